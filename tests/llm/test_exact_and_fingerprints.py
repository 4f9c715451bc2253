import hashlib
import re
import unicodedata

import pytest
from conftest_data import DATA
from odd import check_types, docs, no_docs, odd_docs, odd_rows, prose

from sluice.llm import bloom, exact_dedup, fingerprints
from sluice.llm.common import read

KEY = lambda i: -1 if i is None else i


def test_exact_groups(spark):
    result = exact_dedup.exact_dedup(odd_docs(spark))
    check_types(result, doc_id="LongType", keep_id="LongType", group_size="LongType", kept="BooleanType", text_sha256="StringType")
    groups = {}
    for i, text, *_ in odd_rows():
        groups.setdefault(text or "", []).append(i)
    got = result.collect()
    assert len(got) == len(odd_rows())
    by_hash = {}
    for r in got:
        by_hash.setdefault(r.text_sha256, []).append(r)
    assert len(by_hash) == len(groups)
    for text, ids in groups.items():
        own = by_hash[hashlib.sha256(text.encode()).hexdigest()]
        keep = max(ids, key=KEY)
        assert sorted((KEY(r.doc_id) for r in own)) == sorted(map(KEY, ids))
        assert {(r.keep_id, r.group_size) for r in own} == {(keep, len(ids))}
        assert [r.doc_id for r in own if r.kept] == [keep]


def test_exact_empty_and_hot(spark):
    assert exact_dedup.exact_dedup(no_docs(spark)).count() == 0
    hot = docs(spark, [(i, "same" if i % 3 == 0 else f"text {i}", "en", "a") for i in range(6000)])
    got = exact_dedup.exact_dedup(hot).where("group_size > 1").collect()
    assert len(got) == 2000 and {r.keep_id for r in got} == {5997} and sum(r.kept for r in got) == 1
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(hot).collect()) == sorted([i for i in range(6000) if i % 3] + [5997])


def test_shards_change_no_result(spark):
    rows = docs(spark, [(i, "same" if i % 3 == 0 else f"text {i // 2}", "en", "a") for i in range(300)])
    told = exact_dedup.probed(
        rows.selectExpr("doc_id", "sha2(text, 256) AS text_sha256", "monotonically_increasing_id() AS row_no"), 300, max_bits=11
    ).collect()
    assert len(told) == 300
    times = {}
    for r in told:
        times[r.text_sha256] = times.get(r.text_sha256, 0) + 1
    assert all(r.maybe for r in told if times[r.text_sha256] > 1)
    alone = [r.maybe for r in told if times[r.text_sha256] == 1]
    assert len(alone) == 100 and sum(alone) <= 10
    in_one = sorted(map(tuple, exact_dedup.exact_dedup(rows).collect()))
    assert sorted(map(tuple, exact_dedup.exact_dedup(rows, max_bits=11).collect())) == in_one


def test_drop_copies_keeps_columns(spark):
    rows = odd_docs(spark)
    left = exact_dedup.drop_copies(rows)
    assert left.columns == rows.columns
    assert sorted((r.text or "") for r in left.collect()) == sorted({t or "" for _, t, *_ in odd_rows()})
    assert exact_dedup.drop_copies(no_docs(spark)).count() == 0


def test_the_filter_never_misses_a_repeat(spark):
    rows = spark.createDataFrame([(str(i % 900),) for i in range(1000)], "d string")
    told = bloom.maybe_repeated(rows, "d", bloom.repeated_slots(rows, "d", 1 << 16), 1 << 16, "maybe").collect()
    assert all(r.maybe for r in told if int(r.d) < 100)
    assert sum(r.maybe for r in told) < 260


def canon(text):
    fold = lambda t: unicodedata.normalize("NFKC", t)
    return re.sub(r"[\s\x85]+", " ", fold(fold(text).casefold())).strip(" ")


def brute(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), float(canon(text) == canon(edited)), float(canon(text) == canon(after)))
    return out


@pytest.mark.parametrize("stretch", [2, 1000])
def test_fingerprints_by_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(fingerprints, "STRETCH_ROWS", stretch)
    rows = [(i * 3, t) for i, t in enumerate([prose(i % 7, 20 + i % 3) for i in range(40)] + [None, "", "É", "e\u0301", "Straße", "STRASSE", "ﬁ x", "FI\u00a0 X", "a", "aa", "aaa"])]
    result = fingerprints.fingerprints(docs(spark, [(i, t, None, None) for i, t in rows]))
    check_types(result, n_chars="LongType", near_edited="DoubleType", near_next="DoubleType", fingerprint="StringType")
    got = {r.doc_id: r for r in result.collect()}
    assert {i: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for i, r in got.items()} == brute(rows)
    classes = {}
    for i, t in rows:
        classes.setdefault(canon(t or ""), []).append(i)
    for ids in classes.values():
        assert {(got[i].class_id, got[i].class_size) for i in ids} == {(min(ids), len(ids))}
        assert len({got[i].fingerprint for i in ids}) == 1
    assert len({r.fingerprint for r in got.values()}) == len(classes)


def test_fingerprints_of_odd_rows(spark):
    assert fingerprints.fingerprints(odd_docs(spark)).count() == len(odd_rows())
    assert fingerprints.fingerprints(no_docs(spark)).count() == 0
    alone = fingerprints.fingerprints(docs(spark, [(1, "abcd", None, None)])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and alone.near_next == 1.0


def test_fingerprints_of_the_table_by_brute_force(spark):
    table = read(spark, DATA, "documents")
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in fingerprints.fingerprints(table).collect()}
    assert got == brute([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()])


@pytest.mark.parametrize("stretch", [1, 3, 1000])
def test_rows_that_share_an_id_follow_each_other(spark, monkeypatch, stretch):
    monkeypatch.setattr(fingerprints, "STRETCH_ROWS", stretch)
    ids = [None] * 40 + [5] * 30 + list(range(20))
    rows = [(i, f"text {k} of {i}", None, None) for k, i in enumerate(ids)] + [(5, "again", None, None)] * 4
    got = fingerprints.with_next_text(docs(spark, rows)).collect()
    own = {t: KEY(i) for i, t, *_ in rows}
    assert sorted(r.next_text for r in got) == sorted(r.text for r in got) == sorted(t for _, t, *_ in rows)
    falls = [own[r.text] - own[r.next_text] for r in got]
    assert sorted({f for f in falls if f < 0}) == [-1 - 19] and falls.count(-20) == 1
    assert {f for f in falls if f > 0} <= {1}
    again = fingerprints.with_next_text(docs(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
