import re
import unicodedata
from itertools import combinations

import numpy as np
import pytest
from conftest_data import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import check_types, docs, no_docs, odd_docs, odd_rows, prose

from sluice.llm import common, near_dup
from sluice.llm.common import read


def words_of(text):
    apart = "".join(" " if c > "\x7f" and unicodedata.category(c)[0] in "ZP" or "\x80" <= c <= "\x9f" else c for c in (text or "").lower())
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", apart)


def grams(text):
    words = words_of(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(class, links) of each row, by all pairs."""
    sets = [grams(t) for _, t, *_ in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and both * 5 >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            parent[max(root(a), root(b))] = min(root(a), root(b))
    ids = [r[0] for r in rows]
    members = {}
    for i in range(len(rows)):
        members.setdefault(root(i), []).append(i)
    out = []
    for own in members.values():
        known = [ids[i] for i in own if ids[i] is not None]
        out += [(ids[i], min(known) if known else None, links[i], len(own)) for i in own]
    return sorted(out, key=str)


def result(spark, rows):
    found = near_dup.near_duplicates(docs(spark, rows))
    check_types(found, doc_id="LongType", class_id="LongType", n_links="LongType", class_size="LongType")
    return sorted((tuple(r) for r in found.collect()), key=str)


def family(start, base, n, step=1):
    """Variants of a text with a few words replaced."""
    words = base.split()
    return [(start + i, " ".join("zz%d" % (i * 7) if j == (i * step) % len(words) else w for j, w in enumerate(words)), "en", "a") for i in range(n)]


@pytest.mark.parametrize("block", [4, 512])
def test_links_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    shared = prose(3, 60)
    rows = family(0, prose(1, 120), 12) + family(100, prose(2, 200), 9, 3)
    rows += [(200 + i, f"{shared} {prose(50 + i, 40)}", "en", "a") for i in range(12)]
    rows += [(300 + i, prose(1, 120), "en", "a") for i in range(5)] + odd_rows()
    assert result(spark, rows) == brute(rows)


def test_nothing_and_odd_rows(spark):
    assert near_dup.near_duplicates(no_docs(spark)).count() == 0
    assert near_dup.keep_one(no_docs(spark)).count() == 0
    assert near_dup.near_duplicates(odd_docs(spark)).count() == len(odd_rows())


def test_one_of_each_class_stays(spark):
    rows = family(10, prose(1, 120), 6) + [(1, prose(8, 50), "en", "a"), (None, prose(1, 120), "en", "a"), (2, None, None, None)]
    left = near_dup.keep_one(docs(spark, rows))
    assert left.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 10]


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=200))
def test_words_of_any_text(text):
    words = words_of(text.encode("utf-8", "replace").decode())
    hashes = near_dup.word_hashes(text)
    assert len(hashes) == len(words)
    assert len(set(hashes.tolist())) == len(set(words))


def test_long_words_and_texts(monkeypatch):
    text = " ".join(f"w{i}" for i in range(5000)) + " " + "y" * 3000 + " end"
    whole = near_dup.word_hashes(text)
    monkeypatch.setattr(near_dup, "_CHUNK", 1000)
    parts = near_dup.word_hashes(text)
    assert len(whole) == len(parts) == 5002
    assert (whole[:5000] == parts[:5000]).all() and whole[-1] == parts[-1]


def test_pruning_keeps_what_may_reach_the_threshold():
    need = near_dup.least_matches()
    rng = np.random.default_rng(1)
    kept = dropped = 0
    for _ in range(4000):
        same = np.cumsum(rng.random(near_dup.HASHES) < 0.8)[near_dup.STEP - 1 :: near_dup.STEP]
        kept += (same >= need).all()
        other = np.cumsum(rng.random(near_dup.HASHES) < 0.4)[near_dup.STEP - 1 :: near_dup.STEP]
        dropped += (other < need).any()
    assert kept >= 3990 and dropped >= 3990


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100)]
    found = {r.node: r.label for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100}


def test_components_with_hubs(spark, monkeypatch):
    """Roots and ends that many edges share go by broadcast, and nothing changes."""
    hubs = [(0, i) for i in range(1, 200)] + [(500, i) for i in range(300, 450)] + [(i, i + 1) for i in range(600, 640)]
    table = spark.createDataFrame([*hubs, (199, 620), (7, 7)], "a long, b long")
    expected = {**dict.fromkeys([*range(200), *range(600, 641)], 0), **dict.fromkeys([*range(300, 450), 500], 300)}
    assert {r.node: r.label for r in near_dup.components(table).collect()} == expected
    monkeypatch.setattr(common, "ONE_TASK_ROWS", 0)
    assert {r.node: r.label for r in near_dup.components(table).collect()} == expected


def test_small_tables_are_few_files(spark, monkeypatch):
    """However many partitions a shuffle has: what a step of a few rows writes is one file, or as many as its rows need."""
    files, plain = [], common.materialise_all

    def counted(parts, label, *more):
        table = plain(parts, label, *more)
        files.append((label, len(table.inputFiles())))
        return table

    monkeypatch.setattr(common, "materialise_all", counted)
    rows = family(0, prose(1, 120), 12) + family(100, prose(2, 200), 9, 3) + odd_rows()
    conf = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert result(spark, rows) == brute(rows)
        few = {label: n for label, n in files if label in ("hooks", "parts", "representatives", "labelled", "classes")}
        assert set(few.values()) == {1} and len(few) == 5
        monkeypatch.setattr(common, "FILE_ROWS", 10)
        assert result(spark, rows) == brute(rows)
        assert 1 < max(n for label, n in files if label == "representatives") <= -(-len(rows) // 10)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_keep_one_tells_rows_apart(spark):
    """An id on several texts: one row of each class stays, and nothing else goes; rows without an id rank last."""
    a, b, c, d, e = (prose(k, 60) for k in (1, 2, 3, 4, 8))
    rows = [(3, a + " end", "en", "s"), (5, a, "en", "s"), (5, b, "en", "s"), (7, c, "en", "s"), (7, c + " end", "en", "s"), (9, e, "en", "s"), (9, e, "en", "s")]
    rows += [(None, d, "en", "s"), (None, d + " end", "en", "s"), (None, d, "en", "s"), (None, a, "en", "s"), (None, "", "en", "s")]
    table = docs(spark, rows)
    kept = near_dup.keep_one(table)
    assert kept.columns == table.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert {(3, a + " end"), (5, b), (9, e), (None, "")} < set(got)
    assert sorted(str(i) for i, _ in got) == ["3", "5", "7", "9", "None", "None"]
    assert {t for i, t in got if i is None} < {"", d, d + " end"}


def test_wide_marks_set_words_apart(spark):
    plain = prose(1, 60)
    words = plain.split()
    rows = [(1, plain, "fr", "a"), (2, "\u3000".join(words), "fr", "a"), (3, "\u00ab\u00a0" + "\u2014".join(words) + "\u00a0\u00bb\u2019\u3002", "fr", "a")]
    assert result(spark, rows) == [(1, 1, 2, 3), (2, 1, 2, 3), (3, 1, 2, 3)]


def test_links_of_the_table_by_brute_force(spark):
    table = read(spark, DATA, "documents")
    got = sorted((tuple(r) for r in near_dup.near_duplicates(table).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()])
