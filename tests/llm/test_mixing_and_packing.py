import json
import zlib
from fractions import Fraction

import numpy as np
import pytest
from odd import check_types, docs, no_docs, odd_docs, odd_rows, prose
from tokenizers import Tokenizer

from sluice.llm import mixing, oracles, packing, queries


def fair(sizes, weights=(5, 2, 1), limit=3):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        rest = total - sum(out.values())
        level = rest / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > limit * sizes[s] + 1e-9}
        if not over:
            return out | {s: level * w[s] for s in free}
        out |= {s: limit * sizes[s] for s in over}
        free -= over
    return out


def test_targets_and_taken(spark):
    rows = [(i, prose(i, 5 + i * 7 % 40), "en", [None, "big", "mid", "low", "tiny"][min(4, i % 9)]) for i in range(400)]
    result = mixing.mix(docs(spark, rows))
    check_types(result, doc_id="LongType", size="LongType", source_size="LongType", target="DoubleType", taken="LongType")
    got = result.collect()
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
    targets = fair(sizes)
    for r in got:
        assert r.target == pytest.approx(targets[r.source], abs=1e-3) and r.source_size == sizes[r.source]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 45, s
    again = {r.doc_id: r.taken for r in mixing.mix(docs(spark, rows[::-1]).repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_buckets_change_nothing_but_order(spark, monkeypatch):
    rows = [(i, prose(i, 10), "en", "ab"[i % 2]) for i in range(300)]
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    got = mixing.mix(docs(spark, rows)).collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 10


def test_buckets_keep_the_order(spark, monkeypatch, same):
    """The same documents are taken however many buckets there are: those of the SQL."""
    rows = [(i * 7919 % 1009, prose(i, 10 + i % 3), "en", "ab"[i % 2]) for i in range(300)] + [(None, prose(9, 10), "en", "a")] * 2
    whole = sorted(map(str, mixing.mix(docs(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    assert sorted(map(str, mixing.mix(docs(spark, rows)).collect())) == whole
    same(queries.QUERIES["op7_mixing"], oracles.ORACLES["op7_mixing"])


def test_mix_of_odd_rows(spark):
    assert mixing.mix(odd_docs(spark)).count() == len(odd_rows())
    assert mixing.mix(no_docs(spark)).count() == 0
    empty = mixing.mix(docs(spark, [(1, None, None, None), (2, "", None, "a")])).collect()
    assert {(r.target, r.taken) for r in empty} == {(0.0, 0)}


def test_resample_emits_what_mix_says(spark):
    rows = odd_docs(spark)
    asked = {}
    for r in mixing.mix(rows).collect():
        asked[r.doc_id] = asked.get(r.doc_id, 0) + r.copies
    emitted = mixing.resample(rows)
    assert emitted.columns == rows.columns
    found = {}
    for r in emitted.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {k: v for k, v in asked.items() if v}
    assert mixing.resample(no_docs(spark)).count() == 0


WHOLE = Tokenizer.from_file(packing.TOKENIZER)


def check_packing(got, rows, window):
    tokens = [WHOLE.encode(t or "", add_special_tokens=False).ids + [2] for _, t, *_ in rows]
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i in {r[0] for r in rows}:
        own = [t for t, r in zip(tokens, rows, strict=True) if r[0] == i]
        if len(own) > 1:
            assert sum(p.length for p in by_doc[i]) == sum(map(len, own))
            continue
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(own[0]) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(own[0][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(own[0])
    lengths = {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == lengths.get(p.sequence_id, 0)
        lengths[p.sequence_id] = p.offset + p.length
    assert sorted(lengths) == list(range(len(lengths)))
    assert all(n <= window and (n == window or n & (n - 1) == 0) for n in lengths.values())
    return lengths


@pytest.mark.parametrize(("window", "quantum"), [(4096, 1024), (64, 16), (64, 200)])
def test_packing_round_trip(spark, window, quantum):
    rows = odd_rows()
    result = packing.pack(odd_docs(spark), window=window, quantum=quantum)
    check_types(result, **dict.fromkeys(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), "LongType"))
    check_packing(result.collect(), rows, window)


def test_windows_keep_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 20)
    rows = [(i, prose(i, 60), "en", "aab"[i % 3]) for i in range(120)]
    got = packing.pack(docs(spark, rows), window=512, quantum=64).collect()
    lengths = check_packing(got, rows, 512)
    share, seen = {}, {}
    for p in got:
        s = "aab"[p.doc_id % 3]
        share[s] = share.get(s, 0) + p.length / sum(lengths.values())
        seen.setdefault(p.sequence_id, {}).setdefault(s, []).append(p.length)
    deficit = 0.0
    for k in range(sum(n == 512 for n in lengths.values())):
        deficit += sum(seen[k].get("b", [0])) - share["b"] * 512
        assert abs(deficit) <= 2 * 64 + 1


def test_given_shares(spark):
    rows = [(i, prose(i, 60), "en", "ab"[i % 2]) for i in range(80)]
    got = packing.pack(docs(spark, rows), shares={"a": 3.0, "b": 1.0}, window=512, quantum=64).collect()
    check_packing(got, rows, 512)
    early = [p for p in got if p.sequence_id < 6]
    assert sum(p.length for p in early if p.doc_id % 2 == 0) / sum(p.length for p in early) == pytest.approx(0.75, abs=0.05)


def merged(parts):
    """(doc_id, start, length) with what follows on in the same document as one."""
    out = []
    for doc, start, length in parts:
        if out and out[-1][0] == doc and out[-1][1] + out[-1][2] == start:
            out[-1][2] += length
        else:
            out.append([doc, start, length])
    return out


@pytest.mark.parametrize("shares", [{"a": 3.0, "b": 1.0, "c": 2.0}, None])
def test_deficit_round_robin_by_simulation(spark, shares):
    """The stream is what serving the queues round by round gives, with each queue in the order it came out in."""
    window, quantum = 512, 64
    rows = [(i, prose(i, 10 + i * 13 % 70), "en", "abcb"[i % 4]) for i in range(70)]
    got = sorted(packing.pack(docs(spark, rows), shares=shares, window=window, quantum=quantum).collect(), key=lambda p: (p.sequence_id, p.offset))
    source, queues, totals = {r[0]: r[3] for r in rows}, {}, {}
    for p in got:
        if p.start == 0:
            queues.setdefault(source[p.doc_id], []).append((p.doc_id, p.doc_tokens))
            totals[source[p.doc_id]] = totals.get(source[p.doc_id], 0) + p.doc_tokens
    quota = {s: Fraction(w) * window / sum(map(Fraction, (shares or totals).values())) for s, w in (shares or totals).items()}
    left = {s: [(d, at, min(quantum, n - at)) for d, n in q for at in range(0, n, quantum)] for s, q in queues.items()}
    deficit, stream = dict.fromkeys(left, Fraction(0)), []
    while any(left.values()):
        for s in sorted(left):
            deficit[s] += quota[s]
            while left[s] and left[s][0][2] <= deficit[s]:
                stream.append(left[s].pop(0))
                deficit[s] -= stream[-1][2]
    assert merged((p.doc_id, p.start, p.length) for p in got) == merged(stream)


def test_layout_does_not_depend_on_the_files(spark):
    rows = [(i % 50, prose(i, 20 + i % 30), "en", "ab"[i % 2]) for i in range(90)] + [(7, prose(7, 20), "en", "a")] * 3
    one = packing.pack(docs(spark, rows).coalesce(1), window=512, quantum=64).collect()
    other = packing.pack(docs(spark, rows[::-1]).repartition(5), window=512, quantum=64).collect()
    assert sorted(one) == sorted(other)


def test_other_tokenizers_encode_whole_texts(tmp_path):
    described = json.load(open(packing.TOKENIZER))
    described["normalizer"] = None
    (tmp_path / "cased.json").write_text(json.dumps(described))
    words, whole = packing.WordIds(str(tmp_path / "cased.json")), Tokenizer.from_file(str(tmp_path / "cased.json"))
    for text in ("Some Cased  Words, and more", "", "x\x1fy"):
        assert words.ids(text) == np.array(whole.encode(text, add_special_tokens=False).ids, words.dtype).tobytes()
    assert packing.word_ids(packing.TOKENIZER).by_words and not words.by_words


def test_pack_nothing(spark):
    assert packing.pack(no_docs(spark)).count() == 0


def test_words_have_the_tokenizer_s_ids():
    words = packing.word_ids(packing.TOKENIZER)
    texts = [t or "" for _, t, *_ in odd_rows()] + ["don't IT'S İstanbul ΣΑΣ 12ab!? ½ × naïve… 'S The'll ¡hola! ª º µ ſ ŉ Ÿ e\u0301\u0327 \u2003x\xa0y", "<|startoftext|> <| end"]
    for t in texts:
        assert words.ids(t) == np.array(WHOLE.encode(t, add_special_tokens=False).ids, words.dtype).tobytes()
