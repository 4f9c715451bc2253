import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_data import DATA
from odd import check_types, docs, no_docs, odd_docs, odd_rows
from pyspark.sql import functions as F

from sluice.llm import language_id, toxicity
from sluice.llm.common import held_out, read
from sluice.llm.near_dup import word_hashes


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_languages_are_told_on_held_out_documents(spark):
    table = read(spark, DATA, "documents")
    result = language_id.identify(table)
    check_types(result, doc_id="LongType", held_out="BooleanType", lang_pred="StringType", score="DoubleType")
    true = {r.doc_id: r.lang for r in table.select("doc_id", "lang").collect()}
    got = result.collect()
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == true[r.doc_id] for r in got if r.held_out]
    assert sum(held) >= 0.97 * len(held)


def test_distance_by_brute_force():
    profiles = {"x": language_id.top_grams(*language_id.count_grams("the cat sat on the mat")).tolist(), "y": language_id.top_grams(*language_id.count_grams("der hund im haus der stadt")).tolist()}
    known = language_id.Profiles(profiles)
    top = language_id.top_grams(*language_id.count_grams("the hat")).tolist()
    far = {name: sum(abs(p.index(g) - i) if g in p else known.size for i, g in enumerate(top)) for name, p in profiles.items()}
    name, score = known.judge("the hat")
    assert name == min(far, key=far.get) == "x"
    assert score == pytest.approx(1 - far["x"] / (known.size * len(top)))


def test_grams_are_the_same_in_chunks(monkeypatch):
    text = "Ein Wort, zwei Wörter -- drei!! x  ÿ 12 ende"
    whole = language_id.count_grams(text)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(language_id, "CHUNK", size)
        parts = language_id.count_grams(text)
        assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_language_of_odd_rows(spark):
    got = language_id.identify(odd_docs(spark)).collect()
    assert len(got) == len(odd_rows())
    told = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert all(told[i] == ("und", 0.0) for i in (1, 2, 3, 8))
    assert told[4][0] != "und" and told[9][0] != "und"
    assert language_id.identify(no_docs(spark)).count() == 0
    unlabelled = docs(spark, [(1, "some text", None, "a")])
    assert language_id.identify(unlabelled).first().lang_pred == "und"
    rows = odd_docs(spark)
    kept = language_id.keep_known(rows)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, 9, 10, None, 12, 13}


def test_documents_without_labels_of_language_stay(spark):
    rows = docs(spark, [(1, "some text", None, "a"), (2, "...", None, "a"), (3, None, None, "a"), (4, "Wörter", None, "a")])
    assert {(r.doc_id, r.lang) for r in language_id.keep_known(rows).collect()} == {(1, None), (4, None)}
    assert language_id.keep_known(no_docs(spark)).count() == 0


def test_a_null_language_is_told(spark):
    table = read(spark, DATA, "documents")
    blank = table.withColumn("lang", F.when(~held_out(), F.col("lang")))
    true = {r.doc_id: r.lang for r in table.select("doc_id", "lang").collect()}
    got = language_id.keep_known(blank).select("doc_id", "lang").collect()
    assert sum(r.lang == true[r.doc_id] for r in got) >= 0.97 * len(got)


def test_profiles_by_brute_force(spark):
    """Profiles recomputed by string slices over the drawn documents, of a table with fewer ids than are drawn."""
    table = read(spark, DATA, "documents").limit(400)
    sums = {}
    for r in table.collect():
        if is_held_out(r.doc_id) or r.lang is None or r.text is None:
            continue
        own = sums.setdefault(r.lang, Counter())
        for word in re.sub(r"[\W\d_]+", " ", r.text.lower()).split():
            spaced = f" {word} "
            own.update(word)
            own.update(spaced[i : i + 2] for i in range(len(spaced) - 1))
            own.update(spaced[i : i + 3] for i in range(len(spaced) - 2))

    def code(gram):
        out = 0
        for c in gram:
            out = out << 21 | (1 if c == " " else ord(c) + 1)
        return out

    want = {g: [code(n) for n, _ in sorted(own.items(), key=lambda x: (-x[1], code(x[0])))][: language_id.PROFILE] for g, own in sums.items()}
    assert language_id.learn_profiles(table) == want


def test_the_sample_is_bounded_and_has_no_hot_key(spark):
    rows = docs(spark, [(i, f"word{chr(97 + i % 26)}", "xx" if i % 50 else "yy", "a") for i in range(3000)] + [(7, "again", "xx", "a")] * 1000)
    few = language_id.learn_profiles(rows, learn_from=100)
    assert set(few) == {"xx", "yy"} and all(few.values())


def made_up(spark, n=1200):
    """Texts of which those with an insult are labelled toxic."""
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        text = rng.choice(words, rng.integers(5, 60)).tolist()
        toxic = i % 4 == 0
        if toxic:
            text.insert(int(rng.integers(0, len(text))), ["scoundrel", "villain", "rascal"][i % 3])
        rows.append((i, " ".join(["the", *text]), "en", "a"))
        labels.append((i, int(toxic), 1))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxic_texts_are_found_on_held_out_documents(spark):
    table, labels = made_up(spark)
    model = toxicity.learn(table, labels)
    result = toxicity.score(table, labels, model)
    check_types(result, doc_id="LongType", held_out="BooleanType", score="DoubleType", predicted="IntegerType")
    got = [r for r in result.collect() if r.held_out]
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    right = sum(r.predicted == (r.doc_id % 4 == 0) for r in got)
    assert right >= 0.97 * len(got)
    assert toxicity.score(odd_docs(spark), labels, model).count() == len(odd_rows())
    assert toxicity.score(no_docs(spark), labels, model).count() == 0
    long = " ".join(["w1"] * 250_000)
    pair = toxicity.score(docs(spark, [(1, long, "en", "a"), (2, f"{long} villain {long}", "en", "a")]), labels, model)
    assert {r.doc_id: r.predicted for r in pair.collect()} == {1: 0, 2: 1}


def test_nothing_to_learn_from(spark):
    table, labels = made_up(spark, 40)
    for few in (labels.where("toxic = 0"), labels.limit(0), labels.withColumn("toxic", labels.toxic.cast("int") * None)):
        assert {(r.score, r.predicted) for r in toxicity.score(table, few).collect()} == {(0.0, 0)}


def naive_chance(model, text):
    """The forward pass word by word, from the model's parameters alone."""
    pairs, _ = toxicity.buckets(text)
    row = {int(b): i + 1 for i, b in enumerate(model.known)}
    words = [sum(model.words[row.get(int(b), 0)].astype(float) for b in pair) for pair in pairs.T]
    z = float(model.base)
    for k, width in enumerate(toxicity.WIDTHS):
        padded = words + [np.zeros(toxicity.DIMENSIONS)] * (width - 1)
        for f in range(toxicity.FILTERS):
            seen = [sum(padded[i + o] @ model.filters[k][o][:, f] for o in range(width)) for i in range(len(words))] or [0.0]
            z += max(0.0, max(seen) + model.bias[k][f]) * model.out[k * toxicity.FILTERS + f]
    return 1 / (1 + np.exp(-z))


def a_model(texts, seed=4):
    found = np.unique(np.concatenate([toxicity.buckets(t)[0].ravel() for t in texts]))
    model = toxicity.Model(found[: len(found) // 2], seed=seed)
    model.bias = np.random.default_rng(seed).normal(0, 0.1, model.bias.shape).astype(np.float32)
    model.prepare()
    return model


def test_forward_pass_by_brute_force(monkeypatch):
    texts = ["one", "", "a few words of text", "more words, and more of them " * 30, "one two"]
    model = a_model(texts)
    rows = [model.row_of[toxicity.buckets(t)[0]] for t in texts]
    want = [naive_chance(model, t) for t in texts]
    assert model.probabilities(rows) == pytest.approx(want, abs=1e-4)
    monkeypatch.setattr(toxicity, "SEGMENT", 7)  # documents in overlapping segments
    assert model.probabilities(rows) == pytest.approx(want, abs=1e-4)


def test_gradient_by_differences():
    """What back-propagation gives is the slope of the loss, for every kind of parameter."""
    model = a_model(["some words to learn from and others"], seed=9)
    model.words, model.filters = model.words.astype(float), [f.astype(float) for f in model.filters]
    model.bias, model.out = model.bias.astype(float) + 0.3, model.out.astype(float)
    rows = model.row_of[toxicity.buckets("some words to learn from and others of words")[0]]
    for label in (0, 1):
        found = toxicity.gradient(model, rows, label, 1.0)
        parts = {"words": (model.words, found.words), "bias": (model.bias, found.bias), "out": (model.out, found.out)}
        parts |= {f"filters{k}": (model.filters[k], found.filters[k]) for k in range(len(toxicity.WIDTHS))}
        for name, (held, slope) in parts.items():
            at = list(np.ndindex(*held.shape))[:: max(1, held.size // 12)]
            for i in at:
                if name == "words" and i[0] == 0:
                    continue
                was, loss = held[i], []
                for step in (1e-5, -1e-5):
                    held[i] = was + step
                    loss.append(toxicity.loss(model, rows, label))
                held[i] = was
                own = slope.get(i[0], np.zeros(toxicity.DIMENSIONS))[i[1]] if name == "words" else slope[i]
                assert own == pytest.approx((loss[0] - loss[1]) / 2e-5, abs=1e-4), (name, i)


def test_no_text_is_left_out_by_its_length(spark):
    table, labels = made_up(spark, 60)
    seen = []
    old, toxicity.train = toxicity.train, lambda s, y, g: seen.append((len(s), max(x.shape[1] for x in s)))
    try:
        long = docs(spark, [(0, "w1 " * 120_000, "en", "a")]).unionByName(table.where("doc_id > 0"))
        toxicity.learn(long, labels)
        toxicity.learn(table.unionByName(table), labels)
        toxicity.learn(table, labels, learn_words=600)
    finally:
        toxicity.train = old
    learnt = sum(not is_held_out(i) for i in range(60))
    assert seen[0] == (learnt, 120_000 if not is_held_out(0) else seen[0][1])
    assert seen[1][0] == learnt and 1 < seen[2][0] < learnt


def test_language_of_words():
    assert [toxicity.language_of(word_hashes(t)) for t in ("the cat and the dog", "der Hund und die Katze", "xyz")] == ["en", "de", "other"]


def test_scores_meet_the_threshold_at_the_cutoff():
    model = toxicity.Model(np.array([5]))
    model.cutoffs = {"en": 0.2}
    got = model.scores(np.array([0.0, 0.19, 0.2, 1.0, 0.5, 0.49]), ["en"] * 4 + ["de"] * 2)
    assert (got >= 0.7).tolist() == [False, False, True, True, True, False]


def test_too_many_languages_are_refused(spark, monkeypatch):
    rows = docs(spark, [(i, f"words of {i}", f"l{i % 3}", "a") for i in range(60)])
    assert len(language_id.learn_profiles(rows, size=5)) == 3
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 3)
    whole = language_id.learn_profiles(rows, size=5)
    assert sorted(whole) == ["l0", "l1", "l2"] and all(len(v) == 5 for v in whole.values())
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError):
        language_id.learn_profiles(rows, size=5)
