"""Toxicity by a small convolutional text classifier, trained in numpy.

Words, and their first bytes apart, are hashed to BUCKETS embeddings; a word's is the sum of both. Those seen in MIN_DOCS
training documents are trained and the rest stay zero. Filters of several widths slide over the words, the maximum of each over the whole text is a feature, and a
logistic unit weighs them. The language of a text is told by its function words, and each language has its own
threshold, which the score maps to THRESHOLD. ``lang`` may not be an input of a score, so profiles learnt from it are not
used for that; texts of languages without a list here share one threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import doc_columns, held_out, map_batches, materialise
from .near_dup import _mix, word_bytes, word_hashes

BUCKETS = 1 << 22
WIDTHS = (1, 2, 3)
FILTERS = 8
DIMENSIONS = 16
MIN_DOCS = 3
#: Bytes of a word's beginning that have an embedding too.
PREFIX = 4
#: Labelled documents that the classifier is fitted on, at most, drawn by hash of doc_id whatever their length: in that
#: order, as many as begin within the first LEARN_WORDS words. It bounds what the driver holds (8 bytes a word).
LEARN_FROM = 6_000
LEARN_WORDS = 8_000_000
#: Words in memory as filter responses at a time.
SEGMENT = 100_000
#: Scores from here on are called toxic.
THRESHOLD = 0.7

#: Frequent function words by language.
FUNCTION_WORDS = {
    "de": "der die und das von zu den mit ist ein eine im für auf",
    "en": "the of and to a in is that for it with as was on be by",
    "es": "el los las que y en una por con para del es se un",
    "fr": "le les des et est une du dans qui pour par sur au pas",
}


class Model:
    """The trained parts: bucket numbers (sorted), their embeddings (row 0 is zero), filters, weights, thresholds."""

    def __init__(self, known: np.ndarray, dims: int = DIMENSIONS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.known = known
        self.words = rng.normal(0, 0.1, (len(known) + 1, dims)).astype(np.float32)
        self.words[0] = 0
        self.filters = [rng.normal(0, 0.3, (w, dims, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.float32(-1.0)
        self.cutoffs: dict[str, float] = {}
        self.cutoff = 0.5

    def prepare(self) -> None:
        """Tables for scoring: each bucket's row, and each row's response to every part of every filter."""
        self.row_of = np.zeros(BUCKETS, np.int32)
        self.row_of[self.known] = np.arange(1, len(self.known) + 1)
        self.responses = [[self.words @ part for part in f] for f in self.filters]

    def pooled(self, rows: list[np.ndarray]) -> np.ndarray:
        """The features of each document, given its words' rows; long documents in overlapping segments.

        A filter begins at every word of a document, and past its end meets zeros; without words it meets zeros once.
        """
        reach = max(WIDTHS) - 1
        out = np.zeros((len(rows), len(WIDTHS) * FILTERS), np.float32)
        held: list[tuple[int, np.ndarray, int]] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if not held:
                return
            pad = np.zeros((2, reach), np.int32)
            all_rows = np.concatenate([x for _, r, _ in held for x in (r, pad)], axis=1)
            begin = np.cumsum([0] + [r.shape[1] + reach for _, r, _ in held])
            outside = np.concatenate([np.arange(b + n, e) for b, e, (_, _, n) in zip(begin[:-1], begin[1:], held, strict=True)])
            begin = begin[:-1]
            best = []
            for k, w in enumerate(WIDTHS):
                seen = self.responses[k][0][all_rows[0]] + self.responses[k][0][all_rows[1]]
                for o in range(1, w):
                    seen[:-o] += self.responses[k][o][all_rows[0, o:]]
                    seen[:-o] += self.responses[k][o][all_rows[1, o:]]
                seen[outside] = -np.inf
                best.append(np.maximum(np.maximum.reduceat(seen, begin, axis=0) + self.bias[k], 0))
            found = np.concatenate(best, axis=1)
            np.maximum.at(out, [i for i, _, _ in held], found)
            held, size = [], 0

        for i, r in enumerate(rows):
            if not r.shape[1]:
                r = np.zeros((2, 1), np.int32)
            for at in range(0, r.shape[1], SEGMENT):
                part = r[:, at : at + SEGMENT + reach]
                held.append((i, part, min(SEGMENT, r.shape[1] - at)))
                size += part.shape[1]
                if size >= SEGMENT:
                    flush()
        flush()
        return out

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        z = self.pooled(rows).astype(np.float64) @ self.out.astype(np.float64) + float(self.base)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def scores(self, chances: np.ndarray, languages: list[str]) -> np.ndarray:
        """Chances stretched so that a language's threshold becomes THRESHOLD; order within a language stays."""
        cut = np.array([self.cutoffs.get(g, self.cutoff) for g in languages])
        low = THRESHOLD * chances / cut
        high = THRESHOLD + (1 - THRESHOLD) * (chances - cut) / (1 - cut)
        return np.clip(np.where(chances >= cut, high, np.minimum(low, np.nextafter(THRESHOLD, 0))), 0, 1)


_function_words: dict[str, np.ndarray] = {}


def language_of(hashes: np.ndarray) -> str:
    """The language with most function words among ``hashes``; ``other`` if there is none."""
    if not _function_words:
        _function_words.update({g: np.sort(word_hashes(w)) for g, w in FUNCTION_WORDS.items()})
    best, name = 0, "other"
    for g, own in _function_words.items():
        at = np.searchsorted(own, hashes)
        n = int((own[np.minimum(at, len(own) - 1)] == hashes).sum())
        if n > best:
            best, name = n, g
    return name


def buckets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(2, words) buckets of a text's words and of their beginnings, and the hashes of its words."""
    raw = word_bytes(text)
    hashes = word_hashes(raw)
    begun = _mix(word_hashes(raw, PREFIX) + np.uint64(1))
    return (np.stack((hashes, begun)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), hashes


class Slopes(NamedTuple):
    """The slope of one document's loss by each parameter; of embeddings, by row."""

    words: dict[int, np.ndarray]
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    base: float


def responses(model: Model, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Padded rows and their embeddings, and of every filter the largest response (with ReLU) and where it is."""
    reach = max(WIDTHS) - 1
    padded = np.concatenate((rows, np.zeros((2, reach), np.int32)), axis=1)
    emb = model.words[padded[0]] + model.words[padded[1]]
    n = max(1, rows.shape[1])
    value = np.zeros((len(WIDTHS), FILTERS), model.bias.dtype)
    where = np.zeros((len(WIDTHS), FILTERS), np.int64)
    for k, w in enumerate(WIDTHS):
        seen = emb[:n] @ model.filters[k][0]
        for o in range(1, w):
            seen += emb[o : o + n] @ model.filters[k][o]
        where[k] = seen.argmax(axis=0)
        value[k] = np.maximum(seen[where[k], np.arange(FILTERS)] + model.bias[k], 0)
    return padded, emb, value, where


def loss(model: Model, rows: np.ndarray, label: int) -> float:
    value = responses(model, rows)[2]
    z = float(value.ravel() @ model.out + model.base)
    return float(np.log1p(np.exp(-z if label else z)))


def gradient(model: Model, rows: np.ndarray, label: int, weight: float) -> Slopes:
    """Back-propagation of the log loss, times ``weight``, through the places where the filters respond most."""
    padded, emb, value, where = responses(model, rows)
    z = float(value.ravel() @ model.out + model.base)
    err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * weight
    back = err * model.out.reshape(value.shape) * (value > 0)
    g_filters = [np.zeros_like(f) for f in model.filters]
    g_words: dict[int, np.ndarray] = {}
    for k, w in enumerate(WIDTHS):
        for o in range(w):
            place = where[k] + o
            g_filters[k][o] += emb[place].T * back[k]
            push = model.filters[k][o] * back[k]
            for f in np.flatnonzero(back[k]).tolist():
                for row in padded[:, place[f]].tolist():
                    if row:
                        g_words[row] = g_words.get(row, 0) + push[:, f]
    return Slopes(g_words, g_filters, back, err * value.ravel(), err)


def train(sequences: list[np.ndarray], labels: np.ndarray, languages: list[str], rounds: int = 6, batch: int = 32) -> Model:
    """Fit on bucket sequences by Adagrad on log loss; a quarter of the documents is set aside for the thresholds."""
    order = np.random.default_rng(5).permutation(len(sequences))
    aside, learn = order[: len(order) // 4], order[len(order) // 4 :]
    names, docs = np.unique(np.concatenate([np.unique(sequences[i]) for i in learn]), return_counts=True)
    model = Model(names[docs >= MIN_DOCS])
    model.prepare()
    rows = [model.row_of[s] for s in sequences]
    weight = min(8.0, max(1.0, float((labels[learn] == 0).sum()) / max(1, (labels[learn] == 1).sum()) / 2))
    sums = {"words": np.full_like(model.words, 1e-4), "bias": np.full_like(model.bias, 1e-4), "out": np.full_like(model.out, 1e-4), "base": 1e-4}
    filter_sums = [np.full_like(f, 1e-4) for f in model.filters]
    rng = np.random.default_rng(3)
    for turn in range(rounds):
        rate = 0.1 / (1 + turn)
        rng.shuffle(learn)
        for at in range(0, len(learn), batch):
            g_words: dict[int, np.ndarray] = {}
            g_filters = [np.zeros_like(f) for f in model.filters]
            g_bias, g_out, g_base = np.zeros_like(model.bias), np.zeros_like(model.out), 0.0
            some = learn[at : at + batch]
            for i in some:
                own = gradient(model, rows[i], int(labels[i]), weight if labels[i] else 1.0)
                g_out += own.out
                g_base += own.base
                g_bias += own.bias
                for total, part in zip(g_filters, own.filters, strict=True):
                    total += part
                for row, part in own.words.items():
                    g_words[row] = g_words.get(row, 0) + part
            scale = 1 / len(some)
            if g_words:
                at_rows = np.fromiter(g_words, np.int64, len(g_words))
                step = np.stack(list(g_words.values())) * scale
                sums["words"][at_rows] += step**2
                model.words[at_rows] -= rate * step / np.sqrt(sums["words"][at_rows])
            for k in range(len(WIDTHS)):
                step = g_filters[k] * scale + 1e-4 * model.filters[k]
                filter_sums[k] += step**2
                model.filters[k] -= rate * step / np.sqrt(filter_sums[k])
            for name, step in (("bias", g_bias * scale), ("out", g_out * scale + 1e-4 * model.out), ("base", g_base * scale)):
                sums[name] = sums[name] + step**2
                setattr(model, name, getattr(model, name) - (rate * step / np.sqrt(sums[name])).astype(np.float32))
    model.prepare()
    chances = model.probabilities([rows[i] for i in aside])
    model.cutoff = best_cutoff(chances, labels[aside])
    for g in sorted(set(languages)):
        own = np.array([languages[i] == g for i in aside], bool)
        if (labels[aside][own] == 1).sum() >= 10 and (labels[aside][own] == 0).sum() >= 10:
            model.cutoffs[g] = best_cutoff(chances[own], labels[aside][own])
    return model


def best_cutoff(chances: np.ndarray, labels: np.ndarray) -> float:
    """The cutoff with the best F1, in the middle of the gap it lies in; 0.5 where labels don't tell."""
    if not len(labels) or labels.min() == labels.max():
        return 0.5
    order = np.argsort(-chances, kind="stable")
    hits = np.cumsum(labels[order] == 1)
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + (labels == 1).sum())
    best = int(np.argmax(f1))
    below = chances[order[best + 1]] if best + 1 < len(order) else 0.0
    return float(np.clip((chances[order[best]] + below) / 2, 0.02, 0.98))


def learn(docs: DataFrame, labels: DataFrame, learn_from: int = LEARN_FROM, learn_words: int = LEARN_WORDS) -> Model | None:
    """A model from labelled documents that are not held out; None without both labels.

    Of several labels of a doc_id the largest counts, and of several texts with it that with the smallest hash.
    """
    known = doc_columns(labels, "doc_id", "toxic").where(F.col("toxic").isin(0, 1) & ~held_out() & F.col("doc_id").isNotNull())
    one = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    drawn = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(learn_from)
    texts = doc_columns(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("tie"))
    rows = texts.join(F.broadcast(drawn), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "tie", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [buckets(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in ("doc_id", "toxic", "tie")],
                        pa.array([len(h) for _, h in found], pa.int64()),
                        pa.array([language_of(h) for _, h in found], pa.string()),
                        pa.array([b.astype(np.int32).tobytes() for b, _ in found], pa.binary()),
                    ],
                    ["doc_id", "toxic", "tie", "n", "lang", "words"],
                )

    made = materialise(map_batches(rows, hashed, "doc_id bigint, toxic int, tie bigint, n bigint, lang string, words binary"), "learn")
    sizes = made.groupBy("doc_id").agg(F.min(F.struct("tie", "n")).alias("first")).select("doc_id", "first.*")
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # of learn_from rows at most
    taken = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < learn_words)
    got = made.join(F.broadcast(taken.select("doc_id", "tie")), ["doc_id", "tie"]).dropDuplicates(["doc_id"]).collect()
    got.sort(key=lambda r: r["doc_id"])
    if len({r["toxic"] for r in got}) < 2 or len(got) < 8:
        return None
    return train([np.frombuffer(r["words"], np.int32).reshape(2, -1) for r in got], np.array([r["toxic"] for r in got]), [r["lang"] for r in got])


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The score comes from the whole text alone; null and empty texts get the score of no words. predicted is 1 from
    THRESHOLD on. Without labels of both kinds to learn from, all scores are 0. Repeated rows each get a row; an empty
    table gives an empty result. Extra columns are ignored.
    """
    known = model or learn(docs, labels)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if known is not None:
            known.prepare()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                if known is None:
                    found = np.zeros(part.num_rows)
                else:
                    both = [buckets(t or "") for t in part.column("text").to_pylist()]
                    chances = known.probabilities([known.row_of[b] for b, _ in both])
                    found = known.scores(chances, [language_of(h) for _, h in both])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    if known is not None:  # what prepare() makes is made anew where it is used
        known.row_of = known.responses = None
    rows = doc_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = map_batches(rows, judged, "doc_id bigint, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
