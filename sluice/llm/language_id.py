"""Language identification by rank-order profiles of character n-grams and out-of-place distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import doc_columns, held_out, map_batches

#: n-grams in a profile, of a language and of a document.
PROFILE = 300
#: Labelled documents of each language that a profile is learnt from, at most: a sample by hash of doc_id.
LEARN_FROM = 1_000
#: Languages at most; more are refused. It bounds what is broadcast (LEARN_FROM ids of each) and held by the driver
#: (PROFILE n-grams of each).
MAX_LANGUAGES = 2_000
#: How many times LEARN_FROM documents are let through by the threshold, as the number of ids is an estimate.
DRAWN = 1.5
UNKNOWN = "und"
#: Characters of a text that are in memory as code points at a time.
CHUNK = 1 << 20

#: Rows of a batch whose texts are Python objects at a time.
PART_ROWS = 512

_LETTER = re.compile(r"[^\W\d_]")
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For each code point: itself plus 1 if it is a letter, else 1 (white space)."""
    if "letters" not in _tables:
        points = np.arange(0x110000, dtype=np.int64)
        is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _tables["letters"] = np.where(is_letter, points + 1, 1)
    return _tables["letters"]


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(at, PART_ROWS)


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1-, 2- and 3-grams of letters, words set off by one space. 21 bits hold a character."""
    codes, counts = [], []
    table, last = _letters(), np.ones(1, np.int64)
    for at in range(0, len(text), CHUNK):
        piece = text[at : at + CHUNK].lower().encode("utf-32-le", "replace")
        new = table[np.frombuffer(piece, np.uint32)]
        if at + CHUNK >= len(text):
            new = np.append(new, 1)
        c = np.concatenate((last, new))
        c = c[np.concatenate(([True], (c[1:] != 1) | (c[:-1] != 1)))]
        fresh = len(last) - 1
        two = (c[:-1] << 21) | c[1:]
        three = (two[:-1] << 21) | c[2:]
        keep = c[1:-1] != 1
        one = c[1:] if fresh == 0 else c[fresh + 1 :]
        if fresh:
            two, three, keep = two[fresh:], three[fresh - 1 :], keep[fresh - 1 :]
        grams = np.sort(np.concatenate((one[one != 1], two, three[keep])))
        if len(grams):
            edge = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
            codes.append(grams[edge])
            counts.append(np.diff(np.append(edge, len(grams))))
        last = c[-2:]
    if len(codes) == 1:
        return codes[0], counts[0]
    if not codes:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    names, where = np.unique(np.concatenate(codes), return_inverse=True)
    return names, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def top_grams(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes, most frequent first; equal counts by code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


def learn_profiles(docs: DataFrame, size: int = PROFILE, learn_from: int = LEARN_FROM) -> dict[str, list[int]]:
    """The profile of each language of ``lang``, from rows that are not held out; {} if there are none.

    A language's documents are drawn by their hash: a threshold, from the number of its ids, lets few more than
    ``learn_from`` through where they are read, and the lowest of those are taken. So no task ranks a whole language.
    """
    spark = docs.sparkSession
    known = doc_columns(docs, "doc_id", "lang").where(F.col("lang").isNotNull() & ~held_out())
    counts = known.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("ids")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    shares = spark.createDataFrame([(r["lang"], min(1.0, DRAWN * learn_from / max(1, r["ids"]))) for r in counts], "lang string, share double")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    few = known.withColumn("place", place).join(F.broadcast(shares), "lang").where("place <= share").select("lang", "place", "doc_id").distinct()
    drawn = Window.partitionBy("lang").orderBy("place", "doc_id")
    chosen = few.withColumn("n", F.row_number().over(drawn)).where(F.col("n") <= learn_from).select("doc_id").distinct()
    rows = doc_columns(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sums: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                sums.setdefault(lang, []).append(np.stack(count_grams(text)))
            for lang, pairs in sums.items():
                both = np.concatenate(pairs, axis=1)
                names, where = np.unique(both[0], return_inverse=True)
                n = np.bincount(where, both[1]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array(names), pa.array(n)], ["lang", "gram", "n"])

    counts = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")
    ranked = (
        map_batches(counts, counted, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
        .where(F.col("rank") <= size)
    )
    profiles: dict[str, list[int]] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Profiles:
    """Ranks of every profile's n-grams, in one table for all languages."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.names = sorted(profiles)
        self.size = size
        self.codes = np.unique(np.concatenate([np.array(v, np.int64) for v in profiles.values()] or [np.empty(0, np.int64)]))
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)
        for i, name in enumerate(self.names):
            own = np.array(profiles[name], np.int64)
            self.ranks[np.searchsorted(self.codes, own), i] = np.arange(len(own))

    def judge(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.names or not _LETTER.search(text):
            return UNKNOWN, 0.0
        top = top_grams(*count_grams(text), self.size)
        if not len(top):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, top)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != top)] = len(self.codes)
        ranks = self.ranks[at]
        far = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(np.argmin(far))
        return self.names[best], float(1 - far[best] / (self.size * len(top)))


def identify(docs: DataFrame, profiles: dict[str, list[int]] | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    The nearest profile by out-of-place distance names the language; score is 1 less that distance over the largest
    possible. ``und`` and 0.0 where text is null, empty or without a letter, and everywhere if nothing could be learnt.
    Of languages as near, the first by code point. Whole texts count, in chunks. Profiles are learnt from documents
    that are not held out and whose text and lang are not null, LEARN_FROM of a language at most. Repeated rows each
    get a row; an empty table gives an empty result. Extra columns are ignored.
    """
    known = Profiles(learn_profiles(docs) if profiles is None else profiles)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [known.judge(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    rows = doc_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = map_batches(rows, judged, "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without those whose text is null or has no letter; all columns stay.

    A null ``lang`` becomes the language that ``judge`` tells; one that is given stays. Where no language could be
    learnt, as no document has one, ``lang`` stays null and no document goes that has a letter. An empty table gives an
    empty result.
    """
    known = Profiles(learn_profiles(docs))
    schema = docs.schema

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            at = {n: batch.schema.get_field_index(n) for n in ("text", "lang")}
            texts = batch.column(at["text"]).to_pylist()
            told = [known.judge(t)[0] for t in texts]
            stays = [n != UNKNOWN if known.names else _LETTER.search(t or "") is not None for n, t in zip(told, texts, strict=True)]
            given = batch.column(at["lang"])
            if known.names and given.null_count:
                langs = [own if own is not None else n for own, n in zip(given.to_pylist(), told, strict=True)]
                batch = batch.set_column(at["lang"], batch.schema.field(at["lang"]), pa.array(langs, given.type))
            yield batch.filter(pa.array(stays, pa.bool_()))

    return map_batches(docs, kept, schema)
