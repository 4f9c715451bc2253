"""Removing text that is repeated across documents: passages wherever they stand, or lines; the first occurrence stays.

Passages (``dedup_passages``): any run of 50 words or more that stands at an earlier place too is cut, wherever it begins
and ends and however its lines are broken. To find them all without a record for each word, every run of 50 words is
named by the least hash of the 16-word runs in it, which neighbours mostly share. Runs of words can only be equal where
their names are, so only stretches whose name occurs twice go on. Equal stretches are settled by one digest each; what
is left, one stretch of each kind, is compared run by run.

Lines (``dedup_lines``): every line that is not blank is a unit of its text with its offsets, and so is every paragraph of several lines, so that
a passage is found where its lines are broken elsewhere. Units with equal digests are grouped over all documents; of a
group, the occurrence with the smallest (doc_id, start) stays and the others are cut out of their documents. What is
cut always stands at an earlier place too, as each unit points to an earlier one.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, join_groups, map_batches, materialise, maybe_in, pick_ids

#: Lines and paragraphs of fewer words are left alone; with 0 every line counts that is not blank.
MIN_WORDS = 0
#: Words of the shortest passage that is cut, and of the runs whose hashes name a passage.
PASSAGE_WORDS = 50
NAME_WORDS = 16

_KEPT = "array<struct<start: bigint, end: bigint, kept_doc_id: bigint, kept_start: bigint>>"
_NOT_WORD = re.compile(r"(?:[^\w\n]|_)+")
_LATIN_WORDS = bytes(c if chr(c).isalnum() or c == 10 else 32 for c in range(256))


def _spaced(text: str) -> str:
    """The text in lower case with spaces for all but letters, digits and line breaks."""
    low = text.lower()
    try:
        return low.encode("latin-1").translate(_LATIN_WORDS).decode("latin-1")
    except UnicodeEncodeError:
        return _NOT_WORD.sub(" ", low)


def units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[bytes, int, int]]:
    """(digest, start, end) of each line that is not blank and of each paragraph of several such lines, if it has
    ``min_words`` words or more; end takes in the line break.

    Units are equal when their words are: case, punctuation and white space don't count, and in a paragraph neither
    do line breaks. A line without a word is equal to one of the same marks. Paragraphs end at blank lines.
    """

    def unit(words: list[str], count: int, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
        if count >= min_words:
            yield hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16).digest(), start, end

    start, first, lines, all_words, total = 0, 0, 0, [], 0
    for line, spaced in zip(text.split("\n"), _spaced(text).split("\n"), strict=True):
        end = min(len(text), start + len(line) + 1)
        words = spaced.split()
        count, words = len(words), words or line.split()
        if words:
            if not lines:
                first = start
            lines, total = lines + 1, total + count
            all_words += words
            yield from unit(words, count, start, end)
        else:
            if lines > 1:
                yield from unit(all_words, total, first, start)
            lines, all_words, total = 0, [], 0
        start += len(line) + 1
    if lines > 1:
        yield from unit(all_words, total, first, len(text))


def cut_spans(spans: list[dict]) -> list[dict]:
    """The spans to cut, none inside another: a paragraph's lines where all of them go, else the paragraph as one."""
    spans = sorted(spans, key=lambda s: (s["start"], -s["end"]))
    out, at = [], 0
    while at < len(spans):
        outer, stop = spans[at], at + 1
        while stop < len(spans) and spans[stop]["start"] < outer["end"]:
            stop += 1
        inner = spans[at + 1 : stop]
        whole = sum(s["end"] - s["start"] for s in inner) == outer["end"] - outer["start"]
        out += inner if whole else [outer]
        at = stop
    return out


def occurrences(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, row_no, digest, start, end) of every unit."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                out: list[list] = [[], [], [], [], []]
                for doc_id, row_no, text in zip(*[part.column(n).to_pylist() for n in ("doc_id", "row_no", "text")], strict=True):
                    for digest, start, end in units(text or "", min_words):
                        for column, value in zip(out, (doc_id, row_no, digest, start, end), strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "row_no", "digest", "start", "end"]
                )

    return map_batches(docs, made, "doc_id bigint, row_no bigint, digest binary, start bigint, end bigint")


def _rows(docs: DataFrame) -> DataFrame:
    return materialise(
        doc_columns(docs, "doc_id", "text").select(
            F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row_no")
        ),
        "texts",
        "zstd",
    )


def _repeated_lines(rows: DataFrame, min_words: int) -> DataFrame:
    """(row_no, lines): the units of a row that stand at an earlier place too, by start."""
    found = materialise(occurrences(rows, min_words), "units")
    ranked = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_no", "start")
    firsts = materialise(
        found.groupBy("digest").agg(F.min(ranked).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1"), "repeated"
    )
    repeats = join_groups(found, firsts, "digest", "times", found.count()).where(
        (F.col("row_no") != F.col("first.row_no")) | (F.col("start") != F.col("first.start"))
    )
    return repeats.groupBy("row_no").agg(
        F.sort_array(
            F.collect_list(F.struct("start", "end", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start")))
        ).alias("lines")
    )


def _cut_texts(texts: list[str | None], removed: list[list[dict]]) -> list[pa.Array]:
    """changed, removed_chars, removed, kept_text of texts whose spans are cut out."""
    kept, counts = [], []
    for text, gone in zip(texts, removed, strict=True):
        at, left = 0, []
        for span in gone:
            left.append(text[at : span["start"]])
            at = span["end"]
        counts.append(sum(s["end"] - s["start"] for s in gone))
        kept.append(text if not gone else "".join(left) + text[at:])
    span = pa.struct([(n, pa.int64()) for n in ("start", "end", "kept_doc_id", "kept_start")])
    return [pa.array([c > 0 for c in counts], pa.bool_()), pa.array(counts, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.string())]


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, changed, removed_chars, removed, kept_text.

    ``removed`` lists the cut spans by start: start and end in the original text (code points), and the doc_id and
    start of the first occurrence. A span holds one line with its line break, or a paragraph whose lines are not all
    repeats on their own. Within a document a line stays once too. A null doc_id ranks last; a null text is kept as null with nothing removed; of repeated rows with one doc_id
    the first that was read keeps its lines. An empty table gives an empty result. Extra columns are ignored.
    """
    rows = _rows(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed = [cut_spans(found or []) for found in batch.column("lines").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *_cut_texts(batch.column("text").to_pylist(), removed)],
                ["doc_id", "changed", "removed_chars", "removed", "kept_text"],
            )

    joined = rows.join(_repeated_lines(rows, min_words), "row_no", "left").select("doc_id", "text", "lines")
    return map_batches(joined, cut, f"doc_id bigint, changed boolean, removed_chars bigint, removed {_KEPT}, kept_text string")


@cache
def _points() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point its kind, its lower case where that is one code point, and whether it is white space.

    Kinds: 0 sets words apart, 1 is part of a word, 2 is a word by itself (scripts that are written without spaces).
    """
    kind = np.zeros(sys.maxunicode + 1, np.uint8)
    low = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        char = chr(c)
        if char.isalnum() or unicodedata.category(char) in ("Mn", "Mc"):
            kind[c] = 1
            small = char.lower()
            if len(small) == 1:
                low[c] = ord(small)
    for a, b in ((0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)):
        kind[a:b][kind[a:b] == 1] = 2
    return kind, low, np.fromiter((chr(c).isspace() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@cache
def _factors() -> np.ndarray:
    return np.multiply.accumulate(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """The words of a text: lower-cased runs of letters, digits and marks, and single characters of Chinese and kana."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, low, space = _points()
        kind = np.zeros(len(points) + 2, np.uint8)
        kind[1:-1] = kinds[points]
        inside = kind > 0
        apart = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        starts, ends = np.flatnonzero(apart & inside[1:]), np.flatnonzero(apart & inside[:-1])
        self.count, self.lengths = len(starts), ends - starts
        self.low = low[points[inside[1:-1]]]
        #: Where a cut before each word falls: after the last white space before it, else at its first letter; the ends
        #: of the text for the first word and after the last.
        blank = np.append(0, np.flatnonzero(space[points]) + 1)
        edges = blank[np.searchsorted(blank, starts, "right") - 1]
        edges[1:] = np.where(edges[1:] > ends[:-1], edges[1:], starts[1:])
        edges[:1] = 0
        self.edges: list[int] = [*edges.tolist(), len(text)]

    def stretches(self, least: int) -> tuple[list[int], list[int], list[int], list[bool]]:
        """First word, number of runs, name, and whether it may hold a run twice, of each stretch of runs of ``least``
        words with one name, which is the least hash of the runs of NAME_WORDS words in a run."""
        at = np.cumsum(self.lengths) - self.lengths
        within = np.arange(len(self.low)) - np.repeat(at, self.lengths)
        letters = self.low * _factors()[within % len(_factors())]
        grams = _mix(np.add.reduceat(letters, at) + self.lengths.astype(np.uint64))
        short, width = min(NAME_WORDS, least), 1
        while width < short:  # what is combined may overlap, as all of it is of the same words
            step = min(width, short - width)
            grams, width = grams[:-step] * np.uint64(0xD1B54A32D192ED03) + grams[step:], width + step
        names = grams = _mix(grams)
        width, wanted = 1, least - short + 1
        while width < wanted:
            step = min(width, wanted - width)
            names, width = np.minimum(names[:-step], names[step:]), width + step
        firsts = np.concatenate(([0], np.flatnonzero(names[1:] != names[:-1]) + 1))
        counts = np.diff(firsts, append=len(names))
        found, own = names[firsts], [False] * len(firsts)
        if len(np.unique(grams)) < len(grams):
            spans = zip(firsts.tolist(), counts.tolist(), found, strict=True)
            own = [bool(np.count_nonzero(grams[f : f + n + wanted - 1] == name) > 1) for f, n, name in spans]
        return firsts.tolist(), counts.tolist(), found.view(np.int64).tolist(), own

    def digests(self, firsts: list[int], stops: list[int]) -> list[bytes]:
        """128 bits for the words in each [first, stop)."""
        spaced = np.full(len(self.low) + self.count, 32, np.uint32)
        spaced[np.arange(len(self.low)) + np.repeat(np.arange(1, self.count + 1), self.lengths)] = self.low
        raw = spaced.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        at = [*np.flatnonzero(np.frombuffer(raw, np.uint8) == 32).tolist(), len(raw)]
        blake2b = hashlib.blake2b
        return [blake2b(raw[at[first] : at[stop]], digest_size=16).digest() for first, stop in zip(firsts, stops, strict=True)]


_STRETCH = dict.fromkeys(("doc_id", "row_no", "first", "n", "start", "name"), pa.int64()) | {"own": pa.bool_(), "digest": pa.binary()}
_STRETCH_SQL = "doc_id bigint, row_no bigint, first bigint, n bigint, start bigint, name bigint, own boolean, digest binary"


def _stretch_batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _STRETCH.values(), strict=True)], list(_STRETCH))


def stretches(rows: DataFrame, least: int) -> DataFrame:
    """Runs of ``least`` words that follow each other under one name, for every text: the first run's first word, the
    number of runs, where they start in the text, the name, whether they may repeat each other, and a digest of all
    their words."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), [[] for _ in _STRETCH]
                for doc_id, row_no, text in zip(*[part.column(n).to_pylist() for n in ("doc_id", "row_no", "text")], strict=True):
                    words = Words(text or "")
                    if words.count < least:
                        continue
                    firsts, counts, names, own = words.stretches(least)
                    digests = words.digests(firsts, [f + n + least - 1 for f, n in zip(firsts, counts, strict=True)])
                    same, starts = ([doc_id] * len(firsts), [row_no] * len(firsts)), [words.edges[f] for f in firsts]
                    for column, values in zip(out, (*same, firsts, counts, starts, names, own, digests), strict=True):
                        column += values
                yield _stretch_batch(out)

    return map_batches(rows, made, _STRETCH_SQL)


def single_runs(texts: DataFrame, least: int) -> DataFrame:
    """The same columns for each single run of ``least`` words in the ``ranges`` (first, n) of the texts; no names."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                words = Words(row["text"])
                places = [f for span in row["ranges"] for f in range(span["first"], span["first"] + span["n"])]
                for some in (places[i : i + (1 << 16)] for i in range(0, len(places), 1 << 16)):
                    n = len(some)
                    same = [[row["doc_id"]] * n, [row["row_no"]] * n, some, [1] * n]
                    digests = words.digests(some, [f + least for f in some])
                    yield _stretch_batch([*same, [words.edges[f] for f in some], [0] * n, [False] * n, digests])

    return map_batches(texts, made, _STRETCH_SQL)


def _first_places(found: DataFrame) -> DataFrame:
    """One row per digest: its first place by (doc_id, row_no, word), how often it occurs, its name and ``own``."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_no", "first", "start", "n")
    first = (F.min(place).alias("kept"), F.count(F.lit(1)).alias("times"), F.min("name").alias("name"), F.max("own").alias("own"))
    return found.groupBy("digest").agg(*first)


def _shared(found: DataFrame) -> DataFrame:
    """The rows whose name others have, or which may repeat themselves, and a share of the others: a small one where up
    to an eighth of the names are such."""
    counted = found.groupBy("name").agg(F.count(F.lit(1)).alias("times"), F.max("own").alias("own"))
    return pick_ids(found, counted.where("times > 1 or own").select("name"), found.count() // 8, "name")


def _later_places(found: DataFrame, places: DataFrame) -> DataFrame:
    """(row_no, first, n, kept_row_no, kept_doc_id, kept_start) of what is not the first of its digest."""
    again = materialise(places.where("times > 1").select("digest", "kept", "times"), "again")
    return (
        join_groups(found, again, "digest", "times", found.count())
        .where((F.col("row_no") != F.col("kept.row_no")) | (F.col("first") != F.col("kept.first")))
        .select(
            "row_no", "first", "n",
            F.col("kept.row_no").alias("kept_row_no"), F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"),
        )
    )


def _repeated_runs(rows: DataFrame, least: int) -> DataFrame:
    """(row_no, runs): every run of ``least`` words of a row that stands at an earlier place too, by first word; runs
    that follow each other may be one entry."""
    found = materialise(_shared(materialise(stretches(rows, least), "stretches")), "shared")
    places = materialise(_first_places(found), "places")
    ranges = _shared(places).groupBy(F.col("kept.row_no").alias("row_no")).agg(F.collect_list(F.struct("kept.first", "kept.n")).alias("ranges"))
    texts = pick_ids(rows, ranges, places.count(), "row_no").join(ranges, "row_no")
    single = materialise(single_runs(texts, least), "runs").withColumn("name", F.xxhash64("digest"))
    runs = materialise(_shared(single), "shared-runs")
    later = _later_places(found, places).unionByName(_later_places(runs, _first_places(runs)))
    run = F.struct("first", "n", "kept_row_no", "kept_doc_id", "kept_start")
    return later.groupBy("row_no").agg(F.sort_array(F.collect_list(run)).alias("runs"))


def passage_spans(text: str, runs: pa.StructArray, least: int) -> list[dict]:
    """The spans of a text that its repeated runs cover, none over another; one goes on while it is in one document."""
    out, edges, stop, row = [], Words(text).edges, 0, None
    for first, n, kept_row, kept_id, kept_start in zip(*[column.to_pylist() for column in runs.flatten()], strict=True):
        end = first + n + least - 1
        if end <= stop:
            continue
        if out and first <= stop and kept_row == row:
            out[-1]["end"] = edges[end]
        else:
            out.append({"start": edges[max(first, stop)], "end": edges[end], "kept_doc_id": kept_id, "kept_start": kept_start})
        stop, row = end, kept_row
    return out


def dedup_passages(docs: DataFrame, least: int = PASSAGE_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, changed, removed_chars, removed, kept_text, repeated_lines.

    Every run of ``least`` words or more that stands at an earlier place too, in another document or the same, is cut,
    and nothing else. Words are equal whatever their case, punctuation and white space. ``removed`` lists the cut spans
    by start: start and end in the original text (code points), and doc_id and start of an earlier passage that holds
    the words of the span. A span takes in the marks and white space up to the next word that stays.

    ``repeated_lines`` lists in the same way the lines and paragraphs, of ``min_words`` words or more, that stand at an
    earlier place, as ``dedup_lines`` finds them; those in no passage stay in the text, and a paragraph's lines are
    listed beside it. Ranks, nulls and empty tables are as there; texts of fewer than ``least`` words stay whole.
    """
    rows = _rows(docs)
    both = _repeated_lines(rows, min_words).join(_repeated_runs(rows, least), "row_no", "full")
    marks = materialise(both, "marks").withColumnRenamed("row_no", "__row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = batch.column("text").to_pylist(), batch.column("runs")
            removed = [passage_spans(t, runs[i].values, least) if runs[i].is_valid else [] for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *_cut_texts(texts, removed), batch.column("lines")],
                ["doc_id", "changed", "removed_chars", "removed", "kept_text", "repeated_lines"],
            )

    told = maybe_in(rows, F.xxhash64("row_no"), marks.select(F.xxhash64("__row").alias("__hash")), marks.count())
    lines = F.coalesce("lines", F.array().cast(_KEPT)).alias("lines")
    joined = told.where("__in").join(marks, F.col("row_no") == F.col("__row"), "left").select("doc_id", "text", "runs", lines)
    changed = map_batches(
        joined, cut, f"doc_id bigint, changed boolean, removed_chars bigint, removed {_KEPT}, kept_text string, repeated_lines {_KEPT}"
    )
    none = F.array().cast(_KEPT)
    clear = told.where(~F.col("__in")).select(
        "doc_id", F.lit(False).alias("changed"), F.lit(0).cast("long").alias("removed_chars"), none.alias("removed"),
        F.col("text").alias("kept_text"), none.alias("repeated_lines"),
    )
    return changed.unionByName(clear)
