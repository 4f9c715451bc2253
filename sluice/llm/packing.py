"""Packing documents into fixed windows of tokens with a controlled mixture of sources.

Each source is a queue of documents, and a deficit round-robin serves them: every round adds a source's share of the
window to its deficit, and a slice (at most QUANTUM tokens of a document) leaves in the first round whose deficit covers
it. What a round leaves unspent is carried to the next. So the slice that ends at token ``e`` of its queue leaves in
round ceil(e / share): a formula that every row can work out by itself, given its place in the queue, which is a prefix
sum. Slices in the order (round, source, place) make one stream, which is cut every WINDOW tokens: windows, shares and
deficits run on across partitions, and only the end of the stream could need padding. That end is cut into windows that
are powers of two, so no token of padding is left.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import doc_columns, map_batches, materialise, running_sum

WINDOW = 4096
QUANTUM = 1024
END_ID = 2
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Rows in a bucket of a prefix sum.
BUCKET_ROWS = 20_000
#: Words whose ids a worker remembers.
REMEMBERED = 500_000

_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\sa-z0-9ß-öø-ſ]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-įı-ſ]+")
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


#: How a tokenizer must normalise and split for words to be encoded one by one; others encode whole texts.
_NORMALISERS = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_by_words(described: dict) -> bool:
    """Whether a tokenizer (its JSON) is a byte-level BPE that splits as ``_PIECES`` does."""
    model, steps = described["model"], (described.get("normalizer") or {}).get("normalizers", [])
    first, *others = (described.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return (
        [(n["type"], n.get("pattern", {}).get("Regex")) for n in steps] == _NORMALISERS
        and first.get("pattern", {}).get("Regex") == _SPLIT
        and first.get("behavior") == "Removed"
        and [o["type"] for o in others] == ["ByteLevel"]
        and model.get("type") == "BPE"
        and bool(model.get("end_of_word_suffix"))
        and not model.get("continuing_subword_prefix")
        and not model.get("dropout")
    )


class WordIds(dict):
    """Ids of white-space separated words as little-endian bytes; the whole tokenizer for words of unusual characters.

    The vocabulary never joins what white space separates, so a text's ids are its words' ids in a row. Its merges run
    as ranks over bytes, with the byte 0xFF, which UTF-8 never has, for the end of a word. A tokenizer that splits
    otherwise encodes whole texts.
    """

    def __init__(self, path: str):
        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.type = "H" if self.whole.get_vocab_size(True) <= 1 << 16 else "I"
        self.dtype = "<u2" if self.type == "H" else "<u4"
        with open(path) as f:
            described = json.load(f)
        self.by_words = splits_by_words(described)
        if not self.by_words:
            return
        model = described["model"]
        letters, vocab, suffix = _byte_letters(), model["vocab"], model["end_of_word_suffix"]
        byte_of = {c: b for b, c in enumerate(letters)}
        end = b"\xff"
        known = {bytes([b]): vocab[c] for b, c in enumerate(letters)}
        known |= {bytes([b]) + end: vocab[c + suffix] for b, c in enumerate(letters) if b != 0xFF}
        for merge in model["merges"]:
            token = "".join(merge.split(" ") if isinstance(merge, str) else merge)
            stem = token.removesuffix(suffix)
            known[bytes([byte_of[c] for c in stem]) + end * (stem != token)] = vocab[token]
        self.by_rank = list(known.values())
        ranks = {piece: rank for rank, piece in enumerate(known)}
        self.piece = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word) or "<|" in word:
            out = array(self.type, self.whole.encode(word, add_special_tokens=False).ids).tobytes()
        else:
            low, by_rank = word.lower(), self.by_rank
            if low.isalpha():
                out = array(self.type, [by_rank[r] for r in self.piece(low.encode() + b"\xff")]).tobytes()
            elif low[-1] in ".," and low[:-1].isalpha():
                out = self[low[:-1]] + self[low[-1]]
            else:
                found = [by_rank[r] for p in _PIECES.findall(low) for r in self.piece(p.encode() + b"\xff")]
                out = array(self.type, found).tobytes()
        if len(self) < REMEMBERED and len(word) < 64:
            self[word] = out
        return out

    def ids(self, text: str) -> bytes:
        if not self.by_words or _ODD_SPACE.search(text):
            return array(self.type, self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, text.split()))


_known: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _known:
        _known[path] = WordIds(path)
    return _known[path]


def tokenise(docs: DataFrame, path: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """(doc_id, source_key, tie, doc_tokens, ids): each document's ids as little-endian bytes, the end id last.

    ``tie`` is a hash of the text, which with doc_id gives documents an order.
    """

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        end, width = np.array([end_id], words.dtype).tobytes(), np.dtype(words.dtype).itemsize
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [words.ids(t or "") + end for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in ("doc_id", "source_key", "tie")], pa.array([len(i) // width for i in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "source_key", "tie", "doc_tokens", "ids"],
                )

    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("v"), "source"))
    rows = doc_columns(docs, "doc_id", "text", "source").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("source_key"), F.xxhash64("text").alias("tie")
    )
    return map_batches(rows, tokenised, "doc_id bigint, source_key string, tie bigint, doc_tokens bigint, ids binary")


def tail_edges(total: int, window: int = WINDOW) -> list[int]:
    """Where windows begin at the end of a stream: what is left of the last full window is cut at powers of two."""
    at, edges = total - total % window, []
    while at < total:
        edges.append(at)
        at += 1 << ((total - at).bit_length() - 1)
    return edges


def pieces(slices: DataFrame, total: int, window: int = WINDOW) -> DataFrame:
    """Cut slices (row_no, start, length, place in the stream) where windows begin."""
    edges = tail_edges(total, window)
    tail = F.array(*[F.lit(e) for e in edges]).cast("array<bigint>") if edges else F.array().cast("array<bigint>")
    end = F.col("place") + F.col("length")
    first, last = F.floor(F.col("place") / window) + 1, F.floor((end - 1) / window)
    full = F.when(first <= last, F.transform(F.sequence(first, last), lambda k: k * window)).otherwise(F.array().cast("array<bigint>"))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.col("place")), full, F.filter(tail, lambda x: (x > F.col("place")) & (x < end)))))
    ends = F.concat(F.slice(cuts, F.lit(2), F.size(cuts)), F.array(end))
    cut = slices.withColumn("__cut", F.explode(F.arrays_zip(cuts.alias("a"), ends.alias("b"))))
    a, b = F.col("__cut.a"), F.col("__cut.b")
    whole = total - total % window
    behind = F.size(F.filter(tail, lambda x: x <= a))
    return cut.select(
        "row_no",
        (F.col("start") + a - F.col("place")).alias("start"),
        (b - a).alias("length"),
        F.when(a < whole, F.floor(a / window)).otherwise(whole // window + behind - 1).cast("long").alias("sequence_id"),
        F.when(a < whole, F.pmod(a, F.lit(window))).otherwise(a - F.get(tail, behind - 1)).cast("long").alias("offset"),
    )


def pack(
    docs: DataFrame, shares: dict[str | None, float] | None = None, window: int = WINDOW, quantum: int = QUANTUM, path: str = TOKENIZER
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``shares`` gives sources their part of each window; by default a source's part is its part of all tokens, so all
    queues last to the end. When a queue runs out, the others go on. A source without a share, or with 0, has the
    smallest share of the others. A null text counts as empty and is its end id alone; a null source is a source of
    its own; every document of the table is packed, repeated rows too. A queue stands by hashes of doc_id and text, so
    the layout is the same however the table is split into files. An empty table gives an empty result. Extra columns
    are ignored.
    """
    tokens = materialise(tokenise(docs, path).withColumn("row_no", F.monotonically_increasing_id()), "tokens", "zstd")
    slim = tokens.select("row_no", "source_key", "doc_tokens", F.xxhash64("doc_id", "tie").alias("lot"), "doc_id", "tie")
    count, total = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("doc_tokens"), F.lit(0))).first()
    parts = max(1, -(-count // BUCKET_ROWS))
    by_source = slim.groupBy("source_key").agg(F.sum("doc_tokens").cast("double").alias("share"))
    if shares:
        least = min([v for v in shares.values() if v > 0], default=1.0)
        share = F.lit(least)
        for name, value in shares.items():
            share = F.when(F.col("source_key") == ("n" if name is None else f"v{name}"), F.lit(float(value) if value > 0 else least)).otherwise(share)
        by_source = by_source.select("source_key", share.alias("share"))
    everything = by_source.agg(F.sum("share")).first()[0] or 1.0
    queues = running_sum(
        slim.withColumn("bucket", F.pmod("lot", F.lit(parts))), "source_key", "bucket", [F.asc(c) for c in ("lot", "doc_id", "tie", "row_no")], F.col("doc_tokens"), "before", by_source
    )
    steps = F.sequence(F.lit(0).cast("long"), F.col("doc_tokens") - 1, F.lit(quantum).cast("long"))
    cut = queues.select("row_no", "source_key", "doc_tokens", "before", "share", F.explode(steps).alias("start")).withColumn(
        "length", F.least(F.lit(quantum), F.col("doc_tokens") - F.col("start"))
    )
    queue_end = F.col("before") + F.col("start") + F.col("length")
    turn = F.ceil(queue_end * F.lit(everything) / (F.col("share") * window))
    spread = max(1, -(-count // BUCKET_ROWS) * 4)
    rounds = max(1, -(-total // window))
    served = cut.select(
        "row_no", "source_key", "start", "length", turn.alias("turn"), queue_end.alias("queue_end"), F.lit("all").alias("stream")
    ).withColumn("bucket", F.floor(F.col("turn") * spread / rounds))
    placed = running_sum(
        served, "stream", "bucket", [F.asc("turn"), F.asc("source_key"), F.asc("queue_end")], F.col("length"), "place"
    )
    by_doc = (
        pieces(placed, total, window)
        .groupBy("row_no")
        .agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    )
    return checked(tokens.join(by_doc, "row_no"), path)


def checked(docs: DataFrame, path: str) -> DataFrame:
    """Each piece of (doc_id, doc_tokens, ids, pieces) as a row, with the CRC-32 of its ids."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = word_ids(path).dtype
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            columns = [batch.column(n).to_pylist() for n in ("doc_id", "doc_tokens", "ids", "pieces")]
            for doc_id, n, ids, cut in zip(*columns, strict=True):
                wide = memoryview(np.frombuffer(ids, dtype).astype("<u4").tobytes())
                for p in cut:
                    crc = zlib.crc32(wide[4 * p["start"] : 4 * (p["start"] + p["length"])])
                    for column, value in zip(out, (doc_id, p["start"], p["length"], crc, n, p["sequence_id"], p["offset"]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return map_batches(docs.select("doc_id", "doc_tokens", "ids", "pieces"), summed, schema)
