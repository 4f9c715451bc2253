"""Canonical exact digests of documents; DataFrame and SQL functions only.

The canonical text is NFKC, case-folded and with each run of white space as one space. Its fingerprint is two xxhash64
values with different prefixes (128 bits). Documents with equal fingerprints are one class only if their canonical
bytes are equal too: the grouping is by the bytes inside equal digests, over the possibly repeated rows alone.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bloom import BITS_PER_ROW, MAX_BITS, maybe_repeated, repeated_slots
from .common import doc_columns, join_groups, materialise, power_of_two, text_or_empty

#: Documents in one stretch of the id order, and the most stretches whose bounds the driver holds (two longs each).
STRETCH_ROWS = 1_000
MAX_STRETCHES = 20_000


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, white space folded and trimmed. ``text`` must not be null.

    Text that is ASCII only needs the case and white space steps. The others go through the ICU library that is part of
    Spark, by SQL's ``java_method``.
    """
    icu = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"

    def call(name: str, method: str, arg: Column) -> Column:
        return F.java_method(F.lit(name), F.lit(method), arg, F.lit(True))

    wide = call(icu[0], "compose", call(icu[1], "foldCase", call(icu[0], "compose", text)))
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(wide)
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x{85}]+", " "))


def digest(canon: Column) -> Column:
    """128 bits of xxhash as 32 hexadecimal digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(*seed, canon)), 16, "0") for seed in ([], [F.lit("wide")])]))


def _stretch(bounds: list[int], key: Column, tie: Column) -> Column:
    """The stretch of a row: how many of the sorted ``bounds`` are below ``key``, by two short scans.

    An id that many rows share is a bound several times; its rows are dealt out to as many stretches by ``tie``, which
    lies in [0, 2**62).
    """
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    tops = F.array(*[F.lit(b[-1]).cast("long") for b in blocks])
    table = F.array(*[F.array(*[F.lit(x).cast("long") for x in b]) for b in blocks])

    def below(of: Column) -> Column:
        block = F.size(F.filter(tops, lambda x: x < of))
        inside = F.when(block < len(blocks), F.size(F.filter(F.get(table, block), lambda x: x < of))).otherwise(0)
        return F.least(block * step + inside, F.lit(len(bounds))).cast("int")

    shared = sorted({x for i, x in enumerate(bounds[1:]) if x == bounds[i]})
    if not shared:
        return below(key)
    times = below(key + 1) - below(key)
    among = (times - 1 - F.floor(tie / F.lit(float(1 << 62)) * times)).cast("int")
    return F.when(key.isin(shared), below(key) + F.greatest(F.lit(0), among)).otherwise(below(key))


def with_next_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the next document by descending doc_id; after the last, the first.

    The id order is cut into stretches of about STRETCH_ROWS documents. A document goes to its stretch, and the first
    of each stretch also to the end of the one before it, so every text is shuffled once and no task holds more than a
    stretch. A null doc_id stands last; equal ids stand by a hash of the text.
    """
    lowest = -(2**63)
    rows = doc_columns(docs, "doc_id", "text").select(
        "doc_id", text_or_empty().alias("text"), F.coalesce(F.col("doc_id"), F.lit(lowest)).cast("long").alias("__key")
    )
    rows = rows.withColumn("__tie", F.pmod(F.xxhash64("text"), F.lit(1 << 62)))
    total = rows.count()
    if total == 0:
        return rows.select("doc_id", "text", F.col("text").alias("next_text"))
    wanted = max(1, min(MAX_STRETCHES, total // STRETCH_ROWS))
    marks = [i / wanted for i in range(1, wanted)]
    bounds = []
    if marks:
        bounds = sorted(rows.agg(F.percentile_approx("__key", marks, 20 * wanted)).first()[0])
    place = F.struct(F.col("__key"), (-F.col("__tie")).alias("__back"))
    placed = rows.withColumn("__stretch", _stretch(bounds, F.col("__key"), F.col("__tie")) if bounds else F.lit(0))
    firsts = {r[0]: r[1] for r in placed.groupBy("__stretch").agg(F.max(place)).collect()}
    present = sorted(firsts)
    count = len(bounds) + 1
    first_key = F.array(*[F.lit(firsts[i][0] if i in firsts else None).cast("long") for i in range(count)])
    first_back = F.array(*[F.lit(firsts[i][1] if i in firsts else None).cast("long") for i in range(count)])
    # descending order: a stretch comes after the next higher one that has rows, and the highest after the lowest
    before = F.array(*[F.lit(present[(bisect.bisect_right(present, i)) % len(present)]) for i in range(count)])
    at = F.col("__stretch")
    own = F.struct(at.alias("stretch"), F.lit(False).alias("guest"))
    guest = F.struct(F.get(before, at).alias("stretch"), F.lit(True).alias("guest"))
    is_first = (F.get(first_key, at) == F.col("__key")) & (F.get(first_back, at) == -F.col("__tie"))
    sent = placed.withColumn("__to", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))))
    order = Window.partitionBy(F.col("__to.stretch")).orderBy(F.col("__to.guest"), F.desc("__key"), F.asc("__tie"))
    return (
        sent.withColumn("next_text", F.lead("text").over(order))
        .where(~F.col("__to.guest"))
        .select("doc_id", "text", "next_text")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    class_id, class_size.

    The edited text has its last floor(n_chars / 2) code points replaced by as many of the next document's first, or
    all it has. An exact digest knows equal or not, so a likeness is 1.0 where fingerprints and canonical bytes are
    equal and else 0.0. class_id is the smallest doc_id of the documents with the same canonical bytes. Null text
    counts as empty; a document that is alone is its own next one; repeated rows each get a row. An empty table gives
    an empty result. Extra columns are ignored.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    canons = (
        with_next_text(docs)
        .select(
            "doc_id",
            n.cast("long").alias("n_chars"),
            edited.alias("__edited"),
            canonical(F.col("text")).alias("__canon"),
            canonical(F.col("next_text")).alias("__next"),
        )
        .withColumn("__edited_canon", canonical(F.col("__edited")))
    )
    rows = materialise(
        canons.select(
            "doc_id",
            "n_chars",
            F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"),
            digest(F.col("__canon")).alias("fingerprint"),
            digest(F.col("__edited_canon")).alias("edited_fingerprint"),
            (F.col("__canon") == F.col("__edited_canon")).cast("double").alias("near_edited"),
            (F.col("__canon") == F.col("__next")).cast("double").alias("near_next"),
            F.sha2(F.col("__canon").cast("binary"), 256).alias("proof"),
        ),
        "fingerprints",
    )
    total = rows.count()
    bits = power_of_two(total * BITS_PER_ROW, 16, MAX_BITS)
    marked = materialise(
        maybe_repeated(rows, "fingerprint", repeated_slots(rows, "fingerprint", bits), bits, "maybe"), "probed"
    )
    groups = materialise(byte_classes(docs, marked.where("maybe").select("doc_id"), bits), "classes")
    alone = marked.where(~F.col("maybe")).select(
        "*", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")
    )
    shared = join_groups(
        marked.where("maybe").withColumn("key", F.concat("fingerprint", "proof")), groups, "key", "class_size", total
    )
    return alone.drop("maybe", "proof").unionByName(shared.drop("key", "maybe", "proof"))


def byte_classes(docs: DataFrame, ids: DataFrame, bits: int) -> DataFrame:
    """(key, class_id, class_size): the documents with one of ``ids``, grouped by fingerprint and canonical bytes.

    The ids are a bit map that is broadcast, so the texts of other documents are read but not moved; equal texts meet
    first where they were read. Documents that only the map lets through are grouped as well, which harms nothing.
    """
    maps = repeated_slots(ids.select(F.xxhash64("doc_id").alias("id_hash")), "id_hash", bits, least=1)
    picked = maybe_repeated(
        doc_columns(docs, "doc_id", "text").withColumn("__id_hash", F.xxhash64("doc_id")), "__id_hash", maps, bits, "__in"
    ).where("__in")
    canon = picked.select("doc_id", canonical(text_or_empty()).alias("canon"))
    return (
        canon.select("doc_id", "canon", digest(F.col("canon")).alias("fingerprint"))
        .groupBy("fingerprint", "canon")
        .agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
        .select(F.concat("fingerprint", F.sha2(F.col("canon").cast("binary"), 256)).alias("key"), "class_id", "class_size")
    )
