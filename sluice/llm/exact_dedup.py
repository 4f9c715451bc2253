"""Exact duplicates by two passes over a Bloom filter; DataFrame functions only.

Pass one marks, in a bit map of bounded size, the slots that at least two rows hit. Pass two probes it: a row with a
slot that nobody else hit has no copy and passes straight through; only the others are shuffled and grouped by their
SHA-256. The map is a small table of 4 KiB bit maps that is broadcast, of ``2 ** max_bits`` bits at most. More rows than
it holds are dealt by digest into shards of their own folders, and both passes run over one shard after the other, so
that a map keeps its bits a row at any size. The grouping decides, the filter only spares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import BITS_PER_ROW, MAX_BITS, maybe_repeated, repeated_slots
from .common import doc_columns, join_groups, materialise, materialise_all, power_of_two, text_or_empty


def probed(rows: DataFrame, total: int, max_bits: int = MAX_BITS) -> DataFrame:
    """``rows`` (``total`` of them, with text_sha256) with ``maybe``: false only where no other row has the same digest."""
    shards = max(1, -(-total * BITS_PER_ROW // (1 << max_bits)))
    bits = power_of_two(-(-total // shards) * BITS_PER_ROW, 16, max_bits)

    def marked(own: DataFrame) -> DataFrame:
        return maybe_repeated(own, "text_sha256", repeated_slots(own, "text_sha256", bits), bits, "maybe")

    if shards == 1:
        return materialise(marked(rows), "probed")
    shard = F.pmod(F.xxhash64(F.lit("shard"), F.col("text_sha256")), F.lit(shards).cast("long"))
    dealt = materialise(rows.withColumn("shard", shard), "shards", by=["shard"])
    return materialise_all((marked(dealt.where(F.col("shard") == i).drop("shard")) for i in range(shards)), "probed")


def exact_dedup(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty, so null and empty texts form one group. Of equal texts the
    row with the largest doc_id stays (a null doc_id is the smallest); of repeated rows with that same doc_id exactly
    one stays. An empty table gives an empty result. Extra columns are ignored.
    """
    rows = materialise(
        doc_columns(docs, "doc_id", "text").select(
            "doc_id", F.sha2(text_or_empty().cast("binary"), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row_no")
        ),
        "digests",
    )
    total = rows.count()
    marked = probed(rows, total, max_bits)
    alone = marked.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    shared = marked.where("maybe").drop("maybe")
    groups = materialise(
        shared.groupBy("text_sha256").agg(
            F.max(F.struct("doc_id", "row_no")).alias("keep"), F.count(F.lit(1)).alias("group_size")
        ),
        "groups",
    )
    judged = join_groups(shared, groups, "text_sha256", "group_size", total).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("keep.row_no")).alias("kept"),
        "text_sha256",
    )
    return alone.unionByName(judged)


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without its exact copies, all columns and their order kept; the rules are those of exact_dedup.

    Rows that the filter clears are passed on where they were read; only the others are shuffled. Of rows with the same
    text and the same largest doc_id, any one stays.
    """
    names = [F.col(f"`{n}`") for n in docs.columns]
    digest = F.sha2(F.coalesce(F.col("`text`"), F.lit("")).cast("binary"), 256)
    rows = materialise(docs.select(F.col("`doc_id`").alias("doc_id"), digest.alias("digest")), "digests")
    bits = power_of_two(rows.count() * BITS_PER_ROW, 16, MAX_BITS)
    maps = materialise(repeated_slots(rows, "digest", bits), "maps")
    shared = maybe_repeated(rows, "digest", maps, bits, "maybe").where("maybe")
    winners = shared.groupBy(F.col("digest").alias("__won")).agg(F.max("doc_id").alias("__keep"))
    told = maybe_repeated(docs.withColumn("__digest", digest), "__digest", maps, bits, "__maybe")
    won = (F.col("__digest") == F.col("__won")) & F.col("doc_id").eqNullSafe(F.col("__keep"))
    stay = told.where("__maybe").join(winners, won, "left_semi").dropDuplicates(["__digest"])
    return told.where(~F.col("__maybe")).select(*names).unionByName(stay.select(*names))
