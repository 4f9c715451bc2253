"""Mixing sources to target weights by systematic sampling; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import doc_columns, materialise, running_sum, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
#: No source is asked for more than this many times its own words.
MAX_REPEATS = 3
#: Documents in a bucket of the prefix sum.
BUCKET_ROWS = 50_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """From (source_key, source, size): source_key, source_size, target. One row per source.

    Sources, by code point and null last, take ``weights`` in turn and share the sum of all sizes; a target above
    ``max_repeats`` times its source's size stops there and its excess goes to the others by weight. The end of that
    resharing is a common level: target = min(limit, level * weight), found in one pass by the ratio limit / weight.
    """
    by_source = sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = by_source.withColumn(
        "weight",
        F.element_at(cycle, ((F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights) + 1).cast("int")),
    ).withColumn("limit", F.col("source_size") * F.lit(float(max_repeats)))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "source_key")
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    levelled = (
        ranked.withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn(
            "level",
            (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0))) / F.sum("weight").over(onward),
        )
        .withColumn("level", F.coalesce(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_key", "level"))).over(every)["level"], F.lit(0.0)))
    )
    return levelled.select(
        "source_key", "source_size", F.round(F.least("limit", F.col("level") * F.col("weight")), 6).alias("target")
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    Each document of a source expects target / source_size copies. Their prefix sums, from one offset per source drawn
    from ``seed``, cross an integer at each copy that is emitted, so a document gets the floor or the ceiling of what
    it expects. Documents stand by size, largest first, which keeps a source's words close to its target. A null text
    has size 0; a null source is a source of its own; ties go by doc_id, then by text. Repeated rows count each.
    An empty table gives an empty result; sources of size 0 have target 0. Extra columns are ignored.
    """
    return _decisions(docs, weights, max_repeats, seed).drop("tie")


def _decisions(docs: DataFrame, weights: Sequence[float], max_repeats: int, seed: str) -> DataFrame:
    rows = materialise(
        doc_columns(docs, "doc_id", "text", "source").select(
            "doc_id",
            "source",
            F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("v"), "source")).alias("source_key"),
            F.regexp_count(text_or_empty(), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("size"),
            F.xxhash64("text").alias("tie"),
        ),
        "sizes",
    )
    parts = max(1, -(-rows.count() // BUCKET_ROWS))
    order = [F.desc("size"), F.asc_nulls_last("doc_id"), F.asc("tie")]
    # a bucket: a band of like sizes, cut by ranges of the order where there are many rows; both keep to the order
    band = F.lit(1024) - F.floor(F.log2(F.col("size") + 1) * 16).cast("long")
    if parts > 1:
        keyed = materialise(rows.repartitionByRange(parts, *order).withColumn("bucket", band * parts + F.spark_partition_id()), "ranges")
    else:
        keyed = rows.withColumn("bucket", band)
    placed = running_sum(keyed, "source_key", "bucket", order, F.lit(1).cast("long"), "place", source_targets(rows, weights, max_repeats))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("source_key"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        placed.withColumn("__expected", expected)
        .withColumn("__offset", offset)
        .withColumn(
            "copies",
            F.least(
                F.floor(F.col("__expected") * (F.col("place") + 1) + F.col("__offset")) - F.floor(F.col("__expected") * F.col("place") + F.col("__offset")),
                F.lit(max_repeats),
            ).cast("long"),
        )
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "tie")
    )


def resample(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` copies it, with all columns of ``docs``.

    Of rows with the same doc_id and text, one stands for all and is emitted as often as all together.
    """
    names = [F.col(f"`{n}`") for n in docs.columns]
    asked = (
        _decisions(docs, weights, max_repeats, seed)
        .groupBy(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"))
        .agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows"))
        .where("__copies > 0")
    )
    found = docs.withColumn("__own", F.xxhash64("`text`")).join(
        asked, F.col("`doc_id`").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__tie"))
    )
    once = found.where("__rows = 1").unionByName(found.where("__rows > 1").dropDuplicates(["__id", "__tie"]))
    return once.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*names)
