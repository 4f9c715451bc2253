"""Helpers that several operators share: tables in the shared folder, skew-proof joins, prefix sums."""

from __future__ import annotations

import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bloom import BITS_PER_ROW, MAX_BITS, maybe_repeated, repeated_slots

#: Rows of an Arrow batch, and what Spark's default is.
BATCH_ROWS = 1_000
DEFAULT_BATCH_ROWS = 10_000
#: Narrow rows that one task may hold of one join key.
ONE_TASK_ROWS = 1_000_000
#: Narrow rows to a file of an intermediate table, where it is known how many rows the table can have.
FILE_ROWS = 50_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one in local mode, as in tests."""
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_dir is None:
        _local_dir = f"file://{tempfile.mkdtemp(prefix='sluice-')}"
    return _local_dir


def materialise(df: DataFrame, label: str, codec: str = "snappy", by: Sequence[str] = (), at_most: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost no recompute.

    With ``by``, in folders by the values of those columns. With ``at_most``, the most (narrow) rows there can be, in no
    more files than one for each FILE_ROWS of them, however many partitions a shuffle has: on a local file system an
    executor starts several processes (chmod) for every file. The folder is removed when the application ends.
    """
    return materialise_all([df if at_most is None else df.coalesce(max(1, -(-at_most // FILE_ROWS)))], label, codec, by)


def materialise_all(parts: Iterable[DataFrame], label: str, codec: str = "snappy", by: Sequence[str] = ()) -> DataFrame:
    """``materialise`` for the rows of one or more tables of one schema, which are written one after the other."""
    path = ""
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        path = path or f"{shared_dir(spark)}/sluice/{label}-{uuid.uuid4().hex}"
        df.write.mode("append").partitionBy(*by).option("compression", codec).parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(schema).parquet(path)


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose workers can import this package wherever they run: its code is sent to them once.

    Where the session leaves Spark's default number of rows in a batch, it is lowered to BATCH_ROWS: a batch of whole
    texts is held by the JVM, on its way, and by the worker at the same time, for each core.
    """
    conf, context = df.sparkSession.conf, df.sparkSession.sparkContext
    if conf.get(_BATCH, str(DEFAULT_BATCH_ROWS)) == str(DEFAULT_BATCH_ROWS):
        conf.set(_BATCH, str(BATCH_ROWS))
    if not any(name.startswith("sluice-code") for name in context._python_includes):
        package = Path(__file__).resolve().parents[1]
        made = Path(tempfile.mkdtemp(prefix="sluice-code-")) / "sluice-code"
        context.addPyFile(shutil.make_archive(str(made), "zip", package.parent, package.name))
    return df.mapInArrow(function, schema)


def doc_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns cannot clash with those an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, heavy: int = 2048) -> DataFrame:
    """Left join ``rows`` to one row per ``key`` of ``groups`` where a key may hold any share of the rows.

    ``size`` in ``groups`` is the number of rows of that key and ``total`` the number of all rows, so fewer than
    ``heavy`` keys can exceed ``total / heavy`` rows: those are broadcast (a proven bound), and what is left has no
    key large enough to matter and is joined by shuffle.
    """
    limit = max(1, total // heavy)
    hot = F.broadcast(groups.where(F.col(size) > limit))
    cold = groups.where(F.col(size) <= limit)
    few = rows.join(hot, key)
    rest = rows.join(hot.select(key), key, "left_anti").join(cold, key, "left")
    return few.unionByName(rest)


def hot_keys(rows: DataFrame, key: str, heavy: int = 2048) -> DataFrame | None:
    """The values of ``key`` with more than 1 / ``heavy`` of the rows, so fewer than ``heavy``, as a small table.

    None where all rows together are few enough for one task.
    """
    total = rows.count()
    if total <= ONE_TASK_ROWS:
        return None
    return materialise(rows.groupBy(key).count().where(F.col("count") > max(1, total // heavy)).select(key), "hot")


def join_unique(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``table``, which has one row per ``key`` at most: keys in ``hot`` by broadcast, others by shuffle."""
    if hot is None:
        return rows.join(table, key, how)
    few = F.broadcast(hot)
    often = rows.join(few, key, "left_semi").join(F.broadcast(table.join(few, key, "left_semi")), key, how)
    return often.unionByName(rows.join(few, key, "left_anti").join(table, key, how))


def running_sum(
    df: DataFrame, group: str, bucket: str, order: Sequence[Column], value: Column, out: str, per_group: DataFrame | None = None
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the same ``group``, ordered by ``bucket`` then ``order``.

    No task holds more than one bucket's rows: sums within buckets are local, and the buckets' own totals (one row
    per bucket) give each bucket its start. ``group`` and ``bucket`` must not be null. The columns of ``per_group``, one
    row per group, come along by way of the totals, so that a group with most of the rows is never one join key.
    """
    keyed = df.withColumn("__value", value)
    local = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("__group").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        keyed.groupBy(F.col(group).alias("__group"), F.col(bucket).alias("__bucket"))
        .agg(F.sum("__value").alias("__total"))
        .select("__group", "__bucket", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    )
    if per_group is not None:
        totals = totals.join(per_group.withColumnRenamed(group, "__group"), "__group")
    sums = keyed.withColumn("__local", F.coalesce(F.sum("__value").over(local), F.lit(0)))
    joined = sums.join(totals, (F.col(group) == F.col("__group")) & (F.col(bucket) == F.col("__bucket")))
    return joined.withColumn(out, F.col("__base") + F.col("__local")).drop(
        "__value", "__group", "__bucket", "__base", "__local"
    )


def power_of_two(n: float, low: int, high: int) -> int:
    """The power of two at or above ``n``, within [2**low, 2**high]."""
    return 1 << min(high, max(low, math.ceil(math.log2(max(1.0, n)))))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents no model may learn from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def maybe_in(docs: DataFrame, key: Column, hashes: DataFrame, total: int) -> DataFrame:
    """``docs`` with ``__in``: false only where ``key`` (a hash) is not in ``hashes``, told by a broadcast bit map of
    bounded size."""
    bits = power_of_two(total * BITS_PER_ROW, 16, MAX_BITS)
    maps = repeated_slots(hashes, hashes.columns[0], bits, least=1)
    return maybe_repeated(docs.withColumn("__key_hash", key), "__key_hash", maps, bits, "__in").drop("__key_hash")


def pick_ids(docs: DataFrame, ids: DataFrame, total: int, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that may have one of ``ids`` (``key``): all that have, and a small share of the others.

    Rows are dropped where they are read, and none is shuffled.
    """
    hashes = ids.select(F.xxhash64(key).alias("__hash"))
    return maybe_in(docs, F.xxhash64(f"`{key}`"), hashes, total).where("__in").drop("__in")


def drop_rows(docs: DataFrame, gone: DataFrame, once: DataFrame) -> DataFrame:
    """``docs`` without the rows named in ``gone``, and those named in ``once`` one time each; all columns stay.

    Rows are named by doc_id, which may be null, and ``tie``, the hash of their text; ``gone`` and ``once`` name a row
    once at most. Only rows that the bit map does not clear are shuffled.
    """
    names = [F.col(f"`{n}`") for n in docs.columns]
    marks = gone.select("doc_id", "tie", F.lit(False).alias("stays")).unionByName(once.select("doc_id", "tie", F.lit(True).alias("stays")))
    marks = marks.select(F.col("doc_id").alias("__id"), F.col("tie").alias("__other"), F.col("stays").alias("__stays"))
    hashes = marks.select(F.xxhash64("__id", "__other").alias("__hash"))
    own = docs.withColumn("__tie", F.xxhash64("`text`"))
    told = maybe_in(own, F.xxhash64(F.col("`doc_id`").cast("long"), "__tie"), hashes, marks.count())
    same = F.col("`doc_id`").cast("long").eqNullSafe(F.col("__id")) & (F.col("__tie") == F.col("__other"))
    seen = told.where("__in").join(marks, same, "left")
    single = seen.where("__stays").dropDuplicates(["__id", "__other"])
    return told.where(~F.col("__in")).select(*names).unionByName(seen.where("__stays is null").select(*names)).unionByName(single.select(*names))
