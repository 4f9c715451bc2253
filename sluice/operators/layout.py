"""How rows become files: sorted by key, a bounded number of rows each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

PART = "_part"
FILE = "_file"
_RANGE, _BEFORE, _RANGE_PART = "__range", "__before", "__range_part"
#: Rows of a partition that one task numbers; larger partitions are numbered by ranges.
TASK_ROWS = 2_000_000
#: A partition's files are written where it was numbered if all rows are at least this many times its rows on every core.
EVEN = 4
#: Bytes of a file that a task holds before it writes them.
FLUSH_BYTES = 16 << 20
LISTED = "partition_key string, key string, index int, num_rows bigint"
_PLAIN = (
    T.BooleanType,
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.StringType,
    T.BinaryType,
    T.DateType,
    T.TimestampType,
    T.TimestampNTZType,
    T.DecimalType,
)


def with_rank(df: DataFrame, keys: Sequence[str], out: str = "rank") -> DataFrame:
    """Add each row's place, from 1, in the key order of its partition."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(PART).orderBy(*keys)).cast("long"))


def with_file_index(df: DataFrame, keys: Sequence[str], file_rows: int) -> DataFrame:
    """Add ``_file``: files of exactly ``file_rows`` rows in key order, but for the last of a partition."""
    place = F.row_number().over(Window.partitionBy(PART).orderBy(*keys)).cast("long") - 1
    return df.withColumn(FILE, F.call_function("div", place, F.lit(file_rows).cast("long")))


def in_ranges(df: DataFrame, keys: Sequence[str], ranges: int, path: str) -> DataFrame:
    """``df`` with the number of its range of (_part, keys), written to ``path`` so that every reader sees the same."""
    dealt = df.repartitionByRange(ranges, PART, *[F.col(f"`{k}`") for k in keys]).withColumn(_RANGE, F.spark_partition_id())
    dealt.write.parquet(path)
    return df.sparkSession.read.schema(dealt.schema).parquet(path)


def with_file_index_by_ranges(ranged: DataFrame, keys: Sequence[str], file_rows: int) -> DataFrame:
    """What ``with_file_index`` adds, for rows of ``in_ranges``: a task numbers one range, and the ranges' counts, a row
    per partition and range, tell how many rows of the partition stand before it."""
    earlier = Window.partitionBy(PART).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(PART, _RANGE).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.col(PART).alias(_RANGE_PART), F.col(_RANGE).alias("__at"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(_BEFORE))
    inside = F.row_number().over(Window.partitionBy(PART, _RANGE).orderBy(*keys)).cast("long") - 1
    joined = ranged.withColumn("__inside", inside).join(before, (F.col(PART) == F.col(_RANGE_PART)) & (F.col(_RANGE) == F.col("__at")))
    place = F.col(_BEFORE) + F.col("__inside")
    return joined.withColumn(FILE, F.call_function("div", place, F.lit(file_rows).cast("long"))).drop(_RANGE, _RANGE_PART, "__at", _BEFORE, "__inside")


def numbered_files(df: DataFrame, keys: Sequence[str], file_rows: int, most: int = 0, total: int = 0, work: str | None = None) -> DataFrame:
    """``df`` (with ``_part``) with ``_file``; the rows of a file lie in one task, one after the other in key order.

    ``most`` is at least the number of rows of the largest partition, ``total`` that of all. If ``most`` is more than
    TASK_ROWS, rows are numbered by ranges, which wait in the folder ``work``; the files are the same. Where no
    partition is a large share of a task's rows, a partition's files stay in the task that numbered them, so the rows are
    shuffled once.
    """
    if most > TASK_ROWS and work is not None:
        ranges = max(2, -(-most // TASK_ROWS) * 2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        numbered = with_file_index_by_ranges(in_ranges(df, keys, ranges, work), keys, file_rows).select(*df.columns, FILE)
    else:
        numbered = with_file_index(df, keys, file_rows)
        if 0 < most * EVEN * df.sparkSession.sparkContext.defaultParallelism <= total:
            return numbered.sortWithinPartitions(PART, *keys)  # no work: so the window leaves them
    return numbered.repartition(PART, FILE).sortWithinPartitions(PART, FILE, *keys)


def write_files(numbered: DataFrame, path: str) -> None:
    """Write the rows of ``numbered_files`` as one sorted Parquet file for each (_part, _file), by Spark's writer."""
    numbered.write.partitionBy(PART, FILE).parquet(path)


def plain(schema: T.StructType) -> bool:
    """Whether all columns are of types that Arrow writes to Parquet as Spark does."""
    return all(type(f.dataType) in _PLAIN and (type(f.dataType) is not T.StringType or f.dataType == T.StringType()) for f in schema)


def write_local_files(numbered: DataFrame, path: str, local: str, listed: str) -> DataFrame:
    """The files of ``write_files`` where ``path`` is the folder ``local`` of a local file system, which all executors
    share: written by the tasks themselves.

    Hadoop without its native library starts a process (chmod) for every file, its checksum and its folder, which takes
    most of the time where files are small. Each attempt of a task writes to a folder of its own beside ``path``, with one
    folder for all files that it has of a partition, and only the files of attempts that Spark accepts are listed. The list, (partition_key, key, index, num_rows) with keys
    from the last folder of ``path`` on, is kept in the folder ``listed``.
    """
    name, version, part, file, flush = path.rpartition("/")[2], numbered.sparkSession.version, PART, FILE, FLUSH_BYTES

    def written(batches):
        import os
        import uuid

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        attempt = uuid.uuid4().hex[:12]
        now = writer = schema = None
        pieces, rows = [], 0

        def where(of):  # a folder for each partition, so that there is little to list
            return f"{part}={of[0]}/{file}=all", f"part-{of[1]}.snappy.parquet"

        def flush_pieces():
            nonlocal writer
            if writer is None:
                folder, own_name = where(now)
                os.makedirs(f"{local}-{attempt}/{folder}", exist_ok=True)
                writer = pq.ParquetWriter(f"{local}-{attempt}/{folder}/{own_name}", schema, compression="snappy")
            writer.write_table(pa.Table.from_batches(pieces, schema))
            pieces.clear()

        def closed():
            nonlocal writer
            flush_pieces()
            writer.close()
            writer = None
            key = "/".join([f"{name}-{attempt}", *where(now)])
            return pa.RecordBatch.from_pydict({"partition_key": [now[0]], "key": [key], "index": pa.array([now[1]], pa.int32()), "num_rows": pa.array([rows], pa.int64())})

        for batch in batches:
            if not batch.num_rows:
                continue
            parts, files = batch.column(part), batch.column(file)
            names = [n for n in batch.schema.names if n not in (part, file)]
            if schema is None:
                fields = [batch.schema.field(n).with_metadata({"PARQUET:field_id": str(i)}) for i, n in enumerate(names)]
                schema = pa.schema(fields, {"org.apache.spark.version": version})
            whole = pa.RecordBatch.from_arrays([batch.column(n) for n in names], schema=schema)
            other = pc.or_(pc.not_equal(parts[1:], parts[:-1]), pc.not_equal(files[1:], files[:-1])).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]
            for begin, end in zip(starts, starts[1:]):
                own = (parts[begin].as_py(), files[begin].as_py())
                if own != now:
                    if now is not None:
                        yield closed()
                    now, rows = own, 0
                pieces.append(whole.slice(begin, end - begin))
                rows += end - begin
                if sum(p.nbytes for p in pieces) > flush:
                    flush_pieces()
        if now is not None:
            yield closed()

    numbered.mapInArrow(written, LISTED).write.parquet(listed)
    return numbered.sparkSession.read.schema(LISTED).parquet(listed)


def with_field_ids(df: DataFrame) -> DataFrame:
    """Stamp Parquet field ids, by position, on all columns."""
    fields: list[Column] = [
        F.col(f"`{f.name}`").alias(f.name, metadata={**f.metadata, "parquet.field.id": i}) for i, f in enumerate(df.schema.fields)
    ]
    return df.select(*fields)


def file_counts(df: DataFrame) -> DataFrame:
    """Rows of each (_part, _file)."""
    return df.groupBy(PART, F.col(FILE).cast(T.IntegerType()).alias("index")).agg(F.count(F.lit(1)).alias("num_rows"))
