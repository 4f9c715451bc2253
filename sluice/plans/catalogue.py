"""Registered queries of the warehouse's own operators: each runs over the whole of its tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import naming
from ..functions.partitioning import IntegerRange, StringHash, fnv1, interval, partition_key
from ..model import Subscription, SubscriptionGroup, TableDef, TableOptions
from ..operators import layout, merge, staging, validate
from ..operators.layout import PART
from ..sources import manifests
from ..sources.storage import Store, work_dir
from ..streaming import ingest
from ..warehouse import Warehouse

Query = Callable[[SparkSession, str], DataFrame]

#: How far the merge fixtures move a key that is to be new.
NEW_KEYS = 10_000_000
KEYS = ["o_orderkey"]
ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(*ORDER_COLUMNS)


def merge_inputs(orders: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base, new rows and processed keys, made of every order.

    By status and priority: P is processed but not in the batch (deleted), and comes again under a new key (inserted);
    F comes with another price (updated); O comes as it is (unchanged), but for 5-LOW, which doesn't come (untouched).
    """
    status, low = F.col("o_orderstatus"), F.col("o_orderpriority") == "5-LOW"
    new = orders.where((status != "O") | ~low).select(
        F.when(status == "P", F.col("o_orderkey") + NEW_KEYS).otherwise(F.col("o_orderkey")).alias("o_orderkey"),
        "o_custkey",
        "o_orderstatus",
        F.when(status == "F", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderpriority",
    )
    processed = new.select(*KEYS).unionByName(orders.where(status == "P").select(*KEYS))
    return orders, new, processed


def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders")
    return rows.select("o_orderkey", F.col("o_custkey").cast("int").alias("o_custkey"), F.col("o_totalprice").cast("float").cast("double").alias("price"))


EVENT_COLUMNS = (
    T.StructField("event_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
)


def _events_table(name: str, options: TableOptions | None = None, transformer=None, sources: tuple[str, ...] = ("events",)) -> TableDef:
    return (
        TableDef(name, columns=EVENT_COLUMNS)
        .with_partition("event_id", IntegerRange(2_000))
        .with_group(SubscriptionGroup("all", tuple(Subscription(s, EVENT_COLUMNS, transformer) for s in sources)))
        .with_options(options or TableOptions(delay_seconds=0))
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(*[c.name for c in EVENT_COLUMNS])


def _merged(house: Warehouse, table: str) -> DataFrame:
    """A table after all that is staged was merged."""
    for _, _, error in house.run_once().failures:
        raise error
    return house.read(table)


def insert_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    house = Warehouse(spark, work_dir(spark, "roundtrip"))
    house.add_tables(_events_table("events"))
    house.ingest("events", "external.events", _events(spark, sf_dir))
    return house.staged("events", "external.events").drop("_arrived")


def part_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", IntegerRange(1000).bucket(F.col("o_orderkey")).alias("bucket"))


def part_int_neg(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal").cast("long")
    return _read(spark, sf_dir, "customer").select("c_custkey", IntegerRange(100).bucket(balance).alias("bucket"))


def part_fnv(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = fnv1(F.col("c_name"))
    return _read(spark, sf_dir, "customer").select("c_custkey", h.alias("hash"), interval(h, 10).alias("bucket"))


def part_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer")
    key = partition_key(rows, [("c_custkey", IntegerRange(100)), ("c_name", StringHash(10))])
    return rows.select("c_custkey", key.alias(PART))


def _parted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events")
    return rows.withColumn(PART, partition_key(rows, [("user_id", IntegerRange(10))]))


def batch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.group_sizes(_parted_events(spark, sf_dir))


def set_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    return staging.distinct_rows(rows, rows, rows.withColumn("value", F.lit(0.0)))


def pending_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.pending(_parted_events(spark, sf_dir).withColumnRenamed("event_type", "source"))


def batch_take_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.take_rows(_parted_events(spark, sf_dir), ["event_id"], 5).select("event_id", PART)


def ready_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parted_events(spark, sf_dir)
    found = staging.ready(rows, "ts", F.to_timestamp_ntz(F.lit("2024-01-01 06:00:00")), 10)
    return found.select(PART, F.unix_micros(F.col("first_seen").cast("timestamp")).alias("first_micros"))


def processed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.distinct_keys(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    return layout.with_rank(rows.withColumn(PART, partition_key(rows, [("o_orderkey", IntegerRange(1000))])), KEYS).select("o_orderkey", PART, "rank")


def validate_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.duplicate_keys(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def validate_unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, new, _ = merge_inputs(_orders(spark, sf_dir))
    return validate.unprocessed_keys(new, base, KEYS).select("o_orderkey")


def merge_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, new, gone = merge_inputs(_orders(spark, sf_dir))
    found = merge.classify(base, new, KEYS, ORDER_COLUMNS, gone)
    return found.select(F.coalesce("s.o_orderkey", "b.o_orderkey").alias("o_orderkey"), merge.ACTION)


def merge_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, new, gone = merge_inputs(_orders(spark, sf_dir))
    return merge.merge(base, new, KEYS, ORDER_COLUMNS, gone)


def merge_insert_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, new, _ = merge_inputs(_orders(spark, sf_dir))
    return merge.merge(spark.createDataFrame([], new.schema), new, KEYS, ORDER_COLUMNS)


def merge_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, new, gone = merge_inputs(_orders(spark, sf_dir))
    found = merge.classify(base, new, KEYS, ORDER_COLUMNS, gone).where(F.col(merge.ACTION) == "deleted")
    return found.select("b.*")


def merge_multi_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, new, gone = merge_inputs(_orders(spark, sf_dir))
    once = merge.merge(spark.createDataFrame([], base.schema), base, KEYS, ORDER_COLUMNS)
    twice = merge.merge(once, new, KEYS, ORDER_COLUMNS, gone)
    return merge.merge(twice, base, KEYS, ORDER_COLUMNS)


def merge_keep_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, new, _ = merge_inputs(_orders(spark, sf_dir))
    base, new = base.withColumn("note", F.lit("old")), new.withColumn("note", F.lit("new"))
    return merge.merge(base, new, KEYS, ORDER_COLUMNS).select("o_orderkey", "o_totalprice", "note")


def pack_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem")
    parted = rows.withColumn(PART, partition_key(rows, [("l_orderkey", IntegerRange(1000))]))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return layout.file_counts(layout.with_file_index(parted, keys, 1000))


def pack_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of partitions that are too large for one task, numbered by ranges."""
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parted = rows.withColumn(PART, partition_key(rows, [("l_orderkey", IntegerRange(100_000))]))
    ranged = layout.in_ranges(parted, rows.columns, 16, f"{work_dir(spark, 'ranges')}/rows")
    return layout.file_counts(layout.with_file_index_by_ranges(ranged, rows.columns, 1000))


def _manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    parted = rows.withColumn(PART, partition_key(rows, [("o_orderkey", IntegerRange(5000))]))
    counts = layout.file_counts(layout.with_file_index(parted, KEYS, 1000)).withColumnRenamed(PART, "partition_key")
    named = counts.withColumn("key", naming.data_key("orders", F.col("partition_key"), "1", F.col("index")))
    return manifests.build(named, F.lit("orders"), F.lit(1))


def manifest_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _manifest_rows(spark, sf_dir)
    return found.select("id", "partition_key", "version", F.explode("objects").alias("o")).select("id", "partition_key", "version", "o.key", "o.index", "o.num_rows")


def manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = manifests.parse(manifests.to_text(_manifest_rows(spark, sf_dir)))
    return parsed.select("table_name", "partition_key", F.size("objects").alias("files"), manifests.is_valid(F.struct(*parsed.columns)).alias("valid"))


def manifest_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_type") == "click", F.lit("manifest_abc.json")).otherwise(F.format_string("manifest_%d.json", F.col("event_id")))
    rows = _parted_events(spark, sf_dir).select(F.col(PART).alias("partition_key"), name.alias("name"))
    return manifests.latest_names(rows)


def key_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = naming.buffer_key("events", F.col("event_type"), F.col(PART))
    rows = _parted_events(spark, sf_dir).select("event_id", path.alias("path"))
    return rows.select("event_id", naming.key_source(F.col("path")).alias("source"), naming.key_partition(F.col("path")).alias("part"))


def packet_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    return rows.select("event_id", "p.k", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("p.k").alias("k"))).alias("packet"))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.unix_millis(F.col("ts").cast("timestamp"))
    return _parted_events(spark, sf_dir).select(
        F.col("event_type").alias("queue"), naming.task_id("events", F.col("event_type"), F.col(PART)).alias("task_id"), asked.alias("asked"), (asked + 10_000).alias("due")
    )


def queue_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _tasks(spark, sf_dir)
    last = staging.first_wins(tasks, replace=True).withColumnRenamed("due", "replaced_due")
    return staging.first_wins(tasks).join(last, ["queue", "task_id"])


def queue_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.due_tasks(staging.first_wins(_tasks(spark, sf_dir)), F.lit(1_704_100_000_000))


def queue_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.queue_lengths(staging.first_wins(_tasks(spark, sf_dir)))


def multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    house = Warehouse(spark, work_dir(spark, "multi"))
    house.add_tables(_events_table("events", sources=("low", "high")))
    rows = _events(spark, sf_dir)
    house.ingest("events", "external.low", rows)
    house.ingest("events", "external.high", rows.withColumn("event_id", F.col("event_id") + NEW_KEYS))
    return _merged(house, "events")


LENGTH_FIELDS = (
    T.StructField("doc_id", T.LongType()),
    T.StructField("chars", T.LongType()),
    T.StructField("arrow_chars", T.LongType()),
)


def with_lengths(docs: DataFrame) -> DataFrame:
    """A source's transformer: lengths of texts by the JVM and over Arrow batches."""

    def lengths(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("chars"), pa.array([len(t or "") for t in texts], pa.int64())], ["doc_id", "chars", "arrow_chars"]
            )

    native = docs.withColumn("chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long"))
    return native.mapInArrow(lengths, T.StructType(list(LENGTH_FIELDS)))


def round_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as staged rows, each with the batch that would merge it."""
    staged = _parted_events(spark, sf_dir).select("event_id", "user_id", PART, F.timestamp_seconds("event_id").alias("arrived"))
    return staging.rounds(staged, "arrived", ["user_id"], 50, "turn", "wave").select("event_id", "turn", "wave")


def newly_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    return staging.newly_added(rows.where("event_type <> 'click'"), rows.unionByName(rows))


def run_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events staged three times, some with other values: run_once merges the versions in the order they arrived."""
    house = Warehouse(spark, work_dir(spark, "versions"))
    house.add_tables(_events_table("events"))
    rows = _events(spark, sf_dir)
    for i in range(3):
        batch = rows.where(F.col("event_id") % (i + 1) == 0).withColumn("value", F.col("value") + F.lit(float(i)))
        house.ingest("events", "external.events", batch, arrived=datetime(2024, 1, 1, 0, 0, i, tzinfo=timezone.utc))
    return _merged(house, "events")


def widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders from a source with narrower numbers than the table's."""
    house = Warehouse(spark, work_dir(spark, "widened"))
    house.add_tables(orders_table())
    narrow = _orders(spark, sf_dir).withColumn("o_custkey", F.col("o_custkey").cast("int")).withColumn("o_totalprice", F.col("o_totalprice").cast("float"))
    house.ingest("orders", "external.orders", narrow)
    return _merged(house, "orders")


def store_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions (a table of fixed size) as one file each: written, listed, one removed, and read again."""
    folder, store = work_dir(spark, "files"), Store(spark)
    rows = _read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long"), "r_name")
    for key, name in rows.collect():
        store.write_text(f"{folder}/{name}.json", json.dumps([key, name]))
    store.remove(f"{folder}/ASIA.json")
    return spark.createDataFrame([tuple(json.loads(store.read_text(f"{folder}/{n}"))) for n in store.names(folder)], rows.schema)


def read_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second file of every partition."""
    return merged_orders(spark, sf_dir).read("orders", index=1)


def transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents merged into a table of their lengths, by way of the source's transformer."""
    texts = (T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()))
    table = (
        TableDef("lengths", columns=LENGTH_FIELDS)
        .with_partition("doc_id", IntegerRange(10_000))
        .with_group(SubscriptionGroup("all", (Subscription("documents", texts, with_lengths),)))
        .with_options(TableOptions(delay_seconds=0, file_rows=100_000))
    )
    house = Warehouse(spark, work_dir(spark, "lengths"))
    house.add_tables(table)
    house.ingest("lengths", "external.documents", _read(spark, sf_dir, "documents").select("doc_id", "text"))
    return _merged(house, "lengths")


ORDER_FIELDS = (
    T.StructField("o_orderkey", T.LongType()),
    T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()),
    T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderpriority", T.StringType()),
)


def orders_table(audit: bool = False) -> TableDef:
    table = (
        TableDef("orders", columns=ORDER_FIELDS)
        .with_partition("o_orderkey", IntegerRange(5_000))
        .with_group(SubscriptionGroup("all", (Subscription("orders", ORDER_FIELDS),)))
        .with_options(TableOptions(delay_seconds=0, file_rows=1_000))
    )
    return table.with_audit() if audit else table


def merged_orders(spark: SparkSession, sf_dir: str, audit: bool = False) -> Warehouse:
    """A warehouse whose table orders had two commits: all orders, then the merge fixture's batch."""
    house = Warehouse(spark, work_dir(spark, "orders"))
    house.add_tables(orders_table(audit))
    base, new, gone = merge_inputs(_orders(spark, sf_dir))
    house.commit("orders", {"external.orders": base})
    house.commit("orders", {"external.orders": new}, processed=gone)
    return house


def snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_orders(spark, sf_dir).read("orders")


def snapshot_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    house = merged_orders(spark, sf_dir)
    house.create_view("orders", "orders_snapshot")
    return spark.sql("select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders_snapshot group by o_orderstatus")


def late_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each event a second version: purchases were produced before the stored row and are late, the others after."""
    base = _read(spark, sf_dir, "events").select("event_id", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("_produced_ts"))
    shift = F.when(F.col("event_type") == "purchase", -1).otherwise(1)
    new = _read(spark, sf_dir, "events").select(
        "event_id", (F.col("value") + 1).alias("value"), (F.unix_millis(F.col("ts").cast("timestamp")) + shift).alias("_produced_ts")
    )
    return merge.merge(base, new, ["event_id"], ["value", "_produced_ts"], merge_filter=merge.newer())


def audit_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_orders(spark, sf_dir, audit=True).read("orders").select("o_orderkey", "_processed_count", "_updated_count")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events by a stream of files, one micro-batch each trigger, then the snapshot."""
    root = work_dir(spark, "stream")
    house = Warehouse(spark, f"{root}/house")
    house.add_tables(_events_table("events"))
    rows = _events(spark, sf_dir)
    rows.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(T.StructType(list(EVENT_COLUMNS))).parquet(f"{root}/in")
    query = ingest.start(house, "events", "external.events", stream, f"{root}/checkpoint", {"availableNow": True})
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return house.read("events")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and files of each partition of the merged orders, read through their manifests."""
    house = merged_orders(spark, sf_dir)
    found = house.manifests("orders")
    rows = F.aggregate("objects", F.lit(0).cast("long"), lambda s, o: s + o["num_rows"])
    return found.select("partition_key", "version", F.size("objects").alias("files"), rows.alias("rows"))


QUERIES: dict[str, Query] = {
    f"q_{f.__name__}": f
    for f in (
        scan_project,
        insert_roundtrip,
        part_int,
        part_int_neg,
        part_fnv,
        part_composite,
        batch_groups,
        set_distinct,
        pending_partitions,
        batch_take_n,
        ready_partitions,
        processed_keys,
        sort_rank,
        validate_dups,
        validate_unprocessed,
        merge_classify,
        merge_result,
        merge_insert_only,
        merge_delete,
        merge_multi_batch,
        merge_keep_old,
        pack_files,
        pack_ranges,
        manifest_build,
        manifest_json,
        manifest_latest,
        key_parse,
        packet_json,
        queue_first_wins,
        queue_due,
        queue_length,
        round_batches,
        newly_added,
        run_versions,
        widened,
        store_files,
        read_index,
        multi_source,
        transform,
        snapshot_read,
        snapshot_sql,
        late_filter,
        audit_cols,
        stream_ingest,
        flagship,
    )
}
