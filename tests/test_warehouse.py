from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from threading import Event

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import (
    CommitConflict,
    DuplicateKeys,
    EmptyBatch,
    ManifestError,
    ManifestNotFound,
    PartitionError,
    QueueError,
    SchemaMismatch,
    SubscriptionNotFound,
    TableError,
    TableExists,
    TableNotFound,
    UnprocessedKeys,
)
from sluice.functions.partitioning import IntegerRange, StringHash
from sluice.model import Subscription, SubscriptionGroup, TableDef, TableOptions
from sluice.operators import layout, staging
from sluice.sources import manifests, storage
from sluice.sources.storage import Store
from sluice.streaming import ingest, tasks
from sluice.streaming.tasks import Result, Tasker
from sluice.warehouse import Warehouse, widens

K, V = T.StructField("k", T.LongType()), T.StructField("v", T.StringType())


def table(name="t", transformer=None, sources=("a", "b"), **options):
    given = {"delay_seconds": 0, "file_rows": 2} | options
    group = SubscriptionGroup("g", tuple(Subscription(s, (K, V), transformer) for s in sources))
    return TableDef(name, (K, V)).with_partition("k", IntegerRange(10)).with_group(group).with_options(TableOptions(**given))


@pytest.fixture
def house(spark, tmp_path):
    return Warehouse(spark, f"file://{tmp_path}/house")


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def state(house, **where):
    return sorted((r.k, r.v) for r in house.read("t", **where).collect())


def test_stage_merge_read(spark, house):
    house.add_tables(table())
    house.ingest("t", "external.a", rows(spark, (1, "x"), (2, "y"), (3, "z"), (15, "w")))
    house.ingest("t", "external.a", rows(spark, (1, "x")))
    house.ingest("t", "external.b", rows(spark, (25, "q")))
    assert {(r.source, r["_part"]) for r in house.pending("t").collect()} == {("external.a", "0"), ("external.a", "1"), ("external.b", "2")}
    assert house.staged_batch("t", "external.a", "0", 2).count() == 2
    assert house.run_once() == [0, 1]
    assert house.run_once() == []
    assert state(house) == [(1, "x"), (2, "y"), (3, "z"), (15, "w"), (25, "q")]
    house.ingest("t", "external.b", rows(spark, (2, "Y"), (4, "new")))
    assert house.run_once() == [2]
    assert state(house, keys=["0"]) == [(1, "x"), (2, "Y"), (3, "z"), (4, "new")]
    assert state(house, keys=["0"], index=1) == [(3, "z"), (4, "new")]
    assert [house.manifest("t", p)["version"] for p in "012"] == [1, 0, 0]
    house.create_view("t", "seen")
    assert spark.sql("select count(*) from seen").first()[0] == 6
    assert house.vacuum("t") == 0
    with pytest.raises(ManifestNotFound):
        house.manifest("t", "99")
    with pytest.raises(EmptyBatch):
        house.staged_batch("t", "external.a", "0", 2)


def test_files_are_sorted_and_bounded(spark, house, tmp_path):
    house.add_tables(table())
    house.commit("t", {"external.a": rows(spark, *[(k, "v") for k in (7, 3, 5, 1, 9)])})
    objects = house.manifest("t", "0")["objects"]
    assert [(o["index"], o["num_rows"]) for o in objects] == [(0, 2), (1, 2), (2, 1)]
    files = [pq.read_table(f"{tmp_path}/house/tables/t/{o['key']}") for o in objects]
    assert [f.column("k").to_pylist() for f in files] == [[1, 3], [5, 7], [9]]
    assert [f.metadata[b"PARQUET:field_id"] for f in pq.read_schema(f"{tmp_path}/house/tables/t/{objects[0]['key']}")] == [b"0", b"1"]


def test_deletes_and_full_manifests(spark, house):
    house.add_tables(table())
    house.commit("t", {"external.a": rows(spark, (1, "x"), (11, "y"))})
    house.commit("t", {"external.a": rows(spark)}, processed=spark.createDataFrame([(1,)], "k long"))
    assert state(house) == [(11, "y")]
    assert house.manifest("t", "0")["objects"] == []
    for i in range(16):
        house.commit("t", {"external.a": rows(spark, (21, f"v{i}"))})
    assert state(house) == [(11, "y"), (21, "v15")]
    assert house.vacuum("t") > 10
    assert state(house) == [(11, "y"), (21, "v15")]


def test_replayed_and_conflicting_commits(spark, house):
    house.add_tables(table())
    assert house.commit("t", {"external.a": rows(spark, (1, "x"))}, batch_id="one") == 0
    assert house.commit("t", {"external.a": rows(spark, (1, "other"))}, batch_id="one") == 0
    assert house.commit("t", {"external.a": rows(spark, (2, "y"))}, batch_id="s#7") == 1
    assert house.commit("t", {"external.a": rows(spark, (2, "other"))}, batch_id="s#6") == 1
    assert state(house) == [(1, "x"), (2, "y")]
    with pytest.raises(CommitConflict):
        house.store.publish(f"{house.root}/tables/t/commits/{0:010d}.json", {})
    assert house.store.names(f"{house.root}/tables/t/commits") == [f"{n:010d}.json" for n in range(2)]


def test_a_failed_batch_keeps_its_rows(spark, house):
    house.add_tables(table())
    house.ingest("t", "external.a", rows(spark, (1, "x"), (1, "y")))
    run = house.run_once()
    assert run == [] and [(t, s, type(e)) for t, s, e in run.failures] == [("t", "external.a", DuplicateKeys)]
    assert house.staged("t", "external.a").count() == 2
    assert house.manifests("t").count() == 0


def test_one_failure_stops_no_other_source_or_table(spark, house):
    house.add_tables(table("bad"), table())
    house.ingest("bad", "external.a", rows(spark, (1, "x"), (1, "y")))
    house.ingest("bad", "external.b", rows(spark, (1, "z")))
    house.ingest("t", "external.a", rows(spark, (1, "x")))
    house.ingest("t", "external.b", rows(spark, (1, "newer")))
    run = house.run_once()
    assert [(t, s) for t, s, _ in run.failures] == [("bad", "external.a")]
    assert state(house) == [(1, "newer")] and house.read("bad").first().v == "z"
    assert house.staged("bad", "external.a").count() == 2 and house.staged("bad", "external.b") is None


@pytest.mark.parametrize("limit", [None, 1, 2, 3])
def test_the_latest_version_of_a_key_is_merged_last(spark, house, limit):
    house.add_tables(table(batch_rows=limit))
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    for i, (k, v) in enumerate([(1, "a"), (2, "a"), (1, "b"), (3, "a"), (1, "c"), (1, "a"), (2, "b")]):
        house.ingest("t", "external.a", rows(spark, (k, v)), arrived=start + timedelta(seconds=i))
    run = house.run_once()
    assert not run.failures and len(run) >= (3 if limit is None else 1)
    assert state(house) == [(1, "a"), (2, "b"), (3, "a")]
    assert house.staged("t", "external.a") is None


def test_each_partition_waits_for_itself(spark, house):
    house.add_tables(table(delay_seconds=10))
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    house.ingest("t", "external.a", rows(spark, (1, "x")), arrived=start)
    house.ingest("t", "external.a", rows(spark, (2, "y"), (15, "w")), arrived=start + timedelta(seconds=8))
    assert house.run_once(now=start + timedelta(seconds=12)) == [0]
    assert state(house) == [(1, "x"), (2, "y")]
    assert [(r.k, r["_arrived"].second) for r in house.staged("t", "external.a").collect()] == [(15, 8)]
    again = Warehouse(spark, house.root)
    again.add_tables(table(delay_seconds=10))
    assert again.run_once(now=start + timedelta(seconds=17)) == []
    assert again.run_once(now=start + timedelta(seconds=18)) == [1]
    assert state(house) == [(1, "x"), (2, "y"), (15, "w")] and again.staged("t", "external.a") is None
    assert house.vacuum("t") == 0 and state(house) == [(1, "x"), (2, "y"), (15, "w")]


def test_running_for_a_time(spark, house):
    house.add_tables(table())
    house.ingest("t", "external.a", rows(spark, (1, "x")))
    assert house.run(seconds=0.5) == [0]
    stop = Event()
    stop.set()
    house.ingest("t", "external.a", rows(spark, (2, "x")))
    assert house.run(stop=stop) == []


def test_a_faster_writer_is_merged_with(spark, house, monkeypatch):
    house.add_tables(table())
    house.commit("t", {"external.a": rows(spark, (1, "x"))})
    other = Warehouse(spark, house.root)
    other.add_tables(table())
    publish, raced = house.store.publish, []

    def slow(path, record):
        if not raced:
            raced.append(other.commit("t", {"external.b": rows(spark, (2, "theirs"))}))
        publish(path, record)

    monkeypatch.setattr(house.store, "publish", slow)
    assert house.commit("t", {"external.a": rows(spark, (3, "ours"))}) == 2 and raced == [1]
    assert state(house) == [(1, "x"), (2, "theirs"), (3, "ours")]


def test_large_partitions_are_numbered_by_ranges(spark, house, monkeypatch):
    pairs = [(k * 7 % 10, f"v{k}") for k in range(10)] + [(10 + k, "w") for k in range(5)]
    frame = rows(spark, *pairs).withColumn("_part", (F.col("k") / 10).cast("int").cast("string"))
    whole = {(r.k, r["_file"]) for r in layout.with_file_index(frame, ["k"], 3).collect()}
    ranged = layout.in_ranges(frame, ["k"], 4, f"{house.root}/ranges")
    assert ranged.select("__range").distinct().count() > 1
    assert {(r.k, r["_file"]) for r in layout.with_file_index_by_ranges(ranged, ["k"], 3).collect()} == whole
    monkeypatch.setattr(layout, "TASK_ROWS", 3)
    house.add_tables(table())
    house.commit("t", {"external.a": rows(spark, *pairs)})
    assert [o["num_rows"] for o in house.manifest("t", "0")["objects"]] == [2] * 5
    assert state(house) == sorted(pairs)


def test_processed_keys_must_name_the_batch(spark, house):
    house.add_tables(table())
    with pytest.raises(UnprocessedKeys):
        house.commit("t", {"external.a": rows(spark, (1, "x"), (2, "y"))}, processed=spark.createDataFrame([(1,)], "k long"))


def test_invalid_manifests_are_not_read(spark, house):
    house.add_tables(table())
    house.commit("t", {"external.a": rows(spark, *[(k, "v") for k in range(5)])})
    good = house.manifest("t", "0")
    bad = spark.createDataFrame([good | {"objects": good["objects"][1:]}], manifests.MANIFEST)
    folder = house._last("t")["manifests"]
    manifests.to_text(bad).write.mode("overwrite").text(f"{house.root}/tables/t/{folder}")
    with pytest.raises(ManifestError):
        house.read("t")


def test_narrower_types_are_widened(spark, house):
    house.add_tables(table())
    house.ingest("t", "external.a", rows(spark, (1, "x")).withColumn("k", F.col("k").cast("smallint")))
    house.run_once()
    assert state(house) == [(1, "x")]
    assert widens(T.FloatType(), T.DoubleType()) and not widens(T.LongType(), T.IntegerType()) and not widens(T.LongType(), T.DoubleType())


def test_files_of_the_driver(spark, house, tmp_path):
    (tmp_path / "own").write_text("text")
    house.store.put(str(tmp_path / "own"), f"{house.root}/far")
    house.store.fetch(f"{house.root}/far", str(tmp_path / "back"))
    assert (tmp_path / "back").read_text() == "text"


def test_work_folders_are_marked_for_removal(spark):
    path = storage.work_dir(spark, "marked")
    assert Store(spark).exists(path) and Store(spark).remove_at_exit(path)
    assert not Store(spark).remove_at_exit(path + "-none")


def test_unfinished_writes_are_not_seen(spark, house):
    house.add_tables(table())
    house.commit("t", {"external.a": rows(spark, (1, "x"))})
    home = f"{house.root}/tables/t"
    rows(spark, (1, "half")).write.parquet(f"{home}/data/1-dead/_part=0/_file=0")
    house.store.write_text(f"{house.root}/staging/t/external.a/dead/part-0.parquet", "")
    assert house.staged("t", "external.a") is None
    assert state(house) == [(1, "x")]
    house.commit("t", {"external.a": rows(spark, (2, "y"))})
    assert state(house) == [(1, "x"), (2, "y")]


def test_delay_and_rounds(spark, house):
    house.add_tables(table(delay_seconds=10, batch_rows=2))
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    house.ingest("t", "external.a", rows(spark, *[(k, "v") for k in range(5)]), arrived=start)
    house.ingest("t", "external.a", rows(spark, (9, "late")), arrived=start + timedelta(seconds=9))
    assert house.run_once(now=start + timedelta(seconds=5)) == []
    assert house.run_once(now=start + timedelta(seconds=10)) == [0, 1, 2]
    assert len(state(house)) == 6


def test_transformers(spark, house):
    house.add_tables(table(transformer=lambda df: df.withColumn("v", F.upper("v")).withColumn("extra", F.lit(1))))
    house.commit("t", {"external.a": rows(spark, (1, "x"))})
    assert house.read("t").first().asDict() == {"k": 1, "v": "X", "extra": 1}
    other = Warehouse(spark, house.root + "2")
    other.add_tables(table(transformer=lambda df: df.select("k")))
    with pytest.raises(SchemaMismatch):
        other.commit("t", {"external.a": rows(spark, (1, "x"))})


def test_audit(spark, house):
    house.add_tables(table().with_audit())
    house.commit("t", {"external.a": rows(spark, (1, "x"), (2, "y"), (3, "z"))})
    house.commit("t", {"external.a": rows(spark, (1, "x"), (2, "Y"))})
    got = {r.k: (r["_processed_count"], r["_updated_count"], r["_processed_ts"] > r["_updated_ts"]) for r in house.read("t").collect()}
    assert got == {1: (2, 1, True), 2: (2, 2, False), 3: (1, 1, False)}


def test_definitions_are_checked(spark, house):
    good = table()
    for bad in (
        TableDef(""),
        TableDef("t"),
        TableDef("t", (K, K)).with_partition("k", IntegerRange(5)),
        TableDef("t", (K, V)),
        TableDef("t", (K, V)).with_partition("x", IntegerRange(5)),
        TableDef("t", (K, V)).with_partition("k", IntegerRange(5)).with_partition("k", IntegerRange(5)),
        good.with_group(SubscriptionGroup("")),
        good.with_group(SubscriptionGroup("empty")),
        good.with_group(SubscriptionGroup("g", (Subscription("", (K,)),))),
        good.with_group(SubscriptionGroup("g", (Subscription("c", ()),))),
        good.with_group(SubscriptionGroup("g", (Subscription("c", (V,)),))),
        good.with_group(SubscriptionGroup("g", (Subscription("a", (K,)),))),
        good.with_group(SubscriptionGroup("g", (Subscription("c", (T.StructField("k", T.IntegerType()),)),))),
        good.with_options(TableOptions(file_rows=0)),
    ):
        with pytest.raises(TableError):
            bad.validate()
    with pytest.raises(PartitionError):
        TableDef("t", (K, V)).with_partition("v", StringHash(0)).validate()
    with pytest.raises(TableError):
        house.add_tables(good, TableDef("u"))
    assert not house.has_table("t")
    house.add_tables(good)
    assert house.tables() == [good]
    with pytest.raises(TableExists):
        house.add_tables(good)
    with pytest.raises(TableNotFound):
        house.table("u")
    with pytest.raises(SubscriptionNotFound):
        house.ingest("t", "external.none", rows(spark, (1, "x")))
    for wrong in (rows(spark, (1, "x")).select("k"), rows(spark, (1, "x")).withColumn("k", F.col("k").cast("double")), rows(spark, (1, "x")).toDF("k", "k")):
        with pytest.raises(SchemaMismatch):
            house.ingest("t", "external.a", wrong)
    house.ingest("t", "external.a", rows(spark, (1, "x")).select("v", "k"))
    assert house.staged("t", "external.a").columns[:2] == ["k", "v"]


def test_manifest_validation(spark):
    good = {"id": "3", "table_name": "t", "partition_key": "1", "version": 3, "objects": [{"key": "b", "index": 1, "num_rows": 5}, {"key": "a", "index": 0, "num_rows": 5}]}
    parse = lambda m: manifests.parse(manifests.to_text(spark.createDataFrame([m], manifests.MANIFEST)))
    assert [o["index"] for o in manifests.require_valid(parse(good)).first().objects] == [0, 1]
    for change in ({"id": "4"}, {"table_name": ""}, {"version": -1, "id": "-1"}, {"objects": good["objects"][:1]}, {"partition_key": None}):
        with pytest.raises(ManifestError):
            manifests.require_valid(parse(good | change))


def test_newest_name(spark):
    names = spark.createDataFrame([("23", f"p/manifest_{v}.json") for v in ("1", "3", "2", "abc")], "partition_key string, name string")
    assert manifests.latest_names(names).first().name == "p/manifest_3.json"


def test_newly_added(spark):
    assert staging.newly_added(rows(spark, (1, "x")), rows(spark, (1, "x"), (2, "y"), (2, "y"))).count() == 1


def test_stream_and_replay(spark, house, tmp_path):
    house.add_tables(table())
    rows(spark, (1, "x"), (2, "y"), (2, "y")).coalesce(1).write.parquet(f"{tmp_path}/in")

    def run(checkpoint):
        stream = spark.readStream.schema(T.StructType([K, V])).parquet(f"{tmp_path}/in")
        ingest.start(house, "t", "external.a", stream, f"{tmp_path}/{checkpoint}", {"availableNow": True}).awaitTermination()

    run("one")
    rows(spark, (2, "Y"), (30, "z")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run("one")
    run("one")
    assert state(house) == [(1, "x"), (2, "Y"), (30, "z")]


@dataclass(frozen=True)
class Note:
    n: int


def test_tasks_outlive_their_tasker(house):
    now, seen = [100.0], []
    where = {"clock": lambda: now[0], "store": house.store, "path": f"{house.root}/tasks.json"}
    first = Tasker(**where)
    first.register_queue("slow")
    first.register_task("note", seen.append, Note)
    assert first.add("slow", "note", "x", Note(7), delay=10) and first.add("slow", "note", "y", {"n": 8}, delay=20)
    second = Tasker(**where)
    second.register_queue("slow")
    second.register_task("note", seen.append, Note)
    assert not second.run_next() and not second.add("slow", "note", "x", Note(9))
    now[0] += 15
    assert second.run_next() and seen == [Note(7)]
    assert Tasker(**where).length("slow") == 1


def test_the_loop_goes_on_after_a_failure():
    tasker, seen = Tasker(retry_seconds=100), []
    tasker.register_queue("q")
    tasker.register_task("note", lambda p: seen.append(p["n"]))
    tasker.register_task("fails", lambda p: p["none"])
    tasker.add("q", "fails", "a", {})
    tasker.add("q", "note", "b", {"n": 1})
    assert tasker.run(seconds=0.2) == 1 and seen == [1]
    assert [(i, type(e)) for i, e in tasker.failures] == [("a", KeyError)] and tasker.length("q") == 1


def test_merges_as_tasks(spark, house):
    house.add_tables(table())
    tasker = Tasker()
    ask = tasks.schedule_merges(house, tasker)
    house.ingest("t", "external.a", rows(spark, (1, "x")))
    assert ask("t", "external.a") and not ask("t", "external.a")
    assert tasker.run_next() and not tasker.run_next()
    assert state(house) == [(1, "x")] and tasker.length("merges") == 0


def test_tasks():
    now = [100.0]
    seen = []
    tasker = Tasker(clock=lambda: now[0])
    tasker.register_queue("slow")
    tasker.register_queue("fast", delayed=False)
    tasker.register_task("note", lambda p: seen.append(p["n"]))
    tasker.register_task("again", lambda p: Result(requeue=not seen.append("again") and seen.count("again") < 2))
    assert tasker.add("slow", "note", "x", {"n": 1}, delay=10)
    assert not tasker.add("slow", "note", "x", {"n": 2}, delay=1)
    assert tasker.add("fast", "again", "y", {})
    assert tasker.length("slow") == 1
    while tasker.run_next():
        pass
    assert seen == ["again", "again"]
    now[0] += 5
    assert tasker.add("slow", "note", "x", {"n": 3}, delay=0, replace=True)
    assert tasker.run_next()
    assert not tasker.run_next()
    assert seen[-1] == 3
    for bad in (("none", "note", 0), ("slow", "none", 0), ("fast", "note", 5)):
        with pytest.raises(QueueError):
            tasker.add(bad[0], bad[1], "z", {}, delay=bad[2])

    def fails(_):
        raise ValueError

    tasker.register_task("fails", fails)
    tasker.add("slow", "fails", "f", {})
    with pytest.raises(ValueError):
        tasker.run_next()
    assert tasker.length("slow") == 1


def test_files_are_written_by_the_tasks(spark, tmp_path, monkeypatch):
    """No process is started for a file and its checksum; rows and manifests are those of Spark's writer."""
    types = {"k": "long", "s": "string", "d": "date", "t": "timestamp", "u": "timestamp_ntz", "n": "decimal(20,2)", "b": "binary", "f": "float", "h": "smallint", "y": "boolean"}
    frame = spark.range(35).select(F.when(F.col("id") % 5 != 0, F.col("id")).alias("x"), F.col("id").alias("k"))
    casts = {"d": "date_add(date'1500-03-01', int(x))", "t": "timestamp_seconds(x * -3e8)", "u": "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, int(x))", "b": "encode(string(x), 'UTF-8')", "y": "x % 2 = 0"}
    frame = frame.selectExpr("k", *[f"cast({casts.get(n, 'x')} as {t}) as {n}" for n, t in types.items() if n != "k"])
    columns = tuple(frame.schema.fields)
    monkeypatch.setattr(layout, "FLUSH_BYTES", 1)
    batch_rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = {}
    for way in ("tasks", "spark"):
        if way == "spark":
            monkeypatch.setattr("sluice.warehouse.local_path", lambda spark, path: None)
        house = Warehouse(spark, f"file://{tmp_path}/{way}")
        group = SubscriptionGroup("g", (Subscription("a", columns),))
        house.add_tables(TableDef("t", columns).with_partition("k", IntegerRange(10)).with_group(group).with_options(TableOptions(file_rows=4)))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        try:
            house.commit("t", {"external.a": frame})
            house.commit("t", {"external.a": frame.where("k between 8 and 11").withColumn("h", F.lit(1).cast("smallint"))})
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
        named = [[(o["index"], o["num_rows"], o["key"]) for o in house.manifest("t", p)["objects"]] for p in "0123"]
        keys = [[pq.read_table(f"{tmp_path}/{way}/tables/t/{key}").column("k").to_pylist() for *_, key in part] for part in named]
        assert all((tmp_path / way / "tables/t" / part[0][2]).parent.joinpath(f".{part[0][2].rpartition('/')[2]}.crc").exists() == (way == "spark") for part in named)
        found[way] = sorted(map(repr, house.read("t").collect())), sorted(map(repr, house.read("t", index=1).collect())), [[f[:2] for f in part] for part in named], keys
    assert found["tasks"] == found["spark"]
    assert len(found["tasks"][0]) == 35 and found["tasks"][2][0] == [(0, 4), (1, 4), (2, 2)]


def test_even_partitions_are_shuffled_once(spark):
    frame = spark.range(1000).selectExpr("id as k", "string(id div 10) as _part")
    plans = [layout.numbered_files(frame, ["k"], 4, 10, total)._jdf.queryExecution().executedPlan().toString() for total in (100, 1000)]
    assert [p.count("Exchange hashpartitioning") for p in plans] == [2, 1]
    assert plans[1].count("Sort [") == 1


def test_folders_are_listed_by_few_tasks(spark, house, monkeypatch):
    name, seen, real = "spark.sql.sources.parallelPartitionDiscovery.parallelism", [], type(spark.read).parquet
    house.add_tables(table())
    house.commit("t", {"external.a": rows(spark, (1, "x"), (11, "y"))})
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *paths: (seen.append(int(spark.conf.get(name))), real(self, *paths))[1])
    before = spark.conf.get(name)
    assert state(house) == [(1, "x"), (11, "y")]
    assert seen == [4 * spark.sparkContext.defaultParallelism] and spark.conf.get(name) == before == "10000"
