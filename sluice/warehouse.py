"""The warehouse: registered tables under one root folder, staged batches in, merged snapshots out.

    {root}/staging/{table}/{source}/{batch}                    rows that wait, with _part and _arrived
    {root}/tables/{table}/data/_commit={c}/_part=/_file=       sorted files; on a local disk _commit is of one task and
                                                               _file=all holds all that the task has of a partition
    {root}/tables/{table}/manifests/{commit}                   JSON manifests of the partitions that the commit touched
    {root}/tables/{table}/commits/{commit}.json                what makes a commit: it appears whole, or not at all

A commit reads and writes only the partitions that its rows touch. Every FULL_EVERY commits the manifests of all
partitions are written anew, so a reader opens a bounded number of folders. A commit's record carries on what of the
staging is done with and how far each stream has come, so the last record tells it all and no older one is read for
that. Nothing is overwritten; ``vacuum`` removes what no current manifest names.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from threading import Event
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import CommitConflict, EmptyBatch, ManifestError, ManifestNotFound, SchemaMismatch, TableExists, TableNotFound
from .functions.partitioning import partition_key
from .model import Subscription, TableDef
from .operators import layout, merge, staging, validate
from .operators.layout import FILE, PART
from .sources import manifests
from .sources.storage import Storage, Store, local_path

FULL_EVERY = 16
#: How often a commit is tried anew when another writer was faster.
ATTEMPTS = 5
#: Tasks on every core, at most, that list the folders of a table.
LISTING_TASKS = 4
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_ARRIVED = "_arrived"
_ROUND, _WAVE = "_round", "_wave"

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)


class Run(list[int]):
    """The numbers of the commits made; ``failures`` has (table, source, error) of the sources that could not be merged."""

    def __init__(self) -> None:
        super().__init__()
        self.failures: list[tuple[str, str, Exception]] = []


def widens(given: T.DataType, wanted: T.DataType) -> bool:
    """Whether each value of a type is one of the other, so that a cast loses nothing."""
    for kinds in (_INTEGERS, _FLOATS):
        if type(given) in kinds and type(wanted) in kinds:
            return kinds.index(type(given)) <= kinds.index(type(wanted))
    return given == wanted


class Warehouse:
    def __init__(self, spark: SparkSession, root: str, store: Storage | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.store: Storage = store or Store(spark)
        self._tables: dict[str, TableDef] = {}

    # -- registry

    def add_tables(self, *tables: TableDef) -> None:
        """Register all tables, or none if one is not valid."""
        names = [t.name for t in tables]
        for t in tables:
            t.validate()
            if t.name in self._tables or names.count(t.name) > 1:
                raise TableExists(t.name)
        self._tables.update({t.name: t for t in tables})

    def table(self, name: str) -> TableDef:
        if name not in self._tables:
            raise TableNotFound(name)
        return self._tables[name]

    def has_table(self, name: str) -> bool:
        return name in self._tables

    def tables(self) -> list[TableDef]:
        return list(self._tables.values())

    # -- staging

    def ingest(self, table: str, source: str, batch: DataFrame, arrived: datetime | None = None) -> None:
        """Stage a batch: all its rows appear at once. Columns are matched by name and must have the declared types, or
        narrower ones, which are widened."""
        definition = self.table(table)
        rows = self._checked(definition, source, batch)
        when = F.lit(arrived) if arrived else F.current_timestamp()
        rows = rows.withColumn(PART, partition_key(rows, definition.partitions)).withColumn(_ARRIVED, when.cast("timestamp"))
        rows.write.parquet(f"{self._staging(table, source)}/{uuid.uuid4().hex}")

    def _staging(self, table: str, source: str) -> str:
        return f"{self.root}/staging/{table}/{source}"

    def _checked(self, definition: TableDef, source: str, batch: DataFrame) -> DataFrame:
        wanted = definition.subscription(source).schema
        given = {f.name: f.dataType for f in batch.schema}
        fits = len(batch.columns) == len(given) == len(wanted) and all(f.name in given and widens(given[f.name], f.dataType) for f in wanted)
        if not fits:
            raise SchemaMismatch(f"{source}: {batch.schema.simpleString()} is not {wanted.simpleString()}")
        return batch.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted])

    def _staged_folders(self, table: str, source: str) -> list[str]:
        """Names of the folders whose rows wait: whole ones that no commit consumed, and what a commit carried over."""
        folder, last = self._staging(table, source), self._last(table)
        done, carried = set(last["consumed"]), set(last["carried"])
        return [
            n
            for n in self.store.names(folder)
            if f"{source}/{n}" not in done
            and (not n.startswith("carried-") or f"{source}/{n}" in carried)
            and self.store.exists(f"{folder}/{n}/_SUCCESS")
        ]

    def _staged(self, definition: TableDef, subscription: Subscription, folders: list[str]) -> DataFrame:
        schema = T.StructType([*subscription.columns, T.StructField(PART, T.StringType()), T.StructField(_ARRIVED, T.TimestampType())])
        home = self._staging(definition.name, subscription.source_name)
        return self.spark.read.schema(schema).parquet(*[f"{home}/{n}" for n in folders])

    def staged(self, table: str, source: str) -> DataFrame | None:
        """The rows of a source that wait, with _part and _arrived; None if there are none."""
        definition = self.table(table)
        folders = self._staged_folders(table, source)
        return self._staged(definition, definition.subscription(source), folders) if folders else None

    def pending(self, table: str) -> DataFrame:
        """(source, _part) pairs with rows that wait."""
        found = self.spark.createDataFrame([], f"source string, {PART} string")
        for s in self.table(table).subscriptions():
            if (rows := self.staged(table, s.source_name)) is not None:
                found = found.unionByName(staging.pending(rows.withColumn("source", F.lit(s.source_name))))
        return found

    def staged_batch(self, table: str, source: str, key: str, rows: int) -> DataFrame:
        """At most ``rows`` waiting rows of a partition, oldest first; EmptyBatch if there are none."""
        waiting = self.staged(table, source)
        own = None if waiting is None else waiting.where(F.col(PART) == key)
        if own is None or own.isEmpty():
            raise EmptyBatch(f"{table}/{source}/{key}")
        return staging.take_rows(own, [_ARRIVED, *self.table(table).keys], rows).drop(_ARRIVED)

    # -- processing

    def run_once(self, now: datetime | None = None) -> Run:
        """Merge what is due, each source of each table by itself.

        A partition of a source is due ``delay_seconds`` after its first waiting row arrived; the others' rows go on
        waiting. A source that fails keeps its rows and is named in ``failures``; the others are merged all the same.
        """
        made = Run()
        for definition in self.tables():
            for subscription in definition.subscriptions():
                try:
                    made.extend(self.merge_due(definition.name, subscription.source_name, now))
                except Exception as error:  # noqa: BLE001 - one source's failure is no other's
                    made.failures.append((definition.name, subscription.source_name, error))
        return made

    def run(self, seconds: float | None = None, idle: float = 0.05, stop: Event | None = None) -> Run:
        """``run_once`` again and again, with a pause of ``idle`` seconds where nothing was due, for ``seconds`` or until
        ``stop`` is set."""
        made, end = Run(), None if seconds is None else time.monotonic() + seconds
        while not (stop is not None and stop.is_set()) and (end is None or time.monotonic() < end):
            turn = self.run_once()
            made.extend(turn)
            made.failures = turn.failures + made.failures[:100]
            if not turn:
                time.sleep(idle)
        return made

    def merge_due(self, table: str, source: str, now: datetime | None = None) -> list[int]:
        """Merge the partitions of a source that are due; the numbers of the commits made."""
        definition = self.table(table)
        subscription, now = definition.subscription(source), now or datetime.now(timezone.utc)
        folders = self._staged_folders(table, source)
        if not folders:
            return []
        waiting = self._staged(definition, subscription, folders)
        due = staging.ready(waiting, _ARRIVED, F.lit(now).cast("timestamp"), definition.options.delay_seconds).select(PART)
        drafts = f"{self.root}/tables/{table}/drafts/{uuid.uuid4().hex}"
        rounds = staging.rounds(waiting.join(due, PART, "left_semi"), _ARRIVED, definition.keys, definition.options.batch_rows, _ROUND, _WAVE)
        rounds.write.partitionBy(_ROUND, _WAVE).parquet(drafts)  # ranked once: what a round holds stays so
        if not any(n.startswith(f"{_ROUND}=") for n in self.store.names(drafts)):
            self.store.remove(drafts)
            return []
        fields = [f for f in rounds.schema if f.name not in (_ROUND, _WAVE)]
        ranked = self.spark.read.schema(T.StructType([*fields, T.StructField(_ROUND, T.LongType()), T.StructField(_WAVE, T.IntegerType())])).parquet(drafts)
        order = sorted((r[0], r[1]) for r in ranked.select(_ROUND, _WAVE).distinct().collect())
        rest, carried = waiting.join(due, PART, "left_anti"), []
        if not rest.isEmpty():
            name = f"carried-{uuid.uuid4().hex}"
            rest.select(*waiting.columns).write.parquet(f"{self._staging(table, source)}/{name}")
            carried = [f"{source}/{name}"]
        made = []
        for i, (turn, wave) in enumerate(order):
            batch = ranked.where((F.col(_ROUND) == turn) & (F.col(_WAVE) == wave)).drop(_ROUND, _WAVE, _ARRIVED)
            last = i == len(order) - 1
            consumed = [f"{source}/{n}" for n in folders] if last else ()
            made.append(self.commit(table, {source: batch}, consumed=consumed, carried=carried if last else ()))
        for n in folders:
            self.store.remove(f"{self._staging(table, source)}/{n}")
        self.store.remove(drafts)
        return made

    def transformed(self, definition: TableDef, batches: dict[str, DataFrame]) -> DataFrame:
        """The table's rows from its sources' rows, with _part."""
        rows = None
        for source, batch in batches.items():
            change = definition.subscription(source).transformer
            own = batch.drop(PART)
            own = change(own) if change else own
            rows = own if rows is None else rows.unionByName(own)
        types = {f.name: f.dataType for f in rows.schema}
        if any(types.get(c.name) != c.dataType for c in definition.columns):
            raise SchemaMismatch(f"{definition.name}: {rows.schema.simpleString()}")
        return rows.withColumn(PART, partition_key(rows, definition.partitions))

    def commit(
        self,
        table: str,
        batches: dict[str, DataFrame],
        processed: DataFrame | None = None,
        consumed: Iterable[str] = (),
        carried: Iterable[str] = (),
        batch_id: str | None = None,
    ) -> int:
        """Merge batches by source into the table and publish the next version; its number.

        ``processed`` names all keys of the batches (else UnprocessedKeys) and may name more: those are deleted. A
        ``batch_id`` is ``stream#number`` with numbers that rise; one at or below its stream's last is skipped, so a
        replay changes nothing. Where another writer publishes first, the merge is done anew on that writer's version.
        """
        definition = self.table(table)
        if (done := self._replayed(table, batch_id)) is not None:
            return done
        drafts = f"{self.root}/tables/{table}/drafts/{uuid.uuid4().hex}"
        new = self.transformed(definition, batches)
        new.write.parquet(drafts)  # transformers run once
        new = self.spark.read.schema(new.schema).parquet(drafts)
        validate.check_batch(new, definition.keys, processed)
        gone = None
        if processed is not None:
            gone = processed.select(*definition.keys).withColumn(PART, partition_key(processed, definition.partitions))
        for attempt in range(ATTEMPTS):
            try:
                number = self._merge_and_publish(definition, new, gone, list(consumed), list(carried), batch_id)
                break
            except CommitConflict:
                if attempt == ATTEMPTS - 1:
                    raise
                if (done := self._replayed(table, batch_id)) is not None:
                    number = done
                    break
        self.store.remove(drafts)
        return number

    def _replayed(self, table: str, batch_id: str | None) -> int | None:
        """The number of the commit that has ``batch_id`` or a later one of its stream."""
        if batch_id is None:
            return None
        stream, number = _stream_of(batch_id)
        last = self._last(table)["streams"].get(stream)
        return last[1] if last is not None and number <= last[0] else None

    def _merge_and_publish(
        self, definition: TableDef, new: DataFrame, gone: DataFrame | None, consumed: list[str], carried: list[str], batch_id: str | None
    ) -> int:
        table, home = definition.name, f"{self.root}/tables/{definition.name}"
        last = self._last(table)
        number = last["commit"] + 1
        counted = new.groupBy(PART).agg(F.count(F.lit(1)).alias("__new"))
        touched = counted if gone is None else counted.unionByName(gone.select(PART, F.lit(0).cast("long").alias("__new")))
        touched = touched.groupBy(F.col(PART).alias("partition_key")).agg(F.sum("__new").alias("__new"))
        known = self.manifests(table)
        current = known.join(touched.select("partition_key"), "partition_key", "left_semi").select(*known.columns)
        held = F.aggregate("objects", F.lit(0).cast("long"), lambda s, o: s + o["num_rows"])
        sizes = touched.join(current.select("partition_key", held.alias("__held")), "partition_key", "left").agg(
            F.max(F.col("__new") + F.coalesce("__held", F.lit(0))), F.sum(F.col("__new") + F.coalesce("__held", F.lit(0))), F.sum("__new")
        )
        most, all_rows, new_rows = sizes.first()
        names = [c for c in new.columns if c != PART]
        if definition.audit:
            new = self._with_audit_columns(new)
        base = self._rows(table, current, new.drop(PART).schema)
        width = sum(f.dataType.jsonValue() != "string" and 16 or 64 for f in new.schema)
        small = max((new_rows or 0) * width, 4 * merge.estimated_bytes(new)) <= merge.BROADCAST_BYTES
        judged = merge.classify(base, new.drop(PART), definition.keys, definition.column_names, gone, definition.merge_filter, broadcast_new=small)
        state = merge.apply_with_audit(judged, F.current_timestamp()) if definition.audit else merge.apply(judged).select(*names)
        state = state.withColumn(PART, partition_key(state, definition.partitions))
        data = f"{home}/data/_commit={number}-{uuid.uuid4().hex[:8]}"
        drafts = f"{home}/drafts/{uuid.uuid4().hex}"
        numbered = layout.numbered_files(layout.with_field_ids(state), definition.keys, definition.options.file_rows, most or 0, all_rows or 0, f"{drafts}-ranges")
        local = local_path(self.spark, data) if layout.plain(state.schema) else None
        if local is not None:
            files = layout.write_local_files(numbered, data, local, f"{drafts}-files").withColumn("key", F.concat(F.lit("data/"), "key"))
        else:
            layout.write_files(numbered, data)
            files = self._files(data, state.schema, home)
        built = manifests.build(files, F.lit(table), F.lit(0)).select("partition_key", "objects")
        next_state = (
            touched.join(current.select("partition_key", F.col("version").alias("__before")), "partition_key", "left")
            .join(built, "partition_key", "left")
            .select(
                (F.coalesce("__before", F.lit(-1)) + 1).alias("version"),
                "partition_key",
                F.coalesce("objects", F.array().cast(T.ArrayType(manifests.OBJECT))).alias("objects"),
            )
            .select(F.col("version").cast("string").alias("id"), F.lit(table).alias("table_name"), "partition_key", "version", "objects")
        )
        full = number % FULL_EVERY == 0
        if full:
            next_state = next_state.unionByName(known.join(touched, "partition_key", "left_anti").select(*next_state.columns))
        written = f"{home}/manifests/{number}-{uuid.uuid4().hex[:8]}"
        manifests.to_text(next_state).write.text(written)
        for kind in ("ranges", "files"):
            self.store.remove(f"{drafts}-{kind}")
        still = [c for c in last["consumed"] if self.store.exists(f"{self.root}/staging/{table}/{c}")]
        streams = dict(last["streams"])
        if batch_id is not None:
            stream, turn = _stream_of(batch_id)
            streams[stream] = [turn, number]
        record = {
            "commit": number,
            "manifests": written[len(home) + 1 :],
            "full": full,
            "consumed": sorted({*still, *consumed}),
            "carried": sorted(({*last["carried"]} - {*consumed}) | {*carried}),
            "streams": streams,
            "schema": state.drop(PART).schema.jsonValue(),
        }
        self.store.publish(f"{home}/commits/{number:010d}.json", record)
        return number

    @staticmethod
    def _with_audit_columns(rows: DataFrame) -> DataFrame:
        empty = [F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp"), F.lit(None).cast("long"), F.lit(None).cast("long")]
        for name, column in zip(merge.AUDIT, empty, strict=True):
            rows = rows.withColumn(name, column)
        return rows

    def _files(self, data: str, schema: T.StructType, home: str) -> DataFrame:
        """(partition_key, key, index, num_rows) of the files under ``data``; the counts are from their footers."""
        typed = T.StructType([*[f for f in schema if f.name != PART], T.StructField(PART, T.StringType()), T.StructField(FILE, T.IntegerType())])
        if not any(n.startswith(f"{PART}=") for n in self.store.names(data)):
            return self.spark.createDataFrame([], "partition_key string, key string, index int, num_rows bigint")
        found = self.spark.read.schema(typed).parquet(data)
        name = data[len(home) + 1 :]
        path = F.concat(F.lit(f"{name}/"), F.element_at(F.split(F.col("_metadata.file_path"), f"/{name.replace('=', '(?:=|%3D)')}/"), -1))
        return found.groupBy(F.col(PART).alias("partition_key"), path.alias("key"), F.col(FILE).alias("index")).agg(F.count(F.lit(1)).alias("num_rows"))

    # -- reading

    def _commits(self, table: str) -> list[int]:
        return [int(n[:-5]) for n in self.store.names(f"{self.root}/tables/{table}/commits") if n.endswith(".json") and n[:-5].isdigit()]

    def _commit(self, table: str, number: int) -> dict[str, Any]:
        return json.loads(self.store.read_text(f"{self.root}/tables/{table}/commits/{number:010d}.json"))

    def _last(self, table: str) -> dict[str, Any]:
        """The last commit's record; before the first, one with number -1."""
        log = self._commits(table)
        return self._commit(table, log[-1]) if log else {"commit": -1, "consumed": [], "carried": [], "streams": {}, "schema": None}

    def manifests(self, table: str) -> DataFrame:
        """The latest manifest of every partition."""
        home = f"{self.root}/tables/{table}"
        paths = []
        for number in reversed(self._commits(table)):
            record = self._commit(table, number)
            paths.append(f"{home}/{record['manifests']}")
            if record["full"]:
                break
        if not paths:
            return self.spark.createDataFrame([], manifests.MANIFEST)
        return manifests.latest(manifests.parse(self.spark.read.text(paths)))

    def manifest(self, table: str, key: str) -> dict:
        """The latest manifest of one partition."""
        found = self.manifests(table).where(F.col("partition_key") == key).take(1)
        if not found:
            raise ManifestNotFound(f"{table}/{key}")
        manifests.require_valid(self.spark.createDataFrame(found, manifests.MANIFEST))
        return found[0].asDict(recursive=True)

    def _rows(self, table: str, current: DataFrame, schema: T.StructType | None, index: int | None = None) -> DataFrame:
        """The rows that manifests name. A partition's files lie in one folder of its last commit, and only folders come
        to the driver; with ``index`` those of single files. ManifestError if a manifest is not valid."""
        stored = self._last(table)["schema"]
        stored = T.StructType.fromJson(stored) if stored else schema or T.StructType(list(self.table(table).columns))
        wanted = F.lit(True) if index is None else F.col("o.index") == index
        shape = rf"^(data/[^/]+/{PART}=[^/]+)/" if index is None else r"^(.*)$"
        judged = current.select(manifests.is_valid(F.struct(*manifests.MANIFEST.names)).alias("valid"), "partition_key", F.explode_outer("objects").alias("o"))
        folder = F.when(F.col("valid") & wanted, F.regexp_extract("o.key", shape, 1)).when(~F.col("valid"), F.concat(F.lit("!"), "partition_key"))
        folders = [r[0] for r in judged.select(folder.alias("folder")).where("folder is not null").distinct().collect()]
        if wrong := [f[1:] for f in folders if f.startswith("!")]:
            raise ManifestError(f"{table}: {wrong[0]}")
        if not folders:
            return self.spark.createDataFrame([], stored)
        home = f"{self.root}/tables/{table}"
        with self._few_listing_tasks():
            found = self.spark.read.option("basePath", f"{home}/data").schema(stored).parquet(*[f"{home}/{f}" for f in folders])
        return found.select(*[F.col(f"`{n}`") for n in stored.names])

    @contextmanager
    def _few_listing_tasks(self) -> Iterator[None]:
        """Let a task list many folders: Spark starts one for each (10,000 at most), which takes longer than the listing."""
        conf, few = self.spark.conf, LISTING_TASKS * self.spark.sparkContext.defaultParallelism
        before = conf.get(_LISTING, None)
        conf.set(_LISTING, str(min(few, int(before or few))))
        try:
            yield
        finally:
            conf.unset(_LISTING) if before is None else conf.set(_LISTING, before)

    def read(self, table: str, keys: Iterable[str] | None = None, index: int | None = None) -> DataFrame:
        """The table's current rows: of all partitions or those named, of all their files or the one at ``index``."""
        self.table(table)
        current = self.manifests(table)
        if keys is not None:
            current = current.where(F.col("partition_key").isin(list(keys)))
        return self._rows(table, current, None, index)

    def create_view(self, table: str, view: str | None = None) -> None:
        """Let ``spark.sql`` read the table's current rows."""
        self.read(table).createOrReplaceTempView(view or table)

    def vacuum(self, table: str) -> int:
        """Remove data files' folders that no current manifest names, drafts, and staged folders that are done with; how
        many folders went.

        Readers of older snapshots and other writers must be done.
        """
        home, last = f"{self.root}/tables/{table}", self._last(table)
        live = {r[0] for r in self.manifests(table).select(F.explode("objects").alias("o")).select(F.split("o.key", "/")[1]).distinct().collect()}
        gone = [f"{home}/data/{n}" for n in self.store.names(f"{home}/data") if n not in live]
        gone += [f"{home}/drafts/{n}" for n in self.store.names(f"{home}/drafts")]
        for s in self.table(table).subscriptions():
            folder, source = self._staging(table, s.source_name), s.source_name
            lost = {f"{source}/{n}" for n in self.store.names(folder) if n.startswith("carried-")} - {*last["carried"]}
            gone += [f"{self.root}/staging/{table}/{n}" for n in sorted(lost | {c for c in last["consumed"] if c.startswith(f"{source}/")})]
        return sum(self.store.remove(path) for path in gone)


def _stream_of(batch_id: str) -> tuple[str, int]:
    """Stream and number of ``stream#number``; another id is a stream of its own."""
    stream, _, number = batch_id.rpartition("#")
    return (stream, int(number)) if stream and number.isdigit() else (batch_id, 0)
