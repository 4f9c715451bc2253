"""Tables, their sources and options, declared once and checked when they are registered."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .errors import SubscriptionNotFound, TableError
from .functions.partitioning import Strategy

Transformer = Callable[[DataFrame], DataFrame]
#: From the stored row's and the new row's columns, by name, to whether the new row may replace the stored one.
MergeFilter = Callable[[dict[str, Column], dict[str, Column]], Column]


@dataclass(frozen=True)
class TableOptions:
    """When a batch is due, how many rows of a partition it takes (None: all that wait), and how many rows a file holds."""

    delay_seconds: float = 10.0
    batch_rows: int | None = None
    file_rows: int = 10_000


@dataclass(frozen=True)
class Subscription:
    """A named external source: its columns, and how a batch of them becomes rows of the table (None: as it is)."""

    name: str
    columns: tuple[T.StructField, ...]
    transformer: Transformer | None = None

    @property
    def source_name(self) -> str:
        return f"external.{self.name}"

    @property
    def schema(self) -> T.StructType:
        return T.StructType(list(self.columns))


@dataclass(frozen=True)
class SubscriptionGroup:
    name: str
    subscriptions: tuple[Subscription, ...] = ()


@dataclass(frozen=True)
class TableDef:
    """A table: columns, partition columns with their strategies (together the primary key), sources and options.

    Definitions are built by methods that each return a new one.
    """

    name: str
    columns: tuple[T.StructField, ...] = ()
    partitions: tuple[tuple[str, Strategy], ...] = ()
    groups: tuple[SubscriptionGroup, ...] = ()
    options: TableOptions = field(default_factory=TableOptions)
    merge_filter: MergeFilter | None = None
    audit: bool = False

    def with_columns(self, *columns: T.StructField) -> TableDef:
        return replace(self, columns=self.columns + columns)

    def with_partition(self, column: str, strategy: Strategy) -> TableDef:
        return replace(self, partitions=(*self.partitions, (column, strategy)))

    def with_group(self, group: SubscriptionGroup) -> TableDef:
        return replace(self, groups=(*self.groups, group))

    def with_options(self, options: TableOptions) -> TableDef:
        return replace(self, options=options)

    def with_merge_filter(self, merge_filter: MergeFilter) -> TableDef:
        return replace(self, merge_filter=merge_filter)

    def with_audit(self) -> TableDef:
        return replace(self, audit=True)

    @property
    def keys(self) -> list[str]:
        return [name for name, _ in self.partitions]

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    def subscriptions(self) -> Iterator[Subscription]:
        for group in self.groups:
            yield from group.subscriptions

    def subscription(self, source_name: str) -> Subscription:
        for s in self.subscriptions():
            if s.source_name == source_name:
                return s
        raise SubscriptionNotFound(f"{self.name}: {source_name}")

    def validate(self) -> None:
        """Raise TableError, or PartitionError, for the first thing that is wrong."""

        def need(ok: object, what: str) -> None:
            if not ok:
                raise TableError(f"table {self.name!r}: {what}")

        need(self.name, "it needs a name")
        need(self.columns, "it needs a column")
        need(all(c.name for c in self.columns), "every column needs a name")
        need(len(set(self.column_names)) == len(self.columns), "column names must differ")
        need(self.partitions, "it needs a partition column")
        types = {c.name: c.dataType for c in self.columns}
        need(all(k in types for k in self.keys), "a partition column is not a column of the table")
        need(len(set(self.keys)) == len(self.keys), "partition columns must differ")
        for name, strategy in self.partitions:
            strategy.validate(types[name])
        sources = [s.source_name for s in self.subscriptions()]
        need(len(set(sources)) == len(sources), "source names must differ")
        need(self.options.file_rows > 0 and (self.options.batch_rows or 1) > 0 and self.options.delay_seconds >= 0, "options must be positive")
        for group in self.groups:
            need(group.name, "every group of sources needs a name")
            need(group.subscriptions, f"group {group.name!r} needs a source")
            for s in group.subscriptions:
                need(s.name, f"a source of group {group.name!r} needs a name")
                need(s.columns and all(c.name for c in s.columns), f"source {s.name!r} needs named columns")
                own = {c.name: c.dataType for c in s.columns}
                for key in self.keys:
                    need(own.get(key) == types[key], f"source {s.name!r} needs column {key!r} of type {types[key].simpleString()}")
