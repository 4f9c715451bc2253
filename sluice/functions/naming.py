"""Names of keys, files and manifests, both ways, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The formats below are those of an existing stored layout, which queries parse and write. The warehouse's
# own files lie otherwise (see warehouse.py).


def data_key(table: Column | str, key: Column | str, version: Column | str, index: Column | str) -> Column:
    """``table-state/part-data/{table}/{key}/d_{version}_{index}.parquet``."""
    return F.format_string("table-state/part-data/%s/%s/d_%s_%s.parquet", *[_text(c) for c in (table, key, version, index)])


def manifest_key(table: Column | str, key: Column | str, version: Column | str) -> Column:
    return F.format_string("table-state/part-data/%s/%s/manifest_%s.json", *[_text(c) for c in (table, key, version)])


def manifest_version(name: Column) -> Column:
    """The version in a manifest's name; null where the name holds none."""
    return F.regexp_extract(name, r"manifest_(.*)\.json$", 1).try_cast("int")


def buffer_key(table: Column | str, source: Column | str, key: Column | str) -> Column:
    return F.concat_ws("/", F.lit("table-partition"), *[_text(c) for c in (table, source, key)])


def key_source(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def key_partition(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def task_id(table: Column | str, source: Column | str, key: Column | str) -> Column:
    return F.concat_ws("-", *[_text(c) for c in (table, source, key)])


def _text(value: Column | str) -> Column:
    return (F.lit(value) if isinstance(value, str) else value).cast("string")
