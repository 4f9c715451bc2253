"""Manifests: which files are a partition's current state, at which version. JSON in storage, structs in plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ManifestError
from ..functions.naming import manifest_version

OBJECT = T.StructType([T.StructField("key", T.StringType()), T.StructField("index", T.IntegerType()), T.StructField("num_rows", T.LongType())])
MANIFEST = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("partition_key", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("objects", T.ArrayType(OBJECT)),
    ]
)


def by_index(objects: Column) -> Column:
    """Objects sorted by index."""
    return F.array_sort(objects, lambda a, b: a["index"] - b["index"])


def is_valid(manifest: Column) -> Column:
    """Whether a manifest's fields are there and its sorted objects are numbered from 0 without a gap."""
    objects = manifest["objects"]
    numbered = F.transform(objects, lambda o, i: (o["index"] == i) & o["key"].isNotNull() & (o["key"] != "") & (o["num_rows"] >= 0))
    return F.coalesce(
        (manifest["table_name"] != "")
        & (manifest["partition_key"] != "")
        & (manifest["version"] >= 0)
        & (manifest["id"] == manifest["version"].cast("string"))
        & F.forall(numbered, lambda ok: F.coalesce(ok, F.lit(False))),
        F.lit(False),
    )


def parse(texts: DataFrame, column: str = "value") -> DataFrame:
    """Manifests from their JSON, objects sorted."""
    m = F.from_json(column, MANIFEST)
    return texts.select(m.alias("m")).select(
        "m.id", "m.table_name", "m.partition_key", "m.version", by_index(F.col("m.objects")).alias("objects")
    )


def to_text(manifests: DataFrame) -> DataFrame:
    return manifests.select(F.to_json(F.struct("id", "table_name", "partition_key", "version", "objects")).alias("value"))


def require_valid(manifests: DataFrame) -> DataFrame:
    wrong = manifests.where(~is_valid(F.struct(*manifests.columns))).take(1)
    if wrong:
        raise ManifestError(str(wrong[0].asDict(recursive=True)))
    return manifests


def build(files: DataFrame, table: Column, version: Column) -> DataFrame:
    """From (partition_key, key, index, num_rows), a row per file, one manifest per partition."""
    return files.groupBy("partition_key").agg(
        by_index(F.collect_list(F.struct("key", F.col("index").cast("int").alias("index"), F.col("num_rows").cast("long").alias("num_rows")))).alias("objects")
    ).select(version.cast("string").alias("id"), table.alias("table_name"), "partition_key", version.cast("int").alias("version"), "objects")


def latest(manifests: DataFrame) -> DataFrame:
    """Of each partition's manifests that with the highest version."""
    row = F.struct("id", "table_name", "partition_key", "version", "objects")
    return manifests.groupBy("partition_key").agg(F.max_by(row, "version").alias("m")).select("m.*")


def latest_names(names: DataFrame, name: str = "name") -> DataFrame:
    """The file name of each partition's highest version, from (partition_key, name); names without a version don't count."""
    numbered = names.withColumn("version", manifest_version(F.col(name))).where("version is not null")
    return numbered.groupBy("partition_key").agg(F.max("version").alias("version"), F.max_by(name, "version").alias(name))
