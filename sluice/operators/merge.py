"""The merge: base rows, new rows and processed keys to the next state, by joins on the primary key.

    base  new  processed                 action      row that stays
    yes   no   no                        untouched   base
    yes   no   yes                       deleted     none
    yes   yes  compare columns equal     unchanged   base, whole
    yes   yes  some column differs       updated     new (base if the merge filter refuses)
    no    yes  -                         inserted    new

One plan covers every partition touched. Catalyst sorts and joins by key; where the new rows are small beside the base
they are broadcast instead, and the base is not shuffled at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaMismatch
from ..model import MergeFilter

ACTION = "_merge_action"
#: A side is broadcast only if Catalyst's estimate of its size is at most this.
BROADCAST_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def require_same_schema(base: DataFrame, new: DataFrame) -> None:
    own = {f.name: f.dataType for f in base.schema}
    if {f.name: f.dataType for f in new.schema} != own:
        raise SchemaMismatch(f"{base.schema.simpleString()} and {new.schema.simpleString()}")


def classify(
    base: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    compare: Sequence[str],
    processed: DataFrame | None = None,
    merge_filter: MergeFilter | None = None,
    broadcast_new: bool | None = None,
) -> DataFrame:
    """Structs ``b`` and ``s`` (the base row, the new row, either null) and the action of every key.

    Keys must be unique on each side and not null. ``processed`` holds keys; a new row's key counts as processed anyway.
    """
    require_same_schema(base, new)
    names = base.columns
    whole = lambda df: F.struct(*[F.col(f"`{n}`") for n in names])
    b = base.select(*[F.col(f"`{k}`").alias(f"__b{i}") for i, k in enumerate(keys)], whole(base).alias("b"))
    s = new.select(*[F.col(f"`{k}`").alias(f"__s{i}") for i, k in enumerate(keys)], whole(new).alias("s"))
    on = reduce(lambda x, y: x & y, [F.col(f"__b{i}") == F.col(f"__s{i}") for i in range(len(keys))])
    if broadcast_new is None:
        broadcast_new = estimated_bytes(new) <= BROADCAST_BYTES
    if broadcast_new:
        few = F.broadcast(s)
        known = b.join(few, on, "left")
        met = b.select(*[f"__b{i}" for i in range(len(keys))]).join(F.broadcast(s.select(*[f"__s{i}" for i in range(len(keys))])), on, "left_semi")
        fresh = s.join(met, on, "left_anti").select(
            *[F.lit(None).cast(b.schema[f"__b{i}"].dataType).alias(f"__b{i}") for i in range(len(keys))],
            F.lit(None).cast(b.schema["b"].dataType).alias("b"),
            *[f"__s{i}" for i in range(len(keys))],
            "s",
        )
        both = known.unionByName(fresh)
    else:
        both = b.join(s, on, "full_outer")
    both = both.select(*[F.coalesce(f"__b{i}", f"__s{i}").alias(f"__k{i}") for i in range(len(keys))], "b", "s")
    gone = F.lit(False)
    if processed is not None:
        p = processed.select(*[F.col(f"`{k}`").alias(f"__p{i}") for i, k in enumerate(keys)]).distinct()
        both = both.join(p, reduce(lambda x, y: x & y, [F.col(f"__k{i}") == F.col(f"__p{i}") for i in range(len(keys))]), "left")
        gone = F.col("__p0").isNotNull()
    equal = reduce(lambda x, y: x & y, [F.col(f"b.`{c}`").eqNullSafe(F.col(f"s.`{c}`")) for c in compare], F.lit(True))
    if merge_filter is not None:
        allowed = merge_filter({n: F.col(f"b.`{n}`") for n in names}, {n: F.col(f"s.`{n}`") for n in names})
        equal = equal | ~F.coalesce(allowed, F.lit(False))
    action = (
        F.when(F.col("s").isNull() & gone, "deleted")
        .when(F.col("s").isNull(), "untouched")
        .when(F.col("b").isNull(), "inserted")
        .when(equal, "unchanged")
        .otherwise("updated")
    )
    return both.select("b", "s", action.alias(ACTION))


def apply(classified: DataFrame, keep_action: bool = False) -> DataFrame:
    """The rows of the next state from ``classify``'s result."""
    names = classified.schema["b"].dataType.names
    row = F.when(F.col(ACTION).isin("inserted", "updated"), F.col("s")).otherwise(F.col("b"))
    kept = classified.where(F.col(ACTION) != "deleted").select(row.alias("r"), ACTION)
    return kept.select(*[F.col(f"r.`{n}`").alias(n) for n in names], *([ACTION] if keep_action else []))


def merge(base: DataFrame, new: DataFrame, keys: Sequence[str], compare: Sequence[str], processed: DataFrame | None = None, **options) -> DataFrame:
    """``apply`` after ``classify``."""
    return apply(classify(base, new, keys, compare, processed, **options))


#: Columns that ``with_audit`` keeps: when a row was last processed and updated, and how often.
AUDIT = ("_processed_ts", "_updated_ts", "_processed_count", "_updated_count")


def apply_with_audit(classified: DataFrame, now: Column) -> DataFrame:
    """Like ``apply``, for rows that carry the AUDIT columns: a key that was in the batch counts as processed, and an
    inserted or updated one as updated, at ``now``."""
    names = [n for n in classified.schema["b"].dataType.names if n not in AUDIT]
    take = F.col(ACTION).isin("inserted", "updated")
    seen = F.col(ACTION).isin("inserted", "updated", "unchanged")
    row = F.when(take, F.col("s")).otherwise(F.col("b"))
    kept = classified.where(F.col(ACTION) != "deleted").withColumn("__r", row)
    before = lambda n: F.coalesce(F.col(f"b.`{n}`"), F.lit(0))
    return kept.select(
        *[F.col(f"__r.`{n}`").alias(n) for n in names],
        F.when(seen, now).otherwise(F.col("b._processed_ts")).alias("_processed_ts"),
        F.when(take, now).otherwise(F.col("b._updated_ts")).alias("_updated_ts"),
        (before("_processed_count") + seen.cast("long")).alias("_processed_count"),
        (before("_updated_count") + take.cast("long")).alias("_updated_count"),
    )


def newer(column: str = "_produced_ts") -> MergeFilter:
    """A merge filter against late rows: the new row counts only if its ``column`` is above the stored row's."""
    return lambda stored, new: new[column] > stored[column]
