"""What is staged and due: rows waiting by partition, and the delayed tasks that take them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .layout import PART


def distinct_rows(*batches: DataFrame) -> DataFrame:
    """The union of batches, equal rows once."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return out.dropDuplicates()


def group_sizes(staged: DataFrame) -> DataFrame:
    return staged.groupBy(PART).agg(F.count(F.lit(1)).alias("rows"))


def pending(staged: DataFrame) -> DataFrame:
    """Each (source, partition) with something staged."""
    return staged.select("source", PART).dropDuplicates()


def ready(staged: DataFrame, arrived: str, now: Column, delay_seconds: float) -> DataFrame:
    """Partitions whose first row arrived ``delay_seconds`` ago or more; later rows don't put that off."""
    first = staged.groupBy(PART).agg(F.min(arrived).alias("first_seen"))
    return first.where(F.col("first_seen") <= now - F.make_dt_interval(secs=F.lit(float(delay_seconds))))


def take_rows(staged: DataFrame, order: Sequence[str], rows: int) -> DataFrame:
    """At most ``rows`` rows of each partition; the rest stay for the next round."""
    place = F.row_number().over(Window.partitionBy(PART).orderBy(*order))
    return staged.withColumn("__place", place).where(F.col("__place") <= rows).drop("__place")


def rounds(staged: DataFrame, arrived: str, keys: Sequence[str], rows: int | None, turn: str, wave: str) -> DataFrame:
    """Each row once, at its latest arrival, with the batch that merges it: ``turn``, then ``wave``.

    A turn takes the ``rows`` oldest rows of each partition that are left (all if None), ties by key and by the rows
    themselves. In a turn, a key's later versions wait for a later wave, so the latest is merged last; versions of a
    key that arrived together stay together, for the check of the batch to refuse.
    """
    names = [F.col(f"`{n}`") for n in staged.columns if n != arrived]
    once = staged.groupBy(*names).agg(F.max(F.col(arrived)).alias(arrived))
    place = F.row_number().over(Window.partitionBy(PART).orderBy(arrived, *keys, F.xxhash64(*names))).cast("long") - 1
    number = F.lit(0).cast("long") if rows is None else F.call_function("div", place, F.lit(rows).cast("long"))
    taken = once.withColumn(turn, number)
    later = F.dense_rank().over(Window.partitionBy(turn, *keys).orderBy(arrived))
    return taken.withColumn(wave, later)


def first_wins(tasks: DataFrame, replace: bool = False) -> DataFrame:
    """(queue, task_id, due): of several requests for a task the first due time counts, or the last asked for."""
    due = F.max_by("due", F.struct("asked", "due")) if replace else F.min("due")
    return tasks.groupBy("queue", "task_id").agg(due.alias("due"))


def due_tasks(tasks: DataFrame, now: Column) -> DataFrame:
    """The earliest due task of each queue, ties by task_id."""
    others = [n for n in tasks.columns if n not in ("queue", "due", "task_id")]
    first = tasks.where(F.col("due") <= now).groupBy("queue").agg(F.min(F.struct("due", "task_id", *others)).alias("t"))
    return first.select(*[F.col("queue") if n == "queue" else F.col(f"t.`{n}`") for n in tasks.columns])


def queue_lengths(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("queue").agg(F.count(F.lit(1)).alias("length"))


def newly_added(staged: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` that are not staged yet, each once."""
    return batch.dropDuplicates().exceptAll(staged.dropDuplicates()) if staged.columns else batch.dropDuplicates()
