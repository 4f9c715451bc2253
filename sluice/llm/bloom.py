"""Bloom filters as small tables of bit maps, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each row, and the exponent of its largest size (2**31 bits are 256 MiB).
BITS_PER_ROW = 16
MAX_BITS = 31


def slots(digest: Column, bits: int) -> list[Column]:
    """Two independent slots in [0, bits) for a digest."""
    return [F.pmod(F.xxhash64(digest), F.lit(bits)), F.pmod(F.xxhash64(F.lit("second"), digest), F.lit(bits))]


def repeated_slots(rows: DataFrame, digest: str, bits: int, least: int = 2) -> DataFrame:
    """Bit maps (map_no, bits) of the slots that ``least`` or more rows hit: at most bits / 32768 rows of 4 KiB."""
    hit = rows.select(F.explode(F.array_distinct(F.array(*slots(F.col(digest), bits)))).alias("slot"))
    return (
        hit.groupBy("slot")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least)
        .groupBy(F.bitmap_bucket_number("slot").alias("map_no"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("map_bits"))
    )


def maybe_repeated(rows: DataFrame, digest: str, maps: DataFrame, bits: int, out: str) -> DataFrame:
    """Add ``out``: false only where no other row can have the same digest."""
    found = F.lit(True)
    for i, slot in enumerate(slots(F.col(digest), bits)):
        side = F.broadcast(maps.select(F.col("map_no").alias(f"__map{i}"), F.col("map_bits").alias(f"__bits{i}")))
        rows = rows.withColumn(f"__slot{i}", slot)
        rows = rows.join(side, F.bitmap_bucket_number(f"__slot{i}") == F.col(f"__map{i}"), "left")
        at = F.bitmap_bit_position(f"__slot{i}")
        byte = F.conv(F.hex(F.substring(f"__bits{i}", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = found & F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return rows.withColumn(out, found).drop(*[f"__{c}{i}" for i in range(2) for c in ("map", "bits", "slot")])
