"""Sharding by jump consistent hashing: no ring table, and a new last shard only takes rows, never moves others.

DataFrame functions only. The generator of the published algorithm multiplies modulo 2^64; as longs do not wrap
around under ANSI rules, a key is held as two unsigned 32-bit halves and multiplied in pieces that fit a long.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Fixed by the published algorithm: the multiplier of its linear congruential generator.
MULTIPLIER = 2862933555777941757
LOW32 = 0xFFFFFFFF


def _times_plus_one(hi: Column, lo: Column) -> Column:
    """(hi, lo) of key * MULTIPLIER + 1 modulo 2^64; every intermediate value stays below 2^52."""
    c_hi, c_lo = MULTIPLIER >> 32, MULTIPLIER & LOW32

    def low_product(x: Column, c: int) -> Column:
        """x * c modulo 2^32."""
        return (x * (c & 0xFFFF) + F.shiftleft((x * (c >> 16)).bitwiseAND(0xFFFF), 16)).bitwiseAND(LOW32)

    p0 = lo * (c_lo & 0xFFFF)
    mid = F.shiftright(p0, 16) + lo * (c_lo >> 16)
    low = F.shiftleft(mid.bitwiseAND(0xFFFF), 16) + p0.bitwiseAND(0xFFFF) + 1
    high = F.shiftright(mid, 16) + F.shiftright(low, 32) + low_product(lo, c_hi) + low_product(hi, c_lo)
    return F.struct(high.bitwiseAND(LOW32).alias("hi"), low.bitwiseAND(LOW32).alias("lo"))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard (int, from 0) of a long key. Each step leaves a lower shard for a higher one, so ``shards`` steps
    are always enough and most keys stand still after a few."""
    if shards < 1:
        raise ValueError("there must be at least one shard")

    def step(acc: Column, _: Column) -> Column:
        def moved(k: Column) -> Column:
            nxt = (acc["j"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(k["hi"], 1) + 1).cast("double"))
            return F.struct(k["hi"], k["lo"], acc["j"].alias("b"), F.floor(nxt).alias("j"))

        held = F.transform(F.array(_times_plus_one(acc["hi"], acc["lo"])), moved)[0]
        return F.when(acc["j"] < shards, held).otherwise(acc)

    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(LOW32).alias("lo"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )
    steps = F.sequence(F.lit(1), F.lit(shards))
    return F.aggregate(steps, start, step, lambda acc: acc["b"].cast("int"))


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard.

    The shard depends on the id and the shard count alone. A missing text has size 1 and checksum 0; a missing id is
    a key like any other. Slots number the rows of a shard without gaps: rows are dealt into cells, a cell is
    numbered by a window, and the cells' offsets come from their counts. There are as many cells as rows in a cell
    holds, so neither grows to more than the square root of a shard; cells are dealt by row, so equal ids or texts
    do not meet in one. Repeated rows get slots of their own. Other columns are left out.
    """
    key = F.xxhash64(F.col(id_col))
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            jump_hash(key, shards).alias("shard"),
            jump_hash(key, shards + 1).alias("grown_shard"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sharding",
    )
    cells = max(1, math.isqrt(rows.count() // shards))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int"))
    counts = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "row")
    numbered = rows.withColumn("place", F.row_number().over(inside))
    return numbered.join(offsets, ["shard", "cell"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("offset") + F.col("place") - 1).alias("slot"),
        "grown_shard",
    )
