"""Ranks inside groups of any size without sorting a group in one task.

Rows are range-sorted on group, score and tie, and a row number last, between splitters that Spark
samples from the rows themselves: scores may be as skewed or as equal as they like, parts stay
near equal. The counts of the parts, a small table, give each part its offset in its group. The
sorted rows are checkpointed, so that parts are the same whenever they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..shared import saved

#: Low bits of a generated row number, which count within its part.
_WITHIN = (1 << 33) - 1


def _parts(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows sorted by keys and order, with their part (_part) and place in it (_at)."""
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())
    placed = salted.repartitionByRange(*keys, *order, "_salt").sortWithinPartitions(*keys, *order, "_salt").drop("_salt")
    stored = saved(placed.withColumn("_at", F.monotonically_increasing_id()))
    return stored.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit(_WITHIN))})


def _offsets(parts: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """parts with the amount in earlier parts of the group (before), in all of it (total), and the group's first place in the part (_first)."""
    sums = parts.groupBy("_part", *keys).agg(F.sum(amount).alias("_own"), F.min("_at").alias("_first"))
    group = W.partitionBy(*keys)
    before = F.coalesce(F.sum("_own").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_part", *keys, "_first", before.alias("before"), F.sum("_own").over(group).alias("total"))
    on = [F.col("r._part") == F.col("o._part"), *[F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]]
    return parts.alias("r").join(sums.alias("o"), on).select("r.*", "_first", "before", "total")


def ranked(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """rows with rank from 1 by the order columns in their group, and the group's total."""
    placed = _offsets(_parts(rows, keys, list(order)), keys, F.lit(1))
    return placed.withColumn("rank", F.col("before") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_first", "before")


def running(rows: DataFrame, keys: list[str], score: str, amount: str) -> DataFrame:
    """rows, of which a group has one a score, with the amount of all lower scores in their group (below)."""
    placed = _offsets(_parts(rows, keys, [score]), keys, F.col(amount))
    inside = F.sum(amount).over(W.partitionBy("_part", *keys).orderBy(score).rowsBetween(W.unboundedPreceding, -1))
    return placed.withColumn("below", F.col("before") + F.coalesce(inside, F.lit(0))).drop("_part", "_at", "_first", "before", "total")


def ntile(rows: DataFrame, keys: list[str], score: str, tie: str, n: int, name: str) -> DataFrame:
    """rows with the number, from 1, of their part of n equal parts of the group; the first parts take what is over."""
    size, over = F.floor(F.col("total") / n), F.pmod(F.col("total"), F.lit(n))
    long = over * (size + 1)
    tile = F.when(F.col("rank") <= long, F.ceil(F.col("rank") / (size + 1))).otherwise(over + F.ceil((F.col("rank") - long) / size))
    return ranked(rows, keys, score, tie).withColumn(name, tile.cast("int")).drop("rank", "total")


def quantiles(rows: DataFrame, keys: list[str], score: str, tie: str, shares: list[float]) -> DataFrame:
    """keys, values: exact quantiles by linear interpolation between the two rows that enclose each share."""
    placed = ranked(rows.select(*keys, score, tie), keys, score, tie)
    ends = []
    for q in shares:
        at = F.lit(q) * (F.col("total") - 1)
        low = F.floor(at) + 1
        ends += [F.max(F.when(F.col("rank") == low, F.col(score))), F.max(F.when(F.col("rank") == F.least(low + 1, F.col("total")), F.col(score))), F.max(at - F.floor(at))]
    found = placed.groupBy(*keys).agg(*[e.alias(f"e{k}") for k, e in enumerate(ends)])
    values = [F.col(f"e{3 * k}") + (F.col(f"e{3 * k + 1}") - F.col(f"e{3 * k}")) * F.col(f"e{3 * k + 2}") for k in range(len(shares))]
    return found.select(*keys, F.array(*values).alias("values"))
