"""Allocations over strata: balanced prefixes and balanced quotas.

In a balanced order every prefix of n rows holds near n * quota / total rows of each stratum: the
next row is of the stratum whose count lies most below that, the first in a stated order if
several do. Such an order depends on all steps before, but forgets where it began: two starts
with the same number of rows given come to the same state after a few steps. So blocks of
positions are walked apart, each from a guessed state, and a block is walked again only if the
state that the block before it ends in is not the guess. The result is that of one walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import ranks

#: Positions that one task walks.
BLOCK = 1 << 18


def _guess(quotas: list[int], n: int) -> list[int]:
    """Rows given of each stratum after n positions, by largest remainders."""
    total = sum(quotas)
    given, rest = zip(*(divmod(q * n, total) for q in quotas))
    first = sorted(range(len(quotas)), key=lambda k: (-rest[k], k))[: n - sum(given)]
    return [g + (k in first) for k, g in enumerate(given)]


def _walk(quotas: list[int], given: list[int], begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The stratum of each position from begin to end, and what is given of each stratum then."""
    quota, total = np.array(quotas, np.int64), sum(quotas)
    lack = np.array([q * begin - g * total for q, g in zip(quotas, given)], np.int64)
    out = np.empty(end - begin, np.int32)
    for k in range(end - begin):
        lack += quota
        out[k] = chosen = lack.argmax()
        lack[chosen] -= total
    return out, np.array(given, np.int64) + np.bincount(out, minlength=len(quotas))


def positions(spark: SparkSession, quotas: dict[str, int], stratum: str = "stratum", block: int = BLOCK) -> DataFrame:
    """stratum, place (from 1 within it) and position (from 1) of a balanced order; of equal lacks the first of quotas goes first."""
    names, sizes, total = list(quotas), list(quotas.values()), sum(quotas.values())
    if total > 2**31 or min(sizes, default=0) < 0:
        raise ValueError("quotas are not negative and at most 2**31 in all")
    begins = list(range(0, total, block))
    ends = [*begins[1:], total]
    starts = [_guess(sizes, b) for b in begins]

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, given in zip(batch.column("block").to_pylist(), batch.column("given").to_pylist()):
                _, after = _walk(sizes, given, begins[k], ends[k])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([after.tolist()], pa.list_(pa.int64()))], ["block", "given"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, given in zip(batch.column("block").to_pylist(), batch.column("given").to_pylist()):
                chosen, _ = _walk(sizes, given, begins[k], ends[k])
                place = np.empty(len(chosen), np.int64)
                for s, g in enumerate(given):
                    own = np.flatnonzero(chosen == s)
                    place[own] = g + 1 + np.arange(len(own))
                label = pa.array(names, pa.string()).take(pa.array(chosen))
                yield pa.RecordBatch.from_arrays([label, pa.array(place), pa.array(np.arange(begins[k], ends[k]) + 1)], [stratum, "place", "position"])

    def of_blocks(blocks: list[int]) -> DataFrame:
        made = spark.createDataFrame([(k, starts[k]) for k in blocks], "block int, given array<long>")
        return made.repartition(max(1, min(len(blocks), 4096)), "block")

    walk = list(range(len(begins) - 1))
    while walk:  # a row a block of positions
        ended = {r["block"]: r["given"] for r in of_blocks(walk).mapInArrow(states, "block int, given array<long>").collect()}
        wrong = [k + 1 for k in sorted(ended) if ended[k] != starts[k + 1]]
        for k in wrong:
            starts[k] = ended[k - 1]
        walk = [k for k in wrong if k + 1 < len(begins)]
    return of_blocks(list(range(len(begins)))).mapInArrow(rows, f"{stratum} string, place long, position long")


def balanced_prefixes(rows: DataFrame, stratum: str, digest: Column, strata: list[str]) -> DataFrame:
    """rows with their place in their stratum by a digest, and their position in a balanced order of the strata.

    Rows of other strata are left out.
    """
    held = rows.where(F.col(stratum).isin(strata)).withColumn("_digest", digest)
    counts = {r[stratum]: r["n"] for r in held.groupBy(stratum).agg(F.count("*").alias("n")).collect()}  # a row a stratum
    placed = ranks.ranked(held, [stratum], "_digest").drop("_digest", "total").withColumnRenamed("rank", "place")
    return placed.join(positions(rows.sparkSession, {s: counts.get(s, 0) for s in strata}, stratum), [stratum, "place"])


def balanced_quotas(capacities: DataFrame, stratum: str, capacity: str, total: int) -> DataFrame:
    """stratum, capacity, quota: a total dealt as equally as the capacities allow.

    Strata are filled like vessels to one level. What is left over goes one each to strata above
    the level, to those that it fills least, then by name; at level nothing it goes by name alone.
    A total beyond all capacities gives null quotas. capacities has a row a stratum.
    """
    every = W.partitionBy()
    c = F.col(capacity)
    up = W.orderBy(c, stratum)
    ranked = capacities.select(stratum, capacity).where(c > 0)
    ranked = ranked.withColumns({"below": F.sum(c).over(up.rowsBetween(W.unboundedPreceding, 0)), "above": F.count("*").over(every) - F.row_number().over(up), "room": F.sum(c).over(every)})
    full = F.col("below") + c * F.col("above") <= total  # the level can reach this capacity
    level = ranked.withColumns({
        "base": F.coalesce(F.max(F.when(full, c)).over(every), F.lit(0)),
        "held": F.coalesce(F.max(F.when(full, F.col("below") + c * F.col("above"))).over(every), F.lit(0)),
    })
    level = level.withColumn("open", F.count_if(c > F.col("base")).over(every)).withColumn("rest", F.lit(total) - F.col("held"))
    each = F.when(F.col("open") > 0, F.call_function("div", F.col("rest"), F.col("open"))).otherwise(0)
    level = level.withColumns({"level": F.col("base") + each, "extra": F.col("rest") - each * F.col("open")})
    order = W.orderBy((c <= F.col("level")).cast("int"), F.when(F.col("level") > 0, -c).otherwise(0), stratum)
    more = (F.row_number().over(order) <= F.col("extra")).cast("long")
    return level.select(stratum, capacity, F.when(F.col("room") >= total, F.least(c, F.col("level")) + more).cast("long").alias("quota"))
