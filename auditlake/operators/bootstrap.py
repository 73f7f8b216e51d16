"""Cluster bootstrap by counter-based Poisson(1) weights.

A weight is a function of (seed, unit, replicate) alone, so results do not depend on
partitioning, and all cells of a unit share it. Weighted sums are made where the cells are:
each task multiplies the matrix of its units' weights by its cells' columns and sends one
array over all replicates for each group, so rows never multiply by replicates.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import digest

#: Cumulative Poisson(1) probabilities up to 7, as 48-bit integers.
CUTS = [int(2**48 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8)]
#: Draws of 48 bits that one digest gives.
DRAWS = 5
#: Replicates whose weights a task holds at once.
BLOCK = 500


def poisson_weight(seed: str, unit: Column, replicate: Column) -> Column:
    """The weight as a column; replicates count from 1."""
    block, place = F.floor((replicate - 1) / DRAWS), F.pmod(replicate - 1, F.lit(DRAWS))
    u = F.conv(F.substr(digest(seed, unit, block), place * 12 + 1, F.lit(12)), 16, 10).cast("bigint")
    return reduce(lambda a, b: a + b, [(u >= c).cast("int") for c in CUTS])


#: The weight of each value of a draw's first 16 bits; 255 where the other 32 decide.
_BY_TOP = np.searchsorted(np.array(CUTS), np.arange(1 << 16, dtype=np.int64) << 32, "right").astype(np.uint8)
_BY_TOP[[c >> 32 for c in CUTS]] = 255


def weights(seed: str, units: list, first: int, last: int) -> np.ndarray:
    """Weights of units in rows and of replicates first + 1 to last in columns; first is a multiple of DRAWS."""
    sha = hashlib.sha256
    tails = [b":%d" % b for b in range(first // DRAWS, -(-last // DRAWS))]
    raw = b"".join([sha(head + tail).digest() for head in [f"{seed}:{u}".encode() for u in units] for tail in tails])
    words = np.frombuffer(raw, ">u2").reshape(len(units), -1, 16)[:, :, : 3 * DRAWS].reshape(len(units), -1, 3)[:, : last - first]
    found = _BY_TOP[words[:, :, 0]]
    open_ = np.nonzero(found == 255)
    draws = words[open_].astype(np.int64) @ (1 << np.array([32, 16, 0], np.int64))
    found[open_] = np.searchsorted(np.array(CUTS), draws, "right")
    return found.astype(np.float64)


def weighted_sums(cells: DataFrame, unit: str, keys: list[str], values: list[str], seed: str, replicates: int) -> DataFrame:
    """keys and, for each value, an array of its weighted sums over the replicates."""
    kinds = dict(cells.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *[f"`{v}` array<double>" for v in values]])

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for pdf in frames:
            codes, units = pd.factorize(pdf[unit])
            groups = list(pdf.groupby(keys, sort=False, dropna=False).indices.items())
            columns = pdf[values].to_numpy(np.float64).T
            for first in range(0, replicates, BLOCK):
                last = min(first + BLOCK, replicates)
                w = weights(seed, units.tolist(), first, last)
                for key, at in groups:
                    key = key if isinstance(key, tuple) else (key,)
                    if key not in held:
                        held[key] = np.zeros((len(values), replicates))
                    own, inverse = np.unique(codes[at], return_inverse=True)
                    per_unit = np.stack([np.bincount(inverse, c[at], len(own)) for c in columns])
                    held[key][:, first:last] += per_unit @ w[own]
        if held:
            yield pd.DataFrame([[*key, *[row.tolist() for row in sums]] for key, sums in held.items()], columns=[*keys, *values])

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, *[np.sum(np.stack(pdf[v].to_list()), axis=0).tolist() for v in values]]], columns=[*keys, *values])

    rows = cells.select(unit, *keys, *[F.col(v).cast("double").alias(v) for v in values]).mapInPandas(partial, schema)
    return rows.groupBy(*keys).applyInPandas(total, schema)


def values_of(sums: DataFrame, keys: list[str], statistic: Column) -> DataFrame:
    """keys, replicate, value of a statistic over the columns of a replicate's sums, which have the names of weighted_sums()."""
    arrays = [c for c in sums.columns if c not in keys]
    rows = sums.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("k", "x")).select(*keys, (F.col("k") + 1).alias("replicate"), *[F.col("x")[c].alias(c) for c in arrays])
    return rows.select(*keys, "replicate", statistic.alias("value"))


def ratio(units: DataFrame, unit: str, num: str, den: str, keys: list[str], seed: str, replicates: int) -> DataFrame:
    """keys, replicate, value: weighted ratio of sums; null where the denominator is zero."""
    return values_of(weighted_sums(units, unit, keys, [num, den], seed, replicates), keys, F.when(F.col(den) != 0, F.col(num) / F.col(den)))


def delta(values: DataFrame, base: str, other: str, keys: list[str]) -> DataFrame:
    """keys, replicate, value: the other variant's value less the base's of the same replicate."""
    of = lambda v: F.max(F.when(F.col("variant") == v, F.col("value")))
    return values.groupBy(*keys, "replicate").agg((of(other) - of(base)).alias("value"))


def interval(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_valid, low, high (2.5 and 97.5 %), p: share of replicates at or below zero, plus one."""
    finite = values.where(F.col("value").isNotNull() & ~F.isnan("value"))
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    out = finite.groupBy(*keys).agg(F.count("*").alias("n_valid"), q.alias("q"), ((1 + F.count_if(F.col("value") <= 0)) / (F.count("*") + 1)).alias("p"))
    return out.select(*keys, "n_valid", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "p")


def simultaneous(values: DataFrame, estimate: DataFrame, key: str, centred: bool = False) -> DataFrame:
    """key, low, high, n_valid: max-|t| intervals over all keys; estimate has (key, value).

    Only replicates in which every key has a finite value count; with fewer than two, or an
    estimate that is not finite, there are no bounds. With centred, each replicate and the
    estimate are taken as differences from their means over the keys.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    every = W.partitionBy()
    est = estimate.select(key, F.col("value").cast("double").alias("est"))
    est = est.withColumns({"keys": F.count("*").over(every), "known": F.min(finite(F.col("est")).cast("int")).over(every)})
    whole = W.partitionBy("replicate")
    held = values.join(F.broadcast(est), key).withColumns({"has": F.count_if(finite(F.col("value"))).over(whole), "middle": F.avg("value").over(whole)}).where((F.col("has") == F.col("keys")) & (F.col("known") == 1))
    if centred:
        held = held.withColumn("value", F.col("value") - F.col("middle"))
        est = est.withColumn("est", F.col("est") - F.avg("est").over(every))
        held = held.drop("est").join(F.broadcast(est.select(key, "est")), key)
    se = held.groupBy(key).agg(F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("se"), F.count("*").alias("n_valid")).where("n_valid >= 2")
    t = F.when(F.col("se") > 1e-15, F.abs(F.col("value") - F.col("est")) / F.col("se")).otherwise(0.0)
    cut = held.join(F.broadcast(se), key).groupBy("replicate").agg(F.max(t).alias("t")).agg(F.percentile("t", F.lit(0.95)).alias("cut"))
    found = est.join(se, key, "left").join(F.broadcast(cut))
    return found.select(key, (F.col("est") - F.col("cut") * F.col("se")).alias("low"), (F.col("est") + F.col("cut") * F.col("se")).alias("high"), F.coalesce("n_valid", F.lit(0)).alias("n_valid"))
