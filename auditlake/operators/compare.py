"""Comparisons of variants: rank correlation, recovery, effects, tests over policies, verdicts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..shared import saved


def average_rank(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """rows with the average rank of a value among its keys; equal values share theirs."""
    low = F.rank().over(W.partitionBy(*keys).orderBy(value))
    ties = F.count("*").over(W.partitionBy(*keys, value))
    return rows.withColumn(name, low + (ties - 1) / 2.0)


def spearman(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rank correlation of two columns; pairs has a row a policy."""
    ranked = average_rank(average_rank(pairs.withColumn("_k", F.lit(1)), ["_k"], a, "_a"), ["_k"], b, "_b")
    return ranked.agg(F.corr("_a", "_b").alias("spearman"))


def recovery(raw: DataFrame, scaled: DataFrame, value: str, base: str) -> DataFrame:
    """variant, policy, recovery and gain.

    recovery: how much nearer the scaled variant is to the scaled base than raw to raw; gain:
    how much the scaled value itself lies below the raw one.
    """
    part = W.partitionBy("policy")
    both = raw.select("variant", "policy", F.col(value).alias("r")).join(scaled.select("variant", "policy", F.col(value).alias("s")), ["variant", "policy"])
    base_of = lambda c: F.max(F.when(F.col("variant") == base, F.col(c))).over(part)
    each = both.withColumns({"rb": base_of("r"), "sb": base_of("s")}).where((F.col("variant") != base) & F.col("rb").isNotNull())
    return each.select("variant", "policy", (F.abs(F.col("r") - F.col("rb")) - F.abs(F.col("s") - F.col("sb"))).alias("recovery"), (F.col("r") - F.col("s")).alias("gain"))


def within_slope(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Slope with a fixed effect per group, R2, and the R2 over points held out one at a time beyond the group means.

    Every sum of a held-out point is a total less its own part: leaving a point out moves its
    group's mean, which takes n / (n - 1) of its centred products away.
    """
    part, every = W.partitionBy(group), W.partitionBy()
    centred = points.select(F.count("*").over(part).alias("n"), (F.col(x) - F.avg(x).over(part)).alias("dx"), (F.col(y) - F.avg(y).over(part)).alias("dy"))
    dx, dy, n = F.col("dx"), F.col("dy"), F.col("n")
    sums = centred.withColumns({"sxy": F.sum(dx * dy).over(every), "sxx": F.sum(dx * dx).over(every)})
    more = n / (n - 1)
    slope = (F.col("sxy") - more * dx * dy) / (F.col("sxx") - more * dx * dx)
    left = F.when(n > 1, F.pow(more * (dy - slope * dx), F.lit(2)))
    alone = F.when(n > 1, F.pow(more * dy, F.lit(2)))
    r2 = F.pow(F.sum(dx * dy), F.lit(2)) / (F.sum(dx * dx) * F.sum(dy * dy))
    return sums.agg((F.sum(dx * dy) / F.sum(dx * dx)).alias("slope"), r2.alias("within_r2"), (1 - F.sum(left) / F.sum(alone)).alias("held_out_r2"))


def weighted_mismatch(cells: DataFrame, keys: list[str], wrong: Column, weight: Column) -> DataFrame:
    """Hajek mismatch rate for every subset of keys."""
    return cells.cube(*keys).agg((F.sum(F.when(wrong, weight).otherwise(0.0)) / F.sum(weight)).alias("mismatch"), F.count("*").alias("n"))


def mismatch_effect(cells: DataFrame, domain: str, low: str, high: str, keys: list[str], wrong: Column, weight: Column) -> DataFrame:
    """keys: weighted mismatch of two domains, their difference, and the difference less its mean over all keys."""
    rate = lambda d: F.sum(F.when((F.col(domain) == d) & wrong, weight).when(F.col(domain) == d, 0.0)) / F.sum(F.when(F.col(domain) == d, weight))
    both = cells.groupBy(*keys).agg(rate(low).alias("low"), rate(high).alias("high")).withColumn("difference", F.col("high") - F.col("low"))
    return both.withColumn("centred", F.col("difference") - F.avg("difference").over(W.partitionBy()))


def missing_by_position(cells: DataFrame, position: str, policy: str, missing: Column) -> DataFrame:
    """Missing cells by displayed position, by policy, by both, and in all."""
    flagged = cells.withColumn("_m", missing.cast("int"))
    return flagged.cube(position, policy).agg(F.sum("_m").alias("n_missing"), F.count("*").alias("n"))


def allocate(rows: DataFrame, strata: list[tuple[str, Column, int]], unit: str, order: Column) -> DataFrame:
    """Fill strata in a fixed order, each from units not used before, first by the order.

    The loop is over the strata, about ten; a unit is used once.
    """
    out = None
    for name, belongs, quota in strata:
        free = rows.where(belongs)
        if out is not None:
            free = free.join(out.select(unit), unit, "left_anti")
        one = free.groupBy(unit).agg(F.min(order).alias("_o"))
        picked = one.orderBy("_o").limit(quota).select(unit, "_o", F.lit(name).alias("stratum"))
        out = picked if out is None else out.unionByName(picked)
    return out.withColumn("place", F.row_number().over(W.partitionBy("stratum").orderBy("_o"))).drop("_o")


def helmert(k: int) -> np.ndarray:
    """k - 1 orthonormal contrasts."""
    m = np.zeros((k - 1, k))
    for i in range(1, k):
        m[i - 1, :i], m[i - 1, i] = 1, -i
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def omnibus(values: DataFrame, estimate: DataFrame, key: str, rcond: float = 1e-12) -> DataFrame:
    """One row: evaluable, reason, rank, n_valid, statistic, p of the test that all keys share one effect.

    The statistic is the quadratic form of the estimate's contrasts in the inverse of their covariance
    over replicates; p counts the replicates, recentred at the estimate, that reach it. If the
    contrasts' covariance has not full rank, or an estimate is missing, the test is not evaluable and both are null.
    Replicates that lack a key do not count. Spark sums the covariances, keys by keys, and the forms of all
    replicates in one aggregate each; the inverse of that small matrix is the driver's.
    """
    spark = values.sparkSession
    est = {r[key]: r["value"] for r in estimate.select(key, "value").collect()}  # a row a key
    names = sorted(est)
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    whole = values.where(finite & F.col(key).isin(names)).groupBy("replicate").agg(F.array_sort(F.collect_list(F.struct(key, "value"))).alias("x"))
    whole = saved(whole.where(F.size("x") == len(names)).select("replicate", F.transform("x", lambda v: v["value"]).alias("v")))
    schema = "evaluable boolean, reason string, rank int, n_valid long, statistic double, p double"
    n = whole.count()
    if len(names) < 2 or n < 2 or any(v is None or not np.isfinite(v) for v in est.values()):
        return spark.createDataFrame([(False, "no estimate of every key or too few replicates", None, n, None, None)], schema)
    h = helmert(len(names))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = whole.agg(*[F.covar_samp(F.col("v")[i], F.col("v")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(names), len(names)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = sums[f"c{i}_{j}"]
    inner = h @ cov @ h.T
    singular = np.linalg.svd(inner, compute_uv=False)
    rank = int((singular > singular[0] * rcond).sum())
    if rank < len(names) - 1:
        return spark.createDataFrame([(False, f"covariance of the contrasts has rank {rank} of {len(names) - 1}", rank, n, None, None)], schema)
    form = h.T @ np.linalg.inv(inner) @ h
    e = np.array([est[k] for k in names])
    stat = float(e @ form @ e)
    away = [F.col("v")[i] - float(e[i]) for i in range(len(names))]
    reached = sum((away[i] * away[j] * float(form[i, j] * (1 if i == j else 2)) for i, j in pairs), F.lit(0.0))
    above = whole.agg(F.count_if(reached >= stat)).first()[0]
    return spark.createDataFrame([(True, None, rank, n, stat, (1 + above) / (1 + n))], schema)


def shrink(fits: DataFrame, pooled: float, low: float = 0.05, high: float = 20.0) -> DataFrame:
    """policy, log_t shrunk to the pooled fit's log T by between-policy variance and clipped; fits: (policy, log_t, variance)."""
    every = W.partitionBy()
    between = F.greatest(F.lit(0.0), F.var_samp("log_t").over(every) - F.avg("variance").over(every))
    w = F.when(between + F.col("variance") > 0, between / (between + F.col("variance"))).otherwise(0.0)
    log_t = F.lit(pooled) + w * (F.col("log_t") - F.lit(pooled))
    return fits.select("policy", F.least(F.greatest(log_t, F.log(F.lit(low))), F.log(F.lit(high))).alias("log_t"), w.alias("own_weight"))


def verdict(gates: DataFrame, ladder: list[tuple[str, Column]], otherwise: str) -> DataFrame:
    """gates with the label of the first condition that holds."""
    case = F
    for label, condition in ladder:
        case = case.when(condition, label)
    return gates.withColumn("verdict", case.otherwise(otherwise))
