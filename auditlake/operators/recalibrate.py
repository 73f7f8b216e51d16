"""Learning curves of temperature fits over budgets and methods. Cells carry logits z0..z2 and state_id."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import argmax, softmax
from ..shared import saved
from . import metrics
from .compare import shrink
from .stats import fit_temperature

LOGITS = ["z0", "z1", "z2"]


def scaled(cells: DataFrame, temperature: str) -> DataFrame:
    """cells with probabilities, confidence and correctness under a temperature column."""
    logits = [F.col(z) for z in LOGITS]
    p = softmax(logits, F.col(temperature))
    placed = cells.withColumns({f"p{k}": v for k, v in enumerate(p)})
    return placed.withColumns({"conf": F.greatest("p0", "p1", "p2"), "correct": (argmax(logits) == F.col("state_id")).cast("int")})


def method_temperatures(source: DataFrame, calib: DataFrame, budgets: list[int]) -> DataFrame:
    """budget, method, policy, temperature.

    raw: 1; source: fitted on the source's cells; global: on all policies of the budget's calib
    cells; policy: on each policy's; shrunk: those drawn to the global fit. calib has a rank;
    a budget is its prefix.
    """
    within = F.explode(F.filter(F.array(*map(F.lit, budgets)), lambda b: b >= F.col("rank")))
    nested = saved(calib.where("state_id IS NOT NULL").select("policy", "state_id", *LOGITS, within.alias("budget")))
    by_policy = saved(fit_temperature(nested, ["budget", "policy"]))
    pooled = saved(fit_temperature(nested, ["budget"])).select("budget", F.col("temperature").alias("pooled"))
    own = fit_temperature(source, ["policy"]).select("policy", F.col("temperature").alias("source"))
    both = by_policy.join(pooled, "budget").join(own, "policy")
    drawn = None
    for budget, at in ((r["budget"], r["pooled"]) for r in pooled.collect()):  # a row a budget
        fits = both.where(F.col("budget") == budget).select("policy", F.log("temperature").alias("log_t"), "variance")
        one = shrink(fits, math.log(at)).select(F.lit(budget).alias("budget"), "policy", F.exp("log_t").alias("shrunk"))
        drawn = one if drawn is None else drawn.unionByName(one)
    wide = both.join(drawn, ["budget", "policy"])
    each = [("raw", F.lit(1.0)), ("source", F.col("source")), ("global", F.col("pooled")), ("policy", F.col("temperature")), ("shrunk", F.col("shrunk"))]
    return wide.select("budget", "policy", F.inline(F.array(*[F.struct(F.lit(n).alias("method"), t.alias("t")) for n, t in each])))


def learning_curve(source: DataFrame, calib: DataFrame, test: DataFrame, budgets: list[int]) -> DataFrame:
    """budget, method, mean ECE and NLL over policies, reduction against raw and recovery against the source fit."""
    temperatures = saved(method_temperatures(source, calib, budgets))
    placed = scaled(test.join(F.broadcast(temperatures), "policy"), "t")
    keys = ["budget", "method", "policy"]
    found = metrics.ece(placed, keys).join(metrics.nll_brier(placed, keys), keys)
    mean = found.groupBy("budget", "method").agg(F.avg("ece").alias("mean_ece"), F.avg("nll").alias("mean_nll"))
    of = lambda m: F.max(F.when(F.col("method") == m, F.col("mean_ece"))).over(W.partitionBy("budget"))
    return mean.withColumns({"reduction": 1 - F.col("mean_ece") / of("raw"), "recovery": of("source") - F.col("mean_ece"), "structure_benefit": of("global") - F.col("mean_ece")})


def smallest_budget(curve: DataFrame, most: float) -> DataFrame:
    """method, budget: the least budget from which on every larger one keeps the mean ECE within most; null if none."""
    later = W.partitionBy("method").orderBy(F.desc("budget")).rowsBetween(W.unboundedPreceding, 0)
    held = curve.withColumn("ok", F.min((F.col("mean_ece") <= most).cast("int")).over(later))
    return held.groupBy("method").agg(F.min(F.when(F.col("ok") == 1, F.col("budget"))).alias("budget"))
