"""Calibration and discrimination metrics of scored cells, by any grouping keys.

Cells without a label are left out. "Not applicable" counts in calibration, NLL and Brier and
is left out of F1, error rates and AUROC. Undefined values are null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import ranks

BINS = 15


def bin_of(score: Column, bins: int = BINS) -> Column:
    """Number of interior edges k / bins that are at most the score."""
    return reduce(lambda a, b: a + b, [(score >= F.lit(k / bins)).cast("int") for k in range(1, bins)])


def bin_by_edges(score: Column, edges: Column) -> Column:
    """Number of interior edges of an array that are at most the score."""
    return F.size(F.filter(F.slice(edges, F.lit(2), F.size(edges) - 2), lambda e: e <= score))


def reliability(cells: DataFrame, keys: list[str], score: str = "conf", hit: str = "correct", bins: int = BINS) -> DataFrame:
    """keys, bin, n, mean_conf, accuracy."""
    labelled = cells.where(F.col(hit).isNotNull())
    return labelled.groupBy(*keys, bin_of(F.col(score), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_conf"), F.avg(hit).alias("accuracy"))


def _gap(table: DataFrame, keys: list[str], name: str = "ece") -> DataFrame:
    """Weighted absolute gap of bins (n, mean_conf, accuracy)."""
    gap = F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_conf"))) / F.sum("n")
    return table.groupBy(*keys).agg(gap.alias(name))


def ece(cells: DataFrame, keys: list[str], score: str = "conf", hit: str = "correct", bins: int = BINS) -> DataFrame:
    """Equal-width calibration error."""
    return _gap(reliability(cells, keys, score, hit, bins), keys)


def weighted_ece(cells: DataFrame, keys: list[str], edges: DataFrame, edge_keys: list[str], weight: str | None = None) -> DataFrame:
    """Calibration error over given edges (edge_keys, edges), optionally weighted."""
    w = F.col(weight) if weight else F.lit(1.0)
    placed = cells.where(F.col("correct").isNotNull()).join(F.broadcast(edges), edge_keys).withColumn("bin", bin_by_edges(F.col("conf"), F.col("edges")))
    table = placed.groupBy(*keys, "bin").agg(F.sum(w).alias("n"), (F.sum(w * F.col("conf")) / F.sum(w)).alias("mean_conf"), (F.sum(w * F.col("correct")) / F.sum(w)).alias("accuracy"))
    return _gap(table, keys)


def quantile_edges(cells: DataFrame, keys: list[str], tie: str = "doc_id", bins: int = BINS) -> DataFrame:
    """keys, edges: exact linear quantiles of the confidence, with ends 0 and 1."""
    found = ranks.quantiles(cells.where(F.col("correct").isNotNull()), keys, "conf", tie, [k / bins for k in range(1, bins)])
    return found.select(*keys, F.concat(F.array(F.lit(0.0)), "values", F.array(F.lit(1.0))).alias("edges"))


def adaptive_ece(cells: DataFrame, keys: list[str], tie: str, bins: int = BINS) -> DataFrame:
    """Equal-count calibration error; equal confidences are ordered by tie."""
    placed = ranks.ntile(cells.where(F.col("correct").isNotNull()).select(*keys, "conf", "correct", tie), keys, "conf", tie, bins, "bin")
    table = placed.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("conf").alias("mean_conf"), F.avg("correct").alias("accuracy"))
    return _gap(table, keys)


def classwise_ece(cells: DataFrame, keys: list[str], bins: int = BINS) -> DataFrame:
    """keys, class, ece of each class's probability against its indicator."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), F.col(f"p{k}").alias("score"), (F.col("state_id") == k).cast("int").alias("hit")) for k in range(3)]))
    long = cells.where(F.col("state_id").isNotNull()).withColumn("x", each).select(*keys, "x.class", "x.score", "x.hit")
    return ece(long, [*keys, "class"], "score", "hit", bins)


def violated_ece(cells: DataFrame, keys: list[str], bins: int = BINS) -> DataFrame:
    """keys, violated_ece (binary, among applicable cells) and macro_ece (mean over the three classes)."""
    binary = cells.where("state_id IN (0, 1)").withColumn("hit", (F.col("state_id") == 1).cast("int"))
    macro = classwise_ece(cells, keys, bins).groupBy(*keys).agg(F.avg("ece").alias("macro_ece"))
    return ece(binary, keys, "p1", "hit", bins).withColumnRenamed("ece", "violated_ece").join(macro, keys)


def confusion(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.where(F.col("state_id").isNotNull()).groupBy(*keys, "state_id", "pred").agg(F.count("*").alias("n"))


def rates(cells: DataFrame, keys: list[str]) -> DataFrame:
    """n_violated, n_satisfied, f1, fn_rate, fp_rate with "violated" as the positive class."""
    of = lambda c: F.sum(F.when(c, 1).otherwise(0))
    y, p = F.col("state_id"), F.col("pred")
    sums = cells.where("state_id IN (0, 1)").groupBy(*keys).agg(of((y == 1) & (p == 1)).alias("tp"), of((y == 0) & (p == 1)).alias("fp"), of((y == 1) & (p != 1)).alias("fn"), of(y == 1).alias("n_violated"), of(y == 0).alias("n_satisfied"))
    both = (F.col("n_violated") > 0) & (F.col("n_satisfied") > 0)
    down = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.when(both, F.when(down == 0, 0.0).otherwise(2 * F.col("tp") / down))
    return sums.select(*keys, "n_violated", "n_satisfied", f1.alias("f1"), F.when(F.col("n_violated") > 0, F.col("fn") / F.col("n_violated")).alias("fn_rate"), F.when(F.col("n_satisfied") > 0, F.col("fp") / F.col("n_satisfied")).alias("fp_rate"))


def auroc(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the curve of p1 among applicable cells; distinct scores are counted before ranking."""
    y = F.col("state_id")
    counted = cells.where("state_id IN (0, 1)").groupBy(*keys, "p1").agg(F.sum(F.when(y == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(y == 0, 1).otherwise(0)).alias("neg"))
    counted = ranks.running(counted, keys, "p1", "neg")
    area = counted.withColumn("won", F.col("pos") * (F.col("below") + F.col("neg") / 2)).groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return area.select(*keys, F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("won") / (F.col("pos") * F.col("neg"))).alias("auroc"))


def nll_brier(cells: DataFrame, keys: list[str], eps: float = 1e-12) -> DataFrame:
    y = F.col("state_id")
    own = F.when(y == 0, F.col("p0")).when(y == 1, F.col("p1")).otherwise(F.col("p2"))
    square = reduce(lambda a, b: a + b, [F.pow(F.col(f"p{k}") - (y == k).cast("int"), 2) for k in range(3)])
    return cells.where(y.isNotNull()).groupBy(*keys).agg(F.avg(-F.log(F.greatest(own, F.lit(eps)))).alias("nll"), F.avg(square).alias("brier"))


def class_overlap(cells: DataFrame, keys: list[str], base: str, other: str) -> DataFrame:
    """keys, score (p0..p2 and conf), overlap of the histograms of each."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).alias("conf")) for c in ("p0", "p1", "p2", "conf")]))
    long = cells.select(*keys, "variant", each.alias("x")).select(*keys, "variant", "x.*")
    return histogram_overlap(long, [*keys, "score"], base, other)


def histogram_overlap(cells: DataFrame, keys: list[str], base: str, other: str, bins: int = 50) -> DataFrame:
    """Shared mass of the confidence histograms of two variants."""
    counted = cells.where(F.col("variant").isin(base, other)).groupBy(*keys, "variant", F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    share = counted.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*keys, "variant")))
    wide = share.groupBy(*keys, "bin").agg(*[F.coalesce(F.sum(F.when(F.col("variant") == v, F.col("share"))), F.lit(0.0)).alias(s) for v, s in ((base, "a"), (other, "b"))])
    return wide.groupBy(*keys).agg(F.sum(F.least("a", "b")).alias("overlap"))


def standardized_ece(cells: DataFrame, base: str, bins: int = BINS) -> DataFrame:
    """variant, policy, ece under the base variant's class shares, and the effective sample size."""
    return reweighted_ece(cells, None, base, bins).select("variant", "policy", "ece", "ess")


def reweighted_ece(cells: DataFrame, source: str | None, target: str, bins: int = BINS) -> DataFrame:
    """variant, policy, ece, ess: the source variant (all if None) under the target variant's class shares.

    A class of the target that the source does not have cannot be weighted, so both are null there.
    """
    labelled = cells.where(F.col("state_id").isNotNull())
    share = labelled.groupBy("variant", "policy", "state_id").agg(F.count("*").alias("n"))
    share = share.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("variant", "policy"))).drop("n")
    of = lambda v: share.where(F.col("variant") == v) if v else share
    wanted = of(target).select("policy", "state_id", F.col("share").alias("target"))
    held = of(source).groupBy("variant", "policy").agg(F.collect_set("state_id").alias("held"))
    needed = of(target).groupBy("policy").agg(F.collect_set("state_id").alias("needed"))
    whole = held.join(needed, "policy").select("variant", "policy", (F.size(F.array_except("needed", "held")) == 0).alias("whole"))
    weight = of(source).join(wanted, ["policy", "state_id"], "left").select("variant", "policy", "state_id", (F.coalesce("target", F.lit(0.0)) / F.col("share")).alias("w"))
    placed = labelled.join(F.broadcast(weight), ["variant", "policy", "state_id"]).withColumn("bin", bin_of(F.col("conf"), bins))
    table = placed.groupBy("variant", "policy", "bin").agg(F.sum("w").alias("n"), F.sum(F.pow("w", F.lit(2))).alias("n2"), F.sum(F.col("w") * (F.col("correct") - F.col("conf"))).alias("gap"))
    found = table.groupBy("variant", "policy").agg((F.sum(F.abs("gap")) / F.sum("n")).alias("ece"), (F.pow(F.sum("n"), F.lit(2)) / F.sum("n2")).alias("ess"))
    only = lambda c: F.when(F.col("whole"), F.col(c)).alias(c)
    return found.join(whole, ["variant", "policy"]).select("variant", "policy", only("ece"), only("ess"))


def standardized_delta(cells: DataFrame, base: str, other: str) -> DataFrame:
    """policy, forward (other under the base's shares less base) and backward (other less base under the other's shares)."""
    plain = ece(cells, ["variant", "policy"])
    name = lambda t, v, c: t.where(F.col("variant") == v).select("policy", F.col("ece").alias(c))
    forward, backward = name(reweighted_ece(cells, other, base), other, "o"), name(reweighted_ece(cells, base, other), base, "b")
    joined = name(plain, base, "base").join(name(plain, other, "other"), "policy").join(forward, "policy", "left").join(backward, "policy", "left")
    return joined.select("policy", (F.col("o") - F.col("base")).alias("forward"), (F.col("other") - F.col("b")).alias("backward"))


def paired_delta(metric: DataFrame, value: str, base: str) -> DataFrame:
    """variant, policy, delta of a metric against the base variant."""
    return paired_deltas(metric, [value], base).withColumnRenamed(f"delta_{value}", "delta")


def paired_deltas(metric: DataFrame, values: list[str], base: str) -> DataFrame:
    """variant, policy and delta_<value> of each value; the metric is read once."""
    own = F.col("variant") == base
    part = W.partitionBy("policy")
    deltas = [(F.col(v) - F.max(F.when(own, F.col(v))).over(part)).alias(f"delta_{v}") for v in values]
    has = F.max(own.cast("int")).over(part)
    return metric.select("variant", "policy", *deltas, has.alias("_has")).where((F.col("variant") != base) & (F.col("_has") == 1)).drop("_has")


def delta_report(cells: DataFrame, base: str, least: int = 30) -> DataFrame:
    """variant, policy, deltas of ECE, F1, FN and FP rates, whether both have enough violated cells, and delta FN - delta FP."""
    keys = ["variant", "policy"]
    found = ece(cells, keys).join(rates(cells, keys), keys)
    deltas = paired_deltas(found, ["ece", "f1", "fn_rate", "fp_rate"], base)
    enough = found.withColumn("least", F.least("n_violated", F.max(F.when(F.col("variant") == base, F.col("n_violated"))).over(W.partitionBy("policy"))))
    return deltas.join(enough.select(*keys, (F.col("least") >= least).alias("powered")), keys).withColumn("fn_less_fp", F.col("delta_fn_rate") - F.col("delta_fp_rate"))


def delta_report_summary(report: DataFrame) -> DataFrame:
    """variant: mean, RMS and population standard deviation of each delta over powered policies, mean FN - FP and its positives."""
    names = ["ece", "f1", "fn_rate", "fp_rate"]
    each = [f(F.col(f"delta_{c}")).alias(f"{n}_{c}") for c in names for n, f in (("mean", F.avg), ("rms", lambda x: F.sqrt(F.avg(x * x))), ("sd", F.stddev_pop))]
    return report.where("powered").groupBy("variant").agg(*each, F.avg("fn_less_fp").alias("mean_fn_less_fp"), F.count_if(F.col("fn_less_fp") > 0).alias("n_positive"))


def delta_summary(deltas: DataFrame) -> DataFrame:
    """variant, mean, rms and population standard deviation of the deltas over policies."""
    return deltas.groupBy("variant").agg(F.avg("delta").alias("mean_delta"), F.sqrt(F.avg(F.col("delta") * F.col("delta"))).alias("rms_delta"), F.stddev_pop("delta").alias("sd_delta"), F.sum((F.col("delta") > 0).cast("int")).alias("n_positive"))


def kappa(cells: DataFrame, keys: list[str], a: str, b: str, weight: Column | None = None) -> DataFrame:
    """Exact agreement and Cohen's kappa of two labels, optionally weighted."""
    w = F.lit(1) if weight is None else weight
    counted = cells.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, a, b).agg(F.sum(w).alias("n"))
    # the counts of a group are at most labels x labels
    margins = counted.groupBy(*keys).agg(F.collect_list(F.struct(F.col(a).alias("a"), F.col(b).alias("b"), "n")).alias("x"))
    total = lambda f: F.aggregate("x", F.lit(0.0), lambda acc, x: acc + F.when(f(x), x["n"]).otherwise(0))
    labels = F.array_distinct(F.transform("x", lambda x: x["a"]))
    chance = F.aggregate(labels, F.lit(0.0), lambda acc, k: acc + total(lambda x: x["a"] == k) * total(lambda x: x["b"] == k))
    out = margins.select(*keys, total(lambda x: x["a"] == x["b"]).alias("same"), total(lambda x: F.lit(True)).alias("total"), chance.alias("chance"))
    po, pe = F.col("same") / F.col("total"), F.col("chance") / (F.col("total") * F.col("total"))
    return out.select(*keys, po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def divergences(tokens: DataFrame, keys: list[str], log_ratios: str) -> DataFrame:
    """KL, chi-square, reverse KL and total variation from arrays of token log-ratios, without exploding."""
    total = lambda f: F.sum(F.aggregate(log_ratios, F.lit(0.0), lambda acc, x: acc + f(x)))
    n = F.sum(F.size(log_ratios))
    return tokens.groupBy(*keys).agg((total(lambda x: x) / n).alias("kl"), (total(lambda x: F.exp(x)) / n - 1).alias("chi2"), (total(lambda x: -x * F.exp(-x)) / n).alias("reverse_kl"), (total(lambda x: F.abs(F.exp(-x) - 1)) / n / 2).alias("tv"))


def divergence_checks(tokens: DataFrame, items: DataFrame, key: str, log_ratios: str, total: str, tolerance: float = 1e-6) -> DataFrame:
    """Violations (key, reason): token sums that do not reproduce the item records, and values that are not finite."""
    summed = tokens.select(F.col(key), F.aggregate(log_ratios, F.lit(0.0), lambda a, x: a + x).alias("_s"), F.exists(log_ratios, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).alias("_bad"))
    both = summed.join(items.select(F.col(key), F.col(total).alias("_t")), key, "full_outer")
    reason = F.when(F.col("_s").isNull(), "no tokens").when(F.col("_t").isNull(), "no item").when(F.col("_bad"), "not finite").when(F.abs(F.col("_s") - F.col("_t")) > tolerance, "differs")
    return both.select(key, reason.alias("reason")).where("reason IS NOT NULL")


def macro_f1(cells: DataFrame) -> DataFrame:
    """variant, mean F1 over policies and its coefficient of variation."""
    return rates(cells, ["variant", "policy"]).groupBy("variant").agg(F.avg("f1").alias("mean_f1"), (F.stddev_pop("f1") / F.avg("f1")).alias("cv_f1"))


def severity_fn(cells: DataFrame, weight: Column) -> DataFrame:
    """variant, weighted mean of the policies' FN rates; weight is a column over policy."""
    r = rates(cells, ["variant", "policy"]).where("fn_rate IS NOT NULL")
    return r.groupBy("variant").agg((F.sum(weight * F.col("fn_rate")) / F.sum(weight)).alias("severity_fn_rate"))


def item_kl(items: DataFrame, total: str, tokens: str) -> DataFrame:
    """One row: token-weighted KL, mean item ratio and the share of items below zero."""
    per = F.col(total) / F.col(tokens)
    return items.agg((F.sum(total) / F.sum(tokens)).alias("kl"), F.avg(per).alias("mean_item"), F.avg((F.round(total, 9) < 0).cast("double")).alias("negative_share"))


def scorer_audit(cells: DataFrame, scorer: str, category: str, label: str, score: str, tie: str, bins: int = BINS) -> DataFrame:
    """scorer, category, ece and signed deviation of equal-count bins under 50:50 class weights.

    label is 0 or 1; each class of a category weighs one half in all.
    """
    keys = [scorer, category]
    scored = ranks.ntile(cells.where(F.col(label).isNotNull()).select(*keys, label, score, tie), keys, score, tie, bins, "bin")
    y = F.col(label)
    sums = scored.groupBy(*keys, "bin").agg(*[f.alias(n) for n, f in (("n1", F.sum(y)), ("n0", F.sum(1 - y)), ("s1", F.sum(y * F.col(score))), ("s0", F.sum((1 - y) * F.col(score))))])
    part = W.partitionBy(*keys)
    w1, w0 = (F.lit(0.5) / F.sum(n).over(part) for n in ("n1", "n0"))
    gap = sums.withColumns({"w1": w1, "w0": w0}).withColumn("gap", F.col("w1") * F.col("n1") - F.col("w1") * F.col("s1") - F.col("w0") * F.col("s0"))
    return gap.groupBy(*keys).agg(F.sum(F.abs("gap")).alias("ece"), (-F.sum("gap")).alias("signed"))


def scorer_summary(audit: DataFrame, scorer: str, category: str) -> DataFrame:
    """scorer: mean m, worst w, spread h, cancellation c, the worst category, and whether it is best by mean and by worst."""
    e = F.col("ece")
    each = audit.groupBy(scorer).agg(F.avg(e).alias("m"), F.max(e).alias("w"), F.stddev_pop(e).alias("h"), (1 - F.abs(F.avg("signed")) / F.avg(F.abs("signed"))).alias("c"), F.max_by(category, F.struct(F.round(e, 9), category)).alias("worst_category"))
    first = lambda c: F.row_number().over(W.orderBy(F.round(c, 9), scorer)) == 1
    return each.withColumns({"best_by_mean": first("m"), "best_by_worst": first("w")})


def label_source_delta(audit_a: DataFrame, audit_b: DataFrame, scorer: str, category: str, group: Column) -> DataFrame:
    """scorer, category group: mean absolute change of the calibration error between two label sources."""
    both = audit_a.select(scorer, category, F.col("ece").alias("a")).join(audit_b.select(scorer, category, F.col("ece").alias("b")), [scorer, category])
    return both.groupBy(scorer, group.alias("category_group")).agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs_delta"), F.count("*").alias("n"))
