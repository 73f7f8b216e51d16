"""Calibration and discrimination metrics over the derived score cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..functions.text import digest, hex_int
from ..operators import metrics as M

KEYS = ["variant", "policy"]
PRE = fixtures.SQL
#: Bin of a score: the number of interior edges k / 15 that are at most it.
BIN = "len(list_filter([k / 15.0::DOUBLE FOR k IN range(1, 15)], lambda e: e <= {0}))"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.scored_cells(fixtures.table(spark, sf_dir, "documents"))


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, for comparison with another engine."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _on_cells(f):
    return lambda spark, sf_dir: rounded(f(cells(spark, sf_dir)))


def paired_delta_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.paired_delta(M.ece(cells(spark, sf_dir), KEYS), "ece", "D0"))


def _fixed_edges(c: DataFrame) -> DataFrame:
    base = c.where("variant = 'D0'")
    edges = M.quantile_edges(base, ["policy"])
    return M.weighted_ece(c.withColumn("w", 1 + F.col("doc_id") % 3), KEYS, edges, ["policy"], "w")


def _kappa(c: DataFrame) -> DataFrame:
    d = lambda salt: hex_int(digest(salt, F.col("doc_id"), F.col("policy")), 1, 2)
    two = c.where("variant = 'D0'").withColumns({"a": F.when(d("ann1") < 32, (F.col("state_id") + 1) % 3).otherwise(F.col("state_id")), "b": F.when(d("ann2") < 48, (F.col("state_id") + 2) % 3).otherwise(F.col("state_id"))})
    return M.kappa(two, ["policy"], "a", "b")


def _severity(c: DataFrame) -> DataFrame:
    return M.severity_fn(c, F.when(F.substring("policy", 1, 1) == "H", 3.0).when(F.substring("policy", 1, 1) == "S", 2.0).otherwise(1.0))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fixtures.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_discount"))).alias("x"))
    return lines.select("l_orderkey", F.transform("x", lambda v: (v["l_discount"].cast("double") - 0.05) * 4).alias("log_ratios"))


def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.divergences(tokens(spark, sf_dir).withColumn("all", F.lit("all")), ["all"], "log_ratios"))


def kl_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens(spark, sf_dir).select(F.size("log_ratios").alias("n"), F.aggregate("log_ratios", F.lit(0.0), lambda a, x: a + x).alias("s"))
    return rounded(M.item_kl(t, "s", "n"))


def _scorers(c: DataFrame) -> DataFrame:
    """Scores of applicable cells, to twelve decimals so that ranks do not hang on an engine's last bit."""
    return c.where("state_id IN (0, 1)").withColumns({"p1": F.round("p1", 12), "y": (F.col("state_id") == 1).cast("int")})


def _guard(c: DataFrame) -> DataFrame:
    return M.scorer_summary(M.scorer_audit(_scorers(c), "variant", "policy", "y", "p1", "doc_id"), "variant", "policy")


def _sources(c: DataFrame) -> DataFrame:
    """The same scores against two label sources: the cells' states, and those of a second reviewer."""
    one = _scorers(c)
    two = one.withColumn("y", F.when(hex_int(digest("src2", F.col("doc_id"), F.col("policy")), 1, 2) < 32, 1 - F.col("y")).otherwise(F.col("y")))
    audits = [M.scorer_audit(x, "variant", "policy", "y", "p1", "doc_id") for x in (one, two)]
    return M.label_source_delta(*audits, "variant", "policy", F.substring("policy", 1, 1))


def _ece_sql(inner: str, keys: str) -> str:
    return f"""SELECT {keys}, round(sum(n * abs(acc - mc)) / sum(n), 6) AS ece FROM ({inner}) GROUP BY {keys}"""


_BINNED = f"SELECT variant, policy, {BIN.format('conf')} AS bin, count(*) AS n, avg(conf) AS mc, avg(correct) AS acc FROM scored WHERE correct IS NOT NULL GROUP BY ALL"
_ECE = f"SELECT variant, policy, sum(n * abs(acc - mc)) / sum(n) AS ece FROM ({_BINNED}) GROUP BY ALL"
_RATES = """SELECT variant, policy, count(*) FILTER (state_id = 1) AS n_violated, count(*) FILTER (state_id = 0) AS n_satisfied,
 count(*) FILTER (state_id = 1 AND pred = 1) AS tp, count(*) FILTER (state_id = 0 AND pred = 1) AS fp, count(*) FILTER (state_id = 1 AND pred <> 1) AS fn
 FROM scored WHERE state_id IN (0, 1) GROUP BY ALL"""
_F1 = "CASE WHEN n_violated > 0 AND n_satisfied > 0 THEN CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END END"
#: Equal-count bins under 50:50 weights against one of two label sources.
_SCORERS = ", y_{0} AS (SELECT variant, policy, doc_id, round(p1, 12) AS p1, CASE WHEN '{0}' = 'two' AND ('0x' || substr(sha256(concat_ws(':', 'src2', doc_id::VARCHAR, policy)), 1, 2))::BIGINT < 32 THEN 1 - (state_id = 1)::INTEGER ELSE (state_id = 1)::INTEGER END AS y FROM scored WHERE state_id IN (0, 1)), n_{0} AS (SELECT *, ntile(15) OVER (PARTITION BY variant, policy ORDER BY p1, doc_id) AS bin, 0.5 / sum(y) OVER (PARTITION BY variant, policy) AS w1, 0.5 / sum(1 - y) OVER (PARTITION BY variant, policy) AS w0 FROM y_{0}), g_{0} AS (SELECT variant, policy, bin, sum(CASE WHEN y = 1 THEN w1 * (1 - p1) ELSE -w0 * p1 END) AS g FROM n_{0} GROUP BY ALL), e_{0} AS (SELECT variant, policy, sum(abs(g)) AS ece, -sum(g) AS signed FROM g_{0} GROUP BY ALL) "
_TOKENS = "SELECT l_orderkey, (l_discount::DOUBLE - 0.05) * 4 AS x FROM lineitem"

QUERIES = {
    "scored_cells": (lambda s, d: rounded(cells(s, d).select("doc_id", "variant", "policy", "state_id", "conf", "pred", "correct").where("state_id IS NOT NULL")), PRE + "SELECT doc_id, variant, policy, state_id, round(conf, 6) AS conf, pred, correct FROM scored WHERE state_id IS NOT NULL"),
    "reliability_table": (_on_cells(lambda c: M.reliability(c, KEYS)), PRE + f"SELECT variant, policy, bin::INTEGER AS bin, n, round(mc, 6) AS mean_conf, round(acc, 6) AS accuracy FROM ({_BINNED})"),
    "ece": (_on_cells(lambda c: M.ece(c, KEYS)), PRE + _ece_sql(_BINNED, "variant, policy")),
    "paired_delta_ece": (paired_delta_ece, PRE + f"SELECT a.variant, a.policy, round(a.ece - b.ece, 6) AS delta FROM ({_ECE}) a JOIN ({_ECE}) b ON a.policy = b.policy AND b.variant = 'D0' AND a.variant <> 'D0'"),
    "delta_summary": (_on_cells(lambda c: M.delta_summary(M.paired_delta(M.ece(c, KEYS), "ece", "D0"))), PRE + f"SELECT variant, round(avg(x), 6) AS mean_delta, round(sqrt(avg(x * x)), 6) AS rms_delta, round(stddev_pop(x), 6) AS sd_delta, count(*) FILTER (x > 0) AS n_positive FROM (SELECT a.variant, a.ece - b.ece AS x FROM ({_ECE}) a JOIN ({_ECE}) b ON a.policy = b.policy AND b.variant = 'D0' AND a.variant <> 'D0') GROUP BY variant"),
    "quantile_edges": (lambda s, d: rounded(M.quantile_edges(cells(s, d), KEYS).select(*KEYS, F.posexplode("edges").alias("k", "edge"))), PRE + "SELECT variant, policy, (k - 1)::INTEGER AS k, round(e[k], 6) AS edge FROM (SELECT variant, policy, list_concat(list_concat([0.0::DOUBLE], quantile_cont(conf, [k / 15.0::DOUBLE FOR k IN range(1, 15)])), [1.0::DOUBLE]) AS e FROM scored WHERE correct IS NOT NULL GROUP BY ALL), (SELECT unnest(range(1, 17)) AS k)"),
    "fixed_edge_weighted_ece": (_on_cells(_fixed_edges), PRE + f", edges AS (SELECT policy, quantile_cont(conf, [k / 15.0::DOUBLE FOR k IN range(1, 15)]) AS e FROM scored WHERE correct IS NOT NULL AND variant = 'D0' GROUP BY policy) " + _ece_sql("SELECT variant, s.policy, len(list_filter(e, lambda x: x <= conf)) AS bin, sum(1 + doc_id % 3) AS n, sum((1 + doc_id % 3) * conf) / sum(1 + doc_id % 3) AS mc, sum((1 + doc_id % 3) * correct) / sum(1 + doc_id % 3) AS acc FROM scored s JOIN edges ON s.policy = edges.policy WHERE correct IS NOT NULL GROUP BY ALL", "variant, policy")),
    "adaptive_ece": (_on_cells(lambda c: M.adaptive_ece(c.withColumn("conf", F.round("conf", 12)), KEYS, "doc_id")), PRE + _ece_sql("SELECT variant, policy, bin, count(*) AS n, avg(conf) AS mc, avg(correct) AS acc FROM (SELECT variant, policy, conf, correct, ntile(15) OVER (PARTITION BY variant, policy ORDER BY round(conf, 12), doc_id) AS bin FROM scored WHERE correct IS NOT NULL) GROUP BY ALL", "variant, policy")),
    "classwise_ece": (_on_cells(lambda c: M.classwise_ece(c, KEYS)), PRE + _ece_sql(f"SELECT variant, policy, class, {BIN.format('score')} AS bin, count(*) AS n, avg(score) AS mc, avg(hit) AS acc FROM (SELECT variant, policy, k AS class, [p0, p1, p2][k + 1] AS score, (state_id = k)::INTEGER AS hit FROM scored, (SELECT unnest([0, 1, 2]) AS k) WHERE state_id IS NOT NULL) GROUP BY ALL", "variant, policy, class")),
    "confusion_matrix": (_on_cells(lambda c: M.confusion(c, KEYS)), PRE + "SELECT variant, policy, state_id, pred, count(*) AS n FROM scored WHERE state_id IS NOT NULL GROUP BY ALL"),
    "error_rates": (_on_cells(lambda c: M.rates(c, KEYS)), PRE + f"SELECT variant, policy, n_violated, n_satisfied, round({_F1}, 6) AS f1, round(fn / n_violated, 6) AS fn_rate, round(fp / n_satisfied, 6) AS fp_rate FROM ({_RATES})"),
    "macro_f1": (_on_cells(M.macro_f1), PRE + f"SELECT variant, round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1) / avg(f1), 6) AS cv_f1 FROM (SELECT variant, {_F1} AS f1 FROM ({_RATES})) GROUP BY variant"),
    "severity_weighted_fn": (_on_cells(_severity), PRE + f"SELECT variant, round(sum(w * fn / n_violated) / sum(w), 6) AS severity_fn_rate FROM (SELECT *, CASE substr(policy, 1, 1) WHEN 'H' THEN 3.0 WHEN 'S' THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM ({_RATES})) WHERE n_violated > 0 GROUP BY variant"),
    "auroc": (_on_cells(lambda c: M.auroc(c.withColumn("p1", F.round("p1", 12)), KEYS)), PRE + "SELECT variant, policy, round((sum(r) FILTER (state_id = 1) - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auroc FROM (SELECT variant, policy, state_id, rank() OVER w + (count(*) OVER (PARTITION BY variant, policy, round(p1, 12)) - 1) / 2.0::DOUBLE AS r, count(*) FILTER (state_id = 1) OVER (PARTITION BY variant, policy) AS n1, count(*) FILTER (state_id = 0) OVER (PARTITION BY variant, policy) AS n0 FROM scored WHERE state_id IN (0, 1) WINDOW w AS (PARTITION BY variant, policy ORDER BY round(p1, 12))) GROUP BY variant, policy, n1, n0"),
    "nll_brier": (_on_cells(lambda c: M.nll_brier(c, KEYS)), PRE + "SELECT variant, policy, round(avg(-ln(greatest([p0, p1, p2][state_id + 1], 1e-12))), 6) AS nll, round(avg((p0 - (state_id = 0)::INTEGER)**2 + (p1 - (state_id = 1)::INTEGER)**2 + (p2 - (state_id = 2)::INTEGER)**2), 6) AS brier FROM scored WHERE state_id IS NOT NULL GROUP BY ALL"),
    "histogram_overlap": (_on_cells(lambda c: M.histogram_overlap(c, ["policy"], "D0", "D5")), PRE + ", h AS (SELECT policy, variant, least(floor(conf * 50), 49) AS bin, count(*) AS n FROM scored WHERE variant IN ('D0', 'D5') GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY policy, variant) AS share FROM h) SELECT policy, round(sum(least(a, b)), 6) AS overlap FROM (SELECT policy, bin, coalesce(sum(share) FILTER (variant = 'D0'), 0) AS a, coalesce(sum(share) FILTER (variant = 'D5'), 0) AS b FROM s GROUP BY ALL) GROUP BY policy"),
    "standardized_ece": (_on_cells(lambda c: M.standardized_ece(c, "D0")), PRE + f", cn AS (SELECT variant, policy, state_id, count(*) AS n FROM scored WHERE state_id IS NOT NULL GROUP BY ALL), sh AS (SELECT variant, policy, state_id, n / sum(n) OVER (PARTITION BY variant, policy) AS share FROM cn), w AS (SELECT a.variant, a.policy, a.state_id, b.share / a.share AS w FROM sh a JOIN sh b ON b.variant = 'D0' AND a.policy = b.policy AND a.state_id = b.state_id), t AS (SELECT variant, policy, {BIN.format('conf')} AS bin, sum(w) AS n, sum(w * w) AS n2, sum(w * conf) / sum(w) AS mc, sum(w * correct) / sum(w) AS acc FROM scored JOIN w USING (variant, policy, state_id) GROUP BY ALL) SELECT variant, policy, round(sum(n * abs(acc - mc)) / sum(n), 6) AS ece, round(sum(n)**2 / sum(n2), 6) AS ess FROM t GROUP BY ALL"),
    "annotator_kappa": (_on_cells(_kappa), PRE + ", ab AS (SELECT policy, CASE WHEN ('0x' || substr(sha256(concat_ws(':', 'ann1', doc_id::VARCHAR, policy)), 1, 2))::BIGINT < 32 THEN (state_id + 1) % 3 ELSE state_id END AS a, CASE WHEN ('0x' || substr(sha256(concat_ws(':', 'ann2', doc_id::VARCHAR, policy)), 1, 2))::BIGINT < 48 THEN (state_id + 2) % 3 ELSE state_id END AS b FROM scored WHERE variant = 'D0' AND state_id IS NOT NULL), po AS (SELECT policy, avg((a = b)::INTEGER) AS po, count(*) AS n FROM ab GROUP BY policy), r AS (SELECT policy, a AS k, count(*) AS r FROM ab GROUP BY ALL), c AS (SELECT policy, b AS k, count(*) AS c FROM ab GROUP BY ALL), pe AS (SELECT policy, sum(r * c) AS rc FROM r JOIN c USING (policy, k) GROUP BY policy) SELECT policy, round(po, 6) AS agreement, round((po - rc / (n * n)) / (1 - rc / (n * n)), 6) AS kappa FROM po JOIN pe USING (policy)"),
    "token_divergences": (divergence, f"SELECT 'all' AS \"all\", round(avg(x), 6) AS kl, round(avg(exp(x)) - 1, 6) AS chi2, round(avg(-x * exp(-x)), 6) AS reverse_kl, round(avg(abs(exp(-x) - 1)) / 2, 6) AS tv FROM ({_TOKENS})"),
    "kl_items": (kl_items, f"SELECT round(sum(s) / sum(n), 6) AS kl, round(avg(s / n), 6) AS mean_item, round(avg((round(s, 9) < 0)::INTEGER), 6) AS negative_share FROM (SELECT l_orderkey, sum(x) AS s, count(*) AS n FROM ({_TOKENS}) GROUP BY ALL)"),
    "scorer_audit": (_on_cells(lambda c: M.scorer_audit(_scorers(c), "variant", "policy", "y", "p1", "doc_id")), PRE + _SCORERS.format("one") + "SELECT variant, policy, round(ece, 6) AS ece, round(signed, 6) AS signed FROM e_one"),
    "guard_score_audit": (_on_cells(_guard), PRE + _SCORERS.format("one") + "SELECT *, row_number() OVER (ORDER BY m, variant) = 1 AS best_by_mean, row_number() OVER (ORDER BY w, variant) = 1 AS best_by_worst FROM (SELECT variant, round(avg(ece), 6) AS m, round(max(ece), 6) AS w, round(stddev_pop(ece), 6) AS h, round(1 - abs(avg(signed)) / avg(abs(signed)), 6) AS c, arg_max(policy, ece) AS worst_category FROM e_one GROUP BY variant)"),
    "label_source_delta": (_on_cells(_sources), PRE + _SCORERS.format("one") + _SCORERS.format("two") + "SELECT a.variant, substr(a.policy, 1, 1) AS category_group, round(avg(abs(a.ece - b.ece)), 6) AS mean_abs_delta, count(*) AS n FROM e_one a JOIN e_two b USING (variant, policy) GROUP BY ALL"),
}
