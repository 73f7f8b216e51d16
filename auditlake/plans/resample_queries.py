"""Paired tests, fits and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accumulate as Q
from ..operators import audit as A
from ..operators import bootstrap as B
from ..operators import compare as C
from ..operators import metrics as M
from ..operators import refits as T
from ..operators import stats as S
from .fit_queries import parts
from .metric_queries import _ECE, _TOKENS, PRE, cells, rounded, tokens

#: Replicates of a bootstrap, and of the confirmation's.
R, MANY = 1000, 10_000


def _labels(s, d):
    return cells(s, d).where("variant = 'D0'")


def _points(s, d):
    c = cells(s, d)
    return c.where("state_id IS NOT NULL").groupBy("variant", "policy").agg(F.avg("conf").alias("x"), F.avg("correct").alias("y"))


def _pvalues(s, d):
    chi = A.contingency(cells(s, d).where("variant = 'D0' AND state_id IS NOT NULL"), "state_id", "lang", ["policy"])
    return chi.select("policy", F.round(F.exp(-F.col("chi2") / 12), 12).alias("p"))


def _ratio(s, d):
    c = cells(s, d).where("variant = 'D5' AND correct IS NOT NULL").groupBy("doc_id").agg(F.sum("correct").alias("num"), F.count("*").alias("den"))
    return B.ratio(c.withColumn("all", F.lit("all")), "doc_id", "num", "den", ["all"], "boot", R)


def _boot_ece(s, d):
    return Q.replicated(Q.of_cells(cells(s, d)), "doc_id", ["variant", "policy"], Q.Ece(), "boot", R).drop("metric")


def _delta(s, d):
    return B.delta(_boot_ece(s, d), "D0", "D5", ["policy"])


def _many(s, d):
    """The confirmation's number of replicates."""
    c = Q.of_cells(cells(s, d).where("variant <> 'D5b'"))
    values = Q.replicated(c, "doc_id", ["variant", "policy"], Q.Ece(), "boot", MANY).drop("metric")
    return B.interval(B.delta(values, "D0", "D5", ["policy"]), ["policy"])


def _rates(s, d):
    values = Q.replicated(Q.of_cells(cells(s, d).where("variant = 'D5'")), "doc_id", ["policy"], Q.Rates(), "boot", R)
    return B.interval(values, ["policy", "metric"])


def _kl(s, d):
    """Token-weighted KL of orders as items, a fifth of the replicates."""
    items = tokens(s, d).select("l_orderkey", F.lit("all").alias("all"), F.size("log_ratios").alias("tokens"), F.aggregate("log_ratios", F.lit(0.0), lambda a, x: a + x).alias("total"))
    return B.interval(Q.replicated(items, "l_orderkey", ["all"], Q.WeightedMean("total", "tokens", "kl"), "boot", R // 5), ["all", "metric"])


def _mismatch(s, d):
    c = cells(s, d).where("variant = 'D0' AND lang IN ('en', 'de')").withColumns({"domain": (F.col("lang") == "de").cast("int"), "wrong": (F.col("pred") != F.col("state_id")).cast("int")})
    return B.interval(Q.replicated(Q.of_cells(c, 1.0 / (1 + F.col("doc_id") % 4)), "doc_id", ["policy"], Q.Mismatch(), "boot", R), ["policy", "metric"])


def _standardized(s, d):
    c = Q.of_cells(cells(s, d).where("variant IN ('D0', 'D5')")).withColumn("variant", (F.col("variant") == "D5").cast("int"))
    return B.interval(Q.replicated(c, "doc_id", ["policy"], Q.StandardizedDelta(), "boot", R), ["policy", "metric"])


def _simultaneous(s, d, centred=False):
    est = M.paired_delta(M.ece(cells(s, d), ["variant", "policy"]), "ece", "D0").where("variant = 'D5'").select("policy", F.col("delta").alias("value"))
    return B.simultaneous(_delta(s, d), est, "policy", centred)


def _omnibus(s, d):
    est = M.paired_delta(M.ece(cells(s, d), ["variant", "policy"]), "ece", "D0").where("variant = 'D5'").select("policy", F.col("delta").alias("value"))
    return C.omnibus(_delta(s, d), est, "policy")


def _nll(s, d):
    c = cells(s, d).where("variant = 'D5' AND state_id IS NOT NULL")
    own = F.element_at(F.array("p0", "p1", "p2"), F.col("state_id") + 1)
    each = c.select("doc_id", "policy", (-F.log(own)).alias("num"), F.lit(1.0).alias("den"))  # a unit's cells stay together, so its weights are drawn once
    return B.interval(B.ratio(each, "doc_id", "num", "den", ["policy"], "boot", R), ["policy"])


def _two_stage(s, d):
    _, calib, test = parts(s, d)
    return rounded(T.two_stage(calib, test, "doc_id", [50, 100, 200, 500], "two", 160))


_CUT = " + ".join(f"(u >= {c})::INTEGER" for c in B.CUTS)
_WEIGHTS = f", wt AS (SELECT doc_id, replicate, {_CUT} AS w FROM (SELECT doc_id, replicate, ('0x' || substr(sha256(concat_ws(':', 'boot', doc_id::VARCHAR, ((replicate - 1) // 5)::VARCHAR)), (replicate - 1) % 5 * 12 + 1, 12))::BIGINT AS u FROM documents, (SELECT unnest(range(1, {R + 1})) AS replicate)))"
_RATIO = _WEIGHTS + ", un AS (SELECT doc_id, sum(correct) AS num, count(*) AS den FROM scored WHERE variant = 'D5' AND correct IS NOT NULL GROUP BY ALL), bt AS (SELECT 'all' AS \"all\", replicate::INTEGER AS replicate, sum(w * num) / sum(w * den) AS value FROM un JOIN wt USING (doc_id) GROUP BY ALL) "
_BINS = "len(list_filter([k / 15.0::DOUBLE FOR k IN range(1, 15)], lambda e: e <= conf))"
_BOOT = _WEIGHTS + f", cb AS (SELECT doc_id, variant, policy, {_BINS} AS bin, correct - conf AS gap FROM scored WHERE correct IS NOT NULL), g AS (SELECT variant, policy, replicate, bin, sum(w * gap) AS g, sum(w) AS n FROM cb JOIN wt USING (doc_id) WHERE w > 0 GROUP BY ALL), bt AS (SELECT variant, policy, replicate::INTEGER AS replicate, sum(abs(g)) / sum(n) AS value FROM g GROUP BY ALL) "
_INTERVAL = "count(*) AS n_valid, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, round((1 + count(*) FILTER (value <= 0)) / (count(*) + 1), 6) AS p"
_KL = f"WITH it AS (SELECT l_orderkey, sum(x) AS s, count(*) AS n FROM ({_TOKENS}) GROUP BY ALL), wt AS (SELECT l_orderkey, s, n, replicate, {_CUT} AS w FROM (SELECT *, ('0x' || substr(sha256(concat_ws(':', 'boot', l_orderkey::VARCHAR, ((replicate - 1) // 5)::VARCHAR)), (replicate - 1) % 5 * 12 + 1, 12))::BIGINT AS u FROM it, (SELECT unnest(range(1, {R // 5 + 1})) AS replicate))) SELECT 'all' AS \"all\", 'kl' AS metric, {_INTERVAL} FROM (SELECT replicate, sum(w * s) / sum(w * n) AS value FROM wt GROUP BY replicate)"
_MISMATCH = _WEIGHTS + f", sm AS (SELECT policy, replicate, sum(w * h * (pred <> state_id)::INTEGER) FILTER (lang = 'en') / sum(w * h) FILTER (lang = 'en') AS low, sum(w * h * (pred <> state_id)::INTEGER) FILTER (lang = 'de') / sum(w * h) FILTER (lang = 'de') AS high FROM (SELECT *, 1.0::DOUBLE / (1 + doc_id % 4) AS h FROM scored WHERE variant = 'D0' AND state_id IS NOT NULL) JOIN wt USING (doc_id) GROUP BY ALL), bt AS (SELECT policy, unnest(['low', 'high', 'difference']) AS metric, unnest([low, high, high - low]) AS value FROM sm) SELECT policy, metric, {_INTERVAL} FROM bt WHERE value IS NOT NULL GROUP BY ALL"
_STANDARD = _WEIGHTS + f", cb AS (SELECT doc_id, variant, policy, state_id, {_BINS} AS bin, correct - conf AS gap FROM scored WHERE correct IS NOT NULL AND variant <> 'D5b'), g AS (SELECT variant, policy, state_id, replicate, bin, sum(w * gap) AS g, sum(w) AS n FROM cb JOIN wt USING (doc_id) WHERE w > 0 GROUP BY ALL), nc AS (SELECT variant, policy, replicate, state_id, sum(n) AS n FROM g GROUP BY ALL), sh AS (SELECT variant, policy, replicate, state_id, n / sum(n) OVER (PARTITION BY variant, policy, replicate) AS share FROM nc), ws AS (SELECT a.variant, a.policy, a.replicate, a.state_id, b.share / a.share AS w FROM sh a JOIN sh b USING (policy, replicate, state_id) WHERE a.variant <> b.variant), st AS (SELECT variant, policy, replicate, sum(abs(gg)) / sum(nn) AS e FROM (SELECT variant, policy, replicate, bin, sum(w * g) AS gg, sum(w * n) AS nn FROM g JOIN ws USING (variant, policy, replicate, state_id) GROUP BY ALL) GROUP BY ALL), pl AS (SELECT variant, policy, replicate, sum(abs(gg)) / sum(nn) AS e FROM (SELECT variant, policy, replicate, bin, sum(g) AS gg, sum(n) AS nn FROM g GROUP BY ALL) GROUP BY ALL), bt AS (SELECT policy, CASE WHEN s.variant = 'D5' THEN 'forward' ELSE 'backward' END AS metric, CASE WHEN s.variant = 'D5' THEN s.e - p.e ELSE p.e - s.e END AS value FROM st s JOIN pl p USING (policy, replicate) WHERE s.variant <> p.variant) SELECT policy, metric, {_INTERVAL} FROM bt GROUP BY ALL"
#: The same form from the differences to the last policy: any nine independent contrasts give it. The inverse is by elimination.
_OMNIBUS = _BOOT + f""", dl AS (SELECT a.policy, a.replicate, a.value - b.value AS v FROM bt a JOIN bt b ON a.policy = b.policy AND a.replicate = b.replicate AND a.variant = 'D5' AND b.variant = 'D0'),
ec AS ({_ECE}), es AS (SELECT a.policy, a.ece - b.ece AS e FROM ec a JOIN ec b ON a.policy = b.policy AND a.variant = 'D5' AND b.variant = 'D0'),
la AS (SELECT replicate, v AS lv, e AS le FROM dl JOIN es USING (policy) JOIN policies USING (policy) WHERE ord = 9),
ct AS (SELECT ord + 1 AS i, replicate, v - lv AS c, e - le AS d FROM dl JOIN es USING (policy) JOIN policies USING (policy) JOIN la USING (replicate) WHERE ord < 9),
cv AS (SELECT a.i, b.i AS j, covar_samp(a.c, b.c) AS s FROM ct a JOIN ct b USING (replicate) GROUP BY ALL),
m0 AS (SELECT list(list_concat(r, [(k = i)::INTEGER::DOUBLE FOR k IN range(1, 10)]) ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) AS r FROM cv GROUP BY i)),
el(k, m) AS (SELECT 0, m FROM m0 UNION ALL SELECT k + 1, [CASE WHEN i = k + 1 THEN [x / m[k + 1][k + 1] FOR x IN m[k + 1]] ELSE [m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] FOR j IN range(1, 19)] END FOR i IN range(1, 10)] FROM el WHERE k < 9),
iv AS (SELECT i, j, m[i][9 + j] AS w FROM el, (SELECT unnest(range(1, 10)) AS i), (SELECT unnest(range(1, 10)) AS j) WHERE k = 9),
st AS (SELECT a.replicate, sum((a.c - a.d) * (b.c - b.d) * w) AS b, sum(a.d * b.d * w) AS t FROM ct a JOIN ct b USING (replicate) JOIN iv ON iv.i = a.i AND iv.j = b.i GROUP BY a.replicate)
SELECT true AS evaluable, NULL::VARCHAR AS reason, 9 AS rank, count(*) AS n_valid, round(max(t), 6) AS statistic, round((1 + count(*) FILTER (b >= t)) / (count(*) + 1), 6) AS p FROM st"""
_PTS = ", pt AS (SELECT variant, policy, avg(conf) AS x, avg(correct) AS y FROM scored WHERE state_id IS NOT NULL GROUP BY ALL) "

QUERIES = {
    "pair_divergence": (lambda s, d: rounded(S.pair_divergence(_labels(s, d))), PRE + ", sh AS (SELECT policy, k, count(*) FILTER (state_id = k) / count(*) AS s FROM label_cells, (SELECT unnest([0, 1, 2]) AS k) WHERE variant = 'D0' AND state_id IS NOT NULL GROUP BY ALL) SELECT a.policy AS a, b.policy AS b, round(sum((CASE WHEN a.s > 0 THEN a.s * log2(2 * a.s / (a.s + b.s)) ELSE 0 END + CASE WHEN b.s > 0 THEN b.s * log2(2 * b.s / (a.s + b.s)) ELSE 0 END) / 2), 6) AS js, round(sum(abs(a.s - b.s)) / 2, 6) AS tv FROM sh a JOIN sh b ON a.k = b.k AND a.policy < b.policy GROUP BY ALL"),
    "cochran_q": (lambda s, d: rounded(S.cochran_q(_labels(s, d))), PRE + ", ks AS (SELECT unnest([0, 1, 2]) AS k), wh AS (SELECT doc_id FROM label_cells WHERE variant = 'D0' GROUP BY doc_id HAVING bool_and(state_id IS NOT NULL)), ok AS (SELECT k, doc_id, policy, (state_id = k)::INTEGER AS v FROM label_cells JOIN wh USING (doc_id), ks WHERE variant = 'D0'), r AS (SELECT k, sum(r) AS t, sum(r * r) AS r2, count(*) AS n FROM (SELECT k, doc_id, sum(v) AS r FROM ok GROUP BY ALL) GROUP BY k), c AS (SELECT k, sum(c * c) AS c2 FROM (SELECT k, policy, sum(v) AS c FROM ok GROUP BY ALL) GROUP BY k), q AS (SELECT k, n, 9 * (10 * c2 - t * t) / (10 * t - r2) AS q FROM r JOIN c USING (k)) SELECT k::INTEGER AS state_id, n, round(q, 6) AS q, 9::BIGINT AS df, round(CASE WHEN 9 > 0 THEN greatest(1 - list_sum([exp((9 / 2.0::DOUBLE + jj) * ln(q / 2) - q / 2 - lgamma(9 / 2.0::DOUBLE + jj + 1)) FOR jj IN range(0, 400)]), 0) END, 6) AS p FROM q"),
    "holm_bonferroni": (lambda s, d: rounded(S.holm(_pvalues(s, d), "p", "policy")), PRE + ", y AS (SELECT policy, state_id, lang FROM label_cells WHERE variant = 'D0' AND state_id IS NOT NULL), o AS (SELECT policy, state_id, lang, count(*) AS o FROM y GROUP BY ALL), r AS (SELECT policy, state_id, count(*) AS r FROM y GROUP BY ALL), c AS (SELECT policy, lang, count(*) AS c FROM y GROUP BY ALL), p AS (SELECT policy, round(exp(-(sum(o) * (sum(o * o / (r * c)) - 1)) / 12), 12) AS p FROM o JOIN r USING (policy, state_id) JOIN c USING (policy, lang) GROUP BY policy), k AS (SELECT policy, p, (count(*) OVER () - row_number() OVER (ORDER BY p, policy) + 1) * p AS s, count(*) OVER () AS m FROM p) SELECT policy, round(p, 6) AS p, round(least(1.0, max(s) OVER (ORDER BY p, policy ROWS UNBOUNDED PRECEDING)), 6) AS holm, round(least(1.0, m * p), 6) AS bonferroni FROM k"),
    "ols_leave_one_out": (lambda s, d: rounded(S.ols(_points(s, d), "x", "y")), PRE + _PTS + ", f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS m FROM pt), l AS (SELECT p.x, p.y, regr_slope(q.y, q.x) AS b1, regr_intercept(q.y, q.x) AS a1 FROM pt p JOIN pt q ON (p.variant, p.policy) <> (q.variant, q.policy) GROUP BY p.variant, p.policy, p.x, p.y) SELECT round(max(b), 6) AS slope, round(max(a), 6) AS intercept, round(1 - sum((y - a - b * x)**2) / sum((y - m)**2), 6) AS r2, round(sum((y - a - b * x)**2), 6) AS sse, round(count(*) * ln(sum((y - a - b * x)**2) / count(*)) + 6 + 24 / (count(*) - 4.0::DOUBLE), 6) AS aicc, round(1 - sum((y - a1 - b1 * x)**2) / sum((y - m)**2), 6) AS loo_r2, round(avg(abs(y - a1 - b1 * x)), 6) AS loo_mae, round(sqrt(avg((y - a1 - b1 * x)**2)), 6) AS loo_rmse FROM l, f"),
    "bootstrap_ratio": (lambda s, d: rounded(_ratio(s, d)), PRE + _RATIO + "SELECT \"all\", replicate, round(value, 6) AS value FROM bt"),
    "bootstrap_ratio_interval": (lambda s, d: rounded(B.interval(_ratio(s, d), ["all"])), PRE + _RATIO + "SELECT \"all\", count(*) AS n_valid, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, round((1 + count(*) FILTER (value <= 0)) / (count(*) + 1), 6) AS p FROM bt GROUP BY ALL"),
    "bootstrap_ece": (lambda s, d: rounded(_boot_ece(s, d)), PRE + _BOOT + "SELECT variant, policy, replicate, round(value, 6) AS value FROM bt"),
    "bootstrap_delta_ece_interval": (lambda s, d: rounded(B.interval(_delta(s, d), ["policy"])), PRE + _BOOT + ", dl AS (SELECT a.policy, a.value - b.value AS v FROM bt a JOIN bt b ON a.policy = b.policy AND a.replicate = b.replicate AND a.variant = 'D5' AND b.variant = 'D0') SELECT policy, count(*) AS n_valid, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, round((1 + count(*) FILTER (v <= 0)) / (count(*) + 1), 6) AS p FROM dl GROUP BY policy"),
    "bootstrap_delta_ece_interval_10000": (lambda s, d: rounded(_many(s, d)), PRE + _BOOT.replace(f"range(1, {R + 1})", f"range(1, {MANY + 1})").replace("correct IS NOT NULL)", "correct IS NOT NULL AND variant <> 'D5b')") + ", dl AS (SELECT a.policy, a.value - b.value AS value FROM bt a JOIN bt b ON a.policy = b.policy AND a.replicate = b.replicate AND a.variant = 'D5' AND b.variant = 'D0') SELECT policy, " + _INTERVAL + " FROM dl GROUP BY policy"),
    "bootstrap_nll_interval": (lambda s, d: rounded(_nll(s, d)), PRE + _WEIGHTS + ", un AS (SELECT doc_id, policy, -ln([p0, p1, p2][state_id + 1]) AS v FROM scored WHERE variant = 'D5' AND state_id IS NOT NULL), bt AS (SELECT policy, replicate, sum(w * v) / sum(w) AS value FROM un JOIN wt USING (doc_id) WHERE w > 0 GROUP BY ALL) SELECT policy, count(*) AS n_valid, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, round((1 + count(*) FILTER (value <= 0)) / (count(*) + 1), 6) AS p FROM bt GROUP BY policy"),
    "two_stage_bootstrap": (_two_stage, None),
    "bootstrap_rates_interval": (lambda s, d: rounded(_rates(s, d)), PRE + _WEIGHTS + ", sm AS (SELECT policy, replicate, sum(w) AS a, sum(w) FILTER (state_id = 1) AS pos, sum(w) FILTER (state_id = 0) AS neg, coalesce(sum(w) FILTER (state_id = 1 AND pred = 1), 0) AS tp, coalesce(sum(w) FILTER (state_id = 0 AND pred = 1), 0) AS fp, coalesce(sum(w) FILTER (state_id = 1 AND pred <> 1), 0) AS fn, sum(-w * ln(greatest([p0, p1, p2][state_id + 1], 1e-12))) AS nll, sum(w * ((p0 - (state_id = 0)::INTEGER)**2 + (p1 - (state_id = 1)::INTEGER)**2 + (p2 - (state_id = 2)::INTEGER)**2)) AS brier FROM scored JOIN wt USING (doc_id) WHERE variant = 'D5' AND state_id IS NOT NULL GROUP BY ALL), bt AS (SELECT policy, unnest(['f1', 'fn_rate', 'fp_rate', 'nll', 'brier']) AS metric, unnest([CASE WHEN pos > 0 AND neg > 0 THEN CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::DOUBLE ELSE 2 * tp / (2 * tp + fp + fn) END END, fn / pos, fp / neg, nll / a, brier / a]) AS value FROM sm) SELECT policy, metric, count(*) AS n_valid, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, round((1 + count(*) FILTER (value <= 0)) / (count(*) + 1), 6) AS p FROM bt WHERE value IS NOT NULL GROUP BY ALL"),
    "simultaneous_intervals": (lambda s, d: rounded(_simultaneous(s, d)), PRE + _BOOT + f", dl AS (SELECT a.policy, a.replicate, a.value - b.value AS v FROM bt a JOIN bt b ON a.policy = b.policy AND a.replicate = b.replicate AND a.variant = 'D5' AND b.variant = 'D0'), ec AS ({_ECE}), es AS (SELECT a.policy, a.ece - b.ece AS e FROM ec a JOIN ec b ON a.policy = b.policy AND a.variant = 'D5' AND b.variant = 'D0'), se AS (SELECT policy, stddev_samp(v) AS se, count(*) AS n_valid FROM dl GROUP BY policy), ct AS (SELECT quantile_cont(t, 0.95) AS c FROM (SELECT replicate, max(abs(v - e) / se) AS t FROM dl JOIN es USING (policy) JOIN se USING (policy) GROUP BY replicate)) SELECT policy, round(e - c * se, 6) AS low, round(e + c * se, 6) AS high, n_valid FROM es JOIN se USING (policy), ct"),
    "simultaneous_centred_intervals": (lambda s, d: rounded(_simultaneous(s, d, centred=True)), PRE + _BOOT + f", dl AS (SELECT a.policy, a.replicate, a.value - b.value - avg(a.value - b.value) OVER (PARTITION BY a.replicate) AS v FROM bt a JOIN bt b ON a.policy = b.policy AND a.replicate = b.replicate AND a.variant = 'D5' AND b.variant = 'D0'), ec AS ({_ECE}), es AS (SELECT a.policy, a.ece - b.ece - avg(a.ece - b.ece) OVER () AS e FROM ec a JOIN ec b ON a.policy = b.policy AND a.variant = 'D5' AND b.variant = 'D0'), se AS (SELECT policy, stddev_samp(v) AS se, count(*) AS n_valid FROM dl GROUP BY policy), ct AS (SELECT quantile_cont(t, 0.95) AS c FROM (SELECT replicate, max(abs(v - e) / se) AS t FROM dl JOIN es USING (policy) JOIN se USING (policy) GROUP BY replicate)) SELECT policy, round(e - c * se, 6) AS low, round(e + c * se, 6) AS high, n_valid FROM es JOIN se USING (policy), ct"),
    "omnibus_test": (lambda s, d: rounded(_omnibus(s, d)), PRE.replace("WITH policies", "WITH RECURSIVE policies", 1) + _OMNIBUS),
    "bootstrap_kl_interval": (lambda s, d: rounded(_kl(s, d)), _KL),
    "bootstrap_mismatch_interval": (lambda s, d: rounded(_mismatch(s, d)), PRE + _MISMATCH),
    "bootstrap_standardized_interval": (lambda s, d: rounded(_standardized(s, d)), PRE + _STANDARD),
}
