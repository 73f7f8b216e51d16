"""Fits of temperatures and lines and their learning curve, beside SQL that finds each optimum in its own way.

The SQL of a temperature narrows a grid of log T by the sign of the loss's slope on both sides, that of a
line takes a fixed number of Newton steps; a fit of each is a chain of plain tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import digest, hex_int
from ..operators import recalibrate as L
from ..operators import stats as S
from ..operators.sampling import global_rank
from .metric_queries import BIN, PRE, cells, rounded

KEYS = ["variant", "policy"]
BUDGETS = [50, 100, 200, 500]


def parts(s, d):
    """Source cells, and the calib and test cells of the other variant; calib cells have their rank."""
    c = cells(s, d)
    share = hex_int(digest("part", F.col("doc_id")), 1, 2) < 96
    ranks = global_rank(c.select("doc_id").distinct().where(share), digest("budget", F.col("doc_id")))
    other = c.where("variant = 'D5'")
    return c.where((F.col("variant") == "D0") & share), other.join(ranks, "doc_id"), other.where(~share)


def _temperature(s, d, keys):
    return rounded(S.fit_temperature(cells(s, d), keys).drop("variance"))


def _logistic(s, d, keys):
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), F.col(f"p{k}").alias("score"), (F.col("state_id") == k).cast("int").alias("y")) for k in range(3)]))
    c = cells(s, d).where("state_id IS NOT NULL").select(*KEYS, each.alias("x")).select(*KEYS, "x.*")
    c = c if "class" in keys else c.where("class = 1")
    return rounded(S.logistic_calibration(c, keys, "score", "y"))


def _permuted(s, d):
    c = cells(s, d).where("variant = 'D5' AND state_id IS NOT NULL AND policy < 'S2'")
    points = c.groupBy("policy").agg(F.round(F.avg("conf"), 9).alias("x"), F.round(F.avg("correct"), 9).alias("y"))
    return rounded(S.permutation_test(points, "policy", "x", "y"))


def temperature_sql(name: str, source: str, keys: str, levels: int = 9) -> str:
    """CTEs that end in name: keys, tau, at_bound, variance; source has keys, state_id and z0 to z2."""
    top = "greatest(z0, z1, z2)"
    out = [f"{name}_c AS (SELECT {keys}, z0 - {top} AS a, z1 - {top} AS b, z2 - {top} AS c, [z0, z1, z2][state_id + 1] - {top} AS y FROM {source} WHERE state_id IS NOT NULL)"]
    out.append(f"{name}_0 AS (SELECT {keys}, ln(0.05::DOUBLE) AS lo, ln(20.0::DOUBLE) AS hi, 0 AS bound FROM {name}_c GROUP BY {keys})")
    mean = "(a * exp(t * a) + b * exp(t * b) + c * exp(t * c)) / (exp(t * a) + exp(t * b) + exp(t * c))"
    for k in range(levels):
        slopes = f"SELECT {keys}, lo, hi, bound, j, sum(t * (y - {mean})) AS g FROM (SELECT x.*, lo, hi, bound, j, exp(-(lo + j * (hi - lo) / 16)) AS t FROM {name}_c x JOIN {name}_{k} USING ({keys}), (SELECT unnest(range(0, 17)) AS j)) GROUP BY ALL"
        bound = "CASE WHEN max(j) FILTER (g <= 0) IS NULL THEN -1 WHEN max(j) FILTER (g <= 0) = 16 THEN 1 ELSE 0 END" if k == 0 else "bound"
        at = "least(coalesce(max(j) FILTER (g <= 0), 0), 15)"
        out.append(f"{name}_{k + 1} AS (SELECT {keys}, lo + {at} * (hi - lo) / 16 AS lo, lo + ({at} + 1) * (hi - lo) / 16 AS hi, {bound} AS bound FROM ({slopes}) GROUP BY {keys}, lo, hi, bound)")
    tau = "CASE bound WHEN -1 THEN ln(0.05::DOUBLE) WHEN 1 THEN ln(20.0::DOUBLE) ELSE (lo + hi) / 2 END"
    square = "(a * a * exp(t * a) + b * b * exp(t * b) + c * c * exp(t * c)) / (exp(t * a) + exp(t * b) + exp(t * c))"
    curve = f"sum(t * t * ({square} - ({mean})**2) - t * (y - {mean}))"
    out.append(f"{name} AS (SELECT {keys}, tau, bound <> 0 AS at_bound, CASE WHEN bound = 0 THEN 1 / {curve} END AS variance FROM (SELECT x.*, bound, tau, exp(-tau) AS t FROM {name}_c x JOIN (SELECT {keys}, bound, {tau} AS tau FROM {name}_{levels}) USING ({keys})) GROUP BY {keys}, tau, bound)")
    return ", ".join(out)


def _line_sql(rows: str, keys: str, steps: int = 12) -> str:
    """CTEs lr of (keys, x, y) and l0 to l<steps> of Newton steps from the flat line."""
    out = [f"lr AS (SELECT {keys}, ln(p / (1 - p)) AS x, y FROM (SELECT {keys}, least(greatest(p, 1e-6), 1 - 1e-6) AS p, y FROM ({rows})))", f"l0 AS (SELECT {keys}, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM lr GROUP BY {keys})"]
    for k in range(steps):
        sums = f"SELECT {keys}, a, b, sum(y - q) AS g0, sum((y - q) * x) AS g1, sum(q * (1 - q)) AS h0, sum(q * (1 - q) * x) AS h1, sum(q * (1 - q) * x * x) AS h2 FROM (SELECT *, 1 / (1 + exp(-(a + b * x))) AS q FROM lr JOIN l{k} USING ({keys})) GROUP BY ALL"
        out.append(f"l{k + 1} AS (SELECT {keys}, a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS a, b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b FROM ({sums}))")
    return ", ".join(out) + f" SELECT {keys}, round(a, 6) AS intercept, round(b, 6) AS slope FROM l{steps}"


_ROWS = "SELECT variant, policy, k AS class, [p0, p1, p2][k + 1] AS p, (state_id = k)::INTEGER::DOUBLE AS y FROM scored, (SELECT unnest([0, 1, 2]) AS k) WHERE state_id IS NOT NULL"
_T = "SELECT {keys}, round(exp(tau), 6) AS temperature, at_bound FROM fit"

_PERMUTED = """, pt AS (SELECT row_number() OVER (ORDER BY policy) AS i, round(avg(conf), 9) AS x, round(avg(correct), 9) AS y FROM scored WHERE variant = 'D5' AND state_id IS NOT NULL AND policy < 'S2' GROUP BY policy),
pm(k, o) AS (SELECT 0, []::BIGINT[] UNION ALL SELECT k + 1, list_append(o, i) FROM pm, pt WHERE k < 6 AND NOT list_contains(o, i)),
mx AS (SELECT o, p.x, q.y FROM pm, pt p, pt q WHERE k = 6 AND q.i = o[p.i]),
ft AS (SELECT o, regr_slope(y, x) AS b, avg(x) AS mx, avg(y) AS my, sum(x * x) - sum(x)**2 / 6 AS sxx FROM mx GROUP BY o),
fg AS (SELECT o, o = [1, 2, 3, 4, 5, 6] AS seen, max(b) AS slope, 1 - sum(((y - my - b * (x - mx)) / (1 - 1 / 6.0::DOUBLE - (x - mx)**2 / sxx))**2) / sum((y - my)**2) AS loo FROM mx JOIN ft USING (o) GROUP BY o),
s AS (SELECT slope AS s0, loo AS l0 FROM fg WHERE seen)
SELECT round(max(s0), 6) AS slope, round(max(l0), 6) AS loo_r2, round(avg((slope >= s0 - 1e-12)::INTEGER), 6) AS p_slope, round(avg((loo >= l0 - 1e-12)::INTEGER), 6) AS p_loo_r2, count(*) AS n_orders FROM fg, s"""

_SHARE = "('0x' || substr(sha256(concat_ws(':', 'part', doc_id::VARCHAR)), 1, 2))::BIGINT < 96"
_CURVE = (
    f", rk AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(concat_ws(':', 'budget', doc_id::VARCHAR))) AS rank FROM documents WHERE {_SHARE}), "
    f"so AS (SELECT * FROM scored WHERE variant = 'D0' AND {_SHARE}), "
    f"ca AS (SELECT s.*, budget FROM scored s JOIN rk USING (doc_id), (SELECT unnest({BUDGETS}) AS budget) WHERE variant = 'D5' AND rank <= budget), "
    f"te AS (SELECT * FROM scored WHERE variant = 'D5' AND state_id IS NOT NULL AND NOT {_SHARE}), "
    + ", ".join([temperature_sql("fs", "so", "policy"), temperature_sql("fp", "ca", "budget, policy"), temperature_sql("fg", "ca", "budget")])
    + """, bt AS (SELECT budget, greatest(0, var_samp(tau) - avg(variance)) AS between FROM fp GROUP BY budget),
sh AS (SELECT budget, fp.policy, fs.tau AS source, fg.tau AS pooled, fp.tau AS own, fg.tau + CASE WHEN between + fp.variance > 0 THEN between / (between + fp.variance) ELSE 0 END * (fp.tau - fg.tau) AS drawn FROM fp JOIN fg USING (budget) JOIN fs USING (policy) JOIN bt USING (budget)),
tt AS (SELECT budget, policy, unnest(['raw', 'source', 'global', 'policy', 'shrunk']) AS method, exp(unnest([0, source, pooled, own, least(greatest(drawn, ln(0.05::DOUBLE)), ln(20.0::DOUBLE))])) AS t FROM sh),
pb AS (SELECT budget, method, policy, state_id, pred, exp((z0 - greatest(z0, z1, z2)) / t) AS e0, exp((z1 - greatest(z0, z1, z2)) / t) AS e1, exp((z2 - greatest(z0, z1, z2)) / t) AS e2 FROM te JOIN tt USING (policy)),
cf AS (SELECT budget, method, policy, (pred = state_id)::INTEGER AS correct, greatest(e0, e1, e2) / (e0 + e1 + e2) AS conf, -ln(greatest([e0, e1, e2][state_id + 1] / (e0 + e1 + e2), 1e-12)) AS nll FROM pb),
pe AS (SELECT budget, method, policy, sum(abs(g)) / sum(n) AS ece FROM (SELECT budget, method, policy, """
    + BIN.format("conf")
    + """ AS bin, sum(correct - conf) AS g, count(*) AS n FROM cf GROUP BY ALL) GROUP BY ALL),
pn AS (SELECT budget, method, policy, avg(nll) AS nll FROM cf GROUP BY ALL),
mn AS (SELECT budget, method, avg(ece) AS mean_ece, avg(nll) AS mean_nll FROM pe JOIN pn USING (budget, method, policy) GROUP BY ALL),
cu AS (SELECT *, 1 - mean_ece / max(mean_ece) FILTER (method = 'raw') OVER w AS reduction, max(mean_ece) FILTER (method = 'source') OVER w - mean_ece AS recovery, max(mean_ece) FILTER (method = 'global') OVER w - mean_ece AS structure_benefit FROM mn WINDOW w AS (PARTITION BY budget)) """
)
_ROUNDED = "SELECT budget::INTEGER AS budget, method, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean_ece", "mean_nll", "reduction", "recovery", "structure_benefit")) + " FROM cu"
_SMALLEST = "SELECT method, min(budget) FILTER (ok)::INTEGER AS budget FROM (SELECT method, budget, bool_and(mean_ece <= 0.2) OVER (PARTITION BY method ORDER BY budget DESC) AS ok FROM cu) GROUP BY method"

QUERIES = {
    "temperature_fit": (lambda s, d: _temperature(s, d, ["variant"]), PRE + ", " + temperature_sql("fit", "scored", "variant") + _T.format(keys="variant").join((" ", ""))),
    "temperature_fit_by_policy": (lambda s, d: _temperature(s, d, KEYS), PRE + ", " + temperature_sql("fit", "scored", "variant, policy") + _T.format(keys="variant, policy").join((" ", ""))),
    "logistic_calibration": (lambda s, d: _logistic(s, d, ["variant"]), PRE + ", " + _line_sql(f"SELECT * FROM ({_ROWS}) WHERE class = 1", "variant")),
    "logistic_calibration_by_class": (lambda s, d: _logistic(s, d, [*KEYS, "class"]), PRE + ", " + _line_sql(_ROWS, "variant, policy, class")),
    "permutation_test": (_permuted, PRE.replace("WITH policies", "WITH RECURSIVE policies", 1) + _PERMUTED),
    "learning_curve": (lambda s, d: rounded(L.learning_curve(*parts(s, d), BUDGETS)), PRE + _CURVE + _ROUNDED),
    "smallest_budget": (lambda s, d: L.smallest_budget(L.learning_curve(*parts(s, d), BUDGETS), 0.2), PRE + _CURVE + _SMALLEST),
}
