"""Paired tests and small fits: Spark makes the sums, the rest is on a row per policy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..shared import saved
from .slopes import HIGH, LOGITS, LOW, roots, slopes


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution, by the regularised incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    term = total = 1 / a
    if x < a + 1:
        for n in range(1, 10_000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for n in range(1, 10_000):
        an = -n * (n - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


#: Terms of the series and levels of the fraction below.
TERMS = 200


def chi2_tail(x: Column, df: Column) -> Column:
    """Upper tail of the chi-square distribution, for up to about 2,000 degrees of freedom; null without any.

    The regularised incomplete gamma function: its series below the mean, else its continued fraction
    from the innermost level out, both of a fixed length, so that the value is a column.
    """
    a, h = df.cast("double") / 2, x.cast("double") / 2
    # log gamma of a whole or half number by steps down to 1 or 1/2
    steps = F.sequence(F.lit(1), F.ceil(a).cast("int") - 1)
    end = F.when(F.pmod(df, F.lit(2)) == 1, 0.5 * math.log(math.pi)).otherwise(0.0)
    log_gamma = F.when(a > 1, F.aggregate(F.when(a > 1, steps), end, lambda t, k: t + F.log(a - k))).otherwise(end)
    power = F.exp(a * F.log(h) - h - log_gamma)
    first = F.struct((1 / a).alias("term"), (1 / a).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, lambda s, n: F.struct((s["term"] * h / (a + n)).alias("term"), (s["sum"] + s["term"] * h / (a + n)).alias("sum")), lambda s: s["sum"])
    levels = F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1))
    fraction = F.aggregate(levels, h + 2 * TERMS + 1 - a, lambda d, n: h + 2 * n - 1 - a - n * (n - a) / d)
    tail = F.when(h <= 0, 1.0).when(h < a + 1, 1 - power * series).otherwise(power / fraction)
    return F.when((df > 0) & x.isNotNull(), F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))


def pair_divergence(cells: DataFrame) -> DataFrame:
    """Jensen-Shannon (base 2) and total variation of each two policies' state shares."""
    counted = cells.where("state_id IS NOT NULL").groupBy("policy", "state_id").agg(F.count("*").alias("n"))
    share = counted.withColumn("s", F.col("n") / F.sum("n").over(W.partitionBy("policy"))).groupBy("policy").pivot("state_id", [0, 1, 2]).agg(F.first("s")).na.fill(0.0)
    a, b = (share.select(F.col("policy").alias(p), *[F.col(str(k)).alias(f"{p}{k}") for k in range(3)]) for p in "ab")
    both = a.join(b, F.col("a") < F.col("b"))
    kl = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    js = tv = F.lit(0.0)
    for k in range(3):
        x, y = F.col(f"a{k}"), F.col(f"b{k}")
        js, tv = js + (kl(x, (x + y) / 2) + kl(y, (x + y) / 2)) / 2, tv + F.abs(x - y) / 2
    return both.select("a", "b", js.alias("js"), tv.alias("tv"))


def cochran_q(cells: DataFrame, states: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """state_id, n, q, df, p over policies of the indicator of each state, on complete records."""
    is_state = [(F.col("state_id") == k).cast("int") for k in states]
    whole = cells.groupBy("doc_id").agg(F.count("*").alias("k"), F.min(F.col("state_id").isNotNull()).alias("ok"), F.array(*[F.sum(c) for c in is_state]).alias("row")).where("ok")
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("state_id"), F.col("row")[i].alias("r")) for i, k in enumerate(states)]))
    rows = whole.select("k", each).groupBy("state_id").agg(F.sum("r").alias("total"), F.sum(F.col("r") * F.col("r")).alias("row2"), F.max("k").alias("k"), F.count("*").alias("n"))
    columns = cells.join(whole.select("doc_id"), "doc_id", "left_semi").groupBy("policy").agg(F.array(*[F.sum(c) for c in is_state]).alias("c"))
    squares = columns.select(F.inline(F.array(*[F.struct(F.lit(k).alias("state_id"), F.col("c")[i].alias("c")) for i, k in enumerate(states)]))).groupBy("state_id").agg(F.sum(F.col("c") * F.col("c")).alias("col2"))
    down = F.col("k") * F.col("total") - F.col("row2")
    q = F.when(down != 0, (F.col("k") - 1) * (F.col("k") * F.col("col2") - F.col("total") * F.col("total")) / down)
    return rows.join(squares, "state_id").select("state_id", "n", q.alias("q"), (F.col("k") - 1).alias("df")).withColumn("p", chi2_tail(F.col("q"), F.col("df")))


def stuart_maxwell(cells: DataFrame) -> DataFrame:
    """a, b, n, statistic, p of marginal homogeneity for each two policies, on records that have both.

    The cells of a record meet inside its row, so nothing is joined; a pair's table has nine
    counts. Two degrees of freedom: the quadratic form has a closed form, and so has p.
    """
    row = cells.where("state_id IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("policy", "state_id"))).alias("x"))
    two = F.flatten(F.transform("x", lambda a: F.transform(F.filter("x", lambda b: b["policy"] > a["policy"]), lambda b: F.struct(a["policy"].alias("a"), b["policy"].alias("b"), a["state_id"].alias("i"), b["state_id"].alias("j")))))
    long = row.select(F.explode(two).alias("p")).select("p.*")
    of = lambda c: F.sum(c.cast("int"))
    i, j = F.col("i"), F.col("j")
    sums = {f"d{k}": of(i == k) - of(j == k) for k in (0, 1)} | {f"v{k}{k}": of((i == k) & (j != k)) + of((i != k) & (j == k)) for k in (0, 1)} | {"v01": -of((i == 0) & (j == 1)) - of((i == 1) & (j == 0))}
    t = long.groupBy("a", "b").agg(F.count("*").alias("n"), *[v.alias(k) for k, v in sums.items()])
    d0, d1, v00, v11, v01 = (F.col(c) for c in ("d0", "d1", "v00", "v11", "v01"))
    det = v00 * v11 - v01 * v01
    stat = F.when(det > 0, (d0 * d0 * v11 - 2 * d0 * d1 * v01 + d1 * d1 * v00) / det)
    return t.select("a", "b", "n", stat.alias("statistic"), F.exp(-stat / 2).alias("p"))


def holm(rows: DataFrame, p: str, tie: str) -> DataFrame:
    """Holm and Bonferroni adjusted p; rows has a row a hypothesis."""
    order = W.orderBy(p, tie)
    step = (F.count("*").over(W.partitionBy()) - F.row_number().over(order) + 1) * F.col(p)
    stepped = rows.withColumn("_s", step)
    running = F.max("_s").over(order.rowsBetween(W.unboundedPreceding, 0))
    return stepped.withColumns({"holm": F.least(F.lit(1.0), running), "bonferroni": F.least(F.lit(1.0), F.count("*").over(W.partitionBy()) * F.col(p))}).drop("_s")


TRANSFORMS = {"linear": lambda c: c, "sqrt": F.sqrt, "log1p": F.log1p}


def ols(points: DataFrame, x: str, y: str, transform: str = "linear", intercept: bool = True, keys: list[str] | None = None) -> DataFrame:
    """keys, slope, intercept, r2, sse, aicc, and R2, MAE and RMSE over points left out one at a time.

    Sums of the others are totals less the point's own; one pass over the points.
    """
    keys = keys or []
    every = W.partitionBy(*keys)
    rows = points.select(*keys, TRANSFORMS[transform](F.col(x)).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    cx, cy = F.col("x"), F.col("y")
    sums = {"n": F.count("*"), "sx": F.sum("x"), "sy": F.sum("y"), "sxx": F.sum(cx * cx), "sxy": F.sum(cx * cy)}
    out = rows.withColumns({k: v.over(every) for k, v in sums.items()})

    def fit(n, sx, sy, sxx, sxy):
        if not intercept:
            return sxy / sxx, F.lit(0.0)
        down = n * sxx - sx * sx
        return (n * sxy - sx * sy) / down, (sy * sxx - sx * sxy) / down

    slope, at_zero = fit(*[F.col(k) for k in sums])
    s1, i1 = fit(F.col("n") - 1, F.col("sx") - cx, F.col("sy") - cy, F.col("sxx") - cx * cx, F.col("sxy") - cx * cy)
    square = lambda c: F.pow(c, F.lit(2))
    each = out.select(*keys, "n", slope.alias("slope"), at_zero.alias("intercept"), square(cy - slope * cx - at_zero).alias("sse"), (cy - s1 * cx - i1).alias("left"), square(cy - F.col("sy") / F.col("n")).alias("sst"))
    total = each.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("slope").alias("slope"), F.max("intercept").alias("intercept"), F.sum("sse").alias("sse"), F.sum("sst").alias("sst"),
        F.sum(square(F.col("left"))).alias("loo"), F.avg(F.abs("left")).alias("loo_mae"), F.sqrt(F.avg(square(F.col("left")))).alias("loo_rmse"),
    )
    k = 3.0 if intercept else 2.0  # the coefficients and the error's variance
    aicc = F.col("n") * F.log(F.col("sse") / F.col("n")) + 2 * k + 2 * k * (k + 1) / (F.col("n") - k - 1)
    return total.select(*keys, "slope", "intercept", (1 - F.col("sse") / F.col("sst")).alias("r2"), "sse", aicc.alias("aicc"), (1 - F.col("loo") / F.col("sst")).alias("loo_r2"), "loo_mae", "loo_rmse")


def permutation_test(points: DataFrame, label: str, x: str, y: str, transform: str = "linear") -> DataFrame:
    """slope, loo_r2 and the share of all orders of y, the observed one included, that reach each of them.

    points has a row a label, at most eight: the orders are their factorial. Each order is a
    number; Spark derives its permutation from the number's factorial digits and joins the points.
    """
    bounded = points.select(F.col(label).alias("label"), F.col(x).alias("x"), F.col(y).alias("y"))
    row = bounded.agg(F.array_sort(F.collect_list(F.struct("label", "x", "y"))).alias("p"))
    n = points.count()
    if n > 8:
        raise ValueError(f"{n} points have too many orders")
    # the k-th digit of an order's number picks the next of the places that are left
    start = F.struct(F.sequence(F.lit(0), F.size("p") - 1).alias("left"), F.array().cast("array<int>").alias("taken"), F.col("number").alias("rest"))

    def pick(acc, k):
        size = F.size(acc["left"])
        at = F.pmod(acc["rest"], size).cast("int")
        chosen = F.get(acc["left"], at)
        return F.struct(F.array_remove(acc["left"], chosen).alias("left"), F.array_append(acc["taken"], chosen).alias("taken"), F.floor(acc["rest"] / size).alias("rest"))

    order = F.aggregate(F.sequence(F.lit(1), F.size("p")), start, pick, lambda acc: acc["taken"])
    numbers = row.select("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(math.factorial(n) - 1).cast("long"))).alias("number"))
    mixed = numbers.select("number", F.posexplode(order).alias("k", "v"), "p").select("number", F.get("p", F.col("k"))["x"].alias("x"), F.get("p", F.col("v"))["y"].alias("y"))
    each = ols(mixed, "x", "y", transform, keys=["number"])
    seen = each.where("number = 0").select(F.col("slope").alias("s0"), F.col("loo_r2").alias("l0"))
    reach = lambda c, o: F.avg((F.col(c) >= F.col(o) - 1e-12).cast("int"))
    return each.join(F.broadcast(seen)).agg(F.max("s0").alias("slope"), F.max("l0").alias("loo_r2"), reach("slope", "s0").alias("p_slope"), reach("loo_r2", "l0").alias("p_loo_r2"), F.count("*").alias("n_orders"))


def fit_temperature(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, temperature, at_bound, variance of log T: least mean NLL over log T between the bounds of ``slopes``.

    One pass sums the slopes at fixed points, a task's cells of a key as one row; each key's optimum is a root of
    the polynomial through them. At a bound the variance is null.
    """
    kinds = dict(cells.dtypes)
    on = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for pdf in frames:
            z, y = pdf[LOGITS].to_numpy(np.float64), pdf["state_id"].to_numpy(np.int64)
            for key, at in pdf.groupby(keys, sort=False, dropna=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                sums, n = held.get(key, (0.0, 0))
                held[key] = [sums + slopes(z[at], y[at]).sum(0), n + len(at)]
        if held:
            yield pd.DataFrame([[*k, s.tolist(), n] for k, (s, n) in held.items()], columns=[*keys, "sums", "n"])

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tau, variance = roots(np.sum(np.stack(pdf["sums"].to_list()), axis=0)[:, None], np.array([pdf["n"].sum()]))
        bound = bool(np.isclose(tau[0], [LOW, HIGH], rtol=0, atol=1e-12).any())
        return pd.DataFrame([[*key, math.exp(tau[0]), bound, variance[0]]], columns=[*keys, "temperature", "at_bound", "variance"])

    rows = cells.where("state_id IS NOT NULL").select(*keys, "state_id", *LOGITS)
    sums = rows.mapInPandas(partial, f"{on}, sums array<double>, n long")
    found = sums.groupBy(*keys).applyInPandas(fit, f"{on}, temperature double, at_bound boolean, variance double")
    return found.withColumn("variance", F.when(~F.isnan("variance"), F.col("variance")))


def logistic_calibration(cells: DataFrame, keys: list[str], score: str, hit: str, clip: float = 1e-6, passes: int = 25) -> DataFrame:
    """keys, intercept, slope of hit on the score's logit; five sums a pass for all keys, by Newton steps."""
    spark = cells.sparkSession
    p = F.least(F.greatest(F.col(score), F.lit(clip)), F.lit(1 - clip))
    rows = saved(cells.where(F.col(hit).isNotNull()).select(*keys, F.log(p / (1 - p)).alias("x"), F.col(hit).cast("double").alias("y")))
    state = {tuple(r): (0.0, 0.0) for r in rows.select(*keys).distinct().collect()}
    for _ in range(passes):
        now = spark.createDataFrame([(*k, *v) for k, v in state.items()], [*keys, "a", "b"])
        q = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("x"))))
        w = rows.join(F.broadcast(now), keys).withColumns({"q": q})
        r, v, x = F.col("y") - F.col("q"), F.col("q") * (1 - F.col("q")), F.col("x")
        moved = 0.0
        for g in w.groupBy(*keys).agg(F.sum(r).alias("g0"), F.sum(r * x).alias("g1"), F.sum(v).alias("h0"), F.sum(v * x).alias("h1"), F.sum(v * x * x).alias("h2")).collect():
            k = tuple(g[c] for c in keys)
            det = g["h0"] * g["h2"] - g["h1"] ** 2
            if det <= 0:
                continue
            step = ((g["h2"] * g["g0"] - g["h1"] * g["g1"]) / det, (g["h0"] * g["g1"] - g["h1"] * g["g0"]) / det)
            state[k] = (state[k][0] + step[0], state[k][1] + step[1])
            moved = max(moved, *map(abs, step))
        if moved < 1e-9:
            break
    return spark.createDataFrame([(*k, *v) for k, v in state.items()], [*keys, "intercept", "slope"])
