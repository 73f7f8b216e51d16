"""Metrics under a bootstrap against loops over replicates, and a caller's own metric."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.operators import accumulate, bootstrap
from auditlake.plans import resample_queries

SCHEMA = "doc_id long, variant int, policy string, state_id int, p0 double, p1 double, p2 double, conf double, pred int, correct int, domain int, wrong int, weight double"
R = 12


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        for v in (0, 1):
            for p in ("H1", "H2", None):
                q = rng.dirichlet([1, 1, 1])
                y = int(rng.integers(0, 2 if p == "H2" and v == 1 else 3))  # the second variant lacks a class
                rows.append((i, v, p, y, *map(float, q), float(q.max()), int(q.argmax()), int(q.argmax() == y), i % 2, int(q.argmax() != y), float(1 + i % 3)))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def weight_of():
    return {i: bootstrap.weights("s", [i], 0, R)[0] for i in range(60)}


def values(df, *keys):
    return {(*[r[k] for k in keys], r["metric"], r["replicate"]): r["value"] for r in df.collect()}


def gap(cells, w):
    bins = {}
    for r, x in zip(cells, w):
        b = sum(r[7] >= k / 15 for k in range(1, 15))
        bins[b] = bins.get(b, 0.0) + x * (r[9] - r[7])
    return sum(map(abs, bins.values())) / sum(w)


def test_metrics_equal_loops(table, monkeypatch):
    rows, cells = table
    monkeypatch.setattr(accumulate, "HELD", 200)  # states are sent on more than once
    monkeypatch.setattr(accumulate, "BLOCK", 5)
    w = weight_of()
    ece = values(accumulate.replicated(cells, "doc_id", ["policy"], accumulate.Ece(), "s", R), "policy")
    mean = values(accumulate.replicated(cells, "doc_id", ["policy"], accumulate.WeightedMean("conf", "weight", "kl"), "s", R), "policy")
    apart = values(accumulate.replicated(cells, "doc_id", ["policy"], accumulate.Mismatch(), "s", R), "policy")
    rates = values(accumulate.replicated(cells, "doc_id", ["policy", "variant"], accumulate.Rates(), "s", R), "policy", "variant")
    assert len(ece) == 3 * R
    for p in ("H1", "H2", None):
        own = [r for r in rows if r[2] == p]
        for k in range(R):
            x = [w[r[0]][k] for r in own]
            assert ece[p, "ece", k + 1] == pytest.approx(gap(own, [a * r[12] for r, a in zip(own, x)]))
            assert mean[p, "kl", k + 1] == pytest.approx(sum(a * r[7] for r, a in zip(own, x)) / sum(a * r[12] for r, a in zip(own, x)))
            of = lambda d: sum(a * r[12] * r[11] for r, a in zip(own, x) if r[10] == d) / sum(a * r[12] for r, a in zip(own, x) if r[10] == d)  # noqa: B023, E731
            assert apart[p, "difference", k + 1] == pytest.approx(of(1) - of(0))
            one = [(r, a) for r, a in zip(own, x) if r[1] == 1]
            tp, fp, fn = (sum(a for r, a in one if f(r)) for f in (lambda r: r[3] == 1 and r[8] == 1, lambda r: r[3] == 0 and r[8] == 1, lambda r: r[3] == 1 and r[8] != 1))
            assert rates[p, 1, "f1", k + 1] == pytest.approx(2 * tp / (2 * tp + fp + fn))
            assert rates[p, 1, "nll", k + 1] == pytest.approx(sum(-a * math.log(r[4 + r[3]]) for r, a in one) / sum(a for _, a in one))


def test_standardized_delta_has_class_weights_of_each_replicate(table):
    rows, cells = table
    w = weight_of()
    found = values(accumulate.replicated(cells, "doc_id", ["policy"], accumulate.StandardizedDelta(), "s", R), "policy")
    assert all(found["H2", "forward", k] is None and found["H2", "backward", k] is not None for k in range(1, R + 1))  # a class that the base has and the other has not
    for k in range(R):
        own = {v: [(r, w[r[0]][k]) for r in rows if r[2] == "H1" and r[1] == v] for v in (0, 1)}
        share = {v: {c: sum(x for r, x in own[v] if r[3] == c) / sum(x for _, x in own[v]) for c in range(3)} for v in (0, 1)}
        plain = {v: gap([r for r, _ in own[v]], [x for _, x in own[v]]) for v in (0, 1)}
        under = {v: gap([r for r, _ in own[v]], [x * share[1 - v][r[3]] / share[v][r[3]] if x else 0.0 for r, x in own[v]]) for v in (0, 1)}
        assert found["H1", "forward", k + 1] == pytest.approx(under[1] - plain[0])
        assert found["H1", "backward", k + 1] == pytest.approx(plain[1] - under[0])


def test_a_callers_metric(table):
    class Greatest(accumulate.Accumulator):
        """A caller's metric that does not add: the greatest confidence among drawn cells."""

        columns = ("conf",)

        def start(self, replicates):
            return {"most": np.zeros(replicates)}

        def add(self, state, cells, weight):
            state["most"][:] = np.maximum(state["most"], np.where(weight > 0, cells["conf"][:, None], 0).max(0))

        def merge(self, state, other):
            state["most"][:] = np.maximum(state["most"], other["most"])

        def finish(self, state):
            return {"most": state["most"]}

    rows, cells = table
    w = weight_of()
    found = values(accumulate.replicated(cells.where("policy = 'H1'"), "doc_id", ["policy"], Greatest(), "s", R), "policy")
    for k in range(R):
        assert found["H1", "most", k + 1] == max(r[7] for r in rows if r[2] == "H1" and w[r[0]][k])
    assert accumulate.replicated(cells.limit(0), "doc_id", ["policy"], accumulate.Ece(), "s", R).count() == 0


def test_simultaneous_intervals_take_whole_finite_replicates(spark):
    rng = np.random.default_rng(1)
    boot = rng.normal(0, 1, (40, 3))
    boot[3, 1], boot[7, 2], boot[9, 0] = np.nan, np.inf, np.nan
    est = np.array([0.1, 0.2, -0.4])
    rows = [(f"H{j}", k, None if (k, j) == (9, 0) else float(boot[k, j])) for k in range(40) for j in range(3)]
    values_ = spark.createDataFrame(rows, "policy string, replicate int, value double").repartition(3)
    estimate = spark.createDataFrame([(f"H{j}", float(est[j])) for j in range(3)], "policy string, value double")
    for centred in (False, True):
        b, e = boot[np.isfinite(boot).all(1)], est
        if centred:
            b, e = b - b.mean(1, keepdims=True), e - e.mean()
        se = b.std(0, ddof=1)
        cut = np.quantile(np.abs((b - e) / se).max(1), 0.95)
        found = {r["policy"]: r for r in bootstrap.simultaneous(values_, estimate, "policy", centred).collect()}
        for j in range(3):
            r = found[f"H{j}"]
            assert (r["low"], r["high"], r["n_valid"]) == (pytest.approx(e[j] - cut * se[j]), pytest.approx(e[j] + cut * se[j]), 37)
    none = bootstrap.simultaneous(values_, estimate.withColumn("value", F.lit(float("nan"))), "policy").collect()
    assert len(none) == 3 and all(r["low"] is None and r["n_valid"] == 0 for r in none)


def test_weights_are_cut_by_all_48_bits(monkeypatch):
    def plain(u, r):
        d = hashlib.sha256(f"s:{u}:{(r - 1) // 5}".encode()).digest()[(r - 1) % 5 * 6 :][:6]
        return sum(int.from_bytes(d) >= c for c in bootstrap.CUTS)

    units = [*range(3000), "x", None]
    assert bootstrap.weights("s", units, 10, 33).tolist() == [[plain(u, r) for r in range(11, 34)] for u in units]
    first = [int.from_bytes(hashlib.sha256(f"s:{u}:0".encode()).digest()[:6]) for u in range(2)]
    monkeypatch.setattr(bootstrap, "_BY_TOP", np.full(1 << 16, 255, np.uint8))  # nothing is decided by the first 16 bits
    assert bootstrap.weights("s", [0, 1], 0, 1)[:, 0].tolist() == [sum(d >= c for c in bootstrap.CUTS) for d in first]


def test_nll_bootstrap_draws_a_units_weights_where_its_cells_are(spark, tmp_path):
    """No shuffle scatters a document's policies, each of which would draw its weights again."""
    spark.createDataFrame([(i, "en", "s") for i in range(40)], "doc_id long, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = resample_queries._nll(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInPandas") :]
    assert "Exchange" not in below and "HashAggregate" not in below


def test_weights_of_a_group_are_not_copied():
    w = np.arange(12.0).reshape(6, 2)
    assert np.shares_memory(accumulate.rows_of(w, np.array([2, 3, 4])), w)
    for at in ([2, 3, 4], [0, 2, 1], [1, 1, 3], [5], []):
        at = np.array(at, np.int64)
        assert accumulate.rows_of(w, at).tolist() == w[at].tolist()
