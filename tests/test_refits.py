"""The two-stage bootstrap of refits against loops over replicates, budgets and methods."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import best_log_t, logit_cells

from auditlake.operators import bootstrap, refits, slopes


def auroc(p, y, w):
    pos, neg = (y == 1), (y == 0)
    won = sum(wi * wj * (1.0 if a > b else 0.5 if a == b else 0.0) for a, wi in zip(p[pos], w[pos]) for b, wj in zip(p[neg], w[neg]))
    return won / (w[pos].sum() * w[neg].sum())


def brute(rows, log_t, w):
    """ECE, NLL and AUROC of one policy's cells under one temperature and one weight a cell."""
    z, y = np.array([r[3:] for r in rows]), np.array([r[2] for r in rows])
    s = z / np.exp(log_t)
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    bins = (p.max(1)[:, None] >= np.arange(1, 15) / 15).sum(1)
    gap = sum(abs((w * ((p.argmax(1) == y) - p.max(1)))[bins == b].sum()) for b in range(15))
    return gap / w.sum(), (-w * np.log(p[np.arange(len(y)), y])).sum() / w.sum(), auroc(p[:, 1], y, w)


@pytest.mark.parametrize("ranges", [1, 4])
def test_two_stage_equals_loops(spark, monkeypatch, ranges):
    rows, table = logit_cells(spark)
    rows += [(i, "H1", None, 0.0, 0.0, 0.0) for i in (5, 130)]  # cells without a label count nowhere
    table = table.unionByName(spark.createDataFrame(rows[-2:], table.schema))
    monkeypatch.setattr(refits, "RANGE", 120 // ranges)
    monkeypatch.setattr(refits, "REPLICATES", 10)
    calib, test = table.where("doc_id < 120").withColumn("rank", F.col("doc_id") + 1), table.where("doc_id >= 120")
    found = {(r["policy"], r["budget"], r["method"], r["replicate"]): r for r in refits.two_stage(calib.repartition(3), test.repartition(5), "doc_id", [40, 120], "s", 20).collect()}
    assert len(found) == 2 * (1 + 2 * 3) * 20
    known = [r for r in rows if r[2] is not None]
    for k in (1, 9, 14, 20):
        of = lambda i, seed: bootstrap.weights(seed, [i], 0, 20)[0, k - 1]
        w_test = {p: np.array([of(r[0], "s-test") for r in known if r[1] == p and r[0] >= 120]) for p in ("H1", "H2")}
        for budget in (40, 120):
            own, variance = {}, {}
            cells = [r for r in known if r[0] < budget]
            w = {p: np.array([of(r[0], "s-calib") for r in cells if r[1] == p]) for p in ("H1", "H2")}
            for p in ("H1", "H2"):
                own[p] = best_log_t([r for r in cells if r[1] == p], w[p])
                z = np.array([r[3:] for r in cells if r[1] == p])
                b = np.exp(-own[p])
                q = np.exp(b * z) / np.exp(b * z).sum(1, keepdims=True)
                m, m2 = (q * z).sum(1), (q * z * z).sum(1)
                y = np.array([r[2] for r in cells if r[1] == p])
                variance[p] = 1 / (w[p] * (b * b * (m2 - m * m) - b * (z[np.arange(len(y)), y] - m))).sum()
            pooled = best_log_t(cells, np.array([of(r[0], "s-calib") for r in cells]))
            between = max(0.0, np.var(list(own.values()), ddof=1) - np.mean(list(variance.values())))
            for p in ("H1", "H2"):
                want = {"global": pooled, "policy": own[p], "shrunk": pooled + between / (between + variance[p]) * (own[p] - pooled)}
                for method, tau in want.items():
                    r = found[p, budget, method, k]
                    assert r["log_t"] == pytest.approx(tau, abs=2e-5)
                    test_cells = [x for x in known if x[1] == p and x[0] >= 120]
                    assert (r["ece"], r["nll"], r["auroc"]) == pytest.approx(brute(test_cells, r["log_t"], w_test[p]))
        for p in ("H1", "H2"):
            r = found[p, 0, "raw", k]
            assert r["log_t"] == 0 and (r["ece"], r["nll"], r["auroc"]) == pytest.approx(brute([x for x in known if x[1] == p and x[0] >= 120], 0.0, w_test[p]))


@pytest.mark.parametrize("ranges", [1, 4])
def test_cells_are_sent_once_for_all_budgets_and_methods(spark, monkeypatch, tmp_path, ranges):
    rows, table = logit_cells(spark)
    cells = sum(r[2] is not None and r[0] >= 120 for r in rows)
    monkeypatch.setattr(refits, "RANGE", 120 // ranges)
    calib, test = table.where("doc_id < 120").withColumn("rank", F.col("doc_id") + 1), table.where("doc_id >= 120")
    own, sent = refits._judge, []
    for budgets in ([40], [40, 60, 80, 120]):
        (folder := tmp_path / str(len(budgets))).mkdir()

        def spied(*a, folder=str(folder)):
            judge = own(*a)

            def counted(key, pdf):
                with open(f"{folder}/{'-'.join(map(str, key))}", "w") as out:
                    out.write(str(sum(len(x) for c in pdf for x in pdf[c] if isinstance(x, bytes))))
                return judge(key, pdf)

            return counted

        monkeypatch.setattr(refits, "_judge", spied)
        assert refits.two_stage(calib.repartition(1), test.repartition(1), "doc_id", budgets, "s", 160).count() == 2 * (1 + 3 * len(budgets)) * 160
        sent.append(sum(int(p.read_text()) for p in folder.iterdir()))
    assert sent[1] < 1.5 * sent[0] and sent[1] < 160 * ranges * cells  # each cell comes with 160 weights and 25 bytes


def test_range_sums_give_the_rank_sum_of_one_sort():
    rng = np.random.default_rng(2)
    score, pos = rng.integers(0, 40, 500) / 40, rng.integers(0, 3, 500).astype(float)
    neg = rng.integers(0, 3, 500) * (pos == 0)
    y = (pos > 0).astype(int)
    whole = refits.won_pairs(score, pos, neg.astype(float)) / (pos.sum() * neg.sum())
    assert whole == pytest.approx(auroc(score, y, pos + neg))
    below = won = 0.0
    for low, high in ((0, 0.1), (0.1, 0.55), (0.55, 0.56), (0.56, 2)):
        own = (score >= low) & (score < high)
        if own.any():
            won += refits.won_pairs(score[own], pos[own], neg[own].astype(float)) + pos[own].sum() * below
        below += neg[own].sum()
    assert won / (pos.sum() * neg.sum()) == pytest.approx(whole)


def test_roots_of_bounds_and_no_weight():
    z, y = np.array([[9.0, 0.0, 0.0]] * 4), np.zeros(4, np.int64)
    s = slopes.slopes(z, y)
    tau, variance = slopes.roots(np.stack([s.sum(0), -s.sum(0), 0 * s[0]], 1), np.array([4.0, 4.0, 0.0]))
    assert tau[0] == pytest.approx(np.log(0.05)) and tau[1] == pytest.approx(np.log(20)) and np.isnan(tau[2]) and np.isnan(variance).all()
    drawn = refits.drawn_together(np.array([[0.1], [9.0]]), np.array([[np.nan], [np.nan]]), np.array([0.5]))
    assert drawn.tolist() == [[0.5], [0.5]]  # unknown variances: the pooled fit


def test_policies_without_calibration_have_raw_rows_only(spark):
    _, table = logit_cells(spark, 40)
    calib = table.where("doc_id < 20 AND policy = 'H1'").withColumn("rank", F.col("doc_id") + 1)
    found = refits.two_stage(calib, table.where("doc_id >= 20"), "doc_id", [20], "s", 5)
    assert {(r["policy"], r["method"]) for r in found.collect()} == {("H2", "raw"), *[("H1", m) for m in ("raw", *refits.METHODS)]}
    assert refits.two_stage(calib.limit(0), table.limit(0), "doc_id", [20], "s", 5).count() == 0


def test_columns_of_one_order_are_sorted_once():
    rng = np.random.default_rng(4)
    score = rng.integers(0, 30, 500) / 30
    pos, neg = (rng.integers(0, 4, (500, 6)).astype(float) for _ in "pn")
    want = [sum(p * (neg[score < s, c].sum() + neg[score == s, c].sum() / 2) for s, p in zip(score, pos[:, c])) for c in range(6)]
    assert refits.won_pairs(score, pos, neg).tolist() == want
    assert [refits.won_pairs(score, pos[:, c], neg[:, c]) for c in range(6)] == want
