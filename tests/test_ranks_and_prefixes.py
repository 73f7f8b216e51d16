"""Ranks of skewed groups, balanced orders and quotas, draws, against plain Python."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.operators import metrics, prefixes, ranks, sampling


def one_by_one(quotas):
    """The balanced order by its definition: always the stratum that lacks most of its share."""
    names, given, out = list(quotas), dict.fromkeys(quotas, 0), []
    for n in range(1, sum(quotas.values()) + 1):
        lack = {s: Fraction(quotas[s] * n, sum(quotas.values())) - given[s] for s in names}
        most = max(lack.values())
        chosen = next(s for s in names if lack[s] == most)
        given[chosen] += 1
        out.append((chosen, given[chosen], n))
    return out


@pytest.mark.parametrize("block", [3, 50, 1 << 18])
def test_positions_equal_one_walk(spark, block):
    rnd = random.Random(block)
    for quotas in ({"a": 6, "b": 3, "c": 1}, {"y": 1, "x": 1}, {"a": 0, "b": 4}, {f"s{k}": rnd.randint(0, 40) for k in range(9)}, {"hot": 150, "b": 1, "c": 49}):
        found = prefixes.positions(spark, quotas, block=block).collect()
        assert sorted((r["stratum"], r["place"], r["position"]) for r in found) == sorted(one_by_one(quotas))
    assert prefixes.positions(spark, {"a": 0}).count() == 0
    with pytest.raises(ValueError):
        prefixes.positions(spark, {"a": -1})


def test_a_wrong_guess_is_walked_again(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "_guess", lambda quotas, n: [n] + [0] * (len(quotas) - 1))
    quotas = {"a": 20, "b": 31, "c": 9}
    found = prefixes.positions(spark, quotas, block=8).collect()
    assert sorted((r["stratum"], r["place"], r["position"]) for r in found) == sorted(one_by_one(quotas))


def test_balanced_prefixes_of_rows(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(60)] + [(99, "other"), (98, None)], "id long, s string")
    placed = {r["position"]: r for r in prefixes.balanced_prefixes(rows, "s", F.sha2(F.col("id").cast("string"), 256), ["a", "b", "none"]).collect()}
    assert sorted(placed) == list(range(1, 61)) and set(placed[1].asDict()) == {"id", "s", "place", "position"}
    assert all(abs(sum(placed[k]["s"] == "a" for k in range(1, n + 1)) - n * 2 / 3) <= 1 for n in range(1, 61))


def poured(capacity, total):
    """Quotas by their definition, one row at a time."""
    out = {s: 0 for s, c in capacity.items() if c}
    for _ in range(total):
        s = min((s for s in out if out[s] < capacity[s]), key=lambda s: (out[s], Fraction(out[s], capacity[s]), s))
        out[s] += 1
    return out


def test_balanced_quotas(spark):
    rnd = random.Random(7)
    cases = [({"a": 1, "b": 5, "c": 9}, 9), ({"a": 3, "b": 100}, 3), ({"a": 2, "b": 2}, 4), ({"a": 2, "b": 0}, 0), ({"a": 2, "b": 7, "c": 2}, 2)]
    cases += [(c, rnd.randint(0, sum(c.values()))) for c in ({f"s{k}": rnd.randint(0, 12) for k in range(rnd.randint(1, 9))} for _ in range(12))]
    for capacity, total in cases:
        table = spark.createDataFrame(list(capacity.items()), "s string, c long")
        assert {r["s"]: r["quota"] for r in prefixes.balanced_quotas(table, "s", "c", total).collect()} == poured(capacity, total)
    beyond = prefixes.balanced_quotas(spark.createDataFrame([("a", 1)], "s string, c long"), "s", "c", 2)
    assert beyond.first()["quota"] is None


def skewed(spark, n=20_000):
    """99 % of the scores within a thousandth, half of all equal, and a group that is null."""
    rng = np.random.default_rng(4)
    rows = [("hot" if k % 10 else None, k, 0.9991 if k % 2 else float(rng.random() if k % 100 == 0 else 0.999 + rng.random() / 1000), int(rng.integers(0, 2))) for k in range(n)]
    return rows, spark.createDataFrame(rows, "g string, id long, score double, y int").repartition(6)


def test_ranks_of_skewed_scores(spark):
    rows, table = skewed(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        sizes = [r["n"] for r in ranks._parts(table, ["g"], ["score", "id"]).groupBy("_part").agg(F.count("*").alias("n")).collect()]
        assert len(sizes) > 10 and max(sizes) < 2 * len(rows) / 16
        found = {r["id"]: (r["rank"], r["total"]) for r in ranks.ranked(table, ["g"], "score", "id").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for g in ("hot", None):
        own = sorted((r[2], r[1]) for r in rows if r[0] == g)
        assert [found[i] for _, i in own] == [(k, len(own)) for k in range(1, len(own) + 1)]


def test_tiles_quantiles_and_area_of_skewed_scores(spark):
    rows, table = skewed(spark, 3000)
    own = sorted((r[2], r[1]) for r in rows if r[0] == "hot")
    tiles = {r["id"]: r["t"] for r in ranks.ntile(table, ["g"], "score", "id", 7, "t").where("g = 'hot'").collect()}
    parts = np.array_split([i for _, i in own], 7)
    assert all(tiles[i] == k + 1 for k, part in enumerate(parts) for i in part)
    values = {r["g"]: r["values"] for r in ranks.quantiles(table, ["g"], "score", "id", [0.1, 0.5, 0.995]).collect()}
    assert values["hot"] == pytest.approx(np.quantile([s for s, _ in own], [0.1, 0.5, 0.995]).tolist())
    area = {r["g"]: r["auroc"] for r in metrics.auroc(table.withColumnRenamed("y", "state_id").withColumnRenamed("score", "p1"), ["g"]).collect()}
    for g in ("hot", None):
        pos, neg = (np.array([r[2] for r in rows if r[0] == g and r[3] == y]) for y in (1, 0))
        assert area[g] == pytest.approx(((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / len(pos) / len(neg))


def test_drawn_rows_carry_their_population(spark):
    rows = spark.createDataFrame([(k, None if k % 5 == 0 else "hot") for k in range(100)], "id long, s string")
    drawn = sampling.stratified_draw(rows, ["s"], ["id"], 3)
    assert sorted((r["id"], r["place"], r["population"]) for r in drawn.collect()) == [(0, 1, 20), (1, 1, 80), (2, 2, 80), (3, 3, 80), (5, 2, 20), (10, 3, 20)]
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
