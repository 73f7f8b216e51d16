"""Candidates, components, fingerprints, chi-square tails and the omnibus test against plain Python."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.operators import compare, families, integrity, stats


def similar_sets(sets, num=17, den=20):
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * den >= num * len(sets[a] | sets[b])}


def sets_of(seed, n=120):
    """Sets of 1 to 30 tokens, near copies of some, one token in all of them and some frequent ones."""
    rnd, sets = random.Random(seed), {}
    for i in range(n):
        if sets and rnd.random() < 0.5:
            own = set(sets[rnd.choice(list(sets))])
            for _ in range(rnd.randint(0, 3)):
                own.discard(rnd.choice(sorted(own)))
                own.add(f"t{rnd.randint(0, 300)}" if rnd.random() < 0.5 else f"c{rnd.randint(0, 5)}")
        else:
            own = {f"t{rnd.randint(0, 300)}" for _ in range(rnd.randint(0, 29))} | {f"c{rnd.randint(0, 5)}" for _ in range(rnd.randint(0, 6))}
        sets[i] = own | {"in all"}
    return sets


@pytest.mark.parametrize("hot", [2, 10, 500])
def test_candidates_lose_no_similar_pair(spark, hot):
    for seed in (1, 2):
        sets = sets_of(seed)
        nodes = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "node long, tokens array<string>")
        found = families.candidates(nodes, hot=hot)
        want = similar_sets(sets)
        assert len(want) > 50 and {tuple(r) for r in families.similar(nodes, found).collect()} == want
        assert found.count() == found.distinct().count()


def test_a_token_in_all_makes_few_candidates(spark):
    """Sets that share their most frequent tokens only, in buckets of hundreds of nodes."""
    rnd = random.Random(3)
    sets = {i: {"in all", *(f"c{k}" for k in rnd.sample(range(60), 9))} for i in range(600)}
    nodes = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "node long, tokens array<string>")
    found = families.candidates(nodes, hot=20).count()
    shared = sum(1 for a in sets for b in sets if a < b and len(sets[a] & sets[b]) > 1)
    assert {tuple(r) for r in families.similar(nodes, families.candidates(nodes, hot=20)).collect()} == similar_sets(sets)
    assert found < shared / 20 and found < families.candidates(nodes, hot=10**6).count()


@pytest.mark.parametrize("hot", [2, 500])
def test_signatures_lose_no_similar_pair(spark, hot):
    for seed in (1, 2):
        sets = sets_of(seed)
        nodes = spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in sets.items()], "node long, words string")
        own = nodes.select("node", F.split("words", " ").alias("tokens"))
        found = families.candidates(own, hot=hot, signed=True)
        # a set's words are split only where a pair has met
        words = families.similar(nodes, found, column="words", tokens=lambda c: F.split(c, " "))
        want = similar_sets({i: set(" ".join(sorted(s)).split()) for i, s in sets.items()})
        assert {tuple(r) for r in words.collect()} == want and found.count() < families.candidates(own, hot=hot).count()


def test_no_token_leaves_its_row_before_its_prefix_is_cut(spark):
    """Of long sets without common tokens few entries are shuffled, and a frequent token is in no prefix."""
    nodes = spark.range(200).select(F.col("id").alias("node"), F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: F.when(k < 50, F.concat(F.lit("all"), k)).otherwise(F.concat_ws(":", "id", k))).alias("tokens"))
    hashed = nodes.select("node", F.transform("tokens", lambda t: F.xxhash64(t)).alias("h"))
    placed = families._placed(hashed, 17, 20)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    rows = placed.collect()
    often = {r[0] for r in spark.range(50).select(F.xxhash64(F.concat(F.lit("all"), "id"))).collect()}
    assert {len(r["prefix"]) for r in rows} == {17} and not often & {t for r in rows for t in r["prefix"]}
    assert families.candidates(nodes).count() == 0


def test_only_frequent_tokens_are_counted_for_crowded_buckets(spark):
    """A prefix says how many of its tokens are rare; crowded tokens are split all the same."""
    mixed = [(i, [f"all{k}" for k in range(50)] + [f"{i}:{k}" for k in range(k_rare)]) for i, k_rare in enumerate([50, 3, 0, 0])]
    hashed = spark.createDataFrame(mixed, "node long, t array<string>").select("node", F.transform("t", lambda t: F.xxhash64(t)).alias("h"))
    rows = {r["node"]: r for r in families._placed(hashed, 17, 20).collect()}
    often = {r[0] for r in spark.range(50).select(F.xxhash64(F.concat(F.lit("all"), "id"))).collect()}
    assert [rows[i]["rare"] for i in range(4)] == [17, 3, 0, 0]
    assert all(not often & set(r["prefix"][: r["rare"]]) and often >= set(r["prefix"][r["rare"] : r["lead"]]) for r in rows.values())


def test_only_texts_of_nodes_in_a_pair_are_shuffled(spark, tmp_path):
    spark.range(3000).select(F.col("id").alias("node"), F.concat(F.lit("a b c d e f g "), F.col("id")).alias("words")).write.parquet(f"{tmp_path}/nodes")
    nodes = spark.read.parquet(f"{tmp_path}/nodes")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (5, 2000)], "a long, b long")
    found = families.similar(nodes, pairs, num=7, den=9, column="words", tokens=lambda c: F.split(c, " "))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2
    assert sorted(map(tuple, found.collect())) == [(1, 2), (1, 3), (5, 2000)]
    assert families.similar(nodes, pairs, num=8, den=9, column="words", tokens=lambda c: F.split(c, " ")).count() == 0


def brute_components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_components_of_random_graphs(spark):
    rnd = random.Random(5)
    for n, m in ((1, 0), (60, 20), (60, 60), (300, 280)):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
        table = spark.createDataFrame(edges, "a long, b long")
        found = families.components(spark.range(n).withColumnRenamed("id", "node"), table.unionByName(table)).collect()
        assert {r["node"]: r["component"] for r in found} == brute_components(range(n), edges)


def test_components_of_a_path_in_few_rounds_over_ever_fewer_edges(spark):
    n, seen = 20_000, []
    path = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))

    def store(df):
        kept = families.saved(df)
        if set(kept.columns) == {"a", "b"}:
            seen.append(kept.count())
        return kept

    found = families.linked_components(path, store)
    assert found.agg(F.count("*"), F.max("component")).first() == (n, 0)
    assert len(seen) < 16 and all(2 * b < a or a < 50 for a, b in zip(seen, seen[1:]))


def test_fingerprint_is_of_a_multiset(spark):
    rows = [(1, "a"), (2, "b"), (2, "b"), (3, None)]
    of = lambda r: tuple(integrity.fingerprint(spark.createDataFrame(r, "k long, v string")).first())
    whole = of(rows)
    assert of(rows[::-1]) == whole and whole[0] == 4
    for other in (rows + [(2, "b")], rows[:2] + rows[3:], rows[:-1], [(1, "b"), (2, "a"), *rows[2:]], rows[:-1] + [(3, "")], []):
        assert of(other) != whole
    swapped = spark.createDataFrame(rows, "k long, v string").select("v", "k")
    assert tuple(integrity.fingerprint(swapped).first()) == whole
    plan = integrity.fingerprint(swapped)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "partial_sum" in plan


def test_fingerprint_hashes_all_sorted_digests_in_parts(spark):
    rows = [(i % 3000, None if i % 7 == 0 else f"v{i % 50}") for i in range(6000)]
    parts = {}
    for k, v in rows:
        h = hashlib.sha256(json.dumps({"k": k, "v": v}, separators=(",", ":")).encode()).hexdigest()
        parts.setdefault(h[:3], []).append(h)
    of = lambda texts: hashlib.sha256("".join(texts).encode()).hexdigest()
    want = of(of(sorted(parts[p])) for p in sorted(parts))
    table = spark.createDataFrame(rows, "k long, v string").repartition(7)
    assert tuple(integrity.fingerprint(table).first()) == (6000, want)
    assert tuple(integrity.fingerprint(table.where("k < 0")).first()) == (0, of([]))


def test_chi_square_tail_is_a_column(spark):
    cases = [(x, df) for df in (1, 2, 3, 4, 7, 10, 19, 100, 999) for x in (0.0, 1e-6, 0.3, 1.0, df * 0.5, df - 0.5, df + 2.5, df * 1.5, df * 3.0 + 10)]
    found = spark.createDataFrame(cases, "x double, df long").withColumn("p", stats.chi2_tail(F.col("x"), F.col("df"))).collect()
    for r in found:
        assert r["p"] == pytest.approx(stats.chi2_sf(r["x"], r["df"]), rel=1e-8, abs=1e-300), (r["x"], r["df"])
    assert stats.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05) and math.exp(-1) == pytest.approx(stats.chi2_sf(2.0, 2))
    none = spark.createDataFrame([(None, 3), (1.0, 0), (1.0, None)], "x double, df long").select(stats.chi2_tail(F.col("x"), F.col("df")).alias("p"))
    assert [r["p"] for r in none.collect()] == [None] * 3


def test_cochran_q_of_every_state(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 3, (80, 4))
    rows = [(i, f"P{j}", None if (i, j) == (5, 2) else int(y[i, j])) for i in range(80) for j in range(4)]
    found = {r["state_id"]: r for r in stats.cochran_q(spark.createDataFrame(rows, "doc_id long, policy string, state_id int").repartition(3)).collect()}
    whole = np.delete(y, 5, 0)  # a record with a missing cell is left out
    for k in range(3):
        x = (whole == k).astype(int)
        q = 3 * (4 * (x.sum(0) ** 2).sum() - x.sum() ** 2) / (4 * x.sum() - (x.sum(1) ** 2).sum())
        assert (found[k]["n"], found[k]["q"], found[k]["df"], found[k]["p"]) == (79, pytest.approx(q), 3, pytest.approx(stats.chi2_sf(q, 3)))
    same = spark.createDataFrame([(i, f"P{j}", 1) for i in range(5) for j in range(3)], "doc_id long, policy string, state_id int")
    assert all(r["q"] is None and r["p"] is None for r in stats.cochran_q(same).collect())


def omnibus_of(spark, boot, est):
    names = [f"H{j}" for j in range(len(est))]
    rows = [(p, b, None if np.isnan(boot[b, j]) else float(boot[b, j])) for b in range(len(boot)) for j, p in enumerate(names)]
    values = spark.createDataFrame(rows, "policy string, replicate int, value double").repartition(3)
    return compare.omnibus(values, spark.createDataFrame(list(zip(names, map(float, est))), "policy string, value double"), "policy").first()


def test_omnibus_equals_the_quadratic_form(spark):
    rng = np.random.default_rng(9)
    mix = rng.normal(0, 1, (5, 5))
    for shift in (0.0, 2.0):
        est = np.array([0.3, 0.1, 0.2, 0.15, 0.25]) + shift * np.array([0, 0, 0, 0, 1])
        boot = est + rng.normal(0, 1, (200, 5)) @ mix * 0.3
        boot[17, 2] = np.nan  # a replicate that lacks a policy does not count
        r = omnibus_of(spark, boot, est)
        whole = boot[np.isfinite(boot).all(1)]
        c = np.eye(5)[:4] - np.eye(5)[4]
        inverse = np.linalg.inv(c @ np.cov(whole, rowvar=False) @ c.T)
        stat = (c @ est) @ inverse @ (c @ est)
        d = (whole - est) @ c.T
        p = (1 + (np.einsum("bi,ij,bj->b", d, inverse, d) >= stat).sum()) / (1 + len(whole))
        assert (r["evaluable"], r["rank"], r["n_valid"]) == (True, 4, 199)
        assert (r["statistic"], r["p"]) == (pytest.approx(stat), pytest.approx(p))


def test_omnibus_is_not_evaluable_without_full_rank(spark):
    rng = np.random.default_rng(10)
    est = np.array([0.3, 0.1, 0.2, 0.4])
    boot = est + rng.normal(0, 1, (60, 4))
    boot[:, 3] = boot[:, 2] + 0.2  # two policies move as one
    r = omnibus_of(spark, boot, est)
    assert (r["evaluable"], r["rank"], r["statistic"], r["p"]) == (False, 2, None, None) and "rank 2 of 3" in r["reason"]
    assert not omnibus_of(spark, boot[:1], est)["evaluable"] and not omnibus_of(spark, boot, np.array([0.3, np.nan, 0.2, 0.4]))["evaluable"]
    constant = omnibus_of(spark, np.tile(est, (10, 1)), est)
    assert not constant["evaluable"] and constant["rank"] == 0


def test_a_group_of_near_copies_sends_few_texts(spark, tmp_path):
    """All pairs of a group are compared, though each text is shuffled once a tile and side, not once a pair."""
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(base[:57] + [f"own{i}", f"own{i % 7}", f"own{i % 11}"])) for i in range(100)] + [(200 + i, " ".join(f"x{i // 2}:{k}" for k in range(20 + i % 2))) for i in range(40)]
    spark.createDataFrame(rows, "node long, words string").write.parquet(f"{tmp_path}/nodes")
    nodes, sets = spark.read.parquet(f"{tmp_path}/nodes"), {i: set(w.split()) for i, w in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and (b < 200 or a >= 200)]
    tiles, met = families._tiles(nodes.select("node", F.length("words").alias("w")), spark.createDataFrame(pairs, "a long, b long"))
    assert {(r["a"], r["b"]) for r in tiles.collect()} == set(pairs) and tiles.count() == len(pairs) and met.count() == len(rows)
    assert tiles.select("tile", "a").distinct().count() + tiles.select("tile", "b").distinct().count() <= 4 * len(rows)
    found = families.similar(nodes, spark.createDataFrame(pairs, "a long, b long"), column="words", tokens=lambda c: F.split(c, " "))
    assert sorted(map(tuple, found.collect())) == sorted(similar_sets(sets))


def test_blocks_split_a_large_group_and_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(families, "BLOCK", 3000)
    sets = sets_of(4, 200)
    nodes = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "node long, tokens array<string>")
    every = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "a long, b long")
    assert families._tiles(nodes.select("node", F.lit(100).cast("long").alias("w")), every)[0].select("tile").distinct().count() > 50
    assert sorted(map(tuple, families.similar(nodes, every).collect())) == sorted(similar_sets(sets))
    assert families.similar(nodes, every.where("a < 0")).count() == 0


def test_unlike_long_texts_are_no_candidates(spark):
    """Parities at 256 places tell nothing of sets of thousands of tokens; counts do, and lose no similar pair."""
    rnd, sets = random.Random(7), {}
    for i in range(24):
        sets[i] = set(rnd.sample(range(9000), rnd.randint(2000, 2100)))
        for k in (80, 140):  # two near copies, like their source and not like each other
            copy = set(rnd.sample(sorted(sets[i]), len(sets[i]) - rnd.randint(k - 20, k + 20)))
            sets[k * 10 + i] = copy | {10_000 * k + 1000 * i + j for j in range(len(sets[i]) - len(copy))}
    nodes = spark.createDataFrame([(i, [f"t{t}" for t in sorted(s)]) for i, s in sets.items()], "node long, tokens array<string>")
    found = {tuple(r) for r in families.candidates(nodes, signed=True).collect()}
    want = similar_sets(sets)
    assert len(want) == 48 and want <= found and len(found) <= 24 * 3


def test_entries_of_prefixes_are_not_broadcast(spark):
    """A small table of long prefixes explodes to far more than Spark's estimate of it."""
    rows = spark.range(50).select(F.col("id").alias("node"), F.lit(9).cast("long").alias("n"), F.lit(1).alias("k"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("t"))
    plan = families._meet(rows, 17, 20)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
