import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from auditlake.functions import parse, text
from auditlake.operators import audit, bootstrap, families, integrity, metrics, sampling, stats

CELLS = "doc_id long, variant string, policy string, state_id int, p0 double, p1 double, p2 double, conf double, pred int, correct int"


def cells(spark, probs, labels):
    rows = []
    for i, (p, y) in enumerate(zip(probs, labels)):
        pred = p.index(max(p))
        rows.append((i, "D0", "H1", y, *p, max(p), pred, None if y is None else int(pred == y)))
    return spark.createDataFrame(rows, CELLS)


def test_two_rows_give_calibration_error_of_a_fifth(spark):
    c = cells(spark, [(0.8, 0.1, 0.1), (0.1, 0.8, 0.1)], [0, 1])
    assert metrics.ece(c, ["policy"], bins=2).first()["ece"] == pytest.approx(0.2)
    assert metrics.adaptive_ece(c, ["policy"], "doc_id", bins=2).first()["ece"] == pytest.approx(0.2)


def test_perfect_predictor_and_missing_label(spark):
    hit = lambda y: tuple(0.99 if k == y else 0.005 for k in range(3))
    labels = [0, 1, 2, 0, 1, 2]
    c = cells(spark, [hit(y) for y in labels], labels)
    assert metrics.rates(c, ["policy"]).first()["f1"] == 1
    assert metrics.auroc(c, ["policy"]).first()["auroc"] == 1
    assert metrics.ece(c, ["policy"]).first()["ece"] < 0.02
    more = cells(spark, [hit(y) for y in labels] + [hit(0)], [*labels, None])
    assert metrics.nll_brier(more, ["policy"]).first() == metrics.nll_brier(c, ["policy"]).first()


def test_f1_is_null_with_one_class(spark):
    assert metrics.rates(cells(spark, [(0.1, 0.8, 0.1)], [1]), ["policy"]).first()["f1"] is None


def test_gate_flips_at_two_percent_missing(spark):
    def gate(missing):
        rows = [(i, "D0", "H1", None if i < missing else 0) for i in range(100)]
        return audit.reference_gate(spark.createDataFrame(rows, "doc_id long, variant string, policy string, state_id int")).first()["passes"]

    assert gate(1) and not gate(2)


def test_normalize_text(spark):
    rows = spark.createDataFrame([("Alpha—beta,\n gamma's test.",), ("  ＡBC\n  DeF\t",), (None,)], "t string")
    found = [r[0] for r in rows.select(text.normalize_text(F.col("t"))).collect()]
    assert found == ["alpha beta gamma s test", "abc def", None]


def test_normalize_text_of_every_document(spark, tmp_path):
    def brute(t):
        low = unicodedata.normalize("NFKC", t).lower()
        return " ".join("".join(" " if c.isspace() or unicodedata.category(c).startswith("P") else c for c in low).split())

    texts = [("en", "Alpha, beta."), ("de", "Straße—ÜBER „Öl“ ﬁn"), ("fr", "« L’été » cafe\u0301 ÉCOLE…"), ("es", "¿Año? ¡SÍ! ªº"), ("el", "ΟΔΟΣ ΣΑΣ·"), ("tr", "İI"), ("ja", "ＡＢ、ｶﾞ。"), ("xx", ""), ("xx", "  ...")]
    texts += [(None, "X".join(c for c in map(chr, range(0x3001)) if c.isspace())), ("en", "a+b = c^2 $5")]
    rows = [(i, t, lang) for i, (lang, t) in enumerate(texts)]
    spark.createDataFrame([*rows, (99, None, "de")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["h"] for r in entry.queries()["normalize_text_all"](spark, str(tmp_path)).collect()}
    assert found == {**{i: hashlib.sha256(brute(t).encode()).hexdigest() for i, t, _ in rows}, 99: None}


def test_families_of_every_script(spark, tmp_path):
    def canonical(t):
        low = unicodedata.normalize("NFKC", t).lower()
        return " ".join("".join(" " if c.isspace() or unicodedata.category(c).startswith("P") else c for c in low).split())

    def shingles(t):
        w = canonical(t).split()
        return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {"<short> " + " ".join(w)}

    russian, greek = " ".join(f"дом{chr(0x430 + k % 30)}{k}" for k in range(60)), " ".join(f"λόγ{chr(0x3B1 + k % 15)}{k}" for k in range(60))
    texts = ["año", "año", "ano", "äno", "an\u0303o", "мир", "дом", russian, greek, russian + " ещё", "ＡＢ one two three four five", "ab one two three four five", greek.upper()]
    ids = range(5, 5 + len(texts))
    spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    nodes = {}
    for i, t in zip(ids, texts):
        nodes.setdefault(canonical(t), []).append(i)
    first = {min(v): (shingles(t), v, t) for t, v in nodes.items()}
    pairs = {(a, b) for a in first for b in first if a < b and len(first[a][0] & first[b][0]) * 20 >= 17 * len(first[a][0] | first[b][0])}
    part = {a: a for a in first}
    for _ in first:
        for a, b in pairs:
            part[a] = part[b] = min(part[a], part[b])
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    assert pairs and {(r["a"], r["b"]) for r in run("family_similar_pairs_all")} == pairs
    expected = {}
    for a, (_, members, t) in first.items():
        prints, n, old = expected.get(part[a], ([], 0, False))
        expected[part[a]] = ([*prints, hashlib.sha256(t.encode()).hexdigest()], n + 1, old or any(i % 5 == 0 for i in members))
    assert {r["component"]: (r["family_id"], r["size"], r["has_historical"]) for r in run("family_components_all")} == {c: ("qf_" + min(p)[:24], n, old) for c, (p, n, old) in expected.items()}
    assert {(r["node"], r["component"]) for r in run("family_exclusion_all")} == {(a, c) for a, c in part.items() if not expected[c][2]}


@pytest.mark.parametrize(
    "reply, cells_, strict",
    [('ok {"A": "satisfied", "B": "violated"} end', 2, True), ('{"A": "satisfied", "A": "violated", "B": "violated"}', 1, False), ("{'A': 'satisfied'}", 0, False), ('{"A": "maybe", "B": "violated", "C": 1}', 1, False), ("", 0, False), (None, 0, False), ("}{", 0, False)],
)
def test_parse_reply(reply, cells_, strict):
    out = parse.parse_reply(reply, ("A", "B"), dict(zip(text.STATES, text.STATES)))
    assert (len(out["cells"]), out["strict"]) == (cells_, strict)


def test_families_are_transitive_and_exact(spark):
    base = [f"t{i}" for i in range(20)]
    middle = base[:-1] + ["m"]
    tail = middle[:-2] + ["u", "m"]
    other = [f"t{i}" for i in range(17)] + ["x", "y", "z"]
    nodes = spark.createDataFrame([(1, base), (2, middle), (3, tail), (4, other)], "node long, tokens array<string>")
    edges = families.similar(nodes, families.candidates(nodes))
    assert sorted(map(tuple, edges.collect())) == [(1, 2), (2, 3)]
    assert {r["node"]: r["component"] for r in families.components(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_exact_split_does_not_depend_on_partitions(spark):
    rows = spark.range(500).withColumnRenamed("id", "doc_id")
    split = lambda n: sorted(map(tuple, sampling.exact_split(rows.repartition(n), text.digest("s", F.col("doc_id")), {"a": 120, "b": 30}).select("doc_id", "split").collect()))
    one = split(1)
    assert one == split(7) and [s for _, s in one].count("a") == 120 and len(one) == 150


def test_majority_tie_is_null(spark):
    votes = spark.createDataFrame([(1, True), (1, False), (2, True), (2, True), (2, False)], "unit long, flag boolean")
    assert {r["unit"]: r["flag"] for r in audit.majority(votes, "unit", ["flag"]).collect()} == {1: None, 2: True}


def test_review_merge(spark):
    t = lambda rows: spark.createDataFrame(rows, "id string, label string")
    out = integrity.merge_reviews(t([("a0", "x"), ("a1", "x")]), t([("a0", "x"), ("a1", "y")]), t([("a1", "y")]), "id", "label")
    assert {r["id"]: (r["label"], r["status"]) for r in out.collect()} == {"a0": ("x", "agree"), "a1": ("y", "adjudicated")}


def test_formula_escape(spark):
    rows = spark.createDataFrame([("=f",), ("plain",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.escape_formula(F.col("t"))).collect()] == ["'=f", "plain", None]


def test_aliases_and_the_last_of_repeated_keys(spark):
    known = {"ok": "satisfied", "fail": "violated", "n/a": "not_applicable"}
    replies = ['{"A": " OK ", "B": "n/a", "C": 1}', '{"A": "ok", "A": "fail", "B": "ok"}', '{"A": "ok"}', "[" * 100_000 + "{" + "}", None, "[1, {}]"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(replies)], "i int, t string")
    found = {r["i"]: r["x"] for r in rows.select("i", parse.parse_labels(F.col("t"), ("A", "B"), known).alias("x")).collect()}
    assert found == {0: {"A": "satisfied", "B": "not_applicable"}, 1: {"A": "violated", "B": "satisfied"}, 2: None, 3: None, 4: None, 5: None}
    cells_ = {r["i"]: r["x"] for r in rows.select("i", parse.parse_cells(F.col("t"), ("A", "B"), known).alias("x")).collect()}
    assert cells_[0]["extra"] == ["C"] and not cells_[0]["strict"] and cells_[1]["duplicate"] == ["A"] and cells_[2]["missing"] == ["B"]
    assert [cells_[i]["json_object_found"] for i in range(6)] == [True, True, True, True, False, True]


def test_chi2():
    assert stats.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)


def test_bootstrap_weights_are_poisson(spark):
    w = spark.range(2000).select(bootstrap.poisson_weight("s", F.col("id"), F.lit(1)).alias("w"))
    mean, var = w.agg(F.avg("w"), F.variance("w")).first()
    assert abs(mean - 1) < 0.1 and abs(var - 1) < 0.15


def test_identical_replicates_give_the_estimate(spark):
    values = spark.createDataFrame([("H1", k, 0.5) for k in range(10)], "policy string, replicate int, value double")
    row = bootstrap.simultaneous(values, spark.createDataFrame([("H1", 0.5)], "policy string, value double"), "policy").first()
    assert (row["low"], row["high"]) == (0.5, 0.5)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_contrasts():
    from auditlake.operators import compare

    h = compare.helmert(4)
    assert abs(h @ h.T).round(9).tolist() == [[1, 0, 0], [0, 1, 0], [0, 0, 1]] and abs(h.sum(1)).max() < 1e-9


def test_shrink_to_the_pooled_fit(spark):
    from auditlake.operators import compare

    rows = spark.createDataFrame([("H1", 0.1, 1.0), ("H2", 0.3, 1.0)], "policy string, log_t double, variance double")
    assert {round(r["log_t"], 9) for r in compare.shrink(rows, 0.5).collect()} == {0.5}
    wide = spark.createDataFrame([("H1", -9.0, 1e-6), ("H2", 9.0, 1e-6)], "policy string, log_t double, variance double")
    assert sorted(round(r["log_t"], 3) for r in compare.shrink(wide, 0.0).collect()) == [-2.996, 2.996]  # clipped


def test_permutations_and_choices(spark):
    import itertools

    import numpy as np

    points = [("a", 1.0, 1.0), ("b", 2.0, 1.5), ("c", 3.0, 3.5), ("d", 4.0, 3.0), ("e", 5.5, 4.0)]
    row = stats.permutation_test(spark.createDataFrame(points, "l string, x double, y double"), "l", "x", "y").first()
    x, y = np.array([p[1] for p in points]), np.array([p[2] for p in points])

    def figures(v):
        left = [v[k] - np.polyval(np.polyfit(np.delete(x, k), np.delete(v, k), 1), x[k]) for k in range(len(x))]
        return np.polyfit(x, v, 1)[0], 1 - np.sum(np.square(left)) / np.sum((v - v.mean()) ** 2)

    every = np.array([figures(np.array(v)) for v in itertools.permutations(y)])
    seen = figures(y)
    assert row["n_orders"] == 120 and (row["slope"], row["loo_r2"]) == pytest.approx(seen)
    assert (row["p_slope"], row["p_loo_r2"]) == pytest.approx(tuple((every >= np.array(seen) - 1e-12).mean(0)))
    rows = spark.createDataFrame([(1, ["", None, "a"]), (2, []), (3, ["b", "c"])], "id long, x array<string>")
    found = {r[0]: r[1] for r in rows.select("id", sampling.choose_one(F.col("x"), text.digest("c", F.col("id")))).collect()}
    assert found[1] == "a" and found[2] is None and found[3] in ("b", "c")
    groups = spark.createDataFrame([(1, ["x"]), (2, ["x"]), (3, ["y"]), (4, ["y"])], "id long, g array<string>")
    assert {r["id"] for r in sampling.floor_then_fill(groups, "id", "g", ["id"], 1, 3).collect()} == {1, 2, 3}


def test_logistic_calibration_recovers_the_line(spark):
    import math

    rows = []
    for i in range(400):
        x = (i % 20 - 10) / 4
        p = 1 / (1 + math.exp(-x))
        q = 1 / (1 + math.exp(-(0.3 + 0.5 * x)))
        rows.append(("D0", p, int((i // 20 + 0.5) / 20 < q)))
    row = stats.logistic_calibration(spark.createDataFrame(rows, "variant string, p1 double, y int"), ["variant"], "p1", "y").first()
    assert abs(row["slope"] - 0.5) < 0.1 and abs(row["intercept"] - 0.3) < 0.1


def logit_cells(spark, n=240):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        for p, t in (("H1", 0.5), ("H2", 2.5)):
            z = rng.normal(0, 2, 3)
            q = np.exp(z / t - (z / t).max())
            rows.append((i, p, int(rng.choice(3, p=q / q.sum())), *z.tolist()))
    return rows, spark.createDataFrame(rows, "doc_id long, policy string, state_id int, z0 double, z1 double, z2 double")


def best_log_t(rows, w):
    """log T of least weighted NLL, by a grid that is refined."""
    import numpy as np

    z, y = np.array([r[3:] for r in rows]), np.array([r[2] for r in rows])
    low, high = np.log(0.05), np.log(20)
    for _ in range(12):
        grid = np.linspace(low, high, 21)
        cost = []
        for t in grid:
            s = z / np.exp(t)
            cost.append((w * (np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(y)), y])).sum())
        k = int(np.argmin(cost))
        low, high = grid[max(k - 1, 0)], grid[min(k + 1, 20)]
    return (low + high) / 2


def test_temperature_fits(spark):
    import numpy as np

    rows, table = logit_cells(spark)
    for r in stats.fit_temperature(table, ["policy"]).collect():
        assert np.log(r["temperature"]) == pytest.approx(best_log_t([x for x in rows if x[1] == r["policy"]], 1.0), abs=1e-5) and not r["at_bound"]
    sure = spark.createDataFrame([(i, "H1", 0, 9.0, 0.0, 0.0) for i in range(20)], table.schema)
    assert [(r["temperature"], r["at_bound"]) for r in stats.fit_temperature(sure, ["policy"]).collect()] == [(pytest.approx(0.05), True)]


def test_learning_curve(spark):
    from auditlake.operators import recalibrate

    _, table = logit_cells(spark)
    curve = recalibrate.learning_curve(table.where("doc_id < 60"), table.where("doc_id >= 60 AND doc_id < 160").withColumn("rank", F.col("doc_id") - 59), table.where("doc_id >= 160"), [20, 100])
    found = {(r["budget"], r["method"]): r for r in curve.collect()}
    assert len(found) == 10 and found[100, "policy"]["mean_nll"] < found[100, "raw"]["mean_nll"] and found[100, "raw"]["reduction"] == 0
    assert found[20, "raw"]["mean_ece"] == found[100, "raw"]["mean_ece"] and found[100, "source"]["recovery"] == 0
    small = {r["method"]: r["budget"] for r in recalibrate.smallest_budget(curve, found[100, "policy"]["mean_ece"]).collect()}
    assert small["policy"] in (20, 100)


def test_bootstrap_sums_do_not_depend_on_partitions(spark):
    rows = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("k"), (F.col("id") * 1.0).alias("v"))
    one, many = ({(r["k"]): r["v"] for r in bootstrap.weighted_sums(rows.repartition(n), "doc_id", ["k"], ["v"], "s", 12).collect()} for n in (1, 5))
    w = {(r["id"], r["r"]): r["w"] for r in spark.range(300).select("id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("r")).withColumn("w", bootstrap.poisson_weight("s", F.col("id"), F.col("r"))).collect()}
    for k in (0, 1):
        brute = [sum(i * w[i, r] for i in range(k, 300, 2)) for r in range(1, 13)]
        assert one[k] == many[k] == brute


def test_files(spark, tmp_path):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    from auditlake.sources import files

    schema = StructType([StructField("id", StringType()), StructField("n", LongType())])
    (tmp_path / "a.jsonl").write_text('{"id": "a", "n": 1}\n\n  \n{"id": "b"\n[1]\n7\n{"n": 2}\n{"id": "", "n": 3}\n{"id": "c"}\n{"id": "c", "n": 4}\n{"id": "d", "n": null, "x": 5}\n')
    good, bad = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema)
    assert sorted(map(tuple, good.collect())) == [("a", 1), ("d", None)]
    counts = {}
    for r in bad.collect():
        counts[r["reason"]] = counts.get(r["reason"], 0) + r["n"]
    assert counts == {"blank line": 2, "invalid line": 3, "missing key": 1, "empty key": 1, "duplicate key": 2}
    (tmp_path / "b.json").write_text('[{"id": "x", "n": 1},\n {"id": "y"}]')
    assert files.read_json_array(spark, str(tmp_path / "b.json"), schema).count() == 2
    files.write_once(good, str(tmp_path / "out"))
    with pytest.raises(Exception, match="exists"):
        files.write_once(good, str(tmp_path / "out"))
    sheet = spark.createDataFrame([("1", '=sum("x")\nnext'), ("2", "plain")], "id string, text string")
    files.write_worksheet(sheet, str(tmp_path / "sheet"), ["text"])
    columns = StructType([StructField(c, StringType()) for c in ("id", "text", "label")])
    rows, wrong = files.read_worksheet(spark, str(tmp_path / "sheet"), columns, ["yes"])
    assert rows.count() == 0 and {r["text"] for r in wrong.collect()} == {"'=sum(\"x\")\nnext", "plain"}


def test_ranks_against_sorting(spark):
    import numpy as np

    from auditlake.operators import ranks

    rng = np.random.default_rng(2)
    rows = [(i, f"g{i % 3}" if i % 7 else "g0", float(rng.choice([0.0, 0.25, 0.5, 1.0, rng.random()]))) for i in range(700)] + [(900 + i, "small", 0.5) for i in range(4)]
    table = spark.createDataFrame(rows, "id long, g string, v double").repartition(5)
    tiles = {r["id"]: r["t"] for r in ranks.ntile(table, ["g"], "v", "id", 15, "t").collect()}
    quantiles = {r["g"]: r["values"] for r in ranks.quantiles(table, ["g"], "v", "id", [0.0, 0.1, 0.5, 0.93, 1.0]).collect()}
    for g in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        for k, part in enumerate(np.array_split(np.arange(len(own)), 15), 1):
            assert all(tiles[own[j][0]] == k for j in part)
        assert quantiles[g] == pytest.approx(np.quantile([r[2] for r in own], [0.0, 0.1, 0.5, 0.93, 1.0]))


def test_standardization_is_null_without_a_class(spark):
    rows = [(i, v, "H1", y, 0.6, 0.2, 0.2, 0.6, 0, int(y == 0)) for i, (v, y) in enumerate([("D0", 0), ("D0", 1), ("D0", 2), ("D5", 0), ("D5", 1), ("D5", 0)])]
    table = spark.createDataFrame(rows, CELLS)
    found = {r["variant"]: r for r in metrics.standardized_ece(table, "D0").collect()}
    assert found["D5"]["ece"] is None and found["D0"]["ece"] is not None
    one = metrics.standardized_delta(table, "D0", "D5").first()
    assert one["forward"] is None and one["backward"] is not None


def test_finalize_and_maps(spark):
    t = lambda rows: spark.createDataFrame(rows, "id string, label string")
    good, bad = integrity.finalize(t([("a0", "x"), ("a1", "x"), ("a2", "y"), ("a3", "x")]), t([("a0", "x"), ("a1", "y"), ("a2", "y"), ("a4", "x")]), t([("a1", "y"), ("a2", "z"), ("a9", "x")]), "id", "label")
    assert {r["id"]: r["label"] for r in good.collect()} == {"a0": "x", "a1": "y"}
    assert {r["id"]: r["reason"] for r in bad.collect()} == {"a2": "agreed row changed", "a3": "one annotator", "a4": "one annotator", "a9": "unknown id"}
    m = lambda rows: spark.createDataFrame(rows, "s string, targets array<string>, relation string")
    out = integrity.merge_maps(m([("a", ["x", "y"], "is"), ("b", ["x"], "is"), ("c", ["x"], "is"), ("d", ["x"], "is")]), m([("a", ["y", "x"], "is"), ("b", ["x"], "has"), ("c", ["y"], "is"), ("d", ["z"], "is")]), m([("b", ["q"], "near"), ("c", ["w"], "near")]), ["s"])
    assert {r["s"]: (r["targets"], r["relation"], r["status"]) for r in out.collect()} == {"a": (["x", "y"], "is", "agree"), "b": (["x"], "near", "same targets"), "c": (["w"], "near", "adjudicated"), "d": (None, None, "undecided")}
