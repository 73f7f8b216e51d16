"""Rated choices and schedules against plain Python."""

from collections import Counter

from pyspark.sql import functions as F

from auditlake.functions import text
from auditlake.operators import audit, sampling

SCHEMA = "id long, c array<struct<response:string, annotations:map<string,struct<Rating:string>>>>"


def test_rated_choice(spark):
    one = ("r1", {"honesty": ("4",), "helpfulness": (None,)})
    rows = [(1, [one]), (2, []), (3, None), (4, [("", {"honesty": ("5",)})]), (5, [("r2", None)]), (6, [(None, {})]), (7, [("a", {}), ("b", {"honesty": ("1",)}), ("c", {})])]
    table = spark.createDataFrame(rows, SCHEMA)
    chosen = table.select("id", sampling.choose_rated(F.col("c"), text.digest("k", F.col("id")), ["honesty", "helpfulness"]).alias("c"))
    found = {r["id"]: r["c"] for r in chosen.collect()}
    assert tuple(found[1]) == ("r1", "4", None) and tuple(found[5]) == ("r2", None, None)
    assert [k for k in found if found[k] is None] == [2, 3, 4, 6]
    assert tuple(found[7]) in {("a", None, None), ("b", "1", None), ("c", None, None)}


def test_schedule_balance(spark):
    names = ["A", "B", "C"]
    order = lambda base: text.latin_order(base, F.col("id"))
    rows = spark.range(7)
    swapped = audit.schedule_balance(rows.select(order(["B", "A", "C"]).alias("o")), "o", names).collect()
    held = Counter((["B", "A", "C"][(i + k) % 3], k) for i in range(7) for k in range(3))
    assert {(r["policy"], r["position"]): r["n"] for r in swapped} == held and all(r["balanced"] and r["n_unchanged"] == 0 for r in swapped)
    plain = audit.schedule_balance(rows.select(order(names).alias("o")), "o", names).collect()
    assert {r["n_unchanged"] for r in plain} == {3}
    same = audit.schedule_balance(rows.select(F.array(*map(F.lit, names)).alias("o")), "o", names).collect()
    assert len(same) == 9 and not any(r["balanced"] for r in same) and {r["n"] for r in same} == {0, 7}
