"""Deterministic samples, splits and quotas; every order is a salted digest.

Global ranks never put all rows into one task: rows are ranked inside digest prefixes, whose
counts give each prefix its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import ranks


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key, the first under a stated order."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def global_rank(rows: DataFrame, digest: Column, digits: int = 3) -> DataFrame:
    """rows with rank from 1 by a hex digest; the offsets table has at most 16**digits rows."""
    keyed = rows.withColumns({"_d": digest, "_p": F.substring(digest, 1, digits)})
    counts = keyed.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = keyed.withColumn("_k", F.row_number().over(W.partitionBy("_p").orderBy("_d")))
    return ranked.join(F.broadcast(offsets.select("_p", "_o")), "_p").withColumn("rank", F.col("_k") + F.col("_o")).drop("_d", "_p", "_k", "_o")


def exact_split(rows: DataFrame, digest: Column, sizes: dict[str, int]) -> DataFrame:
    """Disjoint splits of exact sizes by rank; rows beyond all sizes are left out, too few rows are an error."""
    have, due = rows.count(), sum(sizes.values())
    if have < due:
        raise ValueError(f"{due} rows asked of {have}")
    ranked, below, name = global_rank(rows, digest), 0, None
    for split, size in sizes.items():
        below += size
        case = F.col("rank") <= below
        name = F.when(case, split) if name is None else name.when(case, split)
    return ranked.withColumn("split", name).where("split IS NOT NULL")


def share_split(rows: DataFrame, digest: Column, shares: dict[str, int]) -> DataFrame:
    """Splits of all rows by whole hundredths of their number; the last one takes what rounding leaves."""
    n = rows.count()
    sizes = {split: n * share // 100 for split, share in shares.items()}
    sizes[list(sizes)[-1]] += n - sum(sizes.values())
    return exact_split(rows, digest, sizes)


def nested_budgets(rows: DataFrame, digest: Column, budgets: list[int]) -> DataFrame:
    """One row per budget that holds the row; smaller budgets are prefixes of larger ones."""
    ranked = global_rank(rows, digest)
    return ranked.withColumn("budget", F.explode(F.filter(F.array(*[F.lit(b) for b in budgets]), lambda b: b >= F.col("rank"))))


def top_per_stratum(rows: DataFrame, stratum: str, order: list, n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(stratum).orderBy(*order))).where(F.col("place") <= n)


def candidate_set(rows: DataFrame, key: str, strata: dict[str, Column], digest: Column, n: int) -> DataFrame:
    """key, strata: rows that are among the first n of a stratum, with all strata that chose them; strata may overlap."""
    named = F.filter(F.array(*[F.when(c, F.lit(s)) for s, c in strata.items()]), lambda x: x.isNotNull())
    each = rows.select(key, digest.alias("_d"), F.explode(named).alias("stratum"))
    return top_per_stratum(each, "stratum", ["_d"], n).groupBy(key).agg(F.array_sort(F.collect_set("stratum")).alias("strata"))


def shortfall(chosen: DataFrame, strata: list[str], n: int) -> DataFrame:
    """stratum, n, short of every stratum, also of one that chose nothing."""
    due = chosen.sparkSession.createDataFrame([(s,) for s in strata], "stratum string")
    held = chosen.select(F.explode("strata").alias("stratum")).groupBy("stratum").agg(F.count("*").alias("n"))
    return F.broadcast(due).join(held, "stratum", "left").select("stratum", F.coalesce("n", F.lit(0)).alias("n"), F.greatest(F.lit(n) - F.coalesce("n", F.lit(0)), F.lit(0)).alias("short"))


def class_balanced(cells: DataFrame, unit: str, digest: Column, fill: Column, k: int, total: int) -> DataFrame:
    """unit, chosen_by: the first k of every (policy, violated or satisfied), then others by fill up to a total.

    The balanced part is bounded by the policies; its number is counted before the rest is filled.
    """
    ranked = cells.where("state_id IN (0, 1)").withColumn("_d", digest)
    base = top_per_stratum(ranked.withColumn("_c", F.concat_ws(":", "policy", "state_id")), "_c", ["_d"], k).select(unit).distinct()
    left = max(0, total - base.count())
    rest = cells.select(unit).distinct().join(base, unit, "left_anti").orderBy(fill).limit(left)
    return base.withColumn("chosen_by", F.lit("class")).unionByName(rest.withColumn("chosen_by", F.lit("fill")))


def support_gate(cells: DataFrame, units: DataFrame, unit: str, least: int) -> DataFrame:
    """policy, n_violated, n_satisfied among the units, and whether both reach the least."""
    held = cells.join(units.select(unit), unit, "left_semi").groupBy("policy").agg(F.count_if(F.col("state_id") == 1).alias("n_violated"), F.count_if(F.col("state_id") == 0).alias("n_satisfied"))
    return held.withColumn("passes", F.least("n_violated", "n_satisfied") >= least)


def audit_sheets(drawn: DataFrame, key: str, private_order: Column, blind_order: Column, hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """(private, blind): the draw in two separate salted orders; the blind one lacks the hidden columns and its label columns are null."""
    private = global_rank(drawn, private_order).withColumnRenamed("rank", "position")
    blind = global_rank(drawn.drop(*hidden), blind_order).withColumnRenamed("rank", "position")
    return private, blind.withColumns({c: F.lit(None).cast("string") for c in ("annotator_1", "annotator_2", "adjudicated")})


def largest_remainder(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Quota per key proportional to n, exact in sum; counts has a row a key."""
    share = counts.withColumn("exact", F.lit(total) * F.col(n) / F.sum(n).over(W.partitionBy()))
    share = share.withColumns({"base": F.floor("exact"), "rest": F.round(F.col("exact") - F.floor("exact"), 9)})
    left = F.lit(total) - F.sum("base").over(W.partitionBy())
    place = F.row_number().over(W.orderBy(F.desc("rest"), key))
    return share.select(key, n, (F.col("base") + (place <= left).cast("long")).alias("quota"))


def terciles(rows: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """rows with tercile 0, 1 or 2 of a score from 0 to 1 in their group."""
    return ranks.ntile(rows, keys, score, tie, 3, "tercile").withColumn("tercile", F.col("tercile") - 1)


def stratified_draw(rows: DataFrame, stratum: list[str], order: list, n: int) -> DataFrame:
    """At most n a stratum with inclusion probability and its inverse as weight.

    Only the place is ranked, so each task hands on at most n rows a stratum; populations are counts that
    are joined to the drawn rows.
    """
    drawn = rows.withColumn("place", F.row_number().over(W.partitionBy(*stratum).orderBy(*order))).where(F.col("place") <= n)
    held = rows.groupBy(*stratum).agg(F.count("*").alias("population"))
    on = [F.col(f"d.{s}").eqNullSafe(F.col(f"h.{s}")) for s in stratum]
    p = F.least(F.lit(1.0), F.lit(n) / F.col("population"))
    return drawn.alias("d").join(held.alias("h"), on).select("d.*", "population").withColumns({"inclusion": p, "weight": 1 / p})


def choose_one(options: Column, digest: Column) -> Column:
    """One element of an array without its null and empty ones, by a hex digest; null if none is left."""
    kept = F.filter(options, lambda x: x.isNotNull() & (x != ""))
    place = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.greatest(F.size(kept), F.lit(1)) + 1).cast("int")
    return F.get(kept, place - 1)


def choose_rated(completions: Column, digest: Column, aspects: list[str]) -> Column:
    """One of an array of (response, annotations map aspect -> (Rating)) by a hex digest, as response and a rating an aspect.

    Null if there is none or the chosen one has no response; an aspect without an annotation has no rating.
    """
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.greatest(F.size(completions), F.lit(1))
    chosen = F.get(completions, place.cast("int"))
    ratings = [F.try_element_at(chosen["annotations"], F.lit(a))["Rating"].alias(a) for a in aspects]
    return F.when(F.length(chosen["response"]) > 0, F.struct(chosen["response"].alias("response"), *ratings))


def floor_then_fill(rows: DataFrame, key: str, groups: str, order: list, floor: int, total: int) -> DataFrame:
    """The first rows of every group up to a floor, then the first of the others up to a total.

    rows: (key, groups array, ...). The floor is per group, so its part is bounded by the groups.
    """
    each = rows.select("*", F.explode(groups).alias("_g"))
    base = top_per_stratum(each, "_g", order, floor).select(key).distinct()
    rest = rows.join(base, key, "left_anti").orderBy(*order)
    left = max(0, total - base.count())
    return base.unionByName(rest.limit(left).select(key))


def soft_pole(target: Column, matches: Column) -> Column:
    """The pole that a response shows: its target's if it matches, else the other one."""
    return F.when(matches, target).when(~matches, F.when(target == "high", "low").when(target == "low", "high"))


def template_grid(actions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Every action in every context, numbered; both tables are small by design."""
    grid = actions.crossJoin(F.broadcast(contexts))
    return grid.withColumn("position", F.row_number().over(W.orderBy("action", "context")) - 1)
