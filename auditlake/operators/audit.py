"""Label and source audits: counts, shares, agreement, votes and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import chi2_tail


def _of(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def state_shares(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of the states per key set and the share that is not applicable; totals where a key is null."""
    y = F.col("state_id")
    return cells.where(y.isNotNull()).rollup(*keys).agg(_of(y == 0).alias("satisfied"), _of(y == 1).alias("violated"), _of(y == 2).alias("not_applicable"), F.avg((y == 2).cast("int")).alias("na_share"))


def label_rates(cells: DataFrame, keys: list[str]) -> DataFrame:
    """For every subset of keys: applicability and violation among the applicable."""
    y = F.col("state_id")
    return cells.where(y.isNotNull()).cube(*keys).agg(F.count("*").alias("n"), F.avg((y != 2).cast("int")).alias("applicable"), (_of(y == 1) / _of(y != 2)).alias("violation_rate"))


def static_audit(cells: DataFrame, hard: list[str], least: float = 0.05, most_na: float = 0.6) -> DataFrame:
    """policy, counts of the states, N/A share, and flags: a hard policy with too few violated, and too much N/A."""
    shares = state_shares(cells, ["policy"]).where("policy IS NOT NULL")
    total = F.col("satisfied") + F.col("violated") + F.col("not_applicable")
    return shares.withColumns({"thin": F.col("policy").isin(hard) & (F.col("violated") < least * total), "mostly_na": F.col("na_share") > most_na})


def parse_audit(records: DataFrame, ok: str, attempts: str, gate: float = 0.98) -> DataFrame:
    """attempts, n, n_parsed, and in the row of all attempts the parse rate's gate."""
    rolled = records.rollup(attempts).agg(F.count("*").alias("n"), _of(F.col(ok)).alias("n_parsed"))
    rate = F.col("n_parsed") / F.col("n")
    return rolled.select(F.coalesce(F.col(attempts), F.lit(0)).alias(attempts), "n", "n_parsed", rate.alias("parse_rate"), F.when(F.col(attempts).isNull(), rate >= gate).alias("passes"))


def complete_rows(cells: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """keys, n_units and the share of units whose cells all have a label."""
    each = cells.groupBy(*keys, unit).agg(F.min(F.col("state_id").isNotNull().cast("int")).alias("ok"))
    return each.groupBy(*keys).agg(F.count("*").alias("n_units"), F.avg("ok").alias("complete_rate"))


def category_frequency(rows: DataFrame, categories: str, unsafe: str, owners: DataFrame) -> DataFrame:
    """category, n, n_unsafe and its owner (category, owner), null if no policy owns it."""
    long = rows.select(F.explode(categories).alias("category"), F.col(unsafe).alias("unsafe"))
    counted = long.groupBy("category").agg(F.count("*").alias("n"), _of(F.col("unsafe")).alias("n_unsafe"))
    return counted.join(owners, "category", "left")


def pairs(cells: DataFrame, base: str, other: str) -> DataFrame:
    """doc_id, policy, s1, s2 of two variants; null where one is missing."""
    side = lambda v, name: cells.where(F.col("variant") == v).select("doc_id", "policy", F.col("state_id").alias(name))
    return side(base, "s1").join(side(other, "s2"), ["doc_id", "policy"], "full_outer")


def consistency(paired: DataFrame) -> DataFrame:
    """Records parsed on both sides, cell agreement and whole-record agreement."""
    both = paired.where("s1 IS NOT NULL AND s2 IS NOT NULL")
    per_record = both.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum((F.col("s1") == F.col("s2")).cast("int")).alias("same"))
    return per_record.agg(F.count("*").alias("n_records"), (F.sum("same") / F.sum("n")).alias("cell_agreement"), F.avg((F.col("same") == F.col("n")).cast("int")).alias("record_agreement"))


def policy_consistency(paired: DataFrame, cell_gate: float, record_gate: float) -> DataFrame:
    """policy, n, agreement; the row without a policy has all cells, the parse rate of both sides and whether the gates hold.

    A record counts in its gate only if every cell has a label on both sides.
    """
    ok = F.col("s1").isNotNull() & F.col("s2").isNotNull()
    same = F.col("s1") == F.col("s2")
    by_policy = paired.where(ok).rollup("policy").agg(F.count("*").alias("n"), F.avg(same.cast("int")).alias("agreement"))
    record = paired.groupBy("doc_id").agg(F.min(ok.cast("int")).alias("parsed"), F.min(F.coalesce(same, F.lit(False)).cast("int")).alias("same"))
    total = record.agg(F.avg("parsed").alias("parse_rate"), (_of((F.col("parsed") == 1) & (F.col("same") == 1)) / F.sum("parsed")).alias("record_agreement"))
    total = total.withColumn("all", F.lit(True))
    out = by_policy.withColumn("all", F.col("policy").isNull()).join(F.broadcast(total), "all", "left").drop("all")
    gates = (F.col("agreement") >= cell_gate) & (F.col("record_agreement") >= record_gate)
    return out.withColumn("passes", F.when(F.col("policy").isNull(), gates))


def na_transitions(paired: DataFrame) -> DataFrame:
    """policy, n, n_changed, and changes to and from "not applicable"."""
    both = paired.where("s1 IS NOT NULL AND s2 IS NOT NULL")
    s1, s2 = F.col("s1"), F.col("s2")
    return both.groupBy("policy").agg(F.count("*").alias("n"), _of(s1 != s2).alias("n_changed"), _of((s1 != 2) & (s2 == 2)).alias("to_na"), _of((s1 == 2) & (s2 != 2)).alias("from_na"))


def extra_keys(parsed: DataFrame, column: str = "extra") -> DataFrame:
    """key, n: how many records hold each key that was not asked for."""
    return parsed.select(F.explode(F.array_distinct(column)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def structure_agreement(calls: DataFrame, reference: DataFrame) -> DataFrame:
    """structure, position, n, agreement with the reference, N/A rate of both; totals where position is null.

    calls: (doc_id, structure, position, policy, state_id); reference: (doc_id, policy, ref).
    """
    joined = calls.where("state_id IS NOT NULL").join(reference.where("ref IS NOT NULL"), ["doc_id", "policy"])
    na = lambda c: F.avg((F.col(c) == 2).cast("int"))
    rolled = joined.rollup("structure", "position").agg(F.count("*").alias("n"), F.avg((F.col("state_id") == F.col("ref")).cast("int")).alias("agreement"), na("state_id").alias("na_rate"), na("ref").alias("reference_na_rate"))
    return rolled.where("structure IS NOT NULL")


def coverage(calls: DataFrame, units: DataFrame, structures: list[str], policies: list[str]) -> DataFrame:
    """structure, n_due, n_once, n_missing, n_repeated: each cell of each unit should be answered exactly once."""
    due = [F.struct(F.lit(s).alias("structure"), F.lit(p).alias("policy")) for s in structures for p in policies]
    wanted = units.select("doc_id", F.inline(F.array(*due)))
    held = calls.groupBy("doc_id", "structure", "policy").agg(F.count("*").alias("k"))
    k = F.coalesce("k", F.lit(0))
    each = wanted.join(held, ["doc_id", "structure", "policy"], "left")
    return each.groupBy("structure").agg(F.count("*").alias("n_due"), _of(k == 1).alias("n_once"), _of(k == 0).alias("n_missing"), _of(k > 1).alias("n_repeated"))


def transitions(paired: DataFrame) -> DataFrame:
    """Every policy's complete 3 x 3 table of counts; the states come from the row, not from a cross join."""
    cells = paired.where("s1 IS NOT NULL AND s2 IS NOT NULL").groupBy("policy").agg(*[_of((F.col("s1") == a) & (F.col("s2") == b)).alias(f"n{a}{b}") for a in range(3) for b in range(3)])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("s1"), F.lit(b).alias("s2"), F.col(f"n{a}{b}").alias("n")) for a in range(3) for b in range(3)]))
    return cells.withColumn("x", each).select("policy", "x.s1", "x.s2", "x.n")


def majority(votes: DataFrame, unit: str, flags: list[str]) -> DataFrame:
    """Strict majority of each flag per unit; a tie is null for that flag only."""
    decide = lambda f: F.when(2 * F.sum(F.col(f).cast("int")) == F.count("*"), None).otherwise(2 * F.sum(F.col(f).cast("int")) > F.count("*"))
    return votes.groupBy(unit).agg(F.count("*").alias("n_votes"), *[decide(f).alias(f) for f in flags])


def support(voted: DataFrame, safe: str, flags: list[str], threshold: int) -> DataFrame:
    """Per category: positives, benign negatives (flag false, safe true), other negatives, ties, and primary or rare."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("category"), F.col(f).alias("flag")) for f in flags]))
    long = voted.select(safe, each.alias("x")).select(safe, "x.*")
    is_safe = F.coalesce(F.col(safe), F.lit(False))
    counted = long.groupBy("category").agg(_of(F.col("flag")).alias("positive"), _of(~F.col("flag") & is_safe).alias("benign_negative"), _of(~F.col("flag") & ~is_safe).alias("nonpositive"), _of(F.col("flag").isNull()).alias("tie"))
    return counted.withColumn("tier", F.when(F.col("positive") >= threshold, "primary").otherwise("rare"))


def contingency(rows: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Chi-square, degrees of freedom, p and Cramer's V; empty rows and columns do not occur in the counts."""
    n = rows.groupBy(*keys, a, b).agg(F.count("*").alias("o"))
    row = rows.groupBy(*keys, a).agg(F.count("*").alias("r"))
    col = rows.groupBy(*keys, b).agg(F.count("*").alias("c"))
    # sum((o - e)^2 / e) = total * (sum(o^2 / (r c)) - 1), so absent pairs need no row
    part = n.join(row, [*keys, a]).join(col, [*keys, b]).groupBy(*keys).agg(F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"), F.sum("o").alias("n"), F.count_distinct(a).alias("k"), F.count_distinct(b).alias("m"))
    chi = F.col("n") * (F.col("s") - 1)
    return part.select(*keys, "n", chi.alias("chi2"), ((F.col("k") - 1) * (F.col("m") - 1)).alias("df"), F.when(F.least("k", "m") > 1, F.sqrt((F.col("s") - 1) / (F.least("k", "m") - 1))).alias("cramers_v")).withColumn("p", chi2_tail(F.col("chi2"), F.col("df")))


def score_sanity(scores: DataFrame, interface: str, score: str) -> DataFrame:
    """Per interface: all finite and in range, and at least two distinct values."""
    ok = F.col(score).isNotNull() & ~F.isnan(score) & F.col(score).between(0, 1)
    return scores.groupBy(interface).agg(F.count("*").alias("n"), F.min(score).alias("low"), F.max(score).alias("high"), F.min(ok).alias("in_range"), (F.count_distinct(score) >= 2).alias("varies"))


def pooled_range(scores: DataFrame, interface: str, score: str, least: float = 0.05) -> DataFrame:
    """One row: interfaces, those that fail score_sanity, the range of all scores, and whether all gates hold."""
    each = score_sanity(scores, interface, score)
    good = F.col("in_range") & F.col("varies")
    out = each.agg(F.count("*").alias("n_interfaces"), _of(~good).alias("n_bad"), (F.max("high") - F.min("low")).alias("pooled_range"))
    return out.withColumn("passes", (F.col("n_bad") == 0) & (F.col("pooled_range") > least))


def provenance(rows: DataFrame, key: str, label: str, categories: str) -> DataFrame:
    """One row: rows, ids that occur twice, unsafe rows without a category, safe rows with one."""
    twice = rows.groupBy(key).agg(F.count("*").alias("k"), _of((F.col(label) == 1) & (F.size(categories) == 0)).alias("bare"), _of((F.col(label) == 0) & (F.size(categories) > 0)).alias("odd"))
    return twice.agg(F.sum("k").alias("n"), _of(F.col("k") > 1).alias("n_repeated_ids"), F.sum("bare").alias("n_unsafe_without"), F.sum("odd").alias("n_safe_with"))


def criterion_support(rows: DataFrame, label: str, categories: str, criteria: dict[str, list[str]]) -> DataFrame:
    """criterion, n_positive (unsafe rows with one of its categories) and n_negative (safe rows)."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.arrays_overlap(categories, F.array(*map(F.lit, names))).alias("hit")) for c, names in criteria.items()]))
    long = rows.select(F.col(label).alias("label"), each.alias("x")).select("label", "x.*")
    return long.groupBy("criterion").agg(_of((F.col("label") == 1) & F.col("hit")).alias("n_positive"), _of(F.col("label") == 0).alias("n_negative"))


def reference_gate(cells: DataFrame, strict: float = 0.99, missing: float = 0.01) -> DataFrame:
    """Per variant: rate of complete records, greatest missing rate of a policy, and whether both gates hold."""
    y = F.col("state_id")
    record = cells.groupBy("variant", "doc_id").agg(F.min(y.isNotNull().cast("int")).alias("complete")).groupBy("variant").agg(F.avg("complete").alias("complete_rate"))
    policy = cells.groupBy("variant", "policy").agg(F.avg(y.isNull().cast("int")).alias("m")).groupBy("variant").agg(F.max("m").alias("worst_missing"))
    return record.join(policy, "variant").withColumn("passes", (F.col("complete_rate") >= strict) & (F.col("worst_missing") <= missing))


def schedule_balance(orders: DataFrame, order: str, canonical: list[str]) -> DataFrame:
    """policy, position, n, balanced, n_unchanged of a schedule of orders, for every policy and position.

    balanced: n differs from an equal share of the rows by less than one; n_unchanged: rows whose order is the canonical one.
    """
    names = F.array(*[F.lit(p) for p in canonical])
    total = orders.agg(F.count("*").alias("rows"), F.count_if(F.col(order) == names).alias("n_unchanged"))
    held = orders.select(F.posexplode(order).alias("position", "policy")).groupBy("policy", "position").agg(F.count("*").alias("n"))
    grid = total.select("*", F.explode(names).alias("policy")).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(canonical) - 1))).alias("position"))
    both = grid.join(held, ["policy", "position"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.select("policy", "position", "n", (F.abs(F.col("n") * len(canonical) - F.col("rows")) < len(canonical)).alias("balanced"), "n_unchanged")
