"""Joins that check what they join: alignment, manifests, copies, splits, merges.

A violation is a row of a table, so one bad record never hides the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits that part the rows of a fingerprint.
PREFIX = 3


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Violations (id, reason): duplicates on a side, or ids of one side only."""
    a = left.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("a"))
    b = right.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("b"))
    both = a.join(b, "id", "full_outer")
    reason = F.when(F.col("b").isNull(), "left only").when(F.col("a").isNull(), "right only").when(F.col("a") > 1, "left duplicate").when(F.col("b") > 1, "right duplicate")
    return both.select("id", reason.alias("reason")).where("reason IS NOT NULL")


def subset(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Rows of the manifest with its position; a missing row comes with nulls."""
    return manifest.join(rows, key, "left")


def resume(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that are not done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def changed_fields(source: DataFrame, copy: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) of every carried field that differs from its source row."""
    b = copy.select(F.col(key), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = source.join(b, key)
    each = F.explode(F.filter(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull()))
    return joined.select(key, each.alias("field"))


def split_overlap(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Ids shared by each two splits; one shuffle on the id."""
    sets = rows.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    two = F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    return sets.select(two.alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n_shared"))


def excluded(candidates: DataFrame, frozen: DataFrame, fingerprint: str) -> DataFrame:
    """Candidates whose fingerprint no frozen row has."""
    return candidates.join(frozen.select(fingerprint).distinct(), fingerprint, "left_anti")


def merge_reviews(a: DataFrame, b: DataFrame, final: DataFrame, key: str, label: str) -> DataFrame:
    """Agreed label, else the adjudicated one; status agree, adjudicated or undecided."""
    joined = a.select(key, F.col(label).alias("a")).join(b.select(key, F.col(label).alias("b")), key).join(final.select(key, F.col(label).alias("c")), key, "left")
    same = F.col("a") == F.col("b")
    status = F.when(same, "agree").when(F.col("c").isNotNull(), "adjudicated").otherwise("undecided")
    return joined.select(key, F.when(same, F.col("a")).otherwise(F.col("c")).alias(label), status.alias("status"))


def shard_of(position: Column, n: int) -> Column:
    return F.pmod(position, F.lit(n))


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row: number and order-free content hash of a table.

    The digests of all rows, each as often as it comes, are sorted; those with the same first three digits
    are hashed one after another, and the hashes of these 4096 parts in their order are hashed again. Spark sorts and
    a task hashes as it reads, so no part is held; equal rows are counted before.
    """
    row = rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    each = row.groupBy("h").agg(F.sum(F.lit(1)).alias("n")).withColumn("p", F.substring("h", 1, PREFIX))
    parts = each.repartition("p").sortWithinPartitions("p", "h").mapInPandas(_chained, "p string, n long, d string")
    text = F.expr("listagg(d, '') WITHIN GROUP (ORDER BY p)")  # of a row a part
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("fingerprint"))


def _chained(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(p, n, d) of rows (p, h, n) sorted by p and h: a part's number of digests and the hash of them, one after another."""
    at, n, held = None, 0, None
    for pdf in frames:
        out = []
        for p, h, k in zip(pdf["p"], pdf["h"], pdf["n"]):
            if p != at:
                if held:
                    out.append((at, n, held.hexdigest()))
                at, n, held = p, 0, hashlib.sha256()
            for _ in range(k):
                held.update(h.encode())
            n += k
        yield pd.DataFrame(out, columns=["p", "n", "d"])
    if held:
        yield pd.DataFrame([(at, n, held.hexdigest())], columns=["p", "n", "d"])


def manifest_check(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Violations (id, reason): manifest ids without a row, rows that the manifest does not list, and ids listed twice."""
    a = manifest.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("listed"))
    b = rows.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("held"))
    both = a.join(b, "id", "full_outer")
    reason = F.when(F.col("held").isNull(), "missing").when(F.col("listed").isNull(), "not listed").when(F.col("listed") > 1, "listed twice")
    return both.select("id", reason.alias("reason")).where("reason IS NOT NULL")


def verify_fingerprints(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Violations (artifact, reason) of fingerprints (artifact, n_rows, fingerprint) against a frozen manifest of the same."""
    a, b = (t.select("artifact", F.struct("n_rows", "fingerprint").alias(n)) for t, n in ((manifest, "frozen"), (found, "now")))
    both = a.join(b, "artifact", "full_outer")
    reason = F.when(F.col("now").isNull(), "absent").when(F.col("frozen").isNull(), "not listed").when(F.col("now") != F.col("frozen"), "changed")
    return both.select("artifact", reason.alias("reason")).where("reason IS NOT NULL")


def shard_check(source: DataFrame, shards: DataFrame, key: str, shard: str, expected: Column) -> DataFrame:
    """Violations (id, reason) of merged shards: rows in two shards, lost, unknown, or in another shard than expected."""
    held = shards.groupBy(F.col(key).alias("id")).agg(F.count_distinct(shard).alias("k"), F.min(shard).alias("in"))
    own = source.select(F.col(key).alias("id"), expected.alias("due"))
    both = own.join(held, "id", "full_outer")
    reason = F.when(F.col("k").isNull(), "lost").when(F.col("due").isNull(), "unknown").when(F.col("k") > 1, "in two shards").when(F.col("in") != F.col("due"), "in another shard")
    return both.select("id", reason.alias("reason")).where("reason IS NOT NULL")


def split_counts(rows: DataFrame, key: str, split: str, expected: dict[str, int]) -> DataFrame:
    """split, n, n_ids, expected, ok of every expected and every found split."""
    found = rows.groupBy(split).agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_ids"))
    due = rows.sparkSession.createDataFrame(list(expected.items()), f"{split} string, expected long")
    both = found.join(F.broadcast(due), split, "full_outer").na.fill(0, ["n", "n_ids"])
    return both.withColumn("ok", F.coalesce((F.col("n") == F.col("expected")) & (F.col("n") == F.col("n_ids")), F.lit(False)))


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: ids of the first only, of the second only, of both, and whether the sets are equal."""
    both = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full_outer")
    counts = both.agg(F.count_if(F.col("b").isNull()).alias("first_only"), F.count_if(F.col("a").isNull()).alias("second_only"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"))
    return counts.withColumn("equal", (F.col("first_only") == 0) & (F.col("second_only") == 0))


def merge_maps(a: DataFrame, b: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Two reviewers' maps (keys, targets array, relation) with decisions for the rest: keys, targets, relation, status.

    agree: targets as sets and relation are equal; same targets: the relations differ and the
    decision's, if any, holds; adjudicated; undecided, with nulls, is a violation. A row that one
    reviewer lacks is undecided too.
    """
    side = lambda t, n: t.select(*keys, F.array_sort(F.array_distinct("targets")).alias(f"t{n}"), F.col("relation").alias(f"r{n}"))
    j = side(a, 1).join(side(b, 2), keys, "full_outer").join(side(decisions, 3), keys, "left")
    targets, relation = F.col("t1") == F.col("t2"), F.col("r1") == F.col("r2")
    status = F.when(targets & relation, "agree").when(targets & F.col("r3").isNotNull(), "same targets").when(F.col("t3").isNotNull(), "adjudicated").otherwise("undecided")
    j = j.withColumn("status", status)
    pick = lambda own, other: F.when(F.col("status") == "agree", F.col(own)).when(F.col("status") == "undecided", None).otherwise(F.col(other))
    return j.select(*keys, F.when(F.col("status") == "same targets", F.col("t1")).otherwise(pick("t1", "t3")).alias("targets"), pick("r1", "r3").alias("relation"), "status")


def finalize(a: DataFrame, b: DataFrame, final: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(final labels, violations (id, reason)) of two annotators and an adjudicated sheet.

    The id sets of the annotators must match, agreed rows may not change, and every
    disagreement needs a decision; a decision for an unknown id is a violation.
    """
    side = lambda t, n: t.select(key, F.col(label).alias(n), F.lit(True).alias(f"has_{n}"))
    j = side(a, "a").join(side(b, "b"), key, "full_outer").join(side(final, "c"), key, "full_outer")
    same = F.col("a").eqNullSafe(F.col("b"))
    reason = (
        F.when(F.col("has_a").isNull() & F.col("has_b").isNull(), "unknown id").when(F.col("has_a").isNull() | F.col("has_b").isNull(), "one annotator")
        .when(same & F.col("c").isNotNull() & (F.col("c") != F.col("a")), "agreed row changed").when(~same & F.col("c").isNull(), "undecided")
    )
    j = j.withColumn("reason", reason)
    return j.where("reason IS NULL").select(key, F.when(same, F.col("a")).otherwise(F.col("c")).alias(label)), j.where("reason IS NOT NULL").select(F.col(key).alias("id"), "reason")


def safe_sibling(pairs: DataFrame, chosen: DataFrame, generic: str) -> DataFrame:
    """chosen (id, prompt, response) with the safe answer to prefer: its sibling's, or a generic one.

    pairs: (prompt, response_0, response_1, safe_0, safe_1). A sibling is the other response to
    the same prompt, if it is safe and the chosen one is not; of several the least text.
    """
    each = F.explode(F.array(*[F.struct(F.col(f"response_{i}").alias("response"), F.col(f"response_{1 - i}").alias("sibling"), (~F.col(f"safe_{i}") & F.col(f"safe_{1 - i}")).alias("ok")) for i in (0, 1)]))
    known = pairs.select("prompt", each.alias("x")).select("prompt", "x.*").where("ok").groupBy("prompt", "response").agg(F.min("sibling").alias("sibling"))
    return chosen.join(known, ["prompt", "response"], "left").select("id", "prompt", "response", F.coalesce("sibling", F.lit(generic)).alias("preferred"), F.col("sibling").isNotNull().alias("has_sibling"))


def to_long(rows: DataFrame, keys: list[str], columns: dict[str, str], policies: list[str]) -> DataFrame:
    """keys, policy and one column for each map column (map name: new name); a missing cell survives as null."""
    each = [F.struct(F.lit(p).alias("policy"), *[F.try_element_at(m, F.lit(p)).alias(n) for m, n in columns.items()]) for p in policies]
    return rows.select(*keys, F.inline(F.array(*each)))


def to_wide(cells: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys and a map policy -> value without the cells that are null."""
    held = F.filter(F.collect_list(F.struct("policy", F.col(value).alias("v"))), lambda x: x["v"].isNotNull())
    return cells.groupBy(*keys).agg(F.map_from_entries(F.array_sort(held)).alias(name))
