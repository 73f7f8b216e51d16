"""Shards of equal row counts whose every one has the mixture of the whole.

Within each stratum (the source) rows are shuffled by a seeded digest and ranked; a row's
fractional rank is its rank, shifted by a digest of the stratum, over the stratum's rows. All
rows sorted by fractional rank interleave the strata in proportion to their sizes from begin to
end, so that runs of equal length cut from that order match the mixture: a shard has of a
stratum of n rows n / shards, give or take two. The shift spreads strata of few rows over the shards.

Both rankings are range sorts on all their columns, a row number included, so that neither one
stratum nor rows that are alike come together in one task; offsets come from the counts of the
parts. Only ids, digests and sizes are sorted; texts are read once for their digests.

Law: ``rows``, shard sizes at most one apart. Defined results: a null text has size 1 and the
checksum of the empty text; a null source is a stratum of its own; rows without a doc_id take
part; repeated rows are alike, so which of their places is whose is not told; with fewer rows
than shards some shards stay empty; an empty table gives no rows; columns other than doc_id,
text and the stratum are ignored by ``assign`` and kept by ``apply``, where shard and slot
replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._scratch import materialize

SHARDS, SEED = 16, "shards"
#: Low bits of a generated row number, which count within its part.
_WITHIN = (1 << 33) - 1


def _number(*parts: Column) -> Column:
    """52 bits of a digest, which a double holds exactly."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 13), 16, 10).cast("long")


def _placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows in shared storage, sorted, with their part and place in it."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    stored = materialize(placed.withColumn("at", at), name)
    return stored.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(F.lit(_WITHIN))})


def _ranked(rows: DataFrame, group: list[str]) -> DataFrame:
    """rows of _placed() with rank from 0 in their group, and the group's total."""
    cells = rows.groupBy("part", *group).agg(F.count("*").alias("own"), F.min("at").alias("begin"))
    part = W.partitionBy(*group)
    before = F.coalesce(F.sum("own").over(part.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("part", *group, (before - F.col("begin")).alias("shift"), F.sum("own").over(part).alias("total"))
    on = [F.col("r.part") == F.col("c.part"), *[F.col(f"r.{g}").eqNullSafe(F.col(f"c.{g}")) for g in group]]
    joined = rows.alias("r").join(cells.alias("c"), on)
    return joined.select("r.*", (F.col("at") + F.col("shift")).alias("rank"), "total").drop("at", "part")


def _assigned(slim: DataFrame, shards: int, seed: str) -> DataFrame:
    """slim (doc_id, stratum, size, text_crc32, row) with shard and slot."""
    rows = slim.withColumn("shuffled", _number(F.lit(seed), F.col("doc_id").cast("string")))
    within = _ranked(_placed(rows, ["stratum", "shuffled", "text_crc32", "size", "row"], "shuffled"), ["stratum"])
    shift = _number(F.lit(seed), F.lit("stratum"), F.col("stratum")) / float(1 << 52)
    mixed = within.withColumn("fraction", (F.col("rank") + shift) / F.col("total")).drop("rank", "total")
    every = _ranked(_placed(mixed, ["fraction", "stratum", "shuffled", "text_crc32", "size", "row"], "interleaved"), [])
    k = F.lit(shards)
    shard = F.call_function("div", F.col("rank") * k, F.col("total"))
    start = F.call_function("div", shard * F.col("total") + k - 1, k)
    return every.select("row", "doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("rank") - start).alias("slot"))


def _slim(doc_id: Column, text: Column, stratum: Column) -> list[Column]:
    text = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    return [doc_id.cast("long").alias("doc_id"), stratum.cast("string").alias("stratum"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")]


def assign(docs: DataFrame, shards: int = SHARDS, by: str = "source", seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    rows = docs.select(*_slim(F.col("doc_id"), F.col("text"), F.col(by)), F.monotonically_increasing_id().alias("row"))
    return _assigned(materialize(rows, "sizes"), shards, seed).drop("row")


def apply(docs: DataFrame, shards: int = SHARDS, by: str = "source", seed: str = SEED) -> DataFrame:
    """docs with shard and slot; rows are stored once with a number of their own, by which their places come back."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.monotonically_increasing_id().alias("row"))
    whole = materialize(whole, "whole")
    of = F.col("whole")
    places = _assigned(whole.select(*_slim(of["doc_id"], of["text"], of[by]), "row"), shards, seed).select("row", "shard", "slot")
    return whole.join(places, "row").select(*[of[c].alias(c) for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")


def write(docs: DataFrame, path: str, shards: int = SHARDS, by: str = "source", seed: str = SEED) -> None:
    """Write docs as Parquet in a folder for each shard, sorted by slot within each file."""
    placed = apply(docs, shards, by, seed).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    placed.write.partitionBy("shard").parquet(path)
