"""Label, logit and score cells derived from the documents table by digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import argmax, digest, hex_int, once, softmax

#: The policy ids in order, and the variants, base first.
POLICIES = ("H1", "H2", "H3", "H4", "H5", "S1", "S2", "S3", "T1", "T2")
VARIANTS = ("D0", "D5", "D5b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_cells(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, variant, policy, state_id (null where a document's row is missing).

    Every digest is made once: those of a document and a variant before the policies, those of
    a document and a policy before the variants.
    """
    gone = [(hex_int(digest("miss", F.col("doc_id"), F.lit(v)), 1, 2) == 0).alias(v) for v in VARIANTS]
    rows = once(documents.select("doc_id", "lang", "source"), gone=F.struct(*gone))
    rows = rows.select("*", F.inline(F.array(*[F.struct(F.lit(p).alias("policy"), digest("lab", F.col("doc_id"), F.lit(p)).alias("d")) for p in POLICIES])))
    rows = once(rows, base=hex_int(F.col("d"), 1, 4) % 3, D5=hex_int(F.col("d"), 5, 2) < 64, D5b=hex_int(F.col("d"), 7, 2) < 64)
    turned = {v: F.when(F.col(v), (F.col("base") + 1) % 3).otherwise(F.col("base")) if v != "D0" else F.col("base") for v in VARIANTS}
    each = [F.struct(F.lit(v).alias("variant"), F.when(~F.col("gone")[v], turned[v]).cast("int").alias("state_id")) for v in VARIANTS]
    return rows.select("doc_id", "lang", "source", "policy", F.inline(F.array(*each)))


def scored_cells(documents: DataFrame) -> DataFrame:
    """label_cells with z0..z2, p0..p2, conf, pred and correct."""
    cells = once(label_cells(documents), z=digest("z", F.col("doc_id"), F.col("policy"), F.col("variant")))
    z = {f"z{k}": (hex_int(F.col("z"), 1 + 2 * k, 2) - 128) / 32.0 + F.when(F.col("state_id") == k, 2.0).otherwise(0.0) for k in range(3)}
    cells = once(cells, **z).drop("z")
    logits = [F.col(f"z{k}") for k in range(3)]
    cells = once(cells, **{f"p{k}": p for k, p in enumerate(softmax(logits))}, pred=argmax(logits))
    return cells.withColumns({"conf": F.greatest("p0", "p1", "p2"), "correct": (F.col("pred") == F.col("state_id")).cast("int")})


_POL = ", ".join(f"('{p}', {k})" for k, p in enumerate(POLICIES))
#: The same views for DuckDB; queries go on after this text.
SQL = f"""
WITH policies(policy, ord) AS (VALUES {_POL}),
variants(variant) AS (VALUES ('D0'), ('D5'), ('D5b')),
keys AS (SELECT doc_id, lang, source, policy, variant, sha256(concat_ws(':', 'lab', doc_id::VARCHAR, policy)) AS d,
                sha256(concat_ws(':', 'miss', doc_id::VARCHAR, variant)) AS m, sha256(concat_ws(':', 'z', doc_id::VARCHAR, policy, variant)) AS z
         FROM documents, policies, variants),
based AS (SELECT *, ('0x' || substr(d, 1, 4))::BIGINT % 3 AS base,
            (variant = 'D5' AND ('0x' || substr(d, 5, 2))::BIGINT < 64) OR (variant = 'D5b' AND ('0x' || substr(d, 7, 2))::BIGINT < 64) AS turn FROM keys),
label_cells AS (SELECT doc_id, lang, source, policy, variant, z,
   CASE WHEN ('0x' || substr(m, 1, 2))::BIGINT <> 0 THEN (CASE WHEN turn THEN (base + 1) % 3 ELSE base END) END::INTEGER AS state_id FROM based),
logits AS (SELECT * EXCLUDE (z),
   (('0x' || substr(z, 1, 2))::BIGINT - 128) / 32.0::DOUBLE + (CASE WHEN state_id = 0 THEN 2.0 ELSE 0.0 END)::DOUBLE AS z0,
   (('0x' || substr(z, 3, 2))::BIGINT - 128) / 32.0::DOUBLE + (CASE WHEN state_id = 1 THEN 2.0 ELSE 0.0 END)::DOUBLE AS z1,
   (('0x' || substr(z, 5, 2))::BIGINT - 128) / 32.0::DOUBLE + (CASE WHEN state_id = 2 THEN 2.0 ELSE 0.0 END)::DOUBLE AS z2 FROM label_cells),
powers AS (SELECT *, exp(z0 - greatest(z0, z1, z2)) AS e0, exp(z1 - greatest(z0, z1, z2)) AS e1, exp(z2 - greatest(z0, z1, z2)) AS e2 FROM logits),
probs AS (SELECT *, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM powers),
scored AS (SELECT *, greatest(p0, p1, p2) AS conf, CASE WHEN z0 = greatest(z0, z1, z2) THEN 0 WHEN z1 = greatest(z0, z1, z2) THEN 1 ELSE 2 END AS pred,
   CASE WHEN state_id IS NOT NULL THEN (CASE WHEN (CASE WHEN z0 = greatest(z0, z1, z2) THEN 0 WHEN z1 = greatest(z0, z1, z2) THEN 1 ELSE 2 END) = state_id THEN 1 ELSE 0 END) END AS correct
   FROM probs)
"""
