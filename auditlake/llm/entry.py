"""The queries and SQL of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from . import byte_bpe, embedding_dedup, hard_negatives, lm_scoring, order_minhash, packing, periodic_runs, quality_rules, sharding, substring_dedup, token_output, toxicity, url_filter
from ._scratch import materialize

#: Where the public tokenizer files are; every operator takes the path as a parameter.
WORD_BPE, BYTE_BPE, BYTE_RANKS = "word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship.to_executors(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes(quality_rules.BASE)).alias("base_failed"),
        quality_rules.passes(quality_rules.STANDARD).alias("kept"),
        "fail_bits",
    )


def ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy removes, from the stored ledger alone."""
    stored = materialize(quality_rules.ledger(_table(spark, sf_dir, "documents")), "ledger")
    return quality_rules.ablations(stored, [quality_rules.BASE, quality_rules.STANDARD])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_output.write_documents(_table(spark, sf_dir, "documents"), tokenizer(WORD_BPE))
    return token_output.digests(token_output.read(spark, path))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = lm_scoring.train(docs.where(~lm_scoring.held_out(F.col("doc_id"))))
    rows = lm_scoring.score(docs, model).withColumn("held_out", lm_scoring.held_out(F.col("doc_id")))
    return rows.withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE)).drop("ids")


LISTED = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.listed(*rule) for rule in LISTED]
    return url_filter.judge(_table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(_table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(_table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    rows = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out(F.col("doc_id")))
    return rows.select("doc_id", "held_out", "score", "predicted")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode(_table(spark, sf_dir, "documents"), tokenizer(BYTE_RANKS), public_tokenizers.PATTERN, digests=True)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(_table(spark, sf_dir, "embeddings"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    texts = docs.select("doc_id", periodic_runs.with_tails(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic_runs.digests(texts).drop("n_words")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0, 256.0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1,
        "op2_token_output": op2,
        "op3_lm_scoring": op3,
        "op4_packing": op4,
        "op5_url_filter": op5,
        "op6_order_minhash": op6,
        "op7_substring_dedup": op7,
        "op8_toxicity": op8,
        "op9_byte_bpe": op9,
        "op10_embedding_dedup": op10,
        "op11_sharding": op11,
        "op12_periodic_runs": op12,
        "op13_hard_negatives": op13,
        "pipeline": pipeline,
        "quality_rule_ablations": ablations,
    }


_LEDGER = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
n AS (SELECT doc_id, t, ws, len(ws) AS n FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, n - 3)) AS i FROM n WHERE n >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM n),
m AS (
  SELECT n.doc_id, n.n AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(n_repeat, 0) AS n_repeat_words,
         length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals
  FROM n JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN 10 * n_capitals > 3 * word_chars THEN 16 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 32 ELSE 0 END) AS fail_bits
  FROM m)
"""

SQL_OP1 = _LEDGER + r"""
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, CAST(fail_bits AS INTEGER) AS fail_bits
FROM f
"""

SQL_ABLATIONS = (
    _LEDGER
    + r""", ru(policy, mask, rule, bit) AS (VALUES ('base', 3, 'few_words', 1), ('base', 3, 'repeated_words', 2), ('2', 63, 'few_words', 1), ('2', 63, 'repeated_words', 2),
  ('2', 63, 'symbols', 4), ('2', 63, 'repeated_lines', 8), ('2', 63, 'capitals', 16), ('2', 63, 'word_length', 32))
SELECT policy, rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits & mask = bit) AS n_failed_only_this,
       count(*) FILTER (fail_bits & mask & ~bit = 0) AS n_kept_without, count(*) FILTER (fail_bits & mask = 0) AS n_kept
FROM f, ru GROUP BY policy, rule
"""
)

SQL_OP5 = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(rule, h, p, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
  ('com/de/', 'com', '/de/', 'block')),
d AS (SELECT DISTINCT host, path FROM u),
fit AS (
  SELECT d.host, d.path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM d JOIN rules ON (d.host = h OR ends_with(d.host, '.' || h)) AND starts_with(d.path, p)
  GROUP BY d.host, d.path)
SELECT page_id, u.host, u.path, fit.rule,
       coalesce(fit.verdict, CASE WHEN regexp_matches(u.host, '(^|[^a-z0-9])(adult|casino|poker|porn|sex|spam|viagra|warez|xxx)([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fit ON u.host = fit.host AND u.path = fit.path
"""


#: The checksum of a text by its table, which is built from the polynomial.
_CRC_TABLE = """
WITH RECURSIVE steps(i, b, c) AS (SELECT 0, b, b FROM range(256) r(b) UNION ALL SELECT i + 1, b, xor(c >> 1, (c & 1) * 3988292384) FROM steps WHERE i < 8),
t AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE i = 8),
"""
_CRC = """xor(4294967295, coalesce(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce({0}, ''))), '..'), lambda x: ('0x' || x)::BIGINT),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295))"""

#: Links as they are defined, components by the least id reached.
SQL_OP10 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(node, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.node WHERE r.c < l.b),
p AS (SELECT node, min(c) AS c FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN p ON node = vec_id LEFT JOIN n ON n.a = vec_id
"""

#: Both rankings as plain windows.
SQL_OP11 = _CRC_TABLE + f"""
d AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, {_CRC.format("text")} AS crc,
         ('0x' || substr(sha256(concat_ws(':', 'shards', doc_id::VARCHAR)), 1, 13))::BIGINT AS h,
         ('0x' || substr(sha256(concat_ws(':', 'shards', 'stratum', source)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS shift
  FROM documents, t),
f AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, crc, size) - 1 + shift) / count(*) OVER (PARTITION BY source) AS fraction FROM d),
r AS (SELECT *, row_number() OVER (ORDER BY fraction, source, h, crc, size) - 1 AS rank, count(*) OVER () AS total FROM f)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, (rank * 16 // total)::INTEGER AS shard,
       (rank - ((rank * 16 // total) * total + 15) // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM r
"""

#: For each period the islands of places whose five words come again one period later; a stretch within one of a smaller period is not a run of its own.
SQL_OP12 = _CRC_TABLE + f"""
d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, {_CRC.format("doc_id::VARCHAR")} AS h FROM documents, t),
k AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN planted THEN g % n END AS a FROM k),
m AS (SELECT doc_id, n, CASE WHEN planted THEN [CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END FOR i IN range(0, n)] ELSE w END AS w FROM a),
f AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 5], ' ') AS f FROM (SELECT doc_id, n, w, unnest(range(0, n - 4)) AS i FROM m WHERE n >= 5)),
e AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.f = y.f AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS s, count(*) + q + 4 AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island HAVING count(*) + q + 4 >= greatest(6, 4 * q)),
r AS (SELECT * FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
b AS (SELECT doc_id, count(*) AS n_runs, arg_max({{'s': s, 'l': l, 'q': q}}, {{'l': l, 's': -s, 'q': -q}}) AS b, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS told FROM r GROUP BY doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r),
c AS (SELECT x.doc_id, string_agg(v, ' ' ORDER BY x.i) AS kept FROM (SELECT doc_id, unnest(w) AS v, unnest(range(0, n)) AS i FROM m) x LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i WHERE g.i IS NULL GROUP BY x.doc_id)
SELECT m.doc_id, coalesce(n_runs, 0) AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.l // b.q)::BIGINT AS exponent_milli,
       sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM m LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)
"""

SQL_OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.e, v.e)::BIGINT AS score
  FROM v AS a JOIN v ON a.vec_id <> v.vec_id AND len(a.e) = len(v.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": SQL_OP1, "op5_url_filter": SQL_OP5, "quality_rule_ablations": SQL_ABLATIONS, "op10_embedding_dedup": SQL_OP10, "op11_sharding": SQL_OP11, "op12_periodic_runs": SQL_OP12, "op13_hard_negatives": SQL_OP13}
