"""Audits of labels, votes and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from ..functions.text import digest, hex_int
from ..operators import audit as A
from ..operators import integrity as I
from .metric_queries import PRE, cells, rounded

_CELLS = lambda f: lambda s, d: rounded(f(cells(s, d)))
FLAGS = ["returned", "open_", "bulk", "discounted"]


def votes(spark, sf_dir):
    t = fixtures.table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", (F.col("l_returnflag") != "R").alias("is_safe"), (F.col("l_returnflag") == "R").alias("returned"), (F.col("l_linestatus") == "O").alias("open_"), (F.col("l_quantity") > 25).alias("bulk"), (F.col("l_discount") > 0.05).alias("discounted"))


def splits(spark, sf_dir):
    """doc_id, split; a document is in one to three of them."""
    docs = fixtures.table(spark, sf_dir, "documents")
    pick = lambda salt, n: hex_int(digest(salt, F.col("doc_id")), 1, 2) % n
    names = F.array(F.element_at(F.array(*map(F.lit, ("train", "calib", "test"))), (pick("s1", 3) + 1).cast("int")), F.when(pick("s2", 8) == 0, "audit"), F.when(pick("s3", 16) == 0, "conflict"))
    return docs.select("doc_id", F.explode(names).alias("split")).where("split IS NOT NULL")


_SPLITS = """WITH s AS (SELECT doc_id, ['train', 'calib', 'test'][('0x' || substr(sha256(concat_ws(':', 's1', doc_id::VARCHAR)), 1, 2))::BIGINT % 3 + 1] AS split FROM documents
UNION ALL SELECT doc_id, 'audit' FROM documents WHERE ('0x' || substr(sha256(concat_ws(':', 's2', doc_id::VARCHAR)), 1, 2))::BIGINT % 8 = 0
UNION ALL SELECT doc_id, 'conflict' FROM documents WHERE ('0x' || substr(sha256(concat_ws(':', 's3', doc_id::VARCHAR)), 1, 2))::BIGINT % 16 = 0) """
_PAIRS = ", pr AS (SELECT a.doc_id, a.policy, a.state_id AS s1, b.state_id AS s2 FROM label_cells a JOIN label_cells b ON a.doc_id = b.doc_id AND a.policy = b.policy AND a.variant = 'D0' AND b.variant = 'D5' AND a.state_id IS NOT NULL AND b.state_id IS NOT NULL) "
_VOTES = "WITH v AS (SELECT l_orderkey, l_returnflag <> 'R' AS is_safe, l_returnflag = 'R' AS returned, l_linestatus = 'O' AS open_, l_quantity > 25 AS bulk, l_discount > 0.05 AS discounted FROM lineitem), m AS (SELECT l_orderkey, count(*) AS n_votes, " + ", ".join(f"CASE WHEN 2 * sum({f}::INTEGER) = count(*) THEN NULL ELSE 2 * sum({f}::INTEGER) > count(*) END AS {f}" for f in ("is_safe", *FLAGS)) + " FROM v GROUP BY l_orderkey) "
_SUPPORT = " UNION ALL ".join(f"SELECT '{f}' AS category, count(*) FILTER ({f}) AS positive, count(*) FILTER (NOT {f} AND coalesce(is_safe, false)) AS benign_negative, count(*) FILTER (NOT {f} AND NOT coalesce(is_safe, false)) AS nonpositive, count(*) FILTER ({f} IS NULL) AS tie FROM m" for f in FLAGS)


def _merge(spark, sf_dir):
    docs = fixtures.table(spark, sf_dir, "documents")
    label = lambda salt: (hex_int(digest(salt, F.col("doc_id")), 1, 2) % 3).alias("label")
    a, b = docs.select("doc_id", label("r1")), docs.select("doc_id", label("r2"))
    final = docs.where(hex_int(digest("r4", F.col("doc_id")), 1, 2) < 200).select("doc_id", label("r3"))
    return I.merge_reviews(a, b, final, "doc_id", "label").groupBy("status", "label").agg(F.count("*").alias("n")).withColumn("label", F.coalesce("label", F.lit(-1)))


def _hx(salt):
    return f"('0x' || substr(sha256(concat_ws(':', '{salt}', doc_id::VARCHAR)), 1, 2))::BIGINT"


def fingerprint_sql(table: str, columns: tuple[str, ...]) -> str:
    """n_rows and fingerprint of a table as DuckDB makes them; columns in order."""
    row = ", ".join(f"'{c}': {c}" for c in columns)
    pieces = ", ".join(f"sum(('0x' || substr(h, {6 * k + 1}, 6))::BIGINT)" for k in range(11))
    return f"count(*) AS n_rows, sha256(concat_ws(':', count(*), {pieces})) AS fingerprint FROM (SELECT sha256(to_json({{{row}}})::VARCHAR) AS h FROM {table})"


#: The sorted digests of all rows, hashed in 4096 parts.
_FINGERPRINT = "WITH h AS (SELECT sha256(to_json({'doc_id': doc_id, 'quality': quality, 'toxic': toxic})::VARCHAR) AS h FROM labels), p AS (SELECT substr(h, 1, 3) AS p, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY ALL) SELECT coalesce(sum(n), 0)::BIGINT AS n_rows, sha256(coalesce(string_agg(d, '' ORDER BY p), '')) AS fingerprint FROM p"

QUERIES = {
    "state_shares": (_CELLS(lambda c: A.state_shares(c, ["variant", "policy"])), PRE + "SELECT variant, policy, count(*) FILTER (state_id = 0) AS satisfied, count(*) FILTER (state_id = 1) AS violated, count(*) FILTER (state_id = 2) AS not_applicable, round(avg((state_id = 2)::INTEGER), 6) AS na_share FROM label_cells WHERE state_id IS NOT NULL GROUP BY ROLLUP (variant, policy)"),
    "label_rates_cube": (_CELLS(lambda c: A.label_rates(c.where("variant = 'D0'"), ["lang", "policy"])), PRE + "SELECT lang, policy, count(*) AS n, round(avg((state_id <> 2)::INTEGER), 6) AS applicable, round(count(*) FILTER (state_id = 1) / count(*) FILTER (state_id <> 2), 6) AS violation_rate FROM label_cells WHERE state_id IS NOT NULL AND variant = 'D0' GROUP BY CUBE (lang, policy)"),
    "perturbation_consistency": (_CELLS(lambda c: A.consistency(A.pairs(c, "D0", "D5"))), PRE + _PAIRS + "SELECT count(*) AS n_records, round(sum(same) / sum(n), 6) AS cell_agreement, round(avg((same = n)::INTEGER), 6) AS record_agreement FROM (SELECT doc_id, count(*) AS n, count(*) FILTER (s1 = s2) AS same FROM pr GROUP BY doc_id)"),
    "transition_tables": (_CELLS(lambda c: A.transitions(A.pairs(c, "D0", "D5"))), PRE + _PAIRS + "SELECT p.policy, a AS s1, b AS s2, count(pr.doc_id) AS n FROM policies p CROSS JOIN (SELECT unnest([0, 1, 2]) AS a) CROSS JOIN (SELECT unnest([0, 1, 2]) AS b) LEFT JOIN pr ON pr.policy = p.policy AND pr.s1 = a AND pr.s2 = b GROUP BY ALL"),
    "reference_gate": (_CELLS(A.reference_gate), PRE + "SELECT r.variant, round(complete_rate, 6) AS complete_rate, round(worst_missing, 6) AS worst_missing, complete_rate >= 0.99 AND worst_missing <= 0.01 AS passes FROM (SELECT variant, avg(c) AS complete_rate FROM (SELECT variant, doc_id, min((state_id IS NOT NULL)::INTEGER) AS c FROM label_cells GROUP BY ALL) GROUP BY variant) r JOIN (SELECT variant, max(m) AS worst_missing FROM (SELECT variant, policy, avg((state_id IS NULL)::INTEGER) AS m FROM label_cells GROUP BY ALL) GROUP BY variant) w ON r.variant = w.variant"),
    "majority_vote": (lambda s, d: A.majority(votes(s, d), "l_orderkey", ["is_safe", *FLAGS]).select("l_orderkey", "n_votes", *[F.coalesce(F.col(f).cast("string"), F.lit("tie")).alias(f) for f in ("is_safe", *FLAGS)]), _VOTES + "SELECT l_orderkey, n_votes, " + ", ".join(f"coalesce({f}::VARCHAR, 'tie') AS {f}" for f in ("is_safe", *FLAGS)) + " FROM m"),
    "category_support": (lambda s, d: A.support(A.majority(votes(s, d), "l_orderkey", ["is_safe", *FLAGS]), "is_safe", FLAGS, 2000), _VOTES + f"SELECT *, CASE WHEN positive >= 2000 THEN 'primary' ELSE 'rare' END AS tier FROM ({_SUPPORT})"),
    "contingency_cramers_v": (lambda s, d: rounded(A.contingency(fixtures.table(s, d, "documents").join(fixtures.table(s, d, "labels"), "doc_id"), "quality", "source", ["toxic"])), "WITH x AS (SELECT toxic, quality, source FROM documents JOIN labels USING (doc_id)), o AS (SELECT toxic, quality, source, count(*) AS o FROM x GROUP BY ALL), r AS (SELECT toxic, quality, count(*) AS r FROM x GROUP BY ALL), c AS (SELECT toxic, source, count(*) AS c FROM x GROUP BY ALL), t AS (SELECT toxic, sum(o * o / (r * c)) AS s, sum(o)::BIGINT AS n, count(DISTINCT quality) AS k, count(DISTINCT source) AS m FROM o JOIN r USING (toxic, quality) JOIN c USING (toxic, source) GROUP BY toxic) SELECT toxic, n, round(n * (s - 1), 6) AS chi2, (k - 1) * (m - 1) AS df, round(CASE WHEN least(k, m) > 1 THEN sqrt((s - 1) / (least(k, m) - 1)) END, 6) AS cramers_v, round(CASE WHEN ((k - 1) * (m - 1)) > 0 THEN greatest(1 - list_sum([exp((((k - 1) * (m - 1)) / 2.0::DOUBLE + jj) * ln((n * (s - 1)) / 2) - (n * (s - 1)) / 2 - lgamma(((k - 1) * (m - 1)) / 2.0::DOUBLE + jj + 1)) FOR jj IN range(0, 400)]), 0) END, 6) AS p FROM t"),
    "score_sanity": (_CELLS(lambda c: A.score_sanity(c, "variant", "p1")), PRE + "SELECT variant, count(*) AS n, round(min(p1), 6) AS low, round(max(p1), 6) AS high, min(p1 BETWEEN 0 AND 1) AS in_range, count(DISTINCT p1) >= 2 AS varies FROM scored GROUP BY variant"),
    "split_overlap": (lambda s, d: I.split_overlap(splits(s, d), "doc_id", "split"), _SPLITS + "SELECT a.split AS a, b.split AS b, count(*) AS n_shared FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.split < b.split GROUP BY ALL"),
    "aligned_join_violations": (lambda s, d: I.aligned(fixtures.table(s, d, "documents").where("doc_id % 7 <> 0"), fixtures.table(s, d, "labels"), "doc_id").groupBy("reason").agg(F.count("*").alias("n")), "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN b.doc_id IS NULL THEN 'left only' WHEN a.doc_id IS NULL THEN 'right only' END AS reason FROM (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0) a FULL JOIN labels b ON a.doc_id = b.doc_id) WHERE reason IS NOT NULL GROUP BY ALL"),
    "resume_anti_join": (lambda s, d: I.resume(fixtures.table(s, d, "documents").select("doc_id", "source"), fixtures.table(s, d, "labels"), "doc_id"), "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "changed_fields": (lambda s, d: I.changed_fields(fixtures.table(s, d, "documents"), fixtures.table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 11 == 0, "changed").otherwise(F.col("source")).alias("source"), F.when(F.col("doc_id") % 13 == 0, None).otherwise(F.col("n_chars")).alias("n_chars")), "doc_id", ["source", "n_chars"]), "SELECT doc_id, 'source' AS field FROM documents WHERE doc_id % 11 = 0 UNION ALL SELECT doc_id, 'n_chars' FROM documents WHERE doc_id % 13 = 0"),
    "review_merge": (_merge, f"WITH x AS (SELECT {_hx('r1')} % 3 AS a, {_hx('r2')} % 3 AS b, CASE WHEN {_hx('r4')} < 200 THEN {_hx('r3')} % 3 END AS c FROM documents) SELECT CASE WHEN a = b THEN 'agree' WHEN c IS NOT NULL THEN 'adjudicated' ELSE 'undecided' END AS status, coalesce(CASE WHEN a = b THEN a ELSE c END, -1) AS label, count(*) AS n FROM x GROUP BY ALL"),
    "composition_counts": (lambda s, d: fixtures.table(s, d, "documents").join(fixtures.table(s, d, "labels"), "doc_id", "left").groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("n_unsafe"), F.count_if(F.col("toxic") == 0).alias("n_safe")), "SELECT source, lang, count(*) AS n, count(*) FILTER (toxic = 1) AS n_unsafe, count(*) FILTER (toxic = 0) AS n_safe FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL"),
    "provenance_crosstab": (lambda s, d: fixtures.table(s, d, "documents").join(fixtures.table(s, d, "labels"), "doc_id", "left").groupBy("lang", F.coalesce(F.col("quality").cast("string"), F.lit("null")).alias("quality"), F.coalesce(F.col("toxic").cast("string"), F.lit("null")).alias("toxic")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_ids")), "SELECT lang, coalesce(quality::VARCHAR, 'null') AS quality, coalesce(toxic::VARCHAR, 'null') AS toxic, count(*) AS n, count(DISTINCT doc_id) AS n_ids FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL"),
    "table_fingerprint": (lambda s, d: I.fingerprint(fixtures.table(s, d, "labels").select("doc_id", "quality", "toxic")), _FINGERPRINT),
    "shard_assignment": (lambda s, d: fixtures.table(s, d, "documents").groupBy(I.shard_of(F.col("doc_id"), 4).alias("shard")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")), "SELECT doc_id % 4 AS shard, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY ALL"),
    "exclusion_join": (lambda s, d: I.excluded(fixtures.table(s, d, "documents").withColumn("fp", F.sha2("text", 256)), fixtures.table(s, d, "documents").where("doc_id % 5 = 0").withColumn("fp", F.sha2("text", 256)), "fp").select("doc_id", "fp"), "SELECT doc_id, sha256(text) AS fp FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 5 = 0)"),
}
