"""Samples, splits and near-duplicate families."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from ..functions import text as T
from ..functions.text import digest
from ..operators import families as N
from ..operators import sampling as S
from .metric_queries import PRE, cells, rounded

_DOCS = lambda s, d: fixtures.table(s, d, "documents").select("doc_id", "lang", "source", "n_chars")
_D = lambda salt: digest(salt, F.col("doc_id"))
_H = lambda salt: f"sha256(concat_ws(':', '{salt}', doc_id::VARCHAR))"


def texts(spark, sf_dir, whole=False, benchmark=False):
    """(doc_id, source, canonical, fingerprint, historical) of documents; with benchmark its items too, as historical rows with negative ids."""
    text = T.normalize_text(F.col("text")) if whole else T.normalize_text(F.regexp_replace("text", r"[^\x00-\x7F]", "x"), composed=True)
    docs = fixtures.table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source" if "source" in docs.columns else F.lit(None).cast("string").alias("source"), text.alias("canonical"), (F.col("doc_id") % 5 == 0).alias("historical"))
    if benchmark:
        items = fixtures.table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), F.lit(None).cast("string").alias("source"), text.alias("canonical"), F.lit(True).alias("historical"))
        rows = rows.unionByName(items)
    return rows.withColumn("fingerprint", F.sha2("canonical", 256))


def nodes(spark, sf_dir, whole=False, benchmark=False):
    """(node, canonical, fingerprint, historical): one node a canonical text, which is ASCII only unless whole."""
    rows = texts(spark, sf_dir, whole, benchmark)
    return rows.groupBy("fingerprint").agg(F.min("doc_id").alias("node"), F.max("historical").alias("historical"), F.any_value("canonical").alias("canonical")).select("node", "canonical", "fingerprint", "historical")


def similar_nodes(n):
    """Edges of saved nodes."""
    pairs = N.candidates(n.select("node", T.shingles(F.col("canonical")).alias("tokens")), signed=True)
    return N.similar(n, pairs, column="canonical", tokens=T.shingles)


def family_table(spark, sf_dir, whole=False):
    n = N.saved(nodes(spark, sf_dir, whole))
    return N.families(n, N.components(n, N.saved(similar_nodes(n))))


def family_edges(spark, sf_dir, whole=False):
    return similar_nodes(N.saved(nodes(spark, sf_dir, whole)))


def family_exclusion(spark, sf_dir, whole=False):
    n = N.saved(nodes(spark, sf_dir, whole))
    return N.exclude_historical(n, N.components(n, N.saved(similar_nodes(n)))).select("node", "component")


def exclusion_counts(spark, sf_dir):
    """Candidates kept and excluded by source; historical texts are a fifth of the documents and all of benchmark."""
    n = N.saved(nodes(spark, sf_dir, benchmark=True))
    parts = N.components(n, N.saved(similar_nodes(n)))
    members = texts(spark, sf_dir, benchmark=True).select("fingerprint", "source", "historical").join(n.select("fingerprint", "node"), "fingerprint")
    # read twice; texts are normalized for it once
    return N.exclusion_counts(N.saved(members.select("node", "source", "historical")), parts, "source")


_NODES = r"""WITH RECURSIVE c AS (SELECT doc_id, trim(regexp_replace(lower(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g')), '[\p{P}\s]+', ' ', 'g')) AS t, doc_id % 5 = 0 AS h FROM documents),
n AS (SELECT sha256(t) AS fp, min(doc_id) AS node, max(h) AS historical, any_value(t) AS t FROM c GROUP BY ALL),
w AS (SELECT node, fp, historical, regexp_extract_all(t, '[\p{L}\p{N}_]+') AS w FROM n),
s AS (SELECT node, fp, historical, CASE WHEN len(w) < 5 THEN ['<short> ' || array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
x AS (SELECT node, len(s) AS k, unnest(s) AS g FROM s),
e AS (SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.g = b.g AND a.node < b.node GROUP BY a.node, b.node, a.k, b.k HAVING count(*) * 20 >= 17 * (a.k + b.k - count(*))),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, label) AS (SELECT node, node FROM n UNION SELECT e2.b, r.label FROM r JOIN e2 ON e2.a = r.node WHERE r.label < e2.b),
p AS (SELECT node, min(label) AS component FROM r GROUP BY node) """
_FULL = _NODES.replace("doc_id % 5 = 0 AS h FROM documents)", "doc_id % 5 = 0 AS h, source FROM documents UNION ALL SELECT -1 - item_id, trim(regexp_replace(lower(regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g')), '[\\p{P}\\s]+', ' ', 'g')), true, NULL FROM benchmark)").replace("any_value(t) AS t FROM c GROUP BY ALL", "t FROM c GROUP BY t")
#: Texts of every script: canonical composition serves where no text has compatibility characters.
_WHOLE = _NODES.replace("regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g')", "nfc_normalize(text)").replace(r"[\p{P}\s]+", r"[\p{P}\s\p{Z}]+")
_PAIRS, _PARTS, _KEPT = (
    "SELECT a, b FROM e",
    "SELECT component, 'qf_' || substr(min(fp), 1, 24) AS family_id, count(*) AS size, max(historical) AS has_historical FROM p JOIN n USING (node) GROUP BY component",
    "SELECT node, component FROM p JOIN n USING (node) WHERE NOT historical AND component NOT IN (SELECT component FROM p JOIN n USING (node) WHERE historical)",
)

QUERIES = {
    "nested_budgets": (lambda s, d: S.nested_budgets(_DOCS(s, d), _D("budget"), [50, 100, 200, 500]).groupBy("budget", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")), f"SELECT budget::INTEGER AS budget, lang, count(*) AS n, min(doc_id) AS low FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY {_H('budget')}) AS rank FROM documents) JOIN (SELECT unnest([50, 100, 200, 500]) AS budget) ON rank <= budget GROUP BY ALL"),
    "dedup_first": (lambda s, d: S.first_by(fixtures.table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("fp")), ["fp"], [_D("first")]), f"SELECT doc_id, sha256(text) AS fp FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY {_H('first')}) = 1"),
    "stratified_top": (lambda s, d: S.top_per_stratum(_DOCS(s, d), "source", [_D("top")], 5).select("doc_id", "source", "place"), f"SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_H('top')})::INTEGER AS place FROM documents QUALIFY place <= 5"),
    "largest_remainder": (lambda s, d: S.largest_remainder(_DOCS(s, d).groupBy("lang").agg(F.count("*").alias("n")), "lang", "n", 137), "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), x AS (SELECT lang, n, 137 * n / sum(n) OVER () AS e FROM c), y AS (SELECT lang, n, floor(e)::BIGINT AS b, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, lang) AS k, 137 - sum(floor(e)::BIGINT) OVER () AS l FROM x) SELECT lang, n, b + (k <= l)::BIGINT AS quota FROM y"),
    "confidence_terciles": (lambda s, d: S.terciles(cells(s, d).where("variant = 'D0' AND state_id IS NOT NULL").withColumn("c", F.round("conf", 12)), ["lang", "policy"], "c", "doc_id").groupBy("lang", "policy", "tercile").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids")), PRE + "SELECT lang, policy, (ntile - 1)::INTEGER AS tercile, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT lang, policy, doc_id, ntile(3) OVER (PARTITION BY lang, policy ORDER BY round(conf, 12), doc_id) AS ntile FROM scored WHERE variant = 'D0' AND state_id IS NOT NULL) GROUP BY ALL"),
    "stratified_draw": (lambda s, d: rounded(S.stratified_draw(_DOCS(s, d), ["lang", "source"], [_D("draw")], 4).select("doc_id", "place", "population", "inclusion", "weight")), f"SELECT doc_id, place, population, round(least(1.0, 4.0 / population)::DOUBLE, 6) AS inclusion, round((1 / least(1.0::DOUBLE, 4.0::DOUBLE / population)), 6) AS weight FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY {_H('draw')})::INTEGER AS place, count(*) OVER (PARTITION BY lang, source) AS population FROM documents) WHERE place <= 4"),
    "class_balanced_topk": (lambda s, d: S.top_per_stratum(cells(s, d).where("variant = 'D0' AND state_id IN (0, 1)").withColumn("cell", F.concat_ws(":", "policy", "state_id")), "cell", [digest("cb", F.col("doc_id"), F.col("policy"))], 20).select("doc_id", "cell", "place"), PRE + "SELECT doc_id, policy || ':' || state_id AS cell, row_number() OVER (PARTITION BY policy, state_id ORDER BY sha256(concat_ws(':', 'cb', doc_id::VARCHAR, policy)))::INTEGER AS place FROM scored WHERE variant = 'D0' AND state_id IN (0, 1) QUALIFY place <= 20"),
    "family_similar_pairs": (family_edges, _NODES + _PAIRS),
    "family_components": (family_table, _NODES + _PARTS),
    "family_exclusion": (family_exclusion, _NODES + _KEPT),
    "exclusion_counts": (exclusion_counts, _FULL + "SELECT source, count(*) AS n, count(*) FILTER (NOT x.tainted) AS n_kept, count(*) FILTER (x.tainted) AS n_excluded FROM c JOIN n ON n.t = c.t JOIN p USING (node) JOIN (SELECT component, max(historical) AS tainted FROM p JOIN n USING (node) GROUP BY component) x USING (component) WHERE NOT h GROUP BY source"),
    # on texts of every script by the full normaliser
    "family_similar_pairs_all": (lambda s, d: family_edges(s, d, whole=True), _WHOLE + _PAIRS),
    "family_components_all": (lambda s, d: family_table(s, d, whole=True), _WHOLE + _PARTS),
    "family_exclusion_all": (lambda s, d: family_exclusion(s, d, whole=True), _WHOLE + _KEPT),
}
