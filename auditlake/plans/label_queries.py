"""Ids, normalization, requests and parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from ..functions import parse as P
from ..functions import text as T
from .metric_queries import rounded

POL = fixtures.POLICIES
_DOC = lambda s, d: fixtures.table(s, d, "documents")
ALIASES = {"satisfied": "satisfied", "ok": "satisfied", "pass": "satisfied", "violated": "violated", "fail": "violated", "n/a": "not_applicable", "not_applicable": "not_applicable"}
SUFFIXES = ["Licensed under the Apache License, Version 2.0.", ".", " 2.0."]


def _raw(s, d):
    """Replies built from label cells, some of them broken by a digest."""
    c = fixtures.label_cells(_DOC(s, d)).where("variant = 'D0' AND state_id IS NOT NULL")
    state = F.element_at(F.array(*map(F.lit, T.STATES)), F.col("state_id") + 1)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("policy", state.alias("s")))), lambda x: F.concat(F.lit('"'), x["policy"], F.lit('": "'), x["s"], F.lit('"'))), ", ")
    rows = c.groupBy("doc_id").agg(body.alias("body"))
    k = T.hex_int(T.digest("raw", F.col("doc_id")), 1, 2) % 8
    text = F.when(k == 0, F.concat(F.lit("Sure: {"), F.regexp_replace("body", '^"H1": "[a-z_]+", ', ""), F.lit("} done"))).when(k == 1, F.concat(F.lit('{"H2": "satisfied", '), "body", F.lit("}"))).when(k == 2, F.concat(F.lit("{"), F.regexp_replace("body", '"T2": "[a-z_]+"', '"T2": "maybe"'), F.lit("}"))).when(k == 3, F.concat(F.lit("{"), "body", F.lit("} }"))).when(k == 4, F.concat(F.lit("{"), F.translate("body", '"', "'"), F.lit("}"))).otherwise(F.concat(F.lit("Sure: {"), "body", F.lit("} done")))
    return rows.select("doc_id", k.alias("k"), text.alias("reply"))


def _parse(s, d):
    p = _raw(s, d).withColumn("p", P.parse_cells(F.col("reply"), POL))
    return p.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.size("p.cells")).alias("cells"), F.sum(F.size("p.missing")).alias("missing"), F.sum(F.size("p.duplicate")).alias("duplicate"), F.sum(F.size("p.invalid")).alias("invalid"), F.count_if("p.strict").alias("strict"))


_K = "('0x' || substr(sha256(concat_ws(':', 'raw', doc_id::VARCHAR)), 1, 2))::BIGINT % 8"
_PARSE = fixtures.SQL + f", r AS (SELECT doc_id, {_K} AS k FROM label_cells WHERE variant = 'D0' AND state_id IS NOT NULL GROUP BY ALL) SELECT k, count(*) AS n, (sum(CASE WHEN k IN (3, 4) THEN 0 WHEN k IN (0, 1, 2) THEN 9 ELSE 10 END))::BIGINT AS cells, sum(CASE WHEN k IN (3, 4) THEN 10 WHEN k = 0 THEN 1 ELSE 0 END)::BIGINT AS missing, sum((k = 1)::INTEGER)::BIGINT AS duplicate, sum((k = 2)::INTEGER)::BIGINT AS invalid, count(*) FILTER (k > 4) AS strict FROM r GROUP BY k"


def _requests(s, d):
    """Fourteen requests an item: ten single, two blocks of five, one joint, one in Latin order."""
    cases = [F.struct(F.lit(f"single_{p}").alias("structure"), F.array(F.lit(p)).alias("policies")) for p in POL]
    cases += [F.struct(F.lit(f"block_{k}").alias("structure"), F.array(*map(F.lit, POL[5 * k : 5 * k + 5])).alias("policies")) for k in (0, 1)]
    cases += [F.struct(F.lit("joint").alias("structure"), F.array(*map(F.lit, POL)).alias("policies")), F.struct(F.lit("latin").alias("structure"), T.latin_order(list(POL), F.col("doc_id")).alias("policies"))]
    rows = _DOC(s, d).select("doc_id", F.explode(F.array(*cases)).alias("x"))
    return rows.select("doc_id", "x.structure", F.array_join("x.policies", ",").alias("policies"), F.size("x.policies").alias("n"))


_LATIN = "array_to_string([p[(doc_id + k) % 10 + 1] FOR k IN range(0, 10)], ',')"
_P = "[" + ", ".join(f"'{p}'" for p in POL) + "]"

QUERIES = {
    "item_id": (lambda s, d: _DOC(s, d).select("doc_id", T.item_id(F.col("source"), F.col("text"), F.col("lang")).alias("item_id")), "SELECT doc_id, substr(source, 1, 4) || '_' || substr(sha256(text || '||' || lang), 1, 16) AS item_id FROM documents"),
    "stable_uniform": (lambda s, d: rounded(_DOC(s, d).select("doc_id", T.uniform(T.digest("u", F.col("doc_id"))).alias("u"))), "SELECT doc_id, round(('0x' || substr(sha256(concat_ws(':', 'u', doc_id::VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE, 6) AS u FROM documents"),
    "normalize_text": (lambda s, d: _DOC(s, d).where(F.col("lang") == "en").select("doc_id", F.sha2(T.normalize_text(F.col("text")), 256).alias("h")), r"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[\p{P}\s]+', ' ', 'g'))) AS h FROM documents WHERE lang = 'en'"),
    # every language; SQL has no compatibility composition but the canonical one, which is the same where no text has compatibility characters
    "normalize_text_all": (lambda s, d: _DOC(s, d).select("doc_id", F.sha2(T.normalize_text(F.col("text")), 256).alias("h")), r"SELECT doc_id, sha256(trim(regexp_replace(lower(nfc_normalize(text)), '[\p{P}\s\p{Z}]+', ' ', 'g'))) AS h FROM documents"),
    "family_text": (lambda s, d: _DOC(s, d).select("doc_id", F.length(T.strip_suffix(F.col("text"), SUFFIXES)).alias("n")), "SELECT doc_id, (length(text) - CASE WHEN ends_with(text, 'Licensed under the Apache License, Version 2.0.') THEN 47 WHEN ends_with(text, ' 2.0.') THEN 5 WHEN ends_with(text, '.') THEN 1 ELSE 0 END)::INTEGER AS n FROM documents"),
    "shingles": (lambda s, d: _DOC(s, d).select("doc_id", F.size(T.shingles(F.lower("text"))).alias("n")), r"SELECT doc_id, CASE WHEN len(w) < 5 THEN 1 ELSE len(list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)])) END::INTEGER AS n FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents)"),
    "normalize_label": (lambda s, d: fixtures.table(s, d, "orders").select("o_orderkey", T.normalize_label(F.element_at(F.array(*map(F.lit, (" OK ", "Fail", "N/A", "Not-Applicable", "other"))), (F.col("o_orderkey") % 5 + 1).cast("int")), ALIASES).alias("state")).where("state IS NOT NULL"), "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'satisfied' WHEN 1 THEN 'violated' ELSE 'not_applicable' END AS state FROM orders WHERE o_orderkey % 5 <> 4"),
    "judge_requests": (_requests, f"WITH p AS (SELECT {_P} AS p) SELECT doc_id, 'single_' || x AS structure, x AS policies, 1 AS n FROM documents, (SELECT unnest(p) AS x FROM p) UNION ALL SELECT doc_id, 'block_' || k, array_to_string(p[5 * k + 1:5 * k + 5], ','), 5 FROM documents, p, (SELECT unnest([0, 1]) AS k) UNION ALL SELECT doc_id, 'joint', array_to_string(p, ','), 10 FROM documents, p UNION ALL SELECT doc_id, 'latin', {_LATIN}, 10 FROM documents, p"),
    "latin_balance": (lambda s, d: _DOC(s, d).select(F.posexplode(T.latin_order(list(POL), F.col("doc_id"))).alias("position", "policy")).groupBy("position", "policy").agg(F.count("*").alias("n")), f"WITH p AS (SELECT {_P} AS p) SELECT k::INTEGER AS position, p[(doc_id + k) % 10 + 1] AS policy, count(*) AS n FROM documents, p, (SELECT unnest(range(0, 10)) AS k) GROUP BY ALL"),
    "categories_union": (lambda s, d: fixtures.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(T.categories(F.map_from_arrays(F.array(*map(F.lit, ("returned", "open", "bulk"))), F.array(F.max(F.col("l_returnflag") == "R"), F.max(F.col("l_linestatus") == "O"), F.max(F.col("l_quantity") > 25)))), ",").alias("categories")), "SELECT l_orderkey, array_to_string(list_filter([CASE WHEN bool_or(l_quantity > 25) THEN 'bulk' END, CASE WHEN bool_or(l_linestatus = 'O') THEN 'open' END, CASE WHEN bool_or(l_returnflag = 'R') THEN 'returned' END], lambda x: x IS NOT NULL), ',') AS categories FROM lineitem GROUP BY l_orderkey"),
    "parse_judgment_cells": (_parse, _PARSE),
    "formula_escape": (lambda s, d: fixtures.table(s, d, "pages").select("page_id", T.escape_formula(F.concat(F.element_at(F.array(*map(F.lit, ("=", "+", "a", "@", ""))), (F.col("page_id") % 5 + 1).cast("int")), "url")).alias("cell")), "SELECT page_id, CASE WHEN page_id % 5 IN (0, 1, 3) THEN '''' ELSE '' END || ['=', '+', 'a', '@', ''][page_id % 5 + 1] || url AS cell FROM pages"),
}
