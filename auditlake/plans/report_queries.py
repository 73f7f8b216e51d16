"""Integrity reports, label audits, samples and comparisons in full."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import fixtures
from ..functions import parse as P
from ..functions import text as T
from ..functions.text import digest, hex_int, latin_order
from ..operators import audit as A
from ..operators import compare as C
from ..operators import integrity as I
from ..operators import metrics as M
from ..operators import prefixes, ranks
from ..operators import sampling as S
from ..operators import stats
from ..shared import shared_dir
from ..sources import files
from .audit_queries import _PAIRS, _hx, fingerprint_sql
from .compare_queries import _SCALED, _recovery
from .label_queries import _K, ALIASES, POL, _raw
from .metric_queries import _BINNED, _F1, _RATES, BIN, PRE, cells, rounded, tokens

KEYS = ["variant", "policy"]
_T = fixtures.table
_DOC = lambda s, d: fixtures.table(s, d, "documents")
_LABELS = lambda s, d: fixtures.label_cells(_DOC(s, d))
_CELLS = lambda f: lambda s, d: rounded(f(cells(s, d)))
_SPLIT_SHARES = {"train": 60, "calib": 15, "test": 15, "audit": 5, "conflict": 5}


def _at(values, index):
    """The value of a list of literals at a column from 0."""
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _jsonl(s, d):
    k, i = F.col("doc_id") % 7, F.col("doc_id")
    line = (
        F.when(k == 0, "").when(k == 1, F.concat(F.lit('{"id": "d'), i)).when(k == 2, '{"quality": 1}').when(k == 3, '{"id": "", "quality": 1}')
        .when(k == 4, F.concat(F.lit('{"id": "g'), F.floor(i / 70), F.lit('", "quality": 1}'))).when(k == 5, F.concat(F.lit('["d'), i, F.lit('"]')))
        .otherwise(F.concat(F.lit('{"id": "d'), i, F.lit('", "quality": '), F.col("quality"), F.lit("}")))
    )
    path = f"{shared_dir(s)}/jsonl-{uuid.uuid4().hex}"
    _T(s, d, "labels").select(line.alias("value")).write.text(path)
    good, bad = files.read_jsonl(s, path, StructType([StructField("id", StringType()), StructField("quality", StringType())]))
    return bad.groupBy("reason").agg(F.sum("n").alias("n")).unionByName(good.agg(F.lit("good").alias("reason"), F.count("*").alias("n")))


_JSONL = """WITH l AS (SELECT doc_id % 7 AS k, doc_id // 70 AS g FROM labels), dup AS (SELECT g, count(*) AS n FROM l WHERE k = 4 GROUP BY g)
SELECT reason, n FROM (
SELECT CASE k WHEN 0 THEN 'blank line' WHEN 1 THEN 'invalid line' WHEN 5 THEN 'invalid line' WHEN 2 THEN 'missing key' WHEN 3 THEN 'empty key' END AS reason, count(*) AS n FROM l WHERE k IN (0, 1, 2, 3, 5) GROUP BY ALL
UNION ALL SELECT 'duplicate key', sum(n)::BIGINT FROM dup WHERE n > 1
UNION ALL SELECT 'good', (SELECT count(*) FROM l WHERE k = 6) + (SELECT count(*) FROM dup WHERE n = 1)) WHERE n > 0"""


def _fingerprints(s, d):
    of = lambda t, n: I.fingerprint(t).withColumn("artifact", F.lit(n))
    nation, labels, region = (_T(s, d, t) for t in ("nation", "labels", "region"))
    now = of(nation, "nation").unionByName(of(region, "region")).unionByName(of(labels, "labels"))
    frozen = of(nation.withColumn("n_name", F.when(F.col("n_nationkey") == 3, "elsewhere").otherwise(F.col("n_name"))), "nation").unionByName(of(region, "region")).unionByName(of(region, "ghost"))
    return I.verify_fingerprints(now, frozen)


_NATION, _REGION, _FROZEN = ("n_name", "n_nationkey", "n_regionkey"), ("r_name", "r_regionkey"), "(SELECT * REPLACE (CASE WHEN n_nationkey = 3 THEN 'elsewhere' ELSE n_name END AS n_name) FROM nation)"
_MANIFEST = (
    f"WITH now AS (SELECT 'nation' AS artifact, {fingerprint_sql('nation', _NATION)} UNION ALL SELECT 'region', {fingerprint_sql('region', _REGION)} UNION ALL SELECT 'labels', {fingerprint_sql('labels', ('doc_id', 'quality', 'toxic'))}), "
    f"frozen AS (SELECT 'nation' AS artifact, {fingerprint_sql(_FROZEN, _NATION)} UNION ALL SELECT 'region', {fingerprint_sql('region', _REGION)} UNION ALL SELECT 'ghost', {fingerprint_sql('region', _REGION)}) "
    "SELECT coalesce(a.artifact, b.artifact) AS artifact, CASE WHEN a.artifact IS NULL THEN 'absent' WHEN b.artifact IS NULL THEN 'not listed' ELSE 'changed' END AS reason FROM now a FULL JOIN frozen b ON a.artifact = b.artifact WHERE a.artifact IS NULL OR b.artifact IS NULL OR a.n_rows <> b.n_rows OR a.fingerprint <> b.fingerprint"
)


def _shards(s, d):
    docs = _DOC(s, d).select("doc_id")
    i = F.col("doc_id")
    shard = I.shard_of(i, 4)
    moved = docs.where(i % 97 != 0).withColumn("shard", F.when(i % 83 == 0, (shard + 1) % 4).otherwise(shard))
    twice = docs.where((i % 89 == 0) & (i % 97 != 0)).withColumn("shard", (shard + 2) % 4)
    return I.shard_check(docs, moved.unionByName(twice), "doc_id", "shard", shard)


def _judgments(s, d):
    p = _raw(s, d).withColumn("labels", P.parse_labels(F.col("reply"), POL, ALIASES))
    return p.groupBy("k").agg(F.count("*").alias("n"), F.count("labels").alias("n_parsed"), F.count_if(F.col("labels")["H2"] == "satisfied").alias("h2_satisfied"))


def _flags(s, d):
    k = F.col("o_orderkey") % 6
    t = F.when(k == 0, '{"a": true, "b": false}').when(k == 1, '{"a": true}').when(k == 2, '{"a": true, "b": "false"}').when(k == 3, '{"a": true, "a": false, "b": true}').when(k == 4, 'x {"b": true, "a": false} y').otherwise('{"a": true, "b": false, "c": true}')
    parsed = _T(s, d, "orders").select(k.alias("k"), P.parse_flags(t, ("a", "b")).alias("f"))
    return parsed.groupBy("k").agg(F.count("*").alias("n"), F.count("f").alias("n_parsed"), F.count_if(F.col("f")["a"]).alias("n_a"), F.count_if(F.col("f")["b"]).alias("n_b"))


_DEFINITIONS = {p: f"rule {p}" for p in POL}


def _messages(s, d):
    order = T.latin_order(list(POL), F.col("doc_id"))
    return _DOC(s, d).select("doc_id", F.sha2(T.judge_message(F.coalesce("text", F.lit("")), F.col("lang"), order, _DEFINITIONS), 256).alias("message"))


_P = "[" + ", ".join(f"'{p}'" for p in POL) + "]"
_MESSAGES = f"WITH p AS (SELECT {_P} AS p) SELECT doc_id, sha256('Policies:' || chr(10) || array_to_string(['- ' || p[(doc_id + k) % 10 + 1] || ': rule ' || p[(doc_id + k) % 10 + 1] FOR k IN range(0, 10)], chr(10)) || chr(10) || chr(10) || 'Prompt:' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'Response:' || chr(10) || lang || chr(10) || chr(10) || 'Answer with one JSON object, a state for each policy.') AS message FROM documents, p"


def _round_trip(s, d):
    wide = I.to_wide(_LABELS(s, d), ["doc_id", "variant"], "state_id", "labels")
    return I.to_long(wide, ["doc_id", "variant"], {"labels": "state_id"}, list(POL)).groupBy("variant", "policy").agg(F.count("*").alias("n"), F.count("state_id").alias("n_labelled"), F.sum("state_id").alias("states"))


def _poles(s, d):
    i = F.col("doc_id")
    return _DOC(s, d).select("doc_id", S.soft_pole(_at(["high", "low", "none"], i % 3), F.when(i % 5 != 0, i % 2 == 0)).alias("pole")).where("pole IS NOT NULL")


def _grid(s, d):
    return S.template_grid(_T(s, d, "region").select(F.col("r_name").alias("action")), _T(s, d, "nation").select(F.col("n_name").alias("context")))


def _manifest(s, d):
    docs = _DOC(s, d).select("doc_id").where("doc_id % 5 <> 0")
    listed = _T(s, d, "labels").select("doc_id")
    return I.manifest_check(docs, listed.unionByName(listed.where("doc_id % 31 = 0")), "doc_id")


def _split_report(s, d):
    rows = S.share_split(_DOC(s, d).select("doc_id"), digest("split", F.col("doc_id")), _SPLIT_SHARES)
    n = _DOC(s, d).count()
    due = {k: n * v // 100 for k, v in _SPLIT_SHARES.items() if k != "conflict"}
    return I.split_counts(rows, "doc_id", "split", due)


_SHARES = f"WITH n AS (SELECT count(*) AS n FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(concat_ws(':', 'split', doc_id::VARCHAR))) AS rank FROM documents), c AS (SELECT n * 60 // 100 AS a, n * 15 // 100 AS b, n * 15 // 100 AS c, n * 5 // 100 AS e FROM n), sp AS (SELECT doc_id, rank, CASE WHEN rank <= a THEN 'train' WHEN rank <= a + b THEN 'calib' WHEN rank <= a + b + c THEN 'test' WHEN rank <= a + b + c + e THEN 'audit' ELSE 'conflict' END AS split FROM r, c) "


def _maps(s, d):
    docs = _DOC(s, d)
    i = F.col("doc_id")
    pick = lambda salt, n: hex_int(digest(salt, i), 1, 2) % n
    side = lambda a, b: docs.select(i.alias("source_id"), F.col("lang").alias("family"), F.array(F.concat(F.lit("t"), pick(a, 3)), F.lit("t9")).alias("targets"), _at(["broad", "close"], pick(b, 2)).alias("relation"))
    decided = docs.where(pick("m5", 4) > 0).select(i.alias("source_id"), F.col("lang").alias("family"), F.array(F.lit("t5")).alias("targets"), F.lit("exact").alias("relation"))
    return I.merge_maps(side("m1", "m2"), side("m3", "m4"), decided, ["source_id", "family"]).select("source_id", F.array_join("targets", ",").alias("targets"), "relation", "status")


_MAPS = f"WITH x AS (SELECT doc_id, {_hx('m1')} % 3 AS t1, {_hx('m2')} % 2 AS r1, {_hx('m3')} % 3 AS t2, {_hx('m4')} % 2 AS r2, {_hx('m5')} % 4 > 0 AS d FROM documents), y AS (SELECT *, CASE WHEN t1 = t2 AND r1 = r2 THEN 'agree' WHEN t1 = t2 AND d THEN 'same targets' WHEN d THEN 'adjudicated' ELSE 'undecided' END AS status FROM x) SELECT doc_id AS source_id, CASE WHEN status IN ('agree', 'same targets') THEN 't' || t1 || ',t9' WHEN status = 'adjudicated' THEN 't5' END AS targets, CASE status WHEN 'agree' THEN ['broad', 'close'][r1 + 1] WHEN 'undecided' THEN NULL ELSE 'exact' END AS relation, status FROM y"


def _finalize(s, d, part):
    docs = _DOC(s, d)
    i = F.col("doc_id")
    label = lambda salt: (hex_int(digest(salt, i), 1, 2) % 3).alias("label")
    a, b = docs.where(i % 41 != 0).select("doc_id", label("r1")), docs.select("doc_id", label("r2"))
    extra = docs.where(i % 43 == 0).select((-i - 1).alias("doc_id"), F.lit(0).cast("long").alias("label"))
    final = docs.where(hex_int(digest("r4", i), 1, 2) < 200).select("doc_id", label("r3")).unionByName(extra)
    return I.finalize(a, b, final, "doc_id", "label")[part]


_FINAL = f"WITH x AS (SELECT doc_id, CASE WHEN doc_id % 41 <> 0 THEN {_hx('r1')} % 3 END AS a, {_hx('r2')} % 3 AS b, CASE WHEN {_hx('r4')} < 200 THEN {_hx('r3')} % 3 END AS c FROM documents), y AS (SELECT *, CASE WHEN a IS NULL THEN 'one annotator' WHEN a = b AND c IS NOT NULL AND c <> a THEN 'agreed row changed' WHEN a <> b AND c IS NULL THEN 'undecided' END AS reason FROM x) "


def _siblings(s, d):
    k = F.col("o_orderkey")
    pairs = _T(s, d, "orders").select(F.concat(F.lit("p"), "o_custkey").alias("prompt"), *[F.concat(F.lit("r"), k, F.lit(x)).alias(f"response_{n}") for n, x in enumerate("ab")], (k % 3 != 0).alias("safe_0"), (k % 2 == 0).alias("safe_1"), k.alias("id"))
    chosen = pairs.select("id", "prompt", F.col("response_0").alias("response"))
    return I.safe_sibling(pairs.drop("id"), chosen, "generic")


def _choose(s, d):
    t = _T(s, d, "orders").select("o_orderkey", F.array("o_orderpriority", F.lit(None), F.lit(""), "o_orderstatus").alias("x"))
    return t.select("o_orderkey", S.choose_one(F.col("x"), digest("pick", F.col("o_orderkey"))).alias("picked"))


def _rated(s, d):
    line = _T(s, d, "lineitem")
    has = lambda k, c: F.when(c, F.struct(F.lit(k).alias("key"), F.struct(F.concat(F.lit(k), F.lit(":"), F.col("l_linenumber")).alias("Rating")).alias("value")))
    notes = F.filter(F.array(has("helpfulness", F.lit(True)), has("honesty", F.col("l_returnflag") == "R")), lambda x: x.isNotNull())
    text = F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("r"), "l_linenumber")).otherwise("")
    rows = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", text.alias("response"), notes.alias("notes")))).alias("x"))
    completions = F.transform("x", lambda c: F.struct(c["response"].alias("response"), F.map_from_entries(c["notes"]).alias("annotations")))
    chosen = S.choose_rated(completions, digest("rate", F.col("l_orderkey")), ["helpfulness", "honesty", "truthfulness"])
    return rows.select("l_orderkey", chosen.alias("c")).where("c IS NOT NULL").select("l_orderkey", "c.*")


_RATED = "WITH x AS (SELECT l_orderkey, list({'k': l_linenumber, 'f': l_returnflag} ORDER BY l_linenumber, l_returnflag = 'R') AS c FROM lineitem GROUP BY l_orderkey), y AS (SELECT l_orderkey, c[('0x' || substr(sha256(concat_ws(':', 'rate', l_orderkey::VARCHAR)), 1, 8))::BIGINT % len(c) + 1] AS c FROM x) SELECT l_orderkey, 'r' || c.k AS response, 'helpfulness:' || c.k AS helpfulness, CASE WHEN c.f = 'R' THEN 'honesty:' || c.k END AS honesty, NULL::VARCHAR AS truthfulness FROM y WHERE c.k % 3 <> 0"


def _schedule(s, d):
    """Every document's order from the confirmatory base: the canonical one with its first two swapped, rotated by the row's index."""
    rows = ranks.ranked(_DOC(s, d).select("doc_id"), [], "doc_id")
    base = [POL[1], POL[0], *POL[2:]]
    return A.schedule_balance(rows.select(latin_order(base, F.col("rank") - 1).alias("o")), "o", list(POL))


_SCHEDULE = "WITH b AS (SELECT [" + ", ".join(f"'{p}'" for p in (POL[1], POL[0], *POL[2:])) + "] AS b), r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), o AS (SELECT [b[(i + k) % 10 + 1] FOR k IN range(0, 10)] AS o FROM r, b), t AS (SELECT count(*) AS n, count(*) FILTER (o = [" + ", ".join(f"'{p}'" for p in POL) + "]) AS u FROM o), h AS (SELECT o[k + 1] AS policy, k AS position, count(*) AS c FROM o, (SELECT unnest(range(0, 10)) AS k) GROUP BY ALL) SELECT policy, position::INTEGER AS position, c AS n, abs(c * 10 - n) < 10 AS balanced, u AS n_unchanged FROM h, t"


def _candidates(s, d):
    strata = {"de": F.col("lang") == "de", "long": F.col("n_chars") > 2000, "src0": F.col("source") == "src0", "none": F.lit(False)}
    return S.candidate_set(_DOC(s, d), "doc_id", strata, digest("cand", F.col("doc_id")), 40)


_CAND = "WITH e AS (SELECT doc_id, sha256(concat_ws(':', 'cand', doc_id::VARCHAR)) AS o, unnest(list_filter([CASE WHEN lang = 'de' THEN 'de' END, CASE WHEN n_chars > 2000 THEN 'long' END, CASE WHEN source = 'src0' THEN 'src0' END], lambda x: x IS NOT NULL)) AS s FROM documents), k AS (SELECT doc_id, s FROM e QUALIFY row_number() OVER (PARTITION BY s ORDER BY o) <= 40) "


def _balanced(s, d):
    c = _LABELS(s, d).where("variant = 'D0' AND state_id IS NOT NULL")
    return c, S.class_balanced(c, "doc_id", digest("cb", F.col("doc_id"), F.col("policy")), digest("fill", F.col("doc_id")), 5, 150)


_BAL = PRE + ", c AS (SELECT doc_id, policy, state_id FROM label_cells WHERE variant = 'D0' AND state_id IS NOT NULL), b AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM c WHERE state_id IN (0, 1) QUALIFY row_number() OVER (PARTITION BY policy, state_id ORDER BY sha256(concat_ws(':', 'cb', doc_id::VARCHAR, policy))) <= 5)), f AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM c WHERE doc_id NOT IN (SELECT doc_id FROM b)) ORDER BY sha256(concat_ws(':', 'fill', doc_id::VARCHAR)) LIMIT greatest(0, 150 - (SELECT count(*) FROM b))), u AS (SELECT doc_id, 'class' AS chosen_by FROM b UNION ALL SELECT doc_id, 'fill' FROM f) "


def _prefixes(s, d):
    placed = prefixes.balanced_prefixes(_DOC(s, d).select("doc_id", "lang"), "lang", digest("pre", F.col("doc_id")), ["en", "de", "fr", "es"])
    return placed.select("doc_id", "lang", "place", "position")


_PREFIXES = """WITH RECURSIVE s AS (SELECT ['en', 'de', 'fr', 'es'] AS names),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat_ws(':', 'pre', doc_id::VARCHAR))) AS place FROM documents, s WHERE list_contains(names, lang)),
t AS (SELECT quota, list_sum(quota) AS total FROM (SELECT [n_en, n_de, n_fr, n_es] AS quota FROM (SELECT count(*) FILTER (lang = 'en') AS n_en, count(*) FILTER (lang = 'de') AS n_de, count(*) FILTER (lang = 'fr') AS n_fr, count(*) FILTER (lang = 'es') AS n_es FROM r))),
g(n, pick, given) AS (SELECT 0, 0, [0, 0, 0, 0] UNION ALL
  SELECT n + 1, p, [given[i] + (i = p)::INTEGER FOR i IN range(1, 5)]
  FROM (SELECT n, given, list_sort([{'lack': given[i] * total - quota[i] * (n + 1), 'i': i} FOR i IN range(1, 5)])[1].i AS p FROM g, t WHERE n < total))
SELECT doc_id, lang, place::BIGINT AS place, n::BIGINT AS position FROM g, s JOIN r ON r.lang = names[pick] AND r.place = given[pick] WHERE pick > 0"""


def _quotas(s, d):
    sizes = _DOC(s, d).groupBy(F.concat_ws(":", "lang", "source").alias("stratum")).agg(F.count("*").alias("capacity"))
    return prefixes.balanced_quotas(sizes, "stratum", "capacity", 150)


_QUOTAS = """WITH RECURSIVE c AS (SELECT list(s ORDER BY s) AS names, list(n ORDER BY s) AS cap FROM (SELECT lang || ':' || source AS s, count(*) AS n FROM documents GROUP BY 1)),
g(k, a) AS (SELECT 0, [0 FOR x IN cap] FROM c UNION ALL
  SELECT k + 1, [a[i] + (i = p)::INTEGER FOR i IN range(1, len(a) + 1)]
  FROM (SELECT k, a, list_sort(list_filter([{'a': a[i], 'f': a[i] / cap[i]::DOUBLE, 'i': i} FOR i IN range(1, len(a) + 1)], lambda x: x.a < cap[x.i]))[1].i AS p FROM g, c WHERE k < 150))
SELECT unnest(names) AS stratum, unnest(cap) AS capacity, unnest(a)::BIGINT AS quota FROM g, c WHERE k = 150"""


def _floor(s, d):
    rows = _DOC(s, d).where("n_chars > 300").select("doc_id", F.array("lang", "source").alias("groups"), digest("ff", F.col("doc_id")).alias("o"))
    return S.floor_then_fill(rows, "doc_id", "groups", ["o"], 4, 200)


_FLOOR = "WITH d AS (SELECT doc_id, [lang, source] AS g, sha256(concat_ws(':', 'ff', doc_id::VARCHAR)) AS o FROM documents WHERE n_chars > 300), b AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM (SELECT doc_id, o, unnest(g) AS x FROM d) QUALIFY row_number() OVER (PARTITION BY x ORDER BY o) <= 4)), f AS (SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM b) ORDER BY o LIMIT greatest(0, 200 - (SELECT count(*) FROM b))) SELECT doc_id FROM b UNION ALL SELECT doc_id FROM f"


def _sheets(s, d):
    drawn = S.stratified_draw(_DOC(s, d).select("doc_id", "lang", "source"), ["lang"], [digest("draw", F.col("doc_id"))], 25)
    private, blind = S.audit_sheets(drawn, "doc_id", digest("private", F.col("doc_id")), digest("blind", F.col("doc_id")), ["lang", "source", "place", "population", "inclusion", "weight"])
    return private.select("doc_id", "lang", "place", F.col("position").alias("private_position")).join(blind.select("doc_id", F.col("position").alias("blind_position"), F.coalesce("annotator_1", F.lit("")).alias("annotator_1")), "doc_id")


_SHEETS = "WITH w AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat_ws(':', 'draw', doc_id::VARCHAR)))::INTEGER AS place FROM documents QUALIFY place <= 25) SELECT doc_id, lang, place, row_number() OVER (ORDER BY sha256(concat_ws(':', 'private', doc_id::VARCHAR))) AS private_position, row_number() OVER (ORDER BY sha256(concat_ws(':', 'blind', doc_id::VARCHAR))) AS blind_position, '' AS annotator_1 FROM w"


def _attempts(s, d):
    i = F.col("doc_id")
    rec = _LABELS(s, d).where("variant = 'D0'").groupBy("doc_id").agg((F.count("state_id") == 10).alias("parse_ok"))
    return A.parse_audit(rec.withColumn("attempts", 1 + (hex_int(digest("att", i), 1, 2) < 8).cast("int")), "parse_ok", "attempts")


def _categories(s, d):
    t = _T(s, d, "lineitem").join(_T(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey")
    rows = t.groupBy("l_orderkey").agg(F.array_union(F.collect_set("p_brand"), F.collect_set("p_type")).alias("categories"), F.max(F.col("l_returnflag") == "R").alias("unsafe"))
    owners = _T(s, d, "part").select(F.col("p_brand").alias("category")).distinct().withColumn("owner", F.concat(F.lit("owner of "), "category"))
    return A.category_frequency(rows, "categories", "unsafe", owners)


_CATS = "WITH c AS (SELECT DISTINCT l_orderkey, unnest([p_brand, p_type]) AS category FROM lineitem JOIN part ON p_partkey = l_partkey), u AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS unsafe FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL) SELECT category, count(*) AS n, count(*) FILTER (unsafe) AS n_unsafe, CASE WHEN category IN (SELECT p_brand FROM part) THEN 'owner of ' || category END AS owner FROM c JOIN u USING (l_orderkey) GROUP BY category"


def _calls(s, d):
    """Answers by structure: single ones, a joint one that omits some cells and repeats others."""
    base = _LABELS(s, d).where("variant = 'D0'").select("doc_id", "policy", "state_id")
    h = hex_int(digest("call", F.col("doc_id"), F.col("policy")), 1, 2)
    order = T.latin_order(list(POL), F.col("doc_id"))
    joint = base.withColumn("h", h).where("h >= 8").select("doc_id", F.lit("joint").alias("structure"), (F.array_position(order, F.col("policy")) - 1).cast("int").alias("position"), "policy", F.when(F.col("h") < 40, (F.col("state_id") + 1) % 3).otherwise(F.col("state_id")).cast("int").alias("state_id"))
    single = base.select("doc_id", F.lit("single").alias("structure"), F.lit(0).alias("position"), "policy", "state_id")
    again = base.where(h >= 248).select("doc_id", F.lit("joint").alias("structure"), F.lit(0).alias("position"), "policy", "state_id")
    return base, single.unionByName(joint), again


def _structure(s, d):
    base, calls, _ = _calls(s, d)
    out = A.structure_agreement(calls, base.withColumnRenamed("state_id", "ref"))
    return rounded(out.withColumn("position", F.coalesce("position", F.lit(-1))))


def _coverage(s, d):
    _, calls, again = _calls(s, d)
    return A.coverage(calls.unionByName(again), _DOC(s, d), ["single", "joint"], list(POL))


_CALLS = PRE + ", b AS (SELECT l.doc_id, l.policy, l.state_id, (ord - l.doc_id % 10 + 10) % 10 AS pos, ('0x' || substr(sha256(concat_ws(':', 'call', l.doc_id::VARCHAR, l.policy)), 1, 2))::BIGINT AS h FROM label_cells l JOIN policies p ON p.policy = l.policy WHERE variant = 'D0'), calls AS (SELECT doc_id, 'single' AS structure, 0 AS position, policy, state_id, state_id AS ref FROM b UNION ALL SELECT doc_id, 'joint', pos, policy, CASE WHEN h < 40 THEN (state_id + 1) % 3 ELSE state_id END, state_id FROM b WHERE h >= 8) "


def _provenance_rows(s, d):
    l, i = _T(s, d, "labels"), F.col("doc_id")
    rows = l.where("toxic IS NOT NULL").select("doc_id", "toxic", F.when(i % 9 == 0, F.array("quality").cast("array<string>")).when(F.col("toxic") == 1, F.array(F.concat(F.lit("c"), i % 4))).otherwise(F.array().cast("array<string>")).alias("categories"))
    rows = rows.withColumn("categories", F.when(i % 13 == 0, F.array().cast("array<string>")).otherwise(F.col("categories")))
    return rows.unionByName(rows.where(i % 17 == 0))


_PROV = "WITH p0 AS (SELECT doc_id, toxic, CASE WHEN doc_id % 13 = 0 THEN [] WHEN doc_id % 9 = 0 THEN [quality::VARCHAR] WHEN toxic = 1 THEN ['c' || doc_id % 4] ELSE [] END AS cats FROM labels WHERE toxic IS NOT NULL), p AS (SELECT * FROM p0 UNION ALL SELECT * FROM p0 WHERE doc_id % 17 = 0) "


def _effect(c):
    rows = c.where("variant = 'D0' AND state_id IS NOT NULL")
    return C.mismatch_effect(rows, "lang", "en", "de", ["policy"], F.col("pred") != F.col("state_id"), 1.0 / (1 + F.col("doc_id") % 4))


def _weighted_kappa(c):
    h = lambda salt: hex_int(digest(salt, F.col("doc_id"), F.col("policy")), 1, 2)
    two = c.where("variant = 'D0'").withColumns({"a": F.when(h("ann1") < 32, (F.col("state_id") + 1) % 3).otherwise(F.col("state_id")), "b": F.when(h("ann2") < 48, (F.col("state_id") + 2) % 3).otherwise(F.col("state_id"))})
    return M.kappa(two, ["policy"], "a", "b", 1.0 / (1 + F.col("doc_id") % 4))


def _divergence_checks(s, d):
    t = tokens(s, d)
    k = F.col("l_orderkey")
    total = F.aggregate("log_ratios", F.lit(0.0), lambda a, x: a + x)
    items = t.where(k % 50 != 0).select("l_orderkey", (total + F.when(k % 37 == 0, 0.5).otherwise(0.0)).alias("log_ratio_sum"))
    seen = t.where(k % 41 != 0).withColumn("log_ratios", F.when(k % 43 == 0, F.array_append("log_ratios", F.lit(float("nan")))).otherwise(F.col("log_ratios")))
    return M.divergence_checks(seen, items, "l_orderkey", "log_ratios", "log_ratio_sum")


def _points(s, d):
    c = cells(s, d).where("state_id IS NOT NULL")
    return c.groupBy(*KEYS).agg(F.avg("conf").alias("x"), F.avg("correct").alias("y"))


_SQRT = PRE + ", pt AS (SELECT variant, policy, sqrt(avg(conf)) AS x, avg(correct) AS y FROM scored WHERE state_id IS NOT NULL GROUP BY ALL), f AS (SELECT sum(x * y) / sum(x * x) AS b, avg(y) AS m, count(*) AS n FROM pt), l AS (SELECT p.x, p.y, (SELECT sum(q.x * q.y) / sum(q.x * q.x) FROM pt q WHERE (p.variant, p.policy) <> (q.variant, q.policy)) AS b1 FROM pt p), t AS (SELECT max(b) AS b, sum((y - b * x)**2) AS sse, sum((y - m)**2) AS sst, sum((y - b1 * x)**2) AS loo, avg(abs(y - b1 * x)) AS mae, sqrt(avg((y - b1 * x)**2)) AS rmse, max(n) AS n FROM l, f) SELECT round(b, 6) AS slope, 0.0::DOUBLE AS intercept, round(1 - sse / sst, 6) AS r2, round(sse, 6) AS sse, round(n * ln(sse / n) + 4 + 12 / (n - 3.0::DOUBLE), 6) AS aicc, round(1 - loo / sst, 6) AS loo_r2, round(mae, 6) AS loo_mae, round(rmse, 6) AS loo_rmse FROM t"
_LIN = "('0x' || substr(sha256(concat_ws(':', '{0}', doc_id::VARCHAR, policy)), 1, 2))::BIGINT"

_DELTAS = PRE + f", e AS (SELECT variant, policy, sum(n * abs(acc - mc)) / sum(n) AS ece FROM ({_BINNED}) GROUP BY ALL), r AS (SELECT variant, policy, n_violated, {_F1} AS f1, fn / n_violated AS fnr, fp / n_satisfied AS fpr FROM ({_RATES})), x AS (SELECT * FROM e JOIN r USING (variant, policy)), dr AS (SELECT a.variant, a.policy, a.ece - b.ece AS d_ece, a.f1 - b.f1 AS d_f1, a.fnr - b.fnr AS d_fn, a.fpr - b.fpr AS d_fp, least(a.n_violated, b.n_violated) >= 30 AS powered FROM x a JOIN x b ON a.policy = b.policy AND b.variant = 'D0' AND a.variant <> 'D0') "

_STD = "SELECT variant, policy, sum(n * abs(acc - mc)) / sum(n) AS ece FROM (SELECT variant, policy, {bin} AS bin, sum(w) AS n, sum(w * conf) / sum(w) AS mc, sum(w * correct) / sum(w) AS acc FROM scored JOIN (SELECT a.variant, a.policy, a.state_id, b.share / a.share AS w FROM sh a JOIN sh b ON a.variant = '{a}' AND b.variant = '{b}' AND a.policy = b.policy AND a.state_id = b.state_id) USING (variant, policy, state_id) GROUP BY ALL) GROUP BY ALL"

QUERIES = {
    "jsonl_violations": (_jsonl, _JSONL),
    "fingerprint_manifest": (_fingerprints, _MANIFEST),
    "shard_violations": (_shards, "SELECT doc_id AS id, CASE WHEN doc_id % 97 = 0 THEN 'lost' WHEN doc_id % 89 = 0 THEN 'in two shards' ELSE 'in another shard' END AS reason FROM documents WHERE doc_id % 97 = 0 OR doc_id % 89 = 0 OR doc_id % 83 = 0"),
    "parse_judgment": (_judgments, fixtures.SQL + f", r AS (SELECT doc_id, {_K} AS k, max(state_id) FILTER (policy = 'H2') AS h2 FROM label_cells WHERE variant = 'D0' AND state_id IS NOT NULL GROUP BY ALL) SELECT k, count(*) AS n, CASE WHEN k IN (0, 2, 3, 4) THEN 0 ELSE count(*) END AS n_parsed, CASE WHEN k IN (0, 2, 3, 4) THEN 0 ELSE count(*) FILTER (h2 = 0) END AS h2_satisfied FROM r GROUP BY k"),
    "parse_flags": (_flags, "SELECT k, n, CASE WHEN k IN (0, 4) THEN n ELSE 0 END AS n_parsed, CASE WHEN k = 0 THEN n ELSE 0 END AS n_a, CASE WHEN k = 4 THEN n ELSE 0 END AS n_b FROM (SELECT o_orderkey % 6 AS k, count(*) AS n FROM orders GROUP BY ALL)"),
    "judge_messages": (_messages, _MESSAGES),
    "label_round_trip": (_round_trip, PRE + "SELECT variant, policy, count(*) AS n, count(state_id) AS n_labelled, sum(state_id)::BIGINT AS states FROM label_cells GROUP BY ALL"),
    "soft_poles": (_poles, "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['high', 'low', 'none'][doc_id % 3 + 1] ELSE CASE doc_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' END END AS pole FROM documents WHERE doc_id % 5 <> 0 AND NOT (doc_id % 2 = 1 AND doc_id % 3 = 2)"),
    "template_grid": (_grid, "SELECT r_name AS action, n_name AS context, (row_number() OVER (ORDER BY r_name, n_name) - 1)::INTEGER AS position FROM region, nation"),
    "manifest_violations": (_manifest, "SELECT coalesce(l.doc_id, d.doc_id) AS id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN l.doc_id IS NULL THEN 'not listed' ELSE 'listed twice' END AS reason FROM (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0) d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL OR l.doc_id % 31 = 0"),
    "split_report": (_split_report, _SHARES + ", k AS (SELECT split, count(*) AS n, count(DISTINCT doc_id) AS n_ids FROM sp GROUP BY split) SELECT split, k.n, n_ids, CASE split WHEN 'train' THEN n.n * 60 // 100 WHEN 'audit' THEN n.n * 5 // 100 WHEN 'conflict' THEN NULL ELSE n.n * 15 // 100 END AS expected, split <> 'conflict' AS ok FROM k, n"),
    "salted_split": (lambda s, d: S.share_split(_DOC(s, d).select("doc_id"), digest("split", F.col("doc_id")), _SPLIT_SHARES).select("doc_id", "rank", "split"), _SHARES + "SELECT doc_id, rank, split FROM sp"),
    "set_equality": (lambda s, d: I.same_ids(_DOC(s, d).where("doc_id % 3 <> 0"), _T(s, d, "labels"), "doc_id"), "SELECT count(*) FILTER (b.doc_id IS NULL) AS first_only, count(*) FILTER (a.doc_id IS NULL) AS second_only, count(*) FILTER (a.doc_id = b.doc_id) AS shared, false AS equal FROM (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) a FULL JOIN labels b ON a.doc_id = b.doc_id"),
    "map_review": (_maps, _MAPS),
    "finalized_labels": (lambda s, d: _finalize(s, d, 0), _FINAL + "SELECT doc_id, CASE WHEN a = b THEN a ELSE c END AS label FROM y WHERE reason IS NULL"),
    "finalize_violations": (lambda s, d: _finalize(s, d, 1), _FINAL + "SELECT doc_id AS id, reason FROM y WHERE reason IS NOT NULL UNION ALL SELECT -doc_id - 1, 'unknown id' FROM documents WHERE doc_id % 43 = 0"),
    "safe_siblings": (_siblings, "SELECT o_orderkey AS id, 'p' || o_custkey AS prompt, 'r' || o_orderkey || 'a' AS response, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'r' || o_orderkey || 'b' ELSE 'generic' END AS preferred, o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS has_sibling FROM orders"),
    "choose_one": (_choose, "SELECT o_orderkey, CASE ('0x' || substr(sha256(concat_ws(':', 'pick', o_orderkey::VARCHAR)), 1, 8))::BIGINT % 2 WHEN 0 THEN o_orderpriority ELSE o_orderstatus END AS picked FROM orders"),
    "candidate_set": (lambda s, d: _candidates(s, d).select("doc_id", F.array_join("strata", ",").alias("strata")), _CAND + "SELECT doc_id, string_agg(s, ',' ORDER BY s) AS strata FROM k GROUP BY doc_id"),
    "candidate_shortfall": (lambda s, d: S.shortfall(_candidates(s, d), ["de", "long", "none", "src0"], 40), _CAND + "SELECT x AS stratum, count(k.doc_id) AS n, 40 - count(k.doc_id) AS short FROM (SELECT unnest(['de', 'long', 'none', 'src0']) AS x) LEFT JOIN k ON s = x GROUP BY x"),
    "class_balanced_set": (lambda s, d: _balanced(s, d)[1], _BAL + "SELECT doc_id, chosen_by FROM u"),
    "support_gate": (lambda s, d: S.support_gate(*_balanced(s, d), "doc_id", 20), _BAL + "SELECT policy, count(*) FILTER (state_id = 1) AS n_violated, count(*) FILTER (state_id = 0) AS n_satisfied, least(count(*) FILTER (state_id = 1), count(*) FILTER (state_id = 0)) >= 20 AS passes FROM c WHERE doc_id IN (SELECT doc_id FROM u) GROUP BY policy"),
    "balanced_prefixes": (_prefixes, _PREFIXES),
    "balanced_quotas": (_quotas, _QUOTAS),
    "floor_then_fill": (_floor, _FLOOR),
    "audit_sheets": (_sheets, _SHEETS),
    "static_label_audit": (_CELLS(lambda c: A.static_audit(c.where("variant = 'D0'"), ["H1", "H2"], 0.34, 0.33)), PRE + "SELECT policy, count(*) FILTER (state_id = 0) AS satisfied, count(*) FILTER (state_id = 1) AS violated, count(*) FILTER (state_id = 2) AS not_applicable, round(avg((state_id = 2)::INTEGER), 6) AS na_share, policy IN ('H1', 'H2') AND count(*) FILTER (state_id = 1) < 0.34::DOUBLE * count(*) AS thin, avg((state_id = 2)::INTEGER) > 0.33::DOUBLE AS mostly_na FROM label_cells WHERE state_id IS NOT NULL AND variant = 'D0' GROUP BY policy"),
    "parse_attempts": (lambda s, d: rounded(_attempts(s, d)), PRE + ", rec AS (SELECT doc_id, count(state_id) = 10 AS ok, 1 + (('0x' || substr(sha256(concat_ws(':', 'att', doc_id::VARCHAR)), 1, 2))::BIGINT < 8)::INTEGER AS attempts FROM label_cells WHERE variant = 'D0' GROUP BY doc_id) SELECT coalesce(attempts, 0)::INTEGER AS attempts, count(*) AS n, count(*) FILTER (ok) AS n_parsed, round(count(*) FILTER (ok) / count(*), 6) AS parse_rate, CASE WHEN attempts IS NULL THEN count(*) FILTER (ok) / count(*) >= 0.98 END AS passes FROM rec GROUP BY ROLLUP (attempts)"),
    "complete_rows": (lambda s, d: rounded(A.complete_rows(_LABELS(s, d), ["variant", "source"], "doc_id")), PRE + "SELECT variant, source, count(*) AS n_units, round(avg(ok), 6) AS complete_rate FROM (SELECT variant, source, doc_id, min((state_id IS NOT NULL)::INTEGER) AS ok FROM label_cells GROUP BY ALL) GROUP BY ALL"),
    "category_frequency": (_categories, _CATS),
    "policy_consistency": (_CELLS(lambda c: A.policy_consistency(A.pairs(c, "D0", "D5"), 0.7, 0.05)), PRE + _PAIRS + ", rec AS (SELECT doc_id, count(*) = 10 AND min((a IS NOT NULL AND b IS NOT NULL)::INTEGER) = 1 AS parsed, min(coalesce(a = b, false)::INTEGER) = 1 AS same FROM (SELECT l.doc_id, l.policy, l.state_id AS a, m.state_id AS b FROM label_cells l JOIN label_cells m ON l.doc_id = m.doc_id AND l.policy = m.policy AND l.variant = 'D0' AND m.variant = 'D5') GROUP BY doc_id), t AS (SELECT avg(parsed::INTEGER) AS pr, count(*) FILTER (parsed AND same) / count(*) FILTER (parsed) AS ra FROM rec) SELECT policy, count(*) AS n, round(avg((s1 = s2)::INTEGER), 6) AS agreement, CASE WHEN policy IS NULL THEN round(max(pr), 6) END AS parse_rate, CASE WHEN policy IS NULL THEN round(max(ra), 6) END AS record_agreement, CASE WHEN policy IS NULL THEN avg((s1 = s2)::INTEGER) >= 0.7 AND max(ra) >= 0.05 END AS passes FROM pr, t GROUP BY ROLLUP (policy)"),
    "na_transitions": (_CELLS(lambda c: A.na_transitions(A.pairs(c, "D0", "D5"))), PRE + _PAIRS + "SELECT policy, count(*) AS n, count(*) FILTER (s1 <> s2) AS n_changed, count(*) FILTER (s1 <> 2 AND s2 = 2) AS to_na, count(*) FILTER (s1 = 2 AND s2 <> 2) AS from_na FROM pr GROUP BY policy"),
    "extra_keys": (lambda s, d: A.extra_keys(_raw(s, d).select(P.parse_cells(F.col("reply"), POL[:7]).alias("p")).select("p.extra")), fixtures.SQL + f", r AS (SELECT doc_id, {_K} AS k FROM label_cells WHERE variant = 'D0' AND state_id IS NOT NULL GROUP BY ALL) SELECT x AS key, count(*) AS n FROM r, (SELECT unnest(['S3', 'T1', 'T2']) AS x) WHERE k NOT IN (3, 4) GROUP BY x"),
    "structure_agreement": (_structure, _CALLS + "SELECT structure, coalesce(position, -1)::INTEGER AS position, count(*) AS n, round(avg((state_id = ref)::INTEGER), 6) AS agreement, round(avg((state_id = 2)::INTEGER), 6) AS na_rate, round(avg((ref = 2)::INTEGER), 6) AS reference_na_rate FROM calls WHERE state_id IS NOT NULL GROUP BY ROLLUP (structure, position) HAVING structure IS NOT NULL"),
    "cell_coverage": (_coverage, _CALLS + "SELECT 'single' AS structure, count(*) AS n_due, count(*) AS n_once, 0::BIGINT AS n_missing, 0::BIGINT AS n_repeated FROM b UNION ALL SELECT 'joint', count(*), count(*) FILTER (h >= 8 AND h < 248), count(*) FILTER (h < 8), count(*) FILTER (h >= 248) FROM b"),
    "provenance_audit": (lambda s, d: A.provenance(_provenance_rows(s, d), "doc_id", "toxic", "categories"), _PROV + "SELECT count(*) AS n, (SELECT count(*) FROM (SELECT doc_id FROM p GROUP BY doc_id HAVING count(*) > 1)) AS n_repeated_ids, count(*) FILTER (toxic = 1 AND len(cats) = 0) AS n_unsafe_without, count(*) FILTER (toxic = 0 AND len(cats) > 0) AS n_safe_with FROM p"),
    "criterion_support": (lambda s, d: A.criterion_support(_provenance_rows(s, d), "toxic", "categories", {"even": ["c0", "c2"], "odd": ["c1", "c3"]}), _PROV + "SELECT c AS criterion, count(*) FILTER (toxic = 1 AND list_has_any(cats, CASE c WHEN 'even' THEN ['c0', 'c2'] ELSE ['c1', 'c3'] END)) AS n_positive, count(*) FILTER (toxic = 0) AS n_negative FROM p, (SELECT unnest(['even', 'odd']) AS c) GROUP BY c"),
    "pooled_score_range": (_CELLS(lambda c: A.pooled_range(c, "variant", "p1")), PRE + "SELECT 3::BIGINT AS n_interfaces, count(*) FILTER (NOT ok) AS n_bad, round(max(hi) - min(lo), 6) AS pooled_range, count(*) FILTER (NOT ok) = 0 AND max(hi) - min(lo) > 0.05 AS passes FROM (SELECT variant, min(p1) AS lo, max(p1) AS hi, min(p1) >= 0 AND max(p1) <= 1 AND count(DISTINCT p1) >= 2 AS ok FROM scored GROUP BY variant)"),
    "violated_ece": (_CELLS(lambda c: M.violated_ece(c, KEYS)), PRE + f", vb AS (SELECT variant, policy, {BIN.format('p1')} AS bin, count(*) AS n, avg(p1) AS mc, avg((state_id = 1)::INTEGER) AS acc FROM scored WHERE state_id IN (0, 1) GROUP BY ALL), ve AS (SELECT variant, policy, sum(n * abs(acc - mc)) / sum(n) AS v FROM vb GROUP BY ALL), cb AS (SELECT variant, policy, k, {BIN.format('score')} AS bin, count(*) AS n, avg(score) AS mc, avg(hit) AS acc FROM (SELECT variant, policy, k, [p0, p1, p2][k + 1] AS score, (state_id = k)::INTEGER AS hit FROM scored, (SELECT unnest([0, 1, 2]) AS k) WHERE state_id IS NOT NULL) GROUP BY ALL), me AS (SELECT variant, policy, avg(e) AS m FROM (SELECT variant, policy, k, sum(n * abs(acc - mc)) / sum(n) AS e FROM cb GROUP BY ALL) GROUP BY ALL) SELECT variant, policy, round(v, 6) AS violated_ece, round(m, 6) AS macro_ece FROM ve JOIN me USING (variant, policy)"),
    "class_overlap": (_CELLS(lambda c: M.class_overlap(c, ["policy"], "D0", "D5")), PRE + ", lg AS (SELECT policy, variant, unnest(['p0', 'p1', 'p2', 'conf']) AS score, unnest([p0, p1, p2, conf]) AS v FROM scored WHERE variant IN ('D0', 'D5')), h AS (SELECT policy, variant, score, least(floor(v * 50), 49) AS bin, count(*) AS n FROM lg GROUP BY ALL), sx AS (SELECT *, n / sum(n) OVER (PARTITION BY policy, score, variant) AS share FROM h) SELECT policy, score, round(sum(least(a, b)), 6) AS overlap FROM (SELECT policy, score, bin, coalesce(sum(share) FILTER (variant = 'D0'), 0) AS a, coalesce(sum(share) FILTER (variant = 'D5'), 0) AS b FROM sx GROUP BY ALL) GROUP BY ALL"),
    "standardized_delta": (_CELLS(lambda c: M.standardized_delta(c, "D0", "D5")), PRE + f", cn AS (SELECT variant, policy, state_id, count(*) AS n FROM scored WHERE state_id IS NOT NULL GROUP BY ALL), sh AS (SELECT variant, policy, state_id, n / sum(n) OVER (PARTITION BY variant, policy) AS share FROM cn), e AS (SELECT variant, policy, sum(n * abs(acc - mc)) / sum(n) AS ece FROM ({_BINNED}) GROUP BY ALL), fw AS ({_STD.format(bin=BIN.format('conf'), a='D5', b='D0')}), bw AS ({_STD.format(bin=BIN.format('conf'), a='D0', b='D5')}) SELECT a.policy, round(fw.ece - a.ece, 6) AS forward, round(b.ece - bw.ece, 6) AS backward FROM e a JOIN e b ON a.policy = b.policy AND a.variant = 'D0' AND b.variant = 'D5' JOIN fw ON fw.policy = a.policy JOIN bw ON bw.policy = a.policy"),
    "delta_report": (_CELLS(lambda c: M.delta_report(c, "D0")), _DELTAS + "SELECT variant, policy, round(d_ece, 6) AS delta_ece, round(d_f1, 6) AS delta_f1, round(d_fn, 6) AS delta_fn_rate, round(d_fp, 6) AS delta_fp_rate, powered, round(d_fn - d_fp, 6) AS fn_less_fp FROM dr"),
    "delta_report_summary": (_CELLS(lambda c: M.delta_report_summary(M.delta_report(c, "D0"))), _DELTAS + "SELECT variant, " + ", ".join(f"round(avg({c}), 6) AS mean_{n}, round(sqrt(avg({c} * {c})), 6) AS rms_{n}, round(stddev_pop({c}), 6) AS sd_{n}" for c, n in (("d_ece", "ece"), ("d_f1", "f1"), ("d_fn", "fn_rate"), ("d_fp", "fp_rate"))) + ", round(avg(d_fn - d_fp), 6) AS mean_fn_less_fp, count(*) FILTER (d_fn - d_fp > 0) AS n_positive FROM dr WHERE powered GROUP BY variant"),
    "divergence_violations": (_divergence_checks, "SELECT l_orderkey, CASE WHEN l_orderkey % 41 = 0 THEN 'no tokens' WHEN l_orderkey % 50 = 0 THEN 'no item' WHEN l_orderkey % 43 = 0 THEN 'not finite' ELSE 'differs' END AS reason FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE (l_orderkey % 41 = 0 OR l_orderkey % 50 = 0 OR l_orderkey % 43 = 0 OR l_orderkey % 37 = 0) AND NOT (l_orderkey % 41 = 0 AND l_orderkey % 50 = 0)"),
    "mismatch_effect": (_CELLS(_effect), PRE + ", w AS (SELECT policy, lang, sum(CASE WHEN pred <> state_id THEN 1.0::DOUBLE / (1 + doc_id % 4) ELSE 0 END) / sum(1.0::DOUBLE / (1 + doc_id % 4)) AS m FROM scored WHERE variant = 'D0' AND state_id IS NOT NULL GROUP BY ALL), x AS (SELECT a.policy, a.m AS low, b.m AS high, b.m - a.m AS difference FROM w a JOIN w b ON a.policy = b.policy AND a.lang = 'en' AND b.lang = 'de') SELECT policy, round(low, 6) AS low, round(high, 6) AS high, round(difference, 6) AS difference, round(difference - avg(difference) OVER (), 6) AS centred FROM x"),
    "weighted_kappa": (_CELLS(_weighted_kappa), PRE + f", ab AS (SELECT policy, 1.0::DOUBLE / (1 + doc_id % 4) AS w, CASE WHEN {_LIN.format('ann1')} < 32 THEN (state_id + 1) % 3 ELSE state_id END AS a, CASE WHEN {_LIN.format('ann2')} < 48 THEN (state_id + 2) % 3 ELSE state_id END AS b FROM scored WHERE variant = 'D0' AND state_id IS NOT NULL), t AS (SELECT policy, sum(w) AS t, sum(w) FILTER (a = b) / sum(w) AS po FROM ab GROUP BY policy), r AS (SELECT policy, a AS k, sum(w) AS r FROM ab GROUP BY ALL), c AS (SELECT policy, b AS k, sum(w) AS c FROM ab GROUP BY ALL), pe AS (SELECT policy, sum(r * c) AS rc FROM r JOIN c USING (policy, k) GROUP BY policy) SELECT policy, round(po, 6) AS agreement, round((po - rc / (t * t)) / (1 - rc / (t * t)), 6) AS kappa FROM t JOIN pe USING (policy)"),
    "stuart_maxwell": (_CELLS(lambda c: stats.stuart_maxwell(c.where("variant = 'D0'"))), PRE + ", y AS (SELECT doc_id, policy, state_id FROM label_cells WHERE variant = 'D0' AND state_id IS NOT NULL), t AS (SELECT a.policy AS a, b.policy AS b, count(*) AS n, sum((a.state_id = 0)::INT) - sum((b.state_id = 0)::INT) AS d0, sum((a.state_id = 1)::INT) - sum((b.state_id = 1)::INT) AS d1, sum(((a.state_id = 0) <> (b.state_id = 0))::INT) AS v00, sum(((a.state_id = 1) <> (b.state_id = 1))::INT) AS v11, -sum((a.state_id + b.state_id = 1)::INT) AS v01 FROM y a JOIN y b ON a.doc_id = b.doc_id AND a.policy < b.policy GROUP BY ALL), x AS (SELECT a, b, n, (d0 * d0 * v11 - 2 * d0 * d1 * v01 + d1 * d1 * v00) / (v00 * v11 - v01 * v01) AS s FROM t) SELECT a, b, n, round(s, 6) AS statistic, round(exp(-s / 2), 6) AS p FROM x"),
    "ols_sqrt_no_intercept": (lambda s, d: rounded(stats.ols(_points(s, d), "x", "y", "sqrt", False)), _SQRT),
    "rated_choice": (_rated, _RATED),
    "confirmatory_schedule": (_schedule, _SCHEDULE),
    "temperature_recovery": (_recovery, _SCALED),
}
