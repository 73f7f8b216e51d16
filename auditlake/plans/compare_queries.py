"""Comparisons of variants, allocations and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from ..functions.text import digest, latin_order
from ..operators import compare as C
from ..operators import integrity as I
from ..operators import metrics as M
from .metric_queries import _ECE, BIN, PRE, cells, rounded

KEYS = ["variant", "policy"]
_DELTA = f"(SELECT a.variant, a.policy, a.ece - b.ece AS x FROM ({_ECE}) a JOIN ({_ECE}) b ON a.policy = b.policy AND b.variant = 'D0' AND a.variant <> 'D0')"


def _spearman(s, d):
    deltas = M.paired_delta(M.ece(cells(s, d), KEYS), "ece", "D0").withColumn("delta", F.round("delta", 9))
    wide = deltas.groupBy("policy").pivot("variant", ["D5", "D5b"]).agg(F.first("delta"))
    return rounded(C.spearman(wide, "D5", "D5b"))


def _scaled(c, t):
    from ..functions.text import softmax

    p = softmax([F.col(f"z{k}") for k in range(3)], t)
    return c.withColumns({f"p{k}": v for k, v in enumerate(p)}).withColumn("conf", F.greatest("p0", "p1", "p2"))


def _recovery(s, d):
    c = cells(s, d)
    return rounded(C.recovery(M.ece(c, KEYS), M.ece(_scaled(c, 2.0), KEYS), "ece", "D0"))


_SCALED = PRE + ", q AS (SELECT variant, policy, correct, exp((z0 - greatest(z0, z1, z2)) / 2.0) AS a, exp((z1 - greatest(z0, z1, z2)) / 2.0) AS b, exp((z2 - greatest(z0, z1, z2)) / 2.0) AS c FROM scored WHERE correct IS NOT NULL), w AS (SELECT variant, policy, correct, greatest(a / (a + b + c), b / (a + b + c), c / (a + b + c)) AS conf FROM q), sb AS (SELECT variant, policy, " + BIN.format("conf") + " AS bin, count(*) AS n, avg(conf) AS mc, avg(correct) AS acc FROM w GROUP BY ALL), se AS (SELECT variant, policy, sum(n * abs(acc - mc)) / sum(n) AS ece FROM sb GROUP BY ALL), re AS (" + _ECE + ") SELECT a.variant, a.policy, round(abs(a.ece - b.ece) - abs(x.ece - y.ece), 6) AS recovery, round(a.ece - x.ece, 6) AS gain FROM re a JOIN re b ON a.policy = b.policy AND b.variant = 'D0' AND a.variant <> 'D0' JOIN se x ON x.variant = a.variant AND x.policy = a.policy JOIN se y ON y.policy = a.policy AND y.variant = 'D0'"


def _within(s, d):
    points = cells(s, d).where("state_id IS NOT NULL").groupBy(*KEYS).agg(F.avg("conf").alias("x"), F.avg("correct").alias("y"))
    return rounded(C.within_slope(points, "policy", "x", "y"))


def _mismatch(s, d):
    c = cells(s, d).where("variant = 'D0' AND state_id IS NOT NULL")
    return rounded(C.weighted_mismatch(c, ["lang", "policy"], F.col("pred") != F.col("state_id"), 1.0 / (1 + F.col("doc_id") % 4)))


def _positions(s, d):
    c = fixtures.label_cells(fixtures.table(s, d, "documents")).where("variant = 'D0'")
    c = c.withColumn("position", F.array_position(latin_order(list(fixtures.POLICIES), F.col("doc_id")), F.col("policy")) - 1)
    return C.missing_by_position(c, "position", "policy", F.col("state_id").isNull()).withColumn("position", F.coalesce("position", F.lit(-1)))


def _allocate(s, d):
    docs = fixtures.table(s, d, "documents")
    strata = [("de", F.col("lang") == "de", 20), ("src0", F.col("source") == "src0", 10), ("long", F.col("n_chars") > 2000, 30), ("rest", F.lit(True), 40)]
    return C.allocate(docs, strata, "doc_id", digest("alloc", F.col("doc_id")))


_AL = "sha256(concat_ws(':', 'alloc', doc_id::VARCHAR))"
_ALLOC = f"WITH d AS (SELECT doc_id, lang, source, n_chars, {_AL} AS o FROM documents), a AS (SELECT doc_id, o FROM d WHERE lang = 'de' ORDER BY o LIMIT 20), b AS (SELECT doc_id, o FROM d WHERE source = 'src0' AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY o LIMIT 10), c AS (SELECT doc_id, o FROM d WHERE n_chars > 2000 AND doc_id NOT IN (SELECT doc_id FROM a UNION SELECT doc_id FROM b) ORDER BY o LIMIT 30), e AS (SELECT doc_id, o FROM d WHERE doc_id NOT IN (SELECT doc_id FROM a UNION SELECT doc_id FROM b UNION SELECT doc_id FROM c) ORDER BY o LIMIT 40), u AS (SELECT *, 'de' AS stratum FROM a UNION ALL SELECT *, 'src0' FROM b UNION ALL SELECT *, 'long' FROM c UNION ALL SELECT *, 'rest' FROM e) SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY o)::INTEGER AS place FROM u"


def _verdict(s, d):
    g = M.delta_summary(M.paired_delta(M.ece(cells(s, d), KEYS), "ece", "D0"))
    ladder = [("worse", (F.col("mean_delta") > 0.01) & (F.col("n_positive") >= 8)), ("better", (F.col("mean_delta") < -0.01) & (F.col("n_positive") <= 2)), ("mixed", F.col("sd_delta") > 0.02)]
    return C.verdict(g, ladder, "unchanged").select("variant", "verdict")


def _preference(s, d):
    t = fixtures.table(s, d, "conversations")
    user = t.where("role = 'user'").select("conv_id", "turn", F.sha2("text", 256).alias("prompt"))
    reply = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.sha2("text", 256).alias("response"))
    return user.join(reply, ["conv_id", "turn"], "left").select("conv_id", "turn", "prompt", F.coalesce("response", F.lit("generic")).alias("response"))


def _manifest(s, d):
    docs = fixtures.table(s, d, "documents").select("doc_id", "source")
    manifest = fixtures.table(s, d, "labels").select("doc_id", (F.col("doc_id") * 2).alias("position"))
    return I.subset(docs, manifest, "doc_id").select("doc_id", "position", "source")


QUERIES = {
    "spearman_across_seeds": (_spearman, PRE + f", dl AS (SELECT variant, policy, round(x, 9) AS x FROM {_DELTA}), rk AS (SELECT variant, policy, rank() OVER (PARTITION BY variant ORDER BY x) + (count(*) OVER (PARTITION BY variant, x) - 1) / 2.0::DOUBLE AS r FROM dl) SELECT round(corr(a.r, b.r), 6) AS spearman FROM rk a JOIN rk b ON a.policy = b.policy AND a.variant = 'D5' AND b.variant = 'D5b'"),
    "fixed_effect_slope": (_within, PRE + ", pt AS (SELECT variant, policy, avg(conf) AS x, avg(correct) AS y FROM scored WHERE state_id IS NOT NULL GROUP BY ALL), c AS (SELECT x - avg(x) OVER (PARTITION BY policy) AS dx, y - avg(y) OVER (PARTITION BY policy) AS dy FROM pt), h AS (SELECT p.policy, p.x - avg(q.x) AS ex, p.y - avg(q.y) AS ey, p.variant FROM pt p JOIN pt q ON p.policy = q.policy AND p.variant <> q.variant GROUP BY p.policy, p.variant, p.x, p.y), o AS (SELECT h.ex, h.ey, sum(cx * cy) / sum(cx * cx) AS b FROM h JOIN (SELECT hv.policy AS hp, hv.variant AS hvar, q.x - avg(q.x) OVER w AS cx, q.y - avg(q.y) OVER w AS cy FROM pt hv JOIN pt q ON (hv.policy, hv.variant) <> (q.policy, q.variant) WINDOW w AS (PARTITION BY hv.policy, hv.variant, q.policy)) z ON z.hp = h.policy AND z.hvar = h.variant GROUP BY h.policy, h.variant, h.ex, h.ey), r AS (SELECT 1 - sum((ey - b * ex)**2) / sum(ey * ey) AS ho FROM o) SELECT round(sum(dx * dy) / sum(dx * dx), 6) AS slope, round(sum(dx * dy)**2 / (sum(dx * dx) * sum(dy * dy)), 6) AS within_r2, round(max(ho), 6) AS held_out_r2 FROM c, r"),
    "weighted_mismatch": (_mismatch, PRE + "SELECT lang, policy, round(sum(CASE WHEN pred <> state_id THEN 1.0::DOUBLE / (1 + doc_id % 4) ELSE 0 END) / sum(1.0::DOUBLE / (1 + doc_id % 4)), 6) AS mismatch, count(*) AS n FROM scored WHERE variant = 'D0' AND state_id IS NOT NULL GROUP BY CUBE (lang, policy)"),
    "missing_by_position": (_positions, PRE + "SELECT coalesce(x.position, -1) AS position, x.policy, sum((state_id IS NULL)::INTEGER)::BIGINT AS n_missing, count(*) AS n FROM (SELECT l.policy, state_id, (ord - doc_id % 10 + 10) % 10 AS position FROM label_cells l JOIN policies p ON l.policy = p.policy WHERE variant = 'D0') x GROUP BY CUBE (x.position, x.policy)"),
    "ordered_allocation": (_allocate, _ALLOC),
    "verdict_ladder": (_verdict, PRE + f"SELECT variant, CASE WHEN avg(x) > 0.01 AND count(*) FILTER (x > 0) >= 8 THEN 'worse' WHEN avg(x) < -0.01 AND count(*) FILTER (x > 0) <= 2 THEN 'better' WHEN stddev_pop(x) > 0.02 THEN 'mixed' ELSE 'unchanged' END AS verdict FROM {_DELTA} GROUP BY variant"),
    "preference_pairs": (_preference, "SELECT u.conv_id, u.turn, sha256(u.text) AS prompt, coalesce(sha256(a.text), 'generic') AS response FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'"),
    "manifest_subset": (_manifest, "SELECT l.doc_id, l.doc_id * 2 AS position, d.source FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id"),
}
