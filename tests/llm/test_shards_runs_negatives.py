"""Shards, periodic runs and hard negatives against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from auditlake.llm import hard_negatives, periodic_runs, sharding
from auditlake.llm.entry import queries

SCHEMA = "doc_id long, text string, source string, shard int, slot string, row int, part int, n_chars long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# sharding


def documents(spark, n=700):
    rnd = random.Random(3)
    sources = ["hot"] * 300 + [None] * 40 + ["alone"] + [f"s{k}" for k in range(9)] * 50
    rows = [(rnd.choice([k, k, None, 7, 2**63 - 1, -(2**63)]), rnd.choice([None, "", "same text", f"text {k}", "é" * 50]), sources[k % len(sources)], 9, "x", 1, 2, 3) for k in range(n)]
    return spark.createDataFrame(rows + [(5, "again", "hot", 9, "x", 1, 2, 3)] * 90, SCHEMA).repartition(5), rows + [(5, "again", "hot", 9, "x", 1, 2, 3)] * 90


def test_shards_hold_equal_rows_and_the_mixture(spark):
    docs, rows = documents(spark)
    got = sharding.assign(docs).collect()
    due = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(due)
    count = Counter(r["shard"] for r in got)
    assert set(count) == set(range(16)) and max(count.values()) - min(count.values()) <= 1
    for s, n in count.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    whole = sharding.apply(docs).collect()
    assert set(whole[0].asDict()) == set(docs.columns) and len(whole) == len(rows)
    total = Counter(r["source"] for r in whole)
    for (_, source), n in Counter((r["shard"], r["source"]) for r in whole).items():
        assert abs(n - total[source] / 16) <= 2
    # the same in other partitions, up to rows that are alike
    key = lambda r: tuple(map(str, (r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"])))
    assert sorted(map(key, got)) == sorted(map(key, sharding.assign(docs.repartition(2)).collect()))


def test_shards_of_small_and_empty_tables(spark, tmp_path):
    docs, _ = documents(spark, 3)
    few = docs.limit(3)
    got = sharding.assign(few).collect()
    assert len(got) == 3 and len({r["shard"] for r in got}) == 3 and {r["slot"] for r in got} == {0}
    assert sharding.assign(docs.limit(0)).count() == 0 and sharding.apply(docs.limit(0)).columns[-2:] == ["shard", "slot"]
    sharding.write(docs, f"file://{tmp_path}/shards", 4)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.count() == docs.count() and back.groupBy("shard").count().count() == 4


# runs


def brute_lyndon(codes):
    n = len(codes)
    return [next(j for j in range(1, n + 1) if i + j == n or codes[i + j :] < codes[i:]) for i in range(n)]


def brute_runs(w, least=6, exponent=4):
    """Every stretch whose words q apart agree, if no shorter period serves it."""
    n, out = len(w), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            begin = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - begin + q
            if i > begin and size >= max(least, exponent * q):
                own = w[begin : begin + size]
                if not any(own[p:] == own[:-p] for p in range(1, q)):
                    out.add((begin, size, q))
            i = max(i, begin + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def random_words(rnd, most=120):
    k, out = rnd.choice([1, 2, 3, 9, 30]), []
    while len(out) < rnd.randint(0, most):
        if rnd.random() < 0.4:
            root = [f"w{rnd.randint(1, k)}" for _ in range(rnd.randint(1, 7))]
            out += (root * 20)[: rnd.randint(1, 45)]
        else:
            out.append(f"w{rnd.randint(1, k)}")
    return out


def test_grouping_gives_lyndon_lengths_under_both_orders():
    rnd = random.Random(1)
    for _ in range(400):
        parts = [[rnd.randint(1, rnd.choice([1, 2, 3, 6])) for _ in range(rnd.randint(0, 25))] for _ in range(rnd.randint(1, 3))]
        for turned in (lambda c: c, lambda c: 7 - c):
            own = [[turned(c) for c in p] for p in parts]
            codes = [c for p in own for c in [*p, 0]]
            assert periodic_runs.lyndon_lengths(codes) == [x for p in own for x in [*brute_lyndon(p), 0]]


def texts():
    rnd = random.Random(2)
    made = [" ".join(random_words(rnd)) for _ in range(60)]
    spaced = [" \n" + "\t\n ".join(random_words(rnd)) + "\x0b" for _ in range(20)]
    return [None, "", " \n ", "one", "a " * 6, "a " * 5, "ä é " * 30 + "end", "x y " * 4000, "字 " * 3 + "a b c " * 9, *made, *spaced, made[0], made[0]]


def digest_of(w):
    runs = brute_runs(w)
    gone = {i for b, n, q in runs for i in range(b + q, b + n)}
    s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
    told = "".join(f"{b},{n_},{q_}\n" for b, n_, q_ in runs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return len(runs), s, n, q, None if n is None else 1000 * n // q, sha(told), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_runs_digests_and_collapse(spark):
    rows = [(None if i == 3 else i, t, "s", 1, "q", 1, 2, 3) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["doc_id"]: r for r in periodic_runs.digests(docs).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r = got[i]
        assert (r["n_words"], *(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))) == (len(words(t)), *digest_of(words(t)))
    for least, exponent in ((6, 4), (2, 2), (9, 3)):
        found = sorted((r["doc_id"], r["start"], r["length"], r["period"]) for r in periodic_runs.runs(docs.where("n_chars = 3 AND doc_id <> 7"), least, exponent).collect())
        assert found == sorted((i, *x) for i, t, *_ in rows if i not in (None, 7) for x in brute_runs(words(t), least, exponent))
    less = periodic_runs.collapse(docs)
    assert less.columns == docs.columns
    for r in less.collect():
        own = next(t for i, t, *_ in rows if i == r["doc_id"])
        runs = brute_runs(words(own))
        gone = {i for b, n, q in runs for i in range(b + q, b + n)}
        assert (r["text"] is None) == (own is None) and words(r["text"]) == [x for i, x in enumerate(words(own)) if i not in gone]
        assert runs or r["text"] == own
    assert periodic_runs.digests(docs.limit(0)).count() == periodic_runs.collapse(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.runs(docs, 6, 1)


def test_hashes_that_meet_do_not_make_runs():
    codes = np.array([1, 2] * 6 + [3, 1, 2, 0], np.int64)
    assert periodic_runs._search(codes, 6, 4) == [(0, 12, 2)]
    assert periodic_runs._direct(codes, 4, 2) == (0, 12)
    one, two = np.array([5, 5, 6], np.uint64), np.array([1, 2, 2], np.uint64)
    assert len(set(periodic_runs._codes(one, two).tolist())) == 3


def tailed(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_runs_query(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, "", "one two", *[" ".join(f"v{rnd.randint(1, 40)}" for _ in range(rnd.randint(1, 300)))] * 7])) for i in range(1200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries()["op12_periodic_runs"](spark, f"file://{tmp_path}").collect()}
    assert len(got) == len(rows) and sum(r["n_runs"] for r in got.values()) > 20
    for i, t in rows:
        assert tuple(got[i][c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) == digest_of(tailed(i, t))


# hard negatives

VECTORS = "vec_id long, label int, embedding array<double>, block int, anchor string, part int"


def brute_negatives(rows, scale=1.0, low=30, high=90):
    usable = [(i, y, [int(np.floor(scale * x)) for x in v]) for i, y, v in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, (i, y, v) in enumerate(usable):
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, z) for m, (j, z, w) in enumerate(usable) if m != k and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2] == y)[:5]:
            window = sorted(x for x in scored if x[2] != y and low * -s <= 100 * -x[0] <= high * -s)[:10]
            out += [(i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows, scale=1.0, **options):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(*r, 1, "a", 2) for r in rows], VECTORS).repartition(3)
    found = hard_negatives.mine(table, F.col("vec_id") % 100 == 0, scale, **options)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in found.collect())


def vectors(n, dim, centres=12, seed=5):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, dim)) * 4
    return [(k, int(rng.integers(0, 4)), (middle[rng.integers(centres)] + rng.standard_normal(dim)).tolist()) for k in range(n)]


def test_negatives_equal_brute_force(spark, monkeypatch):
    rows = vectors(900, 6)
    rows += [(1000, 1, None), (1001, None, [1.0] * 6), (None, 1, [1.0] * 6), (1100, 1, []), (1003, 1, [float("nan")] * 6), (1004, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1200, 1, [0.0] * 6), (1005, 2, [float("inf")] + [0.0] * 5)]
    rows += [(300, rows[300][1], rows[300][2])] * 3 + [(5000 + k, k % 3, rows[100][2]) for k in range(30)]  # repeats and ties
    rows += [(1300 + k, k % 2, [float(k), -1.0, 2.0]) for k in range(0, 60)]  # another length
    want = brute_negatives(rows)
    assert len(want) > 300
    monkeypatch.setattr(hard_negatives, "PART", 100)
    monkeypatch.setattr(hard_negatives, "BLOCK", 3)
    assert mined(spark, rows) == want


def test_negatives_of_large_numbers_ties_and_few_rows(spark):
    rows = [(k, k % 2, [float(3 + k % 3), float(k // 50)]) for k in range(300)]
    assert mined(spark, rows, 2.0**26) == brute_negatives(rows, 2.0**26)
    assert mined(spark, rows[:2]) == [] and mined(spark, []) == []
    only = [(100, 1, [10.0]), (1, 1, [10.0]), (2, 2, [5.0]), (3, 2, [3.0]), (4, 2, [9.5]), (5, 3, [9.0]), (6, 3, [2.9])]
    assert mined(spark, only) == [(100, 1, 1, 4, 100, 90), (100, 1, 2, 5, 100, 90), (100, 1, 3, 2, 100, 50), (100, 1, 4, 3, 100, 30)]  # 9.5 is 9
    with pytest.raises(Exception, match="bits"):
        mined(spark, [(0, 1, [2.0**40]), (1, 1, [1.0])])


def test_bounds_hold_and_set_rows_aside(tmp_path):
    """Every score lies within its window's bounds, and most rows of far clusters are not scored."""
    import pandas as pd

    rng = np.random.default_rng(1)
    middle = np.repeat(rng.standard_normal((16, 32)) * 60, 64, axis=0)
    x = np.floor(middle + rng.standard_normal((1024, 32)) * 6).astype(np.int32)
    directions = hard_negatives.spread(x.astype(float))
    norms, angles = hard_negatives._angles(x, directions)
    order = np.lexsort((angles.min(1), angles.argmin(1)))
    rows = pd.DataFrame({"vec_id": order, "label": "1", "anchor": order % 100 == 0, "cluster": angles.argmin(1)[order], "raw": [v.tobytes() for v in x[order]]})
    folder = f"file://{tmp_path}"
    assert hard_negatives._store_part(folder, 0, rows, directions) == 11
    part = hard_negatives._Part(folder, 0)
    windows = np.arange(len(part.labels))
    lower, upper = hard_negatives._limits(part.norms, part.angles, part, windows)
    scores = part.vectors.astype(np.int64) @ part.vectors.astype(np.int64).T
    scored = 0
    for w in windows:
        own = scores[:, part.begins[w] : part.begins[w + 1]]
        assert (own >= lower[:, w, None]).all() and (own <= upper[:, w, None]).all()
    for row in part.anchors.tolist():
        best = hard_negatives._Best(5)
        scored += hard_negatives._positives(part, part, row, windows, upper[row], best)
        own = np.delete(scores[row], row)
        assert sorted(own)[::-1][:5] == best.scores.tolist()
    assert scored < 0.7 * len(part.anchors) * len(x)
