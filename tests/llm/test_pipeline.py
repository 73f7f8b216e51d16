"""The pipeline and its stages against brute force, on rows with nulls, empty and very long texts, repeats and clashing names."""

import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from auditlake.llm import order_minhash

RNG = np.random.default_rng(11)
SYLLABLES = ["ra", "lo", "mi", "su", "ten", "van", "dor", "pel", "kin", "zu"]
NAMES = "doc_id long, text string, lang string, source string, n_chars long, row string, number long, id long, less string, n_words long, text_ string, spans string, gram long, toxic int"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def word():
    return "".join(RNG.choice(SYLLABLES, 3))


def text(n):
    return " ".join(word() for _ in range(n))


def edited(t, n):
    own = words(t)
    for k in RNG.choice(len(own), n, replace=False):
        own[k] = word()
    return " ".join(own)


def corpus():
    base, passage = text(150), text(60)
    rows = [(i, text(40)) for i in range(60)]
    rows += [(100 + i, edited(base, 1 + i % 5)) for i in range(40)]
    rows += [(200 + i, f"{text(30)} {passage} {text(30)}") for i in range(6)]
    rows += [(300, None), (301, ""), (302, " \n "), (303, "short one"), (304, text(20_000)), (305, "spam " * 300)]
    rows += [(310, base), (310, base), (310, text(50)), (311, base), (None, text(45)), (None, text(45)), (None, None)]
    rows += [(400 + i, " ".join([*words(text(30)), "zzgrumpig", "zzgrumpig"])) for i in range(40)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", 7, i, "l", 1, "t", "s", 2, 0) for i, t in rows], NAMES).repartition(4)


def quality_fails(t):
    w = words(t)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    repeats = len({k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(5)})
    lines = [x for x in (t or "").split("\n") if words(x)]
    chars = sum(map(len, w))
    return (
        len(w) < 10 or 100 * repeats > 20 * len(w) or 10 * sum(c in "#*$%&|<>" for c in t or "") > len(w)
        or 2 * (len(lines) - len(set(lines))) > len(lines) or 10 * sum("A" <= c <= "Z" for c in t or "") > 3 * chars or not 2 * len(w) <= chars <= 20 * len(w)
    )


def kmers(t):
    w = words((t or "").lower())
    found = [tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else [])
    seen, out = {}, []
    for g in found:
        out.append((g, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + 1
    return out


def chain(a, b):
    """Longest common subsequence of two lists of distinct things."""
    at = {g: k for k, g in enumerate(b)}
    tails = []
    for x in (at[g] for g in a if g in at):
        k = int(np.searchsorted(tails, x))
        tails[k : k + 1] = [x]
    return len(tails)


def near_classes(texts):
    """The first index of each text's class, by alignment of all pairs."""
    lists = [kmers(t) for t in texts]
    sets = [set(x) for x in lists]
    part = list(range(len(texts)))

    def find(k):
        while part[k] != k:
            k = part[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if not same and lists[i] and lists[j] and len(sets[i] & sets[j]) * 9 >= 4 * (len(lists[i]) + len(lists[j])):
                m = chain(lists[i], lists[j])
                same = 5 * m >= 4 * (len(lists[i]) + len(lists[j]) - m)
            if same:
                a, b = find(i), find(j)
                part[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(texts))]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_near_copies_of_a_large_group_against_all_pairs(spark):
    base = text(120)
    rows = [(i, edited(base, 1 + i % 8)) for i in range(70)] + [(100 + i, text(60)) for i in range(20)]
    rows += [(200 + i, edited(text(80), 0)) for i in range(5)] + [(300 + i, f"{base} {text(i)}") for i in range(1, 50, 6)]
    found = {r["doc_id"]: r["class_id"] for r in order_minhash.classes(table(spark, rows)).collect()}
    classes = near_classes([t for _, t in rows])
    assert found == {i: rows[c][0] for (i, _), c in zip(rows, classes)} and max(map(classes.count, classes)) > 16


def test_stages(spark, tmp_path):
    rows = corpus()
    docs = table(spark, rows)
    labels = [(i, int(i >= 400)) for i, _ in rows if i is not None and i not in (300, 310)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality_rules", "minhash_dedup", "substring_dedup", "packing"]
    pairs = lambda df: ordered((r["doc_id"], r["text"]) for r in df.collect())

    out = stages["toxicity"](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert pairs(out) == ordered(r for r in rows if not (r[1] or "").endswith("zzgrumpig"))

    out = stages["quality_rules"](spark, docs, str(tmp_path))
    assert out.columns == docs.columns and pairs(out) == ordered(r for r in rows if not quality_fails(r[1]))

    order = ordered(rows)
    classes = near_classes([t for _, t in order])
    out = stages["minhash_dedup"](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    blank = lambda found: [(i, t or "") for i, t in found]  # noqa: E731  a null and an empty text are one class
    assert blank(pairs(out)) == blank(r for k, r in enumerate(order) if classes[k] == k)

    windows, expected = {}, []
    for i, t in order:
        for k in range(len(words(t)) - 49):
            windows.setdefault(tuple(words(t)[k : k + 50]), i)  # the smallest doc_id; rows without one come last
    for i, t in order:
        w, gone = words(t), set()
        for k in range(len(w) - 49):
            if windows[tuple(w[k : k + 50])] != i:
                gone.update(range(k, k + 50))
        expected.append((i, [x for k, x in enumerate(w) if k not in gone]))
    out = stages["substring_dedup"](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    sort = lambda found: sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert sort((r["doc_id"], words(r["text"])) for r in out.collect()) == sort(expected)
    assert all(r["n_chars"] == len(r["text"] or "") for r in out.collect())

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = stages["packing"](spark, docs, str(tmp_path)).collect()
    lengths = sorted(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sorted(r["doc_tokens"] for r in out if r["start"] == 0) == lengths and sum(r["length"] for r in out) == sum(lengths)


def test_run_and_empty_table(spark, tmp_path):
    rows = corpus()
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 400)) for i, _ in rows if i is not None and i not in (300, 310)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in out}
    assert not any(i is not None and i >= 400 for i in kept) and set(range(60)) <= kept and 304 in kept and not kept & {300, 301, 302, 303, 305, 311}
    assert kept & set(range(100, 140, 5)) == {100} and 310 in kept  # of the copies with one edit the first stays, of 310 its other text
    empty = str(tmp_path / "empty")
    table(spark, rows).where("false").write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_stages_send_texts_in_small_batches(spark, tmp_path):
    """40 MB of texts in one partition reach Python in batches of a few MB once a stage was built, and all of them come."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(bound)
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id"), F.lit(" word ")), 10_000).alias("text"))

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    try:
        corpus_pipeline.drop_repeated_passages(spark, docs.limit(0), str(tmp_path))
        sent = docs.mapInArrow(size, "n long, size long").collect()
        assert sum(r["n"] for r in sent) == 400 and max(r["size"] for r in sent) < 6 << 20
        spark.conf.set(bound, "100000")  # a smaller bound of the session stays
        corpus_pipeline.drop_repeated_passages(spark, docs.limit(0), str(tmp_path))
        assert spark.conf.get(bound) == "100000"
    finally:
        spark.conf.unset(bound)
