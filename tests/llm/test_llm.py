"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from auditlake.llm import byte_bpe, embedding_dedup, lm_scoring, order_minhash, packing, quality_rules, substring_dedup, token_output, toxicity, url_filter
from auditlake.llm._text import HashTable, chunk_spans, slices

RNG = np.random.default_rng(5)
WORDS = ["alpha", "beta,", "gämma", "délta.", "EPS", "ζ", "x1", "don't", "###", "a b", "naïve", "…", "42", "foo\tbar"]
SCHEMA = "doc_id long, text string, ids long, part int, keys string, n_chars long"


def prose(n):
    return " ".join(WORDS[k] for k in RNG.integers(0, len(WORDS), n))


BASE = prose(400)
TEXTS = [None, "", " \n ", "one", "one two", prose(30), prose(30), BASE, BASE, BASE + " tail", "lead " + BASE, prose(3000), "a" * 5000, "  double  spaces \n\n x ", prose(60) + "\n" + prose(60), "the end.\nThe, start. \n next", "edededed anananan ededed", prose(12) * 3, "hello <|endoftext|> there<|startoftext|>x  <|endoftext|>\n\n<|ENDOFTEXT|>", "字" * 300 + " " + "b" * 200]


def table(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, i, 1, "k", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_hash_table():
    keys = np.unique(RNG.integers(1, 2**63, 100_000).astype(np.uint64))
    table_ = HashTable()
    table_.add(keys[::2], np.arange(len(keys[::2]), dtype=np.int32))
    assert (table_.find(keys[::2]) == np.arange(len(keys[::2]))).all() and (table_.find(keys[1::2]) == -1).all()


def test_packed_arrays():
    from auditlake.llm._store import pack, unpack

    long = RNG.integers(0, 2**63, 5000).astype(np.uint64)
    for x in (long, np.sort(long), np.sort(long >> np.uint64(40)), np.repeat(np.sort(long), 2), long[:1], long[:0], np.array([2**64 - 1, 2**64 - 1], np.uint64)):
        assert (unpack(pack(x)) == x).all()


def test_chunks_cover_the_text():
    import pyarrow as pa

    for _, _, buf, off in slices(pa.array(TEXTS)):
        starts, ends, first = chunk_spans(buf, off)
        assert b"".join(buf[a:b].tobytes() for a, b in zip(starts, ends)) == buf.tobytes() and first[-1] == len(starts)


def test_quality_rules(spark):
    found = by_id(quality_rules.ledger(table(spark)))
    assert len(found) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        w = words(t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
    kept = quality_rules.keep(table(spark))
    assert kept.columns == table(spark).columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if not r["fail_bits"]}
    rows = quality_rules.ablations(quality_rules.ledger(table(spark)), [quality_rules.BASE, quality_rules.STANDARD]).collect()
    bits = [r["fail_bits"] for r in found.values()]
    assert len(rows) == 8
    for r in rows:
        policy = quality_rules.mask({"base": quality_rules.BASE, "2": quality_rules.STANDARD}[r["policy"]])
        bit = quality_rules.BIT[r["rule"]]
        assert (r["n_failed"], r["n_failed_only_this"]) == (sum(b & bit > 0 for b in bits), sum(b & policy == bit for b in bits))
        assert (r["n_kept_without"], r["n_kept"]) == (sum(b & policy & ~bit == 0 for b in bits), sum(b & policy == 0 for b in bits))


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_output_round_trip(spark, file):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path(file))
    path = token_output.write_documents(table(spark), P.path(file))
    start = 0
    rows = by_id(token_output.digests(token_output.read(spark, path)))
    for i, t in enumerate(TEXTS):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_words_that_differ_in_case_blank_or_mark_are_one_chunk():
    """As far as the library reads them alike; its ids come out for any text."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from auditlake.llm import _tokens

    def ids_of(memory, texts):
        for _, _, buf, off in slices(pa.array(texts)):
            ids, n = memory.encode(buf, off)
            yield from (x.tolist() for x in np.split(ids, np.cumsum(n)[:-1]))

    def memory_of(file):
        encode_new, _, lowers = _tokens._library_encoder(P.path(file))
        return _tokens.ChunkMemory(encode_new, np.uint32, lowers)

    alike = memory_of("word_bpe_49k.json")
    list(ids_of(alike, ["Élan élan\nÉLAN élan### ÉLAN, Élan!! élan"]))
    assert alike.n == 4  # the word and three marks
    rnd = random.Random(5)
    pieces = [*"aZéÉßÞ×÷ÿJjTtHWy 1'|<>$.,!-_~{}\n\t\u00a0\u030c\u0308\u0331\u0338ΣσİıÅK", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'s", "'LL", "  ", "it's", "ﬁ"]
    known = {}
    fixed = ["J\u030c", "T\u0308o", "<|EndOfText|>", "a<|endoftext|>b", "a×$", "É÷$", " ", "\n", "a\n", "a$", "$a", "", "=\u0338", "a=\u0338", "ΑΣ$ aΣ$"]
    for texts in [*[[t] for t in fixed], *[["".join(rnd.choices(pieces, k=rnd.randint(0, 14))) for _ in range(rnd.randint(1, 4))] for _ in range(3000)]]:
        for file in ("word_bpe_49k.json", "byte_bpe_50k.json"):
            library, memory = known.get(file) or known.setdefault(file, (Tokenizer.from_file(P.path(file)), memory_of(file)))
            assert list(ids_of(memory, texts)) == [library.encode(t, add_special_tokens=False).ids for t in texts], (file, texts)


def test_huffman_limit():
    counts = 2 ** np.arange(40)
    bits = token_output.code_lengths(counts)
    assert bits.max() <= token_output.LIMIT and (2.0**-bits).sum() == 1


class Trigrams:
    """Interpolated modified Kneser-Ney by dictionaries."""

    def __init__(self, texts):
        self.c1, self.c2, self.c3 = {}, {}, {}
        lists = [["<b>", *self.tokens(t)] for t in texts]
        for t in lists:
            for n, counts in ((1, self.c1), (2, self.c2), (3, self.c3)):
                for k in range(len(t) - n + 1):
                    g = tuple(t[k : k + n])
                    counts[g] = counts.get(g, 0) + 1
        self.c1.pop(("<b>",), None)
        self.n = sum(self.c1.values())
        self.cont2 = {g: self.c2[g] if g[0] == "<b>" else sum(h[1:] == g for h in self.c3) for g in self.c2}
        self.cont1 = {g: sum(h[1:] == g for h in self.c2) for g in self.c1}
        self.d = [lm_scoring._discounts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]) for c in (self.cont1, self.cont2, self.c3)]

    @staticmethod
    def tokens(t):
        return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words(t)] + ["<e>"]

    def level(self, counts, d, g, lower):
        own = {h: c for h, c in counts.items() if h[:-1] == g[:-1]}
        if not own:
            return lower
        cut = lambda c: d[min(c, 3) - 1] if c else 0
        return (counts.get(g, 0) - cut(counts.get(g, 0)) + sum(map(cut, own.values())) * lower) / sum(own.values())

    def p(self, u, v, w):
        p1 = self.level(self.cont1, self.d[0], (w,), 1 / (len(self.c1) + 1))
        p2 = self.level(self.cont2, self.d[1], (v, w), p1)
        return p2 if u is None else self.level(self.c3, self.d[2], (u, v, w), p2)

    def score(self, t):
        import math

        s = [None, "<b>", *self.tokens(t)]
        base = sum(math.log10((self.c1.get((w,), 0) + 1) / (self.n + len(self.c1) + 1)) for w in s[2:])
        return base, sum(math.log10(self.p(*s[k - 2 : k + 1])) for k in range(2, len(s)))


def test_lm_scoring(spark):
    train_ = [prose(n) for n in (1, 5, 30, 30, 60)] + ["alpha beta, gämma"] * 3 + [None, "", "Solo"]
    fresh = [*TEXTS[:7], prose(40), "alpha beta, gämma never seen x1", "beta, gämma"]
    model, brute = lm_scoring.train(table(spark, train_)), Trigrams(train_)
    rows = by_id(lm_scoring.score(table(spark, fresh), model))
    assert model.tokens == brute.n and model.types == len(brute.c1)
    for i, t in enumerate(fresh):
        base, score = brute.score(t)
        assert (rows[i]["base_score"], rows[i]["score"]) == pytest.approx((base, score), rel=1e-9), t
        assert rows[i]["n_tokens"] == len(brute.tokens(t)) and rows[i]["n_known"] == sum((w,) in brute.c1 for w in brute.tokens(t))
    whole = sum(brute.p("<b>", "alpha", w) for (w,) in brute.c1) + brute.p("<b>", "alpha", "never-seen")
    assert whole == pytest.approx(1)


def test_lm_files_do_not_grow_with_parts(spark, monkeypatch):
    from collections import Counter
    from pathlib import Path
    from urllib.parse import urlparse

    monkeypatch.setattr(lm_scoring, "PART_BYTES", 40)
    train_ = [prose(n) for n in (1, 5, 30, 30, 60)] + ["alpha beta, gämma"] * 3 + [None, "", "Solo"]
    fresh = [*TEXTS[:7], prose(40), "alpha beta, gämma never seen x1", "beta, gämma"]
    brute = Trigrams(train_)
    for files, most in ((8, 256), (2, 5)):  # of each array: eight, or one for every five parts
        monkeypatch.setattr(lm_scoring, "FILES", files)
        monkeypatch.setattr(lm_scoring, "FILE_PARTS", most)
        model = lm_scoring.train(table(spark, train_))
        found = Counter(p.name.rpartition("-")[0] for p in Path(urlparse(model.folder).path).glob("*.npy"))
        read = {k: n for k, n in found.items() if k.startswith("all-")}
        assert model.parts > 16 and set(read.values()) == {max(files, -(-model.parts // most))}
        assert set(found) - set(read) <= {"pair-more", "pair-counts"}  # no look-up reads them
        rows = by_id(lm_scoring.score(table(spark, fresh), model))
        for i, t in enumerate(fresh):
            assert (rows[i]["base_score"], rows[i]["score"]) == pytest.approx(brute.score(t), rel=1e-9), t


def test_marked_places():
    from auditlake.llm._store import marked, marks

    for n in (0, 1, 64, 65, 5000):
        own = np.flatnonzero(RNG.random(n) < 0.3).astype(np.uint32)
        hit, before = marked(marks([own[: len(own) // 2], own[len(own) // 2 :]], n), np.arange(n))
        assert (np.flatnonzero(hit) == own).all() and (before == np.searchsorted(own, np.arange(n))).all()


def test_lm_without_training_rows(spark):
    model = lm_scoring.train(table(spark).where("false"))
    rows = by_id(lm_scoring.score(table(spark), model))
    assert len(rows) == len(TEXTS) and all(r["score"] == 0 and r["n_known"] == 0 for r in rows.values())


def test_packing(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(table(spark), P.path("byte_bpe_50k.json"), keep_ids=True).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
    seen = {i: [] for i in ids}
    at = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]] += part
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen == ids
    for pieces in at.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    again = packing.pack_documents(table(spark).union(table(spark)).repartition(5), P.path("byte_bpe_50k.json")).drop("ids")
    other = packing.pack_documents(table(spark).union(table(spark)).repartition(2), P.path("byte_bpe_50k.json")).drop("ids")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, other.collect())) and again.count() == 2 * len(rows)
    bins, _ = packing.best_fit_decreasing([7, 6, 3, 2, 2], 10)
    assert bins.tolist() == [0, 1, 0, 1, 1]


def test_url_filter(spark):
    urls = [None, "", "no-scheme", "http://A.Example.org/es/1", "https://example.org/en/12?x", "http://org", "http://myorg/", "http://x.com/fr/", "http://x.com/FR/", "http://spam-farm.net/a", "ftp://x.com://y/de/", "http://x.com/de/a", "http://x.com/de/a"]
    pages = spark.createDataFrame([(i, u, "h", "host") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    rules = [url_filter.listed(*r) for r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))]
    rows = {r["page_id"]: r for r in url_filter.judge(pages.union(pages.where("page_id = 3")), rules).collect()}
    assert len(rows) == len(urls) and url_filter.judge(pages.union(pages.where("page_id = 3")), rules).count() == len(urls) + 1
    assert [rows[i]["rule"] for i in range(len(urls))] == [None, None, None, "example.org/es/", "example.org/en/1", None, None, "com/fr/", None, None, None, "com/de/", "com/de/"]
    assert [rows[i]["verdict"] for i in (3, 7, 9, 11)] == ["block", "allow", "block", "block"]


def test_url_rules_as_a_table(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"https://h{i % 50}.site{i % 7}.net/p{i % 11}/x") for i in range(300)], "page_id long, url string")
    rules = [url_filter.listed(v, f"site{k}.net/p{j}/") for k in range(7) for j in range(0, 11, 2) for v in ("block" if (k + j) % 3 else "allow",)]
    of = lambda r: {x["page_id"]: (x["rule"], x["verdict"]) for x in url_filter.judge(pages, r).collect()}
    in_code = of(rules)
    stored = url_filter.rule_table(spark, rules)
    assert of(stored) == in_code
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 10)  # the shuffled way
    assert of(stored) == in_code
    for i in range(300):
        rule = f"site{i % 7}.net/p{i % 11}/" if i % 11 % 2 == 0 else None
        assert in_code[i] == (rule, "allow" if rule is None or (i % 7 + i % 11) % 3 == 0 else "block")


def test_order_minhash(spark):
    rows = by_id(order_minhash.classes(table(spark)))
    classes = {i: r["class_id"] for i, r in rows.items()}
    assert classes[0] == classes[1] == 0 and classes[2] == 2
    assert classes[7] == classes[8] == classes[9] == classes[10] == 7
    assert classes[5] == 5 and classes[6] == 6 and classes[11] == 11


def test_large_group_of_near_copies(spark):
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(60):
        own = list(base)
        own[3 * k] = f"z{k}"
        texts.append(" ".join(own))
    assert {r["class_id"] for r in order_minhash.classes(table(spark, texts)).collect()} == {0}


def test_similar_pairs_within_one_template(spark):
    # 176 k-mers are everyone's (0.786), 4 more the pair's (0.818): many pairs meet in large buckets only
    texts = [" ".join([f"t{k}" for k in range(180)] + [f"p{i // 2}w{k}" for k in range(4)] + [f"d{i}w{k}" for k in range(20)]) for i in range(800)]
    classes = {r["doc_id"]: r["class_id"] for r in order_minhash.classes(table(spark, texts)).collect()}
    assert classes == {i: i - i % 2 for i in range(800)}


def test_no_similar_pair_is_pruned():
    base = RNG.integers(1, 2**63, 120).astype(np.uint64)
    rows = []
    for _ in range(150):
        own = base[: RNG.integers(90, 121)].copy()
        own[RNG.choice(len(own), RNG.integers(0, 20), replace=False)] = RNG.integers(1, 2**63)
        rows.append(np.unique(own)[RNG.permutation(len(np.unique(own)))] if RNG.random() < 0.1 else own[np.sort(np.unique(own, return_index=True)[1])])
    counts = np.bincount(order_minhash._slot(np.concatenate(rows)), minlength=order_minhash.SLOTS)
    firsts = [order_minhash.prefix(r, counts) for r in rows]
    linked = 0
    for i, a in enumerate(rows):
        for j in range(i):
            if order_minhash.similar(a, rows[j]):
                linked += 1
                met, x, y = np.intersect1d(firsts[i], firsts[j], return_indices=True)
                most = np.minimum(len(a) - x, len(rows[j]) - y)
                assert len(met) and (9 * most >= 4 * (len(a) + len(rows[j]))).any()
    assert linked > 20


def test_keep_of_a_very_long_text(spark):
    import time

    docs = table(spark, [" ".join(f"w{k}" for k in range(20_000)), prose(20_000), None, "", " ".join(f"v{k}" for k in range(30))]).withColumnRenamed("keys", "words_")
    began = time.time()
    kept = quality_rules.keep(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 4] and kept.columns == docs.columns
    assert time.time() - began < 60  # every measurement is made once a row


@pytest.mark.parametrize("key_words", [substring_dedup.KEY_WORDS, 10])  # 10: every minimizer is divided, in the end into windows
def test_substring_dedup(spark, monkeypatch, key_words):
    monkeypatch.setattr(substring_dedup, "KEY_WORDS", key_words)
    passage = [f"p{k}" for k in range(80)]
    texts = [None, " ".join(passage)] + [" ".join([f"d{i}w{k}" for k in range(40)] + passage[i % 7 :] + [f"d{i}v{k}" for k in range(40)]) for i in range(100)] + TEXTS
    rows = by_id(substring_dedup.digests(table(spark, texts)))
    seen = {}
    for i, t in enumerate(texts):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k : k + 50]), i) != i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (rows[i]["n_words"], rows[i]["n_removed"], rows[i]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()), i
    applied = by_id(substring_dedup.apply(table(spark, texts)))
    assert len(applied) == len(texts) and applied[5 + 2]["text"].split()[0] == "d5w0"


def test_stages_with_repeated_doc_ids(spark):
    import corpus_pipeline

    passage = [f"p{k}" for k in range(80)]
    own = lambda n, k: [f"{n}w{i}" for i in range(k)]
    texts = [(1, own("a", 40) + passage), (2, own("b", 70) + passage[5:]), (2, own("b", 70) + passage[5:]), (2, own("c", 120)), (3, own("d", 90) + passage[:60]), (3, passage + own("e", 90)), (4, own("c", 120)), (0, own("f", 60))]
    docs = spark.createDataFrame([(i, " ".join(t), len(" ".join(t))) for i, t in texts], "doc_id long, text string, n_chars long").repartition(3)
    windows = [{tuple(t[k : k + 50]) for k in range(len(t) - 49)} for _, t in texts]
    expected = []
    for i, t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - 49):
            if any(j < i and tuple(t[k : k + 50]) in w for (j, _), w in zip(texts, windows)):
                gone[k : k + 50] = [True] * 50
        expected.append((i, [x for x, g in zip(t, gone) if not g]))
    found = corpus_pipeline.drop_repeated_passages(spark, docs, "").collect()
    assert sorted((r["doc_id"], words(r["text"])) for r in found) == sorted(expected)
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    once = [texts[k] for k in (0, 1, 3, 4, 5, 7)]  # the second row of 2 and row 4 are copies
    assert sorted((r["doc_id"], words(r["text"])) for r in kept.collect()) == sorted(once)


def test_byte_bpe(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = by_id(byte_bpe.encode(table(spark), path, P.PATTERN))
    for i, t in enumerate(TEXTS):
        assert list(rows[i]["ids"]) == library.encode_ordinary(t or "")
    back = by_id(byte_bpe.decode(byte_bpe.encode(table(spark), path, P.PATTERN), path))
    assert all(bytes(back[i]["bytes"]).decode() == (t or "") for i, t in enumerate(TEXTS))


def test_toxicity_evidence_is_the_models_difference(spark):
    import math

    own = lambda i: "".join(chr(97 + (i * k * k + k) % 26) for k in range(1, 6))
    texts = [(f"{prose(12)} {own(i)} {own(i // 2)}" + " grumpig" * (1 + i % 2) * (i % 3 == 0) + " burst" * 9 * (i == 6), int(i % 3 == 0)) for i in range(30)]
    rows = spark.createDataFrame([(t, y) for t, y in texts], "text string, toxic int")
    model = toxicity.count_models(rows)
    n = toxicity.ORDER
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def grams(word):
        raw = b"\1" * (n - 1) + word.translate(lower).encode() + b"\2"
        return [raw[k : k + n] for k in range(len(raw) - n + 1)]

    said = ({}, {})  # of each expression, how often each text says it
    for t, y in texts:
        own_counts = Counter(g for w in words(t) for g in grams(w))
        for g, k in own_counts.items():
            said[y].setdefault(g, []).append(k)
    counts = tuple({g: sum(k) - max(k) + 1 for g, k in of.items()} for of in said)

    def discount(c):
        one, two = sum(v == 1 for v in c), sum(v == 2 for v in c)
        return min(max(one / (one + 2 * two) if one else 0.5, 0.05), 0.95)

    level = {n: set(counts[0]) | set(counts[1])}
    cont = {}
    for k in range(n - 1, 0, -1):
        cont[k] = {}
        for g in level[k + 1]:
            cont[k][g[1:]] = cont[k].get(g[1:], 0) + 1
        level[k] = set(cont[k])

    def shared(g):
        if not g:
            return 1 / 257
        c, d = cont[len(g)], discount(cont[len(g)].values())
        own = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        return (max(c[g] - d, 0) + d * len(own) * shared(g[1:])) / sum(own.values())

    def log_p(g, y):
        d, own = discount(counts[y].values()), {x: v for x, v in counts[y].items() if x[:-1] == g[:-1]}
        total = sum(own.values())
        left = d * len(own) / total if total else 1.0
        # an expression of neither class has the same backoff under both
        p = shared(g[1:]) if g in level[n] else 1.0
        return math.log((max(counts[y].get(g, 0) - d, 0) / total if total else 0) + left * p)

    fresh = ["alpha grumpig neverseen", "Beta, foo bar", "", None, "grumpel " * 3]
    found = {r["doc_id"]: r for r in toxicity.evidence(table(spark, fresh).select("doc_id", "text"), model).collect()}
    for i, t in enumerate(fresh):
        each = [sum(log_p(g, 1) - log_p(g, 0) for g in grams(w)) for w in words(t)]
        assert math.isclose(found[i]["evidence"], sum(each) / max(len(each), 1), abs_tol=1e-9)
        for name, least in (("telling", toxicity.TELLING), ("strong", toxicity.STRONG)):
            assert math.isclose(found[i][name], sum(x for x in each if x > least) / max(len(each), 1), abs_tol=1e-9)


def test_toxicity(spark):
    texts, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        own = [f"{a}{b}" for a, b in zip(RNG.choice(["ra", "lo", "mi", "su"], 40), RNG.choice(["ten", "van", "dor"], 40))]
        if toxic:
            own[3] = own[17] = "zzgrump"
        texts.append(" ".join(own))
        labels.append((i, int(toxic)))
    docs = table(spark, [*texts, None, ""])
    model = toxicity.train(docs, spark.createDataFrame([*labels, (0, None)], "doc_id long, toxic int"))
    rows = by_id(toxicity.score(docs, model))
    wrong = sum(rows[i]["predicted"] != y for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2)
    assert wrong <= 2 and 0 <= rows[400]["score"] < 0.5 and len(rows) == 402
    assert toxicity.keep(docs, model).columns == docs.columns
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embedding_dedup_against_all_pairs(spark, kind):
    centres = RNG.standard_normal((12, 64))
    x = np.concatenate([centres[k] + s * RNG.standard_normal((30, 64)) for k, s in enumerate(np.linspace(0.05, 0.5, 12))] + [RNG.standard_normal((140, 64))])
    x = x.astype(np.float32).astype(np.float64)
    label = np.arange(len(x)) % 2
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))]
    found = {r["vec_id"]: r for r in embedding_dedup.dedup(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    component = np.arange(len(x))
    for _ in range(len(x)):
        component = np.minimum(component, np.where(linked, component[None], len(x)).min(1))
    assert linked.sum() > 500
    assert [found[i]["n_links"] for i in range(len(x))] == linked.sum(1).tolist()
    assert [found[i]["component_id"] for i in range(len(x))] == component.tolist()


def test_embedding_dedup(spark):
    x = RNG.standard_normal((60, 64))
    rows = [(i, v.tolist(), i % 3, "e") for i, v in enumerate(x)]
    rows += [(60 + i, (x[0] + 0.05 * RNG.standard_normal(64)).tolist(), 0, "e") for i in range(10)]
    rows += [(70, x[0].tolist(), 0, "e"), (71, (3 * x[0]).tolist(), 0, "e"), (72, x[0].tolist(), 1, "e"), (73, None, 0, "e"), (74, [0.0] * 64, 0, "e"), (75, [float("nan")] * 64, 0, "e"), (76, x[1].tolist(), None, "e"), (77, [], 0, "e"), (78, [1.0, 2.0], 0, "e")]
    table_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, raw string")
    found = {r["vec_id"]: r for r in embedding_dedup.dedup(table_).collect()}
    assert len(found) == len(rows)
    group = [0, *range(60, 72)]
    assert all(found[i]["component_id"] == 0 and found[i]["n_links"] == len(group) - 1 for i in group)
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in (1, 72, 73, 74, 75, 76, 77, 78))


EMPTY = [
    quality_rules.ledger, order_minhash.classes, order_minhash.keep, substring_dedup.digests, substring_dedup.apply,
    lambda docs: packing.pack_documents(docs, P.path("byte_bpe_50k.json")),
    lambda docs: byte_bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    lambda docs: lm_scoring.score(docs, lm_scoring.train(docs)),
    lambda docs: toxicity.score(docs, toxicity.train(docs, docs.selectExpr("doc_id", "part AS toxic"))),
    lambda docs: token_output.read(docs.sparkSession, token_output.write_documents(docs, P.path("word_bpe_49k.json"))),
    lambda docs: embedding_dedup.dedup(docs.selectExpr("doc_id AS vec_id", "part AS label", "array(1.0D) AS embedding")),
    lambda docs: url_filter.judge(docs.selectExpr("doc_id AS page_id", "text AS url"), [url_filter.listed("allow", "org/")]),
]


@pytest.mark.parametrize("operator", EMPTY)
def test_empty_tables(spark, operator):
    assert operator(table(spark).where("false")).count() == 0


def test_repeated_rows_long_texts_and_clashing_names(spark):
    clash = "doc_id long, text string, part int, keys string, toxic int, n int, score double, ids string, copy long, row string"
    texts = [prose(20_000), "word", None, "", prose(20)]
    rows = [(i, t, 1, "k", 1, 2, 0.5, "i", 3, "r") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:3], clash).repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)] * 2, "doc_id long, toxic int")
    path = P.path("byte_bpe_50k.tiktoken")
    found = {
        "op1": quality_rules.ledger(docs), "op2": token_output.read(spark, token_output.write_documents(docs, P.path("word_bpe_49k.json"))).drop("start"),
        "op3": lm_scoring.score(docs, lm_scoring.train(docs)), "op6": order_minhash.classes(docs).drop("kept"), "op7": substring_dedup.digests(docs),
        "op8": toxicity.score(docs, toxicity.train(docs, labels)), "op9": byte_bpe.encode(docs, path, P.PATTERN, digests=True),
    }
    for name, df in found.items():
        got = [tuple(r) for r in df.collect()]
        assert len(got) == 8, name
        by = {}
        for r in got:
            by.setdefault(r[0], []).append(r)
        assert all(len(v) == (2 if k < 3 else 1) and len(set(v)) == 1 for k, v in by.items()), name
    pieces = packing.pack_documents(docs, P.path("byte_bpe_50k.json")).collect()
    assert sum(r["start"] == 0 for r in pieces) == 8
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in byte_bpe.decode(byte_bpe.encode(docs, path, P.PATTERN), path).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


@pytest.mark.parametrize("listed", [True, False])
def test_halved_keys(tmp_path, listed):
    from auditlake.llm._store import find_keys, read_keys, write_keys

    folder, part_keys = f"file://{tmp_path}", []
    for part, n in ((0, 0), (1, 4000), (2, 1)):
        keys = np.unique(RNG.integers(0, 300, n).astype(np.uint64) ** np.uint64(1 + listed) << np.uint64(32) | RNG.integers(0, 2**32, n).astype(np.uint64))
        write_keys(folder, "k", part, keys, None if listed else 300)
        part_keys.append(keys)
        if listed:
            assert (read_keys(folder, "k", part) == keys).all()
    asked = [np.concatenate([k[::3], k[:50] + np.uint64(1), RNG.integers(0, 300, 40).astype(np.uint64) << np.uint64(32)]) for k in part_keys]
    part = np.repeat(np.arange(3), [len(a) for a in asked])
    due = [int(np.searchsorted(k, x)) if x in k else -1 for k, a in zip(part_keys, asked) for x in a]
    assert find_keys(folder, "k", part, np.concatenate(asked), listed).tolist() == due
