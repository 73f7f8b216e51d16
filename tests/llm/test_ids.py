"""Null, negative, large and repeated doc_ids through the operators that order, number or join by them."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from auditlake.llm import order_minhash, packing, substring_dedup, token_output

RNG = np.random.default_rng(11)
BIG, LOW = 2**63 - 1, -(2**63)


def prose(n):
    return " ".join(f"w{k}" for k in RNG.integers(0, 5000, n))


SHARED, OTHER = prose(120), prose(200)
ROWS = [
    (None, SHARED + " " + prose(9)), (None, OTHER), (None, None), (BIG, OTHER), (BIG, OTHER), (BIG, SHARED), (LOW, prose(40) + " " + SHARED), (-5, "few words"),
    (2**53 + 1, OTHER + " more"), (2**53 + 2, prose(30)), (2**62, ""), (2**62, "x"), (2**62, SHARED + " end"), (7, prose(5000)),
]
PLAIN = [(BIG, OTHER), (LOW, OTHER + " tail"), (2**53 + 1, SHARED), (2**53 + 2, SHARED), (-1, prose(70) + " " + SHARED), (0, prose(50))]


@pytest.fixture(params=["repeated", "plain"])
def rows(request):
    return ROWS if request.param == "repeated" else PLAIN


def table(spark, rows):
    return spark.createDataFrame([(i, t, "n", 1, "f") for i, t in rows], "doc_id long, text string, number string, first int, own string").repartition(4)


def encoded(name, rows):
    library = Tokenizer.from_file(str(P.path(name)))
    out = []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, len(ids), zlib.crc32(ids.tobytes()), ids))
    return out


def place(doc_id):
    return (doc_id is None, doc_id or 0)


def test_token_output(spark, rows):
    found = token_output.digests(token_output.read(spark, token_output.write_documents(table(spark, rows), str(P.path("word_bpe_49k.json"))))).collect()
    due = encoded("word_bpe_49k.json", rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == Counter(x[:3] for x in due)
    found.sort(key=lambda r: r["start"])
    assert [place(r["doc_id"]) for r in found] == sorted(place(i) for i, _ in rows)
    assert [r["start"] for r in found] == np.cumsum([0, *[r["n_tokens"] for r in found][:-1]]).tolist()


def test_packing(spark, rows):
    found = packing.pack_documents(table(spark, rows), str(P.path("byte_bpe_50k.json"))).collect()
    due = Counter()
    for i, n, _, ids in encoded("byte_bpe_50k.json", rows):
        for a in range(0, n, packing.WINDOW):
            part = ids[a : a + packing.WINDOW]
            due[i, a, len(part), zlib.crc32(part.tobytes()), n] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == due
    held = {}
    for r in found:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0, *[n for _, n in parts][:-1]]).tolist() and sum(n for _, n in parts) <= packing.WINDOW


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def less_words(rows):
    """(doc_id, words, words that stay) of every row."""
    starts = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            starts[key] = min(starts.get(key, (True, BIG)), place(i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - 49) if starts[tuple(w[k : k + 50])] < place(i) for j in range(50)}
        out.append((i, len(w), tuple(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_substring_dedup(spark, rows):
    docs = table(spark, rows)
    import hashlib

    due = Counter((i, n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, n, kept in less_words(rows))
    assert Counter(tuple(r) for r in substring_dedup.digests(docs).collect()) == due
    less = substring_dedup.apply(docs)
    assert less.columns == docs.columns
    assert Counter((r["doc_id"], tuple(words(r["text"]))) for r in less.collect()) == Counter((i, kept) for i, _, kept in less_words(rows))


def test_order_minhash(spark, rows):
    docs = table(spark, rows)
    found = order_minhash.classes(docs).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in rows)
    # texts that are alike but for a word or two at an end; the others have nothing in common
    of = lambda t: "other" if t and t.startswith(OTHER) else "shared" if t and t.startswith(SHARED) and len(words(t)) < 130 else t or ""
    groups = {}
    for i, t in rows:
        groups.setdefault(of(t), []).append(place(i))
    due = Counter((place(i), min(groups[of(t)])) for i, t in rows)
    got = Counter((place(r["doc_id"]), place(r["class_id"])) for r in found)
    assert got == due
    kept = order_minhash.keep(docs)
    assert kept.columns == docs.columns and Counter(place(r["doc_id"]) for r in kept.collect()) == Counter(min(g) for g in groups.values())
