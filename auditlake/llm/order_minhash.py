"""Near-duplicate documents by Order MinHash.

A document's k-mers are runs of five words (A-Z in lower case), each labelled with its
occurrence number. A sketch takes the ``PICK`` labelled k-mers with the least hash values
and keeps them in text order, so it is sensitive to edit similarity, not only to the set.
Documents with an equal sketch are candidates; a candidate pair is linked if the banded
alignment of their k-mers, the longest chain of equal k-mers in the same order near the
diagonal, holds M with M / (a + b - M) >= 0.8 for a and b k-mers.

Equal texts are merged before anything else. Within a sketch's bucket of up to ``SMALL``
documents every pair is verified. In a larger one every document is verified against the
member that shares most buckets and two drawn ones; what is then not in the bucket's main
component against six more. A last round is exact: what is still not in the main component is
a leftover, and it is verified against every member of its buckets in another component,
except where a bound proves that the pair is not similar. The chain is no longer than the
number of common labelled k-mers, so a similar pair meets within the first fifth (and one) of both
documents' k-mers in any one order, where the first place at which they meet bounds how many
they can have in common, and so do their numbers of k-mers. The order is rarest first, which
only prunes. So every candidate pair is in one class, verified or proved not similar. Classes
are the connected components of the links.

Sketches miss a pair of similarity s in all ``SKETCHES`` buckets with probability about
(1 - s**PICK)**SKETCHES, 3e-6 at 0.8.

Defined results: a null text is the empty text; equal texts, empty ones too, are one class;
texts under five words are one k-mer; repeated rows are in their document's class; rows
without a doc_id come after all others, and name a class only where no other row does; an empty
table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.families import linked_components
from ._scratch import materialize, numbered
from ._store import pack, unpack
from ._text import LOWER, hash_spans, mix, slices, word_spans

K = 5
PICK = 5
SKETCHES = 32
SIMILAR = (4, 5)  # 0.8 as a fraction
SMALL = 16
#: Members of a large bucket that the others are verified against, in each round.
LEADS = (3, 6)
#: Slots in which k-mers are counted for the order of the last round.
SLOTS = 1 << 20
#: Documents that meet in a k-mer and are dealt to one task of the last round.
SHARE = 256
#: Bytes of text that are worked on at once.
SLICE = 1 << 18
_U = np.uint64


def kmers(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers of word hashes, and each row's first k-mer; a short row is one k-mer."""
    n = np.diff(first)
    count = np.where(n >= K, n - K + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    start = np.arange(at[-1]) - at[:-1][row] + first[:-1][row]
    total = np.zeros(len(start), _U)
    padded = np.concatenate([words, np.zeros(K, _U)])
    with np.errstate(over="ignore"):
        for k in range(K):
            inside = k < n[row]
            total = mix(total + np.where(inside, padded[start + k], _U(k + 1)) * _U(0x9E3779B97F4A7C15) + _U(k))
    return total, at


def labelled(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """k-mer hashes with their occurrence number in the row."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    with np.errstate(over="ignore"):
        own = mix(hashes ^ (row.astype(_U) * _U(0xD1342543DE82EF95)))
        order = np.argsort(own, kind="stable")
        edge = np.concatenate([[True], own[order][1:] != own[order][:-1]]) if len(own) else np.zeros(0, bool)
        run = np.arange(len(own)) - np.maximum.accumulate(np.where(edge, np.arange(len(own)), 0)) if len(own) else own.astype(np.int64)
        number = np.empty(len(own), np.int64)
        number[order] = run
        return mix(hashes + number.astype(_U) * _U(0xA0761D6478BD642F))


def sketches(marked: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of SKETCHES hashes for each row of k-mers; rows without k-mers give zeros."""
    out = np.zeros((len(at) - 1, SKETCHES), _U)
    full = np.flatnonzero(np.diff(at) > 0)
    starts, n = at[:-1][full], np.diff(at)[full]
    if not len(full):
        return out
    most = np.iinfo(np.uint64).max
    for j in range(SKETCHES):
        value = mix(marked ^ mix(np.array([j + 1], _U)))
        places = np.full((len(full), PICK), len(marked), np.int64)
        for k in range(PICK):
            low = np.minimum.reduceat(value, starts)
            hit = np.flatnonzero((value == np.repeat(low, n)) & (value != most))
            row = np.searchsorted(starts, hit, "right") - 1
            row, first = np.unique(row, return_index=True)
            places[row, k] = hit[first]
            value[hit[first]] = most
        places.sort(1)
        picked = np.concatenate([marked, [0]]).astype(_U)[np.minimum(places, len(marked))]
        total = np.full(len(full), j + 1, _U)
        with np.errstate(over="ignore"):
            for k in range(PICK):
                total = mix(total * _U(0x9E3779B97F4A7C15) + picked[:, k])
        out[full, j] = total
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, off in slices(batch.column("text"), SLICE):
            low = LOWER[buf]
            starts, ends, first = word_spans(low, off)
            found, at = kmers(hash_spans(low, starts, ends), first)
            rows = sketches(labelled(found, at), at)
            has = np.diff(at) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * SKETCHES)]), pa.int32()), pa.array(rows[has].reshape(-1).view(np.int64)))
            text = [pa.array(hash_spans(buf, off[:-1], off[1:], kind).view(np.int64)) for kind in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *text, lists], ["doc_id", "t1", "t2", "sketches"])


def _chain(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common chain of labelled k-mers within the band."""
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    j = j[np.argsort(i, kind="stable")]
    if len(j) < 2 or (np.diff(j) > 0).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
        else:
            tails[k] = x
    return len(tails)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two rows of labelled k-mers reach SIMILAR by banded alignment."""
    up, down = SIMILAR
    both = len(a) + len(b)
    if min(len(a), len(b)) * down < max(len(a), len(b)) * up:
        return False
    # at this similarity at most both * (down - up) / (down + up) k-mers stand alone, which bounds the shift
    m = _chain(a, b, both * (down - up) // (down + up) + 1)
    return m * down >= up * (both - m)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            sides = []
            for name in ("text_a", "text_b"):
                rows = []
                for _, _, buf, off in slices(some.column(name), SLICE):
                    low = LOWER[buf]
                    starts, ends, first = word_spans(low, off)
                    found, edge = kmers(hash_spans(low, starts, ends), first)
                    marked = labelled(found, edge)
                    rows += [marked[x:y] for x, y in zip(edge[:-1], edge[1:])]
                sides.append(rows)
            keep += [similar(a, b) for a, b in zip(*sides)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that the alignment confirms."""
    pairs = materialize(pairs.where("a < b").distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = materialize(docs.join(wanted.hint("merge"), "doc_id", "left_semi"), "candidates")  # the same plan at every size
    side = lambda s: texts.select(F.col("doc_id").alias(s), F.col("text").alias(f"text_{s}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    return materialize(both.mapInArrow(_verify, "a long, b long"), "links")


def _marked(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, labelled k-mers, each row's first) of slices of a column of texts."""
    for a, b, buf, off in slices(text, SLICE):
        low = LOWER[buf]
        starts, ends, first = word_spans(low, off)
        found, at = kmers(hash_spans(low, starts, ends), first)
        yield a, b, labelled(found, at), at


def _slot(marked: np.ndarray) -> np.ndarray:
    return (mix(marked) >> _U(44)).astype(np.int64)


def _slot_counts(texts: DataFrame) -> np.ndarray:
    """How many labelled k-mers of the texts fall into each of SLOTS slots."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, marked, _ in _marked(batch.column("text")):
                total += np.bincount(_slot(marked), minlength=SLOTS)
        used = np.flatnonzero(total)
        parts = np.split(used, np.searchsorted(used, np.arange(1, 16) * (SLOTS // 16)))
        rows = [(k, pack(x), pack(total[x])) for k, x in enumerate(parts) if len(x)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["part", "slots", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLOTS, np.int64)
        for slots, counts in zip(pdf["slots"], pdf["counts"]):
            total[unpack(slots).astype(np.int64)] += unpack(counts).astype(np.int64)
        used = np.flatnonzero(total)
        return pd.DataFrame([(pack(used), pack(total[used]))], columns=["slots", "counts"])

    out = np.zeros(SLOTS, np.int64)
    sums = texts.mapInArrow(count, "part int, slots binary, counts binary").groupBy("part").applyInPandas(add, "slots binary, counts binary")
    for r in sums.collect():  # at most SLOTS numbers in all
        out[unpack(r["slots"]).astype(np.int64)] = unpack(r["counts"]).astype(np.int64)
    return out


def prefix(marked: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest labelled k-mers of a row, of which it has one in common with every similar row."""
    up, down = SIMILAR
    order = np.lexsort((marked, counts[_slot(marked)]))
    return marked[order[: len(marked) - -(-len(marked) * up // down) + 1]]


def _unproved(active: DataFrame, placed: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of a leftover and a member of its buckets in other components that no bound excludes."""
    members = placed.join(active.select("bucket").distinct().hint("merge"), "bucket", "left_semi").select("doc_id", "component").distinct()
    left = active.select("doc_id", F.lit(True).alias("left")).distinct()
    members = materialize(members.join(left, "doc_id", "left").select("doc_id", "component", F.coalesce("left", F.lit(False)).alias("left")), "members")
    texts = materialize(docs.join(members.hint("merge"), "doc_id"), "members")
    counts = _slot_counts(texts.select("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = batch.select(["doc_id", "component", "left"])  # a prefix does not repeat the text
            for a, b, marked, at in _marked(batch.column("text")):
                firsts = [prefix(marked[x:y], counts) if y > x else marked[:0] for x, y in zip(at[:-1], at[1:])]
                n = np.array([len(x) for x in firsts])
                row = np.repeat(np.arange(b - a), n)
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                own = heads.slice(a, b - a).take(pa.array(row))
                columns = [np.concatenate([marked[:0], *firsts]).view(np.int64), place.astype(np.int32), np.diff(at)[row].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("doc_id", "component", "left")), *map(pa.array, columns)], ["doc_id", "component", "left", "kmer", "place", "n"])

    entries = materialize(texts.select("doc_id", "component", "left", "text").mapInArrow(emit, "doc_id long, component long, left boolean, kmer long, place int, n int"), "prefixes")
    met = entries.groupBy("kmer").agg(F.count("*").alias("all"), F.count_if("left").alias("lefts")).where("lefts > 0 AND all > 1")
    met = met.select("kmer", F.ceil(F.col("all") / SHARE).cast("int").alias("shares"))
    entries = materialize(entries.join(met.hint("merge"), "kmer"), "prefixes")
    # a k-mer of many documents is dealt in shares, each of which meets all its leftovers
    x = entries.where("left").select("kmer", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), *[F.col(c).alias(f"{c}_x") for c in ("doc_id", "component", "place", "n")])
    y = entries.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int")).select("kmer", "share", "left", *[F.col(c).alias(f"{c}_y") for c in ("doc_id", "component", "place", "n")])
    up, down = SIMILAR
    most = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
    may = (F.col("component_x") != F.col("component_y")) & (~F.col("left") | (F.col("doc_id_x") < F.col("doc_id_y"))) & (most * (up + down) >= up * (F.col("n_x") + F.col("n_y")))
    pairs = x.hint("merge").join(y, (x["kmer"] == y["kmer"]) & (x["share"] == y["share"]) & may)
    return pairs.select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and kept of every row of docs."""
    own = numbered(docs)
    found = _numbers(own.rows.select(F.col("number").alias("doc_id"), "text"))
    return own.named(found, "doc_id", "class_id")


def keep(docs: DataFrame) -> DataFrame:
    """One row of docs of each class, the first by doc_id, with all its columns."""
    own = numbered(docs)
    stays = _numbers(own.rows.select(F.col("number").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("number"))
    return own.rows.join(stays, "number", "left_semi").select("row.*")


def _numbers(docs: DataFrame) -> DataFrame:
    """classes() of rows with unique doc_ids and texts."""
    rows = materialize(docs.mapInArrow(_sketch, "doc_id long, t1 long, t2 long, sketches array<long>"), "sketches")
    firsts = materialize(rows.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep")), "texts")
    reps = rows.join(firsts.withColumnRenamed("rep", "doc_id"), ["doc_id", "t1", "t2"], "left_semi")
    entries = reps.select("doc_id", F.explode("sketches").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(entries.join(sizes, "bucket"), "buckets")
    # the document that shares most, such as the original of many copies, leads its buckets
    weights = shared.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    shared = materialize(shared.join(weights, "doc_id"), "buckets")

    small = shared.where(F.col("n") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
    inner = F.flatten(F.transform("ids", lambda a: F.transform(F.filter("ids", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = small.select(F.explode(inner).alias("p")).select("p.a", "p.b")
    large = shared.where(F.col("n") > SMALL).select("bucket", "doc_id", "weight")
    active, links = large.select("bucket", "doc_id"), None
    for turn, leads in enumerate((*LEADS, 0)):
        if leads:
            salted = [F.max_by("doc_id", F.xxhash64("doc_id", F.lit(100 * turn + k))) for k in range(leads)]
            if turn == 0:
                salted[0] = F.max_by("doc_id", F.struct("weight", F.bitwise_not("doc_id")))
            chosen = large.groupBy("bucket").agg(F.array_distinct(F.array(*salted)).alias("leads"))
            # a document shares most of its leads between its buckets and takes each once
            own = active.join(chosen.hint("merge"), "bucket").groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_set("leads"))).alias("leads"))
            new = own.select(F.explode("leads").alias("lead"), "doc_id").where("lead <> doc_id")
            new = new.select(F.least("lead", "doc_id").alias("a"), F.greatest("lead", "doc_id").alias("b"))
        else:
            new = _unproved(active, placed, docs)
        found = _links(new.unionByName(pairs) if turn == 0 else new, docs)
        links = found if links is None else materialize(links.unionByName(found), "links")
        part = materialize(linked_components(links), "components")
        if not leads:
            break
        sized = part.join(part.groupBy("component").agg(F.count("*").alias("size")), "component").withColumnRenamed("node", "doc_id")
        placed = large.join(sized, "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"), F.coalesce("size", F.lit(1)).alias("size"))
        placed = materialize(placed, "placed")
        main = placed.groupBy("bucket").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
        active = materialize(placed.join(main, "bucket").where("component <> main").select("bucket", "doc_id"), "leftovers")
        if active.isEmpty():
            break
    ids = rows.join(firsts, ["t1", "t2"])
    component = F.coalesce("component", "rep")
    return ids.join(part.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", component.alias("class_id"), (F.col("doc_id") == component).alias("kept"))
