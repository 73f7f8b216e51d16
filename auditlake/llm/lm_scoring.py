"""Interpolated modified Kneser-Ney trigram model, counted in Spark and memory-mapped by workers.

Counting: every task counts the words, then the word pairs, then the triples of its rows and
sends sorted compressed arrays to ranges, where they are merged. Nothing is pruned. Pairs are
sent by their first word; a first word that holds more than a part's fair share is spread
over all parts by the second word. A triple goes to the part of its first pair, whose place
there and the last word make its key; so a pair's followers are together, at most the
vocabulary of them.

The model is a folder of sorted arrays in the shared folder: word hashes (whose position is
the word's id), counts, continuation probabilities, and per part the sorted keys of pairs and
triples, as the last words after each first word or pair and where those begin; counts are kept only
where they are not one, and bits tell where. As soon as the parts of an array are there, they are put back to back in a
few files, whose number hardly grows with the table: a batch of queries touches all of them. Workers
map the files and look up the distinct words and pairs of a batch; nothing of the model passes
through the driver but a few sums per part.

Probability: (c(uvw) - D) / c(uv) + g(uv) * P(w | v), with P(w | v) from the numbers of
distinct words before vw (of the pair's own count after the begin mark, which nothing
precedes), and P(w) from the numbers of distinct words before w, interpolated with
1 / (V + 1), the share of each unknown word. The discounts of each order come from its counts
of counts. A text is scored from a begin mark to an end token; the base-10 logarithm is
returned.

Defined results: a null or empty text is the end token alone; repeated rows are scored
alike, and counted as often as they occur if they are training rows; without training rows
every probability is 1 / (V + 1) = 1; rows without a doc_id are scored like others, and
``held_out`` is null for them; an empty table gives no rows; columns other than
doc_id, text and the training mark are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import materialize, new_folder
from ._store import Parts, by_part, find_keys, find_sorted, first_parts, gather, marked, merge, pack, range_of, read_part, unpack, write_keys, write_part
from ._text import LOWER, hash_spans, slices, sums, word_spans

#: Pairs or triples that a task holds before it sends them.
PENDING = 6_000_000
#: Bytes of training texts for each part of the model.
PART_BYTES = 16 << 20
#: Files of each array of the model, at least if it has as many parts, and parts of a file, at most.
FILES, FILE_PARTS = 8, 256
PACKED = "part int, keys binary, counts binary"


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers that all lookups share."""

    folder: str
    parts: int
    files: int
    bounds: tuple[int, ...]  # first word id of each part, and the number of words
    words: int  # V without the end token; the end token's id is words, the begin mark's words + 1
    documents: int
    tokens: int  # N
    hot: tuple[int, ...]  # first words whose pairs are spread over all parts
    discounts: tuple[tuple[float, ...], ...] = ()  # of counts 1, 2, 3 and more of pairs and of triples
    unknown: float = 1.0  # P of an unknown word
    pairs: tuple[int, ...] = ()  # first pair of each part, and the number of pairs

    @property
    def types(self) -> int:
        """V with the end token."""
        return self.words + (self.documents > 0)


def _word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and each row's first word."""
    buf = LOWER[buf]
    starts, ends, first = word_spans(buf, offsets)
    return hash_spans(buf, starts, ends), first


def _rows(part: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One packed row for each part; keys are sorted."""
    order = by_part(part)
    part, keys, counts = part[order], keys[order], counts[order]
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    ends = [*edges[1:], len(part)]
    return pa.RecordBatch.from_arrays(
        [pa.array(part[edges], pa.int32()), pa.array([pack(keys[a:b]) for a, b in zip(edges, ends)], pa.binary()), pa.array([pack(counts[a:b]) for a, b in zip(edges, ends)], pa.binary())],
        ["part", "keys", "counts"],
    )


def _merged(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return merge([unpack(x) for x in pdf["keys"]], [unpack(x) for x in pdf["counts"]])


def _vocabulary(train: DataFrame, parts: int) -> DataFrame:
    """Packed (word hash, count) by hash range."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for _, _, buf, off in slices(batch.column("text")):
                k, c = np.unique(_word_hashes(buf, off)[0], return_counts=True)
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held > PENDING:
                    k, c = merge(keys, counts)
                    if len(k) > PENDING // 2:
                        yield _rows(range_of(k, parts), k, c)
                        keys, counts, held = [], [], 0
                    else:
                        keys, counts, held = [k], [c], len(k)
        k, c = merge(keys, counts)
        yield _rows(range_of(k, parts), k, c)

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        k, c = _merged(pdf)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "n": [len(k)], "total": [int(c.sum())], "keys": [pack(k)], "counts": [pack(c)]})

    packed = train.select("text").mapInArrow(count, PACKED)
    return packed.groupBy("part").applyInPandas(reduce, "part int, n long, total long, keys binary, counts binary")


class _Words:
    """Word ids of hashes."""

    def __init__(self, model: Model):
        self.model = model
        self.bounds = np.array(model.bounds, np.int64)[first_parts(model.parts, model.files)]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the distinct hashes, ascending but for -1 where unknown; hashes' places among them)."""
        distinct, place = np.unique(hashes, return_inverse=True)
        file = range_of(distinct, self.model.parts) * self.model.files // self.model.parts
        found = find_sorted(self.model.folder, "all-words", file, distinct)
        return np.where(found >= 0, found + self.bounds[file], -1), place


class _Pairs:
    """Parts and files of pairs of ids. A part has a slot for each first word of its range of ids, and for each hot one."""

    def __init__(self, model: Model):
        self.model = model
        self.edges = _edges(model)
        self.hot = np.array(model.hot, np.int64)
        firsts = first_parts(model.parts, model.files)
        self.file = np.repeat(np.arange(model.files), np.diff(firsts))
        self.slots = np.diff(self.edges) + len(self.hot)
        before = np.cumsum(self.slots) - self.slots
        self.head = before - before[firsts[self.file]]  # first slot of each part in its file
        if model.pairs:
            self.start = np.array(model.pairs[:-1], np.int64)
            self.start -= self.start[firsts[self.file]]  # first pair of each part in its file

    def slot(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(part, slot there) of pairs."""
        part = first * self.model.parts // (self.model.words + 2)
        slot = first - self.edges[part]
        at = np.minimum(np.searchsorted(self.hot, first), len(self.hot) - 1)
        hot = np.flatnonzero(self.hot[at] == first)
        part[hot] = (second[hot] * 2654435761 >> 7) % self.model.parts
        slot[hot] = np.diff(self.edges)[part[hot]] + at[hot]
        return part, slot

    def first(self, part: int, slot: np.ndarray) -> np.ndarray:
        """The first words of slots of a part."""
        return np.concatenate([np.arange(self.edges[part], self.edges[part + 1]), self.hot])[slot]

    def find(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(part, place in its file or -1) of pairs."""
        part, slot = self.slot(first, second)
        order = by_part(file := self.file[part])
        place = np.empty(len(part), np.int64)
        place[order] = find_keys(self.model.folder, "all-pairs", file[order], _key(self.head[part] + slot, second)[order], listed=False)
        return part, place

    def stored(self, part: int) -> np.ndarray:
        """The keys of a part's pairs, slot and second word, in ascending order."""
        file, head, at = self.file[part], self.head[part], self.start[part]
        begin = read_part(self.model.folder, "all-pairs-begin", file)[head : head + self.slots[part] + 1]
        tail = read_part(self.model.folder, "all-pairs-tail", file)[at : at + self.model.pairs[part + 1] - self.model.pairs[part]]
        return _key(np.repeat(np.arange(self.slots[part]), np.diff(begin.astype(np.int64))), tail)


def _edges(model: Model) -> np.ndarray:
    """The first id of each part's range of ids, and the number of ids."""
    return -(-np.arange(model.parts + 1) * (model.words + 2) // model.parts)


def _key(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    return head.astype(np.uint64) << np.uint64(32) | tail.astype(np.uint64)


def _in_order(part: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The order by part, then key."""
    order = np.argsort(key)
    return order[by_part(part[order])]


def _sequences(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous id, id, row offsets) of every token with each row's end token; the begin mark's id is end + 1."""
    n = len(first) - 1
    offsets = first + np.arange(n + 1)
    token = np.empty(offsets[-1], np.int64)
    is_end = np.zeros(len(token), bool)
    is_end[offsets[1:] - 1] = True
    token[is_end] = end
    token[~is_end] = ids
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[offsets[:-1]] = end + 1
    return before, token, offsets


def _distinct_pairs(before: np.ndarray, token: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, each token's place among them) of the distinct pairs of numbers below n, in ascending order."""
    pairs, at = np.unique(before * n + token, return_inverse=True)
    return pairs // n, pairs % n, at


def _pairs(train: DataFrame, model: Model) -> DataFrame:
    """Packed (pair key, count) by pair part; a key is the first word's slot and the second word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = _Words(model), _Pairs(model)
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            held.clear()
            first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            part, slot = pairs.slot(first, second)
            order = _in_order(part, keys := _key(slot, second))
            return _rows(part[order], keys[order], counts[order])

        for batch in batches:
            for _, _, buf, off in slices(batch.column("text")):
                hashes, at = _word_hashes(buf, off)
                known, place = words.ids(hashes)
                before, token, _ = _sequences(known[place], at, model.words)
                held.append(_key(before, token))
                n += len(token)
                if n > PENDING:
                    yield flush()
                    n = 0
        yield flush()

    return train.select("text").mapInArrow(count, PACKED)


def _triples(train: DataFrame, model: Model) -> DataFrame:
    """Packed (triple key, count) by the part of the first pair; a key is that pair's place in its part and the last word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = _Words(model), _Pairs(model)
        parts, keys, n = [], [], 0

        def flush() -> pa.RecordBatch:
            part, key = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((parts, np.int64), (keys, np.uint64)))
            order = _in_order(part, key)
            part, key = part[order], key[order]
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(part) != 0) | (key[1:] != key[:-1])])) if len(key) else np.zeros(0, np.int64)
            parts.clear(), keys.clear()
            return _rows(part[edge], key[edge], np.diff(np.append(edge, len(key))))

        for batch in batches:
            for _, _, buf, off in slices(batch.column("text")):
                hashes, at = _word_hashes(buf, off)
                known, place = words.ids(hashes)
                ids = np.concatenate([known, [model.words, model.words + 1]])
                before, token, offsets = _sequences(place, at, len(known))
                first, second, pair = _distinct_pairs(before, token, len(ids))
                part, index = pairs.find(ids[first], ids[second])
                index -= pairs.start[part]
                later = np.ones(len(token), bool)
                later[offsets[:-1]] = False
                later = np.flatnonzero(later)  # tokens with two before them, the begin mark included
                parts.append(part[pair[later - 1]])
                keys.append(_key(index[pair[later - 1]], ids[token[later]]))
                n += len(later)
                if n > PENDING:
                    yield flush()
                    n = 0
        yield flush()

    return train.select("text").mapInArrow(count, PACKED)


def _discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and more from the numbers n of items counted 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (max(float(x), 0.5) for x in n)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _discount(counts: np.ndarray, discounts: tuple[float, ...]) -> np.ndarray:
    return np.array((0.0, *discounts))[np.minimum(counts, 3)]


def _counted(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


def _write_counts(folder: str, name: str, part: int, counts: np.ndarray) -> None:
    """Keep the counts that are not one."""
    more = np.flatnonzero(counts != 1)
    write_part(folder, f"{name}-more", part, more.astype(np.uint32))
    write_part(folder, f"{name}-counts", part, counts[more].astype(np.uint32))


def _by_part(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(part, its run) of ascending parts."""
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(edges, [*edges[1:], len(part)]):
        yield int(part[a]), slice(a, b)


def _read_counts(folder: str, name: str, file: np.ndarray, place: np.ndarray, columns: tuple[str, ...] = ("counts",)) -> list[np.ndarray]:
    """The kept columns at places of files, each one where nothing is kept; file ascends."""
    out = [np.ones(len(file), np.int64) for _ in columns]
    for k, run in _by_part(file):
        hit, at = marked(read_part(folder, f"{name}-more", k), place[run])
        for values, column in zip(out, columns):
            values[run][hit] = read_part(folder, f"{name}-{column}", k)[at[hit]]
    return out


def _pieces(kind: int, ids: np.ndarray, columns: tuple[np.ndarray, ...], parts: int, ranges: int) -> list[tuple]:
    """Packed rows of sums by ascending ids, for the ranges of ids."""
    to = ids.astype(np.int64) * parts // ranges
    return [(kind, k, pack(ids[run]), [pack(x[run]) for x in columns], None) for k, run in _by_part(to)]


STATS = "kind int, part int, keys binary, values array<binary>, counted array<long>"
_STATS = ["kind", "part", "keys", "values", "counted"]


def train(docs: DataFrame) -> Model:
    """Count and store the model of all texts of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)
    files = min(parts, max(FILES, -(-parts // FILE_PARTS)))
    folder = new_folder(spark, "kneser-ney")
    vocabulary = materialize(_vocabulary(docs, parts), "vocabulary")
    sizes = {r["part"]: (r["n"], r["total"]) for r in vocabulary.select("part", "n", "total").collect()}  # one row a part
    bounds = [0]
    for k in range(parts):
        bounds.append(bounds[-1] + sizes.get(k, (0, 0))[0])
    documents = docs.count()
    words, tokens = bounds[-1], sum(t for _, t in sizes.values()) + documents
    share = max(1, tokens // (4 * parts))

    def store_words(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        k, c = (unpack(x) for row in pdf[["keys", "counts"]].dropna().itertuples(index=False) for x in row) if pdf["keys"].notna().any() else (np.zeros(0, np.uint64),) * 2
        write_part(folder, "words", part, k)
        write_part(folder, "counts", part, c.astype(np.int64))
        hot = np.flatnonzero(c > share)
        return pd.DataFrame({"id": hot + bounds[part]})

    # every part gets its file, also those without words
    every = spark.range(parts).select(F.col("id").cast("int").alias("part"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("counts"))
    hot = vocabulary.select("part", "keys", "counts").unionByName(every).groupBy("part").applyInPandas(store_words, "id long")
    hot = tuple(sorted(int(r["id"]) for r in hot.collect())) + (words + 1,)  # at most 4 * parts words pass the share
    gather(spark, folder, parts, files, {"words": None, "counts": None})
    model = Model(folder, parts, files, tuple(bounds), words, documents, tokens, hot)
    ranges, begin, edges = words + 2, words + 1, _edges(model)

    def split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)

    def store_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        """Keep the pairs; tell how many different words stand before each word."""
        part = int(pdf["part"].iloc[0])
        pdf = pdf[pdf["keys"].notna()]
        k, c = _merged(pdf) if len(pdf) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        write_keys(folder, "pairs", part, k, heads=edges[part + 1] - edges[part] + len(hot))
        _write_counts(folder, "pair", part, c)
        after, n = np.unique(split(k)[1], return_counts=True)
        return pd.DataFrame([*_pieces(1, after, (n,), parts, ranges), (4, part, None, None, [len(k)])], columns=_STATS)

    pair_sums = _pairs(docs, model).unionByName(every).groupBy("part").applyInPandas(store_pairs, STATS)
    pair_sums = materialize(pair_sums, "pair-sums")

    def starts(sums: DataFrame, kind: int, at: int) -> np.ndarray:
        """The first item of each part, and the number of items, by what the parts have counted."""
        found = {r["part"]: r["n"] for r in sums.where(F.col("kind") == kind).select("part", F.col("counted")[at].alias("n")).collect()}  # a row a part
        return np.cumsum([0, *[found[k] for k in range(parts)]])

    pair_starts = starts(pair_sums, 4, 0)
    gather(spark, folder, parts, files, {"pairs-begin": pair_starts, "pairs-tail": None})
    model = replace(model, pairs=tuple(pair_starts.tolist()))

    def store_triples(pdf: pd.DataFrame) -> pd.DataFrame:
        """Keep the triples and their pairs' sums; tell how many different words stand before each pair."""
        part = int(pdf["part"].iloc[0])
        pdf = pdf[pdf["keys"].notna()]
        k, c = _merged(pdf) if len(pdf) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        pairs_of = _Pairs(model)
        second_of = split(pairs_of.stored(part))[1]
        write_keys(folder, "triples", part, k, heads=len(second_of))
        _write_counts(folder, "triple", part, c)
        pair, last = split(k)
        place, total, *n = merge([pair], [c], [c == 1], [c == 2], [c > 2])
        more = np.flatnonzero(total != 1)
        write_part(folder, "context-more", part, place[more].astype(np.uint32))
        for name, x in zip(("total", "n1", "n2", "n3"), (total, *n)):
            write_part(folder, f"context-{name}", part, x[more].astype(np.uint32))
        middle = second_of[pair.astype(np.int64)]
        pairs, before = np.unique(middle << np.uint64(32) | last, return_counts=True)
        first, second = (x.astype(np.int64) for x in split(pairs))
        to, slot = pairs_of.slot(first, second)
        order = _in_order(to, pairs := _key(slot, second))
        rows = [(0, p, pack(pairs[order[run]]), [pack(before[order[run]])], None) for p, run in _by_part(to[order])]
        return pd.DataFrame([*rows, (2, part, None, None, [*_counted(c), len(k)])], columns=_STATS)

    triple_sums = _triples(docs, model).unionByName(every).groupBy("part").applyInPandas(store_triples, STATS)
    blank = spark.range(parts).selectExpr("9 AS kind", "CAST(id AS INT) AS part", "CAST(NULL AS BINARY) AS keys", "CAST(NULL AS ARRAY<BINARY>) AS values", "CAST(NULL AS ARRAY<BIGINT>) AS counted")

    def store_continuations(pdf: pd.DataFrame) -> pd.DataFrame:
        """Keep each pair's number of words before it; tell the sums of these by the pair's first word."""
        part = int(pdf["part"].iloc[0])
        of_triples = [(3, part, None, None, x) for x in pdf["counted"][pdf["kind"] == 2]]
        pdf = pdf[pdf["kind"] == 0]
        pairs_of = _Pairs(model)
        pairs = pairs_of.stored(part)
        n = np.zeros(len(pairs), np.int64)
        if len(pdf):
            keys, before = merge([unpack(x) for x in pdf["keys"]], [unpack(x[0]) for x in pdf["values"]])
            n[np.searchsorted(pairs, keys)] = before
        first = pairs_of.first(part, split(pairs)[0].astype(np.int64))
        at_begin = first == begin  # nothing precedes the begin mark
        own = np.ones(len(pairs), np.int64)
        own[read_part(folder, "pair-more", part)] = read_part(folder, "pair-counts", part)
        n[at_begin] = own[at_begin]
        _write_counts(folder, "continuation", part, n)
        ids, *sums_ = merge([first.astype(np.uint64)], [n], [n == 1], [n == 2], [n > 2])
        return pd.DataFrame([*_pieces(0, ids, tuple(sums_), parts, ranges), (2, part, None, None, _counted(n)), *of_triples], columns=_STATS)

    merged = triple_sums.unionByName(blank).groupBy("part").applyInPandas(store_continuations, STATS)
    merged = materialize(merged, "continuation-sums")
    of_pairs, of_triples = (_discounts(np.array([r["counted"][:4] for r in merged.where(F.col("kind") == k).select("counted").collect()]).sum(0)) for k in (2, 3))  # a row a part
    triple_starts = starts(merged, 3, 4)
    by_pair = {"context-more": pair_starts, **dict.fromkeys(("context-total", "context-n1", "context-n2", "context-n3")), "continuation-more": pair_starts, "continuation-counts": None}
    gather(spark, folder, parts, files, {**by_pair, "triples-begin": triple_starts, "triples-tail": None, "triple-more": triple_starts, "triple-counts": None})

    def continuation(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        some = pdf[pdf["kind"] == 1]
        return merge([unpack(x) for x in some["keys"]], [unpack(x[0]) for x in some["values"]])

    def sum_continuation(pdf: pd.DataFrame) -> pd.DataFrame:
        _, n = continuation(pdf)
        return pd.DataFrame({"counted": [_counted(n)], "over": [int((n > 2).sum())], "total": [int(n.sum())]})

    sums_ = pair_sums.groupBy("part").applyInPandas(sum_continuation, "counted array<long>, over long, total long").collect()  # a row a part
    counted = np.array([r["counted"] for r in sums_]).sum(0) if sums_ else np.zeros(4)
    all_pairs, over = sum(r["total"] for r in sums_), sum(r["over"] for r in sums_)
    lower = _discounts(counted)
    rest = (lower[0] * counted[0] + lower[1] * counted[1] + lower[2] * over) / all_pairs if all_pairs else 1.0
    unknown = rest / (model.types + 1)

    def store_sums(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        low, n = edges[part], edges[part + 1] - edges[part]
        some = pdf[pdf["kind"] == 0]
        total, left = np.zeros(n, np.int64), np.ones(n)
        if len(some):
            ids, t, n1, n2, n3 = merge([unpack(x) for x in some["keys"]], *([unpack(x[k]) for x in some["values"]] for k in range(4)))
            at = ids.astype(np.int64) - low
            total[at] = t
            left[at] = (of_pairs[0] * n1 + of_pairs[1] * n2 + of_pairs[2] * n3) / t
        p = np.full(n, unknown)
        if (pdf["kind"] == 1).any():
            ids, c = continuation(pdf)
            p[ids.astype(np.int64) - low] += (c - _discount(c, lower)) / all_pairs
        write_part(folder, "totals", part, total)
        write_part(folder, "left", part, left)
        write_part(folder, "unigram", part, p)
        return pd.DataFrame({"part": [part]})

    merged.where("kind = 0").unionByName(pair_sums).unionByName(blank).groupBy("part").applyInPandas(store_sums, "part int").count()
    gather(spark, folder, parts, files, dict.fromkeys(("totals", "left", "unigram")))
    return replace(model, discounts=(of_pairs, of_triples), unknown=unknown)


class Scorer:
    """Log probabilities of rows of text; one per task."""

    def __init__(self, model: Model):
        self.model, self.words, self.pairs = model, _Words(model), _Pairs(model)
        firsts = first_parts(model.parts, model.files)
        self.totals, self.left, self.unigram = (Parts(model.folder, f"all-{name}", _edges(model)[firsts]) for name in ("totals", "left", "unigram"))
        self.counts = Parts(model.folder, "all-counts", np.array(model.bounds)[firsts])

    def _by_id(self, parts: Parts, ids: np.ndarray, default: float) -> np.ndarray:
        """Values at ids that ascend, -1 where unknown."""
        out = np.full(len(ids), default)
        known = ids >= 0
        out[known] = parts.take(ids[known])
        return out

    def __call__(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each row."""
        m = self.model
        hashes, first = _word_hashes(buf, offsets)
        known, place = self.words.ids(hashes)
        # distinct ids: the words, then the end token and the begin mark
        ids = np.concatenate([known, [m.words, m.words + 1]])
        count = np.concatenate([self._by_id(self.counts, known, 0.0), [m.documents, 0]])
        unigram = self._by_id(self.unigram, ids, m.unknown)
        totals, left = self._by_id(self.totals, ids, 0.0), self._by_id(self.left, ids, 1.0)
        before, token, at = _sequences(place, first, len(known))
        # distinct pairs, known ones by file
        u, v, pair = _distinct_pairs(before, token, len(ids))
        p = left[u] * unigram[v]
        index, file = np.full(len(u), -1), np.zeros(len(u), np.int64)
        asked = np.flatnonzero((ids[u] >= 0) & (ids[v] >= 0) & (totals[u] > 0))
        part, index[asked] = self.pairs.find(ids[u[asked]], ids[v[asked]])
        file[asked] = self.pairs.file[part]
        hit = np.flatnonzero(index >= 0)
        hit = hit[by_part(file[hit])]
        if len(hit):
            (c,) = _read_counts(m.folder, "all-continuation", file[hit], index[hit])
            p[hit] += (c - _discount(c, m.discounts[0])) / totals[u[hit]]
        total, rest = np.ones(len(u)), np.ones(len(u))
        if len(hit):
            total[hit], n1, n2, n3 = _read_counts(m.folder, "all-context", file[hit], index[hit], ("total", "n1", "n2", "n3"))
            single = total[hit] == 1  # one follower, seen once
            n2[single] = n3[single] = 0
            d = m.discounts[1]
            rest[hit] = (d[0] * n1 + d[1] * n2 + d[2] * n3) / total[hit]
        p = p[pair]
        # tokens whose two predecessors are a known pair
        later = np.ones(len(token), bool)
        later[at[:-1]] = False
        later = np.flatnonzero(later)
        context = pair[later - 1]
        later, context = later[index[context] >= 0], context[index[context] >= 0]
        if len(later):
            p[later] *= rest[context]
            last = np.flatnonzero(ids[token[later]] >= 0)
            later, context = later[last], context[last]
            order = _in_order(file[context], context * len(ids) + token[later])
            later, context = later[order], context[order]
            found = find_keys(m.folder, "all-triples", file[context], _key(index[context], ids[token[later]]), listed=False)
            later, context, found = (x[found >= 0] for x in (later, context, found))
            (c,) = _read_counts(m.folder, "all-triple", file[context], found)
            p[later] += (c - _discount(c, d)) / total[context]
        base = np.log10((count[token] + 1) / (m.tokens + m.types + 1))
        return np.diff(at), sums(count[token] > 0, at), sums(base, at), sums(np.log10(p), at)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, perplexity of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for a, b, buf, off in slices(batch.column("text")):
                n, known, base, total = scorer(buf, off)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array(known), pa.array(base), pa.array(total), pa.array(10 ** (-total / n))], names)

    names = ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")


def held_out(doc_id: Column) -> Column:
    """Rows that the model does not learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2
