"""Byte-level BPE by merge replay over the corpus's table of distinct words, and decoding.

Every task sends the distinct words of its documents once, packed by hash range. Each range
is a part of one corpus-wide word table and is replayed once: an inverted index maps each
token pair's rank to the positions where it stands, and the merges present are applied in
rank order to all their positions at once; only the two touched neighbours are entered anew.
The ranges are stored as sorted hash arrays with their ids in the shared folder, workers map
them, and every document gathers its words' ids without another shuffle.

A word of the table is a chunk of the text that no match of the pattern crosses, of at most
``LONG`` bytes; longer ones hardly repeat and are replayed where they stand, as is a word
whose two hashes do not both agree with the table. The number of ranges follows the bytes
of the corpus, so a range is bounded even if no word repeats.

Defined results: a null text is the empty text and has no ids; repeated rows are encoded
alike, rows without a doc_id too; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import new_folder
from ._store import find_sorted, range_of, read_part, squeeze, unsqueeze, write_part
from ._text import HashTable, chunk_spans, hash_spans, ragged, slices, sums

#: Distinct chunks of one replay, about; bounds its arrays.
REPLAY = 150_000
#: Bytes of a chunk that enters the table.
LONG = 64
#: Bytes of texts for each range of the table.
RANGE_BYTES = 64 << 20
#: Distinct chunks, and their bytes, that a task holds before it sends them.
PENDING, PENDING_BYTES = 1_000_000, 16 << 20
#: Hashes that a task remembers as sent.
SENT = 3_000_000
NONE = np.iinfo(np.int32).max


class Ranks:
    """A rank file: bytes of each id, and the rank of every pair of ids whose bytes make an id."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        size = max(self.rank.values()) + 1
        token = [b""] * size
        for raw, r in self.rank.items():
            token[r] = raw
        self.length = np.fromiter(map(len, token), np.int64, size)
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(token), np.uint8)
        decimal = [f"{r} ".encode() for r in range(size)]
        self.text_length = np.fromiter(map(len, decimal), np.int64, size)
        self.text_begin = np.cumsum(self.text_length) - self.text_length
        self.text_flat = np.frombuffer(b"".join(decimal), np.uint8)
        self.byte = np.full(256, -1, np.int32)
        pairs = {}
        get = self.rank.get
        for raw, r in self.rank.items():
            if len(raw) == 1:
                self.byte[raw[0]] = r
            for k in range(1, len(raw)):
                if (a := get(raw[:k])) is not None and (b := get(raw[k:])) is not None:
                    pairs[a << 32 | b] = r
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.merged = np.fromiter(pairs.values(), np.int32, len(pairs))[order]

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where they do not merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        return ragged(self.flat, self.begin[ids], self.length[ids])


def replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, number of each) after every merge that applies, in rank order."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    token = ranks.byte[np.frombuffer(b"".join(words), np.uint8)]
    n = len(token)
    if not n:
        return np.zeros(0, np.int32), lens
    if (token < 0).any():
        raise ValueError("a byte has no rank")
    ends = np.cumsum(lens)
    after = np.arange(1, n + 1, dtype=np.int32)
    after[ends[lens > 0] - 1] = -1
    before = np.arange(-1, n - 1, dtype=np.int32)
    before[(ends - lens)[lens > 0]] = -1
    current = np.full(n, NONE, np.int32)
    inner = np.flatnonzero(after >= 0)
    current[inner] = ranks.of_pairs(token[inner], token[after[inner]])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(positions: np.ndarray) -> None:
        """Put positions under their pair's rank."""
        rank = current[positions]
        positions, rank = positions[rank < NONE], rank[rank < NONE]
        if not len(rank):
            return
        order = np.argsort(rank, kind="stable")
        positions, rank = positions[order], rank[order]
        edges = np.flatnonzero(np.diff(rank, prepend=-1))
        for r, a, b in zip(rank[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(rank)]):
            if r in index:
                index[r].append(positions[a:b])
            else:
                index[r] = [positions[a:b]]
                heappush(heap, r)

    enter(inner)
    alive = np.ones(n, bool)
    while heap:
        r = heappop(heap)
        found = index.pop(r)
        at = found[0] if len(found) == 1 else np.concatenate(found)
        at = np.unique(at[(current[at] == r) & alive[at]])
        if not len(at):
            continue
        if len(at) > 1:
            chained = after[at[:-1]] == at[1:]
            if chained.any():  # overlapping pairs: the left one of each two goes first
                keep = np.ones(len(at), bool)
                for k in np.flatnonzero(chained).tolist():
                    keep[k + 1] = not keep[k]
                at = at[keep]
        gone = after[at]
        follow = after[gone]
        token[at] = r
        alive[gone] = False
        current[gone] = NONE
        after[at] = follow
        has = follow >= 0
        before[follow[has]] = at[has]
        current[at] = NONE
        current[at[has]] = ranks.of_pairs(token[at[has]], token[follow[has]])
        left = before[at]
        left = left[left >= 0]
        current[left] = ranks.of_pairs(token[left], token[after[left]])
        enter(np.concatenate([at[has], left]))
    return token[alive], sums(alive, np.concatenate([[0], ends]))


_known: dict[tuple[str, str], Words] = {}


class Words:
    """Replays chunks of texts under a rank file and a pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks, self.split = Ranks(path), regex.compile(pattern).findall

    @classmethod
    def of(cls, path: str, pattern: str) -> Words:
        """The worker's own."""
        if (path, pattern) not in _known:
            _known[path, pattern] = cls(path, pattern)
        return _known[path, pattern]

    def replay(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, number of each); a match of the pattern that several hold is replayed once."""
        number: dict[str, int] = {}
        parts = [[number.setdefault(w, len(number)) for w in self.split(c.decode())] for c in chunks]
        ids, lens = replay([w.encode() for w in number], self.ranks)
        begin = np.cumsum(lens) - lens
        flat = np.fromiter((k for p in parts for k in p), np.int64)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        return ragged(ids, begin[flat], lens[flat]), sums(lens[flat], np.concatenate([[0], np.cumsum(size)]))


def _send(parts: int):
    """(part, size, chunks): the distinct chunks of a task's texts, by range of their hashes."""

    def flush(hashes: list[np.ndarray], chunks: list[bytes]) -> pa.RecordBatch:
        part = range_of(np.concatenate(hashes), parts)
        order = np.argsort(part, kind="stable")
        edges = np.flatnonzero(np.diff(part[order], prepend=-1))
        rows = []
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)]):
            own = sorted(chunks[k] for k in order[a:b].tolist())
            raw = bytes([len(c) for c in own]) + b"".join(own)
            rows.append((int(part[order[a]]), len(own), len(raw), squeeze(raw)))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["part", "n", "size", "chunks"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, hashes, chunks, size = HashTable(), [], [], 0
        for batch in batches:
            for _, _, buf, off in slices(batch.column("text")):
                starts, ends, _ = chunk_spans(buf, off)
                short = np.flatnonzero(ends - starts <= LONG)
                h = hash_spans(buf, starts[short], ends[short])
                own, first = np.unique(h, return_index=True)
                new = sent.find(own) < 0
                own, first = own[new & (own != 0)], short[first[new & (own != 0)]]
                if sent.n > SENT:
                    sent = HashTable()
                sent.add(own, np.zeros(len(own), np.int32))
                raw = buf.tobytes()
                hashes.append(own)
                more = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
                chunks += more
                size += sum(map(len, more))
                if len(chunks) > PENDING or size > PENDING_BYTES:
                    yield flush(hashes, chunks)
                    hashes, chunks, size = [], [], 0
        if chunks:
            yield flush(hashes, chunks)

    return send


def store_words(docs: DataFrame, path: str, pattern: str) -> tuple[str, int]:
    """Replay the distinct chunks of all texts of docs into a table; its folder and number of parts."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES + 1)
    folder = new_folder(spark, "bpe-words")

    def store(pdf: pd.DataFrame) -> pd.DataFrame:
        part, words = int(pdf["part"].iloc[0]), Words.of(path, pattern)
        distinct: dict[bytes, None] = {}
        for n, size, packed in pdf[["n", "size", "chunks"]].dropna().itertuples(index=False):
            raw = unsqueeze(packed, int(size))
            ends = (int(n) + np.cumsum(np.frombuffer(raw[: int(n)], np.uint8), dtype=np.int64)).tolist()
            distinct.update((raw[a:b], None) for a, b in zip([int(n), *ends[:-1]], ends))
        chunks = list(distinct)
        flat = np.frombuffer(b"".join(chunks), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        keys, pick = np.unique(hash_spans(flat, starts, ends), return_index=True)
        chunks = [chunks[k] for k in pick.tolist()]
        told = [words.replay(chunks[a : a + REPLAY]) for a in range(0, len(chunks), REPLAY)]
        ids, lens = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*told) if told else ((), ())))
        write_part(folder, "keys", part, keys)
        write_part(folder, "checks", part, hash_spans(flat, starts[pick], ends[pick], 1))
        write_part(folder, "firsts", part, np.concatenate([[0], np.cumsum(lens)]).astype(np.uint32))
        write_part(folder, "ids", part, ids.astype(np.uint16 if len(words.ranks.length) <= 1 << 16 else np.uint32))
        return pd.DataFrame({"part": [part]})

    sent = docs.select("text").mapInArrow(_send(parts), "part int, n int, size long, chunks binary")
    every = spark.range(parts).select(F.col("id").cast("int").alias("part"))  # a part without words gets its files too
    sent.unionByName(every, allowMissingColumns=True).groupBy("part").applyInPandas(store, "part int").count()
    return folder, parts


def _gather(words: Words, folder: str, parts: int, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the rows, one after another, and the number of each row."""
    starts, ends, first = chunk_spans(buf, off)
    hashes, pick, place = np.unique(hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
    check = hash_spans(buf, starts, ends, 1)
    part = range_of(hashes, parts)
    found = find_sorted(folder, "keys", part, hashes)
    begin, length, flat, used = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64), [], 0
    for k in np.unique(part[found >= 0]).tolist():
        own = np.flatnonzero((part == k) & (found >= 0))
        agrees = read_part(folder, "checks", k)[found[own]] == check[pick[own]]
        found[own[~agrees]] = -1
        own = own[agrees]
        firsts = read_part(folder, "firsts", k)
        a, b = firsts[found[own]].astype(np.int64), firsts[found[own] + 1].astype(np.int64)
        flat.append(ragged(read_part(folder, "ids", k), a, b - a).astype(np.int64))
        length[own] = b - a
        begin[own] = used + np.cumsum(b - a) - (b - a)
        used += len(flat[-1])
    # what the table does not hold, and occurrences whose second hash differs from their word's
    odd = np.flatnonzero((found < 0)[place] | (check != check[pick][place]))
    raw = buf.tobytes()
    fresh: dict[bytes, int] = {}
    which = [fresh.setdefault(raw[a:b], len(fresh)) for a, b in zip(starts[odd].tolist(), ends[odd].tolist())]
    begin, length = begin[place], length[place]
    if fresh:
        ids, lens = words.replay(list(fresh))
        flat.append(ids.astype(np.int64))
        begin[odd], length[odd] = (used + np.cumsum(lens) - lens)[which], lens[which]
    return ragged(np.concatenate([np.zeros(0, np.int64), *flat]), begin, length), sums(length, first)


def encode(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) with ids array<int>; with digests, the hashes of ids and decoded bytes instead.

    pattern must be one whose matches never join a blank or line feed to the characters before it,
    as the public GPT-like patterns are, and which ends a run of letters before punctuation.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    folder, parts = store_words(docs, path, pattern)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words.of(path, pattern)
        for batch in batches:
            names = batch.column("doc_id")
            for a, b, buf, off in slices(batch.column("text")):
                ids, counts = _gather(words, folder, parts, buf, off)
                at = np.concatenate([[0], np.cumsum(counts)])
                out = [names.slice(a, b - a), pa.array(counts)]
                if digests:
                    out += _digests(words.ranks, ids, at)
                else:
                    out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(out, columns)

    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids"]
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>")
    return docs.mapInArrow(rows, schema)


def _digests(ranks: Ranks, ids: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    written = ragged(ranks.text_flat, ranks.text_begin[ids], ranks.text_length[ids]).tobytes()
    ends = np.concatenate([[0], np.cumsum(ranks.text_length[ids])])[at]
    decoded = ranks.decode(ids).tobytes()
    stops = np.concatenate([[0], np.cumsum(ranks.length[ids])])[at]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return [
        pa.array([sha(written[a : max(a, b - 1)]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]),
        pa.array([sha(decoded[a:b]) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]),
    ]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes) of encode()'s rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(path)
        for batch in batches:
            lists = batch.column("ids")
            raw = [ranks.decode(np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64)).tobytes() if len(x) else b"" for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, bytes binary")
