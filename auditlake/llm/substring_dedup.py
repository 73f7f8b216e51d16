"""Removal of word windows that an earlier document holds, by FM-index shards.

A window is ``WINDOW`` consecutive words. Windows are routed by their minimizer, the least
hash of their k-mers, so equal windows meet in one shard; a run of windows with the same
minimizer travels as one segment. Only segments whose minimizer occurs in two documents
travel at all.

A shard concatenates its segments and builds a compressed FM-index: the Burrows-Wheeler
transform of the text's suffixes, ordered by their first WINDOW words, in a wavelet matrix
of packed bits with rank counts. Backward search then streams every segment from right to
left: one step extends the match by the word to the left, and group borders in the suffix
order shorten it again to WINDOW - 1 words, so each window's interval of occurrences costs
one step. The least document of each interval decides; intervals that hold a smaller one
are reported.

Equal segments are merged first and keep their least document, so a passage of many
documents is one segment. A minimizer whose different segments still exceed a part of a
shard is divided: its windows are cut anew by the minimizer of another hash function, which
equal windows share too, and in the end by the windows themselves, so no shard grows with
one frequent phrase.

Word identity is by 64-bit hashes of the words' bytes; a window is compared by all its words.

Defined results: a null text is the empty text, with no words; texts under WINDOW words lose
nothing; only smaller doc_ids count, so repeats inside a document and in rows with equal
doc_ids stay, and a row without a doc_id comes after all others; repeated rows are each
judged; an empty table gives no rows; other columns, whatever their names, are ignored by
``digests`` and kept by ``apply``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import materialize, numbered
from ._text import hash_spans, mix, slices, word_spans

WINDOW = 50
K = 8
#: Rows whose lists are in Python at once.
ROWS = 1000
#: Words of a shard, about.
SHARD_WORDS = 400_000
#: Words of different segments that one minimizer may bring to a shard.
KEY_WORDS = SHARD_WORDS // 4
#: Rounds in which larger ones are cut by another hash function, before single windows.
ROUNDS = 3
_U = np.uint64


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive words."""
    if len(words) < n:
        return np.zeros(0, _U)
    base = 0x9E3779B97F4A7C15 | 1
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(len(words), base, _U)]))
        down = np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(len(words), pow(base, -1, 1 << 64), _U)]))
        total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(words) * up[:-1])])
        return mix((total[n:] - total[:-n]) * down[: len(words) - n + 1])


def segments(words: np.ndarray, turn: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimizer) of each run of windows with one minimizer; turn selects the hash function."""
    n = len(words) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    low = window_hashes(words, K)
    if turn:
        low = mix(low ^ mix(np.array([turn], _U)))
    size, have = WINDOW - K + 1, 1
    while have < size:  # sliding minimum by doubling
        step = min(have, size - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    low = low[:n]
    start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    return start, np.diff(np.append(start, n)), low[start]


class WaveletMatrix:
    """Rank of symbols in prefixes of a sequence, one packed bit vector per bit of a symbol."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.words, self.counts, self.zeros = bits, [], [], []
        for level in reversed(range(bits)):
            bit = (values >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(_U)
            ones = np.bitwise_count(packed).astype(np.int64)
            self.words.append(packed)
            self.counts.append((np.cumsum(ones) - ones).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol before at, plus where the symbol's run begins in the last level."""
        for k, level in enumerate(reversed(range(self.bits))):
            word = at >> 6
            below = self.words[k][word] & ((_U(1) << (at & 63).astype(_U)) - _U(1))
            ones = self.counts[k][word] + np.bitwise_count(below)
            at = np.where(symbol >> level & 1, self.zeros[k] + ones, at - ones)
        return at


class FMIndex:
    """Occurrence intervals of WINDOW words in a shard of segments."""

    def __init__(self, texts: list[np.ndarray], documents: np.ndarray):
        self.symbols, flat = np.unique(np.concatenate(texts), return_inverse=True)
        lens = np.array([len(x) for x in texts])
        self.first = np.concatenate([[0], np.cumsum(lens + 1)])
        n = int(self.first[-1])
        text = np.zeros(n, np.int64)  # 0 ends a segment
        inner = np.ones(n, bool)
        inner[self.first[1:] - 1] = False
        text[inner] = flat + 1
        self.text = text.astype(np.int32)
        rank = text
        have = 1
        while have < WINDOW:  # order suffixes by their first words, doubling them
            step = min(have, WINDOW - have)
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * (n + 2) + after
            order = np.argsort(key, kind="stable")
            rank_new = np.empty(n, np.int64)
            rank_new[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
            rank = rank_new
            have += step
        order = np.argsort(rank, kind="stable")
        new = np.concatenate([[True], np.diff(rank[order]) != 0])
        self.group = (np.cumsum(new) - 1).astype(np.int32)  # of WINDOW words, by place in the order
        # groups of WINDOW - 1 words: a group border where even those differ
        shorter = window_hashes(mix(text.astype(_U) + _U(1)), WINDOW - 1)
        short = np.concatenate([shorter, np.arange(n - len(shorter)).astype(_U)])[order]
        border = np.concatenate([[True], (short[1:] != short[:-1]) & new[1:]])
        self.short_start = np.maximum.accumulate(np.where(border, np.arange(n), 0)).astype(np.int32)
        ends = np.append(np.flatnonzero(border)[1:], n)
        self.short_end = ends[np.cumsum(border) - 1].astype(np.int32)
        bwt = text[order - 1]
        bits = max(1, int(len(self.symbols)).bit_length())
        self.matrix = WaveletMatrix(bwt, bits)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.symbols) + 1))])
        self.base = self.matrix.rank(np.arange(len(self.symbols) + 1), np.zeros(len(self.symbols) + 1, np.int64))
        owner = np.repeat(documents, lens + 1)[order]
        edge = np.flatnonzero(new)
        self.least = np.minimum.reduceat(owner, edge)

    def _step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + match from intervals of match."""
        base = self.before[symbol] - self.base[symbol]
        return base + self.matrix.rank(symbol, low), base + self.matrix.rank(symbol, high)

    def least_documents(self, which: np.ndarray) -> list[np.ndarray]:
        """For each segment, the least document that holds each of its windows."""
        begin, length = self.first[which], np.diff(self.first)[which] - 1
        out = [np.zeros(int(n) - WINDOW + 1, np.int64) for n in length]
        order = np.argsort(-length, kind="stable")
        low = np.zeros(len(which), np.int64)
        high = np.full(len(which), len(self.text), np.int64)
        offset = np.cumsum(length - WINDOW + 1) - (length - WINDOW + 1)
        found = np.zeros(int((length - WINDOW + 1).sum()), np.int64)
        for step in range(1, int(length.max()) + 1 if len(length) else 0):
            live = order[: int(np.searchsorted(-length[order], -step, "right"))]
            at = length[live] - step
            symbol = self.text[begin[live] + at].astype(np.int64)
            l, h = low[live], high[live]
            if step > WINDOW:  # shorten the match by its last word
                l, h = self.short_start[l].astype(np.int64), self.short_end[h - 1].astype(np.int64)
            l, h = self._step(symbol, l, h)
            low[live], high[live] = l, h
            if step >= WINDOW:
                # the interval lies in one group of WINDOW words
                found[offset[live] + at] = self.least[self.group[l]]
        return [found[a : a + len(x)] for a, x in zip(offset, out)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_words, whole_sha256, minimizers): minimizers holds (first, windows, hash) triples."""
    for batch in batches:
        for a, b, buf, off in slices(batch.column("text")):
            starts, ends, first = word_spans(buf, off)
            hashes = hash_spans(buf, starts, ends)
            raw = buf.tobytes()
            sha, lists = [], []
            for k in range(b - a):
                x, y = first[k], first[k + 1]
                sha.append(hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(starts[x:y].tolist(), ends[x:y].tolist())])).hexdigest())
                s, n, m = segments(hashes[x:y])
                lists.append([{"first": int(p), "windows": int(q), "minimizer": r} for p, q, r in zip(s.tolist(), n.tolist(), m.view(np.int64).tolist())])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("windows", pa.int32()), ("minimizer", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(first)), pa.array(sha), pa.array(lists, kind)], ["doc_id", "n_words", "whole_sha256", "segments"])


SCAN = "doc_id long, n_words long, whole_sha256 string, segments array<struct<first:int,windows:int,minimizer:long>>"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)


SEGMENTS = "doc_id long, first int, key long, c1 long, c2 long, words binary"
_SEGMENTS = pa.schema([("doc_id", pa.int64()), ("first", pa.int32()), ("key", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("words", pa.binary())])


def _content(parts: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Two hashes of all the words of each part."""
    flat = np.concatenate(parts).view(np.uint8)
    ends = np.cumsum([8 * len(x) for x in parts])
    starts = np.concatenate([[0], ends[:-1]])
    return tuple(hash_spans(flat, starts, ends, kind).view(np.int64).tolist() for kind in (0, 1))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per wanted segment with its words' hashes."""
    for batch in batches:
        for a, b, buf, off in slices(batch.column("text")):
            starts, ends, first = word_spans(buf, off)
            hashes = hash_spans(buf, starts, ends)
            docs = batch.column("doc_id").slice(a, b - a).to_pylist()
            heads, parts = [], []
            for k, wanted in enumerate(batch.column("wanted").slice(a, b - a).to_pylist()):
                words = hashes[first[k] : first[k + 1]]
                for w in wanted:
                    heads.append((docs[k], w["first"], w["minimizer"]))
                    parts.append(words[w["first"] : w["first"] + w["windows"] + WINDOW - 1])
            if parts:
                yield _batch([(*h, *c, p.tobytes()) for h, *c, p in zip(heads, *_content(parts), parts)], _SEGMENTS)


CUTS = "p1 long, p2 long, first int, key long, c1 long, c2 long, least long, words binary"
_CUTS = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("first", pa.int32()), ("key", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("least", pa.int64()), ("words", pa.binary())])


def _cut(turn: int):
    """Cut segments (c1, c2, key, least, words) by another minimizer, or in the end into their windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                heads, parts = [], []
                for c1, c2, key, least, raw in zip(*(some.column(c).to_pylist() for c in ("c1", "c2", "key", "least", "words"))):
                    words = np.frombuffer(raw, _U)
                    if turn <= ROUNDS:
                        start, n, low = segments(words, turn)
                        keys = mix(low ^ mix(np.array([key], np.int64).view(_U))).view(np.int64)
                    else:
                        start = np.arange(len(words) - WINDOW + 1)
                        n, keys = np.ones(len(start), np.int64), np.zeros(len(start), np.int64)
                    for p, q, k in zip(start.tolist(), n.tolist(), keys.tolist()):
                        heads.append((c1, c2, p, k))
                        parts.append((least, words[p : p + q + WINDOW - 1]))
                if parts:
                    content = _content([p for _, p in parts])
                    yield _batch([(*h, *c, least, p.tobytes()) for h, *c, (least, p) in zip(heads, *content, parts)], _CUTS)

    return cut


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    """Build the shard's index and stream its segments: (content, least documents per window)."""
    pdf = pdf.sort_values(["least", "c1", "c2"], ignore_index=True)
    texts = [np.frombuffer(x, _U) for x in pdf["words"]]
    index = FMIndex(texts, pdf["least"].to_numpy())
    found = index.least_documents(np.arange(len(texts)))
    return pd.DataFrame({"c1": pdf["c1"], "c2": pdf["c2"], "sources": found})


def _merged(rows: DataFrame, doc: str) -> DataFrame:
    """Equal segments as one, with their least document."""
    return materialize(rows.groupBy("c1", "c2").agg(F.min(doc).alias("least"), F.min("key").alias("key"), F.min("words").alias("words")), "distinct-segments")


def _answers(merged: DataFrame, turn: int = 1) -> DataFrame:
    """(c1, c2, sources): for each window of a segment the least document that holds it."""
    if turn > ROUNDS + 1:  # single windows: the merging has found them
        return merged.select("c1", "c2", F.array("least").alias("sources"))
    size = F.sum(F.length("words")).alias("size")
    large = materialize(merged.groupBy("key").agg(size).where(F.col("size") > 8 * KEY_WORDS).select("key"), "large-keys")
    rest, back = merged, None
    if not large.isEmpty():
        rest = merged.join(large, "key", "left_anti")
        cuts = materialize(merged.join(large, "key", "left_semi").mapInArrow(_cut(turn), CUTS), "cuts")
        below = _answers(_merged(cuts, "least"), turn + 1)
        told = cuts.select("p1", "p2", "first", "c1", "c2").join(below, ["c1", "c2"])
        parts = F.sort_array(F.collect_list(F.struct("first", "sources")))
        back = told.groupBy("p1", "p2").agg(F.flatten(F.transform(parts, lambda x: x["sources"])).alias("sources"))
        back = back.withColumnsRenamed({"p1": "c1", "p2": "c2"})
    spark = merged.sparkSession
    total = rest.agg(F.sum(F.length("words"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (8 * SHARD_WORDS) + 1)
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    found = rest.select(shard, "c1", "c2", "least", "words").groupBy("shard").applyInPandas(_search, "c1 long, c2 long, sources array<long>")
    return materialize(found if back is None else found.unionByName(back), "statistics")


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, low, high): runs of windows that a smaller document than own holds."""
    for batch in batches:
        doc, own, first, lists = (batch.column(c) for c in ("doc_id", "own", "first", "sources"))
        doc, own, first = doc.to_numpy(), own.to_numpy(), first.to_numpy().astype(np.int64)
        off = lists.offsets.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(doc)), np.diff(off))
        sources = lists.values.to_numpy()[off[0] : off[-1]]
        hit = np.flatnonzero(sources < own[row])
        if len(hit):
            at = first[row[hit]] + hit - (off[row[hit]] - off[0])
            edge = np.flatnonzero((np.diff(hit, prepend=-2) != 1) | (np.diff(row[hit], prepend=-1) != 0))
            last = np.append(edge[1:], len(hit)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(doc[row[hit[edge]]]), pa.array(at[edge], pa.int32()), pa.array(at[last] + WINDOW, pa.int32())], ["doc_id", "low", "high"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of the reported runs."""
    for batch in batches:
        for a, b, buf, off in slices(batch.column("text")):
            starts, ends, first = word_spans(buf, off)
            raw = buf.tobytes()
            docs = batch.column("doc_id").slice(a, b - a).to_pylist()
            out = []
            for k, spans in enumerate(batch.column("spans").slice(a, b - a).to_pylist()):
                s, e = starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]]
                mark = np.zeros(len(s) + 1, np.int64)
                for x in spans:
                    mark[x["low"]] += 1
                    mark[x["high"]] -= 1
                keep = np.flatnonzero(np.cumsum(mark)[:-1] == 0)
                kept = b" ".join([raw[p:q] for p, q in zip(s[keep].tolist(), e[keep].tolist())])
                till = np.append(s[1:], off[k + 1])  # a kept word brings the white space after it
                pieces = [raw[p:q] for p, q in zip(s[keep].tolist(), till[keep].tolist())]
                lead = raw[off[k] : s[0]] if len(s) else b""
                out.append((docs[k], len(s), len(s) - len(keep), hashlib.sha256(kept).hexdigest(), (lead + b"".join(pieces)).decode()))
            yield _batch(out, _FINISH)


FINISH = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"
_FINISH = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])


def removals(docs: DataFrame, firsts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of all documents as scanned, rows (FINISH) of the documents that lose words).

    docs has unique doc_ids and texts; firsts, if given, has (doc_id, own), the least of the doc_ids that are one document's.
    """
    scanned = materialize(docs.select("doc_id", "text").mapInArrow(_scan, SCAN), "scan")
    each = scanned.select("doc_id", F.inline("segments"))
    shared = each.groupBy("minimizer").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    wanted = each.join(shared.select("minimizer"), "minimizer").groupBy("doc_id").agg(F.collect_list(F.struct("first", "windows", "minimizer")).alias("wanted"))
    texts = materialize(docs.join(wanted.hint("merge"), "doc_id"), "sharing")  # the same plan at every size
    found = materialize(texts.mapInArrow(_extract, SEGMENTS), "segments")
    told = found.select("doc_id", "first", "c1", "c2").join(_answers(_merged(found, "doc_id")), ["c1", "c2"])
    told = told.withColumn("own", F.col("doc_id")) if firsts is None else told.join(firsts, "doc_id")
    runs = told.select("doc_id", "own", "first", "sources").mapInArrow(_report, "doc_id long, low int, high int")
    spans = runs.groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return scanned, texts.select("doc_id", "text").join(spans, "doc_id").mapInArrow(_finish, FINISH)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs."""
    own = numbered(docs)
    scanned, changed = removals(own.rows.select(F.col("number").alias("doc_id"), "text"), own.firsts)
    changed = changed.select("doc_id", "n_removed", "kept_sha256")
    out = scanned.select("doc_id", "n_words", "whole_sha256").join(changed, "doc_id", "left")
    return own.named(out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256")), "doc_id")


def apply(docs: DataFrame) -> DataFrame:
    """docs with the reported words removed from text; other columns stay, n_chars follows the text."""
    own = numbered(docs)
    _, changed = removals(own.rows.select(F.col("number").alias("doc_id"), "text"), own.firsts)
    changed = changed.select(F.col("doc_id").alias("number"), F.col("text").alias("less"))
    out = own.rows.drop("text").join(changed, "number", "left")
    less = {"text": F.col("less"), "n_chars": F.length("less").cast("long")}
    old = lambda c: F.col("row")[c]
    return out.select(*[F.when(F.col("less").isNotNull(), less[c]).otherwise(old(c)).alias(c) if c in less else old(c).alias(c) for c in docs.columns])
