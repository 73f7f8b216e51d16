"""Periodic runs of words by Baier grouping, and texts without their repetitions.

A run is a stretch of words with smallest period q whose words q apart are identical, as long
as it can be, of at least ``LEAST`` words and ``EXPONENT`` periods. Every run holds a Lyndon
word of length q that is the longest Lyndon word from its place, under the order of the words
or under the reverse order. The first phase of Baier's suffix sorter groups suffixes by just
those words: groups are taken from the greatest down, and each lengthens the groups of the
nearest smaller suffixes before its members. So one pass under either order yields a Lyndon
array; each entry is a root, which is extended to both sides by longest common extensions, and
roots that extend far enough are runs.

Grouping touches only what can lie in a run: within one, each ``GRAM`` consecutive words come
again one period later, so stretches whose word groups do not come again within reach are set
aside before, which loses no run. Extensions are found by hashes and then compared word by word.

Each document is worked on alone, so nothing is shuffled and nothing depends on partitions. A
worker's memory is bounded by one slice of texts, or one document, and by about 200 bytes a word
of the longest stretch.

Defined results: a null or empty text has no words and no runs; repeated rows and rows without a
doc_id get their own results; an empty table gives no rows; columns other than doc_id and text
are ignored by ``digests`` and ``runs`` and kept by ``collapse``, which leaves texts without runs
as they are. Words are equal if two 64-bit hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import hash_spans, mix, ragged, slices, word_spans

#: Words and periods of a run, at least.
LEAST, EXPONENT = 6, 4
#: Most words of a group whose return marks what can lie in a run.
GRAM = 5
#: Words that are grouped at once, unless one stretch has more.
BATCH = 1 << 16
#: Rounds in which marks without reach are taken away; more would only save work.
_ROUNDS = 16

_U = np.uint64


@dataclass(frozen=True)
class Runs:
    """Runs in the order of row, start and period; start counts words of the row."""

    row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def lyndon_lengths(codes: list[int]) -> list[int]:
    """Length of the longest Lyndon word from each place, by Baier grouping; code 0 parts texts and gets 0.

    A group holds suffixes with one common start, its context. Members of groups that are done
    are linked to the left, so following links leads to the nearest suffix of a smaller group.
    """
    n = len(codes)
    members: list[list[int]] = [[] for _ in range(max(codes, default=0) + 1)]
    for i, c in enumerate(codes):
        members[c].append(i)
    group = list(codes)
    size = [len(m) for m in members]
    length = [1] * len(members)
    above = list(range(1, len(members) + 1))
    below = list(range(-1, len(members) - 1))
    link = list(range(n))
    out = [0] * n
    g = len(members) - 1
    while g > 0:
        own = [s for s in members[g] if group[s] == g]
        u = length[g]
        for s in own:
            out[s] = u
            link[s] = s - 1
        hits: dict[int, int] = {}
        for s in own:
            p = s - 1
            while p >= 0 and link[p] != p:
                up = link[p]
                if up >= 0:
                    link[p] = up = link[up]
                p = up
            link[s] = p
            if p >= 0 and codes[p]:
                hits[p] = hits.get(p, 0) + 1
        times: dict[int, dict[int, list[int]]] = {}
        for p, k in hits.items():
            times.setdefault(k, {}).setdefault(group[p], []).append(p)
        for k in sorted(times, reverse=True):
            for low, moved in times[k].items():
                if len(moved) == size[low]:
                    length[low] += k * u
                    continue
                new = len(members)
                for p in moved:
                    group[p] = new
                members.append(moved)
                size[low] -= len(moved)
                size.append(len(moved))
                length.append(length[low] + k * u)
                top = above[low]
                above.append(top)
                below.append(low)
                above[low] = new
                if top < new:
                    below[top] = new
        members[g] = []
        g = below[g]
    return out


def _reach(count: np.ndarray, gram: int, exponent: int) -> np.ndarray:
    """The longest period of a run with so many marked words in a row."""
    return (count + gram - 1) // (exponent - 1)


def _gram(least: int, exponent: int) -> int:
    return min(GRAM, *(max(least, exponent * q) - q for q in range(1, least + 1)))


def _stretches(words: np.ndarray, first: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the word ranges that can hold runs, each within one row, with one word more behind."""
    gram, n = _gram(least, exponent), len(words)
    none = np.zeros(0, np.int64)
    if n <= gram:
        return none, none
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][row]
    at = np.flatnonzero(np.arange(n) + gram <= end)
    key = mix(row[at].astype(_U) + _U(1))
    with np.errstate(over="ignore"):
        for k in range(gram):
            key = mix(key * _U(0x9E3779B97F4A7C15) + words[at + k])
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    marked = at[order[again]]
    far = at[order[again + 1]] - marked
    sort = np.argsort(marked)
    marked, far = marked[sort], far[sort]
    for _ in range(_ROUNDS):
        if not len(marked):
            return none, none
        edge = np.flatnonzero((np.diff(marked, prepend=-2) != 1) | (np.diff(row[marked], prepend=-1) != 0))
        count = np.diff(np.append(edge, len(marked)))
        near = far <= np.repeat(_reach(count, gram, exponent), count)
        if near.all():
            break
        marked, far = marked[near], far[near]
    if not len(marked):
        return none, none
    edge = np.flatnonzero((np.diff(marked, prepend=-2) != 1) | (np.diff(row[marked], prepend=-1) != 0))
    count = np.diff(np.append(edge, len(marked)))
    begin = marked[edge]
    till = np.minimum(begin + count + _reach(count, gram, exponent) + gram, end[begin])
    while len(begin) > 1 and (joined := (begin[1:] <= till[:-1]) & (row[begin[1:]] == row[begin[:-1]])).any():
        apart = np.concatenate([[True], ~joined])
        till = np.maximum.reduceat(till, np.flatnonzero(apart))
        begin = begin[apart]
    return begin, till


def _common(total: np.ndarray, powers: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many items agree from i and j on (step 1) or before them (step -1), at most most; i < j."""
    low, high = np.zeros(len(i), np.int64), most.copy()
    scale = powers[j - i]
    with np.errstate(over="ignore"):
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            a, b = (i, j) if step > 0 else (i - mid, j - mid)
            same = (total[a + mid] - total[a]) * scale == total[b + mid] - total[b]
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)
    return low


def _direct(codes: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """Begin and end of the stretch of period p around i, word by word."""
    low, high = i, i + p
    while low > 0 and codes[low - 1] and codes[low - 1] == codes[low - 1 + p]:
        low -= 1
    while high < len(codes) and codes[high] and codes[high] == codes[high - p]:
        high += 1
    return low, high


def _search(codes: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(begin, length, period) of the runs of codes, in which 0 parts texts."""
    n = len(codes)
    values = mix(codes.astype(_U) * _U(2) + _U(1))
    gaps = np.flatnonzero(codes == 0)
    values[gaps] = mix(np.arange(len(gaps), dtype=_U) * _U(2))
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(n, _U(0x9E3779B97F4A7C15))]))
        total = np.concatenate([np.zeros(1, _U), np.cumsum(values * powers[:n])])
    found: dict[tuple[int, int], tuple[int, int]] = {}
    top = int(codes.max()) + 1
    for ordered in (codes, np.where(codes > 0, top - codes, 0)):
        p = np.array(lyndon_lengths(ordered.tolist()), np.int64)
        i = np.flatnonzero((p > 0) & (np.arange(n) + p < n))
        p = p[i]
        after = _common(total, powers, i, i + p, n - i - p, 1)
        before = _common(total, powers, i, i + p, i, -1)
        length = before + p + after
        long = np.flatnonzero(length >= np.maximum(least, exponent * p))
        for k in long.tolist():
            found.setdefault((int(i[k] - before[k]), int(p[k])), (int(i[k]), int(length[k])))
    out = []
    for (begin, p), (i, length) in found.items():
        if not np.array_equal(codes[begin : begin + length - p], codes[begin + p : begin + length]):  # two hashes met
            begin, end = _direct(codes, i, p)
            length = end - begin
            if length < max(least, exponent * p):
                continue
        out.append((begin, length, p))
    return sorted(set(out))


def _codes(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Numbers from 1 for the words of two hashes."""
    _, index, code = np.unique(one, return_index=True, return_inverse=True)
    if (two[index][code] != two).any():  # equal in the first hash only
        _, code = np.unique(np.column_stack([one, two]), axis=0, return_inverse=True)
    return code.reshape(-1) + 1


def find(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> Runs:
    """The runs of rows whose words are the spans starts to ends of buf; row k has those from first[k] to first[k + 1]."""
    begin, till = _stretches(hash_spans(buf, starts, ends), first, least, exponent)
    got: list[tuple[int, int, int]] = []
    at = 0
    while at < len(begin):
        upto = at + max(1, int(np.searchsorted(np.cumsum(till[at:] - begin[at:]), BATCH, "right")))
        b, size = begin[at:upto], till[at:upto] - begin[at:upto]
        word = ragged(np.arange(len(starts)), b, size)
        code = _codes(*(hash_spans(buf, starts[word], ends[word], kind) for kind in (0, 1)))
        place = np.cumsum(size + 1) - size - 1  # of each stretch, which a zero ends
        codes = np.zeros(int(place[-1] + size[-1] + 1), np.int64)
        codes[ragged(np.arange(len(codes)), place, size)] = code
        for x, length, p in _search(codes, least, exponent):
            k = int(np.searchsorted(place, x, "right")) - 1
            got.append((int(b[k]) + x - int(place[k]), length, p))
        at = upto
    got.sort(key=lambda x: (x[0], x[2]))
    start, length, period = np.array(got, np.int64).reshape(-1, 3).T
    row = np.searchsorted(first, start, "right") - 1
    return Runs(row, start - first[row], length, period)


def _dropped(found: Runs, first: np.ndarray) -> np.ndarray:
    """Whether a run holds each word after its first period."""
    mark = np.zeros(int(first[-1]) + 1, np.int64)
    at = first[found.row] + found.start
    np.add.at(mark, at + found.period, 1)
    np.add.at(mark, at + found.length, -1)
    return np.cumsum(mark)[:-1] > 0


_DIGESTS = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "n_runs", "start", "length", "period", "exponent_milli")], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, off in slices(batch.column("text")):
            starts, ends, first = word_spans(buf, off)
            found = find(buf, starts, ends, first)
            kept = np.flatnonzero(~_dropped(found, first))
            size = ends[kept] - starts[kept] + 1  # with what follows, white space or the row's end
            blank = np.append(np.where((buf == 0x20) | (buf - 9 < 5), np.uint8(0x20), buf), np.uint8(0x20))
            joined = memoryview(ragged(blank, starts[kept], size))
            cut = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(kept, first)]
            of = np.searchsorted(found.row, np.arange(b - a + 1))
            rows = []
            for k in range(b - a):
                own = list(zip(*(x[of[k] : of[k + 1]].tolist() for x in (found.start, found.length, found.period))))
                told = "".join(f"{s},{n},{p}\n" for s, n, p in own).encode()
                s, n, p = min(own, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
                text = joined[cut[k] : max(cut[k], cut[k + 1] - 1)]
                rows.append((int(first[k + 1] - first[k]), len(own), s, n, p, 1000 * n // p if own else None, hashlib.sha256(told).hexdigest(), hashlib.sha256(text).hexdigest()))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(_DIGESTS)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *columns], schema=_DIGESTS)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_runs, the longest run (start, length, period, exponent_milli; of equal ones the first, then the shortest period), runs_sha256 and collapsed_sha256 of every row."""
    schema = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_digest, schema)


def runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, start (word number from 0), length and period of every run."""
    if exponent < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in slices(batch.column("text")):
                found = find(buf, *word_spans(buf, off), least, exponent)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).take(pa.array(found.row)), *map(pa.array, (found.start, found.length, found.period))], ["doc_id", "start", "length", "period"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, start long, length long, period long")


def _collapsed(column: pa.Array) -> pa.Array:
    """The texts, those with runs without the words after each run's first period and the white space behind them."""
    out: list[bytes | None] = []
    for a, b, buf, off in slices(column):
        starts, ends, first = word_spans(buf, off)
        gone = _dropped(find(buf, starts, ends, first), first)
        till = np.append(starts[1:], len(buf))
        last = first[1:][np.diff(first) > 0] - 1
        till[last] = off[1:][np.diff(first) > 0]
        mark = np.zeros(len(buf) + 1, np.int64)
        mark[starts[gone]] += 1
        np.add.at(mark, till[gone], -1)
        kept = np.cumsum(mark)[:-1] == 0
        cut = np.concatenate([[0], np.cumsum(kept)])[off]
        raw = buf[kept].tobytes()
        out += [raw[p:q] for p, q in zip(cut[:-1].tolist(), cut[1:].tolist())]
    valid = column.is_valid().to_pylist()
    return pa.array([x.decode() if ok else None for x, ok in zip(out, valid)], pa.string())


def collapse(docs: DataFrame) -> DataFrame:
    """docs with every run cut to its first period; all columns stay."""
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = _collapsed(columns[at])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(rows, docs.withColumn("text", F.col("text").cast("string")).schema)


def with_tails(doc_id: Column, text: Column) -> Column:
    """The text of which, for a tenth of the ids, a tail of words repeats with one period; ids and lengths decide where and how often."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + F.pmod(i - a, p)).cast("int")))), " ")

    return F.when(F.pmod(h, F.lit(10)) == 0, F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(text))[0]).otherwise(text)
