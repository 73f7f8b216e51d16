"""Sorted arrays in the shared folder, written by tasks as parts and memory-mapped by workers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession

from ._scratch import local_view

_codec = pa.Codec("zstd", 1)


def pack(values: np.ndarray) -> bytes:
    """A compact form of an integer array; sorted ones are kept as differences, of long ones in the upper half only."""
    values = values.astype(np.uint64)
    form = 0
    if len(values) > 1 and bool((values[1:] >= values[:-1]).all()):
        form = 2 if values[-1] >> np.uint64(32) else 1
    if form == 1:
        values = np.diff(values, prepend=np.uint64(0))
    elif form == 2:
        high = values >> np.uint64(32)
        values = np.diff(high, prepend=np.uint64(0)) << np.uint64(32) | values & np.uint64(0xFFFFFFFF)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    return bytes([form]) + len(values).to_bytes(8, "little") + _codec.compress(planes.tobytes(), asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[1:9], "little")
    planes = np.frombuffer(_codec.decompress(raw[9:], 8 * n, asbytes=True), np.uint8).reshape(8, n)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)
    if raw[0] == 1:
        return np.cumsum(values, dtype=np.uint64)
    if raw[0] == 2:
        return np.cumsum(values >> np.uint64(32), dtype=np.uint64) << np.uint64(32) | values & np.uint64(0xFFFFFFFF)
    return values


def squeeze(raw: bytes) -> bytes:
    return _codec.compress(raw, asbytes=True)


def unsqueeze(raw: bytes, size: int) -> bytes:
    return _codec.decompress(raw, size, asbytes=True)


def merge(keys: list[np.ndarray], *columns: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys and the sums of each column."""
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    if not len(key):
        return key, *[np.zeros(0, np.int64) for _ in columns]
    order = np.argsort(key, kind="stable")
    key = key[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[edge], *[np.add.reduceat(np.concatenate(c).astype(np.int64)[order], edge) for c in columns]


@contextlib.contextmanager
def _written(path: str) -> Iterator[BinaryIO]:
    """A stream to a new file; a repeated task replaces the file by the same bytes."""
    if local := local_view(path):
        os.makedirs(os.path.dirname(local), exist_ok=True)
        draft = f"{local}.{uuid.uuid4().hex}"
        with open(draft, "wb") as out:
            yield out
        os.replace(draft, local)
        return
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(os.path.dirname(inner), recursive=True)
    with fs.open_output_stream(inner) as out:
        yield out


def write_part(folder: str, name: str, part: int, values: np.ndarray) -> None:
    """Write one part; a repeated task replaces it by the same bytes."""
    with _written(f"{folder}/{name}-{part}.npy") as out:
        np.save(out, values)


_open: dict[str, np.ndarray] = {}


def _load(path: str) -> np.ndarray:
    """The file, memory-mapped; from a remote store it is fetched into an unlinked local file first."""
    if local := local_view(path):
        return np.load(local, mmap_mode="r")
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    with tempfile.NamedTemporaryFile() as copy:
        with fs.open_input_stream(inner) as source:
            while block := source.read(8 << 20):
                copy.write(block)
        copy.flush()
        return np.load(copy.name, mmap_mode="r")


def read_part(folder: str, name: str, part: int) -> np.ndarray:
    """The part, memory-mapped, and kept so for later calls."""
    path = f"{folder}/{name}-{part}.npy"
    if path not in _open:
        if len(_open) > 4096:
            _open.clear()
        _open[path] = _load(path)
    return np.asarray(_open[path])


def first_parts(parts: int, files: int) -> np.ndarray:
    """The first part of each file of gather(), and the number of parts."""
    return -(-np.arange(files + 1) * parts // files)


def gather(spark: SparkSession, folder: str, parts: int, files: int, arrays: dict[str, np.ndarray | None]) -> None:
    """Put the parts of each array back to back in a few files, named all- and the array's name, and delete them.

    Look-ups of a batch touch every file, so their number must not grow with the table as that of the parts does. An
    array that comes with starts, the first place of every part, holds places in its part, which become places in the
    file; one whose name ends with -begin also closes with the number of its part's places, which only a file keeps.
    One whose name ends with -more holds some of the places in ascending order, and becomes marks().
    """
    names, firsts = sorted(arrays), first_parts(parts, files)

    def pieces(name: str, file: int) -> Iterator[np.ndarray]:
        low, high = int(firsts[file]), int(firsts[file + 1])
        starts = arrays[name]
        for k in range(low, high):
            values = _load(f"{folder}/{name}-{k}.npy")
            if name.endswith("-begin") and k < high - 1:
                values = values[:-1]
            if starts is not None:
                values = values.astype(np.uint32 if starts[high] - starts[low] < 1 << 32 else np.uint64)
                values += values.dtype.type(starts[k] - starts[low])
            yield values

    def copy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, file in ((names[n // files], n % files) for n in pdf["id"]):
                path = f"{folder}/all-{name}-{file}.npy"
                if _exists(path):  # a task before has failed after it wrote the file
                    pass
                elif name.endswith("-more"):
                    write_part(folder, f"all-{name}", file, marks(pieces(name, file), int(arrays[name][firsts[file + 1]] - arrays[name][firsts[file]])))
                else:
                    kinds = [(len(x), x.dtype) for x in pieces(name, file)]
                    with _written(path) as out:
                        np.lib.format.write_array_header_1_0(out, {"descr": kinds[0][1].str, "fortran_order": False, "shape": (sum(n for n, _ in kinds),)})
                        for values in pieces(name, file):
                            out.write(values.tobytes())
                for k in range(int(firsts[file]), int(firsts[file + 1])):
                    _delete(f"{folder}/{name}-{k}.npy")
            yield pdf

    spark.range(0, len(names) * files, 1, len(names) * files).mapInPandas(copy, "id long").count()


def marks(pieces: Iterable[np.ndarray], n: int) -> np.ndarray:
    """Of each 64 of n places, which are among the ascending ones in the pieces, as bits, and how many of those come before."""
    bits = np.zeros(n // 64 + 1, np.uint64)
    for places in pieces:
        word, first = np.unique(places >> 6, return_index=True)
        if len(places):
            bits[word] |= np.bitwise_or.reduceat(np.uint64(1) << (places & 63).astype(np.uint64), first)
    held = np.bitwise_count(bits).astype(np.uint64)
    return np.stack([bits, np.cumsum(held) - held], axis=1).reshape(-1)


def marked(found: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether places are marked, and how many marked ones come before each."""
    word, bit = places >> 6 << 1, (places & 63).astype(np.uint64)
    bits = found[word]
    before = np.bitwise_count(bits & ((np.uint64(1) << bit) - np.uint64(1)))
    return (bits >> bit & np.uint64(1)).astype(bool), found[word + 1].astype(np.int64) + before


def _exists(path: str) -> bool:
    if local := local_view(path):
        return os.path.exists(local)
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    return fs.get_file_info(inner).type != pyarrow.fs.FileType.NotFound


def _delete(path: str) -> None:
    with contextlib.suppress(FileNotFoundError):
        if local := local_view(path):
            os.remove(local)
        else:
            fs, inner = pyarrow.fs.FileSystem.from_uri(path)
            fs.delete_file(inner)


class Parts:
    """One logical array in parts; bounds[k] is the first index of part k."""

    def __init__(self, folder: str, name: str, bounds: np.ndarray):
        self.folder, self.name, self.bounds = folder, name, bounds

    def take(self, index: np.ndarray) -> np.ndarray:
        """The values at sorted indexes."""
        cuts = np.searchsorted(index, self.bounds)
        pieces = [read_part(self.folder, self.name, k)[index[a:b] - self.bounds[k]] for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
        return np.concatenate(pieces) if pieces else np.zeros(0)


def by_part(part: np.ndarray) -> np.ndarray:
    """The order by part that keeps equal parts as they are; numbers of 16 bits are sorted fastest."""
    return np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")


def range_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of a 64-bit hash when parts divide the range of hashes evenly."""
    return ((hashes >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def find_sorted(folder: str, name: str, part: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index within its part of each key, or -1; keys are sorted by part, then key."""
    out = np.full(len(keys), -1, np.int64)
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(edges, [*edges[1:], len(part)]):
        have = read_part(folder, name, int(part[a]))
        if not len(have):
            continue
        at = np.minimum(np.searchsorted(have, keys[a:b]), len(have) - 1)
        hit = have[at] == keys[a:b]
        out[a:b][hit] = at[hit]
    return out


def write_keys(folder: str, name: str, part: int, keys: np.ndarray, heads: int | None = None) -> None:
    """Write ascending keys in half their size: lower halves, and where those of each upper half begin.

    With heads, upper halves are all the numbers below it and need no list; else a list of them is kept.
    """
    head, tail = (keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32)
    if heads is None:
        own, begin = np.unique(head, return_index=True)
        write_part(folder, f"{name}-head", part, own)
        begin = np.append(begin, len(keys))
    else:
        begin = np.searchsorted(head, np.arange(heads + 1))
    write_part(folder, f"{name}-begin", part, begin.astype(np.uint32))
    write_part(folder, f"{name}-tail", part, tail)


def read_keys(folder: str, name: str, part: int) -> np.ndarray:
    """The keys of a part that has a list of upper halves."""
    head, begin, tail = (read_part(folder, f"{name}-{x}", part) for x in ("head", "begin", "tail"))
    return np.repeat(head, np.diff(begin.astype(np.int64))).astype(np.uint64) << np.uint64(32) | tail.astype(np.uint64)


def find_keys(folder: str, name: str, part: np.ndarray, keys: np.ndarray, listed: bool) -> np.ndarray:
    """Index within its part of each key, or -1; keys are sorted by part; listed: the part has a list of upper halves."""
    out = np.full(len(keys), -1, np.int64)
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(edges, [*edges[1:], len(part)]):
        k = int(part[a])
        tail, begin = read_part(folder, f"{name}-tail", k), read_part(folder, f"{name}-begin", k)
        if not len(tail):
            continue
        head, want = (keys[a:b] >> np.uint64(32)).astype(np.uint32), keys[a:b].astype(np.uint32)
        if listed:
            have = read_part(folder, f"{name}-head", k)
            at = np.minimum(np.searchsorted(have, head), len(have) - 1)
            known = have[at] == head
        else:
            at = np.minimum(head.astype(np.int64), len(begin) - 2)
            known = at == head
        low, high = begin[at].astype(np.int64), begin[at + 1].astype(np.int64)
        high[~known] = low[~known]
        low = _at_least(tail, low, high, want)
        hit = low < high
        hit[hit] = tail[low[hit]] == want[hit]
        out[a:b][hit] = low[hit]
    return out


def _at_least(tail: np.ndarray, low: np.ndarray, high: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The first place of an ascending stretch of tail that holds as much as wanted, else its end; all searches side by side."""
    low = low.copy()
    left = np.flatnonzero(high - low > 1)
    at, n, least = low[left], (high - low)[left], want[left]
    while len(left):
        half = n >> 1
        at += half * (tail[at + half - 1] < least)
        n -= half
        more = n > 1
        if (k := np.count_nonzero(more)) < 0.7 * len(left) or not k:  # till then those of one place stay where they are
            low[left] = at
            left, at, n, least = left[more], at[more], n[more], least[more]
    some = np.flatnonzero(low < high)
    low[some] += tail[low[some]] < want[some]
    return low
