"""Exact tokenization of whole texts with a bounded, worker-wide memory of chunks.

A chunk (see chunk_spans) is encoded by the tokenizer library once and its ids are
gathered for every later occurrence. The memory is keyed by one 64-bit hash and checked
with a second; a chunk whose second hash differs is encoded by itself.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain
from pathlib import Path

import numpy as np

from ._text import HashTable, chunk_spans, hash_spans, lower_latin, ragged, sums

#: Chunks remembered by a Python worker before it starts afresh.
MEMORY = 600_000


class ChunkMemory:
    """ids of chunks; encode_new maps a list of chunk bytes to (all their ids, number of each).

    Where the tokenizer lowers letters and drops blanks, words that differ in that only are one chunk, and marks are chunks apart.
    """

    def __init__(self, encode_new, dtype=np.uint16, lowers: bool = False):
        self.encode_new = encode_new
        self.dtype = dtype
        self.lowers = lowers
        self.clear()

    def clear(self) -> None:
        self.table = HashTable()
        self.n = self.used = 0
        self.check = np.zeros(1 << 16, np.uint64)
        self.begin = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, self.dtype)

    def _append(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Encode and store chunks; their slots."""
        ids, lens = self.encode_new([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(lens) > len(self.begin):
            self.check, self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.check, self.begin, self.length))
        slots = np.arange(self.n, self.n + len(lens), dtype=np.int32)
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[slots] = self.used + np.cumsum(lens, dtype=np.int64) - lens
        self.length[slots] = lens
        self.check[slots] = check
        self.used += len(ids)
        self.n += len(lens)
        return slots

    def unknown(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Indexes of one occurrence of each chunk that is not remembered."""
        h = hash_spans(buf, starts, ends, 0)
        missing = np.flatnonzero(self.table.find(h) < 0)
        return missing[np.unique(h[missing], return_index=True)[1]]

    def learn(self, chunks: list[bytes]) -> None:
        """Remember distinct chunks that are not remembered yet."""
        if self.n > MEMORY:
            self.clear()
        raw = b"".join(chunks)
        buf = np.frombuffer(raw, np.uint8)
        lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(lens)
        h, g = hash_spans(buf, ends - lens, ends, 0), hash_spans(buf, ends - lens, ends, 1)
        _, pick = np.unique(h, return_index=True)
        pick = pick[self.table.find(h[pick]) < 0]
        if len(pick):
            self.table.add(h[pick], self._append(raw, (ends - lens)[pick], ends[pick], g[pick]))

    def lookup(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slot of each chunk."""
        if self.n > MEMORY:
            self.clear()
        h, g = hash_spans(buf, starts, ends, 0), hash_spans(buf, starts, ends, 1)
        out = self.table.find(h)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            fresh, first = np.unique(h[missing], return_index=True)
            pick = missing[first]
            raw = buf.tobytes()
            self.table.add(fresh, self._append(raw, starts[pick], ends[pick], g[pick]))
            out[missing] = self.table.find(h[missing])
        if len(h) and len(odd := np.flatnonzero(self.check[out] != g)):
            out[odd] = self._append(buf.tobytes(), starts[odd], ends[odd], g[odd])
        return out

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, one after another, and the number of each row."""
        if self.lowers:
            buf = lower_latin(buf)
        starts, ends, first = chunk_spans(buf, offsets, marks=self.lowers)
        if self.lowers and len(starts):
            starts = starts + (((buf[starts] == 0x20) | (buf[starts] == 0x0A)) & (ends - starts > 1))
        slot = self.lookup(buf, starts, ends)
        length = self.length[slot]
        return ragged(self.flat, self.begin[slot], length), sums(length, first)


_memories: dict[str, ChunkMemory] = {}
_PLAIN = re.compile(r"( ?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)")


def _library_encoder(path: str):
    """Encode chunks by the library; one run of letters goes straight to its model.

    A chunk of Latin letters is a single piece before the merges, so normalizer and
    pattern are skipped for it: byte-level files see its bytes as their printable
    characters, word files see it in lower case. Any other chunk takes the whole way.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    kept = json.loads(Path(path).read_text(encoding="utf-8"))
    lowers = kept["normalizer"] is not None
    model = library.model
    printable = [c for c in range(256) if chr(c).isprintable() and c != 0x20 and c != 0xAD]
    others = [c for c in range(256) if c not in printable]
    shown = {c: chr(c) for c in printable} | {c: chr(256 + k) for k, c in enumerate(others)}
    run = getattr(library, "encode_batch_fast", library.encode_batch)

    def encode_new(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [c.decode() for c in chunks]
        found: list[list[int] | None] = []
        whole = []
        for k, text in enumerate(texts):
            if m := _PLAIN.fullmatch(text):
                piece = m[2].lower() if lowers else text
                if not (lowers and piece.isascii()):
                    piece = piece.encode().decode("latin-1").translate(shown)
                found.append([t.id for t in model.tokenize(piece)])
            else:
                whole.append(k)
                found.append(None)
        for k, x in zip(whole, run([texts[k] for k in whole], add_special_tokens=False)):
            found[k] = x.ids
        lens = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(lens.sum())), lens

    return encode_new, library.get_vocab_size(), lowers


def memory_of(path: str) -> ChunkMemory:
    """The worker's memory for a file of the tokenizers library."""
    if path not in _memories:
        encode_new, size, lowers = _library_encoder(path)
        _memories[path] = ChunkMemory(encode_new, np.uint16 if size <= 1 << 16 else np.uint32, lowers)
    return _memories[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ids with end_id after each; also the rows' offsets."""
    offsets = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.empty(offsets[-1], ids.dtype)
    ends = offsets[1:] - 1
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[ends] = end_id
    out[keep] = ids
    return out, offsets
