"""Vectorised word and chunk arithmetic on Arrow string columns.

Everything works on UTF-8 bytes. A word is a run of bytes other than the ASCII
white space 0x20 and 0x09-0x0D, which is the pattern [^\\x20\\x09-\\x0D]+ because
those bytes never occur inside a multi-byte character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; bounds a worker's memory.
SLICE_BYTES = 1 << 20

_U = np.uint64
WS = np.zeros(256, bool)
WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x = x * _U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> _U(27))
        x = x * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, with a random value for each byte."""

    def __init__(self, seed: int):
        with np.errstate(over="ignore"):
            self.values = mix((np.arange(1, 257, dtype=_U) + _U(seed * 1000)) * _U(0x9E3779B97F4A7C15))
        self.base = (int(mix(np.array([seed + 77], _U))[0]) & ~7) | 5
        self.up = self.down = np.ones(1, _U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n + n // 4, SLICE_BYTES + 2)
            inverse = pow(self.base, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.up, self.down = (
                    np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(n - 1, b, _U)]))
                    for b in (self.base, inverse)
                )
        return self.up, self.down


_powers = [_Powers(1), _Powers(2)]


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span; kind selects one of two independent functions."""
    p = _powers[kind]
    up, down = p.to(len(buf) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(buf) + 1, _U)
        total[0] = 0
        np.cumsum(p.values[buf] * up[: len(buf)], out=total[1:])
        out = (total[ends] - total[starts]) * down[starts]
        return mix(out + (ends - starts).astype(_U))


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of successive runs of rows; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        end = min(end, n)
        yield at, end, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = WS[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_SAFE_NEXT = np.zeros(256, bool)
_SAFE_NEXT[0x21:0x7F] = True
_SAFE_NEXT[0xC3] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SAFE_ASCII = np.zeros(256, bool)
_SAFE_ASCII[0x21:0x7F] = True


#: ASCII marks that may be cut off a letter; no vertical line, which the names of special tokens hold.
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), 0x7B, 0x7D, 0x7E]] = True
#: Second bytes of the letters among U+00C0-U+00FF, and what turns the capitals of them into small ones.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_LATIN_LOWER = np.zeros(256, np.uint8)
_LATIN_LOWER[0x80:0x9F] = 32
_LATIN_LOWER[0x97] = 0


def lower_latin(buf: np.ndarray) -> np.ndarray:
    """The letters A-Z and of U+00C0-U+00DE in lower case; the bytes as they are if that could change what is read.

    A combining mark (lead bytes 0xCC, 0xCD) may compose with a small letter where it does not with the capital,
    and names of special tokens are told by their case.
    """
    if ((buf == 0xCC) | (buf == 0xCD)).any() or b"<|" in buf.tobytes():
        return buf
    out = LOWER[buf]
    after = np.flatnonzero(buf[:-1] == 0xC3) + 1
    out[after] += _LATIN_LOWER[buf[after]]
    return out


def chunk_spans(buf: np.ndarray, offsets: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut rows before single blanks or line feeds that stand between printable characters.

    Tokenizers whose patterns never join a blank to the characters before it encode the
    pieces independently; a cut is made only where both neighbours are ASCII or
    U+00C0-U+00FF, so no other white space can be involved. A full stop or comma between
    an ASCII letter and white space is cut off too: such patterns end the letters there. With marks, so is
    every ASCII mark but the vertical line after a letter of ASCII or U+00C0-U+00FF.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = np.zeros(n, bool)
    if n > 2:
        mid = buf[1:-1]
        last = buf[:-2]
        lead = np.zeros(n - 2, bool)
        lead[1:] = (last[1:] >= 0x80) & (buf[: n - 3] == 0xC3)
        cut[1:-1] = ((mid == 0x20) | (mid == 0x0A)) & (_SAFE_ASCII[last] | lead) & _SAFE_NEXT[buf[2:]]
        cut[1:-1] |= _STOP[mid] & _LETTER[last] & ((buf[2:] == 0x20) | (buf[2:] == 0x0A))
        if marks:
            cut[1:-1] |= _MARK[mid] & (_LETTER[last] | (lead & _LATIN[last]))
        inner = offsets[1:-1]
        cut[inner[inner < n]] = False
        cut[inner[inner > 0] - 1] = False
    cut_at = np.flatnonzero(cut)
    filled = offsets[:-1][np.diff(offsets) > 0]
    starts = np.sort(np.concatenate([cut_at, filled]))
    ends = np.append(starts[1:], n)
    return starts, ends, np.searchsorted(starts, offsets)


def ragged(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenate flat[begin[i]:begin[i] + length[i]] over i."""
    length = length.astype(np.int64)
    total = int(length.sum())
    shift = begin.astype(np.int64) - (np.cumsum(length) - length)
    return flat[np.repeat(shift, length) + np.arange(total)]


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] over i; empty ranges give 0, equal ranges equal sums."""
    if values.dtype.kind == "f":
        out = np.zeros(len(first) - 1)
        full = np.flatnonzero(first[1:] > first[:-1])
        if len(full):
            out[full] = np.add.reduceat(values[: first[-1]], first[:-1][full])
        return out
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


class HashTable:
    """Open addressing from nonzero 64-bit keys to integers, with vectorised access."""

    def __init__(self, bits: int = 16):
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)
        self.n = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        got = self.keys[slot]
        out = np.where(got == keys, self.values[slot], np.int32(-1))
        left = np.flatnonzero((got != keys) & (got != 0))
        while len(left):
            slot[left] = at = (slot[left] + 1) & self.mask
            got = self.keys[at]
            hit = got == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit & (got != 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Enter distinct keys that are not there yet."""
        if 2 * (self.n + len(keys)) > self.mask:
            old = self.keys != 0
            k, v = self.keys[old], self.values[old]
            self.__init__(max(16, int(4 * (self.n + len(keys))).bit_length()))
            self.add(k, v)
        self.n += len(keys)
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]
            own = self.keys[at] == keys[left]
            self.values[at[own]] = values[left[own]]
            left = left[~own]
            slot[left] = (slot[left] + 1) & self.mask
