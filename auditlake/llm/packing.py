"""Best-fit-decreasing packing of tokenized documents into fixed windows.

A document's ids are its tokens and then one end id. Documents longer than a window
are first cut into full windows; the remainders go, longest first, into the open window
with the least sufficient room, found in a segment tree indexed by remaining capacity.
A full window needs no packing and is a sequence as it is. Remainders, at most one a document, are
dealt by a hash of what they hold into groups of about ``GROUP`` and each group is packed by itself,
so no task packs more than a bounded share whatever the documents, and what is packed together does
not depend on how the input is partitioned.

A sequence is padded to the window unless its length is a power of two.

Defined results: a null text is the empty text and gives a piece with the end id alone;
repeated rows are packed as often as they occur, rows without a doc_id too; an empty table gives no pieces; columns
other than the id and the text are ignored; equal lengths are taken in order of document
and start.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import materialize
from ._text import slices
from ._tokens import memory_of, with_end

WINDOW = 2048
#: Remainders that are packed together, on average.
GROUP = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long, ids binary"

PIECE_NAMES, PACKED_NAMES = ([f.split()[0] for f in fields.split(", ")] for fields in (PIECES, PACKED))


class CapacityTree:
    """Counts of open windows by remaining capacity; finds the least capacity of at least n."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, capacity: int, bin_id: int) -> None:
        self.open[capacity].append(bin_id)
        node = capacity + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the tightest window with room for least."""
        node = least + self.size
        count = self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.size
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset there) of each piece; lengths must not increase."""
    tree = CapacityTree(window)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n = 0
    for k, length in enumerate(lengths):
        if (found := tree.take(length)) is None:
            found = window, n
            n += 1
        room, bins[k] = found
        offsets[k] = window - room
        if room > length:
            tree.put(room - length, bins[k])
    return bins, offsets


def cut(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document: full windows and one remainder."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = memory_of(tokenizer)
        for batch in batches:
            for a, b, buf, off in slices(batch.column("text")):
                ids, at = with_end(*memory.encode(buf, off), end_id)
                wide = ids.astype("<u4")
                total = np.diff(at)
                n = -(-total // window)
                doc = np.repeat(np.arange(b - a), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * window
                length = np.minimum(window, total[doc] - start)
                begin = at[doc] + start
                raw = [memoryview(wide[s : s + k]).cast("B") for s, k in zip(begin.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a).take(pa.array(doc)), pa.array(start), pa.array(length),
                        pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(total[doc]),
                        pa.array([bytes(x) for x in raw] if keep_ids else [None] * len(raw), pa.binary()),
                    ],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(pieces, PIECES)


def pack(pieces: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Give each piece its sequence_id, offset and the sequence's padded_length; pieces, a stored table, is read twice.

    A full window is a sequence of its own, with an odd id; the others have even ids.
    """
    n = {r["whole"]: r["n"] for r in pieces.groupBy((F.col("length") >= window).alias("whole")).agg(F.count("*").alias("n")).collect()}
    groups, whole_groups = (max(1, n.get(k, 0) // group) for k in (False, True))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "unnamed", "doc_id", "start", "ids_crc32", "copy"], ascending=[False, True, True, True, True, True], ignore_index=True)
        bins, offsets = best_fit_decreasing(pdf["length"].tolist(), window)
        used = np.bincount(bins, weights=pdf["length"]).astype(np.int64)
        padded = np.where(used & (used - 1), window, used)
        return pdf.assign(sequence_id=2 * (bins * groups + pdf["group"]), offset=offsets, padded_length=padded[bins])[[*PACKED_NAMES, "unnamed"]]

    # equal pieces are counted and numbered, so that they too are dealt apart, and alike in every run
    own = pieces.groupBy(*PIECE_NAMES).agg(F.count("*").alias("copies"))
    own = own.select(*PIECE_NAMES, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    whole, hashed = F.col("length") >= window, F.xxhash64("doc_id", "start", "ids_crc32", "copy")
    own = own.withColumn("group", F.pmod(hashed, F.when(whole, whole_groups).otherwise(groups)))
    place = F.row_number().over(Window.partitionBy("group").orderBy("doc_id", "start", "ids_crc32", "copy")) - 1
    alone = own.where(whole).withColumns({"sequence_id": (place * whole_groups + F.col("group")) * 2 + 1, "offset": F.lit(0).cast("long"), "padded_length": F.lit(window).cast("long")})
    # pandas would turn a column with nulls into floats, which hold no 64-bit ids
    named = own.where(~whole).withColumns({"unnamed": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0))})
    dealt = named.groupBy("group").applyInPandas(packed, f"{PACKED}, unnamed boolean")
    dealt = dealt.withColumn("doc_id", F.when(~F.col("unnamed"), F.col("doc_id"))).drop("unnamed")
    return dealt.unionByName(alone.select(*PACKED_NAMES))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length, ids."""
    return pack(materialize(cut(docs, tokenizer, end_id, window, keep_ids), "pieces"), window)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids): the padded little-endian 32-bit ids of each sequence; needs pieces with ids."""

    def filled(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        raw = b"".join(pdf["ids"])
        room = int(pdf["padded_length"].iloc[0]) * 4 - len(raw)
        return pd.DataFrame({"sequence_id": [pdf["sequence_id"].iloc[0]], "ids": [raw + np.uint32(pad_id).tobytes() * (room // 4)]})

    return packed.groupBy("sequence_id").applyInPandas(filled, "sequence_id long, ids binary")
