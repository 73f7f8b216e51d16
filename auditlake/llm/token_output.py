"""Binary token-id output: canonical length-limited Huffman blocks.

File format. A data set is a folder of Parquet files, one row per block, in ascending
order of document id over the files' ``part`` numbers and each part's ``block`` numbers.
A block stands alone:

* ``doc_ids``: little-endian int64 per document; ``doc_known``: a byte per document, 0 where it has
  no doc_id; ``doc_lengths``: little-endian uint32,
  ids of each document with its end id;
* ``payload``: code words, most significant bit first, documents end to end;
* ``checkpoints``: little-endian uint64 bit offsets of every ``STEP``-th id, so a reader
  may start there;
* ``n_ids``, and ``start_in_part``, the ids of the part before the block.

The code book is a second table (id, bits): code words are canonical, by length and then
id, and at most ``LIMIT`` bits long (package-merge), so a table of 2**LIMIT entries decodes; more
different ids than that are refused.

Defined results: a null text is the empty text and is written as the end id alone;
repeated rows are all written; equal doc_ids follow each other, shorter first; rows without a doc_id come last; an empty
table gives an empty data set; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import materialize, new_folder
from ._text import slices
from ._tokens import memory_of, with_end

LIMIT = 18
STEP = 256
#: Ids after which a block is closed (a document is never split).
BLOCK_IDS = 1 << 18
#: Ids of a range partition, about.
PART_IDS = 1 << 22
BLOCK = "part int, block int, start_in_part long, n_ids long, doc_ids binary, doc_known binary, doc_lengths binary, checkpoints binary, payload binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most limit bits, by package-merge."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} different ids have no code of {limit} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    weight = counts[order].astype(np.float64)
    rows, leaves = [], []
    merged = weight
    for _ in range(limit - 1):
        rows.append(merged)
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        place = np.argsort(both, kind="stable")
        merged = both[place]
        leaves.append(place < n)
    take = 2 * n - 2
    lengths = np.zeros(n, np.int64)
    for is_leaf in reversed(leaves):
        chosen = int(is_leaf[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    lengths[:take] += 1
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical_codes(ids: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code words, order) where order sorts by length and id."""
    order = np.lexsort((ids, bits))
    sorted_bits = bits[order]
    span = np.left_shift(np.int64(1), LIMIT - sorted_bits)
    codes = np.empty(len(ids), np.int64)
    codes[order] = (np.cumsum(span) - span) >> (LIMIT - sorted_bits)
    return codes, order


class CodeBook:
    """Encoder and table-driven decoder for (ids, bits)."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        codes, order = canonical_codes(ids, bits)
        size = int(ids.max()) + 1 if len(ids) else 1
        self.code, self.bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[ids], self.bits[ids] = codes, bits
        span = np.left_shift(np.int64(1), LIMIT - bits[order])
        self.symbol = np.zeros(1 << LIMIT, np.uint32)
        self.step = np.ones(1 << LIMIT, np.int64)
        used = int(span.sum())
        self.symbol[:used] = np.repeat(ids[order], span)
        self.step[:used] = np.repeat(bits[order], span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(payload, bit offsets of every STEP-th id)."""
        bits = self.bits[ids]
        at = np.cumsum(bits) - bits
        word, room = at >> 6, 64 - (at & 63) - bits
        code = self.code[ids]
        n = (int(at[-1] + bits[-1]) >> 6) + 2 if len(ids) else 1
        out = np.zeros(n, np.uint64)
        head = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        edge = np.flatnonzero(np.diff(word, prepend=-1))
        if len(ids):
            out[word[edge]] = np.add.reduceat(head, edge)
        over = room < 0
        out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        size = (int(at[-1] + bits[-1]) + 7) // 8 if len(ids) else 0
        return out.byteswap().tobytes()[:size], at[::STEP].astype("<u8")

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The n ids, all checkpoints' runs side by side."""
        raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at = checkpoints.astype(np.int64)
        out = np.zeros((STEP, len(at)), np.uint32)
        last = len(window) - 1
        for k in range(STEP):
            peek = (window[np.minimum(at >> 3, last)] >> (32 - LIMIT - (at & 7)).astype(np.uint32)) & ((1 << LIMIT) - 1)
            out[k] = self.symbol[peek]
            at += self.step[peek]
        return out.T.reshape(-1)[:n]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, n, ids): little-endian ids of two or four bytes, by the vocabulary's size."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = memory_of(tokenizer)
        for batch in batches:
            names = batch.column("doc_id")
            for a, b, buf, off in slices(batch.column("text")):
                ids, at = with_end(*memory.encode(buf, off), end_id)
                width = ids.dtype.itemsize
                binary = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((at * width).astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([names.slice(a, b - a), pa.array(np.diff(at)), pa.array([width] * (b - a), pa.int32()), binary.cast(pa.binary())], ["doc_id", "n", "width", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, n long, width int, ids binary")


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch of tokenize(), and each row's number."""
    raw = b"".join(batch.column("ids").to_pylist())
    width = batch.column("width")[0].as_py() if batch.num_rows else 2
    return np.frombuffer(raw, f"<u{width}"), batch.column("n").to_numpy(zero_copy_only=False)


def code_book(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bits) from the counts of all rows; at most one row per vocabulary entry reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                more = np.bincount(_ids(batch)[0], minlength=len(total))
                more[: len(total)] += total
                total = more
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    counted = tokens.select("n", "width", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    ids, counts = counted["id"].to_numpy(np.int64), counted["n"].to_numpy(np.int64)
    order = np.argsort(ids)
    ids, counts = ids[order], counts[order]
    return ids, code_lengths(counts), int(counts.sum())


def write(tokens: DataFrame, path: str) -> None:
    """Write tokenize()'s rows to path/blocks and path/codes in the file format above."""
    spark = tokens.sparkSession
    ids, bits, total = code_book(tokens)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_IDS))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = CodeBook(ids, bits)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, ...]] = []

        def close() -> pa.RecordBatch:
            nonlocal number, before
            names, known, values, lens = (np.concatenate(x) for x in zip(*held))
            payload, checkpoints = book.encode(values)
            row = [part, number, before, len(values), names.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), lens.astype("<u4").tobytes(), checkpoints.tobytes(), payload]
            number, before = number + 1, before + len(values)
            held.clear()
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], [f.split()[0] for f in BLOCK.split(", ")])

        pending = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                values, lens = _ids(some)
                name = some.column("doc_id")
                held.append((name.fill_null(0).to_numpy(), name.is_valid().to_numpy(zero_copy_only=False), values, lens))
                pending += len(values)
                if pending >= BLOCK_IDS:
                    pending = 0
                    yield close()
        if held:
            yield close()

    last = F.col("doc_id").asc_nulls_last()
    ordered = tokens.repartitionByRange(parts, last, "n").sortWithinPartitions(last, "n", "ids")
    ordered.mapInArrow(blocks, BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    spark.createDataFrame([(int(i), int(b)) for i, b in zip(ids, bits)], "id long, bits int").coalesce(1).write.parquet(f"{path}/codes")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids little-endian uint32, start counted over the whole data set."""
    book = spark.read.schema("id long, bits int").parquet(f"{path}/codes").toPandas()  # no longer than the vocabulary
    ids, bits = book["id"].to_numpy(np.int64), book["bits"].to_numpy(np.int64)
    stored = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    # one row per range partition, which bounds what the driver and the broadcast hold
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("n")).toPandas().sort_values("part")
    totals["before"] = totals["n"].cumsum() - totals["n"]
    offsets = spark.createDataFrame([(int(p), int(b)) for p, b in zip(totals["part"], totals["before"])], "part int, before long")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = CodeBook(ids, bits)
        for batch in batches:
            for row in range(batch.num_rows):
                x = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                values = decoder.decode(x["payload"], np.frombuffer(x["checkpoints"], "<u8"), x["n_ids"]).astype("<u4")
                lens = np.frombuffer(x["doc_lengths"], "<u4").astype(np.int64)
                at = np.concatenate([[0], np.cumsum(lens)])
                names = pa.array(np.frombuffer(x["doc_ids"], "<i8"), mask=np.frombuffer(x["doc_known"], np.uint8) == 0)
                raw = values.tobytes()
                for k in range(0, len(lens), 256):
                    part = at[k : k + 257]
                    yield pa.RecordBatch.from_arrays(
                        [names[k : k + 256], pa.array(x["before"] + x["start_in_part"] + part[:-1]), pa.array(np.diff(part)), pa.array([raw[4 * s : 4 * e] for s, e in zip(part[:-1], part[1:])], pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return stored.join(F.broadcast(offsets), "part").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids binary")


def write_documents(docs: DataFrame, tokenizer: str, end_id: int = 1) -> str:
    """Tokenize docs into a new data set in the shared folder; its path."""
    path = new_folder(docs.sparkSession, "token-ids")
    write(materialize(tokenize(docs, tokenizer, end_id), "tokens"), path)
    return path


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of read()'s rows."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums_ = pa.array([zlib.crc32(x.as_buffer()) for x in batch.column("ids")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), sums_], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
