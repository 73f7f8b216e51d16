"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors at cosine c are at squared distance 2 - 2c. After a fixed random rotation the
dimensions are split into low-dimensional blocks, and each gets the share of that squared
distance that its dimensions have of all: two linked vectors are within the share in at
least one block. Each block is range-joined over a grid on its leading dimensions, and what
is within a block's share is compared exactly in double precision. A pair counts in the
first block that finds it, so degrees need no list of pairs; of the links only a spanning
forest of each grid cell is kept, so rows stay linear in the vectors.

Equal vectors are merged first and carry their number. A cell with many vectors is split
into tiles of at most ``TILE`` by ``TILE``.

Defined results: rows whose label or vector is null, or whose vector is empty, zero or has
null or non-finite components, link with nothing and are their own component; vectors of
different lengths link with nothing; repeated rows are vectors of their own; a row without a vec_id links like any other but is no
component's name, and has no kept; labels are integers; an empty table
gives no rows; columns other than vec_id, label and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.families import linked_components
from ._scratch import materialize

BLOCK = 8
#: Leading dimensions of a block that its grid uses.
GRID = 2
TILE = 2000
#: Room for rounding in block distances; the exact comparison decides.
SLACK = 1e-9
_PAIRS = 1 << 18


@lru_cache(4)
def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int) -> list[slice]:
    return [slice(k, min(k + BLOCK, dim)) for k in range(0, dim, BLOCK)]


def _prepare(kind: str):
    """(vec_id, label, raw): raw holds the numbers of a usable vector, else null."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for label, vector in zip(batch.column("label").to_pylist(), batch.column("embedding")):
                values = None
                if label is not None and vector.is_valid and len(vector) and not vector.values.null_count:
                    values = np.asarray(vector.values.to_numpy(zero_copy_only=False), kind)
                    if not (np.isfinite(values).all() and values.any()):
                        values = None
                raw.append(None if values is None else values.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(raw, pa.binary())], ["vec_id", "label", "raw"])

    return prepare


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cells(least: float, kind: str):
    """Rows of every vector's home cell and of the cells within reach, for each block."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, mult, label, raw = (batch.column(c).to_pylist() for c in ("rep", "copies", "label", "raw"))
            sizes = np.array([len(x) // np.dtype(kind).itemsize for x in raw], np.int64)
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                turned = _unit([raw[k] for k in own], kind) @ rotation(dim)
                for b, block in enumerate(blocks(dim)):
                    reach = np.sqrt((2 - 2 * least) * (block.stop - block.start) / dim) * (1 + SLACK) + SLACK
                    lead = turned[:, block][:, :GRID]
                    home = np.floor(lead / (2 * reach)).astype(np.int64)
                    low, high = (np.floor((lead + s * reach) / (2 * reach)).astype(np.int64) for s in (-1, 1))
                    out = []
                    for corner in range(1 << lead.shape[1]):
                        pick = np.array([corner >> k & 1 for k in range(lead.shape[1])], bool)
                        cell = np.where(pick, high, low)
                        new = ~((low == high) & pick).any(1)
                        out.append(((cell == home).all(1) & new, cell, new))
                    for is_home, cell, new in out:
                        at = np.flatnonzero(new)
                        names = [" ".join(map(str, c)) for c in cell[at].tolist()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([label[own[k]] for k in at], pa.int64()), pa.array([dim] * len(at), pa.int32()), pa.array([b] * len(at), pa.int32()), pa.array(names, pa.string()), pa.array([rep[own[k]] for k in at], pa.int64()), pa.array([mult[own[k]] for k in at], pa.int64()), pa.array(is_home[at]), pa.array([raw[own[k]] for k in at], pa.binary())],
                            ["label", "dim", "block", "cell", "rep", "copies", "home", "raw"],
                        )

    return emit


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index linked to each of n nodes by edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _join(least: float, kind: str):
    """Links of a tile: (rep, links, other) with other the least member of its part of the forest."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, b = int(pdf["dim"].iloc[0]), int(pdf["block"].iloc[0])
        pdf = pdf.sort_values("rep", ignore_index=True)
        unit = _unit(pdf["raw"].tolist(), kind)
        turned = unit @ rotation(dim)
        parts = blocks(dim)
        budget = [(2 - 2 * least) * (s.stop - s.start) / dim + SLACK for s in parts]
        rep, mult = pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
        homes, members = np.flatnonzero(pdf["as_home"]), np.flatnonzero(pdf["as_member"])
        v = turned[members, parts[b]]
        links = np.zeros(len(pdf), np.int64)
        forest = np.arange(len(pdf))
        rows = max(1, _PAIRS // max(1, len(members)))
        for at in range(0, len(homes), rows):
            h = homes[at : at + rows]
            u = turned[h, parts[b]]
            near = (u * u).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * u @ v.T <= budget[b] + SLACK
            i, j = np.nonzero(near)
            i, j = h[i], members[j]
            i, j = i[rep[i] != rep[j]], j[rep[i] != rep[j]]
            cosine = np.einsum("ij,ij->i", unit[i], unit[j])
            i, j = i[cosine >= least], j[cosine >= least]
            links_here = np.zeros(len(i), bool)
            first = np.full(len(i), -1)
            for k in range(b + 1):  # the first block whose share holds the pair
                diff = turned[i, parts[k]] - turned[j, parts[k]]
                first = np.where((first < 0) & ((diff * diff).sum(1) <= budget[k]), k, first)
            links_here = first == b
            links += np.bincount(i[links_here], weights=mult[j[links_here]], minlength=len(links)).astype(np.int64)
            forest = _forest(len(pdf), np.concatenate([np.arange(len(pdf)), i]), np.concatenate([forest, j]))
        other = rep[forest]
        told = (links > 0) | (other != rep)
        return pd.DataFrame({"rep": rep[told], "links": links[told], "other": other[told]})

    return join


def dedup(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, label, embedding)."""
    # single-precision vectors travel as they are; every computation is in double precision
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    kind = "<f4" if single else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding") if single else F.col("embedding").cast("array<double>"))
    rows = rows.mapInArrow(_prepare(kind), "vec_id long, label long, raw binary")
    rows = materialize(rows.withColumn("digest", F.sha2("raw", 256)), "vectors")
    reps = rows.where("raw IS NOT NULL").groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("raw").alias("raw"))
    reps = materialize(reps, "distinct-vectors")
    schema = "label long, dim int, block int, cell string, rep long, copies long, home boolean, raw binary"
    cells = materialize(reps.mapInArrow(_cells(least, kind), schema), "cells")
    key = ["label", "dim", "block", "cell"]
    sizes = cells.groupBy(*key).agg(F.count("*").alias("size"), F.count_if("home").alias("homes")).where("size > 1 AND homes > 0")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    sized = cells.join(sizes.select(*key, tiles.alias("tiles")), key).withColumn("own", own)
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    pairs = F.array_union(
        F.when(F.col("home"), F.transform(every, lambda k: F.struct(F.col("own").alias("i"), k.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>")),
        F.transform(every, lambda k: F.struct(k.alias("i"), F.col("own").alias("j"))),
    )
    dealt = sized.withColumn("t", F.explode(pairs)).withColumns(
        {"as_home": F.col("home") & (F.col("t.i") == F.col("own")), "as_member": F.col("t.j") == F.col("own"), "i": F.col("t.i"), "j": F.col("t.j")}
    )
    dealt = dealt.select(*key, "i", "j", "rep", "copies", "as_home", "as_member", "raw")
    found = dealt.groupBy(*key, "i", "j").applyInPandas(_join(least, kind), "rep long, links long, other long")
    found = materialize(found, "links")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = linked_components(found.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    each = reps.join(linked, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    each = each.select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(each, ["label", "digest"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
