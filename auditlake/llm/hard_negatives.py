"""Hard negatives by angular triangle filtering.

For each anchor the rows of its label with the highest scores are its positives, and for each
positive the best rows of other labels whose score lies in a window below the positive's score
are its hard negatives. A score is the inner product of integer vectors: components are scaled
and rounded down.

Rows are sorted by label, nearest reference direction and angle to it, and stored in parts of at
most ``PART`` rows with their angles to all ``REFERENCES`` directions. A window of at most
``WINDOW`` neighbouring rows keeps the range of each angle and of the norms. The angles of an
anchor and of a window to one direction bound the angle between them from both sides, by the
triangle inequality on the sphere; the tightest bounds over all directions times the norms are
bounds on scores, widened by more than rounding can move them. Only windows whose bounds overlap
what is still wanted are scored, in integers.

Parts are paired in tiles: a block of anchors meets some parts, in one task, and gives at most
the wanted rows for each anchor, or anchor and positive. So anchors are compared in blocks with
all rows, and what tasks send on does not grow with the rows of a label.

The directions are spread-out rows among at most ``SAMPLE`` of the most frequent length, drawn by
a hash of the id; other lengths have fixed random ones. They decide only how much is scored.

Defined results: rows take no part whose id, label or vector is null or whose vector is empty or
has null or non-finite components; zero vectors score 0; vectors of different lengths do not
compare; repeated rows are rows of their own, and a repeated anchor is each copy's other row; an
anchor without others of its label, or without rows in its windows, gives no rows; equal scores
are ordered by id; an empty table gives no rows. Where scores might leave 64 bits the job fails
with a message.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._scratch import materialize, new_folder
from ._store import read_part, write_part

REFERENCES, SAMPLE = 16, 2000
PART, WINDOW = 8192, 64
#: Anchors of one block, unless one part has more.
BLOCK = 1000
#: Parts of rows that one task goes through, at most.
RUN = 8
POSITIVES, NEGATIVES = 5, 10
#: The window of negatives, in hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Beyond the error of angles, in radians, and of bounds, relative to the norms.
_ANGLE, _BOUND = 1e-6, 1e-9
#: Windows that are scored before the rest are looked at again.
_FIRST = 8


@lru_cache(64)
def _directions(dim: int, count: int = REFERENCES) -> np.ndarray:
    """Fixed random unit vectors."""
    x = np.random.default_rng(dim).standard_normal((count, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spread(x: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit vectors of rows far from each other: each next one has the greatest least angle to those before."""
    norm = np.linalg.norm(x, axis=1)
    x = x[norm > 0] / norm[norm > 0, None]
    if len(x) < count:
        return _directions(x.shape[1], count)
    chosen, near = [0], x @ x[0]
    while len(chosen) < count:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def _angles(x: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to the directions."""
    x = x.astype(np.float64)
    norm = np.sqrt((x * x).sum(1))
    cosine = x @ directions.T / np.where(norm > 0, norm, 1.0)[:, None]
    return norm, np.arccos(np.clip(cosine, -1.0, 1.0))


def _whole(vector: pa.Scalar, scale: float) -> np.ndarray | None:
    """The integer vector of a usable row."""
    if not vector.is_valid or not len(vector) or vector.values.null_count:
        return None
    x = np.asarray(vector.values.to_numpy(zero_copy_only=False), np.float64)
    if not np.isfinite(x).all():
        return None
    x = np.floor(scale * x)
    if np.abs(x).max() >= 2.0**31:
        raise ValueError("a scaled component needs more than 32 bits; choose a smaller scale")
    return x.astype(np.int32)


def _prepare(scale: float, directions: dict[int, np.ndarray]):
    """(vec_id, label, anchor, dim, cluster, angle, raw) of the usable rows."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable = [_whole(v, scale) for v in batch.column("embedding")]
            rows = [k for k, v in enumerate(usable) if v is not None]
            cluster, angle = np.zeros(len(rows), np.int32), np.zeros(len(rows))
            dims = np.array([len(usable[k]) for k in rows], np.int32)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                _, found = _angles(np.stack([usable[rows[k]] for k in own]), directions.get(dim, _directions(dim)))
                cluster[own], angle[own] = found.argmin(1), found.min(1)
            kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("vec_id", "label", "anchor")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(dims), pa.array(cluster), pa.array(angle), pa.array([usable[k].tobytes() for k in rows], pa.binary())], ["vec_id", "label", "anchor", "dim", "cluster", "angle", "raw"])

    return prepare


_ARRAYS = ("ids", "vectors", "norms", "angles", "anchors", "begins", "labels", "low", "high", "least", "most")


class _Part:
    """One stored part: its rows in order, and its windows."""

    def __init__(self, folder: str, part: int):
        self.part = part
        for name in _ARRAYS:
            setattr(self, name, read_part(folder, name, part))
        self.dim = self.vectors.shape[1]

    def rows(self, windows: np.ndarray) -> np.ndarray:
        size = self.begins[windows + 1] - self.begins[windows]
        return np.repeat(self.begins[windows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _store_part(folder: str, part: int, rows: pd.DataFrame, directions: np.ndarray) -> int:
    """Write sorted rows of one length; how many are anchors."""
    x = np.frombuffer(b"".join(rows["raw"]), np.int32).reshape(len(rows), -1)
    norms, angles = _angles(x, directions)
    label = np.array([v.encode() + b"." for v in rows["label"]])
    kind = rows["cluster"].to_numpy()
    fresh = np.concatenate([[True], (label[1:] != label[:-1]) | (kind[1:] != kind[:-1])])
    begin = np.flatnonzero(fresh)
    place = np.arange(len(rows)) - np.repeat(begin, np.diff(np.append(begin, len(rows))))
    begins = np.flatnonzero(place % WINDOW == 0)
    anchors = np.flatnonzero(rows["anchor"].to_numpy())
    low, high = (f.reduceat(angles, begins, axis=0) for f in (np.minimum, np.maximum))
    least, most = (f.reduceat(norms, begins) for f in (np.minimum, np.maximum))
    values = (rows["vec_id"].to_numpy(np.int64), x, norms, angles, anchors, np.append(begins, len(rows)), label[begins], low - _ANGLE, high + _ANGLE, least, most)
    for name, value in zip(_ARRAYS, values):
        write_part(folder, name, part, value)
    return len(anchors)


def _write(folder: str, directions: dict[int, np.ndarray]):
    """(part, anchors) of the parts that a task's sorted rows fill."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        first = TaskContext.get().partitionId() << 20
        made = 0

        def flush() -> pd.DataFrame:
            nonlocal held, made
            rows = pd.concat(held)
            held, part = [], first + made
            made += 1
            dim = int(rows["dim"].iloc[0])
            return pd.DataFrame({"part": [part], "anchors": [_store_part(folder, part, rows, directions.get(dim, _directions(dim)))]})

        for pdf in frames:
            cut = np.flatnonzero(np.diff(pdf["dim"].to_numpy())) + 1
            for a, b in zip([0, *cut], [*cut, len(pdf)]):
                while a < b:
                    if held and held[0]["dim"].iloc[0] != pdf["dim"].iloc[a]:
                        yield flush()
                    take = min(b - a, PART - sum(map(len, held)))
                    held.append(pdf.iloc[a : a + take])
                    a += take
                    if sum(map(len, held)) == PART:
                        yield flush()
        if held:
            yield flush()

    return write


def _limits(norm: np.ndarray, angle: np.ndarray, part: _Part, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of anchors (rows) with any row of the windows (columns)."""
    near = np.zeros((len(norm), len(windows)))
    far = np.full_like(near, np.pi)
    for r in range(angle.shape[1]):
        own = angle[:, r, None]
        low, high = part.low[windows, r], part.high[windows, r]
        np.maximum(near, np.maximum(low - own, own - high), out=near)
        beyond = np.where(own + low >= np.pi, 2 * np.pi - own - low, np.where(own + high <= np.pi, own + high, np.pi))
        np.minimum(far, beyond, out=far)
    top, bottom = np.cos(np.clip(near - _ANGLE, 0, np.pi)), np.cos(np.clip(far + _ANGLE, 0, np.pi))
    least, most = part.least[windows] * norm[:, None], part.most[windows] * norm[:, None]
    room = 1 + _BOUND * most
    return np.where(bottom >= 0, least, most) * bottom - room, np.where(top >= 0, most, least) * top + room


def _scores(x: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(anchor).max(initial=0)) * len(anchor)
    if bound < 2.0**53:
        return (x.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    if bound >= 2.0**63:
        raise ValueError("scores may need more than 64 bits; choose a smaller scale")
    return x.astype(np.int64) @ anchor.astype(np.int64)


class _Best:
    """The first rows by score, then id, of those offered."""

    def __init__(self, count: int):
        self.count, self.scores, self.ids = count, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> float:
        """What a further row's score must reach at least."""
        return float(self.scores[-1]) if len(self.scores) == self.count else -np.inf

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.count:
            reach = np.partition(scores, len(scores) - self.count)[len(scores) - self.count]
            ids, scores = ids[scores >= reach], scores[scores >= reach]
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = np.lexsort((ids, -scores))[: self.count]
        self.scores, self.ids = scores[first], ids[first]


def _positives(part: _Part, own: _Part, row: int, windows: np.ndarray, upper: np.ndarray, best: _Best) -> int:
    """Offer the rows of one label's windows, the highest bounds first; how many rows were scored."""
    order = np.argsort(-upper, kind="stable")
    scored, at = 0, 0
    while at < len(order) and upper[order[at]] >= best.least:
        upto = at + _FIRST if at == 0 else at + int((upper[order[at:]] >= best.least).sum())
        rows = part.rows(windows[order[at:upto]])
        if part.part == own.part:
            rows = rows[rows != row]
        best.offer(_scores(part.vectors[rows], own.vectors[row]), part.ids[rows])
        scored += len(rows)
        at = upto
    return scored


def _negatives(part: _Part, anchor: np.ndarray, windows: np.ndarray, lower: np.ndarray, upper: np.ndarray, low: np.ndarray, high: np.ndarray, bests: list[_Best]) -> int:
    """Offer the rows of windows that overlap a positive's window of scores; how many rows were scored."""
    left = np.arange(len(windows))
    scored, turn = 0, 0
    while len(left):
        floor = np.maximum(low, [b.least for b in bests])
        left = left[((upper[left, None] >= floor) & (lower[left, None] <= high)).any(1)]
        chosen = left[np.argsort(-upper[left], kind="stable")[:_FIRST]] if turn == 0 else left
        left = np.setdiff1d(left, chosen, assume_unique=True)
        turn += 1
        if not len(chosen):
            break
        rows = part.rows(windows[chosen])
        scores, ids = _scores(part.vectors[rows], anchor), part.ids[rows]
        for a, b, best in zip(low, high, bests):
            inside = (scores >= a) & (scores <= b)
            best.offer(scores[inside], ids[inside])
        scored += len(rows)
    return scored


class _Tiles:
    """Blocks of anchors by runs of parts."""

    def __init__(self, folder: str, parts: list[tuple[int, int]], tasks: int):
        self.folder = folder
        self.blocks: list[list[int]] = []
        held = 0
        for part, anchors in parts:
            if anchors:
                if not self.blocks or held + anchors > BLOCK:
                    self.blocks.append([])
                    held = 0
                self.blocks[-1].append(part)
                held += anchors
        run = max(1, min(RUN, len(self.blocks) * len(parts) // tasks))
        self.runs = [[p for p, _ in parts[k : k + run]] for k in range(0, len(parts), run)]

    def __len__(self) -> int:
        return len(self.blocks) * len(self.runs)

    def anchors(self, block: int) -> Iterator[tuple[_Part, np.ndarray]]:
        for number in self.blocks[block]:
            part = _Part(self.folder, number)
            yield part, part.anchors


def _by_label(own: _Part, anchors: np.ndarray) -> Iterator[tuple[bytes, np.ndarray]]:
    """The labels of a part's anchors, and the anchors of each."""
    label = own.labels[np.searchsorted(own.begins, anchors, "right") - 1]
    for value in np.unique(label):
        yield value, anchors[label == value]


def _find_positives(tiles: _Tiles, count: int):
    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tile in (t for pdf in frames for t in pdf["id"].tolist()):
            block, run = divmod(tile, len(tiles.runs))
            parts = [_Part(tiles.folder, p) for p in tiles.runs[run]]
            for own, anchors in tiles.anchors(block):
                best = {row: _Best(count) for row in anchors.tolist()}
                scored = dict.fromkeys(best, 0)
                for label, rows in _by_label(own, anchors):
                    for part in parts:
                        windows = np.flatnonzero(part.labels == label)
                        if part.dim != own.dim or not len(windows):
                            continue
                        _, upper = _limits(own.norms[rows], own.angles[rows], part, windows)
                        for k, row in enumerate(rows.tolist()):
                            scored[row] += _positives(part, own, row, windows, upper[k], best[row])
                out = [(block, own.part << 20 | row, int(own.ids[row]), i, s, scored[row]) for row, b in best.items() for i, s in zip(b.ids.tolist(), b.scores.tolist())]
                if out:
                    yield pd.DataFrame(out, columns=["block", "anchor", "anchor_id", "positive_id", "positive_score", "scored"])

    return find


def _find_negatives(tiles: _Tiles, count: int, low: int, high: int):
    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, run in (t for pdf in frames for t in zip(pdf["block"].tolist(), pdf["run"].tolist())):
            parts = [_Part(tiles.folder, p) for p in tiles.runs[run]]
            table = read_part(tiles.folder, "positives", block)
            by_anchor = dict(zip(table[:, 0].tolist(), range(len(table))))  # the last of each; rows are sorted
            begin = {key: at for at, key in reversed(list(enumerate(table[:, 0].tolist())))}
            for own, anchors in tiles.anchors(block):
                out = []
                for label, rows in _by_label(own, anchors):
                    rows = np.array([r for r in rows.tolist() if own.part << 20 | r in begin], np.int64)
                    if not len(rows):
                        continue
                    of = {r: table[begin[own.part << 20 | r] : by_anchor[own.part << 20 | r] + 1] for r in rows.tolist()}
                    bests = {r: [_Best(count) for _ in of[r]] for r in of}
                    for part in parts:
                        windows = np.flatnonzero(part.labels != label)
                        if part.dim != own.dim or not len(windows):
                            continue
                        lower, upper = _limits(own.norms[rows], own.angles[rows], part, windows)
                        for k, row in enumerate(rows.tolist()):
                            scores = of[row][:, 3].tolist()  # Python's integers do not overflow
                            ends = (np.array([f(s) for s in scores], np.int64) for f in (lambda s: -(-s * low // 100), lambda s: s * high // 100))
                            _negatives(part, own.vectors[row], windows, lower[k], upper[k], *ends, bests[row])
                    for row, found in bests.items():
                        for place, best in enumerate(found):
                            key, place_id, positive, score = of[row][place].tolist()
                            out += [(key, place_id, int(own.ids[row]), positive, score, i, s) for i, s in zip(best.ids.tolist(), best.scores.tolist())]
                if out:
                    yield pd.DataFrame(out, columns=["anchor", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return find


def references(vectors: DataFrame, scale: float, seed: int = 7) -> dict[int, np.ndarray]:
    """Directions of the most frequent length among at most SAMPLE rows, drawn by a hash of the id."""
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding", F.xxhash64("vec_id", F.lit(seed)).alias("drawn"))
    table = rows.orderBy("drawn", "vec_id").limit(SAMPLE).select("embedding").toArrow().column("embedding")
    usable = [x for x in (_whole(v, scale) for v in table) if x is not None]
    if not usable:
        return {}
    dims, counts = np.unique([len(x) for x in usable], return_counts=True)
    dim = int(dims[counts.argmax()])
    return {dim: spread(np.stack([x for x in usable if len(x) == dim]).astype(np.float64))}


def mine(vectors: DataFrame, anchor: Column, scale: float, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; vectors has vec_id, label and embedding.

    The negatives of a positive with score s have low * s <= 100 * score <= high * s.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding", F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    directions = references(rows, scale)
    schema = "vec_id long, label string, anchor boolean, dim int, cluster int, angle double, raw binary"
    ready = materialize(rows.mapInArrow(_prepare(scale, directions), schema), "angles")
    order = ["dim", "label", "cluster", "angle", "vec_id"]
    folder = new_folder(spark, "parts")
    dealt = ready.repartitionByRange(ready.count() // PART + 1, *order).sortWithinPartitions(*order)
    written = materialize(dealt.mapInPandas(_write(folder, directions), "part long, anchors long"), "written")
    parts = sorted((r["part"], r["anchors"]) for r in written.collect())  # a row for each PART rows
    tasks = 4 * spark.sparkContext.defaultParallelism
    tiles = _Tiles(folder, parts, tasks)
    of_tiles = lambda n: spark.range(0, n, 1, max(1, min(n, tasks)))
    found = of_tiles(len(tiles)).mapInPandas(_find_positives(tiles, positives), "block int, anchor long, anchor_id long, positive_id long, positive_score long, scored long")
    first = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id"))
    best = found.withColumn("place", first).where(F.col("place") <= positives)

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        pdf = pdf.sort_values(["anchor", "place"])
        write_part(folder, "positives", block, pdf[["anchor", "place", "positive_id", "positive_score"]].to_numpy(np.int64))
        return pd.DataFrame({"block": [block]})

    have = materialize(best.groupBy("block").applyInPandas(keep, "block int"), "positives")
    todo = have.select("block", F.explode(F.sequence(F.lit(0), F.lit(max(len(tiles.runs) - 1, 0)))).alias("run")).repartition(tasks)
    schema = "anchor long, place long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    near = todo.mapInPandas(_find_negatives(tiles, negatives, low, high), schema)
    rank = F.row_number().over(W.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
