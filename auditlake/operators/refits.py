"""Two-stage bootstrap of temperature refits: budgets by methods in one pass, with weighted AUROC.

A replicate draws a weight for each calibration unit and one for each test unit. Temperatures are
fitted anew on the weighted prefix of each budget and judged on the weighted test cells.

Fitting. The slopes of the loss at fixed points of log T (module ``slopes``) are weighted sums over
cells: one pass multiplies the matrix of cells by points with that of cells by replicates, for each
band of ranks. A budget's sums are those of its bands, so nested budgets share all of them, and the
optimum of every budget, method, policy and replicate is then a root of a polynomial, with no further pass.

Judging. Replicates order the test cells each in its own way, since each has its own T. A policy's
cells are dealt by ranges of the score that sampled splitters divide for each column (one replicate
of one budget and method). A task holds one policy, block of replicates and range, sorts its cells for
each column of every budget and method, and sends on sums: positives and negatives of the range and
the pairs won inside. Prefix sums over the ranges give the rest of the rank sum. A cell goes, with
its weights, once to each range in which one of the columns puts it: budgets and methods have the same
weights, and mostly the same ranges. Ranges are as wide as a task can hold, since a cell is in
more of them the narrower they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import saved
from . import metrics
from .bootstrap import weights
from .slopes import HIGH, LOGITS, LOW, NODES, roots, slopes

#: Replicates that are fitted together, and of one block of columns; a multiple of the draws of a digest.
REPLICATES = 160
#: Cells of one range of scores, about, and ranges of a policy, at most: beyond both, ranges grow.
RANGE, MAX_RANGES = 200_000, 256
#: Ranges of a policy, at least, so that tasks can share it, where each gets so many cells.
SHARED, SHARED_CELLS = 4, 2_000
#: Sampled cells for each range.
PER_RANGE = 64
METHODS = ("global", "policy", "shrunk")
_codec = pa.Codec("zstd", 1)


def _weights_of(seed: str, units: pd.Series, first: int, last: int) -> np.ndarray:
    """Weights of each cell's unit in replicates first + 1 to last."""
    codes, distinct = pd.factorize(units)
    return weights(seed, distinct.tolist(), first, last)[codes]


def slope_sums(calib: DataFrame, unit: str, budgets: list[int], seed: str, replicates: int) -> DataFrame:
    """policy, band, block, sums (points by replicates, flat) and n, the weight, for each replicate of a block.

    calib has policy, state_id, z0..z2 and rank from 1; a band holds the ranks of one budget that no smaller one has.
    """
    bands = sorted(budgets)
    size = REPLICATES
    blocks = -(-replicates // size)
    schema = "policy string, band int, block int, sums array<double>, n array<double>"

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[np.ndarray]] = {}
        for pdf in frames:
            for block, own in pdf.groupby("block", sort=False):
                w = _weights_of(seed, own["unit"], block * size, min((block + 1) * size, replicates))
                z, y = own[LOGITS].to_numpy(np.float64), own["state_id"].to_numpy(np.int64)
                for (policy, band), at in own.reset_index(drop=True).groupby(["policy", "band"], sort=False).indices.items():
                    new = [slopes(z[at], y[at]).T @ w[at], w[at].sum(0)]
                    key = (policy, band, block)
                    held[key] = [a + b for a, b in zip(held[key], new)] if key in held else new
        if held:
            yield pd.DataFrame([[*k, *[x.reshape(-1).tolist() for x in v]] for k, v in held.items()], columns=["policy", "band", "block", "sums", "n"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, *[np.sum(np.stack(pdf[c].to_list()), axis=0).tolist() for c in ("sums", "n")]]], columns=["policy", "band", "block", "sums", "n"])

    band = sum((F.col("rank") > b).cast("int") for b in bands)
    rows = calib.where(F.col("state_id").isNotNull() & (F.col("rank") <= bands[-1])).select(F.col(unit).alias("unit"), "policy", "state_id", *LOGITS, band.alias("band"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return rows.mapInPandas(partial, schema).groupBy("policy", "band", "block").applyInPandas(add, schema)


def drawn_together(own: np.ndarray, variance: np.ndarray, pooled: np.ndarray) -> np.ndarray:
    """Each policy's log T (rows) drawn to the pooled one by its share of variance within policies, and clipped."""
    with np.errstate(invalid="ignore", divide="ignore"):
        between = np.var(own, axis=0, ddof=1) if len(own) > 1 else np.zeros(own.shape[1])
        known = np.isfinite(variance)
        mean = np.where(known, variance, 0).sum(0) / known.sum(0)
        between = np.maximum(0, between - mean)
        total = between + variance
        share = np.where(np.isfinite(total) & (total > 0), between / total, 0.0)
    return np.clip(pooled + share * (own - pooled), LOW, HIGH)


def temperatures(calib: DataFrame, unit: str, budgets: list[int], seed: str, replicates: int) -> DataFrame:
    """budget, method, policy, block and log_t, an array over the block's replicates."""
    bands = sorted(budgets)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        policies = sorted(pdf["policy"].unique())
        size = len(pdf["n"].iloc[0])
        sums, n = np.zeros((len(policies), len(bands), NODES, size)), np.zeros((len(policies), len(bands), size))
        for policy, band, s, w in zip(pdf["policy"], pdf["band"], pdf["sums"], pdf["n"]):
            sums[policies.index(policy), band], n[policies.index(policy), band] = np.reshape(s, (NODES, size)), w
        sums, n = sums.cumsum(1), n.cumsum(1)
        out = []
        for k, budget in enumerate(bands):
            own, variance = (np.stack(v) for v in zip(*[roots(sums[p, k], n[p, k]) for p in range(len(policies))]))
            pooled, _ = roots(sums[:, k].sum(0), n[:, k].sum(0))
            of = {"global": np.broadcast_to(pooled, own.shape), "policy": own, "shrunk": drawn_together(own, variance, pooled)}
            out += [(budget, m, p, key[0], of[m][j].tolist()) for m in METHODS for j, p in enumerate(policies)]
        return pd.DataFrame(out, columns=["budget", "method", "policy", "block", "log_t"])

    return slope_sums(calib, unit, budgets, seed, replicates).groupBy("block").applyInPandas(fit, "budget int, method string, policy string, block int, log_t array<double>")


@dataclass(frozen=True)
class Columns:
    """Blocks of columns: (budget, method, block of replicates), and log T of each policy's columns; raw, of budget 0, has T = 1."""

    seed: str
    replicates: int
    size: int  # replicates of a block
    blocks: list[tuple[int, str, int]]
    tau: dict[tuple[str, int], np.ndarray]  # (policy, number of a block)
    samples: dict[str, np.ndarray] = field(default_factory=dict)  # logits of sampled cells
    ranges: dict[str, int] = field(default_factory=dict)
    _splitters: dict[tuple[str, int], np.ndarray] = field(default_factory=dict)

    def span(self, block: int) -> tuple[int, int]:
        first = block * self.size
        return first, min(first + self.size, self.replicates)

    def numbers(self, policy: str, block: int) -> list[int]:
        """The numbers of a policy's blocks of columns that share a block of replicates."""
        return [k for k, x in enumerate(self.blocks) if x[2] == block and (policy, k) in self.tau]

    def hit(self, policy: str, block: int, z: np.ndarray) -> np.ndarray:
        """The ranges (columns) in which a column puts each cell (rows)."""
        found = np.zeros((len(z), self.ranges.get(policy, 1)), bool)
        if found.shape[1] == 1:
            found[:] = True
            return found
        rows = np.arange(len(z))
        for number in self.numbers(policy, block):
            tau, splitters = self.tau[policy, number], self.splitters(policy, number)
            if (tau == tau[0]).all():  # one order for all columns
                tau, splitters = tau[:1], splitters[:, :1]
            for s, scores in zip(splitters.T, np.ascontiguousarray(_Scored(z, tau).p(1).T)):
                found[rows, np.searchsorted(s[1:-1], scores, "right")] = True
        return found

    def splitters(self, policy: str, number: int) -> np.ndarray:
        """The scores that part the ranges of each column; one more row than ranges, from minus to plus infinity."""
        key = (policy, number)
        if key not in self._splitters:
            k, tau = self.ranges.get(policy, 1), self.tau[key]
            inner = np.zeros((0, len(tau)))
            if k > 1:
                scores = np.sort(_Scored(self.samples[policy], tau).p(1), axis=0)
                inner = scores[np.arange(1, k) * len(scores) // k]
            self._splitters[key] = np.vstack([np.full(len(tau), -np.inf), inner, np.full(len(tau), np.inf)])
        return self._splitters[key]


class _Scored:
    """Probabilities of cells (rows) under temperatures (columns)."""

    def __init__(self, z: np.ndarray, tau: np.ndarray):
        z = z - z.max(1, keepdims=True)
        b = np.exp(-tau)
        self.e = [np.exp(z[:, k, None] * b) for k in range(3)]
        self.total = self.e[0] + self.e[1] + self.e[2]

    def p(self, k: int) -> np.ndarray:
        return self.e[k] / self.total


def _packed(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> bytes:
    """Cells in few bytes: like bytes of the logits stand together, and weights are small numbers."""
    planes = np.ascontiguousarray(z).view(np.uint8).reshape(len(z), -1).T
    return _codec.compress(planes.tobytes() + y.tobytes() + w.tobytes(), asbytes=True)


def _unpacked(raw: bytes, n: int, replicates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.dtype(np.float64).itemsize * len(LOGITS)
    found = np.frombuffer(_codec.decompress(raw, n * (size + 1 + replicates), asbytes=True), np.uint8)
    z, y, w = np.split(found, [n * size, n * (size + 1)])
    return np.ascontiguousarray(z.reshape(size, n).T).view(np.float64), y, w.reshape(n, replicates)


def _pack(columns: Columns):
    """(policy, block, range, n, cells): the cells of a batch, packed, for each block of replicates and range."""
    blocks = sorted({block for _, _, block in columns.blocks})

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            z, y = pdf[LOGITS].to_numpy(np.float64), pdf["state_id"].to_numpy(np.uint8)
            of = pdf.reset_index(drop=True).groupby("policy", sort=False).indices
            for block in blocks:
                w = _weights_of(columns.seed, pdf["unit"], *columns.span(block)).astype(np.uint8)
                out = []
                for policy, at in of.items():
                    for r, inside in enumerate(columns.hit(policy, block, z[at]).T):
                        if len(own := at[inside]):
                            out.append((policy, block, r, len(own), _packed(z[own], y[own], w[own])))
                yield pd.DataFrame(out, columns=["policy", "block", "range", "n", "cells"])

    return pack


def won_pairs(score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """Weighted pairs of a positive above a negative, in each column of weights if there are several; of equal scores one half."""
    order = np.argsort(score)  # equal scores are summed, so their order is free
    score, pos, neg = score[order], pos[order], neg[order]
    edge = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
    p, n = np.add.reduceat(pos, edge), np.add.reduceat(neg, edge)
    return (p * (np.cumsum(n, axis=0) - n / 2)).sum(0)


def _judge(columns: Columns, bins: int):
    """Sums of one policy, block of replicates and range for each column."""
    edges = np.arange(1, bins) / bins

    def judge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        policy, block, r = key
        first, last = columns.span(block)
        z, y, w_all = (np.concatenate(x) for x in zip(*[_unpacked(raw, n, last - first) for raw, n in zip(pdf["cells"], pdf["n"])]))
        found = [(policy, number, r, *sums(policy, number, r, z, y.astype(np.int64), w_all)) for number in columns.numbers(policy, block)]
        return pd.DataFrame(found, columns=["policy", "number", "range", "gap", "total", "nll", "pos", "neg", "won"])

    def sums(policy: str, number: int, r: int, z: np.ndarray, y: np.ndarray, w_all: np.ndarray) -> list[list[float]]:
        tau, splitters = columns.tau[policy, number], columns.splitters(policy, number)
        z = np.ascontiguousarray((z - z.max(1, keepdims=True)).T)
        right, label = z[y, np.arange(len(y))], y
        hit, one_order = z.argmax(0) == y, (tau == tau[0]).all()
        weight = np.ascontiguousarray(w_all.T)
        found = {c: np.zeros(len(tau)) for c in ("total", "nll", "pos", "neg", "won")}
        gap = np.zeros((bins, len(tau)))
        for c, (b, low, high) in enumerate(zip(np.exp(-tau), splitters[r], splitters[r + 1])):
            at = np.flatnonzero(weight[c])
            e = np.exp(z[:, at] * b)
            total = e[0] + e[1] + e[2]
            score = e[1] / total
            inside = np.flatnonzero((score >= low) & (score < high))
            if not len(inside):
                continue
            at, score, conf = at[inside], score[inside], 1.0 / total[inside]  # the greatest power is 1
            w, y = weight[c, at].astype(np.float64), label[at]
            found["total"][c] = w.sum()
            found["nll"][c] = -(w * np.log(np.maximum(np.exp(right[at] * b) * conf, 1e-12))).sum()
            gap[:, c] = np.bincount(np.searchsorted(edges, conf, "right"), w * (hit[at] - conf), bins)
            own = np.flatnonzero(y < 2)
            pos = w[own] * y[own]
            neg = w[own] - pos
            found["pos"][c], found["neg"][c] = pos.sum(), neg.sum()
            if len(own) and not one_order:
                found["won"][c] = won_pairs(score[own], pos, neg)
        if one_order and len(own := np.flatnonzero(label < 2)):  # one order for all columns, as of raw scores
            e = np.exp(z[:, own] * np.exp(-tau[0]))
            score = e[1] / (e[0] + e[1] + e[2])
            inside = (score >= splitters[r, 0]) & (score < splitters[r + 1, 0])
            pos = w_all[own[inside]] * (label[own[inside]] == 1)[:, None].astype(np.float64)
            if len(pos):
                found["won"] = won_pairs(score[inside], pos, w_all[own[inside]] - pos)
        return [x.reshape(-1).tolist() for x in (gap, *found.values())]

    return judge


def evaluate(test: DataFrame, unit: str, columns: Columns, bins: int = metrics.BINS) -> DataFrame:
    """policy, budget, method, replicate, log_t, ece, nll, auroc; a metric without its weight is null."""
    rows = saved(test.where("state_id IS NOT NULL").select(F.col(unit).alias("unit"), "policy", "state_id", *LOGITS))
    for r in rows.groupBy("policy").agg(F.count("*").alias("n")).collect():  # a row a policy
        columns.ranges[r["policy"]] = max(1, min(MAX_RANGES, max(-(-r["n"] // RANGE), min(SHARED, r["n"] // SHARED_CELLS))))
    large = {p: k for p, k in columns.ranges.items() if k > 1}
    if large:
        counts = {r["policy"]: r["n"] for r in rows.groupBy("policy").agg(F.count("*").alias("n")).collect()}
        share = F.create_map(*[x for p, k in large.items() for x in (F.lit(p), F.lit(int(1e6 * min(1.0, PER_RANGE * k / counts[p]))))])
        drawn = rows.where(F.pmod(F.xxhash64("unit", "policy"), F.lit(1_000_000)) < share[F.col("policy")])
        found = drawn.select("policy", *LOGITS).toPandas()  # about PER_RANGE rows a range
        columns.samples.update({p: own[LOGITS].to_numpy(np.float64) for p, own in found.groupby("policy")})
        for p in large:
            columns.ranges[p] = min(large[p], max(1, len(columns.samples.get(p, ()))))
    kinds = {c: "array<double>" for c in ("gap", "total", "nll", "pos", "neg", "won")}
    schema = "policy string, number int, range int, " + ", ".join(f"{c} {k}" for c, k in kinds.items())
    packed = rows.mapInPandas(_pack(columns), "policy string, block int, range int, n int, cells binary")
    groups = sum(columns.ranges.values()) * len({block for _, _, block in columns.blocks})
    packed = packed.repartition(max(1, 2 * groups), "policy", "block", "range")  # little to read and much to do: else Spark would put groups together by their size
    judged = packed.groupBy("policy", "block", "range").applyInPandas(_judge(columns, bins), schema)

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        policy, number = key
        budget, method, _ = columns.blocks[number]
        pdf = pdf.sort_values("range")
        s = {c: np.stack(pdf[c].to_list()) for c in kinds}
        below = np.cumsum(s["neg"], 0) - s["neg"]
        won = (s["won"] + s["pos"] * below).sum(0)
        total, pos, neg = (s[c].sum(0) for c in ("total", "pos", "neg"))
        tau = columns.tau[policy, number]
        with np.errstate(divide="ignore", invalid="ignore"):
            ece = np.abs(s["gap"].sum(0).reshape(bins, -1)).sum(0) / total
            out = {"ece": ece, "nll": s["nll"].sum(0) / total, "auroc": won / (pos * neg)}
        out = {c: [None if math.isnan(x) or math.isnan(t) else x for x, t in zip(v.tolist(), tau.tolist())] for c, v in out.items()}
        first, last = columns.span(columns.blocks[number][2])
        table = pd.DataFrame({"policy": policy, "budget": budget, "method": method, "replicate": np.arange(first + 1, last + 1), "log_t": [None if math.isnan(t) else t for t in tau.tolist()], **out})
        return table.astype({c: "float64" for c in ("log_t", "ece", "nll", "auroc")})

    return judged.groupBy("policy", "number").applyInPandas(finish, "policy string, budget int, method string, replicate int, log_t double, ece double, nll double, auroc double")


def two_stage(calib: DataFrame, test: DataFrame, unit: str, budgets: list[int], seed: str, replicates: int, bins: int = metrics.BINS) -> DataFrame:
    """policy, budget, method (raw with budget 0, global, policy, shrunk), replicate, log_t, ece, nll, auroc.

    The two samples are resampled apart; the same replicate number pairs them. A policy without
    calibration cells has raw rows only. The driver holds a number for each policy and column.
    """
    fitted = temperatures(calib, unit, budgets, f"{seed}-calib", replicates).collect()
    policies = [r["policy"] for r in test.select("policy").distinct().collect()]
    spans = range(-(-replicates // REPLICATES))
    blocks = [(0, "raw", b) for b in spans] + [(n, m, b) for n in sorted(budgets) for m in METHODS for b in spans]
    place = {x: k for k, x in enumerate(blocks)}
    columns = Columns(f"{seed}-test", replicates, REPLICATES, blocks, {})
    for p in policies:
        for b in spans:
            columns.tau[p, place[0, "raw", b]] = np.zeros(min(REPLICATES, replicates - b * REPLICATES))
    for r in fitted:
        columns.tau[r["policy"], place[r["budget"], r["method"], r["block"]]] = np.array(r["log_t"], np.float64)
    return evaluate(test, unit, columns, bins)
