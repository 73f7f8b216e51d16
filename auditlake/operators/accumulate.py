"""Any metric under a cluster bootstrap, as an accumulator that runs where the cells are.

An accumulator says which columns it reads and how a state of arrays over replicates starts, takes
in a block of cells with their units' weights, merges with another and finishes into values. Tasks
take in their own cells and send on states; rows never multiply by replicates. Weights are those of
``bootstrap.weights``, a function of seed, unit and replicate alone, so that all metrics and groups
of one seed are paired.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bootstrap import BLOCK, weights

State = dict[str, np.ndarray]
#: Numbers that a task holds in states before it sends them on.
HELD = 1 << 23
#: Partial states of a group that one task merges; more are merged in two steps.
FAN = 64


class Accumulator(ABC):
    """A metric by additive sums; override merge for others. Each array of a state ends in the axis of replicates."""

    #: Columns of the cells that add() gets, as doubles; a null is nan.
    columns: tuple[str, ...]

    @abstractmethod
    def start(self, replicates: int) -> State: ...

    @abstractmethod
    def add(self, state: State, cells: dict[str, np.ndarray], weight: np.ndarray) -> None:
        """Take in cells; weight has a row a cell and a column a replicate."""

    def merge(self, state: State, other: State) -> None:
        for name, values in other.items():
            state[name] += values

    @abstractmethod
    def finish(self, state: State) -> dict[str, np.ndarray]:
        """Metric name: a value a replicate, nan where there is none."""


def _ratio(num: np.ndarray, den: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(den != 0, num / den, np.nan)


def _bins(score: np.ndarray, bins: int) -> np.ndarray:
    return np.searchsorted(np.arange(1, bins) / bins, score, "right")


def _spread(value: np.ndarray, place: np.ndarray, places: int) -> np.ndarray:
    """A row a place; each cell's value stands in its own."""
    out = np.zeros((places, len(value)))
    out[place, np.arange(len(value))] = value
    return out


@dataclass(frozen=True)
class Ece(Accumulator):
    bins: int = 15
    columns = ("conf", "correct", "weight")

    def start(self, replicates):
        return {"gap": np.zeros((self.bins, replicates)), "n": np.zeros(replicates)}

    def add(self, state, cells, weight):
        own = cells["weight"]
        sums = np.vstack([_spread(own * (cells["correct"] - cells["conf"]), _bins(cells["conf"], self.bins), self.bins), own]) @ weight
        state["gap"] += sums[:-1]
        state["n"] += sums[-1]

    def finish(self, state):
        return {"ece": _ratio(np.abs(state["gap"]).sum(0), state["n"])}


@dataclass(frozen=True)
class Rates(Accumulator):
    """F1, false negatives and false positives of state 1, NLL and Brier score."""

    columns = ("state_id", "pred", "p0", "p1", "p2")

    def start(self, replicates):
        return {k: np.zeros(replicates) for k in ("tp", "fp", "fn", "pos", "neg", "all", "nll", "brier")}

    def add(self, state, cells, weight):
        y, hit = cells["state_id"], cells["pred"] == 1
        p = np.stack([cells["p0"], cells["p1"], cells["p2"]])
        is_class = y == np.arange(3)[:, None]
        of = {"tp": (y == 1) & hit, "fp": (y == 0) & hit, "fn": (y == 1) & ~hit, "pos": y == 1, "neg": y == 0, "all": y >= 0}
        of |= {"nll": -np.log(np.maximum((p * is_class).sum(0), 1e-12)), "brier": ((p - is_class) ** 2).sum(0)}
        for name, values in of.items():
            state[name] += values.astype(np.float64) @ weight

    def finish(self, state):
        s = state
        down = 2 * s["tp"] + s["fp"] + s["fn"]
        f1 = np.where((s["pos"] > 0) & (s["neg"] > 0), np.where(down == 0, 0.0, _ratio(2 * s["tp"], down)), np.nan)
        return {"f1": f1, "fn_rate": _ratio(s["fn"], s["pos"]), "fp_rate": _ratio(s["fp"], s["neg"]), "nll": _ratio(s["nll"], s["all"]), "brier": _ratio(s["brier"], s["all"])}


@dataclass(frozen=True)
class WeightedMean(Accumulator):
    """Sum of one column over that of another: token-weighted KL of (log-ratio sum, tokens)."""

    num: str
    den: str
    name: str = "mean"

    @property
    def columns(self):
        return (self.num, self.den)

    def start(self, replicates):
        return {"num": np.zeros(replicates), "den": np.zeros(replicates)}

    def add(self, state, cells, weight):
        state["num"] += cells[self.num] @ weight
        state["den"] += cells[self.den] @ weight

    def finish(self, state):
        return {self.name: _ratio(state["num"], state["den"])}


@dataclass(frozen=True)
class Mismatch(Accumulator):
    """Weighted mismatch of two domains (0 and 1) and their difference."""

    columns = ("domain", "wrong", "weight")

    def start(self, replicates):
        return {"wrong": np.zeros((2, replicates)), "all": np.zeros((2, replicates))}

    def add(self, state, cells, weight):
        domain = cells["domain"].astype(np.int64)
        state["wrong"] += _spread(cells["weight"] * cells["wrong"], domain, 2) @ weight
        state["all"] += _spread(cells["weight"], domain, 2) @ weight

    def finish(self, state):
        low, high = _ratio(state["wrong"], state["all"])
        return {"low": low, "high": high, "difference": high - low}


@dataclass(frozen=True)
class StandardizedDelta(Accumulator):
    """Change of calibration error between two variants (0 and 1) under equal class shares, both ways.

    The shares, and so the class weights, are those of each replicate. A class that the
    target has and the source has not in a replicate leaves that direction without a value.
    """

    bins: int = 15
    columns = ("variant", "state_id", "conf", "correct")

    def start(self, replicates):
        return {"gap": np.zeros((6 * self.bins, replicates)), "n": np.zeros((6, replicates))}

    def add(self, state, cells, weight):
        group = (3 * cells["variant"] + cells["state_id"]).astype(np.int64)
        state["gap"] += _spread(cells["correct"] - cells["conf"], group * self.bins + _bins(cells["conf"], self.bins), 6 * self.bins) @ weight
        state["n"] += _spread(np.ones(len(group)), group, 6) @ weight

    def finish(self, state):
        gap, n = state["gap"].reshape(2, 3, self.bins, -1), state["n"].reshape(2, 3, -1)
        share = _ratio(n, n.sum(1, keepdims=True))
        plain = [_ratio(np.abs(gap[v].sum(0)).sum(0), n[v].sum(0)) for v in (0, 1)]

        def under(source, target):
            w = np.where(n[source] > 0, _ratio(share[target], share[source]), 0.0)
            found = _ratio(np.abs((w[:, None] * gap[source]).sum(0)).sum(0), (w * n[source]).sum(0))
            return np.where(((n[target] > 0) & (n[source] == 0)).any(0), np.nan, found)

        return {"forward": under(1, 0) - plain[0], "backward": plain[1] - under(0, 1)}


def rows_of(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """w[at]; without a copy where the rows follow each other, as those of a group with one cell a unit do."""
    if len(at) and at[-1] - at[0] == len(at) - 1 and (np.diff(at) == 1).all():
        return w[at[0] : at[-1] + 1]
    return w[at]


def replicated(cells: DataFrame, unit: str, keys: list[str], metric: Accumulator, seed: str, replicates: int) -> DataFrame:
    """keys, metric, replicate, value of every replicate; a value that does not exist is null."""
    kinds = dict(cells.dtypes)
    on = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    partial_schema = f"{on}, block int, task int, state binary"
    shapes = {name: values.shape[:-1] for name, values in metric.start(1).items()}

    def flat(state: State) -> bytes:
        return np.concatenate([state[n].reshape(-1) for n in shapes], dtype=np.float64).tobytes()

    def whole(sent: bytes, size: int) -> State:
        out, at, values = {}, 0, np.frombuffer(sent, np.float64)
        for name, shape in shapes.items():
            n = int(np.prod(shape, dtype=np.int64)) * size
            out[name] = values[at : at + n].reshape(*shape, size)
            at += n
        return out

    def span(block: int) -> int:
        return min(BLOCK, replicates - block * BLOCK)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() % FAN
        held: dict[tuple, State] = {}
        numbers = 0

        def sent() -> pd.DataFrame:
            rows = [[*key, block, task, flat(state)] for (key, block), state in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=[*keys, "block", "task", "state"])

        for pdf in frames:
            codes, units = pd.factorize(pdf[unit])
            groups = list(pdf.groupby(keys, sort=False, dropna=False).indices.items())
            values = {c: pdf[c].to_numpy(np.float64) for c in metric.columns}
            for block in range(-(-replicates // BLOCK)):
                w = weights(seed, units.tolist(), block * BLOCK, block * BLOCK + span(block))
                for key, at in groups:
                    place = (key if isinstance(key, tuple) else (key,), block)
                    if place not in held:
                        held[place] = metric.start(span(block))
                        numbers += sum(v.size for v in held[place].values())
                    metric.add(held[place], {c: v[at] for c, v in values.items()}, rows_of(w, codes[at]))
            if numbers > HELD:
                numbers = 0
                yield sent()
        if held:
            yield sent()

    def merged(pdf: pd.DataFrame, block: int) -> State:
        state = metric.start(span(block))
        for values in pdf["state"]:
            metric.merge(state, whole(values, span(block)))
        return state

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, flat(merged(pdf, key[-2]))]], columns=[*keys, "block", "task", "state"])

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block = key[-1]
        found = metric.finish(merged(pdf, block))
        numbers = np.arange(span(block)) + block * BLOCK + 1
        rows = [pd.DataFrame({**dict(zip(keys, key)), "metric": name, "replicate": numbers, "value": values}) for name, values in found.items()]
        return pd.concat(rows)

    rows = cells.select(unit, *keys, *[F.col(c).cast("double").alias(c) for c in metric.columns if c != unit])
    states = rows.mapInPandas(partial, partial_schema)
    states = states.groupBy(*keys, "block", "task").applyInPandas(fold, partial_schema)
    values = states.groupBy(*keys, "block").applyInPandas(finish, f"{on}, metric string, replicate int, value double")
    return values.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def of_cells(cells: DataFrame, weight: Column | None = None) -> DataFrame:
    """Labelled cells with a weight, 1 unless given."""
    return cells.where("state_id IS NOT NULL").withColumn("weight", F.lit(1.0) if weight is None else weight)
