"""Toxicity by class-conditional Kneser-Ney models, with a logistic curve.

Two models of order ``ORDER`` over the bytes of words, one learned from toxic and one from
ordinary documents. An expression (a byte and the ORDER - 1 before it in its word, begin and
end marked) is counted by its occurrences, but those of the one document of a class that says it most
often count as one: a word that a single text repeats tells little, one that several texts
repeat tells much. Each class has

    P(b | h) = (max(c(hb) - D, 0) + D * types(h) * Q(b | h')) / c(h)

with the discount D estimated from its counts, and both share the backoff Q: an interpolated
Kneser-Ney model one order lower from the continuation counts of both classes together, the
numbers of different bytes before an expression, down to single bytes. So a rare expression
is smoothed alike under both and tells little, and one that neither class holds tells only
how much of its context's mass each class leaves to the backoff.

A text's evidence is the difference of its toxic and ordinary log-likelihoods divided by its
words, and the parts of that difference from words that alone exceed ``TELLING`` and ``STRONG``: the plain
difference drifts with the language, those parts do not. A logistic curve of the three,
fitted on labelled documents that the models have not seen, gives a score from 0 to 1.

Counting and smoothing are joins and aggregates over the table of expressions; the sorted
table of differences is stored in the shared folder and memory-mapped by workers.

Bounds: at most ``MAX_DOCUMENTS`` documents a class are learned from and at most
``MAX_CURVE`` evidence values reach the driver for the curve, all drawn by a hash of the
id; with no toxic or no ordinary training document every score is 0.

Inputs of a score are the text's words alone, with A-Z in lower case. Defined results: a
null or empty text has evidence 0; repeated rows score alike, rows without a doc_id too, and
these have no labels; an empty table gives no rows;
columns other than doc_id, text and the labels' doc_id and toxic are ignored; null labels
do not count; of repeated labels of a document the greatest holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import materialize, new_folder
from ._store import find_sorted, read_part, write_part
from ._text import LOWER, hash_spans, ragged, slices, sums, word_spans

MAX_DOCUMENTS = 20_000
MAX_CURVE = 50_000
#: Bytes of an expression; at most 7, so that one is a positive integer.
ORDER = 7
BEGIN, END = 1, 2
#: Expressions of one stored part, about, and the number that deals them.
PART, PRIME = 500_000, 1_000_003
#: Log-likelihood differences of a word that is told apart from its text's general drift.
TELLING, STRONG = 4.0, 8.0
FEATURES = ("evidence", "telling", "strong")
THRESHOLD = 0.3
#: Bytes of text that are worked on at once.
SLICE = 1 << 18
#: Expressions that a task holds before it merges them.
PENDING = 1_000_000


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never used."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


@dataclass(frozen=True)
class Model:
    folder: str
    parts: int  # 0 without documents of both classes
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, float("-inf"))

    @property
    def usable(self) -> bool:
        return self.parts > 0


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row's first words, each word's place among the distinct words, their expressions, their first expressions)."""
    low = LOWER[buf]
    starts, ends, first = word_spans(low, offsets)
    _, index, place = np.unique(hash_spans(low, starts, ends), return_index=True, return_inverse=True)
    begin, length = starts[index], ends[index] - starts[index]
    size = length + ORDER  # with ORDER - 1 begin marks and one end mark
    at = np.cumsum(size) - size
    marked = np.full(int(size.sum()) + ORDER, BEGIN, np.int64)
    marked[ragged(np.arange(len(marked)), at + ORDER - 1, length)] = ragged(low, begin, length)
    marked[at + size - 1] = END
    whole = np.zeros(len(marked) - ORDER, np.int64)
    for k in range(ORDER):
        whole = whole << 8 | marked[k : k + len(whole)]
    n = length + 1
    return first, place, ragged(whole, at, n), np.concatenate([[0], np.cumsum(n)])


def _merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct expressions with the sums of the first two columns and the greatest of the other two."""
    key = np.concatenate([x[0] for x in held])
    order = np.argsort(key, kind="stable")
    key = key[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    columns = [np.concatenate([x[k] for x in held])[order] for k in range(1, 5)]
    return key[edge], *[np.add.reduceat(c, edge) for c in columns[:2]], *[np.maximum.reduceat(c, edge) for c in columns[2:]]


def _count(rows: DataFrame) -> DataFrame:
    """(gram, ordinary, toxic): occurrences of an expression in each class, those of the document with most of them as one."""
    names = ["gram", "ordinary", "toxic", "most_ordinary", "most_toxic"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for a, b, buf, off in slices(batch.column("text"), SLICE):
                first, place, grams, at = _words(buf, off)
                if not len(place):
                    continue
                row = np.repeat(np.arange(b - a), np.diff(first))
                pairs, times = np.unique(row * (len(at) - 1) + place, return_counts=True)
                row, word = pairs // (len(at) - 1), pairs % (len(at) - 1)
                distinct, number = np.unique(grams, return_inverse=True)
                n = np.diff(at)[word]
                each, own = np.unique(np.repeat(row, n) * len(distinct) + ragged(number, at[word], n), return_inverse=True)
                said = np.bincount(own, np.repeat(times, n)).astype(np.int64)
                is_toxic, seen = toxic[a:b][each // len(distinct)] == 1, each % len(distinct)
                sums_, most = [], []
                for k in (False, True):
                    of = is_toxic == k
                    sums_.append(np.bincount(seen[of], said[of], len(distinct)).astype(np.int64))
                    most.append(np.zeros(len(distinct), np.int64))
                    np.maximum.at(most[-1], seen[of], said[of])
                held.append((distinct, *sums_, *most))
                if sum(len(x[0]) for x in held) > PENDING:
                    held = [_merged(held)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(held)], names)

    counted = rows.select("text", "toxic").mapInArrow(count, ", ".join(f"{c} long" for c in names))
    totals = counted.groupBy("gram").agg(*[F.sum(c).alias(c) for c in names[1:3]], *[F.max(c).alias(c) for c in names[3:]])
    return totals.select("gram", *[(F.col(c) - F.col(f"most_{c}") + F.least(F.col(f"most_{c}"), F.lit(1))).alias(c) for c in names[1:3]])


def _discounts(table: DataFrame, *columns: str) -> list[float]:
    """n1 / (n1 + 2 n2) of each column of counts."""
    seen = table.agg(*[F.count_if(F.col(c) == k) for c in columns for k in (1, 2)]).first()
    return [min(max(a / (a + 2 * b) if a else 0.5, 0.05), 0.95) for a, b in zip(seen[::2], seen[1::2])]


def _context(gram: str = "gram") -> Column:
    return F.shiftright(gram, 8)


def _shorter(gram: Column, order: int) -> Column:
    """The last bytes of an expression."""
    return gram.bitwiseAND(F.lit((1 << 8 * order) - 1))


def _backoff(grams: DataFrame) -> DataFrame:
    """(gram, p): the shared model of order ORDER - 1 from continuation counts."""
    levels = {ORDER: grams.select("gram")}
    for k in range(ORDER - 1, 0, -1):  # every different longer expression is one continuation
        levels[k] = materialize(levels[k + 1].groupBy(_shorter(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n")), "continuations")
    found = None
    for k in range(1, ORDER):
        (d,) = _discounts(levels[k], "n")
        own = levels[k].withColumn("context", _context())
        sums_ = own.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("types"))
        own = own.join(sums_, "context").withColumn("shorter", _shorter(F.col("gram"), k - 1))
        below = F.lit(1 / 257)  # any byte, or the end
        if found is not None:
            own = own.join(found.select(F.col("gram").alias("shorter"), F.col("p").alias("q")), "shorter")
            below = F.col("q")
        found = materialize(own.select("gram", ((F.greatest(F.col("n") - d, F.lit(0.0)) + d * F.col("types") * below) / F.col("total")).alias("p")), "backoff")
    return found


def count_models(rows: DataFrame) -> Model:
    """Models of rows (text, toxic 0 or 1), stored in the shared folder as differences of log-probabilities."""
    spark = rows.sparkSession
    grams = materialize(_count(rows), "expressions")
    n, *seen = grams.agg(F.count("*"), F.sum("ordinary"), F.sum("toxic")).first()
    folder, parts = new_folder(spark, "toxicity"), n // PART + 1
    if not all(seen):
        return Model(folder, 0)
    d = dict(zip(("ordinary", "toxic"), _discounts(grams, "ordinary", "toxic")))
    totals = [f(c).alias(f"{name}_{c}") for c in d for name, f in (("total", F.sum), ("types", lambda c: F.count_if(F.col(c) > 0)))]
    contexts = materialize(grams.groupBy(_context().alias("context")).agg(*totals), "contexts")
    total = lambda c: F.col(f"total_{c}")
    left = {c: F.when(total(c) > 0, d[c] * F.col(f"types_{c}") / total(c)).otherwise(1.0) for c in d}
    lower = _backoff(grams).select(F.col("gram").alias("shorter"), "p")
    each = grams.withColumns({"context": _context(), "shorter": _shorter(F.col("gram"), ORDER - 1)}).join(contexts, "context").join(lower, "shorter")
    of = {c: F.greatest(F.col(c) - d[c], F.lit(0.0)) / F.greatest(total(c), F.lit(1)) + left[c] * F.col("p") for c in d}
    told = each.select(F.lit("grams").alias("kind"), F.col("gram").alias("key"), F.log(of["toxic"] / of["ordinary"]).alias("told"))
    told = told.unionByName(contexts.select(F.lit("contexts").alias("kind"), F.col("context").alias("key"), F.log(left["toxic"] / left["ordinary"]).alias("told")))

    def store(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, kind, part = pdf.sort_values("key"), pdf["kind"].iloc[0], int(pdf["part"].iloc[0])
        write_part(folder, kind, part, pdf["key"].to_numpy())
        write_part(folder, f"{kind}-told", part, pdf["told"].to_numpy())
        return pd.DataFrame({"kind": [kind], "part": [part]})

    dealt = told.withColumn("part", F.pmod(F.pmod("key", F.lit(PRIME)), F.lit(parts)).cast("int"))
    blank = spark.range(parts).select(F.explode(F.array(F.lit("grams"), F.lit("contexts"))).alias("kind"), F.col("id").cast("int").alias("part"))
    have = dealt.groupBy("kind", "part").applyInPandas(store, "kind string, part int")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        """Every part gets its file, also one without expressions."""
        for kind, part in pdf[["kind", "part"]].itertuples(index=False):
            write_part(folder, kind, int(part), np.zeros(0, np.int64))
            write_part(folder, f"{kind}-told", int(part), np.zeros(0))
        return pdf

    blank.join(materialize(have, "stored"), ["kind", "part"], "left_anti").groupBy("part").applyInPandas(fill, "kind string, part int").count()
    return Model(folder, parts)


def _told(model: Model, kind: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stored difference, whether there is one) of ascending keys."""
    part = keys % PRIME % model.parts
    order = np.argsort(part, kind="stable")
    found = find_sorted(model.folder, kind, part[order], keys[order])
    out, has = np.zeros(len(keys)), np.zeros(len(keys), bool)
    for k in np.unique(part).tolist():
        own = (part[order] == k) & (found >= 0)
        out[order[own]] = read_part(model.folder, f"{kind}-told", k)[found[own]]
        has[order[own]] = True
    return out, has


def evidence_of(model: Model, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """FEATURES of each row: toxic minus ordinary log-likelihood per word, and the parts of words beyond TELLING and STRONG."""
    first, place, grams, at = _words(buf, offsets)
    n = np.diff(first)
    if not model.usable or not len(place):
        return np.zeros((len(n), len(FEATURES)))
    distinct, number = np.unique(grams, return_inverse=True)
    told, has = _told(model, "grams", distinct)
    rest = np.flatnonzero(~has)  # the backoff is the same under both: what is left of the masses stays
    told[rest] = _told(model, "contexts", distinct[rest] >> 8)[0]
    each = sums(told[number], at)[place]
    return np.column_stack([sums(np.where(each > least, each, 0.0), first) for least in (-np.inf, TELLING, STRONG)]) / np.maximum(n, 1)[:, None]


def evidence(docs: DataFrame, model: Model, keep: str = "doc_id long") -> DataFrame:
    """Column keep and the FEATURES of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in slices(batch.column(1), SLICE):
                found = evidence_of(model, buf, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(c.copy()) for c in found.T]], [keep.split()[0], *FEATURES])

    return docs.mapInArrow(rows, ", ".join([keep, *[f"{c} double" for c in FEATURES]]))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of the columns of x and an offset: logistic regression by Newton steps with a little ridge."""
    k = x.shape[1]
    if not len(x) or y.min() == y.max():
        share = float(y.mean()) if len(x) else 0.5
        return *(0.0,) * k, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    scale = np.where(x.std(0) > 0, x.std(0), 1.0)
    design = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(k + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(k + 1), design.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return *(float(v) for v in w[:k] / scale), float(w[k])


def _draw(rows: DataFrame, n: int, most: int) -> DataFrame:
    """About most of n rows by a hash of the id."""
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * most / n))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Models from two folds of the labelled rows outside held_out, the curve from the third."""
    labelled = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    curve_fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 3
    labelled = labelled.withColumn("fold", curve_fold)
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in labelled.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    drawn = [_draw(labelled.where(~F.col("fold") & (F.col("toxic") == k)), sizes.get((False, k), 0), MAX_DOCUMENTS) for k in (0, 1)]
    drawn.append(_draw(labelled.where("fold"), sum(n for (f, _), n in sizes.items() if f), MAX_CURVE))
    # the draws bound this table, so it is broadcast and no text is moved
    picked = F.broadcast(materialize(drawn[0].unionByName(drawn[1]).unionByName(drawn[2]), "labels"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(picked, "doc_id")
    model = count_models(rows.where(~F.col("fold")))
    if not model.usable:
        return model
    seen = evidence(rows.where("fold").select("toxic", "text"), model, "toxic int").toPandas()
    curve = _curve(seen[list(FEATURES)].to_numpy(), seen["toxic"].to_numpy(float))
    return replace(model, curve=curve)


def _score(model: Model) -> Column:
    if not model.usable:
        return F.lit(0.0)
    *weights, offset = model.curve
    return 1 / (1 + F.exp(-sum((F.lit(w) * F.col(c) for w, c in zip(weights, FEATURES)), F.lit(offset))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, evidence, score, predicted of every row."""
    rows = evidence(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model)
    return rows.withColumn("score", _score(model)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    columns = docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            found = np.concatenate([np.zeros((0, len(FEATURES))), *[evidence_of(model, buf, off) for _, _, buf, off in slices(text, SLICE)]])
            stays = 1 / (1 + np.exp(-(found @ np.array(model.curve[:-1]) + model.curve[-1]))) < THRESHOLD
            yield batch.filter(pa.array(stays))

    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(rows, docs.schema) if model.usable else docs
