"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import new_folder, saved

__all__ = ["materialize", "new_folder", "numbered"]


def local_view(path: str) -> str | None:
    """The plain path of a shared folder that is mounted as files, else None."""
    url = urlparse(path)
    return url.path if url.scheme in ("", "file") else None


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new shared folder and read it back, which cuts its lineage."""
    return saved(df, name)


@dataclass(frozen=True)
class Numbered:
    """Rows (number, first, doc_id, text, row) of a table, numbered apart in the order of doc_id; row holds all columns.

    Where every row has a doc_id of its own, that is its number. Else rows are numbered from 0 in the order of
    doc_id, those without one last; first is the least number of the rows with the same doc_id.
    """

    rows: DataFrame
    plain: bool

    @property
    def firsts(self) -> DataFrame | None:
        """(doc_id, own): each number with the first of its doc_id, where they may differ."""
        return None if self.plain else self.rows.select(F.col("number").alias("doc_id"), F.col("first").alias("own"))

    def named(self, found: DataFrame, *columns: str) -> DataFrame:
        """found with doc_ids in place of the numbers in its columns."""
        if self.plain:
            return found
        names = found.columns
        for c in columns:
            known = self.rows.select(F.col("number").alias(c), F.col("doc_id").alias("_named"))
            found = found.join(known, c).drop(c).withColumnRenamed("_named", c)
        return found.select(*names)


def numbered(docs: DataFrame) -> Numbered:
    """Number the rows of docs; only where doc_ids repeat or are missing is the table sorted and stored."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    seen = row.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n"), F.count_if(F.col("doc_id").isNull())).first()
    if (seen[0] or 1) == 1 and not seen[1]:
        number = F.col("doc_id")
        return Numbered(row.select(number.alias("number"), number.alias("first"), "doc_id", "text", "row"), True)
    # a doc_id of many rows is split between parts by its texts and by the rows' places in the input
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.col("salt")]
    salted = row.withColumn("salt", F.monotonically_increasing_id())
    placed = salted.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt").withColumn("at", F.monotonically_increasing_id())
    stored = materialize(placed, "numbered").withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    cells = stored.groupBy("part", "doc_id").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    parts = cells.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a part
    cells = cells.join(parts.select("part", before.alias("before")), "part")
    cells = cells.select("part", "doc_id", "before", F.min(F.col("before") + F.col("low")).over(Window.partitionBy("doc_id")).alias("first"))
    on = (F.col("s.part") == F.col("c.part")) & F.col("s.doc_id").eqNullSafe(F.col("c.doc_id"))
    joined = stored.alias("s").join(cells.alias("c"), on)
    return Numbered(materialize(joined.select((F.col("before") + F.col("at")).alias("number"), "first", "s.doc_id", "text", "row"), "numbered"), False)
