"""JSON lines, worksheets and frozen outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import escape_formula

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: StructType, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(good rows, violations (key, reason, n)): blank and invalid lines, missing, empty and duplicate keys.

    Only lines of one JSON object are rows; every row of a duplicate key is a violation.
    """
    full = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    parsed = lines.select("line", F.from_json("line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("x"))
    bad = F.col(f"x.{CORRUPT}").isNotNull() | ~F.col("line").startswith("{") | F.col("x").isNull()
    reason = F.when(F.col("line") == "", "blank line").when(bad, "invalid line").when(F.col(f"x.{key}").isNull(), "missing key").when(F.col(f"x.{key}") == "", "empty key")
    judged = parsed.select("x.*", reason.alias("reason"))
    twice = judged.where("reason IS NULL").groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    good = judged.where("reason IS NULL").drop("reason", CORRUPT).join(twice.select(F.col("key").alias(key)), key, "left_anti").select(*schema.names)
    found = judged.where("reason IS NOT NULL").groupBy(F.when(F.col("reason").isin("missing key", "empty key"), F.col(key)).alias("key"), "reason").agg(F.count("*").alias("n"))
    return good, found.unionByName(twice.select("key", F.lit("duplicate key").alias("reason"), "n"))


def read_json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A file that is one JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_once(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a frozen output; an existing one is an error."""
    df.write.mode("errorifexists").format(kind).save(path)


def write_worksheet(df: DataFrame, path: str, text_columns: list[str], label: str = "label") -> None:
    """A CSV for reviewers: formulas escaped, the label column blank."""
    safe = df.withColumns({c: escape_formula(F.col(c)) for c in text_columns}).withColumn(label, F.lit(""))
    safe.write.mode("errorifexists").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_worksheet(spark: SparkSession, path: str, schema: StructType, allowed: list[str], label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(rows with trimmed lower-case labels, rows whose label is not allowed)."""
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.withColumn(label, F.lower(F.trim(label)))
    ok = F.coalesce(F.col(label).isin(allowed), F.lit(False))
    return rows.where(ok), rows.where(~ok)
