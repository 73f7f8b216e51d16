"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document: ``ledger`` keeps the measurements and one
``fail_bits`` integer. A policy is a named, versioned set of rules; applying one, comparing
several and asking what each rule alone removes are bitwise tests on the ledger, so no text
is read again.

All measurements are made inside a row, with array functions, so nothing is shuffled.
A five-word window is compared by hash first; only documents with two equal hashes compare
the windows' words, so hash collisions cannot change a result.

Defined results: a null text is the empty text (no words, fails ``few_words``); repeated
rows are each judged; an empty table gives an empty ledger; further columns of the input
are dropped, and none of its columns but doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document fails if the condition over the measurement columns holds."""

    name: str
    fails: Callable[[], Column]


@dataclass(frozen=True)
class Policy:
    """A version of the policy: documents that fail none of its rules are kept."""

    version: str
    rules: tuple[str, ...]


#: The place of a rule is its bit; append only, so that old ledgers stay readable.
RULES = (
    Rule("few_words", lambda: F.col("n_words") < 10),
    Rule("repeated_words", lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    Rule("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("repeated_lines", lambda: 2 * F.col("n_dup_lines") > F.col("n_lines")),
    Rule("capitals", lambda: 10 * F.col("n_capitals") > 3 * F.col("word_chars")),
    Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
)
BASE = Policy("base", ("few_words", "repeated_words"))
STANDARD = Policy("2", ("few_words", "repeated_words", "symbols", "repeated_lines", "capitals", "word_length"))
BIT = {rule.name: 1 << k for k, rule in enumerate(RULES)}


def mask(policy: Policy) -> int:
    return sum(BIT[name] for name in policy.rules)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _covered(words: Column, n: Column) -> Column:
    """Word positions inside windows that occur twice or more, by the windows' own words."""
    spans = F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)),
        lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("g"), i.alias("p")),
    )

    def positions(s: Column) -> Column:
        repeated = F.filter(
            s,
            lambda x, i: ((i > 0) & (F.get(s, i - 1)["g"] == x["g"])) | ((i < F.size(s) - 1) & (F.get(s, i + 1)["g"] == x["g"])),
        )
        return F.sort_array(F.transform(repeated, lambda x: x["p"]))

    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end"))
    step = lambda acc, p: F.struct(
        (acc["total"] + F.least(F.lit(WINDOW), p + WINDOW - acc["end"])).alias("total"), (p + WINDOW).alias("end")
    )
    return F.aggregate(_let(F.sort_array(spans), positions), start, step, lambda acc: acc["total"])


def _bind(rows: DataFrame, **values: Column) -> DataFrame:
    """rows with columns that are evaluated once a row, whatever later filters and columns read them.

    A generator of one row keeps them apart: the optimizer neither repeats its input in what
    stands above it nor moves a filter on its output below it.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text_"))
    text = F.col("text_")
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = _bind(rows, words_=words, lines_=lines)
    words, n = F.col("words_"), F.size("words_")
    hashes = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = _bind(rows, hashes_=hashes)
    repeats = F.size(F.array_distinct("hashes_")) < F.size("hashes_")
    length = lambda c: F.length(c).cast("long")
    measured = _bind(
        rows,
        n_words=n.cast("long"),
        word_chars=length(F.regexp_replace(text, SPACE, "")),
        n_symbols=length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")),
        n_lines=F.size("lines_").cast("long"),
        n_dup_lines=(F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"),
        n_repeat_words=F.when(repeats, _covered(words, n)).otherwise(F.lit(0).cast("long")),
        n_capitals=length(F.regexp_replace(text, r"[^A-Z]+", "")),
    )
    return measured.drop("text_", "words_", "lines_", "hashes_")


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements and fail_bits: bit k is set if the document fails rule k."""
    bits = [F.when(rule.fails(), 1 << k).otherwise(0) for k, rule in enumerate(rules)]
    combined = bits[0]
    for bit in bits[1:]:
        combined = combined.bitwiseOR(bit)
    return measure(docs).withColumn("fail_bits", combined)


def passes(policy: Policy) -> Column:
    """Whether a ledger row fails no rule of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def apply_policies(entries: DataFrame, policies: list[Policy]) -> DataFrame:
    """The ledger with a column kept_<version> for each policy."""
    return entries.withColumns({f"kept_{p.version}": passes(p) for p in policies})


def ablations(entries: DataFrame, policies: list[Policy]) -> DataFrame:
    """Per policy and rule: rows that fail it, rows that fail nothing else, and rows kept without it.

    The ledger is first counted by fail_bits, at most 2**len(RULES) rows.
    """
    spark = entries.sparkSession
    cases = F.array(*[F.struct(F.lit(p.version).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(p)).alias("mask"), F.lit(BIT[r]).alias("bit")) for p in policies for r in p.rules])
    patterns = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    each = patterns.select("fail_bits", "n", F.inline(cases))
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    seen = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return each.groupBy("policy", "rule").agg(
        of(seen.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        of(seen == F.col("bit")).alias("n_failed_only_this"),
        of(seen.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
        of(seen == 0).alias("n_kept"),
    )


def keep(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The rows of docs that pass the policy, with all their columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    inner = docs.select(row.alias("doc_id"), F.col("text"))
    judged = ledger(inner).where(passes(policy))
    return judged.select(*[F.col("doc_id")[c].alias(c) for c in docs.columns])
