"""Digests, ids, text normalization and label parsing as columns."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: States in their fixed order; a missing state is null.
STATES = ("satisfied", "violated", "not_applicable")


def once(rows: DataFrame, **values: Column) -> DataFrame:
    """rows with columns that are evaluated once a row, however often later columns and filters use them.

    A generator of one row stands between: the optimizer does not repeat its input above it.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def digest(*parts: Column | str) -> Column:
    """Hex sha256 of the parts joined by colons; orders and draws come from it, never from a generator."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def hex_int(text: Column, start: int, length: int) -> Column:
    """The integer of hex digits start (from 1) to start + length - 1, at most 15 digits."""
    return F.conv(F.substring(text, start, length), 16, 10).cast("bigint")


def uniform(hexdigest: Column) -> Column:
    """A number in [0, 1) from the first 52 bits, exact in double precision."""
    return hex_int(hexdigest, 1, 13) / F.lit(float(2**52))


def item_id(source: Column, prompt: Column, response: Column) -> Column:
    return F.concat(F.substring(source, 1, 4), F.lit("_"), F.substring(F.sha2(F.concat_ws("||", prompt, response), 256), 1, 16))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


#: All Unicode white space; Java's own class of it is ASCII only.
_SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def normalize_text(text: Column, composed: bool = False) -> Column:
    """Lower case, with runs of punctuation and white space as one space; composed texts skip NFKC."""
    base = text if composed else nfkc(text)
    return F.trim(F.regexp_replace(F.lower(base), rf"[\p{{P}}{_SPACE}]+", " "))


def strip_suffix(text: Column, suffixes: list[str]) -> Column:
    """The text without the longest of the suffixes that it ends with."""
    out = text
    for suffix in sorted(suffixes, key=len):
        out = F.when(text.endswith(suffix), F.expr(f"substring({_name(text)}, 1, length({_name(text)}) - {len(suffix)})")).otherwise(out)
    return out


def _name(column: Column) -> str:
    return column._jc.toString()


def shingles(text: Column, n: int = 5) -> Column:
    """The set of n-word shingles; a shorter text is one marked shingle."""
    words = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.transform(
        F.array(words),
        lambda w: F.when(F.size(w) < n, F.array(F.concat(F.lit("<short> "), F.array_join(w, " ")))).otherwise(
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " ")))
        ),
    )[0]


def normalize_label(label: Column, aliases: dict[str, str]) -> Column:
    """satisfied, violated, not_applicable or null, by an alias table."""
    key = F.translate(F.trim(F.lower(label)), "- ", "__")
    pairs = [F.lit(x) for alias, state in aliases.items() for x in (alias, state)]
    return F.element_at(F.create_map(*pairs), key)


def state_id(state: Column) -> Column:
    return F.coalesce(*[F.when(state == s, k) for k, s in enumerate(STATES)])


def latin_order(base: list[str], row: Column) -> Column:
    """The base order rotated by the row's index."""
    order = F.array(*[F.lit(x) for x in base])
    k = F.pmod(row, F.lit(len(base))).cast("int")
    return F.concat(F.slice(order, k + 1, len(base)), F.slice(order, 1, k))


def categories(flags: Column) -> Column:
    """The sorted names whose flag is true in a map of booleans."""
    return F.array_sort(F.map_keys(F.map_filter(flags, lambda _, v: v)))


def split_categories(text: Column) -> Column:
    """The trimmed, non-empty parts of a comma-separated string."""
    return F.filter(F.transform(F.split(text, ","), F.trim), lambda x: x != "")


def escape_formula(text: Column) -> Column:
    """A spreadsheet cell that cannot be taken for a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def softmax(logits: list[Column], temperature: float | Column = 1.0) -> list[Column]:
    """Stable softmax of logits over a temperature."""
    top = F.greatest(*logits)
    powers = [F.exp((z - top) / temperature) for z in logits]
    total = reduce(lambda a, b: a + b, powers)
    return [p / total for p in powers]


def argmax(values: list[Column]) -> Column:
    """Index of the greatest value; the first of equals."""
    top = F.greatest(*values)
    return F.coalesce(*[F.when(v == top, k) for k, v in enumerate(values)])


def judge_message(prompt: Column, response: Column, policies: Column, definitions: dict[str, str]) -> Column:
    """The request to judge a response under an array of policy ids, each with its definition, in the array's order."""
    known = F.create_map(*[F.lit(x) for pair in definitions.items() for x in pair])
    lines = F.array_join(F.transform(policies, lambda p: F.concat(F.lit("- "), p, F.lit(": "), F.element_at(known, p))), "\n")
    return F.concat(F.lit("Policies:\n"), lines, F.lit("\n\nPrompt:\n"), prompt, F.lit("\n\nResponse:\n"), response, F.lit("\n\nAnswer with one JSON object, a state for each policy."))
