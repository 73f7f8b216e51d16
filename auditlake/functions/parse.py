"""Judge replies: strict JSON parsing with all key problems reported, as Arrow-batched functions.

The reply is cut from the first { to the last }; the whole cut must be valid JSON. Spark's own
parser accepts single quotes and keeps the last of duplicate keys, so it cannot tell them.
"""

from __future__ import annotations

import json
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, StringType, StructField, StructType

from .text import STATES

PARSED = StructType(
    [
        StructField("cells", MapType(StringType(), StringType())),
        StructField("missing", ArrayType(StringType())),
        StructField("extra", ArrayType(StringType())),
        StructField("duplicate", ArrayType(StringType())),
        StructField("invalid", ArrayType(StringType())),
        StructField("json_object_found", BooleanType()),
        StructField("strict", BooleanType()),
    ]
)


def _pairs(text: str | None) -> tuple[list, bool]:
    """(key and value pairs of the object from the first { to the last }, whether there is one)."""
    if not text or "{" not in text or "}" not in text[text.index("{") :]:
        return [], False
    try:
        loaded = json.loads(text[text.index("{") : text.rindex("}") + 1], object_pairs_hook=_Object)
    except (ValueError, RecursionError):
        return [], False
    return (list(loaded), True) if isinstance(loaded, _Object) else ([], False)


class _Object(list):
    """The pairs of a JSON object, repeated keys included."""


def _state(value, aliases: dict[str, str]) -> str | None:
    """A label's state, as functions.text.normalize_label gives it."""
    return aliases.get(value.strip().lower().replace("-", "_").replace(" ", "_")) if isinstance(value, str) else None


def parse_reply(text: str | None, expected: tuple[str, ...], aliases: dict[str, str]) -> dict:
    """Every uniquely present valid cell, and the keys that are missing, extra, duplicate or invalid."""
    pairs, found = _pairs(text)
    counts = Counter(k for k, _ in pairs)
    given = {k: _state(v, aliases) for k, v in pairs}
    cells = {k: given[k] for k in expected if counts[k] == 1 and given[k]}
    extra = sorted(k for k in counts if k not in expected)
    duplicate = [k for k in expected if counts[k] > 1] + [k for k in extra if counts[k] > 1]
    return {
        "cells": cells, "missing": [k for k in expected if not counts[k]], "extra": extra, "duplicate": duplicate,
        "invalid": [k for k in expected if counts[k] == 1 and not given[k]], "json_object_found": found,
        "strict": len(cells) == len(expected) and not extra,
    }


def parse_cells(text: Column, expected: tuple[str, ...], aliases: dict[str, str] | None = None) -> Column:
    """Partial recovery: PARSED of each reply. aliases: accepted spellings of the states."""
    known = aliases or dict(zip(STATES, STATES))

    @F.pandas_udf(PARSED)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_reply(t, expected, known) for t in texts], columns=PARSED.names)

    return run(text)


def parse_labels(text: Column, expected: tuple[str, ...], aliases: dict[str, str] | None = None) -> Column:
    """All-or-nothing: the map of labels if every expected key is present and valid, else null.

    Other keys may be there; of a repeated key the last counts.
    """
    known = aliases or dict(zip(STATES, STATES))

    @F.pandas_udf(MapType(StringType(), StringType()))
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            given = {k: _state(v, known) for k, v in _pairs(t)[0]}
            labels = {k: given.get(k) for k in expected}
            out.append(labels if all(labels.values()) else None)
        return pd.Series(out, dtype=object)

    return run(text)


def parse_flags(text: Column, expected: tuple[str, ...]) -> Column:
    """Strict boolean categories: the map of flags if the keys are exactly the expected ones, each once and true or false, else null."""

    @F.pandas_udf(MapType(StringType(), BooleanType()))
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            pairs = _pairs(t)[0]
            exact = sorted(k for k, _ in pairs) == sorted(expected) and all(isinstance(v, bool) for _, v in pairs)
            out.append(dict(pairs) if exact else None)
        return pd.Series(out, dtype=object)

    return run(text)
