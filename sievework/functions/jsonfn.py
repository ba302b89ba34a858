"""JSON in noisy text, and JSON columns with defaults."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def balanced(text: str | None) -> str | None:
    """The first balanced JSON object or array, preferring a fenced block; null if there is none."""
    if text is None:
        return None
    fence = text.find("```")
    if fence >= 0 and (end := text.find("```", fence + 3)) > 0:
        inner = text[fence + 3 : end]
        text = inner[4:] if inner.lower().startswith("json") else inner
    starts = [k for k in (text.find("{"), text.find("[")) if k >= 0]
    if not starts:
        return None
    at = min(starts)
    opening, closing = text[at], "}" if text[at] == "{" else "]"
    depth, quoted, escaped = 0, False, False
    for k in range(at, len(text)):
        ch = text[k]
        if quoted:
            quoted, escaped = escaped or ch != '"', ch == "\\" and not escaped
        elif ch == '"':
            quoted, escaped = True, False
        elif ch == opening:
            depth += 1
        elif ch == closing:
            depth -= 1
            if not depth:
                return text[at : k + 1]
    return None


def extract_json(c: Column) -> Column:
    """JSON text out of a model's answer: reasoning blocks and special tokens are dropped first.

    The balanced scan is no regular expression, so it runs in Arrow batches.
    """

    @F.pandas_udf("string")
    def scan(s: pd.Series) -> pd.Series:
        return s.map(balanced)

    return scan(F.regexp_replace(c, r"(?is)<think>.*?</think>|<\|[^|>]*\|>", " "))


def parsed(c: Column, schema: str, valid: Callable[[Column], Column] | None = None) -> Column:
    """struct<value, stage>: the parsed value, or the stage that failed (extract, json, schema).

    ``valid``, a condition on the value (ranges, enumerations), belongs to the schema.
    """
    text = extract_json(c)
    value = F.from_json(text, schema)
    bad = F.try_parse_json(text).isNull()
    broken = value.isNull() if valid is None else value.isNull() | ~F.coalesce(valid(value), F.lit(False))
    stage = F.when(text.isNull(), "extract").when(bad, "json").when(broken, "schema")
    return F.struct(F.when(stage.isNull(), value).alias("value"), stage.alias("stage"))


def json_or(c: Column, schema: str, default: Column) -> Column:
    """A JSON column, or the default if it is null, blank, JSON null or broken."""
    return F.coalesce(F.from_json(c, schema), default)


def envelope(rows: list[Column], key: str = "evaluations") -> Column:
    """An aggregate: the rows' columns as a JSON object that lists them under a key; batches are of bounded size."""
    return F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(*rows))).alias(key)))


def opened(c: Column, element: str, key: str = "evaluations") -> Column:
    """The elements that a JSON envelope lists; none for anything else."""
    got = F.from_json(c, f"{key} array<struct<{element}>>")[key]
    return F.coalesce(got, F.array().cast(f"array<struct<{element}>>"))


def evaluation_defaults(e: Column) -> dict[str, Column]:
    """The columns of a decoded evaluation: missing lists are empty, missing flags false."""
    lists, flags = ("matchingSkills", "missingSkills", "reasons", "concerns"), ("needsCloud",)
    none = F.array().cast("array<string>")
    return {**{k: F.coalesce(e[k], none) for k in lists}, **{k: F.coalesce(e[k], F.lit(False)) for k in flags}}
