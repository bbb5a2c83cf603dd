"""Strict JSON reading: kinds, members, typed values with fallbacks; and the writer's forms."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEEPEST = 256
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")


def _no_constant(name):
    raise ValueError(name)


def _first_wins(pairs):
    out = {}
    for k, v in pairs:
        out.setdefault(k, v)
    return out


_DECODER = json.JSONDecoder(parse_constant=_no_constant, object_pairs_hook=_first_wins)


def depth(text: str) -> int:
    """The deepest nesting of brackets outside strings."""
    now = most = 0
    inside = escaped = False
    for c in text:
        if inside:
            escaped, inside = (c == "\\" and not escaped), c != '"' or escaped
        elif c == '"':
            inside = True
        elif c in "[{":
            now += 1
            most = max(most, now)
        elif c in "]}":
            now -= 1
    return most


def parse_prefix(text: str):
    """(value, characters used) of the JSON value at the start; ValueError if there is none or it is too deep."""
    start = len(text) - len(text.lstrip(" \t\r\n"))
    if depth(text) > DEEPEST:
        raise ValueError("too deep")
    value, end = _DECODER.raw_decode(text, start)
    return value, end


def parse(text: str):
    value, end = parse_prefix(text)
    if text[end:].strip(" \t\r\n"):
        raise ValueError("more follows")
    return value


def valid(text: Column) -> Column:
    """Whether the whole text is one JSON value by RFC 8259, at most 256 levels deep."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                parse(t)
                return True
            except (ValueError, RecursionError):
                return False

        return texts.map(one, na_action="ignore")

    return run(text)


def kind(text: Column) -> Column:
    """null, bool, number, string, array or object, by the first character of a valid value."""
    c = F.substring(F.ltrim(text), 1, 1)
    return F.when(c == "n", "null").when(c.isin("t", "f"), "bool").when(c == '"', "string").when(c == "[", "array").when(c == "{", "object").otherwise("number")


def count(text: Column) -> Column:
    """Members of an object or array, else 0."""
    return F.coalesce(F.when(kind(text) == "array", F.json_array_length(text)), F.when(kind(text) == "object", F.size(F.json_object_keys(text))), F.lit(0))


def member(text: Column, key: str) -> Column:
    """The first member of that name, as text."""
    return F.get_json_object(text, f"$['{key}']")


def item(text: Column, i: int) -> Column:
    return F.get_json_object(text, f"$[{i}]")


def number(text: Column, key: str, default: float | None = None) -> Column:
    return F.coalesce(member(text, key).try_cast("double"), F.lit(default).cast("double"))


def integer(text: Column, key: str, default: int | None = None) -> Column:
    """A number written without fraction or exponent, else the default."""
    raw = member(text, key)
    return F.coalesce(F.when(raw.rlike(r"^-?[0-9]+$"), raw.try_cast("bigint")), F.lit(default).cast("bigint"))


def flag(text: Column, key: str, default: bool = False) -> Column:
    raw = member(text, key)
    return F.when(raw == "true", True).when(raw == "false", False).otherwise(default)


def written_double(x: float) -> str:
    """17 significant digits; either zero is 0, what isn't finite is null."""
    return "null" if not math.isfinite(x) else "0" if x == 0 else f"{x:.17g}"


def escaped(text: Column) -> Column:
    """The text as a JSON string, quotes included."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("s"))), r'^\{"s":(.*)\}$', 1)
