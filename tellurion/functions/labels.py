"""Label maps as columns."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tellurion.errors import QueryError, UnsupportedError


def key(labels: Column) -> Column:
    """Canonical text of a label map: JSON with its names in order. Equal maps have equal keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def of(key: Column) -> Column:
    """The map that a key is the text of. Groups carry the key alone: a map among the aggregates would keep them from being hashed."""
    return F.from_json(key, "map<string,string>")


def get(labels: Column, name: str) -> Column:
    """An absent label is the empty string."""
    return F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit(""))


def keep(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, v: k.isin(names) & (v != "")) if names else empty()


def drop(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, v: ~k.isin(names))


def empty() -> Column:
    return F.create_map().cast("map<string,string>")


def put(labels: Column, name: str, value: Column) -> Column:
    """An empty value deletes the label."""
    rest = drop(labels, [name])
    return F.when(value == "", rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), value)))


def java_regex(pattern: str) -> str:
    """RE2 text as Java's regex reads it alike; what RE2 lacks is rejected."""
    if re.search(r"\(\?<?[=!]", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise UnsupportedError("lookaround and back references are not part of the dialect")
    return re.sub(r"\(\?P<", "(?<", pattern)


def anchored(pattern: str) -> str:
    return f"^(?s:{java_regex(pattern)})$"


def matches(value: Column, op: str, wanted: str) -> Column:
    if op == "=":
        return value == wanted
    if op == "!=":
        return value != wanted
    found = value.rlike(anchored(wanted).removesuffix("$") + r"\z")
    return found if op == "=~" else ~found


def filter_grammar(text: str | None, labels: Column) -> Column:
    """The JSON filter of the table functions: {"k": "v"} and {"k": {"neq" | "re" | "nre": "v"}}."""
    if not text:
        return F.lit(True)
    try:
        wanted = json.loads(text)
    except ValueError as e:
        raise QueryError(f"bad filter: {e}") from None
    if not isinstance(wanted, dict):
        raise QueryError("a filter is a JSON object")
    out = F.lit(True)
    for name, value in wanted.items():
        if isinstance(value, str):
            value = {"eq": value}
        if not isinstance(value, dict) or not value:
            raise QueryError(f"bad filter for {name!r}")
        for op, x in value.items():
            if op not in ("eq", "neq", "re", "nre") or not isinstance(x, str):
                raise QueryError(f"unknown filter operator {op!r}")
            out = out & matches(get(labels, name), {"eq": "=", "neq": "!=", "re": "=~", "nre": "!~"}[op], x)
    return out
