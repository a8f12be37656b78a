"""JSON texts as values: key-wise merges and keys removed at any depth."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+', re.S)


def _entries(text: Column) -> Column:
    """Entries of a JSON object as variants; null for what is no object."""
    return F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.from_json(text, "map<string,variant>"))


def _merged(old: Column, new: Column, depth: int) -> Column:
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    if depth > 1:
        inner = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>"))

        def below(k: Column, v: Column) -> Column:
            a, b = inner(F.try_element_at(old, k)), inner(v)
            return F.when(a.isNotNull() & b.isNotNull(), F.parse_json(F.to_json(_merged(a, b, depth - 1)))).otherwise(v)

        new = F.transform_values(new, below)
    return F.map_concat(kept, new)


def sorted_json(entries: Column) -> Column:
    """JSON text of a map of variants, keys in order."""
    value = lambda k: F.struct(k.alias("key"), F.element_at(entries, k).alias("value"))
    return F.to_json(F.map_from_entries(F.transform(F.array_sort(F.map_keys(entries)), value)))


def merged_json(old: Column, new: Column, depth: int = 1) -> Column:
    """``old`` with the entries of ``new``, which win where both have a key; keys that only ``old`` has stay. Keys in order.

    With ``depth`` above 1 objects under one key are merged in the same way, down to that depth; other values are replaced,
    a JSON null included. What is no JSON object (null too) has no entries; if neither is an object the result is null."""
    a, b = _entries(old), _entries(new)
    none = F.from_json(F.lit("{}"), "map<string,variant>")
    both = _merged(F.coalesce(a, none), F.coalesce(b, none), depth)
    return F.when(a.isNotNull() | b.isNotNull(), sorted_json(both))


def folded_json(rows: DataFrame, keys: list[str], json: str, order: list[Column]) -> DataFrame:
    """``keys`` and ``json``: the JSON objects of each key's rows merged, each entry from the first row by ``order`` that has it.

    Entries go by (key, name of the entry), of which tasks send one row each, so a key of many rows is never together."""
    found = rows.select("*", F.explode(_entries(F.col(json))).alias("_name", "_value"))
    place = F.row_number().over(Window.partitionBy(*keys, "_name").orderBy(*order))
    best = found.withColumns({"_value": F.to_json("_value"), "_place": place}).where("_place = 1")
    listed = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_name", "_value"))).alias("_all"))
    entry = lambda e: F.struct(e["_name"].alias("key"), F.parse_json(e["_value"]).alias("value"))
    return listed.select(*keys, F.to_json(F.map_from_entries(F.transform("_all", entry))).alias(json))


def without_keys(text: str, word: str) -> str:
    """JSON text without the entries, at any depth and in lists too, whose key holds ``word`` (any case); numbers and strings
    stay as they were written. The text is read once, without recursion, whatever its depth."""
    out: list[str] = []
    inside: list[str] = []  # open brackets
    tokens = _TOKEN.findall(text)
    i, n = 0, len(tokens)
    while i < n:
        t = tokens[i]
        if t[0] == '"' and i + 1 < n and tokens[i + 1] == ":" and inside and inside[-1] == "{" and word in json.loads(t, strict=False).lower():
            i, depth = i + 2, 0
            while i < n:
                depth += (tokens[i] in "{[") - (tokens[i] in "}]")
                i += 1
                if depth <= 0:
                    break
            if i < n and tokens[i] == ",":
                i += 1
            elif out and out[-1] == ",":
                out.pop()
            continue
        if t in "{[":
            inside.append(t)
        elif t in "}]" and inside:
            inside.pop()
        out.append(t)
        i += 1
    return "".join(out)


def stripped_json(payload: Column, word: str) -> Column:
    """``payload`` (JSON text) without the entries whose key holds ``word``, at any depth; what is no JSON becomes null."""

    @F.pandas_udf(StringType())
    def strip(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: without_keys(t, word.lower()), na_action="ignore")

    return strip(F.when(F.try_parse_json(payload).isNotNull(), payload))
