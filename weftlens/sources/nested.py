"""Nested scraper items: the first value present among alternate paths, and fixed columns from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_present(json: Column, paths: Sequence[str]) -> Column:
    """The value of the first path that holds something; empty texts, arrays and objects count as absent."""
    found = (F.get_json_object(json, p) for p in paths)
    return F.coalesce(*(F.when(~F.trim(v).isin("", "[]", "{}", "null"), v) for v in found))


def fixed_columns(df: DataFrame, mapping: Mapping[str, Sequence[str]], kinds: Mapping[str, str] | None = None) -> DataFrame:
    """Each target column from the first of its candidate columns that exists and isn't null, cast where a kind is given; null if none exists."""
    have = set(df.columns)
    out = []
    for target, names in mapping.items():
        own = [F.col(f"`{n}`") for n in names if n in have]
        value = F.coalesce(*own) if own else F.lit(None)
        out.append(value.cast((kinds or {}).get(target, "string")).alias(target))
    return df.select(*out)


def item_columns(df: DataFrame, json_col: str, paths: Mapping[str, Sequence[str]], kinds: Mapping[str, str] | None = None) -> DataFrame:
    """Fixed columns of JSON items, each from its alternate paths; other columns pass through."""
    out = []
    for target, own in paths.items():
        value, kind = first_present(F.col(json_col), own), (kinds or {}).get(target, "string")
        out.append(value.try_cast(kind).alias(target))
    return df.select(*[c for c in df.columns if c != json_col], *out)
