"""Foldings that no built-in expression has: Unicode compatibility form and all HTML entities. Arrow-batched, and only for
rows that need it: the others keep their value without a call into Python's tables."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlens.functions.text import clean_comment


def nfkc(c: Column) -> Column:
    """Compatibility form; ASCII texts are their own."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.when(c.rlike(r"[^\x00-\x7F]"), fold(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(c)


def unescape(c: Column, rounds: int = 4) -> Column:
    """All entities, undone until nothing changes, at most four times."""

    @F.pandas_udf("string")
    def undo(texts: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            for _ in range(rounds):
                fresh = html.unescape(t)
                if fresh == t:
                    break
                t = fresh
            return t

        return texts.map(one, na_action="ignore")

    return F.when(c.contains("&"), undo(F.when(c.contains("&"), c))).otherwise(c)


def folded_comment(c: Column) -> Column:
    """The comment cleaner in full: compatibility form, straight quotes, single spaces, trimmed."""
    return clean_comment(nfkc(c))
