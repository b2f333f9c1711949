"""Duplicates: keep the first, the best or the last by an explicit order, flag groups, look up the first value of a key."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first by ``order`` (which must decide every tie). Null keys are one key."""
    named = {f"dedup_key_{i}": F.col(k) if isinstance(k, str) else k for i, k in enumerate(keys)}
    keyed = df.withColumns(named)
    rank = F.row_number().over(Window.partitionBy(*named).orderBy(*order))
    return keyed.withColumn("dedup_rank", rank).filter("dedup_rank = 1").drop("dedup_rank", *named)


def keep_best(df: DataFrame, key: Column, best: Sequence[Column], tie: str) -> DataFrame:
    """One row per key, the greatest by ``best`` (nulls last), ties to the smallest ``tie``."""
    return keep_first(df, [key], [*(c.desc_nulls_last() for c in best), F.col(tie)])


def two_stage(df: DataFrame, text_key: Column, id_col: str, order: Sequence[Column | str]) -> DataFrame:
    """By text key where there is one, all rows without; then by id."""
    keyed = df.withColumn("stage_key", text_key)
    with_key = keep_first(keyed.filter("stage_key <> ''"), ["stage_key"], order)
    return keep_first(with_key.unionByName(keyed.filter("stage_key = '' or stage_key is null")), [id_col], order).drop("stage_key")


def flag_duplicates(df: DataFrame, key: Column, name: str = "is_duplicate") -> DataFrame:
    """All members of a group of more than one. Groups are counted first, and the count is joined back, so that no group
    has to pass through one task whole."""
    keyed = df.withColumn("flag_key", key)
    counts = keyed.filter("flag_key is not null").groupBy("flag_key").agg(F.count("*").alias("flag_n"))
    return keyed.join(counts, "flag_key", "left").withColumn(name, F.coalesce(F.col("flag_n") > 1, F.lit(False))).drop("flag_key", "flag_n")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``."""
    return keep_first(df, list(keys), [F.col(o).desc_nulls_last() for o in order])


def first_of_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A lookup: the first value that isn't null of each key."""
    return df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value))


def trim_rolling(segments: DataFrame, file: str, order: str, text: str, start: str, end: str) -> DataFrame:
    """Rolling captions: each segment without the words it repeats from the end of the one kept before it.

    A repeated segment extends the one before; one that is wholly repeated goes. Order matters within a file, so a
    file's segments are taken in order by one task; a file is one recording, some thousand segments.
    """
    schema = segments.select(file, order, start, end, text).schema

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows: list[list] = []
        for r in frame.sort_values(order, kind="stable").to_dict("records"):
            words = (r[text] or "").split()
            if rows:
                before = rows[-1][4].split()
                if words == before:
                    rows[-1][3] = max(rows[-1][3], r[end])
                    continue
                k = next((k for k in range(min(len(before), len(words)), 0, -1) if before[-k:] == words[:k]), 0)
                if k and k == len(words):
                    rows[-1][3] = max(rows[-1][3], r[end])
                    continue
                words = words[k:]
            if words:
                rows.append([key[0], r[order], r[start], r[end], " ".join(words)])
        return pd.DataFrame(rows, columns=[file, order, start, end, text])

    return segments.select(file, order, start, end, text).groupBy(file).applyInPandas(run, schema)


def drop_repeated_blocks(turns: DataFrame, file: str, order: str, text: str, least_words: int = 80, share: float = 0.6) -> DataFrame:
    """Turns of at least ``least_words`` words of which more than ``share`` of the sentences stood in a kept turn before."""
    schema = turns.schema

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        seen: set[str] = set()
        kept = []
        for i, value in frame.sort_values(order, kind="stable")[text].items():
            sentences = [" ".join(s.lower().split()) for s in re.split(r"(?<=[.!?])\s+", value or "") if s.strip()]
            if len((value or "").split()) >= least_words and sentences and sum(s in seen for s in sentences) > share * len(sentences):
                continue
            seen.update(sentences)
            kept.append(i)
        return frame.loc[kept]

    return turns.groupBy(file).applyInPandas(run, schema)

