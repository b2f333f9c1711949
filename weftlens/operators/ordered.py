"""Operators that need an order: scaling, top rows, sessions, smoothing, filling, numbering, packing."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlens.runtime import cut_lineage, join_null_safe


def minmax_scale(df: DataFrame, groups: Sequence[str], column: str, out: str, epsilon: float = 1e-9) -> DataFrame:
    """(x - min) / (max - min + epsilon) within groups. The bounds are aggregated and joined back: a group may be any size."""
    bounds = df.groupBy(*groups).agg(F.min(column).alias("mm_lo"), F.max(column).alias("mm_hi"))
    joined = join_null_safe(df, bounds, groups) if groups else df.crossJoin(F.broadcast(bounds))  # one row without groups
    return joined.withColumn(out, (F.col(column) - F.col("mm_lo")) / (F.col("mm_hi") - F.col("mm_lo") + epsilon)).drop("mm_lo", "mm_hi")


def top_n(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank. Spark cuts each partition to its own first ``n`` rows of every
    group before the shuffle (a limit on row_number), so that hot groups stay small."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col(rank) <= n)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def sessions(df: DataFrame, file: str, order: Sequence[str], speaker: str, start: str, end: str, text: str, gap: float | None = 0.9) -> DataFrame:
    """Turns of neighbouring pieces of one speaker: a new one where the speaker changes or ``gap`` seconds pass (None: never).

    ``file, turn, speaker, start, end, text``; times to 3 places.
    """
    w = Window.partitionBy(file).orderBy(*order)
    pause = (F.col(start) - F.lag(end).over(w)) > gap if gap is not None else F.lit(False)
    fresh = F.lag(F.lit(1)).over(w).isNull() | ~F.lag(speaker).over(w).eqNullSafe(F.col(speaker)) | F.coalesce(pause, F.lit(False))
    marked = df.withColumn("ss_new", fresh.cast("int")).withColumn("ss_turn", F.sum("ss_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = F.array_sort(F.collect_list(F.struct(*(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), F.col(text).alias("piece"))))
    turns = marked.groupBy(file, "ss_turn").agg(
        F.first(speaker).alias(speaker), F.round(F.min(start), 3).alias(start), F.round(F.max(end), 3).alias(end), F.array_join(F.transform(pieces, lambda p: p["piece"]), " ").alias(text)
    )
    return turns.withColumnRenamed("ss_turn", "turn")


def majority_smooth(df: DataFrame, file: str, order: str, label: str, out: str, width: int = 15) -> DataFrame:
    """The most frequent label within a window around each row (ties: the first in it); files of at most ``width`` rows stay."""
    half = width // 2
    w = Window.partitionBy(file).orderBy(order)
    near = F.collect_list(F.coalesce(label, F.lit(""))).over(w.rowsBetween(-half, half))
    entries = F.transform(F.array_distinct("ms_near"), lambda x: F.struct((-F.size(F.filter("ms_near", lambda y: y == x))).alias("n"), F.array_position("ms_near", x).alias("at"), x.alias("label")))
    total = df.groupBy(file).agg(F.count("*").alias("ms_n"))
    return (
        df.withColumn("ms_near", near)
        .join(total, file)
        .withColumn(out, F.when(F.col("ms_n") > width, F.nullif(F.array_min(entries)["label"], F.lit(""))).otherwise(F.col(label)))
        .drop("ms_near", "ms_n")
    )


def forward_fill(df: DataFrame, file: str, order: str, label: str, out: str, default: str) -> DataFrame:
    """A missing label is the last one before it, or the default."""
    w = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.coalesce(F.last(label, ignorenulls=True).over(w), F.lit(default)))


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], out: str) -> DataFrame:
    """Numbers 1, 2, ... within groups, where a group may be larger than any task should hold.

    Rows are dealt out by ranges of group and order, so that a large group lies in several partitions, and written down
    (the ranges must stay the same afterwards); each part of a group is numbered on its own, and a small table of the
    parts' sizes says where each part starts. ``order`` must decide every tie.
    """
    keys = {f"nb_key_{i}": F.col(g) for i, g in enumerate(groups)}
    ranged = df.withColumns(keys).repartitionByRange(*keys, *order).withColumn("nb_part", F.spark_partition_id())
    placed = cut_lineage(ranged)
    parts = placed.groupBy(*keys, "nb_part").agg(F.count("*").alias("nb_size"))
    before = F.sum("nb_size").over(Window.partitionBy(*keys).orderBy("nb_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(*(F.col(k).alias(f"{k}_s") for k in keys), F.col("nb_part").alias("nb_part_s"), F.coalesce(before, F.lit(0)).alias("nb_start"))
    own = placed.withColumn("nb_own", F.row_number().over(Window.partitionBy(*keys, "nb_part").orderBy(*order)))
    same = (F.col("nb_part") == F.col("nb_part_s"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_s"))
    return own.join(starts, same).withColumn(out, F.col("nb_own") + F.col("nb_start")).select(*df.columns, out)


def sequential_ids(df: DataFrame, group: str, order: Sequence[Column | str], prefix: Column, width: int, out: str, sep: str = "_") -> DataFrame:
    """``ABC_001`` within groups of any size."""
    n = numbered(df.withColumn("si_prefix", prefix), [group], order, "si_n")
    return n.withColumn(out, F.concat("si_prefix", F.lit(sep), F.lpad(F.col("si_n").cast("string"), width, "0"))).drop("si_prefix", "si_n")


def renumber(df: DataFrame, group: str, order: str, pinned: str, number: int, out: str) -> DataFrame:
    """Numbers 1, 2, ... within groups, where the pinned row keeps ``number`` and no other row takes it."""
    n = F.row_number().over(Window.partitionBy(group, F.col(pinned)).orderBy(order))
    has_pin = F.max(F.col(pinned).cast("int")).over(Window.partitionBy(group))
    return df.withColumn(out, F.when(F.col(pinned), F.lit(number)).otherwise(n + ((n >= number) & (has_pin == 1)).cast("int")))


def _severity_order(severity: str, levels: Sequence[str], keys: Sequence[str]) -> list[Column]:
    at = F.lit(len(levels))
    for i, level in reversed(list(enumerate(levels))):
        at = F.when(F.col(severity) == level, F.lit(i)).otherwise(at)
    return [at.asc(), *(F.col(k).asc_nulls_last() for k in keys)]


def by_severity(df: DataFrame, severity: str, levels: Sequence[str], *keys: str) -> DataFrame:
    """Most severe first, then by keys; unknown levels last."""
    return df.orderBy(*_severity_order(severity, levels, keys))


def place_by_severity(df: DataFrame, severity: str, levels: Sequence[str], out: str, *keys: str) -> DataFrame:
    """The place of every row in that order, from 1; ``keys`` must decide every tie."""
    return numbered(df, [], _severity_order(severity, levels, keys), out)


def relabel_by_appearance(df: DataFrame, file: str, label: str, start: str, prefix: str, out: str) -> DataFrame:
    """Labels numbered from 1 by when they first appear in their file (ties: by label)."""
    first = df.groupBy(file, label).agg(F.min(start).alias("ra_first"))
    numbered = first.withColumn(out, F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(file).orderBy("ra_first", label)).cast("string")))
    return df.join(numbered.drop("ra_first"), [file, label])


def pack(df: DataFrame, group: str, order: str, size: int, out: str = "batch") -> DataFrame:
    """Batches of ``size`` rows within groups of any size, numbered from 0."""
    return numbered(df, [group], [order], "pk_n").withColumn(out, F.floor((F.col("pk_n") - 1) / size)).drop("pk_n")


def rank_between(df: DataFrame, group: str, order: Sequence[Column | str], low: int, high: int) -> DataFrame:
    """The rows ``low`` to ``high`` of each group; partitions keep only their own first ``high`` rows before the shuffle."""
    return top_n(df, [group], [F.col(o) if isinstance(o, str) else o for o in order], high, "rb").filter(F.col("rb") >= low).drop("rb") if high <= 1000 else numbered(df, [group], order, "rb").filter(F.col("rb").between(low, high)).drop("rb")



def chained_offsets(df: DataFrame, file: str, order: str, duration: str, out: str = "offset") -> DataFrame:
    """Where each chunk starts: the durations before it, summed."""
    w = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.round(F.coalesce(F.sum(duration).over(w), F.lit(0.0)), 3))


def pick_quotes(df: DataFrame, theme: str, text: str, id_col: str, per_theme: int = 3, most: int = 28) -> DataFrame:
    """Up to three longest texts per theme, themes by frequency, at most 28 in all."""
    frequency = df.groupBy(theme).agg(F.count("*").alias("pq_n"))
    ranked = top_n(df, [theme], [F.length(text).desc(), F.col(id_col)], per_theme, "pq_rank").join(frequency, theme)
    return ranked.orderBy(F.desc("pq_n"), theme, "pq_rank").limit(most).drop("pq_n")


def absorb_interjections(df: DataFrame, file: str, order: str, speaker: str, text: str, most_words: int = 3) -> DataFrame:
    """A short turn between two turns of one other speaker becomes part of them. What came before is what was merged so far,
    so a file's turns are taken in order by one task (a file is one recording)."""
    schema = df.select(file, order, speaker, text).schema

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(order, kind="stable")[[order, speaker, text]].values.tolist()
        merged: list[list] = []
        for i, (o, s, t) in enumerate(rows):
            after = rows[i + 1][1] if i + 1 < len(rows) else None
            if merged and len((t or "").split()) <= most_words and merged[-1][1] != s and merged[-1][1] == after:
                merged[-1][2] = f"{merged[-1][2]} {t}".strip()
            elif merged and merged[-1][1] == s:
                merged[-1][2] = f"{merged[-1][2]} {t}".strip()
            else:
                merged.append([o, s, t])
        return pd.DataFrame([[key[0], *m] for m in merged], columns=[file, order, speaker, text])

    return df.select(file, order, speaker, text).groupBy(file).applyInPandas(run, schema)
