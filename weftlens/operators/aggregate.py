"""Counts, crosstabs, votes, co-occurrence and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str, count_null: bool = True, top: int | None = None) -> DataFrame:
    """Counts and percentages of a column's values; null is a value or not, but never part of the denominator."""
    rows = df if count_null else df.filter(F.col(column).isNotNull())
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = F.sum(F.when(F.col(column).isNotNull(), F.col("n"))).over(Window.partitionBy())  # over the distinct values only
    out = counts.withColumn("pct", F.round(100.0 * F.col("n") / F.nullif(total, F.lit(0)), 2))
    return out if top is None else out.orderBy(F.desc("n"), column).limit(top)


def multi_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts by row and column, zeros where nothing is; the column's values are named so that one pass is enough."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def crosstab_percent(df: DataFrame, row: str, column: str, round_fraction: bool = False) -> DataFrame:
    """Long form: ``row, column, n, pct`` of each row's total; ``round_fraction`` rounds the fraction to 3 places first."""
    counts = df.groupBy(row, column).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(row))
    return counts.withColumn("pct", F.round(share, 3) * 100 if round_fraction else share * 100)


def describe_by(df: DataFrame, group: str, column: str) -> DataFrame:
    """count, mean, std, min, quartiles, max per group; quartiles are exact."""
    q = lambda p: F.percentile(F.col(column).cast("double"), F.lit(p))
    return df.groupBy(group).agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("lowest"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(column).alias("highest")
    )


def overview(df: DataFrame, text: str, flag: str | None = None) -> DataFrame:
    """One metric per row: rows, texts that stand more than once, empty texts, mean words, flagged rows."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    one = df.agg(
        F.count("*").cast("double").alias("rows"),
        (F.count(text) - F.count_distinct(text)).cast("double").alias("repeated"),
        F.sum((F.trim(F.coalesce(text, F.lit(""))) == "").cast("int")).cast("double").alias("empty"),
        F.round(F.avg(words), 4).alias("mean_words"),
        F.sum((F.col(flag) == F.lit(True)).cast("int") if flag else F.lit(0)).cast("double").alias("flagged"),
    )
    return one.unpivot([], one.columns, "metric", "value")


def list_counts(df: DataFrame, values: Column) -> DataFrame:
    """Counts of the entries of a list column."""
    return df.select(F.explode(values).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def theme_label_share(df: DataFrame, themes: Column, label: str, top: int = 15) -> DataFrame:
    """Of the most frequent themes, the share of each label: ``theme, label, n, share``."""
    rows = df.select(F.explode(themes).alias("theme"), F.col(label).alias("label"))
    counts = rows.groupBy("theme", "label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("theme"))
    ranked = counts.withColumns({"total": total, "share": F.col("n") / total})
    best = counts.groupBy("theme").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "theme").limit(top)
    return ranked.join(best.select("theme"), "theme", "left_semi").drop("total")


def pair_counts(df: DataFrame, left: Column, right: Column) -> DataFrame:
    """Entries of two lists of the same row, counted in pairs."""
    return df.select(F.explode(left).alias("left"), right.alias("r")).select("left", F.explode("r").alias("right")).groupBy("left", "right").agg(F.count("*").alias("n"))


def cooccurrence(df: DataFrame, themes: Column) -> DataFrame:
    """``left, right, n``: rows that hold both; the diagonal counts occurrences. Lists are per row and short."""
    rows = df.select(F.array_distinct(themes).alias("themes"))
    return rows.select(F.explode("themes").alias("left"), "themes").select("left", F.explode("themes").alias("right")).groupBy("left", "right").agg(F.count("*").alias("n"))


def modal_vote(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The most frequent value per key; ties go to the value seen first by ``order``; blanks don't vote."""
    votes = df.filter(F.trim(F.coalesce(F.col(value).cast("string"), F.lit(""))) != "").groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min(order).alias("seen"))
    return votes.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("votes")).alias("v"), "seen", value)).alias(value), F.max("votes").alias("votes"))


def repeat_votes(df: DataFrame, key: str, label: str, order: str, iterations: int | None, default: str, share: float = 0.30, seconds: int = 2) -> DataFrame:
    """Repeat coding: ``modal, stability, secondary`` (other labels with at least ``share`` of the runs, first seen first)
    and the distribution as ``votes_json``. A missing label votes for the default. Without ``iterations``, each key has
    as many runs as rows."""
    votes = df.withColumn(label, F.coalesce(label, F.lit(default))).groupBy(key, label).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    entry = F.struct((-F.col("n")).alias("v"), "seen", F.col(label).alias("label"))
    all_votes = votes.groupBy(key).agg(F.min(entry).alias("top"), F.collect_list(F.struct("seen", F.col(label).alias("label"), "n")).alias("own"), F.sum("n").alias("cast"))
    runs = F.col("cast") if iterations is None else F.lit(iterations)
    others = F.filter("own", lambda o: (o["label"] != F.col("top.label")) & (o["n"] >= share * runs))
    spread = F.map_from_entries(F.transform(F.array_sort(F.transform("own", lambda o: F.struct(o["label"].alias("label"), o["n"].alias("n")))), lambda o: F.struct(o["label"], o["n"])))
    return all_votes.select(
        key,
        F.col("top.label").alias("modal"),
        F.round(-F.col("top.v") / runs, 3).alias("stability"),
        F.array_join(F.transform(F.slice(F.array_sort(others), 1, seconds), lambda o: o["label"]), "; ").alias("secondary"),
        F.to_json(spread).alias("votes_json"),
    )


def stability_bucket(c: Column) -> Column:
    """(0, .5], (.5, .7], (.7, .85], (.85, 1]; null outside."""
    return F.when((c > 0) & (c <= 0.5), "<=0.50").when((c > 0.5) & (c <= 0.7), "0.50-0.70").when((c > 0.7) & (c <= 0.85), "0.70-0.85").when((c > 0.85) & (c <= 1.001), ">0.85")


def funnel_long(df: DataFrame, keys: Sequence[str], stages: Sequence[str]) -> DataFrame:
    """Stage counts in long form with the rate of the first stage."""
    first = F.col(stages[0]).cast("double")
    return df.withColumn("first_stage", first).unpivot([*keys, "first_stage"], list(stages), "stage", "n").withColumn("rate", F.round(F.col("n") / F.nullif("first_stage", F.lit(0.0)), 4)).drop("first_stage")


def group_profile(df: DataFrame, group: str, label: str, score: str, member: str) -> DataFrame:
    """Per group: rows, the most frequent label (ties: the smallest), mean score, the distinct members in order."""
    counts = df.groupBy(group, label).agg(F.count("*").alias("n")).filter(F.col(label).isNotNull())
    top = counts.groupBy(F.col(group).alias("gp_group")).agg(F.min_by(label, F.struct((-F.col("n")).alias("m"), label)).alias("top_label"))
    own = df.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(score), 4).alias("mean_score"), F.array_join(F.array_sort(F.collect_set(member)), "; ").alias("members"))
    return own.join(top, F.col(group).eqNullSafe(F.col("gp_group")), "left").drop("gp_group")


def severity_pivot(df: DataFrame, coder: str, severity: str, levels: Sequence[str]) -> DataFrame:
    """Issues per coder and severity with row totals, and a line of totals."""
    wide = df.groupBy(coder).pivot(severity, list(levels)).agg(F.count(F.lit(1))).na.fill(0)
    wide = wide.withColumn("total", sum((F.col(x) for x in levels), F.lit(0)))
    return wide.unionByName(wide.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*levels, "total"])).withColumn(coder, F.lit("TOTAL")).select(coder, *levels, "total"))


def spoken_time(df: DataFrame, file: str, speaker: str, start: str, end: str) -> DataFrame:
    """Seconds and share per speaker; the one who speaks most is marked (ties: the smaller name)."""
    times = df.groupBy(file, speaker).agg(F.round(F.sum(F.col(end) - F.col(start)), 3).alias("seconds"))
    most = times.groupBy(file).agg(F.min_by(speaker, F.struct((-F.col("seconds")).alias("s"), speaker)).alias("most"), F.sum("seconds").alias("all_seconds"))
    return times.join(most, file).select(file, speaker, "seconds", F.round(F.col("seconds") / F.nullif("all_seconds", F.lit(0.0)), 4).alias("share"), F.col(speaker).eqNullSafe(F.col("most")).alias("dominant"))


def conditional_shares(df: DataFrame, group: str, tests: dict[str, Column]) -> DataFrame:
    """Rows per group with the number and percentage for which each test holds."""
    aggs = [f for n, c in tests.items() for f in (F.sum(c.cast("int")).alias(f"n_{n}"), F.round(100 * F.avg(c.cast("double")), 2).alias(f"pct_{n}"))]
    return df.groupBy(group).agg(F.count("*").alias("n"), *aggs)


def ratio_text(a: Column, b: Column) -> Column:
    """``1 : 2.50``; ``n/a`` for nothing to compare with."""
    return F.when(F.coalesce(a, F.lit(0)) == 0, F.lit("n/a")).otherwise(F.format_string("1 : %.2f", b / a))


def score_summary(scores: DataFrame, kind: str, score: str, alpha: str) -> DataFrame:
    """Means over questions of a score and of alpha by kind and over all; nulls are skipped, not zero."""
    aggs = [F.round(F.avg(score), 6).alias("mean_score"), F.round(F.avg(alpha), 6).alias("mean_alpha"), F.count("*").alias("questions")]
    return scores.groupBy(kind).agg(*aggs).unionByName(scores.agg(*aggs).withColumn(kind, F.lit("all")))
