"""Agreement of two raters: percent agreement, Krippendorff's alpha, Jaccard, confusion metrics, and tables of them.

Ratings come long: one row per item and question with the answers ``a`` and ``b``. An answer that is null or blank is
missing; undefined values (no pairs, no expected disagreement, zero denominators) are null and means skip them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def answered(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) != ""


def paired(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return df.filter(answered(F.col(a)) & answered(F.col(b)))


def percent_agreement(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``pairs, agreement`` over rows both answered."""
    return paired(df).groupBy(*keys).agg(F.count("*").alias("pairs"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"))


def krippendorff_alpha(df: DataFrame, keys: Sequence[str], correction: str = "pairable") -> DataFrame:
    """``pairs, observed, alpha`` of two raters on nominal answers.

    Expected agreement from the pooled values: with ``pairable`` each value is drawn without replacement, with ``none``
    from the plain shares. Alpha is null where no disagreement is expected.
    """
    both = paired(df)
    observed = both.groupBy(*keys).agg(F.count("*").alias("pairs"), F.avg((F.col("a") != F.col("b")).cast("double")).alias("observed"))
    pooled = both.select(*keys, F.explode(F.array(F.col("a"), F.col("b"))).alias("value")).groupBy(*keys, "value").agg(F.count("*").cast("double").alias("c"))
    sums = pooled.groupBy(*keys).agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum(F.col("c") * (F.col("c") - 1)).alias("cp"))
    same = F.col("cp") / F.nullif(F.col("t") * (F.col("t") - 1), F.lit(0.0)) if correction == "pairable" else F.col("cc") / (F.col("t") * F.col("t"))
    expected = 1 - same
    joined = observed.join(sums, list(keys)) if keys else observed.crossJoin(sums)  # one row each without keys
    return joined.select(*keys, "pairs", "observed", F.when(F.abs(expected) > 1e-12, 1 - F.col("observed") / expected).alias("alpha"))


def answer_set(c: Column, sep: str) -> Column:
    """The distinct lower-case labels of a cell."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def jaccard_scores(df: DataFrame, keys: Sequence[str], sep_a: str, sep_b: str) -> DataFrame:
    """``items, exact, jaccard`` of multi-answers; rows where neither rater chose anything are skipped."""
    sets = df.select(*keys, answer_set(F.col("a"), sep_a).alias("x"), answer_set(F.col("b"), sep_b).alias("y"))
    union = F.size(F.array_union("x", "y"))
    j = F.size(F.array_intersect("x", "y")) / union
    return sets.filter(union > 0).groupBy(*keys).agg(F.count("*").alias("items"), F.avg((j == 1.0).cast("double")).alias("exact"), F.avg(j).alias("jaccard"))


def fair_pairs(df: DataFrame, item: str, question: str, parent: str, child: str, yes: str = "yes") -> DataFrame:
    """Ratings of a child question for the items where both raters said yes to its parent."""
    agreed = df.filter((F.col(question) == parent) & (F.lower("a") == yes) & (F.lower("b") == yes)).select(item)
    return df.filter(F.col(question) == child).join(agreed, item, "left_semi")


def band(c: Column) -> Column:
    """strong / acceptable / moderate / weak; null stays null."""
    return F.when(c >= 0.80, "strong").when(c >= 0.67, "acceptable").when(c >= 0.50, "moderate").when(c.isNotNull(), "weak")


def question_scores(single: DataFrame, multi: DataFrame, key: str, sep_a: str, sep_b: str) -> DataFrame:
    """One row per question: kind, items, agreement (exact for multi-answers), alpha, Jaccard, band of the leading score."""
    s = percent_agreement(single, [key]).join(krippendorff_alpha(single, [key]).select(key, "alpha"), key)
    s = s.select(key, F.lit("single").alias("kind"), F.col("pairs").alias("items"), "agreement", "alpha", F.lit(None).cast("double").alias("jaccard"), F.col("agreement").alias("lead"))
    m = jaccard_scores(multi, [key], sep_a, sep_b).select(key, F.lit("multi").alias("kind"), "items", F.col("exact").alias("agreement"), F.lit(None).cast("double").alias("alpha"), "jaccard", F.col("jaccard").alias("lead"))
    return s.unionByName(m).withColumn("band", band(F.col("lead")))


def overall(scores: DataFrame) -> DataFrame:
    """Means over questions: exact over all, alpha over single, Jaccard over multi, and the combined lead."""
    return scores.agg(F.avg("agreement").alias("exact"), F.avg("alpha").alias("alpha"), F.avg("jaccard").alias("jaccard"), F.avg("lead").alias("combined"), F.count("*").alias("questions"))


def merged_ratings(df: DataFrame, item: str, question: str, questions: Sequence[str]) -> DataFrame:
    """One row per item: both answers and whether they agree, per question."""
    aggs = [f for q in questions for f in (F.max(F.when(F.col(question) == q, F.col("a"))).alias(f"human_{q}"), F.max(F.when(F.col(question) == q, F.col("b"))).alias(f"model_{q}"))]
    wide = df.groupBy(item).agg(*aggs)
    return wide.withColumns({f"exact_{q}": (F.col(f"human_{q}") == F.col(f"model_{q}")).cast("int") for q in questions})


def binary_options(df: DataFrame, options: DataFrame, question: str, option: str, sep_a: str, sep_b: str) -> DataFrame:
    """Long binary ratings of multi-answers: one row per item and option of its question, ``a`` and ``b`` as 0 or 1."""
    rows = df.withColumns({"x": answer_set(F.col("a"), sep_a), "y": answer_set(F.col("b"), sep_b)}).filter(F.size(F.array_union("x", "y")) > 0).drop("a", "b")
    has = lambda c: F.array_contains(c, F.lower(F.col(option))).cast("int")
    return rows.join(options, question).withColumns({"a": has("x"), "b": has("y")}).drop("x", "y")


def option_reliability(binary: DataFrame, question: str, option: str) -> DataFrame:
    """Per option: how often each rater chose it, agreement, alpha."""
    keys = [question, option]
    presence = binary.groupBy(*keys).agg(F.sum("a").alias("present_a"), F.sum("b").alias("present_b"))
    return presence.join(percent_agreement(binary, keys), keys).join(krippendorff_alpha(binary, keys).select(*keys, "alpha"), keys)


def confusion(binary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """tp, fp, fn, tn with accuracy, precision, recall and F1 of ``b`` against ``a``; undefined ones are null."""
    n = lambda x, y: F.sum(((F.col("a") == x) & (F.col("b") == y)).cast("int")).alias(f"{'t' if x == y else 'f'}{'p' if y else 'n'}")
    return rates(binary.groupBy(*keys).agg(n(1, 1), n(0, 1), n(1, 0), n(0, 0)))


def rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    div = lambda x, y: x / F.nullif(y, F.lit(0.0))
    return counts.withColumns({"accuracy": div(tp + tn, tp + fp + fn + tn), "prec": div(tp, tp + fp), "recall": div(tp, tp + fn), "f1": div(2 * tp, 2 * tp + fp + fn)})


def micro_macro(options: DataFrame, question: str) -> DataFrame:
    """Per question: metrics of the summed counts, and means of the options' metrics where they are defined."""
    sums = rates(options.groupBy(question).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn"))))
    macro = options.groupBy(question).agg(*(F.avg(c).alias(f"macro_{c}") for c in ("prec", "recall", "f1")))
    return sums.join(macro, question)


def class_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Single answers as classes: accuracy, and macro precision, recall and F1 over the classes that occur."""
    both = paired(df)
    cells = both.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))
    side = cells.select(*keys, F.explode(F.array(F.struct(F.col("a").alias("c"), F.lit("a").alias("s")), F.struct(F.col("b").alias("c"), F.lit("b").alias("s")))).alias("e"), "n", (F.col("a") == F.col("b")).alias("hit"))
    per = side.groupBy(*keys, F.col("e.c").alias("class")).agg(
        F.sum(F.when(F.col("hit") & (F.col("e.s") == "a"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("hit") & (F.col("e.s") == "b"), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~F.col("hit") & (F.col("e.s") == "a"), F.col("n")).otherwise(0)).alias("fn"),
    )
    macro = rates(per.withColumn("tn", F.lit(0))).groupBy(*keys).agg(*(F.avg(c).alias(f"macro_{c}") for c in ("prec", "recall", "f1")))
    return percent_agreement(df, keys).join(macro, list(keys))


def without_flagged(df: DataFrame, flagged: DataFrame, item: str, question: str) -> DataFrame:
    """Ratings without the cells that were flagged."""
    return df.join(flagged.select(item, question).distinct(), [item, question], "left_anti")


def alpha_summary(scores: DataFrame, group: str, alpha: str, disagreement: str) -> DataFrame:
    """mean, median, lowest and highest alpha, mean disagreement, and how many alphas are defined."""
    return scores.groupBy(group).agg(F.avg(alpha).alias("mean"), F.percentile(alpha, F.lit(0.5)).alias("median"), F.min(alpha).alias("lowest"), F.max(alpha).alias("highest"), F.avg(disagreement).alias("disagreement"), F.count(alpha).alias("defined"))


def best_candidate(scores: DataFrame, question: str, candidate: str, score: str, exclude: Sequence[str] = (), exclude_perfect: bool = False) -> DataFrame:
    """The candidate with the highest score per question (ties: the smaller name); exact copies and perfect scores may be left out."""
    rows = scores.filter(F.col(score).isNotNull() & ~F.col(candidate).isin(list(exclude)) if exclude else F.col(score).isNotNull())
    if exclude_perfect:
        rows = rows.filter(F.col(score) < 1.0)
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col(candidate).alias("c")))
    return rows.groupBy(question).agg(best.alias("b")).select(question, F.col("b.c").alias(candidate), (-F.col("b.s")).alias(score))
