"""Data-quality checks: each a row ``name, ok, detail`` or a row per violation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def invariants(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """``name, ok, detail``: for each condition, whether it holds for all rows, and how many it doesn't hold for. One pass."""
    counts = df.agg(*(F.coalesce(F.sum((~F.coalesce(c, F.lit(False))).cast("int")), F.lit(0)).cast("long").alias(n) for n, c in checks.items()))
    return counts.unpivot([], list(checks), "name", "detail").select("name", (F.col("detail") == 0).alias("ok"), "detail")


def expected_values(df: DataFrame, column: str, expected: Sequence[str]) -> DataFrame:
    """Expected values that don't occur."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(e,) for e in expected], f"{column} string")
    return wanted.join(df.select(column).distinct(), column, "left_anti")


def violations(df: DataFrame, key: str, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """``check, severity, key`` of every row that breaks a rule ``(check, severity, condition of the break)``."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"))) for n, s, c in rules)))
    return df.select(F.explode(broken).alias("v"), key).select("v.check", "v.severity", key)


def recoding_report(answers: DataFrame, codebook: DataFrame, item: str, coder: str, question: str, answer: str, sep: str, anchors: int = 6, blanks: int = 3) -> DataFrame:
    """Issues of coded answers against a codebook with ``question, options (array), multi, required, parent, gate``.

    Passes: values outside the list (single HIGH, parts of multi MED), required blanks HIGH, "Other" without its free
    text and free text without its "Other" LOW (a question without options is the free text of a parent that lists
    "Other"), one item twice by one coder HIGH, items of all coders with many blanks HIGH, "none" beside others HIGH,
    answers whose gate is closed MED, open gates without answers MED, cosmetic differences LOW. Sorted by severity,
    coder, item, pass.
    """
    rows = answers.join(codebook, question, "left").withColumn("given", F.trim(F.coalesce(answer, F.lit(""))))
    blank = F.col("given") == ""
    low = lambda c: F.transform(c, lambda x: F.lower(F.trim(x)))
    parts, known = low(F.split("given", sep)), low(F.col("options"))
    listed = F.size("options") > 0
    parent = answers.select(item, coder, F.col(question).alias("parent"), F.lower(F.trim(answer)).alias("parent_answer"))
    rows = rows.join(parent, [item, coder, "parent"], "left")
    open_gate = F.col("gate").isNull() | F.coalesce(F.col("parent_answer") == F.lower("gate"), F.lit(False))
    single = ~F.col("multi") & listed & ~blank
    inside = F.array_contains(known, F.lower("given"))
    issues = violations(
        rows.withColumn("cell", F.struct(coder, item, question)),
        "cell",
        [
            ("1 value outside list", "HIGH", single & ~inside),
            ("2 part outside list", "MED", F.col("multi") & listed & ~blank & (F.size(F.array_except(parts, known)) > 0)),
            ("3 required blank", "HIGH", F.col("required") & blank & open_gate),
            ("7 none beside others", "HIGH", F.col("multi") & F.array_contains(parts, "none") & (F.size(parts) > 1)),
            ("8 gate closed", "MED", F.col("gate").isNotNull() & ~open_gate & ~blank),
            ("9 follow-up blank", "MED", F.col("gate").isNotNull() & open_gate & blank & ~F.col("required")),
            ("10 cosmetic", "LOW", single & inside & ~F.array_contains("options", F.col(answer))),
        ],
    ).select("check", "severity", "cell.*")
    twice = answers.groupBy(coder, item, question).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("5 item twice").alias("check"), F.lit("HIGH").alias("severity"), coder, item, question)
    per_item = answers.groupBy(item).agg(F.count_distinct(coder).alias("coders"))
    empty = answers.filter(F.trim(F.coalesce(answer, F.lit(""))) == "").groupBy(coder, item).agg(F.count("*").alias("n"), F.min(question).alias(question)).filter(F.col("n") >= blanks)
    anchor = empty.join(per_item.filter(F.col("coders") >= anchors), item).select(F.lit("6 anchor with blanks").alias("check"), F.lit("HIGH").alias("severity"), coder, item, question)
    lists_other = codebook.filter(F.array_contains(low(F.col("options")), "other")).select(F.col(question).alias("parent"))
    pairs = codebook.filter(F.coalesce(F.size("options"), F.lit(0)) == 0).select(F.col(question).alias("child"), "parent").join(lists_other, "parent")
    told = answers.select(item, coder, F.col(question).alias("asked"), F.trim(F.coalesce(answer, F.lit(""))).alias("told"))
    others = told.filter(F.array_contains(low(F.split("told", sep)), "other")).join(pairs, F.col("asked") == F.col("parent")).select(item, coder, "parent", "child").distinct()
    texts = told.filter("told <> ''").join(pairs, F.col("asked") == F.col("child")).select(item, coder, "parent", "child").distinct()
    orphan = lambda a, b, name, at: a.join(b, [item, coder, "parent", "child"], "left_anti").select(F.lit(name).alias("check"), F.lit("LOW").alias("severity"), coder, item, F.col(at).alias(question))
    orphans = orphan(others, texts, "4 other without text", "parent").unionByName(orphan(texts, others, "4 text without other", "child"))
    at = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MED", 1).otherwise(2)
    return issues.unionByName(twice).unionByName(anchor).unionByName(orphans).orderBy(at, coder, item, "check")


def assignment_checks(assigned: DataFrame, item: str, coder: str, group: str, coders: int, expected: Mapping[str, int]) -> DataFrame:
    """Checks of a coding design: distinct items, items per group, load per coder, coders per item. ``name, ok, detail``."""
    items = assigned.agg(F.count_distinct(item).alias("n")).select(F.lit("distinct items").alias("name"), (F.col("n") == expected["items"]).alias("ok"), "n")
    per_coder = assigned.groupBy(coder).agg(F.count("*").alias("k")).agg(F.sum((F.col("k") != expected["per_coder"]).cast("int")).alias("bad"), F.count("*").alias("c"))
    load = per_coder.select(F.lit("load per coder").alias("name"), ((F.col("bad") == 0) & (F.col("c") == coders)).alias("ok"), F.col("bad").cast("long").alias("n"))
    per_item = assigned.groupBy(item, group).agg(F.count_distinct(coder).alias("k"))
    wrong = F.when(F.col(group) == "all", F.col("k") != coders).when(F.col(group).startswith("pair"), F.col("k") != 2).otherwise(F.col("k") != 1)
    shared = per_item.agg(F.coalesce(F.sum(wrong.cast("int")), F.lit(0)).cast("long").alias("n")).select(F.lit("coders per item").alias("name"), (F.col("n") == 0).alias("ok"), "n")
    return items.unionByName(load).unionByName(shared)


def missing_fields(columns: Sequence[str]) -> Column:
    """How many of the columns are null or empty in a row."""
    return sum((F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), 1).otherwise(0) for c in columns), F.lit(0))


def risk_indicators(df: DataFrame, group: str, tests: Mapping[str, Column], least: int = 2) -> DataFrame:
    """Per group, which tests hold for at least so many rows: ``indicators`` names them."""
    counts = df.groupBy(group).agg(*(F.sum(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in tests.items()))
    return counts.select(group, *tests, F.array_join(F.array_compact(F.array(*(F.when(F.col(n) >= least, F.lit(n)) for n in tests))), "; ").alias("indicators"))


def same_order(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key stands at another place in the other table: none if both hold the same keys in the same order."""
    a = left.select(F.col(key).alias("left_key"), F.col(order).alias("place"))
    b = right.select(F.col(key).alias("right_key"), F.col(order).alias("place"))
    return a.join(b, "place", "full").filter(~F.col("left_key").eqNullSafe(F.col("right_key")))


def sheet_checks(rows: DataFrame, item: str, coder: str, group: str, place: str, text: str, master: DataFrame, tracker: DataFrame, whole: str = "all") -> DataFrame:
    """``name, bad``: checks of coders' files against the master table and the tracker; 0 is what each should say.

    Blank ids, blank texts, items twice in a file, places twice in a file, items the master doesn't know, texts that differ
    from the master's, shared items that a coder lacks, pair items that don't have two coders, single items that have
    several, shared items at different places, coders without a file, files that no tracker line names, loads that differ
    from the tracker's.
    """
    count = lambda df, name: df.agg(F.count("*").alias("bad")).select(F.lit(name).alias("name"), "bad")
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    twice = lambda *keys: rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    known = rows.select(item, F.trim(F.col(text)).alias("sc_text")).join(master.select(item, F.trim(F.col(text)).alias("sc_master"), F.lit(1).alias("sc_known")), item, "left")
    per_item = rows.groupBy(item, group).agg(F.count_distinct(coder).alias("coders"), F.count_distinct(place).alias("places"))
    loads = rows.groupBy(coder).agg(F.count("*").alias("n")).join(tracker.select(coder, F.col("load").alias("told")), coder, "full")
    everyone = rows.select(coder).distinct().agg(F.count("*").alias("all_coders"))
    shared = per_item.filter(F.col(group) == whole)
    found = [
        count(rows.filter(blank(item)), "blank id"),
        count(rows.filter(blank(text)), "blank text"),
        count(twice(coder, item), "item twice"),
        count(twice(coder, place), "place twice"),
        count(known.filter("sc_known is null"), "unknown item"),
        count(known.filter("sc_known is not null and not (sc_text <=> sc_master)"), "text differs"),
        count(shared.crossJoin(F.broadcast(everyone)).filter("coders <> all_coders"), "shared item missing"),  # one row
        count(per_item.filter(F.col(group).startswith("pair") & (F.col("coders") != 2)), "pair item without two"),
        count(per_item.filter(~F.col(group).startswith("pair") & (F.col(group) != whole) & (F.col("coders") != 1)), "single item with several"),
        count(shared.filter("places > 1"), "shared place differs"),
        count(loads.filter("n is null"), "coder without file"),
        count(loads.filter("told is null"), "file without tracker"),
        count(loads.filter("n <> told"), "load differs"),
    ]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out
