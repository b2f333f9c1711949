"""Delimited files, column discovery, lexicons and caches."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlens.functions import text as T


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV, TSV, parquet or JSON lines by suffix; a byte-order mark is dropped, all delimited columns are text."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".jsonl", ".json")):
        return spark.read.json(path)
    sep = "\t" if path.endswith(".tsv") else ","
    df = spark.read.option("header", "true").option("sep", sep).option("multiLine", "true").option("quote", '"').option("escape", '"').csv(path)
    return df.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in df.columns})


def scan_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """``path, name, size`` of every file below a folder with a suffix, without office's temporary files; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path).select("path", F.col("length").alias("size"))
    return files.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).filter(~F.col("name").startswith("~$")).select("path", "name", "size")


def path_levels(df: DataFrame, path: str, root: str, names: Sequence[str]) -> DataFrame:
    """Folder levels below ``root`` as columns."""
    rest = F.split(F.regexp_replace(path, f"^.*?{re.escape(root)}/*", ""), "/")
    return df.withColumns({n: F.get(rest, F.lit(i)) for i, n in enumerate(names)})


def column_lengths(df: DataFrame) -> DataFrame:
    """``column, mean_len, nonempty, distinct_share`` of the text columns, in one pass."""
    texts = [c for c, t in df.dtypes if t == "string"]
    aggs = [f for i, c in enumerate(texts) for f in (F.avg(F.length(c)).alias(f"l{i}"), F.avg((F.trim(F.coalesce(c, F.lit(""))) != "").cast("int")).alias(f"n{i}"), (F.approx_count_distinct(c) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias(f"d{i}"))]
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"l{i}").alias("mean_len"), F.col(f"n{i}").alias("nonempty"), F.col(f"d{i}").alias("distinct_share")) for i, c in enumerate(texts)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def find_text_column(df: DataFrame, candidates: Sequence[str]) -> str:
    """The first candidate name that exists (whatever its case), else the text column with the longest mean text."""
    by_name = {c.lower(): c for c in df.columns}
    for name in candidates:
        if name.lower() in by_name:
            return by_name[name.lower()]
    rows = column_lengths(df).filter("mean_len is not null").orderBy(F.desc("mean_len"), "column").head(1)
    if not rows:
        raise ValueError("no text column")
    return rows[0]["column"]


def find_column(df: DataFrame, keywords: Sequence[str], override: str | None = None, long_text: bool = False) -> str | None:
    """The best column: 100 per keyword in its name, and for long texts 0.65 per mean character, 50 for being filled, 25 for
    being varied. An override wins if it exists."""
    if override:
        if override not in df.columns:
            raise ValueError(f"no column {override}")
        return override
    names = {c: 100 * sum(k.lower() in c.lower() for k in keywords) for c in df.columns}
    if long_text:
        for r in column_lengths(df).collect():  # one row per column
            names[r["column"]] += 0.65 * (r["mean_len"] or 0) + 50 * (r["nonempty"] or 0) + 25 * (r["distinct_share"] or 0)
    best = max(names.items(), key=lambda kv: kv[1], default=(None, 0))
    return best[0] if best[1] > 0 else None


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """The table, which fails when read if a key stands twice. Counting is a separate aggregate: nothing is collected."""
    twice = df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(1)
    if not twice.isEmpty():
        raise ValueError(f"{key} is not unique")
    return df


def load_lexicon(df: DataFrame, term: str, relevance: str, comment: str | None = None, tiers: Sequence[str] = ("highly", "moderately"), least: int = 2) -> DataFrame:
    """``term, tier`` of a term list: trimmed, of at least two letters, tiers as wanted; a missing tier is read from the
    reviewer's comment."""
    own = F.lower(F.trim(F.coalesce(relevance, F.lit(""))))
    if comment:
        said = F.lower(F.coalesce(comment, F.lit("")))
        own = F.when(own != "", own).when(said.contains("highly"), "highly").when(said.contains("moderate"), "moderately").otherwise(own)
    tier = F.lit(None).cast("string")
    for t in reversed(tiers):
        tier = F.when(own.startswith(t), F.lit(t)).otherwise(tier)
    return df.select(T.squeeze(F.lower(term)).alias("term"), tier.alias("tier")).filter((F.length("term") >= least) & F.col("tier").isNotNull()).groupBy("term").agg(F.min("tier").alias("tier"))


def load_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """``term`` of a text file; lines that are blank or start with ``#`` don't count."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("term")).filter((F.col("term") != "") & ~F.col("term").startswith("#")).distinct()


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if it is there, else made and written."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
