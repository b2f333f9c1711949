"""Queries of copies hidden by formatting and of free-entered values, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlens.llm.canonical_values import Codebook, canonical_values, learned_aliases, without_typos
from weftlens.llm.format_copies import collapsed_records, format_copies
from weftlens.llm.listed import all_rows
from weftlens.runtime import table

#: Entries whose tries an executor can hold; more of them are an error.
MOST_ENTRIES = 200_000


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    tweets = table(spark, sf_dir, "tweet_there_is_no_amount_of").select(F.lit("tweet").alias("src_table"), "row_id", F.col("comment_text_norm").alias("record"))
    kept = table(spark, sf_dir, "filtered_v1_kept").select(F.lit("kept").alias("src_table"), "row_id", F.col("comment_text").alias("record"))
    return tweets.unionByName(kept)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that is a copy of an earlier one but for its format."""
    return format_copies(_records(spark, sf_dir), ["src_table"], "row_id", "record")


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record, with its number of copies."""
    return collapsed_records(_records(spark, sf_dir), ["src_table"], "row_id", "record")


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags, entries = table(spark, sf_dir, "human_kenya_final_validation_flags"), table(spark, sf_dir, "codebook_dim")
    listed = all_rows(entries.select("question_id", "option_id", "option_text", "option_note"), MOST_ENTRIES)
    learned = learned_aliases(flags, entries, "question_id", "content_id", "original_value", "cleaned_value", "option_id", "option_text")
    book = Codebook.build(listed, without_typos(learned, Codebook.build(listed)))
    return canonical_values(flags, book, "flag_id", "question_id", "original_value", "cleaned_value")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of each typed value, 0 for a value without one."""
    return _mapped(spark, sf_dir).select("flag_id", "option_id")


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells with an unmatched value, per question, with their number."""
    return _mapped(spark, sf_dir).filter("option_id = 0").groupBy("question", "typed").agg(F.count("*").alias("cells"))


_FLAT = r"translate(regexp_replace(lower({0}), '[\s\p{{Z}}\p{{P}}=|]+', '', 'g'), 'ς', 'σ')"
_FIELD = r"'^[\s\p{Z}\p{P}]*?(\p{L}[\p{L}\p{M}''’ ]{0,60}?)[\s\p{Z}]*(?:[:=]|[\s\p{Z}][-–—][\s\p{Z}])(.*)$'"
_P2_SQL = (
    r"""
with records as (
  select 'tweet' src_table, row_id, comment_text_norm record from tweet_there_is_no_amount_of
  union all select 'kept', row_id, comment_text from filtered_v1_kept
), usable as (
  select *, """
    + _FLAT.format("record")
    + r""" flat,
    list_filter(regexp_split_to_array(record, '\s*(?:\n|;|\||\s/\s)\s*'), lambda p: regexp_matches(p, '[\p{L}\p{N}]')) pieces
  from records where regexp_matches(record, '[\p{L}\p{N}]')
), fields as (
  select src_table, row_id, flat, case when len(pieces) >= 2 then list_transform(pieces, lambda p: [
    """
    + _FLAT.format(f"regexp_extract(p, {_FIELD}, 1)")
    + ", "
    + _FLAT.format(f"regexp_extract(p, {_FIELD}, 2)")
    + r"""]) end fields from usable
), forms as (
  select src_table, flat, min(list_sort(fields)::varchar) form from fields
  where fields is not null and len(list_filter(fields, lambda f: f[1] = '')) = 0 group by 1, 2
), keyed as (
  select f.src_table, row_id, coalesce('f' || form, 'p' || f.flat) as k from fields f left join forms using (src_table, flat)
), grouped as (
  select *, min(row_id) over (partition by src_table, k) first_row, count(*) over (partition by src_table, k) copies from keyed
)
"""
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (p2_found, p2_records, p5_found, p5_unmatched)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2_SQL + "select src_table, first_row, row_id as copy_row from grouped where row_id <> first_row",
        "p2_records": _P2_SQL + "select src_table, first_row, max(copies) as copies from grouped group by 1, 2",
    }
