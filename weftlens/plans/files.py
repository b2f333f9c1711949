"""Queries of sources, sinks and windows in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftlens.plans.common import FLAGS, KEPT, TWEETS, Registry
from weftlens.runtime import table
from weftlens.sources import nested, sinks, tabular
from weftlens.streaming import incremental

R = Registry()


@R.query("select 'nation' as name, count(*) as n from nation union all select 'region', count(*) from region")
def src_04_parquet(spark, sf_dir):
    one = lambda n: tabular.read_table(spark, f"{sf_dir}/{n}.parquet").agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return one("nation").unionByName(one("region"))


@R.query("select 'region' as stem, count(*) as n from region")
def src_05_scan(spark, sf_dir):
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{sf_dir}/region.parquet").select(F.col("_metadata.file_path").alias("p"))
    return rows.groupBy(F.regexp_extract("p", r"/(region)\.parquet", 1).alias("stem")).agg(F.count("*").alias("n"))


_TEXT = ("url", "text", "comment_text", "language_detected", "keep_reason")


@R.query(" union all ".join(f"""select '{c}' as "column", round(avg(length({c})), 4) as mean_len, round(avg((trim(coalesce({c}, ''), ' ') <> '')::int), 4) as nonempty from tweet_there_is_no_amount_of""" for c in _TEXT))
def src_08_column_lengths(spark, sf_dir):
    out = tabular.column_lengths(table(spark, sf_dir, TWEETS).select(*_TEXT))
    return out.select("column", F.round("mean_len", 4).alias("mean_len"), F.round("nonempty", 4).alias("nonempty"))


@R.query("select id as post_id, coalesce(comment_text, text) as body, likes as like_count, null::varchar as place from tweet_there_is_no_amount_of")
def src_12_fixed_columns(spark, sf_dir):
    mapping = {"post_id": ["tweet_id", "id"], "body": ["full_text", "comment_text", "text"], "like_count": ["likes"], "place": ["geo"]}
    return nested.fixed_columns(table(spark, sf_dir, TWEETS), mapping, {"like_count": "long"})


@R.query("select event_id, (props->>'$.k')::bigint as k, null::varchar as author from events")
def src_11_item_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "props")
    return nested.item_columns(rows, "props", {"k": ["$.legacy.k", "$.k"], "author": ["$.author.userName", "$.author"]}, {"k": "long"})


@R.query("select option_id, lower(option_text) as term, case when option_pos <= 2 then 'highly' else 'moderately' end as tier from codebook_dim where option_pos <= 5")
def src_20_lexicon(spark, sf_dir):
    rows = table(spark, sf_dir, "codebook_dim").select("option_id", "option_text", F.when(F.col("option_pos") <= 2, "Highly relevant").when(F.col("option_pos") <= 4, " moderately ").when(F.col("option_pos") > 5, "low").alias("tier"), F.when(F.col("option_pos") == 5, "seems moderate to me").alias("said"))
    terms = tabular.load_lexicon(rows, "option_text", "tier", "said")
    return rows.select("option_id", F.lower("option_text").alias("term")).join(terms, "term")


@R.query("select c.creator, '[' || string_agg('\"' || replace(platform, '\"', '') || '\"', ',' order by platform) || ']' as platforms from (select distinct creator, platform from documents where creator is not null and platform is not null) c group by 1")
def snk_03_cells_as_text(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter("creator is not null and platform is not null").groupBy("creator").agg(F.array_sort(F.collect_set("platform")).alias("platforms"))
    return sinks.cells_as_text(rows)


@R.query("select flag_id as id, question_id, coder as rater from human_kenya_final_validation_flags")
def snk_11_exported(spark, sf_dir):
    rows = table(spark, sf_dir, FLAGS).select("coder", "question_id", "note", "flag_id")
    return sinks.exported(rows, ["note", "absent"], {"flag_id": "id", "coder": "rater"}, ["id", "question_id"])


@R.query("select row_id, case when video_id = (select min(video_id) from video_source) then 'swapped' else video_id end as video_id from filtered_v1_kept")
def snk_12_swap_id(spark, sf_dir):
    old = table(spark, sf_dir, "video_source").agg(F.min("video_id")).first()[0]
    return sinks.swap_id(table(spark, sf_dir, KEPT).select("row_id", "video_id"), "video_id", old, "swapped")


@R.query("""with m as (select *, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 2 hours then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from m)
select user_id, min(ts) as opened, max(ts) + interval 2 hours as closed, count(*) as pieces, round(sum(value), 6) as total from s group by user_id, k""")
def stream_gap_sessions(spark, sf_dir):
    return incremental.gap_sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "2 hours", "value")


@R.query("select time_bucket(interval 6 hours, ts) as opened, event_type, count(*) as n from events group by 1, 2")
def stream_windowed_counts(spark, sf_dir):
    return incremental.windowed_counts(table(spark, sf_dir, "events"), ["event_type"], "ts", "6 hours")


def queries():
    return R.queries


def oracle_sql():
    return R.sql
