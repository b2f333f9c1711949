"""Queries of aggregation and ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftlens.functions import lexicon as L
from weftlens.functions import text as T
from weftlens.operators import aggregate as A
from weftlens.operators import codebook as C
from weftlens.operators import ordered as W
from weftlens.operators.joins import funnel_join
from weftlens.plans.common import FLAGS, KEPT, MODERATE_TERMS, THEMES, TWEETS, Registry, sql_text
from weftlens.plans.scalars import _best, _padded, _quotes, _sq, _sum_hits
from weftlens.runtime import table

R = Registry()


def _kept(spark, sf_dir, *columns):
    return table(spark, sf_dir, KEPT).select("row_id", *columns)


@R.query("select keep_reason, count(*) as n, round(100.0 * count(*) / (select count(keep_reason) from filtered_v1_kept), 2) as pct from filtered_v1_kept group by 1")
def agg_01_value_counts(spark, sf_dir):
    return A.value_counts(_kept(spark, sf_dir, "keep_reason"), "keep_reason")


@R.query("select language_detected, count(*) as n, round(100.0 * count(*) / (select count(language_detected) from filtered_v1_kept), 2) as pct from filtered_v1_kept where language_detected is not null group by 1 order by 2 desc, 1 limit 5")
def agg_01_top_values(spark, sf_dir):
    return A.value_counts(_kept(spark, sf_dir, "language_detected"), "language_detected", count_null=False, top=5)


@R.query("select item_type, mode, keep, count(*) as n from filtered_v1_kept group by all")
def agg_02_multi_counts(spark, sf_dir):
    return A.multi_counts(_kept(spark, sf_dir, "item_type", "mode", "keep"), ["item_type", "mode", "keep"])


@R.query("select platform, count(*) filter (where content_type = 'post') as post, count(*) filter (where content_type = 'transcript') as transcript, count(*) filter (where content_type = 'memo') as memo from documents group by 1")
def agg_03_crosstab(spark, sf_dir):
    return A.crosstab(table(spark, sf_dir, "documents"), "platform", "content_type", ["post", "transcript", "memo"])


@R.query("select platform, content_type, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (partition by platform), 6) as pct from documents group by 1, 2")
def agg_04_row_percent(spark, sf_dir):
    return A.crosstab_percent(table(spark, sf_dir, "documents"), "platform", "content_type").withColumn("pct", F.round("pct", 6))


@R.query("select platform, content_type, count(*) as n, round(round(count(*) / sum(count(*)) over (partition by platform), 3) * 100, 4) as pct from documents group by 1, 2")
def agg_04_row_percent_rounded(spark, sf_dir):
    return A.crosstab_percent(table(spark, sf_dir, "documents"), "platform", "content_type", round_fraction=True).withColumn("pct", F.round("pct", 4))


@R.query("select source_file, count(*) as n, coalesce(sum(keep::int), 0) as kept, round(avg(vote_count), 4) as mean_votes, round(100.0 * avg((word_count >= 8)::int), 2) as pct_long from filtered_v1_kept group by 1")
def agg_05_named_aggregates(spark, sf_dir):
    return table(spark, sf_dir, KEPT).groupBy("source_file").agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.col("keep").cast("int")), F.lit(0)).alias("kept"), F.round(F.avg("vote_count"), 4).alias("mean_votes"), F.round(100.0 * F.avg((F.col("word_count") >= 8).cast("int")), 2).alias("pct_long")
    )


@R.query("select mode, count(vote_count) as n, round(avg(vote_count), 6) as mean, round(stddev_samp(vote_count), 6) as std, min(vote_count) as lowest, quantile_cont(vote_count::double, 0.25) as q1, quantile_cont(vote_count::double, 0.5) as median, quantile_cont(vote_count::double, 0.75) as q3, max(vote_count) as highest from filtered_v1_kept group by 1")
def agg_06_describe(spark, sf_dir):
    return A.describe_by(_kept(spark, sf_dir, "mode", "vote_count"), "mode", "vote_count").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@R.query(r"""with o as (select count(*)::double as "rows", (count(comment) - count(distinct comment))::double as repeated, sum((trim(coalesce(comment, ''), ' ') = '')::int)::double as empty, round(avg(case when comment is not null then len(list_filter(regexp_split_to_array(comment, '\s+'), lambda w: w <> '')) end), 4) as mean_words, sum((keep = true)::int)::double as flagged from filtered_v1_kept)
select 'rows' as metric, "rows" as value from o union all select 'repeated', repeated from o union all select 'empty', empty from o union all select 'mean_words', mean_words from o union all select 'flagged', flagged from o""")
def agg_07_overview(spark, sf_dir):
    return A.overview(_kept(spark, sf_dir, "comment", "keep"), "comment", "keep")


@R.query("select trim(unnest(string_split(option_note, ',')), ' ') as value, count(*) as n from codebook_dim group by 1")
def agg_08_list_counts(spark, sf_dir):
    return A.list_counts(table(spark, sf_dir, "codebook_dim"), F.transform(F.split("option_note", ","), lambda x: F.trim(x)))


_THEME_LIST = "list_filter([" + ", ".join(f"case when {_sum_hits(p, 'lower(comment)')} > 0 then {sql_text(x)} end" for x, p in THEMES.items()) + "], lambda x: x is not null)"


def _themes(df):
    return df.withColumn("low", F.lower("comment")).withColumn("themes", F.filter(L.all_labels(F.col("low"), THEMES, ""), lambda x: x != ""))


@R.query(f"select theme, label, count(*) as n, round(count(*) / sum(count(*)) over (partition by theme), 6) as share from (select unnest({_THEME_LIST}) as theme, keep_reason as label from filtered_v1_kept) group by 1, 2")
def agg_09_theme_label_share(spark, sf_dir):
    return A.theme_label_share(_themes(_kept(spark, sf_dir, "comment", "keep_reason")), F.col("themes"), "keep_reason").withColumn("share", F.round("share", 6))


@R.query(f"""select "left", unnest(b) as "right", count(*) as n from (select unnest({_THEME_LIST}) as "left", list_filter([case when keep then 'kept' end, mode], lambda x: x is not null) b from filtered_v1_kept) group by 1, 2""")
def agg_10_pair_counts(spark, sf_dir):
    rows = _themes(_kept(spark, sf_dir, "comment", "keep", "mode"))
    return A.pair_counts(rows, F.col("themes"), F.array_compact(F.array(F.when(F.col("keep"), "kept"), "mode")))


@R.query(f"""select "left", unnest(b) as "right", count(*) as n from (select unnest({_THEME_LIST}) as "left", {_THEME_LIST} b from filtered_v1_kept) group by 1, 2""")
def agg_11_cooccurrence(spark, sf_dir):
    return A.cooccurrence(_themes(_kept(spark, sf_dir, "comment")), F.col("themes"))


@R.query("""with d as (select creator, platform, n_chars, content_type from documents), t as (select creator, arg_min(content_type, (-n, content_type)) as top_label from (select creator, content_type, count(*) n from d where content_type is not null group by 1, 2) group by 1)
select d.creator, count(*) as n, round(avg(n_chars), 4) as mean_score, any_value(top_label) as top_label, array_to_string(list_sort(list_distinct(list(platform))), '; ') as members from d left join t on d.creator is not distinct from t.creator group by 1""")
def agg_12_group_profile(spark, sf_dir):
    return A.group_profile(table(spark, sf_dir, "documents").select("creator", "platform", "n_chars", "content_type"), "creator", "content_type", "n_chars", "platform")


@R.query("""select content_id, arg_min(question_id, (-v, seen, question_id)) as question_id, max(v) as votes from (select content_id, question_id, count(*) v, min(flag_id) seen from human_kenya_final_validation_flags where trim(coalesce(question_id, ''), ' ') <> '' group by 1, 2) group by 1""")
def agg_13_modal_vote(spark, sf_dir):
    return A.modal_vote(table(spark, sf_dir, FLAGS), ["content_id"], "question_id", "flag_id")


@R.query("""with v as (select user_id, coalesce(case when event_id % 9 = 0 then null else event_type end, 'none') as label, count(*) n, min(event_id) seen from events group by 1, 2),
m as (select user_id, arg_min(label, (-n, seen, label)) as modal, max(n) top, sum(n)::bigint runs from v group by 1),
s as (select v.user_id, list(label order by seen, label) as others from v join m on v.user_id = m.user_id and v.label <> m.modal and v.n >= 0.3 * m.runs group by 1),
j as (select user_id, '{' || string_agg('"' || label || '":' || n, ',' order by label) || '}' as votes_json from v group by 1)
select m.user_id, modal, round(top / runs, 3) as stability, coalesce(array_to_string(others[1:2], '; '), '') as secondary, votes_json from m join j using (user_id) left join s using (user_id)""")
def agg_14_repeat_votes(spark, sf_dir):
    """Over all events: a user's runs are their own events, so that no id or count bounds them."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("event_type"))
    return A.repeat_votes(rows, "user_id", "event_type", "event_id", None, "none")


@R.query("select event_id, case when s > 0 and s <= 0.5 then '<=0.50' when s > 0.5 and s <= 0.7 then '0.50-0.70' when s > 0.7 and s <= 0.85 then '0.70-0.85' when s > 0.85 and s <= 1.001 then '>0.85' end as bucket from (select event_id, (event_id % 23) / 20.0::double as s from events)")
def agg_15_stability_buckets(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", A.stability_bucket((F.col("event_id") % 23) / 20.0).alias("bucket"))


_FUNNEL = """with f as (select item_type, count(*) as "raw", count(*) filter (where trim(comment, ' ') <> '') as with_text, count(*) filter (where length(comment) >= 100) as long from filtered_v1_kept group by 1)
select item_type, 'raw' as stage, "raw" as n, round("raw" / "raw"::double, 4) as rate from f union all select item_type, 'with_text', with_text, round(with_text / "raw"::double, 4) from f union all select item_type, 'long', long, round(long / "raw"::double, 4) from f"""


@R.query(_FUNNEL)
def agg_16_stage_funnel(spark, sf_dir):
    rows = _kept(spark, sf_dir, "item_type", "comment")
    counts = funnel_join([("raw", rows), ("with_text", rows.filter("trim(comment) <> ''")), ("long", rows.filter("length(comment) >= 100"))], ["item_type"])
    return A.funnel_long(counts, ["item_type"], ["raw", "with_text", "long"])


_LEVEL = "case when flag_type = 'missing value' then 'HIGH' when flag_type like 'filled%' then 'MED' else 'LOW' end"


@R.query(f"""with l as (select coder, {_LEVEL} as lv from human_kenya_final_validation_flags), c as (select coder, count(*) filter (where lv = 'HIGH') as "HIGH", count(*) filter (where lv = 'MED') as "MED", count(*) filter (where lv = 'LOW') as "LOW", count(*) as total from l group by 1)
select * from c union all select 'TOTAL', sum("HIGH"), sum("MED"), sum("LOW"), sum(total) from c""")
def agg_17_severity_pivot(spark, sf_dir):
    return A.severity_pivot(table(spark, sf_dir, FLAGS).select("coder", F.expr(_LEVEL).alias("lv")), "coder", "lv", ["HIGH", "MED", "LOW"])


@R.query("select creator, count(distinct source) as sources, array_to_string(list_sort(list_distinct(list(content_type))), ', ') as kinds from documents group by 1")
def agg_18_distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("creator").agg(F.count_distinct("source").alias("sources"), F.array_join(F.array_sort(F.collect_set("content_type")), ", ").alias("kinds"))


@R.query("""with t as (select user_id, event_type, round(sum(value), 3) as seconds from events group by 1, 2), m as (select user_id, arg_min(event_type, (-seconds, event_type)) as most, sum(seconds) as s from t group by 1)
select user_id, event_type, seconds, round(seconds / nullif(s, 0), 4) as share, event_type is not distinct from most as dominant from t join m using (user_id)""")
def agg_19_spoken_time(spark, sf_dir):
    spans = table(spark, sf_dir, "events").select("user_id", "event_type", F.lit(0.0).alias("s"), F.col("value").alias("e"))
    return A.spoken_time(spans, "user_id", "event_type", "s", "e")


@R.query("select question, count(*) as cells, sum((old is distinct from new)::int) as changed from (select flag_id, 'value' as question, original_value as old, cleaned_value as new from human_kenya_final_validation_flags union all select flag_id, 'note', note, upper(note) from human_kenya_final_validation_flags) group by 1")
def agg_20_changed_cells(spark, sf_dir):
    flags = table(spark, sf_dir, FLAGS)
    before = flags.select("flag_id", F.col("original_value").alias("value"), "note")
    return C.changed_cells(before, flags.select("flag_id", F.col("cleaned_value").alias("value"), F.upper("note").alias("note")), "flag_id", ["value", "note"])


@R.query("select lang, count(*) as n, sum((n_chars > 500)::int) as n_long, round(100 * avg((n_chars > 500)::int), 2) as pct_long, sum((source is null)::int) as n_orphan, round(100 * avg((source is null)::int), 2) as pct_orphan from documents group by 1")
def agg_21_conditional_shares(spark, sf_dir):
    return A.conditional_shares(table(spark, sf_dir, "documents"), "lang", {"long": F.col("n_chars") > 500, "orphan": F.col("source").isNull()})


@R.query("select mode, case when coalesce(sum((keep)::int), 0) = 0 then 'n/a' else printf('1 : %.2f', sum((not keep)::int) / sum(keep::int)::double) end as ratio from filtered_v1_kept group by 1")
def agg_22_ratio_text(spark, sf_dir):
    sums = _kept(spark, sf_dir, "mode", "keep").groupBy("mode").agg(F.sum(F.col("keep").cast("int")).alias("a"), F.sum((~F.col("keep")).cast("int")).alias("b"))
    return sums.select("mode", A.ratio_text(F.col("a"), F.col("b")).alias("ratio"))


@R.query("""with q as (select question_id, case when question_id in ('Q2', 'Q8') then 'multi' else 'single' end as kind, avg((original_value = cleaned_value)::int) as score, case when count(*) % 2 = 0 then avg(length(original_value)) / 100 end as alpha from human_kenya_final_validation_flags group by 1)
select kind, round(avg(score), 6) as mean_score, round(avg(alpha), 6) as mean_alpha, count(*) as questions from q group by 1 union all select 'all', round(avg(score), 6), round(avg(alpha), 6), count(*) from q""")
def agg_23_score_summary(spark, sf_dir):
    scores = (
        table(spark, sf_dir, FLAGS)
        .groupBy("question_id")
        .agg(F.avg((F.col("original_value") == F.col("cleaned_value")).cast("int")).alias("score"), F.when(F.count("*") % 2 == 0, F.avg(F.length("original_value")) / 100).alias("alpha"))
        .withColumn("kind", F.when(F.col("question_id").isin("Q2", "Q8"), "multi").otherwise("single"))
    )
    return A.score_summary(scores, "kind", "score", "alpha").select("kind", "mean_score", "mean_alpha", "questions")


# ordered


@R.query("select row_id, round((vote_count - min(vote_count) over w) / (max(vote_count) over w - min(vote_count) over w + 1e-9), 6) as scaled from filtered_v1_kept window w as (partition by source_file)")
def win_01_minmax_scale(spark, sf_dir):
    return W.minmax_scale(_kept(spark, sf_dir, "source_file", "vote_count"), ["source_file"], "vote_count", "scaled").select("row_id", F.round("scaled", 6).alias("scaled"))


_CLEAN = _sq(_quotes("comment"))


@R.query(
    f"""with c as (select row_id, source_file, {_CLEAN} as cleaned from filtered_v1_kept), s as (select *, len(list_filter(string_split(cleaned, ' '), lambda w: w <> '')) as words from c where length(cleaned) >= 5),
    d as (select * from (select *, row_number() over (partition by source_file, lower(cleaned) order by row_id) k from s where words >= 8) where k = 1)
    select source_file, row_id, rank, words, text_hash from (select source_file, row_id, words, substring(sha256(cleaned), 1, 16) as text_hash, row_number() over (partition by source_file order by length(cleaned) desc, row_id) as rank from d) where rank <= 20"""
)
def topn_per_source(spark, sf_dir):
    """The funnel of the comment pipeline: cleaned, substantive, de-duplicated, the 20 longest per source with hash and words."""
    from weftlens.operators import dedup as D
    from weftlens.operators import filters as FL

    rows = _kept(spark, sf_dir, "source_file", "comment").select("row_id", "source_file", T.clean_comment(F.col("comment")).alias("cleaned"))
    rows = FL.enough_words(FL.long_enough(rows, "cleaned"), "cleaned", 8).withColumn("words", T.words_by_space(F.col("cleaned")).cast("long"))
    rows = D.keep_first(rows, ["source_file", F.lower("cleaned")], ["row_id"])
    top = W.top_n(rows, ["source_file"], [F.length("cleaned").desc(), F.col("row_id")], 20)
    return top.select("source_file", "row_id", F.col("rank").cast("long").alias("rank"), "words", T.short_hash(F.col("cleaned")).alias("text_hash"))


@R.query("select row_id, rank from (select row_id, row_number() over (partition by source_file order by vote_count desc nulls last, row_id) as rank from filtered_v1_kept) where rank <= 5")
def win_02_top_n(spark, sf_dir):
    return W.top_n(_kept(spark, sf_dir, "source_file", "vote_count"), ["source_file"], [F.col("vote_count").desc_nulls_last(), F.col("row_id")], 5).select("row_id", F.col("rank").cast("long").alias("rank"))


@R.query("select row_id, likes, retweets from tweet_there_is_no_amount_of order by likes desc nulls last, retweets desc nulls last, row_id limit 25")
def win_03_top_k(spark, sf_dir):
    return W.top_k(table(spark, sf_dir, TWEETS).select("row_id", "likes", "retweets"), [F.col("likes").desc_nulls_last(), F.col("retweets").desc_nulls_last(), F.col("row_id")], 25)


_EVENTS = "select user_id, event_id, event_type, epoch(ts) as s, epoch(ts) + value as e from events"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).select("user_id", "event_id", "event_type", "s", (F.col("s") + F.col("value")).alias("e"), F.col("event_id").cast("string").alias("word"))


@R.query(
    f"""with x as ({_EVENTS}), m as (select *, case when lag(event_id) over w is null or lag(event_type) over w is distinct from event_type or s - lag(e) over w > 3600 then 1 else 0 end as fresh from x window w as (partition by user_id order by s, event_id)),
    t as (select *, sum(fresh) over (partition by user_id order by s, event_id rows unbounded preceding) as turn from m)
    select user_id, turn, event_type, round(min(s), 3) as s, round(max(e), 3) as e, string_agg(event_id::varchar, ' ' order by s, event_id) as word from t group by 1, 2, 3"""
)
def win_05_sessions(spark, sf_dir):
    return W.sessions(_events(spark, sf_dir), "user_id", ["s", "event_id"], "event_type", "s", "e", "word", gap=3600.0)


@R.query(
    f"""with x as ({_EVENTS}), m as (select *, case when lag(event_id) over w is null or lag(event_type) over w is distinct from event_type then 1 else 0 end as fresh from x window w as (partition by user_id order by s, event_id)),
    t as (select *, sum(fresh) over (partition by user_id order by s, event_id rows unbounded preceding) as turn from m) select user_id, turn, event_type, count(*) as pieces from t group by 1, 2, 3"""
)
def win_06_merge_adjacent(spark, sf_dir):
    turns = W.sessions(_events(spark, sf_dir), "user_id", ["s", "event_id"], "event_type", "s", "e", "word", gap=None)
    return turns.select("user_id", "turn", "event_type", F.size(F.split("word", " ")).cast("long").alias("pieces"))


@R.query(
    """with w as (select user_id, event_id, event_type, list(event_type) over (partition by user_id order by event_id rows between 7 preceding and 7 following) near, count(*) over (partition by user_id) n from events)
    select event_id, case when n <= 15 then event_type else list_min(list_transform(list_distinct(near), lambda x: {'n': -len(list_filter(near, lambda y: y = x)), 'p': list_position(near, x), 'l': x})).l end as smooth from w"""
)
def win_04_majority_smooth(spark, sf_dir):
    return W.majority_smooth(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type", "smooth").select("event_id", "smooth")


@R.query("select event_id, coalesce(last_value(case when event_id % 3 = 0 then event_type end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding), 'none') as filled from events")
def win_08_forward_fill(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("label"))
    return W.forward_fill(rows, "user_id", "event_id", "label", "filled", "none").select("event_id", "filled")


@R.query("select doc_id, upper(substring(platform, 1, 3)) || '_' || lpad((row_number() over (partition by platform order by created_at, doc_id))::varchar, 4, '0') as item_id from documents")
def win_09_sequential_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "platform", "created_at")
    return W.sequential_ids(docs, "platform", ["created_at", "doc_id"], F.upper(F.substring("platform", 1, 3)), 4, "item_id").select("doc_id", "item_id")


@R.query("select s_suppkey, case when s_suppkey = f then 2 else n + (n >= 2)::int end as number from (select s_suppkey, min(s_suppkey) over (partition by s_nationkey) as f, row_number() over (partition by s_nationkey, s_suppkey = f2 order by s_suppkey) as n from (select s_suppkey, s_nationkey, min(s_suppkey) over (partition by s_nationkey) as f2 from supplier))")
def win_10_renumber(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").withColumn("pinned", F.col("s_suppkey") == F.min("s_suppkey").over(Window.partitionBy("s_nationkey")))
    return W.renumber(rows, "s_nationkey", "s_suppkey", "pinned", 2, "number").select("s_suppkey", F.col("number").cast("long").alias("number"))


@R.query(f"select flag_id, {_LEVEL} as lv, row_number() over (order by case when flag_type = 'missing value' then 0 when flag_type like 'filled%' then 1 else 2 end, coder, flag_id) as position from human_kenya_final_validation_flags")
def win_11_by_severity(spark, sf_dir):
    """Every flag with its place in the order."""
    flags = table(spark, sf_dir, FLAGS).select("flag_id", "coder", F.expr(_LEVEL).alias("lv"))
    return W.place_by_severity(flags, "lv", ["HIGH", "MED", "LOW"], "position", "coder", "flag_id").select("flag_id", "lv", "position")


@R.query("with f as (select user_id, event_type, min(ts) m from events group by 1, 2), r as (select user_id, event_type, 'Speaker ' || row_number() over (partition by user_id order by m, event_type) as speaker from f) select event_id, speaker from events join r using (user_id, event_type)")
def win_12_relabel(spark, sf_dir):
    return W.relabel_by_appearance(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "Speaker ", "speaker").select("event_id", "speaker")


@R.query("select event_id, (row_number() over (partition by user_id order by event_id) - 1) // 12 as batch from events")
def win_13_pack(spark, sf_dir):
    return W.pack(table(spark, sf_dir, "events"), "user_id", "event_id", 12).select("event_id", "batch")


@R.query("select doc_id from (select doc_id, row_number() over (partition by platform order by doc_id) r from documents) where r between 11 and 30")
def win_14_after_quota(spark, sf_dir):
    return W.rank_between(table(spark, sf_dir, "documents"), "platform", ["doc_id"], 11, 30).select("doc_id")


@R.query('select event_id, round(coalesce(sum(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0.0), 3) as "offset" from events')
def win_15_chained_offsets(spark, sf_dir):
    return W.chained_offsets(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("event_id", "offset")


@R.query(f"""with b as (select row_id, comment, case when ({_best.replace('lower(t)', 'lower(comment)')}).n > 0 then ({_best.replace('lower(t)', 'lower(comment)')}).label else 'none' end as theme from filtered_v1_kept where comment is not null), f as (select theme, count(*) n from b group by 1)
select row_id, theme from (select row_id, theme, n, row_number() over (partition by theme order by length(comment) desc, row_id) r from b join f using (theme)) where r <= 3 order by n desc, theme, r limit 28""")
def win_16_pick_quotes(spark, sf_dir):
    rows = _kept(spark, sf_dir, "comment").filter("comment is not null").withColumn("theme", L.best_label(F.lower("comment"), THEMES, "none"))
    return W.pick_quotes(rows, "theme", "comment", "row_id").select("row_id", "theme")


_TOTAL = f"regexp_extract_all({_padded.replace('lower(t)', 'lower(comment)')}, '(?:^|[^a-z0-9])({'|'.join(MODERATE_TERMS)})(?:$|[^a-z0-9])', 1)"


@R.query(f"select term, count(*) as files_rows, count(distinct source_file) as files from (select source_file, unnest(list_distinct({_TOTAL})) as term from filtered_v1_kept) group by 1")
def lex_09_match_summary(spark, sf_dir):
    rows = _kept(spark, sf_dir, "comment", "source_file").select("source_file", F.explode(L.keyword_hits(F.lower("comment"), MODERATE_TERMS)).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("files_rows"), F.count_distinct("source_file").alias("files"))


def queries():
    return R.queries


def oracle_sql():
    return R.sql
