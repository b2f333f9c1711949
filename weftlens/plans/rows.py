"""Queries of row operators: filters, duplicates, joins, sets and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftlens.functions import text as T
from weftlens.operators import dedup as D
from weftlens.operators import filters as FL
from weftlens.operators import joins as J
from weftlens.operators import sampling as S
from weftlens.plans.common import (
    AUXILIARY, CONTEXT_TERMS, FAITH_TERMS, FLAGS, GENERIC_TERMS, HIGH_TERMS, HINTS, KEPT, LOW_CONTENT, MODERATE_TERMS, TWEETS, Registry, sql_text,
)
from weftlens.plans.scalars import _entities, _quotes, _sq, _terms_sql
from weftlens.runtime import table

R = Registry()


def _kept(spark, sf_dir, *columns):
    return table(spark, sf_dir, KEPT).select("row_id", *columns)


_WORDS = r"len(list_filter(regexp_split_to_array(comment, '\s+'), lambda w: w <> ''))"
_LONGEST = r"coalesce(list_max(list_transform(regexp_extract_all(comment, '([A-Za-z]+)', 1), lambda w: length(w))), 0)"


@R.query("select source_file, count(*) as n from filtered_v1_kept where length(trim(comment, ' ')) >= 5 group by 1")
def flt_01_long_enough(spark, sf_dir):
    return FL.long_enough(_kept(spark, sf_dir, "comment", "source_file"), "comment", 5).groupBy("source_file").agg(F.count("*").alias("n"))


@R.query(f"select source_file, count(*) as n from filtered_v1_kept where {_WORDS} >= 8 and length(comment) >= 100 group by 1")
def flt_02_enough_words(spark, sf_dir):
    return FL.enough_words(_kept(spark, sf_dir, "comment", "source_file"), "comment", 8, 100).groupBy("source_file").agg(F.count("*").alias("n"))


@R.query(rf"select row_id, length(comment) >= 8 and {_WORDS} >= 3 and len(regexp_extract_all(comment, '[A-Za-z'']+')) >= 2 and {_LONGEST} >= 3 as keep from filtered_v1_kept where comment is not null")
def flt_03_substantive(spark, sf_dir):
    return _kept(spark, sf_dir, "comment").filter("comment is not null").select("row_id", FL.substantive(F.col("comment")).alias("keep"))


_U, _M, _H = sql_text(T.URL), sql_text(T.MENTION), sql_text(T.HASHTAG)


def _ladder_tests(c: str) -> dict[str, str]:
    return {
        "url_only": f"trim({c}, ' ') <> '' and trim(regexp_replace({c}, {_U}, '', 'g'), ' ') = ''",
        "tags_only": f"trim({c}, ' ') <> '' and trim(regexp_replace(regexp_replace({c}, {_M}, '', 'g'), {_H}, '', 'g'), ' ') = ''",
        "no_words": rf"trim({c}, ' ') <> '' and not regexp_matches({c}, '[\p{{L}}\p{{N}}]')",
        "compat": rf"regexp_replace(regexp_replace({c}, '[A-Za-z0-9]', '', 'g'), '\s+', '', 'g') <> ''",
        "low_content": f"len(regexp_extract_all({c}, '[A-Za-z0-9_]+')) <= 4 and trim(regexp_replace(lower({c}), '[^a-z0-9 ]', '', 'g'), ' ') in ({', '.join(map(sql_text, LOW_CONTENT))})",
    }


@R.query("select row_id, " + ", ".join(f"{s} as {n}" for n, s in _ladder_tests("text").items()) + " from tweet_there_is_no_amount_of where text is not null")
def flt_04_content_tests(spark, sf_dir):
    c = F.col("text")
    tests = {"url_only": FL.url_only(c), "tags_only": FL.tags_only(c), "no_words": FL.no_words(c), "compat": FL.no_words(c, compat=True), "low_content": FL.low_content(c, LOW_CONTENT)}
    return table(spark, sf_dir, TWEETS).filter("text is not null").select("row_id", *(v.alias(n) for n, v in tests.items()))


_FORM = _sq("lower(" + _quotes("coalesce(comment, '')") + ")")
_HINT = {n: "(" + " or ".join(f"contains(low, {sql_text(x)})" for x in terms) + ")" for n, terms in HINTS.items()}
_N_HINTS = "(" + " + ".join(f"{h}::int" for h in _HINT.values()) + ")"
_TOKENS = "len(regexp_extract_all(low, '[A-Za-z0-9_]+'))"
_STRUCTURED = f"({_TOKENS} >= 8 or ({_TOKENS} >= 5 and {_N_HINTS} >= 1) or ({_TOKENS} >= 3 and {_N_HINTS} >= 2) or regexp_matches(low, {sql_text(AUXILIARY)}))"


@R.query(f"select row_id, {_STRUCTURED} as structured from (select row_id, {_FORM} as low from filtered_v1_kept)")
def flt_05_structured(spark, sf_dir):
    return _kept(spark, sf_dir, "comment").select("row_id", FL.structured(T.filter_form(F.coalesce("comment", F.lit(""))), HINTS, AUXILIARY).alias("structured"))


def _tier_sql(high, moderate) -> str:
    tiers = [("high_hits", high), ("moderate_hits", moderate), ("context_hits", CONTEXT_TERMS)]
    picked = ", ".join(f"coalesce({_terms_sql(sorted(x)).replace('lower(t)', 'low')}, '') as {n}" for n, x in tiers)
    n = lambda c: f"(case when {c} = '' then 0 else len(string_split({c}, '; ')) end)"
    reason = f"case when {n('high_hits')} >= 1 then '>=1_high' when {n('moderate_hits')} >= 2 then '>=2_moderate' when {n('moderate_hits')} >= 1 and {n('context_hits')} >= 1 then '>=1_moderate_plus_context' else 'reject' end"
    return f"select *, keep_reason <> 'reject' as keep from (select *, {reason} as keep_reason from (select row_id, {picked} from (select row_id, {_FORM} as low from filtered_v1_kept)))"


@R.query(_tier_sql(HIGH_TERMS, MODERATE_TERMS))
def flt_06_keyword_tier_v1(spark, sf_dir):
    return FL.keyword_tier_rule(_kept(spark, sf_dir, "comment"), "comment", HIGH_TERMS, MODERATE_TERMS, CONTEXT_TERMS).drop("comment")


@R.query(_tier_sql(HIGH_TERMS, [x for x in MODERATE_TERMS if x not in GENERIC_TERMS]))
def flt_06_keyword_tier_v2(spark, sf_dir):
    return FL.keyword_tier_rule(_kept(spark, sf_dir, "comment"), "comment", HIGH_TERMS, MODERATE_TERMS, CONTEXT_TERMS, GENERIC_TERMS, "v2").drop("comment")


def _substance_sql(mode: str, compat: bool) -> str:
    tests = _ladder_tests("low")
    ladder = f"when low = '' then 'empty' when {tests['url_only']} then 'url_only' when {tests['tags_only']} then 'tags_mentions_only' when {tests['compat' if compat else 'no_words']} then 'emoji_or_punct_only' when {tests['low_content']} then 'low_content_short' "
    if mode == "v1":
        ladder += f"when {_TOKENS} < 3 then 'too_few_words_v1' when {_STRUCTURED} then 'substantive_v1' else 'not_substantive_v1' end"
    else:
        ladder += f"when {_TOKENS} < 5 then 'too_few_words_v2' when {_TOKENS} >= 8 then 'substantive_v2_len' when {_N_HINTS} >= 1 and {_STRUCTURED} then 'substantive_v2_signal' else 'not_substantive_v2' end"
    flags = ", ".join(f"{h} as has_{n}_hint" for n, h in _HINT.items())
    return f"select row_id, {flags}, {_TOKENS} as word_total, keep_reason, starts_with(keep_reason, 'substantive') as keep from (select *, case {ladder} as keep_reason from (select row_id, {_FORM} as low from filtered_v1_kept))"


def _substance(mode: str, compat: bool = False):
    def run(spark, sf_dir):
        out = FL.substance_rule(_kept(spark, sf_dir, "comment"), "comment", HINTS, LOW_CONTENT, AUXILIARY, mode, compat).drop("comment")
        return out.withColumn("word_total", F.col("word_total").cast("long"))

    return run


for _mode, _compat in (("v1", False), ("v2", False), ("v1", True)):
    R.query(_substance_sql(_mode, _compat), name=f"flt_07_substance_{_mode}{'_compat' if _compat else ''}")(_substance(_mode, _compat))


@R.query("select count(*) as n from filtered_v1_kept where coalesce(lower(regexp_replace(author, '^@', '')) <> 'uncle storm', true)")
def flt_08_not_self_authored(spark, sf_dir):
    return FL.not_self_authored(_kept(spark, sf_dir, "author"), "author", "@Uncle Storm").agg(F.count("*").alias("n"))


_GRAMS = r"list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' ')))"
_SPLIT = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}\p{{M}}'']+'), lambda x: x <> '')"


@R.query(
    f"""with posts as (select distinct unnest({_GRAMS}) gram from (select {_SPLIT.format('text')} w from documents where source = 'microblog_posts')),
    rows as (select row_id, unnest({_GRAMS}) gram from (select row_id, {_SPLIT.format('comment')} w from filtered_v1_kept)),
    quoted as (select row_id from rows left join posts using (gram) group by 1 having avg((posts.gram is not null)::int) >= 0.5)
    select row_id from filtered_v1_kept where row_id not in (select row_id from quoted)"""
)
def flt_09_drop_quotes(spark, sf_dir):
    posts = table(spark, sf_dir, "documents").filter("source = 'microblog_posts'")
    return FL.drop_quotes(_kept(spark, sf_dir, "comment"), "comment", posts, "text", ["row_id"]).select("row_id")


@R.query(r"select row_id, regexp_replace(comment, '^(\s*@[A-Za-z0-9_.-]+[ :,]*)+', '') as reply from filtered_v1_kept")
def flt_10_strip_handles(spark, sf_dir):
    return _kept(spark, sf_dir, "comment").select("row_id", FL.strip_leading_handles(F.col("comment")).alias("reply"))


_FAITH = "|".join(FAITH_TERMS)


@R.query(f"select source_file, count(*) as n from filtered_v1_kept where not coalesce(regexp_matches(lower(comment), {sql_text(_FAITH)}), false) group by 1")
def flt_11_religious_strip(spark, sf_dir):
    return FL.drop_terms(_kept(spark, sf_dir, "comment", "source_file"), "comment", _FAITH).groupBy("source_file").agg(F.count("*").alias("n"))


@R.query("select doc_id, case when doc_id % 7 = 0 then 'curated ' || doc_id else text end as text from documents where doc_id % 5 <> 0")
def flt_12_exclusions_overrides(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    curated = docs.filter("doc_id % 7 = 0").select("doc_id", F.concat(F.lit("curated "), F.col("doc_id").cast("string")).alias("curated"))
    return FL.with_overrides(FL.without_ids(docs, docs.filter("doc_id % 5 = 0"), "doc_id"), curated, "doc_id", "text", "curated")


@R.query(f"select row_id from tweet_there_is_no_amount_of where text is not null and not starts_with(text, 'RT @') and not (trim(regexp_replace(text, {_U}, '', 'g'), ' ') = '' and trim(text, ' ') <> '') and regexp_matches(lower(text), 'money|pesa|owo')")
def flt_13_posts(spark, sf_dir):
    posts = table(spark, sf_dir, TWEETS).select("row_id", "text").filter("text is not null")
    return posts.filter(~F.col("text").startswith("RT @") & ~FL.url_only(F.col("text")) & F.lower("text").rlike("money|pesa|owo")).select("row_id")


@R.query("select reason, count(*) as n from (select case when regexp_matches(lower(comment), 'i grew up|my age i can say') then 'first_person' when regexp_matches(lower(comment), 'best part|got me|sweet me') then 'filler' end as reason from filtered_v1_kept) where reason is not null group by 1")
def flt_14_reason_counts(spark, sf_dir):
    low = F.lower("comment")
    return FL.reason_counts(_kept(spark, sf_dir, "comment"), F.when(low.rlike("i grew up|my age i can say"), "first_person").when(low.rlike("best part|got me|sweet me"), "filler"))


@R.query("select keep_reason, count(*) as n from filtered_v1_kept where keep = true and trim(comment_text, ' ') <> '' group by 1")
def flt_15_kept_rows(spark, sf_dir):
    return FL.kept_rows(_kept(spark, sf_dir, "keep", "keep_reason", "comment_text"), "keep", "comment_text").groupBy("keep_reason").agg(F.count("*").alias("n"))


@R.query("select row_id, case when item_type = 'comment' then regexp_matches(lower(comment), 'money|anger') else regexp_matches(lower(comment), 'weakness|pride') end as relevant from filtered_v1_kept where comment is not null")
def flt_16_relevant_by_kind(spark, sf_dir):
    low = F.lower("comment")
    return _kept(spark, sf_dir, "comment", "item_type").filter("comment is not null").select("row_id", F.when(F.col("item_type") == "comment", low.rlike("money|anger")).otherwise(low.rlike("weakness|pride")).alias("relevant"))


@R.query("""with hits as (select row_id, comment from filtered_v1_kept where regexp_matches(lower(comment), 'weakness')), long as (select row_id, comment from filtered_v1_kept where length(comment) >= 150 and not regexp_matches(lower(comment), 'weakness'))
select comment, min(row_id) as row_id from (select * from hits union all select * from long) group by 1""")
def flt_18_candidates(spark, sf_dir):
    rows = _kept(spark, sf_dir, "comment")
    hit = F.lower("comment").rlike("weakness")
    both = rows.filter(hit).unionByName(rows.filter((F.length("comment") >= 150) & ~hit))
    return D.keep_first(both, ["comment"], ["row_id"])


@R.query("select t.row_id from tweet_there_is_no_amount_of t where not exists (select 1 from filtered_v1_kept k where trim(k.comment, ' ') = trim(t.text, ' ')) and t.text is not null")
def flt_19_already_present(spark, sf_dir):
    have = table(spark, sf_dir, KEPT).select(F.trim("comment").alias("trimmed")).distinct()
    return table(spark, sf_dir, TWEETS).filter("text is not null").select("row_id", F.trim("text").alias("trimmed")).join(have, "trimmed", "left_anti").select("row_id")


# duplicates


@R.query("select row_id, comment from (select *, row_number() over (partition by comment order by row_id) r from filtered_v1_kept) where r = 1")
def dup_01_keep_first(spark, sf_dir):
    return D.keep_first(_kept(spark, sf_dir, "comment"), ["comment"], ["row_id"])


@R.query(f"select row_id from (select row_id, row_number() over (partition by source_file, {_sq('lower(' + _quotes('comment') + ')')} order by row_id) r from filtered_v1_kept) where r = 1")
def dup_02_by_source(spark, sf_dir):
    return D.keep_first(_kept(spark, sf_dir, "comment", "source_file"), ["source_file", T.filter_form(F.col("comment"))], ["row_id"]).select("row_id")


_DUPKEY = rf"regexp_replace(regexp_replace(regexp_replace(lower(text), {_U}, ' ', 'g'), {_M}, ' ', 'g'), '[^\p{{L}}\p{{N}}]+', '', 'g')"


@R.query(f"select row_id, likes from (select row_id, likes, row_number() over (partition by {_DUPKEY} order by likes desc nulls last, posted_at desc nulls last, row_id) r from tweet_there_is_no_amount_of) where r = 1")
def dup_03_keep_best(spark, sf_dir):
    posts = table(spark, sf_dir, TWEETS).select("row_id", "text", "likes", "posted_at")
    return D.keep_best(posts, T.duplicate_key(F.col("text")), [F.col("likes"), F.col("posted_at")], "row_id").select("row_id", "likes")


@R.query(f"""with k as (select row_id, id, {_DUPKEY} as key from tweet_there_is_no_amount_of),
a as (select row_id, id from (select *, row_number() over (partition by key order by row_id) r from k where key <> '') where r = 1 union all select row_id, id from k where key = '' or key is null)
select row_id, id from (select *, row_number() over (partition by id order by row_id) r from a) where r = 1""")
def dup_04_two_stage(spark, sf_dir):
    return D.two_stage(table(spark, sf_dir, TWEETS).select("row_id", "id", "text"), T.duplicate_key(F.col("text")), "id", ["row_id"]).select("row_id", "id")


@R.query("select row_id, coalesce(comment is not null and count(*) over (partition by comment) > 1, false) as is_duplicate from filtered_v1_kept")
def dup_05_flag_duplicates(spark, sf_dir):
    return D.flag_duplicates(_kept(spark, sf_dir, "comment"), F.col("comment")).select("row_id", "is_duplicate")


@R.query("select id, row_id from (select id, row_id, row_number() over (partition by id order by loaded_at desc nulls last, row_id desc) r from tweet_there_is_no_amount_of) where r = 1")
def dup_06_keep_last(spark, sf_dir):
    return D.keep_last(table(spark, sf_dir, TWEETS).select("id", "row_id", "loaded_at"), ["id"], ["loaded_at", "row_id"]).select("id", "row_id")


@R.query("select row_id, len(list_distinct(string_split(lower(comment), ' '))) as n from filtered_v1_kept where comment is not null")
def dup_07_ordered_distinct(spark, sf_dir):
    return _kept(spark, sf_dir, "comment").filter("comment is not null").select("row_id", F.size(F.array_distinct(F.split(F.lower("comment"), " ", -1))).cast("long").alias("n"))


@R.query("select title, arg_min(page_url, published_at) as page_url from video_source where page_url is not null group by 1")
def dup_10_first_of_key(spark, sf_dir):
    return D.first_of_key(table(spark, sf_dir, "video_source"), "title", "page_url", "published_at")


# joins


@R.query("select d.doc_id, coalesce(v.relevant, false) as relevant from documents d left join (select doc_id, doc_id % 2 = 0 as relevant from documents where doc_id % 3 = 0) v using (doc_id)")
def jon_01_verdicts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return J.with_verdicts(docs, docs.filter("doc_id % 3 = 0").withColumn("relevant", F.col("doc_id") % 2 == 0), "doc_id", "relevant")


@R.query("select d.doc_id, v.code, trim(coalesce(text, ''), ' ') = '' or v.doc_id is null as needs_review from documents d left join (select doc_id, doc_id % 4 as code from documents where doc_id % 3 = 0) v using (doc_id)")
def jon_02_codes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = docs.filter("doc_id % 3 = 0").select("doc_id", (F.col("doc_id") % 4).alias("code"))
    return J.with_codes(docs, coded, "doc_id", "text").drop("text")


@R.query("select a.doc_id, a, b, c from (select doc_id, doc_id % 5 a from documents where doc_id % 2 = 0) a join (select doc_id, doc_id % 7 b from documents where doc_id % 3 = 0) b using (doc_id) left join (select doc_id, doc_id % 11 c from documents where doc_id % 4 = 0) c using (doc_id)")
def jon_03_passes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    one = lambda k, n, name: docs.filter(f"doc_id % {k} = 0").withColumn(name, F.col("doc_id") % n)
    return J.pass_results(one(2, 5, "a"), one(3, 7, "b"), one(4, 11, "c"), "doc_id")


@R.query("select row_id, sha1('scope::' || trim(comment, ' ')) as cache_key, r.n as result from filtered_v1_kept k left join (select sha1('scope::' || trim(text, ' ')) h, count(*) n from tweet_there_is_no_amount_of where text is not null group by 1) r on r.h = sha1('scope::' || trim(k.comment, ' '))")
def jon_04_cached_results(spark, sf_dir):
    cache = table(spark, sf_dir, TWEETS).filter("text is not null").groupBy(T.content_key(F.col("text"), "scope").alias("cache_key")).agg(F.count("*").alias("result"))
    return J.cached_results(_kept(spark, sf_dir, "comment"), cache, "comment", "scope", "result").select("row_id", "cache_key", "result")


@R.query("select case when b.id is null then 'only_left' when a.id is null then 'only_right' else 'both' end as side, count(*) as n from (select distinct video_id id from filtered_v1_kept where video_id is not null and vote_count > 5) a full join (select distinct video_id id from video_source) b using (id) group by 1")
def jon_05_id_overlap(spark, sf_dir):
    left = _kept(spark, sf_dir, "video_id", "vote_count").filter("vote_count > 5 and video_id is not null")
    return J.id_overlap(left, table(spark, sf_dir, "video_source"), "video_id")


_STAGES = (("raw", "true"), ("with_text", "trim(comment) <> ''"), ("eight_words", "size(split(comment, ' ')) >= 8"))


@R.query("select a.item_type, a.mode, raw, with_text, eight_words from (select item_type, mode, count(*) raw from filtered_v1_kept group by all) a join (select item_type, mode, count(*) with_text from filtered_v1_kept where trim(comment, ' ') <> '' group by all) b using (item_type, mode) join (select item_type, mode, count(*) eight_words from filtered_v1_kept where len(string_split(comment, ' ')) >= 8 group by all) c using (item_type, mode)")
def jon_06_funnel(spark, sf_dir):
    rows = _kept(spark, sf_dir, "item_type", "mode", "comment")
    return J.funnel_join([(n, rows.filter(test)) for n, test in _STAGES], ["item_type", "mode"])


@R.query("select count(*) filter (where o.o_custkey is not null) as n_in, count(*) filter (where o.o_custkey is null) as n_out from customer left join (select distinct o_custkey from orders) o on c_custkey = o_custkey")
def jon_07_membership(spark, sf_dir):
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    inside = customers.join(orders, "c_custkey", "left_semi").agg(F.count("*").alias("n_in"))
    return inside.crossJoin(customers.join(orders, "c_custkey", "left_anti").agg(F.count("*").alias("n_out")))  # one row each


@R.query("select creator, count(*) as n from (select coalesce(v.creator, 'unknown') as creator from filtered_v1_kept k left join video_source v using (video_id)) group by 1")
def jon_08_lookup(spark, sf_dir):
    return J.lookup(_kept(spark, sf_dir, "video_id"), table(spark, sf_dir, "video_source"), "video_id", "creator", "unknown").groupBy("creator").agg(F.count("*").alias("n"))


def _jk(c: str) -> str:
    return _sq(f"lower(replace({_quotes(_entities(c, 4))}, '…', '...'))")


@R.query(
    f"""with f as (select flag_id, {_jk('original_value')} a from human_kenya_final_validation_flags), o as (select option_id, {_jk('option_text')} b from codebook_dim)
    select flag_id, coalesce(min(case when a = b then option_id end), min(case when a <> '' and (contains(' ' || a || ' ', ' ' || b || ' ') or contains(' ' || b || ' ', ' ' || a || ' ')) then option_id end)) as matched from f, o group by 1"""
)
def jon_09_contains_join(spark, sf_dir):
    flags, options = table(spark, sf_dir, FLAGS).select("flag_id", "original_value"), table(spark, sf_dir, "codebook_dim").select("option_text", "option_id", F.col("option_id").alias("pos"))
    return J.contains_join(flags, options, "flag_id", "original_value", "option_text", "option_id", "pos").select("flag_id", "matched")


_SPANS = """with p as (select user_id, event_id, epoch(ts) as pt from events where event_type = 'view'),
i as (select user_id, event_id as label, epoch(ts) as s, epoch(ts) + value * 20 as e from events where event_type = 'click' and value >= 0)"""


def _spans(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    points = events.filter("event_type = 'view'").select("user_id", "event_id", "at")
    spans = events.filter("event_type = 'click' and value >= 0").select("user_id", F.col("event_id").alias("label"), F.col("at").alias("s"), (F.col("at") + F.col("value") * 20).alias("e"))
    return points, spans


@R.query(
    _SPANS
    + """, m as (select event_id, label, greatest(s - pt, pt - e, 0.0) gap, s, e from p join i using (user_id) where greatest(s - pt, pt - e, 0.0) <= 300)
    select p.event_id, coalesce(b.label::varchar, 'Unknown') as speaker from p left join (select event_id, arg_min(label, (gap, s, e, label)) as label from m group by 1) b using (event_id)"""
)
def jon_11_point_in_interval(spark, sf_dir):
    points, spans = _spans(spark, sf_dir)
    spans = spans.withColumn("speaker", F.col("label").cast("string"))
    return J.point_in_interval(points, spans, "user_id", "event_id", "at", "s", "e", "speaker", tolerance=300.0, width=3600.0).select("event_id", "speaker")


@R.query(
    _SPANS
    + """, g as (select user_id, event_id, pt as s0, pt + 900 as e0 from p), x as (select event_id, label, least(e0, e) - greatest(s0, s) as o, s, e, abs((s + e) / 2 - (s0 + e0) / 2) as d from g join i using (user_id))
    select g.event_id, coalesce(a.label, b.label) as label from g left join (select event_id, arg_min(label, (-o, s, e, label)) as label from x where o > 0 group by 1) a using (event_id) left join (select event_id, arg_min(label, (d, s, e, label)) as label from x group by 1) b using (event_id)"""
)
def jon_12_max_overlap(spark, sf_dir):
    points, spans = _spans(spark, sf_dir)
    segments = points.withColumn("e0", F.col("at") + 900)
    return J.max_overlap(segments, spans, "user_id", "event_id", "at", "e0", "s", "e", "label", width=3600.0).select("event_id", "label")


@R.query("select c_custkey, iteration from customer, (select unnest(range(1, 4)) as iteration) where not (c_custkey % 2 = 0 and iteration = 2)")
def jon_14_iterations(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    done = customers.filter("c_custkey % 2 = 0").withColumn("iteration", F.lit(2))
    return J.iterations(customers, "c_custkey", 3, done).withColumn("iteration", F.col("iteration").cast("long"))


@R.query("select k.row_id, case when v.video_id is null then 'unknown id' when trim(k.title, ' ') is not distinct from trim(v.title, ' ') then 'ok' else 'differs' end as status from filtered_v1_kept k left join video_source v using (video_id)")
def jon_15_verbatim(spark, sf_dir):
    master = table(spark, sf_dir, "video_source").select("video_id", F.col("title").alias("master_title"))
    return J.verbatim_check(_kept(spark, sf_dir, "video_id", "title"), master, "video_id", "title", "master_title").select("row_id", "status")


@R.query("select doc_id, length(text) as size__chars, lang as label__lang from documents")
def jon_16_attach(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return J.attach(docs.select("doc_id"), "doc_id", {"size": docs.select("doc_id", F.length("text").cast("long").alias("chars")), "label": docs.select("doc_id", "lang")})


# sets and samples


@R.query("select 'tweet' as src, row_id as id, text, null as author from tweet_there_is_no_amount_of union all select 'kept', row_id, comment, author from filtered_v1_kept")
def set_01_union(spark, sf_dir):
    tweets = table(spark, sf_dir, TWEETS).select(F.lit("tweet").alias("src"), F.col("row_id").alias("id"), "text")
    kept = _kept(spark, sf_dir, "comment", "author").select(F.lit("kept").alias("src"), F.col("row_id").alias("id"), F.col("comment").alias("text"), "author")
    return tweets.unionByName(kept, allowMissingColumns=True)


@R.query("select 'both' as part, count(*) as n from (select c_nationkey from customer intersect select s_nationkey from supplier) union all select 'either', count(*) from (select c_nationkey from customer union select s_nationkey from supplier) union all select 'only_left', count(*) from (select c_nationkey from customer except select s_nationkey from supplier)")
def set_02_sets(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer").select("c_nationkey"), table(spark, sf_dir, "supplier").select("s_nationkey")
    parts = {"both": a.intersect(b), "either": a.union(b).distinct(), "only_left": a.exceptAll(b).distinct().join(b, F.col("c_nationkey") == F.col("s_nationkey"), "left_anti")}
    out = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n") for n, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@R.query("select option_id, trim(unnest(string_split(option_note, ',')), ' ') as wording from codebook_dim")
def set_04_explode(spark, sf_dir):
    return table(spark, sf_dir, "codebook_dim").select("option_id", F.explode(F.split("option_note", ",")).alias("w")).select("option_id", F.trim("w").alias("wording"))


@R.query("select row_id, 'likes' as measure, likes as n from tweet_there_is_no_amount_of union all select row_id, 'replies', replies from tweet_there_is_no_amount_of union all select row_id, 'retweets', retweets from tweet_there_is_no_amount_of")
def set_05_unpivot(spark, sf_dir):
    return table(spark, sf_dir, TWEETS).select("row_id", "likes", "replies", "retweets").unpivot("row_id", ["likes", "replies", "retweets"], "measure", "n")


@R.query("select event_id, (props->>'$.k')::bigint as k from events")
def set_06_json_columns(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("r")).select("event_id", "r.*")


@R.query("select flag_id, o.option_id, list_contains(list_transform(string_split(cleaned_value, ', '), lambda x: lower(trim(x, ' '))), lower(o.option_text))::int as present from human_kenya_final_validation_flags f join codebook_dim o using (question_id) where cleaned_value is not null")
def set_07_option_flags(spark, sf_dir):
    from weftlens.operators.codebook import option_flags

    flags = table(spark, sf_dir, FLAGS).filter("cleaned_value is not null").select("flag_id", "question_id", "cleaned_value")
    options = table(spark, sf_dir, "codebook_dim").select("question_id", "option_id", "option_text")
    return option_flags(flags, options, "question_id", "cleaned_value", "option_text", ", ").select("flag_id", "option_id", "present")


@R.query()
def smp_01_stratified(spark, sf_dir):
    return S.stratified_sample(_kept(spark, sf_dir, "source_file"), ["source_file"], "row_id", 5)


@R.query()
def smp_02_global(spark, sf_dir):
    return S.global_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 200)


_TIERS = "case when keep_reason = 'piece_relevant' then 'TIER1' when keep_reason = 'experience_shared' then 'TIER2' else 'DROP' end"


@R.query(f"""select row_id, orientation, sample_rank from (select row_id, orientation, row_number() over (partition by orientation order by tier, length(comment) desc, row_id) as sample_rank from
(select row_id, comment, case when mode = 'v1' then 'progressive' else 'regressive' end as orientation, {_TIERS} as tier from filtered_v1_kept where comment is not null) where tier <> 'DROP' and (orientation = 'progressive' or tier = 'TIER1')) where sample_rank <= 100""")
def smp_03_orientation(spark, sf_dir):
    rows = _kept(spark, sf_dir, "comment", "mode", "keep_reason").filter("comment is not null").select("row_id", "comment", F.when(F.col("mode") == "v1", "progressive").otherwise("regressive").alias("orientation"), F.expr(_TIERS).alias("verdict"))
    return S.orientation_sampling(rows, "orientation", "verdict", "comment", "row_id", 100).select("row_id", "orientation", F.col("sample_rank").cast("long").alias("sample_rank"))


@R.query()
def smp_04_round_robin(spark, sf_dir):
    return S.assign_round_robin(table(spark, sf_dir, "documents").select("doc_id", "platform"), ["platform"], "doc_id", [f"coder_{c}" for c in "abcdef"]).groupBy("platform", "coder").agg(F.count("*").alias("n"))


@R.query()
def smp_05_overlap_design(spark, sf_dir):
    return S.overlap_design(table(spark, sf_dir, "documents"), "doc_id", [f"coder_{c}" for c in "abcdef"])


@R.query("""select row_id, mode, vote_count from (select *, row_number() over (partition by mode order by vote_count desc nulls last, row_id) r from filtered_v1_kept) order by case when r <= 30 then 0 else 1 end, vote_count desc nulls last, row_id limit 100""")
def smp_06_diverse(spark, sf_dir):
    return S.select_diverse(_kept(spark, sf_dir, "mode", "vote_count"), "mode", "vote_count", "row_id", 30, 100)


@R.query()
def smp_07_quotas(spark, sf_dir):
    return S.quota_sample(table(spark, sf_dir, "documents").select("doc_id", "platform"), "platform", "doc_id", {"YouTube": 40, "Instagram": 15})


# what seeded samples must come to, whatever the seed draws: sizes, distinct rows, and that they are rows of their table


@R.query("select source_file, least(count(*), 5) as n, least(count(*), 5) as known from filtered_v1_kept group by 1")
def smp_01_sizes(spark, sf_dir):
    kept = _kept(spark, sf_dir, "source_file")
    drawn = S.stratified_sample(kept, ["source_file"], "row_id", 5).join(kept.select("row_id", F.lit(1).alias("known")), "row_id", "left")
    return drawn.groupBy("source_file").agg(F.count_distinct("row_id").alias("n"), F.count("known").alias("known"))


@R.query("select least(count(*), 200) as n from documents")
def smp_02_sizes(spark, sf_dir):
    return S.global_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 200).agg(F.count_distinct("doc_id").alias("n"))


@R.query("select platform, count(*) as docs, floor(count(*) / 6) as least_load, ceil(count(*) / 6) as most_load from documents group by 1")
def smp_04_loads(spark, sf_dir):
    """Loads of six coders in a stratum differ by one at most: the smallest and largest are what they must be."""
    dealt = S.assign_round_robin(table(spark, sf_dir, "documents").select("doc_id", "platform"), ["platform"], "doc_id", list("abcdef"))
    loads = dealt.groupBy("platform").agg(F.count("*").alias("docs"), *(F.sum((F.col("coder") == c).cast("long")).alias(c) for c in "abcdef"))
    return loads.select("platform", "docs", F.least(*"abcdef").cast("double").alias("least_load"), F.greatest(*"abcdef").cast("double").alias("most_load"))


@R.query("select 20 as items, 60 as places, 5 as for_all, 15 as for_pairs, 10 as least_load, 10 as most_load")
def smp_05_design(spark, sf_dir):
    """Five items for all six coders, fifteen for pairs, ten each."""
    design = S.overlap_design(table(spark, sf_dir, "documents"), "doc_id", [f"coder_{c}" for c in "abcdef"])
    loads = design.groupBy("coder").agg(F.count("*").alias("n")).agg(F.min("n").alias("least_load"), F.max("n").alias("most_load"))
    kinds = design.agg(F.count_distinct("doc_id").alias("items"), F.count("*").alias("places"), F.count_distinct(F.when(F.col("group_id") == "all", F.col("doc_id"))).alias("for_all"), F.count_distinct(F.when(F.col("group_id") != "all", F.col("doc_id"))).alias("for_pairs"))
    return kinds.crossJoin(loads)  # one row each


@R.query("select platform, case platform when 'YouTube' then least(count(*), 40) else least(count(*), 15) end as n from documents where platform in ('YouTube', 'Instagram') group by 1")
def smp_07_sizes(spark, sf_dir):
    return smp_07_quotas(spark, sf_dir).groupBy("platform").agg(F.count_distinct("doc_id").alias("n"))


def queries():
    return R.queries


def oracle_sql():
    return R.sql
