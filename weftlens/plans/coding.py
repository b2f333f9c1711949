"""Queries of agreement statistics, quality checks, rule coders, codebook repair and the model boundary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from weftlens.functions import text as T
from weftlens.operators import codebook as C
from weftlens.operators import model as M
from weftlens.operators import quality as Q
from weftlens.operators import reliability as REL
from weftlens.operators import rules as RU
from weftlens.plans.common import CONTEXT_TERMS, FLAGS, HIGH_TERMS, KEPT, MODERATE_TERMS, NEGATIVE, POSITIVE, THEMES, TWEETS, Registry, sql_text
from weftlens.plans.scalars import _evidence_sql, _ranked, _sum_hits
from weftlens.runtime import table

R = Registry()

_B = "case when row_id % 4 = 0 then 'piece_relevant' when row_id % 7 = 0 then null else keep_reason end"
_RATINGS = f"r as (select row_id as item, item_type as question, keep_reason as a, {_B} as b from filtered_v1_kept)"
_MULTI = "m as (select flag_id as item, question_id as question, original_value as a, cleaned_value as b from human_kenya_final_validation_flags)"


def _ratings(spark, sf_dir):
    return table(spark, sf_dir, KEPT).select(F.col("row_id").alias("item"), F.col("item_type").alias("question"), F.col("keep_reason").alias("a"), F.expr(_B).alias("b"))


def _multi(spark, sf_dir):
    return table(spark, sf_dir, FLAGS).select(F.col("flag_id").alias("item"), F.col("question_id").alias("question"), F.col("original_value").alias("a"), F.col("cleaned_value").alias("b"))


_SEP = "[,;|\n]"
_PAIRED = "p as (select * from r where trim(coalesce(a, ''), ' ') <> '' and trim(coalesce(b, ''), ' ') <> '')"


def _alpha_sql(keys: str = "question", source: str = "p", correction: str = "pairable") -> str:
    same = "cp / (t * (t - 1))" if correction == "pairable" else "cc / (t * t)"
    return f"""o as (select {keys}, count(*) as pairs, avg((a <> b)::int) as observed from {source} group by all),
v as (select {keys}, value, count(*)::double as c from (select {keys}, a::varchar as value from {source} union all select {keys}, b::varchar from {source}) group by all),
s as (select {keys}, sum(c) as t, sum(c * c) as cc, sum(c * (c - 1)) as cp from v group by all),
al as (select {keys}, pairs, observed, case when abs(1 - {same}) > 1e-12 then 1 - observed / (1 - {same}) end as alpha from o join s using ({keys}))"""


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@R.query(f"with {_RATINGS}, {_PAIRED} select question, count(*) as pairs, round(avg((a = b)::int), 6) as agreement from p group by 1")
def rel_01_percent_agreement(spark, sf_dir):
    return _rounded(REL.percent_agreement(_ratings(spark, sf_dir), ["question"]), "agreement")


for _name, _correction in (("rel_02_alpha", "pairable"), ("rel_02_alpha_uncorrected", "none")):

    def _alpha(spark, sf_dir, correction=_correction):
        return _rounded(REL.krippendorff_alpha(_ratings(spark, sf_dir), ["question"], correction), "observed", "alpha")

    R.query(f"with {_RATINGS}, {_PAIRED}, {_alpha_sql(correction=_correction)} select question, pairs, round(observed, 6) as observed, round(alpha, 6) as alpha from al", name=_name)(_alpha)


def _set_sql(c: str, sep: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce({c}, ''), {sep}), lambda x: lower(trim(x, ' '))), lambda x: x <> ''))"


_SETS = f"j as (select item, question, {_set_sql('a', 'chr(91) || chr(44) || chr(59) || chr(124) || chr(10) || chr(93)')} as x, {_set_sql('b', sql_text(', '))} as y from m), u as (select *, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::double as jac from j where len(x) + len(y) > 0)"


@R.query(f"with {_MULTI}, {_SETS} select question, count(*) as items, round(avg((jac = 1)::int), 6) as exact, round(avg(jac), 6) as jaccard from u group by 1")
def rel_03_jaccard(spark, sf_dir):
    return _rounded(REL.jaccard_scores(_multi(spark, sf_dir), ["question"], _SEP, ", "), "exact", "jaccard")


_GATED = "g as (select doc_id as item, 'Q1' as question, case when doc_id % 3 = 0 then 'yes' else 'no' end as a, case when doc_id % 2 = 0 then 'Yes' else 'no' end as b from documents union all select doc_id, 'Q1A', platform, case when doc_id % 5 = 0 then 'X' else platform end from documents)"


@R.query(f"with {_GATED}, r as (select * from g where question = 'Q1A' and item in (select item from g where question = 'Q1' and lower(a) = 'yes' and lower(b) = 'yes')), {_PAIRED} select question, count(*) as pairs, round(avg((a = b)::int), 6) as agreement from p group by 1")
def rel_04_fair_agreement(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    parent = d.select(F.col("doc_id").alias("item"), F.lit("Q1").alias("question"), F.when(F.col("doc_id") % 3 == 0, "yes").otherwise("no").alias("a"), F.when(F.col("doc_id") % 2 == 0, "Yes").otherwise("no").alias("b"))
    child = d.select(F.col("doc_id").alias("item"), F.lit("Q1A").alias("question"), F.col("platform").alias("a"), F.when(F.col("doc_id") % 5 == 0, "X").otherwise(F.col("platform")).alias("b"))
    return _rounded(REL.percent_agreement(REL.fair_pairs(parent.unionByName(child), "item", "question", "Q1", "Q1A"), ["question"]), "agreement")


_QS = f"""{_RATINGS}, {_MULTI}, {_PAIRED}, {_alpha_sql()}, {_SETS},
qs as (select question, 'single' as kind, pairs as items, 1 - observed as agreement, alpha, null::double as jaccard, 1 - observed as lead from al
union all select question, 'multi', count(*), avg((jac = 1)::int), null, avg(jac), avg(jac) from u group by question)"""


@R.query(f"with {_QS} select question, kind, items, round(agreement, 6) as agreement, round(alpha, 6) as alpha, round(jaccard, 6) as jaccard, case when lead >= 0.8 then 'strong' when lead >= 0.67 then 'acceptable' when lead >= 0.5 then 'moderate' when lead is not null then 'weak' end as band from qs")
def rel_05_question_scores(spark, sf_dir):
    return _rounded(REL.question_scores(_ratings(spark, sf_dir), _multi(spark, sf_dir), "question", _SEP, ", "), "agreement", "alpha", "jaccard").drop("lead")


@R.query(f"with {_QS} select round(avg(agreement), 6) as exact, round(avg(alpha), 6) as alpha, round(avg(jaccard), 6) as jaccard, round(avg(lead), 6) as combined, count(*) as questions from qs")
def rel_05_overall(spark, sf_dir):
    scores = REL.question_scores(_ratings(spark, sf_dir), _multi(spark, sf_dir), "question", _SEP, ", ")
    return _rounded(REL.overall(scores), "exact", "alpha", "jaccard", "combined")


@R.query(f"with {_GATED} select item, max(a) filter (where question = 'Q1') as human_Q1, max(b) filter (where question = 'Q1') as model_Q1, max(a) filter (where question = 'Q1A') as human_Q1A, max(b) filter (where question = 'Q1A') as model_Q1A, (human_Q1 = model_Q1)::int as exact_Q1, (human_Q1A = model_Q1A)::int as exact_Q1A from g group by 1")
def rel_06_merged_ratings(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    parent = d.select(F.col("doc_id").alias("item"), F.lit("Q1").alias("question"), F.when(F.col("doc_id") % 3 == 0, "yes").otherwise("no").alias("a"), F.when(F.col("doc_id") % 2 == 0, "Yes").otherwise("no").alias("b"))
    child = d.select(F.col("doc_id").alias("item"), F.lit("Q1A").alias("question"), F.col("platform").alias("a"), F.when(F.col("doc_id") % 5 == 0, "X").otherwise(F.col("platform")).alias("b"))
    return REL.merged_ratings(parent.unionByName(child), "item", "question", ["Q1", "Q1A"])


_OPTIONS = f"{_MULTI}, {_SETS}, bin as (select u.item, u.question, option_text as opt, list_contains(x, lower(option_text))::int as a, list_contains(y, lower(option_text))::int as b from u join codebook_dim c on c.question_id = u.question)"


def _binary(spark, sf_dir):
    options = table(spark, sf_dir, "codebook_dim").select(F.col("question_id").alias("question"), F.col("option_text").alias("opt"))
    return REL.binary_options(_multi(spark, sf_dir), options, "question", "opt", _SEP, ", ")


@R.query(f"with {_OPTIONS}, {_alpha_sql('question, opt', 'bin')} select question, opt, sum(a) as present_a, sum(b) as present_b, any_value(pairs) as pairs, round(avg((a = b)::int), 6) as agreement, round(any_value(alpha), 6) as alpha from bin join al using (question, opt) group by 1, 2")
def rel_07_binary_options(spark, sf_dir):
    return _rounded(REL.option_reliability(_binary(spark, sf_dir), "question", "opt"), "agreement", "alpha")


_CONF = f"{_OPTIONS}, cf as (select question, opt, sum((a = 1 and b = 1)::int) as tp, sum((a = 0 and b = 1)::int) as fp, sum((a = 1 and b = 0)::int) as fn, sum((a = 0 and b = 0)::int) as tn from bin group by 1, 2)"
_RATES = "round((tp + tn) / nullif(tp + fp + fn + tn, 0)::double, 6) as accuracy, round(tp / nullif(tp + fp, 0)::double, 6) as prec, round(tp / nullif(tp + fn, 0)::double, 6) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 6) as f1"


@R.query(f"with {_CONF} select question, opt, tp, fp, fn, tn, {_RATES} from cf")
def rel_09_confusion(spark, sf_dir):
    return _rounded(REL.confusion(_binary(spark, sf_dir), ["question", "opt"]), "accuracy", "prec", "recall", "f1")


@R.query(f"with {_CONF}, mac as (select question, avg(tp / nullif(tp + fp, 0)::double) as p, avg(tp / nullif(tp + fn, 0)::double) as r, avg(2 * tp / nullif(2 * tp + fp + fn, 0)::double) as f from cf group by 1), mic as (select question, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(tn) as tn from cf group by 1) select question, tp, fp, fn, tn, {_RATES}, round(p, 6) as macro_prec, round(r, 6) as macro_recall, round(f, 6) as macro_f1 from mic join mac using (question)")
def rel_10_micro_macro(spark, sf_dir):
    out = REL.micro_macro(REL.confusion(_binary(spark, sf_dir), ["question", "opt"]), "question")
    return _rounded(out, "accuracy", "prec", "recall", "f1", "macro_prec", "macro_recall", "macro_f1")


@R.query(f"""with {_RATINGS}, {_PAIRED}, cl as (select question, c, sum((a = c and b = c)::int) as tp, sum((a <> c and b = c)::int) as fp, sum((a = c and b <> c)::int) as fn from p join (select distinct question q, unnest([a, b]) as c from p) on q = question where a = c or b = c group by 1, 2),
mac as (select question, avg(tp / nullif(tp + fp, 0)::double) as p, avg(tp / nullif(tp + fn, 0)::double) as r, avg(2 * tp / nullif(2 * tp + fp + fn, 0)::double) as f from cl group by 1)
select question, count(*) as pairs, round(avg((a = b)::int), 6) as agreement, round(any_value(mac.p), 6) as macro_prec, round(any_value(mac.r), 6) as macro_recall, round(any_value(mac.f), 6) as macro_f1 from p join mac using (question) group by 1""")
def rel_11_class_metrics(spark, sf_dir):
    return _rounded(REL.class_metrics(_ratings(spark, sf_dir), ["question"]), "agreement", "macro_prec", "macro_recall", "macro_f1")


@R.query(f"with {_RATINGS}, x as (select * from r where not (item % 10 = 3 and question = 'comment')), p as (select * from x where a is not null and b is not null) select question, count(*) as pairs, round(avg((a = b)::int), 6) as agreement from p group by 1")
def rel_12_without_flagged(spark, sf_dir):
    rows = _ratings(spark, sf_dir)
    flagged = rows.filter("item % 10 = 3 and question = 'comment'")
    return _rounded(REL.percent_agreement(REL.without_flagged(rows, flagged, "item", "question"), ["question"]), "agreement")


@R.query("with q as (select user_id % 5 as grp, user_id, case when user_id % 7 <> 0 then avg(value) / 100 end as alpha, avg(value) / 50 as dis from events group by 1, 2) select grp, round(avg(alpha), 6) as mean, round(quantile_cont(alpha, 0.5), 6) as median, round(min(alpha), 6) as lowest, round(max(alpha), 6) as highest, round(avg(dis), 6) as disagreement, count(alpha) as defined from q group by 1")
def rel_13_alpha_summary(spark, sf_dir):
    q = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("grp"), "user_id").agg((F.avg("value") / 100).alias("al"), (F.avg("value") / 50).alias("dis")).withColumn("alpha", F.when(F.col("user_id") % 7 != 0, F.col("al")))
    return _rounded(REL.alpha_summary(q, "grp", "alpha", "dis"), "mean", "median", "lowest", "highest", "disagreement")


_CAND = "c as (select question_id as question, coder as candidate, round(avg((original_value = cleaned_value)::int), 6) as score from human_kenya_final_validation_flags group by 1, 2)"


@R.query(f"with {_CAND} select question, arg_min(candidate, (-score, candidate)) as candidate, max(score) as score from c where score is not null and candidate <> 'coder_c' and score < 1 group by 1")
def rel_14_best_candidate(spark, sf_dir):
    scores = table(spark, sf_dir, FLAGS).groupBy(F.col("question_id").alias("question"), F.col("coder").alias("candidate")).agg(F.round(F.avg((F.col("original_value") == F.col("cleaned_value")).cast("int")), 6).alias("score"))
    return REL.best_candidate(scores, "question", "candidate", "score", ["coder_c"], exclude_perfect=True)


@R.query("select flag_type, question_id, count(*) as n, count(distinct content_id) as cells from human_kenya_final_validation_flags group by 1, 2")
def rel_15_flag_counts(spark, sf_dir):
    return table(spark, sf_dir, FLAGS).groupBy("flag_type", "question_id").agg(F.count("*").alias("n"), F.count_distinct("content_id").alias("cells"))


@R.query(f"with {_RATINGS}, {_PAIRED}, {_alpha_sql()}, one as (select question, 1 - observed as agreement, alpha from al) select question, round(agreement, 6) as agreement, round(alpha, 6) as alpha from one union all select 'mean', round(avg(agreement), 6), round(avg(alpha), 6) from one")
def rel_08_single_summary(spark, sf_dir):
    rows = _ratings(spark, sf_dir)
    one = REL.percent_agreement(rows, ["question"]).join(REL.krippendorff_alpha(rows, ["question"]).select("question", "alpha"), "question").select("question", "agreement", "alpha")
    return _rounded(one.unionByName(one.agg(F.lit("mean").alias("question"), F.avg("agreement").alias("agreement"), F.avg("alpha").alias("alpha"))), "agreement", "alpha")


# quality

_CHECKS = {"has_text": "trim(coalesce(text, ''), ' ') <> ''", "has_lang": "lang is not null", "length_ok": "length(text) between 1 and 5000", "has_url": "source_url is not null", "has_id": "content_id is not null"}


@R.query(" union all ".join(f"select {sql_text(n)} as name, count(*) filter (where not coalesce({c}, false)) = 0 as ok, count(*) filter (where not coalesce({c}, false)) as detail from documents" for n, c in _CHECKS.items()))
def qac_01_invariants(spark, sf_dir):
    checks = {"has_text": F.trim(F.coalesce("text", F.lit(""))) != "", "has_lang": F.col("lang").isNotNull(), "length_ok": F.length("text").between(1, 5000), "has_url": F.col("source_url").isNotNull(), "has_id": F.col("content_id").isNotNull()}
    return Q.invariants(table(spark, sf_dir, "documents"), checks)


@R.query("select 'no video' as \"check\", 'HIGH' as severity, row_id from filtered_v1_kept where video_id is null union all select 'no words', 'LOW', row_id from filtered_v1_kept where word_count = 0 union all select 'loaded early', 'MED', row_id from filtered_v1_kept where loaded_at < published_at")
def qac_02_violations(spark, sf_dir):
    rules = [("no video", "HIGH", F.col("video_id").isNull()), ("no words", "LOW", F.col("word_count") == 0), ("loaded early", "MED", F.col("loaded_at") < F.col("published_at"))]
    return Q.violations(table(spark, sf_dir, KEPT).select("row_id", "video_id", "word_count", "loaded_at", "published_at"), "row_id", rules)


@R.query("select creator, sum((n_chars > 1000)::int) as long, sum((lang is null)::int) as unlabelled, array_to_string(list_filter([case when sum((n_chars > 1000)::int) >= 2 then 'long' end, case when sum((lang is null)::int) >= 2 then 'unlabelled' end], lambda x: x is not null), '; ') as indicators from (select creator, coalesce(n_chars, 0) as n_chars, lang from documents) group by 1")
def qac_07_risk_indicators(spark, sf_dir):
    return Q.risk_indicators(table(spark, sf_dir, "documents"), "creator", {"long": F.col("n_chars") > 1000, "unlabelled": F.col("lang").isNull()})


@R.query("select row_id, (comment is null or trim(comment, ' ') = '')::int + (author is null or trim(author, ' ') = '')::int + (video_id is null or trim(video_id, ' ') = '')::int + (keep is null)::int as missing from filtered_v1_kept")
def rul_09_missing_fields(spark, sf_dir):
    return table(spark, sf_dir, KEPT).select("row_id", Q.missing_fields(["comment", "author", "video_id", "keep"]).alias("missing"))


# rule coders

_AUDIENCE = dict(
    themes=THEMES, default_theme="general", positive=POSITIVE, negative=NEGATIVE, emotions=[("grief", "cry|lost"), ("anger", "anger|vex")], personal=["my father|my uncle|my brother", "i grew|i lost|i have", "my age"], personal_themes=["family", "emotion"],
    support=["thank you", "true for me"], critique=["disagree", "let us stop"], hedges="but |maybe", laugh="😂", insults=["fool|idiot|stupid", "useless|moron", "coward|donkey"], severe=["rot alone", "thrown you away"],
    misogyny="women are trash", negative_portrayal="from the woman", reproduces="belong", mentions_women="wom[ae]n", foundations=[("care", "helped|carry"), ("fairness", "both people"), ("authority", "taught me|discipline")], default_foundation="none", clusters={"v1": "first run"},
)


def _audience_sql() -> str:
    h = lambda p: _sum_hits(p, "low")
    m = lambda p: f"regexp_matches(low, {sql_text(p)})"
    a = _AUDIENCE
    pos, neg, sup, cri = h(a["positive"]), h(a["negative"]), h(a["support"]), h(a["critique"])
    themes = f"list_transform(({_ranked.replace('lower(t)', 'low')})[1:4], lambda s: s.label)"
    emotion = "case " + " ".join(f"when {m(p)} then {sql_text(x)}" for x, p in a["emotions"]) + " when sentiment = 'positive' then 'warmth' when sentiment = 'negative' then 'frustration' else 'neutral' end"
    response = (
        f"case when words <= 5 or ({m(a['laugh'])} and words <= 12) then 'joking' when {h(a['personal'])} >= 2 and primary_theme in ('family', 'emotion') then 'personal' when {cri} > {sup} then 'critique' "
        f"when {sup} > 0 and {cri} = 0 then 'support' when ({sup} > 0 and {cri} > 0) or {m(a['hedges'])} then 'debate' when words < 8 then 'unclear' else 'debate' end"
    )
    toxicity = f"least(3, least(2, {h(a['insults'])}) + (coalesce(comment, '') = upper(coalesce(comment, '')) and regexp_matches(coalesce(comment, ''), '[A-Z]') and length(coalesce(comment, '')) > 60)::int + ({h(a['severe'])} > 0)::int)"
    misogyny = f"least(3, 2 * {m(a['misogyny'])}::int + {m(a['negative_portrayal'])}::int + ({m(a['reproduces'])} and {m(a['mentions_women'])})::int)"
    found = "list_filter([" + ", ".join(f"case when {m(p)} then {sql_text(x)} end" for x, p in a["foundations"]) + "], lambda x: x is not null)"
    return f"""with b as (select row_id, comment, mode, lower(coalesce(comment, '')) as low, len(list_filter(regexp_split_to_array(coalesce(comment, ''), '\\s+'), lambda w: w <> '')) as words from filtered_v1_kept),
    c as (select *, case when len({themes}) > 0 then {themes} else ['general'] end as themes, case when {pos} >= {neg} + 2 then 'positive' when {neg} >= {pos} + 2 then 'negative' when {pos} > 0 and {neg} > 0 then 'mixed' when {pos} > 0 then 'positive' when {neg} > 0 then 'negative' else 'neutral' end as sentiment from b),
    d as (select *, themes[1] as primary_theme from c), e as (select *, {emotion} as emotion, {response} as response, {toxicity} as toxicity, {misogyny} as misogyny, {found} as f from d)
    select row_id, array_to_string(themes, '; ') as themes, primary_theme, sentiment, emotion, response, toxicity, misogyny, toxicity = 3 and misogyny >= 2 as hate, case when mode = 'v1' then 'first run' else primary_theme end as cluster, case when len(f) > 0 then array_to_string(f, '; ') else 'none' end as foundations from e"""


@R.query(_audience_sql())
def rul_01_audience_coder(spark, sf_dir):
    out = RU.audience_coder(table(spark, sf_dir, KEPT).select("row_id", "comment", "mode"), "comment", RU.AudienceRules(**_AUDIENCE), "mode")
    return out.drop("comment", "mode").withColumns({"themes": F.array_join("themes", "; "), "foundations": F.array_join("foundations", "; ")})


_DIMS = {"topic": THEMES, "frame": {"critique": NEGATIVE, "praise": POSITIVE, "story": ["i grew|i lost", "when i"]}}


def _best_sql(labels, default: str) -> str:
    best = "list_max([" + ", ".join(f"{{'n': {_sum_hits(p, 'low')}, 'label': {sql_text(x)}}}" for x, p in labels.items()) + "])"
    return f"case when ({best}).n > 0 then ({best}).label else {sql_text(default)} end"


_STRONGEST = "greatest(" + ", ".join(_sum_hits(p, "low") for labels in _DIMS.values() for p in labels.values()) + ")"


@R.query(
    f"""select row_id, {_best_sql(_DIMS['topic'], 'none')} as topic, {_best_sql(_DIMS['frame'], 'plain')} as frame, case when {_STRONGEST} >= 3 or words > 45 then 'High' when {_STRONGEST} >= 1 or words > 12 then 'Medium' else 'Low' end as confidence, {_evidence_sql(['weakness', 'taught me'], 40, 160)} as evidence
    from (select row_id, coalesce(comment, '') as t, lower(coalesce(comment, '')) as low, len(list_filter(regexp_split_to_array(coalesce(comment, ''), '\\s+'), lambda w: w <> '')) as words from filtered_v1_kept)"""
)
def rul_02_dimension_coder(spark, sf_dir):
    rows = table(spark, sf_dir, KEPT).select("row_id", "comment")
    return RU.dimension_coder(rows, "comment", _DIMS, {"topic": "none", "frame": "plain"}, ["weakness", "taught me"]).drop("comment")


@R.query(
    f"""select row_id, case when mode = 'v1' and regexp_matches(low, 'weakness') then 'support' when {_sum_hits(POSITIVE, 'low')} > {_sum_hits(NEGATIVE, 'low')} then 'support' when {_sum_hits(NEGATIVE, 'low')} > {_sum_hits(POSITIVE, 'low')} then 'oppose' when words <= 5 or regexp_matches(low, '😂') then 'neutral' else 'unclear' end as stance
    from (select row_id, mode, lower(coalesce(comment, '')) as low, len(list_filter(regexp_split_to_array(coalesce(comment, ''), '\\s+'), lambda w: w <> '')) as words from filtered_v1_kept)"""
)
def rul_03_stance(spark, sf_dir):
    low = F.lower(F.coalesce("comment", F.lit("")))
    out = RU.stance(low, {"v1": [("support", "weakness")]}, F.col("mode"), POSITIVE, NEGATIVE, "😂", T.words_by_space(low), "unclear")
    return table(spark, sf_dir, KEPT).select("row_id", out.alias("stance"))


_G, _H, _N = list(CONTEXT_TERMS), list(HIGH_TERMS), ["should|must|needs", "never|always"]
_BONUS = {"family": 2, "money": 1}
_PAIRS = ["men .*weakness", "boys .*(weakness|cry)"]


def _relevance_sql() -> str:
    topics = " + ".join(f"({_sum_hits(p, 'low')} > 0)::int" for p in THEMES.values())
    primary = _best_sql(THEMES, "none")
    points = f"least({_sum_hits(_G, 'low')}, 3) + least(2 * {_sum_hits(_H, 'low')}, 4) + least({_sum_hits(_N, 'low')}, 2) + least({topics}, 3) + case {primary} when 'family' then 2 when 'money' then 1 else 0 end - is_reply::int + 3 * regexp_matches(low, {sql_text(_PAIRS[0])})::int + 3 * regexp_matches(low, {sql_text(_PAIRS[1])})::int"
    return f"""with b as (select row_id, lower(coalesce(text, '')) as low, starts_with(coalesce(text, ''), '@') as is_reply, starts_with(coalesce(text, ''), 'RT @') as is_repost, coalesce(likes, 0) + coalesce(replies, 0) + coalesce(retweets, 0) + coalesce(quotes, 0) as engagement from tweet_there_is_no_amount_of),
    c as (select *, case when trim(low, ' ') = '' then 'empty' when is_repost then 'repost' when len(regexp_extract_all(low, '[A-Za-z0-9_]+')) < 5 then 'too short' end as early, {points} as p, {primary} as primary_topic from b),
    d as (select *, case when early is null then p else 0 end as points, coalesce(early, primary_topic) as reason, case when early is not null then 1 when p >= 8 then 5 when p >= 5 then 4 when p >= 3 then 3 when p >= 1 then 2 else 1 end as relevance from c)"""


@R.query(_relevance_sql() + " select row_id, points, relevance, reason, not is_repost and relevance >= (case when is_reply then 4 else 3 end) as keep from d")
def rul_04_relevance(spark, sf_dir):
    return _relevance(spark, sf_dir).select("row_id", "points", "relevance", "reason", "keep")


def _relevance(spark, sf_dir):
    rows = table(spark, sf_dir, TWEETS).select("row_id", "text", RU.engagement("likes", "replies", "retweets", "quotes").alias("engagement"))
    t = F.coalesce("text", F.lit(""))
    return RU.relevance_score(rows, "text", _G, _H, _N, THEMES, _BONUS, t.startswith("@"), t.startswith("RT @"), _PAIRS)


@R.query(_relevance_sql() + " select row_id, relevance, engagement from d where not is_repost and relevance >= (case when is_reply then 4 else 3 end) order by relevance desc, engagement desc, row_id limit 100")
def rul_05_top_posts(spark, sf_dir):
    return _relevance(spark, sf_dir).filter("keep").orderBy(F.desc("relevance"), F.desc("engagement"), "row_id").limit(100).select("row_id", "relevance", "engagement")


# ladders of further outputs; labels and patterns are invented for the test tables

_S = RU.Step
_MORE_AUDIENCE = {
    "masculinity": ([_S("healing", where="primary_theme = 'emotion'"), _S("equal", "both people|share"), _S("traditional", "should|must", "primary_theme in ('family', 'money')")], "mixed"),
    "portrayal": ([_S("negative", "women are trash|from the woman"), _S("equal", "both people|respect", "women"), _S("neutral", where="women")], "absent"),
    "expectation": ([_S("provider", where="primary_theme = 'money'"), _S("open", where="primary_theme = 'emotion'"), _S("disciplined", "discipline|patience"), _S("dominant", "control|rule")], "unstated"),
    "stereotype": ([_S("reproduces", where="portrayal = 'negative'"), _S("contests", "both people|is not weakness"), _S("mixed", "men |boys")], "unclear"),
    "prescriptive": ([_S("yes", "should|must|never|always|let us"), _S("partly", "maybe|can |possible")], "no"),
    "style": ([_S("story", "i lost|i grew|my uncle|my father"), _S("advice", "should|must|let us"), _S("humour", "😂|lol"), _S("reproach", "blam|disagree")], "opinion"),
    "tone": ([_S("aggressive", "fool|idiot|stupid|useless"), _S("pained", where="primary_theme = 'emotion'"), _S("hopeful", "thank|helped"), _S("light", "😂"), _S("calm", where="prescriptive = 'no'")], "serious"),
}
_SNIPPET = {
    "narrative": ([_S("healing", "sorry|forgiveness|cry"), _S("provision", "money|rent|fees|job"), _S("fatherhood", "father|boys|son"), _S("marriage", "marriage|wife|husband"), _S("faith", "prayer|god")], "general"),
    "claim": ([_S("men should speak", "nobody tells|talk|spoke", "narrative = 'healing'"), _S("men carry the cost", where="narrative = 'provision'"), _S("boys need guidance", where="narrative = 'fatherhood'"), _S("marriage is shared", "both people|two people")], "no claim"),
    "solution": ([_S("talk", "talk|spoke|conversation"), _S("pray", "prayer|god"), _S("work", "work|job"), _S("respect", "respect|patience")], "none"),
    "target": ([_S("boys", "boys|son "), _S("couples", "marriage|husband|wife"), _S("men", "men |father|uncle")], "everyone"),
}
_REACTION = {
    "relation": ([_S("confirms", "true for me|thank"), _S("contradicts", "disagree|not true"), _S("extends", "i lost|i grew|my uncle|my father|in our village")], "unrelated"),
    "impact": ([_S("changed", "made me think|in a new way|finally"), _S("moved", "cry|carry"), _S("helped", "helped", "relation = 'confirms'"), _S("resisted", where="relation = 'contradicts'")], "none"),
}
_POST = {
    "orientation": ([_S("reflective", "weakness|think|talk"), _S("traditional", "must|should|never"), _S("devout", "prayer|god")], "unclear"),
    "norm_type": ([_S("provider", "money|rent|fees"), _S("stoic", "hide|silence|cry"), _S("father", "father|boys|son")], "none"),
    "target": ([_S("boys", "boys"), _S("women", "wom[ae]n|wife"), _S("men", "men |husband|uncle")], "everyone"),
}


def _ladder_sql(source: str, text: str, ladders, keep: Sequence[str] = ()) -> str:
    """The same ladders as nested selects over ``source``, which has the key, ``text`` and the ``keep`` columns."""
    sql = f"select *, lower(coalesce({text}, '')) as low from ({source})"
    for name, (steps, default) in ladders.items():
        cases = []
        for s in steps:
            tests = [f"regexp_matches(low, {sql_text(s.pattern)})"] if s.pattern is not None else []
            tests += [f"({s.where})"] if s.where is not None else []
            cases.append(f"when {' and '.join(tests) or 'true'} then {sql_text(s.label)}")
        sql = f"select *, case {' '.join(cases)} else {sql_text(default)} end as {name} from ({sql})"
    return f"select {', '.join([*keep, *ladders])} from ({sql})"


_THEMED = f"select row_id, comment, {_best_sql(THEMES, 'general')} as primary_theme, regexp_matches(low, 'wom[ae]n|wife') as women from (select *, lower(coalesce(comment, '')) as low from filtered_v1_kept)"


@R.query(_ladder_sql(_THEMED, "comment", _MORE_AUDIENCE, ["row_id", "primary_theme"]))
def rul_01_audience_ladders(spark, sf_dir):
    """The outputs of the audience coder that are ladders: kind of masculinity, portrayal, expectation, stereotype, and so on."""
    from weftlens.functions.lexicon import best_label

    low = F.lower(F.coalesce("comment", F.lit("")))
    rows = table(spark, sf_dir, KEPT).select("row_id", "comment", best_label(low, THEMES, "general").alias("primary_theme"), low.rlike("wom[ae]n|wife").alias("women"))
    return RU.ladder_coder(rows, "comment", _MORE_AUDIENCE).drop("comment", "women")


@R.query(_ladder_sql("select doc_id, text from documents", "text", _SNIPPET, ["doc_id"]))
def rul_02_snippet_ladders(spark, sf_dir):
    """The second pass of the snippet coder: narrative, claim, solution, target."""
    return RU.ladder_coder(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _SNIPPET).drop("text")


@R.query(_ladder_sql("select row_id, comment from filtered_v1_kept", "comment", _REACTION, ["row_id"]))
def rul_03_relation_and_impact(spark, sf_dir):
    """How a comment stands to the message, and what it did to its writer."""
    return RU.ladder_coder(table(spark, sf_dir, KEPT).select("row_id", "comment"), "comment", _REACTION).drop("comment")


@R.query(_ladder_sql(_relevance_sql() + " select d.row_id, t.text, points, relevance, reason, engagement, not is_repost and relevance >= (case when is_reply then 4 else 3 end) as keep from d join tweet_there_is_no_amount_of t using (row_id)", "text", _POST, ["row_id", "relevance", "reason", "engagement", "keep"]))
def rul_05_post_table(spark, sf_dir):
    """Every post with its relevance, engagement, orientation, kind of norm and target."""
    coded = RU.ladder_coder(_relevance(spark, sf_dir), "text", _POST)
    return coded.select("row_id", "relevance", "reason", "engagement", "keep", *_POST)


@R.query(f"select row_id, case when p >= n + 2 then 'positive' when n >= p + 2 then 'negative' when p > 0 and n > 0 then 'mixed' when p > 0 then 'positive' when n > 0 then 'negative' else 'neutral' end as sentiment from (select row_id, {_sum_hits(POSITIVE, 'lower(comment)')} as p, {_sum_hits(NEGATIVE, 'lower(comment)')} as n from filtered_v1_kept)")
def rul_06_sentiment(spark, sf_dir):
    from weftlens.functions.lexicon import hits

    low = F.lower("comment")
    return table(spark, sf_dir, KEPT).select("row_id", RU.net_sentiment(hits(low, POSITIVE), hits(low, NEGATIVE)).alias("sentiment"))


# codebooks


@R.query("select flag_id, array_to_string(list_transform(list_sort(list_filter([" + ", ".join(f"{{'p': instr(lower(original_value), {sql_text(o.lower())}), 'o': {sql_text(o)}}}" for o in ("Absent father", "Financial hardship", "Grief and loss", "Violence at home")) + "], lambda s: s.p > 0)), lambda s: s.o), '; ') as options from human_kenya_final_validation_flags where original_value is not null")
def cbk_05_options_in_order(spark, sf_dir):
    options = ["Absent father", "Financial hardship", "Grief and loss", "Violence at home"]
    return table(spark, sf_dir, FLAGS).filter("original_value is not null").select("flag_id", F.array_join(C.options_in_order(F.col("original_value"), options), "; ").alias("options"))


@R.query("select flag_id, coalesce(case lower(trim(original_value, ' ')) when 'absent father' then 'Absent father' when 'gym' then 'Gym' end, 'Other') as one, (select array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(original_value, ';'), lambda x: case lower(trim(x, ' ')) when 'absent father' then 'Absent father' when 'gym' then 'Gym' end), lambda x: x is not null))), '; ')) as many from human_kenya_final_validation_flags where original_value is not null")
def cbk_06_coerce_vocabulary(spark, sf_dir):
    vocabulary = ["Absent father", "Gym"]
    v = F.col("original_value")
    return table(spark, sf_dir, FLAGS).filter("original_value is not null").select("flag_id", C.coerce_one(v, vocabulary, "Other").alias("one"), F.array_join(F.array_sort(C.coerce_many(v, vocabulary)), "; ").alias("many"))


_ANSWERS = "a as (select doc_id, case doc_id % 3 when 0 then 'No' when 1 then 'Yes' else 'Maybe' end as q4, case doc_id % 4 when 0 then 'positive' when 1 then 'negative' else 'none' end as q5, case doc_id % 5 when 0 then 'Supporting' when 1 then 'Challenging' else 'Neutral' end as q8, case doc_id % 2 when 0 then 'because' else '' end as q9, case when doc_id % 7 = 0 then '' else 'null label' end as q10 from documents)"


def _answers(spark, sf_dir):
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (F.col("doc_id") % n + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", pick(3, "No", "Yes", "Maybe").alias("q4"), pick(4, "positive", "negative", "none", "none").alias("q5"), pick(5, "Supporting", "Challenging", "Neutral", "Neutral", "Neutral").alias("q8"), pick(2, "because", "").alias("q9"), F.when(F.col("doc_id") % 7 == 0, "").otherwise("null label").alias("q10")
    )


def _gates():
    return [
        C.Gate("q4", "q4 = 'No' and q5 in ('positive', 'negative')", "Yes", "q4"),
        C.Gate("q5", "q4 = 'No'", "not applicable"),
        C.Gate("q9", "q8 <> 'Supporting'", "", "q9"),
        C.Gate("q10", "q8 <> 'Supporting'", "null label", "q10"),
    ]


_REPAIRED = f"""with {_ANSWERS}, b as (select *, (q4 = 'No' and q5 in ('positive', 'negative'))::int as fix_q4, case when q4 = 'No' and q5 in ('positive', 'negative') then 'Yes' else q4 end as r4 from a),
c as (select *, case when r4 = 'No' then 'not applicable' else q5 end as r5, (q8 <> 'Supporting' and q9 <> '')::int as fix_q9, case when q8 <> 'Supporting' then '' else q9 end as r9, (q8 <> 'Supporting' and q10 <> 'null label')::int as fix_q10, case when q8 <> 'Supporting' then 'null label' else q10 end as r10 from b)"""


@R.query(_REPAIRED + " select doc_id, r4 as q4, r5 as q5, q8, r9 as q9, r10 as q10, fix_q4, fix_q9, fix_q10 from c")
def cbk_07_conditional_repair(spark, sf_dir):
    return C.repair(_answers(spark, sf_dir), _gates())


@R.query(_REPAIRED + " select 'fix_q4' as rule, coalesce(sum(fix_q4), 0) as \"rows\" from c union all select 'fix_q9', coalesce(sum(fix_q9), 0) from c union all select 'fix_q10', coalesce(sum(fix_q10), 0) from c")
def cbk_08_repair_counts(spark, sf_dir):
    return C.repair_counts(C.repair(_answers(spark, sf_dir), _gates()))


@R.query("select flag_id, case when regexp_matches(lower(coalesce(note, '')), 'parent') then 'parent' when regexp_matches(lower(coalesce(note, '')), 'shorthand') and flag_type like 'known%' then 'mapped' else flag_type end as patched from human_kenya_final_validation_flags")
def cbk_09_patches(spark, sf_dir):
    note = F.lower(F.coalesce("note", F.lit("")))
    patched = F.when(note.rlike("parent"), "parent").when(note.rlike("shorthand") & F.col("flag_type").like("known%"), "mapped").otherwise(F.col("flag_type"))
    return table(spark, sf_dir, FLAGS).select("flag_id", patched.alias("patched"))


@R.query("""with v as (select content_id, question_id, cleaned_value, count(*) n, min(flag_id) f from human_kenya_final_validation_flags where trim(coalesce(cleaned_value, ''), ' ') <> '' group by all), c as (select content_id, count(distinct coder) as coders, array_to_string(list_sort(list_distinct(list(coder))), ', ') as coder_list from human_kenya_final_validation_flags group by 1)
select content_id, question_id, arg_min(cleaned_value, (-n, f, cleaned_value)) as cleaned_value, max(n) as votes, any_value(coders) as coders, any_value(coder_list) as coder_list from v join c using (content_id) group by 1, 2""")
def cbk_10_compile_master(spark, sf_dir):
    return C.compile_master(table(spark, sf_dir, FLAGS), "content_id", "question_id", "cleaned_value", "coder", "flag_id")


@R.query("select row_id, regexp_extract(source_file, '([A-Za-z]+)[_ -][^/]*$', 1) as coder from filtered_v1_kept")
def cbk_11_coder_of_file(spark, sf_dir):
    return table(spark, sf_dir, KEPT).select("row_id", C.coder_of_file(F.col("source_file")).alias("coder"))


@R.query()
def cbk_03_canonical_multi(spark, sf_dir):
    options: dict[str, list[str]] = {}
    for q, o in table(spark, sf_dir, "codebook_dim").select("question_id", "option_text").orderBy("option_id").collect():  # the fixed list of entries
        options.setdefault(q, []).append(o)
    flags = table(spark, sf_dir, FLAGS).select("flag_id", "question_id", "original_value")
    return C.canonical_multi(flags, "question_id", "original_value", options, {"Q2": {"gym": "Sport and the body"}})


_SINGLE = ("Calm and reflective", "Angry or confrontational", "Humorous", "Sad or mournful", "Preaching or instructing", "Conversational")


@R.query("select flag_id, coalesce(" + ", ".join(f"case {k} " + " ".join(f"when {sql_text(a)} then {sql_text(b)}" for a, b in pairs) + " end" for k, pairs in (
    ("lower(trim(original_value, ' '))", [("funny", "Humorous")]), ("lower(trim(original_value, ' '))", [(o.lower(), o) for o in _SINGLE]), (r"regexp_replace(lower(original_value), '[\s/]+', '', 'g')", [(o.lower().replace(" ", ""), o) for o in _SINGLE]),
    ("trim(split_part(lower(original_value), '.', 1), ' ')", [("funny", "Humorous")]), ("trim(split_part(lower(original_value), '.', 1), ' ')", [(o.lower(), o) for o in _SINGLE]),
)) + ", trim(original_value, ' ')) as answer from human_kenya_final_validation_flags where question_id = 'Q10A' and original_value is not null")
def cbk_02_canonical_single(spark, sf_dir):
    rows = table(spark, sf_dir, FLAGS).filter("question_id = 'Q10A' and original_value is not null")
    return rows.select("flag_id", C.canonical_single(F.col("original_value"), {"funny": "Humorous"}, list(_SINGLE)).alias("answer"))


# the model boundary


@R.query("select event_id, nullif(regexp_extract('Sure! ```json' || chr(10) || props || chr(10) || '``` done', '(?s)(\\{.*\\})', 1), '') as reply from events")
def mdl_06_extract_json(spark, sf_dir):
    noisy = F.concat(F.lit("Sure! ```json\n"), "props", F.lit("\n``` done"))
    return table(spark, sf_dir, "events").select("event_id", M.extract_json(noisy).alias("reply"))


@R.query("select event_id, greatest(0, least(3, coalesce((props->>'$.k')::int, 0))) as k, 'unknown' as label, 0::bigint as n_tags from events")
def mdl_07_normal_reply(spark, sf_dir):
    out = M.normal_reply(F.col("props"), ["tags"], {"k": (0, 3)}, {"label": "unknown"})
    return table(spark, sf_dir, "events").select("event_id", out["k"].alias("k"), out["label"].alias("label"), F.size(out["tags"]).cast("long").alias("n_tags"))


@R.query("select doc_id from documents where doc_id % 2 = 0 and doc_id % 3 <> 0 and not (doc_id % 10 = 4)")
def mdl_09_accept_critique(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    verdict = lambda c: docs.select("doc_id", c.alias("verdict"))
    audit = docs.select("doc_id", F.when(F.col("doc_id") % 10 == 4, "Regressive").otherwise("other").alias("label"), F.lit("High").alias("confidence"))
    return M.accept_and_critique(docs, verdict(F.col("doc_id") % 2 == 0), verdict(F.col("doc_id") % 3 != 0), audit, "doc_id")


@R.query("with v as (select doc_id, p, (doc_id + p) % 3 <> 0 as verdict from documents, (select unnest(range(1, 6)) as p)) select doc_id, sum(verdict::int) as votes, sum(verdict::int) >= 4 as keep from v group by 1")
def mdl_10_consensus(spark, sf_dir):
    votes = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("p")).select("doc_id", ((F.col("doc_id") + F.col("p")) % 3 != 0).alias("verdict"))
    return M.consensus(votes, "doc_id", 5, 4)


@R.query("""with a as (select vec_id as anchor, embedding as v from embeddings where vec_id < 12), s as (select e.vec_id, a.anchor, list_dot_product(e.embedding::double[], a.v::double[]) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(a.v::double[], a.v::double[]))) as c from embeddings e, a)
select vec_id, arg_min(anchor, (-round(c, 9), anchor)) as anchor, round(max(c), 5) as similarity from s group by 1""")
def mdl_12_cosine_anchor(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return M.cosine_to_anchors(e, "embedding", e.filter("vec_id < 12"), "vec_id", "embedding").select("vec_id", "anchor", F.round("similarity", 5).alias("similarity"))


@R.query(f"select row_id, round(0.20 * least({_sum_hits(MODERATE_TERMS, 'lower(comment)')}, 3) / 3.0 + 0.35 * coalesce(vote_count, 0) / 100.0 + 0.45 * coalesce(keep::int, 0), 6) as score from filtered_v1_kept")
def mdl_13_composite(spark, sf_dir):
    from weftlens.functions.lexicon import hits

    score = M.composite([(F.least(hits(F.lower("comment"), list(MODERATE_TERMS)), F.lit(3)) / 3.0, 0.20), (F.col("vote_count") / 100.0, 0.35), (F.col("keep").cast("int"), 0.45)])
    return table(spark, sf_dir, KEPT).select("row_id", F.round(score, 6).alias("score"))


@R.query()
def mdl_01_batched_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return M.run_model(docs, "doc_id", "text", "stub", M.stub_backend)[0].drop("text")


@R.query()
def mdl_14_topic_clusters(spark, sf_dir):
    return M.topic_clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").groupBy("cluster").agg(F.count("*").alias("n"))


@R.query("select doc_id, case when lang = 'en' then text else coalesce('english of ' || (case when doc_id % 2 = 0 then doc_id end), text) end as translation from documents")
def mdl_16_translated(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.coalesce("text", F.lit(""))).alias("key_text"), "text", "lang")
    cache = docs.filter("doc_id % 2 = 0").select(T.content_key(F.col("key_text"), "en").alias("cache_key"), F.concat(F.lit("english of "), F.col("doc_id").cast("string")).alias("reply"))
    out = M.translated(docs, "key_text", F.coalesce(F.col("lang") == "en", F.lit(False)), cache)
    return out.select("doc_id", F.when(F.col("translation") == F.col("key_text"), F.col("text")).otherwise(F.col("translation")).alias("translation"))


@R.query("select doc_id from documents where doc_id % 4 <> 0 or doc_id % 8 = 0")
def mdl_04_retry_pending(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    verdicts = docs.filter("doc_id % 4 = 0").withColumn("status", F.when(F.col("doc_id") % 8 == 0, "ERROR").otherwise("KEEP"))
    return M.retry_pending(docs, verdicts, "doc_id")


def queries():
    return R.queries


def oracle_sql():
    return R.sql
