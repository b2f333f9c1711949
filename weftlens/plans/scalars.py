"""Queries of scalar operators: text forms, counts, keys, clocks, lexicon matches, JSON and link extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftlens.functions import lexicon as L
from weftlens.functions import text as T
from weftlens.plans.common import FLAGS, KEPT, MODERATE_TERMS, NEGATIVE, PLAIN_TERMS, POSITIVE, THEMES, TWEETS, Registry, sql_text
from weftlens.runtime import table

R = Registry()


def _sq(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'), ' ')"


_QUOTES = "translate({}, '‘’‚“”„', " + sql_text("'''\"\"\"") + ")"


def _quotes(c: str) -> str:
    return _QUOTES.format(c)


_URL, _MENTION = sql_text(T.URL), sql_text(T.MENTION)


def _entities(c: str, rounds: int) -> str:
    for _ in range(rounds):
        for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            c = f"replace({c}, {sql_text(name)}, {sql_text(sign)})"
    return c


def _sum_hits(patterns, c: str = "lower(t)") -> str:
    return "(" + " + ".join(f"case when regexp_matches({c}, {sql_text(p)}) then 1 else 0 end" for p in patterns) + ")"


_KEPT = {"source": KEPT, "key": "row_id", "text": "comment"}
_TWEET = {"source": TWEETS, "key": "row_id", "text": "text"}
_DOC = {"source": "documents", "key": "doc_id", "text": "text"}
_FLAG = {"source": FLAGS, "key": "flag_id", "text": "original_value"}

R.scalar("txt_01_clean_comment", columns={"cleaned": (lambda t, low: T.clean_comment(t), _sq(_quotes("t")))}, **_KEPT)
R.scalar("txt_02_filter_form", columns={"form": (lambda t, low: T.filter_form(t), _sq("lower(" + _quotes("t") + ")"))}, **_KEPT)
R.scalar("txt_03_match_form", columns={"form": (lambda t, low: T.match_form(t), _sq(r"regexp_replace(lower(" + _quotes("t") + r"), '[^\p{L}\p{N}\p{M}#'' ]+', ' ', 'g')"))}, **_KEPT)
R.scalar("txt_04_compact_form", columns={"tagged": (lambda t, low: T.hashtag_form(t), _sq("lower(t)")), "compact": (lambda t, low: T.compact_form(t), r"regexp_replace(lower(t), '[^\p{L}\p{N}]', '', 'g')")}, **_TWEET)
R.scalar("txt_05_duplicate_key", columns={"dup_key": (lambda t, low: T.duplicate_key(t), rf"regexp_replace(regexp_replace(regexp_replace(lower(t), {_URL}, ' ', 'g'), {_MENTION}, ' ', 'g'), '[^\p{{L}}\p{{N}}]+', '', 'g')")}, **_TWEET)
R.scalar(
    "txt_06_strip",
    columns={
        "plain": (lambda t, low: T.strip_links_mentions(t), _sq(f"regexp_replace(regexp_replace(t, {_URL}, ' ', 'g'), {_MENTION}, ' ', 'g')")),
        "undecorated": (lambda t, low: T.strip_decorations(t), _sq(f"regexp_replace(t, {sql_text(T.EMOJI)}, '', 'g')")),
    },
    **_TWEET,
)

def _coded(t):
    return F.replace(F.replace(t, F.lit("'"), F.lit("&amp;#39;")), F.lit(","), F.lit(" &amp;lt;"))


_coded_sql = "replace(replace(t, '''', '&amp;#39;'), ',', ' &amp;lt;')"
R.scalar("txt_07_deep_decode", columns={"decoded": (lambda t, low: T.deep_decode(_coded(t)), _entities(_coded_sql, 4)), "once": (lambda t, low: T.decode_entities(_coded(t)), _entities(_coded_sql, 1))}, **_KEPT)
R.scalar("txt_08_join_key", columns={"join_key": (lambda t, low: T.join_key(t), _sq("lower(replace(" + _quotes(_entities("t", 4)) + ", '…', '...'))"))}, **_KEPT)
R.scalar(
    "txt_09_keep_lines",
    columns={"kept_lines": (lambda t, low: T.keep_lines(t), r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', e'\n', 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', e'\n', 'g'), '\n{3,}', e'\n\n', 'g'), '^[ \n]+|[ \n]+\z', '', 'g')")},
    **_DOC,
)
_cell = _sq("replace(" + _quotes("t") + ", chr(160), ' ')")
R.scalar("txt_10_cell_text", columns={"cell": (lambda t, low: T.cell_text(t), rf"case when ends_with({_cell}, '.') and not ends_with({_cell}, '..') then trim(regexp_replace({_cell}, '\.\z', '')) else {_cell} end")}, **_FLAG)

def _spaced(t):
    return F.regexp_replace(t, r"([,.!?'])", " $1")


R.scalar(
    "txt_11_tidy_joined",
    columns={"tidy": (lambda t, low: T.tidy_joined(_spaced(t)), _sq(r"regexp_replace(regexp_replace(regexp_replace(t, '([,.!?''])', ' \1', 'g'), '\s+([,.!?;:])', '\1', 'g'), '\s+''(s|t|re|ve|ll|d|m) ', '''\1 ', 'g')"))},
    **_KEPT,
)
R.scalar("txt_12_option_key", columns={"option_key": (lambda t, low: T.option_key(t), r"trim(regexp_replace(replace(replace(lower(t), '&', ' and '), 'e.g.', 'eg'), '[^a-z0-9]+', ' ', 'g'))")}, **_FLAG)
R.scalar("txt_13_slug", source="video_source", key="video_id", text="title", columns={"slug": (lambda t, low: T.slug(t, 24), r"substring(regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 24)")})
R.scalar(
    "txt_14_word_counts",
    columns={
        "by_space": (lambda t, low: T.words_by_space(t).cast("long"), r"len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> ''))"),
        "by_boundary": (lambda t, low: T.words_by_boundary(t).cast("long"), r"len(regexp_extract_all(t, '[A-Za-z0-9_]+'))"),
        "alphabetic": (lambda t, low: T.alpha_words(t).cast("long"), r"len(regexp_extract_all(t, '[A-Za-z'']+'))"),
        "chars": (lambda t, low: F.length(t).cast("long"), "length(t)"),
    },
    where="t is not null",
    **_KEPT,
)
R.scalar("txt_15_longest_word", columns={"longest": (lambda t, low: T.longest_word(t).cast("long"), r"coalesce(list_max(list_transform(regexp_extract_all(t, '([A-Za-z]+)', 1), lambda w: length(w))), 0)")}, where="t is not null", **_KEPT)
R.scalar("txt_16_ascii_ratio", columns={"ratio": (lambda t, low: F.round(T.ascii_ratio(t), 4), r"round(length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) / nullif(length(t), 0)::double, 4)")}, **_KEPT)


def _clip_sql(c: str, n: int) -> str:
    return rf"case when length({c}) <= {n} then {c} else regexp_replace(substring({c}, 1, {n}), '\s+\S*\z', '') || '...' end"


R.scalar("txt_17_first_sentence", columns={"clipped": (lambda t, low: T.clip(t, 40), _clip_sql("t", 40)), "sentence": (lambda t, low: T.first_sentence(t, 60), _clip_sql("trim(regexp_extract(t, '^([^.!?]*[.!?]?)', 1))", 60))}, **_KEPT)


def _evidence_sql(patterns, around: int, most: int) -> str:
    out = "''"
    for p in reversed(patterns):
        at = f"(instr(t, regexp_extract(t, {sql_text(p)})))"
        begin = f"greatest({at} - {around}, 1)"
        size = f"(least({at} + {around}, length(t) + 1) - {begin})"
        piece = f"substring((case when {begin} > 1 then '...' else '' end) || substring(t, {begin}, {size}) || (case when {begin} + {size} <= length(t) then '...' else '' end), 1, {most})"
        out = f"case when regexp_matches(t, {sql_text(p)}) then {piece} else {out} end"
    return f"case when t is not null then {out} end"


_EVIDENCE = ["weakness", "taught me", "never said"]
R.scalar("txt_18_evidence_window", columns={"evidence": (lambda t, low: T.evidence_window(t, _EVIDENCE, 30, 70), _evidence_sql(_EVIDENCE, 30, 70))}, **_KEPT)
R.scalar(
    "txt_19_urls",
    columns={
        "n_urls": (lambda t, low: F.size(T.urls(t)).cast("long"), r"len(regexp_extract_all(t, '(https?://[^\s()]+)', 1))"),
        "last_url": (lambda t, low: F.try_element_at(T.urls(t), F.lit(-1)), r"regexp_extract_all(t, '(https?://[^\s()]+)', 1)[-1]"),
        "first_of_two": (lambda t, low: T.split_two_urls(t)["first"], r"regexp_extract_all(t, '(https?://[^\s()]+)', 1)[1]"),
    },
    **_TWEET,
)
R.scalar(
    "txt_21_tags_mentions",
    columns={
        "n_tags": (lambda t, low: F.size(F.regexp_extract_all(t, F.lit(f"({T.HASHTAG})"), 1)).cast("long"), f"len(regexp_extract_all(t, {sql_text('(' + T.HASHTAG + ')')}, 1))"),
        "tags": (lambda t, low: F.array_join(F.array_sort(F.split(T.hashtags(t), "; ")), "; "), f"array_to_string(list_sort(list_distinct(regexp_extract_all(t, {sql_text('(' + T.HASHTAG + ')')}, 1))), '; ')"),
        "named": (lambda t, low: F.array_join(F.array_sort(F.split(T.mentions(t), "; ")), "; "), "array_to_string(list_sort(list_distinct(regexp_extract_all(t, '@([A-Za-z0-9_]+)', 1))), '; ')"),
    },
    where="t is not null",
    **_TWEET,
)

def _count_text(t):
    return F.when(t % 3 == 0, F.format_string("%.1fk", t / 10)).when(t % 3 == 1, F.concat(F.lit(" "), t.cast("string"), F.lit(",000"))).otherwise(F.lit("n/a"))


R.scalar(
    "txt_22_human_count",
    source="video_source",
    key="video_id",
    text="comments_count",
    columns={"n": (lambda t, low: T.human_count(_count_text(t)), "case when t % 3 = 0 then round(format('{:.1f}', t / 10.0)::double * 1000)::bigint when t % 3 = 1 then t * 1000 else 0 end")},
)
R.scalar("txt_23_truthy", source=KEPT, key="row_id", text="keep", columns={"yes": (lambda t, low: T.truthy(t), "coalesce(lower(trim(t::varchar)) in ('true', '1', 'yes', 'y', 't'), false)")})
R.scalar("txt_24_id_text", source="events", key="event_id", text="user_id", columns={"id": (lambda t, low: T.id_text(t.cast("double")), "t::varchar")})
R.scalar("txt_25_content_key", columns={"cache_key": (lambda t, low: T.content_key(t, "scope"), "sha1('scope::' || trim(t))"), "short": (lambda t, low: T.short_hash(t), "substring(sha256(t), 1, 16)")}, where="t is not null", **_KEPT)
R.scalar(
    "txt_26_clock",
    source="events",
    key="event_id",
    text="value",
    columns={
        "clock": (lambda t, low: T.clock_of_seconds(t), "case when t is not null then printf('%02d:%02d:%02d.%03d', round(t * 1000)::bigint // 3600000, round(t * 1000)::bigint // 60000 % 60, round(t * 1000)::bigint // 1000 % 60, round(t * 1000)::bigint % 1000) end"),
        "seconds": (lambda t, low: F.round(T.seconds_of_clock(T.clock_of_seconds(t)), 3), "round(round(t * 1000) / 1000, 3)"),
    },
)
_GUESS = dict(marks="ẹọṣụịńɗƙɓ", foreign=["na", "ya", "kwa", "dey", "wey", "ni"], function_words=["the", "and", "that", "is", "this", "about", "for"])
_word = lambda w: rf"(^|[^a-z]){w}([^a-z]|$)"
R.scalar(
    "txt_27_language_guess",
    columns={
        "guess": (
            lambda t, low: T.language_guess(t, **_GUESS),
            f"case when t is null or trim(t) = '' then 'unknown' when regexp_matches(lower(t), '[{_GUESS['marks']}]') then 'other' "
            f"when {_sum_hits([_word(w) for w in _GUESS['foreign']])} >= 2 then 'other' when {_sum_hits([_word(w) for w in _GUESS['function_words']])} >= 2 then 'en' "
            r"when length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) / nullif(length(t), 0)::double < 0.9 then 'other' else 'unknown' end",
        )
    },
    **_DOC,
)
R.scalar("txt_28_three_class", source=KEPT, key="row_id", text="keep_reason", columns={"label": (lambda t, low: T.three_class(F.when(t == "piece_relevant", "Positive").when(t == "too_short", " NEGATIVE ").otherwise(t)), "case when t = 'piece_relevant' then 'positive' when t = 'too_short' then 'negative' else 'neutral' end")})
R.scalar("txt_29_percent_text", source=KEPT, key="row_id", text="vote_count", columns={"share": (lambda t, low: T.percent_text(t, F.when(t > 3, t * 4 + 1)), "printf('%.1f%%', coalesce(100.0 * t / nullif(case when t > 3 then t * 4 + 1 end, 0), 0.0)::double)")}, where="t is not null")
R.scalar(
    "txt_30_parsed_time",
    source="events",
    key="event_id",
    text="ts",
    columns={"day": (lambda t, low: F.date_format(T.parsed_time(F.when(F.col("event_id") % 5 == 0, F.lit("not a time")).otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss")), "yyyy-MM-dd HH:mm:ss"), "yyyy-MM-dd"), "case when event_id % 5 = 0 then null else strftime(t, '%Y-%m-%d') end")},
)

_padded = "regexp_replace(lower(t), '[^a-z0-9]', '  ', 'g')"
_all_terms = f"regexp_extract_all({_padded}, '(?:^|[^a-z0-9])({'|'.join(PLAIN_TERMS)})(?:$|[^a-z0-9])', 1)"
R.scalar(
    "lex_01_keyword_hits",
    columns={
        "terms": (lambda t, low: F.array_join(F.array_sort(L.keyword_hits(low, PLAIN_TERMS)), "; "), f"array_to_string(list_sort(list_distinct({_all_terms})), '; ')"),
        "first_term": (lambda t, low: F.get(L.keyword_hits(low, PLAIN_TERMS), F.lit(0)), f"{_all_terms}[1]"),
    },
    where="t is not null",
    **_KEPT,
)
R.scalar("lex_02_keyword_totals", columns={"has_hit": (lambda t, low: L.keyword_count(low, PLAIN_TERMS) > 0, f"len({_all_terms}) > 0"), "n_hits": (lambda t, low: L.keyword_count(low, PLAIN_TERMS).cast("long"), f"len({_all_terms})")}, where="t is not null", **_KEPT)


def _terms_sql(terms, tagged: bool = False) -> str:
    tests = []
    for x in terms:
        inner = r"\s+".join(x.split())
        test = f"contains(lower(t), {sql_text(x)})" if tagged and x.startswith("#") else rf"regexp_matches(lower(t), '(^|[^A-Za-z0-9_]){inner}($|[^A-Za-z0-9_])')"
        tests.append(f"case when {test} then {sql_text(x)} end")
    return "array_to_string(list_filter([" + ", ".join(tests) + "], lambda x: x is not null), '; ')"


_TERMS = ("school fees", "next door", "new way", *MODERATE_TERMS)
R.scalar("lex_03_terms_found", columns={"terms": (lambda t, low: F.array_join(L.terms_found(low, _TERMS), "; "), _terms_sql(_TERMS))}, where="t is not null", **_KEPT)
_TAGGED = ("#hani", "#suha", "#l", "money", "pride")
R.scalar("lex_04_tags_and_terms", columns={"terms": (lambda t, low: F.array_join(L.tags_and_terms(low, _TAGGED), "; "), _terms_sql(_TAGGED, True))}, where="t is not null", **_KEPT)
R.scalar("lex_07_pattern_hits", columns={"positive": (lambda t, low: L.hits(low, POSITIVE), _sum_hits(POSITIVE)), "negative": (lambda t, low: L.hits(low, NEGATIVE), _sum_hits(NEGATIVE))}, where="t is not null", **_KEPT)
R.scalar("lex_08_any_phrase", columns={"found": (lambda t, low: L.any_phrase(low, ("my class", "next door", "nyumba")), "contains(lower(t), 'my class') or contains(lower(t), 'next door') or contains(lower(t), 'nyumba')")}, where="t is not null", **_KEPT)
_RULES = [("report", "they told us|said the same"), ("plea", "let us|need more|abeg"), ("lesson", "taught me|new way"), ("story", "grew up|i lost|my ")]
R.scalar("lex_11_first_label", columns={"label": (lambda t, low: L.first_label(low, _RULES, "other"), "case " + " ".join(f"when regexp_matches(lower(t), {sql_text(p)}) then {sql_text(x)}" for x, p in _RULES) + " else 'other' end")}, where="t is not null", **_KEPT)
_best = "list_max([" + ", ".join(f"{{'n': {_sum_hits(p)}, 'label': {sql_text(x)}}}" for x, p in THEMES.items()) + "])"
R.scalar("lex_12_best_label", columns={"label": (lambda t, low: L.best_label(low, THEMES, "none"), f"case when ({_best}).n > 0 then ({_best}).label else 'none' end")}, where="t is not null", **_KEPT)
_ranked = "list_sort(list_filter([" + ", ".join(f"{{'n': -{_sum_hits(p)}, 'label': {sql_text(x)}}}" for x, p in THEMES.items()) + "], lambda s: s.n < 0))"
R.scalar("lex_13_ranked_labels", columns={"labels": (lambda t, low: F.array_join(L.ranked_labels(low, THEMES, "none", 3), " > "), f"coalesce(nullif(array_to_string(list_transform({_ranked}[1:3], lambda s: s.label), ' > '), ''), 'none')")}, where="t is not null", **_KEPT)
R.scalar("lex_14_all_labels", columns={"labels": (lambda t, low: F.array_join(L.all_labels(low, THEMES, "none"), "; "), "coalesce(nullif(array_to_string(list_filter([" + ", ".join(f"case when {_sum_hits(p)} > 0 then {sql_text(x)} end" for x, p in THEMES.items()) + "], lambda x: x is not null), '; '), ''), 'none')")}, where="t is not null", **_KEPT)
R.scalar(
    "lex_05_matcher",
    columns={
        "terms": (
            lambda t, low: F.array_join(L.Matcher(("money", "story", "boy", "school fees", "#hani")).matches(low, T.compact_form(t)), " | "),
            "array_to_string(list_filter([case when regexp_matches(lower(t), '(^|[^a-z0-9])(money|monies)($|[^a-z0-9])') then 'money' end, case when regexp_matches(lower(t), '(^|[^a-z0-9])(story|stories)($|[^a-z0-9])') then 'story' end, "
            "case when regexp_matches(lower(t), '(^|[^a-z0-9])(boy|boys)($|[^a-z0-9])') then 'boy' end, case when contains(lower(t), 'school fees') or contains(lower(t), 'school fee') or "
            r"contains(regexp_replace(lower(t), '[^\p{L}\p{N}]', '', 'g'), 'schoolfee') then 'school fees' end, case when regexp_matches(lower(t), '#hani($|[^a-z0-9_])') then '#hani' end], lambda x: x is not null), ' | ')",
        )
    },
    where="t is not null",
    **_KEPT,
)


@R.query(
    "select event_type, coalesce(nullif(props->>'$.missing', ''), props->>'$.k') as k, count(*) as n from events group by 1, 2",
)
def src_10_json_first_present(spark, sf_dir):
    from weftlens.sources.nested import first_present

    return table(spark, sf_dir, "events").select("event_type", first_present(F.col("props"), ["$.missing", "$.k"]).alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


R.scalar("src_22_link_parts", source="video_source", key="video_id", text="page_url", columns={"host": (lambda t, low: F.regexp_extract(t, r"^https?://([^/]+)", 1), "regexp_extract(t, '^https?://([^/]+)', 1)"), "id": (lambda t, low: F.regexp_extract(t, r"[?&]v=([A-Za-z0-9_-]+)", 1), "regexp_extract(t, '[?&]v=([A-Za-z0-9_-]+)', 1)")})
R.scalar("src_06_path_levels", source=TWEETS, key="row_id", text="url", columns={"level_1": (lambda t, low: F.get(F.split(F.regexp_replace(t, r"^https?://", ""), "/"), F.lit(0)), "split_part(regexp_replace(t, '^https?://', ''), '/', 1)"), "level_2": (lambda t, low: F.get(F.split(F.regexp_replace(t, r"^https?://", ""), "/"), F.lit(1)), "split_part(regexp_replace(t, '^https?://', ''), '/', 2)")}, where="t is not null")
R.scalar("snk_05_number_text", source="events", key="event_id", text="value", columns={"shown": (lambda t, low: T.number_text(F.when(t > 5, t)), "case when t > 5 then printf('%.6f', t) else '' end")})


@R.query("select row_id, case when author is not null and comment is not null then author || ' (' || comment || ')' when author is not null then author when comment is not null then comment else '' end as link from (select row_id, nullif(page_url, '') author, nullif(video_id, '') comment from filtered_v1_kept)")
def txt_20_combined_url(spark, sf_dir):
    return table(spark, sf_dir, KEPT).select("row_id", T.combined_url(F.col("page_url"), F.col("video_id")).alias("link"))


def queries():
    return R.queries


def oracle_sql():
    return R.sql
