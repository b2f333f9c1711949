"""Row filters and rule ladders: what to keep, and why."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlens.functions import lexicon as L
from weftlens.functions import text as T


def long_enough(df: DataFrame, text: str, chars: int = 5) -> DataFrame:
    """Rows whose trimmed text has at least so many characters; nulls go."""
    return df.filter(F.length(F.trim(F.col(text))) >= chars)


def enough_words(df: DataFrame, text: str, words: int = 8, chars: int = 0) -> DataFrame:
    return df.filter((T.words_by_space(F.col(text)) >= words) & (F.length(text) >= chars))


def substantive(c: Column, chars: int = 8, words: int = 3, alpha: int = 2, longest: int = 3) -> Column:
    return (F.length(c) >= chars) & (T.words_by_space(c) >= words) & (T.alpha_words(c) >= alpha) & (T.longest_word(c) >= longest)


def url_only(c: Column) -> Column:
    return (F.trim(c) != "") & (F.trim(F.regexp_replace(c, T.URL, "")) == "")


def tags_only(c: Column) -> Column:
    return (F.trim(c) != "") & (F.trim(F.regexp_replace(F.regexp_replace(c, T.MENTION, ""), T.HASHTAG, "")) == "")


def no_words(c: Column, compat: bool = False) -> Column:
    """Only pictographs and punctuation: no letter and no digit. ``compat`` repeats an older rule, under which any sign that
    isn't an ASCII letter or digit condemned the whole text."""
    if compat:
        return F.regexp_replace(F.regexp_replace(c, "[A-Za-z0-9]", ""), r"\s+", "") != ""
    return (F.trim(c) != "") & ~c.rlike(r"[\p{L}\p{N}]")


def low_content(c: Column, phrases: Sequence[str], words: int = 4) -> Column:
    """A few words that say nothing: the text, bare of punctuation, is one of the phrases."""
    bare = F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", ""))
    return (T.words_by_boundary(c) <= words) & bare.isin(list(phrases))


def hint_groups(low: Column, groups: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """One flag per group of hints; a hint counts inside words too."""
    return {f"has_{name}_hint": L.any_phrase(low, terms) for name, terms in groups.items()}


def structured(low: Column, groups: Mapping[str, Sequence[str]], auxiliary: str) -> Column:
    """Whether a text says something: long, or shorter with hints, or with a verb that makes a statement."""
    words = T.words_by_boundary(low)
    n = sum((f.cast("int") for f in hint_groups(low, groups).values()), F.lit(0))
    return (words >= 8) | ((words >= 5) & (n >= 1)) | ((words >= 3) & (n >= 2)) | low.rlike(auxiliary)


def keyword_tier_rule(df: DataFrame, text: str, high: Sequence[str], moderate: Sequence[str], context: Sequence[str], generic: Sequence[str] = (), mode: str = "v1") -> DataFrame:
    """Adds the hits of three tiers, ``keep`` and ``keep_reason``: one high term, or two moderate ones, or one with context.

    Mode v2 first takes the generic terms out of the high and moderate tiers.
    """
    if mode == "v2":
        high, moderate = [t for t in high if t not in generic], [t for t in moderate if t not in generic]
    df = df.withColumn("tier_low", T.filter_form(F.col(text)))  # once per row, not once per term
    low = F.col("tier_low")
    hits = {n: F.array_sort(L.terms_found(low, terms)) for n, terms in (("high_hits", high), ("moderate_hits", moderate), ("context_hits", context))}
    df = df.withColumns({n: F.coalesce(c, F.array().cast("array<string>")) for n, c in hits.items()})
    reason = (
        F.when(F.size("high_hits") >= 1, ">=1_high")
        .when(F.size("moderate_hits") >= 2, ">=2_moderate")
        .when((F.size("moderate_hits") >= 1) & (F.size("context_hits") >= 1), ">=1_moderate_plus_context")
        .otherwise("reject")
    )
    return df.withColumn("keep_reason", reason).withColumn("keep", F.col("keep_reason") != "reject").withColumns({n: F.array_join(n, "; ") for n in hits}).drop("tier_low")


def substance_rule(df: DataFrame, text: str, groups: Mapping[str, Sequence[str]], phrases: Sequence[str], auxiliary: str, mode: str = "v1", compat: bool = False) -> DataFrame:
    """Adds hint flags, ``keep`` and ``keep_reason`` by a ladder from empty texts to substantive ones."""
    df = df.withColumn("rule_low", T.filter_form(F.coalesce(F.col(text), F.lit(""))))  # once per row, not once per test
    low = F.col("rule_low")
    flags = hint_groups(low, groups)
    df = df.withColumns({**flags, "word_total": T.words_by_boundary(low), "rule_auxiliary": low.rlike(auxiliary)})
    words, n_hints = F.col("word_total"), sum((F.col(f).cast("int") for f in flags), F.lit(0))
    says = (words >= 8) | ((words >= 5) & (n_hints >= 1)) | ((words >= 3) & (n_hints >= 2)) | F.col("rule_auxiliary")
    any_hint = n_hints >= 1
    ladder = (
        F.when(low == "", "empty")
        .when(url_only(low), "url_only")
        .when(tags_only(low), "tags_mentions_only")
        .when(no_words(low, compat), "emoji_or_punct_only")
        .when(low_content(low, phrases), "low_content_short")
    )
    if mode == "v1":
        ladder = ladder.when(words < 3, "too_few_words_v1").when(says, "substantive_v1").otherwise("not_substantive_v1")
    else:
        ladder = (
            ladder.when(words < 5, "too_few_words_v2")
            .when(words >= 8, "substantive_v2_len")
            .when(any_hint & says, "substantive_v2_signal")
            .otherwise("not_substantive_v2")
        )
    df = df.withColumn("keep_reason", ladder)
    return df.withColumn("keep", F.col("keep_reason").startswith("substantive")).drop("rule_low", "rule_auxiliary")


def not_self_authored(df: DataFrame, author: str, handle: str) -> DataFrame:
    """Rows not by the account itself, whatever the case; rows without an author stay."""
    return df.filter(F.coalesce(F.lower(F.regexp_replace(author, "^@", "")) != handle.lower().lstrip("@"), F.lit(True)))


def word_ngrams(c: Column, n: int) -> Column:
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}\p{M}']+"), lambda w: w != "")
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " ")))


def drop_quotes(df: DataFrame, text: str, originals: DataFrame, original_text: str, key: Sequence[str], n: int = 8, share: float = 0.5) -> DataFrame:
    """Rows that don't mostly repeat an original post: less than ``share`` of their word n-grams occur in one.

    N-grams meet by an equi-join; only their distinct keys are compared, so that long or frequent originals cost nothing.
    """
    grams = df.select(*key, F.explode(word_ngrams(F.col(text), n)).alias("gram"))
    known = originals.select(F.explode(word_ngrams(F.col(original_text), n)).alias("gram")).distinct().withColumn("known", F.lit(1))
    quoted = grams.join(known, "gram", "left").groupBy(*key).agg(F.avg(F.coalesce("known", F.lit(0))).alias("known_share")).filter(F.col("known_share") >= share)
    return df.join(quoted, list(key), "left_anti")


def strip_leading_handles(c: Column) -> Column:
    """A reply without the names it starts with."""
    return F.regexp_replace(c, r"^(\s*@[A-Za-z0-9_.-]+[ :,]*)+", "")


def drop_terms(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """Rows whose lower-case text doesn't match; nulls stay."""
    return df.filter(~F.coalesce(F.lower(text).rlike(pattern), F.lit(False)))


def without_ids(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    return df.join(excluded.select(key).distinct(), key, "left_anti")


def with_overrides(df: DataFrame, overrides: DataFrame, key: str, text: str, override: str) -> DataFrame:
    """The curated text where there is one."""
    return df.join(overrides.select(key, F.col(override).alias("curated_text")), key, "left").withColumn(text, F.coalesce("curated_text", text)).drop("curated_text")


def reason_counts(df: DataFrame, reason: Column) -> DataFrame:
    """How many rows each reason took out."""
    return df.select(reason.alias("reason")).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def kept_rows(df: DataFrame, flag: str, text: str) -> DataFrame:
    """Rows whose flag is exactly true and whose text isn't blank."""
    return df.filter((F.col(flag) == F.lit(True)) & (F.trim(F.col(text)) != ""))
