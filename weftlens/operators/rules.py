"""Rule-based coders. A coder is data: pattern lists by label; the operators turn them into expressions of one select."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlens.functions import lexicon as L
from weftlens.functions import text as T

Patterns = Sequence[str]


def net_sentiment(positive: Column, negative: Column, margin: int = 2) -> Column:
    """By a margin positive or negative; both mixed; else whichever there is; else neutral."""
    return (
        F.when(positive >= negative + margin, "positive").when(negative >= positive + margin, "negative").when((positive > 0) & (negative > 0), "mixed").when(positive > 0, "positive").when(negative > 0, "negative").otherwise("neutral")
    )


@dataclass(frozen=True)
class AudienceRules:
    """What the audience coder looks for, as patterns on lower-case text."""

    themes: Mapping[str, Patterns]
    default_theme: str
    positive: Patterns
    negative: Patterns
    emotions: Sequence[tuple[str, str]]
    personal: Patterns
    personal_themes: Sequence[str]
    support: Patterns
    critique: Patterns
    hedges: str
    laugh: str
    insults: Patterns
    severe: Patterns
    misogyny: str
    negative_portrayal: str
    reproduces: str
    mentions_women: str
    foundations: Sequence[tuple[str, str]]
    default_foundation: str
    clusters: Mapping[str, str] = field(default_factory=dict)


def audience_coder(df: DataFrame, text: str, rules: AudienceRules, creator: str | None = None) -> DataFrame:
    """Adds themes, primary theme, sentiment, emotion, response type, toxicity, misogyny, hate flag, foundations, cluster."""
    df = df.withColumns({"coder_raw": F.coalesce(F.col(text), F.lit("")), "coder_low": F.lower(F.coalesce(F.col(text), F.lit("")))})
    low, raw = F.col("coder_low"), F.col("coder_raw")
    df = df.withColumns(
        {
            "themes": L.ranked_labels(low, rules.themes, rules.default_theme),
            "pos_hits": L.hits(low, rules.positive),
            "neg_hits": L.hits(low, rules.negative),
            "support_hits": L.hits(low, rules.support),
            "critique_hits": L.hits(low, rules.critique),
            "words": T.words_by_space(raw),
        }
    ).withColumns({"primary_theme": F.get("themes", F.lit(0)), "sentiment": net_sentiment(F.col("pos_hits"), F.col("neg_hits"))})
    by_sentiment = F.when(F.col("sentiment") == "positive", "warmth").when(F.col("sentiment") == "negative", "frustration").otherwise("neutral")
    emotion = by_sentiment
    for label, pattern in reversed(rules.emotions):
        emotion = F.when(low.rlike(pattern), label).otherwise(emotion)
    response = (
        F.when((F.col("words") <= 5) | (low.rlike(rules.laugh) & (F.col("words") <= 12)), "joking")
        .when((L.hits(low, rules.personal) >= 2) & F.col("primary_theme").isin(list(rules.personal_themes)), "personal")
        .when(F.col("critique_hits") > F.col("support_hits"), "critique")
        .when((F.col("support_hits") > 0) & (F.col("critique_hits") == 0), "support")
        .when(((F.col("support_hits") > 0) & (F.col("critique_hits") > 0)) | low.rlike(rules.hedges), "debate")
        .when(F.col("words") < 8, "unclear")
        .otherwise("debate")
    )
    upper = (raw == F.upper(raw)) & raw.rlike("[A-Z]") & (F.length(raw) > 60)
    toxicity = F.least(F.lit(3), F.least(F.lit(2), L.hits(low, rules.insults)) + upper.cast("int") + (L.hits(low, rules.severe) > 0).cast("int"))
    misogyny = F.least(F.lit(3), 2 * low.rlike(rules.misogyny).cast("int") + low.rlike(rules.negative_portrayal).cast("int") + (low.rlike(rules.reproduces) & low.rlike(rules.mentions_women)).cast("int"))
    found = F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(n)) for n, p in rules.foundations)))
    cluster = F.col("primary_theme")
    if creator and rules.clusters:
        cluster = F.coalesce(F.create_map(*[F.lit(x) for kv in rules.clusters.items() for x in kv])[F.col(creator)], cluster)
    df = df.withColumns({"emotion": emotion, "response": response, "toxicity": toxicity, "misogyny": misogyny, "cluster": cluster, "foundations": F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(rules.default_foundation)))})
    return df.withColumn("hate", (F.col("toxicity") == 3) & (F.col("misogyny") >= 2)).drop("pos_hits", "neg_hits", "support_hits", "critique_hits", "words", "coder_low", "coder_raw")


def confidence(score: Column, words: Column) -> Column:
    return F.when((score >= 3) | (words > 45), "High").when((score >= 1) | (words > 12), "Medium").otherwise("Low")


def dimension_coder(df: DataFrame, text: str, dimensions: Mapping[str, Mapping[str, Patterns]], defaults: Mapping[str, str], evidence: Patterns, extra: Patterns = ()) -> DataFrame:
    """The best label of each dimension, the confidence of the strongest one, and a window of evidence."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    strongest = F.greatest(*(L.hits(low, p) for labels in dimensions.values() for p in labels.values())) + (L.hits(low, extra) if extra else F.lit(0))
    return df.withColumns(
        {
            **{d: L.best_label(low, labels, defaults[d]) for d, labels in dimensions.items()},
            "confidence": confidence(strongest, T.words_by_space(low)),
            "evidence": T.evidence_window(F.coalesce(F.col(text), F.lit("")), list(evidence), 40, 160),
        }
    )


def stance(low: Column, by_creator: Mapping[str, Sequence[tuple[str, str]]], creator: Column, support: Patterns, oppose: Patterns, laugh: str, words: Column, default: str) -> Column:
    """A creator's own tests first, then support against oppose, then short or laughing is neutral, then the default."""
    s, o = L.hits(low, support), L.hits(low, oppose)
    out = F.when(s > o, "support").when(o > s, "oppose").when((words <= 5) | low.rlike(laugh), "neutral").otherwise(default)
    for name, tests in by_creator.items():
        for label, pattern in reversed(tests):
            out = F.when((creator == name) & low.rlike(pattern), label).otherwise(out)
    return out


def relevance_score(df: DataFrame, text: str, gender: Patterns, high: Patterns, normative: Patterns, topics: Mapping[str, Patterns], bonus: Mapping[str, int], is_reply: Column, is_repost: Column, pairs: Patterns) -> DataFrame:
    """Adds ``points``, ``relevance`` 1 to 5, ``keep`` and ``reason``. Capped hits, topic bonus, a reply's malus, two pair patterns."""
    df = df.withColumn("score_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    low = F.col("score_low")
    g, h, n = (L.hits(low, p) for p in (gender, high, normative))
    topic_hits = sum(((L.hits(low, p) > 0).cast("int") for p in topics.values()), F.lit(0))
    primary = L.best_label(low, topics, "none")
    extra = L.let(primary, lambda p: F.coalesce(F.create_map(*[F.lit(x) for kv in bonus.items() for x in kv])[p], F.lit(0)))
    points = F.least(g, F.lit(3)) + F.least(2 * h, F.lit(4)) + F.least(n, F.lit(2)) + F.least(topic_hits, F.lit(3)) + extra - is_reply.cast("int")
    for p in pairs:
        points = points + 3 * low.rlike(p).cast("int")
    early = F.when(F.trim(low) == "", "empty").when(is_repost, "repost").when(T.words_by_boundary(low) < 5, "too short")

    def judged(v: Column) -> Column:
        own = F.when(v["early"].isNull(), v["points"]).otherwise(0)
        level = F.when(v["early"].isNotNull(), 1).when(v["points"] >= 8, 5).when(v["points"] >= 5, 4).when(v["points"] >= 3, 3).when(v["points"] >= 1, 2).otherwise(1)
        return F.struct(F.coalesce(v["early"], v["primary"]).alias("reason"), own.alias("points"), level.alias("relevance"))

    df = df.withColumn("judged", L.let(F.struct(points.alias("points"), early.alias("early"), primary.alias("primary")), judged)).select("*", "judged.*").drop("judged", "score_low")
    return df.withColumn("keep", ~is_repost & (F.col("relevance") >= F.when(is_reply, 4).otherwise(3)))


def engagement(*columns: str) -> Column:
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in columns), F.lit(0))


@dataclass(frozen=True)
class Step:
    """One case of a ladder: ``label`` where ``pattern`` is found in the lower-case text and ``where`` (SQL over the columns
    and the outputs of ladders before) holds; what isn't given holds."""

    label: str
    pattern: str | None = None
    where: str | None = None


def ladder_coder(df: DataFrame, text: str, ladders: Mapping[str, tuple[Sequence[Step], str]]) -> DataFrame:
    """Adds one column per ladder: the label of its first step that holds, else its default. Ladders see those before them."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    for name, (steps, default) in ladders.items():
        out = F.lit(default)
        for step in reversed(steps):
            holds = F.lit(True) if step.pattern is None else low.rlike(step.pattern)
            if step.where is not None:
                holds = holds & F.coalesce(F.expr(step.where), F.lit(False))
            out = F.when(holds, F.lit(step.label)).otherwise(out)
        df = df.withColumn(name, out)
    return df
