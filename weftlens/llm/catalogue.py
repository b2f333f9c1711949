"""The queries of this sub-package, each over its whole tables with production parameters, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlens.llm import record_queries
from weftlens.llm.abuse import AbuseModel, abuse_categories, abuse_scores, fit_abuse
from weftlens.llm.language import LanguageModel, fit_languages, label_language, label_names, language_stretches
from weftlens.llm.mixing import mix_documents, mix_report, water_fill, whole_total
from weftlens.llm.personal import personal_spans
from weftlens.llm.reading import rate_all_documents, rate_documents
from weftlens.llm.tokens import TOKENIZER_DIR, token_counts, token_ids
from weftlens.llm.visual import canonical_text, look_alike_classes, look_alike_pairs, look_keys
from weftlens.llm.listed import all_rows
from weftlens.runtime import cut_lineage, table

TWEETS, KEPT = "tweet_there_is_no_amount_of", "filtered_v1_kept"
#: No more labelled rows than these are read for fitting (those at hand hold hundreds), first by a hash of the row.
MOST_SAMPLES = 20_000
#: Lists that operators hold whole (languages, targets, entries): beyond this an error, never a part of them.
MOST_LISTED = 200_000
#: About so many texts without labels hold the abuse model back, drawn by a hash of the row.
MOST_UNLABELLED = 2_000
_FITTED: dict = {}


def _of(name: str) -> Column:
    return F.lit(name).alias("src_table")


def _samples(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> list[tuple]:
    """Labelled rows, to fit on; in a fixed order, so that a fit doesn't depend on how the table is stored."""
    rows = table(spark, sf_dir, name).select("sample_id", *columns)
    return [tuple(r)[1:] for r in rows.orderBy(F.xxhash64(*rows.columns), "sample_id").limit(MOST_SAMPLES).collect()]


def _listed(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> list[tuple]:
    """A whole list; an error if it is longer than an operator may hold."""
    return all_rows(table(spark, sf_dir, name).select(*columns), MOST_LISTED)


def _fitted(fit: Callable, *samples):
    """What was fitted on these samples before, in this process, or a new fit."""
    key = (fit.__name__, hash(tuple(tuple(s) for s in samples)))
    if key not in _FITTED:
        if len(_FITTED) > 16:
            _FITTED.clear()
        _FITTED[key] = fit(*samples)
    return _FITTED[key]


def _languages(spark: SparkSession, sf_dir: str) -> LanguageModel:
    """Prototypes from the language samples, and from the judged reading texts, which are all English."""
    english = [(t, "en") for (t,) in _samples(spark, sf_dir, "reading_label", "sample_text")]
    return _fitted(fit_languages, sorted(_samples(spark, sf_dir, "lang_sample", "sample_text", "lang") + english, key=str))


def _stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = label_names(_listed(spark, sf_dir, "language_ref", "lang", "lang_name", "other_labels"))
    model = _languages(spark, sf_dir)
    parts = []
    for src, name, text in (("tweet", TWEETS, "comment_text"), ("kept", KEPT, "comment")):
        rows = table(spark, sf_dir, name).select("row_id", text, label_language(F.col("language_detected"), names).alias("label_lang"))
        parts.append(language_stretches(rows, "row_id", text, model, ["label_lang"]).select(_of(src), "*"))
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of the texts whose stored label is missing or wrong, or that are in several languages."""
    wrong = (F.col("n_segs") > 1) | F.col("label_lang").isNull() | (F.col("label_lang") != F.col("lang"))
    return _stretches(spark, sf_dir).filter(wrong).select("src_table", "row_id", "seg_no", "lang")


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every text, with its confidence."""
    return _stretches(spark, sf_dir).select("src_table", "row_id", "seg_no", "lang", F.round("confidence", 4).alias("confidence"), "first_char", "n_words")


def p1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One language per text, that of most of its words, with the confidence of that and the number of languages."""
    share = F.sum("n_words").over(_by_text())
    rows = _stretches(spark, sf_dir).groupBy("src_table", "row_id", "lang").agg(F.sum("n_words").alias("n_words"), F.avg("confidence").alias("confidence"))
    ranked = rows.withColumns({"all_words": share, "langs": F.count("*").over(_by_text())})
    return ranked.groupBy("src_table", "row_id").agg(
        F.max_by("lang", F.struct("n_words", "lang")).alias("lang"),
        F.round(F.max_by(F.col("confidence") * F.col("n_words") / F.col("all_words"), F.struct("n_words", "lang")), 4).alias("confidence"),
        F.max("langs").cast("int").alias("langs"),
    )


def _by_text():
    from pyspark.sql import Window

    return Window.partitionBy("src_table", "row_id")


def _looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of every text, written down once: 32 bytes a row, which are read several times."""
    keys = [look_keys(table(spark, sf_dir, name), "row_id", text).select(_of(src), "*") for src, name, text in (("tweet", TWEETS, "text"), ("kept", KEPT, "comment"))]
    return cut_lineage(keys[0].unionByName(keys[1]))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows whose texts differ as stored but look the same."""
    return look_alike_pairs(_looks(spark, sf_dir), ["src_table"])


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without pairs, one row per text: its class of look (the smallest row that looks like it) and of stored text."""
    return look_alike_classes(_looks(spark, sf_dir), ["src_table"])


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its consistent form."""
    parts = []
    for src, name, text in (("tweet", TWEETS, "text"), ("kept", KEPT, "comment")):
        rows = table(spark, sf_dir, name).select("row_id", text)
        parts.append(canonical_text(rows, text).select(_of(src), "row_id", "canonical_text"))
    return parts[0].unionByName(parts[1])


def _abuse(spark: SparkSession, sf_dir: str) -> AbuseModel:
    texts = _texts(spark, sf_dir)
    # a share of the rows by hash, so that no task sends more than its share to the driver
    rows = sum(table(spark, sf_dir, name).count() for name in (TWEETS, KEPT))  # told by the files' footers
    place = F.shiftrightunsigned(F.xxhash64("src_table", "row_id"), 11) / F.lit(float(1 << 53))
    drawn = texts.filter(place < MOST_UNLABELLED / max(1, rows)).select("scored").limit(2 * MOST_UNLABELLED).collect()
    return _fitted(fit_abuse, _samples(spark, sf_dir, "abuse_label", "sample_text", "category"), sorted({r[0] for r in drawn}))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, name).select(_of(src), "row_id", F.col(text).alias("scored")) for src, name, text in (("tweet", TWEETS, "comment_text"), ("kept", KEPT, "comment"))]
    return parts[0].unionByName(parts[1]).filter("scored is not null")


def _scores(spark: SparkSession, sf_dir: str, model: AbuseModel) -> DataFrame:
    tweets = table(spark, sf_dir, TWEETS).select("row_id", "comment_text", F.lit("tweet").alias("src_table"), F.lit(TWEETS).alias("source"))
    kept = table(spark, sf_dir, KEPT).select("row_id", F.col("comment").alias("comment_text"), F.lit("kept").alias("src_table"), F.col("source_file").alias("source"))
    parts = [abuse_scores(rows, "row_id", "comment_text", model, ["src_table", "source"]) for rows in (tweets, kept)]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per category of a text."""
    model = _abuse(spark, sf_dir)
    return abuse_categories(_scores(spark, sf_dir, model), model, ["src_table", "row_id"])


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of every text."""
    model = _abuse(spark, sf_dir)
    return _scores(spark, sf_dir, model).select("src_table", "row_id", *(F.round(f"score_{c}", 4).alias(f"score_{c}") for c in model.categories))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, and the share of each category, per video file and for the tweet table."""
    model = _abuse(spark, sf_dir)
    scored = _scores(spark, sf_dir, model).filter(F.col(f"score_{model.categories[0]}").isNotNull())
    rates = [F.round(F.avg((F.col(f"score_{c}") >= model.threshold).cast("double")), 6).alias(f"rate_{c}") for c in model.categories]
    return scored.groupBy("src_table", "source").agg(F.count("*").alias("texts"), *rates)


def _common_words(spark: SparkSession, sf_dir: str) -> list[str]:
    """Words of the small reference tables: what is in them isn't a surname."""
    texts = [table(spark, sf_dir, name).select(F.col(column).alias("t")) for name, column in (("lang_sample", "sample_text"), ("abuse_label", "sample_text"), ("reading_label", "sample_text"), ("codebook_dim", "option_text"), ("codebook_dim", "option_note"))]
    words = reduce(DataFrame.unionByName, texts).select(F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"(\p{L}+)"), 1)).alias("word")).distinct()
    return sorted(w for (w,) in all_rows(words, MOST_LISTED))


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _common_words(spark, sf_dir)
    parts = [personal_spans(table(spark, sf_dir, name), "row_id", text, words).select(_of(src), "*") for src, name, text in (("tweet", TWEETS, "comment_text"), ("kept", KEPT, "author"))]
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of personal information in each text."""
    return _personal(spark, sf_dir).select("src_table", "row_id", F.explode("kinds").alias("pii_type"))


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders."""
    return _personal(spark, sf_dir).select("src_table", "row_id", "redacted")


def p7_ids(spark: SparkSession, sf_dir: str, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """The token ids of every document."""
    return token_ids(table(spark, sf_dir, "documents"), "doc_id", "text", "byte_bpe_50k", tokenizer_dir)


def _mix(spark: SparkSession, sf_dir: str, whole: bool = False, tokenizer_dir: str = TOKENIZER_DIR):
    targets = _listed(spark, sf_dir, "mix_target", "source", "target_share", "max_repeats")
    documents = table(spark, sf_dir, "documents").filter(F.col("source").isin([t[0] for t in targets if t[0] is not None]))
    tokens = cut_lineage(token_counts(documents, "text", ["doc_id", "source"], "byte_bpe_50k", tokenizer_dir))
    sizes = {r[0]: r[1] for r in tokens.groupBy("source").agg(F.sum("tokens")).collect()}  # one row per target
    shares = water_fill(sizes, targets, whole_total(sizes, targets) if whole else None)
    return mix_documents(tokens, shares), shares


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the largest mix in which every source that has documents meets its target, and how often each is used."""
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, reachable and actual shares of that mix."""
    return mix_report(*_mix(spark, sf_dir))


def p8_whole_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a mix as large as its sources: small sources are used as often as they may be, others share the rest."""
    return _mix(spark, sf_dir, whole=True)[0]


def p8_whole_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, reachable and actual shares of the mix as large as its sources."""
    return mix_report(*_mix(spark, sf_dir, whole=True))


def _judged(spark: SparkSession, sf_dir: str) -> list[tuple]:
    return _samples(spark, sf_dir, "reading_label", "sample_text", "reading_level")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of every English document of at least 60 tokens."""
    rated = rate_documents(table(spark, sf_dir, "documents"), "doc_id", "text", _judged(spark, sf_dir), _languages(spark, sf_dir))
    return rated.select("doc_id", "reading_level")


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents per source, level and whether they are wholly English, with the mean place on the scale; level and
    language are null for documents without words."""
    documents = table(spark, sf_dir, "documents")
    levels = rate_all_documents(documents, "doc_id", "text", _judged(spark, sf_dir), _languages(spark, sf_dir))
    rows = documents.select("doc_id", "source").join(levels, "doc_id", "left")
    return rows.groupBy("source", "english", "reading_level").agg(F.count("*").alias("docs"), F.round(F.avg("reading_scale"), 3).alias("mean_scale"))


_QUERIES = (p1_found, p1_segments, p1_documents, p3_found, p3_classes, p3_canonical, p4_found, p4_scores, p4_rates, p6_found, p6_redacted, p7_ids, p8_mix, p8_shares, p8_whole_mix, p8_whole_shares, p9_found, p9_profile)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return record_queries.queries() | {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    """What of these can be told in SQL; the tests compare the rest with brute force, exact round trips and held-out samples."""
    return record_queries.oracle_sql()
