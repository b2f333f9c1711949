"""Reading levels of every document."""

from pyspark.sql import functions as F

from weftlens.llm.catalogue import p9_found, p9_profile
from weftlens.llm.reading import rate_all_documents, rate_documents
from weftlens.runtime import table


def test_every_document_with_words(spark, rows_of, language_model):
    judged = rows_of("select sample_text, reading_level from '@reading_label.parquet'")
    texts = [(i, t) for i, (t, _) in enumerate(judged[:30])]
    swahili = "Kulea mtoto bila subira ni kazi ngumu sana. " * 12
    short = "The boy was too short to reach the door."
    rows = spark.createDataFrame([*texts, (100, None), (101, ""), (102, short), (103, swahili), (104, texts[0][1] + "\n" + swahili), (105, "\U0001f64f 2024")], "doc_id long, text string")
    got = {r.doc_id: r for r in rate_all_documents(rows, "doc_id", "text", judged, language_model).collect()}
    assert set(got) == {i for i, _ in texts} | {102, 103, 104}
    assert all(r.reading_level in (1, 2, 3) for r in got.values())
    assert [(got[i].english, got[i].tokens) for i in (102, 103)] == [(True, 9), (False, 96)] and not got[104].english
    long = {r.doc_id: r.reading_level for r in rate_documents(rows, "doc_id", "text", judged, language_model).collect()}
    assert long == {i: r.reading_level for i, r in got.items() if r.english and r.tokens >= 60}


def test_profile_counts_every_document(spark, sf_dir):
    profile = p9_profile(spark, sf_dir).collect()
    assert sum(r.docs for r in profile) == table(spark, sf_dir, "documents").count()
    rated = sum(r.docs for r in profile if r.reading_level is not None)
    assert rated >= table(spark, sf_dir, "documents").filter(F.regexp_like("text", F.lit("[a-z]{3}"))).count() * 0.95
    assert rated > p9_found(spark, sf_dir).count()
