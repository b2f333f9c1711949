"""Reading levels."""

import random

import numpy as np

from weftlens.llm.reading import ReadingModel, _totals, bare_text, fit_reading, rate_documents, word_slots


def levels(model, texts):
    scale = model.scale(*_totals(model, [word_slots(bare_text(t)) for t in texts]))
    return model.levels(scale).tolist()


def test_held_out(rows_of):
    judged = rows_of("select sample_text, reading_level from '@reading_label.parquet'")
    random.Random(1).shuffle(judged)
    model = fit_reading(judged[:90])
    assert np.mean([a == b for a, (_, b) in zip(levels(model, [t for t, _ in judged[90:]]), judged[90:])]) >= 0.95


def test_words_not_sentence_length(rows_of):
    judged = rows_of("select sample_text, reading_level from '@reading_label.parquet'")
    model = fit_reading(judged)
    easy = next(t for t, l in judged if l == 1)
    hard = next(t for t, l in judged if l == 3)
    assert levels(model, [bare_text(easy).replace(".", " and").replace("\n", " "), bare_text(hard).replace(",", ".")]) == [1, 3]


def test_bare_text():
    assert bare_text("[00:37] SPEAKER_00: I was six.\n* Then he went.\n> 1. Host: yes\nplain: no") .split("\n")[:3] == ["I was six.", "Then he went.", "yes"]


def test_degenerate():
    model = ReadingModel(np.zeros(1 << 15), np.zeros(1 << 15))
    assert np.isfinite(model.scale(np.zeros(2), np.array([0.0, 5.0]))).all()


def test_operator(spark, rows_of, language_model):
    judged = rows_of("select sample_text, reading_level from '@reading_label.parquet'")
    texts = [(i, t) for i, (t, _) in enumerate(judged[:30]) if len(t.split()) >= 60]
    swahili = "Kulea mtoto bila subira ni kazi ngumu sana. " * 12
    rows = [*texts, (100, None), (101, ""), (102, "too short"), (103, swahili), (104, texts[0][1] + "\n" + swahili)]
    got = {r.doc_id: r.reading_level for r in rate_documents(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", judged, language_model).collect()}
    assert set(got) == {i for i, _ in texts} and all(got[i] == judged[i][1] for i in got)
    assert rate_documents(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", judged, language_model).count() == 0
