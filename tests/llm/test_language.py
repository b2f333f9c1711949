"""Languages of documents and stretches."""

import random

from pyspark.sql import functions as F

from weftlens.llm.language import fit_languages, label_language, label_names, language_stretches, segment_batch


def test_held_out_accuracy(rows_of):
    samples = rows_of("select sample_text, lang from '@lang_sample.parquet'")
    random.Random(1).shuffle(samples)
    model = fit_languages(samples[:180])
    found = segment_batch(model, [t for t, _ in samples[180:]])
    assert sum(len(s) == 1 and s[0][0] == lang for s, (_, lang) in zip(found, samples[180:])) >= 0.97 * 180


def test_mixtures(rows_of, language_model):
    samples = rows_of("select sample_text, lang from '@lang_sample.parquet' where length(sample_text) between 40 and 120")
    rng = random.Random(2)
    hits = 0
    for _ in range(150):
        (a, x), (b, y), (c, z) = rng.sample(samples, 3)
        want = [x]
        for lang in (y, z):
            if lang != want[-1]:
                want.append(lang)
        (found,) = segment_batch(language_model, [f"{a}{rng.choice(['. ', ' ', ' - '])}{b}, {c}"])
        hits += [s[0] for s in found] == want
        assert all(0 < s[3] <= 1 for s in found)
    assert hits >= 135


def test_no_language_of_their_own(language_model):
    texts = [None, "", "😂😂 !!", "https://x.example/kweli", "@mwalimu_2 #kweli 12:30", "Natazama kutoka Nairobi, karo ya shule ni ngumu sana @some_name https://a.b/the", "this episode made me think about money in a new way, says someone from Kisumu"]
    found = segment_batch(language_model, texts)
    assert [len(f) for f in found] == [0, 0, 0, 0, 0, 1, 1] and found[5][0][0] == "sw" and found[6][0][0] == "en"


def test_long_text(language_model):
    text = "Raising a child without patience is very hard. " * 5000 + "Kulea mtoto bila subira ni kazi ngumu sana. " * 5000
    (found,) = segment_batch(language_model, [text])
    assert [f[0] for f in found] == ["en", "sw"] and found[0][2] == 40_000


def test_labels(spark):
    names = label_names([("en", "English", "eng; en-KE"), ("sw", "Kiswahili", None)])
    rows = spark.createDataFrame([("EN-ke ",), ("Kiswahili",), ("und",), ("",), (None,), ("fr",)], "l string")
    assert [r.x for r in rows.select(label_language(F.col("l"), names).alias("x")).collect()] == ["en", "sw", None, None, None, None]


def test_operator(spark, language_model):
    df = spark.createDataFrame([(1, "Nobody tells boys that money is not weakness", "a"), (2, None, "b"), (1, "Nobody tells boys that money is not weakness", "a")], "row_id long, t string, lang string")
    got = language_stretches(df.withColumnRenamed("lang", "own"), "row_id", "t", language_model, ["own"])
    assert [(r.row_id, r.own, r.seg_no, r.n_segs, r.lang, r.n_words) for r in got.collect()] == [(1, "a", 1, 1, "en", 8)] * 2
    assert language_stretches(df.limit(0), "row_id", "t", language_model).count() == 0
