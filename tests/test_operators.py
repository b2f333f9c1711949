"""Operators without SQL, and the corners of those with it."""

import pytest
from pyspark.sql import functions as F

from weftlens.functions import folding
from weftlens.functions import lexicon as L
from weftlens.functions import text as T
from weftlens.operators import codebook as C
from weftlens.operators import dedup as D
from weftlens.operators import filters as FL
from weftlens.operators import joins as J
from weftlens.operators import model as M
from weftlens.operators import ordered as W
from weftlens.operators import quality as Q
from weftlens.operators import reliability as REL
from weftlens.operators import sampling as S
from weftlens.operators import transcript as X
from weftlens.streaming import incremental


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize(
    "f, value, wanted",
    [
        (T.clean_comment, "  “a”  b\n", '"a" b'), (T.clean_comment, None, None), (T.human_count, "1.2k", 1200), (T.human_count, "3M", 3_000_000), (T.human_count, "1,234", 1234), (T.human_count, "x", 0), (T.human_count, None, 0),
        (T.seconds_of_clock, "01:02:03,500", 3723.5), (T.seconds_of_clock, "02:03.5", 123.5), (T.seconds_of_clock, "x", None), (T.deep_decode, "a &amp;amp;lt; b", "a < b"), (T.cell_text, "  Yes. ", "Yes"), (T.cell_text, "Well...", "Well..."),
        (T.id_text, "12.0", "12"), (T.id_text, "a.0", "a.0"), (T.longest_word, "", 0), (T.words_by_space, " ", 0), (T.ascii_ratio, "", None), (T.keep_lines, "a  b \r\n\n\n\n c", "a b\n\nc"), (T.truthy, " YES ", True), (T.truthy, None, False),
        (lambda c: T.clip(c, 7), "hello world again", "hello..."), (lambda c: T.evidence_window(c, ["zz", "w"], 3), "hello world", "...lo wor..."), (FL.strip_leading_handles, "@a @b: hi @c", "hi @c"), (FL.url_only, " https://x.y ", True),
    ],
)
def test_scalars(spark, f, value, wanted):
    assert one(spark, value, f) == wanted


def test_variants():
    assert L.variants("woman") == ["woman", "women", "womans"] and L.variants("baby") == ["baby", "babies", "babys"] and L.variants("man") == ["man", "men", "mans"] and L.variants("story") == ["story", "stories", "storys"] and L.variants("stories") == ["stories", "story", "stori", "storieses"] and L.variants("box") == ["box", "boxs", "boxes"]
    assert L.variants("go") == ["go"] and L.variants("a1b") == ["a1b"] and L.variants("boys") == ["boys", "boy", "boyses"]
    assert L.expanded(["boy", "boys", "#Tag", "real man"]) == {"boy": ["boy"], "boys": ["boys", "boyses"], "#tag": ["#tag"], "real man": ["real man", "real men", "real mans"]}


def test_rolling_captions(spark):
    rows = [("f", 1, 0.0, 1.0, "so I said"), ("f", 2, 1.0, 2.0, "I said hello to"), ("f", 3, 2.0, 3.0, "hello to"), ("f", 4, 3.0, 4.0, "hello to"), ("f", 5, 4.0, 5.0, "new words"), ("f", 6, 5.0, 6.0, None)]
    got = D.trim_rolling(spark.createDataFrame(rows, "f string, i int, s double, e double, t string"), "f", "i", "t", "s", "e").orderBy("i").collect()
    assert [(r.i, r.e, r.t) for r in got] == [(1, 1.0, "so I said"), (2, 4.0, "hello to"), (5, 5.0, "new words")]


def test_repeated_blocks(spark):
    block = ". ".join(f"sentence number {i} has some words" for i in range(20)) + "."
    rows = [("f", 1, block), ("f", 2, "short"), ("f", 3, block), ("f", 4, "short"), ("f", 5, None)]
    got = D.drop_repeated_blocks(spark.createDataFrame(rows, "f string, i int, t string"), "f", "i", "t").collect()
    assert sorted(r.i for r in got) == [1, 2, 4, 5]


def test_interjections(spark):
    rows = [("f", 1, "A", "one two three four"), ("f", 2, "B", "yes"), ("f", 3, "A", "five"), ("f", 4, "B", "a longer answer here"), ("f", 5, "A", "end")]
    got = W.absorb_interjections(spark.createDataFrame(rows, "f string, i int, s string, t string"), "f", "i", "s", "t").orderBy("i").collect()
    assert [(r.s, r.t) for r in got] == [("A", "one two three four yes five"), ("B", "a longer answer here"), ("A", "end")]


def test_samples(spark):
    df = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 'hot' else concat('g', id % 40) end as g")
    a = S.stratified_sample(df, ["g"], "id", 7)
    assert {r["count"] for r in a.groupBy("g").count().collect()} == {7}
    assert {r.id for r in a.collect()} == {r.id for r in S.stratified_sample(df.repartition(7), ["g"], "id", 7).collect()}
    assert {r.id for r in a.collect()} != {r.id for r in S.stratified_sample(df, ["g"], "id", 7, seed=1).collect()}
    assert S.global_sample(df, "id", 100).count() == 100 and S.global_sample(df.limit(5), "id", 100).count() == 5
    assert {(r.g, r["count"]) for r in S.quota_sample(df, "g", "id", {"hot": 50, "g1": 2}).groupBy("g").count().collect()} == {("hot", 50), ("g1", 2)}
    loads = [r["count"] for r in S.assign_round_robin(df, ["g"], "id", list("abcdef")).filter("g = 'hot'").groupBy("coder").count().collect()]
    assert max(loads) - min(loads) <= 1


def test_overlap_design(spark):
    design = S.overlap_design(spark.range(500), "id", list("abcdef"))
    assert design.select("id").distinct().count() == 20 and design.count() == 5 * 6 + 15 * 2
    assert {r["count"] for r in design.groupBy("coder").count().collect()} == {10}
    checks = Q.assignment_checks(design, "id", "coder", "group_id", 6, {"items": 20, "per_coder": 10})
    assert all(r.ok for r in checks.collect())
    assert not all(r.ok for r in Q.assignment_checks(design.filter("coder <> 'a' or id % 2 = 0"), "id", "coder", "group_id", 6, {"items": 20, "per_coder": 10}).collect())


def test_alpha(spark):
    rows = [("q", "x", "x")] * 3 + [("q", "x", "y"), ("q", "y", "y"), ("q", None, "y"), ("q", " ", "y"), ("c", "x", "x"), ("c", "x", "x")]
    df = spark.createDataFrame(rows, "question string, a string, b string")
    got = {r.question: r for r in REL.krippendorff_alpha(df, ["question"]).collect()}
    assert got["q"].pairs == 5 and got["q"].observed == pytest.approx(0.2)
    assert got["q"].alpha == pytest.approx(1 - 0.2 / (1 - (7 * 6 + 3 * 2) / 90)) and got["c"].alpha is None
    assert {r.question: r.alpha for r in REL.krippendorff_alpha(df, ["question"], "none").collect()}["q"] == pytest.approx(1 - 0.2 / (1 - 0.49 - 0.09))


def test_header():
    h = C.parse_header("Q2. Which topics? (select all that apply): Family / Work / Other")
    assert (h.question_id, h.text, h.options, h.multi, h.open_text) == ("Q2", "Which topics?", ("Family", "Work", "Other"), True, False)
    assert C.parse_header("Q18b) Advice\n- Pray\n- Wait").options == ("Pray", "Wait") and C.parse_header("Notes").open_text


def test_tokens_of():
    options = ["Work", "Work and income", "Family"]
    assert C.tokens_of("family, work and income; WORK", options, {}) == ["Work and income", "Family", "Work"]
    assert C.tokens_of("kids, odd thing", options, {"kids": "Family"}) == ["Family", "odd thing"] and C.tokens_of("", options, {}) == []
    assert C.tokens_of(", ".join(["work"] * 50), options, {}) == ["Work"] and C.tokens_of("homework", options, {}) == ["homework"]


def test_shared_columns():
    assert C.shared_columns(["Item ID", "Q1 & Q2", "Open"], ["q1 and q2", "item id", "x"], ["Item ID"]) == [("Q1 & Q2", "q1 and q2")]


def test_recoding_report(spark):
    book = spark.createDataFrame([("Q1", ["Yes", "No"], False, True, None, None), ("Q1a", ["Red", "None", "Blue"], True, False, "Q1", "yes"), ("Q3", [], False, False, None, None)], "question string, options array<string>, multi boolean, required boolean, parent string, gate string")
    rows = [("i1", "a", "Q1", "yes"), ("i1", "a", "Q1a", "Red; Green"), ("i2", "a", "Q1", ""), ("i2", "a", "Q1a", "None; Red"), ("i3", "b", "Q1", "maybe"), ("i4", "b", "Q1", "Yes"), ("i4", "b", "Q1a", None), ("i4", "b", "Q1", "Yes")]
    got = {(r["check"].split()[0], r.item, r.question) for r in Q.recoding_report(spark.createDataFrame(rows, "item string, coder string, question string, answer string"), book, "item", "coder", "question", "answer", ";").collect()}
    assert {("10", "i1", "Q1"), ("2", "i1", "Q1a"), ("3", "i2", "Q1"), ("7", "i2", "Q1a"), ("8", "i2", "Q1a"), ("1", "i3", "Q1"), ("9", "i4", "Q1a"), ("5", "i4", "Q1")} <= got


def test_model_boundary(spark):
    df = spark.createDataFrame([(1, "hello there"), (2, "hello there"), (3, ""), (4, None), (5, "fail now"), (6, "cached one")], "id int, t string")
    cache = df.filter("id = 6").select(T.content_key(F.col("t"), "n").alias("cache_key"), F.lit('{"k": 1}').alias("reply"))

    def backend(texts):
        assert "cached one" not in texts
        if any("fail" in t for t in texts):
            raise RuntimeError("service")
        return M.stub_backend(texts)

    out, fresh = M.run_model(df, "id", "t", "n", backend, cache, rows_per_call=1)
    got = {r.id: r.reply for r in out.collect()}
    assert got[1] == got[2] == '{"first": "hello", "words": 2}' and got[3] is got[4] is got[5] is None and got[6] == '{"k": 1}'
    assert fresh.count() == 1


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "hello there"), (2, "hello there"), (3, " "), (4, None), (5, "x" * 50), (6, "cached one"), (7, "fail")], "id int, t string")
    cache = df.filter("id = 6").select(T.content_key(F.col("t"), "embedding").alias("cache_key"), F.array(F.lit(9.0)).alias("embedding"))

    def backend(texts):
        assert "cached one" not in texts and all(len(t) <= 20 for t in texts)
        if "fail" in texts:
            raise RuntimeError("service")
        return [[float(len(t))] for t in texts]

    out, fresh = M.embed(df, "t", backend, cache, rows_per_call=1, most_chars=20, wait=0.0)
    assert {r.id: r.embedding for r in out.collect()} == {1: [11.0], 2: [11.0], 3: None, 4: None, 5: [20.0], 6: [9.0], 7: None}
    assert fresh.count() == 2


def test_replies():
    assert M.match_replies([1, 2, 3], [{"id": "2", "x": 1}, {"y": 2}, None]) == [None, '{"x": 1}', None]
    assert M.match_replies([1, 2], [{"x": 1}, {"x": 2}]) == ['{"x": 1}', '{"x": 2}']
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return [{"ok": 1}]

    assert M.with_retry(flaky, 3, 1.0, waits.append) == [{"ok": 1}] and waits == [1.0, 2.0]
    assert M.reply_schema({"a": ["x"]})["properties"]["a"]["enum"] == ["x"] and "sentiment" in M.analyses_catalogue()


def test_clusters(spark):
    rows = [(i, [float(i % 2) * 10 + (i % 7) * 0.01, (i % 5) * 0.01, 1.0, 0.0, 0.5, 0.1]) for i in range(60)]
    got = M.topic_clusters(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v").collect()
    assert len(got) == 60 and len({r.cluster for r in got if r.id % 2} & {r.cluster for r in got if not r.id % 2}) == 0
    assert {r.cluster for r in M.topic_clusters(spark.createDataFrame(rows[:5], "id int, v array<double>"), "id", "v").collect()} == {-1}


def test_anchors_have_a_bound(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "id int, v array<double>")
    got = {r.id: (r.anchor, r.similarity) for r in M.cosine_to_anchors(df, "v", df, "id", "v").collect()}
    assert got == {1: (1, 1.0), 2: (1, 0.0)}
    assert {r.id: (r.anchor, r.similarity) for r in M.cosine_to_anchors(df, "v", df, "id", "v", block=1).collect()} == got
    more = spark.createDataFrame([(i, [float(i % 7), float(i % 5) - 2.0]) for i in range(40)], "id int, v array<double>")
    blocks = [sorted(map(tuple, M.cosine_to_anchors(more, "v", more, "id", "v", block=n).select("id", "anchor", F.round("similarity", 9)).collect())) for n in (3, 100)]
    assert blocks[0] == blocks[1] and M.cosine_to_anchors(more, "v", more.limit(0), "id", "v").filter("anchor is not null").count() == 0


def test_samples_are_as_large_as_asked(spark):
    df = spark.range(5000).selectExpr("id % 900 as id", "case when id % 3 = 0 then null else id % 2 end as g")  # ids repeat
    got = {r.g: r.n for r in S.stratified_sample(df, ["g"], "id", 37).groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert got == {None: 37, 0: 37, 1: 37}
    assert S.global_sample(df, "id", 123).count() == 123 and S.global_sample(df.limit(5), "id", 123).count() == 5
    assert {r.g: r.n for r in S.quota_sample(df, "g", "id", {0: 3, 1: 9}).groupBy("g").agg(F.count("*").alias("n")).collect()} == {0: 3, 1: 9}


def test_retry_waits_as_told():
    class Busy(Exception):
        retry_after = 7

    pauses, calls = [], iter([Busy(), ValueError(), None])

    def call():
        error = next(calls)
        if error:
            raise error
        return [{"id": 1}]

    assert M.with_retry(call, 3, 0.5, pauses.append) == [{"id": 1}] and pauses == [7, 1.0]


def test_transcript_repair(spark):
    broken = '[{"speaker": "Jane Roe", "text": "hello"}, {"speaker": "Bob", "text": "hi"}]\nJane Roe: more\nRoe: and more Bob: ok'
    got = X.repaired(spark.createDataFrame([("f", broken)], "f string, t string"), "f", "t", ["Bob", "Jane Roe"]).orderBy("turn").collect()
    assert [(r.speaker, r.text) for r in got] == [("Jane Roe", "hello"), ("Bob", "hi"), ("Jane Roe", "more"), ("Jane Roe", "and more"), ("Bob", "ok")]
    turns = spark.createDataFrame([("f", 1, "Host", "thank you Mary"), ("f", 2, "Jane", "hello"), ("f", 3, "Mary Jane", "x")], "file string, turn int, speaker string, text string")
    assert [(r.speaker, r.text) for r in X.join_split_names(turns).orderBy("turn").collect()] == [("Host", "thank you"), ("Mary Jane", "hello"), ("Mary Jane", "x")]
    echo = spark.createDataFrame([("f", i, "A" if i % 2 else "Bo", "words Bo" if i % 2 else "x") for i in range(1, 7)], "file string, turn int, speaker string, text string")
    assert {r.text for r in X.strip_echoes(echo).collect()} == {"words", "x"}
    labels = spark.createDataFrame([("f", 1, "and then Mary", "spoke"), ("f", 2, "Speaker 2", "x"), ("f", 3, "J.", "x")], "file string, turn int, speaker string, text string")
    fixed = X.fix_labels(labels, {"Mary": "Mary Roe"}).orderBy("turn").collect()
    assert [(r.speaker, r.text, r.generic) for r in fixed] == [("Mary Roe", "and then spoke", False), ("Speaker 2", "x", True), ("J.", "x", False)]
    assert X.restore_initials(labels, {"f": "Jane Roe"}).filter("turn = 3").first().speaker == "Jane Roe"
    crowd = X.label_audience(spark.createDataFrame([("f", 1, "A", "Amen!"), ("f", 2, "A", "amen and more to say about that")], "file string, turn int, speaker string, text string"), ["amen"])
    assert [r.speaker for r in crowd.orderBy("turn").collect()] == ["Audience", "A"]
    titles = spark.createDataFrame([("On work with Jane Roe", "up"), ("Talk - John Doe", "up"), ("x", "up")], "t string, u string")
    assert [r.p for r in titles.select(X.primary_speaker(F.col("t"), F.col("u")).alias("p")).collect()] == ["Jane Roe", "John Doe", "up"]


def test_sentence_chunks():
    words = [f"w{i}" + ("." if i % 17 == 16 else "") for i in range(400)]
    chunks = X.chunk_to_sentences(words)
    assert all(150 <= len(c.split()) <= 180 and c.endswith(".") for c in chunks[:-1]) and " ".join(chunks).split() == words[: sum(len(c.split()) for c in chunks)]
    assert X.chunk_to_sentences([]) == []


def test_refinement(spark):
    t = lambda rows: spark.createDataFrame(rows, "f string, text string")
    got = {r.f: r.accepted for r in X.refinement_accepted(t([("a", "x y z"), ("a", "x"), ("b", "x y z"), ("c", "x")]), t([("a", "x y z w"), ("b", "x")]), "f").collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_contains_join(spark):
    left = spark.createDataFrame([(1, "Deep work"), (2, "on deep work today"), (3, "deep"), (4, "workers"), (5, None), (6, "")], "id int, t string")
    dim = spark.createDataFrame([(10, "deep work", 2), (11, "Deep Work", 1), (12, "work", 3)], "v int, d string, o int")
    got = {r.id: r.matched for r in J.contains_join(left, dim, "id", "t", "d", "v", "o").collect()}
    assert got == {1: 11, 2: 11, 3: 11, 4: None, 5: None, 6: None}


def test_no_pairs_within_hot_groups(spark):
    df = spark.range(20_000).selectExpr("id", "'same' as k")
    assert D.flag_duplicates(df, F.col("k")).filter("is_duplicate").count() == 20_000
    assert W.top_n(df, ["k"], [F.col("id")], 3).count() == 3


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "u", "Hello!", 1.0), ("2024-01-01 00:10:00", "u", "hello", 2.0), ("2024-01-01 05:00:00", "u", "other", 4.0)]
    source = spark.createDataFrame(rows, "ts string, user string, text string, value double").withColumn("ts", F.to_timestamp("ts"))
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    incremental.start(incremental.first_copies(stream, "text", "ts"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    seen = []
    incremental.each_batch(incremental.windowed_counts(stream, ["user"], "ts", "1 hour"), lambda df, _: seen.extend(df.collect()), str(tmp_path / "c2")).awaitTermination(120)
    assert sum(r.n for r in seen) == 3
    assert incremental.gap_sessions(source, ["user"], "ts", "1 hour", "value").count() == 2 and incremental.first_copies(source, "text", "ts").count() == 2


def test_foldings(spark):
    df = spark.createDataFrame([("ｆｕｌｌ  “ﬁ”",), ("plain",), (None,), ("a &amp;eacute; &amp;amp;lt;",), ("",)], "t string")
    assert [r.x for r in df.select(folding.folded_comment(F.col("t")).alias("x")).collect()][:3] == ['full "fi"', "plain", None]
    assert [r.x for r in df.select(folding.unescape(F.col("t")).alias("x")).collect()][3:] == ["a é <", ""]


def test_options_by_alias(spark):
    f = lambda c: F.array_join(C.options_by_alias(c, ["Work", "Family", "Other"], {"Family": ["kids"]}), "; ")
    assert [one(spark, v, f) for v in ("my kids and work", "Other: none", "another", None)] == ["Work; Family", "Other", "", ""]


def test_speaker_clusters(spark):
    rows = [("f", i, [1.0, 0.01 * i] if i in (0, 1, 4) else [0.0, 1.0]) for i in range(6)] + [("g", 0, [0.0, 0.0])]
    got = {(r.f, r.i): r.speaker for r in M.speaker_clusters(spark.createDataFrame(rows, "f string, i int, v array<double>"), "f", "i", "v").collect()}
    assert [got["f", i] for i in range(6)] == ["Speaker 1", "Speaker 1", "Speaker 2", "Speaker 2", "Speaker 1", "Speaker 2"] and got["g", 0] == "Speaker 1"


def test_numbers_of_a_hot_group(spark):
    df = spark.range(20_000).selectExpr("id", "case when id % 3 > 0 then 'hot' when id % 2 = 0 then null else 'other' end as g", "(id * 7919) % 20011 as o")
    got = W.numbered(df.repartition(6), ["g"], ["o"], "n")
    want = df.selectExpr("id", "row_number() over (partition by g order by o) as m")
    assert got.join(want, "id").filter("n = m").count() == 20_000 and got.columns == ["id", "g", "o", "n"]
    assert W.numbered(df.limit(0), ["g"], ["o"], "n").count() == 0
