"""Queries over whole tables: no row is left out by an id, a length, a place or a limit."""

import json

import duckdb

from weftlens.operators import aggregate as A
from weftlens.plans import catalogue


def run(spark, sf_dir, name):
    return catalogue.queries()[name](spark, sf_dir)


def test_every_event_votes(spark, tmp_path):
    rows = [(i, i % 3, "view" if i % 2 else "click") for i in range(1990, 2200)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = run(spark, str(tmp_path), "agg_14_repeat_votes").collect()
    assert sum(sum(json.loads(r.votes_json).values()) for r in got) == 210
    assert all(0 < r.stability <= 1 for r in got)


def test_runs_of_each_key(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b", None, 1)], "k string, label string, i long")
    got = {r.k: (r.modal, r.stability, r.secondary) for r in A.repeat_votes(rows, "k", "label", "i", None, "none").collect()}
    assert got == {"a": ("x", 0.667, "y"), "b": ("none", 1.0, "")}


def transcripts(spark, tmp_path, *texts):
    rows = [(i, t, "transcript") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, content_type string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_every_turn_is_probed(spark, tmp_path):
    long = "we spoke about the school fees and about the uncle who paid them for many years"
    sf_dir = transcripts(spark, tmp_path, f"Host: {long} until he left\nGuest: yes\nHost: {long[:50]}\nGuest: \nHost: {long} and more")
    got = {r.item: (r.probe, r.turn) for r in run(spark, sf_dir, "jon_10_probe_join").collect()}
    assert got == {"0-1": (80, 1), "0-2": (80, 2), "0-3": (80, 1), "0-5": (80, 1)}


def test_second_probe_and_empty_items(spark):
    items = spark.createDataFrame([("a", 1, "x" * 40 + "y" * 40), ("b", 1, " "), ("c", 1, None)], "item string, f int, t string")
    turns = spark.createDataFrame([(1, 1, "nothing"), (1, 2, "x" * 40 + "z")], "file int, turn int, text string")
    from weftlens.operators.joins import probe_join

    assert [tuple(r) for r in probe_join(items, turns, "t", "file", "turn", "text", "item", "f").collect()] == [("a", 40, 2)]


def test_every_flag_has_a_place(spark, tmp_path):
    kinds = ["known-value normalization", "missing value", "filled missing other specify", None]
    rows = [(i, kinds[i % 4], None if i % 5 == 0 else f"c{i % 3}") for i in range(200)]
    spark.createDataFrame(rows, "flag_id long, flag_type string, coder string").write.parquet(str(tmp_path / "human_kenya_final_validation_flags.parquet"))
    got = sorted((r.position, r.flag_id, r.lv) for r in run(spark, str(tmp_path), "win_11_by_severity").collect())
    at = {"missing value": 0, "filled missing other specify": 1}
    want = sorted(rows, key=lambda r: (at.get(r[1], 2), r[2] is None, r[2] or "", r[0]))
    assert [(p, i) for p, i, _ in got] == [(n, r[0]) for n, r in enumerate(want, 1)]
    assert [lv for _, _, lv in got] == ["HIGH"] * 50 + ["MED"] * 50 + ["LOW"] * 100


def test_unknown_levels_come_last(spark):
    from weftlens.operators.ordered import place_by_severity

    rows = spark.createDataFrame([(1, None), (2, "LOW"), (3, "odd"), (4, "HIGH")], "i int, lv string")
    assert sorted((r.place, r.i) for r in place_by_severity(rows, "lv", ["HIGH", "LOW"], "place", "i").collect()) == [(1, 4), (2, 2), (3, 1), (4, 3)]


def test_every_chunk_is_a_row(spark, tmp_path):
    words = [f"w{i}" for i in range(45)]
    sf_dir = transcripts(spark, tmp_path, f"Host: {' '.join(words)}\nGuest: yes")
    got = sorted((r.turn, r.chunk, r.text) for r in run(spark, sf_dir, "mdl_20_word_chunks").collect())
    assert got == [(1, 1, " ".join(words[:20])), (1, 2, " ".join(words[20:40])), (1, 3, " ".join(words[40:])), (2, 1, "yes")]


def test_more_than_fifty_themes(spark):
    from itertools import product

    from weftlens.operators.model import topic_clusters

    centres = list(product((0.0, 10.0, 21.0, 33.0), repeat=3))[:60]
    rows = [(i, [x + 0.01 * ((i * p) % 11) for x, p in zip(centres[i % 60], (3, 5, 7))]) for i in range(4800)]
    got = topic_clusters(spark.createDataFrame(rows, "i long, v array<double>"), "i", "v", dimensions=3).filter("cluster >= 0")
    assert got.select("cluster").distinct().count() > 50


def test_any_line_end(spark, tmp_path):
    sf_dir = transcripts(spark, tmp_path, "Host: one\r\nand two\r\nGuest: three\r\n", "Host: four\rGuest: five", "Host: six\nGuest: seven", None)
    got = sorted((r.file, r.turn, r.speaker, r.text) for r in run(spark, sf_dir, "src_16_turns").collect())
    assert got == [(0, 1, "Host", "one and two"), (0, 2, "Guest", "three"), (1, 1, "Host", "four"), (1, 2, "Guest", "five"), (2, 1, "Host", "six"), (2, 2, "Guest", "seven")]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet/*.parquet')")
    for name in ("jon_10_probe_join", "mdl_20_word_chunks"):
        df = run(spark, sf_dir, name)
        assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"select {', '.join(df.columns)} from ({catalogue.oracle_sql()[name]})").fetchall())


def test_orphan_other(spark):
    from weftlens.operators.quality import recoding_report

    book = [("Q1", ["Red", "Other"], True, False, None, None), ("Q1b", [], False, False, "Q1", None), ("Q2", ["Yes"], False, False, None, None), ("Q2b", [], False, False, "Q2", None), ("Q3", ["Other"], False, False, None, None), ("Q3b", None, False, False, "Q3", None)]
    rows = [("i1", "Q1", "Red; other"), ("i1", "Q1b", "pink"), ("i2", "Q1", "Other"), ("i2", "Q1b", " "), ("i3", "Q1", "Other"), ("i4", "Q1", "Red"), ("i4", "Q1b", "pink"), ("i5", "Q2", "Yes"), ("i5", "Q2b", "why"), ("i6", "Q3", "Other"), ("i6", "Q3b", "x"), ("i7", "Q3b", "x")]
    answers = spark.createDataFrame([(i, "a", q, v) for i, q, v in rows], "item string, coder string, question string, answer string")
    book = spark.createDataFrame(book, "question string, options array<string>, multi boolean, required boolean, parent string, gate string")
    got = [(r.check, r.severity, r.item, r.question) for r in recoding_report(answers, book, "item", "coder", "question", "answer", ";").collect() if r.check.startswith("4 ")]
    assert got == [("4 other without text", "LOW", "i2", "Q1"), ("4 other without text", "LOW", "i3", "Q1"), ("4 text without other", "LOW", "i4", "Q1b"), ("4 text without other", "LOW", "i7", "Q3b")]
