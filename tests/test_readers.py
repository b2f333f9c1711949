"""Sources and sinks."""

import pytest
from pyspark.sql import functions as F

from weftlens.sources import nested, sinks, speech, tabular, workbook

VTT = """WEBVTT
Kind: captions

00:00:01.000 --> 00:00:02.500 align:start
<c>Hello</c> &amp; welcome

00:00:02,500 --> 00:00:04,000
Hello & welcome
to the <b>show</b>

"""


def lines(spark, text, file="f"):
    return speech.text_lines(spark.createDataFrame([(file, text)], "file string, text string"), "file", "text")


def test_captions(spark):
    got = [tuple(r) for r in speech.caption_segments(lines(spark, VTT)).orderBy("seg").collect()]
    assert got == [("f", 1, 1.0, 2.5, "Hello & welcome"), ("f", 2, 2.5, 4.0, "Hello & welcome to the show")]
    plain = [r.line for r in speech.caption_lines(lines(spark, VTT)).orderBy("pos").collect()]
    assert plain == ["Hello & welcome", "to the show"]
    assert speech.caption_segments(lines(spark, "no captions")).count() == 0


def test_diarisation(spark):
    text = "SPEAKER a 1 5.0 2.0 <NA> <NA> B <NA>\nSPEAKER a 1 1.0 2.5 <NA> <NA> A <NA>\nSPEAKER a 1 x 2.5 <NA> <NA> C <NA>\njunk\nSPEAKER a 1 9.0 1.0 <NA> <NA> B <NA>"
    got = [tuple(r)[1:] for r in speech.diarisation(lines(spark, text)).orderBy("start").collect()]
    assert got == [(1.0, 3.5, "Speaker 1"), (5.0, 7.0, "Speaker 2"), (9.0, 10.0, "Speaker 2")]


def test_turns_and_back(spark):
    text = "Title\n\nHost: Hello there\nand welcome\n\nGuest: Thanks: really"
    t = speech.turns(lines(spark, text))
    assert [(r.turn, r.speaker, r.text) for r in t.orderBy("turn").collect()] == [(1, "Host", "Hello there and welcome"), (2, "Guest", "Thanks: really")]
    assert [r.line for r in speech.header_lines(lines(spark, text)).collect()] == ["Title"]
    assert speech.transcript_text(t).first().text == "Host: Hello there and welcome\n\nGuest: Thanks: really"


def test_loose_json():
    text = '[{"speaker": "A", "text": "one"}, {"speaker": "B", "text": "two \\"x\\""}, {"speaker": "C", "text": "cut of'
    assert speech.loose_json_turns(text) == [("A", "one"), ("B", 'two "x"'), ("C", "cut of")]


def test_json_turns(spark):
    df = spark.createDataFrame([("f", '{"speaker": "A", "text": " x  y "}'), ("g", None), ("h", "")], "file string, body string")
    assert [tuple(r) for r in speech.json_turns(df, "file", "body").collect()] == [("f", 1, "A", "x y")]


def test_workbook_round_trip(spark, tmp_path):
    data = spark.createDataFrame([("a", 1, "x & y"), ("b", 2, None)], "name string, n int, note string")
    path = str(tmp_path / "book.xlsx")
    workbook.write_workbook(path, {"Data [1]": data, "Summary": data.limit(1)})
    assert [s for s, _ in workbook.sheets_of(path)] == ["Data  1", "Summary"]
    rows = workbook.read_workbooks(spark, str(tmp_path))
    got = workbook.with_header(rows).orderBy("row").collect()
    assert [(r.sheet, r.row, r["name"], r.n, r.note) for r in got] == [("Data  1", 2, "a", "1", "x & y"), ("Data  1", 3, "b", "2", None)]
    assert {r.sheet for r in workbook.read_workbooks(spark, path, skip=None).select("sheet").collect()} == {"Data  1", "Summary"}


def test_headers():
    assert workbook.unique_headers(["a", None, "a", " "]) == ["a", "column_2", "a (2)", "column_4"]
    assert workbook.find_header_row([["x"], ["Item ID", "Q1. Topic"], ["1"]], ["item id", "Q1 topic"]) == 1
    assert workbook.find_header_row([["x"]], ["item id"]) is None
    taken = set()
    assert [workbook.sheet_name("a/b" * 20, taken), workbook.sheet_name("a/b" * 20, taken)][1].endswith("(2)")


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,text\n1,"two\nlines, ""quoted"""\n2,\n', encoding="utf-8")
    (tmp_path / "b.tsv").write_text("id\ttext\n1\tx\n")
    a = tabular.read_table(spark, str(tmp_path / "a.csv"))
    assert a.columns == ["id", "text"] and a.orderBy("id").first().text == 'two\nlines, "quoted"'
    assert tabular.read_table(spark, str(tmp_path / "b.tsv")).first().text == "x"
    (tmp_path / "~$a.csv").write_text("x")
    assert {r.name for r in tabular.scan_files(spark, str(tmp_path), ".csv").collect()} == {"a.csv"}


def test_columns_found(spark):
    df = spark.createDataFrame([("1", "short", "a much longer text than others"), ("2", "x", "another long text here")], "id string, Label string, body string")
    assert tabular.find_text_column(df, ["comment", "label"]) == "Label"
    assert tabular.find_text_column(df, ["comment"]) == "body"
    assert tabular.find_column(df, ["lab"]) == "Label" and tabular.find_column(df, ["zzz"], long_text=True) == "body" and tabular.find_column(df, ["zzz"]) is None
    with pytest.raises(ValueError):
        tabular.find_column(df, [], override="nope")
    with pytest.raises(ValueError):
        tabular.assert_unique(df.unionAll(df), "id")
    assert tabular.assert_unique(df, "id").count() == 2


def test_lexicons(spark, tmp_path):
    df = spark.createDataFrame([(" Alpha  Beta ", "Highly relevant", None), ("x", "Highly", None), ("gamma", None, "moderate, I think"), ("delta", "low", None), ("gamma", "highly", None)], "term string, rel string, said string")
    assert {tuple(r) for r in tabular.load_lexicon(df, "term", "rel", "said").collect()} == {("alpha beta", "highly"), ("gamma", "highly")}
    (tmp_path / "ex.txt").write_text("# comment\n\nAlpha\nalpha\n")
    assert [r.term for r in tabular.load_exclusions(spark, str(tmp_path / "ex.txt")).collect()] == ["alpha"]


def test_cached(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "t")
    assert tabular.cached(spark, path, make).count() == 3 and tabular.cached(spark, path, make).count() == 3 and calls == [1]


def test_path_levels(spark):
    df = spark.createDataFrame([("/data/root/jane/tube/a.csv",)], "p string")
    assert tabular.path_levels(df, "p", "/root", ["creator", "platform"]).select("creator", "platform").first()[:] == ("jane", "tube")


def test_nested(spark):
    df = spark.createDataFrame([('{"a": {"b": ""}, "c": "x", "n": "7"}', 1), ("{}", 2), ("broken", 3), (None, 4)], "j string, id int")
    got = nested.item_columns(df, "j", {"v": ["$.a.b", "$.c"], "n": ["$.n"]}, {"n": "int"}).orderBy("id").collect()
    assert [(r.v, r.n) for r in got] == [("x", 7), (None, None), (None, None), (None, None)]
    assert nested.fixed_columns(df, {"k": ["nope", "id"], "z": ["nope"]}).orderBy("k").first()[:] == ("1", None)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A b", True, ["x"], 1.5), ("A b", False, [], None), (None, True, None, 2.0)], "g string, keep boolean, l array<string>, n double")
    summary = {r.g: (r.total, r.kept, r.pct) for r in sinks.write_triple(df, "keep", ["g"], str(tmp_path / "t")).collect()}
    assert summary == {"A b": (2, 1, 50.0), None: (1, 1, 100.0)}
    sinks.write_by_group(df.drop("l"), "g", str(tmp_path / "g"))
    assert {p.name for p in (tmp_path / "g").glob("group_slug=*")} == {"group_slug=a_b", "group_slug=none"}
    sinks.write_csv(df, str(tmp_path / "c"))
    assert {r.n for r in spark.read.option("header", "true").csv(str(tmp_path / "c")).collect()} == {"1.500000", None, "2.000000"}
    assert sinks.swap_id(df, "g", "A b", "Z").filter("g = 'Z'").count() == 2
    with pytest.raises(Exception, match="exists"):
        sinks.swap_id(df, "g", "x", "A b").collect()
    text = sinks.write_report(str(tmp_path / "r.md"), "Report", {"t": df.groupBy("g").agg(F.count("*").alias("n"))})
    assert "| g | n |" in text and sinks.outputs_present([str(tmp_path / "r.md"), str(tmp_path / "no")]) == [(str(tmp_path / "r.md"), True), (str(tmp_path / "no"), False)]
    with pytest.raises(ValueError):
        sinks.write_report(str(tmp_path / "r.md"), "x", {"t": df}, most_rows=1)
