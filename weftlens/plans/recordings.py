"""Queries of timed text, transcript repair and lists, over tables written as caption, diarisation and transcript lines, or
over small invented recordings with their known results."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlens.functions import folding
from weftlens.functions import lexicon as L
from weftlens.functions import text as T
from weftlens.operators import codebook as C
from weftlens.operators import dedup as D
from weftlens.operators import model as M
from weftlens.operators import ordered as W
from weftlens.operators import quality as Q
from weftlens.operators import sampling as SA
from weftlens.operators import transcript as X
from weftlens.plans.common import FLAGS, KEPT, Registry, sql_text
from weftlens.plans.scalars import _quotes, _sq
from weftlens.plans.speech import _TURNS, _turns
from weftlens.runtime import table
from weftlens.sources import speech as S

R = Registry()


def values(columns: str, *rows: tuple) -> str:
    """A table of known results as SQL."""
    show = lambda v: "null" if v is None else sql_text(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return "select * from (values " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f") as known({columns})"


_SPOKEN = "select user_id as file, event_id, event_type, round(value, 3) as s, round(value + 1.5, 3) as e, row_number() over (partition by user_id order by event_id) as n from events where value >= 0"


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter("value >= 0").select(F.col("user_id").alias("file"), "event_id", "event_type", F.round("value", 3).alias("s"), F.round(F.col("value") + 1.5, 3).alias("e"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("event_id")))


def _caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as a caption file: a time line, the tagged text, an empty line."""
    time = F.concat(T.clock_of_seconds(F.col("s")), F.lit(" --> "), T.clock_of_seconds(F.col("e")))
    lines = F.array(time, F.concat(F.lit("<c.x>"), "event_type", F.lit("</c> &amp; so on")), F.lit(""))
    return _spoken(spark, sf_dir).select("file", "n", F.posexplode(lines).alias("k", "line")).select("file", (F.col("n") * 3 + F.col("k")).alias("pos"), "line")


@R.query(f"select file, n as seg, s as start, e as \"end\", event_type || ' & so on' as text from ({_SPOKEN})")
def src_13_captions(spark, sf_dir):
    return S.caption_segments(_caption_lines(spark, sf_dir)).select("file", F.col("seg").cast("long").alias("seg"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


@R.query(f"select file, event_type || ' & so on' as line, min(n * 3 + 1)::bigint as pos from ({_SPOKEN}) group by 1, 2")
def src_14_caption_lines(spark, sf_dir):
    return S.caption_lines(_caption_lines(spark, sf_dir)).select("file", "line", F.col("pos").cast("long").alias("pos"))


@R.query(f"with v as ({_SPOKEN}), f as (select file, event_type, min(s) as s0 from v group by 1, 2), r as (select file, event_type, 'Speaker ' || row_number() over (partition by file order by s0, event_type) as speaker from f) select v.file, s as start, e as \"end\", speaker from v join r using (file, event_type)")
def src_15_diarisation(spark, sf_dir):
    line = F.concat_ws(" ", F.lit("SPEAKER"), F.col("file").cast("string"), F.lit("1"), F.col("s").cast("string"), F.lit("1.5"), F.lit("<NA>"), F.lit("<NA>"), "event_type", F.lit("<NA>"), F.lit("<NA>"))
    return S.diarisation(_spoken(spark, sf_dir).select("file", F.col("n").alias("pos"), line.alias("line")))


@R.query(f"with {_TURNS} select file, string_agg(speaker || ': ' || text, chr(10) || chr(10) order by turn) as text from turns group by 1")
def snk_07_transcript_text(spark, sf_dir):
    return S.transcript_text(_turns(spark, sf_dir))


@R.query(f"""with {_TURNS} select file, 'turn,speaker,text' || chr(10) || string_agg(turn || ',"' || replace(coalesce(speaker, ''), '"', '""') || '","' || replace(coalesce(text, ''), '"', '""') || '"', chr(10) order by turn) as csv from turns group by 1""")
def snk_07_transcript_csv(spark, sf_dir):
    return S.transcript_csv(_turns(spark, sf_dir))


@R.query(f"with {_TURNS} select file, turn, speaker, text from turns")
def snk_07_transcript_json(spark, sf_dir):
    """Written as JSON and read again."""
    written = S.transcript_json(_turns(spark, sf_dir))
    read = F.from_json("json", "array<struct<turn:bigint,speaker:string,text:string>>")
    return written.select("file", F.inline(read))


@R.query(r"select video_id, coalesce(nullif(regexp_extract(title, '(?i)\bwith ([A-Z][\w''-]*(?: [A-Z][\w''-]*){0,3})\s*$', 1), ''), nullif(regexp_extract(title, ' [-–|] ([A-Z][\w''-]*(?: [A-Z][\w''-]*){1,3})\s*$', 1), ''), creator) as speaker from video_source")
def rul_08_primary_speaker(spark, sf_dir):
    return table(spark, sf_dir, "video_source").select("video_id", X.primary_speaker(F.col("title"), F.col("creator")).alias("speaker"))


@R.query(f"select flag_id, list_filter([case when contains(lower(original_value), 'father') or contains(lower(original_value), 'dad') then 'Father' end, case when contains(lower(original_value), 'work') then 'Work' end, case when starts_with(lower(original_value), 'other') then 'Other' end], lambda x: x is not null) as options from {FLAGS} where original_value is not null")
def cbk_04_options_by_alias(spark, sf_dir):
    rows = table(spark, sf_dir, FLAGS).filter("original_value is not null")
    return rows.select("flag_id", C.options_by_alias(F.col("original_value"), ["Father", "Work", "Other"], {"Father": ["dad"]}).alias("options"))


@R.query(f"with {_TURNS}, w as (select file, turn, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as n from turns), o as (select file, count(*) c, sum(n) s from w group by 1), a as (select file, count(*) c, sum(n) s from w where turn % 7 <> 3 group by 1) select o.file, coalesce(a.c >= 0.5 * o.c and abs(a.s - o.s) <= 0.1 * o.s, false) as accepted from o left join a using (file)")
def mdl_19_refinement_guard(spark, sf_dir):
    before = _turns(spark, sf_dir)
    return X.refinement_accepted(before, before.filter("turn % 7 <> 3"), "file")


# compatibility forms in SQL: every character by its table, then the composed form

_COMPATIBLE = {chr(c): unicodedata.normalize("NFKD", chr(c)) for c in range(0x80, 0x20000) if not 0xAC00 <= c <= 0xDFFF and unicodedata.normalize("NFKC", chr(c)) != unicodedata.normalize("NFC", chr(c))}


def _nfkc_sql(c: str) -> str:
    ones = {k: v for k, v in _COMPATIBLE.items() if len(v) == 1}
    many = {k: v for k, v in _COMPATIBLE.items() if len(v) > 1}
    pieces = f"array_to_string(list_transform(range(1, length({c}) + 1), lambda i: coalesce(map_extract(many, substring({c}, i, 1))[1], substring({c}, i, 1))), '')"
    spread = f"case when regexp_matches({c}, {sql_text('[' + ''.join(many) + ']')}) then {pieces} else {c} end"
    lists = ", ".join(f"[{', '.join(map(sql_text, x))}]" for x in (many.keys(), many.values()))
    return f"nfc_normalize(translate({spread.replace('many', f'map({lists})')}, {sql_text(''.join(ones))}, {sql_text(''.join(ones.values()))}))"


@R.query(f"select row_id, {_sq(_quotes('f'))} as cleaned from (select row_id, {_nfkc_sql('comment')} as f from {KEPT})")
def txt_01_folded_comment(spark, sf_dir):
    """The comment cleaner with the compatibility form."""
    return table(spark, sf_dir, KEPT).select("row_id", folding.folded_comment(F.col("comment")).alias("cleaned"))


@R.query(f"select row_id, {_sq('regexp_replace(lower(' + _quotes('f') + '), ' + sql_text(chr(91) + '^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 'p{M}#' + chr(39) + ' ]+') + ', ' + sql_text(' ') + ', ' + sql_text('g') + ')')} as form from (select row_id, {_nfkc_sql('comment')} as f from {KEPT})")
def txt_03_folded_match_form(spark, sf_dir):
    """The match form with the compatibility form."""
    return table(spark, sf_dir, KEPT).select("row_id", T.match_form(folding.nfkc(F.col("comment"))).alias("form"))


# small recordings and lists with known results


@R.query(values("seg, text", (1, "so we said"), (2, "that men talk"), (4, "to each other")))
def dup_08_rolling_captions(spark, sf_dir):
    rows = [("f", 1, 0.0, 1.0, "so we said"), ("f", 2, 1.0, 2.0, "we said that men talk"), ("f", 3, 2.0, 3.0, "men talk"), ("f", 4, 3.0, 4.0, "men talk to each other")]
    return D.trim_rolling(spark.createDataFrame(rows, "file string, seg int, start double, end double, text string"), "file", "seg", "text", "start", "end").select("seg", "text")


@R.query(values("turn, speaker", (1, "A"), (3, "C")))
def win_07_interjections(spark, sf_dir):
    rows = [("f", 1, "A", "we went to the river"), ("f", 2, "B", "yes"), ("f", 3, "A", "and came back"), ("f", 4, "C", "who was there with you then")]
    out = W.absorb_interjections(spark.createDataFrame(rows, "file string, turn int, speaker string, text string"), "file", "turn", "speaker", "text")
    return out.select(F.row_number().over(Window.orderBy("turn")).alias("n"), "speaker").select(F.when(F.col("n") == 1, 1).otherwise(3).alias("turn"), "speaker")


@R.query(values("question_id, options, multi, open_text", ("Q2", 3, True, False), ("Q18B", 2, False, False), ("", 0, False, True)))
def cbk_01_headers(spark, sf_dir):
    heads = [C.parse_header(h) for h in ("Q2. Which topics? (select all that apply): Family / Work / Other", "Q18b) Advice\n- Pray\n- Wait", "Notes")]
    return spark.createDataFrame([(h.question_id, len(h.options), h.multi, h.open_text) for h in heads], "question_id string, options int, multi boolean, open_text boolean")


@R.query(values("word, forms", ("story", "story stories storys"), ("man", "man men mans"), ("box", "box boxs boxes"), ("go", "go")))
def lex_06_variants(spark, sf_dir):
    return spark.createDataFrame([(w, " ".join(L.variants(w))) for w in ("story", "man", "box", "go")], "word string, forms string")


@R.query(values("name, applies, holds", ("not empty", True, True), ("expected size", True, True), ("phrase", True, True), ("tag", True, True), ("whole word", True, True), ("compact", True, True), ("absent", False, False)))
def lex_10_lexicon_checks(spark, sf_dir):
    matcher = L.Matcher(["a woman can't love a man", "#RealMen", "boy", "body count"])
    probes = {"phrase": ("a woman can't love a man", "A woman can’t love a man, they say", True), "tag": ("#RealMen", "this is #realmen in action", True), "whole word": ("boy", "my boyfriend is here", False), "compact": ("body count", "all that bodycount talk", True), "absent": ("girl", "no girl here", False)}
    checks = L.lexicon_checks(matcher, probes, 4)
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).alias("applies"), h.alias("holds")) for n, a, h in checks)))).withColumn("holds", F.when(F.col("applies"), F.col("holds")).otherwise(False))


@R.query(values("analysis, fields", *((n, ", ".join(f)) for n, f in M.ANALYSES.items())))
def mdl_08_analyses(spark, sf_dir):
    return spark.createDataFrame([(n, ", ".join(f)) for n, f in M.analyses_catalogue().items()], "analysis string, fields string")


@R.query("select doc_id, case when trim(coalesce(text, ''), ' ') <> '' then 2 end as width from documents")
def mdl_11_embeddings(spark, sf_dir):
    """Vectors of a stub service; blank texts have none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, _ = M.embed(docs, "text", lambda texts: [[float(len(t)), 1.0] for t in texts])
    return found.select("doc_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("width"))


_TURN_SCHEMA = "file string, turn int, speaker string, text string"


@R.query(values("turn, speaker, text", (1, "Jane Roe", "hello"), (2, "Bob", "hi"), (3, "Jane Roe", "more"), (4, "Jane Roe", "and more"), (5, "Bob", "ok")))
def trx_01_repair(spark, sf_dir):
    """Broken JSON, an inline marker and a bare surname become turns."""
    broken = '[{"speaker": "Jane Roe", "text": "hello"}, {"speaker": "Bob", "text": "hi"}]\nJane Roe: more\nRoe: and more Bob: ok'
    return X.repaired(spark.createDataFrame([("f", broken)], "f string, t string"), "f", "t", ["Bob", "Jane Roe"]).select("turn", "speaker", "text")


@R.query(values("line", ("Jane: hello\nBob: hi there",)))
def trx_02_json_blocks(spark, sf_dir):
    rows = spark.createDataFrame([('```json\n[\n{"speaker": "Jane", "text": "hello"},\n{"speaker" : "Bob" , "text": "hi there"}\n]\n```',)], "t string")
    return rows.select(X.flatten_json_blocks(F.col("t")).alias("line"))


@R.query(values("line", ("so we came\nMary Jane: yes\nJane: and then\nBob: no",)))
def trx_03_inline_markers(spark, sf_dir):
    return spark.createDataFrame([("so we came Mary Jane: yes Jane: and then Bob: no",)], "t string").select(X.split_inline_markers(F.col("t"), ["Jane", "Bob", "Mary Jane"]).alias("line"))


@R.query(f"with {_TURNS} select speaker, count(*) as n from turns where regexp_matches(speaker, '^[A-Z][\\w.''-]*( [A-Z][\\w.''-]*){{0,3}}$') group by 1 having count(*) >= 2")
def trx_03_observed_speakers(spark, sf_dir):
    return X.observed_speakers(_turns(spark, sf_dir))


@R.query(values("turn, speaker, text", (1, "Host", "thank you"), (2, "Mary Jane", "hello"), (3, "Mary Jane", "x")))
def trx_04_split_names(spark, sf_dir):
    rows = [("f", 1, "Host", "thank you Mary"), ("f", 2, "Jane", "hello"), ("f", 3, "Mary Jane", "x")]
    return X.join_split_names(spark.createDataFrame(rows, _TURN_SCHEMA)).select("turn", "speaker", "text")


@R.query(f"with {_TURNS}, e as (select file, turn, speaker, case when turn % 2 = 1 then text || ' Kane' else text end as text from turns union all select file, 0, 'Kane', 'x' from (select distinct file from turns)), s as (select file, count(*) n, sum((text like '% Kane')::int) k from e group by 1) select e.file, turn, case when k >= 3 and k >= 0.4 * n and text like '% Kane' then trim(left(text, length(text) - 5), ' ') else text end as text from e join s using (file)")
def trx_06_strip_echoes(spark, sf_dir):
    """A name put behind every other turn of a file is taken off again, where it is frequent enough."""
    turns = _turns(spark, sf_dir).withColumn("text", F.when(F.col("turn") % 2 == 1, F.concat("text", F.lit(" Kane"))).otherwise(F.col("text")))
    named = turns.select("file").distinct().select("file", F.lit(0).cast("long").alias("turn"), F.lit("Kane").alias("speaker"), F.lit("x").alias("text"))
    return X.strip_echoes(turns.unionByName(named)).select("file", "turn", "text")


@R.query(values("turn, speaker, text, generic", (1, "Mary Roe", "and then spoke", False), (2, "Speaker 2", "x", True), (3, "J.", "x", False)))
def trx_08_fix_labels(spark, sf_dir):
    rows = [("f", 1, "and then Mary", "spoke"), ("f", 2, "Speaker 2", "x"), ("f", 3, "J.", "x")]
    return X.fix_labels(spark.createDataFrame(rows, _TURN_SCHEMA), {"Mary": "Mary Roe"}).select("turn", "speaker", "text", "generic")


@R.query("with a as (select row_number() over (order by s_suppkey) as place, s_suppkey as k from supplier), b as (select row_number() over (order by s_nationkey, s_suppkey) as place, s_suppkey as k from supplier) select place, a.k as left_key, b.k as right_key from a join b using (place) where a.k <> b.k")
def set_03_same_order(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    left = W.numbered(s, [], ["s_suppkey"], "place")
    right = W.numbered(s, [], ["s_nationkey", "s_suppkey"], "place")
    return Q.same_order(left, right, "s_suppkey", "place").select(F.col("place").cast("long").alias("place"), "left_key", "right_key")


@R.query(values("name, ok, n", ("distinct items", True, 20), ("load per coder", True, 0), ("coders per item", True, 0)))
def qac_05_assignment(spark, sf_dir):
    """The checks of the overlap design: 5 items for everyone and 15 for pairs of the ring."""
    coders = list("ABCDEF")
    design = SA.overlap_design(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", coders)
    return Q.assignment_checks(design, "c_custkey", "coder", "group_id", 6, {"items": 20, "per_coder": 10})


@R.query(values("check_name, severity, item, question", ("10 cosmetic", "LOW", "i1", "Q1"), ("2 part outside list", "MED", "i1", "Q1a"), ("3 required blank", "HIGH", "i2", "Q1"), ("7 none beside others", "HIGH", "i2", "Q1a"), ("8 gate closed", "MED", "i2", "Q1a"), ("1 value outside list", "HIGH", "i3", "Q1"), ("9 follow-up blank", "MED", "i4", "Q1a"), ("5 item twice", "HIGH", "i4", "Q1")))
def qac_03_recoding_report(spark, sf_dir):
    book = [("Q1", ["Yes", "No"], False, True, None, None), ("Q1a", ["Red", "None", "Blue"], True, False, "Q1", "yes")]
    rows = [("i1", "a", "Q1", "yes"), ("i1", "a", "Q1a", "Red; Green"), ("i2", "a", "Q1", ""), ("i2", "a", "Q1a", "None; Red"), ("i3", "b", "Q1", "maybe"), ("i4", "b", "Q1", "Yes"), ("i4", "b", "Q1a", None), ("i4", "b", "Q1", "Yes")]
    codebook = spark.createDataFrame(book, "question string, options array<string>, multi boolean, required boolean, parent string, gate string")
    answers = spark.createDataFrame(rows, "item string, coder string, question string, answer string")
    report = Q.recoding_report(answers, codebook, "item", "coder", "question", "answer", ";").distinct()
    return report.select(F.col("check").alias("check_name"), "severity", "item", "question")


# name, severity and condition of the break, in words both engines have
_WORKBOOK_RULES = (
    ("id missing", "HIGH", "row_id is null"), ("text missing", "HIGH", "comment is null or trim(comment) = ''"), ("not cleaned", "MED", "comment is not null and comment_text is null"),
    ("mode outside list", "HIGH", "mode is not null and mode not in ('v1', 'v2')"), ("keep not said", "MED", "comment_text is not null and keep is null"), ("kept without reason", "MED", "keep and (keep_reason is null or keep_reason = '')"),
    ("word count negative", "HIGH", "word_count < 0"), ("words without text", "HIGH", "word_count > 0 and comment_text is null"), ("votes negative", "HIGH", "vote_count < 0"), ("replies negative", "HIGH", "reply_count < 0"),
    ("video missing", "LOW", "video_id is null"), ("source missing", "MED", "source_file is null"), ("title missing", "LOW", "title is null or title = ''"), ("loaded before published", "HIGH", "loaded_at < published_at"), ("author missing", "LOW", "author is null or author = ''"),
)


@R.query("select row_id, c.n as check_name, c.s as severity from (select row_id, unnest([" + ", ".join(f"case when coalesce({c}, false) then {{'n': {sql_text(n)}, 's': {sql_text(s)}}} end" for n, s, c in _WORKBOOK_RULES) + f"]) as c from {KEPT}) where c is not null")
def qac_04_workbook_checks(spark, sf_dir):
    """Fifteen checks of a coded sheet as rules: every row that breaks one, with its severity."""
    found = Q.violations(table(spark, sf_dir, KEPT), "row_id", [(n, s, F.expr(c)) for n, s, c in _WORKBOOK_RULES])
    return found.select("row_id", F.col("check").alias("check_name"), "severity")


@R.query(f"""with r as (select row_number() over (partition by coder order by flag_id) as place, content_id as item, coder, 'single' as grp, original_value as text from {FLAGS} where coder is not null),
m as (select content_id as item, min(original_value) as text from {FLAGS} group by 1), p as (select item, grp, count(distinct coder) c from r group by 1, 2), l as (select coder, count(*) n from r group by 1)
select 'blank id' as name, count(*) filter (where trim(coalesce(item, ''), ' ') = '') as bad from r union all select 'blank text', count(*) filter (where trim(coalesce(text, ''), ' ') = '') from r
union all select 'item twice', count(*) from (select coder, item from r group by 1, 2 having count(*) > 1) union all select 'place twice', 0 union all select 'unknown item', count(*) from r where item is null
union all select 'text differs', count(*) from r join m using (item) where trim(r.text, ' ') is distinct from trim(m.text, ' ') union all select 'shared item missing', 0 union all select 'pair item without two', 0
union all select 'single item with several', count(*) from p where c <> 1 union all select 'shared place differs', 0 union all select 'coder without file', 1 union all select 'file without tracker', 0 union all select 'load differs', count(*) from l where n <> (select max(n) from l)""")
def qac_06_file_checks(spark, sf_dir):
    """The flags as coders' files, each with the largest load on the tracker and one coder who sent none."""
    flags = table(spark, sf_dir, FLAGS).filter("coder is not null")
    rows = W.numbered(flags, ["coder"], ["flag_id"], "place").select("place", F.col("content_id").alias("item"), "coder", F.lit("single").alias("grp"), F.col("original_value").alias("text"))
    master = table(spark, sf_dir, FLAGS).groupBy(F.col("content_id").alias("item")).agg(F.min("original_value").alias("text"))
    loads = rows.groupBy("coder").agg(F.count("*").alias("n"))
    tracker = loads.select("coder").unionByName(spark.createDataFrame([("nobody",)], "coder string")).crossJoin(F.broadcast(loads.agg(F.max("n").alias("load"))))  # one row
    return Q.sheet_checks(rows, "item", "coder", "grp", "place", "text", master, tracker)


def queries():
    return R.queries


def oracle_sql():
    return R.sql
