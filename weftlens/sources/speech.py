"""Readers for timed text: captions, diarisation files, transcripts. Files are read as text lines with their place, and
parsed by expressions; ``lines`` is what all parsers start from: ``file, pos, line``."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlens.functions import text as T


def read_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Every line of every file below a folder; temporary office files (``~$...``) are left out."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return text_lines(raw.filter(~F.col("file").rlike(r"/~\$[^/]*$")), "file", "value")


def text_lines(df: DataFrame, file: str, text: str) -> DataFrame:
    """``file, pos, line`` of a column of whole texts."""
    return df.select(F.col(file).alias("file"), F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("pos", "line"))


_TIME = r"(\d+:\d{2}(?::\d{2})?[.,]\d{3})"


def caption_segments(lines: DataFrame) -> DataFrame:
    """``file, seg, start, end, text`` of VTT or SRT lines: a time line opens a segment, an empty line closes it."""
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    timed = F.col("line").rlike(rf"^\s*{_TIME}\s+-->\s+{_TIME}")
    marked = lines.withColumns({"is_time": timed.cast("int"), "is_blank": (F.trim("line") == "").cast("int")}).withColumns({"seg": F.sum("is_time").over(w), "blanks": F.sum("is_blank").over(w)})
    heads = marked.filter("is_time = 1").select(
        "file",
        "seg",
        F.col("blanks").alias("open_blanks"),
        F.col("pos").alias("open_pos"),
        T.seconds_of_clock(F.regexp_extract("line", _TIME, 1)).alias("start"),
        T.seconds_of_clock(F.regexp_extract("line", rf"-->\s+{_TIME}", 1)).alias("end"),
    )
    body = marked.filter("seg > 0 and is_time = 0 and is_blank = 0").join(heads, ["file", "seg"]).filter("blanks = open_blanks")
    clean = strip_caption_tags(F.col("line"))
    parts = body.filter(clean != "").groupBy("file", "seg", "start", "end").agg(F.array_sort(F.collect_list(F.struct("pos", clean.alias("t")))).alias("parts"))
    return parts.select("file", "seg", "start", "end", F.array_join(F.transform("parts", lambda p: p["t"]), " ").alias("text"))


def strip_caption_tags(c: Column) -> Column:
    """Without ``<...>`` tags, entities decoded, single spaces."""
    return T.squeeze(T.decode_entities(F.regexp_replace(c, r"<[^>]*>", "")))


def caption_lines(lines: DataFrame) -> DataFrame:
    """``file, pos, line``: every caption line once per file, where it first stood, without times, numbers and headers."""
    text = strip_caption_tags(F.col("line"))
    kept = lines.filter(~F.col("line").rlike(rf"{_TIME}\s+-->|^\s*\d+\s*$|^WEBVTT|^Kind:|^Language:|^NOTE")).select("file", "pos", text.alias("line")).filter("line <> ''")
    return kept.groupBy("file", "line").agg(F.min("pos").alias("pos")).select("file", "pos", "line")


def diarisation(lines: DataFrame) -> DataFrame:
    """``file, start, end, speaker`` of RTTM lines; speakers are numbered by when they first speak."""
    p = F.split(F.trim("line"), r"\s+")
    raw = lines.filter(F.trim("line").startswith("SPEAKER ") & (F.size(p) >= 8)).select(
        "file", F.get(p, F.lit(3)).try_cast("double").alias("start"), F.get(p, F.lit(4)).try_cast("double").alias("length"), F.get(p, F.lit(7)).alias("label")
    )
    good = raw.filter("start is not null and length > 0")
    first = good.groupBy("file", "label").agg(F.min("start").alias("first"))
    names = first.withColumn("speaker", F.concat(F.lit("Speaker "), F.row_number().over(Window.partitionBy("file").orderBy("first", "label")).cast("string"))).drop("first")
    return good.join(names, ["file", "label"]).select("file", "start", F.round(F.col("start") + F.col("length"), 3).alias("end"), "speaker")


SPEAKER_LINE = r"^(?:\[[^\]]*\] )?([A-Za-z0-9_][A-Za-z0-9_ .'-]{0,30}): (.*)$"


def turns(lines: DataFrame) -> DataFrame:
    """``file, turn, speaker, text``: a line ``Speaker: text`` opens a turn, other lines go on with it; lines before the
    first turn are the header and are left out, as are empty lines."""
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("line").rlike(SPEAKER_LINE)
    marked = lines.filter(F.trim("line") != "").withColumn("turn", F.sum(opens.cast("int")).over(w)).filter("turn > 0")
    piece = F.when(opens, F.regexp_extract("line", SPEAKER_LINE, 2)).otherwise(F.trim("line"))
    return (
        marked.select("file", "turn", "pos", F.when(opens, F.regexp_extract("line", SPEAKER_LINE, 1)).alias("speaker"), piece.alias("piece"))
        .groupBy("file", "turn")
        .agg(F.max("speaker").alias("speaker"), F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("parts"))
        .select("file", "turn", "speaker", F.array_join(F.transform("parts", lambda p: p["piece"]), " ").alias("text"))
    )


def header_lines(lines: DataFrame) -> DataFrame:
    """``file, pos, line`` before the first turn."""
    first = lines.filter(F.col("line").rlike(SPEAKER_LINE)).groupBy("file").agg(F.min("pos").alias("first_turn"))
    return lines.join(first, "file", "left").filter("(first_turn is null or pos < first_turn) and trim(line) <> ''").select("file", "pos", "line")


def loose_json_turns(text: str) -> list[tuple[str, str]]:
    """Turns from JSON that may be cut off or broken: whole objects are read as JSON, of others the two fields by pattern."""
    found: list[tuple[str, str]] = []
    for piece in re.findall(r"\{[^{}]*\}?", text):
        try:
            item = json.loads(piece)
            speaker, said = item.get("speaker"), item.get("text")
        except (ValueError, AttributeError):
            s, t = re.search(r'"?speaker"?\s*:\s*"([^"]*)"', piece), re.search(r'"?text"?\s*:\s*"((?:[^"\\]|\\.)*)', piece)
            speaker, said = s and s.group(1), t and t.group(1).replace('\\"', '"')
        if speaker and said and said.strip():
            found.append((speaker.strip(), " ".join(said.split())))
    return found


def json_turns(df: DataFrame, file: str, text: str) -> DataFrame:
    """``file, turn, speaker, text`` of transcripts stored as (possibly broken) JSON; one text per call, no state between."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(f, i, s, t) for f, body in zip(frame["file"], frame["text"]) if body for i, (s, t) in enumerate(loose_json_turns(body), 1)]
            yield pd.DataFrame(rows, columns=["file", "turn", "speaker", "text"])

    return df.select(F.col(file).cast("string").alias("file"), F.col(text).alias("text")).mapInPandas(run, "file string, turn int, speaker string, text string")


def transcript_text(t: DataFrame) -> DataFrame:
    """``file, text``: turns as ``Speaker: text`` paragraphs."""
    line = F.concat(F.col("speaker"), F.lit(": "), F.col("text"))
    return t.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("p")).select("file", F.array_join(F.transform("p", lambda x: x["l"]), "\n\n").alias("text"))


def transcript_json(t: DataFrame) -> DataFrame:
    """``file, json``: turns in order as a list of objects."""
    turn = F.struct("turn", "speaker", "text")
    return t.groupBy("file").agg(F.to_json(F.array_sort(F.collect_list(turn))).alias("json"))


def transcript_csv(t: DataFrame) -> DataFrame:
    """``file, csv``: a header and one line per turn, text in double quotes."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("turn").cast("string"), quoted("speaker"), quoted("text"))
    return t.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("p")).select("file", F.concat(F.lit("turn,speaker,text\n"), F.array_join(F.transform("p", lambda x: x["l"]), "\n")).alias("csv"))


def segment_lines(df: DataFrame, start: str, end: str, text: str) -> Column:
    """``[00:00:01.000 --> 00:00:02.500] text``."""
    return F.format_string("[%s --> %s] %s", T.clock_of_seconds(F.col(start)), T.clock_of_seconds(F.col(end)), F.col(text))
