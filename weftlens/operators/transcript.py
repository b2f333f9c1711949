"""Repair of transcripts: speaker names, markers inside text, echoes, chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlens.functions import text as T


def flatten_json_blocks(c: Column) -> Column:
    """``{"speaker": "A", "text": "b"}`` within a text becomes a line ``A: b``."""
    out = F.regexp_replace(c, r'\{\s*"speaker"\s*:\s*"([^"]*)"\s*,\s*"text"\s*:\s*"([^"]*)"\s*\},?', "\n$1: $2\n")
    bare = F.regexp_replace(F.regexp_replace(out, r"(?m)```(?:json)?|^[ \t]*[\[\]][ \t]*$", ""), r"\n{2,}", "\n")
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def split_inline_markers(c: Column, names: Sequence[str]) -> Column:
    """A known name with a colon inside a text opens a new line; longer names first."""
    if not names:
        return c
    pattern = "|".join(re.escape(n) for n in sorted(set(names), key=lambda n: (-len(n), n)))
    return F.regexp_replace(c, rf"\s+({pattern}):\s+", "\n$1: ")


def observed_speakers(turns: DataFrame, least: int = 2) -> DataFrame:
    """``speaker, n`` of names that open at least so many turns and look like names."""
    return turns.filter(F.col("speaker").rlike(r"^[A-Z][\w.'-]*( [A-Z][\w.'-]*){0,3}$")).groupBy("speaker").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def join_split_names(turns: DataFrame) -> DataFrame:
    """``... said Mary`` / ``Jane: hello`` is the speaker Mary Jane: the last capitalised word of the turn before goes over,
    where that makes a name that speaks elsewhere in the file."""
    w = Window.partitionBy("file").orderBy("turn")
    last = F.regexp_extract("text", r"\b([A-Z][a-z]+)$", 1)
    full = F.concat(F.lag(last).over(w), F.lit(" "), F.col("speaker"))
    known = turns.select("file", F.col("speaker").alias("full"), F.lit(1).alias("known")).distinct()
    joined = turns.withColumn("full", F.when(F.lag(last).over(w) != "", full)).join(known, ["file", "full"], "left").withColumn("moved", F.coalesce("known", F.lit(0)))
    w2 = Window.partitionBy("file").orderBy("turn")
    cut = F.coalesce(F.lead("moved").over(w2), F.lit(0)) == 1
    return joined.select("file", "turn", F.when(F.col("moved") == 1, F.col("full")).otherwise(F.col("speaker")).alias("speaker"), F.when(cut, F.trim(F.regexp_replace("text", r"[A-Z][a-z]+$", ""))).otherwise(F.col("text")).alias("text"))


def restore_surnames(turns: DataFrame) -> DataFrame:
    """A speaker given by surname gets the full name, where the file has just one speaker of that surname."""
    surname = F.regexp_extract("speaker", r"(\S+)$", 1)
    full = turns.filter(F.col("speaker").contains(" ")).select("file", surname.alias("surname"), F.col("speaker").alias("full")).distinct()
    single = full.groupBy("file", "surname").agg(F.count("*").alias("n"), F.min("full").alias("full")).filter("n = 1").drop("n")
    return turns.join(single.withColumnRenamed("surname", "speaker"), ["file", "speaker"], "left").select("file", "turn", F.coalesce("full", "speaker").alias("speaker"), "text")


def restore_initials(turns: DataFrame, primary: Mapping[str, str]) -> DataFrame:
    """``J`` or ``J.`` is the file's primary speaker, if that name starts so."""
    out = F.col("speaker")
    if primary:
        name = F.create_map(*[F.lit(x) for kv in primary.items() for x in kv])[F.col("file")]
        out = F.when(F.col("speaker").rlike(r"^[A-Z]\.?$") & (F.substring(name, 1, 1) == F.substring("speaker", 1, 1)), name).otherwise(F.col("speaker"))
    return turns.withColumn("speaker", out)


def strip_echoes(turns: DataFrame, least: int = 3, share: float = 0.4) -> DataFrame:
    """A name that ends many turns of others (at least ``least``, and ``share`` of the file's turns) is an echo and goes."""
    names = turns.select("file", "speaker").distinct()
    ends = turns.join(names.select("file", F.col("speaker").alias("echo")), "file").filter(F.col("text").endswith(F.concat(F.lit(" "), F.col("echo"))))
    size = turns.groupBy("file").agg(F.count("*").alias("size"))
    often = ends.groupBy("file", "echo").agg(F.count("*").alias("n")).join(size, "file").filter((F.col("n") >= least) & (F.col("n") >= share * F.col("size"))).select("file", "echo")
    hit = turns.join(often, "file").filter(F.col("text").endswith(F.concat(F.lit(" "), F.col("echo")))).groupBy("file", "turn").agg(F.max_by("echo", F.length("echo")).alias("echo"))
    return turns.join(hit, ["file", "turn"], "left").select("file", "turn", "speaker", F.when(F.col("echo").isNotNull(), F.rtrim(F.expr("substring(text, 1, length(text) - length(echo))"))).otherwise(F.col("text")).alias("text"))


def sanitise(turns: DataFrame) -> DataFrame:
    """Turns without a name or text go; JSON tails and stray brackets go from texts."""
    clean = T.squeeze(F.regexp_replace(F.regexp_replace("text", r'"?\s*\}\s*\]?\s*,?\s*$', ""), r'^\s*[\[{"]+', ""))
    return turns.withColumn("text", clean).filter((F.col("text") != "") & F.col("speaker").rlike(r"^[A-Za-z][\w .'-]{0,40}$") & ~F.lower("speaker").isin("text", "speaker", "http", "https", "note"))


def fix_labels(turns: DataFrame, renames: Mapping[str, str], generic: Sequence[str] = ("Speaker", "Unknown", "Guest")) -> DataFrame:
    """Renamed speakers; words that leaked into a label go back to its text; generic labels are flagged."""
    label = F.col("speaker")
    leaked = F.regexp_extract(label, r"^(.*[a-z.,!?] )([A-Z][\w'-]*)$", 1)
    bare = F.when(leaked != "", F.regexp_extract(label, r"([A-Z][\w'-]*)$", 1)).otherwise(label)
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in renames.items() for x in kv])[bare], bare) if renames else bare
    return turns.withColumns({"text": F.trim(F.concat(F.when(leaked != "", leaked).otherwise(F.lit("")), F.col("text"))), "speaker": named}).withColumn("generic", F.col("speaker").rlike("^(" + "|".join(map(re.escape, generic)) + r")( ?\d+)?$"))


def repaired(df: DataFrame, file: str, text: str, names: Sequence[str] = ()) -> DataFrame:
    """The whole repair: JSON flattened, markers split, turns read, cleaned, names restored."""
    from weftlens.sources.speech import text_lines, turns

    flat = df.select(F.col(file).alias("file"), split_inline_markers(flatten_json_blocks(F.col(text)), names).alias("text"))
    return restore_surnames(sanitise(turns(text_lines(flat, "file", "text"))))


def speaker_text(turns: DataFrame, pattern: str) -> DataFrame:
    """``file, text``: all a speaker says, in order."""
    mine = turns.filter(F.col("speaker").rlike(pattern))
    return mine.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p")).select("file", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last ``n`` turns of each file."""
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("turn")))
    return turns.withColumn("lt", rank).filter(F.col("lt") <= n).drop("lt")


def label_audience(turns: DataFrame, phrases: Sequence[str], most_words: int = 6) -> DataFrame:
    """Short crowd utterances belong to the audience."""
    bare = F.trim(F.regexp_replace(F.lower("text"), r"[^a-z0-9 ]", ""))
    return turns.withColumn("speaker", F.when((T.words_by_space(F.col("text")) <= most_words) & bare.isin(list(phrases)), F.lit("Audience")).otherwise(F.col("speaker")))


def primary_speaker(title: Column, uploader: Column) -> Column:
    """The name behind the last `` with `` or `` - `` of a title, else the uploader."""
    found = F.coalesce(F.nullif(F.regexp_extract(title, r"(?i)\bwith ([A-Z][\w'-]*(?: [A-Z][\w'-]*){0,3})\s*$", 1), F.lit("")), F.nullif(F.regexp_extract(title, r" [-–|] ([A-Z][\w'-]*(?: [A-Z][\w'-]*){1,3})\s*$", 1), F.lit("")))
    return F.coalesce(found, uploader)


def word_chunks(c: Column, size: int) -> Column:
    """Fixed chunks of ``size`` words, as an array."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    n = F.ceil(F.size(words) / size).cast("int")
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i * size + 1, size), " "))


def chunk_to_sentences(words: Sequence[str], size: int = 150, more: int = 30, least: int = 50) -> list[str]:
    """Windows of ``size`` words, each drawn out by up to ``more`` words to the end of a sentence; short rests go."""
    out, at = [], 0
    while at < len(words):
        end = min(at + size, len(words))
        if end < len(words):
            end = next((i + 1 for i in range(end, min(end + more, len(words))) if re.search(r"[.!?]$", words[i])), end)
        if end - at >= least:
            out.append(" ".join(words[at:end]))
        at = end
    return out


def sentence_chunks(df: DataFrame, key: str, text: str, size: int = 150, more: int = 30, least: int = 50) -> DataFrame:
    """``key, chunk, text`` with ``chunk_to_sentences``."""
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, c) for k, t in zip(frame["k"], frame["t"]) if t for i, c in enumerate(chunk_to_sentences(t.split(), size, more, least), 1)]
            yield pd.DataFrame(rows, columns=[key, "chunk", "text"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, chunk int, text string")


def refinement_accepted(before: DataFrame, after: DataFrame, file: str) -> DataFrame:
    """``file, accepted``: a refined transcript keeps at least half the turns and its words within a tenth."""
    size = lambda df, n: df.groupBy(file).agg(F.count("*").alias(f"{n}_turns"), F.sum(T.words_by_space(F.col("text"))).alias(f"{n}_words"))
    both = size(before, "old").join(size(after, "new"), file, "left")
    ok = (F.col("new_turns") >= 0.5 * F.col("old_turns")) & (F.abs(F.col("new_words") - F.col("old_words")) <= 0.1 * F.col("old_words"))
    return both.select(file, F.coalesce(ok, F.lit(False)).alias("accepted"))
