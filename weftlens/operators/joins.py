"""Joins: lookups with defaults, membership, fallbacks by containment, and intervals in time."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from weftlens.functions import text as T
from weftlens.runtime import ship_package


def with_verdicts(df: DataFrame, verdicts: DataFrame, key: str, flag: str) -> DataFrame:
    """A left join of verdicts; a missing one is false."""
    return df.join(verdicts.select(key, flag), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def with_codes(df: DataFrame, coded: DataFrame, key: str, text: str, review: str = "needs_review") -> DataFrame:
    """A left join of coded rows; rows without text or without a code are flagged for review."""
    missing = (F.trim(F.coalesce(text, F.lit(""))) == "") | F.col("code_found").isNull()
    return df.join(coded.withColumn("code_found", F.lit(1)), key, "left").withColumn(review, missing).drop("code_found")


def pass_results(first: DataFrame, second: DataFrame, third: DataFrame, key: str) -> DataFrame:
    """Rows both first passes have, with the third where it exists."""
    return first.join(second, key, "inner").join(third, key, "left")


def cached_results(df: DataFrame, cache: DataFrame, text: str, namespace: str, result: str) -> DataFrame:
    """Results by content key; ``cache`` has ``cache_key`` and ``result``."""
    return df.withColumn("cache_key", T.content_key(F.col(text), namespace)).join(cache.select("cache_key", result), "cache_key", "left")


def id_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many ids are in both, only left, only right."""
    side = lambda df, n: df.select(key).distinct().withColumn(n, F.lit(1))
    where = F.when(F.col("l").isNull(), "only_right").when(F.col("r").isNull(), "only_left").otherwise("both")
    return side(left, "l").join(side(right, "r"), key, "full").groupBy(where.alias("side")).agg(F.count("*").alias("n"))


def funnel_join(stages: Sequence[tuple[str, DataFrame]], keys: Sequence[str]) -> DataFrame:
    """Counts of several stages by the same keys, side by side."""
    out = None
    for name, df in stages:
        counts = df.groupBy(*keys).agg(F.count("*").alias(name))
        out = counts if out is None else out.join(counts, list(keys), "inner")
    return out


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """A dimension's value, or the default."""
    return df.join(dim.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def contains_join(df: DataFrame, dim: DataFrame, key: str, text: str, dim_text: str, value: str, order: str, block: int = 3, out: str = "matched") -> DataFrame:
    """The value whose text equals the row's, else the first (by ``order``) whose text contains it, or is contained in it, as whole words.

    Containment is found by words in blocks: a text that contains another holds the other's first ``block`` words, so
    candidates meet by that block in an equi-join and only they are compared. Texts of fewer words meet by all of them.
    """
    left = df.withColumns({"cj_id": F.col(key), "cj_text": T.join_key(F.col(text))})
    right = dim.select(T.join_key(F.col(dim_text)).alias("cj_dim"), F.col(value).alias("cj_value"), F.col(order).alias("cj_order")).filter("cj_dim <> ''")
    exact = right.groupBy(F.col("cj_dim").alias("cj_text")).agg(F.min_by("cj_value", "cj_order").alias("cj_exact"))
    rows = left.join(exact, "cj_text", "left")
    open_rows = rows.filter("cj_exact is null and cj_text <> ''").select("cj_id", "cj_text")
    short = open_rows.select("cj_id", "cj_text", F.explode(_blocks(F.col("cj_text"), block)).alias("cj_block"))
    inner = short.join(right.withColumn("cj_block", _head(F.col("cj_dim"), block)), "cj_block").filter(_within("cj_dim", "cj_text"))
    outer = open_rows.withColumn("cj_block", _head(F.col("cj_text"), block)).join(right.select("*", F.explode(_blocks(F.col("cj_dim"), block)).alias("cj_block")), "cj_block").filter(_within("cj_text", "cj_dim"))
    near = inner.select("cj_id", "cj_value", "cj_order").unionByName(outer.select("cj_id", "cj_value", "cj_order")).groupBy("cj_id").agg(F.min_by("cj_value", "cj_order").alias("cj_near"))
    return rows.join(near, "cj_id", "left").withColumn(out, F.coalesce("cj_exact", "cj_near")).drop("cj_id", "cj_text", "cj_exact", "cj_near")


def _within(part: str, whole: str) -> Column:
    """Whether one text stands in another as whole words."""
    return F.contains(F.concat(F.lit(" "), whole, F.lit(" ")), F.concat(F.lit(" "), part, F.lit(" ")))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def _head(c: Column, n: int) -> Column:
    return F.array_join(F.slice(_words(c), 1, n), " ")


def _blocks(c: Column, n: int) -> Column:
    """Every run of one to ``n`` words: what the head of a contained text may be."""
    words = _words(c)
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))

    def runs(size: int) -> Column:
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " "))

    return F.array_distinct(F.concat(*(runs(k) for k in range(1, n + 1))))


def probe_join(items: DataFrame, turns: DataFrame, item_text: str, turn_file: str, turn_order: str, turn_text: str, item_key: str, item_file: str, sizes: Sequence[int] = (80, 40)) -> DataFrame:
    """Where each item stands in its file: the first turn that contains its first 80 characters, else its first 40.

    ``item_key, probe, turn``; items and turns meet by file, never all with all. An item without text stands nowhere.
    """
    probes = items.select(F.col(item_key), F.col(item_file).alias("pj_file"), T.join_key(F.col(item_text)).alias("pj_text")).filter("pj_text <> ''")
    found = probes.join(turns.select(F.col(turn_file).alias("pj_file"), F.col(turn_order).alias("turn"), T.join_key(F.col(turn_text)).alias("pj_turn")), "pj_file")
    tier = F.lit(None).cast("int")
    for i, n in reversed(list(enumerate(sizes))):
        tier = F.when(F.contains("pj_turn", F.substring("pj_text", 1, n)), F.lit(i)).otherwise(tier)
    best = found.withColumn("pj_tier", tier).filter("pj_tier is not null").groupBy(item_key).agg(F.min(F.struct("pj_tier", "turn")).alias("best"))
    return best.select(item_key, F.element_at(F.array(*map(F.lit, sizes)), F.col("best.pj_tier") + 1).alias("probe"), F.col("best.turn").alias("turn"))


def point_in_interval(points: DataFrame, intervals: DataFrame, file: str, point_id: str, point: str, start: str, end: str, label: str, tolerance: float = 0.5, width: float = 10.0, default: str = "Unknown") -> DataFrame:
    """The label of the first interval that holds each point (both ends count), else of the nearest within ``tolerance``.

    A range join in buckets of ``width``: an interval is entered in every bucket that it or its tolerance reaches, a
    point in one, so both meet by equality. First means by start, then end, then label.
    """
    p = points.select(file, F.col(point_id).alias("pi_id"), F.col(point).alias("pi_point")).withColumn("pi_bucket", F.floor(F.col("pi_point") / width))
    i = intervals.select(file, F.col(start).alias("pi_start"), F.col(end).alias("pi_end"), F.col(label).alias("pi_label")).filter("pi_start <= pi_end")
    i = i.withColumn("pi_bucket", F.explode(F.sequence(F.floor((F.col("pi_start") - tolerance) / width), F.floor((F.col("pi_end") + tolerance) / width))))
    gap = F.greatest(F.col("pi_start") - F.col("pi_point"), F.col("pi_point") - F.col("pi_end"), F.lit(0.0))
    met = p.join(i, [file, "pi_bucket"]).withColumn("pi_gap", gap).filter(F.col("pi_gap") <= tolerance)
    best = met.groupBy(file, "pi_id").agg(F.min_by("pi_label", F.struct("pi_gap", "pi_start", "pi_end", "pi_label")).alias(label))
    return points.join(best.withColumnRenamed("pi_id", point_id), [file, point_id], "left").withColumn(label, F.coalesce(label, F.lit(default)))


def max_overlap(segments: DataFrame, intervals: DataFrame, file: str, segment_id: str, s_start: str, s_end: str, start: str, end: str, label: str, width: float = 30.0) -> DataFrame:
    """The label of the interval that overlaps each segment most (ties: the earliest), else of the nearest middle.

    Overlaps meet in buckets. Segments that overlap nothing, usually few, look for the nearest middle among all
    intervals of their own file.
    """
    s = segments.select(file, F.col(segment_id).alias("mo_id"), F.col(s_start).alias("mo_s"), F.col(s_end).alias("mo_e"))
    i = intervals.select(file, F.col(start).alias("mo_start"), F.col(end).alias("mo_end"), F.col(label).alias("mo_label"))
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    met = s.withColumn("mo_cell", cells("mo_s", "mo_e")).join(i.withColumn("mo_cell", cells("mo_start", "mo_end")), [file, "mo_cell"])
    overlap = F.least("mo_e", "mo_end") - F.greatest("mo_s", "mo_start")
    best = met.withColumn("mo_over", overlap).filter("mo_over > 0").groupBy(file, "mo_id").agg(F.min_by("mo_label", F.struct((-F.col("mo_over")).alias("o"), "mo_start", "mo_end", "mo_label")).alias("mo_best"))
    joined = s.join(best, [file, "mo_id"], "left")
    lonely = joined.filter("mo_best is null").drop("mo_best").join(i, file)
    middle = F.abs((F.col("mo_start") + F.col("mo_end")) / 2 - (F.col("mo_s") + F.col("mo_e")) / 2)
    near = lonely.groupBy(file, "mo_id").agg(F.min_by("mo_label", F.struct(middle.alias("d"), "mo_start", "mo_end", "mo_label")).alias("mo_near"))
    return joined.join(near, [file, "mo_id"], "left").select(file, F.col("mo_id").alias(segment_id), F.coalesce("mo_best", "mo_near").alias(label))


def alignment_key(c: Column) -> Column:
    """What words are compared by: small letters, digits and apostrophes. Spaces stay, so that a whole text can be read at once."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}' ]", "")


def align_by_position(words: DataFrame, tokens: DataFrame, file: str, order: str, word: str, label: str, reach: int = 80) -> DataFrame:
    """Speaker labels from a transcript for caption words: word i of N looks near place i/N of the M tokens.

    The nearest equal token within ``reach`` places gives the label (ties: the earlier); without one, the token at the
    place itself. ``words`` has ``file, order, word`` and ``tokens`` also ``label``; orders count from 0 in each file.
    """
    # both sides are grouped as one table: a join would be planned by estimates, which are far too low for words of texts
    key = F.replace(alignment_key(F.col(word)), F.lit(" "), F.lit("")).alias("ap_key")
    kind = tokens.schema[label].dataType
    said = words.select(file, F.lit(True).alias("ap_said"), F.col(order).alias("ap_at"), key, F.lit(None).cast(kind).alias("ap_label"))
    rows = said.unionByName(tokens.select(file, F.lit(False).alias("ap_said"), F.col(order).alias("ap_at"), key, F.col(label).alias("ap_label")))
    side = lambda one: F.array_sort(F.collect_list(F.when(one, F.struct("ap_at", "ap_key", "ap_label"))))
    files = rows.groupBy(file).agg(side(F.col("ap_said")).alias("said"), side(~F.col("ap_said")).alias("held"))
    turns = F.transform("held", lambda t: F.struct(t["ap_label"].alias("label"), F.array(t["ap_key"]).alias("words")))
    aligned = align_files(files.select(file, F.transform("said", lambda w: w["ap_key"]).alias("words"), turns.alias("turns")), file, order, label, reach)
    return aligned.withColumn(order, F.col(order).cast(words.schema[order].dataType))


def align_files(files: DataFrame, file: str, order: str, label: str, reach: int = 80) -> DataFrame:
    """``align_by_position`` of whole files, one row each: ``words`` are the keys of the captions in order, ``turns`` the
    transcript's in order, each with its ``label`` and the keys of its ``words``. Rows are written file by file; none is moved."""
    ship_package(files.sparkSession)
    kind = files.schema["turns"].dataType.elementType["label"].dataType
    schema = StructType([StructField(file, files.schema[file].dataType), StructField(order, LongType()), StructField(label, kind), StructField("matched", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _file_slices(batch):
                row, place, name, matched = _nearest_labels(part.column(1), part.column(2), reach)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(place), name, pa.array(matched)], names=schema.names)

    return files.filter(F.col(file).isNotNull()).select(file, "words", "turns").mapInArrow(run, schema)


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _file_slices(batch: pa.RecordBatch, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Runs of whole files with about so many words each, or one file that has more."""
    if not batch.num_rows:
        return
    per_turn = np.concatenate([[0], _lengths(pc.struct_field(pc.list_flatten(batch.column(2)), [1])).cumsum()])
    ends = per_turn[_lengths(batch.column(2)).cumsum()] + _lengths(batch.column(1)).cumsum()
    bounds = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), batch.num_rows]
    for a, b in itertools.pairwise(bounds):
        yield batch.slice(a, b - a)


def _nearest_labels(words: pa.ListArray, turns: pa.ListArray, reach: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """For every word of a file that has tokens: the file's row, the word's place, its label, whether an equal token was near."""
    flat = pc.list_flatten(turns)
    labels, said = pc.struct_field(flat, [0]), pc.struct_field(flat, [1])
    token_turn = np.repeat(np.arange(len(flat)), _lengths(said))
    token_file = np.repeat(np.arange(len(turns)), _lengths(turns))[token_turn]
    n, m = _lengths(words), np.bincount(token_file, minlength=len(turns))
    word_file = np.repeat(np.arange(len(words)), n)
    i = np.arange(word_file.size) - (n.cumsum() - n)[word_file]
    keys = pc.dictionary_encode(pc.fill_null(pa.concat_arrays([pc.list_flatten(said), pc.list_flatten(words)]), ""))
    code, empty, size = keys.indices.to_numpy().astype(np.int64), keys.dictionary.index("").as_py(), len(keys.dictionary)
    met = m[word_file] > 0
    word_file, i, word_code = word_file[met], i[met], code[token_file.size :][met]
    if not i.size:
        return word_file, i, labels.slice(0, 0), np.zeros(0, bool)
    first, width = m.cumsum() - m, int(m.max()) + 1
    spot = np.minimum(np.floor(i / n[word_file] * m[word_file]).astype(np.int64), m[word_file] - 1)
    # one number holds file, key and place: the tokens beside a place in sorted order are the nearest equal ones
    place = (token_file * size + code[: token_file.size]) * width + np.arange(token_file.size) - first[token_file]
    token = np.argsort(place)
    place, own = place[token], (word_file * size + word_code) * width
    after = np.searchsorted(place, own + spot, side="right")
    before, behind = np.maximum(after - 1, 0), np.minimum(after, place.size - 1)
    back, on = own + spot - place[before], place[behind] - own - spot
    has_back = (after > 0) & (place[before] >= own) & (back <= reach)
    has_on = (after < place.size) & (place[behind] < own + width) & (on < reach)
    matched = (has_back | has_on) & (word_code != empty)
    near = token_turn[token[np.where(has_back & (~has_on | (back <= on)), before, behind)]]
    named = labels.is_valid().to_numpy(zero_copy_only=False)
    turn = np.where(matched & named[near], near, token_turn[first[word_file] + spot])
    return word_file, i, labels.take(pa.array(turn)), matched


def iterations(df: DataFrame, key: str, n: int, done: DataFrame) -> DataFrame:
    """Every row n times, without the (row, iteration) pairs that are done."""
    return df.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(n)))).join(done.select(key, "iteration"), [key, "iteration"], "left_anti")


def verbatim_check(df: DataFrame, master: DataFrame, key: str, text: str, master_text: str) -> DataFrame:
    """Whether each row's text is exactly that of the master: ``ok``, ``differs`` or ``unknown id``."""
    known = master.select(key, F.trim(F.col(master_text)).alias("vc_master"), F.lit(1).alias("vc_known"))
    status = F.when(F.col("vc_known").isNull(), "unknown id").when(F.trim(F.col(text)).eqNullSafe(F.col("vc_master")), "ok").otherwise("differs")
    return df.join(known, key, "left").withColumn("status", status).drop("vc_master", "vc_known")


def attach(df: DataFrame, key: str, analyses: dict[str, DataFrame]) -> DataFrame:
    """Results of several analyses beside each row, columns named ``analysis__field``."""
    for name, result in analyses.items():
        df = df.join(result.select(key, *(F.col(c).alias(f"{name}__{c}") for c in result.columns if c != key)), key, "left")
    return df


def rank_within(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
