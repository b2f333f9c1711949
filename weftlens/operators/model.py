"""The boundary to models: packed batches, a cache by content key, retries, and what is done with replies.

A backend is a function ``list[str] -> list[dict | None]``; services stay outside, tests use a stub.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlens.functions import text as T
from weftlens.runtime import ship_package

Backend = Callable[[list[str]], list[dict | None]]


def extract_json(c: Column) -> Column:
    """The JSON object within fenced or chatty text; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def normal_reply(reply: Column, lists: Sequence[str], scales: Mapping[str, tuple[int, int]], defaults: Mapping[str, str]) -> dict[str, Column]:
    """Columns from a JSON reply: lists (a scalar becomes a list of one), clamped whole numbers, texts with defaults."""
    out: dict[str, Column] = {}
    for n in lists:
        value = F.get_json_object(reply, f"$.{n}")
        parsed = F.from_json(value, "array<string>")
        out[n] = F.when(value.startswith("["), F.coalesce(parsed, F.array().cast("array<string>"))).when(value.isNotNull() & (value != ""), F.array(value)).otherwise(F.array().cast("array<string>"))
    for n, (low, high) in scales.items():
        out[n] = F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.get_json_object(reply, f"$.{n}").try_cast("int"), F.lit(low))))
    for n, default in defaults.items():
        out[n] = F.coalesce(F.nullif(F.trim(F.get_json_object(reply, f"$.{n}")), F.lit("")), F.lit(default))
    return out


def match_replies(ids: Sequence[int], replies: Sequence[dict | None]) -> list[str | None]:
    """Replies by their ``id`` (number or text); where ids are missing or wrong, by place; what is left is None."""
    by_id = {}
    for r in replies:
        if isinstance(r, dict) and str(r.get("id", "")).strip().isdigit():
            by_id[int(str(r["id"]).strip())] = r
    out = []
    for place, i in enumerate(ids):
        found = by_id.get(i)
        if found is None and place < len(replies) and isinstance(replies[place], dict) and "id" not in replies[place]:
            found = replies[place]
        out.append(None if found is None else json.dumps({k: v for k, v in found.items() if k != "id"}, sort_keys=True))
    return out


def with_retry(call: Callable[[], list[dict | None]], attempts: int = 3, wait: float = 0.5, pause: Callable[[float], None] = time.sleep) -> list[dict | None] | None:
    """The call's result; None after so many failures. Waits double; a service that says how long to wait (an error with
    ``retry_after`` seconds, as rate limits have) is given at least that."""
    for attempt in range(attempts):
        try:
            return call()
        except Exception as error:  # a service may fail in any way; the row then has no reply
            if attempt + 1 < attempts:
                pause(max(wait * 2**attempt, float(getattr(error, "retry_after", None) or 0.0)))
    return None


def run_model(df: DataFrame, key: str, text: str, namespace: str, backend: Backend, cache: DataFrame | None = None, rows_per_call: int = 12, attempts: int = 3, wait: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Replies for every row, and the fresh cache rows ``cache_key, reply``.

    Equal texts are asked once; texts in the cache not at all; blank texts have no reply. Rows are packed into calls
    within a partition; a call that fails for good gives null replies, which are not cached and so asked again.
    """
    ship_package(df.sparkSession)
    keyed = df.withColumn("cache_key", F.when(F.trim(F.coalesce(text, F.lit(""))) != "", T.content_key(F.col(text), namespace)))
    pending = keyed.filter("cache_key is not null").groupBy("cache_key").agg(F.first(text).alias("t"))
    if cache is not None:
        pending = pending.join(cache.filter("reply is not null").select("cache_key"), "cache_key", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for begin in range(0, len(frame), rows_per_call):
                part = frame.iloc[begin : begin + rows_per_call]
                texts = part["t"].tolist()
                replies = with_retry(lambda: backend(texts), attempts, wait)
                matched = match_replies(range(1, len(texts) + 1), replies or [])
                yield pd.DataFrame({"cache_key": part["cache_key"].tolist(), "reply": matched})

    fresh = pending.mapInPandas(run, "cache_key string, reply string")
    known = fresh if cache is None else fresh.unionByName(cache.select("cache_key", "reply"))
    return keyed.join(known.filter("reply is not null"), "cache_key", "left").drop("cache_key"), fresh.filter("reply is not null")


# The analyses and the fields of their replies, which results are read and written by.
ANALYSES = {
    "themes": ("themes",), "sentiment": ("sentiment", "intensity"), "emotion": ("emotions",), "ner": ("entities",), "hate_speech": ("hate_speech", "target_group", "severity"), "toxicity": ("toxicity", "categories"),
    "misogyny": ("misogyny", "intensity"), "moral_foundations": ("foundations",), "stance": ("stance", "confidence"), "framing": ("frame", "stance_implied"), "argument_mining": ("claim", "reasoning_type", "justification"),
}


def analyses_catalogue() -> dict[str, tuple[str, ...]]:
    """The analyses a reply may hold, and their fields."""
    return dict(ANALYSES)


def embed(df: DataFrame, text: str, backend: Callable[[list[str]], list[list[float]] | None], cache: DataFrame | None = None, namespace: str = "embedding", rows_per_call: int = 96, most_chars: int = 8000, attempts: int = 3, wait: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Adds ``embedding``, and gives the fresh cache rows ``cache_key, embedding``.

    Equal texts are embedded once, texts in the cache not at all, blank ones have no vector. A service takes no more than
    ``most_chars`` characters of a text; the key is that of the whole text. Calls that fail for good leave nulls, which
    aren't cached.
    """
    ship_package(df.sparkSession)
    keyed = df.withColumn("cache_key", F.when(F.trim(F.coalesce(text, F.lit(""))) != "", T.content_key(F.col(text), namespace)))
    pending = keyed.filter("cache_key is not null").groupBy("cache_key").agg(F.first(text).alias("t"))
    if cache is not None:
        pending = pending.join(cache.filter("embedding is not null").select("cache_key"), "cache_key", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for begin in range(0, len(frame), rows_per_call):
                part = frame.iloc[begin : begin + rows_per_call]
                texts = [t[:most_chars] for t in part["t"]]
                vectors = with_retry(lambda: backend(texts), attempts, wait) or [None] * len(texts)
                yield pd.DataFrame({"cache_key": part["cache_key"].tolist(), "embedding": vectors})

    fresh = pending.mapInPandas(run, "cache_key string, embedding array<double>").filter("embedding is not null")
    known = fresh if cache is None else fresh.unionByName(cache.select("cache_key", F.col("embedding").cast("array<double>").alias("embedding")))
    return keyed.join(known, "cache_key", "left").drop("cache_key"), fresh


def reply_schema(fields: Mapping[str, Sequence[str]]) -> dict:
    """A strict JSON schema: closed fields, each one of its options."""
    return {"type": "object", "additionalProperties": False, "required": list(fields), "properties": {n: {"type": "string", "enum": list(o)} for n, o in fields.items()}}


def cosine_to_anchors(df: DataFrame, vector: str, anchors: DataFrame, anchor_id: str, anchor_vector: str, block: int = 4096) -> DataFrame:
    """Adds ``anchor`` and ``similarity``: the anchor of largest cosine (ties: the smallest id).

    Each Arrow batch is multiplied by a broadcast block of at most ``block`` anchors; more anchors are more blocks, each
    improving on the best so far within the same pass over the rows. A zero, null or shorter vector has similarity 0.
    """
    spark = df.sparkSession
    ship_package(spark)
    kind = dict(anchors.dtypes)[anchor_id]
    out = df.withColumns({"anchor": F.lit(None).cast(kind), "similarity": F.lit(None).cast("double")})
    held: list = []

    def improve(rows: DataFrame, ids: list, unit: np.ndarray) -> DataFrame:
        shared, width = spark.sparkContext.broadcast((ids, unit)), unit.shape[1]
        at = rows.columns.index(vector)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_ids, matrix = shared.value
            for batch in batches:
                x = np.zeros((batch.num_rows, width))
                for i, v in enumerate(batch.column(at).to_pylist()):
                    if v:
                        part = np.array([y or 0.0 for y in v[:width]])
                        size = np.linalg.norm([y or 0.0 for y in v])
                        x[i, : part.size] = part / size if size else 0.0
                found = np.round(x @ matrix.T, 12)
                best = found.argmax(1) if batch.num_rows else np.zeros(0, int)
                old_id, old = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
                ids_now, now = [], []
                for i, k in enumerate(best):
                    better = old[i] is None or found[i, k] > old[i]
                    ids_now.append(own_ids[k] if better else old_id[i])
                    now.append(float(found[i, k]) if better else old[i])
                schema = batch.schema
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(ids_now, schema.field(schema.names.index("anchor")).type), pa.array(now, pa.float64())], names=schema.names)

        return rows.mapInArrow(run, rows.schema)

    def unit_rows(vectors: list) -> np.ndarray:
        width = max((len(v) for v in vectors), default=0)
        x = np.zeros((len(vectors), max(1, width)))
        for i, v in enumerate(vectors):
            x[i, : len(v)] = v
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    for row in anchors.select(anchor_id, anchor_vector).filter(F.col(anchor_vector).isNotNull()).orderBy(anchor_id).toLocalIterator():
        held.append(tuple(row))
        if len(held) == block:
            out, held = improve(out, [i for i, _ in held], unit_rows([v for _, v in held])), []
    return improve(out, [i for i, _ in held], unit_rows([v for _, v in held])) if held else out


def composite(parts: Sequence[tuple[Column, float]]) -> Column:
    """A weighted sum; missing parts count as 0."""
    return sum((F.coalesce(c.cast("double"), F.lit(0.0)) * w for c, w in parts), F.lit(0.0))


def topic_clusters(df: DataFrame, key: str, vector: str, dimensions: int = 5, seed: int = 42, least_rows: int = 10) -> DataFrame:
    """``key, cluster``: vectors reduced by PCA and split by bisecting k-means with n / (2 least) clusters (about sqrt(n) of
    a large table) of at least least = max(5, sqrt(n)/2) rows; smaller clusters and tiny tables are noise (-1)."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    n = df.count()
    if n < least_rows:
        return df.select(key, F.lit(-1).alias("cluster"))
    rows = df.select(key, array_to_vector(F.col(vector)).alias("v"))
    width = len(df.select(vector).first()[0])
    small = PCA(k=min(dimensions, width), inputCol="v", outputCol="p").fit(rows).transform(rows)
    least = max(5, int(n**0.5 / 2))
    found = BisectingKMeans(k=max(2, n // (2 * least)), seed=seed, featuresCol="p", predictionCol="c", minDivisibleClusterSize=float(2 * least)).fit(small).transform(small)
    sizes = found.groupBy("c").agg(F.count("*").alias("size"))
    return found.join(F.broadcast(sizes), "c").select(key, F.when(F.col("size") >= least, F.col("c")).otherwise(-1).alias("cluster"))  # one row per cluster, about sqrt(n)


def speaker_clusters(df: DataFrame, file: str, segment: str, vector: str, speakers: int = 2, rounds: int = 20) -> DataFrame:
    """``file, segment, speaker``: the segments of each recording in two (or more) clusters by cosine.

    Starts from the segments farthest apart, so that the result is the same on every run; speakers are numbered by first
    segment. A recording's segments (some thousand) are clustered by one task.
    """
    kinds = dict(df.dtypes)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(segment, kind="stable")
        x = np.array(frame[vector].tolist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        centres = [x[0]]
        while len(centres) < min(speakers, len(x)):
            centres.append(x[np.argmin(np.max(x @ np.array(centres).T, axis=1))])
        c = np.array(centres)
        own = np.zeros(len(x), int)
        for _ in range(rounds):
            own = np.argmax(x @ c.T, axis=1)
            fresh = np.array([x[own == k].sum(0) if (own == k).any() else c[k] for k in range(len(c))])
            fresh /= np.maximum(np.linalg.norm(fresh, axis=1, keepdims=True), 1e-12)
            if np.allclose(fresh, c):
                break
            c = fresh
        order = list(dict.fromkeys(own.tolist()))
        return pd.DataFrame({file: key[0], segment: frame[segment].tolist(), "speaker": [f"Speaker {order.index(k) + 1}" for k in own]})

    return df.select(file, segment, vector).groupBy(file).applyInPandas(run, f"{file} {kinds[file]}, {segment} {kinds[segment]}, speaker string")


def translated(df: DataFrame, text: str, english: Column, cache: DataFrame, namespace: str = "en") -> DataFrame:
    """``translation``: the text itself if it is English, else the cached translation, else the text."""
    keyed = df.withColumn("cache_key", T.content_key(F.col(text), namespace)).join(cache.select("cache_key", F.col("reply").alias("tr")), "cache_key", "left")
    return keyed.withColumn("translation", F.when(english, F.col(text)).otherwise(F.coalesce("tr", text))).drop("cache_key", "tr")


def retry_pending(df: DataFrame, verdicts: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Rows without a verdict, or with one that is an error."""
    return df.join(verdicts.filter(~F.coalesce(F.col(status), F.lit("ERROR")).isin("ERROR", "")).select(key), key, "left_anti")


def accept_and_critique(df: DataFrame, accept: DataFrame, critique: DataFrame, audit: DataFrame, key: str) -> DataFrame:
    """Rows both passes took, without those an audit named regressive with medium or high confidence."""
    took = lambda v, n: v.filter(F.col("verdict")).select(key)
    out = df.join(took(accept, "a"), key, "left_semi").join(took(critique, "c"), key, "left_semi")
    bad = audit.filter((F.lower("label") == "regressive") & F.lower("confidence").isin("medium", "high")).select(key)
    return out.join(bad, key, "left_anti")


def consensus(verdicts: DataFrame, key: str, passes: int, need: int) -> DataFrame:
    """``key, votes, keep`` over the verdicts of several passes; a missing verdict is no vote."""
    return verdicts.groupBy(key).agg(F.sum(F.coalesce(F.col("verdict"), F.lit(False)).cast("int")).alias("votes")).withColumn("keep", F.col("votes") >= need)


def stub_backend(texts: list[str]) -> list[dict | None]:
    """A backend for tests: length and first word, with ids."""
    return [{"id": i, "words": len(t.split()), "first": (re.findall(r"\w+", t) or [""])[0].lower()} for i, t in enumerate(texts, 1)]
