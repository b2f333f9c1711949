"""The reading level of each document (problem 9).

A Rasch-style model of occurrences: in a document of level t, the rate of word w is proportional to
exp(a_w + b_w t), where b_w is the word's difficulty. As in a Rasch model, levels and difficulties are on one scale and
meet only in their product, so that a document's level depends on its words through one sum, and a word's difficulty on
its documents through one sum per level. Documents judged by hand hold the scale: their levels are fixed at -1, 0 and 1.

Estimation alternates over the cluster: given levels, difficulties follow from counts of words by level (each partition
counts, the counts are added up); given difficulties, every document's level is the best on a grid. Words are hashed
into a fixed number of slots, so that both tables have a fixed size whatever the corpus. Documents without a label take
part with the level they were given in the round before, which carries the scale to words no judged document holds.
The level handed out is the scale cut at two points, those that part the judged documents best.

Defined cases: null, empty and blank documents, and those without a word, have no level; a text without a known word has
the middle of the scale. Difficulties are fitted on documents wholly in English of at least ``least_tokens`` tokens, and
``rate_documents`` rates these; ``rate_all_documents`` rates every document with words and says of each whether it is
wholly English and how many tokens it has. Other languages are put on the English scale, which isn't theirs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlens.llm.language import LanguageModel, segment_batch
from weftlens.runtime import cut_lineage, ship_package, spread

SLOTS = 1 << 15
#: Levels a document may have while difficulties are estimated.
GRID = np.linspace(-1.5, 1.5, 13)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Speaker labels, times and list marks at the start of a line; they aren't the author's words.
_FRAME = re.compile(r"^[ \t]*(?:[>*•#–—-]+[ \t]*|\d{1,3}[.)][ \t]+|\[[^\]\n]{0,12}\][ \t]*)*(?:[^\W_][\w .'’-]{0,24}:[ \t]+)?", re.M)


def bare_text(text: str) -> str:
    """The text without speaker labels, times and list marks."""
    return _FRAME.sub("", text)


def word_slots(text: str) -> list[int]:
    return [xxhash.xxh32_intdigest(w) & (SLOTS - 1) for w in _WORD.findall(text.lower())]


@dataclass
class ReadingModel:
    """``a`` and ``b`` by slot; ``norm``: log of the summed rates at each grid level; ``cuts``: where levels 2 and 3 begin."""

    a: np.ndarray
    b: np.ndarray
    norm: np.ndarray = field(default_factory=lambda: np.zeros(GRID.size))
    cuts: tuple[float, float] = (-0.5, 0.5)

    def scale(self, total: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Levels of documents from their summed difficulties and sizes: the best grid point, refined by a parabola."""
        fit = total[:, None] * GRID - size[:, None] * self.norm
        best = np.clip(fit.argmax(1), 1, GRID.size - 2)
        i = np.arange(best.size)
        left, mid, right = fit[i, best - 1], fit[i, best], fit[i, best + 1]
        bend = left - 2 * mid + right
        shift = np.where(np.abs(bend) > 1e-9, (left - right) / (2 * np.where(bend == 0, 1, bend)), 0.0)
        return np.clip(GRID[best] + np.clip(shift, -1, 1) * (GRID[1] - GRID[0]), GRID[0], GRID[-1])

    def levels(self, scale: np.ndarray) -> np.ndarray:
        return 1 + (scale >= self.cuts[0]).astype(int) + (scale >= self.cuts[1]).astype(int)


def fit_words(counts: np.ndarray, levels: np.ndarray, rounds: int = 12, prior: float = 0.5, ridge: float = 1.0) -> ReadingModel:
    """Difficulties from counts (slot x level): Newton steps on the Poisson form of the model, by slot, with a ridge on b."""
    exposure = counts.sum(0)
    seen = exposure > 0
    counts, levels, exposure = counts[:, seen], levels[seen], exposure[seen]
    mass = counts.sum(1)
    a = np.log((mass + prior) / (exposure.sum() + prior * SLOTS))
    b = np.zeros(SLOTS)
    for _ in range(rounds):
        rate = np.exp(a[:, None] + b[:, None] * levels)
        expected = rate * (exposure / rate.sum(0))
        gap_b = ((counts - expected) * levels).sum(1) - ridge * b
        bend_b = (expected * levels**2).sum(1) + ridge
        b += np.clip(gap_b / bend_b, -1, 1)
        np.clip(b, -6, 6, out=b)
        rate = np.exp(a[:, None] + b[:, None] * levels)
        expected = rate * (exposure / rate.sum(0))
        a += np.clip(np.log((mass + prior) / (expected.sum(1) + prior)), -1, 1)
    model = ReadingModel(a, b)
    model.norm = np.log(np.exp(a[:, None] + b[:, None] * GRID).sum(0))
    return model


def _totals(model: ReadingModel, slots: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter((len(s) for s in slots), np.int64, len(slots))
    flat = np.fromiter((x for s in slots for x in s), np.int64, int(size.sum()))
    return np.bincount(np.repeat(np.arange(len(slots)), size), model.b[flat], len(slots)), size.astype(float)


def _counts(slots: Sequence[Sequence[int]], columns: Sequence[int], width: int) -> np.ndarray:
    found = np.zeros((SLOTS, width))
    for own, column in zip(slots, columns):
        np.add.at(found[:, column], own, 1)
    return found


def place_cuts(scale: np.ndarray, judged: np.ndarray) -> tuple[float, float]:
    """The two points that part the judged levels with the fewest errors, in the middle of the gap they fall in."""
    cuts = []
    for level in (2, 3):
        order = np.sort(scale)
        points = np.concatenate(([order[0] - 0.1], (order[1:] + order[:-1]) / 2, [order[-1] + 0.1]))
        errors = np.array([((scale >= p) != (judged >= level)).sum() for p in points])
        best = points[errors == errors.min()]
        gaps = [min(np.append(np.abs(scale - p), 1e9)) for p in best]
        cuts.append(float(best[int(np.argmax(gaps))]))
    return cuts[0], max(cuts)


def document_words(df: DataFrame, id_col: str, text_col: str, languages: LanguageModel, least_tokens: int = 1, only_english: bool = False) -> DataFrame:
    """``doc_id, slots, english, tokens`` of the documents with words and at least ``least_tokens`` tokens between white space."""
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kept = [(i, bare_text(t), n) for i, t in zip(ids, texts) if t and (n := len(t.split())) >= least_tokens]
            found = segment_batch(model, [t for _, t, _ in kept])
            english = [bool(s) and all(x[0] == "en" or x[2] < 3 for x in s) and any(x[0] == "en" for x in s) for s in found]
            rows = [(i, slots, e, n) for (i, t, n), e in zip(kept, english) if (e or not only_english) and (slots := word_slots(t))]
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "slots", "english", "tokens"])

    return spread(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).filter("t is not null")).mapInArrow(run, "doc_id long, slots array<int>, english boolean, tokens int")


def english_words(df: DataFrame, id_col: str, text_col: str, languages: LanguageModel, least_tokens: int = 60) -> DataFrame:
    """``doc_id, slots`` of the documents wholly in English that have at least ``least_tokens`` tokens between white space."""
    return document_words(df, id_col, text_col, languages, least_tokens, only_english=True).select("doc_id", "slots")


def fit_reading(judged: Sequence[tuple[str, int]], corpus: DataFrame | None = None, rounds: int = 2, label_weight: float = 20.0, most_samples: int = 20_000) -> ReadingModel:
    """Fit on ``(text, level)`` and, in turn with it, on the unjudged ``corpus`` (``doc_id, slots``).

    At most ``most_samples`` judged texts are read. The corpus is counted whole: per round one table of slot x grid
    level comes to the driver, of at most SLOTS x 13 rows.
    """
    judged = [(t, int(l)) for t, l in judged if t and l][:most_samples]
    slots = [word_slots(bare_text(t)) for t, _ in judged]
    truth = np.array([l for _, l in judged])
    anchors = np.array([-1.0, 0.0, 1.0])
    own = _counts(slots, truth - 1, 3)
    model = fit_words(own, anchors)
    for _ in range(rounds if corpus is not None else 0):
        grid = _corpus_counts(corpus, model)
        model = fit_words(np.concatenate([own * label_weight, grid], 1), np.concatenate([anchors, GRID]))
    model.cuts = place_cuts(model.scale(*_totals(model, slots)), truth)
    return model


def _corpus_counts(corpus: DataFrame, model: ReadingModel) -> np.ndarray:
    shared = corpus.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = shared.value, np.zeros((SLOTS, GRID.size))
        for batch in batches:
            slots = batch.column(0).to_pylist()
            if slots:
                scale = own.scale(*_totals(own, slots))
                at = np.rint((scale - GRID[0]) / (GRID[1] - GRID[0])).astype(int)
                found += _counts(slots, at, GRID.size)
        s, g = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(g, pa.int32()), pa.array(found[s, g])], names=["slot", "grid", "n"])

    counted = corpus.select("slots").mapInArrow(run, "slot int, grid int, n double").groupBy("slot", "grid").agg(F.sum("n").alias("n")).toArrow()
    grid = np.zeros((SLOTS, GRID.size))
    grid[counted["slot"].to_numpy(), counted["grid"].to_numpy()] = counted["n"].to_numpy()
    return grid


def reading_levels(corpus: DataFrame, model: ReadingModel) -> DataFrame:
    """``doc_id, reading_scale, reading_level`` of rows of ``doc_id, slots``, and their further columns."""
    shared = corpus.sparkSession.sparkContext.broadcast(model)
    further = [c for c in corpus.columns if c not in ("doc_id", "slots")]
    kinds = dict(corpus.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if batch.num_rows:
                scale = own.scale(*_totals(own, batch.column(1).to_pylist()))
                columns = [batch.column(0), pa.array(scale), pa.array(own.levels(scale), pa.int32()), *batch.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "reading_scale", "reading_level", *further])

    return corpus.select("doc_id", "slots", *further).mapInArrow(run, ", ".join(["doc_id long, reading_scale double, reading_level int", *(f"{c} {kinds[c]}" for c in further)]))


def rate_documents(df: DataFrame, id_col: str, text_col: str, judged: Sequence[tuple[str, int]], languages: LanguageModel, least_tokens: int = 60) -> DataFrame:
    """English documents of at least ``least_tokens`` tokens: fit in turns with the judged ones, levels."""
    corpus = cut_lineage(english_words(df, id_col, text_col, languages, least_tokens))
    return reading_levels(corpus, fit_reading(judged, corpus))


def rate_all_documents(df: DataFrame, id_col: str, text_col: str, judged: Sequence[tuple[str, int]], languages: LanguageModel, least_tokens: int = 60) -> DataFrame:
    """The whole operator: ``doc_id, reading_scale, reading_level, english, tokens`` of every document with words.

    The fit is that of ``rate_documents``, so that both give a document the same level.
    """
    words = cut_lineage(document_words(df, id_col, text_col, languages))
    return reading_levels(words, fit_reading(judged, words.filter(F.col("english") & (F.col("tokens") >= least_tokens))))
