"""The language of every document and of every stretch of a mixed one (problem 1).

Hyperdimensional profiles. Every letter has a random vector of +1 and -1; the vector of an n-gram binds its letters,
each permuted by its place (a cyclic shift per place, then the product); the vector of a word bundles (adds) its
n-grams and scales the sum to unit length; a document bundles its words, a language prototype bundles its samples.
Prototypes are then refined as usual for such profiles: windows of the samples that are taken for another language are
added to their own prototype and taken off the other one, in proportion to the error. A document is compared with the
prototypes by cosine; the document's own length cancels between languages, so a word's share in every comparison is one
inner product per prototype, and these shares are tabled per n-gram: they are the same sums, only not taken again.
N-grams that no sample holds are orthogonal to every prototype up to noise of 1/sqrt(dimensions) and are left out.

A mixed document is cut by the best path through its words, where a change of language costs ``switch_cost`` (less
behind a stop): the stretches of one language come out with a confidence, the share of that language in the
exponentials of the stretch's summed similarities.

Defined cases: null texts and texts without words give no stretch. Links, mentions, tags, addresses, digits and, in
texts of ordinary case, capitalised words within a sentence (names, places) have no language of their own; where nothing
else is left they are compared after all. Very long texts are walked whole, in time linear in their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlens.llm.visual import glyph_tables, text_slices
from weftlens.runtime import ship_package, spread

_LETTER = r"(?:[^\W\d_]|[̀-ͯ])"
#: One match per thing of interest: something without a language, a word, a stop, or a line end.
_PARTS = re.compile(
    r"(?P<none>https?://\S+|www\.\S+|[@#]\S+|\S+@\S+\.\S+|\S+\[at\]\S+|\S*\d\S*)"
    rf"|(?P<word>{_LETTER}+(?:['’ʼ-]{_LETTER}+)*)"
    r"|(?P<stop>[.!?…]+|[,;:|/=\n–—]|\s-\s|[\U0001F300-\U0001FAFF☀-➿]+)"
)
#: The same, read faster: a token with a sign that only such things have is looked at by ``_PARTS``.
_RUN = r"(?:[^\W\d_]+[̀-ͯ]*|[̀-ͯ]+)++"
_READ = re.compile(
    r"([^\s\d@#:/\[]*+[\d@#:/\[]\S*|www\.\S+)"
    rf"|({_RUN}(?:['’ʼ-]{_RUN})*)"
    r"|([.!?…]+|[,;|=\n–—]|\s-\s|[\U0001F300-\U0001FAFF☀-➿]+)"
)
_MARKS = "’ʼʹ"


@dataclass
class LanguageModel:
    """Prototypes and what is derived from them; ``share`` has, per n-gram, its similarity with each prototype."""

    langs: list[str]
    share: dict[str, np.ndarray]
    orders: tuple[int, ...]
    switch_cost: float
    stop_cost: float
    words: dict[str, np.ndarray] = field(default_factory=dict)

    def word(self, word: str) -> np.ndarray:
        """The similarities of one (lower-case) word, remembered per process."""
        known = self.words.get(word)
        if known is None:
            grams = ngrams(word, self.orders)
            total = np.zeros(len(self.langs), np.float32)
            for gram in grams:
                part = self.share.get(gram)
                if part is not None:
                    total += part
            known = total / np.float32(max(1, len(grams)) ** 0.5)
            if len(self.words) > 200_000:
                self.words.clear()
            self.words[word] = known
        return known


def ngrams(word: str, orders: Sequence[int]) -> list[str]:
    """The n-grams of a word within its borders, and the word itself."""
    bordered = f" {word} "
    found = [bordered[i : i + n] for n in orders for i in range(len(bordered) - n + 1)]
    if len(bordered) > max(orders):
        found.append(bordered)
    return found


class _Letters:
    """Random letter vectors and the n-grams bound from them."""

    def __init__(self, dimensions: int, seed: int) -> None:
        self.random = np.random.default_rng(seed)
        self.dimensions, self.letters = dimensions, {}

    def gram(self, gram: str) -> np.ndarray:
        bound = np.ones(self.dimensions, np.int8)
        for place, letter in enumerate(gram):
            if letter not in self.letters:
                self.letters[letter] = self.random.choice(np.array([-1, 1], np.int8), self.dimensions)
            bound = bound * np.roll(self.letters[letter], place)
        return bound


def fit_languages(
    samples: Sequence[tuple[str, str]],
    dimensions: int = 2048,
    orders: tuple[int, ...] = (1, 2, 3, 4),
    windows: tuple[int, ...] = (2, 4, 8, 16),
    rounds: int = 300,
    seed: int = 20,
    switch_cost: float = 6.0,
    stop_cost: float = 3.8,
    shrink: float = 3e-4,
    most_samples: int = 20_000,
    most_windows: int = 2_500,
) -> LanguageModel:
    """Fit prototypes on ``(text, language)``: at most ``most_samples`` labelled texts, and of them at most ``most_windows``
    windows a language (drawn by ``seed``), so that fitting takes the same memory whatever the samples."""
    samples = [(t, l) for t, l in samples if t and l][:most_samples]
    if not samples:
        raise ValueError("no labelled sample")
    langs = sorted({l for _, l in samples})
    letters = _Letters(dimensions, seed)
    texts = [[w.lower() for w, _, kind in parts(t) if kind == "word"] for t in glyph_tables().canonical([t for t, _ in samples])]
    grams = sorted({g for words in texts for w in set(words) for g in ngrams(w, orders)})
    index = {g: i for i, g in enumerate(grams)}
    vectors = np.empty((len(grams), dimensions), np.int8)
    for gram, i in index.items():
        vectors[i] = letters.gram(gram)
    # windows of the samples, of several lengths, at most so many a language, each language weighing the same
    places: dict[int, list[tuple[int, int, int]]] = {k: [] for k in range(len(langs))}
    for n, (words, (_, lang)) in enumerate(zip(texts, samples)):
        for size in windows:
            places[langs.index(lang)] += [(n, i, size) for i in range(0, max(1, len(words) - size + 1), max(1, size // 2))]
    chosen = []
    for k, own in places.items():
        kept = letters.random.permutation(len(own))[:most_windows]
        chosen += [(*own[i], k) for i in sorted(kept)]
    x, y = np.zeros((len(chosen), dimensions), np.float32), np.array([c[3] for c in chosen])
    cached: dict[str, np.ndarray] = {}
    for row, (n, i, size, _) in enumerate(chosen):
        for w in texts[n][i : i + size]:
            if w not in cached:
                if len(cached) >= 4_000:
                    cached.clear()
                own = [index[g] for g in ngrams(w, orders)]
                cached[w] = vectors[own].sum(0, dtype=np.float32) / (len(own) * dimensions) ** 0.5
            x[row] += cached[w]
    cached.clear()
    weight = (1.0 / np.bincount(y, minlength=len(langs)))[y]
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    truth = np.eye(len(langs), dtype=np.float32)[y]
    prototypes = (truth * weight).T @ x  # the bundle of each language's samples
    prototypes *= 1.0 / np.linalg.norm(prototypes, axis=1, keepdims=True)
    velocity = np.zeros_like(prototypes)
    for _ in range(rounds):
        scores = x @ prototypes.T
        guess = np.exp(scores - scores.max(1, keepdims=True))
        guess /= guess.sum(1, keepdims=True)
        velocity = 0.9 * velocity + ((truth - guess) * weight).T @ x - shrink * prototypes
        prototypes += 1.0 * velocity
    # cosine: prototypes of one length, which leaves comparisons to the angle alone
    length = np.linalg.norm(prototypes, axis=1)
    prototypes *= (length.mean() / length)[:, None]
    share = np.concatenate([vectors[i : i + 1000].astype(np.float32) @ prototypes.T for i in range(0, len(grams), 1000)]) / dimensions**0.5
    share -= share.mean(1, keepdims=True)
    return LanguageModel(langs, {g: share[i].copy() for g, i in index.items()}, orders, switch_cost, stop_cost)


def parts(text: str) -> Iterator[tuple[str, int, str]]:
    """The pieces of a text that matter, with their place: ``word``, ``stop`` or ``none`` (without a language)."""
    for m in _PARTS.finditer(text):
        yield m.group(), m.start(), m.lastgroup


_KINDS = {"none": 1, "word": 2, "stop": 3}
_ASCII_UPPER, _ASCII_LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]")


def _ordinary_case(text: str) -> bool:
    """Whether a text has more than three times as many small letters as capitals."""
    data = text.encode("utf-8", "surrogatepass")
    beyond = "" if len(data) == len(text) else "".join(_BEYOND_ASCII.findall(text))
    upper = len(data) - len(data.translate(None, _ASCII_UPPER)) + sum(map(str.isupper, beyond))
    return upper * 3 < len(data) - len(data.translate(None, _ASCII_LOWER)) + sum(map(str.islower, beyond))


def read_words(text: str) -> tuple[list[str], list[int], list[bool], list[bool]]:
    """Lower-case words, their places, whether each counts for language, and whether a stop is before it."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is several: letter by letter, so that places hold
        low = "".join([c if len(c.lower()) != 1 else c.lower() for c in text])
    for mark in _MARKS:
        low = low.replace(mark, "'")
    spans = []  # kind, begin, end of every word and stop
    for m in _READ.finditer(text):
        if m.lastindex == 1:
            spans += [(_KINDS[x.lastgroup], *x.span()) for x in _PARTS.finditer(text, *m.span())]
        else:
            spans.append((m.lastindex, *m.span()))
    ordinary = _ordinary_case(text)
    words, places, counts, stops = [], [], [], []
    stop = True
    for kind, begin, end in spans:
        if kind == 2:
            words.append(low[begin:end])
            places.append(begin)
            counts.append(stop or not ordinary or end - begin < 2 or not text[begin].isupper())
            stops.append(stop)
            stop = False
        elif kind == 3:
            stop = True
    if not any(counts):
        counts = [True] * len(words)
    return words, places, counts, stops


def segment_batch(model: LanguageModel, texts: Sequence[str | None]) -> list[list[tuple[str, int, int, float]]]:
    """Per text its stretches ``(language, first character, words, confidence)`` in reading order."""
    return [found for begin, end in text_slices(texts) for found in _segment_slice(model, texts[begin:end])]


def _segment_slice(model: LanguageModel, texts: Sequence[str | None]) -> list[list[tuple[str, int, int, float]]]:
    forms = glyph_tables().canonical(texts)
    n = len(model.langs)
    read = [read_words(t) if t else ([], [], [], []) for t in forms]
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    order = sorted((i for i, r in enumerate(read) if r[0]), key=lambda i: -len(read[i][0]))
    if not order:
        return out
    sizes = np.array([len(read[i][0]) for i in order])
    begin = np.concatenate(([0], np.cumsum(sizes)))
    # similarities of all words, one text after the other; each distinct word is looked up once
    known: dict[str, int] = {}
    number = known.setdefault
    at = np.array([number(w, len(known)) for i in order for w in read[i][0]], np.int64)
    counted = np.array([c for i in order for c in read[i][2]], bool)
    stopped = np.array([x for i in order for x in read[i][3]], bool)
    sims = np.array([model.word(w) for w in known], np.float32)[at]
    sims[~counted] = 0.0
    cost = np.where(stopped, np.float32(model.stop_cost), np.float32(model.switch_cost))
    # best paths, all texts side by side, longest first, so that those still running are a prefix
    best = sims[begin[:-1]].copy()
    came = np.empty((begin[-1], n), np.int8)
    own = np.arange(n, dtype=np.int8)
    running = len(order)
    final = best.copy()
    for step in range(1, int(sizes[0])):
        while running and sizes[running - 1] <= step:
            running -= 1
            final[running] = best[running]
        now = begin[:running] + step
        head = best[:running]
        top = head.argmax(1)
        change = head[np.arange(running), top] - cost[now]
        stay = head >= change[:, None]
        came[now] = np.where(stay, own, top[:, None])
        best[:running] = np.where(stay, head, change[:, None]) + sims[now]
    final[:running] = best[:running]
    last = final.argmax(1)
    for k, i in enumerate(order):
        b, e, state = int(begin[k]), int(begin[k + 1]), int(last[k])
        places = read[i][1]
        found = []
        right, j = e, e - 1
        while right > b:  # walk back from one change of language to the one before
            same = came[b + 1 : j + 1, state] == state
            stays = same[::-1].argmin() if same.size and not same.all() else same.size
            j -= int(stays)
            total = sims[j:right].sum(0)
            odds = np.exp(np.minimum(60, total - total[state]))
            found.append((model.langs[state], places[j - b], right - j, float(1.0 / odds.sum())))
            if j > b:
                state = int(came[j, state])
            right, j = j, j - 1
        out[i] = found[::-1]
    return out


def language_stretches(df: DataFrame, id_col: str, text_col: str, model: LanguageModel, carry: Sequence[str] = ()) -> DataFrame:
    """One row per stretch: ``row_id``, ``carry`` columns, ``seg_no, n_segs, lang, confidence, first_char, n_words`` (places in the consistent form)."""
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    picked = df.select(F.col(id_col).cast("long").alias("row_id"), *carry, F.col(text_col).alias("read_text")).filter("read_text is not null")
    picked = spread(picked)
    kinds = {"seg_no": pa.int32(), "n_segs": pa.int32(), "lang": pa.string(), "confidence": pa.float64(), "first_char": pa.int32(), "n_words": pa.int32()}
    spark_kinds = {"seg_no": "int", "n_segs": "int", "lang": "string", "confidence": "double", "first_char": "int", "n_words": "int"}
    schema = picked.drop("read_text").withColumns({c: F.lit(None).cast(t) for c, t in spark_kinds.items()}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at, rows = [], []
            for i, found in enumerate(segment_batch(own, batch.column(batch.num_columns - 1).to_pylist())):
                for no, (lang, place, words, confidence) in enumerate(found, 1):
                    at.append(i)
                    rows.append((no, len(found), lang, confidence, place, words))
            kept = batch.take(pa.array(at, pa.int64()))
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], *(pa.array(c, t) for c, t in zip(columns, kinds.values()))], names=[*batch.schema.names[:-1], *kinds])

    return picked.mapInArrow(run, schema)


def label_names(reference: Sequence[tuple[str, str, str | None]]) -> dict[str, str]:
    """Every accepted spelling (lower case) of each language, from rows of ``(lang, name, '; ' list of other labels)``."""
    names = {}
    for lang, name, others in reference:
        for label in [lang, name, *(others or "").split(";")]:
            if label and label.strip():
                names[label.strip().lower()] = lang
    return names


def label_language(label: Column, names: dict[str, str]) -> Column:
    """The language a stored label stands for, null where it is missing, a mark for unknown, or no language of the list."""
    pairs = [F.lit(x) for kv in sorted(names.items()) for x in kv]
    return F.create_map(*pairs)[F.lower(F.trim(label))]
