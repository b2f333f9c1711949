"""Free-entered values mapped to a canonical list (problem 5).

The entries of each list are paths of a trie, with their alias paths beside them: the phrases of the entry's note, the
order of its words changed (of entries of up to four words every order is a path; longer ones have one path with their
words in alphabetical order, which values are brought into), its first words alone, and wordings that earlier passes have mapped to it. A typed value is
run through the trie by a Levenshtein automaton (its states are the rows of the edit table; a swap of neighbours is one
edit), which returns every path within a distance that depends on the value's length; the closest path gives the entry.

A cell may hold several values. It is cut at every possible separator and put together again the cheapest way, so that
an entry with a comma in it stays one value. A value without a path is read word by word and taken for the entry that
at least half of its words belong to, if there is only one; else it is unmatched.

Defined cases: a null or blank cell falls back to the second column, and has no rows if both are; a value of a question
without a list is unmatched; repeated values of a cell count once; ties go to the longer common beginning, then to the
lower entry id. Values of any length are read: one that is longer than every path by more than its distance has none near.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlens.runtime import join_null_safe, ship_package

SEPARATORS = r"[;|\n,/+&]"
JOINING_WORDS = frozenset("and or n the a an of".split())
UNMATCHED = 0


def reach(length: int) -> int:
    """The largest edit distance for a value of this length."""
    return 0 if length <= 3 else 1 if length <= 5 else 2 if length <= 10 else 3


def plain_words(value: str) -> list[str]:
    """Lower-case words; a number behind them (a page, a time) is not part of the value."""
    words = re.findall(r"[^\W_]+", value.lower().replace("'", "").replace("’", ""))
    while len(words) > 1 and words[-1].isdigit():
        words.pop()
    return words


def content(words: Sequence[str]) -> tuple[str, ...]:
    kept = tuple(w for w in words if w not in JOINING_WORDS)
    return kept or tuple(words)


class Trie:
    """Paths over letters; an end holds the entries the path stands for."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.ends: dict[int, set[int]] = {}
        self.longest = 0

    def add(self, path: str, entry: int) -> None:
        node = 0
        self.longest = max(self.longest, len(path))
        for letter in path:
            if letter not in self.next[node]:
                self.next[node][letter] = len(self.next)
                self.next.append({})
            node = self.next[node][letter]
        self.ends.setdefault(node, set()).add(entry)

    def near(self, value: str, most: int) -> list[tuple[int, int, str, int]]:
        """All ``(distance, -common beginning, path, entry)`` within ``most`` edits of ``value``.

        A state is the edit row of a path, kept only in the band of lengths that ``most`` edits can bridge. A value
        longer than every path by more than that has none near.
        """
        found: list[tuple[int, int, str, int]] = []
        if len(value) > self.longest + most:
            return found
        size, far = len(value), most + 1
        stack = [(0, "", [min(i, far) for i in range(size + 1)], None)]
        while stack:
            node, path, row, older = stack.pop()
            if row[size] <= most and node in self.ends:
                common = next((i for i, (a, b) in enumerate(zip(path, value)) if a != b), min(len(path), size))
                found += [(row[size], -common, path, e) for e in self.ends[node]]
            depth = len(path) + 1
            first, last = max(1, depth - most), min(size, depth + most)
            if first > last and depth > most:
                continue
            behind = path[-1:] if older is not None else ""
            for letter, child in self.next[node].items():
                fresh = [far] * (size + 1)
                lowest = far
                if depth <= most:
                    fresh[0] = lowest = depth
                for i in range(first, last + 1):
                    cost = row[i - 1] + (value[i - 1] != letter)
                    if row[i] < cost:
                        cost = min(cost, row[i] + 1)
                    if fresh[i - 1] < cost:
                        cost = min(cost, fresh[i - 1] + 1)
                    if i > 1 and value[i - 2] == letter and value[i - 1] == behind and older[i - 2] < cost:
                        cost = min(cost, older[i - 2] + 1)
                    if cost < far:
                        fresh[i] = cost
                        if cost < lowest:
                            lowest = cost
                if lowest <= most or min(row) < most:  # a swap may still lead back from the row before
                    stack.append((child, path + letter, fresh, row))
        return sorted(found)


@dataclass
class Codebook:
    """The tries of all questions: whole values, entries of many words with their words in alphabetical order, and single
    words with the entries they belong to; ``longest``: letters of the longest value a question can have."""

    values: dict[str, Trie] = field(default_factory=dict)
    words: dict[str, Trie] = field(default_factory=dict)
    exact: dict[tuple[str, str], int] = field(default_factory=dict)
    orders: dict[str, Trie] = field(default_factory=dict)
    longest: dict[str, int] = field(default_factory=dict)
    known: dict[tuple[str, str], tuple[int, int] | None] = field(default_factory=dict)

    @staticmethod
    def build(entries: Sequence[tuple[str, int, str, str | None]], aliases: Sequence[tuple[str, str, int]] = ()) -> Codebook:
        """From ``(question, entry id, text, note)`` and further ``(question, phrase, entry id)``."""
        book = Codebook()
        by_question: dict[str, list[tuple[int, str, str | None]]] = defaultdict(list)
        for question, entry, text, note in entries:
            if question is not None and text:
                by_question[question].append((entry, text, note))
        known: dict[str, dict[tuple[str, ...], int]] = defaultdict(dict)
        for question, phrase, entry in aliases:
            known[question][content(plain_words(phrase))] = entry
        for question, own in by_question.items():
            sure: dict[tuple[str, ...], set[int]] = defaultdict(set)  # entries and phrases of their notes
            loose: dict[tuple[str, ...], set[int]] = defaultdict(set)  # paths derived from them, dropped where not unique
            single: dict[str, set[int]] = defaultdict(set)
            ordered = Trie()
            longest = 0
            for entry, text, note in own:
                words = plain_words(text)
                core = content(words)
                sure[core].add(entry)
                longest = max(longest, len(" ".join(words)), len(note or ""))
                if len(core) > 4:
                    ordered.add(" ".join(sorted(core)), entry)
                if 2 <= len(core) <= 4:
                    for order in itertools.permutations(core):
                        loose[order].add(entry)
                for n in range(2, len(words)):
                    loose[content(words[:n])].add(entry)
                for w in core:
                    single[w].add(entry)
                for phrase in re.split(r"[,;]", note or ""):
                    words = plain_words(phrase)
                    if not words:
                        continue
                    sure[content(words)].add(entry)
                    for i, j in itertools.combinations(range(len(words) + 1), 2):
                        if content(words[i:j]) != tuple(words[i:j]) or j - i < len(words):
                            loose[content(words[i:j])].add(entry)
                    for w in content(words):
                        single[w].add(entry)
            for phrase, entry in known.get(question, {}).items():
                sure.setdefault(phrase, {entry})
                for w in phrase:
                    single[w].add(entry)
            for core, found in list(sure.items()):  # other forms of one-word wordings
                if len(core) == 1 and len(core[0]) > 3:
                    stem = re.sub(r"(?:ings?|ed|s|e)$", "", core[0])
                    for ending in ("", "e", "s", "ing", "ings", "ed"):
                        if len(stem) > 2:
                            loose[(stem + ending,)] |= found
            trie, word_trie = Trie(), Trie()
            paths = {" ".join(core): min(found) for core, found in sure.items()}
            for core, found in loose.items():
                if len(found) == 1 and core not in sure and sum(map(len, core)) >= 3:
                    paths.setdefault(" ".join(core), *found)
            for path, entry in paths.items():
                trie.add(path, entry)
                book.exact[question, path] = entry
            for w, found in single.items():
                for e in found:
                    word_trie.add(w, e)
            book.values[question], book.words[question], book.orders[question] = trie, word_trie, ordered
            book.longest[question] = max(longest, trie.longest) + 3
        return book

    def match(self, question: str | None, value: str) -> tuple[float, int] | None:
        """``(distance, entry)`` of one value, None if it has no entry; a reading word by word counts as distance 4."""
        core = content(plain_words(value))
        key = (question or "", " ".join(core))
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = self._search(key[0], core)
        return self.known[key]

    def _search(self, question: str, core: tuple[str, ...]) -> tuple[float, int] | None:
        trie, joined = self.values.get(question), " ".join(core)
        if trie is None or not core:
            return None
        if (question, joined) in self.exact:
            return 0, self.exact[question, joined]
        near = trie.near(joined, reach(len(joined)))
        if not near and len(core) > 4:
            near = self.orders[question].near(" ".join(sorted(core)), reach(len(joined)))
        if near:
            best = min(near, key=lambda f: (f[0], f[1], f[3]))
            return best[0], best[3]
        votes: dict[int, float] = defaultdict(float)
        for w in core:
            own = self.words[question].near(w, min(2 if len(w) > 8 else 1, reach(len(w))))
            for e in {f[3] for f in own if f[0] == own[0][0]}:
                votes[e] += 1.0 if own[0][0] == 0 else 0.9
        ranked = sorted(votes.items(), key=lambda kv: (-kv[1], kv[0]))
        if ranked and ranked[0][1] * 2 >= len(core) and (len(ranked) == 1 or ranked[1][1] < ranked[0][1]):
            return 4, ranked[0][0]
        return None

    def entries(self, question: str | None, cell: str) -> list[int]:
        """The distinct entries of a cell's values, UNMATCHED among them if a value has none."""
        atoms = [a for a in re.split(SEPARATORS, cell) if plain_words(a)]
        if not atoms:
            return [UNMATCHED] if cell.strip() else []
        alone = [self.match(question, a) for a in atoms]
        if all(m is not None and m[0] < 4 for m in alone):
            return sorted({m[1] for m in alone})
        longest = self.longest.get(question or "", 0)
        best: list[tuple[float, list[int]]] = [(0.0, [])]
        for end in range(1, len(atoms) + 1):
            options = []
            size = 0
            for begin in range(end - 1, -1, -1):
                size += len(" ".join(plain_words(atoms[begin]))) + 1
                if begin < end - 1 and size > longest:
                    break  # longer than any path with all its joining words
                found = self.match(question, " ".join(atoms[begin:end]))
                if found is not None:
                    whole = found[0] < 4
                    if end - begin == 1 or whole:
                        options.append((best[begin][0] + found[0] + 1.0, [*best[begin][1], found[1]]))
                elif end - begin == 1:
                    options.append((best[begin][0] + 6.5, [*best[begin][1], UNMATCHED]))
            best.append(min(options, key=lambda o: o[0]))
        return sorted(set(best[-1][1]))


def phrase_key(value: Column) -> Column:
    """The words of a value as a key for counting, without a number behind them."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.lower(value), "['’]", ""), r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(words, r"( [0-9]+)+$", "")


def learned_aliases(
    flags: DataFrame, entries: DataFrame, question_col: str, unit_col: str, typed_col: str, cleaned_col: str, entry_id: str, entry_text: str, least: int = 2, least_share: float = 0.0005, agreement: float = 0.5
) -> list[tuple[str, str, int]]:
    """Wordings that earlier passes mapped: ``(question, phrase, entry)``.

    A phrase counts if it is a whole cell of one value, is typed under one question only (remarks that are no answer turn
    up under all of them), and most of what it was cleaned to is one entry. An answer flagged again (same ``unit_col``)
    counts once. Counts are over all rows; a phrase must
    carry ``least_share`` of its question's cells, so at most 1/least_share phrases per question come to the driver.
    """
    texts = entries.select(F.col(question_col), phrase_key(F.col(entry_text)).alias("cleaned_key"), F.col(entry_id).alias("entry"))
    cells = flags.select(F.col(question_col), F.col(unit_col).alias("unit"), phrase_key(F.col(typed_col)).alias("phrase"), phrase_key(F.col(cleaned_col)).alias("cleaned_key")).filter(
        F.col("phrase").isNotNull() & (F.length("phrase") > 2) & ~F.col(typed_col).rlike("[;|\n,]") & F.col(question_col).isNotNull()
    ).distinct()
    counted = cells.groupBy(question_col, "phrase", "cleaned_key").agg(F.count("*").alias("n"))
    counted = counted.join(texts, [question_col, "cleaned_key"], "left")
    by_entry = counted.groupBy(question_col, "phrase", "entry").agg(F.sum("n").alias("n"))
    phrases = by_entry.groupBy("phrase").agg(
        F.count_distinct(question_col).alias("questions"),
        F.min(question_col).alias(question_col),
        F.sum("n").alias("cells"),
        F.sum(F.when(F.col("entry").isNotNull(), F.col("n"))).alias("mapped"),
        F.max(F.when(F.col("entry").isNotNull(), F.struct("n", (-F.col("entry")).alias("minus_entry")))).alias("top"),
    )
    totals = cells.groupBy(question_col).agg(F.count("*").alias("all_cells"))
    kept = phrases.filter("questions = 1").join(totals, question_col).filter((F.col("top.n") >= least) & (F.col("top.n") >= agreement * F.col("mapped")) & (F.col("cells") >= least_share * F.col("all_cells")))
    found = [(r[0], r[1], -r[2]) for r in kept.select(question_col, "phrase", "top.minus_entry").orderBy(question_col, "phrase").collect()]
    return found


def without_typos(aliases: Sequence[tuple[str, str, int]], base: Codebook) -> list[tuple[str, str, int]]:
    """The learned wordings that aren't just a known one with a slip of the pen."""
    kept = []
    for question, phrase, entry in aliases:
        match = base.match(question, phrase)
        if match is None or 1 < match[0] or (match[0] == 1 and len(phrase) < 4):
            kept.append((question, phrase, entry))
    return kept


def canonical_values(flags: DataFrame, book: Codebook, id_col: str, question_col: str, typed_col: str, fallback_col: str) -> DataFrame:
    """``flag_id, question, typed, option_id``: the entries of each row's cell, 0 for a value without an entry."""
    spark = flags.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(book)
    typed = F.when(F.trim(F.regexp_replace(F.col(typed_col), r"[\s\p{Z}]+", " ")) != "", F.col(typed_col)).otherwise(F.col(fallback_col))
    picked = flags.select(F.col(id_col).cast("long").alias("flag_id"), F.col(question_col).alias("question"), typed.alias("typed")).filter("typed is not null")
    # a cell is answered once, however many rows hold it: distinct cells go to Python, rows find their cell by a join
    cells = picked.select("question", "typed").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            answers = [own.entries(q, cell) for q, cell in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.list_(pa.int64()))], names=["question", "typed", "options"])

    width = max(4, 2 * spark.sparkContext.defaultParallelism)
    answered = cells.repartition(width, "typed").mapInArrow(run, "question string, typed string, options array<long>")
    return join_null_safe(picked, answered, ["question", "typed"]).select("flag_id", "question", "typed", F.explode("options").alias("option_id"))
