"""Codebooks: options from headers, canonical answers, closed vocabularies, conditional repair, votes into a master."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlens.runtime import ship_package


def option_flags(df: DataFrame, options: DataFrame, question: str, value: str, option: str, sep: str) -> DataFrame:
    """One row per answer and option of its question, with ``present`` 1 or 0. Options are a small dimension, by question."""
    chosen = F.transform(F.split(value, re.escape(sep)), lambda x: F.lower(F.trim(x)))
    rows = df.withColumn("chosen", chosen).join(options, question)
    return rows.withColumn("present", F.array_contains("chosen", F.lower(option)).cast("int")).drop("chosen")


@dataclass(frozen=True)
class Header:
    """What a codebook column's header says."""

    question_id: str
    text: str
    options: tuple[str, ...]
    open_text: bool
    multi: bool


def parse_header(header: str) -> Header:
    """``Q2. Which topics? (select all) : A / B / C`` or options on their own lines."""
    m = re.match(r"\s*(Q\s*\d+[a-z]?)\s*[.):-]?\s*(.*)", header, re.I | re.S)
    number, rest = (m.group(1).replace(" ", "").upper(), m.group(2)) if m else ("", header)
    if "\n" in rest.strip():
        head, *lines = [x.strip() for x in rest.strip().split("\n") if x.strip()]
        found = [re.sub(r"^(?:[-•*]|\d+[.)])\s*", "", x) for x in lines]
    else:
        head, _, tail = rest.partition(":")
        found = [x.strip() for x in tail.split(" / ") if x.strip()]
    low = header.lower()
    open_text = not found or "specify" in low or "open text" in low
    multi = any(x in low for x in ("select all", "all that apply", "multi", "tick all"))
    return Header(number, re.sub(r"\s*\([^)]*\)\s*$", "", head).strip(), tuple(dict.fromkeys(found)), open_text, multi)


def _squeezed(text: str) -> str:
    return re.sub(r"[\s/]+", "", text.lower())


def answer_table(options: Sequence[str], aliases: Mapping[str, str]) -> dict[str, str]:
    """The known wordings of a question's answers: ``view:wording`` to the answer, one view per way of reading a cell."""
    spoken = {o.lower(): o for o in options} | {a.lower(): o for a, o in aliases.items()}
    rows = {f"{view}:{wording}": answer for view in ("whole", "head") for wording, answer in spoken.items()}
    return rows | {f"tight:{_squeezed(o)}": o for o in options}


def canonical_single(value: Column, aliases: Mapping[str, str], options: Sequence[str]) -> Column:
    """An answer in its canonical form, unchanged if it has none: the cell is looked up in ``answer_table`` as a whole, then
    without spaces and slashes, then what stands before its first full stop. Lists are those of one question."""
    known = answer_table(options, aliases)
    if not known:
        return F.trim(value)
    low = F.lower(value)
    views = {"whole": F.trim(low), "tight": F.regexp_replace(low, r"[\s/]+", ""), "head": F.trim(F.substring_index(low, ".", 1))}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(*(table[F.concat(F.lit(f"{view}:"), shown)] for view, shown in views.items()), F.trim(value))


class OptionReader:
    """Reads the options of a multi-answer cell.

    Every place where an option stands between borders is noted in one scan; places are then granted to the longest
    options first, and what no option was granted is split at commas and looked up as an alias or a squeezed option.
    """

    def __init__(self, options: Sequence[str], aliases: Mapping[str, str]) -> None:
        self.ranked = sorted(dict.fromkeys(options), key=lambda o: (-len(o), o))
        self.forms = [(o, o.lower()) for o in self.ranked if o]
        self.loose = {_squeezed(o): o for o in options} | {_squeezed(a): o for a, o in aliases.items()}
        self.alias = {a.lower(): o for a, o in aliases.items()}
        begins = "|".join(sorted({re.escape(low[0]) for _, low in self.forms}))
        self.begins = re.compile(rf"(?<![a-z0-9])(?:{begins})" if begins else r"(?!)")

    def places(self, low: str) -> list[tuple[int, int, int]]:
        """``(rank, begin, end)`` of every option at every place of a lower-case cell."""
        found = []
        for begin in (m.start() for m in self.begins.finditer(low)):
            for rank, (_, form) in enumerate(self.forms):
                end = begin + len(form)
                if low.startswith(form, begin) and not re.match(r"[a-z0-9]", low[end : end + 1]):
                    found.append((rank, begin, end))
        return sorted(found)

    def read(self, value: str) -> list[str]:
        low = value.lower() if len(value.lower()) == len(value) else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        taken = bytearray(len(low))
        answers = []
        for rank, begin, end in self.places(low):
            if not any(taken[begin:end]):
                taken[begin:end] = b"\1" * (end - begin)
                answers.append(self.forms[rank][0])
        rest = "".join("\n" if t else "," if c == "|" else c for c, t in zip(value, taken))
        for piece in (p.strip(" ,.;|") for p in re.split(r"[,\n]", rest)):
            if piece:
                answers.append(self.alias.get(piece.lower()) or self.loose.get(_squeezed(piece)) or piece)
        return list({a.lower(): a for a in reversed(answers)}.values())[::-1]


def tokens_of(value: str, options: Sequence[str], aliases: Mapping[str, str]) -> list[str]:
    """The distinct answers of one multi-answer cell: options by length, then the leftovers."""
    return OptionReader(options, aliases).read(value)


def canonical_multi(df: DataFrame, question: str, value: str, options: Mapping[str, Sequence[str]], aliases: Mapping[str, Mapping[str, str]] | None = None, out: str = "canonical") -> DataFrame:
    """Adds the canonical answers of multi-answer cells joined by ``, ``."""
    ship_package(df.sparkSession)
    aliases = aliases or {}
    readers = {q: OptionReader(own, aliases.get(q, {})) for q, own in options.items()}
    unlisted = OptionReader((), {})
    schema = df.withColumn(out, F.lit(None).cast("string")).schema

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            cells = zip(batch.column(batch.schema.get_field_index(question)).to_pylist(), batch.column(batch.schema.get_field_index(value)).to_pylist())
            done = [None if v is None else ", ".join(readers.get(q, unlisted).read(v)) for q, v in cells]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def options_in_order(value: Column, options: Sequence[str]) -> Column:
    """The known options a cell contains, by where they stand."""
    low = F.lower(value)
    found = F.array(*(F.struct(F.locate(o.lower(), low).alias("at"), F.lit(o).alias("option")) for o in options))
    return F.transform(F.array_sort(F.filter(found, lambda s: s["at"] > 0)), lambda s: s["option"])


def options_by_alias(value: Column, options: Sequence[str], aliases: Mapping[str, Sequence[str]] | None = None, other: str = "Other") -> Column:
    """The options whose label or alias a cell contains, in codebook order; "Other" only where the cell starts with it."""
    low = F.lower(value)
    tests = []
    for o in options:
        words = [o.lower(), *(a.lower() for a in (aliases or {}).get(o, ()))]
        hit = low.startswith(other.lower()) if o == other else F.array_contains(F.array(*(low.contains(w) for w in words)), True)
        tests.append(F.when(hit, F.lit(o)))
    return F.array_compact(F.array(*tests))


def coerce_one(value: Column, vocabulary: Sequence[str], default: str) -> Column:
    """The vocabulary's own spelling, or the default."""
    known = F.create_map(*[F.lit(x) for v in vocabulary for x in (v.lower(), v)])
    return F.coalesce(known[F.lower(F.trim(value))], F.lit(default))


def coerce_many(value: Column, vocabulary: Sequence[str], sep: str = ";") -> Column:
    """The cell's values in the vocabulary's spelling, unknown ones dropped, each once, in order."""
    known = F.create_map(*[F.lit(x) for v in vocabulary for x in (v.lower(), v)])
    return F.array_distinct(F.array_compact(F.transform(F.split(value, re.escape(sep)), lambda x: known[F.lower(F.trim(x))])))


@dataclass(frozen=True)
class Gate:
    """A repair: where ``when`` holds, ``column`` becomes ``value``; ``counter`` counts the rows it changed."""

    column: str
    when: str
    value: str | None
    counter: str | None = None


def repair(df: DataFrame, gates: Sequence[Gate]) -> DataFrame:
    """Conditional repair, rule after rule: each sees what the rules before it wrote. ``fix_<counter>`` says which rows changed.

    Conditions are SQL expressions over the columns; null answers count as empty.
    """
    counters: dict[str, Column] = {}
    for gate in gates:
        hit = F.coalesce(F.expr(gate.when), F.lit(False))
        fresh = F.when(hit, F.lit(gate.value)).otherwise(F.col(gate.column))
        if gate.counter:
            name = f"fix_{gate.counter}"
            changed = (hit & ~F.col(gate.column).eqNullSafe(F.lit(gate.value))).cast("int")
            df = df.withColumn(name, (F.greatest(F.col(name), changed) if name in counters else changed))
            counters[name] = F.col(name)
        df = df.withColumn(gate.column, fresh)
    return df


def repair_counts(df: DataFrame) -> DataFrame:
    """How many rows each counted rule changed."""
    names = [c for c in df.columns if c.startswith("fix_")]
    return df.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).unpivot([], names, "rule", "rows")


def compile_master(answers: DataFrame, item: str, question: str, answer: str, coder: str, order: str) -> DataFrame:
    """One answer per item and question: single-coded as it is, multi-coded by the most votes (ties: who comes first by
    ``order``); blanks don't vote. With the number and the list of coders."""
    votes = answers.filter(F.trim(F.coalesce(answer, F.lit(""))) != "")
    counted = votes.groupBy(item, question, answer).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    modal = counted.groupBy(item, question).agg(F.min_by(answer, F.struct((-F.col("n")).alias("m"), "first", answer)).alias(answer), F.max("n").alias("votes"))
    coders = answers.groupBy(item).agg(F.count_distinct(coder).alias("coders"), F.array_join(F.array_sort(F.collect_set(coder)), ", ").alias("coder_list"))
    return modal.join(coders, item)


def coder_of_file(path: Column) -> Column:
    """``x/B_Jane_Doe.csv`` is coder B."""
    return F.regexp_extract(path, r"([A-Za-z]+)[_ -][^/]*$", 1)


def shared_columns(left: Sequence[str], right: Sequence[str], skip: Sequence[str] = ()) -> list[tuple[str, str]]:
    """Column pairs of two sheets with the same key, without identity and open-text columns."""
    key = lambda c: re.sub(r"[^a-z0-9]+", " ", c.lower().replace("&", " and ")).strip()
    other = {key(c): c for c in reversed(right)}
    skipped = {key(s) for s in skip}
    return [(c, other[key(c)]) for c in left if key(c) in other and key(c) not in skipped]


def changed_cells(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Changed cells per column between two versions of a table."""
    long = lambda df, n: df.select(key, *(F.col(c).cast("string") for c in columns)).unpivot(key, list(columns), "question", n)
    both = long(before, "old").join(long(after, "new"), [key, "question"])
    return both.groupBy("question").agg(F.count("*").alias("cells"), F.sum((~F.col("old").eqNullSafe(F.col("new"))).cast("int")).alias("changed"))

