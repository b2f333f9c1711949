"""One form for texts that look the same on screen (problem 3).

The operator treats a column batch as one long relation ``(row, position, code point)``: the texts are exploded into a
flat array of code points, joined with a broadcast mapping from code point to its visible letters (canonical parts,
full-width and styled letters, look-alike letters, fixed-width spaces; invisible characters map to nothing), the
combining marks behind each letter are put in the order of their class, letters and marks are recomposed, and the rows
are cut out of the array again. The relation lives inside an Arrow batch: as Spark rows it would be one row per
character through a shuffle, some two hundred times the rows of the input.

Defined cases: null stays null, empty stays empty; letter case, accents, digits and punctuation are visible and stay;
ordinary spaces, tabs and line ends stay as they are; a joiner between two pictographs is part of the picture and stays.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlens.runtime import ship_package

LIMIT = 0x110000
JOINER = 0x200D

# Letters of other scripts (and of rarer Latin sets) drawn like the Latin letter before them.
LOOK_ALIKES = """
A ΑАᎪᗅꓮ  B ΒВᏴᗷꓐ  C СᏟꓚϹ  D Ꭰᗞꓓ  E ΕЕᎬꓰ  F ϜᖴꓝҒ  G ᏀԌꓖ  H ΗНᎻꓧ  I ΙІӀꓲ  J ЈᎫꓙ  K ΚКᏦꓗ
L ᏞꓡᏓ  M ΜМᎷꓟϺ  N ΝꓠՆ  O ΟОՕꓳ  P ΡРᏢꓑ  Q ԚՔ  R ᎡꓣᏒ  S ЅՏᏚꓢ  T ΤТᎢꓔ  U ՍꓴᑌԱ  V ᏙꓦѴ  W ԜᎳꓪ
X ΧХꓫ  Y ΥҮᎩꓬУ  Z ΖᏃꓜ
a αаɑ  c сϲᴄ  d ԁ  e еҽ  g ɡցƍ  h һհ  i іιɩ  j јϳ  k кκ  l ӏ  n ոռ  o οоօσ  p рρ  q ԛգ  r гᴦ  s ѕꜱ
u υսᴜ  v νѵᴠ  w ԝɯѡᴡ  x хᕁ  y уγү  z ᴢ
"""


def text_slices(texts: Sequence[str | None], most_chars: int = 400_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most so many characters (or one text), so that working memory doesn't follow the batch."""
    begin = size = 0
    for i, text in enumerate(texts):
        own = len(text) if text else 0
        if size and size + own > most_chars:
            yield begin, i
            begin, size = i, 0
        size += own
    yield begin, len(texts)


def _look_alike_map() -> dict[int, int]:
    found: dict[int, int] = {}
    for entry in LOOK_ALIKES.split("  "):
        for line in entry.split("\n"):
            if line.strip():
                latin, others = line.split()
                found.update({ord(c): ord(latin) for c in others})
    return found


def _visible_parts(ch: str, alike: dict[int, int]) -> list[int]:
    """The code points a character shows as: nothing for invisible ones, a space for odd spaces, else letters and marks."""
    cp, kind = ord(ch), unicodedata.category(ch)
    if kind == "Zs":
        return [0x20]
    if kind == "Cf" or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= cp <= 0xFE0F or 0x180B <= cp <= 0x180F or 0xE0100 <= cp <= 0xE01EF:
        return []
    if 0xAC00 <= cp <= 0xD7A3:  # a whole Hangul syllable is one shape; loose jamo are composed at the end
        return [cp]
    parts = unicodedata.decomposition(ch).split()
    if parts:
        styled = parts[0].startswith("<")
        if styled and not (parts[0] in ("<wide>", "<narrow>", "<font>") and kind[0] in "LN" or parts[0] == "<compat>" and kind in ("Ll", "Lu", "Nl")):
            return [alike.get(cp, cp)]
        return [x for p in parts[styled:] for x in _visible_parts(chr(int(p, 16)), alike)]
    return [alike.get(cp, cp)]


class GlyphTables:
    """The broadcast mappings, indexed by code point; their size is bounded by Unicode, not by the data (about 12 MB)."""

    def __init__(self) -> None:
        alike = _look_alike_map()
        length = np.ones(LIMIT, np.uint8)
        start = np.zeros(LIMIT, np.int32)
        pool: list[int] = []
        self.mark_class = np.zeros(LIMIT, np.uint8)
        self.picture = np.zeros(LIMIT, bool)
        self.word_char = np.zeros(LIMIT, bool)
        pairs: dict[int, int] = {}
        second_starters = []
        for cp in range(LIMIT):
            if 0xD800 <= cp <= 0xDFFF or 0x20000 <= cp < 0x2F800 or 0x2FA20 <= cp < 0xE0000 or cp >= 0xE0200:
                continue  # unassigned, private or plain ideographs: themselves
            ch = chr(cp)
            kind = unicodedata.category(ch)
            self.word_char[cp] = kind[0] == "L" or kind[0] == "N"
            self.picture[cp] = (kind in ("So", "Sk") and cp > 0x2000) or 0x1F3FB <= cp <= 0x1F3FF
            self.mark_class[cp] = unicodedata.combining(ch)
            parts = _visible_parts(ch, alike)
            if parts != [cp]:
                start[cp], length[cp] = len(pool), len(parts)
                pool += parts
            else:
                start[cp] = -1
            split = unicodedata.decomposition(ch).split()
            if len(split) == 2 and not split[0].startswith("<") and unicodedata.normalize("NFC", ch) == ch:
                first, second = (int(x, 16) for x in split)
                pairs[first << 21 | second] = cp
                if unicodedata.combining(chr(second)) == 0:
                    second_starters.append(second)
        self.word_char[0x20000:0x2F800] = True
        start[0x20000:0x2F800] = start[0x2FA20:0xE0000] = start[0xE0200:] = start[0xD800:0xE000] = -1
        self.length, self.start, self.pool = length, start, np.array(pool, np.uint32)
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_values = keys, np.array([pairs[int(k)] for k in keys], np.uint32)
        self.late_composer = np.zeros(LIMIT, bool)
        self.late_composer[second_starters] = True
        self.late_composer[0x1100:0x1200] = True

    def canonical(self, texts: Sequence[str | None]) -> list[str | None]:
        """The consistent form of each text; see the module's text for the steps."""
        return self.canonical_with_places(texts)[0]

    def canonical_with_places(self, texts: Sequence[str | None]) -> tuple[list[str | None], dict[int, np.ndarray]]:
        """Consistent forms, and for each text that isn't plain ASCII the place in it of every character of its form.

        The places are two rows: where the first and behind the last character stand that a character was made of.
        """
        out, places = [], {}
        for begin, end in text_slices(texts):
            forms, own = self._slice(texts[begin:end])
            out += forms
            places.update((i + begin, p) for i, p in own.items())
        return out, places

    def _slice(self, texts: Sequence[str | None]) -> tuple[list[str | None], dict[int, np.ndarray]]:
        out, places = list(texts), {}
        at = [i for i, t in enumerate(texts) if t and not t.isascii()]
        if not at:
            return out, places
        joined = "".join([texts[i] for i in at])
        flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter((len(texts[i]) for i in at), np.int64, len(at))
        row = np.repeat(np.arange(len(at)), sizes)
        # join with the mapping: characters that are themselves keep one place, others get as many as they have parts
        count = self.length[flat].astype(np.int64)
        source = self.start[flat]
        kept = self._kept_joiners(flat, row)
        if kept.size:
            count[kept] = 1
            source = source.copy()
            source[kept] = -1
        ends = np.cumsum(count)
        cps, rows = np.repeat(flat, count), np.repeat(row, count)
        mapped, came = np.repeat(source, count), np.repeat(np.arange(flat.size), count)
        behind = came + 1
        hit = mapped >= 0
        cps[hit] = self.pool[(mapped + np.arange(cps.size) - np.repeat(ends - count, count))[hit]]
        # order marks by class within each run of marks
        rank = self.mark_class[cps]
        marks = np.flatnonzero(rank)
        if marks.size:
            fresh = np.ones(marks.size, bool)
            fresh[1:] = (np.diff(marks) != 1) | (np.diff(rows[marks]) != 0)
            run = np.cumsum(fresh) - 1
            order = marks[np.lexsort((np.arange(marks.size), rank[marks], run))]
            cps[marks], came[marks], behind[marks] = cps[order], came[order], behind[order]
            keep = self._recompose(cps, rows, behind, marks, np.flatnonzero(fresh))
            cps, rows, came, behind = cps[keep], rows[keep], came[keep], behind[keep]
        whole = cps.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        bounds = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(at)))))
        begins = np.concatenate(([0], np.cumsum(sizes)))
        late = np.zeros(len(at), bool)
        late[rows[self.late_composer[cps]]] = True
        for k, i in enumerate(at):
            b, e = int(bounds[k]), int(bounds[k + 1])
            out[i], places[i] = whole[b:e], np.stack((came[b:e], behind[b:e])) - begins[k]
            if late[k]:
                out[i], places[i] = self._compose_late(out[i], places[i])
        return out, places

    def _kept_joiners(self, flat: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Places of joiners between two pictographs (the first may have a selector behind it) of one and the same text."""
        at = np.flatnonzero(flat == JOINER)
        at = at[(at > 0) & (at < flat.size - 1)]
        at = at[(row[at - 1] == row[at]) & (row[at + 1] == row[at])]
        two = np.maximum(at - 2, 0)
        skips = self._selector(flat[at - 1]) & (at > 1) & (row[two] == row[at])
        before = np.where(skips, flat[two], flat[at - 1])
        return at[self.picture[before] & self.picture[flat[at + 1]]]

    def _compose_late(self, text: str, places: np.ndarray) -> tuple[str, np.ndarray]:
        """Joins letters with those behind them that aren't marks (loose jamo, some vowel signs); places are joined as well."""
        letters: list[str] = []
        spans: list[list[int]] = []
        base, last = -1, 0  # the letter to join with, and the class of what stands between
        for ch, begin, end in zip(text, *places.tolist()):
            own = int(self.mark_class[ord(ch)])
            if base >= 0 and (base == len(letters) - 1 or 0 < last < own):
                pair = unicodedata.normalize("NFC", letters[base] + ch)
                if len(pair) == 1:
                    letters[base] = pair
                    spans[base] = [min(spans[base][0], begin), max(spans[base][1], end)]
                    continue
            if own == 0:
                base = len(letters)
            last = own
            letters.append(ch)
            spans.append([begin, end])
        return "".join(letters), np.array(spans, np.int64).reshape(-1, 2).T

    @staticmethod
    def _selector(cps: np.ndarray) -> np.ndarray:
        return (cps == 0xFE0F) | (cps == 0xFE0E)

    def _recompose(self, cps: np.ndarray, rows: np.ndarray, behind: np.ndarray, marks: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Merge each mark into the letter before its run where Unicode has the composed letter; returns what remains.

        The place behind a letter (``behind``) moves past the marks merged into it.
        """
        begin = marks[firsts]
        sizes = np.diff(np.append(firsts, marks.size))
        has_letter = (begin > 0) & (rows[np.maximum(begin - 1, 0)] == rows[begin])
        letter_at = begin - 1
        last = np.zeros(begin.size, np.int64)
        keep = np.ones(cps.size, bool)
        for step in range(int(sizes.max())):
            live = np.flatnonzero((sizes > step) & has_letter)
            if not live.size:
                break
            mark_at = begin[live] + step
            own = self.mark_class[cps[mark_at]].astype(np.int64)
            key = cps[letter_at[live]].astype(np.int64) << 21 | cps[mark_at].astype(np.int64)
            where = np.minimum(np.searchsorted(self.pair_keys, key), self.pair_keys.size - 1)
            merged = (self.pair_keys[where] == key) & (last[live] < own)
            cps[letter_at[live[merged]]] = self.pair_values[where[merged]]
            keep[mark_at[merged]] = False
            behind[letter_at[live[merged]]] = np.maximum(behind[letter_at[live[merged]]], behind[mark_at[merged]])
            last[live[~merged]] = own[~merged]
        return keep


@lru_cache(maxsize=1)
def glyph_tables() -> GlyphTables:
    """The tables, built once per process."""
    return GlyphTables()


def canonical_text(df: DataFrame, text_col: str, out_col: str = "canonical_text") -> DataFrame:
    """Adds the consistent form of ``text_col``. All other columns pass through; a clash with ``out_col`` is an error."""
    if out_col in df.columns:
        raise ValueError(f"column {out_col} exists")
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(glyph_tables())
    schema = df.withColumn(out_col, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            done = tables.canonical(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.string())], names=[*batch.schema.names, out_col])

    return df.mapInArrow(run, schema)


def look_keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` with 128-bit keys of the stored text (``raw``) and of its consistent form (``look``), as pairs of longs.

    Only texts with a letter or digit are kept: nulls, empty and picture-only texts are never equal to anything.
    """
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(glyph_tables())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            looks = tables.canonical(texts)
            rows = []
            for i, text, look in zip(ids, texts, looks):
                if look and any(map(str.isalnum, look)):
                    raw = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
                    key = raw if look is text else xxhash.xxh3_128_digest(look.encode("utf-8", "surrogatepass"))
                    rows.append((i, raw + key))
            words = np.frombuffer(b"".join([r[1] for r in rows]), "<i8").reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), *(pa.array(words[:, k]) for k in range(4))],
                names=["row_id", "raw_hi", "raw_lo", "look_hi", "look_lo"],
            )

    return df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("t")).mapInArrow(
        run, "row_id long, raw_hi long, raw_lo long, look_hi long, look_lo long"
    )


def look_alike_classes(keys: DataFrame, group_cols: list[str]) -> DataFrame:
    """``group_cols, row_id, look_class, text_class`` of the rows that look like a row of another text: linear in the rows.

    A class is named by its smallest row; rows of one ``text_class`` hold one stored text. Two rows of one ``look_class`` and
    different ``text_class`` are a pair of ``look_alike_pairs``.
    """
    look, raw = [*group_cols, "look_hi", "look_lo"], ["raw_hi", "raw_lo"]
    texts = keys.groupBy(*look, *raw).agg(F.min("row_id").alias("text_class"))
    looks = texts.groupBy(*look).agg(F.min("text_class").alias("look_class"), F.count("*").alias("looks")).filter("looks > 1").drop("looks")
    return keys.join(texts.join(looks, look), [*look, *raw]).select(*group_cols, "row_id", "look_class", "text_class")


def look_alike_pairs(keys: DataFrame, group_cols: list[str]) -> DataFrame:
    """All pairs of rows, within ``group_cols``, whose stored texts differ but look the same: ``row_a < row_b``.

    Copies of one stored text never meet each other: rows are first gathered into classes of equal text, classes that
    look the same are paired, and only those pairs are spelled out as rows. The work is that of the result.
    """
    look, raw = [*group_cols, "look_hi", "look_lo"], ["raw_hi", "raw_lo"]
    several = (
        keys.groupBy(*look)
        .agg(*(f(c).alias(f"{n}_{c}") for c in raw for n, f in (("lo", F.min), ("hi", F.max))))
        .filter(" or ".join(f"lo_{c} <> hi_{c}" for c in raw))
        .select(*look)
    )
    rows = keys.join(several, look, "left_semi")
    classes = rows.select(*look, *raw).distinct()
    other = classes.select(*look, F.col("raw_hi").alias("other_hi"), F.col("raw_lo").alias("other_lo"))
    links = classes.join(other, look).filter("raw_hi <> other_hi or raw_lo <> other_lo")
    left = rows.join(links, [*look, *raw]).select(*look, F.col("other_hi").alias("raw_hi"), F.col("other_lo").alias("raw_lo"), F.col("row_id").alias("row_a"))
    return (
        left.join(rows.select(*look, *raw, F.col("row_id").alias("row_b")), [*look, *raw])
        .filter("row_a < row_b")
        .select(*group_cols, "row_a", "row_b")
    )
