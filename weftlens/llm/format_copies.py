"""Copies hidden by formatting (problem 2): records equal but for white space, letter case, punctuation or field order.

A record is a multiset of fields. Any text can be read as one field without a name; a text made up as a form ("Town: X;
Children - 3") can also be read as one field per label. Each normalised name and value pair is hashed, and the hashes are
added up lane by lane: addition commutes, so forms that differ in the order of their fields get one fingerprint without
any sorting (the sum over one field is its hash). Records are grouped by the fingerprint of the nameless reading, and
groups whose labelled readings agree are merged.

Equality is verified without sorting: records of one nameless fingerprint must also agree in a checksum of another kind
and in length; labelled readings that agree across different texts are compared field by field with the first of their
fingerprint, and what differs is told apart by sums under other seeds. Texts are read once and moved for forms only, once per
distinct text; of all other records only fingerprints of some 40 bytes are.

A form whose labels can't be read (say, its punctuation was lost) still equals the form with the same letters in the
same order, and through it that form's other orders.

Nothing is collected: groups are counted with partial aggregation, and rows find their group by one join, whose skewed
keys adaptive execution splits.

Defined cases: null and empty texts and texts without a letter or digit are in no group; rows repeated under one id
count once each; the first row of a group is the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlens.runtime import cut_lineage

#: What formatting may change: white space, separators, punctuation, and the signs = and | of forms.
IGNORED = r"[\s\p{Z}\p{P}=|]+"
_BETWEEN_FIELDS = r"\s*(?:\n|;|\||\s/\s)\s*"
_FIELD = r"^[\s\p{Z}\p{P}]*?(\p{L}[\p{L}\p{M}'’ ]*?)[\s\p{Z}]*(?:[:=]|[\s\p{Z}][-–—][\s\p{Z}])(.*)$"
_LANE = 40
_MASK = (1 << _LANE) - 1
#: The fingerprint of the nameless reading, with what verifies it.
KEYS = ["copy_hash", "copy_hash_too", "copy_check", "copy_length"]


def flat_form(text: Column) -> Column:
    """The letters, digits and signs of a text in lower case, without anything that formatting may change."""
    return F.translate(F.regexp_replace(F.lower(text), IGNORED, ""), "ς", "σ")


def form_fields(text: Column) -> Column:
    """The fields ``(name, value)`` of a text made up as a form, in normal form; null for any other text."""
    pieces = F.filter(F.split(text, _BETWEEN_FIELDS), lambda p: p.rlike(r"[\p{L}\p{N}]"))
    fields = F.transform(
        pieces,
        lambda p: F.struct(flat_form(F.regexp_extract(p, _FIELD, 1)).alias("name"), flat_form(F.regexp_extract(p, _FIELD, 2)).alias("value")),
    )
    return F.when((F.size(fields) >= 2) & F.forall(fields, lambda f: f["name"] != ""), fields)


def field_hash(name: Column, value: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), name, value)


def multiset_hash(fields: Column, seed: int = 1) -> Column:
    """Three 40-bit lanes, each the sum of the fields' hashes, as one number: equal multisets have equal sums in any order."""

    def total(own: int, shift: int) -> Column:
        parts = F.transform(fields, lambda f: F.shiftrightunsigned(field_hash(f["name"], f["value"], own), shift).bitwiseAND(_MASK))
        return F.aggregate(parts, F.lit(0).cast("long"), lambda a, h: (a + h).bitwiseAND(_MASK)).cast("decimal(38,0)")

    step = F.lit(1 << _LANE).cast("decimal(13,0)")
    lanes = [total(seed, 0), total(seed, 24), total(seed + 1, 0)]
    number = lanes[0]
    for lane in lanes[1:]:
        number = (number * step + lane).cast("decimal(38,0)")
    return number


def same_fields(a: Column, b: Column) -> Column:
    """Whether two arrays of fields are equal as multisets, without sorting them."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_except(a, b)) == 0)
    times = lambda fields, x: F.size(F.filter(fields, lambda y: y == x))
    return (F.size(a) == F.size(b)) & (plain | F.forall(F.array_distinct(a), lambda x: times(a, x) == times(b, x)))


def _fingerprints(records: DataFrame, group_cols: list[str], id_col: str, text: Column) -> DataFrame:
    """``group_cols, row_id, KEYS, fields, form`` of the records with a letter or digit; the last two are null but for forms."""
    # forms are few: a cheap test keeps the rest of the texts from being parsed
    likely = text.rlike(r"[\n;|]|\s/\s") & text.rlike(r"[:=]|\s[-–—]\s")
    read = records.filter(text.rlike(r"[\p{L}\p{N}]")).select(
        *group_cols, F.col(id_col).alias("row_id"), flat_form(text).alias("copy_flat"), F.when(likely, form_fields(text)).alias("fields")
    )
    nameless = [field_hash(F.lit(""), F.col("copy_flat"), seed) for seed in (1, 2)]
    verified = [F.coalesce(F.crc32(F.col("copy_flat").cast("binary")), F.lit(0).cast("long")), F.coalesce(F.length("copy_flat"), F.lit(0))]
    form = F.when(F.col("fields").isNotNull(), multiset_hash(F.col("fields")))
    return read.withColumns({**dict(zip(KEYS, [*nameless, *verified])), "form": form}).drop("copy_flat")


def _merged_forms(rows: DataFrame, group_cols: list[str]) -> DataFrame:
    """``group_cols, KEYS, form``: the nameless fingerprints whose labelled reading another one has too, by labelled reading."""
    forms = rows.filter("fields is not null").groupBy(*group_cols, "form", *KEYS).agg(F.first("fields").alias("fields"))
    first = forms.groupBy(*group_cols, "form").agg(F.count("*").alias("texts"), F.min_by("fields", F.struct(*KEYS)).alias("first_fields")).filter("texts > 1")
    told_apart = F.when(same_fields(F.col("fields"), F.col("first_fields")), F.col("form")).otherwise(-multiset_hash(F.col("fields"), 3))
    return forms.join(first, [*group_cols, "form"]).select(*group_cols, *KEYS, told_apart.alias("form")).groupBy(*group_cols, *KEYS).agg(F.min("form").alias("form"))


def format_classes(records: DataFrame, group_cols: list[str], id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their fingerprints, and the classes ``group_cols, KEYS, first_row, copies`` of equal records.

    Texts are read once: the fingerprints are written to the checkpoint folder and read from there.
    """
    rows = cut_lineage(_fingerprints(records, group_cols, id_col, F.col(text_col)))
    flat = rows.groupBy(*group_cols, *KEYS).agg(F.min("row_id").alias("first_row"), F.count("*").alias("copies"))
    form_of = _merged_forms(rows, group_cols)
    merged = flat.join(form_of, [*group_cols, *KEYS]).groupBy(*group_cols, "form").agg(F.min("first_row").alias("form_first"), F.sum("copies").alias("form_copies"))
    of_forms = form_of.join(merged, [*group_cols, "form"]).select(*group_cols, *KEYS, "form_first", "form_copies")
    classes = flat.join(of_forms, [*group_cols, *KEYS], "left").select(
        *group_cols, *KEYS, F.coalesce("form_first", "first_row").alias("first_row"), F.coalesce("form_copies", "copies").alias("copies")
    )
    return rows.drop("fields", "form"), classes


def format_copies(records: DataFrame, group_cols: list[str], id_col: str, text_col: str) -> DataFrame:
    """``group_cols, first_row, copy_row``: one row for each row of a group but its first."""
    rows, classes = format_classes(records, group_cols, id_col, text_col)
    return rows.join(classes.filter("copies > 1"), [*group_cols, *KEYS]).filter("row_id <> first_row").select(*group_cols, "first_row", F.col("row_id").alias("copy_row"))


def collapsed_records(records: DataFrame, group_cols: list[str], id_col: str, text_col: str) -> DataFrame:
    """``group_cols, first_row, copies``: one row for each record, however often and in whatever format it was stored."""
    _, classes = format_classes(records, group_cols, id_col, text_col)
    return classes.groupBy(*group_cols, "first_row").agg(F.max("copies").alias("copies"))
