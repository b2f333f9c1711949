"""Text normalisers, tokenisers, keys and clock expressions: Column in, Column out, all inside code generation.

Every function gives null for a null input unless its text says otherwise; empty strings stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"https?://\S+|www\.\S+"
MENTION = r"@[A-Za-z0-9_.-]+"
HASHTAG = r"#[A-Za-z0-9_]+"
#: Pictographs, symbols and their joiners.
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]+"


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def straight_quotes(c: Column) -> Column:
    return F.translate(c, "‘’‚“”„", "''" + "'" + '"""')


def clean_comment(c: Column) -> Column:
    """Straight quotes, single spaces, trimmed. Full compatibility folding is an operator (it needs more than expressions)."""
    return squeeze(straight_quotes(c))


def filter_form(c: Column) -> Column:
    """The form keyword filters compare: lower case, straight quotes, single spaces."""
    return squeeze(F.lower(straight_quotes(c)))


def match_form(c: Column) -> Column:
    """Lower case, one apostrophe, other punctuation but ``#`` as spaces."""
    return squeeze(F.regexp_replace(F.lower(straight_quotes(c)), r"[^\p{L}\p{N}\p{M}#' ]+", " "))


def hashtag_form(c: Column) -> Column:
    """Lower case with punctuation kept, for terms that start with ``#``."""
    return squeeze(F.lower(c))


def compact_form(c: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def duplicate_key(c: Column) -> Column:
    """Lower case without links, mentions, tag signs and anything that isn't a letter or digit."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), URL, " "), MENTION, " ")
    return F.regexp_replace(bare, r"[^\p{L}\p{N}]+", "")


def strip_links_mentions(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(c, URL, " "), MENTION, " "))


def strip_decorations(c: Column) -> Column:
    """Without pictographs."""
    return squeeze(F.regexp_replace(c, EMOJI, ""))


def decode_entities(c: Column) -> Column:
    """The five named entities and the no-break space; ``&amp;`` last, so that one level is undone."""
    out = c
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def deep_decode(c: Column, rounds: int = 4) -> Column:
    """Entities encoded several times over."""
    for _ in range(rounds):
        c = decode_entities(c)
    return c


def join_key(c: Column) -> Column:
    """Entities, quotes, the ellipsis sign, white space and case levelled, for matching texts across files."""
    return squeeze(F.lower(F.replace(straight_quotes(deep_decode(c)), F.lit("…"), F.lit("..."))))


def keep_lines(c: Column) -> Column:
    """Spaces within lines collapsed, at most one empty line in a row, trimmed."""
    out = F.regexp_replace(c, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+\z", "")


def cell_text(c: Column) -> Column:
    """A cell's value: no-break spaces and quotes levelled, trimmed, one full stop at the end dropped (an ellipsis stays)."""
    out = squeeze(F.replace(straight_quotes(c), F.lit(" "), F.lit(" ")))
    return F.when(out.endswith(".") & ~out.endswith(".."), F.trim(F.regexp_replace(out, r"\.\z", ""))).otherwise(out)


def tidy_joined(c: Column) -> Column:
    """Tokens joined by spaces: no space before punctuation or inside contractions, single spaces."""
    out = F.regexp_replace(c, r"\s+([,.!?;:])", "$1")
    out = F.regexp_replace(out, r"\s+'(s|t|re|ve|ll|d|m) ", "'$1 ")
    return squeeze(out)


def option_key(c: Column) -> Column:
    """``&`` as and, ``e.g.`` as eg, then lower-case letters and digits in single spaces."""
    out = F.replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), F.lit("e.g."), F.lit("eg"))
    return F.trim(F.regexp_replace(out, r"[^a-z0-9]+", " "))


def slug(c: Column, most: int = 60, sep: str = "_") -> Column:
    """A safe file or sheet name."""
    out = F.regexp_replace(F.lower(c), r"[^a-z0-9]+", sep)
    return F.substring(F.regexp_replace(out, f"^{sep}+|{sep}+$", ""), 1, most)


def words_by_space(c: Column) -> Column:
    """Number of pieces between white space; 0 for blank."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def words_by_boundary(c: Column) -> Column:
    """Number of runs of ASCII letters, digits and underscores."""
    return F.regexp_count(c, F.lit(r"[A-Za-z0-9_]+"))


def alpha_words(c: Column) -> Column:
    """Number of runs of ASCII letters and apostrophes."""
    return F.regexp_count(c, F.lit(r"[A-Za-z']+"))


def longest_word(c: Column) -> Column:
    """Length of the longest run of ASCII letters; 0 if there is none."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit(r"([A-Za-z]+)"), 1), F.length)), F.when(c.isNotNull(), F.lit(0)))


def ascii_ratio(c: Column) -> Column:
    """Share of ASCII characters; null for an empty text."""
    return F.length(F.regexp_replace(c, r"[^\x00-\x7F]", "")) / F.nullif(F.length(c), F.lit(0))


def clip(c: Column, limit: int) -> Column:
    """The first ``limit`` characters, cut back to a word and marked with an ellipsis if anything was cut."""
    cut = F.regexp_replace(F.substring(c, 1, limit), r"\s+\S*\z", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, F.lit("...")))


def first_sentence(c: Column, limit: int = 200) -> Column:
    """Up to the first stop, clipped."""
    return clip(F.trim(F.regexp_extract(c, r"^([^.!?]*[.!?]?)", 1)), limit)


def evidence_window(c: Column, patterns: list[str], around: int = 40, most: int = 160) -> Column:
    """The text around the first pattern that matches (in the order given), with ellipses where it was cut; '' without one."""
    out = F.lit("")
    for p in reversed(patterns):
        at = F.regexp_instr(c, F.lit(p))
        begin = F.greatest(at - around, F.lit(1))
        size = F.least(at + around, F.length(c) + 1) - begin
        piece = F.substring(F.concat(F.when(begin > 1, F.lit("...")).otherwise(F.lit("")), c.substr(begin, size), F.when(begin + size <= F.length(c), F.lit("...")).otherwise(F.lit(""))), 1, most)
        out = F.when(at > 0, piece).otherwise(out)
    return F.when(c.isNotNull(), out)


def urls(c: Column) -> Column:
    """All links of a text in order."""
    return F.regexp_extract_all(c, F.lit(r"(https?://[^\s()]+)"), 1)


def split_two_urls(c: Column) -> Column:
    """``struct(first, second)`` of a cell with a link and, in brackets, the link of the post it answers."""
    found = urls(c)
    return F.struct(F.get(found, F.lit(0)).alias("first"), F.get(found, F.lit(1)).alias("second"))


def combined_url(reply: Column, post: Column) -> Column:
    """The reply's link with the post's in brackets; either alone; empty if neither."""
    has_reply, has_post = F.coalesce(reply, F.lit("")) != "", F.coalesce(post, F.lit("")) != ""
    return F.when(has_reply & has_post, F.concat(reply, F.lit(" ("), post, F.lit(")"))).when(has_reply, reply).when(has_post, post).otherwise(F.lit(""))


def hashtags(c: Column) -> Column:
    """Tags in order, each once, joined by ``; ``."""
    return F.array_join(F.array_distinct(F.regexp_extract_all(c, F.lit(f"({HASHTAG})"), 1)), "; ")


def mentions(c: Column) -> Column:
    """Mentioned names without the sign, in order, each once, joined by ``; ``."""
    return F.array_join(F.array_distinct(F.regexp_extract_all(c, F.lit(r"@([A-Za-z0-9_]+)"), 1)), "; ")


def human_count(c: Column) -> Column:
    """``1.2k``, ``3M``, ``1,234`` as a number; anything else 0."""
    plain = F.lower(F.trim(F.replace(c, F.lit(","), F.lit(""))))
    number = F.regexp_extract(plain, r"^([0-9]+(?:\.[0-9]+)?)[km]?\z", 1)
    scale = F.when(plain.endswith("k"), 1_000).when(plain.endswith("m"), 1_000_000).otherwise(1)
    return F.when(F.coalesce(number, F.lit("")) != "", F.round(F.nullif(number, F.lit("")).cast("double") * scale).cast("long")).otherwise(F.lit(0).cast("long"))


def truthy(c: Column) -> Column:
    """Whether a mixed value says yes; null says no."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "y", "t"), F.lit(False))


def id_text(c: Column) -> Column:
    """A number read as a float becomes the text of its whole part; other values their text."""
    text = c.cast("string")
    return F.regexp_replace(text, r"^(-?[0-9]+)\.0+\z", "$1")


def content_key(c: Column, namespace: str) -> Column:
    """sha1 of a namespace and the trimmed text, for caches."""
    return F.sha1(F.concat(F.lit(f"{namespace}::"), F.trim(c)))


def short_hash(c: Column) -> Column:
    """The first 16 hex digits of sha256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def seconds_of_clock(c: Column) -> Column:
    """``[HH:]MM:SS[.mmm]`` (a comma will do) as seconds; null if it isn't one."""
    shape = c.rlike(r"^\d+:\d{2}(:\d{2})?([.,]\d+)?$")
    pieces = F.split(F.replace(c, F.lit(","), F.lit(".")), ":")
    total = F.aggregate(pieces, F.lit(0.0), lambda a, p: a * 60 + p.cast("double"))
    return F.when(shape, total)


def clock_of_seconds(c: Column) -> Column:
    """Seconds as ``HH:MM:SS.mmm``."""
    ms = F.round(c * 1000).cast("long")
    return F.when(c.isNotNull(), F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000))


def pretty_count(c: Column) -> Column:
    """1,234 / 12.3K / 4.5M."""
    return F.when(c >= 1_000_000, F.format_string("%.1fM", c / 1_000_000)).when(c >= 10_000, F.format_string("%.1fK", c / 1000)).when(c.isNotNull(), F.format_number(c, 0))


def three_class(label: Column) -> Column:
    """positive, negative, and neutral for anything else."""
    low = F.lower(F.trim(label))
    return F.when(low.isin("positive", "negative"), low).otherwise(F.lit("neutral"))


def percent_text(n: Column, d: Column) -> Column:
    """``12.5%``; ``0.0%`` for a zero or missing denominator."""
    return F.format_string("%.1f%%", F.coalesce(100.0 * n / F.nullif(d, F.lit(0)), F.lit(0.0)))


def number_text(c: Column, places: int = 6) -> Column:
    """A number with so many places for files; empty for null."""
    return F.when(c.isNotNull(), F.format_string(f"%.{places}f", c.cast("double"))).otherwise(F.lit(""))


def parsed_time(c: Column, *formats: str) -> Column:
    """The first format that fits, null if none does."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats))


def language_guess(c: Column, marks: str, foreign: list[str], function_words: list[str], least: int = 2) -> Column:
    """en / other / unknown by a ladder: tell-tale letters, marker words, function words, share of ASCII."""
    low = F.lower(c)
    hits = sum((F.when(low.rlike(rf"(^|[^a-z]){w}([^a-z]|$)"), 1).otherwise(0) for w in function_words), F.lit(0))
    markers = sum((F.when(low.rlike(rf"(^|[^a-z]){w}([^a-z]|$)"), 1).otherwise(0) for w in foreign), F.lit(0))
    return (
        F.when(c.isNull() | (F.trim(c) == ""), F.lit("unknown"))
        .when(low.rlike(f"[{marks}]"), F.lit("other"))
        .when(markers >= 2, F.lit("other"))
        .when(hits >= least, F.lit("en"))
        .when(ascii_ratio(c) < 0.9, F.lit("other"))
        .otherwise(F.lit("unknown"))
    )
