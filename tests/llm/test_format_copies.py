"""Copies hidden by formatting, against brute force."""

import re
from itertools import combinations

import pytest
import regex

from weftlens.llm.format_copies import collapsed_records, format_copies

ROWS = [
    (1, "Town: Wabiru | Children: 3 | View: money is not all, they say"),
    (2, "children = 3 ; TOWN - wabiru ; view: Money is not all they say"),
    (3, "Town Wabiru Children 3 View money is not all they say"),  # punctuation lost: equals 1 in order, and 2 through it
    (4, "Town: 3 | Children: Wabiru | View: money is not all, they say"),  # values under other labels
    (5, "  “hello   World!” "),
    (6, "HELLO WORLD"),
    (7, "hello world 2"),
    (8, "héllo world"),
    (9, None),
    (10, ""),
    (11, "!!! ... =|"),
    (12, "😂😂"),
    (13, "world hello"),
    (14, "hello\tworld\n."),
    (15, "A: x; A: x; B: y"),
    (16, "B: y; A: x; A: x"),
    (17, "A: x; B: y; B: y"),
    (18, "x" * 20_000 + " Y"),
    (19, "X" * 20_000 + ", y"),
]


def flat(t):
    return regex.sub(r"[\s\p{Z}\p{P}=|]+", "", t.lower())


def fields(t):
    pieces = [p for p in re.split(r"\n|;|\||\s/\s", t) if re.search(r"\w", p)]
    found = [re.match(r"^\W*?([^\W\d_][\w' ]*?)\s*(?:[:=]|\s[-–]\s)(.*)$", p) for p in pieces]
    return sorted((flat(m[1]), flat(m[2])) for m in found) if len(pieces) >= 2 and all(found) else None


def brute():
    usable = [(i, t) for i, t in ROWS if t and re.search(r"[^\W_]", t)]
    parent = {i: i for i, _ in usable}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in combinations(usable, 2):
        if flat(a) == flat(b) or (fields(a) is not None and fields(a) == fields(b)):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return {(root(i), i) for i, _ in usable if root(i) != i}


@pytest.fixture(scope="module")
def records(spark):
    df = spark.createDataFrame(ROWS, "id long, record string")
    return df.selectExpr("id", "record", "'a' as src", "1 as flat", "2 as first_row", "'x' as fields")  # clashing names


def test_against_brute_force(records):
    got = {(r.first_row, r.copy_row) for r in format_copies(records, ["src"], "id", "record").collect()}
    assert got == brute()
    assert (1, 2) in got and (1, 3) in got and (5, 6) in got and (5, 14) in got and (15, 16) in got and (18, 19) in got
    assert not any(x in (4, 7, 8, 9, 10, 11, 12, 13, 17) for pair in got for x in pair)


def test_counts(records):
    copies = {r.first_row: r.copies for r in collapsed_records(records, ["src"], "id", "record").collect()}
    assert copies[1] == 3 and copies[5] == 3 and copies[4] == 1 and copies[15] == 2 and 9 not in copies
    assert sum(copies.values()) == len([1 for _, t in ROWS if t and re.search(r"[^\W_]", t)])


def test_hot_group_and_groups_apart(spark):
    df = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 'Same, text' else concat('own ', id) end as record", "case when id < 1500 then 'a' else 'b' end as src")
    got = format_copies(df, ["src"], "id", "record").groupBy("src", "first_row").count().collect()
    assert {(r.src, r.first_row, r["count"]) for r in got} == {("a", 0, 499), ("b", 1500, 499)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, record string, src string")
    assert format_copies(df, ["src"], "id", "record").count() == 0
    assert collapsed_records(df, ["src"], "id", "record").count() == 0
