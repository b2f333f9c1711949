"""Typed values and their entries."""

import random

import pytest

from weftlens.llm.canonical_values import Codebook, Trie, canonical_values, learned_aliases, reach, without_typos

ENTRIES = [
    ("Q2", 1, "Family and children", "home, parenting, kids"),
    ("Q2", 2, "Faith, prayer and church life", "religion, mosque"),
    ("Q2", 3, "Work and income pressure", "jobs, hustle, bills"),
    ("Q8", 15, "Absent father", "father left, fatherless"),
    ("Q8", 17, "Loneliness and isolation", "alone, no friends"),
    ("Q8", 22, "No struggle mentioned", "none"),
    ("Q8", None or 23, "Angry or confrontational", None),
]


def edits(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_edit_table():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(80)})
    trie = Trie()
    for i, w in enumerate(words):
        trie.add(w, i)
    for _ in range(300):
        value = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 7)))
        for most in range(4):
            assert {(r[2], r[0]) for r in trie.near(value, most)} == {(w, edits(w, value)) for w in words if edits(w, value) <= most}


@pytest.mark.parametrize(
    "question, cell, wanted",
    [
        ("Q2", "Family and children", [1]),
        ("Q2", "faith, prsyer and church life", [2]),
        ("Q2", "Faith, prayer and church life; HSUTLE", [2, 3]),
        ("Q2", "children & family | work n income pressure", [1, 3]),
        ("Q2", "camera problem 43, kids", [0, 1]),
        ("Q8", "angry / confrontational", [23]),
        ("Q8", "aone", [17]),
        ("Q8", "No struggle", [22]),
        ("Q8", "none\nAbsent father.", [15, 22]),
        ("Q8", "absent father, Absent father", [15]),
        ("Q8", "???", [0]),
        ("Q8", "   ", []),
        ("Q99", "Absent father", [0]),
        (None, "Absent father", [0]),
        ("Q8", "x" * 50_000, [0]),
        ("Q8", ", ".join(["alone"] * 3000), [17]),
    ],
)
def test_cells(question, cell, wanted):
    assert Codebook.build(ENTRIES).entries(question, cell) == wanted


def test_reach_grows_with_length():
    assert [reach(n) for n in (1, 3, 4, 5, 6, 10, 11, 40)] == [0, 0, 1, 1, 2, 2, 3, 3]


def test_learned_wordings(spark):
    entries = spark.createDataFrame([(q, e, t, n) for q, e, t, n in ENTRIES], "question_id string, option_id long, option_text string, note string")
    rows = [(f"c{i}", "Q8", "no dad", "Absent father") for i in range(4)] + [("c9", "Q8", "no dad", "Loneliness and isolation"), ("c1", "Q8", "no dad", "Absent father")]
    rows += [(f"d{i}", q, "camera problem", t) for i, (q, t) in enumerate([("Q8", "Absent father"), ("Q8", "Absent father"), ("Q2", "Family and children")])]
    rows += [("e1", "Q8", "alonee", "Absent father"), ("e2", "Q8", "alonee", "Absent father"), ("f", None, "x", None), ("g", "Q8", None, "Absent father"), ("h", "Q8", "a, b", "Absent father")]
    flags = spark.createDataFrame(rows, "content_id string, question_id string, typed string, cleaned string")
    found = learned_aliases(flags, entries, "question_id", "content_id", "typed", "cleaned", "option_id", "option_text")
    assert ("Q8", "no dad", 15) in found and not any(p == "camera problem" for _, p, _ in found)
    assert without_typos(found, Codebook.build(ENTRIES)) == [("Q8", "no dad", 15)]


def test_operator(spark):
    rows = [(1, "Q8", "alone", None, 7), (2, "Q8", None, "absent fathr; camera", 7), (3, "Q8", " ", "", 7), (4, "Q8", None, None, 7), (5, None, "alone", "x", 7), (1, "Q8", "alone", None, 7)]
    flags = spark.createDataFrame(rows, "flag_id long, question_id string, original_value string, cleaned_value string, option_id int")
    got = {(r.flag_id, r.option_id) for r in canonical_values(flags, Codebook.build(ENTRIES), "flag_id", "question_id", "original_value", "cleaned_value").collect()}
    assert got == {(1, 17), (2, 15), (2, 0), (5, 0)}
    assert canonical_values(flags.limit(0), Codebook.build([]), "flag_id", "question_id", "original_value", "cleaned_value").count() == 0
