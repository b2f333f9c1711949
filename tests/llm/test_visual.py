"""Texts that look the same."""

import unicodedata
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from weftlens.llm import visual as V

ALIKE = V._look_alike_map()


def plain(text):
    """The same by the definition, one character after the other."""
    out = []
    for i, ch in enumerate(text):
        if ch == "‍" and 0 < i < len(text) - 1:
            before = text[i - 2] if text[i - 1] in "️︎" and i > 1 else text[i - 1]
            if V.glyph_tables().picture[ord(before)] and V.glyph_tables().picture[ord(text[i + 1])]:
                out.append(ch)
                continue
        out += map(chr, V._visible_parts(ch, ALIKE))
    return unicodedata.normalize("NFC", "".join(out))


LETTERS = st.sampled_from(list("aeo Ab1.\n") + ["̀", "́", "̣", "̇", "ọ", "é", "ǖ", "ａ", "Ｚ", "９", "​", "‍", "﻿", " ", " ", "о", "а", "ο", "ɡ", "😂", "👨", "👩", "️", "ß", "ﬁ", "가", "ᄀ", "ᅡ", "が", "𝐚", "é"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(LETTERS, max_size=12), max_size=5))
def test_against_definition(texts):
    assert V.glyph_tables().canonical(texts) == [plain(t) for t in texts]


def test_neighbours_in_a_batch_play_no_part():
    pieces = ["👨", "\u200d👨", "👨\u200d", "👨\ufe0f", "\ufe0f\u200d👩", "x", "\u0301", "e", "\u1161", "\u1100", "\u200d", "👩"]
    alone = {t: V.glyph_tables().canonical([t])[0] for t in pieces}
    for a in pieces:
        for b in pieces:
            assert V.glyph_tables().canonical([a, b]) == [alone[a], alone[b]], (a, b)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(LETTERS, max_size=12), max_size=6))
def test_one_by_one(texts):
    assert V.glyph_tables().canonical(texts) == [V.glyph_tables().canonical([t])[0] for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(LETTERS, max_size=12), max_size=4))
def test_places(texts):
    forms, places = V.glyph_tables().canonical_with_places(texts)
    for i, (text, form) in enumerate(zip(texts, forms)):
        if i not in places:
            assert form == text
            continue
        begin, behind = places[i]
        assert len(begin) == len(behind) == len(form)
        for letter, b, e in zip(form, begin, behind):  # a character comes from what its places hold
            shown = V.glyph_tables().canonical([text[b:e]])[0] + text[b:e]
            assert 0 <= b < e <= len(text) and set(unicodedata.normalize("NFD", letter)) <= set(unicodedata.normalize("NFD", shown))


@settings(max_examples=200, deadline=None)
@given(st.text(LETTERS, max_size=20))
def test_idempotent(text):
    once = V.glyph_tables().canonical([text])
    assert V.glyph_tables().canonical(once) == once


def test_same_looks():
    same = ["kọ̀wé résumé", "kọ̀wé résumé".replace("ò", "ò"), "ｋọ̀wé résumé", "kọ̀​wé résumé", "kọ̀wé résumé".replace("e", "е")]
    assert len(set(V.glyph_tables().canonical(same))) == 1
    different = ["kọ̀wé", "kọwé", "kòwé", "Kọ̀wé", "kọ̀wé!", "k0wé", "kọ̀ wé"]
    assert len(set(V.glyph_tables().canonical(different))) == len(different)
    family, people = "👨‍👩‍👧", "👨👩👧"
    assert V.glyph_tables().canonical([family, people]) == [family, people]


def test_edges():
    assert V.glyph_tables().canonical([None, "", "plain", "​", "́"]) == [None, "", "plain", "", "́"]
    long = "é" * 1_000_000
    assert V.glyph_tables().canonical([long, "é"]) == [long, "é"]
    assert V.glyph_tables().canonical([]) == []
    assert list(V.text_slices(["a" * 10, None, "b" * 10], 15)) == [(0, 2), (2, 3)]


def test_pairs(spark):
    rows = [(1, "Café money"), (2, "Café money"), (3, "Café money"), (4, "Cаfé money"), (5, "cafe money"), (6, None), (7, ""), (8, "😂"), (9, "😂​"), (10, "ａ"), (11, "a"), (11, "a")]
    df = spark.createDataFrame(rows, "row_id long, t string").selectExpr("row_id", "t", "1 as look_hi", "'x' as src")
    keys = V.look_keys(df, "row_id", "t").selectExpr("'k' as src_table", "*")
    got = {(r.row_a, r.row_b) for r in V.look_alike_pairs(keys, ["src_table"]).distinct().collect()}
    want = {tuple(sorted((i, j))) for (i, a), (j, b) in combinations([r for r in rows if r[1] and plain(r[1]) and any(c.isalnum() for c in r[1])], 2) if a != b and plain(a) == plain(b)}
    assert got == want == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (10, 11)}
    assert V.look_alike_pairs(keys.limit(0), ["src_table"]).count() == 0
    classes = V.look_alike_classes(keys, ["src_table"]).distinct().collect()
    assert {(a.row_id, b.row_id) for a in classes for b in classes if a.row_id < b.row_id and a.look_class == b.look_class and a.text_class != b.text_class} == want
    assert V.look_alike_classes(keys.limit(0), ["src_table"]).count() == 0


def test_hot_class_meets_no_copies_of_itself(spark):
    df = spark.range(30_000).selectExpr("id as row_id", "case when id = 17 then 'hellо' else 'hello' end as t")
    assert V.look_alike_pairs(V.look_keys(df, "row_id", "t").selectExpr("'k' as s", "*"), ["s"]).count() == 29_999


def test_canonical_text_keeps_columns(spark):
    df = spark.createDataFrame([(1, "ａ", [1]), (2, None, None)], "row_id long, t string, other array<int>")
    assert [tuple(r) for r in V.canonical_text(df, "t").orderBy("row_id").collect()] == [(1, "ａ", [1], "a"), (2, None, None, None)]
