"""Personal information."""

import itertools
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftlens.llm.personal import GIVEN_NAMES, NameModel, find_personal, personal_spans, redact, undisguise
from weftlens.llm.visual import glyph_tables

COMMON = frozenset("the and house help find work who was there my name is ask please nobody thank you always".split())


def kinds(text):
    (form,) = glyph_tables().canonical([text])
    return [k for _, _, k in find_personal(form, COMMON)] if form else []


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("write to jane.roe+x@mail.example.org now", ["EMAIL"]), ("jane_4 at mail dot example dot org", ["EMAIL"]), ("jane[at]example.com", ["EMAIL"]), ("JANE (AT) EXAMPLE (DOT) COM", ["EMAIL"]), ("meet me at home. dot", []),
        ("call +254 912 345 678", ["PHONE"]), ("0912-345-678", ["PHONE"]), ("(+234) 901-234567", ["PHONE"]), ("2 5 4 9 1 2 3 4 5 6 7 8", ["PHONE"]), ("zero nine one two three four five six seven eight", ["PHONE"]), ("sifuri tisa moja mbili tatu nne tano sita saba nane", ["PHONE"]), ("０９１２３４５６７８", ["PHONE"]),
        ("order #99817263", []), ("on 14/03/2021", []), ("KSh 25,400 to KSh 31,950", []), ("12,000,233 views", []), ("1899400217335500127", []), ("go to 17:40:12", []),
        ("my ID number 99576957", ["ID"]), ("passport no ZZ 9983555", ["ID"]), ("NIN: 9992-7705-969", ["ID"]), ("kitambulisho 99885126", ["ID"]), ("X990569091Q", ["ID"]), ("the id is nice", []),
        ("Plot 12 Mkoma Lane", ["ADDRESS"]), ("P.O. Box 94323-00803, Rimberu", ["ADDRESS"]), ("House 9, off Kisima Road", ["ADDRESS"]), ("Flat 7B, 6 Mtaa wa Nyuki", ["ADDRESS"]), ("no. 9 OLD FERRY ROAD", ["ADDRESS"]), ("two streets away from the market", []), ("9 hours on the road", []),
        ("my name is Wanjiru N. Talavunile", ["NAME"]), ("ask ruth warimwetho, who was there", ["NAME"]), ("RUTH EZEGBANIRE", ["NAME"]), ("Ezegbanire, Ruth", ["NAME"]), ("Ezegbanire Ruth", ["NAME"]), ("@RuthOluvunile", ["NAME"]), ("@ruth_okelimora45", ["NAME"]), ("ruth.okelimora", ["NAME"]),
        ("see Grace Achieng today", ["NAME"]), ("john dot doe at gmail dot com", ["EMAIL"]), ("j a n e @ m a i l . c o m", ["EMAIL"]), ("write to me at jane+x at mail dot org", ["EMAIL"]), ("call zero nine one 2 3 4 5 6 7 8", ["PHONE"]), ("zero nine one double two three four triple five six", ["PHONE"]), ("my id is one two three four five six seven eight", ["ID"]), ("one of us met two or three people", []),
        ("King Solomon would have", []), ("The Slow Farmer Show", []), ("@havako506", []), ("@zedusu_sokinga121", []), ("thank you always, faith always", []), ("Ruth", []), ("mama ruth", []), ("", []),
    ],
)
def test_kinds(text, wanted):
    assert kinds(text) == wanted


def test_rest_stays_untouched():
    text = "Ｈｉ 😂 — wri​te to jаne@ex​ample.com​, or +254 912 345 678!‍"
    (form,), places = glyph_tables().canonical_with_places([text])
    out = redact(text, find_personal(form, COMMON), places[0])
    assert out == "Ｈｉ 😂 — wri​te to [EMAIL]​, or [PHONE]!‍"


def shown(text, model=None):
    (form,), places = glyph_tables().canonical_with_places([text])
    return redact(text, find_personal(form, COMMON, model), places.get(0))


def test_spans_come_back_to_the_source():
    assert shown("\u1112\u1161\u11ab \u1100\u1161 call 0712345678 please") == "\u1112\u1161\u11ab \u1100\u1161 call [PHONE] please"
    assert shown("İİİİ call zero seven one two three four five six seven eight please") == "İİİİ call [PHONE] please"
    assert shown("write john dot doe at gmail dot com!") == "write [EMAIL]!" and shown("e\u0301 jane\u200b [at] mаil (dot) org e\u0301") == "e\u0301 [EMAIL] e\u0301"


NOISE = st.lists(st.sampled_from(["a", "b", ".", " ", ",", "e\u0301", "İ", "\u1100\u1161", "\u200b", "ﬁ", "😂", "ａ", "\u0323\u0301", "ß"]), max_size=15).map("".join)


@settings(max_examples=300, deadline=None)
@given(NOISE, st.sampled_from(["0712345678", "zero seven one two three four five six seven eight", "jane@mail.org", "jane at mail dot org", "０７１２３４５６７８", "jаne@mail.org"]), NOISE)
def test_nothing_else_is_touched(before, secret, after):
    text = f"{before} | {secret} | {after}"
    out = shown(text)
    kind = "EMAIL" if "mail" in secret else "PHONE"
    assert out == f"{before} | [{kind}] | {after}"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["zero", "one", "double", " ", "at", "dot", "@", ".", "mail", "7", "x", ", "]), max_size=14).map("".join))
def test_undisguise_places(text):
    plain, places = undisguise(text)
    if places is None:
        assert plain == text
    else:
        assert places.shape == (2, len(plain)) and (places[0] < places[1]).all() and (places[1] <= len(text)).all() and (places[0][1:] >= places[0][:-1]).all()


# invented texts with names of other regions, none of them in the list
OTHERS = "Kwabena Asare;Priya Sharma;Chukwuemeka Okonkwo;Nakato Babirye;Tendai Moyo;Thabo Nkosi;Adwoa Mensah;Fatoumata Diallo;Moussa Traore;Lindiwe Dlamini;Carlos Ramirez;Sofia Rossi;Olena Kovalenko;Hiroshi Tanaka;Liam Gallagher;Emily Thompson;Yaw Boateng;Zodwa Mthembu;Abebe Bekele;Selam Tesfaye;Rajesh Kumar;Aminata Sow;Ingrid Larsen;Wangari Maathai;Temitope Balogun;Barasa Wekesa;Nekesa Simiyu;Kiprono Koech".split(";")
FRAMES = ["my name is {} and i agree", "Ask {} about the house", "This was said by Dr. {} on the show", "jina langu ni {}", "please help {} find work", "I met {} there"]


def test_names_outside_the_list():
    model = NameModel(GIVEN_NAMES, COMMON)
    cases = [f.format(n) for f, n in itertools.product(FRAMES, OTHERS)]
    assert not any(set(n.lower().split()) & GIVEN_NAMES for n in OTHERS)
    found = sum("[NAME]" in shown(t, model) for t in cases)
    assert found >= 0.9 * len(cases), found / len(cases)
    plain = ["we drove from Ritobi to Lake Turumbe", "I met Old Ferry Road people", "watch Iron Kiln and Mwamba Talks", "ask The Slow Farmer Show", "he is at Plot 12 Mkoma Lane", "call Radio Kisima now", "Blue Drummer", "Iron Baobab"]
    assert not any("[NAME]" in shown(t, model) for t in plain), [shown(t, model) for t in plain]


def test_long_texts_take_linear_time():
    began = time.time()
    out = shown("Ask Ruth Okelimora or Grace, my name is Thabo Nkosi, call 0912345678 or write to jane at mail dot org. " * 4000, NameModel(GIVEN_NAMES, COMMON))
    assert out.count("[NAME]") == 8000 and out.count("[PHONE]") == 4000 and out.count("[EMAIL]") == 4000 and time.time() - began < 60


def test_operator(spark):
    rows = [(1, "Ask Ruth Okelimora, call 0912345678"), (2, None), (3, ""), (4, "nothing"), (5, "x" * 100_000 + " jane@example.com")]
    got = {r.row_id: r for r in personal_spans(spark.createDataFrame(rows, "row_id long, t string"), "row_id", "t", COMMON).collect()}
    assert got[1].kinds == ["NAME", "PHONE"] and got[1].redacted == "Ask [NAME], call [PHONE]"
    assert got[2].redacted is None and got[3].redacted == "" and got[4].redacted == "nothing" and got[5].redacted.endswith(" [EMAIL]")
    assert personal_spans(spark.createDataFrame([], "row_id long, t string"), "row_id", "t", COMMON).count() == 0
