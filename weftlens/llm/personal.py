"""Personal information in free text (problem 6): find it, name its kind, replace it by a placeholder.

Offset-preserving deobfuscation by two transducers in a row, each of which gives every character it emits its place in
what it read. The first brings a text to its consistent form (look-alike letters, invisible characters, full-width
digits; see ``visual``). The second (``undisguise``) emits digits for spelled digits, ``@`` and ``.`` for "at" and "dot" in
addresses of mail, and single spaced-out characters as one word. All identifiers are detected in what comes out, and
their spans are carried back through both, so that the rest of the source stays untouched.

Kinds: EMAIL, PHONE, ID (national, tax or passport number behind its word), ADDRESS (street, plot or box), NAME (given
name with surname in any order or case, with initials, or run together in a handle). Words are weighed as names by a
model of their letters (``NameModel``), in which standing in the list of given names is one feature; a surname is a word
beside a given name that isn't a common word of the languages at hand.

Defined cases: null stays null without a kind; empty stays empty; texts are read whole; a span belongs to one kind, mail
before address, number and name; a text with several kinds has one row per kind.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlens.llm.visual import glyph_tables
from weftlens.runtime import ship_package, spread

KINDS = ("EMAIL", "ADDRESS", "ID", "PHONE", "NAME")

# Given names common in East and West Africa, and the biblical and English ones in use there.
GIVEN_NAMES = frozenset(
    """
abdul abdi abigail achieng adaeze adaobi ade adebayo agnes ahmed aisha akinyi alex alice ali amaka amina andrew angela anna
anne anthony atieno auma awino ayo babatunde beatrice ben bernard binta blessing bola brenda brian caleb caroline catherine
charity charles chidi chika chinedu chioma christine chuka collins cynthia daniel david deborah dennis diana dorcas edward
elijah elizabeth emeka emmanuel eric esther eunice evans faith fatima fatuma felix florence folake francis fred funke gabriel
george gideon gladys grace halima hamisi hannah hassan hauwa henry hope ibrahim ifeoma ikenna isaac ismail jackson jacob james
jane janet joan john joseph joy joyce juma kamau kelvin kevin khadija kunle lilian linda lucy lydia maina margaret martha martin
mary mercy michael miriam mohammed moses musa mutua naomi ngozi njeri njoroge nkechi obinna ochieng odhiambo oluwaseun omondi
otieno patrick paul peter philip purity rachel rehema rose ruth safiya salim samuel sarah segun simon sola stephen tunde
uche victor wambui wanjiku wanjiru yusuf zainab
""".split()
)
#: Of these, the ones that are English words: in lower case they count only beside an unmistakable surname.
WORD_NAMES = frozenset("faith grace hope joy mercy blessing charity purity victor rose martin".split())
TITLES = frozenset("mr mrs ms miss dr prof sir madam uncle aunt auntie mama baba papa sister brother pastor rev king queen saint chief mzee bishop prophet apostle alhaji mallam big little old the".split())
# The words for the digits, English, Swahili, Hausa, Yoruba and Igbo.
DIGIT_WORDS = {
    w: str(d)
    for d, words in enumerate(
        (
            "zero oh sifuri sifili odo", "one moja daya kan otu", "two mbili biyu meji abuo", "three tatu uku meta ato", "four nne hudu merin ano",
            "five tano biyar marun ise", "six sita shida mefa isii", "seven saba bakwai meje asaa", "eight nane takwas mejo asato", "nine tisa tara mesan itoolu",
        )
    )
    for w in words.split()
}

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_EMAIL = re.compile(r"(?<![\w.+-])[a-z0-9](?:[a-z0-9_%+.-]*[a-z0-9_])?\s?@\s?[a-z0-9-]+(?:\.[a-z0-9-]{2,})+", re.I)
_PLAIN_AT = re.compile(r"@|[\[({<]\s*at\s*[\])}>]", re.I)
_STREET = r"(?:street|st|road|rd|lane|ln|avenue|ave|drive|dr|close|crescent|cres|way|court|boulevard|blvd|highway|estate)"
_ADDRESS = (
    re.compile(r"\b(?:p\.?\s?o\.?\s?box|p\.?\s?m\.?\s?b\.?|s\.?l\.?p\.?|sanduku\s+la\s+posta)\s*(?:no\.?\s*)?\d[\d-]*(?:,\s*[^\W\d_]+)?", re.I),
    re.compile(rf"\b(?:plot|house|hse|flat|door|block|unit|apartment|apt|suite|no)\b\.?\s*\d+[a-z]?\b,?\s+(?:\d+\s+)?(?:off\s+)?(?:[^\W\d_]+\s+){{1,3}}{_STREET}\b", re.I),
    re.compile(rf"(?<![\w.,:/-])\d{{1,5}}[a-z]?,?\s+(?:off\s+)?(?:[^\W\d_]+\s+){{1,3}}{_STREET}\b", re.I),
    re.compile(r"(?:\b(?:plot|house|flat|door|block|no)\b\.?\s*\d+[a-z]?\b,?\s+(?:off\s+)?)?(?:(?<![\w.,:/-])\d{1,5}[a-z]?,?\s+)?(?<=[\d\w,] )(?:mtaa|barabara|njia)\s+(?:wa|ya|la)\s+[^\W\d_]+(?:\s+[A-Z][^\W\d_]+)?", re.I),
    re.compile(r"\bplot\s+(?:no\.?\s*)?\d+[a-z]?\b(?:,?\s+(?!na\b|and\b|of\b)[A-Z][^\W\d_]+){1,2}"),
)
_AREA_WORDS = frozenset("the a an my our your this that in on to of and for away next new every long same other by was is are homes hours years times men boys".split())
_ID = re.compile(
    r"\b(?:national\s+id(?:entity)?(?:\s+(?:number|no\.?|card))?|id(?:entity)?\s*(?:number|no\.?|card|num)|id|nin|bvn|ssn|passport(?:\s*(?:number|no\.?))?|(?:tax|kra)\s*(?:pin|id|number)|tin|kitambulisho(?:\s+(?:namba|nambari))?|pasipoti)"
    r"\s*(?:is|ni|na)?\s*[:#.=-]?\s*(?P<v>[a-z]{0,2}\s?\d(?:[\d -]*\d)?[a-z]?)(?!\w)",
    re.I,
)
_ID_CODE = re.compile(r"(?<![\w@#])[A-Z]\d{9}[A-Z](?!\w)")
_NUMBER = re.compile(r"(?<![\w#@/.,:-])[+(]{0,2}\d(?:[\s().\-/]{0,3}\d){5,19}(?![\w/:]|,\d)")
_GROUPED = re.compile(r"\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}$|\d{4}[/-]\d{1,2}[/-]\d{1,2}$")
_SAYING = re.compile(r"[^\W_]")
_HANDLE = re.compile(r"(?<![\w@.])@?[^\W\d_]+(?:[._-][^\W\d_]+)*\d*(?![\w@])")
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


#: What the second transducer reads: addresses of mail in disguise, spaced-out characters around an @, words, digits.
_MAIL_WORD = r"[a-z0-9_%+.-]*[a-z0-9_]"
_SAY_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+)"
_SAY_AT = r"(?:\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+|\s*@\s*)"
_SAID_MAIL = re.compile(rf"(?<![\w.+@-]){_MAIL_WORD}(?:{_SAY_DOT}{_MAIL_WORD})*{_SAY_AT}[a-z0-9-]+(?:(?:{_SAY_DOT}|\.)[a-z0-9-]+)+", re.I)
_SAID_SIGNS = re.compile(rf"({_SAY_AT})|({_SAY_DOT})", re.I)
_SPACED_OUT = re.compile(r"(?<!\S)[^\W_](?: [\w.+-]){1,} @(?: [\w.-]){3,}(?!\S)")
_SAID_DIGIT = "|".join(sorted(DIGIT_WORDS, key=lambda w: (-len(w), w)))
_SAID_NUMBER = re.compile(rf"(?<!\w)(?:(?:double|triple)\s+)?(?:{_SAID_DIGIT}|\d{{1,9}})(?:[\s,.-]+(?:(?:double|triple)\s+)?(?:{_SAID_DIGIT}|\d{{1,9}})(?!\w))+", re.I)
_SAID_PART = re.compile(rf"(?:(double|triple)\s+)?({_SAID_DIGIT}|\d+)(?!\w)", re.I)
_TIMES = {"double": 2, "triple": 3}


def _spoken_number(m: re.Match) -> list[tuple[str, int, int]] | None:
    """The digits of a run that is at least partly spelled, each with its place; None for a run that is plain digits."""
    found, spelled = [], 0
    for part in _SAID_PART.finditer(m.string, m.start(), m.end()):
        word = part[2].lower()
        digits = DIGIT_WORDS.get(word)
        spelled += digits is not None
        if digits is None:
            found += [(d, part.start(2) + k, part.start(2) + k + 1) for k, d in enumerate(word)] if not part[1] else [(word, part.start(), part.end())]
        else:
            found += [(digits, part.start(), part.end())] * _TIMES.get((part[1] or "").lower(), 1)
    return found if spelled >= 2 and sum(len(d) for d, _, _ in found) >= 6 else None


def _spoken_mail(m: re.Match) -> list[tuple[str, int, int]] | None:
    """A mail address with its signs said; None where nothing marks it as one ("at" and a plain full stop are prose)."""
    shown = m.group()
    signs = list(_SAID_SIGNS.finditer(shown))
    at = next((k for k, sign in enumerate(signs) if sign[1]), None)
    if at is None or not (_PLAIN_AT.search(shown) or any(sign[2] for sign in signs[at:])):
        return None
    if all(sign.group() == "@" for sign in signs):
        return None  # nothing to undo
    found, here = [], 0
    for sign in signs:
        found += [(c, m.start() + here + k, m.start() + here + k + 1) for k, c in enumerate(shown[here : sign.start()])]
        found.append(("@" if sign[1] else ".", m.start() + sign.start(), m.start() + sign.end()))
        here = sign.end()
    return found + [(c, m.start() + here + k, m.start() + here + k + 1) for k, c in enumerate(shown[here:])]


def _spaced_out(m: re.Match) -> list[tuple[str, int, int]]:
    return [(c, m.start() + k, m.start() + k + 1) for k, c in enumerate(m.group()) if c != " "]


def undisguise(form: str) -> tuple[str, np.ndarray | None]:
    """The text with disguises undone, and the places of its characters in ``form`` (two rows: from, up to); None if equal."""
    low = form.lower()
    rules = []
    if "@" in form or re.search(r"\bat\b", low):
        rules += [(_SPACED_OUT, _spaced_out), (_SAID_MAIL, _spoken_mail)]
    if _SAID_WORDS.search(low):
        rules.append((_SAID_NUMBER, _spoken_number))
    edits: list[tuple[int, int, list[tuple[str, int, int]]]] = []
    taken = bytearray(len(form))
    for pattern, undo in rules:
        for m in pattern.finditer(form):
            done = undo(m)
            if done and not any(taken[m.start() : m.end()]):
                taken[m.start() : m.end()] = b"\1" * len(m.group())
                edits.append((*m.span(), done))
    if not edits:
        return form, None
    out, begin, behind, here = [], [], [], 0
    for b, e, done in [*sorted(edits), (len(form), len(form), [])]:
        out.append(form[here:b])
        begin.append(np.arange(here, b))
        behind.append(np.arange(here, b) + 1)
        for shown, x, y in done:
            out.append(shown)
            begin.append(np.full(len(shown), x))
            behind.append(np.full(len(shown), y))
        here = e
    return "".join(out), np.stack((np.concatenate(begin), np.concatenate(behind))).astype(np.int64)


#: Two digit words near each other: what makes a text worth reading for spelled numbers.
_SAID_WORDS = re.compile(rf"(?:\b(?:{_SAID_DIGIT})\b[\s,.\d-]*(?:double\s+|triple\s+)?){{2}}")


class NameModel:
    """How much a word looks like a personal name: log odds of its letters between given names and common words.

    Letters are read with the two before them (borders count); each context is smoothed towards the shorter one. The list
    of given names is both the sample of names and, as a feature of its own, worth ``LISTED``.
    """

    LISTED = 4.0

    def __init__(self, names: Iterable[str], common: Iterable[str]) -> None:
        self.listed = frozenset(names)
        self.common = frozenset(common)
        self.odds: dict[str, float] = {}
        self.counts = [self._count(self.listed), self._count(w for w in self.common - self.listed if len(w) > 2)]

    @staticmethod
    def _count(words: Iterable[str]) -> dict[str, float]:
        found: dict[str, float] = defaultdict(float)
        for word in words:
            bordered = f"^^{word}$"
            for i in range(2, len(bordered)):
                for n in (0, 1, 2):
                    found[bordered[i - n : i + 1]] += 1
                    found[f"{bordered[i - n : i]}*{n}"] += 1
        return dict(found)

    def _log(self, counts: dict[str, float], word: str) -> float:
        bordered, total = f"^^{word}$", 0.0
        for i in range(2, len(bordered)):
            p = 1 / 40
            for n in (0, 1, 2):
                context = counts.get(f"{bordered[i - n : i]}*{n}", 0.0)
                p = (counts.get(bordered[i - n : i + 1], 0.0) + 4 * p) / (context + 4)
            total += float(np.log(p))
        return total

    def word(self, word: str) -> float:
        """Evidence that a (lower-case) word is a name; common words have none."""
        known = self.odds.get(word)
        if known is None:
            if len(self.odds) > 200_000:
                self.odds.clear()
            letters = self._log(self.counts[0], word) - self._log(self.counts[1], word)
            known = self.LISTED + letters if word in self.listed else -self.LISTED if word in self.common else letters
            self.odds[word] = known
        return known


def _is_phone(shown: str, digits: str) -> bool:
    if _GROUPED.match(shown.strip()):
        return False
    if shown.lstrip("(").startswith("+"):
        return 9 <= len(digits) <= 15
    if digits.startswith("00"):
        return 11 <= len(digits) <= 16
    if digits[0] == "0":
        return 9 <= len(digits) <= 11
    return 11 <= len(digits) <= 13 and digits[:3] in ("234", "254", "255", "256", "233", "250", "251", "237", "221", "225") or (digits[:2] in ("27", "44") and len(digits) in (11, 12))


def _surname(word: str, common: frozenset[str], at_least: int = 4) -> bool:
    low = word.lower()
    return len(word) >= at_least and low not in common and low not in TITLES and word.isalpha()


def _like_case(given: str, other: str) -> bool:
    return given[0].isupper() == other[0].isupper()


def _alone(text: str, begin: int, end: int) -> bool:
    """Whether a span is all of a text but signs."""
    return _SAYING.search(text, 0, begin) is None and _SAYING.search(text, end) is None


def _names(text: str, words: Sequence[re.Match], common: frozenset[str]) -> Iterator[tuple[int, int]]:
    """Names that begin, or end, with a given name of the list."""
    n = len(words)
    taken = -1
    for i, m in enumerate(words):
        given = m.group()
        low = given.lower()
        if i <= taken or low not in GIVEN_NAMES or (m.start() and text[m.start() - 1] in "@#"):
            continue
        least = 7 if given[0].islower() and low in WORD_NAMES else 6 if given[0].islower() else 4
        j, end, sure = i, m.end(), None
        while j + 1 < n and j < i + 3:  # initials and further given names, then the surname
            other = words[j + 1]
            between = text[end : other.start()]
            if between.strip(" .") or "\n" in between or (between.strip() and len(words[j].group()) > 1):
                break
            word = other.group()
            if word.lower() in GIVEN_NAMES:
                if low in WORD_NAMES and word.lower() in WORD_NAMES and word[0].islower():
                    break
                j, end = j + 1, other.end()
                sure = (j, end)  # two given names are a name, whatever follows
            elif len(word) == 1:
                j, end = j + 1, other.end()
            else:
                if _like_case(given, word) and _surname(word, common, least):
                    sure = (j + 1, other.end())
                break
        if sure is not None:
            taken = sure[0]
            yield m.start(), sure[1]
        elif i:
            before = words[i - 1]
            between = text[before.end() : m.start()]
            if (between.strip() == "," or (not between.strip() and _alone(text, before.start(), end))) and _like_case(given, before.group()) and _surname(before.group(), common, max(5, least)):
                yield before.start(), m.end()
                taken = i


# Words with which people introduce somebody by name, and words that merely announce a person.
_INTRODUCES = re.compile(
    r"(?:\b(?:my|his|her|your|whose|full|the)\s+(?:full\s+)?names?\s+(?:is|was|are|na)|\b(?:called|named|signed|sincerely|regards)|\bjina\s+(?:langu|lake)\s+ni|\bnaitwa|\banaitwa|\bsunana|\bsunansa|\borúkọ\s+mi\s+ni|\baha\s+m\s+bụ"
    r"|\b(?:mr|mrs|ms|dr|prof|rev)\.?)[\s,:—-]+$",
    re.I,
)
_ANNOUNCES = re.compile(r"(?:\bi\s+am|\bi['’]m|\bthis\s+is|\b(?:ask(?:\s+for)?|contact|call|text|thanks?|yours|meet|met|dear|tell|told|know|knows|help|muulize|pastor|sir|madam))[\s,:—-]+$", re.I)
#: Words behind a pair of words that make it a place, a street or a show.
_NO_PERSON = frozenset("street st road rd lane ln avenue ave drive dr close crescent way court highway estate market town village city county state river lake hill school church hospital hotel show podcast talks radio tv channel club bus station".split())
_PLACE_BEFORE = re.compile(r"\b(?:in|at|from|near|to|of|off|via|between|kutoka|hadi|katika|mtaa|barabara|njia|lake|mount|fort|port|the)\s+$", re.I)
#: What two unlisted words must reach to count as a name behind a word that announces a person.
LEAST_EVIDENCE = -13.0


def _unlisted_names(text: str, words: Sequence[re.Match], model: NameModel) -> Iterator[tuple[int, int]]:
    """Pairs of capitalised words (with an initial between them, or not) behind words that introduce somebody by name, or
    that announce a person where the letters don't speak against it. A pair that stands alone is left: nothing tells an
    unlisted name from a nickname there."""
    for i, m in enumerate(words[:-1]):
        first = m.group()
        if not first[0].isupper() or (first.isupper() and not text.isupper()) or len(first) < 3 or (m.start() and text[m.start() - 1] in "@#_."):
            continue
        j = i + 1
        if len(words[j].group()) == 1 and j + 1 < len(words):
            j += 1
        last = words[j]
        between = text[m.end() : last.start()]
        word = last.group()
        if between.strip(" ." + text[words[i + 1].start()]) or "\n" in between or len(word) < 3 or not word[0].isupper():
            continue
        behind = words[j + 1].group().lower() if j + 1 < len(words) and not text[last.end() : words[j + 1].start()].strip() else ""
        if behind in _NO_PERSON or text[last.end() : last.end() + 1].isdigit() or _PLACE_BEFORE.search(text[max(0, m.start() - 24) : m.start()]):
            continue
        low, second = first.lower(), word.lower()
        if {low, second} & TITLES or second in _NO_PERSON or low in _NO_PERSON:
            continue
        known = len({low, second} & model.common)
        head = text[max(0, m.start() - 40) : m.start()]
        if known < 2 and _INTRODUCES.search(head):
            yield m.start(), last.end()
        elif not known and _ANNOUNCES.search(head) and model.word(low) + model.word(second) >= LEAST_EVIDENCE:
            yield m.start(), last.end()


def _handle_name(handle: str, common: frozenset[str]) -> bool:
    bare = handle.lstrip("@").rstrip("0123456789")
    pieces = [p for part in re.split(r"[._-]", bare) for p in (_CAMEL.findall(part) if not (part.islower() or part.isupper()) else [part])]
    if len(pieces) < 2:
        return False
    low = [p.lower() for p in pieces]
    for k in (0, len(low) - 1):
        rest = low[1:] if k == 0 else low[:-1]
        if low[k] in GIVEN_NAMES and all(p.isalpha() for p in rest) and any(_surname(p, common) or p in GIVEN_NAMES for p in rest):
            return True
    return False


def find_personal(form: str, common: frozenset[str], model: NameModel | None = None) -> list[tuple[int, int, str]]:
    """Spans ``(begin, end, kind)`` in a text of consistent form, in order and without overlaps."""
    plain, places = undisguise(form)
    found = _find(plain, common, model)
    if places is None:
        return found
    return [(int(places[0, b:e].min()), int(places[1, b:e].max()), kind) for b, e, kind in found]


def _find(form: str, common: frozenset[str], model: NameModel | None) -> list[tuple[int, int, str]]:
    found: list[tuple[int, int, str]] = []
    taken = bytearray(len(form))

    def add(begin: int, end: int, kind: str) -> None:
        if not any(taken[begin:end]):
            taken[begin:end] = b"\1" * (end - begin)
            found.append((begin, end, kind))

    if "@" in form:
        for m in _EMAIL.finditer(form):
            add(*m.span(), "EMAIL")
    if any(c in form for c in "0123456789"):
        for pattern in _ADDRESS:
            for m in pattern.finditer(form):
                inner = [w.lower() for w in re.findall(r"[^\W\d_]+", m.group())[:-1]]
                if any(map(str.isdigit, m.group())) and not _AREA_WORDS.intersection(inner):
                    add(*m.span(), "ADDRESS")
        for m in _ID.finditer(form):
            if sum(map(str.isdigit, m.group("v"))) >= 6:
                add(*m.span("v"), "ID")
        for m in _ID_CODE.finditer(form):
            add(*m.span(), "ID")
        for m in _NUMBER.finditer(form):
            digits = "".join(filter(str.isdigit, m.group()))
            if _is_phone(m.group(), digits):
                add(*m.span(), "PHONE")
    words = list(_WORD.finditer(form))
    if not GIVEN_NAMES.isdisjoint(m.group().lower() for m in words):
        for begin, end in _names(form, words, common):
            add(begin, end, "NAME")
    for m in _HANDLE.finditer(form) if "@" in form else (x for x in (_HANDLE.fullmatch(form.strip()),) if x):
        if m.group()[0] == "@" or m.group() == form.strip():
            begin = m.start() if m.string is form else form.index(m.group())
            if _handle_name(m.group(), common):
                add(begin, begin + len(m.group()), "NAME")
    if model is not None and len(words) > 1:
        for begin, end in _unlisted_names(form, words, model):
            add(begin, end, "NAME")
    return sorted(found)


def redact(source: str, spans: Sequence[tuple[int, int, str]], places: np.ndarray | None) -> str:
    """The source with each span replaced by ``[KIND]``; ``places`` maps characters of the form to the source."""
    out, at = [], 0
    for begin, end, kind in spans:
        b, e = (begin, end) if places is None else (int(places[0, begin:end].min()), int(places[1, begin:end].max()))
        out += [source[at:b], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, source[at:]])


def personal_spans(df: DataFrame, id_col: str, text_col: str, common_words: Sequence[str]) -> DataFrame:
    """``row_id, kinds, redacted``: the distinct kinds found in a text (empty array if none) and the text with placeholders."""
    spark = df.sparkSession
    ship_package(spark)
    common = frozenset(w.lower() for w in common_words)
    shared = spark.sparkContext.broadcast((common, glyph_tables(), NameModel(GIVEN_NAMES, common)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, tables, model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            forms, places = tables.canonical_with_places(texts)
            kinds, redacted = [], []
            for i, (text, form) in enumerate(zip(texts, forms)):
                spans = find_personal(form, common, model) if form else []
                kinds.append(sorted({k for _, _, k in spans}))
                redacted.append(redact(text, spans, places.get(i)) if spans else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(redacted, pa.string())], names=["row_id", "kinds", "redacted"])

    return spread(df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("t"))).mapInArrow(run, "row_id long, kinds array<string>, redacted string")
