"""Personal information inside free text: e-mail addresses, phone numbers, identity numbers, addresses, names.

Regular expressions propose spans, checksum validators (Luhn, mod 97, mod 23, mod 11) confirm or refute
numbers, and words nearby raise or lower the score; spans at or above the threshold are kept, the better
one where two overlap. A number without a label needs a right check; under a general label a wrong check
refutes it; under the name of its kind a wrong check lowers the score, which other signs must make up for,
as invented numbers count. Names need a given name, common or learnt from the corpus, or a cue. Offsets count code points of the stored text. Placeholders keep the rest readable.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

THRESHOLD = 0.5
KINDS = ("EMAIL", "PHONE", "ID", "ADDRESS", "NAME")

# Vocabularies of the recognisers.
#: Common given names of many countries; further ones are learnt from the corpus by learn_given_names.
GIVEN_NAMES = """
james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen daniel nancy matthew lisa
anthony margaret mark sandra steven ashley paul kimberly andrew emily joshua donna kenneth michelle kevin carol brian amanda george melissa edward deborah peter anna
hans karl klaus wolfgang ursula ingrid heike sabine jean pierre michel marie claire sophie nathalie jose juan carlos luis miguel maria carmen isabel lucia giovanni
marco giulia francesca olga ivan dmitri svetlana natalia mohammed ahmed ali fatima hassan omar aisha yusuf wei li ming hiroshi yuki kenji takeshi raj priya anil sunita
kwame kofi amina chidi ngozi lars erik anders karin jan piet
""".split()
NOT_A_NAME = """
a about according additional admitted after all also although an and antibiotic antibody antigen apparently april apr assay at aug august autumn ave
avenue background bacteria bank because before blood blvd boulevard both but by c call calle dear care case cases catalogue center central centre chapare chart
children clinic clinica clinical clinicians clinique college commonly conclusion conclusions contact contacts correspondence costs county court crescent cycle
daily data day days dec december dengue department dept despite dia discussion disease district doctor documents dr drive during each early eastern ebola
ecg elisa emergency ethics events evening exposure fall fatal february feb fever figure first following for fort friday from fund general generally
gram group haemodialysis haemorrhagic hanta hantavirus harbour he health hepatitis her herr highland hill his history hospital house however
i icu id if igg igm ii iii image in increasing infection infirmary influenza initial initially institut institute institution instead interview is isolate
isolates it its jan january japan jul july june junction klinikum la laboratory lactate lake landlord lane lassa later lateral le learning left library
local london lot low lp mail main mainly malaria mar march masked mass may measles medical medicine medecin memorial metagenomic methods middle mild minor
model monday monte month months morning mother mount mr mri mrn mrs ms municipal my national nervous new next nhs nir night no non normal north northern
not notably note nov november number nurse oct october of office old on one only open or other our outbreak outpatient paired paragraph parish part
past patient patients pcr pediatric people phone photographs physical please pmid polymerase port prof professor protocol province public puumala
quality recovery reference referred regional registered report reportedly republic research results review ringer river road royal room rt saint
samples san santa sao saturday school science score section sent sep sept september sequence series serology serum service services severe she shore
signed signs sister sodium some south southern special square ssn st state station still street study such sunday supportive surgery sygehus symptoms syndrome
table telephone temperature test tests that the their then there therefore these they this those thursday title to trauma travel treatment tuesday two typically
type under union unit university upper urgent urinalysis valley vero virology virus vitamin wales ward was wednesday week weeks west western when where which white
while winter with without women world year years
dx ct bp alt ast ldh crp dna rna ngo who usa uk eu vital ecmo hiv tb primarily often mostly usually apt box po rue straße strasse haus platz ave reached live lives
home fever-charts kin relatives employer unfallklinik spital hôpital hopital hospitalier universitaire university-hospital krankenhaus centro médico medico general-hospital
schüttelfrost übelkeit hôpitaux événement café naïve une un der die das ein eine el los las les des du de del
""".split()
STREETS = "Street St Road Rd Avenue Ave Lane Ln Blvd Boulevard Crescent Court Drive Way Place Close Terrace Square Row Gardens Walk Highway Parkway Mews Quay".split()
AFTER_NO_NAME = "sign score grade scale catheter syndrome disease test stain reaction criteria county valley province district parish region hospital clinic institute infirmary centre center laboratory street road bulletin fund cohort virus fever university regional memorial".split()
BEFORE_NAME = "by person name named kin patient aunt uncle brother sister mother father wife husband son daughter neighbour neighbor nurse physician surgeon colleague interpreter labelled courtesy signed correspondence contact interview dr prof ms mr mrs miss mme herr frau sr sra".split()
BEFORE_INITIAL = "vitamin hepatitis type grade group class stage vero influenza factor haemophilus protein complement coagulation section table figure appendix".split()
NOT_AN_ID = "trial protocol device lot study sample accession approval catalogue batch kit model ethics grant pump probe serial".split()
TITLES = ("dr", "prof", "ms", "mr", "mrs", "miss", "mme", "herr", "frau", "sr", "sra")


def _letters(upper: bool) -> str:
    """A character class of Latin letters beyond ASCII, by rule."""
    kind = "Lu" if upper else "Ll"
    return "".join(chr(c) for c in range(0xC0, 0x250) if unicodedata.category(chr(c)) == kind)


_UP = "A-Z" + _letters(True) + "√├┼╟ﾃﾅΓГ"
_NC = r"�A-Za-z'’¡-ɏ̀-ͯ‘-›€™∀-⋿─-◿｡-ﾟЀ-џ "
_CAP = rf"(?:[OD]['’])?[{_UP}][{_NC}]+(?:[-‐][{_UP}](?:['’][{_UP}])?[{_NC}]+)*"
_INIT = rf"[{_UP}][̀-ͯ]?\."
_PART = r"(?:van|von|der|den|de|la|del|dos|das|da|di|du|le|ten|ter|bin|ibn|el|zu|af)"
_OPENS = r"(?<![^\s(\[{\"“«„:,;>—–])"
_FIRST = rf"(?:{_CAP}|{_INIT}(?: ?{_INIT})?)"
_NAME = re.compile(rf"{_OPENS}(?:({_FIRST})((?: {_INIT}){{0,2}}) ((?:{_PART} ){{0,2}}(?:al-)?{_CAP})|((?:{_PART} ){{0,2}}(?:al-)?{_CAP}), ({_CAP}(?: {_INIT})?))(?![\w-])")
_TITLED = re.compile(rf"\b(?:Dr|Prof|Ms|Mr|Mrs|Miss|Mme|Herr|Frau|Sra?)\.? ((?:{_PART} )?{_CAP})(?![\w-])")
#: What tells that a person is named next.
_PERSON_CUE = re.compile(r"(?:\b(?:belongs? to|belonging to|signed|named|called|patient|person|nurse|physician|doctor|surgeon|colleague|interpreter|aunt|uncle|brother|sister|mother|father|wife|husband|son|daughter|neighbou?r|kin|correspondence|contact|author|call|phone|ask|reach|dear|Dr|Prof|Mrs?|Ms)\b[.:,;]?[\s\"“(]*|ourtesy of )$", re.IGNORECASE)
_NEXT = re.compile(r"[\s,]*([A-Za-z]+)")
_MORE = re.compile(rf" (?:{_INIT} )?(?:{_PART} ){{0,2}}(?:al-)?{_CAP}")
_BEFORE = re.compile(r"([^\W\d_]+)[.:,;(\s\"“—–]*$")

_EMAIL = re.compile(
    r"(?<![\w.+%-])[\w%+'-][\w.%+'-]*(?: ?[@＠] ?| ?[\[({<] ?at ?[\])}>] ?)[\w-]+(?:(?:\.| ?[\[({<] ?dot ?[\])}>] ?)[\w-]+)+"
    r"|(?<![\w.+%-])[\w%+-][\w.%+-]* at [\w-]+(?: dot [\w-]+)+",
    re.IGNORECASE,
)
_PHONE = re.compile(
    r"(?<![\w+.#-])(?<!\d/)(?:"
    r"\+\d{1,3}(?:[ .\-/]?(?:\(0\)|\(\d{1,5}\)|\d{1,5})){1,6}"
    r"|00[1-9]\d{0,2}(?:[ .\-/](?:\(0\)|\(?\d{1,5}\)?)){2,6}"
    r"|\(\d{2,5}\)[ .\-]?\d{3,4}(?:[ .\-]\d{2,4}){0,3}"
    r"|0\d{1,4} ?/ ?\d{2,4}(?:[ -]?\d{2,5}){1,3}"
    r"|0\d{1,4}(?:[ .\-]\d{2,4}){2,4}"
    r"|(?:1[ .\-])?\d{3}([ .\-])\d{3}\1\d{4}"
    r"|\d{10,11}"
    r")(?: ?(?:ext\.?|x|extension) ?\d{1,5})?(?![\w-])"
)
_PHONE_CUE = re.compile(r"(?:call|phone|tel|mobile|fax|reach|left|contact|lists|kin|number|ring|dial|whats)\w*\b[^!?\n]{0,60}$|/$", re.IGNORECASE)
_ID_VALUE = r"(?!(?:SSN|NIR|MRN|ID|NHS)\b)(?:[A-Z]{1,3}[- ]?)?\d[\dA-Z]*(?:[ /\-.](?:\d+[A-Z]?|[A-Z](?![a-z'’.]))(?![a-z]))*"
_ID = re.compile(
    r"\b(?P<label>SSN|social security(?: (?:number|no\.?))?|NIR|N[uú]mero de identidad|DNI|NIE|CPF|MRN|medical record(?: (?:number|no\.?))?|record(?: (?:number|no\.?))?|hospital (?:number|no\.?|ID)"
    r"|(?:patient|person|citizen|resident)(?:'s)?[ -]?(?:ID|identifier|number|no\.?)|passport(?: (?:number|no\.?))?|(?:health )?insurance(?: (?:number|no\.?|ID|policy))?|national (?:ID|identity|insurance|health)(?: (?:number|no\.?|card))?"
    r"|identity (?:card|number|no\.?)|ID[ -]card|ID[ -]?(?:number|no\.?)|My Number|NHS(?: (?:number|no\.?))?|document(?: (?:number|no\.?))?|tax (?:ID|number)|driver'?s licen[cs]e|licen[cs]e (?:number|no\.?)|ID|Registered under|no\.)"
    rf"(?: card| number| no\.?| is)?[\s:#№.=]*(?P<value>{_ID_VALUE})",
    re.IGNORECASE,
)
_VALUE_CASE = re.compile(_ID_VALUE)
_BARE_ID = re.compile(r"(?<![\w/.-])(?:\d{3}-\d{2}-\d{4}|[1-478] ?\d{2} ?(?:0[1-9]|1[0-2]|[2-9]\d) ?\d[\dAB] ?\d{3} ?\d{3} ?\d{2}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4})(?![\w/-])")
_IBAN = re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?(?!\w)")
_STREET = "|".join(STREETS)
_ADDRESS = re.compile(
    rf"(?<![\w-])(?:"
    rf"(?:Apt|Apartment|Flat|Unit|Suite)\.? ?#?\d*[A-Za-z]?\d*, ?\d{{1,5}}[A-Za-z]? (?:[{_UP}][\w'’.-]* ){{1,3}}(?:{_STREET})\b"
    rf"|(?:House|Plot|Block|Villa)(?: No\.?)? ?\d{{1,5}}[A-Za-z]?, ?(?:[{_UP}][\w'’.-]* ){{1,4}}(?:{_STREET})\b"
    rf"|\d{{1,5}}[A-Za-z]?,? (?:[{_UP}][\w'’.-]* ){{1,3}}(?:{_STREET})\b"
    rf"|\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|av\.|boulevard|bd|allée|impasse|chemin|place|quai|route|cours|passage|square) (?:de la |de l['’]|des |du |de |d['’])?[^\s,.;]+"
    rf"|(?:Calle|Avenida|Avda?\.?|Plaza|Paseo|Camino|Carrera|Travesía|C/) ?(?:de la |del |de los |de las |de )?[^\s,]+(?: [^\s,\d]+){{0,3}},? (?:n[.º°]* ?)?\d{{1,4}}"
    rf"|[{_UP}][\w'’.-]*(?:straße|strasse|str\.|weg|platz|allee|gasse|kamp|ring|damm|ufer|steig|pfad|markt|graben) \d{{1,4}} ?[a-z]?\b"
    rf"|(?:[{_UP}][{_NC}\x7f-\x9f-]+ )?[{_UP}][{_NC}\x7f-\x9f-]+ \d{{1,4}}[a-z]?, ?\d{{4,5}} [{_UP}]"
    rf"|\d{{1,2}}-\d{{1,2}}-\d{{1,2}},? (?:[{_UP}][\w'’]+)(?:-[\w'’]+)*"
    rf"|P\. ?O\. ?Box \d+|PO Box \d+|Post(?:fach| Office Box) \d+|B\.P\. ?\d+|Apartado(?: de correos)? \d+"
    rf")",
)
_MARK = re.compile(r" dot |[\[({<] ?at ?[\])}>]", re.IGNORECASE)
_WIDE = {0xFF10 + i: 0x30 + i for i in range(10)} | {0xFF0D: 0x2D, 0xFF0B: 0x2B, 0xFF08: 0x28, 0xFF09: 0x29, 0x2010: 0x2D, 0x2011: 0x2D, 0x2012: 0x2D, 0x2212: 0x2D}
_GIVEN, _STOP = frozenset(GIVEN_NAMES), frozenset(NOT_A_NAME)
_NO_AFTER, _NAME_BEFORE, _NO_INITIAL, _NO_ID = map(frozenset, (AFTER_NO_NAME, BEFORE_NAME, BEFORE_INITIAL, NOT_AN_ID))
_PARTICLES = frozenset(_PART.strip("(?:)").split("|")) | {"al"}
_WIDE_CHARS = re.compile("[%s]" % "".join(map(chr, _WIDE)))
_FOLD: dict[str, str] = {}


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether the Luhn check digit is right."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(digits: str) -> bool:
    """Whether the two-digit key of a 15-digit national number is right (97 minus the rest)."""
    return len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:])


def iban(value: str) -> bool:
    """Whether an account number's check digits are right: moved to the end, letters as numbers from 10, the rest by 97 is 1."""
    bare = re.sub(r"\s", "", value)
    return 15 <= len(bare) <= 34 and bare.isalnum() and bare.isascii() and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def dni(value: str) -> bool:
    """Whether the letter of a Spanish number is that of the rest by 23."""
    bare = re.sub(r"[^0-9A-Z]", "", value.upper())
    bare = str("XYZ".index(bare[0])) + bare[1:] if bare[:1] in ("X", "Y", "Z") else bare
    return bool(re.fullmatch(r"\d{8}[A-Z]", bare)) and "TRWAGMYFPDXBNJZSQVHLCKE"[int(bare[:8]) % 23] == bare[8]


def mod11(digits: str) -> bool:
    """Whether the last of ten digits is 11 minus the weighted rest by 11."""
    return len(digits) == 10 and (11 - sum(int(d) * w for d, w in zip(digits, range(10, 1, -1))) % 11) % 11 == int(digits[9])


#: Kinds of numbers with a check: the form in which it applies, and the check of value and digits.
_CHECKS = {
    "nir": (re.compile(r"\D*(?:\d\D?){15}"), lambda value, digits: mod97(digits)),
    "dni": (re.compile(r"(?:\d\D?){8}[A-Z]", re.IGNORECASE), lambda value, digits: dni(value)),
    "nie": (re.compile(r"[XYZ]\W?(?:\d\W?){7}[A-Z]", re.IGNORECASE), lambda value, digits: dni(value)),
    "nhs": (re.compile(r"(?:\d\D?){10}"), lambda value, digits: mod11(digits)),
}


def checked(label: str, value: str, digits: str) -> bool | None:
    """Whether the check digit of a labelled number is right; None where its kind has none."""
    kind = label.split(" ")[0]
    if kind in _CHECKS:
        form, test = _CHECKS[kind]
        return test(value, digits) if form.fullmatch(value) else None
    return luhn(digits) if len(digits) == 16 and value.replace(" ", "").replace("-", "").isdigit() else None


def _fold(word: str) -> str:
    """A word in small letters without accents."""
    known = _FOLD.get(word)
    if known is None:
        known = "".join(c for c in unicodedata.normalize("NFD", word.casefold().replace("ø", "o").replace("ł", "l").replace("ß", "ss")) if not unicodedata.combining(c)).strip("'’")
        if len(_FOLD) > 50_000:
            _FOLD.clear()
        _FOLD[word] = known
    return known


def _stops(part: str) -> bool:
    """Whether a part of a name is an ordinary word."""
    return any(_fold(p) in _STOP or p.casefold() in _STOP for p in part.replace("-", " ").split() if p not in _PARTICLES)


def _before(text: str, at: int) -> str:
    m = _BEFORE.search(text, max(0, at - 24), at)
    return m[1].casefold() if m else ""


def _emails(text: str) -> list[Span]:
    if "@" not in text and "＠" not in text and not _MARK.search(text):
        return []
    return [Span("EMAIL", m.start(), m.end(), 0.95) for m in _EMAIL.finditer(text)]


def _addresses(text: str) -> list[Span]:
    return [Span("ADDRESS", m.start(), m.end(), 0.85) for m in _ADDRESS.finditer(text)]


def _ids(text: str) -> list[Span]:
    out = []
    for m in _ID.finditer(text):
        exact = _VALUE_CASE.match(text, m.start("value"))
        if not exact:
            continue
        value = exact[0]
        digits = re.sub(r"\D", "", value)
        if len(digits) < 4:
            continue
        score = 0.8
        if _before(text, m.start()) in _NO_ID:
            score -= 0.5
        label = m["label"].casefold()
        right = checked(label, value, digits)
        if right is not None:
            # A named kind of number with a wrong check digit may be an invented one, which counts; under a general label it is refuted.
            score += 0.15 if right else -0.2 if label.split(" ")[0] in _CHECKS else -0.5
        if re.fullmatch(r"(?:19|20)\d\d-\d\d-\d\d", value):
            score -= 0.6
        if m["label"].casefold() in ("record", "document", "registered under", "no.", "id") and len(digits) < 6:
            score -= 0.4
        out.append(Span("ID", m.start("value"), m.start("value") + len(value), score))
    for m in _BARE_ID.finditer(text):
        digits = re.sub(r"\D", "", m[0])
        sure = (len(digits) == 9 and digits[3:5] != "00" and digits[5:] != "0000") or (len(digits) == 15 and mod97(digits)) or (len(digits) == 16 and luhn(digits))
        if _before(text, m.start()) not in _NO_ID:
            # What has the form but not the key is no number of any other kind either.
            out.append(Span("ID" if sure else "", m.start(), m.end(), 0.7))
    for m in _IBAN.finditer(text):
        # Account numbers are told by their check digits alone; a wrong one is no number of any kind.
        value = m[0] if iban(m[0]) else next((m[0][:k] for k in range(len(m[0]) - 1, 14, -1) if iban(m[0][:k])), m[0])
        out.append(Span("ID" if iban(value) else "", m.start(), m.start() + len(value.rstrip()), 0.9))
    return out


def _phones(text: str) -> list[Span]:
    out = []
    for m in _PHONE.finditer(text):
        value = m[0]
        digits = sum(c.isdigit() for c in re.split("e?xt", value)[0])
        if not 8 <= digits <= 15:
            continue
        score = 0.7 if value[0] in "+(" or value.startswith("00") else 0.6
        cue = _PHONE_CUE.search(text, max(0, m.start() - 90), m.start())
        if value.isdigit():
            score = 0.35
        if cue:
            score += 0.25
        if _before(text, m.start()) in _NO_ID:
            score -= 0.4
        out.append(Span("PHONE", m.start(), m.end(), score))
    return out


def _names(text: str, given_names: frozenset[str] = _GIVEN) -> list[Span]:
    out, at = [], 0
    while m := _NAME.search(text, at):
        at = m.end()
        swapped = m[4] is not None
        given, family = (m[5], m[4]) if swapped else (m[1], m[3])
        initial = "." in given[-1:] and not swapped
        heads = [given] if not initial else []
        if _stops(family) or any(_stops(h) for h in heads):
            # An ordinary word at the start hides a name that may begin with the next word.
            step = text.find(" ", m.start(), m.end())
            at = step + 1 if step > 0 else m.end()
            continue
        known = any(_fold(p) in given_names for p in (given if not swapped else given.split()[0]).split("-"))
        if not swapped and not known and not initial and _fold(family.split()[-1]) in given_names and _MORE.match(text, m.end()):
            at = m.start(3)  # a word before a given name that is followed by the family name
            continue
        if swapped and not known and not _PERSON_CUE.search(text, max(0, m.start() - 40), m.start()):
            step = text.find(" ", m.start(), m.end())
            at = step + 1 if step > 0 else m.end()
            continue
        start = m.start()
        before = _before(text, start)
        # Two capitals alone make no person: eponyms, places and institutions look alike.
        score = 0.4 + 0.3 * known + 0.2 * (before in _NAME_BEFORE or bool(_PERSON_CUE.search(text, max(0, start - 40), start)))
        if initial:
            score = 0.55 + 0.2 * (before in _NAME_BEFORE)
            if before in _NO_INITIAL:
                score -= 0.5
        nxt = _NEXT.match(text, m.end())
        if nxt and text[m.end() : m.end() + 1] == " " and nxt[1].casefold() in _NO_AFTER:
            score -= 0.6
        if before in ("in", "at", "from", "near", "outside", "visited", "st", "santa", "san") and not known:
            score -= 0.4
        if not initial and given.isupper() != family.replace("al-", "").split()[-1].isupper() and len(given) > 1 and not known:
            score -= 0.3
        if given.isupper() and len(given) > 2 and not known:
            score -= 0.4
        out.append(Span("NAME", start, m.end(), score))
    for m in _TITLED.finditer(text):
        if not _stops(m[1]):
            out.append(Span("NAME", m.start(1), m.end(1), 0.6))
    return out


def find_spans(text: str | None, threshold: float = THRESHOLD, given_names: frozenset[str] = _GIVEN) -> list[Span]:
    """Non-overlapping spans of personal information in order of appearance; none in null, empty or blank texts.

    Of overlapping spans the one of the stronger kind stays: e-mail, address, identity number, phone, name.
    """
    if not text or text.isspace():
        return []
    plain = text.translate(_WIDE) if not text.isascii() and _WIDE_CHARS.search(text) else text
    kept: list[Span] = []
    taken = bytearray(len(plain))
    for finder in (_emails, _addresses, _ids, _phones, lambda t: _names(t, given_names)):
        for span in sorted(finder(plain), key=lambda s: (s.start, s.start - s.end)):
            if span.score >= threshold and not any(taken[span.start : span.end]):
                taken[span.start : span.end] = b"\1" * (span.end - span.start)
                if span.kind:
                    kept.append(span)
    kept.sort(key=lambda s: s.start)
    return kept


def redact(text: str | None, threshold: float = THRESHOLD, given_names: frozenset[str] = _GIVEN) -> str | None:
    """The text with each span replaced by its kind in brackets."""
    if text is None:
        return None
    out, at = [], 0
    for span in find_spans(text, threshold, given_names):
        out += [text[at : span.start], f"[{span.kind}]"]
        at = span.end
    return "".join(out) + text[at:]


#: A given name after a cue for a person, before a family name; in Java's dialect, for the pass that learns names.
LEARN_PATTERN = r"(?<![\p{L}])(?:Dr|Prof|Mr|Mrs|Ms|Mme|Herr|Frau|[Nn]urse|[Dd]octor|[Ii]nterpreter|[Aa]unt|[Uu]ncle|[Bb]rother|[Ss]ister|[Mm]other|[Ff]ather|[Ww]ife|[Hh]usband|[Ss]on|[Dd]aughter|[Nn]eighbou?r|[Pp]atient|[Pp]erson|[Kk]in|[Ss]igned|[Cc]orrespondence|[Nn]amed|[Cc]alled|[Cc]olleague)[.:,]? (\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?) (?:\p{Lu}\. ?)?(?:(?:van|von|der|de|la|del|di|da) ){0,2}\p{Lu}[\p{L}'’]+"
#: A name is learnt when it stands before LEAST_FAMILIES different family names; at most MAX_GIVEN names are kept, the most frequent ones.
LEAST_FAMILIES, MAX_GIVEN = 5, 50_000


def learn_given_names(texts: Sequence[DataFrame]) -> frozenset[str]:
    """Given names by cue and by how many family names they stand before, over all texts (tables of one text column), with the common ones.

    Native expressions and one aggregation of the few cued names, counted within tasks first; null texts teach nothing.
    A word that also stands for itself in small letters is ordinary and is no name.
    """
    whole = reduce(DataFrame.unionByName, [t.select(F.col(t.columns[0]).cast("string").alias("t")) for t in texts])
    found = whole.select(F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(f"({LEARN_PATTERN})"), F.lit(1)))).alias("hit"))
    pairs = found.select(F.regexp_extract("hit", LEARN_PATTERN, 1).alias("given"), F.regexp_extract("hit", r"(\S+)$", 1).alias("family"))
    learnt = pairs.groupBy("given").agg(F.approx_count_distinct("family").alias("families"), F.count(F.lit(1)).alias("n")).filter(F.col("families") >= LEAST_FAMILIES)
    rows = learnt.orderBy(F.desc("n"), "given").limit(MAX_GIVEN).collect()
    parts = {_fold(p) for r in rows for p in r["given"].split("-")}
    return frozenset(p for p in parts if p not in _STOP) | _GIVEN


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start_char", T.IntegerType())]))


def _span_column(names: Broadcast):
    @F.pandas_udf(_SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": s.kind, "start_char": s.start} for s in find_spans(t if isinstance(t, str) else None, given_names=names.value)] for t in texts], dtype=object)

    return spans


def _redacted_column(names: Broadcast):
    @F.pandas_udf(T.StringType())
    def redacted(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t if isinstance(t, str) else None, given_names=names.value) for t in texts])

    return redacted


def find_pii(df: DataFrame, text: str, keys: dict[str, Column], given_names: frozenset[str] = _GIVEN) -> DataFrame:
    """Distinct rows (``keys``, kind, start_char) of all items in the column ``text``.

    Rows are made distinct within each map task before the one exchange. Other columns are not read.
    """
    rows = df.select(*[c.alias(k) for k, c in keys.items()], F.col(f"`{text}`").cast("string").alias("_text")).filter(F.col("_text").isNotNull())
    found = rows.select(*keys, F.explode(_span_column(df.sparkSession.sparkContext.broadcast(given_names))("_text")).alias("s"))
    return found.select(*keys, "s.kind", "s.start_char").dropDuplicates()


def redact_column(df: DataFrame, text: str, to: str, given_names: frozenset[str] = _GIVEN) -> DataFrame:
    """``df`` with the column ``to``: the text with typed placeholders; null stays null, empty stays empty."""
    return df.withColumn(to, _redacted_column(df.sparkSession.sparkContext.broadcast(given_names))(F.col(f"`{text}`").cast("string")))
