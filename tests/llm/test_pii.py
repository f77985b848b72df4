"""Recognisers on hand-made texts, checksums, redaction, odd tables."""

import pytest
from pyspark.sql import functions as F

from casemill.llm.pii import dni, find_pii, find_spans, iban, learn_given_names, luhn, mod11, mod97, redact, redact_column

FOUND = [
    ("Contact person Vesna Quillstone (+44 20 7946 0299).", [("NAME", "Vesna Quillstone"), ("PHONE", "+44 20 7946 0299")]),
    ("Referred by Dr Å. Hedrosa, reachable at (555) 013-7081 or a.hedrosa@ward.example.", [("NAME", "Å. Hedrosa"), ("PHONE", "(555) 013-7081"), ("EMAIL", "a.hedrosa@ward.example")]),
    ("mail zoe77 at okawabe-med dot test or anna [at] x.test, b @ y.test", [("EMAIL", "zoe77 at okawabe-med dot test"), ("EMAIL", "anna [at] x.test"), ("EMAIL", "b @ y.test")]),
    ("Registered under NIR 9 69 07 99 128 059 28.", [("ID", "9 69 07 99 128 059 28")]),
    ("SSN 978-16-1666, MRN: 79330423, passport no. XZ9168416, record #918-7670", [("ID", "978-16-1666"), ("ID", "79330423"), ("ID", "XZ9168416"), ("ID", "918-7670")]),
    ("The chart (no. 004131228773) belongs to Sorrenby, Joaquim.", [("ID", "004131228773"), ("NAME", "Sorrenby, Joaquim")]),
    ("lives at 28 Quarrel Road with her aunt Renée van der Drumgarrow", [("ADDRESS", "28 Quarrel Road"), ("NAME", "Renée van der Drumgarrow")]),
    ("Apt 39C, 139 Harrow Street, Haldorp; P.O. Box 502; 7-11-8 Higashi-Kirihata; Calle Tres Molinos 133, 8º B", [("ADDRESS", "Apt 39C, 139 Harrow Street"), ("ADDRESS", "P.O. Box 502"), ("ADDRESS", "7-11-8 Higashi-Kirihata"), ("ADDRESS", "Calle Tres Molinos 133")]),
    ("12 rue des Érables-Creux; Mühlgrabenstraße 206, 00095 Sarnath-Hill; House 80, Gbondo Junction Road", [("ADDRESS", "12 rue des Érables-Creux"), ("ADDRESS", "Mühlgrabenstraße 206"), ("ADDRESS", "House 80, Gbondo Junction Road")]),
    ("queries call ０３－００００－９４０９ or 5550196765", [("PHONE", "０３－００００－９４０９"), ("PHONE", "5550196765")]),
]
NOTHING = [
    "The Marlowick–Brelle score was 4.", "A positive Torvane sign at Torvane Memorial Hospital.", "kit lot 5634-94909, Catalogue no. 5933-74924, protocol 6825-63870, pump model XQ226638, accession XX794311",
    "Ethics approval 7646-43152 was granted by Klinikum Grünwede.", "The Clinic Street cohort in São Marelo county.", "Admitted 2013-02-17, BP 117/80, 5–7 days, 12/6/20", "AST 5 U/L. He took vitamin K. Haemodialysis helped.",
    "Lassa fever in Santa-Orelia", "identified recordings; document version 12", "", "   ", None,
]


@pytest.mark.parametrize("text, expected", FOUND)
def test_found(text, expected):
    got = [(s.kind, text[s.start : s.end]) for s in find_spans(text)]
    assert [(k, v if k != "ADDRESS" else v[: len(e)]) for (k, v), (_, e) in zip(got, expected)] == expected and len(got) == len(expected)


@pytest.mark.parametrize("text", NOTHING)
def test_nothing(text):
    assert find_spans(text) == []


def test_checksums():
    assert luhn("4539578763621486") and not luhn("4539578763621487")
    n = "9690799128059"
    assert mod97(n + f"{97 - int(n) % 97:02d}") and not mod97(n + "00")


@pytest.mark.parametrize("text", ["A Kaplan Meier curve of Staphylococcus Aureus by Ziehl Neelsen stain.", "He flew from Sierra Leone to Addis Ababa.", "ID number 4539578763621487.", "The card 4539 5787 6362 1487 was found.", "Key 1 80 05 75 123 456 29 on the lid.", "Pay to GB82 WEST 1234 5698 7654 33."])
def test_refuted(text):
    assert find_spans(text) == []


@pytest.mark.parametrize("text, value", [("ID number 4539578763621486.", "4539578763621486"), ("IBAN DE89 3704 0044 0532 0130 00 was given", "DE89 3704 0044 0532 0130 00"), ("Pay to GB82WEST12345698765432.", "GB82WEST12345698765432"), ("(ID: 1234567)", "1234567"), ("NIE: X1234567L", "X1234567L"), ("DNI 12345678Z", "12345678Z"), ("Patient-ID: 884123", "884123"), ("NHS number 943 476 5919", "943 476 5919")])
def test_confirmed_or_labelled(text, value):
    assert [(s.kind, text[s.start : s.end]) for s in find_spans(text)] == [("ID", value)]


def test_check_digits():
    assert iban("GB82 WEST 1234 5698 7654 32") and not iban("GB82 WEST 1234 5698 7654 33") and dni("12345678Z") and not dni("12345678A") and dni("X1234567L") and mod11("9434765919") and not mod11("9434765918")
    right, wrong = (next(s.score for s in find_spans(f"NHS number 943 476 591{d}")) for d in "98")
    assert right > 0.9 > 0.7 > wrong


def test_given_names_are_learnt_from_the_corpus(spark):
    families = ["Ashvale", "Brelle", "Hedrosa", "Tanimori", "Nakaseko", "Quistorp", "Marlow"]
    texts = [f"Nurse Zorvina {f} saw the patient." for f in families] + ["Nurse Once Ashvale left.", None, ""]
    names = learn_given_names([spark.createDataFrame([(t,) for t in texts], "t string")])
    assert "zorvina" in names and "once" not in names and "mary" in names
    text = "Later Zorvina Oyinlade wrote to Ashvale, Zorvina about Kaplan Meier."
    assert [text[s.start : s.end] for s in find_spans(text, given_names=names)] == ["Zorvina Oyinlade", "Ashvale, Zorvina"]


def test_redaction_keeps_the_rest():
    assert redact("Call Vesna Quillstone on +44 20 7946 0299, please.") == "Call [NAME] on [PHONE], please."
    assert redact(None) is None and redact("") == "" and redact("nothing") == "nothing"


def test_offsets_count_code_points():
    assert [s.start for s in find_spans("😅 é call +44 20 7946 0299")] == [9]


def test_long_text():
    text = "He was well. " * 60_000 + "Signed: Kofi Haverlund, St. Odile Infirmary"
    assert [(s.kind, text[s.start : s.end]) for s in find_spans(text)] == [("NAME", "Kofi Haverlund")]


def test_table(spark):
    rows = [(1, "SSN 978-16-1666", "a"), (1, "SSN 978-16-1666", "b"), (2, None, "c"), (None, "SSN 978-16-1666", "d"), (3, "", "e")]
    df = spark.createDataFrame(rows, "id long, t string, kind string")
    got = {tuple(r) for r in find_pii(df, "t", {"row_id": F.col("id")}).collect()}
    assert got == {(1, "ID", 4), (None, "ID", 4)}
    assert [r["r"] for r in redact_column(df, "t", "r").orderBy("kind").collect()] == ["SSN [ID]", "SSN [ID]", None, "SSN [ID]", ""]
    assert find_pii(df.limit(0), "t", {"row_id": F.col("id")}).count() == 0
