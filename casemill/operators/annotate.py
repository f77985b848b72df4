"""Annotators give entity spans, words of sex and neutral words of a text.

``RuleAnnotator`` is native: cue patterns as regular expressions, no gazetteer. It stands in for a
statistical model and finds less than one; ``PandasAnnotator`` takes any function from texts to
entities, such as one that runs a language model, once per Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemill.functions import lexicons as L
from casemill.operators.spans import SPANS, no_spans, regex_spans

#: Entity labels and the mask types they become.
LABELS = {"PERSON": "NAME", "DATE": "DATE", "GPE": "LOCATION", "LOC": "LOCATION", "FAC": "LOCATION", "ORG": "ORGANIZATION"}
_CAP = r"\p{Lu}[\p{L}'’-]+"
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|January|February|March|April|June|July|August|September|October|November|December)\b\.?"
_INSTITUTION = r"(?:Hospital|Clinic|Centre|Center|Infirmary|Institute|Laboratory|Service|Sygehus|University|Clinique|Klinikum|Klinik|Hôpital|Clínica|Ospedale|Krankenhaus|Department|Ministry)"
#: Not a place or person: months, institutions, titles.
_OTHER = rf"(?!{_MONTH}|(?:{_CAP}\s){{0,4}}{_INSTITUTION}\b|(?:Dr|Ms|Mr|Mrs|Prof)\b)"
#: What stands before a place.
_PLACE_CUES = "from|visited|visiting|toured|near|outside|contacts in|Contacts in|lives in|lived in|living in|resides in|resided in|stayed in|born in|worked in|travelled to|traveled to|travelling to|traveling to|moved to|returned to|returning to|resident of|residents of|village of|town of|city of|district of|province of|region of"
_PLACE = rf"{_CAP}(?:\s{_CAP}){{0,2}}"
_INITIAL, _PARTICLE = r"\p{Lu}\.", r"(?:de|del|della|la|le|van|der|den|von|zu|ten|dos|da|di|al|el|bin)"
_FULL_NAME = rf"(?:{_CAP}|{_INITIAL})(?:\s(?:{_CAP}|{_INITIAL}|{_PARTICLE})){{0,4}}?(?:\s{_CAP})+"
#: What stands before the full name of a person who has no title.
_PERSON_CUES = (
    r"courtesy of|belongs to|belonged to|kept by|written by|signed by|given by|taken by|reported by|seen by|lists|labelled|labeled|named|called|of kin:|According to|according to|atient,|neighbour,|neighbor,|"
    r"person|nterview with|brother|sister|aunt|uncle|mother|father|son|daughter|wife|husband|cousin|friend|partner|the night|Signed:|Correspondence:|Prof\.|Author:|Contact:|stand,[\"”]"
)


class Annotator(Protocol):
    def entities(self, text: Column) -> Column:
        """Entity spans in document order."""


@dataclass(frozen=True)
class RuleAnnotator:
    """Entities by (label, pattern); patterns are matched without regard to case unless they say otherwise."""

    rules: Sequence[tuple[str, str]] = field(
        default=(
            ("PERSON", rf"(?-i:(?<=\b(?:Dr|Ms|Mr|Mrs)\s)|(?<=\bProf\.\s)){_CAP}(?-i:\s\p{{Lu}}\.)?(?:\s(?:de|la|van|der|von|ten|dos|di)){{0,2}}\s{_CAP}"),
            ("PERSON", rf"(?-i:(?=\p{{Lu}})(?<=\b(?:{_PERSON_CUES})\s){_OTHER}{_FULL_NAME})"),
            ("GPE", rf"(?-i:(?=\p{{Lu}})(?<=\b(?:{_PLACE_CUES})\s){_OTHER}{_PLACE}(?![\p{{L}}\d@]|\.\p{{L}}))"),
            ("DATE", rf"(?-i:(?=[\p{{Lu}}\d])(?:\b{_MONTH}\s\d{{1,2}}(?:st|nd|rd|th)?\b|\b\d{{1,2}}(?:st|nd|rd|th)?\s{_MONTH}|\b{_MONTH},?\s\d{{4}}\b))"),
            ("ORG", rf"(?-i:(?=[CKHO])\b(?:Clinique|Klinikum|Klinik|Hospital|Hôpital|Clínica|Ospedale|Krankenhaus)(?:\s{_CAP})?(?:\s(?:de|des|du|del|della|la|le|les|San|Santa)){{0,2}}\s{_CAP})"),
            ("ORG", rf"(?-i:\b(?:St\.\s)?(?:{_CAP}\s){{1,3}}(?:Hospital|Clinic|Centre|Infirmary|Institute|Laboratory|Service|Sygehus)(?:\s(?:of|de)\s{_CAP})?)"),
        )
    )

    def entities(self, text: Column) -> Column:
        if not self.rules:
            return F.when(text.isNotNull(), no_spans())
        found = [regex_spans(text, pattern, LABELS[label], f"rule:{label}") for label, pattern in self.rules]
        return F.array_sort(F.concat(*found))


@dataclass(frozen=True)
class PandasAnnotator:
    """Entities by a function that takes texts and gives, for each, (start, end, label) in document order."""

    find: Callable[[Sequence[str]], Sequence[Sequence[tuple[int, int, str]]]]

    def entities(self, text: Column) -> Column:
        find = self.find
        kind = T.ArrayType(T.StructType([T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()), T.StructField("original_value", T.StringType()), T.StructField("mask_type", T.StringType()), T.StructField("source", T.StringType())]))

        @F.pandas_udf(kind)
        def run(texts: pd.Series) -> pd.Series:
            known = [t if isinstance(t, str) else "" for t in texts]
            return pd.Series([[{"start_char": a, "end_char": b, "original_value": t[a:b], "mask_type": LABELS[x], "source": f"model:{x}"} for a, b, x in spans if x in LABELS] for t, spans in zip(known, find(known))], dtype=object)

        return F.when(text.isNotNull(), run(text).cast(SPANS))


def words_pattern(words: Sequence[str]) -> str:
    """A pattern for whole words."""
    return r"\b(?:" + "|".join(words) + r")\b"


def sex_spans(text: Column) -> Column:
    """Words that tell a person's sex."""
    return regex_spans(text, words_pattern(L.SEX_TERMS), "SEX", "lexicon")


#: Adverbs and the listed verbs in their forms.
WIDE_NEUTRAL = rf"\b(?:(?:{'|'.join(v.removesuffix('e') for v in L.SAFE_VERBS)})(?:e|s|es|ed|d|ing)?|\p{{L}}{{2,}}ly|also)\b"


def neutral_spans(text: Column, version: int = 3) -> Column:
    """Words whose change leaves the clinical facts alone.

    Version 3 takes the short list of neutral adverbs. Version 2 also takes adverbs and the listed verbs
    of more than three letters that are no protected term, decided by form instead of by a tagger.
    """
    if version >= 3:
        return regex_spans(text, words_pattern(L.SAFE_LOW_RISK_WORDS), "LOW_RISK_WORDING", "lexicon:pos")
    found = regex_spans(text, WIDE_NEUTRAL, "LOW_RISK_WORDING", "lexicon:pos")
    banned = F.array(*map(F.lit, (*L.PROTECTED_TERMS, *L.SEX_TERMS)))
    return F.filter(found, lambda s: (F.length(s["original_value"]) > 3) & ~F.array_contains(banned, F.lower(s["original_value"])))
