"""Clinical safety: flags of words and spans, and reasons to reject a candidate word."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemill.functions import lexicons as L
from casemill.functions.binding import bind


def _member(word: Column, words: Sequence[str]) -> Column:
    return word.isin(*words)


def is_medical_word(word: Column) -> Column:
    """A medical term, a word with a medical ending, or a laboratory pattern as a whole."""
    low = F.lower(word)
    return _member(low, L.MEDICAL_TERMS) | low.rlike("(?:" + "|".join(L.MEDICAL_SUFFIXES) + ")$") | word.rlike(f"(?iuU)^(?:{L.MEDICAL_PATTERN})$")


def is_medical_span(text: Column) -> Column:
    """Whether a laboratory pattern or any medical word stands in the text."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\p{L}]+(?:-[\p{L}]+)*"), F.lit(0))
    return text.rlike(f"(?iuU){L.MEDICAL_PATTERN}") | F.exists(words, lambda w: _member(w, L.MEDICAL_TERMS) | w.rlike("(?:" + "|".join(L.MEDICAL_SUFFIXES) + ")$"))


def is_word(text: Column) -> Column:
    """Whether a span is one word."""
    return ~text.rlike(r"(?U)[\s\-/,]")


def flags(text: Column) -> dict[str, Column]:
    """The six safety flags of a span; spans of several words only carry the medical one."""
    low, one = F.lower(text), is_word(text)
    sets = (L.NEGATION_TERMS, L.SEVERITY_TERMS, L.TEMPORALITY_TERMS, L.OUTCOME_TERMS, L.POLARITY_TERMS)
    out = {"medical_concept": F.when(one, is_medical_word(text)).otherwise(is_medical_span(text))}
    out |= {name: one & _member(low, words) for name, words in zip(L.FLAGS[1:], sets)}
    return out


def normal_token(token: Column) -> Column:
    """A model's token without blanks around it and without the mark of a continued word."""
    trimmed = F.regexp_replace(token, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(trimmed, r"^##", ""), r"(?U)^\s+|\s+$", "")


def _starts_upper(text: Column) -> Column:
    return F.substring(text, 1, 1).rlike(r"^\p{Lu}")


def rejection_reasons(token: Column, original: Column, pos: Column, protected: Column) -> Column:
    """Why a candidate may not stand in for ``original``, in a fixed order; an empty list if it may."""
    word = normal_token(token)
    low, old = F.lower(word), F.lower(F.coalesce(original, F.lit("")))
    checks = (
        (~word.rlike(L.SAFE_TOKEN_PATTERN), "not_a_complete_alphabetic_token"),
        (_member(low, L.SENSITIVE_TERMS) & (low != old), "candidate_is_medical_or_semantically_sensitive"),
        (F.coalesce(protected, F.lit(False)), "source_mask_is_protected"),
        ((F.coalesce(pos, F.lit("")) == "ADV") & (low != old) & ~low.endswith("ly"), "pos_mismatch_expected_adverb"),
        (_starts_upper(F.coalesce(original, F.lit(""))) != _starts_upper(word), "capitalization_mismatch"),
    )
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in checks]))


def checked_candidates(candidates: Column, original: Column, pos: Column, protected: Column) -> Column:
    """Every candidate with its normal form, whether it may stand in for ``original``, and why not."""

    def one(c: Column) -> Column:
        fields = [c["token"].alias("token"), c["score"].alias("score"), normal_token(c["token"]).alias("normalized_token")]
        return bind(rejection_reasons(c["token"], original, pos, protected), lambda why: F.struct(*fields, (F.size(why) == 0).alias("accepted"), why.alias("rejection_reasons")))

    return F.transform(candidates, one)


def select_safe(candidates: Column, original: Column, pos: Column, protected: Column, rank: Column | int) -> Column:
    """``struct<replacement, method, fallback, checked>``: the accepted candidate of the wanted rank, or the original.

    ``candidates`` is ``array<struct<token, score>>`` by falling score; every check is kept in ``checked``.
    A rank beyond the accepted candidates takes the last of them.
    """
    wanted = rank if isinstance(rank, Column) else F.lit(rank)

    def picked(checked: Column) -> Column:
        accepted = F.transform(F.filter(checked, lambda c: c["accepted"]), lambda c: c["normalized_token"])
        return bind(accepted, lambda ok: bind(F.get(ok, F.least(wanted, F.size(ok) - 1)), lambda chosen: result(chosen, checked)))

    def result(chosen: Column, checked: Column) -> Column:
        return F.struct(
            F.coalesce(chosen, original, F.lit("")).alias("replacement"),
            F.when(chosen.isNotNull(), L.METHOD_FILTERED).otherwise(L.METHOD_FALLBACK).alias("method"),
            chosen.isNull().alias("fallback"),
            checked.alias("checked"),
        )

    return bind(checked_candidates(candidates, original, pos, protected), picked)
