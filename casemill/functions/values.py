"""Replacement values for masks under their constraints. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemill.functions import lexicons as L
from casemill.functions.binding import bind
from casemill.functions.draws import SEED, draw, pick


def age_category(age: Column) -> Column:
    return F.when(age < 18, "pediatric").when(age < 65, "adult").otherwise("older_adult")


def first_number(value: Column) -> Column:
    """The first one to three digits as a number, null where there are none."""
    return F.nullif(F.regexp_extract(value, r"(\d{1,3})", 1), F.lit("")).cast("int")


def constraint(mask_type: Column, value: Column) -> Column:
    """What a replacement of this mask must respect, in words."""
    head, tail = L.AGE_CONSTRAINT.split("{}")
    aged = bind(first_number(value), lambda age: F.when(age.isNull(), L.AGE_CONSTRAINT_UNKNOWN).otherwise(F.concat(F.lit(head), age_category(age), F.lit(tail))))
    out = F.when(mask_type == "AGE", aged)
    for name, text in L.CONSTRAINTS.items():
        out = out.when(mask_type == name, text)
    return out.otherwise(L.CONSTRAINT_DEFAULT)


def replaced_age(value: Column, *key: Column | str | int, seed: int = SEED) -> Column:
    """Another age near by in the same category; unchanged where no other age fits."""
    def moved(age: Column) -> Column:
        low = F.when(age < 18, F.greatest(F.lit(0), age - L.AGE_SPREAD["pediatric"])).when(age < 65, F.greatest(F.lit(18), age - L.AGE_SPREAD["adult"])).otherwise(F.greatest(F.lit(65), age - L.AGE_SPREAD["older_adult"]))
        high = F.when(age < 18, F.least(F.lit(17), age + L.AGE_SPREAD["pediatric"])).when(age < 65, F.least(F.lit(64), age + L.AGE_SPREAD["adult"])).otherwise(F.least(F.lit(110), age + L.AGE_SPREAD["older_adult"]))
        return bind(F.struct(low.alias("low"), high.alias("high"), age.between(low, high).alias("inside")), lambda r: chosen(age, r["low"], r["high"], r["inside"]))

    def chosen(age: Column, low: Column, high: Column, inside: Column) -> Column:
        choices = high - low + F.when(inside, 0).otherwise(1)
        at = low + draw(choices, *key, "age", seed=seed).cast("int")
        return bind(F.when(age.isNotNull() & (choices > 0), at), lambda x: F.when(inside & (x >= age), x + 1).otherwise(x))

    return bind(bind(first_number(value), moved), lambda new: F.when(new.isNotNull(), F.regexp_replace(value, F.lit(r"^(\D*)\d{1,3}"), F.concat(F.lit("$1"), new.cast("string")))).otherwise(value))


def replaced_id(value: Column, *key: Column | str | int, seed: int = SEED) -> Column:
    """The label of the identifier and an invented number."""
    trimmed = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    pattern = r"(?i)^(.*?)([A-Z0-9-]{3,})$"
    prefix = F.when(trimmed.rlike(pattern), F.regexp_extract(trimmed, pattern, 1)).otherwise("ID ")
    return F.concat(prefix, F.lit("X"), (draw(900_000, *key, "id", seed=seed) + 100_000).cast("string"))


def replaced_sex(value: Column, change: bool) -> Column:
    """The counterpart of a sex term with its capital kept, or the value itself if sex is to stay."""
    if not change:
        return value
    pairs = F.create_map(*[F.lit(x) for pair in L.SEX_PAIRS.items() for x in pair])
    upper = value.rlike(r"^\p{Lu}")
    return bind(F.coalesce(F.try_element_at(pairs, F.lower(value)), value), lambda new: F.when(upper, F.concat(F.upper(F.substring(new, 1, 1)), F.lower(F.substring(new, 2, 1_000_000)))).otherwise(new))


def fictitious(mask_type: Column, *key: Column | str | int, seed: int = SEED) -> Column:
    """An invented name, place or institution; null for other types."""
    name = F.concat(pick(L.FIRST_NAMES, *key, "first", seed=seed), F.lit(" "), pick(L.LAST_NAMES, *key, "last", seed=seed))
    return F.when(mask_type == "NAME", name).when(mask_type == "LOCATION", pick(L.LOCATIONS, *key, "place", seed=seed)).when(mask_type == "ORGANIZATION", pick(L.ORGANIZATIONS, *key, "institution", seed=seed))
