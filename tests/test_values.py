"""Scalar replacements against expected values."""

import pytest
from pyspark.sql import functions as F

from casemill.functions import dates, lexicons as L, values
from casemill.operators import safety


def column(spark, rows, build, schema="v string, d int"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r["o"] for r in df.select("i", build(F.col("v"), F.col("d")).alias("o")).orderBy("i").collect()]


SHIFTS = [
    ("2020-01-02", 45, "2020-02-16"), ("March 5, 2020", 45, "April 19, 2020"), ("Mar 5, 2020", -45, "Jan 20, 2020"), ("12/31/99", 45, "02/14/00"),
    ("1/2/2020", 45, "02/16/2020"), ("2020/1/2", -45, "2019/11/18"), ("1/2/75", 0, "01/02/75"), ("1/2/69", 365, "01/02/70"), ("March 5 th, 2020", 0, "March 05, 2020"),
    ("MARCH  5,  2020", 30, "April 04, 2020"), ("March 5th, 2020", 45, "March 5th, 2020"), ("Sept 5, 2020", 45, "Sept 5, 2020"), ("Mar. 5, 2020", 45, "Mar. 5, 2020"),
    ("03-05-2020", 45, "03-05-2020"), ("15, 2019", 45, "15, 2019"), ("2020-02-30", 45, "2020-02-30"), ("13/1/2020", 45, "13/1/2020"), ("", 45, ""), (None, 45, None),
]


def test_shifted_keeps_style(spark):
    assert column(spark, [(v, d) for v, d, _ in SHIFTS], dates.shifted) == [e for *_, e in SHIFTS]


def test_two_digit_years_pivot_at_69(spark):
    got = column(spark, [("1/2/75", 0), ("1/2/69", 0), ("1/2/68", 0)], lambda v, d: F.year(dates.parsed(v)[0]))
    assert got == [1975, 1969, 2068]


KINDS = [
    ("2020-01-02", "absolute_date"), ("Mar 5, 2020", "absolute_date"), ("may 5 2020", "absolute_date"), ("12/31/99", "absolute_date"), ("2020-02-30", "unparsed"), ("day 5", "month_day"), ("March 5th", "month_day"), ("6-8 weeks", "week_range"), ("6–8 week", "week_range"),
    ("gestational age 41 weeks", "gestational_age"), ("age 1 week", "gestational_age"), ("3 days", "duration"), ("10months", "duration"), ("15, 2019", "unparsed"), ("soon", "unparsed"), (None, None),
]


def test_kinds(spark):
    assert column(spark, [(v, 0) for v, _ in KINDS], lambda v, d: dates.kind(v)) == [k for _, k in KINDS]


def test_bounded(spark):
    cases = [(45, 2, 2), (44, 2, 1), (-45, 2, -2), (-44, 2, -1), (0, 2, 1), (-31, 1, -1)]
    for days, limit, expected in cases:
        assert column(spark, [("", days)], lambda v, d, limit=limit: dates.bounded(d, limit)) == [expected]


OTHER = [
    ("March 5th", 45, "April 19"), ("December 31", 45, "February 14"), ("February 29", -45, "January 15"), ("day 5", 45, "day 5"), ("6-8 weeks", 45, "8-10 weeks"),
    ("1-2 weeks", -45, "1-2 weeks"), ("8-6 weeks", 44, "9-9 weeks"), ("gestational age 41 weeks", 45, "gestational age 42 weeks"), ("age 1 week", -45, "age 1 week"),
    ("3 days", 45, "5 days"), ("1 day", -45, "1 day"), ("10months", 45, "12months"), ("whenever", 45, "whenever"),
]


def test_other_kinds_shift(spark):
    assert column(spark, [(v, d) for v, d, _ in OTHER], dates.shifted_any) == [e for *_, e in OTHER]


def test_identifier_prefixes(spark):
    cases = [("idiot", r"X\d{6}"), ("case report", r"case X\d{6}"), ("ID: A-12", r"ID: X\d{6}"), ("MRN 1234567", r"MRN X\d{6}"), ("case\nreport", r"ID X\d{6}")]
    import re

    for (value, pattern), got in zip(cases, column(spark, [(v, 1) for v, _ in cases], lambda v, d: values.replaced_id(v, d))):
        assert re.fullmatch(pattern, got), (value, got)


def test_sex_pairs(spark):
    words = ["Her", "MALE", "him", "gentleman", "she", "Hers"]
    assert column(spark, [(w, 0) for w in words], lambda v, d: values.replaced_sex(v, True)) == ["His", "Female", "her", "gentleman", "he", "His"]
    assert column(spark, [("Her", 0)], lambda v, d: values.replaced_sex(v, False)) == ["Her"]


AGES = [("17", {15, 16}), ("18", {19, 20, 21, 22, 23}), ("64", {59, 60, 61, 62, 63}), ("65", {66, 67, 68, 69}), ("1", {0, 2, 3}), ("120", {120})]


@pytest.mark.parametrize("age, allowed", AGES)
def test_ages_stay_in_category(spark, age, allowed):
    got = column(spark, [(f"{age}-year-old, 3 kg", s) for s in range(60)], lambda v, d: values.replaced_age(v, d))
    ages = {int(g.split("-")[0]) for g in got}
    assert ages == allowed and all(g.endswith("-year-old, 3 kg") for g in got)


def test_constraints(spark):
    got = column(spark, [("AGE", 0), ("DATE", 0), ("other", 0)], lambda v, d: values.constraint(v, F.lit("7 yo")))
    assert got == [L.AGE_CONSTRAINT.format("pediatric"), L.CONSTRAINTS["DATE"], L.CONSTRAINT_DEFAULT]


def test_rejection_reasons(spark):
    cases = [("##ly", "also", "", []), ("fever", "also", "ADV", ["candidate_is_medical_or_semantically_sensitive", "pos_mismatch_expected_adverb"]), ("often", "also", "ADV", ["pos_mismatch_expected_adverb"]),
             ("Mainly", "also", "ADV", ["capitalization_mismatch"]), ("x1", "also", "", ["not_a_complete_alphabetic_token"]), ("", "also", "", ["not_a_complete_alphabetic_token"]), ("mainly", "also", "ADV", [])]
    df = spark.createDataFrame([(i, t, o, p) for i, (t, o, p, _) in enumerate(cases)], "i int, t string, o string, p string")
    got = [r["r"] for r in df.select("i", safety.rejection_reasons(F.col("t"), F.col("o"), F.col("p"), F.lit(False)).alias("r")).orderBy("i").collect()]
    assert got == [e for *_, e in cases]


def test_safe_selection(spark):
    df = spark.createDataFrame([([("fever", 0.9), ("mainly", 0.5), ("chiefly", 0.4)],), ([("fever", 0.9)],), ([],)], "c array<struct<token:string,score:double>>")
    pick = lambda rank: [r["s"] for r in df.select(safety.select_safe(F.col("c"), F.lit("also"), F.lit("ADV"), F.lit(False), rank).alias("s")).collect()]
    assert [s["replacement"] for s in pick(0)] == ["mainly", "also", "also"]
    assert [s["replacement"] for s in pick(7)] == ["chiefly", "also", "also"]
    assert [s["fallback"] for s in pick(0)] == [False, True, True] and len(pick(0)[0]["checked"]) == 3
