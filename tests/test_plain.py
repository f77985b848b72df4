"""The way of plain texts against the expressions and Python's md5."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casemill.functions.hashing import md5_words
from casemill.operators import annotate, candidates, fill, mask, plain
from casemill.plans import registry as R

RULES = annotate.RuleAnnotator((("GPE", r"\bNATION_\d+\b"), ("PERSON", r"\bCustomer#\d+\b"), ("ORG", r"\b(?:Lassa Centre|City Clinic|case[ _]\d+)\b"), ("PERSON", r"\bcase \d+\b")))
DATES = (
    "2020-02-29 2021-02-29 2020-2-3 1999/12/31 1999/13/31 12/31/1999 1/2/99 02/29/72 2/29/70 2/3/68 1/2/123 12-31-1999", "February 5, 1998; feb 5, 1998; May 28 1997; Sept 9, 2019; Sep. 9, 2019; SEP 9 2019; June 31, 2000",
    "March 5th, 2020 and March 5 th, 2020; 5th, 2020; 15, 2019; 5 th 2020; Marching 5, 2020; Decorum 12, 2001", "9997-12-31 0002-01-01 00001 19999",
)
TEXTS = [
    "Case report of a 10-year-old man from NATION_9. MRN: 00000001. He was admitted on 1997-05-28 and also reviewed on May 28, 1997. Customer#000000769 was reportedly stable.",
    *DATES, "identified recordings idiopathic Case report patient ID ABC; 45-year-old, 7 yo, 80 y/o, 999 yo, 17 yrs old, 65 year old 110yo 0 yo 200-year-old", "also Also ALSO mainly typically apparently primarily generally commonly reportedly also also also also",
    "id a-b-_ ID:--- id no. X9, case 123 and case_123 patient record number 7-7-7x; MRN#12", "he She HIS hers woman Lady gentleman x", "Lassa Centre and City Clinic, NATION_1, Customer#12", "", " ", "   ", "none", "also", "he", "id: abcd", "é also", "tab\talso", "[MASK] also", "x\x01\x02also", "also \n", "x" * 5000 + " 5 yo", None,
    "case 123-year-old on 2020-01-02, 2020-01-02", "record 12/31/1999 yo", "\\1 $1 \\0 also he", '"also" \\"he\\" {} []',
]
OFFERS = ((("often", 0.4), ("fever", 0.25), (" usually ", 0.2), ("Mainly", 0.1), ("##largely", 0.05), ("also", 0.01), ("a b", 0.0), ("ly", 0.0), ("mostly", 0.0)), (("fever", 0.6), ("now and then", 0.4)), ())


@pytest.mark.parametrize("variants, change_sex, ratio", [(3, True, 0.15), (1, False, 0.5), (2, True, 0.0)])
def test_plain_texts_are_filled_as_by_expressions(spark, variants, change_sex, ratio):
    masking, config = mask.MaskingConfig(annotator=RULES, mask_ratio=ratio), fill.FillingConfig(variants=variants, change_sex=change_sex)
    rows = [(k, t) for k, t in zip([1, 2, 3, 50, 0, -7, 2**40, *range(100, 100 + 4 * len(TEXTS))], TEXTS * 4)]
    known = spark.createDataFrame([*rows, (None, "also")], "source_row_id long, case_text string").repartition(2)
    k = F.col("source_row_id")
    part = known.filter(plain.is_plain(F.col("case_text"), k)).cache()
    assert part.count() > 70
    error = F.when(k % 10 == 0, F.lit("model failed"))
    got = plain.fill_plain(part, "case_text", "source_row_id", masking, config, OFFERS, F.pmod(k, F.lit(3)), error)
    ranked = [F.array(*[F.struct(F.lit(w).alias("token"), F.lit(x).alias("score")) for w, x in offer]).cast(candidates.CANDIDATES) for offer in OFFERS]
    masked = mask.mask_text(part, "case_text", "source_row_id", masking).select("source_row_id", "masked_text", F.to_json("metadata").alias("mask_metadata"))
    out = fill.fill(masked, F.when(F.pmod(k, F.lit(3)) == 0, ranked[0]).when(F.pmod(k, F.lit(3)) == 1, ranked[1]).otherwise(ranked[2]), config=config, error=error)
    details = F.from_json("mask_fill_details", "array<struct<method:string,candidates:array<struct<rejection_reasons:array<string>>>>>")
    methods = F.array_join(F.transform(details, lambda d: d["method"]), ";")
    reasons = F.array_join(F.flatten(F.flatten(F.transform(details, lambda d: F.transform(d["candidates"], lambda c: c["rejection_reasons"])))), ";")
    expected = out.select("source_row_id", "variant_id", "filled_text", "predicted_tokens", "fill_status", "validation_issues", "fill_error", methods.alias("methods"), reasons.alias("reasons"))
    assert got.columns == expected.columns
    for a, b in zip(sorted(map(tuple, got.collect())), sorted(map(tuple, expected.collect())), strict=True):
        assert a == b


def test_lists_that_are_not_there(spark):
    """Only lists that are there may be named; rows that name none fail the job instead of taking another."""
    df = spark.createDataFrame([(1, "also")], "source_row_id long, case_text string")
    with pytest.raises(Exception, match="names no list"):
        plain.fill_plain(df, "case_text", "source_row_id", R.CONFIG, R.FILLING, OFFERS, F.lit(3), F.lit(None).cast("string")).collect()


def test_what_is_not_plain_is_told_apart(spark):
    odd = ["é", "tab\t", "a\n", "[MASK]", "", "x" * 4001, "0001-01-05", "in 9999", None]
    fine = ["a", " ", "00001 19999 00012", "x" * 4000, "9997"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd + fine)], "k int, t string")
    assert [r["p"] for r in df.select("k", plain.is_plain(F.col("t"), F.col("k")).alias("p")).orderBy("k").collect()] == [False] * len(odd) + [True] * len(fine)


def test_configurations_without_this_way():
    for masking, config in ((mask.MaskingConfig(), fill.FillingConfig()), (mask.MaskingConfig(annotator=RULES, mask_sex=False), fill.FillingConfig()), (mask.MaskingConfig(annotator=RULES), fill.FillingConfig(version=3)), (mask.MaskingConfig(annotator=annotate.RuleAnnotator((("DATE", "soon"),))), fill.FillingConfig())):
        with pytest.raises(ValueError):
            plain.PlainFilling(masking, config, OFFERS)


def test_digests_of_columns():
    draw = random.Random(1)
    strings = ["", "é" * 40, *("x" * draw.randrange(0, 130) + str(i) for i in range(9000))]
    words = md5_words(pa.array(strings))
    assert ["".join(f"{x:08x}" for x in w) for w in words.T.tolist()] == [hashlib.md5(s.encode()).hexdigest() for s in strings]
    assert (md5_words(pa.array(strings)[7:90]) == words[:, 7:90]).all() and md5_words(pa.array([], pa.string())).shape == (4, 0)


def test_filled_cases_takes_plain_texts_in_batches(spark):
    """Plain texts, here all, go through Arrow batches; the expressions are kept for the others alone."""
    found = R.QUERIES["filled_cases"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Union") == 1
    assert found.count() == 2 * R.cases(spark, "/root/testdata/sf0.001").count()
