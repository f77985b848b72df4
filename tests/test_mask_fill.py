"""Masking and filling against an independent reading of the rules."""

import json
import re

import pytest
from pyspark.sql import functions as F

from casemill.functions import lexicons as L
from casemill.operators import annotate, fill as filling, spans
from casemill.operators.mask import MaskingConfig, mask_text, masked_dataset

PLAIN = annotate.RuleAnnotator(())
TEXTS = [
    "Case report of a 10-year-old man from NATION_9. MRN: 00000001. He was admitted on 1997-05-28 after 2 days of fever and was also reviewed on May 28, 1997. Customer#000000769 was reportedly stable.",
    "identified recordings idiopathic Case report patient ID ABC; 45-year-old, 7 yo, 80 y/o, 33 years old",
    "March 5th, 2020 and 2020-01-02, Sept. 9 2019, 12/31/99; 5 March 2020; 15, 2019",
    "é2020-01-02 😅 naïve 12 yo woman, MRN: 99881 — Ōmura case no. A-123 also",
    "", " ", "no masks here", "he he HE she", "x" * 5000 + " 5 yo",
]


def by_rule(text):
    """Greedy priority by Python's own regular expressions."""
    found = []
    for pattern in (L.ID_PATTERN, L.AGE_PATTERN, L.DATE_PATTERN, annotate.words_pattern(L.SEX_TERMS)):
        found += [(m.start(), m.end()) for m in re.finditer(pattern, text, re.IGNORECASE)]
    kept = []
    for a, b in found:
        if a < b and not any(a < d and b > c for c, d in kept):
            kept.append((a, b))
    return sorted(kept)


def test_spans_equal_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "k int, t string")
    config = MaskingConfig(annotator=PLAIN, mask_low_risk_wording=False)
    for r in mask_text(df, "t", "k", config).collect():
        assert [(m["start_char"], m["end_char"]) for m in r["metadata"]] == by_rule(r["t"]), r["t"][:80]
        assert [m["original_value"] for m in r["metadata"]] == [r["t"][a:b] for a, b in by_rule(r["t"])]


def test_masked_text_round_trip_and_partition_independence(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "k int, t string")
    config = MaskingConfig(annotator=annotate.RuleAnnotator())
    one, many = (sorted(map(tuple, (mask_text(df.repartition(n), "t", "k", config).select("k", "t", "masked_text", F.to_json("metadata").alias("m")).collect()))) for n in (1, 8))
    assert one == many
    for _, text, masked, meta in one:
        parts, out = masked.split(L.MASK), ""
        values = [m["original_value"] for m in json.loads(meta)]
        assert len(parts) == len(values) + 1
        for part, value in zip(parts, [*values, ""]):
            out += part + value
        assert out == text


def test_default_annotator_finds_places_persons_and_dates(spark):
    text = "A man from São Marelo had visited Port-Aubrac on May 4. Contacts in Kivuto were well in March 2015. According to Ewa T. Hedrosa he was sent to Klinikum Grünwede; mail from PELLANDRA.X@a.example, a letter from Haldorp Clinic in May."
    df = spark.createDataFrame([(1, text)], "source_row_id long, `Case presentation EN` string")
    for version in (2, 3):
        row = masked_dataset(df, config=MaskingConfig(version=version, mask_low_risk_wording=False, mask_sex=False)).first()
        got = list(zip(row["mask_types"].split("; "), row["masked_tokens"].split("; ")))
        assert got == [
            ("LOCATION", "São Marelo"), ("LOCATION", "Port-Aubrac"), ("DATE", "May 4"), ("LOCATION", "Kivuto"), ("DATE", "March 2015"),
            ("NAME", "Ewa T. Hedrosa"), ("ORGANIZATION", "Klinikum Grünwede"), ("ORGANIZATION", "Haldorp Clinic"),
        ]


def test_golden_row(spark):
    df = spark.createDataFrame([(1, TEXTS[0])], "source_row_id long, `Case presentation EN` string")
    row = masked_dataset(df, config=MaskingConfig(annotator=PLAIN, mask_low_risk_wording=False)).first()
    assert row["mask_types"] == "ID; AGE; SEX; ID; SEX; DATE; DATE" and row["masked_token_count"] == 7
    assert row["masked_text"] == "[MASK] of a [MASK] [MASK] from NATION_9. [MASK]. [MASK] was admitted on [MASK] after 2 days of fever and was also reviewed on [MASK]. Customer#000000769 was reportedly stable."
    assert [(m["start_char"], m["end_char"]) for m in json.loads(row["mask_metadata"])] == [(0, 11), (17, 28), (29, 32), (48, 61), (63, 65), (82, 92), (140, 152)]


def test_columns_by_version(spark):
    df = spark.createDataFrame([(1, "he"), (2, None)], "source_row_id long, `Case presentation EN` string")
    v2, v3 = (masked_dataset(df, config=MaskingConfig(version=v, annotator=PLAIN)) for v in (2, 3))
    assert len(v2.columns) == 17 and v3.columns == [*v2.columns, "protection_policy"] and v3.count() == 1


def test_resolution_keeps_priority(spark):
    rows = [[(5, 9), (0, 6), (9, 12), (3, 3)]]
    df = spark.createDataFrame([([(a, b, "", "", "") for a, b in r],) for r in rows], f"c {spans.SPANS}")
    assert [(s[0], s[1]) for s in df.select(spans.resolve(F.col("c")).alias("r")).first()["r"]] == [(5, 9), (9, 12)]


@pytest.mark.parametrize("n, ratio, expected", [(10, 0.15, 2), (30, 0.15, 4), (1, 0.15, 1), (5, 0.0, 0), (0, 0.15, 0)])
def test_sample_sizes(spark, n, ratio, expected):
    df = spark.createDataFrame([(1, " ".join(["also"] * n) or "x")], "k int, t string")
    config = MaskingConfig(annotator=PLAIN, mask_ratio=ratio)
    assert len(mask_text(df, "t", "k", config).first()["metadata"]) == expected


def test_medical_entities_are_protected(spark):
    rules = annotate.RuleAnnotator((("ORG", r"Lassa Centre"), ("ORG", r"City Clinic")))
    df = spark.createDataFrame([(1, "Lassa Centre and City Clinic")], "k int, t string")
    kinds = lambda v: [m["original_value"] for m in mask_text(df, "t", "k", MaskingConfig(version=v, annotator=rules)).first()["metadata"]]
    assert kinds(3) == ["City Clinic"] and kinds(2) == ["Lassa Centre", "City Clinic"]


def test_pandas_annotator(spark):
    found = annotate.PandasAnnotator(lambda texts: [[(t.index("Rome"), t.index("Rome") + 4, "GPE")] if "Rome" in t else [] for t in texts])
    df = spark.createDataFrame([(1, "from Rome"), (2, None), (3, "none")], "k int, t string")
    got = {r["k"]: r["metadata"] for r in mask_text(df, "t", "k", MaskingConfig(annotator=found)).collect()}
    assert got[1][0]["mask_type"] == "LOCATION" and got[2] is None and got[3] == []


def test_clashing_columns_are_refused(spark):
    with pytest.raises(ValueError):
        mask_text(spark.createDataFrame([(1, "a", "b")], "k int, t string, masked_text string"), "t", "k")


def test_metadata_parsing(spark):
    raw = ["{bad", '{"a":1}', '[1,{"mask_index":1}]', "", None, '[{"mask_type":"AGE","mask_index":2},null,"x"]', "[]"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string")
    got = [len(r["m"]) for r in df.select("i", filling.parsed_metadata(F.col("r")).alias("m")).orderBy("i").collect()]
    assert got == [0, 0, 1, 0, 0, 1, 0]


def test_masks_by_index(spark):
    df = spark.createDataFrame([('[{"mask_type":"A","mask_index":3},{"mask_type":"B"},{"mask_type":"C","mask_index":1},{"mask_type":"D"}]',)], "r string")
    assert [m["mask_type"] for m in df.select(filling.by_index(filling.parsed_metadata(F.col("r"))).alias("m")).first()["m"]] == ["B", "D", "C", "A"]


def filled(spark, rows, **config):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "source_row_id long, masked_text string, mask_metadata string")
    return filling.fill(df, config=filling.FillingConfig(**config)).orderBy("source_row_id", "variant_id").collect()


def test_fill_statuses(spark):
    neutral = '[{"mask_index":1,"mask_type":"LOW_RISK_WORDING","original_value":"also"}]'
    sex = '[{"mask_index":1,"mask_type":"SEX","original_value":"he"}]'
    rows = [("a [MASK] b", sex), ("a [MASK] b", neutral), ("a [MASK] b [MASK]", sex), (" ", "[]"), (None, None), ("none", "[]"), ("a [MASK] b", "{bad")]
    got = filled(spark, rows)
    assert [r["fill_status"] for r in got] == ["filled", "filled_with_fallback", "validation_failed", "empty", "empty", "filled", "filled_with_fallback"]
    assert got[1]["filled_text"] == "a also b" and json.loads(got[1]["validation_issues"]) == ["mask_1:no_candidate_satisfied_constraints"]
    assert json.loads(got[2]["validation_issues"]) == ["mask_metadata_count_mismatch:2!=1", "unfilled_mask_remaining"] and got[2]["filled_text"] == "a he b [MASK]"
    assert got[6]["filled_text"] == "a  b"


def test_first_masks_only(spark):
    two = '[{"mask_index":1,"mask_type":"SEX","original_value":"he"},{"mask_index":2,"mask_type":"SEX","original_value":"she"}]'
    row = filled(spark, [("[MASK] and [MASK]", two)], max_masks=1)[0]
    assert row["fill_status"] == "validation_failed" and row["filled_text"] == "he and [MASK]"
    assert json.loads(row["validation_issues"]) == ["mask_metadata_count_mismatch:2!=1", "unfilled_mask_remaining"]
    assert filled(spark, [("[MASK] and [MASK]", two)], max_masks=1, version=3)[0]["fill_status"] == "partially_filled"


def test_variants_share_one_offset_per_row(spark):
    dates = '[{"mask_index":1,"mask_type":"DATE","original_value":"2020-01-01"},{"mask_index":2,"mask_type":"DATE","original_value":"2020-03-01"}]'
    from datetime import date

    for r in filled(spark, [("[MASK] to [MASK]", dates)] * 5, variants=4):
        a, b = (date.fromisoformat(x) for x in r["filled_text"].split(" to "))
        moved = (a - date(2020, 1, 1)).days
        assert (b - date(2020, 3, 1)).days == moved and 30 <= abs(moved) <= 365 and (moved > 0) == (r["variant_id"] % 2 == 1)


def test_policies(spark):
    raw = '[{"mask_type":"DATE","original_value":"soon"},{"mask_type":"DATE","original_value":"2020-01-01"},{"mask_type":"SEX"},{"mask_type":"AGE"},{"mask_type":"NAME"},{"mask_type":"LOW_RISK_WORDING"}]'
    df = spark.createDataFrame([(raw,)], "r string")
    got = df.select(filling.enriched_policies(filling.parsed_metadata(F.col("r")), True).alias("m")).first()["m"]
    assert [m["replacement_policy"] for m in got] == ["preserve_unparsed", "shift_absolute_date", "swap_consistently", "same_age_category", "fictitious_value", "clinicalbert_filtered"]
    assert [m["preserve_chronology"] for m in got[:2]] == [False, True]


def test_validation_is_an_ordered_search(spark):
    rows = [("a [MASK] b", "x a y b z", 1, []), ("a [MASK] b", "b y a", 1, ["non_mask_text_changed"]), ("[MASK]", "", 1, []), ("ab[MASK]", "a", 1, ["non_mask_text_changed"]), ("a.[MASK]", "a.é😅", 2, ["mask_metadata_count_mismatch:1!=2"])]
    df = spark.createDataFrame([(i, m, f, n) for i, (m, f, n, _) in enumerate(rows)], "i int, m string, f string, n int")
    got = [r["v"] for r in df.select("i", filling.validation_issues(F.col("m"), F.col("f"), F.col("n")).alias("v")).orderBy("i").collect()]
    assert got == [e for *_, e in rows]


def test_bad_configs():
    for bad in (dict(date_shift_min=9, date_shift_max=1), dict(variants=0), dict(version=2)):
        with pytest.raises(ValueError):
            filling.FillingConfig(**bad)
    with pytest.raises(ValueError):
        MaskingConfig(mask_ratio=1.5)


def test_fill_contract(spark):
    from casemill.operators.candidates import CANDIDATES

    masks = [{"mask_index": 1, "mask_type": "LOW_RISK_WORDING", "original_value": "also", "pos": "ADV", "lemma": "also"}, {"mask_index": 2, "mask_type": "DATE", "original_value": "2020-01-01"}, {"mask_index": 3, "mask_type": "ODD", "original_value": "o"}, {"mask_index": 4, "original_value": "also", "protected": True}]
    df = spark.createDataFrame([(1, "[MASK] [MASK] [MASK] [MASK]", json.dumps(masks), None), (2, "[MASK]", "[]", "model failed")], "source_row_id long, masked_text string, mask_metadata string, e string")
    ranked = F.array(*[F.struct(F.lit(w).alias("token"), F.lit(x).alias("score")) for w, x in (("fever", 0.9), ("usually", 0.5))]).cast(CANDIDATES)
    row, failed = filling.fill(df, ranked, error=F.col("e")).orderBy("source_row_id").collect()
    a, b, c, d = json.loads(row["mask_fill_details"])
    assert (a["method"], a["replacement"], a["classification"]["pos"], a["classification"]["protected"]) == ("bio_clinicalbert_filtered", "usually", "ADV", False)
    assert a["candidates"][0]["rejection_reasons"] == ["candidate_is_medical_or_semantically_sensitive", "pos_mismatch_expected_adverb"] and a["candidates"][1]["accepted"]
    assert b["method"] == "constraint_shift_absolute_date" and "classification" not in b and (c["method"], c["replacement"]) == ("bio_clinicalbert_low_risk_wording", "fever")
    assert (d["mask_type"], d["method"], d["replacement"], d["validation_issues"]) == ("LOW_RISK_WORDING", "fallback_restore_original", "also", ["no_candidate_satisfied_constraints"])
    assert "source_mask_is_protected" in d["candidates"][1]["rejection_reasons"] and row["fill_status"] == "filled_with_fallback" and row["fill_error"] == ""
    assert (failed["fill_status"], failed["filled_text"], failed["predicted_tokens"], failed["mask_fill_details"], failed["fill_error"]) == ("error", "[MASK]", "", "[]", "model failed")
    third = filling.fill(df, ranked, config=filling.FillingConfig(version=3), error=F.col("e")).orderBy("source_row_id").first()
    assert json.loads(third["mask_fill_details"])[0]["method"] == "bio_clinicalbert_low_risk_wording" and json.loads(third["constraint_policy"])["AGE_DELTA_BY_CATEGORY"]["adult"] > 0


def test_a_literal_mask_in_the_source_shifts_the_fills(spark):
    row = filled(spark, [("[MASK] and [MASK]", '[{"mask_index":1,"mask_type":"SEX","original_value":"he"}]')])[0]
    assert row["filled_text"] == "he and [MASK]" and json.loads(row["validation_issues"])[0] == "mask_metadata_count_mismatch:2!=1"


def test_spans_in_texts_of_every_kind(spark):
    texts = ["A 45-year-old and a 7 yo", "é 45-year-old — ÀGE 7 yo", "\ufdd0 45-year-old \ufdd1 7 yo", "", None, "none", "45-year-old"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["s"] for r in df.select("i", spans.regex_spans(F.col("t"), L.AGE_PATTERN, "AGE", "regex").alias("s")).orderBy("i").collect()]
    assert [[(s["start_char"], s["original_value"]) for s in r] if r is not None else None for r in got] == [[(m.start(), m[0]) for m in re.finditer(L.AGE_PATTERN, t, re.I)] if t is not None else None for t in texts]


def test_token_spans_and_labels(spark):
    df = spark.createDataFrame([("He saw Anna-Maria, 45.",)], "t string")
    t = F.col("t")
    span = lambda a, b: F.struct(F.lit(a).alias("start_char"), F.lit(b).alias("end_char"))
    tokens = spans.regex_spans(t, spans.TOKEN, "TOKEN", "token")
    entities = F.concat(spans.regex_spans(t, "Maria", "NAME", "rule:PERSON"), spans.regex_spans(t, "Anna", "LOCATION", "rule:GPE"))
    got = df.select(spans.token_span(tokens, span(9, 14)).alias("a"), spans.token_span(tokens, span(6, 7)).alias("b"), spans.token_span(tokens, span(15, 18)).alias("c"), spans.labels_over(span(7, 17), entities).alias("l"), spans.labels_over(span(0, 2), entities).alias("n")).first()
    assert tuple(got["a"]) == (7, 17) and got["b"] is None and tuple(got["c"]) == (7, 18) and got["l"] == "GPE,PERSON" and got["n"] == ""


@pytest.mark.parametrize("name", ["token_spans", "mask_metadata", "entity_spans"])
def test_spans_are_looked_for_once(spark, name):
    """No filter repeats the search for spans, and no pattern is sought in two places of the plan."""
    from casemill.plans import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter") and "regexp_replace" in line]
    assert plan.count("NATION_") <= 4


def test_many_matches_keep_their_places(spark):
    """Places of many matches, at both ends, side by side, beyond the first plane and around the marks."""
    texts = ["ab 😅 c-d, é!" * 40, "a", "", "b b", ". . ", "\ufdd0ab\ufdd1 c \ufdd0", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    for r in df.select("t", spans.regex_spans(F.col("t"), "[a-z]", "TOKEN", "token").alias("s")).collect():
        if r["t"] is None:
            assert r["s"] is None
        else:
            assert [(s["start_char"], s["end_char"], s["original_value"]) for s in r["s"]] == [(m.start(), m.end(), m[0]) for m in re.finditer("[a-z]", r["t"])]
