"""Masking of case texts: candidates, priority, neutral wording, metadata, output columns.

One narrow stage of native expressions; nothing is shuffled, and seeds depend on the row's key alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions import lexicons as L
from casemill.functions.values import constraint
from casemill.operators import annotate, safety
from casemill.operators.spans import joined, no_spans, overlaps_any, regex_spans, resolve, splice


@dataclass(frozen=True)
class MaskingConfig:
    """What is masked. ``version`` 3 protects medical spans and narrows the neutral wording; 2 does neither."""

    mask_ratio: float = 0.15
    seed: int = 42
    version: int = 3
    mask_ids: bool = True
    mask_age: bool = True
    mask_dates: bool = True
    mask_names: bool = True
    mask_locations: bool = True
    mask_organizations: bool = True
    mask_sex: bool = True
    mask_low_risk_wording: bool = True
    annotator: annotate.Annotator = field(default_factory=annotate.RuleAnnotator)

    def __post_init__(self) -> None:
        if not 0.0 <= self.mask_ratio <= 1.0:
            raise ValueError("mask_ratio must lie between 0 and 1")
        if self.version not in (2, 3):
            raise ValueError("version must be 2 or 3")


def regex_candidates(text: Column, config: MaskingConfig) -> Column:
    """Identifiers, ages and dates by pattern, in this order of priority."""
    kinds = ((config.mask_ids, L.ID_PATTERN, "ID"), (config.mask_age, L.AGE_PATTERN, "AGE"), (config.mask_dates, L.DATE_PATTERN, "DATE"))
    found = [regex_spans(text, pattern, name, "regex") for wanted, pattern, name in kinds if wanted]
    return F.concat(*found) if found else no_spans()


def entity_candidates(text: Column, config: MaskingConfig) -> Column:
    """Entities in document order (version 3: no medical spans), then sex terms."""
    wanted = [t for t, on in (("NAME", config.mask_names), ("DATE", config.mask_dates), ("LOCATION", config.mask_locations), ("ORGANIZATION", config.mask_organizations)) if on]
    found = F.filter(config.annotator.entities(text), lambda e: e["mask_type"].isin(*wanted)) if wanted else no_spans()
    if config.version >= 3:
        found = F.filter(found, lambda e: ~safety.is_medical_span(e["original_value"]))
    return F.concat(found, annotate.sex_spans(text)) if config.mask_sex else found


def sampled(spans: Column, ratio: float, key: Column, seed: int) -> Column:
    """At least one and about ``ratio`` of the spans, by the order of a hash of key and place; none at ratio 0."""
    if ratio == 0:
        return no_spans()
    size = F.greatest(F.lit(1), F.bround(F.size(spans) * F.lit(ratio)).cast("int"))
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), s["start_char"].cast("string"))).alias("h"), s.alias("s"))))
    return F.transform(F.slice(ranked, 1, size), lambda r: r["s"])


def neutral_candidates(text: Column, taken: Column, key: Column, config: MaskingConfig) -> Column:
    """A sample of neutral words outside the spans that are taken."""
    if not config.mask_low_risk_wording:
        return no_spans()
    free = F.filter(annotate.neutral_spans(text, config.version), lambda s: ~overlaps_any(s, taken))
    return sampled(free, config.mask_ratio, key, config.seed)


def metadata(spans: Column, version: int) -> Column:
    """Spans with constraint, number and token; in version 3 with word class, lemma, entity and safety flags."""

    def enriched(s: Column, i: Column) -> Column:
        value, kind = s["original_value"], s["mask_type"]
        fields = [s[f].alias(f) for f in ("start_char", "end_char", "original_value", "mask_type", "source")]
        fields.append(constraint(kind, value).alias("constraint_rule"))
        if version >= 3:
            one = safety.is_word(value)
            found = safety.flags(value)
            pos = F.when(~one, "").when(kind == "LOW_RISK_WORDING", "ADV").when(F.lower(value).isin("he", "she", "his", "her", "him", "hers"), "PRON").when(kind == "SEX", "NOUN").otherwise("")
            entity = F.when(s["source"].contains(":") & (kind != "LOW_RISK_WORDING"), F.substring_index(s["source"], ":", -1)).otherwise("")
            fields += [pos.alias("pos"), F.when(one, F.lower(value)).otherwise("").alias("lemma"), entity.alias("entity_type")]
            fields += [c.alias(n) for n, c in found.items()]
            fields.append(found["medical_concept"].alias("protected"))
        fields += [(i + 1).alias("mask_index"), F.lit(L.MASK).alias("mask_token")]
        return F.struct(*fields)

    return F.transform(spans, enriched)


def mask_text(df: DataFrame, text: str, key: str, config: MaskingConfig = MaskingConfig(), spans_as: str | None = None) -> DataFrame:
    """``df`` with ``masked_text`` and ``metadata`` (array of structs). Null texts give null in both.

    ``spans_as`` names a column for the bare spans; what reads only these costs no constraints and flags.
    """
    if clash := {"masked_text", "metadata", "_taken", "_spans"} & set(df.columns):
        raise ValueError(f"columns would be overwritten: {sorted(clash)}")
    value, by = F.col(f"`{text}`"), F.col(f"`{key}`")
    taken = df.withColumn("_taken", resolve(F.concat(regex_candidates(value, config), entity_candidates(value, config))))
    spans = taken.withColumn("_spans", F.array_sort(F.concat(F.col("_taken"), neutral_candidates(value, F.col("_taken"), by, config))))
    return spans.withColumn("masked_text", splice(value, F.col("_spans"))).withColumn("metadata", metadata(F.col("_spans"), config.version)).withColumnsRenamed({"_spans": spans_as} if spans_as else {}).drop("_taken", "_spans")


#: Output columns of the masked dataset with the input columns they come from.
PASSED = (("PMCID", "PMCID"), ("PMID", "PMID"), ("Case #", "Case #"), ("disease", "Disease"), ("title", "Title"))


def masked_dataset(cases: DataFrame, text: str = "Case presentation EN", key: str = "source_row_id", config: MaskingConfig = MaskingConfig()) -> DataFrame:
    """The masked dataset with 18 columns (17 in version 2). Cases without text are left out; a missing input column is empty."""
    known = cases.filter(F.col(f"`{text}`").isNotNull())
    masked = mask_text(known.select(F.col(f"`{key}`").alias("source_row_id"), *[(F.col(f"`{i}`") if i in cases.columns else F.lit("")).alias(o) for o, i in PASSED], F.col(f"`{text}`").cast("string").alias("original_text")), "original_text", "source_row_id", config)
    m = F.col("metadata")
    columns = [
        "source_row_id", "PMCID", "PMID", F.col("`Case #`"), "disease", "title", F.lit(text).alias("source_column"), "original_text", "masked_text",
        F.size(m).alias("masked_token_count"), joined(m, "original_value").alias("masked_tokens"), joined(m, "mask_type").alias("mask_types"),
        joined(m, "original_value").alias("original_mask_values"), joined(m, "constraint_rule").alias("replacement_constraints"),
        F.to_json(m).alias("mask_metadata"), F.lit(config.mask_ratio).alias("mask_ratio"), F.lit(f"mask-trial{config.version}").alias("masking_version"),
    ]
    if config.version >= 3:
        columns.append(F.lit(L.PROTECTION_POLICY).alias("protection_policy"))
    return masked.select(*columns)
