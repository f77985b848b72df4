"""Filling of masked texts: variants, replacement per mask, assembly, validation, status.

Masks governed by rules are filled independently of each other, so all of it is one projection over
the array of masks; neutral words come from ranked candidates that pass the safety checks.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions import lexicons as L
from casemill.functions.binding import bind
from casemill.functions.dates import kind, shifted, shifted_any
from casemill.functions.draws import SEED, date_offset
from casemill.functions.values import fictitious, replaced_age, replaced_id, replaced_sex
from casemill.operators import safety
from casemill.operators.candidates import CANDIDATES
from casemill.operators.spans import count_of

MASK_SPLIT = r"\[MASK\]"
_BOOLS = (*L.FLAGS, "protected")
METADATA = (
    "array<struct<start_char:int,end_char:int,original_value:string,mask_type:string,source:string,constraint_rule:string,pos:string,lemma:string,entity_type:string,"
    + ",".join(f"{b}:boolean" for b in _BOOLS)
    + ",mask_index:int,mask_token:string>>"
)


@dataclass(frozen=True)
class FillingConfig:
    """How masks are filled. ``version`` 4 filters candidates, knows kinds of dates and validates; 3 does not."""

    variants: int = 1
    version: int = 4
    change_sex: bool = False
    date_shift_min: int = 30
    date_shift_max: int = 365
    max_masks: int | None = None
    top_k: int = 8
    seed: int = SEED
    model_name: str = "corpus-ranking"

    def __post_init__(self) -> None:
        if self.date_shift_min > self.date_shift_max or self.date_shift_min < 0:
            raise ValueError("date_shift_min must lie between 0 and date_shift_max")
        if self.variants < 1 or self.version not in (3, 4):
            raise ValueError("variants must be at least 1 and version 3 or 4")


def parsed_metadata(raw: Column) -> Column:
    """Mask metadata from JSON text: null, broken JSON and anything but a list give an empty array; members that are no objects are dropped."""
    variant = F.try_parse_json(raw)
    is_list = F.schema_of_variant(variant).startswith("ARRAY")
    items = F.from_json(F.when(is_list, raw), "array<string>")
    objects = F.filter(items, lambda i: F.ltrim(i).startswith("{"))
    whole = F.from_json(F.concat(F.lit("["), F.array_join(objects, ","), F.lit("]")), METADATA)
    return F.coalesce(whole, F.array().cast(METADATA))


def default_metadata(masked: Column) -> Column:
    """One neutral mask without an original value per mask token in the text."""
    n = count_of(masked, L.MASK).cast("int")
    fields = {"mask_type": F.lit("LOW_RISK_WORDING"), "original_value": F.lit("")}
    names = [f.split(":")[0] for f in METADATA.removeprefix("array<struct<").removesuffix(">>").split(",")]
    types = dict(f.split(":") for f in METADATA.removeprefix("array<struct<").removesuffix(">>").split(","))
    one = lambda i: F.struct(*[(i.cast("int") if x == "mask_index" else fields.get(x, F.lit(None).cast(types[x]))).alias(x) for x in names])
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one)).otherwise(F.array().cast(METADATA))


def by_index(masks: Column) -> Column:
    """Masks by ``mask_index``, a missing one counting 0; equal ones keep their order."""
    keyed = F.transform(masks, lambda m, i: F.struct(F.coalesce(m["mask_index"], F.lit(0)).alias("k"), i.alias("i"), m.alias("m")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(a["k"] != b["k"], a["k"] - b["k"]).otherwise(a["i"] - b["i"])), lambda x: x["m"])


def enriched_policies(masks: Column, change_sex: bool) -> Column:
    """Masks with the kind of date and the policy by which they are replaced."""

    def one(m: Column) -> Column:
        t, is_date = m["mask_type"], m["mask_type"] == "DATE"
        date_kind = F.when(is_date, kind(m["original_value"]))
        policy = (
            F.when(is_date & (date_kind == "unparsed"), "preserve_unparsed")
            .when(is_date, F.concat(F.lit("shift_"), date_kind))
            .when(t == "SEX", "swap_consistently" if change_sex else "preserve")
            .when(t == "AGE", "same_age_category")
            .when(t.isin("NAME", "LOCATION", "ORGANIZATION", "ID"), "fictitious_value")
            .otherwise("clinicalbert_filtered")
        )
        extra = {"date_kind": date_kind, "replacement_policy": policy, "preserve_chronology": F.when(is_date, date_kind.isin("absolute_date", "month_day")), "consistency_scope": F.when(t == "SEX", "row")}
        for name, column in extra.items():
            m = m.withField(name, column)
        return m

    return F.transform(masks, one)


def rule_replacement(m: Column, key: Column, variant: Column, days: Column, config: FillingConfig) -> tuple[Column, Column]:
    """(replacement, method) of a mask under a rule; null where no rule applies."""
    t, value, n = m["mask_type"], F.coalesce(m["original_value"], F.lit("")), F.coalesce(m["mask_index"], F.lit(0))
    by = (key, variant, n)
    date = shifted_any(value, days) if config.version >= 4 else shifted(value, days)
    date_method = F.regexp_replace(F.concat(F.lit("constraint_shift_"), kind(value)), "shift_unparsed$", "preserve_unparsed") if config.version >= 4 else F.lit("constraint_row_level_date_shift")
    replacement = (
        F.when(t == "AGE", replaced_age(value, *by, seed=config.seed))
        .when(t == "DATE", date)
        .when(t == "SEX", replaced_sex(value, config.change_sex))
        .when(t == "ID", replaced_id(value, *by, seed=config.seed))
        .otherwise(fictitious(t, *by, seed=config.seed))
    )
    method = (
        F.when(t == "AGE", "constraint_age_category")
        .when(t == "DATE", date_method)
        .when(t == "SEX", "constraint_change_sex_pair" if config.change_sex else "constraint_preserve_sex")
        .when(t == "NAME", "constraint_fictitious_name")
        .when(t == "LOCATION", "constraint_fictitious_location")
        .when(t == "ORGANIZATION", "constraint_fictitious_organization")
        .when(t == "ID", "constraint_fictitious_id")
    )
    return replacement, method


def classification(m: Column) -> Column:
    """What is known of a neutral word: word class, lemma, entity type and the safety flags, missing ones empty or false."""
    texts = [F.coalesce(m[f], F.lit("")).alias(f) for f in ("pos", "lemma", "entity_type")]
    return F.struct(*texts, *[F.coalesce(m[f], F.lit(False)).alias(f) for f in _BOOLS])


def fill_details(masks: Column, key: Column, variant: Column, days: Column, candidates: Column, config: FillingConfig) -> Column:
    """One struct per mask: number, type, original, replacement, method, constraint, shift, and for neutral words
    their classification, the checked candidates and the issues. A mask without a type is a neutral word; a type
    that is unknown takes the raw candidate of its rank, without a check."""
    empty = F.array().cast("array<struct<token:string,score:double,normalized_token:string,accepted:boolean,rejection_reasons:array<string>>>")

    def one(m: Column) -> Column:
        kind_ = F.coalesce(m["mask_type"], F.lit("LOW_RISK_WORDING"))
        replacement, method = rule_replacement(m, key, variant, days, config)
        protected = F.lit(False)
        for flag in _BOOLS:
            protected = protected | F.coalesce(m[flag], F.lit(False))
        rank = (variant - 1).cast("int")
        top = F.slice(candidates, 1, config.top_k)
        neutral = kind_ == "LOW_RISK_WORDING"
        ruled = kind_.isin(*[t for t in L.MASK_TYPES if t != "LOW_RISK_WORDING"])
        original = F.coalesce(m["original_value"], F.lit(""))

        def detail(got: Column) -> Column:
            return F.struct(
                F.coalesce(m["mask_index"], F.lit(0)).alias("mask_index"),
                kind_.alias("mask_type"),
                original.alias("original_value"),
                got["replacement"].alias("replacement"),
                got["method"].alias("method"),
                F.coalesce(m["constraint_rule"], F.lit("")).alias("constraint_rule"),
                F.when(neutral & F.lit(config.version >= 4), classification(m)).alias("classification"),
                F.when(kind_ == "DATE", days).alias("date_shift_days"),
                F.when(got["fallback"], F.array(F.lit("no_candidate_satisfied_constraints"))).otherwise(F.array().cast("array<string>")).alias("validation_issues"),
                got["checked"].alias("candidates"),
            )

        plain = lambda value, how: F.struct(value.alias("replacement"), how.alias("method"), F.lit(False).alias("fallback"), empty.alias("checked"))
        raw = F.coalesce(F.get(top, F.least(rank, F.size(top) - 1))["token"], original)
        chosen = F.when(ruled, plain(replacement, method))
        if config.version >= 4:
            chosen = chosen.when(neutral, safety.select_safe(top, original, m["pos"], protected, rank))
        return bind(chosen.otherwise(plain(raw, F.lit(L.METHOD_MODEL))), detail)

    return F.transform(masks, one)


def assembled(masked: Column, replacements: Column) -> Column:
    """The masked text with the k-th mask replaced by the k-th replacement; masks beyond them stay."""
    segments = F.split(masked, MASK_SPLIT, -1)
    last = F.size(segments) - 1
    return F.array_join(F.transform(segments, lambda s, i: F.concat(s, F.when(i < last, F.coalesce(F.get(replacements, i), F.lit(L.MASK))).otherwise(""))), "")


def _locate(part: Column, text: Column, start: Column) -> Column:
    """The 1-based place of ``part`` in ``text`` from ``start`` on; 0 if it isn't there."""
    return F.call_function("locate", part, text, start)


def segments_kept(masked: Column, filled: Column) -> Column:
    """Whether what stands around the masks is found in the filled text, in order."""
    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"))

    def step(acc: Column, segment: Column) -> Column:
        found = F.when(F.length(segment) == 0, acc["at"] + 1).otherwise(_locate(segment, filled, acc["at"] + 1))
        return F.struct(F.when(acc["ok"] & (found > 0), found - 1 + F.length(segment)).otherwise(acc["at"]).alias("at"), (acc["ok"] & (found > 0)).alias("ok"))

    return F.aggregate(F.split(masked, MASK_SPLIT, -1), start, step, lambda acc: acc["ok"])




def validation_issues(masked: Column, filled: Column, masks: Column | int, mask_issues: Column | None = None) -> Column:
    """What is wrong with a filled text: counts that differ, masks that are left, changed text, issues of masks. Each once, in order."""
    n = (masks if isinstance(masks, Column) else F.lit(masks)).cast("long")

    def found(text: Column, expected: Column) -> Column:
        checks = F.array(
            F.when(expected != n, F.concat(F.lit("mask_metadata_count_mismatch:"), expected.cast("string"), F.lit("!="), n.cast("string"))),
            F.when(F.contains(text, F.lit(L.MASK)), F.lit("unfilled_mask_remaining")),
            F.when(~segments_kept(masked, text), F.lit("non_mask_text_changed")),
        )
        return F.array_distinct(F.array_compact(F.concat(checks, mask_issues) if mask_issues is not None else checks))

    return bind(filled, lambda text: bind(count_of(masked, L.MASK), lambda expected: found(text, expected)))


def fill_status(masked: Column, filled: Column, issues: Column | None) -> Column:
    """empty, filled, filled_with_fallback or validation_failed; without ``issues`` (version 3) empty, filled or partially_filled."""
    blank = F.when(masked.rlike(r"(?U)^\s*$"), "empty")
    if issues is None:
        return blank.when(F.contains(filled, F.lit(L.MASK)), "partially_filled").otherwise("filled")
    return blank.when(F.size(issues) == 0, "filled").when(F.forall(issues, lambda i: F.contains(i, F.lit("no_candidate_satisfied_constraints"))), "filled_with_fallback").otherwise("validation_failed")


def with_variants(df: DataFrame, n: int) -> DataFrame:
    """Each row once per ``variant_id`` 1..n."""
    return df.withColumn("variant_id", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("augmentation_factor", F.lit(n))


def fill(masked: DataFrame, candidates: Column | None = None, key: str = "source_row_id", config: FillingConfig = FillingConfig(), error: Column | None = None) -> DataFrame:
    """Variants of a masked dataset with the filled text and how each mask was filled.

    Null texts count as empty and stay; masks without metadata are taken for neutral words. The metadata
    is parsed and sorted once per row, before the variants are made. ``candidates`` is a column of ranked
    words (``array<struct<token, score>>``); without it every neutral word falls back to its original. Where the
    column ``error`` is not null the row has status error, keeps its masked text and has no details.
    """
    text = F.coalesce(F.col("masked_text"), F.lit(""))
    raw = F.coalesce(F.col("mask_metadata"), F.lit("[]")) if "mask_metadata" in masked.columns else F.lit("[]")
    known = masked.withColumn("_parsed", parsed_metadata(raw))
    masks = by_index(F.when(F.size("_parsed") > 0, F.col("_parsed")).otherwise(default_metadata(text)))
    base = known.withColumn("masked_text", text).withColumn("_masks", F.slice(masks, 1, config.max_masks) if config.max_masks else masks)
    rows = with_variants(base, config.variants)
    offset = date_offset(F.col(f"`{key}`"), F.col("variant_id"), config.date_shift_min, config.date_shift_max, config.seed)
    ranked = candidates if candidates is not None else F.array().cast(CANDIDATES)
    detailed = rows.withColumn("_days", offset).withColumn("_all", fill_details(F.col("_masks"), F.col(f"`{key}`"), F.col("variant_id"), F.col("_days"), ranked, config))
    blank = F.col("masked_text").rlike(r"(?U)^\s*$")
    cut = F.when(blank, F.slice("_all", 1, 0)).otherwise(F.slice("_all", 1, count_of(F.col("masked_text"), L.MASK).cast("int")))
    filled = detailed.withColumn("details", cut).withColumn("filled_text", F.when(blank, F.col("masked_text")).otherwise(assembled(F.col("masked_text"), F.transform("details", lambda d: d["replacement"]))))
    out = filled.withColumn("predicted_tokens", F.array_join(F.transform("details", lambda d: d["replacement"]), "; ")).withColumn("mask_fill_details", F.to_json("details"))
    if config.version >= 4:
        per_mask = F.flatten(F.transform("details", lambda d: F.transform(d["validation_issues"], lambda x: F.concat(F.lit("mask_"), d["mask_index"].cast("string"), F.lit(":"), x))))
        issues = F.when(blank, F.array().cast("array<string>")).otherwise(validation_issues(F.col("masked_text"), F.col("filled_text"), F.size("_masks"), per_mask))
        out = out.withColumn("_issues", issues).withColumn("fill_status", fill_status(F.col("masked_text"), F.col("filled_text"), F.col("_issues"))).withColumn("validation_issues", F.to_json("_issues"))
        out = out.withColumn("source_mask_metadata", raw).withColumn("enriched_mask_metadata", F.to_json(enriched_policies(F.col("_parsed"), config.change_sex)))
    else:
        out = out.withColumn("fill_status", fill_status(F.col("masked_text"), F.col("filled_text"), None))
        policy = {"CHANGE_SEX": config.change_sex, "DATE_SHIFT_MIN_DAYS": config.date_shift_min, "DATE_SHIFT_MAX_DAYS": config.date_shift_max, "AGE_DELTA_BY_CATEGORY": L.AGE_SPREAD}
        out = out.withColumn("constraint_policy", F.lit(json.dumps(policy)))
    if error is not None:
        # A row that failed keeps its masked text and tells why; the others are not touched.
        failed = error.isNotNull()
        out = out.withColumns({
            "filled_text": F.when(failed, F.col("masked_text")).otherwise(F.col("filled_text")), "predicted_tokens": F.when(failed, "").otherwise(F.col("predicted_tokens")),
            "mask_fill_details": F.when(failed, "[]").otherwise(F.col("mask_fill_details")), "fill_status": F.when(failed, "error").otherwise(F.col("fill_status")),
            **({"validation_issues": F.when(failed, "[]").otherwise(F.col("validation_issues"))} if config.version >= 4 else {}),
        })
    return out.withColumn("fill_error", F.coalesce(error, F.lit("")) if error is not None else F.lit("")).withColumn("model_name", F.lit(config.model_name)).withColumn("filling_version", F.lit(f"mask-filling-trial{config.version}")).drop("_parsed", "_masks", "_days", "_all", "_issues", "details")
