"""Analyses of masked and filled datasets: counts, projections, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions import lexicons as L
from casemill.operators.spans import count_of

FILLED_COLUMNS = ("PMCID", "PMID", "Case #", "variant_id", "masked_token_count", "title", "original_text", "masked_text", "filled_text")


def type_counts(types: Column) -> list[Column]:
    """How often each mask type stands in a joined list; 0 where the list is null or empty."""
    return [count_of(types, t).alias(t) for t in L.MASK_TYPES]


def category_counts(masked: DataFrame, keys: Sequence[str] = ("PMCID", "PMID", "Case #")) -> DataFrame:
    """Per masked case: keys, number of masks, counts by type, and pathogens named in masked values."""
    return masked.select(*[F.col(f"`{k}`") for k in keys], "masked_token_count", *type_counts(F.col("mask_types")), *[count_of(F.col("masked_tokens"), p).alias(p) for p in L.PATHOGENS])


def category_rollup(masked: DataFrame, by: str = "disease") -> DataFrame:
    """Counts by type over all cases of a group (spelling of the group's name levelled); aggregated before the shuffle."""
    name = F.nullif(F.lower(F.trim(F.regexp_replace(F.col(f"`{by}`"), r"\s+", " "))), F.lit(""))
    return masked.groupBy(name.alias(by)).agg(F.count(F.lit(1)).alias("cases"), F.sum("masked_token_count").cast("long").alias("masks"), *[F.sum(count_of(F.col("mask_types"), t)).cast("long").alias(t) for t in L.MASK_TYPES])


def project(df: DataFrame, columns: Sequence[str] = FILLED_COLUMNS) -> DataFrame:
    """Those of the columns that exist, in the given order."""
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


PREVIEW_COLUMNS = ("source_row_id", "disease", "masked_token_count", "mask_types", "masking_version", "protection_policy", "original_text", "masked_text")


def preview(df: DataFrame, key: str = "source_row_id", rows: int = 5, chars: int = 1500, columns: Sequence[str] = PREVIEW_COLUMNS) -> DataFrame:
    """The first rows by key with those of the columns that exist, texts cut to ``chars`` characters. A look at the data, no step of a pipeline."""
    shown = [c for c in columns if c in df.columns]
    return df.orderBy(F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in shown]).limit(rows).select(*[F.substring(f"`{c}`", 1, chars).alias(c) if df.schema[c].dataType.typeName() == "string" else F.col(f"`{c}`") for c in shown])


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns that ``df`` lacks, sorted."""
    return sorted(set(required) - set(df.columns))


def all_of_version(masked: DataFrame, version: str) -> DataFrame:
    """One row: whether every row has this masking version, and how many have not."""
    other = ~F.col("masking_version").eqNullSafe(F.lit(version))
    return masked.agg(F.coalesce(~F.bool_or(other), F.lit(True)).alias("all_match"), F.count_if(other).alias("others"))


def leaked_pathogens(values: DataFrame, value: str = "original_value") -> DataFrame:
    """Rows of masked values that hold a protected pathogen's name as a word, with the words found."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(f"`{value}`")), F.lit("[a-z]+"), F.lit(0)))
    hits = F.array_join(F.array_sort(F.array_intersect(words, F.array(*map(F.lit, L.PROTECTED_PATHOGENS)))), ",")
    return values.withColumn("pathogens", hits).filter(F.col("pathogens") != "")
