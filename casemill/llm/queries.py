"""Queries of the llm problems, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm import leaks, mojibake, pii, splits, tokens, toxicity
from casemill.llm.sql import ORACLE_SQL as ORACLE_SQL
from casemill.sources.tables import table

CASES, FILLED = "karte_example", "clinical_case_mask_filling4"
CASE_TEXT = "Case presentation EN"
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every filled variant with the article that stands for all variants tied to it."""
    variants = table(spark, folder, FILLED).select("source_row_id", "variant_id", "PMCID", "PMID")
    return splits.tie_articles(variants).select("source_row_id", "variant_id", "article").distinct()


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Every filled variant with its split; tied variants share one."""
    variants = table(spark, folder, FILLED).select("source_row_id", "variant_id", "PMCID", "PMID")
    return splits.assign_splits(splits.tie_articles(variants), SHARES).select("source_row_id", "variant_id", "article", "split").distinct()


def p1_split_check(spark: SparkSession, folder: str) -> DataFrame:
    """One row on the splits of p1_splits: rows, rows of the source, cases and articles that stand in several splits, and whether every total lies within one case's rows of its share."""
    variants = table(spark, folder, FILLED).select("source_row_id", "variant_id", "PMCID", "PMID")
    out = splits.assign_splits(splits.tie_articles(variants), SHARES)
    totals = out.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("split") == s).alias(s) for s in SHARES])
    apart = lambda key: out.groupBy(key).agg((F.min("split") != F.max("split")).alias("apart")).agg(F.count_if("apart").alias(f"{key}_apart"))
    near = [F.abs(F.col(s) - F.col("n") * share) <= 5 for s, share in SHARES.items()]
    # Three tables of one row each.
    one = totals.select("n", F.coalesce(near[0] & near[1] & near[2], F.lit(True)).alias("near"), F.lit(1).alias("k"))
    return one.join(apart("source_row_id").withColumn("k", F.lit(1)), "k").join(apart("article").withColumn("k", F.lit(1)), "k").drop("k")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Titles and case texts of which at least a part was decoded wrongly."""
    return mojibake.find_garbled(table(spark, folder, CASES), "karte_id", ("Title", CASE_TEXT))


def p2_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The same values with their original wording as far as it can be restored."""
    return mojibake.restore_garbled(table(spark, folder, CASES), "karte_id", ("Title", CASE_TEXT))


def _given_names(spark: SparkSession, folder: str) -> frozenset[str]:
    return pii.learn_given_names([table(spark, folder, CASES).select(F.col(f"`{CASE_TEXT}`")), table(spark, folder, FILLED).select("filled_text")])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every item of personal information in case texts and filled variants."""
    names = _given_names(spark, folder)
    cases = pii.find_pii(table(spark, folder, CASES), CASE_TEXT, {"tbl": F.lit(CASES), "row_id": F.col("karte_id"), "variant_id": F.lit(0)}, names)
    filled = pii.find_pii(table(spark, folder, FILLED), "filled_text", {"tbl": F.lit(FILLED), "row_id": F.col("source_row_id"), "variant_id": F.col("variant_id")}, names)
    return cases.unionByName(filled)


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The same texts with typed placeholders in place of the items."""
    cases = table(spark, folder, CASES).select(F.lit(CASES).alias("tbl"), F.col("karte_id").alias("row_id"), F.lit(0).alias("variant_id"), F.col(f"`{CASE_TEXT}`").alias("text"))
    filled = table(spark, folder, FILLED).select(F.lit(FILLED).alias("tbl"), F.col("source_row_id").alias("row_id"), "variant_id", F.col("filled_text").alias("text"))
    return pii.redact_column(cases.unionByName(filled), "text", "redacted", _given_names(spark, folder)).drop("text")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document by byte_bpe_50k, an empty list for null and empty texts."""
    return table(spark, folder, "documents").select("doc_id", tokens.encoder(spark)(F.col("text")).alias("ids"))


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the evaluation items it leaks and the words of the longest passage of each."""
    return leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the evaluation items it leaks."""
    return p7_leaks(spark, folder).select("doc_id", "item_id")


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its score for abusive, hateful or sexual content."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    model = toxicity.train(docs, table(spark, folder, "doc_labels"))
    return toxicity.score(docs, model).drop("text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with such content."""
    return p8_scores(spark, folder).filter(F.col("score") >= toxicity.THRESHOLD).select("doc_id").distinct()


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    """The rate of such content per source."""
    return toxicity.rates(p8_scores(spark, folder))


QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p1_split_check, p2_found, p2_restored, p4_found, p4_redacted, p6_ids, p7_found, p7_leaks, p8_found, p8_scores, p8_rates)}
