"""Ranked candidate words for neutral masks, from corpus counts or from any model.

``pool_ranking`` counts a fixed pool of neutral words over the whole corpus (its result is as small as
the pool). ``ngram_table`` keeps, for each pair of neighbours, the pool words seen between them.
A model provider is a function from contexts to ranked (token, score) lists, run per Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from casemill.functions import lexicons as L

CANDIDATES = "array<struct<token:string,score:double>>"
#: Neutral words that candidates are taken from, a fixed value.
POOL = (*L.SAFE_LOW_RISK_WORDS, "often", "usually", "mostly", "frequently", "largely", "chiefly", "broadly", "evidently", "normally", "not", "later", "initially")
CONTEXT = 900


def words(text: Column) -> Column:
    """Lower-case ASCII words in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def pool_ranking(corpus: DataFrame, text: str, pool: Sequence[str] = POOL) -> DataFrame:
    """(token, n) for each word of the pool over all texts, counted within tasks before the shuffle. Unseen words count 0."""
    spark = corpus.sparkSession
    seen = corpus.select(F.explode(F.filter(words(F.col(f"`{text}`")), lambda w: w.isin(*pool))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(w,) for w in pool], "token string").join(F.broadcast(seen), "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def ranked_pool(ranking: DataFrame, k: int = 8) -> Column:
    """The ``k`` most frequent words of a ranking as a literal column; ties by word."""
    rows = sorted(((r["n"], r["token"]) for r in ranking.collect()), key=lambda r: (-r[0], r[1]))[:k]
    total = sum(n for n, _ in rows) or 1
    return F.array(*[F.struct(F.lit(w).alias("token"), F.lit(n / total).alias("score")) for n, w in rows]).cast(CANDIDATES)


def ngram_table(corpus: DataFrame, text: str, k: int = 8, pool: Sequence[str] = POOL) -> DataFrame:
    """(prev, next, token, n, rank): pool words between two neighbours, the ``k`` most frequent per pair, ties by word."""
    w = words(F.col(f"`{text}`"))
    triples = F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda i: F.struct(F.element_at("w", (i - 1).cast("int")).alias("prev"), F.element_at("w", i.cast("int")).alias("token"), F.element_at("w", (i + 1).cast("int")).alias("next")))
    found = corpus.select(w.alias("w")).filter(F.size("w") >= 3).select(F.explode(F.filter(triples, lambda t: t["token"].isin(*pool))).alias("t")).select("t.*")
    counted = found.groupBy("prev", "next", "token").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("prev", "next").orderBy(F.desc("n"), "token")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def single_mask_context(text: Column, start: Column, window: int = CONTEXT) -> Column:
    """The text around the mask at ``start`` (0-based), other masks read as ``unknown``."""
    left = F.replace(F.substring(text, F.greatest(F.lit(0), start - window) + 1, F.least(start, F.lit(window))), F.lit(L.MASK), F.lit("unknown"))
    right = F.replace(F.substring(text, start + len(L.MASK) + 1, F.lit(window)), F.lit(L.MASK), F.lit("unknown"))
    return F.concat(left, F.lit(L.MASK), right)


def model_candidates(context: Column, predict: Callable[[Sequence[str]], Sequence[Sequence[tuple[str, float]]]], k: int = 8) -> Column:
    """Candidates by a model: ``predict`` takes contexts and gives ranked (token, score) lists. Whatever it raises fails the job."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("score", T.DoubleType())])))
    def run(contexts: pd.Series) -> pd.Series:
        return pd.Series([[{"token": t, "score": float(s)} for t, s in found[:k]] for found in predict([c if isinstance(c, str) else "" for c in contexts])], dtype=object)

    return run(context)


def model_predictions(context: Column, predict: Callable[[Sequence[str]], Sequence[Sequence[tuple[str, float]]]], k: int = 8, max_words: int = 512) -> Column:
    """``struct<candidates, error>`` by a model: ``predict`` takes contexts with one mask and gives ranked (token, score) lists.

    Contexts are cut to ``max_words`` words around their mask, as models read no more. A context without
    exactly one mask is an error, as is whatever ``predict`` raises: a batch that fails is asked row by row,
    so one bad row costs only itself. Null contexts have no candidates and no error.
    """

    def around(text: str) -> str:
        if text.count(L.MASK) != 1:
            raise ValueError(f"expected exactly one mask, found {text.count(L.MASK)}")
        left, right = (side.split() for side in text.split(L.MASK))
        if len(left) + len(right) < max_words:
            return text
        before = min(len(left), max(max_words // 2, max_words - 1 - len(right)))
        return " ".join([*left[len(left) - before :], L.MASK, *right[: max_words - 1 - before]])

    def ranked(found: Sequence[tuple[str, float]]) -> list[dict]:
        return [{"token": t.strip(), "score": float(s)} for t, s in sorted(found, key=lambda x: -x[1])[:k]]

    @F.pandas_udf(T.StructType([T.StructField("candidates", T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("score", T.DoubleType())]))), T.StructField("error", T.StringType())]))
    def run(contexts: pd.Series) -> pd.DataFrame:
        out: list[tuple[list | None, str | None]] = [([], None)] * len(contexts)
        asked: list[tuple[int, str]] = []
        for i, c in enumerate(contexts):
            try:
                if isinstance(c, str):
                    asked.append((i, around(c)))
            except ValueError as bad:
                out[i] = (None, str(bad))
        try:
            for (i, _), found in zip(asked, predict([c for _, c in asked]), strict=True):
                out[i] = (ranked(found), None)
        except Exception:
            for i, c in asked:
                try:
                    out[i] = (ranked(predict([c])[0]), None)
                except Exception as bad:
                    out[i] = (None, str(bad) or type(bad).__name__)
        return pd.DataFrame(out, columns=["candidates", "error"])

    return run(context)
