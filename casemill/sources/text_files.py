"""Delimited text files in several encodings, text reports, and what loading does to missing values."""

from __future__ import annotations

import codecs
from collections.abc import Sequence
from datetime import datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemill.functions import lexicons as L

#: Encodings in the order in which they are tried, and the names Spark knows them by.
ENCODINGS = (("utf-8", "UTF-8"), ("utf-8-sig", "UTF-8"), ("cp932", "MS932"), ("shift_jis", "Shift_JIS"))
#: The order for filled tables, which are written with a byte order mark.
ENCODINGS_FILLED = (ENCODINGS[1], ENCODINGS[0], *ENCODINGS[2:])
BOM = "﻿"


def detect_encoding(spark: SparkSession, path: str, order: Sequence[tuple[str, str]] = ENCODINGS) -> str:
    """The first encoding that every file under ``path`` decodes in; ValueError if there is none.

    Files are read by the executors line by line, in splits, so none is ever held as a whole; only which encodings
    failed comes back. A line feed is never a part of another character in any of ``ENCODINGS``.
    """
    names = [e for e, _ in order]
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"))
    utf = [n for n in names if n.startswith("utf-8")]
    others = [n for n in names if n not in utf]
    if utf and lines.agg(F.coalesce(F.bool_and(F.is_valid_utf8("line")), F.lit(True))).first()[0]:
        fit = set(utf)
        if names[0] in fit:
            return names[0]
    else:
        fit = set()

    def ok(content: bytes, encoding: str) -> bool:
        try:
            codecs.decode(content, encoding)
        except UnicodeDecodeError:
            return False
        return True

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def fits(contents: pd.Series) -> pd.Series:
        return pd.Series([[ok(c, n) for n in others] for c in contents], dtype=object)

    if others:
        # Lines of ASCII alone decode in all of them. Lines come without the mark a file begins with, so it is asked for by itself.
        odd = lines.filter(F.col("line").rlike(r"[^\x00-\x7F]"))
        row = odd.select(fits(F.col("line").cast("binary")).alias("ok")).agg(*[F.coalesce(F.bool_and(F.col("ok")[i]), F.lit(True)).alias(n) for i, n in enumerate(others)]).first()
        kept = [n for n in others if row[n]]
        if any(not ok(BOM.encode(), n) for n in kept) and _marked(spark, lines.inputFiles()):
            kept = [n for n in kept if ok(BOM.encode(), n)]
        fit |= set(kept)
    for n in names:
        if n in fit:
            return n
    raise ValueError(f"{path} decodes in none of {names}")


def _marked(spark: SparkSession, paths: Sequence[str]) -> bool:
    """Whether a file begins with the byte order mark of UTF-8; three bytes of each are read."""
    conf, mark = spark._jsc.hadoopConfiguration(), BOM.encode()
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
        source = at.getFileSystem(conf).open(at)
        try:
            if all(source.read() == b for b in mark):
                return True
        finally:
            source.close()
    return False


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, schema: str | None = None) -> DataFrame:
    """A table from delimited text with a header; quotes are doubled inside quotes, values may hold line breaks.

    Without ``encoding`` it is detected. All columns are strings unless ``schema`` says otherwise; empty
    values are null.
    """
    found = encoding or detect_encoding(spark, path)
    name = dict(ENCODINGS).get(found, found)
    if name not in ("UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-32"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", name).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str, compression: str = "none") -> str:
    """Delimited text with a header in UTF-8; as many files as partitions."""
    df.write.mode("overwrite").option("header", True).option("compression", compression).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def write_single_csv(df: DataFrame, folder: str, stem: str, bom: bool = False, now: datetime | None = None, stamped: bool = True) -> str:
    """One file ``<stem>_<YYYYmmdd_HHMMSS>.csv`` (or ``<stem>.csv``) in any folder the cluster's file systems know, for hand-overs of bounded size.

    Executors write the parts into a folder beside the target and the driver joins them through the same
    file system, byte by byte; a folder without a scheme is a local one in local mode and the default file
    system's on a cluster.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    name = f"{stem}_{(now or datetime.now()):%Y%m%d_%H%M%S}" if stamped else stem
    if "://" not in folder and not folder.startswith("file:") and spark.sparkContext.master.startswith("local"):
        folder = Path(folder).absolute().as_uri()
    hadoop = jvm.org.apache.hadoop.fs.Path
    target, parts = hadoop(f"{folder}/{name}.csv"), hadoop(f"{folder}/.{name}.parts")
    system = target.getFileSystem(conf)
    system.mkdirs(target.getParent())
    write_csv(df.coalesce(1), parts.toString())
    out = system.create(target, True)
    try:
        if bom:
            out.write(bytearray(BOM.encode()))
        for status in sorted(system.globStatus(hadoop(f"{folder}/.{name}.parts/part-*.csv")), key=lambda s: s.getPath().getName()):
            source = system.open(status.getPath())
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
            source.close()
    finally:
        out.close()
    system.delete(parts, True)
    return target.toString().removeprefix("file:") if target.toString().startswith("file:") else target.toString()


def write_report(df: DataFrame, folder: str, stem: str, version: int = 3, now: datetime | None = None) -> str:
    """One time-stamped text report with a block per masked row, in order of the row's key."""
    target = Path(folder) / f"{stem}_{(now or datetime.now()):%Y%m%d_%H%M%S}.txt"
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("w", encoding="utf-8") as out:
        for i, row in enumerate(df.orderBy("source_row_id").select(report_block(version).alias("b")).toLocalIterator()):
            out.write(("\n" if i else "") + row["b"])
    return str(target)


def report_block(version: int = 3) -> Column:
    """The block of one masked row in the text report."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("nan"))
    labelled = lambda name: F.concat(F.lit(f"{name}: "), text(name))
    head = [F.lit("=" * 80), labelled("source_row_id"), labelled("disease"), labelled("masked_token_count"), labelled("mask_types"), F.lit(""), F.lit("Original:"), text("original_text"), F.lit(""), F.lit("Masked:"), text("masked_text"), F.lit("")]
    if version >= 3:
        tail = [F.concat(F.lit("Mask metadata: "), text("mask_metadata")), F.lit("")]
    else:
        tail = [F.concat(F.lit("Original mask values: "), text("original_mask_values")), F.concat(F.lit("Replacement constraints: "), text("replacement_constraints")), F.lit("")]
    return F.concat_ws("\n", *head, *tail)


def nulled(df: DataFrame, *columns: str) -> DataFrame:
    """Strings that stand for a missing value become null. Blank strings stay."""
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(*L.NA_STRINGS), F.col(f"`{c}`")) for c in columns})


def with_text(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is there; ValueError if the column is not."""
    if column not in df.columns:
        raise ValueError(f"column not found: {column}; there are {df.columns}")
    return df.filter(F.col(f"`{column}`").isNotNull() & ~F.col(f"`{column}`").isin(*L.NA_STRINGS))


def first_rows(df: DataFrame, key: str, n: int | None) -> DataFrame:
    """The first ``n`` rows by key, or all."""
    return df if n is None else df.orderBy(F.col(f"`{key}`")).limit(n)


def numbered(df: DataFrame, column: str = "source_row_id") -> DataFrame:
    """Rows numbered from 0 in file order. ValueError if the column is there already."""
    if column in df.columns or "index" in df.columns:
        raise ValueError(f"the input may not have a column {column} or index")
    # Rows are numbered within partitions; one count per partition says where each partition begins.
    place = df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = sorted((r["_part"], r["n"]) for r in place.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    begins, at = [], 0
    for part, n in sizes:
        begins.append((part, at))
        at += n
    table = df.sparkSession.createDataFrame(begins, "_part int, _begin long")
    return place.join(F.broadcast(table), "_part").select((F.col("_begin") + F.col("_at")).alias(column), *[F.col(f"`{c}`") for c in df.columns])


def with_metadata(df: DataFrame) -> DataFrame:
    """A masked table ready to be filled: null texts empty, null or missing metadata an empty list."""
    if "masked_text" not in df.columns:
        raise ValueError("column not found: masked_text")
    raw = F.coalesce(F.col("mask_metadata").cast("string"), F.lit("[]")) if "mask_metadata" in df.columns else F.lit("[]")
    return df.withColumns({"masked_text": F.coalesce(F.col("masked_text").cast("string"), F.lit("")), "mask_metadata": raw})


def latest_or_given(spark: SparkSession, given: str | None, folder: str, pattern: str = "*.csv") -> str:
    """The given file if there is one, else the newest of the folder."""
    return given or latest_file(spark, folder, pattern)


def latest_file(spark: SparkSession, folder: str, pattern: str = "*.csv") -> str:
    """The newest file that fits ``pattern``; FileNotFoundError if there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    row = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()
    if row is None or row["p"] is None:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return row["p"]


def new_files(spark: SparkSession, folder: str, known: list[str], pattern: str = "*.csv", fall_back: bool = False) -> list[str]:
    """Files that fit ``pattern`` and are not among ``known``, sorted by name; with ``fall_back`` the newest of all where there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    found = sorted(r["path"] for r in files.collect() if r["path"] not in set(known))
    return found or ([latest_file(spark, folder, pattern)] if fall_back else [])
