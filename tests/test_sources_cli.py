"""Files, encodings, command line, streams, analyses, entry."""

import csv
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from casemill import cli
from casemill.functions import draws
from casemill.operators import analyze, candidates
from casemill.sources import text_files as files
from casemill.streaming import masking

ROWS = [
    {"PMCID": "PMC1", "PMID": "7", "Case #": "1", "Disease": "Lassa fever", "Title": "t", "Case presentation EN": 'A 45-year-old man,\nsaid "he" on 2020-01-02. It was also stable.'},
    {"PMCID": "PMC2", "PMID": "", "Case #": "2", "Disease": "", "Title": "", "Case presentation EN": "NA"},
    {"PMCID": "PMC3", "PMID": "9", "Case #": "3", "Disease": "x", "Title": "発熱", "Case presentation EN": " "},
    {"PMCID": "PMC4", "PMID": "9", "Case #": "3", "Disease": "x", "Title": "発熱", "Case presentation EN": ""},
]


def write(path, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        w = csv.DictWriter(f, ROWS[0])
        w.writeheader()
        w.writerows(ROWS)
    return str(path)


def test_encoding_is_found_without_whole_files(spark, tmp_path):
    """Lines suffice, however long the file: a split of it is never one value."""
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "64")
    try:
        for name, content, found in (
            ("u", "発熱,a\n".encode() * 50, "utf-8"), ("s", "発熱,a\r\n".encode("cp932") * 50, "cp932"), ("late", b"a,b\n" * 50 + "発".encode("cp932"), "cp932"),
            ("mark", files.BOM.encode() + "発熱".encode("cp932"), None), ("cut", b"a\n\x81\nb" * 20, None), ("last", b"a,b\n" * 30 + "é\u2028".encode("cp1252", "ignore"), None), ("surrogate", b"\xed\xa0\x80\n" * 30, "cp932"), ("empty", b"", "utf-8"),
        ):
            path = tmp_path / f"{name}.csv"
            path.write_bytes(content)
            if found:
                assert files.detect_encoding(spark, str(path)) == found, name
            else:
                with pytest.raises(ValueError):
                    files.detect_encoding(spark, str(path))
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)


@pytest.mark.parametrize("encoding, found", [("utf-8", "utf-8"), ("utf-8-sig", "utf-8"), ("cp932", "cp932")])
def test_encodings(spark, tmp_path, encoding, found):
    path = write(tmp_path / "in.csv", encoding)
    assert files.detect_encoding(spark, path) == found
    df = files.read_csv(spark, path)
    assert [c.lstrip("﻿") for c in df.columns] == list(ROWS[0])
    got = files.numbered(df).orderBy("source_row_id").collect()
    assert got[2]["Title"] == "発熱" and got[0]["Case presentation EN"] == ROWS[0]["Case presentation EN"] and got[3]["Case presentation EN"] is None
    assert files.with_text(df, "Case presentation EN").count() == 2


def test_undecodable(spark, tmp_path):
    (tmp_path / "bad.csv").write_bytes(b"a\n\xff\xfe\x81\x00\n\x80\x80")
    with pytest.raises(ValueError):
        files.detect_encoding(spark, str(tmp_path / "bad.csv"))


def test_loading_rules(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a [MASK]", None), (3, "NA", "[1]")], "id int, masked_text string, mask_metadata string")
    assert [(r["masked_text"], r["mask_metadata"]) for r in files.with_metadata(df).orderBy("id").collect()] == [("", "[]"), ("a [MASK]", "[]"), ("NA", "[1]")]
    assert files.with_metadata(df.drop("mask_metadata")).first()["mask_metadata"] == "[]"
    assert files.nulled(df, "masked_text").filter("masked_text is null").count() == 2
    with pytest.raises(ValueError):
        files.with_metadata(df.drop("masked_text"))
    with pytest.raises(ValueError):
        files.with_text(df, "absent")
    with pytest.raises(ValueError):
        files.numbered(df.withColumnRenamed("id", "index"))


def test_newest_and_new_files(spark, tmp_path):
    for i, name in enumerate(("a.csv", "b.csv", "c.txt")):
        (tmp_path / name).write_text("x")
        time.sleep(0.05)
    assert files.latest_file(spark, str(tmp_path)).endswith("b.csv")
    assert [p[-5:] for p in files.new_files(spark, str(tmp_path), [files.latest_file(spark, str(tmp_path))])] == ["a.csv"]
    with pytest.raises(FileNotFoundError):
        files.latest_file(spark, str(tmp_path), "*.none")


def test_command_line_end_to_end(spark, tmp_path, capsys):
    source = write(tmp_path / "in.csv")
    out = tmp_path / "out"
    assert cli.main(["mask", "--input-csv", source, "--output-dir", str(out)], spark) == 0
    masked = next(out.glob("clinical_case_mask_trial3_*.csv"))
    report = next(out.glob("clinical_case_mask_trial3_*.txt")).read_text(encoding="utf-8")
    assert report.startswith("=" * 80 + "\nsource_row_id: 0\ndisease: Lassa fever\n") and "Mask metadata: [" in report
    rows = list(csv.DictReader(masked.open(encoding="utf-8", newline="")))
    assert [r["source_row_id"] for r in rows] == ["0", "2"] and rows[0]["original_text"] == ROWS[0]["Case presentation EN"]
    assert rows[0]["masked_text"] == 'A [MASK] [MASK],\nsaid "[MASK]" on [MASK]. It was [MASK] stable.'
    assert cli.main(["fill", "--input-csv", str(masked), "--output-dir", str(out), "--preset", "batch"], spark) == 0
    filled = next(out.glob("clinical_case_mask_filling4_*.csv"))
    assert filled.read_bytes().startswith(b"\xef\xbb\xbf")
    rows = list(csv.DictReader(filled.open(encoding="utf-8-sig", newline="")))
    assert len(rows) == 10 and {r["variant_id"] for r in rows} == set("12345") and all(r["fill_status"] in ("filled", "filled_with_fallback", "empty") for r in rows)
    assert all("woman" in r["filled_text"] for r in rows if r["source_row_id"] == "0")
    assert cli.main(["analyze", "--input-csv", str(masked), "--output-dir", str(out)], spark) == 0
    counts = list(csv.DictReader(next(out.glob("*counts_*.csv")).open()))
    assert counts[0]["AGE"] == "1" and counts[0]["SEX"] == "2" and counts[1]["masked_token_count"] == "0"
    assert cli.main(["project", "--input-csv", str(filled), "--output-dir", str(out)], spark) == 0
    assert "Rows processed: 10" in capsys.readouterr().out


def test_exit_codes(spark, tmp_path):
    assert cli.main(["mask", "--input-csv", str(tmp_path / "none.csv")], spark) == 1
    assert cli.main(["fill", "--input-csv", "x", "--date-shift-min-days", "9", "--date-shift-max-days", "1"], spark) == 2
    assert cli.main(["mask", "--input-csv", "x", "--mask-ratio", "7"]) == 2 and cli.main([]) == 2


def test_streams(spark, tmp_path):
    cases = spark.createDataFrame([(i, f"A {20 + i}-year-old man", datetime(2024, 1, 1 + i % 3)) for i in range(6)] + [(0, "A 20-year-old man", datetime(2024, 1, 1))], "karte_id long, t string, loaded_at timestamp")
    cases.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = masking.mask_files_once(spark, str(tmp_path / "in"), "t", "karte_id")
    assert got.count() == 7 and got.filter("masked_text = 'A [MASK] [MASK]'").count() == 7
    stream = spark.readStream.schema(cases.schema).parquet(str(tmp_path / "in"))
    query = masking.masked_stream(stream, "t", "karte_id", event_time="loaded_at").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("once").count() == 6
    typed = spark.readStream.schema(cases.schema).parquet(str(tmp_path / "in")).withColumn("mask_types", F.lit("AGE; SEX"))
    query = masking.windowed_counts(typed, "loaded_at").writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(r["n"] for r in spark.table("win").collect()) == 14 and spark.table("win").count() == 6


def test_counts_and_checks(spark):
    rows = [("PMC1", 1, 1, 3, "AGE; DATE; DATE", "x; Lassa; Hantaan Hanta hanta", "mask-trial3", " Lassa  fever"), ("PMC2", 2, 1, 0, None, None, "mask-trial3", "LASSA FEVER"), ("PMC3", 2, 1, 1, "LOW_RISK_WORDING", "also", None, None)]
    df = spark.createDataFrame(rows, "PMCID string, PMID long, `Case #` int, masked_token_count int, mask_types string, masked_tokens string, masking_version string, disease string")
    got = [r.asDict() for r in analyze.category_counts(df).orderBy("PMCID").collect()]
    assert (got[0]["DATE"], got[0]["Lassa"], got[0]["Hanta"], got[1]["AGE"], got[2]["LOW_RISK_WORDING"]) == (2, 1, 2, 0, 1)
    rollup = {r["disease"]: (r["cases"], r["masks"]) for r in analyze.category_rollup(df).collect()}
    assert rollup == {"lassa fever": (2, 3), None: (1, 1)}
    assert tuple(analyze.all_of_version(df, "mask-trial3").first()) == (False, 1) and tuple(analyze.all_of_version(df.limit(0), "v").first()) == (True, 0)
    assert analyze.missing_columns(df, ["PMCID", "b", "a"]) == ["a", "b"] and analyze.project(df, ("x", "PMID")).columns == ["PMID"]
    leaks = analyze.leaked_pathogens(spark.createDataFrame([("case Lassa-virus, PUUV",), ("fever",), (None,)], "original_value string"))
    assert [r["pathogens"] for r in leaks.collect()] == ["lassa,puuv"]


def test_candidates(spark):
    df = spark.createDataFrame([("he was also well",), ("she was also well",), ("he was mainly well",), (None,), ("",)], "t string")
    assert [c["token"] for c in df.select(candidates.ranked_pool(candidates.pool_ranking(df, "t"), 2).alias("c")).first()["c"]] == ["also", "mainly"]
    grams = {(r["prev"], r["next"], r["token"], r["n"], r["rank"]) for r in candidates.ngram_table(df, "t").collect()}
    assert grams == {("was", "well", "also", 2, 1), ("was", "well", "mainly", 1, 2)}
    ctx = spark.createDataFrame([("a [MASK] b [MASK] c",)], "t string").select(candidates.single_mask_context(F.col("t"), F.lit(2)).alias("c")).first()["c"]
    assert ctx == "a [MASK] b unknown c"
    model = candidates.model_candidates(F.col("t"), lambda texts: [[("x", 0.5), ("y", 0.4)] for _ in texts], 1)
    assert [c["token"] for c in df.select(model.alias("c")).first()["c"]] == ["x"]


def test_draws_are_stable_and_uniform(spark):
    df = spark.range(20_000)
    counts = [r["count"] for r in df.select(draws.draw(7, F.col("id"), "x").alias("d")).groupBy("d").count().collect()]
    assert len(counts) == 7 and max(counts) - min(counts) < 500
    assert df.select(draws.draw(7, F.col("id"), "x")).first()[0] == df.repartition(5).filter("id = 0").select(draws.draw(7, F.col("id"), "x")).first()[0]
    assert spark.range(1).select(draws.draw(0, F.col("id")).alias("d")).first()["d"] is None


def test_replay_is_the_old_generator(spark):
    import random

    got = spark.range(3).select(draws.replay(F.col("id"), F.lit(2), F.lit(1), 100_000, 999_999).alias("d")).collect()
    assert [r["d"] for r in got] == [random.Random(1000003 + 1009 * i + 97 * 2 + 1).randint(100_000, 999_999) for i in range(3)]


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_predictions_fail_row_by_row(spark):
    def predict(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("no answer")
        return [[(" y ", 0.1), ("x", 0.9)] for _ in texts]

    rows = [(0, "a [MASK] b"), (1, "boom [MASK]"), (2, "none"), (3, "[MASK] [MASK]"), (4, None), (5, "w " * 900 + "[MASK]" + " v" * 900)]
    df = spark.createDataFrame(rows, "k int, t string").coalesce(1)
    got = [r["m"] for r in df.select("k", candidates.model_predictions(F.col("t"), predict, 2).alias("m")).orderBy("k").collect()]
    assert [[c["token"] for c in m["candidates"]] if m["candidates"] is not None else None for m in got] == [["x", "y"], None, None, None, [], ["x", "y"]]
    assert [m["error"] for m in got] == [None, "no answer", "expected exactly one mask, found 0", "expected exactly one mask, found 2", None, None]
    assert df.filter("k = 5").select(candidates.model_predictions(F.col("t"), lambda ts: [[("n", float(len(t.split())))] for t in ts]).alias("m")).first()["m"]["candidates"][0]["score"] == 512


def test_presets_change_defaults_only(monkeypatch):
    given = cli.parsed(["fill", "--input-csv", "x", "--preset", "batch", "--top-k", "3"])
    assert (given.top_k, given.augmentation_factor, given.change_sex) == (3, 5, True) and cli.parsed(["fill", "--input-csv", "x"]).top_k == 8
    monkeypatch.setenv("MASK_FILLING_INPUT_CSV", "from-env")
    monkeypatch.setenv("MASK_FILLING_DEVICE", "cpu")
    assert (cli.parsed(["fill"]).input_csv, cli.parsed(["fill"]).device) == ("from-env", "cpu")
    assert cli.resolved_device("auto", 0) == "cpu" and cli.resolved_device("auto", 1) == "cuda" and cli.resolved_device("cpu", 1) == "cpu"
    with pytest.raises(RuntimeError):
        cli.resolved_device("cuda", 0)
    with pytest.raises(RuntimeError):
        cli.loaded("casemill.none:x")


def test_numbers_follow_the_order_of_the_rows(spark):
    df = spark.range(1000).repartition(7).sortWithinPartitions("id")
    rows = df.collect()
    got = {r["source_row_id"]: r["id"] for r in files.numbered(df).collect()}
    assert [got[i] for i in range(1000)] == [r["id"] for r in rows] and files.numbered(df.limit(0)).count() == 0


def test_single_file_by_the_file_system(spark, tmp_path):
    path = files.write_single_csv(spark.createDataFrame([("é,\n\"", 1)], "a string, b int"), tmp_path.as_uri(), "x", bom=True, stamped=False)
    assert path == str(tmp_path / "x.csv") and (tmp_path / "x.csv").read_bytes().startswith(b"\xef\xbb\xbfa,b") and [f.name for f in tmp_path.iterdir() if f.name.endswith("parts")] == []
    assert files.new_files(spark, str(tmp_path), [], "*.csv") and files.new_files(spark, str(tmp_path), files.new_files(spark, str(tmp_path), []), fall_back=True)
    assert files.latest_or_given(spark, "g", str(tmp_path)) == "g" and files.latest_or_given(spark, None, str(tmp_path)).endswith("x.csv")


def test_preview(spark):
    df = spark.createDataFrame([(i, "t" * 2000) for i in range(9)], "source_row_id long, masked_text string")
    assert [(r[0], len(r[1])) for r in analyze.preview(df).collect()] == [(i, 1500) for i in range(5)]
