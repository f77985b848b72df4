"""Ties against union-find, split totals, odd tables."""

import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from casemill.llm.splits import article_number, assign_splits, choose_counts, components, tie_articles

SCHEMA = "source_row_id long, variant_id int, PMCID string, PMID long, component2 string"


def brute(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keys = []
    for i, (e, _, pmc, pmid, _) in enumerate(rows):
        m = re.search(r"(?<!\d)0*([1-9]\d{7})(?!\d)", unicodedata.normalize("NFKC", pmc)) if pmc else None
        own = [k for k in [("e", e) if e is not None else None, ("a", int(m[1])) if m else None, ("p", pmid) if pmid is not None else None] if k] or [("row", i)]
        keys.append(own[0])
        for k in own:
            parent[find(k)] = find(own[0])
    best = {}
    for k in list(parent):
        if k[0] == "a":
            best[find(k)] = min(best.get(find(k), 10**9), k[1])
    return [f"PMC{best[find(k)]}" if find(k) in best else None for k in keys]


def test_article_numbers(spark):
    texts = ["PMC40036524", "PMCID: PMC39481207", "PMC-40056660", "PMC40020463​", "PMC040029484", "PMC 40008010", "pmc40056610", "40007291", "40094990.0", " PMC40088921 ", "PMC39481207.1", "ＰＭＣ３９４８１２０７", "PMC", "", None, "PMC123"]
    expected = [40036524, 39481207, 40056660, 40020463, 40029484, 40008010, 40056610, 40007291, 40094990, 40088921, 39481207, 39481207, None, None, None, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r["n"] for r in df.select("i", article_number(F.col("t")).alias("n")).orderBy("i").collect()] == expected


def test_ties_equal_union_find(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1, 60), v, rng.choice([None, f"PMC{40000000 + rng.randint(1, 40)}", f"4000000{rng.randint(1, 9)}.0"]), rng.choice([None, 60000000 + rng.randint(1, 40)]), "x") for v in range(300)]
    # A long chain, rows without any key, nulls in the entity, repeated rows, one hot article.
    rows += [(1000 + i, 1, f"PMC{41000000 + i}", 61000000 + i + j, "x") for i in range(20) for j in (0, 1)]
    rows += [(None, 1, "PMC42000000", 62000000, "x"), (None, 2, None, 62000000, "x"), (None, 3, None, None, "x"), rows[0], rows[0]]
    rows += [(5000 + i, 1, "PMC43000000", None, "x") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = tie_articles(df)
    assert got.count() == len(rows) and "component2" in got.columns
    expected = Counter((r[0], r[1], a) for r, a in zip(rows, brute(rows)))
    assert Counter((r["source_row_id"], r["variant_id"], r["article"]) for r in got.collect()) == expected


def test_components_of_odd_tables(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 5), (None, 1), (7, None), (3, 1), (9, 8)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (8, 8), (9, 8)}
    empty = spark.createDataFrame([], SCHEMA)
    assert tie_articles(empty).count() == 0 and assign_splits(tie_articles(empty), {"train": 0.8, "test": 0.2}).count() == 0


@pytest.mark.parametrize("sizes", [{1: 1000}, {3: 40, 7: 9, 50: 2, 1: 11}, {100: 1}, {100: 1, 1: 1}, {}, {2: 50}])
def test_counts_reach_the_closest_total(sizes):
    total = sum(s * n for s, n in sizes.items())
    counts = choose_counts(sizes, [0.8, 0.1, 0.1])
    assert Counter({s: sum(c.get(s, 0) for c in counts) for s in sizes}) == Counter(sizes)
    reach = {0}
    for s, n in sizes.items():
        reach = {r + k * s for r in reach for k in range(n + 1)}
    goal = round(0.1 * total)
    got = sum(s * n for s, n in counts[1].items())
    assert abs(got - goal) == min(abs(r - goal) for r in reach)


def test_scaled_sums_keep_all_components():
    sizes = {1: 5000, 13: 700, 4000: 3}
    counts = choose_counts(sizes, [0.8, 0.1, 0.1], units=2000)
    assert Counter({s: sum(c.get(s, 0) for c in counts) for s in sizes}) == Counter(sizes)


@pytest.mark.parametrize("sizes", [{3: 20_000_000}, {1: 9_000_000, 2: 4_000_000, 5: 900_000, 23: 40_000, 3000: 700, 900_000: 7}, {22: 3_000_000}, {6_000_000: 1, 5_000_000: 2, 84_000_000: 1}])
def test_large_inputs_meet_the_shares(sizes):
    total = sum(s * n for s, n in sizes.items())
    counts = choose_counts(sizes, [0.8, 0.1, 0.1])
    assert Counter({s: sum(c.get(s, 0) for c in counts) for s in sizes}) == Counter(sizes)
    assert all(n >= 0 for c in counts for n in c.values())
    got = sum(s * n for s, n in counts[1].items())
    assert abs(got - 0.1 * total) <= min(sizes) or got == 10_000_000


@pytest.mark.parametrize("sizes", [{1: 4_194_304}, {1: 4_194_305}, {1: 40_000_000}, {2: 200_000_000, 3: 200_000_000}, {10: 1_000_000}, {1: 2 * 10**10, 5: 10**10, 40: 75 * 10**7}, {10**10: 3, 17: 10**9}, {1: 1_000_000, 700_000_000: 1}])
def test_shares_hold_at_every_number_of_rows(sizes):
    total = sum(s * n for s, n in sizes.items())
    counts = choose_counts(sizes, [0.8, 0.1, 0.1])
    assert Counter({s: sum(c.get(s, 0) for c in counts) for s in sizes}) == Counter(sizes) and all(n >= 0 for c in counts for n in c.values())
    got = [sum(s * n for s, n in c.items()) for c in counts]
    if max(sizes) <= 0.8 * total:
        assert all(abs(g - round(0.1 * total)) <= min(sizes) for g in got[1:])
    else:  # one component alone is larger than the share of the first split: all that is left goes to the others
        assert got[1] + got[2] == total - max(sizes)


def test_tied_rows_share_a_split(spark):
    rng = random.Random(5)
    rows = [(rng.randint(1, 400), v, f"PMC{40000000 + rng.randint(1, 300)}", None, "x") for v in range(2000)] + [(None, 1, None, None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    tied = tie_articles(df)
    out = assign_splits(tied, {"train": 0.8, "validation": 0.1, "test": 0.1}, buckets=8).collect()
    assert len(out) == len(rows) and all(r["split"] for r in out)
    by = {}
    for r in out:
        by.setdefault(r["component"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by.values())
