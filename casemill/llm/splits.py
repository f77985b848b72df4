"""Splits that keep related records together.

Records are tied by equal keys (entity, article number, article id), also through further records.
The ties form a bipartite graph of entity nodes and key nodes. Components come from parallel hooking
and shortcutting over parent tables: in each round every tree root with an edge to a smaller root is
hooked onto the smallest such root, trees are flattened by parent jumping, and the edges are
contracted to the roots. The rounds end when no edge joins two roots, after O(log n) of them.

Splits are then chosen by subset sums: the histogram of component sizes (never the components) goes to
the driver, where bitsets over reachable sums pick how many components of each size go to each split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casemill.session import cut

#: A key that holds more than one in HOT of all rows is hot; there are fewer than HOT such keys, so they are broadcast.
HOT = 256
#: Sums are kept in this many units; a unit of large components is a row or more, the rest is chosen in rows.
SUM_UNITS = 1 << 22
_KIND = 1 << 60
#: Full-width digits and what may stand between digits of a number, as fixed values.
_WIDE, _NARROW = "０１２３４５６７８９", "0123456789"


def article_number(pmcid: Column) -> Column:
    """The eight-digit article number in any spelling of a PMCID as a long, null where there is none.

    Letters, blanks, marks, full-width digits, leading zeros, a trailing ``.0`` or version do no harm.
    """
    digits = F.translate(pmcid.cast("string"), _WIDE, _NARROW)
    joined = F.regexp_replace(digits, r"(?<=\d)[\s_,\-​  ]+(?=\d)", "")
    return F.nullif(F.regexp_extract(joined, r"(?<!\d)0*([1-9]\d{7})(?!\d)", 1), F.lit("")).cast("long")


def hot_join(left: DataFrame, right: DataFrame, key: str, left_rows: int) -> DataFrame:
    """Left join of ``left`` with ``right`` (unique on ``key``) that no hot key can slow down.

    Hot keys of ``left`` are counted with map-side aggregation; fewer than HOT of them can exist, so
    their rows of ``right`` are broadcast, and all other rows take the shuffle join.
    """
    hot = left.groupBy(key).count().filter(F.col("count") > max(100_000, left_rows // HOT)).select(F.col(key).alias("_hot"))
    found = [r[0] for r in hot.limit(HOT).collect()]
    if not found:
        return left.join(right, key, "left")
    is_hot = F.col(key).isin(found)
    few = F.broadcast(right.filter(is_hot))
    return left.filter(is_hot).join(few, key, "left").unionByName(left.filter(~F.coalesce(is_hot, F.lit(False))).join(right, key, "left"))


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) of every node in ``edges`` (columns a, b, longs), the root being the smallest node of its component.

    Null ends, loops and repeated edges do no harm; an empty table has no nodes.
    """
    pairs = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    ordered = pairs.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    parents: DataFrame | None = None
    live = cut(ordered.distinct())
    count = live.count()
    for _ in range(max_rounds):
        # Hook: every node goes under its smallest neighbour, itself included.
        both = live.select(F.col("hi").alias("node"), F.col("lo").alias("to")).unionByName(live.select(F.col("lo").alias("node"), F.col("hi").alias("to")))
        hooks = cut(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("up")))
        # Shortcut: jump to the parent's parent until the trees are flat.
        while True:
            jumps = hooks.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            hooks_next = cut(hot_join(hooks, jumps, "up", count).select("node", F.col("upper").alias("up"), (F.col("up") != F.col("upper")).alias("moved")))
            hooks = hooks_next.select("node", "up")
            if hooks_next.filter("moved").limit(1).count() == 0:
                break
        # Contract edges and parents to the new roots.
        if parents is None:
            parents = hooks.select("node", F.col("up").alias("root"))
        else:
            ups = hooks.select(F.col("node").alias("root"), F.col("up"))
            parents = cut(hot_join(parents, ups, "root", nodes).select("node", F.coalesce("up", "root").alias("root")))
        nodes = parents.count()
        half = hot_join(live, hooks.select(F.col("node").alias("hi"), F.col("up").alias("hi_up")), "hi", count)
        full = hot_join(half, hooks.select(F.col("node").alias("lo"), F.col("up").alias("lo_up")), "lo", count)
        live = cut(full.filter("hi_up != lo_up").select(F.greatest("hi_up", "lo_up").alias("hi"), F.least("hi_up", "lo_up").alias("lo")).distinct())
        count = live.count()
        if count == 0:
            return parents
    raise RuntimeError("components did not settle")


def _node(value: Column, kind: int) -> Column:
    """A long for a key of one kind; kinds sort in order, values beyond 60 bits are hashed into them."""
    inside = (value >= 0) & (value < _KIND)
    return F.when(inside, value + F.lit(kind * _KIND)).when(value.isNotNull(), F.xxhash64(value).bitwiseAND(F.lit(_KIND - 1)) + F.lit(kind * _KIND))


def tie_articles(variants: DataFrame, entity: str = "source_row_id", article: str = "PMCID", other: str = "PMID") -> DataFrame:
    """``variants`` with ``component`` (long) and ``article`` (``PMC`` and the smallest article number tied to the row).

    ``article`` is null in components without an article number. Rows without any key are a component
    each and have a null ``component``; nulls tie nothing. Every row comes out once; other columns stay.
    """
    rows = variants.withColumns({"_e": F.col(f"`{entity}`").cast("long"), "_a": article_number(F.col(f"`{article}`")), "_p": F.col(f"`{other}`").cast("long")})
    keys = rows.select(_node(F.col("_a"), 0).alias("art"), _node(F.col("_p"), 1).alias("pmid"), _node(F.col("_e"), 2).alias("ent"))
    # The entity ties its keys; where it is null the row itself ties its two keys. A lone key is a loop.
    first = F.coalesce("ent", "art", "pmid")
    edges = keys.select(F.explode(F.array(F.struct(first.alias("a"), F.coalesce("art", first).alias("b")), F.struct(first.alias("a"), F.coalesce("pmid", first).alias("b")))).alias("e")).select("e.a", "e.b")
    roots = components(edges)
    named = rows.withColumn("node", F.coalesce(_node(F.col("_e"), 2), _node(F.col("_a"), 0), _node(F.col("_p"), 1))).drop("_e", "_a", "_p")
    joined = hot_join(named, roots, "node", variants.count())
    return joined.withColumnRenamed("root", "component").withColumn("article", F.when(F.col("component") < F.lit(_KIND), F.concat(F.lit("PMC"), F.col("component").cast("string")))).drop("node")


def _closest(sizes: Mapping[int, int], goal: int, scale: int = 1, fill: int = 0) -> dict[int, int]:
    """How many components of each size make up the reachable sum (in units of ``scale`` rows) closest to ``goal``; up to ``fill`` units below it are as good."""
    # Largest sizes first: each may only be used while it fits near the goal.
    items: list[tuple[int, int, int]] = []
    for size, count in sorted(sizes.items(), reverse=True):
        weight = max(1, round(size / scale))
        most, bundle = min(count, (2 * goal) // weight + 1), 1
        while most > 0:
            take = min(bundle, most)
            items.append((size, take, weight * take))
            most -= take
            bundle *= 2
    limit = 2 * goal + 1
    mask = (1 << (limit + 1)) - 1
    reach, first = 1, np.full(limit + 1, -1, dtype=np.int32)
    for i, (_, _, weight) in enumerate(items):
        if weight > limit:
            continue
        new = (reach << weight) & mask & ~reach
        if new:
            bits = np.unpackbits(np.frombuffer(new.to_bytes(limit // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: limit + 1]
            first[bits.astype(bool)] = i
            reach |= new
        if (reach >> goal) & 1:
            break
    sums = np.concatenate([[0], np.nonzero(first >= 0)[0]])
    off = np.where(sums > goal, sums - goal, np.maximum(0, goal - fill - sums))
    best = int(sums[np.lexsort((np.abs(sums - goal), off))[0]])
    taken: dict[int, int] = {}
    while best > 0:
        size, take, weight = items[first[best]]
        taken[size] = taken.get(size, 0) + take
        best -= weight
    return taken


def choose_counts(sizes: Mapping[int, int], shares: Sequence[float], units: int = SUM_UNITS) -> list[dict[int, int]]:
    """How many components of each size go to each split, the first split taking what the others leave.

    ``sizes`` maps a component size to its multiplicity. For the later splits, in order, a bitset over
    sums (multiplicities split into binary bundles) finds the reachable total closest to the split's
    share of all rows. Large components are chosen in units of total / ``units`` rows (of one row where
    there are fewer rows than units), the remainder is then closed by exact sums of rows; so the work is
    bounded and the totals lie within the smallest component of the best ones at every number of rows.
    """
    left = dict(sizes)
    total = sum(s * m for s, m in sizes.items())
    scale = max(1, -(-total // units))
    out: list[dict[int, int]] = [{} for _ in shares]

    def move(k: int, size: int, n: int) -> None:
        out[k][size] = out[k].get(size, 0) + n
        left[size] -= n

    for k in range(1, len(shares)):
        goal = round(shares[k] / sum(shares) * total)
        # Coarse: components of at least a unit, leaving what smaller ones can fill.
        large = {s: m for s, m in left.items() if s >= scale}
        small = sum(s * m for s, m in left.items() if s < scale)
        for size, n in _closest(large, round(goal / scale), scale, small // scale).items():
            move(k, size, n)
        # Fill by true sizes, then give back small ones to leave a gap that exact sums close best.
        goal -= sum(s * n for s, n in out[k].items())
        for size in sorted(left, reverse=True):
            if n := min(left[size], max(0, goal) // size):
                move(k, size, n)
                goal -= size * n
        gap = max(1, units // 4)
        for size in sorted(s for s in out[k] if s <= gap):
            if n := min(out[k][size], max(0, -(-(gap - goal) // size))):
                move(k, size, -n)
                goal += size * n
        for size, n in _closest(left, max(0, goal)).items():
            move(k, size, n)
        out[k] = {s: n for s, n in out[k].items() if n}
    out[0] = {s: m for s, m in left.items() if m}
    return out


def assign_splits(tied: DataFrame, shares: Mapping[str, float], buckets: int = 1024) -> DataFrame:
    """``tied`` (with ``component``) with ``split``: all rows of a component share it, totals lie as close to ``shares`` as sizes allow.

    Rows with a null component count as one component together. The first split in ``shares`` takes
    what the subset sums of the others leave. Components of one size are told apart by a rank that is
    computed in buckets, so that no task sees all components of a size.
    """
    names = list(shares)
    sized = cut(tied.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    sizes = {int(r["size"]): int(r["n"]) for r in sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most sqrt(2 * rows) sizes
    spark = tied.sparkSession
    counts = choose_counts(sizes, [shares[n] for n in names])
    plan = []
    for size in sizes:
        at = 0
        for k in (*range(1, len(names)), 0):
            if n := counts[k].get(size, 0):
                plan.append((size, at, at + n, names[k]))
                at += n
    plan_table = spark.createDataFrame(plan, "size long, lo long, hi long, split string")
    placed = sized.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets)))
    offsets = placed.groupBy("size", "bucket").count().withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("size", "bucket", "before")
    local = placed.withColumn("rank", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("component")) - 1)
    ranked = local.join(offsets, ["size", "bucket"]).withColumn("at", F.col("rank") + F.col("before"))
    split_of = ranked.join(F.broadcast(plan_table), (ranked["size"] == plan_table["size"]) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select(F.col("component").alias("_c"), "split")
    keyed = tied.withColumn("_c", F.coalesce("component", F.lit(-1)))
    split_of = split_of.withColumn("_c", F.coalesce("_c", F.lit(-1)))
    return hot_join(keyed, cut(split_of), "_c", sum(s * m for s, m in sizes.items())).drop("_c")
