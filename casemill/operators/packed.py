"""Several values packed in one field: a quote-aware finite-state tokenizer gives one row per value.

The tokenizer walks a field once and tracks three things: the open quote, escapes, and the nesting
depth of brackets. It records every place outside quotes and brackets that could separate values,
by kind of delimiter. Which kinds really separate is decided per field afterwards: with a known
number of slots the subset of kinds that gives this number is taken, the most plausible one where
several do; without it every strong delimiter counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Delimiters that hardly ever stand inside a value, and what choosing to ignore a kind costs.
STRONG = {";": 3.0, "；": 3.0, "|": 3.0, "、": 3.0, "\t": 3.0, "\n": 3.0, " / ": 2.5}
#: Delimiters that do stand inside values: a comma costs little to ignore, one inside a date or a bare slash costs to use.
WEAK_IGNORE = {",": 0.5, "，": 0.5}
WEAK_USE = {"date,": 8.0, "/": 6.0}
QUOTES = {'"': '"', "'": "'", "“": "”", "«": "»", "「": "」", "‘": "’", "`": "`"}
OPEN, CLOSE = "([{", ")]}"
_DATE_COMMA = re.compile(r"[A-Za-z]{3,9}\.?\s+\d{1,2}(?:st|nd|rd|th)?\s*$")
_YEAR = re.compile(r"\s*\d{4}(?![\d/\-])")
_BETWEEN = re.compile(r"[  　]*")
_PLAIN = re.compile(r"[^;；|、\t\n\r,，/\\\"'“«「‘`()\[\]{}]+")
SLOT = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("value", T.StringType())]))


def _unwrapped(text: str) -> str:
    """The field without one pair of list brackets around all of it."""
    inner = text.strip()
    if len(inner) >= 2 and inner[0] in "[{(" and inner[-1] == CLOSE[OPEN.index(inner[0])]:
        depth = 0
        for i, ch in enumerate(inner):
            depth += (ch in OPEN) - (ch in CLOSE)
            if depth == 0 and i < len(inner) - 1:
                return text
        return inner[1:-1]
    return text


def _scan(text: str, use_depth: bool) -> tuple[list[tuple[int, int, str]], int]:
    """Possible separators outside quotes as (start, end, kind), and the depth that was left open."""
    found: list[tuple[int, int, str]] = []
    i, n, depth, fresh, quote = 0, len(text), 0, True, ""
    dead: set[str] = set()  # quotes that close nowhere in the rest of the field
    while i < n:
        ch = text[i]
        if quote:
            if ch == "\\" and i + 1 < n:
                i += 2
            elif ch == quote:
                if i + 1 < n and text[i + 1] == quote and not _ends_value(text, i + 1):
                    i += 2  # a doubled quote is an escaped one
                elif _ends_value(text, i + 1):
                    quote, fresh, i = "", False, i + 1
                else:
                    i += 1
            else:
                i += 1
            continue
        if m := _PLAIN.match(text, i):
            if fresh and m[0].strip():
                fresh = False
            i = m.end()
            continue
        if ch == "\\" and i + 1 < n:
            i, fresh = i + 2, False
            continue
        if fresh and ch in QUOTES and ch not in dead:
            if _closes(text, i + 1, QUOTES[ch]):
                quote, i = QUOTES[ch], i + 1
                continue
            dead.add(ch)
        if use_depth and ch in OPEN:
            depth, fresh, i = depth + 1, False, i + 1
            continue
        if use_depth and ch in CLOSE:
            depth, i = max(0, depth - 1), i + 1
            continue
        kind, a, b = "", i, i + 1
        if ch in STRONG or ch in "，":
            kind = ch
        elif ch == "\r":
            kind, b = "\n", i + (2 if text[i + 1 : i + 2] == "\n" else 1)
        elif ch == ",":
            kind = "date," if _DATE_COMMA.search(text[max(0, i - 16) : i]) and _YEAR.match(text, i + 1) else ","
        elif ch == "/":
            kind = " / " if text[i - 1 : i].isspace() or (text[i + 1 : i + 2].isspace()) or i == 0 or i + 1 == n else "/"
        if kind and depth == 0:
            found.append((a, b, kind))
            fresh = kind not in ("date,", "/")
        else:
            fresh = False
        i = b
    return found, depth


def _ends_value(text: str, i: int) -> bool:
    j = _BETWEEN.match(text, i).end()
    return j >= len(text) or text[j] in ";；|、\t\n\r,，/)]}"


def _closes(text: str, i: int, quote: str) -> bool:
    """Whether a quote opened before ``i`` closes at the end of some value."""
    while (j := text.find(quote, i)) >= 0:
        if text[j - 1] != "\\" and _ends_value(text, j + 1):
            return True
        i = j + 1
    return False


def _clean(value: str) -> str:
    """A value without surrounding spaces, enclosing quotes and escapes."""
    value = value.strip().strip("​﻿").strip()
    if len(value) >= 2 and value[0] in QUOTES and value[-1] == QUOTES[value[0]]:
        quote, value = value[-1], value[1:-1]
        value = value.replace(quote * 2, quote)
    return re.sub(r"\\(.)", r"\1", value).strip()


def _chosen(found: list[tuple[int, int, str]], text: str, slots: int | None) -> set[str]:
    kinds: dict[str, int] = {}
    for _, _, kind in found:
        kinds[kind] = kinds.get(kind, 0) + 1
    if slots is None:
        strong = {k for k in kinds if k in STRONG}
        return strong or {k for k in kinds if k in WEAK_IGNORE}
    names, best, least = list(kinds), set(), float("inf")
    for size in range(len(names) + 1):
        for subset in combinations(names, size):
            cost = sum(STRONG.get(k, WEAK_IGNORE.get(k, 0.0)) for k in names if k not in subset)
            cost += sum(WEAK_USE.get(k, 0.0) for k in subset)
            got = sum(kinds[k] for k in subset) + 1
            if got != slots:
                ends = [text[b:].strip() == "" for _, b, k in found if k in subset]
                extra = 1 if ends and ends[-1] else 0
                starts = 1 if any(text[:a].strip() == "" for a, _, k in found[:1] if k in subset) else 0
                if got - extra == slots:
                    cost += 0.2
                elif got - starts == slots or got - starts - extra == slots:
                    cost += 1.0
                else:
                    cost += 20.0 * abs(got - slots)
            if cost < least:
                best, least = set(subset), cost
    return best


def split_packed(text: str | None, slots: int | None = None) -> list[tuple[int, str]]:
    """(position, clean value) of every non-empty slot of a packed field; positions count from 1.

    Null, empty and blank fields have no values. Empty slots keep their place. With ``slots`` given a
    trailing delimiter beyond that number opens no slot. Lists in brackets are read like bare ones.
    """
    if text is None or not text.strip() or (slots is not None and slots <= 0):
        return []
    text = _unwrapped(text)
    found, depth = _scan(text, True)
    if depth:
        found, _ = _scan(text, False)
    kinds = _chosen(found, text, slots)
    values, at = [], 0
    for a, b, kind in found:
        if kind in kinds:
            values.append(text[at:a])
            at = b
    values.append(text[at:])
    cleaned = [_clean(v) for v in values]
    if slots is not None and len(cleaned) > slots:
        while len(cleaned) > slots and not cleaned[-1]:
            cleaned.pop()
        while len(cleaned) > slots and not cleaned[0]:
            cleaned.pop(0)
    elif slots is None and len(cleaned) > 1 and not cleaned[-1]:
        cleaned.pop()
    return [(i, v) for i, v in enumerate(cleaned, 1) if v]


def packed_values(text: Column, slots: Column | None = None) -> Column:
    """``array<struct<pos, value>>`` of a packed text column."""

    @F.pandas_udf(SLOT)
    def run(texts: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series(
            [[{"pos": p, "value": v} for p, v in split_packed(t if isinstance(t, str) else None, None if pd.isna(n) else int(n))] for t, n in zip(texts, counts)],
            dtype=object,
        )

    return run(text, slots if slots is not None else F.lit(None).cast("int"))


def explode_packed(df: DataFrame, key: str, fields: Sequence[str], slots: str | None = None) -> DataFrame:
    """Distinct rows (``key``, field, pos, value) of packed ``fields``; ``slots`` names the column with the number of slots.

    One shuffle: values are made distinct within each map task before they are exchanged on all four
    columns, so neither repeated loads nor a key that holds a third of all rows weigh on one task. Only
    ``key``, ``slots`` and ``fields`` are read; other columns, whatever their names, do no harm. Null
    keys are kept as a key of their own.
    """
    narrow = df.select(F.col(f"`{key}`").alias("k"), (F.col(f"`{slots}`").cast("int") if slots else F.lit(None).cast("int")).alias("n"), *[F.col(f"`{f}`").cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"f{i}").alias("text")) for i, f in enumerate(fields)])
    placed = narrow.select("k", "n", F.explode(entries).alias("e")).select("k", "n", "e.field", "e.text").filter(F.col("text").isNotNull())
    values = placed.select("k", "field", packed_values(F.col("text"), F.col("n")).alias("v"))
    out = values.select("k", "field", F.explode("v").alias("v")).select("k", "field", "v.pos", "v.value").dropDuplicates()
    return out.withColumnRenamed("k", key)


def pack(values: Iterable[str], delimiter: str = "; ", quote: str = '"') -> str:
    """The inverse for tests: values that hold the delimiter or a quote are quoted."""
    bare = delimiter.strip() or delimiter
    return delimiter.join(f"{quote}{v.replace(quote, quote * 2)}{quote}" if bare in v or quote in v or not v else v for v in values)
