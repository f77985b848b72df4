"""Deeply nested semi-structured records become flat tables that keep parent-child links.

A record is read as a stream, token by token and without building it: every field gives one
(path, ordinals, value) triple in order of appearance. ``path`` is the chain of field names with ``[]``
for a repeated one, ``ordinals`` the one-based positions within the repeated ancestors. Triples are
grouped by their nearest repeated ancestor, and each group is pivoted into the rows of one table, whose
key is the record's key and the ordinals. All of that happens inside the row of the record, so no
shuffle is needed before the tables come out.

Which ancestors repeat is found from the data (``repeated_paths``, ``flatten_repeated``); a ``NestSpec``
names levels that stand at different places in different records (``flatten_nested``). No field is
dropped: what a level does not declare is kept in ``more``, what stands outside the levels in the
table ``envelope``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from json.decoder import scanstring
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANK = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"(?:(-?(?:0|[1-9]\d*))(\.\d+)?([eE][+-]?\d+)?|true|false|null|NaN|-?Infinity)(?![\w.+-])")
_WORDS = {"true": True, "false": False, "null": None}


class _Container:
    """Stands as the value of an object or a list."""

    def __init__(self, name: str):
        self.name = name

    def __repr__(self) -> str:
        return self.name


OBJECT, LIST, CLOSE = _Container("OBJECT"), _Container("LIST"), _Container("CLOSE")
#: Positions within the repeated ancestors, the innermost first: (positions of the ancestors, position).
Ordinals = tuple | None


class Path:
    """A chain of field names, known by its last link; the members of a list are a link without a name."""

    __slots__ = ("parent", "name", "links", "_text")

    def __init__(self, parent: Path | None = None, name: str | None = ""):
        self.parent, self.name, self.links, self._text = parent, name, {}, None

    def link(self, name: str | None) -> Path:
        found = self.links.get(name)
        if found is None:
            found = self.links[name] = Path(self, name)
        return found

    def below(self, top: Path | None) -> str:
        """The chain from ``top`` (the root, if None) on as text, with ``[]`` for members."""
        parts: list[str] = []
        at: Path | None = self
        while at is not None and at is not top and at.parent is not None:
            parts.append("[]" if at.name is None else f".{at.name}")
            at = at.parent
        return "".join(reversed(parts)).removeprefix(".")

    @property
    def text(self) -> str:
        if self._text is None:
            self._text = self.below(None)
        return self._text


def positions_of(ordinals: Ordinals) -> tuple[int, ...]:
    out: list[int] = []
    while ordinals is not None:
        ordinals, i = ordinals
        out.append(i)
    return tuple(reversed(out))


Triple = tuple[Path, Ordinals, Any]


@dataclass(frozen=True)
class Level:
    """One repeated ancestor. The first level is found by ``marker`` (an object that has this field,
    wherever it stands), the others by the field of their parent that holds them. A level whose
    members are plain values keeps them in the column ``value``."""

    name: str
    field_name: str = ""
    marker: str = ""
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class NestSpec:
    """Levels from the outermost to the innermost; every level's position column is ``<name>_pos``."""

    levels: tuple[Level, ...] = field(default_factory=tuple)


_FLAGS = ("medical_concept", "negation_sensitive", "severity_sensitive", "temporality_sensitive", "outcome_sensitive", "polarity_sensitive", "protected")
#: Masks, the candidates of a mask, the rejection reasons of a candidate.
MASK_NEST = NestSpec(
    (
        Level("mask", marker="mask_type", columns=("mask_type", "original_value", "start_char", "end_char", "source", "constraint_rule", "pos", "lemma", "entity_type", "mask_index", "mask_token", *_FLAGS, "date_kind", "replacement_policy", "classification.pos", *(f"classification.flags.{f}" for f in _FLAGS))),
        Level("candidate", field_name="candidates", columns=("token", "normalized_token", "score", "accepted")),
        Level("reason", field_name="rejection_reasons"),
    )
)


class Incomplete(ValueError):
    """The text is no complete record."""


def stream(text: str, root: Path | None = None) -> Iterator[Triple]:
    """(path, ordinals, value) of every field of a record in order of appearance; Incomplete as soon as the text can't be one.

    An object or a list gives its own triple with the value OBJECT or LIST before what it holds, and one
    with CLOSE after it. A repeated field of one object is given as often as it stands there. Nothing is
    kept but the open containers, whose depth is bounded by memory only.
    """
    blank, atom, end = _BLANK.match, _ATOM.match, len(text)
    # Open containers: (is a list, path, ordinals, path of members) with members counted in place.
    open_: list[list] = []
    path, ordinals = root or Path(), None
    at = blank(text, 0).end()
    want_key = may_end = False
    while True:
        c = text[at : at + 1]
        if want_key:
            if c == '"':
                try:
                    name, at = scanstring(text, at + 1, True)
                except ValueError as bad:
                    raise Incomplete from bad
                if text[at : at + 1] != ":":
                    at = blank(text, at).end()
                    if text[at : at + 1] != ":":
                        raise Incomplete
                at += 1
                if text[at : at + 1] in " \t\n\r":
                    at = blank(text, at).end()
                top = open_[-1]
                path, ordinals = top[1].link(name), top[2]
                want_key = may_end = False
                continue
            if c != "}" or not may_end:
                raise Incomplete
        elif c != "]" or not may_end:
            if open_ and open_[-1][0]:
                top = open_[-1]
                top[3] += 1
                path, ordinals = top[1], (top[2], top[3])
            if c == "{":
                yield path, ordinals, OBJECT
                open_.append([False, path, ordinals])
                at, want_key, may_end = blank(text, at + 1).end(), True, True
                continue
            if c == "[":
                yield path, ordinals, LIST
                open_.append([True, path.link(None), ordinals, 0, path])
                at, may_end = blank(text, at + 1).end(), True
                continue
            if c == '"':
                try:
                    value, at = scanstring(text, at + 1, True)
                except ValueError as bad:
                    raise Incomplete from bad
            else:
                m = atom(text, at)
                if m is None:
                    raise Incomplete
                word = m[0]
                value = _WORDS[word] if word in _WORDS else word if len(word) > 4000 else int(word) if m[1] and not m[2] and not m[3] else float(word.replace("Infinity", "inf"))
                at = m.end()
            yield path, ordinals, value
            c = ""
        # A value has ended: close containers as far as they end here, then a comma or the end follows.
        while True:
            if c:
                top = open_.pop()
                yield top[4] if top[0] else top[1], top[2], CLOSE
                at += 1
            c = text[at : at + 1]
            if c in " \t\n\r":
                at = blank(text, at).end()
                c = text[at : at + 1]
            if not open_:
                if at != end:
                    raise Incomplete
                return
            is_list = open_[-1][0]
            if c == ",":
                at = blank(text, at + 1).end()
                want_key, may_end = not is_list, False
                break
            if c != ("]" if is_list else "}"):
                raise Incomplete


def record_triples(text: str | None, root: Path | None = None) -> list[Triple] | None:
    """All triples of one record, or None for null, blank and incomplete ones. A string that holds a record again is opened, however often."""
    while text is not None:
        try:
            found = list(stream(text.removeprefix("﻿"), root))
        except Incomplete:
            return None
        value = found[0][2]
        if not isinstance(value, str):
            return found
        text = value
    return None


@dataclass(slots=True)
class Member:
    """A member of a level: its depth, where it stands, its positions within the levels, its fields."""

    depth: int
    path: Path
    ordinals: Ordinals
    position: tuple[int, ...]
    fields: dict[str, Any]


def members(text: str | None, spec: NestSpec = MASK_NEST, columns: bool = True, root: Path | None = None) -> Iterator[Member]:
    """The members of all levels of one record in the order in which they end, each with its fields (if ``columns``) by path within the member.

    What stands outside all levels comes as members of depth -1, one per repeated ancestor that holds it.
    """
    found = record_triples(text, root)
    if found is None:
        return
    marker = spec.levels[0].marker
    marked: set[int] = set()
    opened: list[int] = []
    for i, (path, _, value) in enumerate(found):
        if value is CLOSE:
            opened.pop()
            continue
        if path.name == marker and opened and found[opened[-1]][2] is OBJECT:
            marked.add(opened[-1])
        if value is OBJECT or value is LIST:
            opened.append(i)
    fields_below = [x.field_name for x in spec.levels[1:]] + [""]
    active: list[tuple[Member, int]] = []
    outside: dict[tuple[Path, int], Member] = {}
    count = depth = 0
    for i, (path, ordinals, value) in enumerate(found):
        if value is CLOSE:
            depth -= 1
            if active and active[-1][1] == depth:
                yield active.pop()[0]
            continue
        container = value is OBJECT or value is LIST
        here, depth = depth, depth + container
        if i in marked:
            count += 1
            active.append((Member(0, path, ordinals, (count,), {}), here))
            continue
        if not active:
            if columns and not container:
                top = path
                while top.name is not None and top.parent is not None:
                    top = top.parent
                outside.setdefault((top, id(ordinals)), Member(-1, top, ordinals, (), {})).fields[path.below(top) or "value"] = value
            continue
        m = active[-1][0]
        below = fields_below[m.depth]
        if below:
            single = path.parent is m.path and path.name == below
            if single and (value is LIST or value is None):
                continue
            if single or (path.name is None and path.parent.parent is m.path and path.parent.name == below):
                child = Member(m.depth + 1, path, ordinals, (*m.position, 1 if single else ordinals[1]), {})
                if container:
                    active.append((child, here))
                else:
                    child.fields["value"] = value
                    yield child
                continue
        if columns and not container:
            name = path.name if path.parent is m.path and path.name is not None else path.below(m.path)
            if "[]" in name:
                m.fields.setdefault(name, []).append(value)
            else:
                m.fields[name] = value
    yield from outside.values()


def _text(value: Any) -> str | None:
    return value if isinstance(value, str) or value is None else json.dumps(value, ensure_ascii=False)


def _names(spec: NestSpec, depth: int) -> tuple[list[str], list[str]]:
    """Position columns and declared columns of a level; a dot becomes an underscore, and a column named like the position gets one at its end."""
    level = spec.levels[depth]
    positions = [f"{x.name}_pos" for x in spec.levels[: depth + 1]]
    return positions, [f"{c}_" if c in positions else c for c in (x.replace(".", "_") for x in (*level.columns, "value"))]


_PLACED = [T.StructField("path", T.StringType()), T.StructField("ordinals", T.ArrayType(T.IntegerType())), T.StructField("more", T.MapType(T.StringType(), T.StringType()))]


def _level_table(base: DataFrame, key: Sequence[str], spec: NestSpec, depth: int) -> DataFrame:
    level = spec.levels[depth] if depth >= 0 else Level("envelope")
    positions, columns = _names(spec, depth) if depth >= 0 else ([], [])
    declared = (*level.columns, "value") if depth >= 0 else ()
    names = [*positions, *columns, "path", "ordinals", "more"]
    kind = T.ArrayType(T.StructType([*(T.StructField(p, T.IntegerType()) for p in positions), *(T.StructField(c, T.StringType()) for c in columns), *_PLACED]))

    def row(m: Member) -> dict:
        own = m.fields
        known = [_text(own[c]) if c in own else None for c in declared]
        rest = {k: _text(v) for k, v in own.items() if k not in declared}
        return dict(zip(names, (*m.position, *known, m.path.text, list(positions_of(m.ordinals)), rest)))

    @F.pandas_udf(kind)
    def shred(texts: pd.Series) -> pd.Series:
        root = Path()
        return pd.Series([[row(m) for m in members(t if isinstance(t, str) else None, spec, True, root) if m.depth == depth] for t in texts], dtype=object)

    flat = base.select(*[f"k{i}" for i in range(len(key))], F.explode(shred("record")).alias("r"))
    return flat.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(key)], *[F.col(f"r.`{n}`").alias(n if n not in key else f"{n}_") for n in names])


def _records(df: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    return df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(key)], F.col(f"`{column}`").cast("string").alias("record")).filter(F.col("record").isNotNull())


def flatten_nested(df: DataFrame, key: Sequence[str], column: str, spec: NestSpec = MASK_NEST) -> dict[str, DataFrame]:
    """One flat table per level and one, ``envelope``, of what stands outside them.

    A table holds the key columns, the positions within the level and its ancestors, the declared fields
    as text, ``path`` and ``ordinals`` (where the member stands, the link to the rows of ``envelope``,
    whose ordinals are a prefix), and ``more``: all other fields by their path. Null, empty, blank and
    cut-off records have no rows; a single value in place of a list is a list of one; null in place of
    a list is none. Repeated rows of ``df`` stay repeated. Other columns are not read. Each table reads
    a record once and pivots its own level only.
    """
    base = _records(df, key, column)
    out = {level.name: _level_table(base, key, spec, d) for d, level in enumerate(spec.levels)}
    out["envelope"] = _level_table(base, key, spec, -1)
    return out


def nested_keys(df: DataFrame, key: str, column: str, spec: NestSpec = MASK_NEST) -> DataFrame:
    """Distinct rows (``key``, one position per level) of all members of all levels; positions below a member are 0.

    The same members as in ``flatten_nested``, without their fields. Rows are made distinct within each
    map task before the one exchange, which is on all columns.
    """
    width = len(spec.levels)
    kind = T.ArrayType(T.StructType([T.StructField(f"{x.name}_pos", T.IntegerType()) for x in spec.levels]))
    names = [f"{x.name}_pos" for x in spec.levels]

    @F.pandas_udf(kind)
    def shred(texts: pd.Series) -> pd.Series:
        root = Path()
        return pd.Series([[dict(zip(names, (*m.position, *(0,) * (width - len(m.position))))) for m in members(t if isinstance(t, str) else None, spec, False, root)] for t in texts], dtype=object)

    base = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{column}`").cast("string").alias("record")).filter(F.col("record").isNotNull())
    flat = base.select("k", F.explode(shred("record")).alias("r")).select("k", *[f"r.{n}" for n in names]).dropDuplicates()
    return flat.withColumnRenamed("k", key)


def _grouped(df: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """(k0.., ancestor, ordinals, fields): the fields of every record by their nearest repeated ancestor, '' for the record itself."""
    kind = T.ArrayType(T.StructType([T.StructField("ancestor", T.StringType()), T.StructField("ordinals", T.ArrayType(T.IntegerType())), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))]))

    def groups(text: str | None, root: Path) -> list[dict]:
        # Fields of one member share the tuple that tells its positions; the triples keep it alive.
        rows: dict[tuple[Path, int], tuple[Ordinals, dict[str, str | None]]] = {}
        found = record_triples(text, root) or ()
        for path, ordinals, value in found:
            top = path
            while top.name is not None and top.parent is not None:
                top = top.parent
            own = rows.setdefault((top, id(ordinals)), (ordinals, {}))[1]
            if not isinstance(value, _Container):
                own[path.below(top) or "value"] = _text(value)
        return [{"ancestor": a.text, "ordinals": list(positions_of(o)), "fields": f} for (a, _), (o, f) in rows.items()]

    @F.pandas_udf(kind)
    def shred(texts: pd.Series) -> pd.Series:
        root = Path()
        return pd.Series([groups(t if isinstance(t, str) else None, root) for t in texts], dtype=object)

    base = _records(df, key, column)
    return base.select(*[f"k{i}" for i in range(len(key))], F.explode(shred("record")).alias("g")).select(*[f"k{i}" for i in range(len(key))], "g.*")


def repeated_paths(df: DataFrame, column: str) -> DataFrame:
    """(ancestor, field, members): every repeated ancestor of the data and its fields with the number of members that have them; '' is the record itself."""
    fields = _grouped(df, [], column).select("ancestor", F.explode_outer(F.map_keys("fields")).alias("field"))
    return fields.groupBy("ancestor", "field").agg(F.count(F.lit(1)).alias("members"))


def flatten_repeated(df: DataFrame, key: Sequence[str], column: str) -> dict[str, DataFrame]:
    """One table per repeated ancestor found in the data: key columns, ``ordinals`` (a parent's are a prefix) and every field of the ancestor as a column of text.

    The ancestors and fields come from one pass over the data; as many as the data's layouts have.
    """
    known: dict[str, list[str]] = {}
    for r in repeated_paths(df, column).collect():
        known.setdefault(r["ancestor"], []).extend([r["field"]] if r["field"] is not None else [])
    groups = _grouped(df, key, column)
    keys = [F.col(f"k{i}").alias(k) for i, k in enumerate(key)]
    taken = {*key, "ordinals"}
    return {a: groups.filter(F.col("ancestor") == a).select(*keys, "ordinals", *[F.try_element_at("fields", F.lit(f)).alias(f"{f}_" if f in taken else f) for f in sorted(fields)]) for a, fields in sorted(known.items())}
