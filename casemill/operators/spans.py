"""Spans in text as arrays of structs: found by patterns, resolved by priority, spliced.

Offsets count code points and are half-open. Everything stays within the row, so there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemill.functions import lexicons as L
from casemill.functions.binding import bind

SPAN = "struct<start_char:int,end_char:int,original_value:string,mask_type:string,source:string>"
SPANS = f"array<{SPAN}>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


#: Characters that no text may hold, put around matches while they are read off; fixed values.
_OPEN, _SHUT = "\ufdd0", "\ufdd1"


def regex_spans(text: Column, pattern: str, mask_type: str, source: str) -> Column:
    """All matches of ``pattern`` (case ignored, Unicode classes) from left to right; null for null text.

    One scan puts marks around the matches; offsets come from the lengths of what lies between the marks.
    Texts of ASCII alone are scanned without Unicode classes, which finds the same and is faster. Texts
    that hold the marks themselves are scanned twice instead, for the matches and for what lies between.
    """

    def placed(starts: Column, hits: Column) -> Column:
        """The spans of ``hits``, of which each begins at its place of ``starts``."""

        def span(hit: Column, i: Column) -> Column:
            a = F.get(starts, i)
            return F.struct(a.alias("start_char"), (a + F.length(hit)).alias("end_char"), hit.alias("original_value"), F.lit(mask_type).alias("mask_type"), F.lit(source).alias("source"))

        return F.transform(hits, span)

    def begins(first: Column, steps: Column) -> Column:
        """``first`` and the sums of it and what of ``steps`` comes before. Only numbers are carried along, as every step copies what it carries."""
        return F.aggregate(steps, F.array(first), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def marked(java: str) -> Column:
        parts = F.split(F.regexp_replace(text, java, f"{_OPEN}$0{_SHUT}"), _OPEN, -1)

        def read(found: Column) -> Column:
            starts = begins(F.length(F.get(found, F.lit(0))), F.transform(F.slice(found, 2, F.size(found)), lambda part: F.length(part) - 1))
            hits = F.transform(F.slice(found, 2, F.size(found)), lambda part: F.substring_index(part, _SHUT, 1))
            return F.when(F.size(found) > 1, bind(starts, lambda at: placed(at, hits))).when(text.isNotNull(), no_spans())

        return bind(parts, read)

    def twice(java: str) -> Column:
        def found(hits: Column) -> Column:
            def read(gaps: Column) -> Column:
                steps = F.transform(hits, lambda hit, i: F.length(hit) + F.length(F.get(gaps, i + 1)))
                return bind(begins(F.length(F.get(gaps, F.lit(0))), steps), lambda at: placed(at, hits))

            return F.when(F.size(hits) > 0, bind(F.split(text, java, -1), read)).when(hits.isNotNull(), no_spans())

        return bind(F.regexp_extract_all(text, F.lit(java), F.lit(0)), found)

    plain, full = f"(?i){pattern}", f"(?iuU){pattern}"
    return F.when(~text.rlike(r"[^\x00-\x7F]"), marked(plain)).when(text.contains(_OPEN) | text.contains(_SHUT), twice(full)).otherwise(marked(full))


def overlaps(a: Column, b: Column) -> Column:
    """Whether two half-open spans share a place."""
    return (a["start_char"] < b["end_char"]) & (a["end_char"] > b["start_char"])


def overlaps_any(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: overlaps(span, o))


def resolve(candidates: Column) -> Column:
    """Spans kept in order of priority: each is kept unless empty or overlapping one that was kept before.

    A dropped span drops no other. The result is sorted by start.
    """
    def chosen(all_: Column) -> Column:
        def clear(kept: Column, c: Column) -> Column:
            return (c["start_char"] < c["end_char"]) & ~F.exists(kept, lambda j: overlaps(c, F.get(all_, j)))

        # Places are carried along instead of spans, as every step copies what it carries.
        none = F.array().cast("array<int>")
        kept = F.aggregate(F.sequence(F.lit(0), F.size(all_) - 1), none, lambda acc, i: bind(F.get(all_, i), lambda c: F.when(clear(acc, c), F.concat(acc, F.array(i))).otherwise(acc)))
        return F.when(F.size(all_) > 0, F.transform(kept, lambda j: F.get(all_, j))).when(all_.isNotNull(), no_spans())

    return F.array_sort(bind(candidates, chosen))


def splice(text: Column, spans: Column, token: str = L.MASK) -> Column:
    """The text with each of the sorted, disjoint spans replaced by ``token``."""
    ends = lambda i: F.when(i > 0, F.get(spans, i - 1)["end_char"]).otherwise(0)
    pieces = F.transform(spans, lambda s, i: F.concat(F.substring(text, ends(i) + 1, s["start_char"] - ends(i)), F.lit(token)))
    return F.concat(F.array_join(pieces, ""), F.substring(text, ends(F.size(spans)) + 1, F.length(text)))


def joined(spans: Column, field: str) -> Column:
    """One field of all spans joined by ``; ``."""
    return F.array_join(F.transform(spans, lambda s: s[field]), "; ")


def count_of(text: Column, part: str) -> Column:
    """How often ``part`` stands in the text without overlap; 0 for null and empty text."""
    return F.coalesce(F.size(F.split(text, F.lit("\\Q" + part + "\\E"), -1)) - 1, F.lit(0)).cast("long")


#: Tokens: words with inner hyphens, apostrophes and marks of numbers, and every other character that is no blank.
TOKEN = r"[\w#]+(?:[-'’.][\w#]+)*|[^\s\w]"


def token_span(tokens: Column, span: Column) -> Column:
    """``struct<start_char, end_char>`` of the smallest run of tokens that covers a span; null where no token touches it."""
    touched = F.filter(tokens, lambda t: overlaps(t, span))
    edges = lambda ts: F.struct(F.get(ts, F.lit(0))["start_char"].alias("start_char"), F.get(ts, F.size(ts) - 1)["end_char"].alias("end_char"))
    return bind(touched, lambda ts: F.when(F.size(ts) > 0, edges(ts)))


def labels_over(span: Column, entities: Column) -> Column:
    """The labels of the entities that touch a span, each once, sorted and joined by commas; empty where none does."""
    labels = F.transform(F.filter(entities, lambda e: overlaps(e, span)), lambda e: F.substring_index(e["source"], ":", -1))
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")
