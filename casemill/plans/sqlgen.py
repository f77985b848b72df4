"""Pieces of DuckDB SQL that say the same as the native expressions, for side-by-side checks."""

from __future__ import annotations

from collections.abc import Sequence

from casemill.functions import lexicons as L
from casemill.operators.annotate import words_pattern

SPAN_TYPE = "STRUCT(start_char INTEGER, end_char INTEGER, original_value VARCHAR, mask_type VARCHAR, source VARCHAR)"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(words: Sequence[str]) -> str:
    return "(" + ", ".join(map(text, words)) + ")"


def spans(column: str, pattern: str, mask_type: str, source: str) -> str:
    """A list of spans for all matches of a pattern, case ignored."""
    hits = f"regexp_extract_all({column}, {text(pattern)}, 0, 'i')"
    gaps = f"string_split_regex({column}, {text(pattern)}, 'i')"
    size = "coalesce(list_sum(list_transform({}, lambda w: length(w))), 0)"
    start = f"({size.format(f'{gaps}[1:i]')} + {size.format(f'{hits}[1:i-1]')})::INTEGER"
    return (
        f"list_transform(range(1, len({hits}) + 1), lambda i: {{'start_char': {start}, 'end_char': ({start} + length({hits}[i]))::INTEGER, "
        f"'original_value': {hits}[i], 'mask_type': {text(mask_type)}, 'source': {text(source)}}}::{SPAN_TYPE})"
    )


def resolved(candidates: str) -> str:
    """Spans kept in order of priority, sorted by start."""
    return (
        f"list_sort(list_reduce({candidates}, lambda acc, c: CASE WHEN c.start_char < c.end_char AND len(list_filter(acc, lambda a: c.start_char < a.end_char AND c.end_char > a.start_char)) = 0 "
        f"THEN list_append(acc, c) ELSE acc END, CAST([] AS {SPAN_TYPE}[])))"
    )


def spliced(column: str, chosen: str) -> str:
    """The text with each span replaced by the mask token."""
    return (
        f"list_reduce({chosen}, lambda acc, s: {{'at': s.end_char, 'o': acc.o || substring({column}, acc.at + 1, s.start_char - acc.at) || '[MASK]'}}, {{'at': 0::INTEGER, 'o': ''}})"
    )


def draw(n: str, *key: str, seed: int = 42) -> str:
    """The md5 draw in [0, n)."""
    joined = " || '|' || ".join([text(str(seed)), *[f"({k})::VARCHAR" for k in key]])
    return f"(('0x' || substr(md5({joined}), 1, 8))::BIGINT % ({n}))"


def pick(pool: Sequence[str], *key: str) -> str:
    return f"[{', '.join(map(text, pool))}][{draw(str(len(pool)), *key)} + 1]"


def first_number(value: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({value}, '(\\d{{1,3}})', 1), '') AS INTEGER)"


def age_category(age: str) -> str:
    return f"CASE WHEN {age} < 18 THEN 'pediatric' WHEN {age} < 65 THEN 'adult' ELSE 'older_adult' END"


def constraint(kind: str, value: str) -> str:
    age = first_number(value)
    a, b = L.AGE_CONSTRAINT.split("{}")
    rest = " ".join(f"WHEN {kind} = {text(k)} THEN {text(v)}" for k, v in L.CONSTRAINTS.items())
    return f"CASE WHEN {kind} = 'AGE' THEN CASE WHEN {age} IS NULL THEN {text(L.AGE_CONSTRAINT_UNKNOWN)} ELSE {text(a)} || {age_category(age)} || {text(b)} END {rest} ELSE {text(L.CONSTRAINT_DEFAULT)} END"


def replaced_age(value: str, *key: str) -> str:
    age = first_number(value)
    low = f"CASE WHEN {age} < 18 THEN greatest(0, {age} - 2) WHEN {age} < 65 THEN greatest(18, {age} - 5) ELSE greatest(65, {age} - 4) END"
    high = f"CASE WHEN {age} < 18 THEN least(17, {age} + 2) WHEN {age} < 65 THEN least(64, {age} + 5) ELSE least(110, {age} + 4) END"
    choices = f"(({high}) - ({low}) + CASE WHEN {age} BETWEEN ({low}) AND ({high}) THEN 0 ELSE 1 END)"
    at = f"(({low}) + {draw(choices, *key, text('age'))})"
    new = f"CASE WHEN {age} BETWEEN ({low}) AND ({high}) AND {at} >= {age} THEN {at} + 1 ELSE {at} END"
    return f"CASE WHEN {age} IS NOT NULL AND {choices} > 0 THEN regexp_replace({value}, '^(\\D*)\\d{{1,3}}', '\\1' || ({new})::VARCHAR) ELSE {value} END"


def replaced_id(value: str, *key: str) -> str:
    pattern = "(?i)^(.*?)([A-Z0-9-]{3,})$"
    return f"CASE WHEN regexp_matches(trim({value}), '{pattern}') THEN regexp_extract(trim({value}), '{pattern}', 1) ELSE 'ID ' END || 'X' || ({draw('900000', *key, text('id'))} + 100000)::VARCHAR"


def replaced_sex(value: str) -> str:
    pairs = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in L.SEX_PAIRS.items())
    new = f"CASE lower({value}) {pairs} ELSE {value} END"
    return f"CASE WHEN regexp_matches({value}, '^[A-Z]') THEN upper(substring({new}, 1, 1)) || lower(substring({new}, 2)) ELSE {new} END"


def fictitious(kind: str, *key: str) -> str:
    name = f"{pick(L.FIRST_NAMES, *key, text('first'))} || ' ' || {pick(L.LAST_NAMES, *key, text('last'))}"
    return f"CASE {kind} WHEN 'NAME' THEN {name} WHEN 'LOCATION' THEN {pick(L.LOCATIONS, *key, text('place'))} WHEN 'ORGANIZATION' THEN {pick(L.ORGANIZATIONS, *key, text('institution'))} END"


def date_offset(key: str, variant: str, low: int = 30, high: int = 365) -> str:
    days = f"({draw(str(high - low + 1), key, variant, '0', text('date_offset'))} + {low})"
    return f"(CASE WHEN {variant} % 2 = 1 THEN {days} ELSE -{days} END)::INTEGER"


# Styles: pattern of the cleaned value, how it is read, how it is written.
_STYLES = (
    ("^\\d{4}-\\d{1,2}-\\d{1,2}$", "%Y-%m-%d", "%Y-%m-%d"), ("^\\d{4}/\\d{1,2}/\\d{1,2}$", "%Y/%m/%d", "%Y/%m/%d"), ("^\\d{1,2}/\\d{1,2}/\\d{4}$", "%m/%d/%Y", "%m/%d/%Y"),
    ("^\\d{1,2}/\\d{1,2}/\\d{2}$", "%m/%d/%y", "%m/%d/%y"), ("^[a-z]{3,9} \\d{1,2}, \\d{4}$", "%B %d, %Y", "%B %d, %Y"), ("^[a-z]{3} \\d{1,2}, \\d{4}$", "%b %d, %Y", "%b %d, %Y"),
    ("^[a-z]{3,9} \\d{1,2} \\d{4}$", "%B %d %Y", "%B %d %Y"), ("^[a-z]{3} \\d{1,2} \\d{4}$", "%b %d %Y", "%b %d %Y"),
)


def _cleaned(value: str) -> str:
    return f"regexp_replace(regexp_replace(trim({value}), '(?i)\\s+(?:st|nd|rd|th)\\b', '', 'g'), '\\s+', ' ', 'g')"


def shifted_date(value: str, days: str) -> str:
    """The absolute date moved in its style; null where the value is none."""
    clean = _cleaned(value)
    branches = [f"CASE WHEN regexp_matches(lower({clean}), '{p}') THEN strftime(try_strptime({clean}, '{r}') + to_days(({days})::INTEGER), '{w}') END" for p, r, w in _STYLES]
    return f"coalesce({', '.join(branches)})"


def date_kind(value: str) -> str:
    tests = ((L.MONTH_DAY_PATTERN, "month_day"), (L.WEEK_RANGE_PATTERN, "week_range"), (L.GESTATIONAL_PATTERN, "gestational_age"), (L.DURATION_PATTERN, "duration"))
    rest = " ".join(f"WHEN regexp_matches(trim({value}), {text('(?i)' + p)}) THEN {text(k)}" for p, k in tests)
    return f"CASE WHEN {shifted_date(value, '0')} IS NOT NULL THEN 'absolute_date' {rest} ELSE 'unparsed' END"


def bounded(days: str, limit: int) -> str:
    return f"(CASE WHEN {days} >= 0 THEN abs({days}) % {limit} + 1 ELSE -(abs({days}) % {limit} + 1) END)"


def shifted_any(value: str, days: str) -> str:
    part = lambda p, g: f"regexp_extract(trim({value}), {text('(?i)' + p)}, {g})"
    whole = lambda p, g: f"TRY_CAST(nullif({part(p, g)}, '') AS INTEGER)"
    month = f"{part(L.MONTH_DAY_PATTERN, 1)} || ' ' || {part(L.MONTH_DAY_PATTERN, 2)} || ' 2000'"
    moved = f"(coalesce(try_strptime({month}, '%B %d %Y'), try_strptime({month}, '%b %d %Y')) + to_days(({days})::INTEGER))"
    start, end = whole(L.WEEK_RANGE_PATTERN, 1), whole(L.WEEK_RANGE_PATTERN, 2)
    first = f"greatest(1, {start} + {bounded(days, 2)})"
    branches = {
        "absolute_date": shifted_date(value, days),
        "month_day": f"coalesce(strftime({moved}, '%B ') || day({moved})::VARCHAR, {value})",
        "week_range": f"({first})::VARCHAR || '-' || ({first} + greatest(0, {end} - {start}))::VARCHAR || ' weeks'",
        "gestational_age": f"{part(L.GESTATIONAL_PATTERN, 1)} || greatest(1, least(42, {whole(L.GESTATIONAL_PATTERN, 2)} + {bounded(days, 2)}))::VARCHAR || {part(L.GESTATIONAL_PATTERN, 3)}",
        "duration": f"greatest(1, {whole(L.DURATION_PATTERN, 1)} + {bounded(days, 2)})::VARCHAR || {part(L.DURATION_PATTERN, 2)} || {part(L.DURATION_PATTERN, 3)}",
    }
    return f"CASE {date_kind(value)} " + " ".join(f"WHEN {text(k)} THEN {v}" for k, v in branches.items()) + f" ELSE {value} END"


def count_of(column: str, part: str) -> str:
    return f"coalesce((length({column}) - length(replace({column}, {text(part)}, ''))) / {len(part)}, 0)::BIGINT"


def sex_pattern() -> str:
    return words_pattern(L.SEX_TERMS)


def medical_word(word: str) -> str:
    suffixes = "|".join(L.MEDICAL_SUFFIXES)
    return f"(lower({word}) IN {values(L.MEDICAL_TERMS)} OR regexp_matches(lower({word}), '(?:{suffixes})$') OR regexp_full_match({word}, {text('(?i)' + L.MEDICAL_PATTERN)}))"


def rejection_reasons(word: str, original: str, pos: str) -> str:
    return (
        f"list_filter([CASE WHEN NOT regexp_matches({word}, {text(L.SAFE_TOKEN_PATTERN)}) THEN 'not_a_complete_alphabetic_token' END, "
        f"CASE WHEN lower({word}) IN {values(L.SENSITIVE_TERMS)} AND lower({word}) <> lower({original}) THEN 'candidate_is_medical_or_semantically_sensitive' END, "
        f"CASE WHEN {pos} = 'ADV' AND lower({word}) <> lower({original}) AND NOT suffix(lower({word}), 'ly') THEN 'pos_mismatch_expected_adverb' END, "
        f"CASE WHEN regexp_matches({original}, '^[A-Z]') <> regexp_matches({word}, '^[A-Z]') THEN 'capitalization_mismatch' END], lambda x: x IS NOT NULL)"
    )
