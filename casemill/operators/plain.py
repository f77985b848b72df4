"""Masking and filling of plain texts in one pass over Arrow batches, with the results of ``mask`` and ``fill``.

Expressions over arrays are interpreted in Spark, which costs milliseconds a case. Here the patterns run over whole
columns (RE2), spans are resolved as columns of numbers, and masks are filled in Python without metadata as JSON text in
between. Texts are plain where RE2, Python and Java read the patterns alike: printable ASCII without a mask token, years
not at the ends of what Python's dates hold. All others take the expressions, so nothing is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions import lexicons as L
from casemill.functions.hashing import md5_words
from casemill.operators import annotate
from casemill.operators.fill import FillingConfig
from casemill.operators.mask import MaskingConfig

#: Longer texts take the expressions, so that a batch has a bound; texts that are handled at once.
LONGEST, AT_ONCE = 4000, 5000
_FAR = 2 * LONGEST
_NO_CANDIDATE = "no_candidate_satisfied_constraints"
_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_FULL, _SHORT = ({m.lower()[:n]: i for i, m in enumerate(_MONTHS, 1)} for n in (9, 3))
#: What may make a span medical, as a first look at all values; decided by ``_medical_span``.
_MAYBE_MEDICAL = "(?i)" + "|".join([*L.MEDICAL_TERMS, *L.MEDICAL_SUFFIXES, "pcr", "ig[agm]", "e6"])
_PATTERN, _SUFFIX = re.compile(L.MEDICAL_PATTERN, re.I | re.A), re.compile("(?:" + "|".join(L.MEDICAL_SUFFIXES) + ")$")


def is_plain(text: Column, key: Column) -> Column:
    """Whether this module may handle a text; never null."""
    # The look behind comes last, as it is dear at every place of a text.
    odd_year = text.rlike(r"[09](?:00[01]|99[89])(?!\d)(?<!\d.{4})")
    return F.coalesce(key.isNotNull() & (F.length(text) <= LONGEST) & text.rlike(r"^[\x20-\x7E]+\z") & ~text.contains(L.MASK) & ~odd_year, F.lit(False))


def _medical_span(value: str) -> bool:
    words = re.findall(r"[a-z]+(?:-[a-z]+)*", value.lower())
    return bool(_PATTERN.search(value)) or any(w in L.MEDICAL_TERMS or _SUFFIX.search(w) for w in words)


def _protected(word: str) -> bool:
    """Whether a neutral word carries any safety flag."""
    low = word.lower()
    if re.search(r"[\s\-/,]", word):
        return _medical_span(word)
    return low in L.MEDICAL_TERMS or bool(_SUFFIX.search(low)) or bool(_PATTERN.fullmatch(word)) or any(low in s for s in (L.NEGATION_TERMS, L.SEVERITY_TERMS, L.TEMPORALITY_TERMS, L.OUTCOME_TERMS, L.POLARITY_TERMS))


def _upper(word: str) -> bool:
    return "A" <= word[:1] <= "Z"


def rejection_reasons(token: str, original: str, pos: str, protected: bool) -> list[str]:
    """Why a candidate may not stand in for ``original``, in the order of ``safety.rejection_reasons``."""
    low, old = token.lower(), original.lower()
    checks = (
        (not re.fullmatch(L.SAFE_TOKEN_PATTERN, token), "not_a_complete_alphabetic_token"),
        (low in L.SENSITIVE_TERMS and low != old, "candidate_is_medical_or_semantically_sensitive"),
        (protected, "source_mask_is_protected"),
        (pos == "ADV" and low != old and not low.endswith("ly"), "pos_mismatch_expected_adverb"),
        (_upper(original) != _upper(token), "capitalization_mismatch"),
    )
    return [name for test, name in checks if test]


@lru_cache(1 << 16)
def parsed(value: str) -> tuple[str, int] | None:
    """(style, ordinal of the day) of an absolute date, as ``dates.parsed`` reads it; none where no style fits."""
    text = re.sub(" +", " ", re.sub(r"(?i) +(?:st|nd|rd|th)\b", "", value.strip(" "))).lower()

    def day(year: str | int, month: str | int | None, of: str) -> int | None:
        try:
            return date(int(year), int(month or 0), int(of)).toordinal()
        except ValueError:
            return None

    tried: list[tuple[str, int | None]] = []
    if m := re.fullmatch(r"(\d{4})([-/])(\d{1,2})\2(\d{1,2})", text):
        tried.append(("ymd_dash" if m[2] == "-" else "ymd_slash", day(m[1], m[3], m[4])))
    elif m := re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{4})", text):
        tried.append(("mdy_slash4", day(m[3], m[1], m[2])))
    elif m := re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{2})", text):
        if day(2000 + int(m[3]), m[1], m[2]):
            tried.append(("mdy_slash2", day((1900 if int(m[3]) >= 69 else 2000) + int(m[3]), m[1], m[2])))
    elif m := re.fullmatch(r"([a-z]{3,9}) (\d{1,2})(,?) (\d{4})", text):
        end = "" if m[3] else "_no_comma"
        tried += [("month_name" + end, day(m[4], _FULL.get(m[1]), m[2])), ("month_abbr" + end, day(m[4], _SHORT.get(m[1]), m[2]))]
    return next(((style, at) for style, at in tried if at), None)


@lru_cache(1 << 16)
def written(style: str, ordinal: int) -> str:
    """A day in the style that it was read in."""
    d = date.fromordinal(ordinal)
    y, m, of = f"{d.year:04d}", f"{d.month:02d}", f"{d.day:02d}"
    month = _MONTHS[d.month - 1] if style.startswith("month_name") else _MONTHS[d.month - 1][:3]
    forms = {"ymd_dash": f"{y}-{m}-{of}", "ymd_slash": f"{y}/{m}/{of}", "mdy_slash4": f"{m}/{of}/{y}", "mdy_slash2": f"{m}/{of}/{y[2:]}"}
    return forms.get(style) or f"{month} {of}{'' if style.endswith('no_comma') else ','} {y}"


@lru_cache(1 << 16)
def _aged(value: str) -> tuple[str, int, int, int, bool, str] | None:
    """(before, age, lowest, number of choices, age among them, after) of an age; none where it stays."""
    m = re.match(r"(\D*)(\d{1,3})", value)
    if not m:
        return None
    age, s = int(m[2]), L.AGE_SPREAD
    first, last, spread = (0, 17, s["pediatric"]) if age < 18 else (18, 64, s["adult"]) if age < 65 else (65, 110, s["older_adult"])
    low, high = max(first, age - spread), min(last, age + spread)
    inside = low <= age <= high
    choices = high - low + (not inside)
    return (m[1], age, low, choices, inside, value[m.end() :]) if choices > 0 else None


def _offsets(strings: pa.Array) -> np.ndarray:
    return np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)


def _spans(texts: pa.Array, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of all matches: marks are put around them, and places follow from where the marks stand."""
    marked = pc.replace_substring_regex(texts, f"(?i)(?:{pattern})", "\x01\\0\x02")
    at = _offsets(marked)
    data = np.frombuffer(marked.buffers()[2], np.uint8)[: at[-1]]
    opened, shut = np.flatnonzero(data == 1), np.flatnonzero(data == 2)
    row = np.searchsorted(at, opened, "right") - 1
    marks = 2 * (np.arange(len(opened)) - np.searchsorted(opened, at[:-1])[row])
    return row, opened - at[row] - marks, shut - at[row] - marks - 1


def _between(texts: pa.Array, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The slices of texts that disjoint spans name, by row and start."""
    at = _offsets(texts)
    bounds = np.stack((at[row] + start, at[row] + end), 1).astype(np.int32).ravel()
    return pa.StringArray.from_buffers(max(0, len(bounds) - 1), pa.py_buffer(bounds), texts.buffers()[2]).take(pa.array(np.arange(0, len(bounds), 2)))


def _joined(strings: pa.Array, chosen: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The chosen strings put together, those between two edges as one."""
    flat = strings.take(pa.array(chosen))
    return pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(_offsets(flat)[edges].astype(np.int32)), flat.buffers()[2])


def _joined_by(strings: pa.Array, edges: np.ndarray) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), strings), "; ")


def _keys(*parts: pa.Array | np.ndarray | str) -> pa.Array:
    """The parts joined by bars, row by row."""
    return pc.binary_join_element_wise(*[pa.array(p).cast(pa.string()) if isinstance(p, np.ndarray) else p for p in parts], "|")


def _draws(size: int | np.ndarray, keys: pa.Array) -> np.ndarray:
    """Numbers in [0, size) as ``draws.draw`` gives them."""
    return md5_words(keys)[0].astype(np.int64) % size


def _listed(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


@lru_cache(1 << 16)
def _named(codes: bytes, names: tuple[str, ...]) -> str:
    return ";".join(names[c] for c in codes)


def _other_sex(value: str) -> str:
    new = L.SEX_PAIRS.get(value.lower(), value)
    return new[:1].upper() + new[1:].lower() if _upper(value) else new


@dataclass(frozen=True)
class PlainFilling:
    """Masks plain texts by version 3 and fills them by version 4, ``offers`` being the lists of ranked words that rows name by number."""

    masking: MaskingConfig
    filling: FillingConfig
    offers: Sequence[Sequence[tuple[str, float]]]

    def __post_init__(self) -> None:
        c, rules = self.masking, getattr(self.masking.annotator, "rules", None)
        whole = c.mask_ids and c.mask_age and c.mask_dates and c.mask_names and c.mask_locations and c.mask_organizations and c.mask_sex and c.mask_low_risk_wording
        if not whole or c.version != 3 or self.filling.version != 4 or self.filling.max_masks is not None:
            raise ValueError("only whole masking of version 3 and filling of version 4 have this way")
        if rules is None or any(label == "DATE" or "(?" in pattern.replace("(?:", "") or r"\p" in pattern for label, pattern in rules):
            raise ValueError("only rules without dates, in patterns that RE2 reads, have this way")
        if self.filling.date_shift_max > 365:
            raise ValueError("dates may move by a year at most, or years would leave what Python's dates hold")
        if not all(word.isascii() for offer in self.offers for word, _ in offer):
            raise ValueError("only ASCII words have this way")

    def found(self, texts: pa.Array, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(row, start, end, number of the type) of the spans to mask, by row and start, and the types."""
        parts: list[tuple[np.ndarray, ...]] = []
        kinds: list[tuple[str, int, str]] = []

        def add(spans: Sequence[np.ndarray], name: str, priority: int, source: str) -> None:
            parts.append((*spans, np.full(len(spans[0]), len(kinds))))
            kinds.append((name, priority, source))

        for i, (name, pattern) in enumerate((("ID", L.ID_PATTERN), ("AGE", L.AGE_PATTERN), ("DATE", L.DATE_PATTERN))):
            add(_spans(texts, pattern), name, i, "regex")
        for label, pattern in self.masking.annotator.rules:
            row, start, end = _spans(texts, pattern)
            values = _between(texts, row, start, end)
            keep = np.ones(len(row), bool)
            for i in np.flatnonzero(pc.match_substring_regex(values, _MAYBE_MEDICAL).to_numpy(zero_copy_only=False)):
                keep[i] = not _medical_span(values[int(i)].as_py())
            add((row[keep], start[keep], end[keep]), annotate.LABELS[label], 3, f"rule:{label}")
        add(_spans(texts, annotate.words_pattern(L.SEX_TERMS)), "SEX", 4, "lexicon")
        row, start, end, kind = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((end, row * _FAR + start))
        row, start, end, kind = (x[order] for x in (row, start, end, kind))
        # Where no two spans of a row share a place, all stay. Neighbours by start tell that.
        clash = np.unique(row[1:][(row[1:] == row[:-1]) & (end[:-1] > start[1:])])
        if len(clash):
            stay = np.ones(len(row), bool)
            for r in clash.tolist():
                a, b = np.searchsorted(row, [r, r + 1]).tolist()
                kept: list[int] = []
                for i in sorted(range(a, b), key=lambda i: (kinds[kind[i]][1], start[i], end[i], kinds[kind[i]][0], kinds[kind[i]][2])):
                    stay[i] = not any(start[i] < end[j] and end[i] > start[j] for j in kept)
                    kept += [i] if stay[i] else []
            row, start, end, kind = (x[stay] for x in (row, start, end, kind))
        words = self._neutral(texts, keys, row, start, end)
        row, start, end, kind = (np.concatenate(x) for x in zip((row, start, end, kind), (*words, np.full(len(words[0]), len(kinds)))))
        order = np.argsort(row * _FAR + start)
        return row[order], start[order], end[order], kind[order], [*(name for name, *_ in kinds), "LOW_RISK_WORDING"]

    def _neutral(self, texts: pa.Array, keys: pa.Array, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """The sample of neutral words outside the spans that are taken."""
        ratio = self.masking.mask_ratio
        w = _spans(texts, annotate.words_pattern(L.SAFE_LOW_RISK_WORDS))
        if len(row):
            before = np.searchsorted(row * _FAR + start, w[0] * _FAR + w[2]) - 1
            free = (before < 0) | ((row * _FAR + end)[before] <= w[0] * _FAR + w[1])
            w = tuple(x[free] for x in w)
        n_row, n_start, _ = w
        of = np.bincount(n_row, minlength=len(texts))
        size = np.maximum(1, np.rint(of * ratio)).astype(np.int64) if ratio > 0 else 0 * of
        asked = np.flatnonzero((of > size)[n_row])
        keep = np.ones(len(n_row), bool)
        if len(asked):
            # The rank of each within its row, by the hash of key and place.
            words = md5_words(_keys(str(self.masking.seed), keys.take(pa.array(n_row[asked])), n_start[asked]))
            by = np.lexsort((*words[::-1], n_row[asked]))
            ranked_row = n_row[asked][by]
            place = np.arange(len(by)) - np.searchsorted(ranked_row, ranked_row)
            keep[asked[by]] = place < size[ranked_row]
        return tuple(x[keep] for x in w)

    def filled(self, texts: pa.Array, keys: pa.Array, offered: np.ndarray, errors: pa.Array) -> dict[str, pa.Array]:
        """The columns of all variants of the texts, variant by variant.

        Pieces of texts are slices of one buffer, in turn what stays and what is masked; a filled text is its pieces
        with those in between taken from the replacements.
        """
        config, n_texts = self.filling, len(texts)
        keys = keys.cast(pa.string())
        row, start, end, kind, types = self.found(texts, keys)
        n = len(row)
        at = _offsets(texts)
        first = np.searchsorted(row, np.arange(n_texts + 1))
        number = np.arange(n) - first[row] + 1
        # Bounds of the pieces: each row begins one, each span begins two.
        head = 2 * first[:-1] + np.arange(n_texts)
        mine = 2 * np.arange(n) + row + 1
        bounds = np.empty(2 * n + n_texts + 1, np.int32)
        bounds[head], bounds[mine], bounds[mine + 1], bounds[-1] = at[:-1], at[row] + start, at[row] + end, at[-1]
        pieces = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), texts.buffers()[2])
        edges = np.append(head, len(bounds) - 1)
        values = pieces.take(pa.array(mine))
        one = np.full(len(bounds) - 1, len(bounds) - 1)
        one[:] = np.arange(len(bounds) - 1)
        one[mine] = len(bounds) - 1
        masked = _joined(pa.concat_arrays([pieces, pa.array([L.MASK])]), one, edges)
        expected = pc.count_substring(masked, L.MASK).to_numpy(zero_copy_only=False)
        blank = pc.match_substring_regex(masked, "^ *$").to_numpy(zero_copy_only=False)
        failed = pc.is_valid(errors).to_numpy(zero_copy_only=False)
        plain = ~failed & ~blank
        of = {t: np.flatnonzero(np.isin(kind, [i for i, x in enumerate(types) if x == t])) for t in dict.fromkeys(types)}
        coded = {t: values.take(pa.array(i)).dictionary_encode() for t, i in of.items() if t in ("AGE", "DATE", "SEX", "LOW_RISK_WORDING")}
        codes = {t: x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for t, x in coded.items()}
        uniques = {t: _listed(x.dictionary) for t, x in coded.items()}
        # What does not depend on the variant: methods, reasons against candidates, masks without one.
        method = np.empty(n, np.int64)
        known_methods = ["constraint_age_category", "constraint_shift_absolute_date", "constraint_preserve_unparsed", "constraint_change_sex_pair" if config.change_sex else "constraint_preserve_sex",
                         "constraint_fictitious_name", "constraint_fictitious_location", "constraint_fictitious_organization", "constraint_fictitious_id", L.METHOD_FILTERED, L.METHOD_FALLBACK]
        for t, m in (("AGE", 0), ("SEX", 3), ("NAME", 4), ("LOCATION", 5), ("ORGANIZATION", 6), ("ID", 7)):
            method[of.get(t, [])] = m
        read = [parsed(v) for v in uniques["DATE"]]
        is_date = np.array([x is not None for x in read], bool)[codes["DATE"]] if read else np.empty(0, bool)
        method[of["DATE"]] = np.where(is_date, 1, 2)
        words, w_row = of["LOW_RISK_WORDING"], row[of["LOW_RISK_WORDING"]]
        if ((offered < 0) | (offered >= len(self.offers))).any():
            raise ValueError("a row names no list of candidates")
        asked = codes["LOW_RISK_WORDING"] * len(self.offers) + offered[w_row]
        some, which = np.unique(asked, return_inverse=True)
        answers = [[self._neutral_word(uniques["LOW_RISK_WORDING"][x // len(self.offers)], x % len(self.offers), v) for x in some.tolist()] for v in range(config.variants)]
        lacks = np.array([a[1] == L.METHOD_FALLBACK for a in answers[0]], bool)[which] if len(some) else np.empty(0, bool)
        method[words] = np.where(lacks, 9, 8)
        bytes_, cut = method.astype(np.uint8).tobytes(), first.tolist()
        methods = pa.array([_named(bytes_[a:b], tuple(known_methods)) for a, b in zip(cut, cut[1:])], pa.string())
        reasons, lacking = [""] * n_texts, [""] * n_texts
        against = [";".join(a[2]) for a in answers[0]]
        for r, w in zip(w_row.tolist(), which.tolist()):
            if against[w]:
                reasons[r] = f"{reasons[r]};{against[w]}" if reasons[r] else against[w]
        for r, i in zip(w_row[lacks].tolist(), number[words[lacks]].tolist()):
            lacking[r] += f',"mask_{i}:{_NO_CANDIDATE}"'
        short = np.array([bool(x) for x in lacking], bool)
        out: list[dict[str, pa.Array]] = []
        for v in range(1, config.variants + 1):
            days = _draws(config.date_shift_max - config.date_shift_min + 1, _keys(str(config.seed), keys, f"{v}|0|date_offset")) + config.date_shift_min
            days = days if v % 2 else -days

            def draws(size: int | np.ndarray, i: np.ndarray, what: str) -> np.ndarray:
                return _draws(size, _keys(str(config.seed), keys.take(pa.array(row[i])), str(v), number[i], what))

            pool, total = [pieces], len(pieces)
            chosen = np.arange(len(pieces))

            def put(i: np.ndarray, strings: pa.Array, picks: np.ndarray | None = None) -> None:
                nonlocal total
                chosen[mine[i]] = total + (np.arange(len(i)) if picks is None else picks)
                pool.append(strings)
                total += len(strings)

            i = of["AGE"]
            aged = [_aged(x) for x in uniques["AGE"]]
            moves = np.flatnonzero(np.array([x is not None for x in aged], bool)[codes["AGE"]]) if aged else np.empty(0, np.int64)
            if len(moves):
                c = codes["AGE"][moves]
                age, least, choices, inside = (np.array([x[k] if x else 0 for x in aged])[c] for k in (1, 2, 3, 4))
                new = least + draws(choices, i[moves], "age")
                new = new + ((inside > 0) & (new >= age))
                pairs, picks = np.unique(c * 1000 + new, return_inverse=True)
                put(i[moves], pa.array([f"{aged[x // 1000][0]}{x % 1000}{aged[x // 1000][5]}" for x in pairs.tolist()], pa.string()), picks)
            i = of["DATE"][is_date]
            if len(i):
                c = codes["DATE"][is_date]
                styles = sorted({x[0] for x in read if x})
                day = np.array([x[1] if x else 0 for x in read])[c] + days[row[i]]
                style = np.array([styles.index(x[0]) if x else 0 for x in read])[c]
                pairs, picks = np.unique(style * 10_000_000 + day, return_inverse=True)
                put(i, pa.array([written(styles[x // 10_000_000], x % 10_000_000) for x in pairs.tolist()], pa.string()), picks)
            if config.change_sex and len(i := of["SEX"]):
                put(i, pa.array([_other_sex(x) for x in uniques["SEX"]], pa.string()), codes["SEX"])
            if len(i := of["ID"]):
                bare = pc.utf8_trim(values.take(pa.array(i)), " ")
                heads = pc.if_else(pc.match_substring_regex(bare, "[A-Za-z0-9-]{3,}$"), pc.replace_substring_regex(bare, "[A-Za-z0-9-]{3,}$", ""), "ID ")
                put(i, pc.binary_join_element_wise(heads, pa.array(draws(900_000, i, "id") + 100_000).cast(pa.string()), "X"))
            if len(i := of.get("NAME", np.empty(0, np.int64))):
                full = pa.array([f"{a} {b}" for a in L.FIRST_NAMES for b in L.LAST_NAMES])
                put(i, full, draws(len(L.FIRST_NAMES), i, "first") * len(L.LAST_NAMES) + draws(len(L.LAST_NAMES), i, "last"))
            for t, places, what in (("LOCATION", L.LOCATIONS, "place"), ("ORGANIZATION", L.ORGANIZATIONS, "institution")):
                if len(i := of.get(t, np.empty(0, np.int64))):
                    put(i, pa.array(places), draws(len(places), i, what))
            if len(words):
                put(words, pa.array([a[0] for a in answers[v - 1]], pa.string()), which)
            every = pa.concat_arrays(pool)
            text = _joined(every, chosen, edges)
            new = _joined_by(every.take(pa.array(chosen[mine])), first)
            # What stays must stand in the filled text in order. It is put there in order, so that a look at its pieces is enough.
            stays = np.ones(len(pieces), bool)
            stays[mine] = False
            changed = np.zeros(n_texts, bool)
            moved = np.flatnonzero(stays & (chosen != np.arange(len(pieces))))
            changed[np.searchsorted(edges, moved, "right") - 1] = True
            left = pc.match_substring(text, L.MASK).to_numpy(zero_copy_only=False)
            wrong = changed | left | (expected != np.diff(first))
            issues = ["[]" if not x else f"[{x[1:]}]" for x in lacking]
            for r in np.flatnonzero(wrong).tolist():
                said = [f'"mask_metadata_count_mismatch:{expected[r]}!={cut[r + 1] - cut[r]}"'] if expected[r] != cut[r + 1] - cut[r] else []
                said += ['"unfilled_mask_remaining"'] if left[r] else []
                said += ['"non_mask_text_changed"'] if changed[r] else []
                issues[r] = f"[{','.join(said)}{lacking[r]}]"
            status = np.select([failed, blank, wrong, short], [3, 4, 2, 1], 0)
            states = pa.array(["filled", "filled_with_fallback", "validation_failed", "error", "empty"])
            ok, is_blank = pa.array(plain), pa.array(failed | blank)
            out.append({
                "variant_id": pa.array(np.full(n_texts, v, np.int32)),
                "filled_text": pc.if_else(is_blank, masked, text), "predicted_tokens": pc.if_else(ok, new, ""), "fill_status": states.take(pa.array(status)), "validation_issues": pc.if_else(ok, pa.array(issues), "[]"),
                "fill_error": pc.fill_null(errors, ""), "methods": pc.if_else(ok, methods, ""), "reasons": pc.if_else(ok, pa.array(reasons), ""),
            })
        return {name: pa.concat_arrays([x[name] for x in out]) for name in out[0]}

    def _neutral_word(self, original: str, offer: int, rank: int) -> tuple[str, str, tuple[str, ...]]:
        """(replacement, method, reasons against all candidates) of a neutral word."""
        pos, protected = "" if re.search(r"[\s\-/,]", original) else "ADV", _protected(original)
        accepted, against = [], []
        for token, _ in self.offers[offer][: self.filling.top_k]:
            word = token.strip().removeprefix("##").strip()
            why = rejection_reasons(word, original, pos, protected)
            against += why
            if not why:
                accepted.append(word)
        chosen = accepted[min(rank, len(accepted) - 1)] if accepted else original
        return chosen, L.METHOD_FILTERED if accepted else L.METHOD_FALLBACK, tuple(against)


def fill_plain(df: DataFrame, text: str, key: str, masking: MaskingConfig, filling: FillingConfig, offers: Sequence[Sequence[tuple[str, float]]], offered: Column, error: Column) -> DataFrame:
    """Variants of texts that are all plain: masked, filled and validated, with the methods and the reasons against candidates.

    ``offered`` is the number of each row's list of candidates; where ``error`` is not null the row has failed.
    """
    by = PlainFilling(masking, filling, offers)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                # A copy, so that the places of texts begin at 0.
                texts = part.column(1).take(pa.array(np.arange(part.num_rows))).cast(pa.string())
                out = by.filled(texts, part.column(0), part.column(2).to_numpy(zero_copy_only=False), part.column(3))
                yield pa.RecordBatch.from_pydict({key: pa.concat_arrays([part.column(0)] * filling.variants)} | out)

    schema = f"{key} {kind}, variant_id int, filled_text string, predicted_tokens string, fill_status string, validation_issues string, fill_error string, methods string, reasons string"
    return df.select(key, text, offered.cast("int").alias("_offered"), error.alias("_error")).mapInArrow(run, schema)
