"""Dates in text: kinds, parsing with the style kept, shifting. All native expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemill.functions import lexicons as L
from casemill.functions.binding import bind

#: Styles in the order in which they are tried: name, pattern of the cleaned value, how it is read and written.
STYLES = (
    ("ymd_dash", r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d", "yyyy-MM-dd"),
    ("ymd_slash", r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d", "yyyy/MM/dd"),
    ("mdy_slash4", r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy", "MM/dd/yyyy"),
    ("mdy_slash2", r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy", "MM/dd/yy"),
    ("month_name", r"^[a-z]{3,9} \d{1,2}, \d{4}$", "MMMM d, yyyy", "MMMM dd, yyyy"),
    ("month_abbr", r"^[a-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy", "MMM dd, yyyy"),
    ("month_name_no_comma", r"^[a-z]{3,9} \d{1,2} \d{4}$", "MMMM d yyyy", "MMMM dd yyyy"),
    ("month_abbr_no_comma", r"^[a-z]{3} \d{1,2} \d{4}$", "MMM d yyyy", "MMM dd yyyy"),
)


def _cleaned(value: Column) -> Column:
    """Trimmed, ordinal endings after a blank dropped, blanks collapsed to one."""
    bare = F.regexp_replace(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), r"(?iU)\s+(?:st|nd|rd|th)\b", "")
    return F.regexp_replace(bare, r"(?U)\s+", " ")


def _read(text: Column, style: str, read: str) -> Column:
    proper = F.initcap(F.lower(text))
    day = F.to_date(F.try_to_timestamp(proper, F.lit(read)))
    # Two-digit years: 69 to 99 lie in the twentieth century.
    return F.when(text.rlike(r"/(?:69|[7-9]\d)$"), F.add_months(day, -1200)).otherwise(day) if style == "mdy_slash2" else day


def parsed(value: Column) -> tuple[Column, Column]:
    """(date, style); a null date and ``unparsed`` where no style fits."""
    text = _cleaned(value)
    days = [F.when(F.lower(text).rlike(pattern), _read(text, style, read)) for style, pattern, read, _ in STYLES]
    style = F.coalesce(*[F.when(d.isNotNull(), F.lit(s[0])) for d, s in zip(days, STYLES)], F.lit("unparsed"))
    return F.coalesce(*days), style


def _shifted_or_null(value: Column, days: Column) -> Column:
    def moved(text: Column, low: Column) -> Column:
        return F.coalesce(*[F.when(low.rlike(pattern), F.date_format(F.date_add(_read(text, style, read), days), write)) for style, pattern, read, write in STYLES])

    return bind(_cleaned(value), lambda text: F.when(text.rlike(r"\d{4}|/\d\d$"), bind(F.lower(text), lambda low: moved(text, low))))


def _is_absolute(value: Column) -> Column:
    def fits(text: Column, low: Column) -> Column:
        return reduce(or_, [low.rlike(pattern) & _read(text, style, read).isNotNull() for style, pattern, read, _ in STYLES])

    return bind(_cleaned(value), lambda text: F.coalesce(bind(F.lower(text), lambda low: fits(text, low)), F.lit(False)))


def shifted(value: Column, days: Column) -> Column:
    """The date moved by ``days`` in its own style with padded days; what can't be parsed stays."""
    return F.coalesce(_shifted_or_null(value, days), value)


def _stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def kind(value: Column) -> Column:
    """absolute_date, month_day, week_range, gestational_age, duration or unparsed; the first that fits."""
    text = _stripped(value)
    return (
        F.when(_is_absolute(value), "absolute_date")
        .when(text.rlike("(?i)" + L.MONTH_DAY_PATTERN), "month_day")
        .when(text.rlike("(?i)" + L.WEEK_RANGE_PATTERN), "week_range")
        .when(text.rlike("(?i)" + L.GESTATIONAL_PATTERN), "gestational_age")
        .when(text.rlike("(?i)" + L.DURATION_PATTERN), "duration")
        .when(value.isNotNull(), "unparsed")
    )


def bounded(days: Column, limit: int) -> Column:
    """A small change other than zero, with the sign of ``days`` (zero counts as positive)."""
    size = F.abs(days) % max(1, limit) + 1
    return F.when(days >= 0, size).otherwise(-size)


def _part(value: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(_stripped(value), "(?i)" + pattern, group)


def _whole(value: Column, pattern: str, group: int) -> Column:
    return F.nullif(_part(value, pattern, group), F.lit("")).cast("int")


def shifted_month_day(value: Column, days: Column) -> Column:
    """A month and day without a year, moved within a leap year; written as full month and bare day."""
    text = F.initcap(F.lower(F.concat(_part(value, L.MONTH_DAY_PATTERN, 1), F.lit(" "), _part(value, L.MONTH_DAY_PATTERN, 2), F.lit(" 2000"))))
    day = F.coalesce(F.to_date(F.try_to_timestamp(text, F.lit("MMMM d yyyy"))), F.to_date(F.try_to_timestamp(text, F.lit("MMM d yyyy"))))
    return F.coalesce(F.date_format(F.date_add(day, days), "MMMM d"), value)


def shifted_weeks(value: Column, days: Column) -> Column:
    """A range of weeks moved a little, its width kept."""
    start, end = _whole(value, L.WEEK_RANGE_PATTERN, 1), _whole(value, L.WEEK_RANGE_PATTERN, 2)
    first = F.greatest(F.lit(1), start + bounded(days, 2))
    return F.coalesce(F.concat(first.cast("string"), F.lit("-"), (first + F.greatest(F.lit(0), end - start)).cast("string"), F.lit(" weeks")), value)


def shifted_gestation(value: Column, days: Column) -> Column:
    """A gestational age moved a little between 1 and 42 weeks."""
    weeks = _whole(value, L.GESTATIONAL_PATTERN, 2)
    moved = F.greatest(F.lit(1), F.least(F.lit(42), weeks + bounded(days, 2)))
    return F.coalesce(F.concat(_part(value, L.GESTATIONAL_PATTERN, 1), moved.cast("string"), _part(value, L.GESTATIONAL_PATTERN, 3)), value)


def shifted_duration(value: Column, days: Column) -> Column:
    """A duration moved a little, at least 1, unit and blanks kept."""
    number = _whole(value, L.DURATION_PATTERN, 1)
    moved = F.greatest(F.lit(1), number + bounded(days, 2))
    return F.coalesce(F.concat(moved.cast("string"), _part(value, L.DURATION_PATTERN, 2), _part(value, L.DURATION_PATTERN, 3)), value)


def shifted_any(value: Column, days: Column) -> Column:
    """The value moved by the rule of its kind; unparsed values stay."""
    text = _stripped(value)
    fits = lambda pattern: text.rlike("(?i)" + pattern)
    other = (
        F.when(fits(L.MONTH_DAY_PATTERN), shifted_month_day(value, days))
        .when(fits(L.WEEK_RANGE_PATTERN), shifted_weeks(value, days))
        .when(fits(L.GESTATIONAL_PATTERN), shifted_gestation(value, days))
        .when(fits(L.DURATION_PATTERN), shifted_duration(value, days))
    )
    return F.coalesce(_shifted_or_null(value, days), other, value)
