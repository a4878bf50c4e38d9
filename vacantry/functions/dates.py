"""Dates, amounts, durations and their labels. The moment "now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, text

#: Written forms of dates, as Spark's patterns, in the order they are tried.
FORMATS = ("yyyy-M-d", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d/M/yyyy", "yyyy/M/d")
#: How those forms look, so that a pattern is only tried where it fits.
SHAPES = (
    r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2} [A-Za-z]{3} \d{4}$", r"^\d{1,2} [A-Za-z]{3,9} \d{4}$", r"^[A-Za-z]{3} \d{1,2}, \d{4}$",
    r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{4}/\d{1,2}/\d{1,2}$",
)
#: Names of months as durations spell them.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DATE = r"(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s*,?\s*)?(?:19|20)\d{2}"
PRESENT = r"present|current|till\s+date|to\s+date|now|ongoing"
#: A range begins as a month or a year does, which is looked at before all months are tried.
RANGE = rf"(?i)(?=[jfmasond][aepuco]|19|20)({DATE})\s*(?:-|–|—|to|until|through)\s*({DATE}|{PRESENT})"


def parse_date(c: Column) -> Column:
    """A timestamp from any of the written forms or ISO 8601; null if none fits."""
    t = clean_text(c)
    worded = F.concat_ws("", F.regexp_extract(t, r"^([^A-Za-z]*)", 1), F.initcap(F.regexp_extract(t, r"^[^A-Za-z]*([A-Za-z]*)", 1)), F.regexp_extract(t, r"^[^A-Za-z]*[A-Za-z]*(.*)$", 1))
    forms = [F.when(t.rlike(shape), F.try_to_timestamp(worded, F.lit(f))) for f, shape in zip(FORMATS, SHAPES)]
    iso = F.when(t.rlike(r"^\d{4}-?\d{2}-?\d{2}([T ].*)?$"), t.try_cast("timestamp"))
    return F.coalesce(*forms, iso)


def lenient_date(c: Column) -> Column:
    """What casts to a timestamp, else null."""
    return c.try_cast("timestamp")


def is_expired(deadline: Column, now: Column) -> Column:
    return deadline.isNotNull() & (deadline < now)


def is_open(deadline: Column, now: Column) -> Column:
    return deadline.isNull() | (deadline >= now)


def from_epoch(c: Column) -> Column:
    """Seconds since 1970 as a timestamp; null for zero, negative or other values."""
    seconds = c.cast("string").try_cast("long")
    return F.when(seconds > 0, F.timestamp_seconds(seconds))


def whole(c: Column) -> Column:
    """A number without its fraction, with commas by thousands; empty if it is none."""
    n = F.trim(c.cast("string")).try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n), F.format_number(F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("long"), 0)).otherwise("")


def money(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """``CUR low - high / period``; parts that are missing are left out; empty without an amount."""
    a, b = whole(low), whole(high)
    amount = F.when((a != "") & (b != "") & (a != b), F.concat(a, F.lit(" - "), b)).otherwise(F.coalesce(F.nullif(a, F.lit("")), b))
    head = F.concat_ws(" ", F.nullif(F.upper(F.trim(text(currency))), F.lit("")), amount)
    per = F.trim(text(period))
    return F.when(amount == "", "").when(per != "", F.concat(head, F.lit(" / "), per)).otherwise(head)


def month_index(token: Column, as_of: Column) -> Column:
    """Months since year 0 of a date like ``Jan 2021``, a bare year (January) or a word for now."""
    year = F.regexp_extract(token, r"((?:19|20)\d{2})", 1).try_cast("int")
    name = F.lower(F.substring(F.regexp_extract(token, r"([A-Za-z]{3,})", 1), 1, 3))
    month = F.greatest(F.array_position(F.array(*map(F.lit, MONTHS)), name), F.lit(1))
    return F.coalesce(year * 12 + month - 1, F.year(as_of) * 12 + F.month(as_of) - 1)


def duration_months(c: Column, as_of: Column) -> Column:
    """Months of a date range (1 at least), else of ``N years M months``, else 0."""
    t = text(c)
    start, end = F.regexp_extract(t, RANGE, 1), F.regexp_extract(t, RANGE, 2)
    span = month_index(end, as_of) - month_index(start, as_of)
    years = F.regexp_extract(t, r"(?i)(\d{1,2})\s*\+?\s*(?:years?|yrs?)\b", 1).try_cast("int")
    months = F.regexp_extract(t, r"(?i)(\d{1,3})\s*(?:months?|mos?)\b", 1).try_cast("int")
    return F.when(start != "", F.greatest(F.lit(1), span)).otherwise(F.coalesce(years, F.lit(0)) * 12 + F.coalesce(months, F.lit(0))).cast("int")


def short_date(c: Column) -> Column:
    return F.date_format(c, "d MMM yyyy")


def relative_date(c: Column, now: Column) -> Column:
    """How long ago a posting appeared; a date to come is written out."""
    days = F.floor((F.unix_micros(now) - F.unix_micros(c)) / 86_400_000_000)
    months = F.floor(days / 30 + 0.5)
    return (
        F.when(c.isNull(), "").when(days < 0, short_date(c)).when(days == 0, "today").when(days == 1, "yesterday")
        .when(days < 30, F.concat(days.cast("string"), F.lit(" days ago"))).when(months <= 1, "a month ago").otherwise(F.concat(months.cast("string"), F.lit(" months ago")))
    )


def deadline_label(c: Column, now: Column) -> tuple[Column, Column]:
    """Text and tone of a deadline. One that has passed is expired at once, also on its last day."""
    days = F.ceil((F.unix_micros(c) - F.unix_micros(now)) / 86_400_000_000)
    late = is_expired(c, now)
    words = (
        F.when(c.isNull(), "No deadline listed").when(late, F.concat(F.lit("Closed on "), short_date(c))).when(days == 0, "Closes today")
        .when(days == 1, "Closes tomorrow").when(days <= 5, F.concat(F.lit("Closes in "), days.cast("string"), F.lit(" days"))).otherwise(F.concat(F.lit("Apply by "), short_date(c)))
    )
    return words, F.when(late, "expired").when(days <= 5, "urgent").otherwise("neutral")


def score_band(score: Column) -> Column:
    return F.when(score >= 75, "Strong match").when(score >= 50, "Partial match").when(score >= 25, "Weak match").otherwise("Low match")


def rounded_score(score: Column) -> Column:
    """Half up; nulls count as 0."""
    return F.floor(F.coalesce(score, F.lit(0.0)) + 0.5).cast("int")


def months_label(months: Column) -> Column:
    """The span as a score's note has it: ``2 yr 6 mo``."""
    years, rest = F.floor(months / 12).cast("string"), (months % 12).cast("string")
    return (
        F.when(months <= 0, "no dated experience").when((months >= 12) & (months % 12 != 0), F.concat(years, F.lit(" yr "), rest, F.lit(" mo")))
        .when(months >= 24, F.concat(years, F.lit(" yrs"))).when(months >= 12, F.lit("1 yr")).otherwise(F.concat(rest, F.lit(" mo")))
    )


def months_span(months: Column) -> Column:
    """The span as a summary has it: ``2 yrs 6 mos``."""
    total = F.greatest(F.lit(0), F.floor(F.coalesce(months.cast("double"), F.lit(0.0)) + 0.5).cast("int"))

    def part(n: Column, unit: str) -> Column:
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise("")))

    return F.when(total == 0, "none listed").otherwise(F.concat_ws(" ", part(F.floor(total / 12), "yr"), part(total % 12, "mo")))
