"""Dates: per-patient shifts, ages, and dates inside text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.config import CLINICAL

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# The date forms recognised in text.
ISO_DATE = r"\b(\d{4})-(\d{2})-(\d{2})\b"
US_DATE = r"\b(\d{2})/(\d{2})/(\d{4})\b"
VERBOSE_DATE = r"\b(\d{1,2})\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+(\d{4})\b"


def shift_days(patient: Column, salt: str = CLINICAL.shift_salt, max_days: int = CLINICAL.max_shift_days) -> Column:
    """Whole days in -max..max derived from the patient id and a salt."""
    digest = F.sha2(F.concat(patient.cast("string"), F.lit(salt)), 256)
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return (number % (2 * max_days + 1) - max_days).cast("int")


def shift_date(day: Column, patient: Column) -> Column:
    return F.date_add(day, shift_days(patient))


def shift_text_dates(text: Column, patient: Column) -> Column:
    """Move every valid ISO, US and day-month-year date in the text; other text stays as it is."""
    offset = shift_days(patient)

    def iso(match: Column) -> Column:
        return F.date_format(F.date_add(match.try_cast("date"), offset), "yyyy-MM-dd")

    def us(match: Column) -> Column:
        day = F.try_to_date(match, "MM/dd/yyyy")
        return F.date_format(F.date_add(day, offset), "MM/dd/yyyy")

    def verbose(match: Column) -> Column:
        parts = [F.regexp_extract(match, "(?iU)" + VERBOSE_DATE, i) for i in (1, 2, 3)]
        plain = F.concat_ws("-", parts[2], _month_number(parts[1]), F.lpad(parts[0], 2, "0"))
        moved = F.date_add(plain.try_cast("date"), offset)
        names = F.array(*[F.lit(m) for m in MONTHS])
        return F.concat_ws(
            " ", F.dayofmonth(moved).cast("string"), F.element_at(names, F.month(moved)), F.year(moved).cast("string")
        )

    def guarded(change):
        return lambda match: F.coalesce(_nonempty(change(match)), match)

    shifted = _rewrite(text, "(?U)" + ISO_DATE, guarded(iso))
    shifted = _rewrite(shifted, "(?U)" + US_DATE, guarded(us))
    return _rewrite(shifted, "(?iU)" + VERBOSE_DATE, guarded(verbose))


def _nonempty(value: Column) -> Column:
    return F.when(value != "", value)


def _month_number(name: Column) -> Column:
    short = F.initcap(F.substring(name, 1, 3))
    table = F.create_map(*[F.lit(v) for i, m in enumerate(MONTHS, 1) for v in (m, f"{i:02d}")])
    return table[short]


def _rewrite(text: Column, pattern: str, change) -> Column:
    """Replace each match of ``pattern`` by ``change(match)``: literals and matches are re-joined in order."""
    literals = F.split(text, pattern)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    changed = F.concat(F.transform(matches, change), F.array(F.lit("")))
    return F.array_join(F.zip_with(literals, changed, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def age_days(created: Column, as_of: Column) -> Column:
    """Whole days elapsed, rounded down."""
    return F.floor((as_of.cast("timestamp").cast("double") - created.cast("timestamp").cast("double")) / 86_400)


def hours_since(moment: Column, as_of: Column) -> Column:
    return (as_of.cast("timestamp").cast("double") - moment.cast("timestamp").cast("double")) / 3_600
