"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Written-out forms seen in bibliographic records, tried after the ISO forms.
WRITTEN_FORMS = (
    "d MMMM yyyy",
    "d MMM yyyy",
    "MMMM d, yyyy",
    "MMM d, yyyy",
    "MMMM yyyy",
    "MMM yyyy",
    "yyyy/M/d",
    "M/d/yyyy",
)


def parse_date(col: str | Column) -> Column:
    """Wall-clock time of a free-form date, value by value; no time zone and no current day play a part.

    Falls back to 1 January of the first year 19xx or 20xx in the text, else null. A
    time of day without a date is null; a zone after a time is not applied.
    """
    value = F.trim(F.col(col) if isinstance(col, str) else col)
    written = [F.try_to_date(value, form).cast("timestamp_ntz") for form in WRITTEN_FORMS]
    year = F.regexp_extract(value, r"(?:19|20)\d{2}", 0)
    first_day = F.concat(F.nullif(year, F.lit("")), F.lit("-01-01")).try_cast("timestamp_ntz")
    # without four digits in a row there is no year, and a date that is not one of a whole year has one
    return F.when(value.rlike(r"\d{4}"), F.coalesce(value.try_cast("timestamp_ntz"), *written, first_day))


def year_of(col: str | Column) -> Column:
    return F.year(parse_date(col))
