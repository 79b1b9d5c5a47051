"""Dates and figures written in texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How dates are written, and what multiplies a figure.
MONTHS = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
FORMS = [  # pattern, and which of its groups hold year, month and day
    (r"(?i)\b(\d{4})-(\d{1,2})-(\d{1,2})\b", (1, 2, 3)),
    (r"(?i)\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\b", (3, 2, 1)),
    (rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({MONTHS}),?\s+(\d{{4}})\b", (3, 2, 1)),
    (rf"(?i)\b({MONTHS})\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", (3, 1, 2)),
]
MONTH_YEAR = rf"(?i)\b({MONTHS})\s+(\d{{4}})\b"
SHORT_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
MULTIPLIERS = {"thousand": 10**3, "lakh": 10**5, "lac": 10**5, "million": 10**6, "crore": 10**7, "billion": 10**9}
FIGURE = r"(?i)(\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(thousand|lakh|lac|million|crore|billion)s?\b"


def month_number(name: Column) -> Column:
    """1 to 12 from a month's name, or from its number."""
    by_name = F.array_position(F.array(*[F.lit(m) for m in SHORT_MONTHS]), F.lower(F.substring(name, 1, 3))).cast("int")
    return F.when(F.rlike(name, F.lit(r"^\d+$")), name.try_cast("int")).otherwise(by_name)


def first_date(text: Column) -> Column:
    """The complete date that stands first in a text: ISO, day.month.year, ``1st July 2026`` or ``July 1, 2026``.

    Of the numbers, a month over 12 and a day that could be one are swapped. Years outside 1900 to 2200, and days that no
    month has, are no dates. Of each way to write a date the first in the text is read.
    """
    found = []
    for pattern, (y, m, d) in FORMS:
        month, day = month_number(F.regexp_extract(text, pattern, m)), F.regexp_extract(text, pattern, d).try_cast("int")
        swap = (month > 12) & (day <= 12)
        iso = F.concat_ws("-", F.regexp_extract(text, pattern, y), F.lpad(F.when(swap, day).otherwise(month).cast("string"), 2, "0"), F.lpad(F.when(swap, month).otherwise(day).cast("string"), 2, "0"))
        when = F.try_to_date(iso, "yyyy-MM-dd")
        fine = F.rlike(text, F.lit(pattern)) & F.year(when).between(1900, 2200)
        found.append(F.when(fine, F.struct(F.instr(text, F.regexp_substr(text, F.lit(pattern))).alias("at"), when.alias("day"))))
    return F.array_min(F.array_compact(F.array(*found)))["day"]


def month_end(text: Column) -> Column:
    """The last day of the month that a text names first (``March 2025``)."""
    iso = F.concat_ws("-", F.regexp_extract(text, MONTH_YEAR, 2), F.lpad(month_number(F.regexp_extract(text, MONTH_YEAR, 1)).cast("string"), 2, "0"), F.lit("01"))
    return F.when(F.rlike(text, F.lit(MONTH_YEAR)), F.last_day(F.try_to_date(iso, "yyyy-MM-dd")))


def multiplied(text: Column) -> Column:
    """Figures with a multiplier (``75 lakh``, ``1.5 crore``) as plain decimals, in order."""
    factor = F.create_map(*[F.lit(x) for k, v in MULTIPLIERS.items() for x in (k, v)])
    whole = F.regexp_extract_all(text, F.lit(FIGURE), F.lit(0))
    number = lambda w: F.regexp_replace(F.regexp_extract(w, FIGURE, 1), ",", "").cast("decimal(18,4)")
    return F.transform(whole, lambda w: (number(w) * F.element_at(factor, F.lower(F.regexp_extract(w, FIGURE, 2))).cast("decimal(12,0)")).cast("double"))
