"""What a question asks for: versions, dates, periods and structure that it names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codicil.functions.dates import FORMS, MONTH_YEAR, first_date, month_end
from codicil.functions.text import version_key

# How questions name versions, comparisons, times and structure.
VERSION_REF = r"(?i)\b(?:v|version\s*:?\s*|edition\s*:?\s*)(\d{1,3}(?:\.\d{1,3})?)\b"
COMPARE = r"(?i)\b(compare|comparison|difference|differences|differ|change|changed|changes|what'?s new|what is new|vs\.?|versus|introduced|added|removed|deleted|dropped|withdrawn|inserted)\b"
VERSION_CONTEXT = r"(?i)\b(?:versions?|latest|previous|earlier|older|newer|current|revised|revision|amended|amendment|updated|update|last\s+year|over\s+time|edition|recently|most\s+recent)\b"
OVER_TIME = (
    r"(?i)\bover\s+(?:time|the\s+years|the\s+versions|the\s+editions)\b"
    r"|\b(?:lowest|highest|cheapest|costliest|best|worst|maximum|minimum|longest|shortest|largest|smallest)\b[^?.]{0,40}\bever\b"
    r"|\bever\s+(?:been|offered|charged|allowed|lower|higher|cheaper)\b"
    r"|\b(?:than|compared\s+(?:to|with)|versus|vs\.?)\s+(?:before|earlier|previously|in\s+the\s+past|the\s+past|older\s+(?:guides?|versions?|editions?)|(?:the\s+)?earlier\s+(?:guides?|versions?|editions?))\b"
    r"|\b(?:then\s+and\s+now|now\s+and\s+then|before\s+and\s+(?:after|now)|earlier\s+and\s+now|past\s+and\s+present)\b"
    r"|\b(?:has|have)\s+(?:the\s+|my\s+|our\s+|your\s+)?(?:[\w-]+\s+){0,5}?(?:gone\s+(?:up|down)|increased|decreased|risen|fallen|dropped|reduced|changed|become\s+\w+)\b"
    r"|\bhow\s+(?:has|have)\b[^?]{0,60}\b(?:changed|moved|evolved)\b"
)
ACROSS = (
    r"(?i)\b(?:each|every|both|all|either|the\s+two)\s+(?:of\s+)?(?:the\s+)?(?:(?:two|three|four|five|six|\d{1,2})\s+)?(?:editions?|versions?)\b"
    r"|\bacross\s+(?:the\s+|all\s+)?(?:editions|versions)\b"
    r"|\bwhich\s+(?:edition|version)\s+(?:sets|has|gives|allows|requires|is|offers|charges)\s+(?:the\s+|a\s+)?(?:higher|lower|larger|smaller|greater|stricter|longer|shorter|more|less|highest|lowest|largest|smallest|greatest|longest|shortest|most|least|cheapest|later|earlier|newer|older|latest|earliest|newest|oldest|more\s+recent)\b"
    r"|\bwhich\s+(?:editions|versions)\b"
)
WHEN_INTRODUCED = (
    r"(?i)\bsince\s+when\b|\bfrom\s+(?:which|what)\s+(?:version|edition|date|year)\b"
    r"|\bwhen\s+(?:did|was|were|has|have|had)\b[^?.;]*?\b(?:start|started|begin|began|begun|commence|commenced|introduce|introduced|add|added|launch|launched|come|came|appear|appeared|bring|brought|take\s+effect|took\s+effect|become|became|change|changed|increase|increased|raise|raised|reduce|reduced|lower|lowered|revise|revised|remove|removed|drop|dropped|withdraw|withdrawn|discontinue|discontinued|stop|stopped|end|ended)\b"
    r"|\b(?:which|what)\s+(?:version|edition)\s+(?:first\s+)?(?:introduced|added|brought|started|began|changed)\b"
    r"|\bfirst\s+(?:introduced|added|appeared|mentioned|offered|started|began)\b"
)
WHICH_PERIOD = (
    r"(?i)\b(?:which|what)\s+(?:period|time|year|month|date|phase)\s+(?:had|was|were|saw)\b"
    r"|\bwhen\s+(?:was|were|did)\b[^?.;]*?\b(?:lowest|highest|cheapest|costliest|largest|smallest|longest|shortest|least|most|best|worst|peak|peaked)\b"
)
YEAR = r"(?i)\b(?:in|during|for)\s+((?:19|20)\d{2})\b"
YEAR_RANGE = r"(?i)\b(?:19|20)\d{2}\s*(?:[-–—]|\bto\b|\bthrough\b)\s*(?:\d{2}|\d{4})\b|\bFY\s*(?:19|20)\d{2}\s*[-–—]\s*\d{2}\b"
AGAINST_NOW = r"(?i)\b(?:with|to|and|from|vs\.?|versus|than)\s+(?:(?:the\s+)?(?:one|a\s+loan|loans)\s+(?:\w+\s+)?)?(?:today|now|at\s+present|currently|(?:the\s+)?current\s+(?:one|version|policy|rules?|guide|edition))\b"
PHRASE = r'"([^"]{3,200})"'
CLAUSE = r"(?i)\b(?:clause|section|para(?:graph)?|point)\s+(\d{1,2}(?:\.\d{1,3}){0,4})\b"
DIVISION = r"(?i)\b((?:chapter|annexure|annex|appendix|schedule|part)\s+(?:\d{1,3}|[ivxlcdm]{1,6}))\b"
PAGE = r"(?i)\b(?:pages?|pg\.?|p\.)\s*(?:no\.?\s*|number\s*|#\s*)?(\d{1,6})(?:\s*(?:-|–|to)\s*(\d{1,6}))?\b"
CODE = r"\b([A-Za-z]{1,10}(?:[-/][A-Za-z]{1,10}){0,3}[-/]?\d[A-Za-z0-9]*(?:[-/.][A-Za-z0-9]+){0,4})\b"
IDENTIFIER = r"\b([A-Za-z]{1,10}[-/][A-Za-z0-9]{1,10}(?:[-/][A-Za-z0-9]{1,10}){0,4})\b"
MOST_COMPARED = 5
ANY_DATE = "(?i)" + "|".join(pattern.removeprefix("(?i)") for pattern, _ in FORMS)


def label_key(label: Column) -> Column:
    """One spelling for each version label: ``v1`` and ``01.0`` are both 1."""
    return F.array_join(version_key(label).cast("array<string>"), ".")


def asked_dates(text: Column, today: Column) -> Column:
    """Distinct dates that a question asks about, full ones first, then months (their last day); one date set against now adds
    today."""
    full = F.transform(F.regexp_extract_all(text, F.lit(ANY_DATE), F.lit(0)), first_date)
    months = F.transform(F.regexp_extract_all(F.regexp_replace(text, ANY_DATE, " "), F.lit(MONTH_YEAR), F.lit(0)), month_end)
    found = F.array_distinct(F.array_compact(F.concat(full, months)))
    return F.when((F.size(found) == 1) & F.rlike(text, F.lit(AGAINST_NOW)), F.array_distinct(F.array_append(found, today))).otherwise(found)


def asked_day(text: Column) -> Column:
    """The one date of a question: a full date, the end of a month, or the end of a year that stands alone."""
    year = F.when(~F.rlike(text, F.lit(YEAR_RANGE)) & F.rlike(text, F.lit(YEAR)), F.make_date(F.regexp_extract(text, YEAR, 1).cast("int"), F.lit(12), F.lit(31)))
    return F.coalesce(first_date(text), month_end(text), year)
