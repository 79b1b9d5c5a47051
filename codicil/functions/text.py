"""Column expressions over text, used inside table jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that no search counts.
STOP_WORDS = (
    "a an and are as at be by can do does for from has have how i in is it its me my of on or our please should tell than "
    "that the their there these this to us was we what when where which who why will with would you your"
).split()
# A search token.
TOKEN = r"[a-z0-9]+(?:[.\-/][a-z0-9]+)*"
# Secrets and what stands in their place.
SECRETS = (
    (r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+", "***"),
    (r"(\w+://[^:/\s]+:)[^@\s]+(@)", "***@"),
    (r"(?i)((?:password|passwd|secret|token|api[_-]?key|authorization|access[_-]?key)[\"']?\s*[:=]\s*[\"']?)([^\"'\s,}]+)", "***"),
    (r"(sk-)[A-Za-z0-9_-]{16,}", "***"),
)


def tokens(text: Column) -> Column:
    """Search tokens of more than one character that are no stop words, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


def normalised(text: Column) -> Column:
    """Lower-case words of letters, digits, per cent signs and dots, parted by one space; dots at their ends go."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([0-9a-z%.]+)"))
    words = F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"^\.+|\.+$", "")), lambda w: w != "")
    return F.array_join(words, " ")


def redacted(text: Column) -> Column:
    """Text with the secrets of `SECRETS` masked."""
    for pattern, mask in SECRETS:
        text = F.regexp_replace(text, pattern, "$1" + mask)
    return text


def secret_count(text: Column) -> Column:
    """How many secrets each pattern finds, summed."""
    counts = [F.regexp_count(text, F.lit(pattern)) for pattern, _ in SECRETS]
    return sum(counts[1:], counts[0])


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("int")


def trigrams(text: Column) -> Column:
    """Distinct three-character pieces of the lower-case words, each with two blanks before and one after."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+)"))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Share of common trigrams in the union of two trigram arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def contains_ci(column: Column, term: str) -> Column:
    """Whether a text contains a term in any case; `%` and `_` stand for themselves."""
    return F.contains(F.lower(column), F.lit(term.lower()))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two longs differ."""
    return F.bit_count(a.bitwiseXOR(b))


def content_similarity(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, falling to 0 at 32 differing bits."""
    return F.greatest(F.lit(0.0), 1 - hamming(a, b) / 32)


def indian_digits(number: Column) -> Column:
    """Whole numbers grouped by three, then by two: 12,34,567."""
    digits = number.cast("bigint").cast("string")
    grouped = F.regexp_replace(digits, r"(\d)(?=(\d\d)+\d$)", "$1,")
    return F.when(F.length(digits) <= 3, digits).otherwise(grouped)


def title_key(title: Column) -> Column:
    """A title without version, year and draft words and punctuation, lower-case."""
    t = F.lower(F.coalesce(title, F.lit("")))
    t = F.regexp_replace(t, r"\b(?:version|ver|v)\s*\.?\s*\d+(?:\.\d+)*\b", " ")
    t = F.regexp_replace(t, r"\b(?:19|20)\d\d\b", " ")
    t = F.regexp_replace(t, r"\b(?:draft|final|revised|updated|copy)\b", " ")
    return F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " "))


def version_key(label: Column) -> Column:
    """Numbers of a version label without trailing zeros: ``v1`` and ``1.0`` agree, and arrays compare in order."""
    parts = F.transform(F.regexp_extract_all(label, F.lit(r"(\d+)")), lambda p: p.cast("int"))
    last = F.array_max(F.transform(parts, lambda p, i: F.when(p != 0, i + 1).otherwise(0)))
    return F.slice(parts, F.lit(1), F.greatest(F.coalesce(last, F.lit(0)), F.lit(1)))
