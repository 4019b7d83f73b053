"""Scalar rules: text edits, tokens and costs, dates, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS, HOUR_MS = 86_400_000, 3_600_000
#: Share of the price that cached tokens are let off, by the beginning of a model's name.
CACHED_DISCOUNT = {"view": 0.5, "click": 0.75, "purchase": 0.9}
BANDS = ((50, "safe"), (70, "moderate"), (85, "warning"))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance by the longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def replaced(text: Column, find: str, by: str, case_sensitive: bool = True, whole_word: bool = False) -> tuple[Column, Column]:
    """(new text, number of replacements)."""
    body = rf"\Q{find}\E"
    pattern = ("" if case_sensitive else "(?i)") + (rf"\b{body}\b" if whole_word else body)
    return F.regexp_replace(text, pattern, by.replace("\\", "\\\\").replace("$", "\\$")), F.regexp_count(text, F.lit(pattern))


def lines_replaced(text: Column, first: int, last: int, by: list[str]) -> Column:
    """Lines first to last (from 1) exchanged; a range past the end appends."""
    lines = F.split(text, "\n")
    head, tail = F.slice(lines, 1, first - 1), F.filter(lines, lambda _, i: i >= last)
    return F.array_join(F.concat(head, F.array(*map(F.lit, by)).cast("array<string>"), tail), "\n")


def iso_date(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def month_key(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM")


def age_days(ms: Column, now_ms: int) -> Column:
    return F.floor((F.lit(now_ms) - ms) / DAY_MS)


def tokens_by_length(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def tokens_estimate(text: Column) -> Column:
    """The greater of a quarter of the characters and 1.3 times the words."""
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.greatest(tokens_by_length(text), F.ceil(words * F.lit(1.3)))


def token_cost(model: Column, tokens: Column, cached: Column, rate: Column) -> Column:
    """Dollars for tokens at rate per million, cached ones with the model's discount."""
    discount = F.lit(0.0)
    for start, part in CACHED_DISCOUNT.items():
        discount = F.when(model.startswith(start), part).otherwise(discount)
    return (tokens - cached) / 1e6 * rate + cached / 1e6 * rate * (1 - discount)


def usage_band(percent: Column) -> Column:
    out = F.when(percent < BANDS[0][0], BANDS[0][1])
    for limit, name in BANDS[1:]:
        out = out.when(percent < limit, name)
    return out.otherwise("critical")


def cache_priority(frequency: Column, hours: Column, days: Column) -> Column:
    return 0.5 * frequency + 0.4 / (hours + 1) + 0.1 / (days + 1)


def active_alternative(content: Column, alternatives: Column, index: Column) -> Column:
    """Index 0 is the content, i the i-th alternative; the content where there is none."""
    return F.coalesce(F.when(index > 0, F.get(alternatives, index - 1)), content)


def first_number(*values: Column) -> Column:
    """The first that is neither null nor 0, else 0."""
    return F.coalesce(*(F.nullif(v, F.lit(0).cast("long")) for v in values), F.lit(0).cast("long"))


def tool_parts(name: Column) -> list[Column]:
    """Agent and mode, parted at the last underscore; without one the mode is unknown."""
    parted = name.contains("_")
    return [F.when(parted, F.regexp_extract(name, "^(.*)_([^_]*)$", 1)).otherwise(name).alias("agent"), F.when(parted, F.regexp_extract(name, "^(.*)_([^_]*)$", 2)).otherwise("unknown").alias("mode")]


def sanitized(text: Column, most: int = 50_000) -> Column:
    """Without control characters but tab and line ends, at most ``most`` characters, trimmed."""
    return F.trim(F.left(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), F.lit(most)))


def json_array(text: Column) -> Column:
    """The items of a text that is a JSON array, as texts; null for any other, one that only looks like an array too."""
    trimmed = F.trim(text)
    return F.when(trimmed.startswith("[") & trimmed.endswith("]"), F.from_json(trimmed, "array<string>"))
