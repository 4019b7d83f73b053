"""Search scores, snippets, highlights and query parsing as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def query_words(query: str) -> list[str]:
    """Words of three letters or more."""
    return [w for w in query.lower().split() if len(w) > 2]


def keyword_score(text: Column, query: str, lowered: bool = False) -> Column:
    """0.9 for the phrase, else by the share of its words, 0.3 at least; null without a match. lowered: text has small letters already, so that it is lowered once and not once a word."""
    low, phrase, words = text if lowered else F.lower(text), query.lower().strip(), query_words(query)
    if not phrase:
        return F.lit(None).cast("double")
    n = reduce(lambda a, b: a + b, (F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    by_words = F.when(n > 0, F.greatest(F.lit(0.3), F.lit(0.8) * n / len(words))) if words else F.lit(None).cast("double")
    return F.when(F.contains(low, F.lit(phrase)), 0.9).otherwise(by_words)


def fuzzy_score(name: Column, query: str) -> Column:
    """1 for the query itself, 0.01 less for each letter more; null unless the query's letters stand in the name in order."""
    wanted = query.lower()
    pattern = "%" + "%".join("\\" + c if c in "%_\\" else c for c in wanted) + "%"
    extra = (F.length(name) - len(wanted)) / 100.0
    return F.when(F.lower(name).like(pattern), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - extra)))


def best(*scores: tuple[float, Column]) -> Column:
    """The greatest weighted score, null if all are."""
    return F.greatest(*(w * s for w, s in scores)) if len(scores) > 1 else scores[0][0] * scores[0][1]


def combined(keyword: Column, fuzzy: Column) -> Column:
    """Both: 0.6 and 0.4 of them; else the one there is."""
    return F.coalesce(F.lit(0.6) * keyword + F.lit(0.4) * fuzzy, keyword, fuzzy)


def found_at(text: Column, query: str) -> Column:
    """Place (from 1) of the phrase or else of its first word that occurs; 0 if none does."""
    low = F.lower(text)
    places = [F.nullif(F.instr(low, q), F.lit(0)) for q in [query.lower().strip(), *query_words(query)] if q]
    return F.coalesce(*places, F.lit(0))


def snippet(text: Column, at: Column, width: int, half: int = 75) -> Column:
    """half characters on both sides of a hit of ``width`` at ``at`` (from 1), dots where text is left out; the start if there is no hit."""
    start = F.when(at > 0, F.greatest(F.lit(0), at - 1 - half)).otherwise(0)
    end = F.when(at > 0, F.least(F.length(text), at - 1 + width + half)).otherwise(F.least(F.length(text), F.lit(2 * half)))
    body = F.trim(F.substring(text, start + 1, end - start))
    return F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(end < F.length(text), "...").otherwise(""))


def highlight(text: Column, query: str, around: int = 50, otherwise: int = 200) -> Column:
    """The hit with what stands around it, else the first characters."""
    at = F.instr(F.lower(text), query.lower())
    start = F.greatest(F.lit(0), at - 1 - around)
    return F.when(at > 0, F.substring(text, start + 1, F.least(F.length(text), at - 1 + len(query) + around) - start)).otherwise(F.left(text, F.lit(otherwise)))


def highlights(text: Column, query: str, most: int = 3, around: int = 20) -> Column:
    """Up to ``most`` hits, which may overlap, each with its surroundings. One search a hit, not one a character."""
    low, word = F.lower(text), F.lit(query.lower())
    places, last = [], F.lit(0)
    for _ in range(most):
        last = F.when(last.isNotNull(), F.nullif(F.position(word, low, last + 1), F.lit(0)))
        places.append(last)
    return F.transform(F.array_compact(F.array(*places)), lambda at: F.substring(text, F.greatest(F.lit(1), at - around), F.least(at + len(query) + around, F.length(text) + 1) - F.greatest(F.lit(1), at - around)))


def path_rank(path: Column, query: str) -> Column:
    """1 for the path itself, 0.8 for a prefix, else less the later it occurs; null if it doesn't."""
    low, q = F.lower(path), query.lower()
    at = F.instr(low, q)
    return F.when(low == q, 1.0).when(at == 1, 0.8).when(at > 0, F.greatest(F.lit(0.1), F.lit(0.5) - (at - 1) / F.length(path)))


def parsed_query(query: Column) -> list[Column]:
    """Tags (#tag), properties (key:value), quoted phrases, and the text that is left."""
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(query, r'"[^"]*"', " "), r"#[A-Za-z0-9_/-]+", " "), r"[A-Za-z0-9_]+:[^\s]+", " ")
    return [
        F.regexp_extract_all(query, F.lit(r"#([A-Za-z0-9_/-]+)"), F.lit(1)).alias("tags"), F.regexp_extract_all(query, F.lit(r"([A-Za-z0-9_]+:[^\s]+)"), F.lit(1)).alias("properties"),
        F.regexp_extract_all(query, F.lit(r'"([^"]*)"'), F.lit(1)).alias("phrases"), F.trim(F.regexp_replace(rest, r"\s+", " ")).alias("clean"),
    ]


def bold(text: Column, query: str) -> Column:
    return F.regexp_replace(text, rf"(?i)(\Q{query}\E)", "**$1**")


def terms(text: Column) -> Column:
    """Distinct index terms: small letters, marks as space, three characters or more."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_\s]", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))
