r"""Substring deduplication by hashed lines: a unit that stood earlier, in any document, is removed; offsets are kept.

Units are lines (``unit``; or ``paragraph``, with blank lines between). A unit is normalised (lower case, one space for any white
space, no punctuation at its ends) and hashed to 128 bits. A unit of fewer than ``min_words`` words is hashed as a chain,
together with as many units before it as it takes to have ``min_words`` words; so short lines that anyone writes stay, but go with a
passage that repeats, however short its lines are. A passage that was set into the middle of a line is no line of its own:
lines are therefore cut further (``inner``), where ``.``, ``!`` or ``?`` is followed by white space, and these sentences are hashed in
chains of ``inner_words`` words. The span of a chain begins at its first unit, so the first units of a passage go too.

Of equal digests the one of smallest (doc_id, start) stays, whole; everywhere else its span is a copy. Chains overlap, so a copy may reach into
a chain that has its first place there: what is removed is the union of a document's copies without the spans of repeated digests that are first in
it. Spans begin and end with units, so whole units go, and every digest is left where it stood first. Digests are counted with a
partial sum before the shuffle, and only those seen twice meet the units again in a join that Spark can split, so a line
of a third of the corpus is no single task's work. Spans are code points of the original text, ends exclusive.

A null text gives a null text without spans; a null doc_id takes no part; rows of equal doc_id are one document, whose
equal units at equal places aren't copies of each other. An empty table gives none.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.tables import take_columns, tidy

UNITS = {
    "paragraph": re.compile(r"(?:[^\n]|\n(?![ \t]*\n))+"),
    "line": re.compile(r"[^\n]+"),
    "sentence": re.compile(r"[^\n.!?]*+(?:[.!?]++(?![ \t\n]|\Z)[^\n.!?]*+)*+(?:[.!?]++|(?=\n|\Z))"),
}
EDGES = " \t\r\x0b\x0c.,;:!?\"'()[]{}«»“”…-*#|"


def units(text: str | None, unit: str, min_words: int) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of each unit or chain that can be a copy, by end; white space at its ends isn't part of it. Digests of unlike kinds of units never meet."""
    out = []
    chain: deque[tuple[int, list[str]]] = deque()  # the last units, as few as have min_words words
    held = 0
    for m in UNITS[unit].finditer(text or ""):
        words = m[0].lower().strip(EDGES).split()
        if not words:
            continue
        start, end = m.end() - len(m[0].lstrip()), m.start() + len(m[0].rstrip())
        chain.append((start, words))
        held += len(words)
        while held - len(chain[0][1]) >= min_words:
            held -= len(chain.popleft()[1])
        if held >= min_words:
            out.append((chain[0][0], end, xxhash.xxh3_128_digest(" \n ".join([unit, *(" ".join(w) for _, w in chain)]))))
    return out


def union(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that overlap made one."""
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def without(spans: list[tuple[int, int]], kept: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of sorted spans apart from each other without other such ones."""
    out, k = [], 0
    for start, end in spans:
        while k < len(kept) and kept[k][1] <= start:
            k += 1
        at = k
        while at < len(kept) and kept[at][0] < end:
            if start < kept[at][0]:
                out.append((start, kept[at][0]))
            start = max(start, kept[at][1])
            at += 1
        if start < end:
            out.append((start, end))
    return out


def repeated_units(docs: DataFrame, unit: str = "line", min_words: int = 15, inner: str | None = "sentence", inner_words: int = 25) -> DataFrame:
    """(doc_id, copies, firsts): of each document the spans of digests that stood earlier, and of repeated ones that stand first in it, as sorted structs (start, end); documents without copies are absent."""
    cuts = [(unit, min_words), *([(inner, inner_words)] if inner else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends, digests = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for start, end, digest in (u for own in cuts for u in units(text, *own)):
                    ids.append(doc), starts.append(start), ends.append(end), digests.append(digest)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "start", "end", "digest"])

    # Cut twice rather than written once: the units take about as much room as the texts.
    found = take_columns(docs, "doc_id", "text").where("doc_id is not null").mapInArrow(tidy(cut), "doc_id long, start int, end int, digest binary")
    place = F.struct("doc_id", "start")
    twice = found.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("_digest"), "first")
    twice = twice.repartition("_digest")  # a plain exchange below the join, so that Spark can split the other side
    placed = found.repartition("digest").join(twice, F.col("digest") == F.col("_digest")).withColumn("copy", place > F.col("first"))
    span = F.struct("start", "end")
    spans = placed.groupBy("doc_id").agg(*(F.array_sort(F.collect_set(F.when(which, span))).alias(name) for name, which in (("copies", F.col("copy")), ("firsts", ~F.col("copy")))))
    return spans.where(F.size("copies") > 0)


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, text without the removed units, removed (spans of the original, sorted and apart), n_removed (their number), chars_removed. Options are those of repeated_units."""
    spans = repeated_units(docs, **options).select(F.col("doc_id").alias("_id"), "copies", "firsts")
    own = take_columns(docs, "doc_id", "text")
    joined = own.join(spans, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "copies", "firsts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone, removed = [], [], []
            for text, *both in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                copies, firsts = (union((s["start"], s["end"]) for s in spans or ()) for spans in both)
                # White space between a unit that goes and one that stays is no unit.
                own = [(a, b) for a, b in without(copies, firsts) if text[a:b].strip()] if text else []
                own = [(a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())) for a, b in own]
                if own:
                    parts, at, last = [], 0, ""
                    for start, end in own:
                        parts.append(text[at:start])
                        at, last = end, parts[-1][-1:] or last
                        # One of the two separators goes with the unit, and lines stay lines.
                        if text[at : at + 1] == "\n" and parts[-1][-1:].isspace() and last != "\n":
                            parts[-1] = parts[-1][:-1]
                        elif (not last or last.isspace()) and text[at : at + 1].isspace():
                            at += 1
                    text = "".join([*parts, text[at:]])
                texts.append(text), gone.append(sum(b - a for a, b in own)), removed.append([{"start": a, "end": b} for a, b in own])
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            columns = [batch.column(0).to_pylist(), texts, [len(x) for x in removed], gone, removed]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "text", "n_removed", "chars_removed", "removed"])

    return joined.mapInArrow(tidy(cut), "doc_id long, text string, n_removed long, chars_removed long, removed array<struct<start: int, end: int>>")
