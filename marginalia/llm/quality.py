r"""Quality rules, line first: each line is judged alone, failing lines go, and a document that loses too much text is rejected.

Line rules, in order; the first that holds names the reason:

* ``symbols``      a third of the words or more in ``[#*$%&|<>]`` characters: tables, menus with separators, markup
* ``shouting``     at least four words, with capitals and without a single small letter
* ``boilerplate``  a line of at most ``SHORT_LINE`` words holds one of ``BOILERPLATE``, or a fifth of a longer line's words stand in them
* ``navigation``   no closing punctuation and fewer than ``min_open_words`` words
* ``repeat``       equal to an earlier line of the document

Words are ``[^\x20\x09-\x0D]+``; a line without a word has no verdict and stays. Null text counts as empty.
A document is kept if it passes the base limits (at least 50 words, at most half of them in repeated 3-word windows)
and at most ``max_loss`` percent of its words stand in failing lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm.tables import take_columns, tidy, utf8

SYMBOLS = b"#*$%&|<>"
CLOSING = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", "…".encode(), "”".encode(), "»".encode(), "。".encode())
BOILERPLATE = (
    b"enable javascript", b"cookie policy", b"cookies to", b"privacy policy", b"terms of use", b"terms of service",
    b"all rights reserved", b"lorem ipsum", b"click here", b"sign up for our newsletter", b"share this",
)
SHORT_LINE, BOILERPLATE_SHARE = 30, 5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lost_words long, n_symbol_lines long, n_shout_lines long, n_boilerplate_lines long, n_nav_lines long, base_failed boolean, kept boolean"
)


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a 3-word window that occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 2_000_000:  # three ids would not fit one integer
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * len(seen) + ids[2:]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(keys, twice))
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def judge_line(line: bytes, n_words: int, min_open_words: int) -> str | None:
    if 3 * sum(line.count(c) for c in SYMBOLS) >= n_words:
        return "symbols"
    if n_words >= 4:
        text = line.decode()
        if text.upper() == text != text.lower():
            return "shouting"
    low = line.lower()
    found = sum(low.count(x) * len(x.split()) for x in BOILERPLATE)
    if found and (n_words <= SHORT_LINE or BOILERPLATE_SHARE * found >= n_words):
        return "boilerplate"
    if n_words < min_open_words and not line.rstrip().endswith(CLOSING):
        return "navigation"
    return None


def clean(text: str | None, max_loss: int = 50, min_open_words: int = 8) -> tuple[tuple, str]:
    """The figures and verdict of one document, and its text without failing lines."""
    data = utf8(text)
    words = data.split()
    n = len(words)
    seen: set[bytes] = set()
    lost = dup = 0
    why = {"symbols": 0, "shouting": 0, "boilerplate": 0, "navigation": 0}
    stay = []
    for line in data.split(b"\n"):
        k = len(line.split())
        reason = None
        if k:
            reason = judge_line(line, k, min_open_words)
            if reason:
                why[reason] += 1
            if line in seen:
                dup += 1
                reason = "repeat"
            seen.add(line)
        if reason:
            lost += k
        else:
            stay.append(line)
    repeat = repeated_words(words)
    chars = len(text or "") - sum(data.count(c) for c in b" \t\n\r\x0b\x0c")
    symbols = sum(data.count(c) for c in SYMBOLS)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    kept = not failed and 100 * lost <= max_loss * n
    return (n, chars, symbols, dup, repeat, lost, *why.values(), failed, kept), b"\n".join(stay).decode()


def quality(docs: DataFrame, max_loss: int = 50, min_open_words: int = 8, with_text: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): figures, ``base_failed``, ``kept``; with_text adds ``clean_text``.

    One pass without a shuffle. Repeated rows are judged alike; a null doc_id stays null; an empty table gives none.
    """
    schema = SCHEMA + (", clean_text string" if with_text else "")
    arrow = pa.schema([("doc_id", pa.int64()), *((c.split()[0], pa.bool_() if c.endswith("boolean") else pa.string() if c.endswith("string") else pa.int64()) for c in schema.split(", ")[1:])])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [clean(t, max_loss, min_open_words) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0).cast(pa.int64()), *([r[0][i] for r in rows] for i in range(len(arrow) - 1 - with_text))]
            if with_text:
                columns.append([r[1] for r in rows])
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return take_columns(docs, "doc_id", "text").mapInArrow(tidy(judge), schema)


def keep_good(docs: DataFrame, max_loss: int = 50, min_open_words: int = 8) -> DataFrame:
    """The rows of docs that are kept, failing lines removed from text; n_chars, where there is one, follows. All columns stay.

    Done in place, so repeated rows and null ids need no join.
    """
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [clean(t, max_loss, min_open_words) for t in batch.column(at).to_pylist()]
            stay = [i for i, (figures, _) in enumerate(rows) if figures[-1]]
            texts = [rows[i][1] for i in stay]
            out = batch.take(pa.array(stay, pa.int64()))
            columns = list(out.columns)
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in out.schema.names:
                k = out.schema.names.index("n_chars")
                columns[k] = pa.array([len(t) for t in texts], pa.int64()).cast(out.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=out.schema.names)

    return docs.mapInArrow(tidy(sift), schema)
