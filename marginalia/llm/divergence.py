r"""Source divergence audit: how far the term frequencies of each source of a language are from its other sources', and from the language's.

Terms are ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` with A-Z lower-cased. A language keeps the terms that at least ``MIN_DOCS`` of its documents hold.
With ``count`` occurrences of V kept terms that sum to N, a term's p is 1 + floor(``UNIT`` * (count + 5) / (N + 5 V)), in exact integers.

Counting is a pass over the texts whose tasks add up before anything is shuffled. Then each kept term is one wide row: an array of counts
indexed by the language's sources, and an array of p beside it. The contribution of a term to every pair of sources comes from these arrays
by higher-order functions, and is summed on the side that makes it before the shuffle, so no group of a language, source or term is gathered.
The few figures of a language's sources meet its terms under a salt, so a language of a third of all terms is no single task's work.

Null text, lang and source are empty strings. A source without terms has every p of count 0; a language that keeps no term has pairs of value 0 and
no terms; a language of one source has no pairs. A row counts as a document, repeated or not. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.tables import scratch, take_columns, tidy, utf8, written

MIN_DOCS, UNIT, TOP = 30, 1_000_000_000, 50
SALTS = 64
#: Distinct terms that a task holds before it hands on what it has counted, and bytes of a text that are cut into terms at a time.
HELD, CHUNK = 100_000, 1 << 20
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time: bytes beyond ASCII never are separators, so characters stay whole."""
    data = utf8(text).translate(LETTERS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n occurrences, docs that hold it), partly summed; each group also has a row of the empty term, with zeros."""

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            found = list(n)
            columns = [pa.array([lang], pa.string()).take(pa.array([0] * (len(found) + 1), pa.int32())), pa.array([source], pa.string()).take(pa.array([0] * (len(found) + 1), pa.int32())), pa.array([b"", *found], pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in found)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=COUNTED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(lambda: (Counter(), Counter()))
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, docs = held[lang or "", source or ""]
                own: set[bytes] = set()
                for some in terms(text):
                    n.update(some)
                    own.update(some)
                docs.update(own)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from rows(held)
                held.clear()
        yield from rows(held)

    cast = [F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")]
    return take_columns(docs, "lang", "source", "text").select(*cast).mapInArrow(tidy(count), "lang string, source string, term string, n long, docs long")


def _p(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(UNIT * (count + 5) / (n + 5 v)), in decimals that hold any product of a long."""
    wide = lambda x, digits: x.cast(f"decimal({digits},0)")
    return F.call_function("div", wide(F.lit(UNIT), 10) * wide(count + 5, 20), wide(n + 5 * v, 20)) + 1


def vectors(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Kept terms as wide rows (lang, term, counts, p, q, sources), and (lang, sources, v) of each language; an empty term of zeros stands for the language itself."""
    totals = counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = totals.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by"))
    kept = written(by_term.where((F.col("term") == "") | (F.col("docs") >= min_docs)), "kept-terms")
    sizes = kept.select("lang", F.explode("by").alias("s")).groupBy("lang", "s.source").agg(F.sum("s.n").alias("n"))
    sizes = sizes.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources"), F.sum("n").alias("total"))
    langs = written(sizes.join(kept.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("v")), "lang"), "languages")
    salted = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    rows = rows.withColumn("by", F.map_from_entries("by"))
    rows = rows.withColumn("counts", F.transform("sources", lambda s: F.coalesce(F.try_element_at("by", s["source"]), F.lit(0).cast("long"))))
    zero = F.lit(0).cast("long")
    p = F.zip_with("counts", "sources", lambda c, s: F.when(F.col("term") == "", zero).otherwise(_p(c, s["n"], F.col("v"))))
    q = F.when(F.col("term") != "", _p(F.aggregate("counts", zero, lambda a, c: a + c), F.col("total"), F.col("v")))
    return written(rows.select("lang", "term", "counts", p.alias("p"), q.alias("q"), "sources"), "term-vectors"), langs


def pairs(wide: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value) both ways for each two sources of a language."""
    one = wide.select("lang", "p", F.posexplode("p").alias("i", "mine"))
    gaps = F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda theirs: F.abs(F.col("mine") - theirs))
    summed = one.select("lang", "i", F.posexplode(gaps).alias("k", "gap")).groupBy("lang", "i", (F.col("i") + F.col("k") + 1).alias("j")).agg(F.sum("gap").alias("value"))
    named = langs.select("lang", F.posexplode("sources").alias("at", "s")).select("lang", "at", "s.source")
    first, second = (named.select("lang", F.col("at").alias(at), F.col("source").alias(name)) for at, name in (("i", "a"), ("j", "b")))
    both = summed.join(first, ["lang", "i"]).join(second, ["lang", "j"])
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return both.select("lang", ways.alias("w"), "value").select("lang", "w.source", "w.item", "value")


def overused(wide: DataFrame) -> DataFrame:
    """(lang, source, item, value): kept terms that occur in a source and have a greater p there than in the language."""
    cells = F.arrays_zip(F.col("sources")["source"].alias("source"), F.col("counts").alias("n"), F.col("p").alias("p"))
    found = F.filter(cells, lambda c: (c["n"] > 0) & (c["p"] > F.col("q")))
    return wide.select("lang", "term", "q", F.explode(found).alias("c")).select("lang", "c.source", F.col("term").alias("item"), (F.col("c.p") - F.col("q")).alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part pair with all other sources, part term with the ``top`` most overused terms. Written already."""
    with scratch(docs.sparkSession):
        wide, langs = vectors(docs, min_docs)
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
        parts = [
            pairs(wide, langs).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank),
            overused(wide).select("lang", "source", F.lit("term").alias("part"), "item", "value", rank).where(F.col("rank") <= top),
        ]
        return written(parts[0].unionByName(parts[1]), "divergence", keep=True)
