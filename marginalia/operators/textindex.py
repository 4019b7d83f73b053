"""A kept full-text index with positions: phrases, NEAR, prefixes, all, any and none of some words, changed by adding and removing rows.

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lowered; ``stem`` keeps Porter's stems of ASCII words instead. Three bucketed tables
lie below one shared folder: ``postings`` (word, id, places, version born), ``words`` for prefixes, and ``gone`` (id, version died). An update writes one
segment of postings and, for what it replaces, a row in gone: a posting counts unless its id died later than it was born. Nothing is
rewritten until ``compact``. A search reads the buckets of its words alone. Postings of a word are dealt to ``PARTS`` parts by id, so that a word
that all rows have is no single task's, and every search groups by id or joins on it, never gathers a word.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.stem import stem, stem_lists
from marginalia.sources.buckets import Buckets

TOKEN = r"[a-z0-9\x{80}-\x{10FFFF}]+"
PARTS = 8
#: FTS's own default of words between those that are near.
NEAR = 10


def placed(rows: DataFrame) -> DataFrame:
    """(id, _words) to (id, word, places): a row for each distinct word of a list, with its places from 0. Lists are sorted and cut where they stand; no word is shuffled to meet its like."""
    sorted_ = F.sort_array(F.transform("_words", lambda word, place: F.struct(word.alias("word"), place.alias("place"))))
    runs = rows.select("id", sorted_.alias("_by"))
    starts = F.filter(F.transform("_by", lambda _, i: i), lambda i: (i == 0) | (F.get("_by", i)["word"] != F.get("_by", F.greatest(i - 1, F.lit(0)))["word"]))
    cut = runs.select("id", "_by", starts.alias("_starts"))
    each = F.transform("_starts", lambda start, k: F.struct(F.get("_by", start)["word"].alias("word"), F.slice("_by", start + 1, F.coalesce(F.get("_starts", k + 1), F.size("_by")) - start)["place"].alias("places")))
    return cut.select("id", F.inline(each))


def tokens(text: Column) -> Column:
    """The words of a text in order, repeated ones too."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(F.coalesce(low, F.lit("")), F.lit(TOKEN), F.lit(0))


class TextIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, stems: bool = False):
        self.spark, self.stems = spark, stems
        self.postings = Buckets(spark, f"{path}/postings", "word string, part int, id string, places array<int>, born int", ["word", "part"], buckets)
        self.words = Buckets(spark, f"{path}/words", "head string, word string", ["head"], buckets)
        self.gone = Buckets(spark, f"{path}/gone", "id string, died int", ["id"], buckets)

    def _version(self) -> int:
        return max([*self.postings.versions(), *self.gone.versions()], default=0)

    def update(self, rows: DataFrame | None = None, removed: DataFrame | None = None, version: int | None = None) -> int:
        """Adds rows (id, text), in place of what these ids had, and takes out the ids of removed (id). Returns the version that this made.

        version: the number to make, to do a batch again; else the one after the last. Rows of one id are one text after the other.
        """
        version = version or self._version() + 1
        parts = [df.select(F.col("id").cast("string").alias("id")) for df in (rows, removed) if df is not None]
        dead = reduce(DataFrame.unionByName, parts).where("id is not null").distinct()
        if self.postings.versions():
            self.gone.add(dead.select("id", F.lit(version).alias("died")), version)
        if rows is not None:
            own = rows.select(F.col("id").cast("string").alias("id"), tokens(F.col("text")).alias("_words")).where("id is not null")
            if self.stems:
                own = own.withColumn("_words", stem_lists("_words"))
            part = F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int").alias("part")
            self.postings.add(placed(own).select("word", part, "id", "places", F.lit(version).alias("born")), version)
            segment = self.postings.read(upto=version).where(F.col("version") == version)
            self.words.add(segment.select(F.left("word", F.lit(1)).alias("head"), "word").distinct(), version)
        return version

    def compact(self) -> int:
        """Makes each bucket one segment, without what has died."""
        version, last = self._version() + 1, self.gone.read().groupBy("id").agg(F.max("died").alias("died"))
        self.postings.compact(version, lambda rows: self._alive(rows, last).select("word", "part", "id", "places", "born", "version", "bucket"))
        self.words.compact(version, lambda rows: rows.dropDuplicates(["bucket", "head", "word"]))
        self.gone.compact(version, lambda rows: rows.groupBy("bucket", "id").agg(F.max("died").alias("died")))
        return version

    def _live(self, rows: DataFrame) -> DataFrame:
        """Live postings, one for each word and id: rows of one id in one update have a posting each."""
        alive = self._alive(rows, self.gone.read().groupBy("id").agg(F.max("died").alias("died")))
        return alive.groupBy("word", "id").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))

    @staticmethod
    def _alive(rows: DataFrame, last: DataFrame) -> DataFrame:
        return rows.join(last, "id", "left").where("died is null or died <= born").drop("died")

    def _term(self, word: str) -> str:
        low = word.translate({c: c + 32 for c in range(65, 91)})
        return stem(low) if self.stems else low

    def held(self, words: Sequence[str]) -> DataFrame:
        """Live postings (word, id, places) of these words, from their buckets alone."""
        wanted = sorted({self._term(w) for w in words})
        keys = self.spark.createDataFrame([(w, p) for w in wanted for p in range(PARTS)], "word string, part int")
        rows = self.postings.lookup(keys).where(F.col("word").isin(wanted))
        return self._live(rows)

    def _by_id(self, words: Sequence[str]) -> tuple[DataFrame, list[str]]:
        """Ids that hold all of the words, with a column of places for each: one shuffle by id."""
        terms = [self._term(w) for w in words]
        columns = {w: f"_{i}" for i, w in enumerate(dict.fromkeys(terms))}
        rows = self.held(words).groupBy("id").agg(*(F.max(F.when(F.col("word") == w, F.col("places"))).alias(c) for w, c in columns.items()))
        return rows.where(" and ".join(f"{c} is not null" for c in columns.values())), [columns[w] for w in terms]

    def all_of(self, *words: str) -> DataFrame:
        return self._by_id(words)[0].select("id")

    def any_of(self, *words: str) -> DataFrame:
        """(id, matched): how many of the words it holds."""
        return self.held(words).groupBy("id").agg(F.count(F.lit(1)).alias("matched"))

    def without(self, ids: DataFrame, *words: str) -> DataFrame:
        """The ids that hold none of the words."""
        return ids.join(self.held(words).select("id"), "id", "left_anti")

    def phrase(self, *words: str) -> DataFrame:
        """(id, starts): where the words follow each other. Each word's places, moved back by its rank, must meet."""
        rows, columns = self._by_id(words)
        moved: list[Column] = [F.transform(c, _minus(k)) for k, c in enumerate(columns)]
        return rows.select("id", reduce(F.array_intersect, moved).alias("starts")).where("size(starts) > 0")

    def near(self, *words: str, between: int = NEAR) -> DataFrame:
        """(id, places): of the last word, where each word has the one before it at most ``between`` words away, in any order; two equal words need two places."""
        rows, columns = self._by_id(words)
        kept = F.col(columns[0])
        for mine, theirs in zip(columns[1:], columns, strict=False):
            around = F.flatten(F.transform(kept, _around(between + 1, mine == theirs)))
            kept = F.array_intersect(F.col(mine), around)
        return rows.select("id", kept.alias("places")).where("size(places) > 0")

    def prefix(self, start: str) -> DataFrame:
        """(word, id, places) of all words that begin so: a range of the word table, then the buckets of what it finds. stems: of stems that begin so."""
        low = start.translate({c: c + 32 for c in range(65, 91)})
        heads = self.spark.createDataFrame([(low[:1],)], "head string")
        found = self.words.lookup(heads).where(F.col("word").startswith(low)).select("word").distinct()
        keys = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        rows = self.postings.lookup(keys).where(F.col("word").startswith(low))
        return self._live(rows)


def _minus(k: int) -> Callable[[Column], Column]:
    return lambda place: place - F.lit(k)


def _around(width: int, apart: bool) -> Callable[[Column], Column]:
    """The places at most width away; apart: but for the place itself."""
    if apart:
        return lambda place: F.concat(F.sequence(place - width, place - 1), F.sequence(place + 1, place + width))
    return lambda place: F.sequence(place - width, place + width)
