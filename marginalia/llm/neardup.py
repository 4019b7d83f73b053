r"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning, exact verification, connected components.

A document is the set of its distinct ``words``-word shingles; words are ``[^\x20\x09-\x0D]+`` with A-Z lower-cased, a text with
fewer words is one shingle, a text without words has an empty set and links with nothing. Documents link when
``intersection / union >= percent / 100``.

1. Documents with equal sets collapse to the one of smallest id, so exact copies cost nothing later.
2. ``BANDS`` bands of ``ROWS`` MinHash values, of which 16 bits are kept, make buckets. A pair at similarity 0.8 shares no bucket with a chance of 6e-7.
3. In each bucket the smallest member is paired with every other: a star, linear in the bucket.
4. Signatures are compared ``STEP`` values at a time; a pair is dropped as soon as the posterior chance (uniform prior) that
   its similarity reaches the threshold falls below ``MISS``. Survivors are verified on their full sets.
5. Links give components. In buckets whose members aren't all in one component yet, the other pairs across components are
   tried too: by a join where the bucket has at most ``SMALL`` members, else block against block inside tasks, where signatures pick
   the members that could link, and these are verified on full sets; only links that join two components come out. Within a component no further pair can matter, so a large
   group of copies never is expanded into pairs, nor is a large group of texts that are almost similar enough.

Rows with equal doc_id are one document with several sets. A null doc_id links with nothing. An empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.components import components
from marginalia.llm.tables import scratch, take_columns, tidy, utf8, written

BANDS, ROWS = 36, 5
HASHES = BANDS * ROWS
STEP, MISS = 20, 1e-6
SMALL, BLOCK, BLOCK_SHINGLES, SALTS = 24, 1000, 500_000, 16
#: So many ids at most are broadcast to pick texts; beyond it they are picked by a shuffled join.
BROADCAST_IDS = 1_000_000
#: Words whose hashes a task remembers before it starts anew.
CACHE_WORDS = 200_000

_rng = np.random.default_rng(20)
_MUL = (_rng.integers(1, 2**31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int, known: WordHashes) -> np.ndarray:
    """The set of a text as sorted 64-bit hashes."""
    parts = utf8(text).lower().split()  # bytes.lower() touches A-Z alone
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(parts))
    n = len(parts) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _mixed(out * np.uint64(0x100000001B3) + h[k : k + n])
    return np.unique(out)


def signature(members: np.ndarray) -> np.ndarray:
    """MinHash values (HASHES, uint32) of a non-empty set."""
    low = members.astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 512):  # a block stays in cache
        np.minimum(best, (low[k : k + 512, None] * _MUL + _ADD).min(axis=0), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key (int64) of each band of a stored signature: bands share a key where their stored rows agree, which ``_facing`` relies on."""
    rows = sig.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mixed(key * np.uint64(0x100000001B3) + rows[:, k])
    return key.view(np.int64)


def least_matches(percent: int = 80, miss: float = MISS) -> list[tuple[int, int]]:
    """(values compared, matches needed to go on): fewer make P(similarity >= percent) < miss under the posterior Beta(m + 1, n - m + 1)."""
    t = percent / 100

    def chance(n: int, m: int) -> float:  # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
        return sum(math.comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(m + 1))

    return [(n, next(m for m in range(n + 1) if chance(n, m) >= miss)) for n in range(STEP, HASHES + 1, STEP)]


def likely(a: np.ndarray, b: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Rows of two signature arrays that survive all steps."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    at = 0
    for n, least in needed:
        matches[alive] += (a[alive, at:n] == b[alive, at:n]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
        at = n
    return alive


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sig, bands); the last three null for empty sets."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sizes, digests, sigs, bands = [], [], [], []
            for text in batch.column(1).to_pylist():
                members = shingles(text, words, known)
                sizes.append(len(members))
                if not len(members):
                    digests.append(None), sigs.append(None), bands.append(None)
                    continue
                sig = signature(members).astype("<u2")
                digests.append(xxhash.xxh3_128_digest(members.tobytes()))
                sigs.append(sig.tobytes())
                bands.append(band_keys(sig))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "sig", "bands"],
            )

    return take_columns(docs, "doc_id", "text").mapInArrow(tidy(sketch), "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>")


def _surviving(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, sig_a, sig_b) to the pairs (a, b) that Bayesian comparison doesn't drop."""
    needed = least_matches(percent)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, HASHES) for c in (2, 3))
            stay = pa.array(likely(a, b, needed))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(stay), batch.column(1).take(stay)], names=["a", "b"])

    return pairs.mapInArrow(tidy(prune), "a long, b long")


def _picked(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose column is among the ids (one column), which are counted first: few are broadcast, many are joined by a shuffle."""
    ids = written(ids.toDF(column).distinct(), "picked")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, "left_semi")


def _sets(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(id, members) of the documents with these doc_ids: their full sets, sorted."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sets = [np.sort(shingles(t, words, known).view(np.int64)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "members"])

    return written(_picked(take_columns(docs, "doc_id", "text"), "doc_id", ids).select("doc_id", "text").mapInArrow(tidy(members), "id long, members array<long>"), "sets")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough; pairs is read several times."""
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), docs, words)
    left, right = (sets.withColumnsRenamed({"id": c, "members": f"set_{c}"}) for c in ("a", "b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    near = 100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)
    return written(pairs.join(left, "a").join(right, "b").where(near).select("a", "b").distinct(), "pair-links")


def _salted(rows: DataFrame, of_keys: DataFrame) -> DataFrame:
    """rows joined with a table of one row a key, in SALTS parts a key, so that a bucket of very many rows is no single task's work."""
    salt = F.pmod(F.xxhash64("rep"), F.lit(SALTS)).alias("_salt")
    return rows.select("*", salt).join(of_keys.select("*", F.explode(F.array(*(F.lit(k).cast("long") for k in range(SALTS)))).alias("_salt")), ["key", "_salt"]).drop("_salt")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of buckets of more than SMALL members, dealt to pairs of blocks (key, kind, i, j), with the side they stand on.

    rows: key, band, rep, comp, n_shingles, sig, main (the component of the bucket's smallest member). Members of the main
    component meet all others block by block, the others each other; two main members never meet. A block holds
    about BLOCK members and BLOCK_SHINGLES shingles at most.
    """
    in_main = F.col("comp") == F.col("main")
    counted = lambda c: F.ceil(F.greatest(F.count_if(c) / BLOCK, F.sum(F.when(c, F.col("n_shingles")).otherwise(0)) / BLOCK_SHINGLES))
    blocks = rows.groupBy("key").agg(counted(in_main).alias("mains"), counted(~in_main).alias("rests"))
    rows = _salted(rows, blocks).withColumn("in_main", in_main)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("rests"))))
    upto = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), f)
    spot = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    own = F.col("own")
    facing_rest = upto("rests", lambda x: spot(0, own, x, F.lit(0)))
    facing_main = upto("mains", lambda x: spot(0, x, own, F.lit(1)))
    facing_own = upto("rests", lambda x: spot(1, F.least(own, x), F.greatest(own, x), F.when(own == x, 2).when(own < x, 0).otherwise(1)))
    rows = rows.withColumn("at", F.explode(F.when(F.col("in_main"), facing_rest).otherwise(F.concat(facing_main, facing_own))))
    return rows.select("key", "at.kind", "at.i", "at.j", "at.side", "band", "rep", "comp", "n_shingles", "sig")


class Roots(dict):
    """Union-find over components."""

    def of(self, x: int) -> int:
        while self.get(x, x) != x:
            self[x] = self.get(self[x], self[x])
            x = self[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.of(x), self.of(y)
        if x != y:
            self[x] = y
        return x != y


def _facing(group: pa.Table, percent: int, needed: list[tuple[int, int]], roots: Roots) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows it likely is similar to) within a pair of blocks, across components as roots has them by then.

    A pair that shares several buckets is looked at in the first of its bands alone.
    """
    comp, size, side = (group.column(c).to_numpy() for c in ("comp", "n_shingles", "side"))
    band = group.column("band")[0].as_py()
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)
    alone = bool((side == 2).all())
    first, second = (np.arange(len(comp)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for at, i in enumerate(first):
        others = second[at + 1 :] if alone else second
        others = others[(comp[others] != comp[i]) & (100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i]))]
        if roots and len(others):
            own = roots.of(int(comp[i]))
            others = others[[roots.of(int(c)) != own for c in comp[others]]]
        if not len(others):
            continue
        others = others[likely(np.broadcast_to(sig[i], (len(others), HASHES)), sig[others], needed)]
        new = (sig[others] == sig[i]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
        if new.any():
            yield i, others[new]


def _settled(rows: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links across components that two blocks hold, verified on full sets inside the task; pairs aren't handed on.

    Sets are fetched for members of likely pairs alone. A task returns a link only where it joins two components.
    """
    needed = least_matches(percent)
    columns = "key long, kind int, i long, j long, side int, band int, rep long, comp long, n_shingles long, sig binary"

    def involved(group: pa.Table) -> pa.Table:
        stay = np.zeros(group.num_rows, bool)
        for i, others in _facing(group, percent, needed, Roots()):
            stay[i] = True
            stay[others] = True
        return group.filter(pa.array(stay))

    blocks = ["key", "kind", "i", "j"]
    open_rows = written(rows.groupBy(*blocks).applyInArrow(involved, columns), "open")
    sets = _sets(open_rows.select(F.col("rep").alias("doc_id")), docs, words).withColumnRenamed("id", "rep")

    def verify(group: pa.Table) -> pa.Table:
        rep, comp = group.column("rep").to_numpy(), group.column("comp").to_numpy()
        lists = group.column("members").combine_chunks()
        size = lists.value_lengths().to_numpy()
        members, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)])
        roots, links = Roots(), []
        for i, others in _facing(group, percent, needed, roots):
            own = members[ends[i] : ends[i + 1]]
            rows_of = np.repeat(np.arange(len(others)), size[others])
            theirs = members[np.concatenate([np.arange(ends[o], ends[o + 1]) for o in others])]
            both = np.bincount(rows_of[own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs], minlength=len(others))
            for o in others[100 * both >= percent * (size[i] + size[others] - both)]:
                if roots.join(int(comp[i]), int(comp[o])):
                    links.append((min(rep[i], rep[o]), max(rep[i], rep[o])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return written(open_rows.join(sets, "rep").select(*(c.split()[0] for c in columns.split(", ")), "members").groupBy(*blocks).applyInArrow(verify, "a long, b long").distinct(), "settled")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable), kept. Written already."""
    with scratch(docs.sparkSession):
        return written(_found(docs, words, percent), "near-duplicates", keep=True)


def _found(docs: DataFrame, words: int, percent: int) -> DataFrame:
    own = written(sketches(docs, words), "sketches")
    reps = own.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull()).groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
    )
    reps = written(reps, "classes")
    sigs = reps.select("rep", "n_shingles", "sig")
    buckets = reps.select(F.posexplode("bands").alias("band", "key"), "rep")
    shared = buckets.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # A plain exchange below each side, so that Spark can split a bucket of very many rows.
    shared = written(buckets.join(shared.repartition("key"), "key").select("key", "band", "rep", "leader", "n"), "buckets")

    def tried(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of classes, pruned by size and signature."""
        pairs = written(pairs, "pairs")
        some = _picked(sigs, "rep", pairs.select(F.explode(F.array("a", "b"))))
        left = some.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sig").alias("sig_a"))
        right = some.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sig").alias("sig_b"))
        compatible = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
        return _surviving(pairs.join(left, "a").join(right, "b").where(compatible).select("a", "b", "sig_a", "sig_b"), percent)

    stars = shared.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = _verified(written(tried(stars), "survivors"), docs, words, percent)
    labels = components(links)

    # Members of buckets of three or more with more than one component.
    comp = shared.where("n > 2").join(labels, F.col("rep") == F.col("node"), "left").select("key", "band", "rep", "leader", "n", F.coalesce("root", "rep").alias("comp"))
    spread = comp.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.when(F.col("rep") == F.col("leader"), F.col("comp"))).alias("main")).where("lo <> hi")
    rows = written(_salted(comp, spread.select("key", "main")), "mixed")
    small = rows.where((F.col("n") <= SMALL) & (F.col("rep") != F.col("leader"))).select("key", "rep", "comp")
    other = small.select("key", F.col("rep").alias("b"), F.col("comp").alias("comp_b"))
    pairs = small.withColumnRenamed("rep", "a").join(other, "key").where("a < b and comp <> comp_b").select("a", "b").distinct()
    more = _verified(written(tried(pairs), "survivors"), docs, words, percent)
    large = rows.where(F.col("n") > SMALL).drop("n", "leader")
    large = _dealt(large.join(_picked(sigs, "rep", large.select("rep")), "rep"))
    more = written(more.union(_settled(large, docs, words, percent)), "more-links")
    if not more.isEmpty():
        links = written(links.union(more).distinct(), "all-links")
        labels = components(links)

    classes = reps.select("digest", "rep").join(labels, F.col("rep") == F.col("node"), "left")
    classes = classes.select(F.col("digest").alias("_digest"), F.coalesce("root", "rep").alias("_component"))
    found = own.select("doc_id", "n_shingles", "digest").join(classes, F.col("digest") == F.col("_digest"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
