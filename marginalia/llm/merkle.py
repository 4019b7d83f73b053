"""Merkle manifest of a dataset: a digest of each document, a tree over each source, a tree over the sources.

A node's digest is the lower-case hex SHA-256 of its preimage. A leaf's preimage holds doc_id, source, lang, n_chars and text, each as its
UTF-8 byte count, ``:`` and value, or ``-`` where it is null. In a tree every ``ARITY`` consecutive nodes (the last run: fewer) have the concatenated
hex digests as their parent's preimage, level by level, until one node remains; a lone node is its tree's root itself. Leaves of a source ascend by
doc_id (nulls first, equal ids by digest), sources by their bytes (null first).

Levels are built with windows: rows are partitioned by tree and parent index, and a collect_list over the whole ordered frame gives the run, which is
the parent's preimage and holds each node's siblings. One row of each run stays and is the next level's node. So no window holds more than a
run, whatever the size of a source: positions come from a range partitioning that a hot source spans many partitions of, plus the rows before
each partition. Proofs then go down from the root, one join a level with a run as its row, so all levels together cost half as much as the lowest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.tables import scratch, take_columns, written

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Digests of the siblings on either side, one struct a level from the leaf up.
PROOF = "array<struct<before: binary, after: binary>>"


def leaf_digest(**instead: Column) -> Column:
    """The digest of a document with these columns; instead: other columns for some of the fields."""

    def held(name: str) -> Column:
        value = instead.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(held, FIELDS)), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def folded_root(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest (hex) and the siblings of its proof lead to."""
    return F.aggregate(proof, digest, lambda acc, level: F.sha2(F.concat(_hex(level["before"]), acc, _hex(level["after"])), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of the siblings' hex digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda level: F.concat(_hex(level["before"]), _hex(level["after"]))), ""), 256)


def _numbered(nodes: DataFrame) -> DataFrame:
    """nodes (tree, key, digest, more) with their place i in the tree, from 0, and the tree's size n."""
    own = nodes.repartitionByRange("tree", "key", "digest").sortWithinPartitions("tree", "key", "digest")
    own = written(own.withColumn("at", F.monotonically_increasing_id()), "ordered")  # its upper bits are the partition, the lower ones the place there
    part = F.shiftright("at", 33)
    runs = own.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n"))
    return own.withColumn("part", part).join(runs, ["tree", "part"]).withColumn("i", F.col("at") + F.col("shift")).drop("at", "part", "shift", "key")


def _raised(nodes: DataFrame, label: str) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """nodes (tree, i, n, digest, more) to: leaves that are trees themselves, levels of runs (tree, p, run) from the leaves up, roots (tree, height, digest). Runs of the lowest level carry more."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    lone, levels = nodes.where("n = 1"), []
    roots = lone.select("tree", F.lit(0).alias("height"), "digest")
    while most > 1:
        parent = F.floor(F.col("i") / ARITY)
        frame = Window.partitionBy("tree", "p").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        member = F.struct(*(c for c in nodes.columns if c not in ("tree", "i", "n")))
        runs = nodes.where("n > 1").withColumn("p", parent).withColumn("run", F.collect_list(member).over(frame)).where(F.col("i") % ARITY == 0)
        preimage = F.array_join(F.transform("run", lambda m: _hex(m["digest"])), "")
        level = written(runs.select("tree", "p", F.ceil(F.col("n") / ARITY).alias("n"), "run", F.unhex(F.sha2(preimage, 256)).alias("digest")), f"{label}-level")
        levels.append(level.select("tree", "p", "run"))
        roots = roots.union(level.where("n = 1").select("tree", F.lit(len(levels)), "digest"))
        nodes, most = level.select("tree", F.col("p").alias("i"), "n", "digest"), -(-most // ARITY)
    return lone, levels, roots


def _proven(lone: DataFrame, levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """The leaves' digest and what they carry, with the columns of roots (tree, height, proof, more): the proof is extended level by level from what lies above the root down to the leaf."""
    more = [c for c in roots.columns if c not in ("tree", "height", "proof")]
    carried = [c for c in lone.columns if c not in ("tree", "i", "n")]
    out = lone.join(roots.where("height = 0").drop("height"), "tree").select(*carried, "proof", *more)
    above = None
    for k in range(len(levels) - 1, -1, -1):
        tops = roots.where(F.col("height") == k + 1).select("tree", F.lit(0).cast("long").alias("p"), "proof", *more)
        above = tops if above is None else above.unionByName(tops)
        digests = F.transform("run", lambda m: F.hex(m["digest"]))
        held = levels[k].withColumn("all", digests).join(above, ["tree", "p"]).select("tree", "p", "all", "proof", *more, F.posexplode("run").alias("at", "member"))
        side = lambda start, length: F.unhex(F.array_join(F.slice("all", start, length), ""))
        step = F.struct(side(F.lit(1), F.col("at")).alias("before"), side(F.col("at") + 2, F.lit(ARITY)).alias("after"))
        above = held.select("tree", (F.col("p") * ARITY + F.col("at")).alias("p"), "member", F.concat(F.array(step), "proof").alias("proof"), *more)
        if k:
            above = above.drop("member")
    return out if above is None else out.unionByName(above.select("member.*", "proof", *more))


def manifest(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot (of its source), root (hex), proof (see PROOF), claimed. Written already.

    claimed: a column over docs, the digest of a copy that is to be held against the manifest, null where it is the leaf itself.
    Repeated rows are leaves of their own. An empty table gives no rows, and no root.
    """
    with scratch(docs.sparkSession):
        # The tree of a row: "" for the null source, which is first, else "=" and the source.
        own = take_columns(docs, *FIELDS)
        leaf = leaf_digest()
        claim = F.lit(None).cast("string") if claimed is None else F.nullif(claimed, leaf)
        tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
        # Written first: what deals rows to ranges looks at them twice, and texts should be hashed once.
        leaves = written(own.select(tree.alias("tree"), F.col("doc_id").alias("key"), "doc_id", F.unhex(leaf).alias("digest"), F.unhex(claim).alias("claim")), "leaves")
        lone, levels, roots = _raised(_numbered(leaves), "source")
        tops = roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest", F.col("tree").alias("of"), "height")
        top_lone, top_levels, top_roots = _raised(_numbered(tops), "top")
        start = top_roots.select("tree", "height", F.expr(f"cast(array() as {PROOF})").alias("proof"), F.col("digest").alias("root"))
        above = _proven(top_lone, top_levels, start).select(F.col("of").alias("tree"), "height", "proof", F.col("digest").alias("subroot"), "root")
        found = _proven(lone, levels, written(above, "subroots"))
        leaf_hex = _hex(F.col("digest"))
        return written(found.select("doc_id", leaf_hex.alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), "proof", F.coalesce(_hex(F.col("claim")), leaf_hex).alias("claimed")), "manifest", keep=True)


def audit(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """manifest() with proof_sha256, folded_root (from what is claimed and the proof) and verified (it is the root)."""
    folded = folded_root(F.col("claimed"), F.col("proof"))
    return manifest(docs, claimed).withColumn("proof_sha256", proof_digest(F.col("proof"))).withColumn("folded_root", folded).withColumn("verified", F.col("folded_root") == F.col("root"))
