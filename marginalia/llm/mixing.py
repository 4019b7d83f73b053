r"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources, by code point with null last, weigh 1, 2, 3 and so on in turn and share the words of the whole table; a target
stops at ``max_repeats`` times its source's size and the excess is shared anew by weight. The targets are then cut into
blocks of ``block_words`` words. Blocks go to sources by highest quotients ``target / (2 * seats + 1)``, then each
source's blocks go to its shards the same way by shard size, so every shard has an integer quota. Within a shard the
documents stand in a seeded order, the words form a ring of equal blocks, and the quota takes whole turns of the ring
and a run of blocks from a seeded start. Only documents at the two ends of a run are cut.

Documents are dealt and ordered by digests of id and text. Shards hold about ``shard_docs`` documents, so no window sees more
than that of a hot source's rows; what is gathered in one place is a row per source, or two or three rows per shard of one
source. So sources may be as many as one task sorts, some ten million.

Rows equal in id and text share a shard: a shard of very many of them is one task's sort, which spills but doesn't hold them.
Null text counts as empty (size 0, nothing taken); repeated rows are mixed as rows of their own; an empty table gives
an empty result; a table without words has target 0 everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.tables import take_columns, unused_prefix, written

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of so many sources at most are broadcast; with more, documents meet their source by a shuffled join.
BROADCAST_SOURCES = 10_000


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def targets(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target). One row per source passes through one task."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    ranked = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    before = Window.orderBy(max_repeats * F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    rate_before = (total - max_repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    capped = ranked.withColumn("capped", rate_before * F.col("weight") > max_repeats * F.col("source_size"))
    left = F.sum(F.when(F.col("capped"), -max_repeats * F.col("source_size")).otherwise(0)).over(everything) + total
    free = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything)
    share = F.when(F.col("capped"), (max_repeats * F.col("source_size")).cast("double")).otherwise(left / free * F.col("weight"))
    return capped.select("source", "source_size", "weight", share.alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], key: list[str], weight: str, seats: str, cap: str) -> DataFrame:
    """Adds ``quota``: the seats of each group dealt to its parties by highest quotients weight / (2 * held + 1), at most cap each.

    The common divisor lies between W / (N + n / 2) and W / (N - n / 2) for n parties, weight W and N seats, so only
    quotients of seats in that range are ranked, two or three a party; all below are surely won.
    """
    own = Window.partitionBy(*group)
    x = parties.withColumns({"_w": F.sum(weight).over(own), "_n": F.count(F.lit(1)).over(own)})
    fair = lambda n: F.when(F.col("_w") > 0, F.col(weight) * n / F.col("_w")).otherwise(0.0)
    x = x.withColumn("_low", F.least(F.col(cap), F.greatest(F.lit(0), F.ceil(fair(F.col(seats) - F.col("_n") / 2) - 1.5))).cast("long"))
    x = x.withColumn("_high", F.least(F.col(cap), F.floor(fair(F.col(seats) + F.col("_n") / 2) + 2.5)).cast("long"))
    bids = x.select(*group, *key, weight, seats, "_low", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence("_low", F.col("_high") - 1))).alias("_seat"))
    bids = bids.withColumn("_rank", F.row_number().over(own.orderBy((F.col(weight) / (2 * F.col("_seat") + 1)).desc_nulls_last(), *key)))
    bids = bids.withColumn("_sure", F.sum(F.when(F.col("_seat").isNull() | (F.col("_seat") == F.col("_low")), F.col("_low")).otherwise(0)).over(own))
    won = F.col("_seat").isNotNull() & (F.col("_rank") <= F.col(seats) - F.col("_sure"))
    return bids.groupBy(*group, *key).agg((F.min("_low") + F.count_if(won)).alias("quota"))


def mix(docs: DataFrame, block_words: int = 16, max_repeats: int = 3, shard_docs: int = 1000, seed: int = 7, row: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text, source): size, source_size, target, taken, and the run taken in part.

    ``copies`` whole copies are taken, and besides the words [part_from, part_to) and [part2_from, part2_to).
    row: a column that differs in every row; it comes out again, and orders rows of equal doc_id and size.
    """
    key = [row] if row else []
    mark = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id"), F.md5("text")))
    sized = take_columns(docs, "doc_id", "text", "source", *key).select(*key, "doc_id", "source", mark.alias("mark"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = written(sized, "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    sources = targets(per_source.select("source", "source_size"), max_repeats)
    sources = sources.join(per_source.select(F.col("source").alias("_s"), "source_docs"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    sources = sources.withColumns({
        "one": F.lit(1), "missing": F.col("source").isNull(), "name": F.coalesce("source", F.lit("")), "shards": F.ceil(F.col("source_docs") / shard_docs),
        "cap": F.ceil(max_repeats * F.col("source_size") / block_words), "blocks": F.round(F.round(F.sum("target").over(Window.partitionBy()) / block_words, 6)),
    })
    sources = written(sources, "mix-sources")
    quotas = sainte_lague(sources, ["one"], ["missing", "name"], "target", "blocks", "cap").withColumnRenamed("quota", "source_quota").drop("one")
    known = sources.select("missing", "name", "source_size", "target", "shards").join(quotas, ["missing", "name"])
    few = sources.count() <= BROADCAST_SOURCES

    keyed = sized.select(*key, "doc_id", "size", "mark", F.col("source").isNull().alias("missing"), F.coalesce("source", F.lit("")).alias("name"))
    placed = keyed.join(F.broadcast(known) if few else known, ["missing", "name"])
    placed = placed.withColumn("shard", _number(F.substring("mark", 17, 15)) % F.col("shards"))
    if not few:  # else the windows below would take over the join's partitions, one a source
        placed = placed.repartition("missing", "name", "shard")
    shards = placed.groupBy("missing", "name", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    shards = shards.withColumn("ring", F.greatest(F.lit(1), F.round(F.col("shard_size") / block_words)).cast("long"))
    shards = shards.withColumn("cap", F.when(F.col("shard_size") > 0, max_repeats * F.col("ring")).otherwise(0))
    dealt = sainte_lague(shards, ["missing", "name"], ["shard"], "shard_size", "source_quota", "cap")
    shards = shards.drop("source_quota", "cap").join(dealt, ["missing", "name", "shard"])

    inside = Window.partitionBy("missing", "name", "shard")
    placed = placed.withColumn("end", F.sum("size").over(inside.orderBy("mark", "doc_id", "size", *key).rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("start", F.col("end") - F.col("size")).join(shards, ["missing", "name", "shard"])
    placed = placed.withColumns({"copies": F.expr("quota div ring"), "extra": F.expr("quota % ring"), "first": _number(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "missing", "name", "shard")), 1, 15)) % F.col("ring")})
    edge = lambda k: f"(({k}) * shard_size div ring)"  # noqa: E731  the word at which block k of the ring begins
    placed = placed.withColumns({
        "run_from": F.expr(edge("first")), "run_to": F.expr(edge("least(first + extra, ring)")), "wrap_to": F.expr(edge("greatest(first + extra - ring, 0)")),
    })
    cut = lambda a, b: (F.greatest(F.lit(0), F.col(a) - F.col("start")) if a else F.lit(0), F.least(F.col("size"), F.greatest(F.lit(0), F.col(b) - F.col("start"))))
    (a, b), (c, d) = cut("run_from", "run_to"), cut(None, "wrap_to")
    placed = placed.withColumns({"part_from": F.least(a, b), "part_to": b, "part2_from": c.cast("long"), "part2_to": d})
    taken = F.col("copies") * F.col("size") + F.col("part_to") - F.col("part_from") + F.col("part2_to") - F.col("part2_from")
    return placed.select(*key, "doc_id", "size", "source_size", "target", taken.alias("taken"), "copies", "part_from", "part_to", "part2_from", "part2_to", F.when(~F.col("missing"), F.col("name")).alias("source"), "shard")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: each document as often as the mix takes it whole, and once more with the words taken in part, two runs of them parted by a line end.

    Columns are those of docs; n_chars, where there is one, follows the text. Each row is taken by its own plan, repeated ids and null ids too.
    """
    # Written once, so that the plan and the rows have the same keys.
    p = unused_prefix(docs)
    row, key, cut = p + "row", p + "key", p + "cut"
    keyed = written(docs.withColumn(row, F.struct(F.xxhash64("text").alias("text"), F.monotonically_increasing_id().alias("n"))), "mix-rows")
    plan = mix(keyed.select("doc_id", "text", "source", F.col(row).alias("row")), row="row", **options)
    plan = plan.select(F.col("row").alias(key), *(F.col(c).alias(p + c) for c in ("size", "copies", "part_from", "part_to", "part2_from", "part2_to")))
    rows = keyed.join(plan, F.col(row) == F.col(key))
    part = lambda c: F.col(p + c)
    whole = (part("part_to") - part("part_from") + part("part2_to") - part("part2_from")) == part("size")
    some = (part("part_to") > part("part_from")) | (part("part2_to") > part("part2_from"))
    pieces = F.array_compact(F.concat(F.array_repeat(F.lit(0), part("copies").cast("int")), F.array(F.when(some & whole, 0).when(some, 1))))
    rows = rows.withColumn(cut, F.explode(pieces))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    run = lambda a, b: F.array_join(F.slice(words, part(a).cast("int") + 1, (part(b) - part(a)).cast("int")), "")
    text = F.when(F.col(cut) == 0, F.col("text")).otherwise(F.concat_ws("\n", F.nullif(run("part_from", "part_to"), F.lit("")), F.nullif(run("part2_from", "part2_to"), F.lit(""))))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*docs.columns)
