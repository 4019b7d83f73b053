"""Link graph, folders and key files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.paths import folder
from marginalia.operators import graph, pointers
from marginalia.operators.fileindex import FileIndex
from marginalia.operators.joins import link_key
from marginalia.plans.registry import query
from marginalia.sources.tables import activity, load, notes, with_views
from marginalia.streaming.live import shared_dir

EDGES = "(SELECT src, dst FROM (SELECT workspace AS src, (workspace + k) % 150 AS dst FROM activity UNION SELECT (workspace + k) % 150, workspace FROM activity) WHERE src <> dst)"
NODES = "(SELECT workspace AS node, round(avg(value) / 100, 6) AS score FROM activity GROUP BY workspace)"


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.undirected(activity(spark, sf).select(F.col("workspace").alias("src"), ((F.col("workspace") + F.col("k")) % 150).alias("dst")))


@query("link_extract", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
def link_extract(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", F.explode(graph.links_in(F.col("html"), (graph.HREF,))).alias("link"))


@query("link_edges", with_views(f"SELECT src, dst FROM {EDGES} e"))
def link_edges(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf)


@query("graph_boost", with_views(f"WITH e AS (SELECT src, dst FROM {EDGES} x), s0 AS (SELECT node, score FROM {NODES} y), s1 AS (SELECT node, score + coalesce((SELECT sum(t.score * 0.3) FROM e JOIN s0 t ON t.node = src WHERE dst = s0.node), 0) AS score FROM s0), s2 AS (SELECT node, score + coalesce((SELECT sum(t.score * 0.15) FROM e JOIN s1 t ON t.node = src WHERE dst = s1.node), 0) AS score FROM s1) SELECT node, round(score, 5) AS score FROM s2"))
def graph_boost(spark: SparkSession, sf: str) -> DataFrame:
    scores = activity(spark, sf).groupBy(F.col("workspace").alias("node")).agg(F.round(F.avg("value") / 100, 6).alias("score"))
    return graph.propagated(scores, edges(spark, sf), distance=2).select("node", F.round("score", 5).alias("score"))


@query("seed_boost", with_views("SELECT path, round(size / 1000.0::DOUBLE * CASE WHEN path = (SELECT min(path) FROM notes WHERE doc_id = 5) THEN 1.5 WHEN name || '.' || extension IN ('doc_7.md', 'doc_8.txt') THEN 1.3 ELSE 1.0 END, 6) AS score FROM notes"))
def seed_boost(spark: SparkSession, sf: str) -> DataFrame:
    own = notes(spark, sf)
    seed = own.where("doc_id = 5").agg(F.min("path")).scalar()
    return graph.seeded(own.select("path", (F.col("size") / 1000.0).alias("score")), [seed, F.lit("other/doc_7.md"), F.lit("other/doc_8.txt")]).select("path", F.round("score", 6).alias("score"))


@query("link_normalize", with_views("SELECT doc_id, 'doc_' || doc_id AS link_key FROM notes"))
def link_normalize(spark: SparkSession, sf: str) -> DataFrame:
    written = F.concat(F.lit("Some/DOC_"), F.col("doc_id").cast("string"), F.element_at(F.array(F.lit(".md#Part"), F.lit("|shown as"), F.lit(".txt"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int")))
    return notes(spark, sf).select("doc_id", link_key(written).alias("link_key"))


@query("subtree", "SELECT r_name || '/' || n_name || '/' || c_name AS path, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 1 AND n_regionkey = 1")
def subtree(spark: SparkSession, sf: str) -> DataFrame:
    """All files below a folder of the tree region / nation / customer."""
    regions = load(spark, sf, "region")
    nations = load(spark, sf, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    files = load(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"), "c_custkey")
    name = regions.where("r_regionkey = 1").select("r_name").scalar()
    return files.where(graph.below(F.col("path"), name))


@query("key_files", with_views("SELECT folder, count(*) AS files, count(CASE WHEN regexp_matches(name, '^doc_[0-9]*0$') THEN 1 END) AS key_files, max(modified) AS newest FROM notes GROUP BY folder"))
def key_files(spark: SparkSession, sf: str) -> DataFrame:
    own = notes(spark, sf).select(folder(F.col("path")).alias("folder"), "name", "modified")
    return own.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("name").rlike("^doc_[0-9]*0$")).alias("key_files"), F.max("modified").alias("newest"))


def _deep(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as a tree in which each number's parent is its half, with a circle: 3 is below 6."""
    c = load(spark, sf, "customer")
    parent = F.when(F.col("c_custkey") == 3, 6).when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 2))
    return c.select(F.col("c_custkey").alias("id"), parent.cast("long").alias("parent"), F.col("c_nationkey").cast("string").alias("name"))


_DEEP = "WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey = 3 THEN 6 WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent, c_nationkey || '' AS name FROM customer), t AS (SELECT id, name AS path, 0 AS level FROM n WHERE parent IS NULL UNION ALL SELECT n.id, path || '/' || name, level + 1 FROM n JOIN t ON n.parent = t.id)"


@query("tree_deep", f"{_DEEP} SELECT n.id, path, level FROM n LEFT JOIN t ON n.id = t.id")
def tree_deep(spark: SparkSession, sf: str) -> DataFrame:
    """Paths in a tree whose depth nobody says; nodes in a circle and below it have none."""
    return pointers.tree_paths(_deep(spark, sf))


@query("tree_below", f"{_DEEP}, top AS (SELECT path FROM t WHERE id = 5) SELECT t.id, t.level FROM t, top WHERE starts_with(t.path, top.path || '/')")
def tree_below(spark: SparkSession, sf: str) -> DataFrame:
    """A node of the tree found by its path, and everything whose path is below it."""
    found = pointers.tree_paths(_deep(spark, sf))
    path = found.where("id = 5").select("path").scalar()
    return found.where(graph.below(F.col("path"), path)).select("id", "level")


def file_events(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as events of files: of each seven of a customer the first makes a file, the next move it from folder to folder, the last deletes it."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("at"))
    own = o.withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("at", "o_orderkey")))
    place = lambda k: F.concat(F.lit("f"), (k % 5).cast("string"), F.lit("/c"), F.col("o_custkey").cast("string"))
    kind = F.when(F.col("k") % 7 == 1, "create").when(F.col("k") % 7 == 0, "delete").otherwise("rename")
    # A creation is where the file is made; a rename or deletion starts from where the last event left it.
    return own.select(F.col("o_orderkey").alias("id"), "at", kind.alias("type"), F.when(kind == "create", place(F.col("k"))).otherwise(place(F.col("k") - 1)).alias("path"), F.when(kind == "rename", place(F.col("k"))).alias("new_path"))


@query("file_renames", """WITH e AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders)
SELECT o_custkey, (k - 1) // 7 + 1 AS life, count(*) FILTER (k % 7 > 1) AS renames, CASE WHEN max(k) % 7 = 0 THEN 'deleted' END AS ending, 'f' || (max(k) - CASE WHEN max(k) % 7 = 0 THEN 1 ELSE 0 END) % 5 AS folder FROM e GROUP BY o_custkey, (k - 1) // 7""")
def file_renames(spark: SparkSession, sf: str) -> DataFrame:
    """Every file that ever was: how often it moved, where it is or last was, and how it ended."""
    files = pointers.renamed(file_events(spark, sf))
    customer = F.regexp_extract("path", "c([0-9]+)$", 1).cast("long")
    life = F.row_number().over(Window.partitionBy(customer).orderBy("born", "id"))
    return files.select(customer.alias("o_custkey"), life.cast("long").alias("life"), F.col("renames").cast("long").alias("renames"), "ending", F.substring_index("path", "/", 1).alias("folder"))


_FILES = """WITH e AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
f AS (SELECT o_custkey, 'f' || max(k) % 5 AS folder, CASE WHEN max(k) % 3 = 0 OR max(k) % 7 = 1 THEN max(k) ELSE greatest(max(k) - max(k) % 3, (max(k) - 1) // 7 * 7 + 1) END AS told FROM e GROUP BY o_custkey HAVING max(k) % 7 > 0)"""


def _followed(spark: SparkSession, sf: str) -> FileIndex:
    """An index that took the file events in two batches by time. Every third event of a customer, and each creation, says what tag the file has."""
    e = file_events(spark, sf)
    k = F.row_number().over(Window.partitionBy(F.regexp_extract("path", "c([0-9]+)$", 1)).orderBy("at", "id"))
    own = e.withColumn("k", k).select(F.lpad(F.col("id").cast("string"), 20, "0").alias("id"), "at", "type", "path", "new_path", F.when((F.col("k") % 3 == 0) | (F.col("type") == "create"), F.array(F.concat(F.lit("t"), F.col("k").cast("string")))).alias("tags"), F.col("at").alias("modified"))
    path = shared_dir(spark)
    own.write.parquet(f"{path}/events")
    events, index = spark.read.parquet(f"{path}/events"), FileIndex(spark, path)
    middle = events.agg(F.percentile_approx("at", 0.6)).scalar()
    index.update(events.where(F.col("at") <= middle))
    index.update(events.where(F.col("at") > middle))
    return index


@query("file_index_folders", f"{_FILES} SELECT folder, count(*) AS files, count(DISTINCT o_custkey) AS customers FROM f WHERE folder IN ('f1', 'f3') GROUP BY folder")
def file_index_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Files of two folders, from an index that followed creations, renames and deletions."""
    found = _followed(spark, sf).in_folder(spark.createDataFrame([("f1",), ("f3",)], "folder string"))
    return found.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("path").alias("customers"))


@query("file_index_tags", f"{_FILES} SELECT 't' || told AS tag, folder || '/c' || o_custkey AS path FROM f WHERE told IN (3, 8, 9)")
def file_index_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Files that have one of three tags now, whatever they had before and wherever they were."""
    return _followed(spark, sf).with_tag(spark.createDataFrame([("t3",), ("t8",), ("t9",)], "tag string"))
