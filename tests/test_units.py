"""Edge rules on rows made by hand."""

import re

import pytest
from pyspark.sql import functions as F

from marginalia.functions import paths, scalars, text
from marginalia.functions.stem import stem
from marginalia.operators import aggregates, events, filters, graph, index, joins, ranking
from marginalia.sources import eventlog


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("glob", "yes", "no"), [
    ("**/*.md", ["a.md", "x/y/a.md"], ["a.txt"]), ("notes.*", ["notes.md"], ["notesmd", "x/notes.md"]), ("a/{b,c}/?.md", ["a/b/1.md", "a/c/2.md"], ["a/d/1.md", "a/b/12.md"]),
    ("[!x]*.md", ["a1.md"], ["x1.md"]), ("a+(b).md", ["a+(b).md"], ["aab.md"]), ("a/**", ["a/b/c", "a/"], ["b/a"]),
])
def test_globs(glob, yes, no):
    pattern = re.compile(paths.glob_to_regex(glob))
    assert all(pattern.search(x) for x in yes) and not any(pattern.search(x) for x in no)


@pytest.mark.parametrize(("word", "want"), [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"), ("hopping", "hop"),
    ("conflated", "conflat"), ("sized", "size"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"),
    ("hopefulness", "hope"), ("formalize", "formal"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("effective", "effect"),
    ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("generalizations", "gener"), ("is", "is"), ("été", "été"),
])
def test_stems(word, want):
    assert stem(word) == want


def test_pages_cover_all_rows_once(spark):
    df = spark.range(57).select("id", (F.col("id") % 5).alias("k"))
    pages = [ranking.page(df, [F.desc("k"), "id"], n, 10) for n in range(7)]
    got = [r["id"] for p in pages for r in p.collect()]
    assert sorted(got) == list(range(57)) and len(pages[5].collect()) == 7 and pages[6].isEmpty()
    assert ranking.page_size(None) == 25 and ranking.page_size(500) == 200 and ranking.page_size(0) == 1
    with pytest.raises(ValueError, match="can't sort"):
        ranking.sorted_by(df, {"key": "k"}, "id; drop table", False, "id")


def test_running_sum_is_that_of_one_window(spark):
    df = spark.range(200).select("id", (F.col("id") * 37 % 11).alias("size"), F.floor(F.col("id") / 3).alias("day"))
    got = {r["id"]: r["total"] for r in ranking.running_sum(df, F.floor(F.col("day") / 10), [F.col("day"), F.col("id")], "size", "total").collect()}
    total = 0
    for i in range(200):
        total += i * 37 % 11
        assert got[i] == total


def test_scores_at_their_limits(spark):
    df = spark.createDataFrame([("alpha beta",), ("beta only",), ("ab",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(text.keyword_score(F.col("t"), "Alpha beta")).collect()]
    assert got == [0.9, 0.4, None, None, None]
    assert [r[0] for r in df.select(text.keyword_score(F.col("t"), "ab")).collect()] == [None, None, 0.9, None, None]
    assert [r[0] for r in df.select(text.keyword_score(F.col("t"), "")).collect()] == [None] * 5
    assert [r[0] for r in df.select(text.fuzzy_score(F.col("t"), "ab")).collect()] == [0.92, None, 1.0, None, None]


def test_snippets_at_both_ends(spark):
    df = spark.createDataFrame([("hit and more text after it",), ("text before the hit",), ("none",)], "t string")
    got = [r[0] for r in df.select(text.snippet(F.col("t"), text.found_at(F.col("t"), "hit"), 3, 5)).collect()]
    assert got == ["hit and...", "...the hit", "none"]
    assert df.select(text.highlights(F.lit("aaaa"), "aa", around=0)).first()[0] == ["aa", "aa", "aa"]


def test_filters_on_nulls(spark):
    df = spark.createDataFrame([(1, "a", 5.0, True), (2, None, None, False), (3, "b", 9.0, True)], "id int, k string, v double, call boolean")
    ids = lambda c: sorted(r["id"] for r in df.where(c).collect())
    assert ids(filters.conjunction([filters.among("k", ["a"]), None])) == [1]
    assert filters.among("k", []) is None and filters.between("v") is None
    assert ids(filters.between("v", 5, 9)) == [1, 3] and ids(filters.between("v", 5, 9, strict=False)) == [1, 2, 3]
    assert ids(filters.tool_calls(F.col("call"), F.col("v") > 6)) == [2, 3]
    assert ids(filters.conjunction([])) == [1, 2, 3] and ids(filters.in_scope("k", [])) == [1, 2, 3]
    assert ids(filters.contains_text("k", "A")) == [1] and ids(filters.contains_text("k", "a.", "word")) == []


def test_groups_of_null_and_of_one_row(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", 0.2), ("a", 0.6)], "k string, score double")
    assert [tuple(r) for r in aggregates.grouped(df, {"k": ("k", "none")}, "score").collect()] == [("a", 2, 0.8, 0.4), ("none", 1, 1.0, 1.0)]
    assert df.groupBy("k").agg(*aggregates.spread("score")).where("k is null").first()["deviation"] == 0
    assert [r[0] for r in df.select(aggregates.band(F.col("score"))).collect()] == ["top", "low", "high"]
    limits = spark.createDataFrame([(5.0, 5.0), (4.0, 5.0), (4.0, 0.0)], "spent double, most double")
    assert [tuple(r) for r in limits.select(*aggregates.budget(F.col("spent"), F.col("most"))).collect()] == [(100.0, True, 0.0), (80.0, False, 1.0), (0.0, False, None)]


def test_log_skips_what_is_malformed(spark, tmp_path):
    log = f"{tmp_path}/log"
    good = spark.createDataFrame([("e1", "message", "d1", 5), ("e2", "message", "d2", 6)], "id string, type string, deviceId string, timestamp long")
    eventlog.append_log(good, log)
    (tmp_path / "log" / "bad.jsonl").write_text('{"id": "e3", "ty\n\n   \n{"type": "no id"}\n{"id": "e4", "type": "state_saved", "data": {"id": "s"}}\n')
    (tmp_path / "log" / "other.txt").write_text('{"id": "e5"}\n')
    got = eventlog.read_log(spark, log)
    assert sorted(r["id"] for r in got.collect()) == ["e1", "e2", "e4"]
    assert got.where("id = 'e4'").first()["data"] == '{"id":"s"}'
    assert eventlog.file_stats(spark, log).agg(F.sum("events")).first()[0] == 5


def test_fold_is_the_same_in_any_order_and_twice(spark):
    log = [
        (1, 10, "a", '{"name":"x","note":"n"}', True, False), (2, 20, "a", '{"note":null}', False, False), (3, 5, "a", '{"name":"old"}', False, False), (4, 30, "b", '{"name":"b"}', True, False),
        (5, 40, "b", "{}", False, True), (6, 10, "c", '{"name":"c"}', False, False), (7, 1, "d", '{"name":"d1"}', True, False), (8, 2, "d", "{}", False, True), (9, 3, "d", '{"name":"d2"}', True, False),
    ]
    schema = "id long, ms long, key string, patch string, is_create boolean, is_delete boolean"
    want = [("a", "x", None, 3), ("d", "d2", None, 3)]
    assert rows(events.folded(spark.createDataFrame(log, schema), "key", "patch", ["name", "note"])) == want
    assert rows(events.folded(spark.createDataFrame(log[::-1], schema).repartition(4), "key", "patch", ["name", "note"])) == want
    twice = spark.createDataFrame(log + log, schema).dropDuplicates(["id"])
    assert rows(events.folded(twice, "key", "patch", ["name", "note"])) == want
    assert events.folded(spark.createDataFrame([], schema), "key", "patch", ["name"]).isEmpty()


def test_ranges_that_touch_meet_once(spark):
    ranges = spark.createDataFrame([(1, 0, 250), (2, 251, 251)], "r long, lo long, hi long")
    spans = spark.createDataFrame([(1, 250, 400), (2, -5, 0), (3, 252, 260), (4, 90, 230)], "s long, start long, end long")
    assert rows(joins.overlapping(ranges, spans, 100).select("r", "s")) == [(1, 1), (1, 2), (1, 4), (2, 1)]


def test_links_and_scores(spark):
    page = spark.createDataFrame([("see [[Note One|x]] and [b](dir/two.md#h) [[Three]]",)], "t string")
    assert page.select(graph.links_in(F.col("t"))).first()[0] == ["Note One", "Three", "dir/two.md"]
    edges = graph.undirected(spark.createDataFrame([(1, 2), (2, 1), (2, 2), (2, 3)], "src long, dst long"))
    assert rows(edges) == [(1, 2), (2, 1), (2, 3), (3, 2)]
    scores = spark.createDataFrame([(1, 1.0), (2, 0.0), (9, 0.5)], "node long, score double")
    assert [(n, round(s, 6)) for n, s in rows(graph.propagated(scores, edges))] == [(1, 1.0), (2, 0.3), (9, 0.5)]


def test_postings_after_an_update(spark):
    docs = spark.createDataFrame([(1, "Red, red apple"), (2, "green apple x"), (3, None)], "id long, t string")
    found = index.postings(docs, "id", "t")
    assert rows(found) == [("apple", 1), ("apple", 2), ("green", 2), ("red", 1)]
    assert rows(index.all_of(found, ["APPLE", "red"])) == [(1,)] and rows(index.any_of(found, ["red", "green"])) == [(1, 1), (2, 1)]
    new = index.updated(found, spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([("blue", 1)], "word string, id long"))
    assert rows(new) == [("apple", 2), ("blue", 1), ("green", 2)]


def test_text_edits(spark):
    one = spark.createDataFrame([("a\nb\nc",)], "t string")
    t = F.col("t")
    assert one.select(scalars.lines_replaced(t, 2, 2, ["x", "y"])).first()[0] == "a\nx\ny\nc"
    assert one.select(scalars.lines_replaced(t, 4, 9, ["x"])).first()[0] == "a\nb\nc\nx"
    assert tuple(one.select(*scalars.replaced(F.lit("a.b a b."), "B.", "$1", False)).first()) == ("a.b a $1", 1)
    assert tuple(one.select(*scalars.tool_parts(F.lit("vault_x_run"))).first()) == ("vault_x", "run")
    assert one.select(scalars.similarity(F.lit(""), F.lit(""))).first()[0] == 1.0
    assert one.select(scalars.first_number(F.lit(None).cast("long"), F.lit(0).cast("long"))).first()[0] == 0


def test_stream_resumes_where_it_stopped(spark, tmp_path):
    from marginalia.streaming import live

    schema = "user_id long, value double, ts timestamp"
    spark.createDataFrame([(1, 2.0), (2, 1.0)], "user_id long, value double").withColumn("ts", F.timestamp_seconds(F.lit(100))).write.parquet(f"{tmp_path}/in/a")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    columns = "user_id long, items long, total double, last_ms long"
    live.drained(live.keyed_fold(stream()), "update", columns, f"{tmp_path}/run")
    spark.createDataFrame([(1, 5.0)], "user_id long, value double").withColumn("ts", F.timestamp_seconds(F.lit(50))).write.parquet(f"{tmp_path}/in/b")
    again = live.newest(live.drained(live.keyed_fold(stream()), "update", columns, f"{tmp_path}/run"), ["user_id"])
    assert rows(again) == [(1, 2, 7.0, 100_000), (2, 1, 1.0, 100_000)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def test_place_of_the_best_match_against_all_places():
    import random

    from marginalia.functions.locate import located

    rng = random.Random(3)
    for _ in range(150):
        text, pattern = "".join(rng.choice("abc ") for _ in range(rng.randrange(40))), "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 7)))
        scores = [(min(edit_distance(pattern, text[k:e]) for e in range(k, len(text) + 1)) / len(pattern) + k / 1000, k) for k in range(len(text))]
        best = min((s for s in scores if s[0] <= 0.4), default=(0, None))
        assert located(text, pattern, 0.4) == best[1], (text, pattern)
    assert located("x" * 2000 + "abc", "abc", 0.5) is None and located(None, "a", 1.0) is None and located("abc", "", 1.0) is None


def test_fragments_in_any_order_and_batch(spark, tmp_path):
    from marginalia.streaming import live

    rows = [[("a", 2, "C", True), ("b", 0, "x", False)], [("a", 0, "A", False), ("a", 2, "C", True), ("c", 0, None, True)], [("a", 1, "B", False)]]
    schema = "call string, seq long, part string, last boolean"
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = live.drained(live.fragment_fold(stream), "append", "call string, text string, fragments long").collect()
    assert sorted((r["call"], r["text"], r["fragments"]) for r in got) == [("a", "ABC", 3), ("c", "", 1)]


def test_log_files_are_named_and_events_stamped(spark, tmp_path):
    from marginalia.sources import eventlog

    path = str(tmp_path / "log")
    eventlog.append_log(spark.createDataFrame([("message",)], "type string"), path, device="d1")
    got = eventlog.read_log(spark, path).collect()
    assert len(got) == 1 and got[0]["deviceId"] == "d1" and got[0]["id"] and got[0]["timestamp"] > 0 and got[0]["file"].startswith("file:")


def test_later_entries_win_and_broken_arrays_stay_texts(spark):
    from pyspark.sql import functions as F

    from marginalia.functions.scalars import json_array
    from marginalia.operators.aggregates import merged_maps

    rows = spark.createDataFrame([("x", 2, {"a": "new"}), ("x", 1, {"a": "old", "b": None}), ("y", 1, {}), ("z", 1, None)], "k string, t int, m map<string, string>")
    assert {r["k"]: r["m"] for r in merged_maps(rows, "k", "m", ["t"]).collect()} == {"x": {"a": "new", "b": None}}
    texts = spark.createDataFrame([(x,) for x in ("[1, \"b\"]", " [] ", "[1", "[1,]x]", "text", None)], "t string")
    assert [r[0] for r in texts.select(json_array(F.col("t"))).collect()] == [["1", "b"], [], None, None, None, None]


def test_trees_without_circles(spark):
    from marginalia.operators.graph import flattened

    nodes = spark.createDataFrame([(1, None, "r"), (2, 1, "a"), (3, 2, "b"), (4, 5, "c"), (5, 4, "d"), (6, 3, "deep")], "id int, parent int, name string")
    assert sorted((r["id"], r["path"], r["level"]) for r in flattened(nodes, 2).collect()) == [(1, "r", 0), (2, "r/a", 1), (3, "r/a/b", 2)]


def test_windows_in_two_levels_are_those_of_one(spark):
    """A hot key, null keys and ties: the same rows with and without buckets, and no window by the key alone sees more than a row a bucket."""
    import random

    from marginalia.operators import events as ev
    from marginalia.operators import ranking

    rng = random.Random(8)
    rows = [(i, rng.choice(["hot", "hot", "a", None]), rng.randrange(5000), rng.randrange(20), round(rng.random(), 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, ms long, n long, score double")
    span = F.floor(F.col("ms") / 300)
    both = lambda f, bucket: [sorted(map(tuple, f(b).collect()), key=repr) for b in (None, bucket)]
    for one, two in (
        both(lambda b: ranking.numbered(df, "k", ["ms", "id"], "at", b).select("id", "at"), span), both(lambda b: ranking.scanned(df, "k", ["ms", "id"], "n", "sum", b).select("id", "sum"), span),
        both(lambda b: ranking.diversified(df, "k", "score", "id", bucket=b).select("id", F.round("score", 6)), F.floor(F.col("score") * -7)), both(lambda b: ev.gap_sessions(df.select("k", "id", "ms"), "k", 40, b), 300),
        both(lambda b: ev.gap_sessions(df.select("k", "id", "ms"), "k", 700, b), 300), both(lambda b: ev.throttled(df.withColumn("o", F.col("ms") * 1000 + F.col("id")), "k", "o", "n", 50, b).select("id", "running"), span),
    ):
        assert one == two and len(one) >= 3
    plan = ranking.numbered(df, "k", ["ms", "id"], "at", span)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    assert len(windows) == 2 and sum("_bucket" in x for x in windows) == 1 and any("Aggregate" in x for x in plan[plan.index("_key"):].split("\n"))


def test_trees_of_any_depth_and_circles(spark):
    from marginalia.operators import pointers

    rows = [(i, i - 1 if i else None, f"n{i}") for i in range(70)] + [(100, 101, "a"), (101, 102, "b"), (102, 100, "c"), (103, 101, "d"), (104, 999, "e"), (105, 104, "f"), (106, None, "g"), (107, 107, "h")]
    got = {r["id"]: (r["path"], r["level"]) for r in pointers.tree_paths(spark.createDataFrame(rows, "id long, parent long, name string")).collect()}
    assert got == {i: ("/".join(f"n{k}" for k in range(i + 1)), i) if i < 70 else ("g", 0) if i == 106 else (None, None) for i, _, _ in rows}
    assert pointers.tree_paths(spark.createDataFrame([], "id long, parent long, name string")).collect() == []


def test_files_through_their_renames(spark):
    import random

    from marginalia.operators import pointers

    for seed in range(3):
        rng = random.Random(seed)
        events = [(i, i, rng.choice(["create", "create", "rename", "rename", "rename", "delete"]), rng.choice("abcdef"), None) for i in range(120)]
        events = [(i, at, kind, path, rng.choice([x for x in "abcdef" if x != path]) if kind == "rename" else None) for i, at, kind, path, _ in events]
        there, files = {}, {}
        for i, _, kind, path, new in events:
            if kind == "delete":
                if path in there:
                    files[there.pop(path)][2] = "deleted"
                continue
            if kind == "rename" and path in there:
                own = there.pop(path)
                files[own][1] += 1
            else:
                own = i
                files[own] = [None, 0, None]
            at = new if kind == "rename" else path
            if at in there:
                files[there[at]][2] = "replaced"
            there[at] = own
            files[own][0] = at
        got = pointers.renamed(spark.createDataFrame(events, "id long, at long, type string, path string, new_path string")).collect()
        assert {r["id"]: [r["path"], r["renames"], r["ending"]] for r in got} == files


def test_file_index_is_that_of_a_plain_replay(spark, tmp_path):
    import random

    from marginalia.operators.fileindex import EVENTS, FileIndex

    rng, files, at = random.Random(4), {}, 0
    index = FileIndex(spark, f"file://{tmp_path}", buckets=3)
    paths = [f"{d}{n}" for d in ("", "a/", "a/b/") for n in "xyz"]
    for batch in range(4):
        events = []
        for i in range(25):
            at += 1
            kind, path = rng.choice(["create", "create", "modify", "rename", "rename", "delete"]), rng.choice(paths)
            new = rng.choice([p for p in paths if p != path]) if kind == "rename" else None
            tags = rng.choice([None, ["t"], ["t", "u"], []]) if kind != "delete" else None
            events.append((f"{i:03}", at, kind, path, new, tags, at if kind != "delete" else None))
            if kind == "delete":
                files.pop(path, None)
                continue
            was = files.pop(path, (None, None)) if kind != "create" else (None, None)
            files[new or path] = (tags if tags is not None else was[0], at)
        df = spark.createDataFrame(events, EVENTS)
        version = index.update(df)
        if batch == 2:
            index.update(df, version)  # done again
        got = {r["path"]: (r["tags"], r["modified"]) for r in index.all_files().collect()}
        assert got == files
    folders = index.in_folder(spark.createDataFrame([("",), ("a/b",), ("no",)], "folder string")).collect()
    assert sorted((r["folder"], r["path"]) for r in folders) == sorted((f, p) for p in files for f in [p.rsplit("/", 1)[0] if "/" in p else ""] if f in ("", "a/b"))
    tags = index.with_tag(spark.createDataFrame([("t",), ("u",)], "tag string")).collect()
    assert sorted((r["tag"], r["path"]) for r in tags) == sorted((t, p) for p, (own, _) in files.items() for t in own or ())
    assert [r["path"] for r in index.file(spark.createDataFrame([("x",), ("q",)], "path string")).collect()] == ["x"] * ("x" in files)
