"""The kept index with positions, and responses over the wire, against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.operators import aggregates, joins
from marginalia.operators.textindex import TextIndex
from marginalia.plans.search import consolidated
from marginalia.streaming import binding, live, wire

WORDS = ["a", "b", "the", "naïve", "running", "run", "x1"]


def words(text):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    """An index after additions, changes, removals and a compaction between, and the texts that it must hold."""
    rng = random.Random(3)
    text = lambda: rng.choice([None, "", "A  b,the.THE_naïve!"]) if rng.random() < 0.1 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 25)))
    index, texts = TextIndex(spark, f"file://{tmp_path_factory.mktemp('index')}", buckets=5), {}
    for step in range(5):
        new = {str(rng.randrange(40)): text() for _ in range(12)}
        gone = [str(rng.randrange(40)) for _ in range(4)] if step else []
        index.update(spark.createDataFrame([*new.items(), (None, "the a")], "id string, text string"), spark.createDataFrame([(i,) for i in gone], "id string"))
        texts = {i: t for i, t in texts.items() if i not in gone} | new
        if step == 2:
            index.compact()
    index.update(removed=spark.createDataFrame([("1",), ("2",)], "id string"))
    return index, {i: words(t) for i, t in texts.items() if i not in ("1", "2")}


def test_phrases(held):
    index, texts = held
    for phrase in (["the"], ["A", "the"], ["b", "b"], ["the", "a", "the"], ["no"], ["the", "no"]):
        low = [p.lower() for p in phrase]
        want = {i: [k for k in range(len(w)) if w[k : k + len(low)] == low] for i, w in texts.items()}
        assert {r["id"]: r["starts"] for r in index.phrase(*phrase).collect()} == {i: k for i, k in want.items() if k}


def test_near(held):
    index, texts = held
    for a, b, between in (("run", "x1", 0), ("the", "the", 1), ("naïve", "a", 4)):
        want = {i: [k for k, w in enumerate(ws) if w == b and any(v == a and j != k and abs(j - k) <= between + 1 for j, v in enumerate(ws))] for i, ws in texts.items()}
        assert {r["id"]: sorted(r["places"]) for r in index.near(a, b, between=between).collect()} == {i: k for i, k in want.items() if k}


def test_prefixes_all_any_none(held):
    index, texts = held
    got = {(r["word"], r["id"]): r["places"] for r in index.prefix("RU").collect()}
    assert got == {(w, i): [k for k, v in enumerate(ws) if v == w] for i, ws in texts.items() for w in ("run", "running") if w in ws}
    assert index.prefix("zz").collect() == []
    assert {r["id"] for r in index.all_of("the", "run").collect()} == {i for i, w in texts.items() if {"the", "run"} <= set(w)}
    some = index.any_of("x1", "naïve", "x1")
    assert {r["id"]: r["matched"] for r in some.collect()} == {i: len({"x1", "naïve"} & set(w)) for i, w in texts.items() if {"x1", "naïve"} & set(w)}
    assert {r["id"] for r in index.without(some, "the").collect()} == {i for i, w in texts.items() if {"x1", "naïve"} & set(w) and "the" not in w}


def test_a_search_reads_its_buckets_alone(held):
    index, _ = held
    wanted = index.spark.createDataFrame([("x1", p) for p in range(8)], "word string, part int")
    buckets = set(index.postings.buckets_of(wanted))
    read = {int(re.search("bucket=([0-9]+)", f)[1]) for f in index.postings.lookup(wanted).inputFiles()}
    assert read <= buckets


def test_stems(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}", buckets=2, stems=True)
    index.update(spark.createDataFrame([(1, "Running runs"), (2, "the runner ran"), (3, "naïve relational")], "id long, text string"))
    assert [r["id"] for r in index.phrase("run", "running").collect()] == ["1"]
    assert [r["id"] for r in index.all_of("relate").collect()] == ["3"]


def test_update_done_again(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}", buckets=2)
    rows = spark.createDataFrame([(1, "a b"), (2, "b")], "id long, text string")
    index.update(rows)
    again = spark.createDataFrame([(2, "c")], "id long, text string")
    version = index.update(again)
    index.update(again, version=version)
    assert sorted((r["word"], r["id"]) for r in index.held(["a", "b", "c"]).collect()) == [("a", "1"), ("b", "1"), ("c", "2")]


def frames(*data, end="\n"):
    return "".join(f"data: {d}{end}{end}" for d in data)


SAID = '{"choices":[{"delta":{"content":"Grüße %s","reasoning":"r"}}]}'
CALL = '{"choices":[{"delta":{"tool_calls":[%s]}}]}'
WHOLE = (
    ": hello\n" + frames(SAID % 1, "{bad", end="\r\n") + "event: x\ndata\n\nid: 3\n" + frames(CALL % '{"index":1,"id":"c1","function":{"name":"f","arguments":"{\\"a\\":"}},{"function":{"arguments":"1"}}', end="\r")
    + frames('{"choices":\ndata: [{"delta":{"content":"!"}}]}', CALL % '{"index":1,"function":{"arguments":"2}"}}', "[1]", '{"usage":{"prompt_tokens":3,"completion_tokens":4}}', "[DONE]", SAID % 2)
)


def test_answers_do_not_depend_on_where_chunks_are_cut():
    whole = wire.fresh()
    wire.arrive(whole, 0, WHOLE)
    want = wire.answer("s", whole)
    assert want["content"] == "Grüße 1!" and want["reasoning"] == "r" and want["ending"] == "done"
    assert want["calls"] == [{"index": 0, "id": "", "name": "", "arguments": "1"}, {"index": 1, "id": "c1", "name": "f", "arguments": '{"a":2}'}]
    assert (want["prompt_tokens"], want["completion_tokens"], want["bad"]) == (3, 4, 3)
    rng = random.Random(1)
    for _ in range(50):
        at = sorted({0, len(WHOLE), *(rng.randrange(len(WHOLE)) for _ in range(rng.randrange(40)))})
        parts = [(n, WHOLE[a:b]) for n, (a, b) in enumerate(zip(at, at[1:], strict=False))]
        shuffled = [*parts, *rng.sample(parts, min(3, len(parts)))]
        rng.shuffle(shuffled)
        held = wire.fresh()
        for n, chunk in shuffled:
            wire.arrive(held, n, chunk)
        assert wire.answer("s", held) == want


def test_answers_expire_and_come_once(spark, tmp_path):
    put = lambda name, rows: spark.createDataFrame(rows, "stream string, n long, ts string, chunk string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.json(f"{tmp_path}/in/{name}")
    run = lambda: live.drained(wire.answers(spark.readStream.schema(wire.CHUNKS).json(f"{tmp_path}/in/*")), "append", wire.ANSWER, f"file://{tmp_path}/run")
    put("a", [("ends", 0, "2024-01-01 00:00:00", WHOLE[:40]), ("open", 0, "2024-01-01 00:00:00", frames(SAID % 7)), ("gap", 1, "2024-01-01 00:00:00", frames(SAID % 8)), ("ends", 0, "2024-01-01 00:00:00", WHOLE[:40])])
    assert run().collect() == []
    put("b", [("ends", 1, "2024-01-01 01:00:00", WHOLE[40:]), ("ends", 1, "2024-01-01 01:00:00", WHOLE[40:])])
    assert [r["ending"] for r in run().collect()] == ["done"]
    put("c", [("ends", 1, "2024-01-01 01:10:00", WHOLE[40:]), ("later", 0, "2024-01-03 00:00:00", frames(SAID % 1))])
    got = sorted((r["stream"], r["content"], r["ending"]) for r in run().collect())
    assert got == [("ends", "Grüße 1!", "done"), ("gap", "", "expired"), ("open", "Grüße 7", "expired")]


def test_consolidated_results_keep_methods_and_sessions(spark):
    rows = [("w", "Click", "s1", 1.0, "Hit "), ("w", "click", "s1", 2.0, "hit"), ("w", "a b", "c", 3.0, "A b c"), ("w", "a", "b c", 0.5, "a b c"), ("w", "a", "b c", 0.5, "a b c"), ("v", "x", None, 1.0, None)]
    got = {r["workspace"]: tuple(r)[1:] for r in consolidated(spark.createDataFrame(rows, "workspace string, type string, session string, score double, snippet string")).collect()}
    assert got["w"] == (3.0, "Click,a,a b,click", 3, "a b c ... hit")


def test_maps_of_keys_without_entries_stay(spark):
    df = spark.sql("select * from values (1, 1, map('a', 1)), (1, 2, map('a', 2, 'b', 3)), (2, 1, map()), (3, 1, null) as t(k, t, m)")
    assert {r["k"]: r["m"] for r in aggregates.merged_maps(df, "k", "m", ["t"]).collect()} == {1: {"a": 2, "b": 3}, 2: {}, 3: {}}


def test_names_that_hold_one_another(spark):
    rng = random.Random(2)
    a = {"".join(rng.choice("ab") for _ in range(rng.randrange(0, 9))) for _ in range(40)} | {"brand"}
    b = {"".join(rng.choice("ab") for _ in range(rng.randrange(0, 9))) for _ in range(40)} | {"a brand", "é"}
    got = joins.holding_one_another(spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string")).collect()
    assert sorted(map(tuple, got)) == sorted((x, y) for x in a for y in b if x and y and (x in y or y in x))


def test_sessions_are_bound_once_and_forgotten_when_idle(spark, tmp_path):
    put = lambda name, rows: spark.createDataFrame(rows, "id long, ts string, session string, workspace string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    known = spark.createDataFrame([("s-00000000000009", "k")], "session_id string, workspace string")
    run = lambda: live.drained(binding.bound(spark.readStream.schema(binding.CALLS).parquet(f"{tmp_path}/in/*"), known), "append", binding.BOUND, f"file://{tmp_path}/run")
    one, nine = "s-00000000000001", "s-00000000000009"
    put("a", [(3, "2024-01-01 00:00:03", one, "b"), (1, "2024-01-01 00:00:01", one, None), (2, "2024-01-01 00:00:02", one, "a"), (4, "2024-01-01 00:00:04", None, "a"), (5, "2024-01-01 00:00:04", "my plan", None), (6, "2024-01-01 00:00:04", nine, "x"), (7, "2024-01-01 00:00:04", "s-123", None)])
    run()
    put("b", [(8, "2024-01-02 00:00:00", one, "b"), (9, "2024-03-01 00:00:00", nine, None)])
    run()
    put("c", [(10, "2024-03-02 00:00:00", one, "b")])  # idle for so long that it is made again
    got = {r["id"]: (r["session_id"], r["name"], r["created"], r["workspace"], r["refused"]) for r in run().collect()}
    assert got == {
        1: (one, f"Session {one}", True, None, False), 2: (one, None, False, "a", False), 3: (one, None, False, "a", True), 4: ("s-20240101000004-4", "Default Session", True, "a", False), 5: ("s-20240101000004-5", "my plan", True, None, False),
        6: (nine, None, False, "k", True), 7: ("s-20240101000004-7", "s-123", True, None, False), 8: (one, None, False, "a", True), 9: (nine, None, False, "k", False), 10: (one, f"Session {one}", True, "b", False),
    }


def test_streams_of_tables_in_several_files(spark, tmp_path):
    from marginalia.plans.logs import stream_fragments

    rows = spark.createDataFrame([(1, 0, "A"), (2, 1, "x"), (1, 1, "B")], "conv_id long, turn long, text string")
    for n in (0, 1):  # a folder of part files, and an empty one
        rows.limit(3 * n).repartition(2).write.parquet(f"{tmp_path}/{n}/conversations.parquet")
    assert [tuple(r) for r in stream_fragments(spark, f"{tmp_path}/1").collect()] == [("1", "AB", 2)]
    assert stream_fragments(spark, f"{tmp_path}/0").collect() == []


def test_keys_of_a_bucket_are_folded_apart(spark, tmp_path):
    """Keys that share a bucket, and with it a group of Spark's state, have states and times of their own."""
    put = lambda name, rows: spark.createDataFrame(rows, "k string, n long, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    seen = lambda k, new, held, mark: ([(k, held, -1)], None, None) if new is None else ([(k, held, len(new))], f"{held or ''}+{sum(n for _, n in new)}", 1704067200000 + new[-1][1] * 86_400_000)
    stream = lambda: spark.readStream.schema("k string, n long, ts timestamp").parquet(f"{tmp_path}/in/*").withWatermark("ts", "1 second")
    run = lambda: live.drained(live.folded(stream(), "k", seen, "k string, held string, n long", buckets=1), "append", "k string, held string, n long", f"file://{tmp_path}/run")
    put("a", [("x", 1, "2024-01-01 00:00:00"), ("x", 1, "2024-01-01 00:00:00"), ("y", 9, "2024-01-01 00:00:00"), (None, 9, "2024-01-01 00:00:00")])
    first = [(None, None, 1), ("x", None, 2), ("y", None, 1)]
    by = lambda r: (str(r[0]), str(r[1]), r[2])
    assert sorted((tuple(r)[:3] for r in run().collect()), key=by) == first
    put("b", [("y", 9, "2024-01-03 00:00:00")])  # x's time is over, which the next watermark shows
    assert sorted((tuple(r)[:3] for r in run().collect()), key=by) == sorted([*first, ("y", "+9", 1), ("x", "+2", -1)], key=by)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_words_of_a_text_are_placed_without_a_shuffle(spark):
    from marginalia.operators.textindex import placed

    rows = placed(spark.createDataFrame([("1", ["b", "a", "b"]), ("2", []), ("3", ["é"])], "id string, _words array<string>"))
    assert exchanges(rows) == 0
    assert sorted(map(tuple, rows.collect())) == [("1", "a", [1]), ("1", "b", [0, 2]), ("3", "é", [0])]


def test_rows_of_one_id_have_one_posting(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}", buckets=2)
    index.update(spark.createDataFrame([(1, "a b"), (1, "c a")], "id long, text string"))
    assert [tuple(r) for r in index.held(["a"]).collect()] == [("a", "1", [0, 1])]


def one_file(spark, path, sql, table="events"):
    """The table of rows that the SQL makes, as a single file."""
    spark.sql(sql).coalesce(1).write.parquet(f"{path}/made")
    (part,) = path.glob("made/part-*.parquet")
    part.rename(path / f"{table}.parquet")
    return str(path)


EVENTS = "select id as event_id, cast(at as timestamp_ntz) as ts, user as user_id, type as event_type, value, '{}' as props from values %s as t(id, at, user, type, value)"


def test_streams_of_tables_in_one_file_or_folders(spark, tmp_path):
    """The same rows from one file, part files and folders of a column, and from nothing beside them."""
    rows = EVENTS % "(1, '2024-01-01', 7, 'view', 1.5D), (2, null, null, 'a b', null)"
    one = one_file(spark, tmp_path / "one", rows)
    spark.sql(rows).repartition(2).write.parquet(f"{tmp_path}/parts/events.parquet")
    spark.sql(rows).write.partitionBy("event_type").parquet(f"{tmp_path}/columns/events.parquet")
    spark.sql(rows).write.parquet(f"{one}/sub/events.parquet")
    for folder in (one, f"{one}/", f"file://{one}", f"{tmp_path}/parts", f"{tmp_path}/columns", f"{tmp_path}/o*e"):
        got = live.drained(live.event_stream(spark, folder).select("event_id", "user_id", "event_type", "value"), "append", "event_id int, user_id int, event_type string, value double").drop("batch")
        assert sorted(map(tuple, got.collect())) == [(1, 7, "view", 1.5), (2, None, "a b", None)]


def test_events_of_one_file_are_taken_once(spark, tmp_path):
    from marginalia.plans.logs import stream_dedup

    path = one_file(spark, tmp_path, EVENTS % "(1L, '2024-01-01', 7L, 'view', 1.5D), (2L, '2024-01-09', 7L, null, 1D), (3L, null, null, 'view', null)")
    assert sorted(map(tuple, stream_dedup(spark, path).collect())) == [(1, "view"), (2, None), (3, "view")]


def test_users_of_one_file_are_folded(spark, tmp_path):
    from marginalia.plans.logs import stream_keyed_fold

    path = one_file(spark, tmp_path, EVENTS % "(1L, '2024-01-01', 7L, 'view', 1.5D), (2L, '2024-01-09', 7L, 'view', 1D), (3L, null, null, 'view', null)")
    assert sorted(map(tuple, stream_keyed_fold(spark, path).collect()), key=str) == [(7, 2, 2.5, 1704758400000), (None, 1, None, None)]


def test_sessions_of_one_file_part_at_the_gap(spark, tmp_path):
    """Silence of half an hour parts, a microsecond less does not; events without a user or a time have sessions too."""
    from marginalia.plans.logs import stream_sessions

    rows = "(1L, '2024-01-01 00:00:00', 7L, 'x', 1D), (2L, '2024-01-01 00:29:59.999999', 7L, 'x', 1D), (3L, '2024-01-01 00:59:59.999999', 7L, 'x', 1D), (4L, '2024-01-01 00:10:00', 8L, 'x', 1D), (5L, '2024-01-09 00:00:00', null, 'x', 1D), (6L, '2024-01-09 00:01:00', null, 'x', 1D), (7L, null, 8L, 'x', 1D), (8L, null, 8L, 'x', 1D)"
    got = stream_sessions(spark, one_file(spark, tmp_path, EVENTS % rows)).collect()
    assert sorted(map(tuple, got), key=str) == [(7, 1704067200000, 2), (7, 1704070799999, 1), (8, 1704067800000, 1), (8, None, 1), (8, None, 1), (None, 1704758400000, 2)]


def test_windows_of_one_file_and_events_without_a_time(spark, tmp_path):
    from marginalia.plans.logs import stream_tumbling

    rows = "(1L, '2024-01-01 00:00:00', 7L, 'x', 1D), (2L, '2024-01-01 23:59:59.999999', 7L, 'x', 2D), (3L, '2024-01-02 00:00:00', 7L, 'x', null), (4L, null, 8L, 'x', 1D), (5L, null, 8L, 'x', 1.5D), (6L, null, 8L, null, null)"
    got = stream_tumbling(spark, one_file(spark, tmp_path, EVENTS % rows)).collect()
    assert sorted(map(tuple, got), key=str) == [(1704067200000, "x", 2, 3.0), (1704153600000, "x", 1, None), (None, "x", 2, 2.5), (None, None, 1, None)]
