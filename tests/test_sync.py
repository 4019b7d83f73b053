"""The log replayed into tables, bucketed tables that grow by segments, and synchronisation in parts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import entities as ent
from marginalia.sources import eventlog
from marginalia.sources.buckets import Buckets
from marginalia.streaming import sync as sync_module
from marginalia.streaming.sync import Sync


def line(type_, id_, ts, data, device="d1", **refs):
    return json.dumps({"id": id_, "type": type_, "deviceId": device, "timestamp": ts, **refs, "data": data})


def replay(events):
    """A plain replay, an event at a time, of workspaces and conversations: what the tables must be."""
    spaces, talks = {}, {}
    for e in sorted({e["id"]: e for e in events}.values(), key=lambda e: (e["timestamp"], e["id"])):
        d = e["data"]
        if e["type"] == "workspace_created" and d.get("id") and d.get("name"):
            made = d.get("created") if d.get("created") is not None else e["timestamp"]
            spaces[d["id"]] = [d["name"], d.get("description"), made, made, 0]
        elif e["type"] == "workspace_updated" and e.get("workspaceId") in spaces and not ("name" in d and d["name"] is None):
            row = spaces[e["workspaceId"]]
            for k, at in (("name", 0), ("description", 1), ("lastAccessed", 3)):
                if k in d:
                    row[at] = d[k]
            if "isActive" in d:
                row[4] = int(bool(d["isActive"]))
        elif e["type"] == "workspace_deleted":
            spaces.pop(e["workspaceId"], None)
        elif e["type"] == "metadata":
            talks[d["id"]] = [d["title"], d["created"], 0]
        elif e["type"] == "conversation_updated" and e["conversationId"] in talks:
            talks[e["conversationId"]][0] = d.get("title", talks[e["conversationId"]][0])
            talks[e["conversationId"]][1] = d.get("updated", talks[e["conversationId"]][1])
        elif e["type"] == "message" and e["conversationId"] in talks:
            talks[e["conversationId"]][1] = e["timestamp"]
            talks[e["conversationId"]][2] += 1
        elif e["type"] == "deleted" and e["entity"] == "conversations":
            talks.pop(e["entityId"], None)
    return sorted((k, *v) for k, v in spaces.items()), sorted((k, *v) for k, v in talks.items())


def random_events(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ts, key = rng.randrange(40), rng.choice("ab")
        out.append(rng.choice([
            line("workspace_created", f"e{i}", ts, {"id": key, "name": f"n{i}", **rng.choice([{}, {"created": i}, {"description": "x", "created": None}])}),
            line("workspace_created", f"e{i}", ts, {"id": key}),
            line("workspace_updated", f"e{i}", ts, rng.choice([{"name": f"u{i}"}, {"name": None, "isActive": True}, {"description": None}, {"lastAccessed": i, "isActive": rng.random() < 0.5}, {}]), workspaceId=key),
            line("workspace_deleted", f"e{i}", ts, {}, workspaceId=key),
            line("metadata", f"e{i}", ts, {"id": key, "title": f"t{i}", "created": i, "vault": "v"}),
            line("conversation_updated", f"e{i}", ts, rng.choice([{"title": f"c{i}"}, {"updated": i}]), conversationId=key),
            line("message", f"e{i}", ts, {"id": f"m{i}", "role": "user", "sequenceNumber": 1}, conversationId=key),
            line("message", f"e{i}", ts, {"id": f"m{i}", "role": "user", "sequenceNumber": 1}, conversationId=key),
            line("deleted", f"e{i}", ts, {}, entity="conversations", entityId=key),
        ]))
    return out


def shown(tables):
    spaces = tables["workspaces"].select("id", "name", "description", "created", "last_accessed", "is_active")
    talks = tables["conversations"].select("id", "title", "updated", "message_count")
    return sorted(map(tuple, spaces.collect())), sorted(map(tuple, talks.collect()))


def read(spark, lines):
    return eventlog.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), ent.ENVELOPE)


@pytest.mark.parametrize("seed", range(4))
def test_tables_are_those_of_a_replay(spark, seed):
    lines = random_events(60, seed)
    assert shown(ent.tables(read(spark, lines + lines[:7]))) == replay(map(json.loads, lines))


def test_events_that_cannot_be_applied(spark):
    lines = [
        line("workspace_created", "1", 1, {"id": "a"}), line("workspace_created", "2", 1, {"id": "a", "name": ""}), line("workspace_updated", "3", 1, {"name": None}, workspaceId="a"), line("song", "4", 1, {}),
        line("message", "5", 1, {"id": "m", "role": "user"}, conversationId="c"), line("state_deleted", "6", 1, {}), line("deleted", "7", None, {}, entity="sessions", entityId="s"), line("metadata", "8", 1, None), line("workspace_created", "9", 1, {"id": "a", "name": "x"}),
    ]
    why = {r["id"]: r["why"] for r in ent.rejected(read(spark, lines)).collect()}
    assert why == {"1": "no name", "2": "no name", "3": "null name", "4": "unknown type", "5": "no sequence_number", "6": "no key", "7": "no timestamp", "8": "no key"}
    assert [r["name"] for r in ent.tables(read(spark, lines))["workspaces"].collect()] == ["x"]
    assert all(df.collect() == [] for df in ent.tables(read(spark, [])).values())


def test_parts_in_any_order_give_the_rebuild(spark, tmp_path, monkeypatch):
    lines = random_events(90, 11)
    log = tmp_path / "log"
    log.mkdir()
    store = Sync(spark, f"file://{tmp_path}/store", buckets=4)
    parts = [lines[60:], lines[:30], lines[60:], lines[30:60] + lines[:5] + ["", "not json", "[1]"]]
    monkeypatch.setattr("marginalia.sources.buckets.SEGMENTS", 2)  # so that buckets are folded on the way
    for i, part in enumerate(parts):
        (log / f"{i}.jsonl").write_text("\n".join(part) + "\n")
        store.drain(f"file://{log}")
    assert shown(store.tables()) == replay(map(json.loads, lines))
    assert any(v % 2 == 0 for v in store.accounts.versions())
    row = store.devices().first()
    assert (row["applied"], row["skipped"]) == (90, 35)
    assert store.since(-1).count() == 90 and store.since(30).count() == sum(json.loads(x)["timestamp"] > 30 for x in lines)
    store.drain(f"file://{log}")  # nothing new
    assert store.devices().first()["skipped"] == 35


def test_a_batch_done_again_changes_nothing(spark, tmp_path):
    lines = random_events(40, 5)
    df = lambda part: spark.createDataFrame([(x,) for x in part], "value string")
    store = Sync(spark, f"file://{tmp_path}", own="d9", buckets=3)
    store.apply(df(lines[:20] + [line("workspace_created", "own", 1, {"id": "z", "name": "z"}, device="d9")]), 1)
    once = shown(store.tables())
    store.apply(df(lines[20:]), 3)
    whole = shown(store.tables())
    store.apply(df(lines[20:]), 3)  # as after a failure before the stream noted it
    assert shown(store.tables()) == whole == replay(map(json.loads, lines))
    assert store.devices().first()["applied"] == 40
    assert once != whole
    store.compact(4)
    store.compact(4)
    assert shown(store.tables()) == whole


def test_a_batch_that_fails_midway_is_done_again(spark, tmp_path, monkeypatch):
    lines = random_events(30, 6)
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.jsonl").write_text("\n".join(lines))
    store = Sync(spark, f"file://{tmp_path}/store", buckets=2)
    real = sync_module.Buckets.add

    def failing(self, rows, version):
        if self.keys == ["id"]:
            raise OSError("lost")
        return real(self, rows, version)

    monkeypatch.setattr(sync_module.Buckets, "add", failing)
    with pytest.raises(Exception, match="lost"):
        store.drain(f"file://{log}")
    monkeypatch.undo()
    store.drain(f"file://{log}")
    assert shown(store.tables()) == replay(map(json.loads, lines))
    assert store.devices().first()["applied"] == 30


def test_buckets_read_only_what_was_touched(spark, tmp_path):
    table = Buckets(spark, f"file://{tmp_path}/t", "k string, n long", ["k"], 8)
    df = lambda *rows: spark.createDataFrame(rows, "k string, n long")
    assert table.read().collect() == [] and table.manifest() == {}
    table.add(df(*((f"k{i}", i) for i in range(50))), 1)
    touched = table.add(df(("k3", 100)), 2)
    assert touched == table.buckets_of(df(("k3", 0))) and len(touched) == 1
    found = table.lookup(df(("k3", 0)))
    assert {r["bucket"] for r in found.collect()} == set(touched)
    assert len(found.inputFiles()) == 2 and all("bucket=%d" % touched[0] in f for f in found.inputFiles())
    assert table.read(upto=1).count() == 50 and table.read().count() == 51
    table.compact(3, lambda rows: rows.groupBy("bucket", "k").agg(F.max("n").alias("n")))
    assert {r["k"]: r["n"] for r in table.read().collect()} == {f"k{i}": 100 if i == 3 else i for i in range(50)}
    assert len(table.lookup(df(("k3", 0))).inputFiles()) == 1
    table.forget(3)
    assert table.read().count() == 50 and table.versions() == [3]
    assert not list((tmp_path / "t/rows/version=1").glob(f"bucket={touched[0]}/*.parquet"))


def test_lines_that_cannot_be_read_are_kept(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1","type":"x"}\n\nnot json\n{"type":"y"}\n')
    (tmp_path / "b.jsonl").write_text('[1,2]\n{"id":"2"}')
    bad = sorted((r["file"][-7:], r["line"], r["why"]) for r in eventlog.unread(spark, f"file://{tmp_path}").collect())
    assert bad == [("a.jsonl", 3, "no JSON object of an event"), ("a.jsonl", 4, "no id"), ("b.jsonl", 1, "no JSON object of an event")]
    lines = sum(bool(x.strip()) for f in ("a", "b") for x in (tmp_path / f"{f}.jsonl").read_text().split("\n"))
    assert eventlog.read_log(spark, f"file://{tmp_path}").count() + len(bad) == lines
