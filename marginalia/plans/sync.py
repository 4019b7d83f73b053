"""Tables rebuilt from a log of JSON lines, at once and in parts. The log is made from the stored tables and written, read and replayed whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import entities as ent
from marginalia.plans.registry import query
from marginalia.sources import eventlog
from marginalia.sources.tables import load
from marginalia.streaming import live
from marginalia.streaming.sync import Sync

#: Events from the tables: suppliers are workspaces, customers sessions, parts states, events traces and changes of workspaces, turns messages.
#: Each is (type, number that gives id and device, time, references, data, table, condition), in SQL that both engines read; references and data are JSON, so that null and absent differ.
T0 = 1704067200000
#: The names of files that Spark writes lines to.
TEXT = "*.txt"
_SOURCES = [
    ("workspace_created", "s_suppkey * 10", f"{T0} + s_suppkey", "", """'{"id":"w' || s_suppkey || '","name":"' || s_name || '","rootFolder":"r' || s_nationkey || '","created":' || (1704067200000 + s_suppkey) || CASE WHEN s_suppkey % 2 = 0 THEN ',"dedicatedAgentId":"a' || s_nationkey || '"' ELSE '' END || '}'""", "supplier", "true"),
    ("workspace_created", "event_id * 10 + 1", "ms", "", """'{"id":"w' || user_id || '","name":"again ' || event_id || '"' || CASE WHEN k > 50 THEN ',"created":' || ms ELSE '' END || '}'""", "act", "event_type = 'signup' AND k > 30"),
    ("workspace_created", "event_id * 10 + 2", "ms", "", """'{"id":"w' || user_id || '"}'""", "act", "event_type = 'signup' AND k <= 30"),
    ("workspace_updated", "event_id * 10 + 3", "ms", """',"workspaceId":"w' || user_id || '"'""", """'{"lastAccessed":' || ms || ',"isActive":' || CASE WHEN k > 50 THEN 'true' ELSE 'false' END || '}'""", "act", "event_type = 'view'"),
    ("workspace_updated", "event_id * 10 + 4", "ms", """',"workspaceId":"w' || user_id || '"'""", """CASE WHEN k < 20 THEN '{"description":null}' WHEN k > 95 THEN '{"name":null,"description":"lost"}' ELSE '{"description":"c' || event_id || '"}' END""", "act", "event_type = 'click'"),
    ("workspace_deleted", "event_id * 10 + 5", "ms", """',"workspaceId":"w' || user_id || '"'""", "'{}'", "act", "event_type = 'error' AND k > 60"),
    ("session_created", "c_custkey * 10 + 6", f"{T0} + c_custkey", """',"workspaceId":"w' || c_custkey % 100 || '"'""", """'{"id":"s' || c_custkey || '","name":"' || c_mktsegment || '","startTime":' || (1704067200000 + c_custkey) || '}'""", "customer", "true"),
    ("session_updated", "c_custkey * 10 + 7", f"{T0} + 500000 + c_custkey % 1000", """',"workspaceId":"w1","sessionId":"s' || c_custkey || '"'""", """'{"endTime":' || (1704067200000 + 2 * c_custkey) || ',"isActive":false' || CASE WHEN c_nationkey % 3 = 0 THEN ',"description":"n' || c_nationkey || '"' ELSE '' END || '}'""", "customer", "c_acctbal < 3000"),
    ("deleted", "c_custkey * 10 + 8", f"{T0} + 600000", """',"entity":"sessions","entityId":"s' || c_custkey || '"'""", "'{}'", "customer", "c_nationkey = 3"),
    ("state_saved", "p_partkey * 100 + 9", f"{T0} + p_partkey", """',"workspaceId":"w' || p_size || '","sessionId":"s' || p_partkey || '"'""", """'{"id":"p' || p_partkey || '","name":"' || p_name || '","created":' || p_partkey || ',"stateJson":"{}","tags":["' || p_brand || '"]}'""", "part", "true"),
    ("state_deleted", "p_partkey * 100 + 19", f"{T0} + 900000", """',"stateId":"p' || p_partkey || '"'""", "'{}'", "part", "p_size > 40"),
    ("state_saved", "p_partkey * 100 + 29", f"{T0} + 900000 + CASE WHEN p_size > 45 THEN 1 ELSE -1 END", """',"workspaceId":"w0","sessionId":"s0"'""", """'{"id":"p' || p_partkey || '","name":"' || p_type || '","created":1}'""", "part", "p_size > 42"),
    ("trace_added", "event_id * 100 + 39", "ms", """',"workspaceId":"w' || user_id || '","sessionId":"s' || user_id || '"'""", """'{"id":"t' || event_id || '","content":"' || event_type || '","metadataJson":"k' || k || '"' || CASE WHEN k > 50 THEN ',"traceType":"tool"' ELSE '' END || '}'""", "act", "true"),
    ("deleted", "event_id * 100 + 49", "ms + 1", """',"entity":"memory_traces","entityId":"t' || event_id || '"'""", "'{}'", "act", "k = 7"),
    ("metadata", "conv_id * 100 + 59", f"{T0} + conv_id", "", """'{"id":"v' || conv_id || '","title":"talk ' || conv_id || '","created":' || (1704067200000 + conv_id) || ',"vault":"main","settings":{"k":' || conv_id || '}}'""", "talk", "true"),
    ("conversation_updated", "conv_id * 100 + 69", f"{T0} + conv_id % 7 * 120000", """',"conversationId":"v' || conv_id || '"'""", """CASE conv_id % 3 WHEN 0 THEN '{"title":"new ' || conv_id || '","updated":7}' WHEN 1 THEN '{"settings":null}' ELSE '{"settings":{"a":[1,2]}}' END""", "talk", "true"),
    ("metadata", "conv_id * 100 + 79", f"{T0} + 150000", "", """'{"id":"v' || conv_id || '","title":"reborn","created":5,"vault":"side"}'""", "talk", "conv_id % 5 = 2"),
    ("message", "conv_id * 100000 + turn * 10", f"{T0} + conv_id + turn * 60000", """',"conversationId":"v' || conv_id || '"'""", """'{"id":"m' || conv_id || ':' || turn || '","role":"' || role || '","content":"' || n || '","sequenceNumber":' || turn || '}'""", "turns", "true"),
    ("message_updated", "conv_id * 100000 + turn * 10 + 1", f"{T0} + conv_id + turn * 60000 + 5000", """',"conversationId":"v' || conv_id || '","messageId":"m' || conv_id || ':' || turn || '"'""", """CASE WHEN turn % 2 = 0 THEN '{"content":"edited","state":"aborted"}' ELSE '{"reasoning":"r","tool_calls":[{"id":"c"}],"tool_call_id":null}' END""", "turns", "turn % 3 = 1"),
    ("deleted", "conv_id * 100000 + turn * 10 + 2", f"{T0} + 90000000", """',"entity":"messages","entityId":"m' || conv_id || ':' || turn || '"'""", "'{}'", "turns", "turn % 7 = 6"),
]
_ROWS = [(t, f"'{chr(97 + i)}' || CAST({n} AS STRING)", f"'d' || CAST(({n}) % 3 AS STRING)", f"CAST({ms} AS BIGINT)", refs or "''", data, table, where) for i, (t, n, ms, refs, data, table, where) in enumerate(_SOURCES)]


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(value, ts, id): the log's lines."""
    events, turns = load(spark, sf, "events"), load(spark, sf, "conversations")
    own = {n: load(spark, sf, n) for n in ("supplier", "customer", "part")} | {
        "act": events.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k")),
        "talk": turns.select("conv_id").distinct(), "turns": turns.select("conv_id", "turn", "role", F.length("text").alias("n")),
    }
    parts = [own[table].where(where).select(F.lit(t).alias("type"), *(F.expr(x).alias(n) for x, n in ((id_, "id"), (device, "device"), (ts, "ts"), (refs, "refs"), (data, "data")))) for t, id_, device, ts, refs, data, table, where in _ROWS]
    log = parts[0]
    for part in parts[1:]:
        log = log.unionByName(part)
    line = F.concat(F.lit('{"id":"'), "id", F.lit('","type":"'), "type", F.lit('","deviceId":"'), "device", F.lit('","timestamp":'), F.col("ts").cast("string"), "refs", F.lit(',"data":'), "data", F.lit("}"))
    return log.select(line.alias("value"), "ts", "id")


def written_log(spark: SparkSession, sf: str) -> DataFrame:
    """The log, written as JSON lines and read back."""
    path = f"{live.shared_dir(spark)}/log"
    write_lines(log_lines(spark, sf), path)
    return eventlog.read_log(spark, path, ent.ENVELOPE, TEXT)


def write_lines(lines: DataFrame, path: str) -> None:
    """Adds a log's lines (value) as files."""
    lines.select("value").write.mode("append").option("lineSep", "\n").format("text").save(path)


_LOG = (
    "act AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), talk AS (SELECT DISTINCT conv_id FROM conversations), turns AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations), "
    "log AS (SELECT type, {'ts': ts, 'id': id} AS tid, ts, ('{' || substr(refs, 2) || '}')::JSON AS r, data::JSON AS d FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS type, {id_} AS id, {ts} AS ts, {refs} AS refs, {data} AS data FROM {table} WHERE {where}" for t, id_, _, ts, refs, data, table, where in _ROWS) + "))"
)


def replayed(name: str, makes: str, needs: str, changes: str | None, bad: str, deletes: str, columns: dict[str, tuple[str, str | None]], more: str = "", joined: str = "") -> str:
    """SQL that replays one entity: columns are (of the creation, field of changes)."""
    parts = [f"make AS (SELECT json_extract_string(d, '$.id') AS key, * FROM log WHERE type = '{makes}' AND {needs} QUALIFY row_number() OVER (PARTITION BY key ORDER BY tid DESC) = 1)", f"gone AS (SELECT key, max(tid) AS gone FROM ({deletes}) GROUP BY key)"]
    shown, joins = [], ["LEFT JOIN gone ON gone.key = make.key", joined]
    for column, (made, field) in columns.items():
        if field is None:
            shown.append(f"{made} AS {column}")
            continue
        value = f"json_extract_string(d, '$.{field}')"
        if column == "is_active":
            value = f"CASE WHEN {value} = 'true' THEN 1 ELSE 0 END"
        elif field == "settings":
            value = f"coalesce({value}, 'null')"
        elif field in ("lastAccessed", "endTime", "updated"):
            value = f"CAST({value} AS BIGINT)"
        ref = {"workspaces": "workspaceId", "sessions": "sessionId", "conversations": "conversationId", "messages": "messageId"}[name]
        parts.append(f"c_{column} AS (SELECT json_extract_string(r, '$.{ref}') AS key, max(tid) AS tid, arg_max({{'v': {value}}}, tid) AS v FROM log WHERE type = '{changes}' AND json_type(d, '$.{field}') IS NOT NULL AND NOT ({bad}) GROUP BY ALL)")
        joins.append(f"LEFT JOIN c_{column} ON c_{column}.key = make.key")
        shown.append(f"CASE WHEN c_{column}.tid > make.tid THEN c_{column}.v.v ELSE {made} END AS {column}")
    body = f"SELECT make.key AS id, {', '.join(shown)} FROM make {' '.join(joins)} WHERE gone IS NULL OR make.tid > gone"
    return f"WITH {_LOG}, {more}{', '.join(parts)} {body}"


def _d(field: str) -> str:
    return f"json_extract_string(make.d, '$.{field}')"


def _generic(name: str, own: str = "") -> str:
    return f"SELECT json_extract_string(r, '$.entityId') AS key, tid FROM log WHERE type = 'deleted' AND json_extract_string(r, '$.entity') = '{name}'{own}"


_OWN = " UNION ALL SELECT json_extract_string(r, '$.{}'), tid FROM log WHERE type = '{}'"
_REF = {c: f"json_extract_string(make.r, '$.{c}')" for c in ("workspaceId", "sessionId", "conversationId")}
SQL = {
    "workspaces": replayed("workspaces", "workspace_created", "json_extract_string(d, '$.name') IS NOT NULL", "workspace_updated", "coalesce(json_type(d, '$.name') = 'NULL', false)", _generic("workspaces", _OWN.format("workspaceId", "workspace_deleted")), {
        "name": (_d("name"), "name"), "description": ("NULL", "description"), "root_folder": (f"coalesce({_d('rootFolder')}, '')", None), "created": (f"coalesce(CAST({_d('created')} AS BIGINT), make.ts)", None),
        "last_accessed": (f"coalesce(CAST({_d('created')} AS BIGINT), make.ts)", "lastAccessed"), "is_active": ("0", "isActive"), "context_json": ("NULL::VARCHAR", None), "dedicated_agent_id": (_d("dedicatedAgentId"), None),
    }),
    "sessions": replayed("sessions", "session_created", "true", "session_updated", "false", _generic("sessions"), {
        "workspace_id": (_REF["workspaceId"], None), "name": (_d("name"), None), "description": ("NULL", "description"), "start_time": (f"CAST({_d('startTime')} AS BIGINT)", None), "end_time": ("NULL", "endTime"), "is_active": ("1", "isActive"),
    }),
    "states": replayed("states", "state_saved", "true", None, "", _generic("states", _OWN.format("stateId", "state_deleted")), {
        "session_id": (_REF["sessionId"], None), "workspace_id": (_REF["workspaceId"], None), "name": (_d("name"), None), "description": ("NULL::VARCHAR", None), "created": (f"CAST({_d('created')} AS BIGINT)", None), "state_json": (_d("stateJson"), None), "tags_json": (_d("tags"), None),
    }),
    "memory_traces": replayed("memory_traces", "trace_added", "true", None, "", _generic("memory_traces"), {
        "session_id": (_REF["sessionId"], None), "workspace_id": (_REF["workspaceId"], None), "timestamp": ("make.ts", None), "trace_type": (_d("traceType"), None), "content": (_d("content"), None), "metadata_json": (_d("metadataJson"), None),
    }),
    "conversations": replayed("conversations", "metadata", "true", "conversation_updated", "false", _generic("conversations"), {
        "title": (_d("title"), "title"), "created": (f"CAST({_d('created')} AS BIGINT)", None), "vault_name": (_d("vault"), None), "metadata_json": (_d("settings"), "settings"), "message_count": ("coalesce(n, 0)", None),
        "updated": (f"CASE WHEN touched.tid IS NOT NULL AND (set_at IS NULL OR touched.tid > set_at) THEN touched.ts WHEN set_at > make.tid THEN set_to ELSE CAST({_d('created')} AS BIGINT) END", None),
    }, "born AS (SELECT json_extract_string(d, '$.id') AS key, max(tid) AS tid FROM log WHERE type = 'metadata' GROUP BY key), touched AS (SELECT born.key, count(*) AS n, max(log.tid) AS tid, max(ts) AS ts FROM log JOIN born ON type = 'message' AND json_extract_string(r, '$.conversationId') = born.key AND log.tid > born.tid GROUP BY born.key), moved AS (SELECT json_extract_string(r, '$.conversationId') AS key, max(tid) AS set_at, arg_max(CAST(json_extract_string(d, '$.updated') AS BIGINT), tid) AS set_to FROM log WHERE type = 'conversation_updated' AND json_type(d, '$.updated') IS NOT NULL GROUP BY key), ", "LEFT JOIN touched ON touched.key = make.key LEFT JOIN moved ON moved.key = make.key"),
    "messages": replayed("messages", "message", "true", "message_updated", "false", _generic("messages"), {
        "conversation_id": (_REF["conversationId"], None), "role": (_d("role"), None), "content": (_d("content"), "content"), "timestamp": ("make.ts", None), "state": (f"coalesce({_d('state')}, 'complete')", "state"), "tool_calls_json": ("NULL", "tool_calls"),
        "tool_call_id": ("NULL", "tool_call_id"), "reasoning_content": ("NULL", "reasoning"), "sequence_number": (f"CAST({_d('sequenceNumber')} AS BIGINT)", None),
    }),
}


def _register(name: str) -> None:
    @query(f"table_{name}", SQL[name])
    def rebuilt(spark: SparkSession, sf: str) -> DataFrame:
        log = written_log(spark, sf)
        return ent.table(ent.accounts(log), name, ent.touches(log).distinct() if name == "conversations" else None)


for _name in SQL:
    _register(_name)


#: What all six tables have in common, to look at them together.
COMMON = {
    "workspaces": ("name", "last_accessed", "is_active"), "sessions": ("description", "end_time", "is_active"), "states": ("tags_json", "created", "NULL"),
    "memory_traces": ("trace_type", "timestamp", "NULL"), "conversations": ("title", "updated", "message_count"), "messages": ("content", "timestamp", "sequence_number"),
}


def _common(name: str, long: str) -> list[str]:
    label, at, n = COMMON[name]
    return [f"'{name}' AS entity", "id", f"{label} AS label", f"{at} AS at", f"CAST({n} AS {long}) AS n"]


def in_parts(spark: SparkSession, sf: str, folder: str, part: Column, order: tuple[int, ...]) -> Sync:
    """A store that the log's parts were synchronised into one after the other."""
    log_lines(spark, sf).withColumn("part", part).write.parquet(f"{folder}/lines")
    lines, sync = spark.read.parquet(f"{folder}/lines"), Sync(spark, f"{folder}/store")
    for n in order:
        write_lines(lines.where(F.col("part") == n), f"{folder}/log")
        sync.drain(f"{folder}/log", TEXT)
    return sync


@query("sync_in_parts", " UNION ALL ".join(f"SELECT {', '.join(_common(n, 'BIGINT'))} FROM ({sql})" for n, sql in SQL.items()))
def sync_in_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The log in three parts, the second sent twice and the first part's odd lines late: the six tables are those of a rebuild."""
    part = F.when(F.crc32("id") % 5 == 0, 2).when(F.col("ts") < T0 + 20 * 86_400_000, 0).otherwise(1)
    sync = in_parts(spark, sf, live.shared_dir(spark), part, (0, 1, 1, 2))
    found = [df.selectExpr(*_common(name, "BIGINT")) for name, df in sync.tables().items()]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


@query("sync_marks", f"WITH {_LOG} SELECT device, max(ts) AS last, count(*) AS applied, CAST(sum(CASE WHEN part = 1 THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM (SELECT type, tid.id AS id, ts, 'd' || (CAST(regexp_replace(tid.id, '[^0-9]', '', 'g') AS BIGINT) % 3) AS device, CASE WHEN ts < {T0} + 20 * 86400000 THEN 0 ELSE 1 END AS part FROM log) GROUP BY device")
def sync_marks(spark: SparkSession, sf: str) -> DataFrame:
    """What each device sent: the last time, events applied, and events that came again."""
    sync = in_parts(spark, sf, live.shared_dir(spark), F.when(F.col("ts") < T0 + 20 * 86_400_000, 0).otherwise(1), (0, 1, 1))
    return sync.devices()


@query("log_unread", f"WITH {_LOG} SELECT value, why FROM (SELECT CASE num % 10 WHEN 3 THEN '{{\"id\":\"' || id WHEN 4 THEN '[\"' || id || '\"]' ELSE '{{\"type\":\"' || type || '\"}}' END AS value, CASE WHEN num % 10 < 5 THEN 'no JSON object of an event' ELSE 'no id' END AS why, num FROM (SELECT type, tid.id AS id, CAST(regexp_replace(tid.id, '[^0-9]', '', 'g') AS BIGINT) AS num FROM log)) WHERE num % 10 IN (3, 4, 5)")
def log_unread(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that can't be read, with why, instead of silence; with those that can they are all of the log's lines."""
    number = F.regexp_replace("id", "[^0-9]", "").cast("long") % 10
    lines = log_lines(spark, sf)
    kind = F.get_json_object("value", "$.type")
    broken = F.when(number == 3, F.concat(F.lit('{"id":"'), "id")).when(number == 4, F.concat(F.lit('["'), "id", F.lit('"]'))).when(number == 5, F.concat(F.lit('{"type":"'), kind, F.lit('"}'))).otherwise(F.col("value"))
    path = f"{live.shared_dir(spark)}/log"
    write_lines(lines.select(broken.alias("value")), path)
    return eventlog.unread(spark, path, ent.ENVELOPE, TEXT).select("value", "why")


@query("log_files", f"WITH {_LOG} SELECT count(*) AS events, count(DISTINCT device) AS files FROM (SELECT CAST(regexp_replace(tid.id, '[^0-9]', '', 'g') AS BIGINT) % 3 AS device FROM log)")
def log_files(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of log files a device, and the statistics of the files: the number of devices and of events."""
    path = f"{live.shared_dir(spark)}/log"
    lines = log_lines(spark, sf).select("value", F.get_json_object("value", "$.deviceId").alias("device"))
    lines.hint("rebalance", "device").write.partitionBy("device").text(path)  # a device's lines are cut to files, each a task's
    stats = eventlog.file_stats(spark, path, TEXT)
    return stats.agg(F.sum("events").alias("events"), F.count_distinct(F.regexp_extract("path", "device=([^/]*)", 1)).alias("files"))


@query("tables_ask", f"SELECT c.title, m.role, count(*) AS messages, max(m.sequence_number) AS last FROM ({SQL['conversations']}) c JOIN ({SQL['messages']}) m ON m.conversation_id = c.id WHERE m.state = 'complete' AND c.title <> 'reborn' GROUP BY c.title, m.role HAVING count(*) >= 2")
def tables_ask(spark: SparkSession, sf: str) -> DataFrame:
    """SQL with parameters over the tables that the log has become."""
    tables = ent.tables(written_log(spark, sf))
    sql = "SELECT c.title, m.role, count(*) AS messages, max(m.sequence_number) AS last FROM {conversations} c JOIN {messages} m ON m.conversation_id = c.id WHERE m.state = :state AND c.title <> :title GROUP BY c.title, m.role HAVING count(*) >= :least"
    return ent.ask(tables, sql, state="complete", title="reborn", least=2)
