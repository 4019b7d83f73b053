"""The event log folded into tables, in batches and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import events as ev
from marginalia.plans.registry import query
from marginalia.sources.tables import activity, load, messages, with_views
from marginalia.streaming import binding, live, wire


def log(spark: SparkSession, sf: str) -> DataFrame:
    """Activity as entity events: signups create, errors with k over 50 delete, the rest change a field or two."""
    name = F.when(F.col("type").isin("signup", "purchase"), F.concat(F.lit("n"), F.col("id").cast("string")))
    patch = F.when(F.col("type") == "view", F.lit('{"note":null}')).when(F.col("type") == "click", F.to_json(F.struct(F.concat(F.lit("c"), F.col("id").cast("string")).alias("note")))).otherwise(F.to_json(F.struct(name.alias("name"))))
    return activity(spark, sf).select("id", "ms", "workspace", "type", patch.alias("patch"), (F.col("type") == "signup").alias("is_create"), ((F.col("type") == "error") & (F.col("k") > 50)).alias("is_delete"))


_LWW = "(SELECT workspace, max(CASE WHEN field = 'name' AND r = 1 THEN v END) AS name, max(CASE WHEN field = 'note' AND r = 1 THEN v END) AS note FROM (SELECT *, row_number() OVER (PARTITION BY workspace, field ORDER BY ms DESC, id DESC) AS r FROM (SELECT workspace, id, ms, 'name' AS field, 'n' || id AS v FROM activity WHERE type IN ('signup', 'purchase') UNION ALL SELECT workspace, id, ms, 'note', CASE WHEN type = 'click' THEN 'c' || id END FROM activity WHERE type IN ('click', 'view'))) GROUP BY workspace)"


@query("event_fold", with_views(f"SELECT l.workspace, name, note, changes FROM {_LWW} l JOIN (SELECT workspace, count(*) AS changes, max(CASE WHEN type = 'signup' THEN (ms, id) END) AS born, max(CASE WHEN type = 'error' AND k > 50 THEN (ms, id) END) AS gone FROM activity GROUP BY workspace) b ON l.workspace = b.workspace WHERE born IS NOT NULL AND (gone IS NULL OR born > gone)"))
def event_fold(spark: SparkSession, sf: str) -> DataFrame:
    return ev.folded(log(spark, sf), "workspace", "patch", ["name", "note"])


@query("event_type_counts", with_views("SELECT type, device, count(*) AS items, min(ms) AS first_ms FROM activity GROUP BY type, device"))
def event_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return activity(spark, sf).groupBy("type", "device").agg(F.count(F.lit(1)).alias("items"), F.min("ms").alias("first_ms"))


@query("latest_per_key", with_views("SELECT workspace, type, id, value FROM (SELECT *, row_number() OVER (PARTITION BY workspace, type ORDER BY ms DESC, id DESC) AS r FROM activity) WHERE r = 1"))
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return ev.latest(activity(spark, sf).select("workspace", "type", "id", "ms", "value"), ["workspace", "type"], ["ms", "id"]).select("workspace", "type", "id", "value")


@query("field_lww", with_views(f"SELECT workspace, name, note FROM {_LWW} l"))
def field_lww(spark: SparkSession, sf: str) -> DataFrame:
    own, order = log(spark, sf), ("ms", "id")
    changes = own.where("type <> 'error'")
    return changes.groupBy("workspace").agg(*(ev.last_where(F.get_json_object("patch", f"$.{f}"), ev.given("patch", f), order).alias(f) for f in ("name", "note")))


@query("tombstone", with_views("SELECT workspace, id, type FROM activity a LEFT JOIN (SELECT workspace AS w, max(ms) AS deleted_ms FROM activity WHERE type = 'error' AND k > 50 GROUP BY workspace) ON workspace = w WHERE type <> 'error' AND (deleted_ms IS NULL OR ms > deleted_ms)"))
def tombstone(spark: SparkSession, sf: str) -> DataFrame:
    own = log(spark, sf)
    deletes = own.where("is_delete").select("workspace", F.col("ms").alias("deleted_ms"))
    return ev.without_deleted(own.where("type <> 'error'"), deletes, "workspace").select("workspace", "id", "type")


@query("fragment_concat", with_views("SELECT conv_id, role, string_agg(content, '' ORDER BY seq) AS arguments, count(*) AS fragments FROM messages GROUP BY conv_id, role"))
def fragment_concat(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments of a call joined in order of arrival."""
    parts = messages(spark, sf).select("conv_id", "role", "seq", F.col("content").alias("part"))
    packed = parts.groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(F.struct("seq", "part"))).alias("all"))
    return packed.select("conv_id", "role", F.array_join(F.transform("all", lambda x: x["part"]), "").alias("arguments"), F.size("all").cast("long").alias("fragments"))


@query("throttle", with_views("SELECT id, CAST(running AS BIGINT) AS running FROM (SELECT id, length(content) AS n, sum(length(content)) OVER (PARTITION BY conv_id ORDER BY seq) AS running FROM messages) WHERE floor(running / 500) > floor((running - n) / 500)"))
def throttle(spark: SparkSession, sf: str) -> DataFrame:
    sized = messages(spark, sf).select("id", "conv_id", "seq", F.length("content").cast("long").alias("n"))
    return ev.throttled(sized, "conv_id", "seq", "n", 500, F.floor(F.col("seq") / 4)).select("id", "running")


@query("gap_sessions", with_views("SELECT workspace, CAST(s AS BIGINT) AS session, count(*) AS items, min(ms) AS begun, max(ms) AS ended FROM (SELECT workspace, ms, sum(n) OVER (PARTITION BY workspace ORDER BY ms, id) AS s FROM (SELECT workspace, id, ms, CASE WHEN coalesce(ms - lag(ms) OVER (PARTITION BY workspace ORDER BY ms, id) > 1800000, TRUE) THEN 1 ELSE 0 END AS n FROM activity)) GROUP BY workspace, s"))
def gap_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return ev.gap_sessions(activity(spark, sf).select("workspace", "id", "ms"), "workspace", 1_800_000, 7 * 86_400_000)


@query("export_finetune", with_views("SELECT conv_id, to_json({'messages': list({'role': role, 'content': content} ORDER BY seq)})::VARCHAR AS line FROM messages WHERE role <> 'system' GROUP BY conv_id"))
def export_finetune(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON line for each conversation that has messages besides the system's."""
    own = messages(spark, sf).where("role <> 'system'")
    packed = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))).alias("all"))
    turns = F.transform("all", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return packed.select("conv_id", F.to_json(F.struct(turns.alias("messages"))).alias("line"))


@query("stream_dedup", "SELECT event_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every event sent twice and taken once."""
    twice = live.event_stream(spark, sf).withColumn("sent", F.explode(F.array(F.lit(1), F.lit(2))))
    return live.drained(live.deduplicated(twice, "event_id").select("event_id", "event_type"), "append", "event_id long, event_type string").select("event_id", "event_type")


@query("stream_tumbling", "SELECT epoch_ms(date_trunc('day', ts)) AS begins, event_type, count(*) AS items, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    updates = live.drained(live.tumbling_counts(live.event_stream(spark, sf)), "update", "begins long, event_type string, items long, total double")
    untimed = updates.where("begins is null").groupBy("begins", "event_type").agg(F.sum("items").alias("items"), F.sum("total").alias("total"))
    return live.newest(updates.where("begins is not null"), ["begins", "event_type"]).unionByName(untimed).withColumn("total", F.round("total", 4))


@query("stream_keyed_fold", "SELECT user_id, count(*) AS items, round(sum(value), 4) AS total, max(epoch_us(ts) // 1000) AS last_ms FROM events GROUP BY user_id")
def stream_keyed_fold(spark: SparkSession, sf: str) -> DataFrame:
    updates = live.drained(live.keyed_fold(live.event_stream(spark, sf)), "update", "user_id long, items long, total double, last_ms long")
    return live.newest(updates, ["user_id"]).withColumn("total", F.round("total", 4))


@query("stream_sessions", "SELECT user_id, epoch_us(min(ts)) // 1000 AS begun, count(*) AS items FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, TRUE) THEN 1 ELSE 0 END AS n FROM events)) GROUP BY user_id, s")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of a stream, parted where a user is silent for half an hour: each once, when the watermark has passed it; a last tick closes those that are open when the stream ends."""
    folder = live.shared_dir(spark)
    ticks = spark.createDataFrame([], "user_id long, ts timestamp")
    ticks.write.parquet(f"{folder}/ticks")
    events = lambda: live.event_stream(spark, sf).select("user_id", "ts").unionByName(spark.readStream.schema(ticks.schema).parquet(f"{folder}/ticks"))
    run = lambda: live.drained(live.session_counts(events()), "append", "user_id long, begun long, items long", folder)
    run()
    last = load(spark, sf, "events").agg((F.max("ts") + F.expr("interval 2 days")).cast("timestamp").alias("ts"))
    last.where("ts is not null").select(F.lit(None).cast("long").alias("user_id"), "ts").write.mode("append").parquet(f"{folder}/ticks")
    return run().select("user_id", "begun", "items")  # the tick's own session stays open


@query("stream_late", "WITH m AS (SELECT max(epoch_us(ts)) // 1000 * 1000 - 86400000000 AS mark FROM events WHERE event_id % 2 = 0) SELECT event_id % 2 AS run, count(*) AS came, CAST(sum(CASE WHEN event_id % 2 = 1 AND epoch_us(ts) <= mark THEN 1 ELSE 0 END) AS BIGINT) AS dropped FROM events, m GROUP BY 1")
def stream_late(spark: SparkSession, sf: str) -> DataFrame:
    """Every second event comes in a later batch, when the watermark has passed most days: how many rows each batch dropped, from the table that a listener keeps."""
    folder = live.shared_dir(spark)
    own = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    with live.late_rows(spark, f"{folder}/late"):
        for batch, half in enumerate((own.where("event_id % 2 = 0"), own.where("event_id % 2 = 1"))):
            half.coalesce(1).write.parquet(f"{folder}/in/half={batch}")
            live.drained(live.deduplicated(spark.readStream.schema(own.schema).parquet(f"{folder}/in/*"), "event_id").select("event_id"), "append", "event_id long", folder)
    runs = spark.read.schema(live.LATE).json(f"{folder}/late").where("rows > 0")
    first = runs.agg(F.min("batch")).scalar()
    return runs.groupBy((F.col("batch") > first).cast("long").alias("run")).agg(F.sum("rows").alias("came"), F.sum("dropped").alias("dropped"))


@query("stream_fragments", "SELECT conv_id || '' AS call, string_agg(text, '' ORDER BY turn) AS text, count(*) AS fragments FROM conversations GROUP BY conv_id HAVING count(*) = max(turn) + 1")
def stream_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation as fragments of one call; a call of which a fragment is missing stays open."""
    ends = load(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("end"))
    rows = live.table_stream(spark, sf, "conversations").join(ends, "conv_id")
    parts = rows.select(F.col("conv_id").cast("string").alias("call"), F.col("turn").alias("seq"), F.col("text").alias("part"), (F.col("turn") == F.col("end")).alias("last"))
    return live.drained(live.fragment_fold(parts), "append", "call string, text string, fragments long").select("call", "text", "fragments")


_H = 3_600_000

def captured(spark: SparkSession, sf: str) -> DataFrame:
    """(stream, n, ts, chunk): responses cut into chunks of 300 characters, a second apart and an hour from response to response."""
    turns = load(spark, sf, "conversations")
    said = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    fragment = F.struct((F.col("turn") % 2).alias("index"), F.concat(F.lit("c"), (F.col("turn") % 2).cast("string")).alias("id"), F.struct(F.concat(F.lit("f"), F.col("turn").cast("string")).alias("name"), F.col("text").alias("arguments")).alias("function"))
    call = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(fragment).alias("tool_calls")).alias("delta"))).alias("choices")))
    frame = F.when(F.col("role") == "user", F.concat(F.lit("data: "), said)).when(F.col("role") == "assistant", F.concat(F.lit("event: x\r\ndata:"), call)).otherwise(F.lit(": note\ndata: (oops"))
    frames = turns.select("conv_id", "turn", F.concat(frame, F.lit("\n\n")).alias("frame"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "frame"))), lambda x: x["frame"]), "")
    usage = F.concat(F.lit('data: {"usage":{"prompt_tokens":'), F.col("conv_id").cast("string"), F.lit(',"completion_tokens":2}}\n\n'))
    ends = F.when(F.col("conv_id") % 4 == 0, 'data: {"choices":[{"finish_reason":"stop","delta":{}}]}\n\ndata: {"choices":[{"delta":{"content":"late"}}]}\n\n').when(F.col("conv_id") % 4 < 3, "data: [DONE]\r\n\r\n").otherwise("")
    whole = frames.groupBy("conv_id").agg(told.alias("told")).withColumn("told", F.concat("told", usage, ends))
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("told") - 1) / 300)), lambda k: F.substring(F.col("told"), (k * 300 + 1).cast("int"), F.lit(300)))).alias("n", "chunk")
    pieces = whole.select("conv_id", cut)
    at = F.timestamp_millis(F.lit(1704067200000) + F.col("conv_id") * _H + F.col("n") * 1000)
    return pieces.select(F.col("conv_id").cast("string").alias("stream"), F.col("n").cast("long").alias("n"), at.alias("ts"), "chunk", "conv_id")


@query("stream_wire", f"""WITH last AS (SELECT max(conv_id) AS top FROM conversations), c AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN text END, '' ORDER BY turn) AS content, count(*) FILTER (role NOT IN ('user', 'assistant')) AS bad, count(*) AS turns,
  string_agg(CASE WHEN role = 'assistant' AND turn % 2 = 0 THEN text END, '' ORDER BY turn) AS even, string_agg(CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN text END, '' ORDER BY turn) AS odd,
  max(CASE WHEN role = 'assistant' AND turn % 2 = 0 THEN turn END) AS te, max(CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN turn END) AS to_ FROM conversations GROUP BY conv_id)
SELECT conv_id || '' AS stream, coalesce(content, '') AS content, concat_ws(';', '0:c0:f' || te || ':' || even, '1:c1:f' || to_ || ':' || odd) AS calls, conv_id AS prompt_tokens, CASE conv_id % 4 WHEN 0 THEN 'stop' WHEN 3 THEN 'expired' ELSE 'done' END AS ending, turns + CASE WHEN conv_id % 4 = 3 THEN 1 ELSE 2 END AS events, bad
FROM c, last WHERE conv_id % 4 < 3 OR conv_id + 4 <= top""")
def stream_wire(spark: SparkSession, sf: str) -> DataFrame:
    """Answers put together from captured chunks, which come in two runs of a stream, some of them late and some twice; answers without an end expire."""
    folder = live.shared_dir(spark)
    own = captured(spark, sf)
    half = own.agg(F.floor(F.max("conv_id") / 2)).scalar()
    dealt = own.withColumn("second", (F.col("conv_id") > half) | ((F.col("conv_id") == half) & (F.col("n") % 2 == 1)))
    dealt.drop("conv_id").write.parquet(f"{folder}/all")
    chunks = spark.read.parquet(f"{folder}/all")
    stream = lambda: spark.readStream.schema(wire.CHUNKS).json(f"{folder}/in")
    for run in (chunks.where("not second"), chunks.where("second or n = 0")):
        run.drop("second").write.mode("append").json(f"{folder}/in")
        found = live.drained(wire.answers(stream(), 5_400_000), "append", wire.ANSWER, folder)
    calls = F.array_join(F.transform("calls", lambda c: F.concat_ws(":", c["index"].cast("string"), c["id"], c["name"], c["arguments"])), ";")
    return found.select("stream", "content", calls.alias("calls"), "prompt_tokens", "ending", "events", "bad")


@query("stream_binding", """WITH c AS (SELECT event_id AS id, ts, user_id, k, CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'plan ' || user_id ELSE 's-' || strftime(ts, '%Y%m%d') || lpad(user_id || '', 6, '0') END AS session, CASE WHEN k > 30 THEN 'w' || k % 3 END AS workspace, user_id % 10 = 3 AS there FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
b AS (SELECT *, CASE WHEN there THEN 'w9' ELSE first_value(workspace IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, id ROWS UNBOUNDED PRECEDING) END AS held, NOT there AND row_number() OVER (PARTITION BY session ORDER BY ts, id) = 1 AS made FROM c WHERE k % 4 > 1)
SELECT id, 's-' || strftime(ts, '%Y%m%d%H%M%S') || '-' || id AS session_id, CASE session WHEN '' THEN 'Default Session' ELSE session END AS name, TRUE AS created, workspace, FALSE AS refused FROM c WHERE k % 4 < 2
UNION ALL SELECT id, session, CASE WHEN made THEN 'Session ' || session END, made, held, workspace IS NOT NULL AND workspace <> held FROM b""")
def stream_binding(spark: SparkSession, sf: str) -> DataFrame:
    """Events as calls that name a session by id, by a friendly name or not at all, in two runs of a stream; a tenth of the users have sessions already."""
    folder = live.shared_dir(spark)
    e = load(spark, sf, "events").withColumns({"ts": F.col("ts").cast("timestamp"), "k": F.get_json_object("props", "$.k").cast("long")})
    own = F.concat(F.lit("s-"), F.date_format("ts", "yyyyMMdd"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    named = F.when(F.col("k") % 4 == 0, "").when(F.col("k") % 4 == 1, F.concat(F.lit("plan "), F.col("user_id").cast("string"))).otherwise(own)
    calls = e.select(F.col("event_id").alias("id"), "ts", named.alias("session"), F.when(F.col("k") > 30, F.concat(F.lit("w"), (F.col("k") % 3).cast("string"))).alias("workspace"))
    known = e.where("user_id % 10 = 3").select(own.alias("session_id"), F.lit("w9").alias("workspace")).distinct()
    middle = e.agg(F.min("ts") + (F.max("ts") - F.min("ts")) / 2).scalar()
    for second in (False, True):
        calls.where((F.col("ts") >= middle) == F.lit(second)).write.parquet(f"{folder}/in/second={second}")
        found = live.drained(binding.bound(spark.readStream.schema(binding.CALLS).parquet(f"{folder}/in/*"), known), "append", binding.BOUND, folder)
    return found.drop("batch")
