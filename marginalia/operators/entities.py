"""The event log replayed into six tables: workspaces, sessions, states, memory_traces, conversations, messages.

Every event is a creation (the whole row anew), a change of the fields that it gives (null where it gives null, absent fields stay), or a deletion of
one entity, in the order of (timestamp, id). What the log does to a row is kept as ``account`` rows: the last creation with what it said, the
last deletion, and for each field the last change. These are maxima, so accounts of parts of a log add up to the account of the whole log,
in whatever order the parts come, and however often. ``tables`` turns accounts into rows: an entity exists if its last creation is later
than its last deletion; a field has the value of its last change if that is later than the creation, else what the creation said.

A creation without a key or a field that must be there, and a change that sets such a field to null, aren't applied (``rejected``). Changes of rows
that don't exist do nothing. Parents aren't looked up, deletions don't cascade, and names needn't be unique. One shuffle by (entity, key).

A conversation also counts its messages since it was created (``touches``), and its time of change moves on with them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of an event besides data, which holds a JSON object.
ENVELOPE = "id string, type string, deviceId string, timestamp long, workspaceId string, sessionId string, conversationId string, stateId string, messageId string, entity string, entityId string, data string"


@dataclass(frozen=True)
class Field:
    """A column of a table: where a creation has it (a field of data, or of the event as ``@name``), what it is if absent, and whether changes may give it."""

    column: str
    source: str
    kind: str = "string"
    needed: bool = False
    default: str | None = None
    changes: bool = False


@dataclass(frozen=True)
class Entity:
    creates: str
    changes: str | None
    deletes: str | None
    ref: str | None
    fields: tuple[Field, ...]


#: The event types, columns and JSON names of the six tables, as logs have them.
ENTITIES = {
    "workspaces": Entity("workspace_created", "workspace_updated", "workspace_deleted", "workspaceId", (
        Field("id", "id", needed=True), Field("name", "name", needed=True, changes=True), Field("description", "description", changes=True), Field("root_folder", "rootFolder", needed=True, default="", changes=True),
        Field("created", "created", "long", True, "@timestamp"), Field("last_accessed", "created", "long", True, "@timestamp"), Field("is_active", "-", "flag", default="0"),
        Field("context_json", "contextJson", changes=True), Field("dedicated_agent_id", "dedicatedAgentId", changes=True),
    )),
    "sessions": Entity("session_created", "session_updated", None, "sessionId", (
        Field("id", "id", needed=True), Field("workspace_id", "@workspaceId", needed=True), Field("name", "name", needed=True, changes=True), Field("description", "description", changes=True),
        Field("start_time", "startTime", "long"), Field("end_time", "-", "long"), Field("is_active", "-", "flag", default="1"),
    )),
    "states": Entity("state_saved", None, "state_deleted", "stateId", (
        Field("id", "id", needed=True), Field("session_id", "@sessionId", needed=True), Field("workspace_id", "@workspaceId", needed=True), Field("name", "name", needed=True),
        Field("description", "description"), Field("created", "created", "long", True), Field("state_json", "stateJson"), Field("tags_json", "tags"),
    )),
    "memory_traces": Entity("trace_added", None, None, None, (
        Field("id", "id", needed=True), Field("session_id", "@sessionId", needed=True), Field("workspace_id", "@workspaceId", needed=True), Field("timestamp", "@timestamp", "long", True),
        Field("trace_type", "traceType"), Field("content", "content"), Field("metadata_json", "metadataJson"),
    )),
    "conversations": Entity("metadata", "conversation_updated", None, "conversationId", (
        Field("id", "id", needed=True), Field("title", "title", needed=True, changes=True), Field("created", "created", "long", True), Field("updated", "created", "long", True),
        Field("vault_name", "vault", needed=True), Field("metadata_json", "settings", changes=True),
    )),
    "messages": Entity("message", "message_updated", None, "messageId", (
        Field("id", "id", needed=True), Field("conversation_id", "@conversationId", needed=True), Field("role", "role", needed=True), Field("content", "content", changes=True), Field("timestamp", "@timestamp", "long", True),
        Field("state", "state", default="complete", changes=True), Field("tool_calls_json", "tool_calls", changes=True), Field("tool_call_id", "tool_call_id", changes=True),
        Field("reasoning_content", "reasoning", changes=True), Field("sequence_number", "sequenceNumber", "long", True),
    )),
}
#: What a change calls a column, where a creation calls it otherwise or doesn't have it.
CHANGED_BY = {("workspaces", "last_accessed"): "lastAccessed", ("workspaces", "is_active"): "isActive", ("sessions", "end_time"): "endTime", ("sessions", "is_active"): "isActive", ("conversations", "updated"): "updated"}
#: Any entity is deleted by an event of this type, with its table in entity and its key in entityId.
DELETED = "deleted"


def given_by(name: str, field: Field) -> str | None:
    """The field of a change's data that gives a column, None where changes don't."""
    return CHANGED_BY.get((name, field.column)) or (field.source if field.changes else None)


#: Fields of data that changes give.
GIVEN = sorted({g for n, e in ENTITIES.items() for f in e.fields if (g := given_by(n, f))})
ORDER = "struct<timestamp: bigint, id: string>"
#: Of an entity: its last creation with the event's fields and data, its last deletion, and each field's last change.
ACCOUNT = f"entity string, key string, made struct<timestamp: bigint, id: string, workspaceId: string, sessionId: string, conversationId: string, data: string>, gone {ORDER}, " + ", ".join(f"`{g}` struct<timestamp: bigint, id: string, value: string>" for g in GIVEN)


def _data(data: str = "data") -> Column:
    """The fields of a JSON object as a map of texts; objects and lists as JSON. A map, so that one reading of it serves all fields."""
    return F.from_json(data, "map<string, string>")


def _source(field: Field) -> Column:
    return F.col(field.source[1:]) if field.source[0] == "@" else F.try_element_at("said", F.lit(field.source))


def addressed(log: DataFrame) -> DataFrame:
    """Events of ENVELOPE with the entity and key that they are about, what they do (make, change, delete; null for other types) and why they can't, if so."""
    kinds, table, key, why = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    rows = log.withColumn("said", _data())
    for name, e in ENTITIES.items():
        made = F.col("type") == e.creates
        lacks = [F.when(_source(f).isNull() | ((F.lit(name) == "workspaces") & (_source(f) == "")), F.lit(f"no {f.column}")) for f in e.fields if f.needed and f.default is None]
        kinds, table, key = F.when(made, "make").otherwise(kinds), F.when(made, name).otherwise(table), F.when(made, F.try_element_at("said", F.lit("id"))).otherwise(key)
        why = F.when(made, F.coalesce(F.lit(None), *lacks)).otherwise(why)
        for kind, type_ in (("change", e.changes), ("delete", e.deletes)):
            if type_:
                is_it = F.col("type") == type_
                kinds, table, key = F.when(is_it, kind).otherwise(kinds), F.when(is_it, name).otherwise(table), F.when(is_it, F.col(e.ref)).otherwise(key)
        if e.changes:
            nulls = [F.when(F.map_contains_key("said", g) & F.try_element_at("said", F.lit(g)).isNull(), F.lit(f"null {f.column}")) for f in e.fields if f.needed and (g := given_by(name, f))]
            why = F.when(F.col("type") == e.changes, F.coalesce(F.lit(None), *nulls)).otherwise(why)
    generic = F.col("type") == DELETED
    kinds, table, key = F.when(generic, "delete").otherwise(kinds), F.when(generic, F.col("entity")).otherwise(table), F.when(generic, F.col("entityId")).otherwise(key)
    why = F.when(kinds.isNull(), "unknown type").when(F.col("timestamp").isNull(), "no timestamp").when(key.isNull(), "no key").otherwise(why)
    return rows.withColumns({"does": kinds, "entity": table, "key": key, "why": why})


def rejected(log: DataFrame) -> DataFrame:
    """(id, type, why) of events that aren't applied."""
    return addressed(log).where(F.col("why").isNotNull()).select("id", "type", "why")


def accounts(log: DataFrame) -> DataFrame:
    """A row of ACCOUNT for each entity of a log: one aggregation with partial results."""
    rows, at = addressed(log), [F.col("timestamp"), F.col("id")]
    # What can't be applied says nothing, rather than being filtered out: a filter would be pushed below the reading of data and read it once more.
    does = lambda kind: F.col("why").isNull() & (F.col("does") == kind)
    given = [F.when(does("change") & F.map_contains_key("said", g), F.struct(*at, F.try_element_at("said", F.lit(g)).alias("value"))).alias(g) for g in GIVEN]
    made = F.when(does("make"), F.struct(*at, "workspaceId", "sessionId", "conversationId", "data")).alias("made")
    found = summed(rows.select("entity", "key", made, F.when(does("delete"), F.struct(*at)).alias("gone"), *given))
    return found.where(F.coalesce("made.id", "gone.id", *(f"{g}.id" for g in GIVEN)).isNotNull())


def summed(parts: DataFrame, *also: str) -> DataFrame:
    """Accounts of parts of a log to accounts of the whole; also: more columns to group by."""
    return parts.groupBy(*also, "entity", "key").agg(*(F.max(c).alias(c) for c in ["made", "gone", *GIVEN]))


def touches(log: DataFrame) -> DataFrame:
    """(conversation, timestamp, id) of each message event that is applied."""
    return addressed(log.where("type = 'message'")).where("why is null").select(F.col("conversationId").alias("conversation"), "timestamp", "id")


def _typed(value: Column, kind: str) -> Column:
    if kind == "flag":
        return F.when(value.isNull() | value.isin("false", "0", ""), F.lit(0)).otherwise(F.lit(1))
    return value.cast(kind)


def table(all_accounts: DataFrame, name: str, touched: DataFrame | None = None) -> DataFrame:
    """One of the six tables from accounts; touched: the messages of conversations, which need them."""
    e = ENTITIES[name]
    rows = all_accounts.where(F.col("entity") == name).where("made is not null and (gone is null or struct(made.timestamp, made.id) > gone)")
    rows = rows.withColumns({"said": _data("made.data"), "born": F.struct("made.timestamp", "made.id")})

    def column(f: Field) -> Column:
        base = F.lit(None).cast("string") if f.source == "-" else F.col(f"made.{f.source[1:]}").cast("string") if f.source[0] == "@" else _source(f)
        if f.default is not None:
            base = F.coalesce(base, F.col(f"made.{f.default[1:]}").cast("string") if f.default[:1] == "@" else F.lit(f.default))
        g = given_by(name, f)
        if g:
            last = F.col(g)
            said = F.coalesce(last["value"], F.lit("null")) if g == "settings" else last["value"]  # a change to null is kept as its JSON text
            base = F.when(F.struct(last["timestamp"], last["id"]) > F.col("born"), said).otherwise(base)
        return _typed(base, f.kind)

    if name != "conversations":
        return rows.select(*(column(f).alias(f.column) for f in e.fields))
    out = rows.select(*(column(f).alias(f.column) for f in e.fields), "born", F.struct("updated.timestamp", "updated.id").alias("set_at"))
    # Messages meet their conversation in a join that Spark can split, and are counted with partial results: a long conversation is no single task.
    later = touched.join(out.select(F.col("id").alias("conversation"), "born"), "conversation").where("struct(timestamp, id) > born")
    counted = later.groupBy("conversation").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("timestamp", "id")).alias("last"))
    both = out.join(counted, out["id"] == counted["conversation"], "left")
    moved = F.when(F.col("last").isNotNull() & (F.col("set_at.timestamp").isNull() | (F.col("last") > F.col("set_at"))), F.col("last.timestamp")).otherwise(F.col("updated"))
    return both.select("id", "title", "created", moved.alias("updated"), "vault_name", F.coalesce("n", F.lit(0)).cast("long").alias("message_count"), "metadata_json")


def tables(log: DataFrame) -> dict[str, DataFrame]:
    """All six from a log of ENVELOPE. An event may be there more than once."""
    found, touched = accounts(log), touches(log).distinct()
    return {name: table(found, name, touched) for name in ENTITIES}


def ask(held: dict[str, DataFrame], sql: str, **values: object) -> DataFrame:
    """SQL over the tables, which it names in braces, with parameters (``:name``) that are bound and never become SQL text."""
    spark = next(iter(held.values())).sparkSession
    return spark.sql(sql, args=values, **{name: df for name, df in held.items() if "{" + name + "}" in sql})
