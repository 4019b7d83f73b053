"""Calls bound to sessions: which session a call belongs to, whether it had to be made, and the one workspace that the session is bound to.

A session id is ``s-`` and fourteen digits. A call without one gets a new session called ``Default Session``; any other text is a friendly name, and
gets a new session of that name; both are made from the call's time and number, and need no state. A call with an id that is unknown makes that session.
A session's workspace is the first that one of its calls names, and stays; a call that names another one is told so (``refused``).

Calls of a session are taken in the order of (ts, id) within a micro-batch. A session's state goes when no call came for ``IDLE_MS`` of event time; a call
after that makes it again, so stores of sessions are asked first (``known``).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.streaming.live import folded

CALLS = "id long, ts timestamp, session string, workspace string"
BOUND = "id long, session_id string, name string, created boolean, workspace string, refused boolean"
STANDARD = r"^s-[0-9]{14}$"
IDLE_MS, DELAY = 7 * 86_400_000, "1 day"


def bound(calls: DataFrame, known: DataFrame | None = None, idle_ms: int = IDLE_MS) -> DataFrame:
    """A stream of CALLS to a stream of BOUND. known: (session_id, workspace) of sessions that there are, in a table."""
    calls = calls.withWatermark("ts", DELAY)
    standard = F.coalesce(F.col("session").rlike(STANDARD), F.lit(False))
    # A second may see many calls, so the number of the call goes into the name of the id's last part, not of its digits.
    own_id = F.concat(F.lit("s-"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("-"), F.col("id").cast("string"))
    name = F.when(F.coalesce(F.trim("session"), F.lit("")) == "", "Default Session").otherwise(F.col("session"))
    made = calls.where(~standard).select("id", own_id.alias("session_id"), name.alias("name"), F.lit(True).alias("created"), "workspace", F.lit(False).alias("refused"))

    def bind(session: str, new: list[tuple] | None, state: str | None, mark: int) -> tuple[list[tuple], str | None, int | None]:
        if new is None:
            return [], None, None
        exists, (held, last), out = state is not None, json.loads(state) if state else (None, 0), []
        for _, id_, workspace, us, there, known_held in sorted(new, key=lambda row: (row[3], row[1])):
            if not exists and there:
                exists, held = True, known_held
            created, exists = not exists, True
            held = held if held is not None else workspace
            out.append((id_, session, f"Session {session}" if created else None, created, held, workspace is not None and workspace != held))
            last = max(last, us // 1000)
        last = max(last, mark)
        return out, json.dumps([held, last]), last + idle_ms

    own = calls.where(standard)
    if known is None:
        own = own.withColumns({"there": F.lit(False), "held": F.lit(None).cast("string")})
    else:
        own = own.join(known.select(F.col("session_id").alias("session"), F.col("workspace").alias("held"), F.lit(True).alias("there")), "session", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    rows = own.select("session", "id", "workspace", F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("us"), "there", "held", "ts")
    return made.unionByName(folded(rows, "session", bind, BOUND))
