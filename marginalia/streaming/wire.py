"""Responses as they come over the wire: chunks of an event stream, cut anywhere, folded to whole answers and tool calls.

Chunks are rows (stream, n from 0, ts, chunk), in any order within the watermark, and perhaps more than once. Per stream the keyed state holds the chunks that
wait for an earlier one, what is left of a line, and what was said so far; it goes when the answer is complete, or when no chunk came for ``EXPIRES_MS``
of event time, and the answer is given as it is (``ending`` expired). The line protocol: fields end with a line, events with an empty line; data fields
of an event are joined by line ends, comments and other fields are skipped. Data is ``[DONE]`` or a JSON object; bad JSON is counted and skipped. Of an
object's first choice, content and reasoning are appended; tool calls are gathered by index, whose id and name are the last ones given and whose
arguments are appended; usage is the last one given; a finish reason of ``ENDINGS`` completes the answer. What comes after that is ignored.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.streaming.live import folded

CHUNKS = "stream string, n long, ts timestamp, chunk string"
ANSWER = "stream string, content string, reasoning string, calls array<struct<index: int, id: string, name: string, arguments: string>>, prompt_tokens long, completion_tokens long, ending string, events long, bad long"
ENDINGS = ("stop", "length", "tool_calls")
EXPIRES_MS, DELAY = 3_600_000, "2 hours"
_LINE = re.compile(r"(.*?)(?:\r\n|\n|\r(?!\Z))", re.S)


def fresh() -> dict:
    return {"next": 0, "waiting": {}, "rest": "", "data": [], "content": [], "reasoning": [], "calls": {}, "usage": None, "ending": None, "events": 0, "bad": 0}


def event(held: dict, data: str) -> None:
    """What one event adds to an answer."""
    held["events"] += 1
    if data == "[DONE]":
        held["ending"] = "done"
        return
    try:
        said = json.loads(data)
        choice = (said.get("choices") or [{}])[0]
        delta = choice.get("delta") or {}
        calls = [(c.get("index") or 0, c.get("id"), c.get("function") or {}) for c in delta.get("tool_calls") or []]
    except (ValueError, AttributeError, TypeError, LookupError):
        held["bad"] += 1
        return
    held["content"].append(delta.get("content") or "")
    held["reasoning"].append(delta.get("reasoning") or "")
    for index, call_id, function in calls:
        call = held["calls"].setdefault(str(index), {"id": "", "name": "", "arguments": []})
        call["id"], call["name"] = call_id or call["id"], function.get("name") or call["name"]
        call["arguments"].append(function.get("arguments") or "")
    held["usage"] = said.get("usage") or held["usage"]
    if choice.get("finish_reason") in ENDINGS:
        held["ending"] = choice["finish_reason"]


def feed(held: dict, chunk: str) -> None:
    """Takes the lines that are whole by now."""
    text, at = held["rest"] + chunk, 0
    for line in _LINE.finditer(text):
        at, field = line.end(), line[1]
        if held["ending"]:
            break
        if field.startswith("data:"):
            held["data"].append(field[5:].removeprefix(" "))
        elif field == "data":
            held["data"].append("")
        elif not field and held["data"]:
            event(held, "\n".join(held["data"]))
            held["data"] = []
    held["rest"] = text[at:]


def arrive(held: dict, n: int, chunk: str) -> None:
    """Takes a chunk when all before it have come; one that came already is left out."""
    if n >= held["next"]:
        held["waiting"].setdefault(str(n), chunk)
    while not held["ending"] and str(held["next"]) in held["waiting"]:
        feed(held, held["waiting"].pop(str(held["next"])))
        held["next"] += 1


def answer(stream: str, held: dict) -> dict:
    usage = held["usage"] or {}
    calls = [{"index": int(i), "id": c["id"], "name": c["name"], "arguments": "".join(c["arguments"])} for i, c in sorted(held["calls"].items(), key=lambda x: int(x[0]))]
    return {
        "stream": stream, "content": "".join(held["content"]), "reasoning": "".join(held["reasoning"]), "calls": calls, "prompt_tokens": usage.get("prompt_tokens") or 0,
        "completion_tokens": usage.get("completion_tokens") or 0, "ending": held["ending"] or "expired", "events": held["events"], "bad": held["bad"],
    }


def answers(chunks: DataFrame, expires_ms: int = EXPIRES_MS, delay: str = DELAY) -> DataFrame:
    """A stream of CHUNKS to a stream of ANSWER: each answer once, when it is complete or has expired. A null chunk is an empty one."""

    def fold(stream: str, new: list[tuple] | None, state: str | None, mark: int) -> tuple[list[tuple], str | None, int | None]:
        held = json.loads(state) if state else fresh()
        if new is None:
            return [] if held["ending"] else [tuple(answer(stream, held).values())], None, None
        was, out = held["ending"], []
        for _, n, chunk, _ in sorted(new, key=lambda row: row[1]):
            arrive(held, n, chunk or "")
        if held["ending"] and not was:
            out = [tuple(answer(stream, held).values())]
            held = fresh() | {"ending": held["ending"]}  # so that chunks which come again open nothing; it expires as others do
        return out, json.dumps(held), max([mark, *(row[3] for row in new)]) + expires_ms

    rows = chunks.withWatermark("ts", delay).select("stream", "n", "ts", "chunk", F.unix_millis("ts").alias("ms"))
    return folded(rows, "stream", fold, ANSWER)
