"""Queries over transcripts of every kind: small files are written to the shared folder and read through skein_sessions."""

from __future__ import annotations

import json
import sqlite3
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.runtime import shared_dir
from skein.store import explode_messages, explode_parts
from skein.streaming.scan import reported

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_homes: dict = {}


def _lines(path: Path, records: list, end: str = "\n") -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + end)


def _database(path: Path, tables: dict[str, tuple[str, list]]) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    with sqlite3.connect(path) as db:
        for name, (columns, rows) in tables.items():
            db.execute(f"CREATE TABLE {name} ({columns})")
            db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * (columns.count(',') + 1))})", rows)
    db.close()


def home(spark: SparkSession) -> Path:
    """A folder with a folder for each source; written once a session. Sources are files, so the shared folder must be mounted."""
    key = spark.sparkContext.applicationId
    if key not in _homes:
        shared = shared_dir(spark)
        if "://" in shared and not shared.startswith("file://"):
            raise ValueError("transcripts are read from mounted folders only")
        h = Path(shared.removeprefix("file://")) / f"sources-{uuid.uuid4().hex}"
        _lines(h / "antigravity/brain/walk/.system_generated/logs/transcript.jsonl", [
            {"type": "PLANNER_RESPONSE", "step_index": 3, "content": "both read"}, {"type": "TOOL_CALL", "step_index": 1, "toolName": "read", "arguments": "{\"p\":1}"}, {"type": "USER_INPUT", "step_index": 0, "content": "read both"},
            {"type": "TOOL_CALL", "step_index": 2, "toolName": "read", "arguments": "{\"p\":2}"}, {"type": "TOOL_CALL", "step_index": 7, "toolName": "lost"}, {"type": "UNHEARD", "step_index": 8}, {"type": "USER_INPUT"}])
        _database(h / "antigravity/conversation_summaries.db", {"conversations": ("id TEXT, name TEXT, updated_at TEXT", [("walk", "n", "2026-03-01T10:00:00Z")])})
        _database(h / "antigravity/brain/walk/payload.db", {"tool_links": ("step_index INT, call_id TEXT, result TEXT", [(1, "k1", "one"), (2, "k2", "two"), (9, "k9", "never")])})
        bubble = lambda n, kind=1: {"type": kind, "text": f"say {n}", "createdAt": f"2026-03-02T10:00:0{n}Z"}
        kv = {"composerHeaders": [{"composerId": "comp", "lastUpdatedAt": 5, "name": "desk"}], "composerData:comp": {"fullConversationHeadersOnly": [{"bubbleId": x} for x in ("b3", "b1", "gone", "b2", "odd")]}, "bubbleId:comp:b1": bubble(1), "bubbleId:comp:b2": bubble(2, 2), "bubbleId:comp:b3": bubble(3), "bubbleId:comp:odd": bubble(4, 8), "bubbleId:comp:stray": bubble(5)}
        _database(h / "cursor/state.vscdb", {"cursorDiskKV": ("key TEXT PRIMARY KEY, value TEXT", [(k, json.dumps(v)) for k, v in kv.items()])})
        turn = lambda n, k, ms, status=None: {"ordinal": n, "type": "task_complete", "payload": {"turn_id": k, "duration_ms": ms} | ({"status": status} if status else {})}
        said = {"ordinal": 1, "type": "response_item", "timestamp": "2026-03-03T10:00:00Z", "payload": {"type": "message", "role": "user", "content": "go"}}
        _lines(h / "codex/sessions/one.jsonl", [said, turn(2, "ta", 10), turn(3, "tb", 20), turn(5, "ta", 40, "aborted"), {"ordinal": 4, "type": "token_usage_record", "payload": {"input_tokens": 7}}, {"ordinal": 6, "type": "token_usage_record", "payload": {"input_tokens": 9}}, {"type": "no ordinal"}])
        _lines(h / "codex/sessions/two.jsonl", [said])
        _lines(h / "codex/sessions/three.jsonl", [said])
        threads = [(t, f"sessions/{f}.jsonl", 1_770_000_000, "/w") for t, f in (("root", "one"), ("kid", "two"), ("alone", "three"), ("unrolled", "none"))]
        _database(h / "codex/state_5.sqlite", {"threads": ("id TEXT, rollout_path TEXT, created_at INT, cwd TEXT", threads), "thread_spawn_edges": ("parent_thread_id TEXT, child_thread_id TEXT", [("root", "kid"), ("root", "unrolled")])})
        g = h / "grok_bot/sand-client-persistence"
        for name, entries in (("log-a", [{"seq": 1, "type": "message", "text": "hi"}, {"seq": 2, "type": "message"}, {"type": "message", "text": "no place"}]), ("log-b", [{"seq": 1, "type": "message", "text": "yo", "role": "assistant"}, {"seq": 2, "type": "wave"}])):
            _lines(g / f"{name}.json", [{"entries": entries}])
        _lines(g / "roster.json", [{"log-a": "ann", "log-z": "zed"}])
        _lines(g / "cloud-agents.json", [[{"agentId": "afar"}]])
        _lines(h / "claude_code/projects/p/main.jsonl", [
            {"type": "user", "timestamp": "2026-03-04T10:00:00Z", "message": {"content": "start"}}, {"type": "custom-title", "title": "first"}, {"type": "cost-state", "totalCostUsd": 0.25, "totalApiDurationMs": 10}, {"type": "custom-title", "title": "last"},
            {"type": "cost-state", "totalCostUsd": 0.75, "totalApiDurationMs": 30}, {"type": "mystery"}, "{ broken", '{"type": "user"'], end="")
        _homes[key] = h
    return _homes[key]


def _sessions(spark: SparkSession, *names: str) -> DataFrame:
    h = home(spark)
    return reported(spark, {n: str(h / n) for n in names})


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t({columns})"


@query(_values("id, message, role, kind, text", "('walk', 0, 'user', 'text', 'read both')", "('walk', 1, 'assistant', 'tool_call', '')", "('walk', 2, 'tool', 'tool_result', 'one')", "('walk', 3, 'assistant', 'tool_call', '')", "('walk', 4, 'tool', 'tool_result', 'two')", "('walk', 5, 'assistant', 'text', 'both read')"))
def tool_link_join(spark, d):
    """Calls in a transcript meet their results in a second database, two messages each; calls without one are left out."""
    m = explode_messages(_sessions(spark, "antigravity"))
    p = explode_parts(m).select("session_id", F.col("message_ordinal").alias("ordinal"), "kind", "text")
    return m.join(p, ["session_id", "ordinal"]).select(F.col("session_id").alias("id"), F.col("ordinal").alias("message"), "role", "kind", F.coalesce("text", F.lit("")).alias("text"))


@query(_values("id, position, bubble, role", "('comp', 0, 'b3', 'user')", "('comp', 1, 'b1', 'user')", "('comp', 2, 'b2', 'assistant')"))
def ordered_by_header_array(spark, d):
    """Messages in the order of a header's list, each found under a key made of both ids."""
    return explode_messages(_sessions(spark, "cursor")).select(F.col("session_id").alias("id"), F.col("ordinal").alias("position"), F.get_json_object("message_json", "$.id").alias("bubble"), "role")


@query(_values("id, parent_id, started_at", "('alone', '', '2026-03-03T10:00:00Z')", "('kid', 'root', '2026-03-03T10:00:00Z')", "('root', '', '2026-03-03T10:00:00Z')"))
def edge_parent_join(spark, d):
    """Threads with those that spawned them; threads without a transcript are not found."""
    return _sessions(spark, "codex").select("id", F.coalesce(F.get_json_object("session_json", "$.parent_id"), F.lit("")).alias("parent_id"), "started_at")


@query(_values("id, owner, openable", "('log-a', 'ann', true)", "('log-b', '', true)", "('afar', '', false)"))
def roster_join(spark, d):
    """Logs with their owners from a roster, and agents elsewhere that cannot be opened."""
    return _sessions(spark, "grok_bot").select("id", F.col("project_id").alias("owner"), "openable")


@query(_values("id, title, cost_usd, api_ms", "('main', 'last', CAST(0.75 AS DOUBLE), 30)"))
def last_write_wins(spark, d):
    """Of records of a session's state the last holds."""
    get = lambda p: F.get_json_object("session_json", p)
    return _sessions(spark, "claude_code").select("id", get("$.metadata.title").alias("title"), get("$.cost.total_cost_usd").cast("double").alias("cost_usd"), get("$.cost.total_api_duration_ms").cast("int").alias("api_ms"))


@query(_values("id, turn, status, duration_ms, input_tokens", "('root', 'ta', 'aborted', 40, 9)", "('root', 'tb', 'completed', 20, 9)"))
def keyed_registry(spark, d):
    """Of records of one turn the last holds; other turns stay."""
    s = _sessions(spark, "codex").select("id", F.get_json_object("session_json", "$.usage.input_tokens").cast("int").alias("input_tokens"), F.explode(F.from_json(F.get_json_object("session_json", "$.turns"), "map<string,struct<status:string,duration_ms:int>>")).alias("turn", "t"))
    return s.select("id", "turn", "t.status", "t.duration_ms", "input_tokens")


@query(_values("agent, id, malformed, unknown, partial, ignored", "('antigravity', 'walk', 2, 1, 0, 0)", "('cursor', 'comp', 1, 1, 0, 0)", "('codex', 'root', 1, 0, 0, 0)", "('codex', 'kid', 0, 0, 0, 0)", "('codex', 'alone', 0, 0, 0, 0)", "('grok_bot', 'log-a', 1, 0, 0, 1)", "('grok_bot', 'log-b', 0, 1, 0, 0)", "('grok_bot', 'afar', 0, 0, 0, 0)", "('claude_code', 'main', 1, 1, 1, 0)"))
def skip_counters(spark, d):
    """Records left out per session, by reason."""
    s = _sessions(spark, "antigravity", "cursor", "codex", "grok_bot", "claude_code")
    return s.select("agent", "id", *[F.col(c).cast("int").alias(c) for c in ("malformed", "unknown", "partial", "ignored")])
