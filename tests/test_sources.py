"""Sources, store, scan loop and command line on made-up transcripts."""

import io
import json
import sqlite3
from pathlib import Path

import pytest

from skein.cli import main, parser, run
from skein.functions.embed import ByteEmbedder, ModelMissing, embedder
from skein.sources import base
from skein.operators import search as R
from skein.sources.adapters import SOURCES, CursorStyle, Fixture, create
from skein.sources.datasource import TailReader
from skein.store import Store, StoreError
from skein.streaming.scan import follow, found, reported, scan


def put(path: Path, records, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records)[: None if end else -1])


@pytest.fixture
def homes(tmp_path):
    c = tmp_path / "claude_code"
    put(c / "projects/p1/s1.jsonl", [
        {"type": "user", "uuid": "u1", "timestamp": "2026-01-01T00:00:00Z", "message": {"content": "fix the parser"}},
        {"type": "assistant", "uuid": "u2", "parentUuid": "u1", "timestamp": "2026-01-01T00:01:00Z", "message": {"content": [{"type": "thinking", "thinking": "hm", "signature": "s"}, {"type": "tool_use", "id": "c1", "name": "grep", "input": {"q": 1}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "c1", "content": [{"x": 1}]}, {"type": "image"}]}},
        {"type": "summary", "summary": "sum"}, {"type": "cost-state", "totalCostUsd": 0.1}, {"type": "cost-state", "totalCostUsd": 0.42, "totalApiDurationMs": 1200}, {"type": "custom-title", "title": "T"}, {"type": "pr-link", "prUrl": "U"},
        "no json", {"type": "file-history-snapshot"}, '{"type":"user"'], end="")
    put(c / "projects/p1/subagents/agent-1.jsonl", [{"type": "user", "message": {"content": "x"}}])
    x = tmp_path / "codex"
    put(x / "sessions/r1.jsonl", [
        {"ordinal": 2, "timestamp": "2026-01-02T00:00:00Z", "type": "response_item", "payload": {"type": "function_call", "call_id": "k", "name": "sh", "arguments": "{\"a\":1}"}},
        {"ordinal": 1, "timestamp": "2026-01-01T00:00:00Z", "type": "response_item", "payload": {"type": "message", "role": "developer", "content": [{"type": "input_text", "text": "hi"}]}},
        {"ordinal": 3, "type": "response_item", "payload": {"type": "function_call_output", "call_id": "k", "output": {"ok": True}}}, {"ordinal": 4, "type": "response_item", "payload": {"type": "reasoning", "summary": [{"text": "a"}, {"text": "b"}]}},
        {"ordinal": 5, "type": "response_item", "payload": {"type": "reasoning", "summary": []}}, {"ordinal": 6, "type": "token_usage_record", "payload": {"input_tokens": 5}}, {"ordinal": 7, "type": "compacted", "payload": {"window_id": "w2", "previous_window": "w1"}},
        {"ordinal": 8, "type": "task_complete", "payload": {"duration_ms": 42}}, {"type": "x"}, {"ordinal": 9, "type": "y"}])
    db = sqlite3.connect(x / "state_5.sqlite")
    db.executescript("CREATE TABLE threads(id TEXT, rollout_path TEXT, created_at INT, cwd TEXT, created_at_ms INT, title TEXT); CREATE TABLE thread_spawn_edges(parent_thread_id TEXT, child_thread_id TEXT)")
    db.executemany("INSERT INTO threads VALUES (?,?,?,?,?,?)", [("t1", "sessions/r1.jsonl", 1, "/w", None, "A"), ("t2", "sessions/none.jsonl", 1, "/w", 1767225600000, None)])
    db.execute("INSERT INTO thread_spawn_edges VALUES ('t0', 't1')")
    db.commit()
    k = tmp_path / "cursor"
    k.mkdir()
    db2 = sqlite3.connect(k / "state.vscdb")
    db2.execute("CREATE TABLE cursorDiskKV(key TEXT PRIMARY KEY, value TEXT)")
    kv = {"composerHeaders": [{"composerId": "c1", "lastUpdatedAt": 1, "name": "N"}], "composerData:c1": {"fullConversationHeadersOnly": [{"bubbleId": "b2"}, {"bubbleId": "b1"}, {"bubbleId": "gone"}, {"bubbleId": "odd"}]}, "bubbleId:c1:b1": {"type": 2, "thinking": "t", "toolFormerData": {"name": "n", "params": "{}"}}, "bubbleId:c1:b2": {"type": 1, "text": "hello", "createdAt": "2026-01-01T00:00:00Z"}, "bubbleId:c1:odd": {"type": 9}}
    db2.executemany("INSERT INTO cursorDiskKV VALUES (?,?)", [(a, json.dumps(b)) for a, b in kv.items()])
    db2.commit()
    g = tmp_path / "grok_bot/sand-client-persistence"
    g.mkdir(parents=True)
    (g / "log.json").write_text(json.dumps({"capped": True, "entries": [{"seq": 2, "type": "voice_call", "callId": 1}, {"seq": 1, "type": "message", "text": "x", "role": "odd"}, {"type": "message"}, {"seq": 3, "type": "message"}, {"seq": 4, "type": "z"}]}))
    (g / "roster.json").write_text('{"log":"me"}')
    (g / "cloud-agents.json").write_text('[{"agentId":"stub"}]')
    a = tmp_path / "antigravity"
    put(a / "brain/v1/.system_generated/logs/transcript.jsonl", [{"type": "TOOL_CALL", "step_index": 2, "toolName": "n", "arguments": "{}"}, {"type": "USER_INPUT", "step_index": 1, "created_at": "2026-01-01T00:00:00Z", "content": "q"}, {"type": "TOOL_CALL", "step_index": 9}, {"type": "CHECKPOINT", "step_index": 3, "summary": "s"}, {"type": "ERROR_MESSAGE", "step_index": 4}, {"type": "USER_INPUT"}, {"type": "?", "step_index": 5}])
    for path, sql in ((a / "conversation_summaries.db", "CREATE TABLE conversations(id TEXT, name TEXT, updated_at TEXT); INSERT INTO conversations VALUES ('v1','n','2026')"), (a / "brain/v1/payload.db", "CREATE TABLE tool_links(step_index INT, call_id TEXT, result TEXT); INSERT INTO tool_links VALUES (2,'c','done')")):
        d = sqlite3.connect(path)
        d.executescript(sql)
        d.close()
    put(tmp_path / "jsonl/j1.jsonl", [{"type": "user", "text": "a"}, {"type": "nope"}, "", "{"])
    put(tmp_path / "cursor_transcripts/pr/agent-transcripts/ct.jsonl", [{"role": "user", "text": "hey", "timestamp": "2026"}, {"role": "user"}])
    yield tmp_path
    db.close()
    db2.close()


def opened(home, name):
    a = create(name, str(home / name))
    return {f.id: a.open(f) for f in a.discover()}


def test_adapters(homes):
    before = base.digest_tree(homes)
    c = opened(homes, "claude_code")
    assert list(c) == ["s1"]
    s = c["s1"].session
    assert [m["role"] for m in s["messages"]] == ["user", "assistant", "user", "user"] and s["cost"]["total_cost_usd"] == 0.42 and s["metadata"] == {"title": "T", "pr_url": "U"}
    assert s["messages"][2]["parts"] == [{"kind": "tool_result", "call_id": "c1", "text": '[{"x": 1}]'}] and s["messages"][1]["provenance"]["line"] == 2
    assert (c["s1"].skips.malformed, c["s1"].skips.unknown, c["s1"].skips.partial) == (1, 1, 1) and s["last_activity_at"] == "2026-01-01T00:01:00Z"
    x = opened(homes, "codex")["t1"]
    assert [m["role"] for m in x.session["messages"]] == ["system", "assistant", "tool", "assistant"] and x.session["parent_id"] == "t0" and x.session["usage"] == {"input_tokens": 5}
    assert x.session["compaction_windows"] == {"w2": {"previous_window": "w1"}} and x.session["turns"]["turn"]["duration_ms"] == 42 and (x.skips.malformed, x.skips.unknown, x.skips.ignored) == (1, 1, 1)
    k = opened(homes, "cursor")["c1"]
    assert [m["id"] for m in k.session["messages"]] == ["b2", "b1"] and k.session["started_at"] == "" and (k.skips.malformed, k.skips.unknown) == (1, 1)
    g = opened(homes, "grok_bot")
    assert g["stub"] is None and g["log"].session["partial"] and [m["role"] for m in g["log"].session["messages"]] == ["user", "system"] and g["log"].session["project_id"] == "me"
    v = opened(homes, "antigravity")["v1"]
    assert [m["role"] for m in v.session["messages"]] == ["user", "assistant", "tool", "assistant", "system"] and v.skips.malformed == 2 and v.skips.unknown == 1
    assert len(opened(homes, "jsonl")["j1"].session["messages"]) == 1 and len(opened(homes, "cursor_transcripts")["ct"].session["messages"]) == 1
    assert base.digest_tree(homes) == before
    f = list(create("cursor", str(homes / "cursor")).discover())
    assert CursorStyle.changed({"c1": "1"}, f) == [] and CursorStyle.changed({}, f) == ["c1"]
    with pytest.raises(base.UnknownSource):
        create("nope", ".")


def test_store_pass_update_prune_and_guard(spark, homes, tmp_path):
    sources = {n: str(homes / n) for n in SOURCES}
    store = Store(spark, f"file://{tmp_path}/store")
    dry = store.ingest(reported(spark, sources), dry_run=True)
    assert sum(r.new for r in dry.collect()) == 7 and store.manifest()["version"] == 0
    first = {r.agent: r for r in store.ingest(reported(spark, sources)).collect()}
    assert first["grok_bot"].error == 1 and sum(r.new for r in first.values()) == 7 and store.read("sessions").count() == 7
    assert store.ingest(reported(spark, sources)).agg({"unchanged": "sum"}).first()[0] == 7 and store.manifest()["version"] == 1
    old = store.read("messages")
    put(homes / "jsonl/j1.jsonl", [{"type": "user", "text": "a", "timestamp": "2026-02-01T00:00:00Z"}, {"type": "user", "text": "parser again"}])
    (homes / "claude_code/projects/p1/s1.jsonl").unlink()
    second = {r.agent: r for r in store.ingest(reported(spark, sources)).collect()}
    assert second["jsonl"].updated == 1 and second["jsonl"].net_messages == 1 and second["claude_code"].pruned == 1
    assert store.read("messages").where("session_id = 'j1'").count() == 2 and old.where("session_id = 's1'").count() == 4
    assert store.read("postings").where("term = 'parser'").count() == 1
    n = store.read("parts").where("text is not null").count()
    store.embed(ByteEmbedder())
    store.embed(ByteEmbedder())
    assert store.read("vectors").count() == n and store.read("sessions").count() == 6
    put(homes / "jsonl/j1.jsonl", [{"type": "user", "text": "b", "timestamp": "2026-03-01T00:00:00Z"}])
    store.ingest(reported(spark, sources))
    assert store.read("vectors").where("session_id = 'j1'").count() == 0
    with pytest.raises(StoreError):
        store.ingest(reported(spark, sources), model_id="m2")


class Script:
    def __init__(self, passes):
        self.left, self.waits, self.t = passes, [], 0

    def now_ms(self):
        return self.t

    def wait_until(self, ms):
        self.waits.append(ms - self.t)
        self.t, self.left = ms, self.left - 1

    def stop_requested(self):
        return self.left <= 1


def test_scan_loop_counts_passes_and_survives_errors(spark, homes, tmp_path):
    store, seen, clock = Store(spark, f"file://{tmp_path}/st"), [], Script(3)
    n = scan(spark, store, {"jsonl": str(homes / "jsonl")}, interval_s=5, ticker=clock, on_pass=lambda k, r: seen.append(r))
    assert n == 2 and len(seen) == 2 and clock.waits == [5000, 5000]  # stopped while waiting
    bad = []
    assert scan(spark, store, {"nope": "x"}, once=True, on_pass=lambda k, r: bad.append(r)) == 1 and isinstance(bad[0], Exception)


def tail(r, start, end):
    return [x[1:] for p in r.partitions(start, end) for x in r.read(p)]


def test_tail_follows_appends(tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text("one\ntw")
    r = TailReader({"root": str(tmp_path)})
    at = r.latestOffset()
    assert tail(r, {}, at) == [(0, "one")]
    with p.open("a") as f:
        f.write("o\nthree\n")
    at2 = r.latestOffset()
    assert tail(r, at, at2) == [(4, "two"), (8, "three")] and tail(r, at2, at2) == []
    p.write_text("new\n")
    assert tail(r, at2, r.latestOffset()) == [(0, "new")]


@pytest.mark.parametrize("each", [1, 2, 3, 7, 50, 1000])
def test_ranges_of_a_file_give_each_line_once(tmp_path, each):
    lines = ["", "a", "é" * 5, "x" * 40, "", "last"]
    (tmp_path / "b.jsonl").write_text("\n".join(lines) + "\nrest")
    r = TailReader({"root": str(tmp_path), "bytes_per_partition": str(each)})
    got = tail(r, {}, r.latestOffset())
    assert [x[1] for x in got] == lines and len({x[0] for x in got}) == len(lines)


def test_stream_of_appended_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in/a.jsonl", ['{"n":1}', '{"n":2}'], end="")
    seen = []
    q = lambda: follow(spark, str(tmp_path / "in")).writeStream.foreachBatch(lambda b, n: seen.extend(r.line for r in b.collect())).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(60)
    q()
    assert seen == ['{"n":1}']
    with (tmp_path / "in/a.jsonl").open("a") as f:
        f.write('\n{"n":3}\n')
    q()
    assert sorted(seen) == ['{"n":1}', '{"n":2}', '{"n":3}']


def test_a_pass_opens_only_what_changed(spark, homes, tmp_path):
    sources = {n: str(homes / n) for n in SOURCES}
    store = Store(spark, f"file://{tmp_path}/store")
    dry = store.sync(found(spark, sources), dry_run=True)
    assert dry.agg({"new": "sum"}).first()[0] == 7 and store.manifest()["version"] == 0
    first = store.sync(found(spark, sources)).collect()
    assert sum(r.new for r in first) == 7 and first[0].opened == 7 and sum(r.error for r in first) == 1
    again = store.sync(found(spark, sources)).collect()
    assert again[0].opened == 0 and sum(r.unchanged for r in again) == 7 and store.manifest()["version"] == 1
    put(homes / "jsonl/j1.jsonl", [{"type": "user", "text": "b"}])  # as many messages, the same times, another text
    (homes / "claude_code/projects/p1/s1.jsonl").unlink()
    third = {r.agent: r for r in store.sync(found(spark, sources)).collect()}
    assert third["jsonl"].opened == 1 and third["jsonl"].updated == 1 and third["claude_code"].pruned == 1
    v = store.manifest()["tables"]["sessions"]
    assert sorted(set(v.values())) == [1, 2] and len([b for b in v.values() if b == 2]) <= 2  # other buckets stay as they are
    assert [r.text for r in store.read("parts").where("session_id = 'j1'").collect()] == ["b"] and store.read("sessions").count() == 6
    assert store.sync(found(spark, sources), force=True).first()["opened"] == 6
    assert {r.session_id for r in R.text_search(store.index(), "hello").collect()} == {"c1"}
    with pytest.raises(StoreError):
        store.commit({}, [], embedding_model="m1") and store.sync(found(spark, sources), embedder=ByteEmbedder())


def test_unsound_sessions_replace_nothing(spark, tmp_path):
    cols = "id string, agent string, project_id string, started_at string, last_activity_at string, message_count long, content_hash string, session_json string, openable boolean, source_place int, place int"
    row = lambda h, j: spark.createDataFrame([("s", "a", "", "", "", 1, h, j, True, 0, 0)], cols)
    store = Store(spark, f"file://{tmp_path}/st")
    store.ingest(row("h1", '{"messages":[{"role":"user","parts":[{"kind":"text","text":"x"}]}]}'))
    assert store.ingest(row("h2", '{"messages":['), force=True).first()["error"] == 1
    assert store.read("messages").count() == 1 and store.read("sessions").first()["content_hash"] == "h1"


def test_older_stores_are_brought_up(spark, tmp_path):
    rows = [("s", "a", "", "", "", 1, "h", '{"messages":[{"role":"user","parts":[{"kind":"text","text":"old words"}]}]}')]
    spark.createDataFrame(rows, "id string, agent string, project_id string, started_at string, last_activity_at string, message_count long, content_hash string, session_json string").write.parquet(f"file://{tmp_path}/o/v=4/sessions")
    (tmp_path / "o/CURRENT").write_text(json.dumps({"version": 4, "schema_version": 1, "embedding_model": None, "tables": {"sessions": 4}}))
    store = Store(spark, f"file://{tmp_path}/o")
    assert store.manifest()["schema_version"] == 3 and [r.text for r in R.text_search(store.index(), "words").collect()] == ["old words"]
    (tmp_path / "o/.CURRENT.crc").unlink(missing_ok=True)
    (tmp_path / "o/CURRENT").write_text(json.dumps({"version": 4, "schema_version": 9, "embedding_model": None, "tables": {}}))
    with pytest.raises(StoreError):
        Store(spark, f"file://{tmp_path}/o")


def test_fixture_doctor_and_undecodable_lines(homes):
    f = Fixture(sessions={"a": {"messages": [{"role": "user", "parts": []}]}, "b": {}}, blocked=("b",))
    got = [f.open(x) for x in f.discover()]
    assert f.opened == 1 and got[1] is None and f.doctor()["issues"] == ["cannot be opened: b"]
    with (homes / "jsonl/j1.jsonl").open("ab") as h:
        h.write(b"\n\xff\xfe\n" + b'{"type":"user","text":"after"}\n')
    s = opened(homes, "jsonl")["j1"]
    assert [m["parts"][0]["text"] for m in s.session["messages"]] == ["a", "after"] and s.skips.malformed == 2
    d = create("claude_code", str(homes / "claude_code")).doctor()
    assert (d["sessions"], d["opened"], d["messages"], d["malformed"], d["partial"]) == (1, 1, 4, 1, 1) and "passed over: projects/p1/subagents/agent-1.jsonl" in d["issues"]
    assert "rollout missing: t2" in create("codex", str(homes / "codex")).doctor()["issues"]


def test_command_line(spark, homes, tmp_path):
    def call(*args):
        out = io.StringIO()
        return run(parser().parse_args(["--home", str(homes), "-o", "json", *args]), spark, out), out.getvalue()

    db = f"file://{tmp_path}/db"
    assert {r["name"]: r["sessions"] for r in json.loads(call("sources")[1])}["claude_code"] == 1
    assert len(json.loads(call("sessions", "--limit", "3")[1])) == 3
    assert call("import", "--db", db)[0] == 0
    assert json.loads(call("search", "parser", "--db", db)[1])[0]["session_id"] == "s1"
    assert call("import", "--db", db, "--embedder", "bytes-4")[0] == 0
    assert json.loads(call("search", "fix the parser", "--mode", "semantic", "--db", db)[1])[0]["score"] == pytest.approx(1)
    assert json.loads(call("search", "parser", "--mode", "hybrid", "--db", db)[1])
    with pytest.raises(ModelMissing):
        embedder("minilm")
    assert json.loads(call("stats", "--by", "day", "--db", db)[1])
    assert json.loads(call("show", "s1", "--message", "1")[1])["role"] == "user" and call("show", "nope")[0] == 1 and call("show", "s1", "--message", "99")[0] == 1
    assert any(r["status"] == "warn" for r in json.loads(call("doctor")[1]))
    assert json.loads(call("snapshot", str(homes / "cursor/state.vscdb"), "--out", str(tmp_path / "o"))[1])[0] == {"snapshot": str(tmp_path / "o/snapshot.db"), "rows": 5, "unchanged": True}
    assert json.loads(call("snapshot", "cursor", "--out", str(tmp_path / "o2"))[1])[0]["rows"] == 5
    assert call("import", "--db", db, "--no-embed")[0] == 0
    assert main(["--root", "x", "sources"]) == 2 and main(["-s", "nope=x", "sources"]) == 2
