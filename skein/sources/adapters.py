"""The sources of transcripts: where their sessions lie and what their records mean.

Every adapter only reads. discover() lists sessions, open() gives one with what was skipped, or None.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

from skein.sources.base import Found, Opened, Skips, UnknownSource, as_object, clean, content_hash, count, decoded, lines, message, rows, session, snapshot, stamp, string, tables


def _stamp(ms) -> str:
    """RFC 3339 of milliseconds; '' for what is not positive."""
    return datetime.fromtimestamp(ms // 1000, UTC).strftime("%Y-%m-%dT%H:%M:%SZ") if isinstance(ms, int) and ms > 0 else ""


def _text(v) -> str:
    """Contents as text: strings as they are, anything else as JSON."""
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


class Adapter:
    agent = ""

    def __init__(self, root: str):
        self.root = Path(root)

    def discover(self) -> Iterator[Found]:
        raise NotImplementedError

    def records(self, found: Found, skips: Skips) -> dict | None:
        raise NotImplementedError

    def open(self, found: Found) -> Opened | None:
        skips = Skips()
        try:
            s = self.records(found, skips) if found.openable else None
        except (OSError, UnicodeDecodeError):
            s = None
        return Opened(s, skips) if s is not None else None

    def doctor(self) -> dict:
        """Sessions, how many can be opened, records kept and left out, issues, and a status that never stops anything."""
        issues = [] if self.root.exists() else [f"missing: {self.root}"]
        total, seen, opened, messages = Skips(), 0, 0, 0
        for f in self.discover():
            seen += 1
            got = self.open(f)
            if got is None:
                issues.append(f"cannot be opened: {f.id}")
                continue
            opened, messages = opened + 1, messages + len(got.session["messages"])
            for k, v in vars(got.skips).items():
                setattr(total, k, getattr(total, k) + v)
        issues += self.issues()
        issues += [f"{v} records {k}" for k, v in vars(total).items() if v and k in ("malformed", "partial")]
        return {"sessions": seen, "opened": opened, "messages": messages, **vars(total), "issues": issues, "status": "warn" if issues else "ok"}

    def issues(self) -> list[str]:
        """What discovery passes over."""
        return []


class JsonLines(Adapter):
    """One session a file of JSON lines; records of users, assistants and the system."""

    agent = "jsonl"
    roles = ("user", "assistant", "system")

    def discover(self):
        for p in sorted(self.root.glob("*.jsonl")):
            yield Found(p.stem, self.agent, "", where=str(p), stamp=stamp(p))

    def records(self, found, skips):
        out = []
        for n, r in lines(Path(found.where), skips):
            if r.get("type") not in self.roles:
                skips.unknown += 1
                continue
            out.append(message(r["type"], [{"kind": "text", "text": _text(r.get("text", r.get("content", "")))}], timestamp=string(r.get("timestamp")), provenance={"source_file": found.where, "line": n}))
        return session(found, out)


class ClaudeStyle(Adapter):
    """projects/<folder>/<session>.jsonl; state records replace earlier ones."""

    agent = "claude_code"

    def issues(self):
        other = [p for p in self.root.glob("projects/*/**/*") if p.is_file() and (p.suffix != ".jsonl" or p.parent.parent.parent != self.root)]
        return [f"passed over: {p.relative_to(self.root)}" for p in sorted(other)]

    def discover(self):
        for p in sorted(self.root.glob("projects/*/*.jsonl")):
            yield Found(p.stem, self.agent, p.parent.name, where=str(p), stamp=stamp(p))

    def records(self, found, skips):
        out, more, meta = [], {}, {}
        for n, r in lines(Path(found.where), skips):
            kind, got = r.get("type"), None
            if kind == "cost-state":
                more["cost"] = clean({"total_cost_usd": r.get("totalCostUsd"), "total_api_duration_ms": count(r.get("totalApiDurationMs")), "total_tool_duration_ms": count(r.get("totalToolDurationMs")), "total_lines_added": count(r.get("totalLinesAdded")), "total_lines_removed": count(r.get("totalLinesRemoved"))})
                continue
            if kind in ("pr-link", "custom-title"):
                key, v = ("pr_url", string(r.get("url")) or string(r.get("prUrl"))) if kind == "pr-link" else ("title", string(r.get("title")))
                if v is not None:
                    meta[key] = v
                continue
            content = r.get("message", {}).get("content") if isinstance(r.get("message"), dict) else None
            if kind == "user":
                got = message("user", self._said(content))
            elif kind == "assistant":
                got = message("assistant", self._answered(content))
            elif kind == "system":
                got = message("system", [{"kind": "system", "text": string(r.get("content")) or ""}])
            elif kind == "summary":
                got = message("user", [{"kind": "text", "text": string(r.get("summary")) or ""}], is_compaction_summary=True)
            if got is None or not got["parts"]:
                skips.unknown += 1
                continue
            where = clean({"source_file": found.where, "line": n, "record_id": string(r.get("uuid")), "record_type": kind, "parent_record": string(r.get("parentUuid")) or None})
            out.append({**got, **clean({"timestamp": string(r.get("timestamp"))}), "provenance": where})
        return session(found, out, metadata=meta or None, **more)

    @staticmethod
    def _said(content) -> list[dict]:
        if isinstance(content, str):
            return [{"kind": "text", "text": content}]
        parts = []
        for b in content if isinstance(content, list) else []:
            if isinstance(b, dict) and b.get("type") == "text":
                parts.append({"kind": "text", "text": string(b.get("text")) or ""})
            elif isinstance(b, dict) and b.get("type") == "tool_result":
                parts.append(clean({"kind": "tool_result", "call_id": string(b.get("tool_use_id")) or "", "text": _text(b["content"]) if b.get("content") is not None else None}))
        return parts

    @staticmethod
    def _answered(content) -> list[dict]:
        parts = []
        for b in content if isinstance(content, list) else []:
            kind = b.get("type") if isinstance(b, dict) else None
            if kind == "text":
                parts.append({"kind": "text", "text": string(b.get("text")) or ""})
            elif kind == "thinking":
                parts.append(clean({"kind": "thinking", "text": string(b.get("thinking")), "signature": string(b.get("signature"))}))
            elif kind == "tool_use":
                parts.append(clean({"kind": "tool_call", "id": string(b.get("id")) or "", "name": string(b.get("name")) or "", "arguments": {"value": b["input"]} if "input" in b else None}))
        return parts


class CodexStyle(Adapter):
    """An index of threads in SQLite, with edges to those that spawned them, and rollouts of JSON lines."""

    agent = "codex"
    index = "state_5.sqlite"
    columns = ["id", "rollout_path", "created_at", "updated_at", "cwd", "title", "archived", "git_sha", "git_branch", "git_origin_url", "model", "created_at_ms", "updated_at_ms"]

    def _threads(self) -> list[dict]:
        if not (self.root / self.index).is_file():
            return []
        db = snapshot(self.root / self.index)
        try:
            have = tables(db)
            parents = {r["child_thread_id"]: r["parent_thread_id"] for r in rows(db, "thread_spawn_edges", ["parent_thread_id", "child_thread_id"])} if "thread_spawn_edges" in have else {}
            return [t | {"parent_id": parents.get(t["id"])} for t in (rows(db, "threads", self.columns) if "threads" in have else [])]
        finally:
            db.close()

    def discover(self):
        for t in sorted(self._threads(), key=lambda t: str(t["id"])):
            path = Path(t["rollout_path"] or "")
            path = path if path.is_absolute() else self.root / path
            if path.is_file():
                ms = lambda a, b: t[a] if t[a] is not None else (t[b] or 0) * 1000  # noqa: B023, E731
                yield Found(t["id"], self.agent, t["cwd"] or "", _stamp(ms("created_at_ms", "created_at")), _stamp(ms("updated_at_ms", "updated_at")), where=json.dumps({"file": str(path), "thread": t}), stamp=f"{stamp(path)}/{content_hash(t)[:16]}")

    def issues(self):
        gone = [t for t in self._threads() if not (Path(t["rollout_path"] or "") if Path(t["rollout_path"] or "").is_absolute() else self.root / (t["rollout_path"] or "")).is_file()]
        return [f"rollout missing: {t['id']}" for t in gone]

    def records(self, found, skips):
        at = json.loads(found.where)
        t, kept = at["thread"], []
        for n, r in lines(Path(at["file"]), skips):
            if isinstance(r.get("ordinal"), int):
                kept.append((r["ordinal"], n, r))
            else:
                skips.malformed += 1
        out, usage, windows, turns = [], None, {}, {}
        for _, n, r in sorted(kept, key=lambda x: x[:2]):
            p = r["payload"] if isinstance(r.get("payload"), dict) else {}
            if r.get("type") == "response_item":
                got = self._item(p)
                if got is None:
                    skips.ignored += p.get("type") == "reasoning"
                    skips.unknown += p.get("type") != "reasoning"
                else:
                    out.append({**got, **clean({"timestamp": string(r.get("timestamp")), "turn_id": string(p.get("turn_id"))}), "provenance": {"source_file": at["file"], "line": n, "ordinal": r["ordinal"]}})
            elif r.get("type") == "token_usage_record":
                usage = clean({k: count(p.get(k)) for k in ("input_tokens", "output_tokens", "cached_input_tokens", "reasoning_output_tokens")})
            elif r.get("type") == "compacted" and string(p.get("window_id")):
                windows[p["window_id"]] = clean({"previous_window": string(p.get("previous_window")), "retained_context": string(p.get("retained_context"))})
            elif r.get("type") == "task_complete":
                k = string(p.get("turn_id")) or "turn"
                turns[k] = clean({"id": k, "status": string(p.get("status")) or "completed", "duration_ms": count(p.get("duration_ms")), "time_to_first_token_ms": count(p.get("time_to_first_token_ms"))})
            else:
                skips.unknown += 1
        meta = clean({k: t.get(k) or None for k in ("title", "git_sha", "git_branch", "git_origin_url", "cwd", "model")} | {"archived": True if t.get("archived") else None})
        return session(found, out, usage=usage, compaction_windows=windows or None, turns=turns or None, metadata=meta or None, parent_id=t.get("parent_id"))

    @staticmethod
    def _item(p: dict) -> dict | None:
        kind = p.get("type")
        if kind == "message":
            content = p.get("content")
            blocks = [content] if isinstance(content, str) else [b.get("text") for b in content if isinstance(b, dict) and b.get("type") in ("input_text", "output_text", "text")] if isinstance(content, list) else []
            parts = [{"kind": "text", "text": x} for x in blocks if isinstance(x, str)]
            role = {"developer": "system"}.get(p.get("role"), p.get("role"))
            return message(role, parts, origin="developer" if p.get("role") == "developer" else None) if parts and role in ("user", "assistant", "system") else None
        if kind == "reasoning":
            text = "\n".join(s["text"] for s in p.get("summary") or [] if isinstance(s, dict) and isinstance(s.get("text"), str))
            return message("assistant", [{"kind": "thinking", "text": text}]) if text else None
        if kind == "function_call":
            v = decoded(p.get("arguments"))
            return message("assistant", [clean({"kind": "tool_call", "id": string(p.get("call_id")) or "", "name": string(p.get("name")) or "", "arguments": {"raw": p["arguments"], "parsed": v} if v is not None else None})])
        if kind == "function_call_output":
            return message("tool", [clean({"kind": "tool_result", "call_id": string(p.get("call_id")) or "", "text": _text(p["output"]) if p.get("output") is not None else None})])
        return None


class CursorStyle(Adapter):
    """A key-value table: headers of the composers, a composer's order of bubbles, and the bubbles."""

    agent = "cursor"
    store = "state.vscdb"

    def _get(self, db, key: str):
        r = db.execute("SELECT value FROM cursorDiskKV WHERE key = ?", (key,)).fetchone()
        v = r[0] if r else None
        return decoded(v.decode("utf-8", "replace") if isinstance(v, bytes) else v)

    _held = None

    def _db(self, again: bool = False):
        """The database as it was when first asked for: one snapshot for all sessions an adapter opens."""
        if self._held is None or again:
            db = snapshot(self.root / self.store) if (self.root / self.store).is_file() else None
            self._held = (db if db is not None and "cursorDiskKV" in tables(db) else None,)
        return self._held[0]

    def discover(self):
        db = self._db(again=True)
        headers = self._get(db, "composerHeaders") if db else None
        for h in sorted((h for h in headers or [] if isinstance(h, dict) and string(h.get("composerId"))), key=lambda h: h["composerId"]):
            yield Found(h["composerId"], self.agent, string(h.get("name")) or "", where=str(h.get("lastUpdatedAt", "")), stamp=str(h.get("lastUpdatedAt", "")))

    def records(self, found, skips):
        db = self._db()
        data = self._get(db, f"composerData:{found.id}") if db else None
        if not isinstance(data, dict):
            return None
        out = []
        for h in data.get("fullConversationHeadersOnly") or []:
            b = self._get(db, f"bubbleId:{found.id}:{h.get('bubbleId')}") if isinstance(h, dict) else None
            if not isinstance(b, dict):
                skips.malformed += 1
                continue
            role = {1: "user", 2: "assistant"}.get(b.get("type"))
            if role is None:
                skips.unknown += 1
                continue
            parts = [{"kind": k, "text": b[k]} for k in ("text", "thinking") if string(b.get(k))]
            tool = b.get("toolFormerData")
            if isinstance(tool, dict):
                v = decoded(tool.get("params"))
                parts.append(clean({"kind": "tool_call", "id": h["bubbleId"], "name": string(tool.get("name")) or "", "arguments": {"raw": tool["params"], "parsed": v} if v is not None else None}))
            if string(b.get("toolResultBlob")):
                parts.append({"kind": "blob", "blob_hash": b["toolResultBlob"], "container": "agentKv:blob"})
            if not parts:
                skips.malformed += 1
                continue
            out.append(message(role, parts, id=h["bubbleId"], timestamp=string(b.get("createdAt"))))
        return session(found, out) | {"started_at": "", "last_activity_at": ""}

    @staticmethod
    def changed(before: dict[str, str], now: list[Found]) -> list[str]:
        """Ids whose stamp differs from the one seen before."""
        return [f.id for f in now if before.get(f.id) != f.where]


class CursorTranscripts(Adapter):
    """<project>/agent-transcripts/*.jsonl with role, text, thinking and timestamp."""

    agent = "cursor"

    def discover(self):
        for p in sorted(self.root.glob("*/agent-transcripts/*.jsonl")):
            yield Found(p.stem, self.agent, p.parent.parent.name, where=str(p), stamp=stamp(p))

    def records(self, found, skips):
        out = []
        for n, r in lines(Path(found.where), skips):
            parts = [{"kind": k, "text": r[k]} for k in ("thinking", "text") if string(r.get(k))]
            if r.get("role") not in ("user", "assistant", "system", "tool") or not parts:
                skips.unknown += 1
                continue
            out.append(message(r["role"], parts, timestamp=string(r.get("timestamp")), provenance={"source_file": found.where, "line": n}))
        return session(found, out)


class EntryLogs(Adapter):
    """One JSON object a session with numbered entries; a roster of owners; stubs of agents that run elsewhere."""

    agent = "grok_bot"
    folder = "sand-client-persistence"

    def _json(self, name: str):
        p = self.root / self.folder / name
        return decoded(p.read_text("utf-8", "replace")) if p.is_file() else None

    def discover(self):
        roster = self._json("roster.json")
        for p in sorted((self.root / self.folder).glob("*.json")):
            if p.name not in ("roster.json", "cloud-agents.json"):
                owner = roster.get(p.stem) if isinstance(roster, dict) else None
                yield Found(p.stem, self.agent, string(owner) or "", where=str(p), stamp=f"{stamp(p)}/{string(owner) or ''}")
        for s in self._json("cloud-agents.json") or []:
            if isinstance(s, dict) and string(s.get("agentId")):
                yield Found(s["agentId"], self.agent, openable=False)

    def records(self, found, skips):
        o = as_object(Path(found.where).read_text("utf-8"))
        if o is None:
            return None
        entries = [(e["seq"], i, e) for i, e in enumerate(o.get("entries") or []) if isinstance(e, dict) and isinstance(e.get("seq"), int)]
        skips.ignored += len(o.get("entries") or []) - len(entries)
        out = []
        for seq, _, e in sorted(entries, key=lambda x: x[:2]):
            if e.get("type") == "message" and isinstance(e.get("text"), str):
                role = e["role"] if e.get("role") in ("assistant", "system") else "user"
                out.append(message(role, [{"kind": "text", "text": e["text"]}], author=string(e.get("author")), timestamp=string(e.get("timestamp")), provenance={"source_file": found.where, "ordinal": seq}))
            elif e.get("type") == "message":
                skips.malformed += 1
            elif e.get("type") == "voice_call":
                out.append(message("system", [e], timestamp=string(e.get("timestamp"))))
            else:
                skips.unknown += 1
        return session(found, out, partial={"reason": "local_cap"} if o.get("capped") is True else None)


class StepLogs(Adapter):
    """A list of conversations in SQLite, steps as JSON lines, and results of tools in a second database."""

    agent = "antigravity"
    index = "conversation_summaries.db"

    def discover(self):
        if not (self.root / self.index).is_file():
            return
        db = snapshot(self.root / self.index)
        for r in sorted(rows(db, "conversations", ["id", "name", "updated_at"]) if "conversations" in tables(db) else [], key=lambda r: str(r["id"])):
            yield Found(r["id"], self.agent, "", "", r["updated_at"] or "", where=str(self.root / "brain" / r["id"]), stamp=stamp(self.root / "brain" / r["id"] / ".system_generated" / "logs" / "transcript.jsonl", self.root / "brain" / r["id"] / "payload.db"))

    def records(self, found, skips):
        base = Path(found.where)
        path, links = base / ".system_generated" / "logs" / "transcript.jsonl", {}
        if not path.is_file():
            return None
        if (base / "payload.db").is_file():
            db = snapshot(base / "payload.db")
            links = {r["step_index"]: r for r in rows(db, "tool_links", ["step_index", "call_id", "result"])} if "tool_links" in tables(db) else {}
        steps = []
        for n, r in lines(path, skips):
            if isinstance(r.get("step_index"), int):
                steps.append((r["step_index"], n, r))
            else:
                skips.malformed += 1
        out = []
        for step, n, r in sorted(steps, key=lambda x: x[:2]):
            kind, where = r.get("type"), {"source_file": str(path), "line": n, "ordinal": step}
            text, at = string(r.get("content")) or string(r.get("summary")) or "", string(r.get("created_at"))
            if kind == "TOOL_CALL":
                link = links.get(step)
                if link is None:
                    skips.malformed += 1
                    continue
                v = decoded(r.get("arguments"))
                call = clean({"kind": "tool_call", "id": link["call_id"] or "", "name": string(r.get("toolName")) or "", "arguments": {"raw": r["arguments"], "parsed": v} if v is not None else None})
                out += [message("assistant", [call], timestamp=at, provenance=where), message("tool", [clean({"kind": "tool_result", "call_id": link["call_id"] or "", "text": link["result"]})], provenance=where)]
                continue
            role = {"USER_INPUT": "user", "PLANNER_RESPONSE": "assistant", "CHECKPOINT": "assistant", "ERROR_MESSAGE": "system"}.get(kind)
            if role is None:
                skips.unknown += 1
                continue
            out.append(message(role, [{"kind": "text", "text": text}], timestamp=at, provenance=where, is_compaction_summary=True if kind == "CHECKPOINT" else None, is_error=True if kind == "ERROR_MESSAGE" else None))
        return session(found, out)


class Fixture(Adapter):
    """Sessions held in memory, for tests: counts what is opened, and some ids cannot be."""

    agent = "fixture"

    def __init__(self, root: str = "", sessions: dict[str, dict] | None = None, blocked: tuple[str, ...] = ()):
        super().__init__(root or ".")
        self.sessions, self.blocked, self.opened = sessions or {}, set(blocked), 0

    def discover(self):
        for k, s in self.sessions.items():
            yield Found(k, self.agent, s.get("project_id", ""), s.get("started_at", ""), s.get("last_activity_at", ""), len(s.get("messages", [])), openable=k not in self.blocked)

    def records(self, found, skips):
        self.opened += 1
        return session(found, self.sessions[found.id].get("messages", []))


SOURCES: dict[str, type[Adapter]] = {"claude_code": ClaudeStyle, "codex": CodexStyle, "cursor": CursorStyle, "cursor_transcripts": CursorTranscripts, "grok_bot": EntryLogs, "antigravity": StepLogs, "jsonl": JsonLines}


def create(name: str, root: str) -> Adapter:
    key = name.replace("-", "_")
    if key not in SOURCES:
        raise UnknownSource(f"unknown source {name!r}; known: {', '.join(sorted(SOURCES))}")
    return SOURCES[key](root)
