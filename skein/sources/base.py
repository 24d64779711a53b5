"""What all transcript sources share: reading, counting what is skipped, building sessions."""

from __future__ import annotations

import hashlib
import json
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path


class UnknownSource(Exception):
    """A source of a name that is not registered; says which are."""


@dataclass
class Skips:
    """Records left out: not readable, of a type that is not kept, cut off at the end, without what they need."""

    malformed: int = 0
    unknown: int = 0
    partial: int = 0
    ignored: int = 0


@dataclass
class Found:
    """What discovery knows of a session without opening it."""

    id: str
    agent: str
    project_id: str = ""
    started_at: str = ""
    last_activity_at: str = ""
    message_count: int = 0
    where: str = ""
    openable: bool = True
    #: Changes whenever the content may have changed; '' where that cannot be told without opening.
    stamp: str = ""


@dataclass
class Opened:
    session: dict
    skips: Skips = field(default_factory=Skips)


def lines(path: Path, skips: Skips, start: int = 0) -> Iterator[tuple[int, dict]]:
    """(line number, object) of a file of JSON lines; only \\n ends a line, and one without it is held back.

    A line whose bytes are no UTF-8 is malformed, as is one that is no object.
    """
    with open(path, "rb") as f:
        f.seek(start)
        for n, raw in enumerate(f, 1):
            if not raw.endswith(b"\n"):
                skips.partial += 1
                return
            try:
                text = raw.decode("utf-8").strip()
            except UnicodeDecodeError:
                skips.malformed += 1
                continue
            if not text:
                continue
            record = as_object(text)
            if record is None:
                skips.malformed += 1
            else:
                yield n, record


def as_object(text) -> dict | None:
    v = decoded(text)
    return v if isinstance(v, dict) else None


def decoded(text):
    """A JSON value of a text, decoded once; None if there is none."""
    try:
        return json.loads(text) if isinstance(text, str) else None
    except (ValueError, RecursionError):
        return None


def string(v) -> str | None:
    return v if isinstance(v, str) else None


def count(v) -> int | None:
    return v if isinstance(v, int) and not isinstance(v, bool) and v >= 0 else None


def clean(d: dict) -> dict:
    """Without the fields that hold nothing."""
    return {k: v for k, v in d.items() if v is not None}


def message(role: str, parts: list[dict], **more) -> dict:
    return clean({"role": role, "parts": parts, **more})


def session(found: Found, messages: list[dict], **more) -> dict:
    """A session; its times are those of the first and the last message in order that have one."""
    times = [m["timestamp"] for m in messages if m.get("timestamp")]
    base = {"id": found.id, "agent": found.agent, "project_id": found.project_id, "messages": messages, "started_at": times[0] if times else found.started_at, "last_activity_at": times[-1] if times else found.last_activity_at}
    return {**base, **clean(more)}


def content_hash(s: dict) -> str:
    return hashlib.sha256(json.dumps(s, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode("utf-8", "surrogatepass")).hexdigest()


def stamp(*paths: Path) -> str:
    """Sizes and times of change of files; a missing one counts."""
    out = []
    for p in paths:
        try:
            s = p.stat()
            out.append(f"{s.st_size}.{s.st_mtime_ns}")
        except OSError:
            out.append("-")
    return "/".join(out)


def snapshot(path: Path) -> sqlite3.Connection:
    """A database as it is now, though others may be writing to it; it is only read.

    With a write-ahead log a read transaction is held, which sees one state and keeps no one from writing;
    any other database is copied into memory.
    """
    source = sqlite3.connect(f"file:{path}?mode=ro", uri=True, isolation_level=None)
    if source.execute("PRAGMA journal_mode").fetchone()[0] == "wal":
        source.execute("BEGIN")
        source.execute("SELECT count(*) FROM sqlite_master").fetchone()
        return source
    try:
        copy = sqlite3.connect(":memory:")
        source.backup(copy, pages=64, sleep=0.005)
        return copy
    finally:
        source.close()


def snapshot_file(path: Path, into: Path) -> Path:
    """Writes snapshot.db, a copy of a database, into a folder; an older one is replaced."""
    into.mkdir(parents=True, exist_ok=True)
    target = into / "snapshot.db"
    target.unlink(missing_ok=True)
    source, out = sqlite3.connect(f"file:{path}?mode=ro", uri=True), sqlite3.connect(target)
    with out:
        source.backup(out, pages=64, sleep=0.005)
    out.close()
    source.close()
    return target


def beside(path: Path) -> list[Path]:
    """A database and the files of its log that exist."""
    return [p for p in (path, Path(f"{path}-wal"), Path(f"{path}-shm")) if p.exists()]


def digest(paths: list[Path]) -> str:
    """One hash over names and contents; a missing file differs from an empty one."""
    h = hashlib.sha256()
    for p in sorted(paths):
        h.update(str(p).encode() + b"\0")
        h.update(b"1" if p.is_file() else b"0")
        if p.is_file():
            with open(p, "rb") as f:
                while block := f.read(1 << 20):
                    h.update(block)
    return h.hexdigest()


def digest_tree(root: Path) -> str:
    return digest([p for p in root.rglob("*") if p.is_file()])


def tables(db: sqlite3.Connection) -> set[str]:
    return {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}


def rows(db: sqlite3.Connection, name: str, columns: list[str]) -> list[dict]:
    """Columns of a table that it has; the others are None."""
    have = {r[1] for r in db.execute(f"PRAGMA table_info({name})")}
    use = [c for c in columns if c in have]
    if not use:
        return []
    return [dict.fromkeys(columns) | dict(zip(use, r)) for r in db.execute(f"SELECT {', '.join(use)} FROM {name}")]
