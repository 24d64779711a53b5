"""The command line: sources, sessions, show, doctor, snapshot, import, scan, search, stats."""

from __future__ import annotations

import argparse
import json
import signal
import sys
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.embed import embedder
from skein.functions.instants import parse_cutoff
from skein.operators import search as R
from skein.operators import sessions as S
from skein.runtime import local_session
from skein.sources import base
from skein.sources.adapters import SOURCES, create
from skein.store import Store
from skein.streaming.scan import Clock, found, reported, scan

OK, NOT_FOUND, USAGE, FAILED, STOPPED = 0, 1, 2, 3, 130
LISTED = ["id", "agent", "project_id", "started_at", "last_activity_at", "message_count"]


class Usage(Exception):
    pass


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skein", description="Conversation histories of coding assistants, on Spark.")
    p.add_argument("-s", "--source", action="append", default=[], help="a source, or name=folder; may be repeated")
    p.add_argument("--root", help="folder of the one source given")
    p.add_argument("--home", default=str(Path.home()), help="folder that holds a folder for each source")
    p.add_argument("-o", "--output", choices=["human", "json", "ndjson"], default="human")
    p.add_argument("--no-truncate", action="store_true")
    v = p.add_subparsers(dest="verb", required=True)
    v.add_parser("sources")
    x = v.add_parser("sessions")
    for a in ("--project", "--since", "--until", "--db"):
        x.add_argument(a)
    x.add_argument("--limit", type=int)
    x = v.add_parser("show")
    x.add_argument("id")
    x.add_argument("--message", type=int)
    v.add_parser("doctor")
    x = v.add_parser("snapshot")
    x.add_argument("database")
    x.add_argument("--out", required=True)
    x = v.add_parser("import")
    x.add_argument("--db", required=True)
    x.add_argument("--full", action="store_true")
    x.add_argument("--dry-run", action="store_true")
    x.add_argument("--embedder", help="also store vectors of this model; by default that of the store")
    x.add_argument("--no-embed", action="store_true", help="store no vectors")
    x = v.add_parser("scan")
    x.add_argument("--store", required=True)
    x.add_argument("--since")
    x.add_argument("--interval", type=float, default=60)
    x.add_argument("--once", action="store_true")
    x.add_argument("--dry-run", action="store_true")
    x = v.add_parser("search")
    x.add_argument("query")
    x.add_argument("--db", required=True)
    x.add_argument("--mode", choices=["text", "semantic", "hybrid"], default="text")
    x.add_argument("--project")
    x.add_argument("--limit", type=int, default=10)
    x = v.add_parser("stats")
    x.add_argument("--by", choices=["source", "project", "day"], default="source")
    x.add_argument("--db", required=True)
    return p


def roots(args) -> dict[str, str]:
    """Folders of the chosen sources; --root needs exactly one."""
    named = dict(s.split("=", 1) if "=" in s else (s, None) for s in args.source)
    if args.root and len(named) != 1:
        raise Usage("--root needs exactly one --source")
    names = list(named) or [n for n in SOURCES if (Path(args.home) / n).exists()]
    return {n.replace("-", "_"): named.get(n) or args.root or str(Path(args.home) / n) for n in names}


def show_rows(rows: list[dict], args, out) -> None:
    """Machine formats are never cut; the human one is cut to 40 characters a cell unless told otherwise."""
    if args.output == "json":
        print(json.dumps(rows, ensure_ascii=False), file=out)
    elif args.output == "ndjson":
        for r in rows:
            print(json.dumps(r, ensure_ascii=False), file=out)
    elif rows:
        cell = lambda v: ("" if v is None else str(v)).split("\n")[0]
        cut = lambda v: v if args.no_truncate or len(v) <= 40 else "…" + v[-39:]
        table = [list(rows[0])] + [[cut(cell(v)) for v in r.values()] for r in rows]
        width = [max(len(r[i]) for r in table) for i in range(len(table[0]))]
        for r in table:
            print("  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip(), file=out)


def emit(df: DataFrame, args, out) -> None:
    show_rows([r.asDict(recursive=True) for r in df.toLocalIterator()], args, out)


def listing(args, spark) -> DataFrame:
    if getattr(args, "db", None):
        return Store(spark, args.db).read("sessions")
    return reported(spark, roots(args)).dropDuplicates(["agent", "id", "project_id"])


def run(args, spark, out=sys.stdout) -> int:
    if args.verb == "sources":
        rows = []
        for n, r in roots(args).items():
            a = create(n, r)
            rows.append({"name": n, "agent": a.agent, "root": r, "sessions": sum(1 for _ in a.discover()), "status": "ok" if Path(r).exists() else "missing"})
        show_rows(rows, args, out)
    elif args.verb == "doctor":
        show_rows([{"name": n, **create(n, r).doctor()} for n, r in roots(args).items()], args, out)
    elif args.verb == "sessions":
        cut = {k: parse_cutoff(getattr(args, k)) for k in ("since", "until") if getattr(args, k)}
        flt = S.SessionFilter(agents=tuple(create(n, ".").agent for n in roots(args)) if args.source else (), project=args.project, limit=args.limit, **cut)
        emit(flt.apply(listing(args, spark)).select(*LISTED), args, out)
    elif args.verb == "show":
        if args.message is not None and args.message < 1:
            raise Usage("--message counts from 1")
        live = reported(spark, roots(args)).where("openable")
        ids = [r["id"] for r in S.resolve(live, args.id).limit(20).collect()]
        if len(ids) != 1:
            print(f"ambiguous: {', '.join(ids)}" if ids else f"unknown session: {args.id}", file=sys.stderr)
            return NOT_FOUND
        s = json.loads(live.where(F.col("id") == ids[0]).first()["session_json"])
        if args.message is not None and args.message > len(s["messages"]):
            return NOT_FOUND
        print(json.dumps(s if args.message is None else s["messages"][args.message - 1], ensure_ascii=False, indent=2), file=out)
    elif args.verb == "snapshot":
        path = Path(args.database)
        if not path.is_file():  # a source in place of a file
            a = create(args.database, roots(argparse.Namespace(**{**vars(args), "source": args.source or [args.database]}))[args.database.replace("-", "_")])
            name = getattr(a, "store", None) or getattr(a, "index", None)
            if name is None:
                raise Usage(f"{args.database} has no database")
            path = a.root / name
        files = base.beside(path)
        before = base.digest(files)
        copy = base.snapshot_file(path, Path(args.out))
        db = base.snapshot(copy)
        table = next((t for t in ("events", "cursorDiskKV") if t in base.tables(db)), None)
        n = db.execute(f"SELECT count(*) FROM {table}").fetchone()[0] if table else None
        show_rows([{"snapshot": str(copy), "rows": n, "unchanged": base.digest(files) == before}], args, out)
    elif args.verb == "import":
        store = Store(spark, args.db)
        name = None if args.no_embed else args.embedder or store.manifest()["embedding_model"]
        emit(store.sync(found(spark, roots(args)), force=args.full, dry_run=args.dry_run, embedder=embedder(name) if name else None), args, out)
    elif args.verb == "scan":
        clock = Clock()
        for sig in (signal.SIGINT, signal.SIGTERM):
            signal.signal(sig, lambda *_: setattr(clock, "stopped", True))

        def each(n, result):
            print(f"pass {n}: {result}", file=sys.stderr) if isinstance(result, Exception) else emit(result, args, out)
            out.flush()

        scan(spark, Store(spark, args.store), roots(args), args.interval, args.once, parse_cutoff(args.since) if args.since else None, args.dry_run, clock, each)
        return STOPPED if clock.stopped else OK
    elif args.verb == "search":
        if len(args.source) > 1:
            raise Usage("at most one --source")
        store = Store(spark, args.db)
        flt = S.SessionFilter(agents=tuple(create(n, ".").agent for n in roots(args)) if args.source else (), project=args.project)
        chosen = flt.apply(store.read("sessions")) if args.source or args.project else None
        index, model = store.index(), store.manifest()["embedding_model"]
        vector = embedder(model).embed([args.query])[0] if model and args.mode != "text" else None
        if args.mode == "text":
            hits = R.text_search(index, args.query, chosen)
        elif args.mode == "semantic":
            hits = R.semantic_search(store.read("vectors"), index, vector, args.limit, chosen)
        else:
            hits = R.hybrid_search(index, store.read("vectors"), args.query, vector, chosen)
        emit(hits.limit(args.limit), args, out)
    elif args.verb == "stats":
        emit(S.buckets(Store(spark, args.db).read("sessions"), args.by), args, out)
    return OK


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args, local_session())
    except (Usage, ValueError, base.UnknownSource) as e:
        print(e, file=sys.stderr)
        return USAGE
    except Exception as e:  # noqa: BLE001
        print(f"{type(e).__name__}: {str(e)[:400]}", file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    sys.exit(main())
