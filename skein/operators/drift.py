"""Schemas that drift between the files of a stream: changes, correspondences, one consistent table.

Every file gets a schema graph: its fields (dotted paths to non-objects) with counts by type, the share
of records that have them, and additive profiles of values, shapes, magnitudes and neighbouring keys.
Profiles are sums, so parts of a file of any size are profiled apart and added up. Between a file and the
one before, similarity flooding propagates match scores of field pairs over the edges of the two graphs
(next and previous field, enclosing object, type) until they converge; pairs that are each other's best
and whose converged score is high enough are the correspondences. Chained over the files they give each
field of each file its canonical name.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.hierarchy import hierarchy
from skein.runtime import BROADCAST_ROWS, Workspace, positions, ship

TYPES = ["number", "string", "boolean", "array"]
#: Widths of the profile blocks: exact values, shapes, magnitudes, neighbouring keys.
_BLOCKS = {"value": 96, "shape": 48, "size": 48, "near": 128}
_START = dict(zip(_BLOCKS, np.cumsum([0, *_BLOCKS.values()])))
_WIDTH = sum(_BLOCKS.values())
_ISO = re.compile(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d")
_NUM = re.compile(r"^-?\d+(\.\d+)?$")
_BOOLEAN = {w: t for t, ws in {"true": "true yes y on t 1 1.0", "false": "false no n off f 0 0.0 -0.0"}.items() for w in ws.split()}


def _never(x):
    raise ValueError(x)


def strict_object(text) -> dict | None:
    """The object of a text that is one strict JSON object, else None."""
    if not isinstance(text, str):
        return None
    try:
        o = json.loads(text, parse_constant=_never)
    except (ValueError, RecursionError):
        return None
    return o if isinstance(o, dict) else None


def leaves(o: dict) -> list[tuple[str, object]]:
    """Dotted paths to non-objects in key order; of paths that clash the last holds."""
    out, stack = [], [("", iter(o.items()))]
    while stack:
        for k, v in stack[-1][1]:
            path = f"{stack[-1][0]}.{k}" if stack[-1][0] or len(stack) > 1 else k
            if isinstance(v, dict):
                stack.append((path, iter(v.items())))
                break
            out.append((path, v))
        else:
            stack.pop()
    return list(dict(out).items())


def type_of(v) -> int:
    return 2 if isinstance(v, bool) else 0 if isinstance(v, int | float) else 1 if isinstance(v, str) else 3


def _slot(block: str, token: str) -> int:
    return _START[block] + zlib.crc32(token.encode("utf-8", "replace")) % _BLOCKS[block]


def tokens(v) -> list[int]:
    """Profile slots of a value; numbers in text count as numbers, lists by their elements."""
    if isinstance(v, list):
        return [s for x in v for s in tokens(x)]
    if isinstance(v, dict) or v is None:
        return [_slot("shape", "{}")]
    if isinstance(v, str) and "," in v and re.fullmatch(r"[\w-]+(,[\w-]+)+", v):
        return [s for x in v.split(",") for s in tokens(x)]
    if isinstance(v, bool) or v in ("true", "false", "True", "False"):
        return [_slot("shape", "bool"), _slot("value", "bool")]
    if isinstance(v, int | float) or _NUM.match(v):
        x = abs(float(v)) if len(str(v)) < 300 else math.inf
        if 1e9 <= x < 2.2e9 or 1e12 <= x < 2.2e12 or 1e15 <= x < 2.2e15:
            return [_slot("shape", "time"), _slot("value", "time"), _slot("size", "time")]
        bins = math.floor(3 * math.log10(x)) if 1e-9 < x < 1e300 else -99
        kind = "fraction" if (isinstance(v, float) and v != int(v) if isinstance(v, float) and math.isfinite(v) else "." in str(v)) else "whole"
        near = [_slot("size", f"n{bins + d}") for d in (-1, 0, 0, 1)]
        return [_slot("shape", kind), _slot("value", f"{kind}{x:g}" if x < 1000 else kind), *near]
    if _ISO.match(v):
        return [_slot("shape", "time"), _slot("value", "time"), _slot("size", "time")]
    shape = re.sub(r"[0-9a-f]{6,}", "h", v)
    shape = re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", "a", shape))
    out = [_slot("shape", shape), _slot("shape", "s" + re.sub(r"[\w\s]+", "", v)), _slot("size", f"l{min(len(v).bit_length(), 12)}")]
    return out + [_slot("value", v)] + [_slot("value", w) for w in re.findall(r"\w+", v)]


#: Lines of a file profiled in one go; larger files are cut into parts by a hash of the line's id.
PART_LINES = 50_000


class Profiler:
    """Sums of the profiles of fields; flushed before it holds too much."""

    def __init__(self, most: int = 200_000):
        self.most, self.held = most, 0
        self.files: dict = {}
        self.near: dict = {}

    def add(self, stream, file, written, text) -> None:
        f = self.files.get((stream, file))
        if f is None:
            f = self.files[stream, file] = [written, 0, {}, {}]
        if written is not None and (f[0] is None or written < f[0]):
            f[0] = written
        o = strict_object(text)
        if o is None:
            return
        f[1] += 1
        got = leaves(o)
        layout = tuple((p, v is not None) for p, v in got)
        if layout not in f[2]:
            self.held += len(layout)
        f[2][layout] = f[2].get(layout, 0) + 1
        for p, v in got:
            if v is not None:
                cell = f[3].get(p)
                if cell is None:
                    cell = f[3][p] = ([0, 0, 0, 0], {}, [])
                cell[0][type_of(v)] += 1
                if isinstance(v, list):
                    cell[2].append(v)
                else:
                    k = (type(v), v)
                    cell[1][k] = cell[1].get(k, 0) + 1
        self.held += len(got)

    def full(self) -> bool:
        return self.held >= self.most

    def _near(self, token: str) -> int:
        if token not in self.near:
            self.near[token] = _slot("near", token)
        return self.near[token]

    def flush(self) -> pd.DataFrame:
        """A row a field and one with path '' a file: n (counts by type, records), slots and counts of the profile."""
        out = []
        for (st, f, ), (w, records, layouts, fields) in self.files.items():
            out.append((st, f, "", w, [0.0, 0.0, 0.0, 0.0, float(records)], [], []))
            prof = {p: np.zeros(_WIDTH) for p in fields}
            for layout, n in layouts.items():
                for i, (p, there) in enumerate(layout):
                    if there:
                        for j, side in ((i - 1, "<"), (i + 1, ">"), (i - 2, "<<"), (i + 2, ">>")):
                            prof[p][self._near(side + (layout[j][0] if 0 <= j < len(layout) else ""))] += n
            for p, (types, values, lists) in fields.items():
                x = prof[p]
                for (_, v), n in values.items():
                    for at in tokens(v):
                        x[at] += n
                for v in lists:
                    for at in tokens(v):
                        x[at] += 1
                at = np.flatnonzero(x)
                out.append((st, f, p, w, [*map(float, types), float(sum(types))], at.tolist(), x[at].tolist()))
        self.files, self.held = {}, 0
        return pd.DataFrame(out, columns=["stream", "source_file", "path", "written_at", "n", "slots", "counts"])


def profile_files(records: DataFrame, stream="stream", file="source_file", written="written_at", payload="payload") -> DataFrame:
    """One row per stream, file, path (and path '' for the file): written_at, n, slots and counts of the profile.

    n are the values by type and the records that have the field; of path '' the records of the file.
    Lines that are not a strict JSON object are no records. Null payloads and files without records keep
    their '' row, so each file takes its place in the order of its stream.
    """
    ship(records.sparkSession)
    base = records.select(F.coalesce(F.col(stream), F.lit("")).alias("stream"), F.coalesce(F.col(file), F.lit("")).alias("source_file"), F.col(written).cast("string").alias("written_at"), F.col(payload).alias("payload"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from skein.operators.drift import Profiler

        held = Profiler()
        for b in batches:
            for row in zip(b["stream"], b["source_file"], b["written_at"], b["payload"]):
                held.add(*row)
                if held.full():
                    yield held.flush()
        yield held.flush()

    ws = Workspace(records.sparkSession)
    partial, _ = ws.write(base.mapInPandas(part, "stream string, source_file string, path string, written_at string, n array<double>, slots array<int>, counts array<double>"), "partial")
    # a row a field and part of a file; the parts are added up slot by slot, so no file is ever in one task
    key = ["stream", "source_file", "path"]
    sums = partial.select(*key, F.explode(F.arrays_zip("slots", "counts")).alias("x")).groupBy(*key, F.col("x.slots").alias("slot")).agg(F.sum("x.counts").alias("c"))
    sums = sums.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("slot", "c"))).alias("at"))  # at most as many entries as slots
    heads = partial.groupBy(*key).agg(F.min("written_at").alias("written_at"), F.array(*[F.sum(F.col("n")[i]) for i in range(5)]).alias("n"))
    return heads.join(sums, key, "left").select(*key, "written_at", "n", F.col("at.slot").alias("slots"), F.col("at.c").alias("counts"))


def dense(slots, counts) -> np.ndarray:
    """A profile of all slots; null slots are none."""
    out = np.zeros(_WIDTH)
    if slots is not None:
        out[np.asarray(slots, int)] = counts
    return out


def _name_tokens(path: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", path)]


def name_similarity(a: str, b: str) -> float:
    """Of two paths, by the words in them whatever their style, the last key counting most."""
    la, lb = _name_tokens(a.rsplit(".", 1)[-1]), _name_tokens(b.rsplit(".", 1)[-1])
    if la == lb or "".join(la) == "".join(lb):
        return 1.0
    fa, fb = set(_name_tokens(a)), set(_name_tokens(b))
    if fa == fb:
        return 0.95
    if set(la) <= set(lb) or set(lb) <= set(la):
        return 0.7
    words = len(fa & fb) / max(1, min(len(fa), len(fb)))
    ja, jb = "".join(la), "".join(lb)
    ga, gb = {ja[i : i + 3] for i in range(max(1, len(ja) - 2))}, {jb[i : i + 3] for i in range(max(1, len(jb) - 2))}
    return max(0.8 * words, len(ga & gb) / len(ga | gb))


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of every row of x with every row of y; 0 where one is empty."""
    n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None]
    return np.divide(x @ y.T, n, out=np.zeros_like(n), where=n > 0)


def _block(p: np.ndarray, name: str) -> np.ndarray:
    return p[:, _START[name] : _START[name] + _BLOCKS[name]]


#: Shares of the kinds of edges in what flows into a pair: neighbouring fields one and two apart, enclosing object, type.
EDGES = {">": 0.2, "<": 0.2, ">>": 0.1, "<<": 0.1, "parent": 0.3, "type": 0.1}
#: Similarity of values from which a pair takes in all that flows to it.
FITTING = 0.7
#: Least converged score of a correspondence, relative to that of fields that stayed.
LEAST = 0.4


class _Side:
    """A schema graph: its fields with profiles, and for each kind of edge where it leads and how often."""

    def __init__(self, fields: dict, records: float):
        self.paths = sorted(fields)
        self.at = {p: i for i, p in enumerate(self.paths)}
        self.n = np.array([fields[p][0] for p in self.paths], float).reshape(-1, 5)
        self.profile = np.array([fields[p][1] for p in self.paths], float).reshape(-1, _WIDTH)
        self.rate = self.n[:, 4] / max(records, 1)
        self.records = max(records, 1)
        self.type = np.argmax(self.n[:, :4], 1) if len(self.paths) else np.zeros(0, int)
        parents = [p.rsplit(".", 1)[0] if "." in p else "" for p in self.paths]
        self.parents = sorted(set(parents))
        self.parent = np.array([self.parents.index(p) for p in parents], int)
        near = self.profile[:, _START["near"] : _START["near"] + _BLOCKS["near"]]
        self.edges = {}
        for side in (">", "<", ">>", "<<"):
            slots = np.array([_slot("near", side + p) - _START["near"] for p in self.paths], int)
            w = near[:, slots] / np.maximum(self.n[:, 4:], 1)
            self.edges[side] = np.minimum(w / np.maximum(w.sum(1, keepdims=True), 1.0), 1.0)


def flood(start: np.ndarray, fit: np.ndarray, old: _Side, new: _Side, gain: float = 1.0, rounds: int = 200, least: float = 1e-4) -> np.ndarray:
    """Fixpoint of score = normalised(start + score + what flows in from the pairs that edges of one kind lead to from both fields).

    A pair takes in as much as its values fit: neighbours cannot make a path of a language. Objects match as
    well as their fields do; fields of one type support each other by a constant.
    """
    keep = start > 0
    inside = np.eye(len(old.parents))[old.parent], np.eye(len(new.parents))[new.parent]
    most = np.maximum(1, np.minimum(inside[0].sum(0)[:, None], inside[1].sum(0)[None]))
    same_type = (old.type[:, None] == new.type[None]).astype(float)
    score = start.copy()
    for _ in range(rounds):
        flow = sum(EDGES[k] * (old.edges[k] @ score @ new.edges[k].T) for k in (">", "<", ">>", "<<"))
        best = np.minimum((inside[0].T @ (score**2) @ inside[1]) / most, 1.0)  # of two objects: the share of fields that match
        flow = flow + EDGES["parent"] * best[old.parent][:, new.parent] + EDGES["type"] * same_type
        now = np.where(keep, start + score + gain * fit * flow, 0.0)
        now /= now.max() or 1.0
        moved = np.abs(now - score).max()
        score = now
        if moved < least:
            break
    return score


def similar(old: _Side, new: _Side) -> tuple[np.ndarray, np.ndarray]:
    """Start scores of all pairs, and how well their values fit: 1 for a field that stayed; else by profile of values, name and share of records."""
    out = np.zeros((len(old.paths), len(new.paths)))
    fit = np.ones_like(out)
    for p, i in old.at.items():
        if p in new.at:
            out[i, new.at[p]] = 1.0
    gone, come = [i for p, i in old.at.items() if p not in new.at], [j for p, j in new.at.items() if p not in old.at]
    if not gone or not come:
        return out, fit
    grid = {k: _cosines(_block(old.profile[gone], k), _block(new.profile[come], k)) for k in ("value", "shape", "size")}
    alike = 0.4 * grid["shape"] + 0.35 * grid["value"] + 0.25 * grid["size"]
    name = np.array([[name_similarity(old.paths[i], new.paths[j]) for j in come] for i in gone])
    alike = np.maximum(alike, np.where(name >= 0.95, 0.6, 0.0))  # the same words in another style say enough
    ra, rb = old.rate[gone][:, None], new.rate[come][None]
    spread = np.sqrt(np.maximum(ra * (1 - ra) / old.records + rb * (1 - rb) / new.records, 1e-4))
    rate = np.exp(-0.5 * np.minimum(np.abs(ra - rb) / (spread + 0.05), 6) ** 2 / 4)
    out[np.ix_(gone, come)] = np.maximum(alike * (0.35 + 0.45 * name + 0.2 * rate), 1e-6)
    fit[np.ix_(gone, come)] = np.clip(alike / FITTING, 0, 1) ** 2
    return out, fit


def match_fields(old: dict, new: dict, n_old: float, n_new: float, gain: float = 1.0, least: float = LEAST) -> dict:
    """Renames between two schema graphs: new path by old path. old, new: (n, profile) by path.

    Fields in both are anchors. Of the others, pairs that are each other's best and reach least in the
    converged score correspond; matched pairs leave, and the rest may then be each other's best.
    """
    a, b = _Side(old, n_old), _Side(new, n_new)
    if not a.paths or not b.paths:
        return {}
    score = flood(*similar(a, b), a, b, gain)
    score = score / (np.mean([score[i, b.at[p]] for p, i in a.at.items() if p in b.at] or [score.max()]) or 1.0)
    for p, i in a.at.items():
        if p in b.at:
            score[i, :] = 0.0
            score[:, b.at[p]] = 0.0
    out = {}
    while True:
        i, j = np.unravel_index(int(np.argmax(score)), score.shape)  # the best of all is the best of both of its fields
        if score[i, j] < least:
            return out
        out[a.paths[i]] = b.paths[j]
        score[i, :] = 0.0
        score[:, j] = 0.0


def compare_files(profiles: DataFrame) -> DataFrame:
    """Per file and field of it or of the file before: idx, old_path, new_path, old_type, new_type, change.

    change is added, removed, renamed, type_changed or same; a field renamed and retyped has two rows.
    The first file of a stream has its fields with change first.
    """
    profiles, _ = Workspace(profiles.sparkSession).write(profiles, "profiles")  # read three times below
    files = profiles.where("path = ''").select("stream", "source_file", "written_at")
    files = positions(files, ["written_at", "source_file"], into="idx", within=["stream"]).select("stream", "source_file", F.col("idx").cast("int").alias("idx"))
    known = profiles.join(files, ["stream", "source_file"])
    both = known.withColumn("side", F.lit(1)).unionByName(known.withColumn("idx", F.col("idx") + 1).withColumn("side", F.lit(0)))
    schema = "stream string, source_file string, idx int, change string, old_path string, new_path string, old_type string, new_type string"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [{}, {}]
        total = [0.0, 0.0]
        name = None
        for side, path, n, at, c, f in zip(pdf["side"], pdf["path"], pdf["n"], pdf["slots"], pdf["counts"], pdf["source_file"]):
            if side == 1:
                name = f
            if path == "":
                total[side] = n[4]
            else:
                sides[side][path] = (np.asarray(n), dense(at, c))
        cols = [x.split()[0] for x in schema.split(", ")]
        if name is None:
            return pd.DataFrame([], columns=cols)
        old, new = sides
        kind = lambda s: TYPES[int(np.argmax(s[0][:4]))]
        idx, st, rows = int(pdf["idx"].iloc[0]), pdf["stream"].iloc[0], []
        if idx == 1:
            rows = [("first", "", p, "", kind(s)) for p, s in new.items()]
        else:
            moved = match_fields(old, new, *total)
            for p in old:
                q = p if p in new else moved.get(p)
                if q is None:
                    rows.append(("removed", p, "", kind(old[p]), ""))
                    continue
                rows.append(("same" if p == q else "renamed", p, q, kind(old[p]), kind(new[q])))
                if kind(old[p]) != kind(new[q]):
                    rows.append(("type_changed", p, q, kind(old[p]), kind(new[q])))
            back = set(moved.values())
            rows += [("added", "", q, "", kind(new[q])) for q in new if q not in old and q not in back]
        return pd.DataFrame([(st, name, idx, *r) for r in rows], columns=cols)

    return both.groupBy("stream", "idx").applyInPandas(one, schema)


def distinct_lines(records: DataFrame) -> DataFrame:
    """Lines delivered twice count once, as first delivered; lines without an id count once each text; null names are ''.

    The lines of a file, or of a part of a large one, come into one task, so its fields are profiled together.
    """
    names = [F.coalesce("stream", F.lit("")).alias("stream"), F.coalesce("source_file", F.lit("")).alias("source_file")]
    sizes = records.groupBy(*names).agg(F.count("*").alias("_lines"))
    sizes, seen = Workspace(records.sparkSession).write(sizes.select("stream", "source_file", F.ceil(F.col("_lines") / PART_LINES).cast("int").alias("_parts")).where("_parts > 1"), "large", n=F.count("*"))
    rows = records.select(*names, "record_id", "written_at", "ingested_at", F.when(F.col("record_id").isNull(), F.col("line")).alias("_line"), F.when(F.col("record_id").isNull(), F.col("payload")).alias("_text"), "payload")
    together = ["stream", "source_file"]
    if seen["n"]:
        rows = rows.join(F.broadcast(sizes) if seen["n"] <= BROADCAST_ROWS else sizes, ["stream", "source_file"], "left")
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("record_id", "_line", "_text"), F.coalesce("_parts", F.lit(1))).cast("int"))
        together = [*together, "_part"]
    first = F.min_by(F.struct("written_at", "payload", "ingested_at"), F.struct("ingested_at", "payload"))
    return rows.repartition(*together).groupBy(*together, "record_id", "_line", "_text").agg(first.alias("_f")).select("stream", "source_file", "record_id", "_f.*")


def unified_table(records: DataFrame) -> DataFrame:
    """One row per record: record_id, stream, source_file, written_at, fields and uncast (maps of canonical name to text).

    A field's canonical name is the path under which the chain of correspondences first had it; its
    values are cast to the type most of that name's files in the stream have, and a value that cannot be
    cast keeps its text in uncast. Lines that are no records are dropped.
    """
    ws = Workspace(records.sparkSession)
    lines, _ = ws.write(distinct_lines(records), "lines")
    changes, _ = ws.write(compare_files(profile_files(lines)), "changes")
    key = lambda idx, path: F.to_json(F.array("stream", idx.cast("string"), path))
    at = changes.where("change in ('first', 'added', 'renamed', 'same')")
    chain = at.select(key(F.col("idx"), F.col("new_path")).alias("id"), F.when(F.col("old_path") != "", key(F.col("idx") - 1, F.col("old_path"))).alias("parent_id"))
    # the keys differ in case only where the paths do, so they are compared as they are
    chain = chain.select(F.hex(F.encode("id", "utf-8")).alias("id"), F.hex(F.encode("parent_id", "utf-8")).alias("parent_id"))
    roots = hierarchy(chain).select(F.decode(F.unhex("id"), "utf-8").alias("id"), F.from_json(F.decode(F.unhex("root_id"), "utf-8"), "array<string>")[2].alias("canonical"))
    named = at.withColumn("id", key(F.col("idx"), F.col("new_path"))).join(roots, "id").select("stream", "source_file", F.col("new_path").alias("path"), "canonical", F.col("new_type").alias("type"))
    kinds = named.groupBy("stream", "canonical", "type").agg(F.count("*").alias("n")).groupBy("stream", "canonical").agg(F.max_by("type", F.struct("n", "type")).alias("as_type"))
    maps = named.join(kinds, ["stream", "canonical"]).groupBy("stream", "source_file").agg(F.map_from_entries(F.collect_list(F.struct("path", F.struct("canonical", "as_type")))).alias("names"))
    maps, seen = ws.write(maps, "maps", n=F.count("*"))
    joined = lines.join(F.broadcast(maps) if (seen["n"] or 0) <= BROADCAST_ROWS // 10 else maps, ["stream", "source_file"])

    def cast(v, kind: str):
        if kind == "string":
            return v if isinstance(v, str) else json.dumps(v)
        if kind == "array":
            return json.dumps(v if isinstance(v, list) else v.split(",") if isinstance(v, str) else [v])
        if kind == "number":
            return json.dumps(v) if type_of(v) == 0 else v if isinstance(v, str) and _NUM.match(v) else str(int(v)) if isinstance(v, bool) else None
        return None if isinstance(v, list) else _BOOLEAN.get(str(v).strip().lower())

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, left = [], []
            for names, text in zip(b["names"], b["payload"]):
                o = strict_object(text)
                if o is None:
                    out.append(None)
                    left.append(None)
                    continue
                names = dict(names)
                got, rest = {}, {}
                for path, v in leaves(o):
                    if v is not None and path in names:
                        c = names[path]
                        x = cast(v, c["as_type"])
                        if x is not None:
                            got[c["canonical"]] = x
                        else:
                            rest[c["canonical"]] = cast(v, "string")
                out.append(got)
                left.append(rest)
            res = b[["record_id", "stream", "source_file", "written_at"]].assign(fields=out, uncast=left)
            yield res[res["fields"].notna()]

    return joined.select("record_id", "stream", "source_file", F.col("written_at").cast("string").alias("written_at"), "payload", "names").mapInPandas(rows, "record_id bigint, stream string, source_file string, written_at string, fields map<string,string>, uncast map<string,string>")
