"""p2 to p5: brute force, round trips and odd inputs."""

import json
import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from skein.operators import drift as D
from skein.operators import large as L
from skein.operators.hierarchy import descendants, hierarchy, subtree_sizes
from skein.operators.instants import CANONICAL, normalise
from skein.store import explode_messages, explode_parts
from skein.operators.nested import REGISTRIES, SINGLES, TABLES, flat_table, listed_fields, listed_objects

# ---- p2 -------------------------------------------------------------------------------------------


def never(x):
    raise ValueError(x)


def walk(text):
    try:
        top = json.loads(text, parse_constant=never)
    except (TypeError, ValueError):
        return []
    out = []

    def go(v, path, parent):
        if isinstance(v, dict):
            for k, x in v.items():
                if path in REGISTRIES:
                    q, listed = f"{path}{{{k}}}", True
                elif not path and k in SINGLES and isinstance(x, dict):
                    q, listed = f"{k}[0]", True
                else:
                    q, listed = f"{path}.{k}" if path else k, False
                if isinstance(x, dict) and listed:
                    out.append((q, parent))
                go(x, q, q if isinstance(x, dict) and listed else parent)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                q = f"{path}[{i}]"
                if isinstance(x, dict):
                    out.append((q, parent))
                go(x, q, q if isinstance(x, dict) else parent)

    if isinstance(top, dict):
        go(top, "", "")
    return out


def listed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, j string")
    return sorted((r.k, r.path, r.parent_path) for r in listed_objects(df, "j", ["k"]).select("k", "path", "parent_path").collect())


def test_nested_matches_a_walk_of_all_messages(spark, small):
    for name, col in (("messages", "message_json"), ("sessions", "session_json")):
        texts = [r[0] for r in spark.read.parquet(f"{small}/{name}.parquet").select(col).collect()]
        assert listed(spark, texts) == sorted((i, *x) for i, t in enumerate(texts) for x in walk(t))


def test_nested_odd_texts(spark):
    deep = "{}"
    for _ in range(60):
        deep = f'{{"s":[{deep}]}}'
    odd = [None, "", " ", "null", "[]", "[{}]", '"x"', '{"a":[{}]} x', '{"a":[{}]}}', '{"a":[{}]}]', '{"a":[{}]}{}', '{"a":[{}],}', "{'a':[{}]}", '{"a":[{"b":NaN}]}', '{"a":1,"a":[{}]}', '{"a":[null,1,{"b":[[{}]]}]}',
           '{"turns":{"a":{},"b":1,"c":[{}]},"x":{"turns":{"q":{}}}}', '{"peers":{"p":1},"parts":{"q":[{}]},"compactions":[{"kept":[{}]}]}', '{"turns":[{}]}', '{"":[{}],"a.b":[{}]}', deep, json.dumps({"a": ["x" * 200_000, {"y": 1}]})]
    assert listed(spark, odd) == sorted((i, *x) for i, t in enumerate(odd) for x in walk(t))


values = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=3), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["turns", "peers", "cost", "per_model", "a", "b"]), c, max_size=3), max_leaves=12)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.dictionaries(st.sampled_from(["turns", "peers", "cost", "x"]), values, max_size=3), min_size=1, max_size=20))
def test_nested_random_objects(spark, objects):
    texts = [json.dumps(o) for o in objects]
    assert listed(spark, texts) == sorted((i, *x) for i, t in enumerate(texts) for x in walk(t))


def test_flat_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([("s", '{"turns":{"t 1":{"id":"a","duration_ms":"x"},"t2":{"id":2,"duration_ms":7}}}', "p", "v")], "id string, j string, path string, v string")
    got = flat_table(listed_objects(df, "j", ["id"]), ["id"], TABLES["turns"]).orderBy("path").collect()
    assert [(r.key, r.f_id, r.f_duration_ms) for r in got] == [("t 1", "a", None), ("t2", "2", 7)]
    assert listed_objects(df.limit(0), "j", ["id"]).count() == 0


def test_every_kind_of_object_has_a_table(spark, small):
    queries = E.queries()
    assert {f"p2_{n}" for n in TABLES} | {"p2_fields"} <= set(queries)
    found = queries["p2_found"](spark, small)
    none = found.where(~F.col("path").rlike("|".join(p for p, _ in TABLES.values())))
    assert none.count() == 0
    assert all(queries[f"p2_{n}"](spark, small).count() for n in ("windows", "peers", "hooks", "steps", "grid", "marks"))


def test_fields_of_any_kind(spark):
    text = json.dumps({"a": 1, "turns": {"t": {"id": "x", "deep": {"y": None, "tags": ["p", 2]}}, "s": "scalar"}, "new": [{"kinds": [{"k.1": True, "e": {}}], "l": []}, {}, 7], "peers": {"peer_id": "z"}})
    df = spark.createDataFrame([(1, text), (2, "[1]"), (3, None)], "k long, j string")
    got = {(r.path, r.parent_path, r.field, r.value) for r in listed_fields(df, "j", ["k"]).collect()}
    assert got == {("", "", "a", "1"), ("turns{t}", "", "id", "x"), ("turns{t}", "", "deep.y", None), ("turns{t}", "", "deep.tags[0]", "p"), ("turns{t}", "", "deep.tags[1]", "2"), ("", "", "turns{s}", "scalar"), ("new[0].kinds[0]", "new[0]", "k.1", "true"), ("new[0].kinds[0]", "new[0]", "e", "{}"), ("new[0]", "", "l", "[]"), ("", "", "new[2]", "7"), ("peers[0]", "", "peer_id", "z")}


# ---- p3 -------------------------------------------------------------------------------------------


def solve(rows):
    parents, ids = {}, {}
    for i, p in rows:
        k = i.strip().lower() if i else ""
        if k:
            ids[k] = min(ids.get(k, i), i)
            if p and p.strip():
                q = p.strip().lower()
                parents[k] = min(parents.get(k, q), q)
    out = {}
    for k, i in ids.items():
        trail, cyc = [k], None
        while trail[-1] in parents and parents[trail[-1]] in ids:
            n = parents[trail[-1]]
            if n in trail:
                cyc = int(n == k)
                break
            trail.append(n)
        path = [ids[x] for x in trail[::-1]]
        out[i] = ("", -1, "", cyc) if cyc is not None else (path[0], len(path) - 1, "/".join(path), 0)
    return out


def tree(spark, rows):
    df = spark.createDataFrame(rows, "id string, parent_id string").withColumn("k", F.lit(1)).withColumn("depth", F.lit("x"))
    return hierarchy(df)


@pytest.mark.parametrize("seed", range(4))
def test_hierarchy_random_graphs(spark, seed):
    r = random.Random(seed)
    rows = [(f"N{i}", r.choice([None, "", " ", f" n{r.randint(0, 60)} ", f"N{max(0, i - 1)}"])) for i in range(60)] + [("c0", "c1"), ("c1", "c2"), ("c2", "C0 "), ("d", "c1"), ("self", "self"), ("orphan", "gone"), ("dup", "N3"), ("dup", "N3")]
    got = {x.id: (x.root_id, x.depth, x.path, x.in_cycle) for x in tree(spark, rows).collect()}
    assert got == solve(rows)


def test_hierarchy_long_chain_star_and_empty(spark):
    rows = [(f"a{i}", f"a{i - 1}" if i else None) for i in range(120)] + [(f"b{i}", "a0") for i in range(300)]
    t = tree(spark, rows)
    got = {x.id: (x.root_id, x.depth, x.path, x.in_cycle) for x in t.collect()}
    assert got == solve(rows)
    sizes = {x.id: x.descendants for x in subtree_sizes(t).collect()}
    assert sizes["a0"] == 419 and sizes["a118"] == 1
    assert descendants(t).count() == sum(v[1] for v in got.values())
    assert tree(spark, [(None, None), ("", "x"), (" ", None)]).count() == 0


# ---- p4 -------------------------------------------------------------------------------------------


def records(spark, files):
    """files: list of (stream, file, written, [payload or object])."""
    rows, n = [], 0
    for s, f, w, ps in files:
        for p in ps:
            n += 1
            rows.append((n, s, f, n, w, w, p if p is None or isinstance(p, str) else json.dumps(p)))
    df = spark.createDataFrame(rows, "record_id long, stream string, source_file string, line long, written_at string, ingested_at string, payload string")
    return df.withColumns({"written_at": F.to_timestamp_ntz("written_at"), "ingested_at": F.to_timestamp_ntz("ingested_at"), "path": F.lit("clash"), "n": F.lit(0)})


def drift(spark, files):
    got = D.compare_files(D.profile_files(D.distinct_lines(records(spark, files)))).where("change not in ('same','first')").collect()
    return sorted((r.source_file, r.change, r.old_path, r.new_path) for r in got)


def test_drift_renames_types_additions(spark):
    r = random.Random(1)
    a = [{"type": r.choice(["user", "system"]), "git_sha": f"{r.getrandbits(40):010x}", "usage": {"output_tokens": r.randint(10, 900)}, "size": r.randint(1, 99), "cwd": "/work/x"} for _ in range(30)]
    b = [{"type": x["type"], "gitSha": x["git_sha"], "usage": {"outputTokens": x["usage"]["output_tokens"]}, "size": str(x["size"]), "locale": "en-US"} for x in a]
    out = drift(spark, [("s", "z", "2026-01-01 00:00:00", a), ("s", "a", "2026-01-02 00:00:00", b)])
    assert out == sorted([("a", "added", "", "locale"), ("a", "removed", "cwd", ""), ("a", "renamed", "git_sha", "gitSha"), ("a", "renamed", "usage.output_tokens", "usage.outputTokens"), ("a", "type_changed", "size", "size")])


def test_drift_odd_records(spark):
    files = [("s", "f1", "2026-01-01 00:00:00", [None, "", "not json", "[1]", '{"a":NaN}', {"a": 1}, {"a": None, "b": {}}, {"a": True}, {"a": 2}]), ("s", "f2", "2026-01-02 00:00:00", [{"a": 1, "long": "x" * 300_000}]), ("s", "f3", "2026-01-03 00:00:00", []), ("s", "f4", "2026-01-04 00:00:00", ["broken"]), (None, None, "2026-01-01 00:00:00", [{"q": 1}])]
    assert drift(spark, files) == sorted([("f2", "added", "", "long"), ("f4", "removed", "a", ""), ("f4", "removed", "long", "")])
    assert D.compare_files(D.profile_files(D.distinct_lines(records(spark, files).limit(0)))).count() == 0


def test_unified_table_follows_renames(spark):
    a = [{"git_sha": f"{i:010x}", "n": i} for i in range(20)]
    b = [{"gitSha": f"{i + 99:010x}", "n": str(i)} for i in range(20)]
    got = D.unified_table(records(spark, [("s", "f1", "2026-01-01 00:00:00", a + [None, "x"]), ("s", "f2", "2026-01-02 00:00:00", b)])).collect()
    assert len(got) == 40 and all(set(r.fields) == {"git_sha", "n"} for r in got)


def test_unified_table_loses_no_value(spark):
    a = [{"is_error": i % 3 == 0, "n": i} for i in range(20)]
    b = [{"is_error": "Yes" if i % 3 == 0 else "no", "n": f"{i} s"} for i in range(19)] + [{"is_error": "unknown", "n": [1]}]
    other = [{"n": f"text {i}", "is_error": 3} for i in range(20)]
    files = [("s", f"f{k}", f"2026-01-0{k + 1} 00:00:00", x) for k, x in enumerate([a, a, a, b])] + [("t", "g", "2026-01-01 00:00:00", other)]
    got = D.unified_table(records(spark, files)).collect()
    assert len(got) == 100 and all(set(r.fields) | set(r.uncast) == {"is_error", "n"} and not set(r.fields) & set(r.uncast) for r in got)
    last = sorted((r for r in got if r.source_file == "f3"), key=lambda r: r.record_id)
    assert [r.fields.get("is_error") for r in last] == ["true" if i % 3 == 0 else "false" for i in range(19)] + [None]
    assert last[-1].uncast == {"is_error": "unknown", "n": "[1]"} and last[0].uncast == {"n": "0 s"}
    assert {r.fields["n"][:5] for r in got if r.stream == "t"} == {"text "} and not any(r.uncast for r in got if r.stream == "t")


# ---- p5 -------------------------------------------------------------------------------------------


def instants(spark, values, zone="UTC"):
    df = spark.createDataFrame([(i, v, "s", zone) for i, v in enumerate(values)], "i int, v string, s string, z string").withColumns({"_t": F.lit(1), "format": F.lit("x"), "_row": F.lit(2)})
    return {r.i: r.utc_ms for r in normalise(df, "v", "s", "z").collect()}


def test_instants_round_trip_of_formats(spark):
    r, forms = random.Random(5), []
    for _ in range(40):
        t = datetime(2024, 1, 1, tzinfo=UTC) + timedelta(milliseconds=r.randint(0, 10**11))
        z = t.astimezone(ZoneInfo("Asia/Kathmandu"))
        ms = (t - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)
        s = ms // 1000 * 1000
        forms += [(t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms % 1000:03d}456z", ms), (z.strftime("%Y-%m-%d %H:%M:%S %z"), s), (z.strftime("%a, %d %b %Y %H:%M:%S %z"), s), (t.strftime("%d.%m.%Y %H:%M:%S"), s), (t.strftime("%m/%d/%Y %I:%M:%S %p"), s), (t.strftime("%a %b %d %H:%M:%S %Y"), s), (t.strftime("%Y%m%dT%H%M%SZ"), s), (str(ms // 1000), s), (str(ms), ms), (f"{ms}123", ms), (f"{ms}123456", ms), (f" {s // 1000}.{ms % 1000:03d}\n", ms), (z.strftime("%Y-%m-%dT%H:%M:%S+05:45[Asia/Kathmandu]"), s)]
    got = instants(spark, [f for f, _ in forms])
    assert got == {i: ms for i, (_, ms) in enumerate(forms)}


def test_instants_zones_and_daylight(spark):
    zone = ZoneInfo("America/New_York")
    for text, fold in (("2025-11-02 01:30:00", 0), ("2026-03-08 02:30:00", 0), ("2025-07-01 12:00:00", 0)):
        want = datetime.fromisoformat(text).replace(tzinfo=zone, fold=fold).astimezone(UTC)
        assert instants(spark, [text], "America/New_York") == {0: int(want.timestamp() * 1000)}
    assert instants(spark, ["2025-07-01 12:00:00"], "No/Where") == instants(spark, ["2025-07-01 12:00:00"], None)


def test_instants_that_are_none(spark):
    none = [None, "", "  ", "0", "-1", "-1756704520342", "NaN", "n/a", "yesterday", "2026-02-30T10:00:00Z", "2026-13-04T08:00:00Z", "0000-00-00 00:00:00", "2025-01-01 24:01:00", "13/04/2025 10:00:00", "2025-01-01T00:00:00+99:99", "x" * 100_000, "1" * 5000]
    assert instants(spark, none) == {}
    assert normalise(spark.createDataFrame([], "v string, s string, z string"), "v", "s", "z").count() == 0


def test_canonical_is_exact(spark):
    df = spark.createDataFrame([("2025-01-01T00:00:00Z",), ("2025-01-01T00:00:00.5Z",), ("2025-01-01T00:00:00Z\n",), (" 2025-01-01T00:00:00Z",), ("2025-01-01t00:00:00Z",)], "v string")
    assert [r.c for r in df.select(F.col("v").rlike(CANONICAL).alias("c")).collect()] == [True, True, False, False, False]


def test_instants_em_learns_the_order_of_day_and_month(spark):
    sure = [f"{d:02d}.{m:02d}.2025 10:00:00" for d in range(13, 28) for m in (1, 2, 3)]
    df = spark.createDataFrame([(v, "s", "UTC") for v in [*sure, "05.02.2025 10:00:00"]], "v string, s string, z string")
    r = normalise(df, "v", "s", "z", stated={"slash": None, "dot": None}).where("v = '05.02.2025 10:00:00'").first()
    assert r.format == "dot_dmy" and not r.ambiguous


# ---- all together ---------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p4_found", "p5_found"])
def test_found_queries_have_the_stated_columns(spark, small, name):
    want = {"p2_found": ["session_id", "ordinal", "path", "parent_path"], "p3_found": ["id", "root_id", "depth", "path", "in_cycle"], "p4_found": ["stream", "source_file", "change", "old_path", "new_path"], "p5_found": ["table_name", "session_id", "ordinal", "field", "utc_ms"]}[name]
    df = E.queries()[name](spark, small)
    assert df.columns == want
    rows = df.toPandas()
    assert len(rows) and not rows.duplicated().any() and isinstance(rows, pd.DataFrame)


def test_flooding_admits_a_rename_its_start_score_would_not():
    r = random.Random(5)
    held = D.Profiler()
    for i in range(60):
        x = {"id": f"{r.getrandbits(48):012x}", "note": {"who": r.choice("abc"), "mood": f"{r.choice(['calm', 'glad', 'odd'])} {r.randint(1, 500)}", "rank": r.randint(1, 9)}, "end": i}
        y = {"id": x["id"], "note": {"who": r.choice("abc"), "temper": f"{r.choice(['calm', 'bleak', 'fine', 'low'])} {r.randint(1, 500)}", "rank": r.randint(1, 9)}, "end": i}
        held.add("s", "a", "1", json.dumps(x))
        held.add("s", "b", "2", json.dumps(y))
    sides = {"a": {}, "b": {}}
    for f, p, n, at, c in held.flush()[["source_file", "path", "n", "slots", "counts"]].itertuples(index=False):
        if p:
            sides[f][p] = (n, D.dense(at, c))
    assert D.match_fields(sides["a"], sides["b"], 60, 60) == {"note.mood": "note.temper"}
    assert D.match_fields(sides["a"], sides["b"], 60, 60, gain=0.0, least=0.62) == {}
    assert D.match_fields(sides["a"], sides["b"], 60, 60, gain=1.0, least=0.62) == {"note.mood": "note.temper"}


def test_profiles_are_the_same_in_one_part_and_in_many(spark):
    rows = [(i, "s", "f", "2026-01-01 00:00:00", json.dumps({"a": i % 7, "b": {"c": f"x {i}"}} if i % 3 else {"a": None, "z": [i]})) for i in range(400)]
    df = spark.createDataFrame(rows, "record_id long, stream string, source_file string, written_at string, payload string")
    table = lambda d: {r.path: (list(r.n), r.slots, r.counts) for r in D.profile_files(d).collect()}
    one, many = table(df.coalesce(1)), table(df.repartition(6))
    assert one == many and one[""][0][4] == 400 and one["a"][0] == [266.0, 0, 0, 0, 266.0] and set(one) == {"", "a", "b.c", "z"}


# ---- large texts ----------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab\"\\\n{", max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["turns", "peers", "parts", "cost", "per_model", "a"]), x, max_size=3), max_leaves=14), st.sampled_from(["", " ", "x", ",", "{}"]))
def test_walking_tokens_equals_brute_force(v, tail):
    text = json.dumps(v, ensure_ascii=False) + tail
    try:
        got = sorted((p, q) for p, q, _ in L.walk(text, REGISTRIES, SINGLES)[0])
    except L.Malformed:
        got = None
    strict = D.strict_object(text)
    assert got == (None if strict is None else sorted(walk(text)))


def test_large_texts_keep_their_rows_and_fields(spark, monkeypatch):
    texts = ['{"parts":[{"kind":"text","x":[{"y":1},null,{"z":{"w":[{}]}}]},{"kind":"tool"}],"turns":{"t":{"id":1.50},"t":{"id":2,"e":[]}},"peers":{"p":true},"e":{}}', '{"a":1} x', '{"cost":{"per_model":{"m":{"cost_usd":3}}}}', "[]", '{"parts":[1,{"a":']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    objects = lambda: sorted(tuple(r) for r in listed_objects(df, "t", ["k"]).selectExpr("k", "path", "parent_path", "to_json(v)").collect())
    fields = lambda: sorted(tuple(map(str, r)) for r in listed_fields(df, "t", ["k"]).collect())
    want = objects(), fields()
    monkeypatch.setattr("skein.operators.nested.LARGE", 5)
    monkeypatch.setattr("skein.operators.nested.large", lambda c: F.octet_length(c) > 5)
    assert (objects(), fields()) == want and len(want[0]) == 8


def test_a_string_of_33_million_characters_loses_nothing(spark):
    rows = [(i, '{"parts":[{"kind":"text","text":"' + "y" * n + '"},{"kind":"tool","edits":[{"old":"a"}]}]}') for i, n in enumerate((33_000_000, 10))]
    df = spark.createDataFrame(rows, "k int, t string")
    got = listed_objects(df, "t", ["k"]).select("k", "path")
    assert sorted(map(tuple, got.collect())) == [(k, p) for k in (0, 1) for p in ("parts[0]", "parts[1]", "parts[1].edits[0]")]
    f = {(r.k, r.path, r.field): r.n for r in listed_fields(df, "t", ["k"]).selectExpr("k", "path", "field", "length(value) as n").collect()}
    assert f[0, "parts[0]", "text"] == 33_000_000 and f[0, "parts[1].edits[0]", "old"] == 1
    parts = explode_parts(explode_messages(spark.createDataFrame([("s", '{"messages":[' + rows[0][1] + "," + rows[1][1] + "]}")], "id string, session_json string")))
    assert sorted((r.message_ordinal, r.part_ordinal, r.kind, r.n) for r in parts.selectExpr("*", "length(text) as n").collect()) == [(0, 0, "text", 33_000_000), (0, 1, "tool", None), (1, 0, "text", 10), (1, 1, "tool", None)]
