"""Every query with SQL gives what its SQL gives; search functions against FTS5 and by hand."""

import sqlite3

import pytest
from compare import connect, same
from pyspark.sql import functions as F

import __spark_entry__ as E
from skein.functions import text as T
from skein.functions.embed import ByteEmbedder
from skein.functions.instants import parse_cutoff
from skein.functions.sentiment import compound
from skein.operators import search as R
from skein.operators import sessions as S
from skein.runtime import positions
from skein.sources.base import content_hash


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", [n for n in E.queries() if n in E.oracle_sql()])
def test_query_equals_its_sql(spark, small, con, name):
    ok, said = same(name, spark, small, con)
    assert ok, said


def parts(spark, rows):
    return spark.createDataFrame(rows, "session_id string, message_ordinal long, part_ordinal long, text string")


def test_text_ranks_equal_fts5(spark):
    texts = ["login login login", "login failed", "Foo_bar foo bar", "größe Login-Seite", "", None, "nothing here", "LOGIN and failed login"]
    rows = [(f"s{i % 3}", i, 0, t) for i, t in enumerate(texts)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(t)")
    db.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", [(i + 1, t) for i, t in enumerate(texts) if t is not None])
    for q, match in (("login", '"login"'), ("login failed", '"login" "failed"'), ("foo_bar", '"foo bar"'), ("GROSSE", '"GROSSE"'), ("grosse", '"grosse"')):
        want = {i - 1: round(r, 9) for i, r in db.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (match,))}
        got = {r.message_ordinal: round(r["rank"], 9) for r in R.part_scores(R.Index.of(parts(spark, rows)), q).collect()}
        assert got == want, q


def test_text_search_order_score_and_empty(spark):
    p = parts(spark, [("r2", 0, 0, "login"), ("r1", 0, 0, "login"), ("r1", 1, 0, "login"), ("r1", 1, 1, None)])
    got = [(r.session_id, r.message_ordinal, round(r.score, 9)) for r in R.text_search(R.Index.of(p), "Login!").collect()]
    assert got == [("r1", 0, round(1 / 61, 9)), ("r1", 1, round(1 / 61, 9)), ("r2", 0, round(1 / 62, 9))]
    assert R.text_search(R.Index.of(p), "?!").count() == 0 and R.text_search(R.Index.of(p.limit(0)), "login").count() == 0
    assert [r.session_id for r in R.text_search(R.Index.of(p), "login", limit=2).collect()] == ["r1", "r1"]


def test_a_search_reads_the_postings_of_its_words_only(spark, small):
    hits = E.queries()["text_search_phrase"](spark, small)
    plan = hits._jdf.queryExecution().toString()
    assert "EqualTo(term,last)" in plan and "EqualTo(term,seen)" in plan and "regexp_extract_all" not in plan


def test_hybrid_fusion(spark):
    p = parts(spark, [("b", 0, 0, "login login"), ("b", 1, 0, "login"), ("a", 0, 0, "login"), ("c", 0, 0, "other")])
    v = spark.createDataFrame([("a", 0, 0, [0.9, 0.43588989]), ("c", 0, 0, [0.5, 0.8660254]), ("b", 0, 0, [-1.0, 0.0]), ("b", 1, 0, [0.0, 0.0])], "session_id string, message_ordinal long, part_ordinal long, embedding array<float>")
    got = [(r.session_id, round(r.score, 5)) for r in R.hybrid_search(R.Index.of(p), v, "login", [1.0, 0.0]).collect()]
    assert got == [("a", round(1 / 62 + 0.9, 5)), ("c", 0.5), ("b", round(1 / 61, 5)), ("b", round(1 / 61, 5))]
    assert R.hybrid_search(R.Index.of(p), v, "login", None).count() == 3 and R.semantic_search(v, R.Index.of(p), None).count() == 0
    only = spark.createDataFrame([("c",)], "id string")
    assert [r.session_id for r in R.semantic_search(v, R.Index.of(p), [1.0, 0.0], 5, only, prefilter=True).collect()] == ["c"]


def test_classification_of_reports(spark):
    cols = "id string, agent string, last_activity_at string, message_count long, content_hash string"
    stored = spark.createDataFrame([("same", "a", "t1", 1, "h"), ("touched", "a", "t1", 1, "h"), ("changed", "a", "t1", 1, "h"), ("gone", "a", "t1", 1, "h"), ("broken", "a", "t1", 1, "h")], cols)
    reported = spark.createDataFrame(
        [("same", "a", "t1", 1, "x", True, 0, 0), ("touched", "a", "t2", 1, "h", True, 0, 1), ("changed", "a", "t2", 3, "n", True, 0, 2), ("new", "b", "t9", 2, "n", True, 1, 0), ("new", "c", "a0", 2, "n", True, 2, 0), ("old", "b", "a0", 2, "n", True, 1, 1), ("broken", "a", "t2", 2, None, False, 0, 3)],
        cols + ", openable boolean, source_place int, place int",
    )
    got = {r.id: r.outcome for r in S.classify(reported, stored, since="b").collect()}
    assert got == {"same": "unchanged", "touched": "unchanged", "changed": "updated", "new": "new", "old": "skipped", "broken": "error"}
    assert {r.id: r.outcome for r in S.classify(reported, stored, refresh=False).collect()}["changed"] == "unchanged"
    assert [r.id for r in S.pruned(stored, reported).collect()] == ["gone"]
    rep = {r.agent: r for r in S.report(S.classify(reported, stored), reported, stored.select("agent").union(spark.createDataFrame([("z",), ("b",), ("c",)], "agent string"))).collect()}
    assert rep["b"].discovered == 2 and rep["c"].discovered == 1 and rep["c"].new == 0 and rep["b"].new == 2 and rep["z"].discovered == 0 and rep["a"].net_messages == 2


def test_positions_are_those_of_a_sort(spark):
    rows = [(i, i * 7919 % 101) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, v int").repartition(7)
    got = {r.i: r.position for r in positions(df, [F.desc("v"), F.col("i")]).collect()}
    assert got == {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert positions(df.limit(0), [F.col("i")]).count() == 0


def test_positions_within_groups_are_those_of_a_window(spark):
    rows = [(None if i % 9 == 0 else "hot" if i % 3 else f"k{i % 5}", i * 7919 % 101, i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(5)
    got = {r.i: r.position for r in positions(df, ["v", "i"], within=["k"]).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        want |= {i: n + 1 for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1:]))}
    assert got == want


def test_first_report_is_the_one_reported_first_not_the_least_active(spark):
    df = spark.createDataFrame([("a", "late", 0, 1), ("a", "early", 1, 0), ("a", "mid", 0, 2)], "id string, last_activity_at string, source_place int, place int")
    assert S.first_report(df, ["id"]).first()["last_activity_at"] == "late"


def test_thread_usage_counts_registered_turns_only(spark):
    turns = spark.createDataFrame([("s", "t1", 1, 2, None), ("s", "t2", 4, None, None), ("s", "x", 100, 100, 100), ("u", "t1", 5, 5, 5)], "session_id string, turn_id string, input_tokens long, output_tokens long, cache_read_tokens long")
    ses = spark.createDataFrame([("s", '{"turns":{"t1":{},"t2":{},"t3":{}}}'), ("u", '{"turns":[]}'), ("b", "{")], "id string, session_json string")
    assert [tuple(r) for r in S.thread_usage(turns, ses).collect()] == [("s", 5, 2, None)]


def test_content_hash_changes_with_any_message_and_spans_blocks(spark):
    ses = spark.createDataFrame([("s", "{}"), ("e", None)], "id string, session_json string")
    rows = [("s", i, f"m{i}") for i in range(50)]
    h = lambda rows, block: {r.id: (r.content_hash, r.messages) for r in S.content_hashes(ses, spark.createDataFrame(rows, "session_id string, ordinal long, message_json string"), block).collect()}
    a = h(rows, 8)
    assert a["s"][1] == 50 and a["e"][1] == 0 and h(rows[::-1], 8) == a and h(rows[:-1] + [("s", 49, "other")], 8)["s"] != a["s"]
    one = {"b": 1, "a": {"y": 1, "x": [1, 2]}}
    assert content_hash(one) == content_hash({"a": {"x": [1, 2], "y": 1}, "b": 1}) != content_hash({"a": {"x": [2, 1], "y": 1}, "b": 1})


def test_small_functions(spark):
    assert parse_cutoff("2026-01-02") == "2026-01-02T00:00:00Z" and parse_cutoff("2h", 7_200_000) == "1970-01-01T00:00:00Z"
    with pytest.raises(ValueError):
        parse_cutoff("soon")
    assert T.query_phrases("a-b foo_bar É") == [["a"], ["b"], ["foo", "bar"], ["e"]]
    df = spark.createDataFrame([("very nice",), ("not nice",), ("NICE works",), (None,), ("",), ("not very bad, sorry",), ("never really bad",), ("so good",)], "t string")
    got = [r.c for r in df.select(compound(F.col("t")).alias("c")).collect()]
    f = lambda s: s / (s * s + 15) ** 0.5
    assert got == pytest.approx([f(1.8 + 0.293), f(1.8 * -0.74), f(1.8), 0.0, 0.0, f((-1.5 - 0.293) * -0.74), f((-1.5 - 0.293) * -0.74), 0.0])
    v = ByteEmbedder().embed(["abc", "abc", ""])
    assert v[0] == v[1] and v[2] == [0.0] * 4


def test_metrics_can_be_registered(spark):
    class Longest:
        name = "longest"

        def score(self, parts):
            return parts.groupBy("session_id").agg(F.max(F.length("text")).alias("chars"))

    S.register(Longest())
    try:
        p = spark.createDataFrame([("a", "text", "thanks, great"), ("a", "text", None), ("b", "thinking", "bad")], "session_id string, kind string, text string")
        got = {r.session_id: r for r in S.measured(p).collect()}
        assert got["a"].longest_chars == 13 and got["a"].meter_thanks == 1 and got["a"].sentiment_positive == 1 and got["b"].sentiment_positive is None
    finally:
        del S.METRICS["longest"]
