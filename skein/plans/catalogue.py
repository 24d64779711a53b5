"""Queries over the stored conversations, each with the SQL that checks it."""

from __future__ import annotations

import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import instants as D
from skein.functions import text as T
from skein.operators import search as R
from skein.operators import sessions as S
from skein.runtime import Workspace, positions, shared_dir, table
from skein.store import Store

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- views ----------------------------------------------------------------------------------------

_SESSION = ["agent", "project_id", "started_at", "last_activity_at", "parent_id"]


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """The fullest report of each session; session_json is an aggregate of its own, which is pruned where it is not asked for."""
    key = ["message_count", "content_hash", *_SESSION]
    full = F.max_by("session_json", F.struct(*key, "session_json"))
    return table(spark, d, "sessions").groupBy("id").agg(F.max(F.struct(*key)).alias("_s"), full.alias("session_json")).select("id", "_s.*", "session_json")


#: The sources in the order in which they report.
_ADAPTERS = ["claude_code", "codex", "cursor", "grok_bot", "antigravity"]


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Every report of a session in the order of the sources and, within one, of the rows as stored."""
    t = table(spark, d, "sessions")
    at = F.array_position(F.array(*map(F.lit, _ADAPTERS)), F.col("agent")).cast("int")
    return t.select("*", F.when(at > 0, at).otherwise(len(_ADAPTERS) + 1).alias("source_place"), F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")).alias("place"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").distinct()


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parts").distinct()


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents as parts: their session, or one of their own."""
    return table(spark, d, "documents").select(F.coalesce("session_id", F.concat(F.lit("doc-"), "doc_id")).alias("session_id"), F.col("doc_id").alias("message_ordinal"), F.lit(0).alias("part_ordinal"), "text", "lang")


_indexes: dict = {}


def index(spark: SparkSession, d: str, of) -> R.Index:
    """The index of parts or corpus: built at the first search over a table and kept while its files stay the same."""
    name = "parts" if of is parts else "documents"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    key = (spark.sparkContext.applicationId, d, name, status.getModificationTime(), status.getLen())
    if key not in _indexes:
        _indexes[key] = R.Index.written(of(spark, d).drop("kind", "lang"), Workspace(spark))
    return _indexes[key]


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).join(table(spark, d, "embeddings"), F.col("message_ordinal") == F.col("vec_id")).select(*R.KEYS, "embedding")


@cache
def query_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


_S = """s AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY message_count DESC, content_hash DESC, agent DESC, project_id DESC NULLS LAST,
  started_at DESC NULLS LAST, last_activity_at DESC NULLS LAST, parent_id DESC NULLS LAST, session_json DESC NULLS LAST) AS rn FROM sessions) WHERE rn = 1)"""
_R = f"""r0 AS (SELECT *, row_number() OVER () AS place FROM sessions),
r AS (SELECT *, coalesce(nullif(list_position({_ADAPTERS}, agent), 0), {len(_ADAPTERS) + 1}) AS source_place FROM r0)"""
_M = "m AS (SELECT DISTINCT * FROM messages)"
_P = "p AS (SELECT DISTINCT * FROM parts)"
_C = "p AS (SELECT coalesce(session_id, 'doc-' || doc_id) AS session_id, doc_id AS message_ordinal, 0 AS part_ordinal, text, lang FROM documents)"
_V = "v AS (SELECT p.session_id, p.message_ordinal, p.part_ordinal, embedding FROM p JOIN embeddings ON message_ordinal = vec_id), q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0)"
_WORDS = f"regexp_extract_all(translate(lower(text), '{T.MARKED}', '{T.BASE}'), '{T.WORD}')"


def _tf(phrase: list[str]) -> str:
    if len(phrase) == 1:
        return f"len(list_filter(w, lambda x: x = '{phrase[0]}'))"
    n = len(phrase)
    return f"len(list_filter(range(1, greatest(len(w) - {n - 2}, 1)), lambda i: list_slice(w, i, i + {n - 1}) = {phrase}))"


def _scored(q: str, session_filter: str = "true") -> str:
    """CTEs up to hits: keys, text, score, position."""
    ps = T.query_phrases(q)
    tfs = ", ".join(f"{_tf(p)} AS tf{i}" for i, p in enumerate(ps))
    dfs = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(ps)))
    idf = lambda i: f"CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END"
    rank = " + ".join(f"({idf(i)}) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(ps)))
    every = " AND ".join(f"tf{i} > 0" for i in range(len(ps)))
    return f"""w AS (SELECT session_id, message_ordinal, part_ordinal, text, {_WORDS} AS w FROM p WHERE text IS NOT NULL),
t AS (SELECT *, len(w) AS dl, {tfs} FROM w), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {dfs} FROM t),
h AS (SELECT t.*, -({rank}) AS rank FROM t, st WHERE {every} AND {session_filter}),
r AS (SELECT session_id, count(*) AS matches, min(rank) AS best, row_number() OVER (ORDER BY count(*) DESC, round(min(rank), 12), session_id) AS position FROM h GROUP BY 1)"""


_HITS = "SELECT session_id, message_ordinal, part_ordinal, text, round(1.0 / (60 + position), 6) AS score FROM h JOIN r USING (session_id)"
_ROUND = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})

# ---- full-text ------------------------------------------------------------------------------------


@query(f"WITH {_P}, {_scored('checksum mismatch')} {_HITS}")
def text_search_hits(spark, d):
    return _ROUND(R.text_search(index(spark, d, parts), "checksum mismatch"), "score")


@query(f"WITH {_P}, {_scored('stack overflow parser')} SELECT session_id, matches, round(best, 6) AS best, position FROM r")
def text_search_sessions(spark, d):
    return _ROUND(R.ranked_sessions(R.part_scores(index(spark, d, parts), "stack overflow parser")).withColumn("position", F.col("position").cast("long")), "best")


@query(f"WITH {_S}, {_P}, {_scored('cursor', 'session_id IN (SELECT id FROM s WHERE agent = $$codex$$)')} {_HITS}")
def text_search_filtered(spark, d):
    return _ROUND(R.text_search(index(spark, d, parts), "cursor", S.SessionFilter(agents=("codex",)).apply(sessions(spark, d))), "score")


@query(f"WITH {_C}, {_scored('línea')} {_HITS}")
def text_search_accents(spark, d):
    return _ROUND(R.text_search(index(spark, d, corpus), "LÍNEA"), "score")


@query(f"WITH {_C}, {_scored('ändern')} {_HITS}")
def text_search_umlaut(spark, d):
    return _ROUND(R.text_search(index(spark, d, corpus), "Ändern!"), "score")


@query(f"WITH {_P}, {_scored('zzqqxyv')} {_HITS}")
def text_search_no_match(spark, d):
    return _ROUND(R.text_search(index(spark, d, parts), "zzqqxyv"), "score")


@query("SELECT session_id, message_ordinal, part_ordinal, text, CAST(0 AS DOUBLE) AS score FROM parts WHERE false")
def text_search_punctuation(spark, d):
    return _ROUND(R.text_search(index(spark, d, parts), "!?, ..."), "score")


@query(f"WITH {_P}, {_scored('last_seen')} {_HITS}")
def text_search_phrase(spark, d):
    return _ROUND(R.text_search(index(spark, d, parts), "last_seen"), "score")


@query(f"WITH {_P}, {_scored('quadratic')} {_HITS} ORDER BY position, message_ordinal, part_ordinal LIMIT 25")
def text_search_limit(spark, d):
    return _ROUND(R.text_search(index(spark, d, parts), "quadratic", limit=25), "score")


@query(f"WITH {_C}, {_scored('renderer overflow')} SELECT session_id, message_ordinal, part_ordinal, round(rank, 6) AS rank FROM h")
def bm25_part_scores(spark, d):
    return _ROUND(R.part_scores(index(spark, d, corpus), "renderer overflow"), "rank")


@query(f"WITH {_P} SELECT count(*) AS n, round(avg(len({_WORDS})), 6) AS mean_length, CAST(sum(len({_WORDS})) AS BIGINT) AS total FROM p WHERE text IS NOT NULL")
def corpus_stats(spark, d):
    return _ROUND(R.corpus_stats(parts(spark, d)), "mean_length")


@query(f"""WITH {_P}, x AS (SELECT session_id, message_ordinal, part_ordinal, {_WORDS} AS w FROM p WHERE text IS NOT NULL),
y AS (SELECT session_id, message_ordinal, part_ordinal, w, unnest(range(1, len(w) + 1)) AS i FROM x)
SELECT w[i] AS term, session_id, message_ordinal, part_ordinal, count(*) AS tf, array_to_string(list_sort(list(i - 1)), ',') AS positions FROM y GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4"))
def postings_build(spark, d):
    return R.postings(parts(spark, d)).drop("length").withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


# ---- semantic and hybrid --------------------------------------------------------------------------

_SIM = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[]))"
_SEM = f"""n AS (SELECT session_id, message_ordinal, part_ordinal, {_SIM} AS similarity FROM v, q ORDER BY similarity DESC, session_id, message_ordinal, part_ordinal LIMIT 4096),
f AS (SELECT * FROM n WHERE similarity >= 0.3), o AS (SELECT session_id, least(1.0, max(similarity)) AS best, row_number() OVER (ORDER BY max(similarity) DESC, session_id) AS position FROM f GROUP BY 1)"""


@query(f"WITH {_C}, {_V} SELECT session_id, message_ordinal, part_ordinal, round({_SIM}, 6) AS similarity FROM v, q ORDER BY {_SIM} DESC, 1, 2, 3 LIMIT 20")
def semantic_topk_parts(spark, d):
    return _ROUND(R.nearest(vectors(spark, d), query_vector(spark, d), 20), "similarity")


@query(f"WITH {_C}, {_V}, {_SEM} SELECT session_id, round(best, 6) AS best, position FROM o")
def semantic_search_sessions(spark, d):
    return _ROUND(R.semantic_sessions(vectors(spark, d), query_vector(spark, d))[1].withColumn("position", F.col("position").cast("long")), "best")


@query(f"WITH {_C}, {_V}, {_SEM} SELECT session_id, message_ordinal, part_ordinal, text, round(best, 6) AS score FROM f JOIN o USING (session_id) JOIN p USING (session_id, message_ordinal, part_ordinal) WHERE position <= 10")
def semantic_search_hits(spark, d):
    return _ROUND(R.semantic_search(vectors(spark, d), index(spark, d, corpus), query_vector(spark, d)), "score")


@query(f"WITH {_C}, {_V}, {_SEM.replace('FROM n WHERE', 'FROM n WHERE starts_with(session_id, $$doc-$$) AND')} SELECT session_id, message_ordinal, part_ordinal, text, round(best, 6) AS score FROM f JOIN o USING (session_id) JOIN p USING (session_id, message_ordinal, part_ordinal) WHERE position <= 5")
def semantic_search_filtered(spark, d):
    alone = corpus(spark, d).where(F.col("session_id").startswith("doc-")).select(F.col("session_id").alias("id"))
    return _ROUND(R.semantic_search(vectors(spark, d), index(spark, d, corpus), query_vector(spark, d), 5, alone), "score")


@query(f"""WITH {_C}, {_V}, {_SEM}, {_scored('renderer')},
tx AS (SELECT h.*, 1.0 / (60 + position) AS ts FROM h JOIN r USING (session_id)),
sc AS (SELECT coalesce(a.session_id, o.session_id) AS session_id, coalesce(ts, 0) + coalesce(best, 0) AS score FROM (SELECT session_id, max(ts) AS ts FROM tx GROUP BY 1) a FULL JOIN o ON a.session_id = o.session_id),
al AS (SELECT session_id, message_ordinal, part_ordinal, text FROM tx UNION SELECT session_id, message_ordinal, part_ordinal, text FROM f JOIN p USING (session_id, message_ordinal, part_ordinal))
SELECT al.*, round(score, 6) AS score FROM al JOIN sc USING (session_id)""")
def hybrid_search(spark, d):
    return _ROUND(R.hybrid_search(index(spark, d, corpus), vectors(spark, d), "renderer", query_vector(spark, d)), "score")


# ---- listings and filters -------------------------------------------------------------------------

_LIST = "id, agent, project_id, started_at, last_activity_at, message_count"
_SEL = [c.strip() for c in _LIST.split(",")]


def _filtered(name: str, flt: S.SessionFilter, where: str) -> None:
    def run(spark, d):
        return flt.apply(sessions(spark, d), parts(spark, d)).select(*_SEL)

    run.__name__ = name
    query(f"WITH {_S}, {_P} SELECT {_LIST} FROM s WHERE {where}")(run)


_filtered("sessions_recent", S.SessionFilter(), "true")
_filtered("sessions_filter_agent", S.SessionFilter(agents=("cursor",)), "agent = 'cursor'")
_filtered("sessions_filter_multi_source", S.SessionFilter(agents=("cursor", "grok_bot")), "agent IN ('cursor', 'grok_bot')")
_filtered("sessions_filter_project", S.SessionFilter(project=""), "project_id = ''")
_filtered("sessions_filter_since", S.SessionFilter(since="2026-01-01T00:00:00Z"), "last_activity_at >= '2026-01-01T00:00:00Z'")
_filtered("sessions_filter_until", S.SessionFilter(until="2025-12-31T23:59:59Z"), "last_activity_at <= '2025-12-31T23:59:59Z'")
_filtered("sessions_filter_part_kind", S.SessionFilter(part_kind="thinking"), "id IN (SELECT session_id FROM p WHERE kind = 'thinking')")
_filtered("sessions_filter_combined", S.SessionFilter(agents=("claude_code",), part_kind="tool_call", since="2025-10"), "agent = 'claude_code' AND last_activity_at >= '2025-10' AND id IN (SELECT session_id FROM p WHERE kind = 'tool_call')")


@query(f"WITH {_S} SELECT {_LIST} FROM s WHERE last_activity_at < '2026' OR (last_activity_at = '2026' AND id > 'm') ORDER BY last_activity_at DESC, id LIMIT 40")
def sessions_keyset_page(spark, d):
    return S.page_after(sessions(spark, d), "2026", "m", 40).select(*_SEL)


@query("SELECT DISTINCT id FROM sessions WHERE starts_with(id, 't-0')")
def session_prefix_resolve(spark, d):
    return S.resolve(table(spark, d, "sessions"), "t-0")


@query(f"WITH {_M}, {_P} SELECT m.session_id, m.ordinal, role FROM m WHERE EXISTS (SELECT 1 FROM p WHERE p.session_id = m.session_id AND message_ordinal = ordinal AND kind = 'tool_result')")
def messages_filter_kind(spark, d):
    return S.messages_with(messages(spark, d), parts(spark, d), "tool_result").select("session_id", "ordinal", "role")


@query(f"WITH {_M} SELECT session_id, ordinal, role, timestamp, row_number() OVER (PARTITION BY session_id ORDER BY ordinal, role NULLS FIRST, timestamp NULLS FIRST) AS position FROM m")
def messages_in_order(spark, d):
    return positions(messages(spark, d).select("session_id", "ordinal", "role", "timestamp"), ["ordinal", "role", "timestamp"], within=["session_id"])


@query(f"WITH {_M} SELECT * FROM m WHERE ordinal = 3")
def message_by_ordinal(spark, d):
    return messages(spark, d).where("ordinal = 3")


@query(f"WITH {_P} SELECT session_id, message_ordinal, part_ordinal, kind, CASE WHEN kind IN ('text', 'thinking', 'tool_result', 'system') THEN text END AS indexed FROM p")
def parts_in_order(spark, d):
    return parts(spark, d).select(*R.KEYS, "kind", S.part_text(F.col("kind"), F.col("text")).alias("indexed")).orderBy(*R.KEYS)


# ---- statistics and usage -------------------------------------------------------------------------


def _stats(by: str, key: str) -> None:
    def run(spark, d):
        return S.buckets(sessions(spark, d), by)

    run.__name__ = f"stats_by_{by}"
    query(f"WITH {_S} SELECT {key} AS bucket, count(*) AS sessions FROM s GROUP BY 1")(run)


_stats("source", "agent")
_stats("project", "CASE WHEN coalesce(project_id, '') = '' THEN 'no project' ELSE project_id END")
_stats("day", "CASE WHEN coalesce(last_activity_at, '') = '' THEN 'no activity' ELSE substr(last_activity_at, 1, 10) END")


@query(f"WITH {_S} SELECT count(*) AS sessions, count(DISTINCT agent) AS agents, CAST(sum(message_count) AS BIGINT) AS messages FROM s")
def stats_total(spark, d):
    return sessions(spark, d).agg(F.count("*").alias("sessions"), F.countDistinct("agent").alias("agents"), F.sum("message_count").alias("messages"))


@query(f"""WITH {_M}, t AS (SELECT *, timestamp AS ts FROM m WHERE coalesce(timestamp, '') <> '')
SELECT m.session_id, coalesce(any_value(a.started_at), '') AS started_at, coalesce(any_value(a.last_activity_at), '') AS last_activity_at, count(*) AS message_count
FROM m LEFT JOIN (SELECT session_id, arg_min(ts, ordinal) AS started_at, arg_max(ts, ordinal) AS last_activity_at FROM t GROUP BY 1) a USING (session_id) GROUP BY 1""")
def session_bounds(spark, d):
    return S.bounds(messages(spark, d))


_U = f"""{_M}, j AS (SELECT session_id, turn_id, ordinal, CASE WHEN json_valid(message_json) THEN message_json END AS js FROM m),
u AS (SELECT session_id, turn_id, ordinal, {", ".join(f"CASE WHEN regexp_full_match(js->>'$.usage.{c}', '[0-9]{{1,18}}') THEN CAST(js->>'$.usage.{c}' AS BIGINT) END AS {c}" for c in S.COUNTERS)}, js->>'$.usage.model' AS model FROM j)"""
_SUMS = ", ".join(f"CAST(sum({c}) AS DOUBLE) AS {c}" for c in S.COUNTERS)


def _doubles(df: DataFrame) -> DataFrame:
    """Sums that may be null, as doubles, so that either side shows them alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in S.COUNTERS})


def _valid(df: DataFrame) -> DataFrame:
    return df.withColumn("message_json", F.when(F.expr("try_parse_json(message_json) is not null"), F.col("message_json")))


@query(f"WITH {_U} SELECT session_id, turn_id, {_SUMS}, arg_min(model, ordinal) FILTER (model IS NOT NULL) AS model FROM u WHERE turn_id IS NOT NULL GROUP BY 1, 2")
def turn_usage(spark, d):
    return _doubles(S.turn_usage(_valid(messages(spark, d))))


@query(f"""WITH {_S}, {_U}, k AS (SELECT id, unnest(json_keys(session_json, '$.turns')) AS turn_id FROM s WHERE json_valid(session_json) AND json_type(session_json) = 'OBJECT' AND json_type(session_json, '$.turns') = 'OBJECT')
SELECT session_id, {_SUMS} FROM u WHERE EXISTS (SELECT 1 FROM k WHERE k.id = u.session_id AND k.turn_id = u.turn_id) GROUP BY 1""")
def thread_usage(spark, d):
    return _doubles(S.thread_usage(S.turn_usage(_valid(messages(spark, d))), sessions(spark, d)))


@query(f"WITH {_U} SELECT model, count(*) AS messages, {_SUMS} FROM u WHERE model IS NOT NULL GROUP BY 1")
def usage_by_model(spark, d):
    m = _valid(messages(spark, d)).select(F.get_json_object("message_json", "$.usage.model").alias("model"), *S.counters(F.col("message_json")))
    return _doubles(m.where("model is not null").groupBy("model").agg(F.count("*").alias("messages"), *[F.sum(c).alias(c) for c in S.COUNTERS]))


@query(f"WITH {_P} SELECT kind, count(*) AS parts, count(text) AS with_text, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM p GROUP BY 1")
def parts_by_kind(spark, d):
    return parts(spark, d).groupBy("kind").agg(F.count("*").alias("parts"), F.count("text").alias("with_text"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


@query(f"WITH {_M} SELECT role, count(*) AS messages, count(DISTINCT session_id) AS sessions FROM m GROUP BY 1")
def messages_by_role(spark, d):
    return messages(spark, d).groupBy("role").agg(F.count("*").alias("messages"), F.countDistinct("session_id").alias("sessions"))


@query("SELECT o_custkey AS project, count(DISTINCT o_orderkey) AS sessions, count(*) AS messages, round(sum(l_quantity), 6) AS quantity, count(*) FILTER (l_returnflag = 'R') AS returned FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def project_rollup(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("r"))
    j = table(spark, d, "orders").join(per, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy(F.col("o_custkey").alias("project")).agg(F.countDistinct("o_orderkey").alias("sessions"), F.sum("n").alias("messages"), F.round(F.sum("q"), 6).alias("quantity"), F.sum("r").alias("returned"))


# ---- deduplication and change capture -------------------------------------------------------------


@query(f"WITH {_R} SELECT agent, id, project_id, arg_min(last_activity_at, place) AS last_activity_at, count(*) AS reports FROM r GROUP BY 1, 2, 3")
def union_dedup_triple(spark, d):
    r, key = reports(spark, d).select("agent", "id", "project_id", "last_activity_at", *S.REPORTED), ["agent", "id", "project_id"]
    again = r.groupBy(*key).agg(F.count("*").alias("reports"))
    same = [again[k].eqNullSafe(F.col(f"f.{k}")) for k in key]
    return S.first_report(r, key).alias("f").join(again, same).select(*[F.col(f"f.{k}") for k in key], F.col("f.last_activity_at"), "reports")


@query(f"WITH {_R} SELECT id, arg_min(agent, place + CAST(source_place AS BIGINT) * 1000000000) AS agent, arg_min(last_activity_at, place + CAST(source_place AS BIGINT) * 1000000000) AS last_activity_at FROM r GROUP BY 1")
def pass_dedup_id(spark, d):
    return S.first_report(reports(spark, d).select("id", "agent", "last_activity_at", *S.REPORTED), ["id"]).select("id", "agent", "last_activity_at")


def _sides(spark, d):
    """Two sides made of the sessions: what a store holds and what the sources report."""
    s = sessions(spark, d)
    bucket = F.conv(F.substring("content_hash", 1, 2), 16, 10).cast("int")
    stored = s.where(bucket < 220).withColumn("message_count", F.when(bucket % 5 == 0, F.col("message_count") + 1).otherwise(F.col("message_count"))).withColumn("content_hash", F.when(bucket % 10 == 0, "old").otherwise(F.col("content_hash")))
    reported = s.where(bucket >= 20).withColumn("openable", bucket % 16 != 3).withColumns({c: F.lit(0) for c in S.REPORTED})
    return stored.select("id", "agent", "last_activity_at", "message_count", "content_hash"), reported.select("id", "agent", "last_activity_at", "message_count", "content_hash", "openable", *S.REPORTED)


_BOTH = f"""{_S}, b AS (SELECT *, CAST('0x' || substr(content_hash, 1, 2) AS INTEGER) AS k FROM s),
st AS (SELECT id, agent, last_activity_at, CASE WHEN k % 5 = 0 THEN message_count + 1 ELSE message_count END AS message_count, CASE WHEN k % 10 = 0 THEN 'old' ELSE content_hash END AS content_hash FROM b WHERE k < 220),
re AS (SELECT id, agent, last_activity_at, message_count, content_hash, k % 16 <> 3 AS openable FROM b WHERE k >= 20)"""


def _classified(since: str | None = None) -> str:
    cut = f"WHEN re.last_activity_at <> '' AND re.last_activity_at < '{since}' THEN 'skipped'" if since else ""
    return f"""{_BOTH}, c AS (SELECT re.id, re.agent, CASE {cut} WHEN st.id IS NULL THEN CASE WHEN openable THEN 'new' ELSE 'error' END
 WHEN re.last_activity_at IS NOT DISTINCT FROM st.last_activity_at AND re.message_count = st.message_count THEN 'unchanged' WHEN NOT openable THEN 'error'
 WHEN re.content_hash = st.content_hash THEN 'unchanged' ELSE 'updated' END AS outcome, re.message_count AS messages, re.message_count - coalesce(st.message_count, 0) AS delta FROM re LEFT JOIN st USING (id))"""


@query(f"WITH {_classified()} SELECT * FROM c")
def cdc_classify(spark, d):
    stored, reported = _sides(spark, d)
    return S.classify(reported, stored)


@query(f"WITH {_classified('2026-01')} SELECT outcome, count(*) AS sessions FROM c GROUP BY 1")
def cdc_cutoff(spark, d):
    stored, reported = _sides(spark, d)
    return S.classify(reported, stored, since="2026-01").groupBy("outcome").agg(F.count("*").alias("sessions"))


@query(f"""WITH {_classified()} SELECT agent, count(*) AS discovered, {", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in S.OUTCOMES)},
CAST(coalesce(sum(messages) FILTER (outcome = 'new'), 0) AS BIGINT) AS added_messages, CAST(coalesce(sum(delta) FILTER (outcome = 'updated'), 0) AS BIGINT) AS net_messages FROM c GROUP BY 1""")
def cdc_report_by_agent(spark, d):
    stored, reported = _sides(spark, d)
    return S.report(S.classify(reported, stored), reported, table(spark, d, "sessions"))


@query(f"WITH {_BOTH} SELECT id FROM st WHERE id NOT IN (SELECT id FROM re)")
def cdc_prune(spark, d):
    stored, reported = _sides(spark, d)
    return S.pruned(stored, reported)


@query(f"WITH {_BOTH} SELECT id FROM re WHERE id NOT IN (SELECT id FROM st)")
def new_ids(spark, d):
    stored, reported = _sides(spark, d)
    return S.pruned(reported, stored)


@query(f"""WITH {_S}, {_M}, b AS (SELECT session_id AS id, ordinal // 1024 AS b, sha256(string_agg(sha256(coalesce(message_json, '')), '' ORDER BY ordinal, sha256(coalesce(message_json, '')))) AS h, count(*) AS n FROM m GROUP BY 1, 2),
x AS (SELECT id, b, h, n FROM b WHERE id IN (SELECT id FROM s) UNION ALL SELECT id, -1, sha256(coalesce(session_json, '')), 0 FROM s)
SELECT id, sha256(string_agg(h, '' ORDER BY b)) AS content_hash, CAST(sum(n) AS BIGINT) AS messages FROM x GROUP BY 1""")
def content_hash_sessions(spark, d):
    return S.content_hashes(sessions(spark, d), messages(spark, d))


@query(f"""WITH {_S}, {_M}, {_P}, pp AS (SELECT session_id, message_ordinal, string_agg(part_ordinal || ':' || coalesce(kind, ''), ',' ORDER BY part_ordinal) AS ps FROM p GROUP BY 1, 2)
SELECT s.id, agent, coalesce(ordinal, -1) AS ordinal, coalesce(role, '') AS role, coalesce(ps, '') AS shape FROM s LEFT JOIN m ON s.id = m.session_id LEFT JOIN pp ON m.session_id = pp.session_id AND ordinal = message_ordinal""")
def open_session_nested(spark, d):
    n = S.opened(sessions(spark, d).select("id", "agent"), messages(spark, d).select("session_id", "ordinal", "role"), parts(spark, d))
    shape = F.array_join(F.transform("parts", lambda p: F.concat(p["part_ordinal"].cast("string"), F.lit(":"), F.coalesce(p["kind"], F.lit("")))), ",")
    return n.select("id", "agent", F.coalesce("ordinal", F.lit(-1)).alias("ordinal"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce(shape, F.lit("")).alias("shape"))


# ---- joins of the sources -------------------------------------------------------------------------


@query(f"""WITH {_M}, x AS (SELECT session_id, ordinal, CASE WHEN json_valid(message_json) AND json_type(message_json) = 'OBJECT' AND json_type(message_json, '$.parts') = 'ARRAY' THEN json_extract(message_json, '$.parts[*]') END AS a FROM m),
e AS (SELECT session_id, ordinal, unnest(a) AS q FROM x), c AS (SELECT session_id, ordinal, q->>'$.id' AS id, q->>'$.name' AS name FROM e WHERE q->>'$.kind' = 'tool_call'),
r AS (SELECT session_id, ordinal, q->>'$.call_id' AS call_id FROM e WHERE q->>'$.kind' = 'tool_result')
SELECT c.session_id, c.id, c.name, c.ordinal, coalesce(r.ordinal, -1) AS result_ordinal FROM c LEFT JOIN r ON c.session_id = r.session_id AND c.id = r.call_id""")
def call_result_pairs(spark, d):
    m = messages(spark, d).withColumn("_v", F.expr("try_variant_get(try_parse_json(message_json), '$.parts', 'array<variant>')"))
    e = m.select("session_id", "ordinal", F.explode("_v").alias("q"))
    get = lambda f: F.expr(f"try_variant_get(q, '$.{f}', 'string')")
    calls = e.where(get("kind") == "tool_call").select("session_id", "ordinal", get("id").alias("id"), get("name").alias("name"))
    results = e.where(get("kind") == "tool_result").select("session_id", "ordinal", get("call_id").alias("call_id"), F.lit("").alias("path"))
    return S.tool_pairs(calls, results).select("session_id", "id", "name", "ordinal", F.coalesce("result_ordinal", F.lit(-1)).alias("result_ordinal"))


# ---- records and scalars --------------------------------------------------------------------------


@query(f"""WITH {_M} SELECT session_id, ordinal, CASE WHEN NOT json_valid(message_json) THEN 'none' ELSE coalesce(lower(json_type(message_json, '$.parts')), 'none') END AS shape FROM m WHERE message_json IS NOT NULL""")
def polymorphic_content(spark, d):
    v = F.expr("schema_of_variant(try_variant_get(try_parse_json('[' || message_json || ']'), '$[0].parts', 'variant'))")
    shape = F.when(v.startswith("ARRAY"), "array").when(v.startswith("OBJECT"), "object").when(v == "STRING", "varchar").when(v == "VOID", "null").otherwise("none")
    return messages(spark, d).where("message_json is not null").select("session_id", "ordinal", F.coalesce(shape, F.lit("none")).alias("shape"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, to_json({'p': props}) AS wrapped FROM events")
def json_decode_once(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.to_json(F.struct(F.col("props").alias("p"))).alias("wrapped"))


@query(f"""WITH t AS (SELECT id, coalesce(created_at_ms, created_at * 1000) AS ms FROM threads)
SELECT id, CASE WHEN coalesce(ms, 0) <= 0 OR ms > {D.LAST_MS} THEN '' ELSE strftime(make_timestamp(ms // 1000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS created FROM t""")
def epoch_to_rfc3339(spark, d):
    return table(spark, d, "threads").select("id", D.epoch_ms_text(F.coalesce("created_at_ms", F.col("created_at") * 1000)).alias("created"))


@query(f"""WITH {_M} SELECT session_id, ordinal, timestamp, coalesce(regexp_full_match(timestamp, '[0-9]{{4}}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\\.[0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])'), false) AS valid FROM m""")
def rfc3339_validate(spark, d):
    return messages(spark, d).select("session_id", "ordinal", "timestamp", D.valid_rfc3339(F.col("timestamp")).alias("valid"))


@query(f"WITH {_S} SELECT id, last_activity_at FROM s WHERE last_activity_at >= '2025-12-25T00:00:00Z'")
def relative_cutoff(spark, d):
    since = D.parse_cutoff("7d", now_ms=1_767_225_600_000)
    return sessions(spark, d).where(F.col("last_activity_at") >= since).select("id", "last_activity_at")


# ---- consumers ------------------------------------------------------------------------------------

_T = "lower(coalesce(text, ''))"
_METER = f"count(*) FILTER (contains({_T}, 'thanks') OR contains({_T}, 'thank you')) AS thanks, count(*) FILTER (contains({_T}, 'fuck') OR contains({_T}, 'f***') OR contains({_T}, 'f**k')) AS curses"


@query(f"WITH {_P}, x AS (SELECT session_id, {_METER} FROM p WHERE kind = 'text' GROUP BY 1) SELECT *, thanks > curses AS favors_thanks FROM x")
def meter_counts(spark, d):
    return S.meter(parts(spark, d))


@query(f"WITH {_P}, x AS (SELECT {_METER} FROM p WHERE kind = 'text') SELECT *, thanks > curses AS favors_thanks FROM x")
def meter_total(spark, d):
    return S.meter(parts(spark, d)).agg(F.coalesce(F.sum("thanks"), F.lit(0)).alias("thanks"), F.coalesce(F.sum("curses"), F.lit(0)).alias("curses")).withColumn("favors_thanks", F.col("thanks") > F.col("curses"))


def _stepped(v: str, word: str) -> str:
    from skein.functions import sentiment as N

    quoted = lambda ws: ", ".join("'" + w.replace("'", "''") + "'" for w in ws)
    return f"CASE WHEN {word} IN ({quoted(N.STRONGER)}) THEN {v} + sign({v}) * {N.BOOST} WHEN {word} IN ({quoted(N.TURNING)}) THEN {v} * {N.NEGATE} ELSE {v} END"


def _sentiment_sql() -> str:
    from skein.functions import sentiment as N

    values = ", ".join(f"('{w}', CAST({v} AS DOUBLE))" for w, v in N.VALENCE.items())
    return f"""WITH {_P}, lex(word, v) AS (VALUES {values}), t AS (SELECT row_number() OVER () AS k, session_id, text FROM p WHERE kind = 'text' AND text IS NOT NULL),
w AS (SELECT k, list_filter(string_split_regex(text, '[^A-Za-z0-9'']+'), lambda x: x <> '') AS ws FROM t), u AS (SELECT k, unnest(range(1, len(ws) + 1)) AS i, list_transform(ws, lambda x: lower(x)) AS ws FROM w),
a AS (SELECT k, i, v AS v0, coalesce(CASE WHEN i > 1 THEN ws[i - 1] END, '') AS b1, coalesce(CASE WHEN i > 2 THEN ws[i - 2] END, '') AS b2, coalesce(CASE WHEN i > 3 THEN ws[i - 3] END, '') AS b3 FROM u JOIN lex ON ws[i] = word),
a1 AS (SELECT *, {_stepped('v0', 'b1')} AS v1 FROM a), a2 AS (SELECT *, {_stepped('v1', 'b2')} AS v2 FROM a1), a3 AS (SELECT *, {_stepped('v2', 'b3')} AS v3 FROM a2),
z AS (SELECT k, sum(v3 ORDER BY i) AS s FROM a3 GROUP BY 1), c AS (SELECT session_id, coalesce(CASE WHEN abs(s) < 1e-12 THEN 0 ELSE s / sqrt(s * s + {N.ALPHA}) END, 0) AS c FROM t LEFT JOIN z USING (k))
SELECT session_id, count(*) FILTER (c >= {N.EDGE}) AS positive, count(*) FILTER (c <= -{N.EDGE}) AS negative, count(*) FILTER (abs(c) < {N.EDGE}) AS neutral FROM c GROUP BY 1"""


@query(_sentiment_sql())
def sentiment_counts(spark, d):
    return S.METRICS["sentiment"].score(parts(spark, d))


@query(f"""WITH {_P}, h AS (SELECT session_id, message_ordinal, part_ordinal, hex(encode(text)) AS x FROM p WHERE text IS NOT NULL),
b AS (SELECT * EXCLUDE (x), list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, i * 2 + 1, 2) AS INTEGER)) AS bs FROM h),
s AS (SELECT * EXCLUDE (bs), {", ".join(f"coalesce(list_sum(list_transform(list_filter(bs, lambda v: v % 4 = {k}), lambda v: v % 13 + 1)), 0) AS s{k}" for k in range(4))} FROM b),
n AS (SELECT *, sqrt(s0 * s0 + s1 * s1 + s2 * s2 + s3 * s3) AS n FROM s)
SELECT session_id, message_ordinal, part_ordinal, {", ".join(f"round(CAST(CAST(CASE WHEN n > 0 THEN s{k} / n ELSE 0 END AS FLOAT) AS DOUBLE), 5) AS e{k}" for k in range(4))} FROM n""")
def stub_embed(spark, d):
    from skein.functions.embed import byte_vector

    e = parts(spark, d).where("text is not null").select(*R.KEYS, F.explode(F.array(byte_vector(F.col("text")))).alias("e"))
    return e.select(*R.KEYS, *[F.round(F.col("e")[k].cast("double"), 5).alias(f"e{k}") for k in range(4)])


# ---- store and streams ----------------------------------------------------------------------------

_COUNTS = ["discovered", *S.OUTCOMES, "added_messages", "net_messages", "pruned"]


def _reports(spark, d):
    """Sessions as sources report them: whole, with those of their messages that are JSON objects."""
    sound = F.expr("try_variant_get(try_parse_json('[' || message_json || ']'), '$[0]', 'map<string,variant>') is not null")
    m = messages(spark, d).where(sound).groupBy(F.col("session_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("ordinal", "message_json"))).alias("l"))
    whole = F.concat(F.lit('{"messages":['), F.coalesce(F.array_join(F.col("l.message_json"), ","), F.lit("")), F.lit("]}"))
    s = sessions(spark, d).select("id", "agent", "project_id", "started_at", "last_activity_at", "message_count", "content_hash")
    return s.join(m, "id", "left").select(*s.columns, whole.alias("session_json"), F.lit(True).alias("openable"), *[F.lit(0).alias(c) for c in S.REPORTED])


_REPORT = "CAST(sum(message_count) AS BIGINT)"
# messages and parts as the store makes them of whole sessions
_STORED = f"""{_S}, {_M}, sm AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ordinal, message_json) - 1 AS ordinal, message_json AS js FROM m
  WHERE json_valid(message_json) AND json_type(message_json) = 'OBJECT' AND session_id IN (SELECT id FROM s)),
sq AS (SELECT session_id, ordinal AS message_ordinal, json_extract(js, '$.parts[*]') AS qs FROM sm WHERE json_type(js, '$.parts') = 'ARRAY'),
su AS (SELECT session_id, message_ordinal, unnest(range(0, len(qs))) AS part_ordinal, unnest(qs) AS q FROM sq),
p AS (SELECT session_id, message_ordinal, part_ordinal, coalesce(q->>'$.kind', 'extra') AS kind, CASE WHEN q->>'$.kind' IN ('text', 'thinking', 'tool_result', 'system') THEN q->>'$.text' END AS text FROM su)"""


_stores: dict = {}


def _store(spark, d) -> Store:
    """A store with one pass over all sessions, kept while the session lives."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _stores:
        store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
        _stores[key] = store, store.ingest(_reports(spark, d)).select("agent", *_COUNTS)
    return _stores[key][0]


@query(f"""WITH {_S} SELECT agent, count(*) AS discovered, count(*) AS new, 0 AS updated, 0 AS unchanged, 0 AS skipped, 0 AS error, {_REPORT} AS added_messages, 0 AS net_messages, 0 AS pruned FROM s GROUP BY 1""")
def store_first_pass(spark, d):
    return (_store(spark, d), _stores[spark.sparkContext.applicationId, d][1])[1]


@query(f"""WITH {_S} SELECT agent, count(*) AS discovered, 0 AS new, 0 AS updated, count(*) AS unchanged, 0 AS skipped, 0 AS error, 0 AS added_messages, 0 AS net_messages, 0 AS pruned FROM s GROUP BY 1""")
def store_refresh_idempotent(spark, d):
    return _store(spark, d).ingest(_reports(spark, d)).select("agent", *_COUNTS)


@query(f"WITH {_S} SELECT {_LIST} FROM s")
def store_read_back(spark, d):
    return _store(spark, d).read("sessions").select(*_SEL)


@query(f"WITH {_STORED} SELECT session_id, ordinal, js->>'$.role' AS role, js->>'$.timestamp' AS timestamp, js->>'$.turn_id' AS turn_id FROM sm")
def store_messages(spark, d):
    return _store(spark, d).read("messages").drop("message_json")


@query(f"WITH {_STORED} SELECT * FROM p")
def store_parts(spark, d):
    return _store(spark, d).read("parts")


@query(f"WITH {_STORED}, x AS (SELECT {_WORDS} AS w FROM p WHERE text IS NOT NULL) SELECT t AS term, count(*) AS occurrences FROM (SELECT unnest(w) AS t FROM x) GROUP BY 1")
def store_postings(spark, d):
    return _store(spark, d).read("postings").groupBy("term").agg(F.sum("tf").alias("occurrences"))


@query(f"WITH {_STORED}, {_scored('checksum mismatch')} {_HITS}")
def store_search_hits(spark, d):
    return _ROUND(R.text_search(_store(spark, d).index(), "checksum mismatch"), "score")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS events, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
def stream_day_buckets(spark, d):
    """A stream over the events to its end, bucketed by day; each batch replaces the result."""
    ws = Workspace(spark)
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    out = source.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("value"))
    names = []

    def keep(batch, n):
        names.append(f"batch{n}")
        ws.write(batch, names[-1])

    out.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{ws.root}/stream").trigger(availableNow=True).start().awaitTermination()
    return ws.read(names[-1], out.schema)
