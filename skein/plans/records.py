"""Queries of the record problems: p2 nested records, p3 hierarchies, p4 drifting schemas, p5 timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import drift as D
from skein.operators import hierarchy as H
from skein.operators import instants as I
from skein.operators import nested as N
from skein.runtime import blank, table


def _objects(spark: SparkSession, d: str, of=N.listed_objects) -> DataFrame:
    m = of(table(spark, d, "messages"), "message_json", ["session_id", "ordinal"])
    s = of(table(spark, d, "sessions").select(F.col("id").alias("session_id"), F.lit(-1).cast("long").alias("ordinal"), "session_json"), "session_json", ["session_id", "ordinal"])
    return s.unionByName(m)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _objects(spark, d).select("session_id", "ordinal", "path", "parent_path").distinct()


def _part_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A flat table; numbers that may be null are doubles and yes or no is text, so that either side of a check shows them alike."""
    t = N.flat_table(_objects(spark, d), ["session_id", "ordinal"], N.TABLES[name]).distinct()
    shown = {f"f_{f}": F.col(f"f_{f}").cast("double" if k == "bigint" else "string") for f, k in N.TABLES[name][1].items() if k in ("bigint", "boolean")}
    return t.withColumns({"position": F.coalesce("position", F.lit(-1)), "key": F.coalesce("key", F.lit("")), **shown})


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    return _part_of(spark, d, "turns")


def p2_model_costs(spark: SparkSession, d: str) -> DataFrame:
    return _part_of(spark, d, "model_costs")


def p2_compactions(spark: SparkSession, d: str) -> DataFrame:
    return _part_of(spark, d, "compactions")


def p2_parts(spark: SparkSession, d: str) -> DataFrame:
    return _part_of(spark, d, "parts")


def p2_edits(spark: SparkSession, d: str) -> DataFrame:
    return _part_of(spark, d, "edits")


def p2_hunks(spark: SparkSession, d: str) -> DataFrame:
    return _part_of(spark, d, "hunks")


def p2_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every field of every object, of kinds without a table too."""
    return _objects(spark, d, N.listed_fields).distinct()


def _query_of(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _part_of(spark, d, name)

    query.__name__ = f"p2_{name}"
    return query


_KINDS = [_query_of(n) for n in N.TABLES if f"p2_{n}" not in globals()]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    changes = D.compare_files(D.profile_files(D.distinct_lines(table(spark, d, "raw_records"))))
    return changes.where("change not in ('same', 'first')").select("stream", "source_file", "change", "old_path", "new_path")


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    return D.unified_table(table(spark, d, "raw_records"))


def _stated(spark: SparkSession, d: str) -> DataFrame:
    """Every value that may need normalising: table, keys, field, text, source, zone of the project."""
    zones = table(spark, d, "project_zones").groupBy("project_id").agg(F.min("zone_name").alias("zone"))
    sessions = table(spark, d, "sessions")
    homes = sessions.groupBy("id").agg(F.min("project_id").alias("project_id"), F.min("agent").alias("agent")).join(zones, "project_id", "left").select("id", "agent", "zone")
    field = lambda f: sessions.select(F.lit("sessions").alias("table_name"), F.col("id").alias("session_id"), F.lit(-1).cast("long").alias("ordinal"), F.lit(f).alias("field"), F.col(f).alias("value"))
    said = table(spark, d, "messages").select(F.lit("messages").alias("table_name"), "session_id", "ordinal", F.lit("timestamp").alias("field"), F.col("timestamp").alias("value"))
    every = field("started_at").unionByName(field("last_activity_at")).unionByName(said).where(~blank(F.col("value")) & ~F.col("value").rlike(I.CANONICAL)).distinct()
    return every.join(homes.withColumnRenamed("id", "session_id"), "session_id", "left").withColumn("source", F.concat_ws("/", "table_name", "agent"))


def p5_normalised(spark: SparkSession, d: str) -> DataFrame:
    """All values with format, instant, posterior and mark of ambiguity."""
    t = table(spark, d, "threads")
    ms, s = F.col("created_at_ms"), F.col("created_at")
    counts = t.select(
        F.lit("threads").alias("table_name"), F.col("id").alias("session_id"), F.lit(-1).cast("long").alias("ordinal"),
        F.when(ms > 0, "created_at_ms").otherwise("created_at").alias("from_field"), F.when(ms > 0, ms).when(s > 0, s).cast("string").alias("value"),
        F.lit("threads").alias("source"), F.lit(None).cast("string").alias("zone"),
    ).where("value is not null").distinct()
    every = _stated(spark, d).select("table_name", "session_id", "ordinal", F.col("field").alias("from_field"), "value", "source", "zone").unionByName(counts)
    return I.normalise(every, "value", "source", "zone").withColumn("field", F.when(F.col("table_name") == "threads", "created_at_ms").otherwise(F.col("from_field")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    got = p5_normalised(spark, d).where("table_name != 'threads' or from_field = 'created_at' or format != 'epoch_ms'")
    return got.select("table_name", "session_id", "ordinal", "field", "utc_ms").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    tree = H.hierarchy(table(spark, d, "sessions"))
    return tree.where(~blank(F.col("parent_id"))).select("id", "root_id", "depth", "path", "in_cycle")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(H.hierarchy(table(spark, d, "sessions")))


def p3_subtree_sizes(spark: SparkSession, d: str) -> DataFrame:
    return H.subtree_sizes(H.hierarchy(table(spark, d, "sessions")))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_turns, p2_model_costs, p2_compactions, p2_parts, p2_edits, p2_hunks, p2_fields, *_KINDS, p3_found, p3_descendants, p3_subtree_sizes, p4_found, p4_unified, p5_found, p5_normalised)
}

_TREE = """
WITH RECURSIVE nodes AS (
  SELECT lower(trim(id)) AS k, min(id) AS id, min(nullif(lower(trim(parent_id, ' \t\n')), '')) AS p FROM sessions GROUP BY 1),
links AS (SELECT c.k, c.id, CASE WHEN n.k IS NULL THEN NULL ELSE c.p END AS p, c.p IS NOT NULL AS has FROM nodes c LEFT JOIN nodes n ON c.p = n.k),
walk AS (
  SELECT k, id, id AS root_id, CAST(0 AS BIGINT) AS depth, id AS path, [id] AS trail FROM links WHERE p IS NULL
  UNION ALL
  SELECT l.k, l.id, w.root_id, w.depth + 1, w.path || '/' || l.id, list_append(w.trail, l.id) FROM links l JOIN walk w ON l.p = w.k)
"""

# Objects of all texts by recursion over the values of JSON.
_NESTED = """
WITH RECURSIVE src AS (SELECT id AS session_id, CAST(-1 AS BIGINT) AS ordinal, session_json AS js FROM sessions UNION SELECT session_id, ordinal, message_json FROM messages),
ok AS (SELECT row_number() OVER () AS k, session_id, ordinal, CAST(js AS JSON) AS js FROM src WHERE json_valid(js) AND json_type(js) = 'OBJECT'),
n AS (
  SELECT k, '' AS path, '' AS anchor, '' AS above, js, 'OBJECT' AS kind, false AS listed FROM ok
  UNION ALL
  SELECT k, path, CASE WHEN listed AND kind = 'OBJECT' THEN path ELSE above END, above, js, kind, listed AND kind = 'OBJECT' FROM (
    SELECT n.k, n.anchor AS above, e.value AS js, e.type AS kind,
      CASE WHEN n.kind = 'ARRAY' THEN n.path || '[' || e.key || ']' WHEN n.path IN ('turns', 'compaction_windows', 'cost.per_model') THEN n.path || '{' || e.key || '}'
           WHEN n.path = '' AND e.key IN ('peers', 'compactions', 'parts') AND e.type = 'OBJECT' THEN e.key || '[0]' WHEN n.path = '' THEN e.key ELSE n.path || '.' || e.key END AS path,
      n.kind = 'ARRAY' OR n.path IN ('turns', 'compaction_windows', 'cost.per_model') OR (n.path = '' AND e.key IN ('peers', 'compactions', 'parts')) AS listed
    FROM n, LATERAL json_each(n.js) e WHERE e.type IN ('OBJECT', 'ARRAY'))),
o AS (SELECT session_id, ordinal, path, above AS parent_path, n.js FROM n JOIN ok USING (k) WHERE listed)
"""


# Times by a pattern of each format, written for this check; zones by the database's own rules.
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"\s*([Zz]|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z]{2,5})?(?:\[([A-Za-z0-9_+/-]+)\])?"
_WRITTEN = [
    (r"^(\d{4})[-/](\d{2})[-/](\d{2})[Tt ]\s*" + _TIME + _ZONE + "$", "y mo d h mi s f z r"), (r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?" + _ZONE + "$", "y mo d h mi s f z r"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4}),?\s+" + _TIME + _ZONE + "$", "d mo y h mi s f z r"), (r"^(\d{1,2})/(\d{1,2})/(\d{4}),?\s+" + _TIME + r"(?:\s*([AaPp])\.?[Mm]\.?)?" + _ZONE + "$", "mo d y h mi s f half z r"),
    (r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})\s+" + _TIME + _ZONE + "$", "d mo y h mi s f z r"), (r"^[A-Za-z]{3}\s+([A-Za-z]{3})\s+(\d{1,2})\s+" + _TIME + r"(?:\s+([A-Za-z]{3,5}))?\s+(\d{4})$", "mo d h mi s f z y"),
]


def _instants_sql() -> str:
    def cut(pattern: str, names: str) -> str:
        ns, quoted = names.split(), "'" + pattern.replace("'", "''") + "'"
        fields = ", ".join(f"{'x.' + n if n in ns else chr(39) * 2} AS {n}" for n in "y mo d h mi s f half z r".split())
        return f"SELECT tab, sid, ordinal, field, zone, {fields} FROM (SELECT *, regexp_extract(v, {quoted}, {ns}) AS x FROM vals WHERE regexp_matches(v, {quoted}))"

    offsets = "MAP {" + ", ".join(f"'{k}': {v[0]}" for k, v in I.ABBREVIATIONS.items()) + "}"
    zone = "coalesce(nullif(r, ''), zone, 'UTC')"
    digits = "regexp_replace(zz, '[^0-9]', '', 'g')"
    return rf"""
WITH homes AS (SELECT id, min(project_id) AS p FROM sessions GROUP BY 1), pz AS (SELECT project_id, min(zone_name) AS zone FROM project_zones GROUP BY 1),
raw AS (SELECT 'sessions' AS tab, id AS sid, CAST(-1 AS BIGINT) AS ordinal, 'started_at' AS field, started_at AS t FROM sessions UNION SELECT 'sessions', id, -1, 'last_activity_at', last_activity_at FROM sessions
  UNION SELECT 'messages', session_id, ordinal, 'timestamp', timestamp FROM messages),
vals AS (SELECT raw.*, regexp_replace(t, '^\s+|\s+$', '', 'g') AS v, zone FROM raw LEFT JOIN homes ON sid = homes.id LEFT JOIN pz ON homes.p = pz.project_id
  WHERE t IS NOT NULL AND NOT regexp_full_match(t, '\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?Z')),
cut AS ({" UNION ALL ".join(cut(*w) for w in _WRITTEN)}),
num AS (SELECT *, TRY_CAST(y AS INT) AS yy, CASE WHEN regexp_matches(mo, '^[A-Za-z]') THEN list_position({I.MONTHS}, lower(mo)) ELSE TRY_CAST(mo AS INT) END AS mm, TRY_CAST(d AS INT) AS dd, TRY_CAST(h AS INT) AS h0,
  TRY_CAST(mi AS INT) AS ii, coalesce(TRY_CAST(nullif(s, '') AS INT), 0) AS ss, CAST(rpad(substr(f, 1, 3), 3, '0') AS INT) AS ms, upper(z) AS zz FROM cut),
tim AS (SELECT *, CASE WHEN half = '' THEN h0 WHEN h0 BETWEEN 1 AND 12 THEN h0 % 12 + CASE WHEN lower(half) = 'p' THEN 12 ELSE 0 END END AS hh FROM num),
loc AS (SELECT *, TRY_CAST(printf('%04d-%02d-%02d %02d:%02d:%02d', yy, mm, dd, hh, ii, ss) AS TIMESTAMP) AS lt FROM tim WHERE hh BETWEEN 0 AND 23 AND ii < 60 AND ss < 60 AND mm BETWEEN 1 AND 12),
off AS (SELECT *, CASE WHEN regexp_matches(zz, '^[+-]') THEN (CASE WHEN zz[1] = '-' THEN -1 ELSE 1 END) * (CAST(substr({digits}, 1, 2) AS INT) * 60 + coalesce(TRY_CAST(nullif(substr({digits}, 3, 2), '') AS INT), 0))
  WHEN zz <> '' THEN ({offsets})[zz] END AS o FROM loc WHERE lt IS NOT NULL),
dated AS (SELECT tab, sid, ordinal, field, CASE WHEN o IS NOT NULL THEN epoch_ms(lt) - o * 60000
  WHEN zz = '' THEN least(epoch_ms(timezone({zone}, lt)), epoch_ms(timezone({zone}, lt - INTERVAL 1 HOUR)) + 3600000) END + ms AS utc_ms FROM off),
digits AS (SELECT tab, sid, ordinal, field, regexp_extract(v, '^(\d{{1,19}})(?:\.(\d+))?$', 1) AS n, regexp_extract(v, '^(\d{{1,19}})(?:\.(\d+))?$', 2) AS f FROM vals WHERE regexp_matches(v, '^\d{{1,19}}(\.\d+)?$')),
tn AS (SELECT DISTINCT id, CASE WHEN created_at_ms > 0 THEN created_at_ms WHEN created_at > 0 THEN created_at END AS n, created_at_ms > 0 AS own FROM threads),
every AS (SELECT 'threads' AS tab, id AS sid, CAST(-1 AS BIGINT) AS ordinal, 'created_at_ms' AS field, CAST(n AS VARCHAR) AS n, '' AS f, own FROM tn WHERE n IS NOT NULL
  UNION ALL SELECT tab, sid, ordinal, field, n, f, NULL FROM digits WHERE NOT regexp_matches(n, '^0*$')),
counted AS (SELECT *, CASE WHEN length(n) <= 11 THEN CAST(n AS BIGINT) * 1000 + CAST(rpad(substr(f, 1, 3), 3, '0') AS INT) WHEN length(n) <= 14 THEN CAST(n AS BIGINT)
  WHEN length(n) <= 17 THEN CAST(n AS BIGINT) // 1000 ELSE CAST(n AS BIGINT) // 1000000 END AS utc_ms FROM every)
SELECT DISTINCT tab AS table_name, sid AS session_id, ordinal, field, utc_ms FROM (SELECT tab, sid, ordinal, field, utc_ms FROM dated WHERE utc_ms IS NOT NULL
  UNION ALL SELECT tab, sid, ordinal, field, utc_ms FROM counted WHERE own IS NULL OR NOT own OR length(n) NOT BETWEEN 12 AND 14)"""


def _table_sql(name: str) -> str:
    pattern, fields = N.TABLES[name]
    types = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    shown = {"bigint": "DOUBLE", "boolean": "VARCHAR"}
    cols = ", ".join(f"CAST(TRY_CAST(js->>'$.{f}' AS {types[t]}) AS {shown.get(t, types[t])}) AS f_{f}" for f, t in fields.items())
    position = r"regexp_extract(path, '\[(\d+)\]$', 1)"
    key = r"regexp_extract(path, '\{(.*)\}$', 1)"
    return f"{_NESTED} SELECT DISTINCT session_id, ordinal, path, parent_path, coalesce(TRY_CAST(nullif({position}, '') AS BIGINT), -1) AS position, {key} AS key, {cols} FROM o WHERE regexp_matches(path, '{pattern}')"


ORACLE = {
    "p5_found": _instants_sql(),
    "p2_found": _NESTED + "SELECT DISTINCT session_id, ordinal, path, parent_path FROM o",
    **{f"p2_{n}": _table_sql(n) for n in N.TABLES},
    "p3_found": _TREE.rstrip() + """,
looped AS (SELECT k AS start, p AS cur, 1 AS n FROM links WHERE k NOT IN (SELECT k FROM walk)
  UNION SELECT s.start, l.p, s.n + 1 FROM looped s JOIN links l ON s.cur = l.k WHERE s.cur <> s.start AND s.n <= (SELECT count(*) FROM links)),
cyc AS (SELECT DISTINCT start FROM looped WHERE cur = start)
SELECT l.id, coalesce(w.root_id, '') AS root_id, coalesce(w.depth, -1) AS depth, coalesce(w.path, '') AS path,
  CAST(CASE WHEN l.k IN (SELECT start FROM cyc) THEN 1 ELSE 0 END AS BIGINT) AS in_cycle
FROM links l LEFT JOIN walk w ON l.k = w.k WHERE l.has""",
    "p3_descendants": _TREE + """
SELECT trail[i] AS ancestor_id, id AS descendant_id, CAST(depth + 1 - i AS INTEGER) AS distance
FROM (SELECT *, unnest(range(1, depth + 1)) AS i FROM walk)""",
    "p3_subtree_sizes": _TREE + """
SELECT trail[i] AS id, count(*) AS descendants, CAST(max(depth + 1 - i) AS INTEGER) AS height
FROM (SELECT *, unnest(range(1, depth + 1)) AS i FROM walk) GROUP BY 1""",
}
