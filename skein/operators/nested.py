"""Nested JSON records into flat tables with parent-child links.

Each text is parsed once into a VARIANT. A higher-order step takes the array of open containers of a
level, and nested transform calls give every child its path, key, index and the path of its nearest
listed ancestor; flatten joins the children of all containers into the next level. The step is folded
over the levels inside one expression, so any depth, any key and any mixture of types works without a
schema and without Python, and inline emits one row per listed object.

Texts of over LARGE bytes, which no VARIANT can be trusted to hold, are read token by token instead.
Parsing repeated keys needs spark.sql.variant.allowDuplicateKeys, which is set on the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.large import LARGE, Malformed, large, one_by_one, walk
from skein.runtime import ship

#: Keyed registries whose values are rows: dotted paths from the top.
REGISTRIES = ("turns", "compaction_windows", "cost.per_model")
#: Top-level keys under which a single object stands for a list of one.
SINGLES = ("peers", "compactions", "parts")

_NODE = "struct<path:string,parent:string,above:string,m:map<string,variant>,a:array<variant>>"
_ROW = "struct<path:string,parent_path:string,v:variant>"
_FIELD = "struct<path:string,parent_path:string,field:string,v:variant>"


def _quoted(names) -> str:
    return ", ".join("'" + n.replace("'", "\\'") + "'" for n in names)


def listed_objects(df: DataFrame, json_col: str, keys: list[str], registries=REGISTRIES, singles=SINGLES) -> DataFrame:
    """One row per object that is an array element at any depth or a registry value: keys, path, parent_path, v.

    v is the object as VARIANT; of an object of over LARGE characters it has the scalars alone. parent_path is the nearest enclosing listed object, '' at the top.
    Null, empty, malformed texts and texts of another kind than one object give no rows; of repeated
    keys in an object the last holds; nulls and scalars in arrays count for positions only. Repeated
    rows of df give repeated rows. Columns of df other than keys and json_col are dropped first, so
    their names can't clash.
    """
    made = "filter(k, c -> c.listed and c.m is not null), c -> struct(c.path as path, c.parent as parent_path, c.v as v)"
    more = _large(df, json_col, keys, registries, singles, 0, "path string, parent_path string, _json string")
    return _walk(df, json_col, keys, registries, singles, made, _ROW).unionByName(more.select(*keys, "path", "parent_path", F.expr("try_parse_json(_json)").alias("v")))


def listed_fields(df: DataFrame, json_col: str, keys: list[str], registries=REGISTRIES, singles=SINGLES) -> DataFrame:
    """One row per value that is no container, or an empty one that is no listed object: keys, path, parent_path, field, value, type.

    path and parent_path are those of the nearest enclosing listed object, '' and '' where that is the top;
    field is the rest of the value's path. value is the text, null for null; type is the JSON value's type.
    So every field of every kind of object comes out, foreseen or not. Texts are refused as in listed_objects().
    """
    rest = "substring(c.path, length(c.parent) + 1)"
    made = f"""filter(k, c -> coalesce(size(c.m), 0) = 0 and coalesce(size(c.a), 0) = 0 and not (c.listed and c.m is not null)),
        c -> struct(c.parent as path, c.above as parent_path, if(c.parent != '' and startswith({rest}, '.'), substring({rest}, 2), {rest}) as field, c.v as v)"""
    more = _large(df, json_col, keys, registries, singles, 1, "path string, parent_path string, field string, _json string")
    told = _valued(_walk(df, json_col, keys, registries, singles, made, _FIELD), keys)
    more = _valued(more.withColumn("v", F.expr("try_parse_json(_json)")), keys, F.when(F.col("v").isNull(), F.expr("substring(_json, 2, length(_json) - 2)")))
    return told.unionByName(more)


def _valued(rows: DataFrame, keys: list[str], too_large=None) -> DataFrame:
    value = F.expr("try_cast(v as string)")
    kind = F.coalesce(F.expr("schema_of_variant(v)"), F.lit("VOID"))
    if too_large is not None:  # a string that no VARIANT holds, as it is written
        value, kind = F.coalesce(value, too_large), F.when(too_large.isNotNull(), "STRING").otherwise(kind)
    return rows.select(*keys, "path", "parent_path", "field", value.alias("value"), kind.alias("type"))


def _large(df: DataFrame, json_col: str, keys: list[str], registries, singles, which: int, schema: str) -> DataFrame:
    """Rows of the texts that are too large for a VARIANT."""
    ship(df.sparkSession)
    registries, singles = tuple(registries), tuple(singles)

    def rows(text: str):
        try:
            return walk(text, registries, singles)[which]
        except Malformed:
            return []

    return one_by_one(df.where(large(json_col)).select(*keys, F.col(json_col).alias("_text")), "_text", rows, schema)


def _walk(df: DataFrame, json_col: str, keys: list[str], registries, singles, made: str, row: str) -> DataFrame:
    """The fold over the levels; made says which children of a level give rows, and which."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    base = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(json_col).alias("_text")).where((F.octet_length("_text") <= LARGE) & (F.col("_text").contains("[") | F.col("_text").contains("{")))
    # The parser stops after one value; wrapped in both kinds of brackets, whatever follows the value is an error.
    base = base.withColumn("_one", F.expr("try_cast(try_parse_json('[' || _text || ']') as array<variant>)")).where("size(_one) = 1")
    base = base.where("try_parse_json('{\"x\":' || _text || '}') is not null").withColumn("_m", F.expr("try_cast(_one[0] as map<string,variant>)")).where("_m is not null")
    # A level needs at least one opening bracket of its own; levels after the last cost nothing.
    levels = "length(_text) - length(translate(_text, '[{', ''))"
    inner = "struct({path} as path, {parent} as parent, {above} as above, try_cast({v} as map<string,variant>) as m, try_cast({v} as array<variant>) as a, {listed} as listed, {v} as v)"
    one = inner.format(path="concat({p}, '[0]')", parent="n.parent", above="n.above", v="e.value", listed="true")
    p = "if(n.path = '', e.key, concat(n.path, '.', e.key))"
    of_map = f"""transform(map_entries(n.m), e -> {inner.format(
        path=f"case when n.path in ({_quoted(registries)}) then concat(n.path, '{{', e.key, '}}') when n.path = '' and e.key in ({_quoted(singles)}) and try_cast(e.value as map<string,variant>) is not null then concat(e.key, '[0]') else {p} end",
        parent="n.parent", above="n.above", v="e.value",
        listed=f"n.path in ({_quoted(registries)}) or (n.path = '' and e.key in ({_quoted(singles)}))")})"""
    of_array = f"transform(n.a, (x, i) -> {inner.format(path="concat(n.path, '[', i, ']')", parent="n.parent", above="n.above", v='x', listed='true')})"
    kids = f"flatten(transform(acc.open, n -> if(n.m is not null, {of_map}, {of_array})))"
    step = f"""transform(array({kids}), k -> struct(
        transform(filter(k, c -> c.m is not null or c.a is not null), c -> if(c.listed and c.m is not null, struct(c.path as path, c.path as parent, c.parent as above, c.m as m, c.a as a), struct(c.path as path, c.parent as parent, c.above as above, c.m as m, c.a as a))) as open,
        concat(acc.out, transform({made})) as out))[0]"""
    fold = f"""aggregate(sequence(1, {levels}),
        cast(struct(array(struct('' as path, '' as parent, '' as above, _m as m, cast(null as array<variant>) as a)) as open, array() as out) as struct<open:array<{_NODE}>,out:array<{row}>>),
        (acc, i) -> if(size(acc.open) = 0, acc, cast({step} as struct<open:array<{_NODE}>,out:array<{row}>>)),
        acc -> acc.out)"""
    rows = base.select(*[f"_k{i}" for i in range(len(keys))], F.expr(f"inline({fold})"))
    return rows.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *[c for c in rows.columns if not c.startswith("_k")])


#: Target tables: pattern of the path, and the fields with their types.
TABLES = {
    "turns": (r"^turns(\{.*\}|\[\d+\])$", {"id": "string", "status": "string", "duration_ms": "bigint", "error": "string"}),
    "windows": (r"^compaction_windows(\{.*\}|\[\d+\])$", {"previous_window": "string", "retained_context": "string"}),
    "model_costs": (r"^cost\.per_model(\{.*\}|\[\d+\])$", {"cost_usd": "double"}),
    "peers": (r"^peers\[\d+\]$", {"peer_id": "string", "status": "string"}),
    "compactions": (r"^compactions\[\d+\]$", {"pre_tokens": "bigint", "post_tokens": "bigint"}),
    "parts": (r"^parts\[\d+\]$", {"kind": "string", "text": "string", "id": "string", "call_id": "string", "name": "string", "status": "string"}),
    "edits": (r"\.edits\[\d+\]$", {"old": "string", "new": "string"}),
    "hunks": (r"\.hunks\[\d+\]$", {"start": "bigint", "len": "bigint"}),
    "kept": (r"^compactions\[\d+\]\.kept\[\d+\]$", {"ordinal": "bigint"}),
    "hooks": (r"^extra\.hooks\[\d+\]$", {"name": "string"}),
    "runs": (r"\.runs\[\d+\]$", {"ms": "bigint", "ok": "boolean"}),
    "steps": (r"\.steps\[\d+\]$", {"id": "string", "title": "string", "done": "boolean"}),
    "substeps": (r"\.substeps\[\d+\]$", {"id": "string", "title": "string", "done": "boolean"}),
    "filters": (r"\.filters\[\d+\]$", {"field": "string", "any_of": "string"}),
    "limits": (r"\.limits\[\d+\]$", {"max": "bigint", "unit": "string"}),
    "grid": (r"\.grid(\[\d+\])+$", {"x": "bigint", "y": "bigint"}),
    "annotations": (r"\.annotations\[\d+\]$", {"line": "bigint"}),
    "marks": (r"\.marks\[\d+\]$", {"at": "bigint"}),
    "segments": (r"\.segments\[\d+\]$", {"ms": "bigint", "speaker": "string"}),
}


def flat_table(objects: DataFrame, keys: list[str], target: tuple[str, dict]) -> DataFrame:
    """One target table of listed_objects(): keys, path, parent_path, position or key in the parent, its fields.

    A field of another type than the target's that cannot be cast is null, as is an absent one.
    """
    pattern, fields = target
    last = F.regexp_extract("path", r"(?:\[(\d+)\]|\{(.*)\})$", 1)
    key = F.regexp_extract("path", r"\{(.*)\}$", 1)
    return objects.where(F.col("path").rlike(pattern)).select(
        *keys, "path", "parent_path", F.nullif(last, F.lit("")).cast("long").alias("position"), F.nullif(key, F.lit("")).alias("key"),
        *[F.expr(f"try_variant_get(v, '$.{f}', '{t}')").alias(f"f_{f}") for f, t in fields.items()],
    )
