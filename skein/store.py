"""A versioned store of sessions, messages and parts in Parquet.

Tables lie in buckets by a hash of the session. A pass writes the buckets it changes as version n+1 and then
replaces CURRENT, which names the version of each bucket, in one rename: readers keep the version they began
with, a pass that fails leaves nothing behind that is read, a dry run writes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import sessions as S
from skein.operators.large import large, one_by_one
from skein.operators.search import Index, lengths, postings
from skein.runtime import Workspace, ship
from skein.sources.datasource import open_found

#: Version 1 had no postings and lengths, version 2 whole tables in place of buckets.
SCHEMA_VERSION = 3
BUCKETS = 64
TABLES = {
    "sessions": "id string, agent string, project_id string, started_at string, last_activity_at string, message_count bigint, content_hash string, session_json string, stamp string",
    "messages": "session_id string, ordinal bigint, role string, timestamp string, turn_id string, message_json string",
    "parts": "session_id string, message_ordinal bigint, part_ordinal bigint, kind string, text string",
    "vectors": "session_id string, message_ordinal bigint, part_ordinal bigint, embedding array<float>",
    "postings": "term string, session_id string, message_ordinal bigint, part_ordinal bigint, tf bigint, length int, positions array<int>",
    "lengths": "session_id string, message_ordinal bigint, part_ordinal bigint, length int",
}


class StoreError(Exception):
    """The store cannot be used: unknown schema version or another embedding model."""


def explode_messages(sessions: DataFrame) -> DataFrame:
    """Messages of session_json, in order from 0; other shapes than a list have none."""
    s = sessions.select(F.col("id").alias("session_id"), F.col("session_json").alias("_text"))
    m = s.where(~large("_text")).select("session_id", F.posexplode(F.expr("try_variant_get(try_parse_json(_text), '$.messages', 'array<variant>')")).alias("pos", "v"))
    get = lambda f: F.expr(f"try_variant_get(v, '$.{f}', 'string')").alias(f)
    small = m.select("session_id", F.col("pos").cast("long").alias("ordinal"), get("role"), get("timestamp"), get("turn_id"), F.to_json("v").alias("message_json"))
    ship(sessions.sparkSession)

    def rows(text: str):
        from skein.store import elements, said

        return [(i, said(v, "role"), said(v, "timestamp"), said(v, "turn_id"), json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True)) for i, v in enumerate(elements(text, "messages"))]

    return small.unionByName(one_by_one(s.where(large("_text")), "_text", rows, TABLES["messages"].split(", ", 1)[1]))


def elements(text: str, key: str) -> list:
    """The list under a key of a JSON object; anything else has none."""
    try:
        v = json.loads(text)
    except (ValueError, RecursionError):
        return []
    v = v.get(key) if isinstance(v, dict) else None
    return v if isinstance(v, list) else []


def said(v, key: str) -> str | None:
    """A scalar under a key as text."""
    x = v.get(key) if isinstance(v, dict) else None
    return x if isinstance(x, str) or x is None else json.dumps(x)


def explode_parts(messages: DataFrame) -> DataFrame:
    """Parts of message_json, in order from 0, with the text that search sees."""
    m = messages.select("session_id", F.col("ordinal").alias("message_ordinal"), F.col("message_json").alias("_text"))
    p = m.where(~large("_text")).select("session_id", "message_ordinal", F.posexplode(F.expr("try_variant_get(try_parse_json(_text), '$.parts', 'array<variant>')")).alias("pos", "v"))
    small = p.select("session_id", "message_ordinal", F.col("pos").cast("long").alias("part_ordinal"), F.expr("try_variant_get(v, '$.kind', 'string')").alias("kind"), F.expr("try_variant_get(v, '$.text', 'string')").alias("text"))
    ship(messages.sparkSession)

    def rows(text: str):
        from skein.store import elements, said

        return [(i, said(v, "kind"), said(v, "text")) for i, v in enumerate(elements(text, "parts"))]

    every = small.unionByName(one_by_one(m.where(large("_text")), "_text", rows, "part_ordinal bigint, kind string, text string"))
    kind = F.coalesce("kind", F.lit("extra"))
    return every.select("session_id", "message_ordinal", "part_ordinal", kind.alias("kind"), S.part_text(kind, F.col("text")).alias("text"))


def bucket(key):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        version = self.manifest()["schema_version"]
        if version not in range(1, SCHEMA_VERSION + 1):
            raise StoreError(f"schema version {version} is not known")
        if version < SCHEMA_VERSION:
            self.migrate()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def manifest(self) -> dict:
        if not self._fs.exists(self._at("CURRENT")):
            return {"version": 0, "schema_version": SCHEMA_VERSION, "embedding_model": None, "tables": {}}
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/CURRENT").collect()))  # one small file

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """A table as it is now, or some buckets of it; what is read later from the result stays at this version. Tables never written are empty."""
        at = self.manifest()["tables"].get(table) or {}
        paths = [f"{self.path}/v={v}/{table}/bucket={b}" for b, v in sorted(at.items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*paths)

    def index(self) -> Index:
        return Index(self.read("postings"), self.read("lengths"), self.read("parts"))

    def migrate(self) -> None:
        """Brings an older store to this version: its sessions are read and all other tables made from them."""
        now = self.manifest()
        old = self.spark.read.schema(TABLES["sessions"]).parquet(f"{self.path}/v={now['tables']['sessions']}/sessions") if "sessions" in now["tables"] else self.spark.createDataFrame([], TABLES["sessions"])
        held = self.spark.read.schema(TABLES["vectors"]).parquet(f"{self.path}/v={now['tables']['vectors']}/vectors") if "vectors" in now["tables"] else None
        self.commit(self.derived(old) | ({"vectors": held} if held is not None else {}), list(range(BUCKETS)), tables={})

    def derived(self, sessions: DataFrame) -> dict[str, DataFrame]:
        """The tables made from sessions, and these."""
        messages = explode_messages(sessions)
        parts = explode_parts(messages)
        return {"sessions": sessions, "messages": messages, "parts": parts, "postings": postings(parts), "lengths": lengths(parts)}

    def guard(self, model_id: str | None) -> None:
        held = self.manifest().get("embedding_model")
        if model_id and held and held != model_id:
            raise StoreError(f"the store has vectors of {held}, not of {model_id}")

    def commit(self, written: dict[str, DataFrame], touched: list[int], **more) -> int:
        """Writes what some buckets of tables hold from now on as a new version and makes it the current one; all else stays as it is.

        A bucket may hold a session with a third of all rows: files of any size are balanced, not one a bucket.
        """
        now = self.manifest()
        v, held = now["version"] + 1, {**now, **more}
        at = {name: dict(x) for name, x in held["tables"].items()}
        for name, df in written.items():
            key = "id" if name == "sessions" else "session_id"
            rows = df.withColumn("bucket", bucket(F.col(key))).hint("rebalance", "bucket").sortWithinPartitions("bucket", *(["term"] if name == "postings" else []))
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={v}/{name}")
            folder = self._at(f"v={v}/{name}")
            there = {int(f.getPath().getName().split("=")[1]) for f in self._fs.listStatus(folder) if "=" in f.getPath().getName()} if self._fs.exists(folder) else set()
            at[name] = {b: w for b, w in at.get(name, {}).items() if int(b) not in touched} | {str(b): v for b in there}
        out = self._fs.create(self._at(f"CURRENT.{v}"), True)
        out.write(bytearray(json.dumps({**held, "version": v, "schema_version": SCHEMA_VERSION, "tables": at}).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._at(f"CURRENT.{v}"), self._at("CURRENT"), options)
        return v

    def sync(self, found: DataFrame, since: str | None = None, refresh: bool = True, prune: bool | None = None, dry_run: bool = False, force: bool = False, embedder=None) -> DataFrame:
        """One pass over summaries (streaming.scan.found): only sessions that are new or may have changed are opened.

        A session is opened when its stamp, activity or number of messages differs from what is stored, or
        where its source gives no stamp. Returns the report by agent with the columns pruned and opened.
        """
        ws = Workspace(self.spark)
        found, _ = ws.write(found, "found")
        first = S.first_report(found, ["id"])
        held = self.read("sessions").select("id", F.col("stamp").alias("_stamp"), F.lit(True).alias("_known"))
        cut = (F.col("last_activity_at") != "") & (F.col("last_activity_at") < since) if since is not None else F.lit(False)
        same = (F.col("stamp") != "") & F.col("stamp").eqNullSafe(F.col("_stamp"))
        need = ~cut & (F.col("_known").isNull() | (F.lit(refresh) & (F.lit(force) | ~same)))
        marked, _ = ws.write(first.join(held, "id", "left").withColumn("_open", need), "marked")
        got = open_found(marked.where("_open and openable").repartition(max(2, self.spark.sparkContext.defaultParallelism), "id"))
        content, seen = ws.write(got, "opened", n=F.count("*"))
        columns = ["message_count", "content_hash", "session_json", "started_at", "last_activity_at", "project_id", "openable"]
        content = content.select("id", *[F.col(c).alias(f"_{c}") for c in columns])
        # what was not opened is as it is stored
        stored = self.read("sessions").select("id", *[F.col(c).alias(f"s_{c}") for c in columns if c not in ("session_json", "openable")])
        j = marked.join(content, "id", "left").join(stored, "id", "left")
        pick = lambda c: F.when(F.col("_open") & F.col("openable"), F.coalesce(f"_{c}", c) if c in marked.columns else F.col(f"_{c}")).otherwise(F.coalesce(f"s_{c}", c) if c in marked.columns else F.col(f"s_{c}"))
        able = F.when(F.col("_open"), F.coalesce("_openable", F.col("openable"))).otherwise(F.col("openable"))
        skipped = F.when(cut, F.col("last_activity_at"))
        reports = j.select(
            "id", "agent", pick("project_id").alias("project_id"), pick("started_at").alias("started_at"), F.coalesce(skipped, pick("last_activity_at")).alias("last_activity_at"), pick("message_count").alias("message_count"),
            pick("content_hash").alias("content_hash"), F.col("_session_json").alias("session_json"), "stamp", able.alias("openable"), "source_place", "place",
        )
        reports, _ = ws.write(reports, "reports")
        # what was opened is compared by content, what was not has the stored one
        out = self.ingest(reports, since, refresh, prune, dry_run, True, embedder.model_id if embedder else None, discovered=found)
        if embedder and not dry_run:
            self.embed(embedder)
        return out.withColumn("opened", F.lit(seen["n"] or 0))

    def ingest(self, reported: DataFrame, since: str | None = None, refresh: bool = True, prune: bool | None = None, dry_run: bool = False, force: bool = False, model_id: str | None = None, discovered: DataFrame | None = None) -> DataFrame:
        """One pass over the reported sessions; returns the report by agent, with a column pruned.

        Whole sessions are replaced. Sessions cut off by since are still reported, so never pruned. A session
        whose JSON is no object is an error and replaces nothing. discovered holds the reports to be counted,
        where reported has each session once.
        """
        self.guard(model_id)
        spark, stored = self.spark, self.read("sessions")
        prune = refresh if prune is None else prune
        if "stamp" not in reported.columns:
            reported = reported.withColumn("stamp", F.lit(None).cast("string"))
        sound = F.col("session_json").isNull() | large("session_json") | F.expr("try_variant_get(try_parse_json(session_json), '$', 'map<string,variant>') is not null")
        reported = reported.withColumn("openable", F.coalesce("openable", F.lit(True)) & F.coalesce(sound, F.lit(True)))
        discovered = reported if discovered is None else discovered
        done, _ = Workspace(spark).write(S.classify(reported, stored, since, refresh, force), "classified")
        gone = S.pruned(stored, discovered) if prune else spark.createDataFrame([], "id string")
        lost = stored.join(gone, "id", "left_semi").groupBy("agent").agg(F.count("*").alias("pruned"))
        agents = discovered.select("agent").unionByName(stored.select("agent"))
        report = S.report(done, discovered, agents).join(lost, "agent", "left").na.fill(0)
        rows = [r.asDict() for r in report.collect()]  # a row an agent
        result = spark.createDataFrame(rows, report.schema)
        fresh = S.first_report(reported, ["id"]).where("session_json is not null").join(done.where("outcome in ('new', 'updated')").select("id"), "id", "left_semi").select(*stored.columns)
        if dry_run or not any(r["new"] or r["updated"] or r["pruned"] for r in rows):
            return result
        out, _ = Workspace(spark).write(fresh.select("id").unionByName(gone), "replaced")
        touched = [r["b"] for r in out.select(bucket(F.col("id")).alias("b")).distinct().collect()]  # at most BUCKETS
        keep = lambda name, key: self.read(name, touched).join(out.withColumnRenamed("id", key), key, "left_anti")
        new = self.derived(fresh)
        if "vectors" in self.manifest()["tables"]:
            new["vectors"] = spark.createDataFrame([], TABLES["vectors"])
        self.commit({name: keep(name, "id" if name == "sessions" else "session_id").unionByName(df) for name, df in new.items()}, touched)
        return result

    def embed(self, embedder) -> int:
        """Vectors for the parts with text that have none yet; returns the version. Refuses another model than the store's."""
        self.guard(embedder.model_id)
        ship(self.spark)
        keys = TABLES["vectors"].rsplit(",", 1)[0]
        todo = self.read("parts").where("text is not null").join(self.read("vectors"), ["session_id", "message_ordinal", "part_ordinal"], "left_anti")

        def vectors(batches):
            for b in batches:
                yield b[["session_id", "message_ordinal", "part_ordinal"]].assign(embedding=embedder.embed(list(b["text"])))

        new = todo.select("session_id", "message_ordinal", "part_ordinal", "text").mapInPandas(vectors, f"{keys}, embedding array<float>")
        new, _ = Workspace(self.spark).write(new, "vectors")
        touched = [r["b"] for r in new.select(bucket(F.col("session_id")).alias("b")).distinct().collect()]  # at most BUCKETS
        v = self.commit({"vectors": self.read("vectors", touched).unionByName(new)}, touched, embedding_model=embedder.model_id)
        texts, held = (self.read(t) for t in ("parts", "vectors"))
        if texts.where("text is not null").count() != held.count():
            raise StoreError("vectors and texts differ in number")
        return v
