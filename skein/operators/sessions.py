"""Filters, orders, deduplication, change capture, usage and statistics of sessions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SessionFilter:
    """All given conditions hold. Times compare as text, so '' fails since and passes until."""

    agents: tuple[str, ...] = ()
    project: str | None = None
    part_kind: str | None = None
    since: str | None = None
    until: str | None = None
    limit: int | None = None

    def apply(self, sessions: DataFrame, parts: DataFrame | None = None) -> DataFrame:
        """Matching sessions, in recent order; null fields match no condition."""
        out = sessions
        if self.agents:
            out = out.where(F.col("agent").isin(*self.agents))
        if self.project is not None:
            out = out.where(F.col("project_id") == self.project)
        if self.since is not None:
            out = out.where(F.col("last_activity_at") >= self.since)
        if self.until is not None:
            out = out.where(F.col("last_activity_at") <= self.until)
        if self.part_kind is not None:
            out = out.join(parts.where(F.col("kind") == self.part_kind).select(F.col("session_id").alias("id")), "id", "left_semi")
        return recent(out, self.limit)


def recent(sessions: DataFrame, limit: int | None = None) -> DataFrame:
    """Last activity first, then id; sessions without activity last."""
    out = sessions.orderBy(F.desc("last_activity_at"), "id")
    return out.limit(limit) if limit is not None else out


def page_after(sessions: DataFrame, last_activity: str, last_id: str, size: int) -> DataFrame:
    """The next page after a row in recent order."""
    after = (F.col("last_activity_at") < last_activity) | ((F.col("last_activity_at") == last_activity) & (F.col("id") > last_id))
    return recent(sessions.where(after), size)


def resolve(sessions: DataFrame, wanted: str) -> DataFrame:
    """The ids an exact id or a prefix stands for: one row when it is clear. An exact id wins."""
    ids = sessions.where(F.col("id").startswith(wanted)).select("id").distinct()
    exact = ids.where(F.col("id") == wanted)
    return exact.unionByName(ids.join(exact.select(F.col("id").alias("_e")), F.lit(True), "left_anti"))


def messages_with(messages: DataFrame, parts: DataFrame, kind: str) -> DataFrame:
    """Messages that have a part of a kind."""
    return messages.join(parts.where(F.col("kind") == kind).select("session_id", F.col("message_ordinal").alias("ordinal")), ["session_id", "ordinal"], "left_semi")


#: Columns that say in which order sessions were reported: source after source, and within one as it lists them.
REPORTED = ["source_place", "place"]


def first_report(reports: DataFrame, keys: list[str], order: list = REPORTED) -> DataFrame:
    """The first report of each key. Repeated keys are found with a map-side combine, not in a window."""
    rest = [c for c in reports.columns if c not in keys]
    return reports.groupBy(*keys).agg(F.min(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *rest)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def part_text(kind: Column, text: Column) -> Column:
    """Text of the kinds that have one for search."""
    return F.when(kind.isin("text", "thinking", "tool_result", "system"), text)


# ---- change capture -------------------------------------------------------------------------------

OUTCOMES = ["new", "updated", "unchanged", "skipped", "error"]


def classify(reported: DataFrame, stored: DataFrame, since: str | None = None, refresh: bool = True, force: bool = False) -> DataFrame:
    """Reported sessions with their outcome against the store: id, agent, outcome, messages, delta.

    Both sides have id, agent, last_activity_at, message_count, content_hash; reported has openable and the columns REPORTED.
    Of an id reported twice the first report counts. Activity before since is skipped, empty activity never. Without
    refresh stored ids are unchanged. A session whose activity and count are as stored is not opened;
    one that was opened is updated only if its content differs; one that cannot be opened is an error.
    """
    one = first_report(reported, ["id"])
    s = stored.select("id", *[F.col(c).alias(f"s_{c}") for c in ("last_activity_at", "message_count", "content_hash")], F.lit(True).alias("known"))
    same = F.col("last_activity_at").eqNullSafe(F.col("s_last_activity_at")) & F.col("message_count").eqNullSafe(F.col("s_message_count"))
    cut = (F.col("last_activity_at") != "") & (F.col("last_activity_at") < since) if since is not None else F.lit(False)
    opened = F.coalesce(F.col("openable"), F.lit(True))
    outcome = (
        F.when(cut, "skipped")
        .when(F.col("known").isNull(), F.when(opened, "new").otherwise("error"))
        .when(F.lit(not refresh) | (same & F.lit(not force)), "unchanged")
        .when(~opened, "error")
        .when(F.col("content_hash").eqNullSafe(F.col("s_content_hash")), "unchanged")
        .otherwise("updated")
    )
    j = one.join(s, "id", "left").withColumn("outcome", outcome)
    return j.select("id", "agent", "outcome", F.coalesce("message_count", F.lit(0)).alias("messages"), (F.coalesce("message_count", F.lit(0)) - F.coalesce("s_message_count", F.lit(0))).alias("delta"))


def pruned(stored: DataFrame, reported: DataFrame) -> DataFrame:
    """Stored ids that no source reports any more."""
    return stored.join(reported.select("id"), "id", "left_anti").select("id")


def report(classified: DataFrame, reported: DataFrame, agents: DataFrame) -> DataFrame:
    """Counts per agent; agents without sessions keep a row of zeros. Repeated reports count as discovered."""
    count = lambda o: F.coalesce(F.count(F.when(F.col("outcome") == o, 1)), F.lit(0))
    per = classified.groupBy("agent").agg(
        *[count(o).alias(o) for o in OUTCOMES],
        F.coalesce(F.sum(F.when(F.col("outcome") == "new", F.col("messages"))), F.lit(0)).alias("added_messages"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "updated", F.col("delta"))), F.lit(0)).alias("net_messages"),
    )
    found = reported.groupBy("agent").agg(F.count("*").alias("discovered"))
    return agents.select("agent").distinct().join(found, "agent", "left").join(per, "agent", "left").na.fill(0)


# ---- usage ----------------------------------------------------------------------------------------

COUNTERS = ["input_tokens", "output_tokens", "cache_read_tokens"]


def counters(json: Column) -> list[Column]:
    """Usage counters of a message: null unless a whole number not below 0."""
    out = []
    for c in COUNTERS:
        v = F.get_json_object(json, f"$.usage.{c}")
        out.append(F.when(v.rlike(r"^\d{1,18}$"), v.try_cast("long")).alias(c))
    return out


def turn_usage(messages: DataFrame) -> DataFrame:
    """Null-aware sums per session and turn, with the first model in order: null where nothing was recorded."""
    m = messages.where("turn_id is not null").select("session_id", "turn_id", "ordinal", *counters(F.col("message_json")), F.get_json_object("message_json", "$.usage.model").alias("model"))
    first = F.min(F.when(F.col("model").isNotNull(), F.struct("ordinal", "model")))["model"]
    return m.groupBy("session_id", "turn_id").agg(*[F.sum(c).alias(c) for c in COUNTERS], first.alias("model"))


def thread_usage(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Null-aware sums per session over the turns that session_json registers under its key turns.

    turns is a result of turn_usage(). Turns that only messages name do not count; sessions without a
    registered turn of their messages have no row, as have those whose session_json is no object.
    """
    keys = F.expr("map_keys(try_variant_get(try_parse_json(session_json), '$.turns', 'map<string,variant>'))")
    registered = sessions.select(F.col("id").alias("session_id"), F.explode(keys).alias("turn_id"))
    return turns.join(registered, ["session_id", "turn_id"], "left_semi").groupBy("session_id").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def content_hashes(sessions: DataFrame, messages: DataFrame, block: int = 1024) -> DataFrame:
    """SHA-256 of the whole content per session: id, content_hash, messages.

    The hash of the hashes of blocks of messages after that of session_json; a block holds the ordinals from
    a multiple of block, so a session with a third of all messages is hashed by many tasks. Nulls hash as ''.
    """
    sha = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    folded = lambda key: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, "h"))), lambda x: x["h"]), ""), 256)
    each = messages.select(F.col("session_id").alias("id"), F.floor(F.col("ordinal") / block).alias("b"), "ordinal", sha(F.col("message_json")).alias("h"))
    blocks = each.groupBy("id", "b").agg(folded("ordinal").alias("h"), F.count("*").alias("n"))
    own = sessions.select("id", F.lit(-1).cast("long").alias("b"), sha(F.col("session_json")).alias("h"), F.lit(0).cast("long").alias("n"))
    return blocks.join(sessions.select("id"), "id", "left_semi").unionByName(own).groupBy("id").agg(folded("b").alias("content_hash"), F.sum("n").alias("messages"))


def bounds(messages: DataFrame) -> DataFrame:
    """First and last timestamp in order of the messages, and their number."""
    t = F.when(F.coalesce(F.col("timestamp"), F.lit("")) != "", F.struct("ordinal", "timestamp"))
    return messages.groupBy("session_id").agg(F.coalesce(F.min(t)["timestamp"], F.lit("")).alias("started_at"), F.coalesce(F.max(t)["timestamp"], F.lit("")).alias("last_activity_at"), F.count("*").alias("message_count"))


def buckets(sessions: DataFrame, by: str) -> DataFrame:
    """Sessions per source, project or day, most first."""
    key = {
        "source": F.col("agent"),
        "project": F.when(F.coalesce(F.col("project_id"), F.lit("")) == "", "no project").otherwise(F.col("project_id")),
        "day": F.when(F.coalesce(F.col("last_activity_at"), F.lit("")) == "", "no activity").otherwise(F.substring("last_activity_at", 1, 10)),
    }[by]
    return sessions.groupBy(key.alias("bucket")).agg(F.count("*").alias("sessions")).orderBy(F.desc("sessions"), "bucket")


def opened(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Sessions with their messages and these with their parts: a row a message, in the order of id and ordinal.

    A session without messages keeps a row with nulls. Only the parts of one message are ever in one row;
    the order is made by ranges, so a session of any length is spread over tasks.
    """
    p = parts.groupBy("session_id", F.col("message_ordinal").alias("ordinal")).agg(F.sort_array(F.collect_list(F.struct("part_ordinal", "kind", "text"))).alias("parts"))
    m = messages.join(p, ["session_id", "ordinal"], "left").withColumnRenamed("session_id", "id")
    return sessions.join(m, "id", "left").orderBy("id", "ordinal")


def tool_pairs(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls of tools with their results in the same session; calls without one keep a row."""
    r = results.select("session_id", F.col("call_id").alias("id"), F.col("path").alias("result_path"), F.col("ordinal").alias("result_ordinal"))
    return calls.join(r, ["session_id", "id"], "left")


# ---- consumers ------------------------------------------------------------------------------------


def meter(parts: DataFrame) -> DataFrame:
    """Thanks and curses in spoken text per session."""
    t = F.lower(F.coalesce("text", F.lit("")))
    has = lambda words: reduce(lambda a, b: a | b, [t.contains(w) for w in words])
    return parts.where("kind = 'text'").groupBy("session_id").agg(
        F.count(F.when(has(["thanks", "thank you"]), 1)).alias("thanks"), F.count(F.when(has(["fuck", "f***", "f**k"]), 1)).alias("curses")
    ).withColumn("favors_thanks", F.col("thanks") > F.col("curses"))


class SessionMetric(Protocol):
    """What a consumer measures of sessions: a name and, of parts, one row a session with a column session_id."""

    name: str

    def score(self, parts: DataFrame) -> DataFrame: ...


class Meter:
    name = "meter"

    def score(self, parts: DataFrame) -> DataFrame:
        return meter(parts)


class Moods:
    """Spoken parts of each session by sentiment."""

    name = "sentiment"

    def score(self, parts: DataFrame) -> DataFrame:
        from skein.functions.sentiment import sentiment

        p = parts.where("kind = 'text' and text is not null").select("session_id", F.explode(F.array(sentiment(F.col("text")))).alias("l"))
        return p.groupBy("session_id").agg(*[F.count(F.when(F.col("l") == x, 1)).alias(x) for x in ("positive", "negative", "neutral")])


METRICS: dict[str, SessionMetric] = {}


def register(metric: SessionMetric) -> None:
    METRICS[metric.name] = metric


for _metric in (Meter(), Moods()):
    register(_metric)


def measured(parts: DataFrame, names: list[str] | None = None) -> DataFrame:
    """All sessions with the columns of the metrics asked for, each column after its metric's name."""
    out = parts.select("session_id").distinct()
    for n in names if names is not None else sorted(METRICS):
        m = METRICS[n].score(parts)
        out = out.join(m.select("session_id", *[F.col(c).alias(f"{n}_{c}") for c in m.columns if c != "session_id"]), "session_id", "left")
    return out
