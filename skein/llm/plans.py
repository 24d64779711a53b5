"""Queries of the text problems: p1 personal information, p6 packing, p7 mixing, p8 harmful content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from skein.llm import harm as A
from skein.llm import mixing as M
from skein.llm import packing as K
from skein.llm import pii as P
from skein.llm.tokens import source_key, with_tokens
from skein.runtime import Workspace, table


def _sized(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return with_tokens(table(spark, d, "documents").select(*columns), "text")


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    docs = _sized(spark, d, "doc_id", "text").select("doc_id", "tokens")
    return K.pack(docs, table(spark, d, "container_sizes"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return K.fill(p6_packed(spark, d), table(spark, d, "container_sizes"))


def p6_rules(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of container: documents packed, missing ones, ones cut without need, containers too full, pieces out of line."""
    packed, _ = Workspace(spark).write(p6_packed(spark, d), "packed")
    caps = table(spark, d, "container_sizes").select("container", "capacity_tokens")
    per = packed.groupBy("container", "doc_id").agg(F.count("*").alias("got"), F.max("pieces").alias("pieces"), F.countDistinct("piece").alias("numbers"), F.sum("tokens").alias("tokens")).join(F.broadcast(caps), "container")
    docs = per.groupBy("container").agg(F.count("*").alias("docs"), F.count(F.when((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens")), 1)).alias("cut"), F.count(F.when((F.col("got") != F.col("pieces")) | (F.col("numbers") != F.col("pieces")), 1)).alias("odd"))
    full = packed.groupBy("container", "container_id").agg(F.sum("tokens").alias("t")).join(F.broadcast(caps), "container").groupBy("container").agg(F.count(F.when(F.col("t") > F.col("capacity_tokens"), 1)).alias("overfull"))
    return docs.join(full, "container")


def p7_rules(spark: SparkSession, d: str) -> DataFrame:
    """Per target source: whether it is as near its target as whole documents allow and no document is used more often than allowed."""
    mixed, _ = Workspace(spark).write(p7_mix(spark, d), "mix")
    largest = mixed.agg(F.max("tokens").alias("largest"), F.sum(F.col("tokens") * F.col("uses")).alias("every"), F.countDistinct("source").alias("sources"))  # one row
    s = M.shares(mixed, table(spark, d, "source_targets")).join(F.broadcast(largest))
    met = F.abs(F.col("tokens") - F.col("target_share") * F.col("every")) <= F.col("largest") * F.col("sources")
    return s.select("source", met.alias("share_met"), (F.col("most_uses") <= F.col("max_repeats")).alias("cap_kept"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return M.mix(_sized(spark, d, "doc_id", "text", "source"), table(spark, d, "source_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    mixed, _ = Workspace(spark).write(p7_mix(spark, d), "mix")
    return M.shares(mixed, table(spark, d, "source_targets"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return A.score(table(spark, d, "documents"), table(spark, d, "doc_labels"), ["doc_id", "source"])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).where("harmful = 1").select("doc_id").distinct()


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return A.rates(p8_scores(spark, d), source_key(F.col("source")))


_PART = ["session_id", "message_ordinal", "part_ordinal"]


def p1_items(spark: SparkSession, d: str) -> DataFrame:
    return P.found(table(spark, d, "parts"), _PART, "text").distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return P.found(table(spark, d, "parts"), _PART, "text", alone=False).select(*_PART, "pii_type", "start_pos").distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return P.redacted(table(spark, d, "parts").select(*_PART, "kind", "text"), "text").drop("text")


QUERIES = {f.__name__: f for f in (p1_found, p1_items, p1_redacted, p8_found, p8_scores, p8_rates, p6_packed, p6_fill, p6_rules, p7_mix, p7_shares, p7_rules)}
# What must hold of any right answer; sizes in tokens are not for SQL.
ORACLE: dict[str, str] = {
    "p6_rules": "SELECT container, (SELECT count(DISTINCT doc_id) FROM documents) AS docs, 0 AS cut, 0 AS odd, 0 AS overfull FROM container_sizes",
    "p7_rules": "SELECT replace(replace(lower(trim(source)), ' ', '_'), '-', '_') AS source, true AS share_met, true AS cap_kept FROM source_targets",
}
