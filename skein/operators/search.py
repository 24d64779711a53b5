"""Full-text, semantic and hybrid search over parts of messages.

Text is found through an index: postings (term, part, positions, length of the part) sorted by term, and
the lengths of all parts. A query reads the postings of its words only, ranks keys, and fetches the texts
of the hits last.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.runtime import Workspace, positions

KEYS = ["session_id", "message_ordinal", "part_ordinal"]
#: Nearest parts looked at, and the least similarity of a hit.
NEIGHBOURS, FLOOR = 4096, 0.3


def corpus_stats(parts: DataFrame) -> DataFrame:
    """Parts with text, their mean length in words and the sum of lengths: one row."""
    return parts.where("text is not null").agg(F.count("*").alias("n"), F.avg(F.size(T.words(F.col("text"))).cast("double")).alias("mean_length"), F.sum(F.size(T.words(F.col("text")))).cast("long").alias("total"))


def postings(parts: DataFrame) -> DataFrame:
    """Inverted index: term, keys of the part, tf, length of the part in words, positions. Null and empty texts have none."""
    tokens = parts.where("text is not null").select(*KEYS, T.words(F.col("text")).alias("w"))
    exploded = tokens.select(*KEYS, F.size("w").alias("length"), F.posexplode("w").alias("pos", "term"))
    return exploded.groupBy("term", *KEYS).agg(F.count("*").alias("tf"), F.max("length").alias("length"), F.sort_array(F.collect_list("pos")).alias("positions"))


def lengths(parts: DataFrame) -> DataFrame:
    """Length in words of each part that has a text."""
    return parts.where("text is not null").select(*KEYS, F.size(T.words(F.col("text"))).alias("length"))


@dataclass(frozen=True)
class Index:
    """What a search reads: postings, lengths, and the parts themselves for the texts of hits."""

    postings: DataFrame
    lengths: DataFrame
    parts: DataFrame

    @classmethod
    def of(cls, parts: DataFrame) -> Index:
        """An index that is derived from the parts at each search."""
        return cls(postings(parts), lengths(parts), parts)

    @classmethod
    def written(cls, parts: DataFrame, workspace: Workspace) -> Index:
        """An index written once, its postings in order of terms, so that a search skips the others."""
        parts, _ = workspace.write(parts, "parts")
        posts, _ = workspace.write(postings(parts).repartitionByRange("term", *KEYS).sortWithinPartitions("term", *KEYS), "postings")
        return cls(posts, workspace.write(lengths(parts), "lengths")[0], parts)

    def texts(self, hits: DataFrame) -> DataFrame:
        """hits with their texts."""
        return hits.join(self.parts.select(*KEYS, "text"), KEYS)


def phrase_hits(posts: DataFrame, phrase: list[str]) -> DataFrame:
    """Parts that hold a phrase: keys, length, tf."""
    word = lambda w, i: posts.where(F.col("term") == w).select(*KEYS, *(["length"] if i == 0 else []), F.col("positions").alias(f"_p{i}"), F.col("tf").alias(f"_n{i}"))
    hits = word(phrase[0], 0)
    if len(phrase) == 1:
        return hits.select(*KEYS, "length", F.col("_n0").alias("tf"))
    for i, w in enumerate(phrase[1:], 1):
        hits = hits.join(word(w, i), KEYS).withColumn("_p0", F.expr(f"filter(_p0, x -> array_contains(_p{i}, x + {i}))")).where("size(_p0) > 0").drop(f"_p{i}", f"_n{i}")
    return hits.select(*KEYS, "length", F.size("_p0").cast("long").alias("tf"))


def part_scores(index: Index, query: str) -> DataFrame:
    """Parts that hold all phrases of a query: keys, rank (lower is better).

    Statistics are of all parts, before any filter. A query without a word matches nothing.
    """
    phrases = T.query_phrases(query)
    if not phrases:
        return index.lengths.select(*KEYS, F.lit(0.0).alias("rank")).limit(0)
    each = [phrase_hits(index.postings, p).withColumnRenamed("tf", f"_tf{i}").withColumnRenamed("length", "_len" if i == 0 else f"_len{i}") for i, p in enumerate(phrases)]
    stats = index.lengths.agg(F.count("*").alias("_n"), F.avg(F.col("length").cast("double")).alias("_avg"))
    for i, h in enumerate(each):
        stats = stats.join(F.broadcast(h.agg(F.count("*").alias(f"_tf{i}df"))))  # one row each
    hits = reduce(lambda a, b: a.join(b, KEYS), each)
    joined = hits.join(F.broadcast(stats))  # statistics are one row
    score = reduce(lambda a, b: a + b, [T.bm25(F.col(f"_tf{i}"), F.col(f"_tf{i}df"), F.col("_n"), F.col("_len"), F.col("_avg")) for i in range(len(phrases))])
    return joined.select(*KEYS, (-score).alias("rank"))


def ranked_sessions(matches: DataFrame) -> DataFrame:
    """Sessions by number of matching parts, then best part, then id: session_id, matches, best, position."""
    per = matches.groupBy("session_id").agg(F.count("*").alias("matches"), F.min("rank").alias("best"))
    return positions(per, [F.desc("matches"), F.round("best", 12), F.col("session_id")])


def ranked_hits(index: Index, query: str, sessions: DataFrame | None = None) -> DataFrame:
    """Hits without their texts: keys, score, position of the session."""
    found = part_scores(index, query)
    if sessions is not None:
        found = found.join(sessions.select(F.col("id").alias("session_id")).distinct(), "session_id", "left_semi")
    order = ranked_sessions(found).select("session_id", "position")
    return found.join(order, "session_id").select(*KEYS, T.fused(F.col("position")).alias("score"), "position")


def text_search(index: Index, query: str, sessions: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Hits: keys, text, score; ordered by session position, then message and part."""
    hits, order = ranked_hits(index, query, sessions), ["position", "message_ordinal", "part_ordinal"]
    if limit is not None:
        hits = hits.orderBy(*order).limit(limit)
    return index.texts(hits).orderBy(*order).select(*KEYS, "text", "score")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: list[float], k: int = NEIGHBOURS) -> DataFrame:
    """The k parts most similar to a query vector: keys, similarity."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(*KEYS, cosine(F.col("embedding"), q).alias("similarity")).where("similarity is not null").orderBy(F.desc("similarity"), *KEYS).limit(k)


def semantic_sessions(vectors: DataFrame, query: list[float], sessions: DataFrame | None = None, prefilter: bool = False) -> tuple[DataFrame, DataFrame]:
    """Hits above the floor among the nearest parts, and their sessions with best similarity and position.

    The sessions asked for are chosen among the nearest parts of all; with prefilter before, so that none is lost.
    """
    chosen = sessions.select(F.col("id").alias("session_id")).distinct() if sessions is not None else None
    if chosen is not None and prefilter:
        vectors = vectors.join(chosen, "session_id", "left_semi")
    hits = nearest(vectors, query).where(F.col("similarity") >= FLOOR)
    if chosen is not None and not prefilter:
        hits = hits.join(chosen, "session_id", "left_semi")
    best = hits.groupBy("session_id").agg(F.max("similarity").alias("best"))  # at most NEIGHBOURS rows
    return hits, best.withColumn("best", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "best"))).withColumn("position", F.row_number().over(Window.orderBy(F.desc("best"), "session_id")))


def semantic_search(vectors: DataFrame, index: Index, query: list[float] | None, k: int = 10, sessions: DataFrame | None = None, prefilter: bool = False) -> DataFrame:
    """Hits of the k most similar sessions: keys, text, score. Without a query vector there are none."""
    if query is None:
        return index.parts.select(*KEYS, "text", F.lit(0.0).alias("score")).limit(0)
    hits, order = semantic_sessions(vectors, query, sessions, prefilter)
    top = order.where(F.col("position") <= max(k, 1))
    return index.texts(hits.join(top, "session_id")).orderBy("position", F.desc("similarity"), "message_ordinal", "part_ordinal").select(*KEYS, "text", F.col("best").alias("score"))


def hybrid_search(index: Index, vectors: DataFrame, query: str, vector: list[float] | None, sessions: DataFrame | None = None, prefilter: bool = False) -> DataFrame:
    """Fused hits: a session scores its text rank plus its best similarity; a part found both ways counts once."""
    if vector is None:
        return text_search(index, query, sessions)
    ws = Workspace(index.parts.sparkSession)
    text, _ = ws.write(ranked_hits(index, query, sessions), "hits")  # keys and scores only, read three times
    hits, order = semantic_sessions(vectors, vector, sessions, prefilter)
    by_text = text.groupBy("session_id").agg(F.max("score").alias("t"))
    score = by_text.join(order.select("session_id", "best"), "session_id", "full").select("session_id", (F.coalesce("t", F.lit(0.0)) + F.coalesce("best", F.lit(0.0))).alias("score"))
    similar = hits.join(text.select(*KEYS), KEYS, "left_anti")
    both = text.select(*KEYS, F.lit(0).alias("way"), F.lit(0.0).alias("similarity")).unionByName(similar.select(*KEYS, F.lit(1).alias("way"), "similarity"))
    return index.texts(both).join(score, "session_id").orderBy(F.desc("score"), "session_id", "way", F.desc("similarity"), "message_ordinal", "part_ordinal").select(*KEYS, "text", "score")
