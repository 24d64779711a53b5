"""Mixing sources to target shares of the total size, with capped repetition.

Documents are aggregated by membership pattern: the set of sources that hold an exact copy of the text.
A min-cost flow over patterns, repetitions and sources routes tokens to the quotas; each further use
of the same tokens costs more, so repetition spreads evenly. Then documents are drawn by a seeded
hash: thresholds on the hash are found from histograms that stay in tables; only the patterns in use come to the driver.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.tokens import source_key
from skein.runtime import BROADCAST_ROWS, Workspace

_BUCKETS = 4096
_SALTS = 64
#: Patterns and sources in use that a flow is planned over.
_PATTERNS = 20_000


class Flow:
    """Min-cost flow by successive cheapest paths on a small graph of float capacities."""

    def __init__(self):
        self.to, self.cap, self.cost, self.out = [], [], [], {}

    def edge(self, a, b, cap: float, cost: float) -> int:
        k = len(self.to)
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0.0, -cost)):
            self.out.setdefault(x, []).append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
            self.out.setdefault(y, [])
        return k

    def run(self, s, t, least: float) -> float:
        total = 0.0
        while True:
            dist, via, queue, queued = {s: 0.0}, {}, deque([s]), {s}
            while queue:
                a = queue.popleft()
                queued.discard(a)
                for e in self.out[a]:
                    b = self.to[e]
                    if self.cap[e] > least and dist[a] + self.cost[e] < dist.get(b, 1e300) - 1e-9:
                        dist[b], via[b] = dist[a] + self.cost[e], e
                        if b not in queued:
                            queue.append(b)
                            queued.add(b)
            if t not in dist:
                return total
            path, b = [], t
            while b != s:
                path.append(via[b])
                b = self.to[via[b] ^ 1]
            push = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= push
                self.cap[e ^ 1] += push
            total += push


def route(tokens: dict[tuple, float], shares: dict[str, float], repeats: dict[str, int], total: float) -> tuple[dict, float]:
    """Tokens from each pattern to each source for a mix of a total, and what was routed."""
    g, sent = Flow(), {}
    for p, n in tokens.items():
        own = [s for s in p if s in shares]
        for k in range(1, sum(repeats[s] for s in own) + 1):
            g.edge("from", p, n, float(k * k))
        for s in own:
            sent[p, s] = (g.edge(p, s, n * repeats[s], 0.0), n * repeats[s])
    for s, share in shares.items():
        g.edge(s, "to", share * total, 0.0)
    done = g.run("from", "to", 1e-6 * max(1.0, total) / 1e3) if tokens else 0.0
    return {k: full - g.cap[e] for k, (e, full) in sent.items()}, done


def largest_total(tokens: dict, shares: dict, repeats: dict) -> float:
    """The largest total whose shares can all be met."""
    lo, hi = 0.0, sum(n * sum(repeats[s] for s in p if s in shares) for p, n in tokens.items())
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if route(tokens, shares, repeats, mid)[1] >= mid * (1 - 1e-7) else (lo, mid)
    return lo


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17) -> DataFrame:
    """One row per document used: doc_id, source, tokens, uses.

    docs has doc_id, text, source, tokens; targets has source, target_share, max_repeats. total is the
    size of the mix in tokens, by default the largest that meets every share exactly; with a larger
    one, sources fall short by what their cap forbids. Sources without a target, null sources and
    documents of no tokens are not used. No document is used more than max_repeats times. Shares are
    scaled to a sum of 1. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    want = targets.where("target_share > 0 and max_repeats > 0").groupBy(source_key(F.col("source")).alias("source")).agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r")).collect()  # one row a source
    scale = sum(r["w"] for r in want) or 1.0
    shares, repeats = {r["source"]: r["w"] / scale for r in want}, {r["source"]: r["r"] for r in want}
    # a group of copies may hold a third of all rows: which sources hold a text is combined before the shuffle
    rows = docs.where("tokens > 0").select("doc_id", source_key(F.col("source")).alias("source"), "tokens", F.sha2("text", 256).alias("copy"))
    rows = rows.where(F.col("source").isin(list(shares)))
    rows, _ = ws.write(rows.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(_BUCKETS * _BUCKETS))), "rows")
    shared = rows.groupBy("copy").agg(F.sort_array(F.collect_set("source")).alias("pattern")).where("size(pattern) > 1")
    shared, seen = ws.write(shared, "shared", n=F.count("*"))
    few = (seen["n"] or 0) <= BROADCAST_ROWS
    # beyond what may be sent to all tasks, rows of a copy are spread over salts and the patterns repeated for each
    if few:
        item = rows.join(F.broadcast(shared), "copy", "left")
    else:
        salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        item = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int")).join(salted, ["copy", "salt"], "left").drop("salt")
    item, _ = ws.write(item.select("doc_id", "source", "tokens", "h", F.coalesce("pattern", F.array("source")).alias("pattern")), "items")
    held = item.groupBy("pattern", "source").agg(F.sum("tokens").alias("n"))
    # the patterns in use: the flow is planned over them, so there may be at most as many as it can take
    rows_ = held.limit(_PATTERNS + 1).collect()
    if len(rows_) > _PATTERNS:
        raise ValueError(f"texts are shared by more than {_PATTERNS} sets of sources")
    have = {(tuple(r["pattern"]), r["source"]): r["n"] for r in rows_}
    most: dict = {}
    for (p, s), n in have.items():
        most[p] = max(most.get(p, 0), n)
    best = largest_total(most, shares, repeats) if total is None else total
    sent, _ = route(most, shares, repeats, best)
    picks = []
    for (p, s), n in have.items():
        q = min(sent.get((p, s), 0.0), n * repeats[s])
        whole = min(int(q / n + 1e-9), repeats[s])
        rest = q - whole * n
        picks.append((list(p), s, whole, float(rest) if rest > 1e-6 * n and whole < repeats[s] else 0.0))
    if not picks:
        return spark.createDataFrame([], "doc_id bigint, source string, tokens bigint, uses int")
    chosen = F.broadcast(spark.createDataFrame(picks, "pattern array<string>, source string, whole int, rest double"))  # a row a pattern and source in use
    coarse = _below(item.join(chosen, ["pattern", "source"]).withColumn("b", F.floor(F.col("h") / _BUCKETS)), "b")
    coarse = coarse.select("pattern", "source", F.col("b").alias("cut"), F.col("left").alias("rest"))  # the bucket that is taken in part
    inside = item.join(F.broadcast(coarse), ["pattern", "source"]).where(F.floor(F.col("h") / _BUCKETS) == F.col("cut"))
    fine = _below(inside.withColumn("b", F.pmod("h", F.lit(_BUCKETS))), "b", "cut")
    cuts = coarse.drop("rest").join(fine.select("pattern", "source", F.col("b").alias("c")), ["pattern", "source"], "left")
    # without a bucket taken in part all or nothing is: rest was 0, or all of the source
    under = F.when(F.col("cut").isNotNull(), F.col("cut") * _BUCKETS + F.coalesce("c", F.lit(_BUCKETS))).otherwise(F.when(F.col("rest") > 0, _BUCKETS * _BUCKETS).otherwise(0))
    used = item.join(chosen, ["pattern", "source"]).join(F.broadcast(cuts), ["pattern", "source"], "left")
    used = used.withColumn("uses", F.col("whole") + F.when(F.col("h") < under, 1).otherwise(0))
    return used.where("uses > 0").select("doc_id", "source", "tokens", "uses")


def _below(rows: DataFrame, bucket: str, *keep: str) -> DataFrame:
    """The first bucket of each pattern and source that rest does not fill, and what is left of rest there; none where all is filled or rest is 0."""
    n = rows.where("rest > 0").groupBy("pattern", "source", *keep, bucket).agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("pattern", "source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)  # at most _BUCKETS rows
    over = n.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") > F.col("rest") + 1e-9)
    return over.groupBy("pattern", "source").agg(F.min(F.struct(F.col(bucket).alias("b"), (F.col("rest") - (F.col("upto") - F.col("n"))).alias("left"))).alias("m")).select("pattern", "source", "m.b", "m.left")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its target and reached share, documents, tokens and the most uses of a document."""
    per = mixed.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"))
    t = targets.groupBy(source_key(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    every = mixed.agg(F.sum(F.col("tokens") * F.col("uses")).alias("every"))
    return (
        t.join(per, "source", "left").crossJoin(F.broadcast(every))  # one row
        .select("source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("every"), F.lit(0.0)), 6).alias("share"), "max_repeats", F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    )
