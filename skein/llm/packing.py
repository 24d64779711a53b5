"""Filling containers of fixed capacity with whole documents.

Planned over the histogram of lengths: best-fit decreasing on counts, so planning costs as much for a
billion documents as for a thousand and its size is bounded by the capacity. The plan gives runs of
slots per length; documents take them by their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.runtime import Workspace


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs of slots (length, first rank, past the last rank, first container, slots a container), and the containers.

    Lengths are 1..capacity. A group is a number of equal containers; groups are found by the least
    space left that still holds the length, and split where only some of their containers take it.
    """
    open_: dict[int, list] = {}  # space left -> groups (first container, containers)
    spaces: list[int] = []
    runs, containers = [], 0

    def put(space: int, group: tuple[int, int]) -> None:
        if space > 0:
            if space not in open_:
                open_[space] = []
                insort(spaces, space)
            open_[space].append(group)

    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        while n > 0:
            i = bisect_left(spaces, length)
            if i == len(spaces):
                each = capacity // length
                full, rest = divmod(n, each)
                for many, slots in ((full, each), (1 if rest else 0, rest)):
                    if many:
                        runs.append((length, rank, rank + many * slots, containers, slots))
                        put(capacity - slots * length, (containers, many))
                        rank, containers = rank + many * slots, containers + many
                n = 0
                continue
            space = spaces[i]
            first, many = open_[space].pop()
            if not open_[space]:
                del open_[space]
                spaces.pop(i)
            slots = min(space // length, max(1, n // many)) if n >= many else 1
            take = min(many, n // slots)
            runs.append((length, rank, rank + take * slots, first, slots))
            rank, n = rank + take * slots, n - take * slots
            put(space - slots * length, (first, take))
            if take < many:
                put(space, (first + take, many - take))
    return runs, containers


#: Pieces of one length that are ranked in one task.
RANKED = 1_000_000


def pack(docs: DataFrame, sizes: DataFrame, key: str = "doc_id", tokens: str = "tokens", ranked_at_once: int = RANKED) -> DataFrame:
    """One row per piece and container kind: container, container_id, key, piece, pieces, tokens.

    A document longer than the capacity is cut into pieces of the capacity and one rest; no other is
    cut. Documents of no tokens (or null) take no space and go to container 0. sizes holds container and
    capacity_tokens, one row a kind; kinds without a positive capacity have no rows. Repeated
    documents each take a slot; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    kinds = sizes.where("capacity_tokens > 0").groupBy("container").agg(F.max("capacity_tokens").alias("c")).collect()  # a handful of kinds
    each = F.array(*[F.struct(F.lit(r["container"]).alias("container"), F.lit(r["c"]).cast("long").alias("c")) for r in kinds])
    schema = f"container string, container_id bigint, {key} bigint, piece bigint, pieces bigint, tokens bigint"
    if not kinds:
        return spark.createDataFrame([], schema)
    cut = (
        docs.select(F.col(key).alias("k"), F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
        .select("k", "n", F.inline(each))
        .withColumn("pieces", F.greatest(F.ceil(F.col("n") / F.col("c")), F.lit(1)).cast("long"))
        .select("container", "c", "k", "n", "pieces", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
        .withColumn("length", F.least(F.col("c"), F.col("n") - F.col("piece") * F.col("c")))
        .select("container", "c", "k", "piece", "pieces", "length")
    )
    cut, _ = ws.write(cut, "pieces")
    # a length may hold a third of all rows: it is counted and ranked in as many salted parts as its rows need
    counted = cut.groupBy("container", "length").agg(F.count("*").alias("n"))  # at most capacity rows a kind
    counted, _ = ws.write(counted.select("container", "length", F.ceil(F.col("n") / ranked_at_once).cast("int").alias("salts")), "lengths")
    cut = cut.join(F.broadcast(counted), ["container", "length"]).withColumn("salt", F.pmod(F.xxhash64("k", "piece"), F.col("salts")).cast("int"))
    parts = cut.groupBy("container", "length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("container", "length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts, _ = ws.write(parts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))), "parts")
    histogram: dict = {}
    for r in parts.where("length > 0").groupBy("container", "length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows a kind
        histogram.setdefault(r["container"], {})[r["length"]] = r["n"]
    rows = [(r["container"], *run) for r in kinds for run in plan(histogram.get(r["container"], {}), r["c"])[0]]
    runs, seen = ws.write(spark.createDataFrame(rows, "container string, length bigint, r0 bigint, r1 bigint, first bigint, slots bigint"), "plan", n=F.count("*"))
    ranked = cut.join(parts.select("container", "length", "salt", "start"), ["container", "length", "salt"]).withColumn(
        "rank", F.col("start") + F.row_number().over(Window.partitionBy("container", "length", "salt").orderBy("k", "piece")) - 1
    )
    # the runs of a length are one after the other in rank: a piece finds its own by halving their starts
    spans = runs.groupBy("container", "length").agg(F.sort_array(F.collect_list(F.struct("r0", "r1", "first", "slots"))).alias("spans"))  # bounded by the capacity
    steps = "sequence(1, cast(ceil(log2(size(spans) + 1)) as int))"
    halve = "if(spans[(a.lo + a.hi + 1) div 2].r0 <= rank, named_struct('lo', cast((a.lo + a.hi + 1) div 2 as int), 'hi', a.hi), named_struct('lo', a.lo, 'hi', cast((a.lo + a.hi + 1) div 2 - 1 as int)))"
    at = F.expr(f"spans[aggregate({steps}, named_struct('lo', 0, 'hi', size(spans) - 1), (a, i) -> if(a.lo < a.hi, {halve}, a), a -> a.lo)]")
    return (
        ranked.join(F.broadcast(spans) if (seen["n"] or 0) <= 200_000 else spans, ["container", "length"], "left")
        .withColumn("s", F.when(F.col("spans").isNotNull(), at))
        .select("container", F.coalesce(F.col("s.first") + F.floor((F.col("rank") - F.col("s.r0")) / F.col("s.slots")), F.lit(0)).cast("long").alias("container_id"), F.col("k").alias(key), "piece", "pieces", F.col("length").alias("tokens"))
    )


def fill(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per kind: containers, pieces, tokens, unused tokens, share filled, and the containers no packing can do without."""
    used = packed.where("tokens > 0").groupBy("container", "container_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    per = used.groupBy("container").agg(F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    c = F.col("capacity_tokens")
    return per.join(sizes.groupBy("container").agg(F.max("capacity_tokens").alias("capacity_tokens")), "container").select(
        "container", "capacity_tokens", "containers", "pieces", "tokens", "fullest", (F.col("containers") * c - F.col("tokens")).alias("unused"),
        F.round(F.col("tokens") / (F.col("containers") * c), 6).alias("filled"), F.ceil(F.col("tokens") / c).alias("least_containers"),
    )
