"""Mixing sources to target weights, by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. A flow routes each pattern's words to its sources'
quotas; a first pass over a pattern's words is free, every further pass costs more (convex), up to ``passes`` passes.
Within a pattern, documents are then taken in a seeded order until its flow is met: whole documents, the last one if
that is nearer to the quota than leaving it out. The order is a hash of id and seed, found by counting it in three levels
of 4096 buckets, with sums in each task before they are shuffled, whatever a source's share of all rows.

The driver sees one row for each pattern (at most MAX_PATTERNS, else an error: the flow is the driver's), never documents.
Sources get weights in code point order, null last; a null source is a source. Null and empty texts have no words and are
not taken. Tickets are of id and text, so rows that share an id or have none are taken each by itself; only rows that are
the same in both are taken or left together. Columns size, source_size, target and taken of the input are replaced. An
empty table gives an empty result. Reruns agree.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import n_words, stored

MAX_PATTERNS = 5_000
WEIGHTS = (3, 1, 2)
BITS = 12
LEVELS = 3
TICKETS = 1 << (BITS * LEVELS)


def ticket(doc_id: Column, text: Column, seed: int = 7) -> Column:
    """36 bits that order documents."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}:"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def quotas(sizes: dict, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict:
    """Target of each source: share of all words by weight, none over ``most`` times its own size, the excess reshared by weight."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    pool, heavy = share * sum(sizes.values()), sum(w.values())
    out = {}
    for s in sorted(names, key=lambda s: (most * sizes[s] / w[s], names.index(s))):
        cap = most * sizes[s]
        if pool / heavy * w[s] <= cap:
            break
        out[s] = cap
        pool, heavy = pool - cap, heavy - w[s]
    return {s: out[s] if s in out else pool / heavy * w[s] for s in names}


def route(patterns: list[tuple[tuple, int]], demand: dict, passes: int = 2) -> list[list[int]]:
    """Words that each pass over each pattern gives, by successive cheapest paths: start, patterns, sources, end."""
    names = list(demand)
    start, end = 0, 1 + len(patterns) + len(names)
    graph: list[list[list]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, room: int, cost: int) -> list:
        there, back = [b, room, cost, len(graph[b])], [a, 0, -cost, len(graph[a])]
        graph[a].append(there)
        graph[b].append(back)
        return there

    at = {s: 1 + len(patterns) + i for i, s in enumerate(names)}
    supply = [[arc(start, 1 + i, size, k * k) for k in range(passes)] for i, (_, size) in enumerate(patterns)]
    for i, (members, size) in enumerate(patterns):
        for s in members:
            arc(1 + i, at[s], size * passes, 0)
    for s in names:
        arc(at[s], end, demand[s], 0)
    height = [0] * (end + 1)
    while True:
        far, came = [float("inf")] * (end + 1), [None] * (end + 1)
        far[start], heap = 0, [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in graph[a]:
                to = d + e[2] + height[a] - height[e[0]]
                if e[1] > 0 and to < far[e[0]]:
                    far[e[0]], came[e[0]] = to, (a, e)
                    heapq.heappush(heap, (to, e[0]))
        if came[end] is None:
            return [[size - a[1] for a in arcs] for (_, size), arcs in zip(patterns, supply, strict=True)]
        height = [h + (f if f < float("inf") else 0) for h, f in zip(height, far, strict=True)]
        room, v = None, end
        while v != start:
            a, e = came[v]
            room, v = e[1] if room is None else min(room, e[1]), a
        v = end
        while v != start:
            a, e = came[v]
            e[1] -= room
            graph[v][e[3]][1] += room
            v = a


def _select(sized: DataFrame, needs: DataFrame) -> DataFrame:
    """(pattern, pass, cut): tickets under the cut are taken in that pass. needs: (pattern, pass, need), need under the pattern's size."""
    from pyspark.sql import Window

    by = Window.partitionBy("pattern", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = needs.withColumn("prefix", F.lit(0).cast("long"))
    for level in range(LEVELS):
        low = BITS * (LEVELS - 1 - level)
        held = open_.select(F.col("pattern").alias("p"), "pass", "need", "prefix")
        # Two rows for each pattern at most.
        inside = sized.join(F.broadcast(held), (F.col("pattern") == F.col("p")) & (F.shiftright("ticket", low + BITS) == F.col("prefix")))
        sums = inside.groupBy("pattern", "pass", "need", "prefix", F.shiftright("ticket", low).alias("bucket")).agg(F.sum("size").alias("words"))
        run = sums.withColumn("upto", F.sum("words").over(by)).withColumn("before", F.col("upto") - F.col("words"))
        # The bucket in which the need is met.
        hit = run.filter((F.col("before") <= F.col("need")) & (F.col("need") < F.col("upto")))
        last = level == LEVELS - 1
        cut = F.when((F.col("need") - F.col("before")) * 2 >= F.col("words"), F.col("bucket") + 1).otherwise(F.col("bucket"))
        open_ = stored(hit.select("pattern", "pass", (F.col("need") - F.col("before")).alias("need"), (cut if last else F.col("bucket")).alias("prefix")), "mix")
    return open_.select("pattern", "pass", F.col("prefix").alias("cut"))


def mix(docs: DataFrame, sources: Column | None = None, text: str = "text", doc_id: str = "doc_id", weights: tuple = WEIGHTS, share: float = 1.5, passes: int = 2, seed: int = 7) -> DataFrame:
    """docs with size (words), source_size and target (of the first of its sources), and taken (words, passes counted).

    sources: array of the sources a document belongs to; by default the column ``source`` alone."""
    spark = docs.sparkSession
    members = F.array(F.col("source").cast("string")) if sources is None else F.sort_array(F.array_distinct(sources), asc=False)
    own = {"_members": members, "_size": n_words(F.col(text)), "_ticket": ticket(F.col(doc_id), F.col(text), seed)}
    rows = docs.withColumns(own).withColumn("_pattern", F.to_json("_members", {"ignoreNullFields": "false"}))
    sized = stored(rows.select(F.col("_pattern").alias("pattern"), F.col("_members").alias("members"), F.col("_size").alias("size"), F.col("_ticket").alias("ticket")), "sized")
    found = sized.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} membership patterns")
    found = sorted(found, key=lambda r: r["pattern"] or "")
    sizes: dict = {}
    for r in found:
        for s in r["members"] or []:
            sizes[s] = sizes.get(s, 0) + r["size"]
    targets = quotas(sizes, weights, share, float(passes)) if sizes else {}
    demand = {s: int(t + 0.5) for s, t in targets.items()}
    given = route([(tuple(r["members"] or []), r["size"]) for r in found], demand, passes)
    needs, whole, facts = [], [], []
    for r, flow in zip(found, given, strict=True):
        first = (r["members"] or [None])[0]
        facts.append((r["pattern"], sizes.get(first, 0), float(targets.get(first, 0.0))))
        for k, need in enumerate(flow):
            (whole if need >= r["size"] else needs).append((r["pattern"], k, need))
    cuts = spark.createDataFrame([(p, k, TICKETS) for p, k, n in whole if n], "pattern string, pass int, cut long")
    if needs:
        cuts = cuts.union(_select(sized.select("pattern", "ticket", "size"), spark.createDataFrame(needs, "pattern string, pass int, need long")))
    marks = cuts.groupBy("pattern").agg(F.collect_list("cut").alias("cuts"))
    table = spark.createDataFrame(facts, "pattern string, source_size long, target double").join(marks, "pattern", "left")
    table = table.select(F.col("pattern").alias("_p"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("cuts").alias("_cuts"))
    times = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<long>")), lambda c: F.col("_ticket") < c))
    # One row for each pattern, MAX_PATTERNS at most.
    out = rows.join(F.broadcast(table), F.col("_pattern") == F.col("_p"), "left").drop("size", "source_size", "target", "taken")
    named = {"size": F.col("_size"), "source_size": F.col("_source_size"), "target": F.col("_target"), "taken": (F.col("_size") * times).cast("long")}
    return out.withColumns(named).drop("_members", "_size", "_ticket", "_pattern", "_p", "_source_size", "_target", "_cuts")
