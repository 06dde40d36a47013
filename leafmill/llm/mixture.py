"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed up by membership pattern (the set of sources that claim them).  A flow routes words from
patterns to source quotas; a pattern's first copy is free and each further copy costs more (convex), so
repetition spreads evenly.  What the flow routes from a pattern is then taken from its documents in a seeded
order: whole copies of all, one more copy of as many as fit.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import columns_of, count_words, stage, table

#: Patterns that may reach the driver; more is an error, not a cut: sources have to be grouped then.
MAX_PATTERNS = 50_000
#: Marginal cost of the first, second, third copy.
COPY_COSTS = (0, 1, 3)
#: Rows among which the one more copy is chosen one by one, about; and the most parts a pattern is cut into.
PART_ROWS, MAX_PARTS = 1000, 65_536


def filled(capacity: list[int], weights: list[int], total: int) -> list[Fraction]:
    """Shares of ``total`` by weight, none above its capacity, the excess shared out anew by weight."""
    share = [Fraction(0)] * len(capacity)
    open_ = sorted(range(len(capacity)), key=lambda i: Fraction(capacity[i], weights[i]))
    rest, weight = Fraction(total), sum(weights)
    while open_ and Fraction(capacity[open_[0]], weights[open_[0]]) < rest / weight:
        i = open_.pop(0)
        share[i] = Fraction(capacity[i])
        rest, weight = rest - capacity[i], weight - weights[i]
    for i in open_:
        share[i] = rest * weights[i] / weight
    return share


def routed(patterns: list[tuple[tuple, int]], quota: dict, costs: tuple[int, ...] = COPY_COSTS) -> list[dict]:
    """Words from each (members, size) to each member source: a flow of least cost among the largest ones.

    Patterns that no chain of common sources connects don't compete: each group of them is a flow of its own."""
    claims = defaultdict(list)
    for p, (members, _) in enumerate(patterns):
        for s in members:
            claims[s].append(p)
    flow: list[dict] = [{} for _ in patterns]
    seen: set[int] = set()
    for start in range(len(patterns)):
        if start in seen:
            continue
        seen.add(start)
        group = [start]
        for p in group:
            for s in patterns[p][0]:
                new = [q for q in claims.pop(s, ()) if q not in seen]
                seen.update(new)
                group += new
        own = sorted(group)
        for p, f in zip(own, least_cost([patterns[p] for p in own], quota, costs), strict=True):
            flow[p] = f
    return flow


def least_cost(patterns: list[tuple[tuple, int]], quota: dict, costs: tuple[int, ...]) -> list[dict]:
    """The flow of one group, by shortest augmenting paths on the graph of its patterns and sources."""
    claims = defaultdict(list)
    for p, (members, _) in enumerate(patterns):
        for s in members:
            claims[s].append(p)
    flow: list[dict] = [{} for _ in patterns]
    left = {s: quota[s] for s in claims if s in quota}
    turn = {s: i for i, s in enumerate(claims)}  # sources may be null: ties in the heap go by their numbers
    used = [0] * len(patterns)
    todo = [p for p in range(len(patterns)) if patterns[p][1] > 0]
    while True:
        # from every pattern at the price of its next copy; along a flow backwards words can be moved over
        heap: list = []
        for p in todo:
            copy = used[p] // patterns[p][1]
            if copy < len(costs):
                heapq.heappush(heap, (costs[copy], 0, p, p, None))
        seen: dict = {}
        goal = None
        while heap:
            cost, kind, _, node, before = heapq.heappop(heap)
            if (kind, node) in seen:
                continue
            seen[kind, node] = before
            if kind == 1 and left.get(node, 0) > 0:
                goal = (kind, node)
                break
            if kind == 0:
                for s in patterns[node][0]:
                    if (1, s) not in seen and s in left:
                        heapq.heappush(heap, (cost, 1, turn[s], s, (kind, node)))
            else:
                for p in claims[node]:
                    if (0, p) not in seen and flow[p].get(node, 0) > 0:
                        heapq.heappush(heap, (cost, 0, p, p, (kind, node)))
        if goal is None:
            return flow
        path = [goal]
        while seen[path[-1]] is not None:
            path.append(seen[path[-1]])
        first = path[-1][1]
        room = patterns[first][1] * (used[first] // patterns[first][1] + 1) - used[first]
        amount = min([room, left[goal[1]]] + [flow[p][s] for (k, p), (_, s) in zip(path, path[1:]) if k == 0])
        for (k, a), (_, b) in zip(path, path[1:]):  # from the end: source a got it from pattern b, or pattern a gave up source b
            if k == 1:
                flow[b][a] = flow[b].get(a, 0) + amount
            else:
                flow[a][b] -= amount
        used[first] += amount
        left[goal[1]] -= amount


@dataclass(frozen=True)
class Plan:
    """What reached the driver and what was decided there: a row per pattern and per source."""

    sizes: dict
    targets: dict
    takes: dict


def plan(slim: DataFrame, weights: tuple[int, ...], max_copies: int) -> Plan:
    """Sources in code-point order, null last, weigh ``weights`` in turn; together they get all words."""
    rows = slim.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns: group the sources first")
    patterns = sorted(((tuple(r.pattern), r["size"], r.n) for r in rows), key=lambda x: [(s is None, s or "") for s in x[0]])
    sizes: dict = defaultdict(int)
    for members, size, _ in patterns:
        for s in members:
            sizes[s] += size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    share = filled([max_copies * sizes[s] for s in names], [weights[i % len(weights)] for i in range(len(names))], sum(p[1] for p in patterns))
    targets = dict(zip(names, share, strict=True))
    costs = COPY_COSTS[:max_copies] + tuple(2 ** (k + 1) for k in range(len(COPY_COSTS), max_copies))
    flows = routed([(m, s) for m, s, _ in patterns], {s: int(t) for s, t in targets.items()}, costs)
    takes = {m: (sum(f.values()), size, n) for (m, size, n), f in zip(patterns, flows, strict=True)}
    return Plan(dict(sizes), {s: float(t) for s, t in targets.items()}, takes)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_copies: int = 3, seed: int = 7) -> DataFrame:
    """A row per row of ``docs`` (doc_id, size, sources: array of string): doc_id, size, sources, ``copies``,
    ``taken`` (copies times size, words), and ``source_size`` and ``target`` of the first of its sources.

    A null source is a source of its own, an empty or null array counts as [null].  A pattern's words come
    within its smallest passed-over document of what was routed.  Documents without words get no copies.
    Repeated rows count each.  The order is a hash of seed and doc_id, so reruns agree.  No rows, no result."""
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce(F.when(F.size("sources") > 0, F.array_sort(F.array_distinct("sources"))), F.array(F.lit(None).cast("string"))).alias("pattern"))
    slim = stage(d.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id")), "sizes")
    p = plan(slim, weights, max_copies)
    rows = []
    for members, (take, size, n) in p.takes.items():
        whole = take // size if size else 0
        first = members[0]
        rows.append((list(members), whole, take - whole * size, max(1, min(MAX_PARTS, -(-n // PART_ROWS))), p.sizes[first], p.targets[first]))
    kind = "pattern array<string>, whole long, more long, parts int, source_size long, target double"
    plans = F.broadcast(spark.createDataFrame(rows, kind))  # at most MAX_PATTERNS rows
    same = F.to_json("pattern")  # tells a null source from any text
    d = slim.withColumn("_key", same).join(plans.withColumn("_key", same).drop("pattern"), "_key")
    d = d.withColumn("_part", F.pmod("_h", F.col("parts")).cast("int"))
    # words before each part of a pattern, in the order of parts: only the part in which `more` ends is looked into
    parts = d.where("more > 0").groupBy("_key", "_part").agg(F.sum("size").alias("_sum"), F.first("more").alias("_more"))
    order = Window.partitionBy("_key").orderBy("_part")
    ends = parts.withColumn("_to", F.sum("_sum").over(order)).select("_key", "_part", (F.col("_more") - F.col("_to") + F.col("_sum")).alias("_room"), "_sum")
    d = d.join(ends, ["_key", "_part"], "left")
    all_, none = F.col("_room") >= F.col("_sum"), F.coalesce("_room", F.lit(0)) <= 0
    fixed = d.where(F.coalesce(all_, F.lit(False)) | none).withColumn("_one", F.when(none, 0).otherwise(1))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_h", "doc_id", "size"], kind="stable")
        room, one = int(part["_room"].iloc[0]), []
        for size in part["size"].tolist():
            one.append(int(size <= room))
            room -= size * one[-1]
        return part.assign(_one=one)

    split = d.where(~(F.coalesce(all_, F.lit(False)) | none)).withColumn("_one", F.lit(0))
    split = split.groupBy("_key", "_part").applyInPandas(fit, split.schema)
    out = fixed.unionByName(split).withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("_one")).otherwise(0).cast("long"))
    return out.select("doc_id", "size", F.col("pattern").alias("sources"), "copies", (F.col("copies") * F.col("size")).alias("taken"), "source_size", "target")


def op2_mixing(spark, sf_dir):
    d = columns_of(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", source="source")
    out = mix(d.select("doc_id", count_words(F.col("text")).alias("size"), F.array("source").alias("sources")))
    return out.select("doc_id", "size", "source_size", "target", "taken")
