"""Approximate nearest neighbours: low-dimensional stable projections in kd-trees, stopped by a chi-square test.

Vectors get one more component that makes all norms equal, so that the largest inner product is the nearest
vector.  Gaussian projections to a few dimensions keep distances in distribution: projected over true distance,
squared, is chi-square.  A top tree, fitted on a bounded sample, cuts the projected space into cells; every row
goes to its cell, and a cell that is too full is dealt into several blocks.  A block is one packed row with a
kd-tree of its own.

A query first searches its own cell, which bounds the distance of its k-th neighbour, and then every other
block that the test doesn't rule out.  Inside a block leaves come nearest first by projected distance, and
their points are verified on the original vectors unless the test holds for their leaf or for the point itself: its projected
distance is so long that a true neighbour at the k-th distance would project there with a probability of at most ``1 - p``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import columns_of, stage, table

#: Rows in a block, points in a leaf, rows the top tree is fitted on, queries in a packed row, queries that meet a leaf at a time.
BLOCK, LEAF, SAMPLE, PACK, SLICE = 8192, 128, 20_000, 1024, 256


def chi_square_quantile(p: float, dims: int) -> float:
    """By bisection on the series of the lower incomplete gamma function."""

    def below(x: float) -> float:
        a, x = dims / 2, x / 2
        term = total = 1 / a
        k = a
        while term > total * 1e-12:
            k += 1
            term *= x / k
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))

    low, high = 1e-9, 40.0 * dims
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def projection(dims: int, to: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims + 1, to))


def kd_cells(points: np.ndarray, leaf: int) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Order of the points, leaves as ranges of it, and the leaves' boxes.  Equal points share a leaf or
    fill several: the cut is by rank, so a leaf never holds more than ``leaf`` points."""
    order, ranges, todo = np.arange(len(points)), [], [(0, len(points))]
    while todo:
        a, b = todo.pop()
        if b - a <= leaf:
            ranges.append((a, b))
            continue
        own = points[order[a:b]]
        axis = int(np.argmax(own.max(0) - own.min(0)))
        m = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[:, axis], m)]
        todo += [(a + m, b), (a, a + m)]
    low = np.array([points[order[a:b]].min(0) for a, b in ranges])
    high = np.array([points[order[a:b]].max(0) for a, b in ranges])
    return order, ranges, low, high


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each query to each box."""
    out = np.zeros((len(q), len(low)))
    for i in range(q.shape[1]):
        out += np.maximum(np.maximum(low[:, i] - q[:, i : i + 1], q[:, i : i + 1] - high[:, i]), 0) ** 2
    return out


class Index:
    """What tasks need besides the blocks: projection, longest squared norm, cells of the top tree."""

    def __init__(self, dims: int, to: int, seed: int, norm2: float, sample: np.ndarray, cells: int):
        self.matrix, self.norm2, self.dims = projection(dims, to, seed), norm2, dims
        self.cuts: list[tuple[int, float, int, int]] = []  # axis, cut, left, right; below 0: cell -1 - n
        self.cells = 0
        self._grow(self.project(sample, True) if len(sample) else np.zeros((0, to)), max(1, cells))

    def _grow(self, points: np.ndarray, cells: int) -> int:
        if cells <= 1 or len(points) < 2 or (spread := points.max(0) - points.min(0)).max() == 0:
            self.cells += 1
            return -self.cells
        axis = int(np.argmax(spread))
        cut = float(np.median(points[:, axis]))
        at = len(self.cuts)
        self.cuts.append((axis, cut, 0, 0))
        left = points[:, axis] < cut
        if not left.any():
            left = points[:, axis] <= cut
        pair = self._grow(points[left], cells // 2), self._grow(points[~left], cells - cells // 2)
        self.cuts[at] = (axis, cut, *pair)
        return at

    def project(self, x: np.ndarray, stored: bool) -> np.ndarray:
        out = x @ self.matrix[: self.dims]
        if stored:
            out += np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0))[:, None] * self.matrix[self.dims]
        return out

    def cell(self, points: np.ndarray) -> np.ndarray:
        out = np.empty(len(points), np.int64)
        todo = [(0 if self.cuts else -1, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                out[rows] = -1 - at
            else:
                axis, cut, left, right = self.cuts[at]
                low = points[rows, axis] < cut
                todo += [(left, rows[low]), (right, rows[~low])]
        return out


def unpack(b: bytes, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b, kind).reshape(-1, width)


def search(ids: np.ndarray, own: np.ndarray, x: np.ndarray, index: Index, skip: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The best k of one block for each query that may have any: places of queries, ids, inner products; and how many
    pairs were verified on the original vectors.

    ``bound``: inner product of the k-th neighbour known so far (-inf: none); a row whose ``own`` is a query's ``skip`` is left out."""
    points, at = index.project(x, True), index.project(q, False)
    order, ranges, low, high = kd_cells(points, LEAF)
    x, ids, own, points = x[order], ids[order], own[order], points[order]
    away = box_distance(at, low, high)
    norm2 = (q * q).sum(1)
    reach = lambda rows, s: limit * np.maximum(index.norm2 + norm2[rows] - 2 * s, 0)  # noqa: E731  squared projected distance at which the test holds
    visits = np.argsort(away, axis=1, kind="stable")
    best = np.full((len(q), k), -np.inf)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max)
    live, verified = np.arange(len(q)), 0
    for step in range(len(ranges)):
        leaf = visits[live, step]
        kth = np.maximum(best[live, k - 1], bound[live])
        live_on = np.isneginf(kth) | (away[live, leaf] <= reach(live, kth))
        live, leaf = live[live_on], leaf[live_on]
        if not len(live):
            break
        by = np.argsort(leaf, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(leaf[by]) > 0])
        ends = np.r_[starts[1:], len(by)]
        for s, e in ((i, min(i + SLICE, e)) for s, e in zip(starts, ends, strict=True) for i in range(s, e, SLICE)):
            rows = live[by[s:e]]
            a, b = ranges[leaf[by[s]]]
            kth = np.maximum(best[rows, k - 1], bound[rows])
            near = box_distance(at[rows], points[a:b], points[a:b])
            open_ = (np.isneginf(kth)[:, None] | (near <= reach(rows, kth)[:, None])) & (own[None, a:b] != skip[rows, None])
            i, j = np.nonzero(open_)
            verified += len(i)
            score = np.full(open_.shape, -np.inf)
            score[i, j] = np.einsum("nd,nd->n", q[rows[i]], x[a + j])
            better = score.max(1) >= best[rows, k - 1]
            rows, score = rows[better], score[better]
            if not len(rows):
                continue
            merged = np.concatenate([best[rows], score], axis=1)
            names = np.concatenate([best_id[rows], np.broadcast_to(ids[a:b], score.shape)], axis=1)
            top = np.lexsort((names, -merged), axis=1)[:, :k]
            best[rows], best_id[rows] = np.take_along_axis(merged, top, 1), np.take_along_axis(names, top, 1)
    who, col = np.nonzero(~np.isneginf(best) & (best >= bound[:, None]))  # what is below the known k-th can't be among them
    return who, best_id[who, col], best[who, col], verified


def nearest(vectors: DataFrame, queries: DataFrame | Column, k: int = 20, dims: int | None = None, to: int = 16, p: float = 0.95, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query among ``vectors`` (both:
    vec_id, embedding), itself left out.

    ``queries`` as a condition on ``vec_id``: those rows of ``vectors``, each against every row but itself.  As a table: rows of their
    own, against every row of another id.  Results are by row, so repeated ids give a list each.

    Vectors that are null, zero, of another length than ``dims`` (left out: the most frequent one, of equals the
    smallest) or hold null or non-finite components take no part, as rows or as queries.  Equal scores go by smaller vec_id.
    Fewer candidates than k: all of them.  No rows: no result."""
    spark = vectors.sparkSession
    if dims is None:
        lengths = columns_of(vectors, embedding="embedding").where("size(embedding) > 0").groupBy(F.size("embedding").alias("n")).count()
        row = lengths.orderBy(F.col("count").desc(), "n").first()
        dims = row.n if row else 1
    x = usable(vectors, dims)
    n, norm2 = x.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    # a bounded sample, the same at every run: the smallest hashes
    share = min(1.0, 2 * SAMPLE / n)
    near = x.where(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "vec_id"), 11) <= int(share * 2**53)).orderBy(F.xxhash64(F.lit(seed), "vec_id")).limit(SAMPLE)
    sample = np.array([r.v for r in near.select("v").collect()], dtype=float).reshape(-1, dims)
    index = spark.sparkContext.broadcast(Index(dims, to, seed, norm2 * (1 + 1e-12), sample, math.ceil(n / BLOCK)))
    limit = chi_square_quantile(p, to)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        i = index.value
        for b in batches:
            v = np.stack(b["v"].to_numpy()) if len(b) else np.zeros((0, dims))
            yield pd.DataFrame({"vec_id": b["vec_id"], "cell": i.cell(i.project(v, True)), "vector": [r.tobytes() for r in v.astype("<f8")]})

    # written with a number a row, which stays the same from here on
    rows = stage(x.mapInPandas(placed, "vec_id long, cell long, vector binary").withColumn("key", F.monotonically_increasing_id()), "placed")
    by_row = not isinstance(queries, DataFrame)
    counts = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))  # a row per cell of the top tree
    dealt = rows.join(counts, "cell").withColumn("part", F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.col("parts")).cast("int"))

    def packed(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["vec_id", "key"], kind="stable")
        i = index.value
        points = i.project(unpack(b"".join(b["vector"]), dims, "<f8"), True)
        return pd.DataFrame([{"cell": b["cell"].iloc[0], "part": b["part"].iloc[0], "ids": b["vec_id"].to_numpy("<i8").tobytes(), "keys": b["key"].to_numpy("<i8").tobytes(), "matrix": b"".join(b["vector"]), "low": points.min(0).tobytes(), "high": points.max(0).tobytes()}])

    blocks = stage(dealt.groupBy("cell", "part").applyInPandas(packed, "cell long, part int, ids binary, keys binary, matrix binary, low binary, high binary"), "blocks")
    # cells are at most as many as sampled rows, so the table of their boxes has a bound
    boxes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in cell_boxes(blocks, to):
        boxes[r.cell] = np.frombuffer(r.low), np.frombuffer(r.high)
    names = np.array(sorted(boxes))
    spans = spark.sparkContext.broadcast((names, np.array([boxes[c][0] for c in names]), np.array([boxes[c][1] for c in names])))

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        i = index.value
        for b in batches:
            if len(b):
                v = np.stack(b["v"].to_numpy())
                yield pd.DataFrame({"query_id": b["vec_id"], "cell": i.cell(i.project(v, True)), "query": [r.tobytes() for r in v.astype("<f8")], "bound": np.nan})

    def routes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        i, (cells, low, high) = index.value, spans.value
        for batch in batches:
            for s in range(0, len(batch), 256):  # a few queries against all cells at a time
                b = batch.iloc[s : s + 256]
                q, bound = unpack(b"".join(b["query"]), dims, "<f8"), b["bound"].to_numpy(float)
                reach = np.where(np.isnan(bound), np.inf, limit * np.maximum(i.norm2 + (q * q).sum(1) - 2 * bound, 0))
                near = (box_distance(i.project(q, False), low, high) <= reach[:, None]) & (cells[None, :] != b["cell"].to_numpy()[:, None])
                who, which = np.nonzero(near)
                same = {c: b[c].to_numpy()[who] for c in ("key", "query_id", "skip")}
                yield pd.DataFrame(same | {"cell": cells[which], "query": b["query"].to_numpy()[who], "bound": bound[who]})

    def run(qs: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or block.empty:
            return pd.DataFrame({"key": [], "query_id": [], "vec_id": [], "score": []}).astype(dict.fromkeys(("key", "query_id", "vec_id"), "int64"))
        key, qid, skip, bound = *(qs[c].to_numpy(np.int64) for c in ("key", "query_id", "skip")), qs["bound"].to_numpy(float)
        ids, keys = (unpack(block[c].iloc[0], 1, "<i8")[:, 0] for c in ("ids", "keys"))
        x = unpack(block["matrix"].iloc[0], dims, "<f8")
        who, got, score, _ = search(ids, keys if by_row else ids, x, index.value, skip, unpack(b"".join(qs["query"]), dims, "<f8"), np.where(np.isnan(bound), -np.inf, bound), k, limit)
        return pd.DataFrame({"key": key[who], "query_id": qid[who], "vec_id": got, "score": score})

    def found(visits: DataFrame) -> DataFrame:
        """Searches (cell, query) visits; at most PACK queries, about, meet one block at a time."""
        packs = visits.groupBy("cell").agg(F.ceil(F.count("*") / PACK).cast("int").alias("packs"))
        q = visits.join(packs, "cell").withColumn("pack", F.pmod(F.xxhash64("key"), F.col("packs")).cast("int"))
        q = q.join(counts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        b = blocks.select("cell", "part", "ids", "keys", "matrix").join(packs, "cell").withColumn("pack", F.explode(F.sequence(F.lit(0), F.col("packs") - 1)))
        by = ["cell", "part", "pack"]
        return q.select(*by, "key", "query_id", "skip", "query", "bound").groupBy(*by).cogroup(b.select(*by, "ids", "keys", "matrix").groupBy(*by)).applyInPandas(run, "key long, query_id long, vec_id long, score double")

    def best(of: DataFrame) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id")))
        return of.groupBy("key", "query_id").agg(F.slice(ordered, 1, k).alias("best"))

    visit = "key long, query_id long, skip long, cell long, query binary, bound double"
    if by_row:
        asked = rows.where(queries).select("key", F.col("vec_id").alias("query_id"), F.col("key").alias("skip"), "cell", F.col("vector").alias("query"), F.lit(float("nan")).alias("bound"))
    else:
        asked = usable(queries, dims).mapInPandas(homes, "query_id long, cell long, query binary, bound double")
        asked = stage(asked.select(F.monotonically_increasing_id().alias("key"), "query_id", F.col("query_id").alias("skip"), "cell", "query", "bound"), "asked")
    first = stage(found(asked), "home")  # the k best of each query's own cell, a row each
    bound = best(first).select("key", F.when(F.size("best") == k, -F.get("best", F.lit(k - 1))["less"]).alias("bound"))
    onward = asked.drop("bound").join(bound, "key", "left").select("key", "query_id", "skip", "cell", "query", "bound").mapInPandas(routes, visit)
    out = best(first.unionByName(found(onward))).select("query_id", F.posexplode("best").alias("rank", "b"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.less")).alias("score"))


def cell_boxes(blocks: DataFrame, to: int) -> list:
    """A row per cell: the box around its blocks."""

    def joined(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"cell": b["cell"].iloc[0], "low": unpack(b"".join(b["low"]), to, "<f8").min(0).tobytes(), "high": unpack(b"".join(b["high"]), to, "<f8").max(0).tobytes()}])

    return blocks.select("cell", "low", "high").groupBy("cell").applyInPandas(joined, "cell long, low binary, high binary").collect()


def usable(df: DataFrame, dims: int) -> DataFrame:
    """vec_id and ``v`` (array of double) of the vectors that take part."""
    d = columns_of(df, vec_id="vec_id", embedding="embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return d.where(F.col("v").isNotNull() & (F.size("v") == dims) & F.forall("v", fine) & F.exists("v", lambda x: x != 0))


def op4_nearest_neighbours(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings")
    return nearest(x, F.col("vec_id") % 20 == 0)
