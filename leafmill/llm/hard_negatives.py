"""Hard-negative mining with a multiway hyperplane tree whose split points keep distance ranges to sibling subtrees.

Vectors of integers get one more component that makes all norms equal, so inner products and distances order alike, and a
window of scores is an annulus around the anchor.  A node of the tree has several split points; a point belongs to the
nearest.  Each split point stores the least and greatest distance to the points of every sibling's subtree.  By the triangle
inequality a subtree can only hold points of an annulus if, for all split points, that range meets the range of distances
which the annulus allows.

The top of the tree is fitted on a bounded sample, but every row goes down it, and its ranges are taken over all rows.  A leaf
of the top is a cell; one that is too full is dealt into several blocks, each with a tree of its own.  Leaves are searched
exactly, in integers.  An anchor searches its own cell first, which gives a bound, and then the cells that remain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import columns_of, stage, table

#: Rows in a block, rows in a leaf, split points of a node, rows the top is fitted on, least sampled rows in a cell, anchors that
#: meet a block at once.
BLOCK, LEAF, WAYS, SAMPLE, LEAST, PACK = 8192, 256, 12, 20_000, 24, 1024
#: Squared norms from here on take no part: scores could leave 64-bit integers.
TOO_LONG = 2.0**55
NONE = np.iinfo(np.int64).min
#: Stands for a null id inside the search, so that null comes last among equal scores.
NULL_ID = np.iinfo(np.int64).max


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


class Tree:
    """Nodes: (split points, least and greatest distances [split point, child], children); a child below 0 is leaf -1 - n."""

    def __init__(self, points: np.ndarray, leaf: int, ways: int = WAYS):
        self.nodes: list[list] = []
        self.leaves: list[np.ndarray] = []
        self.root = self._grow(points, np.arange(len(points)), leaf, ways, 0)

    def _grow(self, points: np.ndarray, rows: np.ndarray, leaf: int, ways: int, depth: int) -> int:
        splits = self._split_points(points[rows], ways) if len(rows) > leaf and depth < 24 else []
        if len(splits) < 2:
            self.leaves.append(rows)
            return -len(self.leaves)
        d = distances(points[rows], splits)
        child = d.argmin(1)
        at = len(self.nodes)
        self.nodes.append([splits, *(np.array([f(d[child == j], 0) for j in range(len(splits))]).T for f in (np.min, np.max)), []])
        self.nodes[at][3] = [self._grow(points, rows[child == j], leaf, ways, depth + 1) for j in range(len(splits))]
        return at

    @staticmethod
    def _split_points(points: np.ndarray, ways: int) -> np.ndarray:
        """Points far from each other, one after the other; none twice."""
        chosen = [int(((points - points.mean(0)) ** 2).sum(1).argmax())]
        far = distances(points, points[chosen])[:, 0]
        while len(chosen) < ways and far.max() > 1e-6 * (1 + abs(points).max()):
            chosen.append(int(far.argmax()))
            far = np.minimum(far, distances(points, points[chosen[-1:]])[:, 0])
        return points[chosen]

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(points), np.int64), [(self.root, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                out[rows] = -1 - at
                continue
            child = distances(points[rows], self.nodes[at][0]).argmin(1)
            todo += [(kid, rows[child == j]) for j, kid in enumerate(self.nodes[at][3])]
        return out

    def paths(self) -> dict[int, list[tuple[int, int]]]:
        """Of each leaf: the nodes above it, each with the child that leads there."""
        out, todo = {}, [(self.root, [])]
        while todo:
            at, path = todo.pop()
            if at < 0:
                out[-1 - at] = path
            else:
                todo += [(kid, [*path, (at, j)]) for j, kid in enumerate(self.nodes[at][3])]
        return out

    def intervals(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance to the points of each leaf that the ranges allow, by query and leaf."""
        low, high = np.zeros((len(q), len(self.leaves))), np.full((len(q), len(self.leaves)), np.inf)
        todo = [(self.root, np.zeros(len(q)), np.full(len(q), np.inf))]
        while todo:
            at, a, b = todo.pop()
            if at < 0:
                low[:, -1 - at], high[:, -1 - at] = a, b
                continue
            splits, least, most, kids = self.nodes[at]
            d = distances(q, splits)
            for j, kid in enumerate(kids):
                todo.append((kid, np.maximum(a, np.maximum(d - most[:, j], least[:, j] - d).max(1)), np.minimum(b, (d + most[:, j]).min(1))))
        return low, high


class Space:
    """Integer vectors as points of equal norm, and scores from distances."""

    def __init__(self, dims: int, norm2: float):
        self.dims, self.norm2 = dims, norm2
        self.exact = norm2 < 2**53  # float products are exact up to here

    def vectors(self, packed: list[bytes]) -> np.ndarray:
        """Shorter vectors are filled up with zeros."""
        return np.frombuffer(b"".join(p.ljust(8 * self.dims, b"\0") for p in packed), "<i8").reshape(-1, self.dims)

    def stored(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.c_[x, np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0))]

    def asked(self, q: np.ndarray) -> np.ndarray:
        return np.c_[q.astype(float), np.zeros(len(q))]

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64) if self.exact else q @ x.T

    def score_bounds(self, tree: Tree, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that each leaf may hold for each query, with room for rounding."""
        low, high = tree.intervals(self.asked(q))
        sum2 = self.norm2 + (q.astype(float) ** 2).sum(1)[:, None]
        slack = 1 + 1e-6 * sum2
        return (sum2 - high**2) / 2 - slack, (sum2 - low**2) / 2 + slack


class Best:
    """The k highest scores of each row, of equals those with smaller ids; takes scores leaf by leaf."""

    def __init__(self, n: int, k: int, known: np.ndarray):
        self.k, self.least = k, known.copy()  # what a score must reach to matter
        self.top = np.full((n, k), NONE)
        self.found: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def take(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        """Scores of some rows against some points; NONE where they don't count."""
        r, c = np.nonzero((score >= self.least[rows][:, None]) & (score > NONE))
        if not len(r):
            return
        self.found.append((rows[r], score[r, c], ids[c], keys[c]))
        self.size += len(r)
        hit = np.unique(r)
        both = np.concatenate([self.top[rows[hit]], score[hit]], axis=1)
        self.top[rows[hit]] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        self.least[rows[hit]] = np.maximum(self.least[rows[hit]], self.top[rows[hit]].min(1))
        if self.size > 64 * len(self.top) + 10_000:
            self.found = [self.result()]
            self.size = len(self.found[0][0])

    def result(self) -> tuple[np.ndarray, ...]:
        if not self.found:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        row, score, ids, keys = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((keys, ids, -score, row))
        row, score, ids, keys = row[order], score[order], ids[order], keys[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        return row[keep], score[keep], ids[keep], keys[keep]


def search(space: Space, block: pd.Series, asks: pd.DataFrame, k: int, negatives: bool) -> pd.DataFrame:
    """What one block gives to some anchors.  Positives: the k best of the anchor's label; negatives: for each of its windows
    [low, high] the k best of other labels.  ``known``: scores that others have reached already, per window."""
    x, ids = space.vectors([block["matrix"]]), np.frombuffer(block["ids"], "<i8")
    keys, labels = np.frombuffer(block["keys"], "<i8"), np.frombuffer(block["labels"], "<i8")
    q, key, label = space.vectors(asks["vector"].tolist()), asks["key"].to_numpy(np.int64), asks["label"].to_numpy(np.int64)
    tree = Tree(space.stored(x), LEAF)
    low_s, high_s = space.score_bounds(tree, q)
    known = np.stack(asks["known"].to_numpy()).astype(np.int64)
    high = np.stack(asks["high"].to_numpy()).astype(np.int64)
    best = [Best(len(q), k, known[:, w]) for w in range(known.shape[1])]
    for leaf in np.argsort(-high_s.max(0)):
        own = tree.leaves[leaf]
        open_ = np.stack([(high_s[:, leaf] >= b.least) & (low_s[:, leaf] <= high[:, w]) for w, b in enumerate(best)], 1)
        rows = np.flatnonzero(open_.any(1))
        if not len(rows):
            continue
        score = space.scores(q[rows], x[own])
        same = label[rows][:, None] == labels[own]
        score[same if negatives else ~same | (key[rows][:, None] == keys[own])] = NONE
        for w, b in enumerate(best):
            on = open_[rows, w]
            if on.any():
                part = score[on]
                b.take(rows[on], np.where(part <= high[rows[on], w][:, None], part, NONE), ids[own], keys[own])
    parts = [(np.full(len(r[0]), w), *r) for w, b in enumerate(best) if len((r := b.result())[0])]
    which, row, score, got, at = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 5
    return pd.DataFrame({"key": key[row], "which": which, "score": score, "vec_id": got, "found": at})


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives among ``vectors`` for the rows
    ``anchors`` (a Column: which of them are anchors); vec_id, label and ``vector`` (array of long) are read.

    An anchor's positives are the ``positives`` rows of its label with the largest inner products, itself (that row, not
    its id) left out; a positive's negatives the first ``negatives`` rows of other labels whose score lies between
    ``percent`` of the positive's.  Equal scores go by smaller id, a null id last.  Fewer rows than asked for: all.
    Rows without a label or vector, or with a null component, take no part, nor do squared norms of 2**55 and more.
    Shorter vectors count as filled up with zeros.  Repeated ids are rows of their own.  No rows: no result.  The id
    2**63 - 1 counts as null."""
    spark = vectors.sparkSession
    rows = vectors.withColumn("_asks", F.coalesce(anchors, F.lit(False)))
    rows = columns_of(rows, vec_id="vec_id", label="label", vector="vector", asks="_asks")
    norm2 = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda v: v.isNotNull())
    rows = rows.where(usable).withColumn("norm2", norm2).where(F.col("norm2") < TOO_LONG)
    # written, so that the keys are the same wherever they are read
    rows = stage(rows.select(F.monotonically_increasing_id().alias("key"), F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("vec_id"), F.col("label").cast("long").alias("label"), "vector", "asks", "norm2"), "rows")
    n, longest, dims = rows.agg(F.count("*"), F.max("norm2"), F.max(F.size("vector"))).first()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    space = Space(max(1, dims), longest)
    # a bounded sample, the same at every run: the smallest hashes
    h = F.xxhash64(F.lit(7), "vec_id", "key")
    some = rows.where(F.shiftrightunsigned(h, 11) <= int(min(1.0, 2 * SAMPLE / n) * 2**53)).orderBy(h).limit(SAMPLE).select("vector").collect()
    sample = space.stored(space.vectors([np.array(r.vector, "<i8").tobytes() for r in some]))
    top = Tree(sample, max(LEAST, len(sample) * BLOCK // n))
    cells = spark.sparkContext.broadcast((space, top, top.paths()))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, top, _ = cells.value
        for b in batches:
            packed = [np.asarray(v, "<i8").tobytes() for v in b["vector"]]
            cell = top.leaf_of(space.stored(space.vectors(packed))) if len(b) else []
            yield pd.DataFrame({"key": b["key"], "vec_id": b["vec_id"], "label": b["label"], "asks": b["asks"], "cell": cell, "vector": packed})

    rows = stage(rows.mapInPandas(placed, "key long, vec_id long, label long, asks boolean, cell long, vector binary"), "placed")
    counts = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = rows.join(counts, "cell").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))

    def packed(b: pd.DataFrame) -> pd.DataFrame:
        space, top, paths = cells.value
        x = space.vectors(b["vector"].tolist())
        points = space.stored(x)
        spans = [distances(points, top.nodes[node][0]) for node, _ in paths[b["cell"].iloc[0]]]
        lo, hi = ([v for d in spans for v in f(d, 0).tolist()] for f in (np.min, np.max))
        whole = {c: b[n].to_numpy("<i8").tobytes() for c, n in (("keys", "key"), ("ids", "vec_id"), ("labels", "label"))}
        return pd.DataFrame([{"cell": b["cell"].iloc[0], "part": b["part"].iloc[0], **whole, "matrix": x.tobytes(), "lo": lo, "hi": hi}])

    blocks = stage(dealt.groupBy("cell", "part").applyInPandas(packed, "cell long, part int, keys binary, ids binary, labels binary, matrix binary, lo array<double>, hi array<double>"), "blocks")
    # ranges over all rows: as many numbers as the top has cells and nodes above them, so they have a bound
    spans = blocks.select("cell", F.posexplode(F.arrays_zip("lo", "hi")).alias("at", "r")).groupBy("cell", "at").agg(F.min("r.lo").alias("lo"), F.max("r.hi").alias("hi")).collect()
    filled = widened(top, spans, {r.cell for r in counts.collect()})
    cells = spark.sparkContext.broadcast((space, filled, filled.paths()))

    def routes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The other cells that may hold what an anchor still needs."""
        space, top, _ = cells.value
        for batch in batches:
            for s in range(0, len(batch), 256):
                b = batch.iloc[s : s + 256]
                q = space.vectors(b["vector"].tolist())
                low_s, high_s = space.score_bounds(top, q)
                known, high = (np.stack(b[c].to_numpy()).astype(float) for c in ("known", "high"))
                near = ((high_s[:, :, None] >= known[:, None, :]) & (low_s[:, :, None] <= high[:, None, :])).any(2)
                near[np.arange(len(b)), b["cell"].to_numpy()] = False
                who, which = np.nonzero(near)
                yield b.iloc[who].assign(cell=which)

    ask = "key long, label long, cell long, vector binary, known array<long>, high array<long>"
    hit = "key long, which int, score long, vec_id long, found long"

    def searched(asks: DataFrame, k: int, other_labels: bool) -> DataFrame:
        """A bounded number of anchors meets one block at a time."""
        packs = asks.groupBy("cell").agg(F.ceil(F.count("*") / PACK).cast("int").alias("packs"))
        a = asks.join(packs, "cell").withColumn("pack", F.pmod(F.xxhash64("key", F.lit(3)), F.col("packs")).cast("int")).join(counts, "cell")
        a = a.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "part", "pack", "key", "label", "vector", "known", "high")
        b = blocks.select("cell", "part", "keys", "ids", "labels", "matrix").join(packs, "cell").withColumn("pack", F.explode(F.sequence(F.lit(0), F.col("packs") - 1))).drop("packs")

        def run(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            if asked.empty or block.empty:
                return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("key", "which", "score", "vec_id", "found")})
            return search(cells.value[0], block.iloc[0], asked, k, other_labels)

        by = ["cell", "part", "pack"]
        found = a.groupBy(*by).cogroup(b.groupBy(*by)).applyInPandas(run, hit)
        return best(found, k)

    def best(found: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("key", "which").orderBy(F.col("score").desc(), "vec_id", "found")
        return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)

    def exact(asks: DataFrame, k: int, other_labels: bool, name: str) -> DataFrame:
        """The own cell first; what it gives bounds the search in all others."""
        first = stage(searched(asks, k, other_labels), f"{name}-home")
        kth = first.where(F.col("place") == k).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("which", "score"))).alias("kth"))
        more = asks.join(kth, "key", "left").withColumn("known", F.transform("known", lambda s, i: F.greatest(s, F.coalesce(F.col("kth")[i], s)))).select(*asks.columns)
        rest = searched(more.select("key", "label", "cell", "vector", "known", "high").mapInPandas(routes, ask), k, other_labels)
        return stage(best(first.drop("place").unionByName(rest.drop("place")), k), name)

    asked = rows.where("asks").select("key", "label", "cell", "vector", F.array(F.lit(NONE + 1)).alias("known"), F.array(F.lit(NULL_ID)).alias("high"))
    near = exact(asked, positives, False, "positives")
    low, high = percent
    scores = near.groupBy("key").agg(F.sort_array(F.collect_set("score")).alias("scores"))  # as many as positives at most
    # whole division towards minus infinity
    bounds = F.expr(f"transform(scores, s -> struct(-((-s * {low} - pmod(-s * {low}, 100)) div 100) as low, (s * {high} - pmod(s * {high}, 100)) div 100 as high))")
    windows = rows.where("asks").select("key", "label", "cell", "vector").join(scores, "key").withColumn("w", bounds)
    # as many windows for each anchor: empty ones fill up
    full = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v), F.lit(positives) - F.size("scores")))
    windows = windows.select("key", "label", "cell", "vector", full("w.low", NULL_ID).alias("known"), full("w.high", NONE + 1).alias("high"))
    hard = exact(windows, negatives, True, "negatives").select("key", "which", "place", F.col("score").alias("negative_score"), F.col("vec_id").alias("negative_id"))
    pairs = near.join(scores, "key").select("key", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.array_position("scores", F.col("score")) - 1).cast("int").alias("which"))
    names = rows.where("asks").select("key", F.col("vec_id").alias("anchor_id"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return pairs.join(hard, ["key", "which"]).join(names, "key").select(real("anchor_id"), real("positive_id"), F.col("place").alias("rank"), real("negative_id"), "positive_score", "negative_score")


def widened(top: Tree, spans: list, there: set[int]) -> Tree:
    """The top with its ranges taken over all rows instead of the sample."""
    paths, out = top.paths(), object.__new__(Tree)
    out.leaves, out.root = top.leaves, top.root
    out.nodes = [[s, np.full(lo.shape, np.inf), np.full(hi.shape, -np.inf), kids] for s, lo, hi, kids in top.nodes]
    place = {cell: [(node, child, i) for node, child in path for i in range(len(top.nodes[node][0]))] for cell, path in paths.items() if cell in there}
    for r in spans:
        node, child, i = place[r.cell][r.at]
        out.nodes[node][1][i, child] = min(out.nodes[node][1][i, child], r.lo)
        out.nodes[node][2][i, child] = max(out.nodes[node][2][i, child], r.hi)
    return out


def op11_hard_negatives(spark, sf_dir):
    """Labels of ids divisible by 7 are moved on by one first, components become floor(256 * x)."""
    x = table(spark, sf_dir, "embeddings")
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    x = x.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda v: F.floor(v.cast("double") * 256))
    return mine(x.select("vec_id", label.alias("label"), vector.alias("vector")), F.col("vec_id") % 50 == 0)
