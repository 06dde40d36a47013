"""MinHash near-duplicates by an inverted join over signature coordinates.

A signature has ``COORDINATES`` minima.  Two documents of the required similarity agree, but for a chance of
about one in a million, in ``MATCHES`` of them at least, so they share one of the first COORDINATES - MATCHES + 1
(the prefix): only these are posted, under (coordinate, value).  A pair is looked at in the list of the first
coordinate it shares and skipped in all others.

- Texts with equal shingle sets are one class; only its smallest id is posted.
- Each document is first compared with the smallest documents of its lists (those it collides with most), which
  costs one or two pairs a document however long a list is, and joins most of a large group.
- What is left are lists whose documents are still in different components.  A long one of many components (a common line,
  say) is dealt out anew by a second shared coordinate, of which any pair has one in the prefix and the coordinate after it.
- Documents outside a list's largest component meet those of the list that have a fitting size, in blocks of bounded
  size; signatures are compared first, and only where pairs above the match threshold remain the texts follow, are
  compared exactly, and each block returns the links that join components - never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import columns_of, stage, table
from leafmill.llm.components import components
from leafmill.llm.shingles import mixed, shingle_sets

COORDINATES = 64
#: Documents of a list that meet in one block, and shingles that they have together.
BLOCK, BLOCK_SHINGLES = 2048, 1_500_000
#: Documents outside its largest component from which on a list is dealt out anew by a second coordinate: up to there
#: each of its rows meets that many others at most, beyond it a row goes to as many lists as there are coordinates.
OUTSIDE = 8 * BLOCK
#: Leaders that a document is compared with at first.
LEADERS = 2


def least_matches(similarity: float, coordinates: int = COORDINATES, sigmas: float = 4.75) -> int:
    """Fewest coordinates in which a pair of just this similarity agrees, but for about one in a million."""
    return max(1, math.floor(coordinates * similarity - sigmas * math.sqrt(coordinates * similarity * (1 - similarity))))


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """Minima of each set (none may be empty) under ``coordinates`` hash functions."""
    if not sets:
        return np.zeros((0, coordinates), np.uint32)
    all_, at = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    factors = mixed(np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    out = np.empty((len(sets), coordinates), np.uint32)
    for j, f in enumerate(factors):
        out[:, j] = np.minimum.reduceat(((all_ ^ (f >> np.uint64(3))) * f) >> np.uint64(32), at)
    return out


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, f1 and f2 (a fingerprint of the set), sig (the signature; null where the set is empty)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), 500):
                part = b.iloc[a : a + 500]
                sets = shingle_sets(part["text"].tolist(), k)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig: list = [None] * len(sets)
                for i, row in zip(full, signatures([sets[i] for i in full]), strict=True):
                    sig[i] = row.tobytes()
                print_ = [(int(s.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mixed(s)).view(np.int64))) if len(s) else (0, 0) for s in sets]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_shingles": [len(s) for s in sets], "f1": [p[0] for p in print_], "f2": [p[1] for p in print_], "sig": sig})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, n_shingles long, f1 long, f2 long, sig binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    same = int((large[at] == small).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)


def matches(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Coordinates in which each row of q agrees with each row of t."""
    if len(q) * len(t) <= 2048:
        return (q[:, None, :] == t[None, :, :]).sum(2)
    out = np.zeros((len(q), len(t)), np.int16)
    for c in range(q.shape[1]):
        out += q[:, c, None] == t[None, :, c]
    return out


def pairs_of(sig: np.ndarray, g: pd.DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs of one list that are above the threshold, in different components, and share no
    earlier coordinate (nor one between the two that a dealt out list stands for); with their matches.  Only rows that
    ask look for others; two rows of the upper size meet in another group."""
    label, asks, upper = g["label"].to_numpy(), g["asks"].to_numpy(), g["upper"].to_numpy()
    first, second = int(g["c"].iloc[0]), int(g["c2"].iloc[0])
    rows = np.flatnonzero(asks)
    q, t, n = [], [], []
    for a in range(0, len(rows), 256):
        own = rows[a : a + 256]
        m = matches(sig[own], sig)
        i, j = np.nonzero((m >= least) & (label[own, None] != label[None, :]) & ~(upper[own, None] & upper[None, :]))
        n.append(m[i, j])
        q.append(own[i])
        t.append(j)
    q, t, n = np.concatenate(q), np.concatenate(t), np.concatenate(n)
    ok = ~(asks[t] & (t < q))  # both ask: once
    for a, b in ((0, first), (first + 1, second)):
        if a < b:
            ok &= ~(sig[q, a:b] == sig[t, a:b]).any(1)
    return q[ok], t[ok], n[ok]


def by_group(keys: list[str], run: Callable[[pd.DataFrame], pd.DataFrame | None]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Whole groups from batches that are sorted by ``keys``; a group is at most a few thousand rows."""

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if b.empty:
                continue
            b = pd.concat([*held, b], ignore_index=True) if held else b.reset_index(drop=True)
            key = b[keys].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for s, e in zip(np.r_[0, cut[:-1]], cut, strict=True) if len(cut) else []:
                if e - s > 1 and (out := run(b.iloc[s:e])) is not None:
                    yield out
            held = [b.iloc[cut[-1] :] if len(cut) else b]
        if held and len(held[0]) > 1 and (out := run(held[0])) is not None:
            yield out

    return over


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    texts = docs.select("doc_id", "text")
    both = pairs.hint("merge").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 200):
                part = b.iloc[s : s + 200]
                distinct = {t: i for i, t in enumerate(dict.fromkeys([*part["ta"], *part["tb"]]))}
                sets = shingle_sets(list(distinct), k)
                ok = [similar(sets[distinct[x]], sets[distinct[y]], percent) for x, y in zip(part["ta"], part["tb"], strict=True)]
                yield part.loc[np.array(ok, bool), ["a", "b"]]

    return both.select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long")


def open_lists(p: DataFrame) -> DataFrame:
    """``p`` (c, v, c2, v2, doc_id, label, size, upper, n_shingles) of the lists with more than one component, with
    the list's rows (n), shingles (m), and largest component (top, n_top)."""
    key = ["c", "v", "c2", "v2", "size"]
    sizes = p.groupBy(*key, "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m"), F.max((~F.col("upper")).cast("int")).alias("lower")).groupBy(*key)
    lists = sizes.agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.count("*").alias("labels"), F.max("lower").alias("lower"), F.max(F.struct("n", "label")).alias("t"))
    return p.join(lists.where("labels > 1 and lower = 1").select(*key, "n", "m", F.col("t.label").alias("top"), F.col("t.n").alias("n_top")), key)


def unresolved(postings: DataFrame, labels: DataFrame, reps: DataFrame, prefix: int, percent: int) -> DataFrame:
    """Postings of lists with more than one component, dealt into groups (GROUP).

    Sets of which one is smaller than ``percent`` of the other can't be similar, so a list falls into classes of
    sizes: a group holds a class and, as upper rows, the next larger one.  A list with over OUTSIDE
    rows outside its largest component falls into those of a second coordinate (c2, v2).  Every document is once a target, those outside the largest component
    are in every block as asking ones."""
    p = postings.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    own = F.floor(F.log(F.col("n_shingles").cast("double")) / (math.log(100 / percent) * 1.0001)).cast("int")
    p = p.withColumn("own", own).withColumn("size", F.explode(F.array(F.col("own"), F.col("own") - 1))).withColumn("upper", F.col("own") > F.col("size"))
    p = stage(open_lists(p.drop("own").withColumn("c2", F.lit(-1)).withColumn("v2", F.lit(0).cast("long"))), "lists")
    rows = ["c", "v", "c2", "v2", "doc_id", "label", "size", "upper", "n_shingles"]

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 1000):
                part = b.iloc[s : s + 1000]
                sig = np.frombuffer(b"".join(part["sig"]), np.uint32).reshape(len(part), -1)[:, : prefix + 1]
                row, c2 = np.nonzero(np.arange(sig.shape[1])[None, :] > part["c"].to_numpy()[:, None])
                out = part.iloc[row].drop(columns="sig")
                yield out.assign(c2=c2.astype(np.int32), v2=sig[row, c2].astype(np.int64))[rows]

    kind = "c int, v long, c2 int, v2 long, doc_id long, label long, size int, upper boolean, n_shingles int"
    outside = F.col("n") - F.col("n_top")
    long_ = p.where(outside > OUTSIDE).select(*rows).join(reps.select("doc_id", "sig"), "doc_id").mapInPandas(second, kind)
    p = p.where(outside <= OUTSIDE).unionByName(open_lists(long_))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("m") / BLOCK_SHINGLES)).cast("int")
    rest_share = (F.col("n") - F.col("n_top")) / F.col("n")
    p = p.withColumn("blocks", blocks).withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("blocks") * rest_share)).cast("int"))
    h = F.xxhash64("doc_id")
    rest, single = F.col("label") != F.col("top"), F.col("blocks") * F.col("chunks") == 1
    rows = ["c", "v", "c2", "v2", "size", "doc_id", "label", "upper"]
    target = p.select(*rows, F.pmod(h, F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), (rest & single).alias("asks"))
    asking = p.where(rest & ~single).select(*rows, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("chunks")).cast("int").alias("chunk"), F.lit(True).alias("asks"))
    return target.unionByName(asking)


GROUP = ["c", "v", "c2", "v2", "size", "block", "chunk"]


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    A null text, or one without words, has an empty set and is linked with nothing; fewer than k words are one
    shingle.  Rows with the same id count as one document when linked, by the sets of all of them.  A row without an id
    is never linked and is kept.  Other columns are left out.  No rows: no result."""
    d = columns_of(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    least = least_matches(percent / 100)
    prefix = COORDINATES - least + 1
    sketch = stage(sketches(d, k), "sketches")
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    # written, so that the join reads two plain shuffles and a class with very many copies can be split
    classes = stage(full.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    reps = full.join(classes, ["f1", "f2", "n_shingles"]).where("doc_id = rep").groupBy("doc_id", "f1", "f2", "n_shingles").agg(F.first("sig").alias("sig"))
    reps = stage(reps.select("doc_id", "sig", "n_shingles"), "reps")

    def coordinates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                sig = np.frombuffer(b"".join(b["sig"]), np.uint32).reshape(len(b), -1)[:, :prefix]
                yield pd.DataFrame({"c": np.tile(np.arange(prefix, dtype=np.int32), len(b)), "v": sig.ravel().astype(np.int64), "doc_id": np.repeat(b["doc_id"].to_numpy(), prefix), "n_shingles": np.repeat(b["n_shingles"].to_numpy(), prefix)})

    posted = reps.select("doc_id", "n_shingles", "sig").mapInPandas(coordinates, "c int, v long, doc_id long, n_shingles int")
    lists = posted.groupBy("c", "v").agg(F.count("*").alias("n"), F.min("doc_id").alias("leader")).where("n > 1").drop("n")
    postings = stage(posted.join(lists, ["c", "v"]), "postings")
    # leaders that a document meets in a tenth of its lists at least, the most frequent first
    met = postings.where("doc_id > leader").groupBy(F.col("leader").alias("a"), F.col("doc_id").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= prefix // 10)
    ranked = met.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(F.col("n").desc(), "a"))).where(F.col("r") <= LEADERS)
    links = stage(verified(ranked.select("a", "b"), d, k, percent), "first")
    labels = components(links)

    left = unresolved(postings.select("c", "v", "doc_id", "n_shingles"), labels, reps, prefix, percent)
    row = [*GROUP, "doc_id", "label", "upper", "asks"]

    def flag(g: pd.DataFrame) -> pd.DataFrame | None:
        if not g["asks"].any():
            return None
        q, t, _ = pairs_of(np.frombuffer(b"".join(g["sig"]), np.uint32).reshape(len(g), -1), g, least)
        return g.iloc[np.unique(np.r_[q, t])][row] if len(q) else None

    kind = "c int, v long, c2 int, v2 long, size int, block int, chunk int, doc_id long, label long, upper boolean, asks boolean"
    meet = left.join(reps.select("doc_id", "sig"), "doc_id").select(*row, "sig").repartition(*GROUP).sortWithinPartitions(*GROUP)
    flagged = stage(meet.mapInPandas(by_group(GROUP, flag), kind), "flagged")

    def link(g: pd.DataFrame) -> pd.DataFrame | None:
        sets = shingle_sets(g["text"].tolist(), k)
        if not all(map(len, sets)):  # another row of an id may have no words
            g, sets = g[[len(s) > 0 for s in sets]], [s for s in sets if len(s)]
        if not g["asks"].any():
            return None
        ids = g["doc_id"].to_numpy()
        q, t, n = pairs_of(signatures(sets), g, least)
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        label, out = g["label"].tolist(), []
        for i in np.lexsort((ids[t], ids[q], -n)):
            a, b = top(label[q[i]]), top(label[t[i]])
            if a != b and similar(sets[q[i]], sets[t[i]], percent):
                root[a] = b
                out.append((ids[q[i]], ids[t[i]]))
        return pd.DataFrame(out, columns=["a", "b"]) if out else None

    # texts go by shuffle at every size: the flagged rows grow with the input and may not be broadcast
    again = flagged.hint("merge").join(d, "doc_id").select(*row, "text").repartition(*GROUP).sortWithinPartitions(*GROUP)
    more = again.mapInPandas(by_group(GROUP, link), "a long, b long")
    found = components(links.unionByName(more))
    joined = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "n_shingles", F.coalesce("label", "rep").alias("component"))
    # documents without words, and rows without an id, share one set that is linked with nothing: they take no part in the join
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    out = sketch.where(~alone).join(joined, ["f1", "f2", "n_shingles"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    out = out.unionByName(sketch.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op5_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
