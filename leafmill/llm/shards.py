"""Sharding along a Hilbert curve over metadata, for files that can be pruned in several dimensions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import columns_of, stage, table


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of the given cells (n rows, one column per dimension, each below
    2**bits), by Skilling's transposition method on whole columns at once."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo excess work, from the highest bit down
        p = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(high, x[:, 0] ^ p, x[:, 0]) ^ swap
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = top
    while q > 1:
        t = np.where(x[:, n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | x[:, i] >> b & 1
    return out


def text_cuts(df: DataFrame, dim: str, parts: int) -> list[str]:
    """The values at which equal shares of the rows end, from the counts of all values in order.

    Values are sorted in ranges; a sum per range and the cuts reach the driver, no more."""
    counts = df.where(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("value")).agg(F.count("*").alias("n"))
    counts = stage(counts.orderBy("value").withColumn("range", F.spark_partition_id()), "values")
    sums = counts.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect()
    total = sum(r.n for r in sums)
    before = {r["range"]: sum(q.n for q in sums[:i]) for i, r in enumerate(sums)}
    if not total:
        return []
    start = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("range")]
    end = start + F.sum("n").over(Window.partitionBy("range").orderBy("value"))
    share = lambda upto: F.floor(upto * F.lit(parts) / F.lit(total))
    cut = counts.withColumn("end", end).where((share(F.col("end")) > share(F.col("end") - F.col("n"))) & (F.col("end") < total))
    return sorted((r.value for r in cut.select("value").collect()), key=lambda v: v.encode())


def quantised(df: DataFrame, dims: list[str], bits: int, accuracy: int = 1000) -> DataFrame:
    """Adds ``_cell``, an array with a number below 2**bits per dimension; nulls are in cell 0.  The cuts of numbers are
    quantiles from sketches of bounded size over all rows, those of texts come from the counts of whole values; only the
    2**bits - 1 cuts a dimension reach the driver."""
    texts = {c for c, kind in df.dtypes if kind == "string"}
    numbers = [c for c in dims if c not in texts]
    shares = [i / 2**bits for i in range(1, 2**bits)]
    row = df.agg(F.count("*"), *[F.percentile_approx(F.col(c).cast("double"), shares, accuracy).alias(c) for c in numbers]).first()
    cuts = {c: sorted(set(row[c] or [])) if c in numbers else text_cuts(df, c, 2**bits) for c in dims}
    value = {c: F.col(c).cast("double") if c in numbers else F.col(c) for c in dims}
    cell = [sum((F.when(value[c] > F.lit(v), 1).otherwise(0) for v in cuts[c]), F.lit(0)) for c in dims]
    return df.withColumn("_cell", F.array(*cell))


def with_rank(df: DataFrame, major: str, minor: str, rows_per_bin: int = 200_000, n_rows: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``_rank``, the place (from 0) in the order of ``major``, a seeded hash of ``minor``, ``minor``, ``ties``.

    No window holds all rows: rows fall into bins (major, part of the hash), counts per bin are summed up
    along the few values of ``major`` and then inside each, and rows are numbered inside their bin.  A value
    of ``major`` with a third of all rows has as many bins as there are millions in it."""
    n_rows = df.count() if n_rows is None else n_rows
    parts = max(1, math.ceil(n_rows / rows_per_bin))
    df = df.withColumn("_hash", F.xxhash64(F.lit(17), minor))
    df = df.withColumn("_bin", F.floor((F.shiftrightunsigned("_hash", 1) / F.lit(float(2**63))) * parts).cast("int"))
    df = df.withColumn("_bin", F.least("_bin", F.lit(parts - 1))).withColumn("_h", F.shiftrightunsigned("_hash", 1))
    bins = df.groupBy(major, "_bin").agg(F.count("*").alias("_n"))
    majors = bins.groupBy(major).agg(F.sum("_n").alias("_m"))
    before = majors.select(major, (F.sum("_m").over(Window.orderBy(major)) - F.col("_m")).alias("_before"))
    inside = bins.select(major, "_bin", (F.sum("_n").over(Window.partitionBy(major).orderBy("_bin")) - F.col("_n")).alias("_inside"))
    starts = inside.join(before, major).select(major, "_bin", (F.col("_before") + F.col("_inside")).alias("_start"))
    own = F.row_number().over(Window.partitionBy(major, "_bin").orderBy("_h", *[F.col(c).asc_nulls_first() for c in (minor, *ties)]))
    ranked = df.withColumn("_own", own)
    return ranked.join(starts, [major, "_bin"]).withColumn("_rank", (F.col("_start") + F.col("_own") - 1).cast("long")).drop("_hash", "_h", "_bin", "_own", "_start")


def hilbert_shards(df: DataFrame, dims: list[str], key: str, n_shards: int, bits: int = 4, ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in the shard): runs of the
    Hilbert order whose counts are at most one apart.

    ``df`` should be narrow (no texts): join the shards back by key to write files.  Nulls in a dimension
    sort first, ties on the curve go by a hash of ``key``, then by ``key``, then by ``ties``; rows that are
    equal in all of these are told apart by any order.  Empty in, empty out."""
    curve = F.pandas_udf(lambda cells: pd.Series(hilbert_index(np.stack(cells.to_numpy()), bits) if len(cells) else [], dtype="int64"), "long")
    n = df.count()
    placed = quantised(df, dims, bits).withColumn("_curve", curve("_cell"))
    ranked = with_rank(placed, "_curve", key, n_rows=n, ties=ties)
    whole, more = divmod(n, n_shards)  # the first `more` shards hold one row more
    rank = F.col("_rank")
    edge = more * (whole + 1)
    shard = F.when(rank < edge, F.floor(rank / (whole + 1))).otherwise(more + F.floor((rank - edge) / max(whole, 1)))
    first = F.col("shard") * whole + F.least(F.col("shard"), F.lit(more))
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", (rank - first).cast("long")).drop("_rank", "_curve", "_cell")


def op9_sharding(spark, sf_dir):
    d = columns_of(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", lang="lang", source="source")
    slim = d.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = hilbert_shards(stage(slim, "slim"), ["source", "lang", "size"], "doc_id", 16, ties=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
