"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row it is given and returns a DataFrame; all but the last
return the columns of their input.  Decisions are by row: ids may repeat or be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import mixture, near_dups, pieces, quality, secrets
from leafmill.llm.common import count_words, stage


def carried(docs: DataFrame, *others: str) -> DataFrame:
    """The whole row as ``doc_id``, beside the columns an operator looks at: decisions then need no join."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), *others)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the strict policy rejects go."""
    book = quality.apply_policy(quality.ledger(carried(docs, "text")), quality.STRICT)
    # the row number keeps the filter where it is: moved down, it would compute each measurement once per mention
    book = book.withColumn("_stays", F.col("kept") & (F.monotonically_increasing_id() >= 0))
    return book.where("_stays").select("doc_id.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one with the smallest id (null last)."""
    # written, so that the numbers are the same in both joins
    rows = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = near_dups.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), k=5, percent=80)
    order = rows.select("_row", F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "_row").alias("_order"))
    stays = found.select(F.col("doc_id").alias("_row"), "component_id").join(order, "_row").groupBy("component_id").agg(F.min("_order").alias("_first"))
    return rows.join(stays.select(F.col("_first._row").alias("_row")), "_row", "left_semi").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay."""
    found = secrets.scan(carried(docs, "text", "source"), labelled=secrets.planted(docs))
    clean = secrets.redacted(F.col("text"), F.col("found"))
    return found.select(clean.alias("_clean"), "doc_id.*").select(*[F.col("_clean").alias(c) if c == "text" else F.col(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, from none to three times; rows equal in all columns share one decision."""
    keyed = docs.withColumn("_key", F.xxhash64(*docs.columns))
    sized = keyed.select(F.col("_key").alias("doc_id"), count_words(F.col("text")).alias("size"), F.array("source").alias("sources"))
    copies = mixture.mix(sized).groupBy(F.col("doc_id").alias("_key")).agg(F.max("copies").cast("int").alias("_copies")).where("_copies > 0")
    return keyed.join(copies, "_key").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids."""
    return pieces.encode(docs).withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding", token_ids),
]
#: Forests, signatures and Viterbi have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"stage{i}")
    return docs
