"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: space and U+0009 to U+000D.
SPACES = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(flat, " "), "")


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where that is unset and all runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-leafmill-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet to the shared folder and reads it back.

    It cuts the lineage: a lost executor never makes the steps before run again, and steps that need the
    same rows twice read the file.  The folder keeps the table until the cluster clears its checkpoints."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafmill-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns_of(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, under new names, so that other columns of ``df`` can't clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in wanted.items()])


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """The place of a public vocabulary file: in ``folder`` if given, else where the installed package has it."""
    if folder:
        return str(Path(folder) / name)
    import public_tokenizers

    return public_tokenizers.path(name)
