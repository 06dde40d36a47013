from pyspark.sql import functions as F

from leafmill import streaming
from tests.helpers import SMALL


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, tmp_path):
    e = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    return e, spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))


def test_windows_match_batch(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    got = run(spark, streaming.windowed_counts(stream, "ts", ["event_type"], "1 day", "1 hour"), "win")
    want = batch.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    # the last windows stay open until the watermark passes them
    assert got.join(want, ["start", "event_type", "n"]).count() == got.count() > 0


def test_once(spark, tmp_path):
    batch, _ = source(spark, tmp_path)
    batch.coalesce(1).write.parquet(str(tmp_path / "twice"))
    batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "twice"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "twice"))
    assert run(spark, streaming.once(stream, "ts", "event_id", "60 days"), "once").count() == batch.count()
