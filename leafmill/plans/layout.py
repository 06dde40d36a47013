"""Tables and reading order of pages set from the tables' rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.operators import tables
from leafmill.plans.common import read
from leafmill.plans.series import query


@query("table_extract", """
WITH r AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row_no, count(*) OVER (PARTITION BY o_custkey) AS n, o_orderkey, o_orderstatus, o_orderdate FROM orders)
SELECT doc_id, row_no, col, CASE col WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN o_orderstatus ELSE strftime(o_orderdate, '%Y-%m-%d') END AS text FROM r, (VALUES (0), (1), (2)) c(col) WHERE n >= 2""")
def table_extract(spark, sf_dir):
    """A page per customer with a line of three cells per order, found again as a table."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    d = read(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w) - 1)
    cell = lambda c, x: F.struct(F.lit(c).alias("c"), F.lit(float(x)).alias("x"))
    d = d.withColumn("at", F.explode(F.array(cell(0, 50), cell(1, 150), cell(2, 250))))
    text = F.when(F.col("at.c") == 0, F.col("o_orderkey").cast("string")).when(F.col("at.c") == 1, F.col("o_orderstatus")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    d = d.select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page"), (F.col("r") * 3 + F.col("at.c")).cast("int").alias("frag_no"), text.alias("text"), F.col("at.x").alias("x"), (F.lit(5000.0) - F.col("r") * 16).alias("y"), F.lit(10.0).alias("size"), F.lit(False).alias("bold"))
    return tables.tables(d.withColumn("width", F.length("text") * 5.2)).select("doc_id", F.col("row_no").cast("long").alias("row_no"), "col", "text")


@query("reading_order", """
WITH c AS (SELECT conv_id, turn, role, sum((role = 'system')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS band FROM conversations)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY band, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn) - 1 AS place FROM c""")
def reading_order(spark, sf_dir):
    """Turns set in two columns, system turns across both."""
    side = F.when(F.col("role") == "system", "C").when(F.col("role") == "user", "I").otherwise("D")
    d = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page"), F.col("turn").alias("line"), F.lit(50.0).alias("x0"), (F.lit(9000.0) - F.col("turn") * 14).alias("y"), side.alias("column"))
    return tables.reading_order(d).select(F.col("doc_id").alias("conv_id"), F.col("line").alias("turn"), F.col("place").cast("long").alias("place"))
