from pyspark.sql import functions as F

import corpus_pipeline as c
from leafmill.llm import quality, secrets
from tests.helpers import SMALL
from tests.llm.test_operators import brute, measured


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in c.STAGES]
    assert len(names) == 5
    kept = c.stage(c.quality_rules(spark, docs, SMALL), "q")
    assert kept.columns == docs.columns
    bad = {i for i, t in texts.items() if measured(t)[0] < 50 or 100 * measured(t)[4] > 50 * measured(t)[0]}
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    book = {r.doc_id: r.kept for r in quality.apply_policy(quality.ledger(docs), quality.STRICT).collect()}
    assert left == {i for i, k in book.items() if k} and not left & bad
    single = c.stage(c.near_dedup(spark, kept, SMALL), "n")
    ids = sorted(left)
    want = {ids[i] for i, (_, top) in enumerate(brute([texts[i] for i in ids], k=5)) if i == top}
    assert {r.doc_id for r in single.select("doc_id").collect()} == want and single.columns == docs.columns
    token = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(' token = "'), F.sha1(F.col("doc_id").cast("string").cast("binary")), F.lit('" end'))).otherwise(" plain end")
    single = c.stage(single.withColumn("text", F.concat("text", token)), "t")
    clean = c.stage(c.secret_scan(spark, single, SMALL), "s")
    assert clean.count() == single.count() and clean.columns == docs.columns
    known = {r.candidate for r in secrets.findings(single).where("kind <> 'opaque'").select("candidate").collect()}
    left_in = [r.text for r in clean.select("text").collect() if any(part[i : i + 16] in r.text for part in known for i in range(len(part) - 15))]
    assert known and not left_in
    mixed = c.stage(c.source_mix(spark, clean, SMALL), "m")
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3
    out = c.token_ids(spark, mixed, SMALL)
    assert out.count() == mixed.count() and out.where("n_ids = 0").count() == 0


def test_empty(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, step in c.STAGES:
        docs = c.stage(step(spark, docs, SMALL), "e")
        assert docs.count() == 0


def test_rows_without_an_id_or_with_one_id(spark):
    long_, other, third = (" ".join(f"{c}{i}" for i in range(80)) for c in "abc")
    rows = [(1, long_, "s"), (2, other, "s"), (2, long_ + " z", "s"), (None, third, "s"), (None, third + " y", "s")]
    docs = c.stage(spark.createDataFrame(rows, "doc_id long, text string, source string"), "d")
    single = c.stage(c.near_dedup(spark, docs, SMALL), "n")
    got = {(r.doc_id, r.text[0]) for r in single.collect()}
    assert single.count() == 3 and got == {(1, "a"), (2, "b"), (None, "c")}
    mixed = c.source_mix(spark, single, SMALL)
    assert sorted(r.text[0] for r in mixed.collect()) == ["a", "b", "c"] and mixed.columns == docs.columns
