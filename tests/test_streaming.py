from occuspan.streaming import ingest


def test_counts_of_a_stream_equal_those_of_a_batch(spark, sf):
    t = spark.read.parquet(f"{sf}/tagged_reads.parquet")
    s = ingest.variant_counts_stream(ingest.read_stream(spark, f"{sf}/tagged_reads.parq*", t), "3650 days")
    q = s.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    got = {r.variant_id: r.n_reads for r in spark.table("counts").collect()}
    once = t.dropDuplicates(["ordinal"]).where("pv is not null")
    from pyspark.sql import functions as F

    from occuspan.functions.tags import variant_ids

    want = {r.v: r["count"] for r in once.select(F.explode(variant_ids(F.col("pv"))).alias("v")).groupBy("v").count().collect()}
    assert got == want
