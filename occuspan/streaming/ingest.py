"""Streaming forms of the additive operators: counts by position and variant grow as files of reads arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occuspan.functions import tags


def read_stream(spark: SparkSession, path: str, like: DataFrame, files: int = 64) -> DataFrame:
    """Parquet files of a folder as a stream with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def variant_counts_stream(reads: DataFrame, late: str = "30 days") -> DataFrame:
    """Reads of each variant; a record that is delivered again within the watermark counts once."""
    once = reads.withColumn("loaded_at", F.col("loaded_at").cast("timestamp")).withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["ordinal"])
    return once.where("pv is not null").select(F.explode(tags.variant_ids(F.col("pv"))).alias("variant_id")).groupBy("variant_id").agg(F.count(F.lit(1)).alias("n_reads"))


def daily_counts_stream(reads: DataFrame, late: str = "30 days") -> DataFrame:
    """Reads of each sample and run day, closed once the watermark has passed the day."""
    return reads.withColumn("run_at", F.col("run_at").cast("timestamp")).withWatermark("run_at", late).groupBy(F.window("run_at", "1 day"), "sample_id").agg(F.count(F.lit(1)).alias("n_reads"))


def update_store(batch: DataFrame, epoch: int, path: str) -> None:
    """For ``foreachBatch``: counts of one batch under their epoch; a batch that is run again replaces itself, and readers sum over epochs."""
    batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
