"""FASTA sequences, position matrices, variant lists, score tables and configuration."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from occuspan.functions import tags


def fasta_lengths(spark: SparkSession, path: str, keep_skipped: bool = False) -> DataFrame:
    """``rname, ref_len`` of each contig; contigs of no class but ``skip`` are dropped unless wanted.

    Lines keep their order by file and offset, and a running count of headers assigns sequence lines to contigs.
    """
    lines = _lines(spark, path)
    g = lines.groupBy("file", "contig").agg(F.max("name").alias("rname"), F.sum(F.when(F.col("head"), 0).otherwise(F.length("line"))).cast("int").alias("ref_len")).where("rname is not null")
    g = g.select("rname", "ref_len")
    return g if keep_skipped else g.where(tags.classify_contig(F.col("rname")) != "skip")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in the order of their file, with the number of their contig; a file is read in splits, line by line, so it may be of any size.

    Within a split lines are read in order, and splits are ordered by where they begin.
    """
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.rtrim("value").alias("line"))
    rows = t.withColumn("head", F.col("line").startswith(">"))
    w = Window.partitionBy("file").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("contig", F.sum(F.col("head").cast("int")).over(w))
    return rows.withColumn("name", F.when(F.col("head"), F.regexp_extract("line", r"^>(\S*)", 1)))


def fasta_sequence(spark: SparkSession, path: str, contig: str) -> str | None:
    """One contig's bases in capitals, as the caller's parameter; None where there is no such file or the file has no such contig. Other errors of reading are raised."""
    try:
        lines = _lines(spark, path)
        number = lines.where(F.col("head") & (F.col("name") == contig)).agg(F.min("contig")).first()[0]
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if number is None:
        return None
    rows = lines.where(~F.col("head") & (F.col("contig") == number)).orderBy("file", "block", "n").select(F.trim("line"))
    return "".join(r[0] for r in rows.toLocalIterator()).upper() or None


def pwm_jaspar(spark: SparkSession, path: str) -> DataFrame:
    """``id, tf, pos, base, count`` of matrices written as a header and a row of counts for each base."""
    t = spark.read.text(path, wholetext=True)
    blocks = t.select(F.explode(F.filter(F.split("value", r"(?m)^>"), lambda b: F.trim(b) != "")).alias("b"))
    head = F.split(F.regexp_extract("b", r"^([^\n]*)", 1), r"\s+", 2)
    rows = blocks.select(head[0].alias("id"), F.coalesce(F.nullif(F.trim(F.get(head, F.lit(1))), F.lit("")), head[0]).alias("tf"), F.explode(F.regexp_extract_all("b", F.lit(r"(?m)^\s*([ACGT]\s*\[[^\]]*\])"), F.lit(1))).alias("r"))
    nums = F.filter(F.split(F.regexp_extract("r", r"\[([^\]]*)\]", 1), r"\s+"), lambda x: x != "")
    return rows.select("id", "tf", F.substring(F.trim("r"), 1, 1).alias("base"), F.posexplode(nums).alias("pos", "c")).select("id", "tf", "pos", "base", F.col("c").cast("double").alias("count"))


def pwm_rows(spark: SparkSession, path: str) -> DataFrame:
    """The same of matrices written as a header and a row of four counts (A, C, G, T) for each position."""
    t = spark.read.text(path, wholetext=True)
    blocks = t.select(F.explode(F.filter(F.split("value", r"(?m)^>"), lambda b: F.trim(b) != "")).alias("b"))
    name = F.regexp_extract("b", r"^(\S+)", 1)
    rows = blocks.select(name.alias("id"), F.posexplode(F.filter(F.slice(F.split("b", r"\n"), 2, 1 << 20), lambda x: F.trim(x) != "")).alias("pos", "r"))
    four = F.split(F.trim("r"), r"\s+")
    return rows.select("id", F.col("id").alias("tf"), "pos", F.explode(F.arrays_zip(F.array(*map(F.lit, "ACGT")).alias("base"), four.alias("count"))).alias("x")).select("id", "tf", "pos", "x.base", F.col("x.count").cast("double").alias("count"))


def variant_list(spark: SparkSession, path: str) -> DataFrame:
    """One id on each line; blank lines are passed over."""
    return spark.read.text(path).select(F.trim("value").alias("variant_id")).where("variant_id <> ''").distinct()


def score_table(spark: SparkSession, path: str) -> DataFrame:
    """A TSV or CSV score table under its common names."""
    from occuspan.operators.joins import normalise_scores

    return normalise_scores(spark.read.csv(path, sep="," if path.endswith(".csv") else "\t", header=True))


def sweep_results(spark: SparkSession, path: str) -> DataFrame:
    """JSON snapshots of calibration runs with the arm that their file name begins with."""
    return spark.read.json(path).withColumn("arm", F.regexp_extract(F.input_file_name(), r"([^/_]+)_[^/]*\.json$", 1))


def sample_config(config: dict, sample: str) -> dict:
    """Settings of one sample: those of the sample where given, else the general ones."""
    general = {k: v for k, v in config.items() if k != "samples"}
    own = (config.get("samples") or {}).get(sample) or {}
    return general | (own if isinstance(own, dict) else {"bam": own})


def parse_region(text: str) -> tuple[str | None, int, int]:
    """``contig:start-end``, ``start-end`` or the same with thousands separators: (contig or None, start, end)."""
    contig, _, span = text.rpartition(":")
    a, _, b = span.replace(",", "").partition("-")
    if not (a.strip().isdigit() and b.strip().isdigit()):
        raise ValueError(f"no region: {text}")
    start, end = int(a), int(b)
    if end < start:
        raise ValueError(f"region ends before it starts: {text}")
    return contig or None, start, end
