"""Sinks: a folder of parquet tables, TSV reports and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_store(tables: dict[str, DataFrame], path: str, partition: dict[str, list[str]] | None = None) -> None:
    """Each table in a parquet folder of its name, replaced if there; ``metadata`` lists names and columns."""
    for name, df in tables.items():
        w = df.write.mode("overwrite").option("compression", "zstd")
        (w.partitionBy(*partition[name]) if partition and name in partition else w).parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(n, ",".join(d.columns)) for n, d in tables.items()], "name string, columns string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def write_tagged(df: DataFrame, path: str) -> None:
    """The tagged reads, split by sample and in file order; ranges of (sample, ordinal) are dealt to tasks, so a large sample has many writers and files."""
    df.repartitionByRange("sample_id", "ordinal").sortWithinPartitions("sample_id", "ordinal").write.mode("overwrite").partitionBy("sample_id").option("compression", "zstd").parquet(path)


def write_tsv(df: DataFrame, path: str, decimals: dict[str, int] | None = None, single: bool = True) -> None:
    """A TSV report with a header; columns in ``decimals`` are written with so many digits, arrays joined by commas.

    ``single`` makes one file, for reports of a few rows a variant; without it each task writes a file of its own.
    """
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if decimals and f.name in decimals:
            c = F.format_string(f"%.{decimals[f.name]}f", c)
        elif f.dataType.typeName() == "array":
            c = F.array_join(c.cast("array<string>"), ",")
        cols.append(c.cast("string").alias(f.name))
    out = df.select(*cols)
    (out.coalesce(1) if single else out).write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="")


def member_text(members, limit: int = 10):
    """The first members and how many more there are: ``A,B,...+3more``."""
    n = F.size(members)
    head = F.array_join(F.slice(members, 1, limit), ",")
    return F.when(n > limit, F.concat(head, F.lit("...+"), (n - limit).cast("string"), F.lit("more"))).otherwise(head)


def metrics(df: DataFrame) -> DataFrame:
    """A one-row table as metric and value rows."""
    cast = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    return cast.unpivot([], df.columns, "metric", "value")


#: fixed values: columns of the reports of a library, in their order
LAYOUTS = {
    "motifs": ["bin", "start", "end", "width", "peak_density", "n_variants", "variant_ids"],
    "cooccupancy": ["site1", "site2", "n_instruments", "weighted_mean_excess", "p_two_sided", "fdr_q", "direction", "frac_instruments_consistent", "is_call", "validated_call", "secondary_artifact"],
    "tf_candidates": ["motif", "id", "tf", "strand", "offset", "score", "score_norm", "concordance"],
}


def write_report(df: DataFrame, path: str, layout: str) -> None:
    """A report in a fixed layout: these columns in this order, scores with six digits and p-values with four significant ones."""
    kinds = dict(df.dtypes)
    cols = [F.format_string("%.4g", c).alias(c) if c in ("p_two_sided", "fdr_q") else F.col(c) for c in LAYOUTS[layout]]
    write_tsv(df.select(*cols), path, {c: 6 for c in LAYOUTS[layout] if kinds[c] == "double" and c not in ("p_two_sided", "fdr_q")})


def calibration_snapshot(p_values: DataFrame, p: str, q: str, path: str) -> None:
    """One JSON row of a calibration run: number, mean and median p, share at most 0.05, and calls at q below 0.05 and 0.10."""
    c = lambda x: F.count(F.when(x, 1))
    row = p_values.agg(F.count(p).alias("n"), F.avg(p).alias("mean_p"), F.percentile(p, F.lit(0.5)).alias("median_p"), (c(F.col(p) <= 0.05) / F.count(p)).alias("share_05"), c(F.col(q) < 0.05).alias("calls_05"), c(F.col(q) < 0.10).alias("calls_10"))
    row.coalesce(1).write.mode("overwrite").json(path)
