"""Problem 2: continuous covered periods of an entity and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from occuspan.session import table

#: fixed values: the four bins and their spelling in results
BINS = ("sub_TF", "TF", "PIC", "nuc")


def bin_spelling(label: Column) -> Column:
    """The spelling of :data:`BINS` for a loosely written label, else null."""
    bare = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    out = F.lit(None).cast("string")
    for b in BINS:
        out = F.when(bare == b.lower(), F.lit(b)).otherwise(out)
    return out


def _sessions(df: DataFrame, keys: list[str]) -> DataFrame:
    """Merges the half-open spans [s, e) of each key with session windows whose gap is the row's own length."""
    span = F.session_window(
        F.timestamp_seconds(F.col("s")),
        F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), (F.col("e") - F.col("s")).cast("decimal(18,6)")),
    )
    return (
        df.groupBy(*keys, span.alias("w"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.unix_seconds("w.start").alias("s"), F.unix_seconds("w.end").alias("e"))
    )


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, block: int = 1 << 16) -> DataFrame:
    """Maximal covered stretches of each entity: ``keys, s, e`` with ``e`` exclusive.

    Both given bounds are inclusive integers. Rows with a null bound, or an end before the start, are
    left out; a null key is an entity of its own; repeated rows change nothing; an empty table gives
    an empty result. Other columns are dropped, so clashing names do no harm.

    A first merge runs per entity and block of start positions, so that an entity holding a large
    share of all rows is spread over tasks and shrinks to at most ``block / 2`` stretches a block;
    the second merge joins these. Stretches that only touch are joined by a window over the result.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    rows = df.select(
        *[F.col(f"`{k}`").alias(a) for k, a in zip(keys, ks)],
        F.col(f"`{start}`").cast("long").alias("s"),
        (F.col(f"`{end}`").cast("long") + 1).alias("e"),
    ).where("s is not null and e is not null and e > s")
    rows = rows.withColumn("blk", F.floor(F.col("s") / block))
    merged = _sessions(_sessions(rows, [*ks, "blk"]).drop("blk"), ks)
    order = Window.partitionBy(*ks).orderBy("s")
    runs = merged.withColumn("new", F.when(F.col("s") <= F.lag("e").over(order), 0).otherwise(1)).withColumn(
        "run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return runs.groupBy(*ks, "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).select(
        *[F.col(a).alias(k) for k, a in zip(keys, ks)], "s", "e"
    )


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """``keys, kind, pos_start, pos_end``: each covered period and each gap between neighbours, bounds inclusive."""
    p = merge_intervals(df, keys, start, end)
    nxt = F.lead("s").over(Window.partitionBy(*keys).orderBy("s"))
    both = p.withColumn("nxt", nxt).select(
        *keys,
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.lit("period").alias("kind"), F.col("s").alias("pos_start"), (F.col("e") - 1).alias("pos_end")),
                    F.when(
                        F.col("nxt").isNotNull(),
                        F.struct(F.lit("gap").alias("kind"), F.col("e").alias("pos_start"), (F.col("nxt") - 1).alias("pos_end")),
                    ),
                )
            )
        ).alias("r"),
    )
    return both.select(*keys, "r.kind", "r.pos_start", "r.pos_end")


def usable_clusters(clusters: DataFrame) -> DataFrame:
    """Rows with a variant, sane bounds and a known bin (spelled as in :data:`BINS`)."""
    return clusters.select("sample_id", "variant_id", bin_spelling(F.col("bin_labels")).alias("bin_labels"), "abs_start", "abs_end").where(
        "variant_id is not null and bin_labels is not null and abs_start >= 0 and abs_end >= abs_start"
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods and gaps of every (sample, variant, bin) in ``clusters``."""
    return periods_and_gaps(usable_clusters(table(spark, sf_dir, "clusters")), ["sample_id", "variant_id", "bin_labels"], "abs_start", "abs_end")


QUERIES = {"p2_found": p2_found}

ORACLES = {
    "p2_found": r"""
with rows_ as (
  select distinct sample_id, variant_id,
    case lower(regexp_replace(bin_labels, '^\s+|\s+$', '', 'g'))
      when 'sub_tf' then 'sub_TF' when 'tf' then 'TF' when 'pic' then 'PIC' when 'nuc' then 'nuc' end as bin_labels,
    cast(abs_start as bigint) as s, cast(abs_end as bigint) as e
  from clusters
  where variant_id is not null and abs_start >= 0 and abs_end >= abs_start),
marked as (
  select *, case when s <= 1 + max(e) over (partition by sample_id, variant_id, bin_labels order by s, e
      rows between unbounded preceding and 1 preceding) then 0 else 1 end as new_
  from rows_ where bin_labels is not null),
runs as (
  select *, sum(new_) over (partition by sample_id, variant_id, bin_labels order by s, e rows unbounded preceding) as run
  from marked),
periods as (
  select sample_id, variant_id, bin_labels, min(s) as s, max(e) as e from runs group by sample_id, variant_id, bin_labels, run),
next_ as (
  select *, lead(s) over (partition by sample_id, variant_id, bin_labels order by s) as nxt from periods)
select sample_id, variant_id, bin_labels, 'period' as kind, s as pos_start, e as pos_end from periods
union all
select sample_id, variant_id, bin_labels, 'gap', e + 1, nxt - 1 from next_ where nxt is not null
""",
}
