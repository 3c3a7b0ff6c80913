"""Problem 5: a sample whose categories match target shares.

Counts per category, integer quotas by largest remainder under floors and caps, the smallest random keys of
each category, and a report of the targets that can't be met.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from occuspan.session import table, written

#: bits of the random key by which ranges are cut, and rows of the range in which a quota ends above which it is cut again
RANGE_BITS, RANGE_ROWS = 8, 500_000


def reads_of(tagged: DataFrame) -> DataFrame:
    """``sample_id, query_name, nc``: each read once, with the nc of its record of greatest ordinal.

    Repeated rows change nothing; rows without sample or query name are left out.
    """
    t = tagged.where("sample_id is not null and query_name is not null")
    # null is a value that the record can have, so the ordinal decides and nc rides along
    return t.groupBy("sample_id", "query_name").agg(F.max_by("nc", "ordinal").alias("nc"))


def eligible(reads: DataFrame) -> DataFrame:
    return reads.where("nc is not null and nc >= 0")


def largest_remainder(share: np.ndarray, floor: np.ndarray, have: np.ndarray, total: int) -> np.ndarray:
    """Integer quotas: at most ``have``, at least ``min(floor, have)``, in sum ``total`` unless the floors exceed it or too little is there.

    Categories without a share get their floor and no more, also where those with a share are exhausted.
    Shares are scaled over the categories that are still free; a category pushed to its floor or cap leaves
    the split and the rest is split again. Remainders go to the largest fraction, then to the first category.
    """
    lo, hi = np.minimum(floor, have), have
    total = int(min(max(total, lo.sum()), hi.sum()))
    q = lo.astype(float)
    free = (hi > lo) & (share > 0)
    fixed = np.where(free, 0, lo).astype(float)
    while free.any():
        left = max(0.0, total - fixed[~free].sum())
        want = left * share / share[free].sum()
        over, under = free & (want >= hi), free & (want <= lo)
        # of the two kinds the one with the larger breach is fixed first, as in any water filling
        breach_o, breach_u = (want - hi)[over].sum(), (lo - want)[under].sum()
        pick, value = (over, hi) if over.any() and breach_o >= breach_u else (under, lo)
        if not pick.any():
            q = np.where(free, want, fixed)
            break
        fixed[pick] = value[pick]
        free &= ~pick
        q = np.where(free, 0, fixed)
    whole = np.floor(q + 1e-9).astype(np.int64)
    frac, rest = q - whole, total - whole.sum()
    for i in np.lexsort((np.arange(len(q)), -frac)):
        if rest <= 0:
            break
        if share[i] > 0 and whole[i] < hi[i]:
            whole[i] += 1
            rest -= 1
    return whole


def _allocate(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("category").reset_index(drop=True)
    share = pdf["share"].fillna(0).clip(lower=0).to_numpy(float)
    q = largest_remainder(share, pdf["floor"].fillna(0).clip(lower=0).to_numpy(np.int64), pdf["have"].to_numpy(np.int64), int(pdf["total"].fillna(0).max()))
    return pdf.assign(quota=q)[["unit", "category", "have", "needed", "quota"]]


def quota_report(rows: DataFrame, targets: DataFrame, unit: str, category: str, share: str, floor: str, total: str) -> DataFrame:
    """``unit, category, have, needed, quota`` of each target row.

    ``targets`` has one row for each unit and category: share, least number and the unit's wanted size. Needed is the
    greater of floor and share * size, nulls ignored. Rows and targets with a null unit or category are left out; of
    repeated targets the greatest numbers count. Rows are counted in each task before the shuffle.
    """
    u, c = F.col(f"`{unit}`"), F.col(f"`{category}`")
    have = rows.where(u.isNotNull() & c.isNotNull()).groupBy(u.alias("_u"), c.alias("_c")).agg(F.count(F.lit(1)).alias("have"))
    t = targets.select(
        u.alias("unit"), c.alias("category"), F.col(share).cast("double").alias("share"), F.col(floor).cast("long").alias("floor"), F.col(total).cast("long").alias("total")
    ).where("unit is not null and category is not null")
    t = t.groupBy("unit", "category").agg(F.max("share").alias("share"), F.max("floor").alias("floor"), F.max("total").alias("total"))
    t = t.withColumn("needed", F.coalesce(F.greatest(F.col("floor").cast("double"), F.col("share") * F.col("total")), F.lit(0.0)))
    t = t.join(have, (t["unit"] == have["_u"]) & (t["category"] == have["_c"]), "left").select("unit", "category", "share", "floor", "total", "needed", F.coalesce("have", F.lit(0)).alias("have"))
    kind = {f.name: f.dataType.simpleString() for f in targets.schema}
    # one group holds a unit's categories (counts, not rows)
    report = t.groupBy("unit").applyInPandas(_allocate, f"unit {kind[unit]}, category {kind[category]}, have long, needed double, quota long")
    return report.select(F.col("unit").alias(unit), F.col("category").alias(category), "have", "needed", "quota")


def quota_sample(rows: DataFrame, report: DataFrame, unit: str, category: str, key: Column) -> DataFrame:
    """The ``rows`` of smallest ``key`` of each unit and category, as many as the report's quota.

    Units and categories without targets give no rows. ``key`` is a deterministic random long; equal keys are broken by
    the row's other columns, so the sample is repeatable.
    A category's rows are spread over ranges of the key: ranges below the quota are kept whole, and the range in
    which the quota ends is cut into finer ones until it has at most ``RANGE_ROWS`` rows; only that one is ranked, so
    no task sorts a whole category however large it is. Empty tables give empty results.
    """
    u, c = F.col(f"`{unit}`"), F.col(f"`{category}`")
    # a range of keys is a run of leading bits, in the order of signed numbers
    at = lambda bits: F.shiftright("_k", 64 - bits)
    keyed = rows.where(u.isNotNull() & c.isNotNull()).withColumns({"_u": u, "_c": c, "_k": key})
    per_range = keyed.groupBy("_u", "_c", at(RANGE_BITS).alias("_r")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_u", "_c").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = report.select(u.alias("_u"), c.alias("_c"), F.col("quota").alias("_room"))
    bits, sample = RANGE_BITS, None
    while True:
        cuts = per_range.withColumn("_before", before).join(room, ["_u", "_c"]).where("_before < _room")
        cuts = written(cuts.select("_u", "_c", "_r", (F.col("_room") - F.col("_before")).alias("_room"), "n"))
        near = keyed.withColumn("_r", at(bits)).join(cuts, ["_u", "_c", "_r"])
        whole = near.where("n <= _room").select(*rows.columns)
        sample = whole if sample is None else sample.unionByName(whole)
        cut = cuts.where("n > _room")
        if bits >= 64 or cut.where(F.col("n") > RANGE_ROWS).isEmpty():
            break
        # one range of a category is cut again; its rows are all that the next turn reads
        keyed = near.where("n > _room").select(*rows.columns, "_u", "_c", "_k")
        room = cut.select("_u", "_c", "_room")
        bits += RANGE_BITS
        per_range = keyed.groupBy("_u", "_c", at(bits).alias("_r")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("_u", "_c", "_r").orderBy("_k", *[F.col(f"`{x}`") for x in rows.columns]))
    ranked = near.where("n > _room").withColumn("_rank", rank).where("_rank <= _room")
    sample = sample.unionByName(ranked.select(*rows.columns))
    return sample


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligible(reads_of(table(spark, sf_dir, "tagged_reads").select("sample_id", "query_name", "nc", "ordinal")))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota_report(_rows(spark, sf_dir), table(spark, sf_dir, "nc_targets"), "sample_id", "nc", "target_share", "min_rows", "sample_rows")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets that can't be met."""
    return _report(spark, sf_dir).where("have < needed").select("sample_id", "nc")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available and wanted numbers and the quota of every target."""
    return _report(spark, sf_dir).withColumn("needed", F.round("needed", 6))


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn reads."""
    rows = written(_rows(spark, sf_dir))
    key = F.xxhash64(F.lit(42), F.col("sample_id"), F.col("query_name"))
    report = quota_report(rows, table(spark, sf_dir, "nc_targets"), "sample_id", "nc", "target_share", "min_rows", "sample_rows")
    return quota_sample(rows, written(report), "sample_id", "nc", key)


QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p5_sample": p5_sample}

ORACLES = {
    "p5_found": """
with r as (
  select sample_id, query_name, arg_max(struct_pack(nc := nc), ordinal).nc as nc from tagged_reads
  where sample_id is not null and query_name is not null group by 1, 2),
h as (select sample_id, nc, count(*) as have from r where nc >= 0 group by 1, 2)
select t.sample_id, t.nc from nc_targets t left join h using (sample_id, nc)
where coalesce(have, 0) < greatest(cast(min_rows as double), target_share * sample_rows)
""",
}
