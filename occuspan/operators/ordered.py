"""Operators over an order: false-discovery control, islands on a position spine, distribution distances."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from occuspan.operators import occupancy as O
from occuspan.session import table
from occuspan.sources import views as V


def bh(df: DataFrame, p: str, keys: list[str], out: str = "q") -> DataFrame:
    """Benjamini-Hochberg q-values of column ``p`` within ``keys``; null p-values have null q and don't count.

    Equal p-values are counted before anything is ordered, so only distinct values are ranked: the q-value of a
    value needs the number of values up to it, not the rows. Ties get the same q.
    """
    known = df.where(F.col(p).isNotNull())
    n = known.groupBy(*keys, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*keys).orderBy("_p")
    upto = F.sum("_k").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_k").over(Window.partitionBy(*keys))
    q = n.withColumn("_t", F.col("_p") * total / upto)
    q = q.withColumn(out, F.least(F.min("_t").over(Window.partitionBy(*keys).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)))
    a, b = df.alias("a"), q.select(*keys, "_p", out).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col(f"a.{p}") == F.col("b._p")]
    return a.join(b, on, "left").select("a.*", f"b.{out}")


def bridge(df: DataFrame, keys: list[str], hot: Column, gap: int) -> Column:
    """True at hot positions, and at positions with a hot one within ``gap`` on both sides; needs a dense spine."""
    w = Window.partitionBy(*keys).orderBy("pos")
    flag = hot.cast("int")
    return hot | ((F.max(flag).over(w.rowsBetween(-gap, -1)) == 1) & (F.max(flag).over(w.rowsBetween(1, gap)) == 1))


def islands(df: DataFrame, keys: list[str], hot: Column, gap: int = 2, merge: int = 5, min_width: int = 3, value: str = "delta") -> DataFrame:
    """Clusters of hot positions with their statistics.

    Gaps of up to ``gap`` cold positions between hot ones are bridged; runs whose distance start - end is at most
    ``merge`` become one; clusters narrower than ``min_width`` are dropped after that. Sums take in bridged positions.
    The peak is the first position of greatest absolute value, and a negative mean is a loss. One shuffle by ``keys``.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    d = df.withColumn("_set", F.coalesce(bridge(df, keys, hot, gap), F.lit(False)))
    d = d.where("_set")
    # a new cluster begins where the set position before it is further than the merge distance
    start = F.when(F.col("pos") - F.lag("pos").over(w) <= merge, 0).otherwise(1)
    d = d.withColumn("_new", start).withColumn("_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = d.groupBy(*keys, "_id").agg(F.min("pos").alias("start"), F.max("pos").alias("end")).where(F.col("end") - F.col("start") + 1 >= min_width)
    a, s = df.select(*keys, "pos", F.col(value).alias("_v")).alias("a"), spans.alias("s")
    on = [F.col(f"a.{k}") == F.col(f"s.{k}") for k in keys] + [F.col("a.pos").between(F.col("s.start"), F.col("s.end"))]
    j = s.join(a, on).select(*[F.col(f"s.{k}").alias(k) for k in keys], "start", "end", "pos", "_v")
    g = j.groupBy(*keys, "start", "end").agg(
        F.sum(F.abs("_v")).alias("sum_abs_delta"),
        F.max(F.abs("_v")).alias("max_abs_delta"),
        F.avg("_v").alias("mean_signed_delta"),
        F.min_by("pos", F.struct(-F.abs("_v"), "pos")).alias("peak_position"),
        F.count(F.when(F.col("_v") > 0, 1)).alias("_up"),
        F.count(F.when(F.col("_v") < 0, 1)).alias("_down"),
    )
    width = F.col("end") - F.col("start") + 1
    return g.select(
        *keys, "start", "end", width.alias("width"), "sum_abs_delta", "max_abs_delta", "mean_signed_delta", "peak_position",
        F.when(F.col("mean_signed_delta") < 0, "loss").otherwise("gain").alias("direction"),
        (F.when(F.col("mean_signed_delta") >= 0, F.col("_up")).otherwise(F.col("_down")) / width).alias("sign_consistency"),
    )


def runs(df: DataFrame, keys: list[str], hot: Column, min_width: int) -> DataFrame:
    """Maximal runs of hot positions on a dense spine, at least ``min_width`` wide."""
    h = df.where(hot).withColumn("_i", F.col("pos") - F.row_number().over(Window.partitionBy(*keys).orderBy("pos")))
    g = h.groupBy(*keys, "_i").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.max("density").alias("peak_density"))
    return g.where(F.col("end") - F.col("start") + 1 >= min_width).drop("_i")


def fold_merge(df: DataFrame, keys: list[str], start: str, end: str, overlap: float) -> DataFrame:
    """Greedy union of intervals in order of start and end: an interval joins the growing one before it while their overlap is at least ``overlap`` of the shorter.

    The order matters, so a group's distinct intervals are folded in one pass of one task; copies are removed before
    the shuffle, which bounds a group by the pairs of positions of its contig, not by its rows.
    """
    iv = df.select(*keys, F.col(start).cast("int").alias("s"), F.col(end).cast("int").alias("e")).where("s is not null and e >= s").distinct()
    kinds = {f.name: f.dataType.simpleString() for f in iv.schema}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list[int]] = []
        for s, e in sorted(zip(pdf["s"].tolist(), pdf["e"].tolist())):
            if out:
                a, b = out[-1]
                if max(0, min(b, e) - max(a, s) + 1) / (min(b - a, e - s) + 1) >= overlap:
                    out[-1] = [min(a, s), max(b, e)]
                    continue
            out.append([s, e])
        head = {k: [pdf[k].iloc[0]] * len(out) for k in keys}
        return pd.DataFrame(head | {"s": [x[0] for x in out], "e": [x[1] for x in out]})

    return iv.groupBy(*keys).applyInPandas(fold, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", s int, e int")


def wasserstein_nc(dist: DataFrame, other: str = "WT") -> DataFrame:
    """W1 between each variant's nucleosome-count distribution and another's: the sum of |F - G| over the integers."""
    hi = dist.agg(F.max("nc").alias("hi"))
    names = dist.select("variant_id").distinct()
    grid = names.join(F.broadcast(hi)).select("variant_id", F.explode(F.sequence(F.lit(0), "hi")).alias("nc"))
    full = grid.join(dist.select("variant_id", "nc", "frac"), ["variant_id", "nc"], "left")
    cdf = full.withColumn("cdf", F.sum(F.coalesce("frac", F.lit(0.0))).over(Window.partitionBy("variant_id").orderBy("nc").rowsBetween(Window.unboundedPreceding, 0)))
    ref = cdf.where(F.col("variant_id") == other).select("nc", F.col("cdf").alias("g"))
    return cdf.where(F.col("variant_id") != other).join(ref, "nc").groupBy("variant_id").agg(F.sum(F.abs(F.col("cdf") - F.col("g"))).alias("w1"))


def ks_uniform_of(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """Greatest distance between a sample of p-values and the uniform distribution, and the mean p."""
    n = df.where(F.col(p).isNotNull()).groupBy(*keys, F.col(p).alias("x")).agg(F.count(F.lit(1)).alias("k"))
    total = F.sum("k").over(Window.partitionBy(*keys))
    upto = F.sum("k").over(Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    e = n.select(*keys, "x", "k", (upto / total).alias("hi"), ((upto - F.col("k")) / total).alias("lo"))
    return e.groupBy(*keys).agg(F.max(F.greatest(F.abs(F.col("hi") - F.col("x")), F.abs(F.col("lo") - F.col("x")))).alias("ks"), (F.sum(F.col("x") * F.col("k")) / F.sum("k")).alias("mean_p"), F.sum("k").alias("n"))


#: fixed values: the percentiles of read counts of which depths are taken
GRID = (5, 10, 25, 50, 75, 90, 95)


def coverage_grid_of(counts: DataFrame, n: str = "n_reads") -> DataFrame:
    """Depths at fixed percentiles of read counts, by index, with both extremes, to the nearest ten (half to even), 20 at least."""
    c = counts.groupBy(F.col(n).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    # distinct read counts, not rows, pass the ungrouped window
    w = Window.partitionBy(F.lit(0)).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    c = c.select("v", (F.sum("k").over(w) - F.col("k")).alias("lo"), F.sum("k").over(w).alias("hi"), F.sum("k").over(Window.partitionBy(F.lit(0))).alias("n"))
    at = F.array(F.lit(0).cast("long"), F.col("n") - 1, *[F.least(F.floor(F.col("n") * q / 100), F.col("n") - 1) for q in GRID])
    hit = c.where(F.exists(at, lambda i: (i >= F.col("lo")) & (i < F.col("hi"))))
    return hit.select(F.greatest(F.lit(20), (F.bround(F.col("v") / 10) * 10).cast("int")).alias("depth")).distinct()


def bh_fdr(spark, d):
    s = table(spark, d, "variant_summary").select("library", "variant_id", "best_cluster_p")
    return bh(s, "best_cluster_p", ["library"]).select("library", "variant_id", F.round("q", 9).alias("q"))


def cluster_islands(spark, d):
    x = O.delta(O.occupancy(V.molecules(spark, d), V.segments(spark, d)))
    c = islands(x, ["variant_id", "bin"], F.abs("delta") > 0.03)
    r = [F.round(n, 8).alias(n) for n in ("sum_abs_delta", "max_abs_delta", "mean_signed_delta", "sign_consistency")]
    return c.where((F.col("end") >= 50) & (F.col("start") < 250)).select("variant_id", "bin", "start", "end", "width", *r, "direction")


def interval_union_merge(spark, d):
    return fold_merge(V.cluster_rows(spark, d), ["library", "bin"], "abs_start", "abs_end", 0.5)


def wasserstein(spark, d):
    return wasserstein_nc(O.nc_distribution(V.read_nc(spark, d))).withColumn("w1", F.round("w1", 8))


def ks_uniform(spark, d):
    k = ks_uniform_of(table(spark, d, "variant_summary"), ["library"], "best_cluster_p")
    return k.select("library", F.round("ks", 9).alias("ks"), F.round("mean_p", 9).alias("mean_p"), "n")


def coverage_grid(spark, d):
    return coverage_grid_of(table(spark, d, "variant_summary").where("n_reads is not null"))


def jaccard_sets(spark, d):
    """Jaccard index of the variants of each read's tag and of its raw calls, by sample."""
    ids = lambda c: F.array_distinct(V.tags.variant_ids(F.col(c)))
    c = V.calls(spark, d).where("pv is not null and pr is not null").select("sample_id", ids("pv").alias("a"), ids("pr").alias("b"))
    u = F.size(F.array_union("a", "b"))
    j = F.when(u == 0, 1.0).otherwise(F.size(F.array_intersect("a", "b")) / u)
    return c.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(j), 9).alias("mean_jaccard"), F.count(F.when(j >= 0.5, 1)).alias("compatible"))


QUERIES = {
    "bh_fdr": bh_fdr,
    "cluster_islands": cluster_islands,
    "interval_union_merge": interval_union_merge,
    "wasserstein_nc": wasserstein,
    "ks_uniform": ks_uniform,
    "coverage_grid": coverage_grid,
    "jaccard_sets": jaccard_sets,
}

ORACLES = {
    "bh_fdr": """
with r as (select library, variant_id, best_cluster_p as p, count(best_cluster_p) over (partition by library) as n,
    count(best_cluster_p) over (partition by library order by best_cluster_p nulls last range unbounded preceding) as upto from variant_summary),
t as (select *, p * n / upto as t from r)
select library, variant_id, case when p is not null then round(least(min(t) over (partition by library order by p desc nulls last range unbounded preceding), 1), 9) end as q from t""",
    "cluster_islands": V.sql(
        "delta",
        """
with h as (select *, abs(delta) > 0.03 as hot from delta),
b as (select *, hot or (coalesce(bool_or(hot) over (p rows between 2 preceding and 1 preceding), false)
    and coalesce(bool_or(hot) over (p rows between 1 following and 2 following), false)) as set_ from h window p as (partition by variant_id, bin order by pos)),
r as (select *, pos - row_number() over (partition by variant_id, bin order by pos) as run from b where set_),
runs as (select variant_id, bin, min(pos) as s, max(pos) as e from r group by variant_id, bin, run),
m as (select *, case when s - lag(e) over (partition by variant_id, bin order by s) <= 5 then 0 else 1 end as new_ from runs),
g as (select *, sum(new_) over (partition by variant_id, bin order by s rows unbounded preceding) as id from m),
c as (select variant_id, bin, min(s) as s, max(e) as e from g group by variant_id, bin, id having max(e) - min(s) + 1 >= 3)
select c.variant_id, c.bin, c.s as start, c.e as "end", c.e - c.s + 1 as width, round(sum(abs(delta)), 8) as sum_abs_delta, round(max(abs(delta)), 8) as max_abs_delta,
  round(avg(delta), 8) as mean_signed_delta, case when avg(delta) < 0 then 'loss' else 'gain' end as direction,
  round(case when avg(delta) >= 0 then count(*) filter (delta > 0) else count(*) filter (delta < 0) end / (c.e - c.s + 1), 8) as sign_consistency
from c join delta d on d.variant_id = c.variant_id and d.bin = c.bin and d.pos between c.s and c.e where c.e >= 50 and c.s < 250 group by c.variant_id, c.bin, c.s, c.e""",
    ),
    "interval_union_merge": V.sql(
        "cluster_rows",
        """
iv as (select library, bin, cast(abs_start as int) as s, cast(abs_end as int) as e from cluster_rows group by all),
o as (select *, row_number() over (partition by library, bin order by s, e) as i from iv),
walk as (
  select library, bin, i, 1 as part, s, e from o where i = 1
  union all
  select o.library, o.bin, o.i,
    case when greatest(least(w.e, o.e) - greatest(w.s, o.s) + 1, 0) / (least(w.e - w.s, o.e - o.s) + 1) >= 0.5 then w.part else w.part + 1 end,
    case when greatest(least(w.e, o.e) - greatest(w.s, o.s) + 1, 0) / (least(w.e - w.s, o.e - o.s) + 1) >= 0.5 then least(w.s, o.s) else o.s end,
    case when greatest(least(w.e, o.e) - greatest(w.s, o.s) + 1, 0) / (least(w.e - w.s, o.e - o.s) + 1) >= 0.5 then greatest(w.e, o.e) else o.e end
  from walk w join o on o.library = w.library and o.bin = w.bin and o.i = w.i + 1)
select library, bin, min(s) as s, max(e) as e from walk group by library, bin, part""".replace("\niv as", "with iv as", 1),
        recursive=True,
    ),
    "wasserstein_nc": V.sql(
        "read_nc",
        """
with g as (select unnest(range(0, (select max(nc) + 1 from read_nc))) as nc),
f as (select variant_id, nc, count(*) / sum(count(*)) over (partition by variant_id) as frac from read_nc where nc >= 0 group by 1, 2),
c as (select v.variant_id, g.nc, sum(coalesce(frac, 0)) over (partition by v.variant_id order by g.nc rows unbounded preceding) as cdf
  from (select distinct variant_id from f) v cross join g left join f on f.variant_id = v.variant_id and f.nc = g.nc)
select a.variant_id, round(sum(abs(a.cdf - b.cdf)), 8) as w1 from c a join c b on b.variant_id = 'WT' and a.nc = b.nc where a.variant_id <> 'WT' group by 1""",
    ),
    "ks_uniform": """
with r as (select library, best_cluster_p as p, row_number() over (partition by library order by best_cluster_p) as k, count(*) over (partition by library) as n
  from variant_summary where best_cluster_p is not null),
t as (select library, p, n, min(k) as lo, max(k) as hi from r group by 1, 2, 3)
select library, round(max(greatest(abs(hi / n - p), abs((lo - 1) / n - p))), 9) as ks, round(sum(p * (hi - lo + 1)) / max(n), 9) as mean_p, max(n) as n from t group by 1""",
    "coverage_grid": """
with c as (select n_reads as v, row_number() over (order by n_reads) - 1 as i, count(*) over () as n from variant_summary where n_reads is not null),
w as (select distinct least(cast(floor(n * q / 100.0) as bigint), n - 1) as i from c, unnest([0, 5, 10, 25, 50, 75, 90, 95, 100]) as t(q))
select distinct cast(greatest(20, round_even(v / 10, 0) * 10) as int) as depth from c join w using (i)""",
    "jaccard_sets": V.sql(
        "calls",
        f"""
with x as (select sample_id, list_distinct({V.ids_sql('pv')}) as a, list_distinct({V.ids_sql('pr')}) as b from calls where pv is not null and pr is not null),
y as (select *, len(list_intersect(a, b)) as i, len(list_distinct(list_concat(a, b))) as u from x),
z as (select sample_id, case when u = 0 then 1.0 else i / u end as j from y)
select sample_id, count(*) as n, round(avg(j), 9) as mean_jaccard, count(*) filter (j >= 0.5) as compatible from z group by 1""",
    ),
}
