"""Footprint coverage, occupancy profiles, nucleosome-count distributions and reweighted references."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from occuspan.sources import views as V

Z = NormalDist().inv_cdf(0.975)


def binned(segments: DataFrame, spec=V.BIN_SPEC) -> DataFrame:
    """Segments that fall into a bin, with its label."""
    return segments.withColumn("bin", V.bin_of(F.col("track"), F.col("length"), spec)).where("bin is not null")


def covered(segs: DataFrame, window=V.WINDOW) -> DataFrame:
    """``read_id, bin, s, e``: disjoint half-open stretches that each read's footprints cover, clipped to the window.

    Segments with ``r_start, r_end`` stand on the reference already (:func:`occuspan.operators.alignment.on_reference`);
    others are of reads that match the reference base by base from its start, so that their query offsets are its positions.
    Overlapping footprints of one read and bin count once. One shuffle by read; nothing is expanded to positions.
    """
    lo, hi = window
    start, end = (F.col("r_start"), F.col("r_end")) if "r_start" in segs.columns else (F.col("q_start"), F.col("q_start") + F.col("length"))
    c = segs.select("read_id", "bin", F.greatest(start, F.lit(lo)).alias("s"), F.least(end, F.lit(hi)).alias("e")).where("s < e")
    w = Window.partitionBy("read_id", "bin").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # what a stretch adds beyond everything that started before it
    return c.withColumn("s", F.greatest("s", F.coalesce(reach, F.lit(lo)))).where("s < e")


def coverage(segs: DataFrame, window=V.WINDOW) -> DataFrame:
    """``read_id, bin, pos``: each covered position once; bounds are clipped before the expansion."""
    return covered(segs, window).select("read_id", "bin", F.explode(F.sequence("s", F.col("e") - 1)).alias("pos"))


def spine(keys: DataFrame, window=V.WINDOW, bins=tuple(b[0] for b in V.BIN_SPEC)) -> DataFrame:
    """Every bin and position of the window for each row of ``keys``."""
    lo, hi = window
    return keys.withColumn("bin", F.explode(F.array(*[F.lit(b) for b in bins]))).withColumn("pos", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))


def depth_profile(cov: DataFrame, groups: list[str], totals: DataFrame, window=V.WINDOW) -> DataFrame:
    """``groups, bin, pos, n_reads, n_cov, occ`` on the whole spine, zeros included.

    Stretches become +1 and -1 at their ends and are summed per position before the shuffle, so what moves is at
    most window x bins rows a task and group, however many reads there are; a running sum gives the depth.
    """
    ends = F.explode(F.array(F.struct(F.col("s").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("e").alias("pos"), F.lit(-1).alias("d"))))
    steps = cov.select(*groups, "bin", ends.alias("x")).groupBy(*groups, "bin", F.col("x.pos").alias("pos")).agg(F.sum("x.d").alias("d"))
    full = spine(totals.select(*groups, "n_reads"), window).join(steps, [*groups, "bin", "pos"], "left")
    run = Window.partitionBy(*groups, "bin").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = full.withColumn("n_cov", F.coalesce(F.sum("d").over(run), F.lit(0)))
    return out.select(*groups, "bin", "pos", "n_reads", "n_cov", (F.col("n_cov") / F.col("n_reads")).alias("occ"))


def occupancy(mols: DataFrame, segs: DataFrame) -> DataFrame:
    """Mean occupancy of each variant, bin and position; the denominator is all molecules of the variant."""
    cov = covered(binned(segs)).join(mols.select("read_id", "variant_id"), "read_id")
    totals = mols.groupBy("variant_id").agg(F.count(F.lit(1)).alias("n_reads"))
    return depth_profile(cov, ["variant_id"], totals)


def delta(occ: DataFrame) -> DataFrame:
    """Each variant's occupancy less wild type's. Wild type's profile is window x bins rows, a fixed size."""
    wt = occ.where("variant_id = 'WT'").select("bin", "pos", F.col("occ").alias("wt_occ"))
    j = occ.where("variant_id <> 'WT'").join(wt, ["bin", "pos"])
    return j.select("variant_id", "bin", "pos", "n_reads", "wt_occ", (F.col("occ") - F.col("wt_occ")).alias("delta"))


def nc_distribution(read_nc: DataFrame) -> DataFrame:
    """``variant_id, nc, n, frac``; unknown counts (null, negative) are left out."""
    g = read_nc.where("nc >= 0").groupBy("variant_id", "nc").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("frac", F.col("n") / F.sum("n").over(Window.partitionBy("variant_id")))


def nc_range(reads: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Reads whose nucleosome count is in a range; unknown counts are dropped only if a bound is set."""
    if lo is None and hi is None:
        return reads
    keep = F.col("nc") >= 0
    keep = keep if lo is None else keep & (F.col("nc") >= lo)
    return reads.where(keep if hi is None else keep & (F.col("nc") <= hi))


def group_variants(reads: DataFrame, min_reads: int = 50, multi_to_first: bool = False) -> DataFrame:
    """``variant_id, n_reads`` of single-variant reads; reads of several variants may count for their first."""
    ids = V.tags.variant_ids(F.col("pv"))
    one = F.size(ids) >= 1 if multi_to_first else F.size(ids) == 1
    return reads.where(one & F.col("pv").isNotNull()).groupBy(F.element_at(ids, 1).alias("variant_id")).agg(F.count(F.lit(1)).alias("n_reads")).where(F.col("n_reads") >= min_reads)


def reweighted_reference(mols_nc: DataFrame, segs: DataFrame) -> DataFrame:
    """Wild type's occupancy standardised to each variant's nucleosome counts: ``variant_id, bin, pos, ref_occ``.

    Weights are renormalised over the counts that wild-type reads have.
    """
    wt = mols_nc.where("variant_id = 'WT'")
    cov = covered(binned(segs)).join(wt.select("read_id", "nc"), "read_id")
    by_nc = depth_profile(cov, ["nc"], wt.groupBy("nc").agg(F.count(F.lit(1)).alias("n_reads")))
    frac = nc_distribution(mols_nc).where("variant_id <> 'WT'").select("variant_id", "nc", "frac")
    j = by_nc.join(frac, "nc")
    return j.groupBy("variant_id", "bin", "pos").agg((F.sum(F.col("frac") * F.col("occ")) / F.sum("frac")).alias("ref_occ"))


def mde_of(p: Column, n: Column, z: float = Z) -> Column:
    """Smallest effect that n reads resolve at occupancy p."""
    q = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    return F.lit(z) * F.sqrt(q * (1 - q) / F.greatest(n, F.lit(1)))


def _occ(spark: SparkSession, d: str) -> DataFrame:
    return occupancy(V.molecules(spark, d), V.segments(spark, d))


def occupancy_profile(spark, d):
    return _occ(spark, d).withColumn("occ", F.round("occ", 9))


def delta_profile(spark, d):
    return delta(_occ(spark, d)).select("variant_id", "bin", "pos", F.round("delta", 9).alias("delta"))


def coverage_explode(spark, d):
    c = coverage(binned(V.segments(spark, d)))
    return c.groupBy("bin", "pos").agg(F.count(F.lit(1)).alias("n_reads"), F.sum("read_id").alias("id_sum"))


def bin_assign(spark, d):
    s = V.segments(spark, d).withColumn("bin", F.coalesce(V.bin_of(F.col("track"), F.col("length")), F.lit("none")))
    return s.groupBy("track", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("lo"), F.max("length").alias("hi"))


#: fixed values: the older bins, which ignore the track
LEGACY_BINS = (("sub_TF", 10, 19), ("TF", 20, 40), ("PIC", 41, 80), ("NUC", 81, None))


def bin_assign_legacy(spark, d):
    """The older bins by length alone, as a range join with the literal bin table."""
    bins = spark.createDataFrame([(b, lo, hi) for b, lo, hi in LEGACY_BINS], "bin string, lo int, hi int")
    s = V.segments(spark, d)
    j = s.join(F.broadcast(bins), (s["length"] >= bins["lo"]) & (bins["hi"].isNull() | (s["length"] <= bins["hi"])))
    return j.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("length").cast("long").alias("bases"))


def join_bin_range(spark, d):
    """Length ranges as an inequality join with the literal bin table (four rows)."""
    bins = spark.createDataFrame([(b, t, lo, hi) for b, t, lo, hi in V.BIN_SPEC], "bin string, bt string, lo int, hi int")
    s = V.segments(spark, d)
    j = s.join(F.broadcast(bins), (s["track"] == bins["bt"]) & (s["length"] >= bins["lo"]) & (s["length"] <= F.coalesce(bins["hi"], F.lit(1 << 30))))
    return j.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("length").cast("long").alias("bases"))


def nc_distribution_q(spark, d):
    return nc_distribution(V.read_nc(spark, d)).withColumn("frac", F.round("frac", 9))


def nc_range_filter(spark, d):
    return nc_range(V.calls(spark, d), 5, 12).groupBy("sample_id", "nc").agg(F.count(F.lit(1)).alias("n"))


def group_variants_q(spark, d):
    return group_variants(V.calls(spark, d), 20)


def group_variants_first(spark, d):
    return group_variants(V.calls(spark, d), 20, multi_to_first=True)


def nc_reweighted_reference(spark, d):
    r = reweighted_reference(V.read_nc(spark, d), V.segments(spark, d))
    return r.withColumn("ref_occ", F.round("ref_occ", 9))


def mde_q(spark, d):
    """Median smallest effect of each variant over positions 100 to 199 and all bins."""
    x = delta(_occ(spark, d)).where("pos between 100 and 199")
    return x.groupBy("variant_id").agg(F.round(F.percentile(mde_of(F.col("wt_occ"), F.col("n_reads")), F.lit(0.5)), 9).alias("mde_median"))


def wt_landscape(spark, d):
    return _occ(spark, d).where("variant_id = 'WT'").select("bin", "pos", F.round("occ", 9).alias("occ"))


def variant_compare(spark, d):
    """Two variants side by side: the two with most reads besides wild type, ties by id."""
    occ = _occ(spark, d)
    top = V.molecules(spark, d).where("variant_id <> 'WT'").groupBy("variant_id").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "variant_id").limit(2)
    named = top.groupBy().agg(F.array_sort(F.collect_list("variant_id")).alias("v"))
    x = occ.join(F.broadcast(named), F.array_contains(F.col("v"), F.col("variant_id")))
    side = lambda i: F.max(F.when(F.col("variant_id") == F.col("v")[i], F.col("occ")))
    return x.groupBy("bin", "pos").agg(F.round(side(0), 9).alias("occ_a"), F.round(side(1), 9).alias("occ_b"))


def heatmap_matrix(spark, d):
    """Variant by position for bin TF: the loss and the gain part of the effect."""
    x = delta(_occ(spark, d)).where("bin = 'TF'")
    return x.select("variant_id", "pos", F.round(F.when(F.col("delta") < 0, F.col("delta")).otherwise(0.0), 9).alias("loss"), F.round(F.when(F.col("delta") > 0, F.col("delta")).otherwise(0.0), 9).alias("gain"))


def variant_bin_summary(spark, d):
    x = delta(_occ(spark, d))
    return x.groupBy("variant_id", "bin").agg(F.round(F.max(F.abs("delta")), 9).alias("max_abs_delta"), F.count(F.when(F.abs("delta") > 0.02, 1)).alias("n_over"), F.round(F.avg("delta"), 8).alias("mean_delta"))


def volcano(spark, d):
    """Signed peak effect and -log10 p of each variant, from the library's summary and its calls."""
    from occuspan.session import table

    s = table(spark, d, "variant_summary").where("best_cluster_p is not null")
    c = V.cluster_rows(spark, d).groupBy("library", "variant_id").agg(F.max_by("mean_signed_delta", F.struct(F.abs("mean_signed_delta"), "cluster_id")).alias("peak"))
    return s.join(c, ["library", "variant_id"], "left").select("library", "variant_id", F.round(F.coalesce("peak", F.lit(0.0)), 9).alias("peak_delta"), F.round(V.tags.neg_log10(F.col("best_cluster_p")), 9).alias("neg_log10_p"), V.tags.stars(F.col("variant_fdr_q")).alias("stars"))


def pq_histogram(spark, d):
    """Counts of p and q in fifty bins; nulls and values out of [0, 1] are left out."""
    from occuspan.session import table

    s = table(spark, d, "variant_summary")
    both = s.select(F.explode(F.array(F.struct(F.lit("p").alias("kind"), F.col("best_cluster_p").alias("x")), F.struct(F.lit("q").alias("kind"), F.col("variant_fdr_q").alias("x")))).alias("r")).select("r.*")
    return both.where("x >= 0 and x <= 1").groupBy("kind", F.least(F.floor(F.col("x") * 50), F.lit(49)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "occupancy_profile": occupancy_profile,
    "delta_profile": delta_profile,
    "coverage_explode": coverage_explode,
    "bin_assign": bin_assign,
    "bin_assign_legacy": bin_assign_legacy,
    "join_bin_range": join_bin_range,
    "nc_distribution": nc_distribution_q,
    "nc_range_filter": nc_range_filter,
    "group_variants": group_variants_q,
    "group_variants_first": group_variants_first,
    "nc_reweighted_reference": nc_reweighted_reference,
    "mde": mde_q,
    "wt_landscape": wt_landscape,
    "variant_compare": variant_compare,
    "heatmap_matrix": heatmap_matrix,
    "variant_bin_summary": variant_bin_summary,
    "volcano": volcano,
    "pq_histogram": pq_histogram,
}

ORACLES = {
    "occupancy_profile": V.sql("occ", "select variant_id, bin, pos, n_reads, n_cov, round(occ, 9) as occ from occ"),
    "delta_profile": V.sql("delta", "select variant_id, bin, pos, round(delta, 9) as delta from delta"),
    "coverage_explode": V.sql("coverage", "select bin, pos, count(*) as n_reads, cast(sum(read_id) as bigint) as id_sum from coverage group by 1, 2"),
    "bin_assign": V.sql("binned", "select track, coalesce(bin, 'none') as bin, count(*) as n, min(length) as lo, max(length) as hi from binned group by 1, 2"),
    "bin_assign_legacy": V.sql(
        "segments",
        "select case when length <= 19 then 'sub_TF' when length <= 40 then 'TF' when length <= 80 then 'PIC' else 'NUC' end as bin, count(*) as n, cast(sum(length) as bigint) as bases from segments where length >= 10 group by 1",
    ),
    "join_bin_range": V.sql("binned", "select bin, count(*) as n, cast(sum(length) as bigint) as bases from binned where bin is not null group by 1"),
    "nc_distribution": V.sql("read_nc", "select variant_id, nc, count(*) as n, round(count(*) / sum(count(*)) over (partition by variant_id), 9) as frac from read_nc where nc >= 0 group by 1, 2"),
    "nc_range_filter": V.sql("calls", "select sample_id, nc, count(*) as n from calls where nc between 5 and 12 group by 1, 2"),
    "group_variants": V.sql("calls", f"select ids[1] as variant_id, count(*) as n_reads from (select {V.ids_sql('pv')} as ids from calls where pv is not null) where len(ids) = 1 group by 1 having count(*) >= 20"),
    "group_variants_first": V.sql("calls", f"select ids[1] as variant_id, count(*) as n_reads from (select {V.ids_sql('pv')} as ids from calls where pv is not null) where len(ids) >= 1 group by 1 having count(*) >= 20"),
    "nc_reweighted_reference": V.sql(
        "read_nc coverage spine",
        """
with wt_n as (select nc, count(*) as n from read_nc where variant_id = 'WT' group by 1),
wt_c as (select nc, bin, pos, count(*) as k from coverage join read_nc using (read_id) where variant_id = 'WT' group by all),
wt_occ as (select n.nc, s.bin, s.pos, coalesce(k, 0) / n.n as occ from wt_n n cross join spine s left join wt_c c on c.nc = n.nc and c.bin = s.bin and c.pos = s.pos),
fr as (select variant_id, nc, count(*) / sum(count(*)) over (partition by variant_id) as frac from read_nc where variant_id <> 'WT' and nc >= 0 group by 1, 2)
select variant_id, bin, pos, round(sum(frac * occ) / sum(frac), 9) as ref_occ from wt_occ join fr using (nc) group by 1, 2, 3""",
    ),
    "mde": V.sql("delta", f"select variant_id, round(quantile_cont({Z!r} * sqrt(wt_occ * (1 - wt_occ) / n_reads), 0.5), 9) as mde_median from delta where pos between 100 and 199 group by 1"),
    "wt_landscape": V.sql("occ", "select bin, pos, round(occ, 9) as occ from occ where variant_id = 'WT'"),
    "variant_compare": V.sql(
        "occ",
        """
with top as (select variant_id, row_number() over (order by variant_id) as i from (
  select variant_id from molecules where variant_id <> 'WT' group by 1 order by count(*) desc, variant_id limit 2))
select bin, pos, round(max(occ) filter (i = 1), 9) as occ_a, round(max(occ) filter (i = 2), 9) as occ_b from occ join top using (variant_id) group by 1, 2""",
    ),
    "heatmap_matrix": V.sql("delta", "select variant_id, pos, round(least(delta, 0), 9) as loss, round(greatest(delta, 0), 9) as gain from delta where bin = 'TF'"),
    "variant_bin_summary": V.sql("delta", "select variant_id, bin, round(max(abs(delta)), 9) as max_abs_delta, count(*) filter (abs(delta) > 0.02) as n_over, round(avg(delta), 8) as mean_delta from delta group by 1, 2"),
    "volcano": V.sql(
        "cluster_rows",
        """
with c as (select library, variant_id, mean_signed_delta as peak from (select *, row_number() over (partition by library, variant_id
  order by abs(mean_signed_delta) desc nulls last, cluster_id desc) as k from cluster_rows) where k = 1)
select s.library, s.variant_id, round(coalesce(peak, 0), 9) as peak_delta, round(-log10(greatest(best_cluster_p, 1e-10)), 9) as neg_log10_p,
  case when variant_fdr_q < 0.05 then '***' when variant_fdr_q < 0.1 then '**' when variant_fdr_q < 0.2 then '*' else '' end as stars
from variant_summary s left join c on c.library = s.library and c.variant_id = s.variant_id where best_cluster_p is not null""",
    ),
    "pq_histogram": """
with x as (select 'p' as kind, best_cluster_p as x from variant_summary union all select 'q', variant_fdr_q from variant_summary)
select kind, cast(least(floor(x * 50), 49) as int) as bucket, count(*) as n from x where x >= 0 and x <= 1 group by 1, 2""",
}
