"""Counts, consensus calls and summary statistics of stage two, and the statistics of single-variant quality control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from occuspan.functions import tags
from occuspan.operators import occupancy as O
from occuspan.session import table, written
from occuspan.sources import views as V


def with_ids(calls: DataFrame, tag: str = "pv") -> DataFrame:
    return calls.where(F.col(tag).isNotNull()).withColumn("ids", tags.variant_ids(F.col(tag)))


def read_class_counts(spark, d):
    """Wild-type, single- and multi-variant reads of each sample."""
    n = F.size("ids")
    c = with_ids(V.calls(spark, d)).groupBy("sample_id")
    return c.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(n == 0, 1)).alias("wt"), F.count(F.when(n == 1, 1)).alias("single"), F.count(F.when(n > 1, 1)).alias("multi"), F.max(n).alias("most"))


def variant_counts(spark, d):
    """Reads, and raw reads, of each variant id; partial counts precede the shuffle."""
    v = with_ids(V.calls(spark, d)).select(F.explode("ids").alias("variant_id"))
    v = v.groupBy("variant_id").agg(F.count(F.lit(1)).alias("n_reads"))
    p = tags.parse_variant_id(F.col("variant_id"))
    return v.select("variant_id", p["position"].alias("position"), p["change_type"].alias("change_type"), "n_reads")


def variant_type_counts(spark, d):
    v = variant_counts(spark, d)
    return v.groupBy("change_type").agg(F.count(F.lit(1)).alias("n_variants"), F.sum("n_reads").alias("n_calls"), F.countDistinct("position").alias("n_positions"))


def titv(spark, d):
    """Transitions to transversions of each library's distinct SNVs; infinite where there is no transversion."""
    s = table(spark, d, "variant_summary").where("change_type = 'snv'").select("library", tags.is_transition(F.col("ref"), F.col("alt")).alias("ti"))
    g = s.groupBy("library").agg(F.count(F.when(F.col("ti"), 1)).alias("n_ti"), F.count(F.when(~F.col("ti"), 1)).alias("n_tv"))
    return g.withColumn("ratio", F.round(F.when(F.col("n_tv") > 0, F.col("n_ti") / F.col("n_tv")).otherwise(F.lit(float("inf"))), 9))


def barcode_tag_counts(spark, d):
    return V.calls(spark, d).where("bc is not null and pv is not null").groupBy("sample_id", "bc", "pv").agg(F.count(F.lit(1)).alias("n"))


def variants_report(spark, d):
    """Reads and distinct barcodes of each exact single-variant tag, and of each variant in any tag."""
    c = with_ids(V.calls(spark, d))
    per = c.select(F.explode("ids").alias("variant_id")).groupBy("variant_id").agg(F.count(F.lit(1)).alias("n_reads"))
    one = c.where(F.size("ids") == 1).groupBy(F.col("ids")[0].alias("variant_id")).agg(F.countDistinct("bc").alias("n_barcodes"))
    return per.join(one, "variant_id", "left").select("variant_id", "n_reads", F.coalesce("n_barcodes", F.lit(0)).alias("n_barcodes"))


def consensus(reads: DataFrame, keys: list[str], ids: str, min_frequency: float = 0.6, min_indel: int = 2) -> DataFrame:
    """Consensus of each cluster: ``keys, n_reads, consensus (sorted ids), support, is_ambiguous``.

    An id is kept if it is in at least ``min_frequency`` of the cluster's reads, an indel also in ``min_indel``
    reads. Support is the share of reads whose set of ids equals the consensus. Reads are first counted by their
    set of ids, so a cluster with very many reads is reduced before the shuffle and never stands in one array.
    """
    sets = reads.groupBy(*keys, F.array_sort(F.array_distinct(F.col(ids))).alias("_set")).agg(F.count(F.lit(1)).alias("_k"))
    total = sets.groupBy(*keys).agg(F.sum("_k").alias("n_reads"))
    per = sets.select(*keys, F.explode("_set").alias("_id"), "_k").groupBy(*keys, "_id").agg(F.sum("_k").alias("_c"))
    need = F.when(tags.is_indel(F.col("_id")), F.col("_c") >= min_indel).otherwise(F.lit(True))
    keep = per.join(total, keys).where((F.col("_c") / F.col("n_reads") >= min_frequency) & need)
    cons = keep.groupBy(*keys).agg(F.array_sort(F.collect_set("_id")).alias("_cons"))
    both = total.join(cons, keys, "left").withColumn("consensus", F.coalesce("_cons", F.array().cast("array<string>"))).drop("_cons")
    hit = sets.join(both, keys).groupBy(*keys).agg(F.sum(F.when(F.col("_set") == F.col("consensus"), F.col("_k")).otherwise(0)).alias("_m"))
    s = F.col("_m") / F.col("n_reads")
    return both.join(hit, keys).select(*keys, "n_reads", "consensus", s.alias("support"), ((s < 0.5) & (F.col("n_reads") > 1)).alias("is_ambiguous"))


def _raw(spark, d) -> DataFrame:
    """Reads with a centroid, and the ids of their raw calls."""
    c = V.calls(spark, d).where("bk is not null and pr is not null")
    return c.withColumn("ids", tags.variant_ids(F.col("pr")))


def consensus_variants(spark, d):
    c = consensus(_raw(spark, d), ["sample_id", "bk"], "ids")
    return c.select("sample_id", "bk", "n_reads", tags.raw_tag(F.col("consensus")).alias("tag"), F.round("support", 9).alias("support"), "is_ambiguous")


def cluster_resolution(spark, d):
    """Clusters by size and state: a cluster of one barcode and one read has low confidence."""
    c = consensus(_raw(spark, d), ["sample_id", "bk"], "ids")
    size = _raw(spark, d).groupBy("sample_id", "bk").agg(F.countDistinct("bc").alias("size"))
    j = c.join(size, ["sample_id", "bk"])
    return j.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_ambiguous"), 1)).alias("ambiguous"), F.count(F.when((F.col("size") <= 1) & (F.col("n_reads") <= 1), 1)).alias("low_confidence"))


def consensus_corrections(spark, d):
    """Clusters with at least one read whose raw tag is not the consensus: majority tag, ids removed and added, and the share of reads corrected."""
    keys = ["sample_id", "bk"]
    raw = _raw(spark, d)
    cons = consensus(raw, keys, "ids").select(*keys, "consensus", tags.raw_tag(F.col("consensus")).alias("cons_tag"), "n_reads")
    tag = tags.raw_tag(F.col("ids"))
    t = raw.withColumn("tag", tag).groupBy(*keys, "tag", "ids").agg(F.count(F.lit(1)).alias("k"), F.min("ordinal").alias("first"))
    g = t.join(cons, keys).groupBy(*keys, "cons_tag", "consensus", "n_reads").agg(
        F.max_by("tag", F.struct("k", -F.col("first"))).alias("raw_tag"), F.sum(F.when(F.col("tag") != F.col("cons_tag"), F.col("k")).otherwise(0)).alias("corrected"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("seen")
    )
    g = g.where("corrected > 0")
    return g.select(
        *keys, "raw_tag", F.col("cons_tag").alias("consensus_tag"), "n_reads", "corrected", F.round(F.col("corrected") / F.col("n_reads"), 9).alias("rate"),
        F.array_join(F.array_sort(F.array_except("seen", "consensus")), "|").alias("removed"), F.array_join(F.array_sort(F.array_except("consensus", "seen")), "|").alias("added"),
    )


def expected_coverage(spark, d):
    """Observed and possible variants of each library: 3, 4 and 1 of a promoter position, one base each."""
    s = table(spark, d, "variant_summary")
    length = table(spark, d, "samples").groupBy("library").agg(F.max(F.col("promoter_end") - F.col("promoter_start") + 1).alias("len"))
    one = F.regexp_extract("variant_id", r":\+?(.*)$", 1)
    g = s.groupBy("library").agg(
        F.countDistinct(F.when(F.col("change_type") == "snv", F.col("variant_id"))).alias("snv"),
        F.countDistinct(F.when((F.col("change_type") == "ins") & (F.length(one) == 1), F.col("variant_id"))).alias("ins"),
        F.countDistinct(F.when((F.col("change_type") == "del") & F.col("variant_id").rlike(r":1[A-Za-z]"), F.col("variant_id"))).alias("del"),
    )
    j = g.join(length, "library")
    pct = lambda c, k: F.round(F.col(c) / (F.col("len") * k) * 100, 9).alias(f"{c}_pct")
    return j.select("library", "len", "snv", "ins", "del", pct("snv", 3), pct("ins", 4), pct("del", 1))


def stats_report(spark, d):
    """Stage-two totals as metric and value rows."""
    c = with_ids(V.calls(spark, d)).agg(
        F.count(F.lit(1)).alias("reads"), F.count(F.when(F.size("ids") == 0, 1)).alias("wild_type"), F.countDistinct("bc").alias("barcodes"), F.countDistinct("bk").alias("centroids"), F.sum(F.size("ids")).alias("calls")
    )
    return c.unpivot([], ["reads", "wild_type", "barcodes", "centroids", "calls"], "metric", "value")


def top_cluster(spark, d):
    """The call of greatest summed effect of each library, variant and bin; ties by least id."""
    c = V.cluster_rows(spark, d).where("sum_abs_delta is not null")
    g = c.groupBy("library", "variant_id", "bin").agg(F.max_by(F.struct("cluster_id", "abs_start", "abs_end", "sum_abs_delta", "direction"), F.struct("sum_abs_delta", -F.col("cluster_id"))).alias("c"), F.count(F.lit(1)).alias("n_clusters"))
    return g.select("library", "variant_id", "bin", "n_clusters", "c.*")


def topk_variants(spark, d):
    """The twenty variants of each library with the least p, then least id."""
    s = table(spark, d, "variant_summary").where("best_cluster_p is not null")
    w = Window.partitionBy("library").orderBy("best_cluster_p", "variant_id")
    return s.withColumn("k", F.row_number().over(w)).where("k <= 20").select("library", "variant_id", "best_cluster_p", "k")


def summary_pivot(spark, d):
    """One row for each library and variant with the calls and the greatest effect of each bin side by side."""
    c = V.cluster_rows(spark, d)
    p = c.groupBy("library", "variant_id").pivot("bin", ["sub_TF", "TF", "PIC", "nuc"]).agg(F.count(F.lit(1)).alias("n"), F.max("max_abs_delta").alias("top"))
    n = lambda b: F.coalesce(F.col(f"{b}_n"), F.lit(0)).alias(f"{b}_n")
    return p.select("library", "variant_id", *[x for b in ("sub_TF", "TF", "PIC", "nuc") for x in (n(b), F.format_string("%.4f", F.col(f"{b}_top")).alias(f"{b}_top"))])


def secondary_freq(spark, d):
    """For each single-variant group of reads, the most frequent other raw call and its share."""
    c = V.calls(spark, d).where("pv is not null and pr is not null")
    c = c.withColumn("a", tags.variant_ids(F.col("pv"))).where(F.size("a") == 1)
    c = c.select(F.col("a")[0].alias("variant_id"), F.array_except(tags.variant_ids(F.col("pr")), F.col("a")).alias("other"))
    n = c.groupBy("variant_id").agg(F.count(F.lit(1)).alias("n_reads"))
    o = c.select("variant_id", F.explode("other").alias("o")).groupBy("variant_id", "o").agg(F.count(F.lit(1)).alias("k"))
    m = o.groupBy("variant_id").agg(F.max("k").alias("top_k"), F.count(F.lit(1)).alias("n_distinct"))
    return n.join(m, "variant_id", "left").select("variant_id", "n_reads", F.round(F.coalesce(F.col("top_k") / F.col("n_reads"), F.lit(0.0)), 9).alias("max_freq"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def empirical_p_of(observed: DataFrame, null: DataFrame, keys: list[str], value: str, draw: str) -> DataFrame:
    """(number of null draws at least as great + 1) / (draws + 1) of each observation; no draws give p = 1.

    Draws are never sorted: each is placed among its key's distinct observations, and places are counted in every task
    before the shuffle, so a key with very many draws costs what its observations cost. Null values are left out.
    """
    o = observed.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_set(F.col(value).cast("double"))).alias("_obs"))
    n = null.where(F.col(draw).isNotNull()).select(*keys, F.col(draw).cast("double").alias("_v"))
    place = F.size(F.filter("_obs", lambda x: x <= F.col("_v")))
    k = n.join(o, keys).select(*keys, place.alias("_r")).groupBy(*keys, "_r").agg(F.count(F.lit(1)).alias("_k"))
    k = k.groupBy(*keys).agg(F.collect_list(F.struct("_r", "_k")).alias("_places"), F.sum("_k").alias("n"))
    each = o.select(*keys, F.posexplode("_obs").alias("_i", value)).join(k, keys, "left")
    ge = F.aggregate(F.filter("_places", lambda x: x["_r"] > F.col("_i")), F.lit(0).cast("long"), lambda s, x: s + x["_k"])
    total = F.coalesce("n", F.lit(0).cast("long"))
    return each.select(*keys, value, ((F.coalesce(ge, F.lit(0)) + 1) / (total + 1)).alias("p"), total.alias("n"))


def empirical_p(spark, d):
    """Each variant's greatest summed effect in a bin against that variant's and bin's null maxima."""
    obs = V.cluster_rows(spark, d).where("sum_abs_delta is not null").groupBy("variant_id", F.col("bin").alias("bin_label")).agg(F.max("sum_abs_delta").alias("obs"))
    nc = table(spark, d, "null_calibration").select("calib_id", "variant_id", "bin_label", "null_max_cluster_sums").where("null_max_cluster_sums >= 0 and null_max_cluster_sums < double('inf')").dropDuplicates(["calib_id"])
    return empirical_p_of(obs, nc, ["variant_id", "bin_label"], "obs", "null_max_cluster_sums").withColumn("p", F.round("p", 9))


def nc_ks_chi2(spark, d):
    """Two-sample KS distance and chi-square of nucleosome counts of each variant against wild type.

    The chi-square takes counts whose expectation is at least 5 and rescales it to the observed total of those.
    """
    nd = O.nc_distribution(V.read_nc(spark, d))
    names = nd.select("variant_id").distinct()
    lo_hi = nd.agg(F.max("nc").alias("hi"))
    grid = names.join(F.broadcast(lo_hi)).select("variant_id", F.explode(F.sequence(F.lit(0), "hi")).alias("nc"))
    full = grid.join(nd, ["variant_id", "nc"], "left").select("variant_id", "nc", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("frac", F.lit(0.0)).alias("frac"))
    full = full.withColumn("cdf", F.sum("frac").over(Window.partitionBy("variant_id").orderBy("nc").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy("variant_id")))
    wt = full.where("variant_id = 'WT'").select("nc", F.col("frac").alias("wf"), F.col("cdf").alias("wc"))
    j = full.where("variant_id <> 'WT'").join(wt, "nc").withColumn("exp", F.col("wf") * F.col("total"))
    ok = F.col("exp") >= 5
    g = j.groupBy("variant_id").agg(F.max(F.abs(F.col("cdf") - F.col("wc"))).alias("ks"), F.count(F.when(ok, 1)).alias("n_bins"), F.sum(F.when(ok, F.col("n"))).alias("o"), F.sum(F.when(ok, F.col("exp"))).alias("e"), F.sum(F.when(ok, F.col("n") * F.col("n") / F.col("exp"))).alias("oo"))
    # sum (n - exp*o/e)^2 / (exp*o/e) = e/o * sum n^2/exp - o
    chi = F.when(F.col("n_bins") >= 2, F.col("e") / F.col("o") * F.col("oo") - F.col("o"))
    return g.select("variant_id", F.round("ks", 9).alias("ks"), "n_bins", F.round(chi, 6).alias("chi2"))


def distance_decay(spark, d):
    """Mean absolute effect of calls by their distance to the variant, in steps of fifty bases; unknown distances left out."""
    c = V.cluster_rows(spark, d).where("variant_distance <> -999999")
    return c.groupBy("bin", (F.floor(F.abs("variant_distance") / 50) * 50).cast("int").alias("distance")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("max_abs_delta"), 9).alias("mean_effect"))


def at_density(spark, d):
    """Rolling share of A and T over 21 reference bases of each library's known positions."""
    s = table(spark, d, "variant_summary").where("change_type = 'snv' and position is not null").groupBy("library", "position").agg(F.min(F.upper("ref")).alias("base"))
    w = Window.partitionBy("library").orderBy("position").rowsBetween(-10, 10)
    return s.select("library", "position", F.round(F.avg(F.when(F.col("base").isin("A", "T"), 1.0).otherwise(0.0)).over(w), 9).alias("at"))


def percentiles(df: DataFrame, keys: list[str], value: str, qs: tuple[float, ...], buckets: int = 4096) -> DataFrame:
    """``keys, n, p``: exact percentiles of each group, by linear interpolation between ranks; nulls and NaN are left out, null keys are a group.

    Each group's range is cut into equal buckets, whose counts are added up before the shuffle and give the buckets
    that hold the wanted ranks; only the distinct values of those buckets are then counted and ordered. So no task
    holds a group, however large it is. ``df`` is read three times and should be a written table.
    """
    x = F.col(value).cast("double")
    d = df.where(x.isNotNull() & ~F.isnan(x)).select(*keys, x.alias("_x"))
    same = lambda k: [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in k]
    b = d.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("n"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(buckets - 1), F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets))).otherwise(0).cast("int")
    d = d.join(b, same(keys)).select(*keys, "_x", at.alias("_b"))
    h = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_k"))
    h = h.withColumn("_before", F.sum("_k").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_k"))
    rank = lambda q: F.lit(q) * (F.col("n") - 1)
    want = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), (F.floor(rank(q)) if side == 0 else F.ceil(rank(q))).cast("long").alias("r")) for i, q in enumerate(qs) for side in (0, 1)])
    r = b.select(*[f"_key_{k}" for k in keys], F.explode(want).alias("w")).select(*[f"_key_{k}" for k in keys], "w.*")
    need = h.join(r, same(keys)).where((F.col("r") >= F.col("_before")) & (F.col("r") < F.col("_before") + F.col("_k"))).select(*keys, "_b", "i", "side", (F.col("r") - F.col("_before")).alias("_r"))
    spots = need.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_b").alias("__b")).distinct()
    v = d.join(spots, [*same(keys), F.col("_b") == F.col("__b")], "left_semi").groupBy(*keys, "_b", "_x").agg(F.count(F.lit(1)).alias("_k"))
    v = v.withColumn("_before", F.sum("_k").over(Window.partitionBy(*keys, "_b").orderBy("_x")) - F.col("_k"))
    found = v.join(need.withColumnsRenamed({**{k: f"_key_{k}" for k in keys}, "_b": "__b"}), [*same(keys), F.col("_b") == F.col("__b")])
    found = found.where((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_k"))).groupBy(*keys, "i").agg(F.max(F.when(F.col("side") == 0, F.col("_x"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("_x"))).alias("z"))
    j = found.join(b, same(keys)).withColumn("_t", F.element_at(F.array(*[F.lit(float(q)) for q in qs]), F.col("i") + 1) * (F.col("n") - 1))
    part = F.col("_t") - F.floor("_t")
    j = j.select(*keys, "n", "i", F.when(part == 0, F.col("a")).otherwise(F.col("a") * (1 - part) + F.col("z") * part).alias("p"))
    return j.groupBy(*keys, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda y: y["p"]).alias("p"))


def null_percentiles(spark, d):
    """Exact percentiles of the null draws of each bin, for comparison with the digests."""
    n = table(spark, d, "null_calibration").select("calib_id", "bin_label", "null_delta").where("null_delta between -1 and 1").dropDuplicates(["calib_id"])
    p = percentiles(written(n.select("bin_label", F.abs(F.col("null_delta").cast("double")).alias("x"))), ["bin_label"], "x", (0.5, 0.95))
    return p.select("bin_label", "n", F.round(F.col("p")[0], 9).alias("p50"), F.round(F.col("p")[1], 9).alias("p95"))


def contig_nc_histogram(spark, d):
    """Reads of each contig by nucleosome count, and their mean length."""
    j = V.read_nc(spark, d).join(V.reads_meta(spark, d).select("read_id", "rname", "qlen"), "read_id")
    return j.groupBy("rname", tags.classify_contig(F.col("rname")).alias("kind"), "nc").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("qlen"), 6).alias("mean_qlen"))


def variants_per_read(spark, d):
    """Histogram of the number of raw calls and of consensus calls of a read."""
    c = V.calls(spark, d).where("pv is not null and pr is not null")
    return c.groupBy(F.size(tags.variant_ids(F.col("pr"))).alias("n_raw"), F.size(tags.variant_ids(F.col("pv"))).alias("n_consensus")).agg(F.count(F.lit(1)).alias("n_reads"))


def metric_clamp(spark, d):
    """Colour range of each library: the 99th percentile of absolute effects, with the share of values beyond it."""
    c = V.cluster_rows(spark, d).select("library", F.abs("mean_signed_delta").alias("x")).where("x is not null")
    c = written(c)
    top = percentiles(c, ["library"], "x", (0.99,)).select("library", F.col("p")[0].alias("top"), "n")
    k = c.join(top, "library").groupBy("library").agg(F.count(F.when(F.col("x") > F.col("top"), 1)).alias("beyond"))
    return top.join(k, "library").select("library", F.round("top", 9).alias("top"), "n", "beyond")


def barcode_lengths(spark, d):
    """Reads and distinct barcodes of each sample by barcode length, with the mean barcode quality."""
    c = V.calls(spark, d).where("bc is not null")
    return c.groupBy("sample_id", F.length("bc").alias("len")).agg(F.count(F.lit(1)).alias("n_reads"), F.countDistinct("bc").alias("n_barcodes"), F.round(F.avg("bq"), 9).alias("mean_bq"))


def nc_by_tag(spark, d):
    """Mean nucleosome count of reads by number of variants, unknown counts left out."""
    c = with_ids(V.calls(spark, d)).where("nc >= 0")
    return c.groupBy("sample_id", F.least(F.size("ids"), F.lit(2)).alias("n_variants")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("nc"), 9).alias("mean_nc"))


QUERIES = {
    f.__name__: f
    for f in (
        contig_nc_histogram, variants_per_read, metric_clamp, barcode_lengths, nc_by_tag,
        read_class_counts, variant_counts, variant_type_counts, titv, barcode_tag_counts, variants_report, consensus_variants, cluster_resolution, consensus_corrections,
        expected_coverage, stats_report, top_cluster, topk_variants, summary_pivot, secondary_freq, empirical_p, nc_ks_chi2, distance_decay, at_density, null_percentiles,
    )
}

_IDS = f"x as (select *, {V.ids_sql('pv')} as ids from calls where pv is not null)"
_RAW = f"""raw_ as (select sample_id, bk, bc, ordinal, {V.ids_sql('pr')} as ids from calls where bk is not null and pr is not null),
tot as (select sample_id, bk, count(*) as n_reads from raw_ group by 1, 2),
per as (select sample_id, bk, id, count(*) as c from (select sample_id, bk, ordinal, unnest(list_distinct(ids)) as id from raw_) group by 1, 2, 3),
cons as (select sample_id, bk, list_sort(list(id)) as ids from per join tot using (sample_id, bk)
  where c / n_reads >= 0.6 and (c >= 2 or not (contains(id, '+') or (contains(id, ':') and not contains(id, '>')))) group by 1, 2),
res as (select t.sample_id, t.bk, t.n_reads, coalesce(c.ids, []) as ids from tot t left join cons c on c.sample_id = t.sample_id and c.bk = t.bk),
sup as (select r.sample_id, r.bk, count(*) filter (list_sort(list_distinct(w.ids)) = r.ids) / any_value(r.n_reads) as support from res r join raw_ w on w.sample_id = r.sample_id and w.bk = r.bk group by 1, 2)"""
_TAG = "case when len({0}) = 0 then 'WT' else concat('[\"', array_to_string(list_sort({0}), '\", \"'), '\"]') end"

ORACLES = {
    "contig_nc_histogram": V.sql("read_nc reads_meta", "select rname, case rname when 'chr1' then 'genomic' when 'plasmidA' then 'plasmid' else 'skip' end as kind, nc, count(*) as n, round(avg(qlen), 6) as mean_qlen from read_nc join reads_meta using (read_id) group by 1, 2, 3"),
    "variants_per_read": V.sql("calls", f"select len({V.ids_sql('pr')}) as n_raw, len({V.ids_sql('pv')}) as n_consensus, count(*) as n_reads from calls where pv is not null and pr is not null group by 1, 2"),
    "metric_clamp": V.sql(
        "cluster_rows",
        """with x as (select library, abs(mean_signed_delta) as x from cluster_rows where mean_signed_delta is not null),
t as (select library, quantile_cont(x, 0.99) as top, count(*) as n from x group by 1)
select t.library, round(t.top, 9) as top, n, count(*) filter (x.x > t.top) as beyond from x join t on t.library = x.library group by 1, 2, 3, t.top""",
    ),
    "barcode_lengths": V.sql("calls", "select sample_id, length(bc) as len, count(*) as n_reads, count(distinct bc) as n_barcodes, round(avg(bq), 9) as mean_bq from calls where bc is not null group by 1, 2"),
    "nc_by_tag": V.sql("calls", f"select sample_id, least(len(ids), 2) as n_variants, count(*) as n, round(avg(nc), 9) as mean_nc from (select sample_id, nc, {V.ids_sql('pv')} as ids from calls where pv is not null and nc >= 0) group by 1, 2"),
    "read_class_counts": V.sql("calls", f"with {_IDS} select sample_id, count(*) as n, count(*) filter (len(ids) = 0) as wt, count(*) filter (len(ids) = 1) as single, count(*) filter (len(ids) > 1) as multi, max(len(ids)) as most from x group by 1"),
    "variant_counts": V.sql(
        "calls",
        rf"""with {_IDS}, v as (select unnest(ids) as variant_id from x)
select variant_id, cast(nullif(regexp_extract(variant_id, '^(\d+):', 1), '') as int) as position, case when not regexp_matches(variant_id, '^\d+:') then null
  when regexp_matches(variant_id, '^\d+:[ACGTacgt]>[ACGTacgt]') then 'snv' when regexp_matches(variant_id, '^\d+:\+[ACGTacgt]') then 'ins'
  when regexp_matches(variant_id, '^\d+:\d+[ACGTacgt]') then 'del' else 'unknown' end as change_type, count(*) as n_reads from v group by 1, 2, 3""",
    ),
    "titv": """
with s as (select library, concat(upper(ref), upper(alt)) in ('AG', 'GA', 'CT', 'TC') as ti from variant_summary where change_type = 'snv')
select library, count(*) filter (ti) as n_ti, count(*) filter (not ti) as n_tv, round(case when count(*) filter (not ti) > 0 then count(*) filter (ti) / count(*) filter (not ti) else 'inf'::double end, 9) as ratio from s group by 1""",
    "barcode_tag_counts": V.sql("calls", "select sample_id, bc, pv, count(*) as n from calls where bc is not null and pv is not null group by 1, 2, 3"),
    "variants_report": V.sql(
        "calls",
        f"""with {_IDS}, per as (select variant_id, count(*) as n_reads from (select unnest(ids) as variant_id from x) group by 1),
one as (select ids[1] as variant_id, count(distinct bc) as n_barcodes from x where len(ids) = 1 group by 1)
select variant_id, n_reads, coalesce(n_barcodes, 0) as n_barcodes from per left join one using (variant_id)""",
    ),
    "consensus_variants": V.sql("calls", f"with {_RAW} select sample_id, bk, n_reads, {_TAG.format('ids')} as tag, round(support, 9) as support, support < 0.5 and n_reads > 1 as is_ambiguous from res join sup using (sample_id, bk)"),
    "cluster_resolution": V.sql(
        "calls",
        f"""with {_RAW}, z as (select sample_id, bk, count(distinct bc) as size from raw_ group by 1, 2)
select size, count(*) as n, count(*) filter (support < 0.5 and n_reads > 1) as ambiguous, count(*) filter (size <= 1 and n_reads <= 1) as low_confidence
from res join sup using (sample_id, bk) join z using (sample_id, bk) group by 1""",
    ),
    "consensus_corrections": V.sql(
        "calls",
        f"""with {_RAW}, t as (select w.sample_id, w.bk, {_TAG.format('w.ids')} as tag, {_TAG.format('r.ids')} as cons_tag, r.ids as cons_ids, n_reads, w.ids, w.ordinal
  from raw_ w join res r on r.sample_id = w.sample_id and r.bk = w.bk),
m as (select sample_id, bk, tag, row_number() over (partition by sample_id, bk order by count(*) desc, min(ordinal)) as k from t group by 1, 2, 3),
g as (select sample_id, bk, any_value(cons_tag) as consensus_tag, any_value(cons_ids) as cons_ids, any_value(n_reads) as n_reads, count(*) filter (tag <> cons_tag) as corrected, list_distinct(flatten(list(ids))) as seen from t group by 1, 2)
select g.sample_id, g.bk, m.tag as raw_tag, consensus_tag, n_reads, corrected, round(corrected / n_reads, 9) as rate,
  coalesce(array_to_string(list_sort(list_filter(seen, lambda v: not list_contains(cons_ids, v))), '|'), '') as removed,
  coalesce(array_to_string(list_sort(list_filter(cons_ids, lambda v: not list_contains(seen, v))), '|'), '') as added
from g join m on m.sample_id = g.sample_id and m.bk = g.bk and m.k = 1 where corrected > 0""",
    ),
    "expected_coverage": r"""
with g as (select library, count(distinct variant_id) filter (change_type = 'snv') as snv,
    count(distinct variant_id) filter (change_type = 'ins' and regexp_matches(variant_id, ':\+?.$')) as ins,
    count(distinct variant_id) filter (change_type = 'del' and regexp_matches(variant_id, ':1[A-Za-z]')) as del from variant_summary group by 1),
l as (select library, max(promoter_end - promoter_start + 1) as len from samples group by 1)
select library, len, snv, ins, del, round(snv / (len * 3) * 100, 9) as snv_pct, round(ins / (len * 4) * 100, 9) as ins_pct, round(del / len * 100, 9) as del_pct from g join l using (library)""",
    "stats_report": V.sql(
        "calls",
        f"""with {_IDS} select unnest(['reads', 'wild_type', 'barcodes', 'centroids', 'calls']) as metric,
  unnest([count(*), count(*) filter (len(ids) = 0), count(distinct bc), count(distinct bk), cast(sum(len(ids)) as bigint)]) as value from x""",
    ),
    "top_cluster": V.sql(
        "cluster_rows",
        """select library, variant_id, bin, n_clusters, cluster_id, abs_start, abs_end, sum_abs_delta, direction from (
  select *, row_number() over (partition by library, variant_id, bin order by sum_abs_delta desc, cluster_id) as k, count(*) over (partition by library, variant_id, bin) as n_clusters
  from cluster_rows where sum_abs_delta is not null) where k = 1""",
    ),
    "topk_variants": "select * from (select library, variant_id, best_cluster_p, row_number() over (partition by library order by best_cluster_p, variant_id) as k from variant_summary where best_cluster_p is not null) where k <= 20",
    "summary_pivot": V.sql(
        "cluster_rows",
        "select library, variant_id, " + ", ".join(f"count(*) filter (bin = '{b}') as \"{b}_n\", coalesce(printf('%.4f', max(max_abs_delta) filter (bin = '{b}')), 'null') as \"{b}_top\"" for b in ("sub_TF", "TF", "PIC", "nuc")) + " from cluster_rows group by 1, 2",
    ),
    "secondary_freq": V.sql(
        "calls",
        f"""with x as (select ordinal, {V.ids_sql('pv')} as a, {V.ids_sql('pr')} as b from calls where pv is not null and pr is not null),
y as (select ordinal, a[1] as variant_id, list_distinct(list_filter(b, lambda v: not list_contains(a, v))) as o from x where len(a) = 1),
n as (select variant_id, count(*) as n_reads from y group by 1),
k as (select variant_id, o_, count(*) as k from (select variant_id, unnest(o) as o_ from y) group by 1, 2)
select n.variant_id, n_reads, round(coalesce(max(k) / any_value(n_reads), 0), 9) as max_freq, count(k) as n_distinct from n left join k on k.variant_id = n.variant_id group by 1, 2""",
    ),
    "empirical_p": V.sql(
        "cluster_rows",
        """with o as (select variant_id, bin as bin_label, max(sum_abs_delta) as obs from cluster_rows where sum_abs_delta is not null group by 1, 2),
n as (select distinct on (calib_id) variant_id, bin_label, null_max_cluster_sums as v from null_calibration where null_max_cluster_sums >= 0 and null_max_cluster_sums < 'inf'::float)
select o.variant_id, o.bin_label, o.obs, round((count(*) filter (cast(v as double) >= obs) + 1) / (count(v) + 1), 9) as p, count(v) as n
from o left join n on n.variant_id = o.variant_id and n.bin_label = o.bin_label group by 1, 2, 3""",
    ),
    "nc_ks_chi2": V.sql(
        "read_nc",
        """with g as (select unnest(range(0, (select max(nc) + 1 from read_nc))) as nc),
f as (select variant_id, nc, count(*) as n from read_nc where nc >= 0 group by 1, 2),
t as (select variant_id, sum(n) as total from f group by 1),
z as (select t.variant_id, t.total, g.nc, coalesce(n, 0) as n from t cross join g left join f on f.variant_id = t.variant_id and f.nc = g.nc),
c as (select *, n / total as frac, sum(n / total) over (partition by variant_id order by nc rows unbounded preceding) as cdf from z),
j as (select a.*, b.cdf as wc, b.frac * a.total as e from c a join c b on b.variant_id = 'WT' and b.nc = a.nc where a.variant_id <> 'WT'),
s as (select variant_id, sum(n) filter (e >= 5) as so, sum(e) filter (e >= 5) as se from j group by 1)
select j.variant_id, round(max(abs(cdf - wc)), 9) as ks, count(*) filter (e >= 5) as n_bins,
  case when count(*) filter (e >= 5) >= 2 then round(sum(power(n - e * so / se, 2) / (e * so / se)) filter (e >= 5), 6) end as chi2 from j join s using (variant_id) group by 1""",
    ),
    "distance_decay": V.sql("cluster_rows", "select bin, cast(floor(abs(variant_distance) / 50) * 50 as int) as distance, count(*) as n, round(avg(max_abs_delta), 9) as mean_effect from cluster_rows where variant_distance <> -999999 group by 1, 2"),
    "at_density": """
with s as (select library, position, min(upper(ref)) as base from variant_summary where change_type = 'snv' and position is not null group by 1, 2)
select library, position, round(avg(case when base in ('A', 'T') then 1.0 else 0.0 end) over (partition by library order by position rows between 10 preceding and 10 following), 9) as at from s""",
    "null_percentiles": """
with n as (select distinct on (calib_id) bin_label, abs(cast(null_delta as double)) as x from null_calibration where null_delta between -1 and 1)
select bin_label, count(*) as n, round(quantile_cont(x, 0.5), 9) as p50, round(quantile_cont(x, 0.95), 9) as p95 from n group by 1""",
}
ORACLES["variant_type_counts"] = "with v as (" + ORACLES["variant_counts"] + ") select change_type, count(*) as n_variants, cast(sum(n_reads) as bigint) as n_calls, count(distinct position) as n_positions from v group by 1"
