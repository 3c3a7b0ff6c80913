"""Whole stages as plans: alignments to calls, calls to consensus tags, molecules to tests and tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occuspan.functions import tags
from occuspan.operators import aggregates, alignment, barcode_clusters, calling, cooccupancy, filters, kernels, motifs, occupancy
from occuspan.session import written


@dataclass(frozen=True)
class CallConfig:
    """Knobs of stage two at their defaults."""

    promoter: tuple[int, int]
    barcode: tuple[int, int] | None = None
    min_quality: int = 20
    min_jaccard: float = 0.5
    frequency: float = 0.6
    indel_reads: int = 2


def filter_reads(reads: DataFrame, contigs: DataFrame, **knobs) -> tuple[DataFrame, DataFrame]:
    """Stage one on BAM rows: (reads that pass, with ``nc`` and ``bn``; counts of each fate)."""
    r = alignment.with_methylation(reads).withColumn("qlen", F.length("seq"))
    r = filters.with_contigs(r, contigs).withColumn("disposition", filters.disposition(**knobs))
    ns = tags.tag_array(F.element_at("tags", "ns"))
    nc = tags.nucleosome_count(F.element_at("tags", "nc").try_cast("int"), F.element_at("tags", "MA"), ns)
    kept = r.where("disposition = 'pass'").withColumn("nc", nc).withColumn("bn", F.when(F.col("nc") > 0, F.col("qlen") / F.col("nc")).otherwise(0.0))
    return kept, r.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


def call_stage(reads: DataFrame, ref: str, cfg: CallConfig) -> dict[str, DataFrame]:
    """Stage two: ``tagged`` reads, ``clusters`` of barcodes with their consensus, and ``exclusions``.

    Reads are called once and written, since barcodes, consensus and tagging all read the calls. A read without a
    cluster keeps its raw tag. Without a barcode region every read keeps its raw tag.
    """
    ok = F.col("flag").bitwiseAND(0x904) == 0
    expected = (cfg.barcode[1] - cfg.barcode[0]) if cfg.barcode else 0
    calls = written(calling.call_variants(reads.where(ok), ref, cfg.promoter, cfg.barcode, cfg.min_quality, (expected - 1, expected + 1)))
    good = calls.where("status = 'pass'").withColumn("raw", tags.raw_tag(F.col("var_ids")))
    if not cfg.barcode:
        return {"tagged": good.select("read_id", F.col("raw").alias("pv"), F.size("var_ids").alias("vc")), "exclusions": calls.groupBy("status").count()}
    bc = good.where("barcode is not null")
    table = bc.groupBy("barcode").agg(F.count(F.lit(1)).alias("reads"), F.min("read_id").alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("var_ids")))).alias("ids"))
    cl = written(barcode_clusters.cluster(table, expected, cfg.min_jaccard))
    withc = bc.join(cl, "barcode")
    cons = aggregates.consensus(withc, ["centroid"], "var_ids", cfg.frequency, cfg.indel_reads)
    sizes = cl.groupBy("centroid").agg(F.count(F.lit(1)).alias("cluster_size"), F.array_sort(F.collect_list("barcode")).alias("member_barcodes"))
    res = written(cons.join(sizes, "centroid").withColumn("tag", tags.raw_tag(F.col("consensus"))).withColumn("is_low_confidence", (F.col("cluster_size") == 1) & (F.col("n_reads") <= 1)))
    j = good.join(cl, "barcode", "left").join(res.select("centroid", "tag", "cluster_size", "consensus"), "centroid", "left")
    tagged = j.select("read_id", F.coalesce("tag", "raw").alias("pv"), F.when(F.col("tag").isNotNull(), F.size("consensus")).otherwise(F.size("var_ids")).alias("vc"), F.col("raw").alias("pr"), F.col("barcode").alias("bc"), F.col("barcode_qual").alias("bq"), F.col("centroid").alias("bk"), F.col("cluster_size").alias("cs"))
    return {"tagged": tagged, "clusters": res, "exclusions": calls.groupBy("status", "bc_status").count()}


def library_tables(mols_nc: DataFrame, segs: DataFrame, cfg: kernels.NullConfig, calls: DataFrame | None = None, library: str = "library", motif_cfg: motifs.MotifConfig = motifs.MotifConfig(), pair_cfg: cooccupancy.PairConfig = cooccupancy.PairConfig()) -> dict[str, DataFrame]:
    """Stage three: the tables of a library, ready for :func:`occuspan.sources.sinks.write_store`.

    ``calls`` are the reads' raw variant calls (``read_id, ids``) for the screen of pairs; without them every read is clean.
    """
    pack = written(kernels.packed(mols_nc, segs, cfg))
    tests = written(kernels.variant_tests(pack, cfg))
    summary = written(kernels.summary(tests).drop("bins", "clusters").withColumn("library", F.lit(library)))
    occ = occupancy.occupancy(mols_nc, segs)
    bins = tests.select("variant_id", F.explode("bins").alias("b"))
    c = tests.select("variant_id", F.explode("clusters").alias("c")).select("variant_id", "c.*")
    c = c.withColumn("library", F.lit(library)).withColumn("width", F.col("abs_end") - F.col("abs_start") + 1)
    # a call's number follows its variant, bin and place
    c = c.withColumn("cluster_id", F.xxhash64("variant_id", "bin", "abs_start"))
    ann = written(motifs.annotate(c, summary).withColumn("is_motif", motifs.motif_flag_of(motif_cfg)))
    hits = motifs.motif_calls(ann, motif_cfg)
    found = written(motifs.intervals_of(motifs.density(hits), motif_cfg))
    sites = written(motifs.sites_of(ann, found, motif_cfg))
    inst = written(motifs.site1_of(ann, sites, motif_cfg))
    pairs = written(cooccupancy.pairs_with_instruments(sites, inst, motif_cfg))
    sets = written(cooccupancy.site_sets(mols_nc, segs, sites, calls, pair_cfg, cfg.window))
    pair_tests = cooccupancy.tests(written(cooccupancy.pair_counts(sets, pairs)), pair_cfg)
    if calls is not None:
        pair_tests = pair_tests.join(cooccupancy.secondary_frequency(sets, calls, sites, pairs, pair_cfg), ["site1", "site2"], "left")
    return {
        "ground_truth_nc": occupancy.nc_distribution(mols_nc),
        "wt_occupancy": occ.where("variant_id = 'WT'"),
        "null_calibration": bins.select("variant_id", "b.bin", "b.null_mean", "b.null_std", "b.null_p95"),
        "variant_summary": summary,
        "variant_bin": bins.select("variant_id", "b.*").drop("null_mean", "null_std", "null_p95"),
        "clusters": ann,
        "motifs": motifs.with_variants(found, hits),
        "sensitivity": motifs.sensitivity(found, hits),
        "sites": sites,
        "cooccupancy": pair_tests,
    }
