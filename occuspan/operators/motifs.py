"""Motif layer: flags, distances, disruption density, motif intervals, base sensitivity, canonical sites and their pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from occuspan.functions import tags
from occuspan.operators.joins import overlap_join
from occuspan.operators.ordered import fold_merge, runs
from occuspan.session import table
from occuspan.sources import views as V


@dataclass(frozen=True)
class MotifConfig:
    """Knobs of the motif layer at their defaults."""

    bins: tuple[str, ...] = ("sub_TF", "TF")
    min_width: int = 5
    max_width: int = 25
    sign_consistency: float = 0.9
    direction: str = "loss"
    fdr: float = 0.10
    density: int = 3
    require_overlap: bool = False
    merge_overlap: float = 0.5
    min_instruments: int = 3
    min_separation: int = 20


#: distance of a call whose variant has no position
UNKNOWN = -999999


def causal_distance(pos0: Column, start: Column, end: Column) -> Column:
    """0 inside the call, the signed distance to its nearer end outside, and a constant where the position is unknown."""
    return F.when(pos0.isNull(), UNKNOWN).when(pos0.between(start, end), 0).when(pos0 < start, pos0 - start).otherwise(pos0 - end)


def motif_flag_of(cfg: MotifConfig) -> Column:
    ok = F.col("bin").isin(*cfg.bins) & F.col("width").between(cfg.min_width, cfg.max_width) & (F.col("sign_consistency") >= cfg.sign_consistency)
    if cfg.direction != "both":
        ok = ok & (F.col("direction") == cfg.direction)
    if cfg.require_overlap:
        ok = ok & F.col("variant_overlap")
    return F.coalesce(ok, F.lit(False))


def annotated(spark, d) -> DataFrame:
    """The table's calls with their variant's position, alternative base and q-value in the library."""
    c = V.cluster_rows(spark, d).drop("is_motif", "variant_distance", "variant_overlap")
    return annotate(c, table(spark, d, "variant_summary"))


def annotate(c: DataFrame, summary: DataFrame) -> DataFrame:
    """Calls (``library, variant_id, abs_start, abs_end, ...``) with their variant's 0-based position, alternative base, distance and ``variant_fdr_q``."""
    p = tags.parse_variant_id(F.col("variant_id"))
    c = c.withColumn("pos0", p["position"] - 1).withColumn("alt", F.upper(p["alt"])).withColumn("kind", p["change_type"])
    dist = causal_distance(F.col("pos0"), F.col("abs_start"), F.col("abs_end"))
    c = c.withColumn("distance", dist).withColumn("variant_overlap", dist == 0)
    q = summary.select("library", "variant_id", "variant_fdr_q")
    return c.join(q, ["library", "variant_id"], "left")


def significant(c: DataFrame, cfg: MotifConfig) -> DataFrame:
    return c.where(F.col("variant_fdr_q") < cfg.fdr)


def density(calls: DataFrame) -> DataFrame:
    """``library, bin, pos, density``: distinct variants with a motif call over each covered position.

    Calls of a variant are merged first, so each position counts a variant once, and the ends are summed: nothing is
    expanded before the shuffle but the positions of the merged calls.
    """
    from occuspan.operators.intervals import merge_intervals

    m = merge_intervals(calls, ["library", "bin", "variant_id"], "abs_start", "abs_end")
    return m.select("library", "bin", F.explode(F.sequence("s", F.col("e") - 1)).alias("pos")).groupBy("library", "bin", "pos").agg(F.count(F.lit(1)).alias("density"))


def motif_calls(calls: DataFrame, cfg: MotifConfig) -> DataFrame:
    return significant(calls.where(motif_flag_of(cfg)), cfg)


def intervals_of(dens: DataFrame, cfg: MotifConfig) -> DataFrame:
    """Maximal runs of positions with at least the threshold density, and wide enough. Uncovered positions are cold."""
    return runs(dens, ["library", "bin"], F.col("density") >= cfg.density, cfg.min_width)


def with_variants(motifs: DataFrame, calls: DataFrame) -> DataFrame:
    """Motif intervals with their width and the variants whose motif calls overlap them."""
    j = overlap_join(motifs, calls.select("library", "bin", "variant_id", "abs_start", "abs_end"), ["library", "bin"], ("start", "end"), ("abs_start", "abs_end"))
    ids = F.array_sort(F.collect_set("b_variant_id"))
    g = j.groupBy("library", "bin", "start", "end", "peak_density").agg(ids.alias("variant_ids"))
    return g.select("library", "bin", "start", "end", (F.col("end") - F.col("start") + 1).alias("width"), "peak_density", F.size("variant_ids").alias("n_variants"), "variant_ids")


def sensitivity(motifs: DataFrame, calls: DataFrame) -> DataFrame:
    """Count and mean signed effect by motif, offset and alternative base; a variant counts by its strongest call on the motif."""
    j = overlap_join(calls, motifs, ["library", "bin"], ("abs_start", "abs_end"), ("start", "end"))
    j = j.where((F.col("kind") == "snv") & F.col("pos0").between(F.col("b_start"), F.col("b_end")) & F.col("alt").isin(*"ACGT"))
    best = j.groupBy("library", "bin", "b_start", "variant_id", "pos0", "alt").agg(F.max_by("mean_signed_delta", F.struct(F.abs("mean_signed_delta"), -F.col("cluster_id"))).alias("eff"))
    return best.groupBy("library", "bin", F.col("b_start").alias("start"), (F.col("pos0") - F.col("b_start")).cast("int").alias("rel_pos"), F.col("alt").alias("base")).agg(F.count(F.lit(1)).alias("n"), F.avg("eff").alias("mean_delta"))


def sites_of(calls: DataFrame, motifs: DataFrame, cfg: MotifConfig) -> DataFrame:
    """Canonical sites: the pooled motif intervals and significant calls of a bin, merged, and whether a motif overlaps."""
    pool = significant(calls, cfg).select("library", "bin", F.col("abs_start").alias("s0"), F.col("abs_end").alias("e0")).unionByName(motifs.select("library", "bin", F.col("start").cast("int").alias("s0"), F.col("end").cast("int").alias("e0")))
    s = fold_merge(pool, ["library", "bin"], "s0", "e0", cfg.merge_overlap)
    hit = overlap_join(s, motifs.select("library", "bin", "start", "end"), ["library", "bin"], ("s", "e"), ("start", "end")).select("library", "bin", "s", "e").distinct().withColumn("m", F.lit(True))
    j = s.join(hit, ["library", "bin", "s", "e"], "left")
    return j.select("library", F.concat("bin", F.lit(":"), F.col("s").cast("string"), F.lit("-"), F.col("e").cast("string")).alias("site_id"), "bin", "s", "e", F.coalesce("m", F.lit(False)).alias("is_motif_site"))


def site1_of(calls: DataFrame, sites: DataFrame, cfg: MotifConfig) -> DataFrame:
    """``library, variant_id, site_id``: the site that holds the variant and overlaps its strongest motif call."""
    j = overlap_join(motif_calls(calls, cfg), sites, ["library", "bin"], ("abs_start", "abs_end"), ("s", "e"))
    j = j.where(F.col("pos0").between(F.col("b_s"), F.col("b_e")))
    return j.groupBy("library", "variant_id").agg(F.max_by("b_site_id", F.struct("sum_abs_delta", -F.col("cluster_id"), -F.col("b_s"))).alias("site_id"))


def pairs_of(sites: DataFrame, inst: DataFrame, cfg: MotifConfig) -> DataFrame:
    """Pairs of a site with enough instruments and every other site of its library at least the separation away."""
    n = inst.groupBy("library", "site_id").agg(F.count(F.lit(1)).alias("n_instruments")).where(F.col("n_instruments") >= cfg.min_instruments)
    a = sites.join(n, ["library", "site_id"]).select("library", F.col("site_id").alias("site1"), F.col("s").alias("s1"), F.col("e").alias("e1"), "n_instruments")
    b = sites.select("library", F.col("site_id").alias("site2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return a.join(b, "library").where((F.col("site1") != F.col("site2")) & (F.greatest(F.col("s1") - F.col("e2"), F.col("s2") - F.col("e1")) >= cfg.min_separation)).select("library", "site1", "site2", "n_instruments")


CFG = MotifConfig(sign_consistency=0.6, direction="both", max_width=60)


def motif_flag(spark, d):
    c = annotated(spark, d).withColumn("m", motif_flag_of(CFG))
    return c.groupBy("library", "bin", "m").agg(F.count(F.lit(1)).alias("n"), F.sum("width").cast("long").alias("bases"))


def cluster_causal_distance(spark, d):
    return annotated(spark, d).select("cluster_id", F.col("distance").cast("int").alias("distance"), "variant_overlap")


def reference_self_check(spark, d):
    """SNVs of a call that cover their position: how often the reference base in the call's sequence is the id's."""
    c = annotated(spark, d).where("kind = 'snv' and variant_overlap and ref_sequence is not null")
    base = F.substring("ref_sequence", F.col("pos0") - F.col("abs_start") + 1, F.lit(1))
    ref = F.upper(tags.parse_variant_id(F.col("variant_id"))["ref"])
    return c.groupBy("library").agg(F.count(F.lit(1)).alias("checked"), F.count(F.when(F.upper(base) != ref, 1)).alias("unlike"))


def disruption_density(spark, d):
    return density(motif_calls(annotated(spark, d), CFG))


def _motifs(c: DataFrame) -> DataFrame:
    return intervals_of(density(motif_calls(c, CFG)), CFG)


def motif_intervals(spark, d):
    return _motifs(annotated(spark, d))


def motif_variants(spark, d):
    """Motif intervals with their contributing variants."""
    c = annotated(spark, d)
    m = with_variants(_motifs(c), motif_calls(c, CFG))
    return m.select("library", "bin", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "n_variants", F.array_join("variant_ids", "|").alias("ids"))


def motif_sensitivity(spark, d):
    c = annotated(spark, d)
    return sensitivity(_motifs(c), motif_calls(c, CFG)).withColumn("mean_delta", F.round("mean_delta", 9))


def canonical_sites(spark, d):
    c = annotated(spark, d)
    return sites_of(c, _motifs(c), CFG)


def assign_site1(spark, d):
    c = annotated(spark, d)
    return site1_of(c, sites_of(c, _motifs(c), CFG), CFG)


def join_site_pairs_theta(spark, d):
    c = annotated(spark, d)
    s = sites_of(c, _motifs(c), CFG)
    return pairs_of(s, site1_of(c, s, CFG), CFG)


QUERIES = {f.__name__: f for f in (motif_flag, cluster_causal_distance, reference_self_check, disruption_density, motif_intervals, motif_variants, motif_sensitivity, canonical_sites, assign_site1, join_site_pairs_theta)}

_A = r"""an0 as (select c.*, cast(nullif(regexp_extract(variant_id, '^(\d+):', 1), '') as int) - 1 as pos0,
    upper(regexp_extract(variant_id, '>([ACGTacgt])', 1)) as snv_alt, regexp_matches(variant_id, '^\d+:[ACGTacgt]>[ACGTacgt]') as snv from cluster_rows c),
an as (select a.*, s.variant_fdr_q as fq, case when pos0 is null then -999999 when pos0 between abs_start and abs_end then 0 when pos0 < abs_start then pos0 - abs_start else pos0 - abs_end end as distance,
    coalesce(a.bin in ('sub_TF', 'TF') and width between 5 and 60 and sign_consistency >= 0.6, false) as m
  from an0 a left join variant_summary s on s.library = a.library and s.variant_id = a.variant_id)"""
_D = _A + """,
mc as (select * from an where m and fq < 0.1),
dens as (select library, bin, pos, count(distinct variant_id) as density from (select library, bin, variant_id, unnest(range(abs_start, abs_end + 1)) as pos from mc) group by 1, 2, 3)"""
_I = _D + """,
hot as (select *, pos - row_number() over (partition by library, bin order by pos) as i from dens where density >= 3),
mo as (select library, bin, min(pos) as start, max(pos) as "end", max(density) as peak_density from hot group by library, bin, i having count(*) >= 5)"""
_S = _I + """,
iv as (select library, bin, cast(abs_start as int) as s, cast(abs_end as int) as e from an where fq < 0.1 union select library, bin, cast(start as int), cast("end" as int) from mo),
o as (select *, row_number() over (partition by library, bin order by s, e) as i from iv),
walk as (
  select library, bin, i, 1 as part, s, e from o where i = 1
  union all
  select o.library, o.bin, o.i,
    case when greatest(least(w.e, o.e) - greatest(w.s, o.s) + 1, 0) / (least(w.e - w.s, o.e - o.s) + 1) >= 0.5 then w.part else w.part + 1 end,
    case when greatest(least(w.e, o.e) - greatest(w.s, o.s) + 1, 0) / (least(w.e - w.s, o.e - o.s) + 1) >= 0.5 then least(w.s, o.s) else o.s end,
    case when greatest(least(w.e, o.e) - greatest(w.s, o.s) + 1, 0) / (least(w.e - w.s, o.e - o.s) + 1) >= 0.5 then greatest(w.e, o.e) else o.e end
  from walk w join o on o.library = w.library and o.bin = w.bin and o.i = w.i + 1),
st0 as (select library, bin, min(s) as s, max(e) as e from walk group by library, bin, part),
sites as (select library, concat(bin, ':', s, '-', e) as site_id, bin, s, e,
  exists (select 1 from mo where mo.library = st0.library and mo.bin = st0.bin and mo.start <= st0.e and mo."end" >= st0.s) as is_motif_site from st0)"""
_1 = _S + """,
one as (select library, variant_id, site_id from (select a.library, a.variant_id, t.site_id, row_number() over (partition by a.library, a.variant_id order by sum_abs_delta desc, cluster_id, t.s) as k
  from mc a join sites t on t.library = a.library and t.bin = a.bin and t.s <= abs_end and t.e >= abs_start and pos0 between t.s and t.e) where k = 1)"""

ORACLES = {
    "motif_flag": V.sql("cluster_rows", f"with {_A} select library, bin, m, count(*) as n, cast(sum(width) as bigint) as bases from an group by 1, 2, 3"),
    "cluster_causal_distance": V.sql("cluster_rows", f"with {_A} select cluster_id, distance, distance = 0 as variant_overlap from an"),
    "reference_self_check": V.sql(
        "cluster_rows",
        rf"with {_A} select library, count(*) as checked, count(*) filter (upper(substr(ref_sequence, pos0 - abs_start + 1, 1)) <> upper(regexp_extract(variant_id, ':([ACGTacgt])>', 1))) as unlike from an where snv and distance = 0 and ref_sequence is not null group by 1",
    ),
    "disruption_density": V.sql("cluster_rows", f"with {_D} select * from dens"),
    "motif_intervals": V.sql("cluster_rows", f"with {_I} select * from mo"),
    "motif_variants": V.sql(
        "cluster_rows",
        f"""with {_I} select mo.library, mo.bin, cast(mo.start as int) as start, cast(mo."end" as int) as "end", cast(count(distinct variant_id) as int) as n_variants, string_agg(distinct variant_id, '|' order by variant_id) as ids
from mo join mc on mc.library = mo.library and mc.bin = mo.bin and abs_start <= mo."end" and mo.start <= abs_end group by 1, 2, 3, 4""",
    ),
    "motif_sensitivity": V.sql(
        "cluster_rows",
        f"""with {_I}, b as (select mo.library, mo.bin, mo.start, a.pos0, a.snv_alt, a.mean_signed_delta as eff, row_number() over (partition by mo.library, mo.bin, mo.start, a.variant_id
    order by abs(mean_signed_delta) desc nulls last, cluster_id) as k
  from mc a join mo on mo.library = a.library and mo.bin = a.bin and abs_start <= mo."end" and mo.start <= abs_end where snv and pos0 between mo.start and mo."end")
select library, bin, start, cast(pos0 - start as int) as rel_pos, snv_alt as base, count(*) as n, round(avg(eff), 9) as mean_delta from b where k = 1 group by 1, 2, 3, 4, 5""",
    ),
    "canonical_sites": V.sql("cluster_rows", f"with {_S} select * from sites", recursive=True),
    "assign_site1": V.sql("cluster_rows", f"with {_1} select * from one", recursive=True),
    "join_site_pairs_theta": V.sql(
        "cluster_rows",
        f"""with {_1}, n as (select library, site_id, count(*) as n_instruments from one group by 1, 2 having count(*) >= 3)
select a.library, a.site_id as site1, b.site_id as site2, n_instruments from sites a join n on n.library = a.library and n.site_id = a.site_id
join sites b on b.library = a.library and b.site_id <> a.site_id and greatest(a.s - b.e, b.s - a.e) >= 20""",
        recursive=True,
    ),
}
