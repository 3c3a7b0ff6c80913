"""Co-occupancy of site pairs: the sites each read occupies, the pairs' 2x2 counts, and their tests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occuspan.functions import tags
from occuspan.operators import kernels as K
from occuspan.operators import motifs as M
from occuspan.operators import occupancy as O
from occuspan.operators.joins import overlap_join
from occuspan.session import written
from occuspan.sources import views as V


@dataclass(frozen=True)
class PairConfig:
    """Knobs of the pair tests at their defaults."""

    occupied: float = 0.5
    min_stratum: int = 25
    min_instruments: int = 3
    call_q: float = 0.05
    min_consistency: float = 0.7
    rounds: int = 10_000
    secondary_window: int = 10
    seed: int = 42


def site_sets(mols: DataFrame, segs: DataFrame, sites: DataFrame, calls: DataFrame | None = None, cfg: PairConfig = PairConfig(), window=V.WINDOW) -> DataFrame:
    """``read_id, variant_id, occ, dirty`` of every read: the sites it occupies, and those near which it has another call.

    A site (``site_id, bin, s, e``, inclusive) is occupied if the read's footprints of its bin cover at least the share
    ``occupied`` of the site's positions inside the window. It is dirty if the read's raw calls (``read_id, ids``)
    hold an id besides the read's variant whose position lies in the site or ``secondary_window`` around it. Sites and
    stretches meet by blocks of positions; only what is occupied is kept, so rows grow with footprints and not with
    reads times sites. Reads without either have empty arrays.
    """
    s = sites.select("site_id", "bin", F.greatest("s", F.lit(window[0])).alias("s"), F.least("e", F.lit(window[1] - 1)).alias("e")).where("s <= e")
    c = O.covered(O.binned(segs), window).select("read_id", "bin", F.col("s").alias("a"), (F.col("e") - 1).alias("z"))
    j = overlap_join(c, s, ["bin"], ("a", "z"), ("s", "e"))
    share = F.sum(F.least("z", "b_e") - F.greatest("a", "b_s") + 1) / (F.first("b_e") - F.first("b_s") + 1)
    got = j.groupBy("read_id", F.col("b_site_id").alias("site_id")).agg(share.alias("share")).where(F.col("share") >= cfg.occupied)
    occ = got.groupBy("read_id").agg(F.collect_set("site_id").alias("occ"))
    none = F.array().cast("array<string>")
    out = mols.select("read_id", "variant_id").join(occ, "read_id", "left")
    if calls is None:
        return out.select("read_id", "variant_id", F.coalesce("occ", none).alias("occ"), none.alias("dirty"))
    k = calls.join(mols.select("read_id", "variant_id"), "read_id").select("read_id", "variant_id", F.explode("ids").alias("id")).where(F.col("id") != F.col("variant_id"))
    k = k.withColumn("at", F.nullif(F.regexp_extract("id", r"^(\d+):", 1), F.lit("")).cast("int") - 1).where("at is not null").withColumn("one", F.lit(1))
    near = sites.select("site_id", (F.col("s") - cfg.secondary_window).alias("s"), (F.col("e") + cfg.secondary_window).alias("e"), F.lit(1).alias("one"))
    dirty = overlap_join(k.select("read_id", "one", "at", F.col("at").alias("at2")), near, ["one"], ("at", "at2"), ("s", "e")).groupBy("read_id").agg(F.collect_set("b_site_id").alias("dirty"))
    return out.join(dirty, "read_id", "left").select("read_id", "variant_id", F.coalesce("occ", none).alias("occ"), F.coalesce("dirty", none).alias("dirty"))


def pair_counts(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``site1, site2, variant_id, c00 .. c11, s00 .. s11`` of wild type and each instrument of each pair: all reads, and those not dirty at the second site.

    ``pairs`` has ``site1, site2, variant_id``, one row for each instrument; repeated rows are one. Reads are counted by
    what they occupy, in each task before the shuffle, and the cells of what they don't come from totals; wild type,
    however large its share, so moves as counts alone.
    """
    wt = pairs.select("site1", "site2").distinct().withColumn("variant_id", F.lit("WT"))
    want = pairs.select("site1", "site2", "variant_id").distinct().unionByName(wt)
    n = sets.groupBy("variant_id").agg(F.count(F.lit(1)).alias("n"))
    k = lambda c: F.count(F.when(c, 1))
    is_occ, is_dirty = F.array_contains("occ", F.col("site")), F.array_contains("dirty", F.col("site"))
    one = sets.select("variant_id", "occ", "dirty", F.explode(F.array_union("occ", "dirty")).alias("site"))
    one = one.groupBy("variant_id", "site").agg(k(is_occ).alias("o"), k(is_occ & ~is_dirty).alias("oc"), k(is_dirty).alias("d"))
    two = sets.select("variant_id", "occ", "dirty", F.explode("occ").alias("site1")).select("variant_id", "occ", "dirty", "site1", F.explode(F.array_union("occ", "dirty")).alias("site"))
    two = two.where("site1 <> site").groupBy("variant_id", "site1", F.col("site").alias("site2")).agg(k(is_occ).alias("both"), k(is_occ & ~is_dirty).alias("bothc"), k(is_dirty).alias("od"))
    j = want.join(n, "variant_id")
    j = j.join(one.select("variant_id", F.col("site").alias("site1"), F.col("o").alias("n1")), ["variant_id", "site1"], "left")
    j = j.join(one.select("variant_id", F.col("site").alias("site2"), F.col("o").alias("n2"), F.col("oc").alias("n2c"), F.col("d").alias("d2")), ["variant_id", "site2"], "left")
    j = j.join(two, ["variant_id", "site1", "site2"], "left").na.fill(0, ["n1", "n2", "n2c", "d2", "both", "bothc", "od"])
    n_, n1, n2, b = F.col("n"), F.col("n1"), F.col("n2"), F.col("both")
    nc, n1c, n2c, bc = n_ - F.col("d2"), n1 - F.col("od"), F.col("n2c"), F.col("bothc")
    cells = lambda p, t, x, y, z: [(t - x - y + z).alias(p + "00"), (y - z).alias(p + "01"), (x - z).alias(p + "10"), z.alias(p + "11")]
    return j.select("site1", "site2", "variant_id", *cells("c", n_, n1, n2, b), *cells("s", nc, n1c, n2c, bc))


def secondary_frequency(sets: DataFrame, calls: DataFrame, sites: DataFrame, pairs: DataFrame, cfg: PairConfig = PairConfig()) -> DataFrame:
    """``site1, site2, n_reads, n_secondary, max_freq``: distinct other calls near the second site among the instruments' reads, and the greatest share of reads with one of them."""
    inst = pairs.select("site1", "site2", "variant_id").distinct()
    n = inst.join(sets.groupBy("variant_id").agg(F.count(F.lit(1)).alias("n")), "variant_id").groupBy("site1", "site2").agg(F.sum("n").alias("n_reads"))
    k = calls.join(sets.select("read_id", "variant_id"), "read_id").select("variant_id", F.explode("ids").alias("id")).where(F.col("id") != F.col("variant_id")).groupBy("variant_id", "id").agg(F.count(F.lit(1)).alias("k"))
    k = k.withColumn("at", F.nullif(F.regexp_extract("id", r"^(\d+):", 1), F.lit("")).cast("int") - 1).where("at is not null").withColumn("one", F.lit(1))
    near = sites.select("site_id", (F.col("s") - cfg.secondary_window).alias("s"), (F.col("e") + cfg.secondary_window).alias("e"), F.lit(1).alias("one"))
    hit = overlap_join(k.select("variant_id", "id", "k", "one", "at", F.col("at").alias("at2")), near, ["one"], ("at", "at2"), ("s", "e")).select("variant_id", "id", "k", F.col("b_site_id").alias("site2"))
    per = inst.join(hit, ["variant_id", "site2"]).groupBy("site1", "site2", "id").agg(F.sum("k").alias("k")).groupBy("site1", "site2").agg(F.max("k").alias("top"), F.count(F.lit(1)).alias("n_secondary"))
    j = n.join(per, ["site1", "site2"], "left")
    return j.select("site1", "site2", "n_reads", F.coalesce("n_secondary", F.lit(0).cast("long")).alias("n_secondary"), (F.coalesce("top", F.lit(0).cast("long")) / F.col("n_reads")).alias("max_freq"))


def pairs_with_instruments(sites: DataFrame, inst: DataFrame, cfg: M.MotifConfig = M.MotifConfig()) -> DataFrame:
    """``site1, site2, variant_id``: the pairs of :func:`occuspan.operators.motifs.pairs_of` with the variants assigned to their first site."""
    p = M.pairs_of(sites, inst, cfg).select("library", "site1", "site2")
    return p.join(inst.select("library", F.col("site_id").alias("site1"), "variant_id"), ["library", "site1"]).select("site1", "site2", "variant_id")


def tests(counts: DataFrame, cfg: PairConfig = PairConfig()) -> DataFrame:
    """The joint test of each pair, with q-values, calls, and whether a call holds on clean reads."""
    return K.cooccupancy(counts, cfg.rounds, cfg.seed, cfg.min_stratum, cfg.min_instruments, cfg.call_q, cfg.min_consistency)


# queries --------------------------------------------------------------------------------------------------

#: sites of the derived molecules: bin, first and last position
SITES = (("TF", 100, 139), ("TF", 140, 179), ("PIC", 150, 199), ("nuc", 20, 79), ("nuc", 220, 279), ("sub_TF", 60, 89))


def derived_sites(spark) -> DataFrame:
    return spark.createDataFrame([("derived", f"{b}:{s}-{e}", b, s, e) for b, s, e in SITES], "library string, site_id string, bin string, s int, e int")


def derived_calls(spark, d) -> DataFrame:
    """``read_id, ids``: raw calls of the derived molecules: their variant, and another one on each seventh read."""
    rid = F.col("read_id")
    other = F.concat((rid % 260 + 20).cast("string"), F.lit(":T>G"))
    return V.molecules(spark, d).select("read_id", F.array_compact(F.array(F.when(F.col("variant_id") != "WT", F.col("variant_id")), F.when(rid % 7 == 0, other))).alias("ids"))


def _pairs(spark, d) -> DataFrame:
    """Pairs of the derived sites; a variant is an instrument of the sites that hold it."""
    v = V.molecules(spark, d).where("variant_id <> 'WT'").select("variant_id").distinct()
    v = v.withColumn("at", tags.parse_variant_id(F.col("variant_id"))["position"] - 1).withColumn("library", F.lit("derived"))
    inst = overlap_join(v.select("library", "variant_id", "at", F.col("at").alias("at2")), derived_sites(spark), ["library"], ("at", "at2"), ("s", "e")).select("library", "variant_id", F.col("b_site_id").alias("site_id"))
    return pairs_with_instruments(derived_sites(spark), inst)


def _sets(spark, d) -> DataFrame:
    return written(site_sets(V.molecules(spark, d), V.segments(spark, d), derived_sites(spark), derived_calls(spark, d)))


def cooccupancy_counts(spark, d):
    """2x2 counts of each pair, for wild type and each instrument, over all reads and over clean ones."""
    return pair_counts(_sets(spark, d), _pairs(spark, d))


def cooccupancy_pairs(spark, d):
    """The joint test of each pair, with the test on reads that have no other call near the second site."""
    return tests(written(cooccupancy_counts(spark, d)))


def cooccupancy_secondary(spark, d):
    """Other calls near the second site of each pair."""
    return secondary_frequency(_sets(spark, d), derived_calls(spark, d), derived_sites(spark), _pairs(spark, d)).withColumn("max_freq", F.round("max_freq", 9))


#: two sites of the derived molecules whose states are compared
TWO = (("nuc:60-99", "nuc", 60, 99), ("TF:150-179", "TF", 150, 179))


def _two(spark, d) -> DataFrame:
    return site_sets(V.molecules(spark, d), V.segments(spark, d), spark.createDataFrame(list(TWO), "site_id string, bin string, s int, e int"))


def site_state(spark, d):
    """Reads of each variant and those that occupy each site; the sites are few and their names ride along."""
    s = _two(spark, d)
    k = s.groupBy("variant_id").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.array_contains("occ", x), 1)).alias(f"o{i}") for i, (x, *_) in enumerate(TWO)])
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("site_id"), F.col(f"o{i}").alias("occupied")) for i, (x, *_) in enumerate(TWO)])).alias("x")
    return k.select("variant_id", "n", each).select("variant_id", "x.site_id", "n", "x.occupied")


def conditional_2x2(spark, d):
    """States of two sites per variant, and the share of the second given the first."""
    k = lambda c: F.count(F.when(c, 1))
    o1, o2 = (F.array_contains("occ", x) for x, *_ in TWO)
    g = _two(spark, d).groupBy("variant_id").agg(k(o1 & o2).alias("c11"), k(o1 & ~o2).alias("c10"), k(~o1 & o2).alias("c01"), k(~o1 & ~o2).alias("c00"))
    return g.withColumn("p1", F.round(F.try_divide("c11", F.col("c11") + F.col("c10")), 9)).withColumn("p0", F.round(F.try_divide("c01", F.col("c01") + F.col("c00")), 9))


QUERIES = {f.__name__: f for f in (cooccupancy_counts, cooccupancy_pairs, cooccupancy_secondary, site_state, conditional_2x2)}

_BASE = f"""
st(site_id, bin, s, e) as (values {", ".join(f"('{b}:{s}-{e}', '{b}', {s}, {e})" for b, s, e in SITES)}),
rc as (select read_id, variant_id, case when variant_id <> 'WT' then variant_id end as own, case when read_id % 7 = 0 then concat(read_id % 260 + 20, ':T>G') end as other from molecules),
inst as (select distinct m.variant_id, st.site_id from (select distinct variant_id from molecules where variant_id <> 'WT') m join st on cast(regexp_extract(m.variant_id, '^(\\d+):', 1) as int) - 1 between st.s and st.e),
ni as (select site_id, count(*) as n from inst group by 1 having count(*) >= 3),
pr as (select a.site_id as site1, b.site_id as site2, b.s - 10 as lo, b.e + 10 as hi from st a join ni on ni.site_id = a.site_id join st b on b.site_id <> a.site_id and greatest(a.s - b.e, b.s - a.e) >= 20),
want as (select site1, site2, lo, hi, variant_id from pr join inst on inst.site_id = pr.site1 union select site1, site2, lo, hi, 'WT' from pr)"""

_STATE = """site(site_id, bin, a, b) as (values ('nuc:60-99', 'nuc', 60, 99), ('TF:150-179', 'TF', 150, 179)),
st as (select m.read_id, m.variant_id, s.site_id, count(c.pos) / (any_value(s.b) - any_value(s.a) + 1) >= 0.5 as occupied
  from molecules m cross join site s left join coverage c on c.read_id = m.read_id and c.bin = s.bin and c.pos between s.a and s.b group by 1, 2, 3)"""

ORACLES = {
    "site_state": V.sql("molecules coverage", f"with {_STATE} select variant_id, site_id, count(*) as n, count(*) filter (occupied) as occupied from st group by 1, 2"),
    "conditional_2x2": V.sql(
        "molecules coverage",
        f"""with {_STATE}, p as (select variant_id, read_id, bool_or(occupied) filter (site_id = 'nuc:60-99') as o1, bool_or(occupied) filter (site_id = 'TF:150-179') as o2 from st group by 1, 2),
g as (select variant_id, count(*) filter (o1 and o2) as c11, count(*) filter (o1 and not o2) as c10, count(*) filter (not o1 and o2) as c01, count(*) filter (not o1 and not o2) as c00 from p group by 1)
select *, round(c11 / nullif(c11 + c10, 0), 9) as p1, round(c01 / nullif(c01 + c00, 0), 9) as p0 from g""",
    ),
    "cooccupancy_counts": V.sql(
        "molecules coverage",
        f"""with {_BASE},
oc as (select read_id, site_id from coverage c join st on c.bin = st.bin and c.pos between st.s and st.e group by read_id, site_id, st.s, st.e having count(*) / (st.e - st.s + 1) >= 0.5),
x as (select w.site1, w.site2, w.variant_id, o1.read_id is not null as a, o2.read_id is not null as b,
    coalesce(r.other <> r.variant_id and cast(regexp_extract(r.other, '^(\\d+):', 1) as int) - 1 between w.lo and w.hi, false) as dirty
  from want w join rc r using (variant_id) left join oc o1 on o1.read_id = r.read_id and o1.site_id = w.site1 left join oc o2 on o2.read_id = r.read_id and o2.site_id = w.site2)
select site1, site2, variant_id, count(*) filter (not a and not b) as c00, count(*) filter (not a and b) as c01, count(*) filter (a and not b) as c10, count(*) filter (a and b) as c11,
  count(*) filter (not a and not b and not dirty) as s00, count(*) filter (not a and b and not dirty) as s01, count(*) filter (a and not b and not dirty) as s10, count(*) filter (a and b and not dirty) as s11
from x group by 1, 2, 3""",
    ),
    "cooccupancy_secondary": V.sql(
        "molecules",
        f"""with {_BASE},
i as (select * from want where variant_id <> 'WT'),
n as (select site1, site2, count(*) as n_reads from i join rc using (variant_id) group by 1, 2),
k as (select site1, site2, other, count(*) as k from i join rc using (variant_id) where other <> variant_id and cast(regexp_extract(other, '^(\\d+):', 1) as int) - 1 between lo and hi group by 1, 2, 3),
t as (select site1, site2, max(k) as top, count(*) as n_secondary from k group by 1, 2)
select site1, site2, n_reads, coalesce(n_secondary, 0) as n_secondary, round(coalesce(top, 0) / n_reads, 9) as max_freq from n left join t using (site1, site2)""",
    ),
}
