"""Reads as molecules: modified bases, footprint tracks, and their places on the reference through the alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occuspan.functions import tags
from occuspan.operators import calling as C
from occuspan.operators import occupancy as O
from occuspan.sources import views as V

#: fixed values: alignment operations that pair query and reference bases
ALIGNED = (C.M, C.EQ, C.X)


def on_reference(tracks: Column, cigar: Column, ref_start: Column) -> Column:
    """Stretches ``track, length, r_start, r_end`` that a read's footprints cover on the reference, as one array.

    ``tracks`` maps a track to its 0-based query starts and lengths. A footprint is cut at the bounds of the query and
    wherever the alignment has an insertion, a deletion or a clip; only bases paired with the reference place it, and
    ``length`` stays that of the whole footprint. Null and empty tracks or alignments give none. It is one expression
    over the row's own arrays, so no read is joined or shuffled.
    """
    paired = F.filter(C._blocks(cigar, ref_start), lambda b: b["op"].isin(*ALIGNED))
    segments = F.flatten(F.transform(F.map_entries(tracks), lambda t: F.transform(t["value"], lambda s: F.struct(t["key"].alias("track"), s["start"].alias("start"), s["length"].alias("length")))))

    def placed(s: Column) -> Column:
        lo = lambda b: F.greatest(s["start"], b["q"], F.lit(0))
        hi = lambda b: F.least(s["start"] + s["length"], b["q"] + b["len"])
        hit = F.filter(paired, lambda b: lo(b) < hi(b))
        return F.transform(hit, lambda b: F.struct(s["track"].alias("track"), s["length"].alias("length"), (b["r"] + lo(b) - b["q"]).alias("r_start"), (b["r"] + hi(b) - b["q"]).alias("r_end")))

    return F.flatten(F.transform(segments, placed))


def footprints(reads: DataFrame) -> DataFrame:
    """``read_id, track, length, r_start, r_end`` of reads with ``read_id, ref_start, cigar`` and BAM ``tags``.

    Tracks come from MA where a read has it, else from the older tags; the result is what :func:`occuspan.operators.occupancy.binned` reads.
    """
    t = lambda n: F.element_at("tags", n)
    tr = tags.tracks(t("MA"), *(tags.tag_array(t(n)) for n in ("ns", "nl", "as", "al")))
    return reads.select("read_id", F.explode(on_reference(tr, F.col("cigar"), F.col("ref_start"))).alias("f")).select("read_id", "f.*")


def with_methylation(reads: DataFrame) -> DataFrame:
    """``reads`` with ``m6a``: adenine calls of the modified-base tag as a share of the sequence's A and T bases; 0 without calls."""
    mm = F.coalesce(F.element_at("tags", "MM"), F.element_at("tags", "Mm"))
    return reads.withColumn("m6a", F.coalesce(tags.at_fraction(tags.modified_calls(mm).cast("double"), F.col("seq")), F.lit(0.0)))


# queries --------------------------------------------------------------------------------------------------


def _aligned_footprints(spark, d) -> DataFrame:
    """The derived alignments (clips, insertions and deletions included), each with one footprint of its line's track."""
    r = C._synthetic(spark, d)
    seg = F.struct(F.col("at").alias("start"), F.when(F.col("flag") == "N", 60 + F.col("qty")).otherwise(9 + F.col("qty")).cast("int").alias("length"))
    return r.withColumn("tracks", F.create_map(F.when(F.col("flag") == "N", "nuc").when(F.col("flag") == "A", "tf").otherwise("msp"), F.array(seg)))


def mapped_coverage(spark, d):
    """Depth of each bin at each reference position, over alignments with clips, insertions and deletions."""
    r = _aligned_footprints(spark, d)
    s = r.select("read_id", F.explode(on_reference(F.col("tracks"), F.col("cigar"), F.col("ref_start"))).alias("f")).select("read_id", "f.*")
    c = O.covered(O.binned(s), (10, 130))
    return c.select("bin", F.explode(F.sequence("s", F.col("e") - 1)).alias("pos")).groupBy("bin", "pos").agg(F.count(F.lit(1)).alias("n_reads"))


def mapped_stretches(spark, d):
    """Stretches and bases that footprints keep on the reference, by track and by their number of pieces."""
    r = _aligned_footprints(spark, d)
    s = r.select(F.map_keys("tracks")[0].alias("track"), on_reference(F.col("tracks"), F.col("cigar"), F.col("ref_start")).alias("f"))
    bases = F.aggregate("f", F.lit(0), lambda a, x: a + x["r_end"] - x["r_start"])
    return s.groupBy("track", F.size("f").alias("pieces")).agg(F.count(F.lit(1)).alias("n"), F.sum(bases).cast("long").alias("bases"), F.sum(F.coalesce(F.array_min(F.transform("f", lambda x: x["r_start"])), F.lit(0))).cast("long").alias("first_sum"))


def modified_base_fraction(spark, d):
    """Adenine calls read from modified-base tags, as a share of A and T bases, by read state under the default range."""
    b = V.barcodes(spark, d)
    mm = F.concat(F.lit("A+a"), F.repeat(F.lit(",1"), (F.col("read_id") % 5).cast("int")), F.lit(";T-a."), F.repeat(F.lit(",0"), (F.col("read_id") % 3).cast("int")), F.lit(";C+mh,2,3;N+21839,4;"))
    r = with_methylation(b.select("read_id", F.col("barcode").alias("seq"), F.create_map(F.lit("MM"), mm).alias("tags")))
    return r.groupBy(F.col("m6a").between(0.0, 0.9).alias("kept"), (F.col("read_id") % 15).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("m6a"), 6).alias("m6a_sum"))


QUERIES = {f.__name__: f for f in (mapped_coverage, mapped_stretches, modified_base_fraction)}

_PLACED = f"""
with x as (select row_number() over () as row_id, l_orderkey * 8 + l_linenumber as read_id, cast(l_quantity as int) as q, cast(l_partkey % 50 as int) as r0, cast(l_partkey % 17 as int) as a,
    case l_returnflag when 'N' then 'nuc' when 'A' then 'tf' else 'msp' end as track,
    cast(case l_returnflag when 'N' then 60 + cast(l_quantity as int) else 9 + cast(l_quantity as int) end as int) as length from lineitem),
ops as (select row_id, read_id, track, length, a, unnest([
  {{'len': q + 3, 'q': q % 5 + 1, 'r': r0}},
  {{'len': q % 3 + 1, 'q': q % 5 + 1 + q + 3, 'r': r0 + q + 3}},
  {{'len': 20, 'q': q % 5 + 1 + q + 3 + q % 3 + 1 + q % 4 + 1, 'r': r0 + q + 3 + q % 3 + 1}},
  {{'len': q, 'q': q % 5 + 1 + q + 3 + q % 3 + 1 + q % 4 + 1 + 20, 'r': r0 + q + 3 + q % 3 + 1 + 20 + q % 6 + 1}}]) as o from x),
st as (select row_id, read_id, track, length, o.r + greatest(a, o.q) - o.q as s, o.r + least(a + length, o.q + o.len) - o.q as e from ops where greatest(a, o.q) < least(a + length, o.q + o.len))"""

ORACLES = {
    "mapped_coverage": _PLACED
    + """,
b as (select *, case when track = 'tf' and length between 10 and 19 then 'sub_TF' when track = 'tf' and length between 20 and 39 then 'TF'
    when track = 'tf' and length between 40 and 60 then 'PIC' when track = 'nuc' and length >= 80 then 'nuc' end as bin from st),
c as (select distinct read_id, bin, unnest(range(s, e)) as pos from b where bin is not null)
select bin, cast(pos as int) as pos, count(*) as n_reads from c where pos between 10 and 129 group by 1, 2""",
    "mapped_stretches": _PLACED
    + """,
p as (select row_id, count(*) as pieces, sum(e - s) as bases, min(s) as first from st group by 1)
select track, cast(coalesce(pieces, 0) as int) as pieces, count(*) as n, cast(sum(coalesce(bases, 0)) as bigint) as bases, cast(sum(coalesce(first, 0)) as bigint) as first_sum
from x left join p using (row_id) group by 1, 2""",
    "modified_base_fraction": V.sql(
        "barcodes",
        r"""
with x as (select read_id, barcode, concat('A+a', repeat(',1', cast(read_id % 5 as int)), ';T-a.', repeat(',0', cast(read_id % 3 as int)), ';C+mh,2,3;N+21839,4;') as mm from barcodes),
y as (select read_id, list_sum(list_transform(list_filter(string_split(mm, ';'), lambda s: regexp_matches(s, '^[ACGTUN][+-][a-z]*a')), lambda s: len(string_split(s, ',')) - 1)) as k,
  length(barcode) - length(replace(replace(barcode, 'A', ''), 'T', '')) as n from x),
z as (select read_id, case when n > 0 then k / n else 0.0 end as f from y)
select f between 0 and 0.9 as kept, read_id % 15 as part, count(*) as n, round(sum(f), 6) as m6a_sum from z group by 1, 2""",
    ),
}
