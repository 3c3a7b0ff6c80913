"""Read filters with first-failure accounting, and projections of read tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occuspan.functions import tags
from occuspan.session import table
from occuspan.sources import views as V


def first_failure(steps: list[tuple[Column, str]], passed: str = "pass") -> Column:
    """One column that names the first condition which holds, in order; a null condition doesn't hold."""
    out = F.lit(passed)
    for cond, name in reversed(steps):
        out = F.when(cond, name).otherwise(out)
    return out


def disposition(m6a_range=(0.0, 0.9), length_slack=(40, 40), keep_genomic: bool = False) -> Column:
    """Stage-one fate of a read with ``rname, m6a, qlen, ref_start, ref_end, ref_len`` and ``kind`` (its contig's class)."""
    plasmid = F.col("kind") == "plasmid"
    steps = [
        (F.col("rname").isNull(), "unknown"),
        (F.col("kind") == "skip", "skip"),
        (F.col("ref_len").isNull(), "unknown"),
        (~F.col("m6a").between(*m6a_range), "methylation"),
        (plasmid & ~F.col("qlen").between(F.col("ref_len") - length_slack[0], F.col("ref_len") + length_slack[1]), "length"),
        (plasmid & ~((F.col("ref_start") == 0) & (F.col("ref_end") == F.col("ref_len"))), "alignment"),
    ]
    return first_failure(steps if keep_genomic else [*steps, (F.col("kind") == "genomic", "genomic_dropped")])


def with_contigs(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """Reads with length and class of their contig; contigs are classified once, and Spark broadcasts them if small."""
    c = contigs.withColumn("kind", tags.classify_contig(F.col("rname")))
    return reads.join(c, "rname", "left")


def _contigs(spark) -> DataFrame:
    return spark.createDataFrame([("chr1", 300), ("plasmidA", 300), ("chrUn_1", 300)], "rname string, ref_len int")


def filter_cascade(spark, d):
    r = with_contigs(V.reads_meta(spark, d), _contigs(spark)).withColumn("disposition", disposition())
    return r.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("m6a"), 6).alias("m6a_sum"))


def classify_contig(spark, d):
    names = V.reads_meta(spark, d).select(F.explode(F.array(F.col("rname"), F.concat(F.lit("CHR"), (F.col("read_id") % 30).cast("string"), F.lit("_alt")), F.concat(F.lit("c"), (F.col("read_id") % 7).cast("string"), F.lit("_Random")))).alias("rname"))
    return names.groupBy("rname", tags.classify_contig(F.col("rname")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def scan_read_stats(spark, d):
    """The scan's counters over the tagged reads: each read's first reason to be left out."""
    t = table(spark, d, "tagged_reads").select("ordinal", "pv", "vc", "pr", "nc").dropDuplicates(["ordinal"])
    why = first_failure([(F.col("pv").isNull(), "no_pv"), (F.col("vc").isNull(), "no_vc"), (F.col("pr").isNull(), "no_pr"), (F.col("nc").isNull() | (F.col("nc") < 0), "no_nc")])
    return t.groupBy(why.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def region_scan(spark, d):
    """Reads overlapping [120, 260): the predicate reaches the scan of a columnar source."""
    s = V.segments(spark, d).where((F.col("q_start") < 260) & (F.col("q_start") + F.col("length") > 120))
    return s.groupBy("track").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("read_id").alias("n_reads"))


def exclusion_report(spark, d):
    """Stage-two exclusions of the tagged reads by barcode state."""
    c = V.calls(spark, d)
    n = F.length("bc")
    status = first_failure([(F.col("pv").isNull(), "no_promoter_coverage"), (F.col("bc").isNull(), "no_barcode_coverage"), (n < 17, "barcode_too_short"), (n > 18, "barcode_too_long"), (F.col("bq") < 20, "low_barcode_quality")])
    return c.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def methylation_fraction(spark, d):
    r = V.reads_meta(spark, d)
    return r.groupBy("rname").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("m6a"), 9).alias("mean_m6a"), F.min("m6a").alias("lo"), F.max("m6a").alias("hi"))


def at_methylation(spark, d):
    """m6A share of A and T bases, with each barcode as the sequence and its read number as the calls."""
    b = V.barcodes(spark, d).withColumn("f", tags.at_fraction((F.col("read_id") % 5).cast("double"), F.col("barcode")))
    return b.groupBy((F.col("read_id") % 50).alias("part")).agg(F.round(F.sum("f"), 6).alias("f_sum"), F.round(F.max("f"), 9).alias("f_max"))


def methylation_histogram(spark, d):
    r = V.reads_meta(spark, d)
    b = F.least(F.floor(F.col("m6a") * 50 + 1e-9), F.lit(49)).cast("int")
    return r.groupBy(tags.classify_contig(F.col("rname")).alias("kind"), b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _ma(spark, d) -> DataFrame:
    """An MA string for each read: its segments by track, in order of start."""
    s = V.segments(spark, d)
    seg = F.concat((F.col("q_start") + 1).cast("string"), F.lit("-"), F.col("length").cast("string"))
    g = s.groupBy("read_id", "track").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("q_start", "length", seg.alias("t")))), lambda x: x["t"]), ",").alias("body"))
    part = F.concat("track", F.when(F.col("track") == "nuc", "+Q:").when(F.col("track") == "tf", "+QQQ:").otherwise("+:"), "body")
    m = g.groupBy("read_id").agg(F.array_join(F.array_sort(F.collect_list(part)), ";").alias("body"))
    return m.select("read_id", F.concat(F.lit("4000;"), "body").alias("ma"))


def parse_ma(spark, d):
    """MA strings written and read again: segments and bases by track."""
    t = _ma(spark, d).select(F.explode(tags.parse_ma(F.col("ma"))).alias("track", "segs")).select("track", F.explode("segs").alias("s"))
    return t.groupBy("track").agg(F.count(F.lit(1)).alias("n"), F.sum("s.start").cast("long").alias("starts"), F.sum("s.length").cast("long").alias("bases"))


def nuc_tags(spark, d):
    """Nucleosome count from MA, and read length per nucleosome."""
    m = _ma(spark, d).join(V.reads_meta(spark, d).select("read_id", "qlen"), "read_id")
    m = m.withColumn("nc", tags.nucleosome_count(F.lit(None).cast("int"), F.col("ma"), F.lit(None).cast("array<int>")))
    bn = F.when(F.col("nc") > 0, F.col("qlen") / F.col("nc")).otherwise(0.0)
    return m.groupBy("nc").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(bn), 4).alias("bn_sum"))


def parse_variant_tag(spark, d):
    """Reads by number of ids and the share of wild type in each library's samples."""
    c = V.calls(spark, d)
    ids = tags.variant_ids(F.col("pv"))
    return c.groupBy("sample_id", F.size(ids).alias("n_ids")).agg(F.count(F.lit(1)).alias("n"), F.min(F.array_join(ids, "|")).alias("first_tag"))


def parse_variant_id(spark, d):
    s = table(spark, d, "variant_summary").select("library", "variant_id")
    return s.select("library", "variant_id", tags.parse_variant_id(F.col("variant_id")).alias("p")).select("library", "variant_id", "p.*")


def raw_tag(spark, d):
    """Tags rebuilt from their ids: how many come back unchanged."""
    c = V.calls(spark, d).where("pv is not null")
    again = tags.raw_tag(tags.variant_ids(F.col("pv")))
    return c.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(again == F.col("pv"), 1)).alias("same"), F.max(again).alias("last_tag"))


def safe_name(spark, d):
    return table(spark, d, "variant_summary").select("variant_id").distinct().select("variant_id", tags.safe_name(F.col("variant_id")).alias("name"))


def sample_name(spark, d):
    return table(spark, d, "samples").select("sample_id", tags.sample_name(F.concat(F.lit("/data/"), "bam_name")).alias("name"))


def strand_map(spark, d):
    """Positions and bases of a minus-strand display of each library's variants."""
    s = table(spark, d, "variant_summary").where("position is not null")
    return s.select("library", "variant_id", tags.strand_position(F.col("position"), F.lit(1000), F.lit(5000), F.lit(True)).alias("offset"), tags.reverse_complement(F.upper("ref")).alias("ref_rc"), tags.reverse_complement(F.upper("alt")).alias("alt_rc"))


def variant_allowlist_semi(spark, d):
    """Reads of the variants on a list: here all with q below 0.1."""
    allow = table(spark, d, "variant_summary").where("variant_fdr_q < 0.1").select("variant_id").distinct()
    c = V.calls(spark, d).select("sample_id", F.explode(tags.variant_ids(F.col("pv"))).alias("variant_id"))
    return c.join(allow, "variant_id", "left_semi").groupBy("variant_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        filter_cascade, classify_contig, scan_read_stats, region_scan, exclusion_report, methylation_fraction, at_methylation, methylation_histogram,
        parse_ma, nuc_tags, parse_variant_tag, parse_variant_id, raw_tag, safe_name, sample_name, strand_map, variant_allowlist_semi,
    )
}

_ID = r"variant_id, '^\d+:"

ORACLES = {
    "filter_cascade": V.sql(
        "reads_meta",
        """
select case when rname = 'chrUn_1' then 'skip' when not (m6a between 0.0 and 0.9) then 'methylation'
    when rname = 'plasmidA' and not (qlen between 260 and 340) then 'length'
    when rname = 'plasmidA' and not (ref_start = 0 and ref_end = 300) then 'alignment'
    when rname = 'chr1' then 'genomic_dropped' else 'pass' end as disposition,
  count(*) as n, round(sum(m6a), 6) as m6a_sum from reads_meta group by 1""",
    ),
    "classify_contig": V.sql(
        "reads_meta",
        """
with x as (select unnest([rname, concat('CHR', cast(read_id % 30 as string), '_alt'), concat('c', cast(read_id % 7 as string), '_Random')]) as rname from reads_meta)
select rname, case when starts_with(lower(rname), 'chrun') or contains(lower(rname), '_random') then 'skip'
  when regexp_full_match(lower(rname), '(chr)?([1-9]|1[0-9]|2[0-2]|x|y|m|mt|ebv)') then 'genomic'
  when regexp_full_match(lower(rname), 'chr([1-9]|1[0-9]|2[0-2]|x|y|m|mt|ebv)_.*') then 'genomic' else 'plasmid' end as kind, count(*) as n
from x group by 1, 2""",
    ),
    "scan_read_stats": """
select case when pv is null then 'no_pv' when vc is null then 'no_vc' when pr is null then 'no_pr' when nc is null or nc < 0 then 'no_nc' else 'pass' end as status, count(*) as n
from (select distinct on (ordinal) * from tagged_reads) group by 1""",
    "region_scan": V.sql("segments", "select track, count(*) as n, count(distinct read_id) as n_reads from segments where q_start < 260 and q_start + length > 120 group by 1"),
    "exclusion_report": V.sql(
        "calls",
        """select case when pv is null then 'no_promoter_coverage' when bc is null then 'no_barcode_coverage' when length(bc) < 17 then 'barcode_too_short'
  when length(bc) > 18 then 'barcode_too_long' when bq < 20 then 'low_barcode_quality' else 'pass' end as status, count(*) as n from calls group by 1""",
    ),
    "methylation_fraction": V.sql("reads_meta", "select rname, count(*) as n, round(avg(m6a), 9) as mean_m6a, min(m6a) as lo, max(m6a) as hi from reads_meta group by 1"),
    "at_methylation": V.sql(
        "barcodes",
        """
with x as (select read_id, length(barcode) - length(replace(replace(barcode, 'A', ''), 'T', '')) as k from barcodes),
y as (select read_id, case when k > 0 then cast(read_id % 5 as double) / k else 0.0 end as f from x)
select read_id % 50 as part, round(sum(f), 6) as f_sum, round(max(f), 9) as f_max from y group by 1""",
    ),
    "methylation_histogram": V.sql("reads_meta", "select case rname when 'chr1' then 'genomic' when 'plasmidA' then 'plasmid' else 'skip' end as kind, cast(least(floor(m6a * 50 + 1e-9), 49) as int) as bucket, count(*) as n from reads_meta group by 1, 2"),
    "parse_ma": V.sql("segments", "select track, count(*) as n, cast(sum(q_start) as bigint) as starts, cast(sum(length) as bigint) as bases from segments group by 1"),
    "nuc_tags": V.sql(
        "segments reads_meta",
        """
with x as (select read_id, cast(count(*) filter (track = 'nuc') as int) as nc from segments group by 1)
select nc, count(*) as n, round(sum(case when nc > 0 then qlen / nc else 0 end), 4) as bn_sum from x join reads_meta using (read_id) group by 1""",
    ),
    "parse_variant_tag": V.sql("calls", f"select sample_id, len(ids) as n_ids, count(*) as n, min(array_to_string(ids, '|')) as first_tag from (select sample_id, {V.ids_sql('pv')} as ids from calls) group by 1, 2"),
    "parse_variant_id": rf"""
select library, variant_id, cast(regexp_extract(variant_id, '^(\d+):', 1) as int) as position,
  case when regexp_matches({_ID}[ACGTacgt]>[ACGTacgt]') then regexp_extract({_ID}([ACGTacgt])>', 1) when regexp_matches({_ID}\+[ACGTacgt]') then ''
    when regexp_matches({_ID}\d+[ACGTacgt]') then regexp_extract({_ID}\d+([ACGTacgt])', 1) end as ref,
  case when regexp_matches({_ID}[ACGTacgt]>[ACGTacgt]') then regexp_extract({_ID}[ACGTacgt]>([ACGTacgt])', 1) when regexp_matches({_ID}\+[ACGTacgt]') then regexp_extract({_ID}\+([ACGTacgt]+)', 1)
    when regexp_matches({_ID}\d+[ACGTacgt]') then '' end as alt,
  case when regexp_matches({_ID}[ACGTacgt]>[ACGTacgt]') then 'snv' when regexp_matches({_ID}\+[ACGTacgt]') then 'ins' when regexp_matches({_ID}\d+[ACGTacgt]') then 'del' else 'unknown' end as change_type
from variant_summary""",
    "raw_tag": V.sql(
        "calls",
        f"""
with x as (select sample_id, pv, list_sort({V.ids_sql('pv')}) as ids from calls where pv is not null),
y as (select *, case when len(ids) = 0 then 'WT' else concat('["', array_to_string(ids, '", "'), '"]') end as again from x)
select sample_id, count(*) as n, count(*) filter (again = pv) as same, max(again) as last_tag from y group by 1""",
    ),
    "safe_name": """
select distinct variant_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(variant_id, ':', '_'), '>', 'to'), '+', 'plus'), ' ', ''), '"', ''), '[', ''), ']', ''), ',', '_'), '/', '_') as name
from variant_summary""",
    "sample_name": r"select sample_id, regexp_replace(regexp_replace(bam_name, '\.bam$', ''), '\.tagged$', '') as name from samples",
    "strand_map": "select library, variant_id, 5000 - position as offset, reverse(translate(upper(ref), 'ACGT', 'TGCA')) as ref_rc, reverse(translate(upper(alt), 'ACGT', 'TGCA')) as alt_rc from variant_summary where position is not null",
    "variant_allowlist_semi": V.sql(
        "calls",
        f"""
with x as (select unnest({V.ids_sql('pv')}) as variant_id from calls)
select variant_id, count(*) as n from x where variant_id in (select variant_id from variant_summary where variant_fdr_q < 0.1) group by 1""",
    ),
}
