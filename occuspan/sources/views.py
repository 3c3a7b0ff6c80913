"""Views over the shared tables in the shapes of the engine's inputs, each beside its DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occuspan.functions import tags
from occuspan.session import table

#: analysis window [start, end) of the derived molecules, and its sequence's length
WINDOW = (0, 300)

#: fixed values: label, track and inclusive length range of each bin; the last has no upper bound
BIN_SPEC = (("sub_TF", "tf", 10, 19), ("TF", "tf", 20, 39), ("PIC", "tf", 40, 60), ("nuc", "nuc", 80, None))


def bin_of(track, length, spec=BIN_SPEC):
    """Label of a footprint's bin, null where none fits."""
    out = F.lit(None).cast("string")
    for label, t, lo, hi in spec:
        fits = (track == t) & (length >= lo)
        out = F.when(fits if hi is None else fits & (length <= hi), F.lit(label)).otherwise(out)
    return out


def molecules(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_custkey") % 20 - 9
    base = lambda s: F.substring(F.lit(s), k.cast("int"), F.lit(1))
    snv = F.concat((101 + (k - 1) * 12).cast("string"), F.lit(":"), base("ACGTACGTAC"), F.lit(">"), base("CGTACGTACG"))
    bc = F.translate(F.substring(F.md5(F.col("o_custkey").cast("string")), 1, 15), "0123456789abcdef", "ACGTACGTACGTACGT")
    return o.select(F.col("o_orderkey").alias("read_id"), F.when(k < 1, "WT").otherwise(snv).alias("variant_id"), bc.alias("true_barcode"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    flag = F.col("l_returnflag")
    return li.select(
        F.col("l_orderkey").alias("read_id"),
        F.when(flag == "N", "nuc").when(flag == "A", "tf").otherwise("msp").alias("track"),
        (F.col("l_partkey") % 240).cast("int").alias("q_start"),
        F.when(flag == "N", 60 + 2 * F.col("l_quantity")).otherwise(9 + F.col("l_quantity")).cast("int").alias("length"),
    )


def read_nc(spark: SparkSession, d: str) -> DataFrame:
    n = segments(spark, d).where("track = 'nuc'").groupBy("read_id").agg(F.count(F.lit(1)).cast("int").alias("nc"))
    return molecules(spark, d).join(n, "read_id", "left").select("read_id", "variant_id", F.coalesce("nc", F.lit(0)).alias("nc"))


def barcodes(spark: SparkSession, d: str) -> DataFrame:
    b, first = F.col("true_barcode"), F.substring("true_barcode", 1, 1)
    rest = F.substring("true_barcode", 2, 100)
    return molecules(spark, d).select("read_id", F.when(F.col("read_id") % 10 == 0, F.concat(F.translate(first, "ACGT", "CGTA"), rest)).when(F.col("read_id") % 10 == 1, rest).otherwise(b).alias("barcode"))


def reads_meta(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("read_id"),
        F.when(F.col("o_orderstatus") == "F", "chr1").when(F.col("o_orderstatus") == "O", "plasmidA").otherwise("chrUn_1").alias("rname"),
        ((F.col("o_orderkey") % 97) / 100.0).cast("double").alias("m6a"),
        (300 + F.col("o_custkey") % 140 - 70).cast("int").alias("qlen"),
        F.when(F.col("o_orderkey") % 11 == 0, 3).otherwise(0).alias("ref_start"),
        F.lit(300).alias("ref_end"),
    )


def last_records(tagged: DataFrame) -> DataFrame:
    """One row for each read of a sample: its record of greatest ordinal. Re-delivered rows change nothing."""
    cols = [c for c in tagged.columns if c not in ("sample_id", "query_name")]
    g = tagged.groupBy("sample_id", "query_name").agg(F.max_by(F.struct(*cols), "ordinal").alias("r"))
    return g.select("sample_id", "query_name", *[F.col(f"r.{c}").alias(c) for c in cols])


def calls(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tagged_reads").select("ordinal", "sample_id", "query_name", "pv", "vc", "pr", "bc", "bq", "bk", "cs", "vq", "nc")
    return last_records(t)


def cluster_rows(spark: SparkSession, d: str) -> DataFrame:
    """``clusters`` with a known bin, sane bounds and each cluster_id once, with the library of its sample."""
    from occuspan.operators.intervals import bin_spelling

    c = table(spark, d, "clusters").where("variant_id is not null and abs_start >= 0 and abs_end >= abs_start")
    c = c.withColumn("bin", bin_spelling(F.col("bin_labels"))).where("bin is not null").drop("bin_labels", "called_at", "loaded_at")
    c = c.dropDuplicates(["cluster_id"])
    return c.join(table(spark, d, "samples").select("sample_id", "library"), "sample_id")


SQL = {
    "molecules": """molecules as (
  select o_orderkey as read_id,
    case when o_custkey % 20 < 10 then 'WT' else concat(cast(101 + (o_custkey % 20 - 10) * 12 as string), ':',
      substr('ACGTACGTAC', cast(o_custkey % 20 - 9 as int), 1), '>', substr('CGTACGTACG', cast(o_custkey % 20 - 9 as int), 1)) end as variant_id,
    translate(substr(md5(cast(o_custkey as string)), 1, 15), '0123456789abcdef', 'ACGTACGTACGTACGT') as true_barcode
  from orders)""",
    "segments": """segments as (
  select l_orderkey as read_id, case l_returnflag when 'N' then 'nuc' when 'A' then 'tf' else 'msp' end as track,
    cast(l_partkey % 240 as int) as q_start,
    cast(case when l_returnflag = 'N' then 60 + 2 * l_quantity else 9 + l_quantity end as int) as length
  from lineitem)""",
    "binned": """binned as (
  select *, case when track = 'tf' and length between 10 and 19 then 'sub_TF' when track = 'tf' and length between 20 and 39 then 'TF'
    when track = 'tf' and length between 40 and 60 then 'PIC' when track = 'nuc' and length >= 80 then 'nuc' end as bin from segments)""",
    "read_nc": """read_nc as (
  select read_id, variant_id, cast(coalesce(k, 0) as int) as nc from molecules
  left join (select read_id, count(*) as k from segments where track = 'nuc' group by 1) using (read_id))""",
    "barcodes": """barcodes as (
  select read_id, case when read_id % 10 = 0 then concat(translate(substr(true_barcode, 1, 1), 'ACGT', 'CGTA'), substr(true_barcode, 2))
    when read_id % 10 = 1 then substr(true_barcode, 2) else true_barcode end as barcode from molecules)""",
    "reads_meta": """reads_meta as (
  select o_orderkey as read_id, case o_orderstatus when 'F' then 'chr1' when 'O' then 'plasmidA' else 'chrUn_1' end as rname,
    cast(o_orderkey % 97 as double) / 100.0 as m6a, cast(300 + o_custkey % 140 - 70 as int) as qlen,
    case when o_orderkey % 11 = 0 then 3 else 0 end as ref_start, 300 as ref_end from orders)""",
    "coverage": """coverage as (
  select distinct read_id, bin, unnest(range(q_start, least(q_start + length, 300))) as pos from binned where bin is not null)""",
    "bins": "bins as (select unnest(['sub_TF', 'TF', 'PIC', 'nuc']) as bin)",
    "spine": "spine as (select bin, unnest(range(0, 300)) as pos from bins)",
    "occ": """depth as (select variant_id, count(*) as n_reads from molecules group by 1),
occ as (
  select d.variant_id, s.bin, s.pos, d.n_reads, coalesce(k, 0) as n_cov, coalesce(k, 0) / d.n_reads as occ
  from depth d cross join spine s left join (
    select variant_id, bin, pos, count(*) as k from coverage join molecules using (read_id) group by all) c
  on c.variant_id = d.variant_id and c.bin = s.bin and c.pos = s.pos)""",
    "delta": """delta as (
  select v.variant_id, v.bin, v.pos, v.n_reads, w.occ as wt_occ, v.occ - w.occ as delta
  from occ v join occ w on w.variant_id = 'WT' and w.bin = v.bin and w.pos = v.pos where v.variant_id <> 'WT')""",
    "calls": """calls as (
  select * from (select ordinal, sample_id, query_name, pv, vc, pr, bc, bq, bk, cs, vq, nc,
    row_number() over (partition by sample_id, query_name order by ordinal desc nulls last) as k_ from tagged_reads) where k_ = 1)""",
    "cluster_rows": r"""cluster_rows as (
  select c.*, s.library, case lower(regexp_replace(bin_labels, '^\s+|\s+$', '', 'g'))
      when 'sub_tf' then 'sub_TF' when 'tf' then 'TF' when 'pic' then 'PIC' when 'nuc' then 'nuc' end as bin
  from (select distinct on (cluster_id) * from clusters) c join samples s using (sample_id)
  where variant_id is not null and abs_start >= 0 and abs_end >= abs_start
    and lower(regexp_replace(bin_labels, '^\s+|\s+$', '', 'g')) in ('sub_tf', 'tf', 'pic', 'nuc'))""",
}

_NEEDS = {
    "binned": ("segments",),
    "read_nc": ("molecules", "segments"),
    "barcodes": ("molecules",),
    "coverage": ("binned",),
    "spine": ("bins",),
    "occ": ("molecules", "coverage", "spine"),
    "delta": ("occ",),
}


def sql(views: str, query: str, recursive: bool = False) -> str:
    """``query`` under a WITH of the named views and what they need."""
    order: list[str] = []

    def add(v: str) -> None:
        for n in _NEEDS.get(v, ()):
            add(n)
        if v not in order:
            order.append(v)

    for v in views.split():
        add(v)
    head = ",\n".join(SQL[v] for v in order)
    q = query.strip()
    word = "with recursive " if recursive else "with "
    if not head:
        return q
    return f"{word}{head}" + (",\n" + q[5:] if q.startswith("with ") else "\n" + q)


def ids_sql(tag: str) -> str:
    """DuckDB list of the ids of a tag."""
    return f"case when {tag} is null or {tag} = 'WT' then [] when json_valid({tag}) and {tag} like '[%' then cast(cast({tag} as json) as varchar[]) else [{tag}] end"


__all__ = ["BIN_SPEC", "WINDOW", "barcodes", "bin_of", "calls", "cluster_rows", "ids_sql", "molecules", "read_nc", "reads_meta", "segments", "sql", "tags"]
