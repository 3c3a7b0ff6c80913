"""Alignments as block tables, variant calls, barcodes and the Levenshtein neighbourhood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occuspan.session import shuffle_partitions, spread, table
from occuspan.sources import views as V

#: fixed values: alignment operations by their codes
M, I, D, N, S, H, EQ, X = 0, 1, 2, 3, 4, 5, 7, 8
_QUERY, _REF = (M, I, S, EQ, X), (M, D, N, EQ, X)

BASES = "ACGT"


def cigar_blocks(reads: DataFrame) -> DataFrame:
    """``read_id, k, op, len, q, r``: each operation with the query and reference offset at which it begins.

    ``reads`` has ``read_id, ref_start, cigar array<struct<op,len>>``. The offsets are a fold over the array, so no
    shuffle takes place. Null and empty alignments give no blocks.
    """
    blocks = _blocks(F.col("cigar"), F.col("ref_start"))
    return reads.select("read_id", F.posexplode(blocks).alias("k", "b")).select("read_id", "k", "b.*")


def _blocks(cigar: Column, ref_start: Column) -> Column:
    start = F.struct(F.lit(0).alias("q"), ref_start.cast("int").alias("r"), F.array().cast("array<struct<op:int,len:int,q:int,r:int>>").alias("out"))

    def step(acc, c):
        return F.struct(
            (acc["q"] + F.when(c["op"].isin(*_QUERY), c["len"]).otherwise(0)).alias("q"),
            (acc["r"] + F.when(c["op"].isin(*_REF), c["len"]).otherwise(0)).alias("r"),
            F.concat(acc["out"], F.array(F.struct(c["op"].alias("op"), c["len"].alias("len"), acc["q"].alias("q"), acc["r"].alias("r")))).alias("out"),
        )

    return F.aggregate(cigar, start, step, lambda a: a["out"])


def call_variants(reads: DataFrame, ref: str, prom: tuple[int, int], bc: tuple[int, int] | None = None, min_quality: int = 0, bc_length=(13, 17)) -> DataFrame:
    """``read_id, status, var_ids, barcode, barcode_qual, bc_status`` of aligned reads, by array expressions alone.

    ``reads`` has ``read_id, ref_start, ref_end, cigar, seq, qual`` (qual may be null). ``prom`` is 0-based and
    inclusive at both ends, ``bc`` half-open; ``ref`` holds the promoter's bases. Mismatches need the base's
    quality, insertions the least quality of their bases, deletions none. An M before the walk's end rejects the
    read. Ids come in the alignment's order. Reads that miss the promoter have no calls.
    """
    ps, pe = prom
    end = max(pe, bc[1]) if bc else pe
    # each step is a projection of its own: what several expressions read is computed once
    reads = reads.withColumn("_blocks", F.filter(_blocks(F.col("cigar"), F.col("ref_start")), lambda b: b["r"] <= end))
    blocks = F.col("_blocks")
    seq, qual = F.col("seq"), F.col("qual")
    good = lambda q0, n: F.coalesce(F.array_min(F.slice(qual, q0 + 1, n)) >= min_quality, F.lit(True))
    ref_ = F.lit(ref)
    none = F.array().cast("array<string>")

    def ids(b):
        lo, hi = F.greatest(b["r"], F.lit(ps)), F.least(b["r"] + b["len"], F.lit(pe + 1))
        overlaps = lo < hi
        sites = F.filter(F.sequence(lo, F.greatest(lo, hi - 1)), lambda p: (p - ps < len(ref)) & good(b["q"] + p - b["r"], F.lit(1)))
        snv = F.transform(sites, lambda p: F.concat((p + 1).cast("string"), F.lit(":"), F.substring(ref_, p - ps + 1, F.lit(1)), F.lit(">"), F.substring(seq, b["q"] + p - b["r"] + 1, F.lit(1))))
        ins = F.array(F.concat((b["r"] + 1).cast("string"), F.lit(":+"), F.substring(seq, b["q"] + 1, b["len"])))
        gone = F.substring(ref_, lo - ps + 1, hi - lo)
        dele = F.array(F.concat((lo + 1).cast("string"), F.lit(":"), F.length(gone).cast("string"), gone))
        return (
            F.when((b["op"] == X) & overlaps, snv)
            .when((b["op"] == I) & b["r"].between(ps, pe) & good(b["q"], b["len"]), ins)
            .when((b["op"] == D) & overlaps, dele)
            .otherwise(none)
        )

    def spots(b):
        lo, hi = F.greatest(b["r"], F.lit(bc[0])), F.least(b["r"] + b["len"], F.lit(bc[1]))
        return F.when(b["op"].isin(EQ, X) & (lo < hi), F.sequence(b["q"] + lo - b["r"], b["q"] + F.greatest(lo, hi - 1) - b["r"])).otherwise(F.array().cast("array<int>"))

    covered = F.col("cigar").isNotNull() & F.col("ref_end").isNotNull() & (F.col("ref_start") <= pe) & (F.col("ref_end") > ps)
    forbidden = F.exists(blocks, lambda b: b["op"] == M)
    state0 = F.when(~covered, "no_promoter_coverage").when(forbidden, "forbidden_cigar").otherwise("pass")
    busy = F.filter(blocks, lambda b: b["op"].isin(X, I, D))
    step = reads.select("read_id", "seq", "qual", "_blocks", busy.alias("_busy"), state0.alias("status"))
    blocks, status = F.col("_blocks"), F.col("status")
    cols = ["read_id", "seq", "qual", "status", F.when(status == "pass", F.flatten(F.transform("_busy", ids))).otherwise(none).alias("var_ids")]
    if not bc:
        return step.select(*cols).drop("seq", "qual")
    step = step.select(*cols, F.when(status == "pass", F.flatten(F.transform(blocks, spots))).otherwise(F.array().cast("array<int>")).alias("_at"))
    at, n = F.col("_at"), F.size("_at")
    state = (
        F.when(status == "forbidden_cigar", "forbidden_cigar").when((status != "pass") | (n == 0), "no_barcode_coverage").when(n < bc_length[0], "barcode_too_short").when(n > bc_length[1], "barcode_too_long").otherwise("pass")
    )
    step = step.withColumn("bc_status", state)
    ok = F.col("bc_status") == "pass"
    text = F.array_join(F.transform(at, lambda p: F.substring(seq, p + 1, F.lit(1))), "")
    mean = F.aggregate(at, F.lit(0.0), lambda s, p: s + F.element_at(qual, p + 1)) / n
    return step.select("read_id", "status", "var_ids", F.when(ok, text).alias("barcode"), F.when(ok & qual.isNotNull(), mean).alias("barcode_qual"), "bc_status")


def d1_neighbours(bc: Column) -> Column:
    """All distinct strings at Levenshtein distance one from a barcode, itself excluded."""
    n = F.length(bc)
    base = F.array(*[F.lit(b) for b in BASES])
    left = lambda i: F.substring(bc, F.lit(1), i)
    right = lambda i: F.substring(bc, i + 1, n)
    spots = F.sequence(F.lit(0), n)
    ins = F.flatten(F.transform(spots, lambda i: F.transform(base, lambda b: F.concat(left(i), b, right(i)))))
    inner = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    sub = F.flatten(F.transform(inner, lambda i: F.transform(base, lambda b: F.concat(left(i), b, right(i + 1)))))
    dele = F.transform(inner, lambda i: F.concat(left(i), right(i + 1)))
    return F.array_remove(F.array_distinct(F.concat(ins, sub, dele)), bc)


def deletions(bc: Column) -> Column:
    """A barcode and the strings one deletion away: two barcodes within distance 1 share one of them."""
    n = F.length(bc)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.concat(F.substring(bc, F.lit(1), i), F.substring(bc, i + 2, n)))
    return F.array_distinct(F.concat(F.array(bc), cut))


def deletions2(bc: Column) -> Column:
    """A barcode and the strings up to two deletions away: two barcodes within distance 2 share one of them."""
    return F.array_distinct(F.flatten(F.transform(deletions(bc), deletions)))


def levenshtein_pairs(bcs: DataFrame, limit: int = 2) -> DataFrame:
    """``a, b, dist`` of distinct barcodes within a distance of 1 or 2, a < b.

    Barcodes meet where they share a string of up to ``limit`` deletions, an equality join, and the distance is
    then computed; every pair within the limit shares one. Nulls are left out. The keys are always sorted and merged:
    Spark takes their size for that of the barcodes, of which each becomes up to 120 keys, and would broadcast them.
    """
    keys = deletions(F.col("barcode")) if limit == 1 else deletions2(F.col("barcode"))
    # a number of partitions and not a size: each short string becomes very many keys
    one = bcs.where("barcode is not null").select("barcode").distinct().repartition(shuffle_partitions(bcs.sparkSession))
    k = one.select("barcode", F.explode(keys).alias("key"))
    p = k.select("key", F.col("barcode").alias("a")).join(k.select("key", F.col("barcode").alias("b")).hint("merge"), "key").where("a < b").select("a", "b").distinct()
    return p.withColumn("dist", F.levenshtein("a", "b")).where(F.col("dist") <= limit)


def _synthetic(spark, d) -> DataFrame:
    """Alignments made from lineitem: each line a short run of operations."""
    li = spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"))
    q = F.col("l_quantity").cast("int")
    c = lambda op, n: F.struct(F.lit(op).alias("op"), n.cast("int").alias("len"))
    cig = F.array(c(S, q % 5 + 1), c(EQ, q + 3), c(X, q % 3 + 1), c(I, q % 4 + 1), c(EQ, F.lit(20)), c(D, q % 6 + 1), c(EQ, q))
    rid = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return li.select(rid.alias("read_id"), F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 50).cast("int").alias("ref_start"), cig.alias("cigar"), q.alias("qty"), F.col("l_returnflag").alias("flag"), (F.col("l_partkey") % 17).cast("int").alias("at"))


def cigar_blocks_q(spark, d):
    b = cigar_blocks(_synthetic(spark, d))
    return b.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("len").cast("long").alias("bases"), F.sum("q").cast("long").alias("q_sum"), F.sum("r").cast("long").alias("r_sum"))


def _aligned(spark, d) -> DataFrame:
    r = _synthetic(spark, d)
    n = F.aggregate("cigar", F.lit(0), lambda a, c: a + F.when(c["op"].isin(*_QUERY), c["len"]).otherwise(0))
    span = F.aggregate("cigar", F.lit(0), lambda a, c: a + F.when(c["op"].isin(*_REF), c["len"]).otherwise(0))
    r = r.withColumn("n", n).withColumn("ref_end", F.col("ref_start") + span)
    hexes = F.translate(F.concat(*[F.md5(F.concat(F.col("s").cast("string"), F.lit(f"/{i}"))) for i in range(6)]), "0123456789abcdef", "ACGTACGTACGTACGT")
    return r.withColumn("seq", F.substring(hexes, F.lit(1), F.col("n"))).withColumn("qual", F.transform(F.sequence(F.lit(1), "n"), lambda i: (i * 7 + F.col("qty")) % 40))


#: reference bases of the derived alignments
REF = "ACGTTGCAAC" * 12


def call_variants_q(spark, d):
    """Calls of the derived alignments, by read state and id."""
    c = call_variants(_aligned(spark, d), REF, (30, 89), (60, 80), 10)
    return c.groupBy("status", "bc_status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("var_ids")).cast("long").alias("n_ids"))


def variant_calls(spark, d):
    """Reads of each call of the derived alignments."""
    c = call_variants(_aligned(spark, d), REF, (30, 89), (60, 80), 10)
    return c.select(F.explode("var_ids").alias("variant_id")).groupBy("variant_id").agg(F.count(F.lit(1)).alias("n"))


def extract_barcode(spark, d):
    """Barcodes of the derived alignments by length."""
    c = call_variants(_aligned(spark, d), REF, (0, 119), (10, 25), 0, (8, 15)).where("bc_status = 'pass'")
    return c.groupBy(F.length("barcode").alias("len")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("barcode_qual"), 4).alias("qual_sum"), F.min("barcode").alias("first_bc"))


def barcode_levenshtein_pairs(spark, d):
    return levenshtein_pairs(V.barcodes(spark, d))


def d1_neighbour_count(spark, d):
    """How many neighbours each distinct barcode has, by length."""
    b = V.barcodes(spark, d).select("barcode").distinct()
    return b.groupBy(F.length("barcode").alias("len"), F.size(d1_neighbours(F.col("barcode"))).alias("neighbours")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "cigar_blocks": cigar_blocks_q,
    "call_variants": call_variants_q,
    "variant_calls": variant_calls,
    "extract_barcode": extract_barcode,
    "barcode_levenshtein_pairs": barcode_levenshtein_pairs,
    "d1_neighbour_count": d1_neighbour_count,
}

#: the derived alignments in SQL: their paired blocks, and what the caller needs of the others
_AL = """
x as (select row_number() over () as read_id, cast(l_quantity as int) as q, cast(l_partkey % 50 as int) as r0,
    translate(concat(md5(concat(l_suppkey, '/0')), md5(concat(l_suppkey, '/1')), md5(concat(l_suppkey, '/2')), md5(concat(l_suppkey, '/3')), md5(concat(l_suppkey, '/4')), md5(concat(l_suppkey, '/5'))), '0123456789abcdef', 'ACGTACGTACGTACGT') as seq
  from lineitem),
y as (select *, q % 5 + 1 as qa, q % 5 + 1 + q + 3 as qx, q % 5 + 1 + q + 3 + q % 3 + 1 as qi, q % 5 + 1 + q + 3 + q % 3 + 1 + q % 4 + 1 as qb, q % 5 + 1 + q + 3 + q % 3 + 1 + q % 4 + 1 + 20 as qc,
    r0 + q + 3 as rx, r0 + q + 3 + q % 3 + 1 as ri, r0 + q + 3 + q % 3 + 1 + 20 as rd, r0 + q + 3 + q % 3 + 1 + 20 + q % 6 + 1 as rc from x),
z as (select *, rc + q as ref_end from y),
paired as (select read_id, q, seq, unnest([{'k': qa, 'r': r0, 'n': q + 3}, {'k': qx, 'r': rx, 'n': q % 3 + 1}, {'k': qb, 'r': ri, 'n': 20}, {'k': qc, 'r': rc, 'n': q}]) as o from z)"""
_IDS = f"""
snv0 as (select read_id, q, qx, rx, seq, unnest(range(greatest(rx, 30), least(rx + q % 3 + 1, 90))) as p from z where r0 <= 89 and ref_end > 30 and rx <= 89),
ids as (
  select read_id, concat(p + 1, ':', substr('{REF}', cast(p - 30 + 1 as bigint), 1), '>', substr(seq, cast(qx + p - rx + 1 as bigint), 1)) as id from snv0 where ((qx + p - rx + 1) * 7 + q) % 40 >= 10 and p - 30 < {len(REF)}
  union all
  select read_id, concat(ri + 1, ':+', substr(seq, qi + 1, q % 4 + 1)) from z where r0 <= 89 and ref_end > 30 and ri between 30 and 89 and list_min(list_transform(range(0, q % 4 + 1), lambda j: ((qi + j + 1) * 7 + q) % 40)) >= 10
  union all
  select read_id, concat(greatest(rd, 30) + 1, ':', least(rd + q % 6 + 1, 90) - greatest(rd, 30), substr('{REF}', greatest(rd, 30) - 30 + 1, least(rd + q % 6 + 1, 90) - greatest(rd, 30)))
    from z where r0 <= 89 and ref_end > 30 and rd <= 89 and greatest(rd, 30) < least(rd + q % 6 + 1, 90))"""

ORACLES = {
    "call_variants": f"""
with {_AL}, {_IDS},
sp as (select read_id, sum(greatest(0, least(o.r + o.n, 80) - greatest(o.r, 60))) as n from paired group by 1),
k as (select read_id, count(*) as n_ids from ids group by 1)
select status, case when status <> 'pass' or n = 0 then 'no_barcode_coverage' when n < 13 then 'barcode_too_short' when n > 17 then 'barcode_too_long' else 'pass' end as bc_status,
  count(*) as n, cast(sum(coalesce(n_ids, 0)) as bigint) as n_ids
from (select z.*, sp.n, k.n_ids, case when r0 <= 89 and ref_end > 30 then 'pass' else 'no_promoter_coverage' end as status from z join sp using (read_id) left join k using (read_id)) group by 1, 2""",
    "variant_calls": f"with {_AL}, {_IDS} select id as variant_id, count(*) as n from ids group by 1",
    "extract_barcode": f"""
with {_AL},
at0 as (select read_id, q, seq, unnest(range(o.k + greatest(o.r, 10) - o.r, o.k + least(o.r + o.n, 25) - o.r)) as k from paired where greatest(o.r, 10) < least(o.r + o.n, 25)),
b as (select read_id, count(*) as len, string_agg(substr(seq, cast(k + 1 as bigint), 1), '' order by k) as bc, avg(((k + 1) * 7 + q) % 40) as bq from at0 group by 1)
select cast(len as int) as len, count(*) as n, round(sum(bq), 4) as qual_sum, min(bc) as first_bc from b where len between 8 and 15 group by 1""",
    "d1_neighbour_count": V.sql(
        "barcodes",
        """
with b as (select distinct barcode from barcodes where barcode is not null),
i as (select barcode, unnest(range(0, length(barcode) + 1)) as i from b),
x as (select barcode, i, unnest(['A', 'C', 'G', 'T']) as c from i),
s as (
  select barcode, concat(substr(barcode, 1, i), c, substr(barcode, i + 1)) as s from x
  union select barcode, concat(substr(barcode, 1, i), c, substr(barcode, i + 2)) from x where i < length(barcode)
  union select barcode, concat(substr(barcode, 1, i), substr(barcode, i + 2)) from i where i < length(barcode))
select cast(length(barcode) as int) as len, cast(k as int) as neighbours, count(*) as n from (select barcode, count(*) as k from s where s <> barcode group by 1) group by 1, 2""",
    ),
    "cigar_blocks": f"""
with x as (select cast(l_quantity as int) as q, cast(l_partkey % 50 as int) as r0 from lineitem),
ops as (select unnest([
  {{'op': {S}, 'len': q % 5 + 1, 'q': 0, 'r': r0}}, {{'op': {EQ}, 'len': q + 3, 'q': q % 5 + 1, 'r': r0}},
  {{'op': {X}, 'len': q % 3 + 1, 'q': q % 5 + 1 + q + 3, 'r': r0 + q + 3}}, {{'op': {I}, 'len': q % 4 + 1, 'q': q % 5 + 1 + q + 3 + q % 3 + 1, 'r': r0 + q + 3 + q % 3 + 1}},
  {{'op': {EQ}, 'len': 20, 'q': q % 5 + 1 + q + 3 + q % 3 + 1 + q % 4 + 1, 'r': r0 + q + 3 + q % 3 + 1}},
  {{'op': {D}, 'len': q % 6 + 1, 'q': q % 5 + 1 + q + 3 + q % 3 + 1 + q % 4 + 1 + 20, 'r': r0 + q + 3 + q % 3 + 1 + 20}},
  {{'op': {EQ}, 'len': q, 'q': q % 5 + 1 + q + 3 + q % 3 + 1 + q % 4 + 1 + 20, 'r': r0 + q + 3 + q % 3 + 1 + 20 + q % 6 + 1}}]) as o from x)
select o.op as op, count(*) as n, cast(sum(o.len) as bigint) as bases, cast(sum(o.q) as bigint) as q_sum, cast(sum(o.r) as bigint) as r_sum from ops group by 1""",
    "barcode_levenshtein_pairs": V.sql(
        "barcodes",
        """
with b as (select distinct barcode from barcodes)
select x.barcode as a, y.barcode as b, levenshtein(x.barcode, y.barcode) as dist from b x join b y on x.barcode < y.barcode and levenshtein(x.barcode, y.barcode) <= 2""",
    ),
}
