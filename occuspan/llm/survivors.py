"""Problem 3: the best representative of each duplicate group.

``survivors`` picks, for each field, the record that deserves trust for it. ``fuse`` weighs the values of
several sources by Bayesian fusion with copy detection. The rows that TESTDATA.md asks for in ``p3_found``
are an order of preference on single records, which posteriors over sources can't give, so that query
uses ``survivors``; ``p3_fused`` holds the fusion's answer beside it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from occuspan.llm.barcodes import READ_SQL, read_barcode
from occuspan.llm.digests import as_array
from occuspan.session import Written, table


def survivors(df: DataFrame, keys: list[str], record_id: str, fields: dict[str, tuple[Column, list[Column]]]) -> DataFrame:
    """One row for each key with at least two distinct record ids: ``keys`` and, for each field, the id that supplies it.

    ``fields`` maps an output name to (qualifies, preferences): among qualifying records the one whose
    preferences are greatest, in turn, wins, and the smallest record id breaks ties; null preferences come
    last; -1 where none qualifies. Every maximum is a partial aggregate, so a key that holds a third of all
    rows is reduced before the shuffle. Repeated rows of one record id change nothing.
    """
    aggs = [F.min(record_id).alias("_lo"), F.max(record_id).alias("_hi")]
    for name, (ok, prefs) in fields.items():
        rank = F.struct(*[p.alias(f"f{i}") for i, p in enumerate(prefs)], (-F.col(record_id)).alias("id"))
        aggs.append(F.max(F.when(ok, rank)).alias(name))
    g = df.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(*aggs).where("_lo <> _hi")
    return g.select(*keys, *[F.coalesce(-F.col(f"{n}.id"), F.lit(-1).cast("long")).alias(n) for n in fields])


def usable_tag(tag: Column) -> Column:
    """True where the trimmed tag is WT in any case or a JSON list of strings with at least one."""
    t = F.regexp_replace(tag, r"(?U)^\s+|\s+$", "")
    ids = F.from_json(t, "array<string>", {"mode": "PERMISSIVE"})
    return F.coalesce((F.upper(t) == "WT") | (t.startswith("[") & t.endswith("]") & (F.size(F.filter(ids, lambda x: F.length(x) > 0)) > 0)), F.lit(False))


def read_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``barcode_cluster_resolution`` with its barcode as read; rows without a barcode are left out."""
    r = table(spark, sf_dir, "barcode_cluster_resolution")
    return r.select(
        "library", read_barcode(F.col("cluster_barcode")).alias("cluster_barcode"), "resolution_id", "consensus_variant_tag", "variant_support", "total_reads", "resolved_at", "resolver"
    ).where("cluster_barcode is not null")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that supply tag and support, and total reads, of each barcode resolved more than once."""
    df = read_records(spark, sf_dir)
    support, when = F.col("variant_support"), F.col("resolved_at")
    return survivors(
        df,
        ["library", "cluster_barcode"],
        "resolution_id",
        {
            "tag_id": (usable_tag(F.col("consensus_variant_tag")) & (support > 0) & (support <= 1), [support, when]),
            "reads_id": (F.col("total_reads") > 0, [when]),
        },
    )


#: links between sources that one pass ships to the executors (about 40 bytes each); more are taken in blocks of this many
PAIR_BLOCK = 2_000_000

#: share of items that a copier copies
COPIED = 0.8


def _lags(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, earlier rows of the same group) for each distance within groups; ``group`` is sorted."""
    k = 1
    while True:
        at = np.flatnonzero(group[k:] == group[:-k]) + k if k < len(group) else group[:0]
        if not len(at):
            return
        yield at, at - k
        k += 1


def _flat(t: pa.Table) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    """Key's row, order, source and value of each claim of a table of claim lists."""
    c = as_array(t.column("claims"))
    row = np.repeat(np.arange(len(c)), np.diff(c.offsets.to_numpy()))
    f = c.flatten()
    return row, *(f.field(n) for n in ("o", "source", "value"))


def _coded(x: pa.Array) -> tuple[np.ndarray, list]:
    d = x.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist()


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pair of sources of each batch: the items on which both say the same minority value, the same leading value, and unlike values."""
    for b in batches:
        row, _, source, value = _flat(pa.Table.from_batches([b]))
        s, names = _coded(source)
        rank = np.argsort(np.argsort(np.array(names, dtype=object))) if names else np.empty(0, int)
        v, said = _coded(value)
        num = {x: i for i, x in enumerate(said)}
        lead = np.array([num.get(x, -1) for x in b.column(b.schema.get_field_index("lead")).to_pylist()], dtype=np.int64)[row]
        found, kinds = [], []
        for i, j in _lags(row):
            lo, hi = np.where(rank[s[i]] < rank[s[j]], s[i], s[j]), np.where(rank[s[i]] < rank[s[j]], s[j], s[i])
            found.append(lo.astype(np.int64) * len(names) + hi)
            kinds.append(np.where(v[i] != v[j], 2, np.where(v[i] == lead[i], 1, 0)))
        code, at = np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_inverse=True)
        n = np.bincount(at * 3 + np.concatenate([np.empty(0, np.int64), *kinds]), minlength=3 * len(code)).reshape(-1, 3)
        side = lambda c: pa.array([names[x] for x in c], pa.string())
        yield pa.RecordBatch.from_arrays([side(code // max(1, len(names))), side(code % max(1, len(names))), *(pa.array(n[:, k]) for k in range(3))], names=["a", "b", "same_minor", "same_lead", "unlike"])


def fuse(claims: DataFrame, keys: list[str], source: str, value: str, n_false: int = 10, copy_prior: float = 0.1, tolerance: float = 1e-3) -> DataFrame:
    """Maximum-posterior value of each key: ``keys, value, posterior, n_sources``.

    Sources are scored by how often they agree with the current posteriors; two sources that share many
    minority values are taken to depend on each other, and a source's vote is discounted by the product
    of (1 - copy probability) over the sources of the same value that come before it by accuracy. A source's several
    claims on one key count once, by its most frequent and then smallest value. Rounds end when no accuracy moves by
    ``tolerance`` or more. Ranks and leading values are no continuous functions of the accuracies, so these can swing;
    from the fourth round on a round moves them half as far as the one before would, which ends any swing.

    Null values and null sources claim nothing (name unknown sources first); a key without claims has no row; repeated
    rows change nothing but a source's most frequent value; among values of equal posterior the smallest wins.

    A key is reduced to one claim for each source before it is gathered, and no pairs are emitted: pairs of
    sources are counted inside each task. Sources and their links are tables, without a bound on their number;
    links are shipped in blocks of at most ``PAIR_BLOCK`` and the votes of the blocks are multiplied.
    """
    spark = claims.sparkSession
    c = claims.where(f"`{value}` is not null and `{source}` is not null").groupBy(*keys, F.col(source).cast("string").alias("source"), F.col(value).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # the most frequent and then smallest value of a source
    c = c.groupBy(*keys, "source").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("m")).select(*keys, "source", F.col("m.value").alias("value"))
    w = Written(c)
    c = w.df
    kinds = {f.name: f.dataType.simpleString() for f in c.schema}
    key_kinds = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    acc = Written(c.select("source").distinct().withColumn("acc", F.lit(0.8)))

    def with_keys(left: DataFrame, right: DataFrame) -> DataFrame:
        """Inner join on the keys, of which a null is a value."""
        right = right.withColumnsRenamed({k: f"_{k}" for k in keys})
        return left.join(right, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*[f"_{k}" for k in keys])

    def gathered(extra: DataFrame | None = None) -> DataFrame:
        """``keys, claims``: each key's claims, the most accurate source first; with the leading value where it is known."""
        said = c.join(acc.df.select("source", "acc"), "source").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("acc")).alias("o"), "source", "value"))).alias("claims"))
        return with_keys(said, extra) if extra is not None else said.withColumn("lead", F.lit(None).cast("string"))

    def copies(rows: DataFrame, known: bool) -> Written:
        """``a, b, p``: the probability that two sources depend on each other; before values are judged, from their agreement alone."""
        k = rows.where(F.size("claims") > 1).select("claims", "lead").mapInArrow(_pair_counts, "a string, b string, same_minor long, same_lead long, unlike long")
        k = k.groupBy("a", "b").agg(F.sum("same_minor").alias("f"), F.sum("same_lead").alias("t"), F.sum("unlike").alias("u"))
        for side in "ab":
            k = k.join(acc.df.select(F.col("source").alias(side), F.col("acc").alias(f"acc_{side}")), side)
        e = 1 - (F.col("acc_a") + F.col("acc_b")) / 2
        pf, pt = F.greatest(F.lit(1e-6), e * e / n_false), F.greatest(F.lit(1e-6), (1 - e) * (1 - e))
        llr = F.col("u") * math.log(1 - COPIED)
        if known:
            llr = llr + F.col("f") * F.log((COPIED * e + (1 - COPIED) * pf) / pf) + F.col("t") * F.log((COPIED * (1 - e) + (1 - COPIED) * pt) / pt)
        else:
            llr = llr + (F.col("f") + F.col("t")) * F.log((COPIED + (1 - COPIED) * (pf + pt)) / (pf + pt))
        odds = F.lit(math.log(copy_prior / (1 - copy_prior))) + llr
        return Written(k.select("a", "b", (1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-700.0)), F.lit(700.0))))).alias("p")))

    def independent(rows: DataFrame, links: DataFrame) -> DataFrame:
        """``keys, source, value, vote, free``: each claim's vote and the probability that it isn't copied from a source before it."""
        n = links.count()
        out = None
        blocks = max(1, -(-n // PAIR_BLOCK))
        for i in range(blocks):
            part = links.where(F.pmod(F.hash("a", "b"), F.lit(blocks)) == i).toArrow() if blocks > 1 else links.toArrow()
            shipped = spark.sparkContext.broadcast((part.column("a").to_pylist(), part.column("b").to_pylist(), part.column("p").to_numpy()))

            def run(batches, shipped=shipped):
                a, b, p = shipped.value
                voc = np.unique(np.array([*a, *b], dtype=object)) if a else np.empty(0, object)
                code = np.searchsorted(voc, a) * len(voc) + np.searchsorted(voc, b) if a else np.empty(0, np.int64)
                o = np.argsort(code)
                code, p = code[o], p[o]
                num = {x: i for i, x in enumerate(voc)}
                for batch in batches:
                    t = pa.Table.from_batches([batch])
                    row, order, src, val = _flat(t)
                    s, names = _coded(src)
                    s = np.array([num.get(x, -1) for x in names], dtype=np.int64)[s] if names else np.empty(0, np.int64)
                    v, _ = _coded(val)
                    # claims of one value together, in their order
                    by = np.lexsort((np.arange(len(row)), v, row))
                    g = np.unique(row[by] * np.int64(len(v) + 1) + v[by], return_inverse=True)[1] if len(row) else row
                    free = np.ones(len(row))
                    for x, y in _lags(g):
                        lo, hi = np.minimum(s[by[x]], s[by[y]]), np.maximum(s[by[x]], s[by[y]])
                        want = lo * len(voc) + hi
                        at = np.minimum(np.searchsorted(code, want), max(0, len(code) - 1))
                        hit = (lo >= 0) & (code[at] == want) if len(code) else np.zeros(len(want), bool)
                        free[by[x[hit]]] *= 1 - p[at[hit]]
                    acc_ = -order.to_numpy(zero_copy_only=False)
                    head = t.select(keys).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*(as_array(head.column(k)) for k in keys), src, val, pa.array(np.log(n_false * acc_ / (1 - acc_))), pa.array(free)], names=[*keys, "source", "value", "vote", "free"])

            part_ = rows.select(*keys, "claims").mapInArrow(run, f"{key_kinds}, source string, value string, vote double, free double")
            out = part_ if out is None else out.unionByName(part_)
        if blocks > 1:
            out = out.groupBy(*keys, "source", "value").agg(F.max("vote").alias("vote"), F.product("free").alias("free"))
        return out

    def judge(rows: DataFrame, links: DataFrame) -> DataFrame:
        scored = independent(rows, links).groupBy(*keys, "value").agg(F.sum(F.col("vote") * F.col("free")).alias("score"), F.count(F.lit(1)).alias("n_src"))
        # equal votes may differ in their last digits, by the order in which they were added
        scored = scored.withColumn("score", F.round("score", 9))
        # shifted by the largest score before exp, with n_false + 1 values in all, those nobody claims scoring 0
        per = scored.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("score"), "value")).alias("top"), F.collect_list("score").alias("all"), F.sum("n_src").alias("n_sources"))
        top = -F.col("top.score")
        z = F.aggregate("all", F.lit(0.0), lambda s, x: s + F.exp(x - top)) + F.greatest(F.lit(n_false + 1) - F.size("all"), F.lit(0)) * F.exp(-top)
        return per.select(*keys, F.col("top.value").alias("value"), (1 / z).alias("posterior"), "n_sources")

    rows = Written(gathered())
    links = copies(rows.df, False)
    turn = 0
    while True:
        turn += 1
        out = Written(judge(rows.df, links.df))
        rows.drop()
        links.drop()
        best = out.df.withColumnRenamed("value", "lead")
        agrees = F.when(F.col("value") == F.col("lead"), F.col("posterior")).otherwise((1 - F.col("posterior")) / n_false)
        new = with_keys(c, best.select(*keys, "lead", "posterior")).groupBy("source").agg(F.least(F.lit(0.99), F.greatest(F.lit(0.05), F.avg(agrees))).alias("new"))
        step = (F.col("new") - F.col("acc")) * 0.5 ** max(0, turn - 3)
        nxt = Written(acc.df.select("source", "acc").join(new, "source").select("source", (F.col("acc") + step).alias("acc"), F.abs(step).alias("moved")))
        acc.drop()
        acc = nxt
        if acc.df.where(F.col("moved") >= tolerance).isEmpty():
            acc.drop()
            return out.df
        rows = Written(gathered(best.select(*keys, "lead")))
        links = copies(rows.df, True)
        out.drop()


#: source of the records without a resolver; the others' names begin with =
UNKNOWN = "?"


def p3_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion's consensus tag of each barcode, with the resolvers and one unknown resolver as sources; posterior rounded to six digits."""
    df = read_records(spark, sf_dir).where(usable_tag(F.col("consensus_variant_tag")))
    tag = F.regexp_replace("consensus_variant_tag", r"(?U)^\s+|\s+$", "")
    df = df.withColumn("tag", F.when(F.upper(tag) == "WT", F.lit("WT")).otherwise(tag)).dropDuplicates(["resolution_id"])
    # records without a resolver are one more source, whose name no resolver can have
    df = df.withColumn("resolver", F.when(F.col("resolver").isNull(), F.lit(UNKNOWN)).otherwise(F.concat(F.lit("="), "resolver")))
    f = fuse(df, ["library", "cluster_barcode"], "resolver", "tag")
    return f.select("library", "cluster_barcode", F.col("value").alias("tag"), F.round("posterior", 6).alias("posterior"), "n_sources")


QUERIES = {"p3_found": p3_found, "p3_fused": p3_fused}

ORACLES = {
    "p3_found": rf"""
with r as (
  select distinct library, {READ_SQL.format('cluster_barcode')} as cluster_barcode, resolution_id, variant_support, total_reads, resolved_at,
    regexp_replace(consensus_variant_tag, '^\s+|\s+$', '', 'g') as t
  from barcode_cluster_resolution),
u as (
  select *, variant_support > 0 and variant_support <= 1 and not isnan(variant_support) and
    coalesce(upper(t) = 'WT' or (t like '[%' and case when json_valid(t) then json_type(t) = 'ARRAY' and json_array_length(t) > 0 else false end), false) as ok_tag
  from r where library is not null and cluster_barcode is not null),
many as (select library, cluster_barcode from u group by 1, 2 having count(distinct resolution_id) > 1),
tag as (select * from (select library, cluster_barcode, resolution_id, row_number() over (partition by library, cluster_barcode
    order by variant_support desc, resolved_at desc nulls last, resolution_id) as k from u where ok_tag) where k = 1),
reads as (select * from (select library, cluster_barcode, resolution_id, row_number() over (partition by library, cluster_barcode
    order by resolved_at desc nulls last, resolution_id) as k from u where total_reads > 0) where k = 1)
select m.library, m.cluster_barcode, coalesce(tag.resolution_id, -1) as tag_id, coalesce(reads.resolution_id, -1) as reads_id
from many m left join tag using (library, cluster_barcode) left join reads using (library, cluster_barcode)
""",
}
