"""Greedy, order-dependent clustering of barcodes by edit distance and variants, as rounds of joins.

A barcode waits until every barcode of higher rank that it could join has been decided; all others are decided at
once. So no group of barcodes is ever gathered in one task, however they hang together, and the outcome is that
of the sequential rule. All joins are by sorting and merging: Spark would take the size of a compressed file for that of
its rows, and send barcodes and molecules to the driver in every round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occuspan.operators.calling import levenshtein_pairs
from occuspan.session import Written, written
from occuspan.sources import views as V


def meet(a: DataFrame, b: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join that is never a broadcast, whatever Spark takes the sides' sizes to be."""
    return a.join(b.hint("merge"), on, how)


def candidates(bcs: DataFrame, expected: int = 15, min_jaccard: float = 0.5) -> DataFrame:
    """``bc, c, near, compatible``: each barcode with those of higher rank within its distance.

    ``bcs`` has ``barcode, reads, first, ids`` (one row each). Rank is by reads, then first appearance. Barcodes shorter
    than expected join at distance 1 only. Sets of ids agree if both are empty, or their Jaccard index is high enough.
    """
    p = levenshtein_pairs(bcs)
    x = bcs.select(F.col("barcode").alias("a"), F.struct(-F.col("reads"), "first").alias("ra"), F.col("ids").alias("ia"))
    y = bcs.select(F.col("barcode").alias("b"), F.struct(-F.col("reads"), "first").alias("rb"), F.col("ids").alias("ib"))
    j = meet(meet(p, x, "a"), y, "b")
    up = F.col("ra") < F.col("rb")
    i, u = F.size(F.array_intersect("ia", "ib")), F.size(F.array_union("ia", "ib"))
    ok = F.when((F.size("ia") == 0) | (F.size("ib") == 0), (F.size("ia") == 0) & (F.size("ib") == 0)).otherwise(i / u >= min_jaccard)
    j = j.select(F.when(up, F.col("b")).otherwise(F.col("a")).alias("bc"), F.when(up, F.col("a")).otherwise(F.col("b")).alias("c"), F.least("ra", "rb").alias("rank_c"), (F.col("dist") == 1).alias("near"), ok.alias("compatible"))
    return j.where(F.col("near") | (F.length("bc") >= expected))


def cluster(bcs: DataFrame, expected: int = 15, min_jaccard: float = 0.5) -> DataFrame:
    """``barcode, centroid`` of every barcode.

    A barcode within distance 1 of a centroid looks at the earliest such centroid first, and joins it if their variants
    agree; else it joins the earliest agreeing centroid within its distance; else it becomes a centroid. Nulls are left
    out; repeated rows of a barcode are one. Each round adds its rows and rewrites none; there are as many rounds as the
    longest chain of barcodes that wait for one another, which short neighbourhoods keep short.
    """
    bcs = written(bcs.where("barcode is not null").dropDuplicates(["barcode"]))
    cand = written(candidates(bcs, expected, min_jaccard))
    linked = cand.select(F.col("bc").alias("barcode")).distinct()
    # a barcode that could join nobody is a centroid from the start
    done = [written(meet(bcs, linked, "barcode", "left_anti").select("barcode", F.col("barcode").alias("centroid")))]
    open_ = Written(linked)
    while not open_.df.isEmpty():
        waits = meet(cand, open_.df.select(F.col("barcode").alias("c")), "c").select(F.col("bc").alias("barcode")).distinct()
        ready = meet(open_.df, waits, "barcode", "left_anti")
        heads = reduce(DataFrame.unionByName, done).where("barcode = centroid").select(F.col("barcode").alias("c"))
        c = meet(meet(cand, heads, "c"), ready.select(F.col("barcode").alias("bc")), "bc")
        g = c.groupBy("bc").agg(
            F.min_by(F.struct("c", "compatible"), F.when(F.col("near"), F.col("rank_c"))).alias("first_near"),
            F.min_by("c", F.when(F.col("compatible"), F.col("rank_c"))).alias("first_ok"),
        )
        pick = F.when(F.col("first_near.compatible"), F.col("first_near.c")).otherwise(F.col("first_ok"))
        now = meet(ready, g.select(F.col("bc").alias("barcode"), pick.alias("to")), "barcode", "left").select("barcode", F.coalesce("to", "barcode").alias("centroid"))
        new = written(now)
        done.append(new)
        if len(done) > 20:  # many short rounds: their tables become one, so a plan stays small
            done = [done[0], written(reduce(DataFrame.unionByName, done[1:]))]
        left = Written(meet(open_.df, new.select("barcode"), "barcode", "left_anti"))
        open_.drop()
        open_ = left
    return reduce(DataFrame.unionByName, done)


def barcode_table(spark, d) -> DataFrame:
    """Derived barcodes with their reads, first appearance and variants."""
    b = meet(V.barcodes(spark, d), V.molecules(spark, d).select("read_id", "variant_id"), "read_id")
    ids = F.array_compact(F.array_sort(F.collect_set(F.when(F.col("variant_id") != "WT", F.col("variant_id")))))
    return b.groupBy("barcode").agg(F.count(F.lit(1)).alias("reads"), F.min("read_id").alias("first"), ids.alias("ids"))


def barcode_clusters(spark, d):
    """Clusters of the derived barcodes by size."""
    c = cluster(barcode_table(spark, d))
    return c.groupBy("centroid").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.array_sort(F.collect_list("barcode")), ",").alias("members"))


QUERIES = {"barcode_clusters": barcode_clusters}
ORACLES: dict[str, str] = {}

__all__ = ["QUERIES", "candidates", "cluster", "meet"]
