"""Joins with more than an equality: fall-backs, nearest matches, overlaps and absences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from occuspan.functions import tags
from occuspan.operators.aggregates import consensus, _raw
from occuspan.session import table
from occuspan.sources import views as V


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], a_iv: tuple[str, str], b_iv: tuple[str, str], block: int = 256) -> DataFrame:
    """Pairs of rows with equal keys whose inclusive intervals overlap, columns of ``a`` then of ``b`` prefixed ``b_``.

    Each interval is dealt to the blocks it touches, so the join is an equality on keys and block; a pair is kept
    in the first block that both touch, so it comes once. Null bounds and reversed intervals match nothing.
    """
    def dealt(df: DataFrame, iv: tuple[str, str], prefix: str) -> DataFrame:
        s, e = F.col(iv[0]), F.col(iv[1])
        d = df.where(s <= e).select(*[F.col(c).alias(prefix + c) for c in df.columns])
        return d.withColumn(prefix + "_blk", F.explode(F.sequence(F.floor(F.col(prefix + iv[0]) / block), F.floor(F.col(prefix + iv[1]) / block))))

    x, y = dealt(a, a_iv, "a_"), dealt(b, b_iv, "b_")
    on = [x[f"a_{k}"] == y[f"b_{k}"] for k in keys] + [x["a__blk"] == y["b__blk"], x[f"a_{a_iv[0]}"] <= y[f"b_{b_iv[1]}"], y[f"b_{b_iv[0]}"] <= x[f"a_{a_iv[1]}"]]
    j = x.join(y, on).where(F.col("a__blk") == F.floor(F.greatest(f"a_{a_iv[0]}", f"b_{b_iv[0]}") / block))
    return j.select(*[F.col("a_" + c).alias(c) for c in a.columns], *[F.col("b_" + c) for c in b.columns])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], l: str, r: str, limit: float | None = None) -> DataFrame:  # noqa: E741
    """Each left row with the right value nearest to its own, the smaller of two as near; null where the key has none, or none within ``limit``.

    Both sides are put in one order and the last and next right values are carried along: one shuffle, no pairs.
    """
    both = left.select(*keys, F.col(l).cast("double").alias("_x"), F.struct(*left.columns).alias("_row")).unionByName(
        right.where(F.col(r).isNotNull()).select(*keys, F.col(r).cast("double").alias("_x"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"))
    )
    val = F.when(F.col("_row").isNull(), F.col("_x"))
    w = Window.partitionBy(*keys).orderBy("_x")
    lo = F.last(val, True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    hi = F.first(val, True).over(w.rangeBetween(0, Window.unboundedFollowing))
    pick = F.when(hi.isNull() | (F.col("_x") - lo <= hi - F.col("_x")), F.coalesce(lo, hi)).otherwise(hi)
    if limit is not None:
        pick = F.when(F.abs(pick - F.col("_x")) <= limit, pick)
    return both.withColumn("nearest", pick).where("_row is not null").select("_row.*", "nearest")


def nearest_of_few(left: DataFrame, values: DataFrame, l: str, r: str, most: int = 100_000) -> DataFrame:  # noqa: E741
    """:func:`nearest` of one list for all rows: the sorted list of at most ``most`` distinct values rides along with each row and is
    searched by halves, so the rows aren't shuffled; with more values than that, rows and values are ordered by blocks of the values."""
    x, v = F.col(l).cast("double"), values.where(F.col(r).isNotNull()).select(F.col(r).cast("double").alias("_v")).distinct()
    if v.limit(most + 1).count() <= most:
        grid = F.broadcast(v.agg(F.sort_array(F.collect_list("_v")).alias("_g")).withColumn("_one", F.lit(1)))
        # halving steps, from the largest, find the number of values up to x
        steps = F.array(*[F.lit(1 << i) for i in range(most.bit_length(), -1, -1)])
        upto = F.aggregate(steps, F.lit(0), lambda k, i: F.when(F.coalesce(F.get("_g", k + i - 1) <= x, F.lit(False)), k + i).otherwise(k))
        j = left.withColumn("_one", F.lit(1)).join(grid, "_one", "left").withColumn("_k", upto)
        lo, hi = F.get("_g", F.col("_k") - 1), F.get("_g", F.col("_k"))
        return j.withColumn("nearest", F.when(hi.isNull() | (x - lo <= hi - x), F.coalesce(lo, hi)).otherwise(hi)).select(*left.columns, "nearest")
    # blocks begin at every so many-th value; each holds its values and the neighbour on either side
    cuts = v.select(F.percentile_approx("_v", [i / 256 for i in range(1, 256)], 10_000).alias("c"))
    block = F.size(F.filter("c", lambda c: c <= F.col("_y")))
    cuts = cuts.withColumn("_one", F.lit(1))
    put = lambda df, y: df.withColumns({"_y": y, "_one": F.lit(1)}).join(F.broadcast(cuts), "_one").withColumn("_blk", block).drop("c", "_y", "_one")
    vb = put(v, F.col("_v"))
    edge = vb.groupBy("_blk").agg(F.min("_v").alias("a"), F.max("_v").alias("z"))
    w = Window.orderBy("_blk")  # at most 256 rows
    every = spread_blocks(left.sparkSession).join(edge, "_blk", "left")
    prev, nxt = F.last("z", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first("a", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    side = every.select("_blk", prev.alias("p"), nxt.alias("n")).select("_blk", F.explode(F.array_compact(F.array("p", "n"))).alias("_v"))
    return nearest(put(left, x), vb.unionByName(side).distinct(), ["_blk"], l, "_v").drop("_blk")


def spread_blocks(spark) -> DataFrame:
    return spark.range(256).select(F.col("id").cast("int").alias("_blk"))


def normalise_scores(df: DataFrame) -> DataFrame:
    """A score table under its common names (any case): position, ref, alt, value, p_value, significant.

    Unknown columns are dropped; names without a column are null.
    """
    #: fixed values: names under which each column is known
    alias = {"position": ("position", "pos", "start"), "ref": ("ref", "reference"), "alt": ("alt", "alternate"), "value": ("value", "log2fc", "effect", "score", "coefficient"), "p_value": ("p-value", "p_value", "pvalue", "p")}
    low = {}
    for c in df.columns:
        low.setdefault(c.lower().strip(), c)
    kind = {"position": "int", "value": "double", "p_value": "double"}
    cols = []
    for name, ways in alias.items():
        hit = next((low[w] for w in ways if w in low), None)
        cols.append((F.col(f"`{hit}`") if hit else F.lit(None)).cast(kind.get(name, "string")).alias(name))
    return df.select(*cols).withColumn("significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))


def score_lookup(variants: DataFrame, scores: DataFrame, order: Column) -> DataFrame:
    """Score of each ``position, ref, alt``: the exact row, else the first row (by ``order``) at the position."""
    s = scores.withColumn("_o", order)
    first = s.groupBy("position").agg(F.min_by(F.struct("value", "p_value"), "_o").alias("_f"))
    exact = s.groupBy("position", F.upper("ref").alias("_r"), F.upper("alt").alias("_a")).agg(F.min_by(F.struct("value", "p_value"), "_o").alias("_e"))
    v = variants.withColumn("_r", F.upper("ref")).withColumn("_a", F.upper("alt"))
    j = v.join(exact, ["position", "_r", "_a"], "left").join(first, "position", "left")
    hit = F.coalesce("_e", "_f")
    return j.select(*[F.col(c) for c in variants.columns], hit["value"].alias("value"), hit["p_value"].alias("p_value"), F.when(F.col("_e").isNotNull(), "exact").when(F.col("_f").isNotNull(), "position").otherwise("none").alias("match"))


def _scores(spark, d) -> DataFrame:
    """A score table made from part prices: one row for each part, at a position of the libraries."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    b = lambda x: F.substring(F.lit("ACGT"), (x % 4 + 1).cast("int"), F.lit(1))
    return p.select((1200 + (k * 7) % 2400).cast("int").alias("POS"), b(k).alias("Ref"), b(k + 1 + k % 3).alias("ALT"), F.col("p_retailprice").alias("Score"), ((k % 100) / 100.0).cast("double").alias("P-Value"), k.alias("k"))


def mpra_normalise(spark, d):
    return normalise_scores(_scores(spark, d)).groupBy("significant").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value_sum"), F.min("position").alias("lo"))


def join_mpra_fallback(spark, d):
    s = normalise_scores(_scores(spark, d)).withColumn("k", F.col("value"))
    v = table(spark, d, "variant_summary").select("library", "variant_id", "position", "ref", "alt")
    return score_lookup(v, s, F.struct("value", "ref", "alt", "p_value")).groupBy("library", "match").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value_sum"))


def join_tag_reads(spark, d):
    """Each read with its cluster's consensus tag, and its raw tag where it has no cluster."""
    keys = ["sample_id", "bk"]
    cons = consensus(_raw(spark, d), keys, "ids").select(*keys, tags.raw_tag(F.col("consensus")).alias("cons"))
    c = V.calls(spark, d).where("pr is not null").withColumn("raw", tags.raw_tag(tags.variant_ids(F.col("pr"))))
    j = c.join(cons, keys, "left").withColumn("tag", F.coalesce("cons", "raw"))
    return j.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("tag") != F.col("raw"), 1)).alias("corrected"), F.count(F.when(F.col("cons").isNull(), 1)).alias("no_cluster"), F.count(F.when(F.col("tag") == "WT", 1)).alias("wt"))


def join_secondary_free_anti(spark, d):
    """Single-variant reads without another raw call within 100 bases of their variant."""
    c = V.calls(spark, d).where("pv is not null and pr is not null").withColumn("a", tags.variant_ids(F.col("pv"))).where(F.size("a") == 1)
    pos = lambda x: F.nullif(F.regexp_extract(x, r"^(\d+):", 1), F.lit("")).cast("int")
    own = F.col("a")[0]
    near = F.exists(tags.variant_ids(F.col("pr")), lambda x: (x != own) & (F.abs(pos(x) - pos(own)) <= 100))
    return c.where(~F.coalesce(near, F.lit(False))).groupBy(own.alias("variant_id")).agg(F.count(F.lit(1)).alias("n_clean"))


def join_nearest_depth(spark, d):
    """The null depth nearest to each variant's reads, from the depths of the null table."""
    v = table(spark, d, "variant_summary").select("library", "variant_id", "n_reads").where("n_reads is not null")
    g = table(spark, d, "null_calibration").select("coverage_level")
    return nearest_of_few(v, g, "n_reads", "coverage_level").select("library", "variant_id", "n_reads", F.col("nearest").cast("int").alias("depth"))


def join_nearest_click(spark, d):
    """Each variant with the peak of a call of its library within three bases of its position, as a click on a plot finds it."""
    v = table(spark, d, "variant_summary").where("position is not null").select("library", "variant_id", "position")
    c = V.cluster_rows(spark, d).where("peak_position is not null").select("library", "peak_position")
    return nearest(v, c.distinct(), ["library"], "position", "peak_position", 3).where("nearest is not null").select("library", "variant_id", F.col("nearest").cast("int").alias("peak"))


def join_interval_overlap(spark, d):
    """Calls that overlap the strongest call of bin nuc in their library, counted by bin."""
    c = V.cluster_rows(spark, d).select("library", "bin", "cluster_id", "abs_start", "abs_end", "sum_abs_delta")
    top = c.where("bin = 'nuc' and sum_abs_delta is not null").groupBy("library").agg(F.max_by(F.struct("abs_start", "abs_end"), F.struct("sum_abs_delta", -F.col("cluster_id"))).alias("t")).select("library", "t.*")
    j = overlap_join(c, top, ["library"], ("abs_start", "abs_end"), ("abs_start", "abs_end"))
    cut = F.least("abs_end", "b_abs_end") - F.greatest("abs_start", "b_abs_start") + 1
    return j.groupBy("library", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(cut).cast("long").alias("bases"))


QUERIES = {
    "mpra_normalise": mpra_normalise,
    "join_mpra_fallback": join_mpra_fallback,
    "join_tag_reads": join_tag_reads,
    "join_secondary_free_anti": join_secondary_free_anti,
    "join_nearest_depth": join_nearest_depth,
    "join_nearest_click": join_nearest_click,
    "join_interval_overlap": join_interval_overlap,
}

from occuspan.operators.aggregates import _RAW, _TAG  # noqa: E402

_SC = """sc as (select cast(1200 + (p_partkey * 7) % 2400 as int) as position, substr('ACGT', cast(p_partkey % 4 + 1 as int), 1) as ref,
  substr('ACGT', cast((p_partkey + 1 + p_partkey % 3) % 4 + 1 as int), 1) as alt, p_retailprice as value, cast(p_partkey % 100 as double) / 100.0 as p_value from part)"""
_POS = r"try_cast(nullif(regexp_extract({0}, '^(\d+):', 1), '') as int)"

ORACLES = {
    "join_nearest_click": V.sql(
        "cluster_rows",
        """
with c as (select distinct library, peak_position as p from cluster_rows where peak_position is not null),
n as (select v.library, v.variant_id, c.p, row_number() over (partition by v.library, v.variant_id order by abs(c.p - v.position), c.p) as k
  from variant_summary v join c on c.library = v.library and abs(c.p - v.position) <= 3 where v.position is not null)
select library, variant_id, cast(p as int) as peak from n where k = 1""",
    ),
    "mpra_normalise": f"with {_SC} select p_value < 0.05 as significant, count(*) as n, round(sum(value), 4) as value_sum, min(position) as lo from sc group by 1",
    "join_mpra_fallback": f"""with {_SC}, o as (select *, row_number() over (partition by position order by value, ref, alt, p_value) as k, row_number() over (partition by position, ref, alt order by value, p_value) as ke from sc)
select v.library, case when e.position is not null then 'exact' when f.position is not null then 'position' else 'none' end as match, count(*) as n, round(sum(case when e.position is not null then e.value else f.value end), 4) as value_sum
from variant_summary v left join o e on e.position = v.position and e.ref = upper(v.ref) and e.alt = upper(v.alt) and e.ke = 1 left join o f on f.position = v.position and f.k = 1 group by 1, 2""",
    "join_tag_reads": V.sql(
        "calls",
        f"""with {_RAW}, c as (select sample_id, bk, {_TAG.format('ids')} as cons from res),
r as (select sample_id, bk, {_TAG.format('ids')} as raw from (select *, {V.ids_sql('pr')} as ids from calls where pr is not null))
select r.sample_id, count(*) as n, count(*) filter (coalesce(cons, raw) <> raw) as corrected, count(*) filter (cons is null) as no_cluster, count(*) filter (coalesce(cons, raw) = 'WT') as wt
from r left join c on c.sample_id = r.sample_id and c.bk = r.bk group by 1""",
    ),
    "join_secondary_free_anti": V.sql(
        "calls",
        f"""with x as (select ordinal, {V.ids_sql('pv')} as a, {V.ids_sql('pr')} as b from calls where pv is not null and pr is not null),
s as (select ordinal, a[1] as variant_id, b from x where len(a) = 1),
bad as (select distinct ordinal from (select ordinal, variant_id, unnest(b) as o from s) where o <> variant_id and abs({_POS.format('o')} - {_POS.format('variant_id')}) <= 100)
select variant_id, count(*) as n_clean from s where ordinal not in (select ordinal from bad) group by 1""",
    ),
    "join_nearest_depth": """
with g as (select distinct coverage_level as depth from null_calibration where coverage_level is not null),
r as (select library, variant_id, n_reads, depth, row_number() over (partition by library, variant_id order by abs(n_reads - depth), depth) as k from variant_summary cross join g where n_reads is not null)
select library, variant_id, n_reads, depth from r where k = 1""",
    "join_interval_overlap": V.sql(
        "cluster_rows",
        """with t as (select library, abs_start as s, abs_end as e from (select *, row_number() over (partition by library order by sum_abs_delta desc, cluster_id) as k from cluster_rows where bin = 'nuc' and sum_abs_delta is not null) where k = 1)
select c.library, c.bin, count(*) as n, cast(sum(least(abs_end, e) - greatest(abs_start, s) + 1) as bigint) as bases from cluster_rows c join t on t.library = c.library and abs_start <= e and s <= abs_end group by 1, 2""",
    ),
}
