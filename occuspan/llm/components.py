"""Problem 4: consolidating pairwise matches into groups (connected components).

Minimum labels are propagated over the edges, every label is led to its root by pointer jumping, and the edges
are contracted to the roots. Every round is written to the shared folder, and the rounds end when no edge joins
two labels. Nothing that grows with the data reaches the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occuspan.llm.barcodes import READ_SQL, read_barcode
from occuspan.session import Written, table


def _jump(parents: DataFrame) -> DataFrame:
    """One pointer jump on ``v, p``: p becomes the parent of p; ``open`` tells whether p had one, so that it may have more."""
    up = parents.select(F.col("v").alias("p"), F.col("p").alias("pp"))
    return parents.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("open"))


def _roots(parents: DataFrame) -> tuple[Written, int]:
    """(``v, p`` with every p a root, number of jumps): each jump doubles the way a pointer spans, so a path of n needs log2 n."""
    m, jumps = Written(_jump(_jump(parents).drop("open"))), 2
    while not m.df.where("open").isEmpty():
        nxt = Written(_jump(_jump(m.df.drop("open")).drop("open")))
        m.drop()
        m, jumps = nxt, jumps + 2
    return m, jumps


def components(edges: DataFrame, rounds: list | None = None) -> DataFrame:
    """``v, root`` for each vertex of ``edges(a, b)`` that is linked to a smaller one.

    The root is the smallest vertex linked directly or indirectly; vertices are of any one type that has an order.
    Vertices that are their own root have no row. Loops, repeated edges and either direction are allowed; rows with a
    null are left out; no edges give no rows. A vertex with a very large share of all edges is met by partial
    aggregation before the shuffle and by AQE's splitting of skewed joins; contraction removes it after one round.
    ``rounds`` receives the number of jumps of each round.

    At most 2 log2(n) rounds: a vertex that keeps its label in a round is smaller than all its neighbours. If one of
    these hooks to another vertex, that one is smaller still and becomes a neighbour, so the vertex goes in the next
    round; if none does, all of them join it. So each survivor of two rounds has taken in at least one other vertex.
    """
    spark = edges.sparkSession
    live = Written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    kind = live.df.schema["a"].dataType.simpleString()
    maps: list[Written] = []
    while not live.df.isEmpty():
        both = live.df
        # a > b, so only the larger end can take the smaller one as its parent: the minimum of its smaller neighbours
        m, jumps = _roots(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")))
        maps.append(m)
        if rounds is not None:
            rounds.append(jumps)
        up = m.df.select("v", "p")
        # every a has a parent; a b has one only if it isn't the least of its neighbours
        ends = both.join(up.withColumnsRenamed({"v": "a", "p": "pa"}), "a").join(up.withColumnsRenamed({"v": "b", "p": "pb"}), "b", "left")
        ends = ends.select(F.col("pa").alias("a"), F.coalesce("pb", "b").alias("b")).where("a <> b")
        nxt = Written(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        live.drop()
        live = nxt
    live.drop()
    if not maps:
        return spark.createDataFrame([], f"v {kind}, root {kind}")
    # from the last round back: a label of a round ends where the later rounds lead it. A vertex has a row in one round
    # only, so each round adds its rows and rewrites none
    done = [maps[-1].df.select("v", F.col("p").alias("root"))]
    for m in reversed(maps[:-1]):
        later = reduce(DataFrame.unionByName, done)
        done.append(Written(m.df.join(later.withColumnsRenamed({"v": "p", "root": "up"}), "p", "left").select("v", F.coalesce("up", "p").alias("root"))).df)
        m.drop()
    return reduce(DataFrame.unionByName, done)


def _hashed(stars: DataFrame, taken: list[DataFrame], mask: int) -> DataFrame:
    """``scope, barcode, id, center`` of ``scope, barcode, hub``: numbers of the barcode and of its hub within the scope.

    A number is a hash; one that two vertices share is in ``taken[0]``, and these vertices get another hash, and so on.
    """
    df = stars
    for name, out in (("barcode", "id"), ("hub", "center")):
        df = df.withColumn(out, F.xxhash64(name, "scope").bitwiseAND(mask))
        for turn, ids in enumerate(taken, 1):
            again = F.xxhash64(F.lit(turn), F.col(name), F.col("scope")).bitwiseAND(mask)
            df = df.join(ids.select(F.col("id").alias("_t")), F.col(out) == F.col("_t"), "left").withColumn(out, F.when(F.col("_t").isNotNull(), again).otherwise(F.col(out))).drop("_t")
    return df.select("scope", "barcode", "id", "center")


def group_members(stars: DataFrame, scope: str, member: str, hub: str, mask: int = -1) -> DataFrame:
    """``scope, barcode, group_id``: one row for each distinct member of a scope.

    ``stars`` has a ``scope`` column and two string columns: each row links its ``member`` with its ``hub``, which is a
    member of the same record and has a row of its own; links so grow with the members and not with their pairs.
    ``group_id`` is the smallest member (byte order) linked directly or indirectly within the scope. Rows with a null
    member or hub link nothing; a null scope is a scope of its own; a lone member is its own group; repeated rows change nothing;
    other columns are ignored; an empty table gives no rows.

    Vertices are numbered by hashes, so no join and no sort gives them out. Numbers that two vertices share are looked for and
    hashed again until none is left, so the result is exact; ``mask`` narrows the hash for tests.
    """
    s, kind = F.col(f"`{scope}`"), stars.schema[scope].dataType.simpleString()
    r = stars.select(s.alias("scope"), F.col(f"`{member}`").alias("barcode"), F.col(f"`{hub}`").alias("hub")).where("barcode is not null and hub is not null")
    taken: list[DataFrame] = []
    while True:
        links = Written(_hashed(r, taken, mask))
        nodes = Written(links.df.select("id", "scope", "barcode").distinct())
        shared = Written(nodes.df.groupBy("id").count().where("count > 1").select("id"))
        if shared.df.isEmpty():
            break
        taken.append(shared.df)
        links.drop()
        nodes.drop()
    root = components(links.df.select(F.col("id").alias("a"), F.col("center").alias("b")))
    of = Written(nodes.df.join(root.withColumnRenamed("v", "id"), "id", "left").select("scope", "barcode", F.coalesce("root", "id").alias("root")))
    links.drop()
    nodes.drop()
    least = of.df.groupBy("root").agg(F.min("barcode").alias("group_id"))
    return of.df.join(least, "root").select(F.col("scope").cast(kind).alias(scope), "barcode", "group_id")


def barcode_stars(res: DataFrame) -> DataFrame:
    """``library, barcode, hub``: each barcode of a record, as read, with the first that can be read."""
    own = F.array(F.col("cluster_barcode"))
    entries = F.concat(own, F.coalesce(F.col("member_barcodes"), F.array().cast("array<string>")))
    # the list is searched only where the record's own barcode can't be read
    hub = F.coalesce(read_barcode(F.col("cluster_barcode")), F.get(F.filter(F.transform(entries, read_barcode), lambda x: x.isNotNull()), F.lit(0)))
    return res.select("library", hub.alias("hub"), F.explode(entries).alias("e")).select("library", read_barcode(F.col("e")).alias("barcode"), "hub")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of each barcode of each library, over all records of ``barcode_cluster_resolution``."""
    return group_members(barcode_stars(table(spark, sf_dir, "barcode_cluster_resolution")), "library", "barcode", "hub")


def p4_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of groups of each library and size."""
    g = p4_found(spark, sf_dir).groupBy("library", "group_id").agg(F.count(F.lit(1)).alias("size"))
    return g.groupBy("library", "size").agg(F.count(F.lit(1)).alias("n_groups"))


QUERIES = {"p4_found": p4_found, "p4_group_sizes": p4_group_sizes}

_GROUPS = rf"""
with recursive r as (
  select distinct library, list_sort(list_distinct(list_filter(list_transform(
    list_concat([cluster_barcode], coalesce(member_barcodes, [])), lambda x: {READ_SQL.format('x')}), lambda x: x is not null))) as m
  from barcode_cluster_resolution),
links as (
  select distinct library, m[1] as lo, unnest(m) as hi from r where len(m) > 0),
edges as (
  select library, lo as a, hi as b from links union select library, hi, lo from links),
walk as (
  select library, hi as barcode, hi as seen from links
  union
  select w.library, w.barcode, e.b from walk w join edges e on e.library is not distinct from w.library and e.a = w.seen),
found as (
  select library, barcode, min(seen) as group_id from walk group by 1, 2)
"""

ORACLES = {
    "p4_found": _GROUPS + "select library, barcode, group_id from found",
    "p4_group_sizes": _GROUPS + """
select library, size, count(*) as n_groups from (select library, group_id, count(*) as size from found group by 1, 2) group by 1, 2""",
}
