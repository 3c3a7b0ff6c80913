"""Problem 1: percentiles of very large numeric columns.

Values are clustered, in order, into centroids under a size function that is finest at both ends. Digests of
days, files or partitions are merged by clustering their centroids again. A second pass counts, for each
estimate, the values below and up to it, which certifies the rank error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occuspan.session import spread, table, written

#: compression: a digest has at most about this many centroids, and a merged one errs by less than 2 / DELTA in rank
DELTA = 400

#: the stated bound on the rank error, as a share of a group's values
RANK_BOUND = 2 / DELTA

#: percentiles of the queries
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def cluster(g: np.ndarray, x: np.ndarray, w: np.ndarray, delta: int = DELTA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids (group, mean, weight) of weighted values of many groups at once, by group and then mean.

    A value falls into the cluster given by the size function asin at the share of weight before it, so a
    cluster holds little near 0 and 1; equal values stay in order and groups of at most delta / 2 values keep each one.
    """
    if not len(x):
        return g, x, w
    o = np.lexsort((x, g))
    g, x, w = g[o], x[o].astype(np.float64), w[o].astype(np.float64)
    first = np.r_[True, g[1:] != g[:-1]]
    start = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    cum = np.cumsum(w)
    base = (cum[start] - w[start])[run]
    total = np.add.reduceat(w, start)[run]
    left = np.clip((cum - w - base) / total, 0, 1)
    k = np.floor(delta / np.pi * (np.arcsin(2 * left - 1) + np.pi / 2)).astype(np.int64)
    size = np.diff(np.r_[start, len(x)])[run]
    k = np.where(size <= delta // 2, np.arange(len(x)), k)
    new = first | np.r_[True, k[1:] != k[:-1]]
    at = np.flatnonzero(new)
    cw = np.add.reduceat(w, at)
    # a mean stays between its values, so rounding can't move a cluster of equal values off them
    last = np.r_[at[1:], len(x)] - 1
    return g[at], np.clip(np.add.reduceat(x * w, at) / cw, x[at], x[last]), cw


def estimate(x: np.ndarray, w: np.ndarray, lo: float, hi: float, qs=QUANTILES) -> np.ndarray:
    """Values at ``qs``: a centroid of weight one is the value of its rank; elsewhere centroids stand at the middle of their weight, with the extremes at both ends, and the line between two gives the value."""
    want = np.asarray(qs) * w.sum()
    cum = np.cumsum(w)
    at = np.minimum(np.searchsorted(cum, want - 1e-9), len(x) - 1)
    line = np.interp(want, np.r_[0, cum - w / 2, cum[-1]], np.r_[lo, x, hi])
    return np.where(w[at] == 1, x[at], line)


def _lists(values: np.ndarray, sizes: np.ndarray, kind=np.float32) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values.astype(kind)))


def as_array(c) -> pa.Array:
    """One array of a column, whatever its chunks."""
    c = c.combine_chunks()
    return c if isinstance(c, pa.Array) else c.chunk(0)


#: values that one step of a task clusters at a time, which bounds its memory at about 100 MB
STEP = 1_000_000

#: ids that one task of the search for repeated ids holds
TASK_IDS = 4_000_000

#: groups whose estimates are shipped to all tasks (about 200 bytes each); with more of them, sorted pieces are joined with the estimates
SHIPPED_GROUPS = 500_000

#: how much finer the digest of a group is made whose estimates are beyond the bound
FINER = 20

#: partial digests of one group that one task merges; more are first merged by parts
FAN = 512

_DIGEST = "n long, lo float, hi float, means array<double>, weights array<double>"


def _steps(batches: Iterator[pa.RecordBatch], size=lambda b: b.num_rows) -> Iterator[pa.Table]:
    """Batches gathered to tables of about ``STEP`` values; ``size`` gives the values of a batch."""
    got, n = [], 0
    for b in batches:
        if b.num_rows:
            got.append(b)
            n += size(b)
        if n >= STEP:
            yield pa.Table.from_batches(got)
            got, n = [], 0
    if got:
        yield pa.Table.from_batches(got)


def _codes(cols: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Dense group numbers of rows by several columns (null is a value), and the first row of each group."""
    code = np.zeros(len(cols[0]), dtype=np.int64)
    for c in cols:
        d = as_array(c.dictionary_encode(null_encoding="encode"))
        code = code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]  # dense, so the product can't overflow
    return code, np.unique(code, return_index=True)[1]


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{k}` {kinds.get(k, 'string')}" for k in keys)


def repeated_ids(df: DataFrame, ident: str) -> DataFrame:
    """``_id``: the ids that stand on more than one row. Only ids are shuffled, by their value; nulls aren't ids."""

    def run(batches):
        got = [b.column(0).to_numpy(zero_copy_only=False) for b in batches if b.num_rows]
        if got:
            x = np.sort(np.concatenate(got))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(x[1:][x[1:] == x[:-1]]))], names=["_id"])

    ids = df.where(F.col(f"`{ident}`").isNotNull()).select(F.col(f"`{ident}`").cast("long").alias("_id"))
    # the number of rows comes from the files' footers; tasks of a bounded size need no more memory on larger tables
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_IDS))
    return ids.repartition(tasks, "_id").mapInArrow(run, "_id long")


def measurements(df: DataFrame, ident: str, keys: list[str], metrics: list[str]) -> DataFrame:
    """``keys, metrics`` of the rows, each id once; of rows of one id that differ the smallest stands for it.

    Rows with a null id can't be known as copies, so each counts. The rows stay where they are read: only those of a
    repeated id are grouped. Their ids are a table that Spark broadcasts if it is small and else joins by id.
    """
    rows = spread(df.select(F.col(f"`{ident}`").cast("long").alias("_id"), *keys, *metrics))
    twice = written(repeated_ids(df, ident))
    one = written(rows.join(twice, "_id", "left_semi").groupBy("_id").agg(F.min(F.struct(*keys, *metrics)).alias("r")).select("r.*"))
    return rows.join(twice, "_id", "left_anti").select(*keys, *metrics).unionByName(one)


def _values(t: pa.Table, keys: list[str], metrics: dict[str, tuple[float, float]]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each metric of a table: its name, the group and value of each measurement, sorted, and the first row of each group."""
    code, where = _codes([t.column(k) for k in keys])
    for m, (low, high) in metrics.items():
        x = t.column(m).to_numpy().astype(np.float32)
        ok = np.isfinite(x) & (x >= low) & (x <= high)
        g, v = code[ok], x[ok]
        if len(v):
            o = np.lexsort((v, g))
            yield m, g[o], v[o], where


def _groups_of(keys: list[str]) -> list[str]:
    return [k for k in keys if k != "metric"]


def sorted_runs(rows: DataFrame, keys: list[str], metrics: dict[str, tuple[float, float]]) -> DataFrame:
    """``keys, metric, vals``: the measurements of each group in sorted pieces, one for each step of a task."""
    by = _groups_of(keys)

    def run(batches):
        for t in _steps(batches):
            for m, g, v, where in _values(t, by, metrics):
                at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
                head = t.select(by).take(pa.array(where[g[at]]))
                yield pa.RecordBatch.from_arrays([*[as_array(head.column(k)) for k in by], pa.array([m] * len(at)), _lists(v, np.diff(np.r_[at, len(g)]))], names=[*by, "metric", "vals"])

    return rows.mapInArrow(run, f"{_key_schema(rows, by)}, metric string, vals array<float>")


def _flat(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(row of each element, elements) of a list column."""
    c = as_array(t.column(name))
    sizes = np.diff(c.offsets.to_numpy())
    return np.repeat(np.arange(len(c)), sizes), c.flatten().to_numpy(zero_copy_only=False)


def _merged(t: pa.Table, keys: list[str], delta: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """One digest for each group of a table of digests, and the group of each row."""
    code, where = _codes([t.column(k) for k in keys])
    row, x = _flat(t, "means")
    groups = len(where)
    g, x, w = cluster(code[row], x, _flat(t, "weights")[1], delta)
    sizes = np.bincount(g, minlength=groups)
    n = np.zeros(groups, dtype=np.int64)
    np.add.at(n, code, t.column("n").to_numpy())
    lo, hi = np.full(groups, np.inf, np.float32), np.full(groups, -np.inf, np.float32)
    np.minimum.at(lo, code, t.column("lo").to_numpy())
    np.maximum.at(hi, code, t.column("hi").to_numpy())
    head = t.select(keys).take(pa.array(where))
    cols = [pa.array(n), pa.array(lo), pa.array(hi), _lists(x, sizes, np.float64), _lists(w, sizes, np.float64)]
    return pa.RecordBatch.from_arrays([*[as_array(head.column(k)) for k in keys], *cols], names=[*keys, "n", "lo", "hi", "means", "weights"]), code


def digests(rows: DataFrame, keys: list[str], metrics: dict[str, tuple[float, float]], delta: int = DELTA, pieces: int = 0) -> DataFrame:
    """One digest for each group of measurements: ``keys, n, lo, hi, means, weights``; ``metric`` is one of the keys.

    ``metrics`` gives the possible range of each float column; nulls, values that aren't finite and values out of
    range are no measurements. Null keys are a group. Each step of a task clusters what it holds of every group, so
    at most about ``delta`` centroids a group and step are shuffled, however many rows a group has. No rows give no digests.
    """
    by = _groups_of(keys)
    names = [*keys, "n", "lo", "hi", "means", "weights"]

    def part(batches):
        for t in _steps(batches):
            for m, g, v, where in _values(t, by, metrics):
                at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
                last = np.r_[at[1:], len(g)] - 1
                dense = np.repeat(np.arange(len(at)), last - at + 1)
                cg, cx, cw = cluster(dense, v, np.ones(len(v)), delta)
                sizes = np.bincount(cg, minlength=len(at))
                head = t.select(by).take(pa.array(where[g[at]]))
                col = {k: as_array(head.column(k)) for k in by} | {"metric": pa.array([m] * len(at))}
                col |= {"n": pa.array((last - at + 1).astype(np.int64)), "lo": pa.array(v[at]), "hi": pa.array(v[last]), "means": _lists(cx, sizes, np.float64), "weights": _lists(cw, sizes, np.float64)}
                yield pa.RecordBatch.from_arrays([col[c] for c in names], names=names)

    parts = rows.mapInArrow(part, f"{_key_schema(rows, keys)}, {_DIGEST}")
    return merge_digests(parts, keys, delta, pieces=pieces)


def merge_digests(parts: DataFrame, keys: list[str], delta: int = DELTA, pieces: int = 0) -> DataFrame:
    """Digests of coarser ``keys`` from any digests: of days, files, partitions or a span of them.

    The digests of a task are sorted by group, so it holds one step of them and the group that is being merged,
    whose centroids are clustered again with each step. ``pieces`` is the number of digests that one group may
    have; where it is above ``FAN``, a group is first merged in parts, so none is merged by a single task.
    """
    cols = ["n", "lo", "hi", "means", "weights"]

    def merging(by):
        def whole(batches):
            held = None
            for t in _steps(batches, lambda b: len(b.column(b.schema.get_field_index("means")).flatten())):
                t = t if held is None else pa.concat_tables([held, t])
                d, code = _merged(t, by, delta)
                last = np.arange(d.num_rows) == code[-1]
                yield d.filter(pa.array(~last))
                held = pa.Table.from_batches([d.filter(pa.array(last))])
            if held is not None:
                yield from held.to_batches()

        return whole

    df = parts.select(*keys, *cols)
    if pieces > FAN:
        salted = [*keys, "_part"]
        df = df.withColumn("_part", F.pmod(F.xxhash64("n", "lo", "hi", F.element_at("means", 1)), F.lit(pieces // FAN)).cast("int")).select(*salted, *cols)
        df = df.repartition(*salted).sortWithinPartitions(*salted).mapInArrow(merging(salted), f"{_key_schema(df, salted)}, {_DIGEST}").select(*keys, *cols)
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merging(keys), f"{_key_schema(parts, keys)}, {_DIGEST}")


def estimates(d: DataFrame, keys: list[str], qs=QUANTILES) -> DataFrame:
    """``keys, n, lo, hi, est``: the values at ``qs`` of each digest."""

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            lo, hi = t.column("lo").to_numpy(), t.column("hi").to_numpy()
            at = as_array(t.column("means")).offsets.to_numpy()
            x, w = _flat(t, "means")[1], _flat(t, "weights")[1]
            at = at - at[0]
            # an estimate is a value of the column's own type, so counting with it needs no rounding
            est = np.array([estimate(x[i:j], w[i:j], p, q, qs) for i, j, p, q in zip(at[:-1], at[1:], lo, hi)]).reshape(-1, len(qs)).astype(np.float32).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)) for k in [*keys, "n", "lo", "hi"]], _lists(est.ravel(), np.full(len(est), len(qs)), np.float64)], names=[*keys, "n", "lo", "hi", "est"])

    return d.mapInArrow(run, f"{_key_schema(d, keys)}, n long, lo float, hi float, est array<double>")


def counted(rows: DataFrame, est: DataFrame, keys: list[str], metrics: dict[str, tuple[float, float]], m: int) -> DataFrame:
    """``est`` with ``below`` and ``upto``: the measurements of each group below and up to each of its ``m`` estimates.

    The estimates are shipped to the tasks, which count where the rows are read and shuffle the counts alone. With more
    groups than ``SHIPPED_GROUPS`` sorted pieces of the rows are joined with them instead.
    """
    by = _groups_of(keys)
    schema = f"{_key_schema(rows, keys)}, " + ", ".join(f"c{j} long" for j in range(2 * m))
    names = [*keys, *[f"c{j}" for j in range(2 * m)]]
    on = lambda: [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    if est.count() <= SHIPPED_GROUPS:
        t = est.select(*keys, "est").toArrow()
        flat = np.array(t.column("est").to_pylist(), dtype=np.float64).reshape(-1, m)
        shipped = rows.sparkSession.sparkContext.broadcast((t.select(keys), flat))

        def run(batches):
            known, value = shipped.value
            index = {k: i for i, k in enumerate(zip(*(known.column(c).to_pylist() for c in keys)))}
            for t in _steps(batches):
                for name, g, v, where in _values(t, by, metrics):
                    at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
                    head = t.select(by).take(pa.array(where[g[at]]))
                    lists = {k: head.column(k).to_pylist() for k in by} | {"metric": [name] * len(at)}
                    pick = np.array([index.get(k, -1) for k in zip(*(lists[c] for c in keys))])
                    out = np.zeros((len(at), 2 * m), dtype=np.int64)
                    for i, (a, z) in enumerate(zip(at, np.r_[at[1:], len(g)])):
                        if pick[i] >= 0:
                            e = value[pick[i]].astype(v.dtype)
                            out[i, :m], out[i, m:] = v[a:z].searchsorted(e, "left"), v[a:z].searchsorted(e, "right")
                    col = {k: as_array(head.column(k)) for k in by} | {"metric": pa.array([name] * len(at))}
                    yield pa.RecordBatch.from_arrays([*[col[k] for k in keys], *[pa.array(out[:, j]) for j in range(2 * m)]], names=names).filter(pa.array(pick >= 0))

        parts = rows.mapInArrow(run, schema)
    else:

        def run(batches):
            for b in batches:
                col = lambda n: b.column(b.schema.get_field_index(n))
                out = np.empty((b.num_rows, 2 * m), dtype=np.int64)
                off, vals = col("vals").offsets.to_numpy(), col("vals").values.to_numpy(zero_copy_only=False)
                e = col("est").flatten().to_numpy(zero_copy_only=False).reshape(-1, m).astype(vals.dtype)
                for i in range(b.num_rows):
                    v = vals[off[i] : off[i + 1]]
                    out[i, :m], out[i, m:] = v.searchsorted(e[i], "left"), v.searchsorted(e[i], "right")
                yield pa.RecordBatch.from_arrays([*[col(k) for k in keys], *[pa.array(out[:, j]) for j in range(2 * m)]], names=names)

        e = est.select(*[F.col(k).alias(f"_{k}") for k in keys], "est")
        parts = sorted_runs(rows, keys, metrics).join(e, on()).select(*keys, "vals", "est").mapInArrow(run, schema)
    sums = parts.groupBy(*keys).agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(2 * m)])
    sums = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.array(*[f"c{j}" for j in range(m)]).alias("below"), F.array(*[f"c{j}" for j in range(m, 2 * m)]).alias("upto"))
    return est.join(sums, on()).select(*est.columns, "below", "upto")


def _errors(c: DataFrame, qs) -> DataFrame:
    """``c`` with ``err``: the distance of each q from the ranks that its estimate has in the data, as a share of n."""
    err = [F.greatest(F.lit(0.0), F.col("below")[j] - q * F.col("n"), q * F.col("n") - F.col("upto")[j]) / F.col("n") for j, q in enumerate(qs)]
    return c.withColumn("err", F.array(*err))


def certify(rows: DataFrame, est: DataFrame, keys: list[str], metrics: dict[str, tuple[float, float]], qs=QUANTILES, bound: float = RANK_BOUND, delta: int = DELTA) -> DataFrame:
    """``keys, n, q, estimate, rank_error``: estimates whose rank error a counting pass has found to be within ``bound``.

    ``rank_error`` is the distance of q from the ranks that the estimate has in the data, as a share of n; it is 0
    where the wanted rank lies among values equal to the estimate. Groups with an estimate beyond the bound are
    digested again, ``FINER`` times as finely, and counted again, until none is left; a digest finer than a group has
    values holds each of them, so this ends.
    """
    m, by = len(qs), _groups_of(keys)
    done = []
    while True:
        c = written(_errors(counted(rows, est, keys, metrics, m), qs))
        worst = F.array_max("err")
        done.append(c.where(worst <= bound).select(*keys, "n", "est", "err"))
        bad = c.where(worst > bound).select(*keys)
        if bad.isEmpty():
            break
        delta *= FINER
        match = lambda names: [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in names]
        # written, so that their size is known before the join is planned
        named = written(bad.withColumnsRenamed({k: f"_{k}" for k in keys}))
        rows = rows.join(written(named.select(*[f"_{k}" for k in by]).distinct()), match(by), "left_semi")
        est = written(estimates(digests(rows, keys, metrics, delta), keys, qs).join(named, match(keys), "left_semi"))
    all_ = reduce(DataFrame.unionByName, done)
    r = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col("est")[j].alias("estimate"), F.col("err")[j].alias("rank_error")) for j, q in enumerate(qs)]))
    return all_.select(*keys, "n", r.alias("r")).select(*keys, "n", "r.*")


#: fixed values: the possible range of each measurement
RANGES = {"null_delta": (-1.0, 1.0), "null_max_cluster_sums": (0.0, float("inf"))}


def _rows(spark: SparkSession, sf_dir: str, *time: str) -> DataFrame:
    df = table(spark, sf_dir, "null_calibration").withColumn("month", F.date_format("run_day", "yyyy-MM"))
    return measurements(df, "calib_id", ["variant_id", "bin_label", *time], list(RANGES))


def _pieces(spark: SparkSession, sf_dir: str) -> int:
    """Steps that the table's rows make, by the number of rows in the files' footers."""
    return table(spark, sf_dir, "null_calibration").count() // STEP


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of both columns for each variant and bin, with the certified rank error and the stated bound."""
    keys = ["variant_id", "bin_label", "metric"]
    rows = _rows(spark, sf_dir)
    est = written(estimates(digests(rows, keys, RANGES, pieces=_pieces(spark, sf_dir)), keys))
    return certify(rows, est, keys, RANGES).withColumn("rank_bound", F.lit(RANK_BOUND))


def p1_day_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mergeable form: one digest for each variant, bin, metric and day."""
    return digests(_rows(spark, sf_dir, "run_day"), ["variant_id", "bin_label", "metric", "run_day"], RANGES, pieces=_pieces(spark, sf_dir))


def p1_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of each variant, bin and month, merged from the digests of the days and certified."""
    d = p1_day_digests(spark, sf_dir).withColumn("month", F.date_format("run_day", "yyyy-MM"))
    keys = ["variant_id", "bin_label", "metric", "month"]
    est = written(estimates(merge_digests(d, keys, pieces=_pieces(spark, sf_dir)), keys, (0.5,)))
    c = certify(_rows(spark, sf_dir, "month"), est, keys, RANGES, (0.5,))
    return c.select(*keys, "n", F.round("estimate", 6).alias("median"), "rank_error", F.lit(RANK_BOUND).alias("rank_bound"))


QUERIES = {"p1_percentiles": p1_percentiles, "p1_day_digests": p1_day_digests, "p1_monthly": p1_monthly}

#: estimates differ from exact percentiles within the bound; the tests compare with brute force
ORACLES: dict[str, str] = {}
