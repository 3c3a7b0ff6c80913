import numpy as np
import pytest
from pyspark.sql import functions as F

from occuspan.llm import digests as D


def make(spark, n=6000):
    r = np.random.default_rng(0)
    rows = []
    for i in range(n):
        k = ["hot", "hot", "a", None][int(r.integers(4))]
        x = float(np.float32(r.choice([r.normal(0, 0.2), 0.25, 5.0, np.nan, -999999.0])))
        rows.append((i, k, int(r.integers(3)), None if r.random() < 0.02 else x, "clash"))
    rows += rows[:500] + [(n + 1 + i, "const", 0, 0.1, "c") for i in range(900)] + [(None, "nul", 0, 0.5, "c")] * 2
    return spark.createDataFrame(rows, "id long, k string, day int, x float, metric_ string"), rows


def exact(rows):
    seen, by = set(), {}
    for i, k, d, x, _ in rows:
        if i is not None and i in seen:
            continue
        seen.add(i)
        if x is not None and np.isfinite(x) and -1 <= x <= 1:
            by.setdefault(k, []).append(float(np.float32(x)))
    return {k: np.sort(v) for k, v in by.items()}


RANGE = {"x": (-1.0, 1.0)}


def rank_error(v, e, q):
    return max(0, np.searchsorted(v, e, "left") - q * len(v), q * len(v) - np.searchsorted(v, e, "right")) / len(v)


@pytest.mark.parametrize("shipped", [1000, 0])
def test_percentiles_within_the_bound_and_counts_exact(spark, monkeypatch, shipped):
    """With estimates shipped, and joined where there are more groups than may be shipped."""
    monkeypatch.setattr(D, "SHIPPED_GROUPS", shipped)
    df, rows = make(spark)
    got_rows = D.measurements(df, "id", ["k", "day"], ["x"]).cache()
    want = exact(rows)
    keys = ["k", "metric"]
    est = D.estimates(D.digests(got_rows, keys, RANGE), keys).cache()
    got = D.certify(got_rows, est, keys, RANGE).collect()
    assert {r.k: r.n for r in got} == {k: len(v) for k, v in want.items()}
    for r in got:
        err = rank_error(want[r.k], r.estimate, r.q)
        assert r.rank_error == pytest.approx(err, abs=1e-12) and err <= D.RANK_BOUND
    if not shipped:
        return
    days = D.digests(got_rows, [*keys, "day"], RANGE).cache()
    part = exact([r for r in rows if r[2] > 0])
    for pieces in (0, 5000):  # merged by one task a group, and by parts first
        for r in D.estimates(D.merge_digests(days.where("day > 0"), keys, pieces=pieces), keys).collect():
            v = part[r.k]
            assert r.n == len(v)
            assert all(rank_error(v, e, q) <= D.RANK_BOUND for q, e in zip(D.QUANTILES, r.est))


def test_estimates_beyond_the_bound_are_refined(spark):
    df, rows = make(spark, 2000)
    got_rows = D.measurements(df, "id", ["k", "day"], ["x"]).cache()
    est = D.estimates(D.digests(got_rows, ["k", "metric"], RANGE, 8), ["k", "metric"], (0.5,)).withColumn("est", F.array(F.lit(0.9)))
    got = D.certify(got_rows, est, ["k", "metric"], RANGE, (0.5,), bound=0.001, delta=8).collect()
    want = exact(rows)
    assert {r.k for r in got} == set(want)
    for r in got:
        assert r.rank_error <= 0.001 and rank_error(want[r.k], r.estimate, 0.5) <= 0.001


def test_steps_of_any_size_give_whole_counts(spark, monkeypatch):
    df, rows = make(spark, 3000)
    want = {k: len(v) for k, v in exact(rows).items()}

    def small(batches):
        D.STEP = 700
        return batches

    got_rows = D.measurements(df, "id", ["k", "day"], ["x"]).repartition(2).mapInArrow(small, "k string, day int, x float")
    monkeypatch.setattr(D, "STEP", 700)
    assert {r.k: r.n for r in D.digests(got_rows, ["k", "metric"], RANGE).collect()} == want


def test_unlike_copies_count_once_and_empty_tables_give_nothing(spark):
    df = spark.createDataFrame([(1, "a", 0, 0.5), (1, "b", 0, 0.6), (1, "a", 0, 0.5), (2, "a", 0, 0.1), (None, "a", 0, 0.1), (None, "a", 0, 0.1)], "id long, k string, day int, x float")
    got = D.measurements(df, "id", ["k", "day"], ["x"])
    assert sorted((r.k, round(r.x, 3)) for r in got.collect()) == [("a", 0.1), ("a", 0.1), ("a", 0.1), ("a", 0.5)]
    none = D.measurements(df.where("id > 9"), "id", ["k", "day"], ["x"])
    assert D.digests(none, ["k", "metric"], RANGE).count() == 0
    assert D.certify(none, D.estimates(D.digests(none, ["k", "metric"], RANGE), ["k", "metric"]), ["k", "metric"], RANGE).count() == 0


def test_merging_many_digests_of_a_skewed_column():
    r = np.random.default_rng(2)
    x = np.exp(r.normal(0, 3, 200_000))
    parts = [D.cluster(np.zeros(2000, int), x[i : i + 2000], np.ones(2000)) for i in range(0, len(x), 2000)]
    g, m, w = D.cluster(*(np.concatenate(p) for p in zip(*parts)))
    assert w.sum() == len(x) and len(m) <= D.DELTA + 2
    x.sort()
    for q, e in zip(D.QUANTILES, D.estimate(m, w, x[0], x[-1])):
        assert abs(np.searchsorted(x, e) / len(x) - q) <= D.RANK_BOUND
