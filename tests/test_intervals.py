import random

import pytest
from pyspark.sql import functions as F

from occuspan.operators.intervals import bin_spelling, periods_and_gaps, usable_clusters
from occuspan.operators.joins import nearest, overlap_join
from occuspan.operators.ordered import bh, fold_merge, islands
from occuspan.operators import kernels as K

import numpy as np


def brute(rows):
    """Periods and gaps by marking positions."""
    out = set()
    by = {}
    for k, s, e in rows:
        if s is not None and e is not None and e >= s:
            by.setdefault(k, set()).update(range(s, e + 1))
    for k, pos in by.items():
        p = sorted(pos)
        runs, a = [], p[0]
        for x, y in zip(p, [*p[1:], None]):
            if y != x + 1:
                runs.append((a, x))
                a = y
        out |= {(k, "period", *r) for r in runs}
        out |= {(k, "gap", r[1] + 1, q[0] - 1) for r, q in zip(runs, runs[1:])}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_periods_and_gaps_against_positions(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None]), s := r.choice([None, r.randrange(0, 300)]), None if s is None else s + r.randrange(-5, 20)) for _ in range(200)]
    rows += rows[:20] + [("hot", i, i + 1) for i in range(0, 200000, 1000)]
    df = spark.createDataFrame([(k, s, e, "x") for k, s, e in rows], "k string, s int, e int, kind string")
    got = {tuple(x) for x in periods_and_gaps(df, ["k"], "s", "e").collect()}
    assert got == brute(rows)


def test_touching_nested_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 6, 7), ("a", 2, 3), ("a", 9, 9)], "k string, s int, e int")
    assert {tuple(x)[1:] for x in periods_and_gaps(df, ["k"], "s", "e").collect()} == {("period", 1, 7), ("gap", 8, 8), ("period", 9, 9)}
    assert periods_and_gaps(df.where("s > 99"), ["k"], "s", "e").count() == 0


def test_bins_and_usable_rows(spark):
    df = spark.createDataFrame(
        [("s", "v", " tf\t", 1, 2), ("s", None, "TF", 1, 2), ("s", "v", "all", 1, 2), ("s", "v", "NUC", -1, 2), ("s", "v", "pic", 5, 4), (None, "v", "SUB_TF", 0, 0), ("s", "v", None, 0, 1)],
        "sample_id string, variant_id string, bin_labels string, abs_start int, abs_end int",
    )
    assert sorted((r.sample_id or "", r.bin_labels) for r in usable_clusters(df).collect()) == [("", "sub_TF"), ("s", "TF")]
    assert df.select(bin_spelling(F.lit(None).cast("string"))).first()[0] is None


@pytest.mark.parametrize("seed", range(3))
def test_islands_against_the_rule(spark, seed):
    r = np.random.default_rng(seed)
    v = r.normal(0, 1, 200)
    df = spark.createDataFrame([("k", int(i), float(x)) for i, x in enumerate(v)], "k string, pos int, delta double")
    got = sorted((c.start, c.end, round(c.sum_abs_delta, 6), c.peak_position, round(c.sign_consistency, 6)) for c in islands(df, ["k"], F.abs("delta") > 1.3).collect())
    hot = np.abs(v) > 1.3
    filled = hot.copy()
    for i in range(200):
        filled[i] |= hot[max(0, i - 2) : i].any() and hot[i + 1 : i + 3].any()
    runs, i = [], 0
    while i < 200:
        if filled[i]:
            j = i
            while j + 1 < 200 and filled[j + 1]:
                j += 1
            if runs and i - runs[-1][1] <= 5:
                runs[-1][1] = j
            else:
                runs.append([i, j])
            i = j
        i += 1
    want = []
    for a, b in runs:
        if b - a + 1 >= 3:
            x = v[a : b + 1]
            dom = 1 if x.mean() >= 0 else -1
            want.append((a, b, round(np.abs(x).sum(), 6), a + int(np.argmax(np.abs(x))), round(float((np.sign(x) == dom).mean()), 6)))
    assert got == want
    # the kernel's forms of the same rule
    assert [(c["start"], c["end"]) for c in K.island_table(hot, v, 2, 5, 3)] == [(a, b) for a, b, *_ in want]
    assert K.island_max(hot[None], np.abs(v)[None], 2, 5, 3)[0] == pytest.approx(max([w[2] for w in want], default=0), abs=1e-5)


def test_bh_with_ties_and_nulls(spark):
    p = [0.01, 0.04, 0.03, 0.03, None, 0.9]
    df = spark.createDataFrame([(i, "k", x) for i, x in enumerate(p)], "i int, k string, p double")
    got = {r.i: r.q for r in bh(df, "p", ["k"]).collect()}
    known = sorted(x for x in p if x is not None)
    for i, x in enumerate(p):
        want = None if x is None else min(1, min(y * len(known) / (k + 1) for k, y in enumerate(known) if y >= x))
        assert got[i] == (None if want is None else pytest.approx(want))


def test_overlap_join_and_nearest(spark):
    r = random.Random(1)
    a = [(i, "k", s := r.randrange(2000), s + r.randrange(700)) for i in range(60)]
    b = [(i, "k", s := r.randrange(2000), s + r.randrange(50)) for i in range(60)]
    x = spark.createDataFrame(a, "i int, k string, s int, e int")
    y = spark.createDataFrame(b, "i int, k string, s int, e int")
    got = sorted((r.i, r.b_i) for r in overlap_join(x, y, ["k"], ("s", "e"), ("s", "e")).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in b if p[2] <= q[3] and q[2] <= p[3])
    near = {r.i: r.nearest for r in nearest(x, y, ["k"], "s", "e").collect()}
    assert all(near[p[0]] == min((q[3] for q in b), key=lambda v: (abs(v - p[2]), v)) for p in a)


def test_fold_merge_grows(spark):
    df = spark.createDataFrame([("k", 0, 9), ("k", 5, 14), ("k", 20, 29), ("k", 0, 9), ("k", None, 3)], "k string, s int, e int")
    assert sorted((r.s, r.e) for r in fold_merge(df, ["k"], "s", "e", 0.5).collect()) == [(0, 14), (20, 29)]


def test_union_takes_calls_of_any_width(spark, monkeypatch):
    from occuspan.operators import ordered

    rows = [("L", "nuc", 0, 499, 500), ("L", "nuc", 450, 520, None), ("L", "TF", 5, 30, 26)]
    monkeypatch.setattr(ordered.V, "cluster_rows", lambda s, d: s.createDataFrame(rows, "library string, bin string, abs_start int, abs_end int, width int"))
    assert {tuple(r) for r in ordered.interval_union_merge(spark, "").collect()} == {("L", "nuc", 0, 520), ("L", "TF", 5, 30)}


def test_percentiles_by_ranges(spark):
    import numpy as np

    from occuspan.operators.aggregates import percentiles

    r = np.random.default_rng(0)
    rows = [(k, float(v)) for k, n in (("a", 500), ("b", 1), (None, 40)) for v in np.round(r.normal(0, 5, n) ** 3, 1)] + [("same", 2.5)] * 30 + [("a", None), ("none", None), ("a", float("nan"))]
    got = {x.k: (x.n, x.p) for x in percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", (0.0, 0.25, 0.5, 0.99, 1.0), buckets=16).collect()}
    by = {}
    for k, v in rows:
        if v is not None and v == v:
            by.setdefault(k, []).append(v)
    assert set(got) == set(by)
    for k, v in by.items():
        assert got[k][0] == len(v) and np.allclose(got[k][1], np.percentile(v, [0, 25, 50, 99, 100]))


def test_nearest_of_a_list(spark):
    import random

    from occuspan.operators import joins

    g = random.Random(1)
    grid = [g.randrange(500) for _ in range(40)]
    rows = [(i, g.randrange(-20, 540) if i % 9 else None) for i in range(200)]
    want = {i: None if x is None else min(set(grid), key=lambda v: (abs(v - x), v)) for i, x in rows}
    a, b = spark.createDataFrame(rows, "i int, x int"), spark.createDataFrame([(v,) for v in grid] + [(None,)], "v int")
    for most in (100_000, 3):  # the list rides along, or rows and values are dealt to blocks
        got = {r.i: r.nearest for r in joins.nearest_of_few(a.where("x is not null"), b, "x", "v", most).collect()}
        assert got == {i: float(v) for i, v in want.items() if v is not None}
    near = joins.nearest(a.where("x is not null").withColumn("k", a.i * 0), b.withColumn("k", b.v * 0), ["k"], "x", "v", 3).collect()
    assert {r.i: r.nearest for r in near} == {i: float(v) if abs(v - dict(rows)[i]) <= 3 else None for i, v in want.items() if v is not None}
