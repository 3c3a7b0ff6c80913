import math
import random

import pytest
from pyspark.sql import functions as F

from occuspan.llm import components, quotas, survivors
from occuspan.llm.barcodes import read_barcode


def groups(records):
    """Union-find over (scope, member)."""
    up = {}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for s, m in records:
        m = [x for x in (m or []) if x is not None]
        for x in m:
            up.setdefault((s, x), (s, x))
        for x in m[1:]:
            a, b = find((s, m[0])), find((s, x))
            up[max(a, b, key=lambda t: t[1])] = min(a, b, key=lambda t: t[1])
    best = {}
    for k in up:
        r = find(k)
        best[r] = min(best.get(r, k[1]), k[1])
    return {(s, x, best[find((s, x))]) for s, x in up}


@pytest.mark.parametrize("seed", range(2))
def test_groups_against_union_find(spark, seed):
    r = random.Random(seed)
    recs = [(r.choice(["L", "M", None]), [r.choice([None, f"b{r.randrange(160):03d}"]) for _ in range(r.randrange(0, 4))]) for _ in range(150)]
    recs += [("chain", [f"c{i:03d}", f"c{i + 1:03d}"]) for i in range(90)] + [("hub", ["z", f"h{i:03d}"]) for i in range(200)] + [("big", ["zz", f"k{i:03d}"]) for i in range(50)] + [("L", None), ("L", ["lone"])]
    rows = [(s, b, next(x for x in m if x is not None), "x") for s, m in recs if m for b in m if any(x is not None for x in m)]
    df = spark.createDataFrame([*rows, *rows[:9], ("L", None, None, "x")], "library string, barcode string, hub string, group_id string")
    for mask in (-1, 0xFFFF) if seed else (-1,):  # with numbers of 16 bits some are shared
        got = components.group_members(df, "library", "barcode", "hub", mask).collect()
        assert {tuple(x) for x in got} == groups(recs) and len(got) == len(groups(recs))


def test_no_records_no_groups(spark):
    df = spark.createDataFrame([], "library string, barcode string, hub string")
    assert components.group_members(df, "library", "barcode", "hub").count() == 0
    assert components.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


@pytest.mark.parametrize("order", ["sorted", "shuffled", "zigzag"])
def test_components_of_a_path(spark, order):
    """Rounds grow with the logarithm of a path's length, however its ids lie along it."""
    n = {"sorted": 5000, "shuffled": 300, "zigzag": 1000}[order]
    ids = list(range(n))
    if order == "shuffled":
        random.Random(5).shuffle(ids)
    if order == "zigzag":  # every other vertex is smaller than both neighbours
        ids = [x for pair in zip(range(n // 2), range(n // 2, n)) for x in pair]
    df = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:])], "a long, b long")
    rounds = []
    assert {x.v: x.root for x in components.components(df, rounds).collect()} == {i: 0 for i in range(1, n)}
    most = 2 * math.log2(n)
    assert len(rounds) <= most and max(rounds) <= most + 2, rounds
    if order == "sorted":
        assert len(rounds) == 1


def test_stars_of_records(spark):
    rows = [("L", "ACGTACGTA", ["CCGTACGTA", "*", None]), ("L", "*", ["x", "ggGTACGTA..", "TTTTTTTTT"]), ("M", None, None), ("M", "AAAAAAAAC", [])]
    got = components.barcode_stars(spark.createDataFrame(rows, "library string, cluster_barcode string, member_barcodes array<string>")).where("barcode is not null").collect()
    assert sorted(tuple(x) for x in got) == [("L", "ACGTACGTA", "ACGTACGTA"), ("L", "CCGTACGTA", "ACGTACGTA"), ("L", "GGGTACGTA", "GGGTACGTA"), ("L", "TTTTTTTTT", "GGGTACGTA"), ("M", "AAAAAAAAC", "AAAAAAAAC")]


def test_how_barcodes_are_read(spark):
    cases = {" acgtacgtn x": "ACGTACGTN", "ACGTACG": None, "ACGTACGT...+3more": "ACGTACGT", "*": None, "": None, None: None, "XACGTACGT": None, "\tACGTACGT\n": "ACGTACGT"}
    df = spark.createDataFrame([(k,) for k in cases], "e string").select("e", read_barcode(F.col("e")).alias("b"))
    assert {r.e: r.b for r in df.collect()} == cases


def test_survivors(spark):
    rows = [
        ("L", "B", 1, '["1:A>C"]', 0.9, 5, None), ("L", "B", 2, "wt ", 0.9, 0, 7), ("L", "B", 3, "[]", 1.0, 9, 8), ("L", "B", 2, "wt ", 0.9, 0, 7), ("L", "B", 4, '["1:A', 0.99, 9, 8),
        ("L", "C", 5, "WT", 0.5, 1, 1), ("L", "C", 5, "WT", 0.5, 1, 1), ("L", "D", 6, None, None, None, None), ("L", "D", 7, "NA", float("nan"), -1, None), (None, "E", 8, "WT", 1.0, 1, 1), (None, "E", 9, "WT", 1.0, 1, 1),
    ]
    df = spark.createDataFrame(rows, "k string, b string, id long, tag string, sup double, n long, at long")
    ok = survivors.usable_tag(F.col("tag")) & (F.col("sup") > 0) & (F.col("sup") <= 1)
    got = survivors.survivors(df, ["k", "b"], "id", {"t": (ok, [F.col("sup"), F.col("at")]), "r": (F.col("n") > 0, [F.col("at")])})
    assert {(r.b, r.t, r.r) for r in got.collect()} == {("B", 2, 3), ("D", -1, -1)}
    assert got.where("b = 'Z'").count() == 0 and survivors.survivors(df.limit(0), ["k", "b"], "id", {"r": (F.col("n") > 0, [F.col("at")])}).count() == 0


def test_fusion_discounts_copies(spark):
    r = random.Random(1)
    rows = []
    for k in range(300):
        truth = "t"
        a, b = ("t" if r.random() < 0.9 else f"x{r.randrange(9)}" for _ in range(2))
        bad = "t" if r.random() < 0.5 else f"y{r.randrange(9)}"
        rows += [(k, "a", a), (k, "b", b), (k, "c1", bad), (k, "c2", bad), (k, "c3", bad)]
        assert truth
    f = survivors.fuse(spark.createDataFrame(rows, "k int, s string, v string"), ["k"], "s", "v").collect()
    assert sum(x.value == "t" for x in f) > 255 and all(0 < x.posterior <= 1 for x in f)
    one = survivors.fuse(spark.createDataFrame([(1, "a", "v"), (1, None, "w"), (2, "a", None)], "k int, s string, v string"), ["k"], "s", "v").collect()
    assert [(x.k, x.value) for x in one] == [(1, "v")]


def fused_by_hand(claims, n_false=10, prior=0.1):
    """The same rule in plain loops over (key, source, value), one claim for each key and source."""
    by = {}
    for k, s, v in claims:
        by.setdefault(k, []).append((s, v))
    acc = {s: 0.8 for _, s, _ in claims}
    lead, turn = {}, 0
    while True:
        turn += 1
        n = {}
        for k, said in by.items():
            for s, v in said:
                for t, u in said:
                    if s < t:
                        x = n.setdefault((s, t), [0, 0, 0])
                        x[2 if v != u else 1 if v == lead.get(k) else 0] += 1
        copy = {}
        for (s, t), (f, h, u) in n.items():
            e = 1 - (acc[s] + acc[t]) / 2
            pf, pt = max(1e-6, e * e / n_false), max(1e-6, (1 - e) ** 2)
            odds = math.log(prior / (1 - prior)) + u * math.log(0.2)
            odds += f * math.log((0.8 * e + 0.2 * pf) / pf) + h * math.log((0.8 * (1 - e) + 0.2 * pt) / pt) if lead else (f + h) * math.log((0.8 + 0.2 * (pf + pt)) / (pf + pt))
            copy[s, t] = 1 / (1 + math.exp(-max(-700, min(700, odds))))
        out = {}
        for k, said in by.items():
            score = {}
            said = sorted(said, key=lambda x: (-acc[x[0]], x[0]))
            for i, (s, v) in enumerate(said):
                free = math.prod(1 - copy.get((min(s, t), max(s, t)), 0) for t, u in said[:i] if u == v)
                score[v] = score.get(v, 0) + math.log(n_false * acc[s] / (1 - acc[s])) * free
            score = {v: round(x, 9) for v, x in score.items()}
            top = max(score.values())
            z = sum(math.exp(x - top) for x in score.values()) + max(n_false + 1 - len(score), 0) * math.exp(-top)
            out[k] = (min(v for v, x in score.items() if x == top), 1 / z)
        lead = {k: v for k, (v, _) in out.items()}
        new = {}
        for k, s, v in claims:
            new.setdefault(s, []).append(out[k][1] if v == lead[k] else (1 - out[k][1]) / n_false)
        new = {s: min(0.99, max(0.05, sum(x) / len(x))) for s, x in new.items()}
        step = {s: (new[s] - acc[s]) * 0.5 ** max(0, turn - 3) for s in acc}
        acc = {s: acc[s] + step[s] for s in acc}
        if max(map(abs, step.values())) < 1e-3:
            return out


def test_fusion_by_hand(spark, monkeypatch):
    monkeypatch.setattr(survivors, "PAIR_BLOCK", 6)  # the ten links are taken in two blocks
    r = random.Random(4)
    claims = [(k, f"s{s}", r.choice("xyz") if s != 2 or r.random() < 0.3 else "x") for k in range(60) for s in range(5) if r.random() < 0.6]
    want = fused_by_hand(claims)
    df = spark.createDataFrame([(k or None, "L", s, v, "w") for k, s, v in claims], "k int, library string, s string, v string, value string")
    got = survivors.fuse(df, ["k", "library"], "s", "v").collect()
    assert {r.k or 0: r.value for r in got} == {k: v for k, (v, _) in want.items()}
    assert all(abs(r.posterior - want[r.k or 0][1]) < 1e-6 for r in got)


def test_fusion_ties_go_to_the_smallest(spark):
    rows = [(1, "a", "y"), (1, "b", "x"), (2, "c", "q"), (2, "c", "p")]
    got = {r.k: r.value for r in survivors.fuse(spark.createDataFrame(rows, "k int, s string, v string"), ["k"], "s", "v").collect()}
    assert got == {1: "x", 2: "p"}
    assert survivors.fuse(spark.createDataFrame([], "k int, s string, v string"), ["k"], "s", "v").count() == 0


def test_fused_keeps_barcodes_without_resolver(spark, tmp_path):
    kinds = "library string, cluster_barcode string, resolution_id long, consensus_variant_tag string, variant_support double, total_reads long, resolved_at timestamp, resolver string"
    rows = [("L", "ACGTACGTACGTACG", 1, "WT", None), ("L", "CCGTACGTACGTACG", 2, '["1:A>C"]', "r1"), ("L", "CCGTACGTACGTACG", 3, '["1:A>C"]', None), ("L", "GCGTACGTACGTACG", 4, "NA", None)]
    spark.createDataFrame([(a, b, i, v, 0.9, 5, None, s) for a, b, i, v, s in rows], kinds).write.parquet(str(tmp_path / "barcode_cluster_resolution.parquet"))
    got = {r.cluster_barcode: (r.tag, r.n_sources) for r in survivors.p3_fused(spark, str(tmp_path)).collect()}
    assert got == {"ACGTACGTACGTACG": ("WT", 1), "CCGTACGTACGTACG": ('["1:A>C"]', 2)}


def test_quotas_keep_floors_caps_and_sum():
    import numpy as np

    r = np.random.default_rng(0)
    for _ in range(300):
        n = r.integers(1, 8)
        share = r.random(n)
        share /= share.sum()
        have, floor, total = r.integers(0, 60, n), r.integers(0, 10, n), int(r.integers(0, 200))
        q = quotas.largest_remainder(share, floor, have, total)
        assert (q <= have).all() and (q >= np.minimum(floor, have)).all()
        assert q.sum() == min(max(total, np.minimum(floor, have).sum()), have.sum())
    assert quotas.largest_remainder(np.array([0.5, 0.3, 0.2]), np.zeros(3, int), np.array([99, 99, 99]), 11).tolist() == [6, 3, 2]


@pytest.mark.parametrize("range_rows", [500_000, 1])
def test_sample_holds_the_smallest_keys(spark, monkeypatch, range_rows):
    monkeypatch.setattr(quotas, "RANGE_ROWS", range_rows)  # with 1 the range of the quota's end is cut again
    r = random.Random(3)
    rows = [("s", f"q{i}", 0 if i < 900 else r.choice([1, 2, None, -1])) for i in range(1300)] + [("t", "q", 5)]
    reads = spark.createDataFrame(rows, "sample_id string, query_name string, nc int")
    targets = spark.createDataFrame([("s", 0, 0.6, 0, 500), ("s", 1, 0.2, 3, 500), ("s", 2, 0.1, 1, 500), ("s", 9, 0.1, 4, 500), ("u", 1, 0.5, 2, 10)], "sample_id string, nc int, target_share double, min_rows int, sample_rows long")
    key = F.xxhash64(F.lit(1), F.col("query_name"))
    rep = quotas.quota_report(quotas.eligible(reads), targets, "sample_id", "nc", "target_share", "min_rows", "sample_rows").cache()
    s = quotas.quota_sample(quotas.eligible(reads), rep, "sample_id", "nc", key)
    quota = {(x.sample_id, x.nc): x for x in rep.collect()}
    got = s.collect()
    for (u, c), x in quota.items():
        mine = {g.query_name for g in got if (g.sample_id, g.nc) == (u, c)}
        assert len(mine) == x.quota <= x.have
        order = [z.query_name for z in reads.where((F.col("sample_id") == u) & (F.col("nc") == c)).orderBy(key).collect()]
        assert mine == set(order[: x.quota])
    assert quota["s", 9].have == 0 and quota["s", 9].needed == 50 and quota["u", 1].quota == 0
    assert sum(x.quota for (u, _), x in quota.items() if u == "s") == 500 and not any(g.sample_id == "t" for g in got)


def test_last_record_decides(spark):
    t = spark.createDataFrame([("s", "q", 3, 1), ("s", "q", None, 2), ("s", "r", 2, 5), ("s", "r", 2, 5), ("s", "r", 7, 4), (None, "x", 1, 1)], "sample_id string, query_name string, nc int, ordinal long")
    assert {(x.query_name, x.nc) for x in quotas.reads_of(t).collect()} == {("q", None), ("r", 2)}
