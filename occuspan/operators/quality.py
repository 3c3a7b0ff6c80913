"""Single-variant quality control: power by depth and the variant that is looked at."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occuspan.operators import kernels as K
from occuspan.session import shuffle_partitions, written
from occuspan.sources import views as V


def target_variant(mols: DataFrame, wanted: str | None = None) -> DataFrame:
    """One row: the named variant, else the one with most reads, ties by id."""
    n = mols.where("variant_id <> 'WT'").groupBy("variant_id").agg(F.count(F.lit(1)).alias("n_reads"))
    if wanted is not None:
        return n.where(F.col("variant_id") == wanted)
    return n.agg(F.min_by(F.struct("variant_id", "n_reads"), F.struct(-F.col("n_reads"), "variant_id")).alias("t")).where("t is not null").select("t.*")


def power(pack: DataFrame, variant: str, depths: list[int], resamples: int = 50, cfg: K.NullConfig = K.NullConfig(iterations=500)) -> DataFrame:
    """``depth, detected, mean_p`` : the share of resamples of a variant's reads, at each depth, with p below 0.05.

    Resamples are dealt to tasks and each is seeded by its depth and number; a depth above the variant's reads is drawn
    with replacement like the others.
    """
    spark = pack.sparkSession
    wt = K.wild_type(pack, cfg)
    one = K.wild_type(pack, cfg, variant)
    shipped = spark.sparkContext.broadcast((wt, one))

    def run(batches):
        wild, var = shipped.value
        for pdf in batches:
            rows = []
            for depth, k in zip(pdf["depth"], pdf["k"]) if len(var.nc) else ():
                name = f"power/{variant}/{depth}/{k}"
                at = np.random.default_rng(K.stable_seed(cfg.seed, "reads/" + name)).integers(0, len(var.nc), depth)
                rows.append((int(depth), K.test_variant(name, var.rows(at), var.nc[at], wild, cfg)["best_cluster_p"]))
            yield pd.DataFrame(rows, columns=["depth", "p"])

    every = spark.createDataFrame([(x, k) for x in depths for k in range(resamples)], "depth int, k int")
    p = every.repartition(shuffle_partitions(spark)).mapInPandas(run, "depth int, p double")
    return p.groupBy("depth").agg(F.avg(F.when(F.col("p") < 0.05, 1.0).otherwise(0.0)).alias("detected"), F.avg("p").alias("mean_p"))


#: fixed values: least and greatest width of a plausible cluster of each bin
PLAUSIBLE = {"sub_TF": (5, 30), "TF": (10, 60), "PIC": (25, 100), "nuc": (50, 200)}


def legacy_null(wt: K.WildType, target: dict[int, float], size: int, cfg: K.NullConfig, name: str) -> dict:
    """The older null: draws of ``size`` wild-type reads with the target shares of counts, less wild type's plain mean.

    Each draw finds its own clusters over its own spatial threshold, the quantile of its absolute differences along the
    window. Gives ``delta`` (draws x bins x positions), and of each bin all cluster sums and each draw's greatest one.
    """
    rng = np.random.default_rng(K.stable_seed(cfg.seed, "legacy/" + name))
    need = [(k, max(1, int(round(f * size)))) for k, f in sorted(target.items())]
    delta = np.empty((cfg.iterations, wt.bins, wt.length), dtype=np.float32)
    mean = np.stack([wt.means(i)[None] for i in range(wt.bins)]).astype(np.float32)
    block = max(1, min(K.DRAW_BLOCK, K.DRAW_CELLS // max(1, size)))
    for s in range(0, cfg.iterations, block):
        idx = K.draw_matrix(wt.pools, need, size, min(block, cfg.iterations - s), rng)
        delta[s : s + len(idx)] = wt.sums(idx) / np.float32(size) - mean
    sums, greatest = [], []
    for i in range(wt.bins):
        a = np.abs(delta[:, i])
        hot = a > np.percentile(a, cfg.quantile * 100, axis=1)[:, None]
        each = [[c["sum_abs"] for c in K.island_table(h, d, cfg.gap, cfg.merge, cfg.min_width)] for h, d in zip(hot, a)]
        sums.append(np.array([x for e in each for x in e]))
        greatest.append(np.array([max(e, default=0.0) for e in each]))
    return {"delta": delta, "sums": sums, "greatest": greatest}


_EFFECT = (
    "variant_id string, bin string, n_raw int, n_matched int, max_abs_delta double, n_positions_q10 int, agree int, disagree int, only_z int, only_empirical int, "
    "clusters array<struct<abs_start:int,abs_end:int,sum_abs_delta:double,sum_p:double,max_sum_p:double,plausible:boolean>>"
)


def effect_test(name: str, bits: np.ndarray, nc: np.ndarray, wt: K.WildType, cfg: K.NullConfig) -> list[dict]:
    """:func:`effect_profile` of a variant given by its reads."""
    return effect_profile(name, lambda at: bits[at].sum(axis=0, dtype=np.int64).reshape(wt.bins, wt.length), nc, wt, cfg)


def effect_profile(name: str, sums: Callable[[np.ndarray], np.ndarray], nc: np.ndarray, wt: K.WildType, cfg: K.NullConfig) -> list[dict]:
    """The single-variant test against the older null, a row for each bin.

    Reads are first matched to wild type's counts without replacement. Positions get an empirical p, a q within the
    promoter and a z-score, which are compared; clusters over the null's threshold at each position get their p among all
    null clusters and among the draws' greatest ones, and whether their width is plausible.
    """
    lo = cfg.window[0]
    ps, pe = cfg.promoter[0] - lo, cfg.promoter[1] - lo
    known = wt.nc[wt.nc >= 0]
    target = {int(k): n / len(known) for k, n in zip(*np.unique(known, return_counts=True))}
    at = K.matched_subsample(nc, target, np.random.default_rng(K.stable_seed(cfg.seed, "match/" + name)))
    null = legacy_null(wt, target, len(at), cfg, name)
    profile, out = sums(at) / len(at), []
    for i, label in enumerate(cfg.bins):
        obs = profile[i] - wt.means(i)[None]
        d = null["delta"][:, i]
        a, a_obs = np.abs(d), np.abs(obs)
        p = ((a >= a_obs).sum(axis=0) + 1) / (len(d) + 1)
        q = np.ones(len(p))
        q[ps:pe] = K.bh_values(p[ps:pe])
        z = (obs - d.mean(axis=0)) / np.maximum(d.std(axis=0), 1e-6)
        by_z, by_p = np.abs(z) > 2.0, p < 0.05
        sums, greatest = null["sums"][i], null["greatest"][i]
        least, most = PLAUSIBLE.get(label, (3, 200))
        clusters = [
            {
                "abs_start": c["start"] + lo, "abs_end": c["end"] + lo, "sum_abs_delta": c["sum_abs"], "sum_p": max(float(np.mean(sums >= c["sum_abs"])), 1 / (len(sums) + 1)) if len(sums) else None,
                "max_sum_p": float(np.mean(greatest >= c["sum_abs"])), "plausible": least <= c["end"] - c["start"] + 1 <= most,
            }
            for c in K.island_table(a_obs > np.percentile(a, cfg.quantile * 100, axis=0), obs, cfg.gap, cfg.merge, cfg.min_width)
            if c["end"] >= ps and c["start"] < pe
        ]
        out.append({"variant_id": name, "bin": label, "n_raw": len(nc), "n_matched": len(at), "max_abs_delta": float(a_obs.max()), "n_positions_q10": int((q[ps:pe] < 0.10).sum()), "agree": int((by_z == by_p).sum()), "disagree": int((by_z != by_p).sum()), "only_z": int((by_z & ~by_p).sum()), "only_empirical": int((~by_z & by_p).sum()), "clusters": clusters})
    return out


def single_variant(pack: DataFrame, variant: str, cfg: K.NullConfig) -> DataFrame:
    """:func:`effect_test` of one variant's packed reads; a variant without reads gives no rows."""
    spark = pack.sparkSession
    one = K.wild_type(pack, cfg, variant)
    shipped = spark.sparkContext.broadcast((K.wild_type(pack, cfg), one))

    def run(batches):
        for pdf in batches:
            wild, var = shipped.value
            if len(pdf) and len(var.nc):
                yield pd.DataFrame(effect_profile(variant, lambda at: var.profile(var.counts(var.pat[at])), var.nc, wild, cfg))

    return spark.range(0, 1, 1, 1).mapInPandas(run, _EFFECT)


def single_variant_test(spark, d):
    """The single-variant test of the variant with most reads, with the 500 draws of its kind."""
    cfg = K.NullConfig(iterations=500)
    row = target_variant(V.molecules(spark, d)).first()
    return single_variant(written(K.packed(V.read_nc(spark, d), V.segments(spark, d), cfg)), row["variant_id"], cfg)


def target_variant_q(spark, d):
    return target_variant(V.molecules(spark, d))


def power_curve(spark, d):
    """Detection by depth of the variant with most reads."""
    cfg = K.NullConfig(iterations=500)
    row = target_variant(V.molecules(spark, d)).first()
    return power(written(K.packed(V.read_nc(spark, d), V.segments(spark, d), cfg)), row["variant_id"], [25, 50, 100, 200], 50, cfg)


QUERIES = {"target_variant": target_variant_q, "power_curve": power_curve, "single_variant_test": single_variant_test}
ORACLES = {"target_variant": V.sql("molecules", "select variant_id, count(*) as n_reads from molecules where variant_id <> 'WT' group by 1 order by 2 desc, 1 limit 1")}
