"""Position matrices: log-odds, best placements on both strands, and their fit to base sensitivity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from occuspan.operators import motifs as M
from occuspan.session import shuffle_partitions
from occuspan.sources import views as V

#: matrices that one pass over the sequences ships (a few kB each); larger collections are scanned in several
MATRIX_BLOCK = 20_000


def log_odds(counts: DataFrame, pseudo: float = 1.0, background: float = 0.25, min_length: int = 4) -> DataFrame:
    """``id, tf, pos, base, lod, ic`` of long-form counts; matrices shorter than ``min_length`` are left out.

    lod = log2((c + pseudo * bg) / (n + pseudo) / bg), with n the position's sum (1 where that is 0); ic is the
    position's information, the sum of p * lod.
    """
    pos = Window.partitionBy("id", "pos")
    n = F.sum("count").over(pos)
    p = (F.col("count") + pseudo * background) / (F.when(n == 0, 1.0).otherwise(n) + pseudo)
    t = counts.withColumn("p", p).withColumn("lod", F.log2(F.col("p") / background)).withColumn("ic", F.sum(F.col("p") * F.col("lod")).over(pos))
    long = F.max("pos").over(Window.partitionBy("id")) + 1
    return t.withColumn("len", long).where(F.col("len") >= min_length).select("id", "tf", "pos", "base", "lod", "ic", "len")


def matrices(lod: DataFrame) -> Iterator[list[tuple[str, str, np.ndarray, np.ndarray]]]:
    """(id, name, length x 4 scores, information) of the matrices, in lists of at most ``MATRIX_BLOCK``, one list at a time."""
    rows = lod.groupBy("id", "tf").agg(F.sort_array(F.collect_list(F.struct("pos", "base", "lod", "ic"))).alias("m")).orderBy("id", "tf")
    out = []
    for r in rows.toLocalIterator():
        n = max(x["pos"] for x in r["m"]) + 1
        a, ic = np.zeros((n, 4)), np.zeros(n)
        for x in r["m"]:
            a[x["pos"], "ACGT".index(x["base"])] = x["lod"]
            ic[x["pos"]] = x["ic"]
        out.append((r["id"], r["tf"], a, ic))
        if len(out) == MATRIX_BLOCK:
            yield out
            out = []
    yield out


_CODE = np.full(256, -1, dtype=np.int64)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i


class Batch:
    """Coded sequences side by side, each followed by a letter that no matrix matches."""

    def __init__(self, seqs: list[str]):
        self.size = np.array([len(x) for x in seqs], dtype=np.int64)
        self.code = _CODE[np.frombuffer("".join(x + "." for x in seqs).encode("latin1", "replace"), dtype=np.uint8)]
        self.start = np.r_[0, np.cumsum(self.size + 1)[:-1]] if len(seqs) else np.empty(0, np.int64)

    def best(self, lod: np.ndarray, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(score, offset) of the best window of every sequence, the first or the last of equals; -inf where none fits. Windows with an unknown base don't count."""
        n = len(self.code)
        wide = np.c_[lod, np.full(len(lod), -np.inf)]  # code -1 is the last column
        s = np.full(n, -np.inf)
        m = n - len(lod) + 1
        if m > 0:
            total = np.zeros(m)
            for j, row in enumerate(wide):
                total += row[self.code[j : j + m]]
            # rounded, so that sums of the same terms in another order are equal
            s[:m] = total.round(9)
        top = np.maximum.reduceat(s, self.start)
        at = np.flatnonzero(s == np.repeat(top, self.size + 1))
        owner = np.searchsorted(self.start, at, "right") - 1
        pick = np.searchsorted(owner, np.arange(len(top)), "right") - 1 if last else np.searchsorted(owner, np.arange(len(top)), "left")
        return top, at[pick] - self.start


def scan(seqs: DataFrame, key: str, seq: str, pwms, top: int | None = None, sensitivity: str | None = None) -> DataFrame:
    """``key, id, tf, strand, offset, score, score_norm, concordance`` of each sequence and matrix that fits on it.

    The plus strand wins ties. ``score_norm`` places the score between the matrix's least and greatest sums; with a
    ``sensitivity`` column (array<double> along the sequence) concordance is its correlation with the matrix's
    information at the match. ``top`` keeps the best by norm, then concordance (unknown last), then id. Null sequences
    and those shorter than five bases have none; ``key`` names a sequence, so rows of one key are one.

    A batch of sequences is scored against a matrix at once, on both strands. ``pwms`` yields lists of matrices; each
    list is one pass over the sequences.
    """
    kind = {f.name: f.dataType.simpleString() for f in seqs.schema}[key]
    cols = [F.col(f"`{key}`").alias("k"), F.col(f"`{seq}`").alias("s")] + ([F.col(f"`{sensitivity}`").alias("v")] if sensitivity else [])
    names = ["key", "id", "tf", "strand", "offset", "score", "score_norm", "concordance"]
    # sequences are short beside the work on them, so they are dealt out by number
    src = seqs.select(*cols).where(F.length("s") >= 5).repartition(shuffle_partitions(seqs.sparkSession))
    out, passes = None, 0
    for block in pwms:
        shipped = seqs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shipped=shipped):
            for pdf in batches:
                b = Batch(pdf["s"].tolist())
                parts = []
                for i, t, a, ic in shipped.value if len(pdf) else ():
                    hi, lo = a.max(axis=1).sum(), a.min(axis=1).sum()
                    plus, at = b.best(a)
                    # the other strand's first window is this strand's last
                    minus, back = b.best(a[::-1, ::-1], last=True)
                    fwd = plus >= minus
                    score, off = np.where(fwd, plus, minus), np.where(fwd, at, b.size - len(a) - back)
                    fits = np.flatnonzero(np.isfinite(score))
                    conc: list[float | None] = [None] * len(fits)
                    if "v" in pdf:
                        for n, j in enumerate(fits):
                            v = pdf["v"].iloc[j]
                            if v is not None and len(v) >= off[j] + len(a):
                                seg, inf = np.asarray(v, float)[off[j] : off[j] + len(a)], ic if fwd[j] else ic[::-1]
                                if seg.std() > 0 and inf.std() > 0:
                                    conc[n] = float(np.corrcoef(inf, seg)[0, 1])
                    norm = (score[fits] - lo) / (hi - lo) if hi > lo else np.zeros(len(fits))
                    parts.append(pd.DataFrame({"key": pdf["k"].to_numpy()[fits], "id": i, "tf": t, "strand": np.where(fwd[fits], "+", "-"), "offset": off[fits], "score": score[fits], "score_norm": norm, "concordance": pd.array(conc, dtype="Float64")}))
                if not parts:
                    continue
                got = pd.concat(parts)
                if top is not None:
                    got = got.assign(_c=got["concordance"].fillna(-1)).sort_values(["key", "score_norm", "_c", "id"], ascending=[True, False, False, True], kind="stable").groupby("key", sort=False).head(top)
                yield got[names]

        part = src.mapInPandas(run, f"key {kind}, id string, tf string, strand string, offset int, score double, score_norm double, concordance double")
        out = part if out is None else out.unionByName(part)
        passes += 1
    if top is not None and passes > 1:
        rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score_norm"), F.desc(F.coalesce("concordance", F.lit(-1.0))), "id"))
        out = out.withColumn("_r", rank).where(F.col("_r") <= top).drop("_r")
    return out.withColumnRenamed("key", key)


#: three small matrices of the queries: the consensus and the count of its base at each position, other bases 2
DEMO = (("M1", "demo_a", "TGACTCA", 20), ("M2", "demo_b", "GGGCGG", 14), ("M3", "demo_c", "CACGTG", 9))


def demo_counts(spark) -> DataFrame:
    rows = [(i, t, p, b, float(n if b == c else 2)) for i, t, s, n in DEMO for p, c in enumerate(s) for b in "ACGT"]
    return spark.createDataFrame(rows, "id string, tf string, pos int, base string, count double")


#: a collection of the size of the public ones, made by a rule
RULE_MATRICES = 800


def rule_counts(spark) -> DataFrame:
    """Counts of ``RULE_MATRICES`` matrices of 6 to 17 positions, each cell from a digest of its matrix, position and base."""
    m = spark.range(RULE_MATRICES).select(F.format_string("R%04d", "id").alias("id"), F.explode(F.sequence(F.lit(0), 5 + F.pmod("id", F.lit(12)).cast("int"))).alias("pos"))
    x = m.select("id", F.concat(F.lit("rule_"), "id").alias("tf"), "pos", F.explode(F.array(*map(F.lit, "ACGT"))).alias("base"))
    byte = F.conv(F.substring(F.md5(F.concat_ws("/", "id", F.col("pos").cast("string"), "base")), 1, 2), 16, 10).cast("int")
    # a cell in four stands out, as the base that a position asks for does
    return x.withColumn("count", F.when(byte < 64, byte + 40.0).otherwise(F.pmod(byte, F.lit(7)).cast("double")))


def pwm_load(spark, d):
    """Log-odds and information of a whole collection."""
    return log_odds(rule_counts(spark)).select("id", "pos", "base", F.round("lod", 9).alias("lod"), F.round("ic", 9).alias("ic"))


def pwm_scan(spark, d):
    """Best placement of each matrix on every different call sequence, of any length that the matrix fits."""
    seqs = V.cluster_rows(spark, d).where("ref_sequence is not null").select("ref_sequence").distinct()
    return scan(seqs, "ref_sequence", "ref_sequence", matrices(log_odds(demo_counts(spark)))).select("ref_sequence", "id", "strand", (F.round("score", 6) + 0.0).alias("score"), (F.round("score_norm", 6) + 0.0).alias("score_norm"))


def tf_candidates(spark, d):
    """The best two matrices of the rule's collection for each motif, with their fit to the motif's base sensitivity."""
    c = M.annotated(spark, d)
    mo = M._motifs(c)
    sens = M.sensitivity(mo, M.motif_calls(c, M.CFG))
    per = sens.groupBy("library", "bin", "start", "rel_pos").agg(F.sum(F.col("n") * F.abs("mean_delta")).alias("x"))
    full = mo.withColumn("rel_pos", F.explode(F.sequence(F.lit(0), (F.col("end") - F.col("start")).cast("int")))).join(per, ["library", "bin", "start", "rel_pos"], "left")
    v = full.groupBy("library", "bin", "start", "end").agg(F.transform(F.array_sort(F.collect_list(F.struct("rel_pos", F.coalesce("x", F.lit(0.0)).alias("x")))), lambda z: z["x"]).alias("v"))
    # the motif's bases come from a call that spans it
    from occuspan.operators.joins import overlap_join

    calls = c.where("ref_sequence is not null and length(ref_sequence) = width").select("library", "bin", "abs_start", "abs_end", "ref_sequence", "cluster_id")
    span = overlap_join(v, calls, ["library", "bin"], ("start", "end"), ("abs_start", "abs_end")).where("b_abs_start <= start and b_abs_end >= end")
    seq = span.groupBy("library", "bin", "start", "end", "v").agg(F.min_by(F.struct("b_abs_start", "b_ref_sequence"), "b_cluster_id").alias("c"))
    s = seq.select(F.concat_ws(":", "library", "bin", "start", "end").alias("motif"), F.expr("substring(c.b_ref_sequence, int(start - c.b_abs_start + 1), int(end - start + 1))").alias("seq"), "v")
    out = scan(s, "motif", "seq", matrices(log_odds(rule_counts(spark))), top=2, sensitivity="v")
    return out.select("motif", "id", "tf", "strand", "offset", F.round("score", 3).alias("score"), F.round("score_norm", 4).alias("score_norm"), F.round("concordance", 4).alias("concordance"))


QUERIES = {"pwm_load": pwm_load, "pwm_scan": pwm_scan, "tf_candidates": tf_candidates}

_PW = "m(id, s, k) as (values " + ", ".join(f"('{i}', '{s}', {n})" for i, _, s, n in DEMO) + """),
cnt as (select id, length(s) as len, p - 1 as pos, b as base, case when substr(s, p, 1) = b then k else 2 end as c, k + 6 as n
  from m, lateral (select unnest(range(1, length(s) + 1)) as p), (select unnest(['A', 'C', 'G', 'T']) as b)),
lod as (select id, len, pos, base, (c + 0.25) / (n + 1) as pr, log2((c + 0.25) / (n + 1) / 0.25) as lod from cnt)"""

ORACLES = {
    "pwm_load": f"""
with m as (select printf('R%04d', i) as id, i, unnest(range(0, 6 + i % 12)) as pos from range({RULE_MATRICES}) t(i)),
x as (select id, cast(pos as int) as pos, unnest(['A', 'C', 'G', 'T']) as base from m),
y as (select *, cast(concat('0x', substr(md5(concat(id, '/', pos, '/', base)), 1, 2)) as int) as byte from x),
c as (select id, pos, base, case when byte < 64 then byte + 40.0 else byte % 7 end as c from y),
n as (select *, sum(c) over (partition by id, pos) as n from c),
p as (select *, (c + 0.25) / (case when n = 0 then 1 else n end + 1) as pr from n)
select id, pos, base, round(log2(pr / 0.25), 9) as lod, round(sum(pr * log2(pr / 0.25)) over (partition by id, pos), 9) as ic from p""",
    "pwm_scan": V.sql(
        "cluster_rows",
        f"""with {_PW},
q as (select distinct ref_sequence as s0 from cluster_rows where ref_sequence is not null and length(ref_sequence) >= 5),
st as (select s0, '+' as strand, upper(s0) as s from q union all select s0, '-', reverse(translate(upper(s0), 'ACGT', 'TGCA')) from q),
mm as (select distinct id, len from lod),
w as (select s0, strand, id, len, o, substr(s, cast(o + 1 as bigint), cast(len as bigint)) as win from st, mm, lateral (select unnest(range(0, greatest(length(s) - len + 1, 0))) as o)),
sc as (select w.s0, w.strand, w.id, w.o, sum(lod) as score from w join lod l on l.id = w.id and l.base = substr(win, cast(pos + 1 as bigint), 1) where regexp_full_match(win, '[ACGT]+') group by 1, 2, 3, 4),
best as (select *, row_number() over (partition by s0, id order by round(score, 9) desc, strand, o) as k from sc),
ex as (select id, sum(hi) as hi, sum(lo) as lo from (select id, pos, max(lod) as hi, min(lod) as lo from lod group by 1, 2) group by 1)
select s0 as ref_sequence, id, strand, round(score, 6) + 0.0 as score, round((score - lo) / (hi - lo), 6) + 0.0 as score_norm from best join ex using (id) where k = 1""",
    ),
}
