import random
import struct
import zlib

from pyspark.sql import functions as F

from occuspan.functions import tags
from occuspan.operators import alignment, barcode_clusters, calling
from occuspan.plans import pipeline
from occuspan.sources import bam, sequences


def walk(r, ref, ps, pe, bs, be, minq):
    """The caller's rule, one base at a time."""
    q, p, ids, spots = 0, r["ref_start"], [], []
    if r["ref_start"] > pe or r["ref_end"] <= ps:
        return "no_promoter_coverage", [], []
    for op, n in r["cigar"]:
        if p > max(pe, be):
            break
        if op == 0:
            return "forbidden_cigar", [], []
        if op in (7, 8):
            for k in range(n):
                if op == 8 and ps <= p + k <= pe and p + k - ps < len(ref) and r["qual"][q + k] >= minq:
                    ids.append(f"{p + k + 1}:{ref[p + k - ps]}>{r['seq'][q + k]}")
                if bs <= p + k < be:
                    spots.append(q + k)
            q, p = q + n, p + n
        elif op == 1:
            if ps <= p <= pe and min(r["qual"][q : q + n]) >= minq:
                ids.append(f"{p + 1}:+{r['seq'][q : q + n]}")
            q += n
        elif op == 2:
            a, b = max(p, ps), min(p + n, pe + 1)
            if a < b:
                ids.append(f"{a + 1}:{b - a}{ref[a - ps : b - ps]}")
            p += n
        elif op == 3:
            p += n
        elif op == 4:
            q += n
    return "pass", ids, spots


def test_calls_and_barcodes_against_a_walk(spark):
    g = random.Random(4)
    ref = "".join(g.choice("ACGT") for _ in range(41))
    reads = []
    for i in range(300):
        cig = [(g.choice([7, 7, 7, 8, 1, 2, 4, 3] + [0] * (i % 25 == 0)), g.randrange(1, 9)) for _ in range(g.randrange(1, 14))]
        n = sum(k for op, k in cig if op in (0, 1, 4, 7, 8))
        span = sum(k for op, k in cig if op in (0, 2, 3, 7, 8))
        start = g.randrange(0, 40)
        reads.append({"read_id": i, "ref_start": start, "ref_end": start + span, "cigar": cig, "seq": "".join(g.choice("ACGT") for _ in range(n)), "qual": [g.randrange(40) for _ in range(n)]})
    df = spark.createDataFrame([tuple(r.values()) for r in reads], "read_id int, ref_start int, ref_end int, cigar array<struct<op:int,len:int>>, seq string, qual array<int>")
    got = {r.read_id: r for r in calling.call_variants(df, ref, (20, 60), (40, 55), 15, (5, 12)).collect()}
    for r in reads:
        status, ids, spots = walk(r, ref, 20, 60, 40, 55, 15)
        x = got[r["read_id"]]
        assert (x.status, list(x.var_ids)) == (status, ids)
        if status == "pass" and 5 <= len(spots) <= 12:
            assert x.barcode == "".join(r["seq"][p] for p in spots)
            assert abs(x.barcode_qual - sum(r["qual"][p] for p in spots) / len(spots)) < 1e-9
        else:
            assert x.barcode is None


def lev(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        p, d[0] = d[0], i + 1
        for j, y in enumerate(b):
            p, d[j + 1] = d[j + 1], min(d[j + 1] + 1, d[j] + 1, p + (x != y))
    return d[-1]


def test_pairs_neighbours_and_greedy_clusters(spark):
    g = random.Random(2)
    base = ["".join(g.choice("ACGT") for _ in range(12)) for _ in range(12)]
    bcs = set(base)
    for b in base:
        for _ in range(6):
            s = list(b)
            for _ in range(g.randrange(1, 3)):
                k = g.randrange(len(s))
                s[k : k + 1] = g.choice([[g.choice("ACGT")], [], [s[k], g.choice("ACGT")]])
            bcs.add("".join(s))
    bcs = sorted(bcs)
    df = spark.createDataFrame([(b, g.randrange(1, 30), i, g.choice([[], ["1:A>C"], ["1:A>C", "2:G>T"]])) for i, b in enumerate(bcs)], "barcode string, reads long, first long, ids array<string>")
    pairs = {(r.a, r.b, r.dist) for r in calling.levenshtein_pairs(df).collect()}
    assert pairs == {(a, b, lev(a, b)) for a in bcs for b in bcs if a < b and lev(a, b) <= 2}
    nb = {r.barcode: set(r.n) for r in df.select("barcode", calling.d1_neighbours(F.col("barcode")).alias("n")).limit(5).collect()}
    for b, n in nb.items():
        assert all(lev(b, x) == 1 for x in n) and b not in n
    rows = sorted(df.collect(), key=lambda r: (-r.reads, r.first))
    heads, want = [], {}

    def agree(x, y):
        x, y = set(x), set(y)
        return not x and not y or bool(x and y and len(x & y) / len(x | y) >= 0.5)

    for r in rows:
        reach = 2 if len(r.barcode) >= 12 else 1
        near = [h for h in heads if lev(h.barcode, r.barcode) <= 1]
        pick = near[0] if near and agree(near[0].ids, r.ids) else next((h for h in heads if lev(h.barcode, r.barcode) <= reach and agree(h.ids, r.ids)), None)
        want[r.barcode] = (pick or r).barcode
        if pick is None:
            heads.append(r)
    assert {r.barcode: r.centroid for r in barcode_clusters.cluster(df, expected=12).collect()} == want


def test_deletion_keys_are_never_broadcast(spark, sf):
    """Spark takes the keys to be as few as the barcodes, so by its estimate it would send them to the driver."""
    plan = calling.barcode_levenshtein_pairs(spark, sf)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_clusters_broadcast_nothing(spark, sf, monkeypatch):
    """Neither the table of barcodes nor any round's join sends rows to the driver."""
    plans, write = [], barcode_clusters.written

    def seen(df):
        out = write(df)
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(barcode_clusters, "written", seen)
    assert barcode_clusters.barcode_clusters(spark, sf).count() > 0
    assert len(plans) > 3 and any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_clusters_meet_keys_without_a_broadcast(spark, sf):
    plan = barcode_clusters.candidates(barcode_clusters.barcode_table(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and "BroadcastHashJoin [key" not in plan


def write_bam(path, contigs, reads, block=300):
    raw = b"BAM\x01" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", len(contigs))
    for n, k in contigs:
        raw += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k)
    for name, flag, ref, pos, cig, seq, qual, extra in reads:
        code = {b: i for i, b in enumerate("=ACMGRSVTWYHKDBN")}
        s = [code[c] for c in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(cig), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | op) for op, n in cig) + bytes(a << 4 | b for a, b in zip(s[::2], s[1::2])) + bytes(qual) + extra
        raw += struct.pack("<i", len(body)) + body
    with open(path, "wb") as f:
        for i in [*range(0, len(raw), block), None]:
            data = raw[i : i + block] if i is not None else b""
            c = zlib.compressobj(6, zlib.DEFLATED, -15)
            z = c.compress(data) + c.flush()
            f.write(b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H", 6) + b"BC\x02\0" + struct.pack("<H", len(z) + 25) + z + struct.pack("<II", zlib.crc32(data), len(data)))


def test_bam_source(spark, tmp_path):
    g = random.Random(3)
    reads = []
    for i in range(40):
        seq = "".join(g.choice("ACGT") for _ in range(g.randrange(5, 60)))
        tag = b"ncC" + bytes([i]) + b"MAZ" + b"40;nuc+Q:1-5\0" + b"nsBi" + struct.pack("<iii", 2, 1, 2)
        reads.append((f"r{i}", 4 if i == 7 else 0, -1 if i == 7 else i % 2, -1 if i == 7 else i, [(7, len(seq) - 2), (4, 2)], seq, [g.randrange(40) for _ in seq], tag))
    p = str(tmp_path / "a.bam")
    write_bam(p, [("c0", 500), ("c1", 600)], reads)
    bam.register(spark)
    got = {r.read_id: r for r in spark.read.format("bam").load(p).collect()}
    assert len(got) == 40
    for name, flag, ref, pos, cig, seq, qual, _ in reads:
        r = got[name]
        assert (r.flag, r.seq, list(r.qual), [tuple(c) for c in r.cigar]) == (flag, seq, qual, cig)
        assert r.rname == (None if ref < 0 else f"c{ref}")
        assert r.tags["nc"] == str(int(name[1:])) and r.tags["ns"] == "1,2" and r.tags["MA"] == "40;nuc+Q:1-5"
    few = spark.read.format("bam").option("contig", "c1").option("start", 10).option("end", 20).load(p)
    assert {r.read_id for r in few.collect()} == {n for n, _, ref, pos, cig, *_ in reads if ref == 1 and pos < 20 and pos + cig[0][1] > 10}
    assert bam.target_contig(bam.read_header(p)[1], "c0") == "c0"
    assert bam.reference_path("@PG\tID:x\tPN:pbmm2\tCL:pbmm2 align -j 4 /d/ref.fa in.bam") == "/d/ref.fa"


def index_bam(path, reads, contigs, block=300):
    """An index of a sorted file as ``write_bam`` makes it: one bin and the windows of each contig."""
    raw_at, at = [], 4 + 4 + 4 + 4 + sum(4 + len(n) + 1 + 4 for n, _ in contigs)
    for name, flag, ref, pos, cig, seq, qual, extra in reads:
        raw_at.append(at)
        at += 4 + 32 + len(name) + 1 + 4 * len(cig) + (len(seq) + 1) // 2 + len(qual) + len(extra)
    starts, data = [], open(path, "rb").read()
    place = 0
    while place < len(data):
        starts.append(place)
        place += struct.unpack_from("<H", data, place + 16)[0] + 1
    off = lambda x: starts[x // block] << 16 | x % block
    out = b"BAI\x01" + struct.pack("<i", len(contigs))
    for c in range(len(contigs)):
        mine = [(r[3], a) for r, a in zip(reads, raw_at) if r[2] == c]
        out += struct.pack("<i", 2) + struct.pack("<Ii", 4681, 1) + struct.pack("<QQ", off(mine[0][1]), off(mine[-1][1]))
        out += struct.pack("<Ii", 37450, 2) + struct.pack("<QQQQ", 0, 0, len(mine), 0)
        windows = {}
        for pos, a in mine:
            for w in (pos >> 14, pos + 30 >> 14):
                windows.setdefault(w, off(a))
        n = max(windows) + 1
        out += struct.pack("<i", n) + struct.pack(f"<{n}Q", *(windows.get(w, 0) for w in range(n)))
    with open(path + ".bai", "wb") as f:
        f.write(out + struct.pack("<Q", 3))


def test_region_scans_by_index(spark, tmp_path):
    g = random.Random(8)
    contigs = [("c0", 90000), ("c1", 90000)]
    reads = []
    for i, (ref, pos) in enumerate(sorted((g.randrange(2), g.randrange(80000)) for _ in range(400))):
        seq = "".join(g.choice("ACGT") for _ in range(30))
        reads.append((f"r{i}", 0, ref, pos, [(7, 30)], seq, [30] * 30, b"MMZ" + b"A+a,1,2;T-a,0;C+m,3;\0"))
    p = str(tmp_path / "s.bam")
    write_bam(p, contigs, reads)
    index_bam(p, reads, contigs)
    bam.register(spark)
    want = {n for n, _, ref, pos, *_ in reads if ref == 1 and pos < 41000 and pos + 30 > 40000}
    assert want and {r.read_id for r in spark.read.format("bam").option("contig", "c1").option("start", 40000).option("end", 41000).load(p).collect()} == want
    reader = bam.BamReader({"path": p, "contig": "c1", "start": "40000", "end": "41000", "splitbytes": "2000"})
    parts = reader.partitions()
    seen = sum(1 for part in parts for _ in bam.records(p, part.start, part.stop, contigs))
    assert parts[0].start >= bam.index_of(p).start_of(1, 40000) and seen < 200 and {r[2] for part in parts for r in reader.read(part)} == want
    df = spark.read.format("bam").load(p).where("rname = 'c1' and ref_start < 41000 and ref_end > 40000")
    assert {r.read_id for r in df.collect()} == want
    assert {(r.rname, r.mapped, r.unmapped) for r in bam.index_counts(spark, p).collect()} == {("c0", sum(r[2] == 0 for r in reads), 0), ("c1", sum(r[2] == 1 for r in reads), 0), (None, 0, 3)}
    # methylation of real records: three adenine calls of each read over its A and T bases
    m = {r.read_id: r.m6a for r in alignment.with_methylation(spark.read.format("bam").load(p)).collect()}
    assert all(abs(m[n] - 3 / (seq.count("A") + seq.count("T"))) < 1e-12 for n, _, _, _, _, seq, *_ in reads)
    kept, fates = pipeline.filter_reads(spark.read.format("bam").load(p), bam.contigs_of(spark, p), m6a_range=(0.0, 0.2), length_slack=(10**6, 10**6))
    assert {r.disposition: r.n for r in fates.collect()}["methylation"] == sum(v > 0.2 for v in m.values()) > 0


def test_footprints_follow_the_alignment(spark):
    """Against a walk over the bases, for clips, insertions, deletions and both kinds of tags."""
    g = random.Random(9)
    rows, want = [], set()
    for i in range(200):
        cig = [(g.choice([4, 7, 7, 8, 1, 2, 3, 0]), g.randrange(1, 12)) for _ in range(g.randrange(1, 9))]
        start, q, r, to = g.randrange(50), 0, 0, {}
        r = start
        for op, n in cig:
            for _ in range(n):
                if op in (0, 7, 8):
                    to[q] = r
                q += op in (0, 1, 4, 7, 8)
                r += op in (0, 2, 3, 7, 8)
        segs = [(g.choice(["nuc", "tf"]), g.randrange(0, 40), g.randrange(1, 30)) for _ in range(3)]
        by = {t: [(s, n) for x, s, n in segs if x == t] for t in {x for x, *_ in segs}}
        if i % 3:
            t = {"MA": "500;" + ";".join(f"{t}+Q:" + ",".join(f"{s + 1}-{n}" for s, n in v) for t, v in by.items())}
        else:
            by = {"nuc": by.get("nuc", []), "msp": by.get("tf", [])}
            t = {a: ",".join(str(x[j]) for x in by[k]) for k, pair in (("nuc", ("ns", "nl")), ("msp", ("as", "al"))) for j, a in enumerate(pair)}
        rows.append((i, start, cig, t))
        want |= {(i, k, n, to[x]) for k, v in by.items() for s, n in v for x in range(s, s + n) if x in to}
    rows += [(900, 0, None, {"MA": "9;nuc:1-5"}), (901, 0, [(7, 9)], {}), (902, None, None, None)]
    df = spark.createDataFrame(rows, "read_id int, ref_start int, cigar array<struct<op:int,len:int>>, tags map<string,string>")
    got = alignment.footprints(df).collect()
    assert {(r.read_id, r.track, r.length, x) for r in got for x in range(r.r_start, r.r_end)} == want


def test_small_readers():
    assert bam.bytes_array(b"") == [] and bam.bytes_array(struct.pack("<3I", 5, 70000, 9)) == [5, 70000, 9]
    assert bam.bytes_array(struct.pack("<3H", 1, 2, 65535)) == [1, 2, 65535] and bam.bytes_array(struct.pack("<2i", -1, -2)) == [65535, 65535, 65534, 65535]


def test_text_sources(spark, tmp_path):
    fa = tmp_path / "x.fa"
    fa.write_text(">chr1 one\nACGT\nac\n>chrUn_2\nAAA\n>p\nG\n")
    assert {tuple(r) for r in sequences.fasta_lengths(spark, str(fa)).collect()} == {("chr1", 6), ("p", 1)}
    assert sequences.fasta_sequence(spark, str(fa), "chr1") == "ACGTAC" and sequences.fasta_sequence(spark, str(fa), "z") is None
    j = tmp_path / "m.jaspar"
    j.write_text(">MA1 Arnt\nA [ 4 19 ]\nC [ 16 0 ]\nG [ 0 1 ]\nT [ 0 0 ]\n>MA2 X\nA [1]\nC [2]\nG [3]\nT [4]\n")
    m = {(r.id, r.tf, r.pos, r.base): r["count"] for r in sequences.pwm_jaspar(spark, str(j)).collect()}
    assert len(m) == 12 and m["MA1", "Arnt", 1, "A"] == 19 and m["MA2", "X", 0, "T"] == 4
    h = tmp_path / "h.txt"
    h.write_text(">H1\n1 2 3 4\n5 6 7 8\n")
    assert {(r.pos, r.base): r["count"] for r in sequences.pwm_rows(spark, str(h)).collect()}[1, "G"] == 7
    assert sequences.parse_region("c:1,000-2000") == ("c", 1000, 2000)
    assert sequences.sample_config({"a": 1, "samples": {"s": {"a": 2}}}, "s") == {"a": 2}


def test_tags(spark):
    row = spark.range(1).select(
        tags.parse_ma(F.lit("90;nuc+Q:11-147,x,3-;msp+:;tf+QQQ:1-22;nuc:5-6;bad")).alias("ma"),
        tags.parse_ma(F.lit(None).cast("string")).alias("none"),
        tags.parse_variant_id(F.lit("6120:3ACG")).alias("d"),
        tags.parse_variant_id(F.lit("x")).alias("u"),
        tags.raw_tag(F.array(F.lit("2:A>C"), F.lit("1:+T"))).alias("t"),
        tags.variant_ids(F.lit("oops")).alias("raw"),
        tags.sample_name(F.lit("/a/b.c.sorted.bam")).alias("s"),
        tags.classify_contig(F.lit("CHR22_alt")).alias("k"),
    ).first()
    assert {k: [tuple(x) for x in v] for k, v in row.ma.items()} == {"nuc": [(4, 6)], "msp": [], "tf": [(0, 22)]}
    assert row.none == {} and tuple(row.d) == (6120, "A", "", "del") and tuple(row.u) == (None, None, None, None)
    assert row.t == '["1:+T", "2:A>C"]' and row.raw == ["oops"] and row.s == "b.c" and row.k == "genomic"
