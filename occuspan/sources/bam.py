"""BAM files as a Spark data source (``spark.read.format("bam")``), with the standard library alone.

A file with a ``.bai`` index is split at record starts that the index names; without one it is a single partition.
Reads stream block by block, so memory doesn't depend on the file. Schema: :data:`SCHEMA`.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = (
    "file string, ordinal bigint, read_id string, flag int, rname string, ref_start int, ref_end int, mapq int, "
    "cigar array<struct<op:int,len:int>>, seq string, qual array<int>, tags map<string,string>"
)

#: fixed values: base letters of the packed sequence, and letters of the alignment operations that advance the reference
_BASES = "=ACMGRSVTWYHKDBN"
_REF_OPS = {0, 2, 3, 7, 8}


class Bgzf:
    """Sequential reader of a block-compressed file from a virtual offset (block start << 16 | place in block)."""

    def __init__(self, path: str, voffset: int = 0):
        self.f = open(path, "rb")
        self.next = voffset >> 16
        self.buf, self.at, self.start = b"", 0, self.next
        if self._block():
            self.at = voffset & 0xFFFF

    def _block(self) -> bool:
        self.f.seek(self.next)
        head = self.f.read(12)
        if len(head) < 12:
            return False
        if head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a block-compressed file")
        xlen = struct.unpack("<H", head[10:12])[0]
        extra, size, p = self.f.read(xlen), 0, 0
        while p + 4 <= xlen:
            n = struct.unpack("<H", extra[p + 2 : p + 4])[0]
            if extra[p : p + 2] == b"BC":
                size = struct.unpack("<H", extra[p + 4 : p + 6])[0] + 1
            p += 4 + n
        data = self.f.read(size - 12 - xlen)
        self.start, self.next = self.next, self.next + size
        self.buf, self.at = zlib.decompress(data[:-8], -15), 0
        return True

    def voffset(self) -> int:
        if self.at >= len(self.buf):
            return self.next << 16
        return self.start << 16 | self.at

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.at >= len(self.buf) and not self._block():
                break
            take = self.buf[self.at : self.at + n - len(out)]
            self.at += len(take)
            out += take
        return out

    def close(self) -> None:
        self.f.close()


def read_header(path: str) -> tuple[str, list[tuple[str, int]], int]:
    """Header text, contigs with their lengths, and the virtual offset of the first record."""
    z = Bgzf(path)
    try:
        if z.read(4) != b"BAM\x01":
            raise ValueError(f"{path} is no BAM file")
        text = z.read(struct.unpack("<i", z.read(4))[0]).rstrip(b"\0").decode("utf-8", "replace")
        contigs = []
        for _ in range(struct.unpack("<i", z.read(4))[0]):
            name = z.read(struct.unpack("<i", z.read(4))[0]).rstrip(b"\0").decode()
            contigs.append((name, struct.unpack("<i", z.read(4))[0]))
        return text, contigs, z.voffset()
    finally:
        z.close()


class Index:
    """What a ``.bai`` index says: record starts, the first record of each 16 kb window of a contig, and read counts."""

    def __init__(self, data: bytes):
        self.starts: list[int] = []
        self.windows: list[list[int]] = []
        self.counts: list[tuple[int, int]] = []
        at, out = 8, set()
        for _ in range(struct.unpack_from("<i", data, 4)[0]):
            n, count = struct.unpack_from("<i", data, at)[0], (0, 0)
            at += 4
            for _ in range(n):
                number, chunks = struct.unpack_from("<Ii", data, at)
                at += 8
                if number == 37450:  # the pseudo-bin holds counts in the place of its second chunk
                    count = struct.unpack_from("<QQ", data, at + 16)
                else:
                    out.update(struct.unpack_from("<Q", data, at + 16 * i)[0] for i in range(chunks))
                at += 16 * chunks
            n = struct.unpack_from("<i", data, at)[0]
            at += 4
            linear = list(struct.unpack_from(f"<{n}Q", data, at))
            out.update(v for v in linear if v)
            at += 8 * n
            self.windows.append(linear)
            self.counts.append(count)
        self.unplaced = struct.unpack_from("<Q", data, at)[0] if len(data) >= at + 8 else 0
        self.starts = sorted(out)

    def start_of(self, contig: int, position: int) -> int | None:
        """Virtual offset from which every record that overlaps ``position`` or later of a contig follows; None where it has none."""
        w = self.windows[contig] if contig < len(self.windows) else []
        at = position >> 14
        return next((v for v in w[at:] if v), None) if at < len(w) else None


def index_of(path: str) -> Index | None:
    """The index beside a file; None without one."""
    for p in (path + ".bai", os.path.splitext(path)[0] + ".bai"):
        if os.path.exists(p):
            with open(p, "rb") as f:
                data = f.read()
            return Index(data) if data[:4] == b"BAI\x01" else None
    return None


def index_starts(path: str) -> list[int]:
    """Virtual offsets of record starts that a ``.bai`` index names, sorted; none without an index."""
    i = index_of(path)
    return i.starts if i else []


def index_counts(spark: SparkSession, path: str):
    """``rname, mapped, unmapped`` of each contig by the index alone, and of reads without a contig under null; no rows without an index."""
    i, kind = index_of(path), "rname string, mapped long, unmapped long"
    if not i:
        return spark.createDataFrame([], kind)
    names = [n for n, _ in read_header(path)[1]]
    return spark.createDataFrame([(n, *map(int, c)) for n, c in zip(names, i.counts)] + [(None, 0, i.unplaced)], kind)


def bytes_array(b: bytes) -> list[int]:
    """Integers of a tag stored as plain bytes: the widest unsigned width that fits and gives no value of 100,000 or more, else signed words."""
    if not b:
        return []
    for size, kind in ((4, "I"), (2, "H")):
        if len(b) % size == 0:
            v = struct.unpack(f"<{len(b) // size}{kind}", b)
            if max(v) < 100_000:
                return list(v)
    if len(b) % 4:
        raise ValueError(f"no array of integers: {len(b)} bytes")
    return list(struct.unpack(f"<{len(b) // 4}i", b))


def _tags(b: bytes) -> dict[str, str]:
    """Tags as text: arrays joined by commas, bytes in hexadecimal kept as they are."""
    size = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
    out, at = {}, 0
    while at + 3 <= len(b):
        name, kind = b[at : at + 2].decode("latin1"), chr(b[at + 2])
        at += 3
        if kind in "ZH":
            end = b.index(b"\0", at)
            out[name], at = b[at:end].decode("utf-8", "replace"), end + 1
        elif kind == "B":
            sub, n = chr(b[at]), struct.unpack_from("<i", b, at + 1)[0]
            f = f"<{n}{size[sub]}"
            out[name] = ",".join(map(str, struct.unpack_from(f, b, at + 5)))
            at += 5 + struct.calcsize(f)
        else:
            v = struct.unpack_from("<" + size[kind], b, at)[0]
            out[name] = v.decode("latin1") if kind == "A" else str(v)
            at += struct.calcsize("<" + size[kind])
    return out


def records(path: str, start: int, stop: int | None, contigs: list[tuple[str, int]]) -> Iterator[tuple]:
    """Rows from one virtual offset up to another, without file and ordinal."""
    z = Bgzf(path, start)
    try:
        while stop is None or z.voffset() < stop:
            size = z.read(4)
            if len(size) < 4:
                return
            b = z.read(struct.unpack("<i", size)[0])
            ref, pos, lname, mapq, _, ncig, flag, lseq = struct.unpack_from("<iiBBHHHi", b)
            at = 32
            name = b[at : at + lname - 1].decode()
            at += lname
            cig = [(v & 15, v >> 4) for v in struct.unpack_from(f"<{ncig}I", b, at)]
            at += 4 * ncig
            packed = b[at : at + (lseq + 1) // 2]
            at += (lseq + 1) // 2
            seq = "".join(_BASES[x >> 4] + _BASES[x & 15] for x in packed)[:lseq]
            q = b[at : at + lseq]
            at += lseq
            qual = None if not lseq or q[0] == 255 else list(q)
            span = sum(n for op, n in cig if op in _REF_OPS)
            mapped = ref >= 0 and not flag & 4
            yield (name, flag, contigs[ref][0] if ref >= 0 else None, pos if pos >= 0 else None, pos + span if mapped and cig else None, mapq, cig or None, seq or None, qual, _tags(b[at:]))
    finally:
        z.close()


class _Part(InputPartition):
    def __init__(self, path: str, start: int, stop: int | None, number: int):
        super().__init__(number)
        self.path, self.start, self.stop, self.number = path, start, stop, number


class BamReader(DataSourceReader):
    """Options: ``path`` (file or folder), ``splitBytes`` (64 MB), and ``contig``, ``start``, ``end`` for an overlap scan.

    Filters on ``rname`` (equality), ``ref_start`` (upper bound) and ``ref_end`` (lower bound) do the same, since
    :func:`register` lets Spark push them; Spark still applies them to the rows. With an index an
    overlap scan begins at the first record that can overlap, and it ends with the first one behind the region.
    """

    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))
        self.contig, self.lo, self.hi = options.get("contig"), options.get("start"), options.get("end")

    def pushFilters(self, filters):
        for f in filters:
            name, v = getattr(f, "attribute", ()), getattr(f, "value", None)
            if isinstance(f, EqualTo) and name == ("rname",):
                self.contig = self.contig or v
            elif isinstance(f, (LessThan, LessThanOrEqual)) and name == ("ref_start",):
                self.hi = min(int(self.hi), v + isinstance(f, LessThanOrEqual)) if self.hi else v + isinstance(f, LessThanOrEqual)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and name == ("ref_end",):
                self.lo = max(int(self.lo or 0), v - isinstance(f, GreaterThanOrEqual))
            yield f  # positions without a contig, and rows without an end, are left to Spark

    def partitions(self):
        files = sorted(os.path.join(self.path, f) for f in os.listdir(self.path) if f.endswith(".bam")) if os.path.isdir(self.path) else [self.path]
        parts = []
        for f in files:
            _, contigs, first = read_header(f)
            index = index_of(f)
            if index and self.contig:
                at = next((i for i, (n, _) in enumerate(contigs) if n == self.contig), None)
                first = None if at is None else index.start_of(at, int(self.lo or 0))
                if first is None:
                    continue
            cuts = [first]
            for v in index.starts if index else ():
                if v > first and (v >> 16) - (cuts[-1] >> 16) >= self.split:
                    cuts.append(v)
            for a, b in zip(cuts, [*cuts[1:], None]):
                parts.append(_Part(f, a, b, len(parts)))
        return parts or [_Part("", 0, 0, 0)]

    def read(self, part):
        if not part.path:
            return
        contigs = read_header(part.path)[1]
        lo, hi = int(self.lo or 0), int(self.hi) if self.hi else None
        order = {n: i for i, (n, _) in enumerate(contigs)}
        wanted = order.get(self.contig) if self.contig and index_of(part.path) else None
        for i, r in enumerate(records(part.path, part.start, part.stop, contigs)):
            if wanted is not None and (r[2] is None or order[r[2]] > wanted or (hi is not None and r[2] == self.contig and r[3] >= hi)):
                return  # an indexed file is sorted
            if self.contig and (r[2] != self.contig or r[3] is None or (hi is not None and r[3] >= hi) or (r[4] or r[3] + 1) <= lo):
                continue
            # the ordinal follows the file: the record's block, then its number in the partition
            yield (part.path, (part.number << 40) + i, *r)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return BamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("bam")`` known, and lets Spark push filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)


def contigs_of(spark: SparkSession, path: str):
    """``rname, ref_len`` of a BAM header (configuration size)."""
    return spark.createDataFrame(read_header(path)[1] or [], "rname string, ref_len int")


def target_contig(contigs: list[tuple[str, int]], wanted: str | None = None) -> str:
    """The named contig, or the only one; anything else is an error."""
    names = [n for n, _ in contigs]
    if wanted is not None:
        if wanted not in names:
            raise ValueError(f"no contig {wanted}")
        return wanted
    if len(names) != 1:
        raise ValueError("name one of the contigs: " + ", ".join(names))
    return names[0]


def reference_path(header: str) -> str | None:
    """The sequence file in an aligner's program line: its first argument that is no flag and ends like one."""
    for line in header.split("\n"):
        if not line.startswith("@PG"):
            continue
        f = dict(x.split(":", 1) for x in line.split("\t")[1:] if ":" in x)
        if any(a in (f.get("PN", "") + " " + f.get("ID", "")).lower() for a in ("pbmm2", "minimap2", "bwa", "bowtie")):
            for arg in f.get("CL", "").split():
                if not arg.startswith("-") and arg.removesuffix(".gz").endswith((".fa", ".fasta", ".fna")):
                    return arg
    return None
