"""Column functions on read tags, variant ids and names. All are built-in expressions, so they stay in codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: contigs of the genome; all others are plasmids, unless skipped
GENOMIC = [*map(str, range(1, 23)), "x", "y", "m", "mt", "ebv"]

#: fixed values: suffixes dropped from a file's name, each once and in this order
SAMPLE_SUFFIXES = (".sorted", ".aligned", ".merged", ".tagged", "_sorted", "_aligned", "_merged", "_tagged", ".plasmid", "_plasmid")


def classify_contig(name: Column) -> Column:
    """``skip``, ``genomic`` or ``plasmid`` by a contig's name; null for null."""
    low = F.lower(name)
    stem = F.regexp_extract(low, r"^chr([^_]+)(_.*)?$", 1)
    return (
        F.when(name.isNull(), F.lit(None).cast("string"))
        .when(low.startswith("chrun") | low.contains("_random"), "skip")
        .when(low.isin(GENOMIC) | stem.isin(GENOMIC), "genomic")
        .otherwise("plasmid")
    )


def parse_ma(ma: Column) -> Column:
    """Tracks of an MA string: map from track to its 0-based starts and lengths.

    Sections without a colon and segments that aren't ``start-length`` are passed over; of equal labels the last
    section counts; a label ends at its quality suffix ``+...``. Null and empty strings give an empty map.
    """
    sections = F.filter(F.slice(F.split(F.coalesce(ma, F.lit("")), ";"), 2, 1 << 20), lambda s: s.contains(":"))
    named = F.transform(sections, lambda s: F.struct(F.element_at(F.split(F.substring_index(s, ":", 1), r"\+"), 1).alias("key"), F.substring(s, F.instr(s, ":") + 1, 1 << 30).alias("body")))
    last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, 1 << 20), lambda later: later["key"] == e["key"]) & (e["key"] != ""))

    def segments(body: Column) -> Column:
        good = F.filter(F.split(body, ","), lambda x: x.rlike(r"^\s*\d+-\d+\s*$"))
        return F.transform(good, lambda x: F.struct((F.trim(F.substring_index(x, "-", 1)).cast("int") - 1).alias("start"), F.trim(F.substring_index(x, "-", -1)).cast("int").alias("length")))

    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], segments(e["body"]).alias("v"))))


def tag_array(text: Column) -> Column:
    """Integers of a comma-separated tag; blanks are passed over."""
    return F.transform(F.filter(F.split(text, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))


def tracks(ma: Column, ns: Column, nl: Column, msp_s: Column, msp_l: Column) -> Column:
    """Tracks of a read: those of MA where it names any, else nuc from the older nucleosome tags and msp from the patch tags.

    Starts without a length, and lengths without a start, are passed over; tags that are absent give no track.
    """
    new = parse_ma(ma)
    pairs = lambda a, b: F.transform(F.slice(F.arrays_zip(a.alias("start"), b.alias("length")), 1, F.greatest(F.least(F.size(a), F.size(b)), F.lit(0))), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    entry = lambda name, a, b: F.when(a.isNotNull() & b.isNotNull(), F.array(F.struct(F.lit(name).alias("key"), pairs(a, b).alias("value")))).otherwise(F.array())
    old = F.map_from_entries(F.concat(entry("nuc", ns, nl), entry("msp", msp_s, msp_l)))
    return F.when(F.size(new) > 0, new).otherwise(old)


def modified_calls(mm: Column, code: str = "a") -> Column:
    """Number of positions that a modified-base tag (MM) calls with a one-letter code, on either strand; 0 for null.

    A section names a base, a strand, its codes and then the distances between calls, one for each call.
    """
    sections = F.filter(F.split(F.coalesce(mm, F.lit("")), ";"), lambda s: s.rlike(rf"^[ACGTUN][-+][a-z]*{code}[a-z]*[.?]?(,|$)"))
    return F.aggregate(sections, F.lit(0), lambda n, s: n + F.size(F.split(s, ",")) - 1)


def nucleosome_count(nc: Column, ma: Column, ns: Column) -> Column:
    """Tag ``nc``, else the nuc segments of MA, else the length of ``ns``, else 0."""
    tracks = parse_ma(ma)
    return F.coalesce(nc, F.when(F.map_contains_key(tracks, "nuc"), F.size(F.element_at(tracks, "nuc"))), F.when(ns.isNotNull(), F.size(ns)), F.lit(0))


def variant_ids(tag: Column) -> Column:
    """Ids of a variant tag: none for WT and null, the JSON list's strings, or the raw text itself."""
    parsed = F.from_json(tag, "array<string>", {"mode": "PERMISSIVE"})
    empty = F.array().cast("array<string>")
    return F.when(tag.isNull() | (tag == "WT"), empty).when(tag.startswith("[") & parsed.isNotNull(), parsed).otherwise(F.array(tag))


def raw_tag(ids: Column) -> Column:
    """The tag of a list of ids: WT, or a JSON list of the sorted ids with a blank after each comma."""
    return F.when(F.size(ids) == 0, "WT").otherwise(F.concat(F.lit('["'), F.array_join(F.array_sort(ids), '", "'), F.lit('"]')))


def parse_variant_id(vid: Column) -> Column:
    """``position, ref, alt, change_type`` of an id such as 6120:t>C, 6120:+T or 6120:3ACG (whose ref is its first base)."""
    pos = F.nullif(F.regexp_extract(vid, r"^(\d+):", 1), F.lit("")).cast("int")
    change = F.regexp_extract(vid, r"^\d+:(.*)", 1)
    snv, ins, dele = r"^([ACGTacgt])>([ACGTacgt])", r"^\+([ACGTacgt]+)", r"^(\d+)([ACGTacgt])"
    kind = F.when(pos.isNull(), F.lit(None).cast("string")).when(change.rlike(snv), "snv").when(change.rlike(ins), "ins").when(change.rlike(dele), "del").otherwise("unknown")
    null = F.lit(None).cast("string")
    ref = F.when(kind == "snv", F.regexp_extract(change, snv, 1)).when(kind == "ins", "").when(kind == "del", F.regexp_extract(change, dele, 2)).otherwise(null)
    alt = F.when(kind == "snv", F.regexp_extract(change, snv, 2)).when(kind == "ins", F.regexp_extract(change, ins, 1)).when(kind == "del", "").otherwise(null)
    return F.struct(pos.alias("position"), ref.alias("ref"), alt.alias("alt"), kind.alias("change_type"))


def is_indel(vid: Column) -> Column:
    return vid.contains("+") | (vid.contains(":") & ~vid.contains(">"))


def is_transition(ref: Column, alt: Column) -> Column:
    """True for A<->G and C<->T in any case."""
    return F.concat(F.upper(ref), F.upper(alt)).isin("AG", "GA", "CT", "TC")


def safe_name(vid: Column) -> Column:
    """A name for files and groups: blanks, quotes and square brackets dropped, separators spelled out."""
    return F.replace(F.replace(F.translate(F.translate(vid, ' "[]', ""), ":,/", "___"), F.lit(">"), F.lit("to")), F.lit("+"), F.lit("plus"))


def sample_name(path: Column) -> Column:
    """The file's name without folder, extension and known suffixes."""
    base = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return reduce(lambda c, s: F.regexp_replace(c, s.replace(".", r"\.") + "$", ""), SAMPLE_SUFFIXES, base)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def strand_position(pos: Column, start: Column, end: Column, minus: Column) -> Column:
    """Display offset of a position: from the start on the plus strand, from the end on the minus strand."""
    return F.when(minus, end - pos).otherwise(pos - start)


def neg_log10(p: Column) -> Column:
    """-log10 with p at 1e-10 or more."""
    return -F.log10(F.greatest(p, F.lit(1e-10)))


def stars(q: Column) -> Column:
    return F.when(q < 0.05, "***").when(q < 0.10, "**").when(q < 0.20, "*").otherwise("")


def natural_key(name: Column) -> Column:
    """(text, number) by which names with a number at the end are ordered."""
    return F.struct(F.regexp_extract(name, r"^(\D*)", 1).alias("text"), F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit("")).cast("long").alias("number"))


def at_fraction(n_m6a: Column, seq: Column) -> Column:
    """m6A calls as a share of A and T bases; 0 where there are none."""
    at = F.length(seq) - F.length(F.translate(seq, "ATat", ""))
    return F.when(at > 0, n_m6a / at).otherwise(F.lit(0.0))
