"""Problem 7: evaluation texts leaking into training text.

Every window of twelve consecutive words of a test item is a pattern. A Wu-Manber scan over a document's words
skips the positions at which no pattern can end (shift table over blocks of two words), selects candidates by
the hash of a window's last block and confirms them word by word.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occuspan.session import spread, table

#: words of a passage; words of a shift block
PASSAGE, BLOCK = 12, 2

#: bytes of item text for which one scan holds the patterns; more items are scanned in blocks of this size
BLOCK_BYTES = 16 << 20


class Words:
    """Splits a text into the maximal runs of letters and digits after NFKC, removal of format characters and lower-casing."""

    def __init__(self):
        import regex

        self.format = regex.compile(r"\p{Cf}+")
        self.run = regex.compile(r"[\p{L}\p{N}]+")
        import re

        self.ascii = re.compile(r"[a-z0-9]+")

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        if text.isascii():
            return self.ascii.findall(text.lower())
        return self.run.findall(self.format.sub("", unicodedata.normalize("NFKC", text)).lower())


class WuManber:
    """Patterns of ``m`` words each; ``scan`` gives the items whose patterns occur in a word list."""

    def __init__(self, items: list[tuple[int, list[str]]], m: int = PASSAGE, b: int = BLOCK):
        self.m, self.b = m, b
        self.far = m - b + 1
        self.shift: dict[tuple[str, ...], int] = {}
        self.bucket: dict[tuple[str, ...], dict[tuple[str, ...], set[int]]] = {}
        for item, words in items:
            for i in range(len(words) - m + 1):
                p = tuple(words[i : i + m])
                for end in range(b, m + 1):
                    key = p[end - b : end]
                    if m - end < self.shift.get(key, self.far):
                        self.shift[key] = m - end
                self.bucket.setdefault(p[m - b :], {}).setdefault(p, set()).add(item)

    def scan(self, words: list[str]) -> set[int]:
        found: set[int] = set()
        m, b, far, shift, bucket = self.m, self.b, self.far, self.shift, self.bucket
        end, n = m, len(words)
        while end <= n:
            key = tuple(words[end - b : end])
            step = shift.get(key, far)
            if step == 0:
                if hit := bucket[key].get(tuple(words[end - m : end])):
                    found |= hit
                step = 1
            end += step
        return found


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of about ``BLOCK_BYTES``, one list at a time."""
    rows, size = [], 0
    for r in items.toLocalIterator():
        rows.append((r["i"], r["t"]))
        size += 4 * len(r["t"])
        if size > BLOCK_BYTES:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


#: the pattern table of the block that a worker process scans for; one is kept, so a worker's tasks build it once
_TABLE: dict[str, WuManber] = {}


def _patterns(name: str, shipped, words: Words, passage: int) -> WuManber:
    if name not in _TABLE:
        wm = WuManber([(i, words(t)) for i, t in shipped.value], passage)
        _TABLE.clear()
        _TABLE[name] = wm
    return _TABLE[name]


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, passage: int = PASSAGE) -> DataFrame:
    """``doc_id, item_id``: documents that hold at least ``passage`` consecutive words of an item as consecutive words.

    Null and empty texts hold nothing; items with fewer words than a passage can't be held; rows with a null id are
    left out; each pair comes once, however often rows repeat; whole texts are scanned, and other columns are ignored.

    The items are the stated query set: they are read in blocks whose text is at most ``BLOCK_BYTES``, so what a scan
    ships to the executors is bounded, and all documents are scanned against each block. Documents aren't shuffled, but for an input of fewer partitions than cores.
    """
    spark = docs.sparkSession
    q = items.where(F.col(f"`{item_id}`").isNotNull() & F.col(f"`{item_text}`").isNotNull()).select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{item_text}`").alias("t"))
    d = spread(docs.where(F.col(f"`{doc_id}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.col(f"`{text}`").alias("t")))
    out = None
    for rows in _blocks(q):
        # the driver keeps no block once it is shipped
        shipped, name = spark.sparkContext.broadcast(rows), uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame], shipped=shipped, name=name):
            words = Words()
            wm = _patterns(name, shipped, words, passage)
            for pdf in batches:
                hits = [(d, i) for d, t in zip(pdf["d"], pdf["t"]) for i in wm.scan(words(t))]
                yield pd.DataFrame(hits, columns=["d", "i"], dtype="int64")

        part = d.mapInPandas(run, "d long, i long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return d.sparkSession.createDataFrame([], f"`{doc_id}` bigint, `{item_id}` bigint")
    return out.distinct().select(F.col("d").alias(doc_id), F.col("i").alias(item_id))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items they hold a passage of."""
    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of leaking documents of every test item, zero included."""
    n = p7_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    items = table(spark, sf_dir, "eval_items").select("item_id", "suite", "lang")
    return items.join(n, "item_id", "left").select("item_id", "suite", "lang", F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs"))


QUERIES = {"p7_found": p7_found, "p7_items": p7_items}

#: SQL here has no NFKC; the tests compare with brute force
ORACLES: dict[str, str] = {}
