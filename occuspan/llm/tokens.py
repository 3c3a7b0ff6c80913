"""Problem 6: encoding a corpus with a public byte-level BPE vocabulary.

The encoder is a streaming transducer. Text arrives in pieces and is cut into pre-tokens; each pre-token's bytes
are fed to a machine that keeps, for each byte of a short tail, the last token of the unique encoding up to that
byte. Tokens are emitted once no continuation can change them, so memory doesn't depend on the length of the text
or of a pre-token.

Why a bounded lookahead suffices. A sequence of tokens is the encoding of its bytes exactly if every two neighbours
are the encoding of theirs. So the encoding of a text, cut at one of its token ends, is the encoding of the part
before, and ``last`` holds all of them. Whatever follows n bytes, one token of the final encoding covers byte n; it
begins at a place j from which the bytes up to n begin a token of the vocabulary (or j = n). The merge list gives
all such beginnings and their longest continuation, the lookahead: no place further back than that is alive. The
tokens shared by the encodings up to all living places are therefore in every continuation.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occuspan.session import spread, table

#: folder of the vocabulary files; a parameter of every function that reads one
VOCAB_DIR = os.environ.get("OCCUSPAN_TOKENIZERS", "/opt/tokenizers")

#: fixed values: the published split pattern of this vocabulary, its contractions apart
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SPLIT = "|".join(CONTRACTIONS) + r"""| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: characters that must follow a pre-token before it is final: an apostrophe may begin the longest contraction
MARGIN = max(map(len, CONTRACTIONS))

#: characters of a piece in which texts are read
PIECE = 1 << 16


class _Feed:
    """Text to come: what is held, and the pieces after it."""

    def __init__(self, pieces: Iterable[str]):
        self.it = iter(pieces)
        self.hold, self.next = "", next(self.it, None)

    def more(self, keep: str) -> bool:
        """Holds what is kept and the next piece; False at the end."""
        if self.next is None:
            self.hold = keep
            return False
        self.hold, self.next = keep + self.next, next(self.it, None)
        return True


class Transducer:
    """Encoder and decoder for one ranks file (base64 token and id on each line)."""

    def __init__(self, path: str, cache: int = 200_000, piece: int = PIECE):
        import regex

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.bytes = {i: b for b, i in self.rank.items()}
        #: every beginning of a token with the bytes that its longest continuation adds, and every ending with its id or -1
        self.more: dict[bytes, int] = {}
        self.ending: dict[bytes, int] = {}
        for b in self.rank:
            for i in range(1, len(b)):
                self.more[b[:i]] = max(self.more.get(b[:i], 0), len(b) - i)
                self.ending.setdefault(b[i:], -1)
        self.ending.update(self.rank)
        #: bytes behind a place after which it can't be alive
        self.lookahead = 1 + max(self.more.values(), default=0)
        self.split = regex.compile(SPLIT)
        self.kinds = [regex.compile(x) for x in (r"\s*", r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*")]
        self.piece = piece
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cache_size = cache
        self.fits: dict[int, bool] = {}

    def merge(self, word: bytes) -> list[int]:
        """The definition: the adjacent pair of lowest rank is merged, the first of equals, until none is left. It judges pairs of tokens."""
        rank = self.rank
        if (whole := rank.get(word)) is not None:
            return [whole]
        parts = [word[i : i + 1] for i in range(len(word))]
        ranks = [rank.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) < 1 << 60:
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], 1 << 60)
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], 1 << 60)
        return [rank[p] for p in parts]

    def _adjoin(self, key: int) -> bool:
        """True where two ids may stand side by side in an encoding."""
        if len(self.fits) > 2 * self.cache_size:
            self.fits.clear()
        a, b = key >> 32, key & 0xFFFFFFFF
        ok = self.fits[key] = self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return ok

    def _step(self, tail: bytes, last: list[int], begin: int) -> None:
        """Extends ``last``, the last id of the encoding of each beginning of ``tail``, from byte ``begin`` to the end."""
        ending, fits = self.ending.get, self.fits.get
        for n in range(begin + 1, len(tail) + 1):
            i = n
            while i:
                i -= 1
                t = ending(tail[i:n])
                if t is None:
                    raise ValueError("the vocabulary lacks a byte")
                if t >= 0:
                    before = last[i]
                    if before < 0:
                        last.append(t)
                        break
                    key = before << 32 | t
                    ok = fits(key)
                    if ok or ok is None and self._adjoin(key):
                        last.append(t)
                        break

    def _ends(self, last: list[int], at: int) -> list[int]:
        """Token ends of the encoding of the first ``at`` bytes."""
        size_of, path = self.bytes, []
        while at > 0:
            path.append(at)
            at -= len(size_of[last[at]])
        return path[::-1]

    def stream(self, pieces: Iterable[bytes]) -> Iterator[int]:
        """Ids of one pre-token that comes in pieces."""
        tail, last = b"", [-1]  # last[0] is the id before the tail
        for piece in pieces:
            for at in range(0, len(piece), 4 * self.lookahead):
                done = len(tail)
                tail += piece[at : at + 4 * self.lookahead]
                self._step(tail, last, done)
                n = len(tail)
                if n < 4 * self.lookahead:
                    continue
                shared = self._ends(last, n)
                for j in range(max(1, n - self.lookahead), n):
                    if tail[j:] in self.more:
                        path, m = self._ends(last, j), 0
                        while m < len(shared) and m < len(path) and shared[m] == path[m]:
                            m += 1
                        shared = shared[:m]
                yield from (last[x] for x in shared)
                if shared:
                    tail, last = tail[shared[-1] :], last[shared[-1] :]
        yield from (last[x] for x in self._ends(last, len(tail)))

    def word(self, w: str) -> tuple[int, ...]:
        """Ids of one pre-token, kept for the next time it occurs."""
        b = w.encode("utf-8", "replace")
        ids = tuple(self.stream((b,)))
        if len(b) <= self.lookahead:
            if len(self.cache) >= self.cache_size:
                self.cache.clear()
            self.cache[w] = ids
        return ids

    def _run(self, feed: _Feed) -> Iterator[bytes]:
        """Bytes of the one pre-token, begun in ``feed.hold``, that goes on over pieces. Of white space the last character is held back, since it may belong to what follows."""
        h, at = feed.hold, 0
        if h[:2].isspace():
            kind = self.kinds[0]
        else:
            at = int(h[0] == " ")
            kind = next(k for k in self.kinds[1:] if k.match(h, at).end() > at)
        back = int(kind is self.kinds[0])
        while True:
            end = kind.match(feed.hold, at).end()
            over = end < len(feed.hold)
            yield feed.hold[: end - back].encode("utf-8", "replace")
            keep = feed.hold[end - back :]
            if over:
                feed.hold = keep
                return
            if not feed.more(keep):
                yield keep.encode("utf-8", "replace")
                feed.hold = ""
                return
            at = 0

    def chunks(self, pieces: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a text that comes in pieces of any length, in lists."""
        feed, get, slow = _Feed(pieces), self.cache.get, self.word
        while feed.more(feed.hold):
            out: list[int] = []
            if feed.next is None:
                for w in self.split.findall(feed.hold):
                    out += get(w) or slow(w)
                yield out
                return
            end = 0
            for m in self.split.finditer(feed.hold):
                if m.end() > len(feed.hold) - MARGIN:
                    break
                out += get(w := m.group()) or slow(w)
                end = m.end()
            yield out
            feed.hold = feed.hold[end:]
            if len(feed.hold) >= self.piece:  # a pre-token that is longer than a piece
                yield from ([i] for i in self.stream(self._run(feed)))
        if feed.hold:
            yield [i for w in self.split.findall(feed.hold) for i in (get(w) or slow(w))]

    def encode_pieces(self, pieces: Iterable[str]) -> Iterator[int]:
        """The same, id by id."""
        for c in self.chunks(pieces):
            yield from c

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; the empty list for an empty and for a null text. Special tokens' strings are ordinary text."""
        out: list[int] = []
        if text:
            for c in self.chunks(text[i : i + self.piece] for i in range(0, len(text), self.piece)):
                out += c
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text in pieces: bytes go through an incremental UTF-8 state machine, which holds back unfinished characters."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if s := machine.decode(self.bytes[i]):
                yield s
        if s := machine.decode(b"", True):
            yield s


_OPEN: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One transducer for each worker process and file."""
    if path not in _OPEN:
        _OPEN[path] = Transducer(path)
    return _OPEN[path]


def encode_column(df: DataFrame, key: str, text: str, vocab: str) -> DataFrame:
    """``key, ids``: the ids (array<int>) of every row's text.

    A null or empty text has the empty list; a text of any length is encoded whole; repeated rows are encoded
    again, each on its own; an empty table gives no rows. Each batch is encoded where it is read; only an input of fewer partitions than cores is dealt out first.
    ``vocab`` is the path of the ranks file, which every executor must see.
    """

    def run(batches):
        t = transducer(vocab)
        for b in batches:
            ids = [np.asarray(t.encode(x), dtype=np.int32) for x in b.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.array(np.concatenate([np.empty(0, np.int32), *ids]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[key, "ids"])

    src = spread(df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text")))
    kind = src.schema[key].dataType.simpleString()
    return src.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document by byte_bpe_50k, without special tokens."""
    return encode_column(table(spark, sf_dir, "documents"), "doc_id", "text", f"{VOCAB_DIR}/byte_bpe_50k.tiktoken")


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_ids, same`` of each document: whether decoding its ids gives the text back."""
    path = f"{VOCAB_DIR}/byte_bpe_50k.tiktoken"

    def run(batches: Iterator[pd.DataFrame]):
        t = transducer(path)
        for pdf in batches:
            ids = [t.encode(x) for x in pdf["text"]]
            same = ["".join(t.decode(i)) == (x or "") for i, x in zip(ids, pdf["text"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_ids": [len(i) for i in ids], "same": same})

    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).mapInPandas(run, "doc_id long, n_ids long, same boolean")


QUERIES = {"p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip}

#: SQL has no tokenizer; that each text comes back whole is what the round trip must show
ORACLES = {}
