import base64
import copy
import itertools
import random
import time
import unicodedata
from collections import Counter

import numpy as np
import pytest

from occuspan.llm import leakage, pii, pii_train, tokens

VOCAB = f"{tokens.VOCAB_DIR}/byte_bpe_50k.tiktoken"
ODD = ["", " ", "\n\n  x", "naïve ſ ﬁ", "日本語のテキスト", "a" * 3000, "=-" * 900, " " * 700 + "b", "it's we'll 'tis", "<|endoftext|>", "​﻿", "x\r\n\ty  ", "🙂" * 300, "0123456789" * 90, "é" * 40]


@pytest.fixture(scope="module")
def t():
    return tokens.Transducer(VOCAB)


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(VOCAB, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.SPLIT, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_reference_and_come_back(t, reference):
    r = random.Random(0)
    small = copy.copy(t)
    small.piece = 6  # every longer pre-token goes over pieces
    texts = ODD + ["".join(r.choice("ab 1'\n.éß語") for _ in range(r.randrange(400))) for _ in range(200)]
    for x in texts:
        ids = t.encode(x)
        assert ids == reference.encode_ordinary(x)
        assert "".join(t.decode(ids)) == x
        assert list(t.encode_pieces(x[i : i + 7] for i in range(0, len(x), 7))) == ids
        assert small.encode(x) == ids
    assert t.encode(None) == []


def test_long_pretokens_stream_in_bounded_memory(t, reference):
    r = random.Random(1)
    for letters in ("a", "ab", "ACGT", "thequickbrown", "=-_"):
        w = "".join(r.choice(letters) for _ in range(2500))
        b = w.encode()
        assert list(t.stream(b[i : i + 5] for i in range(0, len(b), 5))) == reference.encode_ordinary(w)


@pytest.mark.parametrize("unit", ["a", "thequickbrown", "\n", "=-"])
def test_a_long_text_without_blanks_needs_flat_memory(t, unit):
    """Peak memory of the encoder over a long pre-token doesn't depend on its length."""
    import tracemalloc

    peaks = []
    for n in (80_000, 240_000):
        tracemalloc.start()
        count = sum(len(c) for c in t.chunks(unit * (4096 // len(unit)) for _ in range(n // 4096)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert count > 0
    assert peaks[1] < 1.3 * peaks[0] + 300_000, peaks


def test_ids_of_a_table(spark):
    df = spark.createDataFrame([(1, "Hello world", "z"), (2, None, "z"), (3, "", "z"), (3, "", "z")], "doc_id long, text string, ids string")
    got = tokens.encode_column(df, "doc_id", "text", VOCAB).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in got) == [(1, [15496, 995]), (2, []), (3, []), (3, [])]
    assert tokens.encode_column(df.limit(0), "doc_id", "text", VOCAB).count() == 0


def dressed(words, r):
    out = []
    for w in words:
        k = r.random()
        w = w.upper() if k < 0.3 else w
        if r.random() < 0.2 and len(w) > 2:
            w = w[:1] + "​" + w[1:]
        if r.random() < 0.1:
            w = "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalpha() else c for c in w)
        out.append(w + r.choice(["", ",", " ", "**", "\n"]))
    return " ".join(out)


def test_leaks_against_every_window(spark, monkeypatch):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(30)] + ["don", "t", "Straße", "élan"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(5, 40)))) for i in range(15)] + [(99, None), (98, "")]
    docs = []
    for d in range(80):
        parts = [" ".join(r.choice(vocab) for _ in range(20))]
        if r.random() < 0.6:
            w = r.choice(items[:15])[1].split()
            n = r.randrange(9, 16)
            at = r.randrange(max(1, len(w) - n + 1))
            parts.insert(r.randrange(2), dressed(w[at : at + n], r))
        docs.append((d, " ; ".join(parts), "x"))
    docs += [(200, None, "x"), (201, "", "x"), docs[0]]
    split = leakage.Words()
    want = set()
    for d, text, _ in docs:
        w = split(text)
        mine = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for i, it in items:
            v = split(it)
            if any(tuple(v[k : k + 12]) in mine for k in range(len(v) - 11)):
                want.add((d, i))
    a = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert want and {tuple(x) for x in leakage.leaks(a, "doc_id", "text", b, "item_id", "text").collect()} == want
    monkeypatch.setattr(leakage, "BLOCK_BYTES", 100)  # several blocks of items
    assert {tuple(x) for x in leakage.leaks(a, "doc_id", "text", b, "item_id", "text").collect()} == want


def test_words():
    w = leakage.Words()
    assert w("Ｆoo_bar­Baz 2½ É") == ["foo", "barbaz", "21", "2", "é"] and w(None) == []
    assert w("ABC def-1") == ["abc", "def", "1"] and unicodedata


GIVEN = ["Sorya", "Meris", "Tamin", "Bondi", "Danar", "Losko", "Keko", "Jölmek", "Zelmis", "Tási", "Amber", "Falcon"]
FAMILY = ["Lorerin", "Bikanen", "Raesoro", "Kevoro", "Vormark", "Dazulli", "Trozado", "Kunulli", "Jaskhoff", "Söndovek", "Plate", "Lane"]


FOLDS, FOLD = 6, 0


@pytest.fixture(scope="module")
def tagger():
    return pii.trained(GIVEN, FAMILY, [], folds=FOLDS, left_out=FOLD)


def test_held_out_accuracy(tagger):
    """On whole templates that training never saw, in documents of them alone."""
    f = pii_train.Filler(GIVEN, FAMILY, 99, FOLDS, FOLD, True, ordinary={x for x in (*GIVEN, *FAMILY) if pii.fold(x) in tagger.common})
    docs = [f.document() for _ in range(300)]
    hit, said, true = Counter(), Counter(), Counter()
    for (text, spans), got in zip(docs, tagger.find([d[0] for d in docs])):
        want = {(text[a:b], k) for a, b, k in spans}
        mine = {(text[a:b], k) for a, b, k in got}
        for rows, n in ((want & mine, hit), (mine, said), (want, true)):
            n.update(k for _, k in rows)
    figures = {k: (round(hit[k] / true[k], 3), round(hit[k] / said[k], 3)) for k in true}
    assert len(figures) == 5 and all(r > 0.6 and p > 0.8 for r, p in figures.values()), figures
    assert sum(hit.values()) / sum(true.values()) > 0.85, figures


def test_messages_are_exact_without_loops(tagger):
    """Max-sum and sum-product on a chain against every labelling."""
    r = np.random.default_rng(0)
    score = np.full((5, pii.N), -1e4, np.float32)
    score[:, :3] = r.normal(size=(5, 3))
    table = np.zeros((1, pii.N, pii.N), np.float32)
    table[0, :3, :3] = r.normal(size=(3, 3))
    src, dst = np.arange(4), np.arange(1, 5)
    every = {y: sum(score[i, y[i]] for i in range(5)) + sum(table[0, y[i], y[i + 1]] for i in range(4)) for y in itertools.product(range(3), repeat=5)}
    for best in (True, False):
        belief = score.copy()
        np.add.at(belief, np.r_[dst, src], tagger._messages(score, src, dst, table, np.zeros(4, int), best))
        if best:
            assert tuple(belief.argmax(axis=1)) == max(every, key=every.get)
        else:
            z = np.array([[sum(np.exp(v) for y, v in every.items() if y[i] == k) for k in range(3)] for i in range(5)])
            p = np.exp(belief[:, :3] - belief.max(axis=1, keepdims=True))
            assert np.allclose(p / p.sum(axis=1, keepdims=True), z / z.sum(axis=1, keepdims=True), atol=1e-3)


def test_equal_words_agree_across_a_document():
    """A skip edge carries a label from a clear place to an unclear one."""
    t = pii.Tagger(set(), set())
    t.index, t.w = {"p=by": 1, "b": 2}, np.zeros((3, pii.N), np.float32)
    t.w[1, pii.G], t.w[2, pii.O] = 3, 0.5
    t.edge = {"skip": np.diag(np.full(pii.N, 2.0)).astype(np.float32)}
    text = "done by Soryan Lorerin today. " + "x " * 400 + "Soryan Lorerin left."
    nodes, edges = t.graph(text)
    lab = t.decode([(nodes, edges)])[0]
    assert [n.text for n in nodes] == ["Soryan", "Lorerin"] * 2 and lab[0] == lab[2] == pii.G
    assert t.decode([(nodes, [e for e in edges if e[2] != "skip"])])[0][2] == pii.O


def test_long_texts_take_time_in_proportion(tagger):
    """Runs, numbers and addresses of any length, none cut."""
    runs = lambda n: "Anna " * n + "9" * n + " x" + "y" * n + "@a.example.org"
    took = []
    for n in (2000, 8000):
        began = time.process_time()
        nodes, _ = tagger.graph(runs(n))
        took.append(time.process_time() - began)
        assert [x.end - x.start for x in nodes if x.kind == "email"] == [n + 15] and sum(x.kind == "word" for x in nodes) == n and any(x.kind == "number" and len(x.text) == n for x in nodes)
    assert took[1] < 10 * took[0] + 0.5


def test_masks_keep_the_rest(spark, tagger):
    text = "Contact: Sorya Lorerin <sorya.lorerin@lab.example.org>, tel. +44 20 7946 0123. Lot 911-46-5309 is fine."
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x" * 50000)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.masked(df, "doc_id", "text", tagger).collect()}
    assert got[1].text == "Contact: [NAME] <[EMAIL]>, tel. [PHONE]. Lot 911-46-5309 is fine." and got[1].n_replaced == 3
    assert got[2].text is None and got[3].text == "" and got[4].text == "x" * 50000
    found = pii.find(df, "doc_id", "text", tagger).collect()
    assert all(text[r.start : r.end] == r.pii_text for r in found) and len(found) == 3
    assert pii.find(df.limit(0), "doc_id", "text", tagger).count() == 0


def test_lexer_bounds():
    kinds = lambda s: [(n.kind, n.text) for n in pii.lex(s)]
    assert kinds("mail a.b@x.org. Call +44 (0)20 79460123 ext. 4") == [("email", "a.b@x.org"), ("number", "+44 (0)20 79460123")]
    assert kinds("(x1 [at] uni-a [dot] example)") == [("email", "x1 [at] uni-a [dot] example")]
    assert ("address", "12b Oakley St.") in kinds("to 12b Oakley St., second") and ("address", "Langweg 7a") in kinds("Langweg 7a")
    assert kinds("q = 0.0007261 on 2025-08-14T10:00") == []
    assert kinds("Herr Bo Li, 86 b") == [("word", "Bo"), ("word", "Li")] and kinds("J. Wu先生") == [("letter", "J"), ("word", "Wu")]
    assert ("address", "Calle Mayor, 30") in kinds("en Calle Mayor, 30.") and ("address", "人民路12号") in kinds("人民路12号") and ("address", "Feldweg 3") in kinds("am Feldweg 3.")
    assert [n.kind for n in pii.lex("a" * 300 + ".b@x.example")] == ["email"]
    assert pii.Tagger._names("A. van Berg's", pii.lex("A. van Berg's"), [pii.G, pii.FAM]) == [(0, 11, "name")]


def test_lower_case_names_do_not_depend_on_the_rest_of_a_text():
    parts = {"jose", "garcia", "anne-marie", "smith"}
    for name in ("josé garcía", "anne-marie garcía"):
        alone, more = pii.lex(f"i met {name} today", parts), pii.lex(f"i met {name} today. then, in 1999, smith left", parts)
        assert [n.text for n in alone] == ["met", *name.split(), "today"] == [n.text for n in more][:4]
