"""Spelling variants against plain counting and all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import variants
from sightline.llm.variants import Params


def slipped(doc_id, run, slips=31):
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % slips == 0:
        run = run[: h % len(run)] + run[h % len(run) + 1 :]
    return run


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, p=Params()):
    upper = {c: c + 32 for c in range(65, 91)}
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            n[slipped(doc_id, run.translate(upper), p.slips)] += 1
    n = {w: k for w, k in n.items() if len(w) >= p.letters and k >= p.least}
    out, form = [], {}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= p.ratio * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


SCHEMA = "doc_id long, text string"


def test_as_all_pairs_have_it(spark, docs):
    """Words of few letters, so that many are near: chains of forms, ties, double letters, letters beyond ASCII."""
    rng = random.Random(4)
    stems = ["aaaabbb", "abcabca", "Straßeéx", "Àéïøÿ×÷a", "zwischen", "wordword"]
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 10_000]
    for i in range(400):
        words = []
        for _ in range(rng.randrange(30)):
            w = list(rng.choice(stems[: 1 + int(rng.expovariate(0.7)) % len(stems)]))
            for _ in range(int(rng.expovariate(1.1))):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", "é", "AB"])
                w = w or ["a"]
            words.append("".join(w))
        rows.append((rng.choice([None, i, -i]), rng.choice([" ", "-", "1", "Ā", "\n", "\U0001f600"]).join(words)))
    df = spark.createDataFrame(rows, SCHEMA)
    for p in (Params(), Params(letters=3, slips=2, ratio=2), Params(letters=5, least=1, ratio=1_000, bits=1, most=10)):
        assert found(variants.variants(df, p)) == plain(rows, p)


def test_chain_of_forms(spark):
    text = " ".join(w for k, w in enumerate(["letters", "lettersx", "lettersxy", "lettersxyz", "lettersxyza"]) for _ in range(2 * 10 ** (4 - k)))
    got = found(variants.variants(spark.createDataFrame([(None, text)], SCHEMA), Params(slips=2**33)))
    assert got == plain([(None, text)], Params(slips=2**33))
    assert {r[2] for r in got} == {"letters"} and [r[5] for r in got][1:] == [20_000, 2_000, 200, 20]


@pytest.mark.parametrize("word", [b"aab", b"abcdefgh", b"\xe0\xffzzz"])
def test_neighbourhood_is_whole(word):
    letters = b"abz\xe0\xff"
    words = np.frombuffer(word * 2, np.uint8).reshape(2, -1)
    got, made = set(), []
    for kind, h in variants.neighbourhood(words, letters):
        assert (h[0] == h[1]).all()
        for at in range(h.shape[1]):
            for k in range(h.shape[2]):
                w = variants.edited(word, kind, at, letters[k])
                made.append((w, int(h[0, at, k])))
                got.add(w)
    for w, h in made:
        assert int(variants.hashes(np.frombuffer(w, np.uint8).reshape(1, -1))[0]) == h
    n = range(len(word) + 1)
    want = {word[:i] + word[i + 1 :] for i in n[:-1]} | {word[:i] + bytes([c]) + word[i + 1 :] for i in n[:-1] for c in letters} | {word[:i] + bytes([c]) + word[i:] for i in n for c in letters}
    assert got == want


def test_no_words_and_clashing_columns(spark, empty, docs):
    assert found(variants.variants(empty)) == found(variants.variants(spark.createDataFrame([(1, None), (2, ""), (3, "short 123")], SCHEMA))) == []
    few = docs.where("length(text) < 10000")
    more = few.withColumns({c: F.lit(1) for c in ("word", "n", "near", "form", "root", "n_near", "best")})
    assert found(variants.variants(more)) == found(variants.variants(few)) != []


def test_counts_are_handed_on_in_parts(spark, docs, monkeypatch):
    want = sorted(map(tuple, variants.counted(docs).collect()))
    monkeypatch.setattr(variants, "HELD", 3)
    assert sorted(map(tuple, variants.counted(docs).collect())) == want
