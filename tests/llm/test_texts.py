"""op2, op4, op6 and op10 on small tables, against plain Python."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sightline.llm import components, decontam, langid, license, minhash

from .conftest import DOCS, prose

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def licence_truth(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    places, labels = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        for j in range(len(w) - len(p) + 1):
            if w[j : j + len(p)] == p:
                places.append(j)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licences(spark, docs, empty):
    extra = ["MIT License", "mit-license apache  LICENSE, Version 2.0", "xmit license", "GNU General Public License gnu general public license", "cc by cc by nc", "mit\u212a license", "émit license",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal without restriction",
             "x " * 700_000 + "apache license " + "y " * 400_000, "apache", "license mit"]
    df = docs.union(spark.createDataFrame([(1000 + i, t, "en", "s", 0) for i, t in enumerate(extra)], DOCS)).withColumn("labels", F.lit("clash"))
    texts = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    rows = license.scan(df).collect()
    got = sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in rows)
    assert got == sorted(str((i, *licence_truth(t))) for i, t in texts)
    by = {r.doc_id: r for r in rows}
    assert by[1001].labels == "apache,apache-2.0,mit" and by[1004].labels == "cc-by,cc-by-nc" and by[1007].labels == "mit" and 0 < by[1007].score < 1
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)
    assert license.scan(empty).count() == 0


def plain_scan(index, text):
    """Labels and score by trying every place of every template."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    w, labels, score = [x.encode() for x in w], set(), 0.0
    stands = lambda p: [j for j in range(len(w) - len(p) + 1) if tuple(w[j : j + len(p)]) == p]
    for t in index.templates:
        hits = [stands(k) for k in t.keys]
        weight = sum(index.idf[x] for x in t.words)
        for at in hits[0] if all(hits) else []:
            start, slack = at - t.place(0), 0 if t.base else len(t.words) // 2
            near = w[max(0, start - slack) : start + len(t.words) + slack]
            fits = all(any(abs(h - t.place(k) - start) <= slack for h in hits[k]) for k in range(len(hits)))
            if fits and not any(x in b" " + b" ".join(near) + b" " for x in t.without):
                got = sum(min(near.count(x), t.words.count(x)) * index.idf[x] for x in set(t.words)) / weight
                if got >= license.LEAST:
                    labels.add(t.label)
                    score = max(score, got * (1 - np.exp(-got * weight / license.WEIGHT)))
    return ",".join(sorted(labels)), score


def test_licence_texts(spark):
    """Every public text whole, altered, truncated and mixed with another, by labels and score, against a plain search."""
    rng = random.Random(9)
    full = {label: text for label, text, *_ in license.FULL}
    texts = []
    for label, text in full.items():
        w = text.split()
        altered = [rng.choice(["xx", "yy"]) if rng.random() < 0.06 else x for x in w]
        added = [y for x in w for y in ([x, "// *"] if rng.random() < 0.1 else [x])]
        other = rng.choice(list(full.values())).split()
        texts += [prose(rng, "en", 30) + " " + text, " ".join(altered), " ".join(w[: len(w) // 2]), " ".join(added), text + prose(rng, "de", 40) + " ".join(other), " ".join(x for pair in zip(w, other) for x in pair)]
    texts += [f"// SPDX-License-Identifier: {name}" for name, _ in license.TAGS] + ["apache apache license license mit", "neither the name of BSD"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = license.Index(*license.frequencies(df))
    got = {r.doc_id: (r.labels, r.score) for r in license.scan(df).collect()}
    for i, text in enumerate(texts):
        want = plain_scan(index, text)
        assert got[i][0] == want[0] and abs(got[i][1] - want[1]) < 1e-9, text
    for n, label in enumerate(full):
        whole, altered = got[6 * n], got[6 * n + 1]
        assert label in whole[0].split(",") and altered[1] <= whole[1] and whole[1] > 0.85
    assert "bsd-2-clause" not in got[6 * list(full).index("bsd-3-clause")][0] and len({round(s, 3) for _, s in got.values()}) > 20


def test_blocks_part_a_text_between_words():
    data = b"one two  three four five six seven"
    seen = {}
    for start, again, words in license.blocks(data, 2, size=7):
        for i, w in enumerate(words):
            assert seen.setdefault(start + i, w) == w
    assert [seen[i] for i in range(7)] == data.split()


def test_language_of_held_out_documents(spark, docs, empty):
    rng = random.Random(4)
    rows = [(i, prose(rng, "en" if i % 2 else "de", 25), "en" if i % 2 else "de", "s", 0) for i in range(200)]
    df = spark.createDataFrame(rows, DOCS).withColumn("held_out", langid.held_out())
    model = langid.fit(df.where("not held_out"), PIECES)
    told = langid.predict(df, model).join(df.select("doc_id", "lang", "held_out"), "doc_id").where("held_out").collect()
    assert len(told) > 40 and np.mean([r.lang_pred == r.lang for r in told]) >= 0.95 and all(0 <= r.score <= 1 for r in told)
    odd = langid.predict(docs.withColumn("lang_pred", F.lit("clash")), model).collect()
    assert len(odd) == docs.count()
    letters = {r.doc_id: any(c.isalpha() for c in r.text or "") for r in docs.collect()}
    assert all((r.lang_pred == "und") == (not letters[r.doc_id]) for r in odd if r.doc_id not in (3, None))
    assert langid.predict(empty, model).count() == 0
    noise = spark.createDataFrame([(1, "zqxj wvkq xzzt qqpw jxvz kkzq"), (2, prose(rng, "en", 20)), (None, prose(rng, "de", 20)), (4, "a" * 5000), (5, " ".join([prose(rng, "en", 8)] * 40_000))], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in langid.predict(noise, model).collect()}
    assert scores[1] < 0.7 < min(scores[2], scores[None], scores[5])
    kept = langid.recognised(noise.withColumn("score", F.lit("clash")), model, 0.7).collect()
    assert {2, None, 5} <= {r.doc_id for r in kept} and 1 not in {r.doc_id for r in kept} and kept[0].score == "clash"
    nothing = langid.fit(empty, PIECES)
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}


def segmentations(word, pieces):
    if not word:
        yield []
    for j in range(1, len(word) + 1):
        if word[:j] in pieces or j == 1:
            for rest in segmentations(word[j:], pieces):
                yield [word[:j], *rest]


def test_forward_sums_all_segmentations():
    pieces = ["▁a", "▁", "a", "b", "ab", "ba", "aba"]
    rng = np.random.default_rng(1)
    p = rng.random((len(pieces) + 1, 2)) / 8
    lattice = langid.Lattice(pieces, langid.Params())
    words = ["ab", "abab", "ba", "cab", "aba", "ab"]
    got = lattice.log_probs(words, p)
    for w, g in zip(words, got, strict=True):
        want = sum(np.prod([p[pieces.index(x) if x in pieces else -1] for x in s], axis=0) for s in segmentations("▁" + w, pieces))
        assert np.allclose(np.exp(g), want)
    counts = np.zeros(len(pieces) + 1)
    lattice.expected("abab", p[:, 0].tolist(), counts, 2.0)
    weights = [(np.prod([p[pieces.index(x) if x in pieces else -1][0] for x in s]), s) for s in segmentations("▁abab", pieces)]
    total = sum(w for w, _ in weights)
    for i, x in enumerate(pieces):
        assert np.isclose(counts[i], 2 * sum(w * s.count(x) for w, s in weights) / total)


@pytest.mark.parametrize("n", [31, 32, 33, 64, 65, 200, 3000])
def test_long_runs_are_summed_whole(n):
    """Runs beyond a block against plain sums in logarithms, which know of no block."""
    pieces = ["▁a", "▁", "a", "b", "ab", "ba", "aba", "bbab", "▁abb"]
    rng, draw = np.random.default_rng(2), random.Random(n)
    p = rng.random((len(pieces) + 1, 2)) / 1e4
    word = "".join(draw.choice("abab" "c") for _ in range(n))
    lattice, span = langid.Lattice(pieces, langid.Params()), "▁" + word
    at = {x: i for i, x in enumerate(pieces)}
    arcs = [(i, j, at.get(span[i:j], len(pieces))) for j in range(1, len(span) + 1) for i in range(max(0, j - 4), j) if span[i:j] in at or i == j - 1]
    logs = np.log(p)
    forward, backward = np.full((len(span) + 1, 2), -np.inf), np.full((len(span) + 1, 2), -np.inf)
    forward[0], backward[-1] = 0, 0
    for i, j, x in arcs:
        forward[j] = np.logaddexp(forward[j], forward[i] + logs[x])
    for i, j, x in reversed(arcs):
        backward[i] = np.logaddexp(backward[i], backward[j] + logs[x])
    assert np.allclose(lattice.log_probs([word, "ab"], p)[0], forward[-1]) and np.allclose(lattice.log_prob(span, p), forward[-1])
    counts, want = np.zeros(len(p)), np.zeros(len(p))
    lattice.expected(word, p[:, 1].tolist(), counts, 3.0)
    many = np.zeros(len(p))
    lattice.expected_many([word, word], p[:, 1], many, np.array([1.0, 2.0]))
    assert np.allclose(many, counts)
    for i, j, x in arcs:
        want[x] += 3 * np.exp(forward[i, 1] + logs[x, 1] + backward[j, 1] - forward[-1, 1])
    assert np.allclose(counts, want)


def edit_distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_equals_plain_distance():
    rng = random.Random(3)
    for _ in range(300):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        want, found = edit_distance_in(pattern, text), decontam.myers(pattern, text, 6)
        assert (found[0] if found else 7) == min(want, 7)


def test_decontamination(spark, docs, empty):
    rng = random.Random(8)
    items = [(i, prose(rng, "en", 30)) for i in range(8)] + [(50, "short one"), (51, None), (52, ""), (None, prose(rng, "de", 30)), (0, prose(rng, "de", 40))]
    texts = []
    for i, (_, t) in enumerate(items):
        if t and len(t) > 40:
            x = list(t)
            for _ in range(i % 12):
                x[rng.randrange(len(x))] = rng.choice("xyz ")
            texts += [prose(rng, "de", 20) + " " + "".join(x).upper() + " " + prose(rng, "de", 20), "".join(x), "".join(x)[: len(x) // 2]]
    rows = docs.select(*DOCS_COLUMNS).union(spark.createDataFrame([(5000 + i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for params in (decontam.Params(), decontam.Params(block_chars=100)):
        found = decontam.matches(rows.withColumn("item_id", F.lit(1)), bench, params).collect()
        got[params.block_chars] = sorted((r.doc_id, r.item_id, r.distance) for r in found)
    assert got[2_000_000] == got[100]
    want = []
    for r in rows.where("text is not null and length(text) < 5000").collect():
        for i, t in items:
            item = decontam.normalised(t)
            if i is not None and len(item) >= 24:
                d = edit_distance_in(item, decontam.normalised(r.text))
                if d <= len(item) // 16:
                    want.append((r.doc_id, i, d))
    assert got[100] == sorted(want) and len(want) > 8
    kept = decontam.clean(rows, bench)
    assert kept.columns == rows.columns and kept.count() == rows.count() - len({w[0] for w in want})
    assert decontam.matches(empty, bench).count() == 0 and decontam.matches(rows, bench.limit(0)).count() == 0


DOCS_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def near_truth(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            n = len(sets[i] & sets[j])
            if i < j and n and 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def test_near_duplicates(spark, docs, empty):
    rng = random.Random(6)
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id is not null and doc_id <> 3").collect()]
    base = prose(rng, "en", 150).split()
    for i in range(60):  # a large group of near copies, some near enough and some not, and chains of them
        x = list(base)
        for _ in range(i % 6):
            x[rng.randrange(len(x))] = f"w{rng.randrange(10**6)}"
        rows.append((9000 - i, " ".join(x)))
    drift = list(base)
    for i in range(12):
        drift[rng.randrange(len(drift))] = f"d{i}"
        rows.append((9100 + i, " ".join(drift)))
    df = spark.createDataFrame([(*r, "k", "m") for r in rows], "doc_id long, text string, key string, mark string")
    for params in (minhash.Params(), minhash.Params(chunk=7), minhash.Params(crowd=0, listed=50, chunk=1000, block_shingles=900)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, params).collect()}
        assert got == near_truth(rows)


def test_near_duplicates_odd_rows(spark, empty):
    t = "one two three four five six"
    rows = [(None, t), (5, t), (5, t), (None, "a b c d e f g"), (None, "a b c d e f g"), (7, None), (8, ""), (9, "solo"), (10, "SOLO")]
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (None, 3, None, True), (None, 3, None, True), (7, 0, 7, True), (8, 0, 8, True), (9, 1, 9, True), (10, 1, 9, False)]
    assert got == sorted(map(str, want))
    assert minhash.near_duplicates(empty).count() == 0


def spied(monkeypatch):
    """Rows of the tables that the operator writes, by tag."""
    rows, plain = {}, minhash.written

    def counted(df, tag):
        out = plain(df, tag)
        rows.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(minhash, "written", counted)
    return rows


@pytest.mark.parametrize("n", [1000, 2000])
def test_common_passages_make_no_pairs(spark, monkeypatch, n):
    """Pages of 80 shared and 40 own words: none linked, and what meets grows with the pages, not with their square."""
    shared = " ".join(f"s{i}" for i in range(80))
    df = spark.createDataFrame([(k, shared + "".join(f" p{k}x{i}" for i in range(40))) for k in range(n)], "doc_id long, text string")
    rows = spied(monkeypatch)
    got = minhash.near_duplicates(df)
    assert got.where("kept").count() == n
    assert max(rows["mixed"]) <= 24 * n and sum(rows["across"]) < n / 10 and sum(rows["sets"]) < n / 2 and rows["rare"][0] < 30 * n


def test_many_near_copies_meet_in_proportion(spark, monkeypatch):
    """2,000 near copies of one text in blocks of 50: each set is copied about twice, not once for each block."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(2000):
        x = list(base)
        x[rng.randrange(200)] = f"v{rng.randrange(10**9)}"
        texts.append(" ".join(x))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, met = spied(monkeypatch), []
    first, second = minhash.first_round, minhash.second_round
    monkeypatch.setattr(minhash, "first_round", lambda d: met.append(first(d)) or met[-1])
    monkeypatch.setattr(minhash, "second_round", lambda *a: met.append(second(*a)) or met[-1])
    monkeypatch.setattr(minhash, "dropped", lambda *a: None)
    got = minhash.near_duplicates(df, minhash.Params(chunk=50))
    assert got.select("component_id").distinct().count() == 1 and sum(m.count() for m in met) < 3 * 2000 and rows["sets"] == [2000]


@pytest.mark.parametrize("edges, want", [([], {}), ([(1, 1)], {}), ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}), ([(5, 9), (9, 2), (7, 8), (8, 7)], {5: 2, 9: 2, 2: 2, 7: 7, 8: 7})])
def test_components(spark, edges, want):
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.id: r.component for r in components.connected_components(df).collect()} == want


def test_components_of_contracted_edges(spark, monkeypatch):
    """Stars, paths and random edges over many partitions, three edges held at once, against one union of all."""
    monkeypatch.setattr(components, "HELD", 3)
    rng = random.Random(11)
    edges = [(1000, i) for i in range(300)] + [(i, i + 1) for i in range(2000, 2060)] + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(220)]
    rng.shuffle(edges)
    hi, lo = np.array([max(e) for e in edges]), np.array([min(e) for e in edges])
    node, least = components.stars_of(hi, lo)
    want = dict(zip(node.tolist(), least.tolist(), strict=True))
    root = {n: n for e in edges for n in e}
    for _ in range(len(root)):
        before = dict(root)
        for x, y in edges:
            root[x] = root[y] = min(root[x], root[y])
        if root == before:
            break
    assert want == {n: r for n, r in root.items() if n != r}
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.id: r.component for r in components.connected_components(df).collect()}
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}
