"""Merkle manifests against trees built plainly in memory, whatever the parts, the fanout and the blocks."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sightline.llm import merkle
from sightline.llm.merkle import CLOSED, OPEN, TOP, Params, Peaks

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def siblings_of(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        start = i - i % fanout
        out.append((level[start:i], level[i + 1 : start + fanout]))
        i //= fanout
    return out


def plain(rows, fanout=3):
    """Rows as dicts of the fields and `other`, a changed text or None."""

    def leaf(r, text):
        values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    trees = {}
    for r in rows:
        trees.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = [levels_of([x[2] for x in sorted(trees[s], key=lambda x: x[:3])], fanout) for s in names]
    crown = levels_of([x[-1][0] for x in built], fanout)
    out = []
    for k, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            steps = siblings_of(built[k], i, fanout) + siblings_of(crown, k, fanout)
            at = leaf(r, r["other"]) if r["changed"] else own
            for left, right in steps:
                at = h(*left, at, *right)
            proof = h(*(x for left, right in steps for x in [*left, *right]))
            out.append((r["doc_id"], own, built[k][-1][0], crown[-1][0], proof, at, at == crown[-1][0]))
    return sorted(out, key=str)


def check(spark, rows, params=Params()):
    schema = "doc_id long, source string, lang string, n_chars long, text string, changed boolean, part long, digest string"
    df = spark.createDataFrame([(*(r[c] for c in FIELDS), r["changed"], 1, "x") for r in rows], schema)
    text = {"text": F.replace("text", F.lit("\n"), F.lit(""))}
    got = merkle.verified(df, "source", "doc_id", FIELDS, text, F.col("changed"), params)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, params.fanout)


def row(rng, i, source):
    text = rng.choice([None, "", "a\nb", "é\n\n", "plain", "x" * 300])
    return {
        "doc_id": i, "source": source, "lang": rng.choice([None, "de"]), "n_chars": rng.choice([None, 7]), "text": text,
        "changed": rng.choice([True, False, None]), "other": None if text is None else text.replace("\n", ""),
    }


@pytest.mark.parametrize("params", [Params(), Params(fanout=2, tier=3, part_rows=40), Params(tier=1, part_rows=7), Params(fanout=5, tier=2, part_rows=100)])
def test_trees_over_many_parts(spark, params):
    """Sources of all small sizes, one of most rows, null, empty and odd names, null and repeated ids, equal rows."""
    rng = random.Random(5)
    names = [None, "", "=", "z", "é", "\U0001f600", "￮", "a"]
    rows = [row(rng, i, names[k]) for k, n in enumerate([1, 2, 3, 4, 9, 10, 28, 300]) for i in rng.sample(range(-50, 1000), n)]
    rows += [row(rng, None, "z"), row(rng, None, "z"), row(rng, 3, "a"), row(rng, 3, "a")] + [row(rng, 5, "twice")] * 4
    check(spark, rows, params)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_few_rows(spark, n):
    rng = random.Random(n)
    check(spark, [row(rng, i, "s") for i in range(n)])
    check(spark, [row(rng, i, f"s{i}") for i in range(n)])


def test_no_rows(empty):
    assert merkle.verified(empty, "source", "doc_id", FIELDS, {}, F.lit(True)).collect() == []


@pytest.mark.parametrize("fanout", [2, 3])
def test_peaks_of_stretches(fanout):
    """Any cuts of a row of leaves: what is handed out, with the parents of what is open, is the whole tree."""
    rng = random.Random(fanout)
    for n in [*range(1, 30), 100, 243]:
        leaves = [h(str(i)) for i in range(n)]
        want = {(lv, i): d for lv, level in enumerate(levels_of(leaves, fanout)) for i, d in enumerate(level)}
        cuts = sorted({0, n, *(rng.randrange(n) for _ in range(rng.randrange(4)))})
        got, states = {}, {}
        for a, b in zip(cuts, cuts[1:], strict=False):
            def out(level, i, digest, state):
                assert (level, i) not in got
                got[level, i], states[level, i] = digest, state

            peaks = Peaks(fanout, out)
            for i in range(a, b):
                peaks.add(i, leaves[i])
            peaks.close(b == n)
        assert all(want[k] == d for k, d in got.items())
        tops = [k for k, s in states.items() if s == TOP]
        assert len(tops) <= 1 and all(want[k] == want[max(want)] for k in tops)
        for (level, i), s in states.items():
            parent = (level + 1, i // fanout)
            assert s == TOP or (parent in got) == (s == CLOSED)
            assert s != OPEN or len(cuts) > 2
