"""Licence phrases and texts in documents by a positional index of rare words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import FULL, TAGS

KEEP = 20_000  # sets of licence words whose anchors a task keeps
#: A template counts where this share of its weight stands near its mandatory phrases.
LEAST = 0.4
#: Weight at which the score of a whole match comes to 1 - 1/e.
WEIGHT = 12.0

#: Bytes of a word: 0-9, a-z (A-Z count as these) and all above 7F; the rest parts words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

# Base phrases and their labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Openings of public licence texts, their labels, and the phrases without which they don't count.
TEXTS = [
    ("apache license version 2 0", "apache-2.0", ["apache license version 2 0"]),
    ("gnu general public license version 2", "gpl-2.0", ["gnu general public license version 2"]),
    ("gnu general public license version 3", "gpl-3.0", ["gnu general public license version 3"]),
    ("gnu lesser general public license", "lgpl", ["gnu lesser general public license"]),
    ("gnu affero general public license", "agpl", ["gnu affero general public license"]),
    ("mozilla public license", "mpl", ["mozilla public license"]),
    ("cc by nc", "cc-by-nc", ["cc by nc"]),
    ("cc by sa", "cc-by-sa", ["cc by sa"]),
    ("cc by nd", "cc-by-nd", ["cc by nd"]),
    ("creative commons attribution", "cc-by", ["creative commons attribution"]),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction",
        "mit",
        ["permission is hereby granted", "without restriction"],
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "isc",
        ["for any purpose with or without fee"],
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that"
        " the following conditions are met",
        "bsd",
        ["redistribution and use in source and binary forms", "provided that the following conditions"],
    ),
    (
        "this is free and unencumbered software released into the public domain",
        "unlicense",
        ["free and unencumbered software", "public domain"],
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
        " public license as published by the free software foundation",
        "gpl",
        ["free software you can redistribute it", "gnu general public license"],
    ),
]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    base: bool = False
    without: tuple[bytes, ...] = ()  # phrases that rule the template out, with a blank at either end

    def place(self, key: int) -> int:
        """Where a mandatory phrase stands in the template."""
        k = self.keys[key]
        return next(i for i in range(len(self.words)) if self.words[i : i + len(k)] == k)


def _words(text: str) -> tuple[bytes, ...]:
    return tuple(text.encode().translate(TABLE).split())


def templates() -> list[Template]:
    """Base phrases, phrases and openings, full texts and notices, and tags."""
    out = [Template(label, _words(text), (_words(text),), True) for text, label in BASE]
    out += [Template(label, _words(text), tuple(map(_words, keys))) for text, label, keys in TEXTS]
    spaced = lambda t: b" " + b" ".join(_words(t)) + b" "
    out += [Template(label, _words(text), tuple(map(_words, keys)), False, tuple(map(spaced, no))) for label, text, keys, no in FULL]
    tags = [(f"SPDX-License-Identifier: {name}", label) for name, label in TAGS]
    return out + [Template(label, _words(text), (_words(text),)) for text, label in tags]


def blocks(data: bytes, overlap: int, size: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """(number of the first word, words repeated from the block before, words), a bounded part of the text each."""
    carry: list[bytes] = []
    done, at, rest = 0, 0, b""
    while at < len(data) or at == 0:
        part = rest + data[at : at + size].translate(TABLE)
        at += size
        rest = b""
        if at < len(data):
            cut = part.rfind(b" ") + 1
            if cut == 0:
                rest = part  # one word is longer than a block
                continue
            part, rest = part[:cut], part[cut:]
        words = carry + part.split()
        yield done - len(carry), len(carry), words
        done += len(words) - len(carry)
        carry = words[-overlap:] if overlap else []


def frequencies(docs: DataFrame, text: str = "text") -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of those that hold each word of a template: one pass, a sum for each word."""
    vocabulary = {w for t in templates() for w in t.words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {b"": 0}
        for batch in batches:
            for data in batch.column(0).to_pylist():
                counts[b""] += 1
                held: set[bytes] = set()
                for _, _, words in blocks(data, 0):
                    held |= vocabulary.intersection(words)
                for w in held:
                    counts[w] = counts.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    body = docs.select(F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    found = {bytes(r.word): r.n for r in body.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found.pop(b"", 0), found


class Index:
    """Templates, the weights of their words, and postings: licence word -> (template, phrase, place in the phrase)."""

    def __init__(self, n: int, df: dict[bytes, int], rare: int = 2):
        self.templates, self.rare = templates(), rare
        self.idf = {w: math.log(1 + n / (1 + df.get(w, 0))) for t in self.templates for w in t.words}
        self.vocabulary = frozenset(self.idf)
        self.weight = [sum(self.idf[w] for w in t.words) for t in self.templates]
        self.postings: dict[bytes, list[tuple[int, int, int]]] = {}
        for t, template in enumerate(self.templates):
            for k, key in enumerate(template.keys):
                for i, w in enumerate(key):
                    self.postings.setdefault(w, []).append((t, k, i))
        self.overlap = 3 * max(len(t.words) for t in self.templates)
        self.kept: dict[frozenset[bytes], tuple[dict[bytes, list[tuple[int, int, int]]], dict[tuple[int, int], int]]] = {}

    def anchors(self, held: frozenset[bytes]) -> tuple[dict[bytes, list[tuple[int, int, int]]], dict[tuple[int, int], int]]:
        """For the licence words of a file: the postings to look up, and how many of them a phrase needs at one place.

        Only templates all of whose phrases' words are in the file can count. The file's words are gone through by
        falling weight; a word is looked up for the phrases that hold it and have fewer than `rare` words as yet."""
        if held in self.kept:
            return self.kept[held]
        able = {t for t, template in enumerate(self.templates) if all(held.issuperset(key) for key in template.keys)}
        wanted: dict[bytes, list[tuple[int, int, int]]] = {}
        needed: dict[tuple[int, int], int] = {}
        for w in sorted(held, key=lambda w: (-self.idf[w], w)):
            for t, k, i in self.postings.get(w, ()):
                if t in able and needed.get((t, k), 0) < self.rare:
                    wanted.setdefault(w, []).append((t, k, i))
                    needed[t, k] = needed.get((t, k), 0) + 1
        if len(self.kept) >= KEEP:
            self.kept.clear()
        self.kept[held] = wanted, needed
        return wanted, needed

    def phrases(self, words: list[bytes]) -> dict[int, dict[int, list[int]]]:
        """template -> phrase -> places in words: the file's rarest words of the phrase agree on the place, and it stands
        there whole."""
        held = self.vocabulary.intersection(words)
        wanted, needed = self.anchors(held)
        if not wanted:
            return {}
        votes: dict[tuple[int, int, int], int] = {}
        for at, w in enumerate(words):
            if w in wanted:
                for t, k, i in wanted[w]:
                    votes[t, k, at - i] = votes.get((t, k, at - i), 0) + 1
        found: dict[int, dict[int, list[int]]] = {}
        for (t, k, at), n in sorted(votes.items()):
            key = self.templates[t].keys[k]
            if n == needed[t, k] and at >= 0 and tuple(words[at : at + len(key)]) == key:
                found.setdefault(t, {}).setdefault(k, []).append(at)
        return found

    def share(self, t: int, hits: dict[int, list[int]], words: list[bytes]) -> float:
        """Share of the template's weight that stands, word for word, near the best place at which all its mandatory
        phrases stand about as far apart as in it; 0 if there is none."""
        template = self.templates[t]
        if len(hits) < len(template.keys):
            return 0.0
        slack, best = len(template.words) // 2, 0.0
        for at in hits[0]:
            start = at - template.place(0)
            if not all(any(abs(h - template.place(k) - start) <= slack for h in hits[k]) for k in hits):
                continue
            near = words[max(0, start - slack) : start + len(template.words) + slack]
            if template.without and any(x in b" " + b" ".join(near) + b" " for x in template.without):
                continue
            left = Counter(near)
            got = sum(min(n, left[w]) * self.idf[w] for w, n in Counter(template.words).items()) / self.weight[t]
            best = max(best, got)
            if got > 0.999:
                break
        return best if best >= LEAST else 0.0

    def scan(self, data: bytes) -> tuple[int, int, int | None, int | None, set[str], set[str], float]:
        """(words, base places, first, last, base labels, labels, score) of one text."""
        n, count, first, last, base, labels, score = 0, 0, None, None, set(), set(), 0.0
        for start, again, words in blocks(data, self.overlap):
            n = start + len(words)
            for t, hits in self.phrases(words).items():
                template = self.templates[t]
                if template.base:
                    size = len(template.words)
                    new = [start + at for at in hits[0] if at + size > again]  # else counted in the block before
                    if new:
                        count += len(new)
                        first = new[0] if first is None else min(first, new[0])
                        last = new[-1] if last is None else max(last, new[-1])
                        base.add(template.label)
                        score = max(score, 1 - math.exp(-self.weight[t] / WEIGHT))
                    continue
                share = self.share(t, hits, words)
                if share > 0:
                    labels.add(template.label)
                    score = max(score, share * (1 - math.exp(-share * self.weight[t] / WEIGHT)))
        return n, count, first, last, base, base | labels, score


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Pass 1 counts in how many documents each licence word occurs. Pass 2 looks up each file's licence words of highest
    inverse document frequency, keeps places on which the postings of a phrase agree, and verifies the phrase word by
    word; a template counts where all its mandatory phrases stand about as far apart as in it, none that rules it out is
    there, and LEAST of its weight stands near. score is the best, over labels, of that share times
    1 - exp(-weight found / WEIGHT): a whole text is near 1, an altered one less, a bare mention by the rareness of its
    words; 0 with no label. Texts are read in parts of 1 MB that overlap by more than any template.

    Null text is empty: no words, no labels (empty strings), null places. Repeated rows and null ids are carried
    along, other columns ignored. An empty table gives no rows.
    """
    index = Index(*frequencies(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [index.scan(data) for data in batch.column(1).to_pylist()]
            columns = list(zip(*found, strict=True)) if found else [[]] * 7
            joined = [pa.array([",".join(sorted(x)) for x in c], pa.string()) for c in columns[4:6]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *joined, pa.array(columns[6], pa.float64())],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    body = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return body.mapInArrow(run, schema)
