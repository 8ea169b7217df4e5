"""Spelling variants: words one edit apart, by generating every word one edit away and joining these to the vocabulary."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, text_bytes, written

HELD = 200_000  # distinct words that a task counts before it hands them on
BATCH = 1 << 21  # generated words of a batch

#: Odd base of the hashes of words in the filter, modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    """Words have `letters` letters or more and occur `least` times or more. One in `slips` of a document's distinct runs
    loses a letter. A word's form is `ratio` times as frequent or more. The filter that goes to all tasks has `bits`
    bits a word, 2 ** `most` bits at most."""

    letters: int = 7
    least: int = 2
    slips: int = 31
    ratio: int = 10
    bits: int = 32
    most: int = 28


def counted(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Rows (word, n) of the distinct words of docs(doc_id, text), counted in whole texts, before any limit on n.

    Letters are A-Z, a-z and U+00C0 to U+00FF, each one byte of Latin-1; every other character parts runs.
    """
    runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % p.letters)

    def words(doc_id: int | None, text: bytes) -> Iterator[tuple[bytes, int]]:
        letters = text.decode("utf-8", "replace").encode("latin-1", "replace").lower()  # bytes: A-Z only
        seed = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
        seed = zlib.crc32(b":", seed)
        for run, n in Counter(runs.findall(letters)).items():
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
            if h % p.slips == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= p.letters:
                yield run, n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            names = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                for word, n in words(doc_id.as_py(), text.as_py()):
                    held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, np.uint64)]))


def hashes(words: np.ndarray) -> np.ndarray:
    """Polynomial hashes of words of one length, a row of letters each."""
    with np.errstate(over="ignore"):
        return (words.astype(np.uint64) * _powers(words.shape[1])[: words.shape[1]]).sum(1, dtype=np.uint64)


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """Where hashes stand in a filter of 2 ** bits bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def by_length(words: list[bytes]) -> Iterator[np.ndarray]:
    groups: dict[int, list[bytes]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for length, group in groups.items():
        yield np.frombuffer(b"".join(group), np.uint8).reshape(-1, length)


def neighbourhood(words: np.ndarray, alphabet: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """The hashes of all words one edit away from words of one length: (kind, hashes[word, place, letter]).

    Kinds are deletions (one place a letter of the word, no letter), replacements and insertions (a letter of the
    alphabet). Some are equal: insertions beside an equal letter, deletions within a run of one, and replacements
    of a letter by itself, which give the word.
    """
    n = words.shape[1]
    power, x = _powers(n + 1), words.astype(np.uint64)
    letters = np.frombuffer(alphabet, np.uint8).astype(np.uint64)
    terms = x * power[:n]
    before = np.concatenate([np.zeros((len(words), 1), np.uint64), np.cumsum(terms, 1, dtype=np.uint64)], 1)  # of the first i letters
    after = before[:, -1:] - before  # of those from i on, where they stand
    later = np.concatenate([np.cumsum((x * power[1 : n + 1])[:, ::-1], 1, dtype=np.uint64)[:, ::-1], np.zeros((len(words), 1), np.uint64)], 1)  # a place on
    sooner = np.concatenate([np.zeros((len(words), 1), np.uint64), x[:, 1:] * power[: n - 1]], 1)
    sooner = np.concatenate([np.cumsum(sooner[:, ::-1], 1, dtype=np.uint64)[:, ::-1], np.zeros((len(words), 1), np.uint64)], 1)  # a place back
    yield "delete", (before[:, :n] + sooner[:, 1:])[:, :, None]
    yield "replace", (before[:, :n] + after[:, 1:])[:, :, None] + power[:n, None] * letters
    yield "insert", (before + later)[:, :, None] + power[: n + 1, None] * letters


def edited(word: bytes, kind: str, at: int, letter: int) -> bytes:
    end = word[at:] if kind == "insert" else word[at + 1 :]
    return word[:at] + (b"" if kind == "delete" else bytes([letter])) + end


def _filter(vocabulary: DataFrame, size: int) -> np.ndarray:
    """A bitmap of 2 ** size bits with those of the vocabulary's hashes set, made of its words of 64 bits."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [places(hashes(x), size) for x in by_length([w.encode("latin-1") for w in batch.column(0).to_pylist()])]
            if found:
                at = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["word", "bit"])

    marked = vocabulary.select("word").mapInArrow(mark, "word long, bit long").groupBy("word").agg(F.expr("bit_or(bit)").alias("bits"))
    field = np.zeros(1 << (size - 6), np.int64)
    for part in marked.toArrow().to_batches():  # 2 ** (size - 6) rows at most
        field[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return field


def alphabet_of(vocabulary: DataFrame) -> bytes:
    """The letters of the vocabulary's words, in order: 128 at most."""
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).distinct().where("c <> ''")
    return b"".join(sorted(r.c.encode("latin-1") for r in letters.collect()))


def candidates(vocabulary: DataFrame, p: Params = Params()) -> DataFrame:
    """Rows (word, near): of all distinct deletions, replacements and insertions of the vocabulary's words, over the
    letters that occur in it, those that a filter of the vocabulary lets through. All words of it pass, and of others
    about one in `bits` while it is of its full size; it bounds what is shuffled and decides nothing."""
    spark = vocabulary.sparkSession
    many = vocabulary.count()
    size = min(p.most, max(10, int(many * p.bits).bit_length()))
    alphabet, field = alphabet_of(vocabulary), spark.sparkContext.broadcast(_filter(vocabulary, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field_here = field.value
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            for rows in by_length(words):
                step = max(1, BATCH // ((rows.shape[1] + 1) * max(1, len(alphabet))))
                for i in range(0, len(rows), step):
                    some, pairs = rows[i : i + step], set()
                    for kind, h in neighbourhood(some, alphabet):
                        at = places(h, size)
                        hits = np.nonzero((field_here[at >> 6] >> (at & 63)) & 1)
                        for k, place, letter in zip(*(x.tolist() for x in hits), strict=True):
                            word = some[k].tobytes()
                            near = edited(word, kind, place, alphabet[letter])
                            if near != word:
                                pairs.add((word, near))
                    if pairs:
                        yield pa.RecordBatch.from_arrays([pa.array([x[j].decode("latin-1") for x in pairs], pa.string()) for j in (0, 1)], names=["word", "near"])

    return vocabulary.select("word").mapInArrow(run, "word string, near string")


def variants(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """Per word of docs(doc_id, text): word, n, n_near, form, form_n, root.

    Words are counted in whole texts (A-Z lower-cased) with the slips of Params. Two are near if one edit parts them; the
    neighbourhood of each word is generated in full and joined to the vocabulary by equality, so that no distance is
    computed. A word's form is its most frequent near word (ties: the first in code-point order) if that is `ratio`
    times as frequent; root follows forms to the last, in a number of joins that grows with the logarithm of the
    longest chain, which is short as every form is `ratio` times as frequent as the one before.

    Null and empty texts have no words; a null doc_id counts as an empty one in the hash of its runs; repeated rows
    count as often as they occur. Other columns are not looked at. An empty table gives no rows.
    """
    p, spark = params, docs.sparkSession
    vocabulary = written(counted(docs, p).where(F.col("n") >= p.least), "vocabulary")
    met = written(candidates(vocabulary, p), "candidates")
    near = met.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    rows = vocabulary.join(best, "word", "left")
    form_n = -F.col("best.less")
    formed = form_n >= p.ratio * F.col("n")
    rows = written(
        rows.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best.form")).alias("form"), F.when(formed, form_n).alias("form_n")
        ),
        "forms",
    )
    steps = written(rows.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    made = [vocabulary, met]
    while True:  # each round doubles how far a root is followed
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        made.append(steps)
        steps = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    out = written(rows.join(steps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")), "variants")
    dropped(spark, *made, steps, rows)
    return out
