"""Language identification by unigram pieces, summed over all segmentations of a word."""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, worker_cache

LETTERS = re.compile(r"[^\W\d_]+")
CACHE_BYTES = 64 << 20  # sums of words that a worker keeps
BLOCK = 32  # letters between two rescalings of the sums
PART_WORDS = 300_000  # words looked up at once
ROWS = 1_000  # documents held as Python strings at once
SPANS = 16_384  # spans summed at once
BASE, MIX, SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(44)


@dataclass(frozen=True)
class Params:
    """Learning looks at `train_docs` labelled documents at most, those of the smallest hash of their id. A character
    outside the vocabulary has probability `other`. Probabilities of pieces are estimated in `rounds` rounds; a share
    of `even` is dealt out evenly to all pieces, so that what no language has shown tells none from another."""

    train_docs: int = 10_000
    rounds: int = 3
    even: float = 0.001
    other: float = 1e-7
    und: str = "und"


def words(text: str) -> list[str]:
    """Runs of letters, lower case."""
    found = LETTERS.findall(text.lower())
    return found if text.isascii() else [w for r in found for w in ([r] if r.isalpha() else re.findall(r"\w+", "".join(c if c.isalpha() else " " for c in r)))]


def vocabulary(path: str) -> list[str]:
    """Pieces of letters, with or without the mark of a word's start, in the order of the public vocabulary."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))
    return list(dict.fromkeys(p.lower() for p in pieces if p == "▁" or p.removeprefix("▁").isalpha()))


class Lattice:
    """Arcs of all segmentations of a word over the vocabulary, and sums over them."""

    def __init__(self, pieces: list[str], params: Params):
        self.index = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.params, self.unknown = params, len(pieces)
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, BASE)]), dtype=np.uint64)
        hashes = np.zeros(len(pieces), np.uint64)
        for i, piece in enumerate(pieces):
            h = 0
            for c in piece:
                h = (h * int(BASE) + ord(c) + 1) % 2**64
            hashes[i] = h
        self.pieces = np.argsort(hashes)
        self.hashes = hashes[self.pieces]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.hashes * MIX) >> SHIFT] = True

    def arcs(self, span: str, start: int, end: int) -> list[list[tuple[int, int]]]:
        """For each end position in start+1..end the (start, piece) that reach it; a character of no piece is one."""
        get, out = self.index.get, []
        for j in range(start + 1, end + 1):
            here = [(i, piece) for i in range(max(0, j - self.longest), j) if (piece := get(span[i:j])) is not None]
            if not here or here[-1][0] != j - 1:
                here.append((j - 1, self.unknown))
            out.append(here)
        return out

    def log_probs(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log-probability of each word in each language: the sum over all segmentations of the whole word, p[piece]
        holding a value a language. Words of up to BLOCK letters are summed many at a time, longer ones one by one."""
        total = np.empty((len(words), p.shape[1]))
        spans = sorted((f"▁{w}", i) for i, w in enumerate(words) if len(w) <= BLOCK)
        # sorted spans share their beginnings with their neighbours, so blocks lose next to nothing and bound the arrays
        for k in range(0, len(spans), SPANS):
            text, at = zip(*spans[k : k + SPANS], strict=True)
            total[list(at)] = np.log(self.forward(list(text), p))
        for i, w in enumerate(words):
            if len(w) > BLOCK:
                total[i] = self.log_prob(f"▁{w}", p)
        return total

    def log_prob(self, span: str, p: np.ndarray) -> np.ndarray:
        """The same sum for one span of any length. What a place needs are the sums of the `longest` places before it;
        those are carried on and rescaled every BLOCK letters, so nothing underflows and memory stays the same."""
        held, scale = [np.ones(p.shape[1])], np.zeros(p.shape[1])  # sums of the places first..j
        first = 0
        for start in range(0, len(span), BLOCK):
            for here in self.arcs(span, start, min(len(span), start + BLOCK)):
                held.append(sum(held[i - first] * p[piece] for i, piece in here))
            held, first = held[-self.longest :], first + max(0, len(held) - self.longest)
            most = np.max(held, axis=0)
            held, scale = [h / most for h in held], scale + np.log(most)
        return np.log(held[-1]) + scale

    def coded(self, spans: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths, characters and running hashes of spans."""
        size = np.array([len(s) for s in spans])
        width = int(size.max())
        code = np.array(spans, f"<U{width}").view("<u4").reshape(len(spans), width).astype(np.uint64)
        sums = np.zeros((len(spans), width + 1), np.uint64)
        for j in range(width):
            sums[:, j + 1] = sums[:, j] * BASE + code[:, j] + np.uint64(1)
        return size, code, sums

    def found(self, sums: np.ndarray, rows: np.ndarray, j: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the rows have a piece of n characters that ends at j, and that piece, by the hash of its characters."""
        h = sums[rows, j] - sums[rows, j - n] * self.powers[n]
        hit = np.flatnonzero(self.sieve[(h * MIX) >> SHIFT])
        at = np.minimum(np.searchsorted(self.hashes, h[hit]), len(self.hashes) - 1)
        ok = self.hashes[at] == h[hit]
        hit, piece = hit[ok], self.pieces[at[ok]]
        if n == 1:  # a character of no piece
            rest = np.ones(len(rows), bool)
            rest[hit] = False
            rest = np.flatnonzero(rest)
            hit, piece = np.concatenate([hit, rest]), np.concatenate([piece, np.full(len(rest), self.unknown)])
        return hit, piece

    def forward(self, spans: list[str], p: np.ndarray) -> np.ndarray:
        """Sum over all segmentations of each of the sorted spans.

        The sums up to a place depend on what stands before it alone. Spans that begin alike lie beside each other, so
        each distinct beginning is worked out once, a length at a time and all of that length together."""
        size, code, sums = self.coded(spans)
        width = code.shape[1]
        fresh = np.ones(code.shape, bool)  # the beginning up to here is not the one of the span before
        fresh[1:] = np.logical_or.accumulate(code[1:] != code[:-1], axis=1)
        fresh &= np.arange(width) < size[:, None]
        node = np.cumsum(fresh, axis=0) - 1
        alpha = [np.ones((1, p.shape[1]))]
        for j in range(1, width + 1):
            rows = np.flatnonzero(fresh[:, j - 1])
            now = np.zeros((len(rows), p.shape[1]))
            for n in range(1, min(j, self.longest) + 1):
                hit, piece = self.found(sums, rows, j, n)
                start = np.zeros(len(hit), np.int64) if j == n else node[rows[hit], j - n - 1]
                now[hit] += alpha[j - n][start] * p[piece]
            alpha.append(now)
        out = np.empty((len(spans), p.shape[1]))
        for j in range(1, width + 1):
            here = np.flatnonzero(size == j)
            out[here] = alpha[j][node[here, j - 1]]
        return out

    def expected_many(self, words: list[str], p: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> None:
        """expected() for many words in one language; those of up to BLOCK letters are worked out together."""
        short = [i for i, w in enumerate(words) if len(w) <= BLOCK]
        plain = p.tolist() if len(short) < len(words) else []
        for i, w in enumerate(words):
            if len(w) > BLOCK:
                self.expected(w, plain, counts, float(weights[i]))
        short.sort(key=lambda i: len(words[i]))
        for k in range(0, len(short), SPANS // 4):
            some = short[k : k + SPANS // 4]
            size, code, sums = self.coded([f"▁{words[i]}" for i in some])
            width = code.shape[1]
            ahead, back = np.zeros((len(some), width + 1)), np.zeros((len(some), width + 1))
            ahead[:, 0] = 1
            back[np.arange(len(some)), size] = 1
            arcs = []
            for j in range(1, width + 1):
                rows = np.flatnonzero(size >= j)
                for n in range(1, min(j, self.longest) + 1):
                    hit, piece = self.found(sums, rows, j, n)
                    if len(hit):
                        arcs.append((rows[hit], j, n, piece))
                        ahead[rows[hit], j] += ahead[rows[hit], j - n] * p[piece]
            share = weights[some] / ahead[np.arange(len(some)), size]
            for rows, j, n, piece in reversed(arcs):
                use = p[piece] * back[rows, j]
                back[rows, j - n] += use
                counts += np.bincount(piece, share[rows] * ahead[rows, j - n] * use, len(counts))

    def expected(self, word: str, p: list[float], counts: np.ndarray, weight: float) -> None:
        """Adds the expected number of uses of each piece in `weight` words, by forward and backward sums over the
        whole word. Sums are rescaled at the end of each block of `step` places; ahead[b] and back[b] are the logarithms
        of the factors taken out of the sums of block b, and a sum of the block next door is brought to b's scale."""
        span = f"▁{word}"
        n, step = len(span), max(BLOCK, self.longest)
        blocks = range(0, n, step)
        kept = [self.arcs(span, 0, n)] if n <= step else None  # arcs of a long word are found anew for each pass
        forward, backward = array("d", [0.0]) * (n + 1), array("d", [0.0]) * (n + 1)
        forward[0] = backward[n] = 1.0
        ahead, back = [0.0] * len(blocks), [0.0] * len(blocks)
        for b, start in enumerate(blocks):
            end, by = min(n, start + step), 1.0
            if b:
                most = max(forward[max(0, start - self.longest) : start + 1])
                by, ahead[b] = 1 / most, ahead[b - 1] + math.log(most)
            for j, here in enumerate(kept[0] if kept else self.arcs(span, start, end), start + 1):
                forward[j] = sum((forward[i] if i > start or not b else forward[i] * by) * p[piece] for i, piece in here)
        whole = math.log(forward[n]) + ahead[-1]
        for b in reversed(range(len(blocks))):  # block b has the sums of the places start + 1..end, and place 0 at first
            start, end = blocks[b], min(n, blocks[b] + step)
            here = kept[0] if kept else self.arcs(span, start, end)
            if b + 1 < len(blocks):
                most = max(backward[start + 1 : end + 1])
                back[b] = back[b + 1] + math.log(most)
                for j in range(start + 1, end + 1):
                    backward[j] /= most
            share = weight * math.exp(ahead[b] + back[b] - whole)
            up = math.exp(ahead[b - 1] - ahead[b]) if b else 1.0  # forward sums of the block before, in this one's scale
            for j in range(end, start, -1):
                for i, piece in here[j - start - 1]:
                    use = p[piece] * backward[j]
                    backward[i] += use
                    counts[piece] += share * (forward[i] if i > start or not b else forward[i] * up) * use


@dataclass(frozen=True)
class Model:
    languages: list[str]
    pieces: list[str]
    p: np.ndarray  # piece x language; the last row is for characters of no piece
    params: Params


def fit(docs: DataFrame, vocabulary_path: str, params: Params = Params()) -> Model:
    """Piece probabilities of each language in docs(doc_id, text, lang), by expectation and maximisation.

    Word counts of the sample are one Spark aggregation, and each round is another over those counts; the driver gets
    a number for each language and piece, so at most languages x vocabulary. Rows of null text, id or language teach
    nothing; rows that repeat an id are all read, whichever of them are there, and count as often as they occur. Other
    columns of docs are ignored. Words of any length are read whole.
    """
    pieces = vocabulary(vocabulary_path)
    lattice = Lattice(pieces, params)
    known = docs.where("doc_id is not null and text is not null and lang is not null")
    ids = known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.train_docs).distinct()
    sample = known.join(F.broadcast(ids), "doc_id").select("lang", "text")  # at most train_docs longs

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in words(text):
                    counts[lang, w] = counts.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())],
                names=["lang", "word", "n"],
            )

    counted = sample.mapInArrow(split, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = counted.persist()
    languages = sorted(r.lang for r in counted.select("lang").distinct().collect())
    if not languages:
        return Model([], pieces, np.zeros((len(pieces) + 1, 0)), params)
    place = {x: k for k, x in enumerate(languages)}
    p = np.full((len(pieces) + 1, len(languages)), 1.0 / len(pieces))
    p[-1] = params.other

    def expect(batches: Iterator[pa.RecordBatch], p: np.ndarray) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(p.shape)
        for batch in batches:
            lang = np.array([place[x] for x in batch.column(0).to_pylist()])
            every, weights = np.array(batch.column(1).to_pylist(), object), batch.column(2).to_numpy().astype(float)
            for k in np.unique(lang):
                rows, into = np.flatnonzero(lang == k), np.zeros(len(p))
                lattice.expected_many(every[rows].tolist(), p[:, k], into, weights[rows])
                counts[:, k] += into
        piece, k = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(k, pa.int64()), pa.array(counts[piece, k])], names=["piece", "k", "n"])

    for _ in range(params.rounds):
        sums = counted.mapInArrow(lambda b, p=p: expect(b, p), "piece long, k long, n double").groupBy("piece", "k").agg(F.sum("n").alias("n"))
        n = np.full(p.shape, 1e-9)
        got = sums.toPandas()
        n[got["piece"], got["k"]] += got["n"]
        p = (1 - params.even) * n[:-1] / n[:-1].sum(0) + params.even / len(pieces)
        p = np.vstack([p, np.full(len(languages), params.other)])
    counted.unpersist()
    return Model(languages, pieces, p, params)


def _teller(spark, model: Model):
    """A function for tasks: texts to languages, scores and numbers of words."""
    params, key = model.params, uuid.uuid4().hex
    small_batches(spark)
    held = spark.sparkContext.broadcast((model.languages, model.pieces, model.p))  # languages x vocabulary numbers

    def tell(texts: list[str | None]) -> tuple[list[str], list[float], list[int]]:
        known = worker_cache(f"words {key}")  # the words met, from task to task
        if not known:
            languages, pieces, p = held.value
            keep = max(1024, CACHE_BYTES // (16 * max(1, len(languages))))
            tables = np.empty((keep, len(languages))), np.empty((keep, len(languages)))
            known["all"] = (languages, Lattice(pieces, params), p, {}, *tables)
        languages, lattice, p, index, table, sure = known["all"]
        total, each = np.zeros((len(texts), len(languages))), np.zeros((len(texts), len(languages)))
        many = np.zeros(len(texts), np.int64)
        part: list[tuple[int, list[str]]] = []

        def told() -> None:
            new = {w for _, ws in part for w in ws}.difference(index)
            if len(index) + len(new) > len(table):
                index.clear()
                new = {w for _, ws in part for w in ws}
            if new:
                logs = lattice.log_probs(list(new), p)
                at = slice(len(index), len(index) + len(new))
                table[at] = logs
                logs = np.exp(logs - logs.max(1, keepdims=True))
                sure[at] = logs / logs.sum(1, keepdims=True)
                index.update(zip(new, range(at.start, at.stop), strict=True))
            for i, ws in part:
                rows = np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))
                total[i] += table[rows].sum(0)
                each[i] += sure[rows].sum(0)
            part.clear()

        size = 0
        for i, text in enumerate(texts):
            found = words(text) if text and languages else []
            many[i] = len(found)
            for k in range(0, len(found), len(table)):  # a part never has more words than the table has rows
                some = found[k : k + len(table)]
                if size + len(some) > min(len(table), PART_WORDS):
                    told()
                    size = 0
                part.append((i, some))
                size += len(some)
        told()
        pred, score = [params.und] * len(texts), [0.0] * len(texts)
        for i in np.flatnonzero(many):
            best = int(total[i].argmax())
            pred[i], score[i] = languages[best], float(each[i, best] / many[i])
        return pred, score, many.tolist()

    return tell


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        yield from (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, lang_pred, score, n_words.

    The language is the one under which the text, all its words together, is likeliest, languages being equally likely
    beforehand. score is the mean over the words of each word's own probability of being of that language: near 1 where
    nearly every word speaks for it, about one in the number of languages for words that no language has shown; 0 for
    `und`.

    Null text and text without a letter are `und`; so is all text if nothing was learned. Equal scores go to the
    first language by name. Only doc_id and text are looked at. Repeated rows and null ids are carried along; an
    empty table gives no rows.
    """
    tell = _teller(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            pred, score, many = tell(batch.column(1).to_pylist())
            columns = [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(many, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_words long")


def recognised(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, all columns, whose text has a language with a score of `least` or more, judged row by row
    where they are read. If nothing was learned there is no ground to reject a text with letters."""
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    tell, at = _teller(docs.sparkSession, model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            pred, score, _ = tell(batch.column(at).to_pylist())
            keep = [x != model.params.und and y >= least for x, y in zip(pred, score, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
