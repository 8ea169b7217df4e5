"""Benchmark items inside documents by pigeonhole edit matching, verified with Myers' bit-parallel distance."""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import make_dir, new_dir, opened, worker_cache, written

NOT_WORD = re.compile(r"[\W_]+")
SCHEMA = "doc_id long, item_id long, distance long, budget long, at long, until long"


@dataclass(frozen=True)
class Params:
    """An item of m normalised characters has budget m // chars_per_edit; one shorter than min_chars is matched exactly,
    as whole words. With `unnamed`, items of null id are searched too, and reported under a null item_id. Items lie in
    files of about `block_chars` characters; a task that needs several of them reads each once for `spool_chars`
    characters of documents."""

    chars_per_edit: int = 16
    min_chars: int = 24
    block_chars: int = 2_000_000
    spool_chars: int = 64_000_000
    unnamed: bool = False


def normalised(text: str | None) -> str:
    """Lower case, every run of other than letters and digits one blank, none at the ends."""
    return NOT_WORD.sub(" ", (text or "").lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 near-equal pieces; `budget` edits leave at least one of them whole."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the substring of text nearest to pattern, the first of the best; None beyond budget."""
    m = len(pattern)
    ones, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    vp, vn, score = ones, 0, m
    best, end = budget + 1, -1
    for j, c in enumerate(text):
        x = eq.get(c, 0) | vn
        d0 = ((((x & vp) + vp) ^ vp) | x) & ones
        hp, hn = vn | ~(d0 | vp) & ones, vp & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        if score < best:
            best, end = score, j + 1
            if score == 0:
                break
        hp, hn = hp << 1 & ones, hn << 1 & ones
        vp, vn = hn | ~(d0 | hp) & ones, hp & d0
    return (best, end) if end >= 0 else None


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], params: Params):
        import ahocorasick

        self.items = [(i, t, len(t) // params.chars_per_edit if len(t) >= params.min_chars else 0) for i, t in items]
        self.short = [len(t) < params.min_chars for _, t in items]
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, budget) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                at.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item id, distance, budget, start at the latest, end) of the items found, once each, the nearest place."""
        hits: dict[int, set[int]] = {}
        whole: dict[int, int] = {}  # short items: the first place as whole words
        for end, (length, places) in self.automaton.iter(text):
            start = end + 1 - length
            for n, offset in places:
                if not self.short[n]:
                    hits.setdefault(n, set()).add(start - offset)
                elif n not in whole and text[max(0, start - 1) : start] in ("", " ") and text[end + 1 : end + 2] in ("", " "):
                    whole[n] = start
        found = [(self.items[n][0], 0, 0, start, start + len(self.items[n][1])) for n, start in whole.items()]
        for n, starts in hits.items():
            item_id, item, budget = self.items[n]
            best = None
            order, i = sorted(starts), 0
            while i < len(order):
                j = i  # hits whose windows overlap are searched together
                while j + 1 < len(order) and order[j + 1] - order[j] <= len(item):
                    j += 1
                lo, hi = max(0, order[i] - budget), order[j] + len(item) + budget
                i = j + 1
                if best is None or best[0]:
                    near = myers(item, text[lo:hi], budget if best is None else best[0] - 1)
                    if near:
                        best = (near[0], lo + near[1])
            if best:
                found.append((item_id, best[0], budget, best[1] - len(item), best[1]))
        return sorted(found, key=lambda f: (f[0] is not None, f[0] or 0, f[1:]))


def item_files(benchmark: DataFrame, params: Params) -> list[str]:
    """Writes the distinct normalised items into files of the shared folder, each of about block_chars characters (or
    one item), and returns their paths; the driver sees no item. A retried task's file counts only if named here."""
    spark = benchmark.sparkSession
    root = make_dir(spark, new_dir(spark, "items"))
    named = benchmark if params.unnamed else benchmark.where("item_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, paths = [], 0, []

        def close() -> None:
            paths.append(f"{root}/{uuid.uuid4().hex}.items")
            with opened(paths[-1], "wb") as out:
                out.write(pickle.dumps(block))
            block.clear()

        for batch in batches:
            for item_id, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = normalised(raw)
                if not text:
                    continue
                if block and held + len(text) > params.block_chars:
                    close()
                    held = 0
                block.append((item_id, text))
                held += len(text)
        if block:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    tasks = max(1, min(named.count() // 5_000, 1024))  # few items: one file
    rows = named.select("item_id", "text").distinct().repartition(tasks, "item_id", "text")
    return sorted(r.path for r in written(rows.mapInArrow(run, "path string"), "item-files").collect())


def _matcher(path: str, params: Params, keep: bool) -> Matcher:
    known = worker_cache(f"items {path}") if keep else {}
    if not known:
        with opened(path, "rb") as file:
            known["matcher"] = Matcher(pickle.loads(file.read()), params)
    return known["matcher"]


def _scanned(batches: Iterator[pa.RecordBatch], at: int, paths: list[str], params: Params) -> Iterator[tuple[pa.RecordBatch, list[list[tuple]]]]:
    """Each batch with what was found in its texts (column `at`). With one file of items texts pass one by one; with
    more, those of some batches are held while the files pass."""
    if len(paths) == 1:
        match = _matcher(paths[0], params, True)
        for batch in batches:
            yield batch, [match(normalised(t.as_py())) for t in batch.column(at)]
        return
    held: list[tuple[pa.RecordBatch, list[str]]] = []
    size = 0

    def emptied() -> Iterator[tuple[pa.RecordBatch, list[list[tuple]]]]:
        found: list[list[list[tuple]]] = [[[] for _ in texts] for _, texts in held]
        for path in paths:
            match = _matcher(path, params, False)
            for rows, (_, texts) in zip(found, held, strict=True):
                for row, text in zip(rows, texts, strict=True):
                    row += match(text)
        yield from ((batch, rows) for (batch, _), rows in zip(held, found, strict=True))
        held.clear()

    for batch in batches:
        texts = [normalised(t) for t in batch.column(at).to_pylist()]
        held.append((batch, texts))
        size += sum(map(len, texts))
        if size >= params.spool_chars:
            yield from emptied()
            size = 0
    yield from emptied()


def matches(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """A row (doc_id, item_id, distance, budget, at, until) for each document and item of which the document holds a
    stretch within the item's budget of edits; at and until are places in the normalised text.

    Items are a stated query set: they lie in files of bounded size in the shared folder, which the tasks of a single
    pass over the documents read; no text is shuffled. Every hit of every piece is verified; overlapping windows of an
    item are verified together.

    Null or empty texts match nothing, on either side. Items under min_chars match exactly, as whole words.
    Items of null id are searched with `params.unnamed` only. A repeated item text
    under several ids is found under each; an id with several texts stands for each of them. A null doc_id is carried along,
    repeated rows are reported as often as they occur. Other columns are ignored; empty tables give no rows.
    """
    paths = item_files(benchmark, params)
    if not paths:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _scanned(batches, 1, paths, params):
            rows = [
                (doc_id, item, distance, budget, max(at, 0), end)
                for doc_id, hits in zip(batch.column(0).to_pylist(), found, strict=True)
                for item, distance, budget, at, end in hits
            ]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return docs.select("doc_id", "text").where("text is not null").mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """Rows of docs, all columns, whose text holds no benchmark item, judged row by row where they are read. Rows of
    null doc_id or text are judged like others; rows that share a doc_id are judged each by its own text."""
    paths = item_files(benchmark, params)
    if not paths:
        return docs
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _scanned(batches, at, paths, params):
            yield batch.filter(pa.array([not hits for hits in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
