"""Whole texts to ids of a public tokenizer, with the ids of repeated chunks kept.

Both vocabularies part a text before they look pieces up: never inside a run of letters, always where white space
follows another character and where a run of letters ends. A text may be cut at such places, and the ids of the chunks
join to the ids of the text. Chunks repeat far more often than texts, so each worker keeps the ids of those it has met
(about `KEEP`, the frequent ones for good). Chunks that are new are encoded by the library many at a time, and their ids
are told apart by the tokens that begin or end them. The ids of texts are gathered from those of their distinct chunks. A text with the literal of a special token goes to the library whole. Texts with characters beyond Latin-1 or with other white space than
blanks and line feeds take plainer ways.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_cache

KEEP = 900_000
KEEP_CHARS = 36  # characters of all kept chunks for each that may be kept; usual ones have about 9
PART_CHARS = 6_000_000
MARKS = ".,;:!?"
BAR = "|"
#: Runs of blanks and line feeds go with what follows them.
ANY_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space besides blank and line feed: beside these a cut could fall into a run of white space.
OTHER_SPACE = re.compile("[^\\S \\n]|[\\x1c-\\x1f\\x85\\u180e\\u200b\\ufeff]")
OTHER_LATIN = bytes([9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0])


def sliced(batches: Iterator[pa.RecordBatch], column: int = 1, size: int = PART_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about `size` bytes of text each, or one longer text."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        first, before = 0, 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(first, last - first)
            first, before = last, int(ends[last - 1])


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, as the tokenizers library gives them for add_special_tokens=False."""

    def __init__(self, path: str, keep: int | None = None, part_chars: int | None = None):
        self.keep, self.part_chars = keep or KEEP, part_chars or PART_CHARS
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        self.lower = spec["model"].get("end_of_word_suffix") == "</w>"  # lower-cases, drops white space
        self.mark = np.zeros(max(vocabulary.values()) + 2, bool)  # tokens that end (else: begin) a word
        self.mark[[i for t, i in vocabulary.items() if (t.endswith("</w>") if self.lower else t.startswith("Ġ"))]] = True
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]  # found anywhere in a text, inside words too
        self.kept: dict[str, bytes] = {"": b""} if self.lower else {}
        self.old: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.kept_chars = self.bare_chars = 0
        self.marks: dict[str, bytes] = {}
        self.line = np.uint32(vocabulary.get("Ċ", 0))
        self.bar = vocabulary.get(f"{BAR}</w>", -1)

    @classmethod
    def of(cls, path: str, keep: int | None = None, part_chars: int | None = None) -> "Encoder":
        kept = worker_cache(f"ids {path} {keep} {part_chars}")
        if not kept:
            kept["encoder"] = cls(path, keep, part_chars)
        return kept["encoder"]

    def plain(self, text: str) -> bytes:
        """The library's own result for one text."""
        return self._ids(text).tobytes()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def plainly_parted(self, text: str) -> str | None:
        """The text with its chunks between single blanks; None if it needs another way.

        Where no two white-space characters meet, a chunk is what stands between blanks. In the vocabulary that keeps
        white space it stands for itself after a blank, or, if it begins with a line feed, for itself alone; the first
        chunk, which nothing precedes, is marked by a zero character. The other vocabulary has empty chunks too."""
        if any(x in text for x in self.special):
            return None
        try:
            latin = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if len(latin.translate(None, OTHER_LATIN)) != len(latin) or b"\0" in latin:
            return None
        if self.lower:
            return text.lower().replace("\n", " ")
        if not text or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
            return None
        return "\0" + text.replace("\n", " \n")

    def chunks(self, text: str) -> list[str] | None:
        """Chunks of a text that is not plainly parted; None if it must stay whole, as texts do that hold a special
        token's literal."""
        if any(x in text for x in self.special) or OTHER_SPACE.search(text) or "\0" in text:
            return None
        return ["\0" + c for c in ANY_CHUNK.findall(text)]

    def _apart(self, some: list[str], words: bool) -> list[bytes] | None:
        """Ids of chunks that the library takes as one text; None if they can't be told apart. In the vocabulary that
        keeps white space a token that begins with a blank begins a chunk; in the other one a word has one token that
        ends it, and chunks of several words are parted by BAR, which none of them holds."""
        parting = " " if words or not self.lower else f" {BAR} "
        ids = self._ids(" " + parting.join(some))
        if parting != " ":
            first = np.append(np.flatnonzero(ids == self.bar), len(ids))
            first, last = np.append(0, first[:-1] + 1), first
        elif self.lower:
            last = np.flatnonzero(self.mark[ids]) + 1
            first = np.append(0, last[:-1])
        else:
            first = np.flatnonzero(self.mark[ids])
            last = np.append(first[1:], len(ids))
        if len(first) != len(some) or first[0] != 0 or last[-1] != len(ids):
            return None
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip((first * 4).tolist(), (last * 4).tolist(), strict=True)]

    def _learn(self, new: list[str]) -> None:
        """Ids of new chunks: words joined, then a word with its marks put together, then other chunks joined, and one
        by one what begins or holds white space."""
        put, whole = self.kept, []
        words: dict[str, None] = {}
        bare: dict[str, None] = {}
        composed, opened, mixed = [], [], []
        for c in new:
            word = c.rstrip(MARKS)
            if word.isalpha():  # a run of letters, which marks, if any, end
                if word not in put:
                    words[word] = None
                if word != c:
                    composed.append((c, word, c[len(word) :]))
            elif not self.lower and c[:1] in ("\0", "\n") and word[1:].isalpha():  # such a run, but after no blank
                if word[1:] not in self.bare:
                    bare[word[1:]] = None
                opened.append((c, word[1:], c[len(word) :]))
            elif c[:1] in ("", "\0", "\n") or self.lower and BAR in c:
                whole.append(c)
            else:
                mixed.append(c)
        if len(self.bare) + len(bare) > self.keep // 4 or self.bare_chars > KEEP_CHARS * self.keep // 4:
            self.bare.clear()
            self.bare_chars = 0
            bare = dict.fromkeys(w for _, w, _ in opened)
        self.bare_chars += sum(map(len, bare))
        todo = list(bare)
        for i in range(0, len(todo), 512):
            some = todo[i : i + 512]
            ids = self._ids("\n".join(some))
            ends = np.append(np.flatnonzero(ids == self.line), len(ids)).tolist()
            if len(ends) != len(some):  # not to be told apart: one by one
                self.bare.update((w, self.plain(w)) for w in some)
                continue
            for w, first, end in zip(some, [0, *(e + 1 for e in ends)], ends, strict=False):
                self.bare[w] = ids[first:end].tobytes()
        for todo, alike in ((list(words), True), (mixed, False)):
            for i in range(0, len(todo), 512):
                some = todo[i : i + 512]
                ids = self._apart(some, alike)
                if ids is None:
                    whole += some
                else:
                    put.update(zip(some, ids, strict=True))
        for i in range(0, len(whole), 1024):
            some = whole[i : i + 1024]
            texts = [c[1:] if c[:1] == "\0" else c if self.lower or c[:1] == "\n" else " " + c for c in some]
            for c, e in zip(some, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                put[c] = np.array(e.ids, "<u4").tobytes()
        for c, word, marks in composed:
            put[c] = put[word] + self._ending(marks)
        for c, word, marks in opened:
            put[c] = (self.line.tobytes() if c[0] == "\n" else b"") + self.bare[word] + self._ending(marks)

    def _ending(self, marks: str) -> bytes:
        if marks not in self.marks:
            self.marks[marks] = self.plain(marks) if marks else b""
        return self.marks[marks]

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks. Those met are kept in two generations: when the younger is full it becomes the
        older, and a chunk that is met again comes back into the younger, so frequent ones are never forgotten."""
        if len(self.kept) >= self.keep // 2 or self.kept_chars >= KEEP_CHARS * self.keep // 2:
            self.old, self.kept, self.kept_chars = self.kept, {}, 0
        kept, old = self.kept, self.old
        found = list(map(kept.get, chunks))
        if None in found:
            missing = [c for c, ids in zip(chunks, found, strict=True) if ids is None]
            again = {c: old[c] for c in missing if c in old}
            kept.update(again)
            self.kept_chars += sum(map(len, missing))
            self._learn([c for c in missing if c not in again])
            found = list(map(kept.__getitem__, chunks))
        return found

    def _joined(self, chunks: pa.Array, sizes: np.ndarray) -> list[bytes]:
        """Ids of texts of `sizes` chunks each: ids of the distinct chunks, gathered in the order of the text."""
        coded = chunks.dictionary_encode()
        found = pa.array(self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
        _, ends, ids = found.buffers()
        if ids is None:
            return [b""] * len(sizes)
        ids, ends = ids.to_pybytes(), np.frombuffer(ends, np.int64)
        bounds = ends[found.offset + np.append(0, np.cumsum(sizes))].tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; texts are taken in parts of about `part_chars` characters."""
        out: list[bytes] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < self.part_chars):
                size += len(texts[j])
                j += 1
            out += self._part(texts[i:j])
            i = j
        return out

    def _part(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        parted = [self.plainly_parted(t) for t in texts]
        at = [k for k, p in enumerate(parted) if p is not None]
        if at:
            lists = pc.split_pattern(pa.array([parted[k] for k in at], pa.large_string()), " ")
            for k, ids in zip(at, self._joined(lists.flatten(), np.diff(lists.offsets.to_numpy())), strict=True):
                out[k] = ids
        rest = {k: self.chunks(texts[k]) for k, p in enumerate(parted) if p is None}
        at = [k for k, c in rest.items() if c is not None]
        if at:
            flat = pa.array([c for k in at for c in rest[k]], pa.large_string())
            for k, ids in zip(at, self._joined(flat, np.array([len(rest[k]) for k in at], np.int64)), strict=True):
                out[k] = ids
        for k, c in rest.items():
            if c is None:
                out[k] = self.plain(texts[k])
        return out

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]
