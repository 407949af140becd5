"""Hierarchical multi-length packing of tokenized documents into training sequences.

A document's ids are cut at the longest context size; each full cut is a sequence of its own and
the rest goes to the tier of the smallest context size that holds it. The tiers are packed from the
longest, each into sequences of its own size: a sequence opens with the longest piece left in its tier, and its gap is
filled with the largest piece that fits from this tier or, failing that, from a shorter one. A gap that no whole
piece fits is filled by cutting a piece, so only the last sequence of a window is short. It is dealt
out over power-of-two sequences, which need no padding. A training step takes sequences of one tier, more of the shorter
ones, so that all steps hold as many ids; steps of a tier are balanced in what attention costs them.

Windows of documents are packed where they are read: nothing is shuffled, a lost executor's
partitions are simply packed again, and a task holds one window's ids at a time.
"""

from __future__ import annotations

import heapq
import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

TIERS = (256, 512, 1024, 2048)
WINDOW_DOCS = 4096
WINDOW_IDS = 4 << 20
END_ID = 1
STEP_SEQUENCES = 16
CACHE = 600_000
GROUP = 64

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, sequence_tokens int, step_group long"


class Piece(NamedTuple):
    length: int
    doc: int  #: position of the document in its window
    start: int


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never joins what it stands between, so a text's ids are
    those of its parts between ASCII white space, one after the other. It composes characters and then
    lower-cases, so parts of ASCII alone, where nothing is composed, are lower-cased first, except in texts where a special
    token's string could come of that. Different parts are encoded once as long as they keep coming (those not seen for CACHE / 2 other parts are forgotten), those of letters alone in groups: each ends with
    its first id of a token that ends a word.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # known before the last time that there were too many
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        parts = [self._parts((t or "").encode("utf-8", "replace")) for t in texts]
        found = [list(map(self.known.get, p)) for p in parts]
        missing = {w for p, f in zip(parts, found, strict=True) if None in f for w, x in zip(p, f, strict=True) if x is None}
        again = {w: self.older[w] for w in missing if w in self.older}
        if len(self.known) + len(missing) > CACHE // 2:
            self.older, self.known = self.known, {}
        self.known.update(again)
        new = missing.difference(again)
        words = [w for w in new if w.decode().isalpha()]
        self._learn(words, GROUP)
        self._learn(list(new.difference(words)), 1)
        learnt = {w: self.known[w] for w in missing}
        return [b"".join([learnt[w] if x is None else x for w, x in zip(p, f, strict=True)] if None in f else f) for p, f in zip(parts, found, strict=True)]

    @staticmethod
    def _parts(text: bytes) -> list[bytes]:
        if b"<|" in text:
            return text.split()
        return text.lower().split() if text.isascii() else [p.lower() if p.isascii() else p for p in text.split()]

    def _learn(self, words: list[bytes], size: int) -> None:
        groups = [words[i : i + size] for i in range(0, len(words), size)]
        for i in range(0, len(groups), 4096):
            some = groups[i : i + 4096]
            for g, e in zip(some, self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype="<u4")
                blob = ids.tobytes()
                if size == 1:
                    self.known[g[0]] = blob
                    continue
                cuts = [0, *(self.ends[ids].nonzero()[0] * 4 + 4).tolist()]
                if len(cuts) != len(g) + 1:
                    self._learn(g, 1)
                    continue
                self.known.update((w, blob[a:b]) for w, a, b in zip(g, cuts, cuts[1:], strict=False))


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences of pieces that hold each id of documents of these lengths exactly once, none over the longest tier.

    All but the last few sequences have exactly the size of a tier; those are powers of two. Documents of no ids give no piece.
    """
    full = tiers[-1]
    out: list[list[Piece]] = []
    waiting: list[list[Piece]] = [[] for _ in tiers]  # by tier, sorted
    for doc, n in enumerate(lengths):
        whole = n - n % full
        out.extend([Piece(full, doc, start)] for start in range(0, whole, full))
        if n > whole:
            insort(waiting[next(k for k, t in enumerate(tiers) if n - whole <= t)], Piece(n - whole, doc, whole))
    while any(waiting):
        top = max(k for k, w in enumerate(waiting) if w)
        row = [waiting[top].pop()]
        size = tiers[top]
        gap = size - row[0].length
        while gap and any(waiting):
            for w in reversed(waiting):
                if at := bisect_right(w, (gap, 1 << 62)):
                    row.append(w.pop(at - 1))
                    break
            else:  # every piece left is longer than the gap: the shortest one is cut
                w = next(w for w in waiting if w)
                p = w.pop(0)
                row.append(Piece(gap, p.doc, p.start))
                rest = Piece(p.length - gap, p.doc, p.start + gap)
                insort(waiting[next(k for k, t in enumerate(tiers) if rest.length <= t)], rest)
            gap -= row[-1].length
        if not gap:
            out.append(row)
            continue
        # The window's last ids, dealt over powers of two.
        left = size - gap
        row.reverse()
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            part: list[Piece] = []
            while size:
                p = row.pop()
                take = min(size, p.length)
                part.append(Piece(take, p.doc, p.start))
                size -= take
                if take < p.length:
                    row.append(Piece(p.length - take, p.doc, p.start + take))
            out.append(part)
    return out


def step_groups(sequences: list[list[Piece]], size: int = STEP_SEQUENCES) -> list[int]:
    """A step group for each sequence: groups of `size`, balanced in their attention cost (the sum of squared piece lengths).

    The costliest sequence left goes to the cheapest group that has room.
    """
    count = -(-len(sequences) // size)
    heap, out = [(0, g, 0) for g in range(count)], [0] * len(sequences)
    costs = [sum(p.length**2 for p in s) for s in sequences]
    for i in sorted(range(len(sequences)), key=lambda i: (-costs[i], i)):
        cost, g, n = heapq.heappop(heap)
        out[i] = g
        if n + 1 < size:
            heapq.heappush(heap, (cost + costs[i], g, n + 1))
    return out


def tiered_steps(sequences: list[list[Piece]], tiers: tuple[int, ...] = TIERS, size: int = STEP_SEQUENCES) -> tuple[list[int], int]:
    """A step group for each sequence, of one tier and of `size` sequences of the longest or as many ids of shorter ones; and how many groups there are."""
    tier = [next(t for t in tiers if sum(p.length for p in s) <= t) for s in sequences]
    out, first = [0] * len(sequences), 0
    for t in tiers:
        own = [i for i, x in enumerate(tier) if x == t]
        for i, g in zip(own, step_groups([sequences[i] for i in own], size * tiers[-1] // t), strict=True):
            out[i] = first + g
        first += -(-len(own) // (size * tiers[-1] // t))
    return out, first


def pack_documents(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document (doc_id, text), with its place in a sequence; with_ids adds the piece's ids.

    A null text is empty and an empty text has the end id alone. Repeated rows are packed as often as
    they come; null ids stay null. sequence_id is the reading task's number * 2^40 + the sequence's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        base, steps = TaskContext.get().partitionId() << 40, 0
        ids: list[int | None] = []
        blobs: list[bytes] = []
        held = 0

        def window() -> pa.RecordBatch:
            nonlocal base, steps
            sequences = pack([len(b) // 4 for b in blobs], tiers)
            groups, count = tiered_steps(sequences, tiers)
            rows = []
            for n, s in enumerate(sequences):
                total, offset = sum(p.length for p in s), 0
                tier = next(t for t in tiers if total <= t)
                for p in s:
                    part = blobs[p.doc][4 * p.start : 4 * (p.start + p.length)]
                    rows.append((ids[p.doc], p.start, p.length, zlib.crc32(part), len(blobs[p.doc]) // 4, base + n, offset, tier, total, (base >> 40 << 40) + steps + groups[n], *([part] if with_ids else [])))
                    offset += p.length
            base += len(sequences)
            steps += count
            ids.clear()
            blobs.clear()
            types = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.int64()] + [pa.binary()] * with_ids
            names = [x.split()[0] for x in PIECE.split(", ")] + ["ids"] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            keys, texts = b.column(0).to_pylist(), texts_of(b)
            for i in range(0, len(texts), 512):
                for key, blob in zip(keys[i : i + 512], encode(texts[i : i + 512]), strict=True):
                    ids.append(key)
                    blobs.append(blob + end)
                    held += len(blob) // 4 + 1
                    if len(ids) >= WINDOW_DOCS or held >= WINDOW_IDS:
                        yield window()
                        held = 0
        if ids:
            yield window()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE + ", ids binary" * with_ids)
