"""Benchmark items in documents, by pigeonhole edit matching.

An item that stands in a text with at most k edits leaves at least one of its k + 1 pieces
unchanged. One automaton finds the exact hits of all pieces; around each, Myers' bit-parallel
distance decides whether the whole item stands there. Items and texts have a space at either end, so
that whole words are looked for, and a word cut at an end of an item costs edits like any other change.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, texts_of

BUDGET = 0.08
BLOCK_BYTES = 32 << 20

_BREAKS = re.compile(r"[\W_]+")

FOUND = "doc_id long, item_id long, edits int, at long, until long"


def normal(text: str | None) -> str:
    """Lower case, with one space for each run of what is neither letter nor digit."""
    return _BREAKS.sub(" ", text.lower()).strip() if text else ""


def padded(norm: str) -> str:
    return f" {norm} "


def budget_of(item: str, budget: float = BUDGET) -> int:
    """Edits allowed in a normal item, whatever its length."""
    return int(len(item) * budget)


def pieces_of(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of about equal length, with their places."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def peq_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Smallest edit distance between a pattern of m characters and any part of the text, and where the first such part ends."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full  # any part may begin: no cost for what stands before it
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


class Matcher:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: tuple[tuple[int, str], ...], budget: float) -> None:
        import ahocorasick

        self.items = [(i, padded(n), budget_of(n, budget), peq_of(padded(n))) for i, t in items if (n := normal(t))]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for x, (_, item, k, _) in enumerate(self.items):
            for at, piece in pieces_of(item, k):
                pieces.setdefault(piece, []).append((x, at))
        self.automaton = ahocorasick.Automaton()
        for piece, found in pieces.items():
            self.automaton.add_word(piece, (len(piece), found))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, start, end) of each item in a text, at its first best place in the normal text.

        The end is where the best match ends; the start is counted back from it by the item's length.
        """
        norm = normal(text)
        if self.empty or not norm:
            return []
        norm = padded(norm)
        windows: dict[int, list[list[int]]] = {}
        for end, (length, found) in self.automaton.iter(norm):
            for x, at in found:
                _, item, k, _ = self.items[x]
                a = end + 1 - length - at
                lo, hi = max(0, a - k), min(len(norm), a + len(item) + k)
                own = windows.setdefault(x, [])
                if own and lo <= own[-1][1]:  # hits come by their end; overlapping windows are searched as one
                    own[-1][0], own[-1][1] = min(own[-1][0], lo), max(own[-1][1], hi)
                else:
                    own.append([lo, hi])
        out = []
        for x, own in windows.items():
            item_id, item, k, peq = self.items[x]
            best: tuple[int, int] | None = None
            for lo, hi in own:
                if hi - lo < len(item) - k:
                    continue
                if (exact := norm.find(item, lo, hi)) >= 0:
                    d, until = 0, exact + len(item)
                else:
                    d, until = myers(peq, len(item), norm[lo:hi])
                    until += lo
                if d <= k and (best is None or d < best[0]):
                    best = (d, until)
            if best:
                until = min(max(best[1] - 2, 0), len(norm) - 2)  # without the spaces around item and text
                out.append((item_id, best[0], max(0, until - len(item) + 2), until))
        return sorted(out)


@lru_cache(maxsize=2)
def matcher(items: tuple[tuple[int, str], ...], budget: float) -> Matcher:
    return Matcher(items, budget)


def _blocks(benchmark: DataFrame) -> tuple[int, Iterator[tuple[tuple[int, str], ...]]]:
    """How many blocks of about BLOCK_BYTES the items make (at least one, perhaps empty), and the blocks, each read when its turn comes."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").alias("item")).where("item_id is not null and item is not null").distinct()
    blocks = 1 + int((items.agg(F.sum(F.octet_length("item"))).first()[0] or 0) // BLOCK_BYTES)

    def read() -> Iterator[tuple[tuple[int, str], ...]]:
        for n in range(blocks):
            own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n).orderBy("item_id", "item").toArrow()
            yield tuple(zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True))

    return blocks, read()


def _leaky(block: tuple[tuple[int, str], ...], budget: float):
    @F.pandas_udf("boolean")
    def leaky(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = matcher(block, budget).find
        for some in texts:
            yield pd.Series([bool(find(t)) for t in some], dtype=bool)

    return leaky


def without_leaks(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The documents in which no benchmark item stands, with all their columns.

    Of several blocks of items, each one's pass is written before the next block is read, so that the driver holds one block.
    """
    blocks, items = _blocks(benchmark)
    for block in items:
        docs = docs.where(~_leaky(block, budget)("text"))
        if blocks > 1:
            docs = stored(docs)
    return docs


def _hits(docs: DataFrame, block: tuple[tuple[int, str], ...], budget: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = matcher(block, budget).find
        for b in batches:
            rows = [(d, *x) for d, t in zip(b.column(0).to_pylist(), texts_of(b), strict=True) for x in find(t)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)


def leaks(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """A row for each benchmark item that stands in a document with at most `budget` edits a character: doc_id, item_id, edits, and the place in the normal text.

    One rule holds for items of all lengths. Items go to the tasks in blocks of about BLOCK_BYTES of text (or one item),
    one pass over the documents a block; of several, each pass is written before the next block is read, so that the
    driver holds one block. Null or empty items and texts match nothing. Repeated rows give repeated results.
    """
    blocks, items = _blocks(benchmark)
    out: DataFrame | None = None
    for block in items:
        found = _hits(docs, block, budget)
        if blocks > 1:
            found = stored(found)
        out = found if out is None else out.unionByName(found)
    return out
