"""Licences and their notices by a positional index of rare words.

Words weigh by document frequency over all documents. Of each template's mandatory key phrases the words of the highest weight are in an index with their
places in the template. A file's words are looked up there; each hit gives the place at which the template would begin, and postings of a template are intersected by that
place, give or take a few words for what is inserted or left out. Where they agree, the key phrases are
verified, and the share of its weight that stands in order tells whether it is there.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_az, texts_of
from .licence_texts import TEMPLATES

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Different words of a template in the index, those of the highest weight in its key phrases; the least share of a template's weight that stands in its place.
RARE, LEAST_SHARE = 3, 0.75

_BREAKS = bytes(c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def licence_words(text: str | None) -> list[bytes]:
    r"""The words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a text after A-Z are lower-cased."""
    return lower_az(text).translate(_BREAKS).split() if text else []


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where a phrase's words stand consecutively, overlapping places too."""
    out, n, at = [], len(phrase), 0
    try:
        while True:
            at = words.index(phrase[0], at)
            if words[at : at + n] == phrase:
                out.append(at)
            at += 1
    except ValueError:
        return out


class _Entry(NamedTuple):
    label: str
    words: list[bytes]
    keys: list[list[bytes]]
    without: list[list[bytes]]
    weight: float
    slack: int  #: how far from its place a word may stand
    rare: int  #: how many different words of it are in the index


class Index:
    """Templates, inverse document frequencies and the places of each template's rare words; its size is that of the templates."""

    def __init__(self, frequency: dict[bytes, int], n: int) -> None:
        found = [(label, t) for label, some in TEMPLATES.items() for t in some]
        self.idf: dict[bytes, float] = {}
        self.entries: list[_Entry] = []
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for number, (label, t) in enumerate(found):
            words = licence_words(t.text)
            for w in words:
                self.idf.setdefault(w, math.log((n + 1) / (frequency.get(w, 0) + 1)) + 1e-6)
            phrases = [[licence_words(p) for p in some] for some in (t.keys, t.without)]
            rare = sorted({w for k in phrases[0] for w in k}, key=lambda w: (-self.idf[w], w))[:RARE]
            for i, w in enumerate(words):
                if w in rare:
                    self.postings.setdefault(w, []).append((number, i))
            self.entries.append(_Entry(label, words, *phrases, sum(self.idf[w] for w in words), 4 + len(words) // 8, len(rare)))

    def match(self, words: list[bytes]) -> dict[str, float]:
        """Labels of the templates found in a text, and the greatest share of their weight in place."""
        hits: dict[int, list[tuple[int, bytes]]] = {}
        for at, w in enumerate(words):
            for t, i in self.postings.get(w, ()):
                hits.setdefault(t, []).append((at - i, w))
        out: dict[str, float] = {}
        if not hits:
            return out
        places_of: dict[bytes, list[int]] = {}
        for t, found in hits.items():
            e = self.entries[t]
            if out.get(e.label, 0.0) >= 1.0:
                continue
            for offset in _agreed(found, e):
                if not places_of:
                    for at, w in enumerate(words):
                        if w in self.idf:
                            places_of.setdefault(w, []).append(at)
                share = self._share(e, words, offset, places_of)
                if share >= LEAST_SHARE:
                    out[e.label] = max(out.get(e.label, 0.0), share)
                    if share >= 1.0:
                        break
        return out

    def _share(self, e: _Entry, words: list[bytes], offset: int, places_of: dict[bytes, list[int]]) -> float:
        """The share of a template's weight that stands within its slack of its place at an offset; 0 without its key phrases."""
        around = words[max(0, offset - e.slack) : max(0, offset + len(e.words) + e.slack)]
        if not all(places(around, k) for k in e.keys) or any(places(around, k) for k in e.without):
            return 0.0
        total = 0.0
        for i, w in enumerate(e.words):
            own = places_of.get(w, ())
            k = bisect_left(own, offset + i - e.slack)
            if k < len(own) and own[k] <= offset + i + e.slack:
                total += self.idf[w]
        return min(1.0, total / e.weight)


def _agreed(found: list[tuple[int, bytes]], e: _Entry) -> Iterator[int]:
    """Places at which a template could begin: those near which two of its rare words agree, or its only one stands; near ones once."""
    found.sort()
    least, step, last = min(2, e.rare), max(1, e.slack // 2), None
    within: Counter[bytes] = Counter()
    a = 0
    for offset, w in found:
        within[w] += 1
        while found[a][0] < offset - e.slack:
            within[found[a][1]] -= 1
            if not within[found[a][1]]:
                del within[found[a][1]]
            a += 1
        if len(within) >= least:
            for o in (found[a][0], offset):
                if last is None or o >= last + step:
                    last = o
                    yield o


def frequencies(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """In how many of all documents each template word stands, and the number of documents. A task gives one row a word."""
    words = frozenset(w for some in TEMPLATES.values() for t in some for w in licence_words(t.text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()
        for b in batches:
            for t in texts_of(b):
                count.update(words.intersection(licence_words(t)))
                count[b""] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in count], pa.string()), pa.array(list(count.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows}
    return found, found.pop(b"", 0)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, words, base places and the templates found with their scores, of every whole text.

    A null text is empty: no words, no labels, score 0. score is 1 where a base phrase stands, else
    the largest share of a template that stands in place, which is LEAST_SHARE at least. Repeated rows give repeated results.
    """
    index = Index(*frequencies(docs))
    base = [(p.encode().split(), label) for p, label in BASE.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in texts_of(b):
                words = licence_words(t)
                found = [(at, label) for phrase, label in base for at in places(words, phrase)]
                at = [x for x, _ in found]
                base_labels = sorted({x for _, x in found})
                more = index.match(words)
                rows.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(base_labels), ",".join(sorted({*base_labels, *more})), 1.0 if at else max(more.values(), default=0.0)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            cols = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, types, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
