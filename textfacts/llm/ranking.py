"""Ranked lexical search: document shards searched by WAND, their heaps merged.

1. One pass over whole texts keeps, of each document, the number of its terms and the counts of those that a
   block of items asks for; this index is written once. Sums over it give N, L and the terms' df.
2. Documents are dealt evenly to tasks, and each task's to shards of bounded size. A shard has a posting list a
   term in order of place, with each posting's exact impact and the term's greatest. For each item the lists are
   walked by WAND: the pivot is the first document that the greatest impacts of the lists up to it could lift
   into the heap; lists before it skip to it, so documents that can't beat the heap's least are never scored.
   A task's shards share an item's heap, so that later ones skip more.
3. The heaps of all tasks are merged by item.

All scores are sums of integers, so the merged result is exact.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

BEST = 10
#: Bounds of a shard: documents, and their postings of the items' terms.
SHARD_DOCS, SHARD_POSTINGS = 32_768, 2_000_000
#: Documents that a task searches at most, in several shards.
TASK_DOCS = 262_144
#: UTF-8 bytes of items that are broadcast at once; more items are searched in several passes.
ITEM_BYTES = 2 << 20

#: Digits and letters stand for themselves, A-Z for a-z, bytes of other characters too; all else separates.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text's UTF-8, with repeats."""
    return text.translate(_TERMS).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Posting lists in order of place, with impacts."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        """ids: of the documents by place, ascending; then of each posting its place, term and impact."""
        order = np.lexsort((at, term))
        self.ids, self._at, self._impact, term = ids, at[order], impact[order], term[order]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        self._slice = {int(term[a]): (int(a), int(b)) for a, b in zip(first, np.append(first[1:], len(term)), strict=True)}
        self._lists: dict[int, tuple[int, list[int], list[int]]] = {}

    def postings(self, term: int) -> tuple[int, list[int], list[int]] | None:
        """The greatest impact, the places and the impacts of a term; None where it has no place."""
        if term not in self._lists and term in self._slice:
            a, b = self._slice[term]
            impacts = self._impact[a:b].tolist()
            self._lists[term] = max(impacts), self._at[a:b].tolist(), impacts
        return self._lists.get(term)

    def wand(self, terms: list[int], heap: list[tuple[int, int]], most: int) -> int:
        """Put the shard's documents into a heap of (score, -id) of at most `most`, the least first; how many were scored."""
        ends = len(self.ids)
        cursors = [[p[1][0], p[0], 0, p[1], p[2]] for t in terms if (p := self.postings(t)) and p[0] > 0]
        place = lambda c: c[0]
        scored = 0
        while True:
            cursors.sort(key=place)
            # A document of the least score can still win by its id where shards are out of order.
            least, bound, pivot = (heap[0][0] if len(heap) == most else 1), 0, ends
            for c in cursors:
                bound += c[1]
                if bound >= least:
                    pivot = c[0]
                    break
            if pivot == ends:
                return scored
            if cursors[0][0] == pivot:
                total = 0
                for c in cursors:
                    if c[0] != pivot:
                        break
                    i = c[2]
                    total += c[4][i]
                    c[2] = i = i + 1
                    c[0] = c[3][i] if i < len(c[3]) else ends
                scored += 1
                entry = (total, -int(self.ids[pivot]))
                if len(heap) < most:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            else:
                for c in cursors:
                    if c[0] >= pivot:
                        break
                    c[2] = i = bisect_left(c[3], pivot, c[2])
                    c[0] = c[3][i] if i < len(c[3]) else ends


INDEX = "doc_id long, n long, terms array<int>, counts array<int>"
HITS = "item long, doc_id long, score long"


def _index(docs: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """Of each document its id, its number of terms, and which of the asked ones it has, how often."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for b in batches:
            n, terms, counts = [], [], []
            for text in b.column(1).to_pylist():
                own = terms_of(text)
                some = Counter(filter(None.__ne__, map(asked.get, own)))
                n.append(len(own))
                terms.append(list(some))
                counts.append(list(some.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).where("doc_id is not null").mapInArrow(run, INDEX)


def _search(index: DataFrame, items: list[list[int]], weights: list[int], n_docs: int, n_terms: int, most: int, tasks: int) -> DataFrame:
    """Hits of each task's documents, by the number of the item."""
    shared = index.sparkSession.sparkContext.broadcast((items, np.array(weights, dtype=np.int64)))
    shard_docs, shard_postings = SHARD_DOCS, SHARD_POSTINGS

    def shards(batches: Iterator[pa.RecordBatch], weight: np.ndarray) -> Iterator[Shard]:
        held: list[pa.RecordBatch] = []

        def shard() -> Shard:
            t = pa.Table.from_batches(held).sort_by("doc_id")
            ids, n = t.column("doc_id").to_numpy(), t.column("n").to_numpy()
            terms, counts = t.column("terms").combine_chunks(), t.column("counts").combine_chunks()
            at = np.repeat(np.arange(len(ids)), terms.value_lengths().to_numpy(zero_copy_only=False))
            term, tf = terms.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
            m = 10 + 90 * n * n_docs // n_terms
            return Shard(ids, at, term, weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[at])))

        rows = postings = 0
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                b = whole.slice(a, 1024)
                more = len(b.column(2).flatten())
                if held and (rows + b.num_rows > shard_docs or postings + more > shard_postings):
                    yield shard()
                    held, rows, postings = [], 0, 0
                held.append(b)
                rows, postings = rows + b.num_rows, postings + more
        if held:
            yield shard()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = shared.value
        heaps: list[list[tuple[int, int]]] = [[] for _ in own]
        for s in shards(batches, weight):
            for terms, heap in zip(own, heaps, strict=True):
                s.wand(terms, heap, most)
        found = [(i, -d, s) for i, heap in enumerate(heaps) for s, d in heap]
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item", "doc_id", "score"])

    return index.repartition(tasks).mapInArrow(run, HITS)


def _blocks(items: DataFrame, most_bytes: int) -> DataFrame:
    """item_id, text and block: items dealt by hash to blocks of about most_bytes of text."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(1 + size * 5 // (4 * most_bytes))))


def search(docs: DataFrame, items: DataFrame, most: int = BEST, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's best documents with a score above 0, equal scores by ascending doc_id.

    docs has doc_id and text, items item_id and text. Terms are runs of ASCII letters, digits and all characters beyond ASCII, A-Z
    lower-cased; null and empty texts have none. Texts of one item_id are one item of all their terms, each once. Rows whose id is null take
    no part, in counts neither; repeated rows of documents are documents each. No documents, no items or no common term give no rows.

    Only blocks of items and what is counted for their terms come to the driver, `item_bytes` of text at a time and at
    least one item. All documents are read once for each block.
    """
    spark = docs.sparkSession
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("binary"))
    dealt = _blocks(items, item_bytes)
    out = None
    for block in sorted(r["block"] for r in dealt.select("block").distinct().collect()):
        asked: dict[int, set[bytes]] = {}
        for r in dealt.where(F.col("block") == block).toLocalIterator():
            asked.setdefault(r["item_id"], set()).update(terms_of(bytes(r["text"])))
        names = sorted(i for i, terms in asked.items() if terms)
        words = {w: k for k, w in enumerate(sorted(set().union(*asked.values())))}
        if not names:
            continue
        index = stored(_index(docs, words))
        n_docs, n_terms, n_rows = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        if not n_terms:
            continue
        df = [0] * len(words)
        for k, n in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[k] = n
        tasks = max(1, -(-n_rows // TASK_DOCS), min(2 * spark.sparkContext.defaultParallelism, -(-n_rows // SHARD_DOCS)))
        hits = _search(index, [sorted(words[w] for w in asked[i]) for i in names], [weight(n_docs, n) for n in df], n_docs, n_terms, most, tasks)
        name = F.element_at(F.lit(names), (F.col("item") + 1).cast("int"))
        found = hits.select(name.alias("item_id"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    ranked = out.withColumn("rank", F.expr("row_number() over (partition by item_id order by score desc, doc_id)").cast("int"))
    return ranked.where(F.col("rank") <= most).select("item_id", "rank", "doc_id", "score")
