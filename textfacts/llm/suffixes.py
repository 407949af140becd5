"""Repeated passages by sparse suffix arrays.

Only suffixes that start at minimisers are kept: of each window of WINDOW consecutive word 8-grams,
the one of least hash. A passage that two texts share holds the same minimisers in both, so a passage
of `words` words has a kept suffix among its first WINDOW words, and at least words - WINDOW + 1 words
of the passage follow from there. Suffixes that agree on that many words are brought together and sorted
by what follows and what precedes them; neighbours in these orders show how far a match extends to the
right and to the left. Every repeated window of `words` words is found, whatever the number of its copies.

Runs of more than RUN_ROWS suffixes that begin alike are dealt to parts of about that size. A part is sorted like any run, tells
the two smallest documents of each of its windows, and what the parts tell is put together by window, so no task holds a long run.
Suffixes begin alike by a 64-bit hash of their words, and what surrounds them is compared by 31 bits a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from .common import stored, texts_of, words_of

WORDS = 50
GRAM = 8
WINDOW = 16
RUN_ROWS = 1 << 17
CACHE = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Hasher:
    """64-bit hashes of a text's words; a bounded number of them is remembered."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words, known = words_of(text), self.known
        new = set(words).difference(known)
        if len(known) + len(new) > CACHE:
            known.clear()
            new = set(words)
        known.update((w, xxh64_intdigest(w)) for w in new)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


class Rolling:
    """Hashes of all runs of n words of a text, from one pass."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        power = np.cumprod(np.full(n, _ODD)) if n else words
        self.back = np.cumprod(np.full(n, _INVERSE)) if n else words
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power)])

    def __call__(self, at: np.ndarray, n: int) -> np.ndarray:
        x = (self.sums[at + n] - self.sums[at]) * self.back[at]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def minimisers(rolling: Rolling, n: int) -> np.ndarray:
    """Places of the 8-grams that are the least, at first sight, of a window of WINDOW of them."""
    grams = rolling(np.arange(max(0, n - GRAM + 1)), GRAM)
    if len(grams) < WINDOW:
        return np.zeros(0, dtype=np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    return np.unique(windows.argmin(axis=1) + np.arange(len(windows)))


SUFFIX = "key long, doc_id long, at int"
CONTEXT = "key long, doc_id long, at int, left binary, right binary, part int"
PLACE = np.dtype([("doc", "<i8"), ("at", "<i4")])
SPAN = "doc_id long, start int, end int, other long, many boolean"


def repeated_passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words, other_doc: the passages of `words` words or more that stand in other documents too.

    Words are those between ASCII white space, A-Z lower-cased. A passage is a maximal run of words each of
    which lies in a window of `words` words that another doc_id has; other_doc is the smallest such id
    of any of its windows, and is_first tells that doc_id is smaller than all of them. Shorter, empty and
    null texts give no rows, and rows with null ids take no part, nor do repeats within one doc_id.

    Words aren't compared themselves: suffixes are told by keys of 64 bits and the words around them by 31 bits each, so by chance of
    about one in 2^31 a passage may be a word too long, and all repeated windows are found.
    """
    suffix = words - WINDOW + 1

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            keys, ids, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for doc, t in zip(b.column(0).to_pylist(), texts_of(b), strict=True):
                h = hasher(t)
                if len(h) < words:
                    continue
                rolling = Rolling(h)
                at = minimisers(rolling, len(h))
                at = at[at + suffix <= len(h)]
                keys.append(rolling(at, suffix))
                ids.append(np.full(len(at), doc))
                places.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(places).astype(np.int32))], ["key", "doc_id", "at"])

    known = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    suffixes = stored(known.mapInArrow(sample, SUFFIX))
    shared = suffixes.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a < b")
    # Written, so that the join below reads both sides from shuffles and Spark can split the side with the long runs.
    shared = stored(shared.select("key", F.ceil(F.col("n") / RUN_ROWS).cast("int").alias("parts")))
    places = suffixes.join(shared, "key").groupBy("doc_id").agg(F.collect_set(F.struct("at", "key", "parts")).alias("places"))

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, pad = Hasher(), np.zeros(WINDOW, np.uint32)
        for b in batches:
            rows = []
            for doc, t, places in zip(b.column(0).to_pylist(), texts_of(b), b.column(2).to_pylist(), strict=True):
                h = hasher(t)
                parts = {p["key"]: p["parts"] for p in places}
                at = np.unique(np.array([p["at"] for p in places if p["at"] + suffix <= len(h)], dtype=np.int64))
                keys = Rolling(h)(at, suffix).view(np.int64)
                small = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)  # 0 is where a text ends
                small = np.concatenate([pad, small, pad])
                for key, p in zip(keys.tolist(), at.tolist(), strict=True):
                    if (n := parts.get(key)) is None:  # a place of another text of the same id
                        continue
                    left, right = small[p + 1 : p + WINDOW][::-1], small[p + WINDOW + suffix : p + 2 * WINDOW + suffix - 1]
                    part = xxh64_intdigest(b"%d %d" % (doc, p)) % n if n > 1 else -1
                    rows.append((key, doc, p, left.tobytes(), right.tobytes(), part))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], [x.split()[0] for x in CONTEXT.split(", ")])

    context = known.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(surround, CONTEXT)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SPAN.split(", ")]
        held: pa.Table | None = None  # the last run or part of a run, whose end isn't known yet
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            keys, part = t.column("key").to_numpy(), t.column("part").to_numpy()
            new = np.append(True, (keys[1:] != keys[:-1]) | (part[1:] != part[:-1]))
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield from _runs(t.slice(0, last), new[:last], words, names)
            held = t.slice(last)
        if held is not None:
            yield from _runs(held, np.append(True, np.zeros(held.num_rows - 1, bool)), words, names)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for places, alike in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = np.frombuffer(places, dtype=PLACE)
                others = np.full((len(at), WINDOW), np.iinfo(np.int64).max)
                for x in alike:
                    others[:, x["k"]] = np.where(at["doc"] == x["least"], x["second"], x["least"])
                cols = _spans(at["doc"], at["at"], others, words)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc_id", "start", "end", "other"])

    found = stored(context.repartition("key", "part").sortWithinPartitions("key", "part", "right", "left", "doc_id", "at").mapInArrow(neighbours, SPAN + ", window binary, windows array<binary>, places binary"))
    # Suffixes of long runs: a part of a run tells the two smallest documents of each of its windows, and a context
    # (words on both sides) with all its places is one row, so that copies don't multiply what is compared.
    part = found.where("many and window is not null").select("window", F.col("doc_id").alias("a"), F.col("other").alias("b"))
    least = part.groupBy("window").agg(F.min("a").alias("least"), F.max(F.coalesce("b", "a")).alias("most")).where("least < most")
    second = part.join(least, "window").groupBy("window", "least").agg(F.min(F.when(F.col("a") == F.col("least"), F.col("b")).otherwise(F.col("a"))).alias("second"))
    packs = found.where("many and window is null").select(F.col("windows")[0].alias("id"), F.slice("windows", 2, WINDOW).alias("windows"), "places")
    asked = packs.select("id", F.posexplode("windows").alias("k", "window")).where("window is not null")
    shared_windows = asked.join(second, "window").groupBy("id").agg(F.collect_list(F.struct("k", "least", "second")).alias("alike"))
    rest = packs.drop("windows").join(shared_windows, "id").select("places", "alike").mapInArrow(unpack, "doc_id long, start int, end int, other long")
    spans = found.where("not many").select("doc_id", "start", "end", "other").unionByName(rest)
    spans = spans.groupBy("doc_id", "start", "end").agg(F.min("other").alias("other"))
    spans = spans.withColumn("before", F.expr("max(end) over (partition by doc_id order by start, end rows between unbounded preceding and 1 preceding)"))
    spans = spans.withColumn("island", F.expr("sum(case when before is null or start > before then 1 else 0 end) over (partition by doc_id order by start, end rows unbounded preceding)"))
    merged = spans.groupBy("doc_id", "island").agg(F.min("start").cast("long").alias("start_word"), F.max("end").cast("long").alias("end_word"), F.min("other").alias("other_doc"))
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_doc", (F.col("doc_id") < F.col("other_doc")).alias("is_first"))


def _runs(t: pa.Table, new: np.ndarray, words: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The spans of whole runs, and what each part of a longer run tells; `new` marks their first rows."""
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], t.num_rows)
    whole = t.column("part").to_numpy()[starts] < 0
    for is_whole, some in groupby(zip(whole.tolist(), starts.tolist(), ends.tolist(), strict=True), key=lambda x: x[0]):
        some = list(some)
        if is_whole:
            yield _compared(t.slice(some[0][1], some[-1][2] - some[0][1]), words, names)
        else:
            for _, i, j in some:
                yield _packed(t.slice(i, j - i), names)


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    n = t.num_rows
    return tuple(np.frombuffer(b"".join(t.column(c).to_pylist()), dtype=np.uint32).reshape(n, WINDOW - 1) for c in ("left", "right"))


def _compared(t: pa.Table, words: int, names: list[str]) -> pa.RecordBatch:
    """Spans of whole runs of suffixes that agree on their first words: for each way to divide what is missing between left and right, the rows in order of key and division, neighbours alike."""
    keys, docs, at = t.column("key").to_numpy(), t.column("doc_id").to_numpy(), t.column("at").to_numpy()
    alone = np.ones(len(keys), dtype=bool)
    same = keys[1:] == keys[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    left, right = _sides(t)
    whole = np.concatenate([left[:, ::-1], right], axis=1)
    odd = np.cumprod(np.full(WINDOW - 1, _ODD))
    none = np.iinfo(np.int64).max
    others = np.full((len(keys), WINDOW), none)  # of each suffix and division, the smallest other document
    for k in range(WINDOW):  # words taken from the left
        part = whole[:, WINDOW - 1 - k : 2 * WINDOW - 2 - k]
        rows = np.flatnonzero((part != 0).all(axis=1) & ~alone)
        if len(rows) < 2:
            continue
        some, key, own = part[rows], keys[rows], docs[rows]
        order = np.lexsort((own, (some.astype(np.uint64) * odd).sum(axis=1), key))
        some, key, own, rows = some[order], key[order], own[order], rows[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (some[1:] != some[:-1]).any(axis=1)])
        group = np.cumsum(new) - 1
        least = own[new]  # sorted by document within a group
        second = np.full(len(least), none)
        np.minimum.at(second, group, np.where(own != least[group], own, none))
        alike = (second != none)[group]
        others[rows[alike], k] = np.where(own == least[group], second[group], least[group])[alike]
    cols = _spans(docs, at, others, words)
    n = len(cols[0])
    return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.zeros(n, bool)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.binary())), pa.nulls(n, pa.binary())], [*names, "window", "windows", "places"])


def _spans(docs: np.ndarray, at: np.ndarray, others: np.ndarray, words: int) -> list[np.ndarray]:
    """Divisions that follow each other are windows that overlap: one span (document, start, end, other) for each run of them."""
    row, k = np.nonzero(others != np.iinfo(np.int64).max)
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (k[1:] != k[:-1] + 1))) if len(row) else np.zeros(0, int)
    last = np.append(first[1:], len(row)) - 1 if len(row) else first
    cols = [docs[row[first]], at[row[first]] - k[last], at[row[first]] - k[first] + words, np.minimum.reduceat(others[row, k], first) if len(row) else np.zeros(0, np.int64)]
    return [c.astype(kind) for c, kind in zip(cols, (np.int64, np.int32, np.int32, np.int64), strict=True)]


def _packed(t: pa.Table, names: list[str]) -> pa.RecordBatch:
    """A part of a long run of one key, sorted by its words: each context as one row with its windows and places, and for each window the two smallest documents of the part."""
    docs, at, key = t.column("doc_id").to_numpy(), t.column("at").to_numpy(), t.column("key")[0].as_py().to_bytes(8, "little", signed=True)
    left, right = _sides(t)
    whole = np.concatenate([left[:, ::-1], right], axis=1)
    starts = np.flatnonzero(np.append(True, (whole[1:] != whole[:-1]).any(axis=1)))
    least: dict[bytes, list[int]] = {}
    packs = []
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(docs)], strict=True):
        w, two = whole[i], np.unique(docs[i:j])[:2].tolist()
        place = np.empty(j - i, dtype=PLACE)
        place["doc"], place["at"] = docs[i:j], at[i:j]
        windows: list[bytes | None] = []
        for k in range(WINDOW):
            part = w[WINDOW - 1 - k : 2 * WINDOW - 2 - k]
            windows.append(key + bytes([k]) + part.tobytes() if part.all() else None)
            if windows[-1]:
                least[windows[-1]] = sorted({*least.get(windows[-1], ()), *two})[:2]
        packs.append(([xxh3_128_digest(key + w.tobytes() + place[:1].tobytes()), *windows], place.tobytes()))
    n, m = len(least), len(packs)
    cols = [
        pa.array([x[0] for x in least.values()] + [None] * m, pa.int64()), pa.nulls(n + m, pa.int32()), pa.nulls(n + m, pa.int32()),
        pa.array([x[1] if len(x) > 1 else None for x in least.values()] + [None] * m, pa.int64()), pa.array(np.ones(n + m, bool)),
        pa.array([*least, *[None] * m], pa.binary()), pa.array([None] * n + [x for x, _ in packs], pa.list_(pa.binary())), pa.array([None] * n + [x for _, x in packs], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(cols, [*names, "window", "windows", "places"])
