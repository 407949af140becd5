"""Quality by logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

1. Words, runs of marks and single line ends are tokens, with their case. A document's features are its tokens and pairs of
   neighbours (of equal ones also that they are equal), hashed to DIMENSIONS slots; a slot's value is 1 + ln of its count, all scaled to a length of 1. Whole texts count.
2. The features of a bounded sample of labelled documents are written once; parts are runs of its partitions. In each epoch every part
   walks its rows, ordered by hash, from the shared state, updating a coordinate's gradient sums (z, n) as follow-the-regularised-leader does; the parts' changes
   are averaged by slot in a groupBy and become the next epoch's state. Only DIMENSIONS slots at most pass through the driver.
3. The state's closed form gives sparse weights; a document's score is the logistic of a sparse dot product.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, stored

BITS = 18
DIMENSIONS = 1 << BITS
#: Bound of the labelled documents that the model learns from; those of the least hashes of their ids are taken.
SAMPLE_ROWS = 50_000
#: Rows of a part, about: one task walks them in order. No more parts than partitions are made.
PART_ROWS = 4_096
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.05, 0.05
CACHE = 400_000

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+|\n")
#: The hash of any pair of equal neighbours, beside the pair's own.
_TWICE = 1 << 40
#: The slot of the bias lies beyond the hashed ones.
_BIAS = DIMENSIONS


class _Hashes(dict):
    """Hashes of tokens, kept while there is room."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[token] = zlib.crc32(token.encode("utf-8", "replace"))
        return h


def counted(text: str | None, hashes: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text and how often it has each; none of an empty one."""
    hashes = _Hashes() if hashes is None else hashes
    h = np.array([hashes[t] for t in _TOKEN.findall(text or "")], dtype=np.uint64)
    again = np.full(int((h[:-1] == h[1:]).sum()), _TWICE, dtype=np.uint64)
    both = np.concatenate([h, h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(3) + np.uint64(1), again])
    both = (both * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)
    return np.unique(both.astype(np.int32), return_counts=True)


def scaled(counts: np.ndarray) -> np.ndarray:
    values = 1 + np.log(counts)
    return values / np.sqrt((values * values).sum()) if len(values) else values


def features(text: str | None, hashes: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text."""
    slots, counts = counted(text, hashes)
    return slots, scaled(counts)


class Learner:
    """Per-coordinate follow-the-regularised-leader with a proximal term."""

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None) -> None:
        self.z = np.zeros(DIMENSIONS + 1) if z is None else z.copy()
        self.n = np.zeros(DIMENSIONS + 1) if n is None else n.copy()

    def weights(self, slots: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, slots: np.ndarray, values: np.ndarray, y: int) -> None:
        slots, values = np.append(slots, _BIAS), np.append(values, 1.0)
        w = self.weights(slots)
        g = (1 / (1 + np.exp(-np.clip(w @ values, -30, 30))) - y) * values
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[slots] = n + g * g


@dataclass
class Model:
    weights: np.ndarray  #: of each slot, the bias last

    def score_of(self, slots: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[slots] @ values + self.weights[_BIAS], -30, 30))))


def _taken(labels: DataFrame, folds: int, held_out: int, most: int) -> DataFrame:
    """id, y and the order of the usable labelled ids: all, or those under the share of hashes that holds `most` less ten deviations."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != held_out))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").cast("int").alias("y"))
    there = usable.count()
    usable = usable.withColumn("h", F.xxhash64("id"))
    return usable if there <= most else usable.where(F.col("h") <= int((most - 10 * most**0.5) / there * 2**64) - 2**63)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = 5, held_out: int = 0) -> Model:
    """A model from labelled documents whose crc32(doc_id as text) mod `folds` isn't `held_out`.

    At most `sample_rows` labelled ids are taken, by the hash of their ids. Labels other than 0 and 1 and null ids are left out; of several labels of an
    id the greatest counts; repeated rows of a document are learnt each. Without labelled rows all weights are 0, so every score is 0.5.
    """
    spark = docs.sparkSession
    taken = _taken(labels, folds, held_out, sample_rows)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            each = [counted(t, hashes) for t in b.column(2).to_pylist()]
            slots, counts = (pa.array([x[k] for x in each], pa.list_(pa.int32())) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), slots, counts], ["h", "y", "slots", "counts"])

    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(taken), "id").select("h", "y", "text")
    rows = stored(own.mapInArrow(featured, "h long, y int, slots array<int>, counts array<int>"))
    ordered = rows.coalesce(max(1, -(-rows.count() // PART_ROWS))).sortWithinPartitions("h", "slots").select("y", "slots", "counts")
    learner = Learner()
    for _ in range(EPOCHS):
        shared = spark.sparkContext.broadcast((learner.z, learner.n))

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z, n = shared.value  # noqa: B023  run before the next epoch
            own, some = Learner(z, n), False
            for b in batches:
                for y, slots, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                    own.learn(slots.values.to_numpy(), scaled(counts.values.to_numpy()), y)
                    some = True
            at = np.flatnonzero((own.n != n) | (own.z != z))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(own.z[at] - z[at], float(some))), pa.array(np.append(own.n[at] - n[at], 0.0))], ["slot", "z", "n"])

        moved = ordered.mapInArrow(walk, "slot int, z double, n double").groupBy("slot").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toArrow().sort_by("slot")
        parts = max(1.0, moved.column("z")[0].as_py())  # the first row tells how many walked
        moved = moved.slice(1)
        at = moved.column("slot").to_numpy()
        learner.z[at] += moved.column("z").to_numpy() / parts
        learner.n[at] += moved.column("n").to_numpy() / parts
    return Model(learner.weights())


def scorer(docs: DataFrame, model: Model):
    """A column function of texts: their scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes, own = _Hashes(), shared.value
        for some in texts:
            yield pd.Series([own.score_of(*features(t, hashes)) for t in some], dtype="float64")

    return scores


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: good likelier) of every whole text; null and empty texts get the score of no features. Repeated rows are scored each. No rows give none."""
    return docs.select(F.col("doc_id").cast("long"), scorer(docs, model)("text").alias("score"))


def without_poor(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents whose score is the threshold or more, with all their columns."""
    return docs.where(scorer(docs, model)("text") >= threshold)
