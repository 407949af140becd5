"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. From a bounded sample of labelled rows, words and word beginnings that go with toxic labels are
   collected into lexicons. Each lexicon, each fixed word list and each writing pattern is a voter.
2. The votes of all documents give the voters' firing rates and covariances. If voters were
   independent given the label, every covariance would be a product of two accuracies, so each
   triplet of voters yields one accuracy; the median over triplets is taken. What the products
   don't explain is the correlation of two voters, and correlated votes are discounted.
3. The label model's posterior labels of the sample train a logistic classifier over words and word
   beginnings, which scores every document. Its weights have a Gaussian prior: around LISTED for the words of the
   fixed lists and patterns, around zero for all others; so what the sample doesn't show keeps its prior weight.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_az, remainder, stored, texts_of
from .simhash import shingle_hashes

#: Word lists of common insults in four languages; they vote from the start, whatever the labels hold.
WORDS = {
    "en": "idiot moron stupid dumb loser pathetic worthless scum trash garbage clown disgusting filthy ugly hate shut",
    "de": "idiot dumm dummkopf abschaum trottel depp wertlos ekelhaft widerlich hasse",
    "fr": "idiot imbécile connard stupide minable ordure dégoûtant pourri déteste",
    "es": "idiota imbécil estúpido basura asqueroso patético inútil payaso odio",
}
#: Bound of the labelled rows that the model learns from. Lexicons and classifier take all of their words that are significant by LEAST_SHARE and LEAST_Z.
SAMPLE_ROWS = 20_000
LEAST_DOCS = 4
LEXICONS = 16
LEAST_SHARE = 0.6
LEAST_Z = 4.0
HEADS = (4, 5, 6)
PRIOR = 0.1
LISTED = 4.0
CACHE = 400_000
PART = 1 << 20

_BREAKS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_PATTERNS = {
    b"#shout": re.compile(r"\b[A-Z]{4,}(?:\W+[A-Z]{4,})+"),
    b"#marks": re.compile(r"[!?]{3,}"),
    b"#stretch": re.compile(r"([A-Za-z])\1{3,}"),
    b"#you": re.compile(r"\byou(?:'re| are| all are)? (?:an? |such an? |so )?(?:idiot|moron|stupid|dumb|loser|pathetic)", re.IGNORECASE),
}


def terms_of(text: str | None) -> set[bytes]:
    """Different words of a text, letters only, A-Z lower-cased; and the names of the patterns it shows."""
    if not text:
        return set()
    out = set(lower_az(text).translate(_BREAKS).split())
    out.update(name for name, p in _PATTERNS.items() if p.search(text))
    return out


def features_of(term: bytes) -> list[int]:
    """A term's features: itself, and its beginnings of 4 to 6 bytes."""
    if term[:1] == b"#":
        return [zlib.crc32(term)]
    return [zlib.crc32(b"w" + term), *(zlib.crc32(b"%d" % n + term[:n]) for n in HEADS if len(term) >= n)]


@dataclass
class Model:
    """A fitted model; its size is bounded by the words of the sample and the number of voters, not by the input."""

    voters: list[tuple[str, frozenset[int]]]
    accuracy: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))  #: P(fires | toxic), P(fires | clean)
    correlation: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    prior: float = PRIOR
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = 0.0


def _cached(of: Callable[[bytes], object]) -> Callable[[bytes], object]:
    """of(term), remembered for a bounded number of terms."""
    known: dict[bytes, object] = {}

    def get(term: bytes):
        if (x := known.get(term)) is None:
            if len(known) >= CACHE:
                known.clear()
            x = known[term] = of(term)
        return x

    return get


def _induced(rows: np.ndarray, feats: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different features of LEAST_DOCS documents or more (fewer can't be significant); the least share of toxic documents among those that have them, at 95 % (Wilson's bound); and how far that share is from the mean, in standard deviations."""
    names, at, times = np.unique(feats, return_inverse=True, return_counts=True)
    n = np.bincount(at, weights=weight[rows], minlength=len(names))
    a = np.bincount(at, weights=(weight * toxic)[rows], minlength=len(names))
    names, n, a = (x[times >= LEAST_DOCS] for x in (names, n, a))
    p, q, c = float((weight * toxic).sum() / max(weight.sum(), 1e-9)), a / np.maximum(n, 1e-9), 1.96**2
    least = (q + c / 2 / np.maximum(n, 1e-9) - np.sqrt(c * (np.maximum(q * (1 - q), 0) + c / 4 / np.maximum(n, 1e-9)) / np.maximum(n, 1e-9))) / (1 + c / np.maximum(n, 1e-9))
    return names, least, (a - n * p) / np.sqrt(n * p * (1 - p) + 1)


def _places(feats: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in feats those of the sorted array `of` are, and which they are; by parts, so that the driver holds little at a time."""
    where, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(feats) if len(of) else 0, PART):
        some = feats[lo : lo + PART]
        at = np.minimum(np.searchsorted(of, some), len(of) - 1)
        hit = np.flatnonzero(of[at] == some)
        where.append(hit + lo)
        which.append(at[hit])
    return np.concatenate(where), np.concatenate(which)


class _Sample:
    """The features of the labelled rows, in a table, of which the driver reads a part at a time."""

    def __init__(self, known: DataFrame) -> None:
        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = texts_of(b)
                feats = [np.array([f for t in terms_of(x) for f in features_of(t)], dtype="<u4").tobytes() for x in texts]
                kin = [int(h.min() >> np.uint64(1)) if len(h := shingle_hashes(x, 5)) else 0 for x in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kin, pa.int64()), pa.array(feats, pa.binary())], ["id", "y", "kin", "feats"])

        self.table = stored(known.select(F.monotonically_increasing_id().alias("id"), "y", "text").mapInArrow(features, "id long, y int, kin long, feats binary"))
        got = self.table.select("id", "y", "kin").orderBy("id").toArrow()
        self.ids, self.toxic, self.kin = got.column("id").to_numpy(), got.column("y").to_numpy().astype(float), got.column("kin").to_numpy()

    def read(self, keep: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) of all features that keep() keeps of a row's, in order of the rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                kept = [(x := np.frombuffer(f.as_buffer(), dtype="<u4"))[keep(x)].tobytes() for f in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary())], ["id", "feats"])

        got = self.table.select("id", "feats").mapInArrow(run, "id long, feats binary").toArrow().sort_by("id")
        flat = [np.frombuffer(x.as_buffer(), dtype="<u4") for x in got.column("feats")]
        rows = np.searchsorted(self.ids, got.column("id").to_numpy()).astype(np.int32)
        return np.repeat(rows, [len(x) for x in flat]), np.concatenate([*flat, np.zeros(0, "<u4")])


def _label_model(n: float, moments: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Accuracies P(fires | toxic), P(fires | clean) of voters, and their correlations given the label.

    moments[i, j] counts documents on which voters i and j both fire, of n documents.
    """
    k = len(moments)
    rate = np.diag(moments) / max(n, 1)
    cov = moments / max(n, 1) - rate[:, None] * rate[None, :]
    gap = np.zeros(k)
    live = [i for i in range(k) if moments[i, i] > 0]
    for i in live:
        found = [cov[i, j] * cov[i, m] / cov[j, m] for j in live for m in live if i != j < m != i and cov[j, m] > 1e-9 and cov[i, j] > 0 and cov[i, m] > 0]
        if found:
            gap[i] = np.sqrt(np.median(found) / (prior * (1 - prior)))
    gap = np.minimum(gap, rate / prior)  # P(fires | clean) can't be negative
    gap = np.minimum(gap, (1 - rate) / (1 - prior))
    toxic, clean = np.clip(rate + (1 - prior) * gap, 1e-5, 1 - 1e-5), np.clip(rate - prior * gap, 1e-5, 1 - 1e-5)
    left = cov - prior * (1 - prior) * gap[:, None] * gap[None, :]
    spread = np.sqrt(np.maximum(prior * toxic * (1 - toxic) + (1 - prior) * clean * (1 - clean), 1e-12))
    corr = np.clip(left / spread[:, None] / spread[None, :], -1, 1)
    np.fill_diagonal(corr, 0)
    return np.stack([toxic, clean], axis=1), corr


def _posterior(fired: np.ndarray, model: Model) -> np.ndarray:
    """P(toxic | votes) of each row of a 0/1 matrix; a voter's log odds are divided by what correlated voters repeat."""
    toxic, clean = model.accuracy[:, 0], model.accuracy[:, 1]
    share = 1 / (1 + np.maximum(model.correlation, 0).sum(axis=1))
    on, off = np.log(toxic / clean) * share, np.log((1 - toxic) / (1 - clean)) * share
    z = np.log(model.prior / (1 - model.prior)) + fired @ (on - off) + off.sum()
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(rows: np.ndarray, cols: np.ndarray, mean: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 0.003, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model of soft labels y, by Adam on the whole sample, from the prior means of the weights. Without a sample they stay at these."""
    k, w, b = len(mean), mean.astype(float), float(np.log(PRIOR / (1 - PRIOR)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    total = max(weight.sum(), 1e-9)
    for t in range(1, steps + 1 if len(y) else 1):
        z = np.bincount(rows, weights=w[cols], minlength=len(y)) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.append(np.bincount(cols, weights=g[rows], minlength=k) + l2 * (w - mean), g.sum()) / total
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    return w, float(b)


def _taken(labels: DataFrame, sample_rows: int) -> DataFrame:
    """(id, y) of the `sample_rows` usable labelled ids of the least hashes.

    Hashes are uniform, so those under the share that holds ten deviations more than `sample_rows` hold them all;
    only these go to the task that orders them, however many labels there are.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 3) != 1))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("y"))
    share = min(1.0, (sample_rows + 10 * sample_rows**0.5) / max(usable.count(), 1))
    return usable.where(F.xxhash64("id") <= int(share * 2**64) - 2**63 - 1).orderBy(F.xxhash64("id"), "id").limit(sample_rows)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from labelled documents whose crc32(doc_id) mod 3 is not 1, and the votes of all documents.

    At most `sample_rows` labelled rows are taken, by the hash of their ids; that bounds what comes
    to the driver. Rows whose label or id is null are left out. Without labelled rows of both kinds there are no
    lexicons: the fixed word lists and patterns vote, and the classifier learns from their posterior labels.
    """
    taken = _taken(labels, sample_rows)
    sample = _Sample(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(taken), "id").select("y", "text"))
    y = sample.toxic
    # Copies and near copies share their least shingle: a group of them counts as one document.
    _, kin, size = np.unique(sample.kin, return_inverse=True, return_counts=True)
    weight = 1 / size[kin] if len(y) else np.zeros(0)

    voters = [(f"words {k}", frozenset(zlib.crc32(b"w" + w.encode()) for w in v.split())) for k, v in WORDS.items()]
    voters += [(f"pattern {k.decode()}", frozenset([zlib.crc32(k)])) for k in _PATTERNS]
    parts = [_induced(*sample.read(lambda x, n=n: x >> np.uint32(29) == n), y, weight) for n in range(8)]  # by their first bits, so in order
    names, least, z = (np.concatenate(x) for x in zip(*parts, strict=True))
    bad = [int(names[i]) for i in np.lexsort((names, -z, -least)) if least[i] >= LEAST_SHARE]
    for n in range(LEXICONS if bad else 0):
        # Dealt in turn, so that each lexicon has words of every language and strength.
        voters.append((f"lexicon {n}", frozenset(bad[n::LEXICONS])))
    model = Model(voters, prior=float(np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 0.01, 0.5)) if len(y) and y.any() else PRIOR)

    n, moments = _moments(docs, voters)
    model.accuracy, model.correlation = _label_model(n, moments, model.prior)

    listed = np.array(sorted({f for name, words in voters if not name.startswith("lexicon") for f in words}), dtype="<u4")
    keep = np.union1d(names[np.abs(z) >= LEAST_Z], listed)
    voting = np.union1d(keep, np.array(bad, dtype="<u4"))
    rows, flat = sample.read(lambda x: np.isin(x, voting))
    fired = np.zeros((len(y), len(voters)))
    for j, (_, words) in enumerate(voters):
        fired[rows[_places(flat, np.array(sorted(words), dtype="<u4"))[0]], j] = 1
    soft = _posterior(fired, model)
    where, at = _places(flat, keep)
    w, model.bias = _logistic(rows[where], at, np.where(np.isin(keep, listed), LISTED, 0.0), soft, weight)
    model.weights = {int(f): float(x) for f, x in zip(keep, w, strict=True) if abs(x) > 1e-4}
    return model


def _moments(docs: DataFrame, voters: list[tuple[str, frozenset[int]]]) -> tuple[float, np.ndarray]:
    """The number of documents, and how many each pair of voters fires on. A task gives one small matrix."""
    votes: dict[int, int] = {}
    for j, (_, words) in enumerate(voters):
        for f in words:
            votes[f] = votes.get(f, 0) | 1 << j
    k = len(voters)

    def mask_of(term: bytes) -> int:
        m = 0
        for f in features_of(term):
            m |= votes.get(f, 0)
        return m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, get = np.zeros((k, k), dtype=np.int64), 0, _cached(mask_of)
        for b in batches:
            for text in texts_of(b):
                m = 0
                for term in terms_of(text):
                    m |= get(term)
                n += 1
                if m:
                    on = [j for j in range(k) if m >> j & 1]
                    total[np.ix_(on, on)] += 1
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1), pa.int64()), pa.array(np.append(j, -1), pa.int64()), pa.array(np.append(total[i, j], n), pa.int64())], ["i", "j", "n"])

    out, count = np.zeros((k, k)), 0
    for i, j, n in docs.select("text").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if i < 0:
            count = n
        else:
            out[i, j] = n
    return count, out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text. Null and empty texts get the score of no words. No rows give none."""
    weights, bias = model.weights, model.bias

    def weigh(term: bytes) -> float:
        return sum(weights.get(f, 0.0) for f in features_of(term))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _cached(weigh)
        for b in batches:
            z = np.array([sum(sorted(map(get, terms_of(t)))) for t in texts_of(b)], dtype=float) + bias
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns."""
    weights, bias = model.weights, model.bias

    def weigh(term: bytes) -> float:
        return sum(weights.get(f, 0.0) for f in features_of(term))

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        get = _cached(weigh)
        for some in texts:
            z = np.array([sum(sorted(map(get, terms_of(t)))) for t in some], dtype=float) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.where(scores("text") < threshold)
