"""Ranked search, clusters and quality against plain versions, their SQL, and odd rows."""

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textfacts.llm import clustering, quality, queries, ranking

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, score double, rank int, item_id long, n long, terms int, x long, h long, y long, part long"
ODD = (0.5, 1, 2, 3, 4, 5, 6, 7, 8)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_parity(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), duck.sql(queries.SQL[name])
    columns = sorted(got.columns)
    at = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
    assert columns == sorted(want.columns)
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())


def _plain_search(docs, items, most=10):
    """By the formulas, over all documents."""
    terms = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(d, Counter(terms(t))) for d, t in docs if d is not None]
    own = [(d, c) for d, c in own if c]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(w for _, c in own for w in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i].update(terms(t))
    out = []
    for i, words in asked.items():
        found = []
        for d, c in own:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words if w in c)
            found += [(-s, d)] if s > 0 else []
        out += [(i, k + 1, d, -s) for k, (s, d) in enumerate(sorted(found)[:most])]
    return sorted(out)


@pytest.mark.parametrize(("shard", "task", "item_bytes"), [(32_768, 262_144, 1 << 20), (5, 11, 40)])
def test_search_by_brute_force(spark, shard, task, item_bytes, monkeypatch):
    monkeypatch.setattr(ranking, "SHARD_DOCS", shard)
    monkeypatch.setattr(ranking, "TASK_DOCS", task)
    rng = np.random.default_rng(2)
    words = ["the", "Of", "café", "ßx", "Éa", "x1", "1", " ", "日本", "a_b", "I'm", *(f"w{i}" for i in range(30))]
    share = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 40)), p=share / share.sum())) for _ in range(60)]
    texts += [None, "", " ,;", texts[0], texts[0], "the " * 30_000 + "w29", "a\x00b\x7fc"]
    docs = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)] + [(None, "the w1"), (3, "w3 the"), (3, "w3 the")]
    items = [(k, " ".join(rng.choice(words, 6))) for k in range(12)] + [(50, "nothing here"), (51, None), (52, ""), (None, "the"), (0, "w7 w8"), (1, "café CAFÉ a b c")]
    got = ranking.search(spark.createDataFrame([(d, t, *ODD) for d, t in docs], DOC), spark.createDataFrame(items, "item_id long, text string"), item_bytes=item_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == _plain_search(docs, items)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], DOC), spark.createDataFrame([], "item_id long, text string")
    some, asked = spark.createDataFrame([(1, None, *ODD), (2, "x", *ODD)], DOC), spark.createDataFrame([(1, "x"), (2, "y")], "item_id long, text string")
    assert [ranking.search(a, b).count() for a, b in ((docs, items), (docs, asked), (some, items))] == [0, 0, 0]
    assert [tuple(r)[:3] for r in ranking.search(some, asked).collect()] == [(1, 1, 2)]


def test_wand_skips():
    rng = np.random.default_rng(3)
    n, terms = 4_000, 12
    there = [np.flatnonzero(rng.random(n) < 0.5 / (k + 1)) for k in range(terms)]
    impacts = [rng.integers(1, 100, len(a)) * (k + 1) ** 2 for k, a in enumerate(there)]
    ids = np.arange(n) * 3
    shard = ranking.Shard(ids, np.concatenate(there), np.repeat(np.arange(terms), [len(a) for a in there]), np.concatenate(impacts))
    total = np.zeros(n, dtype=np.int64)
    for a, i in zip(there, impacts, strict=True):
        total[a] += i
    heap: list = []
    scored = shard.wand(list(range(terms)), heap, 10)
    assert sorted(heap) == sorted(heapq.nlargest(10, [(int(s), -int(d)) for s, d in zip(total, ids, strict=True) if s]))
    assert scored < (total > 0).sum() / 2
    assert shard.wand([99], [], 10) == 0


def _plain_lloyd(rows, n, rounds, dimensions):
    own = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and len(v) == dimensions and all(c is not None and math.isfinite(c) and abs(c) < 1e5 for c in v)]
    order = sorted(own, key=lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:n]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        near = defaultdict(list)
        for _, v in own:
            near[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(near[k]) for x in zip(*near[k], strict=True)] if k in near else c for k, c in enumerate(centroids)]
    placed = [(i, *nearest(v)[::-1]) for i, v in own]
    by = Counter()
    for _, k, d in placed:
        by[k] += d
    return Counter((i, k, d, by[k], sum(by.values()), tuple(centroids[k])) for i, k, d in placed)


@pytest.mark.parametrize("n", [1, 7, 400])
def test_clusters_by_brute_force(spark, n):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 0.1, (120, 4)) + rng.integers(0, 3, (120, 1)))]
    rows += [(200 + i, [0.25, -0.25, 0.0, 1.0]) for i in range(30)] + [(7, rows[7][1]), (None, [0.5] * 4), (300, None), (301, []), (302, [0.0] * 3), (303, [0.0] * 5), (304, [0.0, None, 0.0, 0.0])]
    rows += [(305 + i, [x, 0.0, 0.0, 0.0]) for i, x in enumerate((math.nan, math.inf, -math.inf, 1e30, 5e4))]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, cluster int, x int")
    got = clustering.clusters(df, n=n, rounds=3, dimensions=4)
    assert Counter((*tuple(r)[:5], tuple(r["centroid"])) for r in got.collect()) == _plain_lloyd(rows, n, 3, 4)
    assert "centroid_sha256" in clustering.digest(got).columns


def test_clusters_of_nothing(spark):
    assert clustering.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert clustering.clusters(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 0


def test_nearest_centroid_is_the_lowest_of_equals():
    near, square = clustering.assign(np.array([[0, 0], [3, 0]]), np.array([[1, 0], [-1, 0], [0, 1], [5, 0]]))
    assert near.tolist() == [0, 0] and square.tolist() == [1, 4]


def test_learner_by_the_formulas():
    rng = np.random.default_rng(5)
    learner, z, n = quality.Learner(), Counter(), Counter()
    for _ in range(200):
        slots = np.sort(rng.choice(50, 6, replace=False))
        values, y = rng.random(6), int(rng.integers(2))
        learner.learn(slots, values, y)
        x = [*zip(slots.tolist(), values.tolist(), strict=True), (quality.DIMENSIONS, 1.0)]
        w = {k: 0.0 if abs(z[k]) <= quality.L1 else -(z[k] - math.copysign(quality.L1, z[k])) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2) for k, _ in x}
        p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x)))
        for k, v in x:
            g = (p - y) * v
            z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality.ALPHA * w[k]
            n[k] += g * g
    assert all(abs(learner.z[k] - z[k]) < 1e-9 and abs(learner.n[k] - n[k]) < 1e-9 for k in z)


def test_features_by_plain_hashing():
    text = "The End of the end!! !!\nof of of"
    tokens = ["The", "End", "of", "the", "end", "!!", "!!", "\n", "of", "of", "of"]
    h = [zlib.crc32(t.encode()) for t in tokens]
    both = h + [a * 0x9E3779B97F4A7C15 + b * 3 + 1 for a, b in zip(h, h[1:], strict=False)] + [1 << 40] * 3
    counts = Counter(x * 0xD6E8FEB86659FD93 % 2**64 >> 64 - quality.BITS for x in both)
    slots, values = quality.features(text)
    assert slots.tolist() == sorted(counts)
    want = np.array([1 + math.log(counts[s]) for s in sorted(counts)])
    assert np.allclose(values, want / np.sqrt((want**2).sum()))
    assert all(len(quality.features(t)[0]) == 0 for t in (None, "", "  "))
    assert abs((quality.features("a b\n" * 200_000)[1] ** 2).sum() - 1) < 1e-9


def test_quality_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op13_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y, _ in held) / len(held) > 0.9
    good, bad = [s for _, y, s in held if y], [s for _, y, s in held if not y]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.95


def test_quality_learns_only_from_its_folds(spark):
    """Labels of held-out ids, odd labels and null ids change nothing."""
    docs = spark.createDataFrame([(i, ("good words here" if i % 2 else "bad ## words ##"), *ODD) for i in range(60)] + [(None, "good", *ODD), (70, None, *ODD), (71, "", *ODD), (1, "good words here", *ODD)], DOC)
    kept = [(i, i % 2) for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    more = [(i, 1 - i % 2) for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0] + [(None, 0), (5, None), (6, 7)]
    schema = "doc_id long, quality int"
    one, two = (quality.fit(docs, spark.createDataFrame(rows, schema)) for rows in (kept, kept + more))
    assert (one.weights == two.weights).all() and one.weights.any()
    got = [(r["doc_id"], r["score"]) for r in quality.score(docs, one).collect()]
    assert len(got) == 64 and all((s > 0.5) == bool(d % 2) for d, s in got if d is not None and d < 60)
    assert len({s for d, s in got if d in (70, 71)}) == 1
    assert {r["doc_id"] for r in quality.without_poor(docs, one, 0.5).collect()} >= set(range(1, 60, 2))
    assert quality.without_poor(docs, one).columns == docs.columns
    assert quality.score(docs.where("false"), one).count() == 0
    none = quality.fit(docs, spark.createDataFrame([], schema))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}


def test_quality_takes_a_bounded_sample(spark):
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    usable = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 5]
    taken = {r["id"] for r in quality._taken(labels, 5, 0, 4_000).collect()}
    assert 2_700 < len(taken) <= 4_000 and taken <= set(usable)
    assert quality._taken(labels, 5, 0, 20_000).count() == len(usable)
