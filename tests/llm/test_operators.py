"""Small tests of the training-data operators: brute force, round trips and odd rows."""

import hashlib
import itertools
import math
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from textfacts.llm import ann, decontaminate, licences, lm, packing, secrets, sharding, simhash, suffixes, toxicity
from textfacts.llm.common import Joined, components

PASSAGE = " ".join(f"word{i}" for i in range(60))
SCHEMA = "doc_id long, text string, score double, key long, node long, print long, block long, leaf int"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [PASSAGE, PASSAGE, "lead in " + PASSAGE + " and out", PASSAGE.replace("word30", "other"), "", None, "one", "one two", "the idiot said " * 30, "password = 'abcdef123456'\nx = y", "x " * 5000]
    rows = [(i, t, 0.5, 1, 2, 3, 4, 5) for i, t in enumerate(texts)] + [(None, "no id", None, None, None, None, None, None), (6, "one", 0.5, 1, 2, 3, 4, 5), (6, "one", 0.5, 1, 2, 3, 4, 5)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 100: 50, 101: 50} | ({0: 0} if 0 in got else {}) | ({50: 50} if 50 in got else {})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bk_tree():
    rng = np.random.default_rng(1)
    prints = [int(x) for x in rng.integers(0, 2**63, 300)]
    prints += [p ^ 1 << int(rng.integers(64)) for p in prints[:100]]
    tree = simhash.BKTree()
    for p in prints:
        tree.add(p)
    for q in prints[::17]:
        for r in (0, 2, 16):
            assert sorted(tree.within(q, r)) == [i for i, p in enumerate(prints) if (p ^ q).bit_count() <= r]


def test_simhash_components(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = [simhash.fingerprint(simhash.shingle_hashes(t, 3)) for _, t in rows]
    j = Joined()
    for a, b in itertools.combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            j.join(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[j.root(i)] = min(d, least.get(j.root(i), d))
    want = Counter((d, f"{p:016x}", least.get(j.root(i))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True)))
    assert Counter(map(tuple, simhash.simhash_components(docs).collect())) == want
    assert prints[4] == prints[5] == 0
    assert simhash.simhash_components(empty).count() == 0


def test_near_duplicates(docs, empty):
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicate_groups(docs).collect() if r["doc_id"] is not None}
    assert got[1] == 0 and got[2] == 0 and got[5] == 4 and got[8] == 8
    assert got[3] == 0  # 51 of 61 shingles in common
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect())[:-1] == [(False, i) for i in (0, 4, 6, 7, 8, 9, 10)]
    assert simhash.without_near_duplicates(empty).count() == 0


def test_near_duplicates_keep_all_columns(spark):
    """Columns named like the operator's own, repeated rows, null ids and ids of several texts."""
    rows = [(1, "a b c d e f", 7, "p"), (1, "a b c d e f", 7, "p"), (2, "a b c d e f", 8, "q"), (None, "x y z", 9, "r"), (3, None, 1, "s"), (4, "", 2, "t"), (1, "other words here", 3, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _node long, text_key string").withColumn("node", F.lit(5)).withColumn("first", F.lit(6)).withColumn("root", F.lit(0)).withColumn("kept_first", F.lit(0))
    kept = simhash.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert Counter(tuple(r)[:4] for r in kept.collect()) == Counter([rows[0], rows[3], rows[4], rows[6]])


@pytest.mark.parametrize(("rows", "size"), [(4096, 32 << 20), (16, 40_000)])
def test_near_duplicates_by_brute_force(spark, rows, size, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", rows)
    monkeypatch.setattr(simhash, "CELL_BYTES", size)
    rng = np.random.default_rng(6)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    for t in texts[:60]:
        w = t.split(" ")
        for _ in range(6):  # similarities from 0.6 to 1, many near 0.8, to the text and to each other
            v = list(w)
            for at in rng.choice(len(w), int(len(w) * rng.uniform(0, 0.04)) + 1):
                v[at] = f"new{rng.integers(1000)}"
            texts.append(" ".join(v))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    parts, common, holders = Joined(), Counter(), {}
    for i, s in enumerate(sets):
        for h in s:
            for j in holders.setdefault(h, []):
                common[j, i] += 1
            holders[h].append(i)
    for (j, i), n in common.items():
        if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
            parts.join(j, i)
    for i in [i for i, s in enumerate(sets) if not s][1:]:
        parts.join(next(i for i, s in enumerate(sets) if not s), i)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicate_groups(df).collect()}
    assert got == {i: parts.root(i) for i in range(len(texts))}
    assert 100 < len(set(got.values())) < len(texts)


def _windows(rows, n=50):
    at = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        for p in range(len(w) - n + 1):
            at.setdefault(b" ".join(w[p : p + n]), set()).add((d, p))
    return {(d, p) for v in at.values() if len({d for d, _ in v}) > 1 for d, p in v}


@pytest.mark.parametrize("limit", [1 << 17, 2])
def test_repeated_passages(docs, empty, limit, monkeypatch):
    monkeypatch.setattr(suffixes, "RUN_ROWS", limit)
    want = _windows([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None])
    rows = suffixes.repeated_passages(docs).collect()
    assert {(r["doc_id"], p) for r in rows for p in range(r["start_word"], r["end_word"] - 49)} == want
    assert {r["doc_id"]: r["other_doc"] for r in rows} == {0: 1, 1: 0, 2: 0}
    assert suffixes.repeated_passages(empty).count() == 0


def test_myers():
    def plain(p, t):
        row = list(range(len(p) + 1))
        best = len(p)
        for c in t:
            new = [0]
            for i, x in enumerate(p):
                new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
            row = new
            best = min(best, row[-1])
        return best

    rng = np.random.default_rng(2)
    for _ in range(200):
        p, t = ("".join(rng.choice(list("abc"), rng.integers(1, n))) for n in (12, 30))
        assert decontaminate.myers(decontaminate.peq_of(p), len(p), t)[0] == plain(p, t)


def test_leaks(spark, docs, empty):
    item = " ".join(f"benchmark{i} item" for i in range(12))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one two")], "item_id long, text string")
    bad = spark.createDataFrame([(1, "so: " + item.upper()), (2, "x " + item.replace("k5 ", "k6 ")), (3, item[: len(item) // 2]), (4, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.leaks(bad, bench).orderBy("doc_id").collect()] == [(1, 1, 0), (2, 1, 1)]
    assert {r["doc_id"] for r in decontaminate.leaks(docs, bench).collect()} == {7}
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(bad, bench).collect()) == [3, 4]
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def _distance_within(item, text):
    """Smallest edit distance between an item and any part of a text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, c in enumerate(text):
            new.append(min(row[j] + (x != c), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_leaks_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = ["ab", "cd", "abc", "word", "other", "longer", "a"]
    items = [" ".join(rng.choice(words, int(rng.integers(1, 14)))) for _ in range(40)]
    texts = []
    for item in items * 2:
        t = list(item)
        for _ in range(int(rng.integers(0, 4))):
            at = int(rng.integers(0, len(t) + 1))
            t[at : at + int(rng.integers(0, 2))] = rng.choice(list("abx "), int(rng.integers(0, 2))).tolist()
        texts.append(" ".join(rng.choice(words, 5)) + rng.choice([" ", "", "! "]) + "".join(t) + rng.choice([" ", "", ", "]) + " ".join(rng.choice(words, 4)))
    texts += ["xa a a", "xa ax", "", None]
    items += ["a a", "The item of thirty-one letters", None, ""]
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            x, norm = decontaminate.normal(item), decontaminate.normal(t)
            if x and norm and (n := _distance_within(f" {x} ", f" {norm} ")) <= int(0.08 * len(x)):
                want.add((d, i, n))
    df, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for size in (decontaminate.BLOCK_BYTES, 300):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        assert {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.leaks(df, bench).collect()} == want
        assert {r["doc_id"] for r in decontaminate.without_leaks(df, bench).collect()} == set(range(len(texts))) - {d for d, _, _ in want}
    assert any(n for _, _, n in want) and (80, 40, 0) in want and (81, 40, 0) not in want


def test_leaks_of_short_items_with_edits():
    item = "item of one and thirty letters."  # 30 characters of normal text
    find = decontaminate.Matcher(((1, item),), 0.08).find
    assert find("so: item of one and thirdy letters") == [(1, 1, 3, 33)]
    assert find("so: item of one and thirty letters") == [(1, 0, 3, 33)]


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        words = [f"w{x}" for x in rng.integers(0, 300, 40)]
        words = ["".join(chr(97 + int(c)) for c in str(x)[1:]) + "q" for x in words]
        if i % 5 == 0:
            words.insert(3, ["gronk", "blarf"][i % 2])
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    held = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    right = sum((s >= 0.7) == (i % 5 == 0) for i, s in held.items()) / len(held)
    assert right > 0.95
    none = toxicity.fit(empty, df.select("doc_id", "toxic").limit(0))
    got = toxicity.score(docs, none).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in got if r["score"] >= 0.7} == {8}
    assert toxicity.without_toxic(docs, none).columns == docs.columns
    assert toxicity.score(empty, none).count() == 0


def test_toxicity_scores_by_plain_sums(spark):
    """Every score of a fitted model as the logistic of a sum over the different words of a text, of very long and repeated ones too."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    more = spark.createDataFrame([(900_001, "you idiot " * 60_000), (900_002, None), (900_003, ""), (900_004, "You IDIOT!!!! stooopid"), (900_004, "You IDIOT!!!! stooopid")], "doc_id long, text string")
    every = docs.unionByName(more)
    want = []
    for r in every.collect():
        z = model.bias + sum(model.weights.get(f, 0.0) for term in toxicity.terms_of(r["text"]) for f in toxicity.features_of(term))
        want.append((r["doc_id"], round(1 / (1 + math.exp(-z)), 9)))
    assert sorted((r["doc_id"], round(r["score"], 9)) for r in toxicity.score(every, model).collect()) == sorted(want)
    kept = sorted(r["doc_id"] for r in toxicity.without_toxic(every, model).collect())
    assert kept == sorted(d for d, s in want if s < 0.7)


def test_toxicity_without_toxic_labels_still_learns(spark):
    """All labels clean: there is no lexicon, but the classifier learns from the posterior labels, so a listed word that clean texts have alone weighs less than one that comes with others."""
    rows = [(i, " ".join([f"plain{'abcdefgh'[i % 8]}", "trash" if i % 2 else "day", "you idiot, you moron, pathetic loser" if i % 10 == 0 else "fine"]) + " " + "q".join(chr(97 + int(c)) for c in str(i))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(df, df.select("doc_id", F.lit(0).alias("toxic")))
    assert not any(name.startswith("lexicon") for name, _ in model.voters)
    weight = {w: model.weights.get(zlib.crc32(b"w" + w), 0.0) for w in (b"trash", b"idiot", b"moron")}
    assert weight[b"trash"] < 1 < weight[b"idiot"]  # all listed words begin at the same weight
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    for i, t in rows[:50]:
        z = model.bias + sum(model.weights.get(f, 0.0) for term in toxicity.terms_of(t) for f in toxicity.features_of(term))
        assert abs(scores[i] - 1 / (1 + math.exp(-z))) < 1e-9
    assert {r["doc_id"] for r in toxicity.without_toxic(df, model).collect()} == {i for i, x in scores.items() if x < 0.7}


def test_votes_by_brute_force(spark, docs):
    voters = [("a", frozenset([zlib.crc32(b"wone"), zlib.crc32(b"widiot")])), ("b", frozenset([zlib.crc32(b"4two"), zlib.crc32(b"4idio")])), ("c", frozenset([zlib.crc32(b"#stretch")]))]
    texts = [r["text"] for r in docs.collect()] + ["aaaaaa idiotic", "idiot", "one idiot"] * 7
    n, moments = toxicity._moments(spark.createDataFrame([(t,) for t in texts], "text string"), voters)
    on = np.array([[any(f in words for term in toxicity.terms_of(t) for f in toxicity.features_of(term)) for _, words in voters] for t in texts], dtype=float)
    assert n == len(texts) and (moments == on.T @ on).all() and moments[0, 1] > 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(12)
    y = rng.random(200_000) < 0.2
    rates = [(0.7, 0.05), (0.5, 0.02), (0.6, 0.1), (0.3, 0.01), (0.4, 0.08)]
    fired = np.column_stack([np.where(y, rng.random(len(y)) < a, rng.random(len(y)) < b) for a, b in rates]).astype(float)
    fired = np.column_stack([fired, fired[:, 0]])  # a voter that repeats the first
    accuracy, correlation = toxicity._label_model(len(y), fired.T @ fired, 0.2)
    assert np.abs(accuracy[1:5] - np.array(rates[1:])).max() < 0.05
    assert correlation[0, 5] > 0.5 and abs(correlation[1, 2]) < 0.1


def test_toxicity_takes_the_least_hashes(spark):
    """The sample is the same as by ordering all usable labels, at sizes below and above their number."""
    labels = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 11 != 0, F.col("id") % 2).alias("toxic")).union(spark.sql("SELECT cast(null AS long), 1L"))
    rows = [tuple(r) for r in labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int"), F.xxhash64("doc_id")).collect()]
    order = [r[:2] for r in sorted(rows, key=lambda r: (r[2], r[0])) if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    for n in (1, 40, 3_000, len(order), 2 * len(order)):
        assert sorted(tuple(r) for r in toxicity._taken(labels, n).collect()) == sorted(order[:n])
    assert toxicity._taken(labels.limit(0), 10).count() == 0


def test_toxicity_learns_from_rows_past_12000(spark):
    ids = spark.range(21_000).where("crc32(cast(id as string)) % 3 != 1").orderBy(F.xxhash64("id"), "id").limit(13_500)
    rows = [(r["id"], "gronk blarf" if i >= 12_000 and i % 3 == 0 else f"plain{'abcdefgh'[i % 8]} words", int(i >= 12_000 and i % 3 == 0)) for i, r in enumerate(ids.collect())]
    # Groups of copies count as one document, so each text is its own.
    rows = [(i, f"{t} {'q'.join(chr(97 + int(c)) for c in str(i))}", y) for i, t, y in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    assert any(zlib.crc32(b"wgronk") in words for name, words in model.voters if name.startswith("lexicon"))


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8)).astype(np.float32).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[3].tolist()) for i in range(40)]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0] + [None] * 7), (None, x[0].tolist()), (2020, [1.0, 2.0]), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    good = {i: np.array(v, dtype=float) for i, v in rows if i is not None and i < 2000}
    hits = total = 0
    for q in (i for i in good if i % 20 == 0):
        want = sorted((-float(ann.inner_products(v[None], good[q])[0]), i) for i, v in good.items() if i != q)[:20]
        hits += len({i for _, i in want} & {i for i, _ in got[q]})
        total += len(want)
        assert all(s == float(ann.inner_products(good[i][None], good[q])[0]) for i, s in got[q]) and len(got[q]) == 20
    assert hits / total > 0.9
    assert 2020 not in got and 2000 not in got
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_graph_finds_what_its_beam_is_narrower_than():
    """Recall on a full shard, with the production beam and with one of a hundredth of the shard."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(ann.SHARD_VECTORS, 64)).astype(np.float32).astype(np.float64)
    g = ann.Graph.build(x)
    g = ann.Graph.unpacked(x.astype(np.float32), g.packed())
    for width, least in ((ann.SEARCH_WIDTH, 0.97), (40, 0.6)):
        hits = 0
        for q in range(0, len(x), 64):
            near = ann.inner_products(x, x[q])
            near[q] = -np.inf
            hits += len(set(np.argsort(-near)[:20].tolist()) & set([i for i in g.search(x[q], width).tolist() if i != q][:20]))
        assert hits / (20 * len(range(0, len(x), 64))) >= least


def test_nearest_of_many_shards(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), width=32, shard_vectors=300).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, len(x), 20):
        near = ann.inner_products(x, x[q])
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 21)) and all(s == near[i] for _, i, s in rows) and rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        near[q] = -np.inf
        hits += len(set(np.argsort(-near)[:20].tolist()) & {i for _, i, _ in rows})
    assert hits / (20 * 150) > 0.9  # the beam holds a tenth of a shard


@pytest.mark.parametrize("long", [1.0, 1e5, 1e20, 1e-20])
def test_nearest_with_one_long_vector(spark, long):
    rng = np.random.default_rng(23)
    vectors = rng.normal(0, 1, (1500, 32))
    vectors[0] *= long
    vectors[1::7] *= 10 ** rng.uniform(-3, 3, (len(vectors[1::7]), 1))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 30 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    found = 0
    for i, v in enumerate(vectors):
        if i % 30 == 0:
            order = [j for j in np.argsort(-(vectors @ v), kind="stable") if j != i][:20]
            found += len(set(order) & set(got[i].values()))
            assert len(got[i]) == 20
    assert found / (20 * len(got)) >= 0.95


def test_secrets(docs, empty):
    text = "Token: 'abcd12' password=x1 AKIA" + "A1" * 8 + " " + "0a" * 12 + " secret=password=abcdefgh\nconst base = \"q8Zr-77xTy\"\ndb_password := base + 'tail-99Q'\npassword_length = 123456789"
    found = secrets.find(text)
    assert [s.kind for s in found if s.kind != "literal"] == ["assign", "access", "hex", "assign"]
    literals = {text[s.start : s.end] for s in found if s.kind == "literal"}
    assert {"q8Zr-77xTy", "tail-99Q"} <= literals and "123456789" not in literals
    clean = secrets.redact(text, found)
    assert not [s for s in secrets.find(clean) if s.kind != "literal"] and "q8Zr" not in clean
    rows = secrets.digest(secrets.scan(docs)).collect()
    assert len(rows) == docs.count() and {r["doc_id"] for r in rows if r["n_assign"]} == {9}
    assert all(r["base_sha256"] == secrets.base_digest_of(t) for r, t in zip(rows[:10], [x["text"] for x in docs.collect()][:10], strict=True))
    assert secrets.redacted(docs).columns == docs.columns and secrets.scan(empty).count() == 0


def _plain_base(text):
    """The base spans, by plain scans."""
    out, low, at = [], text.lower(), 0
    ok = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    while at < len(text):
        name = next((k for k in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(k, at)), None)
        end = None
        if name:
            i = at + len(name)
            i += text[i : i + 1] in ("'", '"')
            while text[i : i + 1] == " ":
                i += 1
            if text[i : i + 1] in (":", "="):
                i += 1
                while text[i : i + 1] == " ":
                    i += 1
                i += text[i : i + 1] in ("'", '"')
                j = i
                while j < len(text) and text[j] in ok:
                    j += 1
                if j > i:
                    end = j
                    if j - i >= 6:
                        out.append(("assign", at, j))
        at = end or at + 1
    for kind, head, chars, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), ("hex", "", set("0123456789abcdef"), 24)):
        at = 0
        while at < len(text):
            j = at + len(head)
            while text.startswith(head, at) and j < len(text) and text[j] in chars:
                j += 1
            if j > at + len(head):
                if j - at >= least:
                    out.append((kind, at, j))
                at = j
            else:
                at += 1
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_secrets_base_by_brute_force(spark):
    rng = np.random.default_rng(9)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", "'", '"', "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "abcdefabcdef", "x", "\n", "é", "ſecret", "K", "-", "+/", "zz9"]
    texts = ["".join(rng.choice(parts, int(rng.integers(1, 30)))) for _ in range(1500)] + [None, ""]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert len(got) == len(texts)
    for d, t in enumerate(texts):
        want = _plain_base(t or "")
        joined = [",".join(f"{k}:{a}:{b}" for k, a, b in some) for some in (want, [tuple(x.split(":")) for x in got[d]["spans"].split(",") if x and not x.startswith("literal")])]
        assert joined[0] == joined[1] and got[d]["base_sha256"] == hashlib.sha256(joined[0].encode()).hexdigest()
        assert tuple(got[d][f"n_{k}"] for k in ("assign", "access", "hex")) == tuple(sum(x[0] == k for x in want) for k in ("assign", "access", "hex"))


@pytest.mark.parametrize("text", [":" + "ab" * 500_000, "password=" * 110_000, "a." * 500_000 + "=x", "a: " + "mut " * 250_000 + "=", "a=`b='c=\"" * 30_000, "".join(f"x{i + 1} = x{i} + x{i}\n" for i in range(20_000)), "".join(f"x{i + 1} = x{i} + 'l{i}'\n" for i in range(20_000)), "a=f(" * 100_000, "a:\n " * 100_000, "<a>" * 150_000, "<a b" * 150_000, 'a="""b=\'\'\'' * 40_000, "a" * 300_000 + ":\n"], ids=["run", "nested", "dots", "type", "quotes", "doubling", "chain", "calls", "below", "tags", "attributes", "triple", "name"])
def test_secrets_in_linear_time(text):
    start = time.process_time()
    secrets.find(text)
    assert time.process_time() - start < 20  # some seconds at most; by squares it would be hours


def test_secrets_through_constants():
    text = "x0 = 'q8Zr-77xTy'\n" + "".join(f"x{i + 1} = x{i} + x{i}\n" for i in range(40)) + "db_password = x40\nlabel = 'q8Zr-99xTy'\nurl = page=client_key=Zx81-kkQ9v\n"
    assert {text[s.start : s.end] for s in secrets.find(text) if s.kind == "literal"} == {"q8Zr-77xTy", "Zx81-kkQ9v"}


@pytest.mark.parametrize("line", ["db_password: str = @", "let client_secret: String = @;", "const apiKey: string | null = @", "private readonly authToken?: Map<string, Array<string>> = @;", "static API_KEY: &'static str = @;", "val dbPassword: String? = @", "def f(x, password: Optional[str] = @, y=1):", "password: typing.Optional['str'] = @", "v: str = @\ndb_password = v"])
def test_secrets_of_typed_declarations(line):
    text = line.replace("@", '"Zx81-kkQ9v"')
    found = secrets.find(text)
    assert "Zx81-kkQ9v" in {text[s.start : s.end] for s in found if s.kind == "literal"}
    assert "Zx81" not in secrets.redact(text, found)


@pytest.mark.parametrize(
    "text",
    ['PASSWORD="""@"""', "x = 1\npassword:\n  @\nother: 2", "db:\n  - api_key: |\n      '@'", "<cfg><db:password type='a'> @ </db:password></cfg>", "DB_PASS=@", 'db.password = os.environ.get("DB_PASSWORD_NAME", "@")', "token = decode('@')", 'v = f(g("@"))\napi_key = v', "secret: str = os.getenv(key, default='@')"],
)
def test_secrets_of_more_forms(text):
    text = text.replace("@", "Zx81-kkQ9v")
    found = secrets.find(text)
    assert {text[s.start : s.end] for s in found if s.kind == "literal"} == {"Zx81-kkQ9v"}
    assert "Zx81" not in secrets.redact(text, found)


@pytest.mark.parametrize("text", ['password = os.environ.get("DB_PASSWORD_X9")', 'token = config.lookup_token("Zx81-key-name")', "password = self.vault.readPassword99()", "password:\n  see the Manual99-b for it", "<password>\n</password>", "password:\nZx81-kkQ9v", "bypass = 'Zx81-kkQ9v'"])
def test_secrets_leave_code_alone(text):
    assert [s for s in secrets.find(text) if s.kind == "literal"] == []


def test_secrets_keep_values_with_equals_signs():
    text = "client_secret: c2Vj-cmV0dmFsdWU=x9\nclient_secret: q8Zr77xTy0=\nlabel: string = 'q8Zr-77xTy'\nx: a == 'q8Zr-77xTy'"
    assert [text[s.start : s.end] for s in secrets.find(text) if s.kind == "literal" and "q8Zr-77xTy" in text[s.start : s.end]] == []
    assert {"c2Vj-cmV0dmFsdWU=x9", "q8Zr77xTy0"} <= {text[s.start : s.end] for s in secrets.find(text) if s.kind == "literal"}


def test_licences(spark, docs, empty):
    df = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0. All rights reserved."), (2, "x GNU General Public License, version 3"), (3, None), (4, "Licensed under the Apache License, Version 2.0."), (5, "under version license")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scan(df).collect()}
    assert (got[1]["base_labels"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == ("cc-by,reserved", 2, 2, 7)
    assert got[1]["labels"] == "cc-by,cc-by-nc-4.0,reserved" and got[2]["labels"] == "gpl,gpl-3.0" and got[4]["labels"] == "apache-2.0"
    assert (got[3]["n_words"], got[3]["labels"], got[3]["score"], got[3]["first_word"]) == (0, "", 0.0, None) and got[5]["labels"] == ""
    assert licences.scan(docs).count() == docs.count() and licences.scan(empty).count() == 0


def test_licences_base_by_sql(spark):
    """Base columns against DuckDB on texts of odd characters."""
    import duckdb

    rng = np.random.default_rng(11)
    parts = ["CC", "by", "cc-by", "general", "PUBLIC", "license", "all rights", "reserved", "All", "\n", " ", ".", "é", "K", "x9", "\x00", "‐"]
    texts = ["".join(x + rng.choice(["", " ", "-"]) for x in rng.choice(parts, int(rng.integers(1, 25)))) for _ in range(800)] + [None, ""]
    got = {r["doc_id"]: tuple(r)[1:6] for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    con = duckdb.connect()
    con.execute("create table t (id bigint, text varchar)")
    con.executemany("insert into t values (?, ?)", list(enumerate(texts)))
    phrases = " union all ".join(f"select {p.split()} p, '{label}' label" for p, label in licences.BASE.items())
    rows = con.execute(rf"""with w as (select id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from t),
      k as ({phrases}), h as (select id, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1 : i + len(p)] = p)) i, label from w, k)
      select w.id, len(w), count(i), min(i), max(i), coalesce(string_agg(distinct label, ',' order by label), '') from w left join h using (id) group by 1, 2""").fetchall()
    assert got == {r[0]: tuple(r[1:]) for r in rows} and any(r[2] > 1 for r in rows)


def _plain_share(index, e, text, offset):
    around = text[max(0, offset - e.slack) : max(0, offset + len(e.words) + e.slack)]
    if not all(licences.places(around, k) for k in e.keys) or any(licences.places(around, k) for k in e.without):
        return 0.0
    return min(1.0, sum(index.idf[w] for i, w in enumerate(e.words) if w in text[max(0, offset + i - e.slack) : max(0, offset + i + e.slack + 1)]) / e.weight)


def test_licences_by_brute_force():
    """Every template tried at every place: what is found has its share there, and what is well there is found, in texts with changed, dropped and inserted words."""
    index = licences.Index({b"license": 60, b"under": 200, b"the": 900, b"version": 30, b"software": 80, b"of": 950, b"or": 700}, 1000)
    rng = np.random.default_rng(7)
    texts = [[w for e in index.entries for w in [*e.words, b"and", b"then"]]]
    for n in range(40):
        text = []
        for e in rng.choice(len(index.entries), 2):
            words = list(index.entries[e].words)
            for at in rng.choice(len(words), len(words) * (n % 4) // 12):
                words[at : at + int(rng.integers(0, 2))] = [rng.choice([b"other", b"license", b"the"])]
            text += words + [b"gap"] * int(rng.integers(0, 9))
        texts.append(text)
    for text in texts:
        got = index.match(text)
        best, sure = {}, set()
        for e in index.entries:
            for o in range(-len(e.words), len(text) + 1):
                share = _plain_share(index, e, text, o)
                best[e.label] = max(best.get(e.label, 0.0), share)
                # With room in the slack, so that a near place does as well.
                tight = _plain_share(index, e._replace(slack=e.slack // 2), text, o)
                if tight >= licences.LEAST_SHARE:
                    sure.add(e.label)
        assert sure <= set(got) <= {k for k, v in best.items() if v >= licences.LEAST_SHARE}
        assert all(share <= best[k] + 1e-9 for k, share in got.items())
    assert set(index.match(texts[0])) == set(licences.TEMPLATES)
    assert all(e.keys and all(licences.places(e.words, k) for k in e.keys) and not any(licences.places(e.words, k) for k in e.without) for e in index.entries)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("mit license", set()),
        ("the MIT license is one of many", set()),
        ("Released under the MIT License.", {"mit"}),
        ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0"}),
        ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}),
        ("Copyright 2020 A. Person\n\n@mit@", {"mit"}),
        ("@bsd-2-clause@", {"bsd", "bsd-2-clause"}),
        ("@bsd-3-clause@", {"bsd", "bsd-3-clause"}),
        ("x " * 500 + "@isc@" + " y" * 500, {"isc"}),
        ("@0bsd@", {"0bsd"}),
        ("", set()),
    ],
)
def test_licence_texts(text, labels):
    for label in licences.TEMPLATES:
        text = text.replace(f"@{label}@", licences.TEMPLATES[label][0].text)
    assert set(licences.Index({b"license": 60, b"the": 900, b"under": 100}, 1000).match(licences.licence_words(text))) == labels


def test_licences_in_linear_time():
    index = licences.Index({}, 1)
    for unit in ("mit license under the ", "redistribution and use in source and binary forms ", "a ", licences.TEMPLATES["isc"][0].text + " "):
        words = licences.licence_words(unit * (1_200_000 // len(unit)))
        start = time.process_time()
        index.match(words)
        assert time.process_time() - start < 30


def test_sharding(spark, docs, empty):
    rows = [(i, "a" * (i % 97) if i % 3 else "copy", i) for i in range(3000)] + [(None, None, 0), (7, "seven", 0), (7, "seven", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size long")
    got = sharding.shard_documents(df, 8).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    assert sorted(by) == list(range(8)) and max(sizes) - min(sizes) < 400
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    assert sharding.shard_documents(empty, 8).count() == 0 and sharding.shard_documents(docs, 3).count() == docs.count()


def _plain_leaves(rows, leaves, dims, ties, weight, extent):
    """The k-d tree by sorting: the leaf of each row, and the dimensions that were split."""
    if leaves == 1 or not rows:
        return [(i, 0) for i, _ in rows], []
    spread = [(max(r[d] for _, r in rows) - min(r[d] for _, r in rows)) / max(1, extent[d]) for d in dims]
    widest = dims[max(range(len(dims)), key=lambda i: (spread[i], -i))]
    key = lambda r: (r[widest], *(r[t] for t in ties))
    groups = {}
    for i, r in rows:
        groups.setdefault(key(r), []).append((i, r))
    want, before, low, high = sum(r[weight] for _, r in rows) * (leaves // 2) / leaves, 0, [], []
    for k in sorted(groups):
        w = sum(r[weight] for _, r in groups[k])
        below = before + w <= want or (before < want and before + w - want < want - before)
        (low if below and not high else high).extend(groups[k])
        before += w
    left, a = _plain_leaves(low, leaves // 2, dims, ties, weight, extent)
    right, b = _plain_leaves(high, leaves - leaves // 2, dims, ties, weight, extent)
    return left + [(i, n + leaves // 2) for i, n in right], [widest, *a, *b]


def test_kd_tree_by_sorting(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BINS", 30)
    rng = np.random.default_rng(15)
    rows = [{"a": int(rng.integers(0, 40)), "b": int(rng.lognormal(3, 1)), "t": int(rng.integers(0, 9)), "u": i, "w": int(rng.integers(1, 100))} for i in range(700)]
    for leaves in (3, 8):
        df = spark.createDataFrame([tuple(r.values()) for r in rows], "a long, b long, t long, u long, w long")
        got = {r["u"]: r["leaf"] for r in sharding.kd_partition(df, ["a", "b"], ["t", "u"], "w", leaves, tolerance=0.0).collect()}
        want, split = _plain_leaves(list(enumerate(rows)), leaves, ["a", "b"], ["t", "u"], "w", {d: max(r[d] for r in rows) - min(r[d] for r in rows) for d in "ab"})
        assert got == dict(want) and (leaves < 8 or set(split) == {"a", "b"})


def test_shards_of_documents(spark):
    """Sizes and hashes by Python; equal texts together; target bytes; splits by measures of the text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = sharding.shard_documents(docs, target_bytes=sum(len(t.encode()) + 1 for t in texts.values()) // 5).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts.items()}
    shard = {r["doc_id"]: r["shard"] for r in got}
    assert set(shard.values()) == set(range(6))  # a sixth holds the division's rest
    by_text = {}
    for d, t in texts.items():
        by_text.setdefault(t, set()).add(shard[d])
    assert all(len(v) == 1 for v in by_text.values()) and len(by_text) < len(texts)
    point = sharding.metadata(spark.createDataFrame([(1, "Aé9\nB日 12")], "doc_id long, text string")).first()
    assert (point["chars"], point["breaks"], point["wide"], point["digits"], point["capitals"], point["size"]) == (9, 1, 3, 3, 2, 13)


def _plain_scores(tokens, held, masses):
    """(base, score) of each text by the smoothing formula, n-grams in plain counters."""
    c, pairs, triples = Counter(), Counter(), Counter()
    for w, h in zip(tokens, held, strict=True):
        if not h:
            c.update(w)
            c[lm.START] += 1
            pairs.update(zip([lm.START, *w], w, strict=False))
            triples.update(zip([lm.START, *w], w, w[1:], strict=False))
    start = c.pop(lm.START, 0)
    n, v = sum(c.values()), len(c)
    one = lambda t: (c[t] + 1) / (n + 1 * (v + 1))
    two = lambda a, t: (pairs[a, t] + masses[0] * one(t)) / ((start if a == lm.START else c[a]) + masses[0])
    three = lambda a, b, t: (triples[a, b, t] + masses[1] * two(b, t)) / (pairs[a, b] + masses[1])
    out = []
    for w in tokens:
        before = [None, lm.START, *w]
        out.append((sum(math.log10(one(t)) for t in w), sum(math.log10(two(b, t) if a is None else three(a, b, t)) for a, b, t in zip(before, before[1:], w, strict=False))))
    return n, c, out


def test_language_model(spark, docs, empty):
    long = np.random.default_rng(13).choice(["the", "a", "of", "law", "end", "new"], 1500)
    more = [(100 + i, " ".join(long[i * 90 : i * 90 + 700])) for i in range(9)] + [(200 + i, "said unseen words here" + " unseen" * i) for i in range(12)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    tokens = [(t or "").encode().lower().split() + [lm.END] for _, t in rows]
    held = [zlib.crc32(str("" if d is None else d).encode()) % 7 == 2 for d, _ in rows]
    n, c, plain = _plain_scores(tokens, held, lm.MASSES)
    want = sorted((round(a, 6), round(b, 6), len(w), sum(c[t] > 0 for t in w), h) for (a, b), w, h in zip(plain, tokens, held, strict=True))
    assert any(held) and len({x[1] for x in want}) > 20
    for size, keys in ((lm.BLOCK_BYTES, lm.DEST_KEYS), (900, 50)):
        got = lm.language_model_scores(df, block_bytes=size, dest_keys=keys, spare_bits=40).collect()
        assert sorted((round(r["base_score"], 6), round(r["score"], 6), r["n_tokens"], r["n_known"], r["held_out"]) for r in got) == want
        assert {r["train_tokens"] for r in got} == {n}
    assert lm.language_model_scores(empty).count() == 0


def test_language_model_without_training(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = lm.language_model_scores(spark.createDataFrame([(i, "some words") for i in ids], "doc_id long, text string")).collect()
    assert len(got) == len(ids) and {(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got} == {(0, 0, 0.0, 0.0)}


def test_automaton_carries_its_state():
    """The traversal token by token, with Python dictionaries for arcs, against the one side by side."""
    texts = ["a b c a b d", "a b c", "c c c a", "", "x a b", "b a b c " * 200]
    tokens, lengths, hashes = lm.encoded(texts)
    block = lm.Block(tokens, lengths, hashes, np.array([True, True, True, True, False, True]), 64)
    word, pair, triple = (block.totals(k, np.zeros(len(block.levels[k][0]), np.uint64)) for k in range(3))
    word = np.insert(word, 1, pair[-1])
    model = lm.Automaton(block.size, word, block.pairs, pair[:-1], block.triples, triple, int(np.delete(word, 1).sum()), int((np.delete(word, 1) > 0).sum()), (2.0, 0.5))
    arcs = {(-1, t): (model.root[t], t if word[t] > 0 else -1) for t in range(block.size)}
    arcs |= {(int(k // block.size), int(k % block.size)): (w, block.size + i) for i, (k, w) in enumerate(zip(model.arcs2, model.weight2, strict=True))}
    arcs |= {(int(k // block.size) + block.size, int(k % block.size)): (w, block.size + to) for k, w, to in zip(model.arcs3, model.weight3, model.next3, strict=True)}
    fail = {t: (model.fail1[t], -1) for t in range(block.size)} | {block.size + i: (w, model.last[i]) for i, w in enumerate(model.fail2)}
    for got, at, n in zip(model.read(block.tokens, block.starts, block.lengths), block.starts, block.lengths, strict=True):
        state, total = 1, 0.0
        for t in tokens[at : at + n].tolist():
            while (state, t) not in arcs:
                total += fail[state][0]
                state = int(fail[state][1])
            total, state = total + arcs[state, t][0], int(arcs[state, t][1])
        assert abs(got - total) < 1e-9


def test_automaton_with_collided_keys():
    """Counts of n-grams that training lacks, as collisions give them: no state without its words, no arc without its states, and no failure."""
    rng = np.random.default_rng(21)
    size = 40
    for some in (0.0, 0.1, 0.5, 1.0):
        word = rng.integers(0, 4, size) * (rng.random(size) < 0.7)
        pairs = np.sort(rng.choice(size * size, 300, replace=False))
        pair = rng.integers(1, 9, 300) * (rng.random(300) < some)
        triples = np.sort(rng.choice(300 * size, 900, replace=False))
        triple = rng.integers(1, 9, 900) * (rng.random(900) < 0.8)
        model = lm.Automaton(size, word, pairs, pair, triples, triple, int(word.sum()) or 1, int((word > 0).sum()), (2.0, 0.5))
        assert (np.diff(model.arcs2) > 0).all() and (np.diff(model.arcs3) > 0).all()
        assert all(word[k // size] and word[k % size] for k in model.arcs2)
        states = set(model.arcs2.tolist())
        assert all(int(model.last[k // size]) * size + int(k % size) in states for k in model.arcs3)
        assert all(len(w) == 0 or w.max() <= 0 for w in (model.root, model.weight2, model.weight3))
        tokens = rng.integers(0, size, 2_000)
        assert (model.read(tokens, np.array([0, 700]), np.array([700, 1_300])) < 0).all()


def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), path, with_ids=True).collect()
    for r in docs.where("doc_id is not null").collect():
        own = sorted((x for x in rows if x["doc_id"] == r["doc_id"]), key=lambda x: x["start"])
        ids = np.concatenate([np.frombuffer(x["ids"], "<u4") for x in own]).tolist()
        assert ids == [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]
    by = {}
    for x in rows:
        by.setdefault(x["sequence_id"], []).append(x)
    for own in by.values():
        own.sort(key=lambda x: x["offset"])
        assert [x["offset"] for x in own] == [sum(y["length"] for y in own[:i]) for i in range(len(own))]
    assert packing.pack_documents(empty, path).count() == 0 and packing.pack_documents(docs, path).agg(F.sum("length")).first()[0] > 0


def test_packing_by_the_tokenizer(spark):
    """Each piece against Tokenizer.encode, on texts whose characters compose, fold and hold tokens' names."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["J̌ H̱ T̈ W̊ Y̊", "Ångström ÅNGSTRÖM", "İstanbul ΣΑΣ ſtraße K", "<|ENDOFTEXT|> <|endoftext|>x", "Don't SAY it's 12,5 %!", "日本語 テスト", "a b C", "X" * 3000, "", None]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for d, x in enumerate(texts):
        ids, at = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4"), 0
        for r in sorted(by[d], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes())) and r["length"] > 0
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        assert sum(r["length"] for r in own) <= 2048
        assert sorted(r["offset"] for r in own) == [sum(y["length"] for y in own if y["offset"] < r["offset"]) for r in sorted(own, key=lambda r: r["offset"])]


def test_pack_is_tight():
    rng = np.random.default_rng(5)
    lengths = [int(x) for x in rng.lognormal(6, 1.5, 500)]
    sequences = packing.pack(lengths)
    sizes = [sum(p.length for p in s) for s in sequences]
    assert sum(sizes) == sum(lengths) and all(s == 2048 or s & (s - 1) == 0 for s in sizes)
    of = Counter(sizes)
    assert all(of[t] > 3 for t in packing.TIERS) and sum(n for x, n in of.items() if x not in packing.TIERS) < 11  # the window's tail
    groups, count = packing.tiered_steps(sequences)
    held = {}
    for x, g in zip(sizes, groups, strict=True):
        held.setdefault(g, []).append(next(t for t in packing.TIERS if x <= t))
    assert sorted(held) == list(range(count)) and all(len(set(v)) == 1 and len(v) <= 16 * 2048 // v[0] for v in held.values())
    places = sorted((p.doc, p.start, p.length) for s in sequences for p in s)
    for (d, a, n), (e, b, _) in itertools.pairwise(places):
        assert b == (a + n if d == e else 0)
    costs = Counter()
    for s, g in zip(sequences, packing.step_groups(sequences), strict=True):
        costs[g] += sum(p.length**2 for p in s)
    assert max(costs.values()) < 1.6 * (sum(costs.values()) / len(costs))
