"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Different vectors are dealt to shards of bounded size by their scale, which is that of their largest component, and by hash. A shard's graph is built by
insertion and stored as flat arrays of neighbours. Queries go to every shard in blocks that are much larger than a
graph, and a query's best rows of all shards are merged. Equal vectors are one node that stands for all its ids.

For inner products, each vector gets one more component that gives all of a shard's vectors the same norm;
the order by inner product is then the order by distance, which such graphs need. Vectors of one scale have similar norms, so
that few long ones don't swamp the differences of the others, and they are scaled to at most 1, so that none is too large for float32.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, stored

NEIGHBOURS = 20
LINKS = 16
BUILD_WIDTH = 64
#: On full shards of Gaussian vectors, recall of the 20 nearest is 0.99 of 64 dimensions and 0.94 of 128.
SEARCH_WIDTH = 512
EXPAND = 8
SHARD_VECTORS = 8_192
LEAST_SHARDS = 6
QUERY_BLOCK = 65_536
#: Powers of 2 that the largest components of a scale span.
SCALE_BITS = 4


def lifted(vectors: np.ndarray) -> np.ndarray:
    """float32 vectors with one more component, all of the same norm, 1 at most."""
    vectors = np.asarray(vectors, dtype=np.float64)
    vectors = vectors / max(np.abs(vectors).max(initial=0), 5e-324)
    vectors = vectors / max(np.sqrt(np.einsum("ij,ij->i", vectors, vectors)).max(initial=0), 1.0)
    norms = np.einsum("ij,ij->i", vectors, vectors)
    last = np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))
    return np.column_stack([vectors, last]).astype(np.float32)


class Graph:
    """Layers of flat neighbour arrays, -1 where there is none. Layer 0 has all nodes; rows have room for half again as many neighbours as they are thinned to."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]] | None = None, entry: int = -1) -> None:
        self.x = lifted(vectors)
        self.layers = layers or []  # of each: the row of a node or -1, and the rows of neighbours
        self.entry = entry
        self.seen = np.zeros(len(vectors), dtype=np.int64)
        self.last = np.zeros(len(vectors), dtype=np.int64)
        self.mark = 0

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 0) -> Graph:
        g, n = cls(vectors), len(vectors)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(LINKS)).astype(int), 12)
        for k in range(int(level.max(initial=0)) + 1):
            own = np.flatnonzero(level >= k)
            row = np.full(n, -1, dtype=np.int32)
            row[own] = np.arange(len(own))
            g.layers.append((row, np.full((len(own), LINKS * 3 // (1 if k == 0 else 2)), -1, dtype=np.int32)))
        for i in range(n):
            g._insert(i, int(level[i]), level)
        return g

    def _insert(self, i: int, top: int, level: np.ndarray) -> None:
        if self.entry < 0:
            self.entry = i
            return
        q, at = self.x[i], np.array([self.entry])
        for k in range(int(level[self.entry]), -1, -1):
            ids, near = self._layer(q, at, k, 1 if k > top else BUILD_WIDTH)
            at = ids if k <= top else ids[:1]
            if k <= top:
                for j in self._diverse(ids, near, LINKS):
                    self._link(i, j, k)
                    self._link(j, i, k)
        if top > level[self.entry]:
            self.entry = i

    def _diverse(self, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """The nearest, without those that are nearer to one already taken; filled up with the nearest others."""
        if len(ids) <= most:
            return ids
        between = self.x[ids] @ self.x[ids].T
        blocked = np.zeros(len(ids), dtype=bool)
        taken: list[int] = []
        for n in range(len(ids)):
            if not blocked[n]:
                taken.append(n)
                if len(taken) == most:
                    break
                blocked |= between[n] > near
        if len(taken) < most:
            taken += np.setdiff1d(np.arange(len(ids)), taken)[: most - len(taken)].tolist()
        return ids[taken]

    def _link(self, i: int, j: int, k: int) -> None:
        row, rows = self.layers[k]
        own = rows[row[i]]
        free = (own < 0).nonzero()[0]
        if len(free):
            own[free[0]] = j
            return
        # A full row is thinned to two thirds, so that this is done once for many links.
        ids = np.append(own, j)
        near = self.x[ids] @ self.x[i]
        order = np.argsort(-near, kind="stable")
        kept = self._diverse(ids[order], near[order], len(own) * 2 // 3)
        own[:] = -1
        own[: len(kept)] = kept

    def _layer(self, q: np.ndarray, at: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of one layer: up to `width` nodes and their inner products, nearest first. Several nodes are expanded a step."""
        row, rows = self.layers[k]
        self.mark += 1
        self.seen[at] = self.mark
        ids, near = at, self.x[at] @ q
        order = np.argsort(-near, kind="stable")
        ids, near, fresh = ids[order], near[order], np.ones(len(at), dtype=bool)
        step = 1 if width == 1 else EXPAND
        while True:
            next_ = fresh.nonzero()[0][:step]
            if not len(next_):
                return ids, near
            fresh[next_] = False
            more = rows[row[ids[next_]]].ravel()
            more = more[more >= 0]
            more = more[self.seen[more] != self.mark]
            if not len(more):
                continue
            self.last[more] = np.arange(len(more))
            more = more[self.last[more] == np.arange(len(more))]  # each once
            self.seen[more] = self.mark
            dots = self.x[more] @ q
            ids, near, fresh = np.concatenate([ids, more]), np.concatenate([near, dots]), np.concatenate([fresh, np.ones(len(more), dtype=bool)])
            order = np.argsort(-near, kind="stable")[:width]
            ids, near, fresh = ids[order], near[order], fresh[order]

    def search(self, q: np.ndarray, width: int) -> np.ndarray:
        """Up to `width` nodes near a vector, nearest first."""
        if self.entry < 0:
            return np.zeros(0, dtype=int)
        q, at = np.append(np.asarray(q, dtype=np.float64) / max(np.abs(q).max(initial=0), 5e-324), 0).astype(np.float32), np.array([self.entry])
        for k in range(len(self.layers) - 1, 0, -1):
            if self.layers[k][0][self.entry] >= 0:
                at = self._layer(q, at, k, 1)[0]
        return self._layer(q, at, 0, width)[0]

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, entry=self.entry, **{f"{n}{k}": a for k, pair in enumerate(self.layers) for n, a in zip(("row", "rows"), pair, strict=True)})
        return out.getvalue()

    @classmethod
    def unpacked(cls, vectors: np.ndarray, blob: bytes) -> Graph:
        z = np.load(io.BytesIO(blob))
        return cls(vectors, [(z[f"row{k}"], z[f"rows{k}"]) for k in range(len(z.files) // 2)], int(z["entry"]))


def inner_products(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """In double precision, component by component, so that equal vectors have equal products wherever they stand."""
    vectors, out = np.asarray(vectors, dtype=np.float64), np.zeros(len(vectors))
    for k in range(len(q)):
        out += vectors[:, k] * q[k]
    return out


def matrix_of(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


GRAPH = "dim int, scale int, shard long, ids array<array<long>>, vectors binary, graph binary"
HITS = "query_id long, vec_id long, score double"


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, width: int = SEARCH_WIDTH, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest rows found of each query, by inner product, ties to the smaller vec_id.

    Both inputs have vec_id and embedding. A row with its query's own id is no candidate. Rows whose
    id is null or whose vector is null, empty, zero or holds null or non-finite components take no part; vectors of
    other dimensions than the query's aren't candidates. Repeated rows count once. No rows give none.
    """
    n_rows = embeddings.count()
    shards = max(LEAST_SHARDS, -(-n_rows // shard_vectors))
    kept = "<f4" if isinstance(embeddings.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"  # without loss

    def valid(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
        finite = "vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x != 0)"
        return df.where(finite).distinct()

    # A vector's smallest ids are enough: no query needs more than k of them besides its own.
    ranked = valid(embeddings).withColumn("n", F.expr("row_number() over (partition by v order by vec_id)")).where(F.col("n") <= k + 1)
    nodes = ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    scale = F.floor(F.log2(F.array_max(F.transform("v", F.abs))) / SCALE_BITS).cast("int")
    nodes = nodes.select(F.size("v").alias("dim"), scale.alias("scale"), F.pmod(F.xxhash64("v"), F.lit(shards)).alias("shard"), "v", "ids")

    def build(t: pa.Table) -> pa.Table:
        vectors = matrix_of(t.column("v"))
        order = np.lexsort(vectors.T)  # the same graph whatever the rows' order
        order = order[np.random.default_rng(0).permutation(len(order))]
        vectors = vectors[order]
        ids = t.column("ids").to_pylist()
        row = [[t.column("dim")[0].as_py()], [t.column("scale")[0].as_py()], [t.column("shard")[0].as_py()], [[ids[i] for i in order]], [vectors.astype(kept).tobytes()], [Graph.build(vectors).packed()]]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, x) for c, x in zip(row, types, strict=True)], ["dim", "scale", "shard", "ids", "vectors", "graph"])

    graphs = stored(nodes.groupBy("dim", "scale", "shard").applyInArrow(build, GRAPH), wide=True)
    asked = cut(valid(queries))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    asked = asked.join(F.broadcast(graphs.select("dim", F.expr("scale + 0").alias("scale")).distinct()), "dim")  # few: doubles have 2,100 powers of 2
    spread = graphs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(graph: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple[list, list, list]] = []
        if graph.num_rows and block.num_rows:
            vectors = np.frombuffer(graph.column("vectors")[0].as_py(), dtype=kept).reshape(-1, graph.column("dim")[0].as_py())
            g, ids = Graph.unpacked(vectors, graph.column("graph")[0].as_py()), graph.column("ids")[0].as_py()
            for own, q in zip(block.column("vec_id").to_pylist(), matrix_of(block.column("v")), strict=True):
                found = g.search(q, width)
                scores = inner_products(vectors[found], q)
                rows = sorted((-s, i) for s, f in zip(scores.tolist(), found, strict=True) for i in ids[f] if i != own)[:k]
                out += [(own, i, -s) for s, i in rows]
        cols = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.Table.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    keys = ("dim", "scale", "shard", "block")
    hits = spread.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, HITS)
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = best.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)").cast("int"))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
