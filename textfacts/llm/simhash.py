"""SimHash near-duplicates by BK-trees over shards of fingerprints.

A shard holds fingerprints that can be close to each other, and its tree goes only to the
fingerprints of that shard. The trees of all shards together grow with the data, so they have
no bound that would allow a broadcast to every task; each is built where its shard was shuffled.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator
from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import EDGE, Joined, components, cut, runs_of, stored, texts_of, words_of

SEED = 42
CHUNK = 1 << 18


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle of `size` words, repeats included; one of all words if there are fewer, none without words."""
    w = words_of(text)
    if not w:
        return np.zeros(0, dtype="<u8")
    shingles = map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else [b" ".join(w)]
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=max(1, len(w) - size + 1))


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half of the hashes; 0 without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK]
        ones += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class BKTree:
    """Flat arrays of nodes; a node's children are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.prints: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        prints, children = self.prints, self.children
        prints.append(x)
        children.append({})
        if len(prints) == 1:
            return
        at, new = 0, len(prints) - 1
        while True:
            d = (prints[at] ^ x).bit_count()
            below = children[at].get(d)
            if below is None:
                children[at][d] = new
                return
            at = below

    def within(self, x: int, radius: int) -> list[int]:
        """Nodes at most radius away; only edges whose key differs from the parent's distance by at most radius are followed."""
        if not self.prints:
            return []
        prints, children, found, todo = self.prints, self.children, [], [0]
        while todo:
            at = todo.pop()
            d = (prints[at] ^ x).bit_count()
            if d <= radius:
                found.append(at)
            for key, child in children[at].items():
                if -radius <= key - d <= radius:
                    todo.append(child)
        return found


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and the 64-bit SimHash (as a signed long) of each text. Null texts count as empty: fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [signed(fingerprint(shingle_hashes(t, shingle))) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(prints, pa.int64())], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, print long")


def print_links(prints: DataFrame, radius: int = 2, blocks: int = 8) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints at most `radius` bits apart, in linear number.

    Of `blocks` blocks of bits, two such fingerprints agree on at least blocks - radius, so each
    goes to one shard for every choice of that many blocks. With 8 blocks and radius 2 a shard's
    members differ in 16 bits at most, so it has no more than 65,536 whatever the input.
    In a shard, a BK-tree finds the neighbours of each fingerprint among those before it; only
    links that join two parts are given out.
    """
    width = 64 // blocks
    masks = []
    for kept in combinations(range(blocks), blocks - radius):
        masks.append(sum(((1 << (width if i < blocks - 1 else 64 - width * (blocks - 1))) - 1) << (width * i) for i in kept))
    keys = F.array(*(F.struct(F.lit(i).alias("shard"), F.col("print").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for shard in runs_of(batches, ["shard", "key"]):
            values, tree, parts = shard.column("print").to_pylist(), BKTree(), Joined()
            for x in values:
                for i in tree.within(x & (2**64 - 1), radius):
                    if parts.join(values[i], x):
                        a.append(values[i])
                        b.append(x)
                tree.add(x & (2**64 - 1))
            if len(a) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = prints.select("print", F.explode(keys).alias("k")).select("k.shard", "k.key", "print")
    return dealt.repartition("shard", "key").sortWithinPartitions("shard", "key", "print").mapInArrow(run, EDGE)


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable by links.

    Takes columns doc_id and text; others may have any names. Null and empty texts have fingerprint
    zero and link like any other. Null ids are kept and never a component's id unless all its ids
    are null. Repeated rows give repeated results. No rows give none.
    """
    prints = cut(fingerprints(docs, shingle))
    distinct = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    roots = components(print_links(distinct.select("print"), radius))
    rooted = distinct.join(roots, distinct["print"] == roots["node"], "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(named, "root").select("print", "component_id")
    return prints.join(classes, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


# --- near-duplicate texts by similarity ------------------------------------------------------

MINHASHES = 8
SIGNATURE = 128
#: Signatures this far over the limit make a pair sure; so far under it, they drop it. Over three deviations.
BAND = 0.12
#: Bounds of a cell, the part of a shard that one task holds: rows, and bytes of texts.
CELL_ROWS, CELL_BYTES = 512, 8 << 20
_M = np.random.default_rng(7)
_KEY_A = _M.integers(1, 2**63, MINHASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIG_A = _M.integers(1, 2**63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mins(hashes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Smallest value of the hashes under each multiplicative permutation."""
    out = np.full(len(odd), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096]
        mixed = (part ^ (part >> np.uint64(29)))[:, None] * odd[None, :]
        out = np.minimum(out, mixed.min(axis=0))
    return out


def near_duplicate_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 22) -> DataFrame:
    """doc_id and group_id (smallest doc_id of its group) of each document, by near_duplicate_classes()."""
    ids, classes = near_duplicate_classes(docs, shingle, similarity, radius)
    return ids.join(classes, "node").select("doc_id", "group_id")


def without_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 22) -> DataFrame:
    """docs with one document of each group: that of the smallest doc_id. All its columns are kept, whatever their names; repeated rows stay once.

    A group whose ids are all null keeps one of its documents.
    """
    ids, classes = near_duplicate_classes(docs, shingle, similarity, radius)
    key = f"text_key_{uuid.uuid4().hex}"
    kept = classes.where("stays").select(F.col("text_key").alias("kept_key"), F.col("first").alias("kept_first"))
    keyed = docs.withColumn(key, _text_key())
    out = keyed.join(kept, (keyed[key] == kept["kept_key"]) & keyed["doc_id"].cast("long").eqNullSafe(kept["kept_first"]), "left_semi")
    if ids.groupBy("doc_id", "node").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", key])
    return out.drop(key)


def _text_key() -> Column:
    """128 bits that stand for a text; a null text is as an empty one."""
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


CELL = ["k", "key", "i", "j"]


def diagonal(rows: DataFrame, weight: Column, limit: int) -> tuple[DataFrame, DataFrame]:
    """rows (k, key, node, ...) with columns i, j and block, each shard (k, key) dealt to blocks of about `limit` in weight that are a cell each; and the shards of more than one block.

    Only rows of one block meet, so the work is linear in the rows.
    """
    heavy = stored(rows.groupBy("k", "key").agg(F.ceil(F.sum(weight) / limit).cast("int").alias("blocks")).where("blocks > 1"))
    dealt = rows.join(heavy, ["k", "key"], "left").withColumn("block", F.pmod(F.xxhash64("node", "k"), F.coalesce("blocks", F.lit(1))).cast("int"))
    return dealt.withColumn("i", F.col("block")).withColumn("j", F.col("block")).drop("blocks"), heavy.select("k", "key")


def crossed(rows: DataFrame, weight: Column, limit: int) -> DataFrame:
    """rows (k, key, node, root, ...) with columns i, j and block: cells of bounded weight in which all pairs of a shard meet whose roots differ.

    In each shard, the rows of the root that weighs most need not meet each other. The rest and they are dealt to blocks,
    and each block of the rest meets every block in one cell. A shard of one root gives no cells.
    """
    roots = rows.groupBy("k", "key", "root").agg(F.sum(weight).alias("w"))
    shards = roots.groupBy("k", "key").agg(F.sum("w").alias("all"), F.max("w").alias("most"), F.max_by("root", "w").alias("main")).where("all > most")
    shards = stored(shards.select("k", "key", "main", F.ceil((F.col("all") - F.col("most")) / limit).cast("int").alias("rest"), F.ceil(F.col("most") / limit).cast("int").alias("mains")))
    dealt = rows.join(shards, ["k", "key"])
    hashed, of_main = F.xxhash64("node", "k"), F.col("root") == F.col("main")
    block = F.when(of_main, F.col("rest") + F.pmod(hashed, F.col("mains"))).otherwise(F.pmod(hashed, F.col("rest")))
    dealt = dealt.withColumn("block", block.cast("int"))
    last = F.when(of_main, F.col("rest") - 1).otherwise(F.col("rest") + F.col("mains") - 1)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "main", "rest", "mains")


class Parts:
    """Parts of a bounded number of rows, by a label of each."""

    def __init__(self, label: np.ndarray) -> None:
        self.label = label

    def join(self, a: int, b: int) -> bool:
        """True if a and b were apart."""
        x, y = self.label[a], self.label[b]
        if x != y:
            self.label[self.label == x] = y
        return bool(x != y)


class Cell:
    """The rows of one cell in plain arrays, with the candidates that its BK-tree gives."""

    def __init__(self, rows: pa.Table) -> None:
        self.nodes, self.prints, self.blocks = (rows.column(c).to_pylist() for c in ("node", "print", "block"))
        self.k, self.key, self.i, self.j = (rows.column(c)[0].as_py() for c in ("k", "key", "i", "j"))
        self.sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), dtype="u1").reshape(-1, SIGNATURE)
        self.keys = np.frombuffer(b"".join(rows.column("low").to_pylist()), dtype="<u4").reshape(-1, MINHASHES)

    def candidates(self, radius: int, parts: Parts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, earlier rows within `radius` bits in other parts, their signatures' similarity), most alike first.

        Rows of one block meet in that block's own cell only. The tree holds each fingerprint once.
        """
        tree, at, place = BKTree(), [], {}
        for row, x in enumerate(self.prints):
            x &= 2**64 - 1
            if self.blocks[row] == self.j:
                found = np.fromiter(chain.from_iterable(at[t] for t in tree.within(x, radius)), dtype=np.int64)
                found = found[parts.label[found] != parts.label[row]]
                if len(found):
                    alike = (self.sig[found] == self.sig[row]).mean(axis=1)
                    order = np.argsort(-alike, kind="stable")
                    yield row, found[order], alike[order]
            if self.blocks[row] == self.i:
                if x not in place:
                    place[x] = len(at)
                    at.append([])
                    tree.add(x)
                at[place[x]].append(row)

    def first_meeting(self, row: int, found: np.ndarray) -> np.ndarray:
        """Of found rows, whether this shard's key is the first that they share with `row`."""
        return ~(self.keys[found, : self.k] == self.keys[row, : self.k]).any(axis=1)


def near_duplicate_classes(docs: DataFrame, shingle: int, similarity: float, radius: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of each document, where node stands for a text, and (node, text_key, first, group_id, stays) of each text.

    Linked are texts whose sets of word shingles have Jaccard similarity of `similarity` or more, linked.

    Equal texts are one member of their group from the start. Fingerprints of different texts are
    dealt to shards by eight min-hash values of their shingle sets, so that two texts of similarity
    s meet with probability 1 - (1 - s)^8, 0.999997 at 0.8. A shard's BK-tree gives the fingerprints
    within `radius` bits; at similarity 0.8 a bit differs with probability 0.15, so that 22 of 64 bits
    are over four deviations beyond the mean. A signature of 128 min-hashes (their low bytes: of many
    shingles, the high ones of any minimum are near zero) tells sure pairs from doubtful ones.

    A large shard is dealt to blocks. First, rows meet within blocks only; as a group of near copies is dealt otherwise in
    each of its shards, this joins most of it. Then those rows of large shards meet that no link has joined so far.
    Either time, sure pairs are joined at once; only texts that have a doubtful pair outside their own part come,
    with their texts, to the shard where the two first met, and the exact similarity of the shingle
    sets is taken there, of pairs that no link has joined so far. Each task gives out only links
    that join two parts, never its pairs.
    Equal texts are told by 128 bits. Null and empty texts have no shingles; they are alike and form one group. Null ids sort last.
    """
    low, high = similarity - BAND, similarity + BAND

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in texts_of(b):
                h = np.unique(shingle_hashes(t, shingle))
                keys = _mins(h, _KEY_A)
                sig = (_mins(h, _SIG_A) & np.uint64(0xFF)).astype("u1").tobytes()
                rows.append((signed(fingerprint(h)), keys.astype(np.int64).tolist(), (keys & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), sig, len((t or "").encode("utf-8", "replace"))))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, types)], ["node", "print", "keys", "low", "sig", "bytes"])

    text = F.coalesce("text", F.lit(""))
    ids = cut(docs.select(F.col("doc_id").cast("long"), _text_key().alias("text_key")))
    first = stored(ids.groupBy("text_key").agg(F.min("doc_id").alias("first")).withColumn("node", F.monotonically_increasing_id()))
    ids = ids.join(first.select("text_key", "node"), "text_key").select("doc_id", "node")
    # One row of each different text: the first of its ids stands for it. Repeated rows are merged when they are sketched.
    one = docs.select(F.col("doc_id").cast("long").alias("id"), _text_key().alias("id_key"), text.alias("text"))
    one = one.join(first, (one["id_key"] == first["text_key"]) & one["id"].eqNullSafe(first["first"])).select("node", "text")
    sketched = stored(one.mapInArrow(sketch, "node long, print long, keys array<long>, low binary, sig binary, bytes long").dropDuplicates(["node"]))
    in_order = [*CELL, "block", "node"]

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links (a, b) of sure pairs; rows (a, k, key) of texts with doubtful pairs that no sure link joined."""
        for rows in runs_of(batches, CELL):
            cell, links, doubtful = Cell(rows), [], (array("i"), array("i"))
            nodes = cell.nodes
            parts = Parts(np.unique(rows.column("root").to_numpy(), return_inverse=True)[1])
            for row, found, alike in cell.candidates(radius, parts):
                links += [(nodes[m], nodes[row]) for m in found[alike >= high].tolist() if parts.join(m, row)]
                found = found[(alike >= low) & (alike < high)]
                found = found[cell.first_meeting(row, found)]
                doubtful[0].extend(found.tolist())
                doubtful[1].extend([row] * len(found))
            x, y = (np.array(d, dtype=np.int64) for d in doubtful)
            apart = parts.label[x] != parts.label[y]
            marked = sorted({nodes[r] for r in np.union1d(x[apart], y[apart]).tolist()})
            n = len(marked)
            columns = [[a for a, _ in links] + marked, [b for _, b in links] + [None] * n, [None] * len(links) + [cell.k] * n, [None] * len(links) + [cell.key] * n]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["a", "b", "k", "key"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, CELL):
            cell, links, texts, sets = Cell(rows), [], rows.column("text"), {}
            nodes, parts = cell.nodes, Parts(np.unique(rows.column("root").to_numpy(), return_inverse=True)[1])

            def shingles(row: int, texts=texts, sets=sets) -> np.ndarray:
                if row not in sets:
                    sets[row] = np.unique(shingle_hashes(texts[row].as_py(), shingle))
                return sets[row]

            for row, found, alike in cell.candidates(radius, parts):
                found = found[alike >= low]
                for m in found[cell.first_meeting(row, found)].tolist():
                    if parts.label[m] == parts.label[row]:
                        continue
                    x, y = shingles(m), shingles(row)
                    both = 0
                    if min(len(x), len(y)) >= similarity * max(len(x), len(y)):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                    if both >= similarity * (len(x) + len(y) - both):
                        parts.join(m, row)
                        links.append((nodes[m], nodes[row]))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    def met(cells: DataFrame, by, schema: str) -> DataFrame:
        return cells.repartition(*CELL).sortWithinPartitions(*in_order).mapInArrow(by, schema)

    def with_roots(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
        if roots is None:
            return rows.withColumn("root", F.col("node"))
        return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def with_texts(cells: DataFrame, marked: DataFrame) -> DataFrame:
        texts = one.join(marked.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
        return cells.drop("bytes").join(texts, "node")

    size, sure_schema = F.col("bytes") + CELL_BYTES // CELL_ROWS, "a long, b long, k int, key long"
    dealt = sketched.select("node", "print", "low", "sig", F.posexplode("keys").alias("k", "key"))

    def doubtful(found: DataFrame, roots: DataFrame) -> DataFrame:
        """The marked rows of shards in which not all have one root yet, with what cells need."""
        marked = with_roots(found.where("b is null").select(F.col("a").alias("node"), "k", "key").distinct(), roots)
        open_ = marked.groupBy("k", "key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("k", "key")
        return cut(marked.join(open_, ["k", "key"], "left_semi").join(sketched.drop("keys"), "node"))

    # Within blocks.
    cells, heavy = diagonal(with_roots(dealt, None), F.lit(1), CELL_ROWS)
    found = cut(met(cells, sure, sure_schema))
    links = found.where("b is not null").select("a", "b")
    roots = cut(components(links))
    marked = doubtful(found, roots)
    cells, heavy_marked = diagonal(marked, size, CELL_BYTES)
    links = cut(links.unionByName(met(with_texts(cells, marked), exact, EDGE)))
    roots = cut(components(links))
    # Between blocks, of shards that have several.
    found = cut(met(crossed(with_roots(dealt.join(heavy, ["k", "key"], "left_semi"), roots), F.lit(1), CELL_ROWS), sure, sure_schema))
    links = links.unionByName(found.where("b is not null").select("a", "b"))
    before = marked.join(heavy_marked, ["k", "key"], "left_semi").select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "k", "key")
    roots = cut(components(links))
    marked = doubtful(found.unionByName(before), roots)
    links = cut(links.unionByName(met(with_texts(crossed(marked, size, CELL_BYTES), marked), exact, EDGE)))
    roots = components(links)
    rooted = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node")).alias("best")
    named = rooted.groupBy("root").agg(best)
    classes = rooted.join(named, "root").select("node", "text_key", "first", F.col("best.first").alias("group_id"), (F.col("node") == F.col("best.node")).alias("stays"))
    return ids, classes
