"""Language-model scores by a weighted backoff automaton.

The model is a trigram model with hierarchical Dirichlet smoothing (MacKay and Peto):
p(w) = (c(w) + 1) / (N + V + 1), and p(w | h) = (c(hw) + m p(w | h')) / (c(h) + m) where h' is h without its
first word. As an automaton: each n-gram of one or two words that training has is a state, besides the root and the
start. A state h has an arc for each word seen after it, of weight p(w | h), to the longest suffix of hw that is a state, and
a failure arc of weight m / (c(h) + m) to h'. The root has an arc for each word, and one for all unknown words.
A text is read once from left to right: the state is carried from token to token, failure arcs are followed
until the state has an arc for the token, and the logarithms of all arcs taken are added up.

The automaton grows with the corpus, so no task holds it. Documents are read into blocks of bounded
bytes, as word codes, and written once. A block asks for the n-grams it has, each once and with its own training
count; the counts are summed over all blocks and sent back, which gives the block the part of the automaton that its
documents can reach. Requests and replies are packed arrays, a row for each block and range of keys, so that no
word's or n-gram's rows meet in one task. Single words have 64-bit keys. Longer n-grams have fingerprints 16 bits longer than
the logarithm of their number, as in randomised language models: one n-gram in about 65,000 takes part of another's count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import remainder, stored, texts_of, words_of

BLOCK_BYTES = 8 << 20
DEST_KEYS = 6_000_000
LEAST_DESTS = 16
#: Of states of one word and of two: the best for held-out texts of sf0.1 among 12 pairs tried.
MASSES = (1000.0, 30.0)
SPARE_BITS = 16
SEGMENT = 256
END, START = b" ", b"\t"  # no word holds white space

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

BLOCK = "block long, ids array<long>, held binary, lengths binary, hashes binary, codes binary, n_tokens long, n_words long"
REQUEST = "dest long, level int, block long, keys binary, counts binary"
REPLY = "block long, level int, dest long, counts binary, n long, v long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers as byte planes, compressed; the first byte is their width."""
    v = np.ascontiguousarray(values, dtype="<u8")
    width = (int(v.max(initial=0)).bit_length() + 7) // 8
    planes = np.ascontiguousarray(v.view("u1").reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(v).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    width, n = blob[0], int.from_bytes(blob[1:9], "little")
    out = np.zeros((n, 8), dtype="u1")
    if n and width:
        out[:, :width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[9:]), dtype="u1").reshape(width, n).T
    return out.view("<u8").ravel()


def encoded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the tokens of texts, the texts' lengths in tokens, and a 64-bit hash for each code; 0 is the end, 1 the start."""
    codes: dict[bytes, int] = {END: 0, START: 1}
    flat: list[int] = []
    lengths = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        w = words_of(t)
        lengths[i] = len(w) + 1
        flat.extend([codes.setdefault(x, len(codes)) for x in w])
        flat.append(0)
    return np.array(flat, dtype=np.int64), lengths, np.fromiter((xxh64_intdigest(w) for w in codes), dtype=np.uint64, count=len(codes))


class Block:
    """The tokens and n-grams of a block's documents.

    Of each level there are keys, sorted, the block's own training counts in their order, and the order itself.
    """

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, train: np.ndarray, bits: int) -> None:
        self.tokens, self.lengths, self.size = tokens, lengths, len(hashes)
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        taught = np.repeat(train, lengths)
        shift = np.uint64(64 - bits)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._add(_mixed(hashes * _A)[self._words()], np.bincount(tokens[taught], minlength=self.size)[self._words()])
        # Pairs of a word (at first the start) and the next; the start's own count travels with them.
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.starts] = 1
        self.pairs, pair_of = np.unique(before * self.size + tokens, return_inverse=True)
        pair_keys = _mixed(hashes[self.pairs // self.size] * _B + _mixed(hashes[self.pairs % self.size] * _C))
        own = np.bincount(pair_of, weights=taught, minlength=len(self.pairs)).astype(np.int64)
        self._add(np.append(pair_keys, _mixed(hashes[1:2] * _C)) >> shift, np.append(own, int(train.sum())))
        # Triples: a pair, by its number, and the next word.
        later = np.ones(len(tokens), dtype=bool)
        later[self.starts] = False
        at = np.flatnonzero(later)
        self.triples, triple_of = np.unique(pair_of[at - 1] * self.size + tokens[at], return_inverse=True)
        own = np.bincount(triple_of, weights=taught[at], minlength=len(self.triples)).astype(np.int64)
        keys = _mixed(pair_keys[self.triples // self.size] * _A + _mixed(hashes[self.triples % self.size] * _C) + _C)
        self._add(keys >> shift, own)

    def _words(self) -> np.ndarray:
        return np.delete(np.arange(self.size), 1)  # all codes but the start

    def _add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.levels.append((keys[order], counts[order], order))

    def requests(self, dests: list[int], bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(level, dest, keys, counts) for each destination, which holds a range of keys."""
        for level, (keys, counts, _) in enumerate(self.levels):
            head = keys >> np.uint64(32 if level == 0 else bits - 32)
            at = np.searchsorted((head * np.uint64(dests[level]) >> np.uint64(32)).astype(np.int64), np.arange(dests[level] + 1))
            for d in np.flatnonzero(np.diff(at)):
                yield level, int(d), keys[at[d] : at[d + 1]], counts[at[d] : at[d + 1]]

    def totals(self, level: int, others: np.ndarray) -> np.ndarray:
        """Training counts of the whole corpus, in the order of the block's n-grams, from what other blocks have of the sorted keys."""
        _, own, order = self.levels[level]
        out = np.empty(len(order), dtype=np.int64)
        out[order] = own + others.astype(np.int64)
        return out


class Automaton:
    """The part of the automaton that a block's documents can reach.

    States are -1 for the root, the code of a word, or `size` + the number of a pair of words. Arcs are sorted arrays.
    """

    def __init__(self, size: int, word: np.ndarray, pairs: np.ndarray, pair: np.ndarray, triples: np.ndarray, triple: np.ndarray, n: int, v: int, masses: tuple[float, float]) -> None:
        self.size, self.word = size, word
        root = (word + 1.0) / (n + 1.0 * (v + 1))
        self.root = np.log10(root)
        m2, m3 = masses
        # What training lacks is no state and no arc. Keys of n-grams can collide, so one that it lacks may come with another's count:
        # a pair needs both its words and a triple both its pairs, and neither is more frequent than what it consists of.
        pair = np.minimum(pair, np.minimum(word[pairs // size], word[pairs % size]))
        seen = pair > 0
        self.arcs2, c2 = pairs[seen], pair[seen]
        first, self.last = self.arcs2 // size, self.arcs2 % size
        p2 = (c2 + m2 * root[self.last]) / (word[first] + m2)
        self.weight2 = np.log10(p2)
        self.fail1 = np.log10(m2 / (word + m2))
        self.fail2 = np.log10(m3 / (c2 + m3))
        number = np.cumsum(seen) - 1
        had = np.flatnonzero((triple > 0) & seen[triples // size])
        state, w = number[triples[had] // size], triples[had] % size
        next_, hit = self._find(self.arcs2, self.last[state] * size + w)
        had, state, w, self.next3 = had[hit], state[hit], w[hit], next_[hit]
        self.arcs3 = state * size + w
        c3 = np.minimum(triple[had], np.minimum(c2[state], c2[self.next3]))
        self.weight3 = np.log10((c3 + m3 * p2[self.next3]) / (c2[state] + m3)) if len(had) else np.zeros(0)

    @staticmethod
    def _find(arcs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(arcs):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(arcs, keys), len(arcs) - 1)
        return at, arcs[at] == keys

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each state over a token: the weight of the failure arcs and the arc taken, and the next state."""
        weight, state, out = np.zeros(len(token)), state.copy(), np.full(len(token), -1, dtype=np.int64)
        two = np.flatnonzero(state >= self.size)
        at, hit = self._find(self.arcs3, (state[two] - self.size) * self.size + token[two])
        weight[two[hit]], out[two[hit]] = self.weight3[at[hit]], self.size + self.next3[at[hit]]
        miss = two[~hit]
        weight[miss] = self.fail2[state[miss] - self.size]
        state[miss] = self.last[state[miss] - self.size]
        one = np.flatnonzero((state >= 0) & (state < self.size))
        at, hit = self._find(self.arcs2, state[one] * self.size + token[one])
        weight[one[hit]] += self.weight2[at[hit]]
        out[one[hit]] = self.size + at[hit]
        miss = one[~hit]
        weight[miss] += self.fail1[state[miss]]
        state[miss] = -1
        none = np.flatnonzero(state < 0)
        weight[none] += self.root[token[none]]
        out[none] = np.where(self.word[token[none]] > 0, token[none], -1)
        return weight, out

    def read(self, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The sum of weights of each text, by one traversal from left to right of all texts side by side.

        A state remembers two tokens, so a long text's later segments begin at the root two tokens early: having read those, the state is that of the whole text.
        """
        parts = -(-lengths // SEGMENT)
        text = np.repeat(np.arange(len(lengths)), parts)
        part = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        early = np.where(part > 0, 2, 0)
        begin = starts[text] + part * SEGMENT - early
        steps = np.minimum(lengths[text] - part * SEGMENT, SEGMENT) + early
        order = np.argsort(-steps, kind="stable")
        text, begin, steps, early = text[order], begin[order], steps[order], early[order]
        state = np.where(early > 0, -1, 1 if self.word[1] > 0 else -1).astype(np.int64)
        total = np.zeros(len(text))
        live = np.searchsorted(-steps, -np.arange(steps.max(initial=0)), side="left")
        for t, n in enumerate(live):
            weight, state[:n] = self.step(state[:n], tokens[begin[:n] + t])
            total[:n] += np.where(t >= early[:n], weight, 0.0)
        return np.bincount(text, weights=total, minlength=len(lengths))


def language_model_scores(docs: DataFrame, masses: tuple[float, float] = MASSES, block_bytes: int = BLOCK_BYTES, dest_keys: int = DEST_KEYS, spare_bits: int = SPARE_BITS) -> DataFrame:
    """Scores of all whole texts by a model of those whose crc32(doc_id as text) mod 7 is not 2.

    A null text is empty and has the end token alone. Documents with null ids are in the training
    part. Repeated rows train and are scored as often as they come. Without training documents,
    every token is unknown and has weight 1 / (0 + 0 + 1). No rows give none.

    There are at most blocks x destinations requests, and no more than n-grams; for much larger inputs, block_bytes and
    dest_keys should grow with the executors' memory.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        held: list[bool] = []
        texts: list[str | None] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal number, size
            tokens, lengths, hashes = encoded(texts)
            row = [number, list(ids), bytes(held), packed(lengths), hashes.tobytes(), packed(tokens), len(tokens), len(hashes)]
            types = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int64(), pa.int64()]
            number, size = number + 1, 0
            ids.clear(), held.clear(), texts.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], _names(BLOCK))

        for b in batches:
            for i, t, h in zip(b.column(0).to_pylist(), texts_of(b), b.column(2).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                held.append(h)
                size += len(t or "") + 16
                if size >= block_bytes:
                    yield block()
        if texts:
            yield block()

    read = docs.select(F.col("doc_id").cast("long"), "text", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"))
    held_blocks = stored(read.mapInArrow(blocks, BLOCK), wide=True)
    tokens, words = (int(x or 0) for x in held_blocks.agg(F.sum("n_tokens"), F.sum("n_words")).first())
    bits = min(64, max(32, (2 * tokens).bit_length() + spare_bits))
    dests = [max(LEAST_DESTS, -(-x // dest_keys)) for x in (words, tokens, tokens)]

    def opened(row: dict) -> Block:
        train = np.frombuffer(row["held"], dtype="u1") == 0
        return Block(unpacked(row["codes"]).astype(np.int64), unpacked(row["lengths"]).astype(np.int64), np.frombuffer(row["hashes"], dtype=np.uint64), train, bits)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                # Keys are sorted, so their differences are small.
                found = [(d, level, row["block"], packed(np.diff(k, prepend=np.uint64(0))), packed(c)) for level, d, k, c in opened(row).requests(dests, bits)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], _names(REQUEST))

    def answer(t: pa.Table) -> pa.Table:
        level, dest = t.column("level")[0].as_py(), t.column("dest")[0].as_py()
        keys = [np.cumsum(unpacked(x.as_buffer().to_pybytes()), dtype=np.uint64) for x in t.column("keys")]
        counts = [unpacked(x.as_buffer().to_pybytes()).astype(np.int64) for x in t.column("counts")]
        names, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, weights=np.concatenate(counts), minlength=len(names)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        # What other blocks have: mostly nothing, so it packs well.
        out = [(b, level, dest, packed(sums[at[e - len(k) : e]] - c), None, None) for b, k, c, e in zip(t.column("block").to_pylist(), keys, counts, ends, strict=True)]
        if level == 0:
            out.append((-1, -1, dest, b"", int(sums.sum()), int((sums > 0).sum())))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], _names(REPLY))

    asked = held_blocks.mapInArrow(ask, REQUEST)
    replies = stored(asked.groupBy("dest", "level").applyInArrow(answer, REPLY))
    n, v = (int(x) for x in replies.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first())

    def score(own: pa.Table, got: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        block = opened(row)
        parts = sorted(zip(*(got.column(c).to_pylist() for c in ("level", "dest", "counts")), strict=True), key=lambda x: x[:2])
        word, pair, triple = (block.totals(level, np.concatenate([unpacked(c) for x, _, c in parts if x == level] or [np.zeros(0, np.uint64)])) for level in range(3))
        word = np.insert(word, 1, pair[-1])  # the start's count
        automaton = Automaton(block.size, word, block.pairs, pair[:-1], block.triples, triple, n, v, masses)
        known = (word > 0)[block.tokens].astype(np.int64)
        per = lambda x: np.add.reduceat(x, block.starts)
        held = np.frombuffer(row["held"], dtype="u1") != 0
        return pa.Table.from_arrays(
            [pa.array(row["ids"], pa.int64()), pa.array(held), pa.array(block.lengths), pa.array(per(known)), pa.array(np.full(len(held), n, dtype=np.int64)), pa.array(per(automaton.root[block.tokens])), pa.array(automaton.read(block.tokens, block.starts, block.lengths))],
            _names(SCORED),
        )

    sent = held_blocks.drop("n_tokens", "n_words")
    return sent.groupBy("block").cogroup(replies.where("level >= 0").groupBy("block")).applyInArrow(score, SCORED)
