"""Lexical retrieval packing into windows of WINDOW tokens.

Every text is tokenised once; whole windows are cut off as sequences of their own and the rest, the tail, is packed with
others. Tails are range-partitioned by the leaf of a small tree of term centroids, fitted on SAMPLE tails at most, and by a min-hash of
their tokens inside it, so that texts with the same words come near each other, and each partition is read in index shards of SHARD
tails. A shard is a BM25 inverted index (document
frequencies over all tails): each seed, longest first, is a query of all its terms, and its best
unused neighbours in the shard fill its window, the last one cut to fit. What doesn't fill a window goes on to the next shard, so
only the last window of a partition is padded.

A task holds one shard at a time, whatever the size of its partition, and (leaf, min-hash, doc_id) splits any group of copies.

Ids are those of `tokenizers` for every text, also for the longest runs of white space. Texts go through in slices of SLICE_BYTES.

Edge cases: a null or empty text is the end token alone; a null doc_id is carried; rows that repeat or share a doc_id are packed as
documents of their own; tails of equal length are seeds in the order of (min-hash, doc_id), and neighbours of equal score are taken
in that order; a very long text is cut into windows of its own; an empty table gives no piece; of other columns, whatever their
names, none is read. The string of the vocabulary's special token in a text is that token, as in `tokenizers`.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .batches import map_rows, slices
from .common import materialize

WINDOW, SHARD, END, K1, B = 1024, 2048, 0, 1.2, 0.75
DENSE, SAMPLE, BRANCH, DIMS, SEED = 0.03, 4000, 8, 2048, 7  # the tree has two levels of BRANCH centroids over DIMS hashed terms
TOKENIZER = "byte_bpe_50k.json"
#: The regular expressions of `tiktoken` overflow on longer runs of white space; `tokenizers` takes such texts.
LONG_SPACE = re.compile(r"\s{4096}")


class Ids:
    """The byte-level BPE of a public tokenizer file: `tokenizers` itself where white space runs long, elsewhere `tiktoken` on the
    ranks that lie beside the file, with the same ids at four times the speed."""

    def __init__(self, name: str) -> None:
        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.plain = Tokenizer.from_file(public_tokenizers.path(name))
        self.size = self.fast.n_vocab
        self.kind = np.uint16 if self.size <= 65536 else np.uint32

    def __call__(self, text: str | None) -> np.ndarray:
        """The ids of a text and END."""
        text = text or ""
        if len(text) >= 4096 and LONG_SPACE.search(text):
            ids = np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4")
        else:
            ids = self.fast.encode_to_numpy(text, allowed_special="all")
        return np.append(ids, np.uint32(END)).astype("<u4")


_IDS: dict[str, Ids] = {}


def token_ids(name: str = TOKENIZER) -> Ids:
    if name not in _IDS:
        _IDS[name] = Ids(name)
    return _IDS[name]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _min_hash(ids: np.ndarray) -> int:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return int(h.min() >> np.uint64(1))


def _token_batches(tokenizer: str, window: int, with_ids: bool):
    def work(batches):
        ids_of = token_ids(tokenizer)
        for b in slices(batches, 1):
            total, full, tails, keys, heads = [], [], [], [], []
            for text in b.column(1).to_pylist():
                ids = ids_of(text)
                cut = ids.size // window * window
                total.append(ids.size)
                full.append([_crc(ids[i : i + window]) for i in range(0, cut, window)])
                tails.append(ids[cut:].astype(ids_of.kind).tobytes())
                keys.append(_min_hash(ids[cut:]) if cut < ids.size else -1)
                heads.append(ids[:cut].tobytes() if with_ids else None)
            cols = [b.column(0), pa.array(total, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(tails, pa.binary()), pa.array(keys, pa.int64()), pa.array(heads, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["_id", "total", "full", "tail", "key", "head"])

    return work


def _frequency_batches(kind, size: int):
    def work(batches):
        counts = np.zeros(size, np.int64)
        for b in batches:
            for tail in b.column(0).to_pylist():
                counts[np.unique(np.frombuffer(tail, kind))] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["token", "n"])

    return work


def bm25_weights(count: np.ndarray, token: np.ndarray, size, idf: np.ndarray, mean: float) -> np.ndarray:
    return (idf[token] * count * (K1 + 1) / (count + K1 * (1 - B + B * size / mean))).astype(np.float32)


class Leaves:
    """Two levels of spherical k-means centroids over the BM25 weights of hashed terms."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float, seed: int = SEED) -> None:
        self.idf, self.mean = idf, mean
        x, rng = np.zeros((len(tails), DIMS), np.float32), np.random.default_rng(seed)
        for row, tail in zip(x, tails):
            at, w = self.terms(tail)
            np.add.at(row, at, w)
        x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
        self.top = self._centroids(x, rng)
        own = (x @ self.top.T).argmax(axis=1)
        self.below = [self._centroids(x[own == k], rng) for k in range(BRANCH)]

    def terms(self, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        token, count = np.unique(tail.astype(np.int64), return_counts=True)
        place = (token.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % DIMS
        return place, bm25_weights(count, token, tail.size, self.idf, self.mean)

    @staticmethod
    def _centroids(x: np.ndarray, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
        if len(x) < BRANCH:
            return np.zeros((BRANCH, DIMS), np.float32)
        c = x[rng.choice(len(x), BRANCH, replace=False)].copy()
        for _ in range(rounds):
            own = (x @ c.T).argmax(axis=1)
            for k in np.unique(own):
                mean = x[own == k].mean(axis=0)
                c[k] = mean / max(1e-9, float(np.linalg.norm(mean)))
        return c

    def leaf(self, tail: np.ndarray) -> int:
        at, w = self.terms(tail)
        k = int((self.top[:, at] @ w).argmax())
        return k * BRANCH + int((self.below[k][:, at] @ w).argmax())


def _leaf_batches(leaves, kind):
    def work(batches):
        for b in batches:
            own = [leaves.value.leaf(np.frombuffer(t, kind)) if t else 0 for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32())], names=[*b.schema.names, "leaf"])

    return work


class Shard:
    """A BM25 inverted index over tails, packed greedily. The postings of terms in a share of DENSE of the tails or more are rows of a matrix,
    which add up faster."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.sizes = np.array([t.size for t in tails], np.int64)
        found = [np.unique(t, return_counts=True) for t in tails]
        widths = np.array([u.size for u, _ in found], np.int64)
        token = np.concatenate([u for u, _ in found]).astype(np.int64)
        tf = np.concatenate([c for _, c in found])
        doc = np.repeat(np.arange(len(tails)), widths)
        weight = bm25_weights(tf, token, self.sizes[doc], idf, mean)
        order = np.argsort(token, kind="stable")
        self.doc, self.weight = doc[order], weight[order].astype(np.float64)
        self.terms, first = np.unique(token[order], return_index=True)
        self.first, self.last = first, np.append(first[1:], token.size)
        self.forward = np.append(0, np.cumsum(widths))
        self.token = token
        held = self.last - self.first
        many = held >= DENSE * len(tails)
        self.row = np.where(many, np.cumsum(many) - 1, -1)
        self.dense = np.zeros((int(many.sum()), len(tails)), np.float32)
        of = np.repeat(self.row, held)
        self.dense[of[of >= 0], self.doc[of >= 0]] = self.weight[of >= 0]

    def scores(self, seed: int) -> np.ndarray:
        a, b = self.forward[seed], self.forward[seed + 1]
        at = np.searchsorted(self.terms, self.token[a:b])
        row = self.row[at]
        out, at = self.dense[row[row >= 0]].sum(axis=0), at[row < 0]
        if at.size:
            spans = [slice(i, j) for i, j in zip(self.first[at].tolist(), self.last[at].tolist())]
            out = out + np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.sizes.size)
        return out

    def windows(self, size: int):
        """Lists of (tail, start in it, length); all but the last are full."""
        start, left = np.zeros_like(self.sizes), self.sizes.copy()
        for seed in np.argsort(-self.sizes, kind="stable").tolist():
            while left[seed]:
                take = min(int(left[seed]), size)
                window, room = [(seed, int(start[seed]), take)], size - take
                start[seed] += take
                left[seed] -= take
                if room:
                    score = self.scores(seed)
                    score[left == 0] = -1
                    while room:
                        best = int(score.argmax())
                        if score[best] < 0:
                            break
                        take = min(int(left[best]), room)
                        window.append((best, int(start[best]), take))
                        start[best] += take
                        left[best] -= take
                        room -= take
                        score[best] = -1
                yield window


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pack_batches(idf, mean: float, kind, window: int, shard: int, with_ids: bool):
    def work(batches):
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # (doc_id, total, start of the tail, its ids)
        rows: list[tuple] = []

        def piece(doc, total, start, ids, offset):
            rows.append((doc, start, ids.size, _crc(ids), total, sequence, offset, ids.astype("<u4").tobytes() if with_ids else None))

        def pack(last: bool):
            nonlocal sequence, held
            if not held:
                return
            docs, rest = held, []
            for w in Shard([d[3] for d in docs], idf.value, mean).windows(window):
                if not last and sum(n for *_, n in w) < window:
                    rest = [(docs[i][0], docs[i][1], docs[i][2] + s, docs[i][3][s : s + n]) for i, s, n in w]
                    continue
                offset = 0
                for i, s, n in w:
                    doc, total, start, ids = docs[i]
                    piece(doc, total, start + s, ids[s : s + n], offset)
                    offset += n
                sequence += 1
            held = rest

        def flush():
            cols = list(zip(*rows)) or [[]] * 8
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 7 else pa.binary()) for i, c in enumerate(cols)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for b in batches:
            for doc, total, full, tail, _, head in zip(*(b.column(i).to_pylist() for i in range(6))):
                for i, crc in enumerate(full):
                    ids = head[4 * i * window : 4 * (i + 1) * window] if with_ids else None
                    rows.append((doc, i * window, window, crc, total, sequence, 0, ids))
                    sequence += 1
                if tail:
                    held.append((doc, total, len(full) * window, np.frombuffer(tail, kind)))
                if len(held) >= shard:
                    pack(False)
                if len(rows) >= 20_000:
                    yield flush()
        pack(True)
        yield flush()

    return work


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW, shard: int = SHARD, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents in their sequences (PIECE); ids, little-endian unsigned 32-bit, only with_ids."""
    spark = docs.sparkSession
    vocabulary, kind = token_ids(tokenizer).size, token_ids(tokenizer).kind
    rows = docs.select(docs["doc_id"].cast("long").alias("_id"), docs["text"].alias("_text"))
    schema = "_id long, total long, full array<long>, tail binary, key long, head binary"
    tokens = materialize(map_rows(rows, _token_batches(tokenizer, window, with_ids), schema), "tokens")
    # one number for each entry of the vocabulary, whatever the input
    counts = map_rows(tokens.select("tail"), _frequency_batches(kind, vocabulary), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    n, size = tokens.agg(F.count("*"), F.sum(F.octet_length("tail"))).first()
    df = np.zeros(vocabulary)
    for token, c in counts:
        df[token] = c
    weights = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    idf = spark.sparkContext.broadcast(weights)
    mean = max(1.0, (size or 0) / kind().itemsize / max(1, n))
    # about twice SAMPLE rows by a hash of their place in the written table, whatever they hold; tails are shorter than a window
    at = F.xxhash64(F.monotonically_increasing_id())
    few = tokens.select("tail", at.alias("at")).where((F.pmod("at", F.lit(max(1, n // (2 * SAMPLE)))) == 0) & (F.octet_length("tail") > 0))
    sample = few.orderBy("at").limit(SAMPLE).collect()
    leaves = spark.sparkContext.broadcast(Leaves([np.frombuffer(r["tail"], kind) for r in sample], weights, mean))
    placed = map_rows(tokens, _leaf_batches(leaves, kind), schema + ", leaf int")
    order = ["leaf", "key", "_id", "total", "tail", "full"]  # the same in every attempt
    near = placed.repartitionByRange("leaf", "key", "_id").sortWithinPartitions(*order).drop("leaf")
    return map_rows(near, _pack_batches(idf, mean, kind, window, shard, with_ids), PIECE)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")


ORACLE: dict[str, str] = {}
