"""Language-model scoring with sharded Elias-Fano tries of words, pairs and triples.

The model backs off by interpolation: P(w | t, u) = s(t, u, w) + b(t, u) P(w | u), P(w | u) = s(u, w) + b(u) P(w), where
s = c(context, w) / (c(context) + m), b = m / (c(context) + m) with m = PAIR_MASS or TRIPLE_MASS, and P(w) is the add-one unigram. s is stored as one byte on
a logarithmic grid. The count of a pair as a context of triples is exact: what that byte says, and the difference, which is sent beside it. All counts are over all training
texts; two begin marks stand before a text.

1. Texts become blocks of BLOCK tokens, written to the shared folder in buckets: word numbers of the block and 64-bit hashes of its
   words. Long texts go on in the next block.
2. For words, then pairs, then triples, a block asks: it sends its distinct n-grams, with their counts in training texts, to shards.
   A shard adds up the counts, builds its level of the trie in memory-mapped files and answers by successor search relative to the
   context: counts of words, numbers and codes of pairs, codes of triples. A word is known by its shard and place there, a pair by
   its shard and place in that level, and in a triple the last word by its place among the successors of the middle word.
3. A block meets the answers of all three levels and sums up its texts' scores.

Contexts of more than SHARD / 2 tokens are cut over as many shards as their count asks for, which every block knows from the level
before; so no list of frequent contexts is made, and a shard is of bounded size whatever a word's or pair's share. Shards grow in
number with the tokens. Messages are at most one for each block and shard and never more than the n-grams in them. The blocks
themselves are never shuffled (they are bucketed); nothing of the model is broadcast or collected but N and V.

Words are told apart by 64-bit hashes. A task's temporary files are lost and built again with it.

Edge cases: a null or empty text is the end token alone; very long texts are scored whole, over blocks; a null doc_id
is not held out; rows that repeat or share a doc_id count each time and are scored one by one; an n-gram without training counts
has code 0; of other columns, whatever their names, none is read; an empty table gives an empty result.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows
from .common import materialize, scratch_root
from .elias_fano import EliasFano, Level

BLOCK, SHARD, PAIR_MASS, TRIPLE_MASS = 1_000_000, 2_000_000, 256.0, 8.0
END, BEGIN = b"\n", b"\r"  # no word holds one
LOW, LEVELS = -12.0, 254  # the grid of codes 1 to 255: log10 from LOW to 0

BLOCKS = "block long, n_tokens long, docs binary, texts binary, lengths binary, flags binary, tokens binary, vocabulary binary"
REQUESTS = "block long, shard int, context binary, width binary, total binary, word binary, seen binary"
ANSWERS = "block long, shard int, place binary, begin binary, value binary, rest binary, n long, v long"


def squeezed(raw) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(bytes(raw))


def _pack(x: np.ndarray) -> bytes:
    """Integers from 0 up in as many byte planes as the largest needs, compressed."""
    planes = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + squeezed(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T))


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<i8").ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=0))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw))


def _pack_signed(x: np.ndarray) -> bytes:
    return _pack(np.where(x < 0, -2 * x - 1, 2 * x))


def _unpack_signed(raw: bytes) -> np.ndarray:
    x = _unpack(raw)
    return np.where(x % 2, -(x + 1) // 2, x // 2)


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in text.split(", "))])


def _block_batches(limit: int):
    def work(batches):
        number = TaskContext.get().partitionId() << 32
        text_number = number
        known: dict[bytes, int] = {END: 0, BEGIN: 1}
        held: dict[str, list] = {k: [] for k in ("docs", "texts", "lengths", "flags")}
        parts, size = [], 0

        def flush():
            nonlocal number, parts, size
            tokens = np.concatenate(parts)
            order = np.argsort(-np.bincount(tokens, minlength=len(known)), kind="stable")  # frequent words get small numbers
            local = np.empty_like(order)
            local[order] = np.arange(order.size)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))[order]
            row = {"block": number, "n_tokens": size, "docs": np.array(held["docs"], np.int64).tobytes(), "texts": np.array(held["texts"], np.int64).tobytes(), "lengths": np.array(held["lengths"], np.int64).tobytes(), "flags": bytes(held["flags"]), "tokens": _pack(local[tokens]), "vocabulary": hashes.tobytes()}
            known.clear()
            known.update({END: 0, BEGIN: 1})
            for x in held.values():
                x.clear()
            number, parts, size = number + 1, [], 0
            return pa.RecordBatch.from_pylist([row], schema=_schema(BLOCKS))

        add = known.setdefault
        for b in batches:
            for i in range(b.num_rows):  # one text at a time
                doc, text, out = (b.column(j)[i].as_py() for j in range(3))
                words = (text or b"").lower().split()
                words.append(END)
                at, lead = 0, [BEGIN, BEGIN]
                while at < len(words):
                    part = words[at : at + limit - size] if at or len(words) > limit - size else words
                    parts.append(np.array([add(w, len(known)) for w in lead] + [add(w, len(known)) for w in part], np.int64))
                    for k, x in (("docs", doc or 0), ("texts", text_number), ("lengths", len(part)), ("flags", bool(out) | (doc is None) << 1 | (not at) << 2)):
                        held[k].append(x)
                    at, size, lead = at + len(part), size + len(part), (lead + part[-2:])[-2:]
                    if size >= limit or len(held["docs"]) >= limit // 8:
                        yield flush()
                text_number += 1
        if parts:
            yield flush()

    return work


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(key, return_inverse=True)


class Block:
    """The distinct words, pairs and triples of a block, sorted by the hashes of their words, and the shards that they are asked of."""

    def __init__(self, row: dict, shards: int, size: int) -> None:
        i64 = lambda k: np.frombuffer(row[k], np.int64)
        self.shards, self.size = shards, size
        self.docs, self.texts, self.lengths = i64("docs"), i64("texts"), i64("lengths")
        flags = np.frombuffer(row["flags"], np.uint8)
        self.held, self.null, starts = ((flags & bit).astype(bool) for bit in (1, 2, 4))
        raw = np.frombuffer(row["vocabulary"], np.uint64)
        order = np.argsort(raw)
        rank = np.empty_like(order)
        rank[order] = np.arange(order.size)
        self.hashes = raw[order]
        self.top = self.hashes >> np.uint64(32)
        self.home = (self.top * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        self.tokens = rank[_unpack(row["tokens"])]
        first = np.cumsum(self.lengths + 2) - (self.lengths + 2)  # two words of context stand before each part of a text
        self.valid = np.ones(self.tokens.size, bool)
        self.valid[first] = self.valid[first + 1] = False
        self.paired = np.ones(self.tokens.size, bool)
        self.paired[first] = False
        self.trained = np.repeat(~self.held, self.lengths + 2) & self.valid
        self.opened = np.zeros(self.tokens.size, bool)  # the second begin mark of a training text, counted as a word there
        self.opened[first[starts & ~self.held] + 1] = True
        self.seen = np.bincount(self.tokens[self.trained | self.opened], minlength=raw.size)
        self.width = raw.size

    def words(self):
        """Requests for words."""
        cuts = np.searchsorted(self.home, np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[s], cuts[s + 1]
            yield {"shard": s, "word": self.hashes[a:b].tobytes(), "seen": _pack(self.seen[a:b])}

    def know_words(self, told: list[dict]) -> None:
        self.count = np.concatenate([_unpack(r["value"]) for r in told])
        if told[0].get("place") is not None:
            places = [_unpack_sorted(r["place"]) for r in told]
            self.id = np.zeros(self.width, np.int64)
            self.id[self.count > 0] = np.concatenate([p | r["shard"] << 32 for p, r in zip(places, told)])

    def make_pairs(self) -> None:
        at = np.flatnonzero(self.paired)
        key, self.pair_at = _distinct(self.tokens[at - 1] * self.width + self.tokens[at])
        self.pair_seen = np.bincount(self.pair_at[(self.trained | self.opened)[at]], minlength=key.size)
        self.before, self.after = key // self.width, key % self.width
        self.pair_total = self.count[self.before]
        cuts = np.minimum(self.shards, 1 + 2 * self.pair_total // self.size)
        self.pair_part = (self.top[self.after] * cuts.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        self.pair_cuts = cuts
        self.pair_shard = (self.home[self.before] + self.pair_part) % self.shards
        asked = np.flatnonzero((self.pair_total > 0) & (self.count[self.after] > 0))
        self.pair_order = asked[np.argsort(self.pair_shard[asked], kind="stable")]
        self.valid_pair = self.valid[at]

    def pairs(self):
        """Requests for pairs, by the context's number."""
        o = self.pair_order
        yield from _requests(self.pair_shard[o], self.id[self.before[o]], self.pair_total[o], self.id[self.after[o]], self.pair_seen[o])

    def know_pairs(self, told: list[dict]) -> None:
        o = self.pair_order
        self.pair_code = np.zeros(self.before.size, np.uint8)
        self.pair_count = np.zeros(self.before.size, np.int64)
        if told:
            self.pair_code[o] = np.concatenate([_codes(r["value"]) for r in told])
            known = o[self.pair_code[o] > 0]
            self.pair_count[known] = _estimate(self.pair_code[known], self.pair_total[known], PAIR_MASS) + np.concatenate([_unpack_signed(r["rest"]) for r in told])
        if told and told[0].get("place") is not None:
            found = self.pair_code[o] > 0
            self.pair_id, self.pair_place = np.zeros((2, self.before.size), np.int64)
            places = np.concatenate([_unpack_sorted(r["place"]) for r in told])
            self.pair_id[o[found]] = places | self.pair_shard[o[found]] << 32
            # every context of a message tells where its successors begin
            change = np.append(True, (np.diff(self.before[o]) != 0) | (np.diff(self.pair_shard[o]) != 0))
            begin = np.concatenate([_unpack_sorted(r["begin"]) for r in told])[np.cumsum(change) - 1]
            self.pair_place[o[found]] = (places - begin[found]) * self.pair_cuts[o[found]] + self.pair_part[o[found]]

    def make_triples(self) -> None:
        at = np.flatnonzero(self.valid_pair)
        key, self.triple_at = _distinct(self.pair_at[at - 1] * np.int64(self.width) + self.after[self.pair_at[at]])
        self.triple_seen = np.bincount(self.triple_at[self.trained[self.valid]], minlength=key.size)
        self.front, last = key // self.width, key % self.width
        self.rear = np.empty(key.size, np.int64)
        self.rear[self.triple_at] = self.pair_at[at]
        count = self.pair_count[self.front]
        part = (self.top[last] * np.minimum(self.shards, 1 + 2 * count // self.size).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        self.triple_shard = (self.pair_shard[self.front] + part) % self.shards
        asked = np.flatnonzero((count > 0) & (self.pair_count[self.rear] > 0))
        self.triple_order = asked[np.argsort(self.triple_shard[asked] * self.shards + self.pair_shard[self.front[asked]], kind="stable")]

    def triples(self):
        """Requests for triples, by the pair's number and the last word's place among the successors of the middle one."""
        o = self.triple_order
        yield from _requests(self.triple_shard[o], self.pair_id[self.front[o]], self.pair_count[self.front[o]], self.pair_place[self.rear[o]], self.triple_seen[o])

    def know_triples(self, told: list[dict]) -> None:
        self.triple_code = np.zeros(self.front.size, np.uint8)
        if told:
            self.triple_code[self.triple_order] = np.concatenate([_codes(r["value"]) for r in told])


def _requests(shard, context, total, word, seen):
    """Messages to the shards (sorted); the n-grams of a context follow one another."""
    change = np.append(True, (np.diff(context) != 0) | (np.diff(shard) != 0)) if shard.size else np.zeros(0, bool)
    some, at = np.unique(shard, return_index=True)
    for s, a, b in zip(some.tolist(), at, np.append(at[1:], shard.size)):
        heads = a + np.flatnonzero(change[a:b])
        yield {"shard": s, "context": _pack_sorted(context[heads]), "width": _pack(np.diff(np.append(heads, b))), "total": _pack(total[heads]), "word": _pack(word[a:b]), "seen": _pack(seen[a:b])}


def _codes(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)


def encode(p: np.ndarray) -> np.ndarray:
    return np.clip(1 + np.rint((np.log10(p) - LOW) * (LEVELS / -LOW)), 1, 255).astype(np.uint8)


def decode() -> np.ndarray:
    """Probability of each code; code 0 is none."""
    p = 10.0 ** (LOW + (np.arange(256) - 1) * (-LOW / LEVELS))
    p[0] = 0
    return p


def _estimate(code: np.ndarray, total: np.ndarray, mass: float) -> np.ndarray:
    """The counts that codes of probabilities stand for, to within the grid."""
    return np.maximum(1, np.rint(decode()[code] * (total + mass))).astype(np.int64)


def _told(requests: pa.Table, rows: list[dict]) -> pa.Table:
    shard = requests["shard"][0].as_py()
    return pa.Table.from_pylist([{"shard": shard} | r for r in rows], schema=_schema(ANSWERS))


def answer_words(requests: pa.Table) -> pa.Table:
    """Count the words of a shard, then tell each block their counts and the places of those that have any."""
    asked = [np.frombuffer(x, np.uint64) for x in requests["word"].to_pylist()]
    words, at = _distinct(np.concatenate(asked))
    count = np.bincount(at, np.concatenate([_unpack(x) for x in requests["seen"].to_pylist()]), words.size).astype(np.int64)
    kept = words[count > 0]
    real = count[words != np.uint64(xxhash.xxh64_intdigest(BEGIN))]
    rows = [{"block": -1, "n": int(real.sum()), "v": int((real > 0).sum())}]
    with tempfile.TemporaryDirectory() as folder:
        level = EliasFano(folder, "words", kept, 2**64)
        place = level.successor(words, np.zeros(words.size, np.int64), np.full(words.size, kept.size))[0]
        for block, n, end in zip(requests["block"].to_pylist(), map(len, asked), np.cumsum([len(x) for x in asked]).tolist()):
            own = at[end - n : end]
            rows.append({"block": block, "place": _pack_sorted(place[own][count[own] > 0]), "value": _pack(count[own])})
        del level
    return _told(requests, rows)


def _answer_level(places: bool, mass: float):
    def answer(requests: pa.Table) -> pa.Table:
        """Build the shard's level from all requests, then answer each of them from it."""
        cols = {k: [f(x) for x in requests[k].to_pylist()] for k, f in (("context", _unpack_sorted), ("width", _unpack), ("total", _unpack), ("word", _unpack), ("seen", _unpack))}
        context, entry = _distinct(np.concatenate(cols["context"]))
        total = np.zeros(context.size, np.int64)
        total[entry] = np.concatenate(cols["total"])
        word = np.concatenate(cols["word"])
        if places:  # numbers of words are sparse; those of successors are places already
            word = _distinct(word)[1]
        size = int(word.max(initial=0)) + 1
        key, at = _distinct(np.repeat(entry, np.concatenate(cols["width"])) * np.int64(size) + word)
        count = np.bincount(at, np.concatenate(cols["seen"]), key.size).astype(np.int64)
        owner, word = key // size, key % size
        spans = np.zeros(context.size, np.int64)
        spans[owner] = word + 1  # of the last in each context
        kept = count > 0
        rows, e, p = [], 0, 0
        with tempfile.TemporaryDirectory() as folder:
            level = Level(folder, owner[kept], word[kept], encode(count[kept] / (total[owner[kept]] + mass)), spans)
            place, code = level.find(owner, word)
            begin = level.begin(np.arange(context.size))
            for block, ctx, wrd in zip(requests["block"].to_pylist(), cols["context"], cols["word"]):
                own = at[p : p + wrd.size]
                row = {"block": block, "value": squeezed(code[own])}
                if places:
                    known = own[code[own] > 0]
                    row["rest"] = _pack_signed(count[known] - _estimate(code[known], total[owner[known]], mass))
                    row |= {"place": _pack_sorted(place[own][code[own] > 0]), "begin": _pack_sorted(begin[entry[e : e + ctx.size]])}
                rows.append(row)
                e, p = e + ctx.size, p + wrd.size
            del level
        return _told(requests, rows)

    return answer


def _ask_words(shards: int, size: int):
    def work(batches):
        for b in batches:
            for row in (r for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
                yield pa.RecordBatch.from_pylist([{"block": row["block"]} | r for r in Block(row, shards, size).words()], schema=_schema(REQUESTS))

    return work


def _informed(blocks: pa.Table, told: pa.Table, shards: int, size: int):
    """The block of a group with what it has been told of each level so far."""
    by_level: dict[int, list[dict]] = {}
    for r in told.sort_by([("level", "ascending"), ("shard", "ascending")]).to_pylist():
        by_level.setdefault(r["level"], []).append(r)
    block = Block(blocks.to_pylist()[0], shards, size)
    block.know_words(by_level[1])
    block.make_pairs()
    return block, by_level


def _ask_pairs(shards: int, size: int):
    def ask(blocks: pa.Table, told: pa.Table) -> pa.Table:
        block, _ = _informed(blocks, told, shards, size)
        return pa.Table.from_pylist([{"block": blocks["block"][0].as_py()} | r for r in block.pairs()], schema=_schema(REQUESTS))

    return ask


def _ask_triples(shards: int, size: int):
    def ask(blocks: pa.Table, told: pa.Table) -> pa.Table:
        block, by_level = _informed(blocks, told, shards, size)
        rows = []
        if 2 in by_level:
            block.know_pairs(by_level[2])
            block.make_triples()
            rows = [{"block": blocks["block"][0].as_py()} | r for r in block.triples()]
        return pa.Table.from_pylist(rows, schema=_schema(REQUESTS))

    return ask


SUMS = "text long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scorer(shards: int, size: int, n: int, v: int):
    def score(blocks: pa.Table, told: pa.Table) -> pa.Table:
        b, by_level = _informed(blocks, told, shards, size)
        b.know_pairs(by_level.get(2, []))
        b.make_triples()
        b.know_triples(by_level.get(3, []))
        one, p = (b.count + 1) / (n + v + 1), decode()
        two = p[b.pair_code] + PAIR_MASS / (b.pair_total + PAIR_MASS) * one[b.after]
        three = np.log10(p[b.triple_code] + TRIPLE_MASS / (b.pair_count[b.front] + TRIPLE_MASS) * two[b.rear])
        tokens, starts = b.tokens[b.valid], np.append(0, np.cumsum(b.lengths)[:-1])
        sums = [np.add.reduceat(x, starts) for x in ((b.count[tokens] > 0).astype(np.int64), np.log10(one)[tokens], three[b.triple_at])]
        cols = [pa.array(b.texts), pa.array(b.docs, mask=b.null), pa.array(b.held), pa.array(b.lengths), *map(pa.array, sums)]
        return pa.table(cols, schema=_schema(SUMS))

    return score


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    """df written to the shared folder in buckets of key, so that grouping by key moves nothing. Only a table of the catalog can say so; its name goes as soon as it is read, the files stay."""
    spark = df.sparkSession
    name = f"foliograph_blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", f"{scratch_root(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def score_texts(docs: DataFrame, held_out) -> DataFrame:
    """Scores of every row of docs, learning from the rows where the Column held_out is false."""
    rows = docs.select(docs["doc_id"].cast("long").alias("_id"), docs["text"].cast("binary").alias("_text"), F.coalesce(held_out, F.lit(False)).alias("_held"))
    blocks = _bucketed(map_rows(rows, _block_batches(BLOCK), BLOCKS), "block")
    shards, size = max(1, -(-(blocks.agg(F.sum("n_tokens")).first()[0] or 0) // SHARD)), SHARD
    own = blocks.drop("n_tokens")

    def meet(told: DataFrame, work, schema: str) -> DataFrame:
        return own.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(work, schema)

    def level(answers: DataFrame, k: int, *columns: str) -> DataFrame:
        told = [F.col(c) if c in columns else F.lit(None).cast("binary").alias(c) for c in ("place", "begin", "value", "rest")]
        return answers.where("block >= 0").select("block", "shard", F.lit(k).alias("level"), *told)

    words = materialize(map_rows(own, _ask_words(shards, size), REQUESTS).groupBy("shard").applyInArrow(answer_words, ANSWERS), "words")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    counts = level(words, 1, "value")
    pairs = materialize(meet(level(words, 1, "place", "value"), _ask_pairs(shards, size), REQUESTS).groupBy("shard").applyInArrow(_answer_level(True, PAIR_MASS), ANSWERS), "pairs")
    triples = materialize(meet(counts.unionByName(level(pairs, 2, "place", "begin", "value", "rest")), _ask_triples(shards, size), REQUESTS).groupBy("shard").applyInArrow(_answer_level(False, TRIPLE_MASS), ANSWERS), "triples")
    told = counts.unionByName(level(pairs, 2, "value", "rest")).unionByName(level(triples, 3, "value"))
    parts = meet(told, _scorer(shards, size, n, v), SUMS)
    whole = parts.groupBy("text").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)


ORACLE: dict[str, str] = {}
