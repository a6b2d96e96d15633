"""SimHash near-dedup by a segment-popcount embedding.

A fingerprint is cut into segments of two bits; the popcounts of the segments are its coordinates. The Manhattan distance
of the coordinates is never more than the Hamming distance, so fingerprints within 3 bits have coordinates
within 3, and in one of the two halves within 1. The grid join therefore works on each half: points meet in a
cell if their coordinates are equal, or differ by 1 in one segment. In the second case the popcounts of the halves
have different parity, so only fingerprints of even parity visit neighbouring cells. Candidates are verified on all 64 bits.

Two random halves share a cell with a chance of (3 / 8) ** 16, so of 10 ** 9 different fingerprints each meets some 150 others in a
cell, and some 4,000 in all: the work grows with the square, but from that far out.

Equal fingerprints are one point. Within a cell a task returns a spanning forest of the links, not the pairs, so
a large group of near copies gives as many rows as members; a cell of over BLOCK points is cut into pairs of
blocks. Components come from alternating large-star and small-star rounds on written tables.

Copies of one text share a fingerprint, and members of a component its root. The joins that bring each of them its component cut keys of
more than HOT_ROWS rows by a salt; the list of these keys, at most one for HOT_ROWS rows, is broadcast.

Edge cases: null and empty texts have fingerprint zero and link like any other; very long texts are hashed in chunks; a null doc_id
counts for nothing in component_id (null if a component has no other) and loses to any other in its group; repeated rows are one
document and stay or go together; rows that share a doc_id are judged each by its own text; ties can't be, as the smallest doc_id stays.
All columns are carried, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import map_rows, slices
from .common import carried, discard, materialize

WORDS, SEED, MAX_BITS, BLOCK, HOT_ROWS = 3, 42, 3, 4096, 100_000
_CHUNK = 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def normalised(raw: bytes) -> np.ndarray:
    """The bytes with A-Z lower-cased and the words joined by one blank."""
    a = np.frombuffer(raw.lower(), np.uint8)
    space = _SPACE[a]
    keep = ~space
    keep[1:] |= ~space[:-1]
    a = np.where(space, 32, a).astype(np.uint8)[keep]
    return a[1:] if a.size and a[0] == 32 else a


def fingerprint(raw: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """Bits set in over half the hashes of the word shingles; zero without a word."""
    if not raw:
        return 0
    a = normalised(raw)
    if a.size and a[-1] == 32:
        a = a[:-1]
    if not a.size:
        return 0
    z = a.tobytes()
    ends = np.append(np.flatnonzero(a == 32), a.size)
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, ends.size - words + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for c in range(0, n, _CHUNK):
        hs = np.array([digest(z[i:j], seed) for i, j in zip(starts[c : c + _CHUNK], ends[c : c + _CHUNK])], np.uint64)
        ones += np.unpackbits(hs.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little", signed=True)


def _fingerprint_batches(words: int, seed: int):
    def work(batches):
        for b in slices(batches, 1):
            prints = [fingerprint(t, words, seed) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64()), b.column(2)], names=["_id", "fp", "_tid"])

    return work


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(_id, fp, _tid) of every row; _tid is a hash of the text."""
    rows = docs.select(docs["doc_id"].cast("long").alias("_id"), docs["text"].cast("binary").alias("_text"), F.xxhash64(docs["text"]).alias("_tid"))
    return map_rows(rows, _fingerprint_batches(words, seed), "_id long, fp long, _tid long")


def _visits(fp: Column) -> Column:
    """Array of (cell, own) of both halves. A cell is the half's number and its 16 two-bit popcounts."""
    out = []
    for half in (0, 1):
        v = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        at = v - F.shiftrightunsigned(v, 1).bitwiseAND(F.lit(0x55555555))
        tag = F.lit(half << 40).cast("long")
        out.append(F.array(F.struct((tag + at).alias("cell"), F.lit(True).alias("own"))))
        for step in (1, -1):
            limit = 2 if step > 0 else 0
            free = F.array(*[F.when(F.shiftrightunsigned(at, 2 * i).bitwiseAND(F.lit(3)) != limit, tag + at + (step << (2 * i))) for i in range(16)])
            near = F.transform(F.filter(free, lambda c: c.isNotNull()), lambda c: F.struct(c.alias("cell"), F.lit(False).alias("own")))
            out.append(F.when(F.bit_count(v) % 2 == 0, near).otherwise(F.array().cast("array<struct<cell:bigint,own:boolean>>")))
    return F.concat(*out)


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same components, one for each node that isn't the smallest of its component."""
    if not a.size:
        return a, b
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: a.size], at[a.size :], np.arange(ids.size)
    while True:
        low, new = np.minimum(label[x], label[y]), label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(ids.size)
    return ids[label[other]], ids[other]


def _links(group: np.ndarray, fp: np.ndarray, own: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links between rows of the same group; two visitors of a cell are no candidates."""
    left, right, held = [], [], 0
    at = np.flatnonzero(group[1:] == group[:-1]) if group.size else np.zeros(0, np.int64)
    step = 1
    while at.size:
        a, b = fp[at], fp[at + step]
        ok = (own[at] | own[at + step]) & (a != b) & (np.bitwise_count((a ^ b).view(np.uint64)) <= bits)
        left.append(a[ok])
        right.append(b[ok])
        held += int(ok.sum())
        if held > 1_000_000:
            x, y = _star(np.concatenate(left), np.concatenate(right))
            left, right, held = [x], [y], x.size
        step += 1
        at = at[at + step < group.size]
        at = at[group[at] == group[at + step]]
    return _star(np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def _link_batches(bits: int):
    def work(batches):
        rest = None
        for b in batches:
            key = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            fp, own = b.column(3).to_numpy(), b.column(4).to_numpy(zero_copy_only=False).astype(bool)
            if rest is not None:
                key, fp, own = np.concatenate([rest[0], key], axis=1), np.concatenate([rest[1], fp]), np.concatenate([rest[2], own])
            if not fp.size:
                continue
            group = np.append(0, np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0)))
            cut = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
            rest = key[:, cut:], fp[cut:], own[cut:]
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _links(group[:cut], fp[:cut], own[:cut], bits)], names=["u", "v"])
        if rest is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _links(np.zeros(rest[1].size, np.int64), rest[1], rest[2], bits)], names=["u", "v"])

    return work


def links(points: DataFrame, bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(u, v): edges between distinct fingerprints `fp` whose components are those of all links of at most `bits` bits.
    The grid is made for 3 bits or fewer."""
    visits = points.select("fp", F.explode(_visits(F.col("fp"))).alias("c")).select("c.cell", "fp", "c.own")
    big = visits.groupBy("cell").count().where(F.col("count") > block).select(F.col("cell").alias("b_cell"), F.ceil(F.col("count") / block).cast("int").alias("b"))
    met = visits.join(big, F.col("cell") == F.col("b_cell"), "left")
    part = F.pmod(F.hash("fp"), F.coalesce("b", F.lit(1)))
    met = met.select("cell", "fp", "own", part.alias("i"), F.explode(F.sequence(F.lit(0), F.coalesce("b", F.lit(1)) - 1)).alias("j"))
    met = met.select("cell", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "fp", "own")
    met = met.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
    return map_rows(met, _link_batches(bits), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes with an edge; root is the smallest of the component. Alternates large-star and small-star until nothing changes."""
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    e = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "x")
        large = both.where("v > u").join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        moved = large.join(small_low, F.col("u") == F.col("x"))
        small = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v")))
        last, e = e, materialize(small.where("u <> v").distinct(), "edges")
        discard(last)
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def split_join(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """rows with the columns of keyed, which has one row for each key, as `k`, and how many rows hold it, as `n`."""
    parts = F.ceil(F.col("n") / HOT_ROWS).cast("int")
    hot = keyed.where(F.col("n") > HOT_ROWS).select(F.col("k").alias("h_k"), parts.alias("h_parts"))  # at most rows / HOT_ROWS keys
    spread = F.pmod(F.xxhash64(*[rows[c] for c in rows.columns]), F.coalesce("h_parts", F.lit(1))).cast("int")
    salted = rows.join(F.broadcast(hot), rows[key] == F.col("h_k"), "left").select(*[rows[c] for c in rows.columns], spread.alias("salt"))
    copies = keyed.withColumn("k_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return salted.join(copies, (F.col(key) == F.col("k")) & (F.col("salt") == F.col("k_salt"))).drop("salt", "k_salt", "k")


def near_duplicate_groups(docs: DataFrame, words: int = WORDS, bits: int = MAX_BITS) -> DataFrame:
    """(_id, fp, _tid, component_id) of every row of docs."""
    prints = materialize(fingerprints(docs, words), "fingerprints")
    points = materialize(prints.groupBy("fp").agg(F.min("_id").alias("first"), F.count("*").alias("n")), "points")
    roots = components(links(points.select("fp"), bits))
    named = points.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.col("n").alias("copies"), F.coalesce("root", "fp").alias("root"))
    least = named.groupBy(F.col("root").alias("k")).agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    classes = split_join(named, materialize(least, "components"), "root").select(F.col("fp").alias("k"), "component_id", F.col("copies").alias("n"))
    return split_join(prints, materialize(classes, "classes"), "fp").select("_id", "fp", "_tid", "component_id")


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of the smallest doc_id of every group, with all their columns."""
    others = near_duplicate_groups(docs).where(~F.col("_id").eqNullSafe(F.col("component_id"))).select(F.col("_id").alias("o_id"), F.col("_tid").alias("o_tid")).distinct()
    rows = carried(docs).withColumn("_tid", F.xxhash64("_text"))
    return rows.join(others, F.col("_id").eqNullSafe(F.col("o_id")) & (F.col("_tid") == F.col("o_tid")), "left_anti").select("_row.*")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    groups = near_duplicate_groups(docs)
    return groups.select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


ORACLE: dict[str, str] = {}
