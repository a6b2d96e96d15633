"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as their words (runs of letters and digits) in lower case, joined by one blank, so that layout, punctuation
and marks between words don't count. An item of m characters has a budget of k = floor(RATE * m)
edits and is split into k + 1 pieces: a passage within the budget holds one of them unchanged. The pieces of a block of
items are found in every text by one Aho-Corasick automaton, and each place that a hit allows is verified by Myers'
bit-parallel distance, free at both ends. There is no limit on hits or matches.

Items travel to the tasks in broadcast blocks of about BLOCK_CHARS characters. The corpus is read once: a task takes its texts in slices
and runs each slice through the automata of all blocks, one after the other, so it holds one automaton and one slice, however large the
benchmark is. The benchmark as a whole, unlike the corpus, passes through the driver. Documents are never shuffled.

Edge cases: null and empty texts match nothing; very long ones are searched whole; of places with the same distance the first is
reported; other columns, whatever their names, are carried by drop_leaks and not read by find_leaks; an empty table, or an empty
benchmark, gives no match; items without letters and digits are
left out, all others are searched, the shortest (a budget of 0) as exact copies wherever they stand; equal items are reported under each id; repeated rows give repeated matches; null ids are carried.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows, slices
from .common import carried

OTHER = re.compile(r"[\W_]+")
RATE, BLOCK_CHARS, SLICE_BYTES = 0.08, 4_000_000, 64_000_000


def normal(text: str | None) -> str:
    return OTHER.sub(" ", (text or "").lower()).strip(" ")


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(eq: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least distance of the pattern to a part of the text that ends at `end` (exclusive; the first such end).
    anchored: the part starts where the text does."""
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j
        ph, mh = ph << 1 | anchored, mh << 1
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
    return best, end


class Matcher:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items, self.auto = [], ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            m = len(text)
            k = int(m * rate)
            cuts = [m * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                places.setdefault(text[a:b], []).append((len(self.items), a))
            self.items.append((item_id, m, k, masks(text), masks(text[::-1])))
        for piece, where in places.items():
            self.auto.add_word(piece, (len(piece), where))
        if places:
            self.auto.make_automaton()

    def matches(self, text: str) -> list[tuple]:
        """(item_id, distance, budget, start, end) of the best place of every item found in a normalised text."""
        if not self.items:
            return []
        windows: dict[int, list[list[int]]] = {}
        exact: dict[int, int] = {}  # the first end of items without a budget, whose only piece is the item
        for last, (size, where) in self.auto.iter(text):
            for i, offset in where:
                _, m, k, *_ = self.items[i]
                if not k:
                    exact.setdefault(i, last + 1)
                    continue
                start = last + 1 - size - offset
                low, high = max(0, start - k), start + m + k
                spans = windows.setdefault(i, [])
                if spans and low <= spans[-1][1] and high - spans[-1][0] <= 8 * (m + k) and low >= spans[-1][0]:
                    spans[-1][1] = max(high, spans[-1][1])
                elif not spans or spans[-1] != [low, high]:
                    spans.append([low, high])
        out = [(self.items[i][0], 0, 0, end - self.items[i][1], end) for i, end in exact.items()]
        for i, spans in windows.items():
            item_id, m, k, eq, back = self.items[i]
            best = None
            for low, high in spans:
                distance, end = myers(eq, m, text[low:high])
                if distance <= k and (best is None or distance < best[0]):
                    size = myers(back, m, text[max(0, low + end - m - k) : low + end][::-1], anchored=True)[1]
                    best = (distance, low + end - size, low + end)
            if best:
                out.append((item_id, best[0], k, *best[1:]))
        return out


SCHEMA = "_id long, _tid long, item_id long, distance int, budget int, start long, end long"


def _match_batches(blocks: list, rate: float):
    held: list[Matcher] = []  # of a benchmark of one block

    def matcher(block) -> Matcher:
        if len(blocks) > 1:
            return Matcher(block.value, rate)
        if not held:
            held.append(Matcher(block.value, rate))
        return held[0]

    def work(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for b in slices(batches, 2, SLICE_BYTES):
            texts = [(i, t, normal(text)) for i, t, text in zip(*(b.column(j).to_pylist() for j in range(3)))]
            for block in blocks:
                m = matcher(block)
                cols = list(zip(*((i, t, *x) for i, t, text in texts for x in m.matches(text)))) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return work


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and item within the item's budget, with the best place in the normalised text."""
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = -(-chars // block_chars) or 1
    block = F.pmod(F.xxhash64("text", "item_id"), F.lit(n))
    blocks = [sc.broadcast([tuple(r) for r in items.where(block == b).collect()]) for b in range(n)]
    rows = docs.select(docs["doc_id"].cast("long").alias("_id"), F.xxhash64(docs["text"]).alias("_tid"), docs["text"].alias("_text"))
    return map_rows(rows, _match_batches(blocks, rate), SCHEMA)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text holds no item, with all their columns."""
    leaks = find_leaks(docs, benchmark).select(F.col("_id").alias("l_id"), F.col("_tid").alias("l_tid")).distinct()
    rows = carried(docs).withColumn("_tid", F.xxhash64("_text"))
    return rows.join(leaks, F.col("_id").eqNullSafe(F.col("l_id")) & (F.col("_tid") == F.col("l_tid")), "left_anti").select("_row.*")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    leaks = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leaks.withColumnRenamed("_id", "doc_id").drop("_tid")


ORACLE: dict[str, str] = {}
