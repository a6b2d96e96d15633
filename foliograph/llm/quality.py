"""Quality rules: boosted trees over document statistics, beside two fixed rules.

The trees learn from `labels`, from at most TRAIN_ROWS labelled documents (those first in a hash order of the doc_id); all
statistics are monotone where DIRECTIONS says so. Every document is scored in the scan that computes its statistics:
nothing is shuffled.

Edge cases: a null or empty text has no words and fails the base rules; a very long text is read whole. Without labels of both classes
the trees reject nothing; null labels are left out, and equal hashes of labels are taken in the order of their values. Rows are scored
one by one, so rows that repeat, share a doc_id or have none need no care; an odds of exactly the threshold keeps. Of other columns,
whatever their names, none is read, and keep_good carries them; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees
from .batches import map_rows, slices

TRAIN_ROWS, THRESHOLD = 4000, 0.5
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5
FEATURES = ["log_words", "word_chars", "symbols", "dup_lines", "repeated", "distinct", "upper", "digits", "marks", "bars", "exclaims", "line_words", "other_bytes", "longest", "short_words"]
#: 1: more is better, -1: more is worse
DIRECTIONS = {"symbols": -1, "dup_lines": -1, "repeated": -1, "distinct": 1, "bars": -1, "exclaims": -1}

_CLASS = np.zeros(256, np.uint8)
for _c in b"\t\n\x0b\x0c\r ":
    _CLASS[_c] = 1
for _c in b"#*$%&|<>":
    _CLASS[_c] = 2
for _c in range(65, 91):
    _CLASS[_c] = 3
for _c in range(48, 58):
    _CLASS[_c] = 4
for _c in b"!":
    _CLASS[_c] = 5
for _c in b".,;:?\"'()[]{}/\\-_=+@^~`":
    _CLASS[_c] = 6
_CLASS[128:192] = 7
_CLASS[192:] = 8


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of that many words that is found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) == len(words):
        return 0
    key, size = ids[:n], len(known)
    for i in range(1, window):
        if size * len(known) >= 2**62:
            key = np.unique(key, return_inverse=True)[1]
            size = n
        key, size = key * len(known) + ids[i : i + n], size * len(known)
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not twice.size:
        return 0
    at = np.searchsorted(twice, key)
    found = twice[np.minimum(at, twice.size - 1)] == key
    covered = np.zeros(len(words), bool)
    for i in range(window):
        covered[i : i + n] |= found
    return int(covered.sum())


def statistics(raw: bytes | None) -> tuple[list[int], list[float]]:
    """[n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words] and FEATURES of a UTF-8 text."""
    raw = raw or b""
    words = raw.split()
    if not words:
        return [0, 0, int(sum(raw.count(bytes([c])) for c in b"#*$%&|<>")), 0, 0], [0.0] * len(FEATURES)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9)
    n, chars = len(words), int(len(raw) - kinds[7])
    word_chars, symbols = chars - int(kinds[1]), int(kinds[2])
    seen: set[bytes] = set()
    dups = 0
    lines = raw.split(b"\n")
    for line in lines:
        if line in seen:
            dups += bool(line.strip())
        else:
            seen.add(line)
    repeated = repeated_words(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    per = 1 / max(1, word_chars)
    feats = [np.log1p(n), word_chars / n, symbols * per, dups / len(lines), repeated / n, len(set(words)) / n, kinds[3] * per, kinds[4] * per, kinds[6] * per, raw.count(b"|") / n, kinds[5] / n, np.log1p(n / len(lines)), kinds[8] * per, np.log1p(sizes.max()), (sizes <= 3).mean()]
    return [n, word_chars, symbols, dups, repeated], [float(x) for x in feats]


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> trees.Trees:
    """Fit the trees on at most `rows` labelled documents."""
    sample = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").alias("l_id"), F.col("quality").alias("l_quality")).orderBy(F.xxhash64("l_id"), "l_quality").limit(rows)
    picked = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("l_id"))

    def work(batches):
        for b in slices(batches, 0):
            feats = [statistics(t)[1] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(feats, pa.list_(pa.float64())), b.column(2)], names=["y", "x", "id"])

    # at most `rows` rows of fixed size, unless doc_ids repeat; the limit holds those too
    got = map_rows(picked.select("text", F.col("l_quality").cast("int"), "doc_id"), work, "y int, x array<double>, id long").orderBy(F.xxhash64("id", "x")).limit(rows).collect()
    x = np.array([r["x"] for r in got], float).reshape(-1, len(FEATURES))
    return trees.fit(x, np.array([r["y"] for r in got], float), directions={FEATURES.index(k): v for k, v in DIRECTIONS.items()})


def _judged(model: trees.Trees, texts: list, threshold: float):
    """Columns of the base statistics, base_failed and kept for a list of UTF-8 texts."""
    both = [statistics(t) for t in texts]
    stats = np.array([b for b, _ in both], np.int64).reshape(-1, 5)
    odds = model.score(np.array([f for _, f in both], float).reshape(-1, len(FEATURES)))
    failed = (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > MAX_REPEATED_PERCENT * stats[:, 0])
    good = 1 / (1 + np.exp(-odds)) >= threshold if model.roots.size else np.ones(len(texts), bool)
    return stats, failed, ~failed & good


def judge(docs: DataFrame, model: trees.Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the statistics, base_failed and kept of every row."""

    def work(batches):
        for b in slices(batches, 1):
            stats, failed, kept = _judged(model, b.column(1).to_pylist(), threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in stats.T], pa.array(failed), pa.array(kept)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), work, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, model: trees.Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the rules and the trees keep, with all their columns."""
    at = docs.columns.index("text")

    def work(batches):
        for b in slices(batches, at):
            yield b.filter(pa.array(_judged(model, [t and t.encode() for t in b.column(at).to_pylist()], threshold)[2]))

    return docs.mapInArrow(work, docs.schema)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


ORACLE: dict[str, str] = {}
