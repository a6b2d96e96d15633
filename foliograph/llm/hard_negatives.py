"""Hard negatives by bit-sliced integer products.

Vectors are integers, components times 256 rounded down. Shifted to be non-negative, a component is a sum of bit-planes; an anchor's score of a row is then a sum
of products of the anchor with 0/1 planes. Planes are taken most significant first. After each, the rest of a score lies between
the anchor's negative and its positive sum times the largest rest of a component, so every pair has an interval, which narrows from plane to plane. Pairs whose
interval can't qualify are dropped; as soon as few are left, only these are worked on. What all planes leave has its exact score.

Two passes: the first finds the positives, where a row of the anchor's label qualifies while its interval reaches the anchor's k-th best score so far. The second finds the
negatives: for each positive a band of scores, in which a row of another label qualifies while its interval meets the band and reaches the third best so far.

Rows are dealt to cells by a hash, anchors to groups; every pair of a cell and a group is one cogroup. A cell and a group have CELL_BYTES of integers at most in expectation, so
a task's memory is bounded; a label or a vector that a third of all rows hold makes no difference, as neither decides the cell. Rows that repeat are
one row with a count. Each pair of cell and group returns a few rows for an anchor, and a window merges these.

Rows with a null label, a null vector, or a null or non-finite component take no part. Edge cases: an anchor's other rows are those with another vec_id; rows that share a
vec_id otherwise count each, and each is an anchor of its own. A null vec_id is no anchor, stands last among ties, and is returned as null (the largest long stands for it
meanwhile). Vectors of different lengths: what is missing is zero; an empty vector scores 0. A positive of negative score has no negatives. Scores that don't surely fit
a long are an error. Ties go to the smaller vec_id. Very long texts can't occur, long vectors make smaller cells. Other columns aren't read. Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

SCALE, POSITIVES, NEGATIVES, EVERY = 256, 5, 3, 50
CELL_BYTES, MIN_CELLS, CELL_ROWS = 16_000_000, 64, 256
ROWS, SPARSE = 2048, 0.1
NO_ID = (1 << 63) - 1


def integers(rows: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """(id, label, x, copies): the rows that take part, with integer vectors, repeated rows once. Written, so that all passes read the same."""
    vec = F.col("embedding")
    good = F.forall(vec, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))  # NaN is above infinity
    some = rows.where(F.col("label").isNotNull() & vec.isNotNull() & good)
    ints = some.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), label.alias("label"), F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("x"))
    return materialize(ints.groupBy("id", "label", "x").agg(F.count("*").alias("copies")), "integers")


def _matrix(column, dims: int) -> np.ndarray:
    """The rows of a list column as int64, padded by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy()
    return out


class Planes:
    """The bit-planes of rows, and anchors to multiply them with."""

    def __init__(self, x: np.ndarray, bits: int, l1: int) -> None:
        """l1: the largest sum of absolute components of an anchor."""
        self.bits = bits
        self.exact = np.float64 if l1 << bits < 1 << 52 else np.int64
        self.kind = np.float32 if l1 < 1 << 24 else self.exact
        self.shifted = x + (1 << (bits - 1))

    def survivors(self, anchors: np.ndarray, rows: slice, alive: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of the pairs that stay alive. keep(anchor, low, high) tells which pairs of intervals can qualify; anchor
        is a column of places while all pairs are looked at, else one for each pair."""
        u = self.shifted[rows]
        a = anchors.astype(self.kind)
        below, above = (np.where(sign, anchors, 0).sum(axis=1).astype(self.exact) for sign in (anchors < 0, anchors > 0))
        score = np.repeat((-(1 << (self.bits - 1)) * anchors.sum(axis=1)).astype(self.exact)[:, None], u.shape[0], axis=1)
        every = np.arange(anchors.shape[0])[:, None]
        at = None
        for b in range(self.bits - 1, -1, -1):
            plane = ((u >> b) & 1).astype(self.kind)
            rest = (1 << b) - 1
            if at is None:
                score += (a @ plane.T).astype(self.exact) * (1 << b)
                alive &= keep(every, score + rest * below[:, None], score + rest * above[:, None])
                if np.count_nonzero(alive) < SPARSE * alive.size or b == 0:
                    at = np.nonzero(alive)
                    score = score[at]
            elif at[0].size:
                score = score + np.einsum("ij,ij->i", a[at[0]], plane[at[1]]).astype(self.exact) * (1 << b)
                ok = keep(at[0], score + rest * below[at[0]], score + rest * above[at[0]])
                at, score = (at[0][ok], at[1][ok]), score[ok]
        return at[0], at[1], score.astype(np.int64)


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, copies: np.ndarray, k: int):
    """The first k of every group by score, ties by smaller id, as (group, score, id); a row with copies counts that often."""
    n = np.minimum(copies, k)
    group, score, ids = (np.repeat(v, n) for v in (group, score, ids))
    order = np.lexsort((ids, -score, group))
    group, score, ids = group[order], score[order], ids[order]
    first = np.searchsorted(group, group, "left")
    top = np.arange(group.size) - first < k
    return group[top], score[top], ids[top]


def _thresholds(group: np.ndarray, score: np.ndarray, k: int, groups: int) -> np.ndarray:
    """The k-th score of each group that has k, else the least long."""
    out = np.full(groups, np.iinfo(np.int64).min)
    last = np.arange(group.size) - np.searchsorted(group, group, "left") == k - 1
    out[group[last]] = score[last]
    return out


def _positives(x, labels, ids, copies, anchors, bits: int, k: int):
    """(anchor, score, id): the first k rows of each anchor's label in the cell, without the anchor's vec_id."""
    ax, alabels, aids = anchors
    planes = Planes(x, bits, int(np.abs(ax).sum(axis=1).max(initial=0)))
    found = (np.zeros(0, np.int64),) * 3
    order = np.argsort(labels, kind="stable")
    planes.shifted, labels, ids, copies = planes.shifted[order], labels[order], ids[order], copies[order]
    for label in np.unique(alabels):
        mine, lo, hi = np.flatnonzero(alabels == label), np.searchsorted(labels, label), np.searchsorted(labels, label, "right")
        best = (np.zeros(0, np.int64),) * 3
        for start in range(lo, hi, ROWS):
            rows = slice(start, min(start + ROWS, hi))
            kth = _thresholds(*best[:2], k, mine.size)

            def keep(at, low, high, kth=kth):
                if at.ndim == 1:
                    return high >= kth[at]
                low = np.where(alive, low, -np.inf)
                sure = -np.partition(-low, k - 1, axis=1)[:, k - 1] if low.shape[1] > k else np.full(low.shape[0], -np.inf)
                return high >= np.maximum(kth, sure)[:, None]

            alive = aids[mine][:, None] != ids[None, rows]
            a, r, s = planes.survivors(ax[mine], rows, alive, keep)
            ones = np.ones(best[0].size, np.int64)
            best = _best(*(np.concatenate(p) for p in zip(best, (a, s, ids[rows][r]))), np.append(ones, copies[rows][r]), k)
        found = tuple(np.concatenate(p) for p in zip(found, (mine[best[0]], best[1], best[2])))
    return found


def _negatives(x, labels, ids, copies, anchors, bands: np.ndarray, bits: int, k: int):
    """(anchor, band, score, id): the first k rows of another label whose score is in each anchor's bands; bands are [lo, hi], none where lo > hi."""
    ax, alabels, _ = anchors
    planes = Planes(x, bits, int(np.abs(ax).sum(axis=1).max(initial=0)))
    m, width = bands.shape[:2]
    best = (np.zeros(0, np.int64),) * 3  # the group is anchor * width + band
    lo, hi = bands[:, :, 0], bands[:, :, 1]
    some = lo <= hi
    top = np.where(some, hi, np.iinfo(np.int64).min).max(axis=1, initial=np.iinfo(np.int64).min)
    for start in range(0, ids.size, ROWS):
        rows = slice(start, min(start + ROWS, ids.size))
        need = np.maximum(lo, _thresholds(best[0], best[1], k, m * width).reshape(m, width))
        least = np.where(some, need, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)

        def keep(at, low, high, need=need, least=least):
            ok = (high >= least[at]) & (low <= top[at])
            if at.ndim == 1:  # few are left: look at each band
                ok &= ((high[:, None] >= need[at]) & (low[:, None] <= hi[at]) & some[at]).any(axis=1)
            return ok

        a, r, s = planes.survivors(ax, rows, alabels[:, None] != labels[None, rows], keep)
        pair, band = np.nonzero((s[:, None] >= lo[a]) & (s[:, None] <= hi[a]))
        new = (a[pair] * width + band, s[pair], ids[rows][r[pair]])
        best = _best(*(np.concatenate(p) for p in zip(best, new)), np.append(np.ones(best[0].size, np.int64), copies[rows][r[pair]]), k)
    return best[0] // max(width, 1), best[0] % max(width, 1), best[1], best[2]


def _blocks(m: int, wide: int):
    """Anchors in blocks whose matrices of scores with ROWS rows have some 8 MB."""
    step = max(1, 512 // wide)
    return (slice(i, i + step) for i in range(0, m, step))


def _columns(t: pa.Table, dims: int):
    return _matrix(t["x"], dims), t["label"].to_numpy(), t["id"].to_numpy()


def _meet(rows: DataFrame, anchors: DataFrame, dims: int, work, schema: str) -> DataFrame:
    """work(rows of a cell, anchors of a group) for every pair of cell and group."""
    fit = max(1, CELL_BYTES // (8 * max(dims, 1)))
    n, m = rows.count(), anchors.count()
    cells, groups = max(-(-n // fit), min(MIN_CELLS, -(-n // CELL_ROWS)), 1), max(-(-m // fit), 1)
    whole = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = lambda k: F.pmod(F.xxhash64("id", "x", "label"), F.lit(k)).cast("int")
    left = rows.select("*", dealt(cells).alias("cell"), whole(groups).alias("group"))
    right = anchors.select("*", dealt(groups).alias("group"), whole(cells).alias("cell"))
    return left.groupBy("cell", "group").cogroup(right.groupBy("cell", "group")).applyInArrow(work, schema)


def _first(found: DataFrame, group: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*group).orderBy(F.col("score").desc(), "other")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows and anchors are `integers`; a negative's score is between low and high percent of
    the positive's."""
    size = F.size("x")
    most = F.max(F.greatest(F.array_max("x"), -F.array_min("x")))
    dims, most, l1 = (v or 0 for v in rows.agg(F.max(size), most, F.max(F.aggregate("x", F.lit(0).cast("double"), lambda s, x: s + F.abs(x.cast("double"))))).first())
    bits = int(most).bit_length() + 1
    if int(l1) << bits >= 1 << 61:
        raise ValueError("scores of these vectors may not fit a long")
    key = F.struct("id", "label", "x")
    asked = materialize(anchors.select("id", "label", "x", "copies", F.xxhash64(key).alias("key")), "anchors")

    def find_positives(left, right):
        x, labels, ids = _columns(left, dims)
        ax, alabels, aids = _columns(right, dims)
        copies, keys = left["copies"].to_numpy(), right["key"].to_numpy()
        for b in _blocks(ids.size and aids.size, 1):
            a, s, other = _positives(x, labels, ids, copies, (ax[b], alabels[b], aids[b]), bits, positives)
            yield pa.table({"key": keys[b][a], "anchor": aids[b][a], "score": s, "other": other})

    def one_table(f, names):
        def work(left, right):
            made = list(f(left, right))
            return pa.concat_tables(made) if made else pa.table({n: pa.array([], pa.int64()) for n in names})

        return work

    found = _meet(rows, asked, dims, one_table(find_positives, ("key", "anchor", "score", "other")), "key long, anchor long, score long, other long")
    good = materialize(_first(found, ["key", "anchor"], positives), "positives")
    scores = good.groupBy(F.col("key").alias("g_key"), F.col("anchor").alias("g_id")).agg(F.array_sort(F.collect_list(F.struct("place", "score")))["score"].alias("bests"))  # at most `positives`
    wanted = asked.join(scores, (F.col("key") == F.col("g_key")) & (F.col("id") == F.col("g_id"))).select("id", "label", "x", "key", "bests")

    def find_negatives(left, right):
        x, labels, ids = _columns(left, dims)
        ax, alabels, aids = _columns(right, dims)
        copies, keys = left["copies"].to_numpy(), right["key"].to_numpy()
        p = _matrix(right["bests"], positives)
        none = np.arange(positives) >= np.diff(right["bests"].combine_chunks().offsets.to_numpy())[:, None]
        bands = np.stack([-(-low * p // 100), high * p // 100], axis=2)
        bands[none] = 1, 0
        for b in _blocks(ids.size and aids.size, 1):
            a, band, s, other = _negatives(x, labels, ids, copies, (ax[b], alabels[b], aids[b]), bands[b], bits, negatives)
            yield pa.table({"key": keys[b][a], "anchor": aids[b][a], "positive": band + 1, "score": s, "other": other})

    near = _meet(rows, wanted, dims, one_table(find_negatives, ("key", "anchor", "positive", "score", "other")), "key long, anchor long, positive long, score long, other long")
    hard = _first(near, ["key", "anchor", "positive"], negatives).select(F.col("key").alias("h_key"), F.col("anchor").alias("h_id"), "positive", F.col("place").alias("rank"), F.col("score").alias("negative_score"), F.col("other").alias("negative_id"))
    pairs = good.join(hard, (F.col("key") == F.col("h_key")) & (F.col("anchor") == F.col("h_id")) & (F.col("place") == F.col("positive")))
    often = asked.select(F.col("key").alias("o_key"), F.col("id").alias("o_id"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    out = pairs.join(often, (F.col("key") == F.col("o_key")) & (F.col("anchor") == F.col("o_id")))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(F.col("anchor").alias("anchor_id"), known("other").alias("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative_id").alias("negative_id"), F.col("score").alias("positive_score"), "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = integers(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), moved)
    return mine(rows, rows.where((F.col("id") % EVERY == 0) & (F.col("id") != NO_ID)))


ORACLE = {
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other_id AS negative_id,
  p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)
QUALIFY row_number() OVER w <= 3
"""
}
