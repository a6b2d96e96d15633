"""Language ID by a linear-chain conditional random field over the words of a text.

Each word, a run of letters in lower case, has affixes, character n-grams up to three and itself (the lexicon) as hashed
features; the chain has learned transitions, so a code-switched text gets a label for every word. Forward-backward gives each word's
posterior; a text's language is the one with the largest mean posterior over its words, and that mean is its score.

The field learns from TRAIN_DOCS documents of each language at most (those first in a hash order of the doc_id), whole.
Their words are cut into runs of random length and chained across languages, so that the transitions see switches; of a language, documents
after TRAIN_BYTES of text are left out of training. Scoring is a map over whole texts, and a text is one chain: long ones are worked
on in pieces of PIECE words side by side, with exact messages between the pieces. Nothing is left out and nothing is shuffled.

Edge cases: null texts and texts without a letter (category L) are `und` with score 0. Without training documents every text is
`und`. A null doc_id is not held out and not learned from; rows that repeat or share a doc_id are scored one by one, and learned
from once for each language. Ties go to the language that sorts first; an empty table gives an empty result; of other columns, whatever
their names, none is read.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import map_rows, slices

TRAIN_DOCS, TRAIN_BYTES, BITS, EPOCHS, PIECE, SEED = 150, 4_000_000, 16, 3, 512, 5
WORD = re.compile(r"[^\W\d_]+")
_KNOWN_WORDS = 400_000


def words_of(text: str) -> list[str]:
    """The words of a text: runs of letters, in lower case. Fractions, Roman numerals and the like are no letters."""
    words = WORD.findall(text.lower())
    if not all(map(str.isalpha, words)):
        words = " ".join("".join(c if c.isalpha() else " " for c in w) for w in words).split()
    return words


def features(words: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, hashed feature): n-grams of one to three letters with the word's ends marked, affixes of three letters and the word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    first = np.cumsum(sizes) - sizes
    mix = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
    gram = code * mix[0]
    parts = [(owner, gram)]
    for n in (1, 2):
        gram = gram[:-1] * mix[3] + code[n:] * mix[n]
        same = owner[:-n] == owner[n:]
        parts.append((owner[:-n][same], gram[same] + mix[n]))
    long = np.flatnonzero(sizes >= 6)
    for tag, at in ((1, first[long]), (2, first[long] + sizes[long] - 4)):
        parts.append((long, sum(code[at + i] * mix[i] for i in range(4)) * mix[3] + np.uint64(tag)))
    place = np.arange(code.size) - np.repeat(first, sizes)
    powers = np.cumprod(np.full(int(sizes.max(initial=1)), mix[3] | np.uint64(1)))
    parts.append((np.arange(len(words)), np.add.reduceat(code * powers[place], first) * mix[2] if len(words) else code))
    hashed = np.concatenate([h for _, h in parts])
    hashed = (hashed ^ (hashed >> np.uint64(29))) * mix[1]
    return np.concatenate([o for o, _ in parts]), (hashed >> np.uint64(64 - bits)).astype(np.int64)


def marginals(emit: np.ndarray, trans: np.ndarray, lengths: np.ndarray, into: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """Posteriors of chains of the given lengths (longest first). emit: positive scores in time-major order, the
    chains still running at each step first; trans: positive scores. into, after: messages to the first element of each
    chain and to its last one, if it is a piece of a longer chain."""
    if not emit.size:
        return emit
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    at = np.append(0, np.cumsum(active))
    alpha, back = np.empty_like(emit), np.ones((lengths.size, emit.shape[1])) if after is None else after.copy()
    prior = np.ones((active[0], emit.shape[1])) if into is None else into
    for t, n in enumerate(active):
        a = (prior[:n] @ trans if t else prior[:n]) * emit[at[t] : at[t + 1]]
        a /= a.sum(axis=1, keepdims=True)
        alpha[at[t] : at[t + 1]] = prior = a
    for t in range(len(active) - 1, -1, -1):
        n, span = active[t], slice(at[t], at[t + 1])
        post = alpha[span] * back[:n]
        b = (back[:n] * emit[span]) @ trans.T
        back[:n] = b / b.sum(axis=1, keepdims=True)
        alpha[span] = post / post.sum(axis=1, keepdims=True)
    return alpha


def chain_marginals(by_word: np.ndarray, trans: np.ndarray, counts: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Posteriors of chains of the given lengths, one after the other. Chains of several pieces get the messages between
    these from each piece's transfer matrix, so the result is that of the whole chain."""
    many, k = -(-counts // piece), by_word.shape[1]
    first = np.append(0, np.cumsum(many))
    sizes = np.full(first[-1], piece)
    sizes[first[1:] - 1] = counts - (many - 1) * piece
    order, place = time_major(sizes)
    emit = np.empty_like(by_word)
    emit[place] = by_word
    into, after = np.ones((sizes.size, k)), np.ones((sizes.size, k))
    long = np.flatnonzero(many > 1)
    if long.size:
        pieces = np.concatenate([np.arange(first[c], first[c + 1]) for c in long])
        pieces = pieces[np.argsort(-sizes[pieces], kind="stable")]  # longest first, so that those still running are a head of the array
        starts = np.append(0, np.cumsum(sizes))[pieces]
        running = np.searchsorted(-sizes[pieces], -np.arange(1, sizes[pieces[0]] + 1), side="right")
        transfer = np.tile(trans, (pieces.size, 1, 1))
        transfer[np.isin(pieces, first[long])] = np.eye(k)  # the first word of a chain has no word before it
        for t, n in enumerate(running):
            step = transfer[:n]
            if t:
                step = (step.reshape(n * k, k) @ trans).reshape(n, k, k)
            np.multiply(step, by_word[starts[:n] + t][:, None, :], out=transfer[:n])
            if t % 8 == 7:
                transfer[:n] /= transfer[:n].max(axis=(1, 2), keepdims=True)
        of = dict(zip(pieces.tolist(), transfer))
        for c in long.tolist():
            a, z = int(first[c]), int(first[c + 1])
            end = of[a].sum(axis=0)
            for p in range(a + 1, z):
                into[p] = end @ trans
                end = end @ of[p]
                end /= end.max()
            for p in range(z - 1, a, -1):
                back = of[p] @ after[p]
                after[p - 1] = back / back.max()
    return marginals(emit, trans, sizes[order], into[order], after[order])[place]


def time_major(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For concatenated chains: the order of the chains, longest first, and the place in time-major order of every element."""
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(order.size)
    active = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), side="right")
    at = np.append(0, np.cumsum(active))
    step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return order, at[step] + np.repeat(rank, lengths)


class Field:
    """The weights of a trained field and a bounded memory of the words it has met."""

    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray) -> None:
        self.labels, self.weights, self.trans = labels, weights, trans
        self.known: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.table = np.zeros((0, len(labels)))

    def __getstate__(self):
        return self.labels, self.weights, self.trans

    def __setstate__(self, state):
        self.__init__(*state)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Positive scores of each word and label."""
        if len(self.known) > _KNOWN_WORDS:
            self.known, self.table = {}, self.table[:0]
        known, size = self.known, len(self.known)
        ids = [known.setdefault(w, len(known)) for w in words]
        if len(known) > size:
            owner, feats = features(list(islice(known, size, None)))
            s = np.stack([np.bincount(owner, w[feats], len(known) - size) for w in self.weights.T], axis=1)
            self.table = np.concatenate([self.table, np.exp(s - s.max(axis=1, keepdims=True)) + 1e-9])
        return self.table[ids]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.labels:
            return labels, scores
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, t in enumerate(texts):
            words = words_of(t) if t else []
            if words:
                held.append((i, words))
                size += len(words)
            if size > 400_000:
                self._predict(held, labels, scores)
                held, size = [], 0
        if held:
            self._predict(held, labels, scores)
        return labels, scores

    def _predict(self, held, labels, scores) -> None:
        counts = np.array([len(ws) for _, ws in held], np.int64)
        post = chain_marginals(self.emissions([w for _, ws in held for w in ws]), np.exp(self.trans), counts)
        mean = np.add.reduceat(post, np.append(0, np.cumsum(counts)[:-1])) / counts[:, None]
        for (i, _), m in zip(held, mean):
            best = int(m.argmax())
            labels[i], scores[i] = self.labels[best], float(min(1.0, m[best]))


def fit(texts: list[str], langs: list[str], epochs: int = EPOCHS, bits: int = BITS, seed: int = SEED, length: int = 64) -> Field:
    """Train on whole texts by the likelihood of chained runs of their words (Adagrad)."""
    names = sorted(set(langs))
    k, r = len(names), np.random.default_rng(seed)
    if not k:
        return Field([], np.zeros((1, 0)), np.zeros((0, 0)))
    known: dict[str, int] = {}
    runs = []
    for text, lang in zip(texts, langs):
        ids = np.array([known.setdefault(w, len(known)) for w in words_of(text)], np.int64)
        cuts = np.cumsum(r.integers(8, 200, ids.size // 8 + 1))
        runs += [(piece, names.index(lang)) for piece in np.split(ids, cuts[cuts < ids.size]) if piece.size]
    if not runs:
        return Field([], np.zeros((1, 0)), np.zeros((0, 0)))
    r.shuffle(runs)
    word = np.concatenate([p for p, _ in runs])
    label = np.concatenate([np.full(p.size, y) for p, y in runs])
    word, label = (np.concatenate([a, a[: -a.size % length]])[: -(-a.size // length) * length].reshape(-1, length) if a.size >= length else a.reshape(1, -1) for a in (word, label))
    owner, flat = features(list(known), bits)
    flat, sizes = flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(known))
    first = np.append(0, np.cumsum(sizes))
    w, trans = np.zeros((1 << bits, k)), np.zeros((k, k))
    gw, gt = np.full_like(w, 1.0), np.full_like(trans, 1.0)
    for _ in range(epochs):
        for rows in np.array_split(r.permutation(len(word)), max(1, len(word) // 64)):
            x, y = word[rows], label[rows]
            some, at = np.unique(x, return_inverse=True)
            at = at.reshape(x.shape)
            own = np.concatenate([flat[first[i] : first[i + 1]] for i in some])
            s = np.add.reduceat(w[own], np.append(0, np.cumsum(sizes[some])[:-1]))[at]
            emit, e = np.exp(s - s.max(axis=2, keepdims=True)) + 1e-30, np.exp(trans)
            n, t = x.shape
            alpha, beta = np.empty((t, n, k)), np.ones((t, n, k))
            alpha[0] = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
            for i in range(1, t):
                a = alpha[i - 1] @ e * emit[:, i]
                alpha[i] = a / a.sum(axis=1, keepdims=True)
            pairs = np.zeros((k, k))
            for i in range(t - 2, -1, -1):
                b = beta[i + 1] * emit[:, i + 1]
                joint = alpha[i][:, :, None] * e * b[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                b = b @ e.T
                beta[i] = b / b.sum(axis=1, keepdims=True)
            post = alpha * beta
            post /= post.sum(axis=2, keepdims=True)
            error = np.eye(k)[y] - post.transpose(1, 0, 2)
            by_word = np.stack([np.bincount(at.ravel(), error[:, :, j].ravel(), some.size) for j in range(k)], axis=1)
            spread = np.repeat(by_word, sizes[some], axis=0)
            hit, where = np.unique(own, return_inverse=True)
            g = np.stack([np.bincount(where, spread[:, j], hit.size) for j in range(k)], axis=1) / n
            gw[hit] += g * g
            w[hit] += 0.5 * g / np.sqrt(gw[hit])
            real = np.zeros((k, k))
            np.add.at(real, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            d = (real - pairs) / n
            gt += d * d
            trans += 0.5 * d / np.sqrt(gt)
    return Field(names, w, trans)


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def train(docs: DataFrame, per_lang: int = TRAIN_DOCS) -> Field:
    """Fit a field on the text and lang of at most per_lang documents of each language, those that begin in its first TRAIN_BYTES,
    whose remainder mod 3 isn't 1."""
    learned = docs.where((remainder(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    best = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = learned.select("doc_id", "lang", F.octet_length("text").cast("long").alias("size")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= per_lang)
    so_far = F.sum("size").over(Window.partitionBy("lang").orderBy("r")) - F.col("size")
    chosen = chosen.withColumn("before", so_far).where(F.col("before") < TRAIN_BYTES)
    chosen = chosen.select(F.col("doc_id").alias("c_id"), F.col("lang").alias("c_lang"))
    rows = learned.join(F.broadcast(chosen), (F.col("doc_id") == F.col("c_id")) & (F.col("lang") == F.col("c_lang"))).select("doc_id", "text", "lang").dropDuplicates(["doc_id", "lang"]).orderBy("doc_id", "lang").collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def label(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def work(batches):
        for b in slices(batches, 2):
            langs, scores = shared.value.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "text")
    return map_rows(rows, work, "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return label(docs, train(docs.select("doc_id", "text", "lang")))


ORACLE: dict[str, str] = {}
