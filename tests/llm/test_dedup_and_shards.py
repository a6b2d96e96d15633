"""Line dedup, SimHash groups, sharding and packing against plain versions, and on awkward tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliograph.llm import line_dedup, packing, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = " \t\n\x0b\x0c\r"


def make(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], SCHEMA)


AWKWARD = [None, "", " \n\t", "x", "word " * 300_000, "same text twice", "same text twice", "É " * 50, "a\x00b c", "\n" * 2000]


def long_line(i):
    return f"this is a shared line number {i} of enough length"


def line_texts():
    r = random.Random(1)
    out = []
    for d in range(60):
        lines = [long_line(r.randrange(12)) for _ in range(r.randrange(0, 6))] + [f"own {d} {k} " + "z" * r.randrange(30) for k in range(3)]
        r.shuffle(lines)
        out.append("\n".join(("  " + x.upper() if r.random() < 0.3 else x) for x in lines))
    return out + ["everyone has this very long hot line\nrest " + str(i) for i in range(300)]


def brute_lines(rows):
    """{id: (n_lines, n_dropped, sha)} of distinct ids."""
    keyed = {i: [(x, x.strip(SPACES).translate(ASCII_LOWER)) for x in (t or "").split("\n")] for i, t in rows}
    docs = {}
    for i, lines in keyed.items():
        for _, k in lines:
            if len(k) >= 20:
                docs.setdefault(k, set()).add(i)
    out = {}
    for i, lines in keyed.items():
        stay = [x for x, k in lines if len(docs.get(k, ())) < 3 or max(docs[k]) == i]
        out[i] = (len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return out


ONE_REPEATS = ["\n".join([long_line(2)] * 500), long_line(2), "\n".join([long_line(3)] * 500 + [long_line(2)]), long_line(3)]


@pytest.mark.parametrize("texts", [line_texts(), AWKWARD + [long_line(1)] * 4, ONE_REPEATS], ids=["mixed", "awkward", "one repeats"])
def test_line_dedup(spark, texts):
    out = line_dedup.dedup_lines(make(spark, texts)).select("_row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("sha")).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.sha) for r in out} == brute_lines(list(enumerate(texts)))


def test_line_dedup_names_repeats_and_null_ids(spark):
    line = "the same long line of thirty characters"
    df = spark.createDataFrame([(1, line, "k"), (1, line, "k"), (2, line, "k"), (None, line, "k"), (None, "other", "k")], "doc_id long, text string, n_lines string").withColumn("h", F.lit(1)).withColumn("_id", F.lit(2))
    rows = line_dedup.dedup_lines(df).select("_row.doc_id", "_row.n_lines", "kept").collect()
    assert Counter((r.doc_id, r.kept) for r in rows) == {(1, ""): 2, (2, line): 1, (None, ""): 1, (None, "other"): 1}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def brute_print(text):
    words = (text or "").translate(ASCII_LOWER).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s, 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in counts.items() if 2 * n > len(shingles))


def brute_groups(prints):
    """{id: smallest id reachable} over Hamming distance of 3 or less."""
    ids, fp = list(prints), np.array([prints[i] for i in prints], np.uint64)
    label = np.arange(len(ids))
    links = [np.flatnonzero(np.bitwise_count(fp ^ f) <= 3) for f in fp]
    while True:
        new = np.array([label[x].min() for x in links])
        if (new == label).all():
            return {i: min(ids[j] for j in range(len(ids)) if label[j] == label[k]) for k, i in enumerate(ids)}
        label = new


def near_copies():
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    out = list(AWKWARD)
    for _ in range(12):
        base = [word() for _ in range(400)]
        out.append(" ".join(base))
        for _ in range(r.randrange(0, 9)):
            copy = list(base)
            for _ in range(r.randrange(1, 4)):
                copy[r.randrange(400)] = word()
            out.append("  ".join(copy).title())
    return out


def test_simhash_groups(spark):
    texts = near_copies()
    rows = simhash.near_duplicate_groups(make(spark, texts)).collect()
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    assert {r["_id"]: r.fp % 2**64 for r in rows} == prints
    assert {r["_id"]: r.component_id for r in rows} == brute_groups(prints)


def test_simhash_cuts_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 3)
    texts = ["one two three four"] * 20 + near_copies()[:40] + [None] * 7
    rows = simhash.near_duplicate_groups(make(spark, texts)).collect()
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    assert len(rows) == len(texts) and {r["_id"]: r.component_id for r in rows} == brute_groups(prints)


def test_simhash_links_lose_nothing(spark):
    """Chains of fingerprints one to three bits apart, dense cells, and cells cut into blocks."""
    r = random.Random(9)
    prints = {r.getrandbits(64) for _ in range(200)}
    for seed in list(prints)[:10]:
        f = seed
        for _ in range(20):
            for _ in range(r.randrange(1, 4)):
                f ^= 1 << r.randrange(64)
            prints.add(f)
    signed = [f - 2**64 if f >= 2**63 else f for f in prints]
    points = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = brute_groups({f: f % 2**64 for f in signed})
    for block in (4096, 2):
        got = {x.node: x.root for x in simhash.components(simhash.links(points, block=block)).collect()}
        assert {f: got.get(f, f) for f in signed} == want


def test_simhash_keeps_one(spark):
    df = make(spark, ["a b c d", "a b c d", "x y z", None, "", "only here, without an id", "x y z"], [4, 2, 7, 9, None, None, 7]).withColumn("fp", F.lit(0)).withColumn("root", F.lit("r"))
    kept = simhash.keep_one_of_each_group(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == {(2, "a b c d"): 1, (7, "x y z"): 2, (9, None): 1, (None, "only here, without an id"): 1}
    assert simhash.keep_one_of_each_group(df.limit(0)).count() == 0


def test_hypergeometric_law():
    r = random.Random(3)
    draws = [sharding.hypergeometric(r, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.12 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.25
    big = [sharding.hypergeometric(r, 3 * 10**9, 7 * 10**9, 10**6) for _ in range(200)]
    assert abs(np.mean(big) - 3e5) < 200
    assert all(sharding.hypergeometric(r, g, b, n) in range(max(0, n - b), min(g, n) + 1) for g in range(5) for b in range(5) for n in range(g + b + 1))


def test_matrix_margins():
    blocks = [0, 5, 100, 3, 17]
    m = sharding.communication_matrix(blocks, 8, 1)
    assert [sum(r) for r in m] == blocks
    assert sorted(map(sum, zip(*m))) == sorted([125 // 8 + (j < 125 % 8) for j in range(8)])


@pytest.mark.parametrize("n", [0, 1, 5, 203])
def test_shards(spark, n):
    df = make(spark, ["same" if i % 3 == 0 else str(i) for i in range(n)]).withColumn("shard", F.lit("clash")).withColumn("_rank", F.lit(0))
    out = sharding.shard_rows(df).select("_row.doc_id", "shard", "slot").collect()
    assert sorted(r.doc_id for r in out) == list(range(n))
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(j, [])) for j in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert [tuple(r) for r in sharding.shard_rows(df).select("_row.doc_id", "shard", "slot").collect()] == [tuple(r) for r in out]
    assert sharding.shard_rows(df.union(df)).count() == 2 * n


def test_equal_rows_are_shuffled_uniformly(spark):
    """Of 800 rows, 400 are equal in all columns; shards, and places inside them, are independent of content and of position."""
    df = spark.createDataFrame([(7, "same") if i % 2 else (i, str(i)) for i in range(800)], "doc_id long, text string").repartition(3)
    out = sharding.shard_rows(df).select("_row.text", "shard", "slot").collect()
    same = np.array([r.text == "same" for r in sorted(out, key=lambda r: (r.shard, r.slot))]).reshape(8, 100)
    assert (abs(same.sum(axis=1) - 50) < 20).all()  # 4 sigma of the hypergeometric law
    assert (abs(same[:, :50].sum(axis=1) - same[:, 50:].sum(axis=1)) < 25).all()
    assert ((same[:, 1:] != same[:, :-1]).sum(axis=1) > 30).all()  # about 50 changes, one for a stretch
    # all seats of two equal rows and two others over many seeds
    seats = Counter()
    four = spark.createDataFrame([(1,), (1,), (2,), (3,)], "x int")
    for seed in range(24):
        seats.update((r.x, r.shard) for r in sharding.shard_rows(four, 2, seed).select("_row.x", "shard").collect())
    assert abs(seats[1, 0] - 24) < 17 and abs(seats[2, 0] - 12) < 10 and abs(seats[3, 0] - 12) < 10


def check_pieces(rows, texts):
    """rows: of texts by id; each id of a text lies in exactly one piece, sequences are gapless and of at most 1024."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, ids.size) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == ids.size
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return len(by_sequence), sum(r.length for r in rows)


def test_packing(spark):
    r = random.Random(2)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randrange(1, 8))) for _ in range(300)]
    texts = dict(enumerate([" ".join(r.choices(words, k=r.choice([3, 40, 400, 3000]))) for _ in range(120)] + AWKWARD + ["Größe <|endoftext|> «ñ» 日本語 \r\n  x"]))
    rows = packing.pack(make(spark, list(texts.values())), shard=16).collect()
    sequences, tokens = check_pieces(rows, texts)
    assert sequences <= tokens / 1024 + 3  # a padded window for each partition at most
    with_ids = packing.pack(make(spark, list(texts.values())), with_ids=True).collect()
    assert all(zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length for p in with_ids)


@pytest.mark.parametrize("run", [" ", "\t", "\n", " \n", "\u3000"])
def test_packing_takes_long_white_space(spark, run):
    texts = {0: "a" + run * 1_000_000 + "b", 1: run * 5000, 2: run * 4095 + "x"}
    check_pieces(packing.pack(make(spark, list(texts.values()))).collect(), texts)


def test_packing_awkward(spark):
    assert packing.pack(make(spark, [])).count() == 0
    rows = packing.pack(make(spark, ["a b"] * 5, [1, 1, 1, None, None]).withColumn("total", F.lit(1)).withColumn("key", F.lit("k"))).collect()
    assert Counter((r.doc_id, r.start) for r in rows) == {(1, 0): 3, (None, 0): 2}
    assert len({r.sequence_id for r in rows}) <= 2


def test_packing_prefers_neighbours():
    """A seed's window takes the tails that share its rare tokens."""
    r = np.random.default_rng(0)
    topic = [r.integers(1000 * t, 1000 * t + 50, 256) for t in range(4) for _ in range(4)]
    order = r.permutation(16)
    shard = packing.Shard([topic[i] for i in order], np.ones(5000, np.float32), 256.0)
    for window in shard.windows(1024):
        assert len({order[i] // 4 for i, *_ in window}) == 1


def test_packing_keeps_topics_together():
    """Most of a tail's best neighbours by brute force are in its shard, far more than a random shard would hold."""
    r = np.random.default_rng(5)
    common, topics = r.integers(0, 200, (600, 60)), [r.integers(1000 + 300 * t, 1000 + 300 * t + 120, (50, 60)) for t in range(12)]
    tails = [np.concatenate([c, t]) for c, t in zip(common, (row for topic in topics for row in topic))]
    df = np.zeros(5000)
    for t in tails:
        df[np.unique(t)] += 1
    idf = np.log1p((600 - df + 0.5) / (df + 0.5)).astype(np.float32)
    leaves, whole = packing.Leaves(tails[::2], idf, 120.0), packing.Shard(tails, idf, 120.0)
    place = np.empty(600, np.int64)
    place[np.lexsort((np.arange(600), [leaves.leaf(t) for t in tails]))] = np.arange(600)
    shard, hits = place // 100, []
    for seed in range(0, 600, 7):
        best = np.argsort(-whole.scores(seed), kind="stable")[1:11]
        hits.append((shard[best] == shard[seed]).mean())
    assert np.mean(hits) > 0.7
    assert packing.Leaves([], idf, 1.0).leaf(tails[0]) == 0


def test_packing_scores_by_all_terms():
    r = np.random.default_rng(3)
    tails, idf = [r.integers(0, 400, n) for n in (900, 300, 300, 20, 1)], r.random(400).astype(np.float32)
    mean = float(np.mean([t.size for t in tails]))
    shard = packing.Shard(tails, idf, mean)
    for seed, own in enumerate(tails):
        want = [sum(idf[w] * n * (packing.K1 + 1) / (n + packing.K1 * (1 - packing.B + packing.B * t.size / mean)) for w in set(own.tolist()) if (n := int((t == w).sum()))) for t in tails]
        assert np.allclose(shard.scores(seed), want, rtol=1e-4)
