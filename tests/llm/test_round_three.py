"""Spelling variants, hard negatives and personal data against plain versions, on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograph.llm import hard_negatives, personal_data, spelling

from .test_dedup_and_shards import ASCII_LOWER

# --- spelling variants


def brute_vocabulary(texts):
    counts = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(words, ratio=10):
    found = {}
    for w, n in words.items():
        around = [v for v in words if near(w, v)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        found[w] = (best if best is not None and words[best] >= ratio * n else None, len(around))
    out = {}
    for w, (form, k) in found.items():
        root = w
        while found[root][0] is not None:
            root = found[root][0]
        out[w] = (form, root, words[w], k, words[form] if form else None)
    return out


def spelled(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def spelling_texts():
    r = random.Random(5)
    stem = ["aabbccd", "abababab", "zzzzzzz", "étéétéé", "connection", "×÷ÿÀabcd"]
    words = list(stem) * 40
    for w in stem:
        for _ in range(60):
            v, i = w, r.randrange(len(w))
            v = r.choice([v[:i] + v[i + 1 :], v[:i] + r.choice("abzé") + v[i:], v[:i] + r.choice("abzé") + v[i + 1 :]])
            words += [v] * r.choice([1, 2, 2, 3])
    words += ["connectio"] * 3 + ["connecti"] * 2 + ["Connection"] * 500 + ["conection"] * 30 + ["conectin"] * 3
    r.shuffle(words)
    texts = [(i % 90, " ".join(words[i::100])) for i in range(100)]
    return [*texts, (None, "connection Connection"), (7, None), (8, ""), (9, "\U0001f600 1 connection2connection")]


def test_spelling(spark):
    rows = [(i, t, "clash", 1) for i, t in spelling_texts()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    out = spelling.spelling_groups(spelling.vocabulary(docs)).collect()
    want = brute_groups(brute_vocabulary(spelling_texts()))
    assert spelled(out) == want and len(out) == len(want)
    assert any(f and root != f for f, root, *_ in want.values()) and any(k > 5 for *_, k, _ in want.values())


def test_long_words(spark):
    """Rows and time are in proportion to a word's length."""
    a, b = "ab" * 100_000, "x" * 100_000
    texts = [(i, t) for t in (a, a[:5000] + "c" + a[5001:], b, b + "x") for i in range(4)]
    words = spelling.vocabulary(spark.createDataFrame(texts, "doc_id long, text string"), typo=10**12)
    out = spelling.spelling_groups(words).collect()
    with pytest.raises(ValueError):
        spelling.spelling_groups(words, ratio=1)
    assert sorted((len(r.word), r.n, r.n_near) for r in out) == [(100_000, 4, 1), (100_001, 4, 1), (200_000, 4, 1), (200_000, 4, 1)]


def test_shared_hash_is_no_link(spark, monkeypatch):
    """Words under one key whose texts differ aren't near."""

    def one_key(words):
        place, key, lo, hi = real(words)
        return place, np.zeros_like(key), lo, hi

    real = spelling.deletions
    monkeypatch.setattr(spelling, "deletions", one_key)
    words = {"abcdefg": 5, "abcdefh": 60, "abcdef": 3, "xbcdefh": 2, "qqqqqqq": 9, "qqqqqqqq": 1}
    rows = [(i, w, words[w]) for i, w in enumerate(sorted(words))]
    frame = spark.createDataFrame(rows, "wid long, word string, n long")
    emitted = spark.createDataFrame([(int(k), rows[p][0], rows[p][2], int(a), int(b)) for p, k, a, b in zip(*one_key([w for _, w, _ in rows]))], "key long, wid long, n long, lo int, hi int")
    monkeypatch.setattr(spelling, "map_rows", lambda *_: emitted)
    assert spelled(spelling.spelling_groups(frame).collect()) == brute_groups(words)


# --- hard negatives


def brute_hard(rows):
    ok = [(i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, [math.floor(256 * x) for x in v]) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    last = lambda i: math.inf if i is None else i
    out = []
    for i, y, v in ok:
        if i is None or i % 50:
            continue
        others = sorted(((-dot(v, w), last(j), z, j) for j, z, w in ok if j != i), key=lambda t: t[:2])
        for p, _, _, pid in [o for o in others if o[2] == y][:5]:
            hard = [(j, -s) for s, _, z, j in others if z != y and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(i, pid, k, j, -p, s) for k, (j, s) in enumerate(hard, 1)]
    return Counter(out)


def vectors():
    r = random.Random(8)
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f32(r.gauss(0, 1) for _ in range(6)), r.randrange(3)) for i in range(230)]
    rows += [(300 + i, rows[50][1], i % 3) for i in range(60)]  # a hot vector: ties
    rows += [rows[100], rows[100], rows[3], rows[3]]  # repeated rows
    rows += [(400, None, 1), (401, [0.5, None], 1), (402, [math.nan] * 6, 1), (403, [math.inf] * 6, 1), (450, rows[0][1], None), (None, rows[1][1], 1), (None, rows[50][1], 2), (500, [], 1), (550, [0.7], 0), (551, [1.0, -2.0, 0.5, 3.0, 1.0, 0.0, 9.0], 1)]
    return rows


def test_hard_negatives(spark, tmp_path):
    for name, rows in (("some", vectors()), ("empty", [])):
        spark.createDataFrame([(*x, "clash", 1) for x in rows], "vec_id long, embedding array<float>, label int, score string, id int").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        out = hard_negatives.op12_hard_negatives(spark, f"{tmp_path}/{name}")
        assert dict(out.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
        got = Counter(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
        assert got == brute_hard(rows)
    assert sum(brute_hard(vectors()).values()) > 50


@pytest.mark.parametrize("scale", [3, 200, 40_000, 300_000_000])
def test_planes_give_exact_scores(scale):
    """Whatever the range, no pair that qualifies is lost, and scores are exact."""
    r = np.random.default_rng(scale)
    x, a = r.integers(-scale, scale + 1, (300, 5)), r.integers(-scale // 2, scale, (7, 5))
    bits = int(np.abs(x).max()).bit_length() + 1
    planes = hard_negatives.Planes(x, bits, int(np.abs(a).sum(axis=1).max()))
    want = a.astype(object) @ x.T.astype(object)
    bar = np.sort(want, axis=1)[:, -10].astype(np.int64)
    passed = []

    def keep(at, low, high):
        passed.append(low.size)
        return high >= (bar[at] if at.ndim == 1 else bar[:, None])

    i, j, s = planes.survivors(a, slice(0, 300), np.ones((7, 300), bool), keep)
    assert {(p, q, t) for p, q, t in zip(i.tolist(), j.tolist(), s.tolist())} == {(p, q, want[p, q]) for p in range(7) for q in range(300) if want[p, q] >= bar[p]}
    assert scale == 3 or passed[-1] < 0.5 * passed[0]  # the intervals drop pairs before the last plane


def test_many_cells(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CELL_BYTES", 2000)
    rows = [x for x in vectors() if x[1] is None or len(x[1]) <= 7]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    ints = hard_negatives.integers(frame, label)
    out = hard_negatives.mine(ints, ints.where((F.col("id") % 50 == 0) & (F.col("id") != hard_negatives.NO_ID)))
    assert Counter(tuple(r) for r in out.collect()) == brute_hard(rows)


def test_scores_beyond_a_long_are_an_error(spark):
    ints = hard_negatives.integers(spark.createDataFrame([(50, [1e15, 1e15], 1), (1, [1e15, 1.0], 1)], "vec_id long, embedding array<double>, label int"), F.col("label").cast("long"))
    with pytest.raises(ValueError, match="long"):
        hard_negatives.mine(ints, ints)


# --- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_personal(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = "".join(c for c in m[0] if c in "0123456789")
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and plain_luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def personal_texts():
    r = random.Random(4)
    bits = ["a.b@c.de", "@", "a@b", "a@b@c.d", "x@y.z@q.w", ".", "..", "1.2.3.4", "256.1.1.1", "000000001.2.3.4.5.6", "4111111111111111", "4111 1111-1111 1111", "+1 (743) 555-3824", "+49 30 ", "+", "-", " ", "7", "12", "\U0001f600", "١", "word", "a1%+-", "\n", "SSN 123-45-6789", "IBAN DE89 3704 0044 0532 0130 00"]
    made = ["".join(r.choices(bits, k=r.randrange(1, 12))) for _ in range(800)]
    return [*made, None, "", " \n", "a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "a@" * 50_000, "1 " * 100_000, "Aa " * 60_000, ":1" * 50_000, "DE89" * 30_000, "a@b." * 40_000, "1-" * 60_000]


def test_personal_data(spark, tmp_path):
    texts = personal_texts()
    rows = [(i // 2, t, "clash", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, c_kind string, n_email int").write.parquet(f"{tmp_path}/documents.parquet")
    out = personal_data.op13_personal_data(spark, str(tmp_path)).collect()
    want = Counter()
    for i, t in enumerate(texts):
        found = brute_personal(t or "") if len(t or "") < 1000 else personal_data.base_spans(t)
        joined = ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in found)
        n = Counter(k for _, k, _ in found)
        want[i // 2, n[0], n[1], n[2], n[3], hashlib.sha256(joined.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out) == want
    for r in out:
        kinds = Counter(s.split(":")[0] for s in r.spans.split(",") if s)
        assert (kinds["email"], kinds["ip"], kinds["card"], kinds["phone"]) == (r.n_email, r.n_ip, r.n_card, r.n_phone)
    some = {s.split(":")[0] for r in out for s in r.spans.split(",")}
    assert {"national_id", "iban"} <= some


@pytest.fixture(scope="module")
def taught(spark):
    """A corpus where few candidates are personal data."""
    r = random.Random(6)
    plain = [f"{r.choice(['Order', 'part no', 'version', 'build'])} {r.randrange(100, 999)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)} and {r.choice('ABC')}lpha {r.choice('ABC')}eta went" for _ in range(400)]
    told = [f"my SSN is {r.randrange(100, 665)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)} thanks, signed {r.choice(['John', 'Maria'])} Keller" for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(plain + told)), "doc_id long, text string")
    return personal_data.train(personal_data.find(docs))


def decided(text, weights):
    some = personal_data.candidates(text, personal_data.base_spans(text))
    v = [personal_data.votes(text, personal_data.KINDS[k], s, e) for k, s, e in some]
    feats = [personal_data.features(text, personal_data.KINDS[k], s, e, x) for (k, s, e), x in zip(some, v)]
    return [f"{personal_data.KINDS[k]}:{text[s:e]}" for s, k, e in sorted(personal_data.added_spans(*zip(*[(k, s, e, f) for (k, s, e), f in zip(some, feats)]), weights))] if some else []


@pytest.mark.parametrize(
    "text, want",
    [
        ("the SSN is 219-09-9999 here", ["national_id:219-09-9999"]),
        ("order 219-09-9999 shipped", []),
        ("SSN: 000-12-3456", []),
        ("call (415) 555-2671 tonight", ["local_phone:(415) 555-2671"]),
        ("write to jane.doe [at] example [dot] com", ["masked_email:jane.doe [at] example [dot] com"]),
        ("look at home.Then go", []),
        ("IBAN DE89 3704 0044 0532 0130 00", ["iban:DE89 3704 0044 0532 0130 00"]),
        ("IBAN DE88 3704 0044 0532 0130 00", []),
        ("born 12/05/1987 there", ["birth_date:12/05/1987"]),
        ("released 12/05/1987 there", []),
        ("host 2001:db8::8a2e:370:7334 up", ["ip6:2001:db8::8a2e:370:7334"]),
        ("at 12:30:45 we met", []),
        ("4495114827612972 190.13.2.1", ["bare_card:4495114827612972"]),
        ("signed John Keller", ["person:John Keller"]),
        ("Alpha Beta went", []),
        ("he lives at 12 Baker Street now", ["address:12 Baker Street"]),
        ("no data, 3 kg at 12 EUR", []),
    ],
)
def test_spans_of_the_classifier(taught, text, want):
    assert decided(text, taught[1]) == want


def test_reliabilities_follow_the_votes(taught):
    """Cues before a number tell its classes apart here, so they come out as reliable; posteriors agree with what was made."""
    labels = taught[0]
    kind = personal_data.KINDS.index("national_id")
    assert labels.reliability(kind)[3] > 0.75 and 0.2 < labels.known[kind][0][1] < 0.5
    assert labels.posterior(kind, personal_data.encoded([1, 1, 0, 1, 0, 0])) > 0.9 > 0.3 > labels.posterior(kind, personal_data.encoded([1, 1, 0, -1, 0, 0]))
