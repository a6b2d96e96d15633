"""Secret scans: base rules, and automata inferred from labelled credentials.

Base spans come from three fixed patterns. Beside them, every run of credential characters as long as the shortest labelled
credential is a candidate, unless a base span touches it; of those, and of runs that are no secret as a whole, the parts are: what base
spans leave, what follows a known opening, and what '=', '/' and '.' cut off, so that a name or a host before a secret doesn't hide it.

For each credential format a prefix tree of labelled examples is folded into a probabilistic automaton by merging states whose
outgoing frequencies agree within the Hoeffding bound (red-blue state merging). States are merged by character classes; within a
state and a class each character has its own probability, so a fixed opening is part of the likelihood and needs no rule. One more
automaton is inferred from labelled harmless strings. A candidate is a secret if it is as long as some example of a format,
its log-likelihood under that format is within the range of the examples, per character, and above that under the harmless automaton by MARGIN, which lies above the ratio of
all but one in a thousand harmless strings of words that the automaton hasn't seen.

The examples are generated from the public shapes of credentials, EXAMPLES for each, with a fixed seed; nothing of the
tables is learned. Texts are scanned whole in one pass and nothing is shuffled.

Edge cases: a null or empty text has no spans; base_sha256 is then the hash of the empty string. Spans of different kinds may
overlap, spans of one kind never do. Very long texts and runs take time in proportion. Rows are scanned one by one, so rows that
repeat, share a doc_id or have none need no care; equal likelihoods are no secret; an empty table gives an empty result; of other
columns, whatever their names, none is read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import random
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows, slices

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_SECRET, MIN_RUN = 6, 20  # no labelled credential is shorter than MIN_RUN; Model holds it against the examples
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_RUN)

EXAMPLES, ALPHA, MARGIN, SLACK = 200, 0.05, 8.0, 0.25


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base rules, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_SECRET]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


# --- labelled examples


def _pick(r: random.Random, alphabet: str, n: int) -> str:
    return "".join(r.choices(alphabet, k=n))


ALNUM = string.ascii_letters + string.digits


def _token(r: random.Random) -> str:
    return base64.urlsafe_b64encode(json.dumps({"sub": _pick(r, string.digits, r.randrange(4, 12)), r.choice(["exp", "iat", "name"]): r.randrange(10**9)}).encode()).decode().rstrip("=")


#: Public shapes of credentials: label -> generator.
FORMATS: dict[str, Callable[[random.Random], str]] = {
    "access key id": lambda r: r.choice(["AKIA", "ASIA"]) + _pick(r, string.ascii_uppercase + string.digits, 16),
    "secret key": lambda r: _pick(r, ALNUM + "+/", 40),
    "code host token": lambda r: r.choice(["ghp_", "gho_", "ghs_"]) + _pick(r, ALNUM, 36),
    "chat token": lambda r: r.choice(["xoxb-", "xoxp-"]) + _pick(r, string.digits, 12) + "-" + _pick(r, string.digits, 12) + "-" + _pick(r, ALNUM, 24),
    "maps key": lambda r: "AIza" + _pick(r, ALNUM + "-_", 35),
    "payment key": lambda r: r.choice(["sk_live_", "rk_live_", "sk_test_"]) + _pick(r, ALNUM, 24),
    "web token": lambda r: r.choice(["eyJhbGciOiJIUzI1NiJ9.", "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.", "eyJ0eXAiOiJKV1QiLCJhbGciOiJSUzI1NiJ9."]) + _token(r) + "." + _pick(r, ALNUM + "-_", 43),
    "upper hex": lambda r: _pick(r, "0123456789ABCDEF", r.choice([32, 40, 64])),
    "random token": lambda r: _pick(r, ALNUM, r.randrange(24, 49)),
}


#: Common words of names, paths and prose in code and documents; every third one is kept for the margin, the others for the automaton.
WORDS = (
    "access account action address admin after agent alpha amount analysis android answer apple archive array article asset async auth author backup balance bank base "
    "batch before block board body book border bottom branch browser buffer build button cache camera cancel catalog center change channel chapter check child city class "
    "client cloud code color column command comment common company config connection content context control copy core count country create credit current custom data "
    "database date debug default delete design detail device digital direct display document domain download driver edit email enable engine entry error event example "
    "export factory feature field file filter final finish first folder font format forum frame free function gallery game general github global google graph group guide "
    "handler header health height history home host house html icon image import index info input install issue java jquery just kernel key label language layer"
).split()


def _pseudo(r: random.Random) -> str:
    """A word of letters in about their usual frequencies, consonants and vowels in turn."""
    turn = r.randrange(2)
    return "".join(r.choice("ttnnsshrrdllccmmffggppbbvvkwyjxqz" if (i + turn) % 2 else "eeeeaaaiiioooouuy") for i in range(r.randrange(2, 9)))


def _word(r: random.Random, held_out: bool = False) -> str:
    return _pseudo(r) if r.random() < 0.4 else r.choice([w for i, w in enumerate(WORDS) if (i % 3 == 0) == held_out])


#: Strings of the same characters that are no secrets, from a source of words.
HARMLESS: list[Callable[[random.Random, Callable[[], str]], str]] = [
    lambda r, w: "".join(w() for _ in range(5)),
    lambda r, w: "".join(w() for _ in range(4)).upper(),
    lambda r, w: "-".join(w() for _ in range(r.randrange(3, 8))),
    lambda r, w: "_".join(w() for _ in range(r.randrange(3, 8))),
    lambda r, w: "_".join(w() for _ in range(r.randrange(3, 7))).upper(),
    lambda r, w: "".join(w().capitalize() for _ in range(r.randrange(3, 8))),
    lambda r, w: w() + "".join(w().capitalize() for _ in range(r.randrange(2, 8))),
    lambda r, w: "/".join(w() for _ in range(r.randrange(3, 8))) + r.choice(["", ".html", "/", "/index.php", ".png", ".js"]),
    lambda r, w: ".".join(w() for _ in range(r.randrange(3, 6))) + r.choice([".com", ".org", ".example.net", "", ""]),
    lambda r, w: "www." + w() + ".com/" + w() + "/" + str(r.randrange(10**6)),
    lambda r, w: f"{r.randrange(1990, 2030)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}-{w()}-{w()}-{r.randrange(100)}",
    lambda r, w: _pick(r, string.digits, r.randrange(16, 64)),
    lambda r, w: r.choice("=-_.") * r.randrange(16, 60),
    lambda r, w: r.choice([*"019xXaAF", "01", "abc", "123"]) * r.randrange(16, 60),
    lambda r, w: f"{w()}.{r.randrange(100)}-{w()}{r.randrange(10)}.example.com",
    lambda r, w: f"{w()}_{w()}{r.randrange(10)}_{w()}v{r.randrange(10)}.{r.randrange(30)}.{r.randrange(9)}",
    lambda r, w: "-".join(_pick(r, "0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
    lambda r, w: f"{w()}={w()}.{w()}/{w()}={r.randrange(1000)}",
]


def harmless(r: random.Random, held_out: bool = False) -> str:
    return r.choice(HARMLESS)(r, lambda: _word(r, held_out))


# --- state merging


def symbols(text: str) -> str:
    """The string in character classes: h, H hexadecimal letters, l, U other letters, d digits, punctuation itself."""
    return text.translate(_CLASSES)


_CLASSES = str.maketrans(string.ascii_lowercase + string.ascii_uppercase + string.digits, "h" * 6 + "l" * 20 + "H" * 6 + "U" * 20 + "d" * 10)
#: What a character's class holds, and the alphabet of credentials.
MEMBERS = {"h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ", "d": string.digits} | {c: c for c in "+/_.=-"}
PRIOR = 2.0  # what the frequencies of the whole automaton count beside those of a state


class Automaton:
    """Probabilistic automaton by merging compatible states of the prefix tree of `words`."""

    def __init__(self, words: list[str], alpha: float = ALPHA) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.chars: list[Counter] = [Counter()]
        self.ends, self.total = [0], [0]
        for w in words:
            s = 0
            for char, c in zip(w, symbols(w)):
                self.total[s] += 1
                self.chars[s][char] += 1
                self.count[s][c] = self.count[s].get(c, 0) + 1
                if c not in self.next[s]:
                    self.next[s][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.chars.append(Counter())
                    self.ends.append(0)
                    self.total.append(0)
                s = self.next[s][c]
            self.total[s] += 1
            self.ends[s] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            na, nb = self.total[a], self.total[b]
            if self._differ(self.ends[a], na, self.ends[b], nb):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self._differ(self.count[a].get(c, 0), na, self.count[b].get(c, 0), nb):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    stack.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the subtree of b to a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.total[a] += self.total[b]
            self.ends[a] += self.ends[b]
            self.chars[a].update(self.chars[b])
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    stack.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge(self) -> None:
        red = [0]
        while True:
            blue = [(self.total[t], -t, s, c) for s in red for c, t in self.next[s].items() if t not in red]
            if not blue:
                break
            _, t, s, c = max(blue)
            for r in red:
                if self._compatible(r, -t):
                    self.next[s][c] = r
                    self._fold(r, -t)
                    break
            else:
                red.append(-t)
        self.states = len(red)
        self.log: list[dict[str, tuple[float, int]]] = [{} for _ in self.next]
        every, size = Counter(), 1
        for s in red:
            every.update(self.chars[s])
        size += sum(every.values())
        for s in red:
            for c, members in MEMBERS.items():
                n, whole = self.count[s].get(c, 0), sum(every[x] for x in members)
                p = math.log((n + PRIOR * (whole + 0.05) / size) / (self.total[s] + PRIOR))
                for x in members:
                    share = (every[x] + 0.5) / (whole + 0.5 * len(members))
                    self.log[s][x] = p + math.log((self.chars[s][x] + PRIOR * share) / (n + PRIOR)), self.next[s].get(c, 0)
        self.stop = [math.log((self.ends[s] + 0.1) / (self.total[s] + 1.5)) for s in range(len(self.next))]

    def score(self, word: str) -> float:
        """Log-likelihood of the string and its end; a class that a state never saw leads to the first state."""
        s, total = 0, 0.0
        for c in word:
            p, s = self.log[s][c]
            total += p
        return total + self.stop[s]


class Model:
    """One automaton for each format, with the least log-likelihood for each character that its examples have, and one for harmless strings."""

    def __init__(self, seed: int = 11, examples: int = EXAMPLES) -> None:
        r = random.Random(seed)
        self.formats: list[tuple[int, float, Automaton]] = []  # the least length and likelihood of the examples
        openings = set()
        for make in FORMATS.values():
            words = [make(r) for _ in range(examples)]
            assert min(map(len, words)) >= MIN_RUN
            a = Automaton(words)
            self.formats.append((min(map(len, words)), min(a.score(w) / (len(w) + 1) for w in words) - SLACK, a))
            openings |= _openings(words)
        self.opening = re.compile("(?=%s)" % "|".join(sorted(map(re.escape, openings), reverse=True)))
        self.harmless = Automaton([harmless(r) for _ in range(examples * 15)])
        self.tables: tuple = ()

    def ratio(self, word: str) -> float:
        """Log-likelihood under the best format whose examples are as unlikely, against that of a harmless string; minus infinity if there is none."""
        scores = [(a.score(word), floor) for size, floor, a in self.formats if len(word) >= size]
        best = max((x for x, floor in scores if x >= floor * (len(word) + 1)), default=-math.inf)
        return best - self.harmless.score(word) if best > -math.inf else best

    def secret_suffixes(self, run: str) -> np.ndarray:
        """secret(run[i:]) of every i, in one pass from the end: the likelihood of the rest from every state."""
        if not self.tables:
            stops, moves, first = [], [], []
            for a in (*(a for *_, a in self.formats), self.harmless):
                first.append(len(stops))
                place = {0: len(stops)}  # only states that merging left
                for s in (queue := [0]):
                    stops.append(a.stop[s])
                    for c, (p, t) in a.log[s].items():
                        if t not in place:
                            place[t] = first[-1] + len(queue)
                            queue.append(t)
                        moves.append((c, place[s], p, place[t]))
            steps = {c: (np.zeros(len(stops)), np.arange(len(stops))) for c in {c for c, *_ in moves}}
            for c, s, p, t in moves:
                steps[c][0][s], steps[c][1][s] = p, t
            self.tables = (np.array(first), np.array(stops), steps, np.array([floor for _, floor, _ in self.formats]), np.array([size for size, *_ in self.formats]))
        first, value, steps, floors, sizes = self.tables
        body = run.rstrip(".=-")
        n = len(body)
        score = np.empty((n + 1, first.size))
        score[n] = value[first]
        for i in range(n - 1, -1, -1):
            p, to = steps[body[i]]
            value = p + value[to]
            score[i] = value[first]
        left = np.arange(n, -1, -1)[:, None]
        best = np.where((score[:, :-1] >= floors * (left + 1)) & (left >= sizes), score[:, :-1], -np.inf).max(axis=1)
        good = np.zeros(len(run), bool)
        good[:n] = (best - score[:, -1] > MARGIN)[:n]
        for i in range(n - 1, -1, -1):  # what stands before is stripped
            if run[i] in ".=-":
                good[i] = i + 1 < n and good[i + 1]
        return good

    def secret(self, run: str) -> bool:
        return self.ratio(run.strip(".=-") or run) > MARGIN


def _openings(words: list[str], share: float = 0.1, size: int = 3) -> set[str]:
    """The strings of `size` characters that at least that share of the examples begin with."""
    return {o for o, n in Counter(w[:size] for w in words).items() if n >= share * len(words)}


def spans(text: str, model: Model) -> tuple[list, list]:
    """Base spans, and these with the spans of whole runs, of a text."""
    base = base_spans(text)
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for *_, e in base), max))  # the furthest end so far
    more = []
    for m in RUN.finditer(text):
        a, b = m.span()
        before = bisect_left(starts, b)
        if not (before and reach[before - 1] > a) and model.secret(m[0]):
            more.append((a, 3, b))
    return base, sorted(base + more)


CUTS = re.compile(r"[=/.]")
FEW = 8  # more suffixes of one part than this are scored together


def _parts(run: str, model: Model):
    """(start, end) of the secrets that begin at an opening or after '=', '/' or '.', and end with the run or at a '=', at a
    '/' too, or at a '.' too; those of openings and longer ones first."""
    ends = [[m.start() for m in re.finditer(c, run)] + [len(run)] for c in ("=", "[=/]", "[=/.]")]
    opened, cuts = [m.start() for m in model.opening.finditer(run)], [0, *(m.end() for m in CUTS.finditer(run))]
    if model.secret(run):
        yield 0, len(run)
    for starts in (opened, cuts):
        for e in ends:
            for end, group in groupby(starts, lambda i: e[bisect_left(e, i)]):
                group = [i for i in group if end - i >= MIN_RUN]
                if len(group) > FEW:
                    good = model.secret_suffixes(run[group[0] : end])
                    yield from ((i, end) for i in group if good[i - group[0]])
                else:
                    yield from ((i, end) for i in group if model.secret(run[i:end]))


def part_spans(text: str, found: list, model: Model) -> list:
    """Spans, beside those found, of secrets that are parts of runs: no two overlap, and none overlaps one of those found."""
    starts = [s for s, _, _ in found]
    reach = list(accumulate((e for *_, e in found), max))
    more = []
    for m in RUN.finditer(text):
        a, b = m.span()
        rests, before = [], bisect_left(starts, b)
        at = a
        for s, _, e in found[bisect_left(reach, a + 1) : before]:
            rests.append((at, s))
            at = max(at, e)
        for s, e in (*rests, (at, b)):
            if e - s < MIN_RUN:
                continue
            taken: list[tuple[int, int]] = []
            for i, j in _parts(text[s:e], model):
                if (s + i, s + j) != (a, b) and all(s + j <= x or y <= s + i for x, y in taken):
                    taken.append((s + i, s + j))
            more += [(i, 3, j) for i, j in taken]
    return more


def _joined(found: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Counts and spans of the secrets of every row."""
    model = model or Model()

    def work(batches):
        for b in slices(batches, 1):
            cols: list[list] = [[] for _ in range(5)]
            for text in b.column(1).to_pylist():
                base, every = spans(text or "", model)
                every = sorted(every + part_spans(text or "", every, model))
                kinds = [k for _, k, _ in base]
                for col, x in zip(cols, (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every))):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64() if i < 3 else pa.string()) for i, c in enumerate(cols)]], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), work, SCHEMA)


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE: dict[str, str] = {}
