"""Personal data: base rules, and a span classifier taught by weak supervision.

Base spans come from four fixed patterns. Beside them, wide patterns propose candidates of further kinds. On each candidate six labelers vote yes, no or
abstain: the strict form of its kind, checks (sums, ranges, calendars), gazetteers, cue words before and after it, and what it touches. No candidate is labelled by hand.

The table of votes of all documents is counted by Spark, so what reaches the driver are at most 3 ** 6 patterns for each kind. Expectation-maximisation estimates
from these counts how often a kind's candidates are personal data, and how often each labeler votes how on either class. The posteriors of the patterns are the targets of the
final classifier, a logistic regression over hashed features (shape, neighbouring words, votes), fitted on one candidate for each of SAMPLE
hash buckets of every kind: that bound is a parameter. Every pattern of votes that the estimated labelers could show is an example too, by its probability and
without a text, so that kinds that a corpus hardly holds are learned as far as the labelers go. It then scores every candidate; those above THRESHOLD are spans.

Texts are read once: base spans and candidates with votes and features are written, which is small, and the last pass works on these. Nothing is shuffled
but counts and the sample, both combined on the map side.

Edge cases: a null or empty text has no spans; base_sha256 is then the hash of the empty string. Base spans of different kinds may overlap; an added span
overlaps no other. Very long texts take time in proportion: what could start anywhere in a run is tried once for a run. Rows that repeat, share a doc_id
or have none are scanned one by one. A probability of just THRESHOLD is no span; of two that overlap, the likelier, then the earlier one, stays. Only doc_id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re
import zlib
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows, slices
from .common import materialize, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("masked_email", "local_phone", "bare_card", "national_id", "iban", "ip6", "birth_date", "person", "address")
KINDS = BASE + ADDED
LABELERS, SAMPLE, PATTERN_WEIGHT, WIDTH, THRESHOLD = 6, 2000, 2000, 1 << 16, 0.5
OWN = len(ADDED) * (1 + 3 * LABELERS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str):
    """A run of local characters has one '@' after it at most, so each is read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base rules, sorted."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# Marks, cue words and gazetteers in four languages.
_AT = r"(?:\s?[\[({<]\s?(?:at|arroba)\s?[\])}>]\s?|\s(?:at|AT|arroba)\s)"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|punkt|punto|point)\s?[\])}>]\s?|\s(?:dot|DOT|punkt|punto|point)\s|\.(?=[A-Za-z]))"
_CAP = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,30}(?!\w)"
TITLES = r"Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Sr|Sra|Señor|Señora|Don|Doña|Mme|Mlle|Monsieur|Madame"
GIVEN = frozenset(
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Emma Olivia Daniel Anna Peter Paul Laura Julia Hans Klaus Jürgen Wolfgang Ursula Sabine Petra Monika Stefan Andreas Matthias Lukas José María Juan Carmen Antonio Ana Manuel Isabel Francisco Pilar Luis Carlos Javier Lucía Pablo Marta Jean Marie Pierre Jacques Michel Nathalie Isabelle Catherine Philippe Sophie François Claire Nicolas Camille Louis Jane Alice Bob Maria Eva Max Felix Hugo".split()
)
TLDS = frozenset("com org net edu gov mil int info biz io dev app eu de es fr uk us ca mx ch at it nl be pt br ar cl co ai me".split())
NOT_NAMES = frozenset("the this that these those a an and or but if in on at of to for by with from new north south east west united street avenue road january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split())
CUES = {
    "masked_email": r"e-?mail|mail|correo|courriel|contact|kontakt|write|reach",
    "local_phone": r"phone|tel|telefon\w*|tel[ée]fono|t[ée]l[ée]phone|call|mobile|cell|fax|handy|m[óo]vil|contact|ring",
    "bare_card": r"card|visa|mastercard|amex|credit|debit|karte|kreditkarte|tarjeta|carte",
    "national_id": r"ssn|social security|national id|tax id|dni|nif|steuer\w*|sozialversicherung\w*|s[ée]cu\w*|insurance",
    "iban": r"iban|account|konto|cuenta|compte|bank|transfer|bic",
    "ip6": r"ip|ipv6|address|host|server|client|from",
    "birth_date": r"born|birth|birthday|dob|geboren|geburtsdatum|geb|nacid[oa]|nacimiento|n[ée]e?|naissance",
    "person": r"mr|mrs|ms|dr|prof|herr|frau|se[ñn]ora?|name|named|dear|signed|by|author|contact|hello|hi|nombre|nom|sincerely|regards",
    "address": r"address|lives? at|located at|ship to|street|adresse|anschrift|direcci[óo]n|domicilio|wohnt|residence|mail to",
}
UNLIKELY = r"version|isbn|issn|order|invoice|sku|part|figure|fig|section|chapter|page|build|release|serial|model|ref|doi|rfc|item|lot|code|pin|sum|total|table|clause|license|copyright"
UNITS = r"\s?(?:kg|g|km|cm|mm|m|lb|oz|%|€|\$|£|eur|usd|gbp|mb|gb|kb|ms|hz|pages?|items?|units?|pcs)(?!\w)"

PATTERNS = {
    "masked_email": re.compile(rf"{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{2,63}})+"),
    "local_phone": re.compile(r"(?<![\w+.,/-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,5}\)[ ]?|[0-9]{2,5}[ ./-])[0-9]{3,4}(?:[ .-][0-9]{3,4}|[0-9]{2,4})(?![\w-])"),
    "bare_card": re.compile(r"(?<![\w.+-])(?:[0-9]{14,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5})(?![\w-])"),
    "national_id": re.compile(r"(?<![\w-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{8}-?[A-HJ-NP-TV-Z]|[XYZ]-?[0-9]{7}-?[A-Z])(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)"),
    "ip6": re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?:::?[0-9A-Fa-f]{1,4}){2,7}(?:::)?(?![\w:])"),
    "birth_date": re.compile(r"(?<![\w./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![\w-])"),
    "person": re.compile(rf"(?<!\w)(?!(?:Dear|Hello|Hi|The|Der|Die|Das|El|La|Los|Las|Le|Les|Liebe|Lieber|Hola|Bonjour|Cher|Chère)(?!\w))(?:(?:{TITLES})\.?[ ])?{_CAP}(?:[ ]{_CAP}){{1,2}}|(?<!\w)(?:{TITLES})\.?[ ]{_CAP}"),
    "address": re.compile(
        rf"(?<![\w.,-])[0-9]{{1,5}}[ ](?:{_CAP}[ ]){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Way|Court|Ct|Square|Place)(?!\w)"
        rf"|(?<!\w)[A-ZÄÖÜ][a-zäöüß]{{1,30}}(?:straße|strasse|weg|platz|gasse|allee)[ ][0-9]{{1,4}}[a-z]?(?!\w)"
        rf"|(?<!\w)(?:Calle|Avenida|Plaza|Paseo)[ ](?:de[ ])?(?:la[ ]|el[ ]|los[ ])?{_CAP},?[ ][0-9]{{1,4}}(?!\w)"
        rf"|(?<![\w.,-])[0-9]{{1,4}},?[ ](?:rue|avenue|boulevard|place)[ ](?:de[ ])?(?:la[ ]|l')?{_CAP}"
    ),
}
_SUMS = frozenset(("bare_card", "national_id", "iban", "ip6"))  # kinds whose failing matches are dropped, as those of base rules are
_NEEDS_DIGIT = frozenset(ADDED) - {"masked_email", "person"}
_BEFORE = {k: re.compile(rf"(?<!\w)(?:{c})(?!\w)") for k, c in CUES.items()}
_UNLIKELY, _UNITS = re.compile(rf"(?<!\w)(?:{UNLIKELY})s?\.?(?:\s+(?:no|nr|number|id)\.?)?\s*[:#]?\s*\Z"), re.compile(UNITS)
_STRICT = {
    "masked_email": re.compile(r"[^\s]{1,64}\s?[\[({<].*[\[({<].*|\S+ (?:at|AT|arroba) \S+ (?:dot|DOT|punkt|punto|point) [a-z]{2,6}"),
    "bare_card": re.compile(r"[2-6][0-9]{3}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([ -]?)[0-9]{6}\2[0-9]{5}"),
    "local_phone": re.compile(r"(?:\+1[ .-]?)?\([2-9][0-9]{2}\) ?[2-9][0-9]{2}[ .-][0-9]{4}|(?:\+1[ .-]?)?[2-9][0-9]{2}([ .-])[2-9][0-9]{2}\1[0-9]{4}|0[0-9]{1,4}[ /-][0-9]{3,8}(?:[ .-][0-9]{2,4})*"),
    "national_id": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{8}-?[A-Z]|[XYZ]-?[0-9]{7}-?[A-Z]"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,3})?|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"),
    "ip6": re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=.*[A-Fa-f]).*::.*"),
    "birth_date": re.compile(r"(?!)"),  # any date has the form of one
    "person": re.compile(rf"(?:{TITLES})\.? .*"),
    "address": re.compile(r".*[0-9].*"),
}
_WORD = re.compile(r"[^\W_]+|[^\w\s]")


def _date(s: str) -> bool:
    a, b, c = (int(x) for x in re.split("[./-]", s))
    days = ((a, b, c),) if a > 31 else ((c, b, a), (c, a, b))
    for y, m, d in days:
        try:
            return 1900 <= datetime.date(y, m, d).year <= 2030
        except ValueError:
            continue
    return False


def _checked(kind: str, s: str) -> int:
    """Sums, ranges and calendars."""
    d = _digits(s)
    if kind == "iban":
        plain = s.replace(" ", "")
        return 1 if 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else -1
    if kind == "national_id":
        if s[-1].isdigit():
            return -1 if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000" else 1
        n = int({"X": "0", "Y": "1", "Z": "2"}.get(s[0], "") + d)
        return 1 if "TRWAGMYFPDXBNJZSQVHLCKE"[n % 23] == s[-1] else -1
    if kind == "ip6":
        try:
            return 1 if ipaddress.IPv6Address(s) else -1
        except ValueError:
            return -1
    if kind == "bare_card":
        return 1 if luhn(d) and len(set(d)) > 2 else -1
    if kind == "birth_date":
        return 0 if _date(s) else -1
    if kind == "local_phone":
        return -1 if len(set(d)) < 3 or not 7 <= len(d) <= 12 else 0
    return 0


def _listed(kind: str, s: str) -> int:
    """Gazetteers."""
    if kind == "person":
        names = [w for w in re.split(r"[ .]+", s) if w]
        if any(w.lower() in NOT_NAMES for w in names):
            return -1
        return 1 if any(w in GIVEN for w in names) else 0
    if kind == "masked_email":
        return 1 if re.split(r"[^A-Za-z]+", s.rstrip("])}> "))[-1].lower() in TLDS else -1
    if kind == "iban":
        return 1 if s[:2] in ("DE", "ES", "FR", "GB", "IT", "NL", "BE", "AT", "CH", "PT", "IE", "LU", "PL", "SE", "NO", "DK", "FI") else 0
    return 0


def votes(text: str, kind: str, s: int, e: int) -> list[int]:
    """The labelers' votes, 1, 0 or -1, in order: form, checks, gazetteer, cues before, cues after, touching characters."""
    span, before, after = text[s:e], text[max(0, s - 48) : s].lower(), text[e : e + 32].lower()
    strict = bool(_STRICT[kind].fullmatch(span))
    form = 1 if strict else (0 if kind in ("person", "address", "birth_date") else -1)
    cue = 1 if _BEFORE[kind].search(before) else (-1 if _UNLIKELY.search(before) else 0)
    behind = -1 if _UNITS.match(after) else (1 if kind in ("address", "person") and re.match(r",? [0-9]{5}(?![0-9])", after) else 0)
    touch = -1 if (s and text[s - 1] in "/\\_#=&?@$") or (e < len(text) and text[e] in "/\\_#=&@") else 0
    return [form, _checked(kind, span), _listed(kind, span), cue, behind, touch]


def encoded(v: list[int]) -> int:
    return sum((x + 1) * 3**i for i, x in enumerate(v))


def decoded(code: int) -> list[int]:
    return [code // 3**i % 3 - 1 for i in range(LABELERS)]


def _shape(s: str) -> str:
    kinds = "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in s[:64])
    return re.sub(r"([Aa])\1+", r"\1", kinds)


def vote_features(kind: str, v: list[int]) -> list[int]:
    """A kind's own feature and those of its votes; they have places of their own, before the hashed ones."""
    first = ADDED.index(kind) * (1 + 3 * LABELERS)
    return [first, *(first + 2 + 3 * i + x for i, x in enumerate(v))]


def features(text: str, kind: str, s: int, e: int, v: list[int]) -> list[int]:
    """Hashed features of a candidate: its votes, its shape and the words beside it."""
    before, after = _WORD.findall(text[max(0, s - 48) : s].lower())[-3:], _WORD.findall(text[e : e + 32].lower())[:2]
    named = ["shape" + _shape(text[s:e]), *(f"b{i}{w}" for i, w in enumerate(reversed(before))), *(f"near{w}" for w in before), *(f"a{i}{w}" for i, w in enumerate(after))]
    return vote_features(kind, v) + [OWN + zlib.crc32(f"{kind}|{n}".encode()) % WIDTH for n in named]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the wide patterns, where no base span is touched."""
    starts, reach = [s for s, _, _ in base], list(accumulate((e for *_, e in base), max))
    digit = _DIGIT.search(text)
    out = []
    for k, kind in enumerate(ADDED, len(BASE)):
        if kind in _NEEDS_DIGIT and not digit:
            continue
        done = 0
        for m in PATTERNS[kind].finditer(text):
            s, e = m.span()
            if kind == "masked_email":  # the name before the mark
                while s > done and s > m.start() - 64 and text[s - 1] in _LOCAL_CHARS:
                    s -= 1
                if s == m.start():
                    continue
            done = e
            if kind in _SUMS and _checked(kind, m[0]) < 0:
                continue
            at = bisect_left(starts, e)
            if not (at and reach[at - 1] > s):
                out.append((k, s, e))
    return out


class Labels:
    """What expectation-maximisation learns from the counts of vote patterns: for each kind the share of personal data, and P(vote | class)."""

    #: Votes (no, abstain, yes) of a labeler by class, as far as is known before: better than chance; checks hardly ever fail on true data, and what names another
    #: thing hardly ever stands before them. They start the estimation and count as PRIOR_COUNT candidates in it, so that counts soon outweigh them.
    VOTES = np.repeat([[[0.37, 0.54, 0.09]], [[0.04, 0.52, 0.44]]], LABELERS, axis=1)
    VOTES[1, 1] = 0.01, 0.51, 0.48
    VOTES[:, 3] = [0.4, 0.54, 0.06], [0.02, 0.51, 0.47]
    SHARE, PRIOR_COUNT = {"person": 0.05, "birth_date": 0.2, "local_phone": 0.4}, 2.0

    def __init__(self, counts: list[tuple[int, int, int]], rounds: int = 30) -> None:
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for kind in range(len(BASE), len(KINDS)):
            mine = [(v, n) for k, v, n in counts if k == kind]
            first = self.SHARE.get(KINDS[kind], 0.25)
            share, table_ = before, _ = np.array([1 - first, first]), self.VOTES
            v = np.array([decoded(c) for c, _ in mine], np.int64).reshape(-1, LABELERS) + 1
            n = np.array([x for _, x in mine], np.float64)
            for _ in range(rounds if mine else 0):
                p = self._posterior(v, share, table_)
                w = np.stack([1 - p, p]) * n
                share = w.sum(axis=1) + self.PRIOR_COUNT * before
                share /= share.sum()
                table_ = np.stack([[self.PRIOR_COUNT * self.VOTES[y, i] + np.bincount(v[:, i], w[y], 3) for i in range(LABELERS)] for y in (0, 1)])
                table_ /= table_.sum(axis=2, keepdims=True)
            self.known[kind] = share, table_

    @staticmethod
    def _posterior(v: np.ndarray, share: np.ndarray, table_: np.ndarray) -> np.ndarray:
        log = np.log(share)[:, None] + np.log(table_[:, np.arange(LABELERS), v]).sum(axis=2)
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))

    def posterior(self, kind: int, code: int) -> float:
        return float(self._posterior(np.array([decoded(code)]) + 1, *self.known[kind])[0])

    def patterns(self, kind: int) -> list[tuple[int, float, float]]:
        """(code, probability, posterior) of every pattern that the labelers could show."""
        share, t = self.known[kind]
        v = np.array([decoded(c) for c in range(3**LABELERS)]) + 1
        chance = (share[:, None] * t[:, np.arange(LABELERS), v].prod(axis=2)).sum(axis=0)
        return list(zip(range(3**LABELERS), chance.tolist(), self._posterior(v, share, t).tolist()))

    def reliability(self, kind: int) -> list[float]:
        """For each labeler, how often its vote, where it votes, is right."""
        share, t = self.known[kind]
        right, wrong = share[0] * t[0, :, 0] + share[1] * t[1, :, 2], share[0] * t[0, :, 2] + share[1] * t[1, :, 0]
        return (right / (right + wrong)).tolist()


def fit_classifier(features_: list[list[int]], targets: list[float], weight: list[float], rounds: int = 300, rate: float = 0.5, ridge: float = 1e-5) -> np.ndarray:
    """Weights of a logistic regression with probabilities as targets, by full gradient steps with step sizes of their own (AdaGrad)."""
    w, seen = np.zeros(OWN + WIDTH), np.full(OWN + WIDTH, 1e-8)
    sizes = np.array([len(f) for f in features_])
    flat, of, y, n = np.concatenate(features_).astype(np.int64), np.repeat(np.arange(sizes.size), sizes), np.array(targets), np.array(weight)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.bincount(of, w[flat], sizes.size)))
        g = np.bincount(flat, ((p - y) * n)[of], w.size) / n.sum() + ridge * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


FOUND = "doc_id long, b_kind array<int>, b_start array<int>, b_end array<int>, c_kind array<int>, c_start array<int>, c_end array<int>, c_votes array<int>, c_features array<array<int>>"


def _find(batches):
    for b in slices(batches, 1):
        base_cols, cand_cols = ([[] for _ in range(3)] for _ in range(2))
        all_votes, all_features = [], []
        for text in b.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            some = candidates(text, base)
            v = [votes(text, KINDS[k], s, e) for k, s, e in some]
            for col, i in zip(base_cols, (1, 0, 2)):
                col.append([x[i] for x in base])
            for col, i in zip(cand_cols, (0, 1, 2)):
                col.append([x[i] for x in some])
            all_votes.append([encoded(x) for x in v])
            all_features.append([features(text, KINDS[k], s, e, x) for (k, s, e), x in zip(some, v)])
        ints = pa.list_(pa.int32())
        cols = [pa.array(c, ints) for c in (*base_cols, *cand_cols, all_votes)] + [pa.array(all_features, pa.list_(ints))]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[c.split()[0] for c in FOUND.split(", ")])


def find(docs: DataFrame) -> DataFrame:
    """Base spans and candidates of every row, with votes and features; written."""
    return materialize(map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _find, FOUND), "candidates")


def train(found: DataFrame, sample: int = SAMPLE) -> tuple[Labels, np.ndarray]:
    """Reliabilities from the votes of all candidates, and the classifier from at most `sample` candidates of each kind."""
    each = found.select("doc_id", F.explode(F.arrays_zip("c_kind", "c_start", "c_votes", "c_features")).alias("c")).select("doc_id", "c.*")
    counts = sorted(tuple(r) for r in each.groupBy("c_kind", "c_votes").count().collect())  # at most 3 ** LABELERS for each kind
    labels = Labels(counts)
    mixed = F.xxhash64("doc_id", "c_start", "c_kind", "c_features")
    bucket = each.select("c_kind", "c_votes", "c_features", mixed.alias("h")).groupBy("c_kind", F.pmod("h", F.lit(sample)).alias("b"))
    rows = bucket.agg(F.min(F.struct("h", "c_votes", "c_features")).alias("c")).select("c_kind", "c.h", "c.c_votes", "c.c_features").collect()  # at most sample * len(ADDED)
    rows = sorted(rows, key=lambda r: (r.c_kind, r.h))
    examples = [(r.c_features, labels.posterior(r.c_kind, r.c_votes), 1.0) for r in rows]
    for k in range(len(BASE), len(KINDS)):  # the labelers' patterns, seen or not, without a text
        examples += [(vote_features(KINDS[k], decoded(code)), p, PATTERN_WEIGHT * chance) for code, chance, p in labels.patterns(k)]
    return labels, fit_classifier(*zip(*examples))


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def added_spans(kinds, starts, ends, feats, weights: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the candidates that the classifier takes, none overlapping another."""
    cut = math.log(threshold / (1 - threshold))
    scored = sorted((-float(weights[f].sum()), s, e, k) for k, s, e, f in zip(kinds, starts, ends, feats))
    taken: list[tuple[int, int]] = []
    out = []
    for score, s, e, k in scored:
        if -score <= cut:
            break
        at = bisect_left(taken, (s, e))
        if (at == 0 or taken[at - 1][1] <= s) and (at == len(taken) or taken[at][0] >= e):
            taken.insert(at, (s, e))
            out.append((s, k, e))
    return out


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def scan(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Counts and spans of the personal data of every row."""
    found = find(docs)
    _, weights = train(found, sample)

    def work(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            doc, *lists = (b.column(i).to_pylist() for i in range(9))
            for bk, bs, be, ck, cs, ce, _, cf in zip(*lists):
                base = list(zip(bs, bk, be))
                every = sorted(base + added_spans(ck, cs, ce, cf, weights, threshold))
                for col, x in zip(cols, (*(bk.count(i) for i in range(4)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every))):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(cols)]], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return map_rows(found, work, SCHEMA)


def op13_personal_data(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
