"""Spelling variants by a symmetric-delete join.

Every word emits itself and its distinct single deletions, each under a 64-bit key; words that share a key meet. Deletions are emitted without
their texts: the polynomial hash of a word without its i-th code point comes from prefix sums, so a word of any length takes time and
rows in proportion to it. Where words have met, their texts are joined back and compared, so that a shared hash alone links nothing.

Distance one is decided exactly and without pairs. Two words of one length are near if they give the same deletion at the same position;
two words whose lengths differ by one, if one is a deletion of the other. A deletion inside a run of one letter stands for all
positions of the run. Hence all words of a group (deletion, position) are near each other, and in a group (deletion) each is near the word that
equals it: counts and the best partner of each member are windows over the group. A group is bounded by the alphabet times the length of the
deletion, however often the words occur; counting occurrences combines on the map side.

Words have numbers in code-point order, given when the vocabulary is written by range, so ties by word are ties by number. Forms are at least
`ratio` times as frequent as the word, so chains are short; roots are found by pointer doubling over written tables.

Edge cases: null and empty texts have no words; a null doc_id counts as the empty string in the hash that picks deletions; rows that repeat or share
a doc_id each count; equal counts go to the smaller word in code-point order; words of any length are whole. Only doc_id and text are read,
so other columns can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import map_rows, slices
from .common import lower_ascii, materialize, table

RUN = "[A-Za-z\\x{C0}-\\x{FF}]+"
MIN_CHARS, MIN_COUNT, RATIO, TYPO = 7, 2, 10, 31
_SLICE = 1_000_000
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def _without(word: Column, at: Column) -> Column:
    """The word without its code point `at`, from 0."""
    return F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, typo: int = TYPO) -> DataFrame:
    """(wid, word, n): the words of all texts, numbered in code-point order. One run in `typo` loses a code point."""
    runs = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(lower_ascii(docs["text"]), F.lit(RUN), F.lit(0))).alias("run"))
    size = F.char_length("run")
    h = F.crc32(F.concat("d", F.lit(":"), "run"))
    hashed = runs.where(size >= min_chars).select("run", h.alias("h"), size.alias("size"))
    word = F.when(F.col("h") % typo == 0, _without(F.col("run"), (F.col("h") % F.col("size")).cast("int"))).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    ordered = counted.repartitionByRange("word").sortWithinPartitions("word")
    return materialize(ordered.select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "vocabulary")


def deletions(words: list[str]) -> tuple[np.ndarray, ...]:
    """(place of the word, key, lo, hi) of every word itself, lo and hi -1, and of its distinct single deletions, each with the positions that give it."""
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    powers = np.ones((2, codes.size + 2), np.uint64)
    powers[:, 1:] = np.array([[_MULTIPLIER], [_INVERSE]], np.uint64)
    np.multiply.accumulate(powers, axis=1, out=powers)
    up, down = powers
    mixed = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    sums = np.append(np.uint64(0), np.cumsum(mixed * up[: codes.size], dtype=np.uint64))
    own = np.arange(sizes.size)
    itself = (sums[ends] - sums[starts]) * down[starts]
    fresh = np.ones(codes.size, bool)
    fresh[1:] = codes[1:] != codes[:-1]
    fresh[starts[sizes > 0]] = True
    lo = np.flatnonzero(fresh)
    hi = np.append(lo[1:], codes.size) - 1
    of = np.repeat(own, sizes)[lo]
    s, e = starts[of], ends[of]
    cut = (sums[lo] - sums[s]) * down[s] + (sums[e] - sums[lo + 1]) * down[s + 1]
    none = np.full(sizes.size, -1)
    parts = ((own, of), (itself, cut), (none, lo - s), (none, hi - s))
    place, key, lo, hi = (np.concatenate(p) for p in parts)
    return place, key.view(np.int64), lo.astype(np.int32), hi.astype(np.int32)


def _emit(batches):
    for b in slices(batches, 1, _SLICE):
        place, key, lo, hi = deletions(b.column(1).to_pylist())
        wid, n = b.column(0).to_numpy()[place], b.column(2).to_numpy()[place]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, wid, n, lo, hi)], names=["key", "wid", "n", "lo", "hi"])


def near_words(words: DataFrame) -> DataFrame:
    """(wid, n_near, best): for each word with near words, their number and the (n, -wid) of the most frequent."""
    emitted = map_rows(words.select("wid", "word", "n"), _emit, "key long, wid long, n long, lo int, hi int")
    met = emitted.withColumn("met", F.count("*").over(Window.partitionBy("key"))).where("met > 1").drop("met")
    texts = words.select(F.col("wid").alias("t_wid"), "word")
    joined = met.join(texts, F.col("wid") == F.col("t_wid"))
    shared = F.when(F.col("lo") < 0, F.col("word")).otherwise(_without(F.col("word"), F.col("lo")))
    exact = joined.select("key", "wid", "n", "lo", "hi", shared.alias("shared"))
    # the texts decide which of the words under a key share a deletion; from here on their number stands for the text
    exact = exact.withColumn("g", F.dense_rank().over(Window.partitionBy("key").orderBy("shared"))).drop("shared")
    places = F.when(F.col("lo") < 0, F.array(F.lit(-1))).otherwise(F.concat(F.array(F.lit(-1)), F.sequence("lo", "hi")))
    members = exact.select("key", "g", "wid", F.struct("n", (-F.col("wid")).alias("low")).alias("me"), (F.col("lo") < 0).alias("whole"), F.explode(places).alias("p"))
    group = Window.partitionBy("key", "g", "p")
    ranked = members.withColumn("rank", F.row_number().over(group.orderBy(F.col("me").desc())))
    seen = ranked.select(
        "wid",
        "me",
        "whole",
        "p",
        F.count("*").over(group).alias("size"),
        F.max(F.when(F.col("rank") == 1, F.col("me"))).over(group).alias("first"),
        F.max(F.when(F.col("rank") == 2, F.col("me"))).over(group).alias("second"),
        F.max(F.when(F.col("whole"), F.col("me"))).over(group).alias("center"),
    ).where("size > 1")
    other = F.when(F.col("first") == F.col("me"), F.col("second")).otherwise(F.col("first"))
    each = (F.col("p") >= 0) | F.col("whole")  # near all the others; else near the center alone
    found = seen.where(each | F.col("center").isNotNull()).select("wid", F.when(each, F.col("size") - 1).otherwise(F.lit(1)).alias("near"), F.when(each, other).otherwise(F.col("center")).alias("best"))
    return found.groupBy("wid").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(wid, root): the last word that following (wid, form) leads to."""
    found = forms.select("wid", F.col("form").alias("root"))
    while True:
        ahead = found.select(F.col("wid").alias("a_wid"), F.col("root").alias("a_root"))
        found = materialize(found.join(ahead, F.col("root") == F.col("a_wid"), "left").select("wid", F.coalesce("a_root", "root").alias("root"), F.col("a_root").isNotNull().alias("moved")), "roots")
        if found.where("moved").isEmpty():
            return found.select("wid", "root")
        found = found.drop("moved")


def spelling_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a written vocabulary (wid, word, n)."""
    if ratio <= 1:
        raise ValueError("forms must be more frequent than their words, or following them may never end")
    near = near_words(words).withColumnRenamed("wid", "n_wid")
    joined = words.join(near, F.col("wid") == F.col("n_wid"), "left")
    has = F.col("best.n") >= ratio * F.col("n")
    counted = materialize(joined.select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, -F.col("best.low")).alias("form"), F.when(has, F.col("best.n")).alias("form_n")), "near")
    forms = counted.where("form IS NOT NULL").select("wid", "form")
    text = lambda name: words.select(F.col("wid").alias(f"{name}_wid"), F.col("word").alias(f"{name}_word"))
    named = forms.join(roots(forms).withColumnRenamed("wid", "r_wid"), F.col("wid") == F.col("r_wid"))
    named = named.join(text("form"), F.col("form") == F.col("form_wid")).join(text("root"), F.col("root") == F.col("root_wid")).select(F.col("wid").alias("f_wid"), "form_word", "root_word")
    out = counted.join(named, F.col("wid") == F.col("f_wid"), "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_groups(vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text")))


ORACLE = {
    "op11_spelling_variants": """
WITH RECURSIVE bytes AS (SELECT range AS b, range::BIGINT AS c, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bytes WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bytes WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z' || chr(192) || '-' || chr(255) || ']+')) AS run
  FROM documents),
raw AS (SELECT run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs WHERE length(run) >= 7),
hashed AS (
  SELECT run, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) AS h
  FROM raw, crc),
made AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word
  FROM hashed),
v AS (SELECT word, count(*) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
e AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM e a JOIN e b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT e.word, v.word, v.n FROM e JOIN v ON e.rest = v.word
  UNION SELECT v.word, e.word, e.n FROM e JOIN v ON e.rest = v.word),
near AS (SELECT word, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY word),
best AS (SELECT word, min(other) AS form, any_value(n_near) AS n_near, m FROM pairs JOIN near USING (word, m) GROUP BY word, m),
f AS (SELECT v.word, CASE WHEN m >= 10 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN m END AS form_n
  FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, form AS step, 1 AS k FROM f WHERE form IS NOT NULL
  UNION ALL SELECT chain.word, f.form, k + 1 FROM chain JOIN f ON chain.step = f.word WHERE f.form IS NOT NULL),
last AS (SELECT word, arg_max(step, k) AS root FROM chain GROUP BY word)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN last ON f.word = last.word
"""
}
