"""Column functions on text: folding, normalising, codes, slugs, markers and snippets."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Glyphs that a broken font map extracts wrongly, and what they stand for.
BROKEN_GLYPHS = {"೦": "°", "Ф": "Φ"}

# Fixed value: lines that are page furniture (date, publisher, site, page counter).
FURNITURE = r"^[ \t]*(?:\d{1,2}/\d{1,2}/\d{4}|SENER|www\.dof\.gob\.mx\S*|\d+/780)[ \t]*$"

# Fixed value: a bare number in a cell. Cells are split at white space, so no look-around is needed.
ATOM = r"^[-+]?[0-9][0-9.,]*$"


@lru_cache
def _folding() -> tuple[str, str]:
    """Letters with diacritics from U+00C0 to U+024F that decompose, and their base letters."""
    pairs = []
    for c in map(chr, range(0xC0, 0x250)):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def unaccent(col: Column) -> Column:
    """Drop diacritics, keep the case. Plain ASCII has none and passes as it is."""
    folded = F.translate(F.regexp_replace(col, r"\p{Mn}", ""), *_folding())
    return F.when(F.octet_length(col) == F.char_length(col), col).otherwise(folded)


def fix_glyphs(col: Column) -> Column:
    return F.translate(col, "".join(BROKEN_GLYPHS), "".join(BROKEN_GLYPHS.values()))


def is_furniture(col: Column) -> Column:
    return F.rlike(col, F.lit(FURNITURE))


def collapse(col: Column) -> Column:
    """White space runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(col, r"[ \t\n\x0b\f\r]+", " "))


def truncate(col: Column, size: int) -> Column:
    """At most size characters; a longer text ends in an ellipsis within them."""
    return F.when(F.char_length(col) > size, F.concat(F.rtrim(F.substring(col, 1, size - 1)), F.lit("…"))).otherwise(col)


def norm_code(col: Column) -> Column:
    """A code without separators: folded, lower case, letters and digits only."""
    return F.regexp_replace(F.lower(unaccent(col)), "[^a-z0-9]", "")


def looks_like_code(code: Column) -> Column:
    """Four characters at least, four of them digits."""
    return (F.char_length(code) >= 4) & (F.char_length(F.regexp_replace(code, "[^0-9]", "")) >= 4)


def term_slug(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(unaccent(col)), "[^a-z0-9]+", "-"), "^-|-$", "")


def table_slug(col: Column) -> Column:
    return F.concat(F.lit("tabla-"), F.regexp_replace(F.regexp_replace(col, "[^A-Za-z0-9_-]+", "-"), "-+$", ""))


def escape_html(col: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def canonical_id(parent: Column, kind: Column, label: Column) -> Column:
    """The parent's id and the marker: letters with a dot as `a.`, all others in parentheses."""
    return F.when(kind == "letter", F.concat(parent, label, F.lit("."))).otherwise(F.concat(parent, F.lit("("), label, F.lit(")")))


def marker_rank(kind: Column, label: Column) -> Column:
    return F.when(kind.isin("num", "paren"), label.try_cast("int")).otherwise(F.ascii(label))


def tokens(col: Column) -> Column:
    """Folded lower-case words."""
    return F.regexp_extract_all(F.lower(unaccent(col)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def tallied(words: Column) -> Column:
    """The distinct words of an array, each with how often it is there (term, tf), in order. Counted inside the row, so nothing is shuffled."""
    once = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  x is evaluated once, not for every element
    ends = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: ~F.element_at(s, i).eqNullSafe(F.get(s, i)))
    runs = lambda s: once(ends(s), lambda e: F.transform(e, lambda at, j: F.struct(F.element_at(s, at).alias("term"), (at - F.coalesce(F.get(e, j - 1), F.lit(0))).cast("long").alias("tf"))))
    return F.when(F.size(words) > 0, once(F.sort_array(words), runs))


def grouped_number(col: Column) -> Column:
    return F.format_number(col, 0)


def percent(col: Column, digits: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", col * 100), F.lit("%"))


def result_url(kind: Column, id_: Column, tid: Column, article: Column, base: str = "") -> Column:
    """Where a search result leads: glossary anchor, table anchor in its article or in the table list, section anchor."""
    slug = table_slug(tid)
    return (
        F.when(kind == "def", F.concat(F.lit(f"{base}/glosario/#"), term_slug(id_)))
        .when((kind == "tabla") & article.isNotNull(), F.concat(F.lit(f"{base}/art/"), article.cast("string"), F.lit("#"), slug))
        .when(kind == "tabla", F.concat(F.lit(f"{base}/tablas#"), slug))
        .otherwise(F.concat(F.lit(f"{base}/art/"), article.cast("string"), F.lit("#"), id_))
    )


def issue_url(repository: str, title: Column, body: Column) -> Column:
    """A prefilled issue form."""
    return F.concat(F.lit(f"{repository}/issues/new?title="), F.url_encode(title), F.lit("&body="), F.url_encode(body))


# The letters that a pattern letter also matches.
ACCENT_CLASSES = {"a": "aàáâã", "e": "eèéêë", "i": "iìíîï", "o": "oòóôõ", "u": "uùúûü", "n": "nñ"}


def accent_pattern(word: str) -> str:
    """A regular expression for the word with any accents, in either case."""
    out = []
    for c in word:
        wide = ACCENT_CLASSES.get(c.lower())
        out.append(f"[{wide}{wide.upper()}]" if wide else c if c.isalnum() else "\\" + c)
    return "".join(out)


def snippet(text: Column, query: str, before: int = 40, after: int = 90) -> Column:
    """The first match of the whole phrase, else of any word of two characters or more, marked in its context; empty if there is none."""
    words = query.split()
    single = [w for w in words if len(w) > 1]
    if not single:
        return F.lit("")
    one = "(?i)" + "|".join(accent_pattern(w) for w in single)
    phrase = "(?i)" + r"\s+".join(accent_pattern(w) for w in words) if len(words) > 1 else one

    def cut(pattern: str) -> Column:
        at = F.regexp_instr(text, F.lit(f"({pattern})"))
        found = F.regexp_extract(text, f"({pattern})", 1)
        start = F.greatest(F.lit(1), at - before)
        end = F.least(F.char_length(text), at - 1 + F.char_length(found) + after)
        marked = F.regexp_replace(escape_html(F.substring(text, start, end - start + 1)), f"({pattern})", "<mark>$1</mark>")
        return F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), marked, F.when(end < F.char_length(text), F.lit("…")).otherwise(F.lit("")))

    return F.coalesce(F.when(F.rlike(text, F.lit(phrase)), cut(phrase)).when(F.rlike(text, F.lit(one)), cut(one)), F.lit(""))
