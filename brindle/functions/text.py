"""Text and URL columns: keys, sites, hashes, extraction. Every function maps Columns to a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that count as missing after trimming, lower-casing and collapsing space (fixed values).
MISSING = (
    "", "-", "--", "—", "–", "_", "?", "n/a", "na", "n.a.", "nan", "null", "none", "nil", "not found", "not available",
    "unknown", "tbd", "tba", "not disclosed", "undisclosed", "#n/a", "nd",
)
_SPACES = r"(?U)\s+"


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body``, so long expressions stay linear in size."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse(c: Column) -> Column:
    """Trims and turns each run of white space (Unicode) into one space."""
    return F.trim(F.regexp_replace(c, _SPACES, " "))


def group_key(c: Column) -> Column:
    """The key that groups a cell, null where the cell is missing."""
    key = F.lower(collapse(c))
    return F.when(~key.isin(*MISSING), key)


def is_missing(c: Column) -> Column:
    return F.coalesce(F.lower(collapse(c)).isin(*MISSING), F.lit(True))


def is_url(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(r"(?i)^(https?://|www\.)\S+$"), F.lit(False))


def site_of(c: Column) -> Column:
    """Host without scheme and ``www.``, lower-cased; the lower-cased input where there is none."""
    host = F.regexp_extract(F.trim(c), r"(?i)^(?:[a-z][a-z0-9+.-]*://)?(?:www\.)?([^/?#:\s]+)", 1)
    return F.lower(F.when(host == "", F.trim(c)).otherwise(host))


def plain_name(c: Column) -> Column:
    """Lower case, letters, digits and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), _SPACES, " "), r"[^a-z0-9 ]", ""))


def row_hash(*cells: Column) -> Column:
    """12 hex digits over the normalised cells of a row; link columns are left to the caller to leave out."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(F.lower(collapse(c)), F.lit("")) for c in cells])), 1, 12)


def record_id(host: Column, names: list[Column], cells: list[Column]) -> Column:
    """Host and the first name that has text, else a digest of the record's cells; cut at 220 characters."""
    digest = F.substring(F.md5(F.concat_ws("|", host, *[F.coalesce(c, F.lit("")) for c in cells])), 1, 16)
    named = F.coalesce(*[F.when(F.trim(p) != "", F.trim(p)) for p in names], digest)
    return F.substring(F.concat_ws("|", host, named), 1, 220)


def clauses(c: Column, most: int = 5) -> Column:
    """Sections that a text cites, in order, each once."""
    return F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(r"[Ss]ection\s+\d+[A-Za-z]*"), F.lit(0))), 1, most)


def first_tag(c: Column, tags: list[tuple[tuple[str, ...], str]], otherwise: str) -> Column:
    """The tag of the first group of words of which the text contains one."""
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit(otherwise)
    for words, tag in reversed(tags):
        out = F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)), F.lit(tag)).otherwise(out)
    return out


def all_tags(c: Column, tags: list[tuple[str, str]], most: int = 6) -> Column:
    """Tags of all words that the text contains, each once, at most ``most``."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.slice(F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(t)) for w, t in tags]))), 1, most)


def jaccard(a: Column, b: Column) -> Column:
    """Share of words in common of two texts; 0 where neither has words."""
    words = lambda c: F.array_remove(F.array_distinct(F.split(plain_name(c), " ")), "")
    union = F.size(F.array_union(words(a), words(b)))
    return F.when(union > 0, F.size(F.array_intersect(words(a), words(b))) / union).otherwise(F.lit(0.0))


def similar_cells(a: Column, b: Column) -> Column:
    """Equal, one inside the other without spaces, or half of the words in common."""
    x, y = plain_name(a), plain_name(b)
    p, q = F.replace(x, F.lit(" "), F.lit("")), F.replace(y, F.lit(" "), F.lit(""))
    inside = (p != "") & (q != "") & (F.contains(p, q) | F.contains(q, p))
    return F.coalesce((x == y) | inside | (jaccard(a, b) >= 0.5), F.lit(False))


def strip_html(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags removed, space collapsed."""
    text = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return collapse(text)


def needs_script(html: Column) -> Column:
    """A large page with hardly any text: it is drawn by its scripts."""
    n = F.char_length(strip_html(html))
    return (F.char_length(html) >= 5000) & (n < 4000) & (n < 0.02 * F.char_length(html))


def emails(c: Column) -> Column:
    """Distinct addresses, ``[at]`` and ``(dot)`` spellings read too, lower-cased and sorted."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), r"\s*[\[(]\s*at\s*[\])]\s*", "@"), r"\s*[\[(]\s*dot\s*[\])]\s*", ".")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(plain, F.lit(r"[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}"), F.lit(0))))


def without_indic(c: Column) -> Column:
    """Drops characters of the Indic script blocks (U+0900 to U+0DFF)."""
    return F.regexp_replace(c, "[ऀ-෿]", "")


def tagged(c: Column, words: list[str], most: int = 12) -> Column:
    """The words of a gazetteer that occur in the text as whole words, first ones first, at most ``most``."""
    hits = F.array(*[F.when(F.lower(c).rlike(rf"(?<![\p{{L}}\p{{N}}_]){w}(?![\p{{L}}\p{{N}}_])"), F.lit(w)) for w in words])
    return F.slice(F.array_distinct(F.array_compact(hits)), 1, most)


def guarded(c: Column) -> Column:
    """A text cell that spreadsheets won't run as a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def keyword_score(c: Column, weights: dict[str, int]) -> Column:
    """Sum of the weights of the keywords that the text contains."""
    low = F.lower(F.coalesce(c, F.lit("")))
    total = F.lit(0)
    for word, weight in weights.items():
        total = total + F.when(F.contains(low, F.lit(word)), weight).otherwise(0)
    return total


def tier(score: Column, steps=((9, "critical"), (6, "high"), (3, "medium"))) -> Column:
    out = F.lit("low")
    for least, name in sorted(steps):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out
