"""Text as column expressions: folding for comparison, lists, keys, HTML, tokens."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(1)
def _accents() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Latin letters that decompose to one ASCII letter, that letter, and those that decompose to several."""
    one, to, several = [], [], []
    for point in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        char = chr(point)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if plain != char and plain.isascii() and len(plain) == 1:
            one.append(char)
            to.append(plain)
        elif plain != char and len(plain) > 1 and plain.isalpha():
            several.append((char, plain))
    return "".join(one), "".join(to), tuple(several)


def strip_accents(col: Column) -> Column:
    """Compatibility decomposition of Latin text without its combining marks."""
    one, to, several = _accents()
    out = F.translate(col, one, to)
    long = out
    for char, plain in several:
        long = F.replace(long, F.lit(char), F.lit(plain))
    # most texts are ASCII, and of the others few have a letter that stands for several
    out = F.when(out.rlike(f"[{''.join(c for c, _ in several)}]"), long).otherwise(out)
    return F.when(col.rlike(r"[^\x00-\x7F]"), F.regexp_replace(out, r"\p{M}+", "")).otherwise(col)


def collapse(col: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def fold(col: Column) -> Column:
    """The form in which values are compared: no accents, upper case, single spaces. Null is the empty text."""
    return collapse(F.upper(strip_accents(F.coalesce(col.cast("string"), F.lit("")))))


def fold_lower(col: Column) -> Column:
    """As ``fold``, in lower case. Most texts are printable ASCII with single spaces, in which only the case is folded."""
    given = F.coalesce(col.cast("string"), F.lit(""))
    plain = ~given.rlike("[^ -~]") & ~F.contains(given, F.lit("  "))
    return F.when(plain, F.trim(F.lower(given))).otherwise(collapse(F.lower(strip_accents(given))))


def folded_lower(text: str) -> str:
    """``fold_lower`` of a text at hand, by the same letters."""
    one, to, several = _accents()
    table = {ord(a): b for a, b in [*zip(one, to, strict=True), *several]}
    plain = "".join(c for c in text.translate(table) if not unicodedata.category(c).startswith("M"))
    return " ".join(plain.lower().split())


def digits(col: Column) -> Column:
    """The ASCII digits of a text, as a phone key."""
    return F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), "[^0-9]", "")


def last_digits(col: Column, n: int = 4) -> Column:
    return F.right(digits(col), F.lit(n))


#: What counts as yes.
YES = ("1", "si", "sí", "true", "yes", "x")


def is_yes(col: Column, blank: bool = False) -> Column:
    """Whether a cell says yes; ``blank`` is what an empty one says."""
    text = F.lower(F.trim(F.coalesce(col.cast("string"), F.lit(""))))
    return F.when(text == "", F.lit(blank)).otherwise(text.isin(*YES))


def is_blank(col: Column) -> Column:
    return F.trim(F.coalesce(col.cast("string"), F.lit(""))) == ""


def items(col: Column, separators: str = ",;") -> Column:
    """The distinct non-empty entries of a list cell, in order."""
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), f"[{separators}]"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def tokens(col: Column, least: int = 4, without: tuple[str, ...] = ()) -> Column:
    """Distinct folded words of at least ``least`` letters, digits or underscores that are no stop words."""
    found = F.array_distinct(F.regexp_extract_all(fold_lower(col), F.lit(f"([a-z0-9_]{{{least},}})"), F.lit(1)))
    return F.array_except(found, F.array(*map(F.lit, without))) if without else found


def html_to_text(col: Column) -> Column:
    """Scripts, styles and tags out, common entities read, white space collapsed."""
    out = F.regexp_replace(col, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r\f]+", " "))


def like_folded(col: Column, pattern: Column) -> Column:
    """SQL LIKE over folded texts, in which a backslash is an ordinary character."""
    return F.like(fold(col), F.replace(fold(pattern), F.lit("\\"), F.lit("\\\\")))


def clip(col: Column, most: int) -> Column:
    """At most ``most`` characters, the last an ellipsis if something was cut."""
    return F.when(F.length(col) > most, F.concat(F.rtrim(F.substring(col, 1, most - 1)), F.lit("…"))).otherwise(col)


def mask_secrets(col: Column) -> Column:
    """Connection strings without user and password."""
    return F.regexp_replace(col, "//[^:/@]+:[^@]+@", "//***:***@")
