"""Numbers from text and text from numbers, by the conventions of Spanish-language sheets and mails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"
#: Currency signs and their codes.
SIGNS = {"$": "USD", "₡": "CRC", "€": "EUR"}
#: Fixed value: a code or sign, the number, a code or sign.
AMOUNT = r"([A-Z]{3}|[$₡€])?\s*(-?[0-9.,]+)\s*([A-Z]{3}|[$₡€])?"

#: What stands beside a number in a cell without being part of it, as of a class of a regex.
DRESS = r"\s ₡$€%"


def bound(col: Column, of: Callable[[Column], Column]) -> Column:
    """``of(col)`` with ``col`` computed once, however often ``of`` names it."""
    return F.get(F.transform(F.array(col), of), F.lit(0))


def _count(col: Column, char: str) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(char), F.lit("")))


def _after_last(col: Column, char: str) -> Column:
    """How many characters follow the last ``char``."""
    return F.instr(F.reverse(col), char) - 1


def _as_double(col: Column) -> Column:
    """A cast that takes plain decimals only: no exponents, suffixes or names of values."""
    return F.when(col.rlike(NUMBER), col.cast("double"))


def parse_number(col: Column) -> Column:
    """The number a text writes, whichever of point and comma it uses.

    Of two kinds of separator the last is the decimal one. One kind alone marks thousands if it occurs more than
    once or exactly three digits follow it (so 0.125 reads as 125), else decimals.
    """
    return bound(F.regexp_replace(col.cast("string"), "[^0-9.,-]", ""), _of_either)


def _of_either(text: Column) -> Column:
    dots, commas = _count(text, "."), _count(text, ",")
    no_dots, no_commas = F.replace(text, F.lit("."), F.lit("")), F.replace(text, F.lit(","), F.lit(""))
    both = F.when(_after_last(text, ".") < _after_last(text, ","), no_commas).otherwise(F.replace(no_dots, F.lit(","), F.lit(".")))
    dot = F.when((dots > 1) | (_after_last(text, ".") == 3), no_dots).otherwise(text)
    comma = F.when((commas > 1) | (_after_last(text, ",") == 3), no_commas).otherwise(F.replace(text, F.lit(","), F.lit(".")))
    return _as_double(F.when((dots > 0) & (commas > 0), both).when(dots > 0, dot).when(commas > 0, comma).otherwise(text))


def parse_integer(col: Column) -> Column:
    """A whole number without passing through a double; with separators, ``parse_number`` rounded half to even."""
    text = F.trim(col.cast("string"))
    exact = F.regexp_replace(text, "[^0-9-]", "").try_cast("bigint")
    return F.when(text.rlike("[.,]"), F.bround(parse_number(text)).try_cast("bigint")).otherwise(exact)


def parse_amount(col: Column) -> Column:
    """struct(currency, amount) of the first amount in a text."""
    text = F.trim(F.coalesce(col.cast("string"), F.lit("")))
    return bound(F.struct(*(F.regexp_extract(text, AMOUNT, g).alias(f"g{g}") for g in (1, 2, 3))), _money)


def _money(groups: Column) -> Column:
    sign = F.coalesce(*(F.nullif(groups[g], F.lit("")) for g in ("g1", "g3")))
    code = sign
    for s, c in SIGNS.items():
        code = F.when(sign == s, F.lit(c)).otherwise(code)
    return F.struct(code.alias("currency"), parse_number(groups["g2"]).alias("amount"))


def clean_number(col: Column, decimal_comma: bool) -> Column:
    """A cell of a column of declared convention: the other separator alone is decimal unless it groups thousands."""
    mark, other = (",", ".") if decimal_comma else (".", ",")

    def read(text: Column) -> Column:
        plain = F.replace(text, F.lit(other), F.lit(""))
        both = F.replace(plain, F.lit(mark), F.lit("."))
        grouped = text.rlike(rf"^-?[0-9]{{1,3}}(\{other}[0-9]{{3}})+$")
        alone = F.when(grouped, plain).otherwise(F.replace(text, F.lit(other), F.lit(".")))
        has_mark, has_other = F.contains(text, F.lit(mark)), F.contains(text, F.lit(other))
        return _as_double(F.when(has_mark & has_other, both).when(has_mark, F.replace(text, F.lit(mark), F.lit("."))).when(has_other, alone).otherwise(text))

    text = col.cast("string")
    return F.when(~text.rlike(rf"[^0-9.,{DRESS}-]"), bound(F.regexp_replace(F.trim(text), f"[{DRESS}]", ""), read))


def format_number_es(col: Column, places: int = 2) -> Column:
    """Point for thousands, comma for decimals, no trailing zeros."""
    text = F.translate(F.format_number(col, places), ",.", ".,")
    return F.regexp_replace(F.regexp_replace(text, "(,[0-9]*?)0+$", "$1"), ",$", "")


def safe_ratio(top: Column, bottom: Column, places: int = 4) -> Column:
    """Null where there is nothing to divide by."""
    return F.round(F.try_divide(top.cast("double"), F.nullif(bottom.cast("double"), F.lit(0.0))), places)
