"""Dates from text, by declared convention or by evidence, and business days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cauceda.functions import numbers

#: Spanish months by their first three letters.
MONTHS = {"ene": 1, "feb": 2, "mar": 3, "abr": 4, "may": 5, "jun": 6, "jul": 7, "ago": 8, "set": 9, "sep": 9, "oct": 10, "nov": 11, "dic": 12}
#: Fixed value: month name, day, year and maybe a time.
SPANISH = r"([A-Za-zÁÉÍÓÚáéíóú]+)\s*([0-9]{1,2})\s*,\s*([0-9]{4})(?:\s*,?\s*([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?)?"
#: Formats tried in this order, each with what it must look like.
FORMATS = (
    ("yyyy-M-d H:m:s", r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"),
    ("yyyy-M-d H:m", r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}$"),
    ("yyyy-M-d", r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"),
    ("d/M/yyyy H:m", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{1,2}$"),
    ("d/M/yyyy", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"),
    ("d-M-yyyy", r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"),
)
ISO = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
PARTS = r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})"
CLOCK = r" ([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?"
#: How a cell begins that has either form.
BEGINS = r"^[0-9]{1,4}[/.-][0-9]{1,2}[/.-][0-9]"


def _try(col: Column, pattern: str) -> Column:
    return F.try_to_timestamp(col, F.lit(pattern)).cast("timestamp_ntz")


def parse_date(col: Column) -> Column:
    """A timestamp without zone from ISO or day-first text; null if none of the formats fits."""
    text = F.substring(F.trim(F.coalesce(col.cast("string"), F.lit(""))), 1, 19)
    read = lambda t: F.coalesce(*(F.when(t.rlike(look), _try(t, pattern)) for pattern, look in FORMATS))
    return numbers.bound(text, lambda t: F.when(t.rlike("^[0-9]{1,4}[/-][0-9]"), read(t)))


def parse_spanish_date(col: Column) -> Column:
    """``Ago 9, 2026 , 16:22`` and its variants; other texts by ``parse_date``. A day that does not exist is null."""
    text = F.trim(F.coalesce(col.cast("string"), F.lit("")))
    months = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))

    def made(group: Column) -> Column:
        name = F.translate(F.lower(group["g1"]), "áéíóú", "aeiou")
        whole = [F.coalesce(F.nullif(group[f"g{i}"], F.lit("")).cast("int"), F.lit(0)) for i in range(2, 7)]
        return F.try_make_timestamp_ntz(whole[1], F.try_element_at(months, F.substring(name, 1, 3)), whole[0], *whole[2:])

    groups = F.struct(*(F.regexp_extract(text, SPANISH, i).alias(f"g{i}") for i in range(1, 7)))
    return F.when(text.rlike(SPANISH), numbers.bound(groups, made)).otherwise(parse_date(text))


def parts(col: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` the parts of a cell, each extracted once; null for a cell that does not begin like a date.

    struct(text, iso, first, second, year, time): ``iso`` where the year comes first; the numbers are null where neither order fits.
    """
    text = F.replace(F.substring(F.trim(col.cast("string")), 1, 19), F.lit("T"), F.lit(" "))

    def number(t: Column, pattern: str, group: int) -> Column:
        return F.regexp_extract(t, pattern, group).try_cast("int")

    def split(t: Column) -> Column:
        clock = [F.coalesce(number(t, CLOCK, g), F.lit(0)) for g in (1, 2, 3)]
        time = F.when(F.contains(t, F.lit(":")), F.array(*clock)).otherwise(F.array(*[F.lit(0)] * 3))
        return F.struct(t.alias("text"), t.rlike(ISO).alias("iso"), *(number(t, PARTS, g).alias(n) for g, n in ((1, "first"), (2, "second"), (3, "year"))), time.alias("time"))

    return F.when(F.trim(col.cast("string")).rlike(BEGINS), numbers.bound(numbers.bound(text, split), of))


def read_parts(found: Column, day_first: bool) -> Column:
    """The timestamp of a cell's parts: ISO is never read day first; the others by the declared convention."""
    day, month = (found["first"], found["second"]) if day_first else (found["second"], found["first"])
    made = F.try_make_timestamp_ntz(found["year"], month, day, *(F.get(found["time"], F.lit(i)) for i in range(3)))
    latin = F.when(month.between(1, 12) & day.between(1, 31), made)  # what cannot be a date would cost an exception
    return F.when(found["iso"], F.coalesce(*(F.when(found["text"].rlike(look), _try(found["text"], p)) for p, look in FORMATS[:3]))).otherwise(latin)


def parse_declared(col: Column, day_first: bool) -> Column:
    """Cells of one column, by its declared convention."""
    return parts(col, lambda found: read_parts(found, day_first))


def proofs(found: Column) -> dict[str, Column]:
    """Of a cell's parts: whether it can only be day first, only month first, or either."""
    first, second = found["first"], found["second"]
    fits = first.between(1, 31) & second.between(1, 31)
    return {"day_first": fits & (first > 12) & (second <= 12), "month_first": fits & (second > 12) & (first <= 12), "either": fits & (first <= 12) & (second <= 12)}


def evidence(col: Column) -> dict[str, Column]:
    """Aggregates that tell a column's convention: cells that can only be day first, month first, or either."""
    cell = parts(col, lambda found: F.struct(*(c.alias(n) for n, c in proofs(found).items())))
    return {n: F.count_if(cell[n]) for n in ("day_first", "month_first", "either")}


def verdict(day_first: int, month_first: int, either: int) -> str:
    """day_first, month_first, contradictory, ambiguous or nothing."""
    if day_first and month_first:
        return "contradictory"
    return "day_first" if day_first else "month_first" if month_first else "ambiguous" if either else ""


def business_date(ts: Column, zone: str) -> Column:
    """The local date of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))
