"""Types of all-text tables: one aggregate over all columns, then one projection.

A column is a number if enough of its cells read as one, else a date, else text. The threshold counts all
rows, blank ones too, unless ``of_filled`` is set. A column's date or decimal convention is the declared one
unless its own cells prove the other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cauceda.functions import dates, numbers, text
from cauceda.operators import extract

THRESHOLD = 0.8
LOST = 0.05
AMBIGUOUS = 5


@dataclass
class Profile:
    """What one pass says about a column."""

    column: str
    rows: int
    filled: int
    numeric: int
    dated: int
    day_first: int
    month_first: int
    either: int
    comma_groups: int
    point_groups: int
    kind: str = "text"
    reads_day_first: bool = True
    reads_decimal_comma: bool = True
    alerts: list[str] = field(default_factory=list)


def cell_marks(col: Column, day_first: bool, decimal_comma: bool) -> dict[str, Column]:
    """Booleans of one cell. A cell that does not begin like a date or has signs of no number is not tried as one."""
    filled = ~text.is_blank(col)
    dated = lambda p: F.coalesce(*(dates.read_parts(p, d) for d in (day_first, not day_first))).isNotNull().alias("dated")
    date = dates.parts(col, lambda p: F.struct(dated(p), *(c.alias(n) for n, c in dates.proofs(p).items())))
    return {
        "filled": filled,
        "numeric": filled & numbers.clean_number(col, decimal_comma).isNotNull(),
        "date": date,
        "comma_groups": col.rlike(r"^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"),
        "point_groups": col.rlike(r"^-?[0-9]{1,3}(\.[0-9]{3})+(,[0-9]+)?$"),
    }


MEASURES = ("filled", "numeric", "date.dated", "date.day_first", "date.month_first", "date.either", "comma_groups", "point_groups")


def counted(df: DataFrame, day_first: bool = True, decimal_comma: bool = True) -> DataFrame:
    """One row: how many rows, then the measures of each column in turn. What is told of a cell is made once, then counted."""
    marks = {f"{i}__{k}": m for i, c in enumerate(df.columns) for k, m in cell_marks(F.col(f"`{c}`").cast("string"), day_first, decimal_comma).items()}
    cells = extract.once(df.select(*(m.alias(k) for k, m in marks.items())), list(marks))
    return cells.agg(F.count("*").alias("rows"), *(F.count_if(f"{i}__{m}").alias(f"{i}__{m}") for i in range(len(df.columns)) for m in MEASURES))


def profiles(df: DataFrame, day_first: bool = True, decimal_comma: bool = True) -> list[Profile]:
    """One job for the whole table; its result is one row."""
    rows, *counts = counted(df, day_first, decimal_comma).first()
    n = len(MEASURES)
    return [decide(Profile(c, rows, *counts[i * n : (i + 1) * n]), day_first, decimal_comma) for i, c in enumerate(df.columns)]


def decide(p: Profile, day_first: bool, decimal_comma: bool, of_filled: bool = False) -> Profile:
    """Fill in the kind, the conventions and what to warn about."""
    least = max(1, int(THRESHOLD * (p.filled if of_filled else p.rows)))
    p.reads_day_first, p.reads_decimal_comma = day_first, decimal_comma
    if p.numeric >= least:
        p.kind, kept = "number", p.numeric
        against = p.comma_groups if decimal_comma else p.point_groups
        if against and not (p.point_groups if decimal_comma else p.comma_groups):
            p.alerts.append(f"{p.column}: {against} cells group thousands against the declared convention")
    elif p.dated >= least:
        p.kind, kept = "timestamp", p.dated
        said = dates.verdict(p.day_first, p.month_first, p.either)
        if said == "contradictory":
            p.alerts.append(f"{p.column}: cells prove both date orders")
        elif said in ("day_first", "month_first"):
            proven = said == "day_first"
            if proven != day_first:
                p.alerts.append(f"{p.column}: cells prove {said}, which was not declared")
            p.reads_day_first = proven
        elif said == "ambiguous" and p.either >= AMBIGUOUS:
            p.alerts.append(f"{p.column}: {p.either} cells read either way")
    else:
        return p
    if p.filled and (p.filled - kept) / p.filled >= LOST:
        p.alerts.append(f"{p.column}: {p.filled - kept} of {p.filled} filled cells do not read as {p.kind}")
    return p


def typed(df: DataFrame, found: list[Profile]) -> DataFrame:
    """``df`` with every column read as its profile says."""
    out = []
    for p in found:
        col = F.col(p.column).cast("string")
        if p.kind == "number":
            col = numbers.clean_number(col, p.reads_decimal_comma)
        elif p.kind == "timestamp":
            col = dates.parse_declared(col, p.reads_day_first)
        out.append(col.alias(p.column))
    return df.select(*out)


def infer(df: DataFrame, day_first: bool = True, decimal_comma: bool = True) -> tuple[DataFrame, list[str]]:
    """The typed table and the alerts."""
    found = profiles(df, day_first, decimal_comma)
    return typed(df, found), [a for p in found for a in p.alerts]


def always_blank(df: DataFrame) -> list[str]:
    """Columns without one filled cell."""
    row = df.agg(*(F.count_if(~text.is_blank(F.col(c))).alias(c) for c in df.columns)).first()
    return [c for c in df.columns if not row[c]]
