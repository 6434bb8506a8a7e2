"""Choosing KPIs and answer formats by what a question says."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cauceda.functions import naming, text

#: Words that tell nothing about a KPI.
STOP = (
    "como", "cual", "cuales", "cuanto", "cuantos", "dame", "decime", "donde", "este", "esta", "estos", "estas", "para", "quiero", "tengo", "total",
    "todos", "todas", "mostrar", "muestra", "necesito", "mes",
)
#: Words of time. A question with one of these needs a query of its own, not a stored formula.
DAYS = ("hoy", "ayer", "anteayer")
SPANS = {"dia": "dias", "semana": "semanas", "mes": "meses", "ano": "anos"}
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
#: What names a format, in the order in which formats are looked for: whole words, beginnings of words, phrases.
FORMATS = (
    ("pdf", {"pdf", "reporte", "informe", "documento"}, (), ()),
    ("excel", {"excel", "excell", "xls", "xlsx", "planilla"}, ("tabulad",), ("hoja de calculo",)),
    ("csv", {"csv"}, (), ()),
    ("chart", {"chart", "imagen", "foto", "pastel"}, ("grafic", "grafiqu", "visualiza", "plote", "diagrama"), ("de barras", "de pastel", "de lineas")),
    ("excel", {"archivo"}, ("exporta", "descarga", "adjunt", "bajar"), ()),
)
EXPLAINS = r"^\W*(entonces\b\W*)?(por\s+que|porque|como\s+es\s+que|que\s+paso|que\s+ocurrio|cual\s+fue\s+el\s+problema)\b"


def relevant(kpis: DataFrame, question: str, most: int = 16) -> DataFrame:
    """The ``most`` KPIs that share most words with the question, name words counting three times; else the first ones.

    kpis: position, kpi, name, examples, description, dimensions, assumptions.
    """
    asked = text.tokens(F.lit(question), without=STOP)

    def hits(*columns: str) -> Column:
        return F.size(F.array_intersect(asked, text.tokens(F.concat_ws(" ", *columns), without=STOP)))

    scored = kpis.withColumn("score", 3 * hits("kpi", "name", "examples") + hits("description", "dimensions", "assumptions"))
    return scored.orderBy(F.desc("score"), "position").limit(most)


def words_of(question: str) -> list[str]:
    """The folded words of a question; a date in figures is one word."""
    return re.findall(r"\d{1,2}[/.-]\d{1,2}(?:[/.-]\d{2,4})?|\w+", naming.plain(question).lower())


def names_period(question: str) -> bool:
    """Whether it names a day, a month, a year, a date, or this, the last or the last few of a span."""
    words = words_of(question)
    if any(w in DAYS or w in MONTHS or not w.isalnum() or (len(w) == 4 and w.isdigit() and w.startswith("20")) for w in words):
        return True
    counted = {x for one, many in SPANS.items() if one != "ano" for x in (one, many)}
    for i, word in enumerate(words):
        before, after = words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""
        if word in SPANS and word != "dia" and (before in ("este", "esta") or after in ("pasado", "pasada")):
            return True
        if word in counted and before.isdigit() and i > 1 and words[i - 2] in ("ultimo", "ultimos", "ultima", "ultimas"):
            return True
    return False


def answer_format(question: str) -> str:
    """text, chart, excel, pdf or csv. A question about why something happened asks for no file."""
    asked, words = naming.plain(question).lower(), words_of(question)
    if re.search(EXPLAINS, asked):
        return "text"
    line = f" {' '.join(words)} "
    for kind, whole, begins, phrases in FORMATS:
        if whole.intersection(words) or any(w.startswith(begins) for w in words) or any(f" {p} " in line for p in phrases):
            return kind
    return "text"


#: Other names of result columns.
ALIASES = {
    "linea id": ("id de linea", "identificador de linea"), "categoria": ("categorias",), "concepto": ("conceptos", "rubro", "rubros"), "titular": ("persona",),
    "presupuesto": ("presupuestado",), "gastado": ("gasto",), "disponible": ("saldo",),
}
#: Other names of every column of percentages.
SHARES = ("porcentaje", "porcentaje consumido", "pct", "%")
#: Phrases that begin a list of columns, of which some stress it, and phrases that take a column out.
BEGINS = {"solo": False, "solamente": False, "unicamente": False, "la respuesta es": True, "las columnas son": True, "los campos son": True}
ENDS = ("nada mas",)
TAKES_OUT = ("sin", "omite", "quita", "no pongas", "no incluyas", "no muestres")


def names_of(column: str) -> tuple[str, ...]:
    """How a question may name a result column."""
    own = naming.plain(column).lower().replace("_", " ").strip()
    share = "porcentaje" in own or "pct" in own.split()
    return (own, *ALIASES.get(own, ()), *(SHARES if share else ()))


def spans(question: str, columns: list[str]) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, what) of the phrases of a question in order, longest first where several begin: begin, end, out, column."""
    asked = " ".join(naming.plain(question).lower().split())
    known = [*((p, "begin") for p in BEGINS), *((p, "end") for p in ENDS), *((p, "out") for p in TAKES_OUT)]
    found = []
    for what, kind, phrase in [*((p, k, p) for p, k in known), *((c, "column", n) for c in columns for n in names_of(c))]:
        edge = ("", "") if phrase == "%" else (r"(?<![a-z0-9])", r"(?![a-z0-9])")
        found += [(m.start(), -m.end(), kind, what) for m in re.finditer(edge[0] + re.escape(phrase) + edge[1], asked)]
    return [(start, -end, kind, what) for start, end, kind, what in sorted(found)]


def requested_columns(question: str, columns: list[str]) -> list[str]:
    """The columns a question lists, in its order, without those it excludes; all of them if it lists none.

    One column alone counts only if the wording stresses it: ``solo`` before one name is often a filter.
    """
    listed: dict[str, int] = {}
    stressed = open_ = False
    out, out_end = set(), -1
    for start, end, kind, what in spans(question, columns):
        if kind == "begin":
            listed, open_, stressed = {}, True, stressed or BEGINS[what]
        elif kind == "end":
            open_, stressed = False, True
        elif kind == "out":
            out_end, stressed = end, stressed or what.startswith("no ")
        else:
            if 0 <= start - out_end <= len(" las ") and out_end >= 0:  # an article may stand between
                out.add(what)
            if open_:
                listed.setdefault(what, start)
    chosen = sorted(listed, key=listed.get) if len(listed) > 1 or (listed and stressed) else list(columns)
    return [c for c in chosen if c not in out] or list(columns)


def project(df: DataFrame, question: str) -> DataFrame:
    """``df`` cut to the requested columns before anything is read."""
    return df.select(*requested_columns(question, df.columns))
