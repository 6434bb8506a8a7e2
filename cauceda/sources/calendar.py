"""Calendar events as rows of a fixed contract, from the provider's JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cauceda.functions import hashing
from cauceda.operators.identity import Identity
from cauceda.sources import parts

_MOMENT = "struct<dateTime:string,date:string,timeZone:string>"
#: What is read of an event.
EVENT = (
    f"id string, iCalUID string, summary string, description string, location string, start {_MOMENT}, `end` {_MOMENT}, status string, "
    f"transparency string, visibility string, eventType string, recurringEventId string, originalStartTime {_MOMENT}, created string, updated string, "
    "htmlLink string"
)
#: Contract columns that are copied, with the event's name of each.
COPIED = {
    "evento_id": "id", "ical_uid": "iCalUID", "titulo": "summary", "descripcion": "description", "ubicacion": "location", "estado": "status",
    "transparencia": "transparency", "visibilidad": "visibility", "evento_recurrente_id": "recurringEventId", "enlace_evento": "htmlLink",
}
#: The contract's columns in order.
COLUMNS = (
    "calendar_id", "recurso", "evento_id", "ical_uid", "titulo", "descripcion", "ubicacion", "inicio", "fin", "zona_horaria", "duracion_min", "todo_el_dia",
    "estado", "transparencia", "visibilidad", "tipo_evento", "evento_recurrente_id", "inicio_original", "creado_en", "actualizado_en", "enlace_evento",
    "organizador", "invitados", "propiedades", "raw_evento",
)
#: What a cancelled event keeps of its stored row.
KEPT_WHEN_CANCELLED = tuple(c for c in COLUMNS if c not in ("calendar_id", "evento_id", "estado", "actualizado_en", "raw_evento"))

#: By what a stored event is known: its calendar, or the name under which a calendar is configured, where its id changed.
KEYS, IDENTITIES = ["calendar_id", "evento_id"], [Identity(("recurso", "evento_id"))]


def instant(text: Column) -> Column:
    """A UTC timestamp of an RFC 3339 text or a bare date."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSS]", "yyyy-MM-dd")))


def events_of(raw: DataFrame) -> DataFrame:
    """The contract and version_hash. raw: calendar_id, recurso, event (JSON text)."""
    df = raw.select("calendar_id", "recurso", "event", F.from_json("event", EVENT).alias("e"))
    start, end = F.coalesce("e.start.dateTime", "e.start.date"), F.coalesce("e.end.dateTime", "e.end.date")
    all_day = F.col("e.start.date").isNotNull() & F.col("e.start.dateTime").isNull()
    none = F.lit("")
    columns = {c: F.coalesce(F.col(f"e.{n}"), none) for c, n in COPIED.items()}
    columns |= {
        "calendar_id": F.col("calendar_id"), "recurso": F.col("recurso"), "inicio": instant(start), "fin": instant(end), "todo_el_dia": all_day,
        "zona_horaria": F.coalesce(F.nullif("e.start.timeZone", none), "e.end.timeZone", none), "tipo_evento": F.coalesce("e.eventType", F.lit("default")),
        "duracion_min": F.when(~all_day, F.bround((F.unix_micros(instant(end)) - F.unix_micros(instant(start))) / 60e6)).cast("bigint"),
        "inicio_original": instant(F.coalesce("e.originalStartTime.dateTime", "e.originalStartTime.date")),
        "creado_en": instant(F.col("e.created")), "actualizado_en": instant(F.col("e.updated")),
        "organizador": F.coalesce(F.get_json_object("event", "$.organizer"), F.lit("{}")), "invitados": F.coalesce(F.get_json_object("event", "$.attendees"), F.lit("[]")),
        "propiedades": F.coalesce(F.get_json_object("event", "$.extendedProperties"), F.lit("{}")), "raw_evento": F.col("event"),
    }
    out = df.select(*(columns[c].alias(c) for c in COLUMNS))
    return out.withColumn("version_hash", hashing.content_hash(*COLUMNS))


def window(df: DataFrame, now: Column, back: int = 30, ahead: int = 60) -> DataFrame:
    """Events that end after ``back`` days ago and begin before ``ahead`` days from now, and cancelled ones."""
    near = (F.col("fin") > now - F.make_interval(days=F.lit(back))) & (F.col("inicio") < now + F.make_interval(days=F.lit(ahead)))
    return df.filter((F.col("estado") == "cancelled") | near)


def events(spark: SparkSession, paths: dict[str, tuple[str, str]], damaged: str = "part") -> tuple[DataFrame, parts.Parts]:
    """The events of several calendars' files of one event a line, and what was read of each calendar.

    paths: calendar id -> (resource, path). A calendar that fails stops no other; see ``parts.read_parts``.
    """
    found = parts.read_parts(spark, {c: path for c, (_, path) in paths.items()}, damaged)
    names = F.create_map(*(F.lit(x) for c, (resource, _) in paths.items() for x in (c, resource)))
    return events_of(found.rows.select(F.col("part").alias("calendar_id"), names[F.col("part")].alias("recurso"), F.col("record").alias("event"))), found
