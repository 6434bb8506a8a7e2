"""Readers of tables, JSON, workbooks, mail, calendars and ad metrics, and the sinks they land in."""

from __future__ import annotations

from cauceda.sources import ads, calendar, files, mail, workbook

#: Readers by the kind that a source's configuration names.
READERS = {
    "csv": files.csv_tables,
    "json": files.json_records,
    "jdbc": files.jdbc_table,
    "workbook": workbook.sheets,
    "mail": mail.messages,
    "calendar": calendar.events,
    "ads": ads.insights,
}


def reader(kind: str):
    if kind not in READERS:
        raise ValueError(f"unknown kind of source: {kind}; known are {', '.join(sorted(READERS))}")
    return READERS[kind]
