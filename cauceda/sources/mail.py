"""Mail messages as rows of a fixed contract."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Iterator
from email import message_from_bytes
from email.header import decode_header, make_header
from email.message import Message
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cauceda.operators.identity import Identity

#: The contract's columns.
CONTRACT = (
    "correo_id string, message_id string, buzon string, carpeta string, uid string, fecha timestamp_ntz, remitente_nombre string, "
    "remitente_correo string, destinatarios string, cc string, asunto string, cuerpo string, n_adjuntos bigint, adjuntos string"
)
COLUMNS = tuple(c.split()[0] for c in CONTRACT.split(", "))
#: Headers that name who a message was sent or forwarded to.
RECIPIENTS = ("To", "Delivered-To", "X-Original-To", "X-Forwarded-To")
BODY = 2000
#: By what a stored message is known: its id, its place, or its number alone where it was stored before mailboxes were told apart.
KEYS, IDENTITIES = ["correo_id"], [Identity(("buzon", "carpeta", "uid")), Identity(("uid",), "trim(coalesce(buzon, '')) = '' OR trim(coalesce(carpeta, '')) = ''")]


def header(value) -> str:
    try:
        return str(make_header(decode_header(str(value)))) if value else ""
    except (LookupError, ValueError, UnicodeError):
        return str(value)


def addresses(values: list) -> list[tuple[str, str]]:
    """Names and distinct lower-case addresses, decoded first and split then."""
    pairs = getaddresses([header(v) for v in values if v])
    return list({a.strip().lower(): (n.strip(), a.strip().lower()) for n, a in reversed(pairs) if a.strip()}.values())[::-1]


def _payload(part: Message) -> str:
    data, charset = part.get_payload(decode=True) or b"", part.get_content_charset() or "utf-8"
    try:
        return data.decode(charset, "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def body_and_files(message: Message) -> tuple[str, list[str]]:
    """The plain text, or the HTML without tags, and the names of what is attached."""
    found: dict[str, str] = {}
    files = []
    for part in message.walk():
        if part.is_multipart():
            continue
        name = header(part.get_filename())
        if name or part.get_content_disposition() == "attachment":
            files.append(name or "unnamed")
        else:
            found.setdefault(part.get_content_type(), _payload(part))
    if found.get("text/plain"):
        return found["text/plain"].strip(), files
    bare = re.sub(r"<(script|style)[^>]*>.*?</(script|style)>|<[^>]+>", " ", found.get("text/html", ""), flags=re.S | re.I)
    return " ".join(bare.split()), files


def row_of(raw: bytes, mailbox: str, folder: str, uid: str) -> dict:
    """One message by the contract. Its id is its Message-ID with its recipients, or its place if it has none."""
    message = message_from_bytes(raw)
    sender = (addresses([message.get("From")]) or [("", "")])[0]
    to = ", ".join(a for _, a in addresses([v for h in RECIPIENTS for v in message.get_all(h, [])]))
    message_id = header(message.get("Message-ID")).strip().lower()
    natural = ("message-id", message_id, to) if message_id else ("uid", mailbox, folder, uid)
    body, files = body_and_files(message)
    try:
        sent = parsedate_to_datetime(message["Date"]).replace(tzinfo=None)
    except (TypeError, ValueError):
        sent = None
    return {
        "correo_id": hashlib.sha256("\0".join(natural).encode()).hexdigest(), "message_id": message_id, "buzon": mailbox, "carpeta": folder, "uid": uid,
        "fecha": sent, "remitente_nombre": sender[0], "remitente_correo": sender[1], "destinatarios": to,
        "cc": ", ".join(a for _, a in addresses(message.get_all("Cc", []))), "asunto": header(message.get("Subject")).strip(), "cuerpo": body[:BODY],
        "n_adjuntos": len(files), "adjuntos": ", ".join(files),
    }


def messages_of(raw: DataFrame) -> DataFrame:
    """Rows of the contract. raw: mailbox, folder, uid, content (binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row_of(r.content, r.mailbox, r.folder, r.uid) for r in batch.itertuples()]
            yield pd.DataFrame(rows, columns=list(COLUMNS)).astype({"fecha": "datetime64[us]"})

    return raw.select("mailbox", "folder", "uid", "content").mapInPandas(run, CONTRACT)


def messages(spark: SparkSession, path: str, mailbox: str, folder: str = "INBOX", newest: int | None = None, since: dt.datetime | None = None) -> tuple[DataFrame, list[str]]:
    """The messages of files named <uid>.eml under ``path``, and an alert where some are left out.

    ``since``: only files that arrived at that moment or later, which the listing decides before any is opened. Of more
    than ``newest`` those of highest uid are read; counting and choosing them reads no content.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(path)
    if since is not None:
        files = files.filter(F.col("modificationTime") >= F.lit(since))
    uid = F.regexp_extract("path", r"([^/]+)\.eml$", 1)
    raw = files.select(F.lit(mailbox).alias("mailbox"), F.lit(folder).alias("folder"), uid.alias("uid"), "content")
    alerts = []
    if newest is not None:
        every = raw.select("uid").count()
        if every > newest:
            alerts.append(f"{mailbox}/{folder}: {every} messages, only the newest {newest} are read: {every - newest} are left out")
            top = raw.select("uid").orderBy(F.col("uid").try_cast("bigint").desc_nulls_last(), F.desc("uid")).limit(newest)
            raw = raw.join(top, "uid", "left_semi")
    return messages_of(raw), alerts
