"""Names of tables, columns and files."""

from __future__ import annotations

import re
import unicodedata


def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", str(text)) if not unicodedata.combining(c))


def identifier(text: str, most: int = 63) -> str:
    """Lower-case letters, digits and underscores; a leading digit gets an underscore."""
    out = re.sub(r"[^0-9a-z]+", "_", plain(text).lower()).strip("_")
    return (f"_{out}" if out[:1].isdigit() else out)[:most]


def headers(names: list) -> list[str]:
    """Column names of a sheet: empty ones by position, repeated ones numbered past names already taken."""
    out: list[str] = []
    wanted = [identifier("" if n is None else n) or f"column_{i}" for i, n in enumerate(names, 1)]
    for name in wanted:
        own, n = name, 1
        while own in out or (n > 1 and own in wanted):
            n += 1
            own = f"{name}_{n}"
        out.append(own)
    return out


def raw_schema(tenant: str) -> str:
    return f"raw_{identifier(tenant)}"


def semantic_schema(tenant: str) -> str:
    return f"semantic_{identifier(tenant)}"


def raw_table(source: str, table: str) -> str:
    return f"{identifier(source)}__{identifier(table)}"


def file_name(title: str, suffix: str, most: int = 60) -> str:
    return f"{identifier(title, most) or 'result'}.{suffix}"


def direct_link(url: str) -> str:
    """A share link that downloads instead of showing a page."""
    return url if re.search(r"[?&]download=1\b", url) else f"{url}{'&' if '?' in url else '?'}download=1"
