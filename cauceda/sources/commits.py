"""Commits that several writers may race for: one file for each version of a table, which only one writer can make.

A writer reads the table's version, makes its rows aside, and claims the next version by creating its file in the
schema's folder ``_commits/<table>``; the store refuses a file that exists, so of two writers with one version in mind one
loses and starts over from what the other wrote. The claim says where the new rows are. Showing them is a change
of locations in the catalog, which can be done again: whoever opens a table whose claim was not carried out, because
its writer died in between, carries it out first. Nothing that is dropped ever owns the folder that is shown.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

#: The property in which a table notes the last claim that was carried out.
VERSION = "cauceda.version"
#: Claims that stay, beside the newest one.
KEEP = 20


class Conflict(RuntimeError):
    """Another writer took the version."""


class Claims:
    """The claims of the tables of a session's catalog."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._hadoop = spark._jvm.org.apache.hadoop

    def _fs(self, path: str):
        at = self._hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def folder(self, name: str) -> str:
        schema, _, table = name.rpartition(".")
        return f"{self.spark.catalog.getDatabase(schema).locationUri.rstrip('/')}/_commits/{table}"

    def versions(self, name: str) -> list[int]:
        fs, at = self._fs(self.folder(name))
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()) if fs.exists(at) else []

    def read(self, name: str, version: int) -> dict:
        fs, at = self._fs(f"{self.folder(name)}/{version}")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def claim(self, name: str, version: int, what: dict) -> None:
        """Take ``version``; Conflict if it is taken."""
        fs, at = self._fs(f"{self.folder(name)}/{version}")
        try:
            stream = fs.create(at, False)
        except Exception as error:
            if fs.exists(at):
                raise Conflict(f"{name}: version {version} is taken") from error
            raise
        try:
            stream.write(json.dumps(what).encode())
        finally:
            stream.close()
        for old in self.versions(name)[: -KEEP - 1]:
            fs.delete(self._hadoop.fs.Path(f"{self.folder(name)}/{old}"), False)

    def exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def delete(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)
