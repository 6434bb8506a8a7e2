"""What was said before: the turns of conversations in a table, read by a window of time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cauceda.operators import trends

TURNS = "tenant string, number string, role string, content string, sql string, at timestamp, turn int"


def history(turns: DataFrame, by: list[str], order: list[str], at: str, now: Column, hours: int = 72, most: int = 20) -> DataFrame:
    """The last ``most`` turns of each conversation that are younger than ``hours``."""
    return trends.last_n(turns.filter(F.col(at) > now - F.make_interval(hours=F.lit(hours))), by, order, most)


class Memory:
    """The turns of one tenant's warehouse."""

    def __init__(self, house):
        self.house, self.name = house, f"{house.meta}.turns"

    def remember(self, tenant: str, number: str, question: str, answer: str, sql: str = "") -> None:
        """Append a question and its answer; neither may be empty."""
        if not (question and answer):
            return
        at = dt.datetime.now(dt.UTC)
        rows = [(tenant, number, "user", question, "", at, 0), (tenant, number, "assistant", answer, sql, at, 1)]
        self.house.spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("append").format("parquet").saveAsTable(self.name)

    def recall(self, tenant: str, number: str, hours: int = 72, most: int = 20) -> list[dict]:
        """The turns of one conversation, oldest first."""
        if not self.house.exists(self.name):
            return []
        own = self.house.spark.table(self.name).filter((F.col("tenant") == tenant) & (F.col("number") == number))
        found = history(own, ["tenant", "number"], ["at", "turn"], "at", F.current_timestamp(), hours, most)
        return [r.asDict() for r in found.select("role", "content", "sql", "at", "turn").orderBy("at", "turn").collect()]

    def forget(self, tenant: str, number: str) -> None:
        if self.house.exists(self.name):
            self.house.swap(self.house.spark.table(self.name).filter(~((F.col("tenant") == tenant) & (F.col("number") == number))), self.name)

    def purge(self, days: int = 30) -> None:
        if self.house.exists(self.name):
            self.house.purge(self.name, "at", days)
