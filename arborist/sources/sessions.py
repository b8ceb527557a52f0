"""Saved sessions: a table replaced as a whole or merged into, atomically, with the session that is current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import VersionedTable

COLUMNS = "session_id string, session string, current boolean"


class SessionStore:
    """Sessions (session_id, session as JSON text) below `root`; every change is a new version made from the last one."""

    def __init__(self, spark: SparkSession, root: str):
        self.table = VersionedTable(spark, root, COLUMNS)

    def load(self) -> tuple[DataFrame, str | None]:
        """(sessions, the current session's id); without any, no rows and None."""
        rows = self.table.read()
        now = rows.where("current").select("session_id").first()
        return rows.select("session_id", "session"), now.session_id if now else None

    def save(self, sessions: DataFrame, current: str | None = None) -> int:
        """Replaces all sessions; `current` counts only where it is one of them. The version."""
        return self.table.update(lambda _: _marked(sessions, F.lit(current)))

    def merge(self, sessions: DataFrame, current: str | None = None) -> int:
        """Adds sessions or replaces those of equal ids, whatever other writers do meanwhile; current None leaves it as it is."""

        def change(old: DataFrame) -> DataFrame:
            kept = old.join(sessions.select("session_id"), "session_id", "left_anti")
            before = old.where("current").select("session_id").first() if current is None else None
            now = current if current is not None else before.session_id if before else None
            return _marked(kept.select("session_id", "session").unionByName(sessions.select("session_id", "session")), F.lit(now))

        return self.table.update(change)

    def delete(self, ids: DataFrame) -> int:
        """Removes the sessions with an id in ids (session_id); a current one that goes leaves none."""
        return self.table.update(lambda old: old.join(ids.select("session_id"), "session_id", "left_anti"))


def _marked(sessions: DataFrame, current) -> DataFrame:
    return sessions.select(F.col("session_id").cast("string").alias("session_id"), F.col("session").cast("string").alias("session"), F.coalesce(F.col("session_id").cast("string") == current.cast("string"), F.lit(False)).alias("current"))
