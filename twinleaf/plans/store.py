"""Stored sessions: fragments and groups of a run as Parquet tables, keyed by session."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .detect import MEMBERS, Detection

SESSION = "session_id string, created_at string, scan_path string, config_json string"


class SessionStore:
    """Tables session, fragments and members below a folder, one sub-folder per session.

    Used as a context: what is written or deleted within it holds when it ends well, and is undone where it ends by an
    exception. A session is listed from then on; within the context it can be read at once. Deleting a session deletes its sub-folder, and thus all
    that belongs to it. Every save is a folder of its own, so that it can be undone.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._open = False
        self._created: set[str] = set()
        self._deleted: set[str] = set()
        self._written: list[str] = []

    def __enter__(self) -> SessionStore:
        self._fs = self._hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._hadoop(self.path))
        self._open = True
        self._created, self._deleted, self._written = set(), set(), []
        return self

    def __exit__(self, kind, value, trace) -> None:
        try:
            if kind is None:
                for s in self._created - self._deleted:
                    self._fs.create(self._hadoop(self._marker(s)), True).close()
                gone = [f"{self.path}/{s}" for s in self._deleted]
            else:
                gone = [*self._written, *(f"{self.path}/{s}" for s in self._created)]
            for x in gone:
                self._fs.delete(self._hadoop(x), True)
        finally:
            self._open = False

    def _at(self, session_id: str, table: str) -> str:
        if not self._open:
            raise RuntimeError("the store is not open; use it in a with statement")
        return f"{self.path}/{session_id}/{table}"

    def _marker(self, session_id: str) -> str:
        return self._at(session_id, "_COMMITTED")

    def _save(self, session_id: str, table: str, rows: DataFrame) -> None:
        at = f"{self._at(session_id, table)}/{uuid.uuid4().hex}"
        self._written.append(at)
        rows.write.parquet(at)

    def _read(self, session_id: str, table: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.option("recursiveFileLookup", "true")
        if schema is not None:
            if session_id in self._deleted or not self._fs.exists(self._hadoop(self._at(session_id, table))):
                return self.spark.createDataFrame([], schema)
            reader = reader.schema(schema)
        return reader.parquet(self._at(session_id, table))

    def create(self, scan_path: list[str], config: dict) -> str:
        session_id = uuid.uuid4().hex
        row = [(session_id, datetime.now(timezone.utc).isoformat(), json.dumps(scan_path), json.dumps(config))]
        self._save(session_id, "session", self.spark.createDataFrame(row, SESSION).coalesce(1))
        self._created.add(session_id)
        return session_id

    def session(self, session_id: str) -> DataFrame:
        return self._read(session_id, "session", SESSION)

    def delete(self, session_id: str) -> None:
        self._at(session_id, "")
        self._deleted.add(session_id)

    def sessions(self) -> list[str]:
        """Committed sessions and those of this context, without deleted ones."""
        self._at("", "")
        there = {s.getPath().getName() for s in self._fs.listStatus(self._hadoop(self.path))}
        return sorted((s for s in there if (s in self._created or self._fs.exists(self._hadoop(self._marker(s)))) and s not in self._deleted))

    def save_fragments(self, session_id: str, fragments: DataFrame) -> None:
        self._save(session_id, "fragments", fragments)

    def fragments(self, session_id: str) -> DataFrame:
        return self._read(session_id, "fragments")

    def fragment(self, session_id: str, fragment_id: str):
        """The row, or None."""
        return self.fragments(session_id).where(F.col("fragment_id") == fragment_id).first()

    def fragments_by_id(self, session_id: str, ids: list[str]) -> DataFrame:
        wanted = self.spark.createDataFrame([(x,) for x in ids], "fragment_id string")
        return self.fragments(session_id).join(wanted, "fragment_id", "left_semi")

    def count(self, session_id: str) -> int:
        return self.fragments(session_id).count()

    def save_groups(self, session_id: str, found: Detection) -> None:
        self._save(session_id, "members", found.members)

    def detection(self, session_id: str) -> Detection:
        return Detection(self._read(session_id, "members", MEMBERS))

    def clone_groups(self, session_id: str) -> DataFrame:
        """(group_id, clone_type, representative_hash, similarity_score, member_fragment_ids) by type and id; members in order."""
        members = self.detection(session_id).members.join(self.fragments(session_id).select("ord", "fragment_id"), "ord")
        folded = members.groupBy("group_id", "clone_type", "representative_hash", "similarity_score").agg(F.sort_array(F.collect_list(F.struct("ord", "fragment_id"))).alias("m"))
        return folded.select("group_id", "clone_type", "representative_hash", "similarity_score", F.transform("m", lambda x: x["fragment_id"]).alias("member_fragment_ids")).orderBy("clone_type", "group_id")

    def group_fragments(self, session_id: str, group_id: str) -> DataFrame:
        members = self.detection(session_id).members.where(F.col("group_id") == group_id)
        return self.fragments(session_id).join(members.select("ord"), "ord", "left_semi").orderBy("ord")

    def fragments_of_groups(self, session_id: str) -> DataFrame:
        """The fragments of all groups with their group_id and clone_type: one join, not one per group."""
        return self.fragments(session_id).join(self.detection(session_id).members.select("group_id", "clone_type", "ord"), "ord")
