"""Stored tables: Parquet versions under one root, made visible together by one pointer.

A snapshot maps each table to the folders that hold it. Writes add folders; a commit writes the next
snapshot and moves the pointer, so theme ids, themes and assignments appear at once or not at all. Each row
carries the snapshot number that wrote it; readers take the latest row of a key. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.traces import insert_or_ignore, latest_wins
from ..schemas import TABLES

SCHEMA_VERSION = 3


class StoreError(RuntimeError):
    pass


@dataclass
class Snapshot:
    number: int = 0
    schema_version: int = SCHEMA_VERSION
    theme_seq: int = 0
    folders: dict[str, list[str]] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self.snapshot = self._load()
        self._pending: Snapshot | None = None

    # -- snapshots

    def _names(self) -> list[str]:
        found = self._fs.listStatus(self._path(self.root))
        return sorted(s.getPath().getName() for s in found if s.getPath().getName().startswith("snapshot-"))

    def _load(self) -> Snapshot:
        names = self._names()
        if not names:
            return Snapshot()
        text = "".join(r.value for r in self.spark.read.text(f"{self.root}/{names[-1]}", wholetext=True).collect())
        found = Snapshot(**json.loads(text))
        if found.schema_version > SCHEMA_VERSION:
            raise StoreError(f"the store has schema version {found.schema_version}; this code knows {SCHEMA_VERSION}")
        return migrate(found)

    def _publish(self, snapshot: Snapshot) -> None:
        """The pointer is the greatest snapshot name; a rename makes it appear whole."""
        name = f"{self.root}/snapshot-{snapshot.number:012d}"
        if self._fs.exists(self._path(name)):
            raise StoreError(f"another writer has made snapshot {snapshot.number}")
        staged = self._path(f"{self.root}/.staged-{uuid.uuid4().hex}")
        out = self._fs.create(staged)
        out.write(json.dumps(vars(snapshot)).encode())
        out.close()
        if not self._fs.rename(staged, self._path(name)):
            raise StoreError(f"snapshot {snapshot.number} can't be made visible")
        self.snapshot = snapshot

    @contextmanager
    def transaction(self):
        """Writes inside become visible together; an error leaves the last snapshot as it is."""
        if self._pending is not None:
            yield self
            return
        s = self.snapshot
        self._pending = Snapshot(s.number + 1, SCHEMA_VERSION, s.theme_seq, {k: list(v) for k, v in s.folders.items()})
        try:
            yield self
            self._publish(self._pending)
        finally:
            self._pending = None

    # -- reading and writing

    def _schema(self, table: str) -> T.StructType:
        return T.StructType.fromDDL(TABLES[table][0]).add("_version", "long").add("_gone", "boolean")

    def _rows(self, table: str) -> DataFrame:
        folders = (self._pending or self.snapshot).folders.get(table, [])
        if not folders:
            return self.spark.createDataFrame([], self._schema(table))
        return self.spark.read.schema(self._schema(table)).parquet(*folders)

    def table(self, name: str) -> DataFrame:
        """Current rows: the latest of each key, without deleted ones."""
        keys = list(TABLES[name][1])
        return latest_wins(self._rows(name), keys, ["_version"]).where("not _gone").drop("_version", "_gone")

    def put(self, name: str, rows: DataFrame, gone: bool = False) -> None:
        """Insert or replace by key."""
        with self.transaction():
            path = f"{self.root}/{name}/{uuid.uuid4().hex}"
            own = T.StructType.fromDDL(TABLES[name][0]).fieldNames()
            rows.select(*own, F.lit(self._pending.number).cast("long").alias("_version"), F.lit(gone).alias("_gone")).write.parquet(path)
            self._pending.folders.setdefault(name, []).append(path)

    def add(self, name: str, rows: DataFrame, order: list | None = None) -> int:
        """Insert or ignore by key; the number of new rows."""
        keys = list(TABLES[name][1])
        with self.transaction():
            path = f"{self.root}/{name}/{uuid.uuid4().hex}"
            fresh = insert_or_ignore(self._rows(name), rows, keys, order or keys)
            own = T.StructType.fromDDL(TABLES[name][0]).fieldNames()
            fresh.select(*own, F.lit(self._pending.number).cast("long").alias("_version"), F.lit(False).alias("_gone")).write.parquet(path)
            n = self.spark.read.parquet(path).count()
            if n:
                self._pending.folders.setdefault(name, []).append(path)
        return n

    def insert_new(self, name: str, rows: DataFrame) -> None:
        """Insert; a key that the table has already is an error."""
        keys = list(TABLES[name][1])
        if found := rows.join(self.table(name).select(*keys), keys, "left_semi").first():
            raise StoreError(f"{name} holds {[found[k] for k in keys]} already")
        self.put(name, rows)

    def delete(self, name: str, keys: DataFrame) -> None:
        own = TABLES[name][1]
        self.put(name, self.table(name).join(keys.select(*own), list(own), "left_semi"), gone=True)

    def delete_theme(self, theme_id: str) -> None:
        """The theme goes, and its assignments become residual."""
        with self.transaction():
            members = self.table("assignments").where(F.col("theme_id") == theme_id).withColumn("theme_id", F.lit(None).cast("string"))
            gone = self.table("themes").where(F.col("id") == theme_id)
            self.put("assignments", members)
            self.put("themes", gone, gone=True)

    def next_theme_number(self, count: int) -> int:
        """The first of ``count`` fresh theme numbers; numbers are never used again."""
        if self._pending is None:
            raise StoreError("theme numbers are taken within a transaction")
        first = self._pending.theme_seq + 1
        self._pending.theme_seq += count
        return first

    def get_meta(self, key: str) -> str | None:
        found = self.table("meta").where(F.col("k") == key).first()
        return found.v if found else None

    def set_meta(self, key: str, value: str) -> None:
        self.put("meta", self.spark.createDataFrame([(key, value)], TABLES["meta"][0]))

    def compact_beyond(self, name: str, folders: int = 32) -> None:
        """Compact a table once it lies in more than so many folders, so reads stay short however long a stream runs."""
        if len((self._pending or self.snapshot).folders.get(name, [])) > folders:
            self.compact(name)

    def compact(self, name: str) -> None:
        """Rewrite a table as its current rows."""
        with self.transaction():
            path = f"{self.root}/{name}/{uuid.uuid4().hex}"
            self.table(name).select("*", F.lit(self._pending.number).cast("long").alias("_version"), F.lit(False).alias("_gone")).write.parquet(path)
            self._pending.folders[name] = [path]


def migrate(found: Snapshot) -> Snapshot:
    """Older snapshots, a version at a time; tables are read by name, so what a version lacks comes as null or empty.

    Version 1 kept no agent with an assignment, and its rows can't be counted by agent: they are left out, and the
    next assignment pass makes them anew. Version 2 had no alert log: it starts empty.
    """
    if found.schema_version < 2:
        found.folders = {**found.folders, "assignments": []}
    if found.schema_version < 3:
        found.folders = {"alert_log": [], **found.folders}
    found.schema_version = SCHEMA_VERSION
    return found
