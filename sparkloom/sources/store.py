"""Versioned Parquet tables with snapshot-isolated transactions.

A database is a folder of Parquet folders (never changed once written) and
numbered manifests. A manifest names the folders of every table; writing the
next number, which only one writer can, is the commit. An INSERT adds a folder,
an UPDATE or DELETE replaces them all by one. Staged folders that no manifest
names are ignored, so a crash needs no repair.

Only one writer can publish a number where a rename refuses an existing
target, as on HDFS and local disks. Object stores without such a rename need
one writer at a time.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders of a table, beyond which an INSERT merges them into one.
MOST_FOLDERS = 64
#: Seconds for which what no manifest names any more is kept for readers that began before: lazy frames, and transactions elsewhere.
KEEP_S = 3600.0


class ConflictError(RuntimeError):
    """Another transaction changed a table that this one changed, too."""


class ConstraintError(ValueError):
    """Rows break a constraint of their table."""


@dataclass
class Snapshot:
    """A transaction: what it began from, and what it has staged (None: dropped)."""

    number: int
    version: int
    tables: dict[str, dict]
    staged: dict[str, dict | None] = field(default_factory=dict)
    state: str = "active"
    #: tables that a constraint was checked against; a change of theirs is a conflict, too
    relied_on: set[str] = field(default_factory=set)

    def get(self, name: str) -> dict | None:
        name = name.lower()
        return self.staged[name] if name in self.staged else self.tables.get(name)

    def names(self) -> list[str]:
        return sorted(n for n in {*self.tables, *self.staged} if self.get(n) is not None)


class Files:
    """The few operations on whatever file system Spark reaches the folder by."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm, self.base = spark.sparkContext._jvm, base.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path("manifests"))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Publishes a file at once; False if it is there already."""
        target, draft = self._path(name), self._path(f"{name}.{uuid.uuid4().hex}")
        if self.fs.exists(target):
            return False
        stream = self.fs.create(draft, True)
        stream.write(text.encode())
        stream.close()
        if not self.fs.exists(target) and self.fs.rename(draft, target):
            return True
        self.fs.delete(draft, False)
        return False

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def age(self, name: str) -> float:
        """Seconds since a file or folder was written."""
        return time.time() - self.fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class Store:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.files = Files(spark, self.base)
        self.active: dict[int, Snapshot] = {}
        self.counts = {"begun": 0, "committed": 0, "aborted": 0}

    # manifests

    def latest(self) -> tuple[int, dict[str, dict]]:
        numbers = [int(n[:-5]) for n in self.files.names("manifests") if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return 0, {}
        top = max(numbers)
        return top, json.loads(self.files.read(f"manifests/{top:012d}.json"))["tables"]

    def begin(self) -> Snapshot:
        version, tables = self.latest()
        self.counts["begun"] += 1
        txn = Snapshot(self.counts["begun"], version, tables)
        self.active[txn.number] = txn
        return txn

    def commit(self, txn: Snapshot) -> bool:
        """Publishes what is staged. The first of two that changed one table wins; the other raises."""
        if txn.state != "active":
            return False
        while txn.staged:
            version, tables = self.latest()
            for name in [*txn.staged, *sorted(txn.relied_on)]:
                if tables.get(name) != txn.tables.get(name):
                    self.rollback(txn)
                    raise ConflictError(f"table {name} was changed by another transaction")
            merged = {n: t for n, t in {**tables, **txn.staged}.items() if t is not None}
            if self.files.create(f"manifests/{version + 1:012d}.json", json.dumps({"version": version + 1, "tables": merged})):
                break
        txn.state = "committed"
        self.active.pop(txn.number, None)
        self.counts["committed"] += 1
        return True

    def rollback(self, txn: Snapshot) -> None:
        if txn.state == "active":
            txn.state = "aborted"
            self.active.pop(txn.number, None)
            self.counts["aborted"] += 1
            for name, entry in txn.staged.items():
                before = (txn.tables.get(name) or {}).get("paths", [])
                for path in (entry or {}).get("paths", []):
                    if path not in before:
                        self.files.delete(path)

    def collect_garbage(self, keep_s: float = KEEP_S) -> int:
        """Deletes folders that no kept manifest and no own active transaction names; returns how many.

        Kept are the latest manifest and those that were the latest within
        the last ``keep_s`` seconds. Readers anywhere thus have that long to
        finish with the snapshot that they began from; folders that are not
        older may be staged by a writer elsewhere, and stay.
        """
        numbers = sorted(int(n[:-5]) for n in self.files.names("manifests") if n.endswith(".json") and n[:-5].isdigit())
        file = lambda n: f"manifests/{n:012d}.json"
        kept = [n for n, after in zip(numbers, [*numbers[1:], None], strict=True) if after is None or self.files.age(file(after)) < keep_s]
        used = {path for n in kept for t in json.loads(self.files.read(file(n)))["tables"].values() for path in t["paths"]}
        for txn in self.active.values():
            used |= {path for t in [*txn.tables.values(), *txn.staged.values()] if t for path in t["paths"]}
        gone = 0
        for folder in self.files.names("tables"):
            for piece in self.files.names(f"tables/{folder}"):
                path = f"tables/{folder}/{piece}"
                if path not in used and self.files.age(path) >= keep_s:
                    self.files.delete(path)
                    gone += 1
        for n in set(numbers) - set(kept):
            self.files.delete(file(n))
        return gone

    # tables

    def schema(self, entry: dict) -> T.StructType:
        return T.StructType.fromJson(json.loads(entry["schema"]))

    def read(self, txn: Snapshot, name: str) -> DataFrame:
        entry = txn.get(name)
        if entry is None:
            raise KeyError(f"no table {name}")
        return self._frame(entry, entry["paths"])

    def _frame(self, entry: dict, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema(entry))
        return self.spark.read.schema(self.schema(entry)).parquet(*[f"{self.base}/{p}" for p in paths])

    def create(self, txn: Snapshot, name: str, schema: T.StructType, **rules) -> None:
        """rules: not_null, unique (lists of column lists), defaults, checks, references, autoincrement, indexes."""
        if txn.get(name) is not None:
            raise ValueError(f"table {name} exists")
        txn.staged[name.lower()] = {"name": name, "schema": schema.json(), "paths": [], "rules": rules, "next": 1}

    def drop(self, txn: Snapshot, name: str) -> None:
        if txn.get(name) is None:
            raise KeyError(f"no table {name}")
        txn.staged[name.lower()] = None

    def write(self, txn: Snapshot, name: str, rows: DataFrame, check: bool = True, add: bool = False, **changes) -> None:
        """Stages these rows in place of the table's, or beside them (``add``), after writing them and checking the constraints on what was written."""
        entry = txn.get(name)
        path = f"tables/{name.lower()}/{uuid.uuid4().hex}"
        schema = self.schema(entry)
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema]).write.parquet(f"{self.base}/{path}")
        staged = {**entry, "paths": [*entry["paths"], path] if add else [path], **changes}
        try:
            if check:
                self._check(txn, staged, self._frame(entry, [path]), self._frame(entry, entry["paths"]) if add and entry["paths"] else None)
            if not add:
                self._check_children(txn, staged)
        except ConstraintError:
            self.files.delete(path)
            raise
        txn.staged[name.lower()] = staged

    def _check(self, txn: Snapshot, entry: dict, rows: DataFrame, old: DataFrame | None) -> None:
        """The table's own constraints on new rows; rows that were there before matter for UNIQUE only."""
        rules, name = entry["rules"], entry["name"]
        broken = [F.count(F.when(F.col(c).isNull(), 1)).alias(f"NOT NULL {c}") for c in rules.get("not_null", [])]
        broken += [F.count(F.when(~F.expr(e), 1)).alias(f"CHECK {e}") for e in rules.get("checks", [])]
        if broken:
            for what, n in rows.agg(*broken).first().asDict().items():
                if n:
                    raise ConstraintError(f"{name}: {what}: {n} row(s)")
        for columns in rules.get("unique", []):
            keys = rows.dropna("any", subset=columns).select(*columns)
            twice = not keys.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
            if twice or (old is not None and not old.join(keys, columns, "left_semi").isEmpty()):
                raise ConstraintError(f"{name}: UNIQUE {', '.join(columns)}")
        for columns, other, theirs in rules.get("references", []):
            own = other.lower() == name.lower()
            parents = rows if old is None else old.unionByName(rows)
            self._matched(name, rows, columns, parents if own else self.read(txn, other), theirs)
            if not own:
                txn.relied_on.add(other.lower())

    def _check_children(self, txn: Snapshot, entry: dict) -> None:
        """Rows that refer to this table, whose rows were replaced, still find theirs."""
        rows = None
        for child in txn.names():
            for columns, other, theirs in txn.get(child)["rules"].get("references", []):
                if other.lower() != entry["name"].lower():
                    continue
                rows = self._frame(entry, entry["paths"]) if rows is None else rows
                own = child == other.lower()
                self._matched(txn.get(child)["name"], rows if own else self.read(txn, child), columns, rows, theirs)
                if not own:
                    txn.relied_on.add(child)

    def _matched(self, name: str, rows: DataFrame, columns: list[str], parent: DataFrame, theirs: list[str]) -> None:
        parent = parent.select(*[F.col(t).alias(f"_{i}") for i, t in enumerate(theirs)])
        condition = F.lit(True)
        for i, c in enumerate(columns):
            condition = condition & (F.col(c) == F.col(f"_{i}"))
        if not rows.dropna("any", subset=columns).select(*columns).join(parent, condition, "left_anti").isEmpty():
            raise ConstraintError(f"{name}: FOREIGN KEY {', '.join(columns)}")

    def append(self, txn: Snapshot, name: str, rows: DataFrame) -> None:
        """Adds rows whose columns are a subset of the table's: defaults, then autoincrement, fill what is missing."""
        entry = txn.get(name)
        rules, schema = entry["rules"], self.schema(entry)
        have = {c.lower(): c for c in rows.columns}
        unknown = set(have) - {f.name.lower() for f in schema}
        if unknown:
            raise ValueError(f"no column {', '.join(sorted(unknown))} in {name}")
        defaults = rules.get("defaults", {})
        full = rows.select(*[(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.expr(defaults[f.name]) if f.name in defaults else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        changes, draft = {}, None
        if auto := rules.get("autoincrement"):
            draft = f"drafts/{uuid.uuid4().hex}"
            full, changes["next"] = self._numbered(full, auto, entry["next"], f"{self.base}/{draft}")
        try:
            self.write(txn, name, full, add=True, **changes)
        finally:
            if draft:
                self.files.delete(draft)
        if len(txn.get(name)["paths"]) > MOST_FOLDERS:
            self.write(txn, name, self.read(txn, name), check=False)

    def _numbered(self, rows: DataFrame, column: str, first: int, draft: str) -> tuple[DataFrame, int]:
        """Numbers for nulls, and the next one. Rows are written once with their part and place, so that numbers don't depend on a second run; a part's numbers begin where those of the parts before it end."""
        rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"), F.col(column).isNull().alias("_none")).write.parquet(draft)
        marked = self.spark.read.parquet(draft)
        facts = marked.groupBy("_part").agg(F.count(F.when(F.col("_none"), 1)).alias("_n"), F.max(column).alias("_top"))  # a row per part
        whole = facts.agg(F.sum("_n").alias("n"), F.max("_top").alias("top")).first()
        first = max(first, (whole["top"] or 0) + 1)
        starts = facts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n") + F.lit(first)).alias("_start"))
        rank = F.row_number().over(Window.partitionBy("_part", "_none").orderBy("_at"))
        numbered = marked.withColumn("_rank", rank).join(starts, "_part")
        return numbered.withColumn(column, F.when(F.col("_none"), F.col("_start") + F.col("_rank") - 1).otherwise(F.col(column))).select(*rows.columns), first + (whole["n"] or 0)

    def update(self, txn: Snapshot, name: str, assignments: dict[str, str], condition: str | None) -> int:
        """Assignments see the old row. Returns how many rows changed."""
        rows = self.read(txn, name)
        hit = F.coalesce(F.expr(condition), F.lit(False)) if condition else F.lit(True)
        kinds = {f.name.lower(): f for f in rows.schema}
        unknown = {c.lower() for c in assignments} - set(kinds)
        if unknown:
            raise ValueError(f"no column {', '.join(sorted(unknown))} in {name}")
        new = {c.lower(): F.expr(e) for c, e in assignments.items()}
        n = rows.where(hit).count()
        if n:
            self.write(txn, name, rows.select(*[F.when(hit, new[f.name.lower()].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name.lower() in new else F.col(f.name) for f in rows.schema]))
        return n

    def delete(self, txn: Snapshot, name: str, condition: str | None) -> int:
        """Removes rows for which the condition is true; returns how many."""
        rows = self.read(txn, name)
        hit = F.coalesce(F.expr(condition), F.lit(False)) if condition else F.lit(True)
        n = rows.where(hit).count()
        if n:
            self.write(txn, name, rows.where(~hit), check=False)
        return n
