"""A store of tables whose runs become visible all at once.

Tables are Parquet folders that are never changed. A commit is one small file that
names the folders of every table, or of every part (day) of one; it appears whole
or not at all. A run writes its tables into new folders and commits last, so a run
that dies leaves the store as it was and its successor does the work again. One
run writes to a store at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column that names a row's part while a table is written, and the part of a table without parts.
PART, WHOLE = "_part", ""
#: The part that only holds a table's columns.
COLUMNS = "columns"
#: Folders that appends may add to a table before it is written as one.
SEGMENTS = 32
#: Pseudo tables: which input folders the last run of the core chain has taken in.
SEEN = "_seen"
COMMIT = "commit long, table string, part string, paths array<string>"


class Store:
    """Named tables under one shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(COMMIT).parquet(f"{self.folder}/_commits")
        except AnalysisException:
            return None

    def folders(self) -> dict[tuple[str, str], list[str]]:
        """(table, part) -> folders of the newest commit that names it; a row per table and calendar day."""
        log = self._log()
        if log is None:
            return {}
        newest = log.groupBy("table", "part").agg(F.max_by("paths", "commit").alias("paths"))
        return {(r["table"], r["part"]): list(r["paths"]) for r in newest.collect()}

    def commit(self, changes: dict[tuple[str, str], list[str]]) -> None:
        log = self._log()
        number = 1 + ((log.agg(F.max("commit")).first()[0] or 0) if log is not None else 0)
        rows = [(number, table, part, [p.removeprefix(f"{self.folder}/") for p in paths]) for (table, part), paths in changes.items()]
        # One file, so that readers see all of the commit or none of it.
        self.spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("append").parquet(f"{self.folder}/_commits")

    def _frame(self, paths: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{p}" for p in paths])

    def stored(self, name: str) -> DataFrame | None:
        """The table, None before its first commit."""
        paths = [p for (table, _), of in self.folders().items() if table == name for p in of]
        return self._frame(paths) if paths else None

    def read(self, name: str) -> DataFrame:
        found = self.stored(name)
        if found is None:
            raise ValueError(f"no table {name} in {self.folder}")
        return found

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Replace a table; what was read before stays readable."""
        run = Run(self)
        run.write(name, df)
        run.commit()
        return self.read(name)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        run = Run(self)
        run.append(name, df)
        run.commit()
        return self.read(name)


class Run:
    """What one run has written and others do not see before ``commit``."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        self.before = store.folders()
        self.changes: dict[tuple[str, str], list[str]] = {}

    def _place(self, name: str) -> str:
        return f"{name}/run-{uuid.uuid4().hex}"

    def folders(self, name: str) -> dict[str, list[str]]:
        """part -> folders, this run's changes included."""
        both = {**self.before, **self.changes}
        return {part: paths for (table, part), paths in both.items() if table == name and paths}

    def parts(self, name: str) -> list[str]:
        return sorted(set(self.folders(name)) - {COLUMNS, WHOLE})

    def stored(self, name: str, parts: Iterable[str] | None = None) -> DataFrame | None:
        """The table as this run sees it; with ``parts`` no other folder is listed or read."""
        found = self.folders(name)
        wanted = found if parts is None else [COLUMNS, *sorted(set(parts) & set(found))]
        paths = [p for part in wanted for p in found.get(part, [])]
        return self.store._frame(paths) if paths else None

    def read(self, name: str, parts: Iterable[str] | None = None) -> DataFrame:
        found = self.stored(name, parts)
        if found is None:
            raise ValueError(f"no table {name} in {self.store.folder}")
        return found

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """A whole table in a new folder."""
        place = self._place(name)
        df.write.parquet(f"{self.store.folder}/{place}")
        self._forget(name)
        self.changes[name, WHOLE] = [place]
        return self.read(name)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Rows in a folder beside those of the table."""
        held = self.folders(name).get(WHOLE, [])
        if len(held) >= SEGMENTS:
            return self.write(name, self.store._frame(held).unionByName(df))
        place = self._place(name)
        df.write.parquet(f"{self.store.folder}/{place}")
        self.changes[name, WHOLE] = [*held, place]
        return self.read(name)

    def write_parts(self, name: str, df: DataFrame, parts: Iterable[str] | None = None) -> DataFrame:
        """Replace the ``parts`` of a table (None: all of it) by the rows of ``df``, whose column PART names theirs.

        A part without rows goes. Spark deals a large part to several writers and
        gives small ones to one.
        """
        place, old = self._place(name), self.folders(name)
        rows = df.where(F.col(PART).isin(sorted(set(parts)))) if parts is not None else df
        rows.hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.store.folder}/{place}/rows")
        if parts is None:
            self._forget(name)
        if parts is None or COLUMNS not in old:
            df.drop(PART).limit(0).write.parquet(f"{self.store.folder}/{place}/columns")
            self.changes[name, COLUMNS] = [f"{place}/columns"]
        made = self._written(f"{place}/rows")
        for part in made if parts is None else parts:
            self.changes[name, part] = [f"{place}/rows/{PART}={part}"] if part in made else []
        return self.read(name)

    def _written(self, place: str) -> list[str]:
        try:
            found = self.spark.read.schema(f"{PART} string").parquet(f"{self.store.folder}/{place}")
        except AnalysisException:
            return []
        return [r[0] for r in found.select(PART).distinct().collect()]

    def _forget(self, name: str) -> None:
        for part in self.folders(name):
            self.changes[name, part] = []

    def fresh(self, name: str) -> DataFrame | None:
        """Rows in folders that the last committed run had not taken in; None if there are none."""
        seen = set(self.before.get((SEEN, name), []))
        paths = [p for of in self.folders(name).values() for p in of if p not in seen]
        return self.store._frame(paths) if paths else None

    def taken_in(self, *names: str) -> None:
        """Remember, with the commit, which folders of these inputs this run has read."""
        for name in names:
            self.changes[SEEN, name] = [p for of in self.folders(name).values() for p in of]

    def commit(self) -> None:
        self.store.commit(self.changes)
        self.before, self.changes = {**self.before, **self.changes}, {}
