"""Tables in parts, changed part by part, under one manifest.

A part is a value of an SQL expression over a row (a key's bucket, a day).  It lies in folders of runs that are never
written again.  A change writes new runs, then one manifest row names the runs of every part of every table: so all its
tables change at once, a change that breaks leaves nothing behind that a reader sees, and a reader keeps what it opened.
Only the parts that a change touches are read and written; whole parts are dropped without either.

The manifest's rows are as long as there are parts, never as there are rows.  One writer at a time: of two that began
from the same row, the second to commit is refused if the first has ended by then.

Cases: a null part is a part of its own; a change without rows of a table leaves that table; null is a key like others;
of several new rows with one key none is chosen, all are kept; a store is opened with the parts that it was begun with.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "number long, name string, parts map<string,array<string>>, applied map<string,long>, layout map<string,string>"
#: The part of rows whose expression is null.
NONE = "none"


def hashed(key: str, parts: int) -> str:
    """The expression of a table in ``parts`` buckets of a key."""
    return f"pmod(xxhash64({key}), {parts})"


@dataclass(frozen=True)
class Table:
    schema: str
    by: str

    def part(self) -> Column:
        return F.coalesce(F.expr(self.by).cast("string"), F.lit(NONE))


@dataclass(frozen=True)
class State:
    """What a manifest row says: the runs of every part as ``table/part``, and of every stream the last batch applied."""

    number: int = 0
    name: str = ""
    parts: dict[str, list[str]] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table], number: int | None = None) -> None:
        """The store in ``path`` as it is now, or as the manifest row of that number left it."""
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables
        self.state = self._latest(number)

    def _latest(self, number: int | None = None) -> State:
        rows = self.spark.read.schema(MANIFEST)
        try:
            found = rows.parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return State()
        if number is not None:
            found = found.filter(F.col("number") == number)
        last = found.orderBy(F.desc("number"), F.desc("name")).first()
        if last is None and number is not None:
            raise ValueError(f"no state {number} at {self.path}")
        layout = {name: t.by for name, t in self.tables.items()}
        if last is not None and last.layout != layout:
            raise ValueError(f"the tables at {self.path} are in parts by {last.layout}")
        return State() if last is None else State(last.number, last.name, dict(last.parts), dict(last.applied))

    def parts(self, table: str) -> list[str]:
        return sorted(p.split("/", 1)[1] for p in self.state.parts if p.split("/", 1)[0] == table)

    def runs(self, table: str, part: str) -> list[str]:
        return self.state.parts.get(f"{table}/{part}", [])

    def read(self, table: str, parts: list[str] | None = None) -> DataFrame:
        """The rows of a table, from the folders of the given parts only."""
        chosen = self.parts(table) if parts is None else parts
        folders = [f"{self.path}/runs/{run}/{table}/part={p}" for p in chosen for run in self.runs(table, p)]
        schema = self.tables[table].schema
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def touched(self, table: str, rows: DataFrame) -> list[str]:
        """The parts that rows belong to: as many at most as the table has."""
        return sorted(r.p for r in rows.select(self.tables[table].part().alias("p")).distinct().collect())

    def change(self) -> Change:
        return Change(self)

    def upsert(self, table: str, new: DataFrame, key: str, batch: tuple[str, int] | None = None) -> list[str]:
        """Rows of ``new`` replace those of their key; returns the parts that were written.  The table's parts must be
        a function of the key."""
        if self.done(batch):
            return []
        parts = self.touched(table, new)
        old = self.read(table, parts)
        same = F.col("old_key").eqNullSafe(F.col(key))
        rest = old.join(new.select(F.col(key).alias("old_key")), same, "left_anti")
        change = self.change()
        change.replace(table, rest.unionByName(new.select(*rest.columns)), parts)
        change.commit(batch)
        return parts

    def retain(self, table: str, least: str, condition: Column) -> list[str]:
        """Drops parts below ``least`` unread, and in the part ``least`` itself the rows that fail the condition; parts
        must sort as text as their rows do (days).  Returns the parts that were dropped."""
        gone = [p for p in self.parts(table) if p < least and p != NONE]
        change = self.change()
        change.drop(table, gone)
        if least in self.parts(table):
            change.replace(table, self.read(table, [least]).filter(condition), [least])
        change.commit()
        return gone

    def done(self, batch: tuple[str, int] | None) -> bool:
        return batch is not None and self.state.applied.get(batch[0], -1) >= batch[1]


class Change:
    """Writes of a change; nothing of them is seen before ``commit``."""

    def __init__(self, store: Store) -> None:
        self.store, self.run = store, uuid.uuid4().hex
        self.now = {p: list(runs) for p, runs in store.state.parts.items()}
        self.written = 0

    def _write(self, table: str, rows: DataFrame, deal: bool = True) -> tuple[str, list[str]]:
        """The run's name and the parts that have rows in it.  Rows are dealt by part, large parts to several tasks."""
        self.written += 1
        run, kind = f"{self.run}-{self.written}", self.store.tables[table]
        folder = f"{self.store.path}/runs/{run}/{table}"
        placed = rows.withColumn("part", kind.part())
        (placed.hint("rebalance", F.col("part")) if deal else placed).write.partitionBy("part").parquet(folder)
        held = self.store.spark.read.schema("part string").parquet(folder).distinct().collect()
        return run, [r.part for r in held]

    def append(self, table: str, rows: DataFrame, deal: bool = True) -> DataFrame:
        """Puts rows beside those of their parts, and gives them as they are written.  ``deal`` is false for rows that come
        from a table in the same parts, and so need no exchange."""
        run, parts = self._write(table, rows, deal)
        for p in parts:
            self.now.setdefault(f"{table}/{p}", []).append(run)
        return self.store.spark.read.schema(self.store.tables[table].schema).parquet(f"{self.store.path}/runs/{run}/{table}").drop("part")

    def replace(self, table: str, rows: DataFrame, parts: list[str]) -> None:
        """The given parts hold ``rows`` from now on; rows of other parts are an error."""
        run, held = self._write(table, rows)
        if set(held) - set(parts):
            raise ValueError(f"rows of parts that are not replaced: {sorted(set(held) - set(parts))[:5]}")
        self.drop(table, parts)
        self.now.update({f"{table}/{p}": [run] for p in held})

    def drop(self, table: str, parts: list[str]) -> None:
        for p in parts:
            self.now.pop(f"{table}/{p}", None)

    def commit(self, batch: tuple[str, int] | None = None) -> None:
        store = self.store
        latest = store._latest()
        if latest.name != store.state.name:
            raise RuntimeError(f"{store.path} was changed by another writer since it was opened")
        applied = store.state.applied | ({batch[0]: batch[1]} if batch else {})
        state = State(store.state.number + 1, self.run, self.now, applied)
        row = (state.number, state.name, state.parts, state.applied, {name: t.by for name, t in store.tables.items()})
        store.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{store.path}/manifest")
        store.state = state
