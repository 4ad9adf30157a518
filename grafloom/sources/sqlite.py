"""SQLite databases as tables: a scan split by row numbers with predicates pushed into it, and files written by tasks.

A path names one database file or, with ``*``, many of the same table; every executor must see it at the same place.  A
file is opened read-only.  Its rows are dealt by ranges of their row numbers; tables without row numbers are read whole.
Comparisons of a column with a value go into the scan where both are of one type, so that SQLite decides them as Spark
would (texts by bytes, whatever the column's collation); others stay with Spark.

Cases: types follow SQLite's rules for declared types (integers are bigint, floating ones double, texts string, blobs
binary; columns without a known type are string); a value that does not fit its column's type is null, or an error with
``mode`` ``failfast``; a table without rows gives none; a path without files, and files without the table, are errors.
"""

from __future__ import annotations

import glob
import os
import sqlite3
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith

#: Rows of a batch, and of a range at least.
ROWS, LEAST = 8192, 50_000
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
PYTHON = {T.LongType: int, T.DoubleType: float, T.StringType: str, T.BinaryType: bytes}
ARROW = {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BinaryType: pa.binary()}


def opened(path: str) -> sqlite3.Connection:
    from urllib.parse import quote

    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def kind(declared: str) -> T.DataType:
    """The type of a column by its declaration."""
    d = declared.upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if "BLOB" in d:
        return T.BinaryType()
    return T.DoubleType() if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else T.StringType()


class Range(InputPartition):
    def __init__(self, path: str, low: int | None, high: int | None):
        self.path, self.low, self.high = path, low, high


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").option("path", ...).option("dbtable", ...)``; ``ranges`` is how many parts a file is
    read in at most, ``least`` how many rows one has."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def files(self) -> list[str]:
        path = self.options["path"].removeprefix("file://")
        found = sorted(glob.glob(path)) if "*" in path else [path] if os.path.exists(path) else []
        if not found:
            raise FileNotFoundError(f"no database at {path}")
        return found

    def schema(self) -> T.StructType:
        with opened(self.files()[0]) as c:
            rows = c.execute(f"PRAGMA table_info({name(self.options['dbtable'])})").fetchall()
        if not rows:
            raise ValueError(f"no table {self.options['dbtable']} in {self.files()[0]}")
        return T.StructType([T.StructField(r[1], kind(r[2] or ""), True) for r in rows])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(schema, self.files(), self.options["dbtable"], int(self.options.get("ranges", 16)), int(self.options.get("least", LEAST)), self.options.get("mode", "permissive").lower() == "failfast")


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, files: list[str], table: str, ranges: int, least: int, strict: bool):
        self.schema, self.files, self.table, self.ranges, self.least, self.strict = schema, files, table, ranges, least, strict
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self.push(f):
                yield f

    def push(self, f: Filter) -> bool:
        if len(f.attribute) != 1 or f.attribute[0] not in self.schema.fieldNames():
            return False
        field = self.schema[f.attribute[0]]
        wanted, column = PYTHON[type(field.dataType)], f"{name(field.name)} COLLATE BINARY"
        stored = {int: "integer", float: "real", str: "text", bytes: "blob"}[wanted]
        fits = f"typeof({name(field.name)}) = '{stored}'"  # a value of another type is null to Spark
        ok = lambda v: type(v) is wanted and not (wanted is int and abs(v) >= 1 << 63) and v == v
        if isinstance(f, IsNull) or isinstance(f, IsNotNull):
            self.where.append(f"NOT ({fits})" if isinstance(f, IsNull) else fits)
        elif type(f) in COMPARED and wanted is not float and ok(f.value):
            self.where.append(f"({fits} AND {column} {COMPARED[type(f)]} ?)")
            self.values.append(f.value)
        elif isinstance(f, In) and wanted is not float and f.value and len(f.value) <= 500 and all(ok(v) for v in f.value):
            self.where.append(f"({fits} AND {column} IN ({', '.join('?' * len(f.value))}))")
            self.values += f.value
        elif isinstance(f, StringStartsWith) and wanted is str:
            self.where.append(f"({fits} AND substr({name(field.name)}, 1, {len(f.value)}) = ? COLLATE BINARY)")
            self.values.append(f.value)
        else:
            return False
        return True

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.files:
            with opened(path) as c:
                try:
                    low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {name(self.table)}").fetchone()
                except sqlite3.OperationalError as e:
                    if "rowid" not in str(e):
                        raise
                    out.append(Range(path, None, None))  # a table without row numbers
                    continue
            if low is None:
                continue
            step = max(self.least, -(-(high - low + 1) // self.ranges))
            out += [Range(path, a, min(a + step - 1, high)) for a in range(low, high + 1, step)]
        return out or [Range(self.files[0], 0, -1)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fields = self.schema.fields
        where, values = list(self.where), list(self.values)
        if partition.low is not None:
            where.append("rowid BETWEEN ? AND ?")
            values += [partition.low, partition.high]
        text = f"SELECT {', '.join(name(f.name) for f in fields)} FROM {name(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else "")
        with opened(partition.path) as c:
            found = c.execute(text, values)
            while rows := found.fetchmany(ROWS):
                columns = [pa.array([self.fitted(v, f.dataType) for v in column], ARROW[type(f.dataType)]) for f, column in zip(fields, zip(*rows))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    def fitted(self, value, data_type: T.DataType):
        if value is None or type(value) is PYTHON[type(data_type)]:
            return value
        if self.strict:
            raise ValueError(f"{value!r} is no {data_type.simpleString()}")
        return None


def sqlite_table(spark: SparkSession, path: str, table: str, ranges: int = 16, mode: str = "permissive", least: int = LEAST) -> DataFrame:
    """The rows of a table of one database file or, with ``*``, of many."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("dbtable", table).option("ranges", ranges).option("mode", mode).option("least", least).load()


def write_sqlite(df: DataFrame, folder: str, table: str) -> list[str]:
    """One database file a task below ``folder``, which all executors must see; a file appears under its name only when it
    is whole, and a repeated task replaces it.  Integers, floats, texts, blobs and truths are stored as such, others as
    texts.  Returns the files' names."""
    target = folder.removeprefix("file://")
    os.makedirs(target, exist_ok=True)
    stored = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    named = [(c, stored.get(t, "TEXT")) for c, t in df.dtypes]
    plain = df.select(*(df[c] if t in stored else df[c].cast("string").alias(c) for c, t in df.dtypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        done = f"part-{context.partitionId():05d}.db"
        open_ = f"{target}/.{done}.{context.taskAttemptId()}"
        c = sqlite3.connect(open_)
        c.execute(f"CREATE TABLE {name(table)} ({', '.join(f'{name(x)} {t}' for x, t in named)})")
        for batch in batches:
            c.executemany(f"INSERT INTO {name(table)} VALUES ({', '.join('?' * len(named))})", zip(*(column.to_pylist() for column in batch.columns)))
        c.commit()
        c.close()
        os.replace(open_, f"{target}/{done}")
        yield pa.RecordBatch.from_arrays([pa.array([done])], names=["file"])

    return sorted(r.file for r in plain.mapInArrow(run, "file string").collect())  # one a task
