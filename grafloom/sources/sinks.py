"""Writers: an index as published snapshots of Parquet tables with their metadata, exports as JSON lines and CSV."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafloom.operators.merge import assert_compatible, upsert

TABLES = ("docs", "nodes", "edges", "chunks", "postings", "corpus")
#: Tables that lie in folders by a column.
FOLDERS = {"postings": "bucket"}


def write_index(tables: dict[str, DataFrame], path: str, meta: dict[str, str]) -> str:
    """Publishes an index below ``path`` and returns its snapshot's name.

    All tables go to a new folder that nothing refers to; then one row is added to the manifest, by the commit of a single
    file, and names it.  A write that breaks anywhere before leaves the index that was there as it was, and readers that
    have opened it keep reading its folder.  Of two writers at once, both snapshots are whole and the later number holds.
    """
    spark, name = next(iter(tables.values())).sparkSession, uuid.uuid4().hex
    for table, df in tables.items():
        writer = df.write.partitionBy(FOLDERS[table]) if table in FOLDERS else df.write
        writer.parquet(f"{path}/snapshots/{name}/{table}")
    held = manifest(spark, path)
    row = ((held[0][0] if held else 0) + 1, name, meta)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return name


MANIFEST = "number long, snapshot string, meta map<string,string>"


def manifest(spark: SparkSession, path: str) -> list[tuple[int, str, dict[str, str]]]:
    """(number, snapshot, meta) of all published snapshots, the one that holds first."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    return sorted(((r.number, r.snapshot, r.meta) for r in rows), reverse=True, key=lambda r: r[:2])


def read_index(spark: SparkSession, path: str, wanted: dict[str, str] | None = None, snapshot: str | None = None) -> dict[str, DataFrame]:
    """The tables of the snapshot that holds, or of a named one; one of another model, revision or dimension than
    ``wanted`` is an error."""
    for _, name, meta in manifest(spark, path):
        if snapshot in (None, name):
            assert_compatible(meta, wanted or {})
            return {table: spark.read.parquet(f"{path}/snapshots/{name}/{table}") for table in TABLES}
    raise ValueError(f"no index at {path}" if snapshot is None else f"no snapshot {snapshot} at {path}")


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines without vectors."""
    df.drop("vector").write.mode("overwrite").json(path)


def write_csv(frames: list[DataFrame], path: str, columns: list[str] | None = None, marked: bool = True) -> None:
    """CSV files of several results; columns that a result lacks are empty, and with ``columns`` others are left out.
    ``marked`` puts the byte-order mark that spreadsheets look for before each file's first name."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    whole = whole if columns is None else whole.select(*[F.col(c) if c in whole.columns else F.lit(None).cast("string").alias(c) for c in columns])
    if marked:
        first = whole.columns[0]
        whole = whole.withColumnRenamed(first, "\ufeff" + first)
    whole.write.mode("overwrite").option("header", True).csv(path)


def sync_graph(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, old: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables of a graph store after a merge by key; edges whose ends are not both there are left out."""
    merged = {"nodes": upsert(old["nodes"], nodes, "node_id"), "chunks": upsert(old["chunks"], chunks, "chunk_id")}
    ids = merged["nodes"].select("node_id")
    whole = edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
    merged["edges"] = upsert(old["edges"], whole.select(*old["edges"].columns), "edge_id")
    return merged


def sync_all(spark: SparkSession, sinks: dict) -> DataFrame:
    """(sink, status, error): runs every sink; one that fails is reported and does not stop the others."""
    rows = []
    for name, write in sinks.items():
        try:
            write()
            rows.append((name, "ok", None))
        except Exception as e:  # noqa: BLE001
            rows.append((name, "error", str(e)[:500]))
    return spark.createDataFrame(rows, "sink string, status string, error string")


def vector_literal(column: str):
    """A vector as text, for stores that take literals: eight significant digits, no zeros at the end."""
    digits = lambda x: F.regexp_replace(F.format_string("%.8g", x.cast("double")), r"\.?0+(?=e|$)", "")
    return F.concat(F.lit("["), F.array_join(F.transform(column, digits), ","), F.lit("]"))
