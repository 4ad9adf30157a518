"""Which texts hold which needles as they are: a join on seeds, then an exact check, for any number of needles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafloom.functions.text import tokens
from grafloom.sources.shared import kept

#: Characters of a piece that stands for a needle without inner tokens; least characters of a token that stands for one.
PIECE, TOKEN = 8, 3


def pieces(c: Column, n: int) -> Column:
    """Every run of ``n`` characters, overlapping, in one pass."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def seeded(kind: int) -> Column:
    """(kind, seed) of all seeds of a kind that a text ``t`` holds."""
    found = tokens(F.col("t")) if kind == 0 else pieces(F.col("t"), kind)
    return F.transform(F.array_distinct(found), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("seed")))


def containing(texts: DataFrame, id_col: str, text_col: str, needles: DataFrame, needle_col: str) -> DataFrame:
    """(id, needle) of all pairs where the text holds the needle; equal needles count once, null and empty ones are held by
    none, and so is any by a null text.

    A text that holds a needle holds all its tokens but the first and the last as whole tokens, so each of these may be
    its seed; a needle without an inner token has its pieces of ``PIECE`` characters as seeds, a shorter one itself.
    Which texts hold which seeds of any needle is found in one pass over them and written; of a needle's seeds the one
    that the fewest texts hold is taken, and a needle with a seed that no text holds goes.  What meets is checked: a text
    meets only needles whose rarest seed it holds, and texts that hold none stay where they are.
    """
    some = needles.select(F.col(needle_col).alias("needle")).filter("needle <> ''").distinct()
    inner = F.filter(F.slice(tokens(F.col("needle")), F.lit(2), F.greatest(F.size(tokens(F.col("needle"))) - 2, F.lit(0))), lambda t: F.length(t) >= TOKEN)
    kinds = some.select("needle", inner.alias("inner"))
    long = F.length("needle") >= PIECE
    own = F.when(F.size("inner") > 0, F.array_distinct("inner")).when(long, F.array_distinct(pieces(F.col("needle"), PIECE))).otherwise(F.array("needle"))
    kind = F.when(F.size("inner") > 0, 0).when(long, PIECE).otherwise(F.length("needle"))
    rows = kinds.select("needle", kind.alias("kind"), F.explode(own).alias("seed"))
    held = texts.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("t is not null")
    known = sorted(r.kind for r in rows.select("kind").distinct().collect())  # PIECE + 1 values at most
    cut = [seeded(k) for k in known]
    if not cut:
        return held.join(some.withColumnRenamed("needle", needle_col), F.lit(False)).select(F.col("i").alias(id_col), needle_col)
    rows = kept(rows)
    found = held.select("i", F.explode(F.flatten(F.array(*cut))).alias("x")).select("i", "x.*")
    found = kept(found.join(rows.select("kind", "seed").distinct(), ["kind", "seed"], "left_semi"))
    often = found.groupBy("kind", "seed").agg(F.count(F.lit(1)).alias("n"))
    counted = rows.join(often, ["kind", "seed"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    seeds = counted.groupBy("needle", "kind").agg(F.min_by(F.struct("seed", "n"), F.struct("n", "seed")).alias("x"))
    seeds = seeds.select("needle", "kind", "x.*").filter("n > 0").drop("n")
    placed = found.join(seeds, ["kind", "seed"]).select("i", "needle")
    return placed.join(held, "i").filter(F.contains("t", "needle")).select(F.col("i").alias(id_col), F.col("needle").alias(needle_col))
