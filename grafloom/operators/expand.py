"""Expansion of scores along a graph: ancestors, outgoing and some incoming edges, each with its weight."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grafloom.functions.words import OTHER_WEIGHT, RELATIONS
from grafloom.sources.shared import kept

#: Depth to which ancestors are followed by scores.
NEAR = 4


def relation_table(spark: SparkSession) -> DataFrame:
    """The fixed relations: native, rel_type, weight, out, rev."""
    return spark.createDataFrame(list(RELATIONS), "native string, rel_type string, weight double, out boolean, rev boolean")


def ancestors(parents: DataFrame, depth: int | None = None, of: DataFrame | None = None) -> DataFrame:
    """(node, ancestor, depth) from (node, parent), each ancestor at its least depth: of all nodes or those in ``of``, up to
    ``depth`` steps or to the top.

    With a depth, the steps are unrolled in one plan.  Without one, each step is written and the walk ends with the step
    that reaches no new ancestor, so cycles end too.
    """
    links = parents.filter("parent is not null").select("node", "parent").distinct()
    start = links if of is None else links.join(of.select("node").distinct(), "node", "left_semi")
    step = start.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    up = links.select(F.col("node").alias("ancestor"), "parent")
    if depth is not None:
        steps = [step]
        for k in range(2, depth + 1):
            step = step.join(up, "ancestor").select("node", F.col("parent").alias("ancestor"), F.lit(k).alias("depth"))
            steps.append(step)
        every = reduce(DataFrame.unionByName, steps).filter(F.col("node") != F.col("ancestor"))
        return every.groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
    step = seen = kept(step.filter(F.col("node") != F.col("ancestor")))
    k = 1
    while not step.isEmpty():
        k += 1
        reached = step.join(up, "ancestor").select("node", F.col("parent").alias("ancestor")).distinct().filter(F.col("node") != F.col("ancestor"))
        step = kept(reached.join(seen, ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(k)))
        seen = seen.unionByName(step)
    return seen


def path_labels(nodes: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """(node, path_label) from (node, parent, label, kind): labels from the top down to the node."""
    chain = ancestors(nodes.select("node", "parent")).unionByName(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")))
    labels = nodes.filter(~F.col("kind").isin(*skip)).select(F.col("node").alias("ancestor"), "label")
    joined = chain.join(labels, "ancestor").select("node", F.struct((-F.col("depth")).alias("d"), "label").alias("x"))
    return joined.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("x")).getField("label"), " > ").alias("path_label"))


def expand(seeds: DataFrame, parents: DataFrame, edges: DataFrame, query_col: str) -> DataFrame:
    """(query, node, score): the seeds' scores and what reaches other nodes from them, each node's largest.

    ``seeds`` is (query, node, score), ``edges`` (source, target, rel).  Each way is an equi-join; no OR-joins.
    """
    spark = seeds.sparkSession
    relations = F.broadcast(relation_table(spark))  # 26 fixed rows
    typed = edges.join(relations.select(F.col("rel_type").alias("rel"), "weight", "out", "rev"), "rel", "left").withColumn("weight", F.coalesce("weight", F.lit(OTHER_WEIGHT)))
    up = ancestors(parents, NEAR, seeds).withColumn("weight", F.greatest(F.lit(0.32), 0.9 - (F.col("depth") - 1) * 0.12))
    out = typed.filter("out").select(F.col("source").alias("node"), F.col("target").alias("to"), "weight")
    back = typed.filter("rev").select(F.col("target").alias("node"), F.col("source").alias("to"), "weight")
    ways = up.select("node", F.col("ancestor").alias("to"), "weight").unionByName(out).unionByName(back)
    reached = seeds.join(ways, "node").select(query_col, F.col("to").alias("node"), (F.col("score") * F.col("weight")).alias("score"))
    return seeds.select(query_col, "node", "score").unionByName(reached).groupBy(query_col, "node").agg(F.max("score").alias("score"))


#: Chunks that the nodes of one question bring at most, and the kinds that come first.
FETCHED = 250
FIRST = ("article", "clause", "point", "sliding")


def fetch(nodes: DataFrame, chunks: DataFrame, query_col: str, id_col: str, *more: str) -> DataFrame:
    """(query, id, score, more columns of ``nodes``) of the chunks (id, node_id, chunk_type, ordinal) of scored nodes
    (query, node, score): ``FETCHED`` of a question at most, by kind, ordinal and id; articles score a little more."""
    from pyspark.sql import Window

    kind = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in FIRST]), F.col("chunk_type")), F.lit(0))
    joined = nodes.join(chunks.select(id_col, "node_id", "chunk_type", "ordinal"), F.col("node") == F.col("node_id"))
    order = Window.partitionBy(query_col).orderBy(F.when(kind == 0, 9).otherwise(kind), "ordinal", id_col)
    some = joined.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= FETCHED)
    return some.select(query_col, id_col, (F.col("score") + F.when(F.col("chunk_type") == "article", 0.08).otherwise(F.lit(0.0))).alias("score"), *more)


def best_chunk(chunks: DataFrame) -> DataFrame:
    """(node_id, chunk_id): of each node the chunk of the best kind, then the least ordinal, then id."""
    order = ("point", "clause", "article", "sliding", "document_intro", "structure", "semantic")
    kind = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), F.col("chunk_type")), F.lit(0))
    kind = F.when(kind == 0, len(order) + 1).otherwise(kind)
    return chunks.groupBy("node_id").agg(F.min_by("chunk_id", F.struct(kind.alias("k"), "ordinal", "chunk_id")).alias("chunk_id"))


def expand_local(base: DataFrame, parents: DataFrame, edges: DataFrame, chunks: DataFrame, query_col: str, found: DataFrame | None = None) -> DataFrame:
    """(query, chunk_id, score, reasons) from base chunks (query, chunk_id, node_id, score, place); ``found`` has the reasons
    (query, chunk_id, reasons) of all chunks that were retrieved, also those that are no base.

    Ways are followed in order: for each base chunk by its place, first itself, then its ancestors (nearest first), then
    the edges of its node and of its ancestors (by relation and end).  Ancestors weigh by what they are and by their
    depth, edges by their relation; those that may be followed backwards are, unless they start at the same nodes.  A
    chunk keeps the score of its best way, its own reasons, the reason of that way, and those of later ones.
    """
    best = best_chunk(chunks).join(chunks.select("chunk_id", "chunk_type"), "chunk_id")
    to = best.select(F.col("node_id").alias("to"), F.col("chunk_id").alias("to_chunk"), "chunk_type")
    chain = ancestors(parents, of=base.select(F.col("node_id").alias("node")))
    deep = F.greatest(F.lit(0.28), 0.72 - F.col("depth") * 0.1)
    weight = F.when(F.col("chunk_type") == "article", 1.05).when(F.col("chunk_type") == "clause", 0.9).when(F.col("chunk_type") == "structure", 0.38).otherwise(deep)
    up = chain.withColumnRenamed("ancestor", "to").join(to, "to").select("node", "to_chunk", weight.alias("w"), F.lit(1).alias("kind"), F.col("depth").alias("pos"), F.lit("").alias("key"), F.lit("ancestor").alias("reason"))
    roots = chain.select("node", F.col("ancestor").alias("near")).unionByName(base.select(F.col("node_id").alias("node")).distinct().select("node", F.col("node").alias("near")))
    relations = F.broadcast(relation_table(edges.sparkSession)).select(F.col("rel_type").alias("rel"), F.col("weight").alias("w"), "rev")  # 26 fixed rows
    typed = edges.filter("rel <> 'ISSUED_BY'").join(relations, "rel", "left").withColumn("w", F.coalesce("w", F.lit(OTHER_WEIGHT)))
    out = typed.select(F.col("source").alias("near"), F.col("target").alias("to"), "w", "rel").join(roots, "near")
    back = typed.filter("rev").select(F.col("target").alias("near"), F.col("source").alias("to"), "w", "rel").join(roots, "near")
    back = back.join(roots.select("node", F.col("near").alias("to")), ["node", "to"], "left_anti")
    side = out.select("node", "to", "w", "rel").unionByName(back.select("node", "to", "w", "rel")).join(to, "to")
    side = side.select("node", "to_chunk", "w", F.lit(2).alias("kind"), F.lit(0).alias("pos"), F.concat_ws(":", "rel", "to").alias("key"), F.concat(F.lit("edge:"), "rel").alias("reason"))
    ways = base.join(up.unionByName(side), base["node_id"] == F.col("node"))
    order = lambda *c: F.struct("place", *c).alias("o")
    reached = ways.select(query_col, F.col("to_chunk").alias("chunk_id"), order("kind", "pos", "key"), (F.col("score") * F.col("w")).alias("score"), "reason")
    own = base.select(query_col, "chunk_id", order(F.lit(0).alias("kind"), F.lit(0).alias("pos"), F.lit("").alias("key")), "score", F.lit("base").alias("reason"))
    lists = own.unionByName(reached).groupBy(query_col, "chunk_id").agg(F.array_sort(F.collect_list(F.struct("o", "score", "reason"))).alias("ways"))
    start = F.struct(F.lit(None).cast("double").alias("score"), F.array().cast("array<string>").alias("reasons"))
    better = lambda s, x: s["score"].isNull() | (x["score"] > s["score"])
    fold = F.aggregate("ways", start, lambda s, x: F.struct(F.when(better(s, x), x["score"]).otherwise(s["score"]).alias("score"), F.when(better(s, x), F.array(x["reason"])).otherwise(F.concat(s["reasons"], F.array(x["reason"]))).alias("reasons")))
    folded = lists.select(query_col, "chunk_id", fold.alias("x"))
    if found is None:
        return folded.select(query_col, "chunk_id", "x.score", F.array_distinct("x.reasons").alias("reasons"))
    known = found.select(query_col, "chunk_id", F.col("reasons").alias("own"))
    return folded.join(known, [query_col, "chunk_id"], "left").select(query_col, "chunk_id", "x.score", F.array_distinct(F.concat(F.coalesce("own", F.array().cast("array<string>")), "x.reasons")).alias("reasons"))


def expand_up(base: DataFrame, parents: DataFrame, chunks: DataFrame, query_col: str, found: DataFrame, depth: int | None = None) -> DataFrame:
    """(query, chunk_id, score, reasons): base chunks and the best chunks of their ancestors, each by its best way only."""
    best = best_chunk(chunks).select(F.col("node_id").alias("ancestor"), F.col("chunk_id").alias("to_chunk"))
    up = ancestors(parents, depth, base.select(F.col("node_id").alias("node"))).join(best, "ancestor")
    weight = F.greatest(F.lit(0.28), 0.72 - F.col("depth") * 0.1)
    order = lambda pos: F.struct(F.col("place"), pos.alias("pos")).alias("o")
    reached = base.join(up, base["node_id"] == up["node"]).select(query_col, F.col("to_chunk").alias("chunk_id"), order(F.col("depth")), (F.col("score") * weight).alias("score"), F.lit("ancestor").alias("reason"))
    every = base.select(query_col, "chunk_id", order(F.lit(0)), "score", F.lit("base").alias("reason")).unionByName(reached)
    first = Window.partitionBy(query_col, "chunk_id").orderBy(F.desc("score"), "o")
    one = every.withColumn("n", F.row_number().over(first)).filter("n = 1")
    own = found.select(query_col, "chunk_id", F.col("reasons").alias("own"))
    return one.join(own, [query_col, "chunk_id"], "left").select(query_col, "chunk_id", "score", F.array_distinct(F.concat(F.coalesce("own", F.array().cast("array<string>")), F.array("reason"))).alias("reasons"))
