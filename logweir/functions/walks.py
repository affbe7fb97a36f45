"""Embeddings of hosts and accounts: random walks with word2vec, and snapshot propagation for link scores."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.functions.features import snapshot_edges, snapshot_weights
from logweir.functions.scorers import IsolationForest
from logweir.sources.shared import cut


def dealt_arcs(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, bin, near) and (a, total, arcs): each node's arcs in as many bins of equal weight as it has arcs; an arc is in every bin that its part of the running weight meets.

    A draw is as likely in one bin as in another, and arcs and bins make at most 4 entries an arc, so the list
    that a step of a walk reads has four entries on average, however many neighbours a node has. An entry holds its
    end of the running weight and, of the neighbour, all weight and all arcs, for the next step.
    """
    two = edges.select(F.concat(F.lit("u:"), "user").alias("a"), F.concat(F.lit("m:"), "machine").alias("b"), "weight")
    arcs = two.unionByName(two.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    arcs = arcs.groupBy("a", "b").agg(F.sum("weight").cast("double").alias("weight"))
    totals = arcs.groupBy("a").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("arcs"))
    w = Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    arcs = arcs.withColumn("hi", F.sum("weight").over(w)).join(totals, "a")
    arcs = arcs.join(totals.select(F.col("a").alias("b"), F.col("total").alias("b_total"), F.col("arcs").alias("b_arcs")), "b", "left")
    bin_of = lambda x: F.least(F.floor(x / F.col("total") * F.col("arcs")), F.col("arcs") - 1)
    # a bin more on either side: rounding of the division never parts a draw from its arc
    bins = F.sequence(F.greatest(bin_of(F.col("hi") - F.col("weight")) - 1, F.lit(0)), F.least(bin_of(F.col("hi")) + 1, F.col("arcs") - 1))
    entry = F.struct("hi", "b", "b_total", "b_arcs")
    return arcs.select("a", F.explode(bins).alias("bin"), entry.alias("x")).groupBy("a", "bin").agg(F.array_sort(F.collect_list("x")).alias("near")), totals


def random_walks(edges: DataFrame, length: int, per_node: int, seed: int) -> DataFrame:
    """(walk, nodes): weighted first-order walks. Each step is a join with the few arcs of the draw's bin; draws are hashes, so reruns agree."""
    lists, totals = (cut(x) for x in dealt_arcs(edges))
    walks = totals.filter("a is not null").withColumn("nth", F.explode(F.sequence(F.lit(1), F.lit(per_node))))
    walks = walks.select(F.concat_ws("#", "a", "nth").alias("walk"), F.array("a").alias("nodes"), "a", "total", "arcs")
    for step in range(length - 1):
        draw = F.pmod(F.xxhash64("walk", F.lit(step), F.lit(seed)), F.lit(1_000_000)) / 1_000_000 * F.col("total")
        at = walks.withColumn("draw", draw).withColumn("bin", F.least(F.floor(F.col("draw") / F.col("total") * F.col("arcs")), F.col("arcs") - 1))
        at = at.join(lists, ["a", "bin"])
        picked = F.coalesce(F.get(F.filter("near", lambda x: x["hi"] > F.col("draw")), F.lit(0)), F.element_at("near", -1))
        at = at.select("walk", "nodes", picked.alias("x"))
        walks = at.select("walk", F.concat("nodes", F.array("x.b")).alias("nodes"), F.col("x.b").alias("a"), F.col("x.b_total").alias("total"), F.col("x.b_arcs").alias("arcs"))
    return walks.select("walk", "nodes")


def embed(edges: DataFrame, dims: int = 64, length: int = 10, per_node: int = 5, seed: int = 0) -> DataFrame:
    """(word, vector) of every node."""
    walks = cut(random_walks(edges, length, per_node, seed))
    parts = max(1, min(256, walks.count() * length // 10_000_000))  # one partition trains alone up to ten million steps
    return Word2Vec(vectorSize=dims, minCount=0, seed=seed, inputCol="nodes", outputCol="v", numPartitions=parts).fit(walks).getVectors()


def walk_scores(train_edges: DataFrame, df: DataFrame, dims: int = 64, length: int = 10, per_node: int = 5, seed: int = 0) -> DataFrame:
    """(event_id, score): an isolation forest on the vectors of an event's user and destination, learned from walks on the training graph and fitted on its edges; ends not in it have zeros."""
    vectors = embed(train_edges, dims, length, per_node, seed)
    vectors = cut(vectors.select("word", vector_to_array("vector").alias("v")))
    zeros = F.array_repeat(F.lit(0.0), dims)
    names = [f"{side}{i}" for side in "um" for i in range(dims)]

    def wide(rows: DataFrame, user: str, machine: str) -> DataFrame:
        for side, column, mark in (("u", user, "u:"), ("m", machine, "m:")):
            own = vectors.select(F.col("word").alias("_w"), F.col("v").alias(f"_{side}"))
            rows = rows.join(own, F.concat(F.lit(mark), F.col(column)) == F.col("_w"), "left").drop("_w")
        return rows.select("event_id", *[F.round(F.get(F.coalesce(f"_{s}", zeros), F.lit(i)), 9).alias(f"{s}{i}") for s in "um" for i in range(dims)])

    fitted = train_edges.groupBy("user", "machine").agg(F.sum("weight").alias("weight")).withColumn("event_id", F.xxhash64("user", "machine"))
    forest = IsolationForest(names, seed=seed).fit(cut(wide(fitted, "user", "machine")))
    return forest.score(cut(wide(df, "src_user", "dst_computer"))).select("event_id", "score")


def link_scores(df: DataFrame, dims: int = 8) -> DataFrame:
    """(event_id, score): how unlike the previous half hour's graph an event's link is.

    Each host has a fixed pseudo-random vector; one propagation over the previous snapshot's weighted links
    (normalised by both ends' strengths) gives its embedding, and the score is minus the dot product of the
    two ends, 0 where either was not seen.
    """
    edges = snapshot_weights(snapshot_edges(df)).select("snapshot", "src", "dst", "weight")
    both = edges.select("snapshot", F.col("src").alias("a"), F.col("dst").alias("b"), "weight").unionByName(edges.select("snapshot", F.col("dst").alias("a"), F.col("src").alias("b"), "weight"))
    strength = both.groupBy("snapshot", "a").agg(F.sum("weight").alias("s"))
    norm = both.join(strength, ["snapshot", "a"]).join(strength.select("snapshot", F.col("a").alias("b"), F.col("s").alias("t")), ["snapshot", "b"])
    flow = norm.withColumn("w", F.col("weight") / F.sqrt(F.col("s") * F.col("t")))
    sums = [F.round(F.sum(F.col("w") * (F.pmod(F.xxhash64("b", F.lit(i)), F.lit(2001)) / 1000 - 1)), 9).alias(f"z{i}") for i in range(dims)]
    z = flow.groupBy("snapshot", "a").agg(*sums).select("snapshot", "a", F.array(*[f"z{i}" for i in range(dims)]).alias("z"))
    rows = df.select("event_id", (F.floor(F.col("time") / 1800) - 1).alias("snapshot"), "src_computer", "dst_computer")
    rows = rows.join(z.select("snapshot", F.col("a").alias("src_computer"), F.col("z").alias("zs")), ["snapshot", "src_computer"], "left")
    rows = rows.join(z.select("snapshot", F.col("a").alias("dst_computer"), F.col("z").alias("zd")), ["snapshot", "dst_computer"], "left")
    dot = F.aggregate(F.zip_with("zs", "zd", lambda p, q: p * q), F.lit(0.0), lambda acc, x: acc + x)
    return rows.select("event_id", F.round(F.coalesce(-dot, F.lit(0.0)), 6).alias("score"))
