"""Graphs of documents: weights, pruning, components and assembly."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import numbers
from folioframe.operators.tables import stored


def canonical_max(edges: DataFrame, least: float = 0.5) -> DataFrame:
    """One edge for each unordered pair, with the greatest weight; weak ones go."""
    pair = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")
    return pair.groupBy("a", "b").agg(F.max("weight").alias("weight")).where(F.col("weight") >= least)


def degrees(edges: DataFrame) -> DataFrame:
    """id and degree of every node that has an edge."""
    return edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def prune(edges: DataFrame, max_nodes: int = 500, max_edges: int = 2000) -> DataFrame:
    """The heaviest edges among the nodes of highest degree; ties by id. The caps are the feature: a view to draw."""
    nodes = degrees(edges).orderBy(F.desc("degree"), "id").limit(max_nodes).select("id")
    inside = edges.join(F.broadcast(nodes.withColumnRenamed("id", "a")), "a", "left_semi").join(F.broadcast(nodes.withColumnRenamed("id", "b")), "b", "left_semi")
    return inside.orderBy(F.desc("weight"), "a", "b").limit(max_edges).select("a", "b", "weight")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every node, lonely ones included. Labels fall to the smallest around them
    and then to their label's own, until none moves; each round's labels are written to the shared folder."""
    both = stored(edges.where("a <> b").select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(nodes.select(F.col("id"), F.col("id").alias("component")).distinct(), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        low = labels.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("new"))
        far = labels.select(F.col("id").alias("new"), F.col("component").alias("far"))
        after = stored(low.join(far, "new", "left").select("id", "was", F.least("new", F.coalesce("far", "new")).alias("component")), "labels")
        labels = after.select("id", "component")
        if not after.where("component <> was").limit(1).count():
            return labels


def dominant(members: DataFrame, value: str) -> DataFrame:
    """The most frequent value of each component, ties by name."""
    counts = members.groupBy("component", value).agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("n"), value))
    return counts.withColumn("r", first).where("r = 1").select("component", F.col(value).alias(f"dominant_{value}"))


def co_occurrence(baskets: DataFrame, basket: str, item: str) -> DataFrame:
    """Unordered pairs of distinct items that share a basket, and how many baskets they share."""
    sets = baskets.select(basket, item).distinct()
    other = sets.select(basket, F.col(item).alias("b"))
    pairs = sets.select(basket, F.col(item).alias("a")).join(other, basket).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("weight", numbers.saturating_weight(F.col("n")))


def similarity_edges(vectors: DataFrame, least: float, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 4096) -> DataFrame:
    """All pairs of vectors whose inner product, brought to 0..1, is least or more. Vectors are cut into blocks, and
    each pair of blocks is one product of matrices; only pairs that pass leave it."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    n = max(1, -(-rows.count() // block))
    own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(own.alias("x"), F.col("id").alias("left_id"), F.col("v").alias("left_v"), other.alias("y")).where("x <= y")
    right = rows.select(own.alias("y"), F.col("id").alias("right_id"), F.col("v").alias("right_v"), other.alias("x")).where("x <= y")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "weight": pd.Series(dtype="float64")})
        p = np.clip(np.stack(a["left_v"]).astype(np.float64) @ np.stack(b["right_v"]).astype(np.float64).T, 0, 1)
        i, j = np.nonzero(p >= least)
        ids = a["left_id"].to_numpy()[i], b["right_id"].to_numpy()[j]
        keep = ids[0] < ids[1] if (a["x"].iloc[0] == b["y"].iloc[0]) else ids[0] != ids[1]
        lo, hi = np.minimum(*ids)[keep], np.maximum(*ids)[keep]
        return pd.DataFrame({"a": lo, "b": hi, "weight": p[i, j][keep]})

    return left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(run, "a bigint, b bigint, weight double")


def force_layout(ids: list[int], edges: list[tuple[int, int, float]], rounds: int = 200, seed: int = 1) -> dict[int, tuple[float, float]]:
    """Positions for a graph that is small enough to draw (after prune): springs along edges, repulsion elsewhere."""
    rng, at = np.random.default_rng(seed), {k: i for i, k in enumerate(ids)}
    xy = rng.uniform(-1, 1, (len(ids), 2))
    a, b = (np.array([at[e[i]] for e in edges], int) for i in (0, 1))
    w = np.array([e[2] for e in edges])
    for step in range(rounds if len(ids) > 1 else 0):
        d = xy[:, None] - xy[None]
        far = np.maximum((d**2).sum(-1), 1e-4)
        push = (d / far[..., None]).sum(1) / len(ids)
        if len(edges):
            pull = (xy[b] - xy[a]) * w[:, None]
            np.add.at(push, a, pull)
            np.add.at(push, b, -pull)
        xy += push * 0.1 * (1 - step / rounds)
    return {k: tuple(map(float, p)) for k, p in zip(ids, xy)}


