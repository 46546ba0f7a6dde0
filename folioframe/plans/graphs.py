"""Graph queries over embeddings, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators import graph
from folioframe.plans.registry import query
from folioframe.session import table

LEAST = 0.35
_E = f"""e AS (SELECT a, b, weight FROM (SELECT x.vec_id AS a, y.vec_id AS b, least(greatest(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 0), 1) AS weight
       FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id) WHERE weight >= {LEAST})"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.similarity_edges(table(spark, sf_dir, "embeddings"), LEAST)


@query("similarity_graph", f"WITH {_E} SELECT a, b, round(weight, 6) AS weight FROM e")
def similarity_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors that are near each other."""
    return _edges(spark, sf_dir).select("a", "b", F.round("weight", 6).alias("weight"))


@query("node_degree", f"WITH {_E} SELECT id, count(*) AS degree FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY 1")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edges each node has."""
    return graph.degrees(_edges(spark, sf_dir))


@query(
    "graph_prune",
    f"""WITH {_E}, n AS (SELECT id FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY 1 ORDER BY count(*) DESC, id LIMIT 100)
        SELECT a, b, round(weight, 6) AS weight FROM e WHERE a IN (FROM n) AND b IN (FROM n) ORDER BY round(weight, 9) DESC, a, b LIMIT 200""",
)
def graph_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest edges among the nodes of highest degree."""
    edges = _edges(spark, sf_dir).withColumn("weight", F.round("weight", 9))
    return graph.prune(edges, 100, 200).select("a", "b", F.round("weight", 6).alias("weight"))


@query(
    "graph_components",
    f"""WITH RECURSIVE {_E}, r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT CASE WHEN e.a = r.id THEN e.b ELSE e.a END, r.c FROM r JOIN e ON e.a = r.id OR e.b = r.id)
        SELECT id, min(c) AS component FROM r GROUP BY 1""",
)
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every vector by its smallest id."""
    nodes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return graph.components(nodes, _edges(spark, sf_dir))


@query(
    "component_summary",
    f"""WITH RECURSIVE {_E}, r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT CASE WHEN e.a = r.id THEN e.b ELSE e.a END, r.c FROM r JOIN e ON e.a = r.id OR e.b = r.id),
        m AS (SELECT id, min(c) AS component FROM r GROUP BY 1), l AS (SELECT component, label, count(*) AS k FROM m JOIN embeddings ON vec_id = id GROUP BY 1, 2)
        SELECT component, sum(k)::BIGINT AS n, first(label ORDER BY k DESC, label) AS dominant_label FROM l GROUP BY 1""",
)
def component_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and dominant label of each component."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    members = graph.components(vectors.select("id"), _edges(spark, sf_dir)).join(vectors, "id")
    return members.groupBy("component").agg(F.count("*").alias("n")).join(graph.dominant(members, "label"), "component")


@query(
    "co_citation",
    """WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n, round(1 - 1 / (1.0::DOUBLE + count(*)), 9) AS weight
       FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2""",
)
def co_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share orders, with a weight that saturates. An order has seven lines at most."""
    return graph.co_occurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey").withColumn("weight", F.round("weight", 9))


@query(
    "edge_kinds",
    """SELECT least(a, b) AS a, greatest(a, b) AS b, max(w) AS weight FROM (SELECT l_suppkey % 50 AS a, l_partkey % 50 AS b, l_discount AS w FROM lineitem) WHERE a <> b GROUP BY 1, 2 HAVING max(w) >= 0.1""",
)
def edge_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel edges folded into the heaviest of each pair."""
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("a"), (F.col("l_partkey") % 50).alias("b"), F.col("l_discount").alias("weight"))
    return graph.canonical_max(edges, 0.1)
