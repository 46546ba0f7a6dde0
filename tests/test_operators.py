"""Search, versions, graphs and tables on small inputs with their edges."""

import datetime as dt
import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from folioframe.operators import graph, search, tables, versions


def ts(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def test_cited_search(spark):
    docs = spark.createDataFrame([(1, "s2", "Phạt hợp đồng", "mức phạt " * 7), (2, "s1", "x", "muc phat"), (3, "s1", "x", "khác"), (4, "s1", "x", "mức phạt"), (5, "s0", None, None)], "doc_id int, source_rel string, heading string, text string")
    got = [(r.citation, r.doc_id, round(r.score, 2)) for r in search.cited_search(docs, "mức phạt", 3, tie="doc_id").orderBy("citation").collect()]
    assert got == [("CITE-0001", 1, 15.0), ("CITE-0002", 2, 2.4), ("CITE-0003", 4, 2.4)]
    assert search.in_scope(docs, "source_rel", []).count() == 5 and search.in_scope(docs, "source_rel", ["s2"]).count() == 1


def test_bm25_counts_prefixes(spark):
    docs = spark.createDataFrame([(1, "alpha alphabet beta"), (2, "beta"), (3, ""), (4, None)], "doc_id int, text string")
    assert [r.doc_id for r in search.bm25(docs, "alpha", 10).collect()] == [1]
    assert search.bm25(docs, "?", 10).count() == 0


def test_vector_top_k(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, [1.0])]
    v = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    got = [(r.vec_id, r.score) for r in search.vector_top_k(v, v.where("vec_id = 0"), 4).orderBy("rank").collect()]
    assert got == [(2, 1.0), (1, 0.0), (4, 0.0), (3, -1.0)]
    with pytest.raises(ValueError):
        search.vector_top_k(v, v, 1, max_queries=3)


def test_merge_legs(spark):
    a, b = (spark.createDataFrame(r, "id string, rank int, score double") for r in ([("x", 0, 2.0), ("y", 1, 1.0)], [("y", 0, 0.9)]))
    got = {r.id: (r.lexical_rank, r.vector_rank, r.vector_score) for r in search.merge_legs(a, b, "id").collect()}
    assert got == {"x": (0, None, 0.0), "y": (1, 0, 0.9)}


def test_versions(spark):
    v = spark.createDataFrame([("a", 1, ts(0)), ("a", 2, ts(10)), ("a", 3, ts(10)), ("b", 1, ts(5))], "k string, n int, at timestamp")
    got = {r.k: r.n for r in versions.as_of(v, "k", "at", F.lit(ts(10)), "n").collect()}
    assert got == {"a": 3, "b": 1} and {r.k for r in versions.as_of(v, "k", "at", F.lit(ts(4)), "n").collect()} == {"a"}
    ended = v.withColumn("until", F.when(F.col("n") == 3, F.lit(ts(12))))
    assert {r.k: r.n for r in versions.as_of(ended, "k", "at", F.lit(ts(12)), "n", "until").collect()} == {"a": 2, "b": 1}
    done = {(r.k, r.n): (r.effective_to, r.is_current) for r in versions.published(v, "k", "at", "n").collect()}
    assert done[("a", 1)] == (ts(10), False) and done[("a", 3)] == (None, True)
    points = spark.createDataFrame([("a", ts(-1)), ("a", ts(10)), ("c", ts(3))], "k string, at timestamp").withColumnRenamed("at", "asked")
    joined = {(r.k, r.asked): r.version_n for r in versions.as_of_join(points, v, "k", "asked", "at", "n", ["n"]).collect()}
    assert joined == {("a", ts(-1)): None, ("a", ts(10)): 3, ("c", ts(3)): None}
    assert versions.publication_errors(v, "at", F.lit(ts(7))).count() == 2


def test_interval_conflicts(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, s := rng.randrange(200), s + rng.randrange(1, 90), rng.choice([1, 2, None])) for i in range(60)]
    df = spark.createDataFrame([(k, i, ts(s), ts(e), v) for k, i, s, e, v in rows], "k string, i int, s timestamp, e timestamp, v int")
    got = sorted((r.a_id, r.b_id) for r in versions.interval_conflicts(df, ["k"], "s", "e", "v", "i").collect())
    assert got == sorted((x[1], y[1]) for x, y in itertools.combinations(rows, 2) if x[0] == y[0] and x[2] < y[3] and y[2] < x[3] and x[4] != y[4])


def test_transitions_and_invariants(spark):
    df = spark.createDataFrame([("draft", "uploaded"), ("draft", "published")], "a string, b string")
    assert [r.x for r in df.select(versions.allowed_transition(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False]
    v = spark.createDataFrame([("a", True, ts(0), None), ("b", False, ts(0), None), ("c", True, ts(0), ts(1)), ("d", True, ts(9), None)], "k string, cur boolean, s timestamp, e timestamp")
    assert {r.k for r in versions.invariant_violations(v, "k", "cur", "s", "e", F.lit(ts(5))).collect()} == {"b", "c", "d"}


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.6), (2, 3, 0.7), (5, 6, 0.4), (4, 4, 1.0)], "a long, b long, weight double")
    one = graph.canonical_max(edges)
    assert sorted(map(tuple, one.collect())) == [(1, 2, 0.9), (2, 3, 0.7)]
    assert {r.id: r.degree for r in graph.degrees(one).collect()} == {1: 1, 2: 2, 3: 1}
    nodes = spark.createDataFrame([(i, "c" if i < 3 else "d") for i in range(1, 7)], "id long, kind string")
    members = graph.components(nodes, one)
    assert {r.id: r.component for r in members.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    assert {r.component: r.dominant_kind for r in graph.dominant(members.join(nodes, "id"), "kind").collect()}[1] == "c"
    assert [(r.a, r.b) for r in graph.prune(one, 2, 5).collect()] == [(1, 2)]
    path = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)], "a long, b long, weight double")
    assert graph.components(spark.range(41), path).select("component").distinct().count() == 1
    xy = graph.force_layout([1, 2, 3], [(1, 2, 0.9)], rounds=20)
    assert xy == graph.force_layout([1, 2, 3], [(1, 2, 0.9)], rounds=20) and set(xy) == {1, 2, 3}


def test_similarity_edges_in_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(30)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {(i, j) for (i, x), (j, y) in itertools.combinations(rows, 2) if sum(a * b for a, b in zip(x, y)) >= 0.5}
    for block in (4096, 7):
        got = [(r.a, r.b) for r in graph.similarity_edges(v, 0.5, block=block).collect()]
        assert set(got) == want and len(got) == len(want)


def test_tables(spark):
    there = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tables.insert_new(there, new, ["k"])) == [(1, "a"), (2, "b"), (3, "y")]
    assert rows(tables.upsert(there, new, ["k"])) == [(1, "a"), (2, "x"), (3, "y")]
    assert rows(tables.replace_group(there, new, "k")) == [(1, "a"), (2, "x"), (3, "y")]
    assert rows(tables.changed(there, new, ["k", "v"])) == [(1, "a"), (2, "b")]
    assert rows(tables.repaired(there, new, "k", "v").select("k", "v")) == [(1, "a"), (2, "x")]
    v = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>")
    assert tables.checked_vectors(v, "v", 2, 5).count() == 1
    with pytest.raises(ValueError):
        tables.checked_vectors(v, "v", 2, 0)


def test_stored_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffled()
    setting = spark.conf.get(tables._SHUFFLES_GO, None)
    one = tables.stored(spark.range(2000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "one")
    two = tables.stored(one.join(one.withColumnRenamed("count", "n").hint("merge"), "k"), "two")
    assert sorted(r.k for r in two.collect()) == list(range(7))
    assert spark.conf.get(tables._SHUFFLES_GO, None) == setting
    until = time.time() + 20  # they are removed behind the query's back
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
