"""What only shows on tables of several files or on larger ones."""

import re
import uuid

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataform.operators import graphs, search, vectors
from strataform.plans import catalogue


def dealt(spark, sf_dir, tmp_path, names):
    """A folder with some tables, each in eight files; DuckDB over it."""
    duck = duckdb.connect()
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").repartition(8).write.parquet(f"{tmp_path}/{n}.parquet")
        duck.execute(f"CREATE VIEW {n} AS SELECT * FROM '{tmp_path}/{n}.parquet/*.parquet'")
    return duck


@pytest.mark.parametrize("name", ["lateral_cross", "lateral_inner_limit", "lateral_left"])
def test_lateral_of_many_files(spark, sf_dir, tmp_path, same_rows, name):
    duck = dealt(spark, sf_dir, tmp_path, ["nation", "customer", "orders"])
    out = catalogue.queries()[name](spark, str(tmp_path))
    assert same_rows(out, duck.sql(catalogue.oracles()[name]))
    # one machine happens to keep an order that a window doesn't ask for; several don't
    windows = re.findall(r"row_number\(\) windowspecdefinition\((.*?)specifiedwindowframe", out._jdf.queryExecution().optimizedPlan().toString())
    assert windows and all(re.search("ASC|DESC", w) for w in windows)


def shuffled_rows(spark, job) -> int:
    """Rows that the stages of a job write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    tracker = spark.sparkContext.statusTracker()
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    try:
        job()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    return sum(store.lastStageAttempt(int(s)).shuffleWriteRecords() for s in stages)


DOCS = [(1, "apache License licence, apache"), (2, None), (3, ""), (4, "Licence apache the Straße_-x Ünï И ΣΑΣ"), (4, "licence more apache"), (None, "apache"), (None, "apache x apache yy"), (7, "lic " * 300), (8, "é" * 40 + " " + "b" * 64 + " " + "c" * 65 + " " + "a")]


def test_index_of_odd_documents(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    index = search.TextIndex.build(docs)
    told = lambda d: sorted(((r.term, r.doc_id, r.tf, tuple(r.positions)) for r in d.collect()), key=repr)
    want = told(search.postings(docs))
    assert told(index.postings()) == want and index.n == len(DOCS) and index.total == sum(x[2] for x in want)
    index.remove(spark.createDataFrame([(1,)], "doc_id long"))
    index.compact()
    assert told(index.postings()) == [x for x in want if x[1] != 1]


def test_index_shuffles_runs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = []
    moved = shuffled_rows(spark, lambda: made.append(search.TextIndex.build(docs)))
    index = made[0]
    terms = index.terms().count()
    # the documents' keys, the vocabulary and a few runs; never a row for each posting
    assert moved < index.postings().count() / 2 + 4 * terms + index.n, (moved, terms)
    # compacting after a removal shuffles the vocabulary and runs too
    index.remove(docs.filter("doc_id % 5 = 1"))
    assert shuffled_rows(spark, index.compact) < index.postings().count() / 2 + 4 * terms


@pytest.mark.parametrize("ask", ["fuzzy", "wildcard", "ngram_fuzzy", "boolean", "many"])
def test_terms_are_looked_up(spark, sf_dir, monkeypatch, ask):
    """Terms that a condition finds are read from their buckets; if there are too many, all postings are, with the same result."""
    index = search.TextIndex.build(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    run = {"fuzzy": lambda: index.fuzzy("licence"), "wildcard": lambda: index.wildcard("*icens*"), "ngram_fuzzy": lambda: index.ngram_fuzzy("license"), "boolean": lambda: index.boolean("licence~1 -apache"), "many": lambda: index.wildcard("*")}[ask]
    few = run()
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert ask == "many" or re.search(r"bucket#\d+L? (IN|INSET|=)", plan), plan
    got = sorted((r.doc_id, round(r.score, 9)) for r in few.collect())
    monkeypatch.setattr(search, "NAMED_TERMS", 0)
    assert got and got == sorted((r.doc_id, round(r.score, 9)) for r in run().collect())


def test_knn_batch_of_ties_and_nulls(spark):
    """Small whole numbers make many ties, across chunks and tasks; against brute force."""
    x = np.random.default_rng(3).integers(-9, 9, size=(40_000, 2)).astype(float)
    e = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id int, embedding array<float>")
    for metric, f in (("euclidean", lambda a: np.sqrt(((x - a) ** 2).sum(axis=1))), ("dot", lambda a: -(x @ a))):
        got = {(r.query_id, r.rank): (r.vec_id, round(r.distance, 9)) for r in vectors.knn_batch(e, e.filter("vec_id < 12"), 7, metric=metric, block=5).collect()}
        want = {}
        for i in range(12):
            d = f(x[i])
            want |= {(i, n + 1): (int(j), round(float(d[j]), 9)) for n, j in enumerate(np.lexsort((np.arange(len(x)), d))[:7])}
        assert got == want
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, None)], "vec_id long, embedding array<double>")
    ranks = sorted((r.query_id, r.rank, r.vec_id) for r in vectors.knn_batch(few, few, 3).collect())
    assert ranks == [(1, 1, 1), (1, 2, 3), (1, 3, 2), (2, 1, 1), (2, 2, 2), (2, 3, 3), (3, 1, 3), (3, 2, 1), (3, 3, 2), (4, 1, 1), (4, 2, 2), (4, 3, 3)]
    # other keys, other metrics and an empty table take the same way as before
    text = few.select(F.col("vec_id").cast("string").alias("vec_id"), "embedding").filter("embedding IS NOT NULL")
    assert [r.vec_id for r in vectors.knn_batch(text, text, 1).orderBy("query_id").collect()] == ["1", "3"]
    assert vectors.knn_batch(few.limit(0), few, 1).count() == vectors.knn_batch(few, few.limit(0), 1).count() == 0


@pytest.mark.parametrize("kind", ["batch", "ivf", "lsh"])
def test_neighbours_shuffle_few_rows(spark, tmp_path, kind):
    """k rows of each query from each task, not each pair that is compared; and the true neighbours, as far as they are candidates."""
    x = np.random.default_rng(4).normal(size=(3000, 8))
    e = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    e.write.parquet(f"{tmp_path}/e")
    e = spark.read.parquet(f"{tmp_path}/e")
    q, found = e.filter("vec_id % 50 = 0"), []
    index = {"batch": None, "ivf": vectors.IvfIndex(e), "lsh": vectors.LshIndex(e)}[kind]
    moved = shuffled_rows(spark, lambda: found.extend((vectors.knn_batch(e, q, 10) if index is None else index.search_batch(q, 10)).collect()))
    assert moved < 2 * len(x) + 60 * 10 * 2 * spark.sparkContext.defaultParallelism
    if index is not None:
        true = {(r.query_id, r.vec_id) for r in vectors.knn_batch(e, q, 10).collect()}
        assert len({(r.query_id, r.vec_id) for r in found} & true) >= 0.9 * len(true)
        assert all(abs(r.distance - np.sqrt(((x[r.query_id] - x[r.vec_id]) ** 2).sum())) < 1e-12 for r in found)


def test_dfs_holds_few_bytes_an_edge():
    """A walk over 400,000 edges, read in batches; against a walk with sets and lists."""
    import tracemalloc

    rng = np.random.default_rng(1)
    e = np.unique(rng.integers(0, 20_000, size=(400_000, 2)), axis=0)
    near = {}
    for a, b in e.tolist():
        near.setdefault(a, []).append(b)
    want, seen, todo = [], set(), [7]
    while todo:
        at = todo.pop()
        if at not in seen:
            seen.add(at)
            want.append(at)
            todo += near.get(at, [])
    own = e[np.isin(e[:, 0], want)]
    nodes = pa.RecordBatch.from_arrays([pa.array(sorted(want)), pa.nulls(len(want), pa.int64())], names=["src", "dst"])
    batches = [nodes, *(pa.RecordBatch.from_arrays([pa.array(own[i : i + 10_000, 0]), pa.array(own[i : i + 10_000, 1])], names=["src", "dst"]) for i in range(0, len(own), 10_000))]
    tracemalloc.start()
    got = [x for b in graphs._walk(7, None)(batches) for x in b.column(0).to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want and most < 16 * len(own), most / len(own)


def test_dfs_is_read_in_batches(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "a"), ("c", "b"), ("x", "y")], "src string, dst string")
    g = graphs.Graph(spark.createDataFrame([(x,) for x in "abcdxy"], "id string"), edges)
    out = g.dfs("a")
    assert [r.id for r in out.orderBy("position").collect()] == ["a", "c", "b", "d"]
    assert [r.id for r in g.dfs("a", 1).orderBy("position").collect()] == ["a", "c", "b"] and [r.id for r in g.dfs("y").collect()] == ["y"]
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()  # a group would be one batch


def test_louvain_deals_edges_seldom(spark):
    """One pass: the edges of a turn's nodes go to a join and to their nodes, and no more."""
    e = np.unique(np.random.default_rng(2).integers(0, 600, size=(12_000, 2)), axis=0)
    e = e[e[:, 0] < e[:, 1]]
    g = graphs.Graph(spark.range(600), spark.createDataFrame(e.tolist(), "src long, dst long").withColumn("weight", F.lit(1.0)))
    moved = shuffled_rows(spark, lambda: g.louvain(1).collect())
    assert moved < 7 * len(e), moved / len(e)
