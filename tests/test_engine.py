"""Small fixtures with nulls, empties and ties; brute force where SQL has no equal; recall of the indexes."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from strataform.functions import columns as C
from strataform.operators import chunks, search, vectors
from strataform.operators.crossmodal import CrossModal
from strataform.operators.graphs import Graph
from strataform.operators.tables import ConstraintError, Policy, Table
from strataform.plans import catalogue, dialect
from strataform.plans.statements import Database
from strataform.sources import tables as T
from strataform.streaming import streams


@pytest.fixture(scope="module")
def db(spark):
    d = Database(spark)
    d.sql("CREATE TABLE users (id INT PRIMARY KEY, name TEXT); INSERT INTO users VALUES (1, 'Alice'), (2, 'Bob')")
    d.sql("CREATE TABLE orders (id INT PRIMARY KEY, user_id INT, total REAL); INSERT INTO orders VALUES (10, 1, 99.5), (20, 1, 23.0), (30, 3, 150.0)")
    d.sql("CREATE TABLE employees (id INT, name TEXT, department TEXT, salary INT); INSERT INTO employees VALUES (1, 'Alice', 'Engineering', 90000), (2, 'Bob', 'Engineering', 80000), (3, 'Charlie', 'Sales', 70000), (4, 'Diana', 'Sales', 75000), (5, 'Eve', 'Engineering', 95000)")
    d.sql("CREATE TABLE sales (id INT, dept TEXT, amount INT); INSERT INTO sales VALUES (1, 'A', 100), (2, 'A', 200), (3, 'B', 150), (4, 'B', 50), (5, 'C', 300)")
    return d


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(
    "text, want",
    [
        ("SELECT u.name, o.total FROM users u JOIN orders o ON u.id = o.user_id", [("Alice", 23.0), ("Alice", 99.5)]),
        ("SELECT u.name, o.total FROM users u LEFT JOIN orders o ON u.id = o.user_id", [("Alice", 23.0), ("Alice", 99.5), ("Bob", None)]),
        ("SELECT u.name, o.total FROM users u RIGHT JOIN orders o ON u.id = o.user_id", [("Alice", 23.0), ("Alice", 99.5), (None, 150.0)]),
        ("SELECT u.name, o.id FROM users u FULL JOIN orders o ON u.id = o.user_id", [("Alice", 10), ("Alice", 20), ("Bob", None), (None, 30)]),
        ("SELECT count(*) FROM users CROSS JOIN orders", [(6,)]),
        ("SELECT u.name, t.total FROM users u JOIN LATERAL (SELECT total FROM orders o WHERE o.user_id = u.id ORDER BY total DESC LIMIT 1) t", [("Alice", 99.5)]),
        ("SELECT name, rank() OVER (PARTITION BY department ORDER BY salary DESC) FROM employees", [("Alice", 2), ("Bob", 3), ("Charlie", 2), ("Diana", 1), ("Eve", 1)]),
        ("SELECT name, lag(salary) OVER (ORDER BY id) FROM employees", [("Alice", None), ("Bob", 90000), ("Charlie", 80000), ("Diana", 70000), ("Eve", 75000)]),
        ("SELECT sum(amount) FILTER (WHERE dept = 'A') FROM sales", [(300,)]),
        ("SELECT dept, sum(amount) FROM sales GROUP BY ROLLUP (dept)", [("A", 300), ("B", 200), ("C", 300), (None, 800)]),
        ("SELECT * FROM (SELECT department, salary FROM employees) PIVOT (sum(salary) FOR department IN ('Engineering' AS eng, 'Sales' AS sales))", [(265000, 145000)]),
        ("SELECT name FROM users WHERE id IN (SELECT user_id FROM orders)", [("Alice",)]),
        ("SELECT name FROM users WHERE id NOT IN (SELECT user_id FROM orders WHERE user_id IS NOT NULL)", [("Bob",)]),
        ("SELECT id FROM orders WHERE total BETWEEN 20 AND 100", [(10,), (20,)]),
        ("SELECT sum(DISTINCT n) FROM VALUES (10), (10), (20) AS t(n)", [(30,)]),
        ("SELECT name FROM users UNION SELECT 'Bob' EXCEPT SELECT 'Alice'", [("Bob",)]),
        ("SELECT 1 % nullif(0, 0) IS NULL, try_divide(1, 0) IS NULL", [(True, True)]),
    ],
)
def test_fixtures(db, text, want):
    assert rows(db.sql(text)) == sorted(want, key=repr)


def test_merge_fixtures(spark):
    d = Database(spark)
    d.sql("CREATE TABLE inventory (id INT PRIMARY KEY, sku TEXT, qty INT); INSERT INTO inventory VALUES (1, 'SKU001', 100), (2, 'SKU002', 200)")
    d.sql("CREATE TABLE updates (sku TEXT, delta INT); INSERT INTO updates VALUES ('SKU001', 50), ('SKU003', 300)")
    d.sql("MERGE INTO inventory USING updates ON inventory.sku = updates.sku WHEN MATCHED THEN UPDATE SET qty = inventory.qty + updates.delta WHEN NOT MATCHED THEN INSERT (id, sku, qty) VALUES (3, updates.sku, updates.delta)")
    assert rows(d.sql("SELECT * FROM inventory")) == [(1, "SKU001", 150), (2, "SKU002", 200), (3, "SKU003", 300)]
    log = {(r.kind, r.version): r.data for r in d.tables["inventory"].change_log().collect()}
    assert sorted(k for k, _ in log) == ["insert", "insert", "update"] and '"qty":150' in next(v for (k, _), v in log.items() if k == "update")
    d.sql("CREATE TABLE inv (id INTEGER PRIMARY KEY, qty INTEGER); CREATE TABLE deltas (id INTEGER PRIMARY KEY, qty INTEGER); INSERT INTO inv VALUES (1, 10), (2, 20); INSERT INTO deltas VALUES (1, 0)")
    d.sql("MERGE INTO inv USING deltas ON inv.id = deltas.id WHEN MATCHED THEN DELETE")
    assert rows(d.sql("SELECT id FROM inv")) == [(2,)] and [r.kind for r in d.tables["inv"].change_log().filter("kind <> 'insert'").collect()] == ["delete"]
    with pytest.raises(ConstraintError, match="two source rows"):
        d.sql("MERGE INTO inv USING (SELECT 2 AS id, 1 AS q UNION ALL SELECT 2, 3) AS s ON inv.id = s.id WHEN MATCHED THEN UPDATE SET qty = s.q")


def test_subquery_changes(spark):
    d = Database(spark)
    d.sql("CREATE TABLE departments (id INT PRIMARY KEY, name TEXT, budget INT); INSERT INTO departments VALUES (1, 'Engineering', 500000), (2, 'Sales', 300000), (3, 'Marketing', 200000)")
    d.sql("CREATE TABLE employees (id INT PRIMARY KEY, name TEXT, dept_id INT, salary INT); INSERT INTO employees VALUES (1, 'Alice', 1, 90000), (2, 'Bob', 1, 80000), (3, 'Charlie', 2, 70000), (4, 'Diana', 2, 75000), (5, 'Eve', 3, 60000), (6, 'Frank', 1, 95000)")
    assert len(rows(d.sql("SELECT name FROM employees WHERE dept_id IN (SELECT id FROM departments WHERE budget > 250000)"))) == 5
    assert rows(d.sql("SELECT name FROM employees WHERE salary = (SELECT max(salary) FROM employees)")) == [("Frank",)]
    d.sql("UPDATE employees SET salary = salary + 1 WHERE dept_id IN (SELECT id FROM departments WHERE name = 'Sales')")
    assert rows(d.sql("SELECT salary FROM employees WHERE dept_id = 2")) == [(70001,), (75001,)]
    gone = d.sql("DELETE FROM employees WHERE dept_id IN (SELECT id FROM departments WHERE budget < 250000) RETURNING name")
    assert rows(gone) == [("Eve",)] and d.sql("SELECT * FROM employees").columns == ["id", "name", "dept_id", "salary"]


def test_keys_and_actions(spark):
    d = Database(spark)
    d.sql("CREATE TABLE pair (a INT, b INT, v INT, PRIMARY KEY (a, b)); INSERT INTO pair VALUES (1, 100, 50), (1, 101, 75)")
    with pytest.raises(ConstraintError):
        d.sql("INSERT INTO pair VALUES (1, 100, 1)")
    with pytest.raises(ConstraintError):
        d.sql("INSERT INTO pair VALUES (1, NULL, 1)")
    for action, want in (("CASCADE", []), ("SET NULL", [(10, None), (20, None)]), ("RESTRICT", None)):
        d = Database(spark)
        d.sql(f"CREATE TABLE parent (id INTEGER PRIMARY KEY, name TEXT); CREATE TABLE child (id INTEGER PRIMARY KEY, parent_id INTEGER REFERENCES parent (id) ON DELETE {action}); INSERT INTO parent VALUES (1, 'Alice'); INSERT INTO child VALUES (10, 1), (20, 1)")
        if want is None:
            with pytest.raises(ConstraintError):
                d.sql("DELETE FROM parent")
            assert d.sql("SELECT * FROM child").count() == 2 and d.sql("SELECT * FROM parent").count() == 1
        else:
            d.sql("DELETE FROM parent")
            assert rows(d.sql("SELECT * FROM child")) == want
            assert d.tables["child"].change_log().filter("version > 1").count() == 2


def test_policies(spark):
    d = Database(spark)
    d.sql("CREATE TABLE docs (id INTEGER, owner TEXT); INSERT INTO docs VALUES (1, 'alice'), (2, 'bob'), (3, NULL); CREATE POLICY own ON docs USING (owner = current_user); ALTER TABLE docs ENABLE ROW LEVEL SECURITY")
    for user, ids in {"alice": [(1,)], "x' OR '1'='1": [], "bob') OR ('1'='1": [], "": []}.items():
        assert rows(d.as_user(user).sql("SELECT id FROM docs")) == ids
        d.sql("DELETE FROM docs WHERE true") if user.startswith("x") else None
    with pytest.raises(PermissionError):
        d.as_user("alice").sql("UPDATE docs SET owner = 'bob'")
    d.sql("DELETE FROM docs")
    assert rows(d.as_user(None).sql("SELECT id FROM docs")) == [(2,), (3,)]
    t = Table("t", spark.sql("SELECT 'current_user' AS name, 1 AS current_users"), rls=True, policies=[Policy("p", "name = 'current_user' AND current_users = 1")])
    assert t.read("someone").count() == 1  # only whole words outside quotes are the user


def test_statements(spark, tmp_path):
    d = Database(spark)
    d.sql("CREATE TABLE IF NOT EXISTS t (id SERIAL PRIMARY KEY, name TEXT); CREATE TABLE IF NOT EXISTS t (x INT); INSERT INTO t VALUES (100, 'a;b'); INSERT INTO t (name) VALUES ('it''s')")
    assert rows(d.sql("SELECT * FROM t")) == [(100, "a;b"), (101, "it's")]
    d.sql("CREATE VIEW v AS SELECT id + 1 AS next FROM t; CREATE TYPE Animal { name: str }; CREATE TYPE Dog EXTENDING Animal { age: int32 }")
    assert rows(d.sql("SELECT next FROM v")) == [(101,), (102,)] and d.types["Dog"] == {"name": "string", "age": "int"}
    assert rows(d.sql("SHOW COLUMNS FROM t")) == [("id", "int", True), ("name", "string", False)] and "t" in [r.name for r in d.sql("SHOW TABLES").collect()]
    assert any("Scan" in r.plan for r in d.sql("EXPLAIN SELECT * FROM t").collect())
    d.sql("DROP VIEW v; DROP TYPE Dog; DROP TABLE IF EXISTS nothing")
    with pytest.raises(KeyError):
        d.sql("DROP TABLE nothing")
    d.migration("001", "CREATE TABLE m (id INT PRIMARY KEY)", "DROP TABLE m")
    d.migration("002", "INSERT INTO m VALUES (1); INSERT INTO m VALUES (1)")
    assert d.migrate(dry=True) == ["001", "002"]
    with pytest.raises(ConstraintError):
        d.migrate()
    assert d.applied == ["001"] and d.sql("SELECT * FROM m").count() == 0 and d.rollback_migration() == "001" and "m" not in d.tables
    d.register_udf("twice", lambda c: c * 2, 1)
    assert rows(d.sql("SELECT id FROM t").select(d.call("twice", "id"))) == [(200,), (202,)]
    with pytest.raises(TypeError):
        d.call("twice", "id", "id")
    assert d.call_tool("query", sql="SELECT count(*) AS n FROM t") == [{"n": 2}] and "CREATE TABLE t" in d.call_tool("schema_inspect", table="t")[0]["text"]
    with pytest.raises(PermissionError):
        d.call_tool("query", sql="DELETE FROM t")
    (tmp_path / "a.json").write_text('[{"name": "Alice", "age": 30}, {"name": "Bob", "age": null}]')
    (tmp_path / "b.csv").write_text('name;age\n"x;y";1\n;\n')
    assert rows(T.import_file(spark, str(tmp_path / "a.json"), "json").select("name", "age")) == [("Alice", 30), ("Bob", None)]
    d.sql(f"CREATE TABLE people (name TEXT, age INT); IMPORT FROM '{tmp_path}/b.csv' INTO people FORMAT csv DELIMITER ';' HEADER true")
    assert rows(d.sql("SELECT * FROM people")) == [("x;y", 1), (None, None)]


def test_vectors_and_hybrid(spark):
    d = Database(spark)
    d.sql("CREATE TABLE items (id INT PRIMARY KEY, embedding VECTOR(3), content TEXT, tenant TEXT); INSERT INTO items VALUES (1, array(1, 0, 0), 'quick brown fox', 'a'), (2, array(0, 1, 0), 'lazy dog sleeps', 'b'), (3, array(0, 0, 1), 'quick brown dog', 'a')")
    with pytest.raises(ConstraintError):
        d.sql("INSERT INTO items VALUES (4, array(1, 0), 'x', 'a')")
    assert rows(d.sql("SELECT id, round(cosine_distance(embedding, array(1D, 0D, 0D)), 6), round(embedding <-> array(1D, 0D, 0D), 6) FROM items")) == [(1, 0.0, 0.0), (2, 1.0, 1.414214), (3, 1.0, 1.414214)]
    assert d.sql("SELECT hybrid_search('items', 'embedding', 'content', 'quick', '[1,0,0]', 2) AS h").first().h == "[]"  # no index yet
    d.sql("CREATE INDEX v ON items (embedding) USING HNSW; CREATE INDEX ON items (content) USING FTS")
    assert d.sql("SELECT hybrid_search_ids('items', 'embedding', 'content', 'quick', '[1,0,0]', 2) AS h").first().h.split(",")[0] == "1"
    assert d.sql("SELECT hybrid_search_filtered('items', 'embedding', 'content', 'dog', '[1,0,0]', 5, 'tenant', 'a') AS h").first().h.count('"id"') == 2
    assert d.call_tool("vector_search", table="items", column="embedding", vector=[0.0, 0.0, 1.0], k=1)[0]["id"] == 3
    with pytest.raises(ValueError):
        d.call_tool("vector_search", table="items", column="embedding", vector=[0.0, 0.0, 1.0], k=0)
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0])], "vec_id int, embedding array<float>")
    assert [r.vec_id for r in vectors.knn(e.filter("embedding IS NOT NULL"), [1.0, 0.0], 3).collect()] == [1, 2, 4]  # ties by key; a zero vector is at 1
    assert rows(e.select(C.vector_add("embedding", "embedding"))) == rows(e.select(C.vector_scale("embedding", 2.0)))
    assert C.compression_ratio("4bit") == 8.0 and C.compression_ratio("pq", 64, 16) == 16.0


def test_crossmodal_modes(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    index = search.TextIndex.build(spark.createDataFrame([(1, "fox"), (3, "fox fox")], "doc_id long, text string"))
    both = CrossModal(e, index, graph(spark, [(1, 2), (2, 4)], [1, 2, 4]))
    get = lambda **kw: {r.doc_id: round(r.score, 6) for r in both.search(**kw).collect()}
    assert get(mode="vector", vector=[1.0, 0.0], k=1) == {1: 1.0} and get(mode="fulltext", text="fox") == {3: 1.0, 1: 0.5}
    assert get(mode="graph", start=1) == {1: 1.0, 2: 0.5, 4: round(1 / 3, 6)} == get(mode="graph", start=1, traversal="dfs")
    assert get(vector=[1.0, 0.0], text="fox", start=1, k=1) == {1: 2.0, 2: 0.5, 3: 1.0, 4: round(1 / 3, 6)}
    with pytest.raises(ValueError):
        both.search("graph")


def test_json_arrays(spark, tmp_path):
    import json

    d = spark.createDataFrame([(1, "a\"b"), (2, None), (3, "c,\n[")], "id int, s string").repartition(3, "id")
    T.export_file(d, str(tmp_path / "a"), "json")
    parts = [json.loads(p.read_text()) for p in (tmp_path / "a").glob("part-*")]
    assert sorted((x["id"], x["s"]) for p in parts for x in p) == [(1, 'a"b'), (2, None), (3, "c,\n[")]
    assert rows(T.import_file(spark, str(tmp_path / "a"), "json", schema=d.schema)) == rows(d)


@pytest.mark.parametrize("kind", ["ivf_search", "lsh_search", "pq_search"])
def test_recall(spark, sf_dir, kind):
    """Against all rows: at least nine of ten true neighbours of every fiftieth row."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    true = {(r.query_id, r.vec_id) for r in vectors.knn_batch(e, e.filter("vec_id % 50 = 0"), 10).collect()}
    got = {(r.query_id, r.vec_id) for r in catalogue.queries()[kind](spark, sf_dir).collect()}
    assert len(got) == len(true) and len(got & true) >= 0.9 * len(true)


def test_text_index(spark):
    docs = spark.createDataFrame([(1, "Nim programming language is fast"), (2, "Python is popular for data science"), (3, "Rust is a systems programming language"), (4, None), (5, ""), (6, "the of and")], "doc_id int, text string")
    index = search.TextIndex.build(docs)
    assert index.n == 6 and [r.doc_id for r in index.bm25("programming language", 10).collect()] in ([1, 3], [3, 1])
    assert index.bm25("").count() == 0 and index.bm25("the of").count() == 0 and index.phrase("language programming").count() == 0
    assert rows(index.phrase("programming language").select("doc_id", "n_matches")) == [(1, 1), (3, 1)]
    assert rows(index.boolean("NOT programming").select("doc_id")) == [(2,), (4,), (5,), (6,)]
    assert rows(index.boolean("program* -rust").select("doc_id")) == [(1,)] and rows(index.boolean("languge~1 AND (nim OR python)").select("doc_id")) == [(1,)]
    with pytest.raises(ValueError):
        search.BooleanQuery("a OR")
    index.remove(docs.filter("doc_id = 1"))
    index.add(spark.createDataFrame([(7, "fast fast language")], "doc_id int, text string"))
    before = rows(index.bm25("fast language").select("doc_id", F.round("score", 9)))
    index.compact()
    assert rows(index.bm25("fast language").select("doc_id", F.round("score", 9))) == before and {r[0] for r in before} == {3, 7}
    assert search.TextIndex.build(docs.limit(0)).bm25("x").count() == 0
    assert rows(spark.createDataFrame([("running",), ("flies",), ("boxes",), ("glass",), ("cats",), ("bed",), ("table",), ("visible",)], "w string").select("w", C.simple_stem("w"))) == sorted([("running", "runn"), ("flies", "fly"), ("boxes", "box"), ("glass", "glass"), ("cats", "cat"), ("bed", "bed"), ("table", "t"), ("visible", "vis")])


GRAPHS = [
    ([(1, 2), (1, 3), (2, 4)], [1, 2, 3, 4]),
    ([(1, 2), (2, 3), (3, 1), (1, 1), (4, 4), (3, 5), (5, 6), (6, 7), (7, 5)], [1, 2, 3, 4, 5, 6, 7, 8]),
]


def graph(spark, edges, nodes):
    e = spark.createDataFrame([(a, b, "x", 1.0) for a, b in edges], "src long, dst long, label string, weight double")
    n = spark.createDataFrame([(i, "n", {}) for i in nodes], "id long, label string, properties map<string,string>")
    return Graph(n, e)


def some_graph(seed, n=14, m=40):
    rng = random.Random(seed)
    return sorted({(rng.randint(1, n), rng.randint(1, n)) for _ in range(m)}), list(range(1, n + 3))


@pytest.mark.parametrize("edges, nodes", [*GRAPHS, some_graph(1)])
def test_dfs_brute(spark, edges, nodes):
    order, stack = [], [1]
    while stack:
        at = stack.pop()
        if at not in order:
            order.append(at)
            stack += sorted({b for a, b in edges if a == at})
    assert [r.id for r in graph(spark, edges, nodes).dfs(1).orderBy("position").collect()] == order


def test_long_paths(spark):
    """No cap on hops."""
    n = 40
    g = graph(spark, [(i, i + 1) for i in range(1, n)], range(1, n + 1))
    assert g.shortest_path(1, n) == list(range(1, n + 1)) and g.shortest_path(n, 1) == [] and g.shortest_path(3, 3) == [3]
    names = Graph(g.nodes.withColumn("id", F.concat(F.lit("n"), "id")), g.edges.withColumn("src", F.concat(F.lit("n"), "src")).withColumn("dst", F.concat(F.lit("n"), "dst")))
    assert [r._node_id for r in names.graph_table("shortest_path", "n1", "n3").orderBy("position").collect()] == ["n1", "n2", "n3"]


def modularity(edges, community):
    weight = {}
    for a, b in edges:
        weight[min(a, b), max(a, b)] = weight.get((min(a, b), max(a, b)), 0) + 1
    deg, total = {}, 0
    for (a, b), w in weight.items():
        deg[a] = deg.get(a, 0) + w
        if a != b:
            deg[b] = deg.get(b, 0) + w
        total += w
    inside = sum(w for (a, b), w in weight.items() if community[a] == community[b])
    per = {}
    for i, x in deg.items():
        per[community[i]] = per.get(community[i], 0) + x
    return inside / total - sum((x / (2 * total)) ** 2 for x in per.values())


def test_louvain(spark):
    """Two cliques joined by an edge are two communities; on others the distributed form is about as good as one node after the other."""
    clique = lambda ids: [(a, b) for a in ids for b in ids if a < b]
    edges = clique([1, 2, 3, 4]) + clique([5, 6, 7, 8]) + [(4, 5)]
    g = graph(spark, edges, range(1, 10))
    for found in (g.louvain(), g.louvain_serial()):
        assert {r.id: r.community for r in found.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 9}


def test_node2vec_brute(spark):
    edges, nodes = some_graph(5, 8, 14)
    near = {i: sorted({b for a, b in edges if a == i}) for i in nodes}
    met = {i: {} for i in nodes}
    for i in nodes:
        for w in range(5):
            at = i
            for step in range(10):
                if not near[at]:
                    break
                to = near[at][(step * 17 + w * 31) % len(near[at])]
                for a, b in ((at, to), (to, at)):
                    if a != b:
                        met[a][b] = met[a].get(b, 0) + 1
                at = to
    ids = [r[0] for r in spark.createDataFrame([(i,) for i in nodes], "i long").select(F.pmod(F.xxhash64("i"), F.lit(64)).cast("int")).collect()]
    slot = dict(zip(nodes, ids))
    got = {r.id: r.embedding for r in graph(spark, edges, nodes).node2vec().collect()}
    for i in nodes:
        total, want = sum(met[i].values()), [0.0] * 64
        for b, k in met[i].items():
            want[slot[b]] += k / total
        assert got[i] == pytest.approx(want if total else [0.01] * 64)


def test_pagerank_and_matching(spark):
    ring = graph(spark, [(1, 2), (2, 3), (3, 1)], [1, 2, 3]).pagerank().collect()
    assert all(abs(r["rank"] - 1 / 3) < 1e-9 for r in ring)
    people = Graph(spark.createDataFrame([(1, "Person", {"name": "Alice"}), (2, "Person", {"name": "Bob"}), (3, "Person", {"name": "Charlie"})], "id long, label string, properties map<string,string>"), spark.createDataFrame([(1, 2, "knows", 1.0), (2, 3, "knows", 1.0), (1, 3, "likes", 1.0)], "src long, dst long, label string, weight double"))
    assert rows(people.cypher("MATCH (a:Person {name: 'Alice'})-[:knows]->(b) RETURN b.name AS who")) == [("Bob",)]
    assert rows(people.cypher("MATCH (b)<-[:likes]-(a) RETURN a.name AS a, b.name AS b")) == [("Alice", "Charlie")]
    assert rows(people.match_nodes("Person", name="Bob").select("id")) == [(2,)] and rows(people.neighbors(1)) == [(2,), (3,)]


def test_chunks(spark):
    rng = random.Random(2)
    texts = ["", " ", None, "One. Two? Three!", "\n\n".join(" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 80))) + "." for _ in range(12)), "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for strategy in ("paragraph", "sentence", "recursive", "fixed"):
        got = {}
        for r in chunks.chunk(df, strategy=strategy, size=200, overlap=0, least=0).orderBy("doc_id", "index").collect():
            got.setdefault(r.doc_id, []).append(r.chunk)
        for i, t in enumerate(texts):
            squeeze = lambda x: "".join((x or "").split())
            assert squeeze("".join(got.get(i, []))) == squeeze(t), strategy  # least=0 loses no text
        if strategy in ("recursive", "fixed"):
            assert all(len(c) <= 200 for x in got.values() for c in x)
    assert [c.chunk for c in chunks.chunk(df.filter("doc_id = 3"), strategy="sentence").orderBy("index").collect()] == ["One.", "Two?", "Three!"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("2 ** 3 ** 2", "power(2, power(3, 2))"), ("-2 ** 2", "-power(2, 2)"), ("b ** -c", "power(b, -c)"), ("f(g(x)) ** 2", "power(f(g(x)), 2)"),
        ("transform(xs, x -> x + 1)", "transform(xs, x -> x + 1)"), ("'a ** b' ++ c", "concat('a ** b', c)"), ("a ?? b ?? 0", "coalesce(coalesce(a, b), 0)"),
        ("x = ? AND y > ?", "x = ? AND y > ?"), ("count(*)", "count(*)"), ("t.*", "t.*"), ("a -- ** b", "a -- ** b"),
    ],
)
def test_dialect(text, want):
    assert dialect.rewrite(text) == want


def test_json_operators(spark):
    one = lambda x: dialect.sql(spark, f"SELECT {x} AS v").first().v
    data = """'{"name": "Alice", "age": 30, "tags": {"k": [1, 2]}}'"""
    assert one(f"{data} ->> 'name'") == "Alice" and one(f"{data} -> 'tags' -> 'k' ->> 1") == "2" and one(f"{data} ->> 'none'") is None
    assert one(f"""{data} @> '{{"age": 30}}'""") and not one(f"""{data} @> '{{"age": 31}}'""") and one("'[1, 2]' @> '[2]'") and not one("'[1]' @> '[2]'")
    assert one(f"""{data} ?| '["x", "age"]'""") and not one(f"""{data} ?& '["x", "age"]'""")
    assert one("'the quick brown fox' @@ 'quick fox'") and one("7 // -2") == -4 and one("NULL ?? 1") == 1


def test_ids(spark):
    n = spark.range(20000, numPartitions=7).select(C.snowflake_id(3).alias("i"))
    assert n.distinct().count() == 20000 and n.filter((F.shiftright("i", 12).bitwiseAND(F.lit(1023))) != 3).count() == 0
    assert spark.range(1).select(C.now_text().alias("t")).first().t[4] == "-"
    assert rows(spark.sql("SELECT 'hello' AS s").select(C.substr0("s", 1, 3), C.substr0("s", 9, 2))) == [("ell", "")]


def test_late_rows(spark, tmp_path):
    """What comes after the watermark has passed its window is dropped; what comes within it counts."""
    src, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    schema = "ts timestamp, event_type string, value double, user_id long"
    for batch in ([("2024-01-01 00:10:00", 1.0), ("2024-01-01 05:00:00", 1.0)], [("2024-01-01 00:20:00", 7.0), ("2024-01-01 04:50:00", 2.0), ("2024-01-01 09:00:00", 1.0)], [("2024-01-01 12:00:00", 1.0)]):
        spark.createDataFrame([(t, "e", v, 1) for t, v in batch], "ts string, event_type string, value double, user_id long").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)
        streams.run_to_end(streams.tumbling(streams.read_stream(spark, src, schema), "1 hour", late="30 minutes"), out, mark, mode="append")
    got = {r.start.strftime("%H:%M"): r.total for r in spark.read.parquet(out).collect()}
    assert got["00:00"] == 1.0 and got["04:00"] == 2.0 and got["05:00"] == 1.0


def test_empty_tables(spark):
    none = graph(spark, [], [])
    assert none.pagerank().count() == 0 and none.louvain().count() == 0 and none.jaccard().count() == 0 and none.node2vec().count() == 0 and none.bfs(1).count() == 1
    t = Table("t", spark.createDataFrame([], "id int, v int"), key=["id"])
    assert t.update({"v": "1"}).count() == 0 and t.delete().count() == 0 and t.insert(spark.createDataFrame([], "id int")).count() == 0
    assert math.isclose(C.compression_ratio("8bit"), 4.0)


def test_watermark_of_times_without_zone(spark, tmp_path):
    """Windows and sessions of a stream whose times have no zone; nothing shifts in a session with summer time, where 02:30 isn't an hour of every day."""
    src, zone = str(tmp_path / "in"), spark.conf.get("spark.sql.session.timeZone")
    rows_in = [("2024-03-31 02:30:00", 1.0), ("2024-03-31 02:59:59.999999", 2.0), ("2024-10-27 02:30:00", 4.0), ("1969-12-31 23:59:59", 8.0), (None, 16.0)]
    spark.createDataFrame([(t, "e", v, 1) for t, v in rows_in], "ts string, event_type string, value double, user_id long").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(src)
    (one,) = (f"{src}/{f}" for f in os.listdir(src) if f.endswith(".parquet"))  # a stream of a single file, as the tables are
    try:
        for z in ("UTC", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", z)
            for name, f in (("windows", streams.tumbling), ("sessions", streams.sessions)):
                events = streams.read_stream(spark, src if name == "windows" else one, spark.read.parquet(src).schema)
                out = str(tmp_path / f"{name}-{z.replace('/', '-')}")
                streams.run_to_end(f(events, late="1 hour"), out)
                got, want = spark.read.parquet(out), f(spark.read.parquet(src))
                assert got.schema["start"].dataType == want.schema["start"].dataType and rows(got) == rows(want) and got.count() == 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
