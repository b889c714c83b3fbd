"""Property graphs as two DataFrames: nodes(id, label, properties map) and edges(src, dst, label, weight).

Loops write their state to the shared folder each round, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources.tables import discard, materialize, scratch


class Graph:
    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    # Changes give a new graph.

    def add_nodes(self, rows: DataFrame) -> "Graph":
        return Graph(self.nodes.unionByName(rows, allowMissingColumns=True), self.edges)

    def add_edges(self, rows: DataFrame) -> "Graph":
        return Graph(self.nodes, self.edges.unionByName(rows, allowMissingColumns=True))

    def remove_node(self, id) -> "Graph":
        return Graph(self.nodes.filter(F.col("id") != id), self.edges.filter((F.col("src") != id) & (F.col("dst") != id)))

    def remove_edge(self, src, dst) -> "Graph":
        return Graph(self.nodes, self.edges.filter(~((F.col("src") == src) & (F.col("dst") == dst))))

    def neighbors(self, id) -> DataFrame:
        return self.edges.filter(F.col("src") == id).select(F.col("dst").alias("id")).distinct()

    def in_neighbors(self, id) -> DataFrame:
        return self.edges.filter(F.col("dst") == id).select(F.col("src").alias("id")).distinct()

    def degrees(self) -> DataFrame:
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
        return ends.groupBy("e.id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")

    @staticmethod
    def load(spark, path: str) -> "Graph":
        return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))

    def match_nodes(self, label: str | None = None, **properties) -> DataFrame:
        d = self.nodes
        if label is not None:
            d = d.filter(F.col("label") == label)
        for k, v in properties.items():
            d = d.filter(F.try_element_at("properties", F.lit(k)) == F.lit(str(v)))
        return d

    # Traversal

    def bfs(self, start, max_depth: int | None = None, label: str | None = None, until=None) -> DataFrame:
        """id, depth and parent (the smallest on a shortest path) of each node reachable from start, or up to the depth of `until`.

        Each round writes its frontier alone; the folders of all rounds are one table.
        """
        hops = self.edges if label is None else self.edges.filter(F.col("label") == label)
        hops = materialize(hops.select("src", "dst").distinct(), "hops")
        kind = hops.schema["src"].dataType
        spark = hops.sparkSession
        base, depth = scratch(spark, "bfs"), 0
        first = spark.range(1).select(F.lit(start).cast(kind).alias("id"), F.lit(None).cast(kind).alias("parent"))
        first.write.parquet(f"{base}/depth=0")
        while True:
            seen = spark.read.schema(f"id {kind.simpleString()}, parent {kind.simpleString()}, depth int").parquet(base)
            frontier = seen.filter(F.col("depth") == depth)
            if (max_depth is not None and depth >= max_depth) or not frontier.take(1) or (until is not None and frontier.filter(F.col("id") == until).take(1)):
                return seen.select("id", "depth", "parent")
            nxt = hops.join(frontier.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
            depth += 1
            nxt.join(seen.select("id"), "id", "left_anti").write.parquet(f"{base}/depth={depth}")

    def shortest_path(self, start, end) -> list:
        """Node ids from start to end, [] if there is none; of any length.  The walk back reads one round's folder a step."""
        reached = self.bfs(start, until=end)
        row = reached.filter(F.col("id") == end).first()
        path = []
        while row is not None:
            path.append(row.id)
            row = None if row.depth == 0 else reached.filter((F.col("depth") == row.depth - 1) & (F.col("id") == row.parent)).first()
        return path[::-1]

    def dijkstra(self, start, weight: str = "weight") -> DataFrame:
        """id and distance of each node reachable over non-negative weights: relaxed until nothing changes."""
        hops = materialize(self.edges.groupBy("src", "dst").agg(F.min(weight).cast("double").alias("w")), "weights")
        kind = hops.schema["src"].dataType
        best = materialize(hops.sparkSession.range(1).select(F.lit(start).cast(kind).alias("id"), F.lit(0.0).alias("distance")), "dist")
        changed = best
        while changed.take(1):
            step = hops.join(changed.select(F.col("id").alias("src"), "distance"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("w")).alias("new"))
            changed = materialize(step.join(best, "id", "left").filter(F.col("distance").isNull() | (F.col("new") < F.col("distance"))).select("id", F.col("new").alias("distance")), "dist")
            best = materialize(best.unionByName(changed).groupBy("id").agg(F.min("distance").alias("distance")), "dist")
        return best

    def pagerank(self, rounds: int = 20, damping: float = 0.85) -> DataFrame:
        """id and rank; the mass of nodes without out-edges goes to all.  That mass is observed while a round's ranks are written: one job a round."""
        out = self.edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
        hops = materialize(self.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")).join(out, "src").select("src", "dst", (F.col("m") / F.col("deg")).alias("share")), "hops")
        n = self.nodes.count()
        ranks = self.nodes.select("id").distinct().join(out.select(F.col("src").alias("id"), F.lit(True).alias("_out")), "id", "left").select("id", F.col("_out").isNull().alias("_dangles"), F.lit(1.0 / max(1, n)).alias("rank"))
        mass = F.coalesce(F.sum(F.when(F.col("_dangles"), F.col("rank"))), F.lit(0.0)).alias("lost")
        last = None
        for i in range(rounds + 1):
            seen = Observation()
            ranks = materialize(ranks.observe(seen, mass), "ranks")
            if last is not None:
                discard(last)
            last = ranks
            if i == rounds:
                return ranks.select("id", "rank")
            got = hops.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("g"))
            ranks = ranks.select("id", "_dangles").join(got, "id", "left").select("id", "_dangles", ((1 - damping) / max(1, n) + damping * (F.coalesce("g", F.lit(0.0)) + seen.get["lost"] / max(1, n))).alias("rank"))

    def dfs(self, start, max_depth: int | None = None) -> DataFrame:
        """id and position of a stack's preorder, the largest neighbour first; of any depth, if none is given.

        Serial by nature: one task walks what BFS reaches.  It reads the nodes and then their edges in order, and holds four bytes an edge.
        """
        reached = materialize(self.bfs(start, max_depth).select("id").filter("id IS NOT NULL"), "reached")
        kind = reached.schema["id"].dataType.simpleString()
        near = self.edges.select("src", "dst").join(reached.select(F.col("id").alias("src")), "src").join(reached.select(F.col("id").alias("dst")), "dst").select("src", "dst").distinct()
        rows = reached.select(F.col("id").alias("src"), F.lit(None).cast(kind).alias("dst")).unionByName(near)
        one = rows.repartition(1).sortWithinPartitions(F.col("dst").isNotNull(), "src", "dst")
        return one.mapInArrow(_walk(start, max_depth), f"id {kind}, position long")

    def louvain(self, passes: int = 10) -> DataFrame:
        """id and community (its smallest id): one level of greedy moves.

        Nodes of one colour (a bit of a hash that changes with the pass) move at once, each to the community of the largest gain,
        ties to the smallest, if that gain beats staying; then the other colour.  Ends with a pass without a move.
        """
        both = self.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
        hops = materialize(both.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(both.filter("a <> b").select(F.col("b").alias("src"), F.col("a").alias("dst"), "w")), "hops")
        state = materialize(hops.groupBy("src").agg(F.sum("w").alias("deg")).select(F.col("src").alias("id"), "deg", F.col("src").alias("c")), "communities")
        total = state.agg(F.sum("deg")).first()[0] or 1.0
        for p in range(passes):
            moves = 0
            for colour in (0, 1):
                turn = lambda x: F.pmod(F.xxhash64(x, F.lit(p)), F.lit(2)) == colour
                told = state.join(state.groupBy("c").agg(F.sum("deg").alias("weight")), "c")
                # only the edges of nodes whose turn it is; they are dealt by node once, for the sums and for the choice
                to = hops.filter(turn("src") & (F.col("src") != F.col("dst"))).join(told.select(F.col("id").alias("dst"), F.col("c").alias("to"), "weight"), "dst").select(F.col("src").alias("id"), "to", "w", "weight")
                to = to.repartition("id").groupBy("id", "to").agg(F.sum("w").alias("w"), F.first("weight").alias("weight"))
                rated = to.join(told.filter(turn("id")).select("id", F.col("c").alias("own"), "deg", F.col("weight").alias("own_weight")), "id")
                gain = F.when(F.col("to") != F.col("own"), F.round(F.col("w") - F.col("weight") * F.col("deg") / total, 9))
                within = F.greatest(F.max(F.when(F.col("to") == F.col("own"), F.col("w"))), F.lit(0.0))
                stay = F.round(within - (F.first("own_weight") - F.first("deg")) * F.first("deg") / total, 9)
                best = rated.groupBy("id").agg(F.min_by("to", F.when(gain.isNotNull(), F.struct(-gain, F.col("to")))).alias("to"), F.max(gain).alias("top"), stay.alias("stay"))
                go = best.filter("top > stay").select("id", "to")
                new = materialize(state.join(go, "id", "left").select("id", "deg", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("_moved")), "communities")
                moves += new.filter("_moved").count()
                discard(state)
                state = new
            if not moves:
                break
        least = state.groupBy("c").agg(F.min("id").alias("community"))
        return self.nodes.select("id").join(state.join(least, "c").select("id", "community"), "id", "left").select("id", F.coalesce("community", "id").alias("community"))

    def louvain_serial(self, passes: int = 10) -> DataFrame:
        """id and community (its smallest id): one level of greedy moves, one node after the other in id order, on one task."""
        rows = self.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
        kind = rows.schema["a"].dataType.simpleString()

        def move(pdf):
            import pandas as pd

            near: dict = {}
            for a, b, w in zip(pdf["a"], pdf["b"], pdf["w"]):
                near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
            deg = {i: sum(x.values()) for i, x in near.items()}
            total = sum(deg.values()) / 2 or 1.0
            own, weight = {i: i for i in near}, dict(deg)
            for _ in range(passes):
                moved = False
                for i in sorted(near):
                    weight[own[i]] -= deg[i]
                    gain: dict = {own[i]: 0.0}
                    for j, w in near[i].items():
                        if j != i:
                            gain[own[j]] = gain.get(own[j], 0.0) + w
                    best = max(sorted(gain), key=lambda c: gain[c] - weight[c] * deg[i] / (2 * total))
                    moved |= best != own[i]
                    own[i] = best
                    weight[best] += deg[i]
                if not moved:
                    break
            least: dict = {}
            for i, c in own.items():
                least[c] = min(least.get(c, i), i)
            return pd.DataFrame({"id": list(own), "community": [least[c] for c in own.values()]})

        found = rows.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(move, f"id {kind}, community {kind}")
        return self.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))

    # Similarity and embedding

    def jaccard(self) -> DataFrame:
        """a < b and similarity of neighbours, in and out, above 0."""
        near = self.edges.select(F.col("src").alias("id"), F.col("dst").alias("n")).unionByName(self.edges.select(F.col("dst").alias("id"), F.col("src").alias("n"))).distinct()
        size = near.groupBy("id").agg(F.count(F.lit(1)).alias("d"))
        both = near.alias("x").join(near.alias("y"), F.expr("x.n = y.n AND x.id < y.id")).groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count(F.lit(1)).alias("c"))
        both = both.join(size.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(size.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
        return both.select("a", "b", (F.col("c") / (F.col("da") + F.col("db") - F.col("c"))).alias("similarity"))

    def adamic_adar(self) -> DataFrame:
        """a < b and the sum over common out-neighbours z of 1 / ln(out-degree of z), for degrees over 1."""
        near = self.edges.select(F.col("src").alias("id"), F.col("dst").alias("n")).distinct()
        deg = near.groupBy(F.col("id").alias("n")).agg(F.count(F.lit(1)).alias("d")).filter("d > 1")
        told = near.join(deg, "n").select("id", "n", (1 / F.log("d")).alias("w"))
        return told.alias("x").join(told.alias("y"), F.expr("x.n = y.n AND x.id < y.id")).groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.sum("x.w").alias("similarity"))

    def node2vec(self, dims: int = 64, walks: int = 5, length: int = 10) -> DataFrame:
        """id and a vector of each node: of its neighbours on deterministic walks, the share of each, in the dimension of its hash; 0.01 everywhere for a node that no walk leaves or enters.

        All walks step at once.  Step s of walk w takes the neighbour at place (17 s + 31 w) modulo their number, in their order; places are rows, so a hub is never one value.
        """
        pairs = self.edges.select("src", "dst").distinct()
        near = materialize(pairs.select("src", "dst", (F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).alias("place")), "near")
        sizes = materialize(near.groupBy(F.col("src").alias("at")).agg(F.count(F.lit(1)).alias("n")), "sizes")
        own = self.nodes.select("id").distinct()
        at = own.select(F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("w"), F.col("id").alias("at")).withColumn("k", F.lit(1).cast("long"))
        steps = None
        for step in range(length):
            spot = at.join(sizes, "at").select("w", "at", "k", F.pmod(F.lit(step * 17) + F.col("w") * 31, F.col("n")).cast("int").alias("place"))
            gone = spot.join(near, (spot["at"] == near["src"]) & (spot["place"] == near["place"])).groupBy("w", "at", "dst").agg(F.sum("k").alias("k"))
            gone = materialize(gone, "walk")  # walks that meet go on together
            steps = gone if steps is None else steps.unionByName(gone)
            at = gone.groupBy("w", F.col("dst").alias("at")).agg(F.sum("k").alias("k"))
        met = steps.filter("at <> dst").select(F.col("at").alias("id"), F.col("dst").alias("other"), "k").unionByName(steps.filter("at <> dst").select(F.col("dst").alias("id"), F.col("at").alias("other"), "k"))
        counts = met.groupBy("id", F.pmod(F.xxhash64("other"), F.lit(dims)).cast("int").alias("d")).agg(F.sum("k").alias("c"))
        held = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("d", "c"))).alias("m"), F.sum("c").alias("total"))
        vec = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i) / F.col("total"), F.lit(0.0)))
        return own.join(held, "id", "left").select("id", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.01), dims)).otherwise(vec).alias("embedding"))

    # Patterns

    def match(self, nodes: list[dict], hops: list[dict]) -> DataFrame:
        """Chains n0 -> n1 -> ... with distinct nodes.  nodes: {name, label, properties}; hops: {label, reverse}."""
        out = None
        for i, n in enumerate(nodes):
            own = self.match_nodes(n.get("label"), **n.get("properties", {})).select(F.col("id").alias(n["name"]))
            if out is None:
                out = own
                continue
            h, last = hops[i - 1], nodes[i - 1]["name"]
            e = self.edges if not h.get("label") else self.edges.filter(F.col("label") == h["label"])
            a, b = ("dst", "src") if h.get("reverse") else ("src", "dst")
            e = e.select(F.col(a).alias(last), F.col(b).alias(n["name"])).distinct()
            out = out.join(e, last).join(own, n["name"])
            for x in nodes[:i]:
                out = out.filter(F.col(x["name"]) != F.col(n["name"]))
        return out.select(*(n["name"] for n in nodes))

    def cypher(self, text: str) -> DataFrame:
        """MATCH (a:Label {k: 'v'})-[:R]->(b) WHERE a.k = 'v' AND ... RETURN a.k AS x, b ORDER BY x LIMIT n."""
        m = re.match(r"(?is)\s*MATCH\s+(.*?)(?:\s+WHERE\s+(.*?))?\s+RETURN\s+(.*?)(?:\s+ORDER\s+BY\s+(.*?))?(?:\s+LIMIT\s+(\d+))?\s*;?\s*$", text)
        if not m:
            raise ValueError(f"not a MATCH ... RETURN: {text}")
        pattern, where, returned, order, limit = m.groups()
        nodes, hops = [], []
        for i, n in enumerate(re.finditer(r"\(\s*(\w*)\s*(?::\s*(\w+))?\s*(\{[^}]*\})?\s*\)", pattern)):
            props = dict(re.findall(r"(\w+)\s*:\s*'?([^',}]*)'?", n[3] or ""))
            nodes.append({"name": n[1] or f"_n{i}", "label": n[2], "properties": props})
        for h in re.finditer(r"\)\s*(<?)-\s*(?:\[\s*\w*\s*(?::\s*(\w+))?[^\]]*\])?\s*-(>?)\s*\(", pattern):
            hops.append({"label": h[2], "reverse": bool(h[1])})
        out = self.match(nodes, hops)
        for n in nodes:
            out = out.join(self.nodes.select(F.col("id").alias(n["name"]), F.struct("id", "label", "properties").alias(f"_{n['name']}")), n["name"])
        fields = set(self.nodes.columns) - {"properties"}
        fit = lambda s: re.sub(r"\b([A-Za-z_]\w*)\.(\w+)", lambda x: f"_{x[1]}.{x[2]}" if x[2] in fields else f"try_element_at(_{x[1]}.properties, '{x[2]}')", s)
        if where:
            out = out.filter(fit(where))
        cols = []
        for r in re.split(r",(?![^(]*\))", returned):
            x, _, name = re.sub(r"(?i)\s+as\s+", "\0", r.strip()).partition("\0")
            cols.append(F.expr(fit(x)).alias(name or x.replace(".", "_")))
        out = out.select(*cols)
        if order:
            keys = [(k.split()[0].replace(".", "_"), k.lower().endswith(" desc")) for k in map(str.strip, order.split(","))]
            out = out.orderBy(*(F.col(k).desc_nulls_last() if d else F.col(k).asc_nulls_last() for k, d in keys))
        return out.limit(int(limit)) if limit else out

    def graph_table(self, algorithm: str, start=None, end=None, max_depth: int | None = None, label: str | None = None) -> DataFrame:
        """_node_id, _node_label and what the algorithm adds: bfs, dfs, shortest_path, dijkstra, pagerank, louvain; else all nodes."""
        g = Graph(self.nodes, self.edges if label is None else self.edges.filter(F.col("label") == label))
        if start is None and algorithm in ("bfs", "dfs", "shortest_path", "dijkstra"):
            start = self.nodes.agg(F.min("id")).first()[0]
        if algorithm == "shortest_path":
            spark = self.nodes.sparkSession
            kind = self.nodes.schema["id"].dataType.simpleString()
            found = spark.createDataFrame(list(enumerate(g.shortest_path(start, end))), f"position int, id {kind}")
        else:
            found = {"bfs": lambda: g.bfs(start, max_depth).select("id", "depth"), "dfs": lambda: g.dfs(start, max_depth), "dijkstra": lambda: g.dijkstra(start), "pagerank": g.pagerank, "louvain": g.louvain}.get(algorithm, lambda: g.nodes.select("id"))()
        return found.join(self.nodes.select("id", F.col("label").alias("_node_label")), "id", "left").withColumnRenamed("id", "_node_id")


def _walk(start, max_depth: int | None):
    """Of batches of (src, dst), first the nodes (null dst) and then the edges, each in order: the preorder from start."""

    def run(batches):
        import pyarrow as pa

        nodes, counts, near = [], None, array("i")
        for b in batches:
            src, dst = b.column(0), b.column(1)
            if dst.null_count:
                nodes.append(src.filter(dst.is_null()))
                src, dst = src.filter(dst.is_valid()), dst.filter(dst.is_valid())
            if len(src):
                if counts is None:
                    ids = pa.concat_arrays(nodes)
                    names = ids.to_numpy(zero_copy_only=False)
                    counts = np.zeros(len(names), dtype=np.int64)
                at, n = np.unique(np.searchsorted(names, src.to_numpy(zero_copy_only=False)), return_counts=True)
                counts[at] += n
                near.frombytes(np.searchsorted(names, dst.to_numpy(zero_copy_only=False)).astype(np.int32).tobytes())
        if not nodes:
            return
        if counts is None:
            ids = pa.concat_arrays(nodes)
            names, counts = ids.to_numpy(zero_copy_only=False), np.zeros(len(ids), dtype=np.int64)
        ends = np.cumsum(counts)
        begin, left = memoryview(ends - counts), memoryview(ends.copy())  # of each node, the edges not yet looked at end at left
        seen, stack = bytearray(len(names)), array("i", [int(np.searchsorted(names, start))])
        order = array("i", stack)
        seen[stack[0]] = 1
        while stack:
            at = stack[-1]
            if left[at] == begin[at] or (max_depth is not None and len(stack) > max_depth):
                stack.pop()
                continue
            left[at] -= 1
            to = near[left[at]]
            if not seen[to]:
                seen[to] = 1
                stack.append(to)
                order.append(to)
        for i in range(0, len(order), 50_000):
            part = np.array(order[i : i + 50_000])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(part)), pa.array(np.arange(i, i + len(part)))], names=["id", "position"])

    return run


def similarity_json(pairs: DataFrame) -> str:
    return json.dumps([{"a": r.a, "b": r.b, "score": r.similarity} for r in pairs.orderBy("a", "b").toLocalIterator()])


def recursive_union(seed: DataFrame, step, limit: int | None = None) -> DataFrame:
    """WITH RECURSIVE ... UNION: step(rows new in the last round) until it gives no new row; an error beyond limit rounds, if one is given.

    Each round writes its new rows alone; the folders of all rounds are one table.
    """
    spark = seed.sparkSession
    base, n = scratch(spark, "recursive"), 0
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seed.schema.fields)
    seed.distinct().write.parquet(f"{base}/round_n=0")
    while True:
        seen = spark.read.schema(f"{fields}, round_n int").parquet(base)
        new = seen.filter(F.col("round_n") == n).drop("round_n")
        if not new.take(1):
            return seen.drop("round_n")
        if limit is not None and n >= limit:
            raise RecursionError(f"no end after {limit} rounds")
        n += 1
        rows = step(new).distinct()
        told = [rows[c].eqNullSafe(seen[c]) for c in seed.columns]
        rows.join(seen, told, "left_anti").write.parquet(f"{base}/round_n={n}")
