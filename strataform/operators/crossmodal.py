"""One query over vectors, texts and a graph that share their keys: each hit scores its weight over 1 + its distance or place, and scores add up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize
from . import search, vectors
from .graphs import Graph

MODES = ("vector", "fulltext", "graph", "hybrid")


def places(d: DataFrame, *order: str) -> DataFrame:
    """d with place, from 0, in an order of all rows: sorted by range, counted by partition, so that no task numbers all of them."""
    kept = materialize(d.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "places")
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))  # a row a partition
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_at")) - 1
    return kept.withColumn("_own", own).join(F.broadcast(base), "_part").withColumn("place", F.col("_base") + F.col("_own")).drop("_part", "_at", "_n", "_base", "_own")


class CrossModal:
    """key: the column of the key in all results.  Any of the three stores may be missing; a mode whose store or argument is missing adds nothing."""

    def __init__(self, embeddings: DataFrame | None = None, texts: search.TextIndex | None = None, graph: Graph | None = None, key: str = "doc_id", embedding_key: str = "vec_id", column: str = "embedding"):
        self.embeddings, self.texts, self.graph = embeddings, texts, graph
        self.key, self.embedding_key, self.column = key, embedding_key, column

    def vector(self, query: list[float], k: int = 10, where=None, weight: float = 1.0) -> DataFrame:
        near = vectors.knn(self.embeddings, query, k, self.column, self.embedding_key, "cosine", where)
        return near.select(F.col(self.embedding_key).alias(self.key), (weight / (1 + F.col("distance"))).alias("score"))

    def fulltext(self, query: str, k: int = 10, weight: float = 1.0) -> DataFrame:
        found = search.ranked(self.texts.bm25(query, k), [F.desc("score"), self.texts.key], k)
        return found.select(F.col(self.texts.key).alias(self.key), (F.lit(weight) / F.col("rank")).alias("score"))

    def traverse(self, start, traversal: str = "bfs", max_depth: int | None = None, weight: float = 1.0) -> DataFrame:
        """Nodes in the order of a traversal: bfs (and shortest) by depth and id, dfs by its preorder."""
        if traversal == "dfs":
            got = self.graph.dfs(start, max_depth).withColumnRenamed("position", "place")
        else:
            got = places(self.graph.bfs(start, max_depth).select("id", "depth"), "depth", "id")
        return got.select(F.col("id").alias(self.key), (F.lit(weight) / (1 + F.col("place"))).alias("score"))

    def search(self, mode: str = "hybrid", vector: list[float] | None = None, text: str | None = None, start=None, k: int = 10, where=None, traversal: str = "bfs", max_depth: int | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), limit: int | None = None) -> DataFrame:
        """key and score, summed over what the mode asks for; the limit best, if one is given."""
        if mode not in MODES:
            raise ValueError(f"modes are {', '.join(MODES)}")
        found = []
        if mode in ("vector", "hybrid") and vector and self.embeddings is not None:
            found.append(self.vector(vector, k, where, weights[0]))
        if mode in ("fulltext", "hybrid") and text and self.texts is not None:
            found.append(self.fulltext(text, k, weights[1]))
        if mode in ("graph", "hybrid") and start is not None and self.graph is not None:
            found.append(self.traverse(start, traversal, max_depth, weights[2]))
        if not found:
            raise ValueError(f"nothing to search by in mode {mode}")
        out = found[0]
        for d in found[1:]:
            out = out.unionByName(d)
        out = out.groupBy(self.key).agg(F.sum("score").alias("score"))
        return out.orderBy(F.desc("score"), self.key).limit(limit) if limit is not None else out
