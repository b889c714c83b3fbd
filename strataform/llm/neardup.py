"""Near-duplicates by Jaccard similarity: components of documents whose sets of five-word shingles reach 0.8.

Documents with equal sets collapse first (node: a 64-bit hash of the sorted set).  Candidates come from MinHash
in 28 bands of 4: at similarity 0.8 a pair shares no band with a chance of 0.59 ** 28 = 4e-7, and less above.
Each bucket links its nodes to its smallest.  Op7's method gives further candidates: SimHash fingerprints, linked at four
bits or fewer by ball hashing.  Components of both kinds of links say who may be near whom.  The sets of a
candidate component then meet in tiles of two blocks of about BLOCK nodes (fewer for long texts): a tile compares
all its pairs exactly and emits a spanning forest of the pairs at 0.8 or more, never all of them.  Every pair
of a candidate component meets in a tile, so no pair at 0.8 is lost to a bucket's choice of links.

Cases: texts that are null or without words have the empty set, equal to each other.  Fewer than five words make one
shingle.  Repeated and null doc_ids are as in simhash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_small, extended, fresh, lean, materialize, slices
from .simhash import _signed, components, fingerprint, keep_least, link_fingerprints, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 28, 4
#: Nodes and shingles of a block, about.
BLOCK, BLOCK_SHINGLES = 256, 1_000_000
_FACTORS = np.random.default_rng(17).integers(0, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def node_of(shingles: np.ndarray) -> int:
    """A signed long for a sorted set."""
    return _signed(xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes(), 7))


def bands(shingles: np.ndarray) -> list[int]:
    """A signed long for each band; none for the empty set, which nothing but itself is near."""
    if not len(shingles):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 512):
        least = np.minimum(least, np.multiply.outer(_FACTORS, shingles[i : i + 512]).min(axis=1))
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    return [_signed(xxhash.xxh64_intdigest(r.tobytes(), b)) for b, r in enumerate(rows)]


def with_node(docs: DataFrame, text: str, name: str, keep: list[str], extra: str | None = None) -> DataFrame:
    """The columns keep and a node; also the bands and the size, or the set, if extra is "bands" or "set"."""
    more = {None: [], "bands": ["_size long", "_bands array<long>", "_fp long"], "set": ["_set array<long>"]}[extra]
    own = docs.select(*keep)
    schema = extended(own, ", ".join([f"{name} long", *(f"{fresh(own, x.split()[0])} {x.split()[1]}" for x in more)]))
    d = docs.select(*keep, F.col(text).alias("_nd_text"))
    longs = pa.list_(pa.int64())

    def run(batches):
        for b in slices(batches, 100):
            sets = [shingle_set(t) for t in b.column(b.num_columns - 1).to_pylist()]
            out = [*b.columns[:-1], pa.array([node_of(s) for s in sets], pa.int64())]
            if extra == "bands":
                out += [pa.array([len(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], longs), pa.array([fingerprint(shingle_hashes(t)) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())]
            elif extra == "set":
                out.append(pa.array([s.view(np.int64) for s in sets], longs))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return d.mapInArrow(lean(run), schema)


def forest(nodes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs at SIMILARITY or more; each step compares one set with those not yet reached."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    own = [flat[e - n : e] for e, n in zip(ends, size)]
    mark = np.zeros(len(words), dtype=np.int64)
    left, edges = np.arange(len(sets)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            fit = left[np.minimum(size[left], size[at]) >= SIMILARITY * np.maximum(size[left], size[at])]
            if not len(fit):
                continue
            mark[own[at]] = 1
            both = np.add.reduceat(mark[np.concatenate([own[i] for i in fit])], np.concatenate(([0], np.cumsum(size[fit])[:-1])))
            mark[own[at]] = 0
            found = fit[5 * both >= 4 * (size[fit] + size[at] - both)]
            edges += [(int(nodes[at]), int(nodes[i])) for i in found]
            left = np.setdiff1d(left, found, assume_unique=True)
            queue += found.tolist()
    return edges


def _tile(pdf):
    import pandas as pd

    pdf = pdf.drop_duplicates("_node")
    e = forest(pdf["_node"].to_numpy(), [np.asarray(s, dtype=np.int64) for s in pdf["_set"]]) if len(pdf) > 1 else []
    return pd.DataFrame(np.array(e, dtype=np.int64).reshape(-1, 2), columns=["a", "b"])


def fingerprint_links(ids: DataFrame) -> DataFrame:
    """a and b: nodes whose documents' fingerprints are equal or in one component of op7's links, linked to the smallest of these nodes."""
    pairs = materialize(ids.select("_fp", "_node").distinct(), "fingerprints")
    linked = link_fingerprints(pairs.select("_fp").distinct()).withColumnRenamed("node", "_linked")
    told = materialize(pairs.join(linked, pairs._fp == F.col("_linked"), "left").select(F.coalesce("root", "_fp").alias("_group"), "_node").distinct(), "fingerprint-groups")
    least = told.groupBy("_group").agg(F.min("_node").alias("a"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_group", "a")
    return told.join(checked_small(least, "least-nodes"), "_group").select("a", F.col("_node").alias("b")).filter("a <> b")


def links(docs: DataFrame, ids: DataFrame, distinct: DataFrame, doc_id: str, text: str) -> DataFrame:
    """node and root of every node that is near another.  distinct: _node, _least, _size of each node."""
    keys = materialize(ids.select("_node", "_bands").dropDuplicates(["_node"]).select("_node", F.explode("_bands").alias("_key")), "bands")
    shared = keys.groupBy("_key").agg(F.min("_node").alias("a"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_key", "a")
    by_fingerprint = fingerprint_links(ids)
    # the common keys of copies are many rows of one key: each is met by a broadcast, or split by adaptive execution
    near = components(keys.join(checked_small(shared, "shared-keys"), "_key").select("a", F.col("_node").alias("b")).unionByName(by_fingerprint))
    near = materialize(near.join(distinct, near.node == distinct._node).select("_node", "root", "_least", "_size"), "candidates")
    blocks = near.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("_size") / BLOCK_SHINGLES)).cast("int").alias("_blocks"))
    near = near.join(blocks, "root").withColumn("_block", F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int"))
    near = checked_small(near.select(F.col("_node").alias("_want"), "_least", "root", "_block", "_blocks"), "blocks")
    # Only the documents that stand for a candidate are read again; a doc_id that repeats with other texts is told by its node.
    few = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_t")).join(near, F.col("_doc").eqNullSafe(F.col("_least")), "inner")
    sets = with_node(few, "_t", "_node", ["_want", "root", "_block", "_blocks"], "set").filter("_node = _want")
    sets = sets.groupBy("_node", "root", "_block", "_blocks").agg(F.first("_set").alias("_set"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    tiles = sets.select("_node", "_set", "root", "_block", other).select("_node", "_set", "root", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"))
    return components(tiles.groupBy("root", "_i", "_j").applyInPandas(_tile, "a long, b long"))


def jaccard_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id (one of them, where it repeats)."""
    name = fresh(docs, "_node")
    marked = materialize(with_node(docs, text, name, docs.columns, "bands"), "marked")
    extra = [marked.columns[len(docs.columns) + i] for i in range(4)]  # node, size, bands, fingerprint
    ids = marked.select(F.col(doc_id).alias("_doc"), *(F.col(c).alias(x) for c, x in zip(extra, ("_node", "_size", "_bands", "_fp"))))
    distinct = materialize(ids.groupBy("_node").agg(F.min("_doc").alias("_least"), F.count(F.lit(1)).alias("_n"), F.max("_size").alias("_size")), "sets")
    linked = materialize(links(docs, ids, distinct, doc_id, text), "near")
    grouped = distinct.join(linked, distinct._node == linked.node, "left").filter("_n > 1 OR root IS NOT NULL").select("_node", "_least", F.coalesce("root", "_node").alias("root"))
    least = checked_small(grouped.groupBy("root").agg(F.min("_least").alias("_c")), "least")
    groups = checked_small(grouped.join(least, "root").select(F.col("_node").alias("_g"), "_c", F.col("root").alias("_group")), "groups")
    return keep_least(docs, marked.select(*docs.columns, name), name, groups, doc_id)
