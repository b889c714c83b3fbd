"""SimHash near-duplicates: exact components of fingerprints that differ in at most four of 64 bits.

Meet in the middle.  Two fingerprints at distance four or less differ in at most two bits on the best two
of three blocks (21, 21 and 22 bits): three drops of one block each leave 42 or 43 bits to compare within
a radius of two.  Every distinct fingerprint emits, for each drop, all variants within half that radius:
itself and each single flip of a kept bit.  Fingerprints within the radius share a variant.  A shuffle on
variants brings them together; each bucket verifies whole fingerprints and emits a spanning forest of its
links, never all its pairs.  That takes 131 rows for each fingerprint, where variants of all 64 bits within
two flips take 2081, and finds the same links; ``whole=True`` emits those 2081 instead.

Buckets hold distinct fingerprints alone (copies are aggregated before), and no bucket is cut short.
Components come from alternating large-star and small-star rounds over written tables; nodes with many links get their
minimum by a broadcast whose rows are bounded by the count of links, so that no key's links meet in one task.

Cases: text that is null or without words has fingerprint zero, linked like any other.  Repeated rows
keep a row each.  A null doc_id is never a component's smallest unless all its ids are null (then the
component_id is null).  An empty table gives no rows.  Other columns pass or are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_small, discard, extended, fresh, lean, materialize, slices

RADIUS = 4
SHINGLE = 4
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BLOCKS = ((0, 21), (21, 42), (42, 64))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle, repeats included; fewer words make one shingle."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(joined, 42)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = (ends - sizes)[: len(words) - k + 1].tolist()
    return np.array([h(joined[a:b], 42) for a, b in zip(begins, ends[k - 1 :].tolist())], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit set where over half of the hashes have it, as a signed long.  Blocks bound memory for long texts."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(packed.view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "_fp", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all, if not given) and a long column of fingerprints."""
    keep = docs.columns if keep is None else keep
    schema = extended(docs.select(*keep), f"{name} long")
    d = docs.select(*keep, F.col(text).alias("_fp_text"))

    def run(batches):
        for b in slices(batches):
            fps = [fingerprint(shingle_hashes(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.int64())], names=[*keep, name])

    return d.mapInArrow(lean(run), schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(fps: DataFrame, fp: str = "_fp", whole: bool = False) -> DataFrame:
    """_key and _fp: each variant of each fingerprint; the dropped block of a key says which block it is.

    whole: no block is dropped, and a variant flips up to two of all 64 bits.
    """
    if whole:
        flips = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i in range(64) for j in range(i))]
        d = fps.select(F.col(fp).alias("_fp"), F.explode(F.array(*(F.lit(_signed(x)).cast("long") for x in flips))).alias("_v"))
        return d.select(F.col("_fp").bitwiseXOR(F.col("_v")).alias("_key"), "_fp")
    parts = []
    for i, (a, b) in enumerate(BLOCKS):
        dropped = ((1 << (b - a)) - 1) << a
        tag = (i + 1) << a
        kept = [j for j in range(64) if not dropped >> j & 1]
        for flip in [0, *(1 << j for j in kept)]:
            parts.append(F.struct(F.lit(_signed(~dropped & (1 << 64) - 1)).cast("long").alias("m"), F.lit(_signed(flip | tag)).cast("long").alias("x")))
    d = fps.select(F.col(fp).alias("_fp"), F.explode(F.array(*parts)).alias("_v"))
    return d.select(F.col("_fp").bitwiseAND(F.col("_v.m")).bitwiseXOR(F.col("_v.x")).alias("_key"), "_fp")


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints; each step compares one with those not yet reached."""
    left, edges = fps, []
    while len(left):
        root, left, queue = left[0], left[1:], [left[0]]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count((left ^ at).view(np.uint64)) <= RADIUS
            found = left[near]
            left = left[~near]
            edges += [(int(root), int(x)) for x in found]
            queue += list(found)
    return edges


def _bucket_edges(batches):
    """Links of each run of equal keys, in rows sorted by key; a run may span batches."""
    held_k, held_f = np.zeros(0, dtype=np.int64), []
    pending: list[np.ndarray] = []

    def emit(key: np.ndarray, fp: np.ndarray):
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(cut)
        two = cut[:-1][size == 2]
        a, b = fp[two], fp[two + 1]
        near = np.bitwise_count((a ^ b).view(np.uint64)) <= RADIUS
        edges = [np.stack([a[near], b[near]], axis=1)]
        for i, n in zip(cut[:-1][size > 2], size[size > 2]):
            if e := _forest(fp[i : i + n]):
                edges.append(np.array(e, dtype=np.int64))
        e = np.concatenate(edges)
        lo, hi = e.min(axis=1), e.max(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], names=["a", "b"])

    for batch in batches:
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1], side="left"))  # the last run may go on in the next batch
        if held_f and key[0] != held_k:
            yield emit(np.full(sum(map(len, held_f)), held_k), np.concatenate(held_f))
            held_f = []
        if held_f and last == 0:
            held_f.append(fp)
            continue
        head = np.concatenate([*held_f, fp[:last]])
        if len(head):
            yield emit(np.concatenate([np.full(len(head) - last, held_k, dtype=np.int64), key[:last]]), head)
        held_k, held_f = key[-1], [fp[last:]]
    if held_f:
        yield emit(np.full(sum(map(len, held_f)), held_k), np.concatenate(held_f))


#: Rows of minima that are broadcast in a round of components, at most; by arithmetic, not by a count of them.
HUBS = 50_000


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of each node of edges(a, b), by large-star and small-star rounds."""

    def star(e: DataFrame, large: bool, n: int) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        if 4 * n <= HUBS:  # at most two rows a link
            j = both.join(F.broadcast(least), "a")
        else:  # of 2n links, at most HUBS / 2 nodes have more than 4n / HUBS
            bound = 4 * n // HUBS
            hubs = both.join(F.broadcast(least.filter(F.col("n") > bound).select("a", "m")), "a", "left")
            j = hubs.filter("m IS NOT NULL").unionByName(hubs.filter("m IS NULL").select("a", "b").join(least.filter(F.col("n") <= bound).select("a", "m"), "a"))
        if large:
            out = j.filter("b > a").select(F.col("b").alias("x"), "m")
        else:
            out = j.select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
        return out.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()

    at = materialize(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    sign = None
    while True:
        now = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == sign or not now[0]:
            break
        sign = now
        after = materialize(star(star(at, True, now[0]), False, 2 * now[0]), "stars")
        discard(at)
        at = after
    roots = at.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()


def link_fingerprints(fps: DataFrame, whole: bool = False) -> DataFrame:
    """_fp and root of every fingerprint that links to another; fps has distinct _fp."""
    buckets = variants(fps, whole=whole).repartition("_key").sortWithinPartitions("_key")
    return components(buckets.mapInArrow(_bucket_edges, "a long, b long"))


def duplicate_groups(ids: DataFrame, doc_id: str = "_doc", fp: str = "_fp") -> DataFrame:
    """_fp and component_id of the fingerprints that two rows or more share or that link to another.

    ids is read several times: give it written.
    """
    distinct = materialize(ids.groupBy(F.col(fp).alias("_fp")).agg(F.min(doc_id).alias("_least"), F.count(F.lit(1)).alias("_n")), "fingerprints")
    linked = materialize(link_fingerprints(distinct.select("_fp")), "components")
    grouped = distinct.join(linked, distinct._fp == linked.node, "left").select("_fp", "_least", "_n", "root")
    grouped = grouped.filter("_n > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "_fp"))
    least = checked_small(grouped.groupBy("root").agg(F.min("_least").alias("component_id")), "least")
    return grouped.join(least, "root").select("_fp", "component_id")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_doc, _fp and component_id of each row of docs."""
    ids = materialize(with_fingerprint(docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_t")), "_t", keep=["_doc"]), "simhash")
    groups = checked_small(duplicate_groups(ids).withColumnRenamed("_fp", "_g"), "groups")
    return ids.join(groups, ids._fp == groups._g, "left").select("_doc", "_fp", F.when(F.col("_g").isNull(), F.col("_doc")).otherwise(F.col("component_id")).alias("component_id"))


def simhash_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id (one of them, where it repeats)."""
    name = fresh(docs, "_fp")
    marked = materialize(with_fingerprint(docs, text, name), "marked")
    groups = checked_small(duplicate_groups(marked.select(F.col(doc_id).alias("_doc"), F.col(name).alias("_fp"))).select(F.col("_fp").alias("_g"), F.col("component_id").alias("_c")), "groups")
    return keep_least(docs, marked, name, groups, doc_id)


def keep_least(docs: DataFrame, marked: DataFrame, name: str, groups: DataFrame, doc_id: str) -> DataFrame:
    """A row of each group of marked (docs with the column name): groups has _g (values of name), _c (the smallest doc_id), and _group if not told by _c and _g."""
    root = fresh(docs, "_root")
    kept = marked.join(groups, marked[name] == groups._g, "left").filter(F.col("_g").isNull() | F.col("_c").eqNullSafe(F.col(doc_id)))
    # A row per group is left, but for groups whose smallest doc_id repeats or is null: only these are dealt by group.
    alone = kept.filter("_g IS NULL").select(*docs.columns)
    one = kept.filter("_g IS NOT NULL")
    per = one.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 OR _c IS NULL")
    if not checked_small(per, "repeated").take(1):
        return kept.select(*docs.columns)
    told = F.col("_group") if "_group" in groups.columns else F.coalesce(F.col("_c").cast("string"), F.concat(F.lit("fp "), F.col("_g").cast("string")))
    one = one.withColumn(root, told).dropDuplicates([root])
    return alone.unionByName(one.select(*docs.columns))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    d = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select(F.col("_doc").alias("doc_id"), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")
