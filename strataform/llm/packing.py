"""Best-fit packing: a grouping genetic algorithm on islands, with elites that migrate.

Documents become token ids and a closing id 0; only longer ones are cut, at the capacity.  Full pieces are
sequences of their own.  The others are dealt by a hash of their unique number into groups of about
``group`` pieces (as many groups as the counted pieces need), and each group is packed on several islands.
An island keeps a small population of packings.  Crossover injects whole well-filled bins of one parent
into the other, removes the other's bins that hold the same pieces, and best-fits the displaced pieces,
longest first.  After each round an island's best packing goes to the next island.  An island rests once it
has reached the lower bound (tokens over capacity, or pieces over half of it), which proves its packing best for its
group.  Then the worst-filled sequences of all groups are opened, and their pieces are dealt into groups and packed the
same way again, so that what groups waste at their edges is packed across groups.  Of each piece are told its level
(1, or 2 where it was packed across groups) and how many sequences evolution saved in its group against best fit.

Cases: null and empty texts are one piece of one id.  Repeated rows are pieces of their own.  Texts of any
length are cut, never dropped.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import random
import zlib
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, lean, materialize
from .tokens import WordTokenizer, default_path, parts

CAPACITY = 2048
GROUP = 4096
ISLANDS, POPULATION, GENERATIONS, ROUNDS = 3, 5, 4, 3
#: Sequences of each group that are packed again across groups.
OPENED = 8
END = array("I", [0]).tobytes()


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, ids: bool = False) -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian bytes) of each piece.  No shuffle."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    definition = d.sparkSession.sparkContext.broadcast(open(tokenizer or default_path()).read())  # one vocabulary file

    def run(batches):
        tok, at = WordTokenizer(definition.value), TaskContext.get().partitionId() << 40
        step = 4 * capacity
        for b in parts(batches, 1):
            kinds = [pa.int64(), b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            docs_of = iter(b.column(0).to_pylist())
            for found, sizes in tok.encode_runs(b.column(1)):
                data, rows, begin = found.astype("<u4").tobytes(), [], 0
                for n, i in zip(sizes.tolist(), docs_of):
                    e = data[begin : begin + 4 * n] + END
                    begin += 4 * n
                    for k in range(0, len(e), step):
                        part = e[k : k + step]
                        rows.append((at, i, k // step, k // 4, len(part) // 4, zlib.crc32(part), part if ids else None))
                        at += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)][: 7 if ids else 6], names=["uid", "doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 7 if ids else 6])
            give_back()

    return d.mapInArrow(lean(run), f"uid long, doc_id {d.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if ids else ""))


def lower_bound(lens, capacity: int = CAPACITY) -> int:
    return max(-(-sum(lens) // capacity), sum(2 * x > capacity for x in lens))


def best_fit(bins: list[list[int]], items: list[int], lens: list[int], capacity: int) -> list[list[int]]:
    """Put items, in order, each into the fullest bin that still holds it.  A bit per free space finds that bin."""
    by_room: dict[int, list[int]] = {}
    mask = 0
    for i, b in enumerate(bins):
        r = capacity - sum(lens[x] for x in b)
        by_room.setdefault(r, []).append(i)
        mask |= 1 << r
    for x in items:
        n = lens[x]
        m = mask >> n
        if m:
            r = n + (m & -m).bit_length() - 1
            i = by_room[r].pop()
            if not by_room[r]:
                mask ^= 1 << r
            bins[i].append(x)
        else:
            r, i = capacity, len(bins)
            bins.append([x])
        by_room.setdefault(r - n, []).append(i)
        mask |= 1 << (r - n)
    return bins


def fitness(bins: list[list[int]], lens: list[int]) -> tuple:
    """Fewer bins first; then fuller ones."""
    return len(bins), -sum(sum(lens[x] for x in b) ** 2 for b in bins)


def crossover(a: list[list[int]], b: list[list[int]], lens: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    full = sorted(a, key=lambda x: -sum(lens[i] for i in x))
    share = rng.uniform(0.3, 0.8)
    injected = [x for x in full[: max(1, int(len(full) * share))] if rng.random() < 0.9]
    inside = {i for x in injected for i in x}
    kept, displaced = [], []
    for x in b:
        if inside.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in inside]
    for _ in range(max(1, len(kept) // 50)):  # mutation: a few bins of the other parent are dealt anew
        if kept:
            displaced += kept.pop(rng.randrange(len(kept)))
    displaced.sort(key=lambda i: -lens[i])
    return best_fit([list(x) for x in injected] + kept, displaced, lens, capacity)


def evolve(lens: list[int], population: list[list[list[int]]], seed: str, capacity: int = CAPACITY, size: int = POPULATION, generations: int = GENERATIONS) -> list[list[list[int]]]:
    """The population after some generations, best first."""
    rng, bound = random.Random(seed), lower_bound(lens, capacity)
    pop = list(population)
    while len(pop) < size:
        noise = 0.0 if not pop else rng.uniform(0.02, 0.3)
        pop.append(best_fit([], sorted(range(len(lens)), key=lambda i: -lens[i] * (1 + noise * rng.random())), lens, capacity))
        if len(pop[-1]) <= bound:
            break
    pop.sort(key=lambda p: fitness(p, lens))
    for _ in range(generations):
        if len(pop[0]) <= bound:
            break
        for _ in range(size - 1):
            a, b = rng.sample(pop, 2) if len(pop) > 1 else (pop[0], pop[0])
            pop.append(crossover(a, b, lens, capacity, rng))
        pop.sort(key=lambda p: fitness(p, lens))
        del pop[size:]
    return pop[:size]


def _assigned(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _bins(assigned: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(assigned, default=-1) + 1)]
    for i, k in enumerate(assigned):
        out[k].append(i)
    return [b for b in out if b]


_POP = pa.list_(pa.list_(pa.int32()))
_STATE = "shard long, island int, lens array<int>, pop array<array<int>>, bins int, start int, done boolean"


def _evolved(dealt: DataFrame, groups: int, capacity: int, islands: int, rounds: int) -> DataFrame:
    """shard, bin (of each piece), bins and start (the best packing before any crossover) of each group of dealt(shard, lens)."""
    state = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lens", F.array().cast("array<array<int>>").alias("pop"), F.lit(None).cast("int").alias("start"))
    for r in range(rounds):

        def run(batches, r=r):
            for b in batches:
                shard, island, lens, pop, start = (b.column(i).to_pylist() for i in range(5))
                out, best, done, began = [], [], [], []
                for s, i, n, p, k in zip(shard, island, lens, pop, start):
                    got = evolve(n, [_bins(x) for x in p], f"{s} {i} {r}", capacity)
                    out.append([_assigned(x, len(n)) for x in got[:2]])
                    best.append(len(got[0]))
                    began.append(len(best_fit([], sorted(range(len(n)), key=lambda x: -n[x]), n, capacity)) if k is None else k)
                    done.append(len(got[0]) <= lower_bound(n, capacity))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, _POP), pa.array(best, pa.int32()), pa.array(began, pa.int32()), pa.array(done, pa.bool_())], names=["shard", "island", "lens", "pop", "bins", "start", "done"])

        # a few islands a task, whatever their size in bytes
        state = materialize(state.repartition(max(1, groups * islands // 4), "shard", "island").mapInArrow(run, _STATE), f"round-{r}")
        if r == rounds - 1 or not state.groupBy("shard").agg(F.bool_or("done").alias("any")).filter("NOT any").take(1):
            break
        moved = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.lit(None).cast("array<int>").alias("lens"), F.slice("pop", 1, 1).alias("pop"), F.lit(None).cast("int").alias("start"))
        state = state.select("shard", "island", "lens", "pop", "start").unionByName(moved).groupBy("shard", "island").agg(F.first("lens", ignorenulls=True).alias("lens"), F.flatten(F.collect_list("pop")).alias("pop"), F.max("start").alias("start"))
    return state.groupBy("shard").agg(F.min_by(F.element_at("pop", 1), F.struct("bins", "island")).alias("bin"), F.min("bins").alias("bins"), F.min("start").alias("start"))


def _level(rest: DataFrame, capacity: int, group: int, islands: int, rounds: int, level: int, opened: int) -> DataFrame:
    """uid, length, sequence_id, offset, level and saved of each row of rest(uid, length), written; sequence_id is null for the pieces of a group's `opened` worst-filled sequences, unless there is one group alone."""
    groups = max(1, -(-rest.count() // group))
    dealt = rest.groupBy(F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(groups)).alias("shard")).agg(F.sort_array(F.collect_list(F.struct(F.col("length").cast("int").alias("n"), "uid")), asc=False).alias("p"))
    dealt = materialize(dealt.select("shard", F.col("p.n").alias("lens"), F.col("p.uid").alias("uids")), "groups")
    best = _evolved(dealt.select("shard", "lens"), groups, capacity, islands, rounds)
    spare = opened if groups > 1 else 0

    def lay(batches):
        for b in batches:
            shard, lens, uids, bins, count, start = (b.column(i).to_pylist() for i in range(6))
            for s, n, u, k, c, first in zip(shard, lens, uids, bins, count, start):
                filled, offset = {}, []
                for x, at in zip(n, k):
                    offset.append(filled.get(at, 0))
                    filled[at] = offset[-1] + x
                again = set(sorted((at for at, full in filled.items() if full < capacity), key=lambda at: (filled[at], at))[:spare])
                where = [None if at in again else level << 60 | s << 24 | at for at in k]
                size = len(u)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u, pa.int64()), pa.array(n, pa.int64()), pa.array(where, pa.int64()), pa.array(offset, pa.int64()), pa.array([level] * size, pa.int32()), pa.array([first - c] * size, pa.int32())],
                    names=["uid", "length", "sequence_id", "offset", "level", "saved"],
                )

    laid = dealt.join(best, "shard").select("shard", "lens", "uids", "bin", "bins", "start")
    return materialize(laid.mapInArrow(lay, "uid long, length long, sequence_id long, offset long, level int, saved int"), "laid")


def pack_pieces(sized: DataFrame, capacity: int = CAPACITY, group: int = GROUP, islands: int = ISLANDS, rounds: int = ROUNDS, opened: int = OPENED) -> DataFrame:
    """uid, sequence_id, offset, level and saved of each row of sized(uid, length), with lengths from 1 to capacity.  sized is read twice: give it written."""
    columns = ["uid", "sequence_id", "offset", "level", "saved"]
    full = sized.filter(F.col("length") == capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).alias("level"), F.lit(0).alias("saved"))
    first = _level(sized.filter(F.col("length") < capacity), capacity, group, islands, rounds, 1, opened)
    again = first.filter("sequence_id IS NULL").select("uid", "length")
    out = full.unionByName(first.filter("sequence_id IS NOT NULL").select(*columns))
    return out.unionByName(_level(again, capacity, group, islands, rounds, 2, 0).select(*columns)) if again.take(1) else out


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, ids: bool = False, **kw) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset, level and saved of each piece of each document."""
    cut = materialize(pieces(docs, doc_id, text, capacity, tokenizer, ids), "pieces")
    return cut.join(pack_pieces(cut.select("uid", "length"), capacity, **kw), "uid").drop("uid")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
