"""LM scoring: stupid-backoff scores of documents, from n-gram counts over all documents.

A word is a run of other than white space, A-Z lower-cased (or an id of a public tokenizer, if one is named).  An n-gram is
a 64-bit hash of its words.  Documents stand in chunks of about ``chunk_bytes`` of text.  Each order is a round of
relations: grams (bucket, chunk), exploded from the chunks, with how often a chunk holds each n-gram and whether several
of its documents do; counts, partitioned by the bucket of the hash and summed over chunks; and counts joined back to the
chunks that hold the n-gram, where each document's own occurrences are taken out (leave one out).  What is left of a
position's n-gram and of its context gives its score; what no other document holds backs off with factor 0.4, down to
single words, where a word not seen elsewhere counts half.  Scores are summed for each document.

A row holds the n-grams that one chunk has in one bucket, sorted and packed, so that shuffles move six bytes an n-gram
and few rows; back comes a bit for each, with the counts of those that are shared.  Buckets are as many as the counted words need.  A round explodes only n-grams whose two parts of one order
less are both held by another document: all others are held by no other document either, so nothing is lost.  A frequent
n-gram counts once a chunk; nothing is broadcast or collected; a task holds one chunk, or one bucket, at a time.

A chunk's words, as codes, and what is left of each order are files in the shared folder, written once, under names that no
other attempt has, and read by the rounds that need them; rows with their paths are all that rounds shuffle of them.

Cases: null and wordless texts have n_words 0 and null scores.  Repeated rows are documents of their own, which see one
another.  A text longer than a chunk is a chunk.  Texts shorter than the order are scored by the orders that they have.
An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, file_system, forget, materialize, scratch
from .tokens import WordTokenizer, parts

ORDER = 5
BACKOFF = 0.4
CHUNK_BYTES = 16 << 20
#: Words of the corpus for one bucket of n-gram hashes.
BUCKET_WORDS = 1_000_000


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of distinct words, the codes of all words, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat = split.flatten().dictionary_encode()
    words = flat.dictionary.to_pylist()
    codes = flat.indices.to_numpy()
    hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in words], dtype=np.uint64)
    full = np.ones(len(codes), dtype=bool) if "" not in words else codes != words.index("")  # ends of a text may be empty
    ends = np.concatenate(([0], np.cumsum(full)))[split.offsets.to_numpy() - split.offsets[0].as_py()]
    return hashes, codes[full].astype(np.uint32), np.diff(ends).astype(np.int64)


def ids_of(tokenizer: WordTokenizer, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, sizes = tokenizer.encode_array(texts)
    kinds, codes = np.unique(ids, return_inverse=True)
    return mixed(kinds.astype(np.uint64), np.uint64(1)), codes.astype(np.uint32), sizes


def mixed(h: np.ndarray, w) -> np.ndarray:
    """The hash of an n-gram and the word behind it."""
    h = h * np.uint64(0x9E3779B97F4A7C15) + w
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _pack(a: np.ndarray) -> bytes:
    """The bytes of each place together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    plain = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(plain.reshape(size, -1).T).reshape(-1).view(kind)


def pack_sorted(a: np.ndarray) -> bytes:
    return _pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _file(folder: str, data: bytes) -> str:
    """Written under a name of its own."""
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    name = uuid.uuid4().hex
    with fs.open_output_stream(f"{path}/{name}", compression=None) as f:
        f.write(data)
    return f"{folder}/{name}"


def _read(path: str) -> bytes:
    fs, name = file_system(path)
    with fs.open_input_stream(name, compression=None) as f:
        return f.read()


def runs_of(grams: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """bucket, begin and end of each run of sorted hashes in one bucket: hashes go to buckets in their order."""
    place = (grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1], [True]))) if len(place) else np.zeros(1, dtype=np.int64)
    return [(int(place[i]), int(i), int(j)) for i, j in zip(cut[:-1], cut[1:])]


class Chunk:
    """The words of a chunk's documents, and what other documents hold of the n-grams that start at each."""

    def __init__(self, lens: np.ndarray, words: np.ndarray, codes: np.ndarray, left: list[np.ndarray]):
        self.lens, self.words, self.codes, self.left = lens, words, codes, left
        self.ends = np.repeat(np.cumsum(lens), lens)

    @classmethod
    def of(cls, path: str, left: list[str]) -> "Chunk":
        data = _read(path)
        a, b = np.frombuffer(data[:16], dtype=np.int64)
        return cls(np.frombuffer(data[16 : 16 + a], dtype=np.int64), np.frombuffer(data[16 + a : 16 + a + b], dtype=np.uint64), _unpack(data[16 + a + b :], np.uint32), [_unpack(_read(x), np.uint32) for x in left])

    def write(self, folder: str) -> str:
        parts = self.lens.tobytes(), self.words.tobytes()
        return _file(folder, np.array([len(x) for x in parts], dtype=np.int64).tobytes() + b"".join(parts) + _pack(self.codes))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the n-grams of order k that another document may hold: their places, sorted by hash, their hashes, whether a gram begins, and whether a document begins in it."""
        at = np.arange(len(self.codes))
        fit = at + k <= self.ends
        if k > 1:
            seen = self.left[-1] > 0
            fit &= seen
            fit[:-1] &= seen[1:]
        at = at[fit]
        h = self.words[self.codes[at]]
        for j in range(1, k):
            h = mixed(h, self.words[self.codes[at + j]])
        order = np.argsort(h, kind="stable")
        at, h = at[order], h[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        own = new.copy()
        own[1:] |= self.ends[at[1:]] != self.ends[at[:-1]]
        return at, h, new, own

    def counted(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each gram, its occurrences, and whether one document (1) or more (2) hold it."""
        at, h, new, own = self.grams(k)
        begin = np.flatnonzero(new)
        if not len(begin):
            return h, begin, begin
        return h[begin], np.diff(np.append(begin, len(h))), np.minimum(np.add.reduceat(own.astype(np.int64), begin), 2)

    def learn(self, k: int, buckets: int, told: dict[int, tuple[bytes, bytes]]) -> None:
        """Take out each document's own occurrences.  told: of each bucket, which of this chunk's n-grams there several documents hold, and how often all chunks do."""
        at, h, new, own = self.grams(k)
        left = np.zeros(len(self.codes), dtype=np.uint32)
        if len(at):
            grams = h[new]
            total = np.zeros(len(grams), dtype=np.int64)
            for bucket, i, j in runs_of(grams, buckets):
                mask, n = told[bucket]
                total[i:j][np.unpackbits(np.frombuffer(mask, dtype=np.uint8), count=j - i).astype(bool)] = _unpack(n, np.uint32)
            total = total[np.cumsum(new) - 1]
            held = np.diff(np.append(np.flatnonzero(own), len(h)))[np.cumsum(own) - 1]
            left[at] = np.minimum(np.where(total > 0, total - held, 0), 0xFFFFFFFF)
        self.left.append(left)

    def scores(self, n_words: int, backoff: float = BACKOFF) -> np.ndarray:
        """The sum of natural logarithms of the scores of each document's words."""
        rest = np.repeat(np.maximum(1, n_words - self.lens), self.lens)
        out = np.log(np.maximum(self.left[0], 0.5) / rest)
        begins = self.ends - np.repeat(self.lens, self.lens)
        for k in range(2, len(self.left) + 1):
            at = np.arange(k - 1, len(out))
            at = at[at - (k - 1) >= begins[at]]  # the last word of an n-gram within a document
            here, context = self.left[k - 1][at - (k - 1)], self.left[k - 2][at - (k - 1)]
            out[at] = np.where(here > 0, np.log(np.maximum(here, 1) / np.maximum(context, 1)), out[at] + np.log(backoff))
        full = np.flatnonzero(self.lens)
        sums = np.zeros(len(self.lens))
        if len(full):
            sums[full] = np.add.reduceat(out, (np.cumsum(self.lens) - self.lens)[full])
        return sums


STATE = "chunk long, n long, path string, left array<string>"


def chunks(docs: DataFrame, doc_id: str, text: str, chunk_bytes: int, tokenizer: str | None, folder: str) -> DataFrame:
    """chunk, n (words), path, left (nothing yet) and docs (ids).  No shuffle."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = d.sparkSession.sparkContext.broadcast(open(tokenizer).read()) if tokenizer else None  # one vocabulary file

    def run(batches):
        tok, chunk = WordTokenizer(shared.value) if shared else None, TaskContext.get().partitionId() << 32
        for b in parts(batches, 1, chunk_bytes):
            words, codes, lens = ids_of(tok, b.column(1)) if tok else words_of(b.column(1))
            path = Chunk(lens, words, codes, []).write(folder)
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
            cols = [pa.array([x], k) for x, k in ((chunk, pa.int64()), (len(codes), pa.int64()), (path, pa.string()), ([], pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([*cols, ids], names=["chunk", "n", "path", "left", "docs"])
            chunk += 1

    return d.mapInArrow(run, f"{STATE}, docs array<{d.schema['doc_id'].dataType.simpleString()}>")


_GRAMS = "bucket long, chunk long, grams binary, n binary"
_MANY = np.uint32(1 << 31)


def _rows(bucket, chunk, grams, n):
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(chunk, pa.int64()), pa.array(grams, pa.binary()), pa.array(n, pa.binary())], names=["bucket", "chunk", "grams", "n"])


def exploded(state: DataFrame, k: int, buckets: int, tasks: int) -> DataFrame:
    """bucket, chunk, grams and n: the n-grams of order k of each chunk that another document may hold; the top bit of n tells that several documents of the chunk do."""

    def run(batches):
        for b in batches:
            for chunk, path, left in zip(*(b.column(i).to_pylist() for i in range(3))):
                grams, n, docs = Chunk.of(path, left[-1:] if k > 1 else []).counted(k)
                n = np.minimum(n, 0x7FFFFFFF).astype(np.uint32) | np.where(docs > 1, _MANY, np.uint32(0))
                runs = runs_of(grams, buckets)
                yield _rows([x for x, _, _ in runs], [chunk] * len(runs), [pack_sorted(grams[i:j]) for _, i, j in runs], [_pack(n[i:j]) for _, i, j in runs])

    return state.select("chunk", "path", "left").repartitionByRange(tasks, "chunk").mapInArrow(run, _GRAMS)


def totals(grams: DataFrame) -> DataFrame:
    """bucket, chunk, grams and n: for each row of exploded, a bit for each of its n-grams (whether two documents or more hold it), and of these how often all chunks do."""

    def told(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk").to_pylist()
        own = [unpack_sorted(x) for x in table.column("grams").to_pylist()]
        n = np.concatenate([_unpack(x, np.uint32) for x in table.column("n").to_pylist()])
        every = np.concatenate(own)
        order = np.argsort(every, kind="stable")
        begin = np.flatnonzero(np.concatenate(([True], every[order][1:] != every[order][:-1])))
        run = np.empty(len(every), dtype=np.int64)
        run[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(every))))
        shared = np.add.reduceat(np.where(n[order] & _MANY, 2, 1), begin) > 1
        total = np.minimum(np.add.reduceat((n[order] & ~_MANY).astype(np.int64), begin), 0xFFFFFFFF).astype(np.uint32)
        out, at = [], 0
        for g in own:
            r = run[at : at + len(g)]
            at += len(g)
            kept = shared[r]
            out.append((np.packbits(kept).tobytes(), _pack(total[r[kept]])))
        return pa.Table.from_batches([_rows(table.column("bucket").to_pylist(), chunk, [x for x, _ in out], [x for _, x in out])])

    return grams.groupBy("bucket").applyInArrow(told, _GRAMS)


def lm_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, chunk_bytes: int = CHUNK_BYTES, tokenizer: str | None = None, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """doc_id, n_words, log_score and mean_log_score of each row of docs.  tokenizer: the path of a vocabulary file."""
    if order < 1:
        raise ValueError("order is 1 or more")
    spark = docs.sparkSession
    folder = scratch(spark, "lm-chunks")
    state = materialize(chunks(docs, doc_id, text, chunk_bytes, tokenizer, folder), "chunks")
    n_words, n_chunks = state.agg(F.sum("n"), F.count(F.lit(1))).first()
    n_words = n_words or 0
    # A task for each chunk, and so many stated: a row is a path of a few bytes, by which adaptive execution would put all chunks in one task.
    tasks = max(1, n_chunks)
    buckets = max(1, -(-n_words // bucket_words))
    kind = docs.schema[doc_id].dataType.simpleString()

    def learner(k: int):
        def learn(left: pa.Table, right: pa.Table) -> pa.Table:
            row = left.to_pylist()[0]
            c = Chunk.of(row["path"], row["left"] if k == order else row["left"][-1:])
            c.learn(k, buckets, dict(zip(right.column("bucket").to_pylist(), zip(right.column("grams").to_pylist(), right.column("n").to_pylist()))))
            if k < order:
                more = pa.array([[*row["left"], _file(folder, _pack(c.left[-1]))]], pa.list_(pa.string()))
                return left.set_column(left.schema.get_field_index("left"), "left", more)
            ids = pa.concat_arrays([x.flatten() for x in left.column("docs").chunks])
            sums, full = c.scores(n_words), c.lens > 0
            return pa.table([ids, pa.array(c.lens), pa.array(sums, mask=~full), pa.array(sums / np.maximum(c.lens, 1), mask=~full)], names=["doc_id", "n_words", "log_score", "mean_log_score"])

        return learn

    for k in range(1, order + 1):
        told = materialize(totals(exploded(state, k, buckets, tasks)), f"counts-{k}")
        forget(spark)
        out = state.repartition(tasks, "chunk").groupBy("chunk").cogroup(told.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(learner(k), state.schema if k < order else f"doc_id {kind}, n_words long, log_score double, mean_log_score double")
        if k == order:
            return out
        after = materialize(out, f"order-{k}")
        discard(told)
        discard(state)
        state = after
        del out, told
        forget(spark)


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    d = lm_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def _oracle(order: int) -> str:
    """Counts of each order, each document's own taken out, the longest one that is left for each word."""
    count = "\n".join(
        f"g{k} AS (SELECT rid, p, c - own AS left_{k} FROM (SELECT rid, p, count(*) OVER (PARTITION BY g) AS c, count(*) OVER (PARTITION BY g, rid) AS own "
        f"FROM (SELECT rid, p, array_to_string(w[p:p + {k - 1}], ' ') AS g FROM places WHERE p + {k - 1} <= len(w)))),"
        for k in range(1, order + 1)
    )
    score = f"ln(greatest(u.left_1, 0.5) / greatest(1, (SELECT sum(len(w)) FROM d) - n))"
    for k in range(2, order + 1):
        context = "c1.left_1" if k == 2 else f"c{k - 1}.left_{k - 1}"
        score = f"CASE WHEN a{k}.left_{k} IS NULL THEN {score} WHEN a{k}.left_{k} > 0 THEN ln(a{k}.left_{k} / {context}) ELSE {score} + ln({BACKOFF}) END"
    joins = "\n".join(f"LEFT JOIN g{k} a{k} ON a{k}.rid = o.rid AND a{k}.p = o.p - {k - 1} LEFT JOIN g{k - 1} c{k - 1} ON c{k - 1}.rid = o.rid AND c{k - 1}.p = o.p - {k - 1}" for k in range(2, order + 1))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT rid, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS p FROM d),
{count}
scored AS (SELECT o.rid, sum({score}) AS s FROM places o JOIN g1 u ON u.rid = o.rid AND u.p = o.p
{joins} GROUP BY o.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(s, 4) AS log_score, round(s / len(w), 6) AS mean_log_score FROM d LEFT JOIN scored USING (rid)
"""


ORACLE = _oracle(ORDER)
