"""Full-text search: a stored inverted index with BM25, TF-IDF, phrase, proximity, boolean, fuzzy, n-gram and wildcard
search; facets and rank fusion.

The index is a list of segments in the shared folder.  A segment holds postings (term, key, tf, positions, dl), partitioned
by a bucket of the term's hash and sorted by term, documents (key, dl) and terms (term, freq).  A search names its terms, so
it reads their buckets alone, and within these the row groups whose statistics fit.

Postings are made a batch of documents at a time: a batch's tokens, sorted by term, are a packed run for each bucket, and
only runs are shuffled.
"""

from __future__ import annotations

import re
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import STOP, tokens
from ..sources.tables import discard, materialize, scratch

K1, B = 1.2, 0.75
BUCKETS = 16
#: Tokens of a run, and postings that are sorted together when runs are written, about.
RUN_TOKENS, WRITE_ROWS = 2_000_000, 2_000_000
#: Tasks that a bucket's runs are dealt to, at most.
SPREAD = 32
#: Terms, found in the vocabulary, that are looked up by name; of more, all postings are read.
NAMED_TERMS = 1000
#: Tombstones that are broadcast, at most; more are joined by shuffle.
DEAD_ROWS = 1_000_000


def query_terms(query: str) -> list[str]:
    return [t for t in re.findall(r"(?:[^\W\d]|-)+", query.lower()) if 2 <= len(t.encode()) <= 64 and t not in STOP]


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """term, key, tf, positions (from 0) and dl (the document's tokens) of each term of each document."""
    d = docs.select(key, tokens(text).alias("_t"))
    e = d.select(key, F.size("_t").alias("dl"), F.posexplode("_t").alias("pos", "term"))
    return e.groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"), F.first("dl").alias("dl"))


def words(text) -> Column:
    """What tokens() gives before stop words and lengths are looked at, with empty strings."""
    return F.split(F.lower(text), r"[^\p{L}_-]+")


def _packed(runs: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, runs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(runs)
    return sink.getvalue().to_pybytes()


def _own_terms(runs: pa.Table) -> pa.Table:
    """runs with a dictionary of the terms in it alone."""
    term = runs.column(0).combine_chunks()
    if pa.types.is_dictionary(term.type):
        used, at = np.unique(term.indices.to_numpy(), return_inverse=True)
        term = pa.DictionaryArray.from_arrays(pa.array(at.astype(np.int32)), term.dictionary.take(pa.array(used)))
    else:
        term = term.dictionary_encode()
    return runs.set_column(0, "term", term)


def _by_bucket(runs: pa.Table, buckets: np.ndarray):
    """The parts of a table by its rows' buckets, packed, with a number that deals them to tasks."""
    order = np.argsort(buckets, kind="stable")
    ends = np.flatnonzero(np.diff(buckets[order], append=-1)) + 1
    begin = 0
    for e in ends.tolist():
        yield int(buckets[order[begin]]), _packed(_own_terms(runs.take(pa.array(order[begin:e]))))
        begin = e


def _bucket_of(terms: list[str], buckets: int) -> np.ndarray:
    """pmod(xxhash64(term), buckets), as Spark has it."""
    return np.array([((h ^ 1 << 63) - (1 << 63)) % buckets for h in (xxhash.xxh64_intdigest(t.encode(), 42) for t in terms)], dtype=np.int64)


def _run(key: pa.Array, split: pa.Array, buckets: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The postings of some documents sorted by term, their buckets, and the documents' tokens."""
    lens = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    told = split.flatten().dictionary_encode()
    terms = told.dictionary
    size = pc.binary_length(terms)
    fit = pc.and_(pc.and_(pc.greater_equal(size, 2), pc.less_equal(size, 64)), pc.invert(pc.is_in(terms, pa.array(STOP, pa.string())))).to_numpy(zero_copy_only=False)
    place = np.full(len(terms), -1, dtype=np.int32)
    place[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms), dtype=np.int32)  # in order of the terms
    code = told.indices.to_numpy(zero_copy_only=False)
    keep = fit[code] if len(terms) else np.zeros(0, dtype=bool)
    doc, code = np.repeat(np.arange(len(lens), dtype=np.int32), lens)[keep], code[keep]
    dl = np.bincount(doc, minlength=len(lens)).astype(np.int32)
    pos = (np.arange(len(doc)) - (np.cumsum(dl) - dl)[doc]).astype(np.int32)
    order = np.argsort(place[code], kind="stable")
    doc, code, pos = doc[order], code[order], pos[order]
    first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])))) if len(doc) else np.zeros(0, dtype=np.int64)
    ends = np.append(first, len(doc))
    doc, code = doc[first], code[first]
    used, at = np.unique(code, return_inverse=True)
    own = terms.take(pa.array(used))
    found = pa.table({"term": pa.DictionaryArray.from_arrays(pa.array(at.astype(np.int32)), own), "key": key.take(pa.array(doc)), "tf": pa.array(np.diff(ends)), "positions": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(pos)), "dl": pa.array(dl[doc])})
    return found, _bucket_of(own.to_pylist(), buckets)[at] if len(at) else np.zeros(0, dtype=np.int64), dl


def _cuts(lens: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Where to cut rows of these lengths into parts of about `most`, a row at least."""
    group = (np.cumsum(lens) - lens) // most
    cut = np.flatnonzero(np.diff(group, prepend=-1, append=-1)).tolist()
    return list(zip(cut[:-1], cut[1:]))


def _text_runs(buckets: int):
    """Of batches of key and words: packed runs by bucket, and in bucket -1 the keys and tokens of the documents."""

    def run(batches):
        n = TaskContext.get().partitionId()
        for b in batches:
            lens = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            for i, j in _cuts(lens, RUN_TOKENS):
                key = b.column(0).slice(i, j - i)
                found, at, dl = _run(key, b.column(1).slice(i, j - i), buckets)
                rows = [(-1, _packed(pa.table({"key": key, "dl": pa.array(dl)}))), *_by_bucket(found, at)]
                n += 1
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int32()), pa.array([n % SPREAD] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "sub", "run"])

    return run


def _row_runs(batches):
    """Of batches of postings: packed runs by bucket, to be sorted when they are written."""
    n = TaskContext.get().partitionId()
    for b in batches:
        n += 1
        rows = list(_by_bucket(pa.Table.from_batches([b]).drop_columns("bucket"), b.column("bucket").to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int32()), pa.array([n % SPREAD] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "sub", "run"])


def _sorted_rows(got: list[tuple[int, pa.Table]], key: str):
    """The postings of some runs sorted by bucket and term, in batches."""
    buckets = np.repeat([x for x, _ in got], [t.num_rows for _, t in got])
    rows = pa.concat_tables([t for _, t in got]).unify_dictionaries().combine_chunks()
    if not rows.num_rows:
        return
    term = rows.column(0).chunk(0)
    place = np.empty(len(term.dictionary), dtype=np.int32)
    place[pc.sort_indices(term.dictionary).to_numpy()] = np.arange(len(place), dtype=np.int32)
    order = np.lexsort((place[term.indices.to_numpy()], buckets))
    for i in range(0, len(order), 50_000):
        part = rows.take(pa.array(order[i : i + 50_000])).combine_chunks()
        cols = [part.column(c).chunk(0) for c in range(5)]
        yield pa.RecordBatch.from_arrays([cols[0].dictionary_decode(), *cols[1:], pa.array(buckets[order[i : i + 50_000]], pa.int64())], names=["term", key, "tf", "positions", "dl", "bucket"])


def _written_rows(key: str):
    """Of batches of packed runs: their postings, sorted some runs at a time."""

    def run(batches):
        got, n = [], 0
        for b in batches:
            for bucket, packed in zip(b.column(0).to_pylist(), b.column(1)):
                t = pa.ipc.open_stream(packed.as_buffer()).read_all()
                got.append((bucket, t))
                n += t.num_rows
                if n >= WRITE_ROWS:
                    yield from _sorted_rows(got, key)
                    got, n = [], 0
        if got:
            yield from _sorted_rows(got, key)

    return run


def _documents_of(key: str):
    def run(batches):
        for b in batches:
            for packed in b.column(0):
                for part in pa.ipc.open_stream(packed.as_buffer()).read_all().to_batches():
                    yield pa.RecordBatch.from_arrays(part.columns, names=[key, "dl"])

    return run


@contextmanager
def _open_files(spark: SparkSession, n: int):
    """A task may write n folders at once, so that its rows aren't sorted by folder first."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    was = spark.conf.get(name)
    spark.conf.set(name, n)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """term and freq (occurrences)."""
    return docs.select(F.explode(tokens(text)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def _followed(at: Column, places: Column, slop: int) -> Column:
    return F.transform(at, lambda s: F.struct(s.a.alias("a"), F.array_min(F.filter(places, lambda x: (x > s.b) & (x <= s.b + 1 + slop))).alias("b")))


def _spots(places: str, term: str) -> Column:
    return F.transform(places, lambda p: F.struct(p.alias("p"), F.lit(term).alias("t")))


def _matches(positions: list[Column], slop: int) -> Column:
    """Starts from which each next word follows within 1 + slop places, the nearest such place each time."""
    at = F.transform(positions[0], lambda x: F.struct(x.alias("a"), x.alias("b")))
    for p in positions[1:]:
        at = F.filter(_followed(at, p, slop), lambda s: s.b.isNotNull())
    return F.coalesce(F.size(at), F.lit(0)).cast("long")


def _window(hits: Column, terms: list[str]) -> Column:
    """The smallest last place less first that holds all terms, of an array of (p, t) sorted by place."""
    start = F.struct(F.array_repeat(F.lit(-(1 << 29)), len(terms)).alias("last"), F.lit(1 << 30).alias("best"))

    def step(acc, s):
        last = F.array(*(F.when(s.t == t, s.p).otherwise(F.element_at(acc.last, i + 1)) for i, t in enumerate(terms)))
        return F.struct(last.alias("last"), F.least(acc.best, F.array_max(last) - F.array_min(last)).alias("best"))

    return F.aggregate(hits, start, step).getField("best").cast("long")


class TextIndex:
    """An inverted index over documents.  Changes add segments or tombstones; compact() writes all anew.

    Null texts are documents of no tokens.  A key that is added again stands beside its old rows: remove it first.
    Searches return key and score, highest first, ties by key; limit None returns all.
    """

    def __init__(self, spark: SparkSession, key: str = "doc_id", buckets: int = BUCKETS):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.segments: list[str] = []
        self.dead: str | None = None
        self.n_dead = 0
        self.n, self.total = 0, 0
        self.kind = "long"

    def _schema(self, part: str) -> str:
        return {
            "postings": f"term string, `{self.key}` {self.kind}, tf long, positions array<int>, dl int, bucket long",
            "documents": f"`{self.key}` {self.kind}, dl int",
            "terms": "term string, freq long, df long",
        }[part]

    @classmethod
    def build(cls, docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> "TextIndex":
        out = cls(docs.sparkSession, key, buckets)
        out.add(docs, text)
        return out

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """Write a segment."""
        path = scratch(self.spark, "text-index")
        self.kind = docs.schema[self.key].dataType.simpleString()
        runs = docs.select(self.key, words(text).alias("_t")).mapInArrow(_text_runs(self.buckets), "bucket int, sub int, run binary")
        runs = materialize(runs, "runs", 16 << 20)
        runs.filter("bucket < 0").select("run").mapInArrow(_documents_of(self.key), self._schema("documents")).write.parquet(f"{path}/documents")
        twice = self.spark.read.schema(self._schema("documents")).parquet(f"{path}/documents").groupBy(self.key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col(self.key).alias("_k"))
        self._write(runs.filter("bucket >= 0"), path, twice if twice.take(1) else None)
        discard(runs)
        self._terms(path)
        self.segments.append(path)
        self._count()

    def _write(self, runs: DataFrame, path: str, twice: DataFrame | None = None) -> None:
        """Postings from packed runs.  A bucket's runs go to several tasks, which sort some runs at a time.  twice: keys of several rows, whose postings of a term are one."""
        rows = runs.repartition("bucket", "sub").select("bucket", "run").mapInArrow(_written_rows(self.key), self._schema("postings"))
        if twice is not None:
            same = rows[self.key].eqNullSafe(twice["_k"])
            merged = rows.join(twice, same, "left_semi").groupBy("term", self.key).agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"), F.first("dl").alias("dl"), F.first("bucket").alias("bucket"))
            rows = rows.join(twice, same, "left_anti").unionByName(merged).sortWithinPartitions("bucket", "term")
        with _open_files(self.spark, self.buckets):
            rows.write.partitionBy("bucket").parquet(f"{path}/postings")

    def _terms(self, path: str) -> None:
        written = self.spark.read.schema(self._schema("postings")).parquet(f"{path}/postings")
        written.groupBy("term").agg(F.sum("tf").alias("freq"), F.count(F.lit(1)).alias("df")).write.parquet(f"{path}/terms")

    def _count(self) -> None:
        r = self.documents().agg(F.count(F.lit(1)), F.sum("dl")).first()
        self.n, self.total = r[0], r[1] or 0

    def _read(self, part: str, dead: bool = True) -> DataFrame:
        out = None
        for s in self.segments:
            d = self.spark.read.schema(self._schema(part)).parquet(f"{s}/{part}")
            out = d if out is None else out.unionByName(d)
        if out is None:
            raise ValueError("an index without a segment")
        if not (self.dead and dead):
            return out
        gone = self.spark.read.parquet(self.dead)
        return out.join(F.broadcast(gone) if self.n_dead <= DEAD_ROWS else gone, self.key, "left_anti")

    def documents(self) -> DataFrame:
        return self._read("documents")

    def postings(self) -> DataFrame:
        return self._read("postings").drop("bucket")

    def terms(self) -> DataFrame:
        """term and freq, of all segments; tombstones count until compact()."""
        return self._read("terms", dead=False).groupBy("term").agg(F.sum("freq").alias("freq"))

    def remove(self, keys: DataFrame) -> None:
        """Tombstones for the keys of a DataFrame with the key's column."""
        path = scratch(self.spark, "tombstones")
        own = keys.select(self.key).filter(F.col(self.key).isNotNull())
        (own.unionByName(self.spark.read.parquet(self.dead)) if self.dead else own).distinct().write.parquet(path)
        self.dead, self.n_dead = path, self.spark.read.parquet(path).count()
        self._count()

    def compact(self) -> None:
        """One segment without the removed documents."""
        path = scratch(self.spark, "text-index")
        self._write(self._read("postings").select("term", F.col(self.key).alias("key"), "tf", "positions", "dl", "bucket").mapInArrow(_row_runs, "bucket int, sub int, run binary"), path)
        self.documents().write.parquet(f"{path}/documents")
        self._terms(path)
        self.segments, self.dead = [path], None
        self._count()

    # Searches

    def hits(self, terms: list[str]) -> DataFrame:
        """The postings of some terms: their buckets are pruned by partition, their rows by statistics."""
        each = sorted(set(terms))
        d = self._read("postings")
        wanted = F.array(*(F.pmod(F.xxhash64(F.lit(t)), F.lit(self.buckets)) for t in each)) if each else F.array(F.lit(0))
        buckets = sorted(set(self.spark.range(1).select(wanted).first()[0])) if each else []
        return d.filter(F.col("bucket").isin(buckets) & F.col("term").isin(each)).drop("bucket")

    def _fitting(self, fits: Column) -> DataFrame:
        """The postings of the terms that fit a condition.  The terms are found in the vocabulary; a few are then looked up, of many all postings are read."""
        found = self._read("terms", dead=False).filter(fits).select("term").distinct().limit(NAMED_TERMS + 1).collect()
        return self.hits([r.term for r in found]) if len(found) <= NAMED_TERMS else self._read("postings").filter(fits).drop("bucket")

    def _weighed(self, hits: DataFrame, terms: list[str] | None = None, kind: str = "bm25") -> DataFrame:
        """hits with _w, the weight of each posting; a term given twice counts twice.  The document frequencies, a row for each term that was asked for, are broadcast."""
        df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
        j = hits.join(F.broadcast(df), "term")
        times = F.lit(1)
        for t in set(terms or []):
            if terms.count(t) > 1:
                times = F.when(F.col("term") == t, terms.count(t)).otherwise(times)
        if kind == "tfidf":
            return j.withColumn("_w", times * F.col("tf") * F.log(F.lit(self.n) / F.col("_df")))
        mean = self.total / self.n if self.total else 1.0
        idf = F.log((F.lit(self.n) - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1)
        return j.withColumn("_w", times * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean)))

    def _top(self, scored: DataFrame, limit: int | None) -> DataFrame:
        return scored.orderBy(F.desc("score"), self.key).limit(limit) if limit is not None else scored

    def bm25(self, query: str, limit: int | None = None) -> DataFrame:
        terms = query_terms(query)
        w = self._weighed(self.hits(terms), terms)
        return self._top(w.groupBy(self.key).agg(F.sum("_w").alias("score")), limit)

    def tfidf(self, query: str, limit: int | None = None) -> DataFrame:
        terms = query_terms(query)
        w = self._weighed(self.hits(terms), terms, "tfidf")
        return self._top(w.groupBy(self.key).agg(F.sum("_w").alias("score")), limit)

    def _all_terms(self, terms: list[str]) -> tuple[DataFrame, list[str]]:
        """key, _s (the sum of weights) and, by term, _p0 and on (positions) of the documents that hold every term."""
        each = sorted(set(terms))
        w = self._weighed(self.hits(terms), terms)
        d = w.groupBy(self.key).agg(F.sum("_w").alias("_s"), F.count(F.lit(1)).alias("_n"), *(F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"_p{i}") for i, t in enumerate(each)))
        return d.filter(F.col("_n") == len(each)), each

    def phrase(self, words: str, slop: int = 0, limit: int | None = None) -> DataFrame:
        """Documents where the words follow one another within 1 + slop places: twice their BM25, and n_matches."""
        terms = query_terms(words)
        d, each = self._all_terms(terms)
        n = _matches([F.col(f"_p{each.index(t)}") for t in terms], slop) if terms else F.lit(0)
        return self._top(d.select(self.key, (2 * F.col("_s")).alias("score"), n.alias("n_matches")).filter("n_matches > 0"), limit)

    def proximity(self, words: str, most: int, limit: int | None = None) -> DataFrame:
        """Documents whose smallest span of all words is at most `most`: BM25 times most over the span, and the span."""
        terms = query_terms(words)
        d, each = self._all_terms(terms)
        spots = F.array_sort(F.flatten(F.array(*(_spots(f"_p{i}", t) for i, t in enumerate(each)))))
        d = d.select(self.key, "_s", _window(spots, each).alias("span")).filter(F.col("span") <= most)
        return self._top(d.select(self.key, (F.col("_s") * most / F.greatest("span", F.lit(1))).alias("score"), "span"), limit)

    def _by_term(self, weight: Column, limit: int | None) -> DataFrame:
        """Sums of weight * tf; weight is null where a term doesn't fit."""
        d = self._fitting(weight.isNotNull()).select(self.key, "tf", weight.alias("_w"))
        return self._top(d.groupBy(self.key).agg(F.sum(F.col("_w") * F.col("tf")).alias("score")), limit)

    def fuzzy(self, query: str, distance: int = 2, limit: int | None = None) -> DataFrame:
        """(1 - distance / longer length) * tf, over terms within the distance of a query word."""
        weight = F.lit(None).cast("double")
        for w in query_terms(query):
            d = F.levenshtein("term", F.lit(w), distance)
            s = F.when(d >= 0, 1 - d / F.greatest(F.length("term"), F.lit(len(w))))
            weight = F.coalesce(weight + s, weight, s)
        return self._by_term(weight, limit)

    def wildcard(self, pattern: str, limit: int | None = None) -> DataFrame:
        """The occurrences of terms that fit *inner*, *end, start* or a whole term."""
        t, p = F.col("term"), pattern
        if p.startswith("*") and p.endswith("*") and len(p) > 1:
            fits = t.contains(p[1:-1])
        else:
            fits = t.endswith(p[1:]) if p.startswith("*") else t.startswith(p[:-1]) if p.endswith("*") else t == p
        return self._by_term(F.when(fits, 1.0), limit)

    def ngram_fuzzy(self, word: str, distance: int = 2, limit: int | None = None) -> DataFrame:
        """Candidate terms' scores times their occurrences.  A few candidates are looked up; of many all postings are read and joined."""
        found = materialize(ngram_candidates(self.terms(), word, distance).select("term", "score"), "candidates")
        few = found.limit(NAMED_TERMS + 1).collect()
        own = self.hits([r.term for r in few]).join(F.broadcast(found), "term") if len(few) <= NAMED_TERMS else self._read("postings").join(found, "term")
        d = own.groupBy(self.key).agg(F.sum(F.col("score") * F.col("tf")).alias("score"))
        return self._top(d, limit)

    def boolean(self, query: str, limit: int | None = None, fields: DataFrame | None = None) -> DataFrame:
        """Documents that fit the query; the score is the BM25 of its terms, 0 where a document holds none.  fields: key and columns for field:value and ranges."""
        parsed = BooleanQuery(query)
        w = self._weighed(self._fitting(parsed.any_term()))
        flags = w.groupBy(self.key).agg(F.sum("_w").alias("score"), *parsed.flags())
        every = self.documents().select(self.key)
        if fields is not None:
            every = every.join(fields, self.key, "left")
        out = every.join(flags, self.key, "left").filter(parsed.test()).select(self.key, F.coalesce("score", F.lit(0.0)).alias("score"))
        return self._top(out, limit)


def fuzzy_terms(vocab: DataFrame, word: str, distance: int = 2) -> DataFrame:
    d = F.levenshtein("term", F.lit(word), distance)
    return vocab.select("term", "freq", d.cast("long").alias("distance")).filter((F.col("distance") >= 0) & (F.abs(F.length("term") - len(word)) <= distance))


def wildcard(vocab: DataFrame, pattern: str) -> DataFrame:
    """Terms that fit a pattern of * and ?."""
    return vocab.filter(F.col("term").rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"))


def ngrams(term: Column, n: int = 3) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(term) - n + 1, F.lit(1))), lambda i: F.substring(term, i, F.lit(n))))


def ngram_candidates(vocab: DataFrame, word: str, distance: int = 2, least: float = 0.1, n: int = 3) -> DataFrame:
    """Terms that share n-grams with the word (Jaccard of at least `least`) and lie within the distance; score is (1 - distance / longer length) * ln(freq + 1)."""
    asked = [word[i : i + n] for i in range(max(1, len(word) - n + 1))]
    own = ngrams(F.col("term"), n)
    common = sum((F.array_contains(own, g).cast("int") for g in asked), F.lit(0))
    jaccard = common / (len(asked) + F.greatest(F.length("term") - n + 1, F.lit(1)) - common)
    d = F.levenshtein("term", F.lit(word), distance)
    out = vocab.filter((F.abs(F.length("term") - len(word)) <= distance) & (common > 0)).select("term", "freq", jaccard.alias("similarity"), d.cast("long").alias("distance"))
    out = out.filter((F.col("similarity") >= least) & (F.col("distance") >= 0))
    return out.withColumn("score", (1 - F.col("distance") / F.greatest(F.length("term"), F.lit(len(word)))) * F.log(F.col("freq") + 1))


def facet_counts(df: DataFrame, fields: list[str], candidates: DataFrame | None = None, key: str = "doc_id", limit: int | None = None) -> DataFrame:
    """field, value and n of each value of each field, in one pass; of candidate keys alone, if given; the limit most frequent values of each field."""
    d = df if candidates is None else df.join(candidates.select(key), key, "left_semi")
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("p")
    out = d.select(pairs).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))
    if limit is None:
        return out
    w = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def facet_filter(df: DataFrame, include: dict[str, list], exclude: dict[str, list] | None = None) -> DataFrame:
    """All fields must fit, any value of a field does."""
    for f, values in include.items():
        df = df.filter(F.col(f).isin(values))
    for f, values in (exclude or {}).items():
        df = df.filter(~F.coalesce(F.col(f).isin(values), F.lit(False)))
    return df


def rank_fusion(lists: list[DataFrame], key: str, weights: list[float] | None = None, k: int = 60, limit: int | None = None) -> DataFrame:
    """key and score: the sum over ranked lists (key, rank from 1) of weight / (k + rank); the limit best."""
    parts = [d.select(F.col(key), (F.lit(w) / (k + F.col("rank"))).alias("s")) for d, w in zip(lists, weights or [1.0] * len(lists))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.groupBy(key).agg(F.sum("s").alias("score"))
    return out.orderBy(F.desc("score"), key).limit(limit) if limit is not None else out


def ranked(top: DataFrame, order: list, k: int) -> DataFrame:
    """The k first rows with their rank; the numbering sees k rows alone."""
    return top.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rerank(hits: DataFrame, query: str, text: str = "text", score: str = "score") -> DataFrame:
    """Adds 0.01 for each query word of over two letters that the text holds."""
    words = [w for w in query.lower().split() if len(w) > 2]
    return hits.withColumn(score, F.col(score) + sum((F.contains(F.lower(text), F.lit(w)).cast("int") * 0.01 for w in words), F.lit(0.0)))


# Boolean queries: AND OR NOT + - "phrase" field:term term~n pre* field:[a TO b] ( )

_TOKEN = re.compile(r'\s*(?:(\()|(\))|(AND|OR|NOT)\b|([+-])(?=\S)|(?:(\w+):)?(?:\[(\S+) TO (\S+)\]|"([^"]*)"|([^\s()"~*]+)(?:~(\d*)|(\*))?))')


class BooleanQuery:
    """A parsed query: which postings it reads, what to gather of each document, and the test of a document.  Neighbours without an operator must both hold."""

    def __init__(self, query: str):
        self.found, at = [], 0
        while at < len(query.rstrip()):
            m = _TOKEN.match(query, at)
            if not m or m.end() == at:
                raise ValueError(f"unreadable at {at}: {query}")
            self.found.append(m.groups())
            at = m.end()
        #: (name, condition on a term) of each leaf, and the terms whose positions phrases need.
        self.leaves: list[tuple[str, Column]] = []
        self.placed: list[str] = []
        self.at = 0
        self.tree = self._either() if self.found else None
        if self.at < len(self.found):
            raise ValueError(f"unbalanced: {query}")

    def _flag(self, cond: Column) -> Column:
        name = f"_f{len(self.leaves)}"
        self.leaves.append((name, cond))
        return F.coalesce(F.col(name), F.lit(False))

    def _leaf(self, field, low, high, quoted, term, fuzz, star) -> Column:
        if low is not None:
            return F.col(field).between(low, high)
        if quoted is not None:
            terms = query_terms(quoted)
            self.placed += [t for t in terms if t not in self.placed]
            return F.coalesce(_matches([F.col(f"_p{self.placed.index(t)}") for t in terms], 0) > 0, F.lit(False)) if terms else F.lit(True)
        if field:
            return F.col(field).cast("string") == term
        t = term.lower()
        if fuzz is not None:
            return self._flag(F.levenshtein("term", F.lit(t), int(fuzz or 2)) >= 0)
        return self._flag(F.col("term").startswith(t) if star else F.col("term") == t)

    def _either(self) -> Column:
        out = self._both()
        while self.at < len(self.found) and self.found[self.at][2] == "OR":
            self.at += 1
            out = out | self._both()
        return out

    def _both(self) -> Column:
        out = self._one()
        while self.at < len(self.found) and self.found[self.at][1] is None and self.found[self.at][2] != "OR":
            self.at += self.found[self.at][2] == "AND"
            out = out & self._one()
        return out

    def _one(self) -> Column:
        if self.at >= len(self.found):
            raise ValueError("an operator without its operand")
        g = self.found[self.at]
        self.at += 1
        if g[2] == "NOT" or g[3] == "-":
            return ~F.coalesce(self._one(), F.lit(False))
        if g[3] == "+":
            return self._one()
        if g[0]:
            out = self._either()
            self.at += 1
            return out
        return self._leaf(*g[4:])

    def any_term(self) -> Column:
        out = F.col("term").isin(self.placed) if self.placed else F.lit(False)
        for _, cond in self.leaves:
            out = out | cond
        return out

    def flags(self) -> list[Column]:
        return [*(F.bool_or(c).alias(n) for n, c in self.leaves), *(F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"_p{i}") for i, t in enumerate(self.placed))]

    def test(self) -> Column:
        return F.coalesce(self.tree, F.lit(False)) if self.tree is not None else F.lit(False)
