"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in whole documents.

Words are the symbols, as numbers of a vocabulary of the benchmark's own words.  Patterns are the windows: ten consecutive words of an item, or all words of a
shorter one.  Patterns of one length form one searcher: a block is the last two words at a position (one,
for patterns of one word); the shift table says how far the window can move without missing a pattern; a
block with shift zero selects, by its hash, the bucket of patterns that end in it; direct comparison of
the words confirms an occurrence.  Tables are sorted arrays; a full block takes some tens of MB in a worker.

The benchmark is read in blocks of a bounded number of bytes; each block is one pass over the documents, written before
the next one starts where there are several, and hits add up, so a benchmark of any size is searched whole.

Cases: null text or text without words has no words and no hits; so has a null item.  Items with equal
windows all count.  Repeated rows keep a row each.  A null item_id counts as the text ``null``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, extended, fresh, lean, materialize, slices, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
WINDOW = 10
#: Bytes of benchmark text in one block of patterns, which is what is broadcast at a time.
BLOCK_BYTES = 16 << 20


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(_LOWER) if text else "")


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct row, and which of these each row is: by hashes, if no two rows share one by chance."""
    h = np.zeros(len(rows), dtype=np.uint64)
    for c in rows.T:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    _, kept, same = np.unique(h, return_index=True, return_inverse=True)
    if not (rows[kept[same]] == rows).all():
        _, kept, same = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return kept, same


class WuManber:
    """Patterns of m words: all windows of m words of some texts.  texts: (item, word numbers)."""

    def __init__(self, m: int, texts: list[tuple[int, np.ndarray]], size: int):
        self.m, self.block, self.size = m, min(2, m), size
        self.flat = np.concatenate([t for _, t in texts])
        lens = np.array([len(t) for _, t in texts], dtype=np.int64)
        base = np.cumsum(lens) - lens
        place = np.arange(len(self.flat)) - np.repeat(base, lens)
        left = np.repeat(lens, lens) - place  # words from here to the end of the text
        # a block at place p ends a window if p >= m - block; else a window that holds it ends m - block - p words on
        at = np.flatnonzero(left >= self.block)
        codes, shifts = self._codes(self.flat)[at], np.maximum(0, m - self.block - place[at])
        order = np.lexsort((shifts, codes))
        codes, shifts = codes[order], shifts[order]
        first = np.concatenate(([True], codes[1:] != codes[:-1]))
        self.codes, self.shifts = codes[first], shifts[first].astype(np.int32)
        # distinct windows, and the items of each
        starts = np.flatnonzero(left >= m)
        rows = self.flat[starts[:, None] + np.arange(m)]
        kept, same = _distinct(rows)
        owner = np.repeat(np.array([i for i, _ in texts], dtype=np.int64), lens)[starts]
        pairs = np.unique(np.stack([same.ravel(), owner], axis=1), axis=0)
        self.owners, self.cut = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(kept) + 1))
        suffix = self._codes(self.flat)[starts[kept] + m - self.block]
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.window, self.begin = suffix[order], order, starts[kept][order]

    def _codes(self, words: np.ndarray) -> np.ndarray:
        """A number for the block at each place (the last place of a longer block has none that counts); -1 with a word that no item has."""
        if self.block == 1:
            return words.astype(np.int64)
        w = words.astype(np.int64)
        nxt = np.append(w[1:], -1)
        return np.where((w < 0) | (nxt < 0), -1, w * self.size + nxt)

    def search(self, words: np.ndarray):
        """The start and window of each occurrence."""
        m, b, n = self.m, self.block, len(words)
        if n < m:
            return
        if not (words >= 0).any():
            return
        codes = self._codes(words)
        spot = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        moves = np.where(self.codes[spot] == codes, self.shifts[spot], m - b + 1).tolist()
        at = m - b  # the place of the window's last block
        while at <= n - b:
            move = moves[at]
            if move:
                at += move
                continue
            low, high = np.searchsorted(self.suffix, codes[at]), np.searchsorted(self.suffix, codes[at], side="right")
            start = at + b - m
            if high > low:
                same = (self.flat[self.begin[low:high, None] + np.arange(m)] == words[start : start + m]).all(axis=1)
                for k in np.flatnonzero(same):
                    yield start, int(self.window[low + k])
            at += 1


class Searcher:
    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.names, self.vocabulary = [i for i, _ in items], {}
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            if words:
                numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], dtype=np.int32)
                by_length.setdefault(min(window, len(words)), []).append((k, numbers))
        self.searchers = [WuManber(m, t, len(self.vocabulary)) for m, t in sorted(by_length.items())]

    def search(self, words: list[str]) -> tuple[set[int], set[str]]:
        """Positions of hit words, and items with an occurring window."""
        hit, items = set(), set()
        get = self.vocabulary.get
        numbers = np.fromiter((get(w, -1) for w in words), dtype=np.int32, count=len(words))
        for s in self.searchers:
            for at, k in s.search(numbers):
                hit.update(range(at, at + s.m))
                items.update(self.names[i] for i in s.owners[s.cut[k] : s.cut[k + 1]])
        return hit, items


def blocks(benchmark: DataFrame, item_id: str, text: str, most: int = BLOCK_BYTES):
    """Lists of items of bounded bytes; an item larger than the bound is a block of its own."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(text).alias("t"))
    block, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r.t or "") * 4 + 16
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += n
    yield block


def _runs(hit: set[int]) -> list[dict]:
    out: list[dict] = []
    for i in sorted(hit):
        if out and out[-1]["end"] == i:
            out[-1]["end"] = i + 1
        else:
            out.append({"begin": i, "end": i + 1})
    return out


def find_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, spans (begin and end, in words, of what is hit) and items (sorted strings).

    Names already taken get underscores.  No shuffle: blocks of patterns go to the documents.
    """
    names = [fresh(docs, c) for c in ("n_words", "spans", "items")]
    cols = docs.columns
    place = cols.index(text)
    span_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    schema = extended(docs, f"{names[0]} long, {names[1]} array<struct<begin:int,end:int>>, {names[2]} array<string>")
    sc = docs.sparkSession.sparkContext
    out = written = None
    for block in blocks(benchmark, item_id, item_text, block_bytes):
        shared = sc.broadcast(Searcher(block, window))  # a few times block_bytes at most
        first = out is None
        if not first:  # one pass at a time, so that one block's tables are in a worker at a time
            before = written
            out = written = materialize(out, "passages")
            if before is not None:
                discard(before)

        def run(batches, shared=shared, first=first):
            searcher = shared.value
            for b in slices(batches):
                texts = b.column(place).to_pylist()
                if not first:
                    spans, found = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
                n, new_spans, new_items = [], [], []
                for i, t in enumerate(texts):
                    words = words_of(t)
                    hit, got = searcher.search(words)
                    if not first:
                        hit.update(j for s in spans[i] for j in range(s["begin"], s["end"]))
                        got = got | set(found[i])
                    n.append(len(words))
                    new_spans.append(_runs(hit))
                    new_items.append(sorted(got))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], pa.array(n, pa.int64()), pa.array(new_spans, span_type), pa.array(new_items, pa.list_(pa.string()))], names=[*cols, *names])

        out = (docs if first else out).mapInArrow(lean(run), schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **kw) -> DataFrame:
    """docs without those that hold a passage of the benchmark; columns stay as they are."""
    found = find_passages(docs, benchmark, text, **kw)
    return found.filter(F.size(F.col(found.columns[-2])) == 0).select(*docs.columns)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.end - s.begin)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def brute_force(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[int, int, list[str]]:
    """n_words, n_hit and items by comparing every place with every window."""
    words, hit, got = words_of(text), set(), set()
    for item, t in items:
        w = words_of(t)
        m = min(window, len(w))
        for i in range(len(w) - m + 1) if m else ():
            for at in range(len(words) - m + 1):
                if words[at : at + m] == w[i : i + m]:
                    hit.update(range(at, at + m))
                    got.add(item)
    return len(words), len(hit), sorted(got)


_WORDS = r"list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark),
bl AS (SELECT item, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0),
pats AS (SELECT DISTINCT item, m, array_to_string(w[i:i+m-1], ' ') AS win FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM bl)),
ms AS (SELECT DISTINCT m FROM bl),
wins AS (SELECT rid, m, i, array_to_string(w[i:i+m-1], ' ') AS win FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
found AS (SELECT DISTINCT rid, m, i, item FROM wins JOIN pats USING (m, win)),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM found) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN its USING (rid)
"""
