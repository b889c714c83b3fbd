"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover the whole text.  Bytes are embedded, learned
filters slide over each chunk, and each filter's maximum in a chunk is kept.  A text's features are, for each
filter, the largest, the mean and the smallest of its chunk maxima; a logistic layer combines them into one
probability.  Embedding, filters and layer are trained together by Adam.  A step takes CHUNKS_A_DOC chunks of a longer
training text, drawn anew each time; scores read all chunks.

Scoring adds, for each place in a filter, one row of a table of 256 bytes, which is embedding times filter.

Cases: null and empty texts are one chunk of padding and get that score.  Without labels, or with labels of
one kind, every score is that kind's share (0.5 without any).  Repeated rows get equal scores.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import bounded_sample, extended, fresh, held_out, lean, materialize, slices, table

#: Labelled documents that the network is fitted on, at most about this many.
TRAIN_DOCS = 2500
CHUNK, STEP = 512, 448
FILTERS, WIDTH, EMBED = 16, 5, 8
STEPS, BATCH, CHUNKS_A_DOC = 1200, 32, 8
THRESHOLD = 0.7


def chunks_of(text: str | None) -> np.ndarray:
    """Rows of CHUNK bytes, zero-padded, each starting STEP after the one before."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    n = max(1, -(-(len(data) - (CHUNK - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, dtype=np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


def drawn(text: str | None, epochs: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray | None]:
    """The chunks of a text that so many epochs read, and which of these each epoch reads: CHUNKS_A_DOC drawn anew from all its chunks; None where it has no more, as each epoch reads them all."""
    c = chunks_of(text)
    if len(c) <= CHUNKS_A_DOC:
        return np.ascontiguousarray(c), None
    rng = np.random.default_rng([seed, zlib.crc32(c[0].tobytes()), len(c)])
    told, places = np.unique(np.stack([rng.choice(len(c), CHUNKS_A_DOC, replace=False) for _ in range(epochs)]), return_inverse=True)
    return c[told], places.reshape(epochs, CHUNKS_A_DOC)


def epochs_of(n: int, steps: int = STEPS) -> int:
    return -(-steps // -(-n // BATCH)) if n else 0


class ByteNetwork:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filters": rng.normal(0, 1 / np.sqrt(EMBED * WIDTH), (WIDTH, EMBED, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, dtype=np.float32),
            "layer": np.zeros(3 * FILTERS, dtype=np.float32),
            "end": np.zeros(1, dtype=np.float32),
        }
        self.constant: float | None = None

    def tables(self) -> np.ndarray:
        return np.einsum("be,kef->kbf", self.p["embed"], self.p["filters"]).astype(np.float32)

    def maxima(self, x: np.ndarray, where: bool = False):
        """Each filter's maximum over each chunk (and its place)."""
        t, n = self.tables(), x.shape[1] - WIDTH + 1
        best = np.empty((len(x), FILTERS), dtype=np.float32)
        places = np.empty((len(x), FILTERS), dtype=np.int64) if where else None
        for i in range(0, len(x), 16):  # sixteen chunks of activations stay in the cache
            part = x[i : i + 16]
            z = np.take(t[0], part[:, :n], axis=0)
            for k in range(1, WIDTH):
                z += np.take(t[k], part[:, k : k + n], axis=0)
            if where:
                at = z.argmax(axis=1)
                places[i : i + 16] = at
                best[i : i + 16] = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0]
            else:
                best[i : i + 16] = z.max(axis=1)
        return (best, places) if where else best

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = np.empty(len(texts))
        pending: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, t in enumerate(texts):
            c = chunks_of(t)
            pending.append((i, c))
            size += len(c)
            if size > 2048 or i == len(texts) - 1:
                h = np.maximum(self.maxima(np.concatenate([c for _, c in pending])) + self.p["bias"], 0)
                at = np.cumsum([0] + [len(c) for _, c in pending])[:-1]
                n = np.diff(np.append(at, len(h)))[:, None]
                f = np.concatenate([np.maximum.reduceat(h, at), np.add.reduceat(h, at) / n, np.minimum.reduceat(h, at)], axis=1)
                out[[j for j, _ in pending]] = 1 / (1 + np.exp(-np.clip(f @ self.p["layer"] + self.p["end"][0], -30, 30)))
                pending, size = [], 0
        return out

    def fit(self, texts: list[str], labels: list[int], steps: int = STEPS, seed: int = 11) -> "ByteNetwork":
        return self.fit_drawn([drawn(t, epochs_of(len(texts), steps), seed) for t in texts], labels, steps, seed)

    def fit_drawn(self, docs: list[tuple], labels: list[int], steps: int = STEPS, seed: int = 11) -> "ByteNetwork":
        """docs: of each text, what drawn gives for epochs_of(len(docs), steps)."""
        y = np.array(labels, dtype=np.float32)
        if len(set(labels)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        rng = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = epoch = 0
        while step < steps:
            order = rng.permutation(len(docs))
            for i in range(0, len(docs), BATCH):
                rows = order[i : i + BATCH]
                part = [c if at is None else c[at[epoch]] for c, at in (docs[j] for j in rows)]
                step += 1
                self._step(part, y[rows], moments, step, 0.01 * (1 - 0.9 * step / steps))
            epoch += 1
        return self

    def _step(self, part: list[np.ndarray], y: np.ndarray, moments: dict, step: int, rate: float) -> None:
        p, x = self.p, np.concatenate(part)
        best, places = self.maxima(x, where=True)
        h = np.maximum(best + p["bias"], 0)
        at = np.cumsum([0] + [len(c) for c in part])
        top = np.stack([h[a:b].max(axis=0) for a, b in zip(at, at[1:])])
        low = np.stack([h[a:b].min(axis=0) for a, b in zip(at, at[1:])])
        mean = np.stack([h[a:b].mean(axis=0) for a, b in zip(at, at[1:])])
        f = np.concatenate([top, mean, low], axis=1)
        q = 1 / (1 + np.exp(-np.clip(f @ p["layer"] + p["end"][0], -30, 30)))
        e = ((q - y) / len(y)).astype(np.float32)
        g = {"layer": f.T @ e + 1e-4 * p["layer"], "end": np.array([e.sum()], dtype=np.float32)}
        df = e[:, None] * p["layer"]
        dh = np.zeros_like(h)
        lanes = np.arange(FILTERS)
        for d, (a, b) in enumerate(zip(at, at[1:])):
            dh[a + h[a:b].argmax(axis=0), lanes] += df[d, :FILTERS]
            dh[a:b] += df[d, FILTERS : 2 * FILTERS] / (b - a)
            dh[a + h[a:b].argmin(axis=0), lanes] += df[d, 2 * FILTERS :]
        dh[h <= 0] = 0
        g["bias"] = dh.sum(axis=0)
        g["filters"], g["embed"] = np.zeros_like(p["filters"]), np.zeros_like(p["embed"])
        for k in range(WIDTH):
            byte = np.take_along_axis(x, places + k, axis=1)  # chunk, filter
            g["filters"][k] = np.einsum("cfe,cf->ef", p["embed"][byte], dh)
            np.add.at(g["embed"], byte.ravel(), (dh[:, :, None] * p["filters"][k].T[None]).reshape(-1, EMBED))
        for k, v in p.items():
            m, s = moments[k]
            m += 0.1 * (g[k] - m)
            s += 0.001 * (g[k] ** 2 - s)
            v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", limit: int = TRAIN_DOCS) -> ByteNetwork:
    """Fit on about limit labelled documents outside the held-out fold, those with the lowest hash of doc_id.

    Labels that contradict one another or are null are left out.
    """
    told = labels.filter(~held_out(doc_id) & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("i")).agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("z")).filter("y = z").select("i", "y")
    told = bounded_sample(told, ["i"], limit)
    d = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
    few = d.join(F.broadcast(told), "i").select("t", "i", "y", F.xxhash64("t").alias("h"))
    epochs = epochs_of(few.select("i", "h").distinct().limit(2 * limit).count())

    def run(batches):
        for b in slices(batches, 50):
            got = [drawn(t, epochs) for t in b.column(0).to_pylist()]
            chunks, places = [c.tobytes() for c, _ in got], [None if at is None else at.astype("<i8").tobytes() for _, at in got]
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.binary()), pa.array(places, pa.binary()), *b.columns[1:]], names=["chunks", "places", "i", "y", "h"])

    # the texts stay where they are: what is read of them comes back, some rows at a time
    schema = StructType([StructField("chunks", BinaryType()), StructField("places", BinaryType()), *few.schema.fields[1:]])
    rows = materialize(few.mapInArrow(run, schema).dropDuplicates(["i", "h"]).limit(2 * limit), "drawn")
    got = sorted(((r.i, r.h or 0, r.y, np.frombuffer(r.chunks, dtype=np.uint8).reshape(-1, CHUNK), None if r.places is None else np.frombuffer(r.places, dtype="<i8").reshape(-1, CHUNKS_A_DOC)) for r in rows.toLocalIterator()), key=lambda r: r[:2])
    return ByteNetwork().fit_drawn([r[3:] for r in got], [r[2] for r in got])


def score_quality(docs: DataFrame, network: ByteNetwork, text: str = "text") -> DataFrame:
    """docs with quality_score.  No shuffle."""
    name, cols, place = fresh(docs, "quality_score"), docs.columns, docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(b.column(place).to_pylist()), pa.float64())], names=[*cols, name])

    return docs.mapInArrow(lean(run), extended(docs, f"{name} double"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
