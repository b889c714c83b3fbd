"""Helpers shared by the operators: shared folder, written tables, checked broadcasts, samples."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.tables import discard, materialize, scratch  # noqa: F401 (the operators take them from here)

#: A broadcast side holds at most this many rows, and takes at most so many bytes as written; larger sides are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forget(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any more, now rather than at the driver's next full collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def file_system(uri: str):
    """pyarrow's file system of a path in the shared folder, and the path there."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def checked_small(df: DataFrame, label: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Write df; mark it for broadcast only if its counted rows are at most limit, and its files at most BROADCAST_BYTES.

    Beyond the limits joins with it are shuffled, and adaptive execution splits hot keys.
    """
    kept = materialize(df, label)
    return F.broadcast(kept) if kept.count() <= limit and written_bytes(kept) <= BROADCAST_BYTES else kept


def written_bytes(df: DataFrame) -> int:
    """Bytes of the files of a DataFrame that materialize returned."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._written)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of doc_id as text leaves 2 modulo 4; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Texts of more characters than this aren't in the sample of op4 (they are scored whole like all others).
SAMPLE_CHARS = 1_000_000


def sampled(df: DataFrame, keys: list[str], limit: int, text: str | None = None) -> DataFrame:
    """About limit rows, those with the lowest hashes of the keys.  Equal rows come all or not at all, and longer texts than SAMPLE_CHARS not, where text is named."""
    if text:
        df = df.filter(F.length(text) <= SAMPLE_CHARS)
    total = df.count()
    if total > limit:
        share = int(limit / total * (1 << 30))
        df = df.filter(F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(1 << 30)) < share)
    return df


def bounded_sample(df: DataFrame, keys: list[str], limit: int, text: str | None = None) -> DataFrame:
    """What sampled gives, twice limit at most: equal rows count once.  Only what is kept is shuffled."""
    return sampled(df, keys, limit, text).dropDuplicates(keys).limit(2 * limit)


def extended(df: DataFrame, ddl: str) -> StructType:
    """The schema of df with the columns of ddl behind."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def slices(batches, rows: int = 500):
    """The batches in parts of a few hundred rows, so that only a part's texts are Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def give_back() -> None:
    """Return to the system what this process has freed: Arrow's pool and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run):
    """run, a function of mapInArrow, that gives back memory at a task's end: workers are used again, and what one stage left would stand beside the next one's."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores where a column (in any case) already has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
