"""Sources and sinks: Parquet tables as views, and CSV, JSON and NDJSON files."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    for n in names:
        load(spark, sf_dir, n).createOrReplaceTempView(n)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; removed at the end.  Where the session names none, a folder of our own: with a local master alone, since other machines don't see it."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strataform-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/strataform/{label}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended first
            pass

    atexit.register(remove)
    return path


def materialize(df: DataFrame, label: str = "state", block_bytes: int | None = None) -> DataFrame:
    """Written to the shared folder and read back: cuts lineage for loops, and survives lost executors.

    block_bytes: size of Parquet row groups, for rows of megabytes.
    """
    path = scratch(df.sparkSession, label)
    (df.write.option("parquet.block.size", block_bytes) if block_bytes else df.write).parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._written = path
    return kept


def discard(df: DataFrame) -> None:
    """Remove the files of a DataFrame that materialize returned and that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(df._written)
    target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def import_file(spark: SparkSession, path: str, format: str = "csv", schema=None, header: bool = True, delimiter: str = ",", null_value: str | None = None, date_format: str | None = None, max_rows: int | None = None) -> DataFrame:
    """max_rows rows at most (any, as files have no order across tasks).  csv, json (an array or objects over several lines), ndjson or jsonl, parquet, orc.  Headerless CSV columns are column_1 and on."""
    if max_rows is not None:
        return import_file(spark, path, format, schema, header, delimiter, null_value, date_format).limit(max_rows)
    r = spark.read.schema(schema) if schema else spark.read
    r = r.option("dateFormat", date_format) if date_format else r
    if format == "csv":
        r = r.option("header", header).option("sep", delimiter).option("escape", '"').option("multiLine", True)
        d = (r.option("nullValue", null_value) if null_value is not None else r).csv(path)
        return d if header or schema else d.toDF(*(f"column_{i + 1}" for i in range(len(d.columns))))
    if format in ("ndjson", "jsonl"):
        return r.json(path)
    if format == "json":
        return r.option("multiLine", True).json(path)
    return r.format(format).load(path)


def _arrays(batches):
    """The lines of one JSON array from the JSON texts of a task's rows."""
    import pyarrow as pa

    first = True
    for b in batches:
        rows = b.column(0).to_pylist()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([("[" if first and not i else ",") + x for i, x in enumerate(rows)])], names=["value"])
            first = False
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], names=["value"])


def export_file(df: DataFrame, path: str, format: str = "csv", header: bool = True, delimiter: str = ",", mode: str = "overwrite", null_value: str | None = None, date_format: str | None = None) -> None:
    """Each task writes its own part (of json, an array of its own); nothing is gathered into one file."""
    w = df.write.mode(mode)
    if format == "csv":
        w = w.option("nullValue", null_value) if null_value is not None else w
        w = w.option("dateFormat", date_format) if date_format else w
        w.option("header", header).option("sep", delimiter).option("escape", '"').csv(path)
    elif format == "json":
        df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).mapInArrow(_arrays, "value string").write.mode(mode).text(path)
    elif format in ("ndjson", "jsonl"):
        w.json(path)
    else:
        w.format(format).save(path)
