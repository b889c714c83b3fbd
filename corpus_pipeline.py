"""A corpus pipeline: quality, language, near-duplicates, benchmark passages, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and reread as the next one's docs.  All but the last return the columns of documents.

Each stage takes nulls in any column, empty and long texts, repeated rows and empty tables; a rejected
document goes whole, and what is kept is unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.llm import bytecnn, decontam, langid, neardup, packing
from strataform.llm.common import materialize, table

#: Languages are rejected under this share of a document's words.
MIN_LANGUAGE_SHARE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the byte network, trained on the labelled documents outside the fold, scores at the threshold or more."""
    network = bytecnn.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = bytecnn.score_quality(docs, network)
    return scored.filter(F.col(scored.columns[-1]) >= bytecnn.THRESHOLD).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a learned language that holds at least half of their words."""
    out = langid.label_languages(docs, langid.train(table(spark, sf_dir, "documents")), spans=False)
    lang, score = out.columns[-3], out.columns[-2]
    return out.filter((F.col(lang) != "und") & (F.col(score) >= MIN_LANGUAGE_SHARE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near-duplicates: five-word shingles, Jaccard 0.8 or more, of candidates by SimHash balls and by MinHash bands."""
    return neardup.jaccard_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without a passage of the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packed)]

#: The models are trained here; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
