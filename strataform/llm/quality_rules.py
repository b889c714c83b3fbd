"""Quality rules: rules on one document, and the frequency of its lines across the documents of its host.

All of it is DataFrame functions.  A line is normalised (A-Z lower-cased, digits to 0, white space
runs to one space, ends trimmed) and hashed together with its host.  Lines that more than
``max_line_docs`` distinct documents of one host hold are removed; a document whose rest is depleted
(under ``min_left_words`` words, or under ``min_left_share`` of its words) is rejected.

Cases: null or wordless text counts as no words and fails the base rules.  Rows without a doc_id add no
document to a line's count.  Repeated rows count as one document, and each keeps its own result row.
A null host is a host of its own.  Extra columns of any name are ignored.  An empty table gives no rows.

The counts of windows and lines rest on 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_small, materialize

SPACE = "[ \\t-\\r]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 8


def _shifted(a: Column, by: int) -> Column:
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))


def _pairs(a: Column, by: int) -> Column:
    """Hash of each element with the one `by` places on; the last `by` results mean nothing."""
    return F.zip_with(a, _shifted(a, by), lambda x, y: F.xxhash64(x, y))


def base_features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row.

    Windows are hashed by doubling (1, 2, 4, 8 words), each step a project of its own, so that no
    array is computed again for each use; only texts with a repeated window sort their windows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(BLANKS))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    d = docs.select(
        *keep,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)).alias("_w"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    rest = ["word_chars", "n_symbols"]
    d = d.select(*keep, *rest, F.size("_w").cast("long").alias("n_words"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    rest += ["n_words", "n_dup_lines"]
    for by in (1, 2, 4):
        d = d.select(*keep, *rest, _pairs(F.col("_h"), by).alias("_h"))
    d = d.select(*keep, *rest, F.slice("_h", F.lit(1), F.greatest(F.col("n_words").cast("int") - (WINDOW - 1), F.lit(0))).alias("_h"))
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    d = d.select(*keep, *rest, F.when(repeats, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))).alias("_s"))
    twins = F.zip_with("_s", _shifted(F.col("_s"), 1), lambda x, y: F.when(x.h == y.h, F.array(x.p, y.p)))
    d = d.select(*keep, *rest, F.array_sort(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull())))).alias("_p"))
    covered = F.zip_with("_p", _shifted(F.col("_p"), 1), lambda x, y: F.least(F.lit(WINDOW), F.coalesce(y - x, F.lit(WINDOW))).cast("long"))
    return d.select(*keep, *rest, F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"))


def document_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """A row for each line with a word: _doc, _body (hash of text and host), _pos, _line (hash of host and line), _nw words."""
    d = docs.select(F.col(doc_id).alias("_doc"), F.xxhash64(text, host).alias("_body"), F.col(host).alias("_host"), F.posexplode(F.split(F.col(text), "\n")).alias("_pos", "_raw"))
    low = F.translate(F.col("_raw"), UPPER + "0123456789", LOWER + "0" * 10)
    d = d.select("_doc", "_body", "_pos", "_host", F.btrim(F.regexp_replace(low, SPACE, " "), F.lit(BLANKS)).alias("_norm"))
    return d.filter("_norm <> ''").select("_doc", "_body", "_pos", F.xxhash64("_host", "_norm").alias("_line"), F.size(F.split("_norm", " ")).alias("_nw"))


def frequent_lines(lines: DataFrame, max_line_docs: int) -> DataFrame:
    """_line and _docs of lines that more than max_line_docs distinct documents hold."""
    return lines.groupBy("_line").agg(F.count_distinct("_doc").alias("_docs")).filter(F.col("_docs") > max_line_docs)


def quality_rules(docs: DataFrame, max_line_docs: int = 20, min_left_words: int = 20, min_left_share: float = 0.5, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, the base features, base_failed, kept, n_removed_lines and n_removed_words of each row of docs.

    Lines are shuffled as hashes alone.  Frequent lines are written and counted, and broadcast only
    if few enough; else the join is shuffled, where adaptive execution splits hot lines.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), F.col(host).alias("_src"))
    lines = materialize(document_lines(d, "doc_id", "_text", "_src"), "lines")  # hashes and places; the texts are cut into lines once
    frequent = checked_small(frequent_lines(lines, max_line_docs).select("_line"), "frequent-lines")
    removed = (
        lines.join(frequent, "_line", "left_semi")
        .dropDuplicates(["_doc", "_body", "_pos"])
        .groupBy("_doc", "_body")
        .agg(F.count(F.lit(1)).alias("n_removed_lines"), F.sum("_nw").alias("n_removed_words"))
    )
    base = base_features(d.withColumn("_own", F.xxhash64("_text", "_src")), ["doc_id", "_own"], "_text")
    out = base.join(removed, base.doc_id.eqNullSafe(removed._doc) & (base._own == removed._body), "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    gone = F.coalesce("n_removed_words", F.lit(0))
    left = F.col("n_words") - gone
    depleted = (gone > 0) & ((left < min_left_words) | (left < min_left_share * F.col("n_words")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), F.coalesce("n_removed_lines", F.lit(0)).cast("long").alias("n_removed_lines"), gone.cast("long").alias("n_removed_words"))


def cleaned_texts(docs: DataFrame, max_line_docs: int = 20, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """docs with frequent lines cut from the text; other columns stay.  The positions to cut travel, not the texts of others."""
    lines = document_lines(docs, doc_id, text, host)
    frequent = checked_small(frequent_lines(lines, max_line_docs).select("_line"), "frequent-lines")
    cut = lines.join(frequent, "_line", "left_semi").groupBy("_doc", "_body").agg(F.collect_set("_pos").alias("_cut"))
    joined = docs.join(cut, F.col(doc_id).eqNullSafe(cut._doc) & (F.xxhash64(F.col(text), F.col(host)) == cut._body), "left")
    parts = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(F.coalesce("_cut", F.array().cast("array<int>")), s.i))
    return joined.select(*[(F.when(F.col("_cut").isNull(), F.col(text)).otherwise(F.array_join(F.transform(parts, lambda s: s.x), "\n")).alias(c) if c == text else docs[c]) for c in docs.columns])


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM docs),
windows AS (
  SELECT rid, i, array_to_string(words[i:i+7], ' ') AS win
  FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - 6, 1))) AS i FROM w WHERE len(words) >= 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM windows) WHERE c > 1),
cov AS (
  SELECT rid, CAST(sum(least(8, coalesce(nx - i, 8))) AS BIGINT) AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM dup) GROUP BY rid),
lines AS (
  SELECT rid, doc_id, source, trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM (SELECT rid, doc_id, source, unnest(ls) AS l FROM w)),
freq AS (SELECT source, norm FROM lines GROUP BY source, norm HAVING count(DISTINCT doc_id) > 20),
gone AS (
  SELECT rid, count(*) AS n_removed_lines, CAST(sum(len(string_split(norm, ' '))) AS BIGINT) AS n_removed_words
  FROM lines l WHERE EXISTS (SELECT 1 FROM freq f WHERE f.norm = l.norm AND f.source IS NOT DISTINCT FROM l.source) GROUP BY rid),
f AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(n_removed_words, 0) AS n_removed_words
  FROM w LEFT JOIN cov USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
    AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < 20 OR n_words - n_removed_words < 0.5 * n_words)) AS kept,
  n_removed_lines, n_removed_words
FROM f
"""
