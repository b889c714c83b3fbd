"""The pipeline's near-duplicates against all pairs, in plain Python."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from strataform.llm import neardup

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute_kept(rows):
    """Positions of the rows kept: of each component at Jaccard 0.8 over five-word shingles, that of the smallest doc_id."""
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or (both and 5 * both >= 4 * (len(a) + len(sets[j]) - both)):
                x, y = group[i], group[j]
                group = [y if g == x else g for g in group]
    return {min((k for k in range(len(rows)) if group[k] == g), key=lambda k: rows[k][0]) for g in set(group)}


def kept_ids(spark, rows):
    return sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOC), "").collect())


def test_near_duplicates_brute(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    want = sorted(rows[k][0] for k in brute_kept(rows))
    assert kept_ids(spark, rows) == want and len(want) < len(rows)


def test_chains_stars_and_tiles(spark, monkeypatch):
    """Families about the threshold: copies with several words changed, chains of such, in tiles of few nodes."""
    monkeypatch.setattr(neardup, "BLOCK", 6)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for _ in range(4):
        base = [word() for _ in range(150)]
        texts.append(base)
        for _ in range(25):
            own = list(rng.choice(texts[-3:]) if rng.random() < 0.5 else base)
            for k in rng.sample(range(len(own)), rng.randrange(1, 7)):
                own[k] = word()
            texts.append(own)
    texts += [["One"], ["one"], [], ["a", "b"]]
    rng.shuffle(texts)
    rows = [(i, " ".join(t), None, None, None) for i, t in enumerate(texts)] + [(len(texts), None, None, None, None)]
    want = sorted(rows[k][0] for k in brute_kept(rows))
    assert kept_ids(spark, rows) == want and 4 < len(want) < len(rows)


def test_same_id_other_texts(spark):
    rows = [(1, "a b c d e f", None, None, None), (1, "u v w x y z", None, None, None), (2, "a b c d e f", None, None, None), (3, "u v w x y z", None, None, None), (None, "", None, None, None), (None, " ", None, None, None)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOC), "").collect()
    assert sorted((r.doc_id or 0, len(r.text.strip())) for r in got) == [(0, 0), (1, 11), (1, 11)]


def test_fingerprints_give_candidates(spark):
    """SimHash alone, without a band: what it links and Jaccard confirms is one group, and nothing else is."""
    words = [f"w{i}" for i in range(400)]
    texts = [words, words[:-1] + ["x"], words[::-1], ["a"], []]  # the first two differ in one shingle of 396
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    ids = neardup.with_node(docs, "text", "_node", ["doc_id"], "bands").withColumn("_bands", F.expr("CAST(array() AS array<bigint>)"))
    distinct = ids.groupBy("_node").agg(F.min("doc_id").alias("_least"), F.max("_size").alias("_size"))
    node = {r.doc_id: r._node for r in ids.collect()}
    found = {r.node: r.root for r in neardup.links(docs, ids, distinct, "doc_id", "text").collect()}
    assert set(found) == {node[0], node[1]} and len(set(found.values())) == 1
