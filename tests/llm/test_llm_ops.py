"""Each operator of strataform.llm against brute force, round trips or held-out accuracy, and on odd tables."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from strataform.llm import bytecnn, decontam, langid, licenses, lmscore, packing, quality_rules, simhash, tokens, urlfilter, warc
from strataform.llm.common import held_out, lean, scratch
from strataform.llm.queries import ORACLES, QUERIES

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (None, "a b c d e", None, None, None),
    (1, None, "en", "s", 3),
    (2, "", None, "s", 0),
    (3, " \t\n ", "fr", None, None),
    (4, "One two three. " * 3000, "en", "s", 1),
    (4, "One two three. " * 3000, "en", "s", 1),
    (5, "1234 !!! ###", "de", "t", 2),
    (6, "漢字 слово word", "en", "t", 2),
]


def docs_of(spark, rows):
    """Odd columns too: names that operators might use themselves."""
    d = spark.createDataFrame(rows, DOC)
    return d.withColumns({"n_words": F.lit("x"), "_fp": F.lit(1), "spans": F.lit("y"), "lang_pred": F.lit(0), "quality_score": F.lit("z"), "N_Paragraphs": F.lit(2)})


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


@pytest.mark.parametrize("name", ["op1_quality_rules", "op3_decontamination", "op5_warc", "op6_url_filter", "op10_lm_score"])
def test_oracles(spark, duck, sf_dir, same_rows, name):
    assert same_rows(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name]))


def brute_quality(text, words=re.compile(r"[^\x20\x09-\x0D]+")):
    w = words.findall(text or "")
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if words.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, odd, none):
    texts = ["a b c d e f g h a b c d e f g h x", "a a a a a a a a a a", "é ##\né ##\n\n é", "漢 字 " * 9]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs_of(spark, rows)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r[1], r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(t)
    out = quality_rules.quality_rules(odd).collect()
    assert len(out) == len(ODD) and not any(r.kept for r in out)
    assert sorted(r[1] for r in out) == [0, 0, 0, 3, 3, 5, 9000, 9000]
    assert quality_rules.quality_rules(none).count() == 0


def test_frequent_lines(spark):
    word = lambda i: " ".join(f"{i}w".translate({48 + d: 97 + d for d in range(10)}) + chr(97 + k) for k in range(25))
    rows = [(i, f"{word(i)}\nShared  LINE 7\n", None, "h", None) for i in range(6)]
    rows += [(10 + i, f"Shared line {i}\n{word('same')}", None, "h", None) for i in range(4)]
    rows += [(20, f"{word('same')}", None, "other", None)]
    d = docs_of(spark, rows)
    got = {r.doc_id: r for r in quality_rules.quality_rules(d, max_line_docs=3).collect()}
    assert all(got[i].kept and got[i].n_removed_lines == 1 for i in range(6))
    assert all(not got[10 + i].kept for i in range(4)) and got[20].kept
    clean = {r.doc_id: r.text for r in quality_rules.cleaned_texts(d, max_line_docs=3).collect()}
    assert clean[0] == f"{word(0)}\n" and clean[11] == "" and clean[20] == word("same")


def test_language(spark, odd, none, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = QUERIES["op2_language_id"](spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id")
    right = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    model = langid.train(docs)
    got = langid.label_languages(odd, model).collect()
    assert len(got) == len(ODD)
    by = {(r.doc_id, (r.text or "")[:3]): r for r in got}
    assert by[1, ""].lang_pred_ == "und" and by[5, "123"].lang_pred_ == "und" and by[3, " \t\n"].lang_score == 0
    assert by[6, "漢字 "].lang_pred_ in model.langs
    assert langid.label_languages(none, model).count() == 0
    empty = langid.label_languages(odd, langid.train(none)).collect()
    assert {r.lang_pred_ for r in empty} == {"und"}


def test_mixed_spans(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs)
    long = docs.filter("lang IN ('fr', 'de') AND length(text) BETWEEN 1000 AND 3000").groupBy("lang").agg(F.min("text").alias("t")).collect()
    part = {r.lang: langid.LETTERS.findall(r.t)[:60] for r in long}
    lang, _, spans = langid.Labeller(model).label([" ".join(part["fr"] + part["de"][:40])], spans=True)[0]
    assert lang == "fr" and [s["lang"] for s in spans] == ["fr", "de"] and abs(spans[0]["end"] - 60) < 6


def test_words_of_scripts():
    """Numerals aren't letters, marks stay in words, and long runs are cut, not dropped."""
    assert langid.words_of("\u00b2 \u00bd \u2167 \u2460 12 _") == [] and langid.words_of("Don't Stra\u00dfe") == ["don", "t", "stra\u00dfe"]
    assert langid.words_of("\u0939\u093f\u0928\u094d\u0926\u0940") == ["\u0939\u093f\u0928\u094d\u0926\u0940"]
    run = "".join(chr(0x4E00 + i) for i in range(500))
    assert "".join(langid.words_of(run)) == run and len(langid.words_of(run)) == 13
    two = langid.Labeller(langid.LanguageModel(["aaa aab aba", "bbb bba bab"], ["x", "y"]))
    assert two.label(["\u2167 \u2460", None, "q"])[:2] == [("und", 0.0, [])] * 2
    assert two.label(["aaa bbb"], spans=True)[0][:2] == ("x", 1.0)  # one switch costs more than it gains; a tie goes to the first


def test_many_languages():
    """More labels than a byte holds."""
    names = [f"l{i:03}" for i in range(300)]
    letters = [chr(97 + i % 26) + chr(97 + i // 26) for i in range(300)]
    model = langid.LanguageModel([f"{w} " * 9 for w in letters], names)
    got = langid.Labeller(model).label([f"{w} " * 5 for w in letters])
    assert [x for x, _, _ in got] == names


def test_viterbi_brute():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        s = -rng.random((n, 3)) * 4
        paths = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n)
        value = [sum(s[i, x] for i, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:])) for p in paths]
        assert (langid.viterbi(s, np.array([n]), 1.5)[0] == paths[int(np.argmax(value))]).all()


def test_wu_manber_brute():
    rng = random.Random(4)
    for _ in range(60):
        words = lambda n: " ".join(rng.choice("a b c D é 1".split()) for _ in range(n))
        items = [(str(i), words(rng.choice([0, 1, 2, 5, 11, 13]))) for i in range(4)]
        text = words(rng.choice([0, 3, 40])) + " " + items[0][1] + " " + words(5) + " " + items[3][1]
        hit, got = decontam.Searcher(items).search(decontam.words_of(text))
        assert (len(decontam.words_of(text)), len(hit), sorted(got)) == decontam.brute_force(text, items)


def test_decontaminate(spark, odd, none):
    bench = spark.createDataFrame([(1, "One two three One two three"), (2, None), (None, "c d")], "item_id long, text string")
    for size in (decontam.BLOCK_BYTES, 1):  # whole, and a block for each item
        got = decontam.find_passages(odd, bench, block_bytes=size).collect()
        assert sorted((r.doc_id or 0, len(r.spans_)) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 1), (4, 1), (5, 0), (6, 0)]
        kept = decontam.decontaminate(odd, bench, block_bytes=size)
        assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 6]
    assert decontam.find_passages(none, bench).count() == 0
    assert decontam.find_passages(odd, bench.limit(0)).filter(F.size("spans_") > 0).count() == 0


def test_licences(spark, odd, none):
    model = licenses.train(odd)
    for family, notices in licenses.TEMPLATES.items():
        for t in notices:
            assert model.predict(t)[0] == family, t
    for t in licenses._PLAIN:
        assert model.predict(t)[0] == licenses.UNKNOWN, t
    rows = [(1, "Some text.\nReleased under the MIT License.\nMore.", None, None, None), *ODD]
    got = licenses.scan_licences(docs_of(spark, rows), model).collect()
    assert len(got) == len(rows) and [x.family for x in got[0].licences] == ["MIT"] and got[0].licences[0].line == 1
    assert all(not r.licences for r in got[1:])
    assert licenses.scan_licences(none, licenses.train(none)).count() == 0


def test_licence_passages(spark, odd):
    """Wrapped notices, versions, several families, tags, and a notice amid a long line."""
    model = licenses.train(odd)
    wrapped = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    cases = {
        wrapped: {"GPL-3.0"}, "GNU General Public License, version 1": {"GPL-1.0"}, "Licensed under the MIT and Apache 2.0 licenses.": {"MIT", "Apache-2.0"}, "SPDX-License-Identifier: Apache-2.0": {"Apache-2.0"},
        "grey sky over town " * 200 + "Released under the MIT License. " + "and so they went home " * 200: {"MIT"}, "He studied at MIT and lived in Apache county.": set(),
    }
    rows = [(i, t, None, None, None) for i, t in enumerate(cases)]
    got = {r.doc_id: {x.family for x in r.licences} for r in licenses.scan_licences(docs_of(spark, rows), model).collect()}
    assert [got[i] for i in range(len(rows))] == list(cases.values())


def test_licence_scores_brute(spark, odd):
    """The probabilities by the definition: weights of each distinct known feature and the intercept, over the temperature, as a softmax."""
    model = licenses.train(odd)
    for t in ("licensed under the mit license", "a b c", "the gnu general public license version 2"):
        words = t.split()
        known = {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))} & set(model.place)
        z = [(sum(model.weights[model.place[f], c] for f in known) + model.weights[-1, c]) / model.temperature for c in range(len(model.classes))]
        e = [np.exp(x - max(z)) for x in z]
        assert np.allclose(model.probabilities(words), np.array(e) / sum(e))


def test_licences_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = docs.select("doc_id", F.col("text").rlike("(?m)^(Released under the MIT|Licensed under|This work is licensed|All rights reserved)").alias("has"))
    got = QUERIES["op4_licences"](spark, sf_dir).join(named, "doc_id")
    assert got.filter((F.col("n_licences") > 0) != F.col("has")).count() == 0


def test_warc(spark):
    big = "x" * 100
    rows = [(3, "http://a/3", big), (1, "http://a/1", big), (2, None, big), (4, "u", "small"), (5, "u", "small"), (6, "v", None), (7, "w", ""), (None, "n", big), (8, "é\n", "é" * 90000), (8, "é\n", "é" * 90000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("_digest", F.lit(2))
    index = warc.write_bundles(pages, scratch(spark, "t"), frame_bytes=1000)
    got = sorted((r.page_id or "", r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_bundles(index).collect())
    assert got == sorted([("3", 100, "revisit", "1"), ("1", 100, "response", None), ("2", 100, "revisit", "1"), ("4", 5, "response", None), ("5", 5, "response", None), ("6", 0, "response", None), ("7", 0, "response", None), ("", 100, "revisit", "1"), ("8", 180000, "response", None), ("8", 180000, "response", None)])
    head, block = warc.fetch(index, "4")
    assert head["WARC-Target-URI"] == "u" and block.endswith(b"small")
    bodies = {r.page_id: bytes(r.payload) for r in warc.read_bundles(index, payloads=True).collect()}
    assert bodies["8"].decode() == "é" * 90000 and hashlib.sha256(bodies["1"]).hexdigest() == hashlib.sha256(big.encode()).hexdigest()
    by_index = sorted((r.record_id or "", r.payload_bytes) for r in warc.read_records(index).collect() if r.record_id == r.frame_id)
    assert by_index == sorted((a, n) for a, n, _, _ in got)
    warc.verify_index(index, 1)
    with pytest.raises(Exception, match="another record|no record|wrong"):
        warc.verify_index(index.withColumn("offset", F.lit(0).cast("long")), 1)
    assert warc.read_bundles(warc.write_bundles(pages.limit(0), scratch(spark, "t"))).count() == 0
    odd_ids = ["a b", "", None, "x\r\nWARC-Type: y", "\u00e9>"]
    odd_pages = spark.createDataFrame([(i, "u", big) for i in odd_ids], "page_id string, url string, html string")
    back = {(r.page_id, r.refers_to) for r in warc.read_bundles(warc.write_bundles(odd_pages, scratch(spark, "t"))).collect()}
    assert back == {(i, None if i == "" else "") for i in odd_ids}


def test_warc_many_repeats(spark):
    """Beyond the bound of a broadcast, payloads that can't repeat stay out of the join; results are the same."""
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("y" * 100), (F.col("id") % 1700).cast("string")).alias("html"))
    whole = warc.decide(pages, "page_id", "html").select("page_id", "_first")
    split = warc.decide(pages, "page_id", "html", broadcast_rows=10).select("page_id", "_first")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect())) and split.filter("_first IS NOT NULL").count() == 2600


def test_blocks_of_a_large_benchmark(spark):
    """Several blocks, each a pass of its own, find what one block finds; a full block's tables stay small."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) + " " + items[rng.randrange(400)][1][5:200] for _ in range(60)]
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    one, many = ({r.doc_id: (r.spans, sorted(r["items"])) for r in decontam.find_passages(docs, bench, block_bytes=n).collect()} for n in (decontam.BLOCK_BYTES, 200_000))
    assert one == many and all(i for _, i in one.values())
    s = decontam.Searcher([(str(i), t) for i, t in items])
    size = sum(x.nbytes for w in s.searchers for x in vars(w).values() if isinstance(x, np.ndarray))
    assert size < 8 * sum(len(t) for _, t in items) * 4

def test_globs_brute(spark):
    rng = random.Random(2)
    to_re = lambda g: re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g), re.S)
    globs = ["".join(rng.choice("ab*?") for _ in range(rng.randint(0, 9))) for _ in range(40)] + ["a" * 70 + "*", "*" + "b" * 130]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(80)] + ["a" * 75, "a" * 9 + "b" * 130]
    got = urlfilter.GlobAutomaton(globs).match([t.encode() for t in texts])
    assert all(got[i, j] == bool(to_re(g).fullmatch(t)) for i, t in enumerate(texts) for j, g in enumerate(globs))


def test_url_filter(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://X.Example.NET/en/a?b#c"), (3, "HTTP://X.Example.NET/en/a?b#c"), (4, "http://example.com/de/"), (None, "https://spam-farm.example.org/en/1"), (5, "http://" + "a" * 5000 + ".org/fr/" + "é" * 5000), (6, "://"), (7, "http://net?x")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("html", F.lit(""))
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in urlfilter.url_filter(pages).collect()}
    assert got[1] == ("", None, "allow") and got[2] == ("", None, "allow") and got[3] == ("x.example.net", "example.net/en/", "allow")
    assert got[4][1:] == ("example.com/de/", "block") and got[None][2] == "block" and got[5][1] == "org/fr/" and got[7] == ("net", None, "allow")
    assert urlfilter.url_filter(pages).count() == len(rows) and urlfilter.url_filter(pages.limit(0)).count() == 0


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """The smallest key reachable of each key, by comparing all pairs."""
    keys, root = sorted(fps), {k: k for k in fps}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash_query_brute(spark, sf_dir):
    got = {r.doc_id: r for r in QUERIES["op7_simhash"](spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert all(got[i].fingerprint == f"{fps[i]:016x}" for i in texts)
    assert {i: got[i].component_id for i in texts} == brute_components(fps)


def test_links_brute(spark):
    """Chains, hubs and large neighbourhoods of fingerprints."""
    rng = random.Random(5)
    fps = set()
    for _ in range(25):
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 30])):
            fps.add(at)
            flips = sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 4, 5])))
            if rng.random() < 0.7:
                at ^= flips
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    d = spark.createDataFrame([(signed(f),) for f in fps], "_fp long")
    got = {r.node: r.root for r in simhash.link_fingerprints(d).collect()}
    want = brute_components({signed(f): f for f in fps})
    size = {}
    for k, r in want.items():
        size.setdefault(r, []).append(k)
    assert {k: r for k, r in want.items() if len(size[r]) > 1} == got


def test_whole_balls_find_the_same_links(spark):
    """All 2081 variants of each fingerprint, and the 131 of dropped blocks."""
    rng, fps = random.Random(8), set()
    for _ in range(12):
        at = rng.getrandbits(63)
        for _ in range(6):
            fps.add(at)
            at ^= sum(1 << b for b in rng.sample(range(63), rng.choice([1, 3, 4, 5])))
    d = spark.createDataFrame([(f,) for f in fps], "_fp long")
    both = [{(r.node, r.root) for r in simhash.link_fingerprints(d, whole=w).collect()} for w in (False, True)]
    assert both[0] == both[1] and both[0] and spark.range(1).select(F.col("id").alias("_fp")).transform(lambda x: simhash.variants(x, whole=True)).count() == 2081


def test_components_with_hubs(spark, monkeypatch):
    """Hubs by broadcast and the other nodes by shuffle give what union-find gives."""
    monkeypatch.setattr(simhash, "HUBS", 40)
    rng = random.Random(6)
    edges = [(0, rng.randint(1, 400)) for _ in range(150)] + [(rng.randint(1, 900), rng.randint(1, 900)) for _ in range(250)] + [(5000 + i, 5001 + i) for i in range(30)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


def test_bucket_runs_span_batches():
    import pyarrow as pa

    key = np.sort(np.random.default_rng(3).integers(0, 40, 500))
    fp = np.arange(500, dtype=np.int64)
    one = [pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], names=["k", "f"])]
    cut = [one[0].slice(i, 7) for i in range(0, 500, 7)]
    rows = lambda bs: sorted({(a, b) for x in simhash._bucket_edges(bs) for a, b in zip(x[0].to_pylist(), x[1].to_pylist())})
    assert rows(one) == rows(cut)


def test_dedup(spark, odd, none):
    kept = simhash.simhash_dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6]
    got = simhash.simhash_groups(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r._doc in (1, 2, 3)} == {1}
    assert simhash.simhash_dedup(none).count() == 0
    lost = docs_of(spark, [(None, "same text here", None, None, None)] * 3)
    assert simhash.simhash_dedup(lost).count() == 1


def test_tokens_exact():
    tok = tokens.WordTokenizer(open(tokens.default_path()).read())
    texts = ["Don't you'll <|endoftext|> x", "İstanbul ß ẞ Ÿ Ω ΣΑΣ é 中文 c\x1cd 1²¼ ½x '!!'s", "a\x00b\x7f　\xa0z", "", " ", "A" * 3000, "<|start", None]
    for t, e in zip(texts, tok.encode(texts)):
        assert np.frombuffer(e, "<u4").tolist() == tok.tokenizer.encode(t or "", add_special_tokens=False).ids


def check_packing(rows, lens=None):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    return len(by)


def test_tokens_of_any_word():
    """Odd letters, contractions, runs of one kind, special tokens' strings and all white space."""
    tok, rng = tokens.WordTokenizer(open(tokens.default_path()).read()), random.Random(5)
    alphabet = [*map(chr, range(0x180)), *"'''sstltvremddll<||>\u2028\u3000\u1e9e\u65e5\ufb01\u200b\ufeff", "<|endoftext|>", "'s", "'re", " ", "\n", "a" * 70, "!" * 80]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["a" + chr(c) + "b" for c in range(0x2000, 0x2070)]
    assert [np.frombuffer(e, "<u4").tolist() for e in tok.encode(texts)] == [tok.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokens_by_runs():
    """Runs give the ids of all texts in order, and hold the ids of a run alone."""
    tok, rng = tokens.WordTokenizer(open(tokens.default_path()).read()), random.Random(6)
    texts = pa.array([" ".join(rng.choice(["some", "words", "c\x1cd", "Grüße", "12"]) for _ in range(rng.choice([0, 1, 3, 40]))) for _ in range(300)] + [None, "x " * 500, ""])
    ids, sizes = tok.encode_array(texts)
    for t in (texts, texts.slice(7), texts.slice(0, 0)):
        runs = list(tok.encode_runs(t, 400))
        assert np.concatenate([np.zeros(0, "u4"), *(x for x, _ in runs)]).tolist() == tok.encode_array(t)[0].tolist()
        assert [n for _, size in runs for n in size.tolist()] == tok.encode_array(t)[1].tolist()
    assert len(list(tok.encode_runs(texts, 400))) > 20 and len(sizes) == len(texts) and sizes.sum() == len(ids)
    texts = pa.array(["one two three four five " * 40] * 8000)
    tracemalloc.start()
    whole = sum(len(x) for x, _ in [tok.encode_array(texts)])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    assert sum(len(x) for x, _ in tok.encode_runs(texts)) == whole
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < most / 3


def test_workers_give_back_memory(spark):
    """What a task has freed doesn't stay with its worker, which later stages use again."""

    def held():
        return int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read()).group(1)) // 1024

    def run(batches):
        for b in batches:
            before = held()
            tok, rng = tokens.WordTokenizer(definition), random.Random(7)
            texts = pa.array([" ".join("".join(rng.choices("etaoins", k=9)) for _ in range(500)) for _ in range(800)])
            tok.encode_array(texts)
            yield pa.RecordBatch.from_arrays([pa.array([before])], names=["n"])

    def now(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([held()])], names=["n"])

    definition, one = open(tokens.default_path()).read(), spark.range(0, 1, 1, 1)
    before = one.mapInArrow(lean(run), "n long").collect()[0].n
    assert one.mapInArrow(now, "n long").collect()[0].n < before + 30


def test_packing_query(spark, sf_dir):
    rows = QUERIES["op8_packing"](spark, sf_dir).collect()
    used = check_packing(rows)
    assert used <= -(-sum(r.length for r in rows) // 2048) * 1.005 + 1
    tok = tokens.WordTokenizer(open(tokens.default_path()).read())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in rows[:300]:
        ids = tok.tokenizer.encode(docs[r.doc_id] or "", add_special_tokens=False).ids + [0]
        part = ids[r.start : r.start + 2048]
        assert r.start == 2048 * r.piece and r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())


def test_packing_odd(spark, odd, none):
    rows = packing.pack(odd, ids=True).collect()
    check_packing(rows)
    assert len({r.doc_id for r in rows}) == 7 and sum(r.length for r in rows if r.doc_id == 2) == 1 and all(len(r.ids) == 4 * r.length for r in rows)
    assert packing.pack(none).count() == 0


def test_genetic_packing():
    """Triples that fill bins exactly: best fit alone wastes bins, evolution gains some back and keeps every piece."""
    rng = random.Random(1)
    lens = []
    for _ in range(60):
        a, b = rng.randint(400, 900), rng.randint(400, 900)
        lens += [a, b, 2048 - a - b]
    first = packing.evolve(lens, [], "x", generations=0)[0]
    best = packing.evolve(lens, [], "x", generations=60)[0]
    assert sorted(i for b in best for i in b) == list(range(len(lens)))
    assert all(sum(lens[i] for i in b) <= 2048 for b in best)
    assert packing.fitness(best, lens) < packing.fitness(first, lens) and len(best) <= len(first)


def test_islands(spark):
    rng = random.Random(2)
    d = spark.createDataFrame([(i, rng.randint(500, 1100)) for i in range(900)], "uid long, length long")
    rows = packing.pack_pieces(d, group=300).join(d, "uid").collect()
    assert len(rows) == 900
    check_packing(rows)


def best_count(lens, capacity):
    """The fewest bins, by trying every bin of each piece."""
    best = len(lens)

    def go(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(lens):
            best = len(room)
            return
        for k in range(len(room)):
            if room[k] >= lens[i] and room[k] not in room[:k]:
                go(i + 1, [*room[:k], room[k] - lens[i], *room[k + 1 :]])
        go(i + 1, [*room, capacity - lens[i]])

    go(0, [])
    return best


def test_packing_is_best_in_small_cases():
    """Against every packing; some of these cases best fit alone packs worse."""
    rng, gained = random.Random(9), 0
    for case in range(40):
        lens = sorted((rng.choice([2, 3, 4, 5, 6, 7]) for _ in range(9)), reverse=True)
        got = packing.evolve(lens, [], f"{case}", capacity=10, generations=30)[0]
        assert sorted(i for b in got for i in b) == list(range(9)) and all(sum(lens[i] for i in b) <= 10 for b in got)
        assert len(got) == best_count(lens, 10)
        gained += len(packing.best_fit([], list(range(9)), lens, 10)) > len(got)
    assert gained


def test_groups_share_their_last_sequences(spark):
    """Groups of their own waste a part of a sequence each; the level across groups takes that back."""
    rng = random.Random(4)
    d = spark.createDataFrame([(i, rng.randint(20, 900)) for i in range(2400)], "uid long, length long")
    alone = packing.pack_pieces(d, group=100, opened=0, rounds=1).select("sequence_id").distinct().count()
    rows = packing.pack_pieces(d, group=100, rounds=1).join(d, "uid").collect()
    used = check_packing(rows)
    assert len(rows) == 2400 and {r.level for r in rows} == {1, 2} and used < alone
    assert used <= -(-sum(r.length for r in rows) // 2048) * 1.015


def test_packing_text_ids(spark):
    rows = packing.pack(spark.createDataFrame([("a", "x y"), (None, None), ("a", "x y")], "doc_id string, text string")).collect()
    assert sorted((r.doc_id or "", r.length) for r in rows) == [("", 1), ("a", 3), ("a", 3)]


def test_network(spark, odd, none, sf_dir):
    out = QUERIES["op9_quality"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    right = out.filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.85
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    unknown = bytecnn.train(odd, labels)
    assert {r.quality_score_ for r in bytecnn.score_quality(odd, unknown).collect()} == {0.5}
    net = bytecnn.ByteNetwork().fit(["aaaa " * 50, "!!!! " * 50] * 4, [1, 0] * 4, steps=60)
    got = bytecnn.score_quality(odd, net).collect()
    assert len(got) == len(ODD) and all(0 <= r.quality_score_ <= 1 for r in got)
    assert bytecnn.score_quality(none, net).count() == 0


def test_network_scores_brute():
    """A plain forward pass: each chunk's every place, embedding times filter, maxima, then the layer."""
    net = bytecnn.ByteNetwork(3)
    rng = np.random.default_rng(2)
    net.p["layer"], net.p["bias"] = rng.normal(0, 0.4, 3 * bytecnn.FILTERS), rng.normal(0, 0.1, bytecnn.FILTERS)
    texts = ["", "abc", "Grüße " * 150, "x" * 960]
    for t, got in zip(texts, net.score(texts)):
        tops = []
        for chunk in bytecnn.chunks_of(t):
            z = [[sum(float(net.p["embed"][chunk[i + k]] @ net.p["filters"][k][:, f]) for k in range(bytecnn.WIDTH)) for f in range(bytecnn.FILTERS)] for i in range(0, len(chunk) - bytecnn.WIDTH + 1)]
            tops.append([max(max(row[f] for row in z) + net.p["bias"][f], 0) for f in range(bytecnn.FILTERS)])
        each = list(zip(*tops))
        x = [*map(max, each), *(sum(e) / len(e) for e in each), *map(min, each)]
        assert abs(got - 1 / (1 + np.exp(-(sum(a * b for a, b in zip(x, net.p["layer"])) + net.p["end"][0])))) < 1e-4


def test_very_long_texts():
    """Beyond a block of hashes, a group of words, a chunk, and a batch's part: what the whole text gives."""
    rng = random.Random(7)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(70_000))
    assert simhash.fingerprint(simhash.shingle_hashes(text)) & (1 << 64) - 1 == brute_fingerprint(text)
    model = langid.LanguageModel(["the cat and the dog", "le chat et le chien"], ["en", "fr"])
    labels = langid.Labeller(model).label(["the cat and the dog " * 210_000, "le chat et le chien", None, "the dog"])
    assert [x for x, _, _ in labels] == ["en", "fr", "und", "en"]
    tok = tokens.WordTokenizer(open(tokens.default_path()).read())
    assert tok.encode([text, "cat"])[0] == b"".join(tok.encode(text.split(" ")))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 50, None, "b", "c" * 200, "d"])], names=["t"])
    cut = [b.column(0).to_pylist() for b in tokens.parts([batch, batch.slice(0, 0)], 0, 60)]
    assert sum(cut, []) == batch.column(0).to_pylist() and len(cut) > 1


def test_chunks_cover_text():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        text = "".join(chr(65 + i % 26) for i in range(n))
        c = bytecnn.chunks_of(text)
        whole = bytes(c[0]) + b"".join(bytes(x[bytecnn.CHUNK - bytecnn.STEP :]) for x in c[1:])
        assert whole.rstrip(b"\0").decode() == text


def test_gradients():
    """A step of the network follows the numerical gradient of its loss."""
    net = bytecnn.ByteNetwork()
    rng = np.random.default_rng(0)
    net.p["layer"] = rng.normal(0, 0.3, 3 * bytecnn.FILTERS).astype(np.float32)
    texts, y = ["hello world " * 60, "!! ?? ## " * 9], np.array([1, 0], dtype=np.float32)
    loss = lambda: float(-(y * np.log(s := net.score(texts)) + (1 - y) * np.log(1 - s)).mean())
    got = {}
    real, net._seen = dict(net.p), got
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    before = {k: v.copy() for k, v in net.p.items()}
    net._step([bytecnn.chunks_of(t) for t in texts], y, moments, 1, 0.0)
    for k, at in (("filters", (2, 3, 5)), ("bias", (4,)), ("embed", (ord("l"), 1)), ("end", (0,))):
        g = moments[k][0][at] / 0.1
        net.p = {n: v.copy() for n, v in before.items()}
        net.p[k][at] += 1e-2
        up = loss()
        net.p[k][at] -= 2e-2
        assert abs((up - loss()) / 2e-2 - g) < 2e-3, k
    net.p = real


def lm_brute(docs, order):
    """The definition, by counting every n-gram of every other document."""
    gram = lambda x, at, k: tuple(x[at : at + k])
    seen = lambda others, g: sum(gram(x, at, len(g)) == g for x in others for at in range(len(x) - len(g) + 1))
    every, out = sum(map(len, docs)), []
    for i, x in enumerate(docs):
        others, total = docs[:i] + docs[i + 1 :], 0.0
        for at in range(len(x)):
            s = max(seen(others, gram(x, at, 1)), 0.5) / max(1, every - len(x))
            for k in range(2, min(order, at + 1) + 1):
                c = seen(others, gram(x, at - k + 1, k))
                s = c / seen(others, gram(x, at - k + 1, k - 1)) if c else 0.4 * s
            total += np.log(s)
        out.append(total if x else None)
    return out


@pytest.mark.parametrize("order", [1, 2, 5])
def test_lm_brute(spark, odd, none, order):
    rng = random.Random(order)
    texts = ["the cat sat", "the cat ran", "a dog sat", "the the the", None, "cat", " \n"] + [" ".join(rng.choice("abAB") for _ in range(rng.randint(0, 9))) for _ in range(20)]
    texts += [texts[-1], "one two three four five six", "One  two three\tfour five six ", "zero one two three four five six"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    want = lm_brute([(t or "").lower().split() for t in texts], order)
    for chunk_bytes in (1, 40, 1 << 20):
        got = {r.doc_id: r for r in lmscore.lm_score(docs_of(spark, rows), order=order, chunk_bytes=chunk_bytes).collect()}
        for i, w in enumerate(want):
            assert got[i].n_words == len((texts[i] or "").split())
            assert got[i].log_score is None if w is None else abs(got[i].log_score - w) < 1e-9
    assert lmscore.lm_score(odd, order=order).count() == len(ODD) and lmscore.lm_score(none, order=order).count() == 0


def test_lm_token_ids(spark):
    texts = ["the cat sat on it", "The cats ran", None, "the cat sat"]
    tok = tokens.WordTokenizer(open(tokens.default_path()).read())
    want = lm_brute([np.frombuffer(e, "<u4").tolist() for e in tok.encode(texts)], 3)
    got = lmscore.lm_score(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), order=3, tokenizer=tokens.default_path()).collect()
    assert all((r.log_score is None) == (want[r.doc_id] is None) and (r.log_score is None or abs(r.log_score - want[r.doc_id]) < 1e-9) for r in got)


def test_lm_tells_repeats(spark):
    """A document that another repeats scores far above its like."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ba", "do", "ki", "lu", "ma", "ne", "po"]) + rng.choice("xyz") for _ in range(60)) for _ in range(300)]
    texts[7] = texts[250]
    got = {r.doc_id: r.mean_log_score for r in lmscore.lm_score(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert min(got[7], got[250]) > max(v for k, v in got.items() if k not in (7, 250)) + 1


def test_held_out(spark):
    rows = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
    assert spark.createDataFrame([(None,)], "id long").select(held_out("id")).first()[0] is False


def test_pipeline_stages(spark, sf_dir, odd, none):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_duplicates", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = odd.select(*docs.columns)
    for name, stage in corpus_pipeline.STAGES:
        for d in (plain, plain.limit(0)):
            out = stage(spark, d, sf_dir)
            rows = out.collect()
            if name != "packing":
                assert out.columns == docs.columns and len(rows) <= d.count()


def test_pipeline_brute(spark, sf_dir):
    """The stages again, in plain Python, over the documents that the models keep."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    net = bytecnn.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = langid.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    ids = sorted(docs)
    ids = [i for i, s in zip(ids, net.score([docs[i].text for i in ids])) if s >= 0.7]
    ids = [i for i, (x, s, _) in zip(ids, langid.Labeller(model).label([docs[i].text for i in ids])) if x != "und" and s >= 0.5]
    words = {i: (docs[i].text or "").translate({c: c + 32 for c in range(65, 91)}) for i in ids}
    words = {i: re.findall("[^\\x20\\x09-\\x0D]+", t) for i, t in words.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    comp = {i: i for i in ids}
    for i in ids:  # all pairs, at Jaccard 0.8
        for j in ids:
            if i < j and comp[i] != comp[j] and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                a, b = sorted((comp[i], comp[j]))
                comp = {k: a if c == b else c for k, c in comp.items()}
    ids = [i for i in ids if comp[i] == i]
    search = decontam.Searcher([(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    ids = [i for i in ids if not search.search(decontam.words_of(docs[i].text))[0]]
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    check_packing(rows)
    assert sorted({r.doc_id for r in rows}) == ids and len(ids) > 50


def test_training_takes_no_whole_texts(spark):
    """Texts of over a million characters are learned from, and what is read of them alone comes to the driver."""
    texts = {1: ("the cat and the dog ", "en", 1), 3: ("le chat et le chien ", "fr", 0), 4: ("## !! ", "en", 0)}
    docs = spark.createDataFrame([(i, t * (1_100_000 // len(t)), x, None, None) for i, (t, x, _) in texts.items()], DOC)
    labels = spark.createDataFrame([(i, y) for i, (_, _, y) in texts.items()], "doc_id long, quality int")
    model = langid.train(docs)
    assert model.langs == ["en", "fr"] and langid.Labeller(model).label(["the dog", "le chien"])[1][0] == "fr"
    assert bytecnn.train(docs, labels).constant is None
    chunks, places = bytecnn.drawn(texts[1][0] * 50_000, 6)
    whole = bytecnn.chunks_of(texts[1][0] * 50_000)
    assert len(chunks) <= 6 * bytecnn.CHUNKS_A_DOC < len(whole) and places.shape == (6, bytecnn.CHUNKS_A_DOC)
    assert all(len(set(p)) == bytecnn.CHUNKS_A_DOC for p in places.tolist()) and {c.tobytes() for c in chunks} <= {c.tobytes() for c in whole}


def test_lm_chunks_in_tasks_of_their_own(spark, tmp_path):
    """Rows of a few bytes stand for chunks of megabytes: adaptive execution must not put them in one task."""
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(24)], "doc_id int, text string")
    state = lmscore.materialize(lmscore.chunks(docs, "doc_id", "text", 1, None, f"file://{tmp_path}/chunks"), "chunks")
    got = lmscore.exploded(state, 1, 1, 24).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in got) == 24 and len(got) >= 20


def test_telling_pairs_count_every_paragraph(spark, monkeypatch):
    """What is frequent is told by all paragraphs, not by those of the sample."""
    rows = [(i, "they said that this work is\n\nplain words of another kind\n\nthe general public was there", None, None, None) for i in range(700)]
    got = licenses.corpus_pairs(docs_of(spark, rows))
    assert got[None] == 2100 and got["this work"] == 700 and got["general public"] == 700
    monkeypatch.setattr(licenses, "SAMPLE_PARAGRAPHS", 1)
    model = licenses.train(docs_of(spark, rows), limit=0)
    assert "this work" not in model.telling and "general public license" not in model.telling and "mit license" in model.telling
