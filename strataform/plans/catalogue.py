"""The queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import chunks, search, vectors
from ..operators.crossmodal import CrossModal
from ..operators.graphs import Graph, recursive_union
from ..operators.tables import ConstraintError, ForeignKey, Policy, Table, number_rows
from ..sources import tables as T
from ..streaming import streams
from . import dialect
from .relational import PAIRS
from .statements import Database

_Q, _SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        _Q[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue, orders and distinct customers of each nation."""
    o, c, n, li = (T.load(spark, sf_dir, t) for t in ("orders", "customer", "nation", "lineitem"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("c_custkey").alias("customers"))


_Q["flagship"] = flagship
_SQL["flagship"] = "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT c_custkey) AS customers FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"


def _relational(text: str):
    names = [t for t in T.TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        T.register(spark, sf_dir, names)
        return spark.sql(text)

    return run


for _name, _pair in PAIRS.items():
    _ours, _theirs = _pair if isinstance(_pair, tuple) else (_pair, _pair)
    _Q[_name], _SQL[_name] = _relational(_ours), _theirs


@query("param_query", "SELECT p_partkey FROM part WHERE p_size > 40 AND p_brand = 'Brand#11'")
def _param(spark, d):
    T.register(spark, d, ["part"])
    return dialect.Query(spark).select("p_partkey").from_("part").where("p_size > ?", 40).where("p_brand = ?", "Brand#11").exec()


# JSON, dialect


@query("json_contains", "SELECT event_id, coalesce(json_extract_string(props, '$.k') = '7', false) AS has FROM events")
def _json_contains(spark, d):
    return T.load(spark, d, "events").select("event_id", C.json_contains("props", F.lit('{"k": 7}')).alias("has"))


@query("json_contained_by", "SELECT event_id, coalesce(json_extract_string(props, '$.k') = '7', false) AS inside FROM events")
def _json_contained(spark, d):
    return T.load(spark, d, "events").select("event_id", C.json_contains(F.lit('{"k": 7, "x": 1}'), F.col("props")).alias("inside"))


@query("json_keys", "SELECT event_id, coalesce(list_contains(json_keys(props), 'k'), false) AS has_k, coalesce(list_contains(json_keys(props), 'z') OR list_contains(json_keys(props), 'k'), false) AS any_of, coalesce(list_contains(json_keys(props), 'z') AND list_contains(json_keys(props), 'k'), false) AS all_of FROM events")
def _json_keys(spark, d):
    return T.load(spark, d, "events").select("event_id", C.json_has_key("props", "k").alias("has_k"), C.json_has_any("props", ["z", "k"]).alias("any_of"), C.json_has_all("props", ["z", "k"]).alias("all_of"))


@query("dialect_precedence", "SELECT event_id, power(2, power(3, 2)) AS tower, -power(2, 2) AS minus, json_extract_string(props, '$.k') || '!' AS chained, coalesce(CAST(json_extract_string(props, '$.zz') AS BIGINT), 7) AS other, 7 // 2 * 2 AS floored, true AS arrays FROM events")
def _precedence(spark, d):
    T.register(spark, d, ["events"])
    return dialect.sql(spark, "SELECT event_id, 2 ** 3 ** 2 AS tower, -2 ** 2 AS minus, props ->> 'k' ++ '!' AS chained, CAST(props -> 'zz' AS BIGINT) ?? 7 AS other, 7 // 2 * 2 AS floored, '[1,2,3]' @> '[1,3]' AND '[2]' <@ '[1,2]' AS arrays FROM events")


@query("dialect_operators", "SELECT event_id, json_extract_string(props, '$.k') AS k, power(2, 3) AS p, coalesce(NULL, event_type) AS t, event_type || '!' AS s, contains(lower(event_type), 'c') AS m FROM events")
def _dialect(spark, d):
    T.register(spark, d, ["events"])
    return dialect.sql(spark, "SELECT event_id, props ->> 'k' AS k, 2 ** 3 AS p, NULL ?? event_type AS t, event_type ++ '!' AS s, event_type @@ 'c' AS m FROM events")


# Vectors


def _emb(spark, d):
    return T.load(spark, d, "embeddings")


_PAIR = "FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0) AS q FROM embeddings)"


def _with_q(spark, d):
    e = _emb(spark, d)
    return e.crossJoin(F.broadcast(e.filter("vec_id = 0").select(F.col("embedding").alias("q"))))  # one row


@query("vector_distances", f"SELECT vec_id, round(list_cosine_distance(e, q), 6) AS cosine, round(list_distance(e, q), 6) AS l2, round(list_inner_product(e, q), 6) AS ip, round(list_sum(list_transform(list_zip(e, q), lambda z: abs(z[1] - z[2]))), 6) AS l1, CAST(len(e) AS INT) AS dims {_PAIR}")
def _distances(spark, d):
    return _with_q(spark, d).select("vec_id", F.round(C.cosine_distance("embedding", "q"), 6).alias("cosine"), F.round(C.l2_distance("embedding", "q"), 6).alias("l2"), F.round(C.inner_product("embedding", "q"), 6).alias("ip"), F.round(C.l1_distance("embedding", "q"), 6).alias("l1"), F.size("embedding").alias("dims"))


def _first(spark, d):
    return [float(x) for x in _emb(spark, d).filter("vec_id = 0").first().embedding]


@query("knn_exact", f"SELECT vec_id, round(list_cosine_distance(e, q), 6) AS distance {_PAIR} ORDER BY list_cosine_distance(e, q), vec_id LIMIT 10")
def _knn(spark, d):
    return vectors.knn(_emb(spark, d), _first(spark, d), 10).select("vec_id", F.round("distance", 6).alias("distance"))


@query("knn_filtered", "SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings WHERE label = 1 ORDER BY list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), vec_id LIMIT 10")
def _knn_filtered(spark, d):
    return vectors.knn(_emb(spark, d), _first(spark, d), 10, metric="euclidean", where="label = 1").select("vec_id", F.round("distance", 6).alias("distance"))


@query("knn_batch", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(e.v, q.v), e.vec_id) AS rank FROM e, e q WHERE q.vec_id % 50 = 0) WHERE rank <= 5")
def _knn_batch(spark, d):
    e = _emb(spark, d)
    return vectors.knn_batch(e, e.filter("vec_id % 50 = 0"), 5).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("vec_normalize", "SELECT vec_id, round(list_sum(list_transform(e, lambda x: (x / n) * (x / n))), 6) AS unit, round(e[1] / n, 6) AS head FROM (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))")
def _normalize(spark, d):
    u = _emb(spark, d).select("vec_id", C.normalize("embedding").alias("u"))
    return u.select("vec_id", F.round(C.inner_product("u", "u"), 6).alias("unit"), F.round(F.col("u")[0], 6).alias("head"))


@query("scalar_quant8", "WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings), b AS (SELECT min(x) AS lo, max(x) AS hi FROM e) SELECT vec_id, CAST(floor((x - lo) / (hi - lo) * 255 + 0.5) AS INT) AS code FROM e, b")
def _quant(spark, d):
    e = _emb(spark, d)
    dims = 64
    stats = e.agg(F.array(*(F.min(F.col("embedding")[i].cast("double")) for i in range(dims))).alias("lo"), F.array(*(F.max(F.col("embedding")[i].cast("double")) for i in range(dims))).alias("hi"))
    return e.crossJoin(F.broadcast(stats)).select("vec_id", C.quantize("embedding", F.col("lo"), F.col("hi"))[0].alias("code"))


@query("binary_hamming", f"SELECT vec_id, CAST(len(list_filter(list_zip(e, q), lambda z: (z[1] >= 0) <> (z[2] >= 0))) AS BIGINT) AS hamming {_PAIR}")
def _hamming(spark, d):
    return _with_q(spark, d).select("vec_id", C.hamming(C.binarize("embedding"), C.binarize("q")).alias("hamming"))


def _every_50(spark, d):
    return _emb(spark, d).filter("vec_id % 50 = 0")


_KEPT: dict = {}


def _kept(spark, d, kind: str, make):
    """An index that is built once for a session and a folder."""
    at = spark.sparkContext.applicationId, d, kind
    if at not in _KEPT:
        _KEPT[at] = make()
    return _KEPT[at]


@query("ivf_search")
def _ivf(spark, d):
    return _kept(spark, d, "ivf", lambda: vectors.IvfIndex(_emb(spark, d))).search_batch(_every_50(spark, d), 10)


@query("lsh_search")
def _lsh(spark, d):
    return _kept(spark, d, "lsh", lambda: vectors.LshIndex(_emb(spark, d))).search_batch(_every_50(spark, d), 10)


@query("pq_search")
def _pq(spark, d):
    return _kept(spark, d, "pq", lambda: vectors.ProductQuantizer(_emb(spark, d))).search_batch(_every_50(spark, d), 10)


@query("scalar_quant4", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), x AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM e), b AS (SELECT i, min(x) AS lo, max(x) AS hi FROM x GROUP BY i), c AS (SELECT vec_id, i, x, lo, hi, CASE WHEN hi > lo THEN CAST(floor((x - lo) / (hi - lo) * 15 + 0.5) AS INT) ELSE 0 END AS code FROM x JOIN b USING (i)) SELECT vec_id, CAST(sum(code) AS BIGINT) AS codes, round(max(abs(lo + code * (hi - lo) / 15 - x)), 6) AS off FROM c GROUP BY vec_id")
def _quant4(spark, d):
    e = _emb(spark, d)
    stats = e.agg(F.array(*(F.min(F.col("embedding")[i].cast("double")) for i in range(64))).alias("lo"), F.array(*(F.max(F.col("embedding")[i].cast("double")) for i in range(64))).alias("hi"))
    q = e.crossJoin(F.broadcast(stats)).select("vec_id", "embedding", "lo", "hi", C.quantize("embedding", F.col("lo"), F.col("hi"), 4).alias("c"))  # one row
    back = C.dequantize(F.col("c"), F.col("lo"), F.col("hi"), 4)
    return q.select("vec_id", F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x).alias("codes"), F.round(F.array_max(F.zip_with(back, "embedding", lambda x, y: F.abs(x - y.cast("double")))), 6).alias("off"))


# Text search

# Fixed values of the SQL side, kept apart from the functions' own.
_STOP_WORDS = (
    "a an the is it in on at to for of with by from as into through during before after above below between out off over under again further "
    "then once here there when where why how all each every both few more most other some such no nor not only own same so than too very can will just don should now "
    "и в на за от да се е са по не че с към но или ако при до"
)
_STOP = ", ".join(f"'{w}'" for w in _STOP_WORDS.split())
_TOK = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}_-]+'), lambda t: strlen(t) BETWEEN 2 AND 64 AND t NOT IN ({_STOP}))"
_D = f"d AS (SELECT doc_id, {_TOK} AS t FROM documents)"
_P = f"{_D}, p AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM d), f AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL), g AS (SELECT term, count(*) AS df, sum(tf) AS freq FROM f GROUP BY term), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d), w AS (SELECT doc_id, term, tf, freq, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / a)) AS bm, tf * ln(n / df) AS ti FROM f JOIN g USING (term) JOIN d USING (doc_id), s)".replace("0.5", "CAST(0.5 AS DOUBLE)").replace("1.2", "CAST(1.2 AS DOUBLE)").replace("2.2", "CAST(2.2 AS DOUBLE)")


def _docs(spark, d):
    return T.load(spark, d, "documents")


def _index(spark, d) -> search.TextIndex:
    return _kept(spark, d, "text", lambda: search.TextIndex.build(_docs(spark, d)))


def _scored(df: DataFrame, *more: str) -> DataFrame:
    return df.select("doc_id", F.round("score", 6).alias("score"), *more)


@query("tokenize_counts", f"WITH {_D} SELECT doc_id, CAST(len(t) AS BIGINT) AS n, CAST(len(list_distinct(t)) AS BIGINT) AS n_terms FROM d")
def _tokenize(spark, d):
    t = C.tokens(F.coalesce("text", F.lit("")))
    return _docs(spark, d).select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@query("bm25", f"WITH {_P} SELECT doc_id, round(sum(bm), 6) AS score FROM w WHERE term IN ('mit', 'license') GROUP BY doc_id ORDER BY sum(bm) DESC, doc_id LIMIT 50")
def _bm25(spark, d):
    return _scored(_index(spark, d).bm25("the MIT license", 50))


@query("tfidf", f"WITH {_P} SELECT doc_id, round(sum(ti), 6) AS score FROM w WHERE term IN ('apache', 'version') GROUP BY doc_id ORDER BY sum(ti) DESC, doc_id LIMIT 50")
def _tfidf(spark, d):
    return _scored(_index(spark, d).tfidf("apache version", 50))


@query("fuzzy_levenshtein", f"WITH {_P} SELECT term, levenshtein(term, 'license') AS distance FROM g WHERE abs(length(term) - 7) <= 2 AND levenshtein(term, 'license') <= 2")
def _fuzzy(spark, d):
    return search.fuzzy_terms(_index(spark, d).terms(), "license").select("term", "distance")


@query("fuzzy_search", f"WITH {_P} SELECT doc_id, round(sum((1 - levenshtein(term, 'licence') / CAST(greatest(length(term), 7) AS DOUBLE)) * tf), 6) AS score FROM f WHERE levenshtein(term, 'licence') <= 2 GROUP BY doc_id")
def _fuzzy_docs(spark, d):
    return _scored(_index(spark, d).fuzzy("licence"))


@query("prefix_terms", f"WITH {_P} SELECT term, CAST(freq AS BIGINT) AS freq FROM g WHERE term LIKE 'lic%'")
def _prefix(spark, d):
    return search.wildcard(_index(spark, d).terms(), "lic*")


@query("wildcard_terms", f"WITH {_P} SELECT term, CAST(freq AS BIGINT) AS freq FROM g WHERE term LIKE '%cens_'")
def _wildcard(spark, d):
    return search.wildcard(_index(spark, d).terms(), "*cens?")


@query("wildcard_search", f"WITH {_P} SELECT doc_id, CAST(sum(tf) AS DOUBLE) AS score FROM f WHERE contains(term, 'icens') GROUP BY doc_id")
def _wildcard_docs(spark, d):
    return _index(spark, d).wildcard("*icens*")


@query("postings", f"WITH {_P} SELECT term, doc_id, count(*) AS tf, CAST(sum(pos - 1) AS BIGINT) AS at FROM p GROUP BY term, doc_id")
def _postings(spark, d):
    return _index(spark, d).postings().select("term", "doc_id", "tf", F.aggregate("positions", F.lit(0).cast("long"), lambda s, x: s + x).alias("at"))


@query("phrase", f"WITH {_P}, m AS (SELECT a.doc_id, count(*) AS n_matches FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'apache' AND b.term = 'license' GROUP BY a.doc_id) SELECT doc_id, round(2 * sum(bm), 6) AS score, any_value(n_matches) AS n_matches FROM w JOIN m USING (doc_id) WHERE term IN ('apache', 'license') GROUP BY doc_id")
def _phrase(spark, d):
    return _scored(_index(spark, d).phrase("Apache License"), "n_matches")


@query("phrase_slop", f"WITH {_P}, m AS (SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 3 WHERE a.term = 'licensed' AND b.term = 'license') SELECT doc_id, round(2 * sum(bm), 6) AS score FROM w JOIN m USING (doc_id) WHERE term IN ('licensed', 'license') GROUP BY doc_id")
def _phrase_slop(spark, d):
    return _scored(_index(spark, d).phrase("licensed license", slop=2))


@query("proximity_two_terms", f"WITH {_P}, m AS (SELECT a.doc_id, min(abs(CAST(a.pos AS BIGINT) - b.pos)) AS span FROM p a JOIN p b ON a.doc_id = b.doc_id WHERE a.term = 'licensed' AND b.term = 'version' GROUP BY a.doc_id HAVING min(abs(CAST(a.pos AS BIGINT) - b.pos)) <= 6) SELECT doc_id, round(sum(bm) * 6 / greatest(any_value(span), 1), 6) AS score, any_value(span) AS span FROM w JOIN m USING (doc_id) WHERE term IN ('licensed', 'version') GROUP BY doc_id")
def _proximity(spark, d):
    return _scored(_index(spark, d).proximity("licensed version", 6), "span")


@query("boolean_and_or_not", f"WITH {_P}, m AS (SELECT doc_id FROM d WHERE (list_contains(t, 'license') OR list_contains(t, 'rights')) AND NOT list_contains(t, 'apache')) SELECT doc_id, round(sum(bm), 6) AS score FROM w JOIN m USING (doc_id) WHERE term IN ('license', 'rights', 'apache') GROUP BY doc_id")
def _boolean(spark, d):
    return _scored(_index(spark, d).boolean("(license OR rights) AND NOT apache"))


@query("boolean_not", f"WITH {_P} SELECT doc_id, CAST(0 AS DOUBLE) AS score FROM d WHERE NOT list_contains(t, 'license')")
def _boolean_not(spark, d):
    return _scored(_index(spark, d).boolean("NOT license"))


@query("boolean_rich", f"WITH {_P}, m AS (SELECT d.doc_id FROM d JOIN documents USING (doc_id) WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' mit license ') AND lang = 'en' AND n_chars BETWEEN 10 AND 90000 AND len(list_filter(t, lambda x: starts_with(x, 'releas'))) > 0) SELECT doc_id, round(sum(bm), 6) AS score FROM w JOIN m USING (doc_id) WHERE term IN ('mit', 'license') OR starts_with(term, 'releas') GROUP BY doc_id")
def _boolean_rich(spark, d):
    return _scored(_index(spark, d).boolean('"MIT license" +lang:en n_chars:[10 TO 90000] releas*', fields=_docs(spark, d).select("doc_id", "lang", "n_chars")))


@query("boolean_fuzzy", f"WITH {_P}, m AS (SELECT doc_id FROM d WHERE len(list_filter(t, lambda x: levenshtein(x, 'licence') <= 1)) > 0 AND NOT list_contains(t, 'apache')) SELECT doc_id, round(sum(bm), 6) AS score FROM w JOIN m USING (doc_id) WHERE levenshtein(term, 'licence') <= 1 GROUP BY doc_id")
def _boolean_fuzzy(spark, d):
    return _scored(_index(spark, d).boolean("licence~1 -apache"))


@query("fts_match_substring", "SELECT doc_id FROM documents WHERE contains(lower(text), 'mit') AND contains(lower(text), 'license')")
def _match(spark, d):
    T.register(spark, d, ["documents"])
    return dialect.sql(spark, "SELECT doc_id FROM documents WHERE text @@ 'mit license'")


_GRAMS = "list_distinct(list_transform(range(1, greatest(length(term) - 2, 1) + 1), lambda i: substring(term, i, 3)))"
_CAND = f"{_P}, x AS (SELECT term, CAST(freq AS BIGINT) AS freq, len(list_filter(['lic', 'ice', 'cen', 'ens', 'nse'], lambda z: list_contains({_GRAMS}, z))) AS c, levenshtein(term, 'license') AS distance FROM g WHERE abs(length(term) - 7) <= 2), y AS (SELECT term, freq, distance, c / CAST(5 + greatest(length(term) - 2, 1) - c AS DOUBLE) AS similarity, (1 - distance / CAST(greatest(length(term), 7) AS DOUBLE)) * ln(freq + 1) AS score FROM x WHERE c > 0 AND distance <= 2)"


@query("ngram_fuzzy", f"WITH {_CAND} SELECT term, freq, distance, round(similarity, 6) AS similarity, round(score, 6) AS score FROM y WHERE similarity >= 0.1")
def _ngram(spark, d):
    return search.ngram_candidates(_index(spark, d).terms(), "license").select("term", "freq", "distance", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


@query("ngram_search", f"WITH {_CAND} SELECT doc_id, round(sum(score * tf), 6) AS score FROM f JOIN y USING (term) WHERE similarity >= 0.1 GROUP BY doc_id")
def _ngram_docs(spark, d):
    return _scored(_index(spark, d).ngram_fuzzy("license"))


@query("index_changes", f"WITH documents AS (SELECT * FROM documents WHERE doc_id % 7 <> 3 UNION ALL SELECT doc_id + 10000000, 'MIT license ' || lang, lang, source, n_chars FROM documents WHERE doc_id % 7 = 3), {_P} SELECT doc_id, round(sum(bm), 6) AS score FROM w WHERE term IN ('mit', 'license') GROUP BY doc_id")
def _index_changes(spark, d):
    """Documents removed and others added in a second segment, then both compacted."""
    docs = _docs(spark, d)
    index = search.TextIndex.build(docs)
    gone = docs.filter("doc_id % 7 = 3")
    index.remove(gone)
    index.add(gone.select((F.col("doc_id") + 10000000).alias("doc_id"), F.concat(F.lit("MIT license "), "lang").alias("text")))
    index.compact()
    return _scored(index.bm25("MIT license"))


@query("facet_counts", "SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def _facets(spark, d):
    return search.facet_counts(_docs(spark, d), ["lang", "source"])


@query("facet_candidates", f"WITH {_D}, c AS (SELECT lang, source FROM documents JOIN d USING (doc_id) WHERE list_contains(t, 'license')), x AS (SELECT 'lang' AS field, lang AS value, count(*) AS n FROM c GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM c GROUP BY source) SELECT field, value, n FROM x QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value NULLS FIRST) <= 3")
def _facet_candidates(spark, d):
    return search.facet_counts(_docs(spark, d), ["lang", "source"], candidates=_index(spark, d).bm25("license"), limit=3)


@query("facet_filter", "SELECT doc_id FROM documents WHERE lang IN ('fr', 'de') AND source IN ('src0', 'src1', 'src2') AND NOT coalesce(source IN ('src1'), false)")
def _facet_filter(spark, d):
    return search.facet_filter(_docs(spark, d), {"lang": ["fr", "de"], "source": ["src0", "src1", "src2"]}, {"source": ["src1"]}).select("doc_id")


@query("detect_language", "SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\\p{Cyrillic}]', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]', '', 'g')) THEN 'ru' ELSE 'en' END AS lang FROM documents")
def _detect(spark, d):
    return _docs(spark, d).select("doc_id", C.detect_language("text").alias("lang"))


_ENGLISH = "CASE WHEN strlen(term) <= 3 THEN term WHEN suffix(term, 'ing') THEN term[:-4] WHEN suffix(term, 'tion') OR suffix(term, 'ness') OR suffix(term, 'ment') OR suffix(term, 'able') OR suffix(term, 'ible') THEN term[:-5] WHEN suffix(term, 'ies') THEN term[:-4] || 'y' WHEN (suffix(term, 'es') OR suffix(term, 'ed') OR suffix(term, 'ly')) AND strlen(term) > 4 THEN term[:-3] WHEN suffix(term, 's') AND NOT suffix(term, 'ss') THEN term[:-2] ELSE term END"


@query("stem_terms", f"WITH {_P} SELECT stem, CAST(sum(freq) AS BIGINT) AS n FROM (SELECT {_ENGLISH} AS stem, freq FROM g) GROUP BY stem")
def _stems(spark, d):
    return _index(spark, d).terms().groupBy(C.simple_stem("term").alias("stem")).agg(F.sum("freq").alias("n"))


_GERMAN = "CASE WHEN strlen(w) <= 3 THEN w WHEN suffix(w, 'ung') THEN w[:-4] WHEN suffix(w, 'heit') OR suffix(w, 'keit') OR suffix(w, 'lich') OR suffix(w, 'isch') OR suffix(w, 'chen') THEN w[:-5] WHEN suffix(w, 'schaft') THEN w[:-7] WHEN suffix(w, 'en') OR suffix(w, 'er') OR suffix(w, 'es') THEN w[:-3] ELSE w END"


@query("language_tokens", f"SELECT doc_id, CAST(len(list_filter(list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}_-]+'), lambda w: {_GERMAN}), lambda t: strlen(t) >= 2 AND t NOT IN ('der', 'die', 'das', 'ein', 'eine', 'und', 'oder', 'aber', 'nicht', 'ist', 'sind', 'war', 'hat', 'haben', 'werden', 'wird', 'kann', 'mit', 'von', 'für', 'auf', 'in', 'an', 'zu', 'bei', 'nach', 'über', 'unter', 'vor', 'zwischen', 'durch', 'gegen', 'ohne'))) AS BIGINT) AS n FROM documents WHERE lang = 'de' AND text IS NOT NULL")
def _language_tokens(spark, d):
    return _docs(spark, d).filter("lang = 'de' AND text IS NOT NULL").select("doc_id", F.size(C.language_tokens("text", "de")).cast("long").alias("n"))


@query("chunk_paragraph", "SELECT doc_id, CAST(len(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: trim(p, ' ' || chr(9) || chr(13) || chr(10))), lambda p: length(p) > 0)) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def _paragraphs(spark, d):
    return _docs(spark, d).filter("text IS NOT NULL").select("doc_id", F.size(C.chunk_paragraphs("text")).cast("long").alias("n"))


@query("chunk_sentence", "SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '([.?!]) ', '\\1' || chr(1), 'g'), chr(1)), lambda p: length(trim(p, ' ' || chr(9) || chr(13) || chr(10))) > 0)) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def _sentences(spark, d):
    return _docs(spark, d).filter("text IS NOT NULL").select("doc_id", F.size(C.chunk_sentences("text")).cast("long").alias("n"))


@query("chunk_recursive")
def _chunk(spark, d):
    return chunks.chunk(_docs(spark, d))


# Hybrid


def _lists(spark, d, k=20, depth=None, where=None):
    """The k nearest vectors and the depth (k) best texts, each ranked from 1."""
    vec = search.ranked(vectors.knn(_emb(spark, d), _first(spark, d), k, where=where).select(F.col("vec_id").alias("doc_id"), "distance"), ["distance", "doc_id"], k)
    return vec, search.ranked(_index(spark, d).bm25("license", depth or k), [F.desc("score"), "doc_id"], depth or k)


def _hybrid_sql(k: int, texts: int, where: str = "true") -> str:
    return f"{_P}, v AS (SELECT doc_id, row_number() OVER (ORDER BY distance, doc_id) AS rank, distance FROM (SELECT vec_id AS doc_id, list_cosine_distance(e, q) AS distance {_PAIR.replace('FROM embeddings)', f'FROM embeddings WHERE {where})')} ORDER BY distance, doc_id LIMIT {k})), x AS (SELECT doc_id, row_number() OVER (ORDER BY bm DESC, doc_id) AS rank FROM (SELECT doc_id, sum(bm) AS bm FROM w WHERE term = 'license' GROUP BY doc_id ORDER BY 2 DESC, 1 LIMIT {texts}))"


def _fused_sql(k: int, texts: int, a: float, b: float, where: str = "true", keep: str = "true") -> str:
    return f"WITH {_hybrid_sql(k, texts, where)} SELECT doc_id, round(sum(s), 8) AS score FROM (SELECT doc_id, CAST({a} AS DOUBLE) / (60 + rank) AS s FROM v UNION ALL SELECT doc_id, CAST({b} AS DOUBLE) / (60 + rank) FROM x WHERE {keep}) GROUP BY doc_id ORDER BY sum(s) DESC, doc_id LIMIT {k}"


@query("hybrid_rrf", _fused_sql(20, 20, 1, 1))
def _hybrid(spark, d):
    return search.rank_fusion(list(_lists(spark, d)), "doc_id", limit=20).select("doc_id", F.round("score", 8).alias("score"))


@query("hybrid_filtered", _fused_sql(20, 60, 1, 1, "label = 1", "doc_id IN (SELECT vec_id FROM embeddings WHERE label = 1)"))
def _hybrid_filtered(spark, d):
    """Vectors are filtered first; three times as many texts are ranked, and then filtered."""
    v, x = _lists(spark, d, 20, 60, "label = 1")
    x = x.join(_emb(spark, d).filter("label = 1").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    return search.rank_fusion([v, x], "doc_id", limit=20).select("doc_id", F.round("score", 8).alias("score"))


@query("hybrid_weighted", _fused_sql(40, 40, 0.7, 0.3).removesuffix("LIMIT 40") + "LIMIT 20")
def _weighted(spark, d):
    """Lists of twice the length that is asked for."""
    return search.rank_fusion(list(_lists(spark, d, 40)), "doc_id", [0.7, 0.3], limit=20).select("doc_id", F.round("score", 8).alias("score"))


@query("crossmodal_scores", f"WITH {_hybrid_sql(20, 20)} SELECT doc_id, round(sum(s), 8) AS score FROM (SELECT doc_id, CAST(0.5 AS DOUBLE) / (1 + distance) AS s FROM v UNION ALL SELECT doc_id, CAST(0.5 AS DOUBLE) / rank FROM x) GROUP BY doc_id")
def _crossmodal(spark, d):
    v, x = _lists(spark, d)
    s = v.select("doc_id", (F.lit(0.5) / (1 + F.col("distance"))).alias("s")).unionByName(x.select("doc_id", (F.lit(0.5) / F.col("rank")).alias("s")))
    return s.groupBy("doc_id").agg(F.round(F.sum("s"), 8).alias("score"))


@query("crossmodal_hybrid", f"WITH RECURSIVE {_hybrid_sql(20, 20)}, " + "@E, h(id, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.dst, h.depth + 1 FROM h JOIN e ON e.src = h.id WHERE h.depth < 2), b AS (SELECT id, row_number() OVER (ORDER BY min(depth), id) AS place FROM h GROUP BY id) SELECT doc_id, round(sum(s), 8) AS score FROM (SELECT doc_id, CAST(0.5 AS DOUBLE) / (1 + distance) AS s FROM v UNION ALL SELECT doc_id, CAST(0.3 AS DOUBLE) / rank FROM x UNION ALL SELECT id, CAST(0.2 AS DOUBLE) / place FROM b) GROUP BY doc_id")
def _crossmodal_hybrid(spark, d):
    both = CrossModal(_emb(spark, d), _index(spark, d), _graph(spark, d))
    return both.search("hybrid", _first(spark, d), "license", 1, 20, max_depth=2, weights=(0.5, 0.3, 0.2)).select("doc_id", F.round("score", 8).alias("score"))


@query("text_index_build", f"WITH {_D} SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS total FROM d")
def _index_build(spark, d):
    """A new index, for the time that it takes."""
    index = search.TextIndex.build(_docs(spark, d))
    return spark.createDataFrame([(index.n, index.total)], "n long, total long")


@query("rerank_overlap", "SELECT doc_id, round(CAST(contains(lower(text), 'mit') AS INT) * 0.01 + CAST(contains(lower(text), 'license') AS INT) * 0.01, 6) AS score FROM documents".replace("0.01", "CAST(0.01 AS DOUBLE)"))
def _rerank(spark, d):
    return search.rerank(_docs(spark, d).withColumn("score", F.lit(0.0)), "MIT license").select("doc_id", F.round("score", 6).alias("score"))


# Graph: parts that follow each other in an order

_E = "e AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, min(a.l_quantity) AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2)"


def _graph(spark, d) -> Graph:
    li = T.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    a, b = li.alias("a"), li.alias("b")
    e = a.join(b, F.expr("a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_partkey <> b.l_partkey"))
    e = e.groupBy(F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst")).agg(F.min("a.l_quantity").alias("weight")).withColumn("label", F.lit("next"))
    n = T.load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"), F.create_map(F.lit("type"), F.col("p_type")).alias("properties"))
    return Graph(n, e)


_START = 1
_SQL["crossmodal_hybrid"] = _SQL["crossmodal_hybrid"].replace("@E", _E)


@query("bfs_depth", f"WITH RECURSIVE {_E}, r(id, depth) AS (SELECT CAST({_START} AS BIGINT), 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 2) SELECT id, min(depth) AS depth FROM r GROUP BY id")
def _bfs(spark, d):
    return _graph(spark, d).bfs(_START, 2).select("id", "depth")


def _relaxed_sql(rounds: int) -> str:
    text = f"WITH {_E}, d0 AS (SELECT CAST({_START} AS BIGINT) AS id, CAST(0 AS DOUBLE) AS x)"
    for i in range(rounds):
        text += f", d{i + 1} AS MATERIALIZED (SELECT id, min(x) AS x FROM (SELECT id, x FROM d{i} UNION ALL SELECT e.dst, d.x + e.w FROM d{i} d JOIN e ON e.src = d.id) GROUP BY id)"
    return text + f" SELECT id, x AS distance FROM d{rounds}"


@query("dijkstra", _relaxed_sql(25))
def _dijkstra(spark, d):
    return _graph(spark, d).dijkstra(_START)


def _pagerank_sql(rounds: int) -> str:
    text = f"WITH {_E}, n AS (SELECT p_partkey AS id FROM part), k AS (SELECT count(*) AS k FROM n), dg AS (SELECT src, count(*) AS c FROM e GROUP BY src), r0 AS (SELECT id, 1.0 / k AS rank FROM n, k)".replace("1.0 / k", "CAST(1 AS DOUBLE) / k")
    for i in range(rounds):
        text += f", l{i} AS (SELECT coalesce(sum(rank), 0) AS l FROM r{i} WHERE id NOT IN (SELECT src FROM dg)), g{i} AS MATERIALIZED (SELECT e.dst AS id, sum(r.rank / dg.c) AS g FROM e JOIN r{i} r ON r.id = e.src JOIN dg ON dg.src = e.src GROUP BY e.dst), r{i + 1} AS MATERIALIZED (SELECT n.id, CAST(0.15 AS DOUBLE) / k + CAST(0.85 AS DOUBLE) * (coalesce(g, 0) + l / k) AS rank FROM n LEFT JOIN g{i} g ON g.id = n.id, k, l{i})"
    return text + f" SELECT id, round(rank, 9) AS rank FROM r{rounds}"


@query("pagerank", _pagerank_sql(20))
def _pagerank(spark, d):
    return _graph(spark, d).pagerank().select("id", F.round("rank", 9).alias("rank"))


@query("degree_counts", f"WITH {_E} SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY id")
def _degrees(spark, d):
    return _graph(spark, d).degrees()


_BOTH = f"{_E}, r AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


@query("jaccard_nodes", f"WITH {_BOTH}, c AS (SELECT src AS id, count(*) AS d FROM r GROUP BY src) SELECT x.src AS a, y.src AS b, round(count(*) / CAST(min(p.d) + min(q.d) - count(*) AS DOUBLE), 6) AS similarity FROM r x JOIN r y ON x.dst = y.dst AND x.src < y.src JOIN c p ON p.id = x.src JOIN c q ON q.id = y.src GROUP BY 1, 2")
def _jaccard(spark, d):
    return _graph(spark, d).jaccard().select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("adamic_adar", f"WITH {_E}, c AS (SELECT src AS n, count(*) AS d FROM e GROUP BY src HAVING count(*) > 1) SELECT x.src AS a, y.src AS b, round(sum(1 / ln(d)), 6) AS similarity FROM e x JOIN e y ON x.dst = y.dst AND x.src < y.src JOIN c ON c.n = x.dst GROUP BY 1, 2")
def _adamic(spark, d):
    return _graph(spark, d).adamic_adar().select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("pattern_two_hop", f"WITH {_E} SELECT a.src AS x, a.dst AS y, b.dst AS z FROM e a JOIN e b ON a.dst = b.src JOIN part p ON p.p_partkey = a.dst WHERE a.src <> b.dst AND p.p_brand = 'Brand#11'")
def _pattern(spark, d):
    return _graph(spark, d).match([{"name": "x"}, {"name": "y", "label": "Brand#11"}, {"name": "z"}], [{}, {}])


@query("cypher_match", f"WITH {_E} SELECT p.p_partkey AS a, q.p_type AS type FROM e JOIN part p ON e.src = p.p_partkey JOIN part q ON e.dst = q.p_partkey WHERE p.p_brand = 'Brand#11' ORDER BY 2 DESC, 1 LIMIT 50")
def _cypher(spark, d):
    return _graph(spark, d).cypher("MATCH (b)<-[:next]-(a) WHERE a.label = 'Brand#11' RETURN a.id AS a, b.type AS type ORDER BY type DESC, a LIMIT 50")


_PATH = f"WITH RECURSIVE {_E}, r(id, depth) AS (SELECT CAST({_START} AS BIGINT), 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 9), b AS (SELECT id, min(depth) AS depth FROM r GROUP BY id), up AS (SELECT e.dst AS id, min(e.src) AS parent FROM e JOIN b x ON x.id = e.src JOIN b y ON y.id = e.dst AND y.depth = x.depth + 1 GROUP BY 1), w(id, depth) AS (SELECT id, depth FROM b WHERE id = 17 UNION ALL SELECT parent, w.depth - 1 FROM w JOIN up ON up.id = w.id WHERE w.depth > 0) SELECT depth AS position, id AS _node_id, p_brand AS _node_label FROM w JOIN part ON p_partkey = id"


@query("shortest_path", _PATH)
def _shortest(spark, d):
    return _graph(spark, d).graph_table("shortest_path", start=_START, end=17)


@query("dfs")
def _dfs(spark, d):
    return _graph(spark, d).dfs(_START)


@query("louvain")
def _louvain(spark, d):
    return _graph(spark, d).louvain()


@query("node2vec")
def _node2vec(spark, d):
    return _graph(spark, d).node2vec()


@query("match_nodes", "SELECT p_partkey AS id FROM part WHERE (p_brand, p_type) = (SELECT (p_brand, p_type) FROM part WHERE p_partkey = 1)")
def _match_nodes(spark, d):
    one = T.load(spark, d, "part").filter("p_partkey = 1").first()
    return _graph(spark, d).match_nodes(one.p_brand, type=one.p_type).select("id")


@query("graph_changes", f"WITH {_E}, x AS (SELECT src, dst FROM e WHERE src <> 1 AND dst <> 1 UNION ALL SELECT 2, -1) SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM x UNION ALL SELECT dst, 0, 1 FROM x) GROUP BY id")
def _graph_changes(spark, d):
    """A node and its edges removed, a node and an edge added, saved and loaded again."""
    g = _graph(spark, d).remove_node(1)
    g = g.add_nodes(spark.range(1).select(F.lit(-1).cast("long").alias("id"))).add_edges(spark.sql("SELECT 2L AS src, -1L AS dst, 'next' AS label"))
    path = T.scratch(spark, "graph")
    g.save(path)
    return Graph.load(spark, path).degrees()


@query("cte_recursive_distinct", "WITH RECURSIVE t(n) AS (SELECT CAST(0 AS BIGINT) UNION SELECT (n * 3 + 1) % 40 FROM t) SELECT n FROM t")
def _recursive(spark, d):
    return recursive_union(spark.range(1).select(F.lit(0).cast("long").alias("n")), lambda new: new.select(((F.col("n") * 3 + 1) % 40).alias("n")))


# Changes


def _customers(spark, d, **kw) -> Table:
    return Table("customer", T.load(spark, d, "customer"), key=["c_custkey"], **kw)


@query("insert_select", "SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey + 10000000, s_name FROM supplier")
def _insert(spark, d):
    t = _customers(spark, d)
    t.insert(T.load(spark, d, "supplier").select((F.col("s_suppkey") + 10000000).alias("c_custkey"), F.col("s_name").alias("c_name")))
    return t.df.select("c_custkey", "c_name")


@query("update_where", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer")
def _update(spark, d):
    t = _customers(spark, d)
    t.update({"c_acctbal": "c_acctbal + 100"}, "c_mktsegment = 'BUILDING'")
    return t.df.select("c_custkey", "c_acctbal")


@query("delete_where", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0)")
def _delete(spark, d):
    t = _customers(spark, d)
    t.delete("c_acctbal < 0")
    return t.df.select("c_custkey")


@query("merge_upsert", "SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN k IS NOT NULL AND c_custkey IS NOT NULL THEN c_acctbal + v WHEN c_custkey IS NULL THEN v ELSE c_acctbal END AS c_acctbal FROM customer FULL JOIN (SELECT s_suppkey * 3 + 100 AS k, s_acctbal AS v FROM supplier) ON c_custkey = k")
def _merge(spark, d):
    t = _customers(spark, d)
    s = T.load(spark, d, "supplier").select((F.col("s_suppkey") * 3 + 100).alias("c_custkey"), F.col("s_acctbal").alias("v"))
    t.merge(s, ["c_custkey"], {"c_acctbal": "t.c_acctbal + s.v"}, insert={"c_custkey": "s.c_custkey", "c_acctbal": "s.v"})
    return t.df.select("c_custkey", "c_acctbal")


@query("merge_delete", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def _merge_delete(spark, d):
    t = _customers(spark, d)
    t.merge(T.load(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey")), ["c_custkey"], "delete")
    return t.df.select("c_custkey")


@query("fk_cascade", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def _cascade(spark, d):
    c = _customers(spark, d)
    o = Table("orders", T.load(spark, d, "orders"), key=["o_orderkey"], foreign=[ForeignKey(["o_custkey"], c, ["c_custkey"], on_delete="cascade")])
    c.delete("c_nationkey = 3")
    return o.df.select("o_orderkey")


@query("unique_violations", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def _unique(spark, d):
    return Table("lineitem", T.load(spark, d, "lineitem"), unique=[["l_orderkey"]]).violations(T.load(spark, d, "lineitem"))["unique l_orderkey"]


@query("check_violations", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity < 49)")
def _checks(spark, d):
    li = T.load(spark, d, "lineitem")
    return Table("lineitem", li, checks={"small": "l_quantity < 49"}).violations(li)["check small"].select("l_orderkey", "l_linenumber")


@query("rls_filter", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def _rls(spark, d):
    t = _customers(spark, d, rls=True, policies=[Policy("own", "c_mktsegment = current_user"), Policy("paid", "c_acctbal > 0", command="select")])
    return t.read("BUILDING").select("c_custkey")


@query("rls_with_check", "SELECT c_custkey FROM customer UNION ALL SELECT s_suppkey + 10000000 FROM supplier WHERE s_acctbal > 0")
def _rls_check(spark, d):
    t = _customers(spark, d, rls=True, policies=[Policy("paid", check="c_acctbal > 0", command="insert")])
    t.insert(T.load(spark, d, "supplier").select((F.col("s_suppkey") + 10000000).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal")), user="x")
    return t.df.select("c_custkey")


def _db(spark, d, *names, **more) -> Database:
    """A database with some of the tables; the others are views."""
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey", "documents": "doc_id", "embeddings": "vec_id"}
    T.register(spark, d, T.TABLES)
    db = Database(spark)
    for n in names:
        db.register(n, T.load(spark, d, n), key=[keys[n]], **more.get(n, {}))
    return db


@query("rls_injection", "SELECT u, CAST(count(c_custkey) AS BIGINT) AS n FROM (VALUES ('BUILDING'), ('x'' OR ''1''=''1'), ('current_user'), ('MACHINERY')) v(u) LEFT JOIN customer ON c_mktsegment = u GROUP BY u")
def _injection(spark, d):
    t = _customers(spark, d, rls=True, policies=[Policy("own", "c_mktsegment = current_user AND 'current_user' <> c_name")])
    out = None
    for u in ("BUILDING", "x' OR '1'='1", "current_user", "MACHINERY"):
        one = t.read(u).agg(F.lit(u).alias("u"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("rls_changes", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_nationkey = 3)")
def _rls_changes(spark, d):
    db = _db(spark, d, "customer")
    db.sql("CREATE POLICY own ON customer USING (c_mktsegment = current_user); ALTER TABLE customer ENABLE ROW LEVEL SECURITY")
    db.as_user("BUILDING").sql("UPDATE customer SET c_acctbal = c_acctbal + 1; DELETE FROM customer WHERE c_nationkey = 3")
    return db.as_user(None).sql("SELECT c_custkey, c_acctbal FROM customer")


@query("merge_conditional", "SELECT coalesce(c_custkey, s_suppkey) AS c_custkey, CASE WHEN c_custkey IS NULL THEN s_acctbal WHEN s_acctbal > 0 THEN c_acctbal + s_acctbal ELSE c_acctbal END AS c_acctbal FROM customer FULL JOIN (SELECT s_suppkey * 40 AS s_suppkey, s_acctbal FROM supplier) s ON c_custkey = s_suppkey")
def _merge_conditional(spark, d):
    db = _db(spark, d, "customer")
    db.sql("MERGE INTO customer AS c USING (SELECT s_suppkey * 40 AS k, s_acctbal AS v FROM supplier) AS s ON c.c_custkey = s.k WHEN MATCHED AND s.v > 0 THEN UPDATE SET c_acctbal = c.c_acctbal + s.v WHEN NOT MATCHED THEN INSERT (c_custkey, c_acctbal) VALUES (s.k, s.v)")
    return db.sql("SELECT c_custkey, c_acctbal FROM customer")


@query("merge_log", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN c_custkey IS NULL THEN 'insert' ELSE 'delete' END AS kind FROM customer RIGHT JOIN (SELECT s_suppkey * 40 AS k FROM supplier) s ON c_custkey = k) GROUP BY kind")
def _merge_log(spark, d):
    db = _db(spark, d, "customer")
    db.sql("MERGE INTO customer USING (SELECT s_suppkey * 40 AS k FROM supplier) s ON customer.c_custkey = s.k WHEN MATCHED THEN DELETE WHEN NOT MATCHED THEN INSERT (c_custkey) VALUES (s.k)")
    return db.tables["customer"].change_log().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("fk_set_null", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def _set_null(spark, d):
    db = _db(spark, d, "customer")
    db.register("orders", T.load(spark, d, "orders"), key=["o_orderkey"], foreign=[ForeignKey(["o_custkey"], db.tables["customer"], ["c_custkey"], on_delete="set null")])
    db.sql("DELETE FROM customer WHERE c_nationkey = 3")
    return db.sql("SELECT o_orderkey, o_custkey FROM orders")


def _chain(spark, d, **act) -> Database:
    """nation, customer and orders, each referring to the one before."""
    db = _db(spark, d, "nation")
    db.register("customer", T.load(spark, d, "customer"), key=["c_custkey"], foreign=[ForeignKey(["c_nationkey"], db.tables["nation"], ["n_nationkey"], **act)])
    db.register("orders", T.load(spark, d, "orders"), key=["o_orderkey"], foreign=[ForeignKey(["o_custkey"], db.tables["customer"], ["c_custkey"], **act)])
    return db


@query("fk_cascade_deep", "SELECT 'orders' AS t, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1 UNION ALL SELECT 'logged', count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def _cascade_deep(spark, d):
    db = _chain(spark, d, on_delete="cascade")
    db.sql("DELETE FROM nation WHERE n_regionkey = 1")
    logged = db.tables["orders"].change_log().filter("kind = 'delete'").agg(F.lit("logged").alias("t"), F.count(F.lit(1)).alias("n"))
    return db.sql("SELECT 'orders' AS t, count(*) AS n FROM orders").unionByName(logged)


@query("fk_update_cascade", "SELECT c_custkey, CASE WHEN n_regionkey = 1 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _update_cascade(spark, d):
    db = _chain(spark, d, on_update="cascade")
    db.sql("UPDATE nation SET n_nationkey = n_nationkey + 100 WHERE n_regionkey = 1")
    return db.sql("SELECT c_custkey, c_nationkey FROM customer")


@query("fk_restrict", "SELECT 'refused' AS outcome, count(*) AS n FROM customer")
def _restrict(spark, d):
    db, outcome = _chain(spark, d), "accepted"
    try:
        db.sql("DELETE FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
    except ConstraintError:
        outcome = "refused"
    return db.sql(f"SELECT '{outcome}' AS outcome, count(*) AS n FROM customer")


@query("rollback", "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer")
def _rollback(spark, d):
    db = _db(spark, d, "customer")
    db.sql("BEGIN; UPDATE customer SET c_acctbal = 0; DELETE FROM customer WHERE c_nationkey = 3; ROLLBACK")
    return db.sql("SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer")


@query("triggers", "SELECT 'after update' AS what, count(*) AS n FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'before delete', count(*) FROM customer WHERE c_nationkey = 4")
def _triggers(spark, d):
    seen = []
    note = lambda what: lambda t, rows: seen.append(rows.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n")))
    db = _db(spark, d, "customer", customer={"triggers": {("after", "update"): [note("after update")], ("before", "delete"): [note("before delete")]}})
    db.sql("UPDATE customer SET c_acctbal = 0 WHERE c_nationkey = 3; DELETE FROM customer WHERE c_nationkey = 4")
    return seen[0].unionByName(seen[1])


@query("on_conflict_nothing", "SELECT c_custkey, c_name FROM customer UNION ALL SELECT -1, 'new'")
def _conflict_nothing(spark, d):
    db = _db(spark, d, "customer")
    db.sql("INSERT INTO customer (c_custkey, c_name) VALUES (1, 'other'), (-1, 'new'), (-1, 'new') ON CONFLICT (c_custkey) DO NOTHING")
    return db.sql("SELECT c_custkey, c_name FROM customer")


@query("on_conflict_update", "SELECT c_custkey, CASE WHEN c_custkey = 1 THEN c_acctbal + 5 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -1, 7")
def _conflict_update(spark, d):
    db = _db(spark, d, "customer")
    db.sql("INSERT INTO customer (c_custkey, c_acctbal) VALUES (1, 5), (-1, 7) ON CONFLICT (c_custkey) DO UPDATE SET c_acctbal = c_acctbal + excluded.c_acctbal")
    return db.sql("SELECT c_custkey, c_acctbal FROM customer")


@query("returning", "SELECT c_custkey, c_acctbal * 2 AS twice FROM customer WHERE c_nationkey = 5 UNION ALL SELECT -1, 20")
def _returning(spark, d):
    db = _db(spark, d, "customer")
    a = db.sql("INSERT INTO customer (c_custkey, c_acctbal) VALUES (-1, 10) RETURNING c_custkey, c_acctbal * 2 AS twice")
    return a.unionByName(db.sql("DELETE FROM customer WHERE c_nationkey = 5 RETURNING c_custkey, c_acctbal * 2 AS twice"))


@query("change_by_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def _change_by_subquery(spark, d):
    db = _db(spark, d, "customer")
    db.sql("DELETE FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
    return db.sql("SELECT c_custkey FROM customer")


@query("create_table", "SELECT 101 AS id, 'none' AS name, 1.5 AS v, CAST(NULL AS VARCHAR) AS note UNION ALL SELECT 102, 'b', 2.5, NULL UNION ALL SELECT 100, 'a', 0.5, NULL".replace("1.5", "CAST(1.5 AS DOUBLE)").replace("2.5", "CAST(2.5 AS DOUBLE)").replace("0.5", "CAST(0.5 AS DOUBLE)"))
def _create_table(spark, d):
    db = Database(spark)
    db.sql("CREATE TABLE things (id SERIAL PRIMARY KEY, name TEXT DEFAULT 'none', v DOUBLE NOT NULL CHECK (v > 0)); INSERT INTO things VALUES (100, 'a', 0.5); INSERT INTO things (v) VALUES (1.5)")
    db.sql("INSERT INTO things (name, v) VALUES ('b', 2.5); ALTER TABLE things ADD COLUMN note TEXT")
    return db.sql("SELECT id, name, v, note FROM things")


@query("constraints_refuse", "SELECT * FROM (VALUES ('key'), ('not null'), ('check'), ('foreign'), ('unique')) v(kind)")
def _constraints(spark, d):
    db, out = Database(spark), []
    db.sql("CREATE TABLE a (id INT PRIMARY KEY, n INT NOT NULL, c INT CHECK (c < 10), u INT UNIQUE); CREATE TABLE b (id INT PRIMARY KEY, a INT REFERENCES a (id)); INSERT INTO a VALUES (1, 1, 1, 1)")
    for kind, text in {"key": "INSERT INTO a VALUES (1, 1, 1, 2)", "not null": "INSERT INTO a (id) VALUES (2)", "check": "INSERT INTO a VALUES (2, 1, 10, 3)", "foreign": "INSERT INTO b VALUES (1, 5)", "unique": "INSERT INTO a VALUES (3, 1, 1, 1)"}.items():
        try:
            db.sql(text)
        except ConstraintError:
            out.append((kind,))
    return spark.createDataFrame(out, "kind string")


@query("import_export_sql", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _import_export(spark, d):
    path = T.scratch(spark, "export")
    db = _db(spark, d)
    db.register("source", T.load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"))
    db.sql(f"CREATE TABLE copy (c_custkey BIGINT, c_name TEXT, c_acctbal DOUBLE); EXPORT TO '{path}' FROM source FORMAT csv DELIMITER ';' HEADER true; IMPORT FROM '{path}' INTO copy FORMAT csv DELIMITER ';' HEADER true")
    return db.sql("SELECT * FROM copy")


@query("settings_sql", "SELECT 'acme' AS tenant, 2 AS n, 1 AS first, 2 AS second, 2 AS now_at")
def _settings(spark, d):
    db = Database(spark)
    db.sql("SET app.tenant = 'acme'")
    a = db.sql("SELECT nextval('s') AS first")
    return a.crossJoin(db.sql("SELECT current_setting('app.tenant') AS tenant, vector_dims(array(1D, 2D)) AS n, nextval('s') AS second")).crossJoin(db.sql("SELECT currval('s') AS now_at"))  # rows of one


@query("graph_table_sql", f"WITH RECURSIVE {_E}, r(id, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 2) SELECT id AS _node_id, min(depth) AS depth, p_brand AS label FROM r JOIN part ON p_partkey = id GROUP BY id, p_brand")
def _graph_table_sql(spark, d):
    db, g = Database(spark), _graph(spark, d)
    db.register("parts_nodes", g.nodes.select("id", F.col("label").alias("node_label"), F.to_json("properties").alias("properties")))
    db.register("parts_edges", g.edges.select(F.col("src").alias("source_id"), F.col("dst").alias("dest_id"), F.col("label").alias("edge_label"), "weight"))
    return db.sql("CREATE GRAPH parts; SELECT _node_id, depth, label FROM GRAPH_TABLE(parts MATCH (a)-[:next]->(b) ALGORITHM bfs START 1 MAXDEPTH 2 COLUMNS (_node_id, depth, _node_label AS label))")


@query("hybrid_search_sql", _fused_sql(20, 20, 1, 1).replace("doc_id, round", "CAST(doc_id AS VARCHAR) AS doc_id, round", 1).replace("ORDER BY sum(s) DESC, doc_id LIMIT 20", "ORDER BY sum(s) DESC, fused.doc_id LIMIT 20").replace(") GROUP BY doc_id ORDER BY sum(s)", ") fused GROUP BY fused.doc_id ORDER BY sum(s)"))
def _hybrid_sql_query(spark, d):
    db = Database(spark)
    e = _emb(spark, d).select(F.col("vec_id").alias("doc_id"), "embedding")
    db.register("both", _docs(spark, d).join(e, "doc_id", "full").select("doc_id", "text", "embedding"), key=["doc_id"])
    db.indexes["t"] = ("both", "text", "fts", _index(spark, d))
    db.sql("CREATE INDEX v ON both (embedding) USING hnsw")
    q = json.dumps(_first(spark, d))
    return db.sql(f"SELECT h.id AS doc_id, round(h.score, 8) AS score FROM (SELECT explode(from_json(hybrid_search('both', 'embedding', 'text', 'license', '{q}', 20), 'array<struct<id:string,score:double>>')) AS h)")


@query("explain_sql")
def _explain(spark, d):
    return _db(spark, d, "customer").sql("EXPLAIN SELECT c_custkey FROM customer WHERE c_acctbal > 0")


@query("show_tables", "SELECT 'customer' AS name UNION ALL SELECT 'nation'")
def _show_tables(spark, d):
    return _db(spark, d, "customer", "nation").sql("SHOW TABLES")


@query("auto_increment", "SELECT count(*) AS n, count(DISTINCT id) AS ids, min(id) AS lo, max(id) AS hi FROM (SELECT row_number() OVER () + 100 AS id FROM nation)")
def _serial(spark, d):
    n = number_rows(T.load(spark, d, "nation").select(F.lit(None).cast("long").alias("id"), "n_name"), "id", 100)
    return n.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("lo"), F.max("id").alias("hi"))


@query("cdc_log", "SELECT kind, count(*) AS n FROM (SELECT 'update' AS kind FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'delete' FROM nation WHERE n_regionkey = 2) GROUP BY kind")
def _cdc(spark, d):
    t = Table("nation", T.load(spark, d, "nation"))
    t.update({"n_name": "upper(n_name)"}, "n_regionkey = 1")
    t.delete("n_regionkey = 2")
    return t.change_log().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# Files, views, functions, streams


def _roundtrip(format: str):
    def run(spark, d):
        src = T.load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
        path = T.scratch(spark, format)
        T.export_file(src, path, format)
        return T.import_file(spark, path, format, schema=src.schema)

    return run


for _f in ("csv", "json", "ndjson", "parquet", "orc"):
    query(f"{_f}_roundtrip", "SELECT c_custkey, c_name, c_acctbal FROM customer")(_roundtrip(_f))


@query("view_query", "SELECT c_custkey, c_acctbal * 2 AS twice FROM customer WHERE c_acctbal > 5000")
def _view(spark, d):
    T.load(spark, d, "customer").filter("c_acctbal > 5000").createOrReplaceTempView("rich")
    return spark.sql("SELECT c_custkey, c_acctbal * 2 AS twice FROM rich")


@query("sql_udf", "SELECT p_partkey, p_retailprice * 1.2 + 1 AS gross FROM part".replace("1.2", "CAST(1.2 AS DOUBLE)"))
def _udf(spark, d):
    T.register(spark, d, ["part"])
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION gross(x DOUBLE) RETURNS DOUBLE RETURN x * 1.2D + 1")
    return spark.sql("SELECT p_partkey, gross(p_retailprice) AS gross FROM part")


@query("show_columns", "SELECT 'c_custkey' AS name UNION ALL SELECT 'c_name' UNION ALL SELECT 'c_nationkey' UNION ALL SELECT 'c_acctbal' UNION ALL SELECT 'c_mktsegment'")
def _columns(spark, d):
    T.register(spark, d, ["customer"])
    return spark.sql("DESCRIBE TABLE customer").select(F.col("col_name").alias("name"))


@query("tumbling_window", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def _tumbling(spark, d):
    return streams.tumbling(T.load(spark, d, "events")).withColumn("total", F.round("total", 3))


@query("session_window", 'WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minute THEN 0 ELSE 1 END AS s FROM events), y AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 minute AS "end", count(*) AS n FROM y GROUP BY user_id, g')
def _sessions(spark, d):
    return streams.sessions(T.load(spark, d, "events"))


@query("sliding_window", "WITH x AS (SELECT unnest([time_bucket(INTERVAL 30 minute, ts), time_bucket(INTERVAL 30 minute, ts) - INTERVAL 30 minute]) AS start, event_type, value FROM events) SELECT start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM x GROUP BY 1, 2")
def _sliding(spark, d):
    return streams.tumbling(T.load(spark, d, "events"), "1 hour", slide="30 minutes").withColumn("total", F.round("total", 3))


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def _stream_windows(spark, d):
    """The events as a stream: all there are, then an end."""
    path = T.scratch(spark, "windows")
    events = streams.read_stream(spark, f"{d}/events.parquet", T.load(spark, d, "events").schema)
    streams.run_to_end(streams.tumbling(events, late="1 hour"), path)
    return spark.read.parquet(path).withColumn("total", F.round("total", 3))


@query("subscribe", "SELECT 'update' AS kind, count(*) AS n FROM nation WHERE n_regionkey = 1")
def _subscribe(spark, d):
    """Change rows of two tables in a folder; the subscriber of one sees its own."""
    log, got = T.scratch(spark, "log"), T.scratch(spark, "got")
    db = _db(spark, d, "nation", "region")
    db.sql("UPDATE nation SET n_name = upper(n_name) WHERE n_regionkey = 1; DELETE FROM region WHERE r_regionkey = 2")
    for t in ("nation", "region"):
        streams.write_changes(db.tables[t].change_log(), log)
    changes = streams.read_stream(spark, log, db.tables["nation"].change_log().schema)
    streams.subscribe(changes, "nation", lambda rows, _: rows.write.mode("append").parquet(got), T.scratch(spark, "subscriber")).awaitTermination()
    return spark.read.parquet(got).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict:
    return dict(_Q)


def oracles() -> dict:
    return dict(_SQL)
