"""Column functions: vectors, JSON, strings, arithmetic.  All are built-in expressions, without Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vector(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _zip(a, b, f) -> Column:
    return F.zip_with(_c(a).cast("array<double>"), _c(b).cast("array<double>"), f)


def inner_product(a, b) -> Column:
    return _sum(_zip(a, b, lambda x, y: x * y))


def l2_distance(a, b) -> Column:
    return F.sqrt(_sum(_zip(a, b, lambda x, y: (x - y) * (x - y))))


def l1_distance(a, b) -> Column:
    return _sum(_zip(a, b, lambda x, y: F.abs(x - y)))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_c(a).cast("array<double>"), lambda x: x * x)))


def cosine_distance(a, b) -> Column:
    """1 where either norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - inner_product(a, b) / n)


DISTANCES = {"cosine": cosine_distance, "euclidean": l2_distance, "l2": l2_distance, "manhattan": l1_distance, "l1": l1_distance, "dot": lambda a, b: -inner_product(a, b)}


def normalize(a) -> Column:
    return F.transform(_c(a).cast("array<double>"), lambda x: F.try_divide(x, norm(a)))


def vector_add(a, b) -> Column:
    return _zip(a, b, lambda x, y: x + y)


def vector_scale(a, by: float) -> Column:
    return F.transform(_c(a).cast("array<double>"), lambda x: x * by)


def quantize(a, low: Column, high: Column, bits: int = 8) -> Column:
    """Codes from 0 to 2^bits - 1, each dimension between its own low and high."""
    top = float((1 << bits) - 1)
    placed = F.arrays_zip(_c(a).cast("array<double>").alias("v"), low.alias("l"), high.alias("h"))
    return F.transform(placed, lambda s: F.when(s["h"] > s["l"], F.floor(F.least(F.greatest((s["v"] - s["l"]) / (s["h"] - s["l"]), F.lit(0.0)), F.lit(1.0)) * top + 0.5)).otherwise(F.lit(0)).cast("int"))


def dequantize(codes: Column, low: Column, high: Column, bits: int = 8) -> Column:
    placed = F.arrays_zip(codes.alias("c"), low.alias("l"), high.alias("h"))
    return F.transform(placed, lambda s: s["l"] + s["c"] * (s["h"] - s["l"]) / float((1 << bits) - 1))


def binarize(a) -> Column:
    """A string of bits: 1 where the value is at least 0."""
    return F.array_join(F.transform(_c(a), lambda x: F.when(x >= 0, F.lit("1")).otherwise(F.lit("0"))), "")


def hamming(a, b) -> Column:
    return F.aggregate(F.zip_with(F.split(_c(a), ""), F.split(_c(b), ""), lambda x, y: (x != y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def compression_ratio(kind: str, dims: int = 0, parts: int = 1) -> float:
    return {"8bit": 4.0, "4bit": 8.0, "binary": 32.0}.get(kind) or 4.0 * dims / parts


# JSON.  A document is a string; a missing key is null.


def json_path(j, *keys: str) -> Column:
    return F.get_json_object(_c(j), "$" + "".join(f"['{k}']" for k in keys))


def json_map(j) -> Column:
    return F.from_json(_c(j), "map<string,string>")


def json_contains(j, part) -> Column:
    """Whether an object holds all entries of another (shallow)."""
    a, b = json_map(j), json_map(part)
    return F.forall(F.map_entries(b), lambda e: F.coalesce(F.try_element_at(a, e.key) == e.value, F.lit(False)))


def json_has_key(j, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(_c(j)), key), F.lit(False))


def json_has_any(j, keys: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.json_object_keys(_c(j)), F.array(*map(F.lit, keys))), F.lit(False))


def json_has_all(j, keys: list[str]) -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, keys)), F.json_object_keys(_c(j)))) == 0, F.lit(False))


# Scalars


def substr0(s, start: int, length: int | None = None) -> Column:
    """From 0; beyond the end is empty."""
    return F.substring(_c(s), start + 1, length if length is not None else 2147483647)


def safe_divide(a, b) -> Column:
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def safe_mod(a, b) -> Column:
    return F.try_mod(_c(a), _c(b))


def to_int(x) -> Column:
    return _c(x).try_cast("bigint")


def now_text() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def strftime(format: str, value) -> Column:
    """%s (epoch seconds) and the usual date letters."""
    if format == "%s":
        return F.unix_timestamp(_c(value)).cast("string")
    for a, b in {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "T": "'T'", "Z": "'Z'"}.items():
        format = format.replace(a, b)
    return F.date_format(_c(value), format)


def snowflake_id(node: int = 0, base_ms: int | None = None) -> Column:
    """Milliseconds (41 bits), node (10) and a number (12), distinct over all rows of a query.

    The rows of partition p take the milliseconds from now + p * 2^18 on, and 4096 numbers of each, so that no two of
    2^30 rows a partition meet.  Ids of two queries of one node meet only if their spans of milliseconds do.
    """
    at = F.monotonically_increasing_id()
    part, row = F.shiftright(at, 33), at.bitwiseAND(F.lit((1 << 33) - 1))
    now = F.lit(base_ms) if base_ms is not None else F.unix_millis(F.current_timestamp())
    ms = now + F.shiftleft(part, 18) + F.shiftright(row, 12)
    return F.shiftleft(ms, 22).bitwiseOR(F.lit((node & 1023) << 12)).bitwiseOR(row.bitwiseAND(F.lit(4095)))


# Text


# Results depend on these words and suffixes.
STOP = """
    a an the is it in on at to for of with by from as into through during before after above below between out off
    over under again further then once here there when where why how all each every both few more most other some such no
    nor not only own same so than too very can will just don should now
    и в на за от да се е са по не че с към но или ако при до
""".split()
STOP_BY_LANGUAGE = {
    "en": """
        a an the is it in on at to for of with by from as into through during and or not but if then else when be was were
        been being have has had do does did will would could should may this that these those i you he she we they
    """.split(),
    "bg": """
        и в на за от да се е са по не че с към но или ако при до как какво кой коя кое кои този тази това тези със между
        след преди без още вече само може трябва има няма
    """.split(),
    "de": "der die das ein eine und oder aber nicht ist sind war hat haben werden wird kann mit von für auf in an zu bei nach über unter vor zwischen durch gegen ohne".split(),
    "fr": "le la les un une des et ou mais pas est sont était a ont sera peut avec de du pour sur dans par entre sous chez je tu il elle nous vous ils elles".split(),
    "ru": "и в на не что он я с а как это по но они мы за от из у к бы ты его её их мой твой наш ваш свой который этот тот такой каждый".split(),
}
#: Of each language, suffixes in the order in which they are tried.
SUFFIXES = {
    "en": "ing tion ness ment able ies es ed ly s".split(),
    "bg": "ища ище ция ние ост ски ство на та".split(),
    "de": "ung heit keit lich isch chen schaft en er es".split(),
    "fr": "ement ment tion eur euse ique esse eux er es".split(),
    "ru": "ость ение ание тель ский ция ние ать ить ыть".split(),
}
# End of the fixed values.


def tokens(text) -> Column:
    """Lower-cased runs of letters, _ and -; of 2 to 64 bytes; without stop words."""
    stop = F.array(*map(F.lit, STOP))
    return F.filter(F.regexp_extract_all(F.lower(_c(text)), F.lit(r"([\p{L}_-]+)"), 1), lambda t: F.octet_length(t).between(2, 64) & ~F.array_contains(stop, t))


def _stripped(t, suffixes: list[str]) -> Column:
    """The first fitting suffix off; words of three bytes stay, and so do short words before the shortest suffixes."""
    t, out = _c(t), F.when(F.octet_length(_c(t)) <= 3, _c(t))
    for s in suffixes:
        fits = t.endswith(s)
        if s in ("es", "ed", "ly"):
            fits = fits & (F.octet_length(t) > 4)
        if s == "s":
            fits = fits & ~t.endswith("ss")
        cut = F.substring(t, F.lit(1), F.length(t) - len(s))
        out = out.when(fits, F.concat(cut, F.lit("y")) if s == "ies" else cut)
    return out.otherwise(t)


def simple_stem(t) -> Column:
    """English suffixes, with -ible beside -able."""
    own = SUFFIXES["en"]
    return _stripped(t, [*own[:5], "ible", *own[5:]])


def stem(t, lang: str = "en") -> Column:
    """Languages without a list of suffixes use English's.  Outside English no suffix asks for a longer word."""
    if lang in ("en",) or lang not in SUFFIXES:
        return _stripped(t, SUFFIXES["en"])
    out = F.when(F.octet_length(_c(t)) <= 3, _c(t))
    for s in SUFFIXES[lang]:
        out = out.when(_c(t).endswith(s), F.substring(_c(t), F.lit(1), F.length(_c(t)) - len(s)))
    return out.otherwise(_c(t))


def language_tokens(text, lang: str = "en") -> Column:
    """Lower-cased runs of letters, digits, _ and -, stemmed, of two bytes or more, without the language's stop words."""
    stop = F.array(*map(F.lit, STOP_BY_LANGUAGE.get(lang, STOP_BY_LANGUAGE["en"])))
    words = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"([\p{L}\p{Nd}_-]+)"), 1)
    return F.filter(F.transform(words, lambda w: stem(w, lang)), lambda t: (F.octet_length(t) >= 2) & ~F.array_contains(stop, t))


def detect_language(text) -> Column:
    """ru where Cyrillic letters outnumber Latin ones, else en."""
    return F.when(F.regexp_count(_c(text), F.lit(r"\p{IsCyrillic}")) > F.regexp_count(_c(text), F.lit("[A-Za-z]")), F.lit("ru")).otherwise(F.lit("en"))


def chunk_paragraphs(text) -> Column:
    return F.filter(F.transform(F.split(_c(text), "\n\n"), lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: F.length(p) > 0)


def chunk_sentences(text) -> Column:
    return F.filter(F.transform(F.split(_c(text), "(?<=[.?!]) "), lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: F.length(p) > 0)
