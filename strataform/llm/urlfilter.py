"""URL filters: glob rules as one bit-parallel wildcard automaton over canonical URLs.

Each rule of k symbols other than ``*`` takes k + 1 bits in a row of 64-bit words.  Bit j says that j
symbols are matched.  A byte moves every bit one place on where the symbol allows that byte; a ``*`` after
j symbols keeps bit j for any byte.  ``?`` stands for any one byte.  All rules advance at once, for a
batch of URLs at once.

Cases: a null url, or one without ``://``, has empty host and path and matches nothing (allow).
Repeated rows each get their row; urls of any length run whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (action, host, path): a rule fits the host and its subdomains, where the path starts with the rule's.
BASE_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: (action, glob over the canonical URL).  An allow glob that fits outweighs block globs.
GLOBS = [
    ("block", "*://spam-*"), ("block", "*://*.spam-*"), ("block", "*://cheap-*"), ("block", "*://*.cheap-*"),
    ("block", "*://free-*"), ("block", "*://*.free-*"), ("block", "*://ads-*"), ("block", "*://*.ads-*"), ("block", "*://ads.*"), ("block", "*://*.ads.*"),
    ("block", "*://*casino*/*"), ("block", "*://*-pills.*"), ("block", "*://*-bets.*"), ("block", "*.exe"), ("block", "*/adserver/*"),
    ("allow", "*://*/robots.txt"), ("allow", "*://*.edu/*"),
]


class GlobAutomaton:
    """Shift-And masks of many globs, each anchored at both ends."""

    def __init__(self, globs: list[str]):
        bits, start, loop, accept = 0, [], [], []
        table: list[tuple[int, int]] = []  # (bit, byte), byte -1 for any
        for g in globs:
            start.append(bits)
            at = bits
            for b in g.encode():
                if b == 0x2A:
                    loop.append(at)
                else:
                    at += 1
                    table.append((at, -1 if b == 0x3F else b))
            accept.append(at)
            bits = at + 1
        self.words = max(1, -(-bits // 64))
        self.start, self.loop = self._mask(start), self._mask(loop)
        self.accept = np.array(accept, dtype=np.int64)
        self.moves = np.zeros((256, self.words), dtype=np.uint64)
        for bit, byte in table:
            rows = slice(None) if byte < 0 else byte
            self.moves[rows, bit // 64] |= np.uint64(1 << (bit % 64))

    def _mask(self, bits: list[int]) -> np.ndarray:
        m = np.zeros(self.words, dtype=np.uint64)
        for b in bits:
            m[b // 64] |= np.uint64(1 << (b % 64))
        return m

    def match(self, urls: list[bytes]) -> np.ndarray:
        """A boolean row for each url, a column for each glob.  URLs run longest first, so those still running are a prefix."""
        n = len(urls)
        out = np.zeros((n, len(self.accept)), dtype=bool)
        if not n or not len(self.accept):
            return out
        sizes = np.array([len(u) for u in urls])
        order = np.argsort(-sizes, kind="stable")
        state = np.repeat(self.start[None, :], n, axis=0)
        joined = np.frombuffer(b"".join(urls[i] for i in order), dtype=np.uint8)
        sizes = sizes[order]
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        one, top = np.uint64(1), np.uint64(63)
        for t in range(int(sizes[0])):
            k = int(np.searchsorted(-sizes, -t, side="left"))  # those longer than t
            s = state[:k]
            moved = s << one
            moved[:, 1:] |= s[:, :-1] >> top
            state[:k] = (moved & self.moves[joined[begins[:k] + t]]) | (s & self.loop)
        out[order] = (state[:, self.accept // 64] >> (self.accept % 64).astype(np.uint64) & one).astype(bool)
        return out


def url_host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))
    return F.coalesce(F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def base_rule(host: Column, path: Column, rules=BASE_RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host and path together) and its action, null where none fits."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones, longer, outweigh
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def url_filter(pages: DataFrame, globs=GLOBS, rules=BASE_RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, glob (those that fit, joined by spaces) of each row.  No shuffle."""
    d = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url"))
    d = d.select("page_id", "_url", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"))
    scheme = F.lower(F.substring_index("_url", "://", 1))
    after = F.expr("substring(_url, instr(_url, '://') + 3 + length(host))")
    canonical = F.when(F.instr("_url", "://") > 0, F.concat(scheme, F.lit("://"), "host", F.substring_index(after, "#", 1)))
    rule, action = base_rule(F.col("host"), F.col("path"), rules)
    d = d.select("page_id", "host", "path", rule.alias("rule"), action.alias("_action"), canonical.alias("_canonical"))
    acts, patterns = [a for a, _ in globs], [g for _, g in globs]

    def judge(batches):
        automaton = GlobAutomaton(patterns)
        block = np.array([a == "block" for a in acts], dtype=bool)
        for b in batches:
            urls = b.column(b.schema.get_field_index("_canonical")).to_pylist()
            hit = automaton.match([(u or "").encode() for u in urls])
            hit[[i for i, u in enumerate(urls) if u is None]] = False
            blocked = hit[:, block].any(axis=1) & ~hit[:, ~block].any(axis=1)
            fits = [" ".join(patterns[j] for j in np.flatnonzero(r)) or None for r in hit]
            own = b.column(b.schema.get_field_index("_action")).to_pylist()
            verdict = [a or ("block" if x else "allow") for a, x in zip(own, blocked)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(verdict, pa.string()), pa.array(fits, pa.string())], names=["page_id", "host", "path", "rule", "verdict", "glob"])

    kind = d.schema["page_id"].dataType.simpleString()
    return d.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string, glob string")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("glob")


def _oracle() -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    by_length = sorted(BASE_RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in by_length)
    act = " ".join(f"WHEN {fits(h, p)} THEN '{a}'" for a, h, p in by_length)
    some = lambda kind: " OR ".join(f"(canonical GLOB '{g}')" for a, g in GLOBS if a == kind)
    return f"""
WITH a AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, url, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM a),
c AS (SELECT page_id, coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path,
  lower(split_part(url, '://', 1)) || '://' || translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || split_part(substr(rest, length(raw) + 1), '#', 1) AS canonical FROM b)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {act} WHEN coalesce({some('block')}, false) AND NOT coalesce({some('allow')}, false) THEN 'block' ELSE 'allow' END AS verdict
FROM c"""


ORACLE = _oracle()
