"""Text chunks by size: fixed with overlap, and recursive.  Sizes are characters.  Order within a text is serial, so Arrow batches run it."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BREAKS = (". ", "? ", "! ", "\n\n", "\n", " ")


def fixed(text: str, size: int = 1024, overlap: int = 128) -> list[str]:
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        nxt = end - overlap if end < len(text) else end
        if end < len(text):
            for b in _BREAKS:
                k = text.rfind(b, at, end)
                if k - at > size // 4:
                    end = nxt = k + len(b)
                    break
        out.append(text[at:end].strip())
        at = max(nxt, at + 1)
    return [x for x in out if x]


def recursive(text: str, size: int = 1024, overlap: int = 128, least: int = 64) -> list[str]:
    """Paragraphs; longer ones by sentences; longer ones by size.  Pieces under `least` go, unless the text is one."""
    out = []
    for p in (x.strip() for x in text.split("\n\n")):
        if len(p) <= size:
            out.append(p)
            continue
        held = ""
        for s in re.split(r"(?<=[.?!]) ", p):
            if held and len(held) + 1 + len(s) > size:
                out.append(held)
                held = ""
            if len(s) > size:
                out += fixed(s, size, overlap)
            else:
                held = f"{held} {s}" if held else s
        out.append(held)
    kept = [x for x in out if len(x) >= least]
    return kept or [x for x in out if x][:1]


def split_text(text: str, strategy: str = "recursive", size: int = 1024, overlap: int = 128, least: int = 64) -> list[str]:
    """The chunks of one text: paragraph, sentence, fixed or recursive (which drops pieces under `least` characters, unless the text is one)."""
    if strategy == "paragraph":
        return [p for p in (x.strip(" \t\r\n") for x in text.split("\n\n")) if p]
    if strategy == "sentence":
        return [p for p in (x.strip(" \t\r\n") for x in re.split(r"(?<=[.?!]) ", text)) if p]
    return fixed(text, size, overlap) if strategy == "fixed" else recursive(text, size, overlap, least)


def chunk(df: DataFrame, key: str = "doc_id", text: str = "text", strategy: str = "recursive", size: int = 1024, overlap: int = 128, least: int = 64) -> DataFrame:
    """key, index, chunk and size of each chunk of each text; null and blank texts have none."""
    kind = df.schema[key].dataType.simpleString()
    if strategy not in ("paragraph", "sentence", "fixed", "recursive"):
        raise ValueError(f"no strategy {strategy}")

    def run(batches):
        for b in batches:
            rows = [(k, i, c, len(c)) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, c in enumerate(split_text(t or "", strategy, size, overlap, least))]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32())], names=[key, "index", "chunk", "size"])

    return df.select(key, F.col(text)).mapInArrow(run, f"{key} {kind}, index int, chunk string, size int")
