"""Language identification: script ranges, per-word scores, and Viterbi over the words of a text.

A word is a run of letters and their marks, lower-cased; runs of more than 40 are words of 40 letters each, so that text
without spaces is read whole and weighs by its length.  Its script (by its first letter's range) narrows the languages
to those that were learned with that script.  Its score for a language is the sum of log probabilities of
its character n-grams (one to four, with edges), clipped so that no single word decides.  Viterbi with a
penalty for each switch labels every word; runs of one label are spans.  A text's language is that of most
of its words; the score is that share.

The model is fitted on about TRAIN_DOCS documents, on TRAIN_WORDS words of each (every n-th of the whole text), and a word
counts COUNT_CAP times at most in its n-grams' counts: these bound the fit, and nothing of what is labelled.

Cases: null text or text without a letter is ``und`` with score 0 and no spans.  Words of scripts that
were never learned carry no evidence (every language, score 0).  A text of such words alone gets the most
frequent learned language, score 0.  Ties go to the language that sorts first.  With nothing to learn from,
every text is ``und``.  Numerals such as a superscript or a Roman numeral sign are no letters.  Repeated rows keep a row each; texts of any length are labelled whole.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import extended, fresh, held_out, lean, materialize, sampled, slices

#: Documents that the model is fitted on, at most about this many.
TRAIN_DOCS = 2000
#: Words of each that the model is fitted on, spread over the text.
TRAIN_WORDS = 200
SWITCH = 8.0
CLIP = 6.0
#: Occurrences of one word in the training texts of a language that count, at most.
COUNT_CAP = 20
#: Letters of a word; a longer run is several words.
WORD_LETTERS = 40
CACHE = 400_000


def _runs_of(kinds: str) -> str:
    """A character class of all characters of some general categories."""
    out, begin = "", None
    for c in range(0x110001):
        own = c < 0x110000 and unicodedata.category(chr(c))[0] in kinds
        if own and begin is None:
            begin = c
        elif not own and begin is not None:
            out += f"\\U{begin:08x}-\\U{c - 1:08x}"
            begin = None
    return out


LETTERS = re.compile(f"[{_runs_of('L')}][{_runs_of('LM')}]*")
#: Where a text has none of these, SIMPLE finds the same words, faster: no marks, and no numerals that count as word characters.
ODD = re.compile("[^\\x00-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u02ff\\u0370-\\u0482\\u048a-\\u0590\\u2010-\\u2027\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fff\\uac00-\\ud7a3]")
SIMPLE = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    low = text.lower() if text else ""
    words = (LETTERS if ODD.search(low) else SIMPLE).findall(low)
    if words and max(map(len, words)) > WORD_LETTERS:
        words = [w[i : i + WORD_LETTERS] for w in words for i in range(0, len(w), WORD_LETTERS)]
    return words


_RANGES = [
    (0x41, "latin"), (0x250, "ipa"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "syriac"), (0x750, "arabic"), (0x780, "other"), (0x8A0, "arabic"),
    (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"), (0xA80, "gujarati"), (0xB00, "oriya"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"), (0xD80, "sinhala"), (0xE00, "thai"),
    (0xE80, "lao"), (0xF00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1C80, "cyrillic"),
    (0x1C90, "georgian"), (0x1CC0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"),
    (0x3190, "han"), (0x31F0, "kana"), (0x3200, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"),
]
_STARTS = [a for a, _ in _RANGES]


def script(char: str) -> str:
    return _RANGES[max(0, bisect.bisect_right(_STARTS, ord(char)) - 1)][1]


def grams(word: str) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)]


def learned_words(text: str | None) -> list[str]:
    got = words_of(text)
    return got[:: max(1, len(got) // TRAIN_WORDS)]


class LanguageModel:
    def __init__(self, texts: list[str], langs: list[str]):
        self._fit(zip(langs, map(learned_words, texts)))

    @classmethod
    def of_words(cls, pairs) -> "LanguageModel":
        """From the language and learned_words of each text, one at a time."""
        self = cls.__new__(cls)
        self._fit(pairs)
        return self

    def _fit(self, pairs) -> None:
        own, texts = defaultdict(Counter), Counter()
        for x, got in pairs:
            own[x].update(got)
            texts[x] += 1
        self.langs = sorted(own)
        n = len(self.langs)
        words = [own[x] for x in self.langs]
        counts: list[Counter] = [Counter() for _ in self.langs]
        scripts = Counter()
        for i, c in enumerate(words):
            for w, k in c.items():
                scripts[script(w[0]), i] += k
                for g in grams(w):
                    counts[i][g] += min(k, COUNT_CAP)
        kept = Counter()
        for c in counts:
            kept.update(c)
        #: The row of each n-gram of the training words that occurs three times or more.
        self.place = {g: r for r, g in enumerate(sorted(g for g, k in kept.items() if k > 2))}
        m = np.zeros((len(self.place), n))
        for i, c in enumerate(counts):
            for g, k in c.items():
                if g in self.place:
                    m[self.place[g], i] = k
        size = np.array([len(g) for g in self.place], dtype=np.int64)
        for k in (1, 2, 3, 4):
            own = m[size == k]
            m[size == k] = np.log((own + 0.2) / (own.sum(axis=0) + 0.2 * len(own) + 1))
        self.matrix = np.concatenate([m - m.max(axis=1, keepdims=True), np.zeros((1, n))]).astype(np.float32) if n else m
        spread = [sum(c.values()) for c in words]
        #: The languages of each script; of others, none.
        self.fits = {s: [scripts[s, i] > 0.005 * max(1, spread[i]) for i in range(n)] for s in {s for s, _ in scripts}}
        self.fits_none = [False] * n
        self.most = max(range(n), key=lambda i: (texts[self.langs[i]], -i)) if n else None

    def score_words(self, words: list[str]) -> np.ndarray:
        """A row for each word: log score of each language, 0 for the best, the same low value where the script excludes it, NaN where no language has the script."""
        get, rows, sizes = self.place.get, [], []
        for w in words:
            own = grams(w)
            rows += map(get, own, repeat(len(self.place)))  # the last row, of zeros, for an n-gram that wasn't learned
            sizes.append(len(own))
        if not words:
            return np.zeros((0, len(self.langs)))
        total = np.add.reduceat(self.matrix[rows], np.cumsum([0, *sizes[:-1]]), axis=0).astype(np.float64)
        fits = np.array([self.fits.get(script(w[0]), self.fits_none) for w in words])
        total = np.where(fits, total, -math.inf)
        told = fits.any(axis=1)
        out = np.full(total.shape, np.nan)
        own = total[told]
        out[told] = np.where(fits[told], np.maximum(own - own.max(axis=1, keepdims=True), -CLIP), -CLIP * 4)
        return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH) -> list[np.ndarray]:
    """Labels of the words of many texts at once.  scores: words of all texts, one after the other."""
    n, k = len(lengths), scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    begins = (np.cumsum(lengths) - lengths)[order]
    steps = int(size[0]) if n else 0
    back = np.zeros(scores.shape, dtype=np.int16)  # where the best path came from
    best = np.zeros((n, k))
    lanes = np.arange(k, dtype=np.int16)
    live = np.searchsorted(-size, -np.arange(steps), side="left")
    for t in range(steps):
        m = live[t]
        at = begins[:m] + t
        if t == 0:
            best[:m] = scores[at]
            continue
        b = best[:m]
        top = b.argmax(axis=1)
        leap = b[np.arange(m), top][:, None] - penalty
        stay = b >= leap
        back[at] = np.where(stay, lanes, top[:, None].astype(np.int16))
        best[:m] = np.where(stay, b, leap) + scores[at]
    labels = np.zeros(len(scores), dtype=np.int16)
    state = best.argmax(axis=1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        m = live[t]
        at = begins[:m] + t
        labels[at] = state[:m]
        state[:m] = back[at, state[:m]]
    ends = np.cumsum(lengths)
    return [labels[e - s : e] for e, s in zip(ends, lengths)]


class Labeller:
    """A model with a bounded cache of word scores."""

    def __init__(self, model: LanguageModel):
        self.model, self.cache, self.rows = model, {}, np.zeros((1024, len(model.langs)), dtype=np.float32)

    def _learn(self, group: list[list[str]]) -> None:
        """Score the words of the group that the cache lacks, some thousands at a time."""
        cache = self.cache
        new = list(set().union(*group).difference(cache))
        need = len(cache) + len(new)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((need - len(self.rows), self.rows.shape[1]), dtype=np.float32)])
        for i in range(0, len(new), 20_000):
            part, at = new[i : i + 20_000], len(cache)
            self.rows[at : at + len(part)] = self.model.score_words(part)
            cache.update(zip(part, range(at, at + len(part))))

    def label(self, texts: list[str | None], spans: bool = False) -> list[tuple]:
        """(language, score, spans) of each text; at most a few million words at a time."""
        out: list[tuple] = []
        group: list[list[str]] = []
        size = 0
        for t in texts:
            words = words_of(t)
            group.append(words)
            size += len(words)
            if size > 1_000_000:
                out += self._group(group, spans)
                group, size = [], 0
        return out + self._group(group, spans)

    def _group(self, group: list[list[str]], spans: bool) -> list[tuple]:
        langs = self.model.langs
        if not langs:
            return [("und", 0.0, [])] * len(group)
        if len(self.cache) > CACHE:
            self.cache = {}
        self._learn(group)
        cache = self.cache
        index = [cache[w] for words in group for w in words]
        lengths = np.array([len(w) for w in group], dtype=np.int64)
        if not index:
            return [("und", 0.0, [])] * len(group)
        scores = self.rows[index]
        told = ~np.isnan(scores[:, 0])
        labels = viterbi(np.where(told[:, None], scores, 0.0), lengths)
        out, at = [], 0
        for words, lab in zip(group, labels):
            known = told[at : at + len(words)]
            at += len(words)
            if not words:
                out.append(("und", 0.0, []))
                continue
            counts = np.bincount(lab[known], minlength=len(langs))
            best = int(counts.argmax()) if counts.any() else self.model.most
            runs = []
            if spans:
                cut = np.flatnonzero(np.concatenate(([True], lab[1:] != lab[:-1], [True])))
                runs = [{"begin": int(a), "end": int(b), "lang": langs[lab[a]]} for a, b in zip(cut[:-1], cut[1:])]
            out.append((langs[best], float(counts[best] / max(1, counts.sum())) if counts.any() else 0.0, runs))
        return out


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", limit: int = TRAIN_DOCS) -> LanguageModel:
    """Fit on text and lang of about limit documents outside the held-out fold, those with the lowest hash of doc_id."""
    d = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("x")).filter(~held_out("i") & F.col("x").isNotNull() & F.col("t").isNotNull())

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([learned_words(t) for t in b.column(0).to_pylist()], pa.list_(pa.string())), *b.columns[1:]], names=["words", "i", "x", "h"])

    # the texts stay where they are: only the words that are learned come back, some rows at a time
    few = sampled(d, ["i", "t", "x"], limit).select("t", "i", "x", F.xxhash64("t").alias("h")).mapInArrow(run, StructType([StructField("words", ArrayType(StringType())), d.schema["i"], d.schema["x"], StructField("h", LongType())]))
    rows = materialize(few.dropDuplicates(["i", "x", "h"]).select("x", "words").limit(2 * limit), "words")
    return LanguageModel.of_words((r.x, r.words) for r in rows.toLocalIterator())


def label_languages(docs: DataFrame, model: LanguageModel, text: str = "text", spans: bool = True) -> DataFrame:
    """docs with lang_pred, lang_score and, if asked for, spans (begin and end in words, lang)."""
    names = [fresh(docs, c) for c in ("lang_pred", "lang_score", "spans")]
    cols, place = docs.columns, docs.columns.index(text)
    schema = extended(docs, f"{names[0]} string, {names[1]} double, {names[2]} array<struct<begin:int,end:int,lang:string>>")
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        labeller = Labeller(shared.value)
        for b in slices(batches, 2500):
            got = labeller.label(b.column(place).to_pylist(), spans)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _, _ in got], pa.string()), pa.array([s for _, s, _ in got], pa.float64()), pa.array([r for _, _, r in got], kind)], names=[*cols, *names])

    return docs.mapInArrow(lean(run), schema)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = label_languages(docs.select("doc_id", "text"), train(docs), spans=True)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.size("spans").cast("long").alias("n_spans"))
