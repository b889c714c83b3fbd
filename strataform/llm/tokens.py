"""Token ids by a public tokenizer file, exact, many texts at a time.

The tokenizer drops white space, and each of its steps (normal form, lower case, split, merges) stays between white
space.  So the ids of a text are those of its white-space-separated words, one after the other.  A batch is split and its
words dictionary-encoded by Arrow; only distinct words are looked at.  Their pieces (letters, single digits, the rest)
are merged together in numpy: all pieces of one length form a matrix, and each step applies to each row its merge of
the lowest rank, the leftmost first.  Words of other scripts, and those that hold a special token's string, go to the
tokenizer itself.  The ids of the texts are then gathered by the words' codes.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LETTER = re.escape("".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == "L"))
_NUMBER = re.escape("".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == "N"))
#: The pieces of words, and the line end that parts one word from the next.
PIECE = re.compile(f"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}\n]+")
UNSAFE = "[^\\x00-\\x{12f}\\x{131}-\\x{17f}]|<\\|"
#: White space to Python or Arrow but not to the tokenizer.
ODD_SPACE = "[\\x1c-\\x1f]"
#: Bytes of text that are taken at a time, about.
PART_BYTES = 16 << 20
#: Bytes of text whose ids are gathered at a time, about.
RUN_BYTES = 1 << 20
_NONE = np.iinfo(np.int32).max


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable letter by which byte-level merges name each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return [chr(b if b in plain else 256 + odd.index(b)) for b in range(256)]


def ragged_take(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[starts[c]:starts[c] + sizes[c]] for each c of codes, one after the other, and their sizes."""
    n = sizes[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total, dtype=np.int64) + np.repeat(starts[codes] - (ends - n), n)], n


class WordTokenizer:
    """For tokenizers that lower-case, drop white space and end words, as word_bpe_49k does."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        model = json.loads(definition)["model"]
        vocab, end, letters = model["vocab"], model["end_of_word_suffix"], _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.last = np.array([vocab[c + end] for c in letters], dtype=np.int32)
        left, right, made = (np.array(x, dtype=np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"])))
        self.base = len(vocab)
        keys = left * self.base + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made.astype(np.int32)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each a with the b behind it; _NONE where there is none."""
        key = a.astype(np.int64) * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def _merge(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of a matrix of first ids, and how many each row has left."""
        n, width = ids.shape
        out, sizes = ids.copy(), np.full(n, width, dtype=np.int64)
        live, rank = np.arange(n), self._rank(ids[:, :-1], ids[:, 1:])
        while width > 1 and len(live):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rank)), at]
            more = best != _NONE
            out[live[~more], :width] = ids[~more]
            sizes[live[~more]] = width
            live, ids, rank, at, best = live[more], ids[more], rank[more], at[more], best[more]
            if not len(live):
                break
            rows, width = np.arange(len(live)), width - 1
            cols = np.arange(width)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), axis=1)
            ids[rows, at] = self.made[best]
            if width == 1:
                out[live, :1], sizes[live] = ids, 1
                break
            cols = cols[:-1]
            rank = np.take_along_axis(rank, cols + (cols >= at[:, None]), axis=1)
            old = np.flatnonzero(at > 0)  # the pairs on both sides of the merged one are new
            rank[old, at[old] - 1] = self._rank(ids[old, at[old] - 1], ids[old, at[old]])
            new = np.flatnonzero(at < width - 1)
            rank[new, at[new]] = self._rank(ids[new, at[new]], ids[new, at[new] + 1])
        return out, sizes

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, starts and sizes of distinct pieces; a line end has none."""
        data = pieces.cast(pa.large_binary())
        offsets = np.frombuffer(data.buffers()[1], dtype=np.int64)[: len(data) + 1]
        begins, width = offsets[:-1], np.diff(offsets)
        flat = np.frombuffer(data.buffers()[2] or b"", dtype=np.uint8)
        order = np.argsort(width, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], np.diff(width[order]) != 0, [True]))) if len(data) else [0]
        ids, starts, sizes, filled = [], np.zeros(len(data), dtype=np.int64), np.zeros(len(data), dtype=np.int64), 0
        for a, b in zip(cut[:-1], cut[1:]):
            w = int(width[order[a]])
            if w > 64:  # a matrix would cost the square of the width
                for i in order[a:b]:
                    got = self.tokenizer.encode(pieces[int(i)].as_py(), add_special_tokens=False).ids
                    ids.append(np.array(got, dtype=np.int32))
                    starts[i], sizes[i] = filled, len(got)
                    filled += len(got)
                continue
            for c in range(a, b, 1 << 16):
                own = order[c : min(b, c + (1 << 16))]
                raw = flat[begins[own][:, None] + np.arange(w)]
                first = self.inner[raw]
                first[:, -1] = self.last[raw[:, -1]]
                merged, n = self._merge(first)
                ids.append(merged[np.arange(w) < n[:, None]])
                starts[own], sizes[own] = filled + np.cumsum(n) - n, n
                filled += int(n.sum())
        return np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32), starts, sizes

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, starts and sizes of distinct words."""
        unsafe = pc.match_substring_regex(words, UNSAFE).to_numpy(zero_copy_only=False)
        plain = words.filter(pa.array(~unsafe))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), "\n")[0].as_py() if len(plain) else ""
        found = pa.array(PIECE.findall(joined.lower()), pa.string()).dictionary_encode()
        codes, ends = found.indices.to_numpy(), pc.index(found.dictionary, "\n").as_py()
        flat, starts, sizes = self._pieces(found.dictionary)
        if ends >= 0:
            sizes[ends] = 0
        ids, n = ragged_take(flat, starts, sizes, codes)
        # a word's ids are those between two line ends
        size = np.zeros(len(words), dtype=np.int64)
        if (~unsafe).any():
            place = np.cumsum(codes == ends)
            size[~unsafe] = np.bincount(place, weights=n, minlength=int((~unsafe).sum())).astype(np.int64)
        start = np.cumsum(size) - size
        extra = np.flatnonzero(unsafe)
        if len(extra):
            more = [np.array(self.tokenizer.encode(words[int(i)].as_py(), add_special_tokens=False).ids, dtype=np.int32) for i in extra]
            size[extra] = [len(m) for m in more]
            start[extra] = len(ids) + np.cumsum(size[extra]) - size[extra]
            ids = np.concatenate([ids, *more])
        return ids, start, size

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 32 bits) of all texts, one after the other, and how many each has; null is empty."""
        got = list(self.encode_runs(texts, None))
        return got[0] if got else (np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))

    def encode_runs(self, texts: pa.Array, most: int | None = RUN_BYTES):
        """What encode_array gives, of runs of about `most` bytes of text (a text at least; None: all texts) one after the other.

        Distinct words are looked at once for all texts; only a run's ids are in memory.
        """
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False)
        split = pc.utf8_split_whitespace(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
        offsets = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        words = split.flatten().dictionary_encode()
        del split
        flat, starts, sizes = self._words(words.dictionary)
        codes = words.indices.to_numpy()
        del words
        length = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in spans(np.cumsum(length) - length, most):
            ids, n = ragged_take(flat, starts, sizes, codes[offsets[i] : offsets[j]])
            ends = np.concatenate(([0], np.cumsum(n)))[offsets[i : j + 1] - offsets[i]]
            size, ids = np.diff(ends), ids.astype(np.uint32)
            if odd[i:j].any():
                own = np.split(ids, ends[1:-1])
                for k in np.flatnonzero(odd[i:j]):
                    own[k] = np.array(self.tokenizer.encode(texts[int(i + k)].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
                    size[k] = len(own[k])
                ids = np.concatenate(own)
            yield ids, size

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty."""
        ids, size = self.encode_array(pa.array(texts, pa.string()))
        data, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(size)
        return [data[e - 4 * n : e] for e, n in zip(ends.tolist(), size.tolist())]


def spans(begins: np.ndarray, most: int | None) -> list[tuple[int, int]]:
    """Where to cut rows that begin at these places into runs of about `most` (None: a single run), a row at least."""
    place = begins // most if most else np.zeros(len(begins), dtype=np.int64)
    cut = np.flatnonzero(np.concatenate(([True], np.diff(place) != 0, [True]))).tolist() if len(begins) else [0]
    return list(zip(cut[:-1], cut[1:]))


def parts(batches, column: int, most: int = PART_BYTES):
    """The batches in slices of about `most` bytes of a string column, a row at least."""
    for b in batches:
        size = pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in spans(np.cumsum(size) - size, most):
            yield b.slice(i, j - i)
