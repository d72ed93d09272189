"""Token ids by the tokenizers library, with a bounded cache of words.

Neither vocabulary joins tokens across a single space, so the ids of a text are those of its
space-separated parts; most parts recur. Texts with other white space go to the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Marks that, after a letter or digit (also once it is normalised), end a word. Special tokens end with another character.
MARKS = ".,;:!?%&#$*"
#: White space other than single spaces and newlines between words.
UNEVEN = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def vocabulary_size(path: str) -> int:
    """How many ids a tokenizer's file has, with its special tokens."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


class Encoder:
    """Little-endian unsigned 32-bit ids of texts. joins_space: a token may begin with one space (byte-level BPE)."""

    def __init__(self, path: str, joins_space: bool, cached_words: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.joins_space, self.lead = joins_space, " " if joins_space else ""
        self.folds = self._direct("Aa") == self._direct("aa")  # lower-cases
        # two generations: what is used again moves to the young one, the old one is dropped as a whole
        self.half, self.young, self.old = cached_words // 2, {}, {}
        self.marks: dict[str, bytes] = {"": b""}
        self.newline = int.from_bytes(self._direct("\n"), "little")  # of byte-level vocabularies
        # the ids that begin a spaced word, or that end a word: where a vocabulary marks one of them
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.startswith("\u0120") if joins_space else t.endswith("</w>"))]] = True

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _joined(self, words: list[str]) -> list[bytes]:
        """Ids of space-separated words from one call; offsets tell which tokens are whose."""
        encoded = self.tokenizer.encode(" " * bool(self.lead) + " ".join(words), add_special_tokens=False)
        ids = np.array(encoded.ids, "<u4")
        at = np.fromiter((a for a, _ in encoded.offsets), np.int64, len(ids))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begin = np.cumsum(sizes) - sizes  # each word with its leading space, or with the one after it
        return self._cut(ids, np.searchsorted(at, begin).tolist())

    def _letters(self, words: list[str]) -> list[bytes]:
        """The same for words of letters only, whose first or last token shows where they meet."""
        ids = np.array(self.tokenizer.encode_batch_fast([" " * bool(self.lead) + " ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        edges = np.flatnonzero(self.edge[ids])
        if len(edges) != len(words):
            return self._joined(words)
        return self._cut(ids, (edges if self.joins_space else np.concatenate(([0], edges[:-1] + 1))).tolist())

    @staticmethod
    def _cut(ids: np.ndarray, begin: list[int]) -> list[bytes]:
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(begin, [*begin[1:], len(ids)], strict=True)]

    def _lines(self, words: list[str]) -> list[bytes]:
        """The same for words that each begin with the only newline they have."""
        ids = np.frombuffer(self._direct("".join(words)), "<u4")
        begin = np.flatnonzero(ids == self.newline)
        return self._cut(ids, begin.tolist()) if len(begin) == len(words) else list(map(self._direct, words))

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that aren't cached. Marks after a letter or digit, up to the end, are tokens of their own."""
        found: dict[str, bytes] = {"": b""}
        letters: list[str] = []
        stems: set[str] = set()
        derived: list[tuple[str, str, bytes]] = []
        young, old, marks, folds = self.young, self.old, self.marks, self.folds
        for w in words:
            ids = old.get(w)
            if ids is not None:
                found[w] = ids
                continue
            if w.isalpha() and not folds:  # most words: nothing to take off
                letters.append(w)
                continue
            stem = w.rstrip(MARKS)
            last = stem[-1:]
            if not (last if last.isascii() else normalize("NFC", last.lower())[-1]).isalnum():
                stem = w
            mark = w[len(stem) :]
            if folds and stem.isascii():
                stem = stem.lower()
            if stem == w:
                stems.add(w)
                continue
            end = marks.get(mark)
            if end is None:
                end = self._direct(mark)
                if len(marks) < 10_000 and len(mark) <= 16:
                    marks[mark] = end
            ids = young.get(stem) or old.get(stem)
            if ids is None:
                derived.append((w, stem, end))
                stems.add(stem)
            else:
                found[w] = ids + end
        lines, others = [], []
        for w in stems.difference(letters) if letters else stems:
            (letters if w.isalpha() else lines if w[:1] == "\n" else others if w else []).append(w)
        for cut, some in ((self._letters, letters), (self._lines, lines), (self._joined, others)):
            for at in range(0, len(some), 2000):
                part = some[at : at + 2000]
                found.update(zip(part, cut(part), strict=True))
        found.update((w, found[stem] + end) for w, stem, end in derived)
        return found

    def _words(self, words: list[str], times: list[int]) -> list[bytes]:
        """Ids of distinct words with how often they occur; those that do so once aren't worth a place in the cache."""
        ids = list(map(self.young.get, words))
        unknown = [i for i, x in enumerate(ids) if x is None]
        fresh = [words[i] for i in unknown]
        learnt = list(map(self._learn(fresh).__getitem__, fresh))
        for i, x in zip(unknown, learnt, strict=True):
            ids[i] = x
        again = {w: x for i, w, x in zip(unknown, fresh, learnt, strict=True) if times[i] > 1 and len(w) <= 64}
        if len(self.young) + len(again) > self.half:
            self.old, self.young = self.young, {}
        self.young.update(again)
        return ids

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """A null text has no ids, like an empty one. Splitting, counting and joining are Arrow's."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        whole: dict[int, bytes] = {}
        if self.joins_space:
            odd = pc.match_substring_regex(texts, UNEVEN)
            whole = {i: self._direct(texts[i].as_py()) for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()}
            texts = pc.if_else(odd, "", texts)
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n" if self.joins_space else " "), " ")
        coded = parts.flatten().dictionary_encode()
        words, places = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        ids = self._words(words, np.bincount(places, minlength=len(words)).tolist())
        joined = pa.array(ids, pa.large_binary()).take(coded.indices)
        at, raw = np.frombuffer(joined.buffers()[1], "<i8"), memoryview(joined.buffers()[2] or b"")
        first, stop = parts.offsets[:-1].to_numpy(), at[parts.offsets[1:].to_numpy()].tolist()
        if not self.joins_space:
            return [bytes(raw[a:b]) for a, b in zip(at[first].tolist(), stop, strict=True)]
        # the first word of a text has no space before it
        heads = {j: self._direct(words[j]) for j in np.unique(places[first]).tolist()}
        out = [heads[j] + bytes(raw[a:b]) for j, a, b in zip(places[first].tolist(), at[first + 1].tolist(), stop, strict=True)]
        for i, x in whole.items():
            out[i] = x
        return out


@lru_cache(maxsize=1)
def worker_encoder(path: str, joins_space: bool) -> Encoder:
    """The encoder of a Python worker: loaded once, its bounded cache serves all tasks that the worker runs."""
    return Encoder(path, joins_space)
