"""Whole-text encoding with public vocabularies, word by word through a cache.

Both vocabularies cut a text into words before they merge anything, so a text's
ids are its words' ids put together.  Each block of texts is cut into words,
the block's different words are looked up in a cache that the worker process
keeps over tasks (bounded by ``CACHE_WORDS``), the library encodes those that
are new, and arrays put the ids together.  Texts with characters for which the
cut could differ (control characters, combining marks, special-token strings,
scripts outside ``_ODD``'s complement) go to the library whole, so the ids are
the library's in every case.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a worker process keeps, per vocabulary: as many new ones and as many older ones.
CACHE_WORDS = 200_000
#: And pieces of words, for the vocabulary that cuts words at signs.
CACHE_PIECES = 350_000
#: Bytes of text that are encoded together.
BLOCK_BYTES = 4_000_000

#: Characters other than precomposed Latin letters, ASCII and common
#: punctuation, which Unicode normalisation leaves as they are.
_ODD = "[^\\t\\n\\r -~¡-¬®-±´-¸º»¿-įĴ-ňŊ-ž‐-‧€]|<\\|"
_ODD_WORD = re.compile(_ODD)
#: The lower-casing vocabulary's cut, for lower-cased words without odd characters.
_CUT = re.compile("'(?:s|t|re|ve|m|ll|d)|[^\\W\\d_]+|[0-9]|[!-/:-@\\[-`{-~¡-©«¬®-±´¶-¸»¿×÷‐-‧€]+")


def blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, in slices of about BLOCK_BYTES; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES, "right")))
        yield texts[at:to]
        at = to
        pa.default_memory_pool().release_unused()


def words_of(block: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of characters other than ASCII white space, with empty strings among them, and each text's first and last."""
    lists = pc.ascii_split_whitespace(block)
    offsets = lists.offsets.to_numpy()
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


def strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The indices begin[i], begin[i] + 1, ... of n[i] each, in a row."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - n), n)


class _Cache:
    """Ids of words in two generations: when the new one is full it becomes the old one, from which words in use come back."""

    def __init__(self, most: int):
        self.most, self._new, self._old = most, {}, {}

    def unknown(self, words: Iterable[str]) -> list[str]:
        """The words that neither generation has; the others are in the new one afterwards."""
        new, old, out = self._new, self._old, []
        for w in words:
            if w not in new:
                ids = old.get(w)
                if ids is None:
                    out.append(w)
                else:
                    new[w] = ids
        return out

    def add(self, words: Iterable[str], ids: Iterable[bytes]) -> None:
        self._new.update(zip(words, ids, strict=True))

    def get(self, words: Iterable[str]) -> list[bytes]:
        return list(map(self._new.__getitem__, words))

    def settle(self) -> None:
        if len(self._new) > self.most:
            self._old, self._new = self._new, {}


class _Words:
    """Ids of words, from the cache or the library; dtype is that of the ids."""

    dtype = "<u4"

    def __init__(self):
        self._words = _Cache(CACHE_WORDS)

    def share(self, n: int) -> None:
        """Lets n vocabularies have the memory of one."""
        self._words.most = CACHE_WORDS // n

    def _learn(self, words: list[str]) -> list[bytes]:
        raise NotImplementedError

    def known(self, words: list[str]) -> list[bytes]:
        """The ids of different words."""
        if new := self._words.unknown(words):
            self._words.add(new, self._learn(new))
        out = self._words.get(words)
        self._words.settle()
        return out

    def gather(self, words: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words' ids in a row, where each text's begin and end, and how many each word has."""
        coded = words.dictionary_encode()
        parts = self.known(strings(coded.dictionary))
        size = np.dtype(self.dtype).itemsize
        ids = np.frombuffer(b"".join(parts), self.dtype)
        each = np.fromiter(map(len, parts), np.int64, len(parts)) // size
        codes = coded.indices.to_numpy()
        n = each[codes]
        bounds = np.concatenate([[0], np.cumsum(n)])[offsets]
        return ids[spread((np.cumsum(each) - each)[codes], n)], bounds, n


class WordBpe(_Words):
    """The lower-casing BPE vocabulary with word ends; ids are little-endian u32."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._tok = Tokenizer.from_file(path)
        vocabulary = self._tok.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._pieces = _Cache(CACHE_PIECES)

    def share(self, n: int) -> None:
        super().share(n)
        self._pieces.most = CACHE_PIECES // n

    def library(self, text: str) -> np.ndarray:
        return np.array(self._tok.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn_pieces(self, pieces: list[str]) -> Iterator[bytes]:
        """One call for many pieces; each one's ids end at a word-end id."""
        for k in range(0, len(pieces), 5000):
            some = pieces[k : k + 5000]
            ids = self.library(" ".join(some))
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) == len(some):
                raw, cuts = ids.tobytes(), (ends * 4).tolist()
                yield from (raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False))
            else:  # not one pre-token each: ask one by one
                yield from (self.library(p).tobytes() for p in some)

    def _learn(self, words: list[str]) -> list[bytes]:
        odd = [i for i, w in enumerate(words) if _ODD_WORD.search(w)]
        if odd:  # words of texts that encode() gives to the library whole; fertility takes them one by one
            out = [b""] * len(words)
            for i in odd:
                out[i] = self.library(words[i]).tobytes()
            rest = sorted(set(range(len(words))) - set(odd))
            for i, ids in zip(rest, self._learn([words[i] for i in rest]) if rest else (), strict=True):
                out[i] = ids
            return out
        cut = [[w] if w.isalpha() else _CUT.findall(w) for w in map(str.lower, words)]
        flat = [p for pieces in cut for p in pieces]
        new = list(dict.fromkeys(self._pieces.unknown(flat)))
        self._pieces.add(new, self._learn_pieces(new))
        ids = iter(self._pieces.get(flat))
        out = [next(ids) if len(p) == 1 else b"".join(islice(ids, len(p))) for p in cut]
        self._pieces.settle()
        return out

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each whole text in turn; null counts as empty."""
        for block in blocks(texts):
            odd = pc.match_substring_regex(block, _ODD)
            ids, bounds, _ = self.gather(*words_of(pc.if_else(odd, "", block) if pc.any(odd).as_py() else block))
            for i, whole in enumerate(odd.to_pylist()):
                yield self.library(block[i].as_py()) if whole else ids[bounds[i] : bounds[i + 1]]


class PieceBpe(_Words):
    """The sentence-piece vocabulary with byte fallback; ids are little-endian u16."""

    dtype = "<u2"
    #: Fixed by the vocabulary's layout: ids of the 256 byte pieces.
    FIRST_BYTE, LAST_BYTE = 3, 258

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        self._sp = sentencepiece.SentencePieceProcessor(model_file=path)

    def _learn(self, words: list[str]) -> list[bytes]:
        return [array("H", ids).tobytes() for ids in self._sp.encode(words, num_threads=1)]


_loaded: dict[tuple[type, str], object] = {}


def loaded(*asked: tuple[type, str]) -> list:
    """The worker process' instances of (kind, path), whose caches last over tasks; only those asked for last are kept."""
    for x in set(_loaded) - set(asked):
        del _loaded[x]
    for kind, path in asked:
        if (kind, path) not in _loaded:
            _loaded[kind, path] = kind(path)
        _loaded[kind, path].share(len(asked))
    return [_loaded[x] for x in asked]


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
