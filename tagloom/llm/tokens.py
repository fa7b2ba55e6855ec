"""Token counts and ids with the public tokenizer libraries.

Words repeat, so a worker remembers what the library gave for a word, by the
word's 64-bit hash in sorted arrays of bounded size, and asks the library for
the words it has not seen. Why a text's tokens are those of its words is stated
at each class.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from tagloom.llm.textblocks import SPACE_TABLE, blocks, word_spans

#: Words remembered by a worker before it starts afresh.
REMEMBER = 1_000_000


def vocabulary(name: str) -> str:
    """The place of a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def word_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def piece_tokenizer(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Known:
    """Numbers of hashes, in the order in which they were learned."""

    def __init__(self) -> None:
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """-1 where a hash is not known."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int64)
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == hashes, self.numbers[at], -1).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        """New, different hashes."""
        order = np.argsort(hashes)
        at = np.searchsorted(self.keys, hashes[order])
        self.numbers = np.insert(self.numbers, at, (len(self.keys) + order).astype(np.int32))
        self.keys = np.insert(self.keys, at, hashes[order])


def _learned(known: Known, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each hash, its unknown hashes, an index of each of these)."""
    different, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    missing = np.flatnonzero(known.find(different) < 0)
    return inverse, different, first[missing]


# Byte classes for cutting marks off words: letter, mark, other; Latin-1 letters are 0xC3 and a byte.
_LETTER, _MARK, _OTHER = 1, 2, 4
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[list(b".,;:!?#$%&*()|")] = _MARK


def _classes(raw: np.ndarray) -> np.ndarray:
    kind = _CLASS[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    good = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    kind[good] = kind[good + 1] = _LETTER
    return kind


class WordIds:
    """Ids of texts by a tokenizer that drops white space, lower-cases letters, and
    never joins across white space, or from letters to marks.

    Its pre-tokenizer matches runs of letters, single digits and runs of other
    characters, never white space; a text's ids are those of its words in order.
    A word of ASCII or Latin-1 letters and the marks above, nothing else, is cut
    between letters and marks as the pre-tokenizer cuts it. ASCII letters are
    lower-cased before words are compared. Texts in which a special token's string
    may occur are left to the library whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = word_tokenizer(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known = Known()
        self.flat, self.sizes, self.starts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids_of(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text, without special tokens added."""
        out: list[np.ndarray] = []
        for i, j in blocks(offsets):
            out += self._block(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        return out

    def _block(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        if len(raw) and bytes(raw).find(b"<|") >= 0:
            if len(offsets) == 2:
                return [np.array(self.tokenizer.encode(bytes(raw).decode(), add_special_tokens=False).ids, np.uint32)]
            return [x for k in range(len(offsets) - 1) for x in self._block(raw[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))]
        if len(self.known) > REMEMBER:
            self.clear()
        kind = _classes(raw) if len(raw) else np.zeros(0, np.uint8)
        hashes, rows, starts, ends = word_spans(raw, offsets, SPACE_TABLE, kind)
        inverse, different, fresh = _learned(self.known, hashes)
        if len(fresh):
            self._learn([bytes(raw[starts[k] : ends[k]]) for k in fresh], hashes[fresh], (kind[starts[fresh]] == _LETTER) & (kind[ends[fresh] - 1] == _LETTER))
        number = self.known.find(different)[inverse] if len(hashes) else np.zeros(0, np.int64)
        n = self.sizes[number]
        at = np.repeat(self.starts[number] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        ids = self.flat[at]
        cut = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(rows, np.arange(len(offsets)))]
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def _learn(self, words: list[bytes], hashes: np.ndarray, plain: np.ndarray) -> None:
        """`plain`: the word may be letters alone; such are asked for many at a time."""
        texts = [w.decode("utf-8", "replace").lower() if p else w.decode("utf-8", "replace") for w, p in zip(words, plain, strict=True)]
        alone = [k for k, (t, p) in enumerate(zip(texts, plain, strict=True)) if not (p and t.isalpha() and max(t) < "Ā")]
        joined = [k for k, (t, p) in enumerate(zip(texts, plain, strict=True)) if p and t.isalpha() and max(t) < "Ā"]
        got: dict[int, np.ndarray] = {}
        for k, e in zip(alone, self.tokenizer.encode_batch_fast([texts[k] for k in alone], add_special_tokens=False) if alone else [], strict=True):
            got[k] = np.array(e.ids, np.uint32)
        for at in range(0, len(joined), 200):
            some = joined[at : at + 200]
            ids = np.array(self.tokenizer.encode(" ".join(texts[k] for k in some), add_special_tokens=False).ids, np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(some) and cut[-1] == len(ids):  # each run of letters ends in one end-of-word token
                got |= zip(some, np.split(ids, cut[:-1]), strict=True)
            else:
                got |= {k: np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, np.uint32) for k in some}
        self.known.add(hashes)
        sizes = np.array([len(got[k]) for k in range(len(words))], np.int64)
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate([self.flat, *(got[k] for k in range(len(words)))])


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


_BLANK = np.zeros(256, bool)
_BLANK[32] = True


class UnitCounts:
    """Token counts of texts by a sentencepiece model that marks spaces.

    Where no piece of the vocabulary has a space mark after another character, a
    token never spans the place before a space. A text without leading, trailing
    or double spaces is then tokenized word by word: each word alone, which gets
    the mark in front that the space gives it inside the text.
    """

    def __init__(self, path: str) -> None:
        self.model = piece_tokenizer(path)
        mark = "\N{LOWER ONE EIGHTH BLOCK}"
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.splits = not any(mark in p.lstrip(mark) for p in pieces) and self.model.encode("a b", out_type=str) == [mark + "a", mark + "b"]
        self.clear()

    def clear(self) -> None:
        self.known, self.values = Known(), np.zeros(0, np.int64)

    def stable(self, before: str, after: str) -> bool:
        """Whether no token can span the place between the two characters."""
        return self.splits and before != " " and after == " "

    def counts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each text."""
        return np.concatenate([np.zeros(0, np.int64), *(self._block(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in blocks(offsets))])

    def _block(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        texts = len(offsets) - 1
        out = np.zeros(texts, np.int64)
        some = np.flatnonzero(offsets[1:] > offsets[:-1])
        if not len(some):
            return out
        blank = raw == 32
        odd = np.zeros(texts, bool)
        odd[some] = blank[offsets[some]] | blank[offsets[some + 1] - 1] | (not self.splits)
        twice = np.flatnonzero(blank[1:] & blank[:-1])
        odd[np.searchsorted(offsets, twice, "right") - 1] = True
        if len(self.known) > REMEMBER:
            self.clear()
        hashes, rows, starts, ends = word_spans(raw, offsets, _BLANK, None)
        inverse, different, fresh = _learned(self.known, hashes)
        if len(fresh):
            words = [bytes(raw[starts[k] : ends[k]]).decode("utf-8", "replace") for k in fresh]
            self.known.add(hashes[fresh])
            self.values = np.concatenate((self.values, np.array(list(map(len, self.model.encode(words, num_threads=1))), np.int64)))
        if len(hashes):
            out += np.bincount(rows, weights=self.values[self.known.find(different)[inverse]], minlength=texts).astype(np.int64)
        for k in np.flatnonzero(odd):
            out[k] = len(self.model.encode(bytes(raw[offsets[k] : offsets[k + 1]]).decode("utf-8", "replace")))
        return out

    def boundaries(self, text: str) -> np.ndarray:
        """Start in code points of every token of a text that is encoded alone."""
        spans = self.model.encode(text, return_type="offset_mapping")["offsets"]
        return np.array([a for a, _ in spans], np.int64)


@lru_cache(maxsize=2)
def unit_counts(path: str) -> UnitCounts:
    return UnitCounts(path)
