"""Token ids of many texts with the tokenizers library, words encoded once.

A text is cut before single spaces, where both tokenizers always start a new piece, so the ids of a text are those of its
words in turn.  Each worker keeps the ids of words it has seen; a text with a space before white space or at its end is
encoded whole, since such a space is a piece of its own for the byte-level tokenizer.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import count

import numpy as np

_UNSAFE = re.compile(r" (?:\s|$)")
_MARK = "…"
_TOGETHER = 100  # new words in one string: the library's time a word grows with its length
_known: dict[tuple, Encoder] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, leading_space: bool) -> Encoder:
    """One encoder per worker process and tokenizer file.

    ``leading_space``: a word's ids include the space before it (byte-level); otherwise white space has no ids.
    """
    key = (path, leading_space)
    if key not in _known:
        _known[key] = Encoder(path, leading_space)
    return _known[key]


class Encoder:
    def __init__(self, path: str, leading_space: bool, limit: int = 800_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.leading, self.limit = Tokenizer.from_file(path), leading_space, limit
        if leading_space:
            vocabulary = self.tokenizer.get_vocab()
            self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
            self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        else:
            mark = self.whole([_MARK])[0]
            assert len(mark) == 1, "the mark between words must be one token"
            self.mark = mark[0]
        self._reset()

    def _reset(self):
        self.at: dict[str, int] = {}  # in order of their index
        self.start, self.size, self.hits = (np.zeros(0, np.int64) for _ in range(3))
        self.store, self.used = np.zeros(1 << 16, np.uint32), 0

    def _forget(self):
        """Keep the words that were met again; new ones are mostly met once."""
        keep = np.flatnonzero(self.hits >= 2)
        words, start, size = list(self.at), self.start[keep], self.size[keep]
        at = np.cumsum(size) - size
        self.store[: size.sum()] = self.store[np.repeat(start - at, size) + np.arange(size.sum())]
        self.at = {words[k]: n for n, k in enumerate(keep)}
        self.start, self.size, self.hits, self.used = at, size, self.hits[keep] // 2, int(size.sum())

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Ids of new words: many words per call, told apart by how a word's ids begin or by a mark between words."""
        # First words of texts have no space before them, and words with the mark can't be told apart by it.
        single = np.array([w.endswith(" ") for w in words] if self.leading else [_MARK in w for w in words], bool)
        order = np.argsort(single, kind="stable")
        alone = [words[k] for k in np.flatnonzero(single)]
        joined = [words[k] for k in np.flatnonzero(~single)] if alone else words
        glue = " " if self.leading else f" {_MARK} "
        parts = [(" " if self.leading else "") + glue.join(joined[k : k + _TOGETHER]) + ("" if self.leading else glue) for k in range(0, len(joined), _TOGETHER)]
        ids = np.concatenate([np.zeros(0, np.uint32), *self.whole(parts)])
        if self.leading:
            cut = np.append(np.flatnonzero(self.opens[ids]), len(ids))
            size = np.diff(cut)
        else:
            cut = np.flatnonzero(ids == self.mark)
            size = np.diff(np.append(-1, cut)) - 1
            ids = ids[ids != self.mark]
        assert len(size) == len(joined), "words and their ids differ in number"
        rest = self.whole([w[:-1] if self.leading else w for w in alone])
        ids = np.concatenate([ids, *rest])
        size = np.concatenate([size, np.array([len(r) for r in rest], np.int64)]).astype(np.int64)
        start = self.used + np.cumsum(size) - size
        back = np.argsort(order)
        self.start = np.concatenate([self.start, start[back]])
        self.size = np.concatenate([self.size, size[back]])
        if self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(max(len(ids), len(self.store)), np.uint32)])
        self.store[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        words: list[str] = []
        ends, odd = [], {}
        for k, text in enumerate(texts):
            if self.leading and _UNSAFE.search(text):
                odd[k] = text
            elif text:
                own = text.split(" ")
                if self.leading:
                    own[0] += " "  # a key no other word can have
                    if len(own[0]) == 1:
                        own = own[1:]  # the text starts with a space
                words += own
            ends.append(len(words))
        if len(self.at) > self.limit:
            self._forget()
        base = len(self.start)
        try:  # a new word is first known by its place among the words, then by its index
            where = np.fromiter(map(self.at.setdefault, words, count(base)), np.int64, len(words))
            new = np.flatnonzero(where == base + np.arange(len(words)))
            if len(new):
                fresh = [words[k] for k in new]
                index = np.zeros(len(words), np.int64)
                index[new] = np.arange(base, base + len(new))
                late = np.flatnonzero(where >= base)
                where[late] = index[where[late] - base]
                self.at.update(zip(fresh, range(base, base + len(new)), strict=True))
                self._learn(fresh)
        except BaseException:
            self._reset()
            raise
        self.hits = np.bincount(where, minlength=len(self.start)) + np.pad(self.hits, (0, len(self.start) - len(self.hits)))
        size = self.size[where]
        off = np.concatenate([[0], np.cumsum(size)])
        flat = self.store[np.repeat(self.start[where] - off[:-1], size) + np.arange(off[-1])]
        cut = off[np.concatenate([[0], ends]).astype(np.int64)]
        out = [flat[cut[k] : cut[k + 1]] for k in range(len(texts))]
        if odd:
            for k, ids in zip(odd, self.whole(list(odd.values())), strict=True):
                out[k] = ids
        return out


def encoded(column, path: str, leading_space: bool, limit: int = 4_000_000) -> Iterator[np.ndarray]:
    """Ids of every text of an Arrow string column in turn, a few megabytes of text at a time; null is empty."""
    coder, part, size = encoder(path, leading_space), [], 0
    for k in range(len(column)):
        part.append(column[k].as_py() or "")
        size += len(part[-1])
        if size > limit:
            yield from coder.encode(part)
            part, size = [], 0
    yield from coder.encode(part)
