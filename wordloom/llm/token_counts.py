"""Token counts of a unigram tokenizer without its tokens.

The vocabulary is a SentencePiece file's pieces and scores, read as a unigram model: white space U+0020 is written as
``▁``, each text starts with one, and every word (from one ``▁`` to the next) is cut into the pieces with the highest sum
of scores.  An Aho-Corasick automaton lists the pieces that end at each character of a word; the dynamic programme keeps
for each position the best score, where its last piece starts, and the number of pieces.  Ties as in the tokenizers
library: of equal sums at a position, the one whose last piece starts first.  A character that is no piece scores ten less
than the worst piece and counts one per byte (byte fallback).
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, functions as F

from wordloom.llm.common import map_batches

SPACE = "▁"
_known: dict[str, PieceCounter] = {}


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class PieceCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], limit: int = 600_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - 10.0
        self.counts, self.limit = {}, limit

    def word(self, word: str) -> int:
        """Pieces of one word, its ``▁`` included."""
        n = len(word)
        best, start, count = [0.0] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        single, unknown = self.single, self.unknown
        done = 0
        for end, (size, score) in self.automaton.iter(word):
            end += 1
            while done < end - 1:  # positions that no piece ends at, and unknown characters at the others
                done = self._close(word, done, best, start, count, single, unknown)
            at = end - size
            value = best[at] + score
            if start[end] < 0 or value > best[end] or (value == best[end] and at < start[end]):
                best[end], start[end], count[end] = value, at, count[at] + 1
        while done < n:
            done = self._close(word, done, best, start, count, single, unknown)
        return count[n]

    @staticmethod
    def _close(word, done, best, start, count, single, unknown) -> int:
        """All pieces that end after character ``done`` are known: let an unknown character compete last."""
        if word[done] not in single:
            value = best[done] + unknown
            if start[done + 1] < 0 or value > best[done + 1]:
                best[done + 1], start[done + 1] = value, done
                count[done + 1] = count[done] + len(word[done].encode("utf-8", "surrogatepass"))
        return done + 1

    def texts(self, texts: list[str]) -> np.ndarray:
        words, ends = [], []
        for text in texts:
            if text:
                text = text.replace(" ", SPACE)
                words += (text[1:] if text.startswith(SPACE) else text).split(SPACE)
            ends.append(len(words))
        if len(self.counts) > self.limit:
            self.counts = {}
        n = np.fromiter(map(self.counts.get, words, repeat(-1)), np.int64, len(words))
        for k in np.flatnonzero(n < 0):
            w = words[k]
            if w not in self.counts:
                self.counts[w] = self.word(SPACE + w)
            n[k] = self.counts[w]
        total = np.concatenate([[0], np.cumsum(n)])
        return np.diff(total[np.concatenate([[0], ends]).astype(np.int64)])


def token_counts(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` of every row; null and empty texts have none; repeated rows are all kept."""

    def fn(batch):
        if vocabulary not in _known:
            _known[vocabulary] = PieceCounter(unigram_vocabulary(vocabulary))
        counter, out, part, size = _known[vocabulary], [], [], 0
        for value in batch.column(1):
            part.append(value.as_py() or "")
            size += len(part[-1])
            if size > 2_000_000:
                out.append(counter.texts(part))
                part, size = [], 0
        out.append(counter.texts(part))
        yield {"doc_id": batch.column(0), "n_tokens": np.concatenate(out)}

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    return map_batches(rows, fn, "doc_id long, n_tokens long")
