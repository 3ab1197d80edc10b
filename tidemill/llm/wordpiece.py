"""Counting word-piece tokens by a longest-match automaton, without building pieces.

A trie of the vocabulary has two roots, one for pieces that begin a word and one for pieces that go on. A node's failure
link leads to where matching goes on after the longest pieces of its text have been taken off, and its pops say how many
those are. A word's count is the sum of pops over the failure links taken; each character is looked at once, each link
shortens the text that is pending, so the time is linear. A word that can't be covered counts as one unknown token.

Nulls: a null text is empty and has no words; a null doc_id stays null. Repeated rows are counted like any other.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import map_arrow, texts

CACHE_WORDS = 700_000


class LongestMatch:
    def __init__(self, first: Iterable[str], more: Iterable[str]) -> None:
        """first: pieces at a word's beginning; more: pieces after that, both without any mark."""
        self.next: list[dict[str, int]] = [{}, {}]
        self.fail: list[int] = [-1, -1]
        self.pops = [0, 0]
        whole: set[int] = set()
        for root, pieces in ((0, first), (1, more)):
            for piece in pieces:
                at = root
                for c in piece:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        self.fail.append(-1)
                        self.pops.append(0)
                    at = self.next[at][c]
                if piece:
                    whole.add(at)
        queue = deque((root, c, v) for root in (1, 0) for c, v in self.next[root].items())
        while queue:  # breadth first, so links of shorter texts are there
            parent, c, v = queue.popleft()
            if v in whole:
                self.fail[v], self.pops[v] = 1, 1
            else:
                at, n = self.fail[parent], self.pops[parent]
                while at >= 0 and c not in self.next[at]:
                    n += self.pops[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[v], self.pops[v] = self.next[at][c], n
            queue.extend((v, d, w) for d, w in self.next[v].items())
        self.cache: dict[bytes, int] = {}

    def count(self, word: str) -> int:
        """Pieces of a word; -1 if it can't be covered."""
        step, fail, pops = self.next, self.fail, self.pops
        at = n = 0
        for c in word:
            while c not in step[at]:
                if fail[at] < 0:
                    return -1
                n += pops[at]
                at = fail[at]
            at = step[at][c]
        while at > 1:
            if fail[at] < 0:
                return -1
            n += pops[at]
            at = fail[at]
        return n

    def __missing__(self, word: bytes) -> int:
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        n = self.cache[word] = self.count(word.decode())
        return n


@functools.cache
def vocabulary(path: str, mark: str = "▁") -> LongestMatch:
    """The normal pieces of a SentencePiece file: those with the word mark begin words, the others go on."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
    return LongestMatch([p[1:] for p in pieces if p.startswith(mark) and mark not in p[1:]], [p for p in pieces if mark not in p])


SCHEMA = "doc_id long, n_words long, n_tokens long, n_unknown long"


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """Per document: words (runs without ASCII white space), word-piece tokens with 1 for each unknown word, unknown words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = vocabulary(model)
        for batch in batches:
            cols: list[list[int]] = [[], [], []]
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = text.split()
                try:
                    counts = list(map(automaton.cache.__getitem__, words))
                except KeyError:
                    known = automaton.cache
                    counts = [known[w] if w in known else automaton.__missing__(w) for w in words]
                unknown = counts.count(-1)
                cols[0].append(len(words))
                cols[1].append(sum(counts) + 2 * unknown)
                cols[2].append(unknown)
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return map_arrow(texts(docs), run, SCHEMA)
