"""SentencePiece (BPE) encoding and decoding over a table of prefixes.

For every prefix of a text the last token of its encoding is unique. A token that an automaton finds ending at position
i is that last token of prefix i if it goes together with the last token of the prefix before it, that is, if merging
their joined text would give exactly these two. So one pass over the matches fills the table; ids are read off backwards.

Whether two tokens go together: merging proceeds in the order of ranks, so the tokens that lie at the common border at
any moment are the right edge of the first token's merge tree and the left edge of the second's. If some pair of them
that lives at the same moment forms a token before both have merged away, the border doesn't hold.

Texts are cut where no piece reaches across (before a word mark that follows another character, around characters outside
the vocabulary, which become bytes, before a sign that no piece joins to a letter). Many texts at once are cut by Arrow; every
distinct word of them is encoded once, and the texts' ids are gathered from the words' own. Texts of other kinds go word by
word through a bounded cache.

Nulls: a null text is empty: no ids, empty decoding; a null doc_id stays null. Repeated rows are encoded like any other.
"""

from __future__ import annotations

import functools
import hashlib
import re
import string
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import GROUP_ROWS, groups, map_arrow, runs, texts

MARK = "▁"
CACHE_WORDS = 400_000
#: Longer stretches aren't kept.
CACHE_CHARS = 48
#: UTF-8 bytes of the texts whose distinct words are found together; a longer text is encoded alone.
GROUP_BYTES = 8 << 20
#: Stands where a text is cut within a word; texts that hold it are encoded alone.
_WITHIN = "\v"
#: Texts that aren't cut together: marks of their own, runs of marks, no words (for Arrow's expressions).
_ALONE = rf"\A\z|\A |  |{MARK}|{_WITHIN}"
_NEVER = 1 << 60


class PieceModel:
    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        normal = [i for i in range(len(self.pieces)) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        order = sorted(normal, key=lambda i: -lib.get_score(i))
        self.rank = {i: r for r, i in enumerate(order)}
        self.id_of = {self.pieces[i]: i for i in normal}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        if lib.normalize("a  b") != f"{MARK}a{MARK}{MARK}b" or lib.normalize("ﬁ\t") != f"{MARK}ﬁ\t":
            raise ValueError("only models without normalization, with a leading mark and kept white space")
        self.chars = {p for p in self.id_of if len(p) == 1}
        joined = {p[i + 1] for p in self.id_of for i in range(len(p) - 1) if p[i].isalpha()}
        signs = "".join(c for c in self.chars if c in string.punctuation and c not in joined)
        self.sign = rf"(\pL)([{re.escape(signs)}])" if signs else None
        self.inner = inner = any(MARK in p.lstrip(MARK) for p in self.id_of)
        # without pieces that go on after a word into a mark, words are encoded alone
        self.cut = re.compile("\n|[^\n]+" if inner else f"\n|{MARK}*[^{MARK}\n]+|{MARK}+").findall if "\n" not in self.chars else re.compile("[\\s\\S]+" if inner else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.halves: dict[int, tuple[int, int]] = {}
        whole = []
        for i in sorted(normal, key=lambda i: (len(self.pieces[i]), i)):
            if self._merges_to_itself(i):
                whole.append(i)
        # of each token beside its length: which tokens it goes together with after them, as far as that was asked
        self.after: dict[int, dict[int, bool]] = {i: {} for i in whole}
        self.n_after = 0
        automaton = ahocorasick.Automaton()
        for i in whole:
            automaton.add_word(self.pieces[i], (i, len(self.pieces[i]), self.after[i]))
        automaton.make_automaton()
        self.matches = automaton.iter
        self.rank_of = {self.pieces[i]: r for i, r in self.rank.items()}
        self.decimal = pa.array([str(i) for i in range(len(self.pieces))])
        # a byte below 128 is a character by itself; others must be decoded with those beside them
        self.shown = pa.array([p.replace(MARK, " ") if i not in self.byte_of else chr(self.byte_of[i]) if self.byte_of[i] < 128 else None for i, p in enumerate(self.pieces)])
        self.cache: dict[str, tuple[int, str, str]] = {}
        self._edge = {False: {}, True: {}}

    def _merges_to_itself(self, token: int) -> bool:
        """Merge the token's own text; keep its last merge. Some vocabularies have tokens that merging never makes."""
        parts = [self.id_of.get(c) for c in self.pieces[token]]
        if None in parts:
            return False
        while len(parts) > 1:
            best = at = None
            for k in range(len(parts) - 1):
                made = self.id_of.get(self.pieces[parts[k]] + self.pieces[parts[k + 1]])
                if made is not None and (best is None or self.rank[made] < self.rank[best]):
                    best, at = made, k
            if best is None:
                return False
            if len(parts) == 2:
                self.halves[token] = (parts[0], parts[1])
            parts[at : at + 2] = [best]
        return parts[0] == token

    def edge(self, token: int, left: bool) -> list[tuple[str, int, int]]:
        """(text of a token, when it is made, when it is merged away) down one edge of the merge tree."""
        known = self._edge[left].get(token)
        if known is None:
            known, dies = [], _NEVER
            at = token
            while True:
                born = self.rank[at] if at in self.halves else -1
                known.append((self.pieces[at], born, dies))
                if at not in self.halves:
                    break
                at, dies = self.halves[at][0 if left else 1], born
            self._edge[left][token] = known
        return known

    def _border_holds(self, first: int, second: int) -> bool:
        for a, born_a, dies_a in self.edge(first, False):
            for b, born_b, dies_b in self.edge(second, True):
                made = self.rank_of.get(a + b)
                if made is not None:
                    when = max(made, born_a, born_b)
                    # of equal merges the left one goes first
                    if when < dies_a and when <= dies_b:
                        return False
        return True

    def fits(self, first: int, second: int) -> bool:
        known = self.after[second].get(first)
        if known is None:
            known = self._border_holds(first, second)
            if self.n_after >= 2_000_000:
                for row in self.after.values():
                    row.clear()
                self.n_after = 0
            self.n_after += 1
            self.after[second][first] = known
        return known

    def run_ids(self, text: str) -> list[int]:
        """Ids of a stretch of characters that are all in the vocabulary."""
        last: list[tuple[int, int, dict[int, bool]] | None] = [None] * len(text)
        fits = self.fits
        for end, found in self.matches(text):
            if last[end] is None:
                token, length, after = found
                if length > end:
                    last[end] = found
                elif (p := last[end - length]) is not None:
                    known = after.get(p[0])
                    if known or known is None and fits(p[0], token):
                        last[end] = found
        out, at = [], len(text) - 1
        while at >= 0:
            token, length, _ = last[at]
            out.append(token)
            at -= length
        out.reverse()
        return out

    def stretch_ids(self, text: str) -> list[int]:
        if self.chars.issuperset(text):
            return self.run_ids(text)
        out, run = [], []
        for c in text:
            if c in self.chars:
                run.append(c)
            else:
                out += self.run_ids("".join(run)) if run else []
                run = []
                out += [self.bytes[b] for b in c.encode()]
        return out + (self.run_ids("".join(run)) if run else [])

    def stretch(self, text: str) -> tuple[int, str, str]:
        known = self.cache.get(text)
        if known is None:
            ids = self.stretch_ids(text)
            known = (len(ids), ",".join(map(str, ids)), self.surface(ids))
            if len(text) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_WORDS:
                    self.cache.clear()
                self.cache[text] = known
        return known

    def surface(self, ids: list[int]) -> str:
        """The text of ids, marks as spaces, runs of bytes as UTF-8 (invalid ones as U+FFFD)."""
        parts, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            parts.append(self.pieces[i].replace(MARK, " "))
        return "".join(parts) + raw.decode("utf-8", "replace")

    def stretches(self, text: str) -> list[str]:
        return self.cut(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for s in self.stretches(text) for i in self.stretch_ids(s)]

    def decode(self, ids: list[int]) -> str:
        """Control ids are nothing; the leading mark that encoding adds goes."""
        return self.surface([i for i in ids if i > 2]).removeprefix(" ")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids in decimal, and the decoded ids, put together from the words' own."""
        found = list(map(self.stretch, self.stretches(text)))
        return sum(x[0] for x in found), ",".join([x[1] for x in found]), "".join([x[2] for x in found]).removeprefix(" ")

    def digests(self, column: pa.Array) -> list[tuple[int, bytes, bytes]]:
        """digest of every text of a column without nulls, as UTF-8."""
        n_bytes = pc.binary_length(column).to_numpy(zero_copy_only=False)
        alone = pc.match_substring_regex(column, _ALONE).to_numpy(zero_copy_only=False) | (n_bytes > GROUP_BYTES) | self.inner
        out: list = [None] * len(column)
        for i in np.flatnonzero(alone).tolist():
            n, ids, decoded = self.digest(column[i].as_py())
            out[i] = n, ids.encode(), decoded.encode()
        rest = np.flatnonzero(~alone)
        for group in groups(rest, n_bytes[rest], GROUP_BYTES):
            offsets, ids = self.gathered(column.take(pa.array(group)))
            decimal = pc.binary_join(pa.ListArray.from_arrays(offsets, self.decimal.take(ids)), ",").cast(pa.binary())
            shown = pc.binary_join(pa.ListArray.from_arrays(offsets, self.shown.take(ids)), "").cast(pa.binary())
            counts = np.diff(offsets.to_numpy()).tolist()
            for k, (i, n, d, text) in enumerate(zip(group.tolist(), counts, decimal.to_pylist(), shown.to_pylist(), strict=True)):
                if text is None:
                    text = self.surface(ids[offsets[k].as_py() : offsets[k + 1].as_py()].to_pylist()).encode()
                out[i] = n, d, text.removeprefix(b" ")
        return out

    def gathered(self, column: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(where each text's ids begin, all ids) of texts that can be cut together."""
        if self.sign:
            column = pc.replace_substring_regex(column, self.sign, rf"\1 {_WITHIN}\2")
        if "\n" not in self.chars:
            column = pc.replace_substring_regex(column, "\n([^\n ])", f"\n {_WITHIN}\\1")
        lists = pc.split_pattern(column, " ")
        words = lists.flatten().dictionary_encode()
        # words have a mark before them, what is cut within a word has none
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), f" {MARK}")[0]
        found = list(map(self.stretch_ids, f"{MARK}{joined}".replace(MARK + _WITHIN, "").split(" ")))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        own = np.fromiter(chain.from_iterable(found), np.int32, lengths.sum())
        which = words.indices.to_numpy()
        n = lengths[which]
        offsets = np.concatenate([[0], np.cumsum(n)])[lists.offsets.to_numpy()]
        return pa.array(offsets, pa.int32()), pa.array(runs(own, (np.cumsum(lengths) - lengths)[which], n))


@functools.cache
def piece_model(path: str) -> PieceModel:
    """One per Python worker."""
    return PieceModel(path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """Per document: number of ids, digests of the ids and of the text decoded from them; with_ids also ids and that text."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    types = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, sha = piece_model(model).digests, hashlib.sha256
        for batch in batches:
            rows = []
            for n, ids, decoded in digests(batch.column(1)):
                rows.append((n, sha(ids).hexdigest(), sha(decoded).hexdigest(), *([list(map(int, ids.split(b","))) if ids else [], decoded] if with_ids else [])))
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)

    return map_arrow(texts(docs), run, SCHEMA + ", ids array<int>, decoded string" * with_ids, GROUP_ROWS)
