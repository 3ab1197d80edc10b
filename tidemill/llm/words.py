"""Exact token ids by two public vocabularies, with a bounded word cache in front of the libraries.

Both vocabularies first split a text into words and then encode each word alone, so a word's ids can be kept and
looked up. The split is done here by `re` with spelled-out classes for texts whose characters all lie below U+0180
(where those classes are complete); any other text goes to the library whole. Results equal the library's.

A text for 'byte_bpe' without white space after white space, which most texts are, is split and encoded by tiktoken, with the
same classes and merges; new words then cost no more than known ones, and nothing is kept. Many such texts at once are cut before
their spaces by Arrow, every distinct piece is encoded once, and the texts' ids are gathered from the pieces' own.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import groups, runs

#: Words kept per Python worker; the cache is emptied when full, which bounds its memory (about 200 bytes a word).
CACHE_WORDS = 700_000

# Letters, numbers and white space below U+0180 by Unicode.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0"
_TAILS = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_WORDS = f"{_TAILS}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+"
#: White space after white space: only there must a split look ahead.
_RUN = re.compile(f"[{_S}][{_S}]")

#: UTF-8 bytes of the texts whose distinct pieces are found together; a longer text is encoded alone. Bounds what gathering takes.
GROUP_BYTES = 8 << 20
#: A white space character between pieces that are encoded together: never part of a longer token. Texts that hold it are encoded alone.
_BETWEEN = "\v"

#: Characters for which the classes above don't hold, or whose lower case depends on more than themselves.
_FOREIGN = re.compile("[^\x00-įı-ſ]")
#: Where any of these is found a text isn't cut at its spaces (for Arrow's expressions).
_ALONE = f"[^\\x00-įı-ſ]|[{_S}][{_S}]|{_BETWEEN}|<\\|"


class WordIds:
    """ids(text) as little-endian unsigned 16-bit bytes. kind: 'word_bpe' (lower case, white space dropped) or 'byte_bpe'."""

    def __init__(self, path: str, kind: str, cache_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.kind, self.cache, self.cache_words = kind, {}, cache_words
        self.tokenizer = Tokenizer.from_file(path)
        specials = [x["content"] for x in json.loads(self.tokenizer.to_str())["added_tokens"]]
        # the string of an added token in a text is that token for the library
        self.special = re.compile("|".join(map(re.escape, specials)), re.I) if specials else None
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids don't fit 16 bits")
        if kind == "word_bpe":
            self.split = re.compile(f"{_TAILS}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+").findall
        else:
            self.split = re.compile(f"{_BYTE_WORDS}|[{_S}]+(?![^{_S}])|[{_S}]+").findall
        self.piece, self.plain = _piece_encoder(path, self.kind)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def learn(self, words: list[str]) -> None:
        rest = []
        for w in words:
            ids = self.piece(w) if self.piece else None
            if ids is None:
                rest.append(w)
            else:
                self.cache[w] = array("H", ids).tobytes()
        if rest:
            for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                self.cache[w] = array("H", e.ids).tobytes()

    def ids(self, text: str) -> bytes:
        if not text.isascii() and _FOREIGN.search(text) or (self.special and "<|" in text and self.special.search(text)):
            return self.whole(text)
        if self.plain and not _RUN.search(text):
            return np.frombuffer(self.plain(text, set()), "=u4").astype("<u2").tobytes()
        words = self.split(text.lower() if self.kind == "word_bpe" else text)
        cache = self.cache
        try:
            return b"".join(map(cache.__getitem__, words))
        except KeyError:
            pass
        if len(cache) > self.cache_words:
            cache.clear()
        self.learn([w for w in set(words) if w not in cache])
        return b"".join(map(cache.__getitem__, words))

    def many(self, column: pa.Array) -> list[bytes]:
        """ids of every text of a column without nulls."""
        if not self.plain:
            return [self.ids(t) for t in column.to_pylist()]
        n_bytes = pc.binary_length(column).to_numpy(zero_copy_only=False)
        alone = pc.match_substring_regex(column, _ALONE).to_numpy(zero_copy_only=False) | (n_bytes > GROUP_BYTES)
        out: list[bytes] = [b""] * len(column)
        for i in np.flatnonzero(alone).tolist():
            out[i] = self.ids(column[i].as_py())
        rest = np.flatnonzero(~alone)
        for group in groups(rest, n_bytes[rest], GROUP_BYTES):
            for i, ids in zip(group.tolist(), self._gathered(column.take(pa.array(group))), strict=True):
                out[i] = ids
        return out

    def _gathered(self, column: pa.Array) -> list[bytes]:
        """Nothing but a space's own word reaches over it, so a text's ids are those of its pieces, each from one space to the next."""
        lists = pc.split_pattern(column, " ")
        offsets, pieces = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        which = pieces.indices.to_numpy()
        # a text's first piece has no space before it
        firsts = lists.flatten().take(pa.array(offsets[:-1])).to_pylist()
        others = pc.binary_join(pa.ListArray.from_arrays([0, len(pieces.dictionary)], pieces.dictionary), f"{_BETWEEN} ")[0].as_py()
        joined = _BETWEEN.join(["", *firsts, f" {others}", ""])
        ids = np.frombuffer(self.plain(joined, set()), "=u4").astype("<u2")
        marks = np.flatnonzero(ids == ids[-1])
        which = which + len(firsts)
        which[offsets[:-1]] = np.arange(len(firsts))
        n = np.diff(marks)[which] - 1
        out = runs(ids, marks[which] + 1, n).tobytes()
        at = (2 * np.concatenate([[0], np.cumsum(n)])[offsets]).tolist()
        return [out[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _piece_encoder(path: str, kind: str) -> tuple[Callable[[str], list[int] | None] | None, Callable[[str, set], bytes] | None]:
    """Ids of one word by the same merges through tiktoken, which is faster; None for a word it can't take. For 'byte_bpe' also
    the ids, as unsigned 32-bit numbers, of a whole text without white space after white space.

    tiktoken knows symbols of one byte only. For 'word_bpe' the last symbol of a word differs from the same byte within
    a word, so words of letters are recoded: one byte value for each (byte, is last) that lower-case letters below
    U+0180 need. Returns None where the file's merges aren't in the order of ids, on which tiktoken relies.
    """
    import tiktoken

    with open(path) as f:
        model = json.load(f)["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    tokens = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    order = [model["vocab"][t] for t in tokens]
    if order != sorted(set(order)):
        return None, None
    if kind == "byte_bpe":
        merged = set(tokens)
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if len(t) == 1 or t in merged}
        core = tiktoken.Encoding("bytes", pat_str=f"{_BYTE_WORDS}|[{_S}]", mergeable_ranks=ranks, special_tokens={})._core_bpe
        return lambda word: core.encode_single_piece(word.encode()), core.encode_to_tiktoken_buffer
    end, letters, tails = "</w>", list(range(97, 123)), list(range(0x80, 0xC0))
    code = {(b, False): i for i, b in enumerate([*letters, *tails, *range(0xC2, 0xC6)])}
    code |= {(b, True): len(code) + i for i, b in enumerate([*letters, *tails])}
    ranks = {}
    for t, i in model["vocab"].items():
        last = t.endswith(end)
        symbols = [byte_of.get(c) for c in (t[: -len(end)] if last else t)]
        keys = [(b, last and k == len(symbols) - 1) for k, b in enumerate(symbols)]
        if keys and all(k in code for k in keys):
            ranks[bytes(code[k] for k in keys)] = i
    single = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    within = bytes(code.get((b, False), 255) for b in range(256))
    last = {b: bytes((i,)) for (b, at_end), i in code.items() if at_end}
    plain = re.compile("[a-z\xdf-\xf6\xf8-\u017f]+").fullmatch

    def recoded(word: str) -> list[int] | None:
        if not plain(word):
            return None
        b = word.encode()
        return single(b[:-1].translate(within) + last[b[-1]])

    return recoded, None


@functools.cache
def word_ids(path: str, kind: str, cache_words: int = CACHE_WORDS) -> WordIds:
    """One per Python worker."""
    return WordIds(path, kind, cache_words)
