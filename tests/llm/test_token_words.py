"""Whole texts by tiktoken, and rounds of the token shards' grammar that can't pay."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemill.llm import repair, words
from tidemill.llm.words import WordIds

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder() -> WordIds:
    return WordIds(PATH, "byte_bpe")


def test_new_words_are_encoded_and_not_kept(coder):
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcdeéß", k=rng.randint(2, 12))) + rng.choice(["", ".", ",\n", "'s"]).strip() for _ in range(3000))
    before = len(coder.cache)
    assert np.frombuffer(coder.ids(text), "<u2").tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert len(coder.cache) == before


def test_white_space_of_every_kind_is_the_librarys(coder):
    library, rng = Tokenizer.from_file(PATH), random.Random(3)
    parts = [" ", "  ", "   ", "\n", "\t", "\r\n", "\xa0", "\x85", "a", "Word", "it's", "'s", "'", "12", "², ", "...", "é", "ſ", "ƀ", "don't ", "x=1;", "\x1c", "\x00", "　", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, weights=[12, 2, 1, 2] + [1] * (len(parts) - 5) + [0.1], k=rng.randint(0, 14)))
        assert np.frombuffer(coder.ids(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_round_that_only_makes_symbols_wider_is_left_out(monkeypatch):
    # few pairs among many ids that share none: wider symbols cost more than these save
    rng, vocabulary = np.random.default_rng(1), 65_520
    pairs = rng.integers(0, vocabulary, (100, 2))
    ids = np.concatenate([rng.integers(0, vocabulary, 400_000), pairs[rng.permutation(np.repeat(np.arange(100), 30))].ravel()])
    starts, rounds, grouped = np.array([0, 30_000, len(ids)]), [], repair._grouped
    monkeypatch.setattr(repair, "_grouped", lambda *a: rounds.append(1) or grouped(*a))
    symbols, offsets, rules = repair.compress(ids, starts, vocabulary)
    left_out = len(rounds)
    assert np.array_equal(repair.expand(symbols, rules, repair.expansion_lengths(rules, vocabulary), vocabulary)[0], ids)
    rounds.clear()
    monkeypatch.setattr(repair, "_least_bytes", lambda *a: 0)
    same = repair.compress(ids, starts, vocabulary)
    assert left_out < len(rounds)
    assert all(np.array_equal(a, b) for a, b in zip((symbols, offsets, rules), same, strict=True))


def test_many_texts_cost_their_distinct_pieces(coder, monkeypatch):
    """Texts of few distinct words go to the merges once for each word, and give the library's ids."""
    rng, library = random.Random(9), Tokenizer.from_file(PATH)
    words = ["".join(rng.choices("abcdeéß", k=9)) + rng.choice(["", ".", ",\nx", "'s"]) for _ in range(50)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 400))) + rng.choice(["", " ", "\n"]) for _ in range(100)] + ["", " ", "\n", "a", " b "]
    taken, plain = [], coder.plain
    monkeypatch.setattr(coder, "plain", lambda text, special: taken.append(len(text)) or plain(text, special))
    before = len(coder.cache)
    found = coder.many(pa.array(texts))
    assert [np.frombuffer(b, "<u2").tolist() for b in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(taken) < sum(map(len, texts)) / 20 and len(coder.cache) == before


@pytest.mark.parametrize("group", [8 << 20, 60])
def test_many_texts_of_every_kind_are_the_librarys(coder, monkeypatch, group):
    library, rng = Tokenizer.from_file(PATH), random.Random(4)
    parts = [" ", "  ", "\n", "\t", "\v", "\r\n", "\xa0", "\x85", "a", "Word", "it's", "'s", "'", "12", "² ", "...", "é", "ſ", "ƀ", "İ", "don't ", "x=1;", "\x1c", "\x00", "　", "<|", "<|endoftext|>", "a" * 70]
    texts = ["".join(rng.choices(parts, weights=[20, 1, 1] + [0.5] * (len(parts) - 3), k=rng.randint(0, 14))) for _ in range(3000)]
    monkeypatch.setattr(words, "GROUP_BYTES", group)
    # a slice of a column, as batches are
    found = coder.many(pa.array(texts).slice(5, 2990))
    assert [np.frombuffer(b, "<u2").tolist() for b in found] == [library.encode(t, add_special_tokens=False).ids for t in texts[5:2995]]
    assert coder.many(pa.array([], pa.string())) == []


def test_whole_shards_expand_each_rule_once(monkeypatch):
    rng, rows = np.random.default_rng(6), []
    expand = repair.expand
    monkeypatch.setattr(repair, "expand", lambda symbols, *a: rows.append(len(symbols)) or expand(symbols, *a))
    phrases = [rng.integers(0, 500, rng.integers(1, 9)) for _ in range(60)]
    parts = [np.concatenate([*(phrases[k] for k in rng.integers(0, 60, 400)), [2]]).astype("<u2") for _ in range(50)]
    shard = repair.Shard(repair.written(list(range(50)), [len(p) for p in parts], np.concatenate(parts), 0, 500))
    assert (shard.all_ids() == np.concatenate(parts)).all() and rows == [len(shard.rules)] and len(shard.rules) < shard.n_symbols / 2
    # rules that are longer together than the ids: the symbols themselves are expanded
    run = np.tile(np.arange(7), 16).astype("<u2")
    shard = repair.Shard(repair.written([0], [len(run)], run, 0, 500))
    rows.clear()
    assert (shard.all_ids() == run).all() and (shard.lengths.sum() > len(run)) == (rows == [shard.n_symbols])
    empty = repair.Shard(repair.written([None], [0], np.zeros(0, "<u2"), 0, 500))
    assert not len(empty.all_ids())
