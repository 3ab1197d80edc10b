"""SentencePiece ids of many texts at once: each distinct word is encoded once, results are the library's."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from tidemill.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture
def model() -> pieces.PieceModel:
    return pieces.PieceModel(PATH)


def by_library(texts):
    ids = [LIB.encode(t) for t in texts]
    return [(len(x), ",".join(map(str, x)).encode(), LIB.decode(x).encode()) for x in ids]


def test_many_texts_cost_their_distinct_words(model, monkeypatch):
    rng = random.Random(5)
    stems = ["".join(rng.choices("abcdeéß", k=9)) for _ in range(60)]
    texts = [" ".join(rng.choice(stems) + rng.choice(["", "", ".", ",", ".\nX"]) for _ in range(300)) for _ in range(40)]
    encoded, looked_up, ids = [], [], model.stretch_ids
    monkeypatch.setattr(model, "stretch_ids", lambda t: encoded.append(t) or ids(t))
    monkeypatch.setattr(model, "stretch", lambda t: looked_up.append(t))
    assert model.digests(pa.array(texts)) == by_library(texts)
    # the stems, and the signs and lines between them: neither words with their signs nor texts
    assert len(encoded) < 80 and not looked_up


@pytest.mark.parametrize("group", [8 << 20, 50])
def test_many_texts_of_every_kind_are_the_librarys(model, monkeypatch, group):
    monkeypatch.setattr(pieces, "GROUP_BYTES", group)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\v", "▁", "a", "the", "Word", "é", "ß.", "ﬁ", "日本", "\U0001f600", "x.y", ").", "...", "e,", "12", "\x00", "\x7f", "\xa0", "　", "'s", "ing", "\r\n", "q" * 40]
    texts = ["".join(rng.choices(parts, weights=[16, 0.5, 3] + [0.6] * 3 + [1] * (len(parts) - 6), k=rng.randint(0, 14))) for _ in range(4000)]
    texts += ["", " ", "\n", " a", "a ", "\n a", "a \n", "a\n\n\nb", "a.\n", ".", "é" * 200, "a. b"]
    # a slice of a column, as batches are
    assert model.digests(pa.array(["x", *texts]).slice(1)) == by_library(texts)
    assert model.digests(pa.array([], pa.string())) == []


def test_ids_and_texts_beside_the_digests(spark):
    texts = ["some words. More", "", "日本 and\nmore", "two  spaces"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.ids, r.decoded) for r in pieces.encode(docs, PATH, with_ids=True).collect()}
    assert found == {i: (LIB.encode(t), LIB.decode(LIB.encode(t))) for i, t in enumerate(texts)}
