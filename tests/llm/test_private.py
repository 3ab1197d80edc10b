"""Personal data: patterns against plain regular expressions, the field against exact sums, held-out documents and links."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import private, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, spans string, n_ip string"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: [int(c) for c in m[0] if c in "0123456789"]
    luhn = lambda d: sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def named(spans):
    return ",".join(f"{private.KINDS[k]}:{s}:{e}" for s, k, e in spans)


@pytest.fixture(scope="module")
def model():
    return private.trained()


def test_patterns():
    rng = random.Random(1)
    pieces = ["a", "b.c", "@", "@", ".", "-", "_%+", "12", "255", "256", "0001", "1.2.3.4", "+1", "+49 (30) 12-34", " ", "é", "4111 1111 1111 1111", "٣", "x@y.z", "\n", "(", "4242424242424242"]
    for _ in range(6000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 14)))
        assert private.base_spans(text) == plain(text), text


def test_long_texts_take_linear_time(model):
    for text in ("a" * 400_000, "a.b@" * 100_000, "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "at x dot " * 30_000):
        began = time.time()
        private.base_spans(text)
        assert time.time() - began < 5
    assert model.spans("word " * 200_000 + "anna.berg@firma.de " + "word " * 200_000, []) is not None


def test_message_passing_is_exact_on_trees(model):
    """Two chains with a link between them are a tree: marginals equal sums over all labellings."""
    rng = np.random.default_rng(3)
    graph = private.Graph([(i, i + 1) for i in range(7)], [[f"f{i}"] for i in range(7)], [-1] * 7, [(0, 1, 1), (1, 2, 0), (3, 4, 1), (4, 5, 0), (5, 6, 0), (2, 5, 3)])
    field = private.Field({f"f{i}": rng.standard_normal(private.LABELS).astype(np.float32) for i in range(7)}, rng.standard_normal((4, private.LABELS, private.LABELS)).astype(np.float32))
    field.pair[3] = (field.pair[3] + field.pair[3].T) / 2
    want = np.zeros((7, private.LABELS))
    for y in itertools.product(range(private.LABELS), repeat=7):
        score = sum(field.weights[f"f{i}"][y[i]] for i in range(7)) + sum(field.pair[k][y[a], y[b]] for a, b, k in graph.edges)
        want[range(7), y] += np.exp(score)
    assert np.allclose(field.marginals(graph), want / want.sum(axis=1, keepdims=True), atol=2e-3)
    graph.given[2] = 3
    assert field.marginals(graph)[2].argmax() == 3


def test_held_out_documents(model):
    """Of what the patterns leave, nine of ten are found; nothing is found that isn't there."""
    seen = Counter()
    for text, spans in private.labelled(250, 99):
        base = private.base_spans(text)
        got = model.spans(text, base)
        for s, k, e in spans:
            if not any(x <= s and e <= y for x, _, y in base):
                seen["all"] += 1
                seen["found"] += any(x < e and s < y and kind - 4 == k for x, kind, y in got)
        seen["wrong"] += sum(not any(x < e and s < y for s, _, e in spans) for x, _, y in got)
    assert seen["all"] > 150 and seen["found"] >= 0.9 * seen["all"] and seen["wrong"] <= 0.02 * seen["all"]


def test_distant_repeats_are_labelled_alike(model):
    """A bare number is none; the same digits are one, where the text has them as a telephone far away. Links alone tell."""
    far = "und so weiter " * 300
    bare = "nimm 6365550172 dort "
    assert model.spans(bare, []) == []
    text = f"tel +1 (636) 555-0172 {far}{bare}"
    found = model.spans(text, private.base_spans(text))
    assert [text[s:e] for s, k, e in found if k == 7] == ["6365550172"]
    other = f"tel +1 (231) 777-4242 {far}{bare}"
    assert model.spans(other, private.base_spans(other)) == []


def test_clean_texts_stay_clean(model):
    for text in ("", " \n", "In 2019 there were 1,200,345 people; see pages 12-19, section 3.4.1.", "Version 2.0 of 12.03.2020 costs 19.99 € (10 %).", "hash 9f86d081884c7d659a2feaa0c55ad015 at 10:45", "*** 1999 ### 42 $$$ 7 %%%", "Let us meet at noon at the bar.", "x = [1, 2, 3, 4, 5]; y = 3.14159"):
        assert model.spans(text, private.base_spans(text)) == [], text


def test_query(spark, model):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op12_private(spark, SF)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = plain(texts[r.doc_id] or "")
        kinds = Counter(k for _, k, _ in base)
        assert tuple(r)[1:6] == (*(kinds[k] for k in range(4)), hashlib.sha256(named(base).encode()).hexdigest())
        assert [x for x in r.spans.split(",") if not x.startswith("crf_")] == (named(base).split(",") if base or not r.spans else [])


def test_odd_rows(spark):
    call = "call 0231/7774242 now"
    rows = [(1, None), (2, ""), (None, "a@b.cd"), (None, None), (3, call), (3, call), (4, "x" * 200_000 + " 10.0.0.7"), (5, "é\x00🙂 +49 30 1234567 8")]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    got = private.scan(df).collect()
    assert sorted(((r.doc_id, r.spans) for r in got), key=str) == sorted([(1, ""), (2, ""), (None, "email:0:6"), (None, ""), (3, "crf_phone:5:17"), (3, "crf_phone:5:17"), (4, "ip:200001:200009"), (5, "phone:4:20")], key=str)
    assert private.scan(df.where("false")).collect() == []
