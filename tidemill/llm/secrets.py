"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two third-order models over the 64 + 4 characters of encoded strings, one of random strings and one of ordinary words and
identifiers, are counted from labelled samples; rarer contexts lean on shorter ones. Letters are counted without their case,
and whether a letter is upper is a chain of its own, so that one word teaches all its spellings. A run of such characters
falls into tokens at its separators. The neighbouring tokens with the largest total of log-likelihood ratios, less a little
for each token, are a secret if that total passes a threshold in nats: a short string must be the stranger, and ordinary
names around a key don't hide it.
There is no rule on which characters a secret must have: strings of letters alone are found as well. Digits alone are as
likely a number as a key and are left.

The labelled samples are random strings from a seeded generator, and as ordinary ones identifiers composed of common words,
and the words of public vocabularies, whose paths are a parameter. The model of these alone is `MarkovRatio.labelled`; it is
the same for every table. `MarkovRatio.of` adds the ordinary words of the whole corpus at hand: all words of letters that three
or more different texts share, but none that the labelled model holds for random by more than LEARNT_NATS: a key that many
texts repeat isn't learnt. Spark counts the words in all rows and the characters of all those words; what comes to the driver
is a number for each context, which the alphabet bounds and not the corpus. `store` and `load` keep a model for other tables.
Any other labelled (text, is_secret) pairs may be used.

Spans are code points, end exclusive. The model adds spans in what the patterns leave of a run; spans of patterns stay.
Nulls: a null text is empty and has no spans; a null doc_id stays null. Repeated rows are scanned like any other, each by
itself. Of tied token groups the first counts. An empty table gives an empty result. Long texts are scanned whole, in time
that grows with their length. Columns besides doc_id and text play no part in `scan`, however they are called; `redact`
keeps them.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import io
import random
import re
import string
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_IDS, discard, give_back, map_arrow, put, stash, texts

# The patterns of the three kinds.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "markov")
#: The least length of a run, or of what base spans leave of one, and of a secret: that of an assigned value.
LEAST = 8
#: Log-likelihood ratio from which tokens are a secret: ordinary words outnumber keys by far.
NATS = 20.0
#: What a token must add to the total, to be part of a secret.
TOKEN_NATS = 3.0
#: Different texts that must share a word, for it to be learnt.
SHARED = 3
#: Copies from which a text is broadcast where texts with copies are too many for it, so that no task gets all its rows.
MANY_COPIES = 4096
#: Rows of an Arrow batch of words.
WORD_ROWS = 20_000
#: A shared word that the labelled model scores higher than this isn't learnt: it is a repeated key rather than a word.
LEARNT_NATS = 26.0
#: Vocabularies of public tokenizers (a token and its rank in a line), whose words are labelled ordinary.
VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
#: Characters judged at a time.
CHUNK = 1 << 20

ALPHABET = string.ascii_letters + string.digits + "+/_=-"
_SEPARATORS = "+/_=-"
# Ordinary words of identifiers.
WORDS = (
    "account action active address after album amount answer array author average backup balance before binary block body border buffer "
    "button cache call catalog center change channel check child class clean client close cloud code column command comment commit common "
    "config connect content context control copy count country create current customer data date debug default delete detail device dialog "
    "direct display document domain draft driver edit email empty enable encode engine entry error event example export factory field file "
    "filter first folder format frame function group handle handler header height history image import index info init input insert item key "
    "label language last layout length level library limit line link list load local location lock login main manager master match member "
    "memory message method model module monitor name network node note number object offset open option order output owner package page panel "
    "parent parse path pattern payment point policy position price print process product profile project property provider public query queue "
    "random range read record region release remote remove render report request reset resource response result return role root route row "
    "sample save schema score screen script search section select send server service session set setting shape share shift size sort source "
    "stack start state status step stop storage store stream string style submit summary switch symbol system table target task template test "
    "text theme thread time title total track transfer tree trigger type update upload user valid value vector version video view visible "
    "wait width window word work write zone the and for with from that this into over under between through information international "
    "development environment organization communication responsibility understanding entwicklung verbindung gesellschaft nachricht "
    "einstellungen bibliothek connaissance gouvernement enseignement desarrollo informaci conocimiento administraci"
).split()


def samples(n: int = 12_000, seed: int = 7, words: Iterable[str] = WORDS) -> Iterator[tuple[str, bool]]:
    """n labelled strings of either kind; the same for the same seed."""
    rng, words = random.Random(seed), list(words)
    both = string.ascii_letters
    alphabets = (both + string.digits, both + string.digits + "+/", "0123456789abcdef", "0123456789ABCDEF", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, both + string.digits + "_-", both, string.ascii_lowercase, string.ascii_uppercase)
    for i in range(n):
        yield "".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(12, 64))), True
        some = rng.choices(words, k=rng.randint(1, 7))
        style = i % 9
        if style == 0:
            some = some[:1] + [w.capitalize() for w in some[1:]]
        elif style == 1:
            some = [w.upper() for w in some]
        elif style == 2:
            some = [*some, str(rng.randint(0, 2030))]
        elif style == 7:
            some = [w.capitalize() for w in some]
        elif style == 8:  # numbers: telephones, cards, dates, times
            some = ["".join(rng.choices(string.digits, k=rng.choice((2, 4, 8, 10, 13, 16)))) for _ in some]
        yield ("" if style in (0, 3, 7) else "_" if style in (1, 2, 4) else "-" if style in (5, 8) else "/").join(some), False


def vocabulary_words(paths: Iterable[str]) -> list[str]:
    """Words of three or more letters that begin a token of the vocabularies, once each."""
    found = set()
    for path in paths:
        with open(path, "rb") as f:
            found.update(m[1].decode() for m in (re.fullmatch(rb" ([A-Za-z]{3,})", base64.b64decode(line.split()[0])) for line in f) if m)
    return sorted(found)


def ordinary_words(docs: DataFrame) -> DataFrame:
    """(word, n): every word of letters that SHARED or more different texts of docs have in common, and the number of these texts.

    Copies of a text count as one: each counts for its share of them.
    """
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    copies = stash(rows.groupBy("hash").agg(F.count("*").alias("copies")).where("copies > 1"))
    n = F.lit(1)
    if copies.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        parts = [F.broadcast(copies)]
    else:
        parts = [F.broadcast(copies.where(F.col("copies") >= MANY_COPIES)), copies.where(F.col("copies") < MANY_COPIES).hint("merge")]
    for i, part in enumerate(parts):
        rows = rows.join(part.withColumnRenamed("copies", f"copies{i}"), "hash", "left")
        n = F.coalesce(F.col(f"copies{i}"), n)
    words = rows.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z]{2,})"), F.lit(1)))).alias("word"), (1 / n).alias("share"))
    out = stash(words.groupBy("word").agg(F.round(F.sum("share")).cast("long").alias("n")).where(F.col("n") >= SHARED))
    discard(copies)
    return out


def _identifier(word: str) -> str:
    """An identifier of the word and one of WORDS; the same for the same word."""
    h = zlib.crc32(word.encode())
    some, style = [word, WORDS[h // 8 % len(WORDS)], word], h % 8
    if style in (1, 5):
        some = [w.capitalize() for w in some]
    elif style == 2:
        some = [w.upper() for w in some]
    elif style == 0:
        some[1:] = [w.capitalize() for w in some[1:]]
    return ("" if style in (0, 1, 3) else "_" if style in (2, 4) else "-" if style in (5, 6) else "/").join(some)


def learnt(words: DataFrame, labelled: MarkovRatio) -> Counts:
    """The contexts in all words (word, n), alone in every case as often as n counts (by powers of two), and once in an identifier.

    Those that the labelled model scores above LEARNT_NATS stay out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CELLS + _CASES, np.int64)
        for batch in batches:
            some: dict[int, list[str]] = {1: []}
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if labelled.score(word) <= LEARNT_NATS:
                    some.setdefault(n.bit_length(), []).extend((word, word.upper(), word.capitalize()))
                    some[1].append(_identifier(word))
            for times, forms in some.items():
                if forms:
                    total += times * np.concatenate(_counted(forms, labelled.place))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    found = map_arrow(words, run, "cell long, n long", WORD_ROWS).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(_CELLS + _CASES, np.int64)
    total[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return total[:_CELLS], total[_CELLS:]


# Codes of characters without their case, one more for what lies outside, and whether a character is a lower or upper letter or neither.
_PLAIN = sorted({c.lower() for c in ALPHABET})
_FOLD = np.array([0, *(_PLAIN.index(c.lower()) + 1 for c in ALPHABET)], np.int32)
_CASE = np.array([0, *(1 if c.islower() else 2 if c.isupper() else 3 for c in ALPHABET)], np.int32)
#: A place in these for each Latin-1 character.
_PLACE = np.zeros(256, np.int32)
_PLACE[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)
#: Four characters without their case, and three cases, as one number each.
_CELLS, _CASES = (len(_PLAIN) + 1) ** 4, 64
#: How often each of these was seen.
Counts = tuple[np.ndarray, np.ndarray]


@dataclass
class MarkovRatio:
    """log P(next | those before, random) - log P(next | those before, ordinary); a run's first characters follow nothing.

    table has the ratio of a character without its case after three others, cases that of a letter's case after two.
    """

    place: np.ndarray
    table: np.ndarray
    cases: np.ndarray
    threshold: float = NATS

    @staticmethod
    def train(labelled: Iterable[tuple[str, bool]], lean: float = 4.0) -> MarkovRatio:
        """Counts of a context are joined by those of the next shorter one, as if it had been seen lean times more."""
        parts: dict[bool, list[str]] = {True: [], False: []}
        for text, secret in labelled:
            parts[bool(secret)].append(text)
        return MarkovRatio.fitted({secret: _counted(some, _PLACE) for secret, some in parts.items()}, lean)

    @staticmethod
    def fitted(counts: dict[bool, Counts], lean: float = 4.0) -> MarkovRatio:
        """From the counts in random (True) and ordinary strings."""
        k = len(_PLAIN) + 1
        logs, cases = {}, {}
        for secret, (n, m) in counts.items():
            some = [n.reshape(k, k, k, k).astype(np.float32)]
            while some[-1].ndim > 1:
                some.append(some[-1].sum(axis=0))
            chance = (some[-1] + 1) / (some[-1].sum() + k)
            for c in some[-2::-1]:
                chance = (c + lean * chance) / (c.sum(axis=-1, keepdims=True) + lean)
            logs[secret] = np.log(chance)
            m = m.reshape(16, 4).astype(float)[:, 1:3]
            cases[secret] = np.log((m + 1) / (m.sum(axis=1, keepdims=True) + 2))
        ratio = logs[True] - logs[False]
        ratio[..., 0] = 0
        case = np.zeros((16, 4), np.float32)
        case[:, 1:3] = cases[True] - cases[False]
        return MarkovRatio(_PLACE, ratio.astype(np.float16).ravel(), case.ravel())

    @staticmethod
    def labelled(words: Iterable[str] = (), vocabularies: Iterable[str] | None = None) -> MarkovRatio:
        """Trained from `samples`, the words of vocabularies and such other words, alone and in identifiers."""
        words = list(words)
        return _labelled(_paths(vocabularies)) if not words else MarkovRatio.train(_training(_paths(vocabularies), words))

    @staticmethod
    def of(docs: DataFrame, vocabularies: Iterable[str] | None = None) -> MarkovRatio:
        """`labelled`, with the ordinary words of all of docs."""
        paths = _paths(vocabularies)
        words = ordinary_words(docs)
        more = learnt(words, _labelled(paths))
        discard(words)
        counts = {secret: _dense(*some) for secret, some in _labelled_counts(paths).items()}
        for some, n in zip(counts[False], more, strict=True):
            some += n
        model = MarkovRatio.fitted(counts)
        # the counts in all cells have been some ten times as large as the model
        del counts, more, some, n
        give_back()
        return model

    def store(self, folder: str, name: str = "secrets.npz") -> None:
        """Keep the model in a folder of the shared store; `load` reads it."""
        out = io.BytesIO()
        np.savez_compressed(out, place=self.place, table=self.table, cases=self.cases, threshold=self.threshold)
        put(folder, name, out.getvalue())

    @staticmethod
    def load(spark: SparkSession, folder: str, name: str = "secrets.npz") -> MarkovRatio:
        with np.load(io.BytesIO(bytes(spark.read.format("binaryFile").load(f"{folder}/{name}").first().content))) as parts:
            return MarkovRatio(parts["place"], parts["table"], parts["cases"], float(parts["threshold"]))

    def ratios(self, p: np.ndarray) -> np.ndarray:
        """Of each place in the codes; 0 outside runs."""
        f, c, k = _FOLD[p], _CASE[p], len(_PLAIN) + 1
        return self.table[_contexts(f, 3, k) * k + f].astype(np.float32) + self.cases[_contexts(c, 2, 4) * 4 + c]

    def score(self, run: str) -> float:
        """A string's total, as it stands."""
        return float(self.ratios(_codes(run, self.place)).sum(dtype=float))

    def secret(self, run: str) -> bool:
        """Whether a string as it stands is one."""
        return len(run) >= LEAST and self.score(run) >= self.threshold


def _paths(vocabularies: Iterable[str] | None) -> tuple[str, ...]:
    return tuple(map(public_tokenizers.path, VOCABULARIES) if vocabularies is None else vocabularies)


def _training(paths: tuple[str, ...], words: list[str]) -> Iterator[tuple[str, bool]]:
    known = vocabulary_words(paths)
    yield from samples(36_000)
    for some in (known, words):
        if some:
            yield from (x for x in samples(seed=8, words=some) if not x[1])
    for x in (*known, *words, *WORDS * 8):
        yield from ((w, False) for w in (x, x.upper(), x.capitalize()))


@functools.cache
def _labelled_counts(paths: tuple[str, ...]) -> dict[bool, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of random and ordinary labelled strings: the contexts seen, how often, and cases; the same for every table, so kept."""
    parts: dict[bool, list[str]] = {True: [], False: []}
    for text, secret in _training(paths, []):
        parts[secret].append(text)
    out = {}
    for secret, some in parts.items():
        n, cases = _counted(some, _PLACE)
        at = np.flatnonzero(n)
        out[secret] = at, n[at], cases
    return out


def _dense(at: np.ndarray, n: np.ndarray, cases: np.ndarray) -> Counts:
    out = np.zeros(_CELLS, np.int64)
    out[at] = n
    return out, cases.copy()


@functools.cache
def _labelled(paths: tuple[str, ...]) -> MarkovRatio:
    return MarkovRatio.fitted({secret: _dense(*some) for secret, some in _labelled_counts(paths).items()})


def _counted(some: list[str], place: np.ndarray) -> Counts:
    """How often each character follows each three others in the strings, and each letter's case each two."""
    k = len(_PLAIN) + 1
    p = _codes("\n".join(["", *some]), place)
    f, c = _FOLD[p], _CASE[p]
    n = np.bincount(_contexts(f, 3, k) * k + f, minlength=_CELLS)
    n.reshape(-1, k)[:, 0] = 0
    cases = np.bincount(_contexts(c, 2, 4) * 4 + c, minlength=_CASES)
    cases[::4] = 0
    return n, cases


def _codes(text: str, place: np.ndarray) -> np.ndarray:
    """A number for each code point, 0 for those outside the alphabet."""
    return place[np.frombuffer(text.encode("latin-1", "replace").replace(b"?", b" "), np.uint8)]


def _contexts(p: np.ndarray, order: int, k: int) -> np.ndarray:
    """The order codes (below k) before each place as one number; what lies before a code 0 doesn't count."""
    out, last, times = np.zeros_like(p), None, 1
    for back in range(1, order + 1):
        one = np.zeros_like(p)
        one[back:] = p[:-back]
        if last is not None:
            one[last == 0] = 0
        out += times * one
        last, times = one, times * k
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the patterns: leftmost, not overlapping within a kind, too short ones dropped."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _best(scores: list[float]) -> tuple[float, int, int]:
    """(total, begin, end) of the neighbouring scores with the largest total; of equal ones the first."""
    best, total, begin = (0.0, 0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best[0]:
            best = (total, begin, i + 1)
    return best


def _judged(p: np.ndarray, model: MarkovRatio) -> list[tuple[int, int]]:
    """(start, end) of the secrets in codes."""
    inside = np.concatenate([[False], p > 0, [False]])
    begins, ends = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    long = ends - begins >= LEAST
    if not long.any():
        return []
    ratios = model.ratios(p)
    # a token begins with a run, and with a separator; one sum for each
    least = min(model.place[ord(c)] for c in _SEPARATORS)
    mark = p >= least
    mark[begins] = True
    begins, ends = begins[long], ends[long]
    at = np.flatnonzero(mark)
    sums = np.add.reduceat(ratios.astype(float), at)
    first, last = np.searchsorted(at, begins), np.searchsorted(at, ends)
    total = np.concatenate([[0], np.cumsum(np.maximum(sums, 0))])
    out = []

    def judge(i: int, j: int, end: int) -> None:
        """The best tokens of at[i:j], then what is left on either side."""
        score, a, b = _best((sums[i:j] - TOKEN_NATS).tolist())
        if score < model.threshold:
            return
        start, stop = int(at[i + a]), int(at[i + b]) if i + b < j else end
        judge(i, i + a, start)
        if stop - start >= LEAST:
            out.append((start + (p[start] >= least and stop - start > LEAST), stop))
        judge(i + b, j, end)

    for k in np.flatnonzero(total[last] - total[first] >= model.threshold):
        judge(int(first[k]), int(last[k]), int(ends[k]))
    return out


def model_spans(texts_: list[str], model: MarkovRatio, base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """For each text (start, kind's place in KINDS, end) of what the model finds in runs, and in the parts of runs that its base spans leave."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts_]
    cuts, held = [0], 0
    for i, t in enumerate(texts_):
        held += len(t)
        if held > CHUNK and i > cuts[-1]:
            cuts.append(i)
            held = len(t)
    for first, last in zip(cuts, [*cuts[1:], len(texts_)], strict=True):
        p = _codes("\n".join(texts_[first:last]), model.place)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts_[first:last])])
        for n, spans in enumerate(base[first:last]):
            for s, _, e in spans:
                p[starts[n] + s : starts[n] + e] = 0
        found: list[tuple[int, int]] = []
        at = 0
        while at < len(p):  # a very long text in parts that end between runs
            end = min(at + CHUNK, len(p))
            while end < len(p) and p[end]:
                end += 1
            found += [(at + s, at + e) for s, e in _judged(p[at:end], model)]
            at = end
        for n, spans in groupby(found, key=lambda x: int(np.searchsorted(starts, x[0], "right")) - 1):  # noqa: B023
            out[first + n] = [(int(s - starts[n]), 3, int(e - starts[n])) for s, e in spans]
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, model: MarkovRatio | None = None) -> DataFrame:
    """Per document: counts by pattern, a digest of the patterns' spans, and all spans with the model's."""
    model = model or MarkovRatio.of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            some = batch.column(1).to_pylist()
            bases = [base_spans(t) for t in some]
            for base, more in zip(bases, model_spans(some, model, bases), strict=True):
                kinds = [k for _, k, _ in base]
                for c, v in zip(cols, (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + more))), strict=True):
                    c.append(v)
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_arrow(texts(docs), run, SCHEMA)


def redact(docs: DataFrame, mark: str = "[SECRET]", model: MarkovRatio | None = None) -> DataFrame:
    """docs with every span of their texts replaced by mark (overlapping spans by one); rows and other columns as they are.

    n_chars alone follows the text, where docs have it as a whole number. A null text stays null.
    """
    model = model or MarkovRatio.of(docs)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, given = [], batch.column(place).to_pylist()
            some = [t or "" for t in given]
            bases = [base_spans(t) for t in some]
            for text, base, more in zip(given, bases, model_spans(some, model, bases), strict=True):
                parts, at = [], 0
                for s, _, e in sorted(base + more):
                    if s >= at:
                        parts += [text[at:s], mark]
                    at = max(at, e)
                out.append(text if not parts else "".join([*parts, text[at:]]))
            arrays = batch.columns
            arrays[place] = pa.array(out, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    out, types = map_arrow(docs, run, docs.schema), dict(docs.dtypes)
    whole = types.get("n_chars") in ("tinyint", "smallint", "int", "bigint")
    return out.withColumn("n_chars", F.length("text").cast(types["n_chars"])) if whole else out
