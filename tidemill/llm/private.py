"""Personal data: fixed patterns, and a skip-chain conditional random field that labels what resembles or repeats them.

Tokens are runs of digits, runs of letters and single other characters, near anything that can be personal data: numbers,
`@`, a bracketed `at` or `dot`, and words of addresses that the document holds. All other tokens are no personal data.
Labels are OTHER and the four kinds. A token's features (shape, the number it is part of, words before it) give its
potentials, neighbouring tokens share others, and so do distant tokens that repeat each other: equal words or numbers, and
numbers that end in the same seven digits. Each occurrence is linked to the next one, never all to all. What the patterns
found has its label; loopy message passing carries that along chains and links until nothing changes. Neighbouring tokens
whose most probable label is the same kind, surely enough, are a span, unless too little of them is left to be one.

The weights maximise the pseudo-likelihood (each token given its neighbours) of documents that a seeded generator makes:
numbers, addresses and cards in many ways of writing, repeated in others, among dates, prices, versions, orders and keys.

Spans are code points, end exclusive. The field adds spans in what the patterns leave; these are named crf_ and their kind.
Nulls: a null text is empty and has no spans; a null doc_id stays null. Repeated rows are scanned each by itself. An empty
table gives an empty result. Texts are scanned whole, in time that grows with their length; in a text with more than PIECE
tokens near numbers, links don't reach from one piece of so many tokens into the next. Of equally probable labels the first
counts, OTHER before the kinds. Columns besides doc_id and text play no part, however they are called.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import map_arrow, texts

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The patterns. A domain behind an @; numbers that begin where a run of digits does, since a later start fails alike.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[Span]:
    """From each @ outwards: the same matches as by the pattern from left to right, in linear time."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, 0, m.end()
            done = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """(start, kind's place in KINDS, end) of the patterns' matches: leftmost, not overlapping within a kind, failing ones dropped."""
    found = list(_emails(text))
    if not _DIGIT.search(text):
        return sorted(found)
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(m[0].count, "0123456789")) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# Tokens and their features

_TOKEN = re.compile(r"[0-9]+|[^\W0-9_]+|\S")
_ANCHOR = re.compile(r"[0-9]+|@|[\[({<]\s?(?:at|dot|punkt|punto|arroba|point)\s?[\])}>]|\b(?:at|arroba)\s[^\W_]{2,30}\s(?:dot|punkt|punto|point)\b", re.I)
_WORD = re.compile(r"[^\W0-9_]{4,}")
_ADDRESS = re.compile(r"[^\W0-9_]\s?[@._\-\[({<]|\b(?:at|arroba)\b", re.I)
_JOINT = re.compile(r"[ ().\-/]{1,3}")
#: Characters around an anchor that belong to its surroundings.
CONTEXT = 48
#: Tokens judged in one graph, links within it.
PIECE = 1_000_000
# Words that tell what a number or name is.
_CUES = {
    "phone": "tel phone telephone call calls fax mobile cell telefon telefono teléfono téléphone handy anrufen móvil movil llamar appeler whatsapp sms reach dial hotline",
    "mail": "mail email e-mail contact write kontakt correo courriel schreiben address",
    "ip": "ip host server ping gateway client dns login router",
    "card": "card visa mastercard amex karte carte tarjeta credit kreditkarte debit paid charged",
    "number": "order invoice page pages chapter version isbn year total price eur usd kg km section id item build line no nr number euros dollars seite bestellung rechnung página pedido commande ticket serial account population about",
    "at": "at arroba",
    "dot": "dot punkt punto point",
    "end": "com org net de fr es uk info io edu",
}
_CUE = {w: k for k, words in _CUES.items() for w in words.split()}


def _size(n: int) -> str:
    return str(n) if n <= 4 else "5-6" if n <= 6 else "7-9" if n <= 9 else "10-13" if n <= 13 else "14-19" if n <= 19 else "20"


@dataclass
class Graph:
    """Tokens (start, end), their features, the labels that are given (-1: none), and edges by kind: 0 apart, 1 in a number or glued, 2 linked as equal words, 3 as numbers."""

    at: list[tuple[int, int]] = field(default_factory=list)
    features: list[list[str]] = field(default_factory=list)
    given: list[int] = field(default_factory=list)
    edges: list[tuple[int, int, int]] = field(default_factory=list)


def covered(at: Sequence[tuple[int, int]], spans: Sequence[Span], none: int = -1) -> list[int]:
    """The label of the first span that each token lies in. Spans of a kind are in order and don't overlap."""
    out = [none] * len(at)
    for kind in reversed(range(len(KINDS))):
        own = [(s, e) for s, k, e in spans if k == kind]
        i = 0
        for n, (s, e) in enumerate(at):
            while i < len(own) and own[i][1] < e:
                i += 1
            if i < len(own) and own[i][0] <= s:
                out[n] = kind + 1
    return out


def _surroundings(text: str, base: Sequence[Span]) -> list[tuple[int, int]]:
    """Parts of the text around anchors, ending between words where these aren't too long."""
    known = {w.casefold() for s, k, e in base if k == 0 for w in _WORD.findall(text[s:e])}
    spots = [m.span() for m in _ANCHOR.finditer(text)]
    if known:
        spots = sorted(spots + [m.span() for m in _WORD.finditer(text) if m[0].casefold() in known])
    out: list[tuple[int, int]] = []
    for s, e in spots:
        low, high = max(0, s - CONTEXT), min(len(text), e + CONTEXT)
        while low and not text[low - 1].isspace() and s - low < 2 * CONTEXT:
            low -= 1
        while high < len(text) and not text[high].isspace() and high - e < 2 * CONTEXT:
            high += 1
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _number_features(text: str, at: list[tuple[int, int]], words: list[str], group: list[int]) -> list[str]:
    """Features of a number, from its digit tokens (places in at) on the whole."""
    first, last = group[0], group[-1]
    parts = [words[i] for i in group if words[i][0].isdecimal()]
    digits = "".join(parts)
    size = _size(len(digits))
    joints = "".join(sorted(set(re.sub(r"[0-9]+", "", text[at[first][0] : at[last][1]]))))
    out = [f"size {size}", f"parts {min(len(parts), 6)}", f"joints {joints}", f"size {size} joints {joints}", f"parts {min(len(parts), 6)} size {size}"]
    if 14 <= len(digits) <= 19:
        out.append("luhn" if luhn(digits) else "no luhn")
    if len(parts) == 4 and all(map(_octet, parts)):
        out.append(f"octets {joints}")
    if len(parts) == 3 and joints in ("-", ".", "/") and max(map(len, parts)) <= 4 and len(digits) <= 8:
        out.append("date")
    if len(parts) == 1 and len(digits) == 4 and digits[:2] in ("18", "19", "20"):
        out.append("year")
    if digits[0] == "0":
        out.append("zero first")
    before = words[first - 1] if first else ""
    out.append(f"before {before}" if before in tuple("+($€£#=:-.,_@%/") else "before word" if before else "before none")
    if before and at[first - 1][1] == at[first][0] and (before.isalpha() or before == "_"):
        out.append("glued before")
    if last + 1 < len(at) and at[last + 1][0] == at[last][1]:
        after = words[last + 1]
        out.append("glued after" if after.isalpha() else f"after {after}" if after in tuple("%€$):/") else "after other")
    cues = {_CUE[w] for w in words[max(0, first - 6) : first] if w in _CUE}
    for c in sorted(cues & {"phone", "ip", "card", "number", "mail"}) or ["none"]:
        out += [f"cue {c}", f"cue {c} size {size}"]
    return out


def _add_part(text: str, low: int, high: int, base: Sequence[Span], graph: Graph, last_of: dict[str, int]) -> None:
    """Adds the tokens of text[low:high]; last_of holds the last token of each thing that can be repeated."""
    at = [(m.start(), m.end()) for m in _TOKEN.finditer(text, low, high)]
    words = [text[s:e].casefold() for s, e in at]
    n, first = len(at), len(graph.at)
    decimal = [text[s] in "0123456789" for s, _ in at]
    number: list[list[str] | None] = [None] * n
    key: list[str | None] = [None] * n
    i = 0
    while i < n:
        if not decimal[i]:
            i += 1
            continue
        group, j = [i], i
        while True:  # the next digits, if only joints lie between
            k = j + 1
            while k < n and k - j <= 3 and not decimal[k]:
                k += 1
            if k < n and decimal[k] and _JOINT.fullmatch(text, at[j][1], at[k][0]):
                group += range(j + 1, k + 1)
                j = k
            else:
                break
        shared = _number_features(text, at, words, group)
        for g in group:
            number[g] = shared
        digits = "".join(words[g] for g in group if decimal[g])
        if len(digits) >= 7:
            longest = max((g for g in group if decimal[g]), key=lambda g: (len(words[g]), -g))
            key[longest] = "tail " + digits[-7:]
        i = j + 1
    labels = covered(at, [b for b in base if b[2] > low and b[0] < high])
    for i in range(n):
        s, e = at[i]
        w = words[i]
        if number[i] is not None:
            kind = "digits" if decimal[i] else f"joint {w}"
            f = [kind, *(f"{kind[:6]} {x}" for x in number[i])]
            if decimal[i]:
                f.append(f"own {_size(len(w))}")
        else:
            before, after = words[i - 1] if i else "", words[i + 1] if i + 1 < n else ""
            glued = (i > 0 and at[i - 1][1] == s, i + 1 < n and e == at[i + 1][0])
            mark = lambda x: _CUE[x] if _CUE.get(x) in ("at", "dot", "end") else x if x and not x.isalnum() else "word" if x else "none"
            shape = mark(w)
            f = [f"shape {shape}", f"left {mark(before)} {glued[0]}", f"right {mark(after)} {glued[1]}", f"{shape} between {mark(before)} {mark(after)}", f"two left {mark(words[i - 2]) if i > 1 else ''} {mark(before)}", f"two right {mark(after)} {mark(words[i + 2]) if i + 2 < n else ''}"]
            if after and number[i + 1] is not None:
                f += [f"opens {shape} {x}" for x in number[i + 1]]
            if any(_CUE.get(x) == "mail" for x in words[max(0, i - 8) : i]):
                f += ["mail before", f"mail before {shape} {mark(before)} {mark(after)}"]
        graph.at.append((s, e))
        graph.features.append(f)
        graph.given.append(labels[i])
        here = first + i
        if i:
            close = number[i] is not None and number[i] is number[i - 1] or at[i - 1][1] == s
            graph.edges.append((here - 1, here, int(close)))
        names = [key[i]] if key[i] else []
        if not names and len(w) >= 4 and w.isalnum():
            names.append("same " + w)
        for name in names:
            if name in last_of:
                graph.edges.append((last_of[name], here, 3 if name[0] == "t" else 2))
            last_of[name] = here


def graphs(text: str, base: Sequence[Span]) -> Iterator[Graph]:
    """The text's tokens near anchors, as one graph, or as several of PIECE tokens."""
    graph = Graph()
    last_of: dict[str, int] = {}
    for part in _surroundings(text, base):
        step = CONTEXT * 4000
        for low in range(part[0], part[1], step):  # a very long stretch of numbers in parts
            _add_part(text, low, min(part[1], low + step), base, graph, last_of)
            if len(graph.at) >= PIECE:
                yield graph
                graph, last_of = Graph(), {}
    if graph.at:
        yield graph


# The field

LABELS = len(KINDS) + 1
ROUNDS = 40
#: The probability from which a token belongs to a kind.
SURE = 0.8


@dataclass
class Field:
    """weights: feature -> row of scores by label; pair: by kind of edge, a score for each two labels."""

    weights: dict[str, np.ndarray]
    pair: np.ndarray

    @staticmethod
    def train(labelled: Sequence[tuple[Graph, list[int]]], rounds: int = 160, rate: float = 0.15, ridge: float = 3e-4) -> Field:
        """By pseudo-likelihood: tokens whose label isn't given, each one given its neighbours' labels."""
        names: dict[str, int] = {}
        rows, cols, y, edges, free, base = [], [], [], [], [], 0
        for g, labels in labelled:
            for i, f in enumerate(g.features):
                for x in set(f):
                    rows.append(base + i)
                    cols.append(names.setdefault(x, len(names)))
            y += labels
            free += [x < 0 for x in g.given]
            edges += [(a + base, b + base, k) for a, b, k in g.edges]
            base += len(labels)
        y_, free_ = np.array(y), np.array(free, float)
        x = np.zeros((base, len(names)), np.float32)
        x[rows, cols] = 1
        a, b, kind = np.array(edges).T
        # how many neighbours of each label a token has, by kind of edge; a chain's two sides apart
        seen = np.zeros((base, 6, LABELS), np.float32)
        for k in (0, 1):
            np.add.at(seen, (b[kind == k], 2 * k, y_[a[kind == k]]), 1)
            np.add.at(seen, (a[kind == k], 2 * k + 1, y_[b[kind == k]]), 1)
        for p, q in ((a, b), (b, a)):
            for k in (2, 3):
                np.add.at(seen, (q[kind == k], 2 + k, y_[p[kind == k]]), 1)
        w, t = np.zeros((len(names), LABELS), np.float32), np.zeros((4, LABELS, LABELS), np.float32)
        moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
        true = np.eye(LABELS, dtype=np.float32)[y_]
        for step in range(1, rounds + 1):
            logits = x @ w
            for k in (0, 1):
                logits += seen[:, 2 * k] @ t[k] + seen[:, 2 * k + 1] @ t[k].T
            logits += seen[:, 4] @ t[2] + seen[:, 5] @ t[3]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            off = ((p - true) * free_[:, None] / free_.sum()).astype(np.float32)
            gw = x.T @ off + ridge * w / 10
            gt = np.stack([seen[:, 0].T @ off + (seen[:, 1].T @ off).T, seen[:, 2].T @ off + (seen[:, 3].T @ off).T, seen[:, 4].T @ off, seen[:, 5].T @ off]) + ridge * t / 200
            gt[2:] = (gt[2:] + gt[2:].transpose(0, 2, 1)) / 2  # a link has no direction
            for v, g, m, s in ((w, gw, *moments[:2]), (t, gt, *moments[2:])):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        return Field({n: w[i] for n, i in names.items()}, t)

    def marginals(self, graph: Graph) -> np.ndarray:
        """Each token's probabilities of the labels, by loopy message passing until they stay."""
        n = len(graph.at)
        none = np.zeros(LABELS, np.float32)
        node = np.array([sum((self.weights.get(x, none) for x in set(f)), none) for f in graph.features])
        given = np.array(graph.given)
        node[given >= 0] = np.where(np.eye(LABELS, dtype=bool)[given[given >= 0]], 0, -60)
        if not graph.edges:
            return _normal(node)
        a, b, kind = np.array(graph.edges).T
        order = np.argsort(kind, kind="stable")
        a, b, kind = a[order], b[order], kind[order]
        m = len(a)
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        psi = np.exp(self.pair - self.pair.max(axis=(1, 2), keepdims=True))
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        cuts = [(k, *np.searchsorted(kind, [k, k + 1])) for k in range(4)]
        messages = np.zeros((2 * m, LABELS))
        by = np.argsort(target, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(target[by]) > 0]))
        for _ in range(ROUNDS):
            belief = node.astype(float)
            belief[target[by][starts]] += np.add.reduceat(messages[by], starts)
            sent = _normal(belief[source] - messages[back])
            new = np.empty_like(messages)
            for k, low, high in cuts:
                new[low:high] = sent[low:high] @ psi[k]
                new[m + low : m + high] = sent[m + low : m + high] @ psi[k].T
            new = np.log(np.maximum(new, 1e-30))
            new -= new.max(axis=1, keepdims=True)
            change = float(np.abs(new - messages).max())
            messages = 0.7 * new + 0.3 * messages
            if change < 1e-3:
                break
        belief = node.astype(float)
        belief[target[by][starts]] += np.add.reduceat(messages[by], starts)
        return _normal(belief)

    def spans(self, text: str, base: Sequence[Span]) -> list[Span]:
        """(start, kind's place after the patterns' kinds, end) of what is found beside base."""
        out = []
        for g in graphs(text, base):
            if all(x >= 0 for x in g.given):
                continue
            p = self.marginals(g)
            best = p.argmax(axis=1)
            best[(p.max(axis=1) < SURE) | (np.array(g.given) >= 0)] = 0
            follows = {(x, y) for x, y, k in g.edges if k < 2 and y == x + 1}
            i = 0
            while i < len(best):
                j = i + 1
                while j < len(best) and best[i] and best[j] == best[i] and (j - 1, j) in follows:
                    j += 1
                if best[i]:
                    s, e = _trimmed(text, g.at[i][0], g.at[j - 1][1])
                    if _enough(text[s:e], int(best[i]) - 1):
                        out.append((s, int(best[i]) - 1 + len(KINDS), e))
                i = j
        return out


def _normal(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    """Without punctuation at the ends, but an opening + or bracket."""
    while s < e and not text[s].isalnum() and text[s] not in "+(":
        s += 1
    while e > s and not text[e - 1].isalnum():
        e -= 1
    return s, e


def _enough(found: str, kind: int) -> bool:
    """Whether so much is left that it can be one of its kind."""
    digits = sum(map(found.count, "0123456789"))
    return (len(found) >= 6 and bool(_ADDRESS.search(found)), digits >= 4 and len(re.findall("[0-9]+", found)) >= 4, digits >= 8, 7 <= digits <= 15)[kind]


# Documents to learn from

_NAMES = "anna berg carlos lopez marie dupont john smith sara klein peter novak julia weber omar haddad lena fischer pablo ruiz".split()
_HOSTS = "example mailbox company post firma correo server web campus studio".split()
_ENDS = "com org net de fr es info".split()


def labelled(n: int = 260, seed: int = 5) -> Iterator[tuple[str, list[Span]]]:
    """n documents and the true spans (start, kind's place in KINDS, end) in them; the same for the same seed."""
    rng, signs = random.Random(seed), ""
    digits = lambda k, first="": first + "".join(rng.choices("0123456789", k=k - len(first)))
    pick = rng.choice

    def word() -> str:
        w = "".join(pick(("ka", "lo", "ri", "the", "and", "en", "sch", "ung", "ción", "eau", "ous", "ing", "or", "at", "du", "el", "in", "st")) for _ in range(rng.randint(1, 4)))
        return w.capitalize() if rng.random() < 0.15 else w

    def noisy(w: str) -> str:
        """Some texts shout, and repeat signs after words."""
        return (w.upper() if signs == "!!" else w) + (pick(signs.split()) if signs else "")

    def prose(k: int) -> str:
        return " ".join(noisy(pick((word, word, word, lambda: pick("the at in of meet point com about to and de we no with for call order page write host server card year".split()), lambda: pick(_NAMES + _HOSTS)))()) for _ in range(k)) + pick((" ", ", ", ". ", ": ", " "))

    def card(valid: bool = True) -> str:
        body = digits(15, pick("3456"))
        return next(body + d for d in "0123456789" if luhn(body + d) == valid)

    def ways(kind: int, thing: tuple) -> list[str]:
        """Ways to write a thing, the patterns' first."""
        if kind == 0:
            a, b, host, end = thing
            return [f"{a}.{b}@{host}.{end}", f"{a}.{b} (at) {host}.{end}", f"{a}.{b}[at]{host}.{end}", f"{a} dot {b} at {host} dot {end}", f"{a}.{b} [at] {host} [dot] {end}", f"{a}.{b} {{at}} {host} {{dot}} {end}", f"{a}.{b} @ {host}.{end}"]
        if kind == 1:
            return [".".join(thing), " . ".join(thing), "-".join(thing), ".".join(thing)]
        c = thing[0]
        if kind == 2:
            return [" ".join(c[i : i + 4] for i in range(0, 16, 4)), c, ".".join(c[i : i + 4] for i in range(0, 16, 4)), "/".join(c[i : i + 4] for i in range(0, 16, 4)), f"{c[:4]} - {c[4:8]} - {c[8:12]} - {c[12:]}"]
        country, area, x, y = thing
        return [f"+{country} ({area}) {x}-{y}", f"+{country} {area} {x} {y}", f"({area}) {x}-{y}", f"0{area} {x}{y}", f"0{area}/{x}{y}", f"{area}-{x}-{y}", f"{area}.{x}.{y}", f"{area} {x} {y}", f"{area}{x}{y}", f"{x}{y}", f"{x} {y}", f"00{country} {area} {x} {y}"]

    def thing(kind: int) -> tuple:
        if kind == 0:
            return pick(_NAMES), pick(_NAMES), pick(_HOSTS), pick(_ENDS)
        if kind == 1:
            return tuple(str(rng.randint(1, 254)) for _ in range(4))
        if kind == 2:
            return (card(),)
        return digits(pick((1, 2)), pick("1234")), digits(3, pick("23456789")), digits(3, pick("23456789")), digits(4)

    def plain() -> str:
        """Numbers and names that are none of these."""
        k = rng.randint(0, 24)
        d, m, year = rng.randint(1, 28), rng.randint(1, 12), rng.randint(1850, 2049)
        made = (
            f"{year}", f"{d}.{m}.{year}", f"{year}-{m:02d}-{d:02d}", f"{d}/{m}/{year % 100:02d}", f"{d:02d}:{m:02d}", f"${d},{digits(3)}.{m:02d}", f"{digits(rng.randint(1, 7))} €", f"{d}.{m} %", f"version {d}.{m}", f"v{d}.{m}.{d}",
            f"order {digits(rng.randint(5, 12))}", f"invoice no {digits(8)}-{digits(3)}", f"page {digits(3)}", f"pages {d}-{d + 9}", f"isbn 978-{d}-{digits(4)}-{digits(4)}-1", f"build {digits(10)}", f"id {digits(rng.randint(6, 16))}", card(False),
            hashlib.sha256(str(rng.random()).encode()).hexdigest()[: rng.randint(8, 64)], f"token = {digits(6)}af{digits(9)}b", f"@{pick(_NAMES)}", f"{digits(3)},{digits(3)},{digits(3)}", f"section {d}.{m}.{d}", f"{word()}_{digits(4)}", f"{digits(rng.randint(1, 20))}",
        )
        return made[k]

    cues = ("mail email contact write kontakt correo", "ip host server ping", "card visa karte tarjeta carte", "tel phone call telefon fax mobile teléfono")
    for _ in range(n):
        signs = pick(("", "", "", "", "!!", "*** $$$ %%% &&& ###", ", . ; : - / | _"))
        text, spans = prose(rng.randint(2, 9)), []

        def put(written: str, kind: int) -> None:
            nonlocal text
            spans.append((len(text), kind, len(text) + len(written)))  # noqa: B023
            text += noisy(written) if "!" not in signs else written  # noqa: B023
            text += pick((" ", ", ", ". ", "\n"))

        for _ in range(rng.randint(1, 4)):
            if rng.random() < 0.55:
                kind = rng.randint(0, 3)
                it = thing(kind)
                some = ways(kind, it)
                known = rng.random() < 0.6
                if known:  # as the patterns find it, then in another way, without a word that tells
                    put(some[0], kind)
                    text += prose(rng.randint(0, 12))
                if rng.random() < 0.8:
                    if not known:
                        text += pick(cues[kind].split()) + pick((" ", ": ", " " + word() + " ", ". "))
                    put(pick(some[1:] if kind else some), kind)
            else:
                again = plain()
                for _ in range(pick((1, 1, 2))):
                    text += again + pick((" ", ", ", ". ", "\n")) + prose(rng.randint(0, 8))
            text += prose(rng.randint(2, 10))
        yield text, spans


@functools.cache
def trained(n: int = 260, seed: int = 5) -> Field:
    """The field learnt from `labelled` documents, once a process."""
    some = [(g, covered(g.at, spans, 0)) for text, spans in labelled(n, seed) for g in graphs(text, base_spans(text))]
    return Field.train([(g, [x if x >= 0 else y for x, y in zip(g.given, t, strict=True)]) for g, t in some])


def written(spans: Sequence[Span]) -> str:
    names = (*KINDS, *(f"crf_{k}" for k in KINDS))
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def scan(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """Per document: counts by pattern, a digest of the patterns' spans, and all spans with the field's."""
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans = [], []
            for t in batch.column(1):
                text = t.as_py()
                base = base_spans(text)
                for k, c in enumerate(counts):
                    c.append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(sorted(base + model.spans(text, base))))
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return map_arrow(texts(docs), run, SCHEMA)
