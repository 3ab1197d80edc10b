"""Words of texts without spaces: the most probable way through a dictionary, which is given or learnt from a corpus.

Runs of the script that has no spaces are cut into words; elsewhere runs of letters and digits are words, in lower case. In
a run every dictionary word that begins at a place is an edge of a word graph; a trie of the words' beginnings ends the
search. A word weighs the logarithm of its share. Characters that no word covers are unknown words: neighbouring ones form
one, which weighs less with each character, by the character's own share in the dictionary. The best path is found from left
to right; of equal ones that with the longer last word.

A dictionary is learnt by counts of all character sequences up to a length: a sequence is a word if it is frequent, if its
parts are together far more often than by chance (cohesion: of all ways to cut it in two, the least), and if many different
characters stand before and behind it (boundary entropy, of both sides the lesser). Counting is done by Spark, each sequence
combined before it is shuffled.

A null text has no words. Texts are read whole; a run's time grows with its length times the longest word's.
"""

import math
import re
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of Chinese script.
HAN = "㐀-䶿一-鿿豈-﫿"
#: The longest word learnt, the least count, cohesion (in nats) and boundary entropy (in nats), and the words kept at most.
LONGEST, LEAST, COHESION, ENTROPY, WORDS = 4, 5, 3.0, 0.8, 200_000


class Segmenter:
    """A function from a text to its words."""

    def __init__(self, words: Mapping[str, float], script: str = HAN) -> None:
        """words: how often each is seen; script: the characters of runs to be cut, as a class of a pattern."""
        total = sum(words.values()) or 1.0
        self.script, self.total = script, total
        self.weights = {w: math.log(n / total) for w, n in words.items() if w and n > 0}
        self.beginnings = {w[:k] for w in self.weights for k in range(1, len(w) + 1)}
        seen: dict[str, float] = {}
        for w, n in words.items():
            for c in w:
                seen[c] = seen.get(c, 0.0) + n
        characters = sum(seen.values()) or 1.0
        self.unseen = math.log(0.1 / (characters + 1))
        self.characters = {c: math.log(n / characters) for c, n in seen.items()}
        self._token = re.compile(f"([{script}]+)|[^\\W_]+")
        self._plain = re.compile(f"[{script}]+")

    def _unknown(self, c: str) -> float:
        """What a character of an unknown word weighs: less than any word that it could be part of."""
        return min(self.characters.get(c, self.unseen), self.unseen) - 2.0

    def cut(self, run: str) -> list[str]:
        n = len(run)
        best = [0.0] + [-math.inf] * n
        step: list[tuple[int, bool]] = [(0, True)] * (n + 1)
        for i in range(n):
            j = i + 1
            while j <= n and run[i:j] in self.beginnings:
                weight = self.weights.get(run[i:j])
                if weight is not None and best[i] + weight > best[j]:
                    best[j], step[j] = best[i] + weight, (i, True)
                j += 1
            weight = best[i] + self._unknown(run[i])
            if weight > best[i + 1]:
                best[i + 1], step[i + 1] = weight, (i, False)
        out: list[str] = []
        at = n
        while at:
            before, known = step[at]
            word = run[before:at]
            if not known:
                while before and not step[before][1]:  # unknown characters beside each other are one word
                    before = step[before][0]
                word = run[before:at]
            out.append(word)
            at = before
        return out[::-1]

    def __call__(self, text: str | None) -> list[str]:
        out: list[str] = []
        for m in self._token.finditer(text or ""):
            if m[1]:
                out += self.cut(m[1])
            else:  # letters and digits, up to a run of the script
                at = 0
                for inner in self._plain.finditer(m[0]):
                    out += [m[0][at : inner.start()].lower()] * (inner.start() > at)
                    out += self.cut(inner[0])
                    at = inner.end()
                out += [m[0][at:].lower()] * (at < len(m[0]))
        return out


def _entropy(pairs: DataFrame, side: str) -> DataFrame:
    """gram and the entropy of the characters at its side; a run's end counts as a character that is new each time."""
    n = pairs.groupBy("gram", side).agg(F.count("*").alias("k"))
    by = n.groupBy("gram").agg(F.sum("k").alias("all"), F.sum(F.when(F.col(side) == "", 0.0).otherwise(F.col("k") * F.log("k"))).alias("s"))
    return by.select("gram", (F.log("all") - F.col("s") / F.col("all")).alias(f"{side}_entropy"))


def candidates(texts: DataFrame, text: str, script: str = HAN, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """word, n, cohesion and entropy of every sequence of up to longest characters that is there least times or more."""
    runs = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(f"([{script}]+)"), F.lit(1))).alias("run"))

    def grams(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length("run") - n + 1, F.lit(1)))
        one = lambda i: F.struct(F.substr("run", i, F.lit(n)).alias("gram"), F.when(i > 1, F.substr("run", i - 1, F.lit(1))).otherwise("").alias("left"), F.substr("run", i + n, F.lit(1)).alias("right"))
        return F.when(F.length("run") >= n, F.transform(places, one)).otherwise(F.array().cast("array<struct<gram:string,left:string,right:string>>"))

    pairs = reduce(DataFrame.unionByName, (runs.select(F.explode(grams(n)).alias("g")).select("g.*") for n in range(1, longest + 1)))
    counts = pairs.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    total = F.lit(float(counts.where(F.length("gram") == 1).agg(F.sum("n")).first()[0] or 1))
    words = counts.where(F.length("gram") > 1)
    cuts = words.select("gram", "n", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("cut"))
    cuts = cuts.select("gram", "n", F.substr("gram", F.lit(1), F.col("cut")).alias("a"), F.substr("gram", F.col("cut") + 1, F.lit(longest)).alias("b"))
    of = lambda s: counts.select(F.col("gram").alias(s), F.col("n").alias(f"n_{s}"))
    held = cuts.join(of("a"), "a").join(of("b"), "b").groupBy("gram").agg(F.first("n").alias("n"), F.min(F.log(F.col("n") * total / (F.col("n_a") * F.col("n_b")))).alias("cohesion"))
    edges = pairs.join(words.select("gram"), "gram", "left_semi")
    sides = _entropy(edges, "left").join(_entropy(edges, "right"), "gram")
    return held.join(sides, "gram").select(F.col("gram").alias("word"), "n", "cohesion", F.least("left_entropy", "right_entropy").alias("entropy"))


def learn(texts: DataFrame, text: str, script: str = HAN, longest: int = LONGEST, least: int = LEAST, cohesion: float = COHESION, entropy: float = ENTROPY, most: int = WORDS) -> dict[str, int]:
    """A dictionary of the texts' words: most of them, by count, and single characters with what is left of theirs."""
    found = candidates(texts, text, script, longest, least).where((F.col("cohesion") >= cohesion) & (F.col("entropy") >= entropy))
    return {r.word: r.n for r in found.orderBy(F.desc("n"), "word").limit(most).select("word", "n").collect()}


def tokens(text: Column, segment: Callable[[str], Iterable[str]]) -> Column:
    """An array of a text's words by a Python function, in Arrow batches; empty for null text."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(segment(t)) if t else [])

    return cut(text)
