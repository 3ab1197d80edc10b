"""Quality rules under weak supervision, in DataFrame functions only.

Rules look at counts of a text and vote good (1), bad (-1) or abstain (0). How often each vote pattern occurs in the
whole table (at most 3 to the number of rules) is all that expectation-maximisation needs: it estimates each rule's
accuracy and the share of good documents without labels, in one SQL fold over that pattern table. A document is kept if
the posterior probability of good, given its votes, is at least `bar`, and if no base rule fails. One bad vote doesn't
reject by itself unless its rule has proved to be nearly always right.

Windows are compared by 64-bit hashes: of n windows two unlike ones are taken for equal with a chance of n^2 / 2^65.

Nulls: a null text has no words (so the base rule fails); a null doc_id stays null. Repeated rows are judged alike. A
probability equal to the bar keeps. An empty table gives an empty result. Very long texts are counted whole. Columns besides
doc_id and text play no part in `judge`, however they are called; `keep_good` keeps them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash

# White space between words, symbols, and frequent words of the languages at hand.
_SPACE = r"[\x20\x09-\x0D]+"
_NOT_SYMBOL = r"[^#*$%&|<>]+"
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "der", "die", "und", "zu", "den", "von", "ist", "le", "la", "les", "de", "et", "des", "que", "el", "los", "y", "en", "un", "una")
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words that lie in windows of WINDOW words found twice or more in the text."""

    def covered(windows: Column) -> Column:
        # windows in the order of their hashes: equal ones are neighbours
        def flagged(ordered: Column) -> Column:
            twice = F.filter(ordered, lambda x, k: (x["h"] == F.get(ordered, k - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(ordered, k + 1)["h"]).eqNullSafe(True))
            places = F.sort_array(F.transform(twice, lambda x: x["at"]))
            return F.aggregate(
                places,
                F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last")),
                lambda s: s["n"],
            )

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at")))), flagged))

    def hashed(hashes: Column) -> Column:
        begins = F.slice(hashes, F.lit(1), F.size(hashes) - (WINDOW - 1))
        windows = F.transform(begins, lambda x, i: F.xxhash64(x, *(hashes[i + k] for k in range(1, WINDOW))))
        return F.when(F.size(hashes) < WINDOW, F.lit(0)).otherwise(let(windows, covered))

    return let(F.transform(words, lambda w: F.xxhash64(w)), hashed)


def features(docs: DataFrame, text: str = "text") -> Column:
    """A struct of counts of the text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop."""
    t = F.coalesce(docs[text], F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        )

    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    by_char = F.struct(F.length(F.regexp_replace(t, _NOT_SYMBOL, "")).cast("long").alias("n_symbols"))
    return let(
        F.struct(let(F.array_remove(F.split(t, _SPACE, -1), ""), counts).alias("w"), by_line.alias("l"), by_char.alias("c")),
        lambda x: F.struct(*(x[g][n].alias(n) for g, ns in (("w", ("n_words", "word_chars", "n_repeat_words", "n_stop")), ("l", ("n_lines", "n_dup_lines")), ("c", ("n_symbols",))) for n in ns)),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def votes(f: Column) -> Column:
    """The rules' votes over a struct of features, in the order of RULES."""
    words = F.greatest(f["n_words"], F.lit(1))
    length = f["word_chars"] / words
    symbols = f["n_symbols"] / words
    doubled = f["n_dup_lines"] / F.greatest(f["n_lines"], F.lit(1))
    repeats = f["n_repeat_words"] / words
    stop = f["n_stop"] / words
    return F.array(
        _vote(f["n_words"] < 15, f["n_words"] >= 30),
        _vote((length < 3.5) | (length > 7.5), length.between(4.2, 6.8)),
        _vote(symbols > 0.3, symbols < 0.1),
        _vote(doubled > 0.3, doubled < 0.1),
        _vote(repeats > 0.1, repeats < 0.03),
        _vote((stop < 0.01) & (f["n_words"] >= 40), (stop > 0.06) & (f["n_words"] >= 40)),
    )


RULES = ("length", "word_length", "symbols", "doubled_lines", "repeats", "frequent_words")


# Where the estimation starts. Chances of a rule's votes (bad, abstain, good) over bad and over good documents;
# an abstention says nothing, so it counts as 1 everywhere.
_START_BAD, _START_GOOD, _START_SHARE = (0.5, 1.0, 0.5), (0.02, 1.0, 0.98), 0.9
#: What is known of the share of good documents before any is seen: as if so many of so many had been good.
PRIOR_GOOD, PRIOR_ALL = 18.0, 20.0


@dataclass
class LabelModel:
    """Share of good documents, and for each rule that votes how likely bad and good votes are over good and over bad documents."""

    share: float
    good: list[list[float]]
    bad: list[list[float]]

    @property
    def accuracy(self) -> list[float]:
        """Of each rule's votes, the share that is right."""
        out = []
        for g, b in zip(self.good, self.bad, strict=True):
            right, wrong = self.share * g[2] + (1 - self.share) * b[0], self.share * g[0] + (1 - self.share) * b[2]
            out.append(right / (right + wrong))
        return out

    def probability(self, votes_: Column) -> Column:
        """Posterior probability of good given the votes."""
        table = lambda rows: F.array(*(F.array(*map(F.lit, r)) for r in rows))
        return _posterior(votes_, F.lit(self.share), table(self.good), table(self.bad))


def _posterior(votes_: Column, share: Column, good: Column, bad: Column) -> Column:
    ratios = F.transform(votes_, lambda v, j: F.log(good[j][v + 1] / bad[j][v + 1]))
    return 1 / (1 + F.exp(-(F.log(share / (1 - share)) + _total(ratios))))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def fit(voted: DataFrame, column: str = "votes", rounds: int = 25) -> LabelModel:
    """Estimate from how often each vote pattern occurs in all of voted; the patterns, not the documents, are gathered.

    Rows without votes (null) don't count. The start holds that bad votes are commoner over bad documents, which tells the
    two classes apart; counts are smoothed by one, the share by PRIOR_GOOD of PRIOR_ALL. A corpus may well be mostly bad.
    """
    m = len(RULES)
    patterns = voted.groupBy(column).count()
    one = patterns.agg(F.collect_list(F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("v"), F.col("count").cast("double").alias("n")))).alias("all"))
    each_rule = lambda f: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), f)

    def step(state: Column, _: Column) -> Column:
        def estimate(scored: Column) -> Column:
            def tables(weight: Callable[[Column], Column]) -> Column:
                def chances(j: Column) -> Column:
                    count = lambda v: _total(F.transform(scored, lambda x: F.when(x["v"][j] == v, weight(x)).otherwise(F.lit(0.0)))) + 1
                    return let(F.struct(count(-1).alias("b"), count(1).alias("g")), lambda c: F.array(c["b"] / (c["b"] + c["g"]), F.lit(1.0), c["g"] / (c["b"] + c["g"])))

                return each_rule(chances)

            n, good = (_total(F.transform(scored, w)) for w in (lambda x: x["n"], lambda x: x["n"] * x["q"]))
            share = (good + PRIOR_GOOD) / (n + PRIOR_ALL)
            return F.struct(share.alias("share"), tables(lambda x: x["n"] * x["q"]).alias("good"), tables(lambda x: x["n"] * (1 - x["q"])).alias("bad"))

        return let(F.transform(F.col("all"), lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), _posterior(x["v"], state["share"], state["good"], state["bad"]).alias("q"))), estimate)

    same = lambda chances: F.array(*[F.array(*map(F.lit, chances))] * m)
    start = F.struct(F.lit(_START_SHARE).alias("share"), same(_START_GOOD).alias("good"), same(_START_BAD).alias("bad"))
    # an empty table has no patterns and leaves the start as it is
    fitted = F.when(F.size("all") > 0, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)).otherwise(start)
    r = one.select(fitted.alias("r")).first().r
    return LabelModel(r.share, [list(x) for x in r.good], [list(x) for x in r.bad])


def _base_failed(f: Column) -> Column:
    return (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])


def judge(docs: DataFrame, bar: float = 0.5) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability."""
    counted = stash(docs.select("doc_id", features(docs).alias("f")))
    voted = counted.withColumn("votes", votes(F.col("f")))
    f = F.col("f")
    # the model decides over what the base rules leave, and learns from that
    p = fit(voted.where(~_base_failed(f))).probability(F.col("votes"))
    return voted.select(
        "doc_id",
        *(f[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        _base_failed(f).alias("base_failed"),
        (~_base_failed(f) & (p >= bar)).alias("kept"),
        p.alias("probability"),
    )


def keep_good(docs: DataFrame, bar: float = 0.5) -> DataFrame:
    """The rows of docs that `judge` keeps, with their columns as they are.

    The texts are counted twice, for the fit and for the filter; no text is moved. Both times the verdict is one
    expression over counts that are bound once: split into columns, the optimizer would copy the counting into each use.
    """
    voted = docs.select(let(features(docs), lambda f: F.when(~_base_failed(f), votes(f))).alias("votes"))
    model = fit(voted)
    return docs.where(let(features(docs), lambda f: ~_base_failed(f) & (model.probability(votes(f)) >= bar)))
