"""Splitting search text into keywords.

The tokenizer is a parameter. The default takes runs of letters and digits in lower case with built-in functions; another,
such as functions.segment's for scripts without spaces, is a Python function, which runs on Arrow batches or as a table
function in SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .segment import tokens

_WORD = r"[\p{L}\p{N}]+"


def keywords(text: Column) -> Column:
    """An array of keywords; empty for null text."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD})"), F.lit(1)), F.array().cast("array<string>"))


Tokenizer = Callable[[str], Iterable[str]]


def exploded(df: DataFrame, text: str, name: str = "keyword", tokenize: Tokenizer | None = None) -> DataFrame:
    """A row for each keyword, none for a row without any (an inner lateral join); JVM only unless a tokenizer is given."""
    return df.withColumn(name, F.explode(tokens(F.col(text), tokenize) if tokenize else keywords(F.col(text))))


def register(spark: SparkSession, tokenize: Tokenizer, name: str = "analyze_words") -> None:
    """A SQL table function name(text) -> word for `FROM t, LATERAL name(text)`, on batches and streams alike."""

    class Analyze:
        def eval(self, text: str) -> Iterator[tuple[str]]:
            for word in tokenize(text) if text else ():
                yield (word,)

    spark.udtf.register(name, F.udtf(Analyze, returnType="word string", useArrow=True))
