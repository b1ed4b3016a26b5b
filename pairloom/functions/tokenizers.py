"""Tokenizers as column expressions. Null in, null out; a text without tokens gives an empty array."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Tokenizer:
    """Splits a column into an array of tokens. Subclass, set ``name`` and define :meth:`tokens`."""

    name = ""

    def tokens(self, text: Column) -> Column:
        """All tokens in order, repeats included."""
        raise NotImplementedError

    def token_set(self, text: Column) -> Column:
        """The distinct tokens."""
        return F.array_distinct(self.tokens(text))

    def vocabulary(self, df: DataFrame, column: str) -> DataFrame:
        """(tok, records, occurrences) of the tokens of a column."""
        rows = df.select(self.tokens(F.col(f"`{column}`")).alias("toks"), F.monotonically_increasing_id().alias("row"))
        once = rows.select("row", F.explode("toks").alias("tok"))
        counts = once.groupBy("tok", "row").agg(F.count("*").alias("n"))
        return counts.groupBy("tok").agg(F.count("*").alias("records"), F.sum("n").alias("occurrences"))

    def nunique_tokens(self, df: DataFrame, column: str) -> int:
        """The number of distinct tokens of a column."""
        return df.select(F.explode(self.token_set(F.col(f"`{column}`"))).alias("tok")).agg(F.count_distinct("tok")).first()[0]

    def __str__(self) -> str:
        return self.name

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self.name == other.name

    def __hash__(self) -> int:
        return hash((type(self), self.name))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


class WhiteSpaceTokenizer(Tokenizer):
    """Lower-cased words between white space."""

    name = "whitespace_tokens"

    def tokens(self, text: Column) -> Column:
        return _words(F.lower(text))


class StrippedWhiteSpaceTokenizer(Tokenizer):
    """Words between white space after all but ``a-z0-9`` is deleted from the lower-cased text."""

    name = "stripped_whitespace_tokens"

    def tokens(self, text: Column) -> Column:
        spaced = F.lower(F.regexp_replace(text, r"(?U)\s+", " "))
        return _words(F.regexp_replace(spaced, "[^a-z0-9 ]+", ""))


class NumericTokenizer(Tokenizer):
    """Runs of digits."""

    name = "num_tokens"

    def tokens(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit("([0-9]+)"), 1)


class AlphaNumericTokenizer(Tokenizer):
    """Runs of ``a-z0-9`` in the lower-cased text."""

    name = "alnum_tokens"

    def tokens(self, text: Column) -> Column:
        return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


class StandardTokenizer(Tokenizer):
    """Runs of letters and digits of any script in the lower-cased text."""

    name = "standard_tokens"

    def tokens(self, text: Column) -> Column:
        return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def _qgrams(text: Column, q: int) -> Column:
    # A lookahead reads all grams in one pass. It moves by UTF-16 units, so texts with characters
    # beyond the basic plane are cut by position.
    at = F.sequence(F.lit(1), F.length(text) - q + 1)
    cut = F.transform(at, lambda i: F.substring(text, i, F.lit(q)))
    fast = F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))" % q), 1)
    none = F.array().cast("array<string>")
    return F.when(F.length(text) < q, none).when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), cut).otherwise(fast)


def _q(q: int) -> int:
    if q < 1:
        raise ValueError("q must be at least 1")
    return q


class QGramTokenizer(Tokenizer):
    """All substrings of ``q`` characters of the lower-cased text, without padding."""

    def __init__(self, q: int):
        self.q, self.name = _q(q), f"{q}gram_tokens"

    def tokens(self, text: Column) -> Column:
        return _qgrams(F.lower(text), self.q)


class StrippedQGramTokenizer(Tokenizer):
    """Q-grams of the lower-cased text without its non-word characters."""

    def __init__(self, q: int):
        self.q, self.name = _q(q), f"stripped_{q}gram_tokens"

    def tokens(self, text: Column) -> Column:
        return _qgrams(F.lower(F.regexp_replace(text, r"(?U)\W+", "")), self.q)


class ShingleTokenizer(Tokenizer):
    """``n`` consecutive stripped words joined without a separator."""

    def __init__(self, n: int):
        self.n, self.name = _q(n), f"{n}shingle_tokens"

    def tokens(self, text: Column) -> Column:
        words = StrippedWhiteSpaceTokenizer().tokens(text)
        count = F.size(words)
        at = F.sequence(F.lit(1), count - self.n + 1)
        joined = F.transform(at, lambda i: F.array_join(F.slice(words, i, self.n), ""))
        return F.when(words.isNull(), None).when(count < self.n, F.array().cast("array<string>")).otherwise(joined)


class FunctionTokenizer(Tokenizer):
    """A tokenizer from a Python function on one string; it runs over Arrow batches."""

    def __init__(self, name: str, function: Callable[[str], list[str]]):
        self.name = name

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda x: None if x is None else list(function(x)))

        self._run = run

    def tokens(self, text: Column) -> Column:
        return self._run(text)


#: Analyzer names of the top-k predicate.
ANALYZERS = {"standard": StandardTokenizer(), "whitespace": WhiteSpaceTokenizer(), "3gram": QGramTokenizer(3)}
