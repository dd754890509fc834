"""Documents to token arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusmill import fixed_values as fixed
from corpusmill.functions import text
from corpusmill.operators import phrases as phrase_ops
from corpusmill.runtime import materialize
from corpusmill.settings import Settings


def stopword_list(
    custom: Iterable[str] = (), indonesian: Iterable[str] = (), english: bool = True
) -> list[str]:
    """Union of Spark's English list, a given Indonesian list, the built-in and custom words."""
    words = set(fixed.BUILT_IN_STOPWORDS) | set(indonesian) | set(custom)
    if english:
        words |= set(StopWordsRemover.loadDefaultStopWords("english"))
    return sorted(words)


def stopword_union(*tables: DataFrame) -> DataFrame:
    """Distinct words of several (word, origin) tables with the origins they come from."""
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table)
    return merged.groupBy("word").agg(
        F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins")
    )


def normalise_tokens(tokens: Column, rule: Callable[[str], str]) -> Column:
    """Apply a token rule (a stemmer, say) inside arrays, without a shuffle.

    The rule runs once per distinct token of an Arrow batch; a failing rule
    keeps the token.
    """

    def safe(token: str) -> str:
        try:
            return rule(token)
        except Exception:
            return token

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def apply(batch: pd.Series) -> pd.Series:
        filled = batch.map(lambda a: a if a is not None else [])
        sizes = filled.map(len).to_numpy()
        flat = np.concatenate([*filled, np.array([], dtype=object)])
        codes, distinct = pd.factorize(flat)
        mapped = np.array([safe(t) for t in distinct], dtype=object)
        flat = mapped[codes] if len(codes) else flat
        return pd.Series(np.split(flat, np.cumsum(sizes)[:-1]), index=batch.index)

    return apply(tokens)


def token_map(docs: DataFrame, rule: Callable[[str], str], column: str = "tokens") -> DataFrame:
    """Each distinct token with its normalised form."""
    distinct = docs.select(F.explode(column).alias("token")).distinct()
    one = normalise_tokens(F.array("token"), rule)
    return distinct.select("token", F.get(one, F.lit(0)).alias("normal"))


class Preprocessor:
    """Clean, tokenise, drop stopwords, filter, normalise and merge phrases."""

    def __init__(
        self,
        settings: Settings = Settings(),
        stopwords: Iterable[str] | None = None,
        rule: Callable[[str], str] | None = None,
    ) -> None:
        self.settings = settings
        self.stopwords = stopword_list() if stopwords is None else sorted(set(stopwords))
        self.rule = rule
        self.bigrams: DataFrame | None = None
        self.trigrams: DataFrame | None = None

    def tokens(self, column: str | Column) -> Column:
        """Tokens of a text before phrases are merged."""
        s = self.settings
        found = text.tokens_of(column, self.stopwords, s.min_word_length, s.max_word_length)
        if s.use_stemming and self.rule is not None:
            found = normalise_tokens(found, self.rule)
        return found

    def tokenize(self, df: DataFrame, column: str = "text", output: str = "tokens") -> DataFrame:
        """Add raw tokens and keep documents of sufficient length, counted here.

        The rows come from a generator: a filter on the size would be moved below the tokens
        and make them a second time.
        """
        least = self.settings.min_doc_length
        kept = F.filter(F.array(self.tokens(column)), lambda found: F.size(found) >= least)
        return df.withColumn(output, F.explode(kept))

    def fit(self, docs: DataFrame, column: str = "tokens") -> "Preprocessor":
        """Learn phrases from tokenised documents."""
        s = self.settings
        self.bigrams = self.trigrams = None
        if s.use_bigrams:
            self.bigrams = phrase_ops.fit_phrases(
                docs, column, s.bigram_min_count, s.phrase_threshold
            )
            if s.use_trigrams:
                merged = phrase_ops.apply_phrases(docs, self.bigrams, column)
                self.trigrams = phrase_ops.fit_phrases(
                    merged, column, s.trigram_min_count, s.phrase_threshold
                )
        return self

    def merge(self, docs: DataFrame, column: str = "tokens") -> DataFrame:
        """Apply the learned phrases."""
        for table in (self.bigrams, self.trigrams):
            if table is not None:
                docs = phrase_ops.apply_phrases(docs, table, column)
        return docs

    def fit_transform(
        self, df: DataFrame, column: str = "text", output: str = "tokens"
    ) -> DataFrame:
        """The whole corpus; tokens are computed once and stored before the fit."""
        docs = materialize(self.tokenize(df, column, output), "tokens")
        return self.fit(docs, output).merge(docs, output).withColumn(
            "token_count", F.size(output)
        )

    def transform(
        self, df: DataFrame, column: str = "text", output: str = "tokens"
    ) -> DataFrame:
        """New texts with the learned phrases; short ones are kept."""
        return self.merge(df.withColumn(output, self.tokens(column)), output)


def corpus_statistics(
    all_docs: DataFrame, docs: DataFrame, column: str = "tokens"
) -> DataFrame:
    """Documents in, kept and skipped, tokens, distinct tokens and mean length.

    One shuffle on the token; per-token counts are combined on the map side.
    """
    total = all_docs.agg(F.count(F.lit(1))).scalar()
    kept = docs.agg(F.count(F.lit(1))).scalar()
    words = (
        docs.select(F.explode(column).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    )
    sums = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_tokens"),
        F.count(F.lit(1)).alias("unique_tokens"),
    )
    return sums.select(
        total.alias("total_documents"),
        kept.alias("processed_documents"),
        (total - kept).alias("skipped_documents"),
        "total_tokens",
        "unique_tokens",
        F.coalesce(F.col("total_tokens") / F.nullif(kept, F.lit(0)), F.lit(0.0)).alias(
            "avg_tokens_per_doc"
        ),
    )
