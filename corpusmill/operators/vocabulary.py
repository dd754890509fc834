"""Dictionary of terms and bag of words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.functions.vectors import let
from corpusmill.runtime import small_side
from corpusmill.settings import Settings


def term_runs(tokens: Column) -> Column:
    """Array of (term, n): the distinct terms of one row with their counts.

    Works inside the row on the sorted tokens, so counting per document needs no
    shuffle.
    """
    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), _runs))


def _runs(ordered: Column) -> Column:
    starts = F.filter(
        F.sequence(F.lit(0), F.size(ordered) - 1),
        lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
    )

    def pair_up(starts: Column) -> Column:
        rest = F.slice(starts, F.lit(2), F.size(starts) - 1)
        return F.zip_with(
            starts,
            F.concat(rest, F.array(F.size(ordered))),
            lambda a, b: F.struct(
                F.get(ordered, a).alias("term"), (b - a).cast("long").alias("n")
            ),
        )

    return let(starts, pair_up)


def occurrences(docs: DataFrame, column: str = "tokens", keep: Sequence[str] = ()) -> DataFrame:
    """(*keep, term, df, n): a row with n = 1 per token, and one with df = 1 per distinct term of a document.

    Their sums per term are its document frequency and its occurrences. Nothing is sorted inside
    the row, and every row goes to the map-side sums as it is made.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    parts = F.array(
        F.struct(none.alias("df"), one.alias("n"), F.col(column).alias("_terms")),
        F.struct(one.alias("df"), none.alias("n"), F.array_distinct(column).alias("_terms")),
    )
    return docs.select(*keep, F.inline(parts)).select(*keep, F.explode("_terms").alias("term"), "df", "n")


def document_frequencies(docs: DataFrame, column: str = "tokens") -> DataFrame:
    """Per term: documents that contain it (df) and occurrences (cf). One shuffle."""
    return occurrences(docs, column).groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("cf"))


def filter_extremes(
    frequencies: DataFrame, n_docs: int | Column, settings: Settings = Settings()
) -> DataFrame:
    """Drop rare and very common terms; keep the `keep_n` with the largest df."""
    n_docs = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    ceiling = F.floor(n_docs * F.lit(settings.no_above))
    return (
        frequencies.where((F.col("df") >= settings.no_below) & (F.col("df") <= ceiling))
        .orderBy(F.desc("df"), "term")
        .limit(settings.keep_n)
    )


def with_ids(terms: DataFrame) -> DataFrame:
    """Number the terms in alphabetical order; at most `keep_n` rows reach this."""
    rank = F.row_number().over(Window.orderBy("term")) - 1
    return terms.select(rank.alias("term_id"), "term", "df", "cf")


def build_dictionary(
    docs: DataFrame, column: str = "tokens", settings: Settings = Settings()
) -> DataFrame:
    """Filtered dictionary (term_id, term, df, cf) of stored tokenised documents."""
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    return with_ids(filter_extremes(document_frequencies(docs, column), n_docs, settings))


def dictionary_sizes(
    docs: DataFrame, column: str = "tokens", settings: Settings = Settings()
) -> DataFrame:
    """Number of terms before and after filtering, in one pass over the terms."""
    ceiling = F.floor(docs.agg(F.count(F.lit(1))).scalar() * F.lit(settings.no_above))
    kept = F.count_if((F.col("df") >= settings.no_below) & (F.col("df") <= ceiling))
    return document_frequencies(docs, column).agg(
        F.count(F.lit(1)).alias("terms_before"),
        F.least(kept, F.lit(settings.keep_n)).alias("terms_after"),
    )


def bag_of_words(
    docs: DataFrame, dictionary: DataFrame, column: str = "tokens", key: str = "doc_id"
) -> DataFrame:
    """Long form (doc_id, term_id, n); unknown terms drop out in the join."""
    terms = small_side(dictionary.select("term", "term_id"))
    return (
        docs.select(key, F.inline(term_runs(F.col(column))))
        .join(terms, "term")
        .select(key, "term_id", "n")
    )


def vectorizer(terms: list[str], column: str = "tokens", output: str = "features") -> CountVectorizerModel:
    """Bag-of-words stage over a given term list; the position is the term id."""
    return CountVectorizerModel.from_vocabulary(
        terms, inputCol=column, outputCol=output, minTF=1.0
    )


def sizes_of_vectors(vectors: DataFrame, column: str = "features", key: str = "doc_id") -> DataFrame:
    """(key, terms, tokens): distinct terms and tokens of each bag of words.

    Reads the numbers that a sparse vector stores, not one for every term of the dictionary.
    """
    counts = vectors.select(key, F.unwrap_udt(column)["values"].alias("v"))
    return counts.select(
        key,
        F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("terms"),
        F.aggregate("v", F.lit(0.0), lambda a, x: a + x).cast("long").alias("tokens"),
    )
