"""Profiles of a record table: gaps, lengths, dates, languages, subjects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from corpusmill import fixed_values as fixed
from corpusmill.functions import dates, labels, text
from corpusmill.operators import dedup, quantiles
from corpusmill.runtime import materialize


def _missing(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.StringType):
        return text.is_missing(name)
    return F.col(name).isNull()


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column; all columns in a single aggregate."""
    columns = list(columns or df.columns)
    one_row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(_missing(df, c)).alias(f"m{i}") for i, c in enumerate(columns)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing_count"))
            for i, c in enumerate(columns)
        ]
    )
    pct = F.col("missing_count") * 100.0 / F.nullif(F.col("n"), F.lit(0))
    return (
        one_row.select("n", F.inline(rows))
        .select(
            "column_name",
            "missing_count",
            pct.alias("missing_pct"),
            (F.col("n") - F.col("missing_count")).alias("non_null_count"),
            labels.severity_band(pct).alias("severity"),
        )
        .orderBy(F.desc("missing_pct"), "column_name")
    )


def required_check(df: DataFrame, columns: Sequence[str] = ("title", "abstract")) -> DataFrame:
    """Missing values of the required columns and the verdict over all of them."""
    counts = {c: F.count_if(_missing(df, c)) for c in columns}
    bad = sum(counts.values(), F.lit(0))
    return df.agg(
        *[n.alias(f"missing_{c}") for c, n in counts.items()], (bad == 0).alias("complete")
    )


def column_types(df: DataFrame) -> DataFrame:
    """Column names and types with the number of values that are not null, in one aggregate."""
    counts = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(df.schema)])
    rows = [
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"),
            F.col(f"c{i}").alias("non_null"),
        )
        for i, f in enumerate(df.schema)
    ]
    return counts.select(F.inline(F.array(*rows)))


def overview(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns))
    )


def describe(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum.

    The texts are read once, to fold each measure to value counts; all else is taken
    from those, however many values differ.
    """
    counts = quantiles.folded(df, measures)
    basic = counts.groupBy("m").agg(
        F.sum("n").alias("n"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    basic = materialize(basic, "measures")
    apart = F.col("v") - F.col("mean")
    spread = counts.join(F.broadcast(basic.select("m", "mean")), "m").groupBy("m").agg(
        F.sqrt(F.sum(F.col("n") * apart * apart) / F.nullif(F.sum("n") - 1, F.lit(0))).alias("std")
    )
    quarters = quantiles.ranked_values(counts, [0.25, 0.5, 0.75]).groupBy("m").agg(
        *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(name) for q, name in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))]
    )
    # one row per measure from here on
    names = df.sparkSession.createDataFrame(list(enumerate(measures)), "m int, measure string")
    wide = names
    for side in (basic, spread, quarters):
        wide = wide.join(F.broadcast(side), "m", "left")
    return wide.orderBy("m").select(
        "measure", F.coalesce("n", F.lit(0)).alias("n"), "mean", "std", "min", "q25", "median", "q75", "max"
    )


def text_lengths(title: str = "title", abstract: str = "abstract") -> dict[str, Column]:
    return {
        "title_length": text.char_length(title),
        "title_words": text.word_count(title),
        "abstract_length": text.char_length(abstract),
        "abstract_words": text.word_count(abstract),
    }


def medians(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """One row with the exact median of each measure."""
    found = quantiles.quantiles(df, measures, [0.5])
    return found.agg(*[F.max(F.when(F.col("measure") == name, F.col("value"))).alias(name) for name in measures])


def histogram(df: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last one is closed.

    Values are first folded to (value, count), so the texts are read once. The
    edges of a constant column lie half a unit to either side.
    """
    folded = (
        df.select(value.cast("double").alias("v"))
        .where("v is not null")
        .groupBy("v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    folded = materialize(folded, "lengths")
    edges = folded.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if edges["lo"] is None:
        lo, hi = 0.0, 1.0
    elif edges["lo"] == edges["hi"]:
        lo, hi = edges["lo"] - 0.5, edges["hi"] + 0.5
    else:
        lo, hi = edges["lo"], edges["hi"]
    width = (hi - lo) / bins
    placed = folded.select(
        F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).alias("bin"), "n"
    )
    spine = df.sparkSession.range(bins).select(
        F.col("id").alias("bin"), F.lit(0).cast("long").alias("n")
    )
    return (
        placed.unionByName(spine)
        .groupBy("bin")
        .agg(F.sum("n").alias("n"))
        .select(
            "bin",
            (F.lit(lo) + F.col("bin") * width).alias("lower"),
            (F.lit(lo) + (F.col("bin") + 1) * width).alias("upper"),
            "n",
        )
    )


def value_counts(df: DataFrame, value: Column | str, name: str = "value") -> DataFrame:
    """Rows per non-null value and their share of all rows, nulls included."""
    value = F.col(value) if isinstance(value, str) else value
    groups = df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    rows = df.agg(F.count(F.lit(1))).scalar()
    return groups.where(F.col(name).isNotNull()).select(
        name, "n", (F.col("n") * 100.0 / rows).alias("pct")
    )


def top_value(df: DataFrame, value: Column | str, name: str = "value") -> DataFrame:
    """The most frequent value; the smallest one wins a tie."""
    value = F.col(value) if isinstance(value, str) else value
    return (
        df.select(value.alias(name))
        .where(F.col(name).isNotNull())
        .groupBy(name)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), name)
        .limit(1)
    )


def year_distribution(df: DataFrame, year: Column | str = "year", recent: int = 5) -> DataFrame:
    """Records per year with a flag on the latest years."""
    year = F.col(year) if isinstance(year, str) else year
    counts = (
        df.select(year.alias("year"))
        .where("year is not null")
        .groupBy("year")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # one row per calendar year, so the rank is taken over a short list
    rank = F.dense_rank().over(Window.orderBy(F.desc("year")))
    return counts.withColumn("is_recent", rank <= recent)


def busiest_year(df: DataFrame, year: Column | str = "year") -> DataFrame:
    """Year range and the year with most records; the earliest one wins a tie."""
    year = F.col(year) if isinstance(year, str) else year
    counts = (
        df.select(year.alias("year"))
        .where("year is not null")
        .groupBy("year")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.agg(
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.max_by("year", F.struct("n", -F.col("year"))).alias("busiest_year"),
        F.max("n").alias("busiest_n"),
    )


def date_success(df: DataFrame, column: str = "date") -> DataFrame:
    """How many dates could be read, and their range."""
    parsed = df.select(dates.parse_date(column).alias("d"))
    n = F.count(F.lit(1))
    return parsed.agg(
        F.count("d").alias("valid"),
        F.count_if(F.col("d").isNull()).alias("invalid"),
        (F.count("d") * 100.0 / F.nullif(n, F.lit(0))).alias("valid_pct"),
        F.min("d").cast("date").alias("earliest"),
        F.max("d").cast("date").alias("latest"),
    )


def unreadable_dates(df: DataFrame, column: str = "date", order: str = "ord", k: int = 10) -> DataFrame:
    """Sample of dates that are present but cannot be read."""
    return (
        df.where(~text.is_missing(column) & dates.parse_date(column).isNull())
        .select(order, column)
        .orderBy(order)
        .limit(k)
    )


def short_texts(df: DataFrame, column: str = "abstract") -> DataFrame:
    rows = df.select(
        text.word_count(column).alias("words"), text.is_missing(column).alias("missing")
    )
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("words") < 50).alias("below_50"),
        F.count_if(F.col("words") < 20).alias("below_20"),
        F.count_if("missing").alias("empty"),
    )


def subject_counts(df: DataFrame, column: str = "subjects", keep_empty: bool = False) -> DataFrame:
    return (
        df.select(F.explode(text.split_list(column, ";", keep_empty)).alias("subject"))
        .groupBy("subject")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def subject_coverage(df: DataFrame, column: str = "subjects") -> DataFrame:
    """Records with subjects and number of distinct subjects, in one pass."""
    rows = df.select(
        (~text.is_missing(column)).alias("has"), text.split_list(column).alias("pieces")
    )
    totals = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("has").alias("with_subjects")
    )
    distinct = (
        rows.select(F.explode("pieces").alias("s")).distinct().agg(F.count(F.lit(1)))
    )
    return totals.select(
        "n",
        "with_subjects",
        (F.col("with_subjects") * 100.0 / F.nullif(F.col("n"), F.lit(0))).alias("coverage_pct"),
        distinct.scalar().alias("distinct_subjects"),
    )


def word_counts(df: DataFrame, words: Column) -> DataFrame:
    """Occurrences per word of an array column."""
    return (
        df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    )


def top_words(df: DataFrame, words: Column, k: int = 50) -> DataFrame:
    return word_counts(df, words).orderBy(F.desc("n"), "word").limit(k)


def word_totals(df: DataFrame, words: Column) -> DataFrame:
    return word_counts(df, words).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_words"),
        F.count(F.lit(1)).alias("distinct_words"),
    )


def stopwords_on_top(
    df: DataFrame, words: Column, listed: Sequence[str] = fixed.COMMON_STOPWORDS, k: int = 50
) -> DataFrame:
    """Listed stopwords among the k most frequent words."""
    return top_words(df, words, k).where(F.col("word").isin(list(listed)))


def quality_findings(
    df: DataFrame,
    columns: Sequence[str] = ("title", "abstract", "date", "authors"),
    threshold: float = 5.0,
) -> DataFrame:
    """Findings worth acting on: gaps, repeated titles and abstracts, short texts."""
    gaps = (
        missing_profile(df, columns)
        .where(F.col("missing_pct") > threshold)
        .select(
            F.concat(F.lit("missing "), "column_name").alias("finding"),
            F.col("missing_count").alias("n"),
        )
    )
    repeats = (
        dedup.duplicate_counts(df)
        .where(F.col("kind").isin("title", "abstract") & (F.col("duplicates") > 0))
        .select(F.concat(F.lit("duplicate "), "kind").alias("finding"), F.col("duplicates").alias("n"))
    )
    short = (
        short_texts(df)
        .where("below_20 > 0")
        .select(F.lit("short abstract").alias("finding"), F.col("below_20").alias("n"))
    )
    return gaps.unionByName(repeats).unionByName(short)


def recommendations(df: DataFrame, column: str = "abstract", english_share: float = 0.1) -> DataFrame:
    """Primary language, mean length and whether English stopwords are needed."""
    rows = df.select(
        text.margin_language(column).alias("language"), text.word_count(column).alias("words")
    )
    groups = rows.groupBy("language").agg(
        F.count(F.lit(1)).alias("n"), F.sum("words").alias("words")
    )
    english = F.coalesce(F.sum(F.when(F.col("language") == "English", F.col("n"))), F.lit(0))
    best = F.min_by("language", F.struct(-F.col("n"), F.col("language")))
    return groups.agg(
        best.alias("primary_language"),
        (F.sum("words") / F.nullif(F.sum("n"), F.lit(0))).alias("mean_words"),
        (english > F.sum("n") * english_share).alias("add_english_stopwords"),
    )


def repeatable_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """`n` rows in the order of a seeded hash, so the same rows come back."""
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(mixed, key).limit(n)
