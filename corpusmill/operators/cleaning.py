"""From raw records to the clean table, and the ledger of what was dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill import fixed_values as fixed
from corpusmill.functions import dates, text
from corpusmill.operators import dedup
from corpusmill.settings import Settings


def require_text(df: DataFrame, columns: Sequence[str] = ("title", "abstract")) -> DataFrame:
    """Keep rows in which none of the columns is missing or blank."""
    for name in columns:
        df = df.where(~text.is_missing(name))
    return df


def fill_missing(
    df: DataFrame,
    label: str = Settings.missing_label,
    columns: Sequence[str] = fixed.FILL_COLUMNS,
) -> DataFrame:
    """Replace nulls and blanks of the secondary columns by a label."""
    present = [c for c in columns if c in df.columns]
    filled = {
        c: F.when(text.is_missing(c), F.lit(label)).otherwise(F.col(c)) for c in present
    }
    return df.withColumns(filled)


def add_dates(df: DataFrame, column: str = "date") -> DataFrame:
    parsed = dates.parse_date(column)
    return df.withColumns({"parsed_date": parsed, "year": F.year(parsed)})


def normalize_columns(
    df: DataFrame, columns: Sequence[str] = ("title", "abstract", "authors", "subjects")
) -> DataFrame:
    return df.withColumns({c: text.normalize_text(c) for c in columns if c in df.columns})


def long_enough(df: DataFrame, column: str = "abstract", words: int = 20) -> DataFrame:
    return df.where(text.word_count(column) >= words)


def keep_language(df: DataFrame, language: str, column: str = "abstract") -> DataFrame:
    """Optional filter on the guessed language of a text."""
    return df.where(text.margin_language(column) == language)


def select_present(df: DataFrame, columns: Sequence[str] = fixed.CLEAN_COLUMNS) -> DataFrame:
    return df.select([c for c in columns if c in df.columns])


def _flags(settings: Settings) -> dict[str, Column]:
    """What decides about a record besides its copies, as narrow booleans."""
    return {
        "has_title": ~text.is_missing("title"),
        "has_abstract": ~text.is_missing("abstract"),
        "is_long": text.words_after_cleanup("abstract") >= settings.min_abstract_words,
    }


def clean_records(
    records: DataFrame,
    order: str = "ord",
    settings: Settings = Settings(),
    keep: Sequence[str] = (),
) -> DataFrame:
    """The whole cleaning step; `keep` names extra columns to carry along.

    Which records stay is decided on narrow rows; the wide rows are joined once
    and only those that stay are normalized.
    """
    rows = dedup.staged_survivors(records, order, extra=_flags(settings))
    kept = rows.where("has_title and has_abstract and is_long").select(F.col("ord").alias(order))
    df = records.join(kept, order, "left_semi")
    df = fill_missing(df, settings.missing_label)
    df = normalize_columns(add_dates(df))
    return select_present(df, [*keep, *fixed.CLEAN_COLUMNS])


LEDGER_STAGES = (
    "initial",
    "exact duplicates removed",
    "identifier duplicates removed",
    "title duplicates removed",
    "abstract duplicates removed",
    "title present",
    "abstract present",
    "abstract long enough",
)


def cleaning_ledger(
    records: DataFrame, order: str = "ord", settings: Settings = Settings()
) -> DataFrame:
    """Rows left after each cleaning stage, in one linear plan over narrow rows."""
    rows = dedup.staged_survivors(records, order, extra=_flags(settings))
    titled = F.col("has_title")
    usable = titled & F.col("has_abstract")
    totals = rows.agg(
        *[F.coalesce(F.sum(f"n_{k}"), F.lit(0)).alias(f"s{k}") for k in range(4)],
        F.count(F.lit(1)).alias("s4"),
        F.count_if(titled).alias("s5"),
        F.count_if(usable).alias("s6"),
        F.count_if(usable & F.col("is_long")).alias("s7"),
    )
    left = F.array(
        *[
            F.struct(
                F.lit(k).alias("step"),
                F.lit(name).alias("stage"),
                F.col(f"s{k}").alias("rows_left"),
                (F.col(f"s{max(k - 1, 0)}") - F.col(f"s{k}")).alias("rows_removed"),
                (F.col(f"s{k}") * 100.0 / F.nullif(F.col("s0"), F.lit(0))).alias("left_pct"),
            )
            for k, name in enumerate(LEDGER_STAGES)
        ]
    )
    return totals.select(F.inline(left))
