"""Keep-first deduplication in stages.

Every stage is one grouped minimum over narrow rows: ingest order, identifier
and fixed-length digests. Copies of a hot value collapse on the map side, so no
task ever holds a whole group, and the wide text columns are not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill import fixed_values as fixed

STAGES = ("row", "identifier", "title", "abstract")


def digest(column: str) -> Column:
    """SHA-256 of a value, 32 bytes; null stays null and forms one group."""
    return F.unhex(F.sha2(F.col(column), 256))


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 over the digests of several columns; nulls count as a value."""
    parts = F.struct(*[F.sha2(F.col(c).cast("string"), 256).alias(c) for c in columns])
    return F.unhex(F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256))


def _keys(df: DataFrame, order: str, columns: Sequence[str], extra: dict[str, Column]) -> DataFrame:
    return df.select(
        F.col(order).alias("ord"),
        row_digest(columns).alias("row"),
        *[digest(c).alias(c) for c in STAGES[1:]],
        *[value.alias(name) for name, value in extra.items()],
    )


def staged_survivors(
    df: DataFrame,
    order: str = "ord",
    columns: Sequence[str] = fixed.RAW_COLUMNS,
    stages: Sequence[str] = STAGES,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """One narrow row per survivor of all stages, with running stage counts.

    `n_0` counts the input rows folded into a survivor, `n_k` the rows that were
    still there after stage k, so their sums give the whole ledger in this pass.
    """
    extra = extra or {}
    rows = _keys(df, order, columns, extra)
    payload = ["identifier", "title", "abstract", *extra]
    counts: list[str] = []
    for position, stage in enumerate(stages):
        rest = [c for c in payload if c != stage]
        sums = [F.sum(c).alias(c) for c in counts]
        rows = rows.groupBy(stage).agg(
            F.min(F.struct("ord", *rest)).alias("first"),
            *sums,
            F.count(F.lit(1)).alias(f"n_{position}"),
        )
        counts.append(f"n_{position}")
        rows = rows.select(
            "first.ord",
            *[F.col(stage) if c == stage else F.col(f"first.{c}") for c in payload],
            *counts,
        )
    return rows


def keep_first(
    df: DataFrame,
    order: str = "ord",
    columns: Sequence[str] = fixed.RAW_COLUMNS,
    stages: Sequence[str] = STAGES,
) -> DataFrame:
    """Rows of `df` that survive the stages; the first in ingest order wins.

    The order column must be unique, since it also identifies the rows.
    """
    kept = staged_survivors(df, order, columns, stages).select(F.col("ord").alias(order))
    return df.join(kept, order, "left_semi")


def duplicate_counts(df: DataFrame, columns: Sequence[str] = fixed.RAW_COLUMNS) -> DataFrame:
    """Duplicates (rows beyond the first) over all columns and per key column.

    The four keys are counted in one pass: each row becomes four narrow rows that
    are combined on the map side.
    """
    kinds = {"all columns": row_digest(columns)} | {c: digest(c) for c in STAGES[1:]}
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in kinds.items()])
    groups = (
        df.select(F.inline(pairs)).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))
    )
    return groups.groupBy("kind").agg(
        F.sum(F.col("n") - 1).alias("duplicates"),
        (F.sum(F.col("n") - 1) * 100.0 / F.nullif(F.sum("n"), F.lit(0))).alias("duplicate_pct"),
    )


def most_repeated(df: DataFrame, column: str, k: int = 10, order: str = "ord") -> DataFrame:
    """The k values that occur most often, among those that occur more than once.

    Equal counts go by first appearance. One aggregate over digests carries the smallest
    `order` (a unique column) of each value; copies of a hot value collapse on the map
    side, and only the k rows named that way are read for their texts.
    """
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(digest(column).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
        .where("n > 1")
    )
    best = counts.orderBy(F.desc("n"), "first").limit(k).select("first", "n").collect()
    top = df.sparkSession.createDataFrame([(r["first"], r["n"]) for r in best], "first long, n long")
    texts = df.where(F.col(order).isin([r["first"] for r in best])).select(F.col(order).alias("first"), F.col(column).alias("value"))
    return texts.join(F.broadcast(top), "first").orderBy(F.desc("n"), "first").select("value", "n")
