"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Equal texts form a group, and a group is placed whole, where the dot product of
its vector with the shards' residual capacity is highest. A group above
1 / PIECES of all bytes, of all tokens or of all rows is dealt into pieces by a hash
of the key first, so no task and no shard has to take a whole hot group.

Packing runs on narrow rows: one per group, spread over tasks by the group's hash.
Every task packs its groups, largest first, into its own share of the capacities,
so the imbalance of a task is about the size of its smallest groups, and tasks
need no word from each other.

Defined results: a null text has size 1 and is grouped with the empty text; rows
without a key value are placed too; an empty table gives no rows; equal keys that
repeat are separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corpusmill.llm.common import unused
from corpusmill.runtime import materialize

#: Groups above 1 / PIECES of all bytes, tokens or rows are dealt into pieces.
PIECES = 512
GROUPS_PER_TASK = 200_000
ROWS_PER_RUN = 100_000
#: Weight of bytes, tokens and rows in the dot product: bytes come first, as small groups are mostly row.
WEIGHTS = np.array([1.0, 0.2, 0.005])


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each vector: largest first, to the highest dot product with what is left.

    Capacities and vectors are in shares of the totals, weighed by WEIGHTS.
    Ties go to the shard with the lower number.
    """
    total = np.maximum(vectors.sum(axis=0), 1e-300)
    share = vectors / total
    left = np.full((shards, vectors.shape[1]), 1.0 / shards)
    out = np.zeros(len(vectors), dtype=np.int32)
    for i in np.lexsort((*vectors.T[::-1], -(share @ WEIGHTS))):
        out[i] = k = int((left @ (WEIGHTS * share[i])).argmax())
        left[k] -= share[i]
    return out


def _placed(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    groups = pa.Table.from_batches(held).sort_by([("digest", "ascending"), ("piece", "ascending")])
    vectors = np.stack([groups[c].to_numpy().astype(float) for c in ("bytes", "tokens", "rows")], axis=1)
    out = groups.select(["digest", "piece"]).append_column("shard", pa.array(pack(vectors, shards), pa.int32()))
    yield from out.to_batches(max_chunksize=50_000)


def assign(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """Per row: the key, `size`, `text_crc32`, `shard` and `slot` (gapless from 0 in each shard)."""
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    (name,) = unused(df, "row_key")
    rows = materialize(
        df.select(
            F.col(key).alias(name),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.size(F.split(body, " ", -1)).cast("long").alias("n_tokens"),
            F.unhex(F.md5(body.cast("binary"))).alias("digest"),
        ),
        "shard-rows",
    )
    n, *totals = rows.agg(F.count("*"), *(F.coalesce(F.sum(c), F.lit(1)) for c in ("size", "n_tokens"))).first()
    most = [max(t // PIECES, 1) for t in (*totals, n)]

    by_digest = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    excess = F.greatest(*(F.col(c) / m for c, m in zip(("bytes", "tokens", "rows"), most)))
    hot = F.broadcast(  # a few PIECES rows at most, as each holds more than about 1 / PIECES of a total
        by_digest.filter((excess > 1) & (F.col("rows") > 1)).select("digest", F.ceil(8 * excess).alias("pieces"))
    )
    pieces = rows.join(hot, "digest", "left").withColumn(
        "piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64(name), F.col("pieces"))).cast("int")
    )
    groups = materialize(
        pieces.groupBy("digest", "piece").agg(
            F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")
        ),
        "shard-groups",
    )
    tasks = max(1, -(-groups.count() // GROUPS_PER_TASK))
    placed = materialize(
        groups.repartition(tasks, "digest", "piece").mapInArrow(
            lambda batches: _placed(batches, shards), "digest binary, piece int, shard int"
        ),
        "shard-groups-placed",
    )
    runs = max(1, -(-n // ROWS_PER_RUN))
    dealt = materialize(
        pieces.join(placed, ["digest", "piece"])
        .select(name, "size", "text_crc32", "shard")
        .withColumn("run", F.pmod(F.xxhash64(name, "text_crc32"), F.lit(runs)).cast("int")),
        "shard-dealt",
    )
    # slots: rows of earlier runs of the shard, plus the place inside the run
    counts = dealt.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = counts.withColumn(
        "before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("shard", "run", "before")
    place = F.row_number().over(Window.partitionBy("shard", "run").orderBy(name, "text_crc32"))
    return (
        dealt.withColumn("place", place)
        .join(before, ["shard", "run"])
        .select(F.col(name).alias(key), "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).alias("slot"))
    )
