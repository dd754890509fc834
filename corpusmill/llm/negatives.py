"""Hard negatives by segment summaries: bounds on scores first, exact scores for what is left.

A vector is cut into segments, at several levels from coarse to fine. Per segment its
mean m and deviation s are stored (weighted with the root of its length). By Cauchy and
Schwarz the inner product of two segments lies within m*m' - s*s' and m*m' + s*s', so
the sums over a level's segments bound the score of a pair. A finer level is only looked
at for pairs that the coarser one left open, and the exact integer product only
for pairs that all levels left open.

Anchors go in blocks against all rows: a block's vectors are broadcast, each task keeps
the best of its rows per anchor, and the tasks' lists are merged by rank. The worst score that a task
keeps for an anchor raises the bound that later rows must reach. A block takes
two passes: one for positives (same label), one for the negatives (other labels) of
every window of scores that the positives give.

Defined results: rows with a null label, a null vector, or a component that is null, not
finite, or not within -4096 and 4096 (so that no score overflows) take no part. A shorter vector
counts as if it ended in zeros. Rows that repeat a key are rows of their own: one can be a
positive of the other. A null key is no anchor, comes after all keys among equal scores and is returned as null. Ties
go by key. A positive with a negative score has no window, hence no rows. An empty table gives no rows.
Columns other than the three that are named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.runtime import materialize, scratch_path

#: Segments per level.
LEVELS = (1, 4, 16)
SCALE = 256
LARGEST = 4096
#: Anchors that are broadcast at a time, and rows that a task compares with them at a time.
BLOCK, ROWS = 2048, 2048
#: Below this share of open pairs, pairs are bounded and scored one by one.
SPARSE = 0.05
_NO_KEY = np.iinfo(np.int64).max
_LOWEST = np.iinfo(np.int64).min


# -- summaries --------------------------------------------------------------------


def borders(width: int) -> list[np.ndarray]:
    """Where the segments of each level begin; a level has no more segments than the vector has components."""
    return [np.unique(np.arange(n) * width // n) for n in LEVELS] if width else []


def summaries(v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level the weighted means and deviations of all rows' segments."""
    out = []
    for begin in borders(v.shape[1]):
        length = np.diff(np.append(begin, v.shape[1]))
        mean = np.add.reduceat(v, begin, axis=1) / length
        apart = v - np.repeat(mean, length, axis=1)
        deviation = np.sqrt(np.add.reduceat(apart * apart, begin, axis=1) / length)
        out.append((mean * np.sqrt(length), deviation * np.sqrt(length)))
    return out


@dataclass
class Rows:
    row: np.ndarray
    key: np.ndarray
    label: np.ndarray
    v: np.ndarray  # whole numbers, as doubles
    levels: list[tuple[np.ndarray, np.ndarray]]


def unpacked(batch: pa.RecordBatch, width: int) -> Rows:
    """Rows as `prepare` stored them."""
    n = batch.num_rows
    column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    matrix = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    levels, stored, at = [], matrix("summary") if width else None, 0
    for begin in borders(width):
        k = len(begin)
        levels.append((stored[:, at : at + k], stored[:, at + k : at + 2 * k]))
        at += 2 * k
    v = matrix("v").astype(np.float64) if width else np.zeros((n, 0))
    return Rows(column("row"), batch.column("key").fill_null(_NO_KEY).to_numpy(), column("label"), v, levels)


def prepare(df: DataFrame, key: str, label: str, vector: str, anchors: Column) -> tuple[DataFrame, int, int]:
    """The rows that take part, with whole numbers and summaries; the vectors' width and largest component."""
    x = F.col(vector)
    usable = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("int"))
    narrow = df.filter(F.col(label).isNotNull() & x.isNotNull() & usable).select(
        F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"),
        F.coalesce(anchors & F.col(key).isNotNull(), F.lit(False)).alias("anchor"), whole.alias("v"),
    )
    width, largest = narrow.agg(
        F.coalesce(F.max(F.size("v")), F.lit(0)),
        F.coalesce(F.max(F.greatest(F.array_max("v"), -F.array_min("v"))), F.lit(0)),
    ).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            n, lists = batch.num_rows, batch.column("v")
            v = np.zeros((n, width))
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            v[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            found = [x for level in summaries(v) for x in level]
            packed = np.concatenate(found, axis=1) if found else np.zeros((n, 0))
            list_of = lambda m, kind: pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1, dtype=np.int32) * m.shape[1]), pa.array(m.astype(kind).ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(made, made + n)), *(batch.column(c) for c in ("key", "label", "anchor")), list_of(v, np.int32), list_of(packed, np.float64)],
                names=["row", "key", "label", "anchor", "v", "summary"],
            )
            made += n

    schema = "row long, key long, label long, anchor boolean, v array<int>, summary array<double>"
    return materialize(narrow.mapInArrow(run, schema), "negatives-rows"), width, largest


# -- bounds and scores ----------------------------------------------------------------


def scored(a: Rows, r: Rows, ai: np.ndarray, rj: np.ndarray, open_: np.ndarray | None, need: np.ndarray, cap: np.ndarray, slack: float, exact: bool):
    """Pairs of anchors `ai` and rows `rj` whose scores may be within need and cap (per anchor), and their scores.

    `open_` says which pairs count at all. `exact` is false where doubles would round the products.
    """
    x = y = None
    for (am, ad), (rm, rd) in zip(a.levels, r.levels):
        if x is None:
            middle, spread = am[ai] @ rm[rj].T, ad[ai] @ rd[rj].T
            spread += slack
            may = (middle + spread >= need[:, None]) & (middle - spread <= cap[:, None])
            open_ = may if open_ is None else open_ & may
            some_a, some_r = open_.any(axis=1), open_.any(axis=0)
            ai, rj, need, cap, open_ = ai[some_a], rj[some_r], need[some_a], cap[some_a], open_[np.ix_(some_a, some_r)]
            if not open_.size:
                break
            if open_.mean() < SPARSE:
                x, y = np.nonzero(open_)
        else:
            middle = np.einsum("ij,ij->i", am[ai[x]], rm[rj[y]])
            spread = np.einsum("ij,ij->i", ad[ai[x]], rd[rj[y]]) + slack
            may = (middle + spread >= need[x]) & (middle - spread <= cap[x])
            x, y = x[may], y[may]
    if x is not None or not exact:
        if x is None:
            x, y = np.nonzero(open_) if open_ is not None else (g.ravel() for g in np.indices((len(ai), len(rj))))
        kind = np.float64 if exact else np.int64
        score = np.einsum("ij,ij->i", a.v[ai[x]].astype(kind), r.v[rj[y]].astype(kind))
    else:
        products = a.v[ai] @ r.v[rj].T
        x, y = np.nonzero(open_) if open_ is not None else (g.ravel() for g in np.indices(products.shape))
        score = products[x, y]
    score = score.astype(np.int64)
    within = (score >= need[x]) & (score <= cap[x])
    return ai[x[within]], rj[y[within]], score[within]


class Best:
    """The best `k` (score, key) of each of `n` lists: higher scores first, then smaller keys."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), _LOWEST)
        self.key = np.full((n, k), _NO_KEY)

    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, of: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        last = self.score[of, -1]
        good = (score > last) | ((score == last) & (key < self.key[of, -1]))
        of, score, key = of[good], score[good], key[good]
        if not len(of):
            return
        touched = np.unique(of)
        of = np.concatenate([np.repeat(touched, self.k), of])
        score = np.concatenate([self.score[touched].ravel(), score])
        key = np.concatenate([self.key[touched].ravel(), key])
        order = np.lexsort((key, ~score, of))  # ~score falls as the score rises
        of, score, key = of[order], score[order], key[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        kept = rank < self.k
        self.score[of[kept], rank[kept]] = score[kept]
        self.key[of[kept], rank[kept]] = key[kept]

    def batch(self) -> pa.RecordBatch:
        of, rank = np.nonzero(self.score > _LOWEST)
        key = self.key[of, rank]
        return pa.RecordBatch.from_arrays(
            [pa.array(of.astype(np.int32)), pa.array(key, mask=key == _NO_KEY), pa.array(self.score[of, rank])], names=["of", "key", "score"]
        )


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Rows]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield unpacked(batch.slice(at, ROWS), width)


def _slack(a: Rows, largest: int) -> float:
    """More than the rounding of any bound, less than the distance of two scores where doubles are exact."""
    return 0.25 + 1e-9 * a.v.shape[1] * float(np.abs(a.v).max(initial=0)) * largest


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("of").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _positives(rows: DataFrame, shared, width: int, largest: int, k: int) -> DataFrame:
    """(of, key, score, rank): the best k other rows of each anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        best, slack, exact = Best(len(a.row), k), _slack(a, largest), width * largest * largest < 1 << 53
        for r in _pieces(batches, width):
            for label in np.intersect1d(a.label, r.label):
                ai, rj = np.flatnonzero(a.label == label), np.flatnonzero(r.label == label)
                need = best.worst()[ai].astype(np.float64)
                x, y, score = scored(a, r, ai, rj, None, need, np.full(len(ai), np.inf), slack, exact)
                other = a.row[x] != r.row[y]
                best.add(x[other], score[other], r.key[y[other]])
        yield best.batch()

    return _ranked(rows.mapInArrow(run, "of int, key long, score long"), k)


def _negatives(rows: DataFrame, shared, windows, width: int, largest: int, k: int) -> DataFrame:
    """(of, key, score, rank): for each window, the best k rows of other labels than its anchor's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, (of, low, high) = shared.value, windows.value  # windows by anchor
        best, slack, exact = Best(len(of), k), _slack(a, largest), width * largest * largest < 1 << 53
        ai, first = np.unique(of, return_index=True)
        end = np.append(first[1:], len(of))
        for r in _pieces(batches, width):
            if not len(ai):
                break
            need = np.minimum.reduceat(np.maximum(low, best.worst()), first).astype(np.float64)
            cap = np.maximum.reduceat(high, first).astype(np.float64)
            differ = a.label[ai][:, None] != r.label
            x, y, score = scored(a, r, ai, np.arange(len(r.row)), differ, need, cap, slack, exact)
            place = np.searchsorted(ai, x)
            for nth in range(int((end - first).max())):
                window = first[place] + nth
                mine = window < end[place]
                mine[mine] = (score[mine] >= low[window[mine]]) & (score[mine] <= high[window[mine]])
                best.add(window[mine], score[mine], r.key[y[mine]])
        yield best.batch()

    return _ranked(rows.mapInArrow(run, "of int, key long, score long"), k)


# -- the operator -----------------------------------------------------------------------


def mine(
    df: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """Per anchor (a condition on rows), positive and negative: keys, rank and scores.

    A negative's score lies between `low` and `high` hundredths of the positive's.
    """
    spark = df.sparkSession
    rows, width, largest = prepare(df, key, label, vector, anchors)
    chosen = rows.filter("anchor")
    blocks = -(-chosen.count() // BLOCK)
    chosen = materialize(chosen.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(blocks, 1))).cast("int")), "negatives-anchors")
    path = scratch_path(spark, "negatives-found")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for block in range(blocks):
        # about BLOCK rows: keys of rows are unique, so blocks are even
        a = chosen.filter(F.col("block") == block).drop("block").toArrow().combine_chunks()
        a = unpacked(a.to_batches()[0], width) if a.num_rows else None
        if a is None:
            continue
        shared = spark.sparkContext.broadcast(a)
        found = _positives(rows, shared, width, largest, positives).sort("of", "rank").toArrow()
        of, score = (found.column(c).to_numpy() for c in ("of", "score"))
        windows = spark.sparkContext.broadcast((of, -(-low * score // 100), high * score // 100))
        names = spark.createDataFrame(
            pa.table(
                {
                    "of": pa.array(np.arange(len(of), dtype=np.int32)), "anchor_id": a.key[of],
                    "positive_id": found.column("key"), "positive_score": score,
                }
            )
        )
        hard = _negatives(rows, shared, windows, width, largest, negatives)
        hard.withColumnsRenamed({"key": "negative_id", "score": "negative_score"}).join(F.broadcast(names), "of").select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
        ).write.mode("append").parquet(path)
        shared.destroy()
        windows.destroy()
    return spark.read.schema(schema).parquet(path)
