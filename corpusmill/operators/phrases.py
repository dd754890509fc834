"""Word pairs that occur together more often than chance, and their merging."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill import runtime
from corpusmill.runtime import materialize, spread_join

DELIMITER = "_"
#: Bytes of phrases that a scan of the documents carries; more phrases take more scans.
SCAN_BYTES = 32 << 20
#: Tokens that a task merges at a time.
SLICE_TOKENS = 1 << 18
#: Numbered pairs that a task counts before it passes them on, and those that a task sums after the shuffle.
TASK_PAIRS, SUM_PAIRS = 1 << 22, 1 << 22


def adjacent_pairs(tokens: Column) -> Column:
    """Array of (pos, w1, w2) for neighbouring tokens, built inside the row."""
    n = F.size(tokens)
    lefts = F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0)))
    rights = F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0)))
    pairs = F.zip_with(lefts, rights, lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))
    return F.when(n > 1, pairs)


def count_pairs(docs: DataFrame, column: str = "tokens") -> DataFrame:
    """Occurrences of every token with its follower; w2 is null at the end of a document.

    One row per token is counted, combined on the map side, in one shuffle.
    """
    tokens = F.col(column)
    followers = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    # the shorter array is filled up with null
    pairs = F.zip_with(tokens, followers, lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))
    return docs.select(F.inline(pairs)).groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"))


def count_singles(pairs: DataFrame) -> DataFrame:
    """Occurrences of every token, summed from the pair counts it starts."""
    return pairs.groupBy("w1").agg(F.sum("n").alias("n"))


def score_pairs(
    pairs: DataFrame, singles: DataFrame, min_count: int = 20, n_pairs: Column | None = None
) -> DataFrame:
    """Score every pair that occurs more than `min_count` times.

    score = (n_ab - min_count) / n_a / n_b * L, where L is the number of distinct
    tokens plus distinct pairs. Both inputs should be stored tables. Rarer pairs
    score zero or less, so they, and tokens too rare to be part of a scored pair,
    are left out before the joins. `n_pairs` is the number of distinct pairs where
    `pairs` does not have them all.
    """
    if n_pairs is None:
        n_pairs = pairs.where("w2 is not null").agg(F.count(F.lit(1))).scalar()
    n_singles = singles.agg(F.count(F.lit(1))).scalar()
    often = singles.where(F.col("n") > min_count)
    left = often.select("w1", F.col("n").alias("n1"))
    right = often.select(F.col("w1").alias("w2"), F.col("n").alias("n2"))
    score = (F.col("n") - min_count) / F.col("n1") / F.col("n2") * (n_pairs + n_singles)
    scored = pairs.where((F.col("n") > min_count) & F.col("w2").isNotNull())
    # a word may have very many followers: beyond the broadcast limit its pairs are spread
    scored = spread_join(spread_join(scored, left, "w1", "w2"), right, "w2", "w1")
    return scored.select("w1", "w2", "n", score.alias("score"))


def fit_phrases(
    docs: DataFrame, column: str = "tokens", min_count: int = 20, threshold: float = 10.0
) -> DataFrame:
    """Stored phrase table (w1, w2, n, score): pairs that score above the threshold."""
    words = docs.select(F.explode(column).alias("w1")).groupBy("w1").agg(F.count(F.lit(1)).alias("n"))
    singles = materialize(words, "singles")
    pairs, n_pairs = _frequent_pairs(docs, singles, column, min_count)
    scored = score_pairs(pairs, singles, min_count, F.lit(n_pairs))
    return materialize(scored.where(F.col("score") > threshold), "phrases")


def _frequent_pairs(docs: DataFrame, singles: DataFrame, column: str, min_count: int) -> tuple[DataFrame, int]:
    """Stored pairs that occur more than `min_count` times, and the number of all distinct pairs.

    Both words of such a pair occur as often. Pairs of words that do (the BROADCAST_ROWS most
    frequent of them) are shuffled as one number; those with another word as two strings. Pairs that occur less often are
    only counted, where they were summed.
    """
    spark = docs.sparkSession
    often = singles.where((F.col("n") > min_count) & F.col("w1").isNotNull())
    listed = often.orderBy(F.desc("n"), "w1").limit(runtime.BROADCAST_ROWS).select("w1").toArrow()
    shared = spark.sparkContext.broadcast(pa.array(listed.column("w1").to_pylist(), pa.string()))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            _, first, second = _neighbours(batch.column(0), shared.value)
            both = (first >= 0) & (second >= 0)
            held.append(first[both] << 32 | second[both])
            size += len(held[-1])
            if size >= TASK_PAIRS:
                yield from _counted(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from _counted(np.concatenate(held))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, first, second = _neighbours(batch.column(0), shared.value)
            at = at[(first < 0) | (second < 0)]
            flat = batch.column(0).flatten()
            yield pa.RecordBatch.from_arrays([flat.take(pa.array(at)), flat.take(pa.array(at + 1))], names=["w1", "w2"])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy()
            words = [shared.value.take(pa.array(x)) for x in (k >> 32, k & 0xFFFFFFFF)]
            yield pa.RecordBatch.from_arrays([*words, batch.column(1)], names=["w1", "w2", "n"])

    tokens = docs.select(column)
    # the rows come combined from the tasks, so they are only combined again after the shuffle
    total = singles.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(math.ceil(total / SUM_PAIRS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    codes = tokens.mapInArrow(numbered, "k long, n long").repartition(parts, "k").groupBy("k").agg(F.sum("n").alias("n"))
    plain = tokens.mapInArrow(others, "w1 string, w2 string").where("w2 is not null").groupBy("w1", "w2")
    plain = plain.agg(F.count(F.lit(1)).alias("n"))
    codes, plain = (
        materialize(_folded(codes, F.col("n") > min_count, ["k"]), "pairs"),
        materialize(_folded(plain, (F.col("n") > min_count) & F.col("w1").isNotNull(), ["w1", "w2"]), "pairs"),
    )
    n_pairs = sum(t.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0] for t in (codes, plain))
    found = codes.where("n is not null").select("k", "n").mapInArrow(spelled, "w1 string, w2 string, n long")
    return materialize(found.unionByName(plain.where("n is not null").drop("pairs")), "frequent-pairs"), n_pairs


def _folded(counts: DataFrame, keep: Column, keys: list[str]) -> DataFrame:
    """Rows to keep, and one row of nulls for all others, with the number of rows each stands for in `pairs`."""
    rows = counts.select(*[F.when(keep, F.col(c)).alias(c) for c in (*keys, "n")])
    return rows.groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("pairs"))


def _neighbours(tokens: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the flat tokens that have a follower in their row, and the numbers of both tokens among `words` or -1."""
    flat = tokens.flatten()
    code = pc.fill_null(pc.index_in(flat, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    inside = np.ones(len(flat), dtype=bool)
    inside[np.cumsum(sizes)[sizes > 0] - 1] = False
    at = np.flatnonzero(inside)
    return at, code[at], code[at + 1]


def _counted(codes: np.ndarray) -> Iterator[pa.RecordBatch]:
    k, n = np.unique(codes, return_counts=True)
    for begin in range(0, len(k), 1 << 18):
        own = slice(begin, begin + (1 << 18))
        yield pa.RecordBatch.from_arrays([pa.array(k[own]), pa.array(n[own].astype(np.int64))], names=["k", "n"])


# -- merging, inside the row ----------------------------------------------------


def _hits(tokens: pa.Array, words: pa.Array, pairs: np.ndarray) -> np.ndarray:
    """Places in the flat tokens whose token and follower are a known pair.

    `pairs` holds sorted numbers: place of the first word among `words`, times their
    number, plus the place of the second.
    """
    flat = tokens.flatten()
    if len(flat) < 2 or not len(pairs):
        return np.zeros(0, np.int64)
    code = pc.fill_null(pc.index_in(flat, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    known = (code[:-1] >= 0) & (code[1:] >= 0)
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    known[ends[(ends > 0) & (ends < len(flat))] - 1] = False  # the follower is in the next row
    at = np.flatnonzero(known)
    pair = code[at] * len(words) + code[at + 1]
    place = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
    return at[pairs[place] == pair]


def _taken(hits: np.ndarray) -> np.ndarray:
    """What a scan from left to right merges: every second hit of an unbroken run."""
    if not len(hits):
        return hits
    starts = np.flatnonzero(np.concatenate([[True], np.diff(hits) != 1]))
    nth = np.arange(len(hits)) - np.repeat(starts, np.diff(np.append(starts, len(hits))))
    return hits[nth % 2 == 0]


def _merged(tokens: pa.Array, starts: np.ndarray) -> pa.Array:
    """Token lists in which the tokens at the starts are joined with their followers."""
    flat = tokens.flatten()
    joined = pc.binary_join_element_wise(flat.take(pa.array(starts)), flat.take(pa.array(starts + 1)), DELIMITER)
    place, kept = np.arange(len(flat)), np.ones(len(flat), dtype=bool)
    place[starts] = len(flat) + np.arange(len(starts))
    kept[starts + 1] = False
    out = pa.concat_arrays([flat, joined.cast(flat.type)]).take(pa.array(place[kept]))
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(kept)])
    offsets = before[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
    absent = pc.is_null(tokens).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(absent, False)), out)


def _lists(flat_places: np.ndarray, tokens: pa.Array) -> pa.Array:
    """Places in the flat tokens as lists of positions in their rows."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    row = np.searchsorted(ends, flat_places, side="right")
    offsets = np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array((flat_places - (ends - sizes)[row]).astype(np.int32)))


def _flat(lists: pa.Array, tokens: pa.Array) -> np.ndarray:
    """The inverse of `_lists`."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    per_row = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(np.cumsum(sizes) - sizes, per_row)


def _by_rows(tokens: pa.Array, work: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """`work` on rows with about SLICE_TOKENS tokens at a time, which bounds its memory; a longer row is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    out, row = [], 0
    while row < len(tokens):
        before = ends[row - 1] if row else 0
        stop = max(int(np.searchsorted(ends, before + SLICE_TOKENS, "right")), row + 1)
        out.append(work(tokens.slice(row, stop - row)))
        row = stop
    return pa.concat_arrays(out) if out else work(tokens)


def _slices(phrases: DataFrame) -> int:
    """Number of slices of a stored phrase table that are small enough to go along with a scan."""
    size = F.octet_length("w1") + F.octet_length("w2") + 24
    return int(phrases.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] // SCAN_BYTES) + 1


def _finder(phrases: DataFrame, slices: int, number: int) -> Callable[[pa.Array], np.ndarray]:
    """Finds the hits of one slice of the phrases; the slice is broadcast."""
    rows = phrases.select("w1", "w2")
    if slices > 1:
        rows = rows.where(F.pmod(F.xxhash64("w1", "w2"), F.lit(slices)) == number)
    found = rows.toArrow().combine_chunks()
    words = pc.unique(pa.chunked_array([*found.column("w1").chunks, *found.column("w2").chunks], pa.string()))
    first, second = (pc.index_in(found.column(c), value_set=words).to_numpy().astype(np.int64) for c in ("w1", "w2"))
    shared = phrases.sparkSession.sparkContext.broadcast((words, np.sort(first * len(words) + second)))
    return lambda tokens: _hits(tokens, *shared.value)


def _scan(docs: DataFrame, phrases: DataFrame, column: str, finish: Callable[[pa.Array, np.ndarray], pa.Array], kind: str, output: str) -> DataFrame:
    """`docs` with `finish(tokens, places to merge)` as a column.

    The documents are scanned where they are: no shuffle, and nothing depends on how
    often a pair occurs. Phrases beyond SCAN_BYTES take a stored scan per slice, which adds its hits.
    """
    slices = _slices(phrases)
    if slices == 1:
        find = _finder(phrases, 1, 0)

        @F.arrow_udf(kind)
        def whole(tokens: pa.Array) -> pa.Array:
            return _by_rows(tokens, lambda some: finish(some, _taken(find(some))))

        return docs.withColumn(output, whole(column))
    held = "_hits"
    while held in docs.columns:
        held += "_"
    for number in range(slices):
        find = _finder(phrases, slices, number)

        @F.arrow_udf("array<int>")
        def part(tokens: pa.Array) -> pa.Array:
            return _lists(find(tokens), tokens)

        hits = part(column) if number == 0 else F.concat(held, part(column))
        docs = materialize(docs.withColumn(held, hits), "phrase-hits")

    @F.arrow_udf(kind)
    def last(tokens: pa.Array, hits: pa.Array) -> pa.Array:
        return finish(tokens, _taken(np.sort(_flat(hits, tokens))))

    return docs.withColumn(output, last(column, held)).drop(held)


def merge_starts(docs: DataFrame, phrases: DataFrame, column: str = "tokens", key: str = "doc_id") -> DataFrame:
    """Positions (from 0) at which two tokens of a document are merged, for a stored phrase table."""
    found = _scan(docs.select(key, column), phrases, column, lambda tokens, at: _lists(at, tokens), "array<int>", "_starts")
    return found.select(key, F.explode("_starts").alias("pos"))


def apply_phrases(docs: DataFrame, phrases: DataFrame, column: str = "tokens") -> DataFrame:
    """Replace `column` by its merged form; all other columns and rows are kept. `phrases` is a stored table."""
    return _scan(docs, phrases, column, _merged, "array<string>", column)


def is_phrase(token: Column) -> Column:
    return token.contains(DELIMITER)
