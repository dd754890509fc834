"""Topic coherence c_v from sliding windows over the documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

EPSILON = 1e-12
_CHUNK = 1 << 17  # windows that are counted at once by a task


def _pair_windows(first: np.ndarray, last: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
    """words x words: number of windows that hold both, when hit k lies in the windows first[k]..last[k].

    Between two neighbouring ends of such spans all windows hold the same words, so one
    row stands for them: the rows are at most twice the hits, however many windows there are.
    """
    cuts = np.unique(np.concatenate([first, last + 1]))
    size = len(cuts) * words
    steps = np.bincount(np.searchsorted(cuts, first) * words + word, minlength=size)
    steps = steps - np.bincount(np.searchsorted(cuts, last + 1) * words + word, minlength=size)
    inside = (np.cumsum(steps.reshape(len(cuts), words), axis=0)[:-1] > 0).astype(np.float64)
    return (inside * np.diff(cuts)[:, None]).T @ inside


def window_counts(
    docs: DataFrame,
    topics: Sequence[tuple[int, Sequence[str]]],
    column: str = "tokens",
    window: int = 110,
    relevant_only: bool = True,
    models: Sequence[int] | None = None,
) -> DataFrame:
    """Windows that hold word i and word j of a topic: (topic_id, i, j, n), i <= j.

    The row with topic_id -1 holds the number of windows. Every partition adds up
    its own counts, so at most 210 numbers per topic of 20 words leave a task.
    Documents without any of the words are not counted unless asked for. `models`
    gives the model of each topic, from 0: one scan then counts for all of them, and the
    windows of model m, in documents with any of its own words, are in row -1 - m. Windows are counted
    _CHUNK at a time, so a long document is cut, with spans that reach over the cut in both parts.
    """
    listed = sorted({w for _, words in topics for w in words})
    index = {w: i for i, w in enumerate(listed)}
    owners = list(models) if models is not None else [0] * len(topics)
    of_model = np.zeros((max(owners, default=0) + 1, len(listed)), dtype=bool)
    local = []
    for owner, (topic_id, words) in zip(owners, topics):
        of_model[owner, [index[w] for w in words]] = True
        places = np.full(len(listed), -1, dtype=np.int64)
        places[[index[w] for w in words]] = np.arange(len(words))
        local.append((topic_id, places, len(words)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set = pa.array(listed, pa.string())
        sums = {t: np.zeros((m, m)) for t, _, m in local}
        seen = np.zeros(len(of_model), dtype=np.int64)
        for batch in batches:
            lists = batch.column(0)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            found = pc.index_in(lists.flatten(), value_set=value_set)
            word = pc.fill_null(found, -1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            at = np.flatnonzero(word >= 0)
            doc = np.searchsorted(ends, at, side="right")
            pos = at - (ends - sizes)[doc]
            per_doc = np.maximum(sizes - window + 1, 1)
            for number, own in enumerate(of_model):
                counted = np.unique(doc[own[word[at]]]) if relevant_only else slice(None)
                seen[number] += int(per_doc[counted].sum())
            if relevant_only:
                per_doc = np.where(np.bincount(doc, minlength=len(sizes)) > 0, per_doc, 0)
            base = (np.cumsum(per_doc) - per_doc)[doc]
            # both grow from hit to hit, since a document's windows follow those of the one before
            first = base + np.maximum(pos - window + 1, 0)
            last = base + np.minimum(pos, per_doc[doc] - 1)
            word = word[at]
            for begin in range(0, int(per_doc.sum()), _CHUNK):
                end = begin + _CHUNK
                part = slice(np.searchsorted(last, begin), np.searchsorted(first, end))
                f, l, w = np.maximum(first[part], begin), np.minimum(last[part], end - 1), word[part]
                for topic_id, places, m in local:
                    k = places[w]
                    own = k >= 0
                    if own.any():
                        sums[topic_id] += _pair_windows(f[own], l[own], k[own], m)
        rows = [(-1 - number, 0, 0, int(n)) for number, n in enumerate(seen)]
        for topic_id, m in sums.items():
            for i, j in zip(*np.triu_indices(len(m))):
                if m[i, j]:
                    rows.append((topic_id, int(i), int(j), int(m[i, j])))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(),) * 3 + (pa.int64(),))],
            names=["topic_id", "i", "j", "n"],
        )

    partial = docs.select(column).mapInArrow(count, "topic_id int, i int, j int, n long")
    return partial.groupBy("topic_id", "i", "j").agg(F.sum("n").alias("n"))


def topic_coherence(counts: DataFrame, n_words: int = 20, models: Sequence[int] | None = None) -> DataFrame:
    """c_v per topic from stored window counts: (topic_id, coherence).

    Everything here has topics x words x words rows at most. `models` as for `window_counts`, for topics numbered from 0.
    """
    total = counts.where("topic_id = -1").select(F.col("n").cast("double")).scalar()
    if models is not None:
        windows = {-1 - r["topic_id"]: float(r["n"]) for r in counts.where("topic_id < 0").collect()}
        total = F.get(F.array(*[F.lit(windows.get(m, 0.0)) for m in models]), F.col("topic_id"))
    rows = counts.where("topic_id >= 0")
    single = rows.where("i = j").select("topic_id", "i", F.col("n").alias("n_i"))
    spots = single.select("topic_id").distinct().select(
        "topic_id",
        F.explode(F.sequence(F.lit(0), F.lit(n_words - 1))).alias("i"),
    ).select("topic_id", "i", F.explode(F.sequence(F.lit(0), F.lit(n_words - 1))).alias("j"))
    both = rows.select(
        "topic_id",
        F.explode(F.array_distinct(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))).alias("p"),
        "n",
    ).select("topic_id", "p.i", "p.j", F.col("n").alias("n_ij"))
    joined = (
        spots.join(both, ["topic_id", "i", "j"], "left")
        .join(single, ["topic_id", "i"], "left")
        .join(single.select("topic_id", F.col("i").alias("j"), F.col("n_i").alias("n_j")), ["topic_id", "j"], "left")
    )
    p_ij = F.coalesce(F.col("n_ij"), F.lit(0)) / total + EPSILON
    npmi = F.when(
        F.col("n_i").isNull() | F.col("n_j").isNull(), F.lit(0.0)
    ).otherwise(F.ln(p_ij / ((F.col("n_i") / total) * (F.col("n_j") / total))) / -F.ln(p_ij))
    v = joined.select("topic_id", "i", "j", npmi.alias("x"))
    summed = F.sum("x").over(Window.partitionBy("topic_id", "j"))
    by_word = (
        v.withColumn("s", summed)
        .groupBy("topic_id", "i")
        .agg(
            F.sum(F.col("x") * F.col("s")).alias("xs"),
            F.sum(F.col("x") * F.col("x")).alias("xx"),
            F.sum(F.col("s") * F.col("s")).alias("ss"),
        )
    )
    scale = F.sqrt("xx") * F.sqrt("ss")
    cosine = F.when(scale > 0, F.col("xs") / scale).otherwise(F.lit(0.0))
    return by_word.groupBy("topic_id").agg(F.avg(cosine).alias("coherence"))


def model_coherence(per_topic: DataFrame) -> DataFrame:
    return per_topic.agg(F.avg("coherence").alias("coherence"))
