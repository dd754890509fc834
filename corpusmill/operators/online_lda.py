"""Online variational Bayes for LDA with all updates in one stage.

The updates are those of Spark ML's `online` optimiser (Hoffman, Blei and Bach 2010): the same random
start, the same documents in every update, the same limit of change per document, the same steps
of the topics and of learned concentrations. There, every update is two jobs of up to three stages, whose
scheduling costs more than the work on `chunk_size` documents. Here the tasks of one barrier
stage keep their documents and a copy of the topics for all updates. After each update
every task writes its sums to a file in the shared folder and adds up those of the others.
"""

from __future__ import annotations

import math
import os
import struct
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import BarrierTaskContext
from pyspark.ml.clustering import LDA, LDAModel, LocalLDAModel
from pyspark.ml.linalg import Vectors
from pyspark.mllib.common import _py2java
from pyspark.mllib.linalg import DenseMatrix, DenseVector
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.runtime import scratch_path

#: Numbers (documents x terms x topics) that are iterated at once.
_BLOCK = 1 << 17
_GAMMA_SHAPE = 100.0
#: Beyond it Spark draws another way; an update is then most of the corpus, and there are few of them.
LARGEST_SHARE = 0.4
_STEP = 1e-3  # a document's topics are done when they change by less on average

# -- Spark's random numbers ---------------------------------------------------------

_48, _64 = (1 << 48) - 1, (1 << 64) - 1


def _signed(x: int, bits: int) -> int:
    return x - (1 << bits) if x >> (bits - 1) else x


class JavaRandom:
    """java.util.Random, as far as `nextLong`."""

    def __init__(self, seed: int) -> None:
        self.state = (seed ^ 0x5DEECE66D) & _48

    def _next(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & _48
        return _signed(self.state >> 16, 32)

    def next_long(self) -> int:
        high = self._next() << 32
        return _signed((high + self._next()) & _64, 64)


def _murmur(data: bytes, seed: int) -> int:
    """MurmurHash3 with 32 bits of whole words."""
    h, low = seed, 0xFFFFFFFF
    for (k,) in struct.iter_unpack("<I", data):
        k = k * 0xCC9E2D51 & low
        k = ((k << 15) | (k >> 17)) & low
        h ^= k * 0x1B873593 & low
        h = ((h << 13) | (h >> 19)) & low
        h = (h * 5 + 0xE6546B64) & low
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & low
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & low
    return h ^ (h >> 16)


def _uniforms(seed: int) -> Iterator[float]:
    """Spark's XORShiftRandom."""
    data = struct.pack(">q", seed)
    low = _murmur(data, 0x3C074A61)
    x = (_murmur(data, low) << 32) | low
    while True:
        x ^= x << 21 & _64
        x ^= x >> 35
        x ^= x << 4 & _64
        high = x & 0x3FFFFFF
        x ^= x << 21 & _64
        x ^= x >> 35
        x ^= x << 4 & _64
        yield ((high << 27) + (x & 0x7FFFFFF)) * 2.0**-53


def sample(n: int, share: float, seed: int) -> np.ndarray:
    """Places of the documents of a partition that an update takes, with replacement.

    Spark's sampler for shares up to LARGEST_SHARE: gaps between documents, and how often each comes.
    """
    draw, log, none = _uniforms(seed).__next__, math.log, math.exp(-share)
    at, places = -1, []
    while True:
        at += 1 + int(log(max(draw(), 5e-11)) / -share)
        if at >= n:
            return np.array(places, dtype=np.int64)
        left = (none + (1.0 - none) * draw()) * draw()
        places.append(at)
        while left > none:
            places.append(at)
            left *= draw()


def gamma_start(seed: int, k: int) -> np.ndarray:
    """The weights that a document's topics start from: breeze's Gamma over a Mersenne Twister."""
    seed &= _64
    bits = np.random.RandomState(np.array([seed >> 32, seed & 0xFFFFFFFF], dtype=np.uint32))
    words, spare, out = iter(()), None, []

    def uniform() -> float:
        nonlocal words
        high = next(words, None)
        if high is None:
            words = iter(bits.randint(0, 1 << 32, size=64, dtype=np.uint32).tolist())
            high = next(words)
        return (((high >> 6) << 26) | (next(words) >> 6)) * 2.0**-52

    d = _GAMMA_SHAPE - 1 / 3
    c = 1 / math.sqrt(9 * d)
    while len(out) < k:
        v = 0.0
        while v <= 0:
            if spare is None:
                angle, far = 2 * math.pi * uniform(), math.sqrt(-2 * math.log(uniform()))
                x, spare = far * math.cos(angle), far * math.sin(angle)
            else:
                x, spare = spare, None
            v = 1 + c * x
        v, u = v * v * v, uniform()
        if u < 1 - 0.0331 * x**4 or math.log(u) < 0.5 * x * x + d * (1 - v + math.log(v)):
            out.append(d * v / _GAMMA_SHAPE)
    return np.array(out)


# -- the mathematics ----------------------------------------------------------------


def digamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: six steps up, then the asymptotic series."""
    t = x * (x + 5.0)
    below = (2.0 * x + 5.0) * ((3.0 * t + 20.0) * t + 24.0) / (t * ((t + 10.0) * t + 24.0))
    y = x + 6.0
    r = 1.0 / (y * y)
    tail = r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r * (1 / 132 - r * (691 / 32760))))))
    return np.log(y) - 0.5 / y - tail - below


def trigamma(x: np.ndarray) -> np.ndarray:
    below = sum(1.0 / (x + i) ** 2 for i in range(10))
    y = x + 10.0
    r = 1.0 / (y * y)
    return below + (1.0 + 0.5 / y + r * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))) / y


def expectation(weights: np.ndarray) -> np.ndarray:
    """Of the logarithm of a Dirichlet vector, along the last axis."""
    both = digamma(np.concatenate([weights, weights.sum(-1, keepdims=True)], -1))
    return both[..., :-1] - both[..., -1:]


def infer(
    counts: np.ndarray, words: np.ndarray, alpha: np.ndarray, gamma: np.ndarray, rest: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places that are done, weights of their topics, expected share, expected count per term) of a block of documents.

    `counts` is documents x places, `words` documents x topics x places, `gamma` documents x
    topics, which is overwritten. Every document is iterated by itself until it is done. Once no more than
    `rest` are left, they stay where they are, for the caller to go on with; a few at a time would be slow.
    """
    docs, k = len(counts), len(alpha)
    whole, at, live = gamma, np.arange(docs), np.ones(docs, dtype=bool)
    share = np.exp(expectation(gamma))
    ratio = counts / (np.matmul(share[:, None, :], words)[:, 0, :] + 1e-100)
    shares, ratios, finished = np.empty_like(share), np.empty_like(ratio), np.zeros(docs, dtype=bool)
    while True:
        new = share * np.matmul(words, ratio[:, :, None])[:, :, 0] + alpha
        share = np.exp(expectation(new))
        ratio = counts / (np.matmul(share[:, None, :], words)[:, 0, :] + 1e-100)
        ended = live & (np.abs(new - gamma).sum(1) <= _STEP * k)
        gamma = new
        if ended.any():
            places = at[ended]
            whole[places], shares[places], ratios[places], finished[places] = gamma[ended], share[ended], ratio[ended], True
            live &= ~ended
            left = np.count_nonzero(live)
            if left <= rest:
                whole[at[live]] = gamma[live]
                done = np.flatnonzero(finished)
                return done, whole[done], shares[done], ratios[done]
            if left <= 0.75 * len(live):
                at, gamma, share, ratio, counts, words = (x[live] for x in (at, gamma, share, ratio, counts, words))
                live = np.ones(left, dtype=bool)


def learned_step(alpha: np.ndarray, mean: np.ndarray, n: int, weight: float) -> np.ndarray:
    """One Newton step of the concentrations; `mean` is that of the expected logarithms of `n` documents."""
    slope = n * (mean - expectation(alpha))
    c, q = n * trigamma(alpha.sum()), -n * trigamma(alpha)
    b = (slope / q).sum() / (1 / c + (1 / q).sum())
    new = alpha - weight * (slope - b) / q
    return new if (new > 0).all() else alpha


# -- documents of a task --------------------------------------------------------------


class Documents:
    """Bags of words of the partitions that a task stands for, in files of its own temporary folder."""

    def __init__(self, batches: Iterator[pa.RecordBatch], parts: list[int]) -> None:
        lengths, of_part = [], []
        with tempfile.TemporaryFile() as terms, tempfile.TemporaryFile() as counts:
            for batch in batches:
                kept = batch.filter(batch.column("terms").is_valid())
                column, values = kept.column("terms"), kept.column("counts")
                terms.write(np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.int32))
                counts.write(np.ascontiguousarray(values.flatten().to_numpy(zero_copy_only=False), dtype=np.float64))
                lengths.append(np.diff(column.offsets.to_numpy()))
                of_part.append(kept.column("part").to_numpy())
            terms.flush(), counts.flush()
            size = os.fstat(terms.fileno()).st_size // 4
            self.terms = np.memmap(terms, np.int32, "r", shape=size) if size else np.empty(0, np.int32)
            self.counts = np.memmap(counts, np.float64, "r", shape=size) if size else np.empty(0)
        self.lengths = np.concatenate([np.empty(0, np.int64), *lengths]).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        of_part = np.concatenate([np.empty(0, np.int32), *of_part])  # sorted
        self.ranges = [(p, *np.searchsorted(of_part, (p, p + 1)).tolist()) for p in parts]
        self.firsts = np.array([first for _, first, _ in self.ranges])

    def blocks(self, chosen: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places in `chosen`, terms, counts) of documents of like length, padded with counts of 0."""
        order = np.argsort(self.lengths[chosen], kind="stable")[::-1]
        while len(order):
            longest = int(self.lengths[chosen[order[0]]])
            most = max(1, _BLOCK // (longest * k))
            here, order = order[:most], order[most:]
            block, place = chosen[here], np.arange(longest)
            inside = place < self.lengths[block][:, None]
            at = np.where(inside, self.starts[block][:, None] + place, self.starts[block][:, None])
            yield here, self.terms[at], np.where(inside, self.counts[at], 0.0)


# -- the stage --------------------------------------------------------------------------


def _exchange(store: fs.FileSystem, folder: str, me: int, tasks: int) -> Callable[[int, bytes], list[bytes]]:
    """A function that gives every task the message of each task, in their order.

    Once a task has all messages of an update, every task has read those of the one before.
    """

    def name(number: int, task: int) -> str:
        return f"{folder}/{number}-{task}"

    def all_of(number: int, message: bytes) -> list[bytes]:
        if tasks == 1:
            return [message]
        with store.open_output_stream(f"{name(number, me)}.part") as out:
            out.write(message)
        store.move(f"{name(number, me)}.part", name(number, me))
        missing, pause = set(range(tasks)) - {me}, 2e-4
        while True:
            infos = store.get_file_info([name(number, t) for t in missing])
            missing -= {int(x.path.rpartition("-")[2]) for x in infos if x.type == fs.FileType.File}
            if not missing:
                break
            time.sleep(pause)
            pause = min(pause * 1.2, 0.02)
        found = []
        for t in range(tasks):
            if t == me:
                found.append(message)
            else:
                with store.open_input_stream(name(number, t)) as read:
                    found.append(read.read())
        if number:
            store.delete_file(name(number - 1, me))
        return found

    return all_of


def run(
    batches: Iterator[pa.RecordBatch], me: int, tasks: int, exchange: Callable[[int, bytes], list[bytes]],
    parts: int, topics: np.ndarray, alpha: np.ndarray, eta: float, learned: bool,
    n_docs: int, share: float, updates: int, offset: float, decay: float, seed: int,
) -> tuple[np.ndarray, np.ndarray]:
    """All updates, as one of `tasks` tasks; returns topics (terms x topics) and concentrations."""
    mine = [p for p in range(parts) if p % tasks == me]
    docs = Documents(batches, mine)
    topics, alpha = topics.copy(), alpha.copy()
    size, k = topics.shape
    head = struct.Struct("<qqq")  # documents, those with terms, terms
    scale = n_docs / math.ceil(share * n_docs)  # by the documents that an update is meant to have
    draws, done = JavaRandom(seed), 0
    draws.next_long()  # the start of the topics
    place = np.zeros(size, dtype=np.int64)
    for number in range(updates):
        of_partition = JavaRandom(draws.next_long())
        seeds = [of_partition.next_long() for _ in range(parts)]
        state, inner = draws.state, draws.next_long()
        total = digamma(topics.sum(0))
        taken, chosen, starts = 0, [np.empty(0, np.int64)], np.empty((len(docs.ranges), k))
        for i, (p, first, last) in enumerate(docs.ranges):
            starts[i] = gamma_start(inner + p, k)
            places = first + sample(last - first, share, seeds[p])
            taken += len(places)
            chosen.append(places[docs.lengths[places] > 0])
        chosen = np.concatenate(chosen)
        seen = np.zeros(size, dtype=bool)
        for _, terms, _ in docs.blocks(chosen, k):
            seen[terms] = True
        ids = np.flatnonzero(seen)
        place[ids] = np.arange(len(ids))
        beta = np.exp(digamma(topics[ids]) - total).T.copy()
        sums, logs = np.zeros((k, len(ids))), np.zeros(k)
        nonempty, gammas = len(chosen), starts[np.searchsorted(docs.firsts, chosen, "right") - 1]
        while len(chosen):
            open_ = np.ones(len(chosen), dtype=bool)
            for block, terms, counts in docs.blocks(chosen, k):
                local = place[terms]
                words = np.empty((len(block), k, terms.shape[1]))
                for t in range(k):
                    words[:, t] = beta[t][local]
                gamma = gammas[block]
                ended, of, shares, ratio = infer(counts, words, alpha, gamma, 0 if len(block) == len(chosen) else len(block) // 4)
                gammas[block], open_[block[ended]] = gamma, False
                flat = local[ended].ravel()
                for t in range(k):
                    sums[t] += np.bincount(flat, (ratio * shares[:, t, None]).ravel(), len(ids))
                if learned:
                    logs += expectation(of).sum(0)
            chosen, gammas = chosen[open_], gammas[open_]
        sums = (sums * beta).T
        message = b"".join((head.pack(taken, nonempty, len(ids)), logs.tobytes(), ids.astype(np.int32).tobytes(), sums.tobytes()))
        messages = exchange(number, message)
        if not sum(head.unpack_from(m)[0] for m in messages):
            draws.state = state  # an update without documents is left out, and draws no second seed
            continue
        done += 1
        n = sum(head.unpack_from(m)[1] for m in messages)
        if not n:
            continue
        weight = (offset + done) ** -decay
        topics *= 1 - weight
        topics += weight * eta
        logs = np.zeros(k)
        for m in messages:
            many = head.unpack_from(m)[2]
            logs += np.frombuffer(m, np.float64, k, head.size)
            ids = np.frombuffer(m, np.int32, many, head.size + 8 * k)
            topics[ids] += weight * scale * np.frombuffer(m, np.float64, many * k, head.size + 8 * k + 4 * many).reshape(many, k)
        if learned:
            alpha = learned_step(alpha, logs / n, n, weight)
    return topics, alpha


def _shared_folder(spark: SparkSession) -> str | None:
    """URI of a new folder that Arrow can open; None where it does not know the file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "lda"))
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
    try:
        store, folder = fs.FileSystem.from_uri(uri)
        store.create_dir(folder, recursive=True)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    return uri


def fit(lda: LDA, bow: DataFrame, n_docs: int, parts: int, n_terms: int) -> LDAModel:
    """What `lda.fit(bow)` gives, where `bow` (doc_id, features) is dealt out to `parts` partitions by
    doc_id and sorted by it.

    As many tasks as partitions run at once, or as many as the cluster has room for; the
    documents of an update do not depend on it. Spark ML fits where an update takes more than LARGEST_SHARE of
    the documents, where Python cannot open the shared folder, and where the number of executors may
    change, which barrier stages do not allow.
    """
    spark = bow.sparkSession
    folder = None
    if lda.getSubsamplingRate() <= LARGEST_SHARE and spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false") != "true":
        folder = _shared_folder(spark)
    if folder is None:
        return lda.fit(bow)
    context = spark.sparkContext._jsc.sc()
    room = context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())
    tasks = max(1, min(parts, room))

    empty = spark.createDataFrame([(Vectors.sparse(n_terms, {}),)], ["features"])
    first = lda.copy({lda.maxIter: 0}).fit(empty)
    start = spark.sparkContext.broadcast(first.topicsMatrix().toArray())
    alpha, eta = np.array(lda.getDocConcentration()), lda.getTopicConcentration()
    rest = (eta, lda.getOptimizeDocConcentration(), n_docs, lda.getSubsamplingRate(), lda.getMaxIter(), lda.getLearningOffset(), lda.getLearningDecay(), lda.getSeed())

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = BarrierTaskContext.get()
        store, path = fs.FileSystem.from_uri(folder)
        path = f"{path}/{task.allGather(uuid.uuid4().hex)[0]}"  # a stage that is run again has a new folder
        store.create_dir(path)
        me = task.partitionId()
        topics, alphas = run(batches, me, tasks, _exchange(store, path, me, tasks), parts, start.value, alpha, *rest)
        if me == 0:
            yield pa.RecordBatch.from_pydict({"topics": [topics.tobytes("F")], "alpha": [alphas.tobytes()]})

    vector = F.unwrap_udt("features")
    places = F.when(vector["type"] == 0, vector["indices"]).otherwise(F.sequence(F.lit(0), F.size(vector["values"]) - 1))
    part = F.pmod(F.hash("doc_id"), F.lit(parts))
    rows = bow.select(part.alias("part"), "doc_id", places.alias("terms"), vector["values"].alias("counts"))
    # one more row for each task, so that none is without rows and left out
    nothing = spark.range(tasks).select(F.col("id").cast("int").alias("part"), F.lit(None).alias("doc_id"), F.lit(None).alias("terms"), F.lit(None).alias("counts"))
    dealt = rows.union(nothing).repartitionById(tasks, F.pmod("part", F.lit(tasks))).sortWithinPartitions("part", "doc_id")
    out = dealt.select("part", "terms", "counts").mapInArrow(fitted, "topics binary, alpha binary", barrier=True).collect()[0]
    start.destroy()
    store, path = fs.FileSystem.from_uri(folder)
    store.delete_dir(path)
    old = spark._jvm.org.apache.spark.mllib.clustering.LocalLDAModel(
        _py2java(spark.sparkContext, DenseMatrix(n_terms, lda.getK(), np.frombuffer(out["topics"]))),
        _py2java(spark.sparkContext, DenseVector(np.frombuffer(out["alpha"]))), eta, _GAMMA_SHAPE,
    )
    java = spark._jvm.org.apache.spark.ml.clustering.LocalLDAModel(first.uid, n_terms, old, spark._jsparkSession)
    return lda._copyValues(LocalLDAModel(java))
