"""Benchmark decontamination by latent semantic retrieval and sequence checks.

Features are the benchmark's words (letters and digits, lower case); their document
frequencies are counted over all documents. Passages are windows of WINDOW words,
STRIDE apart, of items and of documents. A randomised SVD of the TF-IDF passages
(all windows of all items and of all documents; tasks multiply their part of the matrix)
gives RANK latent directions. Every
passage of every document where enough content words of one item stand together is
projected, and its cosine with all item windows gives candidates. For each candidate the longest
common subsequence of the item and the surrounding words decides: COPY of the item's
words in order is a copy; PARAPHRASE of them is a paraphrase if also the item's
answer, its last sentence, is there to ANSWER. An item of one sentence, or with an answer
of one word, is a paraphrase if CONTENT_ORDER of its content words are there in order too. What stands together needs less
than a paraphrase has, and an item without content words counts all its words.

Defined results: null and empty texts hold nothing, and items without words match
nothing; equal items are matched each; repeated rows are found each; with an empty
table there are no rows. The items are the query set: they are broadcast in blocks
of BLOCK items, and each block passes over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm.common import chunks, span_hashes, text_buffer, unused
from corpusmill.runtime import materialize, release, small_side

WINDOW, STRIDE = 24, 8
RANK, OVERSAMPLE, POWER = 48, 16, 2
#: Words in at most this share of the items (or two of them) are content words. A passage is projected
#: where this share of an item's content words per window, within the bounds, stand in one window's length.
CONTENT_SHARE, HIT_SHARE, LEAST_HITS, MOST_HITS = 0.02, 0.3, 2, 6
COSINE = 0.4
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8
#: An answer is a last sentence of two words or more that is at most the first share of its item. An item
#: without one is held by its content words, of which the second share must stand in their order.
ANSWER_SHARE, CONTENT_ORDER = 0.5, 0.5
BLOCK = 10_000

_SIGN = np.zeros(256, dtype=bool)
_SIGN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of lower-case texts, row after row, and the offset of each row's first word."""
    raw, offsets = text_buffer(column)
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = _SIGN[raw]
    opens, closes = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    both = inside[cut] & inside[cut + 1]
    opens[cut[both]] = closes[cut[both]] = True
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    h = span_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return h, np.searchsorted(starts, offsets)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; the rows of the table are bits of one number."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for x in b.tolist():
        match = state & at.get(x, 0)
        if match:
            state = (state + match | state - match) & full
    return len(a) - state.bit_count()


@dataclass(frozen=True)
class Queries:
    ids: np.ndarray  # item per block position
    items: tuple[np.ndarray, ...]  # word hashes of each item
    places: tuple[np.ndarray, ...]  # their numbers in `features`
    answers: tuple[np.ndarray, ...]  # of its last sentence, or its content words
    share: np.ndarray  # of the answer's words that must be there
    features: np.ndarray  # sorted word hashes
    idf: np.ndarray
    holders: tuple[np.ndarray, np.ndarray, np.ndarray]  # content words: first place and number in the list of items
    need: np.ndarray  # hits that an item needs
    basis: np.ndarray  # feature x latent direction
    owner: np.ndarray  # item of each window
    latent: np.ndarray  # unit vectors of the windows


def _lookup(features: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Number of the feature of each word, or -1."""
    if not len(features):
        return np.full(len(h), -1)
    bits = len(features).bit_length() + 3
    if len(h) < 2 << bits:
        at = np.minimum(np.searchsorted(features, h), len(features) - 1)
        return np.where(features[at] == h, at, -1)
    # many words: a table of the upper bits tells where to look, so no search is needed
    shift = np.uint64(64 - bits)
    table = np.searchsorted(features, np.arange(1 << bits, dtype=np.uint64) << shift)
    last = len(features) - 1
    at = np.minimum(table[h >> shift], last)
    out = np.full(len(h), -1)
    for _ in range(np.diff(np.append(table, len(features))).max()):
        np.copyto(out, at, where=features[at] == h)
        at = np.minimum(at + 1, last)
    return out


def _tf(feature: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of features by window: (window, feature, count)."""
    n = last - first
    window = np.repeat(np.arange(len(first)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[window]
    f = feature[at]
    known = f >= 0
    key, count = np.unique(window[known] * (1 << 32) + f[known], return_counts=True)
    return key >> 32, key & ((1 << 32) - 1), count


def _document_windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, last word) of all windows of all rows."""
    n = np.diff(offsets)
    per = np.where(n > 0, np.maximum((n - WINDOW + STRIDE + STRIDE - 1) // STRIDE, 1), 0)
    row = np.repeat(np.arange(len(n)), per)
    first = (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * STRIDE + offsets[:-1][row]
    return row, first, np.minimum(first + WINDOW, offsets[1:][row])


def _matrix(q: Queries, window: np.ndarray, feature: np.ndarray, count: np.ndarray, n: int, side: np.ndarray) -> np.ndarray:
    """Rows of (TF-IDF, each window of unit length) times `side`, which has a row per feature."""
    value = (1 + np.log(count)) * q.idf[feature]
    norm = np.sqrt(np.bincount(window, value * value, n))
    value = value / np.maximum(norm[window], 1e-12)
    out = np.zeros((n, side.shape[1]), dtype=np.float64)
    begin = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]])) if len(window) else np.zeros(0, np.int64)
    if len(begin):
        out[window[begin]] = np.add.reduceat(value[:, None] * side[feature], begin, axis=0)
    return out


def _content(items: tuple[np.ndarray, ...], features: np.ndarray) -> tuple[tuple, np.ndarray]:
    """Which items hold each content word, and how many hits each item needs."""
    own = [np.unique(_lookup(features, i)) for i in items]
    spread = np.bincount(np.concatenate([*own, np.zeros(0, np.int64)]).astype(np.int64), minlength=len(features))
    content = spread <= max(2, CONTENT_SHARE * len(items))
    pairs, need = [], np.ones(len(items), dtype=np.int64)
    for i, mine in enumerate(own):
        some = mine[content[mine]]
        some = some if len(some) >= LEAST_HITS else mine
        pairs.append(np.stack([some, np.full(len(some), i)]))
        n = np.isin(_lookup(features, items[i]), some).sum() * min(1.0, WINDOW / max(len(items[i]), 1))
        need[i] = max(min(int(np.ceil(HIT_SHARE * n)), MOST_HITS), min(LEAST_HITS, len(items[i])), 1)
    feature, item = np.concatenate([*pairs, np.zeros((2, 0), np.int64)], axis=1).astype(np.int64)
    order = np.argsort(feature, kind="stable")
    feature, item = feature[order], item[order]
    ids = np.arange(len(features))
    first = np.searchsorted(feature, ids)
    return (first, np.searchsorted(feature, ids, "right") - first, item), need


def _block(ids: list, texts: list[str]) -> Queries:
    """Item words, answers and the feature list of a block; weights come later."""
    h, offsets = words(pa.array(texts, pa.string()))
    items = tuple(h[a:b] for a, b in zip(offsets, offsets[1:]))
    last = [t.rstrip().rstrip(".!?").replace("!", ".").replace("?", ".").replace("\n", ".").rsplit(".", 1)[-1] for t in texts]
    h, offsets = words(pa.array(last, pa.string()))
    answers = [h[a:b] for a, b in zip(offsets, offsets[1:])]
    features = np.unique(np.concatenate([*items, np.zeros(0, np.uint64)]))
    none = np.zeros(0)
    places = tuple(_lookup(features, i) for i in items)
    holders, need = _content(items, features)
    number = holders[1]  # items that hold each feature as a content word
    share = np.full(len(items), ANSWER)
    for i, (words_of_item, answer) in enumerate(zip(items, answers)):
        if not 2 <= len(answer) <= ANSWER_SHARE * len(words_of_item):
            answers[i], share[i] = words_of_item[number[places[i]] > 0], CONTENT_ORDER
    return Queries(np.array(ids), items, places, tuple(answers), share, features, none, holders, need, none, none, none)


def _stored(docs: DataFrame, q: Queries) -> tuple[DataFrame, np.ndarray]:
    """One pass over all documents: their words as numbers of features, stored, and the document frequencies.

    A number is 2 or 4 bytes; the number of features stands for all other words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(q.features)
    kind = _number_type(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = shared.value
        total = np.zeros(len(features), dtype=np.int64)
        for batch in chunks(batches, "t", 2 << 20):
            h, offsets = words(batch.column("t"))
            f = _lookup(features, h)
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            pair = np.unique(row[f >= 0] * (1 << 32) + f[f >= 0])
            total += np.bincount(pair & ((1 << 32) - 1), minlength=len(features))
            numbers = np.where(f >= 0, f, len(features)).astype(kind)
            lists = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), batch.num_rows, [None, pa.py_buffer(offsets.astype(np.int64) * kind.itemsize), pa.py_buffer(numbers)]
            )
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.int64()), lists.cast(pa.binary())], names=["f", "n", "numbers"]
            )
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(total[some]), pa.nulls(len(some), pa.binary())], names=["f", "n", "numbers"]
        )

    out = materialize(docs.select("t").mapInArrow(run, "f int, n long, numbers binary"), "benchmark-passages")
    df = np.zeros(len(q.features), dtype=np.int64)
    for r in out.filter("f is not null").groupBy("f").agg(F.sum("n")).collect():  # at most one row per feature
        df[r[0]] = r[1]
    return out, df


def _number_type(q: Queries) -> np.dtype:
    return np.dtype(np.uint16 if len(q.features) < 1 << 16 else np.int32)


def _twice(idf: np.ndarray, f: np.ndarray, offsets: np.ndarray, side: np.ndarray, out: np.ndarray) -> None:
    """Adds the transposed matrix times the matrix times `side` to `out`, for all windows of the rows with features `f`.

    `side` has a row per feature and one of zeros for other words. The matrix holds TF-IDF, each window
    of unit length; windows share blocks of STRIDE words, so sums are taken by block, and words that a window has
    more than once are set right after.
    """
    row, first, last = _document_windows(offsets)
    most = len(idf)
    weight = np.append(idf, 0.0)
    scaled = (weight[:, None] * side).astype(np.float32)
    for at in range(0, len(row), 8192):
        own = row[at : at + 8192]
        begin, end = first[at : at + 8192], last[at : at + 8192]
        # the blocks of the slice: up to three of a window, which the next window of the row shares
        n = -(-(end - begin) // STRIDE)
        fresh = np.append(True, own[1:] != own[:-1])
        count = np.where(np.append(fresh[1:], True), n, 1)  # the last window of a row brings all of its blocks
        block = np.cumsum(count) - count
        blocks = int(count.sum())
        start = np.repeat(begin - block * STRIDE, count) + np.arange(blocks) * STRIDE
        place = start[:, None] + np.arange(STRIDE)
        stop = np.repeat(end, count)[:, None]
        p = np.full((blocks + 2, STRIDE), most)
        p[:blocks] = np.where(place < stop, f[np.minimum(place, len(f) - 1)], most)
        none = blocks + 1
        at_block = [block, np.where(n > 1, block + 1, none), np.where(n > 2, block + 2, none)]

        w = np.sort(np.concatenate([p[b] for b in at_block], axis=1), axis=1)
        same = np.flatnonzero((w[:, 1:] == w[:, :-1]) & (w[:, 1:] < most))
        width = w.shape[1] - 1
        opens = np.flatnonzero(np.append(True, (np.diff(same) != 1) | (same[1:] % width == 0))) if len(same) else same
        window, feature = same[opens] // width, w[same[opens] // width, same[opens] % width]
        times = np.diff(np.append(opens, len(same))) + 1
        more = 1 + np.log(times) - times

        square = (weight * weight)[p].sum(axis=1)
        norm = sum(square[b] for b in at_block)
        norm += np.bincount(window, ((1 + np.log(times)) ** 2 - times) * idf[feature] ** 2, len(own))
        sums = np.zeros((blocks + 2, side.shape[1]), dtype=np.float32)
        rows = np.empty_like(sums)
        for j in range(STRIDE):
            sums += np.take(scaled, p[:, j], axis=0, out=rows, mode="clip")
        y = sums[at_block[0]] + sums[at_block[1]] + sums[at_block[2]]
        if len(window):
            fresh = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
            y[window[fresh]] += np.add.reduceat(more[:, None].astype(np.float32) * scaled[feature], fresh, axis=0)
        y /= np.maximum(norm, 1e-24)[:, None].astype(np.float32)

        back = np.zeros((blocks + 2, side.shape[1]), dtype=np.float32)
        for b, used in zip(at_block, (n > 0, n > 1, n > 2)):
            back[b[used]] += y[used]
        # one sum by feature, of the rows of its blocks and of what repeats in a window adds
        rows = np.concatenate([back[:blocks], y[window] * more[:, None].astype(np.float32)])
        number = np.concatenate([p[:blocks].ravel(), feature]).astype(f.dtype)  # short numbers are sorted by their digits
        source = np.concatenate([np.repeat(np.arange(blocks), STRIDE), blocks + np.arange(len(feature))])
        order = np.argsort(number, kind="stable")
        order = order[: np.searchsorted(number[order], most)]
        if len(order):
            number, source = number[order], source[order]
            fresh = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
            total = np.empty((side.shape[1], len(fresh)))
            for j, column in enumerate(np.ascontiguousarray(rows.T)):  # sums along a short column, not across wide rows
                total[j] = np.add.reduceat(column.take(source, mode="clip"), fresh)
            out[number[fresh]] += total.T


#: Features whose rows of a product travel together.
FEATURE_ROWS = 1024


def _basis(stored: DataFrame, q: Queries) -> np.ndarray:
    """Latent directions by a randomised range finder with power steps; each step is one product over all passages."""
    wide = min(RANK + OVERSAMPLE, len(q.features))
    spark = stored.sparkSession
    kind = _number_type(q)
    idf = q.idf
    n = np.array([len(i) for i in q.items])
    flat = _lookup(q.features, np.concatenate([*q.items, np.zeros(0, np.uint64)]))
    rows = stored.filter("numbers is not null").select("numbers")

    def product(side: np.ndarray) -> np.ndarray:
        """Transposed matrix times matrix times `side`, summed over the tasks' parts and the item windows."""
        padded = np.concatenate([side, np.zeros((1, side.shape[1]))])
        shared = spark.sparkContext.broadcast((idf, padded))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, s = shared.value
            out = np.zeros((len(own), s.shape[1]))
            for b in batches:
                raw, offsets = text_buffer(b.column("numbers"))
                _twice(own, raw.view(kind), offsets // kind.itemsize, s, out)
            for g in range(0, len(out), FEATURE_ROWS):
                yield pa.RecordBatch.from_pydict(
                    {"g": pa.array([g], pa.int32()), "part": pa.array([out[g : g + FEATURE_ROWS].tobytes()], pa.binary())}
                )

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for g, part in zip(b.column("g").to_pylist(), b.column("part")):
                    values = np.frombuffer(part.as_buffer())
                    sums[g] = sums[g] + values if g in sums else values
            yield pa.RecordBatch.from_pydict(
                {"g": pa.array(list(sums), pa.int32()), "part": pa.array([v.tobytes() for v in sums.values()], pa.binary())}
            )

        # a task returns a matrix of bounded size, and there are as many as cores can work at
        parts = rows.coalesce(2 * spark.sparkContext.defaultParallelism).mapInArrow(run, "g int, part binary")
        total = np.zeros(side.shape)
        _twice(idf, np.where(flat >= 0, flat, len(idf)), np.concatenate([[0], np.cumsum(n)]), padded, total)
        for g, part in parts.repartition("g").mapInArrow(add, "g int, part binary").collect():  # one matrix
            total[g : g + FEATURE_ROWS] += np.frombuffer(part).reshape(-1, side.shape[1])
        shared.destroy()
        return total * idf[:, None]

    side = np.random.default_rng(5).standard_normal((len(q.features), wide))
    for _ in range(POWER):
        side, _ = np.linalg.qr(side)
        start, side = side, product(side)
    # the product of the last step serves twice: its range holds the directions, and with its start it gives their order
    small = start.T @ side
    value, vector = np.linalg.eigh((small + small.T) / 2)
    kept = value > 1e-9 * max(value[-1], 1e-300)
    left, _, _ = np.linalg.svd(side @ (vector[:, kept] / np.sqrt(value[kept])), full_matrices=False)
    return left[:, :RANK]


def _item_tf(q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(i) for i in q.items])
    first = np.concatenate([[0], np.cumsum(n)])
    flat = _lookup(q.features, np.concatenate([*q.items, np.zeros(0, np.uint64)]))
    _, a, b = _document_windows(first)
    return _tf(flat, a, b)


def fit(docs: DataFrame, ids: list, texts: list[str]) -> Queries | None:
    """The block's features, weights, latent directions and item windows; None when no item has a word."""
    q = _block(ids, texts)
    if not len(q.features):
        return None
    n = docs.count()
    stored, df = _stored(docs, q)
    idf = np.log((1 + n) / (1 + df)) + 1
    lengths = np.array([len(i) for i in q.items])
    owner, _, _ = _document_windows(np.concatenate([[0], np.cumsum(lengths)]))
    q = replace(q, idf=idf, owner=owner)
    basis = _basis(stored, q)
    release(stored)
    q = replace(q, basis=basis)
    latent = _matrix(q, *_item_tf(q), len(owner), basis)
    return replace(q, latent=latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12))


def _dense(q: Queries, f: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks the words where as many content words of one item as it needs begin to stand within WINDOW words."""
    out = np.zeros(len(f), dtype=np.int64)
    start, number, item = q.holders
    place = np.flatnonzero(f >= 0)
    n = number[f[place]]
    owner = item[np.arange(n.sum()) + np.repeat(start[f[place]] - (np.cumsum(n) - n), n)]
    place = np.repeat(place, n)
    order = np.argsort(owner, kind="stable")
    owner, place = owner[order], place[order]
    row = np.searchsorted(offsets, place, "right")
    for need in np.unique(q.need):
        last = np.arange(len(place)) + need - 1
        fits = np.flatnonzero((q.need[owner] == need) & (last < len(place)))
        end = last[fits]
        good = (owner[end] == owner[fits]) & (row[end] == row[fits]) & (place[end] - place[fits] < WINDOW)
        out[place[fits[good]]] = out[place[end[good]]] = 1
    return out


def candidates(q: Queries, f: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word of the passage, item) of passages whose cosine with an item window is at least COSINE."""
    row, first, last = _document_windows(offsets)
    marks = np.concatenate([[0], np.cumsum(_dense(q, f, offsets))])
    some = np.flatnonzero(marks[last] > marks[first])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for block in range(0, len(some), 4096):
        own = some[block : block + 4096]
        latent = _matrix(q, *_tf(f, first[own], last[own]), len(own), q.basis)
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        a, w = np.nonzero(latent.astype(np.float32) @ q.latent.T.astype(np.float32) >= COSINE)
        out.append((row[own[a]], first[own[a]], q.owner[w]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def checked(q: Queries, h: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], tuple[int, str]]:
    """(row, item) -> common words and kind, for candidates that the sequence checks confirm."""
    found: dict[tuple[int, int], tuple[int, str]] = {}
    f = _lookup(q.features, h)
    row, first, item = candidates(q, f, offsets)
    if not len(row):
        return found
    mark = np.zeros(len(q.features) + 1, dtype=bool)  # the last place is for words without a feature

    def marked(by: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Which of `of` are among `by`."""
        mark[by] = True
        out = mark[of]
        mark[by] = False
        return out

    order = np.lexsort((first, item, row))
    row, first, item = row[order], first[order], item[order]
    begin = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (first[1:] - first[:-1] > WINDOW)]))
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(row)]):
        r, i = int(row[a]), int(item[a])
        words_of_item, places = q.items[i], q.places[i]
        n = len(words_of_item)
        lo, hi = max(int(first[a]) - n, int(offsets[r])), min(int(first[b - 1]) + WINDOW + n, int(offsets[r + 1]))
        # a common subsequence is not longer than the item's words that stand in the region, in any order
        if np.count_nonzero(marked(f[lo:hi], places)) < PARAPHRASE * n:
            continue
        for at in range(lo, max(hi - n, lo) + 1, max(n // 2, 1)):  # regions of twice the item's length
            end = min(at + 2 * n, hi)
            if np.count_nonzero(marked(f[at:end], places)) < PARAPHRASE * n:
                continue
            region = h[at:end]
            common = lcs(words_of_item, region[marked(places, f[at:end])])  # other words are in no common subsequence
            kind = None
            if common >= COPY * n:
                kind = "copy"
            elif common >= PARAPHRASE * n and len(q.answers[i]) and lcs(q.answers[i], region) >= q.share[i] * len(q.answers[i]):
                kind = "paraphrase"
            if kind and common > found.get((r, i), (0, ""))[0]:
                found[r, i] = (common, kind)
    return found


def search(
    documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document and item that it holds: both keys, `n_item_words`, `n_common` and `kind`."""
    docs = documents.select(F.col(key).alias("d"), F.lower(text).alias("t"))
    key_type, item_type = documents.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"`{key}` {key_type}, `{item}` {item_type}, n_item_words long, n_common long, kind string"
    spark = documents.sparkSession
    out = spark.createDataFrame([], schema)
    rows = benchmark.select(item, F.lower(F.coalesce(F.col(item_text), F.lit(""))).alias("item_text")).orderBy(item, "item_text").toLocalIterator()
    block: list[tuple] = []

    def searched(q: Queries) -> DataFrame:
        shared = spark.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in chunks(batches, "t", 2 << 20):
                h, offsets = words(batch.column("t"))
                hits = checked(own, h, offsets)
                if not hits:
                    continue
                pairs = sorted(hits)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("d").take(pa.array([r for r, _ in pairs])),
                        pa.array([own.ids[i] for _, i in pairs]),
                        pa.array([len(own.items[i]) for _, i in pairs], pa.int64()),
                        pa.array([hits[p][0] for p in pairs], pa.int64()),
                        pa.array([hits[p][1] for p in pairs]),
                    ],
                    names=[key, item, "n_item_words", "n_common", "kind"],
                )

        return docs.mapInArrow(run, schema)

    def add(result: DataFrame) -> DataFrame:
        q = fit(docs, [r[0] for r in block], [r[1] for r in block])
        return result if q is None else result.union(searched(q))

    for r in rows:  # the query set arrives block by block
        block.append(tuple(r))
        if len(block) == BLOCK:
            out = add(out)
            block = []
    return add(out) if block else out


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`documents` without those that hold a benchmark item."""
    (name,) = unused(documents, "held")
    held = materialize(search(documents, benchmark, key, text).select(F.col(key).alias(name)).distinct(), "benchmark-held")
    return documents.join(small_side(held), F.col(key) == F.col(name), "left_anti")
