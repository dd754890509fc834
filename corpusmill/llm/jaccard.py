"""Near-duplicate join on word shingles with PartEnum signatures.

Two sets link when their Jaccard similarity is at least 75 %, that is when their
Hamming distance is at most a seventh of their sizes' sum. Sizes fall into bands; each
band has a scheme that partitions the feature domain into cells. A set signs its
band's scheme, and the next one too if a partner may fall there. With more cells
than the largest distance, two linked sets agree on whole cells, so they share a
signature (the subsets that are enumerated are the single cells). No link is lost:

- a set with more non-empty cells than its distance bound agrees with a partner on a
  non-empty one, so it signs those only; the few others sign their empty cells too;
- a signature that more than HOT sets carry (a passage that many share, say) is left
  out by a set that keeps more signatures than its bound without its hot ones, since
  one of the kept ones must agree; other sets keep their hot signatures;
- two linked sets even agree on as many signatures as either has above its bound, so
  sets and pairs that share fewer are no candidates.

Exact copies of a set count once. In the first round each set is compared with one other: of the
sets that share one of its SKETCH smallest signatures, the most connected one. That joins most near
copies, with one comparison per member. In the second round all signatures go to buckets, with the
set and its component so far, and only those that sets of several components carry are looked at
further. Pairs are counted by the signatures that at most HOT sets carry. Sets that may share hot ones
alone are compared in blocks, named by their rarest hot signatures: where a partner must share t
of n, by n - t + 1 of them, since any t of them include one of those. Both kinds of pairs are
tested by the parities of their shingles in some hundred bits, which differ in no more
places than the sets do. Of the blocks' pairs those that would join all components, closest first, are compared
before all that are still apart; so no group emits all its pairs, and the near misses of
a large group are not compared shingle by shingle. Final comparisons are exact on the shingles' 64-bit hashes.

Defined results: a text without words has no shingles, links with nothing and is its
own component; so is a null text. Fewer than five words are one shingle. Rows that
repeat a key and its text get the same row each. A null key gets the component of its
copies, or null. Long texts are read whole. Only the key and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.llm.common import chunks, mix, span_hashes, text_buffer, unused, word_spans
from corpusmill.runtime import materialize, release, small_side

WORDS = 5
HOT = 48
#: Signatures of a set that name its candidates in the first round.
SKETCH = 16
#: Bytes of text that are hashed at a time; the working arrays take about 40 bytes for each.
CHUNK = 1 << 20
#: Bytes of a signature that are shuffled; its bucket, whose number grows with the input, tells its upper bits.
SIGN_BYTES = 6
PAIRS_PER_FLUSH = 1_000_000
PAIRS_PER_PARTITION = 2_000_000
#: 64-bit words of parities: one per so many shingles (four bits for each), but at most PARITY_WORDS.
PARITY_SHARE, PARITY_WORDS = 16, 1 << 14
#: Words, and sets, of a block that is compared with another one in a task.
PARITY_BLOCK, PARITY_ROWS = 1 << 20, 2048

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _bands() -> np.ndarray:
    """Largest size of each band; a band is wide enough for partners to be in it or the next."""
    out = [4]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 16 // 9)
    return np.array(out, dtype=np.int64)


BANDS = _bands()


def cells_of(band: np.ndarray) -> np.ndarray:
    """Number of cells of a scheme: above its largest distance, with room for empty and hot cells."""
    return (2 * BANDS[band] // 7 + 1) * 26 // 20 + 2


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, row after row, and the number of each row."""
    raw, offsets = text_buffer(column)
    starts, ends, row = word_spans(raw, offsets)
    n_rows = len(column)
    words = np.bincount(row, minlength=n_rows)
    if not len(starts):
        return np.zeros(0, np.uint64), words.astype(np.int64)
    h = span_hashes(_LOWER[raw], starts, ends)
    first = np.cumsum(words) - words
    length = np.where(words >= WORDS, words - WORDS + 1, np.minimum(words, 1))
    owner = np.repeat(np.arange(n_rows), length)
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + first[owner]
    size = np.minimum(words, WORDS)[owner]
    out = size.astype(np.uint64)
    for j in range(WORDS):
        inside = j < size
        out[inside] = mix(out[inside] * np.uint64(0x9E3779B97F4A7C15) + h[at[inside] + j])
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], np.bincount(owner[new], minlength=n_rows).astype(np.int64)


def set_digests(shingles: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    some = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[some]
    out = []
    for salt in (0x1234567, 0x89ABCDE):
        h = np.zeros(len(sizes), dtype=np.uint64)
        if some.any():
            h[some] = mix(np.add.reduceat(mix(shingles + np.uint64(salt)), starts))
        out.append(h)
    return out[0], out[1]


def signatures(shingles: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of all sets: their hash (lowest bit: parity of the scheme), the set's row, and per row and parity the spare.

    The spare is the number of signatures that a set may do without, or -1.
    """
    starts = np.cumsum(sizes) - sizes
    own = np.searchsorted(BANDS, np.maximum(sizes, 1))
    largest = sizes * 4 // 3  # no partner is larger
    spare = np.full((len(sizes), 2), -1, dtype=np.int64)
    hashes, rows = [], []
    for step in (0, 1):
        band = own + step
        bound = (sizes + np.minimum(largest, BANDS[band])) // 7
        use = np.flatnonzero((sizes > 0) & (bound > 0) & ((largest > BANDS[own]) if step else True))
        if not len(use):
            continue
        n_cells, band = cells_of(band[use]), band[use]
        k = sizes[use]
        owner = np.repeat(np.arange(len(use)), k)
        place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + starts[use][owner]
        value = mix(shingles[place] ^ mix(band.astype(np.uint64) + np.uint64(77))[owner])
        cell = ((value >> np.uint64(32)) * n_cells[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        base = np.cumsum(n_cells) - n_cells
        key = base[owner] + cell  # one number per set and cell
        order = np.argsort(key, kind="stable")
        key, value = key[order], mix(value[order])
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.add.reduceat(value, new)
        key = key[new]
        owner = np.searchsorted(base, key, "right") - 1
        filled = np.bincount(owner, minlength=len(use))
        left = filled - bound[use]
        few = np.flatnonzero(left <= 0)
        if len(few):  # these sign their empty cells too
            empty = np.ones(n_cells.sum(), dtype=bool)
            empty[key] = False
            short = np.zeros(len(use), dtype=bool)
            short[few] = True
            extra = np.flatnonzero(empty)
            extra = extra[short[np.searchsorted(base, extra, "right") - 1]]
            key, total = np.concatenate([key, extra]), np.concatenate([total, np.zeros(len(extra), np.uint64)])
            owner = np.searchsorted(base, key, "right") - 1
        salt = mix(((key - base[owner]) * 64 + band[owner]).astype(np.uint64))
        parity = (band[owner] & 1).astype(np.uint64)
        hashes.append(mix(total ^ salt) & ~np.uint64(1) | parity)
        rows.append(use[owner])
        spare[use, band & 1] = left
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), spare
    return np.concatenate(hashes), np.concatenate(rows), spare


# -- the join -----------------------------------------------------------------


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "t", CHUNK):
        shingles, sizes = shingle_sets(batch.column("t"))
        h1, h2 = set_digests(shingles, sizes)
        sign, row, spare = signatures(shingles, sizes)
        columns = [batch.column("d"), *(pa.array(x) for x in (sizes, h1.view(np.int64), h2.view(np.int64), spare[:, 0], spare[:, 1]))]
        yield pa.RecordBatch.from_arrays([*columns, _sketches(sign, row, len(sizes))], names=["d", "n", "h1", "h2", "spare0", "spare1", "sketch"])


def _sketches(sign: np.ndarray, row: np.ndarray, n_rows: int) -> pa.Array:
    """The SKETCH smallest signatures of each row, smallest by a hash of them."""
    order = np.lexsort((mix(sign ^ np.uint64(0x5EED)), row))
    sign, row = sign[order], row[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < SKETCH
    sign, row = sign[kept], row[kept]
    offsets = np.searchsorted(row, np.arange(n_rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(sign.view(np.int64)))


def _bytes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _numbers(data: bytes, width: int) -> np.ndarray:
    short = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    wide = np.zeros((len(short), 8), dtype=np.uint8)
    wide[:, :width] = short
    return wide.view("<u8")[:, 0].astype(np.uint64)


def _packed(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Signatures with their sets and components (k), in one binary row per bucket and flush.

    A component is the smallest key of its members, so it is written as the distance from the set's own.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        sign, doc, back = (np.concatenate(x) for x in zip(*held))
        bucket = ((sign >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sign, doc, back, bucket = sign[order], doc[order], back[order], bucket[order]
        begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        end = np.append(begin[1:], len(bucket))
        low = int(doc.min())
        width = max(1, (int(doc.max()) - low).bit_length() + 7 >> 3)  # bytes per set, from the smallest one
        far = max(1, int(back.max()).bit_length() + 7 >> 3)
        return pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array(bucket[begin].astype(np.int32)),
                "low": pa.array(np.full(len(begin), low)),
                "width": pa.array(np.full(len(begin), width, np.int32)),
                "far": pa.array(np.full(len(begin), far, np.int32)),
                "sign": pa.array([_bytes(sign[a:b], SIGN_BYTES) for a, b in zip(begin, end)], pa.binary()),
                "doc": pa.array([_bytes(doc[a:b] - low, width) for a, b in zip(begin, end)], pa.binary()),
                "back": pa.array([_bytes(back[a:b], far) for a, b in zip(begin, end)], pa.binary()),
            }
        )

    for batch in chunks(batches, "t", CHUNK):
        shingles, sizes = shingle_sets(batch.column("t"))
        sign, row, _ = signatures(shingles, sizes)
        own, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "k"))
        if len(sign):
            held.append((sign, own[row], (own - k)[row]))
        if sum(len(x[0]) for x in held) >= PAIRS_PER_FLUSH:
            yield flush()
            held = []
    if held:
        yield flush()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(signature, set, component, number of sets) of every signature that sets of two components or more carry."""
    signs, docs, backs = [], [], []
    for batch in batches:
        for bucket, low, width, far, sign, doc, back in zip(*(batch.column(c).to_pylist() for c in ("bucket", "low", "width", "far", "sign", "doc", "back"))):
            signs.append(_numbers(sign, SIGN_BYTES) ^ mix(np.array([bucket + 1])) & ~np.uint64(1))
            docs.append(_numbers(doc, width).astype(np.int64) + low)
            backs.append(_numbers(back, far).astype(np.int64))
    if not signs:
        return
    sign, doc, back = np.concatenate(signs), np.concatenate(docs), np.concatenate(backs)
    del signs, docs, backs
    order = np.argsort(sign, kind="stable")
    sign, doc, back = sign[order], doc[order], back[order]
    first = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1]]))
    k = doc - back
    several = np.minimum.reduceat(k, first) < np.maximum.reduceat(k, first)
    number = np.diff(np.append(first, len(sign)))
    kept = np.repeat(several, number)
    number = np.repeat(number, number)[kept]
    sign, doc, k = sign[kept], doc[kept], k[kept]
    for a in range(0, len(sign), 1 << 18):
        part = slice(a, a + (1 << 18))
        yield pa.RecordBatch.from_arrays(
            [pa.array(sign[part].view(np.int64)), pa.array(doc[part]), pa.array(k[part]), pa.array(number[part])], names=["g", "c", "k", "m"]
        )


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "t", CHUNK):
        shingles, sizes = shingle_sets(batch.column("t"))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(shingles.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), lists], names=["a", "b", "s"])


def linked(pairs: DataFrame, texts: DataFrame, label: str) -> DataFrame:
    """Those of stored `pairs` (a, b) whose sets are similar enough; `texts` has one row per key.

    The texts of both ends are found by the pairs, and their sets are shuffled once,
    to the first end. Many pairs of one first end are a skewed part of that join, which is split at run time.
    """
    ends = small_side(pairs.select("a", F.col("b").alias("d")))
    firsts = small_side(materialize(pairs.select(F.col("a").alias("d")).distinct(), f"{label}-firsts"))
    second = texts.join(ends, "d").select("a", F.col("d").alias("b"), "t").mapInArrow(_shingled, "a long, b long, s array<long>")
    first = texts.join(firsts, "d", "left_semi").select(F.col("d").alias("a"), F.col("d").alias("b"), "t")
    first = first.mapInArrow(_shingled, "a long, b long, s array<long>").select("a", F.col("s").alias("sa"))
    shared = F.size(F.array_intersect("sa", "s"))
    return materialize(
        second.join(first.hint("merge"), "a").filter(100 * shared >= 75 * (F.size("sa") + F.size("s") - shared)).select("a", "b"), label
    )


def components(edges: DataFrame, label: str) -> DataFrame:
    """(c, component) of every end of `edges` (a, b): the smallest end that it can reach.

    Each round every end takes the smallest label around it and then that label's own
    label, so the rounds grow with the logarithm of the longest path.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), f"{label}-edges")
    labels = materialize(both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")).select("c", F.least("c", "m").alias("l")), f"{label}-0")
    last, turn = labels, 0
    while True:
        turn += 1
        around = both.join(labels.toDF("b", "lb"), "b").groupBy(F.col("a").alias("c")).agg(F.min("lb").alias("m"))
        lower = labels.join(around, "c").select("c", F.least("l", "m").alias("l"), F.col("l").alias("was"))
        jumped = lower.alias("x").join(
            labels.toDF("k", "kl"), F.col("x.l") == F.col("k"), "left"
        ).select("x.c", F.least("x.l", F.coalesce("kl", "x.l")).alias("l"), "was")
        stepped = materialize(jumped, f"{label}-{turn}")
        release(last)
        last, labels = stepped, stepped.select("c", "l")
        if stepped.filter("l <> was").isEmpty():
            release(both)
            return labels.withColumnRenamed("l", "component")


def _supported(members: DataFrame) -> DataFrame:
    """Without the sets that share fewer signatures than any partner would share with them."""
    n = F.count("*").over(Window.partitionBy("c", "odd"))
    return members.withColumn("have", n).filter("have >= need").drop("have")


def _open(members: DataFrame) -> DataFrame:
    """Without the signatures that one component alone carries by now."""
    several = members.groupBy("g").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).filter("lo < hi").select("g")
    return members.join(several, "g", "left_semi")


def _near(x: Column, y: Column) -> Column:
    return 4 * F.least(x, y) >= 3 * F.greatest(x, y)


def _first_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): each set b with the most connected of those that share most of its sketch."""
    rows = materialize(sets.select("c", "n", F.explode("sketch").alias("g")), "jaccard-sketches")
    counts = rows.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1")
    several = rows.join(counts, "g")
    central = several.groupBy("c").agg(F.sum("m").alias("w"))
    ranked = materialize(several.drop("m").join(central, "c"), "jaccard-ranked")
    stars = ranked.groupBy("g").agg(F.max(F.struct("w", "c", "n")).alias("top"))
    first = materialize(
        ranked.join(stars, "g")
        .filter((F.col("c") != F.col("top.c")) & _near(F.col("n"), F.col("top.n")))
        .groupBy(F.col("c").alias("b"), F.col("top.c").alias("a"))
        .agg(F.count("*").alias("have"), F.max("top.w").alias("w"))
        .groupBy("b")
        .agg(F.max(F.struct("have", "w", "a")).alias("best"))
        .select(F.col("best.a").alias("a"), "b"),
        "jaccard-first",
    )
    release(rows, ranked)
    return first


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per set and parity of a scheme: its size, and its shingles hashed to bits, of which each holds the parity of their number.

    A shingle that one of two sets has alone turns one bit, so bits that differ are at most the distance of the sets.
    """
    for batch in chunks(batches, "t", CHUNK):
        shingles, sizes = shingle_sets(batch.column("t"))
        own = np.searchsorted(BANDS, np.maximum(sizes, 1))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        spot = mix(shingles ^ np.uint64(0xB175)) >> np.uint64(32)
        for step in (0, 1):
            words = np.clip(BANDS[own + step] // PARITY_SHARE, 8, PARITY_WORDS)
            begin = np.concatenate([[0], np.cumsum(words)])
            at = np.sort(begin[owner] * 64 + (spot * (words[owner] * 64).astype(np.uint64) >> np.uint64(32)).astype(np.int64))
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
            bits = np.zeros(begin[-1] * 64, dtype=bool)
            bits[at[first][np.diff(np.append(first, len(at))) & 1 == 1]] = True
            lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(np.packbits(bits).view(np.int64)))
            odd = (own + step & 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(odd), pa.array(sizes), lists], names=["c", "odd", "n", "bits"])


def _close(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of one cell, of sets of two blocks or of one, whose bits differ no more than linked sets may: sets, components, difference."""
    c, k, n, block, i, j = (cell.column(x).to_numpy() for x in ("c", "k", "n", "block", "i", "j"))
    bits = cell.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(c), -1)  # counts bits of unsigned numbers
    left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
    c2, k2, n2, bits2 = c[right], k[right], n[right], bits[right]
    empty = np.zeros(0, np.int64)
    out = [(empty,) * 5]
    for x in left:
        maybe = np.flatnonzero((k2 != k[x]) & (4 * np.minimum(n2, n[x]) >= 3 * np.maximum(n2, n[x])) & ((c2 > c[x]) | (i[0] != j[0])))
        for some in np.array_split(maybe, len(maybe) * bits.shape[1] // PARITY_BLOCK + 1):
            apart = np.bitwise_count(bits2[some] ^ bits[x]).sum(axis=1, dtype=np.int64)
            near = apart <= (n2[some] + n[x]) // 7
            some = some[near]
            if len(some):
                out.append((np.full(len(some), c[x]), c2[some], np.full(len(some), k[x]), k2[some], apart[near]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _all_close(cell: pa.Table) -> pa.Table:
    """(a, b) of all close pairs of one cell."""
    return _pairs(*_close(cell)[:2])


def _closest(cell: pa.Table) -> pa.Table:
    """(a, b) of close pairs that join the components of one cell as all of them do, the closest first: fewer than components."""
    a, b, k, l, apart = _close(cell)
    names, at = np.unique(np.concatenate([k, l]), return_inverse=True)
    k, l = at[: len(a)], at[len(a) :]
    order = np.lexsort((b, a, apart))
    a, b, k, l = a[order], b[order], k[order], l[order]
    taken = np.zeros(len(a), dtype=bool)
    open_, label = np.arange(len(a)), np.arange(len(names))
    while len(open_):
        ends = np.stack([k[open_], l[open_]], axis=1).ravel()
        found, first = np.unique(ends, return_index=True)  # the closest pair of each component
        best = open_[first // 2]
        taken[best] = True
        # each component takes its neighbour's label where that is smaller, until nothing changes
        label = np.arange(len(names))
        while True:
            low = np.minimum(label[k[best]], label[l[best]])
            after = label.copy()
            np.minimum.at(after, k[best], low)
            np.minimum.at(after, l[best], low)
            after = after[after]
            if np.array_equal(after, label):
                break
            label = after
        k, l = label[k], label[l]
        open_ = open_[k[open_] != l[open_]]
    return _pairs(a[taken], b[taken])


def _usual_pairs(unsettled: DataFrame, parities: DataFrame) -> DataFrame:
    """(a, b) that share usual signatures, as many as linked sets must beside their hot ones, and whose bits are close.

    At most HOT sets carry a usual signature, so a row meets fewer than HOT others.
    """
    sides = unsettled.filter(F.col("m") <= HOT).select("g", "odd", "c", "n", "k", "spare", "hot")
    x, y = (sides.toDF("g", "odd", e, f"n{e}", f"k{e}", f"spare{e}", f"hot{e}") for e in "ab")
    need = F.greatest(F.lit(1), F.greatest("sparea", "spareb") - F.least("hota", "hotb"))
    named = (
        x.join(y, ["g", "odd"])
        .filter((F.col("a") < F.col("b")) & (F.col("ka") != F.col("kb")) & _near(F.col("na"), F.col("nb")))
        .groupBy("a", "b", "odd")
        .agg(F.count("*").alias("have"), F.max(need).alias("need"))
        .filter("have >= need")
        .select("a", "b", "odd")
    )
    one, other = (parities.toDF(e, "odd", f"n{e}", f"bits{e}") for e in "ab")
    differ = F.aggregate(F.zip_with("bitsa", "bitsb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, p: s + p)
    return named.join(one, ["a", "odd"]).join(other, ["b", "odd"]).filter(differ <= F.floor((F.col("na") + F.col("nb")) / 7)).select("a", "b")


def _hot_rows(unsettled: DataFrame, parities: DataFrame) -> DataFrame:
    """Sets that may be linked to one with which they share hot signatures alone, with their bits, by signature.

    Such sets share as many hot ones as either needs, so one of each set's rarest, as far as
    these can be missing from the rest.
    """
    own = Window.partitionBy("c", "odd")
    least = F.greatest(F.lit(1), F.col("spare"))
    rare = (
        unsettled.filter(F.col("m") > HOT)
        .withColumns({"rank": F.row_number().over(own.orderBy("m", "g")), "kept": F.count("*").over(own)})
        .filter(F.col("rank") <= F.col("kept") - least + 1)
        .select("g", "odd", "c", "k")
    )
    return materialize(rare.join(parities, ["c", "odd"]).withColumn("words", F.size("bits")), "jaccard-hot")


def _in_blocks(rows: DataFrame, compare, label: str) -> DataFrame:
    """Distinct (a, b) that `compare` finds among the sets of each signature.

    They are cut into blocks, and each two blocks are compared by their bits in a task, so its memory is bounded.
    """
    total = F.greatest(F.sum("words") / PARITY_BLOCK, F.count("*") / PARITY_ROWS)
    blocks = rows.groupBy("g", "words").agg(F.ceil(total).alias("blocks"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    placed = rows.join(blocks.filter("lo < hi").drop("lo", "hi"), ["g", "words"]).withColumn("block", F.pmod(F.xxhash64("c"), "blocks"))
    cells = placed.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "g", "words", F.least("block", "y").alias("i"), F.greatest("block", "y").alias("j"), "block", "c", "k", "n", "bits"
    )
    return materialize(cells.groupBy("g", "words", "i", "j").applyInArrow(compare, "a long, b long").distinct(), label)


def join(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `df`: the key, `n_shingles`, and `component_id`."""
    texts = df.select(F.col(key).cast("long").alias("d"), F.col(text).alias("t"))
    sets = materialize(
        texts.mapInArrow(_described, "d long, n long, h1 long, h2 long, spare0 long, spare1 long, sketch array<long>"), "jaccard-sets"
    )
    # exact copies: the smallest key stands for all
    copies = sets.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min("d").alias("c"), F.count("*").alias("m")).filter("m > 1")
    classes = materialize(
        sets.join(copies.drop("m"), ["h1", "h2", "n"], "left").select(
            "d", "n", "spare0", "spare1", "sketch", F.when(F.col("n") > 0, F.coalesce("c", "d")).alias("c")
        ),
        "jaccard-classes",
    )
    release(sets)
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = int(total // PAIRS_PER_PARTITION) + 1
    own_class = classes.filter("d = c").drop("d")
    # of rows that repeat a key, one is compared
    if own_class.groupBy("c").agg(F.count("*").alias("m")).filter("m > 1").limit(1).count():
        own_class, texts = own_class.dropDuplicates(["c"]), texts.dropDuplicates(["d"])

    # first round: near copies
    first = _first_pairs(own_class)
    links = linked(first, texts, "jaccard-links")
    found = components(links, "jaccard-components")
    named = own_class.select(F.col("c").alias("d"), "n", "spare0", "spare1").join(
        found.select(F.col("c").alias("d"), "component"), "d", "left"
    )
    named = materialize(named.withColumn("k", F.coalesce("component", "d")).drop("component"), "jaccard-named")

    # second round: pairs that share a signature and are not connected yet
    members = materialize(
        texts.join(small_side(named.select("d", "k")), "d")
        .mapInArrow(lambda batches: _packed(batches, 16 * parts), "bucket int, low long, width int, far int, sign binary, doc binary, back binary")
        .repartition(parts, "bucket")
        .mapInArrow(_shared, "g long, c long, k long, m long"),
        "jaccard-members",
    )
    odd = F.col("g").bitwiseAND(F.lit(1))
    own = Window.partitionBy("c", "odd")
    spare = F.when(F.col("odd") == 1, F.col("spare1")).otherwise(F.col("spare0"))
    # signatures that a set shares at least with each partner, its hot ones left aside
    described = (
        members.join(named.drop("k").withColumnRenamed("d", "c"), "c")
        .withColumn("odd", odd)
        .withColumn("hot", F.sum((F.col("m") > HOT).cast("int")).over(own))
        .withColumn("spare", spare)
        .withColumn("need", F.greatest(F.lit(1), F.col("spare") - F.col("hot")))
        .withColumn("whole", (F.col("hot") == 0) | (F.col("hot") >= F.col("spare")))  # keeps all its signatures
        .filter((F.col("m") <= HOT) | F.col("whole"))
    )
    supported = materialize(_supported(described.select("g", "c", "k", "m", "n", "odd", "need", "spare", "hot", "whole")), "jaccard-supported")
    release(members)
    again = materialize(_supported(_open(supported)), "jaccard-supported")
    release(supported)
    unsettled = materialize(_open(again), "jaccard-unsettled")
    release(again)
    still = materialize(unsettled.select(F.col("c").alias("d")).distinct(), "jaccard-open")
    parities = materialize(
        texts.join(small_side(still), "d", "left_semi").mapInArrow(_parities, "c long, odd long, n long, bits array<long>"), "jaccard-parities"
    )
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # near copies by hot signatures: few pairs join most of them, so that few are left to be compared
    hot = _hot_rows(unsettled, parities)
    closest = _in_blocks(hot, _closest, "jaccard-closest")
    near = linked(materialize(closest.join(done, ["a", "b"], "left_anti"), "jaccard-near-pairs"), texts, "jaccard-near")
    links, done = links.union(near), done.union(closest)
    merged = components(links, "jaccard-merged").withColumnRenamed("component", "now")
    hot_now, unsettled_now = (
        x.join(merged, "c", "left").withColumn("k", F.coalesce("now", "k")).drop("now") for x in (hot, unsettled)
    )
    left = _in_blocks(hot_now, _all_close, "jaccard-hot-pairs")
    rest = _usual_pairs(unsettled_now, parities).union(left).distinct()
    second = materialize(rest.join(done, ["a", "b"], "left_anti"), "jaccard-second")
    release(unsettled, still, parities, hot, closest, left, first, named)
    more = linked(second, texts, "jaccard-more")
    whole = components(links.union(more), "jaccard-whole")
    out = classes.join(whole, "c", "left").select(
        F.col("d").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "c", "d").alias("component_id")
    )
    return out


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`df` without the documents whose component has one with a smaller key."""
    found = join(df, key, text)
    (name,) = unused(df, "gone")
    gone = materialize(
        found.filter(F.col("component_id") != F.col(key)).select(F.col(key).alias(name)).distinct(), "jaccard-gone"
    )
    return df.join(small_side(gone), F.col(key) == F.col(name), "left_anti")
