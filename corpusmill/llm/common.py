"""Helpers shared by the operators: column names, text chunks, vectorised words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """For each name, one that no column of `df` has (case is ignored)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def chunks(batches: Iterable[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut and join batches so that each holds about `most` bytes of a text column.

    A single row above `most` is a chunk of its own.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        sizes = text_bytes(batch.column(column))
        while at < batch.num_rows:
            ends = np.cumsum(sizes[at:]) + size
            n = max(int(np.searchsorted(ends, most, "right")), 0 if held else 1)
            if n:
                held.append(batch.slice(at, n))
                size = int(ends[n - 1])
                at += n
            if at < batch.num_rows or size >= most:
                yield joined(held)
                held, size = [], 0
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def text_bytes(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one array, and the offset of each row (n + 1)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run without white space, and its row."""
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = ~WHITE[raw]
    opens = inside[1:] & ~inside[:-1]  # a word starts at byte i
    closes = inside[:-1] & ~inside[1:]  # a word ended before byte i
    cuts = offsets[1:-1]
    cut = cuts[(cuts > 0) & (cuts < len(raw))]
    both = inside[cut] & inside[cut + 1]  # a row's end inside a run ends the word
    opens[cut[both]] = True
    closes[cut[both]] = True
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, by differences of a running polynomial sum.

    Dividing by the power at a span's start makes the hash the same wherever the span stands.
    """
    n = len(raw)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[raw] * _powers(_BASE, n), out=total[1:])
    h = (total[ends] - total[starts]) * _powers(_BACK, n + 1)[starts]
    return mix(h * np.uint64(0xD6E8FEB86659FD93) + (ends - starts).astype(np.uint64))
