"""Packing documents into training sequences: dominance reduction, then best fit.

Documents become token ids and one end id; only those longer than a sequence are cut. A
piece's size is what matters for packing, and there are at most LIMIT sizes, so the
instance is the number of pieces of each size, however many documents there are.

1. Tasks tokenize, cut, and number the pieces of each size that they made.
2. The counts per size are collected (LIMIT numbers at most) and the plan is made on them:
   a. Martello and Toth's reduction: for the largest size j, a set of at most three pieces
      that dominates every other feasible set with j is fixed for good, as often as
      the counts allow. No optimal packing is lost. Repeated until nothing more is fixed.
   b. Best fit, largest first, for what remains: each piece goes where the least room is left.
   The plan gives, for each size, which of its pieces go to which sequences and where.
3. Tasks turn the number of a piece among those of its size into a sequence and an offset.

No group of equal pieces meets in one task: ranks are a task's own numbers plus the
pieces of that size in earlier tasks.

Words between white space are tokenized when a worker first sees them and then looked up. That gives the
tokenizer's ids: it drops white space, none of its matches crosses any, and no character
combines with a white one before it.

Defined results: a null or empty text is the end id alone; a row with a null key is
packed as others are; rows that repeat a key or text are documents of their own; an
empty table gives no rows. Only the key and the text are read, other columns may have any name.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from corpusmill.llm.common import chunks
from corpusmill.runtime import materialize, small_side

LIMIT = 2048
END_ID = 0
#: Words that a worker remembers; then it starts anew, but still looks into the last ones.
REMEMBERED = 150_000
#: Words that are tokenized at a time; each takes about a kilobyte meanwhile.
TOGETHER = 10_000
#: Bytes of text that are tokenized at a time.
CHUNK = 2 << 20


# -- tokens ---------------------------------------------------------------------


#: A tokenizer with these settings, and any pattern, takes the short way for Latin words.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Printable ASCII and the letters of Latin-1: normal already, and their small letters are one sign each.
_LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")


def _short_way(settings: dict) -> re.Pattern | None:
    """The pattern of a tokenizer's matches in lower-case Latin words, or None where it does more than match."""
    try:
        split, last = settings["pre_tokenizer"]["pretokenizers"]
        pattern = split["pattern"]["Regex"]
        known = settings["normalizer"]["normalizers"] == _NORMALIZER and last == _BYTES and {**split, "pattern": None} == {**_SPLIT, "pattern": None}
    except (KeyError, TypeError, ValueError):
        return None
    if not known or settings["model"]["type"] != "BPE" or settings["model"]["dropout"]:
        return None
    pattern = pattern.replace(r"\p{L}", "a-zß-öø-ÿ").replace(r"\p{N}", "0-9")
    return None if r"\p" in pattern else re.compile(pattern)


def _byte_signs() -> dict[int, str]:
    """The sign that byte-level models write for each byte: itself where it prints, else the next of those from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in prints)
    return {**{b: chr(b) for b in prints}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class Words:
    """Ids of words, each tokenized when first seen and then remembered for a while.

    A Latin word is matched here and its matches, which recur in other words, go to the
    tokenizer's merges one by one; all other words go to the tokenizer whole.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.merges = self.tokenizer.model
        settings = json.loads(model)
        self.pattern = _short_way(settings)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in settings.get("added_tokens") or []) or "(?!)")
        self.signs = _byte_signs()
        self.known: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}
        self.matches: dict[str, bytes] = {}

    def _match(self, match: str) -> bytes:
        found = self.matches.get(match)
        if found is None:
            signs = match if match.isascii() else match.encode().decode("latin-1").translate(self.signs)
            found = self.matches[match] = array("I", [t.id for t in self.merges.tokenize(signs)]).tobytes()
        return found

    def ids(self, words: list[str]) -> list[bytes]:
        """Per word its ids, four little-endian bytes each."""
        if len(self.known) > REMEMBERED:
            self.known, self.last = {}, self.known
        if len(self.matches) > REMEMBERED:
            self.matches = {}
        known, last = self.known, self.last
        new = [w for w in words if w not in known]
        if last:
            known.update((w, last[w]) for w in new if w in last)
            new = [w for w in new if w not in known]
        if self.pattern:
            matches, latin, special, of = self.pattern.findall, _LATIN.fullmatch, self.special.search, self._match
            short = [w for w in new if latin(w) and not special(w)]
            for w in short:
                known[w] = b"".join([of(m) for m in matches(w.lower())])
            new = [w for w in new if w not in known]
        for at in range(0, len(new), TOGETHER):
            some = new[at : at + TOGETHER]
            found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            known.update((w, array("I", e.ids).tobytes()) for w, e in zip(some, found))
        return [known[w] for w in words]


@functools.lru_cache(maxsize=1)
def remembered(model: str) -> Words:
    """One per worker process, which serves many tasks."""
    return Words(model)


def token_ids(column: pa.Array, words: Words, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each closed by `end_id`, and the offset of each text."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(texts)
    per_row = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(split.flatten())
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    found = words.ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    known = np.frombuffer(b"".join(found), np.uint32)
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
    length = ends[number + 1] - ends[number]
    total = np.concatenate([[0], np.cumsum(length)])
    borders = np.concatenate([[0], np.cumsum(per_row)])
    offsets = total[borders] + np.arange(len(borders))  # one end id per text before
    out = np.full(offsets[-1], end_id, np.uint32)
    if len(number):
        row = np.repeat(np.arange(len(per_row)), per_row)
        step = np.arange(total[-1]) - np.repeat(total[:-1], length)
        out[np.arange(total[-1]) + np.repeat(row, length)] = known[np.repeat(ends[number], length) + step]
    return out, offsets


def _cut(df: DataFrame, model: str, limit: int, end_id: int, key: str, text: str, with_ids: bool) -> DataFrame:
    """All pieces: key, piece, start, length, ids_crc32, and the piece's number among those of its task and size."""
    schema = T.StructType(
        [
            T.StructField("key", df.schema[key].dataType),
            T.StructField("piece", T.IntegerType()),
            *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")),
            T.StructField("task", T.IntegerType()),
            T.StructField("place", T.LongType()),
            *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = remembered(model), TaskContext.get().partitionId()
        made = np.zeros(limit + 1, np.int64)
        for batch in chunks(batches, "t", CHUNK):
            ids, offsets = token_ids(batch.column("t"), words, end_id)
            sizes = np.diff(offsets)
            n = -(-sizes // limit)
            row = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = piece * limit
            length = np.minimum(limit, sizes[row] - start)
            begin = offsets[row] + start
            order = np.argsort(length, kind="stable")
            first = np.searchsorted(length[order], length[order])
            place = np.empty(len(row), np.int64)
            place[order] = np.arange(len(row)) - first + made[length[order]]
            made += np.bincount(length, minlength=limit + 1)
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[a : a + m]) for a, m in zip(begin.tolist(), length.tolist())]
            columns = [
                batch.column("key").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                pa.array(crc, pa.int64()), pa.array(np.full(len(row), task, np.int32)), pa.array(place),
            ]
            if with_ids:
                borders = pa.array(np.concatenate([begin, offsets[-1:]]).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(borders, pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("t"))
    return materialize(narrow.mapInArrow(run, schema), "packing-pieces")


# -- the plan, on counts ------------------------------------------------------------


@dataclass
class Group:
    """`n` sequences with equal contents: sizes and how many of each, in their order."""

    n: int
    contents: list[tuple[int, int]]
    room: int


class _Sizes:
    """Pieces left, by size."""

    def __init__(self, counts: dict[int, int]):
        self.n = Counter({s: k for s, k in counts.items() if k})
        self.sorted = sorted(self.n)

    def take(self, size: int, k: int) -> None:
        self.n[size] -= k
        if not self.n[size]:
            del self.n[size]
            self.sorted.pop(bisect.bisect_left(self.sorted, size))

    def largest(self, room: int, used: Counter) -> int | None:
        """The largest size that fits and is left beside the used ones."""
        i = bisect.bisect_right(self.sorted, room) - 1
        while i >= 0 and self.n[self.sorted[i]] <= used[self.sorted[i]]:
            i -= 1
        return self.sorted[i] if i >= 0 else None

    def smallest(self, n: int, used: Counter, above: int = 0) -> list[int]:
        """The n smallest pieces above a size, as far as there are so many."""
        out: list[int] = []
        i = bisect.bisect_right(self.sorted, above)
        while i < len(self.sorted) and len(out) < n:
            size = self.sorted[i]
            out += [size] * min(n - len(out), self.n[size] - used[size])
            i += 1
        return out


def dominating(left: _Sizes, j: int, limit: int) -> tuple[int, ...] | None:
    """A set with j of at most three pieces that dominates all feasible sets with j, or None.

    One set dominates another if the other's pieces can be dealt out to places that the
    pieces of the first one hold, so the first can stand for it in any packing.
    """
    used, room = Counter([j]), limit - j
    top = left.largest(room, used)
    if top is None:
        return (j,)
    low = left.smallest(3, used)
    if top == room or len(low) < 2 or low[0] + low[1] > room:
        return j, top  # it fills the sequence, or no two pieces fit beside j
    if len(low) == 3 and sum(low) <= room:
        return None  # sets of four are not looked at
    best = 0  # the largest sum of a pair beside j
    for x in left.sorted:
        if x >= room or left.n[x] <= used[x]:
            continue
        y = left.largest(min(room - x, x), used + Counter([x]))
        best = max(best, x + y if y else 0)
    if best <= top:
        return j, top
    second = left.largest(room - top, used + Counter([top]))
    if second is None:
        return None
    above = left.smallest(2, used, second)
    return (j, top, second) if len(above) < 2 or sum(above) > room else None


def reduce(counts: dict[int, int], limit: int) -> tuple[list[Group], dict[int, int]]:
    """Sequences that some optimal packing has, and the pieces left after them.

    A set stays dominating while its pieces last, since the others only become fewer; so
    it is fixed as often as the counts allow.
    """
    left, fixed, again = _Sizes(counts), [], True
    while again:
        again = False
        for j in reversed(left.sorted.copy()):
            while left.n[j] and (found := dominating(left, j, limit)):
                need = Counter(found)
                times = min(left.n[x] // k for x, k in need.items())
                for x, k in need.items():
                    left.take(x, k * times)
                fixed.append(Group(times, list(need.items()), limit - sum(found)))
                again = True
    return fixed, dict(left.n)


def best_fit(counts: dict[int, int], limit: int) -> list[Group]:
    """Best fit, largest first, with all pieces of a size at a time.

    A piece goes to a sequence with the least room that suffices, which is then the one
    for the next piece too, until it has no room for another.
    """
    by_room: dict[int, list[Group]] = {}
    rooms: list[int] = []

    def put(group: Group) -> None:
        if group.room not in by_room:
            by_room[group.room] = []
            bisect.insort(rooms, group.room)
        by_room[group.room].append(group)

    def pop(size: int) -> Group | None:
        i = bisect.bisect_left(rooms, size)
        if i == len(rooms):
            return None
        room = rooms[i]
        group = by_room[room].pop()
        if not by_room[room]:
            del by_room[room]
            rooms.pop(i)
        return group

    for size in sorted(counts, reverse=True):
        k = counts[size]
        while k:
            group = pop(size) or Group(-(-k // (limit // size)), [], limit)
            each = group.room // size
            filled = min(group.n, k // each)
            rest = min(k - filled * each, each - 1) if filled < group.n else 0
            if filled:
                put(Group(filled, [*group.contents, (size, each)], group.room - each * size))
            if rest:
                put(Group(1, [*group.contents, (size, rest)], group.room - rest * size))
            untouched = group.n - filled - (rest > 0)
            if untouched and group.contents:
                put(Group(untouched, group.contents, group.room))
            k -= filled * each + rest
    return [g for groups in by_room.values() for g in groups]


def plan(counts: dict[int, int], limit: int = LIMIT) -> np.ndarray:
    """Rows (size, first rank, first sequence, pieces per sequence, offset), by size and rank.

    The pieces of a size from the first rank of a row to that of the next go to sequences in
    turn, `pieces per sequence` each, the first of them at `offset`.
    """
    full = counts.get(limit, 0)
    fixed, rest = reduce({s: k for s, k in counts.items() if 0 < s < limit}, limit)
    groups = [*([Group(full, [(limit, 1)], 0)] if full else []), *fixed, *best_fit(rest, limit)]
    rank: Counter = Counter()
    rows, sequence = [], 0
    for group in groups:
        offset = 0
        for size, each in group.contents:
            rows.append((size, rank[size], sequence, each, offset))
            rank[size] += group.n * each
            offset += size * each
        sequence += group.n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# -- the operator -------------------------------------------------------------------


def pack(
    df: DataFrame,
    model: str,
    key: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32, sequence_id, offset, and the ids where wanted.

    `model` is the content of a tokenizer file.
    """
    pieces = _cut(df, model, limit, end_id, key, text, with_ids)
    counts = materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "packing-counts")
    sizes = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(sizes, limit)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "packing-starts")
    ranked = pieces.join(small_side(starts), ["task", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    out = T.StructType([T.StructField(key, pieces.schema["key"].dataType), *(pieces.schema[c] for c in ("piece", "start", "length", "ids_crc32"))])
    out = out.add("sequence_id", "long").add("offset", "long")
    if with_ids:
        out.add(pieces.schema["ids"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.searchsorted(rows[:, 0], np.arange(limit + 2))  # of each size
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            order = np.lexsort((rank, length))
            # the last row of the size that begins at the rank or before it
            row = np.empty(len(rank), np.int64)
            for size in np.unique(length):
                mine = order[np.searchsorted(length[order], size) : np.searchsorted(length[order], size, "right")]
                a, b = first[size], first[size + 1]
                row[mine] = a + np.searchsorted(rows[a:b, 1], rank[mine], "right") - 1
            nth, each = rank - rows[row, 1], rows[row, 3]
            columns = [batch.column("key"), *(batch.column(c) for c in ("piece", "start", "length", "ids_crc32"))]
            columns += [pa.array(rows[row, 2] + nth // each), pa.array(rows[row, 4] + nth % each * length)]
            yield pa.RecordBatch.from_arrays(columns + ([batch.column("ids")] if with_ids else []), names=out.names)

    return ranked.mapInArrow(place, out)
