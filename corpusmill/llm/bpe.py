"""Byte-level BPE encoding and decoding with DuckDB's recursive queries inside Spark tasks.

Spark's regular expressions split the texts; a task keeps each distinct piece of
its chunk once. Pieces that are tokens themselves need no merge. For the others,
a recursive query unnests the token positions, joins adjacent pairs with the
merge table and contracts each piece's leftmost pair of minimum rank, until no
pair joins. A long piece (text without spaces) is cut into blocks that overlap, and
these are encoded like pieces: a sequence of tokens is the encoding of its bytes when
any two neighbours of it are the encoding of theirs, so two blocks are joined at a token
that both have in the same place, whose neighbours are right on either side. Where two blocks share
none, the whole piece goes through a recursive query of its own. Decoding joins token positions with the vocabulary and gathers the
bytes by an ordered aggregation.

Defined results: a null text gives no ids; an empty text gives none either; null
ids decode to empty bytes; ids that the vocabulary lacks decode to null. Rows that
repeat are encoded each. Other columns are carried when named in `carry`; an
output column replaces one of the same name.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corpusmill.llm.common import chunks, unused

# Unicode White_Space, which is what \s means to the tokenizer's own library
_SPACE = r"\t-\r\x20\x85\xa0" + "".join(
    map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)
PIECES_PER_QUERY = 50_000
TOKENS_PER_BATCH = 1 << 18
#: Pieces above this size are encoded in blocks of it, which overlap by a quarter.
LONG_PIECE = 256
OVERLAP = LONG_PIECE // 4

_MERGE = """
with recursive t as (
  select 0 as step, w, list(tok order by p) as toks from start group by w
  union all
  select s.step + 1, s.w, s.toks[: low.p - 1] || [low.m] || s.toks[low.p + 2 :]
  from t s join (
    select w, (k & 1048575) as p, (k >> 20)::integer as m
    from (
      select w, min((m.m::bigint << 20) | p) as k
      from (select w, unnest(toks[:-2])::bigint << 32 | unnest(toks[2:]) as pair,
                   unnest(range(1, len(toks))) as p from t) a
      join merges m using (pair) group by w)
  ) low using (w)
)
select w, arg_max(toks, step) as toks from t group by w order by w
"""

# For long pieces whose blocks share no token: positions stay rows, and every second position of a run of hits
# is contracted from the left, so that a long run takes few steps.
_MERGE_LONG = """
with recursive t as (
  select w, p, tok, false as done from start
  union all
  select w, row_number() over (partition by w order by p), case when cut then low else tok end, low is null
  from (
    select *, lag(cut) over (partition by w order by p) as gone
    from (
      select *, coalesce(rank = low, false)
        and (p - coalesce(max(case when rank = low then null else p end) over (partition by w order by p), 0)) % 2 = 1 as cut
      from (
        select w, p, tok, m.m as rank, min(m.m) over (partition by w) as low
        from (select w, p, tok, tok::bigint << 32 | lead(tok) over (partition by w order by p) as pair
              from t where not done) a
        left join merges m using (pair))
    )
  ) where not coalesce(gone, false)
)
select w, list(tok order by p) as toks from t where done group by w order by w
"""

_DECODE = """
select d, list(coalesce(v.bytes, ''::blob) order by p) as parts, bool_and(v.id is not null) as known
from tokens left join vocabulary v using (id) group by d order by d
"""


@dataclass(frozen=True)
class Vocabulary:
    """Token bytes by id, and every pair of ids whose joint bytes are a token."""

    tokens: pa.Array  # binary, sorted by id
    ids: np.ndarray
    bytes_to_id: np.ndarray  # 256 single bytes
    pairs: np.ndarray  # left << 32 | right
    merged: np.ndarray


def load_vocabulary(path: str) -> Vocabulary:
    """Read a rank file (base64 token and rank per line); its size bounds all that is broadcast."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    pairs, merged = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs.append(left << 32 | right)
                merged.append(rank)
    order = sorted(ranks, key=ranks.__getitem__)
    return Vocabulary(
        pa.array(order, pa.binary()),
        np.array([ranks[t] for t in order], dtype=np.int32),
        np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32),
        np.array(pairs, dtype=np.int64),
        np.array(merged, dtype=np.int32),
    )


def share(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(load_vocabulary(path))


def pieces(text: Column, pattern: str) -> Column:
    """Matches of the tokenizer's pattern, in order."""
    spelled = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(spelled), F.lit(0))


def _connect(v: Vocabulary):
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
    con.register("merge_rows", pa.table({"pair": v.pairs, "m": v.merged}))
    con.execute("create table merges as select * from merge_rows")
    con.register("token_rows", pa.table({"id": v.ids, "bytes": v.tokens}))
    con.execute("create table vocabulary as select * from token_rows")
    return con


def _merge(con, v: Vocabulary, words: pa.Array, statement: str) -> pa.Array:
    """Token ids of each word, as a list array in the words' order."""
    raw = np.frombuffer(b"".join(words.to_pylist()), dtype=np.uint8)
    lens = pc.binary_length(words).to_numpy().astype(np.int64)
    w = np.repeat(np.arange(len(words), dtype=np.int32), lens)
    p = np.arange(len(raw), dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens) + 1
    con.register("start", pa.table({"w": w, "p": p, "tok": v.bytes_to_id[raw]}))
    out = con.sql(statement).to_arrow_table()
    con.unregister("start")
    return out["toks"].combine_chunks()


def encode_distinct(con, v: Vocabulary, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of distinct binary words: a pool of ids, and each word's start and length in it."""
    own = pc.index_in(words, value_set=v.tokens)
    whole = own.is_valid().to_numpy(zero_copy_only=False)
    start, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    pool = [v.ids[own.drop_null().to_numpy()]]
    start[whole], length[whole] = np.arange(whole.sum()), 1
    used = len(pool[0])
    size = pc.binary_length(words).to_numpy(zero_copy_only=False)
    long = np.flatnonzero(~whole & (size > LONG_PIECE))
    alone = []
    for number in long.tolist():
        ids = _in_blocks(con, v, words[number].as_py())
        if ids is None:
            alone.append(number)
            continue
        start[number], length[number] = used, len(ids)
        pool.append(ids)
        used += len(ids)
    for statement, at in ((_MERGE, np.flatnonzero(~whole & (size <= LONG_PIECE))), (_MERGE_LONG, np.array(alone, np.int64))):
        for block in range(0, len(at), PIECES_PER_QUERY):
            own_rows = at[block : block + PIECES_PER_QUERY]
            lists = _merge(con, v, words.take(pa.array(own_rows)), statement)
            length[own_rows] = lists.value_lengths().to_numpy()
            start[own_rows] = used + np.cumsum(length[own_rows]) - length[own_rows]
            pool.append(lists.flatten().to_numpy().astype(np.int32))
            used += len(pool[-1])
    return np.concatenate(pool), start, length


def _in_blocks(con, v: Vocabulary, word: bytes) -> np.ndarray | None:
    """Ids of a long piece, joined from those of its blocks, or None where two blocks share no token."""
    step = LONG_PIECE - OVERLAP
    begins = range(0, max(len(word) - OVERLAP, 1), step)
    blocks = pa.array([word[b : b + LONG_PIECE] for b in begins], pa.binary()).dictionary_encode()
    pool, start, length = encode_distinct(con, v, blocks.dictionary)
    sizes = pc.binary_length(v.tokens).to_numpy().astype(np.int64)
    out, first = [], 0  # first token of a block that is not in the result yet
    held = None
    for begin, code in zip(begins, blocks.indices.to_pylist()):
        ids = pool[start[code] : start[code] + length[code]]
        ends = begin + np.cumsum(sizes[np.searchsorted(v.ids, ids)])
        place = np.stack([np.concatenate([[begin], ends[:-1]]), ends])
        if held is not None:
            last, last_place = held
            shared, here, there = np.intersect1d(last_place[0] << 32 | last_place[1], place[0] << 32 | place[1], return_indices=True)
            if not len(shared):
                return None
            middle = len(shared) // 2
            out.append(last[first : here[middle]])
            first = there[middle]
        held = ids, place
    out.append(held[0][first:])
    return np.concatenate(out).astype(np.int32)


def encode(
    df: DataFrame, vocabulary: Broadcast, pattern: str, text: str = "text", carry: Iterable[str] = (), out: str = "ids"
) -> DataFrame:
    """The columns `carry` and the ids of `text` as array<int> in `out`."""
    carry = [c for c in carry if c.lower() != out.lower()]
    schema = T.StructType([df.schema[c] for c in carry] + [T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])
    (split,) = unused(df, "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = None
        for batch in batches:
            con = con or _connect(vocabulary.value)
            lists = batch.column(split)
            values = lists.flatten().dictionary_encode()
            pool, start, length = encode_distinct(con, vocabulary.value, values.dictionary.cast(pa.binary()))
            codes = values.indices.to_numpy()
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            tokens = np.zeros(len(codes) + 1, np.int64)
            np.cumsum(length[codes], out=tokens[1:])
            tokens = tokens[ends]
            row = 0
            while row < batch.num_rows:  # slices of bounded size; a longer text is one of its own
                stop = max(int(np.searchsorted(tokens, tokens[row] + TOKENS_PER_BATCH, "right")) - 1, row + 1)
                own = codes[ends[row] : ends[stop]]
                n = length[own]
                flat = np.arange(n.sum()) + np.repeat(start[own] - (np.cumsum(n) - n), n)
                ids = pa.ListArray.from_arrays(
                    pa.array((tokens[row : stop + 1] - tokens[row]).astype(np.int32)), pa.array(pool[flat], pa.int32())
                )
                kept = batch.slice(row, stop - row)
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in carry), ids], names=[*carry, out])
                row = stop
        if con:
            con.close()  # the worker lives on

    return df.select(*carry, pieces(F.col(text), pattern).alias(split)).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: Broadcast, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the bytes of `ids` in `out`."""
    kept = [c for c in df.columns if c.lower() != out.lower()]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = None
        for whole in batches:
            con = con or _connect(vocabulary.value)
            sizes = whole.column(ids).value_lengths().fill_null(0).to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            row = 0
            while row < whole.num_rows:
                stop = max(int(np.searchsorted(ends, ends[row] + TOKENS_PER_BATCH, "right")) - 1, row + 1)
                batch = whole.slice(row, stop - row)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), _decode(con, batch.column(ids), sizes[row:stop])], names=[*kept, out]
                )
                row = stop
        if con:
            con.close()

    return df.mapInArrow(run, schema)


def _decode(con, lists: pa.Array, sizes: np.ndarray) -> pa.Array:
    values = lists.flatten().to_numpy(zero_copy_only=False)
    d = np.repeat(np.arange(len(lists), dtype=np.int32), sizes)
    con.register("tokens", pa.table({"d": d, "p": np.arange(len(values), dtype=np.int32), "id": values}))
    found = con.sql(_DECODE).to_arrow_table()
    con.unregister("tokens")
    out: list[bytes | None] = [b""] * len(lists)
    for d, parts, known in zip(found["d"].to_pylist(), found["parts"], found["known"].to_pylist()):
        values = parts.values
        offsets = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1]
        out[d] = values.buffers()[2][offsets[0] : offsets[-1]].to_pybytes() if known else None
    return pa.array(out, pa.binary())


def digests(ids: str = "ids", decoded: str = "decoded") -> list[Column]:
    """Number of ids, SHA-256 of the ids in decimal, and SHA-256 of the decoded bytes."""
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    ]
