"""Trie of conversation prefixes by truncation peeling.

A conversation cut to its first d turns has a 128-bit key, the XOR of its turns' hashes,
each taken with its place. So stripping the last turn takes that turn's hash out of the
key, and conversations that are equal so far meet at an equal key.

Nodes are discovered by one grouped aggregate over the keys. Turns that exactly the
same conversations share (a chain, such as the part of a conversation that no other has)
are stripped as one: on the path of a conversation they are the nodes with equal numbers of
members. Peeling then goes from the deepest chains upward: each round takes the chains
whose continuations are all peeled, together with those where conversations newly end,
strips them, and regroups them by what is left, adding leaves and saved tokens to the
chain above. Rounds are as many as a path has branchings, not turns.

No conversation or group of equal ones is held by one task. Turns are numbered by a range sort and
counts per range; running keys are taken in pieces of PIECE turns; the members that end at a node
are hashed in order from joined pieces of text, since SHA-256 must read them one after the other.

Defined results: a null role or text is empty; a null turn comes first; turns of equal
number are ordered by role, then by the SHA-256 of the text; repeated rows are turns of
their own; rows with a null conversation are left out; an empty table has no nodes, not
even a root. Texts of any length count whole, by code points. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.runtime import materialize, release, scratch_path, small_side

#: Turns of a conversation whose running keys are taken in one window.
PIECE = 4096
#: Conversation ids that are joined into one piece of text.
JOINED = 1 << 14
HEADS, GROUP = 6, 100

NODE = ["depth", "k1", "k2"]


def numbered(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, pos, n, t1, t2, len) of every turn: its place from 1, the number of turns, its hashes and length.

    A sort by ranges deals a long conversation out to several tasks; a row's place is its
    place in its range plus the conversation's rows in earlier ranges.
    """
    body, who = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    narrow = df.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), who.alias("role"),
        F.unhex(F.sha2(body.cast("binary"), 256)).alias("sha"), F.char_length(body).cast("long").alias("len"),
        F.monotonically_increasing_id().alias("row"),  # equal rows can be dealt out too
    )
    order = ["conv", F.asc_nulls_first("turn"), "role", "sha", "row"]
    placed = narrow.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv", F.monotonically_increasing_id().alias("at"),
        F.xxhash64(F.lit(1), "role", "sha").alias("t1"), F.xxhash64(F.lit(2), "sha", "role").alias("t2"), "len",
    )
    placed = materialize(placed.withColumn("part", F.shiftright("at", 33)), "trie-turns")
    whole = Window.partitionBy("conv")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        placed.groupBy("conv", "part")
        .agg(F.min("at").alias("first"), F.count("*").alias("m"))
        .select("conv", "part", (F.coalesce(F.sum("m").over(earlier), F.lit(0)) + 1 - F.col("first")).alias("off"), F.sum("m").over(whole).alias("n"))
    )
    return placed.join(firsts, ["conv", "part"]).select("conv", (F.col("at") + F.col("off")).alias("pos"), "n", "t1", "t2", "len")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth, t1, t2, len, last) and conversations (conv, total) after the exchange of heads.

    The first h turns of a conversation give way to those of the first conversation of its hundred.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    base = F.col("conv") - F.col("conv") % GROUP
    sizes = materialize(turns.groupBy("conv").agg(F.max("n").alias("n")), "trie-sizes")
    bases = sizes.filter(F.col("conv") % GROUP == 0).select(F.col("conv").alias("base"), F.least("n", F.lit(HEADS - 1)).alias("nb"))
    side = small_side(bases)
    head = F.least("h", F.coalesce("nb", F.lit(0)))
    with_head = lambda df: df.withColumns({"h": h, "base": base}).join(side, "base", "left").withColumn("head", head)
    known = with_head(sizes).select("conv", "base", "h", "head", "n", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))
    known = materialize(known, "trie-conversations")
    own = with_head(turns).filter("pos > h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("head")).alias("depth"), "t1", "t2", "len", (F.col("pos") == F.col("n")).alias("last")
    )
    heads = turns.filter((F.col("conv") % GROUP == 0) & (F.col("pos") < HEADS)).select(F.col("conv").alias("base"), "pos", "t1", "t2", "len")
    lent = known.filter("head > 0").join(heads, "base").filter("pos <= head").select(
        "conv", F.col("pos").alias("depth"), "t1", "t2", "len", ((F.col("pos") == F.col("head")) & (F.col("n") <= F.col("h"))).alias("last")
    )
    return own.union(lent), known.select("conv", "total")


def truncations(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Every conversation cut at every depth: keys (k), keys without the last turn (p), lengths, and whether it ends there."""
    hashed = turns.select(
        "conv", "depth", F.xxhash64(F.lit(1), "depth", "t1", "t2").alias("x1"), F.xxhash64(F.lit(2), "t2", "t1", "depth").alias("x2"),
        "len", "last", F.floor(F.col("depth") / PIECE).alias("piece"),
    )
    order = Window.partitionBy("conv", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = hashed.select(
        "conv", "piece", "depth", "x1", "x2", "len", "last",
        F.bit_xor("x1").over(order).alias("k1"), F.bit_xor("x2").over(order).alias("k2"), F.sum("len").over(order).alias("cum"),
    )
    # only conversations of more than a piece have earlier pieces
    long = conversations.filter(F.col("total") >= PIECE).select("conv")
    earlier = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        hashed.join(small_side(long), "conv", "left_semi")
        .groupBy("conv", "piece")
        .agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("len").alias("len"))
        .select(
            "conv", "piece", F.bit_xor("x1").over(earlier).alias("c1"), F.bit_xor("x2").over(earlier).alias("c2"), F.sum("len").over(earlier).alias("c"),
        )
    )
    carried = materialize(carried.filter("c1 is not null"), "trie-carried")
    zero = lambda c: F.coalesce(c, F.lit(0))
    keyed = (
        inside.join(small_side(carried), ["conv", "piece"], "left")
        .withColumns({"k1": F.col("k1").bitwiseXOR(zero("c1")), "k2": F.col("k2").bitwiseXOR(zero("c2")), "cum": F.col("cum") + zero("c")})
        .select("conv", *NODE, F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "len", "cum", "last")
    )
    nothing = F.lit(0).cast("long")
    root = conversations.select(
        "conv", *(nothing.alias(c) for c in NODE), *(F.lit(None).cast("long").alias(c) for c in ("p1", "p2")),
        nothing.alias("len"), nothing.alias("cum"), (F.col("total") == 0).alias("last"),
    )
    return keyed.union(root)


def end_digests(cut: DataFrame, found: str = "ends_sha256") -> DataFrame:
    """Per node where conversations end: SHA-256 of their ids in order, joined by commas."""
    ends = cut.filter("last").select(*NODE, "conv")
    schema = "depth long, k1 long, k2 long, first long, ids string"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*(pa.array([r[0][i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[1][0] for r in rows], pa.int64()),
                 pa.array([",".join(map(str, r[1])) for r in rows], pa.string())], names=[*NODE, "first", "ids"]
            )

        node, held, done = None, [], []
        for batch in batches:
            for *here, conv in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv"))):
                if held and (here != node or len(held) >= JOINED):
                    done.append((node, held))
                    held = []
                node = here
                held.append(conv)
            if done:
                yield out(done)
                done = []
        if held:
            yield out([(node, held)])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*(pa.array([r[0][i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[1] for r in rows], pa.string())], names=[*NODE, found]
            )

        node, running, done = None, None, []
        for batch in batches:
            for *here, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if here == node:
                    running.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((node, running.hexdigest()))
                node, running = here, hashlib.sha256(ids.encode())
            if done:
                yield out(done)
                done = []
        if node is not None:
            yield out([(node, running.hexdigest())])

    joined = ends.repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv").mapInArrow(join, schema)
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, f"depth long, k1 long, k2 long, {found} string")


def peeled(nodes: DataFrame) -> DataFrame:
    """Chains of `nodes` with the number of chains that continue them, their leaves, and the tokens saved below them."""
    spark = nodes.sparkSession
    chains = nodes.groupBy("owner", "n").agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.min(F.col("cum") - F.col("len")).alias("before"), F.max("cum").alias("cum"),
        *(F.max_by(c, "depth").alias(c) for c in ("k1", "k2")), *(F.min_by(c, "depth").alias(c) for c in ("p1", "p2")),
    )
    chains = materialize(chains, "trie-chains")
    stripped = lambda df, *what: df.groupBy((F.col("top") - 1).alias("bottom"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(*what)
    zero = lambda c: F.coalesce(c, F.lit(0))
    kids = stripped(chains.filter("top > 0"), F.count("*").alias("kids"))
    start = {"kids": zero("kids"), **{c: F.lit(0).cast("long") for c in ("got", "leaves", "saved")}}
    pending = materialize(chains.join(kids, ["bottom", "k1", "k2"], "left").withColumns(start), "trie-pending")
    path, columns = scratch_path(spark, "trie-peeled"), [*chains.columns, "kids", "n_leaves", "saved"]
    while True:
        ready = pending.filter("got = kids").withColumn("n_leaves", F.greatest("leaves", F.lit(1))).select(columns)
        ready.write.mode("append").parquet(path)
        above = F.col("saved") + (F.col("n") - 1) * (F.col("cum") - F.col("before"))
        up = stripped(
            ready.filter("top > 0"), F.count("*").alias("more"), F.sum("n_leaves").alias("more_leaves"), F.sum(above).alias("more_saved")
        )
        added = {"got": F.col("got") + zero("more"), "leaves": F.col("leaves") + zero("more_leaves"), "saved": F.col("saved") + zero("more_saved")}
        left = pending.filter("got < kids").join(up, ["bottom", "k1", "k2"], "left").withColumns(added).select(pending.columns)
        last, pending = pending, materialize(left, "trie-pending")
        schema = ready.schema
        release(last)
        if pending.isEmpty():
            return spark.read.schema(schema).parquet(path)


def trie(cut: DataFrame) -> DataFrame:
    """One row per node of the trie of all `truncations`."""
    cut = materialize(cut, "trie-truncations")
    nodes = cut.groupBy(*NODE).agg(
        F.min("conv").alias("owner"), F.count("*").alias("n"), *(F.max(c).alias(c) for c in ("p1", "p2", "len", "cum")),
        F.count_if("last").alias("ends"),
    )
    nodes = materialize(nodes, "trie-nodes")
    chains = peeled(nodes)
    # the chain above, whose continuations may be many: a sort-merge join, so that skewed parts are split at run time
    parents = chains.select(
        F.col("owner").alias("parent"), (F.col("bottom") + 1).alias("top"), F.col("k1").alias("p1"), F.col("k2").alias("p2")
    )
    placed = chains.drop("k1", "k2", "before").join(parents.hint("merge"), ["top", "p1", "p2"], "left").drop("p1", "p2")
    # pieces of a long chain's depths are joined apart
    piece = lambda c: F.floor(F.col(c) / PIECE)
    placed = placed.withColumnRenamed("cum", "low").withColumn("piece", F.explode(F.sequence(piece("top"), piece("bottom"))))
    joined = nodes.drop("p1", "p2").withColumn("piece", piece("depth")).join(placed, ["owner", "n", "piece"])
    joined = joined.join(end_digests(cut), NODE, "left")
    in_chain: Column = F.col("depth") < F.col("bottom")
    return joined.select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > F.col("top"), F.col("owner")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(in_chain, F.lit(1).cast("long")).otherwise(F.col("kids")).alias("n_children"),
        "n_leaves",
        (F.col("saved") + (F.col("n") - 1) * (F.col("low") - F.col("cum") + F.col("len"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def prefixes(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", exchange: bool = True) -> DataFrame:
    """The trie of the conversations of `df`, with exchanged heads or as they are."""
    turns = numbered(df, conv, turn, role, text)
    if exchange:
        turns = materialize(turns, "trie-numbered")
        return trie(truncations(*rebuilt(turns)))
    turns = materialize(turns.withColumn("depth", F.col("pos")).withColumn("last", F.col("pos") == F.col("n")), "trie-numbered")
    return trie(truncations(turns, turns.groupBy("conv").agg(F.max("n").alias("total"))))
