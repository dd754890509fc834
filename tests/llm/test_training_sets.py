"""Hard negatives, prefix trie and packing against plain versions; odd rows and empty tables."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import oracle
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import negatives, packing, trie
from corpusmill.llm.queries import ORACLES, QUERIES

MODEL = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()


@pytest.mark.parametrize("name", ["op8_quality", "op11_negatives", "op12_prefix_trie"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    assert oracle.difference(spark, oracle.connect(sf_dir), sf_dir, QUERIES[name], ORACLES[name]) is None


# -- 11 ----------------------------------------------------------------------------


def plain_negatives(rows, every=5):
    usable = []
    for place, (key, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) or abs(x) >= 4096 for x in vector):
            continue
        usable.append((place, key, label, [math.floor(256 * x) for x in vector]))
    last = lambda key: math.inf if key is None else key
    out = []
    for place, key, label, v in usable:
        if key is None or key % every:
            continue
        near = sorted(((-sum(x * y for x, y in zip(v, w)), last(k), k, m) for p, k, m, w in usable if p != place), key=lambda x: x[:2])
        for score, _, positive, _ in [x for x in near if x[3] == label][:5]:
            fit = [x for x in near if x[3] != label and 30 * -score <= 100 * -x[0] <= 90 * -score][:10]
            out += [(key, positive, i + 1, x[2], -score, -x[0]) for i, x in enumerate(fit)]
    return sorted(out, key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int, of int, score long, `rank` string"


def mined(spark, rows, every=5):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % every == 0).collect()), key=repr)


def test_negatives_equal_brute_force_with_ties_repeats_and_odd_rows(spark):
    rng = random.Random(5)
    vector = lambda n: [rng.choice([0.0, 0.25, 0.5, rng.uniform(-1, 1)]) for _ in range(n)]
    rows = [(i, [float(np.float32(x)) for x in vector(20)], i % 3) for i in range(150)]
    rows += [rows[0], rows[0], rows[31], (200, rows[7][1], 1), (201, rows[7][1], 2)]
    rows += [(205, None, 1), (210, rows[3][1], None), (215, [], 1), (220, [0.5], 2), (225, [math.nan] * 20, 1), (230, [math.inf], 1)]
    rows += [(235, [None, 1.0], 2), (None, rows[4][1], 2), (None, rows[5][1], 1), (240, [1e30], 1), (245, [4095.0] * 20, 0), (-5, rows[9][1], 0)]
    assert mined(spark, rows) == plain_negatives(rows)


def test_common_vector_and_many_labels(spark):
    rng = random.Random(6)
    same = [0.5] * 17
    rows = [(i, same if i % 2 else [rng.uniform(-1, 1) for _ in range(17)], i % 2 or i) for i in range(120)]
    rows = [(k, [float(np.float32(x)) for x in v], m) for k, v, m in rows]
    assert mined(spark, rows, 3) == plain_negatives(rows, 3)


def test_large_components_are_exact(spark):
    """Products that doubles would round."""
    rng = random.Random(8)
    rows = [(i, [float(np.float32(rng.uniform(-4000, 4000))) for _ in range(9000)], i % 2) for i in range(12)]
    assert mined(spark, rows, 4) == plain_negatives(rows, 4)


def test_no_vectors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, None, 1), (5, [], None)]) == []
    assert mined(spark, [(0, [1.0], 1)]) == []


def test_bounds_hold_on_every_level():
    rng = np.random.default_rng(1)
    for width in (1, 3, 16, 50):
        a, b = np.floor(rng.normal(size=(2, 30, width)) * 100)
        exact = a @ b.T
        spread_before = None
        for (am, ad), (bm, bd) in zip(negatives.summaries(a), negatives.summaries(b)):
            middle, spread = am @ bm.T, ad @ bd.T
            assert (middle - spread <= exact + 1e-6).all() and (exact <= middle + spread + 1e-6).all()
            spread_before = spread
        if width <= max(negatives.LEVELS):
            assert np.allclose(spread_before, 0)  # one component per segment


def test_blocks_of_anchors_do_not_matter(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1))) for _ in range(8)], i % 2) for i in range(90)]
    monkeypatch.setattr(negatives, "BLOCK", 4)
    monkeypatch.setattr(negatives, "ROWS", 7)
    assert mined(spark, rows, 3) == plain_negatives(rows, 3)


# -- 12 ----------------------------------------------------------------------------


def plain_trie(rows, exchange=True):
    own = {}
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", sha(text or ""), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if exchange else 0
        base = own.get(c - int(math.fmod(c, 100)), []) if exchange else []
        whole[c] = base[:h] + turns[h:]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), up, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TURN = "conv_id long, turn long, role string, text string, depth int, k1 string, owner int"


def tree(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURN).repartition(3)
    return sorted(map(tuple, trie.prefixes(df, **more).collect()), key=repr)


def talks(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(95, 130), 200, 201, 203, 305, -7, -100, 1000]:
        for t in range(rng.choice([0, 1, 2, 5, 9])):
            rows.append((c, t, rng.choice(["user", None, ""]), rng.choice(["a", "bc", "日本", None, "", "x" * 40])))
    return rows


@pytest.mark.parametrize("exchange", [True, False])
def test_trie_equals_plain_version(spark, exchange):
    rows = talks(1)
    rows += [(108, None, "user", "first"), (108, 3, "user", "twice"), (108, 3, "user", "twice"), (None, 1, "user", "lost"), (109, 2, None, None)]
    rows += [(c, t, "user", f"line {t}") for c in (500, 501, 502, 563) for t in range(40)] + [(563, 50, "user", "more")]
    assert tree(spark, rows, exchange=exchange) == plain_trie(rows, exchange)


def test_long_conversations_are_taken_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 8)
    monkeypatch.setattr(trie, "JOINED", 3)
    rows = [(c, t, "user", f"line {t}" if t < 30 + c % 3 else f"{c} {t}") for c in range(300, 320) for t in range(50 if c % 4 else 31)]
    assert tree(spark, rows) == plain_trie(rows)


def test_one_conversation_holds_most_rows(spark):
    rows = [(7, t, "user", "same") for t in range(3000)] + [(8, 0, "user", "same"), (9, 0, None, "other")]
    found = trie.prefixes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5), exchange=False)
    assert found.count() == 1 + 3000 + 1
    root = found.filter("depth = 0").first()
    assert (root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (3, 2, 2, 4)


def test_no_conversations(spark):
    assert tree(spark, []) == []
    assert tree(spark, [(None, 1, "a", "b")]) == []
    assert tree(spark, [(1, 1, "a", "b")]) == plain_trie([(1, 1, "a", "b")])


# -- 13 ----------------------------------------------------------------------------


def test_words_taken_the_short_way_have_the_tokenizers_ids():
    words, rng = packing.Words(MODEL), random.Random(4)
    assert words.pattern
    signs = "abzABZ'’sStTdDlLmMrReEvV.,;:!?<|>0129àÀßÿŸİıñÑ×÷ªº́  \t\n\x1c\x85日é\x00~`^_-\"#"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|startoftext|>b", "don't I'LL we'Re x'd ''s", "STRASSE Straße ÀÉ Å", "e\u0301a café"]
    ids, offsets = packing.token_ids(pa.array(texts), words, 0)
    for i, found in enumerate(words.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == found.ids + [0]


def test_packing_cuts_encodes_and_fills(spark, odd, odd_rows):
    tokenizer = Tokenizer.from_str(MODEL)
    got = packing.pack(odd, MODEL, with_ids=True).collect()
    pieces = Counter()
    for doc_id, text, *_ in odd_rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            pieces[doc_id, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == pieces
    check_sequences(got)


def check_sequences(rows, limit=2048):
    """Pieces of a sequence follow each other without gaps and do not pass its end; gives the number of sequences."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences)


def test_packing_is_close_to_the_bound(spark, sf_dir):
    rows = QUERIES["op13_packing"](spark, sf_dir).collect()
    n = check_sequences(rows)
    assert n <= math.ceil(sum(r.length for r in rows) / 2048) * 1.02 + 1
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)


def test_a_common_size_is_spread(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "a few words") for i in range(5000)], "doc_id long, text string").repartition(7)
    rows = packing.pack(df, MODEL).collect()
    assert len(rows) == 5000 and check_sequences(rows) == math.ceil(sum(r.length for r in rows) / 2048)


def test_no_documents(spark, empty):
    assert packing.pack(empty, MODEL).count() == 0


def fewest(items, limit):
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= items[i]}:
            k = rooms.index(room)
            go(i + 1, [*rooms[:k], room - items[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, limit - items[i]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best[0]


def test_reduction_loses_no_optimal_packing():
    rng = random.Random(2)
    for _ in range(150):
        limit = rng.choice([10, 20, 37])
        items = [rng.randint(1, limit - 1) for _ in range(rng.randint(0, 10))]
        fixed, rest = packing.reduce(Counter(items), limit)
        left = [s for s, k in rest.items() for _ in range(k)]
        kept = Counter(left)
        for g in fixed:
            kept.update({s: g.n * each for s, each in g.contents})
        assert kept == Counter(items)
        assert sum(g.n for g in fixed) + fewest(left, limit) == fewest(items, limit)


def test_plan_covers_every_rank_once():
    rng = random.Random(3)
    for _ in range(50):
        limit = rng.choice([12, 100])
        counts = Counter(rng.randint(1, limit) for _ in range(rng.randint(1, 300)))
        rows = packing.plan(counts, limit).tolist()
        rooms = Counter()
        for size, n in counts.items():
            mine = [r for r in rows if r[0] == size]
            assert mine[0][1] == 0
            for rank, after in itertools.zip_longest(range(n), range(1, n)):
                row = [r for r in mine if r[1] <= rank][-1]
                rooms[row[2] + (rank - row[1]) // row[3]] += size
        assert max(rooms.values()) <= limit
        assert len(rooms) <= max(math.ceil(sum(s * k for s, k in counts.items()) / limit) * 1.25, 1) + 1
