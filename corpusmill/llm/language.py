"""Language identification with interpolated Kneser-Ney character models.

A word is a maximal run of letters in lower case with a boundary sign on both sides;
the model predicts each letter and the closing boundary from up to ORDER - 1
signs before it, not beyond the word's start. Per language, n-grams are 64-bit hashes
in sorted arrays: each stored n-gram carries its interpolated probability, each
stored context its back-off weight. A text gets the language with the lowest
cross-entropy per sign.

Fitting reads at most about FIT_ROWS documents, as many of each language (a rate by hash
of the key, so no row order matters), and counts their n-grams in Spark; all of them are kept. The
sample bounds what is broadcast. Other labelled documents, at most about CALIBRATION_ROWS, set
each language's rejection limit and the temperature of the score.

Defined results: a null text, or one without a letter, is `und` with score 0 and not
accepted; so is every text if nothing was learned. Ties go to the language that
sorts first. Repeated rows give equal results; whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corpusmill.llm.common import mix, unused
from corpusmill.runtime import materialize

ORDER = 5
#: Documents of all languages together; each language has an even part of them, and one at least.
FIT_ROWS = 4_000
CALIBRATION_ROWS = 1_200
#: Share of calibration documents of the right language that a limit accepts, and slack on it.
ACCEPTED, SLACK = 0.995, 1.1
EDGE = 0x20


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: Per order (from 1): sorted n-gram hashes, and their probabilities, a column per language (0: not stored).
    grams: tuple[tuple[np.ndarray, np.ndarray], ...]
    #: Per order: sorted context hashes, and back-off weights, a column per language (1: context not stored).
    backoff: tuple[tuple[np.ndarray, np.ndarray], ...]
    limits: np.ndarray
    temperature: float


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))


def _signs(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of ' word word ... ', the places to predict, and each such place's room to its word's edge."""
    text = " " + " ".join(words.to_pylist()) + " "
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    edges = np.flatnonzero(signs == EDGE)
    at = np.arange(1, len(signs))
    room = at - edges[np.searchsorted(edges, at) - 1]  # signs from the opening boundary to here, without this one
    return signs, at, room


def _keys(signs: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Hash of the `order` signs that end at each place."""
    key = np.full(len(at), order, dtype=np.uint64)
    for back in range(order - 1, -1, -1):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signs[at - back])
    return key


def _counted(batch: pa.RecordBatch, words: str, language: str) -> Iterator[pa.RecordBatch]:
    """n-gram counts of a batch: language, order, n-gram, its context, its suffix, whether it opens a word, count."""
    for name in sorted(set(batch.column(language).to_pylist())):
        rows = batch.filter(pc.equal(batch.column(language), name))
        encoded = rows.column(words).flatten().dictionary_encode()
        if not len(encoded):
            continue
        weight = np.bincount(encoded.indices.to_numpy(), minlength=len(encoded.dictionary))
        signs, at, room = _signs(encoded.dictionary)
        word = np.cumsum(signs == EDGE)[at - 1] - 1
        for order in range(1, ORDER + 1):
            fits = room >= order - 1
            here = at[fits]
            key = _keys(signs, here, order)
            unique, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            n = np.bincount(inverse, weights=weight[word[fits]]).astype(np.int64)
            place = here[first]
            context = _keys(signs, place - 1, order - 1) if order > 1 else np.zeros(len(place), np.uint64)
            suffix = _keys(signs, place, order - 1) if order > 1 else np.zeros(len(place), np.uint64)
            opens = room[fits][first] == order - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(unique)),
                    pa.array(np.full(len(unique), order, np.int32)),
                    *(pa.array(x.view(np.int64)) for x in (unique, context, suffix)),
                    pa.array(opens),
                    pa.array(n),
                ],
                names=["lang", "k", "gram", "context", "suffix", "opens", "n"],
            )


def _sampled(df: DataFrame, key: str, lang: str, least: int, rows: int) -> DataFrame:
    """About `rows` rows, an even part of each language (all, if it has fewer), chosen by a hash of the key."""
    counts = {r[0]: r[1] for r in df.groupBy(lang).count().collect()}
    if not counts:
        return df.limit(0)
    scale, each = 1 << 24, max(rows // len(counts), 1)
    rate = F.create_map(*(F.lit(x) for c, n in counts.items() for x in (c, min(scale, each * scale // max(n, 1)))))
    return df.filter(F.pmod(F.xxhash64(key, F.lit(least)), F.lit(scale)) < F.element_at(rate, F.col(lang)))


def _interpolated(rows: pa.Table, languages: tuple[str, ...]) -> tuple[list, list]:
    """Kneser-Ney probabilities and back-off weights of all orders, from the counted n-grams."""
    column = {c: rows[c].to_numpy() for c in ("k", "n", "opens")}
    hashes = {c: rows[c].to_numpy().view(np.uint64) for c in ("gram", "context", "suffix")}
    number = {name: i for i, name in enumerate(languages)}
    lang = np.array([number[x] for x in rows["lang"].to_pylist()], dtype=np.int64)
    grams, backoff = [], []
    for order in range(1, ORDER + 1):
        own, longer = column["k"] == order, column["k"] == order + 1
        keys, contexts = np.unique(hashes["gram"][own]), np.unique(hashes["context"][own])
        probability = np.zeros((len(keys), len(languages)), dtype=np.float32)
        weight = np.ones((len(contexts), len(languages)), dtype=np.float32)
        for i in range(len(languages)):
            mine = own & (lang == i)
            if not mine.any():
                continue
            place = np.searchsorted(keys, hashes["gram"][mine])
            count = column["n"][mine].astype(float)
            if order < ORDER:  # how many different signs stand before; at a word's start there is none, so counts stay
                left = np.zeros(len(keys))
                suffix = hashes["suffix"][longer & (lang == i)]
                at = np.minimum(np.searchsorted(keys, suffix), len(keys) - 1)
                np.add.at(left, at[keys[at] == suffix], 1)
                count = np.where(column["opens"][mine], count, np.maximum(left[place], 1))
            once, twice = (count == 1).sum(), (count == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            h = np.searchsorted(contexts, hashes["context"][mine])
            total = np.bincount(h, count, len(contexts))
            kinds = np.bincount(h, minlength=len(contexts))
            seen = total > 0
            weight[seen, i] = discount * kinds[seen] / total[seen]
            if order == 1:
                lower = np.full(len(count), 1.0 / (len(keys) + 1))
            else:
                below = grams[-1]
                lower = below[1][np.searchsorted(below[0], hashes["suffix"][mine]), i].astype(float)
            probability[place, i] = np.maximum(count - discount, 0) / total[h] + weight[h, i] * lower
        grams.append((keys, probability))
        backoff.append((contexts, weight))
    return grams, backoff


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, (table[at] == keys if len(table) else np.zeros(len(keys), bool))


def log_probabilities(model: Model, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per distinct word: log probability in each language, and its number of predicted signs."""
    signs, at, room = _signs(words)
    depth = np.minimum(room + 1, ORDER)
    whole = np.zeros(len(at), dtype=np.uint64)
    for order in range(1, ORDER + 1):
        mine = depth == order
        whole[mine] = _keys(signs, at[mine], order)
    _, first, inverse = np.unique(whole, return_index=True, return_inverse=True)
    place, depth = at[first], depth[first]
    p = np.full((len(place), len(model.languages)), 1.0 / (len(model.grams[0][0]) + 1), dtype=np.float64)
    for order in range(1, ORDER + 1):
        mine = np.flatnonzero(depth >= order)
        here = place[mine]
        context = _keys(signs, here - 1, order - 1) if order > 1 else np.zeros(len(here), np.uint64)
        h, known = _found(model.backoff[order - 1][0], context)
        lower = p[mine] * np.where(known[:, None], model.backoff[order - 1][1][h] if len(model.backoff[order - 1][0]) else 1.0, 1.0)
        g, stored = _found(model.grams[order - 1][0], _keys(signs, here, order))
        full = model.grams[order - 1][1][g]
        p[mine] = np.where(stored[:, None] & (full > 0), full, lower)
    logs = np.log(np.maximum(p, 1e-12)).astype(np.float32)[inverse]
    starts = np.flatnonzero(signs == EDGE)[:-1]  # word i is predicted at starts[i] + 1 .. starts[i + 1]
    return np.add.reduceat(logs, starts, axis=0), np.diff(np.append(starts, len(at)))


def entropies(model: Model, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per sign of each row in each language, and the row's number of signs."""
    sizes = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    encoded = lists.flatten().dictionary_encode()
    h, length = np.zeros((len(lists), len(model.languages))), np.zeros(len(lists), dtype=np.int64)
    if len(encoded):
        logs, signs = log_probabilities(model, encoded.dictionary)
        codes = encoded.indices.to_numpy()
        ends = np.cumsum(sizes)
        some = np.flatnonzero(sizes)
        starts = (ends - sizes)[some]
        for i in range(len(model.languages)):
            h[some, i] = -np.add.reduceat(logs[codes, i].astype(float), starts)
        length[some] = np.add.reduceat(signs[codes], starts)
        h[some] /= length[some][:, None]
    return h, length


def fit(df: DataFrame, key: str, text: str, lang: str) -> Model:
    """Learn from rows with a text and a language; half of the keys' hashes fit, the rest calibrate."""
    labelled = df.select(key, text, lang).filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    part = F.pmod(F.xxhash64(key, F.lit("calibration")), F.lit(4)) == 0
    words, kept = "w", F.col(lang).cast("string").alias("l")
    counted = materialize(
        _sampled(labelled.filter(~part), key, lang, 1, FIT_ROWS)
        .select(words_of(F.col(text)).alias(words), kept)
        .mapInArrow(
            lambda batches: (out for b in batches for out in _counted(b, words, "l")),
            "lang string, k int, gram long, context long, suffix long, opens boolean, n long",
        )
        .groupBy("lang", "k", "gram")
        .agg(*(F.min(c).alias(c) for c in ("context", "suffix")), F.max("opens").alias("opens"), F.sum("n").alias("n")),
        "language-grams",
    )
    rows = counted.orderBy("lang", "k", "gram").toArrow()
    languages = tuple(sorted(set(rows["lang"].to_pylist())))
    if not languages:
        return Model((), (), (), np.zeros(0), 1.0)
    grams, backoff = _interpolated(rows, languages)
    model = Model(languages, tuple(grams), tuple(backoff), np.full(len(languages), np.inf), 20.0)
    shared = df.sparkSession.sparkContext.broadcast(model)
    sample = _sampled(labelled.filter(part), key, lang, 2, CALIBRATION_ROWS).select(words_of(F.col(text)).alias(words), kept)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, length = entropies(shared.value, b.column(words))
            yield pa.RecordBatch.from_arrays(
                [b.column("l"), pa.array(list(h), pa.list_(pa.float64())), pa.array(length)], names=["l", "h", "length"]
            )

    seen = [r for r in sample.mapInArrow(scored, "l string, h array<double>, length long").collect() if r["length"] and r["l"] in languages]
    if not seen:
        return model
    h, truth = np.array([r["h"] for r in seen]), np.array([languages.index(r["l"]) for r in seen])
    limits = np.full(len(languages), np.inf)
    for i in range(len(languages)):
        own = h[truth == i, i]
        if len(own) >= 20:
            limits[i] = np.quantile(own, ACCEPTED) * SLACK
    likelihood = {t: np.log(np.maximum(_posterior(h, t)[np.arange(len(h)), truth], 1e-9)).mean() for t in (1, 2, 5, 10, 20, 50)}
    return Model(languages, model.grams, model.backoff, limits, float(max(likelihood, key=lambda t: likelihood[t])))


def _posterior(h: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp(-temperature * (h - h.min(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def identify(df: DataFrame, model: Model, text: str = "text", carry: Iterable[str] = ()) -> DataFrame:
    """The columns `carry`, with `lang_pred`, `score` (0 to 1), `cross_entropy` and `accepted`."""
    names = ("lang_pred", "score", "cross_entropy", "accepted")
    carry = [c for c in carry if c.lower() not in names]
    (words,) = unused(df, "words")
    kinds = (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([df.schema[c] for c in carry] + [T.StructField(n, k) for n, k in zip(names, kinds)])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, n = shared.value, b.num_rows
            name, score, entropy, accepted = ["und"] * n, np.zeros(n), [None] * n, np.zeros(n, bool)
            if m.languages:
                h, length = entropies(m, b.column(words))
                best = h.argmin(axis=1)
                lowest = h[np.arange(n), best]
                some = length > 0
                score = np.where(some, _posterior(h, m.temperature)[np.arange(n), best], 0.0)
                accepted = some & (lowest <= m.limits[best])
                name = [m.languages[i] if s else "und" for i, s in zip(best, some)]
                entropy = [float(x) if s else None for x, s in zip(lowest, some)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in carry), pa.array(name), pa.array(score), pa.array(entropy, pa.float64()), pa.array(accepted)],
                names=[*carry, *names],
            )

    return df.select(*carry, words_of(F.col(text)).alias(words)).mapInArrow(run, schema)
