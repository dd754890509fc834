"""Topic models by their properties, coherence by brute force, and streams."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.clustering import LDA
from pyspark.sql import functions as F

from corpusmill.operators import alignment, coherence, online_lda, topics
from corpusmill.operators.preprocess import Preprocessor
from corpusmill.runtime import materialize, scratch_path
from corpusmill.settings import Settings
from corpusmill.sources import tables
from corpusmill.streaming import flows

PLANTED = Settings().with_(passes=40, no_below=1, no_above=1.0)


@pytest.fixture(scope="module")
def planted(spark):
    """400 documents over four groups of words and some shared ones."""
    rows = []
    for d in range(400):
        words = []
        for p in range(60):
            shared = p % 10 == 9
            words.append(
                f"s{(d * 7 + p * 3) % 20}" if shared else f"g{d % 4}w{(d * 13 + p * p + 5 * p) % 25}"
            )
        rows.append((d, words))
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    return materialize(df.repartition(4, "doc_id"), "planted")


@pytest.fixture(scope="module")
def model(planted):
    return topics.train(planted, 4, PLANTED)


def test_planted_topics_are_found(model):
    for _, words in model.top_words(10):
        groups = Counter(w[:2] for w in words if w.startswith("g"))
        assert len(groups) == 1
    assert model.metadata.coherence_score > 0.5
    assert model.metadata.training_time_seconds > 0


def test_distributions_sum_to_one(spark, model, planted):
    theta = model.theta(planted)
    sums = theta.select(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
    assert len(sums) == 400 and all(r["s"] == pytest.approx(1) for r in sums)
    phi = model.phi(spark).groupBy("topic_id").agg(F.sum("weight").alias("s")).collect()
    assert len(phi) == 4 and all(r["s"] == pytest.approx(1) for r in phi)


def test_same_seed_same_model(model, planted):
    again = topics.train(planted, 4, PLANTED, with_coherence=False)
    a = {r["doc_id"]: r["probs"] for r in model.theta(planted).collect()}
    b = {r["doc_id"]: r["probs"] for r in again.theta(planted).collect()}
    assert all(a[d] == pytest.approx(b[d], abs=1e-6) for d in a)


def test_unknown_words_give_equal_probabilities(spark, model):
    df = spark.createDataFrame([(1, ["unheard"]), (2, [])], "doc_id long, tokens array<string>")
    for row in model.theta(df).collect():
        assert row["probs"] == [0.25] * 4


def test_infer(spark, model):
    df = spark.createDataFrame([(1, "G1w3 g1w5\tg1w7 g1w9 g1w11"), (2, None)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in model.infer(df, n_words=3).collect()}
    assert out[1]["num_tokens"] == 5 and out[2]["num_tokens"] == 0
    probs = [t["probability"] for t in out[1]["topics"]]
    assert probs == sorted(probs, reverse=True) and len(out[1]["topics"][0]["top_words"]) == 3
    assert all(w.startswith("g1") for w in out[1]["topics"][0]["top_words"])


def test_model_survives_storage(spark, model, planted):
    path = scratch_path(spark, "test-model")
    tables.save_model(model, spark, path)
    again = tables.load_model(spark, path)
    assert again.metadata == model.metadata
    a = {r["doc_id"]: r["probs"] for r in model.theta(planted).collect()}
    b = {r["doc_id"]: r["probs"] for r in again.theta(planted).collect()}
    assert a == b


def test_search_prefers_the_best(spark, planted):
    best, results = topics.search_topic_counts(planted, [2, 4], PLANTED.with_(passes=15))
    rows = {r["num_topics"]: r["coherence"] for r in results.collect()}
    assert set(rows) == {2, 4} and rows[best] == max(rows.values())


def test_update_plan():
    assert topics.update_plan(10_000, Settings()) == (0.3, 80)
    share, updates = topics.update_plan(10**7, Settings())
    assert share * 10**7 == pytest.approx(Settings().chunk_size) and share * updates == pytest.approx(Settings().passes, rel=1e-3)
    assert topics.update_plan(500, Settings()) == (1.0, 20)


def test_bound_theta_is_recomputed(model, planted):
    bound = topics.BoundTheta(model, planted)
    assert bound.theta.count() == 400
    bound.refresh(planted.where("doc_id < 10"))
    assert bound.theta.count() == 10


# -- coherence ----------------------------------------------------------------


def brute_force_coherence(lists, words, window, relevant_only=True):
    total, single, both = 0, Counter(), Counter()
    known = {w for ws in words for w in ws}
    for tokens in lists:
        if relevant_only and not known & set(tokens):
            continue
        for start in range(max(1, len(tokens) - window + 1)):
            seen = set(tokens[start:start + window]) & known
            total += 1
            for a in seen:
                single[a] += 1
                for b in seen:
                    both[a, b] += 1
    scores = []
    for ws in words:
        def npmi(a, b):
            if not single[a] or not single[b]:
                return 0.0
            p = both[a, b] / total + 1e-12
            return math.log(p / (single[a] / total * single[b] / total)) / -math.log(p)

        v = {a: [npmi(a, b) for b in ws] for a in ws}
        s = [sum(col) for col in zip(*v.values())]

        def cosine(x, y):
            scale = math.sqrt(sum(i * i for i in x)) * math.sqrt(sum(i * i for i in y))
            return sum(i * j for i, j in zip(x, y)) / scale if scale else 0.0

        scores.append(sum(cosine(v[a], s) for a in ws) / len(ws))
    return scores


@pytest.mark.parametrize("window,relevant_only", [(110, True), (7, True), (7, False)])
def test_coherence_is_the_published_measure(spark, planted, window, relevant_only):
    lists = [r["tokens"] for r in planted.collect()] + [["zzz"] * 30, [], ["s1"]]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, tokens array<string>").repartition(5)
    words = [["g0w0", "g0w1", "g0w4", "s1"], ["g1w2", "g2w3", "s5", "never"]]
    counts = coherence.window_counts(df, list(enumerate(words)), "tokens", window, relevant_only)
    got = {r["topic_id"]: r["coherence"] for r in coherence.topic_coherence(materialize(counts, "w"), 4).collect()}
    want = brute_force_coherence(lists, words, window, relevant_only)
    assert [got[0], got[1]] == pytest.approx(want, abs=1e-9)


def test_coherence_in_small_chunks(spark, planted, monkeypatch):
    words = [(0, ["g0w0", "g0w1", "s1"]), (1, ["g1w2", "s5"])]
    whole = coherence.window_counts(planted, words, window=9).collect()
    monkeypatch.setattr(coherence, "_CHUNK", 100)
    pieces = coherence.window_counts(planted, words, window=9).collect()
    assert sorted(whole) == sorted(pieces)


def test_coherence_of_a_long_document(spark):
    """More than 200,000 windows in one document; window and number of words as the study has them."""
    rng = random.Random(3)
    words = [[f"a{i}" for i in range(20)], [f"b{i}" for i in range(19)] + ["a0"]]
    vocabulary = [*words[0], *words[1], *(f"z{i}" for i in range(400))]
    long = [rng.choice(vocabulary) for _ in range(200_300)]
    lists = [long, long[:500], ["a0"] * 150, ["z1"] * 200]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, tokens array<string>").coalesce(1)
    counts = coherence.window_counts(df, list(enumerate(words)))
    got = {r["topic_id"]: r["coherence"] for r in coherence.topic_coherence(materialize(counts, "w"), 20).collect()}
    assert [got[0], got[1]] == pytest.approx(brute_force_coherence(lists, words, 110), abs=1e-9)


def test_one_scan_scores_all_models_alike(spark, planted, model):
    other = topics.train(planted, 2, PLANTED.with_(passes=5))
    scores = dict(topics.coherence_of_models([other, model], planted).select("model", "coherence").collect())
    assert scores[1] == pytest.approx(model.metadata.coherence_score)
    per_topic = topics.coherence_by_topic(other, planted)
    assert scores[0] == pytest.approx(coherence.model_coherence(per_topic).first()[0])


# -- priors and alignment -------------------------------------------------------


def test_prior_modes():
    assert topics.concentrations(None, 4) == ("symmetric", [0.25] * 4, False)
    assert topics.concentrations("auto", 2) == ("auto", [0.5, 0.5], True)
    name, values, learned = topics.concentrations("asymmetric", 5)
    assert name == "asymmetric" and sum(values) == pytest.approx(1) and values == sorted(values, reverse=True) and not learned
    assert values[0] / values[3] == pytest.approx((3 + math.sqrt(5)) / math.sqrt(5))
    assert topics.concentrations([0.1, 0.9], 2)[1] == [0.1, 0.9] and topics.concentrations(2, 2)[1] == [2.0, 2.0]
    for wrong in ("other", [0.1], [0.1, -1.0]):
        with pytest.raises(ValueError):
            topics.concentrations(wrong, 2)
    assert topics.word_concentration(None, 4) == 0.25 and topics.word_concentration(0.1, 4) == 0.1
    with pytest.raises(ValueError):
        topics.word_concentration("auto", 4)


def test_tasks_of_an_update_do_not_grow_with_the_documents(planted):
    stage = topics.fit_vectorizer(planted, settings=PLANTED)
    assert topics.features(planted, stage, 400).rdd.getNumPartitions() == 8
    assert topics.features(planted, stage, 256_410).rdd.getNumPartitions() == 8
    assert topics.features(planted, stage, 2_000_001).rdd.getNumPartitions() == 11


def test_models_of_a_search_have_fewer_tasks_each(planted, monkeypatch):
    used, fit = [], topics.fit_lda

    def counted(bow, *rest):
        used.append(bow.rdd.getNumPartitions())
        return fit(bow, *rest)

    monkeypatch.setattr(topics, "fit_lda", counted)
    topics.train(planted, 2, PLANTED.with_(passes=1), with_coherence=False)
    best, scores = topics.search_topic_counts(planted, (2, 4), PLANTED)
    assert used == [8, 4, 4] and best == 4 and scores.count() == 2


def test_models_fitted_together_equal_those_fitted_alone(spark, planted):
    short = PLANTED.with_(passes=5)
    together = topics.train_priors(planted, 4, ["asymmetric", "auto"], short)
    for model, alpha in zip(together, ("asymmetric", "auto"), strict=True):
        alone = topics.train(planted, 4, short, alpha=alpha, with_coherence=False)
        assert model.metadata.prior == alpha and model.metadata.alpha == pytest.approx(alone.metadata.alpha)
        got, want = ({(r[0], r[1]): r[2] for r in m.phi(spark).collect()} for m in (model, alone))
        assert got == pytest.approx(want)


# -- all updates in one stage ---------------------------------------------------


def _mixed(spark):
    """1,500 documents of 0 to 80 words over four groups."""
    rng = random.Random(1)
    rows = []
    for d in range(1500):
        group = rng.randrange(4)
        words = [f"g{group if rng.random() < 0.8 else rng.randrange(4)}w{int(rng.random() ** 2 * 40)}" for _ in range(rng.choice([0, 5, 40, 80]))]
        rows.append((d, words))
    return materialize(spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(4, "doc_id"), "mixed")


@pytest.mark.parametrize("chunk,alpha,parts", [(100, None, 8), (500, "auto", 4), (100, "auto", 11)])
def test_updates_in_one_stage_give_the_model_of_spark_ml(spark, chunk, alpha, parts):
    docs, settings = _mixed(spark), Settings().with_(passes=2, no_below=1, no_above=1.0, chunk_size=chunk)
    stage = topics.fit_vectorizer(docs, settings=settings)
    bow = topics.features(docs, stage, 1500, "tokens", parts)
    share, updates = topics.update_plan(1500, settings)
    lda = LDA(
        k=5, optimizer="online", maxIter=updates, subsamplingRate=share, docConcentration=[0.2] * 5, topicConcentration=0.2,
        optimizeDocConcentration=alpha == "auto", learningDecay=0.5, learningOffset=1.0, seed=42,
    )
    want = lda.fit(bow)
    got, made = topics.fit_lda(bow, 1500, 5, settings, alpha, None, parts)
    assert made == updates and got.vocabSize() == want.vocabSize() and not got.isDistributed()
    np.testing.assert_allclose(got.topicsMatrix().toArray(), want.topicsMatrix().toArray(), rtol=1e-5)
    np.testing.assert_allclose(got.estimatedDocConcentration().toArray(), want.estimatedDocConcentration().toArray(), rtol=1e-6)
    a, b = ({r["doc_id"]: r["topicDistribution"].toArray() for r in m.transform(bow).collect()} for m in (got, want))
    assert len(a) == 1500 and all(np.allclose(a[d], b[d], atol=1e-3) for d in a)


def test_an_update_needs_no_job_of_its_own(spark):
    docs = _mixed(spark)
    tracker = spark.sparkContext.statusTracker()

    def jobs(passes):
        group = f"updates-{passes}"
        spark.sparkContext.setJobGroup(group, group)
        settings = Settings().with_(passes=passes, no_below=1, no_above=1.0, chunk_size=100)
        stage = topics.fit_vectorizer(docs, settings=settings)
        topics.fit_lda(topics.features(docs, stage, 1500), 1500, 3, settings)
        return len(tracker.getJobIdsForGroup(group))

    try:
        assert jobs(1) == jobs(4)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_document_is_iterated_alike_in_every_block(monkeypatch):
    rng = np.random.default_rng(5)
    lengths = rng.integers(0, 30, 200)
    batch = pa.RecordBatch.from_pydict(
        {
            "part": pa.array([d * 3 // 200 for d in range(200)], pa.int32()),
            "terms": pa.array([rng.choice(50, n, replace=False).tolist() for n in lengths], pa.list_(pa.int32())),
            "counts": pa.array([rng.integers(1, 9, n).astype(float).tolist() for n in lengths], pa.list_(pa.float64())),
        }
    )
    start = rng.gamma(100, 0.01, (50, 4))

    def fitted():
        return online_lda.run(iter([batch]), 0, 1, lambda number, message: [message], 3, start, np.full(4, 0.25), 0.25, True, 200, 0.3, 8, 1.0, 0.5, 7)

    whole = fitted()
    monkeypatch.setattr(online_lda, "_BLOCK", 300)
    for a, b in zip(whole, fitted(), strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-9)


def test_random_numbers_are_those_of_spark(spark):
    jvm, seed = spark._jvm, -123456789012345
    ours, java = online_lda.JavaRandom(42), jvm.java.util.Random(42)
    assert [ours.next_long() for _ in range(4)] == [java.nextLong() for _ in range(4)]
    basis = jvm.breeze.stats.distributions.RandBasis(jvm.org.apache.commons.math3.random.MersenneTwister(seed))
    gamma = jvm.breeze.stats.distributions.Gamma(100.0, 0.01, basis)
    assert online_lda.gamma_start(seed, 90).tolist() == pytest.approx([gamma.draw() for _ in range(90)])
    for share in (0.02, 0.39):
        drawn = spark.range(0, 400, 1, 4)._jdf.toJavaRDD().rdd().sample(True, share, 99).toJavaRDD().collect()
        ours = online_lda.JavaRandom(99)
        places = [100 * p + int(i) for p in range(4) for i in online_lda.sample(100, share, ours.next_long())]
        assert places == [int(str(row)) for row in drawn]


def test_given_concentrations_are_in_the_metadata(spark, planted):
    fitted = topics.train(planted, 2, PLANTED.with_(passes=2), alpha=[0.2, 0.7], eta=0.3, with_coherence=False)
    assert fitted.metadata.alpha == pytest.approx([0.2, 0.7]) and fitted.metadata.eta == 0.3
    row = topics.summary(fitted, spark).first()
    assert row["prior"] == "given" and row["alpha"] == pytest.approx([0.2, 0.7])


def test_best_match_is_the_best_permutation():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 6)):
        for _ in range(20):
            weight = rng.integers(0, 6, size=(n, m)).astype(float)
            match = alignment.best_match(weight)
            assert len(set(match)) == n
            best = max(sum(weight[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n))
            assert sum(weight[i, c] for i, c in enumerate(match)) == best
    assert alignment.best_match(np.zeros((0, 0))) == []


def test_topics_beyond_the_groups_have_none(spark):
    phi = spark.createDataFrame([(0, "x", 0.9), (0, "y", 0.1), (1, "y", 1.0), (2, "x", 0.2)], "topic_id int, term string, weight double")
    groups = spark.createDataFrame([("x", 7), ("y", 5)], "term string, group_id int")
    assert alignment.align(phi, groups) == {0: 7, 1: 5}
    rows = spark.range(4).select(alignment.renamed(F.col("id"), {0: 7, 1: 5}).alias("g")).collect()
    assert [r["g"] for r in rows] == [7, 5, None, None]


def test_coherence_tells_mixed_topics(planted, model):
    pure = [(i, w) for i, w in model.top_words(10)]
    mixed = [(i, [pure[(i + j) % 4][1][j] for j in range(10)]) for i in range(4)]

    def score(words):
        counts = materialize(coherence.window_counts(planted, words), "w")
        return coherence.model_coherence(coherence.topic_coherence(counts, 10)).first()[0]

    assert score(pure) > score(mixed)


# -- stores -------------------------------------------------------------------


def test_csv_keeps_quotes_and_line_ends(spark):
    rows = [("1", 'say "a, b"\nnext', None, " x "), ("2", "", "y", "\\")]
    df = spark.createDataFrame(rows, "identifier string, title string, abstract string, authors string")
    path = scratch_path(spark, "test-csv")
    tables.write_csv(df, path)
    back = sorted(tuple(r) for r in tables.read_csv(spark, path, df.schema).collect())
    assert back == [("1", 'say "a, b"\nnext', None, " x "), ("2", None, "y", "\\")]


def test_theta_store_or_corpus(spark, planted, model):
    path = scratch_path(spark, "theta-test")
    tables.write_store(planted.withColumn("lang", F.lit("en")), path + "-corpus")
    called = []

    def fitted():
        called.append(1)
        return model

    inferred = tables.read_theta(spark, path, path + "-corpus", fitted)
    assert inferred.columns == ["doc_id", "lang", *(f"topic_{k}" for k in range(4)), "dominant_topic", "dominant_topic_prob"]
    rows = {r["doc_id"]: r for r in inferred.collect()}
    for r in model.theta(planted).collect():
        assert [rows[r["doc_id"]][f"topic_{k}"] for k in range(4)] == r["probs"]
    tables.write_store(inferred, path)
    again = tables.read_theta(spark, path, path + "-gone", fitted)
    assert len(called) == 1 and {r["doc_id"]: r for r in again.collect()} == rows


def test_label_file(spark):
    path = scratch_path(spark, "test-labels")
    assert tables.read_labels(spark, path).count() == 0 and not tables.has_labels(spark, path)
    tables.set_label(spark, path, 3, "finance")
    tables.set_label(spark, path, 1, "law")
    tables.set_label(spark, path, 3, "banking")
    assert {tuple(r) for r in tables.read_labels(spark, path).collect()} == {(1, "law"), (3, "banking")}
    tables.reset_labels(spark, path)
    assert not tables.has_labels(spark, path)


def test_preprocessor_survives_storage(spark):
    prep = Preprocessor(Settings().with_(min_doc_length=2, bigram_min_count=1, phrase_threshold=0.1), ["the"])
    df = spark.createDataFrame([(i, "the harga saham naik harga saham") for i in range(9)], "doc_id long, text string")
    want = prep.fit_transform(df).collect()
    path = scratch_path(spark, "test-prep")
    tables.save_preprocessor(prep, spark, path)
    again = tables.load_preprocessor(spark, path)
    assert again.settings == prep.settings
    assert {r["doc_id"]: r["tokens"] for r in want} == {
        r["doc_id"]: r["tokens"] for r in again.transform(df).collect()
    }


# -- streams ------------------------------------------------------------------




def test_first_arrival_over_several_batches(spark):
    def frame(rows):
        return spark.createDataFrame(rows, "identifier string, n int, t string").select(
            "identifier", "n", F.to_timestamp("t").alias("ts")
        )

    first = frame([("a", 1, "2024-01-01 00:00:00"), ("b", 1, "2024-01-01 00:00:01"), ("a", 1, "2024-01-01 00:00:02")])
    later = frame([("a", 2, "2024-01-01 01:00:00"), ("c", 2, "2024-01-01 01:00:00")])
    path = scratch_path(spark, "test-stream")
    state, out = scratch_path(spark, "state"), scratch_path(spark, "out")
    schema = first.schema
    for frame in (first, later):
        frame.coalesce(1).write.mode("append").parquet(path)
        stream = flows.read_new_files(spark, path, schema)
        flows.run_available(flows.first_arrivals(stream), out, state)
    rows = spark.read.schema(schema).parquet(out).collect()
    assert sorted((r["identifier"], r["n"]) for r in rows) == [("a", 1), ("b", 1), ("c", 2)]


def test_state_of_first_arrivals_expires(spark):
    """A key that comes again after the delay is a first arrival again; in between it is dropped."""
    path, state, out = (scratch_path(spark, n) for n in ("arrivals", "state", "out"))
    times = ["2024-01-01 00:00", "2024-01-01 20:00", "2024-01-03 00:00", "2024-01-03 01:00", "2024-01-07 00:00", "2024-01-09 00:00"]
    schema = None
    for i, t in enumerate(times):
        rows = [("aabaca"[i], i, t + ":00")]
        frame = spark.createDataFrame(rows, "identifier string, n int, t string").select("identifier", "n", F.to_timestamp("t").alias("ts"))
        schema = frame.schema
        frame.coalesce(1).write.mode("append").parquet(path)
        flows.run_available(flows.first_arrivals(flows.read_new_files(spark, path, schema)), out, state)
    rows = spark.read.schema(schema).parquet(out).collect()
    assert sorted((r["identifier"], r["n"]) for r in rows) == [("a", 0), ("a", 3), ("a", 5), ("b", 2), ("c", 4)]


def test_open_windows_are_in_the_result(spark):
    path, state, out = (scratch_path(spark, n) for n in ("open", "state", "out"))
    for rows in ([("x", 1.0, "2024-01-01 05:00:00")], [("x", 3.0, "2024-01-01 06:00:00"), ("y", 8.0, "2024-01-02 06:00:00")]):
        frame = spark.createDataFrame(rows, "k string, value double, t string").select("k", "value", F.to_timestamp("t").alias("ts"))
        frame.coalesce(1).write.mode("append").parquet(path)
        stream = flows.read_new_files(spark, path, frame.schema)
        flows.run_updates(flows.windowed_means(stream, ["k"], "value"), out, state)
    rows = flows.latest_rows(spark, out, ["window_start", "k"]).collect()
    assert sorted((r["window_start"].day, r["k"], r["n"], r["mean_value"]) for r in rows) == [(1, "x", 2, 2.0), (2, "y", 1, 8.0)]


def test_late_rows_are_dropped(spark):
    def frame(rows):
        return spark.createDataFrame(rows, "k string, value double, t string").select(
            "k", "value", F.to_timestamp("t").alias("ts")
        )

    path, state, out = (scratch_path(spark, n) for n in ("late", "state", "out"))
    steps = [
        [("x", 1.0, "2024-01-01 05:00:00"), ("x", 3.0, "2024-01-01 06:00:00")],
        [("x", 9.0, "2024-01-03 00:00:00")],
        [("x", 100.0, "2024-01-01 07:00:00"), ("x", 9.0, "2024-01-05 00:00:00")],
    ]
    for rows in steps:
        frame(rows).coalesce(1).write.mode("append").parquet(path)
        stream = flows.read_new_files(spark, path, frame(rows).schema)
        trend = flows.windowed_means(stream, ["k"], "value")
        flows.run_available(trend, out, state)
    rows = spark.read.schema(trend.schema).parquet(out).orderBy("window_start").collect()
    assert [(r["window_start"].day, r["n"], r["mean_value"]) for r in rows] == [(1, 2, 2.0), (3, 1, 9.0)]
