"""Operators against brute force on small fixtures."""

import math
import random
from collections import Counter
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from corpusmill import fixed_values as fixed, runtime
from corpusmill.operators import analysis, cleaning, dedup, phrases, preprocess, profile, quantiles, topic_words, vocabulary
from corpusmill.operators.preprocess import Preprocessor
from corpusmill.runtime import materialize, scratch_root, small_side, spread
from corpusmill.settings import Settings


def docs_of(spark, lists, partitions=3):
    rows = [(i, tokens) for i, tokens in enumerate(lists)]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(partitions)


def records_of(spark, rows):
    names = fixed.RAW_COLUMNS
    full = [(i, *[r.get(c) for c in names]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "ord long, " + ", ".join(f"{c} string" for c in names))


# -- deduplication ------------------------------------------------------------


def brute_force_stages(rows):
    """Ids that survive each stage, first one kept."""
    keys = [
        lambda r: tuple(r.get(c) for c in fixed.RAW_COLUMNS),
        lambda r: r.get("identifier"), lambda r: r.get("title"), lambda r: r.get("abstract"),
    ]
    kept, out = list(enumerate(rows)), []
    for key in keys:
        seen, left = set(), []
        for i, r in kept:
            if key(r) not in seen:
                seen.add(key(r))
                left.append((i, r))
        kept = left
        out.append([i for i, _ in kept])
    return out


def test_staged_dedup_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        hot = rng.random() < 0.35
        rows.append(
            {
                "identifier": f"id{rng.randrange(300)}",
                "title": "same" if hot else rng.choice([None, "", f"t{rng.randrange(80)}"]),
                "abstract": rng.choice([None, f"a{rng.randrange(60)}", "word " * 25]),
                "date": rng.choice([None, "2015"]),
            }
        )
    rows += rows[:50]
    stages = brute_force_stages(rows)
    df = records_of(spark, rows).repartition(5)
    for n, want in enumerate(stages, 1):
        got = dedup.keep_first(df, stages=dedup.STAGES[:n]).select("ord").collect()
        assert sorted(r[0] for r in got) == want
    ledger = [r["rows_left"] for r in cleaning.cleaning_ledger(df).orderBy("step").collect()]
    assert ledger[:5] == [len(rows), *map(len, stages)]
    assert ledger[-1] == cleaning.clean_records(df).count()
    assert ledger == sorted(ledger, reverse=True)


def test_missing_titles_collapse_to_one(spark):
    df = records_of(spark, [{"identifier": str(i), "title": t, "abstract": str(i)} for i, t in enumerate([None, None, "a", "a"])])
    kept = dedup.keep_first(df, stages=("row", "identifier", "title")).select("ord").collect()
    assert sorted(r[0] for r in kept) == [0, 2]


def test_corpus_ledger(spark):
    """The published stage counts of the adapter view at this scale."""
    from corpusmill.plans import fixtures as fx

    ledger = cleaning.cleaning_ledger(fx.corpus(spark, "/root/testdata/sf0.01"))
    left = [r["rows_left"] for r in ledger.orderBy("step").collect()]
    assert left == [1065, 1025, 1000, 670, 654, 652, 652, 635]


# -- phrases ------------------------------------------------------------------


def test_phrase_scores(spark):
    lists = [x.split() for x in ("harga saham naik", "harga saham turun", "harga saham harga saham", "saham naik")]
    pairs = materialize(phrases.count_pairs(docs_of(spark, lists)), "test")
    singles = materialize(phrases.count_singles(pairs), "test")
    assert {r["w1"]: r["n"] for r in singles.collect()} == {"saham": 5, "harga": 4, "naik": 2, "turun": 1}
    scored = {(r["w1"], r["w2"]): r["score"] for r in phrases.score_pairs(pairs, singles, 1).collect()}
    assert scored[("harga", "saham")] == pytest.approx(1.2)
    assert scored[("saham", "naik")] == pytest.approx(0.8)
    docs = docs_of(spark, lists)
    kept = lambda t: [(r["w1"], r["w2"]) for r in phrases.fit_phrases(docs, min_count=1, threshold=t).collect()]
    assert kept(1.0) == [("harga", "saham")]
    assert kept(1.2) == []


def greedy(tokens, pairs):
    out, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) in pairs:
            out.append(tokens[i] + "_" + tokens[i + 1])
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_phrase_merge_is_the_greedy_scan(spark, partitions):
    rng = random.Random(11)
    lists = [[rng.choice("abcd") for _ in range(rng.randrange(0, 40))] for _ in range(150)]
    lists += ["a b c d x".split(), [], ["a"], ["a", "b"], ["a"] * 9]
    pairs = {("a", "b"), ("b", "c"), ("c", "d"), ("a", "a")}
    table = spark.createDataFrame(sorted(pairs), "w1 string, w2 string")
    out = phrases.apply_phrases(docs_of(spark, lists, partitions), table).collect()
    assert len(out) == len(lists)
    for row in out:
        assert row["tokens"] == greedy(lists[row["doc_id"]], pairs)
        split = [w for t in row["tokens"] for w in t.split("_")]
        assert split == lists[row["doc_id"]]


# -- dictionary ---------------------------------------------------------------


def test_term_runs_and_dictionary(spark):
    rng = random.Random(5)
    lists = [[rng.choice("abcdefgh") for _ in range(rng.randrange(0, 12))] for _ in range(60)]
    docs = docs_of(spark, lists)
    got = {r["term"]: (r["df"], r["cf"]) for r in vocabulary.document_frequencies(docs).collect()}
    df = Counter(t for x in lists for t in set(x))
    cf = Counter(t for x in lists for t in x)
    assert got == {t: (df[t], cf[t]) for t in cf}
    small = Settings().with_(no_below=20, no_above=0.6, keep_n=3)
    kept = vocabulary.build_dictionary(docs, settings=small).orderBy("term_id").collect()
    allowed = [t for t in df if 20 <= df[t] <= int(0.6 * len(lists))]
    want = sorted(sorted(allowed, key=lambda t: (-df[t], t))[:3])
    assert [r["term"] for r in kept] == want and [r["term_id"] for r in kept] == list(range(len(want)))
    bow = vocabulary.bag_of_words(docs, materialize(vocabulary.build_dictionary(docs, settings=small), "d"))
    assert {(r["doc_id"], want[r["term_id"]]): r["n"] for r in bow.collect()} == {
        (i, t): n for i, x in enumerate(lists) for t, n in Counter(x).items() if t in want
    }


def test_terms_are_counted_per_group_without_sorting_a_row(spark):
    lists = [["b", "a", "b"], [], ["a"], None, ["c", "c", "c", "a"]]
    docs = docs_of(spark, lists).withColumn("topic", F.when(F.col("doc_id") != 2, F.col("doc_id") % 2))
    rows = vocabulary.occurrences(docs, keep=["topic"])
    assert "sort_array" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = rows.groupBy("term", "topic").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [("a", 0, 2, 2), ("a", None, 1, 1), ("b", 0, 1, 2), ("c", 0, 1, 3)], key=str
    )


def test_sizes_of_vectors_do_not_need_a_number_for_every_term(spark):
    """A dictionary of 2,000 million terms: dense, a vector would take 16 GB."""
    size = 2_000_000_000
    rows = [(1, Vectors.sparse(size, {3: 2.0, size - 1: 5.0})), (2, Vectors.sparse(size, {})), (3, Vectors.dense(0.0, 4.0))]
    got = vocabulary.sizes_of_vectors(spark.createDataFrame(rows, ["doc_id", "features"]))
    assert sorted(map(tuple, got.collect())) == [(1, 2, 7), (2, 0, 0), (3, 1, 4)]


# -- preprocessing ------------------------------------------------------------


def test_tokens_are_made_once(spark):
    """A filter on their number, moved below them, would make them again."""
    words = ["alpha beta", "Alpha beta2 <b>gamma</b> delta", "", None, "one two three four"]
    df = spark.createDataFrame([(i, w, "old") for i, w in enumerate(words)], "doc_id long, text string, tokens string")
    found = Preprocessor(Settings().with_(min_doc_length=3), []).tokenize(df)
    assert found.columns == df.columns
    assert found._jdf.queryExecution().optimizedPlan().toString().count("[^a-z]+") == 1
    assert {r["doc_id"]: r["tokens"] for r in found.collect()} == {
        1: ["alpha", "beta", "gamma", "delta"], 4: ["one", "two", "three", "four"]
    }


def test_length_is_checked_before_merging(spark):
    text_of = "alpha beta " * 15 + "gamma"
    df = spark.createDataFrame([(i, text_of) for i in range(40)] + [(99, "too short")], "doc_id long, text string")
    prep = Preprocessor(Settings().with_(phrase_threshold=0.0), ["gamma"])
    out = prep.fit_transform(df).collect()
    assert len(out) == 40
    assert all(r["token_count"] < 30 for r in out) and out[0]["tokens"][0] == "alpha_beta"


def test_failing_rule_keeps_the_token(spark):
    def rule(token):
        if token == "bad":
            raise ValueError
        return token.upper()

    docs = docs_of(spark, [["bad", "good", "good"], []])
    out = docs.select("doc_id", preprocess.normalise_tokens(F.col("tokens"), rule).alias("t")).collect()
    assert {r["doc_id"]: list(r["t"]) for r in out} == {0: ["bad", "GOOD", "GOOD"], 1: []}


def test_stopword_list():
    words = preprocess.stopword_list(custom=["xyz"], english=False)
    assert "xyz" in words and "yang" in words and len(words) == len(set(words))


# -- profiles -----------------------------------------------------------------


def test_describe_of_known_numbers(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "x int")
    row = profile.describe(df, {"x": F.col("x")}).first()
    assert (row["q25"], row["median"], row["q75"]) == (1.75, 2.5, 3.25)
    assert row["std"] == pytest.approx(1.290994, abs=1e-6)


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(5,)] * 7, "x int")
    bins = {r["bin"]: (r["lower"], r["n"]) for r in profile.histogram(df, F.col("x"), 4).collect()}
    assert sum(n for _, n in bins.values()) == 7 and bins[0][0] == 4.5 and bins[2][1] == 7


def test_all_unique_findings(spark):
    df = records_of(spark, [{"identifier": "1", "title": "a", "abstract": "w " * 30, "date": "2015", "authors": "x"}])
    assert profile.quality_findings(df).count() == 0


# -- theta and phi ------------------------------------------------------------


def theta_of(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, probs array<double>")


def test_trend_keeps_the_empty_year(spark):
    theta = theta_of(spark, [[0.2, 0.8], [0.6, 0.4]])
    docs = spark.createDataFrame([(0, datetime(2010, 5, 1)), (1, datetime(2012, 3, 1))], "doc_id long, d timestamp")
    out = analysis.topic_trends(theta, docs, F.col("d")).where("topic_id = 0").orderBy("period").collect()
    assert [(r["period"].year, r["value"]) for r in out] == [(2010, 0.2), (2011, None), (2012, 0.6)]


def test_similarity_arguments(spark):
    theta = theta_of(spark, [[0.5, 0.5], [0.1, 0.9], [0.5, 0.5]])
    out = analysis.similar_documents(theta, 0, 5).collect()
    assert [r["doc_id"] for r in out] == [2, 1] and out[0]["similarity"] == pytest.approx(1)
    with pytest.raises(ValueError):
        analysis.similar_documents(theta, 0, 5, "euclid")
    with pytest.raises(ValueError):
        analysis.similar_documents(theta, 77)


def test_sort_and_page_arguments(spark):
    df = spark.createDataFrame([(i, f"t{9 - i}") for i in range(10)], "doc_id long, title string")
    assert [r["doc_id"] for r in analysis.sort_by(df, "title").collect()][:2] == [9, 8]
    assert [r["doc_id"] for r in analysis.page(df, 1, 4).collect()] == [4, 5, 6, 7]
    with pytest.raises(ValueError):
        analysis.sort_by(df, "text; drop")


def test_distances_and_overlap_are_symmetric(spark):
    rows = [(0, "a", 0.7), (0, "b", 0.3), (1, "b", 0.5), (1, "c", 0.5), (2, "a", 0.7), (2, "b", 0.3)]
    phi = spark.createDataFrame(rows, "topic_id int, term string, weight double")
    d = {(r["topic_a"], r["topic_b"]): r["distance"] for r in topic_words.topic_distances(phi).collect()}
    assert len(d) == 9 and d[(0, 2)] == pytest.approx(0, abs=1e-9) and d[(1, 1)] == 0
    assert all(d[(a, b)] == d[(b, a)] for a, b in d)
    over = {(r["topic_a"], r["topic_b"]): r for r in topic_words.topic_overlap(phi, 2).collect()}
    assert over[(0, 1)]["jaccard_similarity"] == pytest.approx(1 / 3)
    assert over[(0, 1)]["shared_words"] == ["b"] and over[(0, 2)]["jaccard_similarity"] == 1


# -- runtime ------------------------------------------------------------------


def test_scratch_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert scratch_root(spark) == named.rstrip("/")
    assert scratch_root(spark) == scratch_root(spark)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_small_side_checks_the_size(spark):
    few = materialize(spark.range(10), "few")
    other = spark.range(1000).withColumnRenamed("id", "k")
    assert "strategy=broadcast" in plan_of(other.join(small_side(few, 10), F.col("k") == F.col("id")))
    assert "strategy=merge" in plan_of(other.join(small_side(few, 9), F.col("k") == F.col("id")))


@pytest.mark.parametrize("scan_bytes", [1 << 20, 60, 1])
def test_merge_gives_the_same_with_any_number_of_scans(spark, monkeypatch, scan_bytes):
    monkeypatch.setattr(phrases, "SCAN_BYTES", scan_bytes)
    rng = random.Random(12)
    lists = [[rng.choice("abcde") for _ in range(rng.randrange(0, 30))] for _ in range(60)] + [list("ababcab")] * 20
    pairs = {("a", "b"), ("b", "c"), ("e", "e"), ("d", "a"), ("c", "never")}
    table = materialize(spark.createDataFrame(sorted(pairs), "w1 string, w2 string"), "phrases")
    docs = docs_of(spark, lists, 5).withColumn("_hits", F.lit(3))
    out = phrases.apply_phrases(docs, table)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["tokens"] for r in out.collect()} == {i: greedy(x, pairs) for i, x in enumerate(lists)}
    starts = {}
    for r in phrases.merge_starts(docs, table).collect():
        starts.setdefault(r["doc_id"], []).append(r["pos"])
    for i, tokens in enumerate(lists):
        assert len(tokens) - len(starts.get(i, [])) == len(greedy(tokens, pairs))


def test_merging_needs_no_shuffle_window_or_join(spark):
    table = materialize(spark.createDataFrame([("a", "b")], "w1 string, w2 string"), "phrases")
    stored = materialize(docs_of(spark, [list("abc")] * 9), "docs")
    plan = plan_of(phrases.apply_phrases(stored, table)).split("== Physical Plan ==")[1]
    assert not any(word in plan for word in ("Exchange", "Window", "Join", "Aggregate"))


def test_a_pair_that_fills_nine_tenths_of_all_places(spark):
    lists = [["hot", "pair"] * 4500 + ["x"] * 1000 for _ in range(30)]
    df = docs_of(spark, lists, 6)
    pairs = {("hot", "pair")}
    table = materialize(spark.createDataFrame(sorted(pairs), "w1 string, w2 string"), "phrases")
    for row in phrases.apply_phrases(df, table).collect():
        assert row["tokens"] == greedy(lists[0], pairs)


def test_null_lists_and_tokens_are_kept(spark):
    rows = [(0, None), (1, ["a", None, "b", "a", "b"]), (2, []), (3, ["b"]), (4, ["a"])]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>").coalesce(1)
    table = spark.createDataFrame([("a", "b"), ("b", "a")], "w1 string, w2 string")
    out = {r["doc_id"]: r["tokens"] for r in phrases.apply_phrases(docs, table).collect()}
    assert out == {0: None, 1: ["a", None, "b_a", "b"], 2: [], 3: ["b"], 4: ["a"]}
    none = spark.createDataFrame([], "w1 string, w2 string")
    assert {r["doc_id"]: r["tokens"] for r in phrases.apply_phrases(docs, none).collect()} == dict(rows)


def test_scores_are_the_same_with_spread_keys(spark, monkeypatch):
    rng = random.Random(13)
    lists = [["the", rng.choice("abcdefgh"), "of", rng.choice("abc")] for _ in range(300)]
    pairs = materialize(phrases.count_pairs(docs_of(spark, lists)), "test")
    singles = materialize(phrases.count_singles(pairs), "test")
    want = sorted(map(tuple, phrases.score_pairs(pairs, singles, 2).collect()))
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    scored = phrases.score_pairs(pairs, singles, 2)
    assert "_salt" in plan_of(scored) and "strategy=broadcast" not in plan_of(scored)
    assert sorted(map(tuple, scored.collect())) == want


def test_large_inputs_are_not_spread(spark):
    assert "REPARTITION" in plan_of(spread(spark.range(0, 100, 1, 2), "id"))
    assert "REPARTITION" not in plan_of(spread(spark.range(0, 100, 1, 64), "id"))


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'")
    plan = plan_of(profile.value_counts(df, "source"))
    assert "ReadSchema: struct<lang:string,source:string>" in plan and "EqualTo(lang,en)" in plan


# -- plans that stay small ------------------------------------------------------


def test_quantiles_of_distinct_real_values(spark):
    rng = random.Random(21)
    values = [rng.gauss(0, 1e6) for _ in range(20_000)]
    rows = [(v, float(i % 7), None if i % 3 else v / 7) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(9)
    measures = {c: F.col(c) for c in "abc"} | {"none": F.lit(None).cast("double")}
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r["measure"], r["q"]): r["value"] for r in quantiles.quantiles(df, measures, probabilities).collect()}
    for c in "abc":
        want = df.select(F.percentile(c, probabilities)).first()[0]
        assert [got[c, q] for q in probabilities] == want
    assert not any(m == "none" for m, _ in got)


def test_describe_equals_the_plain_aggregates(spark):
    rng = random.Random(22)
    df = spark.createDataFrame([(rng.uniform(-5, 1000),) for _ in range(500)] + [(None,)], "x double")
    rows = {r["measure"]: r for r in profile.describe(df, {"x": F.col("x"), "none": F.lit(None).cast("int"), "one": F.lit(3)}).collect()}
    want = df.agg(F.count("x"), F.avg("x"), F.stddev_samp("x"), F.min("x"), *[F.percentile("x", q) for q in (0.25, 0.5, 0.75)], F.max("x")).first()
    assert list(rows["x"])[1:] == pytest.approx(list(want))
    assert list(rows["none"])[1:] == [0] + [None] * 7
    assert rows["one"]["std"] == 0 and rows["one"]["median"] == 3 and rows["one"]["n"] == 501
    assert profile.medians(df, {"x": F.col("x")}).first()["x"] == pytest.approx(want[5])
    assert profile.medians(df.limit(0), {"x": F.col("x")}).first()["x"] is None


def test_repeats_name_the_first_of_many_ties(spark):
    rows = [(i, f"v{i % 40}" if i % 3 else "hot") for i in range(200)] + [(900, None), (901, None), (902, "once")]
    df = spark.createDataFrame(rows, "ord long, x string").repartition(6)
    got = [tuple(r) for r in dedup.most_repeated(df, "x", 5).collect()]
    counts = {}
    for i, v in rows:
        if v is not None:
            n, first = counts.get(v, (0, i))
            counts[v] = (n + 1, min(first, i))
    want = sorted(((v, n, f) for v, (n, f) in counts.items() if n > 1), key=lambda x: (-x[1], x[2]))[:5]
    assert got == [(v, n) for v, n, _ in want]
    assert dedup.most_repeated(df.where("ord > 800"), "x").count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_pages_by_cursor_are_the_whole_order(spark, descending):
    rng = random.Random(23)
    rows = [(i, rng.choice(["a", "b", "c", None])) for i in range(53)]
    df = materialize(spark.createDataFrame(rows, "doc_id long, title string").repartition(4), "pages")
    got, after = [], None
    while after is not None or not got:
        page = analysis.page_after(df, after, 10, "title", "doc_id", descending)
        got += [tuple(r) for r in page.collect()]
        after = analysis.cursor(page, "title")
    assert got == [tuple(r) for r in analysis.sort_by(df, "title", "doc_id", descending).collect()]


def test_a_deep_page_has_the_plan_of_the_first(spark):
    df = materialize(spark.range(0, 20_000, 1, 4).withColumnRenamed("id", "doc_id"), "pages")
    first, deep = analysis.page_after(df, None, 10), analysis.page_after(df, (9_999, 9_999), 10)
    assert [r[0] for r in deep.collect()] == list(range(10_000, 10_010))
    physical = lambda d: plan_of(d).split("== Physical Plan ==")[1]
    assert "TakeOrderedAndProject" in physical(first) and "TakeOrderedAndProject" in physical(deep)
    assert "GreaterThan(doc_id,9999)" in physical(deep) and "Exchange" not in physical(deep)
    with pytest.raises(ValueError):
        analysis.page(df, 2_000, 10)


def test_distances_of_a_hundred_topics(spark):
    rng = random.Random(24)
    weights = {}
    for t in range(100):
        raw = {f"w{i}": rng.random() for i in range(30) if (i + t) % 4}
        weights[t] = {w: x / sum(raw.values()) for w, x in raw.items()}
    phi = spark.createDataFrame([(t, w, x) for t, ws in weights.items() for w, x in ws.items()], "topic_id int, term string, weight double")
    got = {(r["topic_a"], r["topic_b"]): r["distance"] for r in topic_words.topic_distances(phi).collect()}
    assert len(got) == 100 * 100

    def distance(a, b):
        half = lambda x, y: x * math.log(2 * x / (x + y)) if x else 0.0
        total = sum(half(a.get(w, 0), b.get(w, 0)) + half(b.get(w, 0), a.get(w, 0)) for w in {*a, *b})
        return math.sqrt(max(total / 2, 0))

    for a, b in [(0, 0), (0, 1), (7, 93), (93, 7), (99, 50)]:
        assert got[a, b] == pytest.approx(distance(weights[a], weights[b]), abs=1e-9)


def test_column_types_counts_values(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, `b.c` string")
    assert [tuple(r) for r in profile.column_types(df).collect()] == [(0, "a", "int", 2), (1, "b.c", "string", 1)]


@pytest.mark.parametrize("numbered", [0, 5, 500_000])
def test_rare_pairs_are_counted_but_not_stored(spark, monkeypatch, numbered):
    """The phrases are those of all pairs, null tokens and null lists included, however many words are numbered."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    lists = [rng.choices([*words, None], [*[1 / (i + 1) for i in range(200)], 0.05], k=rng.randint(0, 60)) for _ in range(400)]
    docs = docs_of(spark, lists).unionByName(spark.createDataFrame([(-1, None)], "doc_id long, tokens array<string>"))
    pairs = materialize(phrases.count_pairs(docs), "test")
    singles = materialize(phrases.count_singles(pairs), "test")
    want = sorted(map(tuple, phrases.score_pairs(pairs, singles, 3).where("score > 0.5").collect()))
    stored = []
    monkeypatch.setattr(phrases, "materialize", lambda df, label: stored.append(materialize(df, label)) or stored[-1])
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", numbered)
    assert sorted(map(tuple, phrases.fit_phrases(docs, min_count=3, threshold=0.5).collect())) == want and len(want) > 20
    frequent = pairs.where("n > 3 and w1 is not null and w2 is not null").count()
    assert pairs.count() > 2 * frequent
    assert max(t.count() for t in stored) <= max(frequent + 1, singles.count())


def test_merging_takes_rows_in_slices(monkeypatch):
    """Memory does not follow the rows of a batch; null, empty and long rows come back."""
    monkeypatch.setattr(phrases, "SLICE_TOKENS", 10)
    rows = [["a"] * 4, None, ["b"] * 25, [], *[["c", "d"]] * 20]
    seen = []

    def work(tokens):
        seen.append(len(tokens.flatten()))
        return phrases._merged(tokens, np.zeros(0, np.int64))

    assert phrases._by_rows(pa.array(rows, pa.list_(pa.string())), work).to_pylist() == rows
    assert sorted(seen)[-1] == 25 and sorted(seen)[-2] <= 10
    assert phrases._by_rows(pa.array([], pa.list_(pa.string())), work).to_pylist() == []
