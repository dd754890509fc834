"""Questions over the topic-word weights phi (topic_id, term, weight).

phi holds at most topics x dictionary size rows, whatever the corpus size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.functions import labels
from corpusmill.functions.vectors import js_term


def top_words(phi: DataFrame, n: int = 10) -> DataFrame:
    """The n heaviest words of every topic, ranked from 1."""
    by_weight = Window.partitionBy("topic_id").orderBy(F.desc("weight"), "term")
    return (
        phi.withColumn("rank", F.row_number().over(by_weight))
        .where(F.col("rank") <= n)
        .select("topic_id", "rank", "term", "weight")
    )


def words_of_topic(phi: DataFrame, topic_id: int, n: int = 10) -> DataFrame:
    return (
        phi.where(F.col("topic_id") == topic_id)
        .orderBy(F.desc("weight"), "term")
        .limit(n)
        .select("term", "weight")
    )


def topic_info(phi: DataFrame, n: int = 20, label_words: int = 3) -> DataFrame:
    """One row per topic: words with weights, top words and an automatic label."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", "term", "weight")))
    grouped = top_words(phi, n).groupBy("topic_id").agg(ranked.alias("r"))
    words = F.transform("r", lambda x: F.struct(x["term"].alias("word"), x["weight"].alias("weight")))
    names = F.transform("r", lambda x: x["term"])
    return grouped.select(
        "topic_id",
        words.alias("words"),
        labels.auto_label(F.col("topic_id"), names, label_words).alias("label"),
        names.alias("top_words"),
    )


def labels_with_defaults(info: DataFrame, custom: DataFrame) -> DataFrame:
    """Custom label where there is one, else the first three words of the topic.

    Both sides have one row per topic.
    """
    return info.join(F.broadcast(custom.select("topic_id", F.col("label").alias("own"))), "topic_id", "left").select(
        "topic_id",
        F.coalesce("own", labels.first_words(F.col("top_words"), 3)).alias("label"),
    )


def _pairs_of_topics(rows: DataFrame, value: str) -> DataFrame:
    """(a, b, x, y) for topics a < b; one row per topic on both sides."""
    left = rows.select(F.col("topic_id").alias("topic_a"), F.col(value).alias("x"))
    right = rows.select(F.col("topic_id").alias("topic_b"), F.col(value).alias("y"))
    return left.join(F.broadcast(right), F.col("topic_a") < F.col("topic_b"))


def topic_overlap(phi: DataFrame, n: int = 20) -> DataFrame:
    """Shared and own words of every pair of topics among their top n, with Jaccard."""
    words = topic_info(phi, n).select("topic_id", F.array_sort("top_words").alias("words"))
    shared = F.array_intersect("x", "y")
    union = F.array_union("x", "y")
    return _pairs_of_topics(words, "words").select(
        "topic_a",
        "topic_b",
        F.col("x").alias("words_a"),
        F.col("y").alias("words_b"),
        shared.alias("shared_words"),
        F.array_except("x", "y").alias("unique_to_a"),
        F.array_except("y", "x").alias("unique_to_b"),
        F.coalesce(F.size(shared) / F.nullif(F.size(union), F.lit(0)), F.lit(0.0)).alias(
            "jaccard_similarity"
        ),
    )


def compare_topics(phi: DataFrame, topic_a: int, topic_b: int, n: int = 10) -> DataFrame:
    """Top words of two topics side by side, rank by rank."""
    ranked = top_words(phi.where(F.col("topic_id").isin(topic_a, topic_b)), n)

    def side(topic: int, name: str) -> list[Column]:
        own = F.col("topic_id") == topic
        return [
            F.max(F.when(own, F.col("term"))).alias(f"word_{name}"),
            F.max(F.when(own, F.col("weight"))).alias(f"weight_{name}"),
        ]

    return ranked.groupBy("rank").agg(*side(topic_a, "a"), *side(topic_b, "b"))


def topic_distances(phi: DataFrame) -> DataFrame:
    """Jensen-Shannon distance of all pairs of topics, both ways, zero to itself.

    One shuffle brings the weights of a term together as one array. The pairs are made
    from it inside the row, and their shares are summed on the map side, so K(K-1)/2
    numbers per task are shuffled. Weights must sum to 1 per topic; a term that a topic lacks counts
    as weight 0, so pairs that both lack it add nothing.
    """
    topics = sorted(r["topic_id"] for r in phi.select("topic_id").distinct().collect())
    place = F.create_map(*[F.lit(x) for i, t in enumerate(topics) for x in (t, i)])
    entries = F.collect_list(F.struct(place[F.col("topic_id")].alias("i"), F.col("weight").alias("w")))
    weights = phi.groupBy("term").agg(F.map_from_entries(entries).alias("w"))
    dense = weights.select(F.transform(F.sequence(F.lit(0), F.lit(len(topics) - 1)), lambda i: F.coalesce(F.try_element_at("w", i), F.lit(0.0))).alias("w"))
    later = lambda i: F.slice("w", i + 2, F.lit(len(topics)))
    pairs = F.flatten(
        F.transform("w", lambda x, i: F.transform(later(i), lambda y, j: F.struct(i.alias("a"), (i + 1 + j).alias("b"), js_term(x, y).alias("share"))))
    )
    shares = dense.select(F.inline(pairs)).where("share <> 0").groupBy("a", "b").agg(F.sum("share").alias("share"))
    # topics x topics rows from here on
    spark, count = phi.sparkSession, len(topics)
    every = spark.createDataFrame([(a, b) for a in range(count) for b in range(a, count)], "a int, b int")
    distance = F.sqrt(F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(0.0)))
    named = F.array(*[F.lit(t) for t in topics])
    both = every.join(F.broadcast(shares), ["a", "b"], "left").select(
        F.get(named, F.col("a")).alias("x"), F.get(named, F.col("b")).alias("y"), distance.alias("distance")
    )
    ways = F.array_distinct(F.array(F.struct(F.col("x").alias("topic_a"), F.col("y").alias("topic_b")), F.struct(F.col("y").alias("topic_a"), F.col("x").alias("topic_b"))))
    return both.select(F.inline(ways), "distance")


def term_relevance(
    phi: DataFrame, shares: DataFrame, n: int = 30, weight_of_probability: float = 0.6
) -> DataFrame:
    """The n most relevant terms of each topic.

    `shares` (topic_id, share) gives each topic's part of all tokens; the marginal
    p(w) is the share-weighted mean of phi.
    """
    lam = weight_of_probability
    joined = _with_marginal(phi, shares)
    relevance = lam * F.ln("weight") + (1 - lam) * F.ln(F.col("weight") / F.col("p_term"))
    by_relevance = Window.partitionBy("topic_id").orderBy(F.desc("relevance"), "term")
    return (
        joined.where("weight > 0")
        .withColumn("relevance", relevance)
        .withColumn("rank", F.row_number().over(by_relevance))
        .where(F.col("rank") <= n)
        .select("topic_id", "rank", "term", "weight", "p_term", "relevance")
    )


def term_saliency(phi: DataFrame, shares: DataFrame, n: int = 30) -> DataFrame:
    """The n most salient terms: p(w) * sum of p(t|w) log(p(t|w) / p(t))."""
    posterior = F.col("weight") * F.col("share") / F.col("p_term")
    part = F.when(posterior > 0, posterior * F.ln(posterior / F.col("share"))).otherwise(F.lit(0.0))
    return (
        _with_marginal(phi, shares)
        .groupBy("term")
        .agg(F.max("p_term").alias("p_term"), F.sum(part).alias("distinctiveness"))
        .select("term", "p_term", (F.col("p_term") * F.col("distinctiveness")).alias("saliency"))
        .orderBy(F.desc("saliency"), "term")
        .limit(n)
    )


def _with_marginal(phi: DataFrame, shares: DataFrame) -> DataFrame:
    by_term = Window.partitionBy("term")
    return phi.join(F.broadcast(shares), "topic_id").withColumn(
        "p_term", F.sum(F.col("weight") * F.col("share")).over(by_term)
    )


def topic_shares(theta: DataFrame, lengths: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each topic's share of all tokens: theta weighted by document length."""
    mass = (
        theta.join(lengths, key)
        .select(F.posexplode("probs").alias("topic_id", "prob"), "token_count")
        .groupBy("topic_id")
        .agg(F.sum(F.col("prob") * F.col("token_count")).alias("mass"))
    )
    # one row per topic
    return mass.select("topic_id", (F.col("mass") / F.sum("mass").over(Window.partitionBy())).alias("share"))
