"""Questions over the document-topic matrix.

theta has one row per document: a key and `probs`, an array with one probability
per topic. The array form is a factor of K smaller than the long form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.functions import text, vectors
from corpusmill.runtime import materialize, small_side


def long_theta(theta: DataFrame, key: str = "doc_id") -> DataFrame:
    return theta.select(key, F.posexplode("probs").alias("topic_id", "prob"))


def with_dominant(theta: DataFrame) -> DataFrame:
    return theta.withColumns(
        {
            "dominant_topic": vectors.argmax(F.col("probs")),
            "dominant_topic_prob": F.array_max("probs"),
        }
    )


def wide_theta(theta: DataFrame, n_topics: int, docs: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """topic_0 .. topic_{K-1}, dominant topic and its probability, joined to `docs`."""
    columns = [F.get("probs", F.lit(k)).alias(f"topic_{k}") for k in range(n_topics)]
    wide = with_dominant(theta).select(key, *columns, "dominant_topic", "dominant_topic_prob")
    return wide if docs is None else docs.join(wide, key)


def distribution_map(theta: DataFrame, doc: int, key: str = "doc_id") -> DataFrame:
    """Topic -> probability of one document."""
    topics = F.sequence(F.lit(0), F.size("probs") - 1)
    return theta.where(F.col(key) == doc).select(
        key, F.map_from_arrays(topics, "probs").alias("distribution")
    )


def notable_topics(theta: DataFrame, above: float = 0.01, key: str = "doc_id") -> DataFrame:
    """Topics of each document above a probability, most likely first (rank from 1).

    Sorted inside the row, so there is no shuffle.
    """
    pairs = F.transform(
        "probs", lambda p, i: F.struct((-p).alias("minus"), i.alias("topic_id"), p.alias("prob"))
    )
    ranked = F.array_sort(F.filter(pairs, lambda x: x["prob"] > above))
    return theta.select(key, F.posexplode(ranked).alias("pos", "x")).select(
        key, (F.col("pos") + 1).alias("rank"), "x.topic_id", "x.prob"
    )


def documents_of_topic(
    theta: DataFrame,
    topic_id: int,
    min_probability: float = 0.3,
    top_n: int | None = None,
    docs: DataFrame | None = None,
    key: str = "doc_id",
) -> DataFrame:
    """Documents whose probability for the topic reaches the threshold, best first.

    With `top_n` the ids are cut first and only those rows are joined.
    """
    prob = F.get("probs", F.lit(topic_id)).alias("prob")
    found = theta.select(key, prob).where(F.col("prob") >= min_probability)
    if top_n:
        found = found.orderBy(F.desc("prob"), key).limit(top_n)
    if docs is not None:
        found = docs.join(small_side(materialize(found, "topic-documents")) if top_n else found, key)
    return found.orderBy(F.desc("prob"), key)


def query_vector(theta: DataFrame, doc: int, key: str = "doc_id", column: str = "probs") -> Column:
    """One document's vector as a literal: a lookup of one row with K numbers."""
    row = theta.where(F.col(key) == doc).select(column).first()
    if row is None:
        raise ValueError(f"no document {doc}")
    return vectors.literal_vector(row[0])


def rank_similar(
    theta: DataFrame,
    query: Column,
    top_n: int = 10,
    method: str = "cosine",
    exclude: int | None = None,
    key: str = "doc_id",
    column: str = "probs",
) -> DataFrame:
    """The documents most similar to a query vector: one scan and a top-n."""
    if method == "cosine":
        score = vectors.cosine(F.col(column), query)
    elif method == "jensenshannon":
        score = vectors.js_similarity(F.col(column), query)
    else:
        raise ValueError(f"unknown method: {method}")
    rows = theta if exclude is None else theta.where(F.col(key) != exclude)
    # scores equal to nine places count as ties, so rounding does not order them
    return (
        rows.select(key, score.alias("similarity"))
        .orderBy(F.desc(F.round("similarity", 9)), key)
        .limit(top_n)
    )


def similar_documents(
    theta: DataFrame,
    doc: int,
    top_n: int = 10,
    method: str = "cosine",
    docs: DataFrame | None = None,
    key: str = "doc_id",
    column: str = "probs",
) -> DataFrame:
    """Documents similar to a given one, itself excluded."""
    query = query_vector(theta, doc, key, column)
    best = rank_similar(theta, query, top_n, method, doc, key, column)
    return best if docs is None else docs.join(small_side(materialize(best, "similar")), key)


def topic_prevalence(theta: DataFrame) -> DataFrame:
    """Mean, population deviation, maximum and number of documents led, per topic."""
    entries = theta.select(
        vectors.argmax(F.col("probs")).alias("lead"),
        F.posexplode("probs").alias("topic_id", "prob"),
    )
    return entries.groupBy("topic_id").agg(
        F.avg("prob").alias("mean_probability"),
        F.stddev_pop("prob").alias("std_probability"),
        F.max("prob").alias("max_probability"),
        F.count_if(F.col("lead") == F.col("topic_id")).alias("num_dominant"),
    )


def dominant_counts(theta: DataFrame) -> DataFrame:
    """Documents led by each topic and their share."""
    counts = (
        theta.groupBy(vectors.argmax(F.col("probs")).alias("dominant_topic"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # one row per topic
    everything = F.sum("n").over(Window.partitionBy())
    return counts.select("dominant_topic", "n", (F.col("n") * 100.0 / everything).alias("pct"))


_AGGREGATES = {"mean": F.avg, "sum": F.sum, "count": F.count}


def topic_trends(
    theta: DataFrame,
    docs: DataFrame,
    date: Column,
    period: str = "year",
    aggregate: str = "mean",
    topics: Sequence[int] | None = None,
    key: str = "doc_id",
) -> DataFrame:
    """Topic probability per period (first day) and topic; empty periods give null.

    `period` is year, quarter, month or week; `aggregate` is mean, sum or count.
    Means are partial before the shuffle, so a crowded period is no hot spot.
    """
    if aggregate not in _AGGREGATES:
        raise ValueError(f"unknown aggregate: {aggregate}")
    if period not in ("year", "quarter", "month", "week"):
        raise ValueError(f"unknown period: {period}")
    dated = docs.select(key, F.date_trunc(period, date).cast("date").alias("period")).where(
        "period is not null"
    )
    entries = dated.join(theta.select(key, "probs"), key).select(
        "period", F.posexplode("probs").alias("topic_id", "prob")
    )
    if topics is not None:
        entries = entries.where(F.col("topic_id").isin(list(topics)))
    values = entries.groupBy("period", "topic_id").agg(
        _AGGREGATES[aggregate]("prob").alias("value")
    )
    # one row per topic: all its periods, and the range over all topics
    packed = values.groupBy("topic_id").agg(
        F.map_from_entries(F.collect_list(F.struct("period", "value"))).alias("known"),
        F.min("period").alias("first"),
        F.max("period").alias("last"),
    )
    everything = Window.partitionBy()
    step = F.make_interval(
        years=F.lit(1 if period == "year" else 0),
        months=F.lit({"quarter": 3, "month": 1}.get(period, 0)),
        weeks=F.lit(1 if period == "week" else 0),
    )
    spine = F.sequence(F.min("first").over(everything), F.max("last").over(everything), step)
    return packed.select("topic_id", "known", spine.alias("spine")).select(
        "topic_id", "known", F.explode("spine").alias("period")
    ).select("period", "topic_id", F.try_element_at("known", F.col("period")).alias("value"))


def dominant_share_by_year(theta: DataFrame, docs: DataFrame, year: Column, key: str = "doc_id") -> DataFrame:
    """Share of each leading topic among the documents of a year."""
    counts = (
        docs.select(key, year.alias("year"))
        .where("year is not null")
        .join(theta.select(key, vectors.argmax(F.col("probs")).alias("dominant_topic")), key)
        .groupBy("year", "dominant_topic")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    in_year = F.sum("n").over(Window.partitionBy("year"))
    return counts.withColumn("share", F.col("n") / in_year)


def rising_and_falling(
    theta: DataFrame, docs: DataFrame, year: Column, threshold: float = 0.01, key: str = "doc_id"
) -> DataFrame:
    """Mean probability in the early and the recent half of the years, and the verdict."""
    entries = (
        docs.select(key, year.alias("year"))
        .where("year is not null")
        .join(theta.select(key, "probs"), key)
        .select("year", F.posexplode("probs").alias("topic_id", "prob"))
    )
    yearly = entries.groupBy("year", "topic_id").agg(
        F.sum("prob").alias("s"), F.count("prob").alias("n")
    )
    # one row per year and topic, so the range is taken over a short list
    everything = Window.partitionBy()
    middle = (F.min("year").over(everything) + F.max("year").over(everything)) / 2
    yearly = yearly.withColumn("early", F.col("year") <= middle)
    early = F.col("early")

    def mean_where(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("s"))) / F.sum(F.when(condition, F.col("n")))

    change = F.col("recent_mean") - F.col("early_mean")
    return (
        yearly.groupBy("topic_id")
        .agg(mean_where(early).alias("early_mean"), mean_where(~early).alias("recent_mean"))
        .select(
            "topic_id",
            "early_mean",
            "recent_mean",
            change.alias("change"),
            F.when(change > threshold, "rising")
            .when(change < -threshold, "falling")
            .otherwise("stable")
            .alias("trend"),
        )
    )


def heatmap_block(theta: DataFrame, n_docs: int = 50, key: str = "doc_id") -> DataFrame:
    """Long form of the first documents by key."""
    return long_theta(theta.orderBy(key).limit(n_docs), key)


def browse(
    docs: DataFrame,
    theta: DataFrame,
    query: str | None = None,
    topic_id: int | None = None,
    min_probability: float = 0.0,
    years: tuple[int, int] | None = None,
    key: str = "doc_id",
) -> DataFrame:
    """Documents by keyword, leading topic, minimum probability and year range."""
    if query:
        docs = docs.where(text.contains_text(["title", "abstract"], query))
    if years is not None:
        docs = docs.where(F.col("year").between(*years))
    led = with_dominant(theta).select(key, "dominant_topic", "dominant_topic_prob")
    if topic_id is not None:
        led = led.where(F.col("dominant_topic") == topic_id)
    led = led.where(F.col("dominant_topic_prob") >= min_probability)
    return docs.join(led, key)


SORT_COLUMNS = ("title", "year", "date", "dominant_topic_prob", "similarity", "doc_id", "identifier")


def sort_by(df: DataFrame, column: str, key: str = "doc_id", descending: bool = False) -> DataFrame:
    if column not in SORT_COLUMNS or column not in df.columns:
        raise ValueError(f"cannot sort by {column}")
    order = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return df.orderBy(order, key)


SHALLOW = 10_000


def page(df: DataFrame, number: int, size: int = 10, order: str = "doc_id") -> DataFrame:
    """Page `number`, counted from 0, of the rows in key order; only for the first rows, since all before are sorted too."""
    if number * size > SHALLOW:
        raise ValueError("ask for deep pages with page_after")
    return df.orderBy(order).offset(number * size).limit(size)


def page_after(
    df: DataFrame,
    after: tuple | None = None,
    size: int = 10,
    column: str = "doc_id",
    key: str = "doc_id",
    descending: bool = False,
) -> DataFrame:
    """The rows that follow a cursor in the order of `sort_by`; `after` holds the last row's sort value and key.

    The cursor is a filter that reaches the scan, so a deep page costs what the first one does: a
    scan and the `size` best rows of each task. Nulls come last; `key` must be unique.
    """
    value = F.col(column)
    if after is not None:
        last, last_key = after
        later_key = F.col(key) > F.lit(last_key)
        if column == key:
            df = df.where(F.col(key) < F.lit(last_key) if descending else later_key)
        elif last is None:
            df = df.where(value.isNull() & later_key)
        else:
            beyond = value < F.lit(last) if descending else value > F.lit(last)
            df = df.where(beyond | ((value == F.lit(last)) & later_key) | value.isNull())
    order = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return df.orderBy(order, key).limit(size)


def cursor(rows: DataFrame, column: str = "doc_id", key: str = "doc_id") -> tuple | None:
    """Where the page ended: its last row's sort value and key, or None if it has no rows."""
    last = rows.select(column, F.col(key).alias("_key")).tail(1)
    return (last[0][0], last[0][1]) if last else None
