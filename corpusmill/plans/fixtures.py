"""Views over the given tables that play the part of the domain's own tables.

`corpus` stands for harvested records, `theta` and `phi` for the output of a
model. Each is a rule over the whole `documents` table; the SQL of the same rule
is in `sql.py`.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusmill import fixed_values as fixed
from corpusmill.operators import topics, vocabulary
from corpusmill.operators.preprocess import Preprocessor
from corpusmill.runtime import materialize, scratch_path, spread
from corpusmill.settings import Settings

TOPICS = 6

_stored: dict[tuple, object] = {}


def stored(spark: SparkSession, sf_dir: str, label: str, build: Callable[[], object]):
    """Build once per application and input folder; later queries re-use it."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _stored:
        _stored[key] = build()
    return _stored[key]


def forget() -> None:
    _stored.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, spread over the cores for work on their texts."""
    return spread(documents(spark, sf_dir), "doc_id")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw record per document."""
    d = F.col("doc_id")
    year = 2007 + d % 19

    def text_of(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    title = (
        F.when(d % 29 == 0, F.lit(None).cast("string"))
        .when(d % 31 == 0, "   ")
        .otherwise(F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 80))
    )
    month_day = text_of(year.cast("string"), "-", F.lpad((1 + d % 12).cast("string"), 2, "0"), "-15")
    date = (
        F.when(d % 20 == 0, F.lit(None).cast("string"))
        .when(d % 20 == 1, "")
        .when(d % 20 == 2, text_of("c", year))
        .when(d % 20 == 3, "n.d.")
        .when(d % 20 == 4, year.cast("string"))
        .when(d % 20 == 5, text_of(year, "/", year + 1))
        .otherwise(month_day)
    )
    gap = F.when(d % 7 == 0, "; ; ").otherwise("; ")
    return texts(spark, sf_dir).select(
        "doc_id",
        text_of("oai:corpus:", d).alias("identifier"),
        title.alias("title"),
        F.when(d % 37 != 0, F.col("text")).alias("abstract"),
        F.when(d % 11 != 0, text_of("Author ", d % 50, "; Author ", d % 7)).alias("authors"),
        date.alias("date"),
        F.when(d % 10 != 0, text_of("topic ", d % 13, gap, "topic ", d % 5)).alias("subjects"),
        F.col("source").alias("publisher"),
        F.when(d % 83 != 0, "Thesis").alias("types"),
        F.when(d % 5 != 0, F.col("lang")).alias("language"),
        F.lit(None).cast("string").alias("source"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records with an ingest order, exact copies and changed copies.

    One scan: every document becomes one to three rows in place.
    """
    d = F.col("doc_id")
    copies = F.filter(F.array(F.lit(0), F.when(d % 25 == 0, 1), F.when(d % 40 == 1, 2)), lambda x: x.isNotNull())
    rows = catalogue(spark, sf_dir).withColumn("copy", F.explode(copies))
    changed = F.concat(F.lit("changed "), d.cast("string"))
    return rows.select(
        (d * 3 + F.col("copy")).alias("ord"),
        "doc_id",
        "identifier",
        F.when(F.col("copy") == 2, changed).otherwise(F.col("title")).alias("title"),
        *fixed.RAW_COLUMNS[2:],
    )


def theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, probs): probabilities given by a rule, one array per document."""
    d = F.col("doc_id")
    weights = F.transform(
        F.sequence(F.lit(0), F.lit(TOPICS - 1)),
        lambda k: (1 + ((d * (7 * k + 3) + k * k) % 1009)).cast("double"),
    )
    mass = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return (
        documents(spark, sf_dir)
        .select("doc_id", weights.alias("w"))
        .select("doc_id", "w", mass.alias("mass"))
        .select("doc_id", F.transform("w", lambda x: x / F.col("mass")).alias("probs"))
    )


def preprocessor() -> Preprocessor:
    """Default parameters, built-in stopwords only."""
    return Preprocessor(Settings(), fixed.BUILT_IN_STOPWORDS)


def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored (doc_id, lang, source, tokens) of documents with 30 tokens or more."""

    def build() -> DataFrame:
        docs = texts(spark, sf_dir).select("doc_id", "lang", "source", "text")
        return materialize(preprocessor().tokenize(docs).drop("text"), "tokens")

    return stored(spark, sf_dir, "tokens", build)


def fitted_preprocessor(spark: SparkSession, sf_dir: str) -> Preprocessor:
    def build() -> Preprocessor:
        return preprocessor().fit(tokenized(spark, sf_dir))

    return stored(spark, sf_dir, "preprocessor", build)


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored tokens after phrases were merged."""

    def build() -> DataFrame:
        docs = fitted_preprocessor(spark, sf_dir).merge(tokenized(spark, sf_dir))
        return materialize(docs, "merged")

    return stored(spark, sf_dir, "merged", build)


def plain_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored (doc_id, topic, tokens) with stopwords kept; the topic is the number
    of the source modulo six."""

    def build() -> DataFrame:
        docs = Preprocessor(Settings(), ()).tokenize(
            texts(spark, sf_dir).select("doc_id", "source", "text")
        )
        topic = (F.substring("source", 4, 9).cast("int") % TOPICS).alias("topic")
        return materialize(docs.select("doc_id", topic, "tokens"), "plain-tokens")

    return stored(spark, sf_dir, "plain-tokens", build)


def phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored dense (topic_id, term, weight): smoothed term shares per source group.

    One shuffle on the term; the six topics are columns until the end, so no
    cross join is needed for the zeros.
    """

    def build() -> DataFrame:
        docs = plain_tokens(spark, sf_dir)
        n = [F.sum(F.when(F.col("topic") == k, F.col("n")).otherwise(0)) for k in range(TOPICS)]
        counts = (
            vocabulary.occurrences(docs, keep=["topic"])
            .groupBy("term")
            .agg(F.sum("df").alias("df"), *[c.alias(f"n{k}") for k, c in enumerate(n)])
        )
        ceiling = F.floor(docs.agg(F.count(F.lit(1))).scalar() * 0.5)
        kept = materialize(counts.where((F.col("df") >= 20) & (F.col("df") <= ceiling)), "phi-n")
        # one row of K + 1 numbers
        sums = kept.agg(
            F.count(F.lit(1)).alias("v"), *[F.sum(f"n{k}").alias(f"n{k}") for k in range(TOPICS)]
        ).first()
        smooth = 1.0 / TOPICS
        weights = F.array(
            *[
                F.struct(
                    F.lit(k).alias("topic_id"),
                    (
                        (F.col(f"n{k}") + smooth) / F.lit(sums[f"n{k}"] + sums["v"] / TOPICS)
                    ).alias("weight"),
                )
                for k in range(TOPICS)
            ]
        )
        return materialize(kept.select("term", F.inline(weights)), "phi")

    return stored(spark, sf_dir, "phi", build)


MODEL_TOPICS = 12


def model(spark: SparkSession, sf_dir: str) -> topics.TopicModel:
    """A model with the default parameters over the stored tokens with merged phrases."""
    return stored(
        spark, sf_dir, "model", lambda: topics.train(merged(spark, sf_dir), MODEL_TOPICS, Settings(), with_coherence=False)
    )


def _element(name: str, value: Column) -> Column:
    """`<name>value</name>` with the three special signs escaped; null writes nothing."""
    safe = F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.coalesce(F.concat(F.lit(f"<{name}>"), safe, F.lit(f"</{name}>")), F.lit(""))


def _repeated(name: str, joined: Column) -> Column:
    parts = F.transform(F.split(joined, "; "), lambda p: _element(name, p))
    return F.coalesce(F.array_join(parts, ""), F.lit(""))


def _with_root(batches):
    """Put one root element around the records of a file."""
    yield pa.RecordBatch.from_pydict({"value": ["<records>"]})
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])
    yield pa.RecordBatch.from_pydict({"value": ["</records>"]})


def record_dump(spark: SparkSession, sf_dir: str) -> str:
    """Folder with the corpus written as record XML, one record after the other.

    Records with doc_id % 13 = 0 are marked deleted and carry no metadata.
    """

    def build() -> str:
        d = F.col("doc_id")
        day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (d % 365).cast("int")), "yyyy-MM-dd")
        deleted = d % 13 == 0
        sets = F.when(d % 3 == 0, F.concat(F.lit("col_"), d % 4, F.lit("; "), F.lit("all"))).otherwise("all")
        header = F.concat(
            F.when(deleted, '<header status="deleted">').otherwise("<header>"),
            _element("identifier", F.col("identifier")),
            _element("datestamp", F.concat(day, F.lit("T00:00:00Z"))),
            _repeated("setSpec", sets),
            F.lit("</header>"),
        )
        fields = F.concat(
            _element("dc:title", F.col("title")),
            _repeated("dc:creator", F.col("authors")),
            _element("dc:description", F.col("abstract")),
            _element("dc:date", F.col("date")),
            _repeated("dc:subject", F.col("subjects")),
            _element("dc:publisher", F.col("publisher")),
            _repeated("dc:type", F.col("types")),
            _element("dc:language", F.col("language")),
            _element("dc:source", F.col("source")),
        )
        body = F.when(deleted, "").otherwise(
            F.concat(F.lit("<metadata><oai_dc:dc>"), fields, F.lit("</oai_dc:dc></metadata>"))
        )
        path = scratch_path(spark, "records")
        lines = corpus(spark, sf_dir).select(
            F.concat(F.lit("<record>"), header, body, F.lit("</record>")).alias("value")
        )
        lines.mapInArrow(_with_root, "value string").write.text(path)
        return path

    return stored(spark, sf_dir, "records", build)
