"""Tables on disk: CSV exchange files and the Parquet stores of each stage."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml.clustering import LocalLDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpusmill import fixed_values as fixed
from corpusmill.operators import analysis
from corpusmill.operators.preprocess import Preprocessor
from corpusmill.operators.topics import ModelMetadata, TopicModel
from corpusmill.settings import Settings

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in fixed.RAW_COLUMNS])
CLEAN_SCHEMA = T.StructType(
    [
        T.StructField(c, T.IntegerType() if c == "year" else T.StringType())
        for c in fixed.CLEAN_COLUMNS
    ]
)
COHERENCE_SCHEMA = T.StructType(
    [T.StructField("num_topics", T.IntegerType()), T.StructField("coherence", T.DoubleType())]
)

_CSV = {"header": "true", "escape": '"', "quote": '"', "encoding": "UTF-8"}


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled and line ends stay inside the quotes."""
    flat = df.select(
        [
            F.array_join(F.col(f.name), "; ").alias(f.name)
            if isinstance(f.dataType, T.ArrayType)
            else F.col(f.name)
            for f in df.schema
        ]
    )
    (
        flat.write.mode("overwrite")
        .options(**_CSV, ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
        .csv(path)
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """CSV with a given schema; empty cells are null."""
    return (
        spark.read.options(**_CSV, multiLine="true", lineSep="\n", emptyValue="")
        .schema(schema)
        .csv(path)
    )


def write_store(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_metadata_csv(processed: DataFrame, path: str) -> None:
    """The processed table without its tokens."""
    write_csv(processed.drop("tokens"), path)


def read_theta(
    spark: SparkSession, matrix_path: str, corpus_path: str, model: Callable[[], TopicModel], column: str = "tokens", key: str = "doc_id"
) -> DataFrame:
    """The wide document-topic matrix: the stored one, or else one inferred for the stored corpus.

    `model` is only called for in the second case, which drops the tokens.
    """
    if path_exists(spark, matrix_path):
        return spark.read.parquet(matrix_path)
    docs = spark.read.parquet(corpus_path)
    fitted = model()
    theta = fitted.theta(docs, column, [c for c in docs.columns if c != column])
    led = analysis.with_dominant(theta)
    topics = [F.get("probs", F.lit(k)).alias(f"topic_{k}") for k in range(fitted.num_topics)]
    rest = [c for c in docs.columns if c not in (column, key)]
    return led.select(key, *rest, *topics, "dominant_topic", "dominant_topic_prob")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark can list the path, on whatever file system it lies."""
    try:
        return bool(
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select("path").limit(1).count()
        )
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


def write_topics_json(topics: DataFrame, path: str) -> None:
    """Topics as JSON lines; words are [word, weight] structs."""
    topics.write.mode("overwrite").json(path)


TOPICS_SCHEMA = (
    "topic_id int, words array<struct<word: string, weight: double>>, label string, "
    "top_words array<string>, coherence double"
)


def read_topics_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOPICS_SCHEMA).json(path)


def parse_labels(documents: DataFrame, column: str = "value") -> DataFrame:
    """Label rows (topic_id, label) of JSON objects with integer keys."""
    parsed = F.from_json(column, "map<string,string>")
    return documents.select(F.explode(parsed).alias("key", "label")).select(
        F.col("key").try_cast("int").alias("topic_id"), "label"
    ).where("topic_id is not null")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Custom labels; none where the file is missing or unreadable."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "topic_id int, label string")
    return parse_labels(spark.read.text(path, wholetext=True))


def has_labels(spark: SparkSession, path: str) -> bool:
    return read_labels(spark, path).limit(1).count() > 0


def labels_json(labels: DataFrame) -> DataFrame:
    """All labels as one JSON object; there is one label per topic."""
    entries = F.array_sort(F.collect_list(F.struct("topic_id", "label")))
    return labels.agg(
        F.to_json(
            F.map_from_entries(
                F.transform(
                    entries, lambda e: F.struct(e["topic_id"].cast("string"), e["label"])
                )
            )
        ).alias("value")
    )


def write_labels(labels: DataFrame, path: str) -> None:
    """Write the label file; nothing of `path` may be read lazily by `labels`."""
    labels_json(labels).coalesce(1).write.mode("overwrite").text(path)


def set_label(spark: SparkSession, path: str, topic_id: int, label: str) -> None:
    """Set one label; the few rows there are pass through the driver."""
    rows = [r for r in read_labels(spark, path).collect() if r["topic_id"] != topic_id]
    rows = [(r["topic_id"], r["label"]) for r in rows] + [(topic_id, label)]
    write_labels(spark.createDataFrame(rows, "topic_id int, label string"), path)


def reset_labels(spark: SparkSession, path: str) -> None:
    write_labels(spark.createDataFrame([], "topic_id int, label string"), path)


def save_model(model: TopicModel, spark: SparkSession, path: str) -> None:
    model.lda.write().overwrite().save(f"{path}/lda")
    model.vectorizer.write().overwrite().save(f"{path}/dictionary")
    _write_json(spark, vars(model.metadata), f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> TopicModel:
    return TopicModel(
        LocalLDAModel.load(f"{path}/lda"),
        CountVectorizerModel.load(f"{path}/dictionary"),
        ModelMetadata(**_read_json(spark, f"{path}/metadata")),
    )


def save_preprocessor(prep: Preprocessor, spark: SparkSession, path: str) -> None:
    """Parameters and stopwords as JSON, phrase tables as Parquet."""
    state = {"settings": vars(prep.settings), "stopwords": prep.stopwords}
    state |= {"bigrams": prep.bigrams is not None, "trigrams": prep.trigrams is not None}
    _write_json(spark, state, f"{path}/state")
    for name in ("bigrams", "trigrams"):
        table = getattr(prep, name)
        if table is not None:
            write_store(table, f"{path}/{name}")


def load_preprocessor(spark: SparkSession, path: str) -> Preprocessor:
    state = _read_json(spark, f"{path}/state")
    prep = Preprocessor(Settings(**state["settings"]), state["stopwords"])
    for name in ("bigrams", "trigrams"):
        if state[name]:
            setattr(prep, name, spark.read.parquet(f"{path}/{name}"))
    return prep


def _write_json(spark: SparkSession, value: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])
