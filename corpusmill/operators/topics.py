"""Topic models with Spark ML: training, inference, choice of the topic count."""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.util import inheritable_thread_target

from corpusmill.functions import text
from corpusmill.operators import coherence, online_lda, topic_words, vocabulary
from corpusmill.operators.preprocess import Preprocessor
from corpusmill.runtime import materialize
from corpusmill.settings import Settings


PARTITION_DOCUMENTS = 200_000
#: Models that are fitted at the same time: an update leaves most of the cores idle.
PARALLEL_FITS = 6
#: Tasks of an update; those of a search, whose models share the cores, are summed without a stage in between.
UPDATE_TASKS, SEARCH_TASKS = 8, 4


@dataclass
class ModelMetadata:
    num_topics: int
    num_documents: int
    vocabulary_size: int
    passes: int
    updates: int
    prior: str
    alpha: list[float]  # one concentration per topic; the learned ones where they are learned
    eta: float
    coherence_score: float | None
    training_time_seconds: float
    coherence_time_seconds: float


class TopicModel:
    """A fitted model with its dictionary (at most `keep_n` terms)."""

    def __init__(
        self,
        lda: LDAModel,
        vectorizer: CountVectorizerModel,
        metadata: ModelMetadata,
    ) -> None:
        self.lda = lda
        self.vectorizer = vectorizer
        self.metadata = metadata

    @property
    def num_topics(self) -> int:
        return self.metadata.num_topics

    def phi(self, spark: SparkSession, n_words: int | None = None) -> DataFrame:
        """Topic-word weights (topic_id, term, weight); weights sum to 1 per topic."""
        described = self.lda.describeTopics(n_words or len(self.vectorizer.vocabulary))
        pairs = described.select(
            F.col("topic").alias("topic_id"),
            F.inline(F.arrays_zip("termIndices", "termWeights")),
        )
        names = spark.createDataFrame(
            list(enumerate(self.vectorizer.vocabulary)), "termIndices int, term string"
        )
        return pairs.join(F.broadcast(names), "termIndices").select(
            "topic_id", "term", F.col("termWeights").alias("weight")
        )

    def top_words(self, n: int = 10) -> list[tuple[int, list[str]]]:
        """Words of each topic on the driver: topics x n strings."""
        terms = self.vectorizer.vocabulary
        rows = self.lda.describeTopics(n).orderBy("topic").collect()
        return [(r["topic"], [terms[i] for i in r["termIndices"]]) for r in rows]

    def theta(
        self, docs: DataFrame, column: str = "tokens", keep: Sequence[str] = ("doc_id",)
    ) -> DataFrame:
        """Topic probabilities as an array `probs`; documents without a known term
        get equal probabilities. A map over the rows, no shuffle."""
        k = self.num_topics
        flat = F.array_repeat(F.lit(1.0 / k), k)
        # copies, so that a caller's stages keep their columns
        vectors = self.vectorizer.copy().setInputCol(column).setOutputCol("features").transform(docs)
        raw = self.lda.copy().setTopicDistributionCol("_topics").transform(vectors)
        probs = vector_to_array("_topics")
        return raw.select(
            *keep, F.when(F.exists(probs, lambda x: x > 0), probs).otherwise(flat).alias("probs")
        )

    def infer(
        self,
        texts: DataFrame,
        column: str = "text",
        preprocessor: Preprocessor | None = None,
        n_words: int = 5,
        keep: Sequence[str] = ("doc_id",),
    ) -> DataFrame:
        """Topics of new texts, most likely first, with the top words of each topic.

        Without a preprocessor a text is lower-cased and split at white space.
        """
        if preprocessor is None:
            words = F.filter(
                F.split(F.lower(text.text_of(column)), f"[{text.SPACE}]+"), lambda w: w != ""
            )
            docs = texts.withColumn("tokens", words)
        else:
            docs = preprocessor.transform(texts, column, "tokens")
        labels = F.array(
            *[F.array(*[F.lit(w) for w in words]) for _, words in self.top_words(n_words)]
        )
        ranked = F.array_sort(
            F.transform(
                "probs",
                lambda p, i: F.struct((-p).alias("m"), i.alias("topic_id"), p.alias("probability")),
            )
        )
        topics = F.transform(
            ranked,
            lambda x: F.struct(
                x["topic_id"].alias("topic_id"),
                x["probability"].alias("probability"),
                F.get(labels, x["topic_id"]).alias("top_words"),
            ),
        )
        scored = self.theta(docs, "tokens", [*keep, "tokens"])
        return scored.select(
            *keep, "tokens", F.size("tokens").alias("num_tokens"), topics.alias("topics")
        )


def update_parts(n_docs: int, least: int = UPDATE_TASKS) -> int:
    """Partitions of the bag of words: `least`, and more beyond PARTITION_DOCUMENTS documents in each."""
    return max(least, math.ceil(n_docs / PARTITION_DOCUMENTS))


def features(
    docs: DataFrame, vectorizer: CountVectorizerModel, n_docs: int, column: str = "tokens", least: int = UPDATE_TASKS
) -> DataFrame:
    """Bag of words in a layout that depends on the data only, so that a seed repeats.

    An update looks at `chunk_size` documents however large the corpus is, and each of its tasks gives its
    sums to all others, so partitions that grow with the documents would make every update dearer.
    The vectors are stored first: a fit starts from these files,
    and its tasks do not carry the plan that made the tokens.
    """
    vectors = vectorizer.copy().setInputCol(column).transform(docs).select("doc_id", "features")
    return (
        materialize(vectors, "features")
        .repartition(update_parts(n_docs, least), "doc_id")
        .sortWithinPartitions("doc_id")
    )


def fit_vectorizer(docs: DataFrame, column: str = "tokens", settings: Settings = Settings()) -> CountVectorizerModel:
    """Dictionary as a Spark ML stage. At most `keep_n` terms come to the driver."""
    dictionary = vocabulary.build_dictionary(docs, column, settings)
    terms = [r["term"] for r in dictionary.select("term", "term_id").orderBy("term_id").collect()]
    if not terms:
        raise ValueError("no term is left after filtering the dictionary")
    return vocabulary.vectorizer(terms, column)


def update_plan(n_docs: int, settings: Settings) -> tuple[float, int]:
    """Share of the documents per update, and number of updates.

    Chunks have `chunk_size` documents at every size of the corpus, and the updates come one
    after the other: a larger chunk is the caller's choice.
    """
    share = min(1.0, settings.chunk_size / n_docs)
    return share, settings.passes * math.ceil(n_docs / settings.chunk_size)


Prior = str | float | Sequence[float]


def concentrations(alpha: Prior | None, num_topics: int) -> tuple[str, list[float], bool]:
    """Name of a document prior, its concentration per topic, and whether they are learned.

    `symmetric`: 1 / K each. `asymmetric`: 1 / (i + sqrt(K)), scaled to one, so earlier
    topics are expected more often. `auto`: learned from the documents, from 1 / K on. A
    number stands for all topics, a sequence gives one each.
    """
    if alpha is None or alpha == "symmetric":
        return "symmetric", [1.0 / num_topics] * num_topics, False
    if alpha == "auto":
        return "auto", [1.0 / num_topics] * num_topics, True
    if alpha == "asymmetric":
        raw = [1.0 / (i + math.sqrt(num_topics)) for i in range(num_topics)]
        return "asymmetric", [x / sum(raw) for x in raw], False
    if isinstance(alpha, str):
        raise ValueError(f"unknown prior: {alpha}")
    given = [float(alpha)] * num_topics if isinstance(alpha, (int, float)) else [float(x) for x in alpha]
    if len(given) != num_topics or min(given) <= 0:
        raise ValueError(f"a prior needs {num_topics} positive numbers")
    return "given", given, False


def word_concentration(eta: str | float | None, num_topics: int) -> float:
    """One number for all words; a prior learned per word is not built."""
    if eta is None or eta == "symmetric":
        return 1.0 / num_topics
    if isinstance(eta, str):
        raise ValueError(f"unknown prior of words: {eta}")
    return float(eta)


def fit_lda(
    bow: DataFrame,
    n_docs: int,
    num_topics: int,
    settings: Settings = Settings(),
    alpha: Prior | None = None,
    eta: str | float | None = None,
    least: int = UPDATE_TASKS,
    n_terms: int | None = None,
) -> tuple[LDAModel, int]:
    """A fitted model and its number of updates, for the `features` of `n_docs` documents and `least` partitions.

    A document's topics are iterated until they change by less than 0.001 on average,
    which the optimiser fixes; there is no limit of iterations to set.
    `bow` is not to be cached: the fit keeps the vectors itself.
    """
    share, updates = update_plan(n_docs, settings)
    _, prior, learned = concentrations(alpha, num_topics)
    lda = LDA(
        k=num_topics,
        optimizer="online",
        maxIter=updates,
        subsamplingRate=share,
        docConcentration=prior,
        topicConcentration=word_concentration(eta, num_topics),
        optimizeDocConcentration=learned,
        learningDecay=0.5,
        learningOffset=1.0,
        seed=settings.seed,
    )
    if n_terms is None:
        n_terms = bow.first()["features"].size
    return online_lda.fit(lda, bow, n_docs, update_parts(n_docs, least), n_terms), updates


def train(
    docs: DataFrame,
    num_topics: int,
    settings: Settings = Settings(),
    alpha: Prior | None = None,
    eta: str | float | None = None,
    with_coherence: bool = True,
    column: str = "tokens",
) -> TopicModel:
    """Train on stored tokenised documents (doc_id, tokens)."""
    return _train_all(docs, [(num_topics, alpha)], settings, eta, with_coherence, column)[0]


def train_priors(
    docs: DataFrame, num_topics: int, alphas: Sequence[Prior | None], settings: Settings = Settings(), column: str = "tokens"
) -> list[TopicModel]:
    """One model per document prior, without coherence, over one dictionary and one bag of words."""
    return _train_all(docs, [(num_topics, alpha) for alpha in alphas], settings, None, False, column)


def _train_all(docs, kinds, settings, eta, with_coherence, column, least=UPDATE_TASKS) -> list[TopicModel]:
    """Models for several (topic count, document prior) over one dictionary and one stored bag of words."""
    started = time.perf_counter()
    n_docs = docs.count()
    stage = fit_vectorizer(docs, column, settings)
    bow = features(docs, stage, n_docs, column, least)
    shared = time.perf_counter() - started

    def fit(kind: tuple[int, Prior | None]) -> TopicModel:
        started = time.perf_counter()
        k, alpha = kind
        lda, updates = fit_lda(bow, n_docs, k, settings, alpha, eta, least, len(stage.vocabulary))
        meta = ModelMetadata(
            num_topics=k,
            num_documents=n_docs,
            vocabulary_size=len(stage.vocabulary),
            passes=settings.passes,
            updates=updates,
            prior=concentrations(alpha, k)[0],
            alpha=lda.estimatedDocConcentration().toArray().tolist(),
            eta=word_concentration(eta, k),
            coherence_score=None,
            training_time_seconds=shared + time.perf_counter() - started,
            coherence_time_seconds=0.0,
        )
        return TopicModel(lda, stage.copy(), meta)

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        models = list(pool.map(inheritable_thread_target(docs.sparkSession)(fit), kinds))
    if with_coherence:
        started = time.perf_counter()
        scores = dict(coherence_of_models(models, docs, column).select("model", "coherence").collect())
        for number, model in enumerate(models):
            model.metadata.coherence_score = scores[number]
            model.metadata.coherence_time_seconds = (time.perf_counter() - started) / len(models)
    return models


def coherence_of_models(models: Sequence[TopicModel], docs: DataFrame, column: str = "tokens", n_words: int = 20, window: int = 110) -> DataFrame:
    """(model, coherence) by place in `models`: one scan counts the windows of all their topics, one job scores them."""
    topics_of = [(number, words) for number, model in enumerate(models) for _, words in model.top_words(n_words)]
    owners = [number for number, _ in topics_of]
    counts = coherence.window_counts(docs, [(i, words) for i, (_, words) in enumerate(topics_of)], column, window, models=owners)
    scored = coherence.topic_coherence(materialize(counts, "windows"), n_words, owners)
    owner = F.get(F.array(*[F.lit(number) for number in owners]), F.col("topic_id"))
    return scored.groupBy(owner.alias("model")).agg(F.avg("coherence").alias("coherence"))


def coherence_by_topic(
    model: TopicModel, docs: DataFrame, column: str = "tokens", n_words: int = 20, window: int = 110
) -> DataFrame:
    counts = coherence.window_counts(docs, model.top_words(n_words), column, window)
    return coherence.topic_coherence(materialize(counts, "windows"), n_words)


def coherence_of(model: TopicModel, docs: DataFrame, column: str = "tokens") -> float:
    return coherence_of_models([model], docs, column).first()["coherence"]


def search_topic_counts(
    docs: DataFrame,
    counts: Sequence[int] = range(5, 21),
    settings: Settings = Settings(),
    column: str = "tokens",
) -> tuple[int, DataFrame]:
    """Coherence for every topic count, and the best one (the smallest on a tie).

    One dictionary, one stored bag of words and one scan of the windows serve all counts.
    """
    models = _train_all(docs, [(k, None) for k in counts], settings, None, True, column, SEARCH_TASKS)
    rows = [(m.num_topics, float(m.metadata.coherence_score)) for m in models]
    best = max(rows, key=lambda r: (r[1], -r[0]))[0]
    return best, docs.sparkSession.createDataFrame(rows, "num_topics int, coherence double")


def best_topic_count(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("coherence"), "num_topics").limit(1)


def topic_table(model: TopicModel, spark: SparkSession, n: int = 20, per_topic: DataFrame | None = None) -> DataFrame:
    """Topics with words, label and, where given, their coherence."""
    info = topic_words.topic_info(model.phi(spark, n), n)
    if per_topic is None:
        return info.withColumn("coherence", F.lit(None).cast("double"))
    return info.join(F.broadcast(per_topic), "topic_id", "left")


def summary(model: TopicModel, spark: SparkSession) -> DataFrame:
    """One row with counts and parameters of the model."""
    meta = asdict(model.metadata)
    schema = (
        "num_topics int, num_documents long, vocabulary_size int, passes int, updates int, "
        "prior string, alpha array<double>, eta double, coherence_score double, training_time_seconds double, "
        "coherence_time_seconds double"
    )
    return spark.createDataFrame([tuple(meta.values())], schema)


class BoundTheta:
    """Documents bound to their topic probabilities, stored until refreshed."""

    def __init__(self, model: TopicModel, docs: DataFrame, column: str = "tokens") -> None:
        self.model = model
        self.refresh(docs, column)

    def refresh(self, docs: DataFrame, column: str = "tokens") -> None:
        self.docs = docs
        self.theta = materialize(self.model.theta(docs, column), "theta")
