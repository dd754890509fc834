"""Queries that fit a topic model.

Spark ML's random start has no SQL equivalent. What a model must find is stated in SQL
for the planted corpus, with its topics named after the planted groups; the model of
the documents' own texts is checked by its sizes and by properties in the tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.functions import vectors
from corpusmill.operators import alignment, analysis, topics
from corpusmill.plans import fixtures as fx, planted, sql
from corpusmill.plans.registry import query
from corpusmill.runtime import materialize, scratch_path
from corpusmill.settings import Settings
from corpusmill.sources import tables


# what SQL can say about a model: its sizes and that its rows sum to one
_SIZES = sql.MERGED + """,
docs_in as (select count(distinct doc_id) as n from m),
freq as (select term from m group by term having count(distinct doc_id) >= 20
  and count(distinct doc_id) <= floor(0.5 * (select n from docs_in))),
sizes as (select (select n from docs_in) as n_docs, (select count(*) from freq) as n_terms)
"""


def _theta(spark, sf_dir) -> DataFrame:
    """Topic probabilities of the whole corpus, stored."""

    def build() -> DataFrame:
        return materialize(fx.model(spark, sf_dir).theta(fx.merged(spark, sf_dir)), "theta")

    return fx.stored(spark, sf_dir, "model-theta", build)


def _planted_theta(spark, sf_dir) -> DataFrame:
    def build() -> DataFrame:
        return materialize(planted.model(spark, sf_dir).theta(planted.corpus(spark, sf_dir)), "theta")

    return fx.stored(spark, sf_dir, "planted-theta", build)


def _group(spark, sf_dir, topic: Column) -> Column:
    return alignment.renamed(topic, planted.groups(spark, sf_dir)).alias("group_id")


def _rounded_array(name: str = "probs", places: int = 6):
    return F.transform(name, lambda x: F.round(x, places))


@query("m15_train_lda")
def m15(spark, sf_dir) -> DataFrame:
    return fx.model(spark, sf_dir).phi(spark)


@query(
    "m15_topic_mass",
    sql.with_(_SIZES)
    + "select k::integer as topic_id, n_terms as terms, 1.0::double as mass from range(12) t(k), sizes",
)
def m15_mass(spark, sf_dir) -> DataFrame:
    """Every topic has a weight for every term, and the weights sum to one."""
    return fx.model(spark, sf_dir).phi(spark).groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 6).alias("mass")
    )


@query(
    "m21_row_sums",
    sql.with_(_SIZES) + "select n_docs as n, 1.0::double as smallest, 1.0::double as largest from sizes",
)
def m21_sums(spark, sf_dir) -> DataFrame:
    """Every document has probabilities that sum to one."""
    mass = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    return _theta(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.min(mass), 6).alias("smallest"),
        F.round(F.max(mass), 6).alias("largest"),
    )


#: Sizes of three groups: seven, two and one of ten documents.
_SKEWED = (0, 0, 0, 0, 0, 0, 0, 1, 1, 2)


@query(
    "m15_prior_modes",
    """select 'symmetric' as prior, k::integer as place, round(1 / 3::double, 9) as value from range(3) t(k)
      union all select 'asymmetric', k::integer,
        round((1 / (k + sqrt(3))) / (1 / sqrt(3) + 1 / (1 + sqrt(3)) + 1 / (2 + sqrt(3))), 9) from range(3) t(k)
      union all select 'auto', k::integer, k::double from range(3) t(k)""",
)
def m15_priors(spark, sf_dir) -> DataFrame:
    """Concentrations of the modes; the learned ones order the groups of a skewed corpus by their sizes."""
    group = F.get(F.array(*[F.lit(g) for g in _SKEWED]), (F.col("doc_id") % 10).cast("int"))
    docs = planted.corpus(spark, sf_dir).withColumn("g", F.concat(F.lit("wo"), F.chr(97 + group.cast("long"))))
    skewed = docs.select("doc_id", F.transform("tokens", lambda t: F.when(t.startswith("wo"), F.concat("g", F.substring(t, 4, 1))).otherwise(t)).alias("tokens"))
    skewed = materialize(skewed, "skewed")
    modes = ("symmetric", "asymmetric", "auto")
    models = dict(zip(modes, topics.train_priors(skewed, 3, modes, Settings())))
    rows = [(m, i, round(x, 9)) for m in ("symmetric", "asymmetric") for i, x in enumerate(models[m].metadata.alpha)]
    of = alignment.align(models["auto"].phi(spark), planted.group_words(spark).where("group_id < 3"))
    learned = sorted(enumerate(models["auto"].metadata.alpha), key=lambda x: -x[1])
    rows += [("auto", place, float(of[topic])) for place, (topic, _) in enumerate(learned)]
    return spark.createDataFrame(rows, "prior string, place int, value double")


@query(
    "m16_model_topics",
    sql.with_(planted.SQL)
    + "select group_id, string_agg(term, ' ' order by rank) as top_words from prank where rank <= 8 group by 1",
)
def m16(spark, sf_dir) -> DataFrame:
    """The words of every topic, best first, for the planted corpus."""
    info = topics.topic_table(planted.model(spark, sf_dir), spark, 8)
    return info.select(_group(spark, sf_dir, F.col("topic_id")), F.array_join("top_words", " ").alias("top_words"))


@query("m17_model_coherence")
def m17(spark, sf_dir) -> DataFrame:
    return topics.coherence_by_topic(fx.model(spark, sf_dir), fx.merged(spark, sf_dir))


@query(
    "m19_topic_count_search",
    f"""select k::integer as num_topics, k = {planted.GROUPS} as is_best, true as scored
      from (select unnest({list(planted.COUNTS)}) as k)""",
)
def m19(spark, sf_dir) -> DataFrame:
    """All topic counts of the study with default passes; the planted number of groups wins."""
    best, results = planted.search(spark, sf_dir)
    return results.select(
        "num_topics", (F.col("num_topics") == best).alias("is_best"), F.col("coherence").between(-1, 1).alias("scored")
    )


@query("s10_search_results_store", f"select {planted.GROUPS}::integer as num_topics, true as same")
def s10(spark, sf_dir) -> DataFrame:
    """The results of the search, written and read back: the best row, and whether it is unchanged."""
    best, results = planted.search(spark, sf_dir)
    path = scratch_path(spark, "coherence-csv")
    tables.write_csv(results, path)
    stored = topics.best_topic_count(tables.read_csv(spark, path, tables.COHERENCE_SCHEMA))
    was = results.select("num_topics", F.col("coherence").alias("was"))
    return stored.join(F.broadcast(was), "num_topics").select("num_topics", (F.col("coherence") == F.col("was")).alias("same"))


#: Above the share of a group that a document has none of, below that of its second one.
_NOTABLE = 0.15


@query(
    "m20_topics_of_documents",
    sql.with_(planted.SQL)
    + """select doc_id, 1::integer as rank, group_id from plead
      union all select doc_id, 2::integer, second from plead where mixed""",
)
def m20(spark, sf_dir) -> DataFrame:
    """Groups of every planted document, most likely first: one, or two where it is mixed."""
    found = analysis.notable_topics(_planted_theta(spark, sf_dir), _NOTABLE)
    return found.select("doc_id", F.col("rank").cast("int").alias("rank"), _group(spark, sf_dir, F.col("topic_id")))


@query("m21_document_topic_matrix")
def m21(spark, sf_dir) -> DataFrame:
    return _theta(spark, sf_dir).select("doc_id", _rounded_array().alias("probs"))


def _inferred(found: DataFrame, spark, sf_dir) -> DataFrame:
    """One row per text and topic, with the topic's words."""
    rows = found.select("doc_id", "num_tokens", F.posexplode("topics").alias("pos", "topic"))
    return rows.select(
        "doc_id", F.col("num_tokens").cast("int").alias("num_tokens"), _group(spark, sf_dir, F.col("topic.topic_id")),
        F.array_join("topic.top_words", " ").alias("top_words"), (F.col("pos") == 0).alias("is_best"),
    )


_INFERRED_SQL = """,
ptop as (select group_id, string_agg(term, ' ' order by rank) as top_words from prank where rank <= {n} group by 1)
select n.doc_id, 9::integer as num_tokens, group_id, top_words, group_id = n.doc_id % {groups} as is_best
from new_texts as n cross join ptop"""


@query(
    "m22_infer_new_texts",
    sql.with_(planted.SQL, "new_texts as (select conv_id * 100000 + turn as doc_id from conversations)")
    + _INFERRED_SQL.format(n=5, groups=planted.GROUPS),
)
def m22(spark, sf_dir) -> DataFrame:
    """All topics of new raw texts, one per conversation turn, through the preprocessor."""
    turn = F.col("conv_id") * 100_000 + F.col("turn")
    texts = fx.table(spark, sf_dir, "conversations").select(turn.alias("doc_id"), planted.new_text(turn, ",").alias("text"))
    return _inferred(planted.model(spark, sf_dir).infer(texts, "text", planted.preprocessor(), 5), spark, sf_dir)


@query(
    "m22_infer_plain_split",
    sql.with_(planted.SQL, "new_texts as (select item_id as doc_id from benchmark)")
    + _INFERRED_SQL.format(n=3, groups=planted.GROUPS),
)
def m22_plain(spark, sf_dir) -> DataFrame:
    """Without a preprocessor: lower case, split at white space."""
    item = F.col("item_id")
    texts = fx.table(spark, sf_dir, "benchmark").select(item.alias("doc_id"), planted.new_text(item, "").alias("text"))
    return _inferred(planted.model(spark, sf_dir).infer(texts, "text", None, 3), spark, sf_dir)


@query(
    "v3_similar_to_text",
    f"""select (k + 1)::integer as rank, (select (min(item_id) % {planted.GROUPS})::integer from benchmark) as group_id
      from range(10) t(k)""",
)
def v3(spark, sf_dir) -> DataFrame:
    """Documents closest to a new text of one group are all of that group; nothing is excluded."""
    item = fx.table(spark, sf_dir, "benchmark").agg(F.min("item_id").alias("doc_id"))
    tokens = planted.preprocessor().transform(item.withColumn("text", planted.new_text(F.col("doc_id"), ";")))
    vector = planted.model(spark, sf_dir).theta(tokens).first()["probs"]
    best = analysis.rank_similar(_planted_theta(spark, sf_dir), vectors.literal_vector(vector), 10)
    order = Window.orderBy(F.desc(F.round("similarity", 9)), "doc_id")
    return best.select(
        F.row_number().over(order).alias("rank"), (F.col("doc_id") % planted.GROUPS).cast("int").alias("group_id")
    )


@query(
    "a25_model_summary",
    sql.with_(_SIZES)
    + """select 12::integer as num_topics, n_docs as num_documents, n_terms::integer as vocabulary_size,
      20::integer as passes, (20 * ceil(n_docs / 3000.0))::integer as updates, 'symmetric' as prior,
      list_transform(range(12), lambda k: 1 / 12::double) as alpha, 1 / 12::double as eta from sizes""",
)
def a25(spark, sf_dir) -> DataFrame:
    return topics.summary(fx.model(spark, sf_dir), spark).drop(
        "training_time_seconds", "coherence_time_seconds", "coherence_score"
    )


@query(
    "v7_overview_counts",
    sql.with_(_SIZES)
    + """select 12::integer as num_topics, n_docs as num_documents, n_terms::integer as vocabulary_size,
      6::bigint as labelled_topics from sizes""",
)
def v7(spark, sf_dir) -> DataFrame:
    model = fx.model(spark, sf_dir)
    path = scratch_path(spark, "labels")
    info = topics.topic_table(model, spark, 20)
    tables.write_labels(info.where("topic_id % 2 = 0").select("topic_id", "label"), path)
    labelled = tables.read_labels(spark, path).agg(F.count(F.lit(1))).scalar()
    return topics.summary(model, spark).select(
        "num_topics", "num_documents", "vocabulary_size", labelled.alias("labelled_topics")
    )


@query(
    "v8_bound_documents",
    sql.with_(planted.SQL) + "select group_id, count(*) as n from plead group by 1",
)
def v8(spark, sf_dir) -> DataFrame:
    """Planted documents bound to the model: how many each group leads."""
    bound = topics.BoundTheta(planted.model(spark, sf_dir), planted.corpus(spark, sf_dir))
    counts = analysis.dominant_counts(bound.theta)
    return counts.select(_group(spark, sf_dir, F.col("dominant_topic")), "n")


@query("s14_model_store", sql.with_(_SIZES) + "select n_docs as n, 0.0::double as largest_gap from sizes")
def s14(spark, sf_dir) -> DataFrame:
    """Largest difference of the probabilities after a reload: zero."""
    path = scratch_path(spark, "model")
    tables.save_model(fx.model(spark, sf_dir), spark, path)
    again = tables.load_model(spark, path).theta(fx.merged(spark, sf_dir))
    both = _theta(spark, sf_dir).join(again.withColumnRenamed("probs", "again"), "doc_id")
    gap = F.array_max(F.zip_with("probs", "again", lambda a, b: F.abs(a - b)))
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.max(gap), 9).alias("largest_gap"))


@query("s15_preprocessor_store", sql.with_(_SIZES) + "select n_docs as n, 0::bigint as different from sizes")
def s15(spark, sf_dir) -> DataFrame:
    """Documents whose tokens differ after a reload: none."""
    path = scratch_path(spark, "preprocessor")
    tables.save_preprocessor(fx.fitted_preprocessor(spark, sf_dir), spark, path)
    again = tables.load_preprocessor(spark, path).merge(fx.tokenized(spark, sf_dir))
    both = fx.merged(spark, sf_dir).join(
        again.select("doc_id", F.col("tokens").alias("again")), "doc_id"
    )
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("tokens") != F.col("again")).alias("different")
    )
