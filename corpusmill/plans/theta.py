"""Queries over topic matrices: theta (documents x topics) and phi (topics x words)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corpusmill.functions import dates, labels, text, vectors
from corpusmill.operators import alignment, analysis, coherence, topic_words
from corpusmill.plans import fixtures as fx, planted, sql
from corpusmill.plans.registry import query
from corpusmill.runtime import materialize, scratch_path
from corpusmill.sources import tables

# documents with a date and a title, one row per document
_DOCS_SQL = sql.CORPUS + f""",
dd as (select doc_id, identifier, title, abstract, {sql.parsed_date()} as pd from base),
dated as (select *, year(pd)::integer as year from dd)
"""


def _docs(spark, sf_dir) -> DataFrame:
    rows = fx.catalogue(spark, sf_dir)
    parsed = dates.parse_date("date")
    return rows.select(
        "doc_id", "identifier", "title", "abstract", parsed.alias("pd"), F.year(parsed).alias("year")
    )


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# -- documents and their topics -----------------------------------------------


@query("theta_long", sql.with_(sql.THETA) + "select doc_id, topic_id, round(prob, 6) as prob from theta")
def theta_long(spark, sf_dir) -> DataFrame:
    return _rounded(analysis.long_theta(fx.theta(spark, sf_dir)), "prob")


@query(
    "f13_documents_of_topic",
    sql.with_(sql.THETA, _DOCS_SQL)
    + "select doc_id, identifier, round(prob, 6) as prob from theta join dated using (doc_id) where topic_id = 2 and prob >= 0.3",
)
def f13(spark, sf_dir) -> DataFrame:
    found = analysis.documents_of_topic(fx.theta(spark, sf_dir), 2, 0.3, None, _docs(spark, sf_dir))
    return _rounded(found.select("doc_id", "identifier", "prob"), "prob")


@query(
    "l4_top_documents_of_topic",
    sql.with_(sql.THETA) + "select doc_id, round(prob, 6) as prob from theta where topic_id = 1 and prob >= 0.3 order by theta.prob desc, doc_id limit 10",
)
def l4(spark, sf_dir) -> DataFrame:
    return _rounded(analysis.documents_of_topic(fx.theta(spark, sf_dir), 1, 0.3, 10), "prob")


@query(
    "f15_browse",
    sql.with_(sql.THETA, _DOCS_SQL)
    + """select doc_id, year, dominant_topic, round(top_prob, 6) as dominant_topic_prob from dated join lead using (doc_id)
      where year between 2010 and 2018 and dominant_topic = 3 and top_prob >= 0.25
        and (contains(lower(coalesce(title, '')), 'an') or contains(lower(coalesce(abstract, '')), 'an'))""",
)
def f15(spark, sf_dir) -> DataFrame:
    found = analysis.browse(_docs(spark, sf_dir), fx.theta(spark, sf_dir), "AN", 3, 0.25, (2010, 2018))
    return _rounded(found.select("doc_id", "year", "dominant_topic", "dominant_topic_prob"), "dominant_topic_prob")


@query(
    "s16_export_filtered",
    sql.with_(sql.THETA, _DOCS_SQL)
    + """select doc_id, identifier, dominant_topic from dated join lead using (doc_id) where top_prob >= 0.3 and year >= 2015""",
)
def s16(spark, sf_dir) -> DataFrame:
    from corpusmill.runtime import scratch_path

    found = analysis.browse(_docs(spark, sf_dir), fx.theta(spark, sf_dir), None, None, 0.3, (2015, 9999))
    export = found.select("doc_id", "identifier", "dominant_topic")
    path = scratch_path(spark, "export")
    tables.write_csv(export, path)
    return tables.read_csv(spark, path, export.schema)


@query(
    "f16_notable_topics",
    sql.with_(sql.THETA)
    + "select doc_id, topic_id, round(prob, 6) as prob from theta where prob > 0.01",
)
def f16(spark, sf_dir) -> DataFrame:
    return _rounded(analysis.notable_topics(fx.theta(spark, sf_dir), 0.01).drop("rank"), "prob")


@query(
    "l6_topics_by_probability",
    sql.with_(sql.THETA)
    + "select doc_id, topic_id, (row_number() over (partition by doc_id order by prob desc, topic_id))::integer as rank from theta where prob > 0.01",
)
def l6(spark, sf_dir) -> DataFrame:
    return analysis.notable_topics(fx.theta(spark, sf_dir), 0.01).select("doc_id", "topic_id", "rank")


@query(
    "l9_dominant_topic",
    sql.with_(sql.THETA) + "select doc_id, dominant_topic, round(top_prob, 6) as dominant_topic_prob from lead",
)
def l9(spark, sf_dir) -> DataFrame:
    return _rounded(analysis.with_dominant(fx.theta(spark, sf_dir)).drop("probs"), "dominant_topic_prob")


@query(
    "v4_dominant_topic_of_document",
    sql.with_(sql.THETA) + "select doc_id, dominant_topic from lead where doc_id = 17",
)
def v4(spark, sf_dir) -> DataFrame:
    return analysis.with_dominant(fx.theta(spark, sf_dir).where("doc_id = 17")).select("doc_id", "dominant_topic")


@query(
    "l10_heatmap_block",
    sql.with_(sql.THETA)
    + "select doc_id, topic_id, round(prob, 6) as prob from theta where doc_id in (select doc_id from documents order by doc_id limit 50)",
)
def l10(spark, sf_dir) -> DataFrame:
    return _rounded(analysis.heatmap_block(fx.theta(spark, sf_dir), 50), "prob")


@query(
    "c14_distribution_of_document",
    sql.with_(sql.THETA) + "select topic_id, round(prob, 6) as prob from theta where doc_id = 5",
)
def c14(spark, sf_dir) -> DataFrame:
    spread = analysis.distribution_map(fx.theta(spark, sf_dir), 5)
    return _rounded(spread.select(F.explode("distribution").alias("topic_id", "prob")), "prob")


@query(
    "m23_wide_theta",
    sql.with_(sql.THETA)
    + "select doc_id, " + ", ".join(f"round(max(case when topic_id = {k} then prob end), 6) as topic_{k}" for k in range(6))
    + ", any_value(dominant_topic) as dominant_topic, round(any_value(top_prob), 6) as dominant_topic_prob from theta join lead using (doc_id) group by doc_id",
)
def m23(spark, sf_dir) -> DataFrame:
    wide = analysis.wide_theta(fx.theta(spark, sf_dir), fx.TOPICS)
    return _rounded(wide, *[f"topic_{k}" for k in range(fx.TOPICS)], "dominant_topic_prob")


_TOPIC_COLUMNS = [f"topic_{k}" for k in range(fx.TOPICS)]


@query(
    "s9_theta_store",
    sql.with_(sql.THETA, _DOCS_SQL)
    + "select doc_id, any_value(identifier) as identifier, "
    + ", ".join(f"round(max(case when topic_id = {k} then prob end), 6) as topic_{k}" for k in range(6))
    + """, any_value(dominant_topic) as dominant_topic, round(any_value(top_prob), 6) as dominant_topic_prob
      from theta join lead using (doc_id) join dated using (doc_id) group by doc_id""",
)
def s9(spark, sf_dir) -> DataFrame:
    """The whole matrix, stored, read back, exported as CSV and read again."""
    wide = analysis.wide_theta(fx.theta(spark, sf_dir), fx.TOPICS, _docs(spark, sf_dir).select("doc_id", "identifier"))
    path, csv = scratch_path(spark, "theta"), scratch_path(spark, "theta-csv")
    tables.write_store(wide, path)
    stored = tables.read_theta(spark, path, path + "-corpus", lambda: fx.model(spark, sf_dir))
    tables.write_csv(stored, csv)
    again = tables.read_csv(spark, csv, stored.schema)
    return _rounded(again.select("doc_id", "identifier", *_TOPIC_COLUMNS, "dominant_topic", "dominant_topic_prob"), *_TOPIC_COLUMNS, "dominant_topic_prob")


@query(
    "s9_theta_from_corpus",
    sql.with_(planted.SQL) + "select doc_id, group_id, 6 as topics, true as sums_to_one from plead",
)
def s9_corpus(spark, sf_dir) -> DataFrame:
    """Without a stored matrix: the stored corpus and the model give it."""
    path = scratch_path(spark, "processed")
    tables.write_store(planted.corpus(spark, sf_dir), path)
    wide = tables.read_theta(spark, path + "-matrix", path, lambda: planted.model(spark, sf_dir))
    found = [c for c in wide.columns if c.startswith("topic_")]
    total = sum((F.col(c) for c in found), F.lit(0.0))
    return wide.select(
        "doc_id", alignment.renamed(F.col("dominant_topic"), planted.groups(spark, sf_dir)).alias("group_id"),
        F.lit(len(found)).alias("topics"), (F.abs(total - 1) < 1e-6).alias("sums_to_one"),
    )


@query(
    "j2_theta_on_documents",
    sql.with_(sql.THETA, _DOCS_SQL)
    + "select doc_id, title, year, topic_id, round(prob, 6) as prob from dated join theta using (doc_id)",
)
def j2(spark, sf_dir) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "title", "year")
    joined = docs.join(fx.theta(spark, sf_dir), "doc_id")
    return _rounded(joined.select("doc_id", "title", "year", F.posexplode("probs").alias("topic_id", "prob")), "prob")


# -- prevalence and trends ----------------------------------------------------


@query(
    "a19_topic_prevalence",
    sql.with_(sql.THETA)
    + """select topic_id, round(avg(prob), 6) as mean_probability, round(stddev_pop(prob), 6) as std_probability,
      round(max(prob), 6) as max_probability, count_if(dominant_topic = topic_id) as num_dominant
      from theta join lead using (doc_id) group by 1""",
)
def a19(spark, sf_dir) -> DataFrame:
    out = analysis.topic_prevalence(fx.theta(spark, sf_dir))
    return _rounded(out, "mean_probability", "std_probability", "max_probability")


@query(
    "a20_dominant_counts",
    sql.with_(sql.THETA)
    + "select dominant_topic, count(*) as n, round(count(*) * 100.0 / (select count(*) from lead), 6) as pct from lead group by 1",
)
def a20(spark, sf_dir) -> DataFrame:
    return _rounded(analysis.dominant_counts(fx.theta(spark, sf_dir)), "pct")


def _trend_sql(period: str, step: str, aggregate: str, where: str = "", rnd: bool = True) -> str:
    value = f"{aggregate}(prob)"
    shown = "round(value, 6)" if rnd else "value"
    return (
        sql.with_(sql.THETA, _DOCS_SQL)
        + f""", x as (select date_trunc('{period}', pd)::date as period, topic_id, {value} as value
        from dated join theta using (doc_id) where pd is not null {where} group by 1, 2),
      spine as (select unnest(generate_series((select min(period) from x), (select max(period) from x), interval {step}))::date as period)
      select spine.period, t.topic_id, {shown} as value from spine cross join (select distinct topic_id from x) t
      left join x on x.period = spine.period and x.topic_id = t.topic_id"""
    )


@query("a21_topic_trends_by_year", _trend_sql("year", "1 year", "avg"))
def a21(spark, sf_dir) -> DataFrame:
    return _rounded(analysis.topic_trends(fx.theta(spark, sf_dir), _docs(spark, sf_dir), F.col("pd")), "value")


@query("j10_gap_filled_months", _trend_sql("month", "1 month", "avg"))
def j10(spark, sf_dir) -> DataFrame:
    out = analysis.topic_trends(fx.theta(spark, sf_dir), _docs(spark, sf_dir), F.col("pd"), "month")
    return _rounded(out, "value")


@query("a22_topic_trends_sum", _trend_sql("year", "1 year", "sum"))
def a22(spark, sf_dir) -> DataFrame:
    out = analysis.topic_trends(fx.theta(spark, sf_dir), _docs(spark, sf_dir), F.col("pd"), "year", "sum")
    return _rounded(out, "value")


@query("a22_topic_trends_count", _trend_sql("quarter", "3 month", "count", rnd=False))
def a22b(spark, sf_dir) -> DataFrame:
    return analysis.topic_trends(fx.theta(spark, sf_dir), _docs(spark, sf_dir), F.col("pd"), "quarter", "count")


@query("f17_trends_of_chosen_topics", _trend_sql("year", "1 year", "avg", "and topic_id in (0, 3, 99)"))
def f17(spark, sf_dir) -> DataFrame:
    out = analysis.topic_trends(
        fx.theta(spark, sf_dir), _docs(spark, sf_dir), F.col("pd"), topics=[0, 3, 99]
    )
    return _rounded(out, "value")


@query(
    "a23_dominant_share_by_year",
    sql.with_(sql.THETA, _DOCS_SQL)
    + """, c as (select year, dominant_topic, count(*) as n from dated join lead using (doc_id) where year is not null group by 1, 2)
    select year, dominant_topic, n, round(n / sum(n) over (partition by year), 6) as share from c""",
)
def a23(spark, sf_dir) -> DataFrame:
    return _rounded(
        analysis.dominant_share_by_year(fx.theta(spark, sf_dir), _docs(spark, sf_dir), F.col("year")), "share"
    )


@query(
    "w5_rank_within_year",
    sql.with_(sql.THETA, _DOCS_SQL)
    + """, c as (select year, dominant_topic, count(*) as n from dated join lead using (doc_id) where year is not null group by 1, 2)
    select year, dominant_topic, (row_number() over (partition by year order by n desc, dominant_topic))::integer as rank from c""",
)
def w5(spark, sf_dir) -> DataFrame:
    share = analysis.dominant_share_by_year(fx.theta(spark, sf_dir), _docs(spark, sf_dir), F.col("year"))
    by_year = Window.partitionBy("year").orderBy(F.desc("n"), "dominant_topic")
    return share.select("year", "dominant_topic", F.row_number().over(by_year).alias("rank"))


@query(
    "a24_rising_and_falling",
    sql.with_(sql.THETA, _DOCS_SQL)
    + """, e as (select year, topic_id, prob from dated join theta using (doc_id) where year is not null),
    mid as (select (min(year) + max(year)) / 2.0 as y from e),
    h as (select topic_id, avg(prob) filter (year <= (select y from mid)) as early_mean,
      avg(prob) filter (year > (select y from mid)) as recent_mean from e group by 1)
    select topic_id, round(early_mean, 6) as early_mean, round(recent_mean, 6) as recent_mean,
      round(recent_mean - early_mean, 6) as change, case when recent_mean - early_mean > 0.001 then 'rising'
      when recent_mean - early_mean < -0.001 then 'falling' else 'stable' end as trend from h""",
)
def a24(spark, sf_dir) -> DataFrame:
    out = analysis.rising_and_falling(
        fx.theta(spark, sf_dir), _docs(spark, sf_dir), F.col("year"), threshold=0.001
    )
    return _rounded(out, "early_mean", "recent_mean", "change")


# -- similarity ---------------------------------------------------------------

_COSINE = """, q as (select topic_id, prob as qp from theta where doc_id = 7),
sim as (select doc_id, sum(prob * qp) / (sqrt(sum(prob * prob)) * sqrt(sum(qp * qp))) as s
  from theta join q using (topic_id) where doc_id <> 7 group by doc_id)"""


@query(
    "v1_similar_documents",
    sql.with_(sql.THETA) + _COSINE
    + " select doc_id, round(s, 6) as similarity, case when s > 0.7 then 'high' when s > 0.4 then 'medium' else 'low' end as band from sim order by round(s, 9) desc, doc_id limit 10",
)
def v1(spark, sf_dir) -> DataFrame:
    best = analysis.similar_documents(fx.theta(spark, sf_dir), 7, 10)
    return _rounded(best.withColumn("band", labels.similarity_band(F.col("similarity"))), "similarity")


@query(
    "j3_similar_document_rows",
    sql.with_(sql.THETA, _DOCS_SQL) + _COSINE
    + " select doc_id, title, round(s, 6) as similarity from (select * from sim order by round(s, 9) desc, doc_id limit 20) join dated using (doc_id)",
)
def j3(spark, sf_dir) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "title")
    return _rounded(analysis.similar_documents(fx.theta(spark, sf_dir), 7, 20, docs=docs), "similarity")


@query(
    "j8_all_similarities",
    sql.with_(sql.THETA) + _COSINE + " select doc_id, round(s, 6) as similarity from sim",
)
def j8(spark, sf_dir) -> DataFrame:
    theta = fx.theta(spark, sf_dir)
    score = vectors.cosine(F.col("probs"), analysis.query_vector(theta, 7))
    return theta.where("doc_id <> 7").select("doc_id", F.round(score, 6).alias("similarity"))


@query(
    "v1_similar_embeddings",
    """with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
    q as (select v as qv from e where vec_id = 3),
    sim as (select vec_id, list_cosine_similarity(v, qv) as s from e, q where vec_id <> 3)
    select vec_id, round(s, 6) as similarity from sim order by round(s, 9) desc, vec_id limit 10""",
)
def v1_embeddings(spark, sf_dir) -> DataFrame:
    rows = fx.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v")
    )
    return _rounded(analysis.similar_documents(rows, 3, 10, key="vec_id", column="v"), "similarity")


_JS = """, q as (select topic_id, prob as qp from theta where doc_id = 7),
d as (select doc_id, sqrt(greatest(0, sum(prob * ln(2 * prob / (prob + qp)) + qp * ln(2 * qp / (prob + qp))) / 2)) as dist
  from theta join q using (topic_id) where doc_id <> 7 group by doc_id)"""


@query(
    "v2_jensen_shannon_documents",
    sql.with_(sql.THETA) + _JS + " select doc_id, round(1 - dist, 6) as similarity from d order by round(1 - dist, 9) desc, doc_id limit 10",
)
def v2(spark, sf_dir) -> DataFrame:
    return _rounded(analysis.similar_documents(fx.theta(spark, sf_dir), 7, 10, "jensenshannon"), "similarity")


@query(
    "l5_similarity_bands",
    sql.with_(sql.THETA) + _JS
    + " select case when 1 - dist > 0.7 then 'high' when 1 - dist > 0.4 then 'medium' else 'low' end as band, count(*) as n from d group by 1",
)
def l5(spark, sf_dir) -> DataFrame:
    theta = fx.theta(spark, sf_dir)
    score = vectors.js_similarity(F.col("probs"), analysis.query_vector(theta, 7))
    return theta.where("doc_id <> 7").groupBy(labels.similarity_band(score).alias("band")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "c12_coherence_bands",
    sql.with_(sql.THETA)
    + """select case when top_prob < 0.4 then 'low' when top_prob < 0.5 then 'medium' when top_prob < 0.6 then 'good'
      when top_prob <= 0.7 then 'very good' else 'excellent' end as band, count(*) as n from lead group by 1""",
)
def c12(spark, sf_dir) -> DataFrame:
    score = F.array_max("probs")
    return fx.theta(spark, sf_dir).groupBy(labels.coherence_band(score).alias("band")).agg(
        F.count(F.lit(1)).alias("n")
    )


# -- topics and their words ---------------------------------------------------


@query("phi_weights", sql.with_(sql.PHI) + "select topic_id, term, round(weight, 9) as weight from phi")
def phi_weights(spark, sf_dir) -> DataFrame:
    return _rounded(fx.phi(spark, sf_dir), "weight", places=9)


@query(
    "w4_top_words",
    sql.with_(sql.PHI) + "select topic_id, rank::integer as rank, term, round(weight, 9) as weight from ranked where rank <= 20",
)
def w4(spark, sf_dir) -> DataFrame:
    return _rounded(topic_words.top_words(fx.phi(spark, sf_dir), 20), "weight", places=9)


@query(
    "m16_words_of_topic",
    sql.with_(sql.PHI) + "select term, round(weight, 9) as weight from ranked where topic_id = 2 and rank <= 10",
)
def m16(spark, sf_dir) -> DataFrame:
    return _rounded(topic_words.words_of_topic(fx.phi(spark, sf_dir), 2, 10), "weight", places=9)


@query(
    "m25_word_weights",
    sql.with_(sql.PHI) + "select topic_id, term, round(weight, 9) as weight from ranked where rank <= 50",
)
def m25(spark, sf_dir) -> DataFrame:
    return _rounded(topic_words.top_words(fx.phi(spark, sf_dir), 50).drop("rank"), "weight", places=9)


@query(
    "c11_auto_labels",
    sql.with_(sql.PHI)
    + """select topic_id, concat('Topic ', topic_id, ': ', string_agg(term, ', ' order by rank)) as label,
      concat('Topik ', topic_id, ': ', string_agg(term, ', ' order by rank)) as display_name
      from ranked where rank <= 3 group by 1""",
)
def c11(spark, sf_dir) -> DataFrame:
    info = topic_words.topic_info(fx.phi(spark, sf_dir), 20)
    name = labels.display_name(F.col("topic_id"), labels.first_words(F.col("top_words")))
    return info.select("topic_id", "label", name.alias("display_name"))


# labels taken from the data: the language with most documents in each topic's sources
_LABELS_SQL = """custom as (select topic_id, max_by(lang, (n, lang)) as label from (
  select cast(substr(source, 4) as int) % 6 as topic_id, lang, count(*) as n from documents group by 1, 2) group by 1)"""


def _custom_labels(spark, sf_dir) -> DataFrame:
    topic = (F.substring("source", 4, 9).cast("int") % fx.TOPICS).alias("topic_id")
    counts = fx.documents(spark, sf_dir).groupBy(topic, "lang").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("topic_id").agg(F.max_by("lang", F.struct("n", "lang")).alias("label"))


@query(
    "j4_labels_with_defaults",
    sql.with_(sql.PHI, _LABELS_SQL)
    + """select r.topic_id, coalesce(any_value(c.label), string_agg(term, ', ' order by rank)) as label
      from ranked r left join (select * from custom where topic_id % 2 = 0) c on c.topic_id = r.topic_id where rank <= 3 group by 1""",
)
def j4(spark, sf_dir) -> DataFrame:
    info = topic_words.topic_info(fx.phi(spark, sf_dir), 20)
    return topic_words.labels_with_defaults(info, _custom_labels(spark, sf_dir).where("topic_id % 2 = 0"))


@query("s12_label_store", sql.with_(_LABELS_SQL) + "select topic_id, case when topic_id = 1 then 'changed' else label end as label from custom")
def s12(spark, sf_dir) -> DataFrame:
    from corpusmill.runtime import scratch_path

    path = scratch_path(spark, "labels")
    tables.write_labels(_custom_labels(spark, sf_dir), path)
    tables.set_label(spark, path, 1, "changed")
    return tables.read_labels(spark, path)


@query(
    "c15_label_reset",
    sql.with_(sql.PHI) + "select topic_id, string_agg(term, ', ' order by rank) as label, false as has_labels from ranked where rank <= 3 group by 1",
)
def c15_reset(spark, sf_dir) -> DataFrame:
    """After a reset of the label file every topic has its default label again."""
    path = scratch_path(spark, "labels")
    tables.write_labels(_custom_labels(spark, sf_dir), path)
    tables.set_label(spark, path, 2, "changed")
    tables.reset_labels(spark, path)
    info = topic_words.topic_info(fx.phi(spark, sf_dir), 20)
    found = topic_words.labels_with_defaults(info, tables.read_labels(spark, path))
    return found.withColumn("has_labels", F.lit(tables.has_labels(spark, path)))


@query("c15_label_json", sql.with_(_LABELS_SQL) + "select topic_id, label from custom")
def c15(spark, sf_dir) -> DataFrame:
    return tables.parse_labels(tables.labels_json(_custom_labels(spark, sf_dir)))


@query(
    "s11_topics_json",
    sql.with_(sql.PHI)
    + """select topic_id, string_agg(term, ' ' order by rank) as words, round(sum(weight), 9) as mass
      from ranked where rank <= 20 group by 1""",
)
def s11(spark, sf_dir) -> DataFrame:
    from corpusmill.runtime import scratch_path

    path = scratch_path(spark, "topics-json")
    info = topic_words.topic_info(fx.phi(spark, sf_dir), 20).withColumn("coherence", F.lit(0.0))
    tables.write_topics_json(info, path)
    mass = F.aggregate("words", F.lit(0.0), lambda a, w: a + w["weight"])
    return tables.read_topics_json(spark, path).select(
        "topic_id", F.array_join("top_words", " ").alias("words"), F.round(mass, 9).alias("mass")
    )


_TOP20 = """, t20 as (select topic_id, list(term order by term) as w from ranked where rank <= 20 group by 1)"""


@query(
    "d8_topic_overlap",
    sql.with_(sql.PHI) + _TOP20
    + """ select a.topic_id as topic_a, b.topic_id as topic_b,
      array_to_string(list_sort(list_intersect(a.w, b.w)), ' ') as shared,
      array_to_string(list_filter(a.w, lambda x: not list_contains(b.w, x)), ' ') as only_a,
      array_to_string(list_filter(b.w, lambda x: not list_contains(a.w, x)), ' ') as only_b,
      round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) as jaccard_similarity
      from t20 a join t20 b on a.topic_id < b.topic_id""",
)
def d8(spark, sf_dir) -> DataFrame:
    pairs = topic_words.topic_overlap(fx.phi(spark, sf_dir), 20)
    return pairs.select(
        "topic_a",
        "topic_b",
        F.array_join("shared_words", " ").alias("shared"),
        F.array_join("unique_to_a", " ").alias("only_a"),
        F.array_join("unique_to_b", " ").alias("only_b"),
        F.round("jaccard_similarity", 6).alias("jaccard_similarity"),
    )


@query(
    "v6_overlap_of_two_topics",
    sql.with_(sql.PHI) + _TOP20
    + """ select len(list_intersect(a.w, b.w))::integer as n_shared from t20 a, t20 b where a.topic_id = 1 and b.topic_id = 4""",
)
def v6(spark, sf_dir) -> DataFrame:
    two = fx.phi(spark, sf_dir).where("topic_id in (1, 4)")
    return topic_words.topic_overlap(two, 20).select(F.size("shared_words").alias("n_shared"))


@query(
    "v5_topic_distances",
    sql.with_(sql.PHI)
    + """, p as (select a.topic_id as topic_a, b.topic_id as topic_b, a.weight as x, b.weight as y
      from phi a join phi b on a.term = b.term)
    select topic_a, topic_b, round(case when topic_a = topic_b then 0.0 else
      sqrt(greatest(0, sum(x * ln(2 * x / (x + y)) + y * ln(2 * y / (x + y))) / 2)) end, 6) as distance from p group by 1, 2""",
)
def v5(spark, sf_dir) -> DataFrame:
    return _rounded(topic_words.topic_distances(fx.phi(spark, sf_dir)), "distance")


@query(
    "j9_topic_pairs",
    sql.with_(sql.PHI)
    + """select a.topic_id as topic_a, b.topic_id as topic_b, round(sum(sqrt(a.weight * b.weight)), 6) as affinity
      from phi a join phi b on a.term = b.term and a.topic_id < b.topic_id group by 1, 2""",
)
def j9(spark, sf_dir) -> DataFrame:
    """Equi-join on the term with an order on the topics: at most K rows per term."""
    phi = fx.phi(spark, sf_dir)
    left = phi.select(F.col("topic_id").alias("topic_a"), "term", F.col("weight").alias("x"))
    right = phi.select(F.col("topic_id").alias("topic_b"), "term", F.col("weight").alias("y"))
    pairs = left.join(right, "term").where("topic_a < topic_b")
    return pairs.groupBy("topic_a", "topic_b").agg(F.round(F.sum(F.sqrt(F.col("x") * F.col("y"))), 6).alias("affinity"))


@query(
    "m26_topics_side_by_side",
    sql.with_(sql.PHI)
    + """select a.rank::integer as rank, a.term as word_a, round(a.weight, 9) as weight_a, b.term as word_b, round(b.weight, 9) as weight_b
      from ranked a join ranked b on a.rank = b.rank where a.topic_id = 0 and b.topic_id = 5 and a.rank <= 10""",
)
def m26(spark, sf_dir) -> DataFrame:
    both = topic_words.compare_topics(fx.phi(spark, sf_dir), 0, 5, 10)
    return _rounded(both, "weight_a", "weight_b", places=9)


_SHARES = """lengths as (select doc_id, len(tokens) as token_count from pdocs),
shares as (select topic_id, sum(prob * token_count) / (select sum(prob * token_count) from theta join lengths using (doc_id)) as share
  from theta join lengths using (doc_id) group by 1),
marg as (select phi.topic_id, term, weight, share, sum(weight * share) over (partition by term) as pt
  from phi join shares using (topic_id))"""


def _shares(spark, sf_dir) -> DataFrame:
    lengths = fx.plain_tokens(spark, sf_dir).select("doc_id", F.size("tokens").alias("token_count"))
    return topic_words.topic_shares(fx.theta(spark, sf_dir), lengths)


@query(
    "m24_term_relevance",
    sql.with_(sql.THETA, sql.PHI, _SHARES)
    + """, r as (select topic_id, term, weight, pt, 0.6 * ln(weight) + 0.4 * ln(weight / pt) as rel from marg)
    select topic_id, rank::integer as rank, term, round(rel, 6) as relevance from (
      select *, row_number() over (partition by topic_id order by rel desc, term) as rank from r) where rank <= 30""",
)
def m24(spark, sf_dir) -> DataFrame:
    out = topic_words.term_relevance(fx.phi(spark, sf_dir), _shares(spark, sf_dir), 30, 0.6)
    return _rounded(out.select("topic_id", "rank", "term", "relevance"), "relevance")


@query(
    "m24_term_saliency",
    sql.with_(sql.THETA, sql.PHI, _SHARES)
    + """select term, round(any_value(pt) * sum((weight * share / pt) * ln(weight / pt)), 9) as saliency
      from marg group by 1 order by any_value(pt) * sum((weight * share / pt) * ln(weight / pt)) desc, term limit 30""",
)
def m24b(spark, sf_dir) -> DataFrame:
    out = topic_words.term_saliency(fx.phi(spark, sf_dir), _shares(spark, sf_dir), 30)
    return _rounded(out.select("term", "saliency"), "saliency", places=9)


@query(
    "m24_topic_shares",
    sql.with_(sql.THETA, sql.PHI, _SHARES) + "select topic_id, round(share, 6) as share from shares",
)
def m24c(spark, sf_dir) -> DataFrame:
    return _rounded(_shares(spark, sf_dir), "share")


# -- coherence over the words of phi ------------------------------------------

_WINDOW, _WORDS = 110, 20

_COHERENCE_SQL = sql.PHI + f""",
tw as (select topic_id, term, rank as k from ranked where rank <= {_WORDS}),
tokd as (select doc_id, tokens, greatest(len(tokens) - {_WINDOW - 1}, 1) as nw from pdocs),
hits as (select doc_id, term, pos, nw from (
    select doc_id, nw, unnest(tokens) as term, generate_subscripts(tokens, 1) - 1 as pos from tokd)
  where term in (select term from tw)),
total as (select sum(nw)::double as n from tokd where doc_id in (select doc_id from hits)),
inside as (select distinct doc_id, term,
    unnest(generate_series(greatest(pos - {_WINDOW - 1}, 0), least(pos, nw - 1))) as win from hits),
single as (select term, count(*) as n from inside group by 1),
together as (select a.term as ta, b.term as tb, count(*) as n from inside a join inside b
  on a.doc_id = b.doc_id and a.win = b.win group by 1, 2),
npmi as (
  select a.topic_id, a.k as i, b.k as j, case when sa.n is null or sb.n is null then 0.0 else
    ln((coalesce(t.n, 0) / total.n + 1e-12) / ((sa.n / total.n) * (sb.n / total.n)))
    / -ln(coalesce(t.n, 0) / total.n + 1e-12) end as x
  from tw a join tw b on a.topic_id = b.topic_id cross join total
  left join single sa on sa.term = a.term left join single sb on sb.term = b.term
  left join together t on t.ta = a.term and t.tb = b.term),
summed as (select topic_id, j, sum(x) as s from npmi group by 1, 2),
per_word as (select topic_id, i, sum(x * s) / (sqrt(sum(x * x)) * sqrt(sum(s * s))) as c
  from npmi join summed using (topic_id, j) group by 1, 2),
per_topic as (select topic_id, avg(c) as coherence from per_word group by 1)
"""


def _phi_coherence(spark, sf_dir) -> DataFrame:
    ranked = topic_words.topic_info(fx.phi(spark, sf_dir), _WORDS).select("topic_id", "top_words")
    words = [(r["topic_id"], r["top_words"]) for r in ranked.orderBy("topic_id").collect()]
    counts = coherence.window_counts(fx.plain_tokens(spark, sf_dir), words, window=_WINDOW)
    return coherence.topic_coherence(materialize(counts, "windows"), _WORDS)


@query(
    "m17_coherence",
    sql.with_(_COHERENCE_SQL) + "select round(avg(coherence), 6) as coherence from per_topic",
)
def m17(spark, sf_dir) -> DataFrame:
    return _rounded(coherence.model_coherence(_phi_coherence(spark, sf_dir)), "coherence")


@query(
    "m18_coherence_by_topic",
    sql.with_(_COHERENCE_SQL) + "select topic_id, round(coherence, 6) as coherence from per_topic",
)
def m18(spark, sf_dir) -> DataFrame:
    return _rounded(_phi_coherence(spark, sf_dir), "coherence")


@query(
    "u3_window_counts",
    sql.with_(_COHERENCE_SQL)
    + """select topic_id, (k - 1)::integer as i, (k - 1)::integer as j, s.n as n from tw join single s using (term)
      union all select a.topic_id, (a.k - 1)::integer, (b.k - 1)::integer, t.n from tw a
        join tw b on a.topic_id = b.topic_id and a.k < b.k join together t on t.ta = a.term and t.tb = b.term
      union all select -1, 0, 0, n::bigint from total""",
)
def u3(spark, sf_dir) -> DataFrame:
    ranked = topic_words.topic_info(fx.phi(spark, sf_dir), _WORDS).select("topic_id", "top_words")
    words = [(r["topic_id"], r["top_words"]) for r in ranked.orderBy("topic_id").collect()]
    return coherence.window_counts(fx.plain_tokens(spark, sf_dir), words, window=_WINDOW)
