"""Streaming queries, run once over what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusmill.functions import vectors
from corpusmill.operators import alignment
from corpusmill.plans import fixtures as fx, planted, sql
from corpusmill.plans.registry import query
from corpusmill.runtime import scratch_path
from corpusmill.sources import tables
from corpusmill.streaming import flows


def _stream(spark, sf_dir, name: str) -> DataFrame:
    schema = fx.table(spark, sf_dir, name).schema
    return flows.read_new_files(spark, f"{sf_dir}/{name}.parquet", schema)


@query(
    "t1_first_arrivals",
    """with keyed as (select concat(user_id, ' ', event_type, ' ', strftime(ts, '%Y-%m-%d')) as key, date_trunc('day', ts) as day from events)
    select key, count(distinct day) as kept, min(day) as day from keyed group by 1""",
)
def t1(spark, sf_dir) -> DataFrame:
    """The first event of every user and type on every day, by event time; state is kept for two days."""
    events = _stream(spark, sf_dir, "events").withColumn("ts", flows.utc_instant("ts"))
    day = F.date_format(flows.utc_wall_clock("ts"), "yyyy-MM-dd")
    keyed = events.select(F.concat_ws(" ", "user_id", "event_type", day).alias("key"), "ts")
    first = flows.first_arrivals(keyed, "key", "ts", "2 days")
    path = scratch_path(spark, "arrivals")
    flows.run_available(first, path, scratch_path(spark, "state"))
    stored = spark.read.schema(first.schema).parquet(path)
    wall = F.date_trunc("day", flows.utc_wall_clock("ts")).cast("timestamp_ntz")
    return stored.groupBy("key").agg(F.count(F.lit(1)).alias("kept"), F.min(wall).alias("day"))


@query(
    "t2_score_new_documents",
    sql.with_(planted.SQL) + "select doc_id, group_id from plead",
)
def t2(spark, sf_dir) -> DataFrame:
    """The planted documents as they arrive, scored with the stored model: the group of each."""
    place = scratch_path(spark, "model")
    tables.save_model(planted.model(spark, sf_dir), spark, place)
    model = tables.load_model(spark, place)
    arriving = planted.numbered(_stream(spark, sf_dir, "documents"))
    path = scratch_path(spark, "scores")
    flows.run_batches(arriving, model.theta, path, scratch_path(spark, "state"))
    best = vectors.argmax(F.col("probs"))
    group = alignment.renamed(best, planted.groups(spark, sf_dir)).alias("group_id")
    return spark.read.parquet(path).select("doc_id", group)


@query(
    "t3_windowed_trend",
    """select date_trunc('day', ts) as window_start, event_type, count(*) as n, round(avg(value), 6) as mean_value
      from events group by 1, 2""",
)
def t3(spark, sf_dir) -> DataFrame:
    """All windows, the open ones as they stand."""
    events = _stream(spark, sf_dir, "events").withColumn("ts", flows.utc_instant("ts"))
    trend = flows.windowed_means(events, ["event_type"], "value")
    path = scratch_path(spark, "trend")
    flows.run_updates(trend, path, scratch_path(spark, "state"))
    return flows.latest_rows(spark, path, ["window_start", "event_type"]).select(
        flows.utc_wall_clock("window_start").alias("window_start"),
        "event_type",
        "n",
        F.round("mean_value", 6).alias("mean_value"),
    )


@query(
    "t4_running_counts",
    "select lang, count(*) as n from documents group by 1",
)
def t4(spark, sf_dir) -> DataFrame:
    counts = flows.running_counts(_stream(spark, sf_dir, "documents"), "lang")
    path = scratch_path(spark, "counts")
    flows.run_batches(counts, lambda batch: batch, path, scratch_path(spark, "state"), "complete")
    return flows.latest_batch(spark, path)
