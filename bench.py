"""Times the headline queries and prints one JSON line.

`BENCH_SF_DIR` names the input folder, `BENCH_CPUS` the number of local cores.
Every figure includes the action that computes the whole result. Tokens, merged
tokens and the model are stored by the steps that produce them and read by the
later ones, as in a real run.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession, functions as F  # noqa: E402

from corpusmill.operators import topics  # noqa: E402
from corpusmill.plans import all_queries, fixtures as fx  # noqa: E402
from corpusmill.settings import Settings  # noqa: E402

# name -> registered query that is run to the end
REGISTERED = {
    "harvest_xml": "s1_xml_records",
    "clean_records": "clean_records",
    "cleaning_ledger": "a15_cleaning_ledger",
    "missing_profile": "a1_missing_profile",
    "describe_lengths": "a3_describe_lengths",
    "most_common_words": "l2_most_common_words",
    "language_profile": "c7_margin_language",
    "phrase_scores": "m9_phrase_scores",
    "dictionary": "m13_filtered_dictionary",
    "bag_of_words": "m14_bag_of_words",
    "topic_prevalence": "a19_topic_prevalence",
    "topic_trends": "a21_topic_trends_by_year",
    "similar_documents": "v1_similar_documents",
    "topic_distances": "v5_topic_distances",
    "topic_overlap": "d8_topic_overlap",
    "term_relevance": "m24_term_relevance",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.serializer", "org.apache.spark.serializer.KryoSerializer")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}
    notes: dict[str, float] = {}

    def run(name, action):
        started = time.perf_counter()
        out = action()
        timings[name] = round(time.perf_counter() - started, 3)
        print(f"{name:24s} {timings[name]:8.3f}s", file=sys.stderr, flush=True)
        return out

    def finish(df):
        df.write.format("noop").mode("overwrite").save()

    queries = all_queries().QUERIES
    fx.documents(spark, sf_dir).count()  # start the executors
    fx.record_dump(spark, sf_dir)  # input of the first query, not part of it
    run("tokenize", lambda: fx.tokenized(spark, sf_dir).count())
    run("merge_phrases", lambda: fx.merged(spark, sf_dir).count())
    run("phi", lambda: fx.phi(spark, sf_dir).count())
    for name, registered in REGISTERED.items():
        run(name, lambda: finish(queries[registered](spark, sf_dir)))

    docs = fx.merged(spark, sf_dir)
    model = run("train_lda_12", lambda: topics.train(docs, 12, Settings(), with_coherence=False))
    run("coherence_12", lambda: topics.coherence_of(model, docs))
    run("document_topics_12", lambda: finish(model.theta(docs)))
    notes["documents"] = model.metadata.num_documents
    notes["tokens"] = docs.agg(F.sum(F.size("tokens"))).first()[0]
    notes["vocabulary"] = model.metadata.vocabulary_size
    notes["updates"] = model.metadata.updates
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": sf_dir.rsplit("sf", 1)[-1],
                "notes": notes,
            }
        )
    )


if __name__ == "__main__":
    main()
