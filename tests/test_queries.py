"""Every registered query against its SQL; the others must run and give rows."""

import pytest
from pyspark.ml.feature import StopWordsRemover

import oracle
from __spark_entry__ import entry
from corpusmill import fixed_values as fixed
from corpusmill.plans import all_queries, sql

QUERIES, SQL = all_queries().QUERIES, all_queries().ORACLES
# at the smallest scale few words pass the dictionary filter, and streams may
# close no window, so an empty result is legitimate for these
MAY_BE_EMPTY = {"m9_phrase_scores", "t3_windowed_trend"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, sf_dir, name):
    assert oracle.difference(spark, con, sf_dir, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0 or name in MAY_BE_EMPTY


def test_default_stopwords(spark, con, sf_dir):
    english = StopWordsRemover.loadDefaultStopWords("english")
    stop = sql.quoted(sorted({*fixed.BUILT_IN_STOPWORDS, *fixed.DOMAIN_STOPWORDS, *english}))
    statement = f"select doc_id, array_to_string({sql.tokens(stop=stop)}, ' ') as words from documents"
    assert oracle.difference(spark, con, sf_dir, QUERIES["u1_default_stopwords"], statement) is None


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 50 and rows[0]["n"] >= rows[-1]["n"]
