"""Queries over records: sources, cleaning, deduplication and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusmill import fixed_values as fixed
from corpusmill.functions import dates, text
from corpusmill.operators import analysis, cleaning, dedup, profile
from corpusmill.plans import fixtures as fx, sql
from corpusmill.plans.registry import query
from corpusmill.runtime import scratch_path
from corpusmill.sources import records, tables

_RAW = ", ".join(fixed.RAW_COLUMNS)

# -- sources and sinks --------------------------------------------------------

_DUMPED = """
dump as (select *, doc_id % 13 = 0 as deleted,
  strftime(date '2024-01-01' + (doc_id % 365)::int, '%Y-%m-%d') as day from corpus)
"""
_DUMP_FIELDS = """
  identifier, coalesce(title, '') as title, coalesce(abstract, '') as abstract,
  coalesce(authors, '') as authors, coalesce(date, '') as date,
  coalesce(subjects, '') as subjects, coalesce(publisher, '') as publisher,
  coalesce(types, '') as types, coalesce(language, '') as language,
  coalesce(source, '') as source
"""


@query(
    "s1_xml_records",
    sql.with_(sql.CORPUS, _DUMPED) + f"select {_DUMP_FIELDS} from dump where not deleted",
)
def s1(spark, sf_dir) -> DataFrame:
    return records.load_records(spark, fx.record_dump(spark, sf_dir))


@query(
    "s2_list_sets",
    sql.with_(sql.CORPUS)
    + """select set_spec, count(*) as n from (
      select 'all' as set_spec from corpus
      union all select concat('col_', doc_id % 4) from corpus where doc_id % 3 = 0)
    group by 1""",
)
def s2(spark, sf_dir) -> DataFrame:
    return records.list_sets(records.read_records(spark, fx.record_dump(spark, sf_dir)))


@query(
    "s3_records_table",
    sql.with_(sql.CORPUS, _DUMPED)
    + """select publisher, count(*) as n, count_if(title = '') as no_title,
      count_if(abstract = '') as no_abstract from (
      select publisher, coalesce(title, '') as title, coalesce(abstract, '') as abstract
      from dump where not deleted) group by 1""",
)
def s3(spark, sf_dir) -> DataFrame:
    table = records.load_records(spark, fx.record_dump(spark, sf_dir))
    return table.groupBy("publisher").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("title") == "").alias("no_title"),
        F.count_if(F.col("abstract") == "").alias("no_abstract"),
    )


@query(
    "s4_raw_csv_round_trip",
    sql.with_(sql.CORPUS) + "select " + ", ".join(f"nullif({c}, '') as {c}" for c in fixed.RAW_COLUMNS) + " from corpus",
)
def s4(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "raw-csv")
    tables.write_csv(fx.corpus(spark, sf_dir).select(*fixed.RAW_COLUMNS), path)
    return tables.read_csv(spark, path)


@query(
    "s5_csv_source",
    sql.with_(sql.CORPUS) + "select publisher, language, count(*) as n, sum(length(abstract))::bigint as chars from corpus group by 1, 2",
)
def s5(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "raw-csv")
    tables.write_csv(fx.corpus(spark, sf_dir).select(*fixed.RAW_COLUMNS), path)
    return (
        tables.read_csv(spark, path)
        .groupBy("publisher", "language")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("abstract")).alias("chars"))
    )


_CLEAN = (
    f"identifier, {sql.normalized('title')} as title, {sql.normalized('abstract')} as abstract, "
    f"{sql.normalized('authors')} as authors, date, year(pd)::integer as year, "
    f"{sql.normalized('subjects')} as subjects, publisher, types, language"
)
_FILLED = "* replace (" + ", ".join(
    f"case when {sql.blank(c)} then 'Tidak Diketahui' else {c} end as {c}" for c in fixed.FILL_COLUMNS
) + f"), {sql.parsed_date()} as pd"
_CLEAN_SQL = f"""
filled as (select {_FILLED} from s4 where not {sql.blank('title')} and not {sql.blank('abstract')}),
clean as (select doc_id, {_CLEAN} from filled where {sql.words('abstract')} >= 20)
"""


@query(
    "s6_clean_store_round_trip",
    sql.with_(sql.CORPUS, sql.DEDUP, _CLEAN_SQL)
    + "select " + ", ".join("nullif(date, '') as date" if c == "date" else c for c in fixed.CLEAN_COLUMNS) + " from clean",
)
def s6(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "clean")
    clean = cleaning.clean_records(fx.corpus(spark, sf_dir))
    tables.write_store(clean, path)
    csv = scratch_path(spark, "clean-csv")
    tables.write_csv(spark.read.parquet(path), csv)
    return tables.read_csv(spark, csv, tables.CLEAN_SCHEMA)


@query(
    "s7_processed_store",
    sql.with_(sql.MERGED)
    + "select doc_id, count(*)::integer as token_count, string_agg(term, ' ' order by pos) as words from m group by doc_id",
)
def s7(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "processed")
    tables.write_store(fx.merged(spark, sf_dir).withColumn("token_count", F.size("tokens")), path)
    return spark.read.parquet(path).select("doc_id", "token_count", F.array_join("tokens", " ").alias("words"))


@query(
    "s8_metadata_csv",
    sql.with_(sql.MERGED)
    + "select doc_id, any_value(lang) as lang, any_value(source) as source, count(*)::integer as token_count from m join docs using (doc_id) group by doc_id",
)
def s8(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "metadata-csv")
    processed = fx.merged(spark, sf_dir).withColumn("token_count", F.size("tokens"))
    tables.write_metadata_csv(processed, path)
    from pyspark.sql.types import StructType

    schema = StructType([f for f in processed.schema if f.name != "tokens"])
    return tables.read_csv(spark, path, schema)


@query(
    "s13_bag_of_words_store",
    sql.with_(sql.TOKENS)
    + """, t as (select doc_id, unnest(tokens) as term from docs),
    dic as (select term, row_number() over (order by term) - 1 as term_id from t group by term
      having count(distinct doc_id) >= 20
         and count(distinct doc_id) <= floor(0.5 * (select count(*) from docs)))
    select doc_id, term_id::integer as term_id, count(*) as n from t join dic using (term) group by 1, 2""",
)
def s13(spark, sf_dir) -> DataFrame:
    from corpusmill.operators import vocabulary
    from corpusmill.runtime import materialize

    docs = fx.tokenized(spark, sf_dir)
    dictionary = materialize(vocabulary.build_dictionary(docs), "dictionary")
    return materialize(vocabulary.bag_of_words(docs, dictionary), "bow")


# -- projections and filters --------------------------------------------------


@query(
    "f1_drop_deleted",
    sql.with_(sql.CORPUS, _DUMPED) + "select identifier, concat(day, 'T00:00:00Z') as datestamp from dump where not deleted",
)
def f1(spark, sf_dir) -> DataFrame:
    raw = records.read_records(spark, fx.record_dump(spark, sf_dir))
    return records.select_records(raw).select("header.identifier", "header.datestamp")


@query(
    "f2_selective_harvest",
    sql.with_(sql.CORPUS, _DUMPED)
    + """select identifier, coalesce(date, '') as date from dump where not deleted
      and doc_id % 3 = 0 and doc_id % 4 = 1 and day between '2024-02-01' and '2024-09-30'""",
)
def f2(spark, sf_dir) -> DataFrame:
    return records.load_records(
        spark, fx.record_dump(spark, sf_dir), "col_1", "2024-02-01", "2024-09-30"
    ).select("identifier", "date")


@query(
    "f3_first_value",
    sql.with_(sql.CORPUS) + "select ord, coalesce(string_split(authors, '; ')[1], '') as first_author from corpus",
)
def f3(spark, sf_dir) -> DataFrame:
    return fx.corpus(spark, sf_dir).select(
        "ord", records.first_value(F.split("authors", "; ")).alias("first_author")
    )


@query(
    "f4_join_values",
    sql.with_(sql.CORPUS)
    + "select ord, coalesce(array_to_string(list_filter(list_transform(string_split(subjects, ';'), lambda s: trim(s)), lambda s: s <> ''), '; '), '') as subjects from corpus",
)
def f4(spark, sf_dir) -> DataFrame:
    return fx.corpus(spark, sf_dir).select(
        "ord", records.joined_values(text.split_list("subjects")).alias("subjects")
    )


@query(
    "f5_require_title_abstract",
    sql.with_(sql.CORPUS)
    + f"select ord, identifier from corpus where not {sql.blank('title')} and not {sql.blank('abstract')}",
)
def f5(spark, sf_dir) -> DataFrame:
    return cleaning.require_text(fx.corpus(spark, sf_dir)).select("ord", "identifier")


@query(
    "f6_abstract_long_enough",
    sql.with_(sql.CORPUS) + f"select ord, {sql.words('abstract')}::integer as words from corpus where {sql.words('abstract')} >= 20",
)
def f6(spark, sf_dir) -> DataFrame:
    return cleaning.long_enough(fx.corpus(spark, sf_dir)).select(
        "ord", text.word_count("abstract").alias("words")
    )


@query(
    "f7_short_abstracts",
    sql.with_(sql.CORPUS)
    + f"""select count(*) as n, count_if({sql.words('abstract')} < 50) as below_50,
      count_if({sql.words('abstract')} < 20) as below_20, count_if({sql.blank('abstract')}) as empty from corpus""",
)
def f7(spark, sf_dir) -> DataFrame:
    return profile.short_texts(fx.corpus(spark, sf_dir))


@query(
    "f8_fill_missing",
    sql.with_(sql.CORPUS) + "select ord, " + ", ".join(
        f"case when {sql.blank(c)} then 'Tidak Diketahui' else {c} end as {c}" for c in fixed.FILL_COLUMNS
    ) + " from corpus",
)
def f8(spark, sf_dir) -> DataFrame:
    return cleaning.fill_missing(fx.corpus(spark, sf_dir)).select("ord", *fixed.FILL_COLUMNS)


@query(
    "f9_fill_text",
    sql.with_(sql.CORPUS) + "select ord, coalesce(abstract, '') as abstract from corpus",
)
def f9(spark, sf_dir) -> DataFrame:
    return fx.corpus(spark, sf_dir).select("ord", text.text_of("abstract").alias("abstract"))


@query(
    "f10_select_present",
    sql.with_(sql.CORPUS) + "select " + ", ".join(c for c in fixed.CLEAN_COLUMNS if c != "year") + " from corpus",
)
def f10(spark, sf_dir) -> DataFrame:
    return cleaning.select_present(fx.corpus(spark, sf_dir))


@query(
    "f11_drop_helpers",
    sql.with_(sql.CORPUS) + "select ord, identifier, title from corpus",
)
def f11(spark, sf_dir) -> DataFrame:
    helped = fx.corpus(spark, sf_dir).select(
        "ord", "identifier", "title", text.char_length("title").alias("title_length")
    )
    return helped.drop("title_length", "detected_language")


@query(
    "f14_keyword_search",
    sql.with_(sql.CORPUS)
    + """select ord, identifier from corpus where contains(lower(coalesce(title, '')), 'tion')
      or contains(lower(coalesce(abstract, '')), 'tion')""",
)
def f14(spark, sf_dir) -> DataFrame:
    return (
        fx.corpus(spark, sf_dir)
        .where(text.contains_text(["title", "abstract"], "Tion"))
        .select("ord", "identifier")
    )


@query(
    "f18_unreadable_dates",
    sql.with_(sql.CORPUS)
    + f"select ord, date from corpus where not {sql.blank('date')} and {sql.parsed_date()} is null order by ord limit 10",
)
def f18(spark, sf_dir) -> DataFrame:
    return profile.unreadable_dates(fx.corpus(spark, sf_dir))


@query(
    "f19_repeatable_sample",
    sql.with_(sql.CORPUS)
    + "select ord, identifier, title from corpus where length(abstract) > 200 order by md5(concat('42:', ord)), ord limit 10",
)
def f19(spark, sf_dir) -> DataFrame:
    long = fx.corpus(spark, sf_dir).where(F.length("abstract") > 200)
    return profile.repeatable_sample(long.select("ord", "identifier", "title"), "ord", 10)


# -- deduplication ------------------------------------------------------------

_STAGES = {
    "d1_exact_duplicates": (1, "s1"),
    "d2_keep_first_identifier": (2, "s2"),
    "d3_keep_first_title": (3, "s3"),
    "d4_keep_first_abstract": (4, "s4"),
}


def _dedup_query(stages: int):
    def run(spark, sf_dir) -> DataFrame:
        kept = dedup.keep_first(fx.corpus(spark, sf_dir), stages=dedup.STAGES[:stages])
        return kept.select("ord", "identifier", "title")

    return run


for _name, (_n, _view) in _STAGES.items():
    query(
        _name, sql.with_(sql.CORPUS, sql.DEDUP) + f"select ord, identifier, title from {_view}"
    )(_dedup_query(_n))


@query(
    "d5_duplicate_counts",
    sql.with_(sql.CORPUS)
    + "select kind, duplicates, round(duplicates * 100.0 / (select count(*) from corpus), 6) as duplicate_pct from ("
    + " union all ".join(
        f"select '{kind}' as kind, (select count(*) from corpus) - (select count(*) from (select distinct {cols} from corpus)) as duplicates"
        for kind, cols in (
            ("all columns", _RAW),
            ("identifier", "identifier"),
            ("title", "title"),
            ("abstract", "abstract"),
        )
    )
    + ")",
)
def d5(spark, sf_dir) -> DataFrame:
    return dedup.duplicate_counts(fx.corpus(spark, sf_dir)).withColumn(
        "duplicate_pct", F.round("duplicate_pct", 6)
    )


for _column in ("title", "abstract"):
    query(
        f"d6_most_repeated_{_column}s",
        sql.with_(sql.CORPUS)
        + f"select {_column} as value, count(*) as n from corpus where {_column} is not null "
        "group by 1 having count(*) > 1 order by n desc, min(ord) limit 10",
    )(lambda spark, sf_dir, c=_column: dedup.most_repeated(fx.corpus(spark, sf_dir), c))


# -- profiles -----------------------------------------------------------------


@query(
    "a1_missing_profile",
    sql.with_(sql.CORPUS)
    + "select *, case when missing_pct > 50 then 'high' when missing_pct > 20 then 'medium' else 'low' end as severity from ("
    + " union all ".join(
        f"select '{c}' as column_name, count_if({sql.blank(c)}) as missing_count, "
        f"round(count_if({sql.blank(c)}) * 100.0 / count(*), 6) as missing_pct, "
        f"count(*) - count_if({sql.blank(c)}) as non_null_count from corpus"
        for c in fixed.RAW_COLUMNS
    )
    + ")",
)
def a1(spark, sf_dir) -> DataFrame:
    return profile.missing_profile(fx.corpus(spark, sf_dir), fixed.RAW_COLUMNS).withColumn(
        "missing_pct", F.round("missing_pct", 6)
    )


@query(
    "a2_required_check",
    sql.with_(sql.CORPUS)
    + f"""select count_if({sql.blank('title')}) as missing_title,
      count_if({sql.blank('abstract')}) as missing_abstract,
      count_if({sql.blank('title')}) + count_if({sql.blank('abstract')}) = 0 as complete from corpus""",
)
def a2(spark, sf_dir) -> DataFrame:
    return profile.required_check(fx.corpus(spark, sf_dir))


_MEASURES = {
    "title_length": "length(coalesce(title, ''))",
    "title_words": sql.words("title"),
    "abstract_length": "length(coalesce(abstract, ''))",
    "abstract_words": sql.words("abstract"),
}
_STATS = """count(x) as n, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as std,
  min(x)::double as min, round(quantile_cont(x, 0.25), 6) as q25, round(quantile_cont(x, 0.5), 6) as median,
  round(quantile_cont(x, 0.75), 6) as q75, max(x)::double as max"""


def rounded_stats(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "median", "q75")})


@query(
    "a3_describe_lengths",
    sql.with_(sql.CORPUS)
    + " union all ".join(
        f"select '{m}' as measure, {_STATS} from (select ({e})::double as x from corpus)" for m, e in _MEASURES.items()
    ),
)
def a3(spark, sf_dir) -> DataFrame:
    return rounded_stats(profile.describe(fx.corpus(spark, sf_dir), profile.text_lengths()))


@query(
    "a4_medians",
    sql.with_(sql.CORPUS)
    + "select " + ", ".join(f"median({e})::double as {m}" for m, e in _MEASURES.items()) + " from corpus",
)
def a4(spark, sf_dir) -> DataFrame:
    return profile.medians(fx.corpus(spark, sf_dir), profile.text_lengths())


@query(
    "a5_length_histogram",
    sql.with_(sql.CORPUS)
    + """, v as (select length(coalesce(abstract, ''))::double as x from corpus),
    e as (select min(x) as lo, (max(x) - min(x)) / 50 as wd from v),
    b as (select least(floor((x - lo) / wd), 49)::bigint as bin, count(*) as n from v, e group by 1)
    select k as bin, round(lo + k * wd, 6) as lower, round(lo + (k + 1) * wd, 6) as upper,
      coalesce(n, 0) as n from range(50) t(k) cross join e left join b on b.bin = k""",
)
def a5(spark, sf_dir) -> DataFrame:
    bins = profile.histogram(fx.corpus(spark, sf_dir), text.char_length("abstract"), 50)
    return bins.withColumns({c: F.round(c, 6) for c in ("lower", "upper")})


@query(
    "a6_value_counts",
    sql.with_(sql.CORPUS)
    + """select language as value, count(*) as n, round(count(*) * 100.0 / (select count(*) from corpus), 6) as pct
      from corpus where language is not null group by 1""",
)
def a6(spark, sf_dir) -> DataFrame:
    return profile.value_counts(fx.corpus(spark, sf_dir), "language").withColumn("pct", F.round("pct", 6))


@query(
    "a7_busiest_year",
    sql.with_(sql.CORPUS)
    + f""", y as (select year({sql.parsed_date()})::integer as year from corpus),
    c as (select year, count(*) as n from y where year is not null group by 1)
    select min(year) as first_year, max(year) as last_year,
      (select year from c order by n desc, year limit 1) as busiest_year, max(n) as busiest_n from c""",
)
def a7(spark, sf_dir) -> DataFrame:
    return profile.busiest_year(fx.corpus(spark, sf_dir), dates.year_of("date"))


@query(
    "a8_date_success",
    sql.with_(sql.CORPUS)
    + f"""select count(d) as valid, count(*) - count(d) as invalid,
      round(count(d) * 100.0 / count(*), 6) as valid_pct, min(d) as earliest, max(d) as latest
      from (select {sql.parsed_date()} as d from corpus)""",
)
def a8(spark, sf_dir) -> DataFrame:
    return profile.date_success(fx.corpus(spark, sf_dir)).withColumn("valid_pct", F.round("valid_pct", 6))


_QUICK = {
    side: " + ".join(
        f"contains(concat(' ', lower(coalesce(text, '')), ' '), ' {w} ')::int" for w in words
    )
    for side, words in (
        ("qi", fixed.QUICK_INDONESIAN),
        ("qe", fixed.QUICK_ENGLISH),
        ("mi", fixed.MARGIN_INDONESIAN),
        ("me", fixed.MARGIN_ENGLISH),
    )
}
QUICK_SQL = f"""quick as (select doc_id, case when coalesce(text, '') = '' then 'unknown' when a > b then 'indonesian'
  when b > a then 'english' else 'mixed/unknown' end as detected
  from (select doc_id, text, {_QUICK['qi']} as a, {_QUICK['qe']} as b from documents))"""
MARGIN_SQL = f"""guess as (select doc_id, text, case when coalesce(text, '') = '' then 'unknown' when a > b + 2 then 'Indonesian'
  when b > a + 2 then 'English' else 'Mixed/Unknown' end as detected
  from (select doc_id, text, {_QUICK['mi']} as a, {_QUICK['me']} as b from documents))"""


@query(
    "a9_primary_language",
    sql.with_(QUICK_SQL) + "select detected as value, count(*) as n from quick group by 1 order by n desc, value limit 1",
)
def a9(spark, sf_dir) -> DataFrame:
    return profile.top_value(fx.texts(spark, sf_dir), text.quick_language("text"))


@query(
    "a10_subject_counts",
    sql.with_(sql.CORPUS)
    + """select subject, count(*) as n from (select trim(unnest(string_split(subjects, ';'))) as subject from corpus)
      where subject <> '' group by 1""",
)
def a10(spark, sf_dir) -> DataFrame:
    return profile.subject_counts(fx.corpus(spark, sf_dir))


@query(
    "a10_subject_coverage",
    sql.with_(sql.CORPUS)
    + f"""select count(*) as n, count_if(not {sql.blank('subjects')}) as with_subjects,
      round(count_if(not {sql.blank('subjects')}) * 100.0 / count(*), 6) as coverage_pct,
      (select count(distinct s) from (select trim(unnest(string_split(subjects, ';'))) as s from corpus) where s <> '')
      as distinct_subjects from corpus""",
)
def a10b(spark, sf_dir) -> DataFrame:
    return profile.subject_coverage(fx.corpus(spark, sf_dir)).withColumn("coverage_pct", F.round("coverage_pct", 6))


@query(
    "a15_cleaning_ledger",
    sql.with_(sql.CORPUS, sql.DEDUP)
    + f""", l as (
      select 0 as step, 'initial' as stage, (select count(*) from corpus) as rows_left
      union all select 1, 'exact duplicates removed', (select count(*) from s1)
      union all select 2, 'identifier duplicates removed', (select count(*) from s2)
      union all select 3, 'title duplicates removed', (select count(*) from s3)
      union all select 4, 'abstract duplicates removed', (select count(*) from s4)
      union all select 5, 'title present', (select count(*) from s4 where not {sql.blank('title')})
      union all select 6, 'abstract present', (select count(*) from s4 where not {sql.blank('title')} and not {sql.blank('abstract')})
      union all select 7, 'abstract long enough', (select count(*) from s4 where not {sql.blank('title')} and not {sql.blank('abstract')}
        and {sql.words('abstract')} >= 20))
    select step, stage, rows_left, coalesce(lag(rows_left) over (order by step), rows_left) - rows_left as rows_removed,
      round(rows_left * 100.0 / (select count(*) from corpus), 6) as left_pct from l""",
)
def a15(spark, sf_dir) -> DataFrame:
    return cleaning.cleaning_ledger(fx.corpus(spark, sf_dir)).withColumn("left_pct", F.round("left_pct", 6))


@query(
    "a16_quality_findings",
    sql.with_(sql.CORPUS)
    + " union all ".join(
        f"select 'missing {c}' as finding, count_if({sql.blank(c)}) as n from corpus "
        f"having count_if({sql.blank(c)}) * 100.0 / count(*) > 5"
        for c in ("title", "abstract", "date", "authors")
    )
    + "".join(
        f" union all select 'duplicate {c}', n from (select (select count(*) from corpus) - "
        f"(select count(*) from (select distinct {c} from corpus)) as n) where n > 0"
        for c in ("title", "abstract")
    )
    + f" union all select 'short abstract', n from (select count_if({sql.words('abstract')} < 20) as n from corpus) where n > 0",
)
def a16(spark, sf_dir) -> DataFrame:
    return profile.quality_findings(fx.corpus(spark, sf_dir))


@query(
    "a17_recommendations",
    sql.with_(MARGIN_SQL)
    + f"""select (select detected from guess group by 1 order by count(*) desc, detected limit 1) as primary_language,
      round(avg({sql.words('text')}), 6) as mean_words,
      count_if(detected = 'English') > count(*) * 0.1 as add_english_stopwords from guess""",
)
def a17(spark, sf_dir) -> DataFrame:
    return profile.recommendations(fx.texts(spark, sf_dir), "text").withColumn(
        "mean_words", F.round("mean_words", 6)
    )


@query(
    "a26_overview",
    sql.with_(sql.CORPUS)
    + """select 'rows' as item, count(*) as n from corpus
      union all select 'columns', 12
      union all select concat('first ', identifier), ord from (select * from corpus order by ord limit 5)""",
)
def a26(spark, sf_dir) -> DataFrame:
    df = fx.corpus(spark, sf_dir)
    totals = profile.overview(df).select(
        F.inline(
            F.array(
                F.struct(F.lit("rows").alias("item"), F.col("n_rows").alias("n")),
                F.struct(F.lit("columns").alias("item"), F.col("n_columns").cast("long").alias("n")),
            )
        )
    )
    first = df.orderBy("ord").limit(5).select(
        F.concat(F.lit("first "), "identifier").alias("item"), F.col("ord").alias("n")
    )
    return totals.unionByName(first)


@query(
    "a26_column_types",
    " union all ".join(
        f"select {i} as position, '{c}' as column_name, '{t}' as type, count({c}) as non_null from documents"
        for i, (c, t) in enumerate((("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")))
    ),
)
def a26b(spark, sf_dir) -> DataFrame:
    return profile.column_types(fx.documents(spark, sf_dir))


# -- windows, order and pages -------------------------------------------------


@query(
    "w6_recent_years",
    sql.with_(sql.CORPUS)
    + f""", c as (select year({sql.parsed_date()})::integer as year, count(*) as n from corpus group by 1)
    select year, n, dense_rank() over (order by year desc) <= 5 as is_recent from c where year is not null""",
)
def w6(spark, sf_dir) -> DataFrame:
    return profile.year_distribution(fx.corpus(spark, sf_dir), dates.year_of("date"))


@query(
    "l1_record_limit",
    sql.with_(sql.CORPUS, _DUMPED)
    + f"""select {_DUMP_FIELDS} from dump where not deleted order by {', '.join(fixed.RAW_COLUMNS)} limit 25""",
)
def l1(spark, sf_dir) -> DataFrame:
    """The first records of the whole dump; repeated identifiers go by their other columns."""
    return records.load_records(spark, fx.record_dump(spark, sf_dir), max_records=25)


@query(
    "l3_sorted_missing_profile",
    sql.with_(sql.CORPUS)
    + "select column_name, row_number() over (order by missing_pct desc, column_name)::integer as position from ("
    + " union all ".join(
        f"select '{c}' as column_name, count_if({sql.blank(c)}) * 100.0 / count(*) as missing_pct from corpus"
        for c in fixed.RAW_COLUMNS
    )
    + ")",
)
def l3(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    ordered = profile.missing_profile(fx.corpus(spark, sf_dir), fixed.RAW_COLUMNS)
    # one row per column of the table
    by_gap = Window.orderBy(F.desc("missing_pct"), "column_name")
    return ordered.select("column_name", F.row_number().over(by_gap).alias("position"))


@query(
    "l7_page",
    sql.with_(sql.CORPUS) + "select ord, identifier, title from corpus order by ord limit 20 offset 40",
)
def l7(spark, sf_dir) -> DataFrame:
    """The third page, each asked for with the cursor of the one before."""
    rows = fx.corpus(spark, sf_dir).select("ord", "identifier", "title")
    after = None
    for _ in range(2):
        after = analysis.cursor(analysis.page_after(rows, after, 20, "ord", "ord"), "ord", "ord")
    return analysis.page_after(rows, after, 20, "ord", "ord")


@query(
    "l7_sorted_page",
    sql.with_(sql.CORPUS) + "select ord, title from corpus order by title desc nulls last, ord limit 25 offset 50",
)
def l7_sorted(spark, sf_dir) -> DataFrame:
    """Sorted by a column with repeated and missing values."""
    rows = fx.corpus(spark, sf_dir).select("ord", "title")
    after = None
    for _ in range(2):
        after = analysis.cursor(analysis.page_after(rows, after, 25, "title", "ord", True), "title", "ord")
    return analysis.page_after(rows, after, 25, "title", "ord", True)


@query(
    "l8_sorted_page",
    sql.with_(sql.CORPUS)
    + "select ord, title, identifier from corpus order by title asc nulls last, ord limit 20",
)
def l8(spark, sf_dir) -> DataFrame:
    rows = fx.corpus(spark, sf_dir).select("ord", "title", "identifier")
    return analysis.sort_by(rows, "title", "ord").limit(20)


# -- scalar functions over records --------------------------------------------


@query(
    "c2_normalize_text",
    sql.with_(sql.CORPUS)
    + f"select ord, {sql.normalized('title')} as title, {sql.normalized('abstract')} as abstract from corpus",
)
def c2(spark, sf_dir) -> DataFrame:
    return cleaning.normalize_columns(fx.corpus(spark, sf_dir)).select("ord", "title", "abstract")


@query(
    "c4_parse_date",
    sql.with_(sql.CORPUS)
    + f"select ord, date, {sql.parsed_date()} as parsed, year({sql.parsed_date()})::integer as year from corpus",
)
def c4(spark, sf_dir) -> DataFrame:
    return cleaning.add_dates(fx.corpus(spark, sf_dir)).select(
        "ord", "date", F.col("parsed_date").cast("date").alias("parsed"), "year"
    )


@query(
    "c6_quick_language",
    sql.with_(QUICK_SQL) + "select doc_id, detected from quick",
)
def c6(spark, sf_dir) -> DataFrame:
    return fx.texts(spark, sf_dir).select("doc_id", text.quick_language("text").alias("detected"))


@query(
    "c7_margin_language",
    sql.with_(MARGIN_SQL) + "select detected as value, count(*) as n, round(count(*) * 100.0 / (select count(*) from guess), 6) as pct from guess group by 1",
)
def c7(spark, sf_dir) -> DataFrame:
    return profile.value_counts(fx.texts(spark, sf_dir), text.margin_language("text")).withColumn(
        "pct", F.round("pct", 6)
    )


@query(
    "c9_split_subjects",
    sql.with_(sql.CORPUS)
    + """select ord, array_to_string(p, '|') as pieces, array_to_string(list_filter(p, lambda x: x <> ''), '|') as kept
      from (select ord, case when subjects is null then [] else list_transform(string_split(subjects, ';'), lambda x: trim(x)) end as p from corpus)""",
)
def c9(spark, sf_dir) -> DataFrame:
    return fx.corpus(spark, sf_dir).select(
        "ord",
        F.array_join(text.split_list("subjects", keep_empty=True), "|").alias("pieces"),
        F.array_join(text.split_list("subjects"), "|").alias("kept"),
    )


@query(
    "c13_percentages",
    sql.with_(sql.CORPUS)
    + """select publisher, count(*) as n, round(count(*) * 100.0 / (select count(*) from corpus), 6) as pct from corpus
      where publisher is not null group by 1""",
)
def c13(spark, sf_dir) -> DataFrame:
    return profile.value_counts(fx.corpus(spark, sf_dir), "publisher", "publisher").withColumn(
        "pct", F.round("pct", 6)
    )


@query(
    "clean_records",
    sql.with_(sql.CORPUS, sql.DEDUP, _CLEAN_SQL) + "select * from clean",
)
def clean(spark, sf_dir) -> DataFrame:
    return cleaning.clean_records(fx.corpus(spark, sf_dir), keep=["doc_id"])


@query(
    "c5_dates_per_year",
    sql.with_(sql.CORPUS)
    + f"select year({sql.parsed_date()})::integer as year, count(*) as n from corpus group by 1",
)
def c5(spark, sf_dir) -> DataFrame:
    """Unreadable dates become null, value by value."""
    return (
        fx.corpus(spark, sf_dir)
        .groupBy(dates.year_of("date").alias("year"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "w1_keep_first_per_abstract",
    sql.with_(sql.CORPUS)
    + "select ord from corpus qualify row_number() over (partition by abstract order by ord) = 1",
)
def w1(spark, sf_dir) -> DataFrame:
    """The rows that `row_number() = 1` keeps, as a grouped minimum."""
    return dedup.keep_first(fx.corpus(spark, sf_dir), stages=("abstract",)).select("ord")


@query(
    "clean_one_language",
    sql.with_(sql.CORPUS, MARGIN_SQL)
    + "select ord, identifier from corpus join guess using (doc_id) where abstract is not null and detected = 'English'",
)
def clean_one_language(spark, sf_dir) -> DataFrame:
    return cleaning.keep_language(fx.corpus(spark, sf_dir), "English").select("ord", "identifier")
