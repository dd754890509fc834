"""Queries over text: cleaning, tokens, phrases, dictionary and bag of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corpusmill import fixed_values as fixed
from corpusmill.functions import text
from corpusmill.operators import phrases, preprocess, profile, vocabulary
from corpusmill.operators.preprocess import Preprocessor
from corpusmill.plans import fixtures as fx, sql
from corpusmill.plans.records import rounded_stats
from corpusmill.plans.registry import query
from corpusmill.runtime import materialize
from corpusmill.settings import Settings


def flagship(spark, sf_dir) -> DataFrame:
    """Raw documents to merged tokens, and the 50 most frequent of them."""
    docs = fx.preprocessor().fit_transform(fx.texts(spark, sf_dir).select("doc_id", "text"))
    return profile.top_words(docs, F.col("tokens"), 50)


# -- scalar text functions ----------------------------------------------------


@query(
    "c1_clean_text",
    f"select doc_id, {sql.cleaned('text')} as cleaned from documents",
)
def c1(spark, sf_dir) -> DataFrame:
    return fx.texts(spark, sf_dir).select("doc_id", text.clean_text("text").alias("cleaned"))


@query(
    "c1_clean_pages",
    f"select page_id, {sql.cleaned('html')} as cleaned from pages",
)
def c1_pages(spark, sf_dir) -> DataFrame:
    return fx.table(spark, sf_dir, "pages").select("page_id", text.clean_text("html").alias("cleaned"))


@query(
    "c3_lengths",
    f"select doc_id, length(text)::integer as chars, {sql.words('text')}::integer as words from documents",
)
def c3(spark, sf_dir) -> DataFrame:
    return fx.texts(spark, sf_dir).select(
        "doc_id", text.char_length("text").alias("chars"), text.word_count("text").alias("words")
    )


_SIMPLE = (
    "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), "
    "lambda t: regexp_full_match(t, '[a-z]{3,}'))"
)


@query(
    "c8_simple_tokens",
    f"select doc_id, array_to_string({_SIMPLE}, ' ') as words from documents",
)
def c8(spark, sf_dir) -> DataFrame:
    return fx.texts(spark, sf_dir).select(
        "doc_id", F.array_join(text.simple_tokens("text"), " ").alias("words")
    )


@query(
    "c10_shorten",
    """select doc_id, case when length(text) > 60 then concat(substr(text, 1, 60), '...') else text end as short
       from documents""",
)
def c10(spark, sf_dir) -> DataFrame:
    return fx.texts(spark, sf_dir).select("doc_id", text.shorten("text", 60).alias("short"))


# -- word profiles of raw texts -----------------------------------------------

_RAW_WORDS = f"raw as (select unnest({_SIMPLE}) as word from documents)"


@query(
    "a11_word_totals",
    sql.with_(_RAW_WORDS) + "select count(*) as total_words, count(distinct word) as distinct_words from raw",
)
def a11(spark, sf_dir) -> DataFrame:
    return profile.word_totals(fx.texts(spark, sf_dir), text.simple_tokens("text"))


@query(
    "l2_most_common_words",
    sql.with_(_RAW_WORDS) + "select word, count(*) as n from raw group by 1 order by n desc, word limit 50",
)
def l2(spark, sf_dir) -> DataFrame:
    return profile.top_words(fx.texts(spark, sf_dir), text.simple_tokens("text"), 50)


@query(
    "d9_stopwords_on_top",
    sql.with_(_RAW_WORDS)
    + f"""select * from (select word, count(*) as n from raw group by 1 order by n desc, word limit 50)
      where word in ({sql.quoted(fixed.COMMON_STOPWORDS)})""",
)
def d9(spark, sf_dir) -> DataFrame:
    return profile.stopwords_on_top(fx.texts(spark, sf_dir), text.simple_tokens("text"))


@query(
    "d7_stopword_union",
    sql.with_(
        f"""lists as (
        select unnest([{sql.quoted(fixed.BUILT_IN_STOPWORDS)}]) as word, 'built-in' as origin
        union all select unnest([{sql.quoted(fixed.COMMON_STOPWORDS)}]), 'common'
        union all select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')), 'benchmark' from benchmark)"""
    )
    + "select word, string_agg(distinct origin, ',' order by origin) as origins from lists group by 1",
)
def d7(spark, sf_dir) -> DataFrame:
    def listed(words, origin) -> DataFrame:
        return spark.createDataFrame([(w, origin) for w in words], "word string, origin string")

    # the third list is as long as the words of a table
    custom = (
        fx.table(spark, sf_dir, "benchmark")
        .select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
        .distinct()
        .withColumn("origin", F.lit("benchmark"))
    )
    return preprocess.stopword_union(
        listed(fixed.BUILT_IN_STOPWORDS, "built-in"), listed(fixed.COMMON_STOPWORDS, "common"), custom
    )


# -- tokens -------------------------------------------------------------------


def _joined(df: DataFrame, column: str = "tokens", name: str = "words") -> DataFrame:
    return df.select("doc_id", F.array_join(column, " ").alias(name))


@query("m1_clean", f"select doc_id, {sql.cleaned('text')} as cleaned from documents")
def m1(spark, sf_dir) -> DataFrame:
    docs = fx.texts(spark, sf_dir)
    return docs.select("doc_id", text.clean_text("text").alias("cleaned"))


@query(
    "m2_tokenize",
    f"select doc_id, len(list_filter(string_split({sql.cleaned('text')}, ' '), lambda t: t <> ''))::integer as n from documents",
)
def m2(spark, sf_dir) -> DataFrame:
    every_word = text.tokens_of("text", (), 1, None)
    return fx.texts(spark, sf_dir).select("doc_id", F.size(every_word).alias("n"))


@query(
    "m3_remove_stopwords",
    f"""select doc_id, array_to_string(list_filter(string_split({sql.cleaned('text')}, ' '),
      lambda t: t <> '' and t not in ({sql.STOP})), ' ') as words from documents""",
)
def m3(spark, sf_dir) -> DataFrame:
    kept = text.drop_stopwords(text.tokens_of("text", (), 1, None), fixed.BUILT_IN_STOPWORDS)
    return fx.texts(spark, sf_dir).select("doc_id", F.array_join(kept, " ").alias("words"))


@query(
    "m4_filter_by_length",
    f"select doc_id, len({sql.tokens(stop=None)})::integer as n from documents",
)
def m4(spark, sf_dir) -> DataFrame:
    kept = text.keep_lengths(text.tokens_of("text", (), 1, None), 3, 50)
    return fx.texts(spark, sf_dir).select("doc_id", F.size(kept).alias("n"))


def strip_plural(token: str) -> str:
    """A stand-in for a stemmer: drop one final s."""
    return token[:-1] if token.endswith("s") else token


@query(
    "m5_token_map",
    sql.with_(sql.WORDS) + "select distinct term as token, regexp_replace(term, 's$', '') as normal from w",
)
def m5(spark, sf_dir) -> DataFrame:
    return preprocess.token_map(fx.tokenized(spark, sf_dir), strip_plural)


@query(
    "m5_normalised_tokens",
    sql.with_(sql.TOKENS)
    + "select doc_id, array_to_string(list_transform(tokens, lambda t: regexp_replace(t, 's$', '')), ' ') as words from toks",
)
def m5_tokens(spark, sf_dir) -> DataFrame:
    stemming = Settings().with_(use_stemming=True)
    prep = Preprocessor(stemming, fixed.BUILT_IN_STOPWORDS, strip_plural)
    return _joined(fx.texts(spark, sf_dir).select("doc_id", prep.tokens("text").alias("tokens")))


@query(
    "m6_token_chain",
    sql.with_(sql.TOKENS) + "select doc_id, array_to_string(tokens, ' ') as words from toks",
)
def m6(spark, sf_dir) -> DataFrame:
    prep = fx.preprocessor()
    return _joined(fx.texts(spark, sf_dir).select("doc_id", prep.tokens("text").alias("tokens")))


@query(
    "m6_token_chain_pages",
    f"select page_id, array_to_string({sql.tokens('html')}, ' ') as words from pages",
)
def m6_pages(spark, sf_dir) -> DataFrame:
    tokens = fx.preprocessor().tokens("html")
    return fx.table(spark, sf_dir, "pages").select("page_id", F.array_join(tokens, " ").alias("words"))


@query(
    "f12_long_documents",
    sql.with_(sql.TOKENS) + "select doc_id, len(tokens)::integer as n from docs",
)
def f12(spark, sf_dir) -> DataFrame:
    return fx.preprocessor().tokenize(fx.texts(spark, sf_dir)).select("doc_id", F.size("tokens").alias("n"))


@query(
    "j1_kept_documents",
    sql.with_(sql.TOKENS) + "select doc_id, lang, text from documents semi join docs using (doc_id)",
)
def j1(spark, sf_dir) -> DataFrame:
    kept = fx.tokenized(spark, sf_dir).select("doc_id")
    return fx.texts(spark, sf_dir).join(kept, "doc_id", "left_semi").select("doc_id", "lang", "text")


@query(
    "j5_stopword_anti_join",
    sql.with_(
        f"""everything as (select doc_id, unnest({sql.tokens(stop=None)}) as term from documents)"""
    )
    + f"select term, count(*) as n from everything where term not in ({sql.STOP}) group by 1",
)
def j5(spark, sf_dir) -> DataFrame:
    """Exploded form: counting comes first, so the join sees distinct words only."""
    stop = spark.createDataFrame([(w,) for w in fixed.BUILT_IN_STOPWORDS], "term string")
    counts = profile.word_counts(fx.texts(spark, sf_dir), text.tokens_of("text"))
    return counts.withColumnRenamed("word", "term").join(F.broadcast(stop), "term", "left_anti")


# -- phrases ------------------------------------------------------------------


@query(
    "j7_adjacent_pairs",
    sql.with_(sql.PHRASES) + "select w1, w2, n from pair",
)
def j7(spark, sf_dir) -> DataFrame:
    return phrases.count_pairs(fx.tokenized(spark, sf_dir)).where("w2 is not null")


@query(
    "w2_lead_pairs",
    sql.with_(sql.PHRASES) + "select doc_id, pos::integer as pos, w1, w2 from adj where w2 is not null",
)
def w2(spark, sf_dir) -> DataFrame:
    pairs = phrases.adjacent_pairs(F.col("tokens"))
    rows = fx.tokenized(spark, sf_dir).select("doc_id", F.posexplode(pairs).alias("p", "pair"))
    return rows.select("doc_id", (F.col("p") + 1).alias("pos"), "pair.w1", "pair.w2")


@query(
    "m9_phrase_scores",
    sql.with_(sql.PHRASES) + "select w1, w2, n, round(score, 6) as score from phrase",
)
def m9(spark, sf_dir) -> DataFrame:
    return phrases.fit_phrases(fx.tokenized(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(
    "m10_merged_tokens",
    sql.with_(sql.MERGED) + "select doc_id, string_agg(term, ' ' order by pos) as words from m group by 1",
)
def m10(spark, sf_dir) -> DataFrame:
    table = fx.fitted_preprocessor(spark, sf_dir).bigrams
    return _joined(phrases.apply_phrases(fx.tokenized(spark, sf_dir), table))


@query(
    "w3_merge_starts",
    sql.with_(sql.MERGED) + "select doc_id, (pos - 1)::integer as pos from start",
)
def w3(spark, sf_dir) -> DataFrame:
    table = fx.fitted_preprocessor(spark, sf_dir).bigrams
    return phrases.merge_starts(fx.tokenized(spark, sf_dir), table)


_TRIGRAMS = """,
adj2 as (select doc_id, term as w1, lead(term) over (partition by doc_id order by pos) as w2 from m),
uni2 as (select term, count(*) as n from m group by term),
pair2 as (select w1, w2, count(*) as n from adj2 where w2 is not null group by w1, w2),
size2 as (select (select count(*) from uni2) + (select count(*) from pair2) as l),
phrase2 as (select w1, w2, p.n, (p.n - 10)::double / a.n / b.n * (select l from size2) as score
  from pair2 p join uni2 a on a.term = w1 join uni2 b on b.term = w2 where p.n > 10),
known2 as (select * from phrase2 where score > 10)
"""

_THREE_WORDS = """,
pos2 as (select doc_id, term, row_number() over (partition by doc_id order by pos) as pos from m),
next2 as (select *, lead(term) over (partition by doc_id order by pos) as follower from pos2),
hit2 as (select doc_id, pos, pos - row_number() over (partition by doc_id order by pos) as run
  from next2 join known2 on w1 = term and w2 = follower),
start2 as (select doc_id, pos from (
  select *, row_number() over (partition by doc_id, run order by pos) as step from hit2) where step % 2 = 1),
m2 as (select n.doc_id, n.pos,
    case when s.pos is not null then concat(n.term, '_', n.follower) else n.term end as term
  from next2 n left join start2 s on s.doc_id = n.doc_id and s.pos = n.pos
  left join start2 p on p.doc_id = n.doc_id and p.pos = n.pos - 1 where p.pos is null)
"""


@query(
    "m11_second_pass_phrases",
    sql.with_(sql.MERGED + _TRIGRAMS) + "select w1, w2, n, round(score, 6) as score from known2",
)
def m11(spark, sf_dir) -> DataFrame:
    docs = fx.merged(spark, sf_dir)
    return phrases.fit_phrases(docs, min_count=Settings().trigram_min_count).withColumn(
        "score", F.round("score", 6)
    )


@query(
    "m11_three_word_corpus",
    sql.with_(sql.MERGED + _TRIGRAMS + _THREE_WORDS)
    + "select doc_id, string_agg(term, ' ' order by pos) as words from m2 group by 1",
)
def m11_corpus(spark, sf_dir) -> DataFrame:
    prep = Preprocessor(Settings().with_(use_trigrams=True), fixed.BUILT_IN_STOPWORDS)
    docs = fx.tokenized(spark, sf_dir)
    return _joined(prep.fit(docs).merge(docs))


@query(
    "m7_whole_corpus",
    sql.with_(sql.MERGED) + "select doc_id, count(*)::integer as token_count, string_agg(term, ' ' order by pos) as words from m group by 1",
)
def m7(spark, sf_dir) -> DataFrame:
    docs = fx.preprocessor().fit_transform(fx.texts(spark, sf_dir).select("doc_id", "text"))
    return docs.select("doc_id", "token_count", F.array_join("tokens", " ").alias("words"))


@query(
    "m8_table_column",
    sql.with_(sql.MERGED)
    + """select doc_id, any_value(documents.lang) as lang, any_value(documents.n_chars) as n_chars,
      count(*)::integer as token_count from m join documents using (doc_id) group by 1""",
)
def m8(spark, sf_dir) -> DataFrame:
    docs = fx.preprocessor().fit_transform(fx.texts(spark, sf_dir), "text", "tokens")
    return docs.select("doc_id", "lang", "n_chars", "token_count")


@query(
    "a12_token_counts",
    sql.with_(sql.MERGED) + "select term as word, count(*) as n from m group by 1",
)
def a12(spark, sf_dir) -> DataFrame:
    return profile.word_counts(fx.merged(spark, sf_dir), F.col("tokens"))


@query(
    "a12_top_phrases",
    sql.with_(sql.MERGED)
    + "select term as word, count(*) as n from m where contains(term, '_') group by 1 order by n desc, word limit 20",
)
def a12_phrases(spark, sf_dir) -> DataFrame:
    merged = F.filter(F.col("tokens"), phrases.is_phrase)
    return profile.top_words(fx.merged(spark, sf_dir), merged, 20)


@query(
    "a13_corpus_statistics",
    sql.with_(sql.MERGED)
    + """select (select count(*) from toks) as total_documents, (select count(*) from docs) as processed_documents,
      (select count(*) from toks) - (select count(*) from docs) as skipped_documents,
      count(*) as total_tokens, count(distinct term) as unique_tokens,
      round(count(*) / (select count(*) from docs), 6) as avg_tokens_per_doc from m""",
)
def a13(spark, sf_dir) -> DataFrame:
    return preprocess.corpus_statistics(fx.documents(spark, sf_dir), fx.merged(spark, sf_dir)).withColumn(
        "avg_tokens_per_doc", F.round("avg_tokens_per_doc", 6)
    )


@query(
    "a14_token_count_spread",
    sql.with_(sql.MERGED)
    + """select 'token_count' as measure, count(x) as n, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as std,
      min(x)::double as min, round(quantile_cont(x, 0.25), 6) as q25, round(quantile_cont(x, 0.5), 6) as median,
      round(quantile_cont(x, 0.75), 6) as q75, max(x)::double as max
      from (select count(*)::double as x from m group by doc_id)""",
)
def a14(spark, sf_dir) -> DataFrame:
    return rounded_stats(profile.describe(fx.merged(spark, sf_dir), {"token_count": F.size("tokens")}))


# -- dictionary and bag of words ----------------------------------------------

_DICTIONARY = """,
freq as (select term, count(distinct doc_id) as df, count(*) as cf from w group by term),
dic as (select * from freq where df >= 20 and df <= floor(0.5 * (select count(*) from docs)))
"""
DICTIONARY = sql.WORDS + _DICTIONARY


@query("m12_document_frequencies", sql.with_(DICTIONARY) + "select term, df, cf from freq")
def m12(spark, sf_dir) -> DataFrame:
    return vocabulary.document_frequencies(fx.tokenized(spark, sf_dir))


@query(
    "m13_filtered_dictionary",
    sql.with_(DICTIONARY) + "select (row_number() over (order by term) - 1)::integer as term_id, term, df, cf from dic",
)
def m13(spark, sf_dir) -> DataFrame:
    return vocabulary.build_dictionary(fx.tokenized(spark, sf_dir))


@query(
    "m13_dictionary_keep_n",
    sql.with_(DICTIONARY)
    + """select (row_number() over (order by term) - 1)::integer as term_id, term, df, cf
      from (select * from dic order by df desc, term limit 100)""",
)
def m13_keep(spark, sf_dir) -> DataFrame:
    return vocabulary.build_dictionary(fx.tokenized(spark, sf_dir), settings=Settings().with_(keep_n=100))


@query(
    "a18_dictionary_sizes",
    sql.with_(DICTIONARY) + "select (select count(*) from freq) as terms_before, (select count(*) from dic) as terms_after",
)
def a18(spark, sf_dir) -> DataFrame:
    return vocabulary.dictionary_sizes(fx.tokenized(spark, sf_dir))


_BOW = """, ids as (select *, (row_number() over (order by term) - 1)::integer as term_id from dic)
select doc_id, term_id, count(*) as n from w join ids using (term) group by 1, 2"""


@query("m14_bag_of_words", sql.with_(DICTIONARY + _BOW))
def m14(spark, sf_dir) -> DataFrame:
    docs = fx.tokenized(spark, sf_dir)
    dictionary = materialize(vocabulary.build_dictionary(docs), "dictionary")
    return vocabulary.bag_of_words(docs, dictionary)


@query(
    "j6_known_tokens",
    sql.with_(DICTIONARY) + "select doc_id, count(*) as known from w semi join dic using (term) group by 1",
)
def j6(spark, sf_dir) -> DataFrame:
    docs = fx.tokenized(spark, sf_dir)
    dictionary = materialize(vocabulary.build_dictionary(docs), "dictionary")
    return vocabulary.bag_of_words(docs, dictionary).groupBy("doc_id").agg(F.sum("n").alias("known"))


@query(
    "m14_spark_ml_bag_of_words",
    sql.with_(DICTIONARY + """, b as (select doc_id, term, count(*) as n from w semi join dic using (term) group by 1, 2)
    select doc_id, count(*) as terms, sum(n)::bigint as tokens from b group by 1"""),
)
def m14_ml(spark, sf_dir) -> DataFrame:
    """The vectors that the topic model is trained on."""
    from corpusmill.operators import topics

    docs = fx.tokenized(spark, sf_dir)
    vectors = topics.fit_vectorizer(docs).transform(docs)
    return vocabulary.sizes_of_vectors(vectors).where("terms > 0")


# -- user-supplied parts ------------------------------------------------------

_CUSTOM = ["que", "les", "der", "und"]


@query(
    "u1_custom_stopwords",
    f"""select doc_id, len({sql.tokens(stop=sql.quoted([*fixed.BUILT_IN_STOPWORDS, *_CUSTOM]))})::integer as n
      from documents""",
)
def u1(spark, sf_dir) -> DataFrame:
    words = preprocess.stopword_list(custom=_CUSTOM, english=False)
    tokens = Preprocessor(Settings(), words).tokens("text")
    return fx.texts(spark, sf_dir).select("doc_id", F.size(tokens).alias("n"))


@query("u1_default_stopwords")
def u1_default(spark, sf_dir) -> DataFrame:
    """The whole chain of lists as the study uses it, with its own words; the test has the SQL, with Spark's list."""
    words = preprocess.stopword_list(custom=fixed.DOMAIN_STOPWORDS)
    tokens = Preprocessor(Settings(), words).tokens("text")
    return _joined(fx.texts(spark, sf_dir).select("doc_id", tokens.alias("tokens")))


@query(
    "u4_preprocess_new_texts",
    sql.with_(
        sql.PHRASES
        + f""",
      ctoks as (select conv_id * 100000 + turn as id, {sql.tokens()} as tokens from conversations),
      cw as (select id, unnest(tokens) as w1, generate_subscripts(tokens, 1) as pos from ctoks),
      cadj as (select *, lead(w1) over (partition by id order by pos) as w2 from cw),
      chit as (select id, pos, pos - row_number() over (partition by id order by pos) as run
        from cadj join phrase using (w1, w2)),
      cstart as (select id, pos from (
        select *, row_number() over (partition by id, run order by pos) as step from chit) where step % 2 = 1),
      cm as (select a.id, a.pos, case when s.pos is not null then concat(a.w1, '_', a.w2) else a.w1 end as term
        from cadj a left join cstart s on s.id = a.id and s.pos = a.pos
        left join cstart p on p.id = a.id and p.pos = a.pos - 1 where p.pos is null)"""
    )
    + """select c.id as doc_id, coalesce(string_agg(term, ' ' order by pos), '') as words
      from ctoks c left join cm on cm.id = c.id group by 1""",
)
def u4(spark, sf_dir) -> DataFrame:
    """Phrases learned from the documents, applied to the conversation turns."""
    turns = fx.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100_000 + F.col("turn")).alias("doc_id"), "text"
    )
    return _joined(fx.fitted_preprocessor(spark, sf_dir).transform(turns))
