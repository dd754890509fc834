"""The queries of the operators of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.llm import bpe, decontaminate, jaccard, language, licenses, negatives, packing, pii, quality, secrets, shards, trie, warc
from corpusmill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.share(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = bpe.encode(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN, carry=["doc_id"])
    return bpe.decode(ids, vocabulary).select("doc_id", *bpe.digests())


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = language.fit(docs.filter(part != 2), "doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), model, carry=["doc_id"])
    return found.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(secrets.count_of(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.array_join("found", ",").alias("spans"),
    )


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", *quality.COUNTS, "base_failed", "kept"
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "canonical_sha256", "license", F.array_join("line_licenses", ",").alias("line_licenses")
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"), pii.train()).select(
        "doc_id",
        *(pii.count_of(kind).alias(f"n_{kind}") for kind in pii.KINDS),
        F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.array_join("found", ",").alias("spans"),
    )


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefixes(table(spark, sf_dir, "conversations"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return packing.pack(table(spark, sf_dir, "documents"), file.read())


QUERIES: dict[str, Query] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_decontaminate": op2_decontaminate,
    "op3_language": op3_language,
    "op4_warc": op4_warc,
    "op5_sharding": op5_sharding,
    "op6_secrets": op6_secrets,
    "op7_jaccard": op7_jaccard,
    "op8_quality": op8_quality,
    "op9_licenses": op9_licenses,
    "op10_pii": op10_pii,
    "op11_negatives": op11_negatives,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_packing": op13_packing,
}

ORACLES: dict[str, str] = {
    "op4_warc": """
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
        g as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as last from p)
        select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
               case when payload_bytes >= 1000 and page_id < last then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 1000 and page_id < last then last end as refers_to
        from g""",
    "op8_quality": r"""
        with t as (select row_number() over () as r, doc_id, coalesce(text, '') as body from documents),
        s as (select r, doc_id, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') as words,
                     list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
        windows as (select r, unnest(range(1, len(words) - 1)) as p, words from s),
        twice as (select r, p, count(*) over (partition by r, words[p], words[p + 1], words[p + 2]) as n from windows),
        covered as (select r, count(distinct place) as n from (select r, unnest([p, p + 1, p + 2]) as place from twice where n > 1) group by r),
        c as (select doc_id, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::bigint as word_chars,
                     (length(body) - length(translate(body, '#*$%&|<>', '')))::bigint as n_symbols,
                     (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words,
                     len(lines) as n_lines, len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) as n_letters
              from s left join covered using (r)),
        f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               not (base_failed or word_chars > 14 * n_words or word_chars < 3 * n_words or 100 * n_symbols > 10 * n_words
                    or 100 * n_dup_lines > 50 * n_lines or 100 * n_letters < 70 * n_words) as kept from f""",
    "op11_negatives": """
        with e as (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as l,
                          list_transform(embedding, lambda x: floor(256 * x::double)) as v
                   from embeddings
                   where label is not null and embedding is not null
                     and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.r as ar, a.vec_id as anchor_id, b.r as br, b.vec_id as id, a.l = b.l as same, list_inner_product(a.v, b.v)::bigint as score
              from e as a join e as b on a.vec_id % 100 = 0 and a.r <> b.r),
        p as (select ar, br as pr, anchor_id, id as positive_id, score as positive_score from s where same
              qualify row_number() over (partition by ar order by score desc, id nulls last) <= 5),
        n as (select p.ar, p.pr, p.anchor_id, positive_id, positive_score, s.id as negative_id, s.score as negative_score,
                     row_number() over (partition by p.ar, p.pr order by s.score desc, s.id nulls last) as rank
              from p join s on s.ar = p.ar and not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
        select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 10""",
    "op12_prefix_trie": """
        with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as pos,
                          coalesce(role, '') as role, coalesce(text, '') as text
                   from conversations where conv_id is not null),
        own as (select c, list({'role': role, 'text': text} order by pos) as turns from t group by c),
        bits as (select c, turns, [ord(x)::ubigint for x in string_split(c::varchar, '')] as bytes from own),
        crc as (select c, turns, (xor(list_reduce(list_concat([4294967295::ubigint], bytes),
                    lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)::ubigint[]),
                        lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)), 4294967295::ubigint) % 6)::int as h
                from bits),
        whole as (select a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) as turns from crc as a left join own as b on b.c = a.c - a.c % 100),
        cut as (select c, turns, unnest(range(0, len(turns) + 1)) as depth from whole),
        paths as (select c, depth, len(turns) = depth as ends, turns[1:depth] as path from cut),
        nodes as (select path, depth, min(c) as conv_id, count(*) as n_convs, coalesce(length(path[-1].text), 0) as tokens,
                         sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where ends), '')) as ends_sha256
                  from paths group by path, depth),
        kids as (select path[1:depth - 1] as path, count(*) as n_children from nodes where depth > 0 group by all),
        up as (select path[1:d] as path, sum((k.path is null)::int) as n_leaves, sum((n_convs - 1) * tokens) as saved
               from (select n.path, n_convs, tokens, unnest(range(0, depth + 1)) as d from nodes as n) as n left join kids as k using (path)
               group by all)
        select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves::bigint as n_leaves,
               saved::bigint as saved_tokens, n.ends_sha256
        from nodes as n join up on up.path = n.path left join kids on kids.path = n.path
        left join nodes as p on n.depth > 0 and p.depth = n.depth - 1 and p.path = n.path[1:n.depth - 1]""",
}
