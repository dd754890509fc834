"""SQL of the fixture views, as fragments of a WITH clause (DuckDB dialect)."""

from __future__ import annotations

from corpusmill import fixed_values as fixed

CORPUS = r"""
base as (
  select doc_id * 3 as ord, doc_id, concat('oai:corpus:', doc_id) as identifier,
    case when doc_id % 29 = 0 then null when doc_id % 31 = 0 then '   '
         else substr(split_part(text, chr(10), 1), 1, 80) end as title,
    case when doc_id % 37 = 0 then null else text end as abstract,
    case when doc_id % 11 = 0 then null
         else concat('Author ', doc_id % 50, '; Author ', doc_id % 7) end as authors,
    case doc_id % 20 when 0 then null when 1 then '' when 2 then concat('c', 2007 + doc_id % 19)
         when 3 then 'n.d.' when 4 then concat('', 2007 + doc_id % 19)
         when 5 then concat(2007 + doc_id % 19, '/', 2008 + doc_id % 19)
         else concat(2007 + doc_id % 19, '-', lpad(concat('', 1 + doc_id % 12), 2, '0'), '-15')
         end as date,
    case when doc_id % 10 = 0 then null
         when doc_id % 7 = 0 then concat('topic ', doc_id % 13, '; ; topic ', doc_id % 5)
         else concat('topic ', doc_id % 13, '; topic ', doc_id % 5) end as subjects,
    source as publisher,
    case when doc_id % 83 = 0 then null else 'Thesis' end as types,
    case when doc_id % 5 = 0 then null else lang end as language,
    cast(null as varchar) as source
  from documents),
corpus as (
  select * from base
  union all select * replace (ord + 1 as ord) from base where doc_id % 25 = 0
  union all select * replace (ord + 2 as ord, concat('changed ', doc_id) as title)
    from base where doc_id % 40 = 1)
"""

_ALL = ", ".join(fixed.RAW_COLUMNS)

DEDUP = f"""
s1 as (select * from corpus qualify row_number() over (partition by {_ALL} order by ord) = 1),
s2 as (select * from s1 qualify row_number() over (partition by identifier order by ord) = 1),
s3 as (select * from s2 qualify row_number() over (partition by title order by ord) = 1),
s4 as (select * from s3 qualify row_number() over (partition by abstract order by ord) = 1)
"""


def blank(column: str) -> str:
    return f"({column} is null or not regexp_matches({column}, '\\S'))"


def words(column: str) -> str:
    return f"len(regexp_extract_all(coalesce({column}, ''), '\\S+'))"


def normalized(column: str) -> str:
    one_line = f"trim(regexp_replace(coalesce({column}, ''), '\\s+', ' ', 'g'))"
    return f"regexp_replace({one_line}, '[\\x00-\\x1f\\x7f]', '', 'g')"


def parsed_date(column: str = "date") -> str:
    """Date of the forms the corpus view contains."""
    return (
        f"coalesce(try_cast({column} as date), try_cast(concat(nullif(regexp_extract("
        f"{column}, '(19|20)[0-9][0-9]'), ''), '-01-01') as date))"
    )


def cleaned(column: str) -> str:
    out = f"lower(coalesce({column}, ''))"
    for pattern, by in (
        (r"https?://\S+|www\.\S+", ""),
        (r"\S+@\S+", ""),
        ("<[^>]+>", ""),
        (r"\d+", ""),
        (r"[^a-zA-Z\s]", " "),
        (r"\s+", " "),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"trim({out})"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


STOP = quoted(fixed.BUILT_IN_STOPWORDS)


def tokens(column: str = "text", stop: str | None = STOP) -> str:
    unwanted = f" and t not in ({stop})" if stop else ""
    return (
        f"list_filter(string_split({cleaned(column)}, ' '), "
        f"lambda t: length(t) between 3 and 50{unwanted})"
    )


TOKENS = f"""
toks as (select doc_id, lang, source, {tokens()} as tokens from documents),
docs as (select * from toks where len(tokens) >= 30)
"""

WORDS = TOKENS + """,
w as (select doc_id, unnest(tokens) as term, generate_subscripts(tokens, 1) as pos from docs)
"""

# phrases with the default parameters, and their greedy merging as gaps and islands
PHRASES = WORDS + """,
adj as (select doc_id, pos, term as w1, lead(term) over (partition by doc_id order by pos) as w2 from w),
uni as (select term, count(*) as n from w group by term),
pair as (select w1, w2, count(*) as n from adj where w2 is not null group by w1, w2),
size as (select (select count(*) from uni) + (select count(*) from pair) as l),
scored as (
  select w1, w2, pair.n, (pair.n - 20)::double / a.n / b.n * (select l from size) as score
  from pair join uni a on a.term = w1 join uni b on b.term = w2),
phrase as (select * from scored where n > 20 and score > 10)
"""

MERGED = PHRASES + """,
hit as (select doc_id, pos, pos - row_number() over (partition by doc_id order by pos) as run
        from adj join phrase using (w1, w2)),
start as (select doc_id, pos from (
  select *, row_number() over (partition by doc_id, run order by pos) as step from hit) where step % 2 = 1),
m as (
  select adj.doc_id, adj.pos,
    case when s.pos is not null then concat(adj.w1, '_', adj.w2) else adj.w1 end as term
  from adj left join start s on s.doc_id = adj.doc_id and s.pos = adj.pos
  left join start p on p.doc_id = adj.doc_id and p.pos = adj.pos - 1
  where p.pos is null)
"""

THETA = """
raw_theta as (
  select doc_id, k as topic_id, (1 + ((doc_id * (7 * k + 3) + k * k) % 1009))::double as wt
  from documents cross join range(6) t(k)),
theta as (select doc_id, topic_id::integer as topic_id,
  wt / sum(wt) over (partition by doc_id) as prob from raw_theta),
lead as (select doc_id, min_by(topic_id, (-prob, topic_id)) as dominant_topic, max(prob) as top_prob
  from theta group by doc_id)
"""

PHI = f"""
ptoks as (select doc_id, cast(substr(source, 4) as int) % 6 as topic_id, {tokens(stop=None)} as tokens
  from documents),
pdocs as (select * from ptoks where len(tokens) >= 30),
pw as (select doc_id, topic_id, unnest(tokens) as term from pdocs),
terms as (select term from pw group by term
  having count(distinct doc_id) >= 20
     and count(distinct doc_id) <= floor(0.5 * (select count(*) from pdocs))),
cnt as (select topic_id, term, count(*) as n from pw semi join terms using (term) group by 1, 2),
tot as (select topic_id, sum(n) as n from cnt group by 1),
phi as (
  select tot.topic_id::integer as topic_id, terms.term,
    (coalesce(cnt.n, 0) + 1e0 / 6) / (tot.n + (select count(*) from terms) / 6e0) as weight
  from tot cross join terms left join cnt on cnt.topic_id = tot.topic_id and cnt.term = terms.term),
ranked as (select *, row_number() over (partition by topic_id order by weight desc, term) as rank from phi)
"""


def with_(*parts: str) -> str:
    return "with " + ",".join(part.strip() for part in parts) + "\n"
