r"""SQL that gives the same rows as the queries of ``catalog``, for DuckDB on the same tables.

Larger statements are put together from named parts: each part is a function that returns a subquery or a list
expression.
"""

from __future__ import annotations

from quillon.functions.scores import KEYWORD_STOP, QUERY_TYPES
from quillon.operators.answering import NO_ANSWER, TEMPLATES
from quillon.operators.expansion import PROMPTS


def text_of(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def tok(c: str, lower: bool = True) -> str:
    return rf"regexp_extract_all({f'lower({c})' if lower else c}, '[\p{{L}}\p{{N}}_]+')"


def words(c: str) -> str:
    return rf"list_filter(string_split_regex(trim({c}), '\s+'), lambda w: w <> '')"


def wset(c: str) -> str:
    return f"list_distinct({words(f'lower({c})')})"


def sents(c: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({c}, '[.!?]+\s+'), lambda s: trim(s)), lambda s: s <> '')"


def grams(items: str, n: int) -> str:
    return f"list_transform(range(1, len({items}) - {n} + 2), lambda i: array_to_string({items}[i:i + {n - 1}], ' '))"


def jacc(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"case when len({a}) = 0 or len({b}) = 0 then 0.0 else {both}::double / (len({a}) + len({b}) - {both}) end"


def top(scored: str, k: int, cols: str = "query_id, doc_id, score", by: str = "query_id") -> str:
    return f"(select {cols}, rank from (select *, row_number() over (partition by {by} order by score desc nulls last, doc_id) as rank from {scored}) where rank <= {k})"


DOCS = "(select doc_id, text from documents)"
ASKED = "(select item_id as query_id, text from benchmark)"


def hashed(terms: str, keys: str) -> str:
    """Signed hashed term counts at length one, from rows of keys and term."""
    x = f"(select {keys}, ('0x' || substr(md5(term), 1, 8))::bigint % 256 as bucket, sum(case when ('0x' || substr(md5(term), 9, 1))::int % 2 = 0 then n else -n end)::double as x from (select {keys}, term, count(*) as n from {terms} group by {keys}, term) group by all)"
    return f"(select {keys}, bucket, x / sqrt(nn) as weight from (select *, sum(x * x) over (partition by {keys}) as nn from {x}) where nn > 0 and x <> 0)"


def hash_vectors(source: str, id: str) -> str:
    return hashed(f"(select {id}, unnest({tok('text')}) as term from {source})", id)


def text_vector(k: int, asked: str = ASKED, docs: str = DOCS) -> str:
    pairs = f"(select query_id, doc_id, round(sum(d.weight * q.weight), 6) as score from {hash_vectors(docs, 'doc_id')} d join {hash_vectors(asked, 'query_id')} q using (bucket) group by query_id, doc_id)"
    return top(pairs, k)


def idf_of(docs: str) -> str:
    return f"""(with d as materialized (select {tok('text')} as t from {docs}), n as (select count(*) as n from d),
df as materialized (select term, count(*) as df from (select unnest(list_distinct(t)) as term from d) group by term),
raw as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as raw from df, n)
select term, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw)"""


IDF = idf_of("documents")


def bm25(k: int, asked: str = ASKED, docs: str = "documents") -> str:
    scored = f"""(with d as (select doc_id, {tok('text')} as t from {docs}),
st as (select avg(len(t)) as avgdl from d),
tf as (select doc_id, term, count(*) as tf, any_value(dl) as dl from (select doc_id, len(t) as dl, unnest(t) as term from d) group by doc_id, term),
q as (select query_id, term, count(*) as qtf from (select query_id, unnest({tok('text')}) as term from {asked}) group by query_id, term)
select query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
from q join {idf_of(docs)} i using (term) join tf using (term), st group by query_id, doc_id)"""
    return top(scored, k)


def hybrid(alpha: str, k: int = 10, asked: str = ASKED, docs: str | None = None) -> str:
    vector_docs, docs = docs or DOCS, docs or "documents"
    scored = f"""(with v as {text_vector(2 * k, asked, vector_docs)}, b as (select query_id, doc_id, score / nullif(max(score) over (partition by query_id), 0) as t from {bm25(2 * k, asked, docs)})
select query_id, doc_id, round({alpha} * coalesce(v.score, 0) + (1 - {alpha}) * coalesce(b.t, 0) + 1e-9, 6) as score from v full join b using (query_id, doc_id))"""
    return top(scored, k)


def candidates(k: int) -> str:
    return f"(select c.query_id, c.doc_id, c.score, c.rank, d.text, b.text as query from {bm25(k)} c join documents d using (doc_id) join benchmark b on b.item_id = c.query_id)"


QV = "(select vec_id as query_id, embedding::double[] as e from embeddings where vec_id % 50 = 0)"


def vector(k: int, q: str = QV) -> str:
    return top(f"(select query_id, vec_id as doc_id, round(list_cosine_similarity(q.e, v.embedding::double[]), 6) as score from {q} q, embeddings v)", k)


def greedy(cand: str, sim: str, weight: float, k: int) -> str:
    """Greedy MMR. cand: (query_id, doc_id, score); sim: (query_id, a, b, s) over the same candidates."""
    rest = round(1 - weight, 6)
    return f"""with recursive cand as materialized {cand}, sim as materialized {sim},
pick(query_id, step, chosen) as (
  select query_id, 1, [arg_min(doc_id, row(-round({weight} * score, 6), doc_id))] from cand group by query_id
  union all
  select query_id, step + 1, list_append(any_value(chosen), arg_min(doc_id, row(-v, doc_id))) from (
    select p.query_id, p.step, p.chosen, c.doc_id, round({weight} * any_value(c.score) - {rest} * max(s.s), 6) as v
    from pick p join cand c on c.query_id = p.query_id and not list_contains(p.chosen, c.doc_id)
    join sim s on s.query_id = p.query_id and s.a = c.doc_id and list_contains(p.chosen, s.b)
    where p.step < {k} group by p.query_id, p.step, p.chosen, c.doc_id) group by query_id, step),
last as (select query_id, arg_max(chosen, step) as chosen from pick group by query_id)
select query_id, unnest(chosen) as doc_id, unnest(range(1, len(chosen) + 1)) as place from last"""


def fixed(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""with s as (select doc_id, t, unnest(range(0, len(t), {step})) as s from (select doc_id, {tok('text', False)} as t from documents))
select doc_id, doc_id || '_' || (s // {step}) as chunk_id, (s // {step})::bigint as chunk_index, array_to_string(t[s + 1:s + {size}], ' ') as text from s where len(t[s + 1:s + {size}]) >= {size // 2}"""


def packed(budget: int, size: str) -> str:
    flush = f"r.cur > 0 and r.cur + z.n > {budget}"
    return f"""with recursive z as materialized (select doc_id, i, s, {size} as n from (select doc_id, unnest(ss) as s, unnest(range(len(ss))) as i from (select doc_id, {sents('text')} as ss from documents))),
r(doc_id, i, cur, ch) as (select doc_id, i, n, 0 from z where i = 0
  union all select z.doc_id, z.i, case when {flush} then z.n else r.cur + z.n end, case when {flush} then r.ch + 1 else r.ch end from r join z on z.doc_id = r.doc_id and z.i = r.i + 1)
select doc_id, doc_id || '_s' || ch as chunk_id, ch::bigint as chunk_index, string_agg(s, ' ' order by i) as text from r join z using (doc_id, i) group by doc_id, ch"""


SENTENCES = f"(select doc_id, unnest(range(len(ss)))::int as pos, unnest(ss) as sentence, len(ss) as n from (select doc_id, {sents('text')} as ss from documents))"
SIMS = f"""(with v as materialized {hashed(f"(select doc_id, pos, unnest({tok('sentence')}) as term from {SENTENCES})", "doc_id, pos")},
s as (select a.doc_id, a.pos, sum(a.weight * b.weight) as sim from v a join v b on a.doc_id = b.doc_id and b.pos = a.pos + 1 and a.bucket = b.bucket group by a.doc_id, a.pos)
select z.doc_id, z.pos, z.sentence, case when z.pos < z.n - 1 then round(coalesce(sim, 0), 6) end as sim from {SENTENCES} z left join s using (doc_id, pos))"""
SEMANTIC = f"""with recursive z as materialized {SIMS},
low as (select doc_id, pos + 1 as b from (select *, lag(sim) over w > sim and lead(sim) over w > sim as low from z window w as (partition by doc_id order by pos)) where low),
size as (select doc_id, count(*) as n from z group by doc_id),
brk as (select doc_id, b, row_number() over (partition by doc_id order by b) as k from (
  select doc_id, b from low union all
  select doc_id, unnest(range(250, n, 250)) from size where doc_id not in (select doc_id from low)) join size using (doc_id) where n > 3),
r(doc_id, k, start, keep) as (select doc_id, 0::bigint, 0::bigint, false from size
  union all select r.doc_id, b.k, case when b.b - r.start < 10 then r.start else b.b end, b.b - r.start >= 10 from r join brk b on b.doc_id = r.doc_id and b.k = r.k + 1),
cut as (select doc_id, start as c from r where keep),
part as (select z.doc_id, z.pos, any_value(z.sentence) as sentence, count(c.c) as i from z left join cut c on c.doc_id = z.doc_id and c.c <= z.pos group by z.doc_id, z.pos)
select doc_id, doc_id || '_semantic' || i as chunk_id, i as chunk_index, string_agg(sentence, ' ' order by pos) as text from part group by doc_id, i"""

RULES = """(select query_id, unnest(range(len(v))) as variant, unnest(v) as variant_text from (select query_id, list_concat([text], list_filter([
case when not starts_with(lower(text), 'please') then 'Please ' || text end, case when not starts_with(lower(text), 'what') then 'What about ' || text end,
case when not starts_with(lower(text), 'i want to know') then 'I want to know ' || text end, case when not starts_with(lower(text), 'how') then 'How does ' || text || ' work' end,
case when not contains(lower(text), 'explain') then 'Explain ' || text end], lambda x: x is not null)[1:2]) as v from (select item_id as query_id, text from benchmark)))"""


def merged(rankings: str, k: int) -> str:
    return f"select query_id, doc_id, place from (select query_id, doc_id, row_number() over (partition by query_id order by variant, rank, doc_id) as place from (select *, row_number() over (partition by query_id, doc_id order by variant, rank) as n from {rankings}) where n = 1) where place <= {k}"


def query_type(c: str) -> str:
    return "case " + " ".join(f"when regexp_matches(lower({c}), '{p}') then '{n}'" for n, p in QUERY_TYPES) + " else 'exploratory' end"


MEANS = "(select query_id, list(x order by d) as e from (select query_id, d, x / sqrt(sum(x * x) over (partition by query_id)) as x from (select label::bigint as query_id, d, avg(x) as x from (select label, unnest(range(len(embedding))) as d, unnest(embedding::double[]) as x from embeddings) group by label, d)) group by query_id)"
BLEND = f"(select q.query_id, list_transform(list_zip(q.e, m.e), lambda p: 0.3 * p[1] + 0.7 * p[2]) as e from {QV} q join embeddings v on v.vec_id = q.query_id join {MEANS} m on m.query_id = v.label)"


def keyword(query: str, text: str) -> str:
    """Of columns of a row."""
    low, asked = f"lower({text})", tok(query)
    stop = ", ".join(map(text_of, KEYWORD_STOP))
    count = lambda items: f"coalesce(list_sum(list_transform({items}, lambda p: (length({low}) - length(replace({low}, p, '')))::double / length(p))), 0)"
    keys = f"list_filter({asked}, lambda w: w not in ({stop}))"
    return f"10 * ({count(keys)} + 2 * {count(f'list_concat({grams(asked, 2)}, {grams(asked, 3)})')}) / greatest(1, len({words(text)})) + case when contains({low}, lower({query})) then 5.0 else 0.0 end"


def reranked(score: str, k: int, fetch: int = 20) -> str:
    return top(f"(select query_id, doc_id, round({score}, 6) as score from {candidates(fetch)})", k)


HISTORY = "(select conv_id, turn, coalesce(string_agg(text, ' ') over (partition by conv_id order by turn rows between 3 preceding and 1 preceding) || ' ', '') || text as query from conversations where role = 'user')"
PAIRS = "(select conv_id, turn, question, text as answer from (select *, lag(role) over w as before, lag(text) over w as question from conversations window w as (partition by conv_id order by turn)) where role = 'assistant' and before = 'user')"
ANSWERS = f"(select conv_id * 1000 + turn as id, answer, question as expected, question || ' ' || answer as context from {PAIRS})"
EXTRACT = f"""(select query_id, place, sentence, score from (select *, row_number() over (partition by query_id order by score desc, rank, pos) as place from (
select query_id, rank, pos, sentence, round(len(list_intersect(sw, q)) / (1 + 0.1 * abs(len(sw) - len(q))), 6) as score from (
select query_id, rank, q, pos, sentence, {wset('sentence')} as sw from (select query_id, rank, {wset('query')} as q, unnest(range(len(ss))) as pos, unnest(ss) as sentence from (select *, {sents('text')} as ss from {candidates(5)}))) where len(list_intersect(sw, q)) > 0)))"""


def f1(a: str, b: str) -> str:
    both = f"len(list_intersect({wset(a)}, {wset(b)}))"
    return f"case when {both} > 0 then 2.0 * {both} / (len({wset(a)}) + len({wset(b)})) else 0.0 end"


def gram_f1(n: int) -> str:
    a, b = grams(tok("answer"), n), grams(tok("expected"), n)
    return f"""(select id, sum(least(x, y)) as both from (select id, g, count(*) as x from (select id, unnest({a}) as g from {ANSWERS}) group by id, g) join (select id, g, count(*) as y from (select id, unnest({b}) as g from {ANSWERS}) group by id, g) using (id, g) group by id)"""


def gram_size(n: int) -> str:
    return f"(greatest(len({tok('answer')}) - {n - 1}, 0) + greatest(len({tok('expected')}) - {n - 1}, 0))"


def share(n: int) -> str:
    return f"len(list_filter(a{n}, lambda g: list_contains(c{n}, g)))::double / len(a{n})"


_TOKENS = f"(select id, answer, expected, {tok('answer')} as own, {tok('context')} as other from {ANSWERS})"
GRAMS = f"(select id, answer, expected, len(own) as size, {grams('own', 2)} as a2, {grams('own', 3)} as a3, list_distinct({grams('other', 2)}) as c2, list_distinct({grams('other', 3)}) as c3 from {_TOKENS})"
FAITH = f"case when size < 2 then 1.0 when size = 2 then {share(2)} else ({share(2)} + {share(3)}) / 2 end"
DIVERSITY = "case when len({0}) > 0 then len(list_distinct({0}))::double / len({0}) else 0.0 end"
QRELS = "(select q.vec_id as query_id, e.vec_id as doc_id from embeddings q join embeddings e using (label) where q.vec_id % 50 = 0)"
METRICS = f"""(select query_id, {', '.join(f'round(coalesce(h{k}, 0)::double / least({k}, n), 6) as p_at_{k}' for k in (1, 3, 5))},
{', '.join(f'round(coalesce(h{k}, 0)::double / n_relevant, 6) as r_at_{k}' for k in (1, 3, 5))}, round(coalesce(1.0 / first, 0), 6) as mrr from (
select query_id, count(*) as n, min(case when hit then rank end) as first, {', '.join(f'count(distinct case when hit and rank <= {k} then doc_id end) as h{k}' for k in (1, 3, 5))}
from (select r.*, q.doc_id is not null as hit from {vector(10)} r left join {QRELS} q using (query_id, doc_id)) group by query_id)
join (select query_id, count(*) as n_relevant from {QRELS} group by query_id) using (query_id))"""
DETAILS = f"(select *, case when query_id % 9 = 4 then 'failed' end as error, case when query_id % 3 = 0 then 'definition' else 'general' end as category from {METRICS})"

RUNS = "(select event_type as method, 'exp_' || (user_id % 7) as experiment, event_id as seq, ts, value as seconds, case when event_id % 11 <> 0 then round(value % 1, 4) end as metric_mrr from events)"
GROUPED = f"(select method, experiment, round(avg(seconds), 6) as seconds, round(avg(metric_mrr), 6) as metric_mrr from {RUNS} group by method, experiment)"


def described(source: str, columns: tuple[str, ...]) -> str:
    q = lambda c, p, n: f"round(quantile_cont({c}, {p}), 6) as {n}"
    one = lambda c: f"select '{c}' as measure, count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, min({c}) as min, {q(c, 0.25, 'p25')}, {q(c, 0.5, 'p50')}, {q(c, 0.75, 'p75')}, max({c}) as max from {source}"
    return " union all ".join(map(one, columns))


def gains(extra: str = "") -> str:
    return f"select method, round(mean, 6) as mean, round(mean - base, 6) as improvement, round((mean - base) / nullif(abs(base), 0), 6) as relative{extra} from (select method, avg(metric_mrr) as mean, avg(seconds) as seconds from {RUNS} group by method), (select avg(metric_mrr) as base from {RUNS} where method = 'click')"


BEST = f"(select * from {RUNS} where metric_mrr is not null order by metric_mrr desc, seq limit 1)"
PAIR_COSINES = f"(select query_id, doc_id, round(sum(d.weight * q.weight), 6) as score from {hash_vectors(DOCS, 'doc_id')} d join {hash_vectors(ASKED, 'query_id')} q using (bucket) group by query_id, doc_id)"
FUSED_PARTS = f"""(select query_id, doc_id, rank from {top(f"(select c.query_id, c.doc_id, coalesce(v.score, 0) as score from {candidates(20)} c left join {PAIR_COSINES} v using (query_id, doc_id))", 100)}
union all select query_id, doc_id, rank from {reranked(keyword('query', 'text'), 100)} union all select query_id, doc_id, rank from {reranked(jacc(wset('query'), wset('text')), 100)})"""
TEXT_PAIRS = f"(with v as materialized {hash_vectors(DOCS, 'doc_id')}, c as materialized {candidates(20)}, p as (select a.query_id, a.doc_id as a, b.doc_id as b from c a join c b using (query_id)) select query_id, a, b, round(coalesce((select sum(x.weight * y.weight) from v x join v y using (bucket) where x.doc_id = a and y.doc_id = b), 0), 6) as s from p)"


def rrf(parts: str, k: int = 10) -> str:
    return top(f"(select query_id, doc_id, round(sum(1 / (60.0 + rank)), 6) as score from {parts} group by query_id, doc_id)", k)


SYNONYMS = "(values ('this', 'that', 1), ('this', 'such', 2), ('that', 'this', 1), ('that', 'which_one', 2), ('with', 'with', 1), ('with', 'by', 2), ('from', 'out', 1), ('the', 'a', 1), ('there', 'here', 1), ('there', 'yonder', 2), ('there', 'thither', 3)) s(term, synonym, rank)"

HYDE = "(select query_id, 'Response to: ' || prompt as prompt from (" + "select query_id, case " + " ".join(f"when query_type = '{n}' then {text_of(p.split('%s')[0])} || text || {text_of(p.split('%s')[1])}" for n, p in PROMPTS.items()) + f" end as prompt from (select item_id as query_id, text, {query_type('text')} as query_type from benchmark)))"
HYDE_TEXTS = f"(select query_id, 0 as pos, prompt as text from {HYDE} union all select query_id, 1, prompt || ' from a technical perspective' from {HYDE})"
HYDE_MEAN = f"""(with v as {hashed(f"(select query_id, pos, unnest({tok('text')}) as term from {HYDE_TEXTS})", "query_id, pos")}, m as (select query_id, bucket, sum(weight) / 2 as x from v group by query_id, bucket)
select query_id, bucket, x / sqrt(sum(x * x) over (partition by query_id)) as weight from m)"""


def prompts(name: str) -> str:
    """(query_id, prompt) of a template over the best three texts."""
    filled = f"replace(replace({text_of(TEMPLATES[name])}, '{{context}}', context), '{{query}}', query)"
    return f"(select query_id, {filled} as prompt from (select query_id, query, string_agg(text, chr(10) || chr(10) order by rank) as context from {candidates(3)} group by query_id, query))"


QUESTIONS = f"(select question, answer as expected_answer, 'Doc 1|Doc ' || conv_id as relevant_docs, 'general' as category, 'medium' as difficulty from {PAIRS})"
_VECTOR20, _BM20 = text_vector(20), bm25(20)

ORACLE_SQL: dict[str, str] = {
    "chunk_fixed_tokens": fixed(64, 0),
    "chunk_fixed_overlap": fixed(128, 32),
    "chunk_paragraph": f"""with a as (select doc_id, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: trim(p)), lambda p: p <> '') as b, list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(p)), lambda p: p <> '') as l from documents),
p as (select doc_id, text, case when len(b) > 1 then b when len(l) > 1 then l end as parts from a),
u as (select doc_id, unnest(parts) as t, unnest(range(len(parts))) as i from p where parts is not null)
select doc_id, doc_id || '_p' || i as chunk_id, i::bigint as chunk_index, t as text from u where len({words('t')}) >= 10
union all select doc_id, null, 0, text from p where parts is null and text is not null""",
    "chunk_sentence_pack": packed(60, f"len({words('s')})"),
    "chunk_semantic_units": packed(300, f"len({words('s')})"),
    "chunk_sentence_chars": packed(500, "length(s)"),
    "chunk_sliding_windows": f"""with w as (select doc_id, text, {words('text')} as w from documents), n as (select *, len(w) as n from w where len(w) > 0),
s as (select doc_id, w, list_concat(range(0, n - 199, 100), case when (n - 200) % 100 <> 0 then [n - 200] else [] end) as st from n where n > 200),
u as (select doc_id, w, unnest(st) as s, unnest(range(len(st))) as i from s)
select doc_id, doc_id || '_sw' || i as chunk_id, i as chunk_index, array_to_string(w[s + 1:s + 200], ' ') as text from u
union all select doc_id, doc_id || '_sw0', 0, text from n where n <= 200""",
    "chunk_semantic_seg": SEMANTIC,
    "sentence_similarity": f"select * from {SIMS}",
    "chunk_estimate": "select doc_id, case when length(text) > 0 then greatest(1, floor((length(text) - 200) / 800.0)::bigint + 1) else 0 end as chunks from documents",
    "term_postings": f"select doc_id, term, count(*) as tf from (select doc_id, unnest({tok('text')}) as term from documents) group by doc_id, term",
    "corpus_stats": f"with d as (select {tok('text')} as t from documents) select count(*) as n_docs, sum(len(t))::bigint as n_tokens, round(avg(len(t)), 6) as avgdl, (select count(distinct x) from (select unnest(t) as x from d)) as n_terms from d",
    "idf_table": f"select term, df, round(idf, 6) as idf from {IDF}",
    "tfidf_vectors": f"""with p as (select doc_id, term, count(*) as tf from (select doc_id, unnest({tok('text')}) as term from documents) group by doc_id, term),
w as (select doc_id, term, tf * (ln((1 + (select count(*) from documents))::double / (1 + df)) + 1) as w from p join (select term, count(*) as df from p group by term) using (term))
select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from w""",
    "hash_embedding": f"select doc_id, bucket, round(weight, 6) as weight from {hash_vectors(DOCS, 'doc_id')}",
    "vector_topk": f"select * from {vector(10)}",
    "bm25_topk": f"select * from {bm25(10)}",
    "text_vector_topk": f"select * from {text_vector(10)}",
    "hybrid_topk": f"select * from {hybrid('0.5')}",
    "hybrid_alpha_sweep": " union all ".join(f"select *, {a}::double as alpha from {hybrid(a + '::double')}" for a in ("0.3", "0.5", "0.7")),
    "mmr_retrieve": greedy(vector(20), f"(select a.query_id, a.doc_id as a, b.doc_id as b, round(list_cosine_similarity(x.embedding::double[], y.embedding::double[]), 6) as s from {vector(20)} a join {vector(20)} b using (query_id) join embeddings x on x.vec_id = a.doc_id join embeddings y on y.vec_id = b.doc_id)", 0.5, 5),
    "mmr_scaled": greedy(f"(select query_id, doc_id, score / max(score) over (partition by query_id) as score from {vector(20)})", f"(select a.query_id, a.doc_id as a, b.doc_id as b, round(list_cosine_similarity(x.embedding::double[], y.embedding::double[]), 6) as s from {vector(20)} a join {vector(20)} b using (query_id) join embeddings x on x.vec_id = a.doc_id join embeddings y on y.vec_id = b.doc_id)", 0.7, 5),
    "multi_query_dedup": merged(f"(select query_id // 10 as query_id, query_id % 10 as variant, doc_id, rank from {bm25(10, f'(select query_id * 10 + variant as query_id, variant_text as text from {RULES})')})", 10),
    "union_dedup": f"""with u as (select r.*, d.text from (select query_id, 0 as variant, doc_id, rank from {text_vector(10)} union all select query_id, 1, doc_id, rank from {bm25(10)}) r join documents d using (doc_id))
select query_id, doc_id, place from (select *, row_number() over (partition by query_id order by variant, rank, doc_id) as place from u a where not exists (select 1 from u b where b.query_id = a.query_id and b.text = a.text and (b.variant, b.rank) < (a.variant, a.rank))) where place <= 20""",
    "hyde_mean_vector": f"select query_id, unnest(range(len(e))) as d, round(unnest(e), 6) as x from {MEANS}",
    "hybrid_hyde_topk": f"select * from {vector(10, BLEND)}",
    "classify_query": f"select doc_id, {query_type('text')} as query_type from documents",
    "hyde_prompts": "select query_id, query_type, case " + " ".join(f"when query_type = '{n}' then {text_of(p.split('%s')[0])} || text || {text_of(p.split('%s')[1])}" for n, p in PROMPTS.items()) + f" end as prompt from (select item_id as query_id, text, {query_type('text')} as query_type from benchmark)",
    "expand_templates": "select item_id as query_id, unnest(range(3)) as variant, unnest([text, 'information about ' || text, 'explain ' || text]) as variant_text from benchmark",
    "multi_query_rules": f"select * from {RULES}",
    "expand_synonyms": f"""select item_id as query_id, 0::bigint as variant, text as variant_text from benchmark
union all select query_id, pos * 100 + rank, array_to_string(list_concat(t[1:pos], [synonym], t[pos + 2:]), ' ') from (select query_id, t, unnest(range(len(t))) as pos, unnest(t) as term from (select item_id as query_id, {tok('text')} as t from benchmark)) p join {SYNONYMS} using (term)
where length(term) > 3 and rank <= 2 and not contains(synonym, '_') and synonym <> term""",
    "llm_line_parse": "select item_id as query_id, unnest(range(4)) as variant, unnest([text, 'first of q' || item_id || 'x', 'second', '- first of q' || item_id || 'x']) as variant_text from benchmark",
    "jaccard_rerank": f"select * from {reranked(jacc(wset('query'), wset('text')), 10)}",
    "keyword_rerank": f"select * from {reranked(keyword('query', 'text'), 10)}",
    "llm_rating": "select item_id as query_id, round(least(greatest(item_id % 15, 1), 10) / 10.0, 6)::double as score from benchmark",
    "contextual_query": f"select * from {HISTORY}",
    "contextual_rerank": f"select * from {top(f'''(select p.conv_id as query_id, p.turn - 1 as doc_id, round({jacc(wset('query'), wset('answer'))}, 6) as score from {PAIRS} p join {HISTORY} h on h.conv_id = p.conv_id and h.turn = p.turn - 1)''', 100)}",
    "rrf_fusion": f"select * from {rrf(f'(select query_id, doc_id, rank from {text_vector(20)} union all select query_id, doc_id, rank from {bm25(20)})')}",
    "multi_stage_fused": f"""with f as materialized {rrf(FUSED_PARTS, 100)}, m as ({greedy("(select query_id, doc_id, score / max(score) over (partition by query_id) as score from f)", TEXT_PAIRS, 0.7, 20)})
select query_id, doc_id, f.score, m.place as rank from m join f using (query_id, doc_id) where m.place <= 10""",
    "multi_stage_sequential": f"""with s as materialized (select query_id, doc_id, rank as before, round({keyword('query', 'text')}, 6) as first, round({jacc(wset('query'), wset('text'))}, 6) as score from {candidates(20)}),
m as (select *, row_number() over (partition by query_id order by first desc nulls last, before, doc_id) as place from s)
select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc nulls last, place) as rank from m) where rank <= 10""",
    "diversity_mmr": greedy(f"(select query_id, doc_id, round({jacc(wset('query'), wset('text'))}, 6) as score from {candidates(20)})", f"(with c as materialized (select query_id, doc_id, {wset('text')} as w from {candidates(20)}) select a.query_id, a.doc_id as a, b.doc_id as b, round({jacc('a.w', 'b.w')}, 6) as s from c a join c b using (query_id))", 0.5, 5),
    "extractive_sentences": f"select * from {EXTRACT} where place <= 3",
    "extractive_answer": f"""with b as (select query_id, list(sentence order by place) as s from {EXTRACT} where place <= 3 group by query_id)
select q.query_id, coalesce(case when len(list_filter(s, lambda x: len({words('x')}) >= 10)) = 0 then array_to_string(s, ' ') when len(s) > 1 and {jacc(wset('s[1]'), wset('s[2]'))} < 0.7 then s[1] || ' ' || s[2] else s[1] end, {text_of(NO_ANSWER)}) as answer
from (select distinct query_id from {candidates(5)}) q left join b using (query_id)""",
    "prompt_assembly": f"select query_id, 'Context:' || chr(10) || string_agg(text, chr(10) || chr(10) order by rank) || chr(10) || chr(10) || 'Question: ' || query || chr(10) || chr(10) || 'Answer:' as prompt from {candidates(3)} group by query_id, query",
    "answer_compare": f"select id, a as words, b as other_words, round(100.0 * abs(a - b) / nullif(greatest(a, b), 0), 6) as difference_percent from (select conv_id * 1000 + turn as id, len({words('answer')}) as a, len({words('question')}) as b from {PAIRS})",
    "lexical_diversity": f"select doc_id, round({DIVERSITY.format(words('lower(text)'))}, 6) as diversity from documents",
    "precision_recall_mrr": f"select * from {METRICS}",
    "pseudo_qrels": f"""with q as (select item_id as query_id, list_distinct({tok('text')}) as t from benchmark), s as (select query_id, doc_id, any_value(size) as size, count(*) as shared from (select query_id, len(t) as size, unnest(t) as term from q) join (select doc_id, unnest(list_distinct({tok('text')})) as term from documents) using (term) group by query_id, doc_id)
select query_id, doc_id, shared from (select *, shared >= least(3, size) as enough, max((shared >= least(3, size))::int) over (partition by query_id) as met, row_number() over (partition by query_id order by shared desc, doc_id) as place from s) where enough or met = 0 and place <= 2""",
    "containment_qrels": f"select b.item_id as query_id, d.doc_id from (select item_id, array_to_string({words('text')}, ' ') as q from benchmark) b join (select doc_id, array_to_string({words('text')}, ' ') as t from documents) d on contains(d.t, b.q)",
    "rouge_overlap": f"select id, round({f1('answer', 'expected')}, 6) as rouge1 from {ANSWERS}",
    "rouge_ngrams": f"select a.id, round(coalesce(2.0 * x.both / {gram_size(1)}, 0), 6) as rouge1, round(coalesce(2.0 * y.both / nullif({gram_size(2)}, 0), 0), 6) as rouge2 from {ANSWERS} a left join {gram_f1(1)} x using (id) left join {gram_f1(2)} y using (id)",
    "faithfulness": f"select id, round({FAITH}, 6) as faithfulness from {GRAMS}",
    "relevance_precision": f"select query_id, round(avg(case when len(q) > 0 then len(list_intersect(q, t))::double / len(q) else 0 end), 6) as relevance from (select query_id, {wset('query')} as q, {wset('text')} as t from {candidates(5)}) group by query_id",
    "mean_relevance": f"select query_id, round(avg({jacc('q', 't')}), 6) as relevance from (select query_id, {wset('query')} as q, {wset('text')} as t from {candidates(5)}) group by query_id",
    "answer_heuristics": f"""select id, round(r, 6) as rouge1, round(r * 0.8, 6) as rouge2, round(r * 0.9, 6) as rougel, round(f, 6) as faithfulness, round((r + f) / 2, 6) as answer_correctness,
case when contains(answer, '[') and contains(answer, ']') then 1.0 when contains(lower(answer), 'according to') or contains(lower(answer), 'mentioned in') then 0.8 else 0.0 end::double as citation_rate,
case when o > 5 then 0.8 when o > 2 then 0.6 else 0.5 end::double as correctness, round(d, 6) as lexical_diversity
from (select id, answer, {f1('answer', 'expected')} as r, {FAITH} as f, len(list_intersect({wset('answer')}, {wset('expected')})) as o, {DIVERSITY.format(words('lower(answer)'))} as d from {GRAMS})""",
    "eval_aggregate": "select " + ", ".join(f"round(avg(case when error is null then {m} end), 6) as avg_{m}" for m in ("p_at_5", "r_at_5", "mrr")) + f", count(*) as question_count, count(error) as failed_count from {DETAILS}",
    "eval_by_category": "select category, " + ", ".join(f"round(avg({m}), 6) as {m}" for m in ("p_at_1", "p_at_3", "p_at_5", "r_at_1", "r_at_3", "r_at_5", "mrr")) + f", count(*) as n_queries from {DETAILS} group by category",
    "union_runs": f"select experiment, seq, seconds, null::double as metric_mrr, null::varchar as method from {RUNS} where seq % 2 = 0 union all select experiment, seq, null, metric_mrr, method from {RUNS} where seq % 2 = 1",
    "group_mean": f"select experiment, method, seconds, metric_mrr from {GROUPED}",
    "summary_mean_std": f"select method, round(avg(seconds), 6) as seconds_mean, round(stddev_samp(seconds), 6) as seconds_std, round(avg(metric_mrr), 6) as metric_mrr_mean, round(stddev_samp(metric_mrr), 6) as metric_mrr_std, count(*) as n from {RUNS} group by method",
    "group_size": f"select experiment, method, count(*) as n from {RUNS} group by experiment, method",
    "group_first": f"select method, arg_min(seconds, seq) as seconds from {RUNS} group by method",
    "left_join_attach": f"select a.method, a.metric_mrr, b.seconds from (select method, round(avg(metric_mrr), 6) as metric_mrr from {RUNS} group by method) a left join (select method, arg_min(seconds, seq) as seconds from {RUNS} where method <> 'click' group by method) b using (method)",
    "derived_columns": f"select seq, round(1 / greatest(seconds, 0.001), 6) as per_second, experiment || '_' || method as config, case method when 'click' then 1.0 when 'view' then 0.5 end::double as efficiency from {RUNS}",
    "describe_stats": described(RUNS, ("seconds", "metric_mrr")),
    "describe_lineitem": described("lineitem", ("l_quantity", "l_extendedprice", "l_discount")),
    "pivot_mean": """select l_returnflag, round(avg(case when l_linestatus = 'F' then l_extendedprice end), 6) as "F", round(avg(case when l_linestatus = 'O' then l_extendedprice end), 6) as "O" from lineitem group by l_returnflag""",
    "melt_metrics": f"select seq, 'Run Time' as metric, seconds as score from {RUNS} union all select seq, 'Mrr', metric_mrr from {RUNS}",
    "best_config": f"select method, experiment, seq, metric_mrr from {BEST}",
    "best_config_per_group": f"select method, experiment, seq, metric_mrr from (select *, row_number() over (partition by method order by metric_mrr desc, seq) as n from {RUNS} where metric_mrr is not null) where n = 1",
    "metric_fallback": f"select seq, 'metric_mrr' as metric from {BEST}",
    "min_max_balance": f"select method, experiment, round(0.5 * (metric_mrr - a) / nullif(b - a, 0) + 0.5 * (1 - (seconds - c) / nullif(d - c, 0)), 6) as balance from {GROUPED}, (select min(metric_mrr) as a, max(metric_mrr) as b, min(seconds) as c, max(seconds) as d from {GROUPED})",
    "improvement_over_baseline": gains(),
    "improvement_per_second": gains(", round((mean - base) / nullif(seconds, 0), 6) as per_second"),
    "pareto_frontier": f"select method, seq, seconds, metric_mrr from (select *, max(metric_mrr) over (partition by method order by seconds, seq rows between unbounded preceding and 1 preceding) as m from {RUNS} where metric_mrr is not null) where metric_mrr > greatest(coalesce(m, 0), 0)",
    "ci95": f"select method, round(m, 6) as mean, round(m - h, 6) as low, round(m + h, 6) as high, n from (select method, avg(metric_mrr) as m, coalesce(1.96 * stddev_samp(metric_mrr) / sqrt(count(metric_mrr)), 0) as h, count(metric_mrr) as n from {RUNS} group by method)",
    "time_metric_corr": "select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) as corr from lineitem group by l_returnflag",
    "median_quadrants": f"select method, experiment, case when seconds <= c then 'fast' else 'slow' end || '_' || case when metric_mrr >= v then 'good' else 'poor' end as quadrant from {GROUPED}, (select median(seconds) as c, median(metric_mrr) as v from {GROUPED})",
    "config_grid": "select * from (select distinct event_type from events), (select distinct coalesce(lang, 'und') as lang from documents), (select distinct o_orderpriority from orders)",
    "turn_pairing": f"select * from {PAIRS}",
    "latest_run_best": f"select seq, method, metric_mrr from {RUNS} where ts::date = (select max(ts::date) from events) and metric_mrr is not null order by metric_mrr desc, seq limit 1",
    "dedup_keep_first": f"select method, experiment, seq, seconds from (select *, row_number() over (partition by method, experiment order by seq) as n from {RUNS}) where n = 1",
    "missing_metric_count": f"select 'seconds' as column, count(*) - count(seconds) as missing from {RUNS} union all select 'metric_mrr', count(*) - count(metric_mrr) from {RUNS}",
    "seeded_sample": "select doc_id from documents order by md5('42:' || doc_id), doc_id limit 50",
    "best_across_experiments": f"select experiment, max(seconds) as seconds, max(metric_mrr) as metric_mrr from {RUNS} group by experiment",
    "run_timeline": f"select method, seq, round(epoch_us(ts - a)::double / nullif(epoch_us(b - a), 0), 6) as place, round(epoch_us(ts - c)::double / nullif(epoch_us(d - c), 0), 6) as place_in_type from (select *, min(ts) over () as a, max(ts) over () as b, min(ts) over (partition by method) as c, max(ts) over (partition by method) as d from {RUNS})",
    "ordered_categories": f"select distinct method, case method when 'view' then 1 when 'click' then 2 else 3 end::bigint as place from {RUNS}",
    "upsert_by_name": "select c_custkey, case when c_custkey % 5 = 0 then 'NEW' else c_mktsegment end as c_mktsegment from customer",
    "question_profile": "select count(*) as questions, (select string_agg(x, ',' order by x) from (select distinct lang as x from documents)) as category, (select string_agg(x, ',' order by x) from (select distinct source as x from documents)) as difficulty from documents",
    "question_filter": "select * from labels where quality = 1 and toxic = 0",
    "display_missing": f"select seq, coalesce(printf('%.4f', metric_mrr), 'N/A') as metric_mrr from {RUNS}",
    "recommendation_json": f"""select '{{"best_config":{{"method":"' || method || '","experiment":"' || experiment || '"}},"score":' || round(metric_mrr, 6) || ',"metric":"metric_mrr"}}' as recommendation from {BEST}""",
    "latency_windows": "select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(avg(value), 6) as mean_value, max(value) as max_value from events group by all",
    "llm_line_parse_fallback": "select item_id as query_id, unnest(range(3)) as variant, unnest([text, 'Information about ' || text, 'Tell me about ' || text]) as variant_text from benchmark",
    "hyde_documents": f"select query_id, pos::bigint as pos, text from {HYDE_TEXTS}",
    "transform_router": f"select *, 'multi_query' as method from {RULES} union all select item_id, unnest(range(3)), unnest([text, 'information about ' || text, 'explain ' || text]), 'templates' from benchmark union all select item_id, 0, text, unnest(['none', 'hybrid']) from benchmark",
    "multi_query_k5": merged(f"(select query_id // 10 as query_id, query_id % 10 as variant, doc_id, rank from {bm25(5, f'(select query_id * 10 + variant as query_id, variant_text as text from {RULES})')})", 10),
    "retrieve_dispatch": f"select *, 'vector' as method from {text_vector(10)} union all select *, 'bm25' from {bm25(10)} union all select *, 'hybrid' from {hybrid('0.5')}",
    "hyde_vector_topk": f"select * from {top(f"(select query_id, doc_id, round(sum(d.weight * q.weight), 6) as score from {hash_vectors(DOCS, 'doc_id')} d join {HYDE_MEAN} q using (bucket) group by query_id, doc_id)", 10)}",
    "index_build": f"select chunk_id, length(text) as chars, round(1.0::double, 6) as norm from ({fixed(256, 0)})",
    "cross_encoder_rerank": f"select * from {reranked(jacc(wset('query'), wset('text')), 10)}",
    "llm_rerank": f"select * from {reranked(f"floor(1 + 9 * ({jacc(wset('query'), wset('text'))}) + 0.5) / 10", 10)}",
    "fusion_vector_bm25": f"select * from {rrf(f'(select query_id, doc_id, rank from {_VECTOR20} union all select query_id, doc_id, rank from {_BM20})')}",
    "fusion_vector_cross_encoder": f"""with v as materialized {_VECTOR20}, p as (select v.query_id, v.doc_id, d.text, b.text as query from v join documents d using (doc_id) join benchmark b on b.item_id = v.query_id)
select * from {rrf(f"(select query_id, doc_id, rank from v union all select query_id, doc_id, rank from {top(f"(select query_id, doc_id, round({jacc(wset('query'), wset('text'))}, 6) as score from p)", 100)})")}""",
    "prompt_templates": " union all ".join(f"select *, '{n}' as template from {prompts(n)}" for n in ("basic", "instructional", "extractive", "citation")),
    "generated_answer": f"select query_id, 'Response to: ' || prompt as answer from {prompts('basic')}",
    "answer_contexts": f"select query_id, string_agg(rank || ':' || doc_id || ':' || length(text), ',' order by rank) as contexts from {candidates(3)} group by query_id",
    "metric_columns": f"select seq, metric_mrr, seconds as metric_seconds from {RUNS}",
    "sort_keys": f"select *, row_number() over (order by method, metric_mrr desc nulls last, seq) as place from (select method, metric_mrr, seq from {RUNS} order by method, metric_mrr desc nulls last, seq limit 100)",
    "best_alpha": "select l_discount, round(avg(l_extendedprice), 6) as l_extendedprice from lineitem group by l_discount order by 2 desc, 1 limit 1",
    "drop_null": f"select seq, metric_mrr from {RUNS} where metric_mrr is not null",
    "head_sample": "select doc_id, lang from documents order by doc_id limit 50",
    "empty_guard": f"select 'all' as name, count(*) > 0 as has_rows from {RUNS} union all select 'none', count(*) > 0 from {RUNS} where seq < 0",
    "answer_contexts_reranked": f"select query_id, string_agg(r.rank || ':' || doc_id || ':' || length(d.text), ',' order by r.rank) as contexts from {reranked(jacc(wset('query'), wset('text')), 3, 10)} r join documents d using (doc_id) group by query_id",
    "bm25_index_topk": f"select * from {bm25(10)}",
    "vector_index_topk": f"select * from {vector(10)}",
    "grid_size": "select (select count(distinct event_type) from events) * (select count(distinct coalesce(lang, 'und')) from documents) * (select count(distinct o_orderpriority) from orders) as configurations",
    "plottable_columns": "select unnest(['seq', 'seconds', 'metric_mrr']) as name",
    "profile_first_five": "select doc_id, lang as category, source as difficulty from documents order by doc_id limit 5",
    "config_merge": "select user_id, event_type as name, arg_max(value, event_id) as value from events group by user_id, event_type",
    "config_diff": """with e as (select user_id, event_type as name, arg_max(value, event_id) as value from events group by all), h as (select max(event_id) // 2 as half from events),
f as (select user_id, event_type as name, arg_max(value, event_id) as value from events, h where event_id <= half group by all)
select user_id, name, f.value as old, e.value as new from f full join e using (user_id, name) where f.value is distinct from e.value""",
    "embedder_menu": f"""select v.*, case when registered then (select count(*) from documents) end as n_texts, case when registered then (select count(*) from documents where coalesce(len({tok('text')}), 0) = 0) end as n_empty
from (values ('Offline', 'hash', true), ('Lightweight (Fast)', 'all-MiniLM-L6-v2', false), ('Lightweight (Fast)', 'BAAI/bge-small-en-v1.5', false), ('Balanced', 'all-mpnet-base-v2', false), ('Specialized', 'multi-qa-mpnet-base-dot-v1', false), ('Commercial API', 'text-embedding-ada-002', false)) v(tier, name, registered)""",
    "experiment_grids": "select experiment, configurations, configurations * (select count(*) from benchmark) as answered from (values ('chunking', 33::bigint), ('embedding', 1), ('retrieval', 8), ('query_processing', 7), ('reranking', 7), ('generation', 12)) v(experiment, configurations)",
    "config_compare": f"select method as config, round(avg(seconds), 6) as seconds, round(avg(metric_mrr), 6) as metric_mrr from {RUNS} group by method",
    "evaluation_report": f"select method as config_name, seq as question, metric_mrr as mrr, count(*) over (partition by method) as n from {RUNS}",
    "source_text": "select trim(p) as text from (select unnest(string_split(text, chr(10))) as p from documents) where trim(p) <> ''",
    "source_csv": "select 'Doc ' || doc_id as title, text from documents",
    "source_jsonl": "select 'Doc ' || doc_id as title, text from documents where text is not null",
    "source_parquet": "select doc_id, text from documents",
    "document_struct": "select doc_id, case when doc_id % 2 = 0 then 'T' || doc_id else 'Untitled Document' end as title, text from documents",
    "questions_json": f"select 'turns' as name, * from {QUESTIONS}",
    "questions_csv": f"select * from {QUESTIONS}",
    "questions_template": f"select 'What is retrieval?' as question, 'Finding relevant documents.' as expected_answer, 'Document 1|Document 2' as relevant_docs, 'general' as category, 'medium' as difficulty union all select question, expected_answer, relevant_docs, category, difficulty from {QUESTIONS}",
    "runs_csv": f"select seq, metric_mrr, method as experiment, '2025-04-18 17:08:53' as run_ts from {RUNS}",
    "runs_parquet": f"select method as experiment, seq, case when method = 'click' then seconds end as seconds, case when method <> 'click' then metric_mrr end as metric_mrr from {RUNS}",
    "run_folders": "select event_type || '_experiment_' || strftime(d, '%Y%m%d') || '_120000' as folder, event_type as experiment, strftime(d, '%Y-%m-%d') || ' 12:00:00' as run_ts, row_number() over (order by d desc, event_type || '_experiment_' || strftime(d, '%Y%m%d') || '_120000') as place from (select distinct event_type, ts::date as d from events)",
}
ORACLE_SQL["chunk_chars"] = """with recursive p as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') as ps from documents),
c as materialized (select doc_id, ps, len(ps) as n, list_transform(range(len(ps) + 1), lambda k: coalesce(list_sum(list_transform(ps[1:k], lambda x: length(x))), 0)::bigint) as cum from p where len(ps) > 0),
r(doc_id, i, lo, ended) as (select doc_id, 0::bigint, 0::bigint, null::bigint from c
  union all select doc_id, i + 1, case when flush then list_filter(range(lo, i + 1), lambda k: k = i or (cum[i + 1] - cum[k + 1] + i - k - 1 <= 200 and cum[i + 1] - cum[k + 1] + i - k + size <= 1000))[1] else lo end, case when flush then lo end
  from (select r.doc_id, r.i, r.lo, cum, length(ps[r.i + 1]) as size, r.lo < r.i and cum[r.i + 1] - cum[r.lo + 1] + r.i - r.lo + length(ps[r.i + 1]) > 1000 as flush from r join c using (doc_id) where r.i < c.n)),
ends as (select doc_id, ended as a, i - 1 as b from r where ended is not null union all select doc_id, lo, i from r join c using (doc_id) where i = n),
texts as (select doc_id, b, trim(array_to_string(ps[a + 1:b], chr(10)), ' ' || chr(9) || chr(10) || chr(13)) as text from ends join c using (doc_id)),
numbered as (select *, row_number() over (partition by doc_id order by b) - 1 as i from texts where text <> '')
select doc_id, doc_id || '_c' || i as chunk_id, i as chunk_index, text from numbered"""
ORACLE_SQL["rouge_lcs"] = f"""with recursive w as materialized (select id, {tok("answer")} as a, {tok("expected")} as b from {ANSWERS}),
r(id, i, best) as (select id, 0, list_transform(b, lambda x: 0) from w
  union all select id, i, list_transform(range(1, len(v) + 1), lambda j: list_max(v[1:j])) from (
  select r.id, r.i + 1 as i, list_transform(range(1, len(b) + 1), lambda k: case when b[k] = a[r.i + 1] then coalesce(r.best[k - 1], 0) + 1 else r.best[k] end) as v from r join w using (id) where r.i < len(a)))
select id, round(case when n > 0 then 2.0 * n / (len(a) + len(b)) else 0 end, 6) as rouge_l from (select w.id, a, b, coalesce(r.best[len(b)], 0) as n from r join w using (id) where r.i = len(a))"""
ORACLE_SQL["chunk_validate"] = f"select doc_id, coalesce(chunk_id, 'paragraphs_0_0_' || doc_id || '_' || chunk_index) as chunk_id, chunk_index, text from ({ORACLE_SQL['chunk_paragraph']})"


def _chunk_rows(sql: str) -> str:
    return f"(select doc_id * 2097152 + chunk_index as doc_id, doc_id as source_id, text from ({sql}))"


def _means(config: str, ranking: str, chunks: str) -> str:
    """One row: the mean ranking metrics of rankings of chunks, against the documents of ``pseudo_qrels``."""
    cuts = (1, 3, 5)
    part = lambda a, b: f"case when {b} > 0 then round({a}::double / {b}, 6) else 0 end"
    names = [*(f"p_at_{k}" for k in cuts), *(f"r_at_{k}" for k in cuts), "mrr"]
    return f"""select {text_of(config)} as config, {", ".join(f"round(avg({m}), 6) as {m}" for m in names)} from (
select {", ".join(part(f"coalesce(h{k}, 0)", f"least({k}, coalesce(n, 0))") + f" as p_at_{k}" for k in cuts)}, {", ".join(part(f"coalesce(h{k}, 0)", "coalesce(n_relevant, 0)") + f" as r_at_{k}" for k in cuts)}, round(coalesce(1.0 / first, 0), 6) as mrr
from (select item_id as query_id from benchmark) b left join (select query_id, count(*) as n, min(case when hit then rank end) as first, {", ".join(f"count(distinct case when hit and rank <= {k} then doc_id end) as h{k}" for k in cuts)}
  from (select f.*, q.doc_id is not null as hit from (select query_id, source_id as doc_id, min(rank) as rank from {ranking} r join {chunks} c using (doc_id) group by query_id, source_id) f left join pq q using (query_id, doc_id)) group by query_id) using (query_id)
left join (select query_id, count(*) as n_relevant from pq group by query_id) using (query_id))"""


def _grid_sql(parts: list[tuple[str, str, str]]) -> str:
    """parts: a configuration's changes, its ranking and its chunks."""
    return f"with pq as materialized ({ORACLE_SQL['pseudo_qrels']}) " + " union all ".join(f"({_means(*p)})" for p in parts)


def _retrieved(method: str, alpha: float, k: int, chunks: str, asked: str = ASKED) -> str:
    plain = f"(select doc_id, text from {chunks})"
    return bm25(k, asked, plain) if method == "bm25" else text_vector(k, asked, plain) if method == "vector" else hybrid(str(alpha), k, asked, plain)


def _expanded(method: str, alpha: float, k: int, chunks: str) -> str:
    """Rankings of a query's variants by synonyms, merged."""
    asked = f"(select query_id * 1000000 + variant as query_id, variant_text as text from ({ORACLE_SQL['expand_synonyms']}))"
    each = f"(select query_id // 1000000 as query_id, query_id % 1000000 as variant, doc_id, rank from {_retrieved(method, alpha, k, chunks, asked)})"
    return f"(select query_id, doc_id, place as rank from ({merged(each, k)}))"


def experiments(chunk_grid: list[dict], retrieval_grid: list[dict], rerank_grid: list[dict]) -> dict[str, str]:
    """SQL of the experiments whose configurations are given; the last two grids are over paragraphs."""
    import json

    sql = {("paragraphs", None): ORACLE_SQL["chunk_paragraph"], ("fixed_tokens", 64): fixed(64, 0), ("fixed_tokens", 128): fixed(128, 32)}
    name = lambda c: json.dumps(c, sort_keys=True)
    own = lambda c: "chunks" + str(c.get("chunk_size", ""))
    views = {own(c): _chunk_rows(sql[c.get("chunking_strategy", "paragraphs"), c.get("chunk_size")]) for c in chunk_grid}
    with_chunks = lambda parts, names: "with " + ", ".join(f"{n} as materialized {views[n]}" for n in names) + " select * from (" + _grid_sql(parts) + ")"
    chunk_parts = [(name(c), _retrieved(c["retrieval_method"], 0.5, 5, own(c)), own(c)) for c in chunk_grid]
    found = lambda c: (_expanded if c.get("use_query_expansion") else _retrieved)(c["retrieval_method"], c.get("retrieval_alpha", 0.5), 5, "chunks")

    def reranked_by(c: dict) -> str:
        if not c.get("use_reranking", True):
            return found(c)
        first = _retrieved(c["retrieval_method"], 0.5, 20, "chunks")
        if c["reranking_method"] == "fusion":
            return rrf(f"(select query_id, doc_id, rank from {first} union all select query_id, doc_id, rank from {_retrieved('bm25', 0.5, 20, 'chunks')})", 5)
        return top(f"(select query_id, doc_id, round({jacc(wset('b.text'), wset('d.text'))}, 6) as score from {first} r join chunks d using (doc_id) join benchmark b on b.item_id = r.query_id)", 5)

    return {
        "experiment_chunking_part": with_chunks(chunk_parts, views),
        "experiment_retrieval": with_chunks([(name(c), found(c), "chunks") for c in retrieval_grid], ["chunks"]),
        "experiment_reranking": with_chunks([(name(c), reranked_by(c), "chunks") for c in rerank_grid], ["chunks"]),
    }
