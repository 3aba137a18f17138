"""The queries of this package: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import chatformat, codebooks, collocations, decontaminate, htmltext, langid, ngramlm, packing, quality, simhash, toxicity, urlfilter, warczip
from quillon.llm.common import table

#: The rules of op1 and the extra conversation of op5.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
EXTRA_CONVERSATION = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chatformat.digests(chatformat.windows(turns.unionByName(extra)))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.classes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.score_corpus(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, ranks = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))
    return packing.pack(table(spark, sf_dir, "documents"), path, ranks, public_tokenizers.PATTERN)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warczip.round_trip(table(spark, sf_dir, "pages"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.codes(table(spark, sf_dir, "embeddings"))


_OPERATORS = (op1_urls, op2_decontamination, op3_main_text, op4_language, op5_chat, op6_simhash, op7_repetition, op8_toxicity, op9_language_model, op10_packing, op11_collocations, op12_warc, op13_codes)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _OPERATORS}



def _repetition_sql() -> str:
    """op7 from its definition: every n-gram as a list of words, windows counted per text."""
    covers = (3, *quality.MAX_COVER)
    grams = " union all ".join(f"select doc_id, i, {n} as n, w[i:i + {n - 1}] as g from p where i <= len(w) - {n - 1}" for n in covers)
    cover = lambda n: f"coalesce(r{n}.chars, 0)::double / greatest(word_chars, 1)"
    joins = " ".join(f"left join (select * from r where n = {n}) r{n} using (doc_id)" for n in covers)
    base = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
    kept = " and ".join([f"not ({base})", f"line_cover <= {quality.MAX_LINE_COVER}", *(f"cover_{n} <= {most}" for n, most in quality.MAX_COVER.items())])
    return rf"""with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
g as ({grams}),
again as (select doc_id, n, i from (select *, count(*) over (partition by doc_id, n, g) as times from g) where times > 1),
inside as (select distinct doc_id, n, unnest(range(i, i + n)) as i from again),
r as (select x.doc_id, x.n, count(*) as words, sum(length(p.w[x.i])) as chars from inside x join p using (doc_id, i) group by x.doc_id, x.n),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from d),
dup as (select doc_id, count(*) as lines, sum(bare) as chars from (select doc_id, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) as bare, row_number() over (partition by doc_id, line order by i) as k from l) where k > 1 and bare > 0 group by doc_id),
f as (select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
coalesce(dup.lines, 0) as n_dup_lines, coalesce(r3.words, 0) as n_repeat_words, coalesce(dup.chars, 0)::double / greatest(word_chars, 1) as line_cover, {", ".join(f"{cover(n)} as cover_{n}" for n in quality.MAX_COVER)} from d left join dup using (doc_id) {joins})
select *, {base} as base_failed, {kept} as kept from f"""


def _chat_sql() -> str:
    """op5 from its definition: windows turn by turn, texts escaped, all counted and hashed."""
    esc = lambda c: rf"replace(replace(replace({c}, '\', '\s'), '<turn', '\lturn'), '</turn', '\l/turn')"
    role = lambda c: rf"replace({esc(c)}, '>', '\g')"
    extra = " union all ".join(f"select {c}, {t}, '{r}', '{x}'" for c, t, r, x in EXTRA_CONVERSATION)
    return rf"""with recursive a as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from (select conv_id, turn, role, text from conversations union all {extra})),
b as (select *, row_number() over w as i, count(*) over (partition by conv_id) as n_turns, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]')) + {chatformat.OVERHEAD} as n from a window w as (partition by conv_id order by turn, role, text)),
s as (select conv_id, n as sys, length('<turn:system>' || {esc("text")} || '</turn>') + 2 as head from b where i = 1 and role = 'system' and n_turns > 1),
t as (select b.*, coalesce(sys, 0) as sys, coalesce(head, 0) as head, row_number() over (partition by b.conv_id order by i) as k, length('<turn:' || {role("role")} || '>' || {esc("text")} || '</turn>') + 2 as size from b left join s using (conv_id) where not (i = 1 and s.conv_id is not null)),
f(conv_id, k, win, used) as (select conv_id, k, 1, n from t where k = 1
  union all select t.conv_id, t.k, case when f.used + t.n > greatest(1, greatest(1, {chatformat.BUDGET} - t.sys) - case when f.win > 1 then {chatformat.HISTORY} else 0 end) then f.win + 1 else f.win end,
  case when f.used + t.n > greatest(1, greatest(1, {chatformat.BUDGET} - t.sys) - case when f.win > 1 then {chatformat.HISTORY} else 0 end) then t.n else f.used + t.n end from f join t on t.conv_id = f.conv_id and t.k = f.k + 1),
w as (select t.*, f.win, sum(t.n) over (partition by t.conv_id, f.win order by t.k desc) as "left" from t join f using (conv_id, k)),
own as (select conv_id, win, sum(n) as n from w group by conv_id, win),
again as (select w.conv_id, sum(w.size) as size from w join own o on o.conv_id = w.conv_id and o.win = w.win + 1 where w."left" <= least({chatformat.HISTORY}, {chatformat.BUDGET} - w.sys - o.n) group by w.conv_id),
c as (select conv_id, max(win)::bigint as n_windows, sum(size) + max(head) * max(win) as chars from w group by conv_id)
select b.conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256, coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256, (any_value(c.chars) + coalesce(any_value(again.size), 0))::bigint as formatted_chars, any_value(c.n_windows) as n_windows
from b join c using (conv_id) left join again using (conv_id) group by b.conv_id"""


def _collocation_sql() -> str:
    """op11 from its definition: all phrases of up to three words of every piece, counted."""
    return rf"""with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from d),
g as materialized (select lang, k, w[i:i + k - 1] as g, count(*) as f from (select lang, w, unnest(range(1, len(w) + 1)) as i from p), (values (1), (2), (3)) as sizes(k) where i + k - 1 <= len(w) group by all),
total as (select lang, sum(f)::bigint as n from g where k = 1 group by lang),
c as materialized (select lang, k, g, f from g where k > 1 and f >= {collocations.LEAST}),
halves as (select lang, k, g, f, 1 as cut, array_to_string(g[1:1], ' ') as x, array_to_string(g[2:k], ' ') as y from c union all select lang, k, g, f, 2, array_to_string(g[1:2], ' '), array_to_string(g[3:3], ' ') from c where k = 3),
parts as (select lang, array_to_string(g, ' ') as x, f from g where f >= {collocations.LEAST}),
cuts as (select h.*, l.f as l, r.f as r, (1000000::hugeint * h.f * h.f) // (l.f::hugeint * r.f) as score from halves h join parts l on l.lang = h.lang and l.x = h.x join parts r on r.lang = h.lang and r.x = h.y),
best as (select * from (select *, row_number() over (partition by lang, g order by score, cut) as z from cuts) where z = 1),
longer as (select lang, g, max(f) as f from (select lang, g[1:2] as g, f from c where k = 3 union all select lang, g[2:3], f from c where k = 3) group by lang, g),
kept as (select b.* from best b left join longer o on o.lang = b.lang and o.g = b.g and b.k = 2 where o.f is null or 100 * o.f < {collocations.COVERED} * b.f),
ranked as (select lang, array_to_string(g, ' ') as phrase, f as a, l, r, score::bigint as score, row_number() over (partition by lang order by score desc, f desc, encode(array_to_string(g, ' '))) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join total using (lang) where rank <= {collocations.TOP}"""


def _warc_sql() -> str:
    """op12 from its definition: the first of equal payloads is the response."""
    return f"""with p as (select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as payload_digest, strlen(coalesce(html, '')) as payload_bytes from pages),
f as (select *, case when payload_bytes >= {warczip.REVISIT} then min(page_id) over (partition by payload_digest) else page_id end as first from p)
select page_id, payload_bytes, payload_digest, case when first is null or first = page_id then 'response' else 'revisit' end as record_type, case when first <> page_id then first end as refers_to from f"""


def _codebook_sql() -> str:
    """op13 from its definition: plain Lloyd rounds over integers."""
    parts, entries = codebooks.PARTS, codebooks.ENTRIES
    near = lambda c: f"select r, p, (array_agg(e order by d, e))[1] as e, min(d) as d from (select x.r, x.p, c.e, sum((x.v - c.v) * (x.v - c.v))::bigint as d from x join {c} c using (p, j) group by x.r, x.p, c.e) group by r, p"
    floored = "(sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*)"
    rounds = ""
    for i in range(codebooks.ROUNDS):
        rounds += f"a{i} as materialized ({near(f'c{i}')}), c{i + 1} as materialized (select p, e, j, coalesce(m.v, c{i}.v) as v from c{i} left join (select x.p, a{i}.e, x.j, ({floored})::bigint as v from x join a{i} using (r, p) group by x.p, a{i}.e, x.j) m using (p, e, j)), "
    last = f"c{codebooks.ROUNDS}"
    return f"""with w as (select row_number() over (order by vec_id) as r, vec_id, label, list_transform(embedding, lambda x: floor({codebooks.SCALE} * x::double)::bigint) as v from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as materialized (select r, (i - 1) // (len // {parts}) as p, (i - 1) % (len // {parts}) as j, v[i] as v from (select r, v, len(v) as len, unnest(range(1, len(v) + 1)) as i from w)),
c0 as materialized (select p, r - 1 as e, j, v from x where r <= {entries}),
{rounds}z as materialized ({near(last)}),
t as (select r, string_agg(format('{{:02x}}', e), '' order by p) as code, sum(d)::bigint as error from z group by r)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, (select sha256(string_agg(v::varchar, ',' order by p, e, j)) from {last}) as codebooks_sha256 from t join w using (r)"""


#: What the other operators compute is hashed, learned or searched in ways that SQL cannot express; tests compare them
#: with brute force.
ORACLE_SQL: dict[str, str] = {"op5_chat": _chat_sql(), "op7_repetition": _repetition_sql(), "op11_collocations": _collocation_sql(), "op12_warc": _warc_sql(), "op13_codes": _codebook_sql()}
