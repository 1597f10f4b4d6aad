"""SQL twins of the operator queries, for DuckDB."""

from __future__ import annotations

from lakeaudit.llm.chat import CONTROL, END, START

_T = "coalesce(text, '')"
_ESCAPED = "replace(t, '\\', '\\\\')"
for _a, _b in CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_a}{_b}', '{_a}\\{_b}')"

_CHAT = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as r, {_T} as t from (
    select conv_id, turn, role, text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
    union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized as (
  select *, row_number() over w as pos, count(*) over (partition by conv_id) as n,
    {len(START) + 1 + len(END)} + length(r) + length({_ESCAPED}) as size
  from turns window w as (partition by conv_id order by turn, r, t)),
ended as (
  select *, sum(size) over (partition by conv_id order by pos) as upto from sized)
select conv_id, count(*) as n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' order by pos)) as turns_sha256,
  coalesce(sum(length(t)) filter (r = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(t, '' order by pos) filter (r = 'assistant'), '')) as loss_sha256,
  (sum(upto) filter (r = 'assistant' or pos = n))::bigint as formatted_chars
from ended group by conv_id
"""

_TOPK = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v))
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from scored qualify rank <= 5
"""

_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


def _shingles(table: str, key: str) -> str:
    """Distinct five-word shingles of a table's texts; of fewer words, the one of all."""
    return f"""select distinct {key}, sh from (
    select {key}, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as sh
    from (select {key}, {_WORDS} as w from {table}))"""


_LEAKS = f"""
with d as ({_shingles("documents", "doc_id")}),
i as ({_shingles("benchmark", "item_id")}),
sets as (select item_id, count(*) as n, md5(string_agg(sh, '|' order by sh)) as name from i group by item_id),
named as (select min(item_id) as item_id, count(*) as n_items, min(n) as n_shingles from sets group by name),
shared as (
  select doc_id, item_id, count(*) as n_shared from d join i using (sh) join named using (item_id) group by doc_id, item_id)
select doc_id, item_id, n_items, n_shared, n_shingles, n_shared / n_shingles as containment
from shared join named using (item_id) where n_shared >= 0.8 * n_shingles - 1e-9
"""

_NEAR = f"""
with recursive s as materialized ({_shingles("documents", "doc_id")}),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as materialized (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y using (sh)
    where x.doc_id <> y.doc_id group by 1, 2)
  join n p on p.doc_id = a join n q on q.doc_id = b where c >= 0.8 * (p.n + q.n - c) - 1e-9),
reach as (select doc_id as a, doc_id as b from documents union select r.a, p.b from reach r join pairs p on r.b = p.a),
links as (select a, count(*) as n_links from pairs group by a)
select doc_id, (select min(b) from reach where a = doc_id) as class_id, coalesce(n_links, 0) as n_links
from documents left join links on a = doc_id
"""

_LISTED = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

_PASSAGES = f"""
with d as materialized (select doc_id, coalesce(length(text), 0) as n, {_LISTED} as w from documents),
later as (
  select doc_id, i from (select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) as k
    from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d))
  qualify row_number() over (partition by k order by doc_id, i) > 1),
gone as (select distinct doc_id, i + j as p from later cross join range(20) t(j)),
cut as (select doc_id, list(p) as ps, count(*) as n_removed, count(*) filter (lag is null or lag < p - 1) as n_spans
  from (select doc_id, p, lag(p) over (partition by doc_id order by p) as lag from gone) group by doc_id),
words as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as p from d where doc_id in (select doc_id from cut)),
kept as (select doc_id, string_agg(x, ' ' order by p) as t from words anti join gone using (doc_id, p) group by doc_id),
lost as (select doc_id, sum(length(x)) as n_lost from words semi join gone using (doc_id, p) group by doc_id)
select doc_id, (n - coalesce(n_lost, 0))::bigint as n_chars, len(w) as n_words, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(case when n_removed is null then array_to_string(w, ' ') else coalesce(t, '') end) as kept_sha256
from d left join cut using (doc_id) left join kept using (doc_id) left join lost using (doc_id)
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PHRASES = f"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from pieces),
f as materialized (
  select lang, size, phrase, count(*) as f from (
    select lang, size, array_to_string(w[i:i + size - 1], ' ') as phrase from (
      select lang, w, size, unnest(range(1, len(w) - size + 2)) as i from w cross join (values (1), (2), (3)) s(size)))
  group by all),
n as (select lang, sum(f)::bigint as n from f where size = 1 group by lang),
c as (select lang, size, phrase, f as a, string_split(phrase, ' ') as w from f where size > 1 and f >= 10),
cuts as (select *, array_to_string(w[:k], ' ') as p, array_to_string(w[k + 1:], ' ') as q from c cross join (values (1), (2)) t(k) where k < size),
scored as (
  select cuts.lang, cuts.phrase, cuts.size, a, x.f as l, y.f as r, ((1000000 * a::hugeint * a) // (x.f::hugeint * y.f))::bigint as score
  from cuts join f x on x.lang = cuts.lang and x.phrase = p and x.size = k join f y on y.lang = cuts.lang and y.phrase = q and y.size = cuts.size - k
  qualify row_number() over (partition by cuts.lang, cuts.phrase order by score, k) = 1),
longer as (select lang, array_to_string(w[i:i + 1], ' ') as phrase, max(a) as most from c cross join (values (1), (2)) t(i) where size = 3 group by all)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from scored join n using (lang) left join longer using (lang, phrase) where size = 3 or most is null or 100 * most < 50 * a
qualify rank <= 2000
"""

ORACLE = {
    "op1_chat_formatting": _CHAT,
    "op3_topk_search": _TOPK,
    "op5_decontamination": _LEAKS,
    "op8_ngram_jaccard": _NEAR,
    "op11_passage_dedup": _PASSAGES,
    "op13_collocations": _PHRASES,
}
