"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from keyloom.llm.jaccard import SHINGLE, SIMILAR
from keyloom.llm.licenses import PHRASES, TEMPLATES, need_of, words_of
from keyloom.llm.urls import RULES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _licenses() -> str:
    quoted = lambda words: f"[{', '.join(repr(w) for w in words)}]"
    phrases = ", ".join(f"({quoted(p.split(' '))}, '{label}')" for p, label in PHRASES)
    rows = []
    for label, text, names in TEMPLATES:
        words = words_of(text)
        rows.append(f"('{label}', {quoted(sorted(set(words)))}, {quoted(words_of(names))}, {len(words)}, {len(set(words))}, {need_of(len(set(words)))})")
    return f"""
with d as (select doc_id, {_WORDS} as w from documents),
p as (select * from (values {phrases}) v(phrase, label)),
hit as (
  select doc_id, label, i - 1 as k from (select doc_id, w, unnest(generate_series(1, len(w))) as i from d), p
  where w[i] = phrase[1] and w[i:i + len(phrase) - 1] = phrase
),
base as (select doc_id, count(*) as n, min(k) as a, max(k) as b, string_agg(distinct label, ',' order by label) as labels from hit group by 1),
t as (select * from (values {', '.join(rows)}) v(label, words, names, length, m, need)),
windows as (
  select doc_id, label, words, names, m, need, w[s + 1:s + length] as b
  from (select doc_id, w, label, words, names, length, m, need, unnest(generate_series(0, greatest(len(w) - length, 0))) as s from d, t where list_has_all(w, names))
),
found as (select doc_id, label, len(list_intersect(words, b)) as c, m from windows where list_has_all(b, names) and len(list_intersect(words, b)) >= need),
best as (select doc_id, max(c / m) as score from found group by 1),
every as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from found union select doc_id, label from hit) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(base.n, 0) as n_base, cast(a as bigint) as first_word, cast(b as bigint) as last_word,
  coalesce(base.labels, '') as base_labels, coalesce(every.labels, '') as labels, cast(coalesce(score, 0) as double) as score
from d left join base using (doc_id) left join every using (doc_id) left join best using (doc_id)"""


def _urls() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
s as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
),
r as (select * from (values {rules}) v(verdict, h, p)),
best as (
  select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as verdict from s, r
  where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by 1
)
select s.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from s left join best using (page_id)"""


_DECONTAMINATION = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
g as (select distinct item, n, w[i:i + n - 1] as gram from (select item, w, least(13, len(w)) as n, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) as i from b where len(w) > 0)),
p as (select doc_id, n, i, w[i:i + n - 1] as gram from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, (select distinct n from g))),
h as (select doc_id, i, p.n, item from p join g on p.n = g.n and p.gram = g.gram),
c as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as k from h) group by 1),
x as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join c using (doc_id) left join x using (doc_id)"""

_PREFERENCES = r"""
with t as (select conv_id // 2 as pair_id, conv_id % 2 = 0 as chosen, coalesce(turn, -1) as turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations),
s as (select pair_id, turn, role, text, sum(case when chosen then 1 else -1 end) as b from t group by all),
e as (select pair_id, min(turn) filter (where b <> 0) as ends from s group by 1),
j as (
  select t.*, ends is null or turn < ends as p, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as shown from t join e on t.pair_id = e.pair_id
),
m as (select *, cast(length(shown) as varchar) || ':' || case when role = 'assistant' then '1' else '0' end as mark from j)
select pair_id, coalesce(string_agg(shown, '' order by turn, role, text) filter (where p and chosen), '') as prompt,
  count(*) filter (where p and chosen) as n_prompt_turns,
  coalesce(string_agg(shown, '' order by turn, role, text) filter (where not p and chosen), '') as chosen,
  coalesce(string_agg(mark, ',' order by turn, role, text) filter (where not p and chosen), '') as chosen_mask,
  coalesce(string_agg(shown, '' order by turn, role, text) filter (where not p and not chosen), '') as rejected,
  coalesce(string_agg(mark, ',' order by turn, role, text) filter (where not p and not chosen), '') as rejected_mask
from m group by 1"""

_JACCARD = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, g from (
    select doc_id, w[i:i + {SHINGLE - 1}] as g from (select doc_id, w, unnest(generate_series(1, len(w) - {SHINGLE - 1})) as i from d where len(w) >= {SHINGLE})
    union all select doc_id, w from d where len(w) between 1 and {SHINGLE - 1})
),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where {SIMILAR[1]} * k >= {SIMILAR[0]} * (p.n + q.n - k)),
edges as (select x, y from links union all select y, x from links),
reach as (select x, y from edges union select r.x, e.y from reach r join edges e on r.y = e.x)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce((select min(y) from reach where x = d.doc_id), d.doc_id)) as component_id
from d left join n using (doc_id)"""

ORACLES: dict[str, str] = {
    "op2_license_scans": _licenses(),
    "op5_url_filters": _urls(),
    "op6_decontamination": _DECONTAMINATION,
    "op7_chat_format": _PREFERENCES,
    "op9_ngram_jaccard": _JACCARD,
}
