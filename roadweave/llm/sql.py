"""DuckDB SQL of those queries that SQL can express."""

from __future__ import annotations

from .licenses import PHRASES, TEMPLATES, parse, pattern

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"

OP1 = f"""
with recursive d as (select doc_id, {_WORDS} as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                          when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
r as (select doc_id as a, doc_id as b from d union select r.a, e.b from r join e on e.a = r.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(b) from r where r.a = d.doc_id) as component_id
from d left join n using (doc_id)
"""

OP6 = f"""
with d as (select doc_id, {_WORDS} as w from documents), i as (select item_id, {_WORDS} as w from benchmark),
ds as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
si as (select distinct item_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from i),
n as (select item_id, count(*) as n from si group by all),
c as (select doc_id, item_id, count(*) as c from ds join si using (g) group by all)
select doc_id, item_id, n as n_item, c as n_common, c / n as containment from c join n using (item_id) where 100 * c >= 80 * n
"""

OP7 = f"""
with d as (select doc_id, {_WORDS} as w from documents where doc_id is not null),
x as (select doc_id, i - 1 as word, md5(array_to_string(w[i:i + 49], ' ')) as g from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d)),
f as (select g, min(doc_id) as lo from x group by g),
h as (select doc_id, word, lo from x join f using (g) where lo < doc_id),
m as (select *, case when word <= lag(word) over (partition by doc_id order by word) + 50 then 0 else 1 end as new from h),
k as (select *, sum(new) over (partition by doc_id order by word) as span from m)
select doc_id, min(word) as first_word, max(word) + 50 - min(word) as n_words, unnest(list_distinct(list(lo))) as first_doc_id from k group by doc_id, span
"""

_PROBE = "'<|im_end|><|im_start|>assistant ok'"
OP8 = rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -1, 0, 'user', {_PROBE} union all select -1, 1, 'assistant', {_PROBE})
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls last, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::bigint as formatted_chars
from c group by conv_id
"""


def _op9() -> str:
    words = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    places = []
    for phrase, label in PHRASES.items():
        test = " and ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split()))
        places.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {test}), lambda i: {{'at': i - 1, 'label': '{label}'}})")
    accepted = ", ".join(f"case when regexp_matches(t, '(?:^| ){pattern(parse(template))}') then '{label}' end" for label, template in TEMPLATES.items())
    labels = "array_to_string(list_sort(list_distinct({})), ',')"
    base = "list_transform(p, lambda x: x.label)"
    return f"""
with d as (select doc_id, {words} as w from documents),
e as (select doc_id, w, array_to_string(w, ' ') || ' ' as t, list_concat(list_concat({places[0]}, {places[1]}), {places[2]}) as p from d),
a as (select *, list_filter([{accepted}], lambda x: x is not null) as found from e)
select doc_id, len(w)::bigint as n_words, len(p)::bigint as n_base, list_min(list_transform(p, lambda x: x.at)) as first_word, list_max(list_transform(p, lambda x: x.at)) as last_word,
       {labels.format(base)} as base_labels, {labels.format(f"list_concat({base}, found)")} as labels,
       case when len(found) > 0 then 1.0 when len(p) > 0 then 0.5 else 0.0 end::double as score
from a
"""


ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": OP1,
    "op6_benchmark_leaks": OP6,
    "op7_repeated_spans": OP7,
    "op8_chat": OP8,
    "op9_licenses": _op9(),
}
