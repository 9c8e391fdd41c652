"""DuckDB SQL for the operators that it can express over whole tables."""

from __future__ import annotations

from lodestack.llm.licences import TEMPLATES, THRESHOLD, bigrams_of, words_of

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes as hexadecimal digits; windows of 50 bytes are 100 digits.
REPEATS = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select doc_id, k, substr(h, 2 * k - 1, 100) s from (select doc_id, h, unnest(range(1, length(h) // 2 - 48)) k from d where length(h) >= 100)),
m as (select s, min(doc_id) least from w group by s having count(distinct doc_id) > 1),
c as (select doc_id, k, case when k > lag(k) over (partition by doc_id order by k) + 50 then 1 else 0 end new from w join m using (s) where doc_id > least),
i as (select doc_id, k, sum(new) over (partition by doc_id order by k rows unbounded preceding) island from c),
r as (select doc_id, min(k) a, max(k) + 49 b from i group by doc_id, island),
p as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) done from r),
k as (select doc_id, sum(b - a + 1)::bigint n_removed, count(*) n_spans, max(b) tail, string_agg(substr(h, 2 * done + 1, 2 * (a - done - 1)), '' order by a) head from p join d using (doc_id) group by doc_id)
select d.doc_id, (length(h) // 2)::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans,
  sha256(unhex(case when k.doc_id is null then h else head || substr(h, 2 * tail + 1) end)) kept_sha256
from d left join k on d.doc_id = k.doc_id
"""


def licences(threshold: float = THRESHOLD) -> str:
    """Every passage against every template; no trigger words, only the size bounds."""
    rows = []
    for name, templates in TEMPLATES.items():
        for t in templates:
            grams = ", ".join(f"'{g}'" for g in sorted(bigrams_of(t)))
            rows.append(f"('{name}', {max(1, len(words_of(t)) - 1)}, [{grams}])")
    return f"""
with t(licence, width, grams) as (values {", ".join(rows)}),
p as (
  select doc_id, 0 unit, unnest(string_split(text, chr(10))) passage from documents
  union all select doc_id, 1, passage from (select doc_id, unnest(string_split_regex(text, '\\n[ \\t\\r]*\\n')) passage from documents) where contains(passage, chr(10))
  union all select doc_id, 2, text from documents where regexp_matches(text, '\\n[ \\t\\r]*\\n')
),
w as (select doc_id, unit, list_filter(string_split_regex(translate(passage, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+'), lambda x: x <> '') ws from p),
g as (select doc_id, unit, case when len(ws) = 1 then ws else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end gs from w where len(ws) > 0),
dw as (select doc_id, list_filter(string_split_regex(translate(text, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+'), lambda x: x <> '') ws from documents),
dg as (select doc_id, case when len(ws) = 1 then ws else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end gs from dw where len(ws) > 0),
places as (select row_number() over () r, doc_id, unnest(gs) gram, unnest(range(1, len(gs) + 1)) k, gs all_gs from dg),
tg as (select licence, width, grams, unnest(grams) gram from t),
win as (select doc_id, licence, grams, list_distinct(list_slice(all_gs, k, k + width - 1)) gs from places join tg using (gram) where k + width - 1 <= len(all_gs)),
h as (
  select doc_id, unit, licence, 2.0 * len(list_intersect(gs, grams)) / (len(gs) + len(grams)) dice from g, t
  where len(gs) * {2 - threshold} >= len(grams) * {threshold} - 0.000000001 and len(grams) * {2 - threshold} >= len(gs) * {threshold} - 0.000000001
  union all select doc_id, 3, licence, 2.0 * len(list_intersect(gs, grams)) / (len(gs) + len(grams)) from win
)
select doc_id, licence, round(max(dice), 6) dice, ['line', 'paragraph', 'text', 'window'][1 + arg_max(unit, (dice, -unit))] unit, (count(*) filter (where unit < 3))::bigint n_places
from h where dice >= {threshold} - 0.000000001 group by doc_id, licence
"""
