"""Queries of problem 1: a few keys holding most rows."""

from ..operators import hotkeys as H
from ..session import table

_KEYED = """
with rows as (
  select 'interlocutor' as field_name, coalesce(nullif(interlocutor, ''), 'unknown') as key_value, text, speech_acts from annotated_lines
  union all
  select 'situation_type', coalesce(nullif(situation_type, ''), 'unknown'), text, speech_acts from annotated_lines)
"""

QUERIES = {
    "p1_found": lambda s, d: H.hot_keys(table(s, d, "annotated_lines")),
    "p1_key_profile": lambda s, d: H.key_profile(table(s, d, "annotated_lines")),
    "p1_key_sentences": lambda s, d: H.key_sentences(table(s, d, "annotated_lines")),
    "p1_key_acts": lambda s, d: H.key_acts(table(s, d, "annotated_lines")),
}

ORACLE = {
    "p1_found": _KEYED + "select field_name, key_value from rows group by 1, 2 having count(*) > 0.05 * (select count(*) from annotated_lines)",
    "p1_key_profile": _KEYED
    + """, ranked as (select *, length(text) as n, count(text) over (partition by field_name, key_value) as c,
        row_number() over (partition by field_name, key_value order by length(text) nulls last) as r from rows)
select field_name, key_value, count(*) as n_rows, count(*)::double / (select count(*) from annotated_lines) as share,
  min(n) as len_min, max(case when r = greatest(1, ceil(0.5 * c)) then n end) as len_q0,
  max(case when r = greatest(1, ceil(0.9 * c)) then n end) as len_q1, max(n) as len_max
from ranked group by 1, 2""",
    "p1_key_sentences": _KEYED
    + r""", s as (select field_name, key_value, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[。！？；…—.!?;\n]+'), lambda x: trim(x, E' \t\r\n　')), lambda x: x <> '') as l from rows)
select field_name, key_value, sum(len(l))::bigint as sentences, sum(len(list_filter(l, lambda x: length(x) <= 5)))::bigint as short,
  sum(len(list_filter(l, lambda x: length(x) > 5 and length(x) <= 15)))::bigint as medium, sum(len(list_filter(l, lambda x: length(x) > 15)))::bigint as long,
  coalesce(sum(list_sum(list_transform(l, lambda x: length(x)))), 0)::bigint as chars
from s group by 1, 2""",
    "p1_key_acts": _KEYED
    + """, a as (select field_name, key_value, unnest(speech_acts) as x from rows), c as (
  select field_name, key_value, x.type as act, count(*) as n from a where coalesce(x.type, '') <> '' group by 1, 2, 3)
select field_name, key_value, act, n, round_even(n::double / sum(n) over (partition by field_name, key_value), 6) as share from c""",
}
