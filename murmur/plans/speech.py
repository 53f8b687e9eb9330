"""Queries of speech acts and their SQL."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import hub
from ..operators import speech as S
from ..session import table

_lines = lambda s, d: table(s, d, "annotated_lines")


def _re2(p: str) -> str:
    """The pattern in the dialect of the SQL engine: no look-ahead, the end of text spelled out."""
    if p == r"没关系(?!.{0,5}[。…])":
        return r"没关系(?:[^。…\n]{6}|[^。…\n]{0,5}(?:\n|\z))"
    return p.replace("$", r"(?:\n?\z)")


_RULES = " union all ".join(f"select distinct line_uid, {i} as ord, '{k}' as type, {c} as confidence from annotated_lines where regexp_matches(text, '{_re2(p)}')" for i, (k, c, p) in enumerate(R.ACT_RULES))
_LABEL = "case x.act " + " ".join(f"when '{k}' then '{v}'" for k, v in R.ACT_LABELS.items()) + " else x.act end"
_PROFILE = """a as (select coalesce(nullif(situation_type, ''), 'unknown') as situation_type, coalesce(nullif(interlocutor, ''), 'unknown') as interlocutor, coalesce(nullif(phase, ''), 'unknown') as phase, coalesce(x.type, 'unknown') as act
  from (select *, unnest(speech_acts) as x from annotated_lines where source is distinct from 'archive')),
long as (select 'global' as slice_dim, '' as slice_value, act from a union all select 'situation_type', situation_type, act from a union all select 'interlocutor', interlocutor, act from a union all select 'phase', phase, act from a),
c as (select slice_dim, slice_value, act, count(*) as n from long group by 1, 2, 3),
prof as (select *, round_even(n / sum(n) over (partition by slice_dim, slice_value), 3) as pct, n / sum(n) over (partition by slice_dim, slice_value) as raw, row_number() over (partition by slice_dim, slice_value order by n desc, act) as r from c)"""
_pct = lambda x: f"round_even(({x}) * 100, 0)::int || '%'"
#: The rules in the SQL engine's words: speech acts from the texts themselves.
_CLASSIFIED = f"""k as (select line_uid, type, label, max(confidence)::double as confidence from (select *, case type {" ".join(f"when '{k}' then '{v}'" for k, v in R.ACT_LABELS.items())} end as label from ({_RULES})) group by all)"""


def _patterns(profile: str) -> str:
    return f"""with {profile}, g as (select coalesce(max(pct) filter (where act = 'evade'), 0) as ev, coalesce(max(pct) filter (where act = 'restrain'), 0) as re, coalesce(max(pct) filter (where act = 'console'), 0) as co from prof where slice_dim = 'global'),
p as (select 'high_evade' as pattern, '在被追问时倾向回避直接回答（回避行为占比' || {_pct("ev")} || '），常用省略号结尾或反问代替回答' as rule, 0 as layer, least(ev * 3, 1.0) as confidence from g where ev > 0.12
union all select 'selective_invite', '只在安慰他人时发出邀请，在面对对抗时从不邀请——即使在冲突中也保持邀请姿态是罕见的', 0, 0.7 where exists (select 1 from prof where slice_dim = 'situation_type' and slice_value = 'comfort' and act = 'invite') and not exists (select 1 from prof where slice_dim = 'situation_type' and slice_value = 'confront' and act = 'invite')
union all select 'restrained_consolation', '安慰他人时倾向用克制的表达（先说''我明白''，再轻描淡写地宽慰），而不是热情的鼓励', 2, least((re + co) * 2, 1.0) from g where re > 0.08 and co > 0.08
union all select 'interlocutor_' || x.act, '对' || x.slice_value || '的对话中，' || {_LABEL} || '行为占比最高（' || {_pct("x.raw")} || '）——用' || {_LABEL} || '的方式回应' || x.slice_value, 4, least(x.raw, 0.9) from prof x where x.slice_dim = 'interlocutor' and x.slice_value <> 'unknown' and x.r = 1 and x.raw > 0.3 and x.n >= 2
union all select 'phase_shift_' || x.slice_value || '_' || x.act, x.slice_value || '时期，' || {_LABEL} || '行为' || case when x.raw > coalesce(w.pct, 0) then '显著增多' else '显著减少' end || '（偏移' || {_pct("abs(x.raw - coalesce(w.pct, 0))")} || '）', 2, least(abs(x.raw - coalesce(w.pct, 0)) * 2, 0.9) from prof x left join prof w on w.slice_dim = 'global' and w.act = x.act
  where x.slice_dim = 'phase' and x.slice_value <> 'unknown' and x.n >= 2 and abs(x.raw - coalesce(w.pct, 0)) > 0.15 and (select count(distinct slice_value) from prof where slice_dim = 'phase') >= 2)
select pattern, rule, layer, round_even(confidence::double, 6) as confidence from p"""


_once = lambda s, d: hub.once(_lines(s, d), "line_uid", "ingested_at")

QUERIES = {
    "speech_act_classify": lambda s, d: S.classify(hub.once(_lines(s, d).select("line_uid", "text"), "line_uid")).select("line_uid", F.explode("speech_acts").alias("a")).select("line_uid", "a.type", "a.confidence"),
    "speech_act_profile": lambda s, d: S.profile(_lines(s, d)),
    "speech_act_coverage": lambda s, d: S.coverage(_lines(s, d)),
    "speech_act_top": lambda s, d: S.profile(_lines(s, d)).filter("slice_dim = 'global'").orderBy(F.desc("n"), "act").limit(5).select("act", "n", "pct"),
    "behavior_patterns": lambda s, d: S.behaviour_patterns(S.profile(_lines(s, d))),
    "speech_act_analysis": lambda s, d: S.analyse(_once(s, d)),
}
ORACLE = {
    "speech_act_classify": f"with m as ({_RULES}) select line_uid, type, max(confidence)::double as confidence from m group by line_uid, type",
    "speech_act_profile": f"with {_PROFILE} select slice_dim, slice_value, act, n, pct from prof",
    "speech_act_coverage": "select sum(len(coalesce(speech_acts, [])))::bigint as total_acts, count(*) filter (where len(speech_acts) > 0) as lines_with_acts from annotated_lines where source is distinct from 'archive'",
    "speech_act_top": f"with {_PROFILE} select act, n, pct from prof where slice_dim = 'global' order by n desc, act limit 5",
    "behavior_patterns": _patterns(_PROFILE),
    "speech_act_analysis": _patterns(f"{_CLASSIFIED}, o as (select distinct on (line_uid) line_uid, source, situation_type, interlocutor, phase from annotated_lines), " + _PROFILE.replace("from (select *, unnest(speech_acts) as x from annotated_lines where source is distinct from 'archive'))", "from (select *, {'type': type} as x from o join k using (line_uid) where source is distinct from 'archive'))")),
}
