"""Queries of period metrics and their SQL."""

from ..functions import rules as R
from ..operators import temporal as T
from ..session import table
from .fingerprint import FEATURES

_lines = lambda s, d: table(s, d, "annotated_lines")


def _metrics(keys: str) -> str:
    return f"select {keys}, count(*) as lines, coalesce(round_even(sum(sentence_chars) / nullif(sum(n_sentences), 0), 1), 0) as avg_length, round_even(avg(coalesce(ellipsis::int, 0)) * 100, 1) as ellipsis_pct, round_even(avg(coalesce(exclamation::int, 0)) * 100, 1) as exclamation_pct, round_even(avg(coalesce(negation_short::int, 0)) * 100, 1) as negation_pct, round_even(coalesce(sum(self_refs), 0) / count(*), 2) as self_ref_freq from feats group by all"


_BASE = f"with base as (select * replace (coalesce(nullif(interlocutor, ''), 'unknown') as interlocutor) from annotated_lines where coalesce(source, '') <> 'archive' and coalesce(nullif(phase, ''), 'unknown') <> 'unknown'), {FEATURES}"


def _acts(keys: str, where: str = "true") -> str:
    return f"select {keys}, act, n, n / sum(n) over (partition by {keys}) as share from (select {keys}, coalesce(x.type, 'unknown') as act, count(*) as n from (select {keys}, unnest(speech_acts) as x from base where {where}) group by all)"


_ACT = "case k.act " + " ".join(f"when '{k}' then '{v}'" for k, v in R.ACT_LABELS.items()) + " else k.act end"


def _diff(join: str, scope: str) -> str:
    """Rows of large differences for pairs(scope, a, b) with metrics m and shares s."""
    on = lambda t, k: f"{t}.item = pairs.{k}" + (f" and {t}.phase = pairs.phase" if scope else "")
    sc = "pairs.phase, " if scope else ""
    both = f"from pairs join m x on {on('x', 'a')} join m y on {on('y', 'b')}"
    rate = lambda metric, c, least, what, more, less, one, two: f"select {sc}pairs.a, pairs.b, '{metric}' as metric, x.{c}::double as baseline, y.{c}::double as comparison, round_even((y.{c} - x.{c}) / x.{c} * 100, 1) as shift_pct, '{what}' || case when y.{c} > x.{c} then '{more}' else '{less}' end || '（' || x.{c}::double || '{one}→' || y.{c}::double || '{two}）' as reading {both} where x.{c} > 0 and abs((y.{c} - x.{c}) / x.{c}) > {least}"
    acts = f"select {sc}pairs.a, pairs.b, 'speech_act:' || k.act, round_even(coalesce(x.share, 0) * 100, 1), round_even(coalesce(y.share, 0) * 100, 1), round_even((coalesce(y.share, 0) - coalesce(x.share, 0)) * 100, 1), {_ACT} || case when coalesce(y.share, 0) > coalesce(x.share, 0) then '行为显著增多' else '行为显著减少' end || '（' || round_even(coalesce(x.share, 0) * 100, 1) || '%→' || round_even(coalesce(y.share, 0) * 100, 1) || '%）' from pairs cross join (select distinct act from s) k left join s x on {on('x', 'a')} and x.act = k.act left join s y on {on('y', 'b')} and y.act = k.act where abs(coalesce(y.share, 0) - coalesce(x.share, 0)) > 0.1"
    return " union all ".join([rate("avg_sentence_length", "avg_length", 0.25, "句式", "偏长", "偏短", "", "字"), rate("ellipsis_pct", "ellipsis_pct", 0.3, "沉默/停顿", "增多", "减少", "%", "%"), rate("negation_pct", "negation_pct", 0.3, "否定表达", "增多", "减少", "%", "%"), acts])


_TWO = f"""{_BASE}, m0 as ({_metrics("phase")}), m as (select *, phase as item from m0), s as (select *, phase as item from ({_acts("phase")})),
ordered as (select phase, row_number() over (order by t.ord nulls last, phase) as o from (select distinct phase from m0) left join timeline t on t.id = phase),
pairs as (select p.phase as a, q.phase as b from ordered p join ordered q on q.o = p.o + 1), d as ({_diff("", "")})"""
_FOUR = f"""{_BASE}, m0 as (select * from ({_metrics("phase, interlocutor")}) where interlocutor <> 'unknown' and lines >= 2), m as (select *, interlocutor as item from m0), s as (select *, interlocutor as item from ({_acts("phase, interlocutor")})),
pairs as (select x.phase, x.interlocutor as a, y.interlocutor as b from m0 x join m0 y on x.phase = y.phase and x.interlocutor < y.interlocutor), d as ({_diff("", "phase")})"""
_CONF = lambda by, top: f"least(round_even(abs(shift_pct) / {by}, 6), {top})::double as confidence"

QUERIES = {
    "slice_metrics_by_phase": lambda s, d: T.slice_metrics(T.periods(_lines(s, d)), ["phase"]),
    "slice_metrics_by_phase_interlocutor": lambda s, d: T.slice_metrics(T.periods(_lines(s, d)), ["phase", "interlocutor"]),
    "act_shares_by_phase": lambda s, d: T.act_shares(T.periods(_lines(s, d)), ["phase"]),
    "interlocutor_counts_by_phase": lambda s, d: T.interlocutor_counts(_lines(s, d)),
    "adjacent_shift": lambda s, d: T.period_shifts(_lines(s, d), table(s, d, "timeline")),
    "pairwise_interlocutor_diff": lambda s, d: T.interlocutor_differences(_lines(s, d)),
    "temporal_rules_topk": lambda s, d: T.temporal_rules(_lines(s, d), table(s, d, "timeline")),
}
ORACLE = {
    "slice_metrics_by_phase": f"{_BASE} {_metrics('phase')}",
    "slice_metrics_by_phase_interlocutor": f"{_BASE} {_metrics('phase, interlocutor')}",
    "act_shares_by_phase": f"{_BASE} {_acts('phase')}",
    "interlocutor_counts_by_phase": f"{_BASE} select phase, interlocutor, count(*) as n from base group by all",
    "adjacent_shift": f"{_TWO} select a as from_phase, b as to_phase, metric, baseline, comparison, shift_pct, reading, {_CONF(50, 0.95)} from d",
    "pairwise_interlocutor_diff": f"{_FOUR} select phase, a, b, metric, baseline, comparison, shift_pct, reading, {_CONF(40, 0.9)} from d",
    "temporal_rules_topk": f"with two as ({_TWO} select 2 as layer, a || '->' || b as scope, metric, b || '时期相比' || a || '时期：' || reading as rule, {_CONF(50, 0.95)} from d), four as ({_FOUR} select 4 as layer, phase || '/' || a || '/' || b as scope, metric, phase || '时期，对' || a || '与对' || b || '的表达差异：' || reading as rule, {_CONF(40, 0.9)} from d) select * from (select * from two union all select * from four) order by confidence desc, layer, scope, metric limit 20",
}
