"""Queries of rule checks and their SQL."""

from pyspark.sql import functions as F

from ..operators import persona as P
from ..session import materialize, table

#: A description in the form the parser reads, for the test texts.
PERSONA = """# 航海者

## Layer 0：核心
- 从不用命令口吻说话
- 不用感叹号
- 不说「归我了」
- 不会哭

## Layer 2：表达风格
口头禅：「……在呢」、「依我看」
高频词：海图、缆绳、雾
自称：极少自称

## Layer 5：禁忌
- 不谈「内鬼」
- 不谈牺牲

## Correction 记录
暂无
"""
_P = P.parse(PERSONA)
_lines = lambda s, d: table(s, d, "annotated_lines")
_BLANK = r"trim(coalesce(text, ''), E' \t\r\n　')"
_SLICED = f"l as (select * from annotated_lines where coalesce(source, '') <> 'archive' and {_BLANK} <> ''), s as (select 'global' as dim, '' as value, text from l " + " ".join(f"union all select '{c}', coalesce(nullif({c}, ''), 'unknown'), text from l" for c in ("phase", "interlocutor", "situation_type", "source")) + "), sl as (select * from s where value <> 'unknown')"
_TESTS = {i: "|".join(f"(?:{p})" for p, _ in P.forbidden(r)) for i, r in enumerate(_P["layer0"]) if P.forbidden(r)}
_SPOKEN = r"case when regexp_matches(text, '[「“‘].*[」”’]') then true when regexp_matches(text, '[！!？?……—]') and length(text) < 60 then true when regexp_matches(text, '^(我|吾|我们|咱们)') and length(text) < 50 then true when regexp_matches(text, '^泰拉历|^\d{4}|^[A-Z][a-z]+（|成立于|属于|是.*组织|是.*角色') then false when length(text) > 200 then false else length(text) < 80 end"
_VIOL = f"with {_SLICED}, viol as (" + " union all ".join(f"select dim, value, count(*) as lines, {i} as rule, count(*) filter (where regexp_matches(text, '{p}')) as violations from sl group by 1, 2" for i, p in _TESTS.items()) + ")"
_WORDS = [w for t in _P["layer5"] for w in P.taboo_words(t)]
_CNT = lambda w: f"sum((length(text) - length(replace(text, '{w}', ''))) // {len(w)})"
_SCORE = f"""a as (select dim, value, count(*) as lines, {" + ".join(f"(count(*) filter (where regexp_matches(text, '{p}')) > 0)::int" for p in _TESTS.values())} as broken,
  {" + ".join([f"(count(*) filter (where contains(text, '{w}')) > 0)::int" for w in ("……在呢", "依我看")] + [f"({_CNT(w)} >= 3)::int" for w in _P["style"]["frequent_words"]] + [f"(round_even({_CNT('我')} / count(*), 2) < 1.0)::int"])} as holds,
  {" + ".join(f"count(*) filter (where {_SPOKEN} and contains(text, '{w}'))" for w in _WORDS)} as hits from sl group by 1, 2 having count(*) >= 2),
b as (select dim, value, lines, round_even(({len(_TESTS)} - broken) / {len(_TESTS)} * 100, 1) as layer0, round_even(holds / 6 * 100, 1) as layer2, greatest(0, 100 - 10 * hits)::double as layer5 from a),
sc as (select *, round_even(layer0 * 0.5 + layer2 * 0.3 + layer5 * 0.2, 1) as overall, case when layer0 * 0.5 + layer2 * 0.3 + layer5 * 0.2 >= 90 then 'A' when layer0 * 0.5 + layer2 * 0.3 + layer5 * 0.2 >= 75 then 'B' when layer0 * 0.5 + layer2 * 0.3 + layer5 * 0.2 >= 60 then 'C' else 'D' end as grade,
  case when lines >= 20 then 'high' when lines >= 10 then 'medium' when lines >= 3 then 'low' else 'very_low' end as confidence from b)"""

def _advice(s, d):  # noqa: ANN001, ANN202
    scores = materialize(P.validate(_lines(s, d), _P), "persona")
    return P.recommendations(scores, P.inconsistencies(P.rule_violations(_lines(s, d), _P["layer0"]), scores))


QUERIES = {
    "dialogue_filter": lambda s, d: table(s, d, "documents").select("doc_id", P.is_dialogue(F.col("text")).alias("spoken")),
    "rule_violations": lambda s, d: P.rule_violations(_lines(s, d), _P["layer0"]),
    "slice_validation": lambda s, d: P.validate(_lines(s, d), _P),
    "slice_inconsistency": lambda s, d: P.inconsistencies(P.rule_violations(_lines(s, d), _P["layer0"]), P.validate(_lines(s, d), _P)),
    "slice_recommendations": lambda s, d: _advice(s, d),
    "slice_coverage": lambda s, d: P.coverage(P.validate(_lines(s, d), _P)),
    "slice_quality": lambda s, d: P.quality(P.validate(_lines(s, d), _P)),
}
_INCONSISTENT = """q as (select 'phase_specific_violation' as type, rule::varchar as detail from viol where dim = 'phase' and lines >= 2 group by rule having count(*) filter (where violations > 0) between 1 and count(*) - 1
union all select case dim when 'interlocutor' then 'interlocutor_score_gap' else 'situation_score_gap' end, printf('%.1f', max(overall) - min(overall)) from sc where dim in ('interlocutor', 'situation_type') group by dim having count(*) >= 2 and max(overall) - min(overall) > case dim when 'interlocutor' then 20 else 25 end
union all select 'situation_specific_violation', rule::varchar from viol where dim = 'situation_type' and value = 'confront' and lines >= 2 and violations > 0 and exists (select 1 from viol where dim = 'situation_type' and value = 'casual' and lines >= 2) and rule not in (select rule from viol where dim = 'situation_type' and value = 'casual' and violations > 0))"""
ORACLE = {
    "dialogue_filter": f"select doc_id, {_SPOKEN} as spoken from documents",
    "rule_violations": f"{_VIOL} select * from viol",
    "slice_validation": f"with {_SLICED}, {_SCORE} select * from sc",
    "slice_inconsistency": f"{_VIOL}, {_SCORE}, {_INCONSISTENT} select * from q",
    "slice_recommendations": f"""{_VIOL}, {_SCORE}, {_INCONSISTENT} select case when overall < 60 then 'high' else 'medium' end as priority, 'global' as target, 'score' as kind, printf('%.1f', overall) as detail from sc where dim = 'global' and overall < 75
union all select case type when 'situation_specific_violation' then 'low' else 'medium' end, case type when 'phase_specific_violation' then 'Layer 0' when 'interlocutor_score_gap' then 'Layer 2-3' when 'situation_score_gap' then 'Layer 0-2' else 'Layer 0' end, type, detail from q
union all select 'low', 'data_quality', 'source_gap', arg_min(value, (overall, value)) from sc where dim = 'source' having count(*) >= 2 and max(overall) - min(overall) > 15
union all select 'info', 'data_coverage', 'small_slice', dim || ':' || value || '(n=' || lines || ')' from sc where dim in ('phase', 'interlocutor') and confidence in ('low', 'very_low')""",
    "slice_coverage": f"with {_SLICED}, {_SCORE} select count(*) as total_slices, count(*) filter (where confidence = 'high') as high_confidence_slices, count(distinct dim) as covered_dimensions, 4 as total_dimensions, round_even(count(distinct dim) / 4 * 100, 0)::bigint as coverage_pct from sc where dim <> 'global'",
    "slice_quality": f"with {_SLICED}, {_SCORE} select dim, count(*) as slices, sum(lines)::bigint as lines, count(*) filter (where confidence = 'high') as high_confidence, round_even(avg(overall), 2) as mean_overall from sc where dim <> 'global' group by 1",
}
