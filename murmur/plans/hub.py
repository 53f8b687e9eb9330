"""Queries of the hub and their SQL."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import hub as H
from ..operators import phase as P
from ..session import table
from . import phase as PP

_STRIP = lambda c: f"trim({c}, E' \\t\\r\\n　')"
_WHOLE = "concat_ws(' ', scene, text, array_to_string(narration, ' '))"


def _case(table_: list, c: str, default: str | None) -> str:
    lit = lambda v: "null" if v is None else f"'{v}'"
    return "case " + " ".join(f"when contains({c}, '{k}') then {lit(v)}" for k, v in table_) + f" else {lit(default)} end"


_SITUATION = "case " + " ".join(f"when {' or '.join(f'contains({_WHOLE}, {chr(39)}{x}{chr(39)})' for x in w)} then '{k}'" for k, w in R.SITUATIONS.items()) + " else 'casual' end"
_STORY = "story as (select distinct on (row_id) * from story_lines)"
_story = lambda s, d: H.once(table(s, d, "story_lines"), "row_id")

QUERIES = {
    "reply_to": lambda s, d: H.reply_to(_story(s, d), "story_id", "answers", ["pos", "row_id"]).select("row_id", "answers"),
    "scene_asof": lambda s, d: H.scene_asof(_story(s, d), "story_id", ["pos", "row_id"]).select("row_id", "scene_now"),
    "situation_type": lambda s, d: _story(s, d).select("row_id", H.situation(F.col("scene"), F.col("text"), F.col("narration")).alias("situation")),
    "voice_annotation": lambda s, d: _voice(s, d),
    "hub_union_ids": lambda s, d: H.hub(table(s, d, "operator_data"), table(s, d, "story_lines")),
    "context_lines": lambda s, d: _context(s, d).select("part", "line_id", "source", "scene", "interlocutor", "situation_type", "phase", "inference_source", "inference_confidence", F.size("narration").cast("bigint").alias("narrations")),
    "context_report": lambda s, d: P.report(_context(s, d).filter("source = 'voice'")),
    "context_stats": lambda s, d: H.distributions(_context(s, d)),
    "hub_distributions": lambda s, d: H.distributions(table(s, d, "annotated_lines")),
    "hub_latest": lambda s, d: H.once(table(s, d, "annotated_lines"), "line_uid", "ingested_at").select("line_uid", "slug", "line_id", "pos", "source", "phase"),
    "story_phase_distribution": lambda s, d: _story(s, d).filter("is_target").groupBy(F.coalesce(F.nullif("phase", F.lit("")), F.lit("unknown")).alias("phase")).agg(F.count(F.lit(1)).alias("n")),
    "plain_label_split": lambda s, d: H.label_split(table(s, d, "documents"), "doc_id"),
    "csv_first_comma": lambda s, d: H.first_comma(table(s, d, "documents"), "doc_id"),
}


def _context(s, d):  # noqa: ANN001, ANN202
    return H.context(table(s, d, "operators"), table(s, d, "operator_data"), table(s, d, "story_lines"), rules=PP.WORLD)


def _voice(s, d):  # noqa: ANN001, ANN202
    who, what = H.voice_context(F.col("title"))
    return H.once(table(s, d, "operator_data"), "rec_id").filter("kind = 'voice'").select("rec_id", who.alias("interlocutor"), what.alias("situation_type"))


_LINES = r"(select doc_id, unnest(l) as l, generate_subscripts(l, 1) as n from (select doc_id, string_split(text, E'\n') as l from documents where text is not null))"
_W = "over (partition by story_id order by pos, row_id)"
_HUB = f"""d as (select distinct on (rec_id) * from operator_data), {_STORY},
n as (select *, row_number() over (partition by slug, kind order by idx nulls first, rec_id) - 1 as n from d where kind = 'archive' or coalesce(text, '') <> ''),
t as (select *, row_number() over (order by story_id, pos, row_id) - 1 as n from story where is_target),
p as (select slug as part, 'V' as c, n, text, 'voice' as source, title as source_detail, title as scene, {_case(R.VOICE_INTERLOCUTOR, "coalesce(title, '')", None)} as interlocutor, {_case(R.VOICE_SITUATION, "coalesce(title, '')", 'casual')} as situation_type, null as phase, []::varchar[] as narration from n where kind = 'voice'
union all select slug, 'A', n, text, 'archive', title, '档案', null, 'casual', 'unknown', [] from n where kind = 'archive' and coalesce(text, '') <> ''
union all select story_id, 'S', n, text, 'story', story_id, scene, nullif(reply_to, ''), {_SITUATION}, coalesce(nullif(phase, ''), 'unknown'), coalesce(narration, []) from t),
lines as (select *, c || lpad(n::varchar, greatest(3, length(n::varchar))::int, '0') as line_id from p)"""
_VOICE_LINES = "(select part as slug, text from lines where source = 'voice')"
_TOLD = f"""cl as ({PP.cluster_sql(_VOICE_LINES, "slug")}), df as ({PP.DEFAULTS.replace(PP.cluster_sql(PP._VOICES, "slug"), "select * from cl")}),
told as (select l.* exclude (phase), case when source <> 'voice' then l.phase else coalesce({PP._PAT}, {PP._KEY}, cl.phase, nullif(df.phase, 'unknown'), 'unknown') end as phase,
  case when source <> 'voice' then null when {PP._PAT} is not null then 'content_pattern' when {PP._KEY} is not null then 'content_keyword' when cl.phase is not null then 'cluster' when coalesce(df.phase, 'unknown') <> 'unknown' then 'default' else 'unknown' end as inference_source,
  case when source <> 'voice' then null when {PP._PAT} is not null then 'high' when {PP._KEY} is not null then 'medium' when cl.phase is not null then cl.confidence when coalesce(df.phase, 'unknown') <> 'unknown' then 'medium' else 'low' end as inference_confidence
  from lines l left join cl on source = 'voice' and cl.slug = part left join (select slug, phase from df) df on source = 'voice' and df.slug = part)"""
ORACLE = {
    "reply_to": f"with {_STORY} select row_id, case when is_target then coalesce(case when not lead(is_target) {_W} then lead(speaker) {_W} end, case when not lag(is_target) {_W} then lag(speaker) {_W} end) end as answers from story",
    "scene_asof": f"with {_STORY} select row_id, last_value(nullif(scene, '') ignore nulls) over (partition by story_id order by pos, row_id rows between unbounded preceding and current row) as scene_now from story",
    "situation_type": f"with {_STORY} select row_id, {_SITUATION} as situation from story",
    "voice_annotation": f"select distinct on (rec_id) rec_id, {_case(R.VOICE_INTERLOCUTOR, chr(99) + 'oalesce(title, ' + chr(39) * 2 + ')', None)} as interlocutor, {_case(R.VOICE_SITUATION, chr(99) + 'oalesce(title, ' + chr(39) * 2 + ')', 'casual')} as situation_type from operator_data where kind = 'voice'",
    "hub_union_ids": f"with {_HUB} select part, line_id, text, source, source_detail, scene, interlocutor, situation_type, phase, narration from lines",
    "context_lines": f"with {_HUB}, {_TOLD} select part, line_id, source, scene, interlocutor, situation_type, phase, inference_source, inference_confidence, len(narration) as narrations from told",
    "context_report": f"with {_HUB}, {_TOLD}, r as (select 'phase' as kind, phase as value, count(*) as n from told where source = 'voice' group by 2 union all select 'source', inference_source, count(*) from told where source = 'voice' group by 2 union all select 'confidence', inference_confidence, count(*) from told where source = 'voice' group by 2 union all select 'total', '', count(*) from told where source = 'voice') select kind, value, n, round_even(n / (select count(*) from told where source = 'voice') * 100, 1) as pct from r",
    "context_stats": f"with {_HUB}, {_TOLD} select 'source' as kind, source as value, count(*) as n from told group by 2 union all select 'phase', phase, count(*) from told where source <> 'archive' group by 2 union all select 'situation_type', situation_type, count(*) from told group by 2",
    "hub_distributions": "with k as (select coalesce(nullif(source, ''), 'unknown') as source, coalesce(nullif(phase, ''), 'unknown') as phase, coalesce(nullif(situation_type, ''), 'unknown') as situation_type from annotated_lines) select 'source' as kind, source as value, count(*) as n from k group by 2 union all select 'phase', phase, count(*) from k where source <> 'archive' group by 2 union all select 'situation_type', situation_type, count(*) from k group by 2",
    "hub_latest": "select distinct line_uid, slug, line_id, pos, source, phase from annotated_lines",
    "story_phase_distribution": f"with {_STORY} select coalesce(nullif(phase, ''), 'unknown') as phase, count(*) as n from story where is_target group by 1",
    "plain_label_split": f"""with r as (select doc_id, n, {_STRIP("l")} as l from {_LINES}), k as (select *, case when contains(l, ':') then ':' when contains(l, '：') then '：' when contains(l, '|') then '|' end as sep from r where l <> '' and not starts_with(l, '#'))
select doc_id, n::bigint as n, case when sep is null then 'line_' || n else {_STRIP("left(l, instr(l, sep) - 1)")} end as label, case when sep is null then l else {_STRIP("substr(l, instr(l, sep) + 1)")} end as text from k""",
    "csv_first_comma": f"""with r as (select doc_id, n, {_STRIP("l")} as l from {_LINES}) select doc_id, n::bigint as n, case when contains(l, ',') then {_STRIP("left(l, instr(l, ',') - 1)")} else 'line_' || n end as label, case when contains(l, ',') then {_STRIP("substr(l, instr(l, ',') + 1)")} else l end as text from r where l <> ''""",
}
