"""Queries of period inference and their SQL, with a rule pack of the test texts' world."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import phase as P
from ..session import table

#: What tells the period in the test texts; the operators take it like the rule pack of another world.
WORLD = R.PhaseRules(
    order=["early", "lantern", "interregnum", "return"],
    patterns=[("lantern", r"点燃.{0,6}塔灯"), ("interregnum", r"塔灯.{0,4}熄灭"), ("return", r"(?:旧船队|旧约).{0,10}(?:归来|再谈)")],
    words={"interregnum": ["万一失火", "暴露了内鬼"], "return": ["重新开放航道", "被写进章程"], "early": ["木码头"]},
    chapters=[("CH00-00000", "early"), ("CH00-00001", "lantern"), ("CH00-00002", "interregnum")],
    activities=[("CH00-000030", "return"), ("CH00-000031", "lantern")],
    categories=[("属于灰港的干员", "lantern"), ("属于卫队的干员", "interregnum")],
    factions=[("灰港联合航运会", "lantern"), ("锚链卫队", "interregnum"), ("绳梯学院", "return")],
    cluster_words={"early": ["铜哨", "缆绳", "木匠"], "lantern": ["潮钟塔", "灯塔", "领水员", "护送商队"], "interregnum": ["煤", "走私船", "守卫"], "return": ["海图", "测绘", "重燃"]},
    scene_words=[("lantern", ["潮钟塔", "灰港"]), ("interregnum", ["盐脊", "矿井"]), ("return", ["白帆", "浮码头"])],
    defaults={"领航员": "return", "Navigator": "early"},
)


def _lit(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _any(words: list[str], c: str) -> str:
    return "(" + " or ".join(f"contains({c}, {_lit(w)})" for w in words) + ")"


_PAT = "case " + " ".join(f"when regexp_matches(text, {_lit(p)}) then '{v}'" for v, p in WORLD.patterns) + " end"
_KEY = "case " + " ".join(f"when {_any(w, 'text')} then '{v}'" for v, w in WORLD.words.items()) + " end"
_COUNTS = ", ".join("coalesce(sum(" + " + ".join(f"contains(text, '{w}')::int" for w in WORLD.cluster_words[p]) + f"), 0)::bigint as c{i}" for i, p in enumerate(WORLD.order))
_ALL = [f"c{i}" for i in range(len(WORLD.order))]
_TOP = f"greatest({', '.join(_ALL)})"


def cluster_sql(src: str, by: str) -> str:
    which = " ".join(f"when {c} then '{p}'" for c, p in zip(_ALL, WORLD.order, strict=True))
    return f"select {by}, phase, score, ratio, case when ratio >= 0.6 and score >= 5 then 'medium' else 'low' end as confidence from (select {by}, case {_TOP} {which} end as phase, {_TOP} as score, round_even({_TOP} / ({' + '.join(_ALL)}), 6) as ratio from (select {by}, {_COUNTS} from {src} group by 1) where {_TOP} > 0)"


_VOICES = "(select slug, text from operator_data where kind = 'voice')"
_FACTION = "case " + " ".join(f"when contains(faction, '{n}') then '{p}'" for n, p in WORLD.factions) + " end"
_FIXED = lambda c: f"case {c} " + " ".join(f"when '{n}' then '{p}'" for n, p in WORLD.defaults.items()) + " end"
_MATCH = lambda c, rows: "case " + " ".join(f"when contains({c}, '{k}') then '{p}'" for k, p in rows) + " end"
_SCENE = "case " + " ".join(f"when {_any(w, 'lower(coalesce(scene, ' + chr(39) * 2 + '))')} then '{p}'" for p, w in WORLD.scene_words) + " end"
#: Default period of every record: slug, phase, source, confidence.
DEFAULTS = f"""select slug, coalesce({_FIXED("name_zh")}, {_FACTION}, c.phase, 'unknown') as phase, case when {_FIXED("name_zh")} is not null then 'default' when {_FACTION} is not null then 'faction' when c.phase is not null then 'cluster' else 'none' end as source,
case when {_FIXED("name_zh")} is not null then 'high' when {_FACTION} is not null then 'medium' when c.phase is not null then c.confidence else 'low' end as confidence from operators left join ({cluster_sql(_VOICES, "slug")}) c using (slug)"""

#: Pages of activities in the form of the template, made of the timeline; the chapters that lead to them.
PAGES = [
    ("灯塔旧事", "{{活动信息\n|名称=第9章 灯塔旧事\n|名称缩短=第9章|类型=主线\n}}\n正文|x=1", ["主线"]),
    ("潮汐之间", "前言\n{{活动信息|类型=支线故事\n|名称=灯塔的领水员\n|备注={{color|red|x=2}}\n}}", ["支线故事", "2023年"]),
    ("无人知晓", "{{活动信息\n|名称=无\n|类型=支线故事\n}}", ["支线故事"]),
    ("并非故事", "{{活动信息\n|名称=灯塔\n|类型=支线故事\n}}", ["杂项"]),
    ("空页", "没有模板|a=b", []),
]
CHAPTERS = ["CH-ST-1 灯塔旧事/NBT", "CH-ST-2 潮汐之间", "CH-ST-3 无人知晓", "CH-ST-4 并非故事", "CH-ST-5 空页", "CH00-000031", "没有代码", None]
MAIN = [(9, "lantern"), (0, "early")]


def _activities(s, d):  # noqa: ANN001, ANN202
    pages = s.createDataFrame(PAGES, "title string, value string, categories array<string>")
    from dataclasses import replace

    return P.activity_phases(s.createDataFrame([(c,) for c in CHAPTERS], "chapter string"), "chapter", pages, replace(WORLD, main_story=MAIN))


_CATEGORIES = lambda s, d: table(s, d, "operators").select("slug", F.array(F.concat(F.lit("属于"), F.substring("faction", 1, 2), F.lit("的干员")), F.when(F.col("page_type") == "operator", "干员")).alias("categories"))
_voices = lambda s, d: table(s, d, "operator_data").filter("kind = 'voice'").select("slug", "text")

QUERIES = {
    "phase_cascade": lambda s, d: P.infer(table(s, d, "documents").select("doc_id", "source", "text"), "source", rules=WORLD).select("doc_id", "phase", "phase_source", "phase_confidence"),
    "phase_content": lambda s, d: table(s, d, "documents").select("doc_id", F.coalesce(P.by_pattern(F.col("text"), WORLD), P.by_keyword(F.col("text"), WORLD)).alias("f")).filter("f is not null").select("doc_id", "f.*"),
    "phase_cluster": lambda s, d: P.cluster(table(s, d, "documents"), "source", rules=WORLD),
    "phase_default": lambda s, d: P.default_phase(table(s, d, "operators"), _voices(s, d), rules=WORLD),
    "phase_default_categories": lambda s, d: P.default_phase(table(s, d, "operators"), _voices(s, d), _CATEGORIES(s, d), WORLD),
    "phase_story": lambda s, d: table(s, d, "story_lines").select("row_id", "story_id", "scene").distinct().select("row_id", P.story_phase(F.col("story_id"), F.col("scene"), WORLD).alias("phase")),
    "phase_activities": _activities,
    "inference_report": lambda s, d: P.report(table(s, d, "annotated_lines")),
    "inference_suggestions": lambda s, d: P.suggestions(table(s, d, "annotated_lines")),
}
_CAT = "case substr(faction, 1, 2) when '灰港' then 'lantern' when '卫队' then 'interregnum' end"
ORACLE = {
    "phase_cascade": f"with c as ({cluster_sql('documents', 'source')}) select doc_id, coalesce({_PAT}, {_KEY}, c.phase, {_FIXED('source')}, 'unknown') as phase, case when {_PAT} is not null then 'content_pattern' when {_KEY} is not null then 'content_keyword' when c.phase is not null then 'cluster' when {_FIXED('source')} is not null then 'default' else 'none' end as phase_source, case when {_PAT} is not null then 'high' when {_KEY} is not null then 'medium' when c.phase is not null then c.confidence else 'low' end as phase_confidence from documents left join c using (source)",
    "phase_content": f"select doc_id, coalesce({_PAT}, {_KEY}) as phase, case when {_PAT} is not null then 'content_pattern' else 'content_keyword' end as source, case when {_PAT} is not null then 'high' else 'medium' end as confidence from documents where coalesce({_PAT}, {_KEY}) is not null",
    "phase_cluster": cluster_sql("documents", "source"),
    "phase_default": DEFAULTS,
    "phase_default_categories": f"with d as ({DEFAULTS}), o as (select *, {_CAT} as cat, page_type = 'operator' or faction is not null as member from operators) select slug, case when d.source = 'default' then d.phase when cat is not null then cat when d.source <> 'none' then d.phase when member then 'early' else 'unknown' end as phase, case when d.source = 'default' then 'default' when cat is not null then 'category' when d.source <> 'none' then d.source when member then 'category' else 'none' end as source, case when d.source = 'default' then 'high' when cat is not null then 'medium' when d.source <> 'none' then d.confidence else 'low' end as confidence from o join d using (slug)",
    "phase_story": f"select distinct row_id, coalesce({_MATCH('story_id', WORLD.chapters)}, {_MATCH('story_id', WORLD.activities)}, {_SCENE}, 'unknown') as phase from story_lines",
    "phase_activities": "select * from (values ('CH-ST-1 灯塔旧事/NBT', 'lantern', 'activity_type', 'high'), ('CH-ST-2 潮汐之间', 'lantern', 'activity_type', 'low'), ('CH-ST-3 无人知晓', null, null, null), ('CH-ST-4 并非故事', null, null, null), ('CH-ST-5 空页', null, null, null), ('CH00-000031', 'lantern', 'activity', 'medium'), ('没有代码', null, null, null), (null, null, null, null)) as t(chapter, phase, source, confidence)",
    "inference_report": "with k as (select coalesce(nullif(phase, ''), 'unknown') as p, coalesce(nullif(inference_source, ''), 'unknown') as s, coalesce(nullif(inference_confidence, ''), 'unknown') as c from annotated_lines), r as (select 'phase' as kind, p as value, count(*) as n from k group by 2 union all select 'source', s, count(*) from k group by 2 union all select 'confidence', c, count(*) from k group by 2 union all select 'total', '', count(*) from k) select kind, value, n, round_even(n / (select count(*) from k) * 100, 1) as pct from r",
    "inference_suggestions": "with a as (select avg((coalesce(nullif(phase, ''), 'unknown') = 'unknown')::int) as u, avg((inference_confidence is not distinct from 'low')::int) as l from annotated_lines) select 'add_content_rules' as suggestion from a where u > 0.5 union all select 'review_low_confidence' from a where l > 0.3",
}
