"""Queries of entities and relations and their SQL."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import hub
from ..operators import relations as G
from ..session import table

_names = lambda s, d: G.dictionary(table(s, d, "operators"), table(s, d, "name_aliases"))
_DICT = "own as (select distinct name_zh as alias, name_zh as canonical from operators where name_zh <> ''), dict as (select * from own union select alias, canonical from name_aliases where alias not in (select alias from own))"
_FOUND = f"with {_DICT}, first as (select alias, min(canonical) as canonical from dict group by 1), found as (select distinct doc_id, canonical as entity from documents join first on contains(text, alias))"
_EDGES = "each as (select *, unnest(case when len(coalesce(sources, [])) = 0 then [null] else sources end) as s from relation_edges)"
_RANK = "case confidence when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end"


def _merge(keys: str) -> str:
    return f"select {keys}, n as source_count, case when n >= 3 or r = 3 then 'high' when n >= 2 or r = 2 then 'medium' else 'low' end as confidence from (select {keys}, count(distinct s) as n, max({_RANK}) as r from each group by all)"


#: Words by which the test texts tell relations.
PATTERNS = [("comrade", "共事|答应过"), ("origin", "出身|早年做过"), ("duty", "经手人|其中有|负责"), ("duty", "轮流|登记"), ("letter", "写信说|总说")]


def _cast(s, d):  # noqa: ANN001, ANN202
    """Full names, and the given names of those of whom by-names are known, each for itself."""
    full = table(s, d, "operators").filter("name_zh <> ''").select(F.col("name_zh").alias("canonical"))
    given = table(s, d, "name_aliases").filter("canonical like '%·%'").select(F.substring_index("canonical", "·", 1).alias("canonical"))
    return full.unionByName(given).distinct().select(F.col("canonical").alias("alias"), "canonical")


def _mentions(s, d):  # noqa: ANN001, ANN202
    return G.relation_mentions(G.sentences(table(s, d, "documents"), ["doc_id"]), ["doc_id"], _cast(s, d), PATTERNS)


QUERIES = {
    "entity_mentions": lambda s, d: G.mentions(table(s, d, "documents"), "doc_id", _names(s, d)).distinct(),
    "cooccurrence_pairs": lambda s, d: G.cooccurrence(G.mentions(table(s, d, "documents"), "doc_id", _names(s, d)), "doc_id"),
    "relation_mentions": lambda s, d: _mentions(s, d),
    "relation_graph_of_texts": lambda s, d: G.merge(_mentions(s, d).withColumn("sources", F.array(F.col("doc_id").cast("string")))),
    "relation_edges_graph": lambda s, d: G.graph(table(s, d, "relation_edges"), ("phase", "src", "dst", "type")),
    "contextual_edges": lambda s, d: G.contextual_graph(hub.once(table(s, d, "annotated_lines"), "line_uid", "ingested_at"), _cast(s, d), table(s, d, "timeline"), "slug", PATTERNS),
    "normalize_name": lambda s, d: G.normalize(table(s, d, "story_lines").filter("speaker <> ''").select("speaker").distinct(), "speaker", table(s, d, "operators"), table(s, d, "name_aliases")),
    "relation_merge": lambda s, d: G.merge(table(s, d, "relation_edges"), ("phase", "src", "dst", "type")),
    "relation_merge_global": lambda s, d: G.merge(table(s, d, "relation_edges")),
    "relation_nodes": lambda s, d: G.nodes(table(s, d, "relation_edges"), table(s, d, "operators")),
    "relation_trajectories": lambda s, d: G.trajectories(G.merge(table(s, d, "relation_edges"), ("phase", "src", "dst", "type")), table(s, d, "timeline")),
}
_CAST = "cast_ as (select distinct name_zh as e from operators where name_zh <> '' union select distinct split_part(canonical, '·', 1) from name_aliases where contains(canonical, '·'))"
_VETO = "(" + " or ".join(f"contains(t, '{w}')" for w in R.RELATION_VETO) + ")"
_PATTERNS = ", ".join(f"({k}, '{t}', '{p}')" for k, (t, p) in enumerate(PATTERNS))
_OF, _IS = "contains(gap, '的') and length(gap) < 15", "contains(gap, '是') and contains(tail, '的')"


def _said(src: str, keys: str, prefix: str) -> str:
    """Relations that the sentences src(keys, n, t) state, as {prefix}m."""
    on = " and ".join(f"x.{k} = y.{k}" for k in keys.split(", "))
    x = lambda a: ", ".join(f"{a}.{k}" for k in keys.split(", "))
    p = prefix
    return f"""{p}h as (select {keys}, n, t, e from {src} join cast_ on contains(t, e)),
{p}j as (select {x("x")}, x.e as a, y.e as b, x.n as s, x.n as z, x.t from {p}h x join {p}h y on {on} and x.n = y.n and x.e < y.e where not {_VETO.replace("(t,", "(x.t,")}),
{p}r as (select distinct {x("x")}, least(x.e, y.e) as a, greatest(x.e, y.e) as b, x.n as s, y.n as z from {p}h x join {p}h y on {on} and y.n between x.n + 1 and x.n + 2 and x.e <> y.e),
{p}q as (select {x("r")}, r.a, r.b, r.s, r.z, string_agg(q.t, '。' order by q.n) as t from {p}r r join {src} q on {on.replace("x.", "r.").replace("y.", "q.")} and q.n between r.s and r.z where not exists (select 1 from {p}j j where {on.replace("x.", "j.").replace("y.", "r.")} and j.a = r.a and j.b = r.b) group by all),
{p}p as (select * from {p}j union all select * from {p}q where not {_VETO} and length(t) <= 240),
{p}f as (select {keys}, a, b, k, type, words, arg_min(t, s * 10 + z - s) as t from {p}p, (values {_PATTERNS}) as w(k, type, words) where regexp_matches(t, words) group by all),
{p}g as (select *, instr(t, a) as pa, instr(t, b) as pb, len(regexp_extract_all(t, words)) as c, instr(t, regexp_extract(t, words)) as pw from {p}f),
{p}d as (select *, case when pa < pb then substr(t, pa + length(a), greatest(pb - pa - length(a), 0)) else substr(t, pb + length(b), greatest(pa - pb - length(b), 0)) end as gap, case when pa < pb then substr(t, pb + length(b), 10) else substr(t, pa + length(a), 10) end as tail from {p}g),
{p}o as (select *, case when {_OF} then pa > pb when {_IS} then pa < pb else abs(pw - pa) < abs(pw - pb) end as fwd from {p}d),
{p}m as (select {keys}, case when fwd then a else b end as src, case when fwd then b else a end as dst, type, k as pattern, case when c >= 3 then 'high' when c = 2 then 'medium' else 'low' end as confidence,
  coalesce(left(trim(list_filter(string_split(t, '。'), lambda v: (contains(v, a) or contains(v, b)) and regexp_matches(v, words))[1], E' \\t\\r\\n　'), 200), '') as context from {p}o)"""


_PARTS = r"list_filter(list_transform(regexp_split_to_array(text, '[。！？\n]+'), lambda v: trim(v, E' \t\r\n　')), lambda v: v <> '')"
_DOCS = f"{_CAST}, s as (select doc_id, generate_subscripts(l, 1) - 1 as n, unnest(l) as t from (select doc_id, {_PARTS} as l from documents)), {_said('s', 'doc_id', 'd_')}"
_LINES = f"""{_CAST}, o as (select distinct on (line_uid) * from annotated_lines order by line_uid, ingested_at desc), live as (select slug, coalesce(nullif(phase, ''), 'unknown') as phase, pos, line_uid, text from o where source is distinct from 'archive' and text <> ''),
e as (select slug, phase, pos, line_uid, generate_subscripts(l, 1) as i, unnest(l) as t from (select *, {_PARTS} as l from live)),
ws as (select slug, row_number() over (partition by slug order by pos nulls first, line_uid, i) - 1 as n, t from e),
ps as (select slug, phase, row_number() over (partition by slug, phase order by pos nulls first, line_uid, i) - 1 as n, t from e where (slug, phase) in (select (slug, phase) from live where phase <> 'unknown' group by slug, phase having count(*) >= 3)),
{_said("ws", "slug", "w_")}, {_said("ps", "slug, phase", "p_")}"""
_CTX = f"""with {_LINES}, we as (select slug, src, dst, type, case max({_RANK}) when 3 then 'high' when 2 then 'medium' else 'low' end as confidence, list_sort(list_distinct(list(context) filter (where context <> '')))[1:2] as contexts from w_m group by all),
pe as (select slug, phase, src, dst, type, max({_RANK}) as r from p_m group by all),
ordered as (select slug, phase, row_number() over (partition by slug order by t.ord nulls last, phase) as o, count(*) over (partition by slug) as m from (select distinct slug, phase from pe) left join timeline t on t.id = phase), x as (select * from pe join ordered using (slug, phase) where m >= 2),
ph as (select slug, src, dst, type, list({{'phase': phase, 'confidence': case r when 3 then 'high' when 2 then 'medium' else 'low' end}} order by phase) as phases from pe group by all),
g as (select slug, src, dst, type, count(*) as n, min(o) as fo, arg_min(phase, o) as fp, arg_max(phase, o) as lp, arg_min(r, o) as fr, arg_max(r, o) as lr from x group by all),
a as (select g.slug, g.src, g.dst, g.type, string_agg(x.phase || '时期为' || x.type, '、' order by x.o, x.type) as also from g join x on g.slug = x.slug and g.src = x.src and g.dst = x.dst and g.type <> x.type group by all),
c as (select g.slug, g.src, g.dst, g.type, case when n = 1 and fo > 1 then '在' || fp || '时期新出现' when n = 1 then '仅在' || fp || '时期出现后消失' when lr > fr then '从' || fp || '到' || lp || '逐步强化' when lr < fr then '从' || fp || '到' || lp || '逐步淡化' end as course from g),
tr as (select slug, src, dst, type, case when course is not null and also is not null then course || '；同时' || also when also is not null then '关系类型存在变化：' || also else course end as trajectory from c left join a using (slug, src, dst, type))
select slug, src, dst, type, confidence, coalesce(contexts, []) as contexts, coalesce(phases, []) as phases, trajectory from we left join ph using (slug, src, dst, type) left join tr using (slug, src, dst, type)"""

ORACLE = {
    "relation_mentions": f"with {_DOCS} select doc_id, src, dst, type, pattern, confidence, context from d_m",
    "relation_graph_of_texts": f"with {_DOCS} select src, dst, type, n as source_count, case when n >= 3 or r = 3 then 'high' when n >= 2 or r = 2 then 'medium' else 'low' end as confidence from (select src, dst, type, count(distinct doc_id) as n, max({_RANK}) as r from d_m group by all)",
    "relation_edges_graph": f"with {_EDGES}, m as ({_merge('phase, src, dst, type')}), s as (select phase, src, dst, type, coalesce(list_sort(list_distinct(flatten(list(coalesce(sources, []))))), []) as sources, coalesce(list_sort(list_distinct(list_filter(flatten(list(coalesce(contexts, []))), lambda v: v <> '')))[1:3], []) as contexts from relation_edges group by all) select m.*, s.sources, s.contexts from m join s on m.phase is not distinct from s.phase and m.src = s.src and m.dst = s.dst and m.type = s.type",
    "contextual_edges": _CTX,
    "normalize_name": "with k as (select name_zh as k, 0 as o, name_zh as c, false as low from operators where name_zh <> '' union all select alias, 1, canonical, false from name_aliases union all select lower(name_en), 2, name_zh, true from operators where name_zh <> '' and name_en <> ''), n as (select distinct speaker from story_lines where speaker <> '') select speaker, (select c from k where case when low then k = lower(trim(speaker, E' \t\r\n　')) else k = trim(speaker, E' \t\r\n　') end order by o, c limit 1) as canonical from n",

    "entity_mentions": f"{_FOUND} select * from found",
    "cooccurrence_pairs": f"{_FOUND} select x.entity as a, y.entity as b, count(*) as n from found x join found y using (doc_id) where x.entity < y.entity group by 1, 2",
    "relation_merge": f"with {_EDGES} {_merge('phase, src, dst, type')}",
    "relation_merge_global": f"with {_EDGES} {_merge('src, dst, type')}",
    "relation_nodes": "select name, coalesce(min(name_en), '') as name_en, coalesce(min(race), 'unknown') as race, coalesce(min(faction), 'unknown') as faction from (select src as name from relation_edges union select dst from relation_edges) left join operators on name_zh = name group by 1",
    "relation_trajectories": f"""with {_EDGES}, e as (select *, {_RANK} as r from ({_merge('phase, src, dst, type')}) where phase is not null),
ordered as (select phase, row_number() over (order by t.ord nulls last, phase) as o from (select distinct phase from e) left join timeline t on t.id = phase), x as (select * from e join ordered using (phase)),
g as (select src, dst, type, count(*) as n, min(o) as fo, arg_min(phase, o) as fp, arg_max(phase, o) as lp, arg_min(r, o) as fr, arg_max(r, o) as lr from x group by all),
a as (select g.src, g.dst, g.type, string_agg(x.phase || '时期为' || x.type, '、' order by x.o, x.type) as also from g join x on g.src = x.src and g.dst = x.dst and g.type <> x.type group by all),
c as (select g.src, g.dst, g.type, case when n = 1 and fo > 1 then '在' || fp || '时期新出现' when n = 1 then '仅在' || fp || '时期出现后消失' when lr > fr then '从' || fp || '到' || lp || '逐步强化' when lr < fr then '从' || fp || '到' || lp || '逐步淡化' end as course from g)
select c.src, c.dst, c.type, case when course is not null and also is not null then course || '；同时' || also when also is not null then '关系类型存在变化：' || also else course end as evolution from c left join a using (src, dst, type) where coalesce(course, also) is not null and (select count(*) from ordered) >= 2""",
}
