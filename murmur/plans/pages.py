"""Queries of pages made from the tables (scripts, wiki dialogue, headings, front matter) and rule texts, with their SQL."""

from pyspark.sql import functions as F

from ..operators import hub as H
from ..operators import persona as P
from ..operators import relations as G
from ..session import table
from ..sources import readers as R
from .persona import PERSONA

#: Speaker whose lines count as the target's.
TARGET = "薇洛恩"


def _rows(s, d):  # noqa: ANN001, ANN202
    """Story lines once, in one line each, without the brackets that are commands in a script."""
    flat = F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "[]", "［］"), r"\s+", " "))
    who = F.coalesce(F.nullif(F.trim(F.regexp_replace("speaker", r"['‘’：:\s\"]+", " ")), F.lit("")), F.lit("旁白"))
    return H.once(table(s, d, "story_lines"), "row_id").select(F.col("story_id").alias("path"), "pos", "row_id", who.alias("who"), flat.alias("said"), F.coalesce(F.nullif("scene", F.lit("")), F.lit("")).alias("scene"))


def _pages(s, d, line):  # noqa: ANN001, ANN202
    """One page a story: its lines in order."""
    each = _rows(s, d).withColumn("l", line)
    return each.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "row_id", "l"))), lambda x: x["l"]), "\n").alias("value"))


_script = lambda s, d: H.dialogues(_pages(s, d, F.concat(F.lit('[name="'), "who", F.lit('"]'), "said", F.lit("\n[Delay(time=1)]"))), TARGET)
_wiki = lambda s, d: H.dialogues(_pages(s, d, F.concat(F.when(F.col("scene") != "", F.concat(F.lit("== "), "scene", F.lit(" ==\n"))).otherwise(""), F.lit("'''"), "who", F.lit("'''："), "said")), TARGET)
_number = lambda d: d.groupBy("path", "speaker", "text", *[c for c in ("scene", "is_target", "reply_to") if c in d.columns]).agg(F.count(F.lit(1)).alias("n"))

QUERIES = {
    "dialogue_script": lambda s, d: _number(_script(s, d).select("path", "speaker", "text", "is_target", "reply_to")),
    "dialogue_narration": lambda s, d: _script(s, d).select("path", F.explode("narration").alias("narration")).groupBy("path", "narration").agg(F.count(F.lit(1)).alias("n")),
    "dialogue_wiki": lambda s, d: _number(_wiki(s, d).select("path", "speaker", "text", "scene", "is_target", "reply_to")),
    "timeline_headings": lambda s, d: R.timeline(table(s, d, "timeline").select(F.col("id").alias("path"), F.concat(F.lit("前言\n### "), "year_range", F.lit(" "), "label", F.lit("\n正文")).alias("value"))),
    "frontmatter_fields": lambda s, d: R.frontmatter(table(s, d, "operators").select(F.col("slug").alias("path"), F.concat(F.lit("---\nname: "), F.coalesce("name_zh", F.lit("")), F.lit("\nurl: "), F.coalesce("source_url", F.lit("")), F.lit("\n无\n---\n正文: x")).alias("value"))).select(F.col("path").alias("slug"), F.explode("fields").alias("field", "value")),
    "section_loader": lambda s, d: R.sections(table(s, d, "documents").filter("text <> ''").select(F.col("doc_id").alias("path"), F.col("text").alias("value"))).select(F.col("path").alias("doc_id"), F.col("k").cast("bigint").alias("k"), "section"),
    "name_boundaries": lambda s, d: table(s, d, "documents").select("doc_id", *[F.rlike("text", F.lit(G.name_pattern([n]))).alias(c) for n, c in (("K", "letter"), ("嗯", "character"), ("雾", "inside"), ("灰港", "word"))]),
    "persona_rules": lambda s, d: s.createDataFrame([(p, k, x) for p, xs in (("layer0", _P["layer0"]), ("layer5", _P["layer5"]), ("words", _P["style"]["frequent_words"]), ("self", [_P["style"]["self_reference"]]), ("phrases", [_P["style"]["catchphrases"]]), ("corrections", _P["corrections"])) for k, x in enumerate(xs)], "part string, k bigint, text string"),
    "persona_patterns": lambda s, d: s.createDataFrame([(r, p, t) for r in _P["layer0"] for p, t in P.forbidden(r)] + [(r, w, "taboo") for r in _P["layer5"] for w in P.taboo_words(r)], "rule string, pattern string, text string"),
}
_P = P.parse(PERSONA)

_FLAT = "trim(regexp_replace(translate(coalesce(text, ''), '[]', '［］'), '\\s+', ' ', 'g'), ' ')"
_WHO = "coalesce(nullif(trim(regexp_replace(speaker, '[''‘’：:\\s\"]+', ' ', 'g'), ' '), ''), '旁白')"
_LINES = f"r as (select distinct on (row_id) story_id as path, pos, row_id, {_WHO} as who, {_FLAT} as said, nullif(scene, '') as scene from story_lines)"
_ANSWER = "case when t then coalesce(case when not lead(t) over w then lead(speaker) over w end, case when not lag(t) over w then lag(speaker) over w end) end"
_SPOKEN = f"s as (select path, pos, row_id, who as speaker, regexp_replace(said, '[（(](.+?)[）)]', '', 'g') as text, contains(who, '{TARGET}') as t from r), k as (select path, pos, row_id, speaker, trim(text, E' \\t\\r\\n　') as text, t from s where trim(text, E' \\t\\r\\n　') <> '')"
ORACLE = {
    "dialogue_script": f"with {_LINES}, {_SPOKEN}, a as (select path, speaker, text, t as is_target, {_ANSWER} as reply_to from k window w as (partition by path order by pos, row_id)) select *, count(*) as n from a group by all",
    "dialogue_narration": f"with {_LINES}, {_SPOKEN} select path, narration, count(*) as n from (select path, unnest(regexp_extract_all(said, '[（(](.+?)[）)]', 1)) as narration from r where row_id in (select row_id from k)) group by all",
    "dialogue_wiki": f"with {_LINES}, k as (select path, pos, row_id, who as speaker, said as text, contains(who, '{TARGET}') as t, last_value(scene ignore nulls) over (partition by path order by pos, row_id rows between unbounded preceding and current row) as scene from r), l as (select * from k where text <> ''), a as (select path, speaker, text, scene, t as is_target, {_ANSWER} as reply_to from l window w as (partition by path order by pos, row_id)) select *, count(*) as n from a group by all",
    "timeline_headings": r"select id as path, 0 as ord, year_range as range, label from timeline where regexp_matches(year_range, '^\d{3,4}-\d{3,4}$') union all select id, k, '', e from timeline, (values (0, 'early'), (1, 'babel'), (2, 'resurrected')) as t(k, e) where not regexp_matches(year_range, '^\d{3,4}-\d{3,4}$')",
    "frontmatter_fields": "select slug, 'name' as field, coalesce(name_zh, '') as value from operators union all select slug, 'url', coalesce(source_url, '') from operators",
    "section_loader": r"""with p as (select doc_id, text, [x for x in [trim(y, E' \t\r\n　') for y in case when regexp_matches(text, '(?m)^#+\s+') then regexp_split_to_array(text, '(?m)^#+\s+') else regexp_split_to_array(text, '\n\s*\n') end] if length(x) > 20] as l from documents where text <> ''),
q as (select doc_id, case when len(l) > 0 then l else [trim(text, E' \t\r\n　')] end as l from p) select doc_id, (i - 1)::bigint as k, l[i] as section from (select *, unnest(range(1, len(l) + 1)) as i from q)""",
    "name_boundaries": "select doc_id, regexp_matches(text, '(^|[^A-Za-z0-9])K([^A-Za-z0-9]|$)') as letter, regexp_matches(text, '(^|[^一-鿿])嗯([^一-鿿]|$)') as character, regexp_matches(text, '(^|[^一-鿿])雾([^一-鿿]|$)') as inside, contains(text, '灰港') as word from documents",
    "persona_rules": "select * from (values ('layer0', 0, '从不用命令口吻说话'), ('layer0', 1, '不用感叹号'), ('layer0', 2, '不说「归我了」'), ('layer0', 3, '不会哭'), ('layer5', 0, '不谈「内鬼」'), ('layer5', 1, '不谈牺牲'), ('words', 0, '海图'), ('words', 1, '缆绳'), ('words', 2, '雾'), ('self', 0, '极少自称'), ('phrases', 0, '「……在呢」、「依我看」')) as t(part, k, text)",
    "persona_patterns": "select * from (values ('从不用命令口吻说话', '命令|给我|必须|立刻|马上', '使用了命令式语气'), ('不用感叹号', '[！!]', '使用了感叹号'), ('不说「归我了」', '归我了', '使用了''归我了'''), ('不会哭', '哭了|流泪|泪流|泪水', '出现了哭泣描写'), ('不谈「内鬼」', '内鬼', 'taboo'), ('不谈牺牲', '牺牲', 'taboo')) as t(rule, pattern, text)",
}
