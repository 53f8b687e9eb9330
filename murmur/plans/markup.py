"""Queries of wiki pages and their SQL."""

from pyspark.sql import functions as F

from ..operators import wiki as W
from ..session import table
from ..sources import readers as R

_CLEAN = "text"
for _p, _t, _o in ((r"<!--.*?-->", "", "gs"), (r"<ref[^>]*>.*?</ref>", "", "gs"), (r"\{\{[^{}]*\}\}", "", "g"), (r"\[\[([^|\]]*\|)?([^\]]*)\]\]", r"\2", "g"), ("''{2,5}", "", "g"), (r"<[^>]+>", "", "g"), (r"\n{3,}", "\n\n", "g")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_t}', '{_o}')"
_CLEAN = f"trim({_CLEAN}, E' \\t\\r\\n　\u00a0\u2005\u2009\u202f')"
_SLUG_IN = "name_en"

REDIRECTS = [("a", "#REDIRECT [[b]]"), ("b", "#redirect [[c]]"), ("c", "正文"), ("d", "#REDIRECT [[nowhere]]"), ("e", ""), ("e/NBT", "剧情"), ("f", "#重定向 [[e]]"), ("g", None), ("h", "#REDIRECT [[h]]"), *[(f"k{i:02}", f"#REDIRECT [[k{i + 1:02}]]") for i in range(40)], ("k40", "尾")]
_FIELDS = ["name_zh", "name_en", "faction", "race", "birthday", "description"]
_KIND = "case when faction is null then case when race is null then 'none' else 'enemy' end when length(slug) % 3 = 0 then 'archive' else 'operator' end"


def _pages(s, d):  # noqa: ANN001, ANN202
    """Pages of every kind, written from the records: slug, path, value."""
    rec, brace = table(s, d, "operators").withColumn("kind", F.expr(_KIND)), lambda name, *rows: F.concat(F.lit("{{" + name + "\n"), *rows, F.lit("}}\n"))
    row = lambda k, c: F.concat(F.lit(f"|{k}="), F.coalesce(F.col(c), F.lit("")), F.lit("\n"))
    body = F.when(F.col("kind") == "operator", F.concat(brace("CharinfoV2", row("干员名", "name_zh"), row("干员外文名", "name_en"), F.lit("|所属组织={{color|red|"), F.coalesce("faction", F.lit("")), F.lit("}}\n")), brace("人员档案set", F.lit("|种族=[["), F.coalesce("race", F.lit("无")), F.lit("|"), F.coalesce("race", F.lit("无")), F.lit("]]\n"), row("生日", "birthday"))))
    body = body.when(F.col("kind") == "enemy", brace("敌人信息/2", row("名称", "name_zh"), row("种类", "race"), row("描述", "infection_status"))).when(F.col("kind") == "archive", F.lit("== 干员档案 ==\n")).otherwise("正文")
    voice = F.concat(F.lit("|标题1=问候\n|台词1={{VoiceData/word|中文|"), F.coalesce("infection_status", F.lit("。")), F.lit("}}\n|标题2=空\n|台词2=\n"))
    return rec.select("slug", F.col("slug").alias("path"), F.concat(body, F.when(F.col("kind") == "operator", voice).otherwise("")).alias("value"))


QUERIES = {
    "clean_markup": lambda s, d: table(s, d, "documents").select("doc_id", W.clean(F.col("text")).alias("clean")),
    "page_redirects": lambda s, d: W.follow_redirects(s.createDataFrame(REDIRECTS, "path string, value string")),
    "legacy_records": lambda s, d: W.legacy_records(table(s, d, "operators").select(F.col("slug").alias("path"), F.concat(F.lit("|种族 = "), F.coalesce("race", F.lit("")), F.lit("\n| 阵营="), F.coalesce("faction", F.lit("")), F.lit("|职业=木匠\n==干员档案==\n'''"), F.coalesce("infection_status", F.lit("无")), F.lit("'''\n==语音==\n")).alias("value"))).select("path", "race", "faction", "profession", F.col("archives")[0]["text"].alias("archive"), F.size("voice_lines").cast("bigint").alias("voices")),
    "page_sections": lambda s, d: R.local_records(table(s, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("value"))).select(F.col("path").alias("doc_id"), F.explode("fields").alias("section", "body")).filter("startswith(section, 'section_')"),
    "link_unwrap": lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(W.wiki_links(F.col("text"))).alias("k", "l")).select("doc_id", F.col("k").cast("bigint").alias("k"), "l.target", "l.label"),
    "page_type": lambda s, d: _pages(s, d).select("slug", W.page_type(F.col("value")).alias("page_type")),
    "page_records": lambda s, d: W.parse_pages(_pages(s, d)).select(F.col("path").alias("slug"), "page_type", *_FIELDS, F.size("voice_lines").cast("bigint").alias("voices"), F.coalesce(F.size("archives"), F.lit(0)).cast("bigint").alias("archives")),
    "page_voices": lambda s, d: W.parse_pages(_pages(s, d)).select(F.col("path").alias("slug"), F.posexplode("voice_lines").alias("k", "v")).select("slug", F.col("k").cast("bigint").alias("k"), "v.label", "v.text"),
    "slug": lambda s, d: table(s, d, "operators").filter("name_en is not null").select(F.col("slug").alias("stored"), W.slug(F.col("name_en")).alias("made")),
    "page_url": lambda s, d: table(s, d, "operators").select("slug", W.page_url(F.col("name_en"), "https://wiki.example/w/").alias("url")),
    "title_split_sections": lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(F.filter(F.transform(F.split("text", r"(?m)^#+\s+"), W.T.strip), lambda x: F.length(x) > 20)).alias("k", "section")).withColumn("k", F.col("k").cast("bigint")),
    "voice_payload": lambda s, d: table(s, d, "operator_data").select("rec_id", "text").distinct().select("rec_id", W.clean_voice(F.col("text")).alias("clean")),
}
_MD = r"regexp_split_to_array(text, '(?m)^#+\s+')"
ORACLE = {
    "page_redirects": "select * from (values ('a', 'c', '正文'), ('b', 'c', '正文'), ('c', 'c', '正文'), ('d', 'd', '#REDIRECT [[nowhere]]'), ('e', 'e', '剧情'), ('e/NBT', 'e/NBT', '剧情'), ('f', 'e', '剧情'), ('g', 'g', null), ('h', 'h', '#REDIRECT [[h]]')) as t(path, target, value) union all select 'k' || lpad(i::varchar, 2, '0'), 'k40', '尾' from range(0, 41) as r(i)",
    "legacy_records": r"select slug as path, nullif(race, '') as race, nullif(faction, '') as faction, '木匠' as profession, coalesce(infection_status, '无') as archive, 0 as voices from operators",
    "page_sections": rf"""with p as (select doc_id, generate_subscripts(l, 1) as i, unnest(l) as x from (select doc_id, {_MD} as l from documents)), t as (select doc_id, i, 'section_' || trim(split_part(x, E'\n', 1), E' \t\r\n　') as section, case when contains(x, E'\n') then trim(substr(x, instr(x, E'\n') + 1), E' \t\r\n　') else '' end as body from p where i > 1)
select doc_id, section, arg_max(body, i) as body from t group by 1, 2""",
    "clean_markup": f"select doc_id, {_CLEAN} as clean from documents",
    "link_unwrap": r"""with l as (select doc_id, regexp_extract_all(text, '\[\[(?:([^|\]\n]*)\|)?([^\]\n]*)\]\]', 1) as a, regexp_extract_all(text, '\[\[(?:([^|\]\n]*)\|)?([^\]\n]*)\]\]', 2) as b from documents)
select doc_id, (i - 1)::bigint as k, coalesce(nullif(a[i], ''), b[i]) as target, b[i] as label from (select *, unnest(range(1, len(b) + 1)) as i from l)""",
    "page_type": f"select slug, case {_KIND} when 'none' then 'unknown' when 'enemy' then 'enemy' else 'operator' end as page_type from operators",
    "page_records": f"""select slug, case k when 'none' then 'unknown' when 'enemy' then 'enemy' else 'operator' end as page_type, case when k in ('operator', 'enemy') then nullif(trim(name_zh), '') end as name_zh, case when k = 'operator' then nullif(trim(name_en), '') end as name_en,
  case when k = 'operator' then nullif(trim(faction), '') end as faction, case k when 'operator' then coalesce(race, '无') when 'enemy' then nullif(trim(race), '') end as race, case when k = 'operator' and birthday <> '未公开' then nullif(trim(birthday), '') end as birthday, case when k = 'enemy' then nullif(trim(infection_status), '') end as description,
  case when k = 'operator' then 1 else 0 end as voices, 0 as archives from (select *, {_KIND} as k from operators)""",
    "page_voices": f"select slug, 0 as k, '问候' as label, coalesce(infection_status, '。') as text from operators where {_KIND} = 'operator'",
    "slug": r"select slug as stored, regexp_replace(trim(regexp_replace(lower(name_en), '[^a-z0-9\s-]', '', 'g')), '\s+', '-', 'g') as made from operators where name_en is not null",
    "page_url": "select slug, 'https://wiki.example/w/' || url_encode(name_en) as url from operators",
    "title_split_sections": r"""with s as (select doc_id, [x for x in [trim(y, E' \t\r\n　') for y in regexp_split_to_array(text, '(?m)^#+\s+')] if length(x) > 20] as l from documents) select doc_id, (i - 1)::bigint as k, l[i] as section from (select *, unnest(range(1, len(l) + 1)) as i from s)""",
    "voice_payload": r"select distinct rec_id, coalesce(nullif(regexp_extract(text, '\{\{VoiceData/word\|中文\|(.+?)\}\}', 1), ''), " + _CLEAN + ") as clean from operator_data",
}
