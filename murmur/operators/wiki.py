"""Raw wiki pages to records: cleaning, templates, fields, archives, voice lines, slugs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize

# Keys of the templates and the columns they fill.
CHARINFO = {"干员名": "name_zh", "干员外文名": "name_en", "稀有度": "rarity", "职业": "profession", "分支": "branch", "所属国家": "country", "所属组织": "faction", "位置": "position", "标签": "tags", "画师": "artist", "中文配音": "cv_zh"}
ENEMY = {"名称": "name_zh", "地位级别": "threat_level", "描述": "description", "伤害类型": "damage_type", "攻击方式": "attack_type", "种类": "race"}
PROFILE = {"性别": "gender", "战斗经验": "combat_experience", "出身地": "birthplace", "生日": "birthday", "种族": "race", "身高": "height", "矿石病感染情况": "infection_status", "是否感染者": "is_infected"}
ATTRIBUTES = {"所属势力": "faction", "隐藏势力": "hidden_faction"}
# Slugs of names that aren't spelled by rule.
SLUGS = {"特蕾西娅": "te-lei-xi-ya", "特雷西斯": "te-lei-xi-si", "阿米娅": "a-mi-ya", "凯尔希": "kai-er-xi", "博士": "bo-shi", "塔露拉": "ta-lu-la", "银灰": "yin-hui", "陈": "chen", "星熊": "xing-xiong", "W": "w", "可露希尔": "ke-lu-xi-er", "华法琳": "hua-fa-lin", "伊芙利特": "yi-fu-li-te", "塞雷娅": "sai-lei-ya", "推进之王": "tui-jin-zhi-wang", "煌": "huang", "史尔特尔": "shi-er-te-er", "浊心斯卡蒂": "zhuo-xin-si-ka-di", "玛恩纳": "ma-en-na", "令": "ling", "耀骑士临光": "yao-qi-shi-lin-guang", "异客": "yi-ke", "爱布拉娜": "ai-bu-la-na", "维什戴尔": "wei-shi-dai-er", "魔王": "mo-wang"}
_LINK = r"\[\[([^|\]]*\|)?([^\]]*)\]\]"


def clean(c: Column) -> Column:
    """Wiki markup off: comments, references, innermost templates, link targets, emphasis, tags; at most one blank line."""
    for pattern, to in ((r"(?s)<!--.*?-->", ""), (r"(?s)<ref[^>]*>.*?</ref>", ""), (r"\{\{[^{}]*\}\}", ""), (_LINK, "$2"), (r"'{2,5}", ""), (r"<[^>]+>", ""), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, to)
    return T.strip(c)


def clean_voice(c: Column) -> Column:
    """The first payload of a voice template up to its first '}}', else the cleaned text."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"\{\{VoiceData/word\|中文\|(.+?)\}\}", 1), F.lit("")), clean(c))


_BRACES = re.compile(r"\{\{|\}\}")


def body_of(text: str | None, name: str, pattern: bool = False) -> str | None:
    """Body of the first {{name template (name may be a pattern), from the line after its name to its own closing braces; NULL if there is none or it never closes."""
    head = re.search(r"\{\{%s\s*\n" % (name if pattern else re.escape(name)), text) if text else None
    depth = 1
    for b in _BRACES.finditer(text, head.end()) if head else ():
        depth += 1 if b.group() == "{{" else -1
        if depth == 0:
            return text[head.end() : b.start()]
    return None


def template_body(c: Column, name: str, pattern: bool = False) -> Column:
    """body_of as a column. Balanced braces are no regular language, so this is the one Python function of this module."""

    @F.pandas_udf("string")
    def body(s: pd.Series) -> pd.Series:
        return s.map(lambda t: body_of(t, name, pattern), na_action="ignore")

    return body(F.when(F.rlike(c, F.lit("\\{\\{" + name)) if pattern else F.contains(c, F.lit("{{" + name)), c))


def fields(body: Column, keys: dict[str, str], drop: tuple[str, ...] = ()) -> Column:
    """Map column -> value of '|key=value' lines; links unwrapped, colours and other templates off; the last of equal keys holds."""
    lines = F.filter(F.transform(F.split(body, "\n"), T.strip), lambda x: F.startswith(x, F.lit("|")) & F.contains(x, F.lit("=")))

    def entry(x: Column) -> Column:
        key = T.strip(F.regexp_extract(x, r"(?s)^\|([^=]*)=", 1))
        value = T.strip(F.regexp_extract(x, r"(?s)^\|[^=]*=(.*)$", 1))
        for pattern, to in ((r"\{\{color\|[^|]*\|([^}]*)\}\}", "$1"), (r"\{\{[^{}]*\}\}", ""), (_LINK, "$2")):
            value = F.regexp_replace(value, pattern, to)
        return F.struct(T.first_match(F.concat(F.lit("\x01"), key, F.lit("\x01")), [(f"\x01{k}\x01", v) for k, v in keys.items()]).alias("key"), T.strip(value).alias("value"))

    entries = F.filter(F.transform(lines, entry), lambda e: e["key"].isNotNull() & (e["value"] != "") & ~e["value"].isin(list(drop) or ["\x00"]))
    # the last entry of each key
    keep = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(keep)


def page_type(c: Column) -> Column:
    return F.when(F.rlike(c, F.lit(r"\{\{Charinfo(V2)?")), "operator").when(F.contains(c, F.lit("{{敌人信息/")), "enemy").when(F.rlike(c, F.lit(r"==\s*干员档案\s*==")), "operator").otherwise("unknown")


def archives(body: Column) -> Column:
    """Array of (index, title, text) of an archive template's numbered entries; entries without text are left out."""
    p = r"(?s)\|档案(\d+)=([^\n|]+)\s*\n\s*\|档案\1条件=[^\n]*\n\s*\|档案\1文本=(.*?)(?=\n\s*\|档案\d+=|\z)"
    group = lambda i: F.regexp_extract_all(body, F.lit(p), F.lit(i))
    rows = F.transform(F.arrays_zip(group(1).alias("a"), group(2).alias("b"), group(3).alias("c")), lambda x: F.struct(x["a"].cast("int").alias("index"), T.strip(x["b"]).alias("title"), clean(F.regexp_replace(x["c"], r"<br\s*/?>", "\n")).alias("text")))
    return F.filter(rows, lambda x: x["text"] != "")


def old_archive(text: Column) -> Column:
    """The archive section of a page in the old form as one entry of at most 500 characters; NULL if there is none."""
    section = F.regexp_extract_all(text, F.lit(r"(?s)==\s*干员档案\s*==\n(.*?)(?=\n==[^=])"), F.lit(1))
    return F.when(F.size(section) > 0, F.array(F.struct(F.lit(0).alias("index"), F.lit("干员档案").alias("title"), F.left(clean(section[0]), F.lit(500)).alias("text"))))


def abilities(body: Column) -> Column:
    """The ability block of an enemy template, over several lines up to the next field; NULL without one."""
    t = F.regexp_extract(body, r"(?s)\|能力\s*=\s*(.*?)(?=\n\||\n?\}\})", 1)
    for p, to in ((r"\{\{color\|[^|]*\|([^}]*)\}\}", "$1"), (r"\{\{[^{}]*\}\}", ""), (r"<br\s*/?>", "\n")):
        t = F.regexp_replace(T.strip(t), p, to)
    return F.nullif(T.strip(t), F.lit(""))


def voice_lines(text: Column) -> Column:
    """Array of (label, text) of numbered titles and lines; empty ones are left out."""
    p = r"(?s)\|标题(\d+)\s*=\s*([^\n|]+)\s*\n\s*\|台词\1\s*=\s*(.*?)(?=\n\s*\|标题\d+=|\n\s*\|语音\d+=|\z)"
    group = lambda i: F.regexp_extract_all(text, F.lit(p), F.lit(i))
    rows = F.transform(F.arrays_zip(group(2).alias("b"), group(3).alias("c")), lambda x: F.struct(T.strip(x["b"]).alias("label"), clean_voice(T.strip(x["c"])).alias("text")))
    return F.filter(rows, lambda x: x["text"] != "")


def parse_pages(pages: DataFrame) -> DataFrame:
    """One record a page(path, value): path, page_type, every field as a column, abilities, archives, voice_lines.

    The character template comes first; the attribute template fills the faction, the profile template the rest. A page
    without the archive template may have the old section; one without voice lines those of its page path/语音记录.
    """
    v = F.col("value")
    b = pages.withColumns({"__v2": template_body(v, "CharinfoV2"), "__v1": template_body(v, "Charinfo"), "__en": template_body(v, "敌人信息/[a-z0-9]+", True), "__pr": template_body(v, "人员档案set"), "__at": template_body(v, "属性"), "__ar": template_body(v, "人员档案")})
    m = {"info": fields(F.coalesce("__v2", "__v1"), CHARINFO), "enemy": fields(F.col("__en"), ENEMY), "attr": fields(F.col("__at"), ATTRIBUTES), "prof": fields(F.col("__pr"), PROFILE, ("未公开",))}
    b = b.withColumns({f"__m_{k}": x for k, x in m.items()})
    names = list(dict.fromkeys([*CHARINFO.values(), *ENEMY.values(), *ATTRIBUTES.values(), *PROFILE.values()]))
    return b.select("path", page_type(v).alias("page_type"), *[F.coalesce(*[F.try_element_at(f"__m_{k}", F.lit(n)) for k in m]).alias(n) for n in names], abilities(F.col("__en")).alias("abilities"), F.when(F.coalesce("__ar", F.lit("")) != "", archives(F.col("__ar"))).otherwise(old_archive(v)).alias("archives"), voice_lines(v).alias("voice_lines"))


def with_voice_pages(records: DataFrame, pages: DataFrame) -> DataFrame:
    """records of parse_pages; those without voice lines get the lines of their page's voice page, if pages hold one."""
    sub = pages.filter("endswith(path, '/语音记录')").select(F.regexp_replace("path", "/语音记录$", "").alias("__p"), voice_lines(F.col("value")).alias("__v"))
    sub = sub.groupBy("__p").agg(F.first("__v").alias("__v"))
    own = F.size(F.coalesce("voice_lines", F.array())) > 0
    return records.join(sub, F.col("path") == F.col("__p"), "left").withColumn("voice_lines", F.when(own, F.col("voice_lines")).otherwise(F.coalesce("__v", "voice_lines"))).drop("__p", "__v")


def legacy_records(pages: DataFrame) -> DataFrame:
    """path, race, faction, profession, archives, voice_lines of pages in the old form, by field names wherever they stand."""
    v = F.col("value")
    field = lambda k: F.nullif(T.strip(F.regexp_extract(v, rf"\|\s*{k}\s*=\s*([^\n|]+)", 1)), F.lit(""))
    b = pages.withColumn("__ar", template_body(v, "人员档案"))
    return b.select("path", field("种族").alias("race"), field("阵营").alias("faction"), field("职业").alias("profession"), F.when(F.coalesce("__ar", F.lit("")) != "", archives(F.col("__ar"))).otherwise(old_archive(v)).alias("archives"), voice_lines(v).alias("voice_lines"))


def slug(c: Column) -> Column:
    """Fixed slugs, then lower-case ASCII with hyphens; names of other scripts keep their ASCII part, or get a stable number."""
    fixed = F.lit(None).cast("string")
    for k, v in SLUGS.items():
        fixed = F.when(c == k, v).otherwise(fixed)
    ascii_ = F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9\s-]", "")), r"\s+", "-")
    number = F.concat(F.lit("op-"), F.lpad(F.pmod(F.xxhash64(c), F.lit(10000)).cast("string"), 4, "0"))
    return F.coalesce(fixed, F.nullif(ascii_, F.lit("")), number)


def page_url(c: Column, base: str) -> Column:
    """Address of a page: the percent-encoded name behind the base."""
    return F.concat(F.lit(base), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")))


def follow_redirects(pages: DataFrame) -> DataFrame:
    """path, target, value: each page with the text of the page its redirects lead to; an empty text is that of target/NBT if there is one.

    Every step joins each page's way with the way of where it leads, so chains of any length end after the logarithm of
    their length. A dangling redirect keeps its own page; one that goes round ends at itself or at a page of its circle.
    """
    to = F.nullif(F.regexp_extract("value", r"(?i)^\s*#(?:REDIRECT|重定向)\s*\[\[([^\]|#]+)", 1), F.lit(""))
    links = materialize(pages.groupBy("path").agg(F.first("value").alias("value")), "wiki")
    there = links.select(F.col("path").alias("__q"))
    way = links.select("path", to.alias("to")).join(there, F.col("to") == F.col("__q"), "left").select("path", F.coalesce("__q", "path").alias("target"))
    left = None
    while True:
        way = materialize(way, "wiki")
        far = way.select(F.col("path").alias("__p"), F.col("target").alias("__t"))
        step = materialize(way.join(far, F.col("target") == F.col("__p")).select("path", F.col("__t").alias("target"), (F.col("__t") != F.col("target")).alias("moved")), "wiki")
        moving = step.filter("moved").count()
        # every step brings some page of a chain home; if none came, what still moves goes round
        if moving in (0, left):
            way = step.select("path", F.when(F.col("moved"), F.col("path")).otherwise(F.col("target")).alias("target"))
            break
        left, way = moving, step.select("path", "target")
    text = links.select(F.col("path").alias("__p"), "value")
    nbt = links.filter("endswith(path, '/NBT')").select(F.regexp_replace("path", "/NBT$", "").alias("__n"), F.col("value").alias("__v"))
    out = way.join(text, F.col("target") == F.col("__p")).join(nbt, F.col("target") == F.col("__n"), "left")
    return out.select("path", "target", F.when(F.coalesce("value", F.lit("")) == "", F.coalesce("__v", "value")).otherwise(F.col("value")).alias("value"))


def page_categories(links: DataFrame, prefix: str = "分类:") -> DataFrame:
    """title, categories (array, in order of pos, without the prefix) of links(title, pos, category)."""
    name = F.when(F.startswith("category", F.lit(prefix)), F.expr(f"substring(category, {len(prefix) + 1})")).otherwise(F.col("category"))
    each = links.filter("category is not null").select("title", F.struct("pos", name.alias("c")).alias("s"))
    return each.groupBy("title").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["c"]).alias("categories"))


def wiki_links(c: Column) -> Column:
    """Array of (target, label) of [[target|label]] links."""
    p = r"\[\[(?:([^|\]\n]*)\|)?([^\]\n]*)\]\]"
    return F.transform(F.arrays_zip(F.regexp_extract_all(c, F.lit(p), F.lit(1)).alias("a"), F.regexp_extract_all(c, F.lit(p), F.lit(2)).alias("b")), lambda x: F.struct(F.coalesce(F.nullif(x["a"], F.lit("")), x["b"]).alias("target"), x["b"].alias("label")))
