"""Queries of the catalogue and their SQL."""

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..session import table

_DEFAULTS = {"name_en": "unknown", "faction": "none", "race": "unknown", "birthday": "-"}
#: Versions as records carry them: bare, with and without a minor, past 9, and none.
_FORMS = ["v1", "v2", "1.0", "v1.9", "v1.10", "2", "draft", "v2.3", " v1.2 "]
_made = lambda s, d: table(s, d, "operators").select("slug", "faction", "race", F.get(F.array(*[F.lit(v) for v in [*_FORMS, None]]), F.length("slug") % (len(_FORMS) + 1)).alias("version"))
_STORED = "made as (select slug, faction, race, ([" + ", ".join(f"'{v}'" for v in _FORMS) + f", null])[length(slug) % {len(_FORMS) + 1} + 1] as version from operators)"

QUERIES = {
    "catalog_defaults": lambda s, d: C.listing(table(s, d, "operators"), _DEFAULTS),
    "next_version": lambda s, d: C.next_version(_made(s, d), "faction"),
    "normal_version": lambda s, d: _made(s, d).select("slug", C.normal_version(F.col("version")).alias("version")),
    "latest_version": lambda s, d: C.latest(_made(s, d).filter(r"version rlike '^v\\d' and race is not null").groupBy("race", "version").agg(F.min("slug").alias("slug")), "race"),
    "scaffold_catalog": lambda s, d: C.scaffold(table(s, d, "operators").select("slug", F.col("name_zh").alias("name"), "name_en"), F.lit("2025-01-02 03:04:05").cast("timestamp")).select("slug", "name", "name_en", "created_at", "version", "profile.faction", "corrections_count"),
    "missing_files": lambda s, d: C.missing_files(table(s, d, "operators").select("slug", F.explode(F.expr("case when lang is null then array('persona.md') when lang <> 'zh' or faction is null then array('SKILL.md', 'persona.md') else array('SKILL.md', 'meta.json') end")).alias("file"))),
    "version_list": lambda s, d: C.version_list(_made(s, d).filter("faction is not null"), "faction"),
}
ORACLE = {
    "catalog_defaults": "select slug, " + ", ".join(f"coalesce(nullif({c}, ''), '{v}') as {c}" for c, v in _DEFAULTS.items()) + " from operators where slug is not null and not starts_with(slug, '.') and slug <> 'versions'",
    "next_version": rf"with {_STORED}, p as (select faction, case when regexp_matches(version, '^v\d+\.\d+$') then regexp_extract(version, '^v(\d+)', 1)::int * 1000 + regexp_extract(version, '(\d+)$', 1)::int when regexp_matches(version, '^v\d+$') then 1000 + version[2:]::int end as n from made) select faction, case when max(n) is null then 'v1.0' else 'v' || greatest(max(n) // 1000, 1) || '.' || (max(n) % 1000 + 1) end as next from p group by 1",
    "normal_version": rf"with {_STORED} select slug, case when regexp_matches(v, '^\d+\.\d+$') then 'v' || v when regexp_matches(v, '^\d+$') then 'v' || v || '.0' else 'v' || v end as version from (select slug, regexp_replace(trim(version), '^v', '') as v from made)",
    "latest_version": rf"with {_STORED}, g as (select race, version, min(slug) as slug from made where version like 'v%' and race is not null group by 1, 2), n as (select *, regexp_extract(version, 'v(\d+)', 1)::int as a, coalesce(nullif(regexp_extract(version, '\.(\d+)$', 1), '')::int, 0) as b from g) select race, version, slug from n qualify row_number() over (partition by race order by a desc, b desc) = 1",
    "version_list": f"with {_STORED} select faction, list_sort(list_distinct(list(version))) as versions from made where version like 'v%' and faction is not null group by 1",
    "scaffold_catalog": "select slug, name_zh as name, coalesce(name_en, '') as name_en, '2025-01-02T03:04:05.000000' as created_at, 'v1.0' as version, 'unknown' as faction, 0 as corrections_count from operators",
    "missing_files": "select slug, case when lang is null then ['SKILL.md', 'meta.json'] else ['meta.json'] end as missing from operators where lang is null or lang <> 'zh' or faction is null",
}
