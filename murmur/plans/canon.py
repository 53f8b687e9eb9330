"""Queries of claims and their SQL."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import canon as C
from ..session import table

_COLS = ["race", "faction", "birthplace", "gender"]
#: Claims that the test texts state.
DOC_CLAIMS = [("post", "职务", r"【职务】([^。，【\n]{1,20})"), ("base", "驻地", r"【驻地】([^。，【\n]{1,20})"), ("number", "编号", r"编号(\d+)")]
_claims = lambda s, d: C.record_claims(table(s, d, "operators"), _COLS, "page_type", "slug")
_REC = "c as (" + " union all ".join(f"select page_type as entity, slug as source, '{c}' as field, nullif({c}, '') as value from operators where nullif({c}, '') is not null" for c in _COLS) + ")"
_NORM = "replace(replace(replace(value, ' ', ''), '（', '('), '）', ')')"
_claims_sql = lambda rules: " union all ".join(f"select doc_id, text, {i} as rule, '{f}' as field, '{lab}' as label, unnest(regexp_extract_all(text, '{p}', 1)) as v, unnest(regexp_extract_all(text, '{p}', 0)) as whole, unnest(range(0, len(regexp_extract_all(text, '{p}', 0)))) as k from documents" for i, (f, lab, p) in enumerate(rules))
_REL = "case " + " ".join(f"when contains(lower(coalesce(source, '')), '{k}') then '{v}'" for k, v in R.RELIABILITY) + " else 'medium' end"
_CROSS = f"select entity, field, count(distinct {_NORM}) as versions, count(*) as claims, count(distinct source) as distinct_sources, case when count(distinct {_NORM}) > 1 then 'conflicted' when count(*) = 1 then 'unverified' else 'confirmed' end as status, case when count(distinct {_NORM}) > 1 then 'low' when count(*) >= 2 then 'high' else 'medium' end as confidence from c group by all"



def _first_claims(rules: list[tuple[str, str, str]]) -> str:
    return f"with m as ({_claims_sql(rules)}), f as (select *, trim(v, E' \\t\\r\\n　') as value from m), g as (select *, row_number() over (partition by doc_id, field, value order by rule, k) as n, instr(text, whole) as p from f where trim(v, E' \\t\\r\\n　') <> '' and length(v) < 50) select doc_id::varchar as source, field, label, value, trim(substr(text, greatest(1, p - 30), p - greatest(1, p - 30) + length(whole) + 30), E' \\t\\r\\n　') as context from g where n = 1"


#: Claims about people and ships that the test texts state, in the form of the rule pack's.
WORLD_CLAIMS = [("origin", "出身", r"出身([^，。\n]{2,12})，"), ("trade", "职业", r"早年做过([^。，\n]{2,8})"), ("post", "职务", r"【职务】([^。，【\n]{1,20})"), ("sight", "视力", r"视力(\d+)"), ("crew", "人数", r"共(\d+)名")]
#: Errors that the test texts make and correct: id, wrong, correct, patterns, patterns of texts that correct it.
WORLD_ERRORS = [
    ("W001", "塔灯一直亮着", "塔灯曾经熄灭", [r"点燃塔灯", r"塔灯.{0,6}亮"], [r"塔灯熄灭"]),
    ("W002", "雾海没有走私船", "走私船到处都是", [r"追踪走.{0,2}私船", r"走私船[^。]*到处"], [r"推测有误", r"迫使对方撤回"]),
    ("W003", "众人都在矿井", "众人在各处", [r"众人正在[^。]*矿石"], []),
]
_NEAR = lambda n: f"substr(text, greatest(1, p - {n}), p - greatest(1, p - {n}) + length(whole) + {n})"


def _errors_sql() -> str:
    rows, k = [], 0
    for mid, wrong, correct, patterns, excludes in WORLD_ERRORS:
        for p in patterns:
            ex = " or ".join(f"regexp_matches({_NEAR(200)}, '{e}')" for e in excludes) or "false"
            fix = " or ".join(f"contains({_NEAR(40)}, '{w}')" for w in R.CORRECTING)
            rows.append(f"select doc_id, '{mid}' as id, {k} as k, '{p}' as pattern, whole as matched, '{wrong}' as wrong, '{correct}' as correct, ({ex}) as veto, ({fix}) as fixed from (select doc_id, text, regexp_extract(text, '{p}') as whole, instr(text, regexp_extract(text, '{p}')) as p from documents where regexp_matches(text, '{p}'))")
            k += 1
    return f"with m as ({' union all '.join(rows)}) select doc_id::varchar as source, id, pattern, matched, wrong, correct from m where not fixed and not exists (select 1 from m v where v.doc_id = m.doc_id and v.id = m.id and v.k <= m.k and v.veto)"


QUERIES = {
    "canon_claims": lambda s, d: C.claims(table(s, d, "documents"), "doc_id", WORLD_CLAIMS),
    "claim_rules": lambda s, d: _rules(s).select("id", "pattern", "ord"),
    "doc_claims": lambda s, d: C.claims(table(s, d, "documents"), "doc_id", DOC_CLAIMS),
    "misconception_check": lambda s, d: C.misconceptions(table(s, d, "documents"), "doc_id", WORLD_ERRORS),
    "canon_check": lambda s, d: C.cross_validate(C.claims(table(s, d, "documents"), "doc_id", WORLD_CLAIMS)),
    "cross_validate_claims": lambda s, d: C.cross_validate(_claims(s, d), ("entity", "field")),
    "claim_versions": lambda s, d: C.versions(_claims(s, d), ("entity", "field")),
    "canon_summary": lambda s, d: C.summary(C.cross_validate(_claims(s, d), ("entity", "field"))),
    "source_reliability": lambda s, d: table(s, d, "documents").select("doc_id", C.reliability(F.col("source")).alias("reliability")),
}
def _rules(s):  # noqa: ANN001, ANN202
    """The built-in errors with one of them overridden and one new."""
    mine = [("W002", "走私船.*海", 0), ("W009", "第九", 1)]
    return C.merge_rules(s.createDataFrame([(r[0], "|".join(r[3]), i) for i, r in enumerate(WORLD_ERRORS)], "id string, pattern string, ord int"), s.createDataFrame(mine, "id string, pattern string, ord int"), "id")


ORACLE = {
    "canon_claims": _first_claims(WORLD_CLAIMS),
    "claim_rules": "select * from (values ('W001', '点燃塔灯|塔灯.{0,6}亮', 0), ('W002', '走私船.*海', 1), ('W003', '众人正在[^。]*矿石', 2), ('W009', '第九', 4)) as t(id, pattern, ord)",
    "misconception_check": _errors_sql(),
    "canon_check": f"with c as (select * from ({_first_claims(WORLD_CLAIMS)})) select field, count(distinct {_NORM}) as versions, count(*) as claims, count(distinct source) as distinct_sources, case when count(distinct {_NORM}) > 1 then 'conflicted' when count(*) = 1 then 'unverified' else 'confirmed' end as status, case when count(distinct {_NORM}) > 1 then 'low' when count(*) >= 2 then 'high' else 'medium' end as confidence from c group by all",
    "doc_claims": _first_claims(DOC_CLAIMS),
    "cross_validate_claims": f"with {_REC} {_CROSS}",
    "claim_versions": f"with {_REC} select entity, field, {_NORM} as value, count(*) as source_count from c group by all",
    "canon_summary": f"with {_REC} select status, count(*) as n from ({_CROSS}) group by 1",
    "source_reliability": f"select doc_id, {_REL} as reliability from documents",
}
