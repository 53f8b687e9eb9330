"""Queries of style fingerprints and their SQL."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import fingerprint as P
from ..session import materialize, table


def _list(s: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in s) + "]"


def _any(s: list[str], c: str = "text") -> str:
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in s) + ")"


def _count(s: list[str], c: str = "text") -> str:
    return "(" + " + ".join(f"((length({c}) - length(replace({c}, '{w}', ''))) // {len(w)})" for w in s) + ")"


_FLAGS = "ellipsis ellipsis_start dash exclamation question rhetorical metaphor parallelism negation honorific intimate".split()
_ASK = "(contains(text, '？') or contains(text, '?'))"
#: The features of a line, as SQL.
FEATURES = f"""
f as (select *, [length(x) for x in [trim(y, E' \\t\\r\\n　') for y in regexp_split_to_array(text, '{R.SENTENCE_END}')] if x <> ''] as lens,
  [left(x, 2) for x in [trim(y, E' \\t\\r\\n　') for y in regexp_split_to_array(text, '[，、；]')] if length(x) >= 2] as starts from base),
feats as (select *, len(lens) as n_sentences, len([x for x in lens if x <= 5]) as n_short, len([x for x in lens if x > 5 and x <= 15]) as n_medium, len([x for x in lens if x > 15]) as n_long,
  coalesce(list_sum(lens), 0) as sentence_chars, list_min(lens) as min_len, list_max(lens) as max_len,
  contains(text, '…') or contains(text, '...') as ellipsis, starts_with(text, '…') or starts_with(text, '...') as ellipsis_start, contains(text, '—') as dash,
  contains(text, '！') or contains(text, '!') as exclamation, {_ASK} as question, {_ASK} and {_any(R.RHETORICAL)} as rhetorical, {_any(R.METAPHOR)} as metaphor,
  len(regexp_split_to_array(text, '[，、；]')) >= 3 and len([x for x in list_distinct(starts) if len(list_filter(starts, lambda q: q = x)) >= 3]) > 0 as parallelism,
  regexp_matches(text, '{R.NEGATION}') as negation, regexp_matches(text, '{R.NEGATION_SHORT}') as negation_short,
  {_any(R.HONORIFIC)} as honorific, {_any(R.INTIMATE)} as intimate, {", ".join(f"{_count([w])} as self_{i}" for i, w in enumerate(R.words(R.FIRST_PERSON)))}, {", ".join(f"{_count(w)} as nature_{i}" for i, w in enumerate(R.NATURE.values()))}, {_count(R.FIRST_PERSON)} as self_refs, {" + ".join(_count(w) for w in R.NATURE.values())} as nature_words,
  {", ".join(f"{_count(w)} as emotion_{i}" for i, w in enumerate(R.EMOTIONS.values()))} from f)"""

_E, _S, _N = ([f"{k}_{i}" for i in range(n)] for k, n in (("emotion", len(R.EMOTIONS)), ("self", len(R.words(R.FIRST_PERSON))), ("nature", len(R.NATURE))))
_SUMS = (
    "count(*) as lines, "
    + ", ".join(f"coalesce(sum({c}), 0)::bigint as {c}" for c in ["n_sentences", "n_short", "n_medium", "n_long", "sentence_chars", "self_refs", "nature_words", *_E, *_S, *_N])
    + ", min(min_len) as min_len, max(max_len) as max_len, "
    + ", ".join(f"coalesce(sum({c}::int), 0)::bigint as {c}_n" for c in _FLAGS)
)


def _best(cols: list[str], names: list[str], none: str) -> str:
    top = f"greatest({', '.join(cols)})"
    return f"case when {top} = 0 then '{none}' " + " ".join(f"when {c} = {top} then '{n}'" for c, n in zip(cols, names, strict=True)) + " end"


def _traits(rules: list[tuple[str, str]], none: str) -> str:
    return "case when lines > 0 then coalesce(nullif(concat_ws('；', " + ", ".join(f"case when {c} then '{t}' end" for c, t in rules) + f"), ''), '{none}') end"


_FINISH = f"""
fin as (select *, round_even(sentence_chars / nullif(n_sentences, 0), 1) as avg_length, round_even(n_short / nullif(n_sentences, 0) * 100, 1) as short_pct,
  round_even(n_medium / nullif(n_sentences, 0) * 100, 1) as medium_pct, round_even(n_long / nullif(n_sentences, 0) * 100, 1) as long_pct, {", ".join(f"round_even({c}_n / nullif(lines, 0) * 100, 1) as {c}_pct" for c in _FLAGS)},
  round_even(self_refs / nullif(lines, 0), 2) as self_ref_freq, round_even(nature_words / nullif(lines, 0), 2) as nature_density,
  {_best(_S, R.words(R.FIRST_PERSON), "省略自称")} as self_primary, {_best(_N, list(R.NATURE), "无")} as nature_top, {_best(_E, list(R.EMOTIONS), "unknown")} as emotion_dominant, {" + ".join(f"({c} >= 2)::int" for c in _E)} as emotion_active from agg),
typed as (select *, case when n_sentences = 0 then 'unknown' when short_pct > 50 then '短句型' when long_pct > 40 then '长句型' when short_pct > 25 and long_pct > 25 then '长短交替型' else '中句型' end as sentence_type,
  case when emotion_active >= 5 then '宽谱' when emotion_active >= 3 then '中谱' else '窄谱' end as emotion_breadth,
  case when lines = 0 then 'unknown' when honorific_n > intimate_n * 2 then '尊称型' when intimate_n > honorific_n * 2 then '亲昵型' when honorific_n > 0 and intimate_n > 0 then '切换型' else '省略称呼型' end as address_type,
  {_traits([("rhetorical_n > 0.1 * lines", "善用反问引导思考"), ("metaphor_n > 0.1 * lines", "偏好意象化表达"), ("negation_n > 0.4 * lines", "频繁使用否定句式，倾向从反面界定"), ("negation_n < 0.1 * lines", "极少使用否定句，表达积极正向")], "修辞风格平实直白")} as rhetoric_traits,
  {_traits([("ellipsis_n > 0.3 * lines", "频繁停顿，善于沉默"), ("ellipsis_start_n > 0.15 * lines", "常以沉默开头，话语经过深思熟虑"), ("exclamation_n < 0.05 * lines", "几乎不用感叹号，语气极度克制"), ("exclamation_n > 0.3 * lines", "常用感叹号，表达直接热烈")], "语气平稳，无明显极端标记")} as pause_traits,
  case when self_refs = 0 then '极少使用第一人称，倾向省略主语或使用''我们''' when self_ref_freq < 0.3 then '极少自称，倾向省略主语' when self_primary = '我' then '常用''我''，表达直接' when self_primary in ('吾', '本王', '朕') then '使用''' || self_primary || '''自称，体现特殊身份地位' else '自称''' || self_primary || '''，有独特表达习惯' end as self_reading,
  case when nature_words = 0 then 'none' when nature_density > 3 then '高频' when nature_density > 1 then '中频' else '低频' end as nature_level from fin),
final as (select *, case when emotion_dominant = 'unknown' then '未检测到明显情感词汇' else '主导情感为''' || emotion_dominant || '''，情感谱系' || emotion_breadth || '（活跃情感' || emotion_active || '种）' end as emotion_reading,
  case when nature_words = 0 then '极少使用自然意象' else '自然意象密度' || nature_level || '（' || nature_density || '个/句），偏好' || nature_top || '意象' end as nature_reading,
  concat_ws('；', '句式' || sentence_type || '，平均' || coalesce(avg_length::varchar, '0') || '字', pause_traits, self_reading, emotion_reading, rhetoric_traits, nature_reading) as summary from typed)"""
_BLANK = r"trim(coalesce(text, ''), E' \t\r\n　')"
_SLICES = (
    f"with base as (select * from annotated_lines where coalesce(source, '') <> 'archive'), {FEATURES}, keyed as (select *, coalesce(nullif(situation_type, ''), 'unknown') as a, coalesce(nullif(interlocutor, ''), 'unknown') as b, coalesce(nullif(phase, ''), 'unknown') as c from feats), "
    "long as (select *, 'global' as slice_dim, '' as slice_value from keyed union all select *, 'situation_type', a from keyed union all select *, 'interlocutor', b from keyed union all select *, 'phase', c from keyed), "
    "raw as (select slice_dim, slice_value, count(*) as raw_lines from long group by 1, 2), "
    f"sums as (select slice_dim, slice_value, {_SUMS} from long where {_BLANK} <> '' group by 1, 2), "
    "agg as (select sums.*, raw_lines from raw join sums using (slice_dim, slice_value) where (slice_dim = 'global' or raw_lines >= 2) and not (slice_dim = 'phase' and slice_value = 'unknown')), " + _FINISH
)

_SHIFTS = """, g as (select avg_length as ga, ellipsis_pct as ge, emotion_dominant as gd, negation_pct as gn from final where slice_dim = 'global'),
s as (select * from final, g where slice_dim <> 'global')
select slice_dim, slice_value, 'sentence_length' as dimension, case when avg_length < ga then '偏短' else '偏长' end as shift, round_even(abs(avg_length - ga) / ga, 2) as magnitude from s where ga > 0 and abs(coalesce(avg_length, 0) - ga) / ga > 0.3
union all select slice_dim, slice_value, 'ellipsis', case when ge = 0 then '出现沉默标记（全局无）' when ellipsis_pct > ge then '更多沉默' else '更少沉默' end, case when ge = 0 then round_even(ellipsis_pct / 100, 2) else round_even(abs(ellipsis_pct - ge) / ge, 2) end from s where (ge > 0 and abs(ellipsis_pct - ge) / ge > 0.4) or (ge = 0 and ellipsis_pct > 20)
union all select slice_dim, slice_value, 'emotion_dominant', '从''' || gd || '''偏移到''' || emotion_dominant || '''', null from s where gd <> emotion_dominant
union all select slice_dim, slice_value, 'negation', case when gn = 0 then '出现否定表达（全局无）' when negation_pct > gn then '更多否定' else '更少否定' end, case when gn = 0 then round_even(negation_pct / 100, 2) else round_even(abs(negation_pct - gn) / gn, 2) end from s where (gn > 0 and abs(negation_pct - gn) / gn > 0.4) or (gn = 0 and negation_pct > 20)"""


def _lex_sql(lexicon: dict[str, list[str]], by: str = "") -> str:
    values = ", ".join(f"('{c}', '{w}')" for c, ws in lexicon.items() for w in ws)
    key = f"{by}, " if by else ""
    return f"select {key}category, word, sum((length(text) - length(replace(text, word, ''))) // length(word))::bigint as n, min(pos) as first_pos from annotated_lines, (values {values}) as w(category, word) where contains(text, word) group by all"


_lines = lambda s, d: table(s, d, "annotated_lines")
#: Titles by which the test texts address people, beside the rule pack's.
TITLES = ["船医", "书记官", "领航员"]

QUERIES = {
    "fingerprint_wide": lambda s, d: P.fingerprint(P.spoken(_lines(s, d))),
    "fingerprint_by_source": lambda s, d: P.fingerprint(P.spoken(_lines(s, d), "voice")),
    "source_fingerprints": lambda s, d: P.source_fingerprints(_lines(s, d)),
    "fingerprint_slices": lambda s, d: P.contextual_fingerprint(_lines(s, d)),
    "fingerprint_shifts": lambda s, d: P.shifts(materialize(P.contextual_fingerprint(_lines(s, d)).select("slice_dim", "slice_value", *P.SHIFTING), "slices")).select("slice_dim", "slice_value", "dimension", "shift", "magnitude"),
    "sentence_length_by_source": lambda s, d: P.line_features(_lines(s, d)).groupBy("source").agg(F.sum("n_sentences").alias("n_sentences"), F.bround(F.sum("sentence_chars") / F.sum("n_sentences"), 1).alias("avg_length"), F.min("min_len").cast("bigint").alias("min_len"), F.max("max_len").cast("bigint").alias("max_len")),
    "pause_markers_by_source": lambda s, d: P.line_features(_lines(s, d)).groupBy("source").agg(*[T.pct(F.col(c)).alias(f"{c}_pct") for c in _FLAGS[:5]]),
    "pronoun_counts": lambda s, d: P.pronouns(_lines(s, d)),
    "lexicon_spectrum": lambda s, d: P.lexicon_counts(_lines(s, d), R.EMOTIONS, "source"),
    "imagery_words": lambda s, d: P.lexicon_counts(_lines(s, d), R.NATURE),
    "imagery_top_words": lambda s, d: P.lexicon_counts(_lines(s, d), R.NATURE).orderBy(F.desc("n"), "first_pos", "word").limit(5),
    "rhetoric_rates": lambda s, d: P.line_features(_lines(s, d)).groupBy(T.missing("phase").alias("phase")).agg(*[T.pct(F.col(c)).alias(f"{c}_pct") for c in ("rhetorical", "metaphor", "parallelism", "negation")]),
    "address_pattern": lambda s, d: P.line_features(_lines(s, d)).groupBy(T.missing("situation_type").alias("situation_type")).agg(F.count_if("honorific").alias("honorific"), F.count_if("intimate").alias("intimate")),
    "address_examples": lambda s, d: P.first_examples(_lines(s, d), T.contains_any("text", [*R.words(R.HONORIFIC), *TITLES])),
}

_BASE = f"with base as (select * from annotated_lines), {FEATURES} "
ORACLE = {
    "fingerprint_wide": f"with base as (select * from annotated_lines where coalesce(source, '') <> 'archive' and {_BLANK} <> ''), {FEATURES}, agg as (select {_SUMS} from feats), {_FINISH} select * from final",
    "fingerprint_by_source": f"with base as (select * from annotated_lines where source = 'voice' and {_BLANK} <> ''), {FEATURES}, agg as (select {_SUMS} from feats), {_FINISH} select * from final",
    "source_fingerprints": f"with base as (select * from annotated_lines where coalesce(source, '') <> 'archive' and {_BLANK} <> ''), {FEATURES}, agg as (select coalesce(nullif(source, ''), 'unknown') as source, {_SUMS} from feats group by 1), {_FINISH} select * from final",
    "fingerprint_slices": _SLICES + " select * from final",
    "fingerprint_shifts": _SLICES + _SHIFTS,
    "sentence_length_by_source": _BASE + "select source, sum(n_sentences)::bigint as n_sentences, round_even(sum(sentence_chars) / sum(n_sentences), 1) as avg_length, min(min_len) as min_len, max(max_len) as max_len from feats group by 1",
    "pause_markers_by_source": _BASE + "select source, " + ", ".join(f"round_even(avg(coalesce({c}::int, 0)) * 100, 1) as {c}_pct" for c in _FLAGS[:5]) + " from feats group by 1",
    "pronoun_counts": f"with c as (select w as pronoun, o, (select coalesce(sum((length(text) - length(replace(text, w, ''))) // length(w)), 0)::bigint from annotated_lines) as n from (select unnest({_list(R.FIRST_PERSON)}) as w, generate_subscripts({_list(R.FIRST_PERSON)}, 1) as o)) select pronoun, n, round_even(n / (select sum(n) from c) * 100, 1) as share_pct, o = (select o from c order by n desc, o limit 1) as is_primary from c where n > 0",
    "lexicon_spectrum": _lex_sql(R.EMOTIONS, "source"),
    "imagery_words": _lex_sql(R.NATURE),
    "imagery_top_words": _lex_sql(R.NATURE) + " order by n desc, first_pos, word limit 5",
    "rhetoric_rates": _BASE + "select coalesce(nullif(phase, ''), 'unknown') as phase, " + ", ".join(f"round_even(avg(coalesce({c}::int, 0)) * 100, 1) as {c}_pct" for c in ("rhetorical", "metaphor", "parallelism", "negation")) + " from feats group by 1",
    "address_pattern": _BASE + "select coalesce(nullif(situation_type, ''), 'unknown') as situation_type, count(*) filter (where honorific) as honorific, count(*) filter (where intimate) as intimate from feats group by 1",
    "address_examples": f"select row_number() over (order by pos, line_uid) as k, left(text, 50) as example from (select * from annotated_lines where {_any([*R.words(R.HONORIFIC), *TITLES])} order by pos, line_uid limit 5)",
}
