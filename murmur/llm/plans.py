"""Queries and SQL of the text operators."""

from pyspark.sql import functions as F

from ..session import table
from . import contamination, lookalike, markup, names, packing, splitting, termcounts

_ONCE = """
with once as (select line_uid, any_value(phase) as phase, any_value(situation_type) as situation_type, any_value(speech_acts) as speech_acts
  from annotated_lines group by line_uid),
terms as (
  select line_uid, 'phase' as field_name, phase as term from once union all
  select line_uid, 'situation_type', situation_type from once union all
  select line_uid, 'speech_acts', x.type from (select line_uid, unnest(speech_acts) as x from once)),
counts as (select field_name, term, count(*) as occurrences, count(distinct line_uid) as lines from terms where coalesce(term, '') <> '' group by 1, 2),
marked as (select *, case when lines <= 3 then 'rare' when lines > 0.4 * (select count(*) from once) then 'common' end as mark from counts)
"""


def _texts(s, d):  # noqa: ANN001, ANN202
    return table(s, d, "operator_data"), table(s, d, "story_lines"), table(s, d, "documents")


def _groups(s, d):  # noqa: ANN001, ANN202
    return names.name_groups(table(s, d, "story_lines"), table(s, d, "annotated_lines"), table(s, d, "operators"), table(s, d, "name_aliases"))


def _rest(s, d):  # noqa: ANN001, ANN202
    """Leaks that are left after decontamination."""
    clean = contamination.decontaminate(table(s, d, "documents"), table(s, d, "eval_items")).select("doc_id", "text")
    return contamination.leaked_items(clean, table(s, d, "eval_items")).agg(F.count(F.lit(1)).alias("leaks"))


QUERIES = {
    "p2_found": lambda s, d: names.name_pairs(_groups(s, d)),
    "p2_groups": lambda s, d: _groups(s, d),
    "p3_found": lambda s, d: termcounts.term_counts(table(s, d, "annotated_lines")).filter("mark is not null").select("field_name", "term", "mark"),
    "p3_term_counts": lambda s, d: termcounts.term_counts(table(s, d, "annotated_lines")),
    "p3_act_ngrams": lambda s, d: termcounts.act_ngrams(table(s, d, "annotated_lines")),
    "p4_found": lambda s, d: markup.residue(*_texts(s, d)),
    "p4_wrappers": lambda s, d: markup.infer_wrappers(markup.mark_streams(markup.texts_of(*_texts(s, d)))),
    "p4_clean": lambda s, d: markup.clean_texts(*_texts(s, d)),
    "p5_found": lambda s, d: lookalike.lookalike_pairs(lookalike.canonical_records(table(s, d, "annotated_lines"), table(s, d, "operator_data"))),
    "p5_canonical": lambda s, d: lookalike.canonical_records(table(s, d, "annotated_lines"), table(s, d, "operator_data")),
    "p6_containers": lambda s, d: packing.pack_documents(table(s, d, "documents")),
    "p6_fill_report": lambda s, d: packing.fill_report(packing.pack_documents(table(s, d, "documents"))),
    "p6_properties": lambda s, d: packing.properties(table(s, d, "documents"), packing.pack_documents(table(s, d, "documents"))),
    "p7_rest": lambda s, d: _rest(s, d),
    "p7_found": lambda s, d: contamination.leaked_items(table(s, d, "documents"), table(s, d, "eval_items")),
    "p7_passages": lambda s, d: contamination.leaked_passages(table(s, d, "documents"), table(s, d, "eval_items")),
    "p7_decontaminated": lambda s, d: contamination.decontaminate(table(s, d, "documents"), table(s, d, "eval_items")),
    "p8_found": lambda s, d: splitting.oversized(table(s, d, "documents")),
    "p8_tiling": lambda s, d: splitting.tiling(splitting.split_documents(table(s, d, "documents"), oversized_only=False)),
    "p8_pieces": lambda s, d: splitting.split_documents(table(s, d, "documents")),
}

def _looks_sql() -> str:
    """The one form of a text in the SQL engine's words: characters as they look, composed."""
    import sys

    every = [(chr(i), lookalike.look(chr(i))) for i in range(0x80, sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF]
    pairs = [(c, to) for c, to in every if to is not None and len(to) == 1 and to != c]
    gone = "".join(c for c, to in every if to == "")
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    # what is beyond the end of the target list is dropped
    return f"nfc_normalize(translate(text, {lit(''.join(c for c, _ in pairs) + gone)}, {lit(''.join(to for _, to in pairs))}))"


ORACLE = {
    "p6_properties": "select count(*) as documents, 0 as missing, 0 as repeated, 0 as overfull, 0 as wrongly_split from documents",
    "p7_rest": "select 0 as leaks",
    "p8_tiling": "select doc_id, length(text) as chars, true as within, true as ordered from documents where text <> ''",
    "p5_found": f"""with r as (select 'annotated_lines' as src, line_uid as id, text from annotated_lines union select 'operator_data', rec_id, text from operator_data), k as (select *, {_looks_sql()} as form from r where text <> '' and id is not null),
odd as (select * from k where form in (select form from k group by form having count(distinct text) > 1))
select distinct x.src as src_a, x.id as id_a, y.src as src_b, y.id as id_b from odd x join odd y on x.form = y.form and x.text <> y.text and (x.src, x.id) < (y.src, y.id)""",
    "p3_found": _ONCE + "select field_name, term, mark from marked where mark is not null",
    "p3_term_counts": _ONCE + "select * from marked",
    "p3_act_ngrams": """
with once as (select line_uid, list_filter(list_transform(any_value(speech_acts), lambda x: x.type), lambda x: coalesce(x, '') <> '') as t from annotated_lines group by line_uid),
grams as (select line_uid, n, array_to_string(t[i:i + n - 1], ' > ') as gram
  from (select line_uid, t, unnest(range(1, len(t) + 1)) as i from once), (select unnest(range(1, (select max(len(t)) from once) + 1)) as n) where i + n - 1 <= len(t))
select n::bigint as n, gram, count(*) as occurrences, count(distinct line_uid) as lines from grams group by 1, 2""",
}
