"""Occurrence and record counts of all n-grams by a distributed suffix array with common-prefix intervals.

Every record is a short sequence of terms. Its suffixes (cut at max_n terms) are sorted inside the
record; neighbours of that order with a common prefix of h terms are duplicates for every n <= h, so
a record counts once for a prefix if those duplicate adjacencies are subtracted from its occurrences.
Equal suffixes of all records are added up first (map-side), so a term that stands in a third of all
rows is one row afterwards. The distinct suffixes are range-partitioned and sorted: a suffix array.
Each task walks its part and closes common-prefix intervals; an interval cut by a partition border
gives two partial sums, which one more aggregation adds up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RARE_LINES = 3
COMMON_SHARE = 0.4


def line_terms(lines: DataFrame) -> DataFrame:
    """One row for each line and field: field_name, terms. Lines are told apart by line_uid.

    Rows stored twice (same line_uid) are one line. A row without line_uid is a line of its own.
    NULL and '' are no terms; a NULL or empty speech_acts gives none.
    """
    acts = F.filter(F.transform("speech_acts", lambda a: a["type"]), lambda x: x.isNotNull() & (x != ""))
    one = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.array(c))
    slim = lines.select("line_uid", F.struct(one("phase").alias("phase"), one("situation_type").alias("situation_type"), F.when(F.size(acts) > 0, acts).alias("speech_acts")).alias("__t"))
    once = slim.filter("line_uid is not null").groupBy("line_uid").agg(F.first("__t").alias("__t")).select("__t").unionByName(slim.filter("line_uid is null").select("__t"))
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"__t.{f}").alias("terms")) for f in ("phase", "situation_type", "speech_acts")])
    return once.select(F.explode(pairs).alias("__p")).select("__p.field_name", "__p.terms")


#: Terms of a suffix where only single terms are asked for.
TERM_SUFFIX = 3


def ngram_counts(records: DataFrame, group: str, terms: str, max_n: int | None = None) -> DataFrame:
    """Counts of every n-gram of up to max_n terms (None: of any length): group, gram (array), occurrences, records.

    NULL or empty sequences count for nothing. NULL terms inside a sequence aren't allowed; filter them
    before. Equal records count as often as they come.
    """
    if max_n is None:  # the longest record, one number
        max_n = max(1, records.agg(F.max(F.size(terms))).first()[0] or 1)
    suffix = F.expr(f"transform(sequence(1, size({terms})), i -> slice({terms}, i, {max_n}))")
    rows = records.filter(F.col(terms).isNotNull() & (F.size(terms) > 0)).select(F.col(group).alias("g"), F.array_sort(suffix).alias("s"))
    # common prefix with the neighbour before it in the record's own order
    lcp = " + ".join(f"cast(k > 0 and size(x) >= {d} and slice(x, 1, {d}) = slice(s[greatest(k - 1, 0)], 1, {d}) as int)" for d in range(1, max_n + 1))
    each = rows.select("g", F.explode(F.expr(f"transform(s, (x, k) -> struct(x as suffix, {lcp} as lcp))")).alias("e")).select("g", "e.suffix", "e.lcp")
    dups = F.array(*[F.sum((F.col("lcp") >= d).cast("bigint")) for d in range(1, max_n + 1)])
    distinct = each.groupBy("g", "suffix").agg(F.count(F.lit(1)).alias("occ"), dups.alias("dups"))
    array = distinct.repartitionByRange("g", "suffix").sortWithinPartitions("g", "suffix")

    def intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prev_g, prev = None, []
        occ, rec = [0] * max_n, [0] * max_n
        out: list[tuple] = []
        first = True

        def close(depth: int) -> None:
            for d in range(len(prev), depth, -1):
                out.append((prev_g, prev[:d], occ[d - 1], rec[d - 1]))
                occ[d - 1] = rec[d - 1] = 0

        frame = lambda: pd.DataFrame(out, columns=["g", "gram", "occ", "rec"])
        for b in batches:
            for g, suffix, n, dup in zip(b["g"], b["suffix"], b["occ"], b["dups"], strict=True):
                cur = list(suffix)
                common = 0
                if not first and g == prev_g:
                    while common < min(len(cur), len(prev)) and cur[common] == prev[common]:
                        common += 1
                if not first:
                    close(common)
                for d in range(len(cur)):
                    occ[d] += int(n)
                    rec[d] += int(n) - int(dup[d])
                prev_g, prev, first = g, cur, False
            if len(out) > 5000:
                yield frame()
                out.clear()
        if not first:
            close(0)
        yield frame()

    parts = array.mapInPandas(intervals, "g string, gram array<string>, occ bigint, rec bigint")
    return parts.groupBy("g", "gram").agg(F.sum("occ").alias("occurrences"), F.sum("rec").alias("records")).select(F.col("g").alias(group), "gram", "occurrences", "records")


def mark_of(records: Column, total: Column, rare: int = RARE_LINES, common: float = COMMON_SHARE) -> Column:
    return F.when(records <= rare, "rare").when(records > common * total, "common")


def term_counts(lines: DataFrame, rare: int = RARE_LINES, common: float = COMMON_SHARE) -> DataFrame:
    """Every term of phase, situation_type and speech_acts: field_name, term, occurrences, lines, mark.

    mark is rare, common or NULL. An empty table gives no rows. Terms are the intervals of depth one in the array of all
    suffixes, which are cut at TERM_SUFFIX terms since nothing deeper is asked for.
    """
    grams = ngram_counts(line_terms(lines), "field_name", "terms", TERM_SUFFIX).filter(F.size("gram") == 1)
    total = lines.agg((F.countDistinct("line_uid") + F.count_if(F.col("line_uid").isNull())).alias("__total"))
    return grams.crossJoin(F.broadcast(total)).select("field_name", F.col("gram")[0].alias("term"), "occurrences", F.col("records").alias("lines"), mark_of(F.col("records"), F.col("__total"), rare, common).alias("mark"))


def act_ngrams(lines: DataFrame, max_n: int | None = None) -> DataFrame:
    """All n-grams of the speech-act types in stored order: n, gram (joined by ' > '), occurrences, lines."""
    acts = line_terms(lines).filter("field_name = 'speech_acts'")
    return ngram_counts(acts, "field_name", "terms", max_n).select(F.size("gram").cast("bigint").alias("n"), F.array_join("gram", " > ").alias("gram"), "occurrences", F.col("records").alias("lines"))
