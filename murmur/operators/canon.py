"""Claims from several sources: extraction, known errors, cross validation, reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


def _claim(rule: int, field: str, label: str):  # noqa: ANN202
    return lambda x, k: F.struct(F.lit(rule).alias("rule"), k.alias("k"), F.lit(field).alias("field"), F.lit(label).alias("label"), T.strip(x["v"]).alias("value"), x["whole"].alias("whole"))


def claims(texts: DataFrame, source: str, patterns: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """source, field, label, value, context: what each text states by the patterns (field, label, pattern with one group).

    A value of a field comes once a source, the first time; values of 50 characters and more are none. The
    context reaches 30 characters to both sides.
    """
    rows = []
    for i, (field, label, p) in enumerate(R.CLAIMS if patterns is None else patterns):
        pat = F.lit(f"(?d){p}")
        pairs = F.arrays_zip(F.regexp_extract_all("text", pat, F.lit(0)).alias("whole"), F.regexp_extract_all("text", pat, F.lit(1)).alias("v"))
        rows.append(F.transform(pairs, _claim(i, field, label)))
    found = texts.select(F.col(source).cast("string").alias("source"), "text", F.explode(F.filter(F.flatten(F.array(*rows)), lambda x: (x["value"] != "") & (F.length(x["value"]) < 50))).alias("c")).select("source", "text", "c.*")
    # the context is cut out before the rows are shuffled, so that no text is shuffled once a claim
    context = T.strip(T.around(F.col("text"), F.expr("instr(text, whole)"), F.length("whole"), 30))
    short = found.select("source", "rule", "k", "field", "label", "value", context.alias("context"))
    first = short.withColumn("__n", F.row_number().over(Window.partitionBy("source", "field", "value").orderBy("rule", "k"))).filter("__n = 1")
    return first.select("source", "field", "label", "value", "context")


def misconceptions(texts: DataFrame, source: str, known: list | None = None) -> DataFrame:
    """source, id, pattern, matched, wrong, correct for the first match of each pattern, unless the text corrects it.

    A correcting pattern within 200 characters vetoes the match and the later patterns of the same id; a correcting
    word within 40 characters vetoes the match.
    """
    out = []
    for mid, wrong, correct, patterns, excludes in R.MISCONCEPTIONS if known is None else known:
        vetoed = F.lit(False)
        for p in patterns:
            pat = f"(?d){p}"
            whole = F.regexp_substr("text", F.lit(pat))
            at, size = F.regexp_instr("text", F.lit(pat)), F.length(whole)
            near = T.around(F.col("text"), at, size, 200)
            excluded = F.lit(False)
            for e in excludes:
                excluded = excluded | F.rlike(near, F.lit(f"(?d){e}"))
            vetoed = vetoed | (whole.isNotNull() & excluded)
            corrected = T.contains_any(T.around(F.col("text"), at, size, 40), R.words(R.CORRECTING))
            out.append(F.when(whole.isNotNull() & ~vetoed & ~corrected, F.struct(F.lit(mid).alias("id"), F.lit(p).alias("pattern"), whole.alias("matched"), F.lit(wrong).alias("wrong"), F.lit(correct).alias("correct"))))
    return texts.select(F.col(source).cast("string").alias("source"), F.explode(F.array_compact(F.array(*out))).alias("m")).select("source", "m.*")


def normal_value(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit("（"), F.lit("(")), F.lit("）"), F.lit(")"))


def cross_validate(found: DataFrame, keys: tuple[str, ...] = ("field",)) -> DataFrame:
    """keys, status, versions (normalised values), claims, distinct_sources, confidence.

    One value: confirmed, or unverified if claimed once; several: conflicted. NULL values claim nothing.
    """
    v = found.filter("value is not null").withColumn("__v", normal_value(F.col("value")))
    g = v.groupBy(*keys).agg(F.count_distinct("__v").alias("versions"), F.count(F.lit(1)).alias("claims"), F.count_distinct("source").alias("distinct_sources"))
    status = F.when(F.col("versions") > 1, "conflicted").when(F.col("claims") == 1, "unverified").otherwise("confirmed")
    return g.withColumns({"status": status, "confidence": F.when(F.col("versions") > 1, "low").when(F.col("claims") >= 2, "high").otherwise("medium")})


def versions(found: DataFrame, keys: tuple[str, ...] = ("field",)) -> DataFrame:
    """keys, value (normalised), source_count of every version of every claim."""
    return found.filter("value is not null").groupBy(*keys, normal_value(F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("source_count"))


def summary(validated: DataFrame) -> DataFrame:
    """status, n."""
    return validated.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def reliability(source: Column) -> Column:
    """First known kind of source in the label; medium."""
    return T.first_match(F.lower(F.coalesce(source, F.lit(""))), R.RELIABILITY, "medium")


def record_claims(records: DataFrame, columns: list[str], entity: str, source: str) -> DataFrame:
    """entity, field, value, source of the filled columns of a record table."""
    items = F.array(*[F.struct(F.lit(c).alias("field"), F.nullif(F.col(c), F.lit("")).alias("value")) for c in columns])
    return records.select(F.col(entity).alias("entity"), F.col(source).alias("source"), F.explode(items).alias("c")).select("entity", "source", "c.*").filter("value is not null")


def merge_rules(builtin: DataFrame, custom: DataFrame, key: str) -> DataFrame:
    """Builtin rows overridden by custom rows of the same key, then the custom rows that are new. ord tells the order."""
    cols = [c for c in builtin.columns if c not in (key, "ord")]
    b, c = builtin.alias("b"), custom.alias("c")
    top = builtin.agg((F.coalesce(F.max("ord"), F.lit(-1)) + 1).alias("__top"))
    j = b.join(c, F.col(f"b.{key}") == F.col(f"c.{key}"), "full").crossJoin(F.broadcast(top))
    return j.select(F.coalesce(f"b.{key}", f"c.{key}").alias(key), *[F.coalesce(f"c.{x}", f"b.{x}").alias(x) for x in cols], F.coalesce("b.ord", F.col("__top") + F.col("c.ord")).alias("ord"))
