"""Speech acts: rule classification, profiles by slice and behaviour patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T

_DIMS = ("situation_type", "interlocutor", "phase")


def acts_of(text: Column) -> Column:
    """Array of (type, label, confidence): the surest rule of each type, in the order of the winning rules. NULL text: none."""
    per_type = []
    for kind, label in R.ACT_LABELS.items():
        rules = [(i, c, p) for i, (k, c, p) in enumerate(R.ACT_RULES) if k == kind]
        rules.sort(key=lambda r: (-r[1], r[0]))
        best = None
        for i, c, p in rules:
            s = F.struct(F.lit(i).alias("ord"), F.lit(kind).alias("type"), F.lit(label).alias("label"), F.lit(c).alias("confidence"))
            hit = F.rlike(text, F.lit(f"(?d){p}"))
            best = F.when(hit, s) if best is None else best.when(hit, s)
        per_type.append(best)
    found = F.array_sort(F.filter(F.array(*per_type), lambda x: x.isNotNull()))
    return F.transform(found, lambda x: F.struct(x["type"].alias("type"), x["label"].alias("label"), x["confidence"].alias("confidence")))


def classify(lines: DataFrame, out: str = "speech_acts") -> DataFrame:
    """lines with its speech acts; a column of that name is replaced."""
    return lines.withColumn(out, acts_of(F.col("text")))


def acts(lines: DataFrame) -> DataFrame:
    """One row for each act of each line that isn't an archive's: the slice keys ('unknown' for none) and act."""
    keyed = lines.filter("source is null or source <> 'archive'").select(*[T.missing(d).alias(d) for d in _DIMS], "pos", "line_uid", F.explode("speech_acts").alias("a"))
    return keyed.withColumn("act", F.coalesce(F.col("a.type"), F.lit("unknown"))).drop("a")


def coverage(lines: DataFrame) -> DataFrame:
    """One row: total_acts, lines_with_acts, of lines that aren't an archive's."""
    spoken = lines.filter("source is null or source <> 'archive'")
    return spoken.agg(F.coalesce(F.sum(F.greatest(F.size("speech_acts"), F.lit(0))), F.lit(0)).cast("bigint").alias("total_acts"), F.count_if(F.size("speech_acts") > 0).alias("lines_with_acts"))


def profile(lines: DataFrame) -> DataFrame:
    """slice_dim (global, situation_type, interlocutor, phase), slice_value, act, n and pct (3 digits, of the slice's acts)."""
    a = acts(lines)
    grouped = a.groupingSets([[F.col("act")], *[[F.col(d), F.col("act")] for d in _DIMS]], *_DIMS, "act").agg(F.count(F.lit(1)).alias("n"), F.grouping_id(*_DIMS, "act").alias("__gid"))
    dim, value = F.lit("global"), F.lit("")
    for i, d in enumerate(_DIMS):
        here = F.col("__gid").bitwiseAND(8 >> i) == 0
        dim, value = F.when(here, d).otherwise(dim), F.when(here, F.col(d)).otherwise(value)
    out = grouped.select(dim.alias("slice_dim"), value.alias("slice_value"), "act", "n")
    return out.withColumn("pct", F.bround(F.col("n") / F.sum("n").over(Window.partitionBy("slice_dim", "slice_value")), 3))


def _label(act: Column) -> Column:
    """Name of an act; an act that has none is its own."""
    return F.coalesce(T.first_match(F.concat(F.lit("|"), act, F.lit("|")), [(f"|{k}|", v) for k, v in R.ACT_LABELS.items()]), act)


def behaviour_patterns(prof: DataFrame) -> DataFrame:
    """pattern, rule (a sentence), layer, confidence from profile()'s rows, five kinds of pattern, the surest first.

    The most frequent act of an interlocutor is, of equal ones, the smallest by name; of equally sure patterns the
    smaller pattern and rule come first.
    """
    glob = prof.filter("slice_dim = 'global'").agg(*[F.coalesce(F.max(F.when(F.col("act") == a, F.col("pct"))), F.lit(0.0)).alias(a) for a in ("evade", "restrain", "console")])
    pattern = lambda d, name, rule, layer, sure: d.select(name.alias("pattern"), rule.alias("rule"), F.lit(layer).alias("layer"), sure.alias("confidence"))
    lit, join, pct = F.lit, F.concat, T.percent_text
    evade = pattern(glob.filter("evade > 0.12"), lit("high_evade"), join(lit("在被追问时倾向回避直接回答（回避行为占比"), pct(F.col("evade")), lit("），常用省略号结尾或反问代替回答")), 0, F.least(F.col("evade") * 3, lit(1.0)))
    sit = prof.filter("slice_dim = 'situation_type' and act = 'invite'").agg(F.max(F.when(F.col("slice_value") == "comfort", F.col("n"))).alias("yes"), F.max(F.when(F.col("slice_value") == "confront", F.col("n"))).alias("no"))
    invite = pattern(sit.filter("coalesce(yes, 0) > 0 and coalesce(no, 0) = 0"), lit("selective_invite"), lit("只在安慰他人时发出邀请，在面对对抗时从不邀请——即使在冲突中也保持邀请姿态是罕见的"), 0, lit(0.7))
    calm = pattern(glob.filter("restrain > 0.08 and console > 0.08"), lit("restrained_consolation"), lit("安慰他人时倾向用克制的表达（先说'我明白'，再轻描淡写地宽慰），而不是热情的鼓励"), 2, F.least((F.col("restrain") + F.col("console")) * 2, lit(1.0)))
    people = prof.filter("slice_dim = 'interlocutor' and slice_value <> 'unknown'").groupBy("slice_value").agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.min_by("act", F.struct(-F.col("n"), F.col("act"))).alias("act"))
    people = people.withColumns({"share": F.col("top") / F.col("total"), "label": _label(F.col("act"))}).filter("share > 0.3 and top >= 2")
    towards = pattern(people, join(lit("interlocutor_"), "act"), join(lit("对"), "slice_value", lit("的对话中，"), "label", lit("行为占比最高（"), pct(F.col("share")), lit("）——用"), "label", lit("的方式回应"), "slice_value"), 4, F.least("share", lit(0.9)))
    whole = prof.filter("slice_dim = 'global'").select("act", F.col("pct").alias("g"))
    ph = prof.filter("slice_dim = 'phase'")
    several = ph.agg((F.countDistinct("slice_value") >= 2).alias("__several"))
    total = Window.partitionBy("slice_value")
    shift = ph.withColumn("p", F.col("n") / F.sum("n").over(total)).join(F.broadcast(several), F.col("__several")).join(whole, "act", "left").withColumn("delta", F.col("p") - F.coalesce("g", lit(0.0)))
    shift = shift.filter("slice_value <> 'unknown' and abs(delta) > 0.15 and n >= 2")
    shifted = pattern(shift, join(lit("phase_shift_"), "slice_value", lit("_"), "act"), join("slice_value", lit("时期，"), _label(F.col("act")), lit("行为"), F.when(F.col("delta") > 0, "显著增多").otherwise("显著减少"), lit("（偏移"), pct(F.abs("delta")), lit("）")), 2, F.least(F.abs("delta") * 2, lit(0.9)))
    out = evade.unionByName(invite).unionByName(calm).unionByName(towards).unionByName(shifted)
    return out.withColumn("confidence", F.bround("confidence", 6)).orderBy(F.desc("confidence"), "pattern", "rule")


def analyse(lines: DataFrame) -> DataFrame:
    """behaviour_patterns of lines whose acts are classified here, whatever their speech_acts column held."""
    return behaviour_patterns(profile(classify(lines)))
