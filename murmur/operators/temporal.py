"""Metrics of slices and their comparison between consecutive periods and between interlocutors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..session import materialize
from .fingerprint import line_features
from .speech import _label as act_label


def slice_metrics(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Line count, mean sentence length, shares of lines with pauses, exclamations and denials, self references a line."""
    return line_features(lines).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lines"),
        F.coalesce(F.bround(F.sum("sentence_chars") / F.nullif(F.sum("n_sentences"), F.lit(0)), 1), F.lit(0.0)).alias("avg_length"),
        T.pct(F.col("ellipsis")).alias("ellipsis_pct"),
        T.pct(F.col("exclamation")).alias("exclamation_pct"),
        T.pct(F.col("negation_short")).alias("negation_pct"),
        F.bround(F.coalesce(F.sum("self_refs"), F.lit(0)) / F.count(F.lit(1)), 2).alias("self_ref_freq"),
    )


def act_shares(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, act, n, share of the slice's acts."""
    a = lines.select(*keys, F.explode("speech_acts").alias("a")).groupBy(*keys, F.coalesce(F.col("a.type"), F.lit("unknown")).alias("act")).agg(F.count(F.lit(1)).alias("n"))
    return a.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def interlocutor_counts(lines: DataFrame) -> DataFrame:
    """phase, interlocutor, n of lines of named periods."""
    return periods(lines).groupBy("phase", "interlocutor").agg(F.count(F.lit(1)).alias("n"))


def periods(lines: DataFrame) -> DataFrame:
    """Lines of named periods that aren't archives; interlocutor 'unknown' where missing."""
    return lines.filter((F.coalesce("source", F.lit("")) != "archive") & (T.missing("phase") != "unknown")).withColumn("interlocutor", T.missing("interlocutor"))


def ordered_phases(found: DataFrame, timeline: DataFrame) -> DataFrame:
    """phase, ord: periods of the timeline in its order, then the others by name. One row a period."""
    known = timeline.select(F.col("id").alias("phase"), F.col("ord").alias("__o"))
    return found.select("phase").distinct().join(F.broadcast(known), "phase", "left").withColumn("ord", F.row_number().over(Window.orderBy(F.col("__o").asc_nulls_last(), "phase"))).drop("__o")


def told(what: Column, way: Column, x: Column, y: Column, first: str, second: str) -> Column:
    """The sentence that reads a difference, such as 'denials fewer (40%->20%)' in the language of the rules."""
    return F.concat(what, way, F.lit("（"), x.cast("string"), F.lit(f"{first}→"), y.cast("string"), F.lit(f"{second}）"))


#: Rates that are compared: metric, column, least difference as a share of the baseline, what is told of it, more, less, units of both figures.
RATES = [("avg_sentence_length", "avg_length", 0.25, "句式", "偏长", "偏短", "", "字"), ("ellipsis_pct", "ellipsis_pct", 0.3, "沉默/停顿", "增多", "减少", "%", "%"), ("negation_pct", "negation_pct", 0.3, "否定表达", "增多", "减少", "%", "%")]
#: What the metric of an act begins with, and the least difference of two shares.
ACT, LEAST_SHARE = "speech_act:", 0.1


def profiles(metrics: DataFrame, shares: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, figures (rates and shares of acts by metric), wide (metrics of the acts whose share is above LEAST_SHARE): one row a slice.

    Shares lie between 0 and 1, so two of them differ by more than LEAST_SHARE only if one of them is above it. A figure has its value and what
    is shown and told of it, so that these are made once a slice and not once a pair.
    """

    def entry(metric: Column, value: Column, shown: Column, what: Column) -> Column:
        return F.struct(metric.alias("key"), F.struct(value.alias("value"), shown.alias("shown"), shown.cast("string").alias("text"), what.alias("what")).alias("figure"))

    share = F.col("share")
    acts = shares.groupBy(*keys).agg(F.collect_list(entry(F.concat(F.lit(ACT), "act"), share, F.bround(share * 100, 1), act_label(F.col("act")))).alias("__a"))
    rates = F.array(*[entry(F.lit(metric), F.col(c), F.col(c), F.lit(what)) for metric, c, _, what, *_ in RATES])
    p = metrics.select(*keys, rates.alias("__r")).join(acts, [*keys], "left").withColumn("__a", F.coalesce("__a", F.filter("__r", lambda x: F.lit(False))))
    wide = F.transform(F.filter("__a", lambda x: x["figure"]["value"] > LEAST_SHARE), lambda x: x["key"])
    return p.select(*keys, F.map_from_entries(F.concat("__r", "__a")).alias("figures"), wide.alias("wide"))


def _side(found: DataFrame, item: str, name: str) -> DataFrame:
    """Profiles as the side `name` (a or b) of a comparison."""
    return found.withColumnsRenamed({item: name, "figures": f"f{name}", "wide": f"w{name}"})


def _differences(both: DataFrame, only: Sequence[str] = ()) -> DataFrame:
    """(scope.., a, b, both profiles): metric, baseline, comparison, shift_pct, reading for every large difference of slice b against slice a. Nothing is shuffled."""
    metrics = F.concat(F.array(*[F.lit(r[0]) for r in RATES]), F.array_union("wa", "wb"))
    # both figures are looked up here and once; as columns of their own they would be looked up again wherever they are named
    looked_up = F.transform(metrics, lambda m: F.struct(m.alias("metric"), F.try_element_at("fa", m).alias("__x"), F.try_element_at("fb", m).alias("__y")))
    d = both.select(*only, "a", "b", F.explode_outer(looked_up).alias("__d")).select(*only, "a", "b", "__d.*")
    of = lambda name, none: (F.coalesce(F.col("__x")[name], F.lit(none)), F.coalesce(F.col("__y")[name], F.lit(none)))
    (x, y), shown, text = of("value", 0.0), of("shown", 0.0), of("text", "0.0")

    def by_metric(rate, act: Column) -> Column:  # noqa: ANN001
        out = F.when(F.col("metric") == RATES[0][0], rate(*RATES[0][2:]))
        for r in RATES[1:]:
            out = out.when(F.col("metric") == r[0], rate(*r[2:]))
        return out.otherwise(act)

    rel = (y - x) / F.nullif(x, F.lit(0.0))
    way = lambda more, less: F.when(y > x, more).otherwise(less)
    large = by_metric(lambda least, *_: (x > 0) & (F.abs(rel) > least), F.abs(y - x) > LEAST_SHARE)
    change = F.when(F.startswith("metric", F.lit(ACT)), y - x).otherwise(rel)
    what = F.coalesce(F.col("__x")["what"], F.col("__y")["what"])
    reading = by_metric(lambda _, __, more, less, first, second: told(what, way(more, less), *text, first, second), told(what, way("行为显著增多", "行为显著减少"), *text, "%", "%"))
    return d.filter(large).select(*only, "a", "b", "metric", shown[0].alias("baseline"), shown[1].alias("comparison"), F.bround(change * 100, 1).alias("shift_pct"), reading.alias("reading"))


def _compare(pairs: DataFrame, metrics: DataFrame, shares: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pairs(a, b): the differences of slice b against slice a."""
    found = profiles(metrics, shares, keys)
    return _differences(pairs.join(_side(found, keys[-1], "a"), "a").join(_side(found, keys[-1], "b"), "b"))


def period_shifts(lines: DataFrame, timeline: DataFrame) -> DataFrame:
    """from_phase, to_phase, metric, baseline, comparison, shift_pct, confidence for consecutive periods."""
    p = periods(lines)
    m = materialize(slice_metrics(p, ["phase"]), "temporal")
    order = ordered_phases(m, timeline)
    pairs = order.select(F.lag("phase").over(Window.orderBy("ord")).alias("a"), F.col("phase").alias("b")).filter("a is not null")
    out = _compare(pairs, m, materialize(act_shares(p, ["phase"]), "temporal"), ["phase"])
    return out.select(F.col("a").alias("from_phase"), F.col("b").alias("to_phase"), "metric", "baseline", "comparison", "shift_pct", "reading", F.least(F.bround(F.abs("shift_pct") / 50, 6), F.lit(0.95)).alias("confidence"))


#: Profiles for which the pairs of a period are made in one cell.
CELL = 256


def interlocutor_profiles(lines: DataFrame, least: int = 2) -> DataFrame:
    """Profiles of the interlocutors of a period with `least` lines or more each, written once."""
    p, keys = periods(lines).filter("interlocutor <> 'unknown'"), ["phase", "interlocutor"]
    return materialize(profiles(slice_metrics(p, keys).filter(F.col("lines") >= least), act_shares(p, keys), keys), "temporal")


def _interlocutor_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """phase, a, b (a < b) and both profiles for every two interlocutors of a period, a from `first`.

    A period's pairs are dealt out in cells by hashes of a and b. Profiles are sent to their cells, pairs are sent nowhere.
    """
    n = math.ceil(math.sqrt(second.count() / CELL)) or 1
    of, every = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = _side(first, "interlocutor", "a").withColumn("__i", of("a")).withColumn("__j", every)
    b = _side(second, "interlocutor", "b").withColumn("__j", of("b")).withColumn("__i", every)
    cell, tasks = ["phase", "__i", "__j"], max(n * n, first.sparkSession.sparkContext.defaultParallelism)
    return a.repartition(tasks, *cell).join(b.repartition(tasks, *cell), cell).filter("a < b").drop("__i", "__j")


#: The greatest confidence of a difference between interlocutors.
SUREST = 0.9


def _sure(d: DataFrame) -> DataFrame:
    sure = F.abs("shift_pct") / 40
    return d.withColumn("confidence", F.when(sure >= SUREST, SUREST).otherwise(F.bround(sure, 6)))


def interlocutor_differences(lines: DataFrame, least: int = 2) -> DataFrame:
    """phase, a, b (a < b), metric.. for every two interlocutors of a period with `least` lines or more each."""
    found = interlocutor_profiles(lines, least)
    return _sure(_differences(_interlocutor_pairs(found, found), ["phase"]))


#: The number of profiles whose pairs surest_pairs() makes first.
HEADS = 64


def _first_rules(rules: DataFrame, k: int) -> DataFrame:
    return rules.orderBy(F.desc("confidence"), "layer", "scope", "metric").limit(k)


def surest_pairs(found: DataFrame, k: int) -> DataFrame:
    """The first k rules, in the order of _first_rules(), of what interlocutor_differences() gives for these profiles.

    Confidence ends at SUREST, and a scope begins with its period and a. So once k rules of that confidence are known whose scopes
    don't come after the least period and a that is left, no pair that is left has a rule before them. Until then more pairs
    are made, if need be all of them.
    """
    start = F.concat_ws("/", "phase", "interlocutor", F.lit(""))
    partners = found.groupBy("phase").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("phase")
    paired, heads = found.join(partners, "phase", "left_semi"), HEADS
    while True:
        size, left = paired.select(start.alias("__s")).orderBy("__s").limit(heads + 1).agg(F.count(F.lit(1)), F.max("__s")).first()
        every = size <= heads
        d = _sure(_differences(_interlocutor_pairs(found if every else found.filter(start < left), found), ["phase"]))
        rules = d.select(F.lit(4).alias("layer"), F.concat_ws("/", "phase", "a", "b").alias("scope"), "metric", F.concat("phase", F.lit("时期，对"), "a", F.lit("与对"), "b", F.lit("的表达差异："), "reading").alias("rule"), "confidence")
        top = materialize(_first_rules(rules, k), "temporal")
        if every or top.filter((F.col("confidence") >= SUREST) & (F.col("scope") <= left)).count() >= k:
            return top
        heads *= 4


def temporal_rules(lines: DataFrame, timeline: DataFrame, k: int = 20) -> DataFrame:
    """The k surest differences of both kinds (a top-k report): layer, scope, metric, rule (a sentence), confidence."""
    two = period_shifts(lines, timeline).select(F.lit(2).alias("layer"), F.concat_ws("->", "from_phase", "to_phase").alias("scope"), "metric", F.concat("to_phase", F.lit("时期相比"), "from_phase", F.lit("时期："), "reading").alias("rule"), "confidence")
    return _first_rules(two.unionByName(surest_pairs(interlocutor_profiles(lines), k)), k)
