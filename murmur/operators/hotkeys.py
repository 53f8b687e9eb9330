"""Per-key results over keys of which a few hold most rows.

Counts, sums and shares are algebraic, so partial aggregation on the map side already removes
the imbalance. Order statistics are not; they are found here by distributed exact selection:
histograms of a key's values (mergeable counts, with the least and greatest value of each bin) are
refined round by round inside the bin that holds the wanted rank, until that bin holds one value.
No task ever sees more than `bins` histogram rows of one key, however hot the key is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import fits_broadcast, materialize

#: Salts of the join that replaces the broadcast when there are very many keys.
SALTS = 32


def unpivot_keys(df: DataFrame, fields: Sequence[str], carry: dict[str, Column], missing: str = "unknown") -> DataFrame:
    """One row for each row and field: field_name, key_value (NULL and '' become `missing`) and the carried columns.

    Columns of df whose names clash with the results' names do no harm: only `fields` and the
    columns in `carry` are read.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.coalesce(F.nullif(F.col(f).cast("string"), F.lit("")), F.lit(missing)).alias("key_value")) for f in fields])
    base = df.select(pairs.alias("__pairs"), *[c.alias(n) for n, c in carry.items()])
    return base.select(F.explode("__pairs").alias("__p"), *carry).select("__p.field_name", "__p.key_value", *carry)


def _with_ranges(rows: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the open value ranges of their key; rows of keys with none are left out."""
    renamed = ranges.select(*[F.col(k).alias(f"__r_{k}") for k in keys], "__ranges")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    if fits_broadcast(ranges):
        out = rows.join(F.broadcast(renamed), cond)
    else:  # too many keys to broadcast: salt the rows, so that a hot key spreads over SALTS tasks
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64(F.spark_partition_id(), "__v"), F.lit(SALTS)).cast("int"))
        copies = renamed.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = salted.join(copies, cond & (F.col("__salt") == F.col("__copy"))).drop("__salt", "__copy")
    return out.drop(*[f"__r_{k}" for k in keys])


def per_key_quantiles(df: DataFrame, keys: Sequence[str], value: Column, probs: Sequence[float], bins: int = 512, max_rounds: int = 64) -> DataFrame:
    """Exact quantiles for each key: keys, n_rows, n_values, min_value, max_value, q0 .. qk (in the order of `probs`).

    The quantile at p is the smallest value with at least p of the key's values at or below it
    (SQL's percentile_disc). value must be numeric; integers up to 2**53 in size, or doubles.
    NULL and NaN values count in n_rows only; a key without values has NULL quantiles. Ties and
    repeated rows count as often as they are stored. NULL is a key like any other. An empty table
    gives no rows.
    """
    keys = list(keys)
    v = value.cast("double")
    rows = df.select(*keys, F.when(F.isnan(v), F.lit(None)).otherwise(v).alias("__v"))
    # counts of equal values, added up on the map side: a hot key is as many rows as it has values, spread over tasks by key and value
    counts = materialize(rows.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c")), "hotkeys")
    return _select(counts, keys, probs, bins, max_rounds)


def _select(counts: DataFrame, keys: list[str], probs: Sequence[float], bins: int, max_rounds: int) -> DataFrame:
    """per_key_quantiles of counts(keys, __v, __c)."""
    some = F.when(F.col("__v").isNotNull(), F.col("__c"))
    stats = materialize(counts.groupBy(*keys).agg(F.sum("__c").alias("n_rows"), F.coalesce(F.sum(some), F.lit(0)).alias("n_values"), F.min("__v").alias("min_value"), F.max("__v").alias("max_value")), "hotkeys")
    probes = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    state = stats.filter("n_values > 0").withColumn("__q", F.explode(probes)).select(
        *keys,
        F.col("__q.i").alias("__i"),
        F.greatest(F.lit(1), F.ceil(F.bround(F.col("__q.p") * F.col("n_values"), 9))).cast("bigint").alias("__rank"),
        F.lit(0).cast("bigint").alias("__below"),
        F.col("min_value").alias("__lo"),
        F.col("max_value").alias("__hi"),
    )
    done = None
    for _ in range(max_rounds):
        state = materialize(state, "hotkeys")
        settled = state.filter("__lo = __hi")
        done = settled if done is None else done.unionByName(settled)
        open_ = state.filter("__lo < __hi")
        if open_.isEmpty():
            break
        ranges = open_.groupBy(*keys).agg(F.collect_set(F.struct("__lo", "__hi")).alias("__ranges"))
        near = _with_ranges(counts.filter("__v is not null"), ranges, keys).withColumn("__r", F.expr("get(filter(__ranges, r -> __v >= r.__lo and __v <= r.__hi), 0)")).filter("__r is not null")
        # halves keep the difference of two large doubles finite; the bin number never decreases with the value
        pos = F.expr(f"cast(floor((__v / 2 - __r.__lo / 2) / (__r.__hi / 2 - __r.__lo / 2) * {bins}) as int)")
        hist = (
            near.select(*keys, F.col("__r.__lo").alias("__lo"), F.col("__r.__hi").alias("__hi"), F.least(F.lit(bins - 1), pos).alias("__bin"), "__v", "__c")
            .groupBy(*keys, "__lo", "__hi", "__bin")
            .agg(F.sum("__c").alias("__n"), F.min("__v").alias("__bmin"), F.max("__v").alias("__bmax"))
        )
        up_to = F.sum("__n").over(Window.partitionBy(*keys, "__lo", "__hi").orderBy("__bin"))
        hist = hist.withColumn("__upto", up_to)
        a, b = open_.alias("a"), hist.alias("b")
        cond = F.lit(True)
        for c in [*keys, "__lo", "__hi"]:
            cond = cond & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        inside = (F.col("a.__rank") - F.col("a.__below")).between(F.col("b.__upto") - F.col("b.__n") + 1, F.col("b.__upto"))
        state = a.join(b, cond & inside).select(
            *[F.col(f"a.{k}").alias(k) for k in keys], "a.__i", "a.__rank", (F.col("a.__below") + F.col("b.__upto") - F.col("b.__n")).alias("__below"), F.col("b.__bmin").alias("__lo"), F.col("b.__bmax").alias("__hi")
        )
    else:
        raise RuntimeError(f"values not separated after {max_rounds} rounds")
    wide = done.groupBy(*keys).agg(*[F.max(F.when(F.col("__i") == i, F.col("__lo"))).alias(f"q{i}") for i in range(len(probs))])
    out = stats.alias("s").join(wide.alias("w"), _join_on(keys), "left")
    return out.select(*[F.col(f"s.{k}").alias(k) for k in keys], "n_rows", "n_values", "min_value", "max_value", *[f"q{i}" for i in range(len(probs))])


def _join_on(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"s.{k}").eqNullSafe(F.col(f"w.{k}"))
    return cond


def key_profile(lines: DataFrame, fields: Sequence[str] = ("interlocutor", "situation_type"), probs: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """Line count, share and exact text-length quantiles of every value of each field.

    field_name, key_value, n_rows, share (of all stored rows), len_min, len_q0 .. , len_max.
    Lengths are code points; a NULL text has none, '' has 0.
    """
    rows = unpivot_keys(lines, fields, {"__len": F.length("text")})
    q = per_key_quantiles(rows, ["field_name", "key_value"], F.col("__len"), probs)
    total = q.groupBy(F.col("field_name").alias("__f")).agg(F.sum("n_rows").alias("__total"))  # one row a field
    return q.join(F.broadcast(total), F.col("field_name") == F.col("__f")).withColumn("share", F.col("n_rows") / F.col("__total")).select(
        "field_name", "key_value", "n_rows", "share", F.col("min_value").cast("bigint").alias("len_min"), *[F.col(f"q{i}").cast("bigint").alias(f"len_q{i}") for i in range(len(probs))], F.col("max_value").cast("bigint").alias("len_max")
    )


def hot_keys(lines: DataFrame, fields: Sequence[str] = ("interlocutor", "situation_type"), share: float = 0.05) -> DataFrame:
    """Keys of each field that hold more than `share` of all stored rows: field_name, key_value.

    In the order of a hash a key's rows lie side by side, so one that holds more than a share s of them holds one of the
    quantiles s, 2s, .. 1. Exact selection finds those 1 / s hashes of each field, and only their keys are counted.
    """
    marks = F.pmod(F.xxhash64("key_value"), F.lit(2**52)).cast("double")
    rows = unpivot_keys(lines, fields, {})
    probs = [*[k * share for k in range(1, int(1 / share + 1e-9) + 1) if k * share < 1], 1.0]
    q = materialize(per_key_quantiles(rows, ["field_name"], marks, probs), "hotkeys")
    hashes = q.select(F.col("field_name").alias("__f"), "n_rows", F.explode(F.array_distinct(F.array(*[f"q{i}" for i in range(len(probs))]))).alias("__h"))
    some = rows.join(F.broadcast(hashes), (F.col("field_name") == F.col("__f")) & (marks == F.col("__h")))
    return some.groupBy("field_name", "key_value").agg((F.count(F.lit(1)) > share * F.max("n_rows")).alias("__hot")).filter("__hot").select("field_name", "key_value")


def key_sentences(lines: DataFrame, fields: Sequence[str] = ("interlocutor", "situation_type")) -> DataFrame:
    """Sentence profile of every key: number of sentences, of short, medium and long ones, total and mean length."""
    sentences = F.filter(F.transform(F.split("text", "[。！？；…—.!?;\\n]+"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    rows = unpivot_keys(lines, fields, {"__lens": F.transform(sentences, F.length)})
    n = lambda cond: F.sum(F.size(F.filter("__lens", cond))).cast("bigint")
    return rows.groupBy("field_name", "key_value").agg(
        F.coalesce(n(lambda x: x >= 0), F.lit(0).cast("bigint")).alias("sentences"),
        F.coalesce(n(lambda x: x <= 5), F.lit(0).cast("bigint")).alias("short"),
        F.coalesce(n(lambda x: (x > 5) & (x <= 15)), F.lit(0).cast("bigint")).alias("medium"),
        F.coalesce(n(lambda x: x > 15), F.lit(0).cast("bigint")).alias("long"),
        F.coalesce(F.sum(F.aggregate("__lens", F.lit(0), lambda a, x: a + x)), F.lit(0)).cast("bigint").alias("chars"),
    )


def key_acts(lines: DataFrame, fields: Sequence[str] = ("interlocutor", "situation_type")) -> DataFrame:
    """Speech-act profile of every key: act, n and the share of the key's acts. NULL and '' acts are none."""
    rows = unpivot_keys(lines, fields, {"__acts": F.col("speech_acts")})
    counts = rows.select("field_name", "key_value", F.explode("__acts").alias("__a")).filter("coalesce(__a.type, '') <> ''").groupBy("field_name", "key_value", F.col("__a.type").alias("act")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("field_name", "key_value"))
    return counts.withColumn("share", F.bround(F.col("n") / total, 6))
