"""Style fingerprints: features once a line, aggregated by grouping sets, and shifts against the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T

DIMS = ("situation_type", "interlocutor", "phase")


def spoken(lines: DataFrame, source: str | None = None) -> DataFrame:
    """Lines that count as speech: no archives, no blank text; one source if asked for."""
    out = lines.filter((F.coalesce("source", F.lit("")) != "archive") & (T.strip(F.coalesce("text", F.lit(""))) != ""))
    return out.filter(F.col("source") == source) if source else out


def parallel(text: Column) -> Column:
    """Three clauses or more that begin with the same two characters."""
    starts = F.transform(F.filter(F.transform(F.split(text, "[，、；]"), T.strip), lambda p: F.length(p) >= 2), lambda p: F.left(p, F.lit(2)))
    many = F.exists(F.array_distinct(starts), lambda p: F.size(F.filter(starts, lambda q: q == p)) >= 3)
    return (F.size(F.split(text, "[，、；]")) >= 3) & many


def line_features(lines: DataFrame) -> DataFrame:
    """lines plus one column a feature, in one projection over literals.

    A NULL text has NULL features, which count as not present.
    """
    t = F.col("text")
    lens = F.transform(T.sentences(t, R.SENTENCE_END), F.length)
    size = lambda cond: F.size(F.filter(lens, cond)).cast("bigint")
    ask = F.contains(t, F.lit("？")) | F.contains(t, F.lit("?"))
    feats = {
        "n_sentences": F.size(lens).cast("bigint"),
        "n_short": size(lambda x: x <= 5),
        "n_medium": size(lambda x: (x > 5) & (x <= 15)),
        "n_long": size(lambda x: x > 15),
        "sentence_chars": F.aggregate(lens, F.lit(0), lambda a, x: a + x).cast("bigint"),
        "min_len": F.array_min(lens),
        "max_len": F.array_max(lens),
        "ellipsis": F.contains(t, F.lit("…")) | F.contains(t, F.lit("...")),
        "ellipsis_start": F.startswith(t, F.lit("…")) | F.startswith(t, F.lit("...")),
        "dash": F.contains(t, F.lit("—")),
        "exclamation": F.contains(t, F.lit("！")) | F.contains(t, F.lit("!")),
        "question": ask,
        "rhetorical": ask & T.contains_any(t, R.words(R.RHETORICAL)),
        "metaphor": T.contains_any(t, R.words(R.METAPHOR)),
        "parallelism": parallel(t),
        "negation": F.rlike(t, F.lit(R.NEGATION)),
        "negation_short": F.rlike(t, F.lit(R.NEGATION_SHORT)),
        "honorific": T.contains_any(t, R.words(R.HONORIFIC)),
        "intimate": T.contains_any(t, R.words(R.INTIMATE)),
        **{f"self_{i}": T.count_sub(t, w) for i, w in enumerate(R.words(R.FIRST_PERSON))},
        **{f"nature_{i}": T.count_all(t, R.words(w)) for i, w in enumerate(R.NATURE.values())},
    }
    feats["self_refs"] = T.count_all(t, R.words(R.FIRST_PERSON))
    feats["nature_words"] = T.count_all(t, [w for ws in R.NATURE.values() for w in ws])
    for i, w in enumerate(R.EMOTIONS.values()):
        feats[f"emotion_{i}"] = T.count_all(t, R.words(w))
    return lines.withColumns(feats)


def _best(names: list[str], columns: list[str]) -> Column:
    """Name of the largest column, the first of equal ones; NULL if all are 0."""
    out = F.lit(None).cast("string")
    top = F.greatest(*columns)
    for n, c in reversed(list(zip(names, columns, strict=True))):
        out = F.when(F.col(c) == top, F.lit(n)).otherwise(out)
    return F.when(top > 0, out)


FLAGS = "ellipsis ellipsis_start dash exclamation question rhetorical metaphor parallelism negation honorific intimate".split()
SELF, NATURE, FEELINGS = [f"self_{i}" for i in range(len(R.words(R.FIRST_PERSON)))], [f"nature_{i}" for i in range(len(R.NATURE))], [f"emotion_{i}" for i in range(len(R.EMOTIONS))]
SUMS = ["n_sentences", "n_short", "n_medium", "n_long", "sentence_chars", *SELF, *NATURE, *FEELINGS]


def _partial() -> list[Column]:
    """Sums of the features of lines; they add up, so that slices can be made of smaller slices."""
    s = lambda c, to: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(to)
    return [F.count(F.lit(1)).alias("lines"), *[s(c, c) for c in SUMS], *[s(F.col(c).cast("int"), f"{c}_n") for c in FLAGS], F.min("min_len").cast("bigint").alias("min_len"), F.max("max_len").cast("bigint").alias("max_len")]


def _whole() -> list[Column]:
    """The same of rows that hold such sums."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return [s("lines"), *[s(c) for c in SUMS], *[s(f"{c}_n") for c in FLAGS], F.min("min_len").alias("min_len"), F.max("max_len").alias("max_len")]


def traits(rules: list[tuple[Column, str]], none: str) -> Column:
    """The texts of the rules that hold, in order; `none` if none does."""
    return F.coalesce(F.nullif(F.concat_ws("；", *[F.when(c, t) for c, t in rules]), F.lit("")), F.lit(none))


def _finish(agg: DataFrame) -> DataFrame:
    """Averages, percentages, types and their readings from the sums of a slice. Every threshold is applied to counts, never to rounded figures."""
    total = lambda cols: sum((F.col(c) for c in cols), F.lit(0).cast("bigint"))
    agg = agg.withColumns({"self_refs": total(SELF), "nature_words": total(NATURE)})
    some = F.nullif("lines", F.lit(0))
    part = lambda c: F.bround(F.col(c) / F.nullif("n_sentences", F.lit(0)) * 100, 1)
    agg = agg.withColumns({"avg_length": F.bround(F.col("sentence_chars") / F.nullif("n_sentences", F.lit(0)), 1), "short_pct": part("n_short"), "medium_pct": part("n_medium"), "long_pct": part("n_long"), **{f"{c}_pct": F.bround(F.col(f"{c}_n") / some * 100, 1) for c in FLAGS}})
    kind = F.when(F.col("n_sentences") == 0, "unknown").when(F.col("short_pct") > 50, "短句型").when(F.col("long_pct") > 40, "长句型").when((F.col("short_pct") > 25) & (F.col("long_pct") > 25), "长短交替型").otherwise("中句型")
    active = sum((F.when(F.col(c) >= 2, 1).otherwise(0) for c in FEELINGS), F.lit(0))
    ratio = lambda c: F.col(f"{c}_n") / some
    polite, close = F.col("honorific_n"), F.col("intimate_n")
    agg = agg.withColumns(
        {
            "sentence_type": kind,
            "self_ref_freq": F.bround(F.col("self_refs") / some, 2),
            "self_primary": F.coalesce(_best(R.words(R.FIRST_PERSON), SELF), F.lit("省略自称")),
            "nature_density": F.bround(F.col("nature_words") / some, 2),
            "nature_top": F.coalesce(_best(list(R.NATURE), NATURE), F.lit("无")),
            "emotion_dominant": F.coalesce(_best(list(R.EMOTIONS), FEELINGS), F.lit("unknown")),
            "emotion_active": active.cast("bigint"),
            "emotion_breadth": F.when(active >= 5, "宽谱").when(active >= 3, "中谱").otherwise("窄谱"),
            "address_type": F.when(F.col("lines") == 0, "unknown").when(polite > close * 2, "尊称型").when(close > polite * 2, "亲昵型").when((polite > 0) & (close > 0), "切换型").otherwise("省略称呼型"),
            "rhetoric_traits": F.when(F.col("lines") > 0, traits([(ratio("rhetorical") > 0.1, "善用反问引导思考"), (ratio("metaphor") > 0.1, "偏好意象化表达"), (ratio("negation") > 0.4, "频繁使用否定句式，倾向从反面界定"), (ratio("negation") < 0.1, "极少使用否定句，表达积极正向")], "修辞风格平实直白")),
            "pause_traits": F.when(F.col("lines") > 0, traits([(ratio("ellipsis") > 0.3, "频繁停顿，善于沉默"), (ratio("ellipsis_start") > 0.15, "常以沉默开头，话语经过深思熟虑"), (ratio("exclamation") < 0.05, "几乎不用感叹号，语气极度克制"), (ratio("exclamation") > 0.3, "常用感叹号，表达直接热烈")], "语气平稳，无明显极端标记")),
        }
    )
    me = F.col("self_primary")
    agg = agg.withColumns(
        {
            "self_reading": F.when(F.col("self_refs") == 0, "极少使用第一人称，倾向省略主语或使用'我们'").when(F.col("self_ref_freq") < 0.3, "极少自称，倾向省略主语").when(me == "我", "常用'我'，表达直接").when(me.isin("吾", "本王", "朕"), F.concat(F.lit("使用'"), me, F.lit("'自称，体现特殊身份地位"))).otherwise(F.concat(F.lit("自称'"), me, F.lit("'，有独特表达习惯"))),
            "emotion_reading": F.when(F.col("emotion_dominant") == "unknown", "未检测到明显情感词汇").otherwise(F.concat(F.lit("主导情感为'"), "emotion_dominant", F.lit("'，情感谱系"), "emotion_breadth", F.lit("（活跃情感"), F.col("emotion_active").cast("string"), F.lit("种）"))),
            "nature_level": F.when(F.col("nature_words") == 0, "none").when(F.col("nature_density") > 3, "高频").when(F.col("nature_density") > 1, "中频").otherwise("低频"),
        }
    )
    nature = F.when(F.col("nature_words") == 0, "极少使用自然意象").otherwise(F.concat(F.lit("自然意象密度"), "nature_level", F.lit("（"), F.col("nature_density").cast("string"), F.lit("个/句），偏好"), "nature_top", F.lit("意象")))
    head = F.concat(F.lit("句式"), "sentence_type", F.lit("，平均"), F.coalesce(F.col("avg_length").cast("string"), F.lit("0")), F.lit("字"))
    return agg.withColumn("nature_reading", nature).withColumn("summary", F.concat_ws("；", head, "pause_traits", "self_reading", "emotion_reading", "rhetoric_traits", "nature_reading"))


def fingerprint(lines: DataFrame) -> DataFrame:
    """One row for all lines. An empty table gives one row with 0 lines and NULL averages."""
    return _finish(line_features(lines).agg(*_partial()))


def source_fingerprints(lines: DataFrame) -> DataFrame:
    """The fingerprint of the spoken lines of each source: source and the columns of fingerprint()."""
    return _finish(line_features(spoken(lines)).groupBy(T.missing("source").alias("source")).agg(*_partial()))


def contextual_fingerprint(lines: DataFrame, least: int = 2, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """slice_dim ('global' or a dimension), slice_value and the fingerprint of each slice with `least` lines or more.

    NULL and '' slice values are 'unknown'; the unknown period makes no slice. Lines are counted before
    blank ones are left out; a slice of blank lines only doesn't come out. The features are summed once by all dimensions
    together, and the slices are grouping sets over those few rows, not over the lines.
    """
    blank = T.strip(F.coalesce("text", F.lit(""))) == ""
    keys = [f"__{d}" for d in dims]
    keyed = line_features(lines.filter(F.coalesce("source", F.lit("")) != "archive").withColumns({f"__{d}": T.missing(d) for d in dims}))
    cells = keyed.groupBy(*keys, blank.alias("__blank")).agg(*_partial())
    none = [F.when(F.col("__blank"), None if c in ("min_len", "max_len") else 0).otherwise(F.col(c)).cast("bigint").alias(c) for c in ["lines", *SUMS, *[f"{c}_n" for c in FLAGS], "min_len", "max_len"]]
    cells = cells.select(*keys, F.col("lines").alias("__raw"), *none)
    sets = [[], *[[F.col(k)] for k in keys]]
    agg = cells.groupingSets(sets, *keys).agg(F.coalesce(F.sum("__raw"), F.lit(0)).alias("raw_lines"), F.grouping_id(*keys).alias("__gid"), *_whole())
    dim, value = F.lit("global"), F.lit("")
    for i, (d, k) in enumerate(zip(dims, keys, strict=True)):
        here = F.col("__gid") == (2 ** len(dims) - 1 - 2 ** (len(dims) - 1 - i))
        dim, value = F.when(here, d).otherwise(dim), F.when(here, F.col(k)).otherwise(value)
    out = agg.withColumns({"slice_dim": dim, "slice_value": value}).filter((F.col("slice_dim") == "global") | ((F.col("raw_lines") >= least) & (F.col("lines") > 0))).filter("not (slice_dim = 'phase' and slice_value = 'unknown')")
    return _finish(out.drop("__gid", *keys))


#: What shifts() compares.
SHIFTING = ["avg_length", "ellipsis_pct", "emotion_dominant", "negation_pct"]


def shifts(slices: DataFrame) -> DataFrame:
    """slice_dim, slice_value, dimension, global_value, slice_value_of, shift, magnitude from contextual_fingerprint's rows.

    The whole is one row, so it is broadcast. slices needs the columns SHIFTING.
    """
    whole = slices.filter("slice_dim = 'global'").select(*[F.col(c).alias(f"g_{c}") for c in SHIFTING]).limit(1)
    j = slices.filter("slice_dim <> 'global'").crossJoin(F.broadcast(whole))

    def row(dimension: str, g: Column, s: Column, cond: Column, shift: Column, magnitude: Column) -> Column:
        return F.when(cond, F.struct(F.lit(dimension).alias("dimension"), g.cast("string").alias("global_value"), s.cast("string").alias("slice_is"), shift.alias("shift"), magnitude.alias("magnitude")))

    def rate(dimension: str, c: str, more: str, less: str, fresh: str) -> Column:
        g, s = F.coalesce(f"g_{c}", F.lit(0.0)), F.coalesce(c, F.lit(0.0))
        rel = F.abs(s - g) / F.nullif(g, F.lit(0.0))
        new = (g == 0) & (s > 20)
        return row(dimension, g, s, ((g > 0) & (rel > 0.4)) | new, F.when(new, fresh).when(s > g, more).otherwise(less), F.when(new, F.bround(s / 100, 2)).otherwise(F.bround(rel, 2)))

    g, s = F.coalesce("g_avg_length", F.lit(0.0)), F.coalesce("avg_length", F.lit(0.0))
    rel = F.abs(s - g) / F.nullif(g, F.lit(0.0))
    rows = F.array(
        row("sentence_length", g, s, (g > 0) & (rel > 0.3), F.when(s < g, "偏短").otherwise("偏长"), F.bround(rel, 2)),
        rate("ellipsis", "ellipsis_pct", "更多沉默", "更少沉默", "出现沉默标记（全局无）"),
        row("emotion_dominant", F.col("g_emotion_dominant"), F.col("emotion_dominant"), F.col("g_emotion_dominant") != F.col("emotion_dominant"), F.concat(F.lit("从'"), "g_emotion_dominant", F.lit("'偏移到'"), "emotion_dominant", F.lit("'")), F.lit(None).cast("double")),
        rate("negation", "negation_pct", "更多否定", "更少否定", "出现否定表达（全局无）"),
    )
    return j.select("slice_dim", "slice_value", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r")).select("slice_dim", "slice_value", "r.*")


def lexicon_counts(lines: DataFrame, lexicon: dict[str, list[str]], by: str | None = None) -> DataFrame:
    """category, word, n (occurrences), first_pos (smallest pos with it), for each value of `by` if given. Words that don't occur are left out."""
    items = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(w).alias("word"), F.lit(i).alias("ord"), T.count_sub("text", w).alias("n")) for i, (c, w) in enumerate((c, w) for c, ws in lexicon.items() for w in R.words(ws))])
    keys = [by] if by else []
    hits = lines.select(*keys, "pos", F.explode(F.filter(items, lambda x: x["n"] > 0)).alias("h")).select(*keys, "pos", "h.*")
    return hits.groupBy(*keys, "category", "word").agg(F.sum("n").alias("n"), F.min("pos").alias("first_pos"))


def pronouns(lines: DataFrame) -> DataFrame:
    """pronoun, n, share in per cent of all of them, is_primary (most frequent; of equal ones the first in the list)."""
    words = R.words(R.FIRST_PERSON)
    sums = lines.agg(*[F.coalesce(F.sum(T.count_sub("text", w)), F.lit(0)).cast("bigint").alias(f"c{i}") for i, w in enumerate(words)])
    rows = F.array(*[F.struct(F.lit(w).alias("pronoun"), F.col(f"c{i}").alias("n"), F.lit(i).alias("ord")) for i, w in enumerate(words)])
    total = F.aggregate(rows, F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    top = F.array_max(F.transform(rows, lambda x: F.struct(x["n"].alias("n"), (-x["ord"]).alias("o"))))
    return sums.select(F.explode(F.filter(rows, lambda x: x["n"] > 0)).alias("p"), total.alias("t"), top.alias("top")).select("p.pronoun", "p.n", F.bround(F.col("p.n") / F.col("t") * 100, 1).alias("share_pct"), (F.col("p.ord") == -F.col("top.o")).alias("is_primary"))


def first_examples(lines: DataFrame, cond: Column, n: int = 5, width: int = 50) -> DataFrame:
    """The first n lines (by pos, then line_uid) that fulfil the condition: k, example (its first characters). A top-k report."""
    hits = lines.filter(cond).orderBy("pos", "line_uid").limit(n).select("pos", "line_uid", F.left("text", F.lit(width)).alias("example"))
    from pyspark.sql import Window

    return hits.select(F.row_number().over(Window.orderBy("pos", "line_uid")).cast("bigint").alias("k"), "example")
