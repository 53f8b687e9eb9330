"""Period inference: an ordered cascade of rules as one expression, content clusters, and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


def result(phase: Column, source: str, confidence: str) -> Column:
    """(phase, source, confidence), NULL where the phase is."""
    return F.when(phase.isNotNull(), F.struct(phase.alias("phase"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence")))


def by_pattern(text: Column, rules: R.PhaseRules = R.ZH) -> Column:
    return result(T.first_rule(text, rules.patterns), "content_pattern", "high")


def by_keyword(text: Column, rules: R.PhaseRules = R.ZH) -> Column:
    return result(T.first_words(text, list(rules.words.items())), "content_keyword", "medium")


def by_chapter(chapter: Column, rules: R.PhaseRules = R.ZH) -> Column:
    return result(T.first_match(chapter, rules.chapters), "chapter_code", "medium")


def by_activity(name: Column, rules: R.PhaseRules = R.ZH) -> Column:
    return result(T.first_match(name, rules.activities), "activity", "medium")


def by_activity_type(kind: Column, name: Column, rules: R.PhaseRules = R.ZH) -> Column:
    """Of an activity's page: main-line chapters by their number; side stories by the words of a period in their name, with low confidence."""
    n = F.nullif(F.regexp_extract(name, r"第(\d+)章", 1), F.lit("")).cast("int")
    number = F.lit(None).cast("string")
    for least, phase in reversed(rules.main_story):
        number = F.when(n >= least, phase).otherwise(number)
    main = result(F.when(F.contains(kind, F.lit(R.MAIN_STORY)), number), "activity_type", "high")
    side = result(F.when(F.contains(kind, F.lit(R.SIDE_STORY)), T.first_words(name, list(rules.cluster_words.items()))), "activity_type", "low")
    return F.coalesce(main, side)


def activity_page(chapter: Column, rules: R.PhaseRules = R.ZH) -> Column:
    """Title of the page of a chapter's activity: known by the chapter's code, else the name that stands in the chapter; NULL for others."""
    code = F.regexp_extract(chapter, r"^([A-Z]+)-", 1)
    known = T.first_match(F.concat(F.lit("|"), code, F.lit("|")), [(f"|{k}|", v) for k, v in rules.code_pages])
    name = T.strip(F.regexp_extract(chapter, r"[A-Z]+-ST-\d+\s+(.+?)(?:/NBT)?$", 1))
    return F.when(code != "", F.coalesce(known, F.nullif(name, F.lit(""))))


def activity_info(value: Column) -> Column:
    """Map of the fields of the first activity template of a page; empty without one.

    Its lines run from the one that names it to the one that closes it; every part between bars that has a '=' is a field, the last of equal ones holds.
    """
    lines = F.split(value, "\n")
    opens = F.transform(lines, lambda x: F.contains(x, F.lit(R.ACTIVITY_TEMPLATE)) & F.contains(x, F.lit("{{")))
    rest = F.slice(lines, F.greatest(F.array_position(opens, True), F.lit(1)).cast("int"), F.size(lines))
    depth = lambda x: (F.length(x) - F.length(F.replace(x, F.lit("{{"), F.lit("")))) / 2 - (F.length(x) - F.length(F.replace(x, F.lit("}}"), F.lit("")))) / 2
    # lines are taken while the braces before them are open
    state = F.aggregate(rest, F.struct(F.lit("").alias("t"), F.lit(1.0).alias("left"), F.lit(0.0).alias("depth")), lambda s, x: F.when(s["left"] > 0, F.struct(F.concat(s["t"], F.lit("|"), x).alias("t"), F.when(s["depth"] + depth(x) <= 0, 0.0).otherwise(1.0).alias("left"), (s["depth"] + depth(x)).alias("depth"))).otherwise(s))
    parts = F.filter(F.split(state["t"], r"\|"), lambda x: F.contains(x, F.lit("=")))
    pairs = F.filter(F.transform(parts, lambda x: F.struct(T.strip(F.substring_index(x, "=", 1)).alias("key"), T.strip(F.regexp_replace(x, "^[^=]*=", "")).alias("value"))), lambda e: (e["key"] != "") & (e["value"] != "") & ~F.startswith(e["key"], F.lit("{")))
    keep = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda later: later["key"] == e["key"]))
    return F.when(F.array_contains(opens, True), F.map_from_entries(keep)).otherwise(F.create_map().cast("map<string,string>"))


def page_activities(pages: DataFrame, rules: R.PhaseRules = R.ZH) -> DataFrame:
    """title, name, kind, phase, source, confidence of pages(title, value, categories) that have an activity template.

    The short name counts before the long one. NULL categories are none.
    """
    info = pages.withColumn("__i", activity_info(F.col("value"))).filter(F.size("__i") > 0)
    field = lambda k: F.try_element_at("__i", F.lit(k))
    named = info.select("title", "categories", F.coalesce(*[field(k) for k in R.ACTIVITY_NAMES], F.lit("")).alias("name"), F.coalesce(field(R.ACTIVITY_TYPE), F.lit("")).alias("kind"))
    return named.withColumn("__r", by_activity_type(F.col("kind"), F.col("name"), rules)).select("title", "categories", "name", "kind", "__r.*")


def activity_phases(chapters: DataFrame, chapter: str, pages: DataFrame, rules: R.PhaseRules = R.ZH) -> DataFrame:
    """Each distinct chapter with phase, source, confidence: by the activities known by name, else by its activity's page; NULL where neither tells.

    A name that only stands in the chapter counts if its page says in its categories that it is a story. Pages are the small
    side; several pages of one title count as the smallest by name.
    """
    known = [k for k, _ in rules.code_pages]
    told = page_activities(pages, rules).groupBy("title").agg(F.min_by(F.struct("categories", "phase", "source", "confidence"), "name").alias("__p"))
    each = chapters.select(F.col(chapter).alias("chapter")).distinct().withColumn("__page", activity_page(F.col("chapter"), rules)).withColumn("__coded", F.regexp_extract("chapter", r"^([A-Z]+)-", 1).isin(known))
    story = F.exists(F.coalesce("__p.categories", F.array().cast("array<string>")), lambda c: F.contains(c, F.lit(R.SIDE_STORY)) | F.contains(c, F.lit(R.MAIN_STORY)))
    joined = each.join(told, each["__page"] == told["title"], "left")
    paged = F.when(F.col("__coded") | story, F.when(F.col("__p.phase").isNotNull(), F.struct("__p.phase", "__p.source", "__p.confidence")))
    return joined.withColumn("__f", F.coalesce(by_activity(F.col("chapter"), rules), paged)).select("chapter", "__f.*")


def by_categories(categories: Column, rules: R.PhaseRules = R.ZH) -> Column:
    """Of a page's categories (array): the first, in the page's order, that tells a period; a mere member is of the first period, with low confidence."""
    told = F.transform(categories, lambda c: T.first_match(F.concat(F.lit("|"), c, F.lit("|")), [(f"|{k}|", p) for k, p in rules.categories] or [("\x00", None)]))
    first = F.get(F.filter(told, lambda x: x.isNotNull()), F.lit(0))
    member = F.exists(categories, lambda c: F.contains(c, F.lit(R.MEMBER)))
    return F.coalesce(result(first, "category", "medium"), result(F.when(member, F.lit(rules.first)), "category", "low"))


def by_faction(faction: Column, rules: R.PhaseRules = R.ZH) -> Column:
    return result(T.first_match(faction, rules.factions), "faction", "medium")


def story_phase(chapter: Column, scene: Column, rules: R.PhaseRules = R.ZH) -> Column:
    """Chapter, activity, then scene words; unknown."""
    s = F.lower(F.coalesce(scene, F.lit("")))
    return F.coalesce(by_chapter(chapter, rules)["phase"], by_activity(chapter, rules)["phase"], T.first_words(s, rules.scene_words), F.lit("unknown"))


def cluster(lines: DataFrame, by: str, text: str = "text", rules: R.PhaseRules = R.ZH) -> DataFrame:
    """by, phase, score, ratio, confidence: the period most of whose words occur in a group's texts.

    One pass: the number of words each text holds, summed by group. Equal scores go to the earlier period;
    groups without any such word don't come out.
    """
    cols = [f"__c{i}" for i in range(len(rules.order))]
    counts = [F.coalesce(F.sum(sum((F.contains(F.col(text), F.lit(w)).cast("int") for w in rules.cluster_words[p]), F.lit(0))), F.lit(0)).cast("bigint").alias(c) for p, c in zip(rules.order, cols, strict=True)]
    agg = lines.groupBy(by).agg(*counts)
    top = F.greatest(*cols)
    phase = F.lit(None).cast("string")
    for p, c in reversed(list(zip(rules.order, cols, strict=True))):
        phase = F.when(F.col(c) == top, p).otherwise(phase)
    out = agg.filter(top > 0).select(by, phase.alias("phase"), top.alias("score"), F.bround(top / sum((F.col(c) for c in cols), F.lit(0)), 6).alias("ratio"))
    return out.withColumn("confidence", F.when((F.col("ratio") >= 0.6) & (F.col("score") >= 5), "medium").otherwise("low"))


def _fixed(name: Column, rules: R.PhaseRules) -> Column:
    out = F.lit(None).cast("string")
    for k, p in rules.defaults.items():
        out = F.when(name == k, p).otherwise(out)
    return out


def _unknown() -> Column:
    return F.struct(F.lit("unknown").alias("phase"), F.lit("none").alias("source"), F.lit("low").alias("confidence"))


def infer(lines: DataFrame, by: str, chapter: str | None = None, rules: R.PhaseRules = R.ZH) -> DataFrame:
    """lines with phase, phase_source, phase_confidence: content, chapter, activity, the group's cluster, the group's default, unknown.

    The cluster is computed once a group and joined, never once a line. Columns of those names are replaced.
    """
    base = lines.drop("phase", "phase_source", "phase_confidence")
    groups = cluster(base, by, rules=rules).select(F.col(by).alias("__by"), F.struct("phase", F.lit("cluster").alias("source"), "confidence").alias("__c"))
    j = base.join(groups, base[by] == F.col("__by"), "left")
    t = F.col("text")
    ch = [by_chapter(F.col(chapter), rules), by_activity(F.col(chapter), rules)] if chapter else []
    found = F.coalesce(by_pattern(t, rules), by_keyword(t, rules), *ch, F.col("__c"), result(_fixed(F.col(by), rules), "default", "low"), _unknown())
    return j.withColumn("__f", found).withColumns({"phase": F.col("__f.phase"), "phase_source": F.col("__f.source"), "phase_confidence": F.col("__f.confidence")}).drop("__f", "__c", "__by")


def default_phase(records: DataFrame, voices: DataFrame, categories: DataFrame | None = None, rules: R.PhaseRules = R.ZH) -> DataFrame:
    """slug, phase, source, confidence of each record: fixed default, category of its page, faction, cluster of its voice lines, member of any group, unknown.

    categories(slug, categories array) may be missing or lack a slug.
    """
    c = cluster(voices, "slug", rules=rules).select(F.col("slug").alias("__s"), F.struct("phase", F.lit("cluster").alias("source"), "confidence").alias("__c"))
    j = records.select("slug", "name_zh", "faction").join(c, F.col("slug") == F.col("__s"), "left")
    if categories is not None:
        cat = categories.groupBy(F.col("slug").alias("__t")).agg(F.first("categories").alias("categories"))
        j = j.join(cat, F.col("slug") == F.col("__t"), "left").withColumn("__k", by_categories(F.col("categories"), rules))
    else:
        j = j.withColumn("__k", result(F.lit(None).cast("string"), "category", "low"))
    sure = F.when(F.col("__k.confidence") != "low", F.col("__k"))
    fixed = result(_fixed(F.col("name_zh"), rules), "default", "high")
    return j.withColumn("f", F.coalesce(fixed, sure, by_faction(F.col("faction"), rules), F.col("__c"), F.col("__k"), _unknown())).select("slug", "f.*")


def voice_phases(voices: DataFrame, defaults: DataFrame, rules: R.PhaseRules = R.ZH) -> DataFrame:
    """voices(slug, text, ..) with phase, inference_source, inference_confidence: content, cluster of the record's voice lines, its default period, unknown.

    One cluster and one default a slug, joined to the lines.
    """
    base = voices.drop("phase", "inference_source", "inference_confidence")
    c = cluster(base, "slug", rules=rules).select(F.col("slug").alias("__s"), F.struct("phase", F.lit("cluster").alias("source"), "confidence").alias("__c"))
    d = defaults.filter("phase <> 'unknown'").groupBy(F.col("slug").alias("__t")).agg(F.min("phase").alias("__d"))
    j = base.join(c, base["slug"] == F.col("__s"), "left").join(d, base["slug"] == F.col("__t"), "left")
    found = F.coalesce(by_pattern(F.col("text"), rules), by_keyword(F.col("text"), rules), F.col("__c"), result(F.col("__d"), "default", "medium"), F.struct(F.lit("unknown").alias("phase"), F.lit("unknown").alias("source"), F.lit("low").alias("confidence")))
    return j.withColumn("__f", found).withColumns({"phase": F.col("__f.phase"), "inference_source": F.col("__f.source"), "inference_confidence": F.col("__f.confidence")}).drop("__f", "__s", "__t", "__c", "__d")


def report(lines: DataFrame) -> DataFrame:
    """kind (phase, source, confidence, total), value, n, pct of inferred lines; values that are missing are 'unknown'."""
    cols = {"phase": "phase", "source": "inference_source", "confidence": "inference_confidence"}
    keyed = lines.select(*[T.missing(c).alias(k) for k, c in cols.items()])
    g = keyed.groupingSets([[F.col("phase")], [F.col("source")], [F.col("confidence")], []], "phase", "source", "confidence").agg(F.count(F.lit(1)).alias("n"), F.grouping_id("phase", "source", "confidence").alias("gid"))
    kind = F.when(F.col("gid") == 3, "phase").when(F.col("gid") == 5, "source").when(F.col("gid") == 6, "confidence").otherwise("total")
    total = lines.agg(F.count(F.lit(1)).alias("total"))
    return g.crossJoin(F.broadcast(total)).select(kind.alias("kind"), F.coalesce("phase", "source", "confidence", F.lit("")).alias("value"), "n", F.bround(F.col("n") / F.nullif("total", F.lit(0)) * 100, 1).alias("pct"))


def suggestions(lines: DataFrame) -> DataFrame:
    """Advice when more than half of the lines have no period, or more than 30 % are inferred with low confidence: suggestion."""
    n = F.count(F.lit(1))
    a = lines.agg((F.count_if(T.missing("phase") == "unknown") / n).alias("u"), (F.count_if(T.missing("inference_confidence") == "low") / n).alias("l"))
    return a.select(F.explode(F.array_compact(F.array(F.when(F.col("u") > 0.5, "add_content_rules"), F.when(F.col("l") > 0.3, "review_low_confidence")))).alias("suggestion"))
