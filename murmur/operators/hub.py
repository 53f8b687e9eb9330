"""The hub of annotated lines: dialogue from scripts and pages, reply and scene windows, union and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..session import materialize
from . import phase as P

# Commands of a script that end a speaker's part, and commands taken out of it.
_STOP = r"\[name=|\[dialog\]|\[Decision\]|\[HEADER\]|\[Blocker\]|\[stopmusic\]|\[playMusic\]|\z"
_NOISE = r"\[(?:charslot|Camera|Image|Background|PlaySound|playsound|playMusic|PlayMusic|stopmusic|StopMusic|SoundVolume|soundchannel|SoundChannel|Blocker|Delay|delay|dialog|Dialog|Decision|Predicate|HEADER|Sticker|subtitle|showitem|Hideitem|character|Character|action|MoveScreen)[^\]]*\]"
_NARRATION = "[（(](.+?)[）)]"


def script_lines(pages: DataFrame) -> DataFrame:
    """Dialogue of [name="X"] scripts: path, pos, speaker, text, narration (array). pages: path, value.

    What stands in brackets becomes narration, other commands go; lines without text are left out. NULL pages give none.
    """
    pairs = F.arrays_zip(F.expr(r"""regexp_extract_all(value, '\\[name="([^"]+)"\\]', 1)""").alias("who"), F.expr(rf"""regexp_extract_all(value, '(?s)\\[name="[^"]+"\\](.*?)(?={_STOP.replace(chr(92), chr(92) * 2)})', 1)""").alias("said"))
    raw = pages.select("path", F.posexplode(pairs).alias("pos", "p")).select("path", "pos", F.col("p.who").alias("speaker"), F.col("p.said").alias("said"))
    body = F.regexp_replace("said", _NOISE, "")
    text = F.regexp_replace(F.regexp_replace(body, _NARRATION, ""), r"\[[^\]]*\]", "")
    text = F.array_join(F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: x != ""), "\n")
    return raw.select("path", "pos", T.strip(F.col("speaker")).alias("speaker"), text.alias("text"), F.regexp_extract_all(body, F.lit(_NARRATION), F.lit(1)).alias("narration")).filter("text <> ''")


def wiki_lines(pages: DataFrame) -> DataFrame:
    """Dialogue of '''X'''：text pages, line by line, with the scene of the last header above: path, pos, speaker, text, scene."""
    quote = r"^['‘’]{2,3}(.+?)['‘’]{2,3}[：:]\s*(.+?)\s*$"
    rows = pages.select("path", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    head = F.when(F.rlike("line", F.lit(r"^={2,4}\s*(.*?)\s*={2,4}")), F.regexp_extract("line", r"^={2,4}\s*(.*?)\s*={2,4}", 1))
    seen = rows.withColumn("scene", F.last(head, ignorenulls=True).over(Window.partitionBy("path").orderBy("pos")))
    return seen.filter(F.rlike("line", F.lit(quote))).select("path", "pos", T.strip(F.regexp_extract("line", quote, 1)).alias("speaker"), T.strip(F.regexp_extract("line", quote, 2)).alias("text"), "scene")


def dialogues(pages: DataFrame, target: str) -> DataFrame:
    """Both formats by what the page holds, with is_target and reply_to: path, pos, speaker, text, narration, scene, is_target, reply_to."""
    script = F.contains("value", F.lit('[name="'))
    a = script_lines(pages.filter(script)).withColumn("scene", F.lit(None).cast("string"))
    b = wiki_lines(pages.filter(~script)).withColumn("narration", F.array().cast("array<string>"))
    both = a.unionByName(b).withColumn("is_target", F.contains("speaker", F.lit(target)))
    return reply_to(both, "path", "reply_to", ["pos"])


def reply_to(lines: DataFrame, part: str, out: str, order: list[str]) -> DataFrame:
    """For a target's line the next speaker if that is another, else the one before if that is another, else NULL."""
    w = Window.partitionBy(part).orderBy(*order)
    nxt = F.when(~F.lead("is_target").over(w), F.lead("speaker").over(w))
    prv = F.when(~F.lag("is_target").over(w), F.lag("speaker").over(w))
    return lines.withColumn(out, F.when(F.col("is_target"), F.coalesce(nxt, prv)))


def once(lines: DataFrame, key: str, newest: str | None = None) -> DataFrame:
    """Rows stored twice kept once (the newest if told); rows with a NULL key all stay."""
    if newest is None:
        kept = lines.filter(F.col(key).isNotNull()).dropDuplicates([key])
    else:
        kept = lines.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[c for c in lines.columns if c != key]), newest).alias("__r")).select(key, "__r.*").select(*lines.columns)
    return kept.unionByName(lines.filter(F.col(key).isNull()))


def scene_asof(lines: DataFrame, part: str, order: list[str], out: str = "scene_now") -> DataFrame:
    """The last scene named at or before each line of its part; NULL before the first."""
    return lines.withColumn(out, F.last(F.nullif("scene", F.lit("")), ignorenulls=True).over(Window.partitionBy(part).orderBy(*order)))


def situation(scene: Column, text: Column, narration: Column) -> Column:
    """First kind of situation of which any word stands in scene, text or narration; casual."""
    whole = F.concat_ws(" ", scene, text, F.array_join(narration, " "))
    return F.coalesce(T.first_words(whole, [(k, R.words(w)) for k, w in R.SITUATIONS.items()]), F.lit("casual"))


def voice_context(title: Column) -> tuple[Column, Column]:
    """(interlocutor, situation) a voice line's title tells."""
    t = F.coalesce(title, F.lit(""))
    return T.first_match(t, R.VOICE_INTERLOCUTOR), T.first_match(t, R.VOICE_SITUATION, "casual")


def number_within(rows: DataFrame, part: list[str], major: str, order: list[str], out: str = "n", width: int = 4096) -> DataFrame:
    """rows with `out`: their number from 0 within `part`, in the order of major (an integer, NULL first) and then `order`.

    In two levels, so that a hot part is no one task's: rows are numbered inside ranges of `width` values of major, and
    the ranges of a part, which are few, by the number of rows before them. Rows of one major value (also of NULL) stay in one range.
    """
    ranged = rows.withColumn("__range", F.floor(F.coalesce(F.col(major), F.lit(-1)) / width))
    sizes = ranged.groupBy(*part, "__range").agg(F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*part).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*[F.col(p).alias(f"__{p}") for p in part], F.col("__range").alias("__r"), F.coalesce(before, F.lit(0)).alias("__before"))
    same = F.col("__range") == F.col("__r")
    for p in part:
        same = same & F.col(p).eqNullSafe(F.col(f"__{p}"))
    inner = F.row_number().over(Window.partitionBy(*part, "__range").orderBy(F.col(major).asc_nulls_first(), *order)) - 1
    return ranged.withColumn("__i", inner).join(offsets, same).withColumn(out, F.col("__before") + F.col("__i")).drop("__range", "__r", "__before", "__i", *[f"__{p}" for p in part])


def running_totals(sizes: DataFrame, key: str, n: str, out: str = "before") -> DataFrame:
    """sizes(key, n) with `out`: the sum of n over all smaller keys. Keys are range-partitioned and written, summed inside each
    partition, and only the partitions' totals go through one task."""
    ranged = materialize(sizes.repartitionByRange(key).withColumn("__p", F.spark_partition_id()), "hub")
    w = lambda *by: Window.partitionBy(*by).orderBy(key if by else "__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__p").agg(F.sum(n).alias("__t")).withColumn("__o", F.coalesce(F.sum("__t").over(w()), F.lit(0))).select(F.col("__p").alias("__q"), "__o")
    return ranged.withColumn("__i", F.coalesce(F.sum(n).over(w("__p")), F.lit(0))).join(F.broadcast(totals), F.col("__p") == F.col("__q")).withColumn(out, F.col("__o") + F.col("__i")).drop("__p", "__q", "__o", "__i")


def hub(voice_and_archive: DataFrame, story: DataFrame) -> DataFrame:
    """Union of voice lines, story lines of targets and archives: part, line_id, text, source, source_detail, scene, interlocutor, situation_type, phase, narration.

    Identifiers count from 0: voice lines and archives within their record by idx (archives with empty text keep their
    number and are left out), story lines through all stories in order of story_id. Neither a hot record nor all
    stories are ever numbered in one task. Story lines keep their period; voice lines have NULL till it is inferred.
    """
    data = once(voice_and_archive, "rec_id")
    who, what = voice_context(F.col("title"))
    number = lambda prefix, n: F.concat(F.lit(prefix), F.lpad(n.cast("string"), F.greatest(F.lit(3), F.length(n.cast("string"))), F.lit("0")))
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    counted = number_within(data.filter("kind = 'archive' or coalesce(text, '') <> ''"), ["slug", "kind"], "idx", ["rec_id"])
    voices = counted.filter("kind = 'voice'").select(F.col("slug").alias("part"), number("V", F.col("n")).alias("line_id"), "text", F.lit("voice").alias("source"), F.col("title").alias("source_detail"), F.col("title").alias("scene"), who.alias("interlocutor"), what.alias("situation_type"), none.alias("phase"), empty.alias("narration"))
    archives = counted.filter("kind = 'archive' and coalesce(text, '') <> ''").select(F.col("slug").alias("part"), number("A", F.col("n")).alias("line_id"), "text", F.lit("archive").alias("source"), F.col("title").alias("source_detail"), F.lit("档案").alias("scene"), none.alias("interlocutor"), F.lit("casual").alias("situation_type"), F.lit("unknown").alias("phase"), empty.alias("narration"))
    lines = once(story, "row_id").filter("is_target")
    offsets = running_totals(lines.groupBy("story_id").agg(F.count(F.lit(1)).alias("__n")), "story_id", "__n", "__before").select(F.col("story_id").alias("__story"), "__before")
    numbered = number_within(lines, ["story_id"], "pos", ["row_id"], "__k").join(offsets, F.col("story_id") == F.col("__story")).withColumn("n", F.col("__before") + F.col("__k"))
    stories = numbered.select(F.col("story_id").alias("part"), number("S", F.col("n")).alias("line_id"), "text", F.lit("story").alias("source"), F.col("story_id").alias("source_detail"), "scene", F.nullif("reply_to", F.lit("")).alias("interlocutor"), situation(F.col("scene"), F.col("text"), F.col("narration")).alias("situation_type"), T.missing("phase").alias("phase"), F.coalesce("narration", empty).alias("narration"))
    return voices.unionByName(stories).unionByName(archives)


def context(records: DataFrame, voice_and_archive: DataFrame, story: DataFrame, categories: DataFrame | None = None, rules: R.PhaseRules = R.ZH) -> DataFrame:
    """The whole hub with periods: hub()'s columns with phase, inference_source and inference_confidence.

    Voice lines get theirs by content, the cluster of their record's voice lines or their record's default period;
    story lines keep theirs, archives have none. Only voice lines have an inference.
    """
    lines = hub(voice_and_archive, story)
    voices = lines.filter("source = 'voice'").withColumnRenamed("part", "slug")
    defaults = P.default_phase(records, voices.select("slug", "text"), categories, rules)
    told = P.voice_phases(voices, defaults, rules).withColumnRenamed("slug", "part")
    none = F.lit(None).cast("string")
    return told.unionByName(lines.filter("source <> 'voice'").withColumns({"inference_source": none, "inference_confidence": none}))


def distributions(lines: DataFrame) -> DataFrame:
    """kind (source, phase, situation_type), value, n: lines by source, by situation, and by period without archives."""
    keyed = lines.select(*[T.missing(c).alias(c) for c in ("source", "phase", "situation_type")])
    live = F.count_if(F.col("__live"))
    g = keyed.withColumn("__live", F.col("source") != "archive").groupingSets([[F.col("source")], [F.col("phase")], [F.col("situation_type")]], "source", "phase", "situation_type")
    g = g.agg(F.count(F.lit(1)).alias("every"), live.alias("live"), F.grouping_id("source", "phase", "situation_type").alias("gid"))
    out = g.select(F.when(F.col("gid") == 3, "source").when(F.col("gid") == 5, "phase").otherwise("situation_type").alias("kind"), F.coalesce("source", "phase", "situation_type").alias("value"), F.when(F.col("gid") == 5, F.col("live")).otherwise(F.col("every")).alias("n"))
    return out.filter("n > 0")


def label_split(texts: DataFrame, key: str) -> DataFrame:
    """key, n (line, from 1), label, text of 'label: text' lines; blank lines and comments are left out.

    The first of ':', '：' and '|' that a line has, in that priority, splits it; a line without is labelled line_n.
    """
    rows = texts.select(key, F.posexplode(F.split("text", "\n")).alias("p", "l")).select(key, (F.col("p") + 1).alias("n"), T.strip(F.col("l")).alias("l")).filter("l <> '' and not startswith(l, '#')")
    label, rest = F.concat(F.lit("line_"), F.col("n").cast("string")), F.col("l")
    for sep in ("|", "：", ":"):
        at = F.locate(sep, "l")
        label = F.when(at > 0, T.strip(F.expr(f"substring(l, 1, locate('{sep}', l) - 1)"))).otherwise(label)
        rest = F.when(at > 0, T.strip(F.expr(f"substring(l, locate('{sep}', l) + 1)"))).otherwise(rest)
    return rows.select(key, F.col("n").cast("bigint").alias("n"), label.alias("label"), rest.alias("text"))


def first_comma(texts: DataFrame, key: str) -> DataFrame:
    """key, n, label, text of lines split at the first comma only; a line without one is labelled line_n; blank lines are left out."""
    rows = texts.select(key, F.posexplode(F.split("text", "\n")).alias("p", "l")).select(key, (F.col("p") + 1).cast("bigint").alias("n"), T.strip(F.col("l")).alias("l")).filter("l <> ''")
    has = F.contains("l", F.lit(","))
    return rows.select(key, "n", F.when(has, T.strip(F.split("l", ",", 2)[0])).otherwise(F.concat(F.lit("line_"), F.col("n").cast("string"))).alias("label"), F.when(has, T.strip(F.split("l", ",", 2)[1])).otherwise(F.col("l")).alias("text"))
