"""Readers and writers. Every reader has an explicit schema and gives NULL or default for what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import hub

RECORD = "name_zh string, name_en string, slug string, page_type string, source_url string, source string, lang string, faction string, gender string, combat_experience string, birthplace string, birthday string, race string, height string, infection_status string, is_infected string, fetch_time string, voice_lines array<struct<label:string,text:string>>, archives array<struct<index:int,title:string,text:string>>"
STORY = "dialogues array<struct<speaker:string,text:string,narration:array<string>,scene:string,is_target:boolean,reply_to:string,situation_type:string,phase:string>>"


def pages(spark: SparkSession, path: str) -> DataFrame:
    """path, value: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def labelled_text(spark: SparkSession, path: str) -> DataFrame:
    """path, n, label, text of 'label: text' files."""
    return hub.label_split(pages(spark, path).withColumnRenamed("value", "text"), "path")


def labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """path, n, label, text split at the first comma; a first row that speaks of labels is a header."""
    rows = hub.first_comma(pages(spark, path).withColumnRenamed("value", "text"), "path")
    return rows.filter("not (n = 1 and lower(concat(label, ',', text)) like '%label%')")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Character records of JSON files."""
    return spark.read.schema(RECORD).json(path, multiLine=True)


def voice_or_archive(recs: DataFrame) -> DataFrame:
    """slug, pos, label, text: a record's voice lines, or its archives (labelled by index) where it has none."""
    voices = F.transform("voice_lines", lambda v: F.struct(v["label"].alias("label"), v["text"].alias("text")))
    old = F.transform("archives", lambda a: F.struct(a["index"].cast("string").alias("label"), a["text"].alias("text")))
    return recs.select("slug", F.posexplode(F.when(F.size("voice_lines") > 0, voices).otherwise(old)).alias("pos", "x")).select("slug", "pos", "x.*")


def stories(spark: SparkSession, path: str) -> DataFrame:
    """path, pos and the fields of each story line, defaults filled."""
    d = spark.read.schema(STORY).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode("dialogues").alias("pos", "l")).select("path", "pos", "l.*")
    return d.fillna({"text": "", "is_target": False}).withColumn("narration", F.coalesce("narration", F.array().cast("array<string>")))


#: The periods that stand in where a page names none.
DEFAULT_PERIODS = [("early", "early"), ("babel", "babel"), ("resurrected", "resurrected")]


def timeline(texts: DataFrame) -> DataFrame:
    """path, ord, range, label of '### 1031-1094 label' headings; three default periods for a page without any."""
    p = r"###\s*(\d{3,4})\s*[-–—]\s*(\d{3,4})\s*(.+)"
    g = lambda i: F.regexp_extract_all("value", F.lit(p), F.lit(i))
    found = F.transform(F.arrays_zip(g(1).alias("a"), g(2).alias("b"), g(3).alias("c")), lambda x: F.struct(F.concat_ws("-", x["a"], x["b"]).alias("range"), T.strip(x["c"]).alias("label")))
    default = F.array(*[F.struct(F.lit("").alias("range"), F.lit(label).alias("label")) for _, label in DEFAULT_PERIODS])
    return texts.select("path", F.posexplode(F.when(F.size(found) > 0, found).otherwise(default)).alias("ord", "x")).select("path", "ord", "x.*")


def sections(texts: DataFrame) -> DataFrame:
    """path, k, section of more than 20 characters: Markdown at headings, plain text at blank lines, else the whole."""
    md = F.rlike("value", F.lit(r"(?m)^#+\s+"))
    parts = lambda p: F.filter(F.transform(F.split("value", p), T.strip), lambda x: F.length(x) > 20)
    chosen = F.when(md, parts(r"(?m)^#+\s+")).otherwise(parts(r"\n\s*\n"))
    return texts.select("path", F.posexplode(F.when(F.size(chosen) > 0, chosen).otherwise(F.array(T.strip(F.col("value"))))).alias("k", "section"))


def frontmatter(texts: DataFrame) -> DataFrame:
    """path, map of 'key: value' lines between the leading --- marks."""
    head = F.regexp_extract("value", r"(?s)\A---\s*\n(.*?)\n---", 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: F.contains(x, F.lit(":")))
    return texts.select("path", F.map_from_entries(F.transform(pairs, lambda x: F.struct(T.strip(F.substring_index(x, ":", 1)).alias("key"), T.strip(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))).alias("fields"))


def dialogue_texts(spark: SparkSession, path: str, kind: str = "plain") -> DataFrame:
    """path, n, text of spoken lines only: kind plain ('label: text'), csv, or json (a record's voice lines, empty ones left out)."""
    if kind == "json":
        rec = records(spark, path).select(F.col("_metadata.file_path").alias("path"), F.posexplode("voice_lines").alias("n", "v"))
        return rec.select("path", (F.col("n") + 1).cast("bigint").alias("n"), F.col("v.text").alias("text")).filter("text <> ''")
    return (labelled_csv if kind == "csv" else labelled_text)(spark, path).select("path", "n", "text")


def local_records(texts: DataFrame) -> DataFrame:
    """path, fields: a Markdown page's front matter and a section_{title} for each heading; of equal keys the last holds.

    Quotation marks around values go. What stands before the first heading is no section. NULL pages have no fields.
    """
    head = F.regexp_extract("value", r"(?s)\A---\s*\n(.*?)\n---\s*\n", 1)
    pairs = F.transform(F.filter(F.split(head, "\n"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(T.strip(F.substring_index(x, ":", 1)).alias("key"), F.regexp_replace(F.regexp_replace(T.strip(F.regexp_replace(x, r"^[^:]*:", "")), r'^"+|"+$', ""), "^'+|'+$", "").alias("value")))
    parts = F.split("value", r"(?m)^#+\s+")
    titled = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda x: F.struct(F.concat(F.lit("section_"), T.strip(F.substring_index(x, "\n", 1))).alias("key"), F.when(F.contains(x, F.lit("\n")), T.strip(F.regexp_replace(x, r"^[^\n]*\n", ""))).otherwise("").alias("value")))
    every = F.concat(pairs, titled)
    keep = F.filter(every, lambda e, i: ~F.exists(F.slice(every, i + 2, F.greatest(F.size(every), F.lit(1))), lambda later: later["key"] == e["key"]))
    return texts.select("path", F.map_from_entries(keep).alias("fields"))


def write_acts(lines: DataFrame, path: str) -> None:
    """The hub with its speech acts classified anew (archives have none), to a new place: nothing is written over what is read."""
    from ..operators import speech

    none = F.array().cast("array<struct<type:string,label:string,confidence:double>>")
    spoken = F.col("source").isNull() | (F.col("source") != "archive")
    write_hub(lines.withColumn("speech_acts", F.when(spoken, speech.acts_of(F.col("text"))).otherwise(none)), path)


def write_relations(edges: DataFrame, path: str) -> None:
    """Annotated relations as Parquet, sorted by their ends inside each file."""
    edges.sortWithinPartitions("src", "dst", "type").write.mode("errorifexists").parquet(path)


def write_reports(reports: dict[str, DataFrame], path: str) -> None:
    """Named reports (fingerprint, slices, validation, canon, ..) as JSON lines, each in its own folder."""
    for name, df in reports.items():
        write_json(df, f"{path.rstrip('/')}/{name}")


def write_hub(lines: DataFrame, path: str) -> None:
    """The hub as Parquet by source, without inference columns, so that later reads prune."""
    lines.drop("inference_source", "inference_confidence").write.partitionBy("source").mode("errorifexists").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    df.write.mode("errorifexists").json(path)
