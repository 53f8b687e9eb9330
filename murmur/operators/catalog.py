"""Catalogue rows and versions of products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_version(c: Column) -> Column:
    """v{major}.{minor}; a number alone is a major; anything else gets the prefix v."""
    v = F.regexp_replace(F.trim(c), "^v", "")
    return F.when(F.rlike(v, F.lit(r"^\d+\.\d+$")), F.concat(F.lit("v"), v)).when(F.rlike(v, F.lit(r"^\d+$")), F.concat(F.lit("v"), v, F.lit(".0"))).otherwise(F.concat(F.lit("v"), v))


def next_version(versions: DataFrame, key: str, version: str = "version") -> DataFrame:
    """key, next: one minor above the highest version; v1.0 where there is none. An old vN counts as minor N of major 1."""
    parts = F.when(F.rlike(version, F.lit(r"^v\d+\.\d+$")), F.struct(F.regexp_extract(version, r"^v(\d+)", 1).cast("int").alias("major"), F.regexp_extract(version, r"\.(\d+)$", 1).cast("int").alias("minor"))).when(F.rlike(version, F.lit(r"^v\d+$")), F.struct(F.lit(1).alias("major"), F.regexp_extract(version, r"^v(\d+)$", 1).cast("int").alias("minor")))
    top = versions.groupBy(key).agg(F.max(parts).alias("t"))
    return top.select(key, F.when(F.col("t").isNull(), "v1.0").otherwise(F.concat(F.lit("v"), F.greatest(F.col("t.major"), F.lit(1)).cast("string"), F.lit("."), (F.col("t.minor") + 1).cast("string"))).alias("next"))


def listing(records: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """slug and the given columns with defaults for NULL and ''; hidden slugs and 'versions' are left out."""
    return records.filter("slug is not null and not startswith(slug, '.') and slug <> 'versions'").select("slug", *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)).alias(c) for c, d in defaults.items()])


def snapshot(df: DataFrame, path: str, version: str) -> None:
    """Store a version beside the others; nothing that is there is overwritten."""
    df.write.mode("errorifexists").parquet(f"{path}/version={version}")


def restore(spark, path: str, version: str) -> DataFrame:  # noqa: ANN001
    """A stored version."""
    return spark.read.parquet(f"{path}/version={version}")


def latest(df: DataFrame, key: str, version: str = "version") -> DataFrame:
    """The newest row of each key, versions compared by number."""
    n = F.struct(F.regexp_extract(version, r"v(\d+)", 1).cast("int").alias("a"), F.coalesce(F.nullif(F.regexp_extract(version, r"\.(\d+)$", 1), F.lit("")).cast("int"), F.lit(0)).alias("b"))
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), n).alias("__r")).select(key, "__r.*")


def version_list(stored: DataFrame, key: str, version: str = "version") -> DataFrame:
    """key, versions: the different versions of each key that begin with v, in the order of their letters (v1.10 before v1.2)."""
    return stored.filter(F.startswith(version, F.lit("v"))).groupBy(key).agg(F.array_sort(F.collect_set(version)).alias("versions"))


def scaffold(names: DataFrame, now: Column | None = None) -> DataFrame:
    """slug, name, name_en, created_at, updated_at, version, profile, tags, impression, corrections_count of new products: everything unknown yet."""
    when = F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    unknown, none = F.lit("unknown"), F.array().cast("array<string>")
    profile = F.struct(unknown.alias("faction"), unknown.alias("identity"), unknown.alias("mbti"), none.alias("key_relationships"))
    tags = F.struct(none.alias("personality"), none.alias("leadership"), none.alias("philosophy"))
    return names.select("slug", "name", F.coalesce("name_en", F.lit("")).alias("name_en"), when.alias("created_at"), when.alias("updated_at"), F.lit("v1.0").alias("version"), profile.alias("profile"), tags.alias("tags"), F.lit("").alias("impression"), F.lit(0).alias("corrections_count"))


#: Files that a product must have.
REQUIRED = ["SKILL.md", "meta.json"]


def missing_files(files: DataFrame, required: list[str] | None = None) -> DataFrame:
    """slug, missing: the required files that files(slug, file) lacks, for every slug that lacks one."""
    need = F.array(*[F.lit(x) for x in (REQUIRED if required is None else required)])
    have = files.groupBy("slug").agg(F.collect_set("file").alias("__f"))
    return have.select("slug", F.array_except(need, "__f").alias("missing")).filter("size(missing) > 0")


def rolled_back(meta: DataFrame, version: str) -> DataFrame:
    """meta with rolled_back_from (the version before), rolled_back_to and the new version."""
    to = normal_version(F.lit(version))
    return meta.withColumns({"rolled_back_from": F.coalesce("version", F.lit("unknown")), "rolled_back_to": to, "version": to})
