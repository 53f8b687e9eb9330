"""Session defaults, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows below which a prepared lookup side may be broadcast; callers count before hinting.
BROADCAST_ROWS = 200_000
#: Bytes of a materialized side's files above which it isn't broadcast, however few rows it has.
BROADCAST_BYTES = 32 << 20
#: Tables written by materialize() and not yet released.
_written: list[str] = []

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "murmur", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; on a cluster pass no master and let spark-submit decide."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where the setting is missing (tests, local mode)."""
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        d = os.environ.get("MURMUR_LOCAL_SHARED") or tempfile.mkdtemp(prefix="murmur-")
        os.environ["MURMUR_LOCAL_SHARED"] = d
        atexit.register(_remove_local, d)
        d = f"file://{d}"
    return d.rstrip("/")


def _remove_local(d: str) -> None:
    import shutil

    shutil.rmtree(d, ignore_errors=True)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut the lineage: write df once to the shared folder and read it back.

    Unlike a cached or locally checkpointed frame the files outlive any executor. release() deletes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/murmur-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.unregister(_release_at_exit)
        atexit.register(_release_at_exit)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what materialize() wrote in this process, and say how many tables that were.

    Frames made from them can't be read afterwards, so a job calls this when its results are stored. It runs by itself when the
    driver ends in an orderly way.
    """
    sc = spark.sparkContext
    gone = 0
    while _written:
        path = sc._jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += bool(path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _written:
        try:
            release(spark)
        except Exception:  # noqa: BLE001 - the session may be gone already, and the folder with it
            _written.clear()


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df (already materialized, so that this is cheap) has at most `limit` rows and BROADCAST_BYTES of files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES and df.limit(limit + 1).count() <= limit
