"""Session settings of the engine."""

from __future__ import annotations

import tempfile
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tessera", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution, UTC and ANSI semantics; settings are Spark properties with _ for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    # Arrow batches of 1,000 rows: with Spark's 10,000 a worker would hold tens of megabytes of texts.
    defaults = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.unionOutputPartitioning": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def plain_unions(spark: SparkSession) -> SparkSession:
    """The session, in which a union of sides that are dealt alike does not count as dealt like these.

    Spark 4.1 takes it for that; but adaptive execution may merge the sides' partitions
    differently, and then a group of the union comes out in two rows.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


#: Bytes of a table's file that a task reads at most: what it groups before a shuffle is in proportion.
SPLIT_BYTES = 32 << 20


def small_splits(spark: SparkSession) -> SparkSession:
    """The session, in which a task reads SPLIT_BYTES of a file at most; one that has set less keeps it."""
    if spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() > SPLIT_BYTES:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only in local mode and if the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: the lineage ends there."""
    path = new_folder(plain_unions(df.sparkSession), name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes all that the engine has written to the shared folder; no result that is still to be computed may need it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tessera")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Run:
    """When a run began, for its record: with Run("name") as run: …; run.record()."""

    def __init__(self, name: str):
        self.name, self.seconds = name, None

    def __enter__(self) -> Run:
        self.began, self._at = datetime.now(UTC), time.monotonic()
        return self

    def __exit__(self, *_) -> None:
        self.seconds = time.monotonic() - self._at

    def record(self) -> dict:
        """Name, start and end in ISO form, and seconds; of a run that goes on, until now."""
        return {"name": self.name, "began": self.began.isoformat(), "ended": datetime.now(UTC).isoformat(), "seconds": round(self.seconds if self.seconds is not None else time.monotonic() - self._at, 3)}
