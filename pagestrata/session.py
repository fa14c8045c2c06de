"""Session settings and lineage cutting."""

from __future__ import annotations

import json
import logging
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pagestrata.errors import AuditError

# Runtime settings every job wants: adaptive plans, skew splitting, UTC clocks, Arrow transfer.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Pages and records may be large: a batch ends at so many bytes, whatever its rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}


def build_session(app: str = "pagestrata", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the runtime settings; ``master`` is left to spark-submit on a cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pagestrata-checkpoint-"))
    else:
        raise AuditError("CHECKPOINT_DIR_MISSING", "Set spark.checkpoint.dir to a folder every executor can reach.")


def checkpoint_folder(spark: SparkSession) -> str:
    """A new place in the shared checkpoint folder."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from there.

    Later steps survive lost executors, read only the columns they use, and know the size of what
    they join.
    """
    spark = df.sparkSession
    path = checkpoint_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class BucketedTable:
    """Rows in the shared checkpoint folder, dealt into buckets by their keys once.

    Joins on the keys read the buckets as they lie, without a shuffle. ``append`` adds rows under a
    new value of ``part``, a partition column, so that the rows of one append can be read alone.
    """

    def __init__(self, spark: SparkSession, keys: list[str], part: str | None = None):
        _ensure_checkpoint_dir(spark)
        self.spark, self.keys, self.part = spark, keys, part
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"pagestrata_{uuid.uuid4().hex}"
        self.path = f"{spark.sparkContext.getCheckpointDir()}/{self.name}"

    def append(self, df: DataFrame, distinct: bool = False) -> int:
        """Writes rows and tells how many there were; with ``distinct`` equal ones once, found where they lie after the shuffle."""
        seen = Observation()
        rows = df.repartition(self.buckets, *self.keys)
        rows = (rows.distinct() if distinct else rows).observe(seen, F.count(F.lit(1)).alias("rows"))
        writer = rows.write.mode("append").format("parquet").option("path", self.path).bucketBy(self.buckets, *self.keys)
        (writer.partitionBy(self.part) if self.part else writer).saveAsTable(self.name)
        return seen.get["rows"]

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def closed(self) -> DataFrame:
        """The rows by their path; the name is given up, the files stay."""
        rows = self.spark.read.schema(self.rows().schema).parquet(self.path)
        self.spark.sql(f"DROP TABLE {self.name}")
        return rows


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deals rows out over all cores where the input comes in fewer partitions than there are cores.

    For work that is heavy per row, on inputs of few row groups; a large input stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def progress(stage: str, status: str, **facts) -> None:
    """One JSON line per stage on the package's logger."""
    logging.getLogger("pagestrata").info(json.dumps({"stage": stage, "status": status, **facts}, default=str))


def with_deadlines(spark: SparkSession, work: dict[str, Callable[[], DataFrame]], seconds: float | None = None) -> dict[str, DataFrame | Exception]:
    """Runs and writes out several sources side by side; a source that fails or is late is an error value.

    Without ``seconds`` every source is waited for. The jobs of a late source are cancelled by their tag,
    the others go on.
    """
    results: dict[str, DataFrame | Exception] = {}
    # Open the folder before the threads do.
    _ensure_checkpoint_dir(spark)

    def run(name: str, tag: str, read: Callable[[], DataFrame]) -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            outcome = cut_lineage(read())
        except Exception as error:  # one source must not stop the others
            outcome = error
        results.setdefault(name, outcome)

    threads = {}
    for name, read in work.items():
        tag = f"source-{uuid.uuid4().hex}"
        thread = InheritableThread(target=run, args=(name, tag, read), daemon=True)
        threads[name] = (thread, tag)
        thread.start()
    end = None if seconds is None else time.monotonic() + seconds
    for name, (thread, tag) in threads.items():
        thread.join(None if end is None else max(0.0, end - time.monotonic()))
        if thread.is_alive():
            late = AuditError("ARCHIVE_TIMEOUT", f"Source {name} exceeded its deadline of {seconds:g} seconds.")
            results.setdefault(name, late)
            spark.sparkContext.cancelJobsWithTag(tag)
    return {name: results[name] for name in work}
