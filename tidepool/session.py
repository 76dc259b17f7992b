"""Session helpers: defaults every job relies on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that change results, not only speed: all dates are rendered in UTC.
RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# Runtime re-planning: partition coalescing, skew-join splitting and
# broadcast conversion once the real size of a shuffle side is known.
PLANNER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows are handed to Python by bytes, not only by number: long texts do not add up there.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def build_session(app: str = "tidepool", master: str | None = None,
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine's defaults.

    On a cluster, ``master`` stays None and the launcher decides; tests pass
    ``local[*]``.  The UI is off: jobs here are batch and nothing serves pages.
    """
    builder = (SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**RESULT_CONF, **PLANNER_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    prepare(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers.

    The package's own files are zipped on the driver and added to the job, once
    for each Spark application; Arrow functions then work wherever the driver
    was started and whether or not the package is installed on the executors.
    """
    import zipfile
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tidepool-ship-"), "tidepool.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    out.write(file, os.path.relpath(file, os.path.dirname(package)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Apply result-affecting runtime settings to a session we did not build,
    and see that its executors can import this package."""
    ship_package(spark)
    for k, v in RESULT_CONF.items():
        spark.conf.set(k, v)
    for k, v in PLANNER_CONF.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The setting is read from the session.  Only a local-mode session (tests,
    single machine) gets a private folder when it is unset; a cluster job
    without a shared folder is refused, because executor-local paths vanish
    with the executor.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if conf_dir:
        if not current:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if current:
        return current
    if not _is_local(spark):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) so checkpoints and staged tables survive executor loss")
    local = tempfile.mkdtemp(prefix="tidepool-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for staged tables."""
    base = checkpoint_dir(spark)
    # The checkpoint dir set through SparkContext gains a uuid sub-folder;
    # staged tables live beside it under our own prefix.
    return os.path.join(base.rstrip("/"), "tidepool-stage", f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    """Parts that a shuffle of this session has before any are put together."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; a folder of parquet parts or a single parquet file."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
