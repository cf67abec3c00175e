"""Session settings and reliable lineage cuts."""

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores="*", shuffle_partitions=8, memory="16g") -> SparkSession:
    """Single-machine session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("threatloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, for a cluster that does not have it installed."""
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="threatloom-ship-"), "threatloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written copy.

    The folder is the session's ``spark.checkpoint.dir``. Only a local master may fall back
    to a folder of its own, because no other machine has to read it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            folder = tempfile.mkdtemp(prefix="threatloom-checkpoint-")
        context.setCheckpointDir(folder)
    return _released(df)


# Spark removes the shuffle files of a query that ends while this is set (from 4.1 on; unknown and unused before).
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _released(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` that leaves no shuffle files behind.

    Nothing reads them once the copy is written, but Spark keeps them until the driver happens to collect
    garbage, so a job of many steps fills the executors' disks with all of them. The setting is taken up when
    a frame is made, so it holds for a frame of its own and not for the caller's.
    """
    conf = df.sparkSession.conf
    before = conf.get(RELEASE, None)
    conf.set(RELEASE, "true")
    try:
        own = df.select("*")
        return own.checkpoint()
    finally:
        if before is None:
            conf.unset(RELEASE)
        else:
            conf.set(RELEASE, before)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for tables that one step writes and the next reads."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        checkpointed(spark.range(1))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
