"""Session settings, shared working folders and lineage cuts."""

from __future__ import annotations

import re
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"

# Runtime SQL settings the jobs rely on. Shuffle width and file split size stay the cluster's.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # One key may hold a third of a side: split it even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session the caller owns."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Build a single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shelfmark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_shipped: list[object] = []


def ship_package(spark: SparkSession) -> None:
    """Give the workers of this application the package, as ``--py-files`` would, once."""
    context = spark.sparkContext
    if context in _shipped:
        return
    home = Path(__file__).parent
    packed = Path(SparkFiles.getRootDirectory()) / "packed" / "shelfmark.zip"
    packed.parent.mkdir(exist_ok=True)
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(home.rglob("*.py")):
            archive.write(file, file.relative_to(home.parent))
    context.addPyFile(str(packed))  # the driver serves it; no task reads this path
    _shipped[:] = [context]


def shared_root(spark: SparkSession) -> str:
    """Return the folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a folder of this
    application below the warehouse is taken, set as checkpoint folder and removed when the
    application ends; a warehouse on one machine's disk is refused unless the master is local.
    """
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if not configured:
        configured = spark.sparkContext.getConf().get(CHECKPOINT_SETTING)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/work-{spark.sparkContext.applicationId}"
        check_shared(folder, spark.sparkContext.master)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        spark.sparkContext.setCheckpointDir(folder)
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def check_shared(folder: str, master: str) -> None:
    """Refuse a folder on one machine's disk for an application that runs on several machines."""
    one_machine = folder.startswith(("file:", "/"))
    if one_machine and not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors share; {folder} is on one machine")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """Return a new path below the shared folder; nothing exists there yet."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder once and go on from the files.

    A lost executor then costs no replay of the rounds before, and the planner knows the real
    size of what follows.
    """
    return counted_cut(df)[0]


def counted_cut(df: DataFrame) -> tuple[DataFrame, int]:
    """Like ``cut_lineage``, with the row count seen while writing."""
    spark = df.sparkSession
    path = fresh_dir(spark, "cut")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["rows"]
