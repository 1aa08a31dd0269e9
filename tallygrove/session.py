"""Session defaults and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(cores: int | None = None, app: str = "tallygrove", **extra: str) -> SparkSession:
    """A session with the engine's defaults. What was submitted (spark-submit, `--conf`, spark-defaults.conf) wins over
    them, arguments win over both. Outside local mode neither master nor partition count is set here."""
    first = SparkConf(loadDefaults=False)
    first.set("spark.driver.memory", os.environ.get("TALLYGROVE_DRIVER_MEMORY", "8g"))
    SparkContext._ensure_initialized(conf=first)  # noqa: SLF001  later `--conf` arguments override this one
    submitted = dict(SparkConf(_jvm=SparkContext._jvm).getAll())  # noqa: SLF001
    cores = cores or os.cpu_count() or 4
    wanted = dict(DEFAULTS)
    master = submitted.get("spark.master", "local[*]")
    if master == "local[*]":
        wanted["spark.master"] = f"local[{cores}]"
        submitted.pop("spark.master", None)
    if is_local(master):
        wanted["spark.sql.shuffle.partitions"] = str(cores)
    builder = SparkSession.builder.appName(app)
    for key, value in {**wanted, **{k: v for k, v in submitted.items() if k in wanted}, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable for the Python workers of every executor, wherever they start. Sessions that were not
    made here need it called once, or the package on the workers' path."""
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tallygrove-package-")
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "tallygrove"), "zip", os.path.dirname(root), os.path.basename(root)))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch it when they start


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only in local mode a temporary one may stand in for it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tallygrove-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Stash:
    """Tables written to the shared folder to cut lineage: they survive lost executors and are smaller than row
    checkpoints. `drop` removes tables that no later step reads; the rest goes with the application."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
        self.count = 0

    def _path(self, path: str) -> tuple:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        if not self.count:
            root, files = self._path(self.root)
            files.mkdirs(root)
            files.deleteOnExit(root)
        path = f"{self.root}/{self.count:04d}-{name}"
        self.count += 1
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stash_path = path  # noqa: SLF001
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            path = getattr(df, "_stash_path", None)
            if path:
                target, files = self._path(path)
                files.delete(target, True)


def plan_bytes(df: DataFrame) -> int:
    """The bytes of the tables that a frame reads, by the optimizer's statistics; no job runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()  # noqa: SLF001
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
