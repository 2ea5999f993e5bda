"""Session helpers: a local session for tests and bench, and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "ledgerloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench.  A cluster brings its own."""
    return tune(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the wide projections of this package need.

    HotSpot never compiles a method of more than 8000 bytes of bytecode.  Below
    that limit Spark falls back to expression-wise generated code, which is
    compiled; above it the fused method would be interpreted, several times slower.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # Dates and clock windows do not depend on where the driver runs.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts: the cluster's ``spark.checkpoint.dir``.

    A temporary folder is made up only on a local master with nothing set; on a
    cluster a machine-local folder would be lost with its executor, so that is
    an error instead.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir"
    )
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is not None:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="run-ledgerloom-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once under the checkpoint folder and continue from the written table.

    A Parquet table rather than an RDD checkpoint: smaller, and later steps read
    only the columns they need.  Any executor can read it after another is lost.
    """
    return Scratch(df.sparkSession).cut(df)


class Scratch:
    """A folder of written tables under the checkpoint folder, and the owner that removes them.

    ``cut`` writes a table and returns the frame that reads it; ``drop`` removes
    tables no later step reads; ``close`` removes the whole folder, once the
    result that reads from it has been written.  Folders still open when the
    program ends go then, as long as the session is still there.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        atexit.register(self._close_at_exit)
        self.folder = f"{checkpoint_dir(spark).rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"
        self._count = 0

    def path(self, name: str = "table") -> str:
        self._count += 1
        return f"{self.folder}/{self._count}-{name}"

    def cut(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._delete(table._scratch_path)

    def close(self) -> None:
        self._delete(self.folder)
        atexit.unregister(self._close_at_exit)

    def _close_at_exit(self) -> None:
        if SparkContext._active_spark_context is not None:
            self._delete(self.folder)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
