"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
BLOCK_ROWS_CONF = "runledger.block.rows"
DEFAULT_BLOCK_ROWS = 4_000_000


def local_session(app: str = "runledger", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for tables that cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. A machine-local folder is
    made only for a local master, where there is no other machine.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    named = tempfile.mkdtemp(prefix="runledger-")
    atexit.register(shutil.rmtree, named, ignore_errors=True)
    spark.conf.set(CHECKPOINT_CONF, named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "step", replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used by loops and wherever a result is consumed twice. Parquet in place of
    ``checkpoint()`` gives the next plan true sizes and column pruning. ``replaces`` is a
    table of an earlier ``cut`` that nothing needs any more once this one is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    if replaces is not None:
        drop_cut(replaces)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def drop_cut(table: DataFrame) -> None:
    """Delete the files of a ``cut`` table; any other DataFrame is left alone."""
    path = getattr(table, "_cut_path", None)
    if path is not None:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def block_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BLOCK_ROWS_CONF, str(DEFAULT_BLOCK_ROWS)))
