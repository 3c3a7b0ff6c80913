"""Session helpers: table access, the shared scratch folder and written intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def builder(master: str = "local[*]", partitions: int = 8, memory: str = "8g"):
    """Builder with the settings the engine is designed for (AQE, UTC, zstd shuffle)."""
    return (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the master is
    local (tests, notebooks) a temporary folder is made; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="occuspan-")
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir() or made


def _fs_delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application's written tables; removed when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{shared_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"

        def clean() -> None:
            try:
                _fs_delete(spark, _ROOTS[app])
            except Exception:  # the JVM may be gone already
                pass

        atexit.register(clean)
    return _ROOTS[app]


class Written:
    """A table in the shared folder: cuts lineage, survives lost executors, can be dropped early."""

    def __init__(self, df: DataFrame, partition_by: str | None = None):
        self.spark = df.sparkSession
        self.path = f"{scratch_root(self.spark)}/{uuid.uuid4().hex}"
        w = df.write.option("compression", "zstd")
        (w.partitionBy(partition_by) if partition_by else w).parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        _fs_delete(self.spark, self.path)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    return Written(df).df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores, for steps whose cost is CPU and not bytes.

    An input with enough partitions is left as it is, so large data isn't shuffled; a small file with one row group would
    else run in one task. A plan that shuffles already is left alone too: asking for its partitions would run it.
    The rows are the same either way.
    """
    if df._jdf.queryExecution().executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
