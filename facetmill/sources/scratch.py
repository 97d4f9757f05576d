"""Written tables in the cluster's shared folder.

Iterative operators cut their lineage by writing an intermediate result and reading it again. The
folder is the one the session names in ``spark.checkpoint.dir``: all executors reach it, so a lost
executor costs a recomputation of its tasks and never the table. Only a local master without that
setting (tests, a laptop) falls back to a folder of its own, removed when the process ends.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; raises on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="facetmill-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


class Scratch:
    """Intermediate tables of one operator call.

    ``write`` stores a DataFrame as zstd parquet and returns it read back, with the lineage cut.
    ``drop`` deletes a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)

    def tidy(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of finished rounds now rather than at some later collection."""
        gc.collect()
        self.spark._jvm.System.gc()


def one_thread_a_task(df: DataFrame) -> DataFrame:
    """``df``, with the Python workers of later stages told to use one linear-algebra thread, as each has one core."""
    env = df.sparkSession.sparkContext.environment
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        env.setdefault(name, "1")
    return df
