"""Where tables between jobs live, and their removal."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def storage_root(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one only in local mode with the setting unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = getattr(storage_root, "local", None)
    if root is None:
        root = storage_root.local = "file://" + tempfile.mkdtemp(prefix="tessel-")
    return root


def new_place(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    path = f"{storage_root(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df below the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation."""
    path = new_place(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes below which spread deals a table anew; it shuffles no more than that.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, its rows dealt over all cores where it is small: a small table may be one row group, which one task reads and
    computes on alone. A larger table stays as it is read."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if int(str(size)) < SPREAD_BYTES else df


def sweep(spark: SparkSession) -> int:
    """Remove what this process has written between jobs; call it once results that rest on it are stored."""
    jvm, n = spark.sparkContext._jvm, 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n
