"""Tables that outlive lost executors: written to the cluster's shared folder, then read again."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. On a local master, as in tests, a new temporary one stands in where it is unset; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = _LOCAL.get(master) or _LOCAL.setdefault(master, "file://" + tempfile.mkdtemp(prefix="satchel-checkpoint-"))
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/satchel-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later failures recompute nothing before this point.

    The tables are as lazy a result's input as any, so they stay until the folder is cleared, as checkpoints do; dropped() takes one away before.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df, dealt by keys over as many tasks as there are cores if it comes from fewer files: a small file is one task's, however much work its rows are. Large tables stay as
    they are read, without a shuffle."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= n else df.repartition(n, *keys)


def log_rows(spark: SparkSession, path: str, schema: str) -> list:
    """The rows of a small log at path; none if nothing has been written there yet."""
    try:
        return spark.read.schema(schema).parquet(path).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again. Folders are told by their path alone, since a file system may answer with its host and port."""
    for table in tables:
        spark = table.sparkSession
        own = urlsplit(shared_dir(spark)).path.rstrip("/") + "/satchel-"
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if urlsplit(folder).path.startswith(own):
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
