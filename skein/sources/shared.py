"""The folder that all executors share, and tables written there between the rounds of iterative operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_CLEAN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """From spark.checkpoint.dir. Where that is unset, a temporary folder if all runs in one process, else an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not (sc.master or "").split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skein-shared-")
        sc.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/skein-{sc.applicationId}"
    if path not in _CLEAN:
        _CLEAN.add(path)
        atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None and sc._gateway is not None and sc._jvm is not None:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Removes all tables written so far: for when the results that read them have been used up."""
    remove(spark, shared_dir(spark))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and survives the loss of any executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def qualified(table: DataFrame) -> str:
    """Where a written table lies, with its scheme."""
    return qualified_path(table.sparkSession, table._skein_path)


def qualified_path(spark: SparkSession, path: str) -> str:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toString()


def uri(path: str) -> str:
    """A qualified path as pyarrow.fs takes it."""
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def stored(path: str, column: str = "id") -> np.ndarray:
    """A column of whole numbers of a written table, read by a task through pyarrow.fs."""
    from pyarrow.dataset import dataset
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(uri(path))
    return dataset(at, filesystem=fs, format="parquet").to_table(columns=[column]).column(column).to_numpy()


def dropped(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more, such as those of a round that's over."""
    for t in tables:
        if path := getattr(t, "_skein_path", None):
            remove(t.sparkSession, path)
