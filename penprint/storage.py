"""Tables and scratch files in the folder that the driver and the executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratch: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="penprint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    if not _scratch:
        atexit.register(clean_scratch)
    path = f"{shared_dir(spark)}/penprint/{label}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


@contextmanager
def collected() -> Iterator[list[tuple[SparkSession, str]]]:
    """The scratch paths made inside the block, in a list that is complete at its end."""
    begun, made = len(_scratch), []
    yield made
    made += _scratch[begun:]


def release(made: list[tuple[SparkSession, str]]) -> None:
    """Remove collected scratch files; nothing that reads them may be left to run."""
    for spark, path in made:
        remove(spark, path)
    made.clear()


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def clean_scratch() -> None:
    for spark, path in _scratch:
        try:
            remove(spark, path)
        except Exception:  # the session may have ended already
            pass
    _scratch.clear()


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs nothing upstream."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def dropped(df: DataFrame) -> None:
    """Remove the files behind a table made by written()."""
    remove(df.sparkSession, df.scratch)
