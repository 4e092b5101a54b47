"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it.
WS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one is set, in local mode only: on a cluster
    every executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all of {master} share")
        found = f"file://{tempfile.mkdtemp(prefix='docloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folder of each table that written() made and released() hasn't deleted, by a mark that its DataFrame carries.
_held: dict[str, SparkSession] = {}


def _remove(path: str) -> None:
    spark = _held.pop(path, None)
    if spark is None:
        return
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone at exit
        pass


@atexit.register
def _remove_all() -> None:
    for path in list(_held):
        _remove(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, so a lost executor costs no recomputation
    of what lies before. The files go with released(), or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _held[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes the files of tables from written() that nothing will read any more."""
    for df in tables:
        _remove(getattr(df, "_docloom_path", ""))


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ordered_join(c: Column, sep: str) -> Column:
    return F.array_join(c, sep)
