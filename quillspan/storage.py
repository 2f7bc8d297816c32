"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver see, from ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder is chosen if everything runs in one local process;
    on a cluster that raises RuntimeError.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="quillspan-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """The path's file system and the path, as the cluster's own objects."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs, at = file_system(df.sparkSession, folder)
        fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def moved(spark: SparkSession, old: str, new: str) -> None:
    """One rename; where ``new`` is there already (another driver was faster), ``old`` goes."""
    fs, at = file_system(spark, old)
    to = file_system(spark, new)[1]
    fs.mkdirs(to.getParent())
    if fs.exists(to) or not fs.rename(at, to):
        fs.delete(at, True)


def replaced(df: DataFrame, path: str) -> DataFrame:
    """``df`` as the table at ``path``: written beside it, then moved into its place."""
    spark = df.sparkSession
    made = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(made)
    fs, at = file_system(spark, path)
    fs.delete(at, True)
    if not fs.rename(file_system(spark, made)[1], at):
        raise OSError(f"{made} could not be moved to {path}")
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of a table's files: another one if the table was written anew."""
    fs, at = file_system(spark, path)
    return hashlib.sha256("\n".join(sorted(f"{s.getPath()}|{s.getLen()}|{s.getModificationTime()}" for s in fs.listStatus(at))).encode()).hexdigest()[:24]


def dealt(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose rows all cores share.

    A table of fewer bytes than its cores could take in one split each (often a single row group) keeps
    most of them idle; such a table is dealt out anew, of the columns that are read alone.  Larger ones
    are read as they lie.
    """
    fs, at = file_system(spark, path)
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    rows = spark.read.parquet(path)
    return rows.repartition(cores) if fs.getContentSummary(at).getLength() < cores * split else rows
