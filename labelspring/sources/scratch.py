"""Tables written between jobs, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a session on one machine gets a folder of its
    own; a cluster session must name one, since its machines share no ``/tmp``.
    """
    folder = spark.conf.get(CONF, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CONF} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="labelspring-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/labelspring/{uuid.uuid4().hex}/{name}"


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Write the rows to the path and go on from the written table."""
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Go on from a copy of the rows in the shared folder.

    Survives the loss of any executor, and unlike a checkpoint stays columnar:
    a later step that needs the ids and scores does not read the vectors.
    """
    return write_table(df, new_path(df.sparkSession, name))


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`write_table` wrote and nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
