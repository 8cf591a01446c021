"""Intermediate tables that several branches of a plan read.

A table that is costly to make and read more than once (distinct names, headings,
candidates, the edges of a round) is written once to shared storage and read back:
it survives lost executors, cuts the lineage, and gives the optimizer a real size
to choose joins by. Shared storage is the folder that the cluster names in
``spark.checkpoint.dir``; where that is unset it is the session's warehouse. Where
that would be a folder of one machine (``file:``) it is taken on a local master only
and refused on a cluster, whose executors would each write to a disk of their own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: list[str] = []


def staging_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        shared = usable(spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master)
    return shared.rstrip("/") + "/dossiermill"


def usable(warehouse: str, master: str) -> str:
    """The warehouse, if every executor of ``master`` can reach it."""
    local = warehouse.startswith("file:") or "://" not in warehouse
    if local and not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a shared folder: {warehouse} lies on one machine, and the master is {master}")
    return warehouse


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    path = f"{staging_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back; the executors that made it may go."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete one staged table through Hadoop's file system, whatever the storage is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if path in _staged:
        _staged.remove(path)


def clear(spark: SparkSession) -> None:
    """Delete what this process has staged; call it when no DataFrame over it is needed any more."""
    for path in list(_staged):
        remove(spark, path)
