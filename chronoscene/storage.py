"""Reading tables and cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is named a local session gets a temporary one; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="chronoscene-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return named or current.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: keeps partitions and their order, survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialized(df: DataFrame) -> DataFrame:
    """Writes the rows once as Parquet in the shared folder and reads them from there.

    For costly projections (tokenizing, parsing) that several stages read; ``checkpoint`` would compute them twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/chronoscene-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
