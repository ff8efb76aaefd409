"""Cutting a plan: results of a step are written once to the shared checkpoint folder and read from there on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a folder of our own in local mode; on a cluster, whose
    machines couldn't see such a folder, it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="geoweft-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, written as a table of the shared folder, for rounds of joins: what follows is planned by the table's size.
    Estimates outlive checkpoint(), and each round would square them, to numbers of thousands of digits."""
    folder = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dealt(df: DataFrame) -> DataFrame:
    """df for a join that is dealt over tasks whatever its estimated size. Spark estimates from compressed bytes, and would
    gather tables of many rows on the driver to broadcast them."""
    return df.hint("merge")
