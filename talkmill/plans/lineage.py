"""Cutting lineage with tables written to the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; set one only where it is unset.

    A cluster without that setting is an error, because a machine-local folder
    would be lost with its executor. Local masters get a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="talkmill-checkpoint-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the checkpoint folder and return a scan of it.

    Survives the loss of executors, unlike a local checkpoint, and is computed exactly once however many branches
    read the result; ``checkpoint()`` computes a frame twice, once to materialize and once to write it. Branches read
    only the columns they need, and joins know the table's size.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
