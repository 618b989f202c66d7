"""Cutting lineage where a result must not change or be computed twice."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Masters whose executors are this process.
LOCAL = re.compile(r"local(\[.*\])?")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.  A local session that names none, as in tests, gets one
    of its own; a cluster that names none raises, as no other folder outlives an executor."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not LOCAL.fullmatch(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lamina-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def settled(df: DataFrame) -> DataFrame:
    """``df`` as of now, written to the folder that the cluster names: as parquet, of which a reader
    takes the columns it needs; as a checkpoint where parquet has no such type."""
    spark = df.sparkSession
    if not re.search('"(void|interval[^"]*)"', df.schema.json()):
        path = f"{shared_folder(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
