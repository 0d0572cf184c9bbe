"""Settings that the jobs need from the session."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it.  On a cluster it is installed, or
    shipped by spark-submit; then this changes nothing that matters."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and the context has
    none either is a temporary folder taken, and only in a local session, as in tests; elsewhere executors wouldn't see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there: lineage ends here, and a
    lost executor costs no more than a read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared checkpoint folder and read from there.

    For loops with many joins: a checkpoint hands on the size that was estimated for its plan, and a join's estimate is the product of
    its sides', so after some ten self-joins in turn the estimate alone has millions of digits and takes longer than the work.  A table has the size of its files.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
