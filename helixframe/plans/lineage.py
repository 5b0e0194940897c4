"""Cutting lineage in loops, in a folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a session whose executors are threads of the driver
    (tests, a laptop) uses a temporary one; on a cluster it is an error, as no
    folder is known that its machines share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/helixframe-checkpoints"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and cut its lineage.

    The result starts a plan of its own.  What ``checkpoint`` returns still
    carries the constraints that the optimizer derived for ``df``; in loops of
    joins these multiply until planning takes longer than running.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    written = df.checkpoint(eager=True)._jdf
    spark = df.sparkSession
    rows = written.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, written.schema(), False), spark)
