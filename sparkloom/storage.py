"""Places that outlive an executor: checkpoints and written tables.

A fixpoint loop or a reused intermediate must survive lost executors, so it is
written to the folder named by ``spark.checkpoint.dir`` (shared on a cluster)
and read again. Only when a local session names no folder, as in tests, one is
set; on a cluster, where it would be another folder on each machine, that is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder; sets a local one only if the session is local and has none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="sparkloom-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def table(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage as ``checkpoint()`` does, and beyond that leaves columnar
    files whose size Spark knows, so later joins are planned from real sizes.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`table`, once it is used up."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles():
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("table-"):
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
            return
