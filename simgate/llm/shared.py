"""The folder that the driver and all executors share, for cut lineage and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Without it nothing is written: a folder of one machine would lose rows on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not folder and (master == "local" or master.startswith("local[")):
        folder = f"file://{tempfile.gettempdir()}/simgate-shared"  # one process
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """The rows of df, from Parquet in the shared folder: cuts lineage, and survives lost executors. ``options`` go to the Parquet writer."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options or {}).parquet(folder)
    table = spark.read.schema(df.schema).parquet(folder)
    table.written_to = folder
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave, when everything that reads them is written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
