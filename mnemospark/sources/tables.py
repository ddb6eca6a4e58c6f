"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_arrival(df: DataFrame, name: str = "arrival") -> DataFrame:
    """Adds the place of each row in the order of delivery: file, then row in the file.

    It is read from the scan's metadata, so it costs no shuffle and no counter. Comparing
    two such structs compares the order of arrival.
    """
    return df.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


def spread(df: DataFrame) -> DataFrame:
    """A scan whose rows are costly to work on, over as many tasks as there are cores at
    least; a table of many splits stays as it is. Only for scans: what is planned at run time
    would be run to be counted."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
