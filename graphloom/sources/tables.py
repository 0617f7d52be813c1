"""Readers of the parquet tables in one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` (one file or a folder of files) under `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where its files are too few to reach them: a small table in fewer
    files than there are cores would be read, and worked on, by as few tasks. Tables that
    fill the cores by themselves are left as they are, without a shuffle."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if size >= cores * split or not 0 < len(df.inputFiles()) < cores:
        return df
    return df.repartition(cores)
