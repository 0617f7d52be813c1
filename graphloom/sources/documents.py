"""Readers and writers of the small documents around a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_ontology(spark: SparkSession, path: str, predicates: tuple[str, ...] = ("is_a",)) -> DataFrame:
    """(child, parent) of an ontology graph in JSON: {"graphs": [{"edges": [{"sub", "pred", "obj"}]}]}."""
    schema = "graphs array<struct<edges:array<struct<sub:string,pred:string,obj:string>>>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    e = doc.select(F.explode("graphs").alias("g")).select(F.explode("g.edges").alias("e"))
    return e.where(F.col("e.pred").isin(*predicates)).select(F.col("e.sub").alias("child"), F.col("e.obj").alias("parent")).distinct()


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question, expected) of a text file: one question a line, `| expected` after it at
    will; blank lines and lines that begin with # do not count."""
    line = F.trim("value")
    t = spark.read.text(path).where((line != "") & ~F.startswith(line, F.lit("#")))
    parts = F.split(line, r"\s*\|\s*", 2)
    return t.select(F.get(parts, 0).alias("question"), F.get(parts, 1).alias("expected"))


def write_versioned(df: DataFrame, path: str, version: str, mode: str = "overwrite") -> None:
    """A table with the version of what it was made from, partitioned by it."""
    df.withColumn("version", F.lit(version)).write.mode(mode).partitionBy("version").parquet(path)


def write_result(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A result as JSON lines."""
    df.write.mode(mode).json(path)
