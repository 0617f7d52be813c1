import os

from pyspark.sql import functions as F

from graphloom.sources import spill, spread, table
from graphloom.sources.scratch import Scratch, shared_dir


def test_spilled_tables_lie_in_the_named_folder_and_can_be_dropped(spark):
    root = shared_dir(spark)
    assert root == spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(root.removeprefix("file://")))
    keep = Scratch(spark)
    a = keep.spill(spark.range(5).withColumn("x", F.array("id")))
    assert a.count() == 5 and len(set(os.listdir(root.removeprefix("file://"))) - before) == 1
    keep.drop(a)
    keep.drop(a)
    assert set(os.listdir(root.removeprefix("file://"))) == before
    empty = spill(spark.range(0).withColumn("s", F.lit("x")))
    assert empty.count() == 0 and empty.columns == ["id", "s"]


def test_spread_reaches_all_cores_with_every_row(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    t = table(spark, str(tmp_path), "t")
    wide = spread(t)
    assert wide.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r["id"] for r in wide.collect()) == list(range(1000))
    spark.range(1000).repartition(9).write.parquet(str(tmp_path / "u.parquet"))
    u = table(spark, str(tmp_path), "u")
    assert spread(u) is u
    memory = spark.createDataFrame([(1,)], "a int")
    assert spread(memory).count() == 1
