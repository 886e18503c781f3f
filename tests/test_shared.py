from pyspark.sql import functions as F

from concordat import shared


def test_unions_of_joins_aggregate_each_key_once(spark, tmp_path):
    """One side's join becomes a broadcast join at run time, the other's does not; both are hashed by the key."""
    shared.sound(spark)
    few = spark.createDataFrame([(k % 50, k) for k in range(200)], "k long, v long")
    few.repartition(4).write.parquet(f"{tmp_path}/few")
    asked = spark.createDataFrame([(k,) for k in range(25)], "k long").repartition(4)
    one, two = (spark.read.parquet(f"{tmp_path}/few").join(asked.filter(f"k % {m} >= 0"), "k", "left_semi") for m in (7, 11))
    rows = one.unionByName(two).groupBy("k").agg(F.count("*").alias("n")).collect()
    assert len(rows) == 25 and {r["n"] for r in rows} == {8}
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"
