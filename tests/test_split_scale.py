"""A stratified split leaves the rows where they are."""

from pyspark.sql import functions as F

from beatlake.operators import summaries as U


def test_split_does_not_exchange_rows_by_class(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("y"), F.col("id").alias("i"))
    x = U.stratified_split(df, "y", F.col("i"), "seed", 0.8)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")  # as where Spark takes the cuts for large
    try:
        joins = [line for line in x._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in line]
    finally:
        spark.conf.unset(threshold)
    assert "BroadcastHashJoin" in joins[0]  # the split's own, above those of the quantiles
    assert {(r["y"], r["n"]) for r in x.where("is_train").groupBy("y").agg(F.count("*").alias("n")).collect()} == {(0, 800), (1, 800), (2, 800)}
