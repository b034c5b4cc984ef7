from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
}


def test_a_hot_order_id_is_split_by_the_plain_payment_join(spark):
    """A third of the payments name one order; they arrive over several map tasks."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    try:
        hot = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id"))
        payments = spark.range(0, 60_000, 1, 8).select(F.col("id").alias("payment_id"), hot.alias("order_id"))
        known = spark.range(0, 60_000, 1, 4).select(F.col("id").alias("order_id"), F.lit(True).alias("_known"))
        joined = payments.join(known, "order_id", "left")
        assert joined.where("_known is null").count() == 0
        joined.write.format("noop").mode("overwrite").save()
        frame = payments.join(known, "order_id", "left")
        assert len(frame.collect()) == 60_000
        assert "skew=true" in frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in SETTINGS:
            spark.conf.unset(key)
