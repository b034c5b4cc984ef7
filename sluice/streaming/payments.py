"""Verdicts of payments while orders and payments arrive as two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.operators.classify import judged_payments
from sluice.session import remove
from sluice.sources.layers import PartitionedTable

# The state of the join holds every payment of the delay. A second version of it would only save a
# repeated batch the way back to the checkpoint.
STATE_CONF = {"spark.sql.streaming.maxBatchesToRetainInMemory": "1"}


def stream_payment_verdicts(
    payments: DataFrame,
    orders: DataFrame,
    delay: str = "7 days",
    reach: str = "150 days",
    ahead: str = "1 day",
) -> DataFrame:
    """Each payment once, with its verdict; ``orders`` streams the accepted ones.

    A payment belongs to an order of the ``reach`` before it, or of up to ``ahead`` after it.
    Either may arrive first, by up to ``delay`` of event time: a payment waits for its order in
    the state of the join and is accepted when that comes. It is an orphan once the watermarks
    of both streams say that no order can come any more. So the state holds orders of the reach
    and payments of the delay, and both are dropped as the watermarks move on. A payment without
    a time counts as paid when it was ingested. Rows later than the delay are dropped, and a
    repeated order id within the delay counts once.
    """
    paid = payments.withColumn("_event", F.coalesce("paid_at", "_ingested_at")).withWatermark("_event", delay)
    known = orders.select(F.col("order_id").alias("_known"), F.col("ordered_at").alias("_ordered"))
    known = known.withWatermark("_ordered", delay).dropDuplicatesWithinWatermark(["_known"])
    near = (
        (F.col("order_id") == F.col("_known"))
        & (F.col("_ordered") >= F.col("_event") - F.expr(f"INTERVAL {reach}"))
        & (F.col("_ordered") <= F.col("_event") + F.expr(f"INTERVAL {ahead}"))
    )
    marked = paid.join(known, near, "leftOuter")
    return judged_payments(marked, "_known").select(*payments.columns, "reject_rule", "reject_reason")


def keep_verdicts(verdicts: DataFrame, table: PartitionedTable, checkpoint: str) -> StreamingQuery:
    """Upsert final verdicts by payment id; a replayed batch writes the same rows again.

    A payment gets one verdict, so a batch is added to the table unless a payment id comes again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stage = f"{table.path}-stage/batch={batch_id}"
        batch.write.mode("overwrite").parquet(f"{stage}/rows")
        rows = spark.read.schema(batch.schema).parquet(f"{stage}/rows")
        rows = rows.where(F.col("payment_id").isNotNull())
        if not rows.isEmpty():
            table.upsert(rows, "payment_id", f"{stage}/merged", add=True)
        remove(spark, stage)

    conf = verdicts.sparkSession.conf
    before = {key: conf.get(key, None) for key in STATE_CONF}
    for key, value in STATE_CONF.items():
        conf.set(key, value)
    try:
        # The query keeps the settings it starts with.
        return (
            verdicts.writeStream.outputMode("append")
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for key, value in before.items():
            if value is None:
                conf.unset(key)
            else:
                conf.set(key, value)
