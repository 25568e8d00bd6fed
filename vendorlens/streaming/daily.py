"""Daily message counts as a stream.

Mail arrives backwards as well as forwards, so no day is ever closed: each micro-batch writes its own
counts, and reading adds them up.
"""

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import utc_day


def daily_counts(messages: DataFrame) -> DataFrame:
    """Messages per account and UTC day of the timestamp ``ts``."""
    return messages.groupBy("account_id", utc_day(F.unix_millis("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def start_daily(messages: DataFrame, path: str, checkpoint: str):
    """Writes the counts of every micro-batch as a partition of its own; a repeated batch overwrites it."""
    def write(df, n):
        (daily_counts(df).withColumn("batch", F.lit(n).cast("bigint")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))

    return (
        messages.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(write).start())


def current_days(spark, path: str) -> DataFrame:
    """Messages per account and day over all batches; days without mail have no row."""
    return spark.read.parquet(path).groupBy("account_id", "day").agg(F.sum("n").alias("n"))
