"""Dashboard numbers kept by signed rows.

A batch writes, by account and measure, what it adds less what it takes away; the numbers are sums over all batches. A change of a
vendor is its row before it, taken away, and its row after it, added. What a batch costs follows the vendors, messages and actions it
touches. Batches may come in any order and again: each owns a partition.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import stats

KEY = ["account_id", "measure"]
SCHEMA = "account_id string, measure string, n bigint"
VENDORS, MESSAGES, ACTIONS = "vendors", "total_messages", "actions"
IMPACT = ["lists_unsubscribed", "emails_deleted", "bytes_reclaimed"]


def of_vendors(vendors: DataFrame) -> DataFrame:
    """What each vendor counts for, a row per measure. ``vendors`` carries the features."""
    levels = {f"risk_{level}": stats.vendor_risk() == level for level in stats.LEVELS}
    counts = {VENDORS: F.lit(True), **stats.vendor_measures(), **levels}
    names = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in counts.items()]))
    return vendors.select("account_id", F.explode(names).alias("measure"), F.lit(1).cast("bigint").alias("n"))


def of_messages(messages: DataFrame) -> DataFrame:
    return messages.select("account_id", F.lit(MESSAGES).alias("measure"), F.lit(1).cast("bigint").alias("n"))


def of_actions(actions: DataFrame) -> DataFrame:
    """What each action counts for: itself, and its part of the impact."""
    size = F.coalesce("size_bytes", F.lit(0))
    values = {ACTIONS: F.lit(1), **dict(zip(IMPACT, (
        F.when(F.col("action_type") == "unsubscribed", 1).otherwise(0),
        F.when(F.col("action_type").isin("trashed", "spam_reported"), F.coalesce("message_count", F.lit(0))).otherwise(0), size)))}
    pairs = F.array(*[F.struct(F.lit(name).alias("measure"), value.cast("bigint").alias("n")) for name, value in values.items()])
    return actions.select("account_id", F.inline(pairs))


def delta(added: DataFrame = None, removed: DataFrame = None) -> DataFrame:
    """``account_id, measure, n``: rows of the functions above, added and taken away, as sums that are not zero."""
    signed = [df.select(*KEY, (sign * F.col("n")).alias("n")) for df, sign in ((added, 1), (removed, -1)) if df is not None]
    rows = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
    return rows.groupBy(*KEY).agg(F.sum("n").alias("n")).filter("n <> 0")


def write_delta(rows: DataFrame, path: str, batch: int, change: int = 0):
    """Writes the signed rows of a batch as its partition; a repeated batch overwrites it."""
    numbered = rows.groupBy(*KEY).agg(F.sum("n").alias("n")).withColumns({"batch": F.lit(batch).cast("bigint"), "change": F.lit(change).cast("bigint")})
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "change").parquet(path)


def read_deltas(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, batch bigint, change bigint").parquet(path)


def _sums(deltas: DataFrame, measures) -> DataFrame:
    """A row per account with the sums of the measures."""
    rows = deltas.filter(F.col("measure").isin(list(measures)))
    return rows.groupBy("account_id").agg(*[F.coalesce(F.sum(F.when(F.col("measure") == m, F.col("n"))), F.lit(0)).alias(m) for m in measures])


def dashboard(deltas: DataFrame) -> DataFrame:
    """The headline counts of :func:`stats.dashboard`, for accounts with a vendor or a message."""
    sums = _sums(deltas, [MESSAGES, VENDORS, *stats.vendor_measures()])
    return sums.filter(f"{MESSAGES} > 0 OR {VENDORS} > 0").drop(VENDORS)


def risk_counts(deltas: DataFrame) -> DataFrame:
    """:func:`stats.risk_counts`, for accounts with a vendor."""
    sums = _sums(deltas, [VENDORS, *(f"risk_{level}" for level in stats.LEVELS)]).filter(f"{VENDORS} > 0")
    pairs = F.array(*[F.struct(F.lit(x).alias("risk_level"), F.col(f"risk_{x}").alias("vendors")) for x in stats.LEVELS])
    return sums.select("account_id", F.inline(pairs))


def impact(deltas: DataFrame) -> DataFrame:
    """:func:`stats.impact`, for accounts with an action."""
    return _sums(deltas, [ACTIONS, *IMPACT]).filter(f"{ACTIONS} > 0").drop(ACTIONS)
