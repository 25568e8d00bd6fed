"""Writers."""

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.dates import utc_month
from ..operators.joins import chunked_lists


def with_month(messages: DataFrame) -> DataFrame:
    """Adds the partition column of stored messages."""
    return messages.withColumn("msg_month", utc_month(F.col("date_ms")))


def write_table(df: DataFrame, path: str, keys=(), mode="overwrite"):
    """Parquet, partitioned by ``keys``. Overwrite replaces only the partitions that are written."""
    if not keys:
        df.write.mode(mode).parquet(path)
        return
    # Rebalancing gathers the rows of a partition in few files and splits one that is too large.
    (df.hint("rebalance", *keys).write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy(*keys).parquet(path))


def write_counted(df: DataFrame, path: str, counts: dict, keys=(), mode="overwrite") -> dict:
    """:func:`write_table`, and the ``counts`` (name to condition) of the rows it writes, taken in the same pass; ``rows`` is their number.

    A job that is repeated counts its last attempt of each task once.
    """
    seen = Observation()
    named = [F.count_if(F.coalesce(hit, F.lit(False))).alias(name) for name, hit in counts.items()]
    write_table(df.observe(seen, F.count(F.lit(1)).alias("rows"), *named), path, keys, mode)
    return seen.get


def write_companies(companies: DataFrame, path: str):
    """Companies as JSON lines in name order; part files follow each other in that order."""
    out = companies.withColumn("domains", F.coalesce("domains", F.expr("array()").cast("array<string>")))
    out.orderBy("name", "slug").write.mode("overwrite").json(path)


def write_breach_docs(docs: DataFrame, path: str):
    """Breach documents as JSON lines."""
    docs.write.mode("overwrite").json(path)


def write_json_arrays(df: DataFrame, path: str, by, per_file=1000, item=None, head="[", tail="]"):
    """JSON arrays of about ``per_file`` objects, one array per file, between ``head`` and ``tail``."""
    item = F.to_json(F.struct(*df.columns) if item is None else item)
    sized = chunked_lists(df.withColumn("_all", F.lit(0)).withColumn("_item", item), ["_all"], "_item", per_file, by)
    text = F.concat(F.lit(head), F.array_join("items", ","), F.lit(tail))
    sized.select(text.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
