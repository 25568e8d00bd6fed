"""Changes of a stored, partitioned table that write only the partitions they touch.

Keys are mapped to partitions by a look at the key columns; the partitions found are read, changed, stored aside and then put in place of the old
ones by dynamic partition overwrite. All other files stay as they are.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.scratch import kept
from ..sources.sinks import write_table
from . import state

_NULL = "__HIVE_DEFAULT_PARTITION__"


def partitions_of(table: DataFrame, keys: DataFrame, on, partition) -> DataFrame:
    """The partitions of ``table`` that hold a row of one of the keys. Reads the key columns only."""
    return table.select(*partition, *on).join(keys.select(*on).distinct(), list(on), "left_semi").select(*partition).distinct()


def rewrite_partitions(spark: SparkSession, path: str, schema, partition, touched: DataFrame, change) -> int:
    """Puts ``change(rows)`` in place of the rows of the touched partitions; returns how many partitions that are.

    ``touched`` has a row of partition values each; as many as the table has partitions come to the driver at most, and as literals they prune the
    scan. ``change`` may drop and alter rows but not move them to another partition. A partition that loses all its rows keeps its folder, with an empty file.
    """
    partition = list(partition)
    table = spark.read.schema(schema).parquet(path)
    names = {tuple(r) for r in touched.select(*partition).distinct().collect()}
    if not names:
        return 0
    hit = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(partition, name)]) for name in names])
    rows = kept(change(table.filter(hit)).select(*table.columns), "rewrite")
    write_table(rows, path, partition)
    left = {tuple(r) for r in rows.select(*partition).distinct().collect()}
    empty = spark.createDataFrame([], table.drop(*partition).schema)
    for name in names - left:
        folder = "/".join(f"{c}={_NULL if v is None else v}" for c, v in zip(partition, name))
        empty.coalesce(1).write.mode("overwrite").parquet(f"{path}/{folder}")
    return len(names)


def _applied(spark, path, schema, partition, keys, on, change) -> int:
    table = spark.read.schema(schema).parquet(path)
    return rewrite_partitions(spark, path, schema, partition, partitions_of(table, keys, on, partition), change)


def delete_ids(spark, path, schema, partition, ids: DataFrame) -> int:
    """Stored form of ``state.delete_ids``."""
    return _applied(spark, path, schema, partition, ids, state.ID, lambda rows: state.delete_ids(rows, ids))


def delete_by_vendor(spark, path, schema, partition, keys: DataFrame, types=None) -> int:
    """Stored form of ``state.delete_by_vendor``."""
    return _applied(spark, path, schema, partition, keys, state.VENDOR, lambda rows: state.delete_by_vendor(rows, keys, types)[0])


def mark_unsubscribed(spark, path, schema, partition, keys: DataFrame, by="vendor_key") -> int:
    """Stored form of ``state.mark_unsubscribed``."""
    return _applied(spark, path, schema, partition, keys, ["account_id", by], lambda rows: state.mark_unsubscribed(rows, keys, by))


def set_status(spark, path, schema, partition, changes: DataFrame, on) -> int:
    """Stored form of ``state.set_status``."""
    return _applied(spark, path, schema, partition, changes, list(on), lambda rows: state.set_status(rows, changes, on))


def reset_accounts(spark, path, schema, partition, accounts: DataFrame) -> int:
    """Stored form of ``state.reset_accounts``, of one table."""
    gone = accounts.select("account_id").distinct()
    return _applied(spark, path, schema, partition, gone, ["account_id"], lambda rows: rows.join(gone, "account_id", "left_anti"))
