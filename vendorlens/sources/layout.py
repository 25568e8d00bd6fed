"""Messages laid out along a space-filling curve of account and day.

The bits of an account's hash and of the day take turns in one number, by which rows are ranged over files and sorted inside them. Each file, and each row group of
it, then holds a small rectangle of accounts and days, so the statistics that parquet keeps of both columns prune by account, by date, and best by both; folders
by month prune by date alone. The hash is stored, because account names are not in its order.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import DAY_MS
from .readers import date_range

#: Bits of each side. Days are counted from 1995-01-01, where backfills end; 14 bits last 44 years, earlier and later days share the ends.
BITS, FIRST_DAY = 14, 9131


def account_hash(account) -> Column:
    return F.pmod(F.xxhash64(account), F.lit(1 << BITS)).cast("int")


def curve(account, date_ms) -> Column:
    """The place of an account and a time on the curve; undated rows stand on the first day."""
    day = F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), F.floor(F.coalesce(F.col(date_ms), F.lit(0)) / DAY_MS) - FIRST_DAY)).cast("bigint")
    sides = account_hash(account).cast("bigint"), day
    bits = [F.shiftleft(F.shiftright(side, i).bitwiseAND(F.lit(1)), 2 * i + 1 - k) for i in range(BITS) for k, side in enumerate(sides)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def write_clustered(messages: DataFrame, path: str, files: int, group_bytes: int = 128 << 20, mode="overwrite"):
    """Parquet files of ``files`` ranges of the curve, with a column ``account_hash``; ``group_bytes`` is the size of their row groups."""
    placed = messages.withColumns({"account_hash": account_hash("account_id"), "_place": curve("account_id", "date_ms")})
    (placed.repartitionByRange(files, "_place", "account_id", "date_ms").sortWithinPartitions("_place", "account_id", "date_ms").drop("_place")
     .write.mode(mode).option("parquet.block.size", group_bytes).parquet(path))


def read_clustered(spark: SparkSession, path: str, accounts=None, since_ms: int = None, until_ms: int = None, headers_only=False) -> DataFrame:
    """Messages of a list of accounts (all if None) and of [since, until). Filters on the hash and the date reach the scan."""
    rows = spark.read.parquet(path)
    if accounts is not None:
        hashes = [r[0] for r in spark.createDataFrame([(a,) for a in accounts], "a string").select(account_hash("a")).collect()]
        rows = rows.filter(F.col("account_hash").isin(hashes) & F.col("account_id").isin(list(accounts)))
    return date_range(rows.drop("account_hash"), since_ms, until_ms, headers_only)
