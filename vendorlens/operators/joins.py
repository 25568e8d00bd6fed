"""Join helpers that hold up when one key owns a large share of the rows.

Joins are plain equality joins: Catalyst broadcasts a side below its size threshold, and adaptive
execution splits a partition that is too large. ``spread_join`` is for sessions without it.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

# Tasks a hot key is split over, and the most hot keys there can be.
SALTS = 16


def hot_keys(df: DataFrame, on, share: float) -> list:
    """The keys that more than ``share`` of the rows have, as rows: fewer than 1 / share of them."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return counts.filter(F.col("_n") > share * total).select(*on).collect()


def spread_join(left: DataFrame, right: DataFrame, on, how="inner", spread=(), salts=None) -> DataFrame:
    """Equality join that splits the keys a count shows to be hot over ``salts`` tasks.

    A key is hot if it has more than 1 / salts of the left rows. Only hot left rows are salted, by a
    hash of the ``spread`` columns, so a retried task places a row where it was; only the right
    rows of hot keys are copied. Nothing is copied where no key is hot.
    """
    on = [on] if isinstance(on, str) else list(on)
    salts = salts or int(left.sparkSession.conf.get("spark.vendorlens.salts", str(SALTS)))
    hot = hot_keys(left, on, 1 / salts)
    if not hot:
        return left.join(right, on, how)
    found = reduce(lambda a, b: a | b, [
        reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(row[c])) for c in on]) for row in hot])
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    salted = left.withColumn("_salt", F.when(found, salt).otherwise(0))
    copies = F.when(found, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(right.withColumn("_salt", F.explode(copies)), [*on, "_salt"], how).drop("_salt")


def lookup(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Rows whose key is listed in ``keys`` (by id, domain, slug or sender)."""
    on = [on] if isinstance(on, str) else list(on)
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def chunked_lists(df: DataFrame, keys, item, per_part=1000, by=()) -> DataFrame:
    """Groups as lists of bounded length: ``keys, part, n_parts, items``.

    A group of up to ``per_part`` rows is one list. A larger one is split by a hash of ``by``, so
    no task ever holds an unbounded group and no row is dropped. Items are sorted descending.
    """
    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / per_part).alias("n_parts"))
    part = F.pmod(F.xxhash64(*by), F.col("n_parts"))
    return (
        df.join(sizes, list(keys))
        .withColumn("part", part)
        .groupBy(*keys, "part", "n_parts")
        .agg(F.sort_array(F.collect_list(item), False).alias("items")))
