"""Rows of far ranks by quantile selection.

A mergeable sketch per group gives the values near the wanted ranks; a count of the rows before that range and inside it corrects it, and only the
rows inside are ranked. Values are order-preserving whole numbers of the sort columns, one after another: where a range shrinks to a single value
(ties), the next number narrows it on. So a page costs a few scans; nothing is sorted or stored as a whole, and no task holds
more of a group than the range.
"""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DateType, IntegralType, StringType, TimestampType

from ..sources.scratch import kept

#: Size of a sketch, and by how much of a group a rank that it gives may be off. A range that misses the wanted ranks is widened.
SKETCH, ERROR, GRID = 1024, 0.005, 512
#: Rows of a group that are ranked without narrowing its range further.
FEW = 50_000
_MOST, _BYTES = 1 << 62, 7


def sort_of(order) -> list:
    """Sort columns of an order: pairs (column, falling). Nulls are smallest."""
    return [F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c, down in order]


def _numbers(value: Column, kind) -> list:
    """Whole numbers that put the values of a column in its order, one after the other; none for types that have no such."""
    if isinstance(kind, (IntegralType, BooleanType)):
        return [F.greatest(F.least(value.cast("bigint"), F.lit(_MOST - 1)), F.lit(1 - _MOST))]
    if isinstance(kind, DateType):
        return [F.unix_date(value).cast("bigint")]
    if isinstance(kind, TimestampType):
        return [F.unix_micros(value)]
    if isinstance(kind, StringType):
        # Seven bytes at a time: shorter values are filled up with zero bytes, which no byte comes before.
        data = value.cast("binary")
        return [F.conv(F.rpad(F.hex(F.substring(data, at, _BYTES)), 2 * _BYTES, "0"), 16, 10).cast("bigint") for at in range(1, 1 + 4 * _BYTES, _BYTES)]
    return []


def _levels(df: DataFrame, order) -> list:
    """The numbers of the order, all rising. They end with a column that its numbers may not tell apart wholly."""
    out = []
    for column, down in order:
        kind = df.select(_column(column).alias("v")).schema["v"].dataType
        numbers = _numbers(_column(column), kind)
        out += [F.coalesce(-n if down else n, F.lit(_MOST if down else -_MOST)) for n in numbers]
        if not numbers or isinstance(kind, StringType):
            break
    return out


def _column(column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _step(rows: DataFrame, state: DataFrame, keys, number: Column, first: int, last: int, error: float) -> DataFrame:
    """``state`` after one look at the wide groups: range of the number, rows before it and inside, and whether one value is left."""
    state = state.drop("_low", "_high")
    wide = rows.withColumn("_v", number).join(state.filter(F.col("_here") & (F.col("_inside") > FEW)), keys)
    sketched = wide.groupBy(*keys).agg(
        F.kll_sketch_agg_bigint("_v", F.lit(SKETCH)).alias("_sketch"), F.min("_v").alias("_least"), F.max("_v").alias("_greatest"),
        *[F.first(c).alias(c) for c in ("_earlier", "_inside", "_total")])
    share = [(F.lit(float(rank)) - F.col("_earlier")) / F.col("_inside") + slack for rank, slack in ((first, -error), (last, error))]
    # A sketch is asked for fixed ranks only: those of a grid, from which the next ones outside are taken.
    grid = F.kll_sketch_get_quantile_bigint("_sketch", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
    places = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * GRID for x in share]
    low, high = (F.element_at(grid, side(x).cast("int") + 1) for side, x in zip((F.floor, F.ceil), places))
    # A sketch needn't know the ends of its group.
    bounds = kept(sketched.select(*keys, F.when(share[0] <= 0, F.col("_least")).otherwise(low).alias("_low"),
                                   F.when(share[1] >= 1, F.col("_greatest")).otherwise(high).alias("_high")), "page-bounds")
    counted = wide.join(bounds, keys).groupBy(*keys).agg(
        F.count_if(F.col("_v") < F.col("_low")).alias("_skipped"), F.count_if(F.col("_v").between(F.col("_low"), F.col("_high"))).alias("_left"))
    found = state.join(bounds, keys, "left").join(counted, keys, "left")
    start = F.col("_earlier") + F.col("_skipped")
    hit = F.coalesce((start <= first) & (start + F.col("_left") >= F.least(F.lit(last), F.col("_total"))), F.lit(False))
    one = hit & (F.col("_low") == F.col("_high"))
    return kept(found.select(
        *keys, "_total", F.when(hit, start).otherwise(F.col("_earlier")).alias("_earlier"), F.when(hit, F.col("_left")).otherwise(F.col("_inside")).alias("_inside"),
        F.when(hit, F.col("_low")).alias("_low"), F.when(hit, F.col("_high")).alias("_high"),
        (F.col("_here") & ~one & ~(hit & (F.col("_left") * 2 > F.col("_inside")))).alias("_here"), (F.col("_next") | one).alias("_next")), "page-ranges")


def narrowed(df: DataFrame, keys, order, first: int, last: int):
    """(rows of ``df`` among which those with ``first < rank <= last`` of their group are, ``keys, _earlier``: how many rows of the group come before them).

    ``order``: pairs (column, falling). Groups of ``first`` rows or fewer have no such rows. Keys may not be null.
    """
    keys, columns, rows = list(keys), df.columns, df
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total")).filter(F.col("_total") > first)
    zero, yes, none = F.lit(0).cast("bigint"), F.lit(True), F.lit(None).cast("bigint")
    state = kept(sizes.withColumns({"_earlier": zero, "_inside": F.col("_total"), "_low": none, "_high": none, "_here": yes, "_next": yes}), "page-ranges")
    for number in _levels(df, order):
        state = state.withColumns({"_here": F.col("_next"), "_next": F.lit(False)})
        for attempt in range(3):
            if state.filter(F.col("_here") & (F.col("_inside") > FEW)).isEmpty():
                break
            state = _step(rows, state, keys, number, first, last, ERROR * 4 ** attempt)
            ranges = state.select(*keys, "_low", "_high")
            rows = rows.join(ranges, keys).filter(F.col("_low").isNull() | number.between(F.col("_low"), F.col("_high"))).select(*columns)
    return rows.join(state.select(*keys), keys, "left_semi"), state.select(*keys, "_earlier")
