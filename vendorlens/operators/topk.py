"""Newest-n and best-of operators. The rank filter sits directly above its window, so Spark cuts
each group to n rows per partition before the shuffle (up to rank 1000); a hot vendor never lands in
one task whole. Deeper pages are narrowed to a value range by quantile sketches."""

from pyspark.sql import DataFrame, Window, functions as F

from .deep_pages import narrowed, sort_of

VENDOR = ["account_id", "vendor_key"]

# Opt-out methods, best first.
METHOD_PRIORITY = ["rfc8058", "list-unsubscribe", "footer"]


def newest(df: DataFrame, keys, n: int, rank="rank") -> DataFrame:
    """The n newest rows per key (by date, then id)."""
    order = Window.partitionBy(*keys).orderBy(F.desc("date_ms"), F.desc("message_id"))
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= n)


def latest_messages(messages: DataFrame, types=None, n: int = 20) -> DataFrame:
    """Newest n messages per vendor, optionally of some types only."""
    wanted = messages.filter(F.col("type").isin(list(types))) if types else messages
    return newest(wanted, VENDOR, n)


def messages_by_sender(messages: DataFrame, types=None, n: int = 50, lone: int = 10, each: int = 5) -> DataFrame:
    """Of the newest n messages per vendor, the first ``lone`` of a lone sender or ``each`` of each of several."""
    listed = latest_messages(messages, types, n)
    vendor = Window.partitionBy(*VENDOR)
    several = F.min("sender_email").over(vendor) != F.max("sender_email").over(vendor)
    order = Window.partitionBy(*VENDOR, "sender_email").orderBy("rank")
    return (
        listed.withColumn("several", several)
        .withColumn("sender_rank", F.row_number().over(order))
        .filter(F.col("sender_rank") <= F.when(F.col("several"), each).otherwise(lone)))


def _has_url():
    return F.coalesce(F.col("unsubscribe_url") != "", F.lit(False))


def unsub_url_by_sender(messages: DataFrame) -> DataFrame:
    """Newest opt-out URL per sender."""
    return messages.filter(_has_url()).groupBy("account_id", "sender_email").agg(
        F.max_by("unsubscribe_url", F.struct("date_ms", "message_id")).alias("unsubscribe_url"))


def unsub_url_by_vendor(messages: DataFrame) -> DataFrame:
    """Newest opt-out URL per vendor, from bulk mail."""
    return messages.filter(_has_url() & (F.col("type") == "bulk")).groupBy(*VENDOR).agg(
        F.max_by("unsubscribe_url", F.struct("date_ms", "message_id")).alias("unsubscribe_url"))


def unsub_methods(messages: DataFrame) -> DataFrame:
    """Per vendor and method, the newest URL and sender of bulk mail not yet unsubscribed."""
    open_ = F.col("status").isNull() | (F.col("status") != "unsubscribed")
    value = F.struct("date_ms", "message_id", "unsubscribe_url", "sender_email")
    return (
        messages.filter((F.col("type") == "bulk") & _has_url() & open_)
        .groupBy(*VENDOR, F.col("unsubscribe_method").alias("method"))
        .agg(F.max(value).alias("v"))
        .select(*VENDOR, "method", F.col("v.unsubscribe_url").alias("url"), "v.sender_email", "v.date_ms"))


def best_unsub(methods: DataFrame) -> DataFrame:
    """Best method per vendor: one-click, list header, footer."""
    priority = F.array_position(F.array(*[F.lit(m) for m in METHOD_PRIORITY]), F.col("method"))
    return (
        methods.withColumn("priority", priority).filter("priority > 0")
        .groupBy(*VENDOR).agg(F.min(F.struct("priority", "method", "url", "sender_email")).alias("v"))
        .select(*VENDOR, "v.method", "v.url", "v.sender_email"))


def oneclick_worklist(vendors: DataFrame, methods: DataFrame) -> DataFrame:
    """Vendors that can be opted out in bulk, with the URL to call."""
    urls = methods.filter(F.col("method") == "rfc8058").select(*VENDOR, "url")
    return vendors.filter("has_rfc8058").select(*VENDOR, "name").join(urls, VENDOR, "inner")


def subjects_sample(messages: DataFrame, n: int = 10) -> DataFrame:
    """The first n subjects per vendor, by date then id, joined by blanks."""
    return joined_subjects(first_subjects(messages, n), n)


def first_subjects(messages: DataFrame, n: int = 10) -> DataFrame:
    """The first n messages with a subject per vendor, by date then id: date, id and subject."""
    return earliest_subjects(messages.filter("subject IS NOT NULL"), n)


def earliest_subjects(rows: DataFrame, n: int = 10) -> DataFrame:
    order = Window.partitionBy(*VENDOR).orderBy("date_ms", "message_id")
    return (
        rows.select(*VENDOR, "date_ms", "message_id", "subject")
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("rank"))


def joined_subjects(rows: DataFrame, n: int = 10) -> DataFrame:
    """One text per vendor from rows that hold its first n subjects (and may hold more)."""
    item = F.struct("date_ms", "message_id", "subject")
    return (
        earliest_subjects(rows, n).groupBy(*VENDOR)
        .agg(F.array_sort(F.collect_list(item)).alias("s"))
        .select(*VENDOR, F.array_join("s.subject", " ").alias("subjects")))


# Up to this rank, Spark cuts a ranked group to the wanted rows before the shuffle.
NEAR_RANK = 1000


def ranked_between(df: DataFrame, keys, order, first: int, last: int) -> DataFrame:
    """Rows with ``first < rank <= last`` in their group, with their ``rank``.

    ``order``: pairs (column, falling); nulls are smallest. Near ranks come from a window that is cut per partition; of farther ones, only the rows of a value range that is
    sure to hold them are ranked (:mod:`deep_pages`). Nothing is sorted or written as a whole.
    """
    if last <= NEAR_RANK:
        ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*sort_of(order))))
        return ranked.filter(F.col("rank") <= last).filter(F.col("rank") > first)
    near, earlier = narrowed(df, keys, order, first, last)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*sort_of(order)))
    ranked = near.withColumn("rank", place).join(earlier, list(keys)).withColumn("rank", F.col("rank") + F.col("_earlier"))
    return ranked.filter((F.col("rank") > first) & (F.col("rank") <= last)).drop("_earlier")


def page_of(df: DataFrame, keys, order, page: int, limit: int) -> DataFrame:
    """One page per key in the given order, with its ``rank``."""
    return ranked_between(df, keys, order, (page - 1) * limit, page * limit)
