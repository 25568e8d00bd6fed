"""Vendor detail, recommended actions and the activity log."""

from pyspark.sql import DataFrame, functions as F

from ..functions import signals
from ..functions.signals import YEAR_MS
from ..operators import breaches as breach_ops, rollups, topk
from ..operators.joins import chunked_lists
from ..operators.rollups import VENDOR

TWO_YEARS_MS = int(2 * YEAR_MS)
TEN_YEARS_MS = int(10 * YEAR_MS)
MIN_MESSAGES = 5

_MESSAGE = ["date_ms", "message_id", "type", "subject", "sender_email", "unsubscribe_method", "unsubscribe_url", "status"]


#: Message lists of a vendor record: section, types (None: all), newest n.
MESSAGE_LISTS = (("all_messages", None, 20), ("bulk_messages", ("bulk",), 50), ("account_messages", ("transactional", "order"), 50))


def detail_sections(vendors: DataFrame, messages: DataFrame, actions: DataFrame, breaches: DataFrame, everyone: bool = False) -> DataFrame:
    """Lists of a vendor record as rows ``section, part, items``.

    Message lists are bounded by their newest-n rule and come from one scan: a message is a candidate of each
    list it belongs to, and lists are cut per partition before the shuffle. Senders, actions and breaches have no bound,
    so a long one comes in several parts; items are JSON objects. ``everyone``: ``vendors`` is the
    whole table, so messages need not be looked up in it.
    """
    keys = vendors.select(*VENDOR).distinct()
    mine = messages if everyone else messages.join(keys, VENDOR, "left_semi")
    acts = actions.join(keys, VENDOR, "left_semi")

    belongs = [F.when(F.lit(True) if types is None else F.col("type").isin(*types), F.lit(section)) for section, types, _ in MESSAGE_LISTS]
    longest = max(n for _, _, n in MESSAGE_LISTS)
    wanted = F.create_map(*[F.lit(x) for section, _, n in MESSAGE_LISTS for x in (section, n)])
    newest = topk.newest(mine.withColumn("section", F.explode(F.array_compact(F.array(*belongs)))), [*VENDOR, "section"], longest)
    lists = (
        newest.filter(F.col("rank") <= wanted[F.col("section")]).groupBy(*VENDOR, "section")
        .agg(F.sort_array(F.collect_list(F.struct(*_MESSAGE)), False).alias("l"))
        .select(*VENDOR, "section", F.lit(0).cast("bigint").alias("part"), F.transform("l", lambda x: F.to_json(x)).alias("items")))

    def parts(section, frame, item, by):
        return chunked_lists(frame, VENDOR, item, by=by).select(
            *VENDOR, F.lit(section).alias("section"), F.col("part").cast("bigint").alias("part"),
            F.transform("items", lambda x: F.to_json(x)).alias("items"))

    info = breach_ops.breach_info(vendors.select(*VENDOR, "first_seen"), breaches)
    return (
        lists
        .unionByName(parts("senders", rollups.sender_counts(mine), F.struct("message_count", "sender_email", "sender_name"),
                           ["sender_email", "sender_name"]))
        .unionByName(parts("activity", acts, F.struct("actioned_at", "action_id", "action_type", "message_count", "size_bytes"),
                           ["action_id"]))
        .unionByName(parts("breaches", info, F.struct("breach_date", "name", "domain", "pwn_count", "likely_affected"),
                           ["name"])))


def vendor_detail(vendors: DataFrame, companies: DataFrame, messages: DataFrame, actions: DataFrame) -> DataFrame:
    """One record per vendor: vendor, company facts, totals of its lists."""
    facts = companies.select(
        F.col("slug").alias("company_slug"), F.col("name").alias("company_name"),
        F.col("email").alias("company_email"), F.col("web").alias("company_web"))
    joined = vendors.join(facts, "company_slug", "left")
    risk = signals.computed_risk(F.col("category_id"), F.col("has_orders"), F.col("has_account"))
    latest = topk.newest(messages, VENDOR, 1).select(
        *VENDOR, F.col("message_id").alias("latest_message_id"), F.col("subject").alias("latest_subject"))
    acts = actions.groupBy(*VENDOR).agg(
        F.count(F.lit(1)).alias("action_count"), F.max("actioned_at").alias("last_action_at"))
    return (
        joined.join(latest, VENDOR, "left").join(acts, VENDOR, "left").fillna({"action_count": 0})
        .select(
            *VENDOR, "company_slug", "company_name", "company_email", "company_web", "name", "category_id",
            risk.alias("risk_level"), "message_count", "sender_count", "bulk_count", "first_seen", "last_seen",
            "has_marketing", "has_account", "has_orders", "status",
            "latest_message_id", "latest_subject", "action_count", "last_action_at"))


def activity_rows(actions: DataFrame, vendors: DataFrame) -> DataFrame:
    """Actions with the name of their vendor."""
    facts = vendors.select(
        *VENDOR, F.coalesce(F.nullif("name", F.lit("")), "vendor_key", F.lit("Unknown")).alias("vendor_name"),
        "company_slug")
    return actions.join(facts, VENDOR)


def activity_log(actions: DataFrame, vendors: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest actions of each account after ``offset``, with the account's ``total``."""
    total = actions.groupBy("account_id").agg(F.count(F.lit(1)).alias("total"))
    newest = [("actioned_at", True), ("action_id", False)]
    return (
        topk.ranked_between(activity_rows(actions, vendors), ["account_id"], newest, offset, offset + limit)
        .join(total, "account_id")
        .select("account_id", "rank", "total", "action_id", "vendor_key", "vendor_name", "company_slug",
                "action_type", "message_count", "size_bytes", "actioned_at"))


def recommend(vendors: DataFrame, messages: DataFrame, breaches: DataFrame, as_of_ms: int, newest: int = 50) -> DataFrame:
    """Ordered suggestions per vendor: breach steps, opt-outs, deletions, account checks.

    Opt-outs come from the ``newest`` bulk messages, in the order in which a method first shows there.
    """
    hit = (
        breach_ops.breach_info(vendors.select(*VENDOR, "first_seen"), breaches)
        .filter("likely_affected").select(*VENDOR).distinct().withColumn("affected", F.lit(True)))
    bulk = topk.latest_messages(messages, ["bulk"], newest)
    usable = F.coalesce(
        (F.col("unsubscribe_method") != "none") & (F.col("unsubscribe_method") != "")
        & (F.col("unsubscribe_url") != ""), F.lit(False))
    active = F.col("status").isNull() & (F.col("date_ms") > as_of_ms - TWO_YEARS_MS)
    methods = (
        bulk.groupBy(*VENDOR, F.when(usable, F.col("unsubscribe_method")).alias("method"))
        .agg(F.min("rank").alias("first"), F.bool_or(active).alias("active"))
        .groupBy(*VENDOR)
        .agg(F.bool_or("active").alias("active"),
             F.array_sort(F.collect_list(F.when(F.col("method").isNotNull(), F.struct("first", "method")))).alias("m")))
    total, last = F.col("message_count"), F.col("last_seen")
    seen = F.coalesce(last, F.lit(0)) > 0
    ancient = seen & (last < as_of_ms - TEN_YEARS_MS) & (total >= MIN_MESSAGES)
    stale = seen & (last < as_of_ms - TWO_YEARS_MS) & ~ancient & (total >= MIN_MESSAGES)
    marketing = (F.col("bulk_count") > 0) & (F.col("bulk_count") == total)
    affected = F.coalesce("affected", F.lit(False))

    def only(condition, *names):
        return F.when(condition, F.array(*[F.lit(n) for n in names])).otherwise(
            F.expr("array()").cast("array<string>"))

    none = F.expr("array()").cast("array<string>")
    unsub = F.when(
        F.coalesce("active", F.lit(False)),
        F.transform("m.method", lambda x: F.concat(F.lit("unsub-"), x))).otherwise(none)
    items = F.concat(
        only(affected, "breachReview", "breachAccess", "breachDeletion"),
        F.coalesce(unsub, none),
        only(marketing, "deleteMarketing"),
        only((total > 0) & ~marketing, "deleteAll"),
        only(ancient & ~affected, "checkActive"),
        only(stale & ~affected, "dataDeletion"))
    return (
        vendors.join(hit, VENDOR, "left").join(methods, VENDOR, "left")
        .select(*VENDOR, F.posexplode(items).alias("pos", "action")))
