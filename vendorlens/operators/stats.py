"""Dashboard numbers, daily trend, impact, downloads."""

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import signals
from ..functions.dates import DAY_MS, utc_day

LEVELS = ["high", "medium", "low"]


def vendor_risk():
    return signals.computed_risk(F.col("category_id"), F.col("has_orders"), F.col("has_account"))


def risk_counts(vendors: DataFrame) -> DataFrame:
    """Vendors per account and computed risk level; levels without vendors show 0."""
    per_account = vendors.withColumn("risk", vendor_risk()).groupBy("account_id").agg(
        *[F.count_if(F.col("risk") == level).alias(level) for level in LEVELS])
    pairs = F.array(*[F.struct(F.lit(x).alias("risk_level"), F.col(x).alias("vendors")) for x in LEVELS])
    return per_account.select("account_id", F.inline(pairs))


def vendor_measures() -> dict:
    """The headline counts that vendors make: name and whether a vendor counts.

    Vendors carry the feature columns and ``on_breach_list``.
    """
    open_ = F.col("status").isNull() | (F.col("status") != "reviewed")
    actioned = (F.col("status") == "reviewed") | F.col("has_action")
    actioned = F.coalesce(actioned, F.col("has_action"))
    visible = (
        open_ & (F.col("has_account") | F.col("on_breach_list")) & ~F.col("is_personal")
        & (F.col("has_nonpersonal") | actioned) & (F.col("has_unwhitelisted") | actioned))
    return {
        "unique_vendors": visible,
        "mailing_lists": F.col("has_marketing") & F.col("has_unwhitelisted_bulk"),
        "breached": F.col("on_breach_list") & open_,
        "lists_actioned": F.col("has_marketing") & F.col("has_action"),
        "active_subscriptions": F.col("has_actionable_recent_bulk"),
        "reviewed": F.col("status") == "reviewed",
        "high_risk_unreviewed": visible & (vendor_risk() == "high")}


def dashboard(vendors: DataFrame, messages: DataFrame, actions: DataFrame) -> DataFrame:
    """Eight headline counts per account; messages give the total only."""
    counts = vendors.groupBy("account_id").agg(*[F.count_if(hit).alias(name) for name, hit in vendor_measures().items()])
    total = messages.groupBy("account_id").agg(F.count(F.lit(1)).alias("total_messages"))
    return (
        total.join(counts, "account_id", "full")
        .fillna(0))


def impact(actions: DataFrame) -> DataFrame:
    """Lists unsubscribed, mails deleted, bytes reclaimed per account."""
    kind = F.col("action_type")
    return actions.groupBy("account_id").agg(
        F.count_if(kind == "unsubscribed").alias("lists_unsubscribed"),
        F.coalesce(F.sum(F.when(kind.isin("trashed", "spam_reported"), F.col("message_count"))), F.lit(0))
        .alias("emails_deleted"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes_reclaimed"))


def daily_trend(messages: DataFrame, accounts: DataFrame, as_of_ms: int, days: int, most: int = 365) -> DataFrame:
    """Gap-free messages per account and UTC day over the last ``days`` days (1 to ``most``)."""
    if not 1 <= days <= most:
        raise ValueError(f"days must be from 1 to {most}")
    end = as_of_ms // DAY_MS * DAY_MS
    start = end - (days - 1) * DAY_MS
    day = utc_day(F.col("date_ms"))
    counted = (
        messages.filter(F.col("date_ms").between(start, end + DAY_MS - 1))
        .groupBy("account_id", day.alias("day")).agg(F.count(F.lit(1)).alias("n")))
    first, last = (utc_day(F.lit(x)) for x in (start, end))
    spine = accounts.select("account_id").distinct().withColumn("day", F.explode(F.sequence(first, last)))
    return spine.join(counted, ["account_id", "day"], "left").fillna({"n": 0})


def trend_marker(trend: DataFrame, starts: DataFrame) -> DataFrame:
    """Index of the first trend day on or after each account's start day, else of the last day."""
    position = F.row_number().over(Window.partitionBy("account_id").orderBy("day")) - 1
    indexed = trend.withColumn("pos", position).join(starts.select("account_id", "start_day"), "account_id")
    reached = F.when(F.col("day") >= F.col("start_day"), F.col("pos"))
    return indexed.groupBy("account_id").agg(F.coalesce(F.min(reached), F.max("pos")).alias("point"))


def trend_change(trend: DataFrame, period: int = 7) -> DataFrame:
    """Mean of the last ``period`` days against the ``period`` before: direction and percent."""
    p = max(1, int(period))
    back = F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("day")))
    ranked = trend.withColumn("back", back)
    means = ranked.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("days"),
        F.avg(F.when(F.col("back") <= p, F.col("n"))).alias("last"),
        F.avg(F.when(F.col("back").between(p + 1, 2 * p), F.col("n"))).alias("prev"))
    prev = F.nullif("prev", F.lit(0.0))
    raw = F.floor((F.col("last") - prev) / prev * 100 + 0.5)
    pct = (
        F.when(F.col("days") < 2 * p, 0)
        .when(F.col("prev") == 0, F.when(F.col("last") == 0, 0).otherwise(100))
        .otherwise(raw))
    direction = F.when(F.col("pct") == 0, "flat").when(F.col("pct") < 0, "down").otherwise("up")
    return means.withColumn("pct", pct.cast("bigint")).select(
        "account_id", direction.alias("direction"), F.abs("pct").alias("pct"))


def platform_of(asset):
    """Platform of a release file by its name."""
    n = F.lower(asset)
    return (
        F.when(F.endswith(n, F.lit(".exe")) | n.rlike("setup|windows|-win"), "win")
        .when(F.endswith(n, F.lit(".dmg")) | n.rlike("macos|darwin") | F.endswith(n, F.lit(".app.tar.gz")), "macos")
        .when(F.endswith(n, F.lit(".appimage")), "linux-appimage")
        .when(F.endswith(n, F.lit(".deb")), "linux-deb")
        .otherwise("other"))


def release_downloads(assets: DataFrame) -> DataFrame:
    """Downloads by release and platform, with totals per release, per platform and overall."""
    return (
        assets.withColumn("platform", platform_of(F.col("asset")))
        .cube("tag", "platform").agg(F.sum("download_count").alias("downloads"))
        .select(F.coalesce("tag", F.lit("(all)")).alias("tag"),
                F.coalesce("platform", F.lit("(all)")).alias("platform"), "downloads"))


def backfill_ranges(messages: DataFrame, cursor_ms: int, floor_ms: int, days: int = 90, stop_after: int = 3) -> DataFrame:
    """Messages a backwards walk from the cursor would read: ranges of ``days`` down to the floor,
    ended by ``stop_after`` empty ranges in a row. One job; the walk is found from range counts."""
    width = days * DAY_MS
    inside = messages.filter((F.col("date_ms") < cursor_ms) & (F.col("date_ms") >= floor_ms)).withColumn(
        "range", F.floor((F.lit(cursor_ms) - 1 - F.col("date_ms")) / width))
    filled = inside.groupBy("account_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.lag("range").over(Window.partitionBy("account_id").orderBy("range")), F.lit(-1))
    last = (
        filled.withColumn("gap", F.col("range") - before - 1)
        .groupBy("account_id")
        .agg(F.min(F.when(F.col("gap") >= stop_after, F.col("range"))).alias("stop")))
    reached = filled.join(last, "account_id").filter(F.col("stop").isNull() | (F.col("range") < F.col("stop")))
    return inside.join(reached.select("account_id", "range"), ["account_id", "range"], "left_semi")
