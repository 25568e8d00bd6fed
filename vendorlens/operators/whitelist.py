"""Whitelists: senders that are covered, messages that are not, what can still be added."""

from pyspark.sql import DataFrame, functions as F

from ..functions import addresses

_OWNER = ["account_id", "sender_email"]


def whitelisted_senders(senders: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Distinct (account_id, sender_email) covered by an address or by a domain at or above theirs."""
    keys = senders.select(*_OWNER).distinct().withColumn(
        "value", F.explode(addresses.sender_suffixes(F.col("sender_email"))))
    listed = whitelist.select("account_id", F.lower("value").alias("value")).distinct()
    return (
        keys.join(listed, ["account_id", "value"], "left_semi")
        .select(*_OWNER).distinct())


def with_coverage(senders: DataFrame, whitelist: DataFrame, keys) -> DataFrame:
    """A table of one row per ``keys`` (which name the sender) with the flag ``covered``.

    The rows themselves go through the join and are gathered again, so what they were computed
    from is not read a second time.
    """
    values = [c for c in senders.columns if c not in keys]
    listed = whitelist.select("account_id", F.lower("value").alias("value")).distinct().withColumn("hit", F.lit(True))
    exploded = senders.withColumn("value", F.explode_outer(addresses.sender_suffixes(F.col("sender_email"))))
    joined = exploded.join(listed, ["account_id", "value"], "left")
    return joined.groupBy(*keys).agg(
        F.coalesce(F.bool_or("hit"), F.lit(False)).alias("covered"), *[F.first(c).alias(c) for c in values])


def not_whitelisted(messages: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Messages no whitelist entry covers. Coverage is decided once per sender, not per message."""
    covered = whitelisted_senders(messages, whitelist)
    return messages.join(covered, _OWNER, "left_anti")


def not_actioned(messages: DataFrame, actions: DataFrame) -> DataFrame:
    """Messages whose vendor has no ``unsubscribed`` action."""
    done = actions.filter(F.col("action_type") == "unsubscribed").select("account_id", "vendor_key").distinct()
    return messages.join(done, ["account_id", "vendor_key"], "left_anti")


def seed_whitelist(accounts: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Whitelist plus each account's own address, and its domain unless that is a webmail one."""
    email = F.lower("email")
    domain = addresses.mail_domain(email)
    own_domain = F.when(~domain.isin(addresses.dims.PERSONAL_DOMAINS), domain)
    added = accounts.select("account_id", F.explode(F.array_compact(F.array(email, own_domain))).alias("value"))
    return whitelist.select("account_id", "value").unionByName(added).distinct()


def edit_whitelist(whitelist: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """Adds entries that are new, keeps the first creation time of repeats, removes others."""
    keys = ["account_id", "value"]
    every = whitelist.unionByName(add.withColumn("value", F.lower("value")))
    first = every.groupBy(*keys).agg(F.min("created_at").alias("created_at"))
    gone = remove.select("account_id", F.lower("value").alias("value")).distinct()
    return first.join(gone, keys, "left_anti")


def whitelist_scope(vendors: DataFrame, senders: DataFrame, companies: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Per vendor, as rows: entries that apply (``entry``) and values that can be added (``option``).

    ``senders``: distinct account_id, vendor_key, sender_email.
    """
    owner = ["account_id", "vendor_key"]
    web = companies.select(F.col("slug").alias("company_slug"), "web")
    host = F.coalesce(
        addresses.bare_host(F.col("web")),
        F.nullif(F.regexp_extract(F.regexp_replace(F.lower(F.trim("web")), r"\Awww\.", ""), r"\A[^/:?#]+", 0), F.lit("")),
        F.lower(F.trim("vendor_key")))
    roots = (
        vendors.select(*owner, "company_slug").join(web, "company_slug", "left")
        .select(*owner, addresses.root_domain(host).alias("root")))
    entries = whitelist.select("account_id", F.lower(F.trim("value")).alias("value")).distinct()
    mails = senders.select(*owner, F.lower("sender_email").alias("value")).distinct()
    domains = mails.select(*owner, addresses.mail_domain(F.col("value")).alias("value")).distinct()
    by_value = mails.unionByName(domains.filter("value IS NOT NULL")).join(entries, ["account_id", "value"])
    rooted = entries.filter(~F.contains("value", F.lit("@"))).withColumn(
        "root", addresses.root_domain(F.col("value")))
    by_root = roots.join(rooted, ["account_id", "root"])
    known = by_value.select(*owner, "value").unionByName(by_root.select(*owner, "value")).distinct()
    options = mails.unionByName(roots.select(*owner, F.col("root").alias("value"))).distinct()
    addable = options.join(entries, ["account_id", "value"], "left_anti")
    return known.withColumn("kind", F.lit("entry")).unionByName(
        addable.select(*owner, "value").withColumn("kind", F.lit("option")))
