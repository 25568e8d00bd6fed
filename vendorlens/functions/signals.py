"""Age, volume, risk, severity and report columns."""

from pyspark.sql import Column, functions as F

from .dates import DAY_MS

YEAR_MS = 365.25 * DAY_MS

# Parts of exposed data class names that set the severity of a breach.
HIGH_CLASSES = ["passport", "government issued", "driver", "bank account", "credit card",
                "social security", "health", "medical"]
MEDIUM_CLASSES = ["password", "date of birth", "phone", "physical address", "financial"]

SENSITIVE = ["financial", "healthcare", "government"]


def activity_signal(last_seen: Column, as_of_ms: int) -> Column:
    """Age class with half-open ranges; unknown when missing or 0."""
    days = (F.lit(as_of_ms) - last_seen) / DAY_MS
    return (
        F.when(last_seen.isNull() | (last_seen == 0), "unknown")
        .when(days < 90, "recent").when(days < 365, "active")
        .when(days < 730, "inactive").when(days < 1825, "stale")
        .otherwise("dead"))


def volume_signal(count: Column) -> Column:
    return (F.when(count <= 5, "oneoff").when(count <= 25, "low")
            .when(count <= 100, "medium").otherwise("high"))


def computed_risk(category: Column, has_orders: Column, has_account: Column) -> Column:
    """Risk level of a vendor; orders always weigh most, an unknown category is medium."""
    sensitive = category.isin(SENSITIVE)
    return (
        F.when(has_orders, "high")
        .when(sensitive & has_account, "high")
        .when(sensitive, "medium")
        .when(category.isin("social", "marketing") & has_account, "medium")
        .when(category.isin("social", "marketing"), "low")
        .when(category == "entertainment", "low")
        .otherwise("medium"))


def risk_rank(category: Column, has_orders: Column, has_account: Column) -> Column:
    """1 = high, 2 = medium, 3 = low, for sorting."""
    risk = computed_risk(category, has_orders, has_account)
    return F.when(risk == "high", 1).when(risk == "medium", 2).otherwise(3)


def severity(data_classes: Column) -> Column:
    """high, medium or low by the exposed data classes."""
    def any_of(words):
        return F.coalesce(
            F.exists(data_classes, lambda c: F.lower(c).rlike("|".join(words))), F.lit(False))
    return F.when(any_of(HIGH_CLASSES), "high").when(any_of(MEDIUM_CLASSES), "medium").otherwise("low")


def _fixed(value: Column, digits: int) -> Column:
    """Decimal text, halves away from zero, without grouping marks."""
    scale = 10 ** digits
    return F.format_string(f"%.{digits}f", F.floor(value * scale + 0.5) / scale)


def human_bytes(size: Column) -> Column:
    kb = 1024
    return (
        F.when(size < kb, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < kb ** 2, F.concat(_fixed(size / kb, 1), F.lit(" KB")))
        .when(size < kb ** 3, F.concat(_fixed(size / kb ** 2, 1), F.lit(" MB")))
        .otherwise(F.concat(_fixed(size / kb ** 3, 2), F.lit(" GB"))))


def human_count(n: Column) -> Column:
    return (
        F.when(n <= 0, "Unknown")
        .when(n >= 1_000_000, F.concat(_fixed(n / 1_000_000, 1), F.lit(" million")))
        .when(n >= 1_000, F.concat(_fixed(n / 1_000, 0), F.lit("K")))
        .otherwise(n.cast("string")))


def human_fine(eur: Column) -> Column:
    return (
        F.when(eur >= 1_000_000, F.concat(F.lit("€"), _fixed(eur / 1_000_000, 1), F.lit("M")))
        .when(eur >= 1_000, F.concat(F.lit("€"), _fixed(eur / 1_000, 0), F.lit("K")))
        .otherwise(F.concat(F.lit("€"), eur.cast("string"))))
