"""Row checks and the valid/quarantine split."""

from pyspark.sql import Column, DataFrame, functions as F

from ..dims.patterns import WHITE_SPACE

# Known message types.
MESSAGE_TYPES = ["bulk", "transactional", "order", "personal", "unknown"]

_PART = f"[^{WHITE_SPACE}@]+"


def is_email(col: Column) -> Column:
    return F.coalesce(col.rlike(rf"\A{_PART}@{_PART}\.{_PART}\z"), F.lit(False))


def is_domain(col: Column) -> Column:
    return F.coalesce(col.rlike(r"\A[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\z"), F.lit(False))


def is_email_or_domain(col: Column) -> Column:
    return is_email(col) | is_domain(col)


def is_message_type(col: Column) -> Column:
    return F.coalesce(col.isin(MESSAGE_TYPES), F.lit(False))


def flag_failures(df: DataFrame, rules: dict) -> DataFrame:
    """Adds ``failed``: names of the rules (name -> Column) a row breaks."""
    checks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("failed", F.array_compact(F.array(*checks)))


def split_valid(df: DataFrame, rules: dict):
    """(valid rows, quarantined rows with ``failed``)."""
    flagged = flag_failures(df, rules)
    bad = F.size("failed") > 0
    return flagged.filter(~bad).drop("failed"), flagged.filter(bad)
