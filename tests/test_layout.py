"""The clustered layout prunes by account and by date; counts of a write are those of the rows."""

from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from vendorlens.functions.dates import DAY_MS
from vendorlens.operators import enforcement, matching
from vendorlens.sources import layout, sinks
from vendorlens.verify import tables as t
from vendorlens.verify.joins import resolved


def mail(spark, n=60_000):
    day = F.lit(12_000) + F.col("id") * 7919 % 3000
    return spark.range(n).select(
        F.concat(F.lit("a"), F.col("id") % 200).alias("account_id"), F.concat(F.lit("m"), "id").alias("message_id"),
        F.when(F.col("id") % 97 > 0, day * DAY_MS).alias("date_ms"), F.sha2(F.col("id").cast("string"), 512).alias("subject"))


def groups(path):
    """Statistics of the row groups of a folder: (least, greatest) of account_hash and date_ms."""
    out = []
    for file in sorted(Path(path).rglob("*.parquet")):
        meta = pq.ParquetFile(file).metadata
        names = [meta.schema.column(c).name for c in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            found = {n: meta.row_group(g).column(i).statistics for i, n in enumerate(names)}
            out.append({n: (s.min, s.max) if s is not None and s.has_min_max else None for n, s in found.items()})
    return out


def read(found, **ranges):
    """Row groups that a reader can't skip."""
    return sum(all(g[c] is None or g[c][0] <= high and g[c][1] >= low for c, (low, high) in ranges.items()) for g in found)


def test_row_groups_read(spark, tmp_path):
    path, rows = str(tmp_path / "t"), mail(spark)
    layout.write_clustered(rows, path, 64, group_bytes=64 << 10)
    found = groups(path)
    one = spark.createDataFrame([("a17",)], "a string").select(layout.account_hash("a")).first()[0]
    month = (12_900 * DAY_MS, 12_930 * DAY_MS - 1)
    account, date = read(found, account_hash=(one, one)), read(found, date_ms=month)
    both = read(found, account_hash=(one, one), date_ms=month)
    assert len(found) >= 64 and account <= len(found) / 3 and date <= len(found) / 3 and both <= max(4, len(found) // 12)
    # Files of one order of account and day prune by account alone.
    plain = str(tmp_path / "plain")
    rows.withColumn("account_hash", layout.account_hash("account_id")).repartitionByRange(64, "account_hash", "date_ms").write.option("parquet.block.size", 64 << 10).parquet(plain)
    assert read(groups(plain), date_ms=month) > 2 * date


def test_rows_of_accounts_and_dates(spark, tmp_path):
    path, rows = str(tmp_path / "t"), mail(spark, 3000)
    layout.write_clustered(rows, path, 5)
    since, until = 12_500 * DAY_MS, 13_500 * DAY_MS
    for accounts, low, high in ((["a1", "a2", "none"], since, until), (None, since, None), (["a5"], None, None), (None, None, None), ([], None, None)):
        want = rows
        if accounts is not None:
            want = want.filter(F.col("account_id").isin(accounts))
        if low is not None:
            want = want.filter(F.col("date_ms") >= low)
        if high is not None:
            want = want.filter(F.col("date_ms") < high)
        got = layout.read_clustered(spark, path, accounts, low, high)
        assert sorted(map(tuple, got.select(*rows.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_undated_and_far_days_are_kept(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", "1", None), ("a", "2", -5 * DAY_MS), ("b", "3", 10**15), (None, "4", 0)], "account_id string, message_id string, date_ms long")
    layout.write_clustered(rows, path, 2)
    assert sorted(r["message_id"] for r in layout.read_clustered(spark, path).collect()) == ["1", "2", "3", "4"]


def test_counts_of_a_write_are_those_of_the_rows(spark, sf, tmp_path):
    companies, fines = t.companies(spark, sf), resolved(spark, sf)
    quality = F.coalesce("quality", F.lit("unknown"))
    names = ["verified", "tested", "unknown"]
    seen = sinks.write_counted(companies, str(tmp_path / "c"), {
        **{n: quality == n for n in names}, **{f"{n}_domains": (quality == n) & (F.size("domains") > 0) for n in names}})
    want = {r["quality"]: r for r in matching.company_profile(companies).collect()}
    assert seen["rows"] == spark.read.parquet(str(tmp_path / "c")).count() == companies.count()
    assert all((seen[n], seen[f"{n}_domains"]) == (want[n]["companies"], want[n]["with_domains"]) for n in names)

    tiers = enforcement.tier_of()
    kinds = ["override", "exact", "prefix", "name"]
    seen = sinks.write_counted(fines, str(tmp_path / "f"), {
        **{k: tiers == k for k in kinds}, **{f"{k}_regulator": (tiers == k) & F.col("dpa_country").isNotNull() for k in kinds}})
    want = {r["tier"]: r for r in enforcement.enforcement_profile(fines).collect()}
    assert all((seen[k], seen[f"{k}_regulator"]) == ((want[k]["fines"], want[k]["with_regulator"]) if k in want else (0, 0)) for k in kinds)


def test_counts_with_partitions_and_nothing_to_write(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 3).alias("p"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))
    seen = sinks.write_counted(rows, str(tmp_path / "t"), {"even": F.col("v").isNotNull(), "large": F.col("v") > 50}, ["p"])
    assert seen == {"rows": 100, "even": 50, "large": 24}
    assert sinks.write_counted(rows.limit(0), str(tmp_path / "n"), {"even": F.col("v").isNotNull()}) == {"rows": 0, "even": 0}
