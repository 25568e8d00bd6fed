"""Change feeds to a mail store of messages and queryable vendors, in micro-batches.

Tables are append-only parquet folders, partitioned by ``bucket`` (a hash of the account) and by the pair (``batch``, ``change``): the micro-batch of
the feed, and the user's changes after it, from 1 on; the feed's own rows have change 0. Nothing is written twice or taken back; what is
current follows from joins and the greatest pair of a key:

* ``messages``: a row lives until a deletion of its id with a greater pair;
* ``changes``: deletions, by the feed or the user, and statuses the user gave; the latest since the message came counts;
* ``senders``: the rollup of a sender, written anew for the senders that a batch touches;
* ``vendors``: company, name, category, status and earliest subjects of a vendor, written anew likewise;
* ``companies``: which companies the store has been matched with.

Changes that the feed delivers again are dropped by the state of the stream (:func:`start_ingest`). A batch looks its ids up once, adds its own messages
to the rollups, and reads others only for vendors that it deletes or marks mail of. Run again, it overwrites its own partitions and nothing else.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators import ingest, matching, rollups, state, topk
from ..operators.state import ID, VENDOR
from ..plans.vendors import matched_vendors, with_lists
from ..sources.scratch import kept
from ..sources.sinks import write_table

LANDING_SCHEMA = """
account_id string, source string, folder string, id string, received_ms bigint,
headers array<struct<name:string,value:string>>, from_email string, from_name string, subject string,
body_text string, body_html string, snippet string, size_bytes bigint, ingest_ms bigint, op string, seq bigint
"""
ROLLUP = f"""sender_email string, message_count bigint, bulk_count bigint, size_bytes bigint, first_seen bigint, last_seen bigint,
    {", ".join(f"{n} boolean" for n in rollups.FLAGS)}, recent_ms bigint, named struct<bulk:boolean,date_ms:bigint,message_id:string,sender_name:string>"""
FACTS = ["company_slug", "name", "category_id", "risk_level", "status"]
SCHEMAS = {
    "messages": """account_id string, message_id string, sender_email string, sender_name string, subject string, date_ms bigint,
        body_preview string, headers map<string,string>, unsubscribe_url string, unsubscribe_method string,
        size_bytes bigint, vendor_key string, type string, status string""",
    "changes": "account_id string, message_id string, vendor_key string, kind string, status string",
    "senders": f"account_id string, vendor_key string, {ROLLUP}",
    "vendors": f"""account_id string, vendor_key string, {", ".join(f"{n} string" for n in FACTS)},
        subjects array<struct<date_ms:bigint,message_id:string,subject:string>>""",
    "companies": "account_id string, slug string",
}
_AT = "batch bigint, change bigint, bucket int"
_KEY = ["bucket", *VENDOR]


@dataclass(frozen=True)
class Tables:
    """Folders of one mail store, on shared storage. ``buckets`` is fixed with the store: as many as make one bucket's messages a few gigabytes."""
    root: str
    buckets: int = 64

    def path(self, name):
        return f"{self.root}/{name}"

    def bucket(self):
        return F.pmod(F.xxhash64("account_id"), F.lit(self.buckets)).cast("int")


def create(spark: SparkSession, tables: Tables):
    """Makes the empty tables of a store; those that are there stay as they are."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], f"{schema}, {_AT}").write.mode("append").partitionBy("bucket", "batch", "change").parquet(tables.path(name))


def _at():
    return F.struct("batch", "change")


def _read(spark: SparkSession, tables: Tables, name, before=None) -> DataFrame:
    """A table as it was before a pair (batch, change)."""
    rows = spark.read.schema(f"{SCHEMAS[name]}, {_AT}").option("basePath", tables.path(name)).parquet(tables.path(name))
    return rows if before is None else rows.filter((F.col("batch") < before[0]) | ((F.col("batch") == before[0]) & (F.col("change") < before[1])))


def _write(df: DataFrame, tables: Tables, name, at):
    rows = df.withColumns({"batch": F.lit(at[0]).cast("bigint"), "change": F.lit(at[1]).cast("bigint"), "bucket": tables.bucket()})
    write_table(rows.select(*StructType.fromDDL(f"{SCHEMAS[name]}, {_AT}").names), tables.path(name), ["bucket", "batch", "change"])


def _of(spark, tables, name, at) -> DataFrame:
    return _read(spark, tables, name).filter((F.col("batch") == at[0]) & (F.col("change") == at[1]))


def _latest(rows: DataFrame, keys) -> DataFrame:
    """The row of the greatest pair of each key."""
    names = [c for c in rows.columns if c not in ("batch", "change", *keys)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), _at()).alias("v")).select(*keys, *[F.col(f"v.{n}").alias(n) for n in names])


def _alive(spark, tables, before, columns) -> DataFrame:
    """Columns of the messages that no later deletion of their id takes back, with the last ``mark`` of the id."""
    mark = F.when(F.col("kind") == "mark", F.struct(_at().alias("at"), "status"))
    last = (_read(spark, tables, "changes", before).groupBy("bucket", *ID)
            .agg(F.max(F.when(F.col("kind") == "delete", _at())).alias("gone"), F.max(mark).alias("mark")))
    return (_read(spark, tables, "messages", before).select(*columns, "batch", "change").join(last, ["bucket", *ID], "left")
            .filter(F.col("gone").isNull() | (F.col("gone") < _at())).drop("gone"))


def live_messages(spark: SparkSession, tables: Tables, before=None) -> DataFrame:
    """Current messages with their current status, or those current before a pair (batch, change)."""
    rows = _alive(spark, tables, before, ["bucket", *StructType.fromDDL(SCHEMAS["messages"]).names])
    given = F.when(F.col("mark.at") > _at(), F.col("mark.status")).otherwise(F.col("status"))
    return rows.withColumn("status", given).drop("mark", "batch", "change")


def live_ids(spark: SparkSession, tables: Tables, before=None) -> DataFrame:
    """Id and vendor of the current messages: three columns of the large table."""
    return _alive(spark, tables, before, ["bucket", *ID, "vendor_key"]).select("bucket", *ID, "vendor_key")


def current_senders(spark: SparkSession, tables: Tables, before=None) -> DataFrame:
    """The sender rollup of all current messages, without reading messages."""
    return _latest(_read(spark, tables, "senders", before), [*_KEY, "sender_email"]).filter("message_count > 0")


def current_facts(spark: SparkSession, tables: Tables, before=None) -> DataFrame:
    """Company, name, category, status and earliest subjects of every vendor that ever had mail."""
    return _latest(_read(spark, tables, "vendors", before), _KEY)


def current_vendors(spark: SparkSession, tables: Tables) -> DataFrame:
    """Every vendor that ever had mail: counts, flags, company, name, category, status."""
    stats = current_senders(spark, tables).groupBy(*VENDOR).agg(
        *rollups.counts(), F.sum("bulk_count").alias("bulk_count"), *[F.bool_or(n).alias(n) for n in rollups.FLAGS])
    facts = current_facts(spark, tables).drop("subjects")
    full = rollups.on_stored_vendors(stats, facts, flags=rollups.FLAGS, counts=["message_count", "sender_count", "bulk_count"])
    return full.join(facts, VENDOR)


def vendor_table(spark: SparkSession, tables: Tables, whitelist, actions, breaches, as_of_ms) -> DataFrame:
    """The streamed vendors with every column that the vendor query, the dashboard and the suggestions ask for."""
    facts = current_facts(spark, tables).select(*VENDOR, *FACTS)
    return with_lists(facts, current_senders(spark, tables).drop("bucket"), whitelist, actions, breaches, as_of_ms)


def apply_batch(batch: DataFrame, batch_id: int, tables: Tables, accounts=None, companies=None, since_ms: int = None):
    """One micro-batch of an ordered change feed: net changes, first-wins append, deletions, refresh.

    ``since_ms`` leaves out added messages that are older by the date that normalization gives them;
    messages without any date, and all deletions, pass.
    """
    spark, at = batch.sparkSession, (batch_id, 0)
    if batch_id == 0:
        create(spark, tables)
    feed = batch.withColumn("message_id", ingest.message_id())
    net = state.net_changes(feed.select(*ID, "seq", "op"))
    own = _buckets(feed, tables)
    known = kept(live_ids(spark, tables, at).filter(own).join(net, ID), "known")
    added = ingest.ingest(batch.filter("op = 'add'"), accounts, keep=["seq"])
    if since_ms is not None:
        added = added.filter(F.col("date_ms").isNull() | (F.col("date_ms") >= since_ms))
    added = added.join(net.filter("op = 'add'").select(*ID), ID, "left_semi")
    fresh = state.first_writes(added, "seq").drop("seq").join(known.select(*ID), ID, "left_anti")
    _write(fresh, tables, "messages", at)
    gone = known.filter("op = 'delete'").select(*ID, "vendor_key").distinct()
    _write(gone.withColumns({"kind": F.lit("delete"), "status": F.lit(None).cast("string")}), tables, "changes", at)
    _refresh(spark, tables, at, own, companies)


def user_changes(spark: SparkSession, tables: Tables, delete=None, marks=None, vendor_status=None) -> int:
    """Writes what a user did after the last batch of the feed; returns the number of the change after that batch.

    ``delete``: ids (account_id, message_id). ``marks``: ids with ``status`` (null clears it). ``vendor_status``:
    vendors (account_id, vendor_key) with ``status``. Ids and vendors that are not stored change nothing.
    """
    create(spark, tables)
    last = last_change(spark, tables)
    at = (last[0], last[1] + 1)
    own = _buckets(reduce(DataFrame.unionByName, [f.select("account_id") for f in (delete, marks, vendor_status) if f is not None]), tables)
    stored = live_ids(spark, tables, at).filter(own).drop("bucket")
    written = _read(spark, tables, "changes").drop("bucket", "batch", "change").limit(0)
    if delete is not None:
        rows = stored.join(delete.select(*ID).distinct(), ID)
        written = written.unionByName(rows.withColumns({"kind": F.lit("delete"), "status": F.lit(None).cast("string")}))
    if marks is not None:
        written = written.unionByName(stored.join(marks.select(*ID, "status"), ID).dropDuplicates(ID).withColumn("kind", F.lit("mark")))
    _write(written, tables, "changes", at)
    _refresh(spark, tables, at, own, None, vendor_status)
    return at[1]


def _buckets(df: DataFrame, tables: Tables):
    """A filter on the buckets of the accounts of ``df``. As many numbers as the store has buckets come to
    the driver at most; as literals they prune the partitions of the store."""
    return F.col("bucket").isin([r["b"] for r in df.select(tables.bucket().alias("b")).distinct().collect()])


def _refresh(spark, tables, at, own, companies, vendor_status=None):
    """Rollups and facts of the vendors that a batch's messages, changes and companies touch."""
    upto = (at[0], at[1] + 1)
    new = _of(spark, tables, "messages", at).drop("batch", "change").filter("vendor_key IS NOT NULL")
    cut = kept(_of(spark, tables, "changes", at).filter("vendor_key IS NOT NULL").select(*_KEY).distinct(), "cut")
    old = current_senders(spark, tables, at).filter(own)
    rollup = rollups.sender_rollup(new.join(cut, _KEY, "left_anti"))
    added = rollups.merged(old.drop("bucket").join(rollup.select(*VENDOR, "sender_email"), [*VENDOR, "sender_email"], "left_semi").unionByName(rollup))
    subjects = topk.first_subjects(new.join(cut, _KEY, "left_anti"))
    if not cut.isEmpty():
        again = live_messages(spark, tables, upto).filter(own).join(cut, _KEY, "left_semi")
        counted = rollups.sender_rollup(again)
        # A sender without mail left has a row that says so.
        none = old.join(cut, _KEY, "left_semi").join(counted.select(*VENDOR, "sender_email"), [*VENDOR, "sender_email"], "left_anti").withColumn("message_count", F.lit(0).cast("bigint"))
        added = added.unionByName(counted).unionByName(none.drop("bucket"))
        subjects = subjects.unionByName(topk.first_subjects(again))
    _write(added, tables, "senders", at)

    before = current_facts(spark, tables, at)
    grown = new.select(*_KEY).distinct()
    if companies is not None:
        grown = grown.unionByName(_newly_matched(spark, tables, at, before, companies)).distinct()
    grown = kept(grown, "grown")
    touched = grown.unionByName(cut)
    if vendor_status is not None:
        # A status is written for stored vendors only.
        asked = vendor_status.select(*VENDOR).withColumn("bucket", tables.bucket())
        touched = touched.unionByName(asked.join(before.select(*_KEY), _KEY, "left_semi").select(*_KEY))
    earlier = before.join(touched.distinct(), _KEY, "right")
    known = earlier.join(cut, _KEY, "left_anti").select(*VENDOR, F.inline("subjects")).unionByName(subjects.select(*VENDOR, "date_ms", "message_id", "subject"))
    first = topk.earliest_subjects(known).groupBy(*VENDOR).agg(F.array_sort(F.collect_list(F.struct("date_ms", "message_id", "subject"))).alias("subjects"))
    # A vendor that only lost or was marked mail keeps the facts it had.
    rows = earlier.drop("subjects").join(first, VENDOR, "left")
    if companies is not None:
        senders = current_senders(spark, tables, upto).join(grown, _KEY, "left_semi").drop("bucket")
        texts = first.select(*VENDOR, F.array_join("subjects.subject", " ").alias("subjects"))
        facts = matching.categorize_by_subjects(matched_vendors(senders, companies), texts)
        found = F.struct(*FACTS[:-1]).alias("found")
        rows = rows.join(facts.select(*VENDOR, found), VENDOR, "left").withColumns(
            {c: F.when(F.col("found").isNotNull(), F.col(f"found.{c}")).otherwise(F.col(c)) for c in FACTS[:-1]})
        _write(companies.select(F.lit(None).cast("string").alias("account_id"), "slug"), tables, "companies", at)
    if vendor_status is not None:
        rows = state.set_status(rows, vendor_status.select(*VENDOR, "status"), VENDOR)
    _write(rows, tables, "vendors", at)


def _newly_matched(spark, tables, at, before, companies) -> DataFrame:
    """Vendors without a company that one of the companies new to the store matches: open vendors x new companies, beside the
    touched vendors x all companies of the batch. Old companies can't match them: they didn't before."""
    fresh = companies.join(_read(spark, tables, "companies", at).select("slug").distinct(), "slug", "left_anti")
    open_ = before.filter("company_slug IS NULL").select(*_KEY, "name", "company_slug")
    return matching.match_companies(open_, fresh).filter("company_slug IS NOT NULL").select(*_KEY)


def start_ingest(spark: SparkSession, source: str, tables: Tables, checkpoint: str, accounts=None,
                 companies=None, since_ms: int = None, files_per_batch: int = None, first_batch: int = 0):
    """Starts the ingest of a landing folder; returns the running query.

    It takes what is there and ends; a scheduler starts it again. The checkpoint, on shared storage, keeps the position and the changes delivered.
    """
    create(spark, tables)
    provider = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(provider, "").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    reader = spark.readStream.schema(LANDING_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(source).dropDuplicates(["account_id", "source", "folder", "id", "op", "seq"])
    return (
        rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda df, n: apply_batch(df, first_batch + n, tables, accounts, companies, since_ms)).start())


def last_change(spark: SparkSession, tables: Tables) -> tuple:
    """The greatest pair (batch, change) of the store; (-1, 0) where it is empty."""
    pairs = [_read(spark, tables, name).agg(F.max(_at()).alias("at")).first()["at"] for name in ("messages", "changes", "vendors")]
    return max([(-1, 0), *[(p["batch"], p["change"]) for p in pairs if p is not None]])


def next_batch(spark: SparkSession, tables: Tables) -> int:
    """First batch of a feed that follows everything in the store."""
    return last_change(spark, tables)[0] + 1


def replay_since(spark: SparkSession, source: str, tables: Tables, fresh_checkpoint: str, since_ms: int,
                 accounts=None, companies=None):
    """Feed position lost: reads everything since a time again, under a new checkpoint.

    Stored ids are skipped. Batch numbers go on where the store ended; the first one stays beside the checkpoint, for a replay that is started again.
    """
    create(spark, tables)
    path = fresh_checkpoint + ".first-batch"
    spark.createDataFrame([(next_batch(spark, tables),)], "n bigint").write.mode("ignore").parquet(path)
    return start_ingest(spark, source, tables, fresh_checkpoint, accounts, companies, since_ms, first_batch=spark.read.parquet(path).first()["n"])


def compact(spark: SparkSession, tables: Tables, target: Tables):
    """The current rows of a store under its last pair in a new folder, to which streams then write under their old checkpoint."""
    create(spark, target)
    last = last_change(spark, tables)
    _write(live_messages(spark, tables), target, "messages", last)
    _write(current_senders(spark, tables), target, "senders", last)
    _write(current_facts(spark, tables), target, "vendors", last)
    _write(_read(spark, tables, "companies").select("account_id", "slug").distinct(), target, "companies", last)
