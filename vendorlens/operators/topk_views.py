"""Newest-k lists that are kept, with a reserve, instead of being ranked again.

Of each key a view holds the first k + r rows in its order. Additions go into the list, deletions out of it; a deletion costs reserve only, and a key is
read from the base table again when fewer than k rows are left and there are more below. A list is one row, of k + r items at most:

``items`` (first ones first), ``floor`` (the last place up to which the list is complete, null if it holds all rows of the key), key columns.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import kept
from .topk import VENDOR, METHOD_PRIORITY


@dataclass(frozen=True)
class TopK:
    """The first ``k`` rows per ``keys`` by ``order`` (descending unless ``up``), of the rows that ``where`` lets in, with a reserve of ``reserve`` rows.

    ``order`` ends in the id, so no two rows of a key are equal in it; ``payload`` are further columns of an item. Rows without a key are in no list.
    """

    keys: tuple
    order: tuple
    payload: tuple = ()
    k: int = 20
    reserve: int = 20
    up: bool = False
    where: str = "true"

    def _rows(self, messages: DataFrame) -> DataFrame:
        item = F.struct(F.struct(*self.order).alias("at"), F.struct(*self.order, *self.payload).alias("value"))
        return messages.filter(self.where).dropna(subset=list(self.keys)).select(*self.keys, item.alias("item"))

    def _listed(self, rows: DataFrame) -> DataFrame:
        """Lists of rows of (keys, item, floor): cut to k + reserve; what is cut off lowers nothing but raises the floor."""
        most = self.k + self.reserve
        place = F.col("item.at")
        order = Window.partitionBy(*self.keys).orderBy(place.asc() if self.up else place.desc())
        # One row more than the list holds says that there are more.
        near = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most + 1)
        lists = near.groupBy(*self.keys).agg(
            F.sort_array(F.collect_list("item"), self.up).alias("items"), F.first("floor", ignorenulls=True).alias("floor"))
        cut = F.size("items") > most
        return (lists.withColumn("floor", F.when(cut, F.element_at("items", most)["at"]).otherwise(F.col("floor")))
                .withColumn("items", F.slice("items", 1, most)))

    def _inside(self, at: Column, floor: Column) -> Column:
        """Whether a place is where the list is complete."""
        return floor.isNull() | ((at <= floor) if self.up else (at >= floor))

    def build(self, messages: DataFrame) -> DataFrame:
        rows = self._rows(messages)
        return self._listed(rows.withColumn("floor", F.lit(None).cast(rows.schema["item"].dataType["at"].dataType)))

    def apply(self, view: DataFrame, added: DataFrame, deleted: DataFrame, messages: DataFrame):
        """(the view after a batch, the keys that were read from ``messages`` again).

        ``added`` and ``deleted`` are rows of the base table, those of a change of a row both: as it was and as it is. ``messages`` is the base table after the batch;
        only rows of the keys that ran out are read from it. ``view`` is read several times: pass one that is stored. The changed lists are stored, as they
        are used for the keys that ran out and for the others.
        """
        keys = list(self.keys)
        new, gone = self._rows(added), self._rows(deleted).select(*keys, F.col("item.at").alias("at"))
        touched = new.select(*keys).union(gone.select(*keys)).distinct()
        before = view.join(touched, keys, "left_semi")
        old = before.select(*keys, F.explode("items").alias("item"), "floor")
        arrived = new.join(before.select(*keys, "floor"), keys, "left").filter(self._inside(F.col("item.at"), F.col("floor")))
        left = old.select(*keys, "item", "floor").join(gone, [*[old[k].eqNullSafe(gone[k]) for k in keys], old["item.at"].eqNullSafe(gone["at"])], "left_anti")
        lists = self._listed(left.unionByName(arrived))
        # A list that lost all its items has no row by now, but still its floor.
        known = before.select(*keys, F.col("floor").alias("known"))
        empty = F.array().cast(view.schema["items"].dataType)
        lists = (known.join(lists, keys, "full").withColumn("floor", F.coalesce("floor", "known"))
                 .withColumn("items", F.coalesce("items", empty)).drop("known"))
        lists = kept(lists, "changed-lists")
        short = (F.size("items") < self.k) & F.col("floor").isNotNull()
        refilled = lists.filter(short).select(*keys)
        again = self.build(messages.join(refilled, keys, "left_semi"))
        untouched = view.join(touched, keys, "left_anti")
        after = untouched.unionByName(lists.filter(~short & (F.size("items") > 0)).select(*view.columns)).unionByName(again.select(*view.columns))
        return after, refilled

    def first(self, view: DataFrame) -> DataFrame:
        """The first k rows of every key, with their ``rank``."""
        items = F.slice("items", 1, self.k)
        return view.select(*self.keys, F.posexplode(items).alias("rank", "item")).select(*self.keys, "item.value.*", (F.col("rank") + 1).cast("bigint").alias("rank"))


_OPEN = "type = 'bulk' AND unsubscribe_url <> '' AND (status IS NULL OR status <> 'unsubscribed')"


def latest(k: int = 20, reserve: int = 20) -> TopK:
    """Kept form of ``topk.latest_messages``."""
    return TopK(tuple(VENDOR), ("date_ms", "message_id"), ("subject", "sender_email", "type"), k, reserve)


def first_subjects(k: int = 10, reserve: int = 10) -> TopK:
    """Kept form of ``topk.first_subjects``."""
    return TopK(tuple(VENDOR), ("date_ms", "message_id"), ("subject",), k, reserve, up=True, where="subject IS NOT NULL")


def methods(reserve: int = 4) -> TopK:
    """Kept form of ``topk.unsub_methods``: the newest open opt-out of each method of a vendor."""
    return TopK((*VENDOR, "unsubscribe_method"), ("date_ms", "message_id"), ("unsubscribe_url", "sender_email"), 1, reserve, where=_OPEN)


def subjects_of(view: DataFrame, spec: TopK) -> DataFrame:
    """One text per vendor, as ``topk.subjects_sample``."""
    texts = F.transform(F.slice("items", 1, spec.k), lambda i: i["value"]["subject"])
    return view.select(*VENDOR, F.array_join(texts, " ").alias("subjects"))


def best_of(view: DataFrame, spec: TopK) -> DataFrame:
    """The best method per vendor, as ``topk.best_unsub``."""
    rank = F.array_position(F.array(*[F.lit(m) for m in METHOD_PRIORITY]), F.col("method"))
    rows = spec.first(view).select(*VENDOR, F.col("unsubscribe_method").alias("method"), F.col("unsubscribe_url").alias("url"), "sender_email")
    return (rows.withColumn("priority", rank).filter("priority > 0").groupBy(*VENDOR)
            .agg(F.min(F.struct("priority", "method", "url", "sender_email")).alias("v")).select(*VENDOR, "v.method", "v.url", "v.sender_email"))
