"""Shards and WARC audits."""

import zlib

import pytest
from pyspark.sql import functions as F

from vendorlens.llm import sharding, warc


def check_shards(rows, shards):
    total = sum(r.size for r in rows)
    per = [[r for r in rows if r.shard == k] for k in range(shards)]
    for mine in per:
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        if mine:
            largest = max(r.size for r in rows)
            assert abs(sum(r.size for r in mine) - total / shards) <= largest
    return per


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_documents(documents, shards):
    rows = sharding.shard(documents, shards).collect()
    texts = {r.doc_id: r.text.encode() for r in documents.collect()}
    assert len(rows) == len(texts)
    assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in rows)
    check_shards(rows, shards)


def test_shards_are_contiguous_and_keep_equal_texts_together(spark):
    docs = spark.createDataFrame([(i, "copy" if i % 3 == 0 else f"text number {i}") for i in range(900)], "doc_id long, text string").repartition(7)
    rows = sharding.shard(docs, 8).collect()
    check_shards(rows, 8)
    copies = sorted((r.shard, r.slot) for r in rows if r.size == 5)
    inner = {s for s, _ in copies} - {copies[0][0], copies[-1][0]}
    assert all(r.size == 5 for r in rows if r.shard in inner)
    again = sharding.shard(docs.orderBy(F.desc("doc_id")).repartition(3), 8).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_odd_documents(odd, no_documents):
    rows = sharding.shard(odd, 4).collect()
    assert len(rows) == odd.count()
    check_shards(rows, 4)
    assert [(r.size, r.text_crc32) for r in rows if r.doc_id == 1] == [(1, 0)]
    assert sharding.shard(no_documents, 4).collect() == []
    with pytest.raises(ValueError):
        sharding.shard(odd, 0)


@pytest.fixture(scope="module")
def records(spark, sf):
    return warc.lay_out(warc.to_records(spark.read.parquet(f"{sf}/pages.parquet")), volume_bytes=100_000)


def test_records_follow_each_other(records):
    rows = records.orderBy("leaf").collect()
    at = 0
    for n, r in enumerate(rows):
        assert (r.leaf, r.offset, r.volume, r.size) == (n, at, at // 100_000, len(r.payload))
        head, _, body = bytes(r.payload).partition(b"\r\n\r\n")
        length = int(dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert body == body[:length] + b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
        at += r.size


@pytest.mark.parametrize("fan", [2, 16, 1000])
def test_audit_finds_every_change(records, fan):
    n = records.count()
    assert warc.audit(records, records, fan).collect() == []
    hit = {0, 7, n // 2, n - 1}
    rotten = warc.bit_rot(records, F.col("leaf").isin(hit))
    assert {tuple(r) for r in warc.audit(records, rotten, fan).collect()} == {(x, "changed") for x in hit}


@pytest.mark.parametrize("fan", [2, 16])
def test_audit_finds_missing_and_extra_records(records, fan):
    n = records.count()
    fewer = records.filter(~F.col("leaf").isin(3, n - 1))
    assert {tuple(r) for r in warc.audit(records, fewer, fan).collect()} == {(3, "missing"), (n - 1, "missing")}
    assert {tuple(r) for r in warc.audit(fewer, records, fan).collect()} == {(3, "extra"), (n - 1, "extra")}
    assert {tuple(r) for r in warc.audit(records.filter("leaf = 0"), records, fan).collect()} == {(x, "extra") for x in range(1, n)}
    assert warc.audit(records, records.limit(0), fan).count() == n
    assert warc.audit(records.limit(0), records.limit(0), fan).collect() == []


def test_descent_reads_only_branches_that_differ(records):
    levels = warc.tree(warc.leaves(records), 4, "test-tree")
    n = records.count()
    assert [t.count() for t in levels] == [max(1, -(-n // 4**k)) for k in range(len(levels))] and levels[-1].count() == 1
    root = levels[-1].first()
    assert (root.start, root.stop) == (0, records.agg(F.sum("size")).first()[0])


def test_odd_pages(spark):
    rows = [(1, None, None, 5), (None, "u", "h", 5), (1, None, None, 5), (2, "u", "", 5), (3, "ü", "x" * 200_000, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, leaf int")
    laid = warc.lay_out(warc.to_records(pages))
    assert laid.count() == 5 and warc.audit(laid, laid).collect() == []
    assert warc.lay_out(warc.to_records(pages.limit(0))).collect() == []
