"""The registered queries beside their SQL, and the ones without it by their contract."""

import pytest

import __spark_entry__ as entry
from vendorlens.llm import queries
from vendorlens.llm.common import table
import sqlcheck as check


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, con, key):
    df = queries.QUERIES[key](spark, sf)
    found = con.execute(queries.ORACLES[key])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check.rows_of(names, found.fetchall())


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


COLUMNS = {
    "op1": "page_id bigint, url string, text string, n_chars bigint",
    "op2": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op4": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op6": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op8": "doc_id bigint, fingerprint string, component_id bigint",
    "op9": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op10": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op13": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
}


OTHERS = {
    "op11": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
}


@pytest.mark.parametrize("key", [k for k in queries.QUERIES if k.split("_")[0] in OTHERS])
def test_columns_of_the_contract(spark, sf, key):
    assert ", ".join(f"{n} {t}" for n, t in queries.QUERIES[key](spark, sf).dtypes) == OTHERS[key.split("_")[0]]


@pytest.mark.parametrize("key", [k for k in queries.QUERIES if k.split("_")[0] in COLUMNS])
def test_columns_and_rows_of_the_contract(spark, sf, key):
    df = queries.QUERIES[key](spark, sf)
    assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == COLUMNS[key.split("_")[0]]
    source = {"op1": "pages", "op10": "embeddings"}.get(key.split("_")[0], "documents")
    assert df.count() == table(spark, sf, source).count()


def test_secret_digests(spark, sf):
    import hashlib

    from test_secrets import brute

    rows = {r.doc_id: r for r in queries.op2_secret_scan(spark, sf).collect()}
    for doc in table(spark, sf, "documents").collect():
        want, row = brute(doc.text), rows[doc.doc_id]
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex"))
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(filter(None, row.spans.split(",")))
