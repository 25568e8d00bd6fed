"""Line dedup against a plain version, and the perfect hash by itself."""

import random

import numpy as np
import pytest

from vendorlens.llm import lines
from vendorlens.llm.perfect import PerfectHash

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def key(line):
    return line.strip(WHITE).translate(LOWER)


def plain(rows, least=10):
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least and i is not None:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        found = (text or "").split("\n")
        kept = [x for x in found if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(found), len(found) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, line int, place string").repartition(5)
    return sorted(map(tuple, lines.drop_repeated_lines(docs, **options).collect()), key=str)


@pytest.mark.parametrize("shard_lines", [1, 1 << 18])
def test_as_plain_version(spark, shard_lines):
    pick, pool = random.Random(4), ["A common line here", " a COMMON line here\t", "é" * 9, "é" * 10, "ÀÉÎ stays as it is", "short", "", "   ", *(f"line number {k}" for k in range(40))]
    rows = [(k // 2 if k % 7 else None, "\n".join(pick.choices(pool, k=pick.randint(0, 12)))) for k in range(120)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "a line that only one has\n" * 3), (504, "\n".join(f"line number {k % 40}" for k in range(5000))), rows[3], rows[3]]
    assert run(spark, rows, shard_lines=shard_lines) == plain(rows)


def test_odd_documents(spark, odd, no_documents):
    found = lines.drop_repeated_lines(odd).collect()
    assert sorted(((r.doc_id, r.text) for r in odd.collect()), key=str) and len(found) == odd.count()
    want = plain([(r.doc_id, r.text) for r in odd.collect()])
    assert sorted(map(tuple, found), key=str) == want
    assert lines.drop_repeated_lines(no_documents).count() == 0


def test_a_hot_line_is_dealt_to_parts(spark, monkeypatch):
    """The probes of one line of all documents go to many tasks, and each answers for its own."""
    written, plain_stored = {}, lines.stored

    def kept(df, name, **options):
        written[name] = plain_stored(df, name, **options)
        return written[name]

    monkeypatch.setattr(lines, "stored", kept)
    rows = [(k, f"the line of all documents\nown line of {k}") for k in range(400)]
    assert run(spark, rows) == plain(rows)
    assert max(r.parts for r in written["line-parts"].collect()) >= 4


def test_lines_that_meet_in_a_shard_by_64_bits_get_another_seed():
    import pyarrow as pa

    place, mark = np.array([8, 16, 24], np.int64), np.array([100, 92, 5], np.int64)  # 100 + 8 = 92 + 16
    row = {c: lines.build_shard(pa.table({"shard": pa.array([0] * 3, pa.int32()), "place": place, "mark": mark, "count": place, "first": place})).column(c)[0].as_py()
           for c in ("seed", "bits", "starts", "place")}
    assert row["seed"] == 3
    number = PerfectHash.unpacked(row["bits"], row["starts"]).numbers(lines._slot_keys(place, mark, 3))
    assert (np.frombuffer(row["place"], "<i8")[number] == place).all()


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 100_000])
def test_perfect_hash_numbers_all_keys(n, rng):
    keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    built = PerfectHash.build(keys)
    again = PerfectHash.unpacked(*built.packed())
    assert sorted(again.numbers(keys)) == list(range(len(keys)))
    others = again.numbers(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    assert ((others >= -1) & (others < max(1, len(keys)))).all()
    assert 64 * len(built.bits) <= 5 * len(keys) + 64 * 40
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([5, 5], np.uint64))
