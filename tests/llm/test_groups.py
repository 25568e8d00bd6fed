"""SimHash groups, embedding groups, components: all against pairwise comparison."""

import numpy as np
import pytest
import xxhash

from vendorlens.llm import embeddings, simhash
from vendorlens.llm.components import components


def plain_fingerprint(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for white in "\t\n\v\f\r":
        words = words.replace(white, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(documents):
    for row in documents.limit(60).collect():
        assert simhash.fingerprint(row.text.encode()) == plain_fingerprint(row.text)
    for text in ("", " \n", "A b", "a", "É b\x0bC d", "x\x1cy \x85 z w"):
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("segments", [8, 16, 32])
@pytest.mark.parametrize("bits", [0, 1, 2])
def test_near_pairs_are_all_pairs_once(spark, rng, segments, bits):
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    found = set()
    for c in centres:
        for _ in range(60):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(b)
            found.add(x)
    found |= {0, 1, 3, 7, 2**64 - 1, 2**63}
    signed = sorted(np.array(sorted(found), dtype=np.uint64).view(np.int64).tolist())
    rows = simhash.near_pairs(spark.createDataFrame([(x,) for x in signed], "fp long"), bits, segments).collect()
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_documents_as_pairwise(documents, sets):
    rows = documents.select("doc_id", "text").collect()
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    for i, (a, x) in enumerate(prints):
        sets.find(a)
        for b, y in prints[i + 1:]:
            if (x ^ y).bit_count() <= 2:
                sets.join(a, b)
    got = simhash.near_duplicates(documents).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{x:016x}", sets.find(i)) for i, x in prints}


def test_odd_documents(odd, no_documents):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    of = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    zero = "0" * 16
    assert of[(1, zero)] == of[(2, zero)] == of[(3, zero)] == of[(None, zero)] == 1
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5} and [r.component_id for r in rows].count(5) == 3
    assert simhash.near_duplicates(no_documents).collect() == []
    with pytest.raises(ValueError):
        simhash.near_duplicates(odd, max_bits=3)


def test_components(spark, rng, sets):
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, x) for x in range(5001, 5200)]
    edges += [(3, 3), (None, 4), (5, None), edges[0], edges[0][::-1]]
    for a, b in edges:
        if a is not None and b is not None and a != b:
            sets.join(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: sets.find(x) for x in sets.up} and len(got) == len(sets.up)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def planted(rng, n=240, dim=24):
    x = rng.normal(size=(n, dim))
    for k in range(0, n - 4, 5):
        x[k + 1] = x[k] * 3
        x[k + 2] = x[k] + rng.normal(size=dim) * rng.uniform(0.05, 0.6)
        x[k + 3] = x[k + 2] + rng.normal(size=dim) * 0.3
    return x


def cosine_links(rows, threshold=0.93):
    """Pairs by plain double-precision cosine."""
    good = [(i, l, np.array(v, float) / np.abs(v).max()) for i, v, l in rows if i is not None and l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    return [(a, b) for n, (a, l, x) in enumerate(good) for b, m, y in good[n + 1:]
            if l == m and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold]


@pytest.mark.parametrize("tile_rows", [7, 40, 1024])
def test_embeddings_as_pairwise(spark, rng, sets, tile_rows):
    rows = [(i, v.tolist(), int(i % 3 == 0)) for i, v in enumerate(planted(rng))]
    bad = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] * 24, [float("inf")] * 24, [1.0] * 23]
    rows += [(1000 + i, v, 0) for i, v in enumerate(bad)] + [(2000, rows[0][1], None), (2001, rows[0][1], None), (None, rows[0][1], 1)]
    rows += [(3000 + i, [1e200] * 24, 1) for i in range(3)] + [(3000, [1e200] * 24, 1)] + [(4000, [1.0] * 23, 0)]
    distinct = {r[0]: r for r in rows if r[0] is not None}.values()
    degree = dict.fromkeys([r[0] for r in distinct], 0)
    for a, b in cosine_links(distinct):
        degree[a] += 1
        degree[b] += 1
        sets.join(a, b)
    table = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    got = embeddings.near_duplicates(table, tile_rows=tile_rows).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (n, sets.find(i), sets.find(i) == i) for i, n in degree.items()}
    assert len(got) == len(degree) and sum(degree.values()) > 100


def test_error_bounds_hold(rng):
    x, y = rng.normal(size=(300, 48)) * 10.0 ** rng.integers(-5, 5, (300, 1)), rng.normal(size=(200, 48))
    (qx, sx, ex), (qy, sy, ey) = embeddings.quantize(x), embeddings.quantize(y)
    near = (qx.astype(float) @ qy.astype(float).T) * sx[:, None] * sy[None, :]
    exact = embeddings.unit_rows(x) @ embeddings.unit_rows(y).T
    assert (np.abs(near - exact) <= ey[None, :] + ex[:, None] * (1 + ey[None, :]) + 1e-12).all()


def test_threshold_is_exact(rng):
    """Pairs a hair above and below the threshold fall on their own side."""
    base = embeddings.unit_rows(rng.normal(size=(50, 32)))
    side = rng.normal(size=(50, 32))
    side = embeddings.unit_rows(side - (side * base).sum(axis=1, keepdims=True) * base)
    for shift, linked in ((1e-9, True), (-1e-9, False)):
        c = 0.93 + shift
        other = base * c + side * np.sqrt(1 - c * c)
        for k in range(50):
            i, _ = embeddings.links(base[k:k + 1], other[k:k + 1], 0.93, False)
            assert bool(len(i)) == linked


def test_forest_keeps_connections(rng, sets):
    ids = rng.permutation(500)
    i, j = rng.integers(0, 500, (2, 400))
    a, b = embeddings.forest(ids, i, j)
    other = type(sets)()
    for x, y in zip(i, j):
        if x != y:
            sets.join(int(ids[x]), int(ids[y]))
    for x, y in zip(a, b):
        other.join(int(x), int(y))
    assert {k: sets.find(k) for k in sets.up} == {k: other.find(k) for k in sets.up} and len(a) < len(sets.up)


def test_empty_embeddings(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(empty).collect() == []
    with pytest.raises(ValueError):
        embeddings.near_duplicates(empty, threshold=0)
