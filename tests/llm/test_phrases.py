"""Phrase counts and collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vendorlens.llm import phrases

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_counts(rows):
    out = {}
    for text, lang in rows:
        counts = out.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            counts.update(tuple(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    return out


def plain_collocations(rows, top=2000, least=10):
    out = []
    for lang, f in plain_counts(rows).items():
        n, found = sum(v for g, v in f.items() if len(g) == 1), []
        for g, a in f.items():
            inside = [h for h in f if len(h) == 3 and f[h] >= least and 100 * f[h] >= 50 * a and g in (h[:2], h[1:])] if len(g) == 2 and a >= least else []
            if len(g) > 1 and a >= least and not inside:
                score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, n, -s) for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts():
    """Common words, one pair that makes up a third of all words with many words after it, all signs, long pieces, odd rows."""
    pick = random.Random(8)
    words = [f"w{k}" for k in range(30)] + ["É", "ÀB", "x\xa0y", "z\x0by"]
    rows = []
    for k in range(200):
        said = []
        for _ in range(pick.randint(0, 40)):
            said.append(pick.choice([*words, "Hot Pair " + pick.choice(words), "hot pair hot pair"]) + pick.choice(["", "", "", ",", ". ", "\t", "\n", " ; !"]))
        rows.append((" ".join(said), pick.choice(["en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), (" \t.,", "de"), ("a b c " * 3000, "en"), ("only", "xx")] + rows[:3]


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, "p") for r in rows], "text string, lang string, n int, phrase string").repartition(4)


@pytest.mark.parametrize("budget, block", [(1, 50), (200, 1000), (1 << 20, 1 << 19)])
def test_counts_whatever_the_groups(spark, budget, block):
    rows = texts()
    words, found = phrases.phrase_counts(table(spark, rows), least=3, budget=budget, block_words=block)
    want = plain_counts(rows)
    assert {(r.lang, r.word): r.n for r in words.collect()} == {(l, g[0]): v for l, f in want.items() for g, v in f.items() if len(g) == 1}
    got = {(r.lang, tuple(w for w in (r.w1, r.w2, r.w3) if w is not None)): r.f for r in found.collect()}
    assert got == {(l, g): v for l, f in want.items() for g, v in f.items() if len(g) > 1 and v >= 3}


def test_collocations_as_plain_version(spark):
    rows = texts()
    assert sorted(map(tuple, phrases.collocations(table(spark, rows)).collect())) == plain_collocations(rows)
    assert sorted(map(tuple, phrases.collocations(table(spark, rows), top=5, budget=100).collect())) == plain_collocations(rows, top=5)


def test_nothing_to_count(spark, no_documents, odd):
    assert phrases.collocations(no_documents).count() == 0
    want = plain_collocations([(r.text, r.lang) for r in odd.collect()])
    assert sorted(map(tuple, phrases.collocations(odd).collect())) == want and want


def test_long_pieces_come_in_chunks():
    words = [f"v{k % 7}" for k in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([" ".join(words)])], names=["lang", "text"])
    got, singles = Counter(), Counter()
    for _, block in phrases._blocks([batch], 1 << 20, chunk=9):
        names = [None, *block.words[1:]]
        for a, b, c, n in zip(*block.suffixes()):
            got[names[a], names[b], names[c]] += n
        ids = np.concatenate(block.parts)[np.concatenate(block.starts)]
        singles.update(names[i] for i in ids)
    padded = [*(w.encode() for w in words), None, None]
    assert got == Counter((padded[i], padded[i + 1], padded[i + 2]) for i in range(99)) and singles == Counter(padded[:100])


def test_groups_keep_the_budget():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 50, phrases.BUCKETS)
    words[[5, 6, 900]] = 10_000, 400, 399
    groups = phrases.Groups.of(words, np.full(phrases.BUCKETS, 500), 400)
    assert groups.cuts[5] == 25 and groups.cuts[6] == 1 and groups.parts[0] == 2
    load = np.bincount(groups.base[groups.cuts == 1], words[groups.cuts == 1])
    assert load.max() <= 400 and groups.base[6] >= groups.base[5] + 25


def test_scores_beyond_64_bits(spark):
    a, l, r = 3_000_000_000_000, 7_000_000_000_001, 9_000_000_000_003
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(phrases._score("a", "l", "r").alias("s")).first()
    assert row.s == 1_000_000 * a * a // (l * r)
