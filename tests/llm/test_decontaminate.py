import random

import pytest

from vendorlens.llm import decontaminate as d


def brute(words, items, window):
    """(hit places, ids of items) by looking every window up."""
    windows = {}
    for i, w in items:
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(i)
    hit, found = set(), set()
    for n in {len(w) for w in windows}:
        for k in range(len(words) - n + 1):
            ids = windows.get(tuple(words[k:k + n]))
            if ids:
                hit.update(range(k, k + n))
                found |= ids
    return hit, found


@pytest.mark.parametrize("letters,window", [("ab", 3), ("abc", 4), ("abcdefgh", 5), ("a", 2)])
def test_random_words(letters, window):
    pick = random.Random(len(letters) * 10 + window)
    for _ in range(400):
        items = [(str(i), tuple(pick.choices(letters, k=pick.randint(0, 9)))) for i in range(4)]
        auto = d.SuffixAutomaton(items, window)
        for _ in range(4):
            words = pick.choices(letters + "z", k=25)
            spans, numbers = auto.match(words)
            hit, found = brute(words, items, window)
            assert {x for a, b in spans for x in range(a, b)} == hit
            assert {auto.ids[n] for n in numbers} == found
            assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_words():
    assert d.words_of("Ab-c É1 İx\x7fy".encode()) == ["ab".encode(), b"c", "É1".encode(), "İx".encode(), b"y"]
    assert d.words_of(None) == d.words_of(b"") == d.words_of(b" -!") == []


@pytest.fixture
def benchmark(spark):
    rows = [(2, "One two THREE four five six"), (10, "one two three"), (3, None), (4, "--"), (None, "zz zz zz"), (2, "One two THREE four five six")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_contamination(spark, odd, benchmark):
    rows = {(r.doc_id, r.n_words): r for r in d.contamination(odd, benchmark).collect()}
    assert rows[(5, 6)].n_hit == 6 and rows[(5, 6)]["items"] == ["10", "2"] and rows[(5, 6)].n_items == 2
    assert rows[(1, 0)].n_hit == 0 and rows[(1, 0)]["items"] == []
    assert sum(r.n_hit > 0 for r in d.contamination(odd, benchmark).collect()) == 3


def test_empty_tables(spark, odd, no_documents, benchmark):
    assert d.contamination(no_documents, benchmark).collect() == []
    assert all(r.n_hit == 0 for r in d.contamination(odd, benchmark.limit(0)).collect())


def test_removal(spark, benchmark, odd, no_documents):
    text = "Keep É this! One, two three; four five six. And some more clean words after it here"
    docs = spark.createDataFrame([(1, text, 83, 7), (2, "one two three four five six", 27, 7), (3, "clean", 5, 7), (4, None, None, 7)],
                                 "doc_id long, text string, n_chars long, n_hit int")
    out = {r.doc_id: r for r in d.remove_contamination(docs, benchmark).collect()}
    assert sorted(out) == [1, 3, 4]
    assert out[1].text == "Keep É this! . And some more clean words after it here" and out[1].n_chars == len(out[1].text)
    assert out[3].text == "clean" and out[4].text is None
    assert d.remove_contamination(odd, benchmark).count() == odd.count() - 3
    assert d.remove_contamination(no_documents, benchmark).count() == 0


@pytest.mark.parametrize("max_bytes", [1, 40])
def test_a_large_benchmark_comes_in_parts(odd, benchmark, max_bytes):
    """As many automata as parts, one pass each; the result is that of one."""
    assert sum(1 for _ in d.automata(benchmark, max_bytes=max_bytes)) > 1
    parts = d.contamination(odd, benchmark, max_bytes=max_bytes).collect()
    assert sorted(map(str, parts)) == sorted(map(str, d.contamination(odd, benchmark).collect()))
    kept = d.remove_contamination(odd, benchmark, max_bytes=max_bytes).collect()
    assert sorted(map(str, kept)) == sorted(map(str, d.remove_contamination(odd, benchmark).collect()))


@pytest.mark.parametrize("max_bytes", [1, 3 << 20])
def test_items_without_an_id_hit(spark, max_bytes):
    items = spark.createDataFrame([(None, "red green blue"), (None, "some other words"), (7, "red green blue"), (8, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a red green blue b some other words"), (2, "some other words"), (3, "clean")], "doc_id long, text string")
    rows = {r.doc_id: tuple(r)[1:] for r in d.contamination(docs, items, max_bytes=max_bytes).collect()}
    assert rows == {1: (8, 6, 2, ["7"]), 2: (3, 3, 1, []), 3: (1, 0, 0, [])}
    assert [r.text for r in d.remove_contamination(docs, items, max_coverage=0.9, max_bytes=max_bytes).orderBy("doc_id").collect()] == ["a  b ", "clean"]


def test_lengths_that_are_no_numbers_stay(spark, odd, benchmark):
    kept = d.remove_contamination(odd, benchmark, max_coverage=1.0, max_bytes=1)
    assert kept.columns == odd.columns and {r["n_chars"] for r in kept.collect()} == {"many"} and {r["_marks"] for r in kept.collect()} == {"m"}
