"""Language, quality and main text: held-out accuracy, exactness of the scores, odd rows."""

import collections
import math
import zlib

import numpy as np
import pytest

from vendorlens.llm import langid, layouts, mainhtml, quality


@pytest.fixture(scope="module")
def trees(documents):
    return langid.train(documents, per_language=30)


def test_language_of_held_out_documents(documents, trees):
    rows = {r.doc_id: r for r in langid.identify(documents, trees).collect()}
    truth = {r.doc_id: r.lang for r in documents.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [i for i, r in rows.items() if r.held_out]
    assert np.mean([rows[i].lang_pred == truth[i] for i in held]) > 0.97
    assert all(0 < r.score <= 1 for r in rows.values())


def test_code_lengths_are_those_of_the_trees(documents):
    counts = [tuple(r) for r in langid.context_counts(langid.training_sample(documents, 5)).collect()]
    trees, seen = langid.build_trees(counts), {}  # as production: no context is left out
    for lang, code, n in counts:
        b = code.to_bytes(4, "big")
        for k in range(4):
            seen.setdefault((lang, b[3 - k:3]), collections.Counter())[b[3]] += n

    def bits(lang, data):
        total, data = 0.0, b"\n\n\n" + data
        for i in range(3, len(data)):
            for k in (3, 2, 1, 0):
                c = seen.get((lang, data[i - k:i]))
                if c is None:
                    continue
                all_, kinds = sum(c.values()), len(c)
                if data[i] in c:
                    total -= math.log2(c[data[i]] / (all_ + kinds))
                    break
                total -= math.log2(kinds / (all_ + kinds))
            else:
                total += 8
        return total

    texts = [langid.normalized(r.text.encode())[:700] for r in documents.limit(6).collect()] + [b"", b"q", "zß ÿ 😀".encode()]
    scores = trees.score(texts)
    for text, row in zip(texts, scores):
        assert row == pytest.approx([bits(lang, text) for lang in trees.languages], abs=0.01)


def test_long_texts_score_as_their_whole(trees):
    text = langid.normalized(("Der Hund und die Katze. " * 150_000).encode())
    half = len(text) // 2
    whole = trees.score([text, text[:half]])
    rest = trees.score([text[half - 3:]])[0] - trees.score([text[half - 3:half]])[0]
    assert len(text) > 3 << 20 and whole[0] - whole[1] == pytest.approx(rest, rel=1e-4)


def test_odd_documents_have_a_language_or_none(odd, no_documents, trees):
    rows = langid.identify(odd, trees).collect()
    assert len(rows) == odd.count()
    none = {(r.doc_id, r.score) for r in rows if r.lang_pred == "und"}
    assert {i for i, _ in none} == {1, 2, 3, 10, None} and all(s == 0 for _, s in none)
    assert all(not r.held_out for r in rows if r.doc_id is None)
    assert langid.identify(no_documents).collect() == []
    assert langid.keep_identified(odd, trees).columns == odd.columns
    assert langid.keep_identified(odd, trees).count() == odd.count() - 5


def test_trees_built_in_tasks_are_those_of_the_counts(documents):
    counts = [tuple(r) for r in langid.context_counts(langid.training_sample(documents, 7)).collect()]
    one, two = langid.build_trees(counts), langid.train(documents, per_language=7)
    assert one.languages == two.languages and all(a.packed() == b.packed() for a, b in zip(one.trees, two.trees))
    assert sum(len(x) for t in two.trees for x in t.packed()) < 1 << 20


def test_texts_of_no_learned_language_go(spark, documents):
    texts = [(1, "这是一个没有人学过的语言的句子。" * 20), (2, "Это предложение на другом языке. " * 20), (3, documents.first().text), (4, "12 34"), (5, None)]
    extra = spark.createDataFrame([(i, t, None) for i, t in texts], "doc_id long, text string, lang string")
    rows = documents.select("doc_id", "text", "lang").unionByName(extra.withColumn("doc_id", langid.F.col("doc_id") + 10**9))
    kept = {r.doc_id for r in langid.keep_identified(rows).collect()}
    assert {i - 10**9 for i in kept if i >= 10**9} == {3}
    assert {r.doc_id for r in documents.collect() if r.text and any(map(str.isalpha, r.text))} <= kept


def test_without_labels_only_letterless_texts_go(odd):
    none = odd.withColumn("lang", langid.F.lit(None).cast("string"))
    assert langid.keep_identified(none).count() == odd.count() - 5


def test_without_labels_nothing_is_said(odd):
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


def test_quality_of_held_out_documents(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = {r.doc_id: r for r in quality.score(docs, known).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    held = [(r.quality, rows[r.doc_id].predicted) for r in known.collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_quality_learns_from_its_fold_only(spark, odd):
    """Labels of the held-out fold change nothing."""
    ids = [i for i in range(1, 200)]
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "BAD!! BAD!!") for i in ids], "doc_id long, text string")
    right = [(i, i % 2) for i in ids]
    wrong = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in right]
    a, b = (sorted(map(tuple, quality.score(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect())) for x in (right, wrong))
    assert a == b and all(r[3] == r[0] % 2 for r in a)


def test_quality_of_odd_rows(spark, odd, no_documents, labels):
    some = spark.createDataFrame([(5, 1), (5, 0), (2, 0), (9, 1), (None, 1), (7, None), (99, 1)], "doc_id long, quality int")
    rows = quality.score(odd, some).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score(odd, some.limit(0)).collect()} == {0.5}
    assert quality.score(no_documents, labels).collect() == []


def test_dual_coordinate_descent_finds_the_optimum(rng):
    """The gap between the primal and the dual closes."""
    rows = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(80)]
    y = np.where(rng.random(80) < 0.5, 1, -1)
    values, cost = [rng.normal(size=6) for _ in rows], np.full(80, 0.7)
    w = quality.dual_coordinate_descent(rows, values, y, cost, 30, rounds=3000)
    margin = np.array([y[i] * (w[r] @ v + w[-1]) for i, (r, v) in enumerate(zip(rows, values))])
    value = w @ w / 2 + (cost * np.maximum(0, 1 - margin)).sum()
    for _ in range(300):
        other = w + rng.normal(size=31) * rng.choice([1e-3, 1e-2, 0.1])
        m = np.array([y[i] * (other[r] @ v + other[-1]) for i, (r, v) in enumerate(zip(rows, values))])
        assert other @ other / 2 + (cost * np.maximum(0, 1 - m)).sum() >= value - 1e-3


def test_features_of_pieces_are_those_of_the_whole(monkeypatch):
    text = ("Some words, AND 12 more;\nlines " * 40).encode()
    whole = quality.features(text).tolist()
    monkeypatch.setattr(quality, "_PIECE", 37)
    assert quality.features(text).tolist() == whole


# Main text.

def test_layouts_not_seen_in_training():
    field, wrong, total = mainhtml.trained(), 0, 0
    for page in layouts.labelled_pages(60, seed=99):
        found = mainhtml.blocks(page)
        labels = [bool(b[0].main) for b in found]
        wrong += sum(a != b for a, b in zip(field.viterbi(found), labels))
        total += len(found)
    assert wrong / total < 0.01


def test_viterbi_is_the_best_of_all_chains():
    field = mainhtml.trained()
    page = "<nav><a>x</a></nav><article><h1>A b</h1><p>Some text here.</p></article><div class=comment><p>Some reply, then.</p></div><footer>c</footer>"
    found = mainhtml.blocks(page)
    scores, joined, t = field.emissions(found), mainhtml._joined(found), field.transition

    def total(chain):
        return sum(s for s, c in zip(scores, chain) if c) + sum(t[k, a, b] for k, a, b in zip(joined, chain, chain[1:]))

    chains = [[n >> i & 1 for i in range(len(found))] for n in range(1 << len(found))]
    assert total([int(x) for x in field.viterbi(found)]) == pytest.approx(max(map(total, chains)))


PAGES = [
    (None, ""), ("", ""), ("   ", ""), ("<p", ""), ("<html><body></body></html>", ""),
    ("<nav><a href=/>Home</a></nav><article><h1>T &amp; x</h1><p>A&nbsp;b\n c<br>d</p><script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>E <b>f</p></article><footer>&copy; g</footer>",
     "T & x\nA b c d\nE f"),
    ("<article><p>One &lt;b&gt; &#233;&eacute; two.<p>Three four.<div class='ad'>Buy now.</div><p>Five six.</article><section class=comments><p>Nice one, really.</p></section>",
     "One <b> éé two.\nThree four.\nFive six."),
    ("<main><p>Unclosed everything<p>is read anyway", "Unclosed everything\nis read anyway"),
    ("<body><aside class=sidebar><p>Links are here.</p></aside><article><p>Body of it, long enough.</p><form><label>Mail</label><input></form></article></body>", "Body of it, long enough."),
    ("<article><script>unclosed <p>hidden</p></article>", ""),
]


def test_main_text_of_small_pages():
    field = mainhtml.trained()
    for page, text in PAGES:
        assert field.extract(page or "") == text, page


TEXT = "The quick article text goes on here, with several words and commas, until it ends."
PARAGRAPHS = "".join(f"<p>{TEXT} {i}.</p>" for i in range(3))
SITES = {
    "plain": f"<body><h1>Title here</h1>{PARAGRAPHS}</body>",
    "unnamed": f"<body><ul><li><a href=a>Home</a></li><li><a href=b>About us</a></li></ul><div><h1>Title here</h1>{PARAGRAPHS}</div><div><p>Copyright 2020 Somebody</p></div></body>",
    "blog": f"""<body><div id=page><div id=masthead><h1>Blog name</h1><h2>just a blog</h2></div><div id=primary><article class='post hentry'>
        <h1 class=entry-title>Title here</h1><div class=entry-content>{PARAGRAPHS}<div class='sharedaddy'><a>Share this</a></div></div></article><div id=comments><h3>2 thoughts</h3>
        <ol class=comment-list><li><p>I think so too, thanks for the text.</p></li><li><p>Not me, really not.</p></li></ol><form id=commentform><p>Leave a reply here</p></form></div></div>
        <div id=secondary class=widget-area><h3>Recent</h3><ul><li><a>One post</a></li></ul></div><div id=colophon><p>Powered by something nice.</p></div></div></body>""",
    "news": f"""<body><header><a>News</a><nav><a>World</a><a>Sport</a></nav></header><div class='cookie-banner'><p>We use cookies to make this site better. Accept them all.</p></div>
        <main><article><h1>Title here</h1>{PARAGRAPHS}<aside class='newsletter-promo'><h3>Sign up</h3><p>Get our newsletter every day in your mail.</p></aside></article>
        <section class='read-more'><h2>More stories</h2><ul><li><a>Other story that is here</a></li></ul></section></main>
        <section class='readerComments'><p>Great article, thanks for it all.</p><p>I disagree with the writer, who is wrong.</p></section><footer><p>All rights reserved, and so on.</p></footer></body>""",
    "board": f"""<body><div class=topbar>Login</div><div class=content><h1>Title here</h1><div class='ad-unit'>Buy this thing now, it is cheap.</div>{PARAGRAPHS}</div>
        <div class=responses><div class=response><p>I like it a lot, thanks.</p></div></div></body>""",
    "notice": f"<body><article><div class='notice'>This text was updated yesterday, please note it.</div><h1>Title here</h1>{PARAGRAPHS}<form><p>Subscribe today, for free.</p><input></form></article></body>",
}


@pytest.mark.parametrize("site", SITES)
def test_sites_unlike_the_training_layouts(site):
    assert mainhtml.trained().extract(SITES[site]) == "\n".join(["Title here", *(f"{TEXT} {i}." for i in range(3))])


def test_main_text_of_the_table(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in mainhtml.extract_text(pages).collect()}
    for row in pages.collect():
        inside = re.search("<article>(.*)</article>", row.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in re.split("</?(?:p|h1)>", inside)]
        text = "\n".join(p for p in parts if p)
        assert (got[row.page_id].text, got[row.page_id].n_chars, got[row.page_id].url) == (text, len(text), row.url)


def test_odd_pages(spark):
    rows = [(i, None if i % 2 else "u", p, "clash", 3) for i, (p, _) in enumerate(PAGES)] + [(None, None, "<div>" * 3000 + "deep" + "</div>" * 3000, "", 1), (0, "u", None, "clash", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = mainhtml.extract_text(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert mainhtml.extract_text(pages.limit(0)).collect() == []


def test_pathological_markup_ends():
    field = mainhtml.trained()
    for page in ("<" * 200_000, '<a "' * 50_000, "<!--" * 50_000, "<p class='" * 20_000, "&" * 100_000, "<script>" * 20_000, "</p>" * 50_000):
        field.extract(page)
