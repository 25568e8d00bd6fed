"""The pipeline against a plain version of its stages."""

import hashlib
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from vendorlens.llm import decontaminate
from vendorlens.llm.common import table

from test_decontaminate import brute
from test_secrets import ASSIGN
from test_similar import plain_kept


def plain_run(spark, sf, sets):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    docs = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t)}
    kept = set(plain_kept(sorted(docs.items()), sets))
    docs = {i: t for i, t in docs.items() if i in kept}
    items = [(str(r.item_id), tuple(decontaminate.words_of(r.text.encode()))) for r in table(spark, sf, "benchmark").collect()]
    word = re.compile("[0-9a-z\x80-\U0010ffff]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for i, text in list(docs.items()):
        places = [m.span() for m in word.finditer(text.translate(lower))]
        hit, _ = brute([text.translate(lower)[a:b].encode() for a, b in places], items, 10)
        if len(hit) > 0.5 * len(places):
            del docs[i]
            continue
        gone, run = [], []
        for k in range(len(places) + 1):
            if k in hit:
                run.append(k)
            elif run:
                gone.append((places[run[0]][0], places[run[-1]][1]))
                run = []
        for a, b in reversed(gone):
            text = text[:a] + text[b:]
        docs[i] = text
    for i, text in docs.items():
        spans = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        out, at = [], 0
        for a, b in sorted(spans):
            if a >= at:
                out += [text[at:a], "[secret]"]
            at = max(at, b)
        docs[i] = "".join(out) + text[at:]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in docs.items()}


def test_run_as_plain_version(spark, sf, sets):
    want = plain_run(spark, sf, sets)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.ids for r in rows} == want and len(rows) == len(want)
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() for r in rows)


def test_stages_keep_the_columns(spark, sf):
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_odd_documents_pass_all_stages(spark, sf, odd, no_documents):
    for docs in (odd, no_documents):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        docs.collect()


def test_rows_without_an_id_stay(spark, sf, odd):
    kept = corpus_pipeline.drop_near_duplicates(spark, odd, sf).collect()
    assert sum(r.doc_id is None for r in kept) == 2
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 4, 4, 5, 7, 8, 9, 10]


def test_tokens_are_made_in_small_blocks(monkeypatch):
    """The workers of four stages before are still there, so the last stage holds 4 MB of text in a task at most, or one document."""
    seen = {}
    monkeypatch.setattr(corpus_pipeline.bpe, "encode", lambda docs, path, **options: seen.update(options))
    corpus_pipeline.tokenize(None, None, None)
    assert seen["block_bytes"] <= 4 << 20
