import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vendorlens.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def same(docs, **options):
    """Every row of the operator as the library has it."""
    texts = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    rows = bpe.encode(docs, PATH, outputs=("ids", "decoded", "digests"), **options).collect()
    want = []
    for i, text in texts:
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        back = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), ids, back, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = [(str(r.doc_id), r.n_tokens, r.ids, r.decoded, r.ids_sha256, r.decoded_sha256) for r in rows]
    assert sorted(got) == sorted(want)


def test_documents(documents):
    same(documents)


@pytest.mark.parametrize("block_bytes", [1, 50, 100_000])
def test_odd_texts_in_blocks_of_any_size(odd, block_bytes):
    same(odd, block_bytes=block_bytes)


TEXTS = [
    "it's WE'RE you'd'll 's's don't''t", "a<|endoftext|>b <|startoftext|> <|END", "<|endoftext|><|endoftext|>", "ΑΣ ΣΑΣ ǅ İstanbul ẞ",
    "é ȩ́ ﬁ Å ｆｕｌｌ", "1²½Ⅷ٣ 12", "\x00\x1f\x85\xa0 　x", "日本語 テキスト 한국어", "👩‍👩‍👧 🏳️‍🌈", "µª º ÿ ß×÷", "H̱ẖ",
    "\x1c\x1d a\x0bb", "foo_bar--baz...", "‍x​", "'", "''s",
]


def test_hard_texts(spark):
    same(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))


def test_every_character_of_the_first_plane_block(spark):
    rows = [(i, "".join(chr(c) + "x " for c in range(i * 256, i * 256 + 256))) for i in range(0x30)]
    same(spark.createDataFrame(rows, "doc_id long, text string"))


def test_decode(spark):
    ids = spark.createDataFrame([(1, [320, 533]), (2, []), (3, None), (4, [49407, 10**6])], "doc_id long, ids array<int>")
    out = {r.doc_id: r.decoded for r in bpe.decode(ids, PATH).collect()}
    assert out == {1: LIBRARY.decode([320, 533], skip_special_tokens=False), 2: "", 3: None, 4: "<|endoftext|>"}


def test_empty_table(no_documents):
    assert bpe.encode(no_documents, PATH).collect() == []


def test_other_tokenizers_are_refused(no_documents):
    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.encode(no_documents, public_tokenizers.path("byte_bpe_50k.json"))
