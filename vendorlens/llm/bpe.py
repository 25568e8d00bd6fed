"""BPE encoding and decoding through a table of distinct words.

1. Split: each task cuts its texts into the tokenizer's words and gathers documents into blocks. A block
   keeps its distinct words once, dealt into slices by word hash, and each document as positions in that list.
2. Encode: slices of all blocks meet by hash; there every distinct word is encoded once.
3. Join back: a block's ids return to the block, and each document reads them by position.
4. Decode: ids are joined with the id-to-piece table, whose size the vocabulary bounds.

What is shuffled is the distinct words of blocks, not the words of texts, so a word that makes up a third
of all text counts once per block. Nothing passes the driver but the tokenizer file.
"""

import hashlib
import json
import os
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.scratch import scratch_path
from .common import byte_texts, partitions, tidied, tidy

#: The normalizer and word pattern this operator knows: tokenizer files with others are refused.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _latin(kind: str) -> str:
    """The Latin-1 characters of one general category, as the inside of a character class."""
    return "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind)


class Splitter:
    """Texts to words, as the tokenizer's normalizer and pre-tokenizer do.

    Latin-1 texts, where normal forms change nothing, go through a plain pattern; all others through the library.
    Strings of the file's added tokens are words of their own.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        said = json.loads(spec)
        splits = said["pre_tokenizer"]["pretokenizers"]
        if [n["type"] for n in said["normalizer"]["normalizers"]] != NORMALIZERS or splits[0]["pattern"] != {"Regex": PATTERN}:
            raise ValueError("this tokenizer splits words in another way")
        added = said["added_tokens"]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or t["content"].split() != [t["content"]] for t in added):
            raise ValueError("added tokens must be plain strings")
        self.added = [t["content"] for t in added]
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        letters, numbers, white = _latin("L"), _latin("N"), "\\t-\\r \x85\xa0"
        self.plain = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{white}{letters}{numbers}]+")

    def words(self, text: str) -> list:
        if self.cut is not None and any(t in text for t in self.added):
            return [w for k, part in enumerate(self.cut.split(text)) for w in ([part] if k % 2 else self._words(part))]
        return self._words(text)

    def _words(self, text: str) -> list:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            normal = self.library.normalizer.normalize_str(text)
            return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return self.plain.findall(text.lower())


@lru_cache(maxsize=2)
def _splitter(spec: str) -> Splitter:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Splitter(spec)


class _Block:
    """Documents of one task whose words share one list."""

    def __init__(self):
        self.numbers, self.ids, self.streams, self.bytes = {}, [], [], 0

    def add(self, doc_id, words, size):
        number = self.numbers.setdefault
        self.ids.append(doc_id)
        self.streams.append(np.array([number(w, len(self.numbers)) for w in words], dtype="<u4"))
        self.bytes += size

    def rows(self, slices: int):
        """The block's positions as packed bytes, and its words by slice. Words are numbered by falling count."""
        every = np.concatenate(self.streams) if self.streams else np.zeros(0, "<u4")
        order = np.argsort(-np.bincount(every, minlength=len(self.numbers)), kind="stable")
        rank = np.empty(len(order), "<u4")
        rank[order] = np.arange(len(order), dtype="<u4")
        words = list(self.numbers)
        words = [words[i] for i in order]
        slice_of = [zlib.crc32(w.encode()) % slices for w in words]
        deal = {}
        for word, s in zip(words, slice_of):
            deal.setdefault(s, []).append(word)
        return {"doc_ids": self.ids, "counts": [len(s) for s in self.streams], "positions": _pack(rank[every]), "slice_of": _pack(np.array(slice_of)),
                "words": [{"slice": s, "text": _compress(" ".join(w).encode())} for s, w in deal.items()]}


def _dealt(slice_of: np.ndarray) -> np.ndarray:
    """Where each word comes to stand when the slices follow each other, each in the order of its words' numbers."""
    out = np.empty(len(slice_of), np.int64)
    out[np.argsort(slice_of, kind="stable")] = np.arange(len(slice_of))
    return out


def _compress(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _pack(numbers: np.ndarray) -> bytes:
    """Compressed: the first bytes of all numbers, then the second ones, and so on; the high ones are nearly all zero."""
    return _compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _blocks(docs: DataFrame, spec, slices: int, block_bytes: int) -> DataFrame:
    """One row per block. The number of a block is its task's partition and its place there."""
    id_type = docs.schema["doc_id"].dataType
    schema = (f"block long, doc_ids array<{id_type.simpleString()}>, counts array<bigint>, positions binary, slice_of binary, "
              "words array<struct<slice:int,text:binary>>")
    arrow = pa.schema([
        ("block", pa.int64()), ("doc_ids", pa.list_(to_arrow_type(id_type))), ("counts", pa.list_(pa.int64())),
        ("positions", pa.binary()), ("slice_of", pa.binary()),
        ("words", pa.list_(pa.struct([("slice", pa.int32()), ("text", pa.binary())])))])

    def run(batches):
        split, block, number = _splitter(spec.value).words, _Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                block.add(doc_id, split(data.decode()) if data else [], len(data or b""))
                if block.bytes >= block_bytes:
                    yield pa.RecordBatch.from_pylist([{"block": number, **block.rows(slices)}], arrow)
                    block, number = _Block(), number + 1
        if block.ids:
            yield pa.RecordBatch.from_pylist([{"block": number, **block.rows(slices)}], arrow)

    return docs.mapInArrow(tidied(run), schema)


def _encoded(words: DataFrame, spec) -> DataFrame:
    """``block, slice, sizes, ids``: the ids of each word of a slice, in order. A distinct word is encoded once per slice task."""
    def run(batches):
        tokenizer, known = _splitter(spec.value).library, {}
        for batch in batches:
            sizes, flat = [], []
            for text in batch.column("text").to_pylist():
                found = zstandard.ZstdDecompressor().decompress(text).decode().split(" ")
                new = [w for w in found if w not in known]
                for w, e in zip(new, tokenizer.encode_batch(new, add_special_tokens=False)):
                    known[w] = np.array(e.ids, dtype="<u4")
                ids = [known[w] for w in found]
                sizes.append(_pack(np.array([len(x) for x in ids])))
                flat.append(_pack(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("slice"), pa.array(sizes, pa.binary()), pa.array(flat, pa.binary())],
                names=["block", "slice", "sizes", "ids"])

    return words.mapInArrow(tidied(run), "block long, slice int, sizes binary, ids binary")


def pieces(path: str) -> list:
    """The id-to-piece table of a tokenizer file: the piece of id i at place i."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    table = said["model"]["vocab"] | {t["content"]: t["id"] for t in said["added_tokens"]}
    out = [""] * (max(table.values()) + 1)
    for piece, i in table.items():
        out[i] = piece
    return out


def _word_table(parts: list):
    """Ids of every word of a block, from its slices in order: (start of each word in flat, flat ids)."""
    if not parts:
        return np.zeros(1, np.int64), np.zeros(0, "<u4")
    sizes = np.concatenate([_unpack(s) for s, _ in parts])
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), np.concatenate([_unpack(i) for _, i in parts])


def _joined(start: np.ndarray, flat: np.ndarray, texts: np.ndarray) -> list:
    """For every word the texts of its ids, joined by one space: the join of ids with a table whose row i is that of id i."""
    of, bounds = texts[flat].tolist(), start.tolist()
    return [" ".join(of[a:b]) for a, b in zip(bounds, bounds[1:])]


def _digests(words, names, decoded):
    """Hashes of the ids, and of the pieces, of one document, without building either as a list of numbers."""
    ids = hashlib.sha256(" ".join(map(names.__getitem__, words)).encode()).hexdigest()
    return ids, hashlib.sha256(" ".join(map(decoded.__getitem__, words)).encode()).hexdigest()


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", outputs=("ids",),
           block_bytes: int = 32 << 20) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens`` and the chosen outputs.

    ``outputs``: ``ids`` (array<int>), ``decoded`` (the text the ids decode to, special tokens kept) and
    ``digests`` (``ids_sha256, decoded_sha256``: SHA-256 of the decimal ids joined by one space, and of the decoded text).
    Null and empty texts have no tokens. Ids may repeat or be null: rows are kept apart by their place.
    ``path`` is a tokenizer file of the driver; ``block_bytes`` bounds a task's memory, a longer text is a block of its own.
    """
    spark: SparkSession = docs.sparkSession
    with open(path, encoding="utf-8") as file:
        content = file.read()
    _splitter(content)  # refuses a file it doesn't know before any job starts
    spec, table = spark.sparkContext.broadcast(content), spark.sparkContext.broadcast(pieces(path))
    slices, wanted = partitions(spark), docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = wanted.schema["doc_id"].dataType

    # Written, so that the numbers of blocks and the positions in them can't change when a task runs again.
    folder, made = scratch_path(spark, "bpe-blocks"), _blocks(wanted, spec, slices, block_bytes)
    made.write.option("compression", "zstd").parquet(folder)
    blocks = spark.read.schema(made.schema).parquet(folder)
    words = (blocks.select("block", F.explode("words").alias("w")).select("block", "w.slice", "w.text")
             .repartition(slices, "slice"))
    returned = _encoded(words, spec)

    fields, arrow = ["doc_id " + id_type.simpleString(), "n_tokens long"], [("doc_id", to_arrow_type(id_type)), ("n_tokens", pa.int64())]
    if "ids" in outputs:
        fields, arrow = [*fields, "ids array<int>"], [*arrow, ("ids", pa.list_(pa.int32()))]
    if "decoded" in outputs:
        fields, arrow = [*fields, "decoded string"], [*arrow, ("decoded", pa.string())]
    if "digests" in outputs:
        fields, arrow = [*fields, "ids_sha256 string", "decoded_sha256 string"], [*arrow, ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    out_schema = pa.schema(arrow)

    def join(key, left: pa.Table, right: pa.Table) -> pa.Table:
        _splitter.cache_clear()  # the worker encoded words before; joining needs no tokenizer
        order = sorted(range(right.num_rows), key=right.column("slice").to_pylist().__getitem__)
        sizes, ids = right.column("sizes").to_pylist(), right.column("ids").to_pylist()
        start, flat = _word_table([(sizes[i], ids[i]) for i in order])
        lengths, columns = np.diff(start), {f.name: [] for f in out_schema}
        names = _joined(start, flat, np.array([str(i) for i in range(len(table.value))], object)) if "digests" in outputs else None
        decoded = _joined(start, flat, np.array(table.value, object)) if {"digests", "decoded"} & {*outputs} else None
        for row in left.to_pylist():
            places, moved = _unpack(row["positions"]), _dealt(_unpack(row["slice_of"]))
            at = 0
            for doc, count in zip(row["doc_ids"], row["counts"]):
                mine = moved[places[at:at + count]]
                at += count
                columns["doc_id"].append(doc)
                columns["n_tokens"].append(int(lengths[mine].sum()))
                if "ids" in outputs:
                    first, size = start[mine], lengths[mine]
                    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    columns["ids"].append(flat[np.repeat(first, size) + within].astype(np.int32))
                listed = mine.tolist() if decoded is not None else ()
                if "decoded" in outputs:
                    columns["decoded"].append(" ".join(map(decoded.__getitem__, listed)))
                if "digests" in outputs:
                    for name, value in zip(("ids_sha256", "decoded_sha256"), _digests(listed, names, decoded)):
                        columns[name].append(value)
        out = pa.table([pa.array(columns.pop(f.name), f.type) for f in out_schema], schema=out_schema)
        del names, decoded, start, flat, lengths
        tidy()
        return out

    return (blocks.select("block", "doc_ids", "counts", "positions", "slice_of").groupBy("block")
            .cogroup(returned.groupBy("block")).applyInArrow(join, ", ".join(fields)))


def decode(ids: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """``ids`` with a column ``decoded``: its ids joined with the id-to-piece table, in order, by one space.

    As the tokenizer's own decode with special tokens kept. Ids the table doesn't have give nothing; null gives null.
    """
    table = ids.sparkSession.sparkContext.broadcast(pieces(path))

    def run(batches):
        piece = table.value
        for batch in batches:
            out = [None if x is None else " ".join(piece[i] for i in x if i is not None and 0 <= i < len(piece))
                   for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    return ids.mapInArrow(run, StructType([*ids.schema.fields, StructField("decoded", StringType())]))
