"""Language identification by prediction by partial matching (PPM).

Per language, a tree of byte contexts of order 0 to 3 counts which byte follows. The code length of a byte
is that of the longest context in the tree; a byte not seen there costs an escape and is coded in the next
shorter context. The statistics are frozen after training, so the cost of a byte depends on it and
the three bytes before only. Every context that the training texts hold is kept, sparsely: a code length for each byte seen in it and one for the escape.
A text is scored whole, its different four-byte runs once for each language; the language with the least total wins.

A language of the given tables has up to 6,600 contexts of three bytes and takes 0.2 to 0.35 MB: 1.3 MB to broadcast for four languages, about 35 MB for 100. Trees are built in tasks, one a
language, of the bounded sample; the driver sees them packed.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, byte_texts, id_crc, tidied

ORDER = 3
UNKNOWN = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return _ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text))


def normalized(data: bytes) -> bytes:
    """Lower case: shouting is the same language."""
    return data.lower() if data.isascii() else data.decode().lower().encode()


def _code(data: np.ndarray) -> np.ndarray:
    """Each byte with the three before it, as one number; ``data`` starts with three bytes of padding."""
    d = data.astype(np.int64)
    return (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]


def training_sample(docs: DataFrame, per_language: int, doc_id="doc_id", text="text", lang="lang") -> DataFrame:
    """``lang, text`` of at most ``per_language`` labelled documents of each language outside the held-out fold.

    Texts are read whole; ids alone are chosen from."""
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (id_crc(doc_id) % 4 != 2))
    chosen = bounded_sample(labelled.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang")), "lang", per_language)
    texts = labelled.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    # At most per_language rows of a few bytes for each language.
    return texts.join(F.broadcast(chosen), ["id", "lang"]).select("lang", "text")


def context_counts(sample: DataFrame) -> DataFrame:
    """``lang, code, n``: how often four bytes follow each other in the texts of a language, lower-cased."""
    def run(batches):
        for batch in batches:
            texts = {}
            for lang, data in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                texts.setdefault(lang, []).append(normalized(data))
            for lang, parts in texts.items():
                codes, n = np.unique(_code(np.frombuffer(b"\n\n\n" + b"\n\n\n".join(parts), np.uint8)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "code", "n"])

    return sample.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Tree:
    """The contexts of one language: ``seen[k]`` are runs of k + 1 bytes, ascending, with the ``bits`` of the last one after the others;
    ``contexts[k]`` are runs of k bytes with the bits of an ``escape``."""

    def __init__(self, arrays: list):
        self.seen, self.bits, self.contexts, self.escape = ([arrays[4 * k + i] for k in range(ORDER + 1)] for i in range(4))

    @classmethod
    def of(cls, codes: np.ndarray, n: np.ndarray) -> "Tree":
        """From counts of four-byte runs. Escapes follow method C: with T symbols seen in a context, d of
        them distinct, a seen symbol has n / (T + d), an unseen one d / (T + d) times its share in the shorter context."""
        arrays = []
        for k in range(ORDER + 1):
            seen, at = np.unique(codes & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            count = np.bincount(at, n)
            contexts, of = np.unique(seen >> 8, return_inverse=True)
            distinct, total = np.bincount(of), np.bincount(of, count)
            both = np.log2(total + distinct)
            arrays += [seen.astype("<u4"), (both[of] - np.log2(count)).astype("<f4"), contexts.astype("<u4"), (both - np.log2(distinct)).astype("<f4")]
        return cls(arrays)

    def packed(self) -> list:
        return [x.tobytes() for k in range(ORDER + 1) for x in (self.seen[k], self.bits[k], self.contexts[k], self.escape[k])]

    @classmethod
    def unpacked(cls, data: list) -> "Tree":
        return cls([np.frombuffer(x, kind) for x, kind in zip(data, ["<u4", "<f4"] * 2 * (ORDER + 1))])

    def cost(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each four-byte run after the others."""
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        for k in range(ORDER, -1, -1):
            run = codes[open_] & np.uint32((1 << 8 * (k + 1)) - 1)
            at, found = _find(self.seen[k], run)
            out[open_[found]] += self.bits[k][at[found]]
            open_, context = open_[~found], run[~found] >> np.uint32(8)
            at, known = _find(self.contexts[k], context)
            out[open_[known]] += self.escape[k][at[known]]
        out[open_] += 8
        return out


def _find(sorted_: np.ndarray, values: np.ndarray):
    """(places of the values in an ascending array, which ones are there)."""
    at = np.minimum(np.searchsorted(sorted_, values), max(0, len(sorted_) - 1))
    return at, sorted_[at] == values if len(sorted_) else np.zeros(len(values), bool)


@dataclass
class Trees:
    """The trees of all languages; ``most_bits`` is the bound on bits per byte above which a text is of none of them."""

    languages: list
    trees: list
    most_bits: float = float("inf")

    def score(self, texts: list) -> np.ndarray:
        """Total bits of each text (normalized bytes) under each language, in pieces of bounded size."""
        total = np.zeros((len(texts), len(self.languages)))
        pieces, held = [], 0
        for i, data in enumerate(texts):
            for at in range(0, len(data), 1 << 20):
                piece = (b"\n\n\n" + data[:1 << 20]) if at == 0 else data[at - 3:at + (1 << 20)]
                pieces.append((i, piece))
                held += len(piece)
                if held > 1 << 20:
                    self._add(total, pieces)
                    pieces, held = [], 0
        self._add(total, pieces)
        return total

    def _add(self, total, pieces):
        if not pieces:
            return
        lengths = np.array([len(p) for _, p in pieces])
        codes, of = np.unique(_code(np.frombuffer(b"".join(p for _, p in pieces), np.uint8)).astype(np.uint32), return_inverse=True)
        ends = np.cumsum(lengths) - 3
        # The places that mix two pieces, the first three of all but the first piece, lie between end and next start.
        bounds = np.stack([ends - lengths + 3, ends], axis=1).ravel()
        owners = [i for i, _ in pieces]
        for k, tree in enumerate(self.trees):
            bits = np.append(tree.cost(codes)[of], 0.0)
            np.add.at(total[:, k], owners, np.add.reduceat(bits, bounds)[::2])


def build_trees(counts) -> Trees:
    """Trees from ``(lang, code, n)`` rows; every context is kept."""
    by_lang = {}
    for lang, code, n in counts:
        by_lang.setdefault(lang, []).append((code, n))
    languages = sorted(by_lang)
    return Trees(languages, [Tree.of(*np.array(by_lang[x], np.int64).T) for x in languages])


def _packed(table: pa.Table) -> pa.Table:
    tree = Tree.of(table.column("code").to_numpy(), table.column("n").to_numpy())
    return pa.table({"lang": table.column("lang")[:1].combine_chunks(), "tree": pa.array([tree.packed()], pa.list_(pa.binary()))})


def train(docs: DataFrame, per_language: int = 1500, doc_id="doc_id", text="text", lang="lang", bounded: bool = False) -> Trees | None:
    """Trees of the languages in ``docs``; None where no row may be learned from.

    ``per_language`` bounds the sample of documents, whose texts are read whole; more than 1,000 languages are refused. ``bounded``: the most bits per byte that
    a text of the sample has under its best language, and a quarter more, become ``most_bits``, or the eight of a plain byte if that is more.
    """
    sample = training_sample(docs, per_language, doc_id, text, lang)
    rows = sorted(context_counts(sample).groupBy("lang").applyInArrow(_packed, "lang string, tree array<binary>").collect())
    if not rows:
        return None
    trees = Trees([r["lang"] for r in rows], [Tree.unpacked(r["tree"]) for r in rows])
    if bounded:
        shared = docs.sparkSession.sparkContext.broadcast(trees)

        def run(batches):
            for batch in batches:
                texts = [normalized(x) for x in byte_texts(batch.column(1))]
                bits = shared.value.score(texts).min(axis=1) / [max(1, len(x)) for x in texts]
                yield pa.RecordBatch.from_arrays([pa.array([bits.max() if len(bits) else 0.0], pa.float64())], names=["bits"])

        trees.most_bits = max(8.0, 1.25 * sample.mapInArrow(tidied(run), "bits double").agg(F.max("bits")).first()[0])
    return trees


def classify(trees: Trees | None, values: list):
    """(languages, scores) of texts given as bytes or None."""
    langs, scores = [UNKNOWN] * len(values), [0.0] * len(values)
    if trees is None:  # nothing to learn from
        return langs, scores
    mine = [i for i, x in enumerate(values) if x and has_letter(x.decode())]
    bits = trees.score([normalized(values[i]) for i in mine])
    if mine:
        best = bits.min(axis=1, keepdims=True)
        share = 1 / np.exp2(np.clip(best - bits, -1000, 0)).sum(axis=1)
        for i, k, x in zip(mine, bits.argmin(axis=1), share):
            langs[i], scores[i] = trees.languages[k], float(x)
    return langs, scores


def identify(docs: DataFrame, trees: Trees | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **limits) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    ``held_out``: the id's crc32 leaves 2 modulo 4; such rows are never learned from. ``lang_pred`` is ``und`` (score 0)
    where the text is null or has no letter, or there is nothing to learn from. Repeated rows give repeated rows. ``score`` is the share of the winner among
    all languages, 2 to the minus code length each. A null doc_id is neither held out nor learned from.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees or train(docs, doc_id=doc_id, text=text, lang=lang, **limits))

    def run(batches):
        for batch in batches:
            langs, scores = classify(shared.value, byte_texts(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    wanted = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(id_crc(doc_id) % 4 == 2, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return wanted.mapInArrow(tidied(run), f"doc_id {wanted.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, trees: Trees | None = None, text: str = "text", **limits) -> DataFrame:
    """``docs`` without the rows that are of no language: null texts, texts without a letter, and those whose code length
    under the best language is more than ``most_bits`` a byte. Columns stay.

    The bound is taken from the training texts, so that texts like them stay. Where there is nothing to learn from, only null texts and those
    without a letter go. Repeated rows stay or go together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees or train(docs, text=text, bounded=True, **limits))

    def run(batches):
        for batch in batches:
            values, known = byte_texts(batch.column(text)), shared.value
            kept = [bool(x) and has_letter(x.decode()) for x in values]
            mine = [i for i, k in enumerate(kept) if k]
            if known is not None and mine and np.isfinite(known.most_bits):
                texts = [normalized(values[i]) for i in mine]
                for i, data, bits in zip(mine, texts, known.score(texts).min(axis=1)):
                    kept[i] = bool(bits <= known.most_bits * len(data))
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)
