"""Phrase collocations from suffix subtrees, built group by group (vertical partitioning as in ERA).

A suffix is a word and up to two words after it in its piece; all suffixes that start alike are a subtree. Subtrees are grouped so that
each group fits a memory budget:

1. Counting: words of each language, and totals of word hashes and of pair hashes in a fixed number of buckets.
2. Grouping: buckets of first words are put together up to the budget; a bucket above it is cut by the first two words, and
   a bucket of pairs above it by all three, so no word and no pair makes a group of its own size.
3. Building: each task turns its text into blocks of distinct suffixes with counts, and sends every group its part. A group merges the
   parts, sorts its suffixes (the leaves of its subtrees, three words deep) and reads the count of every phrase from the totals below it.

The driver holds the bucket totals and what they decide, of fixed size. Words and phrases never pass it.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import byte_texts, partitions, stored, tidied

#: Lower-cases A-Z, makes every byte that ends a piece a full stop and tabs spaces.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
BUCKETS = 1 << 14
_STOP, _END = b".", 0  # stands between pieces


def words_of(data: bytes | None) -> list:
    """The words of a text, with a full stop wherever a piece ends."""
    return (data or b"").translate(_BYTES).replace(_STOP, b" . ").split()


def _mixed(*hashes: np.ndarray) -> np.ndarray:
    """One hash of several, in order."""
    out = np.zeros(len(hashes[0]), np.uint64)
    with np.errstate(over="ignore"):
        for h in hashes:
            out = (out ^ h) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return out


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) % BUCKETS


class _Numbers(dict):
    """Words numbered from 1 in order of appearance."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


class _Block:
    """Suffixes of the texts of one language. ``words``: the words by number, 0 is the end of a piece."""

    def __init__(self):
        self.numbers, self.parts, self.starts, self.size = _Numbers({_STOP: _END}), [], [], 0

    def add(self, words: list, n: int):
        """The first ``n`` words of a text as starts of suffixes; ``words`` are these and up to two more."""
        ids = np.array([*map(self.numbers.__getitem__, words), _END], np.int64)
        self.parts.append(ids)
        self.starts.append((ids != _END) & (np.arange(len(ids)) < n))
        self.size += len(words)

    @property
    def words(self) -> list:
        return [b"", *list(self.numbers)[1:]]

    def pairs(self):
        """(first, second) of every place that a suffix starts from, but for the last words of pieces."""
        ids = np.append(np.concatenate(self.parts), _END)
        kept = np.concatenate(self.starts) & (ids[1:] != _END)
        return ids[:-1][kept], ids[1:][kept]

    def hashes(self, lang: str) -> np.ndarray:
        """A hash of every word with its language; place 0 is the end."""
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        return np.array([0, *(xxhash.xxh3_64_intdigest(w, seed) for w in self.words[1:])], np.uint64)

    def suffixes(self):
        """(first, second, third, count) of the distinct suffixes of two words or more; third is 0 where the piece ends."""
        ids = np.concatenate([*self.parts, np.zeros(2, np.int64)])
        first, second, third = ids[:-2], ids[1:-1], ids[2:]
        kept = np.concatenate(self.starts) & (second != _END)
        coded, count = np.unique((first[kept] << 42) | (second[kept] << 21) | third[kept], return_counts=True)
        return coded >> 42, (coded >> 21) & 0x1FFFFF, coded & 0x1FFFFF, count


def _blocks(batches, words: int, chunk: int = 1 << 19):
    """(language, block) of the texts of a task, in blocks of about ``words`` words of all languages together; a longer text comes in chunks."""
    held, size = {}, 0
    for batch in batches:
        for lang, data in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
            found = words_of(data)
            for at in range(0, len(found), chunk):
                held.setdefault(lang, _Block()).add(found[at:at + chunk + 2], min(chunk, len(found) - at))
                size += min(chunk, len(found) - at)
                if size >= words:
                    yield from held.items()
                    held, size = {}, 0
    yield from held.items()


def _counted(texts: DataFrame, block_words: int) -> DataFrame:
    """``lang, word, bucket, n``: counts of words with their bucket, and, with a null word, totals of the buckets of pairs."""
    def run(batches):
        pairs = np.zeros(BUCKETS, np.int64)
        for lang, block in _blocks(batches, block_words):
            ids, hashes = np.concatenate(block.parts), block.hashes(lang)
            n = np.bincount(ids[np.concatenate(block.starts)], minlength=len(hashes))[1:]
            first, second = block.pairs()
            pairs += np.bincount(_bucket(_mixed(hashes[first], hashes[second])), minlength=BUCKETS)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(block.words[1:], pa.binary()).cast(pa.string()),
                                              pa.array(_bucket(_mixed(hashes[1:])).astype(np.int32)), pa.array(n)], names=["lang", "word", "bucket", "n"])
        some = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.string()), pa.nulls(len(some), pa.string()),
                                          pa.array(some.astype(np.int32)), pa.array(pairs[some])], names=["lang", "word", "bucket", "n"])

    return (texts.mapInArrow(tidied(run), "lang string, word string, bucket int, n long")
            .groupBy("lang", "word", "bucket").agg(F.sum("n").alias("n")))


@dataclass
class Groups:
    """``base[b]``: the group of the bucket b of first words; it has ``cuts[b]`` groups, chosen by the pair. ``parts[p]``: into how many a bucket of pairs is cut."""

    base: np.ndarray
    cuts: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, pairs: np.ndarray, budget: int) -> "Groups":
        """From totals of buckets: neighbouring buckets share a group up to the budget, larger ones are cut."""
        cuts, base, number, held = np.maximum(1, -(-words // budget)), np.zeros(BUCKETS, np.int64), 0, 0
        for b, (n, c) in enumerate(zip(words.tolist(), cuts.tolist())):
            if held and (c > 1 or held + n > budget):
                number, held = number + 1, 0
            base[b] = number
            if c > 1:
                number += c
            else:
                held += n
        return cls(base, cuts, np.where(pairs > budget, -(-pairs // budget), 1))

    def place(self, one: np.ndarray, two: np.ndarray, three: np.ndarray):
        """(group, part, whether the counts of the pair are in several parts) of suffixes, by the hashes of their words."""
        bucket, pair = _bucket(_mixed(one)), _mixed(one, two)
        group = self.base[bucket] + (pair % self.cuts[bucket].astype(np.uint64)).astype(np.int64)
        # Pairs of a whole group of words stay together: the group is within the budget.
        parts = np.where(self.cuts[bucket] > 1, self.parts[_bucket(pair)], 1)
        return group, (_mixed(pair, three) % parts.astype(np.uint64)).astype(np.int64), parts > 1


def _packed(columns: list) -> bytes:
    """Whole numbers below 2**32, compressed: all lowest bytes, then all next ones, and so on."""
    planes = np.stack(columns).astype("<u4").view(np.uint8).reshape(len(columns), -1, 4)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.transpose(0, 2, 1)).tobytes())


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(n, 4, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4")[:, :, 0].astype(np.int64)


def _dealt(texts: DataFrame, groups: Groups, block_words: int) -> DataFrame:
    """``grp, part, lang, words, suffixes``: the suffixes of every block, dealt to their groups with the words they name."""
    shared = texts.sparkSession.sparkContext.broadcast(groups)  # three arrays of BUCKETS numbers
    names = ["grp", "part", "lang", "words", "suffixes"]

    def run(batches):
        for lang, block in _blocks(batches, block_words):
            found, words, hashes = block.suffixes(), np.array(block.words, object), block.hashes(lang)
            if not len(found[0]):
                continue
            group, part, open_ = shared.value.place(*(hashes[x] for x in found[:3]))
            unit = group * (part.max() + 1) + part
            order = np.argsort(unit, kind="stable")
            ends = np.flatnonzero(np.diff(unit[order])) + 1
            rows = []
            for mine in np.split(order, ends):
                columns = [x[mine] for x in found]
                used = np.zeros(len(words), bool)
                for x in columns[:3]:
                    used[x] = True
                used[_END] = False
                again = np.cumsum(used) * used
                columns[:3] = [again[x] for x in columns[:3]]
                rows.append((int(group[mine[0]]), int(part[mine[0]]), lang, zstandard.ZstdCompressor(level=1).compress(b" ".join(words[used])),
                             _packed([*columns, open_[mine]])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()))], names=names)

    return texts.mapInArrow(tidied(run), "grp long, part long, lang string, words binary, suffixes binary")


def _totals(columns: list, count: np.ndarray):
    """Sums of ``count`` over equal neighbours in all ``columns``: (place of the first of each, sum)."""
    new = np.ones(len(count), bool)
    new[1:] = np.any([np.diff(c) != 0 for c in columns], axis=0)
    at = np.flatnonzero(new)
    return at, np.add.reduceat(count, at)


def subtree_counts(parts: list, least: int):
    """Phrases of two and three words with their counts, from the leaves of a group's subtrees: rows (first, second, third or None, count).

    ``parts``: (words, suffixes) of blocks, the suffixes as (first, second, third, count, open) with places in words from 1. A pair whose counts
    are open is in several parts of its group and given whatever its count.
    """
    numbers, columns = {}, []
    for words, found in parts:
        ids = np.array([_END, *(numbers.setdefault(w, len(numbers) + 1) for w in words)], np.int64)
        columns.append([*(ids[x] for x in found[:3]), *found[3:]])
    one, two, three, count, open_ = (np.concatenate(x) for x in zip(*columns))
    order = np.lexsort((three, two, one))
    one, two, three, count, open_ = (x[order] for x in (one, two, three, count, open_))
    words = [None, *numbers]
    at, total = _totals([one, two], count)
    for i, n in zip(at[(total >= least) | (open_[at] > 0)].tolist(), total[(total >= least) | (open_[at] > 0)].tolist()):
        yield words[one[i]], words[two[i]], None, n
    at, total = _totals([one, two, three], count)
    kept = (total >= least) & (three[at] != _END)
    for i, n in zip(at[kept].tolist(), total[kept].tolist()):
        yield words[one[i]], words[two[i]], words[three[i]], n


def _built(least: int):
    def run(table: pa.Table) -> pa.Table:
        by_lang, rows = {}, []
        for lang, words, found in zip(*(table.column(c).to_pylist() for c in ("lang", "words", "suffixes"))):
            by_lang.setdefault(lang, []).append((zstandard.ZstdDecompressor().decompress(words).split(b" "), _unpacked(found, 5)))
        for lang, parts in by_lang.items():
            rows += [(lang, *row) for row in subtree_counts(parts, least)]
        kinds = [pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        columns = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
        return pa.table([c.cast(pa.string()) if t == pa.binary() else c for c, t in zip(columns, kinds)], names=["lang", "w1", "w2", "w3", "f"])
    return run


def phrase_counts(docs: DataFrame, least: int = 10, budget: int = 1 << 20, block_words: int = 1 << 19, text: str = "text", lang: str = "lang"):
    """(``lang, word, n`` of all words, ``lang, w1, w2, w3, f`` of the phrases of two words, with a null w3, and three, found ``least`` times or more).

    ``budget``: suffixes of a group; ``block_words``: words that a task holds at once. Null languages count as ``und``, null texts have no words.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    counted = stored(_counted(texts, block_words), "phrase-words")
    words = counted.filter("word IS NOT NULL").select("lang", "word", "n")
    totals = np.zeros((2, BUCKETS), np.int64)  # at most two rows for a bucket
    for row in counted.groupBy("bucket", F.col("word").isNull().alias("pair")).agg(F.sum("n").alias("n")).collect():
        totals[int(row["pair"]), row["bucket"]] = row["n"]
    # Not fewer groups than tasks at a time.
    groups = Groups.of(totals[0], totals[1], max(1, min(budget, -(-int(totals[0].sum()) // partitions(spark)))))
    dealt = _dealt(texts, groups, block_words).repartition(partitions(spark), "grp", "part")
    found = dealt.groupBy("grp", "part").applyInArrow(_built(least), "lang string, w1 string, w2 string, w3 string, f long")
    nodes = stored(found, "phrase-counts")
    # Only pairs of a bucket that was cut have several rows, and their threes never: all three words chose the part.
    whole = nodes.groupBy("lang", "w1", "w2", "w3").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return words, stored(whole, "phrases")


def _score(a: str, l: str, r: str) -> Column:
    """floor(1000000 * a * a / (l * r)), exact."""
    big = [f"CAST({x} AS DECIMAL(19, 0))" for x in (a, l, r)]
    return F.expr(f"CAST((CAST(1000000 AS DECIMAL(7, 0)) * CAST({big[0]} * {big[0]} AS DECIMAL(31, 0))) div CAST({big[1]} * {big[2]} AS DECIMAL(38, 0)) AS BIGINT)")


def collocations(docs: DataFrame, top: int = 2000, least: int = 10, inside_percent: int = 50, budget: int = 1 << 20, block_words: int = 1 << 19,
                 text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of two or three words of each language.

    A-Z are lower-cased; pieces end at . , ; : ! ? and line ends, words at spaces and tabs. ``a`` is the count of the phrase, ``n`` that of all words of
    the language, ``l`` and ``r`` those of the phrase's parts at the cut with the lowest ``score`` (a million times a * a / (l * r), rounded down; the first such cut).
    A pair inside a phrase of three words (that is counted ``least`` times or more) with ``inside_percent`` percent of its count or more is left out. Order: score and a
    falling, then the phrase in byte order, so there are no ties. Counts are over all rows, repeated ones too; null languages are ``und``, null
    texts have no words. ``doc_id`` and other columns aren't read.
    """
    words, phrases = phrase_counts(docs, least, budget, block_words, text, lang)
    often = stored(words.filter(F.col("n") >= least), "frequent-words")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    two, three = phrases.filter("w3 IS NULL").drop("w3"), phrases.filter("w3 IS NOT NULL")

    def counts(word, name):
        return often.select("lang", F.col("word").alias(word), F.col("n").alias(name))

    def pairs(first, second, name):
        return two.select("lang", F.col("w1").alias(first), F.col("w2").alias(second), F.col("f").alias(name))

    longer = (three.select("lang", "f", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
              .groupBy("lang", "p.w1", "p.w2").agg(F.max("f").alias("longest")))
    of_two = (two.join(longer, ["lang", "w1", "w2"], "left").filter(f"longest IS NULL OR 100 * longest < {inside_percent} * f")
              .join(counts("w1", "l"), ["lang", "w1"]).join(counts("w2", "r"), ["lang", "w2"])
              .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), "l", "r", _score("f", "l", "r").alias("score")))
    of_three = (three.join(counts("w1", "l1"), ["lang", "w1"]).join(counts("w3", "r2"), ["lang", "w3"])
                .join(pairs("w2", "w3", "r1"), ["lang", "w2", "w3"]).join(pairs("w1", "w2", "l2"), ["lang", "w1", "w2"])
                .withColumn("s1", _score("f", "l1", "r1")).withColumn("s2", _score("f", "l2", "r2")))
    first = F.col("s1") <= F.col("s2")
    of_three = of_three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                               F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = of_two.unionByName(of_three).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
