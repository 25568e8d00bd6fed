"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of all items' words is built once and read by every task. A document's words are streamed
through it; after each word the state and length tell the longest run of words, ending there, that occurs
in some item. Where that run holds a whole window of an item, its words are hit.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from .common import byte_texts, stored, tidied, with_texts

#: Lower-cases A-Z, keeps digits, a-z and bytes from 0x80 on, and makes everything else a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(data: bytes | None) -> list:
    """The words of a UTF-8 text, in lower case."""
    return (data or b"").translate(_WORD_BYTES).split()


class SuffixAutomaton:
    """All word runs of all items. ``items``: (id, words); a window is ``window`` words, or a whole shorter item.

    ``items_at[s]``: items with a window that ends a run of state s; ``shorter[s]``: (length, items)
    of whole items shorter than a window that end it.
    """

    def __init__(self, items, window: int = 10):
        self.window, self.ids, self.vocabulary = window, [], {}
        self.next, self.link, self.length = [{}], [-1], [0]
        prefixes, whole = [], {}
        for item_id, words in items:
            if not words:
                continue
            number, last = len(self.ids), 0
            self.ids.append(item_id)
            ends = []
            for w in words:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                ends.append(last)
            prefixes.append(ends)
            if len(words) < window:
                whole.setdefault(last, []).append(number)
        self._windows(prefixes)
        self._short(whole)

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._clone(last, c, known)
        new = self._state(self.length[last] + 1, {})
        while last != -1 and c not in self.next[last]:
            self.next[last][c] = new
            last = self.link[last]
        if last == -1:
            self.link[new] = 0
        else:
            q = self.next[last][c]
            self.link[new] = q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        return new

    def _clone(self, last: int, c: int, q: int) -> int:
        clone = self._state(self.length[last] + 1, dict(self.next[q]))
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while last != -1 and self.next[last].get(c) == q:
            self.next[last][c] = clone
            last = self.link[last]
        return clone

    def _state(self, length: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def _windows(self, prefixes):
        """Each window belongs to the one state whose runs include the last ``window`` words of a prefix."""
        home, self.items_at = {}, {}
        for number, ends in enumerate(prefixes):
            for end in ends[self.window - 1:]:
                home.setdefault(self._home(end), set()).add(number)
        self.home = {}
        for s in range(len(self.next)):
            if self.length[s] >= self.window:
                self.home[s] = self._home(s)
        self.items_at = {s: frozenset(home.get(h, ())) for s, h in self.home.items()}

    def _home(self, s: int) -> int:
        while self.length[self.link[s]] >= self.window:
            s = self.link[s]
        return s

    def _short(self, whole):
        """Whole short items of a state and of all its suffix states."""
        self.shorter = {}
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            mine = self.shorter.get(self.link[s], ()) if s else ()
            if s in whole:
                mine = (*mine, (self.length[s], frozenset(whole[s])))
            if mine:
                self.shorter[s] = mine

    def match(self, words: list):
        """(spans of hit words as sorted disjoint (first, end), numbers of the items with occurring windows)."""
        window, moves, link, length = self.window, self.next, self.link, self.length
        shorter, items_at = self.shorter, self.items_at
        spans, items, state, run = [], set(), 0, 0
        for at, c in enumerate(map(self.vocabulary.get, words)):
            if c is None:
                state = run = 0
                continue
            nxt = moves[state].get(c)
            while nxt is None and state:
                state = link[state]
                run = length[state]
                nxt = moves[state].get(c)
            if nxt is None:
                continue
            state = nxt
            run += 1
            if run >= window:
                _cover(spans, at + 1 - window, at + 1)
                items |= items_at[state]
            if state in shorter:
                for size, numbers in shorter[state]:
                    if size <= run:
                        _cover(spans, at + 1 - size, at + 1)
                        items |= numbers
        return spans, items


def _cover(spans: list, first: int, end: int):
    """Adds a span that ends at or after all others; those it touches become one."""
    while spans and spans[-1][1] >= first:
        a, b = spans.pop()
        first, end = min(a, first), max(b, end)
    spans.append((first, end))


def automata(benchmark: DataFrame, window: int = 10, max_bytes: int = 3 << 20, item_id: str = "item_id", text: str = "text"):
    """Yields the automata of a benchmark table, built on the driver one after another, each to be broadcast to the tasks.

    Test items are a curated list that doesn't grow with the corpus, so there are few as a rule. A table of more than ``max_bytes``
    of text is cut by hash into parts of about that size: an automaton needs about 125 bytes for each byte of text, 390 MB for a full part, on the driver and in a task.
    Items without an id are items like others; their id is None.
    """
    items = benchmark.filter(F.col(text).isNotNull()).select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // max_bytes))
    for k in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).collect()
        found = ((r["id"], tuple(words_of(r["text"].encode()))) for r in rows)
        yield SuffixAutomaton(sorted(found, key=lambda x: (x[0] is not None, x[0] or "", x[1])), window)


def _match(auto, data: bytes | None, marks) -> tuple:
    """Number of words, spans and item ids of a text, joined to those of automata before."""
    found = words_of(data)
    spans, numbers = auto.match(found)
    items = {auto.ids[n] for n in numbers}
    if marks is not None:
        joined = []
        for a, b in sorted([*spans, *((m["a"], m["b"]) for m in marks["spans"])]):
            if joined and a <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
            else:
                joined.append((a, b))
        spans, items = joined, items | set(marks["items"])
    return len(found), spans, items


_MARKS = "struct<spans:array<struct<a:bigint,b:bigint>>,items:array<string>>"


def _through(docs: DataFrame, benchmark: DataFrame, text: str, window: int, max_bytes: int, last, schema):
    """``docs`` through all automata: ``last(batch, results)`` makes the rows of the last pass from the spans and items of each text.

    With several automata, each has a pass of its own, so no task holds two; what the earlier ones found is stored beside the rows.
    """
    marks = "_marks"
    while marks.lower() in map(str.lower, docs.columns):
        marks += "_"
    arrow = pa.struct([("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def passing(shared, final):
        def run(batches):
            for batch in batches:
                values = byte_texts(batch.column(text))
                before = batch.column(marks).to_pylist() if marks in batch.schema.names else [None] * len(values)
                results = [_match(shared.value, x, m) for x, m in zip(values, before)]
                rest = batch.select([n for n in batch.schema.names if n != marks])
                if final:
                    yield last(rest, values, results)
                else:
                    now = pa.array([{"spans": [{"a": a, "b": b} for a, b in s], "items": list(i)} for _, s, i in results], arrow)
                    yield pa.RecordBatch.from_arrays([*rest.columns, now], names=[*rest.schema.names, marks])
        return run

    broadcast, held = docs.sparkSession.sparkContext.broadcast, None
    marked = StructType([*docs.schema.fields, StructField(marks, StructType.fromDDL(f"m {_MARKS}").fields[0].dataType)])
    for auto in automata(benchmark, window, max_bytes):
        if held is not None:
            docs = stored(docs.mapInArrow(tidied(passing(broadcast(held), False)), marked), "decontaminate")
        held = auto
    return docs.mapInArrow(tidied(passing(broadcast(held), True)), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text",
                  max_bytes: int = 3 << 20) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items array<string>``.

    A word is hit if an occurrence of a window covers it; ``items`` are the distinct ids, sorted as strings, of
    the items with occurring windows. Items without an id hit words like others; they are not in ``items`` and count as one of ``n_items``. Null texts and items have no words; an empty
    benchmark hits nothing. Repeated rows give repeated rows; items that repeat an id are one item.
    """
    def rows(batch, values, results):
        items = [sorted(x for x in i if x is not None) for _, _, i in results]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([n for n, _, _ in results], pa.int64()),
             pa.array([sum(b - a for a, b in s) for _, s, _ in results], pa.int64()),
             pa.array([len(i) for _, _, i in results], pa.int64()), pa.array(items, pa.list_(pa.string()))],
            names=["doc_id", "n_words", "n_hit", "n_items", "items"])

    wanted = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {wanted.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items array<string>"
    return _through(wanted, benchmark, "text", window, max_bytes, rows, schema)


def _word_places(data: bytes) -> np.ndarray:
    """(first byte, end) of every word."""
    mapped = np.frombuffer(data.translate(_WORD_BYTES), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mapped.view(np.int8), [0]])))
    return edge.reshape(-1, 2)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5,
                         text: str = "text", n_chars: str = "n_chars", max_bytes: int = 3 << 20) -> DataFrame:
    """``docs`` without what it shares with the benchmark; columns and their order stay.

    Hit spans (runs of words covered by windows) are cut out of a text from their first to their last word.
    A document of whose words more than the share ``max_coverage`` is hit goes whole. ``n_chars``, where
    it is a column of whole numbers, becomes the new length of changed texts. Documents without a hit stay as they are, null and empty ones too.
    """
    def cleaned(batch, values, results):
        keep, changed = [], {}
        for i, (data, (n_words, spans, _)) in enumerate(zip(values, results)):
            keep.append(not spans or sum(b - a for a, b in spans) <= max_coverage * n_words)
            if spans and keep[-1]:
                places, out, at = _word_places(data), [], 0
                for a, b in spans:
                    out.append(data[at:places[a, 0]])
                    at = places[b - 1, 1]
                values[i] = changed[i] = b"".join([*out, data[at:]])
        return with_texts(batch, text, n_chars, values, changed).filter(pa.array(keep, pa.bool_()))

    return _through(docs, benchmark, text, window, max_bytes, cleaned, docs.schema)
