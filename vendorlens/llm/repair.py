"""Conversation repair: cheapest edits that give a legal order of roles, by a dynamic program with square-root checkpoints.

A legal conversation is empty, or an optional system turn and then user and assistant in turns. Reading it needs four states; for each the cost of the
cheapest edits of the rest is a number, so a conversation is a chain of steps on vectors of four costs, from the last row to the first. The costs are
stored only before every k-th of n rows, k about the root of n; walking forward, one block of costs at a time is worked out
again, and of the edits that keep the cost least (the tight ones) the first in ASCII order is taken.

Rows are dealt into ranges of (conversation, turn), so a task reads whole conversations one after another. One that lies within a range
is repaired there. One that touches the end of a range, or is too long to hold, is a chain of runs, a run per range: each run becomes a four by four
table of costs, the tables are chained backwards, each run walks from all four states, and the walks are chained forwards. Texts are read again
only for the repaired text, as a stream.
"""

import hashlib
from math import isqrt

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import byte_texts, partitions, stored, tidied

WHITE = b" \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5  # costs; the last for each truncated row that stays
START, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, or the role of the turn before
NEXT = (USER, USER, ASSISTANT, USER)  # the state after the turn that a state waits for
NAMES = {USER: "user", ASSISTANT: "assistant"}
_KEPT = {(START, SYSTEM): SYSTEM, (START, USER): USER, (SYSTEM, USER): USER, (USER, ASSISTANT): ASSISTANT, (ASSISTANT, USER): USER}
_ROLES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL_PAIRS = {"su", "ua", "au"}
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)  # the first fault of a row
_NEVER = 1 << 50


def fault(text: bytes) -> int:
    """The fault a text has by itself."""
    rest = text.rstrip(WHITE)
    return BLANK if not rest else FINE if rest[-1:] in (b".", b"!", b"?") else TRUNCATED


def code(role: str, kind: int) -> int:
    """A row as one small number: its fault, and the role its first letter stands for (0: none)."""
    return kind * 4 + _ROLES.get(role[:1], 0)


def _inserted(costs):
    """Costs before a place, where turns may also be inserted."""
    return tuple(min(costs[q], INSERT + costs[NEXT[q]], 2 * INSERT + costs[NEXT[NEXT[q]]]) for q in range(4))


END = _inserted((0, _NEVER, _NEVER, 0))


def _options(row: int, state: int):
    """(letter, cost, state after) of the edits of a row, in the order of their letters."""
    kind, role = divmod(row, 4)
    yield "D", DELETE, state
    if kind in (FINE, TRUNCATED):
        stays = CUT_OFF if kind == TRUNCATED else 0
        if (state, role) in _KEPT:
            yield "K", KEEP + stays, _KEPT[state, role]
        yield "R", REROLE + stays, NEXT[state]


_EDITS = [[tuple(_options(row, q)) for q in range(4)] for row in range(16)]


def before(row: int, after):
    """Least costs in the four states before a row, from those after it."""
    return _inserted([min(cost + after[to] for _, cost, to in options) for options in _EDITS[row]])


def walk(codes: bytes, state: int, end):
    """(edits, state after the last row): the ASCII-least of the cheapest edits of the rows, given the costs after them."""
    n, block = len(codes), isqrt(len(codes)) or 1
    checkpoints, costs = {}, end
    for i in range(n - 1, -1, -1):
        costs = before(codes[i], costs)
        if i % block == 0:
            checkpoints[i] = costs
    edits = []
    for low in range(0, n, block):
        high = min(n, low + block)
        again = [checkpoints.get(high, end)]
        for i in range(high - 1, low - 1, -1):
            again.append(before(codes[i], again[-1]))
        again.reverse()
        for i in range(low, high):
            now, after = again[i - low], again[i - low + 1]
            while True:
                tight = [(letter, to) for letter, cost, to in _EDITS[codes[i]][state] if cost + after[to] == now[state]]
                if INSERT + now[NEXT[state]] == now[state] and (not tight or tight[0][0] > "I"):
                    edits.append("I")
                    state = NEXT[state]
                    continue
                letter, state = tight[0]
                edits.append(letter)
                break
    return "".join(edits), state


def closing(state: int) -> str:
    """The inserts after the last row."""
    return "I" * (END[state] // INSERT)


def turns_after(edits: str, rows, state: int):
    """The repaired (role, text) that edits make of an iterator of rows, and the state behind each."""
    for letter in edits:
        role, text = (None, "") if letter == "I" else next(rows)
        if letter != "D":
            state = _KEPT[state, _ROLES[role[0]]] if letter == "K" else NEXT[state]
            yield (role if letter == "K" else NAMES[state]), text, state


def illegal_pairs(roles) -> int:
    return sum(a[:1] + b[:1] not in LEGAL_PAIRS for a, b in zip(roles, roles[1:]))


def gaps(turns: set) -> int:
    """Turns missing between the first and the last one; None is no turn."""
    known = [t for t in turns if t is not None]
    return max(known) - min(known) + 1 - len(known) if known else 0


class _Digest:
    """``role:text`` of repaired turns, joined by line ends: their SHA-256, and the text itself if wanted."""

    def __init__(self, text: bool):
        self.hash, self.first, self.parts = hashlib.sha256(), True, [] if text else None

    def add(self, role: str, text: str):
        data = ("" if self.first else "\n") + f"{role}:{text}"
        self.first = False
        self.hash.update(data.encode())
        if self.parts is not None:
            self.parts.append(data)

    def values(self):
        return self.hash.hexdigest(), None if self.parts is None else "".join(self.parts)


_DONE = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha256 string, repaired string"
_OPEN = "key string, range long, place long, turn long, role string, text string, row int, print_a long, print_b long"
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
_BOTH = f"{_DONE}, {_OPEN.split(', ', 1)[1]}"
_BOTH_ARROW = pa.schema([(n, _ARROW[t]) for n, t in (f.split() for f in _BOTH.split(", "))])


def repair_whole(rows: list, text: bool) -> dict:
    """The result of a conversation from all its rows (turn, role, text) in order."""
    seen, kinds = set(), []
    for _, role, value in rows:
        kind = fault(value.encode())
        if kind != BLANK:
            print_ = (role, xxhash.xxh3_128_digest(value))
            kind = DUPLICATE if print_ in seen else kind
            seen.add(print_)
        kinds.append(kind)
    codes = bytes(code(role, kind) for (_, role, _), kind in zip(rows, kinds))
    edits, state = walk(codes, START, END)
    audit, digest, costs = edits + closing(state), _Digest(text), END
    for i in range(len(codes) - 1, -1, -1):
        costs = before(codes[i], costs)
    for role, value, _ in turns_after(audit, ((r, t) for _, r, t in rows), START):
        digest.add(role, value)
    sha256, repaired = digest.values()
    return {"gaps": gaps({t for t, _, _ in rows}), "blank": kinds.count(BLANK), "duplicate": kinds.count(DUPLICATE), "truncated": kinds.count(TRUNCATED),
            "illegal": illegal_pairs([r for _, r, _ in rows]), "cost": costs[START], "audit": audit, "sha256": sha256, "repaired": repaired}


def _ranges(ordered: DataFrame, text: bool, most_rows: int, most_bytes: int) -> DataFrame:
    """One pass over sorted ranges: results of the conversations inside, and the rows of the others."""
    def run(batches):
        number, place, out = TaskContext.get().partitionId(), 0, []
        key, rows, size, whole = None, [], 0, False  # the first conversation of a range may have begun before it

        def opened():
            nonlocal place
            for turn, role, value in rows:
                data = value.encode()
                a, b = (x - (1 << 64) if x >> 63 else x for x in divmod(xxhash.xxh3_128_intdigest(data), 1 << 64))
                out.append({"key": key, "range": number, "place": place, "turn": turn, "role": role, "text": value, "row": code(role, fault(data)), "print_a": a, "print_b": b})
                place += 1
            rows.clear()

        for batch in batches:
            for name, turn, role, value in zip(*(c.to_pylist() for c in batch.columns)):
                if name != key:
                    if whole:
                        out.append({"key": key, **repair_whole(rows, text)})
                        rows.clear()
                    opened()
                    whole, key, size = key is not None, name, 0
                rows.append((turn, role, value))
                size += len(value)
                if whole and (len(rows) > most_rows or size > most_bytes):
                    whole = False
                if not whole and len(rows) >= 1000:
                    opened()
            if out:
                yield pa.RecordBatch.from_pylist(out, _BOTH_ARROW)
                out.clear()
        opened()  # the last one may go on in the next range
        if out:
            yield pa.RecordBatch.from_pylist(out, _BOTH_ARROW)

    return ordered.mapInArrow(tidied(run), _BOTH)


def _chained(table, after):
    """Costs before a run from those after it."""
    return tuple(min(table[q * 4 + e] + after[e] for e in range(4)) for q in range(4))


def _run(table: pa.Table) -> pa.Table:
    """The rows of a run as one row: their codes, and the costs between its states before and after."""
    table = table.sort_by("place")
    codes, roles = bytes(table.column("row").to_pylist()), table.column("role").to_pylist()
    columns = []
    for e in range(4):
        costs = tuple(0 if q == e else _NEVER for q in range(4))
        for row in reversed(codes):
            costs = tuple(min(c, _NEVER) for c in before(row, costs))
        columns.append(costs)
    return pa.table({**{c: table.column(c)[:1].combine_chunks() for c in ("key", "range")}, "codes": pa.array([codes], pa.binary()),
                     "costs": pa.array([[columns[e][q] for q in range(4) for e in range(4)]], pa.list_(pa.int64())),
                     "first": [roles[0][:1]], "last": [roles[-1][:1]], "illegal": pa.array([illegal_pairs(roles)], pa.int64())})


def _backwards(table: pa.Table) -> pa.Table:
    """A row per run of a conversation: the costs after it, and what the whole conversation has."""
    runs = table.sort_by("range").to_pylist()
    after, ends = END, []
    for run in reversed(runs):
        ends.append(list(after))
        after = _chained(run["costs"], after)
    illegal = sum(r["illegal"] for r in runs) + sum(a["last"] + b["first"] not in LEGAL_PAIRS for a, b in zip(runs, runs[1:]))
    n = len(runs)
    return pa.table({"key": [r["key"] for r in runs], "range": pa.array([r["range"] for r in runs], pa.int64()), "after": pa.array(ends[::-1], pa.list_(pa.int64())),
                     "illegal": pa.array([illegal] * n, pa.int64()), "cost": pa.array([after[START]] * n, pa.int64())})


def _walks(batches):
    """The edits of each run from each of the four states, and where they lead."""
    for batch in batches:
        rows = []
        for key, number, codes, after in zip(*(batch.column(c).to_pylist() for c in ("key", "range", "codes", "after"))):
            walks = [walk(codes, q, after) for q in range(4)]
            rows.append({"key": key, "range": number, "edits": [w for w, _ in walks], "to": [q for _, q in walks]})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.string()), ("range", pa.int64()), ("edits", pa.list_(pa.string())), ("to", pa.list_(pa.int32()))]))


def _forwards(table: pa.Table) -> pa.Table:
    """A row per run of a conversation: its state before, and the inserts after the last run."""
    state, rows = START, table.sort_by("range").to_pylist()
    for row in rows:
        row["state"], state = state, row.pop("to")[state]
        row["inserts"] = ""
    rows[-1]["inserts"] = closing(state)
    return pa.Table.from_pylist(rows, pa.schema([("key", pa.string()), ("range", pa.int64()), ("state", pa.int32()), ("inserts", pa.string())]))


def _texts(text: bool):
    """Rows sorted by conversation, range and place, before each run's rows one with its edits, to the digest of each conversation."""
    schema = pa.schema([("key", pa.string()), ("sha256", pa.string()), ("repaired", pa.string())])

    def run(batches):
        key, digest, state, edits, at = None, None, START, "", 0

        def inserts():
            nonlocal state, at
            while at < len(edits) and edits[at] == "I":
                state, at = NEXT[state], at + 1
                digest.add(NAMES[state], "")

        for batch in batches:
            out = []
            for name, place, role, value, piece in zip(*(batch.column(c).to_pylist() for c in ("key", "place", "role", "text", "edits"))):
                if name != key:
                    if key is not None:
                        out.append((key, *digest.values()))
                    key, digest, state = name, _Digest(text), START
                if place < 0:
                    edits, at = piece, 0
                else:
                    for new, kept, state in turns_after(edits[at], iter([(role, value)]), state):
                        digest.add(new, kept)
                    at += 1
                inserts()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.string()) for c in (key, *digest.values())], schema=schema)

    return run


def _repair_open(rows: DataFrame, text: bool) -> DataFrame:
    """The results of conversations that several ranges hold, or that are too long for a task."""
    n = partitions(rows.sparkSession)
    at, same = F.struct("range", "place"), ["key", "role", "print_a", "print_b"]
    words = rows.filter(f"row < {4 * BLANK} OR row >= {4 * DUPLICATE}")
    firsts = words.groupBy(*same).agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first < last").select(*same, "first")
    light = rows.select("key", "range", "place", "turn", "role", "row", "print_a", "print_b").join(firsts, same, "left")
    again = F.col("first").isNotNull() & (at > F.col("first")) & ~F.col("row").between(4 * BLANK, 4 * BLANK + 3)
    light = stored(light.select("key", "range", "place", "turn", "role", F.when(again, 4 * DUPLICATE + F.col("row") % 4).otherwise(F.col("row")).alias("row")), "repair-rows")
    kind = F.floor(F.col("row") / 4)
    facts = light.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        *[F.count_if(kind == k).alias(c) for k, c in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))])
    # A run is at most one range of rows without their texts, and a conversation has at most one run for each range.
    runs = stored(light.drop("turn").repartition(n, "key", "range").groupBy("key", "range")
                  .applyInArrow(_run, "key string, range long, codes binary, costs array<long>, first string, last string, illegal long"), "repair-runs")
    ends = stored(runs.drop("codes").groupBy("key").applyInArrow(_backwards, "key string, range long, after array<long>, illegal long, cost long"), "repair-ends")
    walks = stored(runs.select("key", "range", "codes").join(ends, ["key", "range"]).select("key", "range", "codes", "after")
                   .mapInArrow(_walks, "key string, range long, edits array<string>, to array<int>"), "repair-walks")
    states = walks.drop("edits").groupBy("key").applyInArrow(_forwards, "key string, range long, state int, inserts string")
    pieces = stored(walks.join(states, ["key", "range"])
                    .select("key", "range", F.concat(F.element_at("edits", F.col("state") + 1), "inserts").alias("edits")), "repair-edits")
    audits = pieces.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "edits"))), lambda p: p["edits"]), "").alias("audit"))
    stream = (rows.select("key", "range", "place", "role", "text", F.lit(None).cast("string").alias("edits"))
              .unionByName(pieces.select("key", "range", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("role"),
                                         F.lit(None).cast("string").alias("text"), "edits")))
    digests = (stream.repartition(n, "key").sortWithinPartitions("key", "range", "place")
               .mapInArrow(tidied(_texts(text)), "key string, sha256 string, repaired string"))
    whole = ends.groupBy("key").agg(F.first("illegal").alias("illegal"), F.first("cost").alias("cost"))
    names = [f.split()[0] for f in _DONE.split(", ")]
    return facts.join(whole, "key").join(audits, "key").join(digests, "key").select(*names)


def repair(turns: DataFrame, outputs=("repaired",), most_rows: int = 4096, most_bytes: int = 4 << 20,
           conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` and the chosen outputs.

    ``outputs``: ``repaired`` (``role:text`` of the repaired turns, joined by line ends) and ``sha256`` (of that text). Rows are taken by turn, null turns first;
    rows of one turn by role, then text. Null roles and texts are one space; a null conv_id is a conversation of its own. A row's first fault counts: blank
    (white space only), duplicate (its role and text stood before; repeated rows are duplicates), truncated (the last other character is not . ! or ?).
    ``gaps``: turns missing between the first and the last. ``illegal``: neighbours whose roles' first letters are not su, ua or au.
    ``audit``: the ASCII-least of the cheapest edits: K keeps a row (0), R gives it the role that is due (1), D deletes it (2, and always for
    blank and duplicate rows), I inserts an empty turn of the role that is due (5); a truncated row that stays costs 5 more. A row whose role begins with another letter can't be kept.
    Conversations of up to ``most_rows`` rows and ``most_bytes`` characters are repaired in one task, others in runs.
    """
    spark = turns.sparkSession
    named = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                         *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    keyed = named.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    n = partitions(spark)
    order = ["key", F.col("turn").asc_nulls_first(), "role", "text"]
    # Long texts stay out of the bounds of the ranges, so rows of one turn and role that begin alike come into one range.
    ordered = (keyed.repartitionByRange(n, *order[:3], F.substring("text", 1, 64)).sortWithinPartitions(*order).select("key", "turn", "role", "text"))
    found = stored(_ranges(ordered, "repaired" in outputs, most_rows, most_bytes), "repair-ranges")
    done, open_ = [f.split()[0] for f in _DONE.split(", ")], [f.split()[0] for f in _OPEN.split(", ")]
    results = found.filter("audit IS NOT NULL").select(*done).unionByName(_repair_open(found.filter("audit IS NULL").select(*open_), "repaired" in outputs))
    kept = [c for c in done if c not in ("sha256", "repaired") or c in outputs]
    return keyed.select("conv_id", "key").distinct().join(results.select(*kept), "key").drop("key")
