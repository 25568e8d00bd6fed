"""Conversation repair against a search over all edits."""

import hashlib
import random

import pytest

from vendorlens.llm import repair
from vendorlens.llm.repair import ASSISTANT, BLANK, DUPLICATE, FINE, START, SYSTEM, TRUNCATED, USER

WHITE = " \t\n\x0b\x0c\r"
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WORD = {"u": "user", "a": "assistant"}


def kinds(rows):
    out = []
    for i, (_, role, text) in enumerate(rows):
        rest = text.rstrip(WHITE)
        out.append("blank" if not rest else "duplicate" if (role, text) in [r[1:] for r in rows[:i]] else "fine" if rest[-1] in ".!?" else "truncated")
    return out


def plain(rows):
    """The best of all paths, kept as (cost, edits, turns) for every state after every row."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    found = kinds(rows)

    def inserted(best):
        for _ in range(4):
            for state, (cost, edits, turns) in list(best.items()):
                for letter in "ua":
                    if (state, letter) in MOVES:
                        better(best, MOVES[state, letter], (cost + 5, edits + "I", turns + [f"{WORD[letter]}:"]))
        return best

    def better(best, state, path):
        if state not in best or path[:2] < best[state][:2]:
            best[state] = path

    best = inserted({START: (0, "", [])})
    for (_, role, text), kind in zip(rows, found):
        after = {}
        for state, (cost, edits, turns) in best.items():
            better(after, state, (cost + 2, edits + "D", turns))
            if kind in ("fine", "truncated"):
                more = 5 if kind == "truncated" else 0
                if (state, role[:1]) in MOVES:
                    better(after, MOVES[state, role[:1]], (cost + more, edits + "K", turns + [f"{role}:{text}"]))
                for letter in "ua":
                    if (state, letter) in MOVES:
                        better(after, MOVES[state, letter], (cost + 1 + more, edits + "R", turns + [f"{WORD[letter]}:{text}"]))
        best = inserted(after)
    cost, audit, turns = min((best[s] for s in (START, ASSISTANT) if s in best), key=lambda p: p[:2])
    turn = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turn) - min(turn) + 1 - len(turn) if turn else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest(), "\n".join(turns))


SAID = ["Yes.", "No!", "and then", " \t\n", "", "Why? ", "x", "done.\n", "ß…"]
ROLES = ["user", "assistant", "system", "tool", "", "user", "assistant", None]


def conversations(n, longest, seed=3):
    pick = random.Random(seed)
    out = {}
    for k in range(n):
        out[k] = [(pick.choice([None, *range(-3, 9)]) if pick.random() < 0.3 else t, pick.choice(ROLES), pick.choice([*SAID, f"text {t}.", None])) for t in range(pick.randint(1, longest))]
    return out


def test_walk_and_costs_as_all_edits():
    for rows in conversations(400, 9).values():
        rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        got = repair.repair_whole(rows, True)
        assert tuple(got.values()) == plain(rows), rows


def run(spark, convs, n=6, **options):
    rows = [(k, t, r, x, 0) for k, c in convs.items() for t, r, x in c]
    random.Random(1).shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int").repartition(n)
    return {r.conv_id: tuple(r)[1:] for r in repair.repair(turns, outputs=("sha256", "repaired"), **options).collect()}


def test_conversations_across_ranges(spark):
    """Few rows a range, conversations of one row to 300, one with most rows; null ids, turns, roles and texts."""
    convs = conversations(40, 12) | {100: conversations(1, 300, 5)[0] * 2, None: conversations(1, 20, 6)[0], 101: [(None, "user", "Same.")] * 300}
    assert run(spark, convs) == {k: plain(c) for k, c in convs.items()}


def test_conversations_too_long_for_a_task(spark):
    convs = conversations(12, 60, 9)
    assert run(spark, convs, most_rows=5) == {k: plain(c) for k, c in convs.items()}
    assert run(spark, convs, most_bytes=30) == {k: plain(c) for k, c in convs.items()}


def test_empty_table_and_outputs(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(none).collect() == []
    one = spark.createDataFrame([("c", 1, "user", "Hello.")], "conv_id string, turn int, role string, text string")
    row = repair.repair(one).first()
    assert row.asDict() == {"conv_id": "c", "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 2, "audit": "D", "repaired": ""}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 10, 1000])
def test_checkpoints_of_any_length(n):
    """A walk over n rows costs what the vectors say, from every state."""
    pick = random.Random(n)
    codes = bytes(repair.code(pick.choice(["user", "assistant", "system", "x"]), pick.choice([FINE, FINE, TRUNCATED, BLANK, DUPLICATE])) for _ in range(n))
    costs = repair.END
    for row in reversed(codes):
        costs = repair.before(row, costs)
    for state in range(4):
        edits, after = repair.walk(codes, state, repair.END)
        spent, rows, at = 5 * (edits + repair.closing(after)).count("I"), iter(codes), state
        for letter in edits:
            if letter == "I":
                at = repair.NEXT[at]
            else:
                cost, at = next((c, to) for name, c, to in repair._EDITS[next(rows)][at] if name == letter)
                spent += cost
        assert (spent, at) == (costs[state], after)
