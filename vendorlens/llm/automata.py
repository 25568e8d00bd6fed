"""Regular expressions of a small dialect to one minimal byte automaton.

The dialect: literals, escapes (``\\d \\w \\s \\xHH`` and escaped punctuation), classes, groups, ``|``, and the
repeats ``? * + {n} {n,} {n,m}``. All rules are compiled together: syntax tree, byte NFA, subset
construction, minimisation, and a flat transition array. Read forwards and anchored, a state says which
rules match the bytes read so far; read backwards over a text, it says which rules have a match that starts here.
"""

from array import array

_CLASSES = {"d": range(48, 58), "w": [*range(48, 58), *range(65, 91), 95, *range(97, 123)], "s": [9, 10, 11, 12, 13, 32]}


class _Parser:
    """Recursive descent to trees: ("set", bytes), ("cat", [..]), ("alt", [..]), ("rep", tree, low, high)."""

    def __init__(self, pattern: str, fold: bool):
        self.text, self.at, self.fold = pattern, 0, fold

    def tree(self):
        out = self.alternatives()
        if self.at < len(self.text):
            raise ValueError(f"unmatched ')' in {self.text!r}")
        return out

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def peek(self):
        return self.text[self.at:self.at + 1]

    def take(self):
        self.at += 1
        return self.text[self.at - 1]

    def atom(self):
        c = self.take()
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            inner = self.alternatives()
            if self.peek() != ")":
                raise ValueError(f"missing ')' in {self.text!r}")
            self.at += 1
            return inner
        if c == "[":
            return self.bracket()
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        if c == "\\":
            return ("set", self.folded(self.escape()))
        if c in "*+?{}":
            raise ValueError(f"nothing to repeat in {self.text!r}")
        return ("cat", [("set", self.folded({b})) for b in c.encode()])

    def escape(self):
        c = self.take()
        if c in _CLASSES:
            return set(_CLASSES[c])
        if c == "x":
            self.at += 2
            return {int(self.text[self.at - 2:self.at], 16)}
        if c.isalnum():
            raise ValueError(f"unknown escape \\{c}")
        return {ord(c)}

    def bracket(self):
        negated, found, first = self.peek() == "^", set(), True
        self.at += negated
        while first or self.peek() != "]":
            first = False
            c = self.take()
            low = self.escape() if c == "\\" else {ord(c)}
            if self.peek() == "-" and self.text[self.at + 1] != "]" and len(low) == 1:
                self.at += 1
                c = self.take()
                high = self.escape() if c == "\\" else {ord(c)}
                low = set(range(min(low), min(high) + 1))
            found |= low
        self.at += 1
        if max(found) > 255:
            raise ValueError("classes hold single bytes only")
        found = self.folded(found)
        return ("set", frozenset(range(256)) - found if negated else found)

    def folded(self, values):
        if self.fold:
            values = {x for v in values for x in ((v, v ^ 32) if chr(v & ~32) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else (v,))}
        return frozenset(values)

    def repeated(self, tree):
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                low, _, high = self.text[self.at:self.text.index("}", self.at)].partition(",")
                exact = "," not in self.text[self.at:self.text.index("}", self.at)]
                self.at = self.text.index("}", self.at) + 1
                bounds = int(low), int(low) if exact else int(high) if high else None
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            tree = ("rep", tree, *bounds)
        return tree


class _Nfa:
    def __init__(self):
        self.jumps, self.steps, self.accepts = [], [], {}  # empty moves; (byte set, next) or None; rule by state

    def state(self):
        self.jumps.append([])
        self.steps.append(None)
        return len(self.jumps) - 1

    def add(self, tree, start, backwards):
        """Builds ``tree`` from ``start`` on; the state it ends in."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            here = self.state()
            self.jumps[start].append(here)
            self.steps[here] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1][::-1] if backwards else tree[1]:
                start = self.add(part, start, backwards)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                fork = self.state()
                self.jumps[start].append(fork)
                self.jumps[self.add(part, fork, backwards)].append(end)
            return end
        _, inner, low, high = tree
        for _ in range(low):
            start = self.add(inner, start, backwards)
        if high is None:
            loop, end = self.state(), self.state()
            self.jumps[start].append(loop)
            self.jumps[self.add(inner, loop, backwards)].append(loop)
            self.jumps[loop].append(end)
            return end
        end = self.state()
        for _ in range(high - low):
            self.jumps[start].append(end)
            start = self.add(inner, start, backwards)
        self.jumps[start].append(end)
        return end

    def closure(self, states):
        seen, open_ = set(states), list(states)
        while open_:
            for x in self.jumps[open_.pop()]:
                if x not in seen:
                    seen.add(x)
                    open_.append(x)
        return frozenset(x for x in seen if self.steps[x] or x in self.accepts)


class Dfa:
    """``moves[state | byte]`` is the next state; states are multiples of 256, ``start`` is the first, and
    ``rules.get(state)`` are the rules that accept in it. ``dead``: the state that no byte leaves, or -1.

    States from ``first_accepting`` on are exactly the accepting ones, so a scan needs one comparison.
    """

    def __init__(self, trees, backwards=False, floating=False):
        nfa = _Nfa()
        root = nfa.state()
        for rule, tree in enumerate(trees):
            start = nfa.state()
            nfa.jumps[root].append(start)
            nfa.accepts[nfa.add(tree, start, backwards)] = rule
        table, accepts = self._subsets(nfa, root, floating)
        self._number(*self._minimal(table, accepts))

    @staticmethod
    def _subsets(nfa, root, floating):
        """Subset construction over classes of bytes that no rule tells apart."""
        sets = {s[0] for s in nfa.steps if s}
        signature = {}
        for b in range(256):
            signature.setdefault(tuple(b in s for s in sets), []).append(b)
        groups = list(signature.values())
        first = nfa.closure([root])
        numbers, table, accepts, at = {first: 0}, [], [], 0
        order = [first]
        while at < len(order):
            states = order[at]
            at += 1
            accepts.append(frozenset(nfa.accepts[x] for x in states if x in nfa.accepts))
            row = [0] * 256
            for group in groups:
                reached = {nfa.steps[x][1] for x in states if nfa.steps[x] and group[0] in nfa.steps[x][0]}
                nxt = nfa.closure(reached | {root} if floating else reached)
                if nxt not in numbers:
                    numbers[nxt] = len(order)
                    order.append(nxt)
                for b in group:
                    row[b] = numbers[nxt]
            table.append(row)
        return table, accepts

    @staticmethod
    def _minimal(table, accepts):
        """Splits blocks of states until all states of a block go to the same blocks."""
        kinds = {}
        block = [kinds.setdefault(a, len(kinds)) for a in accepts]
        while True:
            kinds = {}
            new = [kinds.setdefault((block[s], *[block[x] for x in row]), len(kinds)) for s, row in enumerate(table)]
            if len(kinds) == len(set(block)):
                break
            block = new
        firsts = {}
        for s, b in enumerate(block):
            firsts.setdefault(b, s)
        return ({b: [block[x] for x in table[s]] for b, s in firsts.items()}, {b: accepts[s] for b, s in firsts.items()}, block[0])

    def _number(self, rows, accepts, start):
        order = sorted(rows, key=lambda b: (bool(accepts[b]), b))
        number = {b: i * 256 for i, b in enumerate(order)}
        self.moves = array("l", [number[x] for b in order for x in rows[b]]).tolist()
        self.start = number[start]
        self.rules = {number[b]: tuple(sorted(accepts[b])) for b in order if accepts[b]}
        self.first_accepting = min(self.rules, default=len(order) * 256)
        self.dead = next((number[b] for b in order if not accepts[b] and all(x == b for x in rows[b])), -1)
        self.size = len(order)

    def longest(self, data: bytes, at: int) -> int:
        """The end of the longest match that starts at ``at``; -1 if none."""
        state, end, moves, least, dead = self.start, -1, self.moves, self.first_accepting, self.dead
        if state >= least:
            end = at
        for i in range(at, len(data)):
            state = moves[state | data[i]]
            if state >= least:
                end = i + 1
            elif state == dead:
                break
        return end


def parse(pattern: str, fold: bool = False):
    return _Parser(pattern, fold).tree()
