"""Secret scan: all rules in one automaton, one pass over the bytes of a text.

The automaton reads a text backwards. In each state it knows every rule that has a match starting at the
byte just read, so one pass gives all possible starts of all rules. From the leftmost start that
is not inside an earlier match of its rule, an automaton of that rule alone gives the longest match.
"""

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .automata import Dfa, parse
from .common import byte_texts, tidied, with_texts


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the dialect of ``automata``; ``fold``: letters in either case. A match counts if what
    follows its longest ``head`` (nothing: the match itself) has ``least`` bytes or more; one that is too short still takes its text."""

    kind: str
    pattern: str
    least: int = 0
    head: str = ""
    fold: bool = False


_KEYWORD = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: The kinds every report has, in their order.
BASE = (
    Rule("assign", _KEYWORD + "[A-Za-z0-9+/_.=-]+", 6, _KEYWORD, fold=True),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    # A run that is too short holds no match that is long enough, so the bound can stand in the pattern.
    Rule("hex", "[0-9a-f]{24,}"),
)
#: Published formats of well-known tokens and keys.
MORE = (
    Rule("private_key", r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("github", r"(gh[pousr]|github_pat)_[A-Za-z0-9_]+", 40),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]+", 15),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9+/_.~-]+=*", 20, r"bearer\x20+", fold=True),
    Rule("url_login", r"(https?|ftp|ssh|postgres(ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._%+-]+:[^\s/@:]+@[A-Za-z0-9.-]+"),
)
# Lengths stand beside the patterns: counting them inside would multiply the states of the joint automaton.

# White space and line ends, also as escapes of a string; lines may begin with marks of a quotation or a comment.
_SPACE, _END = r"(\s|\\[nrt]|[>|#*])", r"[\x20\x09]*(\x0A|\x0D|\\n|\\r)"
_FIELDS = rf"({_END}{_SPACE}*[A-Za-z][A-Za-z0-9-]*:[^\x0A\x0D\\]*)*"
#: What belongs to a private key after its BEGIN line: headers and base64 up to the END line or, if there is none, up to the end of the
#: base64 lines (runs of 20 or more, and a last one that is padded or fills its line).
_KEY_BODY = (rf"{_FIELDS}({_SPACE}|[A-Za-z0-9+/=])*-----END ([A-Z0-9]+ )*PRIVATE KEY-----"
             rf"|{_FIELDS}({_SPACE}+[A-Za-z0-9+/=]{{20,}})*({_SPACE}+[A-Za-z0-9+/]+=+|{_END}{_SPACE}*[A-Za-z0-9+/=]+{_END})?")


class Scanner:
    def __init__(self, rules=BASE + MORE):
        self.rules = tuple(rules)
        trees = [parse(r.pattern, r.fold) for r in self.rules]
        self.starts = Dfa(trees, backwards=True, floating=True)
        self.each = [Dfa([t]) for t in trees]
        self.heads = [Dfa([parse(r.head, r.fold)]) if r.head else None for r in self.rules]

    def _starts(self, data: bytes) -> list:
        """(byte, rules that have a match from there on), from the last to the first."""
        auto, out, at = self.starts, [], len(data)
        state, moves, least, rules = auto.start, auto.moves, auto.first_accepting, auto.rules
        for byte in reversed(data):
            at -= 1
            state = moves[state | byte]
            if state >= least:
                out.append((at, rules[state]))
        return out

    def spans(self, data: bytes) -> list:
        """``(start, rule number, end)`` in bytes, leftmost and without overlap per rule, in order of start, then rule."""
        out, free = [], [0] * len(self.rules)
        for at, rules in reversed(self._starts(data)):
            for r in rules:
                if at < free[r]:
                    continue
                free[r] = end = self.each[r].longest(data, at)
                value = at if self.heads[r] is None else self.heads[r].longest(data, at)
                if end - value >= self.rules[r].least:
                    out.append((at, r, end))
        return out


@lru_cache(maxsize=4)
def scanner(rules=BASE + MORE) -> Scanner:
    """The compiled rules, once per driver; tasks get the arrays as a broadcast, whose size only the rules decide."""
    return Scanner(rules)


def _in_code_points(data: bytes, spans: list) -> list:
    if not spans or data.isascii():
        return spans
    ends = sorted({x for s, _, e in spans for x in (s, e)})
    chars, at, known = 0, 0, {}
    for x in ends:
        chars += len(data[at:x].decode("utf-8", "replace"))
        at = x
        known[x] = chars
    return [(known[s], r, known[e]) for s, r, e in spans]


def find_secrets(docs: DataFrame, rules=BASE + MORE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, spans array<struct<kind, start, end>>`` in code points, end exclusive.

    Null and empty texts have no spans, repeated rows give repeated rows. Matches of one kind never overlap; those of different kinds may.
    """
    rules = tuple(rules)
    compiled = docs.sparkSession.sparkContext.broadcast(scanner(rules))

    def run(batches):
        scan = compiled.value
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            out = []
            for data in byte_texts(batch.column(1)):
                data = data or b""
                out.append([{"kind": rules[r].kind, "start": s, "end": e} for s, r, e in _in_code_points(data, scan.spans(data))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(item))], names=["doc_id", "spans"])

    wanted = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {wanted.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return wanted.mapInArrow(tidied(run), schema)


@lru_cache(maxsize=1)
def _key_body() -> Dfa:
    return Dfa([parse(_KEY_BODY)])


def redact_secrets(docs: DataFrame, rules=BASE + MORE, text: str = "text", n_chars: str = "n_chars", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask``; overlapping spans become one mask.

    The span of a private key goes on from its BEGIN line over headers and body to the END line. Columns and their order stay.
    ``n_chars``, where it is a column of whole numbers, becomes the new length of changed texts. Repeated rows stay repeated.
    """
    compiled, mark = docs.sparkSession.sparkContext.broadcast((scanner(tuple(rules)), _key_body())), mask.encode()

    def run(batches):
        scan, body = compiled.value
        for batch in batches:
            values, changed = byte_texts(batch.column(text)), {}
            for i, data in enumerate(values):
                spans = scan.spans(data) if data else []
                if spans:
                    out, at = [], 0
                    for start, r, end in spans:
                        if scan.rules[r].kind == "private_key":
                            # The added line end closes a last line that the text ends with.
                            end = min(len(data), body.longest(data + b"\n", end))
                        if start >= at:
                            out += [data[at:start], mark]
                        at = max(at, end)
                    values[i] = changed[i] = b"".join([*out, data[at:]])
            yield with_texts(batch, text, n_chars, values, changed)

    return docs.mapInArrow(tidied(run), docs.schema)
