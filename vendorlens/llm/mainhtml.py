"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree.

A block is a run of text inside one innermost block element. Its features are the tags, classes, ids and roles of all
elements around it, and the shape of its text. The chain of blocks gets the labels article or not; neighbours are
tied by a transition weight that depends on whether they share a container. Decoded by Viterbi.
"""

import html
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import byte_texts, tidied
from .layouts import labelled_pages

#: Elements that hold raw text, up to their end tag or the end of the page; none of it is text of the page.
_RAW = "script|style|textarea|title|iframe|noscript"
#: Elements whose inside is not shown as text.
_SILENT = frozenset("template svg canvas audio video select button annotation annotation-xml".split())
#: Elements that "/>" closes.
_FOREIGN = frozenset(("svg", "math"))
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<({_RAW})(?=[\s/>])[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"""|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>|</?[A-Za-z][^>]*+\Z""", re.S | re.I)
#: One attribute: name, then its whole value, so that nothing inside a value is taken for a name.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_READ = frozenset("class id role itemprop hidden aria-hidden style data-main".split())
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
#: What an opening tag closes, as far as the element that holds it.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"})}


class _Element:
    """What is known of an element by its path; elements of equal paths share it. ``features`` are those of the whole path."""

    __slots__ = ("tag", "block", "features", "main", "hidden", "silent", "link", "children")

    def __init__(self, tag, attributes, parent):
        names, self.hidden, self.main = set(), parent.hidden if parent else False, parent.main if parent else None
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key not in _READ:
                    continue
                if key == "data-main":
                    self.main = value == "1"
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    self.hidden = True
                elif key != "style" and key != "aria-hidden":
                    names |= {f"{'role' if key == 'role' else 'name'}:{p.lower().rstrip('s')}" for p in _NAME_PART.findall(value)}
        self.tag, self.block = tag, tag in _BLOCK
        self.silent = tag in _SILENT or parent is not None and parent.silent
        self.link = tag == "a" or parent is not None and parent.link
        above = parent.features if parent else frozenset()
        mine = {f"in:{tag}", *names}
        self.features = above if mine <= above else above | mine
        self.children = {}

    def child(self, tag, attributes):
        """The element below this path; paths that repeat are built once."""
        key = (tag, attributes)
        found = self.children.get(key)
        if found is None:
            found = self.children[key] = _Element(tag, attributes, self)
        return found


def _unclosed(tokens: list) -> set:
    """Which tokens open a silent element that no end tag closes."""
    open_ = {}
    for i, m in enumerate(tokens):
        tag = m[3] and m[3].lower()
        if tag in _SILENT:
            if not m[2]:
                open_.setdefault(tag, []).append(i)
            elif open_.get(tag):
                open_[tag].pop()
    return {i for found in open_.values() for i in found}


def blocks(page: str) -> list:
    """``(element, container, text, linked, numbers)`` for each block with text, in page order; ``linked`` is the share of text inside links,
    ``numbers`` tell the block's element and its container from all others of the page."""
    out, tokens = [], list(_TOKEN.finditer(page))
    loose = _unclosed(tokens)
    # Open elements, with their number; the third is set for a silent one that nothing closes.
    stack, run, linked, at, number, ends_soon = [(_Element("html", "", None), 0, False)], [], 0, 0, 0, False

    def flush():
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                here = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0].block or i == 0)
                above = max(0, here - 1)
                total = sum(map(len, run))
                out.append((stack[here][0], stack[above][0], text, min(1.0, linked / max(1, total)), (stack[here][1], stack[above][1])))
            run.clear()
        linked = 0

    def text(part):
        nonlocal linked
        inner = stack[-1][0]
        if part and not inner.silent:
            run.append(part)
            if inner.link:
                linked += len(part)

    def close(tags, holders):
        """Closes the innermost element of ``tags`` unless one of ``holders`` stands inside."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0].tag in tags:
                del stack[i:]
                return
            if stack[i][0].tag in holders:
                return

    for i, m in enumerate(tokens):
        text(page[at:m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "br":
                run.append(" ")
            elif tag in _BLOCK:
                flush()
                if any(e[0].tag == tag for e in stack[1:]):
                    while stack.pop()[0].tag != tag:
                        pass
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0].tag == tag:
                        if any(e[0].block for e in stack[k:]):
                            flush()
                        del stack[k:]
                        break
                    if stack[k][0].block and tag not in _SILENT:
                        break
            continue
        if tag in ("br", "hr", "img", "input", "wbr"):
            if tag == "hr":
                flush()
            elif tag != "wbr":
                run.append(" ")
            continue
        if tag in _VOID or tag == "html" or tag in _FOREIGN and m[4].endswith("/"):
            continue
        if tag in _BLOCK:
            flush()
            if ends_soon:
                # What nothing closes ends where the next block begins, if its parent doesn't end before.
                lost = next((k for k, e in enumerate(stack) if e[2]), len(stack))
                del stack[lost:]
                ends_soon = False
            close({"p"}, _BLOCK - {"p"})
            if tag in _CLOSES:
                close(*_CLOSES[tag])
            if tag != "head":
                close({"head"}, ())
        number += 1
        ends_soon = ends_soon or i in loose
        stack.append((stack[-1][0].child(tag, m[4]), number, i in loose))
    text(page[at:])
    flush()
    return out


_COPYRIGHT = re.compile(r"©|\(c\) ?\d|copyright|all rights reserved", re.I)
_LENGTHS = (1, 2, 4, 7, 12, 20, 40, 80)


def _text_features(text: str, linked: float) -> tuple:
    words = text.count(" ") + 1
    return (f"words:{sum(words > n for n in _LENGTHS)}", f"linked:{0 if linked == 0 else 1 + int(linked * 3.99)}",
            f"end:{text[-1] if text[-1] in '.!?:,;|' else 'w' if text[-1].isalpha() else 'o'}", f"commas:{min(3, text.count(','))}",
            f"copyright:{_COPYRIGHT.search(text) is not None}", f"bars:{min(2, text.count('|'))}")


def features(found: list, i: int) -> list:
    """All features of block i: of its path, its text, and its place at the ends of the page."""
    element, container, text, linked, _ = found[i]
    own = [*element.features, f"tag:{element.tag}", f"below:{container.tag}", *_text_features(text, linked), "any"]
    if element.hidden:
        own.append("hidden")
    if i == 0:
        own.append("first")
    if i == len(found) - 1:
        own.append("last")
    return own


def _joined(found: list) -> list:
    """For each block but the first: 1 if it has the container of the one before, or its element."""
    return [int(a[4][0] == b[4][0] or a[4][1] == b[4][1]) for a, b in zip(found, found[1:])]


class Field:
    """Weights of the features for the label article (0 for the other), and transitions by (shared container, from, to)."""

    def __init__(self):
        self.weight, self.transition, self._paths = {}, np.zeros((2, 2, 2)), {}

    def emissions(self, found: list) -> list:
        out, weight = [], self.weight.get
        if len(self._paths) > 50_000:
            self._paths.clear()
        for element, container, text, linked, _ in found:
            key = (element.features, element.tag, container.tag, element.hidden)
            path = self._paths.get(key)
            if path is None:
                path = sum(weight(f, 0.0) for f in (*element.features, f"tag:{element.tag}", f"below:{container.tag}", "any", *(["hidden"] * element.hidden)))
                self._paths[key] = path
            out.append(path + sum(weight(f, 0.0) for f in _text_features(text, linked)))
        if out:
            out[0] += weight("first", 0.0)
            out[-1] += weight("last", 0.0)
        return out

    def viterbi(self, found: list) -> list:
        """The most likely labels of a chain of blocks; on a tie, not the article."""
        if not found:
            return []
        scores, ways, moves = self.emissions(found), [], self.transition.tolist()
        off, on = 0.0, scores[0]
        for score, joined in zip(scores[1:], _joined(found)):
            t = moves[joined]
            from_off, from_on = off + t[0][0], on + t[1][0]
            to_off, to_on = off + t[0][1], on + t[1][1]
            ways.append((from_on > from_off, to_on > to_off))
            off, on = max(from_off, from_on), max(to_off, to_on) + score
        labels = [on > off]
        for way in reversed(ways):
            labels.append(way[labels[-1]])
        return labels[::-1]

    def extract(self, page: str) -> str:
        found = blocks(page)
        return "\n".join(b[2] for b, main in zip(found, self.viterbi(found)) if main and not b[0].hidden)


def _log_add(a, b):
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def fit(pages: list, rounds: int = 8, rate: float = 0.4, decay: float = 2e-5) -> Field:
    """Maximum likelihood on labelled pages by adaptive gradient steps, one page at a time, with a small weight decay."""
    field, chains = Field(), []
    for page in pages:
        found = blocks(page)
        if found:
            chains.append(([features(found, i) for i in range(len(found))], _joined(found), [int(bool(b[0].main)) for b in found]))
    squares, moved = {}, np.full((2, 2, 2), 1e-8)
    for _ in range(rounds):
        for rows, joined, labels in chains:
            s = [sum(field.weight.get(f, 0.0) for f in row) for row in rows]
            n, t = len(s), field.transition.tolist()
            ahead, back = [(0.0, s[0])], [(0.0, 0.0)] * n
            for i in range(1, n):
                (a, b), w = ahead[-1], t[joined[i - 1]]
                ahead.append((_log_add(a + w[0][0], b + w[1][0]), _log_add(a + w[0][1], b + w[1][1]) + s[i]))
            for i in range(n - 2, -1, -1):
                (a, b), w = back[i + 1], t[joined[i]]
                b += s[i + 1]
                back[i] = (_log_add(w[0][0] + a, w[0][1] + b), _log_add(w[1][0] + a, w[1][1] + b))
            total = _log_add(*ahead[-1])
            for i, row in enumerate(rows):
                slope = labels[i] - math.exp(ahead[i][1] + back[i][1] - total)
                if abs(slope) > 1e-4:
                    for f in row:
                        squares[f] = squares.get(f, 1e-8) + slope * slope
                        old = field.weight.get(f, 0.0)
                        field.weight[f] = old + rate * (slope - decay * old) / math.sqrt(squares[f])
            slope = np.zeros((2, 2, 2))
            for i in range(1, n):
                k = joined[i - 1]
                slope[k, labels[i - 1], labels[i]] += 1
                for x in (0, 1):
                    for y in (0, 1):
                        slope[k, x, y] -= math.exp(ahead[i - 1][x] + t[k][x][y] + s[i] * y + back[i][y] - total)
            moved += slope * slope
            field.transition += rate * slope / np.sqrt(moved)
    return field


@lru_cache(maxsize=2)
def trained(pages: int = 2500, rounds: int = 8, seed: int = 7) -> Field:
    """The model for ``pages`` labelled pages (the bound on what it is fitted on)."""
    return fit(labelled_pages(pages, seed), rounds)


def extract_text(pages: DataFrame, field: Field | None = None, html_column: str = "html") -> DataFrame:
    """``pages`` with ``text`` (the main text) and ``n_chars`` (its code points) in place of columns of these names.

    White space inside a block becomes one space; blocks are joined by one newline. Null and empty pages, and pages without an
    article, give an empty text. Broken markup is read as browsers do: what is never closed ends with its parent, and a
    button, select, svg, canvas, audio, video or template that is never closed ends at the next block too. Repeated rows give repeated rows.
    """
    model = field or trained()
    model._paths.clear()
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars", html_column.lower())]

    def run(batches):
        for batch in batches:
            texts = [shared.value.extract(data.decode()) if data else "" for data in byte_texts(batch.column(len(kept)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=[*kept, "text", "n_chars"])

    schema = StructType([*(pages.schema[c] for c in kept), StructField("text", StringType()), StructField("n_chars", LongType())])
    return pages.select(*kept, F.col(html_column)).mapInArrow(tidied(run), schema)
