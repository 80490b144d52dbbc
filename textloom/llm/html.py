"""Main text of web pages by composite text density.

For every node of the page's tree: C characters, T tags, LC characters in links and LT link tags below it.
Its composite text density (Sun, Song and Liao, 2011) is characters per tag, adjusted for links:

    C / T * log[ln(C / nLC * LC + LCb / Cb * C + e)] (C / LC * T / LT)

with nLC = C - LC, b the body, and 1 for any count of zero. A node's density sum adds its children's
densities. The node with the greatest density sum is found; the least density on its path to the body is
the threshold; then, from the body down, every node whose density reaches the threshold gives the subtree
of greatest density sum within it, if that sum reaches the threshold too.

Pages are parsed in one pass over their tags; the text between tags is never looked at character by
character. Unclosed paragraphs, list items, rows and cells end where the next begins; unmatched end tags
are skipped; scripts, styles and comments aren't text.

Defined results: a null page gives null text, an empty one or one without text an empty text; a page
without a body is its own body; ties of the density sum go to the first node in document order; rows
repeat as they are given; a null id or url is kept; a very long or deeply nested page is parsed whole, in memory in
proportion to itself; an empty table gives an empty result. Columns other than id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "page_id long, url string, content string, chars int, density double, threshold double, nodes int"
_TAG = re.compile(r"<!--(?:.*?-->|.*$)|<(/?)([a-zA-Z][^\s/>]*)(?:(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[!?][^>]*>", re.S)
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe svg".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul br html".split())
_ENDS_P = _BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


def parse(page: str) -> tuple[list[str], list[int], list[list]]:
    """Names and parents of all nodes in document order, and each node's content: texts and child nodes."""
    names, parents, content = ["#root"], [-1], [[]]
    stack, at, end = [0], 0, len(page)

    def text(piece: str) -> None:
        piece = _SPACE.sub(" ", entities.unescape(piece) if "&" in piece else piece)
        if piece and (piece != " " or content[stack[-1]]):
            content[stack[-1]].append(piece)

    while at < end:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if names[stack[i]] == name:
                    del stack[i:]
                    break
            continue
        if name in _RAW:
            if not page.endswith("/>", m.start(), m.end()):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        ends, within = _ENDS.get(name, (None, None))
        if name in _ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if names[stack[i]] == "p":
                    del stack[i:]
                    break
                if names[stack[i]] in _BLOCK:
                    break
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if names[stack[i]] in within:
                    break
                if names[stack[i]] in ends:
                    del stack[i:]
                    if name != "tr":
                        break
        if name in ("html", "body") and name in names:
            continue  # a second one only adds attributes
        node = len(names)
        names.append(name)
        parents.append(stack[-1])
        content.append([])
        content[stack[-1]].append(node)
        if name not in _VOID and not page.endswith("/>", m.start(), m.end()):
            stack.append(node)
        elif name not in _VOID:
            continue
    return names, parents, content


def densities(names: list[str], parents: list[int], content: list[list], body: int) -> tuple[list[float], list[float]]:
    """Composite text density and density sum of every node."""
    n = len(names)
    c, t, lc, lt = [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):  # children come after their parents
        own = sum(len(x) for x in content[i] if isinstance(x, str))
        c[i] += own
        if names[i] == "a":
            lc[i] = c[i]  # all characters below a link are link characters
        p = parents[i]
        if p >= 0:
            c[p] += c[i]
            lc[p] += lc[i]
            t[p] += t[i] + 1
            lt[p] += lt[i] + (names[i] == "a")
    ratio = lc[body] / (c[body] or 1)
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if c[i]:
            ti, li, lti, plain = t[i] or 1, lc[i] or 1, lt[i] or 1, c[i] - lc[i] or 1
            base = math.log(math.log(c[i] / plain * lc[i] + ratio * c[i] + math.e)) if lc[i] or ratio else 0.0
            # A base of 1 (no link anywhere) has no logarithm: plain density.
            density[i] = c[i] / ti * (math.log(c[i] / li * ti / lti) / base if base > 1e-9 else 1.0)
        if parents[i] >= 0:
            sums[parents[i]] += density[i]
    return density, sums


def extract(page: str) -> tuple[str, float, float, int]:
    """(main text, density of its node, threshold, nodes)."""
    names, parents, content = parse(page)
    body = names.index("body") if "body" in names else 0
    density, sums = densities(names, parents, content, body)
    n = len(names)
    last = list(range(n))  # the last node of each subtree: nodes are in document order
    for i in range(n - 1, 0, -1):
        last[parents[i]] = max(last[parents[i]], last[i])

    best_in = list(range(n))  # the first node of greatest density sum in each subtree
    for i in range(n - 1, 0, -1):
        p, b = parents[i], best_in[i]
        if sums[b] > sums[best_in[p]] or (sums[b] == sums[best_in[p]] and b < best_in[p]):
            best_in[p] = b
    top = best_in[body]
    threshold, i = density[top], top
    while i != body and i >= 0:
        i = parents[i]
        threshold = min(threshold, density[i])
    chosen, todo = [], [body]
    while todo:
        i = todo.pop()
        if density[i] < threshold - 1e-9 or not density[i]:
            continue
        best = best_in[i]
        if best != top and sums[best] < threshold:
            continue  # its children add up to less than one node of the body path
        if not chosen or not any(x <= best <= last[x] for x in chosen):
            chosen.append(best)
        todo += [x for x in reversed(content[i]) if not isinstance(x, str) and not any(y <= x <= last[y] for y in chosen)]
    chosen = [x for x in sorted(chosen) if not any(y != x and y <= x <= last[y] for y in chosen)]
    out: list[str] = []

    stack = [iter([x]) for x in reversed(chosen)]
    closing: list[str] = ["" for _ in chosen]
    while stack:  # by hand, for pages may nest deeper than Python may
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
            if closing.pop():
                out.append("\n")
        elif isinstance(x, str):
            out.append(x)
        else:
            block = names[x] in _BLOCK
            if block:
                out.append("\n")
            stack.append(iter(content[x]))
            closing.append("\n" if block else "")
    lines = (_SPACE.sub(" ", x).strip() for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x), density[top], threshold, n - 1


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row a page: OUT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [extract(x) if x is not None else (None, None, None, None) for x in part.column("html").to_pylist()]
                text, density, threshold, nodes = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([None if x is None else len(x) for x in text], pa.int32()), pa.array(density, pa.float64()), pa.array(threshold, pa.float64()), pa.array(nodes, pa.int32())],
                    ["page_id", "url", "content", "chars", "density", "threshold", "nodes"],
                )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, OUT)
