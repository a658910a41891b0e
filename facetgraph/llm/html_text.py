"""Operator 4: main text of pages by a tree-structured graphical model.

Block elements of a page are nodes, each main text or not. A node's features (tag, words
of class and id, length, links) and a potential on each parent-child edge score a
labelling; sum-product messages go up and down the tree and give each node's marginal.
Weights come from labelled pages by gradient ascent on the conditional likelihood. Text
of nodes with a marginal of a half or more is kept, in page order.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetgraph.llm.common import table

#: A quote opens a value only behind an equals sign. Nothing is given back on the way, so that a match takes linear time.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
#: The same without quotes, for pages in which a tag never ends.
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Content of these is never text of the page.
DROPPED = frozenset("script style noscript template head title textarea select button svg iframe option datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("#page html body nav header footer aside article main section div form menu".split())
#: A start tag of the first closes an open element of the second, within the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


@dataclass
class Node:
    parent: int
    tag: str
    names: list[str]
    label: int | None = None
    chars: int = 0  # of its own text
    linked: int = 0
    marks: int = 0
    features: list[str] = field(default_factory=list)

    @property
    def kind(self) -> int:
        """1 if the element is a plain one without names, which follows its parent more closely than a section does."""
        return int(not self.names and self.tag not in SECTIONS)


def tags(page: str) -> Iterator[tuple[str, bool, str, str, int]]:
    """(text before, is an end tag, name, attributes, place behind) of each tag; the last one has no name. Sent a place, goes on there.

    Comments and declarations have no name either. A page is read once: only the first
    tag that never ends is looked for up to the page's end.
    """
    pattern, at, start = TAG, 0, 0
    while True:
        begin = page.find("<", at)
        if begin < 0:
            break
        sign = page[begin + 1 : begin + 2]
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            end = len(page) if end < 0 else end + 3
            found = (False, "", "")
        elif sign in ("!", "?"):
            end = page.find(">", begin)
            if end < 0:
                break
            end, found = end + 1, (False, "", "")
        elif sign == "/" or sign.isalpha():
            match = pattern.match(page, begin)
            if match is None and (sign.isascii() and sign.isalpha() or page[begin + 2 : begin + 3].isalpha()):
                pattern = LOOSE_TAG
                match = pattern.match(page, begin)
                if match is None and page.find(">", begin) < 0:
                    break
            if match is None:
                at = begin + 1
                continue
            end, found = match.end(), (bool(match[1]), match[2].lower(), match[3])
        else:
            at = begin + 1
            continue
        moved = yield (page[start:begin], *found, end)
        start = at = end if moved is None else moved
        if moved is not None:
            yield ("", False, "", "", at)  # answers the send
    yield (page[start:], False, "", "", len(page))


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block elements, parents first, and the runs of text (node, text) in page order; in time linear in the page."""
    nodes, runs = [Node(-1, "#page", [])], []
    stack, words, links = [0], [], 0
    # where the open elements of each tag stand in the stack, and those that are neither paragraph nor heading
    open_at: dict[str, list[int]] = {}
    others: list[int] = [0]
    low, unclosed = None, set()

    def last(names) -> int:
        return max((open_at[n][-1] for n in names if open_at.get(n)), default=-1)

    def flush() -> None:
        nonlocal words
        text = " ".join("".join(words).split())
        words = []
        if text:
            runs.append((stack[-1], text))
            nodes[stack[-1]].chars += len(text)
            nodes[stack[-1]].marks += sum(text.count(c) for c in ".,;:!?")

    def pop_to(depth: int) -> None:
        flush()
        while len(stack) > depth:
            tag = nodes[stack.pop()].tag
            open_at[tag].pop()
            if others[-1] == len(stack):
                others.pop()

    reader = tags(page)
    for text, ends, tag, attributes, at in reader:
        if text:
            if "&" in text:
                text = entities.unescape(text)
            words.append(text)
            if links:
                nodes[stack[-1]].linked += len(text.strip())
        if not tag:
            continue
        if ends:
            if tag in BLOCKS:
                depth = last((tag,))
                if depth > 0:
                    pop_to(depth)
                else:
                    flush()
                links = 0
            elif tag == "a":
                links = 0
            continue
        if tag in DROPPED:
            low = low if low is not None else page.lower()
            if len(low) != len(page):  # lower case of some letters is longer
                low = page
            end = -1 if tag in unclosed or attributes.endswith("/") else low.find(f"</{tag}", at)
            if end >= 0:
                close = page.find(">", end)
                reader.send(len(page) if close < 0 else close + 1)
            elif not attributes.endswith("/"):
                unclosed.add(tag)
            words.append(" ")
            continue
        if tag == "br":
            words.append(" ")
        elif tag == "a":
            links = 1
        elif tag in BLOCKS:
            flush()
            links = 0
            depth = last(("p",))
            if depth > others[-1]:
                pop_to(depth)
            if tag in CLOSES:
                own, within = CLOSES[tag]
                depth = last(own)
                if depth > max(0, last(within)):
                    pop_to(depth)
            names, label = [], None
            for name, value in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id", "role", "itemprop", "aria-label"):
                    names += [w.lower() for w in NAME_WORD.findall(value)]
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                    names.append("#hidden")
                elif name == "data-main":
                    label = int(value)
            if tag != "hr":
                nodes.append(Node(stack[-1], tag, names, label))
                open_at.setdefault(tag, []).append(len(stack))
                if tag != "p" and tag not in HEADINGS:
                    others.append(len(stack))
                stack.append(len(nodes) - 1)
    flush()
    below, linked = [n.chars for n in nodes], [n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        below[nodes[i].parent] += below[i]
        linked[nodes[i].parent] += linked[i]
    for node, inside, within in zip(nodes, below, linked, strict=True):
        size = min(4, int(math.log(node.chars + 1, 4)))
        dense = 0 if not node.chars else 1 + min(2, int(3 * node.linked / (node.chars + 1)))
        node.features = [f"tag {node.tag}", *[f"name {w}" for w in dict.fromkeys(node.names)], f"size {size}", f"links {dense}", f"marks {min(3, node.marks)}", f"inside {min(5, int(math.log(inside + 1, 4)))}", f"share {int(3.99 * inside / (below[0] + 1))}", f"within {min(2, int(3 * within / (inside + 1)))}"]
    return nodes, runs


@dataclass
class TreeModel:
    weights: dict[str, float]
    edges: list[list[list[float]]]  # edges[kind of child][parent's label][child's label]


def marginals(nodes: list[Node], model: TreeModel) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """P(main) of each node, and for each node but the first P(parent, node) as (00, 01, 10, 11), by sum-product."""
    moves = [[math.exp(x) for row in kind for x in row] for kind in model.edges]
    edge = [moves[n.kind] for n in nodes]
    get = model.weights.get
    emit = [math.exp(max(-20.0, min(20.0, sum(get(f, 0.0) for f in n.features)))) for n in nodes]
    up = [[1.0, e] for e in emit]
    sent = [(1.0, 1.0)] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        x, y = up[i]
        s = x + y
        x, y = x / s, y / s
        a, b, c, d = edge[i]
        m = (a * x + b * y, c * x + d * y)
        sent[i] = m
        above = up[nodes[i].parent]
        above[0] *= m[0]
        above[1] *= m[1]
        s = above[0] + above[1]
        above[0], above[1] = above[0] / s, above[1] / s
    down = [(1.0, 1.0)] * len(nodes)
    belief, pairs = [0.0] * len(nodes), []
    for i, node in enumerate(nodes):
        if i:
            p = node.parent
            a, b, c, d = edge[i]
            # what the parent says without this child's own message
            x, y = down[p][0] * up[p][0] / sent[i][0], down[p][1] * up[p][1] / sent[i][1]
            s = x + y
            x, y = x / s, y / s
            down[i] = (x * a + y * c, x * b + y * d)
            joint = (x * a * up[i][0], x * b * up[i][1], y * c * up[i][0], y * d * up[i][1])
            s = sum(joint)
            pairs.append(tuple(j / s for j in joint))
        x, y = down[i][0] * up[i][0], down[i][1] * up[i][1]
        belief[i] = y / (x + y)
    return belief, pairs


def train(pages: list[str], steps: int = 120, rate: float = 0.5, decay: float = 0.02) -> TreeModel:
    """Fits to pages whose elements carry data-main="1" or "0", which holds for what is inside up to the next mark."""
    trees = []
    for page in pages:
        nodes, _ = parse(page)
        labels = []
        for n in nodes:
            labels.append(n.label if n.label is not None else labels[n.parent] if n.parent >= 0 else 0)
        trees.append((nodes, labels))
    model = TreeModel({}, [[[0.0, 0.0], [0.0, 0.0]] for _ in range(2)])
    squares: dict = {}

    def move(key, value: float, gradient: float) -> float:
        squares[key] = squares.get(key, 1e-6) + gradient * gradient
        return value + rate * gradient / math.sqrt(squares[key])

    for _ in range(steps):
        slope: dict[str, float] = {}
        edges = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(2)]
        for nodes, labels in trees:
            belief, pairs = marginals(nodes, model)
            for n, want, got in zip(nodes, labels, belief, strict=True):
                for f in n.features:
                    slope[f] = slope.get(f, 0.0) + want - got
            for n, want, (p00, p01, p10, p11) in zip(nodes[1:], labels[1:], pairs, strict=True):
                edge = edges[n.kind]
                edge[labels[n.parent]][want] += 1
                edge[0][0] -= p00
                edge[0][1] -= p01
                edge[1][0] -= p10
                edge[1][1] -= p11
        for f, g in slope.items():
            w = model.weights.get(f, 0.0)
            model.weights[f] = move(f, w, g - decay * w)
        model.edges = [[[move((k, i, j), e[i][j], edges[k][i][j] - decay * e[i][j]) for j in (0, 1)] for i in (0, 1)] for k, e in enumerate(model.edges)]
    return model


def main_text(page: str | None, model: TreeModel) -> str:
    nodes, runs = parse(page or "")
    if not runs:
        return ""
    belief, _ = marginals(nodes, model)
    return "\n".join(text for node, text in runs if belief[node] >= 0.5)


def extract_main_text(pages: DataFrame, model: TreeModel, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """id_col, url_col, `text` (empty if none), `n_chars` for each row of pages. Null html is an empty page; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), model) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facetgraph.llm.labelled_pages import PAGES

    return extract_main_text(table(spark, sf_dir, "pages"), train(PAGES))
