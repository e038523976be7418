"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks with their place in the element tree. A
logistic classifier over each block's features gives its score s; the cost of
calling it boilerplate is log(1 + e^s), the cost of calling it content
log(1 + e^-s), and these are its capacities to source and sink. The classifier
sees the block alone: its length, links and ending, and the menus, footers,
forms and names of adverts that it stands in. What it can't see comes in as
smoothness costs: edges between neighbours in page order, the heavier the
nearer they are in the tree, between neighbours under one parent, and from an
article or main element, a node of its own that is content, to the blocks that
no boilerplate element cuts off from it. The minimum cut is the cheapest
labelling; the source side is the content. So a short line of an article that
looks like boilerplate stays with its neighbours.

The weights are learned from pages that mark their article: its blocks are the
examples of content, the rest those of boilerplate. Each weight starts from a
stated value and moves as far as the pages bear it out, so names that the
sample lacks keep theirs; without such pages all keep theirs.

Text rules: character references are decoded, white space within a block
becomes one space, blocks are trimmed, empty ones go, and content blocks are
joined by one line break in page order. Defined results: null, empty and
text-free pages give the empty text; unclosed and unmatched tags are repaired
by closing what they imply; each row is extracted alone, so repeated rows come
out alike; further columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import HEAD, pieces, table, trimmed

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |(?P<head>""" + HEAD + r""")
    |<(?P<raw>script|style|iframe|textarea)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<[!?/][^>]*>
    |<[a-zA-Z][^>]*>""",
    re.S | re.I | re.X,
)
ATTRIBUTE = re.compile(r"""([^\s"'=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
WORD = re.compile(r"[a-z]+")
# Elements that hold the page or its article: words of their attributes speak of what else is in them.
HOLDERS = frozenset("html body main article".split())

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body article main section div table ul ol dl blockquote form nav aside header footer".split())
ENDS_PARAGRAPH = SCOPE | frozenset("p h1 h2 h3 h4 h5 h6 pre hr address fieldset figure figcaption".split())
# Elements whose content is no text; one without an end tag ends with its parent. The first two don't end a block.
DROPPED = frozenset("svg select noscript template".split())
BARRIER = SCOPE | frozenset("noscript template foreignobject".split())

#: Stated values of the classifier's weights. First what a block is: log of its characters, share of linked characters,
#: an ending of a sentence, a heading. Then what it stands in: elements, and names in the class, id or role of an element.
#: A name counts only if all its words are listed (cookie-notice, not has-sidebar).
PLAIN = {"": -1.8, "length": 0.5, "links": -3.0, "sentence": 0.6, "heading": 0.3}
ELEMENTS = dict.fromkeys("nav footer aside form menu button dialog select".split(), -6.0) | {"header": -4.0, "figcaption": -0.5}
NAMES = dict.fromkeys(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice "
    "popup promo promoted recommended related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget complementary contentinfo search alert".split(),
    -6.0,
) | {"header": -4.0, "masthead": -4.0} | dict.fromkeys("article content entry post story main text body".split(), 1.0)
STATED = PLAIN | {f"<{k}>": v for k, v in ELEMENTS.items()} | {f".{k}": v for k, v in NAMES.items()}
HIDDEN = -12.0
#: Smoothness: neighbours in page order (divided by their distance in the tree), neighbours under one parent, and what an
#: article or a main element binds its blocks with; and the score of such an element.
NEIGHBOUR, SIBLING, BOUND, BINDING = 0.5, 0.75, {"article": 4.0, "main": 2.5}, 50.0


class Block:
    __slots__ = ("parts", "linked", "marks", "path", "heading", "hub", "text")

    def __init__(self, path: tuple[int, ...], heading: bool, hub: tuple[int, str] | None):
        self.parts: list[str] = []
        self.linked = 0
        self.marks: frozenset[str] = frozenset()
        self.path, self.heading, self.hub = path, heading, hub
        self.text = ""

    def features(self) -> dict[str, float]:
        n = len(self.text)
        out = {"": 1.0, "length": math.log1p(n), "links": min(1.0, self.linked / n), "sentence": float(self.text[-1] in ".!?\"'"), "heading": float(self.heading)}
        return out | dict.fromkeys(self.marks, 1.0)


def attribute_marks(attrs: str) -> tuple[frozenset[str], frozenset[str], bool]:
    """Names in class, id and role that speak against the element's blocks, names that speak for them, and whether it is hidden."""
    against: set[str] = set()
    favour: set[str] = set()
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return frozenset(), frozenset(), True
        if name in ("class", "id", "role"):
            for token in value.split():
                words = WORD.findall(token)
                known = [w for w in words if w in NAMES]
                if known and len(known) == len(words) and any(NAMES[w] < 0 for w in known):
                    against.update(f".{w}" for w in known if NAMES[w] < 0)
                else:
                    favour.update(f".{w}" for w in known if NAMES[w] > 0)
    return frozenset(against), frozenset(favour), False


def blocks(page: str) -> list[Block]:
    """The page's text blocks with text, in page order."""
    found: list[Block] = []
    # name, marks of what encloses, number of the element, whether no element but only names speak against it, the article that binds it
    stack: list[tuple[str, frozenset[str], int, bool, tuple[int, str] | None]] = [("", frozenset(), 0, True, None)]
    serial, links, dropped = 0, 0, 0
    block: Block | None = None
    at = 0

    def flush() -> None:
        nonlocal block
        if block is not None:
            block.text = " ".join(html.unescape("".join(block.parts)).split())
            if block.text:
                found.append(block)
            block = None

    def add(text: str) -> None:
        nonlocal block
        if dropped:
            return
        if block is None:
            if not text.strip():
                return
            block = Block(tuple(s[2] for s in stack if s[0] in SCOPE), any(s[0] in ("h1", "h2", "h3") for s in stack[-3:]), stack[-1][4])
        block.parts.append(text)
        block.marks |= stack[-1][1]
        block.hub = block.hub and stack[-1][4]
        if links:
            block.linked += len(text)

    def pop_to(k: int) -> None:
        nonlocal links, dropped
        while len(stack) > k:
            name = stack.pop()[0]
            links -= name == "a"
            dropped -= name in DROPPED
            if not dropped and name not in INLINE and name not in ("svg", "select"):
                flush()

    for m in TAG.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if (m["raw"] or m["head"]) and not dropped:
                flush()
            continue
        name = name.lower()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
                if stack[k][0] in SCOPE and name not in SCOPE:
                    break
            continue
        if name in VOID:
            if name in ("br", "img", "wbr"):
                add(" ") if block is not None else None
            elif name == "hr" and not dropped:
                flush()
            continue
        if name == "svg" and m["attrs"].endswith("/"):
            continue
        if name == "body":
            pop_to(2 if stack[1:] and stack[1][0] == "html" else 1)
        closes = CLOSES.get(name, set()) | ({"p"} if name in ENDS_PARAGRAPH else set())
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closes:
                    pop_to(k)
                    break
                if stack[k][0] in BARRIER:
                    break
        if not dropped and name not in INLINE and name not in ("svg", "select"):
            flush()
            serial += 1
        dropped += name in DROPPED
        links += name == "a"
        _, marks, _, by_name, hub = stack[-1]
        against, favour, hidden = frozenset(), frozenset(), False
        if m["attrs"] and "=" in m["attrs"] or "hidden" in m["attrs"]:
            against, favour, hidden = attribute_marks(m["attrs"])
        if name in ("article", "main") and by_name and not against and not hidden:
            marks = frozenset()  # names around an article speak of what else they hold
            hub = (serial, name)
        if hidden:
            marks, hub, by_name = marks | {"hidden"}, None, False
        elif name in ELEMENTS:
            marks, hub, by_name = marks | {f"<{name}>"}, hub if ELEMENTS[name] > -1 else None, by_name and ELEMENTS[name] > -1
        if against and name not in HOLDERS or against and name == "article":
            marks, hub = marks | against, None
        elif favour and not any(STATED.get(x, HIDDEN) < 0 for x in marks):
            marks |= favour
        stack.append((name, marks, serial, by_name, hub))
    if at < len(page):
        add(page[at:])
    pop_to(1)
    flush()
    return found


def block_score(b: Block, weights: dict[str, float]) -> float:
    return sum(weights.get(k, HIDDEN) * v for k, v in b.features().items())


def distance(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    """Steps between two elements of the tree, from their ancestors' numbers."""
    same = 0
    for x, y in zip(a, b):
        if x != y:
            break
        same += 1
    return len(a) + len(b) - 2 * same


def smoothness(found: list[Block]) -> tuple[dict[tuple[int, int], float], int]:
    """Weights of the edges between blocks, and from the nodes that follow them, one for each binding element; the number of those."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[tuple[int, ...], int] = {}
    hubs: dict[tuple[int, str], int] = {}
    for i, b in enumerate(found):
        if i:
            edges[i - 1, i] = NEIGHBOUR / (1 + distance(found[i - 1].path, b.path))
        if b.path in last:
            edges[last[b.path], i] = edges.get((last[b.path], i), 0.0) + SIBLING
        last[b.path] = i
        if b.hub is not None:
            edges[hubs.setdefault(b.hub, len(found) + len(hubs)), i] = BOUND[b.hub[1]]
    return edges, len(hubs)


def minimum_cut(scores: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Whether each node is on the source side of a minimum cut, the smallest such side: augmenting paths of fewest edges first."""
    n = len(scores)
    # flow straight from source to node to sink leaves the difference of its capacities, which is its score
    rest = list(scores)
    flow: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        flow[a][b] = flow[a].get(b, 0.0) + w
        flow[b][a] = flow[b].get(a, 0.0) + w
    # a node that its edges cannot outweigh keeps its own side; its edges turn into capacities of its neighbours
    fixed: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        v = queue.popleft()
        if fixed[v] is None and abs(rest[v]) > sum(flow[v].values()):
            fixed[v] = bool(rest[v] > 0)
            for u, w in flow[v].items():
                del flow[u][v]
                rest[u] += w if fixed[v] else -w
                if fixed[u] is None:
                    queue.append(u)
            flow[v] = {}
    eps = 1e-9
    for start in range(n):
        while fixed[start] is None and rest[start] > eps:
            came: dict[int, int] = {start: start}
            queue, sink = deque([start]), -1
            while queue and sink < 0:
                v = queue.popleft()
                for u, w in flow[v].items():
                    if w > eps and u not in came:
                        came[u] = v
                        if rest[u] < -eps:
                            sink = u
                            break
                        queue.append(u)
            if sink < 0:
                break
            path, v = [], sink
            while v != start:
                path.append((came[v], v))
                v = came[v]
            push = min(rest[start], -rest[sink], *(flow[a][b] for a, b in path))
            for a, b in path:
                flow[a][b] -= push
                flow[b][a] += push
            rest[start] -= push
            rest[sink] += push
    side = [f is True or (f is None and r > eps) for f, r in zip(fixed, rest)]
    queue = deque(v for v in range(n) if side[v] and fixed[v] is None)
    while queue:
        v = queue.popleft()
        for u, w in flow[v].items():
            if w > eps and not side[u]:
                side[u] = True
                queue.append(u)
    return side


def content_blocks(found: list[Block], weights: dict[str, float]) -> list[bool]:
    edges, hubs = smoothness(found)
    return minimum_cut([block_score(b, weights) for b in found] + [BINDING] * hubs, edges)[: len(found)]


def main_text(page: str | None, weights: dict[str, float] = STATED) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return "\n".join(b.text for b, content in zip(found, content_blocks(found, weights)) if content)


EXAMPLES = "names array<string>, numbers array<double>, content boolean"


def examples(pages: DataFrame) -> DataFrame:
    """Features (names and numbers) of every block of pages (column html) that mark an article, and whether it is content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "html", 1 << 22):
                names, numbers, content = [], [], []
                for page in batch.column(0):
                    found = blocks(page.as_py() or "")
                    if any(b.hub is not None and b.hub[1] == "article" for b in found):
                        for b in found:
                            x = b.features()
                            names.append(list(x))
                            numbers.append(list(x.values()))
                            content.append(b.hub is not None and b.hub[1] == "article")
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.list_(pa.string())), pa.array(numbers, pa.list_(pa.float64())), pa.array(content, pa.bool_())], names=["names", "numbers", "content"])

    return pages.select("html").mapInArrow(trimmed(run), EXAMPLES)


def fit(x: np.ndarray, y: np.ndarray, stated: np.ndarray, strength: float = 20.0, steps: int = 30) -> np.ndarray:
    """Logistic regression whose weights are drawn to the stated ones; all examples together weigh as much as `strength` of them."""
    w = stated.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        share = strength / len(y)
        grad = share * (x.T @ (p - y)) + (w - stated)
        step = np.linalg.solve(share * (x.T * (p * (1 - p))) @ x + np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(pages: DataFrame, sample: int = 400) -> dict[str, float]:
    """The classifier's weights, from at most `sample` pages (columns page_id, html), those of the lowest hash of page_id.

    Every block is an example twice, as it stands and without its elements and
    names, for pages that mark nothing.
    """
    chosen = pages.where("html is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = examples(chosen).toPandas()
    if rows["content"].nunique() < 2:
        return dict(STATED)
    order = list(STATED)
    at = {k: i for i, k in enumerate(order)}
    x = np.zeros((len(rows), len(order)))
    for i, (names, numbers) in enumerate(zip(rows["names"], rows["numbers"])):
        for k, v in zip(names, numbers):
            if k in at:
                x[i, at[k]] = v
    bare = x.copy()
    bare[:, len(PLAIN) :] = 0
    y = rows["content"].to_numpy(float)
    return dict(zip(order, fit(np.vstack([x, bare]), np.concatenate([y, y]), np.array([STATED[k] for k in order])).tolist()))


def extract(pages: DataFrame, weights: dict[str, float] | None = None, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns `keep`, text and n_chars of every whole page (column html). weights: those of train, or the stated ones."""
    source = pages.select(*keep, "html")
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars long"
    used = dict(STATED if weights is None else weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "html", 1 << 22):
                texts = [main_text(x.as_py(), used) for x in batch.column(batch.schema.get_field_index("html"))]
                rows = [batch.column(batch.schema.get_field_index(k)) for k in keep]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*keep, "text", "n_chars"])

    return source.mapInArrow(trimmed(run), schema)


def op4_html_extraction(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))


#: For pages whose main text is one article element of h1 and p, with breaks, bold text and at most the four references below.
OP4_SQL = r"""
with a as (select page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) as x from pages),
b as (select page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(x, '</?(p|h1)>', chr(10), 'g'), '<br>', ' ', 'g'), '</?b>', '', 'g'), chr(10)) as parts from a),
c as (select page_id, url, list_filter(list_transform(parts, lambda t: trim(regexp_replace(regexp_replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda t: t <> '') as lines from b)
select page_id, url, array_to_string(lines, chr(10)) as text, cast(length(array_to_string(lines, chr(10))) as bigint) as n_chars from c
"""
