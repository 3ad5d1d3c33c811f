"""HTML extraction: boosted trees over DOM nodes and hierarchical decoding.

A page becomes a tree of block elements whose leaves are runs of text. Each node has features of its
subtree (text, link and punctuation density), attribute tokens of its own and of its ancestors, depth
and place among its siblings. Boosted trees give the log-odds that a subtree holds main text. The
decoding takes, of all consistent choices, the likeliest: a dropped node drops all below it, so no
ancestor contradicts a descendant. The trees are trained on generated pages, of which it's known which
blocks are main text; the training is the same in every run.

White space inside a block becomes one blank, blocks are joined by \\n, references are decoded. Scripts,
styles, comments and controls are no text. Null and empty pages, and pages without main text, give the
empty text. Unclosed tags, stray end tags and cut-off pages are read as browsers do, roughly; a head ends at
the first tag that can't stand in it, and of an unclosed control only the tag is skipped. Rows are
independent: repeated rows repeat, an empty table stays empty, clashing input columns give way.
"""

from __future__ import annotations

import functools
import html as references
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import boosting
from .common import prepare, with_arrow_columns

#: Fixed values of the markup language.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("applet audio canvas datalist head iframe math noembed noframes noscript object script select style svg template textarea title video".split())
RAW = frozenset("script style textarea title".split())
HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
          "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
TAGS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "table", "td", "blockquote", "figure", "button", "label", "dl")
#: Ancestors that are features of their own.
ABOVE = ("nav", "header", "footer", "aside", "form", "article", "main", "li", "table", "section")
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|$))|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_ENDS = re.compile(r"[.!?。…]")
NUMBERS = 26
#: Nodes whose features are held at once; a page of more has them all to itself.
NODES = 20_000


@dataclass
class Tree:
    """Nodes in page order; a node's subtree is the run up to its end."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, tokens=(), text=None, linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.tokens.append(tokens)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1


@functools.lru_cache(4096)
def attribute_tokens(attributes: str) -> tuple[str, ...]:
    found = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        value = re.sub(r"([a-z])([A-Z])", r"\1 \2", value)
        found += _WORD.findall(value.lower())
    return tuple(dict.fromkeys(found))


def end_of_head(page: str, at: int) -> int:
    """Where the head that starts before `at` ends: at its end tag or the first tag that can't stand in a head."""
    while m := _TOKEN.search(page, at):
        name = (m[2] or m[5] or "").lower()
        if name and ((m[1] or m[4]) and name == "head" or name not in HEAD):
            return m.start()
        at = m.end()
        if name in SKIPPED and name != "head" and not (m[1] or m[4]):
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            if not end and name in RAW:
                break
            at = end.start() if end else at
    return len(page)


def parse(page: str) -> Tree:
    tree = Tree()
    stack = [tree.add(-1, "#page")]
    names = ["#page"]
    count: Counter[str] = Counter()  # of open elements, so that stray end tags needn't walk the stack
    endless: set[str] = set()  # skipped elements of which no end tag follows
    run: list[str] = []
    linked, link, at, n = 0, False, 0, len(page)

    def flush():
        nonlocal linked
        if run:
            text = " ".join(references.unescape("".join(run)).split())
            if text:
                tree.add(stack[-1], "#text", (), text, min(linked, len(text)))
            run.clear()
            linked = 0

    def close(upto: int):
        flush()
        count.subtract(names[upto:])
        del stack[upto:], names[upto:]

    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            run.append(text)
            if link:
                linked += len(text)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:
            if name == "a":
                link = False
            elif count[name]:
                for k in range(len(names) - 1, 0, -1):
                    if names[k] == name:
                        close(k)
                        break
            continue
        if name == "head":
            at = end_of_head(page, at)
            run.append(" ")
        elif name in SKIPPED:
            closed = name in ("svg", "math") and m[0].endswith("/>")
            end = None if closed or name in endless else re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            if end:
                at = end.start()
            elif not closed:
                endless.add(name)
                if name in RAW:
                    at = n
            run.append(" ")
        elif name == "a":
            link = True
        elif name in VOID:
            run.append(" ")
            if name == "hr":
                flush()
        elif name in BLOCKS or "-" in name:
            flush()
            if names[-1] == "p":
                close(len(names) - 1)
            if name in CLOSES:
                closed, edge = CLOSES[name]
                for k in range(len(names) - 1, 0, -1):
                    if names[k] in edge:
                        break
                    if names[k] in closed:
                        close(k)
            if name in ("html", "body") and name in names:
                continue
            stack.append(tree.add(stack[-1], name, attribute_tokens(m[3] if m[3] is not None else m[6] or "")))
            names.append(name)
            count[name] += 1
    flush()
    return tree


def features(tree: Tree, vocabulary: dict[str, int]) -> np.ndarray:
    n = len(tree.parent)
    parent = np.array(tree.parent)
    leaf = np.array([t is not None for t in tree.text])
    chars = np.array([len(t) if t else 0 for t in tree.text], float)
    words = np.array([t.count(" ") + 1 if t else 0 for t in tree.text], float)
    ends = np.array([len(_ENDS.findall(t)) if t else 0 for t in tree.text], float)
    linked, leaves, longest = np.array(tree.linked, float), leaf.astype(float), chars.copy()
    elements = (~leaf).astype(float)
    before = np.concatenate([[0], np.cumsum(chars)[:-1]])
    sums = np.stack([chars, words, ends, linked, leaves, elements])
    children, order, last = np.zeros(n), np.zeros(n), np.full(n, -1)
    left, right = np.full(n, -1), np.full(n, -1)
    for k in range(n - 1, 0, -1):
        p = tree.parent[k]
        sums[:, p] += sums[:, k]
        longest[p] = max(longest[p], longest[k])
    depth = np.zeros(n)
    for k in range(1, n):
        p = tree.parent[k]
        depth[k] = depth[p] + 1
        order[k] = children[p]
        children[p] += 1
        if last[p] >= 0:
            left[k], right[last[p]] = last[p], k
        last[p] = k
    chars, words, ends, linked, leaves, elements = sums
    total = max(chars[0], 1)
    top = np.maximum(parent, 0)
    size = lambda at: np.where(at >= 0, np.log1p(chars[at]), 0)
    tags = np.array(tree.tag)
    own_tag = np.where(leaf, tags[top], tags)
    numbers = [
        depth, np.log1p(chars), np.log1p(words), linked / np.maximum(chars, 1), np.log1p(elements), np.log1p(chars / (elements + 1)), ends / np.maximum(words, 1),
        order, children[top], chars / np.maximum(chars[top], 1), before / total, (before + chars) / total, children, np.log1p(chars / np.maximum(leaves, 1)), leaf,
        size(left), size(right), (left >= 0) & (tags[left] == tags), (right >= 0) & (tags[right] == tags), np.log1p(longest), chars / total,
        linked[top] / np.maximum(chars[top], 1), np.log1p(chars[top]), ends, ends[top] / np.maximum(words[top], 1), np.log1p(leaves),
    ]
    tokens = len(vocabulary)
    out = np.zeros((n, NUMBERS + len(TAGS) + len(ABOVE) + 2 * tokens), np.float32)
    out[:, :NUMBERS] = np.stack(numbers, axis=1)
    for k, name in enumerate(TAGS):
        out[:, NUMBERS + k] = own_tag == name
    above, inherited = NUMBERS + len(TAGS), NUMBERS + len(TAGS) + len(ABOVE) + tokens
    flag = {name: above + k for k, name in enumerate(ABOVE)}
    for k in range(1, n):
        p = tree.parent[k]
        out[k, above:above + len(ABOVE)] = out[p, above:above + len(ABOVE)]
        out[k, inherited:] = out[p, inherited:]
        name = tree.tag[k]
        if name in flag:
            out[k, flag[name]] = 1
        for t in tree.tokens[k]:
            if t in vocabulary:
                out[k, inherited - tokens + vocabulary[t]] = out[k, inherited + vocabulary[t]] = 1
    return out


def decode(tree: Tree, margin: np.ndarray) -> list[str]:
    """The texts kept by the likeliest choice in which nothing is kept below a dropped node."""
    n = len(tree.parent)
    keep_one = -np.logaddexp(0, -margin)
    drop_all = -np.logaddexp(0, margin)
    best = keep_one.copy()  # of the node's subtree, itself kept
    for k in range(n - 1, 0, -1):
        p = tree.parent[k]
        best[p] += max(best[k], drop_all[k])
        drop_all[p] += drop_all[k]
    kept = np.zeros(n, bool)
    kept[0] = best[0] >= drop_all[0]
    out = []
    for k in range(1, n):
        kept[k] = kept[tree.parent[k]] and best[k] >= drop_all[k]
        if kept[k] and tree.text[k] is not None:
            out.append(tree.text[k])
    return out


@dataclass
class Model:
    vocabulary: dict[str, int]
    trees: boosting.Boosted

    def extract(self, pages: list[str | None]) -> list[str]:
        out: list[str] = []
        held: list[Tree | None] = []
        nodes = 0
        for page in pages:
            tree = parse(page) if page else None
            more = len(tree.parent) if tree else 0
            if nodes and nodes + more > NODES:
                out += self._texts(held)
                held, nodes = [], 0
            held.append(tree)
            nodes += more
        return out + self._texts(held)

    def _texts(self, parsed: list[Tree | None]) -> list[str]:
        rows = [features(t, self.vocabulary) for t in parsed if t is not None]
        margin = self.trees.margin(np.concatenate(rows)) if rows else np.zeros(0)
        out, at = [], 0
        for t in parsed:
            if t is None:
                out.append("")
                continue
            out.append("\n".join(decode(t, margin[at : at + len(t.parent)])))
            at += len(t.parent)
        return out


@functools.cache
def trained(pages: int = 480, seed: int = 17) -> Model:
    """The model of generated pages."""
    from .html_samples import sample

    rng = np.random.default_rng(seed)
    trees, labels = [], []
    for _ in range(pages):
        page, main = sample(rng)
        tree = parse(page)
        good = np.array([t is not None and t in main for t in tree.text])
        for k in range(len(good) - 1, 0, -1):
            good[tree.parent[k]] |= good[k]
        trees.append(tree)
        labels.append(good)
    seen = Counter(t for tree in trees for tokens in tree.tokens for t in set(tokens))
    vocabulary = {t: k for k, t in enumerate(sorted(t for t, c in seen.items() if c >= 6))}
    x, y = np.concatenate([features(t, vocabulary) for t in trees]), np.concatenate(labels).astype(float)
    return Model(vocabulary, boosting.fit(x, y, trees=80, share=0.35, rows=0.8))


def main_texts(pages: DataFrame) -> DataFrame:
    """pages (html, ...) with text and n_chars."""
    spark = prepare(pages.sparkSession)
    shared = spark.sparkContext.broadcast(trained())
    at = pages.columns.index("html")

    def compute(batch):
        texts = shared.value.extract(batch.column(at).to_pylist())
        return pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())

    return with_arrow_columns(pages, "text string, n_chars long", compute)
