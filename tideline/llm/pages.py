"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks, the runs of text between block-level tags, each with the tags, classes and ids above it.
Features of a block are its ancestors, its own tag, lengths, links, marks and words; the field adds weights for the label
of the block before. Weights are trained by gradient ascent on labelled pages, and Viterbi decoding picks the blocks that
are content. Scripts, styles, comments and other markup never become blocks.

Labelled pages come from ``labelled_pages``: page layouts written down here with a label per block, filled with the text of
a bounded sample of the pages' own paragraphs, so that the field learns layout and shape rather than words.
"""

from __future__ import annotations

import html as html_module
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 14
SAMPLE_PAGES, SENTENCES = 300, 20_000
LAYOUTS, ROUNDS, RATE, DECAY = 400, 30, 0.5, 1e-4

#: Tags that end a block, tags without content, and tags whose content is no text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead title tr ul video audio canvas".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = ("script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object")
CLOSES_PARAGRAPH = BLOCK_TAGS - {"br", "button"}
#: What an opening tag ends, up to the tag that holds such things.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
BLANKS = re.compile(r"\s+")
NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass(eq=False, slots=True)
class Node:
    """An open tag: the tag around it, its names, and the features that it adds to those of the tags around it."""

    parent: Node | None
    tag: str
    names: str
    added: tuple[int, ...]
    in_title: bool


@dataclass
class Block:
    text: str
    linked: int
    node: Node | None

    @property
    def path(self) -> tuple[tuple[str, str], ...]:
        """(tag, names) from the root."""
        found, node = [], self.node
        while node:
            found.append((node.tag, node.names))
            node = node.parent
        return tuple(reversed(found))


class _Open:
    """The open tags, by depth and by tag, so that no step looks through all of them."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.features: dict[str, int] = {}

    def top(self, tags: Iterable[str]) -> int:
        """The depth of the innermost of some tags, or -1."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=-1)

    def push(self, tag: str, names: str) -> None:
        own = dict.fromkeys([f"in {tag}", *(f"name {n}" for n in names.split())])
        added = tuple(_number(f) for f in own if not self.features.get(f))
        for f in own:
            self.features[f] = self.features.get(f, 0) + 1
        parent = self.nodes[-1] if self.nodes else None
        self.depths.setdefault(tag, []).append(len(self.nodes))
        if tag in BLOCK_TAGS:
            self.blocks.append(len(self.nodes))
        self.nodes.append(Node(parent, tag, names, added, tag == "title" or bool(parent and parent.in_title)))

    def cut(self, depth: int) -> None:
        """Ends all tags from a depth on."""
        while len(self.nodes) > depth:
            node = self.nodes.pop()
            self.depths[node.tag].pop()
            if node.tag in BLOCK_TAGS:
                self.blocks.pop()
            for f in dict.fromkeys([f"in {node.tag}", *(f"name {n}" for n in node.names.split())]):
                self.features[f] -= 1


def leaf_blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order, with blanks folded, none empty, in time linear in the page.

    Unclosed tags end with what holds them, stray end tags are passed over, cut-off markup is markup, and a quote that
    is not closed is a character of its tag.
    """
    page = page or ""
    blocks: list[Block] = []
    stack = _Open()
    texts: list[str] = []
    linked = 0

    def end_block() -> None:
        nonlocal linked
        if texts:
            text = BLANKS.sub(" ", html_module.unescape("".join(texts))).strip()
            if text:
                blocks.append(Block(text, linked, stack.nodes[-1] if stack.nodes else None))
            texts.clear()
        linked = 0

    def close(tags: set[str], within: set[str]) -> None:
        limit = stack.top(within)
        while (depth := stack.top(tags)) > limit:
            end_block()
            stack.cut(depth)

    at = 0
    for found in TOKEN.finditer(page):
        if found.start() < at:
            continue
        if found.start() > at:
            piece = page[at : found.start()]
            texts.append(piece)
            if stack.depths.get("a"):
                linked += len(piece)
        at = found.end()
        slash, name, attributes = found.group(1), (found.group(2) or "").lower(), found.group(3) or ""
        if not name:
            continue
        if name in HIDDEN_TAGS and not slash:
            if not attributes.endswith("/"):
                ending = _ending(name).search(page, at)
                at = ending.end() if ending else len(page)
            continue
        if name in BLOCK_TAGS:
            end_block()
        if slash:
            depth = stack.top((name,))
            if depth >= 0 and (name in BLOCK_TAGS or not stack.blocks or depth > stack.blocks[-1]):
                stack.cut(depth)
            continue
        if name in CLOSES_PARAGRAPH:
            close({"p"}, {"table", "td", "th", "li", "div", "section", "article", "blockquote", "button"})
        if name in ENDS:
            close(*ENDS[name])
        if name not in VOID_TAGS and not attributes.endswith("/"):
            stack.push(name, _names(attributes))
    if at < len(page):
        rest = page[at:]
        texts.append(rest[: rest.index("<")] if re.search(r"<[/!?a-zA-Z]", rest) else rest)
    end_block()
    return blocks


@lru_cache(maxsize=64)
def _ending(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I)


def _names(attributes: str) -> str:
    if not attributes:
        return ""
    found = []
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role"):
            found += NAME_PARTS.findall(value)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            found.append("hidden")
    return " ".join(x.lower() for x in found)


@lru_cache(maxsize=1 << 16)
def _number(feature: str) -> int:
    return zlib.crc32(feature.encode()) % FEATURES


def own_features(blocks: list[Block]) -> list[list[int]]:
    """Numbers of the features of each block, from its shape, its place and its own tag."""
    title = next((b.text for b in blocks if b.node and b.node.in_title), None)
    out = []
    for i, block in enumerate(blocks):
        size = len(block.text)
        words = block.text.count(" ") + 1
        found = ["bias", f"length {min(9, size.bit_length())}", f"words {min(8, words.bit_length())}", f"links {min(4, 4 * block.linked // max(1, size))}"]
        found.append(f"ends {block.text[-1] if block.text[-1] in '.!?:,' else 'x'}")
        found.append(f"marks {min(3, sum(map(block.text.count, '.,;!?')) * 8 // words)}")
        if block.text[0] in "©" or "©" in block.text:
            found.append("copyright")
        if title is not None and block.text == title:
            found.append("as title")
        if i == 0:
            found.append("first")
        if i == len(blocks) - 1:
            found.append("last")
        if block.node:
            found += [f"own {block.node.tag}", f"pair {block.node.parent.tag if block.node.parent else ''} {block.node.tag}"]
        out.append([*map(_number, found)])
    return out


def block_features(blocks: list[Block]) -> list[list[int]]:
    """``own_features``, and those of the tags around each block; for the small pages of training."""
    out = own_features(blocks)
    for block, own in zip(blocks, out):
        node = block.node
        while node:
            own += node.added
            node = node.parent
    return out


@dataclass(frozen=True)
class Field:
    """Weights by feature and label (1 is content), and by label and next label."""

    weights: np.ndarray
    follows: np.ndarray

    def scores(self, features: list[list[int]]) -> np.ndarray:
        counts = np.fromiter(map(len, features), np.int64, len(features))
        flat = np.fromiter((f for own in features for f in own), np.int64, int(counts.sum()))
        return np.add.reduceat(self.weights[flat], np.concatenate(([0], np.cumsum(counts)[:-1])), axis=0)

    def around(self, blocks: list[Block]) -> np.ndarray:
        """What the tags around each block add to its scores; each tag's features are added up once."""
        known: dict[Node | None, tuple[float, float]] = {None: (0.0, 0.0)}
        for block in blocks:
            waiting, node = [], block.node
            while node not in known:
                waiting.append(node)
                node = node.parent
            a, b = known[node]
            for node in reversed(waiting):
                for x, y in self.weights[list(node.added)].tolist():
                    a, b = a + x, b + y
                known[node] = (a, b)
        return np.array([known[b.node] for b in blocks])

    def labels(self, blocks: list[Block]) -> list[int]:
        """The most likely labels of a page's blocks, in time linear in the page."""
        return self.best(self.scores(own_features(blocks)) + self.around(blocks)) if blocks else []

    def decode(self, features: list[list[int]]) -> list[int]:
        """The most likely labels of blocks with given features."""
        return self.best(self.scores(features)) if features else []

    def best(self, block_scores: np.ndarray) -> list[int]:
        """Viterbi: the labels of the highest sum; of equal ones, not content."""
        scores = block_scores.tolist()
        (f00, f01), (f10, f11) = self.follows.tolist()
        a, b = scores[0]
        back = []
        for x, y in scores[1:]:
            back.append((a + f00 < b + f10, a + f01 < b + f11))
            a, b = max(a + f00, b + f10) + x, max(a + f01, b + f11) + y
        label = int(b > a)
        labels = [label]
        for own in reversed(back):
            label = int(own[label])
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[list[list[int]], list[int]]], rounds: int = ROUNDS, rate: float = RATE, decay: float = DECAY) -> Field:
    """Gradient ascent on the mean log-likelihood of the labels, with forward-backward sums and adaptive steps."""
    weights, follows = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    seen_w, seen_f = np.full((FEATURES, 2), 1e-8), np.full((2, 2), 1e-8)
    pages = [p for p in pages if p[0]]
    for _ in range(rounds):
        field = Field(weights, follows)
        grad_w, grad_f = -decay * len(pages) * weights, -decay * len(pages) * follows
        for features, labels in pages:
            scores = field.scores(features)
            n = len(labels)
            ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0] = scores[0]
            for i in range(1, n):
                ahead[i] = np.logaddexp(ahead[i - 1, 0] + follows[0], ahead[i - 1, 1] + follows[1]) + scores[i]
            for i in range(n - 2, -1, -1):
                later = scores[i + 1] + behind[i + 1]
                behind[i] = np.logaddexp(follows[:, 0] + later[0], follows[:, 1] + later[1])
            total = np.logaddexp(*ahead[-1])
            error = -np.exp(ahead + behind - total)
            error[np.arange(n), labels] += 1
            counts = np.fromiter(map(len, features), np.int64, n)
            flat = np.fromiter((f for own in features for f in own), np.int64, int(counts.sum()))
            np.add.at(grad_w, flat, np.repeat(error, counts, axis=0))
            if n > 1:
                pair = ahead[:-1, :, None] + follows + (scores[1:] + behind[1:])[:, None, :] - total
                grad_f -= np.exp(pair).sum(axis=0)
                np.add.at(grad_f, (labels[:-1], labels[1:]), 1)
        seen_w += grad_w**2
        seen_f += grad_f**2
        weights = weights + rate * grad_w / np.sqrt(seen_w)
        follows = follows + rate * grad_f / np.sqrt(seen_f)
    return Field(weights, follows)


class _Layout:
    """Writes one page out of given sentences, with its content blocks."""

    def __init__(self, rng: random.Random, sentences: list[str]):
        self.rng, self.sentences, self.content = rng, sentences, []

    def words(self, low: int, high: int) -> str:
        return " ".join(" ".join(self.rng.choice(self.sentences) for _ in range(3)).split()[: self.rng.randint(low, high)])

    def text(self, low: int = 1, high: int = 4) -> str:
        return " ".join(self.rng.choice(self.sentences) for _ in range(self.rng.randint(low, high)))

    def tag(self, tag: str, inner: str, names: str = "") -> str:
        key = self.rng.choice(["class", "class", "id"])
        return f'<{tag}{f" {key}=" + chr(34) + names + chr(34) if names else ""}>{inner}</{tag}>'

    def either(self, tags: str, names: str, inner: str) -> str:
        """A tag that says what it is, or a plain one whose name does."""
        if self.rng.random() < 0.5:
            return self.tag(self.rng.choice(tags.split()), inner, self.rng.choice(["", *names.split()]))
        return self.tag(self.rng.choice(["div", "section", "div"]), inner, self.rng.choice(names.split()))

    def keep(self, text: str) -> str:
        text = BLANKS.sub(" ", text).strip()
        if text:
            self.content.append(text)
        return html_module.escape(text, quote=False)

    def links(self, count: int) -> str:
        items = [f'<li><a href="/x">{html_module.escape(self.words(1, 3))}</a></li>' for _ in range(count)]
        return f"<ul>{''.join(items)}</ul>" if self.rng.random() < 0.7 else " ".join(x[4:-5] for x in items)

    def boilerplate(self) -> str:
        rng, escape = self.rng, html_module.escape
        kind = rng.choice(["nav", "header", "aside", "ad", "notice", "form", "related", "share"])
        if kind == "nav":
            return self.either("nav", "nav menu navbar navigation breadcrumb breadcrumbs topmenu", self.links(rng.randint(1, 9)))
        if kind == "header":
            return self.either("header", "header site-header masthead banner branding top", self.tag(rng.choice(["div", "p", "span", "h1"]), escape(self.words(1, 8)), rng.choice(["", "logo", "tagline"])))
        if kind == "aside":
            inner = self.tag("h3", escape(self.words(1, 4))) + (self.links(rng.randint(2, 6)) if rng.random() < 0.6 else f"<p>{escape(self.text(1, 3))}</p>")
            return self.either("aside", "sidebar widget side rail secondary", inner)
        if kind == "ad":
            return self.tag(rng.choice(["div", "div", "aside", "section", "p"]), rng.choice([escape(self.text(1, 2)), f"<p>{escape(self.text(1, 2))}</p>"]), rng.choice("ad ads advert advertisement sponsored promo ad-slot banner-ad".split()))
        if kind == "notice":
            return self.tag(rng.choice(["div", "p", "section", "dialog"]), rng.choice([escape(self.text(1, 2)), f"<p>{escape(self.text(1, 2))}</p><button>{escape(self.words(1, 2))}</button>"]), rng.choice("cookie notice cookie-notice consent alert newsletter subscribe popup modal banner gdpr paywall".split()))
        if kind == "form":
            inner = f"<label>{escape(self.words(1, 4))}</label><input type=\"text\"><select><option>{escape(self.words(1, 2))}</option><option>{escape(self.words(1, 2))}</option></select><button>{escape(self.words(1, 2))}</button>"
            return self.tag("form", rng.choice([inner, f"<p>{escape(self.text(1, 1))}</p>" + inner]), rng.choice(["", "search", "login", "signup"]))
        if kind == "related":
            return self.either("aside section", "related recommended more-stories read-more also tags", self.tag("h2", escape(self.words(1, 4))) + self.links(rng.randint(2, 6)))
        return self.tag("div", self.links(rng.randint(2, 4)), rng.choice("share social sharing toolbar pagination pager meta byline".split()))

    def comments(self) -> str:
        escape = html_module.escape
        inner = self.tag("h3", escape(self.words(1, 3))) if self.rng.random() < 0.6 else ""
        for _ in range(self.rng.randint(1, 5)):
            inner += self.tag(self.rng.choice(["div", "li", "article"]), rng_pick(self.rng, [f"<p>{escape(self.text(1, 3))}</p>", escape(self.text(1, 3))]), self.rng.choice(["comment", "comment-body", "reply", ""]))
        return self.either("section div", "comments comment-list responses discussion disqus", inner)

    def article(self) -> str:
        rng, parts = self.rng, []
        head = self.words(3, 14)
        if rng.random() < 0.9:
            parts.append(f"<h1>{self.keep(head)}</h1>")
        for i in range(rng.randint(0, 9)):
            roll = rng.random()
            if roll < 0.08:
                parts.append(f"<{rng.choice(['h2', 'h3'])}>{self.keep(self.words(1, 6))}</{'h2'}>".replace("</h2>", ""))
            elif roll < 0.14:
                parts.append("<ul>" + "".join(f"<li>{self.keep(self.words(2, 25))}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif roll < 0.18:
                parts.append(f"<blockquote>{self.keep(self.text(1, 2))}</blockquote>")
            elif roll < 0.21:
                cells = "".join(f"<td>{self.keep(self.words(1, 3))}</td>" for _ in range(rng.randint(1, 4)))
                parts.append(f"<table><tr>{cells}</tr></table>")
            elif roll < 0.24:
                parts.append(f"<pre>{self.keep(self.words(2, 15))}</pre>")
            elif roll < 0.28:
                parts.append(f"<figure><img src=\"x\"><figcaption>{self.keep(self.words(2, 12))}</figcaption></figure>")
            elif roll < 0.38:
                parts.append(f"<p><b>{self.keep(self.words(2, 40) if rng.random() < 0.6 else head)}<br>")
            else:
                text = self.text(1, 6) if rng.random() < 0.85 else self.words(1, 3)
                shown = self.keep(text)
                if rng.random() < 0.15 and " " in shown:
                    cut = shown.index(" ")
                    shown = f"<a href=\"/y\">{shown[:cut]}</a>{shown[cut:]}"
                parts.append(f"<p>{shown}" + ("</p>" if rng.random() < 0.85 else ""))
            if rng.random() < 0.06:
                parts.append(self.boilerplate())
        inner = "".join(parts)
        roll = rng.random()
        if roll < 0.5:
            return f"<article>{inner}</article>"
        if roll < 0.65:
            return self.tag("main", inner)
        return self.tag("div", inner, rng.choice("content article post entry story main article-body post-content entry-content text".split()))

    def page(self) -> str:
        rng, escape = self.rng, html_module.escape
        head = f"<head><meta charset=\"utf-8\"><title>{escape(self.words(1, 12))}</title><style>p{{margin:0}}</style><script>var x=\"</p>\";</script></head>"
        before = "".join(self.boilerplate() for _ in range(rng.randint(0, 4)))
        main = self.article() if rng.random() < 0.97 else ""
        after = "".join(self.boilerplate() for _ in range(rng.randint(0, 3)))
        if rng.random() < 0.35:
            after = self.comments() + after
        foot = ""
        if rng.random() < 0.85:
            line = f"&copy; {escape(self.words(1, 4))} &middot; {escape(self.text(1, 2))}"
            foot = self.either("footer", "footer site-footer bottom copyright legal colophon", rng_pick(rng, [line, f"<p>{line}</p>", self.links(3) + line]))
        end = "</body></html>" if rng.random() < 0.9 else ""
        return f"<!DOCTYPE html><html>{head}<body>{before}{main}{after}{foot}{end}"


def rng_pick(rng: random.Random, options: list[str]) -> str:
    return rng.choice(options)


def labelled_pages(sentences: list[str], count: int = LAYOUTS, seed: int = 11) -> list[tuple[str, list[str]]]:
    """Pages with the texts of their content blocks, out of ``sentences``."""
    rng, made = random.Random(seed), []
    for _ in range(count):
        layout = _Layout(rng, sentences)
        page = layout.page()
        made.append((page, layout.content))
    return made


def labels_of(blocks: list[Block], content: list[str]) -> list[int]:
    """1 for the blocks that are the next content text, in order."""
    labels, at = [], 0
    for block in blocks:
        hit = at < len(content) and block.text == content[at] and not any(tag in ("title", "head") for tag, _ in block.path)
        labels.append(int(hit))
        at += hit
    return labels


SENTENCE = re.compile(r"[^.!?]+[.!?]+")


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, layouts: int = LAYOUTS) -> Field:
    """A field trained on layouts filled with up to ``SENTENCES`` sentences of ``sample_pages`` pages, by smallest digest."""
    drawn = pages.where("html IS NOT NULL").select("html").orderBy(F.xxhash64("html"), "html").limit(sample_pages)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.strip() for page in batch.column(0).to_pylist() for b in leaf_blocks(page) for s in SENTENCE.findall(b.text)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s in found if len(s) < 400], pa.string())], names=["sentence"])

    listed = drawn.mapInArrow(cut, "sentence string").distinct().orderBy(F.xxhash64("sentence"), "sentence").limit(SENTENCES)
    sentences = [r.sentence for r in listed.collect()] or ["A few plain words stand here.", "And some more of them, too."]
    examples = []
    for page, content in labelled_pages(sentences, layouts):
        blocks = leaf_blocks(page)
        examples.append((block_features(blocks), labels_of(blocks, content)))
    return train(examples)


def main_text(page: str | None, field: Field) -> str:
    """The content blocks of a page, in order, joined by one space; empty if there are none."""
    blocks = leaf_blocks(page)
    return " ".join(b.text for b, keep in zip(blocks, field.labels(blocks)) if keep)


def extract(pages: DataFrame, field: Field, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` of every row; null is an empty page."""
    shared = pages.sparkSession.sparkContext.broadcast(field)
    chosen = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{html}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            texts = [main_text(x, held) for x in batch.column(len(keep)).to_pylist()]
            columns = [*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f"k{i}" for i in range(len(keep))), "text", "n_chars"])

    schema = ", ".join([*(f"k{i} {chosen.schema[i].dataType.simpleString()}" for i in range(len(keep))), "text string, n_chars long"])
    made = chosen.mapInArrow(run, schema)
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")
