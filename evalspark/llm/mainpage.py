"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A leaf block is the text between two block-level tags. Its features are the tags and the words of the class and id
attributes of its ancestors, its own tag, its length, its share of linked text and its last sign. The
model has a weight per feature and one per pair of neighbouring labels, is trained by gradient steps on the
likelihood of labelled pages, and decodes each page by Viterbi's algorithm.

Labelled pages come from the pages themselves. Pages that mark their article (article or main) say which blocks are
main text; at most ``sample`` of them (a documented bound), those with the smallest hash of their id, are
taken into one task. Each is learnt as it is and in ``variants`` other layouts, in which its article stands in
other containers and its texts also serve as menus, headers, footers, sidebars, notices, adverts, forms, share
bars and reader comments, around and inside the article. The weights, one per feature seen there, are all that
reaches the driver.

Cases: null, empty and tagless pages give the text the model finds in them, or an empty one; tags cut off at the
end are dropped; repeated rows are read each; other columns are not read; no rows give no rows; without pages
that mark an article the model learns from filler texts.
"""

from __future__ import annotations

import html
import json
import math
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.frames import bounded_rows, map_batches

# fixed values: elements of HTML by their role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript svg iframe object head title math canvas audio video".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPE = frozenset("table td th caption button object ul ol dl select".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block(NamedTuple):
    text: str
    path: tuple  # of (tag, words of class and id), from the root
    linked: float  # share of its characters that are links


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    found: list[Block] = []
    stack: list[tuple[str, tuple]] = []
    parts: list[str] = []
    links = hidden = at = 0
    linked = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, tuple(x for x in stack if x[0] not in INLINE), min(1.0, linked / len(text))))
            parts, linked = [], 0

    def pop(depth: int) -> None:
        nonlocal links, hidden
        for name, _ in stack[depth:]:
            links -= name == "a"
            hidden -= name in HIDDEN
        del stack[depth:]

    end = len(page)
    while at < end:
        m = TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and not hidden:
            parts.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name not in INLINE:
            flush()
        elif name == "br":
            parts.append(" ")
            continue
        if m[1]:  # an end tag closes its element and what is open inside; one without a partner does nothing
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    pop(depth)
                    break
                if name in INLINE and stack[depth][0] not in INLINE:
                    break
            continue
        closing = ("p",) if name in ENDS_P else SIBLINGS.get(name, ())
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in closing:
                    pop(depth)
                    break
                if stack[depth][0] in SCOPE or (name in SIBLINGS and stack[depth][0] in ENDS_P):
                    break
        if name in VOID or m[3].endswith("/") and name not in RAW and name in ("svg", "path"):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            if name == "textarea":
                parts.append("")
            at = close.start() if close else end
            skip = page.find(">", at)
            at = skip + 1 if close and skip >= 0 else end
            continue
        words = tuple(w.lower() for a in ATTRIBUTE.findall(m[3]) for w in WORD.findall(" ".join(a))) if m[3] else ()
        stack.append((name, words))
        links += name == "a"
        hidden += name in HIDDEN
    flush()
    return found


_path_features: dict[tuple, list[str]] = {}


def features(b: Block) -> list[str]:
    known = _path_features.get(b.path)
    if known is None:
        if len(_path_features) > 20_000:
            _path_features.clear()
        tags = {t for t, _ in b.path}
        words = {w for _, ws in b.path for w in ws}
        known = [f"in {t}" for t in tags] + [f"as {w}" for w in words] + [f"tag {b.path[-1][0] if b.path else ''}"]
        if b.path:
            known += [f"tag as {w}" for w in b.path[-1][1]]
        _path_features[b.path] = known
    n = len(b.text)
    return [
        *known, f"length {min(7, int(math.log2(n + 1)) // 2 * 2)}", f"linked {int(b.linked * 3.999)}",
        f"ends {b.text[-1] if b.text[-1] in '.!?:;,' else 'other'}", f"copyright {'©' in b.text}",
    ]


class Chain:
    """Two labels, 1 for main text: weights of features for label 1, and weights of pairs of labels."""

    def __init__(self, weights: dict[str, float] | None = None, pairs=((0.0, 0.0), (0.0, 0.0)), bias: float = 0.0):
        self.weights, self.pairs, self.bias = dict(weights or {}), [list(p) for p in pairs], bias

    def scores(self, page: list[Block]) -> list[float]:
        get = self.weights.get
        return [self.bias + sum(get(f, 0.0) for f in features(b)) for b in page]

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not page:
            return []
        (a, b), (c, d) = self.pairs
        back = []
        no, yes = 0.0, 0.0
        for i, s in enumerate(self.scores(page)):
            if i:
                back.append((0 if no + a >= yes + c else 1, 0 if no + b >= yes + d else 1))
                no, yes = max(no + a, yes + c), max(no + b, yes + d) + s
            else:
                yes = s
        labels = [0 if no >= yes else 1]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def learn(self, pages: list[tuple[list[Block], list[int]]], passes: int, rate: float = 0.6, decay: float = 1e-4) -> None:
        """Gradient steps on the likelihood, with a rate per weight."""
        seen: dict = {}

        def step(table, key, gradient: float) -> None:
            gradient -= decay * (table.get(key, 0.0) if isinstance(table, dict) else table[key])
            name = (id(table), key)
            seen[name] = seen.get(name, 1e-6) + gradient * gradient
            change = rate * gradient / math.sqrt(seen[name])
            if isinstance(table, dict):
                table[key] = table.get(key, 0.0) + change
            else:
                table[key] += change

        own = {"bias": self.bias}
        for _ in range(passes):
            for page, labels in pages:
                if not page:
                    continue
                self.bias = own["bias"]
                s = np.array(self.scores(page))
                t = np.array(self.pairs)
                n = len(page)
                emit = np.stack([np.zeros(n), s], axis=1)
                ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
                ahead[0] = emit[0]
                for i in range(1, n):
                    ahead[i] = emit[i] + np.logaddexp(ahead[i - 1][0] + t[0], ahead[i - 1][1] + t[1])
                for i in range(n - 2, -1, -1):
                    x = emit[i + 1] + behind[i + 1]
                    behind[i] = np.logaddexp(t[:, 0] + x[0], t[:, 1] + x[1])
                total = np.logaddexp(ahead[-1][0], ahead[-1][1])
                chance = np.exp(ahead[:, 1] + behind[:, 1] - total)
                for b, y, p in zip(page, labels, chance.tolist(), strict=True):
                    if abs(y - p) > 1e-3:
                        step(own, "bias", y - p)
                        for f in features(b):
                            step(self.weights, f, y - p)
                if n > 1:
                    both = np.exp(ahead[:-1, :, None] + t[None] + (emit + behind)[1:, None, :] - total).sum(axis=0)
                    for a, b in zip(labels[:-1], labels[1:], strict=True):
                        both[a][b] -= 1
                    for a in (0, 1):
                        for b in (0, 1):
                            step(self.pairs[a], b, -float(both[a][b]) / n)
        self.bias = own["bias"]


# words of class and id attributes that the layouts use
PLAIN = "container wrapper page site layout row column inner outer block box section group item".split()
MAIN = "content main article post entry story body text single primary".split()
KINDS = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar links".split(),
    "header": "header masthead top branding logo banner".split(),
    "footer": "footer copyright legal bottom colophon imprint".split(),
    "sidebar": "sidebar widget aside related recommended popular trending rail more".split(),
    "notice": "cookie cookies consent notice notification alert gdpr popup modal overlay privacy disclaimer".split(),
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner".split(),
    "form": "form search login subscribe newsletter signup register contact".split(),
    "comments": "comment comments commentlist reply replies respond discussion disqus responses thread feedback reviews".split(),
    "share": "share sharing social tags meta follow".split(),
}
TAGS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}
LEAVES = {
    "menu": ["li", "li", "a", "div"], "header": ["p", "div", "h1", "h2", "span"], "footer": ["p", "div", "li", "small"],
    "sidebar": ["li", "p", "h3", "div"], "notice": ["p", "div", "h2"], "advert": ["p", "div", "h3"],
    "form": ["label", "button", "p", "legend", "option", "div"], "comments": ["p", "p", "li", "div", "h3"], "share": ["li", "p", "div"],
}
FILLER = ["Every river begins somewhere.", "The old town lies on a hill, and its walls are of grey stone.", "Nobody knew the answer."]


def _layout(rng: random.Random, title: str, paragraphs: list[str], others: list[str]) -> tuple[list[Block], list[int]]:
    """A labelled page: the article in some container, and the other parts of a page around and inside it."""
    root = (("html", ()), ("body", ()))
    for _ in range(rng.randint(0, 2)):
        root += ((rng.choice(["div", "section"]), tuple(rng.sample(PLAIN, rng.randint(0, 2)))),)
    texts = others + paragraphs or FILLER

    def part(kind: str, above: tuple) -> list[tuple[Block, int]]:
        named = kind not in TAGS or rng.random() < 0.5
        words = tuple(rng.sample(KINDS[kind], rng.randint(1, 2))) if named else ()
        tag = TAGS.get(kind, "div") if not named or rng.random() < 0.4 else rng.choice(["div", "div", "section", "ul", "aside"])
        path = above + ((tag, words),)
        if rng.random() < 0.3:
            path += (("div", tuple(rng.sample(PLAIN, rng.randint(0, 1)))),)
        is_link = kind in ("menu", "share") or kind == "sidebar" and rng.random() < 0.5
        count = rng.randint(2, 7) if kind in ("menu", "comments", "sidebar", "form") else rng.randint(1, 2)
        found = []
        for _ in range(count):
            text = rng.choice(texts)
            if kind in ("menu", "share", "form", "header") and rng.random() < 0.8:
                text = " ".join(text.split()[: rng.randint(1, 4)])
            if kind == "footer" and rng.random() < 0.5:
                text = "© " + text
            leaf = rng.choice(LEAVES[kind])
            own = path if rng.random() < 0.25 or leaf in ("a", "span", "small") else path + ((leaf, ()),)
            found.append((Block(text, own, 1.0 if is_link else 0.0), 0))
        return found

    container = rng.choice(["article", "article", "main", "both", "named", "named", "none"])
    inside = {"article": (("article", ()),), "main": (("main", ()),), "both": (("main", ()), ("article", ())), "none": ()}.get(container)
    if inside is None:
        inside = ((rng.choice(["div", "section"]), tuple(rng.sample(MAIN, rng.randint(1, 2)))),)
    if rng.random() < 0.3:
        inside += (("div", tuple(rng.sample(MAIN + PLAIN, 1))),)
    path = root + inside
    body: list[tuple[Block, int]] = []
    if title:
        above = path + ((("header", ()),) if rng.random() < 0.15 and container in ("article", "both") else ())
        body.append((Block(title, above + (("h1", ()),), 0.0), 1))
    for text in paragraphs[: rng.choice([2, 5, 40])]:
        leaf = rng.choice(["p"] * 8 + ["h2", "li", "blockquote", "pre", "div"])
        extra = (("ul", ()),) if leaf == "li" else ()
        body.append((Block(text, path + extra + ((leaf, ()),), rng.choice([0.0] * 5 + [0.2])), 1))
        if rng.random() < 0.2:
            body += part(rng.choice(["advert", "sidebar", "share", "notice", "form"]), path)
    if rng.random() < 0.35:
        body += part("share", path)
    if rng.random() < 0.6:
        body += part("comments", path if rng.random() < 0.6 else root)
    front = [k for k in ("notice", "header", "menu", "advert", "sidebar", "form") if rng.random() < 0.45]
    rear = [k for k in ("sidebar", "advert", "form", "share", "menu", "notice", "footer") if rng.random() < 0.4]
    found = [x for k in front for x in part(k, root)] + body + [x for k in rear for x in part(k, root)]
    return [b for b, _ in found], [y for _, y in found]


def labelled(pages: list[tuple[int, str]], variants: int) -> list[tuple[list[Block], list[int]]]:
    """Labelled pages from (seed, html) pairs that mark their article."""
    found = []
    for seed, page in pages or [(0, "")]:
        rng = random.Random(seed)
        own = blocks(page)
        labels = [int(any(t in ("article", "main") for t, _ in b.path) and not any(t in TAGS.values() for t, _ in b.path)) for b in own]
        if any(labels):
            found.append((own, labels))
        main = [b for b, y in zip(own, labels, strict=True) if y]
        title = next((b.text for b in main if b.path[-1][0] == "h1"), "")
        paragraphs = [b.text for b in main if b.path[-1][0] != "h1"][:40] or FILLER
        others = [b.text for b, y in zip(own, labels, strict=True) if not y]
        found += [_layout(rng, title, paragraphs, others) for _ in range(variants)]
    return found


def train(pages: DataFrame, sample: int = 250, variants: int = 8, passes: int = 6, id_col: str = "page_id", html_col: str = "html") -> Chain:
    rows = pages.select(F.xxhash64(id_col).alias("seed"), F.col(html_col).alias("page"))
    marked = rows.where(F.col("page").rlike("(?i)<(article|main)[\\s>]")).orderBy("seed", "page").limit(sample)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        taken = [x for b in batches for x in zip(b.column("seed").to_pylist(), b.column("page").to_pylist(), strict=True)]
        taken.sort()
        chain = Chain()
        examples = labelled(taken, variants)
        random.Random(11).shuffle(examples)
        chain.learn(examples, passes)
        yield {"model": pa.array([json.dumps([chain.weights, chain.pairs, chain.bias])])}

    found = bounded_rows(map_batches(marked.repartition(1), learn, "model string"), 1)
    if found:
        return Chain(*json.loads(found[0]["model"]))
    chain = Chain()
    chain.learn(labelled([], variants), passes)
    return chain


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, y in zip(found, chain.decode(found), strict=True) if y)


def extract(pages: DataFrame, chain: Chain, keep: list[str], html_col: str = "html") -> DataFrame:
    """The kept columns, text (the main text, empty if there is none) and n_chars (its code points)."""
    rows = pages.select(*keep, F.col(html_col).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            texts = [main_text(p, chain) for p in b.column("_html").to_pylist()]
            yield {c: b.column(c) for c in keep} | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(rows, run, f"{types}, text string, n_chars long")
