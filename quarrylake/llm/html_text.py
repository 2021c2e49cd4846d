"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is read into a sequence of leaf blocks, each with its ancestors' tags, class
and id words and its own text. A conditional random field scores every block as main
text or not from those features and from its neighbour's label; Viterbi decoding
gives the best labelling of the page. The field is trained in the driver, in seconds,
by gradient ascent of the conditional log-likelihood on labelled pages. As the tables
hold no labelled pages, ``labelled_pages`` writes them: layouts of many kinds, filled
with invented words, whose main blocks are known (their number is a parameter).

Scripts, styles, templates, titles and form controls are no text. All else is, also
inside ``math``, ``svg``, ``noscript``, ``object``, ``canvas``, ``iframe`` and hidden
elements: tags and being hidden are features, the field decides.

Scale: one Arrow map, no shuffle; the weights (some hundred numbers) travel with the
task. Whole pages are read, nothing is dropped or capped.

A null or empty page has an empty text. White space is what ``str.split`` takes as
such. A line break tag counts as white space. Repeated rows give repeated rows; other
columns are ignored.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose start or end cuts a block (fixed values, from the HTML standard).
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements without content (fixed values).
VOID_TAGS = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements whose content is no text of the page (fixed values).
RAW_TAGS = frozenset("script style template title textarea select".split())
#: Those of them whose content no parser reads as elements: without an end tag they
#: reach to the end of the page; of others only the tag is skipped (fixed values).
TEXT_ONLY_TAGS = frozenset("script style textarea title".split())
#: Elements of other languages, in which a tag that ends in a slash has no content
#: (fixed values).
FOREIGN_TAGS = frozenset("svg math".split())
#: Elements that end at the start of the ones named (fixed values).
ENDED_BY: dict[str, frozenset[str]] = {
    "p": BLOCK_TAGS - frozenset("body head html caption tbody td tfoot th thead tr option optgroup legend title".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A leaf block: its text, how much of it lies in links, its ancestors."""

    text: str
    linked: float
    tags: tuple[str, ...]
    names: frozenset[str]
    hidden: bool = False


@dataclass
class _Open:
    tag: str
    names: frozenset[str]
    hidden: bool = False
    raw: bool = False


def is_hidden(attributes: str) -> bool:
    """Whether a tag's attributes hide its element: by name, not by a word in a value."""
    if not HIDDEN.search(attributes):
        return False
    own = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        own.setdefault(name.lower(), "".join(values).strip().lower())
    return "hidden" in own or own.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", own.get("style", "")))


def blocks_of(page: str | None) -> list[Block]:
    """The page's leaf blocks in order, without scripts, styles, titles, templates and
    form controls. All else is text; the field decides, by tags and by what is hidden."""
    out: list[Block] = []
    stack: list[_Open] = []
    parts: list[str] = []
    linked: list[str] = []
    endless: set[str] = set()

    def cut() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                in_links = len("".join(html.unescape("".join(linked)).split()))
                out.append(Block(text, min(1.0, in_links / max(1, len(text.replace(" ", "")))), tuple(x.tag for x in stack), frozenset().union(*(x.names for x in stack)), any(x.hidden for x in stack)))
            parts.clear()
            linked.clear()

    def take(text: str) -> None:
        if text:
            parts.append(text)
            if any(x.tag == "a" for x in stack):
                linked.append(text)

    page = page or ""
    at = 0
    while m := TOKEN.search(page, at):
        take(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK_TAGS:
                cut()
            if any(x.tag == tag for x in stack):
                while stack.pop().tag != tag:
                    pass
            continue
        if tag in RAW_TAGS:
            if tag in BLOCK_TAGS and not any(x.tag in FOREIGN_TAGS for x in stack):
                cut()
            if not m[3].rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                end = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in TEXT_ONLY_TAGS:
                    at = len(page)
                else:
                    endless.add(tag)
            parts.append(" ") if parts else None
            continue
        if m[3].endswith("/") and (tag in FOREIGN_TAGS or any(x.tag in FOREIGN_TAGS for x in stack)):
            continue
        if tag in BLOCK_TAGS:
            cut()
        while stack and tag in ENDED_BY.get(stack[-1].tag, ()):
            stack.pop()
        if tag in BLOCK_TAGS and "p" in (own := [x.tag for x in stack]) and tag in ENDED_BY["p"]:  # an open <p> below inline elements
            last = len(own) - 1 - own[::-1].index("p")
            if not any(t in BLOCK_TAGS for t in own[last + 1 :]):
                del stack[last:]
        if tag in VOID_TAGS:
            if parts:
                parts.append(" ")
            continue
        names = frozenset(WORD.findall(" ".join(a or b or c for a, b, c in NAMED.findall(m[3])).lower())) if "=" in m[3] else frozenset()
        stack.append(_Open(tag, names, bool(m[3]) and is_hidden(m[3])))
    take(page[at:])
    cut()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Feature names of each block of a page."""
    out = []
    for i, b in enumerate(blocks):
        words = b.text.split()
        own = [f"in:{t}" for t in dict.fromkeys(b.tags)] + [f"name:{n}" for n in b.names]
        own += [f"leaf:{b.tags[-1] if b.tags else ''}", f"length:{min(7, len(words).bit_length())}", f"links:{int(b.linked * 4)}"]
        own += [f"depth:{min(9, len(b.tags))}", "bias"]
        if re.search(r"[.!?…\"»]$", b.text):
            own.append("sentence")
        if re.match(r"(?:©|\(c\)|copyright\b)", b.text, re.I):
            own.append("copyright")
        if b.hidden:
            own.append("hidden")
        if i == 0:
            own.append("first")
        if i == len(blocks) - 1:
            own.append("last")
        out.append(own)
    return out


@dataclass
class Field:
    """Weights of a two-label linear chain: per feature, and per pair of labels."""

    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        """Each block's score of being main text, against 0 for not."""
        return np.array([sum(self.weights[self.index[f]] for f in row if f in self.index) for row in rows])

    def decode(self, scores: np.ndarray) -> list[int]:
        """Viterbi: the labelling of highest score."""
        if not len(scores):
            return []
        best, back = np.array([0.0, scores[0]]), []
        for s in scores[1:]:
            ways = best[:, None] + self.steps
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + np.array([0.0, s])
        label = int(best.argmax())
        out = [label]
        for b in reversed(back):
            label = int(b[label])
            out.append(label)
        return out[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(scores: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward sums: P(label) of each block, and expected label pairs."""
    n = len(scores)
    local = np.stack([np.zeros(n), scores], axis=1)
    ahead, behind = local.copy(), np.zeros((n, 2))
    for i in range(1, n):
        ahead[i] += _log_sum(ahead[i - 1][:, None] + steps, 0)
    for i in range(n - 2, -1, -1):
        behind[i] = _log_sum(steps + (local[i + 1] + behind[i + 1])[None, :], 1)
    whole = _log_sum(ahead[-1], 0)
    single = np.exp(ahead + behind - whole)
    pairs = np.zeros((2, 2))
    for i in range(n - 1):
        pairs += np.exp(ahead[i][:, None] + steps + (local[i + 1] + behind[i + 1])[None, :] - whole)
    return single[:, 1], pairs


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-3, seed: int = 3) -> Field:
    """Adaptive stochastic gradient ascent of the conditional log-likelihood."""
    index = {f: i for i, f in enumerate(sorted({f for rows, _ in pages for r in rows for f in r}))}
    out = Field(index, np.zeros(len(index)), np.zeros((2, 2)))
    grown, grown_steps = np.full(len(index), 1e-2), np.full((2, 2), 1e-2)
    coded = [([[index[f] for f in r] for r in rows], np.array(labels)) for rows, labels in pages if rows]
    rng = random.Random(seed)
    for _ in range(rounds):
        rng.shuffle(coded)
        for rows, labels in coded:
            scores = np.array([out.weights[r].sum() for r in rows])
            main, pairs = marginals(scores, out.steps)
            slope = np.zeros(len(index))
            for r, d in zip(rows, labels - main, strict=True):
                slope[r] += d
            touched = np.flatnonzero(slope)
            slope[touched] -= decay * out.weights[touched]
            seen = np.zeros((2, 2))
            np.add.at(seen, (labels[:-1], labels[1:]), 1)
            step = seen - pairs - decay * out.steps
            grown[touched] += slope[touched] ** 2
            grown_steps += step**2
            out.weights[touched] += rate * slope[touched] / np.sqrt(grown[touched])
            out.steps += rate * step / np.sqrt(grown_steps)
    return out


#: Names of wrappers of main text, and of everything around it, in labelled pages
#: (fixed values).
MAIN_NAMES = "content main article post entry story body text page markdown prose".split()
SIDE_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topbar toc pager pagination".split(),
    "header": "header masthead banner branding hero site top".split(),
    "footer": "footer foot bottom legal copyright site".split(),
    "aside": "sidebar side aside widget related recommended trending popular more rail".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner dfp adslot".split(),
    "notice": "notice cookie consent gdpr alert banner popup modal newsletter subscribe paywall message warning info".split(),
    "form": "form search login signup subscribe newsletter contact".split(),
    "comments": "comments comment reply replies discussion respond disqus reviews".split(),
    "share": "share social sharing follow tags meta byline author".split(),
}


def labelled_pages(count: int, seed: int = 5) -> list[tuple[str, list[str]]]:
    """Pages of many layouts in invented words, each with its main blocks in order."""
    rng = random.Random(seed)
    parts = ["ba", "ke", "li", "no", "ru", "sta", "ven", "tor", "mi", "sel", "é", "öst", "ña", "qu", "dra"]

    def words(n: int) -> str:
        return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))

    def sentence() -> str:
        return words(rng.randint(3, 16)).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def prose() -> str:
        style = rng.random()
        text = " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 4, 8])))
        if style < 0.08:
            return text.upper()
        return words(rng.randint(1, 3)) if style < 0.16 else text

    def box(tag: str, kind: str, body: str) -> str:
        names = " ".join(rng.sample(SIDE_NAMES[kind], k=rng.randint(1, 2)))
        if rng.random() < 0.08:
            return f'<{tag} {rng.choice(["hidden", "style=display:none", "aria-hidden=true"])} class="{names}">{body}</{tag}>'
        return f'<{tag} class="{names}">{body}</{tag}>' if rng.random() < 0.75 else f'<{tag} id="{names.split()[0]}">{body}</{tag}>' if rng.random() < 0.5 or tag in ("div", "section") else f"<{tag}>{body}</{tag}>"

    def links() -> str:
        items = [f'<a href="/{words(1)}">{words(rng.randint(1, 3))}</a>' for _ in range(rng.randint(2, 8))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else " | ".join(items)

    def small() -> str:
        return rng.choice([prose, sentence, lambda: f"<p>{prose()}</p>", lambda: f"<p>{sentence()}</p><p>{sentence()}</p>"])()

    def around(where: str) -> str:
        kinds = {"top": ["nav", "header", "notice", "ad", "form"], "in": ["ad", "share", "aside", "notice", "form"], "end": ["comments", "aside", "share", "form", "ad", "notice", "nav"], "last": ["footer"]}[where]
        kind = rng.choice(kinds)
        tag = {"nav": ["nav", "div", "nav"], "header": ["header", "div"], "footer": ["footer", "footer", "div"], "aside": ["aside", "aside", "div", "section"], "form": ["form", "form", "div"], "comments": ["section", "div"]}.get(kind, ["div", "div", "section", "aside"])
        tag = rng.choice(tag)
        if kind == "nav":
            return box(tag, kind, links())
        if kind == "form":
            body = f"<label>{words(2)}</label><input name=q><button>{words(1)}</button>" + (f"<p>{sentence()}</p>" if rng.random() < 0.5 else "")
            return box(tag, kind, body if tag == "form" else f"<form>{body}</form>")
        if kind == "footer":
            return box(tag, kind, rng.choice(["&copy; ", "© ", "", ""]) + rng.choice([prose(), sentence() + "<br>" + sentence(), f"<p>{sentence()}</p>" + links()]))
        if kind == "comments":
            one = lambda: rng.choice([f'<div class="comment"><b>{words(1)}</b><p>{prose()}</p></div>', f"<li><p>{prose()}</p></li>", f"<p>{prose()}</p>"])
            return box(tag, kind, (f"<h3>{words(2)}</h3>" if rng.random() < 0.6 else "") + "".join(one() for _ in range(rng.randint(1, 5))))
        if kind == "aside":
            return box(tag, kind, (f"<h3>{words(2)}</h3>" if rng.random() < 0.5 else "") + rng.choice([links, small, lambda: f"<p>{prose()}</p>"])())
        if kind == "header":
            return box(tag, kind, rng.choice([f"<h1>{words(2)}</h1>", f"<div>{words(2)}</div>", ""]) + rng.choice([links(), f"<p>{sentence()}</p>", sentence()]))
        return box(tag, kind, rng.choice([small(), small(), links()]))

    out = []
    for _ in range(count):
        main: list[str] = []

        def own(text: str, main: list[str] = main) -> str:
            main.append(" ".join(html.unescape(re.sub(r"<[^>]*>", "", text.replace("<br>", " "))).split()))
            return text

        body = [f"<h{rng.choice('112')}>{own(words(rng.randint(2, 9)))}</h1>".replace("</h1>", "</h1>")] if rng.random() < 0.8 else []
        body = [re.sub(r"^<h2>(.*)</h1>$", r"<h2>\1</h2>", b, flags=re.S) for b in body]
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.72:
                text = own(prose())
                body.append(rng.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text}", f"<div>{text}</div>"]))
            elif kind < 0.8:
                body.append(f"<h2>{own(words(3))}</h2>")
            elif kind < 0.86:
                body.append("<ul>" + "".join(f"<li>{own(sentence())}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
            elif kind < 0.9:
                body.append(f"<blockquote>{own(prose())}</blockquote>")
            elif kind < 0.93:
                body.append(f'<p>{own(words(4) + " <a href=/x>" + words(2) + "</a> " + words(5) + ".")}</p>')
            else:
                body.append(around("in"))
        inner = "".join(body)
        wrap = rng.random()
        name = " ".join(rng.sample(MAIN_NAMES, k=rng.randint(1, 2)))
        if wrap < 0.45:
            inner = f"<article>{inner}</article>"
        elif wrap < 0.6:
            inner = f'<article class="{name}">{inner}</article>'
        elif wrap < 0.72:
            inner = f"<main>{inner}</main>"
        elif wrap < 0.9:
            inner = f'<div class="{name}">{inner}</div>'
        else:
            inner = f'<div id="{name.split()[0]}">{inner}</div>'
        if rng.random() < 0.2:
            inner = f"<main>{inner}</main>"
        top = "".join(around("top") for _ in range(rng.randint(0, 4)))
        end = "".join(around("end") for _ in range(rng.randint(0, 3))) + (around("last") if rng.random() < 0.85 else "")
        if rng.random() < 0.2:
            inner = f'<div class="{rng.choice(["wrapper", "container", "row", "layout"])}">{inner}{around("end")}</div>'
        out.append((f"<!DOCTYPE html><html><head><title>{words(3)}</title><script>var a='</p>';</script></head><body>{top}{inner}{end}</body></html>", main))
    return out


def labels_of(blocks: list[Block], main: list[str]) -> list[int]:
    """1 for the blocks that are the main blocks in order."""
    left = list(main)
    out = []
    for b in blocks:
        hit = bool(left) and b.text == left[0]
        left = left[1:] if hit else left
        out.append(int(hit))
    return out


@functools.lru_cache(maxsize=2)
def trained(count: int = 700, seed: int = 5) -> Field:
    """The field trained on ``count`` labelled pages."""
    pages = []
    for page, main in labelled_pages(count, seed):
        blocks = blocks_of(page)
        pages.append((features(blocks), labels_of(blocks, [m for m in main if m])))
    return train(pages)


def main_text(page: str | None, model: Field) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, label in zip(blocks, model.decode(model.scores(features(blocks))), strict=True) if label)


def extract(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", training_pages: int = 700) -> DataFrame:
    """The operator: key, url, text and n_chars of every page."""
    model = trained(training_pages)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(url, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [main_text(x.as_py(), model) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return df.select(F.col(key), F.col(url).cast("string"), F.col(page).cast("string")).mapInArrow(run, schema)
