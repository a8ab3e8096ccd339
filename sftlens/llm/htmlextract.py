"""Main-text extraction: a linear-chain CRF over the leaf blocks of a page's DOM.

A page is cut into leaf blocks: runs of text between block-level tags, with the tags, classes and
ids of their open block-level ancestors.  Each block is described by those and by text features
(length, end punctuation, share of link text, notice words); the CRF labels blocks as main
text or not, Viterbi over the pages of a batch.  It is trained on labelled pages; the default ones are
written from a rule (``labelled_pages``): articles in various containers among menus, headers,
footers, sidebars, adverts, notices, forms and reader comments.

Scripts, styles, comments and markup are never text.  Character references are decoded, white
space inside a block becomes one blank, blocks are joined by an empty line in page order.

Edge cases: null or empty html gives empty text; unclosed, crossed and cut-off tags are tolerated (a
cut-off tag at the end is markup); repeated rows give equal rows; an empty table an empty result; time
is linear in the page's length.
"""
from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import crf

BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav noscript ol option p pre
section select summary table tbody td textarea tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# opening one of these ends an open one of the same set
ALONE = {t: s for s in (("p",), ("li",), ("dt", "dd"), ("option",), ("tr",), ("td", "th")) for t in s}
ENDS_P = BLOCK - {"button", "label", "option"}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|template|svg)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<loose>/?[a-zA-Z])[^>]*+(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)", re.S | re.I)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
NOTICE = re.compile(r"©|copyright|cookie|subscribe|newsletter|sign up|log in|all rights|privacy|advert|sponsored|share this|read more|follow us", re.I)


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """(ancestor features, text, characters inside links) of each leaf block with text."""
    out: list = []
    if not page:
        return out
    stack: list[tuple[str, tuple[str, ...]]] = []  # open block-level tags, each with all features so far
    still_open: Counter = Counter()  # tags on the stack
    parts: list[str] = []
    links = linked = 0

    def close() -> str:
        tag = stack.pop()[0]
        still_open[tag] -= 1
        return tag

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append((stack[-1][1] if stack else (), text, linked))
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(text)

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            say(page[at:m.start()])
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            continue
        tag = tag.lower()
        if m.group("end"):
            if tag in BLOCK:
                flush()
                if still_open[tag]:  # else there is nothing to look for, however deep the page is
                    while close() != tag:
                        pass
            elif tag == "a" and links:
                links -= 1
        elif tag in BLOCK:
            flush()
            if tag in ENDS_P and stack and stack[-1][0] == "p":
                close()
            if tag in ALONE and stack and ALONE.get(stack[-1][0]) == ALONE[tag]:
                close()
            if tag not in VOID:
                attrs = m.group("attrs")
                have = stack[-1][1] if stack else ()
                new = {"t_" + tag}
                if "=" in attrs:
                    for x in NAMES.finditer(attrs):
                        new.update("k_" + w for w in PART.findall((x.group(1) or x.group(2) or x.group(3) or "").lower()))
                still_open[tag] += 1
                stack.append((tag, tuple(sorted(set(have) | new)) if not new <= set(have) else have))
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            links += 1
    if at < len(page):
        say(page[at:])
    flush()
    return out


def text_features(text: str, linked: int) -> tuple[str, ...]:
    n = len(text)
    words = text.count(" ") + 1
    share = linked / n
    return ("bias", "len_" + ("1" if words < 3 else "3" if words < 6 else "6" if words < 12 else "12" if words < 30 else "30"),
            "link_" + ("none" if share == 0 else "some" if share < 0.5 else "most"),
            "stop" if text[-1] in ".!?…\"'”»" else "open", "notice" if n < 400 and NOTICE.search(text) else "plain")


def labelled_pages(pages: int = 160, seed: int = 5) -> list[tuple[str, list[bool]]]:
    """(html, is main text per leaf block) of made-up pages, from a rule."""
    rng = random.Random(seed)
    vocabulary = "the a of and to in river house stone light green small people year time water story found made long new old city".split()

    def words(low, high):
        return " ".join(rng.choice(vocabulary) for _ in range(rng.randint(low, high)))

    def sentence(low=1, high=40):
        return words(low, high).capitalize() + rng.choice("...!?")

    noise = (
        lambda: ("<nav><ul>" + "<li><a href='#'>{}</a></li>" * 4 + "</ul></nav>", [words(1, 2) for _ in range(4)]),
        lambda: ("<header><div class='logo'>{}</div><p>{}</p></header>", [words(1, 3), sentence()]),
        lambda: ("<div class='ad'>{}</div>", [sentence()]),
        lambda: ("<div class='advert banner'><p>{}</p></div>", [sentence()]),
        lambda: ("<div id='sidebar'><h3>{}</h3><p>{}</p><ul><li><a>{}</a></li></ul></div>", [words(1, 3), sentence(), words(2, 5)]),
        lambda: ("<aside><h4>{}</h4><p>{}</p></aside>", [words(1, 3), sentence()]),
        lambda: ("<aside class='related'><a>{}</a></aside>", [words(3, 9)]),
        lambda: ("<div class='menu'><a>{}</a> <a>two</a></div>", [words(1, 2)]),
        lambda: ("<div class='cookie-notice'><p>{}</p><button>OK</button></div>", ["This site uses cookies. " + sentence()]),
        lambda: ("<div class='notice alert'>{}</div>", [sentence()]),
        lambda: ("<form><label>{}</label><p>{}</p><button>{}</button></form>", [words(1, 3), sentence(), words(1, 1)]),
        lambda: ("<form class='newsletter'><p>{}</p><select><option>{}</option></select></form>", ["Subscribe: " + words(2, 9), words(1, 2)]),
        lambda: ("<div class='share social'><a>{}</a></div>", ["Share this"]),
        lambda: ("<div class='breadcrumbs'><a>{}</a></div>", [words(1, 2)]),
        lambda: ("<div class='promo sponsored'><h3>{}</h3><p>{}</p></div>", [words(1, 4), sentence()]),
        lambda: ("<table class='menu'><tr><td><a>{}</a></td><td><a>{}</a></td></tr></table>", [words(1, 2), words(1, 2)]),
    )
    comments = (
        lambda: ("<section class='comments'><h3>Comments</h3><p>{}</p><p>{}</p></section>", [sentence(), sentence()]),
        lambda: ("<div id='comments'><div class='comment'><p>{}</p></div></div>", [sentence()]),
        lambda: ("<ol class='comment-list'><li>{}</li><li>{}</li></ol>", [sentence(), sentence()]),
        lambda: ("<div class='reader-comments'><blockquote>{}</blockquote></div>", [sentence()]),
        lambda: ("<div class='responses reply'><p>{}</p></div>", [sentence()]),
    )
    boxes = ("<article>{}</article>", "<article>{}</article>", "<article class='post'>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>",
             "<div class='content'>{}</div>", "<div id='content'>{}</div>", "<div class='post-body entry'>{}</div>", "<div class='article-text'>{}</div>",
             "<section class='story'>{}</section>", "<div class='main'><div>{}</div></div>", "<div>{}</div>", "{}")
    bodies = (lambda s: f"<p>{s}</p>", lambda s: f"<p>{s}</p>", lambda s: f"<p><b>{s}<br>", lambda s: f"<h2>{s}</h2>",
              lambda s: f"<ul><li>{s}</li></ul>", lambda s: f"<blockquote>{s}</blockquote>", lambda s: f"<p><a>x</a> {s}</p>",
              lambda s: f"<table><tr><td>{s}</td></tr></table>", lambda s: f"<pre>{s}</pre>", lambda s: f"<div>{s}</div>")
    footers = ("<footer>{}</footer>", "<footer><p>{}</p></footer>", "<div class='footer'>{}</div>", "<div id='footer'><p>{}</p></div>")
    out = []
    for _ in range(pages):
        marks: list[bool] = [False]
        page = f"<html><head><title>{words(2, 6)}</title></head><body>"

        def add(pieces):
            nonlocal page
            form, texts = pieces()
            form = form.format(*texts)
            marks.extend([False] * len(blocks(form)))
            page += form

        for piece in rng.sample(noise, rng.randint(1, 5)):
            add(piece)
        box = rng.choice(boxes)
        head, _, tail = box.partition("{}")
        page += head
        if rng.random() < 0.6:
            page += f"<h1>{words(2, 9)}</h1>"
            marks.append(True)
        for _ in range(rng.randint(1, 9)):
            page += rng.choice(bodies)(sentence())
            marks.append(True)
            if rng.random() < 0.08:
                add(rng.choice(noise[2:4] + noise[6:7] + noise[12:13]))
        if "article" in box and rng.random() < 0.4:
            add(rng.choice(comments))
        page += tail
        if rng.random() < 0.4:
            add(rng.choice(comments))
        for piece in rng.sample(noise, rng.randint(0, 2)):
            add(piece)
        add(lambda: (rng.choice(footers), [rng.choice(["© ", "", "Copyright "]) + sentence()]))
        out.append((page + "</body></html>", marks))
    return out


class Extractor:
    """The fitted CRF; emissions of descriptions are memoised."""

    def __init__(self, labelled: list[tuple[str, list[bool]]]):
        described, labels = [], []
        for page, marks in labelled:
            own = blocks(page)
            if len(own) != len(marks):
                raise ValueError(f"a labelled page has {len(own)} blocks and {len(marks)} labels")
            described.append([self.describe(b) for b in own])
            labels.append(np.array(marks, np.int64))
        names = sorted({f for page in described for d in page for f in d})
        index = {f: i for i, f in enumerate(names)}
        kinds: dict[tuple, int] = {}
        chains = [np.array([kinds.setdefault(d, len(kinds)) for d in page], np.int64) for page in described]
        rows = np.zeros((len(kinds), len(names)))
        for d, i in kinds.items():
            rows[i, [index[f] for f in d]] = 1
        self.chain = crf.fit(rows, crf.pad(chains), crf.pad(labels), 2, rounds=120)
        self.weight = dict(zip(names, self.chain.weights, strict=True))
        self.memo: dict[tuple, np.ndarray] = {}

    @staticmethod
    def describe(block) -> tuple[str, ...]:
        above, text, linked = block
        return above + text_features(text, linked)

    def emission(self, block) -> np.ndarray:
        d = self.describe(block)
        got = self.memo.get(d)
        if got is None:
            got = sum((self.weight[f] for f in d if f in self.weight), np.zeros(2))
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[d] = got
        return got

    def texts(self, pages: list[str | None]) -> list[str]:
        """Main text of each page."""
        cut = [blocks(p) for p in pages]
        lengths = np.fromiter(map(len, cut), np.int64, len(cut))
        if not lengths.sum():
            return [""] * len(pages)
        em = np.array([self.emission(b) for own in cut for b in own])
        starts = np.cumsum(lengths) - lengths
        y = crf.decode(em, starts, lengths, self.chain)
        return ["\n\n".join(b[1] for b, keep in zip(own, y[s:s + len(own)], strict=True) if keep) for own, s in zip(cut, starts, strict=True)]


def extract(pages: DataFrame, labelled: list[tuple[str, list[bool]]] | None = None, id_col: str = "page_id",
            html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: id, ``keep`` columns, text, n_chars (code points)."""
    extractor = Extractor(labelled_pages() if labelled is None else labelled)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts: list[str] = []
            for i in range(0, len(b), 500):
                texts += extractor.texts(b[html_col].iloc[i:i + 500].tolist())
            out = b[[id_col, *keep]].copy()
            out["text"] = texts
            out["n_chars"] = np.fromiter(map(len, texts), np.int64, len(texts))
            yield out

    kinds = dict(pages.dtypes)
    head = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *keep))
    return pages.select(id_col, *keep, html_col).mapInPandas(run, f"{head}, text string, n_chars bigint")
