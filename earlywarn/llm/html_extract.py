"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of tags and words. Every word scores its weight (positive in running text) and every tag its weight (never above
``-EPSILON``); one linear scan finds the contiguous run with the largest sum, which is the content region. The weights are log-odds of a token
standing inside against outside the content, counted over the labelled pages: those whose markup itself names one ``<article>`` or
``<main>``. Without labelled pages the default weights hold.

Before the scan, subtrees that never belong to an article are taken out: scripts, styles, menus, footers, sidebars, forms and the elements
whose class, id or role names an advert, notice, comment list and the like. An element named so that holds the article or its heading stays.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by one newline in page order.

Defined cases: null or empty html gives empty text; a page without markup is one block; unclosed and stray tags are tolerated; a removed
element that is never closed only loses its tag; repeated rows are extracted alike; an empty table gives no rows; other columns pass through.

Plan: one narrow pass of Arrow batches to count tokens (a few hundred sums leave it) and one to extract. No text is shuffled.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPSILON = 0.02
#: Elements never part of an article.
REMOVED = frozenset("head title script style noscript template iframe object embed svg canvas math audio video nav footer aside form button select textarea option datalist dialog menu".split())
#: Words in class, id or role that name what surrounds an article.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer "
    "comment comments commentlist disqus replies respond notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended "
    "recommendations widget widgets toolbar pagination pager copyright legal disclaimer search contentinfo complementary form dialog skip outbrain taboola".split()
)
#: Elements that end a block.
BLOCKS = frozenset(
    "html body main article section header div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre hr address figure figcaption details summary fieldset center hgroup".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe")
#: A tag whose weight was never counted, and the classic weights of words and tags when no page is labelled.
UNSEEN = -0.2
#: The weight of a tag that only ever stands outside.
CERTAIN = -30.0
DEFAULT = {"word": 1.0, "word:a": 0.3, "word:li": 0.6} | {t: -0.1 for t in ("p", "/p", "br", "h1", "/h1", "h2", "/h2", "h3", "/h3", "b", "/b", "i", "/i", "em", "/em", "strong", "/strong", "blockquote", "/blockquote", "span", "/span", "ul", "/ul", "ol", "/ol", "li", "/li")} | {t: -30.0 for t in ("html", "/html", "body", "/body", "article", "/article", "main", "/main")} | {f"!{t}": -0.1 for t in ("div", "script", "style", "aside", "form", "section", "p", "ul", "span")}

#: Attribute values are quoted, or run to the next blank or bracket and may hold quotes.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"'=]|=\s*+[^\s<>\"'][^\s<>]*+|=|\"[^\"]*\"|'[^']*')*+)>", re.S)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
WORD = re.compile(r"\S+")


def _named(attributes: str) -> bool:
    if not attributes:
        return False
    if HIDDEN.search(attributes):
        return True
    return any(p.lower() in NAMED for m in NAMES.finditer(attributes) for p in PIECES.findall(m[1] or m[2] or m[3] or ""))


def tokens(page: str) -> list[tuple[str, str]]:
    """``("", text)`` and ``(name, attributes)`` or ``("/name", "")`` in page order; contents of raw elements are left out."""
    out, at, n = [], 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            out.append(("", page[at:]))
            break
        if m.start() > at:
            out.append(("", page[at : m.start()]))
        at = m.end()
        if m[2]:
            name = m[2].lower()
            out.append((m[1] + name, "" if m[1] else m[3]))
            if not m[1] and name in RAW:
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                    out.append(("/" + name, ""))
    return out


def _closings(toks: list[tuple[str, str]]) -> dict[int, int]:
    """The place of the closing tag of each element that has one, by the place of its opening tag."""
    opened: dict[str, list[int]] = {}
    out = {}
    for k, (name, _) in enumerate(toks):
        if name.startswith("/"):
            if opened.get(name[1:]):
                out[opened[name[1:]].pop()] = k
        elif name:
            opened.setdefault(name, []).append(k)
    return out


def cleaned(page: str) -> list[tuple[str, str]]:
    """The tokens without the subtrees that surround an article."""
    toks, out, at, inside = tokens(page), [], 0, 0
    closing = _closings(toks)
    while at < len(toks):
        name, attributes = toks[at]
        if name in ("article", "main"):
            inside += 1
        elif name in ("/article", "/main"):
            inside = max(0, inside - 1)
        if name and name[0] != "/" and name not in ("html", "body", "main", "article"):
            always = name in REMOVED
            if (always or name == "header" or _named(attributes)) and name not in VOID:
                end = closing.get(at, -1)
                held = {t for t, _ in toks[at : end + 1]} if end >= 0 else set()
                keep = (not always and bool(held & {"article", "main", "h1"}) and (inside > 0 or bool(held & {"article", "main"}))) or (always and bool(held & {"article", "main"}))
                if end >= 0 and not keep:
                    out.append(("!" + name, ""))
                    at = end + 1
                    continue
                if end < 0 and always:
                    at += 1
                    continue
        out.append((name, attributes))
        at += 1
    return out


def sequence(page: str) -> list[tuple[str, str]]:
    """``(kind, text)`` of every token: kind is the tag, or ``word``, ``word:a``, ``word:li`` for a run of text."""
    out, link, item = [], 0, 0
    for name, text in cleaned(page):
        if name:
            if name == "a":
                link += 1
            elif name == "/a":
                link = max(0, link - 1)
            elif name == "li":
                item = 1
            elif name in ("/li", "/ul", "/ol", "p", "h1"):
                item = 0
            out.append((name, ""))
        elif text:
            out.append(("word:a" if link else "word:li" if item else "word", text))
    return out


def labelled_counts(page: str) -> tuple[Counter, Counter]:
    """Tokens inside and outside the content of a page that names it; two empty counters for other pages."""
    seq = sequence(page)
    for mark in ("article", "main"):
        at = [k for k, (t, _) in enumerate(seq) if t == mark]
        end = [k for k, (t, _) in enumerate(seq) if t == "/" + mark]
        if len(at) == 1 and len(end) == 1 and end[0] > at[0]:
            inner, outer = Counter(), Counter()
            for k, (t, text) in enumerate(seq):
                (inner if at[0] < k < end[0] else outer)[t] += len(WORD.findall(text)) if t.startswith("word") else 1
            return inner, outer
    return Counter(), Counter()


def weights_from(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log-odds of each kind of token; words may be positive, tags stay below 0."""
    inside = sum(a for a, _ in counts.values())
    outside = sum(b for _, b in counts.values())
    if not inside or not outside:
        return dict(DEFAULT)
    out = {}
    for t, (a, b) in counts.items():
        w = math.log((a + 0.5) / (inside + 1)) - math.log((b + 0.5) / (outside + 1))
        # a tag that only ever stands outside ends a region for certain; the words of a page are many, so their weight is capped
        out[t] = min(w, 1.0) if t.startswith("word") else min(-EPSILON, w) if a or b < 20 else CERTAIN
        if t.startswith("!"):
            out[t] = max(out[t], -0.3)  # what was taken out can also stand in the midst of an article
    out["word"] = max(out.get("word", 0.0), 0.25)
    # lists and links are rare in some tables; where none was labelled they count as weaker words
    for t in ("word:a", "word:li"):
        if not counts.get(t, (0, 0))[0]:
            out[t] = DEFAULT[t] * out["word"]
    return out


def best_region(seq: list[tuple[str, str]], weights: dict[str, float]) -> tuple[int, int]:
    """The run [start, end) of tokens with the largest sum; the longest of equal ones."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for k, (t, text) in enumerate(seq):
        total += weights.get(t, 0.0) * len(WORD.findall(text)) if t.startswith("word") else weights.get(t, UNSEEN if t.lstrip("/!") in BLOCKS else -EPSILON)
        if total >= best and total > 0:
            best, span = total, (start, k + 1)
        if total < 0:
            total, start = 0.0, k + 1
    return span


def _whole_article(seq: list[tuple[str, str]], lo: int, hi: int) -> tuple[int, int]:
    """A region inside an ``<article>`` or ``<main>`` grows to all of it: short ends score little but belong to it."""
    for mark in ("article", "main"):
        a = lo
        while a > 0 and seq[a - 1][0] not in (mark, "/" + mark):
            a -= 1
        if hi > lo and a > 0 and seq[a - 1][0] == mark:
            b = hi
            while b < len(seq) and seq[b][0] not in (mark, "/" + mark):
                b += 1
            return a, b
    return lo, hi


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of one page."""
    if not page:
        return ""
    seq = sequence(page)
    lo, hi = _whole_article(seq, *best_region(seq, weights))
    blocks, now = [], []
    for t, text in seq[lo:hi]:
        name = t.lstrip("/!")
        if t.startswith("word"):
            now.append(html.unescape(text))
        elif name in BLOCKS or (t[0] == "!" and name not in ("button", "select", "svg", "script", "style")):
            blocks.append("".join(now))
            now = []
        elif name == "br":
            now.append(" ")
    blocks.append("".join(now))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def learn_weights(pages: DataFrame, page_html: str = "html") -> dict[str, float]:
    """Weights from all labelled pages of a table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, outer = Counter(), Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                if page:
                    a, b = labelled_counts(page)
                    inner.update(a)
                    outer.update(b)
        keys = [k for k in {*inner, *outer} if k.lstrip("/!") in BLOCKS | REMOVED | VOID or k.startswith("word") or len(k) <= 8]
        yield pa.RecordBatch.from_pydict({"kind": pa.array(keys, pa.string()), "inside": pa.array([inner[k] for k in keys], pa.int64()), "outside": pa.array([outer[k] for k in keys], pa.int64())})

    sums = pages.select(F.col(page_html).alias("html")).mapInArrow(count, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("a"), F.sum("outside").alias("b"))
    # a few hundred kinds of tags exist; the rarest beyond 2000 get the weight of unseen ones
    return weights_from({r.kind: (r.a, r.b) for r in sums.orderBy(F.desc(F.col("a") + F.col("b")), "kind").limit(2000).collect()})


def extract_text(pages: DataFrame, page_html: str = "html", weights: dict[str, float] | None = None, out: str = "main_text") -> DataFrame:
    """``pages`` with the main text of each as a last column."""
    weights = learn_weights(pages, page_html) if weights is None else weights
    names = [f"c{i}" for i in range(len(pages.columns))]
    at = pages.columns.index(page_html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([extract(p, weights) for p in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text], names=[*names, "_text"])

    schema = ", ".join(f"{n} {t}" for n, (_, t) in zip(names, pages.dtypes, strict=True)) + ", _text string"
    got = pages.toDF(*names).mapInArrow(run, schema)
    return got.select(*(F.col(n).alias(c) for n, c in zip(names, pages.columns, strict=True)), F.col("_text").alias(out))
