"""Operator 7: main text of web pages from flat text blocks.

A page is read as a flat list of text blocks: runs of text between block tags.  A
block is described by its word count and link density and those of the blocks before
and after it, by the kind of container it stands in, and by a few signs.  A decision
tree, trained on a small table of labelled blocks, keeps the blocks of the article.
Nearly half of the labelled pages withhold the kind of container, so counts and densities decide
first and tags and whole names settle what they leave open.
"""

from __future__ import annotations

import html as references
import random
import re

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tree_share, walk_tree

THRESHOLD = 0.5

#: Comments and other marks, tags with quoted values, and the next plain "<".
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:\-]*)"
                   r"((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+))*+)>", re.S)
#: A name, then an optional value; a quote counts only right after the "=".
ATTRIBUTE = re.compile(r"""([^\s>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select",
          "head", "title"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
          "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
          "tt", "u", "var", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A new one of these ends an open one of the same list.
CLOSES = {t: {"p"} for t in ("p", "div", "ul", "ol", "table", "article", "section", "blockquote", "pre", "form", "nav",
                             "aside", "header", "footer", "main", *HEADINGS)} | {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
AROUND_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
ARTICLE_TAGS = {"article", "main"}
#: Words that name something around an article.  A name counts only as a whole: all its
#: parts are among these words or PLAIN_WORDS ("cookie-notice", not "side-effects").
AROUND_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice alert popup modal overlay sidebar side aside widget widgets menu nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager footer foot header masthead topbar toolbar comment comments discussion disqus respond reply replies "
    "reactions share sharing social related recommended recommendations newsletter subscribe subscription signup login "
    "hidden copyright contentinfo complementary".split())
ARTICLE_WORDS = frozenset("article post entry content story main body text prose".split())
PLAIN_WORDS = frozenset("area bar block box bottom col column container form group inner item items left links list outer "
                        "page panel right row section site slot top unit wrap wrapper".split())
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "container", "heading",
            "sentence_end", "copyright", "place")


def _whole_name(name: str) -> int:
    """-1 for the name of something around an article, 1 for that of an article, else 0."""
    parts = {w for w in re.split(r"[-_\d]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w}
    if parts & AROUND_WORDS:
        return -1 if parts <= AROUND_WORDS | PLAIN_WORDS | ARTICLE_WORDS else 0
    return 1 if parts & ARTICLE_WORDS and parts <= ARTICLE_WORDS | PLAIN_WORDS else 0


def _kind(tag: str, attributes: str, inside: int) -> int:
    """1 if a tag opens the article, -1 if it opens something around it, else 0."""
    named = set()
    if attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id", "role") and not (tag in HEADINGS and name == "id"):  # an anchor
                named.update(_whole_name(n) for n in value.split())
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return -1
    if tag in ("html", "body"):
        return 0
    if tag in ARTICLE_TAGS:
        return 1
    if named & {1, -1}:
        return -1 if -1 in named else 1
    if tag == "header" and inside > 0:  # of the article itself
        return 0
    return -1 if tag in AROUND_TAGS else 0


def blocks(page: str | None) -> list[dict]:
    """Text blocks of a page in order: text, words, linked words, container, heading."""
    out: list[dict] = []
    page = page or ""
    stack: list[tuple[str, int]] = []      # open tags, with the kind of their container
    text: list[str] = []
    linked: list[str] = []
    silent = links = 0

    def flush() -> None:
        if text:
            words = references.unescape("".join(text)).split()
            if words:
                out.append({"text": " ".join(words), "words": len(words),
                            "linked": len(references.unescape(" ".join(linked)).split()),
                            "container": next((k for _, k in reversed(stack) if k), 0),
                            "heading": any(t in HEADINGS for t, _ in stack)})
            text.clear()
            linked.clear()

    def close(at: int) -> None:
        nonlocal silent, links
        for tag, _ in stack[at:]:
            silent -= tag in SILENT
            links -= tag == "a"
        del stack[at:]

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        part = page[at:m.start() if m else len(page)]
        if part and not silent:
            text.append(part)
            if links:
                linked.append(part)
        if m is None:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            if not silent:
                flush()
        elif tag == "br" and not silent:
            text.append(" ")
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in ARTICLE_TAGS | {"div", "section", "body"} and tag in INLINE | {"p", "li"}:
                    break  # a stray end of something small doesn't end its container
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in ("body", "main", "article"):  # whatever was left open before
            for k, (open_, _) in enumerate(stack):
                if open_ == "head":
                    close(k)
                    break
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in CLOSES.get(tag, ()):
                close(k)
                break
            if stack[k][0] not in INLINE and stack[k][0] not in CLOSES.get(tag, ()):
                break
        if tag in ("script", "style", "textarea", "template", "title", "noscript", "iframe"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)  # nothing in there is a tag
            at = end.end() if end else len(page)
            continue
        inside = next((k for _, k in reversed(stack) if k), 0)
        stack.append((tag, _kind(tag, m[3], inside)))
        silent += tag in SILENT
        links += tag == "a"
    if not silent:
        flush()
    return out


def features(found: list[dict]) -> list[list[float]]:
    """The tree's view of each block of a page, in the order of FEATURES."""
    density = [min(1.0, b["linked"] / b["words"]) for b in found]
    none = (0.0, 1.0)
    rows = []
    for k, b in enumerate(found):
        before = (float(min(found[k - 1]["words"], 100)), density[k - 1]) if k else none
        after = (float(min(found[k + 1]["words"], 100)), density[k + 1]) if k + 1 < len(found) else none
        rows.append([float(min(b["words"], 100)), density[k], *before, *after, float(b["container"]), float(b["heading"]),
                     float(b["text"][-1] in ".!?\"'”»:"), float("©" in b["text"][:40] or "rights reserved" in b["text"].lower()),
                     k / len(found)])
    return rows


def template_page(r: random.Random, kind: str) -> tuple[str, list[int]]:
    """A made page and the label of each of its blocks (1: of the article).

    ``kind`` says what marks the article: "tags", "names" (whole class names), "none"
    (boxes without a name or with a made one) or "bare" (an article and nothing else)."""
    syllables = "an be ca der el fo ga hin in jo ka lu mer no or pi que ra sta ti un ver wo".split()
    labels: list[int] = []
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    run = lambda lo, hi: " ".join(word() for _ in range(r.randint(lo, hi)))
    sentences = lambda n, lo, hi: " ".join(run(lo, hi).capitalize() + "." for _ in range(n))
    link = lambda text: f'<a href="/{word()}">{text}</a>'
    marked = kind in ("tags", "names")     # only there can odd texts be told apart

    def block(tag: str, text: str, label: int) -> str:
        labels.append(label)
        return f"<{tag}>{text}</{tag}>"

    def box(tag: str, name: str, inner: str) -> str:
        if kind == "tags" and tag != "div":
            return f"<{tag}>{inner}</{tag}>"
        made = name if marked else r.choice(("", word(), f"{word()}-{word()}"))
        return f'<div class="{made}">{inner}</div>' if made else f"<div>{inner}</div>"

    def paragraph() -> str:
        odd = r.random()
        if marked and odd < 0.15:          # a link alone, or a word or two
            return block("p", link(run(1, 9)) if odd < 0.07 else run(1, 3), 1)
        if odd < 0.3:
            return block("p", f"{run(4, 30)} {link(run(1, 4))} {sentences(1, 4, 20)}", 1)
        if odd < 0.4:
            return block("h2", run(1, 6), 1)
        if odd < 0.5:
            return "<ul>" + "".join(block("li", run(2, 15), 1) for _ in range(r.randint(1, 4))) + "</ul>"
        return block("p", sentences(r.randint(1, 6), 2, 18), 1)

    def said(n: int) -> str:
        return "".join(block("p", sentences(r.randint(1, 4), 2, 16) if marked or r.random() < 0.3
                             else link(run(2, 12)), 0) for _ in range(n))

    def advert() -> str:
        return box("div", r.choice(("ad", "ads", "promo-box", "cookie-notice", "banner")), said(1))

    if kind == "bare":
        short = r.random() < 0.4
        return "".join(block("p", run(1, 8), 1) if short else paragraph() for _ in range(r.randint(1, 8))), labels
    page = [box("nav", "menu", "<ul>" + "".join(block("li", link(run(1, 2)), 0) for _ in range(r.randint(2, 8))) + "</ul>")]
    if r.random() < 0.4:
        page.append(box("header", "header", block("p", run(2, 9), 0)))
    page += [advert() for _ in range(r.randint(0, 2))]
    body = [block("h1", run(2, 20), 1)] if r.random() < 0.9 else []
    for _ in range(r.randint(0, 9)):
        body.append(advert() if marked and r.random() < 0.05 else paragraph())
    page.append(box("article", r.choice(("article", "content", "story-body")), "".join(body)))
    if r.random() < 0.5:
        page.append(box("aside", "sidebar", said(r.randint(1, 4))))
    if r.random() < 0.3:
        page.append(box("form", "newsletter-form", block("label", run(1, 4), 0) + block("p", run(3, 12), 0)))
    if marked and r.random() < 0.4:
        page.append(box("div", "comments", said(r.randint(1, 5))))
    page += [advert() for _ in range(r.randint(0, 1))]
    page.append(box("footer", "footer", block("p", f"&copy; {run(1, 5)}" if r.random() < 0.8 else run(2, 9), 0)))
    return f"<html><head><title>x</title></head><body>{''.join(page)}</body></html>", labels


#: Share of each kind of page: on most of them nothing but the texts and links tell.
KINDS = ("none",) * 6 + ("tags",) * 3 + ("names",) * 2 + ("bare",) * 2


def labelled_blocks(pages: int = 1040, seed: int = 9) -> list[tuple[list[float], int]]:
    """Labelled blocks of pages made from templates, the kinds of KINDS in turn: menus,
    notices, adverts, sidebars, forms, comments and footers around an article."""
    r = random.Random(seed)
    rows: list[tuple[list[float], int]] = []
    for k in range(pages):
        page, labels = template_page(r, KINDS[k % len(KINDS)])
        rows += zip(features(blocks(page)), labels, strict=True)
    return rows


def train(spark: SparkSession, rows: list | None = None, *, depth: int = 10) -> list:
    """The decision tree as a list of nodes, fitted on labelled blocks."""
    table = [(float(y), Vectors.dense(x)) for x, y in (labelled_blocks() if rows is None else rows)]
    frame = spark.createDataFrame(table, ["label", "features"]).coalesce(4)
    # a seed left out is Python's hash of the class name, another one in each process
    return walk_tree(DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=4, seed=0).fit(frame))


def main_text(page: str | None, tree: list, threshold: float = THRESHOLD) -> str:
    found = blocks(page)
    return "\n".join(b["text"] for b, x in zip(found, features(found)) if tree_share(tree, x) >= threshold)


def extract(pages: DataFrame, tree: list, *, page_id: str = "page_id", url: str = "url", html: str = "html",
            threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text, n_chars.

    Null and empty pages, and pages without an article, have an empty text; an empty
    table gives no rows, a very long page is read whole, in one pass.  Unclosed
    tags and comments, and a page that breaks off, are read as far as they go.  A line
    break inside a block counts as white space.  Rows that repeat are kept, other
    columns are not read."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (page_id, url)}

    def run(batches):
        for b in batches:
            texts = [main_text(v.as_py(), tree, threshold) for v in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(page_id), F.col(url), F.col(html)).mapInArrow(
        run, f"page_id {kinds[page_id]}, url {kinds[url]}, text string, n_chars long")
