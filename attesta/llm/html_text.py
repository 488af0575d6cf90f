"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks at block-level tags. Each block has its words, its share of
words inside links, the same of its two neighbours, and what its ancestors say (a
menu-like, a comment-like or an article-like container). A CART tree, trained on the
small labelled table below, tells main text from the rest.

Defined cases: null html is empty; markup without main text gives an empty text with
0 characters; an unfinished tag at the end is dropped; unclosed elements end with the
page, but of a raw one (a button, say) that is self-closed or never closed only the tag is
dropped, scripts and styles excepted; repeated rows are extracted each; an empty table gives no rows. Only page_id,
url and html are read. The whole page is read, whatever its length.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import table

PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|<(?:/?[a-zA-Z][^>]*)\Z", re.S)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "select", "option", "button", "math", "object", "canvas"}
# Where a raw element stops; an option has no end tag of its own where another or the list's end follows.
STOP = {t: re.compile(rf"(?i)</{t}\b[^>]*(?:>|\Z)" + (r"|(?=<(?:option|optgroup)\b|</(?:select|datalist|optgroup)\b)" if t == "option" else "")) for t in RAW}
UNQUOTED = re.compile(r"=\s*[^\s\"'=]+$")
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q",
          "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
OUTER = {"nav", "footer", "aside", "form", "menu", "dialog", "head"}
HINT = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|cookies?|consent|copyright|disclaimer|footer|foot|form|header|masthead|menu|modal|nav\w*|newsletter|"
                  r"notice|notices|notification|alert|pagination|popup|promo\w*|related|recommend\w*|share|sharing|sidebar|side|social|sponsor\w*|subscribe|tags?|toolbar|widget|login|search|signup)(?:$|[\s_-])")
TALK = re.compile(r"(?i)(?:^|[\s_-])(?:comments?|commentlist|replies|reply|respond|discussion|disqus|reviews?|responses?|reader-comments)(?:$|[\s_-])")
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
ATTR = re.compile(r"(?i)\b(class|id|role|aria-label|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def blocks(source: str) -> list[tuple[str, int, int, int, int, int]]:
    """(text, words, linked words, menu-like, comment-like, article-like) of each block in page order."""
    out, stack, parts, links = [], [], [], []
    marks = {"a": 0, "outer": 0, "talk": 0, "main": 0}

    def close():
        text = re.sub(r"\s+", " ", entities.unescape("".join(parts))).strip()
        if text:
            out.append((text, len(text.split()), len(entities.unescape(" ".join(links)).split()), int(marks["outer"] > 0), int(marks["talk"] > 0), int(marks["main"] > 0)))
        parts.clear(), links.clear()

    def pop():
        for kind in stack.pop()[1]:
            marks[kind] -= 1

    at, endless = 0, set()
    while m := PIECE.search(source, at):
        if m.start() > at:
            parts.append(source[at:m.start()])
            if marks["a"]:
                links.append(source[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            close()
        elif tag == "br":
            parts.append(" ")
        if m[1]:
            if any(t == tag for t, _ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag in RAW:
            said = m[3].rstrip()
            alone = said.endswith("/") and not UNQUOTED.search(said) and tag not in {"script", "style"}
            rest = None if alone or tag in endless else STOP[tag].search(source, at)
            if rest:
                at = rest.end()
            elif tag in {"script", "style"}:
                at = len(source)
            elif not alone:
                endless.add(tag)
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            if tag in {"p", "li", "td", "tr", "dt", "dd", "option"} and any(t == tag for t, _ in stack[-3:]):
                while stack[-1][0] != tag:
                    pop()
                pop()
            said = {k.lower(): (x or y or z).strip() for k, x, y, z in ATTR.findall(m[3])}
            names = f"{said.get('class', '')} {said.get('id', '')} {said.get('aria-label', '')}"
            hidden = "hidden" in said or re.search(r"display\s*:\s*none", said.get("style", ""))
            kinds = ["a"] if tag == "a" else []
            inside = marks["main"] and tag in {"header", "h1", "h2", "h3"}
            if tag not in {"html", "body", "article", "main"}:
                if tag in OUTER or tag == "header" and not inside or hidden or said.get("role", "").lower() in ROLES or HINT.search(names):
                    kinds.append("outer")
            if TALK.search(names):
                kinds.append("talk")
            if tag in {"article", "main"} or said.get("role", "").lower() in {"main", "article"} or re.search(r"(?i)(?:^|[\s_-])(?:article|post|entry|story|content|main)(?:$|[\s_-])", names):
                kinds.append("main")
            for kind in kinds:
                marks[kind] += 1
            stack.append((tag, kinds))
    if at < len(source):
        parts.append(source[at:])
    close()
    return out


def features(found: list[tuple]) -> np.ndarray:
    """words, link density, the neighbours' words and link densities, the three container marks, page has an article."""
    words = np.array([b[1] for b in found], float)
    dense = np.minimum(1, np.array([b[2] for b in found]) / np.maximum(words, 1))
    before = lambda x: np.concatenate([[0.0], x[:-1]])
    after = lambda x: np.concatenate([x[1:], [0.0]])
    marks = np.array([b[3:] for b in found], float)
    return np.column_stack([words, dense, before(words), before(dense), after(words), after(dense), marks, np.full(len(found), marks[:, 2].any(), float)])


# The labelled table: made-up pages; blocks of data-y="1" elements are main text.
LABELLED = [
    '<body><nav><ul><li><a>Home</a></li><li><a>World news</a></li></ul></nav><article><h1 data-y>Rain</h1><p data-y>It rained for nine days and the river rose.</p><p data-y>Short.</p></article><footer>All rights kept.</footer></body>',
    '<body><header><h2>The Paper</h2></header><main><h1 data-y>Title of it</h1><p data-y>One two three four five six seven <a>eight nine</a> ten.</p><div class="ad">Buy two for one today and save a lot of money now.</div><p data-y>Last words.</p></main><aside><p>Most read this week by our readers everywhere.</p></aside></body>',
    '<body><div class="menu"><a>A</a> <a>B</a></div><div><p data-y>Plain prose without any article element is still the main text of the page, being long and free of links.</p><p data-y>A second paragraph of some ten words follows it here, and stands on its own.</p></div><div class="comments"><p>I liked reading this very much, thank you for writing it down.</p></div></body>',
    '<body><article><p data-y>Some text.</p><form><p>Your mail address here please</p></form><div class="notice">We use cookies on this site to make it better for you.</div><section class="comments"><p>First!</p><p>No, it is not so, as any reader of the text would know.</p></section></article><footer><p>Imprint and contact of the publisher and all of the staff.</p></footer></body>',
    '<body><ul><li><a>one</a></li><li><a>two</a></li><li><a>three four</a></li></ul><p data-y>Nothing but this long paragraph is worth keeping on the whole page, and it has twenty words or so.</p><p><a>next page</a></p><p>c 2001</p></body>',
    '<body><div class="cookie"><p>Cookies are used.</p></div><div id="content"><h1 data-y>Heading</h1><p data-y>Words of the story.</p><ul><li data-y>A point <a>made</a></li><li data-y><a>Linked point</a></li></ul></div><div class="sidebar"><p>Other stories that you may like to read after this one.</p></div></body>',
    '<body><article><h1 data-y>T</h1><p data-y><a>All of it is one link in an article</a></p><p data-y>x</p></article><div class="ad">y</div></body>',
]


def labelled() -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    for page in LABELLED:
        mark = "✓"
        found = blocks(re.sub(r"<(\w+) data-y>", lambda m: f"<{m[1]}>{mark}", page))
        ys += [b[0].startswith(mark) for b in found]
        xs.append(features(found))
    return np.vstack(xs), np.array(ys)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6):
    """A CART tree by Gini impurity: (feature, threshold, left, right), or a leaf's verdict."""
    if depth == 0 or y.all() or not y.any():
        return bool(y.mean() >= 0.5)
    best = None
    for f in [9, 8, 7, 6, 1, 0, 3, 5, 2, 4]:
        for t in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= t
            cost = sum(s.sum() * 2 * y[s].mean() * (1 - y[s].mean()) for s in (left, ~left))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, (t + x[x[:, f] > t, f].min()) / 2)
    if best is None:
        return bool(y.mean() >= 0.5)
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


def decide(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x), bool)
    out[left], out[~left] = decide(tree[2], x[left]), decide(tree[3], x[~left])
    return out


def main_text(source: str | None, tree) -> str:
    found = blocks(source or "")
    if not found:
        return ""
    return "\n".join(b[0] for b, keep in zip(found, decide(tree, features(found))) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks."""
    tree = grow(*labelled())

    def task(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [main_text(h, tree) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(task, "page_id long, url string, text string, n_chars long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
