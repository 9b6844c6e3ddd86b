"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of elements and text nodes. Every node is content or not;
its potential comes from binary features (kind of tag, words of class and id,
length, share of link text, what its ancestors are), and a 2 x 2 table links
parent and child. Sum-product message passing, once upward and once downward,
gives every node's marginal; a block of text is kept if the mean marginal of its
text nodes, weighted by their characters, is at least one half.

Inside an article (``article``, or ``main`` on pages without one) other weights
hold than outside: what is short, linked or in lists is mostly navigation on the
page around it, but belongs to the article within. There, class words that
articles use themselves (``DOUBTFUL``) only weigh against blocks that are links.

Training: a bounded sample of pages that mark their article with an ``article``
element labels its own nodes (text inside it, outside of elements that are never
content, is content; an element is content if it holds content). Each is used
three times: as it is; with lists, tables, links and sections made of its own
words added to its article; and so extended with its sectioning tags, classes
and ids hidden, so the other features are learned too. The likelihood's gradient comes
from the same message passing; weights are pulled towards ``PRIOR``, which
carries what tag and class names mean and holds where the sample shows nothing
else.

Text: character references decoded, white space inside a block turned into one
space, blocks joined by a line feed in page order.

Defined cases: null html counts as empty; a page without content gives the empty
string; unclosed and stray tags are repaired as browsers do for paragraphs, list
items, table cells and the head; scripts and embedded media are left out up to
their end tag, without one only script, style and textarea reach to the page's
end; formulas keep their text; repeated rows get equal results; other columns are
ignored; an empty table, or one without labelled pages, uses the prior.
"""

from __future__ import annotations

import html as entities
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

TRAIN_PAGES, ROUNDS, STEP, RIDGE = 150, 40, 0.3, 0.02
LONGEST_TRAINING_PAGE = 200_000   # characters; the sample's size is bounded

# Tag classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title".split())
IN_HEAD = frozenset("html head base link meta title".split())     # other tags and text end the head
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr
ul""".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
          "th": {"tr", "table"}, "option": {"select"}}
KIND = {t: k for k, tags in {
    "main": "article main", "never": "nav footer aside form menu dialog button select",
    "header": "header", "text": "p blockquote pre dd figcaption", "head": "h1 h2 h3 h4 h5 h6",
    "list": "ul ol dl li dt table tbody thead tr td th", "group": "div section body html center details fieldset legend label",
    "link": "a"}.items() for t in tags.split()}
NEVER_WORDS = re.compile(
    r"(?<![a-z])(?:nav|navbar|navigation|menu|masthead|footer|sidebar|notice|cookies?|gdpr|banner|advert\w*|ads?|sponsor\w*|promo\w*|"
    r"share|sharing|comments?|repl(?:y|ies)|respond|breadcrumbs?|subscribe|newsletter|signup|login|popup|modal|overlay|toolbar|"
    r"pagination|pager)(?![a-z])")
# as above outside an article; inside, its own sections have such names
DOUBTFUL = re.compile(
    r"(?<![a-z])(?:header|side|aside|consent|social|discussion|related|recommend\w*|form|search|widget|copyright|tags|disclaimer|"
    r"legal|alert)(?![a-z])")
MAIN_WORDS = re.compile(r"(?<![a-z])(?:article|content|post|entry|story|main|body|text)(?![a-z])")

TO_END = frozenset("script style textarea".split())      # without an end tag, up to the page's end
LEFT_OUT = TO_END | frozenset("noscript template svg iframe canvas object audio video annotation annotation-xml".split())
_tag = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    rf"|<({'|'.join(sorted(LEFT_OUT, reverse=True))})(?=[\s/>])[^>]*>|<[!?/][^>]*>", re.S | re.I)
_ends = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in LEFT_OUT}
_title = re.compile(r"(?:[^<]++|<(?!/?(?:head|body|title|html)[\s/>]))*+</title\s*>", re.I)
_closed = re.compile(r"(?:^|[\s\"']|(?:^|\s)[^\s=\"']+)/$")   # not the end of an unquoted value
_name = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_camel = re.compile(r"([a-z])([A-Z])")

FEATURES = [f"{kind} {what}" for kind in ("text", "element") for what in (
    "any", "main", "never", "header", "text", "head", "list", "group", "link", "other", "never words", "main words",
    "in never", "in main", "no links", "some links", "mostly links", "tiny", "short", "long", "very long", "sentence", "sign",
    "inside", "inside list", "inside group", "inside no links", "inside some links", "inside mostly links", "inside tiny",
    "inside short", "inside long", "inside very long", "inside doubtful", "inside doubtful links")]
PLACE = {f: i for i, f in enumerate(FEATURES)}
PRIOR = np.zeros(len(FEATURES))
for _f, _w in {"text in never": -6.0, "element in never": -3.0, "element never": -4.0, "element never words": -3.0,
               "element header": -1.5, "element main": 2.0, "element main words": 0.5, "text in main": 1.0,
               "text mostly links": -1.5, "element mostly links": -1.0, "text text": 0.7, "text head": 0.5,
               "text sentence": 0.5, "text sign": -0.5, "text inside": 2.0, "element inside": 1.0,
               "text inside doubtful links": -6.0, "element inside doubtful links": -3.0}.items():
    PRIOR[PLACE[_f]] = _w
# log potentials of (parent, child) in the states not content, content
LINK_PRIOR = np.array([[1.0, -3.0], [-0.5, 0.5]])


class Page:
    """Nodes in page order: parent, tag ('' for text), names, block, text."""

    def __init__(self, source: str):
        self.parent, self.tag, self.names, self.block, self.text, self.linked = [-1], ["html"], [""], [0], [""], [False]
        stack, at, block = [0], 0, 0

        def pop_to(tags, scope):
            for i in range(len(stack) - 1, 0, -1):
                t = self.tag[stack[i]]
                if t in tags:
                    del stack[i:]
                    return
                if t in scope:
                    return

        def end_head():
            pop_to({"title"}, set())
            pop_to({"head"}, set())

        def add(tag, names, text):
            self.parent.append(stack[-1])
            self.tag.append(tag)
            self.names.append(names)
            self.block.append(block)
            self.text.append(text)
            self.linked.append(self.linked[stack[-1]] or tag == "a")

        unclosed, heads = set(), False
        while m := _tag.search(source, at):
            if m.start() > at:
                if heads and self.tag[stack[-1]] == "head" and source[at: m.start()].strip():
                    end_head()
                    heads = False
                add("", "", source[at: m.start()])
            at = m.end()
            tag = (m[2] or m[4] or "").lower()
            if not tag:
                continue
            closed = tag not in TO_END and not m[1] and m[3] and m[3][-1] == "/" and _closed.search(m[3])
            if closed and (tag in LEFT_OUT or tag == "math"):
                continue
            if tag in LEFT_OUT and not m[1]:
                end = None if tag in unclosed else _ends[tag].search(source, at)
                if end or tag in TO_END:
                    at = end.end() if end else len(source)
                    continue
                unclosed.add(tag)
            if heads and not m[1] and tag not in IN_HEAD:
                end_head()
                heads = False
            if tag == "br":
                add("", "", " ")
                continue
            if tag in BLOCKS:
                block += 1
            if m[1]:
                if tag in BLOCKS or tag not in VOID:
                    pop_to({tag}, set() if tag in BLOCKS else BLOCKS)
                continue
            if tag in ("html", "head", "body") and (tag in self.tag or tag == "head" and "body" in self.tag):
                continue
            if tag in BLOCKS:
                pop_to({"p"}, BLOCKS - {"p"})
            if tag in CLOSES:
                pop_to(CLOSES[tag], SCOPES[tag])
            names = " ".join(x.strip("\"'") for x in _name.findall(m[3])) if m[3] else ""
            add(tag, _camel.sub(r"\1 \2", names).lower().replace("_", " "), "")
            if tag not in VOID:
                stack.append(len(self.tag) - 1)
            if tag in HIDDEN:
                heads = True
            if tag == "title" and (end := _title.match(source, at)):    # its text has no tags
                add("", "", source[at: source.rindex("<", at, end.end())])
                stack.pop()
                at = end.end()
        if at < len(source):
            if heads and self.tag[stack[-1]] == "head" and source[at:].strip():
                end_head()
            add("", "", source[at:])
        for i, t in enumerate(self.text):
            if t:
                self.text[i] = entities.unescape(t)

    def features(self, hide: bool = False):
        """Active features of every node; hide: sectioning tags and names unseen."""
        n = len(self.tag)
        size, links = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            if not self.tag[i]:
                size[i] = len(self.text[i].strip())
                links[i] = size[i] if self.linked[i] else 0
            if i:
                size[self.parent[i]] += size[i]
                links[self.parent[i]] += links[i]
        block_size, block_links = {}, {}
        for i in range(n):
            if not self.tag[i]:
                b = self.block[i]
                block_size[b] = block_size.get(b, 0) + size[i]
                block_links[b] = block_links.get(b, 0) + links[i]
        never, main, inside, doubt, out = [False] * n, [False] * n, [False] * n, [False] * n, []
        article = "article" if "article" in self.tag else "main"
        kinds = [KIND.get(t, "other") for t in self.tag]
        if hide:
            kinds = ["group" if k in ("main", "never", "header") else k for k in kinds]
        for i in range(n):
            up = self.parent[i]
            if i:
                never[i], main[i], inside[i], doubt[i] = never[up], main[up], inside[up], doubt[up]
            what = ["any"]
            if self.tag[i]:
                total, linked, names = size[i], links[i], "" if hide else self.names[i]
                kind = kinds[i]
                if kind == "header" and main[i]:
                    kind = "group"
                what.append(kind)
                bad, good = (bool(NEVER_WORDS.search(names)), bool(MAIN_WORDS.search(names))) if names else (False, False)
                if names and not bad and DOUBTFUL.search(names):
                    bad, doubt[i] = not inside[i], doubt[i] or inside[i]
                what += ["never words"] * bad + ["main words"] * (good and not bad)
                what += ["in never"] * never[i] + ["in main"] * main[i]
                if kind in ("never", "header") or bad and kind != "main" and self.tag[i] not in ("body", "html"):
                    never[i] = True
                if kind == "main":
                    main[i] = True
                    inside[i] = inside[i] or self.tag[i] == article
            else:
                b = self.block[i]
                total, linked = block_size[b], block_links[b]
                holder = up
                while holder and self.tag[holder] not in BLOCKS:
                    holder = self.parent[holder]
                text = self.text[i].rstrip()
                what.append(kinds[holder])
                what += ["in never"] * never[i] + ["in main"] * main[i]
                what += ["sentence"] * text.endswith((".", "!", "?", "…")) + ["sign"] * any(c in text for c in "©®|»")
            share = linked / total if total else 0
            links_ = "no links" if share == 0 else "some links" if share < 0.5 else "mostly links"
            length = "tiny" if total < 20 else "short" if total < 80 else "long" if total < 400 else "very long"
            if inside[i] and not never[i]:
                what = ["inside", f"inside {links_}", f"inside {length}",
                        *(f"inside {k}" for k in ("list", "group") if k in what),
                        *(["inside doubtful"] + ["inside doubtful links"] * (share >= 0.5)) * doubt[i]]
            else:
                what += [links_, length]
            prefix = "element " if self.tag[i] else "text "
            out.append([PLACE[prefix + w] for w in what])
        return out

    def labels(self):
        """Content or not of every node, where the page marks its article."""
        n = len(self.tag)
        inside, content = [False] * n, [False] * n
        for i in range(1, n):
            t, up = self.tag[i], self.parent[i]
            bad = KIND.get(t) == "never" or bool(self.names[i] and KIND.get(t) != "main" and NEVER_WORDS.search(self.names[i]))
            inside[i] = t == "article" or inside[up] and not bad
            if not t and inside[i] and self.text[i].strip():
                content[i] = True
        for i in range(n - 1, 0, -1):
            if content[i]:
                content[self.parent[i]] = True
        return content


def enriched(source: str) -> str:
    """The page, its article extended by blocks that articles may hold, of its own words."""
    start, end = source.lower().find("<article"), source.lower().rfind("</article")
    words = re.sub(r"<[^>]*>", " ", source[start:end]).split()[1:] if 0 <= start < end else []
    if len(words) < 20:
        return source
    one, some, many = words[0], " ".join(words[1:4]), " ".join(words[4:20])
    return (f"{source[:end]}<ul><li>{one}</li><li>{some}</li><li>{many}</li></ul><ol><li><a href=x>{some}</a></li><li>{one}</li></ol>"
            f"<table><tr><th>{one}</th><th>{one}</th></tr><tr><td>{some}</td><td>{one}</td></tr></table><p><a href=x>{many}</a></p>"
            f"<p>{one}</p><div>{some}</div><div class=legal><p>{some}</p></div><fieldset><legend>{one}</legend>{many}</fieldset>"
            f"<section class=related-work><h2>{one}</h2><p>{many}</p></section>{source[end:]}")


def sum_product(parent, local, links, pairs=None):
    """Marginal probability of content of every node. ``pairs`` (2 x 2) gets the
    expected counts of parent and child states."""
    n = len(parent)
    (a00, a01), (a10, a11) = np.exp(links).tolist()
    exp, log = math.exp, math.log
    up, message = list(local), [0.0] * n
    for i in range(n - 1, 0, -1):
        e = exp(min(max(up[i], -60.0), 60.0))
        message[i] = log((a10 + a11 * e) / (a00 + a01 * e))
        up[parent[i]] += message[i]
    belief = up
    for i in range(1, n):
        above = exp(min(max(belief[parent[i]] - message[i], -60.0), 60.0))
        if pairs is not None:
            e = exp(min(max(up[i], -60.0), 60.0))
            cells = (a00, a01 * e, above * a10, above * a11 * e)
            total = sum(cells)
            for k in range(4):
                pairs[k >> 1][k & 1] += cells[k] / total
        belief[i] = up[i] + log((a01 + a11 * above) / (a00 + a10 * above))
    return [1 / (1 + exp(min(max(-b, -60.0), 60.0))) for b in belief]


def fit(pages):
    """Weights and links from the sources of labelled pages."""
    weights, links = PRIOR.copy(), LINK_PRIOR.copy()
    data = []
    for source in pages:
        for text, hide in (source, False), (enriched(source), False), (enriched(source), True):
            page = Page(text)
            labels = np.array(page.labels(), float)
            active = page.features(hide)
            flat = np.array([f for x in active for f in x])
            data.append((page.parent, flat, np.repeat(np.arange(len(active)), [len(x) for x in active]), labels))
    if not data:
        return weights, links
    nodes = sum(len(p) for p, *_ in data)
    seen = np.zeros((2, 2))
    for parent, _, _, y in data:
        np.add.at(seen, (y[np.array(parent[1:], int)].astype(int), y[1:].astype(int)), 1)
    scale_w, scale_l = np.full(len(weights), 1e-8), np.full((2, 2), 1e-8)
    for _ in range(ROUNDS):
        g, pairs = -RIDGE * nodes * (weights - PRIOR), [[0.0, 0.0], [0.0, 0.0]]
        for parent, flat, owner, y in data:
            local = np.bincount(owner, weights[flat], len(y))
            marginal = np.array(sum_product(parent, local.tolist(), links, pairs))
            g += np.bincount(flat, (y - marginal)[owner], len(weights))
        gl = seen - np.array(pairs) - RIDGE * nodes * (links - LINK_PRIOR)
        scale_w += g * g
        scale_l += gl * gl
        weights += STEP * g / np.sqrt(scale_w)
        links += STEP * gl / np.sqrt(scale_l)
    return weights, links


def extract(source: str, weights, links) -> str:
    page = Page(source)
    w = weights.tolist()
    marginal = sum_product(page.parent, [sum([w[f] for f in x]) for x in page.features()], links)
    hidden = [False] * len(page.tag)
    blocks, mass = {}, {}
    for i in range(1, len(page.tag)):
        hidden[i] = hidden[page.parent[i]] or page.tag[i] in HIDDEN
        if not page.tag[i] and not hidden[i]:
            b, size = page.block[i], len(page.text[i].strip())
            blocks.setdefault(b, []).append(page.text[i])
            total, good = mass.get(b, (0, 0.0))
            mass[b] = total + size, good + size * marginal[i]
    out = []
    for b, parts in blocks.items():
        total, good = mass[b]
        if total and good >= 0.5 * total:
            text = " ".join("".join(parts).split())
            if text:
                out.append(text)
    return "\n".join(out)


def learn(pages: DataFrame, train_pages: int = TRAIN_PAGES):
    """Fit on a sample, by hash, of about ``train_pages`` pages with exactly one article element."""
    n, span = max(pages.count(), 1), 1_000_000_000
    chance = F.pmod(F.xxhash64(F.lit("pages"), F.col("page_id"), F.length("html")), F.lit(span))
    sample = pages.select("html", chance.alias("chance")).filter(
        (F.col("chance") < span * min(n, train_pages) // n) & (F.length("html") <= LONGEST_TRAINING_PAGE)
        & (F.size(F.split(F.lower("html"), "<article[ >]")) == 2)).collect()
    return fit([r["html"] for r in sorted(sample)])


def main_text(pages: DataFrame, model) -> DataFrame:
    """page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights, links = shared.value
        for batch in batches:
            texts = [extract(h, weights, links) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html") \
        .mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_tree_model_html(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, learn(pages))
