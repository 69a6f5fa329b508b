"""HTML extraction by tree scoring.

Paragraphs pass points for length and commas to their ancestors, discounted by link density; the best container and
its siblings of like score are kept. Names of classes and ids weigh: they take away a node only where all of a name says
frame (social-links, not social-studies), and not where its own paragraphs score as the article's do and no frame is
named more strongly. A form that holds most of the page's text is the page, other forms go; "related" parts inside an article
stay where they are plain paragraphs. Formulas (MathML) are text, their annotations are not. Of several articles side by side
the best one is the page's. One pass in Python over each page, linear in its length, no shuffle.

Null or empty html gives an empty text; a page without article text gives an empty text; broken markup is read as a
browser would read it (unclosed tags end with their parent, an unclosed comment or script runs to the end). Extra
columns are not read. Equal pages are equal results; ties of score go to the container that begins first.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

# Fixed values of HTML: elements without end tags, with raw text, and those that break a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea iframe svg annotation annotation-xml object audio video canvas xmp noembed noframes title select".split()
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option legend".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption option legend html body".split())
#: A start tag of the key ends an open element of the value, unless one of STOPS is between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
STOPS = frozenset("ul ol dl menu table div section article".split())
DROPPED = frozenset("nav footer aside button dialog menu head fieldset input label".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: Words of class names and ids that mean a page's frame, those that mean no part of an article even inside one, words that
#: say nothing beside them, and those that mean an article.
FRAME = frozenset("banner breadcrumb breadcrumbs cookie cookies consent gdpr footer footnav masthead menu menus nav navbar navigation navbox newsletter notice notices pagination pager popup modal overlay share sharing shoutbox sidebar sidebars skyscraper social subscribe subscription tags toolbar topbar widget widgets login signup search alert disclaimer copyright legal rail".split())
NEVER = frozenset("ad ads advert adverts advertisement advertisements advertorial adsense adbox adslot comment comments commentlist respond disqus reply replies related recommended promo promos promoted promotion sponsor sponsors sponsored teaser teasers".split())
NEUTRAL = frozenset("a all and area bar big block body bottom box btn button buttons by center column container content cta empty fixed form foot global group head header heading holder icons image inline inner item items label large left line link links list main message mobile module note of off on outer page panel post posts primary reader readers right row secondary section set site size small stack sticky sub text the title to top up user wrap wrapper your".split())
WORDS = re.compile(r"[a-z]+", re.I)
#: Names that a part of an article may have too: inside one, links or brevity must agree.
DOUBTFUL = frozenset("related recommended".split())
#: Why a node is left out: by its name only, which an article inside it can outweigh; as a form, which most of the page's text
#: inside it can; by a doubtful name, which plain paragraphs can; or for good.
BY_NAME, FOR_GOOD, AS_FORM, IN_DOUBT = 1, 2, 3, 4
#: Share of links and characters of a part of an article that has a doubtful name.
DOUBT_LINKS, DOUBT_CHARS = 0.2, 120
GOOD = frozenset("article body content entry main page post text story blog hentry".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 figcaption".split())
CONTAINERS = frozenset("html article main body div section td blockquote center".split())

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "score", "weight", "dropped", "chars", "linked", "order", "commas", "inside")

    def __init__(self, tag: str, parent: "Node | None", order: int):
        self.tag, self.parent, self.order = tag, parent, order
        self.children: list[Node | str] = []
        self.score, self.weight, self.dropped = 0.0, 0.0, 0
        self.chars = self.linked = self.commas = 0
        #: Whether an article or main is around it.
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))


def named(names: str, kind: frozenset[str]) -> bool:
    """Whether a name (a class or an id) has a word of that kind and none of another meaning."""
    for name in names.split():
        words = [w.lower() for w in WORDS.findall(name)]
        if any(w in kind for w in words) and all(w in FRAME or w in NEVER or w in NEUTRAL for w in words):
            return True
    return False


def _weigh(node: Node, attrs: str) -> None:
    """Sets what tag, class, id and role say of a node."""
    tag = node.tag
    node.dropped = FOR_GOOD if tag in DROPPED or tag == "header" and not node.inside else AS_FORM if tag == "form" else 0
    if tag in ("article", "main"):
        node.weight = 25.0
    if attrs:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
        names = f"{found.get('class', '')} {found.get('id', '')}"
        if found.get("role", "").lower() in DROPPED_ROLES or HIDDEN.search(found.get("style", "")) or found.get("aria-hidden", "").lower() == "true" or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", ATTR.sub(" ", attrs)):
            node.dropped = FOR_GOOD
        if tag not in ("html", "body", "main", "a"):
            if named(names, NEVER):
                doubtful = node.inside and tag in ("section", "div") and not named(names, NEVER - DOUBTFUL)
                node.dropped = FOR_GOOD if node.dropped == AS_FORM or not doubtful else node.dropped or IN_DOUBT
            elif tag != "article" and named(names, FRAME):
                node.dropped = node.dropped or BY_NAME
            node.weight += 25.0 if any(w.lower() in GOOD for w in WORDS.findall(names)) else 0.0
        if found.get("role", "").lower() in ("main", "article"):
            node.weight += 25.0


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root and all nodes in page order."""
    root = Node("html", None, 0)
    nodes, top, at = [root], root, 0
    open_tags: dict[str, int] = {}

    def close(until: Node) -> Node:
        node = top
        while node is not until:
            open_tags[node.tag] -= 1
            node = node.parent
        open_tags[until.tag] -= 1
        return until.parent

    for m in TOKEN.finditer(page):
        if m.start() > at:
            top.children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None or m["tag2"] and page[m.end() - 1] != ">":
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if open_tags.get(tag):
                node = top
                while node.tag != tag:
                    node = node.parent
                if node is not root:
                    top = close(node)
            elif tag == "p":
                top.children.append(" ")
            continue
        if tag in ("html", "body") and (tag == "html" or open_tags.get("body")):
            continue
        if tag in VOID:
            top.children.append(" " if tag in ("br", "hr") else "")
            continue
        ends = ("p",) if tag in CLOSES_P and open_tags.get("p") else ENDS.get(tag, ())
        if any(open_tags.get(x) for x in ends):
            node, stops = top, frozenset(("table", "td", "div", "article", "section", "li", "blockquote")) if ends == ("p",) else STOPS - {tag}
            while node is not root and node.tag not in ends and node.tag not in stops:
                node = node.parent
            if node.tag in ends:
                outer = node
                while ends[0] != "p" and outer.parent is not None and outer.parent.tag in ends:
                    outer = outer.parent
                top = close(outer)
        node = Node(tag, top, len(nodes))
        _weigh(node, m["attrs"] or m["attrs2"] or "")
        top.children.append(node)
        nodes.append(node)
        if not (m["attrs"] or m["attrs2"] or "").rstrip().endswith("/") or tag in BLOCK or tag in ("a", "b", "i", "em", "span", "strong"):
            open_tags[tag] = open_tags.get(tag, 0) + 1
            top = node
    if at < len(page):
        top.children.append(html.unescape(page[at:]))
    return root, nodes


def outweigh(root: Node, nodes: list[Node]) -> None:
    """Takes back what forms and doubtful names say where the text inside says otherwise: a form around most of the page's
    text is the page, a part of an article with plain paragraphs is text."""
    if not any(n.dropped in (AS_FORM, IN_DOUBT) for n in nodes):
        return
    chars, linked, plain = ([0] * len(nodes) for _ in range(3))
    for n in reversed(nodes):
        chars[n.order] += sum(len(x.strip()) for x in n.children if isinstance(x, str))
        if n.tag == "a":
            linked[n.order] = chars[n.order]
        plain[n.order] += n.tag == "p"
        if n.parent is not None and n.dropped not in (BY_NAME, FOR_GOOD):
            for held in (chars, linked, plain):
                held[n.parent.order] += held[n.order]
    for n in nodes:
        k = n.order
        if n.dropped == AS_FORM and plain[k] and 2 * chars[k] > chars[root.order]:
            n.dropped = 0
        elif n.dropped == IN_DOUBT:
            n.dropped = 0 if plain[k] and chars[k] >= DOUBT_CHARS and linked[k] <= DOUBT_LINKS * chars[k] else FOR_GOOD


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root, nodes = parse(page)
    outweigh(root, nodes)
    cleared: set[int] = set()
    for n in nodes:
        if n.tag in ("article", "main") and not n.dropped:
            up = n.parent
            while up is not None and up.dropped != FOR_GOOD and up.order not in cleared:  # a page's frame may be named after its sidebar
                cleared.add(up.order)
                up.dropped, up = 0, up.parent
    for n in nodes:  # parents come first
        n.dropped = n.dropped or (n.parent.dropped if n.parent is not None else 0)
    for n in reversed(nodes):
        if n.dropped:
            continue
        for x in n.children:
            if isinstance(x, str):
                n.chars += len(x.strip())
                n.commas += x.count(",")
            elif not x.dropped:
                n.chars += x.chars
                n.linked += x.linked
                n.commas += x.commas
        if n.tag == "a":
            n.linked = n.chars
    for n in nodes:
        if n.dropped or not n.chars:
            continue
        own = n.tag in PARAGRAPHS or n.tag in CONTAINERS and any(isinstance(x, str) and x.strip() for x in n.children)
        if own:
            points = (1 + n.commas + min(n.chars / 100, 3)) * (1 - n.linked / n.chars)
            up, share, level = (n if n.tag in CONTAINERS else n.parent), 1.0, 0
            while up is not None and level < 4:
                up.score += points * share
                up, level = up.parent, level + 1
                share = 0.5 if level == 1 else 1 / (3 * level)
    best = None
    for n in nodes:
        if n.dropped or not n.chars or n.score <= 0 or n.tag in PARAGRAPHS - {"td", "blockquote"}:
            continue
        n.score = (n.score + n.weight) * (1 - n.linked / n.chars)
        if best is None or n.score > best.score:
            best = n
    if best is None:
        return ""
    up = best
    while up is not None:  # the whole article, where the page marks one
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    kept = [best]
    if best.parent is not None and best.tag not in ("main", "body", "html"):
        kept = []
        for x in best.parent.children:
            if x is best:
                kept.append(x)
            elif isinstance(x, Node) and not x.dropped and x.chars and best.tag != "article":
                density = x.linked / x.chars
                if x.score >= max(min(10, 0.5 * best.score), 0.2 * best.score) or density < 0.25 and x.tag in PARAGRAPHS - {"li", "td"}:
                    kept.append(x)
    return " ".join("".join(_pieces(kept)).split())


def _pieces(kept: list[Node]) -> list[str]:
    out: list[str] = []
    for top in kept:
        stack: list[Node | str] = [top]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif not x.dropped:
                if x.tag in BLOCK:
                    out.append(" ")
                    stack.append(" ")
                stack.extend(reversed(x.children))
        out.append(" ")
    return out


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        for b in slices(batches, 500):
            out = [extract(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
