"""Main text of web pages by consensus host paths.

1. One map parses every page, scores its containers and emits, for the page's
   host, a vote for the path of the best one: the chain of tag names with
   classes generalised (digits and hashes dropped), ids left out.
2. Votes are summed by (host, path) with map-side combination and each host's
   winning path is the one with the largest sum.  Hosts with a single page or a
   split vote still have a winner; the page's own best container is the
   fallback where the winning path is absent or holds less than half the unlinked
   text of that container (a page of another template).  An inner container is
   better than an outer one only if it sheds links or boilerplate.
3. Pages get their host's winner and are extracted again from the containers on
   the winning path.  Up to ``max_broadcast_bytes`` of counted winners these are
   broadcast and no page moves; beyond it the join is salted, so that a host with
   a third of all pages is spread over many tasks.

Parsing follows the HTML rules that matter here: raw text of script, style,
textarea and title, comments, void elements, implied ends of p, li, dt, dd,
option, tr, td and th, and end tags that match nothing.  Every class word is in a path.  Boilerplate parts
(menus, headers, footers, asides, forms, notices, adverts, reader comments, by
tag, role or class word) are left out wherever they stand, except headers within
an article that hold its heading.  A class or id counts as a word of boilerplate
only if it holds nothing else (``sidebar``, ``cookie-banner``, ``ad-1``) but words for a
place on the site (``site-footer``, ``left-nav``; ``site-header``) or for a kind of part
(``comment-list``, ``cookieConsent``, ``share-buttons``); other compounds
such as ``share-price`` or ``with-sidebar`` stay in the text and only count against
a container.  Neither applies to an element that holds the page's article or main,
or most of its unlinked text.  Inside an article a word that articles use as well
(``menu``, ``notice``, ``related``, ``reply``) counts only with evidence: links make up half
of the element's text, or it holds controls of a form.  What a style attribute hides is
left out.

Defined results: null or empty html gives an empty text; character references
are decoded, white space inside a block (line breaks included) becomes one
space, blocks are joined by one newline in page order and nothing else is
dropped or capped.  A null or unparsable url counts as the host ''.  Ties go to
the smaller path (votes) and the inner container (scores); repeated rows are
extracted each for itself and vote each; an empty table gives no rows; pages of
any length or depth take time in proportion to their length.  Columns of the
input named text or n_chars are replaced, others are kept, the html goes.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.markup import ESCAPABLE_RAW, RAW_TEXT, VOID
from ..runtime import arrow_map, stash

#: Fixed values of the HTML standard: elements by their part in parsing.
RAW = RAW_TEXT | ESCAPABLE_RAW
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt html legend li optgroup option tbody td tfoot th thead tr".split())
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
#: Parts of a page that are never main text.
SKIP_TAGS = frozenset("nav footer aside form script style noscript template iframe svg button select textarea input object embed canvas audio video head menu dialog xmp noembed noframes".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner banners nav navbar navigation menu menus sidebar sidebars "
    "aside footer footers breadcrumb breadcrumbs comment comments disqus reply replies respond cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations toolbar pagination pager widget widgets masthead skip".split()
)
#: Words that say only where on the site a part of boilerplate is; with them a header is one too.
SITE_WORDS = frozenset("site global top bottom main page left right primary secondary".split())
SITE_HEADERS = frozenset("site global top".split())
#: Words that only say what kind of part a name means; with them a word of boilerplate still is one.
PART_WORDS = frozenset(
    "area bar block body box button buttons container content feed form group holder icons inner item items links list message outer panel part post posts section articles stories "
    "strip thread tools user users reader readers view wrap wrapper zone".split()
)
#: Words of boilerplate that are words of an article as well (a menu of dishes, a notice, a reply); inside an article they need evidence.
WEAK_WORDS = frozenset(
    "aside banner banners menu menus navigation notice notices overlay pager promo promos promotion related recommended recommendations reply replies respond share sharing skip social toolbar widget widgets login signup".split()
)
#: Words of readers' comments, which may well be longer than the text they follow.
READER_WORDS = frozenset("comment comments disqus reply replies respond".split())
_TAG = re.compile(
    r"<(?:(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(?:>|\Z)"
    r"|!--(?:-?>|.*?(?:--!?>|\Z))|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z))",
    re.S,
)
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[a-z]+")
#: A lower-case letter before an upper-case one, or one of these words before a part's name: a word ends there.
_GLUED = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PARTED = re.compile(r"\b(ads?|advert|comments?|cookies?|gdpr|consent|newsletter|share|sharing|related|sidebar|sponsor)(?=(?:area|bar|box|buttons?|container|list|links|panel|posts|section|wrap|wrapper)\b)")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!important\s*)?(?:;|$)", re.I)
_CONTROLS = frozenset("form input textarea select button".split())
_NO_ATTRIBUTES: dict[str, str] = {}
_NO_WORDS: frozenset[str] = frozenset()
_CONTAINERS = frozenset("article main section div td body".split())


class Node:
    """An element; ``parts`` holds texts and nodes in order.

    ``named`` tells what its class and id say: 2 boilerplate, 1 a compound with such a word, 0 nothing.
    """

    __slots__ = ("tag", "key", "parent", "parts", "skip", "depth", "named", "words", "in_article", "weak")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.parent, self.parts = tag, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.in_article = parent is not None and (parent.in_article or parent.tag in ("article", "main"))
        self.named, self.words, self.weak = 0, _NO_WORDS, False
        if not attributes:
            self.key, self.skip = tag, tag in SKIP_TAGS
            return
        words = sorted({w for w in _WORDS.findall(attributes.get("class", "").lower()) if len(w) > 1})
        self.key = tag + "".join("." + w for w in words)
        self.skip = (
            tag in SKIP_TAGS
            or attributes.get("role", "").lower() in SKIP_ROLES
            or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "style" in attributes and bool(_HIDDEN.search(attributes["style"]))
        )
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        names = _PARTED.sub(r"\1-", _GLUED.sub("-", names).lower())
        self.words = SKIP_WORDS.intersection(_WORDS.findall(names))
        if self.words and not self.skip and tag not in ("html", "body", "article", "main"):
            self.named = 1
        if not self.skip and tag not in ("html", "body", "article", "main") and (parts := [n for n in names.split() if _boilerplate(n)]):
            self.named, self.skip = 2, True
            self.weak = self.in_article and all(WEAK_WORDS.issuperset(_WORDS.findall(n)) for n in parts)

    def path(self) -> str:
        keys, node = [], self
        while node is not None:
            keys.append(node.key)
            node = node.parent
        return ">".join(reversed(keys))


class _Open:
    """The open elements, with the places of each tag, so that a look-up needs no walk."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {"html": [0]}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tags) -> int:
        """Place of the innermost open element with one of these tags, -1 if there is none."""
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=-1)

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all within."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()

    def imply_end(self, tags, stop) -> None:
        """Close the innermost of ``tags`` unless an element of ``stop`` lies within."""
        place = self.last(tags)
        if place > 0 and place > self.last(stop):
            self.cut(place)


def _boilerplate(name: str) -> bool:
    """Whether a class or id names a part of boilerplate and nothing else."""
    own = set(_WORDS.findall(name))
    kept = own - SITE_WORDS
    if kept & SKIP_WORDS:
        kept -= PART_WORDS
    return bool(kept) and kept <= SKIP_WORDS or kept == {"header"} and bool(own & SITE_HEADERS)


def _attributes(raw: str) -> dict[str, str]:
    if not raw or raw.isspace() or raw == "/":
        return _NO_ATTRIBUTES
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def parse(text: str) -> Node:
    """Tree of a page under a root element; never fails."""
    root = Node("html", {}, None)
    stack, named = _Open(root), False
    at, n = 0, len(text)
    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            stack.nodes[-1].parts.append(text[at:])
            break
        m = _TAG.match(text, lt) or _LOOSE_TAG.match(text, lt)
        if not m:
            stack.nodes[-1].parts.append(text[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            stack.nodes[-1].parts.append(text[at:lt])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if (place := stack.last((tag,))) > 0:
                stack.cut(place)
            continue
        if tag in ("html", "head", "body") and stack.last((tag,)) >= 0:
            continue
        if tag in CLOSES_P:
            stack.imply_end(("p",), ("button", "table", "td", "th"))
        if tag in IMPLIED_END:
            stack.imply_end(*IMPLIED_END[tag])
        node = Node(tag, _attributes(m[3]), stack.nodes[-1])
        node.parent.parts.append(node)
        named = named or node.named > 0
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(text, at)
            close = end.start() if end else n
            node.parts.append(text[at:close])
            at = n if not end else text.find(">", close) + 1 or n
        elif tag not in VOID and not m[3].rstrip().endswith("/") or tag in BLOCK - {"hr"}:
            stack.push(node)
    if named:
        _keep_holders(root)
    return root


def _keep_holders(root: Node) -> None:
    """Take the mark of boilerplate from named elements that hold the article or most of the unlinked text.

    A weakly named element inside an article loses it too, unless half of its text is
    links or it holds controls of a form.
    """
    order: list[Node] = []
    size: dict[int, int] = {}
    linked_size: dict[int, int] = {}
    controls: set[int] = set()
    pending: list[tuple[Node, bool]] = [(root, False)]
    while pending:
        node, linked = pending.pop()
        if node.skip and not node.named or node.tag == "title":
            continue
        order.append(node)
        linked = linked or node.tag == "a"
        text = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        size[id(node)], linked_size[id(node)] = (0, text) if linked else (text, 0)
        if any(isinstance(p, Node) and p.tag in _CONTROLS for p in node.parts):
            controls.add(id(node))
        pending.extend((p, linked) for p in node.parts if isinstance(p, Node))
    held: dict[int, int] = {}
    mains: set[int] = set()
    for node in reversed(order):
        own = id(node)
        if node.tag == "main":
            mains.add(own)
        if node.tag in ("article", "main") and not node.words:
            held[own] = max(held.get(own, 0), size[own])
        if node.parent is not None:
            up = id(node.parent)
            size[up] += size[own]
            linked_size[up] += linked_size[own]
            if own in controls:
                controls.add(up)
            held[up] = max(held.get(up, 0), held.get(own, 0))
            if own in mains:
                mains.add(up)
    whole = max(1, size[id(root)])
    outside, dropped = 0, set()
    for node in order:
        if node.skip or node.parent is not None and id(node.parent) in dropped:
            dropped.add(id(node))
        elif node.tag in ("article", "main"):
            outside = max(outside, size[id(node)])
    dropped.clear()
    for node in order:
        own = id(node)
        if node.parent is not None and id(node.parent) in dropped:
            dropped.add(own)
        elif node.named:
            article = held.get(own, 0)
            most = 2 * size[own] > whole and 5 * outside <= whole and (node.named == 1 or not node.words & READER_WORDS)
            prose = node.weak and size[own] > linked_size[own] and own not in controls
            if own in mains or 5 * article > whole and article >= outside or most or prose:
                node.named, node.skip = 0, False
            elif node.skip:
                dropped.add(own)


def _dropped(node: Node) -> bool:
    """Whether a part is boilerplate; a header counts as one unless it stands in an article."""
    return node.skip or node.tag == "header" and not node.in_article


def blocks(node: Node) -> list[str]:
    """Texts of the blocks under ``node``, without boilerplate."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if not run:
            return
        text = "".join(run)
        text = " ".join((entities.unescape(text) if "&" in text else text).split())
        run.clear()
        if text:
            out.append(text)

    pending: list[object] = list(reversed(node.parts))
    while pending:
        part = pending.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            run.append(part)
        elif part.tag == "br":
            run.append(" ")
        elif not _dropped(part) and part.tag != "title":
            if part.tag in BLOCK:
                flush()
                pending.append(None)
            pending.extend(reversed(part.parts))
    flush()
    return out


def score_containers(root: Node) -> tuple[list[tuple[float, Node]], dict[int, list[float]]]:
    """(score, container) from the best: text length that counts, less what stands in links; articles and mains count more.

    Equal scores mean equal texts, where the inner container is taken.  Also the [unlinked, linked] text of every kept node by its identity.
    """
    own: dict[int, list[float]] = {}
    order: list[Node] = []
    pending: list[tuple[Node, bool]] = [(root, False)]
    while pending:
        node, linked = pending.pop()
        if node is not root and (_dropped(node) or node.tag == "title"):
            continue
        order.append(node)
        linked = linked or node.tag == "a" or node.named == 1
        size = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        own[id(node)] = [0.0 if linked else size, size if linked else 0.0]
        pending.extend((p, linked) for p in node.parts if isinstance(p, Node))
    total = {k: list(v) for k, v in own.items()}
    for node in reversed(order):
        if node.parent is not None and id(node.parent) in total:
            for j in (0, 1):
                total[id(node.parent)][j] += total[id(node)][j]
    found = []
    whole = max(1.0, total[id(root)][0])
    for node in order:
        if node.tag in _CONTAINERS:
            text, links = total[id(node)]
            share = text / whole
            bonus = {"article": 0.5, "main": 0.4}.get(node.tag, 0.0) if share > 0.2 else 0.0
            found.append((share - links / max(1.0, text + links) + bonus, node))
    return sorted(found, key=lambda x: (-x[0], -x[1].depth)), total


def best_container(root: Node) -> Node:
    found, _ = score_containers(root)
    return found[0][1] if found and found[0][0] > 0 else root


def on_path(root: Node, path: str) -> list[Node]:
    """Outermost kept elements with this generalised path, in page order; boilerplate is no step of it."""
    keys = path.split(">")
    level = [root] if root.key == keys[0] else []
    for key in keys[1:]:
        level = [p for node in level for p in node.parts if isinstance(p, Node) and p.key == key and not _dropped(p)]
    return level


def extract(html: str | None, path: str | None) -> str:
    """Main text of one page from the winning path of its host, or from its own best container."""
    if not html:
        return ""
    root = parse(html)
    chosen = on_path(root, path) if path else []
    found, total = score_containers(root)
    best = found[0][1] if found and found[0][0] > 0 else root
    held = sum(total[id(node)][0] for node in chosen if id(node) in total)
    text = "\n".join(b for node in chosen for b in blocks(node)) if 2 * held >= total[id(best)][0] else ""
    return text or "\n".join(blocks(best))


def host(url: Column) -> Column:
    """Lower-cased host of a URL, empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path) with the most votes of the host's pages; ties go to the smaller path."""
    thin = pages.where(F.length(html_col) > 0).select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            votes: dict[tuple[str, str], float] = {}
            for own, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                found, _ = score_containers(parse(page))
                if found and found[0][0] > 0:
                    key = (own, found[0][1].path())
                    votes[key] = votes.get(key, 0.0) + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.string()), pa.array(list(votes.values()), pa.float64())], names=["host", "path", "votes"]
            )

        return step

    votes = arrow_map(thin, make, "host string, path string, votes double").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    return votes.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("host", "path")


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", max_broadcast_bytes: int = 32 << 20, salts: int = 64) -> DataFrame:
    """``pages`` with text (main text) and n_chars (its code points) in place of the html."""
    base = pages.drop("text", "n_chars", "_host", "_path", "_salt")
    winners = stash(winning_paths(base, url_col, html_col).select(F.col("host").alias("_host"), F.col("path").alias("_path")), "hosts")
    hosted = base.withColumn("_host", host(F.col(url_col)))
    size = winners.agg(F.sum(F.octet_length("_host") + F.octet_length("_path") + 32)).first()[0] or 0
    if size <= max_broadcast_bytes:
        joined = hosted.join(F.broadcast(winners), "_host", "left").drop("_host")
    else:
        salted = winners.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        hosted = hosted.withColumn("_salt", F.pmod(F.xxhash64(F.coalesce(url_col, F.lit("")), F.length(html_col)), F.lit(salts)))
        joined = hosted.join(salted, ["_host", "_salt"], "left").drop("_host", "_salt")
    kept = [f for f in base.schema.fields if f.name != html_col]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [extract(h, p) for h, p in zip(b.column(html_col).to_pylist(), b.column("_path").to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

        return step

    return arrow_map(joined, make, schema)
