"""Main text of web pages by scoring the element tree.

Paragraph-like blocks earn points for their length and commas and pass them to their ancestors, less the
further away; a container's points are discounted by its share of link text. The best container, raised to
the innermost article or main element around it, is kept with those siblings that score or read like content.

Scripts, styles, controls, menus, footers, asides and hidden elements are left out by tag, role and attribute.
Forms, headers and elements whose class or id has a word for something beside the text (adverts, comments,
notices and so on) are only suspected. One stays, as a wrapper, if every article, main element and headline of
the page is in it and there is an article, or if it holds most of the page's points; comments never do by that.

Defined results: null or empty html and pages without article text give an empty text; markup that is cut
off or badly nested is read as far as it goes; repeated rows get equal texts; an empty table no rows.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key ends an open element among the values.
ENDS = {t: frozenset(["p"]) for t in BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}}
ENDS |= {"li": frozenset(["p", "li"]), "dt": frozenset(["p", "dt", "dd"]), "dd": frozenset(["p", "dt", "dd"]), "tr": frozenset(["p", "td", "th", "tr"]), "td": frozenset(["p", "td", "th"]), "th": frozenset(["p", "td", "th"]), "option": frozenset(["option"])}
#: Elements that such an implied end does not reach beyond.
SCOPE = frozenset("table td th button caption html body article section div main ul ol dl blockquote".split())
DROPPED = frozenset("script style noscript template head title nav footer aside button select textarea iframe object embed svg canvas audio video dialog menu datalist label".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
UNLIKELY = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu menus modal nav navbar navigation navigations newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion related remark reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
#: Words of reader comments, which may be longer than the article.
COMMENTS = frozenset("comment comments commentlist disqus remark reply replies respond".split())
PARAGRAPHS = frozenset("p pre td th li dd dt blockquote h1 h2 h3 h4 h5 h6 figcaption".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "parent", "children", "points", "chars", "commas", "links", "dropped", "suspect", "mass", "heads", "articles", "kind", "within", "depth")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, suspect: str = "", kind: str | None = None):
        self.tag, self.parent, self.children, self.dropped, self.suspect = tag, parent, [], dropped, suspect
        self.kind = kind  # the class attribute
        self.within = tag in ("article", "main") or parent is not None and parent.within
        self.depth = 0 if parent is None else parent.depth + 1
        self.points, self.chars, self.commas, self.links = 0.0, 0, 0, 0
        self.mass, self.heads, self.articles = 0.0, 0, 0


def left_out(tag: str, attrs: dict[str, str | None]) -> bool:
    """Whether an element can hold no text of an article."""
    if tag in DROPPED:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    style = (attrs.get("style") or "").replace(" ", "").lower()
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        return True
    return (attrs.get("role") or "").lower() in ROLES


def suspicion(tag: str, attrs: dict[str, str | None], within_article: bool) -> str:
    """`comments`, `other` or nothing: what an element seems to hold instead of the article."""
    if tag == "form" or tag == "header" and not within_article:
        return "other"
    if not attrs or tag in ("html", "body", "main") or tag == "article" and not within_article:
        return ""
    words = {w.lower() for name in ("class", "id") for w in WORD.findall(attrs.get(name) or "")}
    if words & COMMENTS:
        return "comments"
    # The head of an article is part of it.
    return "other" if (words - {"header", "tags"} if within_article else words) & UNLIKELY else ""


class TreeBuilder(HTMLParser):
    """Builds the tree of what isn't dropped; text of dropped elements is left out.

    The open elements are kept in order and by tag, so that a tag takes no longer in deep markup.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", None)
        self.open, self.by_tag = [self.root], {}

    @property
    def at(self) -> Node:
        return self.open[-1]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ends = ENDS.get(tag)
        if ends:
            self.imply_end(tag, ends)
        above = self.at
        if tag in VOID:
            if tag in ("br", "hr") and not above.dropped:
                above.children.append("\n" if tag == "br" else Node(tag, above))
            return
        known = dict(attrs)
        node = Node(tag, above, above.dropped or left_out(tag, known), suspicion(tag, known, above.within), known.get("class"))
        if not node.dropped:
            above.children.append(node)
        self.open.append(node)
        self.by_tag.setdefault(tag, []).append(node)

    def close(self) -> None:
        super().close()
        self.end_from(1)

    def end_from(self, depth: int) -> None:
        """Ends the open elements of this depth and below."""
        while len(self.open) > depth:
            self.by_tag[self.open.pop().tag].pop()

    def innermost(self, tags: Iterable[str]) -> int:
        """The depth of the innermost open element of these tags, or 0."""
        return max((nodes[-1].depth for t in tags if (nodes := self.by_tag.get(t))), default=0)

    def imply_end(self, tag: str, ends: frozenset[str]) -> None:
        """Ends the outermost element that the start tag ends, of those within the innermost scope."""
        scope = self.innermost(["table"] if tag in ("td", "th", "tr") else SCOPE - ends)
        found = []
        for t in ends:
            nodes = self.by_tag.get(t, [])
            if nodes and nodes[-1].depth > scope:
                found.append(nodes[bisect.bisect_right(nodes, scope, key=lambda n: n.depth)].depth)
        if found:
            self.end_from(min(found))

    def handle_endtag(self, tag: str) -> None:
        if depth := self.innermost([tag]):
            self.end_from(depth)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if not self.at.dropped:
            self.at.children.append(data)


def nodes_in_order(root: Node) -> list[Node]:
    """Parents before children, in page order."""
    found, open_nodes = [], [root]
    while open_nodes:
        node = open_nodes.pop()
        found.append(node)
        open_nodes += [c for c in reversed(node.children) if isinstance(c, Node)]
    return found


def given(node: Node) -> float:
    """The points that a block gives for its text: of a paragraph all of it, of another block its own."""
    if node.tag in PARAGRAPHS:
        chars, commas = node.chars, node.commas
    elif node.tag in BLOCK:
        text = "".join(c for c in node.children if isinstance(c, str)).strip()
        chars, commas = len(text), text.count(",")
    else:
        return 0.0
    return (1 + commas + min(chars / 100, 3)) * (1 - link_density(node)) if chars else 0.0


def measure(nodes: list[Node]) -> None:
    """Fills what nodes hold: chars, commas, links, mass, headlines and articles."""
    for node in nodes:
        node.chars, node.commas, node.links, node.mass, node.heads, node.articles = 0, 0, 0, 0.0, 0, 0
    for node in reversed(nodes):
        own = [c for c in node.children if isinstance(c, str)]
        node.chars += sum(len(c.strip()) for c in own)
        node.commas += sum(c.count(",") for c in own)
        if node.tag == "a":
            node.links = node.chars
        node.mass += given(node)
        node.heads += node.tag in ("h1", "main")
        node.articles += node.tag == "article" and not node.suspect
        above = node.parent
        if above is not None:
            for name in ("chars", "commas", "links", "mass", "heads", "articles"):
                setattr(above, name, getattr(above, name) + getattr(node, name))


def without_suspects(root: Node) -> None:
    """Takes suspected elements out of the tree, from the outermost on, but those that hold the page's text."""
    nodes = nodes_in_order(root)
    if not any(n.suspect for n in nodes):
        return
    measure(nodes)
    open_nodes = [root]
    while open_nodes:
        node = open_nodes.pop()
        kept = []
        for c in node.children:
            if isinstance(c, Node):
                whole = c.heads == root.heads and c.articles == root.articles
                large = 2 * c.mass > root.mass and c.suspect != "comments"
                if c.suspect and not (whole and (root.articles or large)):
                    continue
                open_nodes.append(c)
            kept.append(c)
        node.children = kept


def score(root: Node) -> list[Node]:
    """Fills chars, commas, links and points of all nodes; returns the nodes in order."""
    nodes = nodes_in_order(root)
    measure(nodes)
    for node in reversed(nodes):
        points = given(node)
        if not points:
            continue
        # A block with text of its own is a container of it too.
        if node.tag not in PARAGRAPHS:
            node.points += points
        above, share = node.parent, 1.0
        for level in range(1, 6):
            if above is None or above.tag in ("#root", "html"):
                break
            above.points += points * share
            above, share = above.parent, 1 / (2 * level)
    return nodes


def link_density(node: Node) -> float:
    return node.links / node.chars if node.chars else 0.0


def final(node: Node) -> float:
    return node.points * (1 - link_density(node))


def chosen(root: Node) -> list[Node]:
    """The best container and the siblings kept with it, in page order."""
    nodes = score(root)
    best = max((n for n in nodes if n.tag not in ("#root", "html")), key=final, default=None)
    if best is None or best.points <= 0:
        return [root] if root.chars else []
    above = best
    while above is not None and above.tag not in ("article", "main"):
        above = above.parent
    best = above or best
    if best.tag == "body" or best.parent is None:
        return [best]
    least = max(1.0, 0.2 * final(best))
    kept = []
    for node in best.parent.children:
        if not isinstance(node, Node):
            continue
        density = link_density(node)
        paragraph = node.tag in PARAGRAPHS and node.chars and (density < 0.25 if node.chars > 80 else density == 0)
        if node is best or node.chars and (node.tag == best.tag == "article" or final(node) >= least and density < 0.5 or paragraph):
            kept.append(node)
    return with_short_siblings(best, kept)


def with_short_siblings(best: Node, kept: list[Node]) -> list[Node]:
    """The siblings kept, with blocks of the same article that are too short to score.

    These lie between two that are kept, or are of the best one's tag and class where others like it are kept.
    """
    alike = lambda n: (n.tag, n.kind) == (best.tag, best.kind)
    series = sum(alike(n) for n in kept) > 1
    siblings = [n for n in best.parent.children if isinstance(n, Node)]
    known = {id(n) for n in kept}
    places = [i for i, n in enumerate(siblings) if id(n) in known]
    text = lambda n: n.chars and link_density(n) < 0.5 and n.tag in BLOCK
    return [n for i, n in enumerate(siblings) if id(n) in known or text(n) and (places[0] < i < places[-1] or series and alike(n))]


def blocks(nodes: list[Node]) -> list[str]:
    """The texts of the blocks below, white space made single."""
    found, open_text = [], []

    def end() -> None:
        text = " ".join("".join(open_text).split())
        open_text.clear()
        if text:
            found.append(text)

    # None ends a block; a stack keeps deep nesting from recursion.
    todo: list[Node | str | None] = [x for n in reversed(nodes) for x in (None, n, None)]
    while todo:
        item = todo.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            open_text.append(item)
        else:
            edge = [None] if item.tag in BLOCK else []
            todo += [*edge, *reversed(item.children), *edge]
    end()
    return found


def main_text(html: str | None) -> str:
    """The article's blocks, joined by line feeds."""
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    without_suspects(builder.root)
    return "\n".join(blocks(chosen(builder.root)))


@F.pandas_udf(T.StringType())
def main_text_udf(html: pd.Series) -> pd.Series:
    return html.map(main_text, na_action=None)


def extract(html: Column) -> Column:
    return main_text_udf(html.cast("string"))


def text_table(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select("page_id", "url", extract(F.col("html")).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
