"""Main text of pages by consensus host paths.

Each page's containers are scored by the text they hold outside links and boilerplate,
and the page votes for one of them by its generalised path of tags and classes. Votes
are counted by host in Spark. A page is then extracted again from the container with
its host's winning path, if that leaves out only little of its own choice or what the
host's pages leave beside their text; else its own choice counts.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gridtrend.llm.common import keep, small

TAG = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)/?>)""", re.S
)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Elements whose content is not page text and may hold anything up to their end.
RAW = {"script", "style", "textarea", "title", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CONTAINERS = {"html", "body", "main", "article", "section", "div", "table", "tbody", "tr", "td", "center", "form"}
BLOCKS = CONTAINERS | {
    "address", "aside", "blockquote", "caption", "dd", "details", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "legend", "li", "menu", "nav", "ol", "p", "pre",
    "summary", "tfoot", "th", "thead", "ul", "dialog", "noscript", "template",
}
#: A start tag that ends an open element of these names, if no block lies between.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
NOT_TEXT = {
    "nav", "footer", "aside", "noscript", "template", "iframe", "button", "select", "svg", "menu", "dialog",
    "object", "head", "canvas", "audio", "video", "map",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"}
#: Words of a class or id that mark boilerplate, and beginnings of such words.
MARKS = {
    "ad", "ads", "nav", "menu", "footer", "header", "masthead", "sidebar", "aside", "widget", "banner", "notice", "notices",
    "modal", "popup", "overlay", "share", "sharing", "social", "related", "recommended", "search", "login", "form",
    "pager", "pagination", "toolbar", "topbar", "respond", "replies", "reply", "promo", "legal", "copyright", "alert",
    "rail", "teaser", "tags", "signup", "toc", "skip",
}
STARTS = ("advert", "sponsor", "navig", "navbar", "breadcrumb", "cookie", "consent", "comment", "newsletter", "subscri",
          "promot", "disqus", "gdpr", "sidebar", "outbrain", "taboola")
#: Marks of parts that often hold more text than the article.
TALK = ("comment", "repl", "respond", "disqus", "cookie", "consent", "gdpr")
#: Words that say nothing beside a mark: a class or id is a mark if it has one and its
#: other words are of these.
PLAIN = {
    "a", "area", "bar", "block", "blocks", "body", "bottom", "box", "boxes", "btn", "button", "buttons", "column",
    "container", "content", "entry", "footer", "global", "group", "holder", "inner", "item", "items", "js", "left",
    "link", "links", "list", "main", "mobile", "module", "outer", "page", "panel", "post", "posts", "primary",
    "region", "right", "row", "secondary", "section", "site", "sticky", "text", "title", "top", "unit", "wrap",
    "wrapper", "wp", "us", "slot", "policy", "icons", "icon", "media", "articles", "stories", "message", "header",
}
#: Share of the text that a container holds for the vote to go down into it from the top
#: of the page, where what stands beside it in containers of their own is less than a
#: tenth and taken for noise; and from any other container, whose parts belong together.
DOWN, WITHIN = 0.9, 0.999
TOPS = {"", "html", "body"}
SHARE = 0.8
MOST = 0.5
NEVER = 2.0
WINNER = 0.2
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """A container. Its path is known by a hash of its parent's and its own step, so that
    a page of many thousand nested elements needs no more than that for each."""

    __slots__ = ("up", "path", "score", "tag", "children", "order")

    def __init__(self, up, step: str, tag: str, order: int):
        self.up, self.tag, self.score, self.children, self.order = up, tag, 0.0, [], order
        self.path = xxhash.xxh64_hexdigest(f"{up.path}>{step}") if up is not None else ""
        if up is not None:
            up.children.append(self)


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(text)} if text else {}


def boilerplate(tag: str, attrs: dict[str, str], in_article: bool) -> float:
    """Share of the page's unlinked text that the element must hold to stay: 0 if it is
    no boilerplate. A form or a marked element that holds most of it is a wrapper."""
    if tag in NOT_TEXT or (tag == "header" and not in_article):
        return NEVER
    least = MOST if tag == "form" else 0.0
    if not attrs:
        return least
    role = attrs.get("role", "").lower()
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or role in ROLES:
        return NEVER
    if tag in ("body", "html", "main", "article"):
        return MOST if role == "form" else 0.0
    marks = []
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w.lower() for w in WORD.findall(name)]
        if in_article and tag in ("header", "h1", "h2", "div"):
            words = [w for w in words if w != "header"]
        marked = [w for w in words if w in MARKS or w.startswith(STARTS)]
        if marked and all(w in marked or w in PLAIN for w in words):
            marks += marked
    if any(w.startswith(TALK) for w in marks):
        return SHARE
    return MOST if marks or role == "form" else least


def label(tag: str, attrs: dict[str, str]) -> str:
    """Tag, and classes without digits: what pages of one template have in common."""
    names = sorted({re.sub(r"[\d_]+", "", c.lower()) for c in attrs.get("class", "").split()} - {""})
    return ".".join([tag, *names])


class Page:
    """Blocks of text of a page, each with the container it lies in."""

    def __init__(self, source: str):
        self.spared: set[int] = set()
        self.read(source)
        self.spared = self.wrappers()
        if self.spared:
            self.read(source)
        for node, text, links in self.scored:
            node.score += max(0.0, len(text) - 2.0 * links)
        for node in reversed(self.nodes[1:]):  # children come after their parents
            node.up.score += node.score

    def read(self, source: str) -> None:
        self.root = Node(None, "", "", 0)
        #: Places in the stack of the open elements of each name, and of blocks.
        self.open_at: defaultdict[str, list[int]] = defaultdict(list)
        self.open_blocks: list[int] = []
        self.nodes = [self.root]
        self.blocks: list[tuple[Node, str]] = []
        # name, container, boilerplate, article, link, innermost marked element, never text
        self.stack: list[tuple[str, Node, bool, bool, bool, int, bool]] = []
        self.scored: list[tuple[Node, str, int]] = []
        self.lines: list[bool] = []
        self.parts: list[str] = []
        self.linked = 0
        #: Of each marked element, and first of the page: share to stay, the marked
        #: element around it, unlinked text that is in no marked element in it, and
        #: that of article elements.
        self.marked: list[list] = [[NEVER, 0, 0, 0]]
        at, last = 0, source.rfind(">")
        while True:
            m = TAG.search(source, at) if at <= last or source.find("<!--", at) >= 0 else None
            self.text(source[at : m.start() if m else len(source)])
            if not m:
                break
            at = m.end()
            close, name, rest = m[1], (m[2] or "").lower(), m[3]
            if not name:
                continue
            if close:
                self.close(name)
            elif name in RAW:
                end = re.compile(rf"</{name}\b", re.I).search(source, at)
                at = source.find(">", end.end()) + 1 if end else 0
                at = at or len(source)
            else:
                self.open(name, rest)
        self.flush()

    def wrappers(self) -> set[int]:
        """Marked elements that hold so much of the unlinked text that they wrap the
        page. None is if text of an article stands outside in what surrounds it."""
        held = [m[2] for m in self.marked]
        for k in range(len(held) - 1, 0, -1):
            held[self.marked[k][1]] += held[k]
        article = [0] * len(held)
        for k in range(1, len(held)):
            outer = self.marked[k][1]
            article[k] = article[outer] + self.marked[outer][3]
        return {k for k in range(1, len(held)) if held[k] and held[k] >= self.marked[k][0] * held[0] and not article[k]}

    def here(self) -> tuple[str, Node, bool, bool, bool, int, bool]:
        return self.stack[-1] if self.stack else ("", self.root, False, False, False, 0, False)

    def text(self, s: str) -> None:
        if not s:
            return
        _, _, gone, article, link, inner, never = self.here()
        if not never and not link:
            self.marked[inner][2] += len(s.strip())
            self.marked[inner][3] += len(s.strip()) * article
        if not gone:
            self.parts.append(s)
            if link:
                self.linked += len(s)

    def flush(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            if text:
                node = self.here()[1]
                self.blocks.append((node, text))
                self.scored.append((node, text, min(self.linked, len(text))))
                self.lines.append(2 * self.linked <= len(text))
        self.parts, self.linked = [], 0

    def drop_to(self, k: int) -> None:
        while len(self.stack) > k:
            name = self.stack.pop()[0]
            self.open_at[name].pop()
            if name in BLOCKS:
                self.open_blocks.pop()

    def open(self, name: str, rest: str) -> None:
        if name == "br":
            self.text(" ")
            return
        if name in BLOCKS:
            self.flush()
            if self.open_blocks:
                k = self.open_blocks[-1]
                if self.stack[k][0] == "p" or self.stack[k][0] in CLOSES.get(name, ()):
                    self.drop_to(k)
        if name in VOID:
            return
        attrs = attributes(rest)
        _, node, gone, article, link, inner, never = self.here()
        least = 0.0 if never else boilerplate(name, attrs, article)
        never = never or least == NEVER
        gone = gone or never
        if least and not never:
            self.marked.append([least, inner, 0, 0])
            inner = len(self.marked) - 1
            gone = gone or inner not in self.spared
        if name in CONTAINERS and not gone:
            node = Node(node, label(name, attrs), name, len(self.nodes))
            self.nodes.append(node)
        self.open_at[name].append(len(self.stack))
        if name in BLOCKS:
            self.open_blocks.append(len(self.stack))
        self.stack.append((name, node, gone, article or name in ("article", "main"), link or name == "a", inner, never))

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        if not self.open_at[name]:
            return
        k = self.open_at[name][-1]
        if name in BLOCKS or not self.open_blocks or k > self.open_blocks[-1]:
            self.drop_to(k)

    def vote(self) -> Node:
        """From the root down to the container whose parts do not hold most of it."""
        node = self.root
        while node.children:
            best = max(node.children, key=lambda c: (c.score, -c.order))
            least = (DOWN if node.tag in TOPS else WITHIN) * node.score
            if best.score < least or not best.score or (node.tag in ("article", "main") and best.tag != "article"):
                break
            node = best
        return node

    def beside(self, own: Node) -> set[str]:
        """Paths of the containers with text that stand next to one and its ancestors."""
        out, node = set(), own
        while node.up is not None:
            out.update(c.path for c in node.up.children if c.score and c.path != node.path)
            node = node.up
        return out

    def within(self, path: str) -> str:
        """Blocks of all containers with a path and text of their own, in page order, and
        the blocks that stand directly in what is around them, up to the article or main
        part: headings, paragraphs, lists, quotations and bare text, but not mere links.
        A container with one part that holds most of it is around that part."""
        inside, part, above = [False] * len(self.nodes), [0] * len(self.nodes), set()
        around = set()
        for n in self.nodes[1:]:  # parents come first
            part[n.order] = n.order if n.tag in ("article", "main") else part[n.up.order]
        for n in self.nodes:
            own = n.path == path and bool(n.score or not path)
            inside[n.order] = own or (n.up is not None and inside[n.up.order])
            if inside[n.order] and (own or n.up.order in around) and n.tag not in ("article", "main"):
                if any(c.score >= SHARE * n.score for c in n.children if c.score):
                    around.add(n.order)
            whole = part[n.up.order] if n.up is not None else 0
            if own and n.up is not None and (n.tag not in ("article", "main") or whole):
                node = n.up
                while node is not None and node.order not in above:
                    above.add(node.order)
                    if node.order == whole and whole:
                        break
                    node = node.up
        kept = (
            text for (node, text), line in zip(self.blocks, self.lines)
            if (inside[node.order] and (line or node.order not in around)) or (line and node.order in above)
        )
        return "\n".join(kept)

    def scores(self, own: Node, path: str, beside: set[str]) -> tuple[float, float]:
        """Score on a path in the page, and that of a container that lies on the path or
        on paths beside it."""
        found = covered = 0.0
        walk = [(self.root, False, False)]
        while walk:
            node, inside, counted = walk.pop()
            inside = inside or node is own
            if node.path == path:
                found += node.score
            if not counted and (node.path == path or node.path in beside):
                counted = True
                covered += node.score * inside
            walk += [(c, inside, counted) for c in node.children]
        return found, covered

    def extract(self, winners: list[str], beside: list[str] = ()) -> str:
        """The text on the first host path that holds nearly all of the page's own
        container, or with it what the host's pages leave beside their text."""
        own = self.vote()
        for path in winners:
            found, covered = self.scores(own, path, set(beside))
            if found and (found >= SHARE * own.score or (found >= WINNER * own.score and covered >= SHARE * own.score)):
                return self.within(path)
        return self.within(own.path)


def host(url: Column) -> Column:
    """Lower-case host of a URL, null if it has none."""
    name = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(F.length(name) > 0, name)


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, pages, beside): how many pages of a host chose a path, and how many
    left it beside the one they chose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for h, x in zip(*(c.to_pylist() for c in batch.columns)):
                page = Page(x)
                own = page.vote()
                if own.score > 0:
                    found.append((h, own.path, 1))
                    found += [(h, path, 0) for path in page.beside(own)]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["host", "path", "own"])

    rows = pages.filter("host is not null and html is not null").select("host", "html")
    counted = rows.mapInArrow(run, "host string, path string, own int").groupBy("host", "path")
    return counted.agg(F.sum("own").alias("pages"), F.sum(1 - F.col("own")).alias("beside"))


def with_tops(counted: DataFrame) -> DataFrame:
    """``counted`` with ``all`` votes of the host and its ``first`` path."""
    first = F.min(F.struct((-F.col("pages")).alias("n"), "path"))["path"]
    top = keep(counted.filter("pages > 0").groupBy("host").agg(F.sum("pages").alias("all"), first.alias("first")))
    return counted.join(F.broadcast(top) if small(top, 512) else top, "host")


def winning_paths(counted: DataFrame) -> DataFrame:
    """(host, winners): paths with at least a fifth of a host's votes, and the first
    of all, most votes first; so no host has more than six."""
    kept = with_tops(counted).filter((F.col("pages") >= WINNER * F.col("all")) | (F.col("path") == F.col("first")))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("pages")).alias("n"), "path")))
    return kept.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("winners"))


def beside_paths(counted: DataFrame) -> DataFrame:
    """(host, beside): paths that at least half of a host's pages leave beside their
    text and none chooses; no more than twice as many as a page has."""
    kept = with_tops(counted).filter((F.col("all") > 1) & (F.col("pages") == 0) & (F.col("beside") >= MOST * F.col("all")))
    return kept.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("beside"))


@F.pandas_udf(StringType())
def text_of(sources: pd.Series, winners: pd.Series, beside: pd.Series) -> pd.Series:
    paths = lambda w: list(w) if w is not None else []
    return pd.Series([Page(s).extract(paths(w), paths(b)) for s, w, b in zip(sources, winners, beside)], dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` without html, with ``text`` and ``n_chars`` (columns of these names are
    replaced).

    A page without html, markup or text has an empty text. Pages without a host in
    their url follow their own vote. Repeated pages vote, and are extracted, each.
    Ties between paths go to the smaller path.
    """
    own = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    rows = pages.withColumn("__host", host(F.col("url")))
    counted = keep(votes(rows.select(F.col("__host").alias("host"), "html")))
    won = keep(winning_paths(counted).join(beside_paths(counted), "host", "left"))
    won = won.select(F.col("host").alias("__host"), F.col("winners").alias("__winners"), F.col("beside").alias("__beside"))
    if small(won, 512):
        won = F.broadcast(won)
    body = F.coalesce(F.col("html"), F.lit(""))
    out = rows.join(won, "__host", "left").select(*own, text_of(body, F.col("__winners"), F.col("__beside")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
