"""Main text of web pages by consensus host paths.

A first pass scores the containers of every page and names the best one by its generalised path: tags and classes from the
top, without numbers. The pages of a host vote, and the path with most votes wins; pages are then read again and the text
is taken from the containers at the winning path. A page that has no such container falls back on its own best one. Votes
are combined before the shuffle. The winners, one short row a host, are joined back to the pages; beyond the session's
broadcast threshold that is a shuffled join, whose skewed hosts adaptive execution splits.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from carefold.session import cut_lineage

_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|$)|!\[CDATA\[.*?(?:\]\]>|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(>?))""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMES = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements without article text.
_DROPPED = frozenset("head nav header footer aside form script style noscript template textarea title iframe noembed noframes xmp select button dialog menu svg math "
                     "object audio video canvas input datalist fieldset".split())
_BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table caption thead tbody tfoot tr td th section article main figure "
                    "figcaption address hr details summary center body html header footer nav aside form fieldset".split())
_CLOSES_P = _BLOCKS - {"caption", "thead", "tbody", "tfoot", "tr", "td", "th", "dt", "dd", "li", "body", "html"}
#: A start tag ends open elements of these names, up to the nearest of the second set.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
         "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in a class or id that mark what is not the article.
_JUNK = frozenset("nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer sidebar aside rail related recommended recommendations "
                  "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr "
                  "notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login register search share sharing "
                  "social comment comments disqus replies reply respond discussion pagination pager toolbar skip widget widgets copyright legal disclaimer paywall "
                  "hidden invisible form".split())
#: Beginnings of words that mark it as well, for names written together.
_JUNK_STARTS = ("advert", "banner", "breadcrumb", "comment", "cookie", "disqus", "footer", "menu", "navi", "newsletter", "popup", "related", "sidebar", "sponsor", "subscri")
_JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
_GOOD = frozenset("article content post entry story body text main page blog".split())
_NEVER = frozenset("html body main article".split())


class _Node:
    """An open element: its own ``step`` of the path, its nearest block (``block``), whether it lies in a link, and how far its
    path agrees with the wanted one (``agreed`` characters, -1: not at all; ``inside``: at it or below)."""
    __slots__ = ("tag", "parent", "step", "junk", "kind", "score", "block", "linked", "agreed", "inside")

    def __init__(self, tag, parent, step, junk, kind):
        self.tag, self.parent, self.step, self.junk, self.kind, self.score = tag, parent, step, junk, kind, 0.0
        self.block = self if tag in _BLOCKS or parent is None else parent.block
        self.linked = parent is not None and parent.linked or tag == "a"
        self.agreed, self.inside = 0, False

    @property
    def path(self) -> str:
        """The generalised path, put together only for the few nodes that are asked, so that deep pages stay cheap."""
        steps, node = [], self
        while node is not None:
            steps.append(node.step)
            node = node.parent
        return ">".join(s for s in reversed(steps) if s)

    def follow(self, wanted: str) -> None:
        """Set ``agreed`` and ``inside`` from those of the parent."""
        at, self.inside = self.parent.agreed, self.parent.inside
        if self.inside or at < 0:
            self.agreed = at
            return
        step = f">{self.step}" if self.parent.parent is not None else self.step
        if wanted.startswith(step, at):
            self.agreed = at + len(step)
            self.inside = self.agreed == len(wanted)
        else:
            self.agreed = -1
            self.inside = len(step) > len(wanted) - at and step.startswith(wanted[at:] + ">")


def _describe(tag: str, attributes: str, parent: _Node) -> _Node:
    """A node with its step of the path, whether it is outside the article, and what speaks for it."""
    junk, classes, kind = parent.junk or tag in _DROPPED, "", 0
    if attributes and "=" in attributes or "hidden" in attributes:
        got = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
        words = [w.lower() for w in _NAMES.findall(got.get("class", "") + " " + got.get("id", ""))]
        marks = [w for before, w in zip(["", *words], words) if before not in ("no", "has", "with", "without")]
        role = got.get("role", "").lower()
        if tag not in _NEVER and (role in _JUNK_ROLES or any(w in _JUNK or w.startswith(_JUNK_STARTS) for w in marks)):
            junk = True
        if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", ""), re.I):
            junk = True
        classes = ".".join(sorted({re.sub(r"\d+", "", c) for c in got.get("class", "").split()} - {""}))
        if got.get("itemprop", "").lower() == "articlebody":
            kind = 3
        elif role == "main":
            kind = 2
        elif not _GOOD.isdisjoint(marks):
            kind = 1
    kind = 3 if tag == "article" else max(kind, 2) if tag == "main" else kind
    return _Node(tag, parent, f"{tag}.{classes}" if classes else tag, junk, kind)


def blocks(page: str, wanted: str = "") -> Iterator[tuple[_Node, str, int]]:
    """(innermost block element, text, characters of it inside links) for every run of text that is not outside the article.
    With a path, the elements know whether they lie inside it."""
    root = _Node("html", None, "", False, 0)
    stack, text, links, place, opened = [root], [], 0, 0, Counter()

    def flush():
        nonlocal text, links
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                yield stack[-1].block, whole, links
        text, links = [], 0

    def say(raw: str):
        nonlocal links
        if raw and not stack[-1].junk:
            plain = entities.unescape(raw) if "&" in raw else raw
            text.append(plain)
            if stack[-1].linked:
                links += len(plain)

    def close(names, until=frozenset()):
        if not any(opened[n] for n in names):  # nothing to close, however deep the page is
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in until:
                return
            if stack[i].tag in names:
                opened.subtract(n.tag for n in stack[i:])
                del stack[i:]
                return

    while found := _TAG.search(page, place):
        say(page[place:found.start()])
        place = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if not found[4]:  # a stray quote: the tag ends at the next bracket
            place = (page.find(">", place) + 1) or len(page)
        if tag == "br" or tag == "wbr":
            if tag == "br":
                say(" ")
            continue
        if tag in _BLOCKS or tag in _DROPPED:
            yield from flush()
        if found[1]:
            close({tag}, frozenset() if tag in _BLOCKS else frozenset({"td", "th", "table"}))
            continue
        if tag in ("html", "body"):
            if tag == "body":
                close({"head"})
            if opened[tag] or tag == "html":
                continue
        if tag in _CLOSES_P:
            close({"p"}, frozenset({"td", "th", "table", "button"}))
        if tag in _ENDS:
            close(*_ENDS[tag])
        if tag in _VOID or found[3].rstrip().endswith("/") and tag not in _BLOCKS and tag not in _RAW:
            continue
        stack.append(_describe(tag, found[3], stack[-1]))
        opened[tag] += 1
        if wanted:
            stack[-1].follow(wanted)
        if tag in _RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.I).search(page, place)
            place = end.start() if end else len(page)
    say(page[place:])
    yield from flush()


def best_path(page: str | None) -> tuple[str, float] | None:
    """Path and score of the container that holds most text outside links."""
    scored: dict[int, _Node] = {}
    for node, text, links in blocks(page or ""):
        worth = max(len(text) - 2 * links, 0) + 25 * (node.tag == "p")
        holder, share = node.parent if node.tag not in ("div", "section", "td", "article", "main", "body") and node.parent is not None else node, 1.0
        while holder is not None and share > 0.2:
            holder.score += worth * share * (1, 1.5, 2, 3)[holder.kind]
            scored[id(holder)] = holder
            holder, share = holder.parent, share / 2
    if not scored:
        return None
    best = max(scored.values(), key=lambda n: n.score)
    above, holder = [], best
    while holder is not None:
        above.append(holder)
        holder = holder.parent
    lifted = next((n for kind in (3, 2) for n in reversed(above) if n.kind == kind), best)
    return lifted.path, best.score


def text_at(page: str | None, path: str | None) -> str:
    """The blocks inside the containers at ``path``, in page order, one a line; from the page's own best if there are none."""
    for wanted in (path, None):
        if wanted is None:
            own = best_path(page)
            if own is None:
                return ""
            wanted = own[0]
        lines = [text for node, text, _ in blocks(page or "", wanted) if node.inside or not wanted]
        if lines:
            return "\n".join(lines)
    return ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, path): the article text of every page and the winning path of its host.

    White space inside a block is one space, blocks are joined by a line feed; null and empty pages have the empty text. Ties
    between paths go to the higher total score, then to the path that sorts last. Pages without a url are one host. Repeated rows vote
    and come out each; other columns are not looked at."""
    spark_kind = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    slim = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).cast("string").alias("_html"), host.alias("_host"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [best_path(h.as_py()) for h in batch.column("_html")]
            yield pa.RecordBatch.from_arrays([batch.column("_host"), pa.array([g and g[0] for g in got], pa.string()), pa.array([g and g[1] for g in got], pa.float64())],
                                             names=["_host", "path", "score"])

    votes = slim.select("_host", "_html").mapInArrow(vote, "_host string, path string, score double").filter("path IS NOT NULL")
    counted = votes.groupBy("_host", "path").agg(F.count("*").alias("votes"), F.sum(F.round("score").cast("long")).alias("score"))
    winners = cut_lineage(counted.groupBy("_host").agg(F.max(F.struct("votes", "score", "path")).alias("w")).select("_host", F.col("w.path").alias("_path")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_at(h.as_py(), p) for h, p in zip(batch.column("_html"), batch.column("_path").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string()), batch.column("_path")], names=[id_col, url_col, "text", "path"])

    joined = slim.join(winners, "_host", "left").select("_id", "_url", "_html", "_path")
    return joined.mapInArrow(read, f"`{id_col}` {spark_kind[id_col]}, `{url_col}` {spark_kind[url_col]}, text string, path string")
