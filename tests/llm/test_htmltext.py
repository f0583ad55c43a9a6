"""Main text of pages against a slow second extractor over html.parser, and pages that are deep, broken or hostile."""

import random
import time
from collections import defaultdict
from html.parser import HTMLParser

from carefold.llm import htmltext

BLOCKS = {"html", "body", "div", "section", "article", "main", "p", "ul", "li", "nav", "aside"}
JUNK_CLASSES = {"sidebar", "comments", "ad-box"}


class Tree(HTMLParser):
    """Well-formed pages as (block element, text, characters in links), elements as paths of (tag, class) from the top."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.open, self.runs, self.text, self.links = [], [], "", 0
        self.feed(page)
        self.end()

    def end(self):
        whole = " ".join(self.text.split())
        if whole:
            at = max((k for k, (tag, _, _) in enumerate(self.open) if tag in BLOCKS), default=-1)
            self.runs.append((tuple(self.open[:at + 1]), whole, self.links))
        self.text, self.links = "", 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS or tag == "script":
            self.end()
        if tag not in ("html", "body") or tag == "body":
            self.open.append((tag, dict(attrs).get("class", ""), self.getpos()))

    def handle_endtag(self, tag):
        if tag in BLOCKS or tag == "script":
            self.end()
        if tag != "html":
            self.open.pop()

    def handle_data(self, data):
        if any(tag in ("nav", "aside", "script") or c in JUNK_CLASSES and tag not in ("main", "article") for tag, c, _ in self.open):
            return
        self.text += data
        self.links += len(data) * any(tag == "a" for tag, _, _ in self.open)


def path(element):
    clean = [(tag, "".join(x for x in c if not x.isdigit())) for tag, c, _ in element]
    return ">".join(f"{tag}.{c}" if c else tag for tag, c in clean)


def kind(element):
    if not element:
        return 0
    tag, c, _ = element[-1]
    return 3 if tag == "article" else 2 if tag == "main" else int(c.startswith(("content", "post")))


def best(runs):
    """(path, score) of the container with most text: a run counts for its container, half for the next, a quarter above."""
    score = {}
    for element, text, links in runs:
        worth = max(len(text) - 2 * links, 0) + 25 * (bool(element) and element[-1][0] == "p")
        at, share = len(element), 1.0
        if element and element[-1][0] not in ("div", "section", "td", "article", "main", "body"):
            at -= 1
        while at >= 0 and share > 0.2:
            score[element[:at]] = score.get(element[:at], 0.0) + worth * share * (1, 1.5, 2, 3)[kind(element[:at])]
            at, share = at - 1, share / 2
    if not score:
        return None
    top = max(score, key=score.get)
    ups = [top[:k] for k in range(len(top) + 1)]
    lifted = next((u for want in (3, 2) for u in ups if kind(u) == want), top)
    return path(lifted), score[top]


def text_of(runs, wanted):
    for p in (wanted, (best(runs) or ("",))[0]):
        lines = [text for element, text, _ in runs if p is not None and (not p or any(path(element[:k]) == p for k in range(1, len(element) + 1)))]
        if lines:
            return "\n".join(lines)
    return ""


def page(r):
    def some(depth):
        out = ""
        for _ in range(r.randint(1, 4)):
            roll = r.random()
            if depth < 5 and roll < 0.45:
                tag = r.choice(["div", "div", "section", "article", "main", "nav", "aside"])
                c = r.choice(["", "", ' class="content"', ' class="post7"', ' class="sidebar"', ' class="x"', ' class="comments"', ' class="ad-box"'])
                out += f"<{tag}{c}>{some(depth + 1)}</{tag}>"
            elif roll < 0.75:
                out += f"<p>{words(r)} <b>{words(r)}</b>, <a href='/q'>{words(r)}</a>\n {words(r)} &amp; &lt;x&gt;</p>"
            elif roll < 0.85:
                out += f"<ul><li>{words(r)}</li><li><a href=\"#\">{words(r)}</a></li></ul>"
            elif roll < 0.9:
                out += "<script>if (a < b) document.write('<p>no</p>');</script>"
            else:
                out += words(r)
        return out
    return f"<!DOCTYPE html><html><body>{some(0)}</body></html>"


def words(r):
    return " ".join(r.choice(["alpha", "beta", "größe", "delta", "epsilon zeta"]) for _ in range(r.randint(1, 12)))


def test_whole_pages_and_hosts(spark):
    r = random.Random(5)
    shapes = [page(r) for _ in range(40)]
    rows = [(k, f"https://host{k % 9}.example/{k}", r.choice(shapes) if k % 3 else page(r)) for k in range(400)]
    votes, runs = defaultdict(lambda: [0, 0]), {}
    for k, url, body in rows:
        runs[k] = Tree(body).runs
        got = best(runs[k])
        assert htmltext.best_path(body) == got
        if got:
            vote = votes[url.split("/")[2], got[0]]
            vote[0], vote[1] = vote[0] + 1, vote[1] + int(got[1] + 0.5)
    winner = {h: max((v[0], v[1], p) for (g, p), v in votes.items() if g == h)[2] for h, _ in votes}
    out = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    assert len(out) == len(rows)
    for row in out:
        host = row["url"].split("/")[2]
        assert row["path"] == winner.get(host)
        assert row["text"] == text_of(runs[row["page_id"]], winner.get(host)), row["page_id"]


def test_deep_pages_take_linear_time():
    def seconds(n):
        start = time.perf_counter()
        assert htmltext.text_at("<div class='a b'>" * n + "<p>the text" + "</x>" * n, None) == "the text"
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(32000) < 40 * max(seconds(4000), 0.05)  # eight times the length; the square would be 64 times


def test_wanted_paths():
    body = "<div class='x>y'><p>a</p></div><div class='x'><p>b</p></div><div><div class='x'>c</div></div>"
    assert htmltext.text_at(body, "div.x") == "a\nb" and htmltext.text_at(body, "div.x>p") == "b"
    assert htmltext.text_at(body, "div>div.x") == "c" and htmltext.text_at("", "div") == "" == htmltext.text_at(None, None)
