"""Main text of web pages by consensus paths per host.

Every page's containers are scored by the text of the blocks they hold directly, links and boilerplate left
out. A page votes for the generalised tag-class path of its best container; votes are counted per host in Spark,
and each page is extracted again at its host's winning path (at its own best one, if it has no such element).
"""

from __future__ import annotations

import html
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngrid.llm.common import append, cut

#: Hosts whose winning path is broadcast; more of them are joined by a shuffle.
BROADCAST_HOSTS = 100_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object canvas select".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody thead tfoot table ul ol dl figcaption figure summary details address center".split())
DROP = frozenset("nav aside footer button dialog menu head".split())
#: Seldom part of the article, but some sites wrap whole pages in them.
WRAP = frozenset("form fieldset".split())
#: An open element that the start of another one ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body article section main div nav aside footer header form table ul ol dl td th".split())
#: Words in class or id that name what never belongs to the article, where a name ends in one of them or in a word of PARTS: ``post-comments``, ``comments_area``.
#: In other names (``comments-open``, ``ad-free``, ``reply-to-critics``) they may tell a state or a topic.
NEVER = frozenset(
    "ad ads adv advert adverts advertisement adbox adsense sponsor sponsored cookie cookies consent gdpr popup modal newsletter subscribe subscription signup breadcrumb breadcrumbs pagination pager skip "
    "comment comments commentlist replies reply respond disqus".split()
)
#: Words that mark what seldom belongs to it: names of layouts and of topics hold them too, so an element that holds most of the text is kept all the same.
SELDOM = frozenset(
    "promo promotion banner notice notices notification overlay nav navbar navigation menu sidebar sidebars rail widget widgets footer masthead topbar toolbar share sharing social related recommended recommendations "
    "discussion login search hidden copyright".split()
)
PARTS = frozenset("area banner bar block body box button container footer form group header holder inner item items label link list message meta outer panel placeholder row section slot thread title top bottom unit widget wrap wrapper left right text".split())
#: Letters outside links that an element marked weakly must hold before its mark is lifted.
LIFT = 200
#: Share of a page's longer runs of text that its container must hold; a run counts from so many letters on.
SHARE, LONG = 0.75, 40
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?/][^>]*>", re.S)
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
KEEP, WEAK, STRONG = 0, 1, 2


def _label(tag: str, attrs: str) -> tuple[str, int]:
    """Generalised name of an element (digits count as one sign), and how surely its class, id or role marks boilerplate."""
    if not attrs or attrs.isspace():
        return tag, KEEP
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
    if not got:
        return tag, KEEP
    names = [re.sub(r"\d+", "0", c) for c in got.get("class", "").split()]
    label = tag + "".join(f".{c}" for c in sorted(set(names)))
    if not names and got.get("id"):
        label += "#" + re.sub(r"\d+", "0", got["id"])
    off = STRONG if "hidden" in got or got.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert") else KEEP
    for name in [*got.get("class", "").split(), got.get("id", "")]:
        words = [w.lower() for w in SPLIT.split(name) if w]
        if not {"no", "has", "with", "without"} & set(words[:1]):
            never = NEVER & set(words)
            off = max(off, STRONG if never and words[-1] in NEVER | PARTS else WEAK if never or SELDOM & set(words) else KEEP)
    return label, off


class Page:
    """The elements of a page and its runs of text (element, block, text, in a link).

    Per element: parent, tag, label, own mark, its container (the nearest block that is no paragraph or list, itself included), the nearest
    article or main around it, and a hash of its path. Every list grows in page order; the work is in proportion to the page, however deep it nests.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.label, self.mark, self.container, self.article, self.hash = [-1], ["#"], ["#"], [KEEP], [0], [0], [0]
        self.runs: list[tuple[int, int, str, bool]] = []
        self.stack: list[int] = [0]
        self.open: dict[str, list[int]] = {}  # places in the stack by tag
        self.scopes: list[int] = [0]
        self.links, block, at, lower, text_from = 0, 0, 0, None, 0
        size = len(source)
        while True:
            start = source.find("<", at)
            if start < 0:
                break
            if source.startswith("<!--", start):
                self._text(block, source[text_from:start])
                end = source.find("-->", start + 4)
                at = text_from = size if end < 0 else end + 3
                continue
            m = TAG.match(source, start) or PLAIN_TAG.match(source, start)
            if m is None:
                at = start + 1
                if source.find(">", at) < 0:  # no tag can end any more
                    break
                continue
            self._text(block, source[text_from:start])
            at = text_from = m.end()
            if m.lastindex is None or m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                if name == "br":
                    self.runs.append((self.stack[-1], block, "\n", self.links > 0))
                if name in VOID:
                    continue
                block += name in BLOCK
                k = self.open[name][-1] if self.open.get(name) else -1
                if k > 0 and (name in SCOPE or k >= self.scopes[-1]):
                    self._close(k)
                continue
            if name == "br":
                self.runs.append((self.stack[-1], block, "\n", self.links > 0))
                continue
            if name in BLOCK:
                block += 1
                ends = ENDS.get(name, set()) | {"p"}
                while True:
                    k = max((self.open[t][-1] for t in ends if self.open.get(t)), default=-1)
                    if k < 1 or k < self.scopes[-1]:
                        break
                    ended = self.tag[self.stack[k]]
                    self._close(k)
                    if ended != "p":
                        break
            if name in VOID:
                continue
            if name in RAW:
                lower = lower if lower is not None else source.lower() if len(source.lower()) == size else source
                end = lower.find(f"</{name}", at)
                if not m[3].endswith("/"):
                    at = text_from = size if end < 0 else (source.find(">", end) + 1 or size)
                continue
            self._start(name, m[3])
        self._text(block, source[text_from:])

    def _start(self, name: str, attrs: str) -> None:
        label, off = _label(name, attrs)
        above, e = self.stack[-1], len(self.tag)
        inside = self.article[above]
        if name in ("html", "body"):
            off = KEEP
        elif name in ("article", "main"):
            # the first article around a text is named after topics; one inside another article may be a comment or a card
            off = off if off == STRONG or name == "article" == self.tag[inside] else KEEP
        elif name in DROP or name == "header" and not inside:
            off = STRONG
        elif name in WRAP:
            off = max(off, WEAK)
        elif name == "label" and not self.open.get("p") and (self.open.get("form") or self.open.get("fieldset")):
            off = STRONG
        self.parent.append(above)
        self.tag.append(name)
        self.label.append(label)
        self.mark.append(off)
        self.container.append(e if name in BLOCK and name not in LEAF else self.container[above])
        self.article.append(e if name in ("article", "main") else inside)
        self.hash.append(zlib.crc32(label.encode("utf-8", "surrogatepass"), self.hash[above]))
        self.open.setdefault(name, []).append(len(self.stack))
        if name in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(e)
        self.links += name == "a"

    def _close(self, k: int) -> None:
        """End the element at place ``k`` of the stack and all in it."""
        while len(self.stack) > k:
            name = self.tag[self.stack.pop()]
            self.open[name].pop()
            self.links -= name == "a"
            if name in SCOPE:
                self.scopes.pop()

    def _text(self, block: int, text: str) -> None:
        if text:
            self.runs.append((self.stack[-1], block, text, self.links > 0))

    def path(self, e: int) -> str:
        out = []
        while e > 0:
            out.append(self.label[e])
            e = self.parent[e]
        return ">".join(out[::-1])

    def at_path(self, path: str) -> set[int]:
        """The elements at a path."""
        h = 0
        for part in path.split(">"):
            h = zlib.crc32(part.encode("utf-8", "surrogatepass"), h)
        last = path.rsplit(">", 1)[-1]
        return {e for e in range(1, len(self.tag)) if self.hash[e] == h and self.label[e] == last and self.path(e) == path}

    def kept(self, roots: set[int]) -> list[bool]:
        """For every element whether its text belongs to the outermost of ``roots`` around it: no mark stands between the two.

        Marks on and above a root do not count. A weak mark is lifted where the element holds more text outside links
        than all that is unmarked below the root, more than it has in links, and LIFT letters at least.
        """
        n = len(self.tag)
        if not any(m == WEAK for m in self.mark):
            out = [False] * n
            for e in range(n):
                out[e] = e in roots or e > 0 and not self.mark[e] and out[self.parent[e]]
            return out
        root, marked = [-1] * n, [-1] * n  # the outermost marked element between an element and its root, itself included
        lifted: set[int] = set()
        amount = [0] * n
        linked = [0] * n
        for e, _, text, link in self.runs:
            size = len(text) if not text.isspace() else 0
            (linked if link else amount)[e] += size
        while True:
            for e in range(n):
                up = self.parent[e]
                if up >= 0 and root[up] >= 0:
                    root[e] = root[up]
                    marked[e] = marked[up] if marked[up] >= 0 else e if self.mark[e] and e not in lifted else -1
                else:
                    root[e], marked[e] = (e if e in roots else -1), -1
            free: dict[int, int] = {}
            held: dict[int, list[int]] = {}
            # what a marked element would bring in: its text, less that of marked elements in it
            inner = [-1] * n
            for e in range(n):
                if root[e] < 0:
                    continue
                if marked[e] < 0:
                    free[root[e]] = free.get(root[e], 0) + amount[e]
                    continue
                top = marked[e]
                inner[e] = top if e == top else -1 if inner[self.parent[e]] < 0 or self.mark[e] and e not in lifted else top
                if inner[e] == top:
                    h = held.setdefault(top, [0, 0])
                    h[0] += amount[e]
                    h[1] += linked[e]
            best = max((e for e in held if self.mark[e] == WEAK and held[e][0] > max(held[e][1], free.get(root[e], 0), LIFT - 1)), key=lambda e: held[e][0], default=-1)
            if best < 0:
                return [root[e] >= 0 and marked[e] < 0 for e in range(n)]
            lifted.add(best)

    def best(self) -> tuple[int, float]:
        """The container with the highest score, or the smallest around it that holds most of the longer text; -1 without any text.

        Where no text stands outside links, that in links counts.
        """
        kept = self.kept({0})
        runs = [(self.container[e], len(text.strip()), link) for e, _, text, link in self.runs if kept[e] and not text.isspace()]
        runs = [(e, n) for e, n, link in runs if not link] or [(e, n) for e, n, _ in runs]
        score: dict[int, float] = {}
        total = [0] * len(self.tag)
        for e, n in runs:
            score[e] = score.get(e, 0) + n
            if n >= LONG:
                total[e] += n
            if e > 0:
                up = self.parent[e]
                score[up] = score.get(up, 0) + n / 2
        if not score:
            return -1, 0.0
        best = max(score, key=lambda e: (score[e], -e))
        for e in range(len(total) - 1, 0, -1):
            total[self.parent[e]] += total[e]
        # the article around the best section is the container
        top = self.article[best] or best
        while top > 0 and total[top] < SHARE * total[0]:
            top = self.parent[top]
        return top, score[best]

    def text(self, chosen: set[int]) -> str:
        """Blocks of the chosen elements, one per line."""
        kept = self.kept(chosen)
        blocks: dict[int, list[str]] = {}
        for e, block, text, _ in self.runs:
            if kept[e]:
                blocks.setdefault(block, []).append(text)
        lines = (" ".join(html.unescape("".join(x)).split()) for _, x in sorted(blocks.items()))
        return "\n".join(x for x in lines if x)


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, pages, score): how many pages of a host have their best container at a path."""

    def run(batches):
        for b in batches:
            host, path, score = [], [], []
            for url, source in zip(b.column(0), b.column(1), strict=True):
                page = Page(source.as_py() or "")
                e, s = page.best()
                if e > 0:
                    host.append(host_of(url.as_py()))
                    path.append(page.path(e))
                    score.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(score, pa.float64())], names=["host", "path", "score"])

    rows = pages.select(F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "host string, path string, score double")
    return rows.groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum("score").alias("score"))


def winners(counted: DataFrame) -> DataFrame:
    """(host, path): most pages, then the higher score, then the path that sorts first."""
    return counted.groupBy("host").agg(F.max_by("path", F.struct("pages", F.round("score"), F.expr("-length(path)"), "path")).alias("path"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` plus ``main_path``, ``main_text`` and ``main_chars``; columns of these names, and ``main_host``, are replaced.

    A null or empty page, and one without text outside boilerplate, gives an empty text. Pages whose url is null or has no
    host vote together. Repeated rows come back as often as they came; an empty table gives an empty result.
    Blocks follow one another by one line break, white space inside is one space, nothing is capped.
    """
    pages = pages.drop("main_path", "main_text", "main_chars")
    won = cut(winners(votes(pages, url_col, html_col)).select(F.col("host").alias("main_host"), F.col("path").alias("main_path")))
    few = won.count() <= BROADCAST_HOSTS
    host = append(pages, [url_col], "main_host string", lambda c: [pa.array([host_of(u) for u in c[0]], pa.string())])
    # beyond that, hosts of many pages are partitions that Spark splits as skewed
    rows = host.join(F.broadcast(won) if few else won, "main_host", "left").drop("main_host")

    def make(columns):
        texts = []
        for source, path in zip(*columns, strict=True):
            page = Page(source or "")
            chosen = page.at_path(path) if path is not None else set()
            text = page.text(chosen) if chosen else ""
            if not text:
                e, _ = page.best()
                text = page.text({e}) if e >= 0 else ""
            texts.append(text)
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return append(rows, [html_col, "main_path"], "main_text string, main_chars long", make)


def op9_host_paths(spark, sf_dir):
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.col("main_chars").alias("n_chars"))
