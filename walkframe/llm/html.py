"""Main text of web pages, by consensus paths of each host.

Every page scores its containers: a block of text counts for the container it
stands in, and half as much for each container around that. From the best one the way goes outwards, to the article
that it is the larger part of; that one votes,
with the best one's score, for its generalised path (tags and classes from the root,
without numbers). Votes are summed by host and path in Spark, and every page is
extracted again from the elements on the best-voted path that it has. A page
with none of its host's paths keeps its own best.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# HTML's element classes, and words in class names of what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg object select canvas audio video head".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html"
    " li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br option".split()
)
CONTAINERS = frozenset("article main section div td body blockquote center table html".split())
#: A start tag ends an open element of these, up to the nearest element of the second set.
ENDS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table thead tbody tfoot"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
ENDS_P = BLOCK - {"br", "li", "td", "th", "tr", "dd", "dt", "option", "body", "html", "summary", "figcaption"}
NOT_ARTICLE = frozenset("nav footer aside form button menu dialog label input datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
BAD_WORDS = frozenset(
    "nav navbar navigation menu footer sidebar aside comment comments commentlist reply replies respond disqus ad ads advert adverts advertisement adsense adslot"
    " banner promo promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription"
    " signup login share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager widget widgets toolbar masthead topbar skip"
    " hidden copyright form search".split()
)
#: Words that may stand beside those in a class name; beside any other word, as in long-form, they say nothing.
BESIDE = frozenset(
    "area articles bar block bottom box button buttons col column container content entries fixed footer form global group header icons inner items left link links list main"
    " messages outer page panel post posts primary right row secondary section site slot sticky stories top unit wrap wrapper user thread".split()
)
#: Readers' words: hidden however many there are.
READERS = frozenset("comment comments commentlist reply replies respond disqus".split())
GOOD_WORDS = frozenset("article content post entry story main text body".split())
STATES = frozenset("has with no is without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Paths longer than so many characters are written as a digest of their beginning and their last step.
LONG_PATH = 400

#: Containers that are parts of an article rather than of a page's layout.
PARTS = frozenset("section blockquote table td center".split())
#: Of what a container adds to those in it, so much may be in links.
LINKED = 0.3

#: A page is extracted on another path than its best only if that scores so large a share of the best.
LEAST = 0.1

#: Most tags: without < or > in quotes, so that no match goes on behind the next <.
PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
OUTSIDE_QUOTES = re.compile(r"""[^>"']*+""")
ATTRIBUTE = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORDS = re.compile(r"[a-z]+")


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


class Tags:
    """The tags of a page, one after the other, in time linear in the page.

    A ``>`` in quotes doesn't end a tag, if the quotes are closed and another ``>`` follows; else the first ``>`` ends it.
    Where a search for the end came to nothing, later searches that reach one of its places outside quotes end there at once.
    """

    def __init__(self, source: str) -> None:
        self.source, self.last = source, source.rfind(">")
        self.closing = {q: source.rfind(q) for q in "\"'"}
        self.dead: set[int] = set()

    def end(self, at: int) -> int:
        """Where the tag ends whose attributes begin at ``at``: its ``>``, or -1."""
        source, at_first, seen = self.source, at, []
        while at not in self.dead:
            seen.append(at)
            at = OUTSIDE_QUOTES.match(source, at).end()
            if at > self.last:
                break
            if source[at] == ">":
                return at
            if at in self.dead:
                break
            seen.append(at)
            close = source.find(source[at], at + 1) if self.closing[source[at]] > at else -1
            if close < 0:
                break
            at = close + 1
        self.dead.update(seen)
        return source.find(">", at_first) if at_first <= self.last else -1

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, whether it is an end tag, attributes) of the next tag; comments and the like have no name."""
        source = self.source
        while (start := source.find("<", at)) >= 0:
            if m := PLAIN.match(source, start):
                return start, m.end(), m[2].lower(), m[1] != "", m[3]
            mark = source[start + 1 : start + 2]
            for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if source.startswith(opening, start):
                    close = source.find(closing, start + len(opening))
                    return start, close + len(closing) if close >= 0 else len(source), "", False, ""
            if start > self.last:
                # no tag can end any more; only a comment that is open to the end of the page may follow
                rest = [x for x in (source.find("<!--", start), source.find("<![CDATA[", start)) if x >= 0]
                if not rest:
                    return None
                at = min(rest)
                continue
            if m := NAME.match(source, start):
                close = self.end(m.end())
                if close >= 0:
                    return start, close + 1, m[2].lower(), bool(m[1]), source[m.end() : close]
            elif mark and mark in "!?/":
                return start, source.find(">", start) + 1, "", False, ""
            at = start + 1
        return None


class Page:
    """The elements of a page in document order, and its text as events.

    ``parent``, ``tag``, ``path``, ``depth`` (containers around it) and ``role`` (0 article, 1 boilerplate,
    2 a header, whose headings count inside an article) describe element i; its events are ``first[i]`` to
    ``last[i]``, and the elements in it those up to ``beyond[i]``. ``mine`` is the role without those around it, 3 where only a
    class name or a form says boilerplate; elements ``kept`` have none of their own. An event is (element, text, in a link),
    or None at the edge of a block. Places on the stack of open elements are kept by tag, so no tag looks through the stack.
    """

    def __init__(self, source: str, kept: frozenset[int] = frozenset()) -> None:
        self.kept, self.mine = kept, [0]
        self.tag, self.parent, self.path, self.depth, self.role = ["html"], [-1], ["html"], [0], [0]
        self.first, self.last, self.beyond = [0], [0], [0]
        self.events: list[tuple[int, str, bool] | None] = []
        self.stack, self.places, self.blocks_open, self.containers_open = [0], {}, [], [0]
        tags, at, end = Tags(source), 0, len(source)
        lower, links = None, self.places.setdefault("a", [])

        def text(piece: str) -> None:
            if piece:
                self.events.append((self.stack[-1], piece, bool(links)))

        while at < end and (found := tags.next(at)):
            start, after, name, closes, source_of = found
            text(source[at:start])
            at = after
            if not name:
                continue
            if closes:
                if name in BLOCK:
                    self.events.append(None)
                place = self.nearest((name,))
                # an end tag of an inline element doesn't close containers
                if place > 0 and (name in BLOCK or self.containers_open[-1] <= place):
                    self.close(place)
                continue
            if name in BLOCK:
                self.events.append(None)
            if name == "html" or name == "svg" and source_of.endswith("/"):
                continue  # foreign elements are closed by their own tag, unlike <script/> and the like
            if name in RAW:
                if name != "head":
                    lower = lower or source.lower()
                    close = lower.find(f"</{name}", at) if len(lower) == end else -2
                    if close == -2:  # lower case is longer
                        m = re.compile(f"</{name}", re.IGNORECASE).search(source, at)
                        close = m.start() if m else -1
                    at = source.find(">", close) + 1 if 0 <= close <= tags.last else end
                continue
            if name in VOID:
                continue
            if name in ENDS_P:
                if self.blocks_open:
                    t = self.tag[self.stack[self.blocks_open[-1]]]
                    if t == "p" or (t in HEADINGS and name in HEADINGS):
                        self.close(self.blocks_open[-1])
            elif name in ENDS:
                ended, scope = ENDS[name]
                while (place := self.nearest(ended)) > self.nearest(scope):
                    self.close(place)
                    if name != "tr":
                        break
            self.open(name, source_of, self.stack)
        text(source[at:])
        self.close(0)

    def nearest(self, names: Iterable[str]) -> int:
        """The highest place on the stack of an open element of these names, or -1."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def close(self, to: int) -> None:
        """Close the stack down to place ``to``, which is closed as well."""
        while len(self.stack) > to:
            i = self.stack.pop()
            self.last[i], self.beyond[i] = len(self.events), len(self.tag)
            place, name = len(self.stack), self.tag[i]
            if place:
                self.places[name].pop()
            if name in BLOCK and place:
                self.blocks_open.pop()
            if name in CONTAINERS:
                self.containers_open.pop()

    def open(self, name: str, source: str, stack: list[int]) -> None:
        i, up = len(self.tag), stack[-1]
        has = attributes(source) if source and not source.isspace() else {}
        classes = (has.get("class", "") + " " + has.get("id", "")).lower().split()
        mine = 0
        if name in NOT_ARTICLE or has.get("role", "").lower() in ROLES or "hidden" in has or has.get("aria-hidden") == "true" or "display:none" in has.get("style", "").replace(" ", ""):
            mine = 3 if name == "form" else 1
        elif name == "header":
            mine = 2
        elif name not in ("body", "article", "main"):
            for c in classes:
                w = WORDS.findall(c)
                if w and w[0] not in STATES:
                    if not BAD_WORDS.isdisjoint(w) and BAD_WORDS.union(BESIDE).issuperset(w):
                        mine = 3 if READERS.isdisjoint(w) else 1
                        break
                    if "header" in w:
                        mine = 2
        if i in self.kept:
            mine = 0
        self.mine.append(mine)
        role = self.role[up]
        if role == 2 and name in HEADINGS and self.nearest(("article", "main")) >= 0:
            role = 0
        elif role == 0:
            role = 1 if mine == 3 else mine
        general = ".".join([name, *sorted({re.sub(r"[0-9]+", "#", c) for c in has.get("class", "").lower().split()})])
        self.tag.append(name)
        self.parent.append(up)
        own = name in CONTAINERS
        around = self.path[up]
        if own and len(around) > LONG_PATH:
            around = "#" + hashlib.blake2b(around.encode(errors="surrogatepass"), digest_size=16).hexdigest()
        self.path.append(f"{around}>{general}" if own else around)
        self.depth.append(self.depth[up] + own)
        self.role.append(role)
        self.first.append(len(self.events))
        self.last.append(len(self.events))
        self.beyond.append(i + 1)
        place = len(stack)
        if name in self.places:
            self.places[name].append(place)
        else:
            self.places[name] = [place]
        if name in BLOCK:
            self.blocks_open.append(place)
        if own:
            self.containers_open.append(place)
        stack.append(i)

    def wrongly_hidden(self) -> frozenset[int]:
        """Elements that only a class name (or being a form) hides, though next to nothing is left without them: the largest, and those around or in it that hold half as much."""
        if 3 not in self.mine:
            return frozenset()
        shown, inside, strong = 0, [0] * len(self.tag), [m == 1 for m in self.mine]
        for i in range(1, len(self.tag)):
            strong[i] |= strong[self.parent[i]]
        for e in self.events:
            if e is not None and not e[2]:
                n = len(e[1].strip())
                if self.role[e[0]] == 0:
                    shown += n
                if not strong[e[0]]:
                    inside[e[0]] += n
        for i in range(len(self.tag) - 1, 0, -1):
            inside[self.parent[i]] += inside[i]
        weak = [i for i, m in enumerate(self.mine) if m == 3 and not strong[i]]
        most = max(weak, key=lambda i: (inside[i], -i), default=0)
        if not most or not inside[most]:
            return frozenset()
        titled = any(t in ("h1", "article", "main") for t in self.tag[most : self.beyond[most]]) or self.nearest_up(most, ("article", "main"))
        if shown and not (titled and shown < 0.1 * inside[most]):
            return frozenset()
        return frozenset(i for i in weak if 2 * inside[i] >= inside[most])

    def nearest_up(self, i: int, names: tuple[str, ...]) -> bool:
        """Whether element i stands in one of these."""
        while i > 0 and self.tag[i] not in names:
            i = self.parent[i]
        return i > 0

    def blocks(self, i: int = 0) -> Iterator[tuple[int, str, int]]:
        """(element, text, characters of it in links) of each block in element i that isn't boilerplate."""
        held: list[str] = []
        where, linked = i, 0
        for e in [*self.events[self.first[i] : self.last[i]], None]:
            if e is None:
                if held:
                    text = " ".join("".join(map(html.unescape, held)).split())  # a tag ends a reference
                    if text:
                        yield where, text, linked
                    held, linked = [], 0
            elif self.role[e[0]] == 0:
                if not held:
                    where = e[0]
                held.append(e[1])
                linked += len(e[1]) if e[2] else 0
            elif held:
                held.append(" ")

    def scores(self) -> dict[int, float]:
        """Of each container with text: characters outside links, halved with each container in between."""
        found: dict[int, float] = {}
        for where, text, linked in self.blocks():
            while self.tag[where] not in CONTAINERS:
                where = self.parent[where]
            found[where] = found.get(where, 0.0) + max(0, len(text) - linked)
        for i in range(len(self.tag) - 1, 0, -1):  # what is inside comes behind
            if worth := found.get(i, 0.0):
                up = self.parent[i]
                while self.tag[up] not in CONTAINERS:
                    up = self.parent[up]
                found[up] = found.get(up, 0.0) + worth / 2
        for i in found:
            last = set(WORDS.findall(self.path[i].rpartition(">")[2]))
            found[i] *= 1.5 if self.tag[i] in ("article", "main") else 1.25 if last & GOOD_WORDS else 1.0
        return found

    def whole(self, path: str) -> str:
        """The path of the container that the best-scored ones, on ``path``, are the larger part of.

        From the first of them outwards: an article around it is taken, and any container that adds only text of its own, or of parts of
        an article, no more than there is so far and little of it in links. The page, its body and what
        has other divisions with text beside the best end the way.
        """
        own: dict[int, list[int]] = {}
        for where, text, linked in self.blocks():
            while self.tag[where] not in CONTAINERS:
                where = self.parent[where]
            n = own.setdefault(where, [0, 0])
            n[0] += len(text)
            n[1] += linked
        inside = self.on_path(path)
        if not inside:
            return path
        at, last, have, best = inside[0], self.beyond[inside[0]], 0, path
        for i in range(at, last):
            have += own.get(i, (0, 0))[0]
        while self.tag[at] != "article":
            up = self.parent[at]
            while up > 0 and self.tag[up] not in CONTAINERS:
                up = self.parent[up]
            if up <= 0 or self.tag[up] in ("body", "html"):
                break
            added, linked, apart = 0, 0, False
            for i in (*range(up, at), *range(last, self.beyond[up])):  # what is new on this step
                if i in own:
                    n, in_links = own[i]
                    if self.path[i] == path or self.path[i].startswith(path + ">"):
                        have += n
                    else:
                        added, linked, apart = added + n, linked + in_links, apart or i != up and self.tag[i] not in PARTS
            if self.tag[up] != "article" and (apart or added > have or linked > LINKED * added):
                break
            at, last, have = up, self.beyond[up], have + added
            if added or self.tag[up] == "article":
                best = self.path[up]
        return best

    def on_path(self, path: str) -> list[int]:
        """The containers on a path, without those inside another of them."""
        found: list[int] = []
        for i, p in enumerate(self.path):
            if p == path and self.tag[i] in CONTAINERS and not (found and i < self.beyond[found[-1]]):
                found.append(i)
        return found

    def text(self, elements: list[int]) -> str:
        return "\n".join(t for i in elements for _, t, _ in self.blocks(i))


def ranked_paths(page: Page) -> list[tuple[str, float, bool]]:
    """The paths of a page's containers, their scores, summed over the elements on a path, and whether they are the page or its body; best first."""
    by_path: dict[str, float] = {}
    root: dict[str, bool] = {}
    for i, s in page.scores().items():
        by_path[page.path[i]] = by_path.get(page.path[i], 0.0) + s
        root[page.path[i]] = page.depth[i] < 2
    ranked = sorted(((p, s, root[p]) for p, s in by_path.items()), key=lambda x: (-x[1], x[0]))
    if ranked and (around := page.whole(ranked[0][0])) != ranked[0][0]:
        return [(around, ranked[0][1], False), *(x for x in ranked if x[0] != around)]
    return ranked


def read_page(source: str | None) -> Page:
    """The page; read again where a class name would hide next to all of it."""
    page = Page(source or "")
    kept = page.wrongly_hidden()
    return Page(source or "", kept) if kept else page


def eligible(scores: list[tuple[str, float, bool]], least: float = LEAST) -> list[str]:
    """Of a page's ranked paths, those that it can be extracted on, its own best one first.

    A path with a small share (``least``) of what the best one scores isn't taken, nor is
    the page as a whole where it has a container of its own: other templates of the host
    that have no container say nothing about this one.
    """
    if not scores:
        return []
    _, top, whole = scores[0]
    return [p for p, s, root in scores if s >= least * top and (not root or whole)]


def extract(source: str | None, paths: list[str], least: float = LEAST) -> str:
    """Text of the elements on the first of ``paths`` that the page is eligible for; or of its own best container."""
    page = read_page(source)
    mine = eligible(ranked_paths(page), least)
    if not mine:
        return page.text([0])
    return page.text(page.on_path(next((p for p in paths if p in mine), mine[0])))


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def ballots(pages: DataFrame) -> DataFrame:
    """``(host, key, own, eligible, votes)`` of each page: its best path and the votes for it, and all paths it can be extracted on, sorted."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, mine, votes = [], [], []
            for source in b.column(2):
                scores = ranked_paths(read_page(source.as_py()))
                of = eligible(scores)
                own.append(of[0] if of else None)
                mine.append(sorted(of))
                votes.append(round(1024 * scores[0][1]) if of else 0)  # whole numbers: a sum has no order
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(own, pa.string()), pa.array(mine, pa.list_(pa.string())), pa.array(votes, pa.int64())],
                ["host", "key", "own", "eligible", "votes"],
            )

    return pages.select("host", "key", "html").mapInArrow(read, "host string, key binary, own string, eligible array<string>, votes long").where("own is not null")


def chosen_paths(cast: DataFrame) -> DataFrame:
    """``(host, key, path)`` of the pages that are extracted on another path than their own best.

    All votes of a host count. Pages of a template are eligible for the same paths, so
    these sets, not pages, meet the votes.
    """
    votes = cast.groupBy("host", F.col("own").alias("path")).agg(F.sum("votes").alias("votes"))
    open_ = cast.where(F.size("eligible") > 1)
    sets = open_.select("host", "eligible").distinct()
    best = F.min(F.struct((-F.col("votes")).alias("v"), "path"))["path"].alias("path")
    choice = sets.withColumn("path", F.explode("eligible")).join(votes, ["host", "path"]).groupBy("host", "eligible").agg(best)
    return open_.join(choice, ["host", "eligible"]).where("path <> own").select("host", "key", "path").distinct()


#: The pages' paths are sent to every task up to so many characters; beyond, they are joined by host and digest.
SMALL = 8 << 20


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages``.

    * null and empty html give an empty text; a null url is a host of its own;
    * paths with equal votes go by their names; of a header in an article the headings are kept, other text of it isn't;
    * whole pages are read, at any length; repeated rows each come back;
    * an empty table gives an empty result; other columns are ignored, whatever their names.

    Pages vote with a short row each, summed before the shuffle, so a host with
    any share of the pages is no hot key. Only pages whose host outvotes their own
    best path get one; the pages themselves aren't shuffled as long as these paths
    are small (their size is checked).
    """
    from walkframe.session import cut

    key = F.unhex(F.md5(F.coalesce("html", F.lit("")).cast("binary"))).alias("key")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), key)
    paths = cut(chosen_paths(cut(ballots(rows))))
    size = paths.agg(F.sum(F.length("host") + F.length("path") + 64)).first()[0] or 0
    joined = rows.join(F.broadcast(paths) if size <= SMALL else paths, ["key", "host"], "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract(h.as_py(), [p] if p else []) for h, p in zip(b.column(2), b.column(3).to_pylist())]
            n = np.array([len(t) for t in text], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(n)], ["page_id", "url", "text", "n_chars"])

    return joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "path").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )


def op1_html_main_text(spark, sf_dir):
    from walkframe.llm.common import table

    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op1_html_main_text": op1_html_main_text}
ORACLE_SQL: dict[str, str] = {}
