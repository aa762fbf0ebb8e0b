"""Main text of web pages by consensus paths of their hosts.

1. Every page is read into containers (article, main, section, div, list, table ...), each with
   its generalised path: tags, classes and ids from the root down, digits replaced. The page
   scores each path by the share of the page's plain text that it holds and by how little else
   (links, menus, notices) it holds, and votes for its best one.
2. Spark adds the votes up by host and path. A host keeps its most voted paths, and the paths
   whose containers are no part of the text: those that hold one and the same text on all of at
   least ``MIN_PAGES`` pages, and those that hold mostly links on nearly all of them.
3. Every page is read again with the paths of its host. The page takes the most voted path it
   has with enough text, or its own best one, and returns the blocks below it.

Votes are pre-aggregated where they are made, so a host with a third of all pages is one row per
path and task before the shuffle. The table of hosts is joined as it is; Spark broadcasts it
if its stored size allows that, and splits a crowded host's pages otherwise.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from licmatch.llm.frames import stage

#: Pages of a host on which a path must occur to be left out of the text.
MIN_PAGES = 3
#: Such a path occurs on at least one page in so many of its host.
ONE_IN = 5
#: Voted paths kept per host.
PATHS = 3
#: A voted path needs so much of the score of the page's own best path.
ENOUGH = 0.2
#: Share of link text from which a container counts as a menu.
LINKED = 0.6

# Element names of HTML and usual names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
    "nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul "
    "caption".split())
CONTAINERS = frozenset("article blockquote body center dd details div dl fieldset figure "
                       "main ol section table tbody td th tr ul".split())
SKIPPED = frozenset("aside audio button canvas dialog footer form head iframe input label map "
                    "menu nav noscript object option script select style svg template textarea "
                    "title video".split())
SKIPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu "
                          "menubar navigation search toolbar".split())
SKIPPED_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising alert alerts banner "
    "breadcrumb breadcrumbs byline comment commentlist comments consent cookie cookies copyright "
    "disclaimer discussion disqus footer gdpr header login masthead menu menus modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination popup promo "
    "promoted promotion recommendations recommended related replies reply respond responses "
    "search share sharing sidebar sidenav signup skip social sponsor sponsored sponsors "
    "subscribe subscription tags teaser toc toolbar topbar widget widgets".split())
ALWAYS_SKIPPED = frozenset("ad ads comment comments disqus menu nav sidebar".split())
MAIN_NAMES = frozenset("article articlebody body content entry main maincontent post postbody "
                       "story text".split())
#: An element named as a skipped part and as one of these may hold the text all the same.
WRAPPERS = frozenset("columns container grid inner layout outer row site wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: The start of an element of the left kind ends open ones of the right kinds.
ENDS = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["td", "th", "tr"],
        "td": ["td", "th"], "th": ["td", "th"], "option": ["option"]}
SCOPES = frozenset("article aside body div dl footer header main nav ol section table td th "
                   "ul".split())

#: Comment, declaration, tag (quotes count right after an equals sign), or a tag cut off.
_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)
                      |(?P<name>/?[A-Za-z][^\s/>]*)
                       (?P<rest>(?:[^>="']++|=\s*"[^"]*+"|=\s*'[^']*+'|["'=])*+>|[^>]*\Z))""",
                  re.S | re.X)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Attributes that say what an element is.
_TELLING = re.compile(r"\b(?:class|id|role|hidden|style)\b", re.I)
#: Elements whose content is text whatever it looks like.
_RAW = {tag: re.compile(rf"</{tag}(?![A-Za-z0-9])", re.I)
        for tag in "iframe noembed script style textarea title xmp".split()}
#: Elements whose end may be left out.
_OPEN_ENDED = frozenset("body dd dt html li option p tbody td tfoot th thead tr".split())
_MARKUP = re.compile(r"<[^>]*>")
_NAME = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_M64 = 2**64 - 1

KEEP, SKIP, TITLES, WRAP = 0, 1, 2, 3


@cache
def _tags_of(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.I)


def _tokens(value: str) -> set[str]:
    """Words of a class or id attribute; has-, no- and with- classes tell nothing."""
    out = set()
    for name in _CAMEL.sub("-", value).split():
        words = [w.lower() for w in _NAME.findall(name)]
        if words and words[0] not in ("has", "no", "with", "without"):
            out.update(words)
    return out


class Page:
    """Containers and text blocks of one page, in page order.

    Containers are parallel lists over the element number; a parent has a smaller number than
    its children, so sums over subtrees are one loop backwards.
    """

    def __init__(self, html: str):
        self.parent, self.path, self.state, self.tag = [-1], [""], [KEEP], [""]
        self.within = [False]  # below an element that is named as the text
        self.plain, self.linked, self.links, self.other = [0], [0], [0], [0]
        self.digest = [0]
        self.blocks: list[tuple[int, str]] = []
        self._open: list[tuple[str, int]] = []
        self._counts: Counter = Counter()
        self._text: list[str] = []
        self._anchors = 0
        self._read(html)
        self._flush()
        self._sum_up()

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            tag = _TAG.search(html, at)
            if tag is None or tag.start() > at:
                self._data(html[at:tag.start() if tag else size])
            if tag is None:
                return
            at = tag.end()
            name = tag["name"]
            if name is None or not tag["rest"].endswith(">"):
                continue
            name = name.lower()
            if name[0] == "/":
                self._end(name[1:])
                continue
            rest = tag["rest"]
            self._start(name, {a.lower(): unescape(x or y or z) for a, x, y, z in
                               _ATTRIBUTE.findall(rest)} if _TELLING.search(rest) else {})
            if name in _RAW:
                end = _RAW[name].search(html, at)
                at = end.start() if end else size
            elif self._open and self.state[self._open[-1][1]] == SKIP and name not in VOID:
                at = self._skip(html, name, at)

    def _skip(self, html: str, name: str, at: int) -> int:
        """Where a skipped element ends; its inside is read only if its end can't be told."""
        if name not in _OPEN_ENDED:
            depth = 1
            for tag in _tags_of(name).finditer(html, at):
                depth += -1 if tag[1] else 1
                if not depth:
                    inside = _MARKUP.sub("", html[at:tag.start()])
                    self.other[self._element()] += len(inside.strip())
                    return tag.start()
        return at

    # -- elements -----------------------------------------------------------------------

    def _element(self) -> int:
        return self._open[-1][1] if self._open else 0

    def _pop(self) -> None:
        tag, _ = self._open.pop()
        self._counts[tag] -= 1
        self._anchors -= tag == "a"

    def _close_to(self, tags) -> None:
        """Close an open element of one of the tags, unless a scope lies in between."""
        counts = self._counts
        for tag in tags:
            if counts.get(tag):
                break
        else:
            return
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] in tags:
                while len(self._open) > i:
                    self._pop()
                return
            if self._open[i][0] in SCOPES:
                return

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "br":
            self._text.append(" ")
            return
        if tag in BLOCKS:
            self._flush()
            self._close_to(("p",))
            if tag in HEADINGS:
                self._close_to(HEADINGS)
            for ended in ENDS.get(tag, ()):
                self._close_to((ended,))
        if tag in VOID:
            return
        if tag == "a":
            self._close_to(("a",))
        self._push(tag, attrs)

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        above = self._element()
        state = self._state(tag, attrs, above)
        if tag in CONTAINERS or state != self.state[above]:
            self.parent.append(above)
            self.path.append(self._path(self.path[above], tag, attrs))
            self.state.append(state)
            self.tag.append(tag)
            names = self._names(attrs)
            self.within.append(self.within[above] or tag in ("article", "main")
                               or (tag in ("div", "section", "td") and bool(names & MAIN_NAMES)))
            for sums in (self.plain, self.linked, self.links, self.other, self.digest):
                sums.append(0)
            above = len(self.parent) - 1
        if tag == "a":
            self._anchors += 1
            self.links[above] += 1
        self._open.append((tag, above))
        self._counts[tag] += 1

    def _state(self, tag: str, attrs: dict, above: int) -> int:
        upper = self.state[above]
        if upper == SKIP:
            return SKIP
        if upper == WRAP:
            if tag not in ("article", "main") and not (tag == "div" and
                                                       self._names(attrs) & MAIN_NAMES):
                return SKIP if tag in SKIPPED else WRAP
        if upper == TITLES:
            return KEEP if tag in HEADINGS else TITLES if tag not in SKIPPED else SKIP
        if tag in ("html", "body", "article", "main"):
            listed = tag == "article" and _tokens(attrs.get("class", "")) & SKIPPED_NAMES
            return SKIP if listed and "comment" in " ".join(listed) else KEEP
        if not attrs and tag != "header":
            return SKIP if tag in SKIPPED else KEEP
        names = self._names(attrs)
        if tag == "header" or "header" in names:
            return TITLES if self.within[above] or names & MAIN_NAMES else SKIP
        if (tag in SKIPPED or attrs.get("role", "").lower() in SKIPPED_ROLES
                or "hidden" in attrs or _HIDDEN.search(attrs.get("style", ""))):
            return SKIP
        if names & ALWAYS_SKIPPED or (tag not in HEADINGS and names & SKIPPED_NAMES
                                      and not names & MAIN_NAMES - {"text"}):
            return WRAP if names & WRAPPERS and not self.within[above] else SKIP
        return KEEP

    @staticmethod
    def _names(attrs: dict[str, str]) -> set[str]:
        return _tokens(f"{attrs.get('class', '')} {attrs.get('id', '')}") if attrs else set()

    @staticmethod
    def _path(upper: str, tag: str, attrs: dict) -> str:
        label = tag
        if "class" in attrs:
            label = ".".join([tag, *sorted(set(_DIGITS.sub("0", attrs["class"]).split()))])
        if attrs.get("id"):
            label += "#" + _DIGITS.sub("0", attrs["id"].strip())
        if len(upper) > 400:  # still one name per path
            upper = xxhash.xxh3_128_hexdigest(upper)
        if len(label) > 400:
            label = tag + xxhash.xxh3_128_hexdigest(label)
        return f"{upper}>{label}" if upper else label

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if not self._counts.get(tag):
            return
        crossing = tag in BLOCKS
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == tag:
                while len(self._open) > i:
                    self._pop()
                return
            if not crossing and self._open[i][0] in SCOPES:
                return

    # -- text ---------------------------------------------------------------------------

    def _data(self, data: str) -> None:
        element = self._element()
        if self.state[element] != KEEP:
            self.other[element] += len(data.strip())
            return
        if "&" in data:
            data = unescape(data)
        if self._anchors:
            self.linked[element] += len(data.strip())
        self._text.append(data)

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split()) if self._text else ""
        self._text.clear()
        if text:
            element = self._element()
            while self.state[element] != KEEP:  # the end of a skipped element ends a block
                element = self.parent[element]
            self.blocks.append((element, text))
            self.plain[element] += len(text)
            self.digest[element] += xxhash.xxh3_64_intdigest(text)

    def _sum_up(self) -> None:
        for e in range(len(self.parent) - 1, 0, -1):
            up = self.parent[e]
            for sums in (self.plain, self.linked, self.links, self.other):
                sums[up] += sums[e]
            self.digest[up] = (self.digest[up] + self.digest[e]) & _M64

    # -- scores -------------------------------------------------------------------------

    def is_menu(self, e: int) -> bool:
        return self.links[e] >= 2 and self.linked[e] >= LINKED * self.plain[e]

    def paths(self) -> dict[str, list]:
        """Per path of text containers: plain, linked, other length, links, digest, named."""
        out: dict[str, list] = {}
        for e in range(1, len(self.parent)):
            if self.state[e] == KEEP and self.tag[e] in CONTAINERS and self.tag[e] != "html":
                row = out.setdefault(self.path[e], [0, 0, 0, 0, 0, False])
                for i, sums in enumerate((self.plain, self.linked, self.other, self.links)):
                    row[i] += sums[e]
                row[4] = (row[4] + self.digest[e]) & _M64
                row[5] |= self.within[e]
        return out

    def scores(self) -> dict[str, float]:
        """Share of the page's plain text below a path times the purity of what is there."""
        paths = self.paths()
        total = max((max(p - l, 0) for p, l, *_ in paths.values()), default=0)
        out = {}
        for path, (plain, linked, other, _, _, named) in paths.items():
            own = max(plain - linked, 0)
            if plain:
                tag = re.split(r"[.#]", path.rsplit(">", 1)[-1], maxsplit=1)[0]
                likely = (1.5 if tag == "article" else 1.4 if tag == "main" else
                          1.25 if named else 0.8 if tag == "body" else
                          0.7 if tag in ("ul", "ol", "dl", "tr", "tbody", "blockquote") else 1.0)
                out[path] = likely * (own + 1) / (total + 1) * (own + 1) / (plain + other + 1)
        return out

    def best(self, scores: dict[str, float]) -> str | None:
        """The path of the highest score; of equal ones the first in page order."""
        return max(scores, key=scores.get) if scores else None

    def text(self, voted: list[str], left_out: list[str]) -> str:
        scores = self.scores()
        own = self.best(scores)
        if own is None:
            return "\n".join(text for _, text in self.blocks)
        chosen = next((p for p in voted if scores.get(p, 0.0) >= ENOUGH * scores[own]), own)
        dropped = set(left_out)
        inside = [False] * len(self.parent)
        gone = [False] * len(self.parent)
        for e in range(1, len(self.parent)):
            up = self.parent[e]
            inside[e] = inside[up] or self.path[e] == chosen
            if inside[up]:
                gone[e] = gone[up] or self.path[e] in dropped or (
                    not self.within[e] and self.tag[e] in CONTAINERS and self.is_menu(e))
        return "\n".join(text for e, text in self.blocks if inside[e] and not gone[e])


def _vote_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page and path (host, path, pages, votes, menus, low, high), and its host's page."""
    for batch in batches:
        rows: dict[tuple, list] = {}
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = Page(html or "")
            best = page.best(page.scores())
            rows.setdefault((host, ""), [0, 0, 0, 0, 0])[0] += 1
            for path, (plain, linked, _, links, digest, _) in page.paths().items():
                digest -= 2**63
                row = rows.setdefault((host, path), [0, 0, 0, digest, digest])
                row[0] += 1
                row[1] += path == best
                row[2] += links >= 2 and linked >= LINKED * plain
                row[3], row[4] = min(row[3], digest), max(row[4], digest)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.string()),
             *[pa.array([r[i] for r in rows.values()], pa.int64()) for i in range(5)]],
            ["host", "path", "pages", "votes", "menus", "low", "high"])


def host_of(url: str = "url"):
    """Host of an address in lower case, without user and port; null if it has none."""
    host = F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", 1)
    return F.when(host != "", F.lower(host))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, voted, left_out): the paths that each host's pages agree on."""
    votes = stage(
        pages.select(host_of().alias("host"), F.col("html").cast("string").alias("html"))
        .where(F.col("host").isNotNull())
        .mapInArrow(_vote_batches, "host string, path string, pages long, votes long, "
                                   "menus long, low long, high long")
        .groupBy("host", "path")
        .agg(F.sum("pages").alias("pages"), F.sum("votes").alias("votes"),
             F.sum("menus").alias("menus"), F.min("low").alias("low"), F.max("high").alias("high")))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    voted = (votes.where("votes > 0").withColumn("nth", F.row_number().over(order))
             .where(F.col("nth") <= PATHS)
             .groupBy("host")
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "path"))),
                              lambda v: v.path).alias("voted"),
                  # does the text of the most voted path differ between pages?
                  F.max(F.expr("nth = 1 and low <> high")).alias("varied")))
    totals = votes.where("path = ''").select("host", F.col("pages").alias("total"))
    # Paths on a fifth of a host's pages or more: five times the containers of a page at most.
    left_out = (votes.where("path <> ''").where(F.col("pages") >= MIN_PAGES)
                .join(totals, "host").where(F.col("pages") * ONE_IN >= F.col("total"))
                .where("menus * 10 >= pages * 8 or low = high")
                .groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("left_out")))
    empty = F.array().cast("array<string>")
    return voted.join(left_out, "host", "left").select(
        "host", "voted",
        F.when(F.col("varied"), F.coalesce("left_out", empty)).otherwise(empty).alias("left_out"))


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [Page(html).text(voted or [], left_out or []) if html else ""
                 for html, voted, left_out in zip(*[batch.column(c).to_pylist() for c in
                                                    ("html", "voted", "left_out")])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()),
             pa.array([len(t) for t in found], pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the article of every page, one line per block.

    A null or empty page gives an empty text. A page without a host, or of a host without
    agreement, is extracted by its own best path; one without any container gives all its
    blocks. Repeated rows are extracted each by themselves and vote each. Cut-off pages and
    elements that never end are read as far as they go. In a header inside the article only
    headings are kept. ``br`` is white space inside a block; cells, items and captions are
    blocks.
    """
    hosts = stage(host_paths(pages))
    known = pages.select("page_id", F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
                         host_of().alias("_host"))
    # Pages without a host are spread; no host looks like their keys.
    spread = F.concat(F.lit("\n"), (F.xxhash64("html") % 4096).cast("string"))
    return (known.join(hosts, F.coalesce("_host", spread) == F.col("host"), "left")
            .select("page_id", "url", "html", "voted", "left_out")
            .mapInArrow(_text_batches, pages.select("page_id").schema.simpleString()[7:-1]
                        .replace(":", " ", 1) + ", url string, text string, n_chars long"))
