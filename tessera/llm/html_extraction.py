"""HTML extraction by consensus host paths.

Pass one scores the containers of every page and Spark sums, per host, the votes
for their generalised tag-class paths; pass two cuts each page by the best of
its host's paths that it has. A container's score is the text of its blocks
without links, halved with each container in between; article and main elements
and telling class names weigh more. Numbers in class names are generalised, so
that ``post-17`` and ``post-18`` are one path. The ``PATHS_PER_HOST`` paths with
most votes travel with a host; pages that have none of them are found in a pass of
their own and join their paths with the votes of all. No page is written on the way.

Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments are dropped wherever they stand, by element, role, or a class
whose words all say so (``site-header``, ``cookie-notice``; not ``entry-header``,
``content-with-sidebar``). A header inside an article stays, and so does a form
that frames the page's article, main part or title. Blocks keep page order;
nothing is cut short.

Defined results: null or empty html gives an empty text; a page without a known
path uses its own best container; a null url is a host of its own; repeated
rows are extracted each; ties of score go to the outer container, ties of votes
to the lesser path; html of any length and depth is read in linear time; an empty
table gives no rows; other columns pass through ``extract``, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Hosts whose paths are broadcast; beyond it the join shuffles (and Spark splits hot hosts).
MOST_BROADCAST_HOSTS = 50_000
#: Paths that travel with a host. A page that has none of them looks for its best path by a join with all votes.
PATHS_PER_HOST = 5

# Element names and class words.
_RAW = "script style noscript template textarea iframe svg object title xmp".split()
_DROPPED = {*"head nav footer aside dialog menu button select fieldset label".split()}
_VOID = {*"area base br col embed hr img input link meta param source track wbr".split()}
_CONTAINERS = {*"html body main article section div td center details form".split()}
_BLOCKS = _CONTAINERS | {
    *"p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 hr pre blockquote table thead tbody tfoot tr th caption figure figcaption address summary header nav footer aside".split()
}
_CLOSED_BY = {"p": ("p",), "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_BARRIERS = tuple(_CONTAINERS | {*"ul ol dl table".split()})
_INNER = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
_IN_HEAD = {*"head title meta link style script base noscript template".split()}
_BAD_WORDS = {
    *"ad ads advert adverts advertisement advertising sponsor sponsored promo sidebar side menu nav navbar navigation topbar header footer "
    "masthead breadcrumb breadcrumbs cookie cookies consent notice notices popup modal overlay newsletter subscribe subscription signup share sharing "
    "social related recommended comment comments commentlist disqus replies reply respond login search widget widgets pagination pager toolbar".split()
}
#: Words that say where or in what form a thing stands: a class is bad if all its words are bad or of these.
_PLACE_WORDS = {
    *"site page main top bottom left right global primary secondary container wrapper wrap area list box block section bar inner outer row col "
    "button buttons link links panel item items group fixed sticky mobile desktop small large slot unit rail zone thread form posts articles stories "
    "content text title body banner icons policy".split()
}
_BAD_ROLES = {*"navigation banner contentinfo complementary search dialog alert menu menubar form".split()}
_GOOD_WORDS = {*"content article post entry story text body main".split()}
#: Elements that a page's frame has and a form for readers has not.
_FRAME = {*"article main h1 section nav".split()}

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*+)")
_QUOTED = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\b", re.I) for t in _RAW}


def _is_bad(name: str) -> bool:
    """A class or id that names something beside the article, as a whole: ``site-header`` does, ``entry-header`` and ``with-sidebar`` do not."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    return any(w in _BAD_WORDS for w in words) and all(w in _BAD_WORDS or w in _PLACE_WORDS for w in words)


class _Open:
    """Elements that are open, with the places of each name, so that no step looks through all of them."""

    def __init__(self):
        # (tag, container, dropped, in a link, blocks before it)
        self.items: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, 0)]
        self.places: dict[str, list[int]] = defaultdict(list)

    def push(self, item: tuple[str, int, bool, bool, int]) -> None:
        self.places[item[0]].append(len(self.items))
        self.items.append(item)

    def last(self, tags) -> int:
        """Place of the innermost element of these names, or 0."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def pop(self) -> tuple[str, int, bool, bool, int]:
        item = self.items.pop()
        self.places[item[0]].pop()
        return item


class Page:
    """Containers (path, parent, weight) and kept blocks (container, text, characters in links).

    A path is a hash of its elements, each with its generalised classes, so that deep pages stay small.
    Reading takes time in proportion to the page, whatever it holds.
    """

    def __init__(self, source: str | None):
        self.containers: list[tuple[int, int, float]] = [(0, -1, 0.25)]
        self.blocks: list[tuple[int, str, int]] = []
        self._text: list[str] = []
        self._linked = 0
        self._frames = 0
        self._open = _Open()
        self._read(source or "")

    def _read(self, source: str) -> None:
        at, end, last, plain = 0, len(source), source.rfind(">"), False
        while at < end:
            start = source.find("<", at)
            if start < 0 or start > last and not source.startswith("<!--", start):
                break
            if source.startswith("<!--", start):
                self._add(source[at:start])
                close = source.find("-->", start + 4)
                at = end if close < 0 else close + 3
                continue
            name = _NAME.match(source, start + 1)
            if not name and source[start + 1 : start + 2] not in ("!", "?", "/"):
                self._add(source[at : start + 1])
                at = start + 1
                continue
            self._add(source[at:start])
            stop = source.find(">", start)
            if name and not plain:
                quoted = _QUOTED.match(source, name.end()).end()
                if source.startswith(">", quoted):
                    stop = quoted
                else:
                    plain = True  # a quote without an end: from here on the first > ends a tag
            at = stop + 1
            if not name:
                continue
            tag, rest = name[1].lower(), source[name.end() : stop]
            if source[start + 1] == "/":
                self._close(tag)
            elif tag in _RAW_END:
                if not rest.endswith("/"):
                    m = _RAW_END[tag].search(source, at)
                    close = source.find(">", m.end()) if m else -1
                    at = end if close < 0 else close + 1
            else:
                self._start(tag, rest)
        self._add(source[at:])
        while len(self._open.items) > 1:
            self._end()
        self._flush()

    def _add(self, raw: str) -> None:
        if raw and not self._open.items[-1][2]:
            self._text.append(raw)
            if self._open.items[-1][3]:
                self._linked += len(raw)

    def _flush(self) -> None:
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            if text:
                self.blocks.append((self._open.items[-1][1], text, min(self._linked, len(text))))
            self._text, self._linked = [], 0

    def _end(self) -> None:
        """Closes the innermost element."""
        tag, _, dropped, _, before = self._open.items[-1]
        if tag in _BLOCKS or dropped:
            self._flush()
        self._open.pop()
        # a form that frames no page is for readers to fill in
        if tag == "form" and before >= 0 and self._frames <= before >> 32:
            del self.blocks[before & 0xFFFFFFFF :]

    def _close_to(self, place: int) -> None:
        while len(self._open.items) > place:
            self._end()

    def _start(self, tag: str, attributes: str) -> None:
        if tag not in _IN_HEAD and self._open.places.get("head"):
            self._close_to(self._open.last(("head",)))
        if tag in _BLOCKS:
            self._flush()
            barrier = self._open.last(_INNER.get(tag, _BARRIERS))
            places = [x for x in (self._open.last((t,)) for t in _CLOSED_BY.get(tag, ("p",))) if x > barrier]
            if places:
                self._close_to(min(places))
        elif tag == "br":
            self._add(" ")
        if tag in _FRAME:
            self._frames += 1
        if tag in _VOID:
            return
        _, container, dropped, linked, _ = self._open.items[-1]
        names = {k.lower(): (a or b or c).lower() for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
        classes = [*names.get("class", "").split(), *names.get("id", "").split()]
        before = -1
        if not dropped:
            frame = tag in ("html", "body", "article", "main")
            header = tag == "header" and not self._open.places.get("article")
            dropped = tag in _DROPPED or header or not frame and any(map(_is_bad, classes)) or names.get("role") in _BAD_ROLES and tag != "form"
            if dropped:
                self._flush()
            elif tag in _CONTAINERS:
                general = sorted(re.sub(r"\d+", "0", c) for c in classes)
                path = xxhash.xxh3_64_intdigest(f"{self.containers[container][0]}>{'.'.join([tag, *general])}".encode("utf-8", "surrogatepass")) >> 1
                good = names.get("role") == "main" or any(w in _GOOD_WORDS for c in classes for w in re.split(r"[^a-z]+", c))
                weight = {"article": 3.0, "main": 2.0, "body": 0.5, "html": 0.25}.get(tag, 1.5 if good else 1.0)
                self.containers.append((path, container, weight))
                container = len(self.containers) - 1
                before = self._frames << 32 | len(self.blocks)
        self._open.push((tag, container, dropped, linked or tag == "a", before))

    def _close(self, tag: str) -> None:
        place = self._open.last((tag,))
        if place:
            self._close_to(place)

    def scores(self) -> list[float]:
        out = [0.0] * len(self.containers)
        for container, text, linked in self.blocks:
            out[container] += float(len(text) - linked)
        for i in range(len(out) - 1, 0, -1):  # a container stands behind the one it lies in
            out[self.containers[i][1]] += out[i] / 2
        return [s * c[2] for s, c in zip(out, self.containers, strict=True)]

    def best(self) -> int:
        scores = self.scores()
        return max(range(len(scores)), key=lambda i: (scores[i], -i))

    def votes(self) -> dict[int, float]:
        """The share of the page's best score that each path reaches."""
        scores = self.scores()
        top = max(scores)
        found: dict[int, float] = {}
        if top > 0:
            for s, (path, _, _) in zip(scores, self.containers, strict=True):
                found[path] = max(found.get(path, 0.0), s / top)
        return found

    def filled(self) -> set[int]:
        """Paths of containers that hold blocks."""
        full = [False] * len(self.containers)
        for container, _, _ in self.blocks:
            full[container] = True
        for i in range(len(full) - 1, 0, -1):
            full[self.containers[i][1]] |= full[i]
        return {c[0] for c, f in zip(self.containers, full, strict=True) if f}

    def text(self, paths: list[int], otherwise_best: bool = True) -> str | None:
        """The blocks under the first of the paths that holds any, else under the page's best container (or null)."""
        if not self.blocks:
            return ""
        filled = self.filled()
        path = next((p for p in paths if p in filled), None)
        if path is None and not otherwise_best:
            return None
        best = self.best() if path is None else -1
        inside = [False] * len(self.containers)
        for i, (own, parent, _) in enumerate(self.containers):
            inside[i] = i == best or own == path or parent >= 0 and inside[parent]
        return "\n".join([text for container, text, _ in self.blocks if inside[container]])


def _host(url: str):
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/:?#]*)", 1), F.lit(""))


def path_votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, votes) of every path of each host."""

    def vote(frames):
        for frame in frames:
            sums: dict[tuple[str, int], float] = defaultdict(float)
            for host, source in zip(frame["host"], frame["html"], strict=True):
                for path, share in Page(source).votes().items():
                    sums[host, path] += share
            yield pd.DataFrame([(*k, v) for k, v in sums.items()], columns=["host", "path", "votes"])

    slim = pages.select(_host(url).alias("host"), F.col(html).alias("html"))
    votes = slim.mapInPandas(vote, "host string, path long, votes double")
    return votes.groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))


def host_paths(votes: DataFrame, n: int = PATHS_PER_HOST) -> DataFrame:
    """(host, paths): the n paths with most votes of each host, best first."""
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    top = votes.withColumn("n", place).filter(F.col("n") <= n)
    return top.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("n", "path"))).alias("all")).select("host", F.transform("all", lambda x: x["path"]).alias("paths"))


def _without_path(frames):
    """Pages (_row, html, paths) that hold text, but under none of their host's paths."""
    for frame in frames:
        known = [list(p) if p is not None else [] for p in frame["paths"]]
        lost = [Page(source).text(p, otherwise_best=False) is None for source, p in zip(frame["html"], known, strict=True)]
        yield frame[["_row"]][lost]


def _best_paths(pages: DataFrame, votes: DataFrame) -> DataFrame:
    """(_row, path): of all paths that a page (_row, host, html) has, the one with most votes of its host."""

    def own(frames):
        for frame in frames:
            found = [(row, host, path) for row, host, source in zip(frame["_row"], frame["host"], frame["html"], strict=True) for path in Page(source).filled()]
            yield pd.DataFrame(found, columns=["_row", "host", "path"])

    each = pages.mapInPandas(own, "_row long, host string, path long").join(votes, ["host", "path"])
    best = each.groupBy("_row").agg(F.max(F.struct("votes", (-F.col("path")).alias("path"))).alias("best"))
    return best.select("_row", (-F.col("best.path")).alias("path"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", out: str = "main_text") -> DataFrame:
    """``pages`` with the main text of each in column ``out``. ``pages`` must be read from files."""
    votes = common.staged(path_votes(pages, url, html))
    paths = common.staged(host_paths(votes))
    few = paths.count() <= MOST_BROADCAST_HOSTS
    held = [c for c in pages.columns if c != out]
    # input columns by place, so that no name of theirs clashes
    names = {c: f"_in_{i}" for i, c in enumerate(held)}
    rows = common.with_row_id(pages.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], _host(url).alias("host"), F.col(f"`{html}`").alias("html")))
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names.values())

    def cut(frames):
        for frame in frames:
            known = [[*(p if p is not None else []), *([] if one is None else [int(one)])] for p, one in zip(frame["paths"], frame["path"], strict=True)]
            text = [Page(source).text(p) for source, p in zip(frame["html"], known, strict=True)]
            yield frame[list(names.values())].assign(_text=text)

    joined = rows.join(F.broadcast(paths) if few else paths, "host", "left")
    other = common.staged(joined.select("_row", "html", "paths").mapInPandas(_without_path, "_row long"))
    if other.isEmpty():
        joined = joined.withColumn("path", F.lit(None).cast("string"))
    else:
        best = common.staged(_best_paths(rows.join(other, "_row", "left_semi").select("_row", "host", "html"), votes))
        # as text, for pandas would make numbers with nulls inexact
        joined = joined.join(best.withColumn("path", F.col("path").cast("string")), "_row", "left")
    done = joined.select(*names.values(), "html", "paths", "path").mapInPandas(cut, f"{kinds}, _text string")
    return done.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("_text").alias(out))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = common.read(spark, sf_dir, "pages").select("page_id", "url", "html")
    done = extract(pages)
    return done.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


QUERIES = {"op9_html_extraction": op9_html_extraction}
ORACLE_SQL: dict[str, str] = {}
