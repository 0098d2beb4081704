"""Main text of web pages: containers are scored on each page, and hosts vote on where their article is.

Reading, scoring and extraction take time in proportion to a page, however deep or broken its markup.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import maybe_broadcast, written

NAME, STOP = re.compile(r"[a-zA-Z][\w:-]*"), re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, up to their end tag; those of the second kind may also close themselves.
RAW = frozenset("script style noscript template iframe svg textarea title math object canvas xmp".split())
FOREIGN = frozenset("svg math object canvas iframe".split())
#: Elements that stand on lines of their own.
LINES = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
#: Elements that an opening tag closes if they are the nearest of their kind.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
LISTS = ("ul", "ol", "dl", "table")
KEEPERS = frozenset("table ul ol dl div section article main body html td th".split())
#: Elements of text, which stand in an article and are never where it stands; parts of tables, which are so unless a cell lays out the page.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 hgroup pre blockquote ul ol dl li dt dd figure figcaption caption summary legend address".split())
TABLES, CELLS = frozenset("table thead tbody tfoot tr".split()), frozenset(["td", "th"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold no part of an article.
OUTSIDE = frozenset("nav header footer aside form menu button select option optgroup datalist dialog head label fieldset".split())
#: Words of class, id and role that mark the same, wherever they stand and whatever other words they are joined to.
STRONG = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|adsense|sponsor\w*|comments?|commentlist|disqus|respond|cookies?|consent|gdpr|newsletter|sidebar)(?=$|[\s_-])", re.I
)
#: Words that do so outside articles. Within one they do if they stand alone or among their like, as in `related` or `menu-bar`; joined
#: to others, as in `related-work` or `menu-list`, they may name a part of the article, and mark it only if most of it is links.
WEAK = re.compile(
    r"promo\w*|notices?|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumbs?|toolbar|widget|footer|replies|share|sharing|social|related"
    r"|recommend\w*|subscribe|subscription|signup|login|pagination|pager|complementary|contentinfo",
    re.I,
)
LIKE = re.compile(r"bar|box|banner|wrap|wrapper|container|inner|outer|area|section|buttons?|icons?|posts|\d*", re.I)
JOINED = re.compile("[_-]+")
#: Words that mark the surroundings of an article, and may also name a part of one: they count outside articles and for no element of text.
AROUND = re.compile(r"(?:^|[\s_-])(?:banner|alert|side|aside|foot|header|masthead|topbar|search|skip|copyright|legal)(?=$|[\s_-])", re.I)
MAIN = re.compile(r"(?:^|[\s_-])(?:article|articlebody|main|content|post|entry|story|body|text)(?=$|[\s_-])", re.I)
#: The host's path is followed if it holds this share of what the page's own best container holds.
LEAST_SHARE = 0.5


@dataclass
class Node:
    """An element that stands on lines of its own, and what it holds in all."""

    parent: int
    tag: str
    likely: bool  # an element of articles, or a class that names one
    path: int  # a hash of the generalised names from the root
    depth: int
    good: int = 0
    whole: int = 0
    heads: bool = False


@dataclass
class Run:
    """Text of articles between such elements: its node, its characters in links."""

    node: int
    text: str
    links: int


@dataclass
class Mark:
    """An element that may hold no part of an article, which is known when it has ended: an inline one if its end tag comes,
    another if most of its text is links."""

    parent: int
    inline: bool
    run: int  # the number of the run that it begins in
    ended: bool = False
    chars: int = 0
    links: int = 0
    outside: bool = False


@dataclass
class Page:
    """The nodes of a page, parents first, and its runs of text in order."""

    nodes: list[Node] = field(default_factory=list)
    runs: list[Run] = field(default_factory=list)


def weight_of(marks: str) -> int:
    """What class, id and role say of an element: 2 outside, 1 perhaps outside, 0 nothing."""
    if STRONG.search(marks):
        return 2
    found = 0
    for name in marks.split():
        parts = [p for p in JOINED.split(name) if p]
        weak = [WEAK.fullmatch(p) is not None for p in parts]
        if any(weak):
            found = 2 if all(w or LIKE.fullmatch(p) for w, p in zip(weak, parts, strict=True)) else max(found, 1)
            if found == 2:
                break
    return found


def _likely(tag: str, classes: str) -> bool:
    return tag in ("article", "main") or MAIN.search(classes) is not None


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): `text`, `open` and `close`. Comments, declarations and raw elements are left out.

    A tag ends at the first > that isn't quoted. Where quotes don't close before the end of the page,
    they count for nothing from there on, so no part of a page is read again and again.
    """
    last, at, quoted = page.rfind(">"), 0, True
    while at < len(page):
        lt = page.find("<", at)
        if lt != at:
            yield "text", page[at:lt] if lt >= 0 else page[at:], ""
        if lt < 0:
            return
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if lt > last:
            yield "text", "<", ""
            at = lt + 1
            continue
        if page[lt + 1] in "!?":
            at = page.find(">", lt) + 1
            continue
        closing = page[lt + 1] == "/"
        name = NAME.match(page, lt + 1 + closing)
        if name is None:
            yield "text", "<", ""
            at = lt + 1
            continue
        end = name.end()
        while quoted:
            stop = STOP.search(page, end)
            if stop is None:
                quoted = False
            elif stop[0] == ">":
                end = stop.start()
                break
            else:
                end = page.find(stop[0], stop.end()) + 1
                quoted = end > 0
        if not quoted:
            end = page.find(">", name.end())
            if end < 0:
                yield "text", page[lt:], ""
                return
        tag, rest, at = name[0].lower(), page[name.end() : end], end + 1
        if tag in RAW and not closing:
            if not (tag in FOREIGN and rest.endswith("/")):
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                after = page.find(">", close.end()) if close else -1
                at = after + 1 if after >= 0 else len(page)
            continue
        yield "close" if closing else "open", tag, rest


def read(page: str | None) -> Page:
    """The nodes and runs of a page. Tags left open are closed as browsers do, in the common cases.

    Each piece of text is in or out by the elements that it stands in itself. An inline element that is never closed
    reaches no further than to the next element on lines of its own.
    """
    out = Page()
    # tag, node, outside, in an article, elements with lines of their own so far, where the nearest p or keeper is, innermost mark
    stack: list[tuple[str, int, bool, bool, int, int, int]] = []
    where: dict[str, list[int]] = defaultdict(list)
    marks: list[Mark] = []
    parts: list[tuple[str, bool, int]] = []  # text, whether it is in a link, its mark
    runs: list[tuple[int, int, list[tuple[str, bool, int]]]] = []  # its number, its node, its pieces
    number = 0

    def flush() -> None:
        nonlocal parts, number
        if parts:
            runs.append((number, stack[-1][1] if stack else -1, parts))
            parts = []
        number += 1

    def add(text: str) -> None:
        if not (stack and stack[-1][2]):
            parts.append((text, bool(where["a"]), stack[-1][6] if stack else -1))

    def cut(at: int) -> None:
        while len(stack) > at:
            where[stack.pop()[0]].pop()

    for kind, tag, rest in tokens(page or ""):
        if kind == "text":
            add(tag)
            continue
        if tag == "br":
            add(" ")
            continue
        lines = tag in LINES
        if lines:
            flush()
        if kind == "close":
            if where[tag]:
                at = where[tag][-1]
                if lines or stack[-1][4] == (stack[at - 1][4] if at else 0):
                    mark = stack[at][6]
                    if mark >= 0 and mark != (stack[at - 1][6] if at else -1):
                        marks[mark].ended = True
                    cut(at)
            continue
        if lines:
            # Such an element closes an open paragraph; list items and cells close their like
            if tag not in ("html", "body") and stack and stack[-1][5] >= 0 and stack[stack[-1][5]][0] == "p":
                cut(stack[-1][5])
            if tag in CLOSES:
                like = max((where[t][-1] for t in CLOSES[tag] if where[t]), default=-1)
                if like > max((where[t][-1] for t in LISTS if where[t]), default=-1):
                    cut(like)
        if tag in VOID or rest.endswith("/"):
            continue
        attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(rest)}
        classes = attributes.get("class", "")
        named = " ".join(attributes.get(k, "") for k in ("class", "id", "role"))
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or HIDDEN.search(attributes.get("style", ""))
        above = stack[-1] if stack else ("", -1, False, False, 0, -1, -1)
        likely = _likely(tag, classes)
        # The heading of an article may stand in a header of its own
        gone = (tag in OUTSIDE and not (tag == "header" and (where["article"] or where["main"]))) or bool(hidden)
        weight = weight_of(named) if named.strip() and tag not in ("html", "body", "article", "main") and tag not in HEADINGS else 0
        outside, mark = above[2], above[6]
        if lines:
            around = tag not in ("html", "body", "article", "main") and tag not in LEAVES and not above[3] and AROUND.search(named)
            outside = outside or gone or bool(around) or weight == 2 or (weight == 1 and not above[3])
        if not outside and ((lines and weight == 1) or (not lines and (gone or weight == 2))):
            marks.append(Mark(mark, not lines, number))
            mark = len(marks) - 1
        node = above[1]
        if lines:
            names = sorted({re.sub(r"\d+", "", c).strip("-_") for c in classes.lower().split()} - {""})
            parent = out.nodes[node] if node >= 0 else None
            path = xxhash.xxh3_64_intdigest(".".join([tag, *names]), parent.path if parent else 0)
            out.nodes.append(Node(node, tag, likely, path, parent.depth + 1 if parent else 1))
            node = len(out.nodes) - 1
        here = len(stack) if tag == "p" or tag in KEEPERS else above[5]
        where[tag].append(len(stack))
        stack.append((tag, node, outside, above[3] or (likely and tag not in ("html", "body")), above[4] + lines, here, mark))
    flush()
    # What marks hold in all, the inner ones first; then which hold no part of an article, the outer ones first
    for _, _, pieces in runs:
        for text, link, mark in pieces:
            if mark >= 0:
                marks[mark].chars += len(text)
                marks[mark].links += len(text) * link
    for m in reversed(marks):
        if m.parent >= 0:
            marks[m.parent].chars += m.chars
            marks[m.parent].links += m.links
    for m in marks:
        own = m.ended if m.inline else 2 * m.links >= m.chars > 0
        m.outside = own or (m.parent >= 0 and marks[m.parent].outside)
    for at, place, pieces in runs:
        kept = [p for p in pieces if p[2] < 0 or not (marks[p[2]].outside or (marks[p[2]].inline and marks[p[2]].run == at))]
        text = " ".join(html.unescape("".join([p[0] for p in kept])).split())
        if text:
            out.runs.append(Run(place, text, sum(len(p[0]) for p in kept if p[1])))
    # what a node holds goes up to its parent once
    for run in out.runs:
        if run.node >= 0:
            node = out.nodes[run.node]
            node.good += max(0, len(run.text) - 2 * run.links)  # little where most is links
            node.whole += len(run.text)
            node.heads |= node.tag in HEADINGS
    for node in reversed(out.nodes):
        if node.parent >= 0:
            parent = out.nodes[node.parent]
            parent.good, parent.whole = parent.good + node.good, parent.whole + node.whole
            parent.heads |= node.heads
    return out


def held(page: Page) -> dict[int, tuple[int, int, int, bool]]:
    """For each path at which an article may stand (none within text, lists or tables of data): good and all
    characters, depth, whether it is a likely place."""
    # Cells that hold headings or are named as an article's lay out the page
    layout = {n.path for n in page.nodes if n.tag in CELLS and (n.likely or n.heads)}
    fits: list[bool] = []
    out: dict[int, tuple[int, int, int, bool]] = {}
    for n in page.nodes:
        fits.append((n.parent < 0 or fits[n.parent]) and n.tag not in LEAVES and (n.tag not in CELLS or n.path in layout))
        if fits[-1] and n.tag not in TABLES and n.good:
            good, whole, *_ = out.get(n.path, (0, 0))
            out[n.path] = (good + n.good, whole + n.whole, n.depth, n.likely)
    return out


def scores(page: Page) -> dict[int, tuple[float, int]]:
    """Paths of containers, how well each holds the page's text and nothing else, and their depth.

    Text outside an article is left out wherever it stands, so no container is charged for it.
    """
    total = sum(max(0, len(r.text) - 2 * r.links) for r in page.runs)
    return {
        path: (good / total * good / max(1, whole) * (1.2 if likely else 1.0), depth)
        for path, (good, whole, depth, likely) in held(page).items()
        if total and good >= 0.3 * total
    }


def best(votes: dict[int, tuple[float, int]]) -> int | None:
    """The path with the most votes; ties go to the deeper one, then by number."""
    return min(votes, key=lambda p: (-round(votes[p][0], 9), -votes[p][1], p), default=None)


def text_at(page: Page, path: int | None) -> str:
    """The text within nodes of a path; all text that isn't outside, if there is none."""
    inside: list[bool] = []
    for n in page.nodes:
        inside.append((n.parent >= 0 and inside[n.parent]) or n.path == path)
    return "\n".join(r.text for r in page.runs if path is None or (r.node >= 0 and inside[r.node]))


def extract(page: Page, path: int | None) -> str:
    """The text at the host's path, if it holds the page's article, else at the page's own best path, else all
    text that isn't outside."""
    own, there = best(scores(page)), held(page)
    good = lambda p: there[p][0] if p in there else 0
    chosen = path if path is not None and good(path) and good(path) >= LEAST_SHARE * good(own) else own
    return text_at(page, chosen) or text_at(page, None)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: dict[tuple[str, int, int], float] = defaultdict(float)
        for host, page in zip(batch.column(0), batch.column(1), strict=True):
            host = host.as_py()
            if host is not None:
                for path, (s, depth) in scores(read(page.as_py())).items():
                    votes[host, path - (1 << 64) if path >> 63 else path, depth] += s
        keys = list(votes)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32()))), pa.array(votes.values(), pa.float64())],
            names=["host", "path", "depth", "votes"],
        )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = [p if p is None else p % (1 << 64) for p in batch.column(2).to_pylist()]
        texts = [extract(read(page.as_py()), path) for page, path in zip(batch.column(1), paths, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def winning_paths(pages: DataFrame) -> DataFrame:
    """host and path: where most of a host's pages have their article. Votes are summed before the shuffle."""
    rows = pages.select(host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string"))
    votes = rows.mapInArrow(_vote, "host string, path long, depth int, votes double").groupBy("host", "path", "depth")
    votes = votes.agg(F.round(F.sum("votes"), 6).alias("votes"))
    deepest = F.struct("votes", "depth", "path")
    return votes.groupBy("host").agg(F.max(deepest).alias("best")).select("host", F.col("best.path").alias("path"))


def main_text(pages: DataFrame, row: Column | None = None) -> DataFrame:
    """row (all columns of pages, or those given) and text of every page's whole html.

    A null html has no text. Pages without a host, or without their host's path, go by their own
    best container, and so do pages whose article stands elsewhere. Repeated rows are extracted each, a
    page of any length or depth whole; an empty table gives no rows, and other columns come back in row.
    """
    row = F.struct(*pages.columns) if row is None else row
    won = written(winning_paths(pages), "paths")
    rows = pages.select(row.alias("row"), F.col("html").cast("string").alias("html"), host_of(F.col("url").cast("string")).alias("host"))
    # Few hosts are broadcast; many are joined, where Spark splits the rows of a hot host
    rows = rows.join(maybe_broadcast(won, 100_000), "host", "left").select("row", "html", "path")
    return rows.mapInArrow(_extract, f"row {rows.schema['row'].dataType.simpleString()}, text string")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars."""
    out = main_text(pages.select("page_id", "url", "html"), F.struct("page_id", "url"))
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
