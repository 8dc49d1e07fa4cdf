"""Main text of web pages: site templates found by counting subtrees per host, and semantic rules in each page.

Each page is parsed once. The subtree of every block element is hashed before any rule is applied; Spark counts in how
many different pages of a host each hash occurs, and subtrees that recur across many pages of their host are deleted.
Rules about element names, roles and class names then drop what stands on too few pages to be told by counting.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, written

#: Element names of HTML by their part in a page. SKIPPED ones are parts of a line that aren't read.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("button select option svg math object canvas audio video map datalist".split())
#: Of these, elements that end where a new block begins if they were never closed.
CONTROLS = frozenset("button select option".split())
DROPPED = frozenset("head nav footer aside menu dialog".split())
BLOCKS = DROPPED | frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that no class name, role or size makes a part of the frame.
CONTENT = frozenset("html body main article".split())
#: Words of class and id names that mark what is not the main text, words that say nothing beside them, and roles.
MARKS = frozenset("ad ads adsense adsbygoogle bio adv advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus respond reply replies pagination pager toolbar masthead".split())
NEUTRAL = frozenset("site page main top bottom left right list box container wrapper wrap block section area global primary secondary inner outer bar links link item items buttons icons media widget header text policy form thread posts article post user author title body slot unit google law info this".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Numbers and sizes in class names, which say nothing.
_NUMBER = re.compile(r"\d+(?:x\d+)?")
#: The least share of links in the text of an element that a mark beside other words makes a part of the frame.
LINK_SHARE = 0.5
#: The least share of the text left by the rules that articles must hold to be all that counts.
ARTICLE_SHARE = 1 / 3

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|(?=[\s/>]|\Z))""", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


@dataclass
class _Element:
    name: str
    first: int
    #: What a rule says: 2 drop, 1 drop unless it is what the page is about, -1 drop if most of its text is links, 0 nothing.
    rule: int = 0
    skipped: bool = False
    article: bool = False
    parts: list[bytes] = field(default_factory=list)
    last: int = -1
    hashed: int = 0
    closed: bool = True


def _marked(attributes: str, in_article: bool) -> int:
    """The rule that attributes give: 2 for hidden elements and roles, 1 for class and id names that are marks as a whole,
    -1 for those that are marks in part. Numbers say nothing: `ad1` and `ad_728x90` are `ad`."""
    if "=" not in attributes and "hidden" not in attributes:
        return 0
    rule = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" and value in ("", "hidden") or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return 2
        if name in ("class", "id"):
            for token in value.split():
                words = {_NUMBER.sub("", w) for w in re.split(r"[^a-z0-9]+", token)} - {""}
                if words & MARKS or (not in_article and "header" in words):
                    rule = 1 if words <= MARKS | NEUTRAL else rule or -1
    return rule


@dataclass
class Page:
    """Blocks of text in page order with whether each counts as main text, and the block elements."""

    blocks: list[str]
    kept: list[bool]
    elements: list[_Element]


def _lead(e: _Element, links: list[int], sizes: list[int]) -> int:
    """The end of the blocks of links that an element begins with."""
    return next((i for i in range(e.first, e.last) if links[i] < LINK_SHARE * sizes[i]), e.last)


def parse(page: str) -> Page:
    """The page's blocks and elements; the work is linear in its length, however deep elements are nested.

    Where article or main elements hold a third of the text that rules leave, only they count. Inline elements are
    parts of a sentence and have no subtree of their own; those that are skipped or marked say nothing. A form that
    is never closed isn't dropped, and of another part of the frame that is never closed only the links it begins
    with, if it would take most of the page's text; a button ends at the next block.
    """
    blocks: list[str] = []
    inside: list[bool] = []
    elements: list[_Element] = []
    stack: list[_Element] = []
    links: list[int] = []
    text: list[str] = []
    linked: list[str] = []
    open_: Counter[str] = Counter()
    skipped, articles, at = 0, 0, 0

    def flush() -> None:
        said = " ".join("".join(text).split())
        link = len(" ".join("".join(linked).split()))
        text.clear()
        linked.clear()
        if said:
            blocks.append(said)
            links.append(link)
            inside.append(articles > 0)
            if stack:
                stack[-1].parts.append(xxhash.xxh3_64_digest(said))

    def close(closed: bool = True) -> None:
        nonlocal skipped, articles
        e = stack.pop()
        open_[e.name] -= 1
        skipped -= e.skipped
        articles -= e.article
        e.last, e.closed = len(blocks), closed
        digest = b""
        if e.name in BLOCKS and e.parts:
            digest = xxhash.xxh3_64_digest(b"".join([e.name.encode(), *e.parts]))
            e.hashed = int.from_bytes(digest, "little", signed=True)
            elements.append(e)
        if stack and e.parts:
            stack[-1].parts.extend([digest] if digest else e.parts)

    while at < len(page):
        m = _TAG.search(page, at)
        if not skipped:
            text.append(html.unescape(page[at : m.start() if m else len(page)]))
            if open_["a"]:
                linked.append(text[-1])
        if m is None:
            break
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCKS and not closing and stack and stack[-1].name in CONTROLS:
            while stack and stack[-1].name in CONTROLS:
                close(closed=False)
        if name in BLOCKS and not skipped:
            flush()
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None) if open_[name] else None
            if depth is not None and not (name == "p" and any(e.name in ("td", "article", "div") for e in stack[depth + 1 :])):
                while len(stack) > depth:
                    close(closed=len(stack) == depth + 1)
            continue
        if name in VOID:
            continue
        if name in BLOCKS and stack and stack[-1].name == "p" or name in ("li", "dd", "dt", "tr", "td", "th", "option") and stack and stack[-1].name == name:
            close()
        elif name in BLOCKS and open_["p"]:  # an open p with unclosed inline elements ends too
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name in BLOCKS), None)
            if k is not None and stack[k].name == "p":
                while len(stack) > k:
                    close()
        if name in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if m[3].endswith("/") and name not in BLOCKS and name not in SKIPPED:
            continue
        e = _Element(name, len(blocks), article=name in ("article", "main"))
        if name in DROPPED or name == "header" and not articles:
            e.rule = 2
        elif name not in CONTENT:
            marked = _marked(m[3], articles > 0)
            e.rule = max(1, marked) if name in ("form", "fieldset") else marked
        e.skipped = name in SKIPPED or name not in BLOCKS and e.rule > 0
        skipped += e.skipped
        articles += e.article
        open_[name] += 1
        stack.append(e)
    if not skipped:
        flush()
    while stack:
        close(closed=False)
    return Page(blocks, _kept(blocks, links, inside, elements), elements)


def _spread(n: int, spans: list[tuple[int, int]]) -> list[bool]:
    """Which of n blocks lie in one of the spans."""
    change = [0] * (n + 1)
    for a, b in spans:
        change[a] += 1
        change[b] -= 1
    depth, out = 0, []
    for c in change[:n]:
        depth += c
        out.append(depth > 0)
    return out


def _kept(blocks: list[str], links: list[int], inside: list[bool], elements: list[_Element]) -> list[bool]:
    sizes = list(map(len, blocks))
    said, linked = [0, *itertools.accumulate(sizes)], [0, *itertools.accumulate(links)]
    # an element that is never closed would take all that follows it
    wide = {id(e) for e in elements if e.rule == 2 and not e.closed and 2 * (said[e.last] - said[e.first]) > said[-1]}
    gone = _spread(len(blocks), [(e.first, _lead(e, links, sizes) if id(e) in wide else e.last) for e in elements if e.rule == 2])
    before = [0, *itertools.accumulate(n * (not g) for n, g in zip(sizes, gone, strict=True))]
    articles = [0, *itertools.accumulate(i and not g for g, i in zip(gone, inside, strict=True))]

    def framing(e: _Element) -> bool:
        """Whether a marked element goes: always beside an article of its own, else unless it holds most of the text."""
        beside = articles[-1] > 0 and articles[e.first] == articles[e.last]
        if e.rule < 0 and linked[e.last] - linked[e.first] < LINK_SHARE * (said[e.last] - said[e.first]):
            return False
        return beside or 2 * (before[e.last] - before[e.first]) <= before[-1]

    weak = [(e.first, e.last) for e in elements if e.rule in (1, -1) and (e.closed or e.name != "form") and framing(e)]
    kept = [not (g or w) for g, w in zip(gone, _spread(len(blocks), weak), strict=True)]
    left = sum(n for n, k in zip(sizes, kept, strict=True) if k)
    if 0 < left <= sum(n for n, k, i in zip(sizes, kept, inside, strict=True) if k and i) / ARTICLE_SHARE:
        kept = [k and i for k, i in zip(kept, inside, strict=True)]
    return kept


def host(url: str | None) -> str:
    """The host in lower case, or an empty string."""
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


_SUBTREE = pa.struct([("hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("body", pa.int64()), ("blocks", pa.list_(pa.string())), ("subtrees", pa.list_(_SUBTREE))])


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, body, blocks, subtrees): the blocks that rules keep, and for each hash of a block element's
    subtree the kept blocks it holds, none if the rules drop it. body is a hash of the kept text, so that copies of a
    page count once."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for page_id, url, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            found = parse(page or "")
            at = [0]
            for k in found.kept:
                at.append(at[-1] + k)
            blocks = [b for b, k in zip(found.blocks, found.kept, strict=True) if k]
            subtrees = [{"hash": e.hashed, "first": at[e.first], "last": at[e.last]} for e in found.elements]
            rows.append((page_id, url, host(url), xxhash.xxh3_64_intdigest("\n".join(blocks)) - (1 << 63), blocks, subtrees))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PARSED, strict=True)], schema=_PARSED)

    return map_slices(pages.select(pages["page_id"].cast("long"), "url", "html"), run, _PARSED, text="html")


def templates(found: DataFrame, least_pages: int = 10, least_share: float = 0.3) -> DataFrame:
    """(host, gone): the hashes of each host's subtrees that `least_pages` pages of different text, and `least_share`
    of the host's, hold. A host has at most 1 / least_share times the subtrees of a page."""
    seen = found.select(F.xxhash64("host").alias("of"), "body", F.explode("subtrees.hash").alias("subtree")).distinct()
    counts = seen.groupBy("of", "subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
    # written, so that a host with very many counts can be split when they are joined
    often = written(counts, "page-subtrees")
    sizes = found.select("host", "body").distinct().groupBy("host").agg(F.count("*").alias("pages")).withColumn("of", F.xxhash64("host"))
    many = often.join(written(sizes, "page-hosts"), "of").filter(F.col("n") >= least_share * F.col("pages"))
    return written(many.groupBy("host").agg(F.collect_set("subtree").alias("gone")), "page-templates")


def extract(pages: DataFrame, least_pages: int = 10, least_share: float = 0.3) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, one line a block.

    Null and empty html give an empty text; a null url belongs to the host ''; copies of a page are extracted each,
    but count once for templates; an empty table gives no rows. Other columns are not read.
    """
    found = written(parsed(pages), "parsed-pages")
    joined = found.join(templates(found, least_pages, least_share), "host", "left")
    spans = F.filter("subtrees", lambda s: (s["first"] < s["last"]) & F.array_contains("gone", s["hash"]))
    joined = joined.withColumn("spans", F.when(F.col("gone").isNotNull(), spans))
    left = F.filter("blocks", lambda _, i: ~F.exists("spans", lambda s: (s["first"] <= i) & (i < s["last"])))
    text = F.concat_ws("\n", F.when(F.size("spans") > 0, left).otherwise(F.col("blocks")))
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
