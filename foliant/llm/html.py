"""Main text of web pages by structure and nearest-URL page differencing.

A page is read into blocks, each with a region: 'main' (inside article, main or an element with such a role), 'boiler'
(menus, headers, footers, sidebars, notices, adverts, forms, reader comments, by tag, role, class or id) or 'open'.
Main blocks are text. Structure says nothing of open blocks, be there main blocks beside them or not:
of each host's distinct lists of open lines a representative is sorted by host and URL path, each is paired with the
neighbour of the same host whose path shares the longer prefix (so never with a copy), its result goes to all pages
with that list, their open lines are aligned by longest common subsequence, and shared lines are deleted, as are
blocks that are mostly links. Lines inside a page's main element are never deleted for being shared, since copies of
an article on two pages would lose their text.

Pages are sorted by range partitions with sampled bounds; a host may span many, and the pages at bounds are paired
through a table of two rows a partition. Only hashes of lines are sorted; pages join their neighbour's hashes.

Defined results: null or empty html gives empty text; null url has no host and is paired with none; a page without
a neighbour whose lines differ keeps its open blocks; copies (same lines) of a host get equal text; unclosed and cut tags are read as far as they go; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from itertools import pairwise
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, small

# Elements that reach to their end tag or the page's end, elements without page text that end with their
# parent, boilerplate elements, main elements, elements that end a block, and words
# of class and id that mark boilerplate.
READ_ON = ["script", "style", "noscript", "iframe", "textarea", "title"]
MUTE = {"template", "svg", "object", "canvas", "audio", "video", "select", "button", "option", "datalist"}
BOILER = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset", "search"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "status", "toolbar"}
MAIN = {"article", "main"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
MARKS = set(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot adbox adunit banner sponsor sponsors sponsored promo promos sidebar sidebars sidenav sidemenu nav navbar navigation"
    " navmenu menu menus menubar breadcrumb breadcrumbs crumbs masthead topbar toolbar footer header cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay"
    " subscribe subscription newsletter signup login paywall comment comments commentlist disqus responses replies respond share sharing social related recommended recommendations teaser teasers"
    " trending widget widgets pagination pager tags taglist outbrain taboola skiplink disclaimer copyright".split()
)
#: What a word with hyphens may end in, after one of MARKS, or begin with, before one.
MARK_ENDS = set("area bar block box button buttons container form icons label link links list menu message popup section slot unit widget wrap wrapper".split()) | MARKS
MARK_STARTS = set("bottom global left main page post right side site skip sticky top".split())


def is_mark(word: str) -> bool:
    """Whether a word of class or id names boilerplate: 'ad', 'cookie-banner', 'site-footer'; not 'share-price' or 'navy'."""
    parts = [p for p in re.split("[-_]+", word) if p]
    if len(parts) < 2:
        return word in MARKS
    if parts[0] in ("comment", "comments"):
        return True
    return parts[0] in MARKS and parts[-1] in MARK_ENDS or parts[0] in MARK_STARTS and parts[-1] in MARKS


LINK_SHARE = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for n in READ_ON}
#: Elements that a start tag ends where they are still open, and the elements that it doesn't look beyond.
_ITEM, _CELL = {"ul", "ol", "menu"}, {"table"}
_ENDS = {"li": ({"li"}, _ITEM), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, _CELL), "th": ({"td", "th"}, _CELL), "tr": ({"tr"}, _CELL), "option": ({"option"}, {"select", "datalist"} | BLOCK), "button": ({"button"}, BLOCK)}
#: Elements beyond which an end tag doesn't look.
_SCOPE = {"li": _ITEM, "dt": {"dl"}, "dd": {"dl"}, "td": _CELL, "th": _CELL, "tr": _CELL, "p": BLOCK - {"p"}}
#: Start tags of text inside <svg> or <math>, which end it.
_BREAKOUT = (BLOCK | {"b", "big", "code", "em", "i", "img", "s", "small", "span", "strong", "strike", "sub", "sup", "tt", "u"}) - {"caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
_FOREIGN, _INSIDE = {"svg", "math"}, {"foreignobject", "desc", "mi", "mo", "mn", "ms", "mtext", "annotation-xml"}
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)


def _region(name: str, attrs: str, around: str) -> str:
    """The region that an element opens inside region `around`."""
    if around in ("boiler", "mute"):
        return around
    if name in MUTE:
        return "mute"
    role = ""
    if attrs:
        for key, *values in _ATTR.findall(attrs):
            key, value = key.lower(), "".join(values).lower()
            if key == "role":
                role = value
            elif key in ("class", "id") and name not in ("html", "body") and any(is_mark(w) and not (w == "header" and around == "main") for w in value.split()):
                return "boiler"
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                return "boiler"
    if role in BOILER_ROLES or name in BOILER and not (name == "header" and around == "main"):
        return "boiler"
    return "main" if name in MAIN or role in ("main", "article") else around


def blocks(page: str) -> list[tuple[str, str, float]]:
    """(region, text, share of link text) of each block in page order; references decoded, white space made single."""
    out, parts, linked, at = [], [], 0, 0
    region = shown = "open"  # shown: the region of the parts at hand, which a mute element leaves as it is
    stack: list[tuple[str, str, bool]] = []  # open elements: name, region around, whether it opened another
    opened: Counter[str] = Counter()
    anchors = 0

    def close():
        nonlocal parts, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((shown, text, min(1.0, linked / max(1, len(text)))))
        parts, linked = [], 0

    def keep(piece):
        nonlocal linked
        if piece and region != "mute":
            parts.append(piece)
            linked += len(piece) if anchors else 0

    def enter(new):
        nonlocal region, shown
        if new not in ("mute", shown):
            close()
            shown = new
        region = new

    def end(k):
        """Ends the element at place k of the stack and all inside it."""
        enter(stack[k][1])
        opened.subtract(n for n, _, _ in stack[k:])
        del stack[k:]

    def end_tag(name):
        stops, inline, crossed = _SCOPE.get(name, ()), name not in BLOCK and name not in MUTE, False
        for k in range(len(stack) - 1, -1, -1):
            n, _, changed = stack[k]
            if n == name:
                if changed or not (inline and crossed):
                    end(k)
                return
            if n in stops:
                return
            crossed = crossed or n in BLOCK

    def implied_ends(name):
        """Ends what a start tag ends without an end tag."""
        if (opened["svg"] or opened["math"]) and name in _BREAKOUT:
            k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in _FOREIGN | _INSIDE)
            if stack[k][0] in _FOREIGN:
                end(k)
        if opened["p"] and name in BLOCK:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    end(k)
                    break
                if stack[k][0] in BLOCK or stack[k][0] in MUTE:
                    break
        ended, stops = _ENDS.get(name, ((), ()))
        if any(opened[n] for n in ended):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ended:
                    end(k)
                    break
                if stack[k][0] in stops:
                    break

    while m := _TOKEN.search(page, at):
        keep(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        ends, is_block = bool(m["end"] or m["end2"]), name in BLOCK
        if is_block and region != "mute":
            close()
        if not ends and name not in VOID:
            implied_ends(name)
        elif ends and opened[name]:
            end_tag(name)
        if region != "mute":
            if name == "a":
                anchors = max(0, anchors + (-1 if ends else 1))
            if is_block:
                close()
                if name in ("p", "li", "div", "td"):
                    anchors = 0
        if ends or name in VOID or m[0].endswith("/>") and (name in _FOREIGN or opened["svg"] or opened["math"]):
            continue
        if name in _RAW_END:
            over = _RAW_END[name].search(page, at)
            at = over.end() if over else len(page)
            continue
        inner = _region(name, m["attrs"] or "", region)
        stack.append((name, region, inner != region))
        opened[name] += 1
        enter(inner)
    keep(page[at:])
    close()
    return out


def host_and_path(url: str | None) -> tuple[str | None, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.netloc.lower() or None), parts.path
    except ValueError:
        return None, ""


def line_hash(text: str) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh64_digest(text.encode()), "little", signed=True)


def _places(y: list[int]) -> tuple[dict[int, int], int]:
    """The places of each line as bits, and all bits."""
    places: dict[int, int] = {}
    for j, h in enumerate(y):
        places[h] = places.get(h, 0) | 1 << j
    return places, (1 << len(y)) - 1


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of x and each prefix of y."""
    places, row = _places(y)
    full = row
    for h in x:
        u = row & places.get(h, 0)
        row = (row + u | row - u) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def common_lines(own: list[int], other: list[int]) -> set[int]:
    """Places in own of a longest common subsequence of both.

    Equal ends are taken off; then half of own is aligned with every prefix of other and the other half with every
    suffix, which tells where to part both (Hirschberg), at all sizes alike. Rows are bits of one number.
    """
    a, z = 0, 0
    while a < min(len(own), len(other)) and own[a] == other[a]:
        a += 1
    while z < min(len(own), len(other)) - a and own[-1 - z] == other[-1 - z]:
        z += 1
    shared = set(range(a)) | set(range(len(own) - z, len(own)))
    y = other[a : len(other) - z]
    known = set(y)
    at = [i for i in range(a, len(own) - z) if own[i] in known]  # lines that other lacks are in no alignment
    if len(at) <= 1:
        return shared | set(at)
    x, mid = [own[i] for i in at], len(at) // 2
    split = int(np.argmax(_lengths(x[:mid], y) + _lengths(x[mid:][::-1], y[::-1])[::-1]))
    upper, lower = common_lines(x[:mid], y[:split]), common_lines(x[mid:], y[split:])
    return shared | {at[i] for i in upper} | {at[mid + i] for i in lower}


def main_text(page: str | None, other: list[int] | None = None) -> str:
    """A page's text; other: hashes of the open lines of its neighbour, empty if it has none; None: by structure alone."""
    found = blocks(page or "")
    if other is None and any(r == "main" for r, _, _ in found):
        return " ".join(t for r, t, _ in found if r == "main")
    places = [i for i, (r, _, _) in enumerate(found) if r == "open"]
    shared = {places[i] for i in common_lines([line_hash(found[i][1]) for i in places], other)} if other else set()
    return " ".join(t for i, (r, t, s) in enumerate(found) if r == "main" or r == "open" and i not in shared and s <= LINK_SHARE)


def list_digest(lines: list[int]) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(np.array(lines, dtype=np.int64).tobytes())


def undecided(pages: DataFrame) -> DataFrame:
    """(k, page_id, host, path, lines, digest of lines) of the pages that need a neighbour: with open blocks and a host."""

    def run(batches):
        for b in batches:
            out = []
            for k, page_id, url, page in zip(*(b.column(i).to_pylist() for i in range(4))):
                found = blocks(page or "")
                host, path = host_and_path(url)
                if host and (lines := [line_hash(t) for r, t, _ in found if r == "open"]):
                    out.append((k, page_id, host, path, lines, list_digest(lines)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.binary()))], names=["k", "page_id", "host", "path", "lines", "digest"])

    return pages.select(_key(), F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "k long, page_id long, host string, path string, lines array<long>, digest binary")


def _key():
    return F.xxhash64("page_id", "url", "html").alias("k")


_PAIR = "kind string, k long, page_id long, near int, other long, lines array<long>, host string, path string"
_PAIR_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string())


def _paired(batches, edges: bool):
    """Rows in order -> for each two that follow one another on a host a row for both, and the first and last as edges.

    edges: the rows are edges of several partitions, without lines; the last of one is paired with the first of the next.
    """

    def near(x, y, bonus):
        n = next((i for i, (p, q) in enumerate(zip(x[3], y[3])) if p != q), min(len(x[3]), len(y[3])))
        return ("pair", x[0], x[1], 2 * n + bonus, y[0], None if edges else y[4], None, None)

    end = lambda kind, x: (kind, x[0], x[1], None, None, None, x[2], x[3])
    out_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PAIR_TYPES)], names=[c.split()[0] for c in _PAIR.split(", ")])
    last, first = None, True
    for b in batches:
        rows = list(zip(*(b.column(i).to_pylist() for i in range(b.num_columns))))
        out = []
        if rows and first and not edges:
            out.append(end("first", rows[0]))
        first = first and not rows
        for x, y in pairwise([*([last] if last else []), *rows]):
            if x[2] == y[2] and (not edges or (x[4], y[4]) == ("last", "first")):
                out += [near(x, y, 0), near(y, x, 1)]
        last = rows[-1] if rows else last
        if out:
            yield out_of(out)
    if last and not edges:
        yield out_of([end("last", last)])


def neighbours(keys: DataFrame) -> DataFrame:
    """(k, other: the lines of the nearest page by URL whose lines differ) for each page of undecided() with such a page on its host."""
    first = F.min_by(F.struct("k", "page_id", "path", "lines"), F.struct("path", "page_id", "k")).alias("first")
    single = materialize(keys.groupBy("host", "digest").agg(first).select("host", "digest", "first.*"), "distinct-pages")
    order = ["host", "path", "page_id", "k"]
    found = materialize(single.select("k", "page_id", "host", "path", "lines").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda b: _paired(b, False), _PAIR), "page-pairs")
    # two short rows a partition; lines of those few pairs are joined afterwards
    ends = found.filter("kind != 'pair'").select("k", "page_id", "host", "path", "kind").coalesce(1).sortWithinPartitions(*order, "kind").mapInArrow(lambda b: _paired(b, True), _PAIR)
    across = ends.drop("lines").join(single.select(F.col("k").alias("other"), "lines"), "other")
    best = found.filter("kind = 'pair'").unionByName(across, allowMissingColumns=True).groupBy("k", "page_id").agg(F.max(F.struct("near", "lines")).alias("best"))
    of_list = single.select("k", "host", "digest").join(best.select("k", F.col("best.lines").alias("other")), "k").drop("k")
    return keys.select("k", "host", "digest").dropDuplicates(["k"]).join(of_list, ["host", "digest"]).select("k", "other")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        for b in batches:
            texts = [main_text(h, o or []) for h, o in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    keys = materialize(undecided(pages), "undecided-pages")
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    if keys.isEmpty():
        rows = rows.withColumn("other", F.lit(None).cast("array<long>"))
    else:
        near = materialize(neighbours(keys), "neighbours")
        rows = rows.withColumn("k", _key()).join(small(near), ["k"], "left").select("page_id", "url", "html", "other")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
