"""Main text of web pages by differencing against the page with the nearest URL of the same host.

A page becomes a list of lines (block texts). A line's key is what it is compared by: its words, or,
for lines inside parts that markup names as page furniture (menus, headers, footers, notices, ...),
its place in the markup, since furniture keeps its place from page to page while its words change.
Pages of a host with equal lists are taken together, and the lists are sorted by host and path; the
neighbour of other content that shares the longer path prefix is the nearest. Both lists are aligned by
longest common subsequence and the lines in common go, and furniture whose place a neighbour has too.

Markup is evidence beside that. Furniture named by markup always goes, neighbour or not; a furniture name does
not count for an ancestor of the main content. A line of the marked main content (article, main) that aligns with a
neighbour goes when it recurs on the host (in more than half of the host's different lists, three at least): mirrors and
quotes must not erase an article. That holds where the marked content is no less than the page's unmarked text: teasers
are compared like any line. Where a host has no page of other content, nothing can be compared and markup decides.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitchlens.llm._common import cut, shuffle_partitions

#: Elements whose content is never text.
SILENT = {"script", "style", "noscript", "template", "svg", "canvas", "iframe", "object", "head", "title", "select", "textarea",
          "math", "audio", "video", "map"}
#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that are page furniture by themselves.
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
#: Words in class, id or role that name furniture.
FURNITURE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "complementary", "contentinfo", "cookie", "cookies", "consent", "disclaimer", "disqus", "footer", "form", "gdpr", "header",
    "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "privacy",
    "promo", "promotion", "promoted", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
#: Elements that do not end a block of text.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
          "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
          "u", "var", "wbr", "img"}
#: Elements whose end tag may be missing, and the start tags that end them.
CLOSED_BY = {"p": {"p", "div", "ul", "ol", "dl", "table", "section", "article", "aside", "nav", "header", "footer", "form", "main",
                   "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "hr", "figure", "address", "fieldset"},
             "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"},
             "th": {"td", "th", "tr"}, "option": {"option"}}
MAIN = {"article", "main"}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_WS = " \t\n\r\f\v"

TEXT, PLACE, MAIN_TEXT = 0, 1, 2


def _marks(attrs: str) -> tuple[set[str], bool]:
    """(words that name furniture, names main content)."""
    bad, main = set(), False
    for m in _NAMED.finditer(attrs):
        name, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
        if name == "hidden":
            bad.add(name)
        elif name == "style":
            bad |= {"hidden"} if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else set()
        elif name == "itemprop":
            main |= value == "articleBody"
        else:
            words = {x.lower() for x in _SPLIT.split(value) if x}
            bad |= words & FURNITURE_NAMES
            main |= name == "role" and value.lower() in MAIN
    return bad, main


class Lines:
    """One pass over the markup: block lines with their kind (plain, furniture, main) and compare key."""

    def __init__(self, page: str):
        self.text: list[str] = []
        self.kind: list[int] = []
        self.key: list[int] = []
        self.stack: list[tuple[str, str, bool, bool]] = []  # name, name with the furniture words, furniture, main
        self.held: list[str] = []
        self.bad: list[int] = []    # furniture elements that are open, by number
        self.main: list[int] = []   # main elements that are open, by number
        self.n_bad = 0
        self.around: list[tuple[int, ...]] = []  # per main element the furniture elements around it
        self.spots: list[tuple[tuple[int, ...], tuple[int, ...], str]] = []  # per line: furniture, main elements, place
        self._read(page)
        self._settle()

    def _flush(self) -> None:
        if not self.held:
            return
        line = " ".join(entities.unescape("".join(self.held)).split())
        self.held.clear()
        if not line:
            return
        where = "/".join(label for n, label, bad, _ in self.stack if bad or n not in INLINE) if self.bad else ""
        self.text.append(line)
        self.spots.append((tuple(self.bad), tuple(self.main), where))

    def _settle(self) -> None:
        """Kinds and keys, when the whole page is known."""
        of_main, of_bad = [0] * len(self.around), [0] * self.n_bad
        for line, (bad, main, _) in zip(self.text, self.spots):
            for k in main:
                of_main[k] += len(line)
            for k in bad:
                of_bad[k] += len(line)
        if of_main:  # names of elements around the largest main element say nothing about it
            spared = set(self.around[of_main.index(max(of_main))])
        else:
            half = sum(map(len, self.text)) / 2
            spared = {k for k, n in enumerate(of_bad) if n > half}
        size = [0, 0, 0]
        for line, (bad, main, _) in zip(self.text, self.spots):
            self.kind.append(PLACE if not spared.issuperset(bad) else MAIN_TEXT if main else TEXT)
            size[self.kind[-1]] += len(line)
        if size[MAIN_TEXT] < size[TEXT]:  # cards and teasers beside a body that is not marked
            self.kind = [TEXT if k == MAIN_TEXT else k for k in self.kind]
        for line, kind, (_, _, where) in zip(self.text, self.kind, self.spots):
            self.key.append(xxhash.xxh64_intdigest(f"{kind == PLACE}\n{where if kind == PLACE else line}".encode("utf-8", "replace")) >> 1)

    def _push(self, name: str, words: set[str], bad: bool, main: bool) -> None:
        self.stack.append((name, ".".join([name, *sorted(words)]), bad, main))
        if bad:
            self.bad.append(self.n_bad)
            self.n_bad += 1
        if main:
            self.main.append(len(self.around))
            self.around.append(tuple(self.bad))

    def _pop(self, to: int) -> None:
        while len(self.stack) > to:
            _, _, bad, main = self.stack.pop()
            if bad:
                self.bad.pop()
            if main:
                self.main.pop()

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.search(page, at)
            if m is None:
                self.held.append(page[at:])
                break
            if m.start() > at:
                self.held.append(page[at:m.start()])
            at = m.end()
            name = m.group(2)
            if name is None:
                if m.group(0).startswith("<![CDATA["):
                    self.held.append(entities.escape(m.group(0)[9:].removesuffix("]]>")))
                continue
            name = name.lower()
            if name in INLINE and not (m.group(3) and "=" in m.group(3)):
                self._inline(name, bool(m.group(1)))
                continue
            at = self._tag(page, at, name, bool(m.group(1)), m.group(3) or "")
        self._flush()

    def _inline(self, name: str, end: bool) -> None:
        """Inline elements without attributes change nothing that is compared."""
        if end:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == name:
                    if self.stack[k][2]:
                        self._flush()
                    if all(x[0] in INLINE for x in self.stack[k:]):
                        self._pop(k)
                    return
                if self.stack[k][0] not in INLINE:
                    return

    def _tag(self, page: str, at: int, name: str, end: bool, attrs: str) -> int:
        if end:
            if name in INLINE:
                self._inline(name, True)
                return at
            self._flush()
            if name == "br":
                return at
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == name:
                    self._pop(k)
                    break
            return at
        if name in SILENT:
            if name not in ("svg", "math"):
                self._flush()
            if attrs.rstrip().endswith("/"):
                return at
            close = re.compile(f"</{re.escape(name)}[\\s>/]", re.I).search(page, at)
            if close is None:  # never closed: an unclosed head ends where the body starts, others take the rest
                body = re.compile(r"<body[\s>]", re.I).search(page, at) if name in ("head", "title") else None
                return body.start() if body else len(page)
            return close.start()
        words, main = _marks(attrs) if attrs else (set(), False)
        if name in INLINE:
            if words:
                self._flush()
            if name not in VOID and not attrs.rstrip().endswith("/"):
                self._push(name, words, bool(words), False)
            return at
        self._flush()
        while self.stack and name in CLOSED_BY.get(self.stack[-1][0], ()):
            self._pop(len(self.stack) - 1)
        if name in VOID:
            return at
        if name in ("body", "html"):
            words = set()
        bad = bool(words) or name in FURNITURE and not (name == "header" and self.main)
        self._push(name, words, bad, main or name in MAIN)
        return at


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of a that are in a longest common subsequence with b."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[len(a) - 1 - hi] == b[len(b) - 1 - hi]:
        hi += 1
    ends = np.append(np.arange(lo), np.arange(len(a) - hi, len(a)))
    x, y = a[lo:len(a) - hi], b[lo:len(b) - hi]
    ix, iy = np.flatnonzero(np.isin(x, y)), np.flatnonzero(np.isin(y, x))  # lines of one side only never match
    if not len(ix):
        return ends
    return np.sort(np.append(ends, lo + ix[_lcs(x[ix], y[iy])]))


def _lcs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hirschberg's halving over row-wise numpy updates: memory stays linear in the lines."""
    if not len(x) or not len(y):
        return np.zeros(0, np.int64)
    if len(x) == 1:
        return np.zeros(1, np.int64) if (y == x[0]).any() else np.zeros(0, np.int64)
    order = np.argsort(y, kind="stable")
    lo, hi = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
    if int((hi - lo).sum()) * 16 < len(x) * len(y):
        return _by_matches(order, lo, hi)
    mid = len(x) // 2
    total = _lengths(x[:mid], y) + _lengths(x[:mid - 1:-1] if mid else x[::-1], y[::-1])[::-1]
    cut_at = int(total.argmax())
    return np.append(_lcs(x[:mid], y[:cut_at]), mid + _lcs(x[mid:], y[cut_at:])).astype(np.int64)


def _by_matches(order: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Longest common subsequence from the matching pairs (Hunt and Szymanski): about pairs x log(lines) steps.

    order[lo[i]:hi[i]] are the places in y, ascending, that match line i of x.
    """
    ends: list[int] = []           # smallest end in y of a common subsequence of each length
    last: list[int] = []           # its last pair
    line, before = [], []          # of every pair that improved an end
    places = order.tolist()
    for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
        for k in range(b - 1, a - 1, -1):
            j = places[k]
            at = bisect_left(ends, j)
            if at < len(ends) and ends[at] == j:
                continue
            line.append(i)
            before.append(last[at - 1] if at else -1)
            ends[at:at + 1], last[at:at + 1] = [j], [len(line) - 1]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(line[k])
        k = before[k]
    return np.array(out[::-1], np.int64)


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    row = np.zeros(len(y) + 1, np.int64)
    for v in x:
        row[1:] = np.maximum(row[1:], row[:-1] + (y == v))
        np.maximum.accumulate(row, out=row)
    return row


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (lower case, without user, port, www. or m.) and path; unusual URLs keep what can be read."""
    u = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(u, r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(host, r"^(?:www|m)\.", ""), path


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, kinds = [], []
        for page in b.column(b.num_columns - 1).to_pylist():
            lines = Lines(page or "")
            keys.append(np.array(lines.key, np.int64).tobytes())
            kinds.append(bytes(lines.kind))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(keys, pa.binary()), pa.array(kinds, pa.binary())],
                                         ["row", "host", "path", "keys", "kinds"])


def neighbours(lines: DataFrame, parts: int) -> DataFrame:
    """host, list, path, keys, kinds, prev, next: one row per distinct line list of a host.

    Pages of a host with equal lists (mirrors, other query strings) are one row, at the first of their paths, so
    a run of copies of any length has the pages of other lists as neighbours (NULL: none on the host). Pages
    without a line are left out. Lists are dealt by ranges of (host, path, list), which also cuts a host with
    a third of all pages; the edges of ranges are one row each and are exchanged through a small table.
    """
    lists = (lines.where("length(keys) > 0").groupBy("host", "list")
             .agg(F.min("path").alias("path"), F.first("keys").alias("keys"), F.first("kinds").alias("kinds")))
    ranged = cut(lists.repartitionByRange(parts, "host", "path", "list").withColumn("part", F.spark_partition_id()))
    w = W.partitionBy("part").orderBy("host", "path", "list")
    page = F.struct("host", "path", "keys")
    near = ranged.withColumns({"prev": F.lag(page).over(w), "next": F.lead(page).over(w)})
    # One row per range: its first and last list; ranges follow each other in order of their number.
    order = F.struct("host", "path", "list")
    ends = ranged.groupBy("part").agg(F.min_by(page, order).alias("head"), F.max_by(page, order).alias("tail"))
    line = W.partitionBy().orderBy("part")
    edge = ends.select("part", F.lag("tail").over(line).alias("before"), F.lead("head").over(line).alias("after"))
    both = near.join(F.broadcast(edge), "part").select(
        "host", "list", "path", "keys", "kinds", F.coalesce("prev", "before").alias("prev"), F.coalesce("next", "after").alias("next"))
    return both.select("host", "list", "path", "keys", "kinds", F.when(F.col("prev.host") == F.col("host"), F.col("prev")).alias("prev"),
                       F.when(F.col("next.host") == F.col("host"), F.col("next")).alias("next"))


def _shared_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per list of lines a byte per line, 1 where the line goes, and the keys of its marked lines that align with a
    neighbour.

    A neighbour that holds all of a page's content (its marked lines, or the unmarked ones of a page without)
    is a copy of it and tells nothing about unmarked lines: then the other neighbour is asked. Unmarked lines
    beside marked main content go where no page is left to ask.
    """
    for b in batches:
        gone, shared = [], []
        for r in b.to_pylist():
            own, kinds = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["kinds"], np.uint8)
            near = sorted((x for x in (r["prev"], r["next"]) if x), key=lambda x: -_shared_prefix(x["path"], r["path"]))
            plain, main = kinds == TEXT, kinds == MAIN_TEXT
            content = main if main.any() else plain
            mask, held, settled = kinds == PLACE, np.zeros(len(own), bool), False
            for x in near:
                found = np.zeros(len(own), bool)
                found[common(own, np.frombuffer(x["keys"], np.int64))] = True
                held |= found & main
                if not settled and not found[content].all():
                    mask |= found & plain
                    settled = True
            if not settled:
                mask |= plain & main.any()
            gone.append(mask.astype(np.uint8).tobytes())
            shared.append(np.unique(own[held]).tolist())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gone, pa.binary()), pa.array(shared, pa.list_(pa.int64()))],
                                         ["host", "list", "gone", "shared"])


def recurring(masks: DataFrame) -> DataFrame:
    """host, list, again: the keys of a list's marked lines that align with a neighbour in more than half of the
    different lists of the host, and in three at least."""
    lists = masks.groupBy("host").agg(F.count(F.lit(1)).alias("lists"))
    held = masks.where(F.size("shared") > 0).select("host", "list", F.explode("shared").alias("key"))
    often = (held.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").join(lists, "host").where("2 * n > lists")
             .select("host", "key"))
    # At most as many keys as the list has lines.
    return held.join(often, ["host", "key"]).groupBy("host", "list").agg(F.collect_list("key").alias("again"))


def _shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for page, gone, again in zip(*(c.to_pylist() for c in b.columns[-3:]), strict=True):
            lines, often = Lines(page or ""), set(again or ())
            out.append(" ".join(t for t, g, kind, key in zip(lines.text, gone or b"", lines.kind, lines.key)
                                if not g and not (kind == MAIN_TEXT and key in often)))
        text = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns[:-3], text, pa.compute.utf8_length(text).cast(pa.int64())],
                                         [*b.schema.names[:-3], "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) per input row.

    NULL or empty html gives an empty text, a NULL url is a host of its own without a name, repeated rows
    each get the same text: the lines that no page of other content on the host shares and those of the
    marked main content that do not recur on the host. A very long page is read whole; two pages of many lines are
    aligned in time of their matching pairs, or of the product of their repeated lines if these are most.
    """
    parts = [F.col(id_col).cast("string"), F.col(url_col), F.col(html_col)]
    row = F.unhex(F.md5(F.concat(*[x for c in parts for x in (F.when(c.isNull(), "-").otherwise("+"), F.coalesce(c, F.lit("")), F.lit("\n"))])
                        .cast("binary")))
    host, path = host_path(F.col(url_col))
    keyed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), row.alias("row"))
    lines = (pages.select(row.alias("row"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
             .mapInArrow(_listed, "row binary, host string, path string, keys binary, kinds binary").dropDuplicates(["row"]))
    lines = cut(lines.withColumn("list", F.unhex(F.md5(F.concat("keys", "kinds")))))
    masks = cut(neighbours(lines, shuffle_partitions(pages.sparkSession))
                .mapInArrow(_shared_lines, "host string, list binary, gone binary, shared array<long>"))
    both = masks.select("host", "list", "gone").join(recurring(masks), ["host", "list"], "left")
    gone = lines.select("row", "host", "list").join(both, ["host", "list"], "left").select("row", "gone", "again")
    kind = pages.schema[id_col].dataType.simpleString()
    return (keyed.join(gone, "row", "left").select("page_id", "url", "html", "gone", "again")
            .mapInArrow(_texts, f"page_id {kind}, url string, text string, n_chars long"))
