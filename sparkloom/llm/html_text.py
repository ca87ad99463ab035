"""Main text of web pages with site template removal.

A page is parsed into elements and text blocks. Site templates are found by counting, per host in Spark, on how
many pages an element subtree recurs, in two forms: as it is (tags and text), and as structure (tags,
names and position, with text and link targets left out) where links hold most of it, as in menus whose entries
differ from page to page. Containers on ``SHARE`` of a host's pages, single blocks on ``BLOCK_SHARE``, structures on ``SHAPE_SHARE`` are
deleted there, at least ``MIN_PAGES`` pages each, and containers on ``MANY`` pages whatever the share. Pages count as different only if
their own longest text differs: a group of copied articles, though it may be a third of all pages, is one of these,
and ``MIN_ARTICLES`` are asked for.

Beside this, elements whose tag, role or class says that they are menus,
headers, footers, sidebars, notices, adverts, forms, scripts or comments are dropped (``names=False`` leaves
that to the counts, but for scripts and other raw elements). What remains inside the page's article (else its main part, else its body) is the text.

Counts are combined map-side and keyed by (host, hash), so a host with a third of all pages is spread over
its hashes. The recurring hashes are sent to the executors only if they number at
most ``BROADCAST_ROWS``; beyond, each page is joined with its own marks. Pages are never shuffled in
the first way, and parsed twice rather than stored.

Defined results: null or empty html gives the empty text; a null or malformed url is a host of
its own (the empty name); repeated rows count as pages each, but as one article; an empty table gives an empty result; other
columns are ignored. Broken markup is read as browsers do in the main cases: unclosed
elements end with their parent, stray end tags are skipped, a quote that is never closed ends with its tag, an unfinished tag at the end is dropped.
Time is linear in the length of a page.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow
from sparkloom.storage import table

#: Shares of a host's pages for containers, single blocks and structures; pages and articles at least; pages that suffice.
SHARE, BLOCK_SHARE, SHAPE_SHARE, MIN_PAGES, MIN_ARTICLES, MANY = 0.2, 0.5, 0.5, 5, 3, 200
BROADCAST_ROWS = 500_000

_OPENING = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?])")
_EDGE = re.compile(r"[>=]")
_QUOTED = re.compile(r"\s*([\"'])")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title svg math object audio video canvas select".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_STOPS = frozenset("ul ol dl table div section article main body".split())
_KEPT_WHOLE = frozenset("html body main article".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTAINERS = frozenset("aside center dd details dialog div dl fieldset footer form header menu nav ol section table ul".split())
_DROP_TAGS = frozenset("head nav header footer aside form button dialog menu".split()) | _RAW
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Names of furniture: alone; as the last word of a name; and as the first before a word for a box.
_DROP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr"
    " notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar aside menu nav navbar navigation"
    " breadcrumb breadcrumbs footer masthead topbar comment comments disqus respond replies reply share sharing social"
    " related recommended recommendations pagination pager toolbar login searchbox searchform skiplink header".split()
)
_LAST_NAMES = frozenset(
    "footer nav navbar navigation menu sidebar breadcrumb breadcrumbs masthead topbar banner popup modal overlay pagination pager toolbar comments advert"
    " adverts advertisement ads ad newsletter".split()
)
_BOXES = frozenset(
    "bar bars box boxes banner block button buttons col column container form icon icons inner item items label link links list"
    " message panel row section slot slots top unit widget widgets wrap wrapper".split()
)
_NOT_NAMES = frozenset("has no with without is".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found.group(1).lower() if found else ""


def _named_away(value: str) -> bool:
    """Whether a class or id names page furniture: alone, before words for boxes, or as its last word."""
    for name in value.split():
        parts = [p.lower() for p in _NAME.findall(name)]
        if not parts:
            continue
        boxed = len(parts) > 1 and parts[0] in _DROP_NAMES and all(x in _BOXES or x in _DROP_NAMES or x.isdigit() for x in parts[1:])
        if "".join(parts) in _DROP_NAMES or boxed or (parts[-1] in _LAST_NAMES and parts[0] not in _NOT_NAMES):
            return True
    return False


def _dropped(tag: str, raw: str) -> bool:
    if tag in _DROP_TAGS:
        return True
    if not raw or tag in _KEPT_WHOLE or tag in _HEADINGS:
        return False
    for m in _ATTRIBUTE.finditer(raw):
        key = m.group(1).lower()
        value = m.group(2) or m.group(3) or m.group(4) or ""
        if key in ("class", "id"):
            if _named_away(value):
                return True
        elif key == "role":
            if value.lower() in _DROP_ROLES:
                return True
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _hash(*parts: bytes) -> int:
    return xxhash.xxh64_intdigest(b"\x00".join(parts)) >> 1


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


class Page:
    """Elements in page order: ``tags``, ``parents``, ``drops``, ``hashes``, ``shapes``; ``blocks`` of (element, piece).

    ``hashes`` are of subtrees as they are, ``shapes`` of their structure and position where links hold most of the text.
    """

    def __init__(self, source: str, names: bool = True) -> None:
        self.tags, self.parents, self.drops, self.hashes, self.shapes, self.places = [""], [0], [False], [0], [0], [0]
        self.blocks: list[list[tuple[int, str]]] = []
        self._names = names
        self._open: list[int] = [0]
        self._count: Counter[str] = Counter()
        self._inner: list[list[bytes]] = [[]]
        self._form: list[list[bytes]] = [[]]
        self._chars: list[list[int]] = [[0, 0]]
        self._block: list[tuple[int, str]] = []
        self._forms: set[int] = set()
        self._parse(source)

    def _text(self, piece: str) -> None:
        if "&" in piece:
            piece = references.unescape(piece)
        self._block.append((self._open[-1], piece))
        if flat := " ".join(piece.split()):
            self._inner[-1].append(flat.encode("utf-8", "surrogatepass"))
            self._chars[-1][0] += len(flat)
            self._chars[-1][1] += len(flat) * (self._count["a"] > 0)

    def _flush(self) -> None:
        if self._block:
            self.blocks.append(self._block)
            self._block = []

    def _close(self) -> None:
        at, inner, form, (chars, linked) = self._open.pop(), self._inner.pop(), self._form.pop(), self._chars.pop()
        self._count[self.tags[at]] -= 1
        if self.tags[at] in _BLOCK:
            self._flush()
        if inner:
            tag = self.tags[at].encode("utf-8", "replace")
            self.hashes[at] = _hash(tag, *inner)
            self._inner[-1].append(self.hashes[at].to_bytes(8, "little"))
            shape = _hash(tag, self.places[at].to_bytes(8, "little"), *form)
            if 2 * linked > chars:
                self.shapes[at] = shape
            mark = shape.to_bytes(8, "little")
            if self._form[-1][-1:] != [mark]:  # lists of another length have the same structure
                self._form[-1].append(mark)
            self._chars[-1][0] += chars
            self._chars[-1][1] += linked

    def _enter(self, tag: str, raw: str) -> None:
        if tag in _BLOCK:
            self._flush()
            if self._count["p"] and tag not in ("html", "body"):
                while self.tags[self._open[-1]] != "p":
                    self._close()
                self._close()
        if any(self._count[x] for x in _CLOSES.get(tag, ())):
            for depth in range(len(self._open) - 1, 0, -1):
                name = self.tags[self._open[depth]]
                if name in _CLOSES[tag]:
                    while len(self._open) > depth:
                        self._close()
                    if tag != "tr":
                        break
                elif name in _STOPS:
                    break
        up = self._open[-1]
        named = " ".join(sorted(m.group(2) or m.group(3) or m.group(4) or "" for m in _ATTRIBUTE.finditer(raw) if m.group(1).lower() == "class")) if "class" in raw else ""
        self.tags.append(tag)
        self.parents.append(up)
        self.places.append(_hash(self.places[up].to_bytes(8, "little"), tag.encode("utf-8", "replace"), named.encode("utf-8", "replace")))
        if tag == "form" and not _dropped("div", raw):
            self._forms.add(len(self.tags) - 1)
        nested = tag == "article" and self._count["article"] > 0
        self.drops.append(self._names and _dropped("section" if nested else tag, raw))
        self.hashes.append(0)
        self.shapes.append(0)
        self._open.append(len(self.tags) - 1)
        self._count[tag] += 1
        self._inner.append([])
        self._form.append([])
        self._chars.append([0, 0])

    def _parse(self, source: str) -> None:
        at, end, unclosed = 0, len(source), set()

        def tag_end(pos: int) -> int:
            """After the ``>`` of a tag, or -1; quotes count only where a value begins, and only if they are closed."""
            while (m := _EDGE.search(source, pos)) is not None:
                pos = m.end()
                if m.group() == ">":
                    return pos
                if (q := _QUOTED.match(source, pos)) and q.group(1) not in unclosed:
                    close = source.find(q.group(1), q.end())
                    if close < 0:
                        unclosed.add(q.group(1))
                    else:
                        pos = close + 1
            return -1

        while at < end:
            m = _OPENING.search(source, at)
            if m is None:
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            tag = m.group(2)
            if tag is None:
                mark = "-->" if m.group() == "<!--" else ">"
                close = source.find(mark, m.end())
                at = end if close < 0 else close + len(mark)
                continue
            at = tag_end(m.end())
            if at < 0:
                at = end  # an unfinished tag
                break
            raw = source[m.end() : at - 1]
            tag = tag.lower()
            if m.group(1):
                for depth in range(len(self._open) - 1, 0, -1) if self._count[tag] else ():
                    if self.tags[self._open[depth]] == tag:
                        while len(self._open) > depth:
                            self._close()
                        break
                    if tag not in _BLOCK and self.tags[self._open[depth]] in _BLOCK:
                        break
                continue
            if tag in _RAW:
                close = _raw_end(tag).search(source, at)
                at = close.end() if close else end
            elif tag == "br":
                self._block.append((self._open[-1], " "))
            elif tag in _VOID:
                if tag == "hr":
                    self._flush()
            else:
                self._enter(tag, raw)
                if raw.endswith("/") and tag not in _BLOCK:
                    self._close()
        if at < end:
            self._text(source[at:])
        while len(self._open) > 1:
            self._close()
        self._flush()
        self._keep_main()

    def _keep_main(self) -> None:
        """Furniture does not hold the article: what is around the page's own article or main part is not dropped.

        A form around one is the page's, unless named as furniture. Nothing else is to be done where one with text is in nothing dropped; where all are, the one in
        fewest dropped elements counts, and of these the one with most text.
        """
        regions = [i for i in range(1, len(self.tags)) if self.tags[i] in ("article", "main")]
        if not regions:
            return
        for up in {self.parents[i] for i in regions}:
            while up:
                if up in self._forms:
                    self.drops[up] = False
                up = self.parents[up]
        inside, depth, chars = ([0] * len(self.tags) for _ in range(3))
        for i in range(1, len(self.tags)):
            depth[i] = depth[self.parents[i]] + self.drops[i]
        for b in self.blocks:
            for i, piece in b:
                chars[i] += len(piece.strip())
        for i in range(len(self.tags) - 1, 0, -1):
            inside[i] += chars[i]
            inside[self.parents[i]] += 0 if self.drops[i] else inside[i]
        if any(depth[i] == 0 and inside[i] for i in regions):
            return
        up = self.parents[min(regions, key=lambda i: (not inside[i], depth[i], -inside[i], i))]
        while up:
            self.drops[up] = False
            up = self.parents[up]

    def article(self) -> int:
        """A hash of the page's own text: its longest block in an article or main part, else its two longest."""
        inside = [False] * len(self.tags)
        for i in range(1, len(self.tags)):
            inside[i] = inside[self.parents[i]] or self.tags[i] in ("article", "main")
        own, every = "", []
        for b in self.blocks:
            flat = " ".join("".join(piece for _, piece in b).split())
            every.append(flat)
            if inside[b[0][0]] and len(flat) > len(own):
                own = flat
        longest = [own] if own else sorted(every, key=len)[-2:]
        return _hash(*sorted(x.encode("utf-8", "surrogatepass") for x in longest))

    def subtrees(self) -> set[tuple[int, int]]:
        """``kind, hash`` of the subtrees that may be a template: 1 containers, 2 other blocks, 3 structures."""
        found = set()
        for tag, h, shape in zip(self.tags, self.hashes, self.shapes):
            if h and tag in _BLOCK and tag not in _KEPT_WHOLE:
                found.add((1 if tag in _CONTAINERS else 2, h))
                if shape and tag in _CONTAINERS:
                    found.add((3, shape))
        return found

    def templates(self, recurring: frozenset[int] | set[int]) -> list[bool]:
        """Which elements are the root of a recurring subtree."""
        return [
            bool(h) and (h in recurring or shape in recurring) and t in _BLOCK and t not in _KEPT_WHOLE
            for h, shape, t in zip(self.hashes, self.shapes, self.tags)
        ]

    def text(self, recurring: frozenset[int] | set[int]) -> str:
        n = len(self.tags)
        fine, article, main, title = [True] * n, [False] * n, [False] * n, [False] * n
        template = self.templates(recurring)
        for i in range(1, n):
            up, tag = self.parents[i], self.tags[i]
            article[i] = article[up] or tag == "article"
            main[i] = main[up] or tag == "main"
            drop = self.drops[i] or template[i]
            title[i] = article[up] and tag == "header" and fine[up] and not template[i] or title[up]
            fine[i] = fine[up] and (not drop or title[i] and tag == "header")
        inside = None
        for region in (article, main):
            if any(region[i] and fine[i] for b in self.blocks for i, piece in b if piece.strip()):
                inside = region
                break
        out = []
        for b in self.blocks:
            kept = [
                piece
                for i, piece in b
                if fine[i] and (inside is None or inside[i]) and (not title[i] or self._in_heading(i))
            ]
            if flat := " ".join("".join(kept).split()):
                out.append(flat)
        return " ".join(out)

    def _in_heading(self, i: int) -> bool:
        while i:
            if self.tags[i] in _HEADINGS:
                return True
            if self.tags[i] == "header":
                return False
            i = self.parents[i]
        return False


def page_text(source: str | None, recurring: frozenset[int] | set[int] = frozenset(), names: bool = True) -> str:
    return Page(source, names).text(recurring) if source else ""


def _source(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(
        F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html")
    )


def subtree_hashes(source: DataFrame) -> DataFrame:
    """``page_key, host, kind, hash, article``: each page's distinct subtrees, and kind 0 for the page itself."""
    keyed = source.select(F.xxhash64("page_id", "url", "html").alias("page_key"), "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, url, text in zip(*(c.to_pylist() for c in batch.columns)):
                page, host = Page(text or ""), host_of(url)
                article = page.article()
                rows += [(key, host, kind, h, article) for kind, h in ((0, 0), *page.subtrees())]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            columns = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_key", "host", "kind", "hash", "article"])

    return arrow(keyed, run, "page_key long, host string, kind int, hash long, article long")


def recurring_subtrees(hashes: DataFrame, min_pages: int = MIN_PAGES, min_articles: int = MIN_ARTICLES, many: int = MANY) -> DataFrame:
    """``host, hash`` of subtrees on enough of a host's pages, with enough articles."""
    each = hashes.groupBy("host", "kind", "hash", "article").agg(F.count("*").alias("n"))
    counts = each.groupBy("host", "kind", "hash").agg(F.sum("n").alias("n"), F.count("*").alias("articles"))
    enough = (F.col("n") >= min_pages) & (F.col("articles") >= min_articles)
    counts = table(counts.where(enough | (F.col("kind") == 0)))
    hosts = counts.where("kind = 0").select("host", F.col("n").alias("pages"))
    share = F.when(F.col("kind") == 1, SHARE).when(F.col("kind") == 2, BLOCK_SHARE).otherwise(SHAPE_SHARE)
    often = (F.col("n") >= share * F.col("pages")) | ((F.col("kind") == 1) & (F.col("n") >= many))
    return counts.where("kind != 0").join(hosts, "host").where(often).select("host", "hash").distinct()


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_pages: int = MIN_PAGES, min_articles: int = MIN_ARTICLES, many: int = MANY, names: bool = True, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars, n_templates``, the last the subtrees deleted because they recur."""
    source = _source(pages, id_col, url_col, html_col)
    hashes = subtree_hashes(source)
    recurring = table(recurring_subtrees(hashes, min_pages, min_articles, many))
    if recurring.limit(broadcast_rows + 1).count() <= broadcast_rows:
        by_host: dict[str, set[int]] = {}
        for row in recurring.collect():  # at most broadcast_rows rows, counted above
            by_host.setdefault(row.host, set()).add(row.hash)
        known = pages.sparkSession.sparkContext.broadcast(by_host)
        rows = source.withColumn("marks", F.lit(None).cast("array<long>"))
    else:
        known = None
        marks = hashes.join(recurring, ["host", "hash"]).groupBy("page_key").agg(F.collect_set("hash").alias("marks"))
        keyed = source.withColumn("_key", F.xxhash64("page_id", "url", "html"))
        rows = keyed.join(marks, F.col("_key") == F.col("page_key"), "left").select("page_id", "url", "html", "marks")
    kind = source.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none: set[int] = set()
        for batch in batches:
            urls, sources, marks = (batch.column(k).to_pylist() for k in (1, 2, 3))
            found = known.value if known is not None else None
            texts, deleted = [], []
            for u, t, m in zip(urls, sources, marks):
                here = found.get(host_of(u), none) if found is not None else set(m or ())
                page = Page(t or "", names)
                texts.append(page.text(here))
                deleted.append(sum(page.templates(here)))
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(deleted, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars", "n_templates"])

    return arrow(rows, run, f"page_id {kind}, url string, text string, n_chars long, n_templates long")
