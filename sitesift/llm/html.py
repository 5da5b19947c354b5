"""Main text of pages: site templates are found by counting element subtrees per host, then removed.

A page is read into a list of elements, in time linear in its length. A block element has a hash over its tag, classes and text,
children included; a box outside the main part also has one over its tags and classes alone, as menus and notices differ in
words from page to page. Spark counts in how many different pages of a host a hash occurs; subtrees on many of them (inside
the main part: on half of them) are the site's template and are deleted. Where that leaves nothing but the main part, the page is
settled by the counts. Elsewhere (hosts of few pages, blocks of one page) what names itself as no article (navigation, forms,
notices, adverts, comments) goes, and text comes from the article or main part alone, if there is one.
"""

import html
import re
import sys

import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from .common import out, texts, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_PAGES, MIN_SHARE, INNER_SHARE = 10, 0.05, 0.5
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:script|style|noscript|template|textarea|title|svg|iframe)\b[^>]*>|<[!?][^>]*>|</?[a-zA-Z](?:[^\"'>]|\"[^\"]*\"|'[^']*')*+>|</?[a-zA-Z][^>]*>", re.S | re.I)
_COMMENT = re.compile(r"<!--.*", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[a-z]+")
#: fixed values of HTML: elements without an end tag, elements that break a line, elements that hold no text of the page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                  "head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
#: blocks that are counted inside the main part too; paragraphs, headings, quotes and single entries are its prose
BOXES = frozenset("address aside details dialog div dl fieldset figure footer form header hgroup menu nav ol search section table ul".split())
#: parts of a list or table: they go or stay with it
ENTRIES = frozenset("caption dd dt li option tbody td tfoot th thead tr".split())
RAW = frozenset("script style noscript template textarea title svg iframe".split())
NO_TEXT = RAW | frozenset("head nav footer aside form button select option dialog object canvas audio video search menu".split())
#: a start tag of the first kind ends an open element of the second
ENDS = {"p": ("p",), "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS |= {t: ("p",) for t in BLOCK - {"p", "li", "dd", "dt", "tr", "td", "th", "option", "html", "body", "head", "title"}}
WALLS = frozenset("table ul ol dl article section div main body html aside nav footer header form td".split())
#: words in a class, id or role that mark what is no article
NO_ARTICLE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
                       "sidebar nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar masthead footer comment comments respond reply replies disqus share sharing "
                       "social related recommended newsletter subscribe subscription signup login search form contentinfo complementary".split())


class Page:
    """Elements of one page in page order: tag, parent, marks; and the stream of text pieces and block breaks."""

    def __init__(self, source: str):
        self.tags, self.parents, self.marks, self.ids = ["#"], [0], [frozenset()], [""]
        self.stream: list[tuple[int, str | None]] = []  # (element, text), text None: a block break
        self._stack, self._open_at, self._walls = [0], {}, []  # open elements, places of each name and of walls among them
        at, end = 0, source.rfind(">") + 1  # behind the last ">" no tag can end
        while True:
            m = _TOKEN.search(source, at, end)
            self._text(self._stack[-1], source[at:m.start() if m else end])
            if not m:
                break
            at, token = m.end(), m.group()
            if token[1] in "!?":
                if token.startswith("<!--") and not token.endswith("-->"):
                    end = at = len(source)
                continue
            name = _NAME.match(token).group(1).lower()
            if token[1] == "/":
                self._close(name)
                continue
            while True:  # what this tag ends, but for what is walled off
                last = max((self._open_at[t][-1] for t in ENDS.get(name, ()) if self._open_at.get(t)), default=0)
                if not last or self._walls and self._walls[-1] > last:
                    break
                self._close(self.tags[self._stack[last]])
            self._open(name, token)
            if name in RAW and not token.endswith("/>"):  # its content is no markup
                stop = re.compile(rf"</{name}\s*>|\Z", re.I).search(source, at)
                at = stop.end()
                end = max(end, at)
                self._close(name)
        self._text(self._stack[-1], _COMMENT.sub("", source[end:]))
        self.stream.append((0, None))

    def _text(self, node: int, text: str) -> None:
        if text:
            self.stream.append((node, html.unescape(text) if "&" in text else text))

    def _open(self, name: str, token: str) -> None:
        values = {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(token)} if "=" in token else {}
        self.tags.append(name)
        self.parents.append(self._stack[-1])
        self.ids.append(" ".join([name, values.get("class", ""), values.get("id", ""), values.get("role", "")]))
        hidden = {"hidden"} if values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "") else set()
        self.marks.append(frozenset(hidden | set(_WORD.findall(self.ids[-1][len(name):].lower()))))
        node = len(self.tags) - 1
        if name in BLOCK:
            self.stream.append((node, None))
        elif name == "br":
            self.stream.append((self._stack[-1], " "))
        if name not in VOID and not token.endswith("/>"):
            self._open_at.setdefault(name, []).append(len(self._stack))
            if name in WALLS:
                self._walls.append(len(self._stack))
            self._stack.append(node)

    def _close(self, name: str) -> None:
        if not self._open_at.get(name):
            return
        k = self._open_at[name][-1]
        for node in self._stack[k:]:
            if self.tags[node] in BLOCK:
                self.stream.append((self.parents[node], None))
            self._open_at[self.tags[node]].pop()
        while self._walls and self._walls[-1] >= k:
            self._walls.pop()
        del self._stack[k:]

    def inside(self, own) -> list[bool]:
        """For each element: does own hold for it or for one above it."""
        got = [False]
        for n in range(1, len(self.tags)):
            got.append(got[self.parents[n]] or own(n))
        return got

    def outcast(self, n: int, main: list[bool]) -> bool:
        tag, marks = self.tags[n], self.marks[n]
        if tag in ("html", "body", "article", "main") and "comment" not in marks and "comments" not in marks:
            return False
        if tag == "header" or "header" in marks:
            return not main[n]  # the headline of an article stays
        return tag in NO_TEXT or "hidden" in marks or bool(marks & NO_ARTICLE)

    def is_main(self, n: int) -> bool:
        return self.tags[n] in ("article", "main") or "articlebody" in self.marks[n] or ("main" in self.marks[n] and self.tags[n] == "div")

    def hashes(self) -> dict[int, list[int]]:
        """Hashes of block elements with text: of the whole subtree (tag, classes, id and text, white space as one blank), and for
        boxes outside the main part of its shape (the same without text, like neighbours once). Elements that hold the main part
        or most of the page's text have none; inside the main part only boxes without most of its text do. The lowest
        bit says whether the element stands inside."""
        n = len(self.tags)
        main = self.inside(self.is_main)
        holds, size = [False] * n, [0] * n
        parts: list[list[str]] = [[] for _ in range(n)]
        below: list[list[str]] = [[] for _ in range(n)]
        for node, text in self.stream:
            if text is not None and (clean := " ".join(text.split())):
                parts[node].append(clean)
                size[node] += len(clean)
        top = list(range(n))  # of an element inside: the outermost main element above it
        for k in range(1, n):
            if main[self.parents[k]]:
                top[k] = top[self.parents[k]]
        got, shape = [0] * n, [0] * n
        for k in range(n - 1, -1, -1):
            got[k] = xxhash.xxh64_intdigest("\x00".join([self.ids[k], *parts[k]]), 7) if size[k] else 0
            shape[k] = xxhash.xxh64_intdigest("\x00".join([self.ids[k], *below[k]]), 11)
            p = self.parents[k]
            if k and size[k]:
                parts[p].append(f"{got[k]:x}")
                if self.tags[k] not in RAW:
                    size[p] += size[k]
            if k:
                holds[p] = holds[p] or holds[k] or self.is_main(k)
                mine = f"{shape[k]:x}"
                if self.tags[k] in BLOCK and (not below[p] or below[p][-1] != mine):
                    below[p].append(mine)

        def counts(k: int) -> bool:
            if not size[k] or holds[k] or self.is_main(k) or self.tags[k] in ENTRIES:
                return False
            if main[k]:
                return self.tags[k] in BOXES and 2 * size[k] <= size[top[k]]
            return self.tags[k] in BLOCK and self.tags[k] not in RAW and 2 * size[k] <= size[0]

        marked = any(main)
        return {k: [got[k] & ~1 | main[k]] + ([shape[k] & ~1] if marked and not main[k] and self.tags[k] in BOXES else []) for k in range(1, n) if counts(k)}

    def text(self, template: set[int]) -> str:
        return self.settled(template)[0]

    def settled(self, template: set[int]) -> tuple[str, str]:
        """The page's text, and what settled it: "counts", "marks" or, without either, "page"."""
        main = self.inside(self.is_main)
        deleted = {k for k, hs in self.hashes().items() if template.intersection(hs)} if template else set()
        unread = lambda k: self.tags[k] in RAW or self.tags[k] == "head" or "hidden" in self.marks[k]
        cast = self._outcasts(main)
        if deleted:
            gone = self.inside(lambda k: k in deleted or unread(k))
            left = {node for node, text in self.stream if text is not None and not gone[node] and text.strip()}
            if any(main[k] for k in left) and all(main[k] for k in left) and not any(cast[k] for k in left):
                return self._blocks(gone, main, False), "counts"
        gone = self.inside(lambda k: k in deleted or cast[k])
        if any(m and not g for m, g in zip(main, gone, strict=True)) and (got := self._blocks(gone, main, True)):
            return got, "marks"
        return self._blocks(gone, main, False), "marks" if any(cast) else "page"

    def _outcasts(self, main: list[bool]) -> list[bool]:
        return self.inside(lambda k: self.outcast(k, main))

    def _blocks(self, gone: list[bool], main: list[bool], within: bool) -> str:
        blocks, buffer = [], []
        for node, text in [*self.stream, (0, None)]:
            if text is None:
                if block := " ".join("".join(buffer).split()):
                    blocks.append(block)
                buffer = []
            elif not gone[node] and (main[node] or not within):
                buffer.append(text)
        return "\n".join(blocks)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"),
                        F.xxhash64(F.coalesce(F.col(html_col), F.lit(""))).alias("content"))


def subtrees(rows: DataFrame) -> DataFrame:
    """(host, content, hash): the distinct subtree hashes of each page."""
    schema = pa.schema([("host", pa.string()), ("content", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            yield out(schema, host=b.column("host"), content=b.column("content"), hashes=[sorted({_signed(h) for own in Page(t).hashes().values() for h in own}) for t in texts(b, "html")])

    return rows.select("host", "content", "html").mapInArrow(run, "host string, content long, hashes array<long>").select("host", "content", F.explode("hashes").alias("hash"))


def templates(nodes: DataFrame, pages_of_host: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, inner_share: float = INNER_SHARE) -> DataFrame:
    """(host, hash) of subtrees on at least `min_pages` different pages and a `min_share` of the host's, inside the main part
    an `inner_share`; equal pages count once."""
    counted = nodes.groupBy("host", "hash").agg(F.countDistinct("content").alias("n")).where(F.col("n") >= min_pages)
    return counted.join(pages_of_host, "host").where(F.col("n") >= F.col("pages") * F.when(F.col("hash").bitwiseAND(1) == 1, inner_share).otherwise(min_share)).select("host", "hash")


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, inner_share: float = INNER_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars, settled_by) of every row: the article's blocks in page order, one line each; settled_by says
    whether the counts alone, marks or neither decided.

    Null or empty pages, and pages without article text, have an empty text. Pages without a host count as one host. Equal pages
    of a host share their result; repeated rows repeat.
    """
    rows = _rows(pages, id_col, url_col, html_col)
    nodes = written(subtrees(rows), "subtrees")
    hosts = rows.groupBy("host").agg(F.countDistinct("content").alias("pages"))
    found = templates(nodes, hosts, min_pages, min_share, inner_share)
    own = nodes.join(found, ["host", "hash"], "left_semi").groupBy("host", "content").agg(F.collect_set("hash").alias("template"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("settled_by", pa.string())])

    def run(batches):
        for b in batches:
            got = [Page(t).settled({x & (1 << 64) - 1 for x in known or ()}) for t, known in zip(texts(b, "html"), b.column("template").to_pylist(), strict=True)]
            yield out(schema, page_id=b.column("id"), url=b.column("url"), text=[t for t, _ in got], n_chars=[len(t) for t, _ in got], settled_by=[how for _, how in got])

    return rows.join(own, ["host", "content"], "left").select("id", "url", "html", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long, settled_by string")
