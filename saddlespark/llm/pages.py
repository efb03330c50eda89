"""Main text of web pages, with site templates found by recurring subtrees.

Two passes over the pages.  The first hashes every block-level element's subtree (tag, texts,
children) and Spark counts, per host, on how many pages with different main texts each hash
occurs; hashes on many of a host's pages are its template.  How many grows with the logarithm of
the host's pages, so what fills thousands of pages of a large host is found however large the rest.  The second pass takes the page's
article, leaves out what the markup itself declares to be something else (menus, forms,
adverts, comments...) and every subtree that belongs to the template, and joins the blocks
that are left.

Inside an article, plain text blocks (paragraphs, headings, list items...) are content even if
other pages quote them; only containers can be template there.  Copies of one page count once,
so a page that is mirrored a hundred times on a host does not become its own template.

Cases: null or empty html gives an empty text; a null url, or one without a host, has no template.
Unclosed, misnested and cut-off markup is closed as browsers would, roughly.  Pages without an
article element use main, then the whole body.  Repeated rows are pages of their own; other
columns are left out.  An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

MIN_PAGES = 5  # with different main texts
BROADCAST_HASHES = 1 << 16  # more go through shuffled joins

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
HINTED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption td th tr caption summary address".split())
CONTAINERS = frozenset(
    "html head body main article section div header footer nav aside ul ol dl table thead tbody tfoot figure "
    "form fieldset details center hgroup search dialog menu hr noscript".split()
)
BLOCKS = TEXT_BLOCKS | CONTAINERS
NOT_TEXT = frozenset(
    "head nav footer aside form noscript template button select object svg canvas audio video dialog menu search "
    "input option".split()
) | RAW
# An open element of the set is closed by the tag.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted cookie cookies consent gdpr notice "
    "popup modal overlay newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead comment comments commentlist disqus reply replies respond share sharing social related recommended "
    "pagination pager toolbar widget widgets login skip alert contentinfo complementary".split()
)
OUTSIDE_HINTS = HINTS | frozenset("header banner".split())


class Page:
    """Elements and texts of a page as flat lists; parents come before their children."""

    def __init__(self, source: str):
        self.tags, self.parents, self.hints, self.holds, self.hashes = ["#root"], [-1], [frozenset()], [False], [0]
        self.names: list[set[str] | frozenset[str]] = [frozenset()]  # whole names of class and role
        self.texts: list[tuple[int, int, str]] = []  # element, block number, text
        self._inner: list[list[str]] = [[]]
        self._stack, self._block, self._open_p = [0], 0, 0
        at, end = 0, len(source)
        while at < end:
            m = TOKEN.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            tag = (m["tag"] or m["tag2"] or "").lower()
            if not tag:
                continue
            if m["close"] or m["close2"]:
                self._end(tag)
                continue
            attrs = m["attrs"] if m["tag"] else m["attrs2"]
            self._begin(tag, attrs or "")
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = close.end() if close else end
                self._close()
        while len(self._stack) > 1:
            self._close()

    def _text(self, text: str) -> None:
        self.texts.append((self._stack[-1], self._block, text))
        self._inner[-1].append(" ".join(text.split()))

    def _begin(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self._text(" ")
        if tag in BLOCKS:
            self._block += 1
            if self._open_p:
                self._pop_to("p", CONTAINERS - {"form"})
        if tag in CLOSED_BY:
            for old in CLOSED_BY[tag]:
                self._pop_to(old, {"ul", "ol", "dl", "table", "select"})
        if tag in VOID:
            return
        words: set[str] = set()
        names: set[str] = set()
        if attrs:
            for m in HINTED.finditer(attrs):
                told = (m[2] or m[3] or m[4] or "").lower()
                words.update(re.split(r"[^a-z0-9]+", told))
                if m[1].lower() != "id":
                    names.update(told.split())
                if m[1].lower() == "role" and told == "main":
                    words.add("#main")
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        self.hints.append(words)
        self.names.append(names)
        self.holds.append(False)
        self.hashes.append(0)
        self._stack.append(len(self.tags) - 1)
        self._open_p += tag == "p"
        self._inner.append([])
        if tag in ("article", "main") or "#main" in words:
            for i in self._stack[:-1]:
                self.holds[i] = True

    def _pop_to(self, tag: str, stop: frozenset[str] | set[str]) -> None:
        """Close the nearest open ``tag`` and what is inside it, unless an element of ``stop`` comes first."""
        for i in range(len(self._stack) - 1, 0, -1):
            open_tag = self.tags[self._stack[i]]
            if open_tag == tag:
                while len(self._stack) > i:
                    self._close()
                return
            if open_tag in stop:
                return

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._block += 1
            self._pop_to(tag, frozenset({"article", "main", "body"}) - {tag} if tag in TEXT_BLOCKS else frozenset())
        else:
            self._pop_to(tag, BLOCKS)

    def _close(self) -> None:
        import xxhash

        i, inner = self._stack.pop(), self._inner.pop()
        self._open_p -= self.tags[i] == "p"
        digest = xxhash.xxh64_intdigest(self.tags[i] + "\x01" + "\x02".join(x for x in inner if x))
        self.hashes[i] = digest - (1 << 63)
        self._inner[-1].append(f"\x03{digest:x}")
        if self.tags[i] in BLOCKS:
            self._block += 1

    def _region(self, dropped: list[bool]) -> list[bool]:
        for wanted in ("article", "main", "#root"):
            roots = [not dropped[i] and (t == wanted or (wanted == "main" and "#main" in self.hints[i])) for i, t in enumerate(self.tags)]
            if any(roots):
                break
        for i in range(1, len(roots)):
            roots[i] = roots[i] or roots[self.parents[i]]
        return roots

    def declared(self) -> list[bool]:
        """Elements that the markup itself says are not main text, with all they hold.

        Inside an article just containers can be, by a whole name of their class or role.
        """
        out = [False] * len(self.tags)
        inside = [False] * len(self.tags)
        for i in range(1, len(self.tags)):
            up, tag = self.parents[i], self.tags[i]
            inside[i] = inside[up] or tag in ("article", "main") or "#main" in self.hints[i]
            hint = (tag in CONTAINERS and self.names[i] & HINTS) if inside[i] else self.hints[i] & OUTSIDE_HINTS
            own = tag in NOT_TEXT or bool(hint) or (tag == "header" and not inside[up])
            out[i] = out[up] or (own and not self.holds[i] and tag not in ("html", "body"))
        return out

    def candidates(self) -> Iterator[int]:
        """Elements that a template may consist of."""
        inside = [False] * len(self.tags)
        for i in range(1, len(self.tags)):
            tag = self.tags[i]
            inside[i] = inside[self.parents[i]] or tag in ("article", "main")
            if tag in BLOCKS and not self.holds[i] and tag not in ("html", "body", "head", "article", "main"):
                if not (inside[i] and tag in TEXT_BLOCKS):
                    yield i

    def main_text(self, template: frozenset[int] | set[int] = frozenset()) -> str:
        dropped = self.declared()
        if template:
            for i in self.candidates():
                dropped[i] = dropped[i] or self.hashes[i] in template
            for i in range(1, len(dropped)):
                dropped[i] = dropped[i] or dropped[self.parents[i]]
        region, blocks = self._region(dropped), {}
        for node, block, text in self.texts:
            if region[node] and not dropped[node]:
                blocks.setdefault(block, []).append(text)
        joined = (" ".join(entities.unescape("".join(b)).split()) for b in blocks.values())
        return "\n\n".join(b for b in joined if b)


def host(url) -> F.Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _subtrees(pages: DataFrame) -> DataFrame:
    """page (hash of host and html), host, hash of a subtree and of the main text.

    The row without a subtree counts the page itself.
    """
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, where, source in zip(b["page"].array, b["host"].array, b["html"].array, strict=True):
                page = Page(source)
                body = xxhash.xxh64_intdigest(page.main_text()) - (1 << 63)
                out += [(key, where, None, body), *((key, where, h, body) for h in {page.hashes[i] for i in page.candidates()})]
            key, where, found, body = zip(*out, strict=True) if out else ((), (), (), ())
            columns = {"page": pd.array(key, dtype="int64"), "host": where, "subtree": pd.array(found, dtype="Int64"), "body": pd.array(body, dtype="int64")}
            yield pd.DataFrame(columns)

    known = pages.select(host(F.col("url")).alias("host"), F.col("html")).filter("host IS NOT NULL AND html IS NOT NULL")
    known = known.select(F.xxhash64("host", "html").alias("page"), "host", "html")
    return known.mapInPandas(run, "page long, host string, subtree long, body long")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """host and subtree: a row for each hash of its template.

    A hash belongs to it on ``min_pages`` different pages, or log2 of the host's if that is more.
    """
    seen = _subtrees(pages).select("host", "subtree", "body").distinct()
    counts = seen.groupBy("host", "subtree").agg(F.count("*").alias("pages"))
    whole = counts.filter("subtree IS NULL").select("host", F.greatest(F.lit(min_pages), F.floor(F.log2("pages"))).alias("need"))
    often = counts.filter(F.col("subtree").isNotNull() & (F.col("pages") >= min_pages)).join(whole, "host")
    return often.filter("pages >= need").select("host", "subtree")


def extract(pages: DataFrame, **kw) -> DataFrame:
    """page_id, url and main text of every page."""
    found = materialize(templates(pages, **kw))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host"))
    shared = None
    if found.count() <= BROADCAST_HASHES:
        by_host: dict[str, set[int]] = {}
        for r in found.toLocalIterator():
            by_host.setdefault(r["host"], set()).add(r["subtree"])
        shared = pages.sparkSession.sparkContext.broadcast(by_host)
        rows = rows.withColumn("template", F.lit(None).cast("array<long>"))
    else:
        # each page gets the hashes it has itself, whatever the length of its host's list
        own = _subtrees(pages).filter("subtree IS NOT NULL").select("page", "host", "subtree").distinct().join(found, ["host", "subtree"])
        own = own.groupBy("page").agg(F.collect_set("subtree").alias("template"))
        rows = rows.withColumn("page", F.xxhash64("host", "html")).join(own, "page", "left")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for source, where, template in zip(b["html"].array, b["host"].array, b["template"].array, strict=True):
                if shared is not None:
                    known = shared.value.get(where, frozenset())
                else:
                    known = set() if template is None else set(template)
                out.append(Page(source).main_text(known) if source else "")
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": out})

    return rows.select("page_id", "url", "html", "host", "template").mapInPandas(texts, "page_id long, url string, text string")
