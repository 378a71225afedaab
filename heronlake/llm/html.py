"""Main text of web pages by removing the templates of their sites.

Every element subtree is hashed twice: by content (tag, class-like attributes, text, children's
hashes) and, if it is no element that text is made of, by its slot (path from the root, tag,
attributes and the kinds of children in order, without text).  Spark counts, per host, on how
many pages each hash occurs.

*By content*, a subtree on at least ``MIN_PAGES`` pages and a share of ``SHARE`` of its host's
pages is template and deleted, with all it holds, if it has at most ``SHORT`` words; a longer
one, which may be an article that was published again, only from a share of ``STRONG``.
Paragraphs, headings, list items, quotations and the like need a share of ``STRONG`` and at most
``SHORT`` words, and go only while they make less than half of their article (or page), else
that was published again.  Inside ``main`` or ``article``, other elements are template
from a share of ``STRONG`` and with less than half of the text.

*By slot*, menus, adverts and footers are found whose text differs from page to page: on hosts of
``SITE`` pages or more, outside marked articles, a slot on a share of ``STRONG`` of the pages is
template if it has less than half of the words that the page has left and not its first main heading.

Names, roles and classes of menus, headers, footers, asides, notices, adverts, forms or reader
comments decide on hosts of fewer pages, where counts say little, and inside articles;
scripts, styles and hidden elements go everywhere.  Of what is left, a page that marks its
article (``main`` or ``article``) has its text there.

Tolerant of unclosed and stray tags, and of tags inside scripts and attribute values.
Null html gives the empty text; a null or odd url belongs to the host ''; repeated rows
count as pages of their own.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.llm.common import BROADCAST_KEYS, chunks, mapped, store

#: Sites have several templates, so one of them may stand on a small share of the pages.
MIN_PAGES, SHARE, STRONG, SHORT, SITE = 3, 0.01, 0.3, 60, 10

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)""", re.S)
STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?<![\w-])(?:hidden(?![\w-])|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that are never text, and those that by name are not the main one.
DROPPED = frozenset("head title script style noscript template iframe textarea xmp button select option input svg canvas object".split())
NAMED = frozenset("nav aside footer form fieldset dialog menu".split())
#: Recurring elements of these names may be content.
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre code figure figcaption table thead tbody tfoot tr td th br b i em strong a span u s small sub sup q cite abbr mark time img".split())
#: Words of class, id and role attributes that mark something else than main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement adslot adsense banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices alert popup promo promoted promotion recommended related remark remarks replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"thead", "tbody", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
#: An implied end doesn't reach beyond these.
BARRIER = ("article", "main", "body")
SCOPE = frozenset("article main body html table ul ol dl div section aside nav header footer form td th blockquote".split())


class Page:
    """The element tree of a page: parallel lists by element, in document order; element 0 is the root."""

    def __init__(self, source: str):
        self.tag, self.parent, self.marks, self.inner = ["#"], [-1], [""], [[]]
        self.hidden = [False]
        # open elements, and where in that stack each name and each scope stands
        self.stack, self.open, self.scopes = [0], {}, []
        self.quotes = True
        at, n, last = 0, len(source), source.rfind(">")
        while at < n:
            m = TAG.search(source, at) if at <= last else None
            if not m or m.start() > last:
                self._text(self.stack[-1], source[at:])
                break
            if m.start() > at:
                self._text(self.stack[-1], source[at : m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            close = self._close(source, at)
            attributes, at = source[at:close], close + 1
            if m[1]:
                self._end(name)
                continue
            self._begin(name, attributes)
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at, last + 1)
                if name in ("textarea", "title", "noscript"):
                    self._text(self.stack[-1], source[at : end.start() if end else n])
                self._end(name)
                at = end.end() if end else n
            elif name in VOID or attributes.endswith("/"):
                self._cut(len(self.stack) - 1)

    def _close(self, source: str, at: int) -> int:
        """Where the tag ends whose attributes begin at *at* (there is a ">" behind).  A ">" in quotes
        doesn't end it; a page where a quote stays open is read without quotes from there on, so
        that the rest is looked through once only."""
        i = at
        while self.quotes:
            m = STOP.search(source, i)
            if m and m[0] == ">":
                return m.start()
            i = source.find(m[0], m.end()) + 1 if m else 0
            self.quotes = i > 0
        return source.find(">", at)

    def _text(self, node: int, text: str) -> None:
        self.inner[node].append(entities.unescape(text) if "&" in text else text)

    def _begin(self, name: str, attributes: str) -> None:
        if name in BLOCK and name not in ("option", "body", "html"):
            self._imply({"p"})
        if name in CLOSES:
            self._imply(CLOSES[name])
        i = len(self.tag)
        self.tag.append(name)
        self.parent.append(self.stack[-1])
        found = ATTRIBUTE.findall(attributes) if "=" in attributes else []
        self.marks.append(" ".join(a or b or c for _, a, b, c in found).lower())
        self.hidden.append(bool(attributes and HIDDEN.search(attributes)))
        self.inner.append([])
        self.inner[self.stack[-1]].append(i)
        self.open.setdefault(name, []).append(len(self.stack))
        if name in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(i)

    def _cut(self, k: int) -> None:
        """Close the open elements from place *k* of the stack on."""
        while len(self.stack) > k:
            tag = self.tag[self.stack.pop()]
            self.open[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()

    def _innermost(self, names: Iterable[str]) -> int:
        return max((self.open[x][-1] for x in names if self.open.get(x)), default=0)

    def _imply(self, names: set[str]) -> None:
        """Close the innermost open element of *names*, unless a scope lies between."""
        k = self._innermost(names)
        if k and k >= (self.scopes[-1] if self.scopes else 0):
            self._cut(k)

    def _end(self, name: str) -> None:
        """Close the innermost open *name*; a stray end tag doesn't reach beyond an article or the body."""
        k = self._innermost((name,))
        if k and (name in BARRIER or name == "html" or k > self._innermost(BARRIER)):
            self._cut(k)

    def hashes(self) -> list[int]:
        """Hash of each element's subtree (signed 64 bits); 0 where it has no text."""
        out, text = [0] * len(self.tag), [0] * len(self.tag)
        for i in range(len(self.tag) - 1, -1, -1):
            parts = [self.tag[i], self.marks[i]]
            for x in self.inner[i]:
                if isinstance(x, int):
                    text[i] += text[x]
                    parts.append(f"\x01{out[x]}")
                elif words := x.split():
                    text[i] += len(words)
                    parts.append(" ".join(words))
            h = xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "replace"), 7)
            out[i] = h - (1 << 64) if h >> 63 else h
        self.words, out[0] = text, 0
        return [h if t else 0 for h, t in zip(out, text, strict=True)]

    def slots(self) -> list[int]:
        """Hash of each element's place and shape (after :meth:`hashes`); 0 for elements that text is made of or without text."""
        n = len(self.tag)
        shape, path, out = [""] * n, [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            kinds: list[str] = []
            for x in self.inner[i]:
                kind = shape[x] if isinstance(x, int) else "#" if x.strip() else ""
                if kind and kind != (kinds[-1] if kinds else ""):
                    kinds.append(kind)
            if self.words[i]:
                shape[i] = xxhash.xxh64_hexdigest("\0".join((self.tag[i], self.marks[i], *kinds)).encode("utf-8", "replace"), 11)
        for i in range(1, n):
            up = path[self.parent[i]]
            path[i] = xxhash.xxh64_intdigest(f"{up}\0{self.tag[i]}\0{self.marks[i]}".encode("utf-8", "replace"), 13)
            if shape[i] and self.tag[i] not in CONTENT and self.tag[i] not in DROPPED:
                h = xxhash.xxh64_intdigest(f"{path[i]}\0{shape[i]}".encode(), 17)
                out[i] = h - (1 << 64) if h >> 63 else h
        return out

    def _left(self, gone: list[bool]) -> list[int]:
        """Words of each element's subtree outside what is *gone*."""
        left = self.words.copy()
        for i in range(1, len(self.tag)):
            left[self.parent[i]] -= self.words[i]
        for i in range(len(self.tag) - 1, 0, -1):
            if gone[i]:
                left[i] = 0
            left[self.parent[i]] += left[i]
        return left

    def _roots(self, gone: list[bool]) -> list[int]:
        """Outermost remaining ``main``, else ``article`` elements, else the whole page."""
        for name in ("main", "article"):
            found, inside = [], [False] * len(self.tag)
            for i in range(1, len(self.tag)):
                inside[i] = inside[self.parent[i]]
                if self.tag[i] == name and not gone[i]:
                    if not inside[i]:
                        found.append(i)
                    inside[i] = True
            if found and name == "main":
                articles, within = [], [False] * len(self.tag)
                for i in range(1, len(self.tag)):
                    within[i] = within[self.parent[i]]
                    if inside[i] and self.tag[i] == "article" and not gone[i]:
                        if not within[i]:
                            articles.append(i)
                        within[i] = True
                return articles or found
            if found:
                return found
        return [0]

    def text(self, template: set[int], weak: set[int] = frozenset(), site: bool = False, names: bool = True) -> str:
        """Main text, given the host's subtrees of a share of STRONG (*template*) and of SHARE (*weak*), and
        whether it has SITE pages or more (*site*).  Without *names* only what is counted goes."""
        n = len(self.tag)
        holds, heading, in_article = [False] * n, [False] * n, [False] * n
        for i in range(n - 1, 0, -1):
            if self.tag[i] in ("article", "main"):
                holds[i] = True
            holds[self.parent[i]] = holds[self.parent[i]] or holds[i]
            heading[self.parent[i]] = heading[self.parent[i]] or heading[i] or self.tag[i] in HEADINGS
        marked, hashes = holds[0], self.hashes()
        slots = self.slots() if site else hashes
        lead = next((i for i in range(1, n) if self.tag[i] == "h1"), 0)  # the first main heading and what holds it
        leads = {lead}
        while lead:
            lead = self.parent[lead]
            leads.add(lead)
        article = [0] * n  # the nearest article, or the page
        gone, repeats = [False] * n, [False] * n
        repeated: dict[int, int] = {}
        for i in range(1, n):
            p, tag = self.parent[i], self.tag[i]
            in_article[i] = in_article[p] or tag in ("article", "main")
            article[i] = i if tag in ("article", "main") else article[p]
            if gone[p]:
                gone[i] = True
                continue
            by_name = names and (in_article[i] or not site)
            words = set(re.split(r"[^a-z]+", self.marks[i])) if by_name and self.marks[i] else set()
            if tag in DROPPED or self.hidden[i]:
                gone[i] = True
            elif by_name and tag in NAMED:
                gone[i] = True
            elif by_name and tag == "header":
                gone[i] = not (in_article[i] and heading[i])
            elif words & MARKS and tag not in ("body", "html") and not (holds[i] and tag != "article") and not (tag in HEADINGS):
                gone[i] = True
            elif hashes[i] and not holds[i] and tag not in ("body", "html"):
                own, often = article[i], hashes[i] in template
                if tag in CONTENT:
                    repeats[i] = repeats[p] or (often and self.words[i] <= SHORT)
                    if repeats[i] and not repeats[p]:
                        repeated[own] = repeated.get(own, 0) + self.words[i]
                elif marked and in_article[i]:
                    gone[i] = often and 2 * self.words[i] < self.words[own]
                else:
                    gone[i] = often or (hashes[i] in weak and self.words[i] <= SHORT)
        if site:
            left = self._left(gone)
            for i in range(1, n):
                gone[i] = gone[i] or gone[self.parent[i]] or (not in_article[i] and not holds[i] and i not in leads and slots[i] in template and 2 * left[i] < left[0])
        # an article most of which recurs was published again: it stays whole
        for i in range(1, n):
            gone[i] = gone[i] or gone[self.parent[i]] or (repeats[i] and 2 * repeated[article[i]] < self.words[article[i]])
        blocks: list[str] = []
        current: list[str] = []

        def flush() -> None:
            if line := " ".join("".join(current).split()):
                blocks.append(line)
            current.clear()

        for root in self._roots(gone):
            work: list[tuple[int, int]] = [(root, 0)]
            while work:
                node, k = work.pop()
                inner = self.inner[node]
                while k < len(inner):
                    x = inner[k]
                    k += 1
                    if isinstance(x, str):
                        current.append(x)
                    elif gone[x]:
                        if self.tag[x] in BLOCK:
                            flush()
                    else:
                        if self.tag[x] in BLOCK:
                            flush()
                        elif self.tag[x] == "br":
                            current.append(" ")
                        work.append((node, k))
                        work.append((x, 0))
                        break
                else:
                    if self.tag[node] in BLOCK:
                        flush()
            flush()
        return "\n".join(blocks)


def host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """``host``, ``pages``, ``template`` and ``weak``: the hashes of subtrees on shares of STRONG and *share* of its pages.

    A page's subtrees that pass are at most those it holds, and each stands on *share* of
    the pages, so a host's list is at most 1 / *share* times a page's subtrees.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"host": pa.array([k[0] for k in total], pa.string()), "hash": pa.array([k[1] for k in total], pa.int64()), "n": pa.array(list(total.values()), pa.int64())})

        for part, texts in chunks(batches, "html"):
            for name, source in zip(part.column(0).to_pylist(), texts, strict=True):
                page = Page(source)
                total.update((name, h) for h in {0, *page.hashes(), *page.slots()})
            if len(total) > 200_000:
                yield out()
                total.clear()
        yield out()

    counted = mapped(pages.select(host(url).alias("host"), F.col(html).alias("html")), run, "host string, hash long, n long").groupBy("host", "hash").agg(F.sum("n").alias("n"))
    counted = store(counted.where(F.col("n") >= min_pages), "subtrees")
    sizes = counted.where("hash = 0").select("host", F.col("n").alias("pages"))
    many = counted.where("hash <> 0").join(sizes, "host").where(F.col("n") >= share * F.col("pages"))
    strong = F.col("n") >= STRONG * F.col("pages")
    return many.groupBy("host").agg(F.max("pages").alias("pages"), F.collect_list(F.when(strong, F.col("hash"))).alias("template"), F.collect_list(F.when(~strong, F.col("hash"))).alias("weak"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE, bound: int = BROADCAST_KEYS) -> DataFrame:
    """*key*, *url*, ``text`` and ``n_chars``: one row per row of *pages*.

    Templates of at most *bound* hashes in all are broadcast; more are joined by host.  Very
    long pages are parsed in linear time; an empty table gives an empty table.
    """
    known = store(templates(pages, url, html, min_pages, share), "templates")
    held = known.agg(F.coalesce(F.sum(F.size("template") + F.size("weak")), F.lit(0))).first()[0]
    source = pages.select(F.col(key), F.col(url), F.col(html).alias("html"), host(url).alias("host"))
    names = [key, url, "text"]
    schema = T.StructType([*source.schema.fields[:2], T.StructField("text", T.StringType())])
    nothing = frozenset(), frozenset(), False
    if held <= bound:
        sets = {r.host: (frozenset(r.template), frozenset(r.weak), r.pages >= SITE) for r in known.toLocalIterator()}
        shared = pages.sparkSession.sparkContext.broadcast(sets)
    else:
        shared, source = None, source.join(known, "host", "left").select(key, url, "html", "host", "template", "weak", F.coalesce(F.col("pages") >= SITE, F.lit(False)).alias("site"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "html"):
            hosts = part.column(3).to_pylist()
            if shared:
                of = shared.value
            else:  # rows of one host hold the same lists
                of = {h: (*(frozenset(part.column(c)[i].as_py() or ()) for c in (4, 5)), part.column(6)[i].as_py()) for h, i in dict(zip(hosts, range(len(hosts)), strict=True)).items()}
            out = [Page(x).text(*of.get(h, nothing)) for x, h in zip(texts, hosts, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(out, pa.string())], names)

    return mapped(source, run, schema).withColumn("n_chars", F.length("text").cast("long"))
