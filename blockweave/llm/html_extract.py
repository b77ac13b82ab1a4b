"""Main text of web pages with removal of each site's template.

1. Every page is parsed into its element tree. The subtrees that could belong to a template,
   inside an article containers with lists, tables and figures, else all, are hashed by their
   source. Menus and link lists differ from page to page, so subtrees outside articles whose text is
   mostly links are hashed by their shape as well: tags and classes, equal neighbours as one.
   (host, hash) rows are counted over pages by an aggregate with a map side, so a host
   that holds a third of all pages costs no task more than another. A subtree on ``SHARE`` of a
   host's pages, and on ``LEAST`` at least, is that host's template, and so is a container, list,
   table or figure on ``MANY`` of its pages, however large the host is, unless those are mostly
   copies of a few pages.
2. Each page is parsed again. Its article (with the main element around it, if any), or the page if
   it has none, is read without template subtrees and without elements that are by name, role or class menus, headers, footers,
   sidebars, notices, adverts, forms, scripts, styles or comments. Nothing else is left out:
   paragraphs that many pages quote inside their article are text and stay.

The template table is broadcast while it takes at most ``BROADCAST`` bytes; beyond that the hashes
of each page meet the templates in a join, so that a page is given only those it holds, however
many its host has. Adaptive execution can split the join for a hot template.

Defined results: null and empty html give an empty text, as does a page without text. Elements
that are not closed end with their parent; stray end tags are ignored. A page without a host
has templates in common with other such pages. Rows are treated one by one, repeated or not. An
empty table gives no rows. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.runtime import few_bytes, settle

#: A template subtree is on this share of its host's pages, and on so many at least.
SHARE, LEAST = 0.25, 5
#: A container on so many pages of its host is a template whatever their share.
MANY = 100
#: Of 64 classes of page digests, so many must hold it then; 100 different pages reach about 51, copies of one page reach 1.
CLASSES = 32
#: Bytes of (host, hash) rows that are broadcast at most.
BROADCAST = 8 << 20

#: A tag ends before another one begins and closes its quotes: what does not is text. The first parts of a tag are read at once, others one by one.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'){0,200}+)|<[!?][^<>]*+>", re.S)
PART = re.compile(r"[^<>\"']++|\"[^\"]*+\"|'[^']*+'")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

#: Element names and words of class and id, by what they mean here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe".split())
#: Read as elements, so that they end with their parent at the latest, but never text.
UNSEEN = set("template select".split())
INLINE = set("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img data".split())
TEXT = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody table ul ol dl figcaption figure em b i strong".split())
#: Text elements that hold others and may be templates inside an article, too.
GROUPS = set("ul ol dl table figure".split())
BOILERPLATE = set("nav footer aside form menu dialog button head".split()) | RAW | UNSEEN
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr notice sidebar comment comments "
    "disqus nav navbar navigation menu breadcrumb breadcrumbs footer header masthead".split()
)
SINGLE = TEXT | INLINE
LINES = set("p h1 h2 h3 h4 h5 h6 blockquote dd td figcaption pre".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}


class Element:
    __slots__ = ("tag", "start", "end", "children", "attributes", "hash", "shape", "text", "links")

    def __init__(self, tag: str, start: int, attributes: str = ""):
        self.tag, self.start, self.end, self.attributes = tag, start, -1, attributes
        self.hash = self.shape = 0
        #: characters of text below, and of those in links
        self.text = self.links = 0
        #: elements, and (from, to) of the text between them
        self.children: list[Element | tuple[int, int]] = []


def parse(source: str) -> Element:
    """The element tree of a page; positions point into ``source``."""
    root = Element("#page", 0)
    stack, at, text, size = [root], 0, 0, len(source)
    #: where on the stack each tag, and each element that is not inline, is open
    opened: defaultdict[str, list[int]] = defaultdict(list)
    blocks = [0]
    no_end: set[int] = set()  # places from which no tag closes

    def close(to: int, end: int) -> None:
        while len(stack) > to:
            e = stack.pop()
            e.end = end
            if stack:
                opened[e.tag].pop()
                if blocks[-1] == len(stack):
                    blocks.pop()

    def nearest(tags: set[str]) -> int:
        return max((opened[t][-1] for t in tags if opened[t]), default=0)

    while at < size:
        m = TOKEN.search(source, at)
        if not m:
            break
        at = m.end()
        tag = m[2] and m[2].lower()
        if tag:
            tried = []
            while source[at : at + 1] != ">" and at not in no_end and (part := PART.match(source, at)):
                tried.append(at)
                at = part.end()
            if source[at : at + 1] != ">":
                no_end.update(tried)
                at = m.start() + 1
                continue
            attributes, at = source[m.end(2) : at], at + 1
        if m.start() > text:
            stack[-1].children.append((text, m.start()))
        text = at
        if not tag:
            continue
        if m[1]:
            if opened[tag]:
                i = opened[tag][-1]
                close(i + 1, m.start())
                close(i, at)
            continue
        if tag in CLOSED_BY:
            i = nearest(CLOSED_BY[tag])
            if i > nearest(SCOPE[tag]):
                close(i, m.start())
        elif tag not in INLINE and tag != "br" and stack[blocks[-1]].tag == "p":  # a block ends an open paragraph
            close(blocks[-1], m.start())
        new = Element(tag, m.start(), attributes)
        stack[-1].children.append(new)
        if tag in VOID or attributes.endswith("/"):
            new.end = at
        elif tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            new.end = at = text = stop.end() if stop else size
        else:
            opened[tag].append(len(stack))
            if tag not in INLINE:
                blocks.append(len(stack))
            stack.append(new)
    if text < size:
        stack[-1].children.append((text, size))
    close(0, size)
    return root


def _boilerplate(e: Element, in_article: bool) -> bool:
    if e.tag in BOILERPLATE or e.tag == "header" and not in_article:
        return True
    if not e.attributes or e.tag in ("html", "body", "article", "main") and "comment" not in e.attributes:
        return False
    words, role = [], ""
    for name, *values in ATTRIBUTE.findall(e.attributes):
        name, value = name.lower(), (values[0] or values[1] or values[2]).lower()
        if name in ("class", "id"):
            words += value.split()
        elif name == "role":
            role = value.strip()
    if role in ROLES:
        return True
    for word in words:
        parts = re.split(r"[-_]+", word)
        if WORDS.intersection(parts) and not (in_article and {"header", "title"}.intersection(parts) and {"post", "entry", "article", "page"}.intersection(parts)):
            return True
    return False


def _hash(page: Element, source: str) -> None:
    """Hash every subtree by its source, in which the elements inside stand as their own hashes, and by its shape: linear at any depth."""
    order = [page]
    for e in order:
        order += [c for c in e.children if isinstance(c, Element)]
    for e in reversed(order):
        parts, at, shapes = [], e.start, []
        for c in e.children:
            if isinstance(c, Element):
                parts += [source[at : c.start].encode("utf-8", "surrogatepass"), b"\0%d\0" % c.hash]
                at = c.end
                e.text += c.text
                e.links += c.links
                if not shapes or shapes[-1] != c.shape:
                    shapes.append(c.shape)
            else:
                e.text += len(source[c[0] : c[1]].strip())
        parts.append(source[at : e.end].encode("utf-8", "surrogatepass"))
        e.hash = xxhash.xxh3_64_intdigest(b"".join(parts)) - (1 << 63)
        if e.tag == "a":
            e.links = e.text
        classes = sorted(v.lower() for n, *vs in ATTRIBUTE.findall(e.attributes) if n.lower() == "class" for v in "".join(vs).split()) if "class" in e.attributes.lower() else ()
        e.shape = xxhash.xxh3_64_intdigest(f"{e.tag} {' '.join(classes)} {shapes}".encode("utf-8", "surrogatepass"), seed=1) - (1 << 63)


def _link_list(e: Element) -> bool:
    """Whether most of a container's text is links."""
    return e.text > 0 and 2 * e.links >= e.text and _container(e)


def _candidate(e: Element, in_article: bool, in_text: bool) -> bool:
    """Whether an element may belong to a template: paragraphs and inline elements inside an article may not, nor words within a line of text."""
    return e.tag not in ("html", "head", "body", "br") and not (in_article and not _container(e)) and not (in_text and e.tag in INLINE)


def _container(e: Element) -> bool:
    return e.tag in GROUPS or e.tag not in SINGLE


def subtree_hashes(source: str) -> dict[int, bool]:
    """Hashes of the subtrees of a page that may belong to a template, and whether they are containers."""
    found: dict[int, bool] = {}
    page = parse(source)
    _hash(page, source)
    todo = [(page, False, False)]
    while todo:
        e, in_article, in_text = todo.pop()
        for c in e.children:
            if isinstance(c, Element):
                if _candidate(c, in_article, in_text):
                    found[c.hash] = _container(c)
                if not in_article and c.tag not in ("html", "body") and _link_list(c):
                    found[c.shape] = True
                if c.tag not in RAW | UNSEEN and c.tag != "head":
                    todo.append((c, in_article or c.tag in ("article", "main"), _line(c, in_text)))
    return found


def _line(e: Element, in_text: bool) -> bool:
    """Whether inline elements in ``e`` are words within a line of text."""
    return e.tag in LINES or in_text and e.tag in INLINE


def _articles(e: Element) -> list[Element]:
    """Outermost articles that are not part of boilerplate, with the main elements around them; else the page's first main element."""
    found, mains = [], []
    todo: list[tuple[Element, Element | None]] = [(e, None)]
    while todo:
        x, main = todo.pop()
        if _boilerplate(x, False) and x.tag != "#page":
            continue
        if x.tag == "article":
            found.append(main or x)
            continue
        if main is None and (x.tag == "main" or 'role="main"' in x.attributes):
            mains.append(x)
            main = x
        todo += [(c, main) for c in reversed(x.children) if isinstance(c, Element)]
    return sorted({id(x): x for x in found}.values(), key=lambda x: x.start) or mains[:1]


def _read(top: Element, source: str, in_article: bool, templates: frozenset[int] | set[int], out: list[str]) -> None:
    """The text of an element without boilerplate and templates; line ends stand around blocks."""
    frames = [(iter(top.children), False, False)]
    while frames:
        children, block, in_text = frames[-1]
        for c in children:
            if isinstance(c, tuple):
                out.append(html.unescape(source[c[0] : c[1]]))
                continue
            inner = c.tag not in INLINE
            if inner:
                out.append("\n")
            if _boilerplate(c, in_article):
                continue
            if templates and (_candidate(c, in_article, in_text) and c.hash in templates or not in_article and c.shape in templates and _link_list(c)):
                continue
            frames.append((iter(c.children), inner, _line(c, in_text)))
            break
        else:
            frames.pop()
            if block:
                out.append("\n")


def main_text(source: str, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's article as one line: white space becomes one blank, blocks are joined by one."""
    page = parse(source)
    if templates:
        _hash(page, source)
    articles = _articles(page)
    out: list[str] = []
    for e in articles or [page]:
        _read(e, source, bool(articles), templates, out)
        out.append("\n")
    return " ".join("".join(out).split())


def host_of(url):
    """Host of a web address in lower case; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The other columns, and a row for every subtree of a page that may belong to a template."""
    for batch in batches:
        own = [subtree_hashes(x.as_py() or "") for x in batch.column("html")]
        rows = pa.array([i for i, x in enumerate(own) for _ in x], pa.int64())
        others = [n for n in batch.schema.names if n != "html"]
        columns = [batch.column(n).take(rows) for n in others]
        columns += [pa.array([h for x in own for h in x], pa.int64()), pa.array([c for x in own for c in x.values()], pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=[*others, "hash", "container"])


def site_templates(pages: DataFrame, share: float = SHARE, least: int = LEAST, url_col: str = "url", html_col: str = "html", many: int = MANY) -> DataFrame:
    """(host, hash) of subtrees that recur across the pages of a host."""
    own = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    rows = own.withColumn("page", F.pmod(F.xxhash64("html"), F.lit(64)).cast("int")).mapInArrow(_hashes, "host string, page int, hash long, container boolean")
    counts = rows.groupBy("host", "hash").agg(F.count("*").alias("n"), F.expr("bit_or(if(container, shiftleft(1L, page), 0L))").alias("classes")).where(F.col("n") >= min(least, many))
    sizes = own.groupBy("host").agg(F.count("*").alias("pages"))
    common = (F.col("n") >= least) & (F.col("n") >= share * F.col("pages"))
    return counts.join(sizes, "host").where(common | (F.col("n") >= many) & (F.bit_count("classes") >= CLASSES)).select("host", "hash")


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = SHARE, least: int = LEAST, broadcast: int = BROADCAST, many: int = MANY
) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    templates = settle(site_templates(pages, share, least, url_col, html_col, many), "templates")
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    held = None
    if few_bytes(templates, broadcast):
        known: dict[str, set[int]] = {}
        for r in templates.collect():
            known.setdefault(r["host"], set()).add(r["hash"])
        held = pages.sparkSession.sparkContext.broadcast(known)
    else:
        # equal pages of a host hold the same templates, so a digest names a page
        own = own.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
        of_page = own.select("host", "digest", "html").mapInArrow(_hashes, "host string, digest string, hash long, container boolean")
        of_page = of_page.join(templates, ["host", "hash"]).groupBy("host", "digest").agg(F.collect_set("hash").alias("hashes"))
        own = own.join(of_page, ["host", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = batch.column("host").to_pylist()
            mine = [held.value.get(h, ()) for h in hosts] if held is not None else [x or () for x in batch.column("hashes").to_pylist()]
            texts = [main_text(x.as_py() or "", set(t)) for x, t in zip(batch.column("html"), mine)]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    kind = dict(own.dtypes)["page_id"]
    return own.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
