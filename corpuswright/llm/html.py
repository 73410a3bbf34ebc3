"""Main text of web pages, with site template removal.

Every element's subtree has a hash of its tags and text. Spark counts in how many different pages of a host each hash
occurs; subtrees that recur across at least PAGES different pages of a host, however many it has, are its templates and go,
wherever they stand: menus, footers and adverts like notices inside of articles. Pages with the same text count once, so
copies of an article are no template. Elements that hold the main text, and inside an article element a paragraph, heading,
quotation or the like without links (PROSE), are none by themselves, since a passage that articles share is text; any other
subtree there can be one, with all it holds.

What recurrence can't tell, on hosts with few pages, names settle. Elements that say what they are by tag or role (nav,
footer, dialog) go. A class or id says so only if each of its words is one of NAMES or NEUTRAL (main-menu, but not
menu-prices or with-sidebar), and then only of an element that holds no article or main element; where only such elements
have text, those with a paragraph stay. Reader comments go in any case. The text is that of the page's main element, or of
the article elements that are not mostly links: of those inside the main element if they make up a third of what it has,
and of any if there is no main element. Results say how many blocks went as templates and how many otherwise.

A block ends where a block-level element begins or ends; a line break is white space inside it. White space is what
Unicode calls so. Headings of an article stay, also where they stand in its header.

Defined results: a null or empty html has no text; a null or broken url has host ''; a page of any length is read
whole; repeated rows get equal texts; an empty table gives an empty result; only page_id, url and html are read, so other
columns may have any name.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, through_python, written

PAGES = 5  # different pages of a host in which a template recurs at least

TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z)))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
GONE = frozenset("head script style textarea title noscript iframe template xmp noembed noframes nav aside footer button select object svg canvas dialog menu audio video map datalist option".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p blockquote pre li dt dd td th tr figcaption".split())
CLOSES = {  # an element of this kind is closed by the beginning of those
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset("td th tr tbody tfoot thead".split()), "th": frozenset("td th tr tbody tfoot thead".split()), "option": frozenset(["option", "optgroup"]),
}
BARRIER = {"li": frozenset("ul ol menu".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "p": frozenset("td th li button object".split()), "option": frozenset(["select"])}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner breadcrumb breadcrumbs nav navbar navigation menu submenu megamenu masthead header "
    "topbar toolbar footer sidebar aside rail widget widgets related recommended recommendations trending popular share sharing sharebar social comment comments commentlist disqus respond reply replies "
    "discussion cookie cookies consent gdpr notice notices popup modal overlay lightbox subscribe subscription newsletter signup login signin search pagination pager copyright skip outbrain taboola".split()
)
MAIN_NAMES = frozenset("article content main post entry story body text".split())
READERS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
NEUTRAL = frozenset(
    "a b c x s u js l r t wp main page site global primary secondary top bottom left right inner outer box boxes bar bars list lists item items container wrapper wrap block blocks area section unit units slot slots "
    "button buttons btn link links form forms group row col column columns grid panel card cards title text content body post posts article articles entry story stories news media holder frame image img icon icons logo "
    "label message info more less this on via by the and new latest facebook twitter linkedin email mail print fixed sticky mobile desktop small large default dark light first last count meta thread tree author avatar".split()
)


class Element:
    __slots__ = ("best", "boiler", "dead", "gone", "head", "headed", "heading", "holds", "links", "main", "named", "parent", "parts", "prose", "readers", "size", "tag", "value")

    def __init__(self, tag: str, parent: Element | None, attributes: str) -> None:
        self.tag, self.parent, self.parts, self.size, self.links, self.value = tag, parent, [tag], 0, 0, 0
        self.boiler = self.dead = self.headed = self.heading = self.holds = self.prose = self.readers = False
        self.best: Element | None = None
        self.main, self.head, words, roles = 0, tag == "header", set(), set()
        self.gone, self.named = tag in GONE, tag == "form"
        if len(attributes) > 1:
            for key, a, b, c in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), a or b or c
                if key in ("class", "id"):
                    for name in entities.unescape(value).split():
                        own = {x.lower() for x in NAME.findall(name)}
                        words |= own
                        told = own & NAMES
                        if told and tag not in ("html", "body", "main", "header") and all(x in NAMES or x in NEUTRAL or x.isdigit() for x in own):
                            self.readers |= not own.isdisjoint(READERS)
                            self.named |= told != {"header"}  # such an element is a header, see read()
                            self.head |= told == {"header"} and tag in ("div", "section")
                elif key == "role":
                    roles.add(value.strip().lower())
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    self.gone = True
                elif key == "itemprop" and value.lower() == "articlebody":
                    self.main = 3
        self.gone |= not ROLES.isdisjoint(roles)
        if tag == "article":
            self.main = 4
        elif tag == "main" or "main" in roles:
            self.main = 2
        elif tag in ("div", "section", "td") and not MAIN_NAMES.isdisjoint(words):
            self.main = max(self.main, 1)
        if self.main in (2, 4) and not self.readers:
            x = parent
            while x is not None and not x.holds:
                x.holds = True
                x = x.parent


def _judge(blocks: list[tuple[str, Element]], elements: list[Element]) -> None:
    """Sets ``boiler`` of all elements, of which parents come first."""
    for x in elements:
        x.boiler = x.gone or x.parent is not None and x.parent.boiler
    named = [x for x in elements if x.named and not x.holds and not x.readers]
    only = {x for x in named if x.prose}  # these stay where nothing but named elements has text
    for drop in (set(named), set(named) - only):
        kept = []
        for x in elements:
            dead = x.gone or x in drop or x.readers and not (x.holds and x.tag != "article" and x.main)
            x.boiler = dead or x.parent is not None and x.parent.boiler
        kept = any(not own.boiler for _, own in blocks)
        if kept or not only:
            break


def blocks_of(page: str) -> tuple[list[tuple[str, Element]], list[Element]]:
    """(text, innermost block-level element) of each block in page order, and all block-level elements closed."""
    root = Element("", None, "")
    stack: list[Element] = [root]
    inline: list[int] = []  # of open links: 1
    blocks: list[tuple[str, Element]] = []
    elements: list[Element] = [root]
    run: list[str] = []
    places: dict[str, list[int]] = {}  # of the open elements of each tag in the stack
    linked = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                own = stack[-1]
                own.parts.append(text)
                blocks.append((text, own))
                own.size += len(text)
                own.links += min(linked, len(text))
                own.prose |= own.tag in ("p", "blockquote", "pre")
            run.clear()
            linked = 0

    def close(upto: int) -> None:
        while len(stack) > upto:
            done, above = stack.pop(), stack[-1]
            places[done.tag].pop()
            above.size, above.links, above.prose = above.size + done.size, above.links + done.links, above.prose or done.prose
            done.value = xxhash.xxh64_intdigest("\x00".join(done.parts).encode("utf-8", "surrogatepass"), 7) - (1 << 63)
            above.parts.append(str(done.value))

    at, n, find = 0, len(page), TAG.search
    while at < n:
        hit = find(page, at)
        end = hit.start() if hit else n
        if end > at:
            text = page[at:end]
            if "&" in text:
                text = entities.unescape(text)
            run.append(text)
            if inline:
                linked += len(text)
        if not hit:
            break
        at = hit.end()
        name = hit[2]
        if name is None:
            continue
        tag = name.lower()
        if tag in INLINE:
            if tag == "br":
                run.append(" ")
            elif tag == "a":
                if hit[1]:
                    inline.clear()
                else:
                    inline[:] = [1]
            elif not hit[1] and len(hit[3]) > 6:  # an inline element that is hidden or an advert stands for itself
                probe = Element(tag, stack[-1], hit[3][:-1])
                if probe.gone or probe.named or probe.readers:
                    closing = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    if closing and not re.search(rf"<{re.escape(tag)}[\s>]", page[at : closing.start()], re.I):
                        at = closing.end()
            continue
        if tag in RAW:  # what it holds is no markup, and it ends no block
            if not hit[1]:
                closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = closing.end() if closing else n
            continue
        flush()
        if hit[1]:
            if places.get(tag):
                close(places[tag][-1])
                if tag in ("article", "main", "body", "div", "section"):
                    inline.clear()
            continue
        for kind, begins in CLOSES.items():
            if tag in begins and places.get(kind):
                k = places[kind][-1]
                if all(not places.get(x) or places[x][-1] < k for x in BARRIER[kind]):
                    close(k)
        if tag in VOID:
            continue
        own = Element(tag, stack[-1], hit[3].rstrip(">"))
        places.setdefault(tag, []).append(len(stack))
        stack.append(own)
        elements.append(own)
        if hit[3].endswith("/>") and tag in ("svg", "path", "object"):
            close(len(stack) - 1)
    flush()
    close(1)
    _judge(blocks, elements)
    return blocks, elements


def _containers(elements: list[Element]) -> set[Element]:
    """What the page's text stands in; empty if nothing says so."""
    plain = lambda x: x.size - x.links
    able = [x for x in elements if x.main and not x.boiler and x.size]
    # of the strongest kind, the one with the most text outside of links; the first of equals
    best = max((x for x in able if x.main < 4), key=lambda x: (x.main == 2, x.main, plain(x)), default=None)
    while best is not None and best.parent is not None and best.parent.main == best.main and not best.parent.boiler:
        best = best.parent
    inside = _under(elements, {best}) if best is not None and best.main == 2 and plain(best) else None
    articles = [x for x in able if x.main == 4 and (inside is None or x in inside)]  # an article beside a main element is none of its text
    articles = [x for x in articles if 2 * x.links <= x.size] or articles
    nested = _under(elements, set(articles))
    articles = [x for x in articles if x not in nested]
    if articles and (best is None or 3 * sum(map(plain, articles)) >= plain(best)):
        return set(articles)
    return {best} if best is not None else set()


def _under(elements: list[Element], tops: set[Element]) -> set[Element]:
    """The elements below any of ``tops``."""
    found: set[Element] = set()
    for x in elements:
        if x.parent is not None and (x.parent in tops or x.parent in found):
            found.add(x)
    return found


class Page:
    """A page read: its blocks, each with its element, and which elements may be templates."""

    def __init__(self, page: str | None) -> None:
        self.blocks, self.elements = blocks_of(page or "")
        containers = _containers(self.elements)
        above: set[Element] = set()  # what holds the text
        for x in containers:
            while x is not None and x not in above:
                above.add(x)
                x = x.parent
        self.open: dict[Element, None] = {}
        for x in self.elements:
            up = x.parent
            x.best = x if x in containers else up.best if up is not None else None
            if up is not None and x not in containers:
                x.headed, x.heading = up.headed or x.head, up.heading or x.tag in HEADINGS
            in_article = x.best is not None and x.best.main == 4
            if up is not None and x.size and x not in above and x.tag not in ("html", "body") and not (in_article and x.tag in PROSE and not x.links and not x.boiler):
                self.open[x] = None
        self.bare = not containers

    def hashes(self) -> list[int]:
        """Of the subtrees that may be templates."""
        return list(dict.fromkeys(x.value for x in self.open))

    def _text(self, own: Element) -> bool:
        if own.boiler or own.best is None and not self.bare:
            return False
        if own.headed and not (own.heading and own.best is not None):
            return False
        return not (own.best is None and own.size and own.links > 0.7 * own.size and own.tag not in ("p", "body", "html", ""))

    def left(self, templates: set[int]) -> tuple[list[str], int, int]:
        """The texts of the blocks that are left, how many went as templates, and how many otherwise."""
        for x in self.elements:
            x.dead = x.parent is not None and x.parent.dead or bool(templates) and x in self.open and x.value in templates
        out, gone, other = [], 0, 0
        for text, own in self.blocks:
            if own.dead:
                gone += 1
            elif self._text(own):
                out.append(text)
            else:
                other += 1
        return out, gone, other


HOST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def known(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host and mark (a digest of host and html) of every page."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit(""))
    return rows.withColumn("host", host).withColumn("mark", F.unhex(F.md5(F.concat("host", F.lit("\x00"), "html"))))


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, mark, sign, hash) of :func:`known` pages: each subtree that may be a template; sign is a hash of the page's
    text with its templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, 2, 1 << 22):
                signs, found = [], []
                for page in batch.column(2).to_pylist():
                    own = Page(page)
                    found.append(own.hashes())
                    signs.append(xxhash.xxh64_intdigest("\n".join(own.left(set())[0]).encode("utf-8", "surrogatepass")) - (1 << 63))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signs, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["host", "mark", "sign", "hashes"])

    found = through_python(pages.select("host", "mark", "html"), run, "host string, mark binary, sign long, hashes array<long>")
    return found.select("host", "mark", "sign", F.explode("hashes").alias("hash"))


def templates(each: DataFrame, least: int = PAGES) -> DataFrame:
    """(host, hash): of :func:`subtrees`, those that recur across a host's different pages."""
    counted = each.select("host", "sign", "hash").distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least).select("host", "hash")


def extracted(pages: DataFrame, least: int = PAGES) -> DataFrame:
    """page_id, url, text, n_chars, n_templates and n_others (blocks that went as templates, and otherwise) of every page.

    Pages are read twice, as that takes less disk than keeping their elements between the passes."""
    rows = known(pages)
    each = written(subtrees(rows), "subtrees")
    sites = written(templates(each, least), "templates").select(F.col("host").alias("_host"), F.col("hash").alias("_hash"))
    # a subtree, and a page with its copies, may make up a third of all pages; they have one row on the other side of
    # these joins, and Spark splits their rows
    met = each.join(sites.hint("merge"), (F.col("host") == F.col("_host")) & (F.col("hash") == F.col("_hash")))
    gone = met.groupBy(F.col("mark").alias("_mark")).agg(F.collect_set("hash").alias("templates"))  # at most the elements of a page
    out = rows.join(written(gone, "gone").hint("merge"), F.col("mark") == F.col("_mark"), "left")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, 2, 1 << 22):
                found = [Page(page).left(set(own or ())) for page, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                texts = ["\n".join(x) for x, _, _ in found]
                numbers = [pa.array(x, pa.int64()) for x in (map(len, texts), (n for _, n, _ in found), (n for _, _, n in found))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), *numbers], names=["page_id", "url", "text", "n_chars", "n_templates", "n_others"])

    return through_python(out.select("page_id", "url", "html", "templates"), run, f"page_id {kind}, url string, text string, n_chars long, n_templates long, n_others long")


def op7(pages: DataFrame) -> DataFrame:
    return extracted(pages)
