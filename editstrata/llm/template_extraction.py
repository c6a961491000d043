"""Main texts of web pages, from templates deduced for each host by classes of tokens with equal occurrence vectors.

1. Tokens. A page is a sequence of tags, told apart by the path of containers that they stand in, and of the texts between two tags. A token's occurrence
   vector holds its count on each page of the host. Spark sums it up as the number of pages, the occurrences, and two sums of hashes of (page, count); equal sums are equal vectors.
2. Classes. Tokens of a host with the same vector, on half of its pages at least, form a class (of two tokens or more). There are at most twice as many such tokens as
   a page of the host has on average, whatever the number of pages.
3. Template. A second reading keeps the classes that are valid: on every page their tokens stand in the same order, again and again, and each round lies in the same slot of the
   same enclosing class. The template is the valid classes, nested in each other's slots. The same reading adds up how much text that is not the
   template's stands under each container of a class that occurs once a page.
4. Slots. The main container is the one that is marked as an article, or else the innermost that holds nearly all of that text. What is left of its slots, without the parts whose
   tags or names say menu, notice, advert, comments and the like, and without texts of the template, is the page's main text.

Hosts with under MIN_PAGES pages, and pages without their host's container, take the container from their own marks. Texts in the main container count as the template's only if
each of MIN_STATIC pages or more of the host has them: an article's own words, copies on a few pages among them, stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import kept, scratch, written
from .url_filter import host_of

#: Pages that a host needs for a template, and for text of the template in its articles.
MIN_PAGES, MIN_STATIC = 3, 8
#: Share of a host's text that a marked container, and any other one, must hold to be the main one.
MARKED, UNMARKED = 0.3, 0.9
#: Hosts or tokens of templates up to which a table of hosts is broadcast (about 50 bytes each); past it, a host of more than HOT pages is joined in parts.
BROADCAST_ROWS, HOT = 100_000, 10_000

# Element names of the HTML standard by what they do, and names that sites give to parts that are no article.
CONTAINERS = set("html head body div section article main nav header footer aside ul ol dl menu table form fieldset figure details dialog blockquote".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noembed noframes xmp template svg math object noscript".split())
DROPPED = set("head nav footer aside form fieldset button select menu dialog".split())
HEAD = set("title meta link style script base noscript template object".split())
OTHER_PARTS = set(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead "
    "cookie cookies consent gdpr notice notices alert alerts newsletter subscribe subscription signup login popup modal overlay share sharing social related recommended recommendations "
    "comment comments commenting disqus respond reply replies discussion widget widgets toolbar pagination pager search contentinfo complementary form".split()
)
MARKS = set("article articlebody post entry content story main".split())
NOT_A_PART = ("has", "with", "no", "without", "is", "not")

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _key(*parts: object) -> int:
    """A positive 63-bit hash, the same in every process."""
    return int.from_bytes(blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1 or 1


@dataclass(frozen=True)
class Element:
    """An open container, or another element that is no part of the article."""

    name: str
    key: int
    mark: int
    dropped: bool
    inside: int  # 1: a main element, 2: an article


_ROOT = Element("", 0, 0, False, 0)


@dataclass(slots=True)
class Event:
    """A tag (text is None) or a text between two tags; stack holds the open containers from the outermost on."""

    token: int
    text: str | None
    block: bool
    stack: tuple[Element, ...]
    opened: Element | None = None

    @property
    def dropped(self) -> bool:
        return bool(self.stack) and self.stack[-1].dropped


def _names(attributes: str) -> tuple[str, list[list[str]]]:
    """Class, id and role without digits, and the words of each name in them."""
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {}
    values = [found.get(k, "") for k in ("class", "id", "role", "itemprop")]
    words = [[w.lower() for w in _WORD.findall(name)] for v in values for name in v.split()]
    if "articleBody" in values[3]:
        words.append(["articlebody"])
    return re.sub(r"\d+", "0", " ".join(values).strip()), words


def _element(parent: Element, name: str, attributes: str) -> Element | None:
    """What an opening tag opens; None if it is neither a container nor a part to drop."""
    signature, words = _names(attributes)
    told = [set(w) for w in words if w and w[0] not in NOT_A_PART]
    inside = 2 if name == "article" else max(parent.inside, int(name == "main"))
    part = any(w & OTHER_PARTS for w in told) and name not in ("html", "body", "main")
    part |= name in DROPPED or name == "article" and parent.inside == 2  # an article in an article: a comment on it
    part |= not inside and name not in ("html", "body") and (name == "header" or any("header" in w for w in told))
    if name not in CONTAINERS and not part:
        return None
    mark = 3 if name == "article" else 2 if name == "main" or ["main"] in words else 1 if any(w & MARKS for w in told) and name not in ("html", "body") else 0
    return Element(name, _key(parent.key, name, signature), mark, parent.dropped or part, inside)


_elements: dict[tuple[Element, str, str], tuple[Element | None, int]] = {}
_closing: dict[tuple[int, str], int] = {}


def _opened(parent: Element, name: str, attributes: str) -> tuple[Element | None, int]:
    """The element and the tag's token; both are remembered, as pages repeat them."""
    if (found := _elements.get(at := (parent, name, attributes))) is None:
        if len(_elements) > 50_000:
            _elements.clear()
        element = _element(parent, name, attributes)
        found = _elements[at] = element, element.key if element else _key(parent.key, "<", name)
    return found


def _closed(parent: Element, name: str) -> int:
    if (found := _closing.get(at := (parent.key, name))) is None:
        if len(_closing) > 50_000:
            _closing.clear()
        found = _closing[at] = _key(*at, "/")
    return found


def events(html: str | None) -> Iterator[Event]:
    """Tags and texts of a page in order. Scripts, styles, comments and the like are passed over; what is left open ends where the page ends, or where the standard closes it."""
    html, at, stack = html or "", 0, ()

    def text(to: int) -> Iterator[Event]:
        if to > at:
            run = html[at:to]
            if not run.isspace():
                yield Event(0, run, False, stack)
            else:
                yield Event(-1, " ", False, stack)

    while match := _TAG.search(html, at):
        yield from text(match.start())
        at = match.end()
        name = (match[2] or match[5] or "").lower()
        if not name:
            continue
        block = name not in INLINE
        if match[1] or match[4]:
            if name in ("body", "html"):
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    stack = stack[:k]
                    break
            yield Event(_closed(stack[-1] if stack else _ROOT, name), None, block, stack)
            continue
        attributes = match[3] or match[6] or ""
        if name in RAW:
            end = _RAW_END[name].search(html, at)
            at = (html.find(">", end.end()) + 1 or len(html)) if end else len(html)
            yield Event(_opened(stack[-1] if stack else _ROOT, name, "")[1], None, False, stack)
            continue
        if stack and stack[-1].name == "head" and name not in HEAD:
            stack = stack[:-1]
        if block and stack and (stack[-1].name == "p" or stack[-1].name == name and name in ("li", "dt", "dd", "td", "th", "tr", "option")):
            stack = stack[:-1]
        if name in ("html", "body") and any(e.name == name for e in stack):
            continue
        element, token = _opened(stack[-1] if stack else _ROOT, name, attributes)
        inner = (*stack, element) if element and name not in VOID else stack
        yield Event(token, None, block, stack, element if inner is not stack else None)
        stack = inner
    yield from text(len(html))


def text_token(event: Event) -> int:
    """The token of a text: its words at its place."""
    return _key(event.stack[-1].key if event.stack else 0, "=", " ".join(event.text.split()))


def _mixed(page: int, count: int) -> tuple[int, int]:
    x = ((page & 0xFFFFFFFFFFFFFFFF) + count * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return x & 0xFFFFFFFF, x >> 32


_TOKENS = "host string, token long, is_text boolean, pages long, occurrences long, low long, high long, first long"


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pages (page hash, host, html) each token's part of the sums, added up within a batch."""
    for batch in batches:
        sums: dict[tuple[str, int, bool], list[int]] = {}
        for k in range(batch.num_rows):
            page, host, html = (batch.column(c)[k].as_py() for c in range(3))
            seen: dict[tuple[int, bool], list[int]] = {}
            for place, e in enumerate(events(html)):
                if e.text is None:
                    token = (e.token, False)
                elif e.token or e.dropped:
                    continue
                else:
                    token = (text_token(e), True)
                seen.setdefault(token, [0, place])[0] += 1
            halves: dict[int, tuple[int, int]] = {}
            for (token, is_text), (count, place) in seen.items():
                low, high = halves.get(count) or halves.setdefault(count, _mixed(page, count))
                into = sums.setdefault((host, token, is_text), [0, 0, 0, 0, 0])
                for at, value in enumerate((1, count, low, high, place)):
                    into[at] += value
        if sums:
            hosts, tokens, texts = zip(*sums, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(tokens, pa.int64()), pa.array(texts), *(pa.array(x, pa.int64()) for x in zip(*sums.values(), strict=True))], [f.split()[0] for f in _TOKENS.split(", ")])


def classes(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each host (host, classes): its classes in the order in which they begin, each with its tokens in order, pages and occurrences. Rows of `pages` are (page, host, html)."""
    tokens = pages.select("page", "host", "html").mapInArrow(_count_tokens, _TOKENS).groupBy("host", "token", "is_text").agg(*(F.sum(c).alias(c) for c in ("pages", "occurrences", "low", "high", "first")))
    few = sizes.count() <= BROADCAST_ROWS
    half = tokens.filter("pages > 1").join(F.broadcast(sizes) if few else sizes, "host").filter((F.col("n_pages") >= MIN_PAGES) & (2 * F.col("pages") >= F.col("n_pages")))
    own = half.groupBy("host", "n_pages", "pages", "occurrences", "low", "high").agg(F.sort_array(F.collect_list(F.struct((F.col("first") / F.col("pages")).alias("place"), "token", "is_text"))).alias("tokens"))
    return own.filter(F.size("tokens") > 1).groupBy("host").agg(F.first("n_pages").alias("n_pages"), F.sort_array(F.collect_list(F.struct(F.col("tokens")[0]["place"].alias("place"), "pages", "occurrences", "tokens"))).alias("classes"))


class Walk:
    """Follows a host's classes along the tokens of a page: which class breaks its order or its nesting, and in which slot of which class each one lies."""

    def __init__(self, tokens: list[list[int]]) -> None:
        self.place = {t: (c, k) for c, members in enumerate(tokens) for k, t in enumerate(members)}
        self.size = [len(members) for members in tokens]
        self.broken: set[int] = set()
        self.parents: dict[int, set[int]] = {}
        self.open: list[list[int]] = []  # class, place of its last token

    def step(self, token: int) -> None:
        if (found := self.place.get(token)) is None:
            return
        c, k = found
        if c in self.broken:
            return
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == c), -1)
        if at < 0:
            if k:
                self.broken.add(c)
                return
            self.parents.setdefault(c, set()).add(self.open[-1][0] * 4096 + self.open[-1][1] if self.open else -1)
            self.open.append([c, 0])
        else:
            self.broken.update(x[0] for x in self.open[at + 1 :])  # an inner class is not over where the outer one goes on
            del self.open[at + 1 :]
            if k != self.open[at][1] + 1:
                self.broken.add(c)
                self.open.pop()
                return
            self.open[at][1] = k
        if k + 1 == self.size[c]:
            self.open.pop()

    def end(self) -> None:
        self.broken.update(x[0] for x in self.open)


_FACTS = "host string, class int, token long, mark int, depth int, wrong long, parent_least long, parent_most long, own_text long, all_text long"


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pages (host, html, classes): each class's faults and slots, and the text under each container, added up within a batch. Class -1, token 0 is the whole page."""
    for batch in batches:
        faults: dict[tuple[str, int], list[int]] = {}
        amounts: dict[tuple[str, int, int, int], list[int]] = {}
        hosts: dict[str, tuple[list[list[int]], set[int], set[int]]] = {}
        for k in range(batch.num_rows):
            host = batch.column(0)[k].as_py()
            if host not in hosts:
                known = batch.column(2)[k].as_py()
                hosts[host] = [[t["token"] for t in c["tokens"]] for c in known], {t["token"] for c in known for t in c["tokens"] if t["is_text"]}, {t["token"] for c in known if c["pages"] == c["occurrences"] for t in c["tokens"] if not t["is_text"]}
            tokens, texts, once = hosts[host]
            walk = Walk(tokens)
            for e in events(batch.column(1)[k].as_py()):
                if e.text is None:
                    walk.step(e.token)
                elif not e.token and not e.dropped:
                    token, size = text_token(e), len(e.text)
                    walk.step(token)
                    own = 0 if token in texts else size
                    for at, (key, mark, depth) in enumerate([(0, 0, 0), *((x.key, x.mark, d) for d, x in enumerate(e.stack, 1))]):
                        if not at or key in once:
                            into = amounts.setdefault((host, key, mark, depth), [0, 0])
                            into[0] += own
                            into[1] += size
            walk.end()
            for c, parents in walk.parents.items():
                into = faults.setdefault((host, c), [0, min(parents), max(parents)])
                into[1], into[2] = min(into[1], *parents), max(into[2], *parents)
            for c in walk.broken:
                faults.setdefault((host, c), [0, -1, -1])[0] += 1
        rows = [(h, c, 0, 0, 0, *x, 0, 0) for (h, c), x in faults.items()] + [(h, -1, key, mark, depth, 0, -1, -1, *x) for (h, key, mark, depth), x in amounts.items()]
        if rows:
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in _FACTS.split(", ")])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of hosts (host, n_pages, classes, facts): the main container's token and the texts of the template."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            valid = {f["class"] for f in r["facts"] if f["class"] >= 0 and not f["wrong"] and f["parent_least"] == f["parent_most"]}
            once = {t["token"] for k, c in enumerate(r["classes"]) if k in valid and c["pages"] == c["occurrences"] for t in c["tokens"]}
            whole = next((f for f in r["facts"] if f["class"] < 0 and not f["token"]), None)
            if whole is None:
                continue
            amount = "own_text" if whole["own_text"] else "all_text"
            under = [f for f in r["facts"] if f["class"] < 0 and f["token"] in once]
            marked = [f for f in under if f["mark"] and f[amount] >= MARKED * whole[amount]]
            other = [f for f in under if f[amount] >= UNMARKED * whole[amount]]
            main = max(marked, key=lambda f: (f["mark"], f[amount], f["depth"])) if marked else max(other, key=lambda f: f["depth"], default=None)
            static = [t["token"] for k, c in enumerate(r["classes"]) if k in valid and c["pages"] == c["occurrences"] == r["n_pages"] >= MIN_STATIC for t in c["tokens"] if t["is_text"]]
            out.append((r["host"], main and main["token"], static if main and main["own_text"] else []))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.list_(pa.int64())))], ["host", "main", "static"])


def by_host(pages: DataFrame, sizes: DataFrame, table: DataFrame, columns: list[str], tokens: Column) -> DataFrame:
    """`pages` with the columns of its host's one row in `table` (null without one). Small tables are broadcast; else the pages of a hot host are dealt out over copies of its row."""
    slim = table.select("host", *columns)
    if table.agg(F.coalesce(F.sum(tokens + 2), F.lit(0))).first()[0] <= BROADCAST_ROWS:
        return pages.join(F.broadcast(slim), "host", "left")
    hot = max(HOT, (sizes.agg(F.coalesce(F.sum("n_pages"), F.lit(0))).first()[0]) // HOT)  # so that there are at most HOT such hosts
    parts = sizes.filter(F.col("n_pages") > hot).select("host", F.ceil(F.col("n_pages") / hot).cast("int").alias("parts"))
    dealt = pages.join(F.broadcast(parts), "host", "left").withColumn("part", F.pmod(F.col("page"), F.coalesce("parts", F.lit(1)))).drop("parts")
    copies = slim.join(F.broadcast(parts), "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1))).drop("parts")
    return dealt.join(copies, ["host", "part"], "left").drop("part")


def templates(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """host, main (the main container's token, null if there is none) and static (tokens of the template's texts) for hosts with a template."""
    known = written(classes(pages, sizes), "classes")
    facts = by_host(pages, sizes, known, ["classes"], F.aggregate("classes", F.lit(0), lambda n, c: n + F.size(c["tokens"]))).filter("classes is not null").select("host", "html", "classes").mapInArrow(_check, _FACTS)
    summed = facts.groupBy("host", "class", "token", "mark", "depth").agg(*(F.sum(c).alias(c) for c in ("wrong", "own_text", "all_text")), F.min("parent_least").alias("parent_least"), F.max("parent_most").alias("parent_most"))
    each = summed.groupBy("host").agg(F.collect_list(F.struct("class", "token", "mark", "depth", "wrong", "parent_least", "parent_most", "own_text", "all_text")).alias("facts"))
    return known.join(each, "host").select("host", "n_pages", "classes", "facts").mapInArrow(_decide, "host string, main long, static array<long>")


def extracted(html: str | None, main: int | None = None, static: frozenset[int] = frozenset()) -> str:
    """The text of a page's main container; without one of that token, of the container of the page that is marked best and holds most, or of the page."""
    page = list(events(html))
    if main is None or not any(e.opened and e.opened.key == main for e in page):
        amounts: dict[int, list[int]] = {}
        for e in page:
            if e.text is not None and not e.dropped:
                for x in e.stack:
                    if x.mark:
                        amounts.setdefault(x.key, [x.mark, 0])[1] += len(e.text) * (not e.token)
        main = max(amounts, key=lambda k: (*amounts[k], k), default=None)
    out: list[str] = []
    for e in page:
        if e.text is None:
            if e.block:
                out.append("\n")
        elif not e.dropped and (main is None or any(x.key == main for x in e.stack)) and not (static and not e.token and text_token(e) in static):
            out.append(unescape(e.text))
    return " ".join("".join(out).split())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for k in range(batch.num_rows):
            html, main, static = (batch.column(c)[k].as_py() for c in (2, 3, 4))
            texts.append(extracted(html, main, frozenset(static or ())))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row of `pages` (page_id, url, html).

    text holds the main container's blocks in page order: character references decoded, white space turned into one space, blocks joined by
    one space; it is empty if there is none. A null html counts as empty. Pages with a null url, or one without a host, are a host of their own. Repeated rows count as
    pages of their own and get equal texts; ids may be null. Other columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host")).withColumn("page", F.xxhash64("page_id", "url", "html"))
    with scratch(pages.sparkSession):
        sizes = kept(rows.groupBy("host").agg(F.count("*").alias("n_pages")), "hosts")
        found = kept(templates(rows, sizes), "templates")
    placed = by_host(rows, sizes, found, ["main", "static"], F.size("static"))
    return placed.select("page_id", "url", "html", "main", "static").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
