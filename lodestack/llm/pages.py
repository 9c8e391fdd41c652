"""Main text of web pages by equivalence-class template deduction, host by host.

Every page becomes a sequence of tokens: opening and closing tags with the path of open elements, and
whole text nodes of any length with their path. A token's occurrence vector says how often each page
of the host holds it; it is kept as a count and a sum of hashes, so a host may hold any share of all
pages. Then, for each host:

1. tokens that enough pages hold are grouped by equal occurrence vectors (an equivalence class); a
   class counts if it is large: a few tags or words of constant text;
2. a class is valid if on (nearly) every page its tokens come in the same order, cycle after cycle, no
   cycle overlaps another class's (they nest or follow each other), and it always nests in the same gap
   of the same class; all others are dropped. The valid classes are the template;
3. what stands between two neighbouring template tokens is a slot. Constant text is template itself and
   goes; slots that hold nearly nothing but links on the host's pages are menus and go; where articles
   (or ``main``) hold most of the host's slot text, what lies outside them goes. The other slots are
   the page's text.

A host with too few different pages shows no template; its pages are judged each by itself. In either
case blocks under elements that say that they hold no main text (menus, headers, footers, sidebars,
notices, adverts, forms, comments: by tag, role, or a class or id made of such words only) are left out.
Inside an article nothing is left out as template or menu.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import batch_of
from lodestack.scratch import discard, materialise

#: A token is frequent if this share of a host's pages, and at least this many pages, hold it.
SUPPORT, LEAST_PAGES = 0.5, 3
#: Tags and words that make a class large; share of its pages that may break a valid class.
LARGE, BROKEN = 3, 0.05
#: Share of link text from which a slot is a menu; share of text from which articles are preferred.
LINKS, ARTICLES = 0.8, 0.5
#: Template tokens of all hosts that are broadcast (8 bytes each); more of them go by a shuffle join.
BROADCAST_TOKENS = 4_000_000

# Names of elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
BLOCK_ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ASIDE = frozenset("nav header footer aside form button menu dialog fieldset".split())
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "nav navbar navigation menu menus breadcrumb breadcrumbs footer sidebar aside widget widgets related recommended share sharing social toolbar pagination pager "
    "comment comments commentlist respond disqus reply replies".split()
)
HEAD_WORDS = frozenset("header masthead banner topbar".split())
CONTENT_WORDS = frozenset("post article entry story content chapter section".split())
FILLERS = frozenset(
    "a area b bar block blog body bottom box button buttons center col column container content count desktop fixed float form global group head icon icons id inline inner item items large left link links list main media message middle "
    "mobile new news outer page panel policy post posts primary article articles reader region right row secondary section site slot small sticky stories story sub text top unit user view wrap wrapper x zone the and us our".split()
)
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def _named_side(name: str) -> bool:
    """Whether a class or an id is made of words for side matter; a word of its own (related-work) says that it is not."""
    words = set(_WORDS.findall(name))
    if words & SIDE_WORDS:
        return words <= SIDE_WORDS | HEAD_WORDS | FILLERS
    return bool(words & HEAD_WORDS) and not words & CONTENT_WORDS and words <= HEAD_WORDS | FILLERS


def _side(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element says that it holds no main text, and whether it says that it holds all of it."""
    side, main = name in ASIDE, name in ("article", "main")
    if attributes and ("=" in attributes or "hidden" in attributes.lower()):
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values).lower()
            if key in ("class", "id"):
                side = side or any(map(_named_side, value.split()))
            elif key == "role":
                side, main = side or value.strip() in SIDE_ROLES, main or value.strip() == "main"
            elif (key == "aria-hidden" and value == "true") or key == "hidden" or (key == "style" and "display:none" in value.replace(" ", "")):
                side = True
    return side, main and not side


class Page:
    """A page's tokens and blocks in order.

    ``blocks`` are ``(token, side, inside, links, text)``: side matter by its names, inside an article,
    characters of link text. ``order`` is the sequence of the page: template tokens as they are, and
    blocks as ``~number``; inside an article there are only blocks, and their token is 0.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[int, bool, bool, int, str]] = []
        self.order: list[int] = []
        self.stack: list[tuple[str, bool, bool]] = []
        self.parts: list[str] = []
        self.link, self.linked = False, 0
        at, end, lower = 0, len(source), None
        while at < end:
            m = _TAG.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if m.group(2) is None:
                if m.group().startswith("<![CDATA["):
                    self._text(m.group()[9:].removesuffix("]]>"))
                continue
            name = m.group(2).lower()
            if name == "a":
                self.link = not m.group(1)
            if m.group(1):
                self._close(name)
            elif name in RAW:
                if not m.group(3).rstrip().endswith("/"):
                    lower = source.lower() if lower is None else lower
                    stop = lower.find(f"</{name}", at)
                    stop = end if stop < 0 else stop
                    at = lower.find(">", stop) + 1 or end
            elif name == "br":
                self.parts.append(" ")
            elif name not in VOID:
                self._open(name, m.group(3) or "")
            elif name == "hr":
                self._flush()
        self._flush()

    def _text(self, raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if self.link:
            self.linked += len(text)

    def _path(self) -> str:
        return "/".join([x[0] for x in self.stack])

    def _flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            links, self.parts, self.linked = min(self.linked, len(text)), [], 0
            if text:
                _, side, inside = self.stack[-1] if self.stack else ("", False, False)
                self.order.append(~len(self.blocks))
                self.blocks.append((0 if inside else token(self._path() + ">" + text), side, inside, links, text))

    def _open(self, name: str, attributes: str) -> None:
        side, main = _side(name, attributes)
        if name in INLINE and not side:
            return
        self._flush()
        if name in BLOCK_ENDS_P:
            self._pop(("p",), ("article", "div", "section", "main", "td", "li", "body", "blockquote"))
        if name == "li":
            self._pop(("li",), ("ul", "ol", "menu"))
        _, side_above, inside = self.stack[-1] if self.stack else ("", False, False)
        if inside and not side_above and (name == "header" or (side and not _side(name, _HEADLESS.sub(" ", attributes))[0])):
            side = False  # an article's own heading
        mark = zlib.crc32(_SPACE.sub(" ", attributes.strip()).encode("utf-8", "replace")) if attributes and ("class" in attributes or "id=" in attributes) else 0
        self.stack.append((f"{name}.{mark:08x}" if mark else name, side_above or side, inside or (main and not side_above)))
        if not inside:
            self.order.append(token("<" + self._path()))

    def _cut(self, i: int) -> None:
        """Close the i-th open element and all within it."""
        for j in range(len(self.stack) - 1, i - 1, -1):
            if not (j and self.stack[j - 1][2]):
                self.order.append(token("</" + "/".join([x[0] for x in self.stack[: j + 1]])))
        del self.stack[i:]

    def _pop(self, names: tuple[str, ...], stop: tuple[str, ...]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0].split(".")[0]
            if name in names:
                self._cut(i)
                return
            if name in stop:
                return

    def _close(self, name: str) -> None:
        if name in INLINE and not any(x[0].split(".")[0] == name for x in self.stack):
            return
        self._flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0].split(".")[0] == name:
                self._cut(i)
                return

    def tokens(self) -> dict[int, tuple[int, int, int]]:
        """Of each token: how often, the place where it is first, and its words (a tag counts as one)."""
        out: dict[int, tuple[int, int, int]] = {}
        for place, x in enumerate(self.order):
            words = 1
            if x < 0:
                x, words = self.blocks[~x][0], self.blocks[~x][4].count(" ") + 1
            if x:
                n, first, _ = out.get(x, (0, place, 0))
                out[x] = n + 1, first, words
        return out

    def slots(self, template: frozenset[int] | set[int]) -> Iterator[tuple[int, int, bool]]:
        """Each block's number, the template token before it (0: none), and whether it is template itself."""
        slot = 0
        for x in self.order:
            if x < 0:
                own = self.blocks[~x][0]
                yield ~x, slot, own in template
                x = own
            if x in template:
                slot = x

    def main_text(self, template: frozenset[int] | set[int] = frozenset(), menus: frozenset[int] | set[int] = frozenset(), articles: bool | None = None) -> str:
        """The text of the slots that hold it. ``articles``: what the host's pages say (None: this page decides)."""
        kept = []
        for i, slot, constant in self.slots(template):
            _, side, inside, links, text = self.blocks[i]
            if not side and (inside or not (constant or (slot in menus and links >= LINKS * len(text)))):
                kept.append((inside, text))
        within = sum(len(text) for inside, text in kept if inside)
        if within and (within >= ARTICLES * sum(len(text) for _, text in kept) if articles is None else articles):
            kept = [x for x in kept if x[0]]
        return "\n\n".join(text for _, text in kept)


_HEADLESS = re.compile("|".join(sorted(HEAD_WORDS)), re.IGNORECASE)


def token(name: str) -> int:
    """63-bit name of a token, above zero."""
    return (xxhash.xxh3_64_intdigest(name.encode("utf-8", "replace")) >> 1) | 1


def broken(sequence: list[int], places: dict[int, tuple[int, int, int]]) -> tuple[dict[int, int], set[int]]:
    """Of the classes in a page: the gap that each one's first cycle nests in, and those that are not valid there.

    ``places`` has ``(class, index, size)`` of each token. Cycles of a class must run through its tokens
    in order, and what opens within a cycle must end within it, in one gap.
    """
    open_: list[list[int]] = []  # class, last index, size
    parent: dict[int, int] = {}
    bad: set[int] = set()
    for x in sequence:
        if x not in places:
            continue
        c, index, size = places[x]
        if index == 0:
            above = open_[-1][0] * 1_000_003 + open_[-1][1] if open_ else 0
            above &= (1 << 62) - 1
            if parent.setdefault(c, above) != above:
                bad.add(c)
            if any(o[0] == c for o in open_):
                bad.add(c)
                open_ = [o for o in open_ if o[0] != c]
            if size > 1:
                open_.append([c, 0, size])
            continue
        if not any(o[0] == c for o in open_):
            bad.add(c)
            continue
        while open_[-1][0] != c:  # what is still open within this cycle overlaps it
            bad.add(open_.pop()[0])
        if open_[-1][1] + 1 != index:
            bad.add(c)
            open_.pop()
        elif index + 1 == size:
            open_.pop()
        else:
            open_[-1][1] = index
    bad.update(o[0] for o in open_)
    return parent, bad


def _near(table: DataFrame, side: DataFrame, tokens: str) -> DataFrame:
    """``table`` with the host's row of ``side`` (``on_host`` and arrays); broadcast only if it is counted to be small."""
    n = side.agg(F.sum(F.size(tokens))).first()[0] or 0
    return table.join(F.broadcast(side) if n <= BROADCAST_TOKENS else side, F.col("host") == F.col("on_host"), "left")


def classes(pages: DataFrame, support: float = SUPPORT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``on_host, classes``: for each host its large equivalence classes, as arrays of tokens in page order.

    ``pages`` has ``page_id, host, html``. Rows that repeat a ``page_id`` count as one page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["host", "page_id", "token", "n", "place", "words"], [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            rows = [(h, p, t, *x) for p, h, source in zip(batch.column("page_id").to_pylist(), batch.column("host").to_pylist(), batch.column("html"), strict=True) for t, x in Page(source.as_py()).tokens().items()]
            if rows:
                yield batch_of(names, types, list(zip(*rows, strict=True)))

    seen = pages.select("page_id", "host", "html").mapInArrow(run, "host string, page_id long, token long, n int, place int, words int")
    seen = seen.groupBy("host", "token", "page_id").agg(F.max("n").alias("n"), F.min("place").alias("place"), F.max("words").alias("words"))
    vectors = seen.groupBy("host", "token").agg(F.count("*").alias("pages"), F.sum("n").alias("times"), F.bit_xor(F.xxhash64("page_id", "n")).alias("vector"), F.min(F.struct("page_id", "place")).alias("first"), F.max("words").alias("words"))
    sizes = pages.select("host", "page_id").distinct().groupBy(F.col("host").alias("on_host")).agg(F.count("*").alias("of")).where(F.col("of") >= least_pages)
    frequent = vectors.where(F.col("pages") >= least_pages).join(sizes, F.col("host") == F.col("on_host")).where(F.col("pages") >= support * F.col("of"))
    grouped = frequent.groupBy("on_host", "pages", "times", "vector").agg(F.sum("words").alias("words"), F.array_sort(F.collect_list(F.struct("first", "token"))).alias("members")).where(F.col("words") >= LARGE)
    return grouped.select("on_host", F.col("members.token").alias("tokens")).groupBy("on_host").agg(F.array_sort(F.collect_list("tokens")).alias("classes"))


def templates(pages: DataFrame, support: float = SUPPORT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``on_host, template, menus, articles``: for each host with a template the tokens of its valid classes,
    those whose slot is a menu, and whether articles hold most of the text of its slots."""
    found = materialise(classes(pages, support, least_pages), "classes")
    joined = _near(pages.select("page_id", "host", "html"), found, "classes").where("on_host is not null").select("page_id", "host", "classes", "html")
    names = ["host", "page_id", "kind", "key", "a", "b"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, places = None, {}
        for batch in batches:
            rows = []
            for p, h, groups, source in zip(batch.column("page_id").to_pylist(), batch.column("host").to_pylist(), batch.column("classes"), batch.column("html"), strict=True):
                if h != last:
                    last, places = h, {t: (c, i, len(ts)) for c, ts in enumerate(groups.as_py()) for i, t in enumerate(ts)}
                page = Page(source.as_py())
                parent, bad = broken([page.blocks[~x][0] if x < 0 else x for x in page.order], places)
                rows += [(h, p, 0, c, above, int(c in bad)) for c, above in parent.items()]
                rows += [(h, p, 0, c, 0, 1) for c in bad if c not in parent]
                mass: dict[int, list[int]] = {}
                articles = [0, 0]
                for i, slot, constant in page.slots(places.keys()):
                    _, side, inside, links, text = page.blocks[i]
                    if not side and not constant:
                        articles[0] += len(text) * inside
                        articles[1] += len(text)
                        if not inside:
                            m = mass.setdefault(slot, [0, 0])
                            m[0] += links
                            m[1] += len(text)
                rows += [(h, p, 1, slot, *m) for slot, m in mass.items()]
                rows.append((h, p, 2, 0, *articles))
            if rows:
                yield batch_of(names, types, list(zip(*rows, strict=True)))

    said = joined.mapInArrow(run, "host string, page_id long, kind int, key long, a long, b long")
    said = materialise(said.dropDuplicates(["host", "page_id", "kind", "key"]), "said")  # rows with the same html count once
    nested = said.where("kind = 0").groupBy("host", "key", "a").agg(F.count("*").alias("pages"), F.sum("b").alias("broken"))
    nested = nested.groupBy("host", "key").agg(F.max("pages").alias("most"), F.sum("pages").alias("pages"), F.sum("broken").alias("broken"))
    valid = nested.where(F.col("pages") - F.col("most") + F.col("broken") <= BROKEN * F.col("pages")).select(F.col("host").alias("v_host"), F.col("key").cast("int").alias("number"))
    summed = said.where("kind > 0").groupBy("host", "kind", "key").agg(F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"))
    tokens = valid.join(found, F.col("v_host") == F.col("on_host")).select("on_host", F.explode(F.element_at("classes", F.col("number") + 1)).alias("token"))
    template = tokens.groupBy("on_host").agg(F.collect_set("token").alias("template"))
    menus = summed.where((F.col("kind") == 1) & (F.col("sum_a") >= LINKS * F.col("sum_b"))).groupBy(F.col("host").alias("m_host")).agg(F.collect_set("key").alias("menus"))
    articles = summed.where("kind = 2").select(F.col("host").alias("a_host"), (F.col("sum_a") >= ARTICLES * F.col("sum_b")).alias("articles"))
    out = template.join(menus, F.col("on_host") == F.col("m_host"), "left").join(articles, F.col("on_host") == F.col("a_host"), "left")
    out = materialise(out.select("on_host", "template", "menus", "articles"), "template")
    discard(found, said)
    return out


def main_text(pages: DataFrame, support: float = SUPPORT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every row of ``pages`` (``page_id, url, html``).

    Blocks stand in page order, joined by two line feeds; white space inside a block is one space;
    character references are decoded. Null html counts as empty; pages without main text get the
    empty text. A page whose url is null or has no host belongs to the host "". A null ``page_id``
    stays null; repeated rows each give a row, and rows with the same html are one page of the
    template; other columns are ignored. An empty table gives an empty result.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    found = templates(rows.select(F.xxhash64("html").alias("page_id"), "host", "html"), support, least_pages)
    joined = _near(rows, found, "template").select("page_id", "url", "host", "template", "menus", "articles", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, (frozenset(), frozenset(), None)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = []
            for h, t, m, articles, source in zip(batch.column("host").to_pylist(), batch.column("template"), batch.column("menus"), batch.column("articles").to_pylist(), batch.column("html"), strict=True):
                if h != last:
                    last, known = h, (frozenset(t.as_py() or ()), frozenset(m.as_py() or ()), articles)
                texts.append(Page(source.as_py()).main_text(*known))
            yield batch_of(["page_id", "url", "text", "n_chars"], [pa.int64(), pa.string(), pa.string(), pa.int64()], [batch.column("page_id"), batch.column("url"), texts, [len(t) for t in texts]])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
