"""Main text of web pages, with the templates of each site removed.

Pass 1 parses every page into elements, hashes each block element's subtree from
its children's hashes and counts in Spark, for each host, on how many different
pages each subtree occurs. Pass 2 parses again, deletes the subtrees that recur
and the elements that are no article text by their kind (navigation, headers,
footers, sidebars, forms, scripts, styles, adverts, notices, reader comments) and
returns the text that is left.

A subtree recurs when it stands beside different content: pages are counted by
the hash of the content that they have besides the subtree, so any number of copies
of a page count once, and a page counts only if that rest is at least 1/``SMALL``
as long as the subtree, so a copied article in changing surroundings is no template.
From ``MIN_SHARE`` of the host's different pages on, but from ``MIN_PAGES`` and at
most ``MANY`` of them, it is deleted. Outside an article the words of links do not
enter the hash: a menu is the same template whatever it links to. Paragraphs, headings
and list items are templates as part of a block only, never alone.

Kinds are told by tags, and by whole names in class, id and role: a name is read in its
words, so ``main-nav`` is navigation, while ``has-sidebar`` or ``nav-tabs-wrapper`` say
something about an article's surroundings. Headings have no such names. A named
element goes unless it holds the article itself: the largest ``article`` or ``main`` of the page,
or, for names that say little (social, menu, banner, search, ...), four fifths of the text outside one;
no name deletes all there is.

The main text is that of the ``article`` or ``main`` with the most text of its own, and of
the others with a quarter of that at least; smaller ones are teasers or comments. Where the page's
paragraphs outside hold over twice as much, its body is the main text.

Counting is pre-aggregated, so a host with most of the pages makes no hot task.
Templates are broadcast up to ``MAX_BROADCAST_BYTES``, measured first; beyond
that, pages join them by host, hot hosts apart from the rest.

Defined cases: null and empty html give an empty text; a null url is a host of
its own; broken markup is read as far as it goes (unclosed elements end with
their parent, a stray end tag is ignored, an unclosed comment, script or tag runs to
the end); pages of any length and depth are read in time in proportion to their length;
repeated page_ids are separate rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, materialise, small_batches

MIN_PAGES, MIN_SHARE, MANY, SMALL = 5, 0.2, 50, 8
MAX_BROADCAST_BYTES = 32 << 20

#: To the end of a tag, or of the page; quotes count in values only. Nothing is read twice: the groups are possessive.
_REST = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+"
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|xmp)\b{_REST}(?:>|\Z).*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>{_REST})(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img ruby rt rp".split())
_CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd figcaption td th tr".split())
_DROP = frozenset("head nav footer aside button select option menu dialog object svg canvas audio video map".split())
_PARAGRAPH = frozenset("p pre blockquote".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of what is no article text: plain ones, and ones that also say what surrounds an article.
_PLAIN = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors cookie cookies newsletter popup "
    "breadcrumb breadcrumbs pagination sidebar comments commentlist disqus replies responses nav navbar navigation".split()
)
_VAGUE = frozenset("banner notice notices alert share sharing related footer contentinfo complementary search login widget promo promotion header masthead menu social modal consent subscribe".split())
#: Vague names that count as the last word of a name, too; what names a part of an article before "header"; what tells a state or a frame.
_VAGUE_LAST = frozenset("banner notice notices alert share sharing footer header masthead menu widget promo modal".split())
_OF_ARTICLE = frozenset("entry post article story content title".split())
_STATE = frozenset("has with no without is show hide not enable".split())
_FRAME = frozenset("enabled disabled open closed active visible fixed page wrapper wrap layout body main content".split())
#: Words that name a kind with one of the second set behind them.
_FIRST = frozenset("ad ads advert advertisement cookie cookies sidebar comment comments share social promo sponsor sponsored newsletter related nav".split())
_THING = frozenset("slot box bar block area section list container notice banner unit links buttons left right top bottom form widget icons panel thread message popup".split())
_GLUED = re.compile(r"(?:comments|sidebar|adslot|adverts?|advertisement|newsletter|navbar|breadcrumbs?)$")
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_CAMEL, _WORD = re.compile(r"([a-z0-9])([A-Z])"), re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
#: Share of the text outside an article that keeps a vaguely named element; share of the main text that makes an article part of it; how much more a page's body must hold.
_MOSTLY, _PART, _MORE = 0.8, 0.25, 2
_SPACE, _BLANK = re.compile(r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"), "\x20\x09\x0a\x0b\x0c\x0d"
#: Kinds of elements that end by themselves: which they are, and behind which others they are out of reach.
_KINDS = (
    (frozenset({"p"}), frozenset("button td th li div article section main body".split())),
    (frozenset({"li"}), frozenset("ul ol menu".split())),
    (frozenset({"dt", "dd"}), frozenset({"dl"})),
    (frozenset({"tr"}), frozenset({"table", "tbody"})),
    (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    (frozenset({"option"}), frozenset({"select"})),
)
#: The kind of open element that a start tag ends.
_ENDS = dict.fromkeys("p div ul ol dl table h1 h2 h3 h4 h5 h6 blockquote pre section article aside nav footer header main form hr figure address fieldset".split(), 0)
_ENDS |= {"li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
_TOUCHED = {t: [(k, t in own) for k, (own, stops) in enumerate(_KINDS) if t in own or t in stops] for t in frozenset().union(*(own | stops for own, stops in _KINDS))}
_ALL = (1 << 64) - 1


class Element:
    """mark: 0 none, 1 vague, 2 plain; near: depth of the open element of each kind that is in reach; box: the article or main it is in.

    hash, loose: of the subtree, exact and without words of links; total: sum of the hashes of its texts; chars: their length.
    """

    __slots__ = ("tag", "parent", "drop", "inside", "link", "paragraph", "heading", "near", "mark", "box", "hash", "loose", "total", "chars")

    def __init__(self, tag: str, parent: int, up: Element | None, near: tuple):
        self.tag, self.parent, self.near = tag, parent, near
        self.drop = up is not None and up.drop or tag in _DROP
        self.inside = up is not None and up.inside or tag in ("article", "main")
        self.link = up is not None and up.link or tag == "a"
        self.paragraph = up is not None and up.paragraph or tag in _PARAGRAPH
        self.heading = up is not None and up.heading or tag in _HEADING
        self.box = up.box if up is not None else 0
        self.mark = self.hash = self.loose = self.total = self.chars = 0


def _hash(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=8).digest()


@functools.lru_cache(1 << 16)
def kind_of(names: str, inside: bool) -> int:
    """What the names in a class, id or role say: 0 nothing, 1 vaguely and 2 plainly no article text. Inside an article headers and vague last words say nothing."""
    found = 0
    for name in names.split():
        words = _WORD.findall(_CAMEL.sub(r"\1-\2", name).lower())
        if not words:
            continue
        first, last = words[0], words[-1]
        if len(words) == 1:
            plain, vague = first in _PLAIN or _GLUED.search(first), first in _VAGUE and not (inside and first in ("header", "masthead"))
        elif first in _STATE or last in _FRAME:
            continue
        else:
            thing = first in _FIRST and words[1] in _THING
            plain = last in _PLAIN or thing and (first in _PLAIN or first == "comment")
            vague = thing or not inside and last in _VAGUE_LAST and not (last == "header" and first in _OF_ARTICLE)
        found = 2 if plain else max(found, 1 if vague else 0)
        if found == 2:
            break
    return found


def _mark(tag: str, attrs: str, inside: bool) -> int:
    """The kind of an element by its tag and attributes."""
    found = 1 if tag == "form" or tag == "header" and not inside else 0
    if attrs and tag not in _HEADING:
        for name, a, b, c in _ATTRIBUTE.findall(attrs):
            name, value = name.lower(), a or b or c
            if name in ("class", "role") or name == "id" and tag not in _CONTENT:
                found = max(found, kind_of(value, inside))
            elif name == "hidden" or name == "style" and _HIDDEN.search(value):
                found = max(found, 1)
    return found


def parse(source: str) -> tuple[list[Element], list[str], list[int], list[tuple[int, int]]]:
    """Elements in page order, the pieces of text between tags (decoded; block tags leave a space), each piece's element, and the number of pieces at each element's end."""
    root = Element("", -1, None, (0,) * len(_KINDS))
    elements, pieces, owner, closed, stack, opened = [root], [], [], [], [0], {}

    def put(text: str) -> None:
        pieces.append(text)
        owner.append(stack[-1])

    def close(depth: int) -> None:
        while len(stack) > depth:
            e = elements[stack[-1]]
            if e.tag not in _INLINE:
                put(" ")
            closed.append((len(pieces), stack.pop()))
            opened[e.tag] -= 1

    at = 0
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            text = source[at : m.start()]
            put(entities.unescape(text) if "&" in text else text)
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            if opened.get(tag):
                depth = len(stack) - 1
                while elements[stack[depth]].tag != tag:
                    depth -= 1
                close(depth)
            continue
        if tag in _ENDS and elements[stack[-1]].near[_ENDS[tag]]:
            close(elements[stack[-1]].near[_ENDS[tag]])
        if tag not in _INLINE:
            put(" ")
        attrs = m["attrs"]
        if tag in _VOID or attrs.endswith("/") and tag in ("svg", "path"):
            continue
        up = elements[stack[-1]]
        near = up.near
        if tag in _TOUCHED:
            near = list(near)
            for k, own in _TOUCHED[tag]:
                near[k] = len(stack) if own else 0
            near = tuple(near)
        e = Element(tag, stack[-1], up, near)
        if not e.drop and tag not in ("html", "body"):
            e.mark = _mark(tag, attrs.strip(), up.inside)
        if tag in ("article", "main"):
            e.box = len(elements)
        elements.append(e)
        stack.append(len(elements) - 1)
        opened[tag] = opened.get(tag, 0) + 1
    if at < len(source):
        text = source[at:]
        put(entities.unescape(text) if "&" in text else text)
    close(1)
    return elements, pieces, owner, closed


def _clean(text: str) -> str:
    return _SPACE.sub(" ", text).strip(_BLANK)


def tidy(pieces: list[str]) -> str:
    return _clean("".join(pieces))


def _lengths(elements: list[Element], pieces: list[str], owner: list[int]) -> tuple[list[int], list[int]]:
    """Own text of each element without headings and links: all of it, and that in paragraphs."""
    every, paragraphs = [0] * len(elements), [0] * len(elements)
    for text, k in zip(pieces, owner):
        e = elements[k]
        if not (e.drop or e.link or e.heading):
            n = len(text) - text.count(" ") if len(text) < 64 else len(_clean(text))
            every[k] += n
            if e.paragraph:
                paragraphs[k] += n
    return every, paragraphs


def _by_box(elements: list[Element], own: list[int], gone: list[bool]) -> dict[int, int]:
    """Text of each article and main besides those in it, and of the page besides them (0)."""
    out = {0: 0}
    for k, e in enumerate(elements):
        if not gone[k]:
            out[e.box] = out.get(e.box, 0) + own[k]
    return out


def _main_boxes(elements: list[Element], every: list[int], paragraphs: list[int], gone: list[bool]) -> tuple[int, set[int]]:
    """The box with the main text (0: the page's body), and all boxes that are part of it."""
    own = _by_box(elements, every, gone)
    outside = _by_box(elements, paragraphs, gone)[0]
    boxes = {b: n for b, n in own.items() if b}
    most = max(boxes, key=lambda b: (boxes[b], -b), default=0)
    if not boxes or outside > _MORE * boxes[most]:
        return 0, {0} | {b for b, n in boxes.items() if n >= _PART * outside}
    return most, {b for b, n in boxes.items() if n >= _PART * boxes[most]}


def kept(elements: list[Element], pieces: list[str], owner: list[int]) -> tuple[list[bool], set[int]]:
    """Of each element whether it is deleted by its kind, or with one above it, and the boxes of the main text."""
    every, paragraphs = _lengths(elements, pieces, owner)
    under = list(every)
    for k in range(len(elements) - 1, 0, -1):
        under[elements[k].parent] += under[k]
    gone = [e.drop for e in elements]
    for kind in (2, 1):
        main, above = 0, set()
        if kind == 1:
            main = k = _main_boxes(elements, every, paragraphs, gone)[0]
            while k > 0:
                above.add(k)
                k = elements[k].parent
        left = _by_box(elements, every, gone)
        now = [False] * len(elements)
        for k in range(1, len(elements)):
            e = elements[k]
            if gone[k] or now[e.parent]:
                now[k] = True
            elif e.mark == kind and k not in above:
                # what is left of the scope without it: of its article, or of the page
                scope = elements[e.parent].box
                whole = under[scope] if scope else under[0]
                rest = whole - under[k]
                mostly = kind == 1 and not scope and under[k] >= _MOSTLY * whole
                now[k] = not (under[k] and (rest <= 0 or mostly))
        gone = now
        if kind == 2:  # what went is no part of the whole that follows
            under = [0 if g else n for g, n in zip(gone, every)]
            for k in range(len(elements) - 1, 0, -1):
                under[elements[k].parent] += under[k]
    return gone, _main_boxes(elements, every, paragraphs, gone)[1]


def hash_subtrees(elements: list[Element], pieces: list[str], owner: list[int], closed: list[tuple[int, int]], gone: list[bool]) -> None:
    """Hashes of what is not deleted, each from its texts and the hashes of its children in order."""
    parts, plain = [[] for _ in elements], [[] for _ in elements]
    ends = iter([*closed, (len(pieces) + 1, 0)])
    end, k = next(ends)
    for i in range(len(pieces) + 1):
        while end <= i:
            e = elements[k]
            if not gone[k]:
                up, name = e.parent, e.tag.encode("utf-8", "surrogatepass")
                one = _hash(b"\0".join((name, *parts[k])))
                two = one if parts[k] == plain[k] else _hash(b"\0".join((name, *plain[k])))
                e.hash, e.loose = int.from_bytes(one, "little", signed=True), int.from_bytes(two, "little", signed=True)
                parts[up].append(b"\1" + one)
                plain[up].append(b"\1" + two)
                elements[up].total = elements[up].total + e.total & _ALL
                elements[up].chars += e.chars
            parts[k] = plain[k] = ()
            end, k = next(ends)
        if i < len(pieces) and not gone[owner[i]]:
            clean = _clean(pieces[i])
            if clean:
                e, raw = elements[owner[i]], clean.encode("utf-8", "surrogatepass")
                parts[owner[i]].append(raw)
                plain[owner[i]].append(b"" if e.link else raw)
                e.total = e.total + int.from_bytes(_hash(raw), "little") & _ALL
                e.chars += len(clean)


def _candidate(e: Element) -> bool:
    """Elements that may be templates: blocks, but no paragraphs, headings, items or cells alone, nor the article itself."""
    return e.tag not in _INLINE and e.tag not in ("html", "body", "article", "main") and e.tag not in _CONTENT


def subtrees(source: str) -> tuple[int, set[tuple[int, bool, int]]]:
    """Hash of a page's content; of each candidate its hash, whether it is inside an article, and the hash of the content besides it, if that is long enough."""
    elements, pieces, owner, closed = parse(source)
    gone, _ = kept(elements, pieces, owner)
    hash_subtrees(elements, pieces, owner, closed, gone)
    page, found = elements[0], set()
    for k, e in enumerate(elements):
        if k and e.chars and not gone[k] and _candidate(e) and SMALL * (page.chars - e.chars) >= e.chars:
            found.add((e.hash if e.inside else e.loose, e.inside, page.total - e.total & _ALL))
    return page.total, found


def main_text(source: str, templates: frozenset[int] = frozenset(), inner: frozenset[int] = frozenset()) -> str:
    """templates, inner: hashes that recur enough to be deleted outside and inside an article."""
    elements, pieces, owner, closed = parse(source)
    gone, boxes = kept(elements, pieces, owner)
    if templates or inner:
        hash_subtrees(elements, pieces, owner, closed, gone)
        for k in range(1, len(elements)):
            e = elements[k]
            gone[k] = gone[k] or gone[e.parent] or (e.hash in inner if e.inside else e.loose in templates) and _candidate(e)
        boxes = _main_boxes(elements, *_lengths(elements, pieces, owner), gone)[1]
    out, last = [], True
    for piece, k in zip(pieces, owner):
        here = elements[k].box in boxes and not gone[k]
        if here:
            out.append(piece if last else " " + piece)
        last = here
    return tidy(out)


def host_of(url: str = "url"):
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def site_templates(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """host, hash, inside, n: the templates of each host and the number of different pages that show it."""
    lean = pages.select(host_of(url).alias("host"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        for batch in batches:
            hosts, hashes, insides, rests = [], [], [], []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                page, found = subtrees(source.as_py() or "")
                hosts += [host] * (len(found) + 1)
                hashes += [h for h, _, _ in found] + [None]  # the null counts the page
                insides += [i for _, i, _ in found] + [False]
                rests += [signed(r) for _, _, r in found] + [signed(page)]
            yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "hash": pa.array(hashes, pa.int64()), "inside": pa.array(insides, pa.bool_()), "rest": pa.array(rests, pa.int64())})

    seen = lean.mapInArrow(run, "host string, hash bigint, inside boolean, rest bigint").distinct()
    counts = materialise(seen.groupBy("host", "hash", "inside").agg(F.count("*").alias("n")).filter(f"hash IS NULL OR n >= {MIN_PAGES}"), "html-subtrees")
    named = counts.withColumn("host", F.encode("host", "UTF-8"))
    sizes = named.filter("hash IS NULL").select("host", F.col("n").alias("pages"))
    total = sizes.agg(F.sum("pages")).first()[0] or 0
    found = join_counted(named.filter("hash IS NOT NULL").select("host", "hash", "inside", "n"), sizes, "host", "pages", total, F.col("hash"))
    return found.filter(F.col("n") >= F.least(F.lit(float(MANY)), MIN_SHARE * F.col("pages"))).select(F.decode("host", "UTF-8").alias("host"), "hash", "inside", "n")


def extract(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, url, text of every page."""
    small_batches(pages.sparkSession)
    found = site_templates(pages, html, url)
    pick = lambda inside: F.collect_list(F.when(F.col("inside") == inside, F.col("hash")))
    by_host = materialise(found.groupBy("host").agg(pick(False).alias("templates"), pick(True).alias("inner"), F.max("n").alias("n")), "html-templates")
    lean = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.encode(host_of(url), "UTF-8").alias("host"))
    size = by_host.agg(F.sum(F.length("host") + 8 * (F.size("templates") + F.size("inner")) + 32)).first()[0] or 0
    by_host = by_host.withColumn("host", F.encode("host", "UTF-8"))
    if size <= MAX_BROADCAST_BYTES:
        both = lean.join(F.broadcast(by_host), "host", "left")
    else:
        both = join_counted(lean, by_host, "host", "n", lean.count(), F.col("page_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict = {}
        for batch in batches:
            texts = []
            for host, source, outer, inner in zip(batch.column(2), batch.column(3), batch.column(4), batch.column(5)):
                host = host.as_py()
                if host not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[host] = frozenset(outer.as_py() or ()), frozenset(inner.as_py() or ())
                texts.append(main_text(source.as_py() or "", *sets[host]))
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string())})

    types = {c: both.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return both.select("page_id", "url", "host", "html", "templates", "inner").mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op4_html_extract": op4_html_extract}
ORACLE_SQL: dict[str, str] = {}
