"""HTML main-text extraction by equivalence-class template deduction.

1. Every page is cut into tags and texts. A template token is an element by its path (tag names, with a class or id that
   has no digits; containers without one are numbered among their siblings), or a text by its hash. A token's
   occurrence vector is its count on each page of its host.
2. Vectors are compared by a commutative digest (XOR of hashes of (page, count)), which Spark aggregates by host and
   token before anything is shuffled, so a host with a third of all pages is no hot task. Tokens of a host with one
   digest are an equivalence class; element classes of at least two tokens on ``min_pages`` pages or more are valid.
   Pages of a host with equal html count once.
3. Valid classes are nested into a template: the skeleton is the largest class that stands once on nearly all pages
   (``CONSTANT`` percent); a class goes into the innermost element of the skeleton that holds all of its elements, and
   what occurs there once a page refines the skeleton. A host's template is one row no larger than a page.
4. What the template doesn't hold are its slots. Each has the characters that vary in it over all pages, outside
   menus, headers, footers, sidebars, notices, adverts, forms and comments as far as names tell (all characters, if
   hardly any vary: the pages are copies of one article). The main slot is the template's ``article`` or ``main`` if
   the innermost element with all varying text lies inside or around it; else that element, if it is a container and
   doesn't hold the whole page; else the innermost container with half of the characters or more, or its parent if a
   heading that varies stands directly in that. A page yields all that stands in the main
   slot, whether other pages have it or not, without parts named as above.
5. Pages of hosts without a template (fewer than ``min_pages`` distinct pages), and pages that lack their host's main
   slot, are judged alone: by their ``article`` or ``main`` element, else whole.

Blocks begin and end at block elements; character references are decoded; white space in a block becomes one
space; blocks are trimmed and joined by a newline. Defined results: null or empty html gives an empty text; a null or
odd url is a host of its own name (""); repeated pages are extracted each for itself; extra columns are dropped;
unclosed and stray tags are tolerated; an empty table gives no rows. The input must be a deterministic scan, because
pages are numbered in reading order.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Scratch, clean_columns, read, small_batches

#: Share of a host's distinct pages, in percent, that a text must stand on to be part of the template.
CONSTANT = 90
#: Share of all characters, in percent, that must vary for the varying ones to tell where the main text is.
VARYING = 10

# Element and class names with a role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
DROP = frozenset("head nav header footer aside form script style textarea title noscript template iframe svg math button select option dialog menu search object canvas audio video xmp noembed noframes".split())
DROP_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget related recommended share sharing social "
    "comment comments disqus replies newsletter subscribe subscription signup login search pagination pager skip".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLOSES_P = BLOCK - frozenset("html head body title td th tr tbody thead tfoot caption".split())
SELF_NEST = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Elements that can be a main slot.
CONTAINERS = frozenset("article body center div main section table tbody td".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"(class|id|role|aria-hidden|hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPLIT = re.compile(r"[\s_-]+")
SPACE = re.compile(r"\s+")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


class Element:
    __slots__ = ("tag", "path", "dropped", "main", "inside")

    def __init__(self, tag, path, dropped, main):
        self.tag, self.path, self.dropped, self.main = tag, path, dropped, main
        #: Containers without a name, by tag, that began directly in this one.
        self.inside: dict[str, int] = {}


def parse(page: str):
    """Yields ("open", path) for elements and ("text", path, dropped, in_article, text) for blocks, in page order.

    ``path`` is the elements from the root; ``dropped`` tells whether one of them is a part that isn't main text.
    """
    stack = [Element("", "", False, False)]
    parts: list[str] = []
    at = 0

    def flush():
        text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            # A block belongs to the innermost block element around it.
            e = next(x for x in reversed(stack) if x.tag in BLOCK or not x.tag)
            yield "text", e.path, stack[-1].dropped, e.main, text

    def pop_to(depth):
        del stack[depth:]

    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                parts.append(" ")
                continue
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if not depth:
                if tag in BLOCK:
                    yield from flush()
                continue
            if any(x.tag in BLOCK for x in stack[depth:]):
                yield from flush()
            pop_to(depth)
            continue
        if tag == "br" or (tag in VOID and tag not in BLOCK):
            parts.append(" " if tag == "br" else "")
            continue
        if tag in BLOCK:
            yield from flush()
            if tag in CLOSES_P:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p"), 0)
                if depth:
                    pop_to(depth)
            if tag in SELF_NEST:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in SELF_NEST[tag]:
                        pop_to(i)
                        break
                    if stack[i].tag in ("ul", "ol", "dl", "table", "select"):
                        break
        if tag in VOID:
            continue
        names, role, hidden = set(), "", False
        if m[3]:
            for k, a, b, c in ATTR.findall(m[3]):
                v, k = (a or b or c).lower(), k.lower()
                if k in ("class", "id"):
                    names.update(SPLIT.split(v.strip()))
                elif k == "role":
                    role = v.strip()
                elif k == "hidden" or v == "true":
                    hidden = True
        up = stack[-1]
        main = up.main or tag in ("article", "main") or role == "main"
        odd = names & DROP_NAMES
        drop = up.dropped or hidden or role in DROP_ROLES or (tag in DROP and not (tag == "header" and up.main)) or (bool(odd) and tag not in ("html", "body", "article", "main"))
        name = min(odd) if odd else min((x for x in names if x.isalpha()), default="")
        if not name and tag in CONTAINERS and tag != "body":
            up.inside[tag] = name = up.inside.get(tag, 0) + 1
        path = f"{up.path}/{tag}" + (f".{name}" if name else "")
        yield "open", path
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            raw = page[at : close.start() if close else len(page)]
            at = close.end() if close else len(page)
            if tag in ("title", "textarea") and (text := SPACE.sub(" ", entities.unescape(raw)).strip()):
                yield "text", path, True, False, text
            continue
        if m[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        stack.append(Element(tag, path, drop, main))
    yield from flush()


def digest(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


MAIN_TAGS = re.compile(r"/(article|main)\b[^/]*$")
HEADING = re.compile(r"/h[1-6][^/]*$")


def tag_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].split(".", 1)[0]


def parent_of(path: str) -> str:
    return path.rsplit("/", 1)[0]


def nested(classes: list[dict], total: int) -> list[tuple[str, int]]:
    """The template's elements that stand once on a page, (path, characters held on all pages): the skeleton, and the
    once-a-page classes that nest in one of its elements. ``classes`` have pages, times and elements (path, held)."""
    once = [c for c in classes if c["times"] == c["pages"] and c["elements"]]
    frame = [c for c in once if 100 * c["pages"] >= CONSTANT * total]
    if not frame:
        return []
    skeleton = max(frame, key=lambda c: (c["pages"], len(c["elements"]), c["elements"][0]))
    out = dict(skeleton["elements"])
    for c in sorted(frame, key=lambda c: min(p.count("/") for p, _ in c["elements"])):
        # All of the class must stand in one element of the template built so far.
        if c is not skeleton and any(all(within(p, e) for p, _ in c["elements"]) for e in out):
            out.update(c["elements"])
    return sorted(out.items())


def choose(paths: list[tuple[str, int]], constant: dict[str, int]) -> str:
    """The main slot among a template's elements (path, characters held); ``constant``: characters of template texts by
    the path that holds them. "" if there is none."""
    held = dict(paths)
    vary = {p: n - sum(c for q, c in constant.items() if within(q, p)) for p, n in paths}
    if 100 * max(vary.values(), default=0) < VARYING * max(held.values(), default=0):
        vary = held
    whole = max(vary.values(), default=0)
    if not whole:
        return ""
    heading = lambda up, slot: any(HEADING.search(p) and within(p, up) and not within(p, slot) and n > 0 for p, n in vary.items())
    every = max((p for p, n in vary.items() if n == whole), key=lambda p: (p.count("/"), p))
    named = [p for p, n in vary.items() if MAIN_TAGS.search(p) and 2 * n >= whole and (within(p, every) or within(every, p))]
    if named:
        slot, *around = sorted(named, key=lambda p: (-p.count("/"), p))
        for up in around:
            if within(slot, up) and heading(up, slot):
                slot = up
        return slot
    if tag_of(every) in CONTAINERS - {"body"} and held[every] < max(held.values()):
        return every
    inner = [p for p, n in vary.items() if 2 * n >= whole and tag_of(p) in CONTAINERS]
    if not inner:
        return ""
    slot = max(inner, key=lambda p: (p.count("/"), p))
    up = parent_of(slot)
    if up in vary and tag_of(up) != "body" and any(HEADING.search(p) and parent_of(p) == up and n > 0 for p, n in vary.items()):
        slot = up
    return slot


def main_slot(classes: list[dict], constant: list[dict], total: int) -> str:
    paths = nested([{**c, "elements": [(x["path"], x["held"]) for x in c["elements"]]} for c in classes], total)
    still: dict[str, int] = {}
    for x in constant:
        still[x["path"]] = still.get(x["path"], 0) + x["held"]
    return choose(paths, still)


def within(path: str, slot: str) -> bool:
    return path == slot or path.startswith(slot + "/")


def extract(page: str, slot: str) -> str:
    """Blocks of the main slot. Without a slot, or where the page lacks it, the page's own elements decide."""
    found, opened = [], set()
    for kind, *rest in parse(page):
        if kind == "open":
            opened.add(rest[0])
        else:
            found.append(rest)
    if slot not in opened:
        slot = min((p for p in opened if MAIN_TAGS.search(p)), key=lambda p: (p.count("/"), p), default="")
    return "\n".join([t for path, dropped, _, t in found if not dropped and (not slot or within(path, slot))])


def ancestors(path: str) -> list[str]:
    parts = path.split("/")
    return ["/".join(parts[:i]) for i in range(2, len(parts) + 1)]


def occurrences(pages: DataFrame) -> DataFrame:
    """``host, token, path, is_text, held, mark, n``: each page's tokens; ``mark`` is the page's part of the token's
    vector, ``held`` the characters of text in it (for a text: its own)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for host, key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                count: dict[str, int] = {}
                held: dict[str, int] = {}
                texts: dict[tuple[int, str], list[int]] = {}
                for kind, *rest in parse((data or b"").decode("utf-8", "replace")):
                    if kind == "open":
                        count[rest[0]] = count.get(rest[0], 0) + 1
                    else:
                        path, dropped, _, text = rest
                        if not dropped:
                            for p in ancestors(path):
                                held[p] = held.get(p, 0) + len(text)
                            x = texts.setdefault((digest(text), path), [0, 0])
                            x[:] = x[0] + 1, x[1] + len(text)
                rows = [(digest(p), p, False, held.get(p, 0), c) for p, c in count.items()] + [(k, p, True, n, c) for (k, p), (c, n) in texts.items()]
                for token, path, is_text, n, c in rows:
                    for col, v in zip(out, (host, token, path, is_text, n, digest(f"{key}:{c}"), c)):
                        col.append(v)
            types = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["host", "token", "path", "is_text", "held", "mark", "n"])

    return pages.select("host", "key", "t").mapInArrow(run, "host string, token bigint, path string, is_text boolean, held bigint, mark bigint, n bigint")


def distinct_pages(pages: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(pages without later copies of equal html on one host, ``host, total``: their number)."""
    prints = scratch.cut(pages.select("host", "key", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(7), "t").alias("h2")))
    firsts = scratch.cut(prints.groupBy("host", "h1", "h2").agg(F.min("key").alias("first"), F.count("*").alias("copies")))
    copies = scratch.cut(prints.join(firsts.where("copies > 1"), ["host", "h1", "h2"]).where("key <> first").select("key"))
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    return pages.join(copies, "key", "left_anti"), firsts.groupBy("host").agg(F.count("*").alias("total"))


def templates(pages: DataFrame, scratch: Scratch, min_pages: int = 3) -> DataFrame:
    """``host, total, classes, constant``: the host's number of distinct pages, its valid element classes and its
    template texts; hosts without valid classes are absent."""
    pages, totals = distinct_pages(pages, scratch)
    tokens = occurrences(pages).groupBy("host", "token", "path", "is_text").agg(F.sum("held").alias("held"), F.bit_xor("mark").alias("vector"), F.count("*").alias("pages"), F.sum("n").alias("times"))
    # What isn't on nearly all pages is content; texts of single pages, the bulk of all tokens, end here.
    tokens = tokens.where(F.col("pages") >= min_pages).join(totals, "host").where(100 * F.col("pages") >= CONSTANT * F.col("total"))
    element = F.when(~F.col("is_text"), F.struct("path", "held"))
    text = F.when(F.col("is_text"), F.struct("path", "held"))
    classes = tokens.groupBy("host", "total", "vector", "pages", "times").agg(F.sort_array(F.collect_list(element)).alias("elements"), F.collect_list(text).alias("texts"))
    valid = classes.where("(size(elements) >= 2 and times = pages) or size(texts) > 0")
    return valid.groupBy("host", "total").agg(F.collect_list(F.struct("pages", "times", "elements")).alias("classes"), F.flatten(F.collect_list("texts")).alias("constant"))


def extract_pages(pages: DataFrame, min_pages: int = 3) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    spark = pages.sparkSession
    small_batches(spark, 64)
    src = clean_columns(pages, "page_id", "url", "html").select(
        "page_id", "url", F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")).alias("host"),
        F.monotonically_increasing_id().alias("key"), F.col("html").cast("binary").alias("t"),
    )
    scratch = Scratch(spark, "html")
    known = scratch.cut(templates(src, scratch, min_pages))
    # One row a host; the hot host's pages are the streamed side of the join.
    with_template = src.drop("key").join(known, "host", "left")

    def run(batches):
        import pyarrow as pa

        slots: dict[str, str] = {}
        for batch in batches:
            texts = []
            for i, (host, data) in enumerate(zip(batch.column("host").to_pylist(), batch.column("t").to_pylist())):
                if host not in slots:
                    if len(slots) > 1000:
                        slots.clear()
                    total, classes, constant = (batch.column(n)[i].as_py() for n in ("total", "classes", "constant"))
                    slots[host] = main_slot(classes or [], constant or [], total or 0)
                texts.append(extract((data or b"").decode("utf-8", "replace"), slots[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return with_template.select("page_id", "url", "host", "t", "total", "classes", "constant").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return extract_pages(pages.withColumn("page_id", F.col("page_id").cast("long")))
