"""Main text of web pages by a site style tree.

All pages of a host are merged into one tree: a node is an element's place, that is the tags,
classes and ids from the root down, with the presentations (sequences of child elements) and
contents seen there and how often. Both give an entropy: a place that many pages show alike is
of little importance, one that they fill differently of much. Pages of a host with one main text
count once, so that copies of an article don't make its places look like notices. Only the
tree's counts are aggregated, by (host, text) and (host, place, value), so that a host that holds
most pages is no large task.

On each page importance is then composed from the leaves upwards: an element's own, from its
presentations, and its children's; the more presentations a place has, the more its own counts.
A branch goes if neither it nor anything below it is important. Names (tags, classes, ids and
roles) are a second sign, for what differs on every page: they say what stands around an article,
unless what they name holds the article itself.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, pieces, released

#: Elements of HTML that have no end tag, hold raw text, or start a block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg xmp noembed noframes".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are never shown as text.
HIDDEN = set("head script style noscript template iframe svg select option input textarea title button object embed canvas audio video map xmp noembed noframes".split())
#: Elements that stand around an article.
AROUND = set("nav header footer aside form menu dialog".split())
#: An open element of the value ends when one of the key starts.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: Where an end tag that is left out isn't looked for any further up.
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
#: Words in a class, id or role that name what stands around an article.
NOISE = set("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments commentlist consent contentinfo cookie cookies copyright disqus disclaimer foot footer form header masthead menu modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination popup promo promoted promotion recommended related replies reply respond rail search share sharing sidebar sidebars signin signup skip social sponsor sponsored subscribe subscription taboola tags teaser toc toolbar topbar tracking widget widgets complementary dialog alert".split())
#: A class of which a part follows one of these says what an element hasn't or has beside it, not what it is.
BESIDE = set("has no with without not is".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements whose place is never removed by counts alone, as are those that say that they are the article.
WHOLE = {"html", "body", "article", "main"}
#: Elements of text: a class names them only if it is one of the words as a whole.
TEXT = set("a abbr b blockquote caption cite code dd dt em figcaption figure h1 h2 h3 h4 h5 h6 i img li mark p pre q s small span strong sub sup table tbody td th thead tr u".split())
#: A host's place is judged by its counts if so many pages of different texts show it ...
MIN_PAGES = 6
#: ... and removed with less importance than this.
MIN_IMPORTANCE = 0.35
#: How far the children's importance counts in an element's, to the power of its presentations.
PASSED_ON = 0.9
#: The low places of all hosts are broadcast if they are no more than this; else pages are joined by host and salt.
MAX_BROADCAST = 500_000
SALTS = 64

#: Of the hashes of runs of texts.
PRIME, BASE = (1 << 61) - 1, 1_400_305_337_884_129_657
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*(?:[\"'][^>]*)?)>?", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAMES = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


def named(tag: str, a: dict[str, str]) -> int:
    """Whether tag, class, id and role say that an element stands around an article: 0 no, 1 by part of a name or a tag that may also hold one, 2 yes."""
    if tag in ("html", "body", "main"):
        return 0
    strong = 2 if tag in AROUND else 0
    if tag in ("form", "header"):
        strong = 1
    for k in ("class", "id", "role"):
        for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", entities.unescape(a.get(k, ""))).lower().split():
            if name in NOISE:
                return 2
            if strong or tag in TEXT:
                continue
            words = NAMES.findall(name)
            if any(w in NOISE and (not i or words[i - 1] not in BESIDE) for i, w in enumerate(words)):
                strong = 1
    return strong


class Node:
    """An element. noise: it is removed; article: it says that it is the article; size: shown characters below; holds: bits for an article (1), paragraphs (2), headings (4) and an h1 (8) in it."""

    __slots__ = ("tag", "place", "hidden", "named", "noise", "parts", "up", "article", "size", "holds")

    def __init__(self, tag: str, up: Node | None, attributes: str):
        self.tag, self.up, self.parts, self.size, self.holds = tag, up, [], 0, 0
        label, self.hidden, self.article, a = "", tag in HIDDEN, tag in ("article", "main"), {}
        if attributes and attributes.strip(" /"):
            a = {k.lower(): x or y or z for k, x, y, z in ATTRIBUTE.findall(attributes)}
            if a.get("class") or a.get("id"):
                label = "." + " ".join(sorted(re.sub(r"\d+", "0", a.get("class", "")).split())) + "#" + re.sub(r"\d+", "0", a.get("id", ""))
            style = a.get("style", "").replace(" ", "").lower()
            self.hidden = self.hidden or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
            self.article = self.article or a.get("role") == "main" or a.get("itemprop") == "articleBody"
        self.named = named(tag, a)
        self.noise = self.hidden
        # a running hash, so that a place costs the same at any depth
        self.place = place_id(f"{up.place}/{tag}{label}" if up else tag + label)


def parse(page: str) -> Node:
    """The page's elements; tags that are left out or badly nested are dealt with as browsers do, in the main."""
    root = cur = Node("#", None, "")
    at, depth = 0, 0
    for m in iter(lambda: TOKEN.search(page, at), None):
        if m.start() > at:
            cur.parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            node = cur
            while node is not root and node.tag != tag:
                if tag not in BLOCKS and node.tag in BLOCKS:  # an inline end tag doesn't end a block
                    node = root
                    break
                node = node.up
            if node is not root:
                cur = node.up
            continue
        if tag in BLOCKS:
            ends = CLOSES.get(tag)
            node = cur
            while node is not root and (ends or tag not in FENCES):
                if ends and node.tag in ends or not ends and node.tag == "p":
                    cur = node.up
                    break
                if node.tag in FENCES.get(tag, ()) or not ends and node.tag in BLOCKS:
                    break
                node = node.up
        node = Node(tag, cur, m[3])
        cur.parts.append(node)
        if tag in VOID or (m[3].endswith("/") and tag not in BLOCKS and tag not in RAW):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*[^>]*>?", re.I).search(page, at)
            node.parts.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            continue
        depth += 1
        cur = node
    if at < len(page):
        cur.parts.append(page[at:])
    judge(root)
    return root


def judge(root: Node) -> None:
    """Sets every element's size and, by names alone, which are noise.

    A named element stays if it holds most of the page's text, no article stands outside of all
    named elements, and it holds an article, or, if only a part of a name or a tag that may hold
    one says so, paragraphs or a heading. A header within an article stays if it has a heading.
    """
    open_, hidden, some = [root], 0, False
    for kind, x in walk(root):
        if kind == "text":
            if not hidden:
                open_[-1].size += len(x.strip())
        elif kind == "start":
            open_.append(x)
            hidden += x.hidden
            some = some or x.named > 0
        elif x is not root:
            open_.pop()
            hidden -= x.hidden
            if not x.hidden:
                x.holds |= x.article
                open_[-1].size += x.size
                open_[-1].holds |= x.holds | (2 if x.tag in ("p", "blockquote", "pre") else 0) | (4 if x.tag in HEADINGS else 0) | (8 if x.tag == "h1" else 0)
    if not some:
        return
    named_ = 0
    outside = False
    for kind, x in walk(root):
        if kind == "start":
            named_ += x.named > 0
            outside = outside or (x.article and not named_ and x.size > 0)
        elif kind == "end":
            named_ -= x is not root and x.named > 0
    inside = 0
    for kind, x in walk(root):
        if kind == "start":
            if x.named and not x.hidden:
                most = not outside and 2 * x.size > root.size and (x.holds & 1 or (x.named == 1 and x.holds & 6))
                x.noise = not most and not (inside and x.tag == "header" and x.holds & 4)
            inside += x.article
        elif kind == "end" and x is not root:
            inside -= x.article


def weigh(root: Node, tree: dict[int, tuple[float, float, int]]) -> None:
    """Marks the branches in which nothing is important. `tree`: a place's content and presentation entropy and its number of presentations; others count as 1."""
    frames: list[list] = [[0.0, 0, True, False]]  # the children's importance and number, whether all are low, whether there is text besides
    hidden = 0
    for kind, x in walk(root):
        if kind == "text":
            if not hidden and not x.isspace():
                frames[-1][3] = True
        elif kind == "start":
            frames.append([0.0, 0, True, False])
            hidden += x.hidden
        elif x is not root:
            total, n, low, own = frames.pop()
            hidden -= x.hidden
            if x.hidden or not (n or own):
                continue
            content, layout, kinds = tree.get(x.place, (1.0, 1.0, 1))
            if n:
                if own:
                    total, n, low = total + content, n + 1, low and content < MIN_IMPORTANCE
                passed = PASSED_ON**kinds
                importance = (1 - passed) * layout + passed * total / n
            else:
                importance = content
            low = low and importance < MIN_IMPORTANCE and not (x.tag in WHOLE or x.article)
            if x.noise:
                continue
            x.noise = low
            up = frames[-1]
            up[0], up[1], up[2] = up[0] + importance, up[1] + 1, up[2] and low


def walk(root: Node) -> Iterator[tuple[str, object]]:
    """('start', node), ('text', string) and ('end', node) in page order, without recursion: pages may be nested very deeply."""
    stack = [iter(root.parts)]
    nodes = [root]
    while stack:
        for x in stack[-1]:
            if isinstance(x, str):
                yield "text", x
            else:
                yield "start", x
                stack.append(iter(x.parts))
                nodes.append(x)
                break
        else:
            stack.pop()
            yield "end", nodes.pop()


def blocks(root: Node) -> list[str]:
    """The texts of the blocks that remain without noise."""
    out: list[str] = []
    run: list[str] = []
    skip = 0

    def flush() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(run))).strip()
        if text:
            out.append(text)
        run.clear()

    for kind, x in walk(root):
        if kind == "text":
            if not skip:
                run.append(x)
        elif x is root:
            pass
        elif kind == "start":
            skip += skip > 0 or x.noise
            if x.tag in BLOCKS:
                flush() if skip < 2 else None
            elif x.tag == "br" and not skip:
                run.append(" ")
        else:
            skip -= skip > 0
            if x.tag in BLOCKS and not skip:
                flush()
    flush()
    return out


def main_roots(root: Node) -> list[Node]:
    """The outermost article or main elements that aren't noise, if they hold most of what isn't noise, an h1 or say that they are the main part; else the whole page: teasers are articles too."""
    found: list[Node] = []
    inside = skip = most = 0
    for kind, x in walk(root):
        if kind == "text":
            most += 0 if skip else len(x.strip())
        elif x is not root:
            step = 1 if kind == "start" else -1
            if kind == "start" and x.article and not inside and not skip and not x.noise:
                found.append(x)
            if x.noise:
                skip += step
            if x.article:
                inside += step
    sure = any(x.tag != "article" or x.holds & 8 for x in found)
    return found if found and (sure or 2 * sum(map(_kept, found)) > most) else [root]


def _kept(node: Node) -> int:
    size = skip = 0
    for kind, x in walk(node):
        if kind == "text":
            size += 0 if skip else len(x.strip())
        elif x is not node and x.noise:
            skip += 1 if kind == "start" else -1
    return size


def place_id(place: str) -> int:
    return xxhash.xxh64_intdigest(place) - (1 << 63)


def host_of(url: str | None) -> str:
    """The URL's host in lower case, or an empty string."""
    m = re.match(r"\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def features(root: Node) -> dict[int, tuple[int, int]]:
    """For each place of a page with text: hashes of the presentation and of the text below it, all of its elements taken together."""
    layout: dict[int, list[int]] = {}
    text: dict[int, tuple[int, int]] = {}
    # Hashes of the first k texts and powers of the base: an element's texts are a range, whose hash follows from its ends at any depth.
    upto, power = [0], [1]
    open_: list[tuple[int, int]] = []
    hidden = 0
    for kind, x in walk(root):
        if kind == "text":
            s = "" if hidden else x.strip()
            if s:
                upto.append((upto[-1] * BASE + xxhash.xxh64_intdigest(s)) % PRIME)
                power.append(power[-1] * BASE % PRIME)
        elif x is root:
            pass
        elif x.hidden:
            hidden += 1 if kind == "start" else -1
        elif hidden:
            pass
        elif kind == "start":
            if open_:
                layout[open_[-1][0]].append(x.place)
            open_.append((x.place, len(upto) - 1))
            layout.setdefault(x.place, [])
        else:
            p, start = open_.pop()
            n = len(upto) - 1 - start
            own, before = (upto[-1] - upto[start] * power[n]) % PRIME, text.get(p, (0, 0))
            text[p] = ((before[0] * power[n] + own) % PRIME, before[1] + n)
    return {p: (place_id(" ".join(map(str, places))), place_id(f"{text[p][0]} {text[p][1]}")) for p, places in layout.items() if text[p][1]}


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, place, pages, layout_entropy, content_entropy, presentations) of each host's merged tree.

    Pages of a host with one main text, as names tell it, count as one, that with the least features. Entropies
    are to base m, the number of such pages that show the place: 0 if all are alike, 1 if none
    are, or if only one page shows it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                host, same, place, layout, content = [], [], [], [], []
                for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    root = parse(h) if h else None
                    found = features(root) if root else None
                    if found:
                        host.append(host_of(u))
                        same.append(place_id("\n".join(blocks_of(root))))
                        place.append(list(found))
                        layout.append([x for x, _ in found.values()])
                        content.append([x for _, x in found.values()])
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(same, pa.int64()), pa.array(place, longs), pa.array(layout, longs), pa.array(content, longs)], names=["host", "same", "place", "layout", "content"])

    shown = pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(released(run), "host string, same long, place array<long>, layout array<long>, content array<long>")
    once = shown.groupBy("host", "same").agg(F.min(F.struct("place", "layout", "content")).alias("x"))
    each = once.select("host", F.explode(F.arrays_zip("x.place", "x.layout", "x.content")).alias("x"))
    seen = each.select("host", F.col("x.place").alias("place"), F.posexplode(F.array("x.layout", "x.content")).alias("kind", "value"))
    values = seen.groupBy("host", "place", "kind", "value").agg(F.count("*").alias("c"))
    kinds = values.groupBy("host", "place", "kind").agg(F.sum("c").alias("m"), F.count("*").alias("k"), F.sum(F.col("c") * F.log(F.col("c").cast("double"))).alias("s"))
    h = F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log(F.col("m").cast("double")))).otherwise(1.0)
    first, second = F.col("kind") == 0, F.col("kind") == 1
    return kinds.withColumn("h", h).groupBy("host", "place").agg(F.max("m").alias("pages"), F.max(F.when(first, F.col("h"))).alias("layout_entropy"), F.max(F.when(second, F.col("h"))).alias("content_entropy"), F.max(F.when(first, F.col("k"))).alias("presentations"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(page_id, url, text, n_chars): one row per page, whole and in page order.

    A null or empty page has an empty text. A null URL belongs to the host without a name.
    Repeated rows stay; a place that fewer than `min_pages` pages of different texts show is
    judged by its names alone.
    """
    low = (F.col("content_entropy") < MIN_IMPORTANCE) | (F.col("layout_entropy") < MIN_IMPORTANCE)
    tree = style_tree(pages).where((F.col("pages") >= min_pages) & low)
    at = F.struct("place", F.col("content_entropy").cast("float").alias("c"), F.col("layout_entropy").cast("float").alias("l"), F.least("presentations", F.lit(1000)).cast("int").alias("k"))
    trees = checkpointed(tree.groupBy("host").agg(F.collect_list(at).alias("tree"), F.max(F.col("content_entropy") < MIN_IMPORTANCE).alias("any")).where("any").select(F.col("host").alias("h"), "tree"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    size = trees.agg(F.sum(F.size("tree"))).first()[0] or 0
    if size <= max_broadcast:  # of 20 bytes each, and html isn't shuffled
        joined = rows.join(F.broadcast(trees), host == F.col("h"), "left")
    else:  # a large host's pages are many tasks
        salted = trees.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("s", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, (host == F.col("h")) & (F.col("s") == F.col("salt")), "left")
    joined = joined.select("page_id", "url", "html", "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                texts = []
                for h, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    texts.append(main_text(h, {x["place"]: (x["c"], x["l"], x["k"]) for x in t} if t else None))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(released(run), "page_id long, url string, text string, n_chars long")


def main_text(page: str | None, tree: dict[int, tuple[float, float, int]] | None = None) -> str:
    """A page's main text, given its host's tree."""
    if not page:
        return ""
    root = parse(page)
    if tree:
        weigh(root, tree)
    return "\n".join(blocks_of(root))


def blocks_of(root: Node) -> list[str]:
    """The blocks of the article elements, or of the page if there are none that hold most of it."""
    found = main_roots(root)
    return blocks(root) if found == [root] else [b for node in found for b in blocks(_alone(node))]


def _alone(node: Node) -> Node:
    root = Node("#", None, "")
    root.parts = [node]
    return root
