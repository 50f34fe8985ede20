"""Main text of web pages by wrapper induction.

Pages of a host come from few templates.  Every page is outlined: its regions,
named by the labels on the way to them, and the blocks right inside them.  What
repeats in a region on most of the different pages that have it is template;
the region that most of those pages have their running text in is the article.
Both are counted over all pages of the host; every page is then aligned with
what its host's pages have in common, and the article's blocks are read out.

Regions are the structural elements; paragraphs, headings, list items and
the like are blocks inside them.  Menus, forms, adverts, notices, side bars,
page headers and footers and reader comments are known by their element, by
the words of their class or id, or by being mostly links.

:func:`induce` makes a template of a few given pages by simple tree matching.
"""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored

# A host with more regions to know than this has them sent to each page apart, and not all to every page.
HOST_REGIONS = 300
# Lists of siblings with more pairs than this squared are matched by their labels in order.
MOST_CHILDREN = 300
# A block this short that so large a part of a host's differing pages repeats is template.
CONSTANT_CHARS = 300
CONSTANT_SHARE = 0.7
LEAST_PAGES = 4
# Share of link text at which a region is a menu, and least share of a page's running text in the article's region.
MENU_LINKS = 0.6
MAIN_SHARE = 0.6

REGIONS = frozenset(
    "body div section article main aside nav header footer form ul ol dl table tbody thead tfoot tr figure details "
    "fieldset menu dialog center".split()
)
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption blockquote pre address figcaption summary hr legend title".split())
RAW = frozenset("script style noscript template iframe svg math object canvas audio video head textarea title select".split())
NEVER = frozenset("nav footer aside form menu dialog button fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = REGIONS | (BLOCKS - {"title"})
AROUND = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisement|adbox|adslot|banner|sponsor(?:ed)?|promo(?:tion)?s?|side-?bar|menu|nav(?:bar|igation)?|"
    r"foot(?:er)?|masthead|site-?header|page-?header|top-?bar|breadcrumbs?|cookies?|consent|notice|alert|pop-?up|modal|overlay|newsletter|"
    r"subscribe|sign-?up|login|search|share|sharing|social|related|recommended|widgets?|comments?|disqus|replies|respond|pagination|pager|"
    r"copyright|disclaimer|skip-?link|toolbar)(?:$|[^a-z])"
)
TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[!?][^>]*>)")
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Region:
    """A structural element: label, children and blocks, in page order."""

    __slots__ = ("tag", "label", "around", "items", "kids", "seen", "texts", "main", "constant", "outside")

    def __init__(self, tag: str, attributes: str = ""):
        named = {k.lower(): (a or b or c).strip().lower() for k, a, b, c in NAMED.findall(attributes)} if attributes else {}
        self.tag = tag
        self.label = tag + "".join(f"|{k}={re.sub('[0-9]+', '0', named[k])}" for k in sorted(named))
        self.around = tag in NEVER or any(AROUND.search(v) for v in named.values()) or named.get("role") in (
            "navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert")
        self.items: list = []  # regions, and blocks as [text, link characters]
        self.kids: list[Region] = []
        self.seen, self.texts, self.main, self.constant, self.outside = 1, {}, False, frozenset(), False

    def add(self, kid: Region) -> Region:
        self.items.append(kid)
        self.kids.append(kid)
        return kid


def parse(page: str) -> Region:
    """The page's regions and blocks; broken markup is closed the way browsers do."""
    root = Region("body")
    open_: list[tuple[str, Region]] = [("body", root)]
    words: list[str] = []
    links = [0, 0]  # open anchors, characters inside them
    at, size = 0, len(page)
    deep: dict[str, int] = {}  # open elements by tag

    def flush():
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            if text:
                open_[-1][1].items.append([text, min(links[1], len(text))])
            words.clear()
        links[1] = 0

    def put(raw):
        if raw:
            words.append(raw)
            if links[0]:
                links[1] += len(raw.strip())

    while at < size:
        m = TAG.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        if m.group(0) == "<!--":
            end = page.find("-->", at)
            at = size if end < 0 else end + 3
            continue
        if not m.group(2):
            continue
        tag, closing = m.group(2).lower(), m.group(1)
        if tag in RAW:
            if not closing and not m.group(3).endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>|<body\b" if tag == "head" else rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = size if end is None else end.start() if end.group(0)[1] != "/" else end.end()
            continue
        if tag == "a":
            links[0] = 0 if closing else 1
        elif tag == "br":
            words.append(" ")
        elif tag in REGIONS:
            if tag == "body":
                flush()
                continue
            if not closing:
                flush()
                links[0] = 0
                region = open_[-1][1].add(Region(tag, m.group(3)))
                open_.append((tag, region))
                deep[tag] = deep.get(tag, 0) + 1
            elif deep.get(tag):
                flush()
                while True:
                    shut = open_.pop()[0]
                    deep[shut] -= 1
                    if shut == tag:
                        break
        elif tag in BLOCKS:
            flush()
    flush()
    _judge(root)
    return root


def _upwards(root: Region) -> Iterator[Region]:
    """Every region after those inside it."""
    order, stack = [], [root]
    while stack:
        r = stack.pop()
        order.append(r)
        stack += r.kids
    return reversed(order)


def _judge(root: Region) -> None:
    """Marks what lies around an article: by element, by name, or for being mostly links.

    Characters, and those in links, are added up once, from the inside out.
    """
    sums: dict[int, tuple[int, int]] = {}
    for r in _upwards(root):
        total = sum(len(x[0]) for x in r.items if not isinstance(x, Region))
        links = sum(x[1] for x in r.items if not isinstance(x, Region))
        for k in r.kids:
            total, links = total + sums[id(k)][0], links + sums[id(k)][1]
        sums[id(r)] = total, links
        listed = r.tag in ("ul", "ol", "div", "section", "table", "dl") and total > 0 and links >= MENU_LINKS * total
        r.outside = r.around or listed or r.tag == "header" and not any(k.tag == "article" for k in r.kids)


def matching(a: Region, b: Region, memo: dict) -> tuple[int, list]:
    """Simple tree matching: size of the largest top-down, order-keeping
    matching of two regions with equal labels, and the matched pairs of children."""
    stack = [(a, b)]
    while stack:
        p, q = stack[-1]
        if (id(p), id(q)) in memo:
            stack.pop()
        elif p.label != q.label:
            memo[id(p), id(q)] = 0, []
        else:
            twins = _twins(p.kids, q.kids)
            below = [(p.kids[i], q.kids[j]) for i, j in twins if (id(p.kids[i]), id(q.kids[j])) not in memo]
            if below:
                stack += below
            else:
                memo[id(p), id(q)] = _best(p.kids, q.kids, twins, memo)
    return memo[id(a), id(b)]


def _twins(a: list[Region], b: list[Region]) -> list[tuple[int, int]]:
    """Positions of siblings with equal labels; in very long lists, each with the next one of its label only."""
    if len(a) * len(b) <= MOST_CHILDREN**2:
        return [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i].label == b[j].label]
    places: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        places.setdefault(y.label, []).append(j)
    out, after = [], -1
    for i, x in enumerate(a):
        own = places.get(x.label, [])
        k = bisect.bisect_right(own, after)
        # One that would pass over most of the others is left alone.
        if k < len(own) and own[k] - after <= MOST_CHILDREN:
            after = own[k]
            out.append((i, after))
    return out


def _best(a: list[Region], b: list[Region], twins: list[tuple[int, int]], memo: dict) -> tuple[int, list]:
    """Size of the largest order-keeping matching of siblings, with itself, and its pairs."""
    if not twins:
        return 1, []
    own = {(i, j): memo[id(a[i]), id(b[j])][0] for i, j in twins}
    if len(a) * len(b) > MOST_CHILDREN**2:
        return 1 + sum(own.values()), [(a[i], b[j]) for i, j in twins]
    n, m = len(a), len(b)
    score = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        row, above = score[i], score[i - 1]
        for j in range(1, m + 1):
            more = own.get((i - 1, j - 1), 0)
            row[j] = max(row[j - 1], above[j], above[j - 1] + more if more else 0)
    pairs, i, j = [], n, m
    while i and j:
        more = own.get((i - 1, j - 1), 0)
        if more and score[i][j] == score[i - 1][j - 1] + more:
            pairs.append((a[i - 1], b[j - 1]))
            i, j = i - 1, j - 1
        elif score[i][j] == score[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return score[n][m] + 1, pairs[::-1]


def _walk(region: Region) -> Iterator[Region]:
    stack = [region]
    while stack:
        r = stack.pop()
        yield r
        stack += reversed(r.kids)


def _note(region: Region, page: Region) -> None:
    for x in page.items:
        if not isinstance(x, Region):
            region.texts[x[0]] = region.texts.get(x[0], 0) + 1


def _join(template: Region, page: Region, memo: dict) -> None:
    """Adds a page's regions to the template: matched ones count, new ones enter after their neighbour."""
    stack = [(template, page)]
    while stack:
        old, new = stack.pop()
        _note(old, new)
        twins = {id(q): p for p, q in matching(old, new, memo)[1]}
        place = {id(k): i for i, k in enumerate(old.kids)}
        entered: list[tuple[int, Region]] = []
        after = 0
        for kid in new.kids:
            twin = twins.get(id(kid))
            if twin is not None:
                twin.seen += 1
                stack.append((twin, kid))
                after = place[id(twin)] + 1
            else:
                for r in _walk(kid):
                    _note(r, r)
                entered.append((after, kid))
        for at, kid in reversed(entered):
            old.kids.insert(at, kid)


def running(root: Region, constant: frozenset = frozenset()) -> dict[int, int]:
    """Characters outside links and outside ``constant`` blocks of every region, without what lies around an article in it."""
    out: dict[int, int] = {}
    for r in _upwards(root):
        own = sum(len(x[0]) - x[1] for x in r.items if not isinstance(x, Region) and x[0] not in constant)
        out[id(r)] = own + sum(out[id(k)] for k in r.kids if not k.outside)
    return out


def _inside(region: Region) -> Iterator[Region]:
    stack = [region]
    while stack:
        r = stack.pop()
        yield r
        stack += [k for k in reversed(r.kids) if not k.outside]


def choose(root: Region, constant: frozenset = frozenset()) -> Region:
    """The smallest region that holds most of the page's running text."""
    plain = running(root, constant)
    whole = plain[id(root)]
    for r in _inside(root):
        if r.tag in ("article", "main") and plain[id(r)] >= MAIN_SHARE * whole > 0:
            root, whole = r, plain[id(r)]
            break
    while True:
        kids = [(plain[id(k)], k) for k in root.kids if not k.outside]
        best = max(kids, key=lambda x: x[0], default=(0, None))
        if root.tag == "article" or best[1] is None or best[0] < MAIN_SHARE * whole or len(kids) == 1 and best[0] < whole:
            return root
        # Blocks beside the best child belong to the article too.
        if best[0] < 0.95 * whole:
            return root
        root = best[1]


def induce(pages: list[str]) -> Region:
    """The template of a few pages: regions with their constant
    blocks, and marks on the region of the article."""
    trees = [parse(p) for p in dict.fromkeys(pages)]
    # Copies of one article tell nothing about what is constant: one page for each longest block.
    distinct = {max((x[0] for r in _walk(t) for x in r.items if not isinstance(x, Region)), key=len, default=""): t for t in reversed(trees)}
    trees = list(distinct.values())[::-1]
    if not trees:
        return Region("body")
    trees.sort(key=lambda t: -sum(1 for _ in _walk(t)))
    template = _copy(trees[0])
    for r in _walk(template):
        _note(r, r)
    votes: dict[int, int] = {}
    for tree in [_copy(t) for t in trees[1:]]:
        template.seen += 1
        _join(template, tree, {})
    for r in _walk(template):
        if r.seen >= LEAST_PAGES:
            r.constant = frozenset(t for t, n in r.texts.items() if n >= CONSTANT_SHARE * r.seen and len(t) <= CONSTANT_CHARS)
    # Each page votes for the template region that its own article falls into.
    for tree in trees:
        own = choose(tree, template.constant)
        for p, q in _aligned(template, tree):
            if q is own:
                votes[id(p)] = votes.get(id(p), 0) + 1
    best = max(votes.values(), default=0)
    for r in _walk(template):
        r.main = best > 0 and votes.get(id(r), 0) == best
        r.items, r.texts = list(r.kids), {}
        best = 0 if r.main else best
    return template


def _aligned(a: Region, b: Region) -> list[tuple[Region, Region]]:
    memo: dict = {}
    out, stack = [], [(a, b)]
    while stack:
        p, q = stack.pop()
        out.append((p, q))
        stack += matching(p, q, memo)[1]
    return out


def extract(page: str | None, template: Region) -> str:
    """The article's blocks in page order, joined by an empty line."""
    if not page:
        return ""
    root = parse(page)
    pairs = _aligned(template, root)
    constant = {id(q): p.constant for p, q in pairs}
    main = next((q for p, q in pairs if p.main), None)
    if main is None or not running(main)[id(main)]:
        main = choose(root, template.constant)
    out: list[str] = []
    # What a host repeats inside an element made for the article is still its text.
    whole = main.tag in ("article", "main")
    stack: list = [(main, frozenset() if whole else constant.get(id(main), frozenset()))]
    while stack:
        x, fixed = stack.pop()
        if isinstance(x, Region):
            if x is not main and x.outside:
                continue
            own = frozenset() if whole else constant.get(id(x), frozenset())
            stack += [(y, own) for y in reversed(x.items)]
        elif x[0] not in fixed:
            out.append(x[0])
    return "\n\n".join(out)


def host_of(url: str = "url"):
    """Host of a URL, lowered; NULL and odd URLs share one group."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1), F.lit("")))


def _mark(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def places(root: Region) -> dict[int, tuple[int, int]]:
    """Hashes of the way from the root to every region that may be an article's: by labels
    and the number among the siblings of that label, and by labels alone."""
    out = {id(root): (_mark("= body"), _mark("body"))}
    for r in _inside(root):
        exact, plain = out[id(r)]
        number: dict[str, int] = {}
        for k in r.kids:
            if not k.outside:
                number[k.label] = number.get(k.label, 0) + 1
                out[id(k)] = _mark(f"= {exact} {number[k.label]} {k.label}"), _mark(f"{plain} {k.label}")
    return out


def _short(root: Region, at: dict[int, tuple[int, int]]) -> Iterator[tuple[int, str]]:
    """(way, text) of the blocks that may be template; inside an element made for the article none is."""
    stack = [root]
    while stack:
        r = stack.pop()
        if r.tag not in ("article", "main"):
            for x in r.items:
                if not isinstance(x, Region):
                    if len(x[0]) <= CONSTANT_CHARS:
                        yield at[id(r)][1], x[0]
                elif not x.outside:
                    stack.append(x)


def outline(page: str) -> tuple[int, list[int], list[tuple[int, int]]]:
    """The page's article (by its longest block), the ways to its regions, and its (way, block) pairs."""
    root = parse(page)
    at = places(root)
    longest = max((x[0] for r in _walk(root) for x in r.items if not isinstance(x, Region)), key=len, default="")
    return _mark(longest), sorted({k for pair in at.values() for k in pair}), sorted({(k, _mark(t)) for k, t in _short(root, at)})


def _template(rows: list[dict] | None) -> tuple[dict[int, frozenset], dict[int, float]]:
    rows = rows or []
    return {r["k"]: frozenset(r["fixed"]) for r in rows if r["fixed"]}, {r["k"]: r["share"] for r in rows if r["share"]}


def _own(root: Region, at: dict[int, tuple[int, int]], fixed: dict[int, frozenset]) -> tuple[Region, frozenset]:
    """The page's own article region, and its blocks (way, text) that are template."""
    constant = frozenset((k, t) for k, t in _short(root, at) if k in fixed and _mark(t) in fixed[k])
    return choose(root, frozenset(t for _, t in constant)), constant


def read(page: str | None, template: tuple[dict, dict] = ({}, {})) -> str:
    """The article's blocks in page order, joined by an empty line.

    ``template``: by the ways to regions, hashes of their blocks that repeat,
    and shares of pages that have their article there.
    """
    if not page:
        return ""
    fixed, share = template
    root = parse(page)
    at = places(root)
    main, constant = _own(root, at, fixed)
    # The region most pages with such a one have their article in; of several ones of a way, the page's own or the longest.
    known = [(share[k], not plain, r is main, r) for r in _inside(root) for plain, k in enumerate(at[id(r)]) if k in share] if share else []
    if known:
        best = max(known, key=lambda x: x[:3])[:3]
        long = running(root)
        found = max((r for *x, r in known if tuple(x) == best), key=lambda r: long[id(r)])
        main = found if long[id(found)] else main
    out: list[str] = []
    # What a host repeats inside an element made for the article is still its text.
    stack: list = [(main, main.tag in ("article", "main"), at[id(main)][1])]
    while stack:
        x, whole, way = stack.pop()
        if not isinstance(x, Region):
            if whole or (way, x[0]) not in constant:
                out.append(x[0])
        elif x is main or not x.outside:
            inside = whole or x.tag in ("article", "main")
            stack += [(y, inside, at[id(x)][1]) for y in reversed(x.items)]
    return "\n\n".join(out)


def regions(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(host, k, share, fixed)`` of the regions to know, counted over all pages, and
    ``(page, host, keys)``: which regions a page has.

    Pages with one article count once.  Only hashes are moved, never html.
    """
    rows = pages.where("html <> ''").select(F.xxhash64("url", "html").alias("page"), host_of().alias("host"), "html")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = pa.list_(pa.struct([("k", pa.int64()), ("t", pa.int64())]))
        for batch in batches:
            article, keys, blocks = zip(*map(outline, batch.column("html").to_pylist())) if len(batch) else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page"), batch.column("host"), pa.array(article, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                 pa.array([[{"k": k, "t": t} for k, t in x] for x in blocks], marks)], ["page", "host", "article", "keys", "blocks"])

    drawn = stored(rows.mapInArrow(draw, "page long, host string, article long, keys array<long>, blocks array<struct<k:long,t:long>>"), "outlines")
    # One page to an article: the one of the least hash.
    first = stored(drawn.groupBy("host", "article").agg(F.min("page").alias("page")), "articles")
    one = drawn.join(first, ["host", "article", "page"]).dropDuplicates(["host", "article"])
    one = stored(one.select("host", "article", "keys", "blocks"), "distinct")
    seen = one.select("host", F.explode("keys").alias("k")).groupBy("host", "k").agg(F.count("*").alias("seen")).where(F.col("seen") >= LEAST_PAGES)
    seen = stored(seen, "seen")
    often = one.select("host", F.inline("blocks")).groupBy("host", "k", "t").agg(F.count("*").alias("n")).where(F.col("n") >= CONSTANT_SHARE * LEAST_PAGES)
    fixed = often.join(seen, ["host", "k"]).where(F.col("n") >= CONSTANT_SHARE * F.col("seen"))
    fixed = stored(fixed.groupBy("host", "k").agg(F.collect_list("t").alias("fixed")), "fixed")
    # With the repeated blocks known, every page tells where its own article is.
    known = fixed.select("host", "k", F.lit(0.0).alias("share"), "fixed")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for page, template in zip(batch.column("html").to_pylist(), _templates(batch)):
                root = parse(page)
                at = places(root)
                found.append(list(at[id(_own(root, at, template[0])[0])]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page"), batch.column("host"), pa.array(found, pa.list_(pa.int64()))], ["page", "host", "keys"])

    told = with_regions(rows, known, drawn).mapInArrow(vote, "page long, host string, keys array<long>")
    told = told.join(first, ["host", "page"]).dropDuplicates(["host", "article"])
    votes = told.select("host", F.explode("keys").alias("k")).groupBy("host", "k").agg(F.count("*").alias("votes"))
    share = votes.join(seen, ["host", "k"]).select("host", "k", (F.col("votes") / F.col("seen")).alias("share"))
    return stored(share.join(fixed, ["host", "k"], "full"), "regions"), drawn.select("page", "host", "keys")


def with_regions(rows: DataFrame, known: DataFrame, drawn: DataFrame) -> DataFrame:
    """``rows(page, host, ...)`` with ``template``, what is known of a page's regions.

    All of a host, or, where that is much, only those the page has.
    """
    size = known.groupBy("host").agg(F.count("*").alias("n"))
    large = stored(size.where(F.col("n") > HOST_REGIONS).select("host"), "large-hosts")
    entry = F.collect_list(F.struct("k", "share", "fixed")).alias("template")
    by_host = stored(known.join(large, "host", "left_anti").groupBy("host").agg(entry), "templates")
    out = rows.join(by_host, "host", "left")
    if large.isEmpty():
        return out
    keys = drawn.join(large, "host", "left_semi").dropDuplicates(["page"]).select("page", "host", F.explode("keys").alias("k"))
    by_page = stored(keys.join(known, ["host", "k"]).groupBy("page").agg(entry), "page-templates")
    apart = rows.join(large, "host", "left_semi").join(by_page, "page", "left")
    return rows.join(large, "host", "left_anti").join(by_host, "host", "left").unionByName(apart)


def _templates(batch: pa.RecordBatch) -> Iterator[tuple[dict, dict]]:
    """The templates of a batch's pages; neighbours that share one unpack it once."""
    column, last, value = batch.column("template"), None, ({}, {})
    for x in column:
        if last is None or not x.equals(last):
            last, value = x, _template(x.as_py())
        yield value


def _plain(root: Region) -> list[tuple]:
    """The regions in page order, each with the number of those right inside it."""
    return [(r.tag, r.label, r.around, r.main, sorted(r.constant), len(r.kids)) for r in _walk(root)]


def _region(rows: list[tuple]) -> Region:
    """Back from :func:`_plain`."""
    root, open_ = None, []
    for tag, label, around, main, constant, kids in rows:
        r = Region(tag)
        r.label, r.around, r.main, r.constant = label, around, main, frozenset(constant)
        if open_:
            open_[-1][0].add(r)
            open_[-1][1] -= 1
        else:
            root = r
        open_.append([r, kids])
        while open_ and not open_[-1][1]:
            open_.pop()
    return root


def _copy(root: Region) -> Region:
    """The regions with their own blocks, apart from the page they were read from."""
    twin = {}
    for r in _upwards(root):
        new = Region(r.tag)
        new.label, new.around, new.outside = r.label, r.around, r.outside
        for x in r.items:
            new.add(twin[id(x)]) if isinstance(x, Region) else new.items.append(x)
        twin[id(r)] = new
    return twin[id(root)]


def extract_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of ``pages(page_id, url, html)``.

    NULL, empty and textless pages give an empty text.  Hosts with fewer than
    LEAST_PAGES different pages are read by the rules alone.
    Repeated rows are rows of their own.
    """
    known, drawn = regions(pages)
    rows = pages.select("page_id", "url", "html", F.xxhash64("url", "html").alias("page"), host_of().alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [read(page, template) for page, template in zip(batch.column("html").to_pylist(), _templates(batch))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return with_regions(rows, known, drawn).mapInArrow(run, "page_id long, url string, text string, n_chars long")
