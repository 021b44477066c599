"""Main text of web pages by wrapper induction.

Pages become small trees (long runs of like siblings count as one repeated node). Every page of a host is aligned with
one page of it, the host's pivot, by simple tree matching, which names each of its nodes: by the pivot's node that it
is aligned with, or by its path below the last one that is. Over the host's pages, texts that stand in the same place
on most pages that have the place are the template; what varies is a slot. A slot outside articles whose text is mostly
that of links, over all its pages, is a menu, however its entries vary. A page's text is that of its other slots.

A host may repeat an article, and a copy is no template. So inside an article (or main) element, pages with the same
longest text count once. Elsewhere every page counts. What is neither constant nor article is read off the tags and
names around it: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are never
content, however their text varies; and if a page marks an article, only slots inside it are content. Inside an article
the name of a paragraph, heading, list item or cell says nothing: only those of elements that group others do.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, shared_dir, slices, stored

CONSTANT = 0.6  # share of the pages with a place that have the same text there, from which it is template
LINKED = 0.6  # share of a place's characters that stand in links, from which it is a menu
LEAST = 3  # pages that must have the text, or the menu, for that
RUN = 4  # like siblings in a row that are aligned one by one; longer runs count as one repeated node
WIDTH = 200  # children that are aligned at once; more are aligned block by block
SPLIT = 2000  # pages of one host that meet its pivot in one group
LARGE = 200_000  # hosts of more than SPLIT pages that are broadcast, at most; if there are more, they are joined

# Elements of HTML by role.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul video audio canvas".split())
NEVER = frozenset("nav header footer aside form menu button select input option dialog head title script style noscript template iframe svg math textarea object embed canvas audio video".split())
CLOSES_P = BLOCK - {"br", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
GROUPS = frozenset("div section ul ol dl table details figure fieldset center".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = frozenset("html body article main section div table ul ol dl nav header footer aside form td th blockquote".split())
# Parts of class names, ids and roles that mark what is not the article.
NAMES = re.compile(
    r"(?:^|[-_ ])(?:ads?|adv|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|side|aside|header|masthead|footer|foot|cookies?|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|"
    r"subscribe\w*|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|replies|reply|disqus|respond|toolbar|pagination|pager|widget|copyright|legal|search|skip|contentinfo|complementary|form)(?=$|[-_ ])"
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)>|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "name", "skip", "article", "children", "key", "size", "linked")

    def __init__(self, tag: str, name: str, skip: bool, article: bool):
        self.tag, self.name, self.skip, self.article = tag, name, skip, article
        self.children, self.key = [], ""
        self.size = self.linked = 0  # characters of its own blocks, and of those in links

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.name}"


def _marks(attributes: str) -> tuple[str, bool, bool]:
    """(names of an element in order, whether its state says that it is not content, whether they do)."""
    if "=" not in attributes and "hidden" not in attributes:
        return "", False, False
    names, off = [], False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if key.lower() in ("hidden", "aria-hidden"):
            off |= value not in ("false",)
        else:
            names.append(value)
    name = " ".join(names)
    return name, off, bool(NAMES.search(name))


def parse(html: str | None) -> tuple[Node, list[tuple[Node, str]]]:
    """(root, blocks in page order). A block is a run of text without a block element's border inside, with the
    innermost block element it stands in; references are decoded, white space is one space, empty blocks are left out.

    Tags need not be balanced: what HTML lets a page leave out is closed where HTML closes it, and a stray closing
    tag is passed over.
    """
    root = Node("", "", False, False)
    stack, blocks, run = [root], [], []
    text, at, n = html or "", 0, len(html or "")
    linked, link = 0, 0  # characters of the run in links; depth at which the open link began

    def flush():
        nonlocal linked
        if run:
            words = _SPACE.sub(" ", unescape("".join(run))).strip()
            run.clear()
            if words:
                blocks.append((stack[-1], words))
                stack[-1].size += len(words)
                stack[-1].linked += min(linked, len(words))
        linked = 0

    def close_to(i: int):
        nonlocal link
        flush()
        del stack[i:]
        link = link if link <= i else 0  # a link that nothing ends does so with the element around it

    for m in iter(lambda: _TOKEN.search(text, at), None):
        if m.start() > at:
            run.append(text[at : m.start()])
            linked += len(run[-1].strip()) if link else 0
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if not m[1] and tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(text, at)
            at = end.end() if end else n
            continue
        if tag not in BLOCK and tag not in NEVER:
            if tag == "a":
                link = len(stack) if not m[1] and "href" in m[3].lower() else 0
            continue
        if m[1]:
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            flush()
            if i:
                close_to(i)
            continue
        flush()
        if tag in EMPTY or tag == "br":
            continue
        if tag in CLOSES_P and len(stack) > 1 and stack[-1].tag == "p":
            close_to(len(stack) - 1)
        if tag in SIBLINGS:
            i = len(stack) - 1
            while i > 0 and stack[i].tag not in SIBLINGS[tag] and stack[i].tag not in LIMITS:
                i -= 1
            if i > 0 and stack[i].tag in SIBLINGS[tag]:
                close_to(i)
        name, off, named = _marks(m[3])
        up = stack[-1]
        off |= named and (not up.article or tag in GROUPS)
        body = tag in ("article", "main", "body", "html")
        node = Node(tag, name, up.skip or tag in NEVER and not (tag == "header" and up.article) or (off and not body), up.article or tag in ("article", "main"))
        up.children.append(node)
        stack.append(node)
    if at < n:
        rest = text[at:]
        run.append(rest if "<" not in rest or not re.match(r".*<[a-zA-Z/!][^>]*\Z", rest, re.S) else rest[: rest.rindex("<")])
    flush()
    return root, blocks


class Run:
    """One node, or like siblings in a row that count as one, in a tree of runs."""

    __slots__ = ("label", "nodes", "kids", "key")

    def __init__(self, nodes: list[Node]):
        self.label, self.nodes, self.kids, self.key = nodes[0].label, nodes, [], ""


def groups(nodes: list[Node]) -> list[list[Node]]:
    """Nodes one by one, but runs of more than RUN of the same label together."""
    runs: list[list[Node]] = []
    for c in nodes:
        if runs and runs[-1][0].label == c.label:
            runs[-1].append(c)
        else:
            runs.append([c])
    return [g for r in runs for g in ([r] if len(r) > RUN else [[c] for c in r])]


def folded(root: Node) -> Run:
    """The tree of runs of a page, each with a number as its key."""
    todo, n = [top := Run([root])], 0
    while todo:
        run = todo.pop()
        run.key, n = str(n), n + 1
        run.kids = [Run(g) for g in groups([c for x in run.nodes for c in x.children])]
        todo += reversed(run.kids)
    return top


def blocks_of(a: list[Run], b: list[Run]) -> list[tuple[list[Run], list[Run]]]:
    return [(a[i : i + WIDTH], b[i : i + WIDTH]) for i in range(0, min(len(a), len(b)), WIDTH)]


def signed(tops: list[Run]) -> tuple[dict[int, int], dict[int, int]]:
    """Number of each run's shape by its id (equal subtrees have equal numbers), and the size of each shape."""
    shapes: dict[tuple, int] = {}
    sign, size = {}, {}
    for top in tops:
        order = [top]
        for run in order:
            order += run.kids
        for run in reversed(order):
            shape = (run.label, *(sign[id(k)] for k in run.kids))
            sign[id(run)] = n = shapes.setdefault(shape, len(shapes))
            size[n] = 1 + sum(size[sign[id(k)]] for k in run.kids)
    return sign, size


def aligned(page: Run, pivot: Run) -> list[tuple[Run, Run]]:
    """Pairs of the largest matching of two trees that keeps order, parents and labels (simple tree matching: the
    children of a pair are aligned by dynamic programming). Pairs are listed from the root down and weighed from the
    leaves up, so depth does not matter.

    The weight of a pair hangs on the shapes of its subtrees only, so it is worked out once for each two shapes, and
    equal ones match whole; a table of children is made again where the matching is read off, so none is kept."""
    sign, size = signed([page, pivot])
    of = lambda u, v: (sign[id(u)], sign[id(v)])
    pairs, seen = [(page, pivot)], {of(page, pivot)}
    for a, b in pairs:
        if sign[id(a)] == sign[id(b)]:
            continue
        for x, y in blocks_of(a.kids, b.kids):
            first = {sign[id(v)]: v for v in reversed(y)}
            for u in {sign[id(u)]: u for u in reversed(x)}.values():
                for v in first.values():
                    if u.label == v.label and of(u, v) not in seen:
                        seen.add(of(u, v))
                        pairs.append((u, v))
    weight: dict[tuple[int, int], int] = {}

    def table(x: list[Run], y: list[Run]) -> list[list[int]]:
        best = [[0] * (len(y) + 1)]
        for u in x:
            above, row = best[-1], [0]
            for j, v in enumerate(y):
                row.append(max(above[j + 1], row[j], above[j] + (weight[of(u, v)] if u.label == v.label else 0)))
            best.append(row)
        return best

    depth: dict[int, int] = {}
    for top in (page, pivot):  # children come before parents when shapes are taken by height
        order = [top]
        for run in order:
            order += run.kids
        for run in reversed(order):
            depth[sign[id(run)]] = 1 + max((depth[sign[id(k)]] for k in run.kids), default=0)
    for a, b in sorted(pairs, key=lambda p: min(depth[sign[id(p[0])]], depth[sign[id(p[1])]])):
        same = sign[id(a)] == sign[id(b)]
        weight[of(a, b)] = size[sign[id(a)]] if same else 1 + sum(table(x, y)[-1][-1] for x, y in blocks_of(a.kids, b.kids))
    chosen = [(page, pivot)]
    for a, b in chosen:
        if sign[id(a)] == sign[id(b)]:
            chosen += reversed([*zip(a.kids, b.kids)])
            continue
        for x, y in blocks_of(a.kids, b.kids):
            best, i, j = table(x, y), len(x), len(y)
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    chosen.append((x[i], y[j]))
    return chosen


def name_places(root: Node, pivot: Run | None) -> None:
    """Give every node of a page the name of its place: that of the pivot's node it is aligned with, or else the
    name of the place around it and its own label."""
    page = folded(root)
    known = {id(x): y.key for x, y in aligned(page, pivot)} if pivot is not None else {}
    page.key, todo = "0", [page]
    while todo:
        run = todo.pop()
        for x in run.nodes:
            x.key = run.key
        for k in run.kids:
            k.key = known.get(id(k)) or f"{run.key}/{k.label}"
        todo += run.kids


def place_id(key: str, text: str = "") -> int:
    """A signed 64-bit number for a place, or for a text in a place."""
    return xxhash.xxh64_intdigest(f"{key}\0{text}") - 2**63


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def longest_text(html: Column) -> Column:
    """A hash of the longest text between two tags, never 0."""
    texts = F.split(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", ""), "<[^>]*>")
    longest = F.array_max(F.transform(texts, lambda t: F.struct(F.length(F.trim(t)).alias("n"), F.xxhash64(F.trim(t)).alias("h"))))
    return F.when(longest["h"] == 0, F.lit(1).cast("long")).otherwise(longest["h"])


def main_text(blocks: list[tuple[Node, str]], template: frozenset[int]) -> str:
    """The blocks of slots: not template (a text in a place, or a place outside articles as a whole), not what is never
    content, and inside the article if the page marks one."""
    kept = [(x, t) for x, t in blocks if not x.skip]
    if any(x.article for x, _ in kept):
        kept = [(x, t) for x, t in kept if x.article]
    return " ".join(t for x, t in kept if place_id(x.key, t) not in template and (x.article or place_id(x.key) not in template))


class Pivots:
    """The trees of pivots that a task has met last."""

    def __init__(self, limit: int = 256):
        self.limit, self.known = limit, {}

    def __call__(self, host: str, html: str | None) -> Run | None:
        if html is None:
            return None
        if host not in self.known:
            if len(self.known) >= self.limit:
                self.known.clear()
            self.known[host] = folded(parse(html)[0])
        return self.known[host]


def _count(batches):
    pivots = Pivots()
    for b in slices(batches, "html"):
        seen: dict[tuple[str, int, int, int], int] = {}
        sizes: dict[tuple[str, int, int, int], list[int]] = {}  # of places outside articles: characters, those in links
        for html, host, pivot, once in zip(*(b.column(i).to_pylist() for i in range(4))):
            if not html:
                continue
            root, blocks = parse(html)
            name_places(root, pivots(host, pivot))
            here, nodes = set(), {}
            for x, t in blocks:
                if not x.skip:
                    place, page = place_id(x.key), once if x.article else 0
                    here |= {(host, place, 0, page), (host, place, place_id(x.key, t), page)}
                    if not x.article:
                        nodes[id(x)] = x, (host, place, 0, page)
            for x, k in nodes.values():
                sum_ = sizes.setdefault(k, [0, 0])
                sum_[0] += x.size
                sum_[1] += x.linked
            for k in here:
                seen[k] = seen.get(k, 0) + 1
        keys = list(zip(*seen)) if seen else [(), (), (), ()]
        size, linked = zip(*(sizes.get(k, (0, 0)) for k in seen)) if seen else ((), ())
        numbers = (*keys[1:], list(seen.values()), size, linked)
        yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), *(pa.array(k, pa.int64()) for k in numbers)], names=["host", "place", "text", "page", "n", "size", "linked"])


def _take(batches):
    pivots = Pivots()
    for b in slices(batches, "html"):
        out = []
        for html, host, pivot, template in zip(*(b.column(i).to_pylist() for i in range(2, 6))):
            root, blocks = parse(html)
            name_places(root, pivots(host, pivot))
            out.append(main_text(blocks, frozenset(template or ())))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Two passes over the pages: one counts, for each host, what its template is; one extracts. A host's pivot is its
    page with the least page_id of those that have a tag (of equal ones, the least html). Pages meet their pivot in
    groups of about SPLIT pages of a host, so no task gets a whole large host; counts are added up in tasks before
    they are shuffled. A null or empty html has an empty text; a url without a host belongs to the host ``''``;
    repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    folder = shared_dir(pages.sparkSession)
    firsts = rows.groupBy("host").agg(F.min(F.when(F.col("html").contains("<"), F.col("page_id"))).alias("page_id"), F.count("*").alias("size"))
    firsts = stored(firsts.withColumn("parts", F.ceil(F.col("size") / SPLIT).cast("int")), folder, "hosts")
    pivots = rows.filter(F.col("html").contains("<")).join(firsts, ["host", "page_id"]).groupBy("host", "parts").agg(F.min("html").alias("pivot"))
    pivots = stored(pivots, folder, "pivots")
    large = firsts.filter("parts > 1").select("host", "parts")
    large = F.broadcast(large) if large.count() <= LARGE else large  # about 50 bytes a row
    dealt = rows.join(large, "host", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("page_id"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")

    def met(given: DataFrame, wrappers: DataFrame) -> DataFrame:
        parts = wrappers.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return given.join(parts, ["host", "part"], "left")

    counted = met(dealt.filter(F.length("html") > 0).select("html", "host", "part", longest_text(F.col("html")).alias("once")), pivots)
    seen = map_texts(counted.select("html", "host", "pivot", "once"), _count, "host string, place long, text long, page long, n long, size long, linked long")
    sums = [F.sum(c).alias(c) for c in ("n", "size", "linked")]
    seen = seen.groupBy("host", "place", "text", "page").agg(*sums).withColumn("n", F.when(F.col("page") == 0, F.col("n")).otherwise(1))
    seen = stored(seen.groupBy("host", "place", "text").agg(*sums).filter(F.col("n") >= LEAST), folder, "seen")
    places = seen.filter("text = 0").select("host", "place", F.col("n").alias("pages"))
    fixed = seen.filter("text <> 0").join(places, ["host", "place"]).filter(F.col("n") >= CONSTANT * F.col("pages"))
    menus = seen.filter("text = 0 and linked > 0").filter(F.col("linked") >= LINKED * F.col("size")).select("host", F.col("place").alias("text"))
    templates = fixed.select("host", "text").union(menus).groupBy("host").agg(F.collect_list("text").alias("template"))
    wrappers = stored(pivots.join(templates, "host", "left"), folder, "wrappers")
    full = met(dealt, wrappers).select("page_id", "url", "html", "host", "pivot", "template")
    return map_texts(full, _take, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")
