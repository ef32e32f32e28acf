"""Main text of web pages by wrapper induction.

Method: a page is read into a tree of its block elements. Siblings that are leaves of one kind (tag and class) share a node, and
so do neighbours of one shape. A host's most frequent tree is its template; its other trees are aligned to it by simple tree
matching (the largest order-preserving match of nodes, by dynamic programming over children). At each aligned node the texts
of the whole page are counted over the host's pages: a text that CONSTANT of the pages that have the node hold there is
template, whatever the element is called; what varies is content. The content's root is the lowest node that holds nearly all
(MOST) of the varying text that isn't links. A page's text is its varying text below that root, and its heading.

Names of elements and classes come last. They take what isn't text of the article out of what varies below the root (reader
comments, forms), and choose between readings: if the element marked as article holds most of the varying text, only that. Where
nothing was induced (few pages of a host, a tree that doesn't match), the article is what names say it is.

Scale: a page is read once, in its task, and its blocks are written to the shared folder. Different trees are aligned row by
row with their host's template; texts are counted by (host, node, hash) with partial sums before the shuffle, which spreads a
hot host by its texts. What is learned of each tree of each host joins the pages: sent to executors if measured and small, else
by a shuffle that Spark splits when skewed. No host is ever in one task.

Defined cases: null html, or html without text, gives the empty text. Null url: a host of its own. A host with fewer
than FEW distinct pages, or whose texts all vary, has no constants. Pages of a host with equal articles count as one page; near
copies count each; repeated rows are repeated in the result. Ties: of trees that are equally frequent, the template is the one
whose digest is smallest; of nodes, the first. A page whose texts are all constant keeps what names mark. Unclosed elements end
as HTML ends them; an unclosed comment or script runs to the end. Very long and very deep pages are read whole, in time linear in
their length. Other columns are not read. An empty table gives an empty one.
"""

import html as entities
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleweave.llm.arrow_text import row_slices, rows_to_batch
from taleweave.llm.lineage import broadcast_if_small, stored

#: The share of a host's pages that must hold a text at a node, and the pages needed to tell.
CONSTANT, FEW = 0.6, 4
#: The share of a node's varying text that one of its children must hold for the content's root to lie below it.
MOST = 0.9

# Elements of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select option button object".split())
CLOSES_P = BLOCKS - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
SAME_CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
ASIDE = frozenset("nav footer aside form menu dialog script style head".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices "
    "popup modal newsletter subscribe signup comment comments respond replies reply disqus share sharing social related recommended recommendations pagination pager toolbar widget masthead skip login search".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
MAIN_WORDS = ("article", "post", "entry", "story", "content", "main")

_OPENING = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_ENDING = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[a-z0-9]+")
_UNFIT = re.compile(r"[()\s]+")
#: Flags of a block: beside the text by its names, mostly links, heading of the page, in the article that names mark.
BESIDE, LINKS, TITLE, NAMED = 1, 2, 4, 8


@lru_cache(maxsize=20_000)
def _attributes(raw: str) -> tuple[str, bool, str]:
    """(class for the kind of a node, whether the element stands beside the text, what may mark the main text)."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    words = _NAME.findall(names)
    role = found.get("role", "").lower()
    beside = any(w in ASIDE_WORDS for w in words) or role in ASIDE_ROLES or "hidden" in found or found.get("aria-hidden") == "true"
    main = "main" if role == "main" or found.get("itemprop", "").lower() == "articlebody" else next((w for w in MAIN_WORDS if w in words), "")
    # Classes with a number (of a page, an item) tell no kind.
    kind = sorted({_UNFIT.sub("_", w) for w in found.get("class", "").lower().split() if not any(c.isdigit() for c in w)})
    return ".".join(kind), beside, main


def tokens(source: str):
    """(start, end, closing, name, attributes) of each tag, and of each comment with an empty name; in time linear in the source."""
    at, end, last = 0, len(source), source.rfind(">")
    quotes = {q: source.rfind(q) for q in "\"'"}
    while 0 <= (start := source.find("<", at)) < last:
        if source.startswith("<!--", start):
            close = source.find("-->", start + 4)
            at = close + 3 if close >= 0 else end
            yield start, at, "", "", ""
            continue
        if source.startswith(("<!", "<?"), start):
            at = source.find(">", start) + 1
            yield start, at, "", "", ""
            continue
        name = _OPENING.match(source, start + 1)
        if not name:
            at = start + 1
            continue
        stop = name.end()
        while (m := _ENDING.search(source, stop)) and m[0] != ">":
            # A quote without its twin is a character like others.
            stop = source.find(m[0], m.end()) + 1 if quotes[m[0]] > m.start() else m.end()
        if not m:  # its end stands in quotes that only seem to be some: from here on, quotes are none
            quotes = dict.fromkeys(quotes, -1)
            m = re.compile(">").search(source, name.end())
        at = m.end()
        yield start, at, name[1], name[2].lower(), source[name.end() : m.start()]
    if source.startswith("<!--", start) and start >= 0:  # an open comment after the last tag
        yield start, end, "", "", ""


class Page:
    """Blocks of text of a page and the tree of its block elements."""

    def __init__(self, source: str):
        self.sigs, self.parents = ["#"], [-1]  # of each block element
        self.blocks: list[tuple] = []  # element, text, beside, mostly links, region, header, heading
        self.regions: list[tuple[str, int]] = [("", 0)]  # kind and outer region of each
        self.titled: set[int] = set()  # headers with an h1
        self._read(source)
        self._fold()

    def _read(self, source):
        # Of each open element: name, element, beside, region, header.
        stack = [("#", 0, False, 0, 0)]
        open_of: dict[str, int] = {}
        blocks_at: list[int] = []  # where block elements are on the stack
        pieces: list[str] = []
        linked = headers = 0
        endless: set[str] = set()  # raw elements that don't end from here on

        def flush():
            nonlocal linked
            if pieces:
                text = " ".join(entities.unescape("".join(pieces)).split())
                if text:
                    _, element, beside, region, header = stack[-1]
                    self.blocks.append((element, text, beside, 2 * linked >= sum(map(len, pieces)), region, header, self.sigs[element].split(".")[0] == "h1"))
                pieces.clear()
                linked = 0

        def close(depth):
            if blocks_at and blocks_at[-1] >= depth:
                flush()
            while blocks_at and blocks_at[-1] >= depth:
                blocks_at.pop()
            for e in stack[depth:]:
                open_of[e[0]] -= 1
            del stack[depth:]

        def close_last(names, within):
            """End the innermost open element of these names, unless one of the others is open within it."""
            if any(open_of.get(n) for n in names):
                for i in reversed(blocks_at):
                    if stack[i][0] in names:
                        close(i)
                        return
                    if stack[i][0] in within:
                        return

        at = 0
        for start, end, closing, name, raw in tokens(source):
            if start < at:
                continue  # inside a raw element
            if start > at:
                pieces.append(source[at:start])
                linked += (start - at) * bool(open_of.get("a"))
            at = end
            if not name:
                continue
            if closing:
                if open_of.get(name):
                    close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name))
                continue
            if name in RAW:
                over = None if name in endless else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                if over:
                    at = over.end()
                else:
                    endless.add(name)
                    at = len(source) if name in ("script", "style", "textarea", "title") else at
                continue
            if name in CLOSES_P:
                close_last(("p",), BLOCKS)
            if name in SAME_CLOSES:
                close_last(("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,), SAME_CLOSES[name])
            if name in VOID:
                if name == "hr":
                    flush()
                elif name == "br":
                    pieces.append(" ")
                continue
            _, element, beside, region, header = stack[-1]
            kind, aside, main = _attributes(raw)
            if name in BLOCKS:
                flush()
                self.sigs.append(f"{name}.{kind}" if kind else name)
                self.parents.append(element)
                element = len(self.sigs) - 1
                if name == "header":
                    headers += 1
                    header = headers
                elif name == "h1" and header:
                    self.titled.add(header)
                if name in ("article", "main") or main:
                    self.regions.append(("article" if name == "article" else "main" if name == "main" or main == "main" else main, region))
                    region = len(self.regions) - 1
            elif raw.endswith("/"):
                continue
            main_part = name in ("article", "main", "body", "html")
            if name in BLOCKS:
                blocks_at.append(len(stack))
            stack.append((name, element, beside or name in ASIDE or (aside and not main_part), region, header))
            open_of[name] = open_of.get(name, 0) + 1
        pieces.append(source[at:])
        flush()

    def _fold(self):
        """Number the nodes: elements that share one have one number. shape: the tree of nodes in brackets."""
        n = len(self.sigs)
        below: list[list[int]] = [[] for _ in range(n)]
        for e in range(1, n):
            below[self.parents[e]].append(e)
        ids: dict[tuple, int] = {}
        shapes: list[tuple[str, tuple, list]] = []  # kind, shapes of the children, how many nodes stand before each of them
        sizes: list[int] = []
        shape, slot = [0] * n, [0] * n
        for e in range(n - 1, -1, -1):  # children come after their parents
            kids: list[int] = []
            leaves: dict[int, int] = {}
            branch = -1
            for c in below[e]:
                s = shape[c]
                if not shapes[s][1]:
                    slot[c] = leaves.setdefault(s, len(kids))
                elif branch >= 0 and kids[branch] == s:
                    slot[c] = branch
                else:
                    slot[c] = branch = len(kids)
                if slot[c] == len(kids):
                    kids.append(s)
            key = (self.sigs[e], tuple(kids))
            if key not in ids:
                ids[key] = len(shapes)
                before = [0]
                for s in kids:
                    before.append(before[-1] + sizes[s])
                shapes.append((*key, before))
                sizes.append(1 + before[-1])
            shape[e] = ids[key]
        self.numbers = [0] * n
        for e in range(1, n):
            p = self.parents[e]
            self.numbers[e] = self.numbers[p] + 1 + shapes[shape[p]][2][slot[e]]
        out, todo = [], [shape[0]]
        while todo:
            s = todo.pop()
            if s < 0:
                out.append(")")
                continue
            out.append("(" + shapes[s][0])
            todo += [-1, *reversed(shapes[s][1])]
        self.shape = "".join(out)

    def _named(self, shown) -> set[int]:
        """Of the blocks shown, those of the article with most text; without one, of the main element, of what a class marks, or all."""
        own = [0] * len(self.regions)
        for i in shown:
            own[self.blocks[i][4]] += len(self.blocks[i][1])
        for r in range(len(own) - 1, 0, -1):
            own[self.regions[r][1]] += own[r]
        for kinds in (("article",), ("main",), MAIN_WORDS):
            best = max((r for r in range(1, len(own)) if self.regions[r][0] in kinds), key=lambda r: (own[r], -r), default=0)
            if best and own[best]:
                inside = [False] * len(own)
                for r in range(1, len(own)):
                    inside[r] = r == best or inside[self.regions[r][1]]
                return {i for i in shown if inside[self.blocks[i][4]]}
        return set(shown)

    def flagged(self) -> list[tuple[int, str, int]]:
        """(node, text, flags) of each block, in page order."""
        beside = [b[2] or bool(b[5] and b[5] not in self.titled) for b in self.blocks]
        named = self._named([i for i, aside in enumerate(beside) if not aside])
        return [
            (self.numbers[b[0]], b[1], BESIDE * beside[i] + LINKS * b[3] + TITLE * b[6] + NAMED * (i in named)) for i, b in enumerate(self.blocks)
        ]


class Tree:
    """A tree from its shape: of each node its kind, children, size and parent."""

    def __init__(self, shape: str, ids: dict):
        self.sigs, self.kids, self.parents = [], [], []
        path: list[int] = []
        for part in re.findall(r"\([^()]*|\)", shape):
            if part == ")":
                path.pop()
                continue
            node = len(self.sigs)
            self.sigs.append(part[1:])
            self.kids.append([])
            self.parents.append(path[-1] if path else -1)
            if path:
                self.kids[path[-1]].append(node)
            path.append(node)
        n = len(self.sigs)
        self.sizes, self.ids = [1] * n, [0] * n
        for e in range(n - 1, -1, -1):
            self.sizes[e] += sum(self.sizes[c] for c in self.kids[e])
            self.ids[e] = ids.setdefault((self.sigs[e], *(self.ids[c] for c in self.kids[e])), len(ids))


def _matching(a: Tree, b: Tree, i: int, j: int):
    """The most nodes that match below two nodes of one kind, and their pairs, nested; asks for what it needs by yielding (i, j)."""
    if a.ids[i] == b.ids[j]:
        return a.sizes[i], (range(i, i + a.sizes[i]), range(j, j + a.sizes[i]))
    x, y = a.kids[i], b.kids[j]
    head = 0  # equal subtrees at either end match in any largest match
    while head < min(len(x), len(y)) and a.ids[x[head]] == b.ids[y[head]]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and a.ids[x[-1 - tail]] == b.ids[y[-1 - tail]]:
        tail += 1
    ends = [*zip(x[:head], y[:head]), *zip(x[len(x) - tail :], y[len(y) - tail :])]
    found = [(range(i, i + 1), range(j, j + 1)), *((range(p, p + a.sizes[p]), range(q, q + a.sizes[p])) for p, q in ends)]
    score = 1 + sum(a.sizes[p] for p, _ in ends)
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    pair = {}
    for p, c in enumerate(x, 1):
        for q, d in enumerate(y, 1):
            if a.sigs[c] == b.sigs[d]:
                pair[p, q] = yield c, d
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for p in range(1, len(x) + 1):
        row, above = best[p], best[p - 1]
        for q in range(1, len(y) + 1):
            row[q] = max(above[q], row[q - 1], above[q - 1] + pair[p, q][0] if (p, q) in pair else 0)
    p, q = len(x), len(y)
    while p and q:
        if best[p][q] == best[p - 1][q]:
            p -= 1
        elif best[p][q] == best[p][q - 1]:
            q -= 1
        else:
            found.append(pair[p, q][1])
            p, q = p - 1, q - 1
    return score + best[len(x)][len(y)], found


def simple_match(a: Tree, b: Tree) -> tuple[int, list[int]]:
    """The most nodes of two trees that match in order under matching parents, and for each node of a its node in b, or -1."""
    own = [-1] * len(a.sigs)
    if a.sigs[0] != b.sigs[0]:
        return 0, own
    stack, answer = [_matching(a, b, 0, 0)], None  # by hand: pages may be deeper than Python's own stack
    while stack:
        try:
            stack.append(_matching(a, b, *stack[-1].send(answer)))
            answer = None
        except StopIteration as done:
            stack.pop()
            answer = done.value
    todo = [answer[1]]
    while todo:
        found = todo.pop()
        if isinstance(found, list):
            todo += found
        else:
            for i, j in zip(*found):
                own[i] = j
    return answer[0], own


def content_range(tree: Tree, mass: dict[int, int]) -> tuple[int, int]:
    """The nodes from .. to below which nearly all varying text lies: the lowest inner node with MOST of its parent's."""
    total = [mass.get(e, 0) for e in range(len(tree.sigs))]
    for e in range(len(total) - 1, 0, -1):
        total[tree.parents[e]] += total[e]
    at = 0
    while total[at]:
        best = max((c for c in tree.kids[at] if tree.kids[c]), key=lambda c: (total[c], -c), default=None)
        if best is None or total[best] < MOST * total[at]:
            break
        at = best
    return (at, at + tree.sizes[at]) if total[0] else (0, 0)


def inside_of(tree: Tree, own: list[int], first: int, last: int) -> list[int]:
    """The nodes of a tree that lie below the content's root: those matched there, and what only this tree has below them."""
    inside = [False] * len(own)
    for e, o in enumerate(own):
        inside[e] = first <= o < last if o >= 0 else tree.parents[e] >= 0 and inside[tree.parents[e]]
    return [e for e, yes in enumerate(inside) if yes]


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


_BLOCK = pa.struct([("node", pa.int32()), ("key", pa.int64()), ("flags", pa.int32()), ("text", pa.string())])
_READ = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("shape", pa.string()), ("tree", pa.string()), ("digest", pa.string()), ("blocks", pa.list_(_BLOCK)),
])


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host of each page, its tree, the digests of the tree and of the article's texts, and all blocks of text."""

    def run(batches):
        import xxhash

        for batch in batches:
            for _, part in row_slices(batch, ["html"]):
                rows = {f.name: [] for f in _READ} | {c: part.column(c) for c in ("page_id", "url", "host")}
                for source in part.column("html").to_pylist():
                    page = Page(source or "")
                    blocks = page.flagged()
                    rows["shape"].append(page.shape)
                    rows["tree"].append(xxhash.xxh3_128_hexdigest(page.shape))
                    rows["digest"].append(xxhash.xxh3_128_hexdigest("\n".join(t for _, t, flags in blocks if flags & NAMED)))
                    rows["blocks"].append([{"node": n, "key": xxhash.xxh3_64_intdigest(t, seed=flags & LINKS) - 2**63, "flags": flags, "text": t} for n, t, flags in blocks])
                yield rows_to_batch(_READ, rows)

    schema = "page_id long, url string, host string, shape string, tree string, digest string, blocks array<struct<node:int,key:bigint,flags:int,text:string>>"
    return pages.select("page_id", "url", host_of("url").alias("host"), "html").mapInArrow(run, schema)


def distinct_pages(read: DataFrame) -> DataFrame:
    """One of the pages of a host whose articles are equal: host, tree and its texts as (node, key, chars); chars: 0 for links."""
    size = lambda b: F.when(b["flags"].bitwiseAND(LINKS) != 0, 0).otherwise(F.length(b["text"]))
    texts = F.transform("blocks", lambda b: F.struct(b["node"].alias("node"), b["key"].alias("key"), size(b).alias("chars")))
    return read.groupBy("host", "digest").agg(F.min(F.struct("tree", texts.alias("texts"))).alias("p")).select("host", "p.*")


def aligned_trees(read: DataFrame, distinct: DataFrame) -> DataFrame:
    """(host, tree, shape, template, pages, own): each tree of a host matched with the host's most frequent one; own: for each node its node there."""
    shapes = read.groupBy("host", "tree").agg(F.first("shape").alias("shape"))
    trees = stored(distinct.groupBy("host", "tree").agg(F.count("*").alias("pages")).join(shapes, ["host", "tree"]))
    templates = trees.groupBy("host").agg(F.min_by("shape", F.struct(-F.col("pages"), "tree")).alias("template"), F.sum("pages").alias("of_host")).where(F.col("of_host") >= FEW)
    schema = pa.schema([("host", pa.string()), ("tree", pa.string()), ("shape", pa.string()), ("template", pa.string()), ("pages", pa.int64()), ("own", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            for _, part in row_slices(batch, ["shape", "template"]):
                rows = {f.name: part.column(f.name) for f in schema if f.name != "own"} | {"own": []}
                for shape, template in zip(rows["shape"].to_pylist(), rows["template"].to_pylist()):
                    ids: dict = {}
                    rows["own"].append(simple_match(Tree(shape, ids), Tree(template, ids))[1])
                yield rows_to_batch(schema, rows)

    both = trees.join(broadcast_if_small(stored(templates)), "host").select("host", "tree", "shape", "template", "pages")
    return both.mapInArrow(run, "host string, tree string, shape string, template string, pages long, own array<int>")


def text_counts(distinct: DataFrame, aligned: DataFrame) -> DataFrame:
    """(host, own, key, n, chars, constant): on how many of a host's distinct pages a text stands at an aligned node, and its length, 0 for links."""
    # A page counts a text once at a node, however often it stands there.
    text = lambda t: F.struct(F.get("own", t["node"]).alias("own"), t["key"].alias("key"), t["chars"].alias("chars"))
    each = distinct.join(broadcast_if_small(aligned.select("host", "tree", "own")), ["host", "tree"]).select("host", F.explode(F.array_distinct(F.transform("texts", text))).alias("t"))
    once = each.select("host", "t.*").where("own >= 0").groupBy("host", "own", "key").agg(F.count("*").alias("n"), F.first("chars").alias("chars"))
    pages = aligned.select("host", "pages", F.explode("own").alias("own")).where("own >= 0").groupBy("host", "own").agg(F.sum("pages").alias("pages"))
    counts = once.join(broadcast_if_small(stored(pages)), ["host", "own"])
    return counts.select("host", "own", "key", "n", "chars", ((F.col("pages") >= FEW) & (F.col("n") >= CONSTANT * F.col("pages"))).alias("constant"))


def induced(read: DataFrame) -> DataFrame:
    """(host, tree, inside, constants): what is learned of each tree: its nodes below the content's root, and hashes of (node, text) that are template."""
    distinct = stored(distinct_pages(read))
    aligned = stored(aligned_trees(read, distinct))
    counts = stored(text_counts(distinct, aligned))
    mass = counts.where("not constant").groupBy("host", "own").agg(F.sum(F.col("n") * F.col("chars")).alias("mass")).groupBy("host").agg(F.collect_list(F.struct("own", "mass")).alias("mass"))  # a row a node of the template
    schema = pa.schema([("host", pa.string()), ("tree", pa.string()), ("inside", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            for _, part in row_slices(batch, ["shape", "template"]):
                rows = {"host": part.column("host"), "tree": part.column("tree"), "inside": []}
                for shape, template, own, mass in zip(*(part.column(c).to_pylist() for c in ("shape", "template", "own", "mass"))):
                    bounds = content_range(Tree(template, {}), {m["own"]: m["mass"] for m in mass or ()})
                    rows["inside"].append(inside_of(Tree(shape, {}), own, *bounds))
                yield rows_to_batch(schema, rows)

    with_mass = aligned.join(broadcast_if_small(stored(mass)), "host", "left").select("host", "tree", "shape", "template", "own", "mass")
    inside = with_mass.mapInArrow(run, "host string, tree string, inside array<int>")
    nodes = aligned.select("host", "tree", F.posexplode("own").alias("node", "own")).where("own >= 0")
    constants = nodes.join(broadcast_if_small(stored(counts.where("constant").select("host", "own", "key"))), ["host", "own"])
    known = constants.groupBy("host", "tree").agg(F.collect_list(F.xxhash64("node", "key")).alias("constants"))
    return inside.join(known, ["host", "tree"], "left").select("host", "tree", "inside", F.coalesce("constants", F.array().cast("array<bigint>")).alias("constants"))


def extract_text(pages: DataFrame, induce: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of each page; induce=False: by names alone, as for a host with few pages."""
    read = stored(read_pages(pages))
    if induce:
        rows = read.join(broadcast_if_small(stored(induced(read))), ["host", "tree"], "left")
    else:
        rows = read.withColumns({"inside": F.lit(None).cast("array<int>"), "constants": F.lit(None).cast("array<bigint>")})
    has = lambda b, flag: b["flags"].bitwiseAND(flag) != 0
    chars = lambda blocks: F.aggregate(blocks, F.lit(0), lambda n, b: n + F.when(has(b, TITLE), 0).otherwise(F.length(b["text"])))  # noqa: E731  beside headings
    constant = lambda b: F.coalesce(F.array_contains("constants", F.xxhash64(b["node"], b["key"])), F.lit(False))
    below = lambda b: (F.array_contains("inside", b["node"]) & ~has(b, LINKS)) | has(b, TITLE)
    # First what varies below the content's root; then names.
    found = rows.withColumn("varying", F.filter("blocks", lambda b: ~constant(b))).withColumn("below", F.filter("varying", lambda b: below(b) & ~has(b, BESIDE)))
    found = found.withColumns({"marked": F.filter("below", lambda b: has(b, NAMED)), "named": F.filter("varying", lambda b: has(b, NAMED)), "all_named": F.filter("blocks", lambda b: has(b, NAMED))})
    text = (
        F.when(2 * chars(F.col("marked")) >= F.greatest(chars(F.col("below")), chars(F.col("named")), F.lit(1)), F.col("marked"))
        .when(2 * chars(F.col("below")) >= F.greatest(chars(F.col("named")), F.lit(1)), F.col("below"))
        .when(F.size("named") > 0, F.col("named")).otherwise(F.col("all_named"))
    )
    made = found.select("page_id", "url", F.array_join(F.transform(text, lambda b: b["text"]), "\n").alias("text"))
    return made.withColumn("n_chars", F.length("text").cast("long"))
