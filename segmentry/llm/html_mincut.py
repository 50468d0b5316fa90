"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks at block-level tags, and its elements into regions: an element whose tag, role or class speaks for
content or against it begins one. The graph has a node for every block and every region. A block's terminal capacity is the
log-odds of a classifier of its text (words, links, punctuation, headings), a region's is what its marks say. Smoothness
edges join each block with its region (or, outside all regions, with the element around it), each region with the one
around it, and neighbours in page order, more strongly the closer their places in the document tree. The minimum cut, found
by max-flow, labels the blocks, so short paragraphs follow the article around them, long comments the section of comments, and a
region with doubtful marks the texts in it. Nodes whose terminal capacity exceeds all their other edges are labelled
beforehand, which changes no minimum cut.

The classifier is a logistic model fitted to blocks of regions with firm marks in SAMPLE pages (those of the smallest hashes), drawn
towards fixed weights, which stand alone where no page has such marks.

Scripts, styles, titles, forms' controls and comments in the markup never make blocks; the head ends at the first
text or element that can't be in it. Tags may be unclosed, closed twice or cut off at the end of the page: a hidden
element without its end tag ends with the element around it or at the next block (scripts and styles: with the page).

Results for odd rows: null or empty html, and pages without content, give an empty text; repeated
rows give equal values; nothing is dropped or capped by length.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_slice, table

#: Elements that never hold readable text, elements that part blocks, and void elements.
HIDDEN = frozenset("script style noscript template svg math title iframe object canvas audio video select textarea button datalist noembed noframes xmp map".split())
BLOCKS = frozenset("html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open one of the same kind, or an open paragraph.
ENDS_OWN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
#: Clues of boilerplate and of content, in tags, roles and words of class and id. A class or id of STRONG words, with BESIDE words at most, holds for all below it.
BOILER_TAGS = frozenset("nav footer aside form menu dialog search".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
STRONG = re.compile(r"^(nav|navbar|navigation|menu|menubar|submenu|breadcrumbs?|footer|ads?|adv|advert\w*|adsense|adbox|adslot|sponsor\w*|promo|promos|promotion\w*|promoted|comments?|commentlist|disqus|respond|replies|reply|discussion|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|searchform|form|related|recommend\w*|share|sharing|sharebar|social|pagination|pager|outbrain|taboola|copyright|legal|disclaimer|skip|alert|toast|paywall|trending|feedback)$")
BESIDE = re.compile(r"^(site|top|bottom|main|list|lists|box|boxes|block|blocks|bar|container|wrapper|wrap|section|sections|links?|banner|area|items?|inner|outer|left|right|posts?|articles?|stories|slots?|unit|units|text|content|message|msg|widgets?|panel|global|primary|secondary|mobile|desktop|header|title|icons?|buttons?|btn|to|us|the|your|and|by|of|you|page|group|module|placeholder|leaderboard|body|row|col|column|media|threads?|entry|entries|user|reader|policy|warning|sticky|fixed|small|large|count|box\w*|\w)$")
WEAK = re.compile(r"^(header|masthead|banner|topbar|toolbar|sidebar|sidebars|side|rail|widgets?|meta|byline|tags?|toc|hidden)$")
CONTENT = re.compile(r"^(article|articlebody|content|maincontent|main|post|postbody|entry|story|storybody|body|text|prose)$")
LAYOUT = re.compile(r"^(has|with|no|layout|page|wrapper|wrap|container|row|col|grid|site|l|r|left|right)$")

TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
HIDDEN_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in HIDDEN}
#: Hidden elements without markup in them; CODE may hold anything that looks like tags.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
CODE = frozenset("script style xmp".split())

PLAIN, ARTICLE, LIGHT, BOILER = range(4)
#: What the marks of a region say for content: of a tag or role, of a class or id, and of a class or id with a STRONG word among others.
BY_TAG, BY_CLASS, DOUBTFUL = {ARTICLE: 8.0, LIGHT: -8.0, BOILER: -20.0}, {ARTICLE: 6.0, LIGHT: -8.0, BOILER: -12.0}, -1.5
#: A page with an article of so many words keeps nothing outside regions; MARKED is what it says against it.
ARTICLE_WORDS, MARKED = 5, -8.0
#: Weights of the edges, and the most that a text can say for or against content.
TO_REGION, TO_CONTAINER, SAME_KIND, OTHER_KIND, NEXT, NEXT_REGION, MOST = 5.0, 2.5, 4.0, 1.0, 1.0, 0.1, 3.0
#: Fixed weights that the fitted ones are drawn to: of a constant, tens of words, an end mark, links beyond 0.3 of the words, a heading.
WEIGHTS = (-1.0, 1.0, 0.5, -5.0, 0.8)
#: Pages that the classifier is fitted to at most, and how strongly its weights are drawn to the fixed ones (in blocks).
SAMPLE, DRAWN = 500, 200.0


class Block:
    __slots__ = ("text", "words", "linked", "region", "element", "heading")


class Region:
    __slots__ = ("kind", "says", "above")

    def __init__(self, kind: int, says: float, above: int):
        self.kind, self.says, self.above = kind, says, above


def clue(name: str, attributes: str, above: int) -> tuple[int, float]:
    """The kind of region that an element is in, given the kind above it, and what its marks say (0: it begins no region)."""
    words, names, role = [], [], ""
    if above == BOILER:
        return above, 0.0
    if attributes and name not in ("html", "body"):
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                own = [re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower()) for x in value.split()]
                names += own
                words += [w for x in own for w in x]
            elif key == "role":
                role = value.strip().lower()
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.lower().replace(" ", ""):
                return BOILER, BY_TAG[BOILER]
    if name in BOILER_TAGS or role in BOILER_ROLES:
        return BOILER, BY_TAG[BOILER]
    strong = [x for x in names if any(map(STRONG.match, x))]
    if any(all(STRONG.match(w) or BESIDE.match(w) for w in x) for x in strong):
        return BOILER, BY_CLASS[BOILER]
    if name in ("article", "main") or role in ("article", "main"):
        return ARTICLE, BY_TAG[ARTICLE] if above != ARTICLE else 0.0
    if above != ARTICLE:
        if name == "header":
            return LIGHT, BY_TAG[LIGHT] if above != LIGHT else 0.0
        if any(map(WEAK.match, words)) and not any(map(LAYOUT.match, words)):
            return LIGHT, BY_CLASS[LIGHT] if above != LIGHT else 0.0
    if above == PLAIN and any(map(CONTENT.match, words)):
        return ARTICLE, BY_CLASS[ARTICLE]
    return above, DOUBTFUL if strong else 0.0


class Ends:
    """Where the hidden elements of a page end."""

    def __init__(self, page: str):
        self.page, self.next = page, {}

    def own(self, name: str, at: int) -> tuple[int, int]:
        """Start and end of the next end tag of the name, the end of the page if there is none."""
        found = self.next.get(name)
        if found is None or found[0] < at:
            m = HIDDEN_END[name].search(self.page, at)
            found = self.next[name] = m.span() if m else (len(self.page), len(self.page))
        return found

    def after(self, name: str, at: int, around) -> int:
        """The place behind an element whose start tag ends at `at`, inside open block elements `around`."""
        start, end = self.own(name, at)
        if name in CODE or name in RAW and start < len(self.page):
            return end
        inner: dict[str, int] = {}
        while (m := TAG.search(self.page, at, start)) is not None:
            at, tag, closing = m.end(), (m[2] or m[5] or "").lower(), bool(m[1] or m[4])
            if "body" not in around and (tag == "head" and closing or tag == "body" and not closing):
                return m.start()
            if tag in CODE and not closing:
                at = min(self.own(tag, at)[1], start)
            elif tag in BLOCKS and tag not in VOID:
                if start == len(self.page):
                    # without an end tag of its own an element ends with the first block
                    return m.start()
                if not closing:
                    inner[tag] = inner.get(tag, 0) + 1
                elif inner.get(tag):
                    inner[tag] -= 1
                elif tag in around:
                    return m.start()
        return end


class Page:
    """Blocks in page order, with white space settled and references decoded, the regions, and the parent and depth of every element."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.regions = [Region(PLAIN, 0.0, -1)]
        self.parent, self.depth = [0], [0]
        self.read(page)

    def read(self, page: str) -> None:
        #: Open block elements: name, region, number; and how many are open by name.
        stack, names = [("", 0, 0)], Counter()
        pieces: list[str] = []
        link = linked = 0

        def flush():
            if pieces:
                words = entities.unescape("".join(pieces)).split()
                pieces.clear()
                if words:
                    b = Block()
                    b.text, b.words, b.linked = " ".join(words), len(words), min(linked, len(words))
                    b.region, b.element, b.heading = stack[-1][1], stack[-1][2], stack[-1][0] in HEADINGS
                    self.blocks.append(b)

        def close(k):
            for name, _, _ in stack[k:]:
                names[name] -= 1
            del stack[k:]

        at, end, ends = 0, len(page), Ends(page)
        while at < end:
            m = TAG.search(page, at)
            # what follows a lone "<" is text
            raw = page[at : m.start()] if m else page[at:]
            if raw:
                pieces.append(raw)
                if link:
                    linked += len(raw.split())
            if m is None:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] if m[2] else m[6]
            if name in HIDDEN:
                if not closing and not attributes.endswith("/"):
                    at = ends.after(name, at, +names)
                continue
            if name == "a":
                link = 0 if closing else 1
                continue
            if name == "br":
                pieces.append(" ")
                continue
            if name not in BLOCKS:
                continue
            flush()
            link = linked = 0
            if name in VOID:
                continue
            if closing:
                for k in range(len(stack) - 1, 0, -1) if names[name] else ():
                    if stack[k][0] == name:
                        close(k)
                        break
                    if name == "p" or name in ENDS_OWN and stack[k][0] in ENDS_OWN[name]:
                        break
                continue
            if stack[-1][0] == "p":
                close(len(stack) - 1)
            if name in ENDS_OWN and (names[name] or name in ("dt", "dd") and names["dt"] + names["dd"]):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name or stack[k][0] in ("dt", "dd") and name in ("dt", "dd"):
                        close(k)
                        break
                    if stack[k][0] in ENDS_OWN[name]:
                        break
            _, region, above = stack[-1]
            kind, says = clue(name, attributes, self.regions[region].kind)
            if says:
                self.regions.append(Region(kind, says, region))
                region = len(self.regions) - 1
            self.parent.append(above)
            self.depth.append(self.depth[above] + 1)
            stack.append((name, region, len(self.parent) - 1))
            names[name] += 1
        flush()

    def apart(self, a: int, b: int) -> int:
        """Steps between two elements in the document tree."""
        steps = 0
        while a != b:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            a, steps = self.parent[a], steps + 1
        return steps

    def graph(self, weights) -> tuple[list[float], list[tuple[int, int, float]]]:
        """What speaks for content in each node, and the edges; the blocks are the first nodes."""
        blocks, regions, n = self.blocks, self.regions, len(self.blocks)
        values = [max(-MOST, min(MOST, sum(map(mul, weights, features(b))))) for b in blocks] + [r.says for r in regions]
        edges = [(n + r.above, n + k, SAME_KIND if regions[r.above].kind == r.kind else OTHER_KIND) for k, r in enumerate(regions) if k and r.above]
        marked = sum(b.words for b in blocks if regions[b.region].kind == ARTICLE) >= ARTICLE_WORDS
        if marked:
            values[n] = MARKED
        containers: dict[int, int] = {}
        for k, b in enumerate(blocks):
            if b.region or marked:
                edges.append((k, n + b.region, TO_REGION))
            else:
                at = containers.setdefault(self.parent[b.element], len(values))
                if at == len(values):
                    values.append(0.0)
                edges.append((k, at, TO_CONTAINER))
            if k:
                a = blocks[k - 1]
                edges.append((k - 1, k, (NEXT if a.region == b.region else NEXT_REGION) / (1 + 0.5 * self.apart(a.element, b.element))))
        return values, edges


def features(b: Block) -> tuple[float, ...]:
    return 1.0, min(b.words, 40) / 10, float(b.text[-1] in ".!?…。\"”"), max(0.0, b.linked / b.words - 0.3), float(b.heading)


def firm(source: str) -> list[tuple[float, ...]]:
    """Features and label of each block in a region with firm marks; shares of links on a grid, so that there are few different rows."""
    page, out = Page(source), []
    for b in page.blocks:
        r = page.regions[b.region]
        if r.kind in (ARTICLE, BOILER) and abs(r.says) >= abs(BY_CLASS[r.kind]):
            x = features(b)
            out.append((*x[:3], round(x[3] * 20) / 20, x[4], float(r.kind == ARTICLE)))
    return out


def fit(rows) -> tuple[float, ...]:
    """Weights of the classifier, from rows of features, label and number; both labels count the same, however many blocks have them."""
    rows = np.array(sorted(rows), float).reshape(-1, len(WEIGHTS) + 2)
    x, y, n, prior = rows[:, :-2], rows[:, -2], rows[:, -1], np.array(WEIGHTS)
    good, bad = (n * y).sum(), (n * (1 - y)).sum()
    if not (good and bad):
        return WEIGHTS
    share, w = n * np.where(y == 1, (good + bad) / good / 2, (good + bad) / bad / 2), prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + DRAWN * (w - prior)
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + DRAWN * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(round(float(v), 6) for v in w)


def min_cut(values: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of the minimum cut; values: source capacity less sink capacity."""
    n = len(values)
    total, by = [0.0] * n, [[] for _ in range(n)]
    for i, j, w in edges:
        total[i] += w
        total[j] += w
        by[i].append((j, w))
        by[j].append((i, w))
    values, label = list(values), [None] * n
    settled = deque(k for k in range(n) if abs(values[k]) >= total[k])
    while settled:
        k = settled.popleft()
        if label[k] is not None:
            continue
        label[k] = values[k] > 0
        for j, w in by[k]:
            if label[j] is None:
                values[j] += w if label[k] else -w
                total[j] -= w
                if abs(values[j]) >= total[j] - 1e-12:
                    settled.append(j)
    free = [k for k in range(n) if label[k] is None]
    if free:
        for k, side in zip(free, max_flow_side(free, values, by, label)):
            label[k] = side
    return label


def max_flow_side(free, values, by, label) -> list[bool]:
    """Dinic's algorithm on the nodes without a label."""
    place = {k: i for i, k in enumerate(free)}
    n = len(free)
    s, t = n, n + 1
    graph: list[list[list]] = [[] for _ in range(n + 2)]

    def add(i, j, c, back):
        graph[i].append([j, c, len(graph[j])])
        graph[j].append([i, back, len(graph[i]) - 1])

    for k in free:
        if values[k] > 0:
            add(s, place[k], values[k], 0.0)
        elif values[k] < 0:
            add(place[k], t, -values[k], 0.0)
        for j, w in by[k]:
            if label[j] is None and j > k:
                add(place[k], place[j], w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            i = queue.popleft()
            for j, c, _ in graph[i]:
                if c > 1e-12 and level[j] < 0:
                    level[j] = level[i] + 1
                    queue.append(j)
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        at = [0] * (n + 2)
        while True:
            # one augmenting path of the level graph, without recursion
            path, i = [], s
            while i != t:
                while at[i] < len(graph[i]):
                    j, c, _ = graph[i][at[i]]
                    if c > 1e-12 and level[j] == level[i] + 1:
                        break
                    at[i] += 1
                if at[i] < len(graph[i]):
                    path.append((i, at[i]))
                    i = graph[i][at[i]][0]
                elif path:
                    i, _ = path.pop()
                    at[i] += 1
                else:
                    break
            if i != t:
                break
            least = min(graph[i][k][1] for i, k in path)
            for i, k in path:
                e = graph[i][k]
                e[1] -= least
                graph[e[0]][e[2]][1] += least


def main_text(source: str | None, weights=WEIGHTS) -> str:
    page = Page(source or "")
    kept = min_cut(*page.graph(weights)) if page.blocks else []
    return "\n\n".join(b.text for b, k in zip(page.blocks, kept) if k)


def learn(pages: DataFrame, page: str = "html") -> tuple[float, ...]:
    """Weights from the SAMPLE different pages of the smallest hashes; the driver sees counts of the different rows of features only."""
    hashed = pages.where(F.col(page).isNotNull()).select(F.col(page).alias("page"), F.xxhash64(page).alias("hash"))
    last = hashed.select("hash").distinct().orderBy("hash").limit(SAMPLE).agg(F.max("hash")).first()[0]
    if last is None:
        return WEIGHTS
    names = ["one", "words", "ended", "linked", "heading", "label"]
    schema = pa.schema([(c, pa.float64()) for c in names])

    def run(batches):
        for batch in batches:
            for source in batch.column(0):
                rows = firm(source.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.float64()) for k in range(len(names))], schema=schema)

    chosen = hashed.where(F.col("hash") <= last).select("page").distinct()
    return fit(tuple(r) for r in chosen.mapInArrow(run, ", ".join(f"{c} double" for c in names)).groupBy(*names).count().collect())


def extract(pages: DataFrame, page: str = "html", weights=None) -> DataFrame:
    """page_id, url, text and n_chars of every page; without weights they are learned from the pages."""
    weights = learn(pages, page) if weights is None else weights
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def f(ids, urls, sources):
        texts = [main_text(x, weights) for x in sources]
        return [ids, urls, texts, [len(x) for x in texts]]

    return pages.select("page_id", "url", page).mapInArrow(per_slice(lambda: f, schema), "page_id long, url string, text string, n_chars long")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
