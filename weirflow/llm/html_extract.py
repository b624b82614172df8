"""Main text of web pages by consensus host paths.

Each page scores its containers by the text that their blocks hold beside links. The pages of a host then
vote, in Spark, on generalised tag-class paths (numbers in class names don't tell paths apart), and every
page is extracted again from the elements that lie on the winning path of its host; a page without such an
element uses its own best container. Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and comments are left out: by their tag or role, or by a whole class or id that names one (``sidebar``,
``site-footer``, ``share-buttons``; not ``has-sidebar``, ``share-price`` or ``related-work``). A class never condemns html, body,
main or article, nor what the extracted container lies in, and a header within an article or main element is part of it. If a page has no
text outside elements that a class or a form condemns, these count as any others. A condemned element within a paragraph takes its own words only. Ids name headings and paragraphs as targets of links and
condemn none. A first heading that stands before the extracted text, beside its container within a common element, belongs to it.

Parsing is linear in the page: open elements are found by their tag, and a container carries a hash of its path, so
neither stray end tags nor deep nesting is searched or copied. Only the paths that a page votes for become strings.

Votes are whole numbers summed with map-side aggregation, so a host with a third of all pages costs no more
than others. The winners (a row for each host) are broadcast while there are at most ``BROADCAST_HOSTS``,
else joined by a shuffle that Spark can split.

Defined results: null html is empty; a page without blocks gives an empty text; a page whose URL is null or
has no host votes with the others of that kind; each input row gives one row; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.arrow import id_type, map_slices, shared_dir

BROADCAST_HOSTS = 50_000
#: Containers for which a page votes, and the whole of a page's votes.
TOP = 3
VOTES = 1000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[\s/](?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)?|[^>]*)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg object select xmp noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CONTAINERS = frozenset("article body center div main section td".split())
#: Elements that are never part of the article, by tag or role.
NOISE_TAGS = frozenset("nav header footer aside button dialog menu head".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
#: Elements that no id condemns.
TARGETS = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Elements that no class condemns.
SAFE = frozenset("html body main article".split())
#: A class or id that names something else than the article: one of these words, alone or with words that only say where or what of it.
NOISE = re.compile(
    r"(?:(?:site|page|global|main|top|bottom|left|right|primary|secondary|blog|reader|user|post|article|cookie|gdpr|legal|mobile|sticky|social|google|email)[-_]+)?"
    r"(?:ads?|adverts?|advertisements?|banner|breadcrumbs?|comments?|commentlist|comment-respond|respond|replies|cookies?|consent|copyright|disclaimer|disqus|footer|foot|masthead|menu|nav|navbar|navigation|newsletter|"
    r"notices?|alert|pager|pagination|popup|promos?|promoted|related|recommended|recommendations|search|share|sharing|sidebar|skip-link|social|sponsors?|sponsored|subscribe|signup|login|modal|tags|toolbar|topbar|widgets?)"
    r"(?:[-_]+(?:list|area|section|wrapper|wrap|container|box|block|bar|banner|slot|unit|links?|buttons?|icons?|menu|nav|inner|top|bottom|left|right|main|primary|secondary|form|threads?|items?|posts|articles|stories|media|text|holder|panel|body|content|signup|share|default|fixed|light|dark|label|title|heading))*[-_]*[0-9]*"
    r"|author[-_]+(?:box|bio|card|info|panel|widget)[-_]*[0-9]*"
)
HEADER = re.compile(r"(?:(?:site|page|global|main|top|blog)[-_]+)?header(?:[-_]+(?:wrapper|wrap|container|inner|area|bar|top|main|nav))*[-_]*[0-9]*")
#: What a start tag closes when it is the innermost of its kind, and where looking for it stops.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",)), "option": (("option",), ("select",)), "p": (("p",), (*CONTAINERS, *NOISE_TAGS))}
ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}
PRIME = (1 << 61) - 1


def grown(key: int, step: str) -> int:
    """The hash of a path with a step more."""
    return (key * 1_000_003 + zlib.crc32(step.encode("utf-8", "surrogatepass")) + 1) % PRIME


def step(tag: str, attrs: str) -> tuple[str, str, list[str]]:
    """An element's part of a path, its role, and its classes and id."""
    if "=" not in attrs:
        return tag, "", []
    found = {k.lower(): entities.unescape(v.strip("\"'")) for k, v in ATTR.findall(attrs)}
    classes = found.get("class", "").split()
    general = sorted({re.sub(r"[0-9]+", "#", x.lower()).replace(">", "") for x in classes})
    return ".".join([tag, *general]), found.get("role", "").strip().lower(), [*classes, found.get("id", "").strip()]


def names_noise(names: list[str], pattern: re.Pattern = NOISE) -> bool:
    return any(x and pattern.fullmatch(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", x).lower()) for x in names)


class Block:
    """Runs of text with how many elements around each are condemned by a class and whether it is link text; the block's container and tag."""

    __slots__ = ("at", "runs", "tag")

    def __init__(self, at: int, tag: str):
        self.at, self.tag, self.runs = at, tag, []

    def text(self, soft: int | None = None) -> str:
        """Of the runs that so many elements condemn, or of all."""
        return " ".join(entities.unescape("".join(t for t, s, _ in self.runs if soft is None or s == soft)).split())

    def clean(self) -> bool:
        return any(not s for _, s, _ in self.runs)

    def weight(self, every: bool) -> int:
        return max(0, sum(len(t) * (1 - 2 * link) for t, s, link in self.runs if every or not s))


class Page:
    """The containers of a page (parent, step, hash of the path, condemned elements around and at it, article or main element that it is in) and its blocks."""

    def __init__(self, page: str):
        self.parent, self.step, self.key, self.soft, self.home = [-1], [""], [0], [0], [-1]
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, bool, bool, int]] = []  # tag, noise, condemned by a class, container
        self.open: dict[str, list[int]] = {}
        self.noise = self.condemned = 0
        self.now: Block | None = None
        self.read(page)

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag, bad, soft, _ = self.stack.pop()
            self.open[tag].pop()
            self.noise -= bad
            self.condemned -= soft

    def last(self, tags: tuple[str, ...]) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def say(self, text: str) -> None:
        if self.noise or not text:
            return
        if self.now is None:
            if text.isspace():
                return
            tag = next((t for t, *_ in reversed(self.stack) if t in BLOCKS), "")
            self.now = Block(self.stack[-1][3] if self.stack else 0, tag)
            self.blocks.append(self.now)
        self.now.runs.append((text, self.condemned, bool(self.open.get("a"))))

    def start(self, tag: str, attrs: str) -> None:
        name, role, names = step(tag, attrs)
        if tag in TARGETS:
            names = names[:-1]
        inside = bool(self.open.get("article") or self.open.get("main"))
        bad = tag in NOISE_TAGS and not (tag == "header" and inside) or role in NOISE_ROLES and tag not in SAFE
        soft = not bad and tag not in SAFE and (tag == "form" or names_noise(names) or not inside and names_noise(names, HEADER))
        at = self.stack[-1][3] if self.stack else 0
        self.noise += bad
        self.condemned += soft
        if tag in CONTAINERS and not self.noise:
            new = len(self.parent)
            home = self.home[at]
            kind = self.step[home].split(".", 1)[0] if home >= 0 else ""
            if tag == "article" and kind != "article" or tag == "main" and not kind:
                home = new
            self.parent.append(at)
            self.step.append(name)
            self.key.append(grown(self.key[at], name))
            self.soft.append(self.condemned)
            self.home.append(home)
            at = new
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, bad, soft, at))

    def read(self, page: str) -> None:
        at = 0
        while m := TOKEN.search(page, at):
            self.say(page[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "br":
                self.say(" ")
                continue
            if tag in BLOCKS and not self.noise:
                self.now = None
            if m["close"]:
                if self.open.get(tag):
                    self.pop(self.open[tag][-1])
                continue
            for kind in [k for k in (("p", tag) if tag in BLOCKS and tag != "p" else (tag,)) if k in CLOSES]:  # a block ends an open paragraph
                own, stop = CLOSES[kind]
                found = self.last(own)
                if found > self.last(stop):
                    self.pop(found)
            closed = m["attrs"].endswith("/")
            if tag in VOID or closed and tag not in BLOCKS and tag not in RAW or closed and tag == "svg":
                continue
            if tag in RAW:  # its content is no markup
                end = ENDS[tag].search(page, at)
                at = end.end() if end else len(page)
                continue
            self.start(tag, m["attrs"])
        self.say(page[at:])

    def path(self, node: int) -> str:
        steps = []
        while node > 0:
            steps.append(self.step[node])
            node = self.parent[node]
        return ">".join(reversed(steps))

    def scores(self) -> dict[int, float]:
        """Of the containers that blocks count for: a block's article or main element, else the nearest ones. One container stands for all of its path."""
        clean = [b for b in self.blocks if b.clean()]
        every = not clean
        clean = clean or self.blocks
        first: dict[int, int] = {}
        total: dict[int, float] = {}
        for b in clean:
            n = b.weight(every)
            node, share = (self.home[b.at], 0.0) if self.home[b.at] >= 0 else (b.at, 0.6)
            weight = 1.0
            for _ in range(3 if share else 1):
                if node <= 0:
                    break
                known = first.setdefault(self.key[node], node)
                total[known] = total.get(known, 0.0) + n * weight
                node, weight = self.parent[node], weight * share
        return total

    def best(self) -> list[tuple[int, float]]:
        return sorted(((k, s) for k, s in self.scores().items() if s > 0), key=lambda x: (-x[1], x[0]))[:TOP]

    def within(self, key: int) -> list[str]:
        """The texts of the blocks in the outermost containers of a path, without what a class condemns within them, and of the headline beside them."""
        base = [-1] * len(self.parent)  # condemned elements around the container of the path, -1 outside
        for k in range(1, len(base)):
            up = base[self.parent[k]]
            base[k] = up if up >= 0 else self.soft[k] if self.key[k] == key else -1
        chosen = [b for b in self.blocks if base[b.at] >= 0 and b.text(base[b.at])]
        texts = [b.text(base[b.at]) for b in chosen]
        if chosen and not any(b.tag == "h1" for b in chosen):
            texts = self.headline(chosen[0], base) + texts
        return texts

    def headline(self, first: Block, base: list[int]) -> list[str]:
        """The only clean first heading of the page, if it stands before the text in an element around its container that is neither html nor body."""
        heads = [b for b in self.blocks if b.tag == "h1" and b.clean()]
        if len(heads) != 1 or self.blocks.index(heads[0]) > self.blocks.index(first):
            return []
        node = first.at
        while node > 0 and base[node] >= 0:
            node = self.parent[node]
        while node > 0 and node != heads[0].at:
            node = self.parent[node]
        return [heads[0].text(0)] if node > 0 and self.step[node].split(".", 1)[0] not in ("html", "body") else []


def extract(page: str, path: str | None) -> str:
    found = Page(page)
    chosen: list[str] = []
    if path:
        key = 0
        for x in path.split(">"):
            key = grown(key, x)
        chosen = found.within(key)
    if not chosen:
        own = found.best()
        chosen = found.within(found.key[own[0][0]]) if own else [b.text(0) for b in found.blocks]
    return "\n\n".join(t for t in chosen if t)


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def ballots(batch: pa.RecordBatch) -> pa.RecordBatch:
    hosts, paths, votes = [], [], []
    for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
        read = Page(page)
        found = read.best()
        total = sum(s for _, s in found)
        for k, s in found:
            hosts.append(h)
            paths.append(read.path(k))
            votes.append(int(VOTES * s / total))
    return pa.record_batch([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes, pa.int64())], names=["host", "path", "votes"])


def keyed_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), host(F.col(url_col).cast("string")).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))


def host_paths(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path and votes of each host's winning path; of equal ones the deeper, then the first by name."""
    cast = map_slices(keyed_pages(pages, id_col, url_col, html_col).select("host", "html"), ballots, "host string, path string, votes long", "html")
    sums = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    order = F.struct(-F.col("votes"), -F.size(F.split("path", ">")), "path", "votes")
    return sums.groupBy("host").agg(F.min(order).alias("w")).select("host", F.col("w.path").alias("path"), F.col("w.votes").alias("votes"))


def extracted(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [extract(h, p) for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
    return pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each row."""
    shared_dir(pages.sparkSession)
    winners = host_paths(pages, id_col, url_col, html_col).select(F.col("host").alias("_host"), "path").checkpoint()
    if winners.count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    rows = keyed_pages(pages, id_col, url_col, html_col)
    rows = rows.join(winners, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "path")
    return map_slices(rows, extracted, f"page_id {id_type(pages, id_col)}, url string, text string, n_chars long", "html")
