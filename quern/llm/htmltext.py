"""HTML extraction with site style trees.

Pages of a host are merged into one style tree, and those of all hosts of a registered domain, which often share their
templates, into another. A node is a block element that holds others, or has a class, id or role; elements with the same run
of such names from the root are one node, and bare paragraphs, headings and inline elements are part of the node they stand
in. Spark counts, over the distinct pages of each such site, the looks of each node, its run of children (presentation), and
its own texts (content; addresses and numbers in it count as alike). With m pages a node's presentation has the entropy of
its looks, to the base m; its content has one less the mean entropy of its texts, where a text that c pages share has
log c / log m. What is neither new in look nor in content has a low importance, and a branch of a page that has only nodes of
low importance, in one of the two trees, is removed from it. One page says nothing, so a node's importance is drawn towards 1
as if so many pages had shown it: PRIOR of them, or for parts of an article PRIOR_INSIDE.

The tree decides first. Some noise differs from page to page, so that no entropy shows it: scripts and forms, menus and
comments. What of these the tree has left goes by what HTML itself says: by tags, roles and a few whole names of classes.
The element article (or main) stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import apart, over_texts, owned, together, with_fields, written
from quern.sources.tables import table

#: Nodes below these importances are low: in general, and inside an article.
LOW, LOW_INSIDE = 0.7, 0.3
PRIOR, PRIOR_INSIDE = 2.0, 10.0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav noscript ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Blocks that are nodes without any attribute.
HOLDERS = frozenset("article aside details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
#: Elements that a new one of the given tag ends, up to the nearest element that holds them.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLD = ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select", "body", "article", "div", "section")
ENDS_P = BLOCK - {"html", "head", "body", "title", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "legend", "summary"}
HOLD_P = ("button", "table", "td", "article", "div", "section", "body")
OF_HEAD = frozenset("base link meta noscript script style template title".split())
#: Never text of a page, whatever the tree says.
NO_TEXT = frozenset("head title script style noscript noembed noframes template iframe object svg button select textarea datalist canvas".split())
DROPPED = frozenset("nav footer aside dialog menu label".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Whole names of classes and ids that leave no doubt.
DROPPED_NAMES = frozenset(
    "ad ads advert advertisement advertising adsense sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar side-bar footer "
    "site-footer site-header masthead cookie cookies cookie-banner cookie-notice cookie-consent consent gdpr notice newsletter subscribe signup "
    "popup modal comment comments comment-list commentlist comment-section comments-section comments-area comment-area comments-list comment-body "
    "comment-content comment-text comment-form comment-respond comment-thread user-comments reader-comments disqus disqus_thread related related-articles related-posts share share-buttons "
    "social social-links widget".split()
)
#: What HTML says of an element: nothing; that it goes; that it is a form; that it is, or is within, an article; that it has no text.
OPEN, GOES, FORM, INSIDE, EMPTY = range(5)
ROOT = 0
#: Each node of a site's tree is in so many copies when pages look up their own.
SALTS = 8
#: Low nodes of all sites that are broadcast at most, some 100 bytes each; beyond, pages meet their own in joins.
MAX_BROADCAST = 300_000

#: Attributes that are looked at.
WANTED = frozenset(("class", "id", "role", "hidden", "style"))
NOT_SHOWN = re.compile(r"(?:display\s*+:\s*+none|visibility\s*+:\s*+hidden)", re.I)
#: Tags as most are: attributes without a value, or with one that ends as it should.
PLAIN = re.compile(r"""<([a-zA-Z][^\t\n\f\r />]*+)((?:[\t\n\f\r ]++[^\t\n\f\r />="'<]++(?:=(?:"[^"]*+"|'[^']*+'|[^\t\n\f\r "'<>=`]++))?+)*+)[\t\n\f\r ]*+(/?)>""")
PLAIN_END = re.compile(r"</([a-zA-Z][^\t\n\f\r />]*+)[\t\n\f\r ]*+>")
ATTRIBUTE = re.compile(r"""([^\t\n\f\r />="'<]++)(?:=(?:"([^"]*+)"|'([^']*+)'|([^\t\n\f\r "'<>=`]++)))?+""")
#: Any tag up to its name, and what stands between and in attributes.
TAG = re.compile(r"<(/?)([a-zA-Z][^\t\n\f\r />]*+)")
BETWEEN = re.compile(r"[\t\n\f\r /]*+")
NAME = re.compile(r"=?[^\t\n\f\r />=]*+")
EQUALS = re.compile(r"[\t\n\f\r ]*+=[\t\n\f\r ]*+")
UNQUOTED = re.compile(r"[^\t\n\f\r >]*+")
EMPTY_COMMENT, COMMENT_END = re.compile("<!--(?:>|->)"), re.compile("--!?>")
#: Elements whose contents are no tags, with what ends them.
RAW = {tag: re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I) for tag in "script style textarea title iframe noembed noframes".split()}
LEADING_ZEROS, LONG_NUMBER = re.compile("(&#[xX]?+)0++(?=[0-9a-fA-F])"), re.compile("&#(?:[0-9]{8,}+|[xX][0-9a-fA-F]{8,}+);?+")
#: Names of hosts, and numbers.
ALIKE = re.compile(r"[\w-]+(?:\.[\w-]+)+|[0-9]+")


def digest(*parts: str | int) -> int:
    return int.from_bytes(blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def unescaped(text: str) -> str:
    """Character references decoded; numbers too long for any character count as unknown ones."""
    if "&#" in text:
        text = LONG_NUMBER.sub("\ufffd", LEADING_ZEROS.sub(r"\1", text))
    return unescape(text) if "&" in text else text


def attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes WANTED of a tag, from behind its name on, and where it ends: -1 if it never does. Of a repeated one the first counts."""
    found: dict[str, str] = {}
    while True:
        at = BETWEEN.match(html, at).end()
        if at == len(html):
            return found, -1
        if html[at] == ">":
            return found, at + 1
        name = NAME.match(html, at)
        value, at = "", name.end()
        if equals := EQUALS.match(html, at):
            at = equals.end()
            if (quote := html[at : at + 1]) in ('"', "'"):
                end = html.find(quote, at + 1)
                if end < 0:
                    return found, -1
                value, at = html[at + 1 : end], end + 1
            else:
                end = UNQUOTED.match(html, at).end()
                value, at = html[at:end], end
        if (name := name.group().lower()) in WANTED:
            found.setdefault(name, value)


class Page:
    """A page's nodes, each after the one it is in, and its pieces of text.

    keys, above, says: of each node a hash of the names from the root, the node it is in, what HTML says of it. looks: the
    names of its children. pieces: (node, text); None for a text is a border between blocks.

    One scan from left to right reads the page, as the HTML standard says: a tag or comment that is not finished ends with
    the page and counts for nothing, and so does an unfinished script. No place is read more than twice.
    """

    def __init__(self, html: str | None):
        self.keys, self.above, self.says, self.looks = [ROOT], [0], [OPEN], [[]]
        self.pieces: list[tuple[int, str | None]] = []
        self.now: list[str] = []  # text of the node now_in that is not among the pieces yet
        self.now_in = 0
        self.open: list[tuple[str, int]] = []  # tags with their nodes
        self.places: dict[str, list[int]] = {}  # of each tag, where it is open
        self.read(html or "")
        self.settle()

    def read(self, html: str) -> None:
        at = 0
        while at < len(html):
            less = html.find("<", at)
            if less < 0:
                less = len(html)
            if less > at:
                self.data(unescaped(html[at:less]))
            if less == len(html):
                return
            if plain := PLAIN.match(html, less):
                tag, given, closes = plain.groups()
                found = {}
                for name, *values in ATTRIBUTE.findall(given) if given else ():
                    if (name := name.lower()) in WANTED:
                        found.setdefault(name, "".join(values))
                at = self.start(html, tag.lower(), found, plain.end(), closes)
            elif end := PLAIN_END.match(html, less):
                self.end_tag(end[1].lower())
                at = end.end()
            elif tag := TAG.match(html, less):
                found, at = attributes(html, tag.end())
                if at < 0:
                    return
                if tag[1]:
                    self.end_tag(tag[2].lower())
                else:
                    at = self.start(html, tag[2].lower(), found, at, html[at - 2] == "/")
            elif html.startswith(("<!", "<?", "</"), less):
                at = self.after_comment(html, less)
                if at < 0:
                    return
            else:
                self.data("<")
                at = less + 1

    @staticmethod
    def after_comment(html: str, at: int) -> int:
        """Where a comment, or what counts as one, ends; -1 if it never does."""
        if not html.startswith("<!--", at):
            return html.find(">", at) + 1 or -1
        if empty := EMPTY_COMMENT.match(html, at):
            return empty.end()
        end = COMMENT_END.search(html, at + 4)
        return end.end() if end else -1

    def start(self, html: str, tag: str, given: dict, at: int, closes: object) -> int:
        """Takes a start tag; gives where to read on, which is behind the contents of an element that holds no tags."""
        self.start_tag(tag, given)
        if tag in RAW:
            end = RAW[tag].search(html, at)
            return end.start() if end else len(html)
        if closes and tag not in VOID:
            self.end_tag(tag)
        return at

    def settle(self) -> None:
        if self.now:
            self.pieces.append((self.now_in, "".join(self.now)))
            self.now = []

    def data(self, text: str) -> None:
        node = self.node()
        if self.says[node] == EMPTY:
            return
        if node != self.now_in:
            self.settle()
            self.now_in = node
        self.now.append(text)

    def border(self) -> None:
        self.settle()
        if self.pieces and self.pieces[-1][1] is not None:
            self.pieces.append((0, None))

    def node(self) -> int:
        return self.open[-1][1] if self.open else 0

    def nearest(self, tags: tuple) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def end(self, place: int) -> None:
        while len(self.open) > place:
            self.places[self.open.pop()[0]].pop()

    def end_nearest(self, tags: tuple, holders: tuple) -> None:
        place = self.nearest(tags)
        if place > self.nearest(holders):
            self.end(place)

    def meaning(self, tag: str, names: list[str], role: str, hidden: bool) -> int:
        above = self.says[self.node()]
        if above == EMPTY or tag in NO_TEXT or hidden:
            return EMPTY
        if above == GOES:
            return GOES
        if tag in ("article", "main"):
            return INSIDE
        if above == FORM or tag == "form":
            return FORM
        if tag in DROPPED or role in DROPPED_ROLES or (tag == "header" and above != INSIDE) or not DROPPED_NAMES.isdisjoint(names):
            return GOES
        return above

    def start_tag(self, tag: str, given: dict) -> None:
        if tag not in OF_HEAD:
            self.end_nearest(("head",), ())
        if tag in ("html", "body"):  # pages may leave them out
            return
        if tag in BLOCK:
            self.end_nearest(("button", "select"), ())  # no block is within these
        if tag in ENDS_P:
            self.end_nearest(("p",), HOLD_P)
        if tag in ENDED_BY:
            self.end_nearest(ENDED_BY[tag], HOLD)
        named = {k: unescaped(given[k]).strip().lower() for k in ("class", "id", "role") if k in given} if given else {}
        name = tag + "".join(f"[{k}={v}]" for k, v in named.items() if v)
        at = self.node()
        hidden = "hidden" in given or ("style" in given and NOT_SHOWN.search(unescaped(given["style"])) is not None)
        says = self.meaning(tag, [*named.get("class", "").split(), named.get("id", "")], named.get("role", ""), hidden)
        self.looks[at].append(name)
        if says != self.says[at] or (tag in BLOCK and tag not in VOID and (tag in HOLDERS or name != tag)):
            self.keys.append(digest(self.keys[at], name))
            self.above.append(at)
            self.says.append(says)
            self.looks.append([])
            at = len(self.keys) - 1
        if tag in BLOCK:
            self.border()
        elif tag == "br":
            self.data(" ")
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append((tag, at))

    def end_tag(self, tag: str) -> None:
        if tag in BLOCK:
            self.border()
        elif tag == "br":
            self.data(" ")
        self.end_nearest((tag,), ())

    def own_texts(self) -> dict[int, str]:
        """The text of each node that has any, without that of the nodes in it."""
        own: dict[int, list[str]] = {}
        for node, data in self.pieces:
            if data and not data.isspace():
                own.setdefault(node, []).append(" ".join(data.split()))
        return {node: "\n".join(texts) for node, texts in own.items()}

    def nodes(self) -> list[dict]:
        """The nodes, those of one key merged: key, digests of the run of children and of the own text, whether it is inside an article."""
        own = self.own_texts()
        merged: dict[int, tuple[list, list, bool]] = {}
        for i in range(1, len(self.keys)):
            if self.says[i] != EMPTY:
                run, texts, _ = merged.setdefault(self.keys[i], ([], [], self.says[i] == INSIDE))
                run += [x for j, x in enumerate(self.looks[i]) if not j or self.looks[i][j - 1] != x]
                if i in own:
                    texts.append(ALIKE.sub("#", own[i]))
        return [{"key": k, "look": digest(*run), "content": digest(*texts) if texts else None, "inside": inside} for k, (run, texts, inside) in merged.items()]

    def text(self, low: set, meanings: bool = True) -> str:
        return main_text(self.keys, self.above, self.says, *map(list, zip(*self.pieces, (0, None), strict=True)), low, meanings)


def main_text(keys: list, above: list, says: list, of: list, texts: list, low: set, meanings: bool = True) -> str:
    """The blocks outside the branches that have low nodes only, and outside what HTML says goes. of, texts: the pieces of a page."""
    n = len(keys)
    all_low = [key in low for key in keys]
    all_low[0] = False
    for i in range(n - 1, 0, -1):
        if not all_low[i]:
            all_low[above[i]] = False
    gone = [False] * n
    for i in range(1, n):
        gone[i] = all_low[i] or says[i] == EMPTY or (meanings and says[i] in (GOES, FORM))
        gone[i] |= gone[above[i]] and not (meanings and says[i] == INSIDE)
    blocks, now = [], []
    for node, data in zip([*of, 0], [*texts, None], strict=True):
        if data is None:
            if text := " ".join("".join(now).split()):
                blocks.append(text)
            now = []
        elif not gone[node]:
            now.append(data)
    return "\n\n".join(blocks)


#: What one parse of a page leaves: its nodes as the trees see them, and all that its main text is made of.
PARSED = "nodes array<struct<key:long,look:long,content:long,inside:boolean>>, keys array<long>, above array<int>, says array<tinyint>, of array<int>, texts array<string>"
SKELETON = ("keys", "above", "says", "of", "texts")


def parsed(htmls: list, meanings: bool = True) -> dict:
    """Columns PARSED of each page. With `meanings`, text that goes by what HTML says is left out of its pieces."""
    pages = list(map(Page, htmls))
    nodes = [p.nodes() for p in pages]
    if meanings:
        for p in pages:
            p.pieces = [piece for piece in p.pieces if p.says[piece[0]] not in (GOES, FORM)]
    node = pa.struct([("key", pa.int64()), ("look", pa.int64()), ("content", pa.int64()), ("inside", pa.bool_())])
    return {
        "nodes": pa.array(nodes, pa.list_(node)),
        "keys": pa.array([p.keys for p in pages], pa.list_(pa.int64())),
        "above": pa.array([p.above for p in pages], pa.list_(pa.int32())),
        "says": pa.array([p.says for p in pages], pa.list_(pa.int8())),
        "of": pa.array([[node for node, _ in p.pieces] for p in pages], pa.list_(pa.int32())),
        "texts": pa.array([[text for _, text in p.pieces] for p in pages], pa.list_(pa.string())),
    }


def page_nodes(pages: DataFrame) -> DataFrame:
    """(site, page, key, look, content, inside) of every node of every distinct page of a host and of its domain. pages: host, page, nodes."""
    sites = F.array_distinct(F.array("host", F.substring_index("host", ".", -2)))
    return pages.select("page", F.explode(sites).alias("site"), "nodes").select("site", "page", F.explode("nodes").alias("n")).select("site", "page", "n.*").distinct()


def style_tree(found: DataFrame) -> DataFrame:
    """(site, key, inside, pages, importance) of each node of each site's style tree. found: a table of page_nodes()."""
    m = F.log(F.col("pages").cast("double"))
    looks = found.groupBy("site", "key", "look").agg(F.count("*").alias("c"), F.max("inside").alias("inside")).groupBy("site", "key")
    looks = looks.agg(F.sum("c").alias("pages"), F.max("inside").alias("inside"), F.sum(F.col("c") * F.log(F.col("c").cast("double"))).alias("s"))
    # -sum c/m log(c/m) = log m - sum c log c / m
    presentation = F.when(F.col("pages") > 1, 1 - F.col("s") / F.col("pages") / m).otherwise(1.0)
    texts = found.where("content is not null").groupBy("site", "key", "content").agg(F.count("*").alias("c"))
    texts = texts.groupBy("site", "key").agg(F.avg(F.log(F.col("c").cast("double"))).alias("shared"))
    content = F.when(F.col("shared").isNull(), 0.0).when(F.col("pages") > 1, 1 - F.col("shared") / m).otherwise(1.0)
    both = looks.join(texts, ["site", "key"], "left")
    return both.select("site", "key", "inside", "pages", (1 - (1 - presentation) * (1 - content)).alias("importance"))


def low_nodes(tree: DataFrame, meanings: bool = True) -> DataFrame:
    """(site, key) of the nodes whose importance is low, as far as the pages seen can tell."""
    inside = F.col("inside") if meanings else F.lit(False)
    prior = F.when(inside, PRIOR_INSIDE).otherwise(PRIOR)
    drawn = ((F.col("pages") - 1) * F.col("importance") + prior) / (F.col("pages") - 1 + prior)
    return tree.where(drawn < F.when(inside, LOW_INSIDE).otherwise(LOW)).select("site", "key")


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


@owned
def extracted(pages: DataFrame, meanings: bool = True, trees: bool = True, most_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """`pages` without html and with text, the main text, and n_chars, its code points.

    pages: url, html and any other columns; those of the names made are replaced. A null or empty html gives an empty text.
    A null url is of the empty host; urls and pages are taken whole, however long or deep. Equal pages of a host count as one
    for its tree, and give the same text. Of a repeated attribute the first counts; nodes of equal importance are judged
    alike. An empty table stays empty. More than `most_broadcast` low nodes are not broadcast but joined, to the same result. With meanings=False only the tree decides, but for what never is text; with
    trees=False only what HTML says.
    """
    pages, rest = apart(pages, "url", "html")
    hosted = pages.withColumn("host", host_of(F.col("url"))).withColumn("page", F.xxhash64("host", "html"))
    # each page is parsed once
    found = written(over_texts(hosted, "html", lambda htmls: parsed(htmls, meanings), PARSED), kept=True)
    kept = ["url", "carried"]
    joined = found.select(*kept, "host", F.array().cast("array<long>").alias("low"), *SKELETON)
    lows: dict[str, frozenset] = {}
    if trees:
        of_pages = written(page_nodes(found))
        low = written(low_nodes(style_tree(of_pages), meanings))
        if low.count() <= most_broadcast:
            for row in low.groupBy("site").agg(F.collect_set("key").alias("keys")).collect():
                lows[row.site] = frozenset(row["keys"])
        else:
            low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            # a page's own low nodes: no more than it has; a large site's nodes go to several tasks
            salted = of_pages.select("site", "page", "key").withColumn("salt", F.pmod("page", F.lit(SALTS)).cast("int"))
            low = written(salted.join(low.hint("merge"), ["site", "key", "salt"]).groupBy("page").agg(F.collect_set("key").alias("low")), kept=True)
            joined = found.join(low.hint("merge"), "page", "left").select(*kept, "host", "low", *SKELETON)
    sent = pages.sparkSession.sparkContext.broadcast(lows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_site, none = sent.value, frozenset()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                text = []
                for host, low, *skeleton in zip(*(part.column(c).to_pylist() for c in ("host", "low", *SKELETON)), strict=True):
                    of_its_host, of_domain = of_site.get(host, none), of_site.get(".".join(host.split(".")[-2:]), none)
                    text.append(main_text(*skeleton, {k for k in skeleton[0] if k in of_its_host or k in of_domain}.union(low or ()), meanings))
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in kept} | {"text": pa.array(text, pa.string())})

    made = joined.mapInArrow(run, with_fields(joined, kept, "text string")).withColumn("n_chars", F.length("text").cast("long"))
    return together(made, rest, "url", "text", "n_chars")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 5."""
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
