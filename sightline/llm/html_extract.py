"""Main text of web pages by a site style tree.

Pages of one host are merged into a tree of styles: a node is a path of element
names with class and id words (digits dropped); of parts alike under one parent, as divs
without names, it is the place among them. For each page and path the
presentation (its sequence of child elements) and the content (its text, that
of inline elements included) are hashed. Over a host's m pages, a node's
importance is the larger of the two entropies, to base m: near 0 where all pages
show the same there, near 1 where each differs; a node on fewer than `min_pages`
pages counts as important. From each page, branches are removed of which every
node, the top one and all below, is unimportant on its site, or whose role
is that of a menu, header, footer, side bar, notice, advert, form, or reader
comments. Roles are told by the element, the ARIA role and whole class names; a
name of several words (related-posts, article-share) tells one only if the others
merely place it or say whose it is. An id does so outside articles and not on a section, as ids are made from
titles, too. Headings, paragraphs and what is in them have no role by name. What
names leave open is decided by importance. The same holds inside the article
a page marks as such; but the article itself is no such branch, and one that is
repeated whole is still the page's text. Of several articles all count but those
marked as teasers or comments, by their own name or that of a part they are in; what stands
beside them in the page's main part counts too, unless it is a list of links or its site repeats it.
A form that holds an article or most of the page's prose, and a part named like a side bar
that holds nearly all of it, only wrap the page and have no role.

Entropies need only sums, so counts combine before each shuffle and a host with
a third of all pages costs no single task. Unimportant paths go to all tasks only if
they are few (BROADCAST_ROWS); else pages are dealt by host and salt, and the host's
paths, one row each, stream ahead of its pages.

Defined cases: null or empty HTML gives an empty text; a null URL is a host of
its own; unclosed elements, comments and quotes are closed as browsers do;
repeated rows give repeated results; an empty table gives an empty result; texts
of any length are whole, and are read in time proportional to their length; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

BROADCAST_ROWS, SALTS = 100_000, 32

START = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
CLOSES_P = BLOCK - {"br", "body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"ul", "ol", "dl", "table", "select", "menu"}
DROPPED = set("head nav aside form script style noscript template iframe svg canvas button select textarea dialog menu object audio video map input title footer".split())
# Words in names (class, role, id) that name other parts of a page than its article.
ROLE_WORDS = set("nav navbar navigation menu footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist respond replies disqus share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager widget toolbar copyright masthead complementary contentinfo search searchform".split())
HEAD_WORDS = {"header", "topbar", "masthead"}
CONTENT_WORDS = set("content main article post entry story text page wrapper container layout body".split())
#: Those of them that a part's name may hold without making it the content: post-share, article-related, main-nav.
OWNER_WORDS = set("content main article post entry story text".split())
#: Words that may stand beside those in a name without changing what it tells.
PLACE_WORDS = set("site global top bottom left right upper lower inner outer primary secondary list lists item items box bar area block section group wrap wrapper container panel links link buttons button icons posts articles stories form strip unit slot wp js".split())
#: Words that tell a role even beside a word for the content: post-comments, page-footer.
STRONG_WORDS = set("comment comments sidebar footer".split())
#: Elements that hold text of their own; a name on one is about its text.
PROSE = set("h1 h2 h3 h4 h5 h6 p pre blockquote dt caption figcaption summary".split())
TEASER_WORDS = set("teaser teasers card cards preview previews".split())
LANDMARKS = {"article", "main"}
#: Containers, which are told apart by their places; items of lists and tables and paragraphs are not.
PLACED = BLOCK - PROSE - set("li dd dt tr td th br hr html body hgroup".split())
#: What is no text of the page, whatever it holds.
UNSEEN = set("head script style noscript template iframe svg canvas select textarea title object audio video map".split())
#: Words for what readers write; the last ones tell so beside a word for readers only.
READER_WORDS, TALK_WORDS = set("user users reader readers visitor visitors community".split()), set("discussion discussions discuss reactions opinions".split())


class Node:
    __slots__ = ("tag", "words", "names", "ident", "hidden", "parts", "parent", "path", "inside", "prose", "size", "linked", "told", "landmark", "wraps", "alike")

    def __init__(self, tag: str, words: frozenset, names: tuple, ident: str, hidden: bool, parent):
        self.tag, self.words, self.names, self.ident, self.hidden, self.parent = tag, words, names, ident, hidden, parent
        self.parts: list = []  # nodes and texts, in page order
        self.prose = tag in PROSE or tag not in BLOCK and parent is not None and parent.prose
        self.inside = parent is not None and (parent.inside or parent.tag == "article")
        self.size = self.linked = self.told = 0  # characters of text, of that in links, of prose that isn't
        self.landmark = self.wraps = False
        self.alike: dict[str, int] | None = None
        key = tag + "".join(sorted("." + w for w in words))
        if parent is not None and tag in PLACED:
            if parent.alike is None:
                parent.alike = {}
            place = parent.alike[key] = parent.alike.get(key, -1) + 1
            key += f"#{place}" if place else ""
        self.path = xxhash.xxh64_intdigest(key, parent.path if parent else 0)


def _split(name: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]


NOTHING = (frozenset(), (), "", False)


def _words(attributes: str) -> tuple[frozenset, tuple, str, bool]:
    """Words of class, id and role; names in class and role; id; whether hidden."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return NOTHING
    found, names, ident = set(), (), ""
    hidden = "hidden" in ATTRIBUTE.sub(" ", attributes).lower().replace("/", " ").split()  # without a value
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id", "role"):
            found.update(_split(value))
            if name == "id":
                ident = value
            else:
                names += tuple(value.split())
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return frozenset(found), names, ident, hidden


def _tag_end(page: str, place: int, strict: bool) -> tuple[int, bool]:
    """Where the tag ends whose name ends at `place`, or -1; with strict=False at the first >, be it in quotes or not.

    The second value is whether quotes still count: once one is never closed, they don't, so a page is gone through
    to its end for that but once."""
    if strict:
        at = place
        while (m := STOP.search(page, at)) is not None:
            if m[0] == ">":
                return m.start(), True
            at = page.find(m[0], m.end()) + 1
            if not at:
                break
    return page.find(">", place), False


def parse(page: str) -> Node:
    """The page's tree, measured; never fails."""
    root = Node("#root", frozenset(), (), "", False, None)
    stack, where = [root], {"#root": [0]}  # open nodes, and by name the depths of those open
    place, n, strict = 0, len(page), True

    def close(names, limits) -> None:
        """Closes the nearest open node of these names, unless one of the limits is nearer."""
        depth = max((where[t][-1] for t in names if where.get(t)), default=0)
        if depth and depth >= max((where[t][-1] for t in limits if where.get(t)), default=0):
            while len(stack) > depth:
                where[stack.pop().tag].pop()

    while place < n:
        m = START.search(page, place)
        if m is None:
            stack[-1].parts.append(page[place:])
            break
        if m.start() > place:
            stack[-1].parts.append(page[place : m.start()])
        if m[2] is None:
            end = page.find("-->" if m[0] == "<!--" else ">", m.start() + 2)
            place = n if end < 0 else end + (3 if m[0] == "<!--" else 1)
            continue
        end, strict = _tag_end(page, m.end(), strict)
        if end < 0:  # no > is left: the rest is text
            stack[-1].parts.append(page[m.start() :])
            break
        attributes, place = page[m.end() : end], end + 1
        tag = m[2].lower()
        if m[1]:
            close((tag,), LIMITS - {tag} if tag in ("p", "li") else ())
            continue
        if tag in CLOSES_P:
            close(("p",), ("table", "td", "th", "button", "article", "section", "div", "li", "body"))
        if tag in CLOSED_BY:
            close(CLOSED_BY[tag], LIMITS)
        node = Node(tag, *_words(attributes), stack[-1])
        stack[-1].parts.append(node)
        if tag in RAW:
            over = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, place)
            close_at = page.find(">", over.start()) if over else -1
            place = close_at + 1 if close_at >= 0 else n
        elif tag not in VOID and not attributes.endswith("/"):
            where.setdefault(tag, []).append(len(stack))
            stack.append(node)
    _measure(root)
    return root


def _measure(root: Node) -> None:
    """Sizes of all branches, and which of them only wrap the page."""
    nodes = list(_walk(root))
    for x in reversed(nodes):
        if x.tag in UNSEEN or x.hidden:
            continue
        own = sum(len(p) - p.count(" ") - p.count("\n") for p in x.parts if isinstance(p, str))
        x.size += own
        x.told += own if x.prose and x.tag != "a" else 0
        if x.tag == "a":
            x.linked, x.told = x.size, 0
        x.landmark |= x.tag in LANDMARKS
        if x.parent is not None:
            x.parent.size += x.size
            x.parent.linked += x.linked
            x.parent.told += x.told
            x.parent.landmark |= x.landmark
    for x in nodes:
        if x.tag == "form":
            x.wraps = x.landmark or 2 * x.told > root.told > 0
        elif x.tag in ("div", "section", "table", "tbody", "tr", "td", "span", "center"):
            x.wraps = 10 * x.told >= 9 * root.told > 0 and not any(_about_readers(n) for n in (*x.names, x.ident))


def _walk(node: Node):
    """Nodes below, in page order, without recursion."""
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(p for p in reversed(x.parts) if isinstance(p, Node))


def text_of(node: Node, dropped=lambda x: False) -> str:
    """Text of a branch: blocks joined by one space, character references decoded."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not dropped(x):
            if x.tag in BLOCK:
                out.append(" ")
                todo.append(" ")
            todo.extend(reversed(x.parts))
    return " ".join(html.unescape("".join(out)).split())


@lru_cache(100_000)
def _told(name: str) -> str:
    """What a whole name tells: "strong", "role" or "head" (another part of the page), "content", or "" (nothing)."""
    words = set(_split(name))
    if words & TALK_WORDS and words & READER_WORDS:
        return "strong"
    for kind, telling, beside in (("content", CONTENT_WORDS, PLACE_WORDS), ("strong", STRONG_WORDS, ROLE_WORDS | CONTENT_WORDS | PLACE_WORDS), ("role", ROLE_WORDS, PLACE_WORDS | OWNER_WORDS), ("head", HEAD_WORDS, PLACE_WORDS)):
        if words & telling and words <= telling | beside:
            return kind
    return ""


def _about_readers(name: str) -> bool:
    """Whether a name is that of comments."""
    words = set(_split(name))
    return bool(words & {"comment", "comments", "commentlist", "respond", "replies", "disqus"} or words & TALK_WORDS and words & READER_WORDS)


def _role_drops(node: Node, inside: bool) -> bool:
    """Whether the node's role is that of another part than the article."""
    if node.hidden:
        return True
    if node.wraps:
        return False
    if node.tag in DROPPED:
        return not (node.tag == "footer" and node.parent is not None and node.parent.tag == "blockquote")
    if node.tag == "header" and not inside:
        return True
    if node.tag in ("html", "body", "#root") or node.prose:
        return False
    told = {_told(n) for n in node.names}
    if not inside and node.tag != "section" and node.ident:
        told.add(_told(node.ident))
    if node.tag in LANDMARKS:
        return any(_told(n) == "strong" and _about_readers(n) for n in node.names)
    if "strong" in told:
        return True
    return "content" not in told and ("role" in told or not inside and "head" in told)


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def _styled(node: Node) -> bool:
    """Whether the node is one of the style tree; texts of others belong to the one they are in."""
    return node.tag in BLOCK and node.tag != "br"


def style_nodes(page: str) -> list[tuple[int, int, int]]:
    """(path, presentation, content) of each path on the page."""
    shown: dict[int, list] = {}
    said_in: dict[int, object] = {}
    for x in _walk(parse(page)):
        if _styled(x):
            look, said = shown.setdefault(x.path, [xxhash.xxh64(), xxhash.xxh64()])
            look.update(" ".join(p.tag for p in x.parts if isinstance(p, Node)) + ";")
        else:
            said = None if x.parent is None or _role_drops(x, x.inside) else said_in[id(x.parent)]
        said_in[id(x)] = said
        if said is not None:
            for p in x.parts:
                if isinstance(p, str):
                    said.update(p)
    return [(_signed(path), _signed(look.intdigest()), _signed(said.intdigest())) for path, (look, said) in shown.items()]


def _noise(root: Node, unimportant: frozenset) -> set[int]:
    """Ids of the nodes that are unimportant with all below them; parts that go by their role have no say."""
    quiet: set[int] = set()
    for x in reversed(list(_walk(root)) if unimportant else []):
        own = not _styled(x) or _signed(x.path) in unimportant
        if own and all(id(p) in quiet for p in x.parts if isinstance(p, Node)) or _role_drops(x, x.inside):
            quiet.add(id(x))
    return quiet


def main_text(page: str | None, unimportant: frozenset = frozenset()) -> str:
    """The page's main text, given the paths (signed) that its site repeats."""
    if not page:
        return ""
    root = parse(page)
    outside = lambda x: _role_drops(x, False)
    inside = lambda x: _role_drops(x, True)
    articles, teasers, todo = [], [], [(root, False, None)]
    mains = []
    while todo:
        x, marked, in_main = todo.pop()
        if outside(x):
            # a wrapper named like a menu or side bar still holds the article, if there is none elsewhere
            if x.tag in DROPPED or x.hidden or not x.landmark:
                continue
            marked = True
        if x.tag == "article":
            (teasers if marked or _teaser(x) else articles).append((x, in_main))
            continue
        if in_main is None and (x.tag == "main" or "main" in x.words and x.tag in ("div", "section")):
            mains.append(x)
            in_main = x
        todo.extend((p, marked, in_main) for p in reversed(x.parts) if isinstance(p, Node))
    quiet = _noise(root, unimportant)
    for found in (articles, teasers):
        own = {id(a) for a, _ in found}
        for drops in (lambda x: inside(x) or _styled(x) and id(x) in quiet, inside):  # an article that a site repeats whole is still one
            texts, done = [], set()
            for a, main in found:
                if main is None or main.tag != "main" or found is teasers:
                    texts.append(text_of(a, lambda x, a=a, drops=drops: inside(x) if x is a else drops(x)))
                elif id(main) not in done:  # with what stands beside the article
                    done.add(id(main))
                    beside = lambda x, own=own, main=main, drops=drops: x is not main and (
                        inside(x) if id(x) in own else x.tag == "article" and not x.inside or (drops(x) if x.inside else outside(x) or _styled(x) and id(x) in quiet or _link_list(x)))
                    texts.append(text_of(main, beside))
            if texts := [t for t in texts if t]:
                return " ".join(texts)
    noise = lambda x: outside(x) or _styled(x) and id(x) in quiet and x.tag not in ("html", "body")
    if texts := [t for x in mains if (t := text_of(x, lambda y, x=x: y is not x and noise(y)))]:
        return " ".join(texts)
    return text_of(root, lambda y: noise(y) or _link_list(y))


def _teaser(article: Node) -> bool:
    """Whether an article's names say that it points to another one."""
    told = [set(_split(n)) for n in article.names]
    return any(w & TEASER_WORDS and w <= TEASER_WORDS | PLACE_WORDS | CONTENT_WORDS for w in told) or any(_told(n) in ("role", "strong") for n in article.names)


def _link_list(node: Node) -> bool:
    """Whether most of a list's or table's text is inside links."""
    return node.tag in ("ul", "ol", "table", "dl") and node.linked > 0 and 2 * node.linked >= node.size


def _host():
    return F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def unimportant_paths(pages: DataFrame, threshold: float = 0.2, min_pages: int = 5) -> DataFrame:
    """(host, path): those of the hosts' site style trees whose importance is low."""

    def nodes(batches):
        for batch in batches:
            counts = Counter()
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for path, look, said in style_nodes(page or ""):
                    counts[host, path, 0, look] += 1
                    counts[host, path, 1, said] += 1
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[i] for k in keys], t) for i, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int64()))), pa.array(list(counts.values()), pa.int64())],
                names=["host", "path", "kind", "shown", "n"])

    rows = pages.select(_host().alias("host"), "html").mapInArrow(nodes, "host string, path long, kind int, shown long, n long")
    alike = rows.groupBy("host", "path", "kind", "shown").agg(F.sum("n").alias("n"))
    summed = alike.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = (F.log("m") - F.col("s") / F.col("m")) / F.log("m")
    known = summed.where(F.col("m") >= min_pages).withColumn("entropy", entropy)
    return known.groupBy("host", "path").agg(F.max("entropy").alias("importance")).where(F.col("importance") < threshold).select("host", "path")


def extract(pages: DataFrame, threshold: float = 0.2, min_pages: int = 5) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    low = written(unimportant_paths(pages, threshold, min_pages), "style-tree")
    rows = pages.select(_host().alias("host"), "page_id", "url", "html")
    few = low.limit(BROADCAST_ROWS + 1).collect()
    sites: dict[str, frozenset] = {}
    if len(few) <= BROADCAST_ROWS:
        paths: dict[str, set] = {}
        for r in few:
            paths.setdefault(r.host, set()).add(r.path)
        sites = {host: frozenset(own) for host, own in paths.items()}
        dealt = rows.withColumn("path", F.lit(None).cast("long"))
    else:
        none = [F.lit(None).cast(pages.schema[c].dataType).alias(c) for c in ("page_id", "url", "html")]
        ahead = low.select("host", *none, "path").withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        behind = rows.withColumns({"path": F.lit(None).cast("long"), "_salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")})
        dealt = ahead.unionByName(behind).repartition("host", "_salt").sortWithinPartitions("host", "_salt", F.col("path").asc_nulls_last()).drop("_salt")
    streamed = len(few) > BROADCAST_ROWS

    def read(batches):
        site, met, quiet = None, [], frozenset()
        for batch in batches:
            keep, out = [], []
            for i, (host, page, path) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("host", "html", "path")), strict=True)):
                if path is not None:
                    if host != site or quiet is not None:
                        site, met, quiet = host, [], None
                    met.append(path)
                    continue
                if streamed and (quiet is None or host != site):
                    quiet, met = frozenset(met) if host == site else frozenset(), []
                    site = host
                keep.append(i)
                out.append(main_text(page, quiet if streamed else sites.get(host, frozenset())))
            own = batch.select(["page_id", "url"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return dealt.select("host", "page_id", "url", "html", "path").mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: For pages whose article is marked and holds only h1, p, b and br: its text in SQL.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS h FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(?:p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') AS h FROM a),
c AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(replace(h, '&quot;', '"'), '&amp;?', '&', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g') AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c
"""
