"""HTML extraction by wrapper induction.

Every page becomes a tree in which siblings of one label (tag, classes, id) are one repeating node. The commonest tree
of a host is its template. Each page is aligned with the template of its host by simple tree matching (Yang, 1991):
the largest order-preserving match, so a node that stands elsewhere than in the template is a slot of its own. Over
all pages of the host, Spark counts per slot on how many pages it occurs and whether the text under it varies.
A slot whose text never varies is template and goes; varying slots are content. Text is taken by aligning each
page again and asking its slots.

Varying boxes that are no main text (reader comments, adverts, menus) cannot be told by variation; they are ruled out by
element (nav, aside, footer, ...) or by a class, id or role all of whose words speak of such boxes ("ad-slot" does,
"social-history" does not). A form or such a word rules nothing out that holds an article or main element. A page that has
article or main elements is read inside them only; there a constant slot goes only if it is a box of its own, not
a paragraph, heading, list, table or inline element.

Slots are known by chained 64-bit hashes of labels, so depth costs nothing. A slot is template if it stands on three
distinct pages at least and on a fiftieth of the host's pages, which bounds the decisions sent back per host,
whatever its classes and ids are. On hosts of fewer distinct pages, marks alone decide.

Defined results: null or empty html, and pages without content, give an empty text; pages without a host share the
empty host; unclosed tags end where HTML ends them or with the page; repeated pages give repeated rows and count as one
distinct page; extra columns are ignored; an empty table gives an empty table. Nothing is cut.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .url_filter import host_and_path

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html caption dd dt legend li option summary tbody td tfoot th thead tr".split())
#: Start tags that end an open element of these kinds, and the elements that such an end does not leave.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"})}
#: Elements that are never main text; of these, a form may hold a page.
NOT_TEXT = frozenset("head script style noscript template iframe object svg canvas nav footer aside form button select input textarea dialog menu title audio video".split())
#: Words of classes, ids and roles that speak of such boxes, and words that say nothing beside them.
NOT_TEXT_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup sidebar aside menu menubar nav navbar navigation breadcrumb breadcrumbs masthead header footer comment comments reply replies respond disqus "
    "share sharing social related recommended widget toolbar pagination pager search contentinfo complementary".split()
)
LAYOUT_WORDS = frozenset(
    "article articles bar block blog bottom box btn button buttons col column container entry field fixed form global group holder icon icons in inner item items js left link links list "
    "mobile my outer page panel post posts primary region right row secondary section site slot small sticky text the title to top unit wrap wrapper area".split()
)
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th figure figcaption b i em strong a span code br hr img".split())
MAIN = frozenset({"article", "main"})
#: Words that say what a box is whatever else its name says: comments, other stories, adverts, notices. Articles inside do not make it text;
#: only a main element does. With a word of STATE_WORDS a name tells of the page, not of a box.
OTHER_WORDS = frozenset("advert advertisement advertisements advertising adverts ads adsense alert comment commenter commentlist comments consent cookie cookies disqus newsletter promo promoted recommended related replies respond sponsor sponsored sponsors".split())
STATE_WORDS = frozenset("closed count disabled enabled has no off on open status with without".split())
#: Distinct pages of a host that must hold a slot for it to be template, and the part of its pages.
PAGES, PART = 3, 0.02
#: Blocks of text that make a body of a marked box, if nothing else on the page has text.
BODY_BLOCKS = 3
#: Hosts whose templates are broadcast at most, within the byte bound of ``bounded``; more are joined by a shuffle.
HOSTS = 50_000
#: What a task remembers (counted slots, aligned nodes) before it passes on or forgets it; results do not depend on it.
HELD = 200_000

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</[^>]*>", re.S)
_NAMED = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_DIGITS, _PARTS, _HUMP = re.compile(r"\d+"), re.compile(r"[^a-z]+"), re.compile(r"(?<=[a-z])(?=[A-Z])")
_QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s=/])", re.I)
_UNSEEN = re.compile(r"(?:^|\s)style\s*=\s*(?:\"[^\"]*|'[^']*|[^\s>]*)(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
#: No mark; by a word, which a body of text inside lifts; for good; by a word of OTHER_WORDS.
_FREE, _SOFT, _HARD, _OTHER = 0, 1, 2, 3


class Node:
    """A collapsed element: label, children by label in order, its own mark, whether it lies in a main element."""

    __slots__ = ("label", "tag", "parent", "children", "mark", "inner", "main", "marked", "key")

    def __init__(self, label: str, tag: str, parent: Node | None, mark: int, main: bool):
        self.label, self.tag, self.parent, self.children, self.mark = label, tag, parent, {}, mark
        self.inner = main or (parent is not None and parent.inner)
        self.main, self.marked, self.key = main, False, 0


def _speaks_of_other_boxes(name: str, inner: bool) -> bool:
    words = [w for w in _PARTS.split(_HUMP.sub("-", name).lower()) if w]
    said = [w for w in words if w in NOT_TEXT_WORDS and not (inner and w == "header")]
    return bool(said) and all(w in LAYOUT_WORDS or w in NOT_TEXT_WORDS for w in words)


def _names_another_box(name: str) -> bool:
    words = {w for w in _PARTS.split(_HUMP.sub("-", name).lower()) if w}
    return bool(words & OTHER_WORDS) and not words & STATE_WORDS


def _label(tag: str, attributes: str, inner: bool) -> tuple[str, int, bool]:
    """tag.class#id with numbers made alike, its mark, and whether it is a main element."""
    mark = _HARD if tag in NOT_TEXT else _FREE
    mark = _SOFT if tag == "form" else _HARD if tag == "header" and not inner else mark
    label, main = tag, tag in MAIN
    if not attributes or tag in ("html", "body"):
        return label, mark, main
    if _HIDDEN.search(_QUOTED.sub("=", attributes)) or _UNSEEN.search(attributes):
        mark = _HARD
    for name, value in _NAMED.findall(attributes):
        value = value.strip("\"'")
        name = name.lower()
        main = main or (name == "role" and value.strip().lower() in MAIN)
        label += {"class": ".", "id": "#", "role": "@"}[name] + ".".join(sorted(_DIGITS.sub("0", value.lower()).split()))
        # the page's own article is text whatever its names; one inside it may be a comment or another story
        if mark in (_FREE, _SOFT) and (tag == "article" and inner or not main) and any(map(_names_another_box, value.split())):
            mark = _OTHER
        if mark == _FREE and not main and any(_speaks_of_other_boxes(own, inner) for own in value.split()):
            mark = _SOFT
    return label, mark, main


def parse(source: str, texts: bool = True) -> tuple[Node, list[tuple[Node, str]]]:
    """The collapsed tree, and the blocks of text in page order with the node each begins in."""
    root = Node("", "", None, _FREE, False)
    stack, blocks, chunks, owner, labels, open_ = [root], [], [], None, {}, {}
    lower = None

    def flush() -> None:
        nonlocal chunks, owner
        if chunks:
            text = " ".join(entities.unescape("".join(chunks)).split())
            if text:
                blocks.append((owner, text))
        chunks, owner = [], None

    def text(data: str) -> None:
        nonlocal owner
        if texts:
            if owner is None and not data.isspace():
                owner = stack[-1]
            chunks.append(data)

    def leave(depth: int) -> None:
        for node in stack[depth:]:
            open_[node.tag] -= 1
            if node.mark:
                flush()
        del stack[depth:]

    at, end = 0, len(source)
    while at < end:
        found = _MARKUP.search(source, at)
        if not found:
            rest = source[at:]
            cut = rest.rfind("<")
            if cut >= 0 and re.match(r"</?[a-zA-Z!]", rest[cut:]):
                rest = rest[:cut]
            if rest:
                text(rest)
            break
        if found.start() > at:
            text(source[at : found.start()])
        at = found.end()
        tag = found[2] or found[5]
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        if found[1] or found[4]:
            if open_.get(tag):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        leave(depth)
                        break
                    # the end of an inline element does not end a block
                    if tag not in BLOCK and stack[depth].tag in BLOCK:
                        break
            continue
        if tag == "br":
            chunks.append(" ")
        if tag in CLOSES_P:
            if open_.get("p"):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == "p":
                        leave(depth)
                        break
                    if stack[depth].tag in BLOCK:
                        break
        elif tag in ENDS:
            kinds, walls = ENDS[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in walls:
                    break
                if stack[depth].tag in kinds:
                    leave(depth)
                    if tag != "tr" or stack[-1].tag not in kinds:
                        break
        parent = stack[-1]
        attributes = found[3] or found[6] or ""
        key = (tag, attributes, parent.inner)
        if key not in labels:
            labels[key] = _label(*key)
        label, mark, main = labels[key]
        node = parent.children.get(label)
        if node is None:
            node = parent.children[label] = Node(label, tag, parent, mark, main)
        if mark:
            flush()
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            if lower is None:
                lower = source.lower()
            stop = lower.find("</" + tag, at)
            at = end if stop < 0 else (lower.find(">", stop) + 1 or end)
            continue
        stack.append(node)
        open_[tag] = open_.get(tag, 0) + 1
    flush()
    return root, blocks


def preorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.children.values()))
    return out


def shape(nodes: list[Node]) -> str:
    """The tree in preorder: the number of children and the label of each node."""
    return "\n".join(f"{len(n.children)} {n.label}" for n in nodes)


def tree_of(shape_: str) -> Node:
    """The tree that a shape stands for."""
    root, open_ = None, []
    for line in shape_.split("\n"):
        children, _, label = line.partition(" ")
        node = Node(label, "", open_[-1][0] if open_ else None, _FREE, False)
        if open_:
            open_[-1][0].children[label] = node
            open_[-1][1] -= 1
        else:
            root = node
        open_.append([node, int(children)])
        while open_ and not open_[-1][1]:
            open_.pop()
    return root


# ------------------------------------------------------------------- alignment


def heaviest_ascent(places: list[int], gains: list[int]) -> list[int]:
    """Positions of the ascending subsequence of places with the largest sum of gains."""
    if all(a < b for a, b in zip(places, places[1:], strict=False)):
        return list(range(len(places)))
    size = max(places) + 2
    # a binary indexed tree of (sum, last position) for ascents that end up to a place
    best: list[tuple[int, int]] = [(0, -1)] * (size + 1)
    before = []
    for i, (place, gain) in enumerate(zip(places, gains, strict=True)):
        top, k = (0, -1), place
        while k > 0:
            top = max(top, best[k])
            k -= k & -k
        before.append(top[1])
        made, k = (top[0] + gain, i), place + 1
        while k <= size:
            best[k] = max(best[k], made)
            k += k & -k
    top, k = (0, -1), size
    while k > 0:
        top = max(top, best[k])
        k -= k & -k
    out, i = [], top[1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def simple_tree_match(template: Node, page: Node) -> list[tuple[Node, Node]]:
    """The largest order-preserving match of two trees whose roots match: pairs of nodes, parents first.

    Siblings have distinct labels, so only nodes of one label path can match, and the match of two nodes is the
    heaviest ascent of their common children.
    """
    pairs, below = [(template, page)], []
    for t, p in pairs:
        places = {label: i for i, label in enumerate(t.children)} if p.children else {}
        common_ = [label for label in p.children if label in places]
        below.append((len(pairs), [places[label] for label in common_]))
        pairs.extend((t.children[label], p.children[label]) for label in common_)
    gain, chosen = [1] * len(pairs), [[]] * len(pairs)
    for i in range(len(pairs) - 1, -1, -1):
        first, places = below[i]
        if places:
            chosen[i] = [first + k for k in heaviest_ascent(places, gain[first : first + len(places)])]
            gain[i] += sum(gain[k] for k in chosen[i])
    out, at = [0], 0
    while at < len(out):
        out.extend(chosen[out[at]])
        at += 1
    return [pairs[i] for i in out]


def _chain(above: int, label: str, matched: bool) -> int:
    data = above.to_bytes(8, "little", signed=True) + (b"=" if matched else b"~") + label.encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


class Aligner:
    """Slots of pages under the templates of their hosts; pages of one host and shape share an alignment."""

    def __init__(self):
        self.trees: dict[str, Node] = {}
        self.known: dict[tuple[str, str], list[int]] = {}
        self.held = 0

    def __call__(self, nodes: list[Node], template: str | None) -> None:
        """Sets the slot key of every node (preorder) of a page; the root has key 0."""
        form = shape(nodes)
        keys = self.known.get((template or "", form))
        if keys is None:
            if self.held > HELD:
                self.trees, self.known, self.held = {}, {}, 0
            if template and template not in self.trees:
                self.trees[template] = tree_of(template)
                self.held += template.count("\n")
            pairs = simple_tree_match(self.trees[template], nodes[0]) if template else []
            matched = {id(p) for _, p in pairs}
            for node in nodes[1:]:
                node.key = _chain(node.parent.key, node.label, id(node) in matched)
            keys = [node.key for node in nodes]
            self.known[template or "", form] = keys
            self.held += len(keys)
        for node, key in zip(nodes, keys, strict=True):
            node.key = key


def _unpacked(packed: bytes | None) -> str | None:
    return None if packed is None else zlib.decompress(packed).decode("utf-8", "surrogatepass")


# ------------------------------------------------------------------- induction


def _code(data: str) -> int:
    return int.from_bytes(hashlib.blake2b(data.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shapes of a host's pages, and the pages of each, for the rows of one task."""
    seen: dict[tuple[str, int], list] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        if seen:
            rows = [(h, c, *v) for (h, c), v in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["host", "code", "pages", "shape"])

    for batch in batches:
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            form = shape(preorder(parse(source or "", texts=False)[0]))
            key = (host, _code(form))
            if key not in seen:
                packed = zlib.compress(form.encode("utf-8", "surrogatepass"), 6)
                seen[key] = [0, packed]
                held += len(packed) + 100
            seen[key][0] += 1
            if held > 20 * HELD:
                yield from out()
                seen, held = {}, 0
    yield from out()


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and slot that has text under it: pages, bits of distinct pages, least and greatest hash of the text."""
    aligner, stats = Aligner(), {}
    names = ["host", "slot", "pages", "bits", "low", "high"]

    def out() -> Iterator[pa.RecordBatch]:
        if stats:
            rows = [(h, k, *v) for (h, k), v in stats.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.string()] + [pa.int64()] * 5, strict=True)], names=names)

    for batch in batches:
        templates = [_unpacked(t) for t in batch.column("template").to_pylist()]
        for host, source, template in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), templates, strict=True):
            if template is None:
                continue
            root, blocks = parse(source or "")
            nodes = preorder(root)
            aligner(nodes, template)
            under: dict[int, int] = {}
            for node, text in blocks:
                under[id(node)] = (under.get(id(node), 1) * 0x9E3779B97F4A7C15 + _code(text)) & (2**64 - 1)
            # children come after their parents: sums from the end
            for node in reversed(nodes):
                own = under.get(id(node))
                if own is not None and node.parent is not None:
                    above = id(node.parent)
                    under[above] = (under.get(above, 1) * 0xD1B54A32D192ED03 + (own ^ node.key & (2**64 - 1))) & (2**64 - 1)
            bit = 1 << (_code(source or "") & 63)
            bit -= (bit >> 63) << 64
            for node in nodes:
                own = under.get(id(node))
                if own is None and node.parent is not None:
                    continue
                own = (own or 0) - (1 << 63)
                known = stats.get((host, node.key))
                if known is None:
                    stats[host, node.key] = [1, bit, own, own]
                else:
                    known[0] += 1
                    known[1] |= bit
                    known[2], known[3] = min(known[2], own), max(known[3], own)
        if len(stats) > HELD:
            yield from out()
            stats = {}
    yield from out()


def induce(pages: DataFrame) -> DataFrame:
    """host, template (packed shape), constant (slot keys, joined by commas) of every host of PAGES pages or more."""
    shapes = pages.mapInArrow(_shapes, "host string, code long, pages long, shape binary")
    shapes = shapes.groupBy("host", "code").agg(F.sum("pages").alias("pages"), F.min("shape").alias("shape"))
    templates = shapes.groupBy("host").agg(F.sum("pages").alias("all"), F.max_by("shape", F.struct("pages", "code")).alias("template")).where(F.col("all") >= PAGES)
    templates = common.cut(templates.select("host", "template"))
    slots = pages.join(common.bounded(templates, HOSTS), "host").mapInArrow(_slots, "host string, slot long, pages long, bits long, low long, high long")
    slots = common.cut(slots.groupBy("host", "slot").agg(F.sum("pages").alias("pages"), F.bit_or("bits").alias("bits"), F.min("low").alias("low"), F.max("high").alias("high")))
    hosts = slots.where("slot = 0 and low <> high").select("host", F.col("pages").alias("all"))
    constant = slots.where((F.col("slot") != 0) & (F.col("low") == F.col("high")) & (F.bit_count("bits") >= PAGES)).join(hosts, "host").where(F.col("pages") >= PART * F.col("all"))
    constant = constant.groupBy("host").agg(F.array_join(F.array_sort(F.collect_list("slot")).cast("array<string>"), ",").alias("constant"))
    return templates.join(constant, "host", "left")


# ------------------------------------------------------------------ extraction


def page_text(source: str, aligner: Aligner, template: str | None, constant: frozenset[int]) -> str:
    root, blocks = parse(source or "")
    if not blocks:
        return ""
    nodes = preorder(root)
    if constant:
        aligner(nodes, template)
    # what holds a main element, and what holds that or an article; an article in a box of other stories does not count outside it
    holds, cores = set(), set()
    for node in reversed(nodes):
        if node.parent is None or node.mark == _HARD:
            continue
        core = node.tag == "main" or "@main" in node.label or id(node) in cores
        if core:
            cores.add(id(node.parent))
        if (node.main or id(node) in holds) and (core or node.mark != _OTHER):
            holds.add(id(node.parent))

    def mark(void: set[int]) -> None:
        for node in nodes[1:]:
            soft = node.mark == _SOFT and id(node) not in void
            other = node.mark == _OTHER and id(node) not in cores
            node.marked = node.parent.marked or node.mark == _HARD or soft or other

    mark(holds)
    if all(node.marked for node, _ in blocks):
        # marked boxes that hold a body of text, where there is no other
        held: dict[int, int] = {}
        for node, _ in blocks:
            while node.parent is not None:
                held[id(node)] = held.get(id(node), 0) + 1
                node = node.parent
        mark(holds | {i for i, n in held.items() if n >= max(BODY_BLOCKS, 0.8 * len(blocks))})
    if constant:
        for node in nodes[1:]:
            plain = node.inner and (node.tag in PLAIN or node.main)
            node.marked = node.marked or node.parent.marked or (node.key in constant and not plain and id(node) not in holds)
    within = any(node.main and not node.marked for node in nodes)
    return "\n".join(text for node, text in blocks if not node.marked and (node.inner or not within))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    aligner, constants = Aligner(), {}
    for batch in batches:
        out = []
        for source, template, constant in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), batch.column("constant").to_pylist(), strict=True):
            constant = constant or ""
            if constant not in constants:
                if len(constants) > 2000:
                    constants.clear()
                constants[constant] = frozenset(map(int, filter(None, constant.split(","))))
            out.append(page_text(source, aligner, _unpacked(template) if constant else None, constants[constant]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text for every row of pages."""
    common.configure(pages.sparkSession)
    host, _ = host_and_path(F.col(url_col))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    wrappers = common.bounded(common.cut(induce(own.select("host", "html"))), HOSTS)
    joined = own.join(wrappers, "host", "left").select("page_id", "url", "html", "template", "constant")
    return joined.mapInArrow(_extract, "page_id long, url string, text string")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages")).select("*", F.char_length("text").cast("long").alias("n_chars"))


#: The generated pages are regular enough for SQL: the article element, cut at its block tags.
ORACLE_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS body FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(replace(body, '<br>', ' '), '</?(?:p|h1)>'), lambda x:
  replace(replace(replace(replace(replace(trim(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&')) AS parts FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM c
"""
