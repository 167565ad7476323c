"""HTML extraction by wrapper induction over the pages of a host.

Method: each page becomes a tree of its block elements in which equal neighbours are folded into one. The fullest tree
of a host is its reference; simple tree matching (the largest ordered matching of equal labels, by dynamic programming
over children) aligns every other page with it, so each text block falls into a slot of the reference. A text that
fills its slot on half of the host's pages is constant and belongs to the template; outside the article a slot whose few
texts come again and again is template, too. What varies is content. Copies of a page must not make its article look
constant, so pages are counted by families: the smallest hash of three words in a row in a page's longest text, which
copies and most near copies share.

Elements and names that mark menus, headers, footers, sidebars, notices, adverts, forms and reader comments are left out
on every page; if there is an ``article`` (else ``main``) element, content is looked for inside it. On hosts with few
families nothing is learnt, and lists of links outside an article are left out instead.

Matching works on tree shapes, and equal pairs of shapes are matched once per worker; texts travel as hashes. Defined
cases: null or empty html has an empty text; a null url shares one host with other urls without a host; a page cut off
inside a tag ends before it; elements nest to any depth, and end tags of nothing open are passed over; rows that repeat a
page_id are each extracted.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm import core, files
from fieldtrace.llm.registry import query

FAMILIES = 5  # a host with fewer teaches nothing
CONSTANT = 0.5  # share of a host's families in which a constant text stands
RECURRING = 0.5  # distinct texts per use below which a slot outside the article is template
ORDERS = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)  # odd multipliers: orders of hashes
SALTS = 16  # shares in which a host's pages meet its wrapper

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
SKIPPED = frozenset("""script style noscript template head title svg math canvas iframe object embed audio video form button select option textarea input
datalist nav footer aside dialog menu""".split())
MARKS = frozenset("""nav navbar navigation menu breadcrumb breadcrumbs sidebar footer ad ads advert adverts advertisement advertising banner sponsor sponsored
promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search share
sharing social related recommended recommendations comment comments disqus respond replies pagination pager toolbar widget copyright masthead skip""".split())
ROLES = frozenset("navigation contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
_TOKEN = re.compile(r"[\[\]]|\"(?:[^\"\\]|\\.)*\"")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Node:
    """An element with what it means for its texts."""

    __slots__ = ("tag", "label", "children", "blocks", "dropped", "region", "link")

    def __init__(self, tag: str, label: str, dropped: bool, region: int, link: bool):
        self.tag, self.label, self.dropped, self.region, self.link = tag, label, dropped, region, link
        self.children: list[Node] = []
        self.blocks: list[int] = []


def _names(attributes: dict) -> set[str]:
    return {x.lower() for value in (attributes.get("class"), attributes.get("id")) if value for x in _NAME.findall(value)}


def _open(tag: str, attributes: dict, parent: Node) -> Node:
    """region: 2 inside an article, 1 inside a main element, 0 outside both."""
    names, role = _names(attributes), (attributes.get("role") or "").lower()
    region = parent.region
    if tag == "article" or role == "article" or attributes.get("itemprop") == "articleBody":
        region = 2
    elif tag == "main" or role == "main":
        region = max(region, 1)
    marked = names & (MARKS if tag not in ("html", "body", "main", "article") else {"comment", "comments"})
    head = (tag == "header" or role == "banner" or "header" in names) and region == 0
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(_HIDDEN.search(attributes.get("style") or ""))
    dropped = parent.dropped or tag in SKIPPED or bool(marked) or role in ROLES or head or hidden
    label = tag + "".join(f".{x}" for x in sorted(names) if not x.isdigit())
    return Node(tag, label, dropped, region, parent.link or tag == "a")


def parse(page: str) -> tuple[Node, list[tuple[str, Node, int]]]:
    """(root, blocks): blocks are (text with single spaces, innermost block element, characters within links)."""
    root = Node("", "", False, 0, False)
    stack, homes, blocks, parts, linked = [root], [root], [], [], 0
    at, end = 0, len(page)
    opened: Counter = Counter()  # an end tag of nothing open costs no look through the stack

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                homes[-1].blocks.append(len(blocks))
                blocks.append((text, homes[-1], linked))
            parts.clear()
        linked = 0

    def say(raw: str):
        nonlocal linked
        if raw and stack[-1].tag not in SKIPPED:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if stack[-1].link:
                linked += len(text)

    def close(depth: int):
        while len(stack) > depth:
            if stack[-1].tag in BLOCK or stack[-1].dropped and not stack[-2].dropped:
                flush()
                homes.pop()
            opened[stack.pop().tag] -= 1

    while at < end:
        m = _TAG.search(page, at)
        say(page[at:m.start() if m else end])
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if opened[tag]:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        close(depth)
                        break
            continue
        if tag == "br":
            parts.append(" ")
        if tag in VOID:
            if tag in BLOCK:
                flush()
            continue
        attributes = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3].strip("/ ") else {}
        if tag in BLOCK:
            for depth in range(len(stack) - 1, 0, -1):  # a new block ends an open paragraph
                if stack[depth].tag == "p":
                    close(depth)
                    break
                if stack[depth].tag in BLOCK:
                    break
        if tag in CLOSES:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in KEEPS[tag]:
                    break
                if stack[depth].tag in CLOSES[tag]:
                    close(depth)
                    break
        if m[3].endswith("/") and tag in ("svg", "path"):
            continue
        node = _open(tag, attributes, stack[-1])
        if tag in RAW:
            stop = re.compile(f"</{tag}[\\s/>]", re.IGNORECASE).search(page, at)
            at = stop.start() if stop else end
            if stop:
                at = page.find(">", stop.start()) + 1 or end
            continue
        if tag in BLOCK or node.dropped and not stack[-1].dropped:
            flush()
            homes[-1].children.append(node)
            homes.append(node)
        stack.append(node)
        opened[tag] += 1
    close(1)
    flush()
    return root, blocks


# --- trees

def fold(node: Node) -> list:
    """[label, children, blocks] with equal neighbours made one, deeply; without recursion, as pages nest to any depth."""
    root = [node.label, [], list(node.blocks)]
    todo = [(root, node.children)]
    while todo:
        into, children = todo.pop()
        groups: list[tuple[list, list[Node]]] = []
        for c in children:
            if groups and groups[-1][0][0] == c.label:
                groups[-1][0][2].extend(c.blocks)
                groups[-1][1].extend(c.children)
            else:
                groups.append(([c.label, [], list(c.blocks)], list(c.children)))
        into[1] = [item for item, _ in groups]
        todo += groups
    return root


def shape(folded) -> tuple[str, list[list[int]]]:
    """(JSON of labels in nested lists, blocks of each node in pre-order)."""
    out, held, todo = [], [], [folded]
    while todo:
        item = todo.pop()
        if item is None:
            out.append("]")
            continue
        label, children, blocks = item
        held.append(blocks)
        out.append(f"{',' if out else ''}[{json.dumps(label)}")
        todo.append(None)
        todo += reversed(children)
    return "".join(out), held


def _tree(text: str) -> tuple[list[str], list[list[int]]]:
    """(labels, children) of the nodes of a shape in pre-order."""
    labels, children, stack = [], [], []
    for token in _TOKEN.findall(text):
        if token == "[":
            if stack:
                children[stack[-1]].append(len(children))
            stack.append(len(children))
            children.append([])
        elif token == "]":
            stack.pop()
        else:
            labels.append(token)
    return labels, children


@functools.lru_cache(maxsize=4096)
def align(mine: str, reference: str) -> tuple[int, ...]:
    """For each node of a shape in pre-order, the node of the reference that simple tree matching pairs it with, or -1."""
    names, under = _tree(mine)
    if mine == reference:
        return tuple(range(len(names)))
    other_names, other_under = _tree(reference)
    out = [-1] * len(names)
    if names[0] != other_names[0]:
        return tuple(out)
    # a pair of nodes has one pair of parents, so each is met once, after its parents
    pairs = [(0, 0)]
    for x, y in pairs:
        pairs += [(c, d) for c in under[x] for d in other_under[y] if names[c] == other_names[d]]
    weight: dict[tuple[int, int], int] = {}
    tables: dict[tuple[int, int], np.ndarray] = {}
    for x, y in reversed(pairs):
        best = tables[x, y] = np.zeros((len(under[x]) + 1, len(other_under[y]) + 1), np.int64)
        for i, c in enumerate(under[x], 1):
            for j, d in enumerate(other_under[y], 1):
                best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + weight.get((c, d), 0))
        weight[x, y] = 1 + int(best[-1, -1])
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        out[x] = y
        best, i, j = tables[x, y], len(under[x]), len(other_under[y])
        while i and j:
            c, d = under[x][i - 1], other_under[y][j - 1]
            if (c, d) in weight and best[i, j] == best[i - 1, j - 1] + weight[c, d]:
                todo.append((c, d))
                i, j = i - 1, j - 1
            elif best[i, j] == best[i - 1, j]:
                i -= 1
            else:
                j -= 1
    return tuple(out)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _pages(batch) -> list[str]:
    return [x.decode("utf-8", "replace") for x in core.blobs(batch)]


def signatures(texts: list[str]) -> list[int]:
    """Smallest hash of three words in a row of all texts end to end, in each order; of the words where they are fewer."""
    words = core.hash_words([w.encode("utf-8", "surrogatepass") for t in texts for w in t.split()])
    three = core.rolling(words, min(3, max(1, len(words))))
    return [int((three * k).min() >> np.uint64(1)) if len(three) else 0 for k in ORDERS]


def _learn(batches):
    """(host, salt, shape, size, families, nodes, texts): the tree of each page with its texts as hashes."""
    for batch in core.slices(batches):
        rows = []
        for page in _pages(batch):
            root, blocks = parse(page)
            tree, held = shape(fold(root))
            nodes = [k for k, own in enumerate(held) for _ in own]
            hashes = [_hash(blocks[b][0]) for own in held for b in own]
            families = signatures([text for text, home, _ in blocks if not home.dropped])
            rows.append((tree, len(held), families, nodes, hashes))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("salt"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.int64())),
                                          pa.array(cols[3], pa.list_(pa.int32())), pa.array(cols[4], pa.list_(pa.int64()))],
                                         names=["host", "salt", "shape", "size", "families", "nodes", "texts"])


def _slots(batches):
    """(host, family, slot, text) of all aligned texts."""
    for batch in batches:
        hosts, families, slots, texts = [], [], [], []
        for host, tree, family, nodes, own, reference in zip(*(batch.column(c).to_pylist() for c in ("host", "shape", "family", "nodes", "texts", "reference")), strict=True):
            to = align(tree, reference)
            found = {(to[n], t) for n, t in zip(nodes, own, strict=True) if to[n] >= 0}
            hosts += [host] * len(found)
            families += [family] * len(found)
            slots += [s for s, _ in found]
            texts += [t for _, t in found]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(families, pa.int64()), pa.array(slots, pa.int32()), pa.array(texts, pa.int64())],
                                         names=["host", "family", "slot", "text"])


def _extract(batches):
    for batch in core.slices(batches):
        texts = []
        given = (batch.column(c).to_pylist() for c in ("reference", "template", "constants"))
        for page, reference, template, constants in zip(_pages(batch), *given, strict=True):
            texts.append(content(page, reference, template or (), constants or ()))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


def content(page: str, reference: str | None = None, template=(), constants=()) -> str:
    """The main text of a page, given its host's reference shape, template slots and hashes of constant texts by slot."""
    root, blocks = parse(page)
    slot = dict.fromkeys(range(len(blocks)), -1)
    if reference:
        tree, held = shape(fold(root))
        to = align(tree, reference)
        slot = {b: to[k] for k, own in enumerate(held) for b in own}
    fixed, set_ = set(template), {(c["slot"], c["text"]) for c in constants}
    region = max((home.region for _, home, _ in blocks if not home.dropped), default=0)
    out = []
    for k, (text, home, linked) in enumerate(blocks):
        if home.dropped or home.region < region:
            continue
        if set_ and (slot[k], _hash(text)) in set_:
            continue
        if region == 0 and (slot[k] in fixed if fixed else linked > len(text) / 2):
            continue
        out.append(text)
    return "\n".join(out)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, reference, template, constants) of hosts; pages: (host, salt, data)."""
    parsed = pages.select("host", "salt", "data").mapInArrow(_learn, "host string, salt long, shape string, size int, families array<long>, nodes array<int>, texts array<long>")
    folder = files.new_folder(pages.sparkSession, "trees")  # as Parquet, where the few shapes of a host cost little
    parsed.write.parquet(folder)
    trees = pages.sparkSession.read.parquet(folder)
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    told = trees.select("host", F.posexplode("families").alias("order", "family")).groupBy("host", "order", "family").agg(F.lit(1).alias("one"))
    best = told.groupBy("host", "order").agg(F.count("*").alias("n")).groupBy("host").agg(F.max(F.struct("n", (-F.col("order")).alias("back"))).alias("b")).select("host", F.col("b.n").alias("families"), (-F.col("b.back")).alias("order"))
    fullest = trees.groupBy("host").agg(F.max(F.struct("size", "shape")).alias("most")).select("host", F.col("most.shape").alias("reference"))
    reference = core.cut(fullest.join(best, "host"))
    teach = reference.where(F.col("families") >= FAMILIES)
    slots = trees.join(teach.select("host", "reference", "order", salts), ["host", "salt"]).withColumn("family", F.get("families", "order")).drop("families", "order").mapInArrow(_slots, "host string, family long, slot int, text long")
    uses = slots.distinct().groupBy("host", "slot", "text").agg(F.count("*").alias("uses"))
    uses = uses.join(teach.select("host", "families"), "host")
    # at most two texts can fill half of a slot each, so the lists are short
    constant = (F.col("uses") >= FAMILIES) & (F.col("uses") > CONSTANT * F.col("families"))
    by_slot = uses.groupBy("host", "slot").agg(F.sum("uses").alias("all"), F.count("*").alias("texts"), F.collect_set(F.when(constant, F.col("text"))).alias("fixed"))
    recurring = (F.col("all") >= FAMILIES) & (F.col("texts") <= RECURRING * F.col("all"))
    found = by_slot.groupBy("host").agg(F.sort_array(F.collect_set(F.when(recurring, F.col("slot")))).alias("template"),
                                        F.flatten(F.collect_list(F.transform("fixed", lambda t: F.struct(F.col("slot").alias("slot"), t.alias("text"))))).alias("constants"))
    return reference.select("host", "reference").join(found, "host", "left")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per page."""
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    url = F.col(f"`{url_col}`").cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), host.alias("host"),
                        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary").alias("data")).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    learnt = wrappers(rows).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    ready = rows.join(learnt, ["host", "salt"], "left").select("page_id", "url", "data", "reference", "template", "constants")
    return ready.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


@query("op1_html_wrapper")
def op1(spark, sf_dir):
    return extract(core.read(spark, sf_dir, "pages"))
