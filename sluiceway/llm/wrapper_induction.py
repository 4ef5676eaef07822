"""Main text of web pages by wrapper induction over the pages of a host.

A page's element tree, with many siblings of one label folded into one, is its skeleton. The
skeletons of a host are aligned by simple tree matching into one template; whatever a page
has at a template node is that node's texts there. A text that all pages with the node have
there belongs to the template, and so does one that most pages have in some sibling of a
repeated label, wherever it stands among them. Nodes with other texts are slots. Content is what fills the slots
of the article, outside elements whose tag or role says menu, advert and the like. A form, or an
element that is never closed, is no such element if the article or most of the page lies in
it. Words of class and id are evidence only: they count against a text by how little else the
page has.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.llm.common import prepare, record
from sluiceway.session import stored

# So many different pages must agree on a node's text before it counts as template.
LEAST_PAGES = 5
# Skeletons of a host that one task aligns; more are aligned in parts, and the templates of the
# parts in further rounds.
SKELETONS_AT_ONCE = 500
# More siblings of one label than this are folded into one.
APART = 4
# A text in siblings of a repeated label is template if at least this share of the pages that
# have texts in such siblings have it.
MOST_PAGES = 0.9
# Elements nested deeper than this count as part of the one they are in.
DEEPEST = 150

# HTML's element names by behaviour.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    """a abbr b bdi bdo big br cite code data del dfn em font i ins kbd label mark q s samp small
    span strike strong sub sup time tt u var wbr img""".split()
)
CLOSES_P = frozenset(
    """address article aside blockquote center details dialog dir div dl fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul""".split()
)
CLOSED_BY_SAME = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
# What is never main text by tag and by ARIA role, and what seldom is by word of
# class or id.
OTHER_TAGS = frozenset(
    """head nav header footer aside form menu button select dialog svg canvas audio video object
    script style textarea title noscript template iframe""".split()
)
OTHER_ROLES = frozenset(
    "navigation banner complementary contentinfo search form alert dialog menu menubar".split()
)
OTHER_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion
    nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead toolbar
    cookie cookies consent notice notices alert popup modal overlay subscribe newsletter signup
    login search share sharing social related recommended comment comments reply replies respond
    disqus widget pagination pager copyright disclaimer""".split()
)
# Elements that no word of class or id speaks against, nor against what they are in.
FRAME = frozenset("html body main article".split())
# Texts in an element with such a word are left out if the texts with less against them are
# this share of both or more: by a word inside a longer name, and by a name that is the word.
BY_PART, BY_NAME = 1, 2
LEAST_SHARE = {BY_PART: 0.1, BY_NAME: 0.01}
# A form or unclosed element with more than the one share of the page's characters is a frame, if
# less than the other share lies outside elements that are never main text.
FRAME_SHARE, FREE_SHARE = 0.5, 0.1
MAIN_TAGS, MAIN_ROLES = frozenset(("article", "main")), frozenset(("article", "main"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+(?:>|\Z)|[^>]*(?:>|\Z))",
    re.S,
)
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")


class Node:
    """An element of a skeleton or template: label, whether it can be content, children."""

    __slots__ = (
        "against", "children", "closed", "into", "is_form", "is_main", "is_other", "label",
        "main", "number", "other", "parent", "repeated",
    )

    def __init__(self, label: str, other: bool = False, main: bool = False, parent: Node | None = None):
        self.label, self.other, self.main, self.parent = label, other, main, parent
        # What the element itself says; other and main hold for all it contains.
        self.is_other, self.is_main, self.is_form, self.closed = other, main, False, False
        self.children: list[Node] = []
        self.number = 0
        self.repeated = False  # several siblings were folded into it
        self.against = 0  # what class and id say: 0, BY_PART or BY_NAME
        self.into: Node | None = None  # the node this one was merged into

    def add(self, label: str, other: bool, main: bool) -> Node:
        child = Node(label, self.other or other, self.main or main, self)
        child.is_other, child.is_main = other, main
        self.children.append(child)
        return child

    def merged(self) -> Node:
        node = self
        while node.into is not None:
            node = node.into
        return node


def matched(a: Node, b: Node) -> int:
    """Simple tree matching: nodes that two trees share, in order, from the root down."""
    if a.label != b.label:
        return 0
    if not a.children or not b.children:
        return 1
    return 1 + _aligned(a.children, b.children)[0]


def _aligned(left: list[Node], right: list[Node]) -> tuple[int, list[tuple[int, int]]]:
    """The best order-preserving pairing of two lists of children, and its weight."""
    shared = {a.label for a in left} & {b.label for b in right}
    lefts = [i for i, a in enumerate(left) if a.label in shared]
    rights = [j for j, b in enumerate(right) if b.label in shared]
    left, right = [left[i] for i in lefts], [right[j] for j in rights]
    best = [[0] * (len(right) + 1)]
    weights: dict[tuple[int, int], int] = {}
    for i, a in enumerate(left, 1):
        row = [0]
        for j, b in enumerate(right, 1):
            weight = weights[i, j] = matched(a, b)
            pair = best[i - 1][j - 1] + weight if weight else 0
            row.append(max(best[i - 1][j], row[j - 1], pair))
        best.append(row)
    pairs, i, j = [], len(left), len(right)
    while i and j:
        if weights[i, j] and best[i][j] == best[i - 1][j - 1] + weights[i, j]:
            i, j = i - 1, j - 1
            pairs.append((lefts[i], rights[j]))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[len(left)][len(right)], pairs[::-1]


def merge(template: Node, tree: Node) -> None:
    """Align ``tree`` with ``template``; what has no partner is added in its place.

    Every node of ``tree`` then knows the node it became part of.
    """
    tree.into = template
    template.repeated |= tree.repeated
    if not tree.children:
        return
    pairs = {}
    if template.children:
        pairs = {j: i for i, j in _aligned(template.children, tree.children)[1]}
    children, taken = [], 0
    for j, child in enumerate(tree.children):
        if j in pairs:
            children += template.children[taken : pairs[j] + 1]
            taken = pairs[j] + 1
        else:
            children.append(Node(child.label, child.other, child.main, template))
        merge(children[-1], child)
    template.children = children + template.children[taken:]


def parse(page: str | None) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of block elements, and the texts of blocks with their elements, in order."""
    root = Node("")
    stack: list[tuple[str, Node]] = [("", root)]
    blocks: list[tuple[Node, str]] = []
    pending: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(pending)).split()) if pending else ""
        pending.clear()
        if text:
            blocks.append((stack[-1][1], text))

    def close(names: tuple[str, ...], within: frozenset[str]) -> None:
        for at in range(len(stack) - 1, 0, -1):
            if stack[at][0] in names:
                flush()
                stack[at][1].closed = True
                del stack[at:]
                return
            if stack[at][0] in within:
                return

    page, at = page or "", 0
    lower = None
    while at < len(page):
        token = _TOKEN.search(page, at)
        if not token:
            pending.append(page[at:])
            break
        pending.append(page[at : token.start()])
        at = token.end()
        end, name, attributes = token[1], token[2], token[3]
        if not name:
            continue
        name = name.lower()
        if end:
            if name in INLINE:
                if any(tag == name for tag, _ in stack[1:]):
                    close((name,), CLOSES_P)
            elif any(tag == name for tag, _ in stack):
                flush()
                while stack[-1][0] != name:
                    stack.pop()
                stack.pop()[1].closed = True
            continue
        if name in RAW:
            lower = page.lower() if lower is None else lower
            stop = lower.find(f"</{name}", at)
            at = len(page) if stop < 0 else stop
            shut = _TOKEN.search(page, at)
            at = shut.end() if shut and stop >= 0 else len(page)
            if name in ("title", "textarea", "iframe"):
                flush()
            continue
        if name == "br":
            pending.append(" ")
            continue
        names = {k.lower(): v.strip("\"'").lower() for k, v in _NAMES.findall(attributes)} if attributes else {}
        words = set(_WORD.findall(f"{names.get('class', '')} {names.get('id', '')}")) if names else ()
        # What heads an article is its title; what heads a page is not.
        heads = name == "header" and any(tag == "article" for tag, _ in stack)
        other = (name in OTHER_TAGS and not heads) or names.get("role") in OTHER_ROLES
        main = name in MAIN_TAGS or names.get("role") in MAIN_ROLES
        against = 0
        if not (main or name in FRAME or OTHER_WORDS.isdisjoint(words)):
            own = f"{names.get('class', '')} {names.get('id', '')}".split()
            against = BY_PART if OTHER_WORDS.isdisjoint(own) else BY_NAME
        if name in INLINE and not ((other or against) and name not in VOID):
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in CLOSES_P:
            close(("p",), CLOSES_P - {"p"})
        if name in CLOSED_BY_SAME:
            close(CLOSED_BY_SAME[name], frozenset(("ul", "ol", "table", "dl", "select", "menu")))
        flush()
        label = f"{name}.{names['class']}" if names.get("class") else name
        inside = stack[-1][1]
        if len(stack) <= DEEPEST or (other and not inside.other) or against > inside.against:
            inside = inside.add(label, other, main)
            inside.against, inside.is_form = against, name == "form"
        around = inside if main else None
        while around is not None:
            around.against, around = 0, around.parent
        stack.append((name, inside))
    flush()
    unframe(root, blocks)
    inherit(root)
    return root, blocks


def unframe(root: Node, blocks: list[tuple[Node, str]]) -> None:
    """Let forms and unclosed elements that hold the article or most of the page be content.

    A page with an article or main element outside all others stays as it is. Where every one
    of them is inside, the elements around them are frames: forms and unclosed ones, and any
    element if there is no text beside. Without one, the share of characters decides.
    """
    total = sum(len(text) for _, text in blocks)
    while True:
        nodes = list(numbered(root))
        mains = [node for node in nodes if node.is_main]
        if any(not node.other for node in mains):
            return
        free = sum(len(text) for node, text in blocks if not node.other)
        held: Counter[int] = Counter()
        for node, text in blocks:
            for around in _around(node):
                held[around.number] += len(text)
        inside = {around.number for node in mains for around in _around(node)}
        frames = [
            node
            for node in nodes
            if node.is_other
            and (
                node.number in inside and (not free or node.is_form or not node.closed)
                or not mains
                and (node.is_form or not node.closed)
                and not (node.parent and node.parent.other)
                and held[node.number] > FRAME_SHARE * total
                and free < FREE_SHARE * total
            )
        ]
        if not frames:
            return
        for node in frames:
            node.is_other = False
        for node in nodes:
            node.other = node.is_other or (node.parent is not None and node.parent.other)


def _around(node: Node | None) -> Iterator[Node]:
    """The node and all it lies in."""
    while node is not None:
        yield node
        node = node.parent


def inherit(root: Node) -> None:
    """What is said against an element holds for all it contains, but not for an article."""
    for node in numbered(root):
        if node.parent is not None:
            node.against = max(node.against, node.parent.against)


def fold(node: Node) -> None:
    """Merge siblings that share a label into the first of them, if they are more than APART."""
    if node.other:
        node.children = []  # nothing in it can be content
        return
    often = Counter(child.label for child in node.children)
    first: dict[str, Node] = {}
    kept = []
    for child in node.children:
        fold(child)
        if often[child.label] <= APART:
            kept.append(child)
        elif child.label in first:
            merge(first[child.label], child)
        else:
            child.repeated = True
            first[child.label] = child
            kept.append(child)
    node.children = kept


def numbered(root: Node) -> Iterator[Node]:
    """All nodes in order, each given its number."""
    waiting, count = [root], 0
    while waiting:
        node = waiting.pop()
        node.number = count
        count += 1
        waiting += reversed(node.children)
        yield node


def families(root: Node) -> dict[int, tuple[int, bool]]:
    """For each number the family of its node, and whether a label is repeated in the family.

    A family are the siblings of one label, and further down what has one label in a family.
    """
    family: dict[int, int] = {root.number: root.number}
    of_label: dict[tuple[int, str], int] = {}
    repeated: dict[int, bool] = {root.number: False}
    for node in numbered(root):
        for child in node.children:
            own = family[node.number]
            first = of_label.get((own, child.label))
            if first is None:
                first = of_label[own, child.label] = child.number
                repeated[first] = repeated[own]
            else:
                repeated[first] = True
            repeated[first] |= child.repeated
            family[child.number] = first
    return {number: (first, repeated[first]) for number, first in family.items()}


def dump(node: Node) -> list:
    return [node.label, int(node.repeated), [dump(child) for child in node.children]]


def load(data: list, parent: Node | None = None) -> Node:
    node = Node(data[0], parent=parent)
    node.repeated = bool(data[1])
    node.children = [load(child, node) for child in data[2]]
    return node


PARSED = record(
    skeleton=T.StringType(),
    slots=T.ArrayType(T.IntegerType()),
    texts=T.ArrayType(T.StringType()),
    mains=T.ArrayType(T.BooleanType()),
    against=T.ArrayType(T.IntegerType()),
    whole=T.LongType(),
)
# Which node of its part's template a skeleton's slot became; the template is on one row, slot -1.
ALIGNED = (
    "host string, part long, key string, slot int, node int, family int, repeated boolean, template string"
)
SLOT = ["host", "part", "key", "slot", "node", "family", "repeated"]


def _hash(texts: list[str]) -> int:
    raw = "\x00".join(texts).encode("utf-8", "surrogatepass")
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def skeleton_of(page: str | None) -> tuple[str, list[int], list[str], list[bool], list[int]]:
    """The page's skeleton, and the texts that can be content with their skeleton nodes.

    Then whether each text is inside the page's article or main element, and what words of
    class and id say against it.
    """
    root, blocks = parse(page)
    fold(root)
    for _ in numbered(root):
        pass
    kept = [
        (node.merged().number, text, node.main, node.against)
        for node, text in blocks
        if not node.other
    ]
    data = json.dumps(dump(root), separators=(",", ":"), ensure_ascii=False)
    slots, texts, mains, against = map(list, zip(*kept, strict=True)) if kept else ([], [], [], [])
    return data, slots, texts, mains, against


@F.pandas_udf(PARSED)
def _parsed(pages: pd.Series) -> pd.DataFrame:
    rows = []
    for page in pages:
        skeleton, slots, texts, mains, against = skeleton_of(page)
        # Copies of a page with other adverts are the same page.
        plain = [text for text, level in zip(texts, against, strict=True) if not level] or texts
        rows.append((skeleton, slots, texts, mains, against, _hash(plain)))
    return pd.DataFrame(rows, columns=[f.name for f in PARSED])


def _align(rows: pd.DataFrame) -> pd.DataFrame:
    """One template from the skeletons or templates of a host, and each one's nodes in it."""
    rows = rows.sort_values("key", ignore_index=True)
    template, trees = Node(""), []
    for data in rows["skeleton"]:
        tree = load(json.loads(data))
        trees.append(list(numbered(tree)))
        merge(template, tree)
    for _ in numbered(template):
        pass
    kin = families(template)
    out = [
        (key, node.number, node.merged().number, *kin[node.merged().number])
        for key, nodes in zip(rows["key"], trees, strict=True)
        for node in nodes
    ]
    found = pd.DataFrame([*out, (None, -1, -1, -1, False)], columns=SLOT[2:])
    found["host"], found["part"] = rows["host"].iloc[0], rows["part"].iloc[0]
    whole = json.dumps(dump(template), separators=(",", ":"), ensure_ascii=False)
    found["template"] = [None] * len(out) + [whole]
    return found[[*SLOT, "template"]]


def _dealt(skeletons: DataFrame) -> DataFrame:
    """Skeletons aligned into one template for each part of a host, each part in one task."""
    of_host = skeletons.groupBy("host").agg(F.ceil(F.count("*") / SKELETONS_AT_ONCE).alias("parts"))
    dealt = skeletons.join(of_host, "host").select(
        "host", F.pmod(F.xxhash64("key"), "parts").alias("part"), "key", "skeleton"
    )
    # By both columns, or all parts of a large host would be aligned in one task.
    parts = dealt.repartition("host", "part").groupBy("host", "part")
    return stored(parts.applyInPandas(_align, ALIGNED), "aligned")


def _aligned_hosts(skeletons: DataFrame) -> DataFrame:
    """host, key, slot, and the node of the host's one template that it became, with its family.

    The templates of a large host's parts are aligned in further rounds, until it has one.
    """
    found = _dealt(skeletons)
    slots = found.where("slot >= 0").select(*SLOT)
    while True:
        several = found.where("slot < 0").groupBy("host").agg(F.count("*").alias("parts")).where("parts > 1")
        if several.isEmpty():
            return slots.drop("part")
        templates = found.where("slot < 0").join(several, "host", "left_semi")
        found = _dealt(
            templates.select("host", F.col("part").cast("string").alias("key"), F.col("template").alias("skeleton"))
        )
        moved = found.where("slot >= 0").select(
            "host",
            F.col("key").cast("long").alias("part"),
            F.col("slot").alias("node"),
            *(F.col(c).alias(f"next_{c}") for c in ("part", "node", "family", "repeated")),
        )
        slots = stored(
            slots.join(moved, ["host", "part", "node"], "left").select(
                *(F.coalesce(f"next_{c}", c).alias(c) if f"next_{c}" in moved.columns else c for c in SLOT)
            ),
            "slots",
        )


def main_texts(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Pages without a url, or with one that names no host, share a host. A null or empty page
    has an empty text. On a host with too few different pages to compare, nothing counts as
    template, and tags, roles and names decide alone. Other columns are not read.
    """
    prepare(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[^:/?#]+://([^/?#]+)", 1))
    rows = pages.select(
        F.col(key).alias("page_id"),
        F.col(url).alias("url"),
        host.alias("host"),
        _parsed(F.col(html).cast("string")).alias("p"),
    ).select("page_id", "url", "host", "p.*")
    rows = stored(rows.withColumn("key", F.md5(F.col("skeleton").cast("binary"))), "parsed")
    # Stored, so that their size is known before the join: Spark then broadcasts rules below
    # its threshold instead of moving the texts to them.
    rules = stored(_rules(rows), "rules")
    found = _with_content(rows.join(rules, ["host", "key"], "left"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _with_content(rows: DataFrame) -> DataFrame:
    """With ``text``: what fills the page's slots in its article or main element, if anything does.

    Texts with a word of class or id against them stay if little else is left.
    """
    blocks = F.arrays_zip("slots", "texts", "mains", "against")

    def template(b):
        return F.array_contains("template", F.struct(b["slots"].alias("slot"), F.xxhash64(b["texts"]).alias("hash")))

    varying = F.filter(blocks, lambda b: ~F.coalesce(template(b), F.lit(False)))
    main = F.filter("varying", lambda b: b["mains"])

    def chars(level: int):
        """Characters of the texts with at most so much against them."""
        return F.aggregate(
            F.filter("kept", lambda b: b["against"] <= level),
            F.lit(0).cast("long"),
            lambda total, b: total + F.length(b["texts"]),
        )

    def stays(level: int):
        less, all_ = F.col(f"chars{level - 1}"), F.col(f"chars{level}")
        return (less == 0) | (less < LEAST_SHARE[level] * all_)

    found = (
        rows.withColumn("varying", F.coalesce(varying, F.array()))
        .withColumn("kept", F.when(F.exists("varying", lambda b: b["mains"]), main).otherwise(F.col("varying")))
        .withColumns({f"chars{level}": chars(level) for level in (0, BY_PART, BY_NAME)})
        .withColumns({f"stays{level}": stays(level) for level in (BY_PART, BY_NAME)})
    )
    left = F.filter(
        "kept",
        lambda b: (b["against"] == 0)
        | ((b["against"] == BY_PART) & F.col(f"stays{BY_PART}"))
        | ((b["against"] == BY_NAME) & F.col(f"stays{BY_NAME}")),
    )
    return found.withColumn("text", F.array_join(F.transform(left, lambda b: b["texts"]), " "))


def _rules(rows: DataFrame) -> DataFrame:
    """For each host and skeleton that has any, the template texts: hashes with their slots."""
    skeletons = rows.groupBy("host", "key").agg(F.first("skeleton").alias("skeleton"))
    slots = _aligned_hosts(skeletons)
    nodes = slots.groupBy("host", "key").agg(
        F.array_sort(F.collect_list(F.struct("slot", "node", "family", "repeated"))).alias("nodes")
    )
    # Pages with the same texts count once.
    own = F.struct("key", "slots", F.transform("texts", lambda t: F.xxhash64(t)).alias("hashes"))
    pages = rows.groupBy("host", "whole").agg(F.min(own).alias("own")).select("host", "own.*")
    placed = pages.join(nodes, ["host", "key"]).select(
        "host",
        # Slots are numbered from 0 without gaps.
        F.transform(
            F.arrays_zip("slots", "hashes"),
            lambda b: F.struct(F.get("nodes", b["slots"]).alias("at"), b["hashes"].alias("hash")),
        ).alias("placed"),
    )

    def places(of: str, kind: int, blocks, hashed: bool):
        """Where a page has which text, or without the hash that it has a text there at all."""
        return F.transform(
            blocks,
            lambda b: F.struct(
                F.lit(kind).alias("kind"),
                b["at"][of].alias("place"),
                (b["hash"] if hashed else F.lit(None).cast("long")).alias("hash"),
            ),
        )

    repeated = F.filter("placed", lambda b: b["at"]["repeated"])
    had = F.array_distinct(
        F.concat(
            *(places("node", 0, F.col("placed"), hashed) for hashed in (True, False)),
            *(places("family", 1, repeated, hashed) for hashed in (True, False)),
        )
    )
    counted = (
        placed.select("host", F.explode(had).alias("p"))
        .groupBy("host", "p.kind", "p.place", "p.hash")
        .agg(F.count("*").alias("pages"))
        .where(F.col("pages") >= LEAST_PAGES)
    )
    counted = stored(counted, "texts")
    total = counted.where("hash IS NULL").select("host", "kind", "place", F.col("pages").alias("of"))
    least = F.when(F.col("kind") == 0, F.col("of")).otherwise(MOST_PAGES * F.col("of"))
    template = (
        counted.where("hash IS NOT NULL")
        .join(total, ["host", "kind", "place"])
        .where(F.col("pages") >= least)
        .select("host", "kind", "place", "hash")
    )
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("node").alias("place")),
        F.struct(F.lit(1).alias("kind"), F.col("family").alias("place")),
    )
    found = slots.select("host", "key", "slot", F.inline(kinds)).join(template, ["host", "kind", "place"])
    return found.groupBy("host", "key").agg(F.collect_set(F.struct("slot", "hash")).alias("template"))
