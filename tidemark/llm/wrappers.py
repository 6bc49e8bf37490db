"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A page is read into a tree of labelled blocks and text slots; inline markup is part of a slot. Runs of equal siblings
become a repeated group. The trees of a host are aligned one after the other: what both hold is aligned further, what one
lacks becomes optional, what then stands beside its like is folded into the repeated group. Texts that are equal on all
pages are template, differing ones are slots. The result is the host's wrapper, an expression of sequences, optional and
repeated groups without alternatives. Its main text is the deepest element that holds most of the slots' characters; tags are a
check on that. A page is then walked along the wrapper, and what fills the slots of the main text is its text.

Pages of one shape and host are one tree with their texts' states, made before the shuffle, and a host's trees are aligned in
portions whose wrappers are aligned in turn, so a host with a third of all pages loads no task. Null html is empty and gives an
empty text; a null url is a host of its own. Broken or cut-off markup is read as far as it goes. Elements nested over DEPTH deep
stand beside each other in the tree, as browsers have it at a depth of their own; what drops a text still follows the nesting.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stage
from .url_rank import host_of

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math|object)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*|[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)", re.S | re.I)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Elements by their part in a page, and words of classes, ids and roles that mark what is no main text.
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = set("nav footer aside form button select option menu dialog head input label fieldset".split())
_CLOSED_BY = {"p": set("p div ul ol li table article section h1 h2 h3 h4 h5 h6 blockquote pre footer header nav aside form main hr figure dl".split()), "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_MARKS = set("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert comment comments reply replies respond discussion disqus sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer share sharing social related recommended widget newsletter subscribe subscription signup popup modal overlay toolbar pagination pager login search contentinfo complementary dialog".split())
_OUTER_MARKS = {"header", "topbar", "top"}
_COMMENTS = set("comment comments reply replies respond discussion disqus".split())
_MAIN = ("article", "main")
_WORD = re.compile(r"[a-z]+")
#: Portions of a host's trees; a share of the text that makes an element the main one.
PORTIONS, SHARE = 16, 0.6
#: Different pages that must bear a text, and none another one in its place, before it is template.
PAGES = 3
#: Levels of a tree; what is nested deeper stands on the last one.
DEPTH = 100


class Block:
    __slots__ = ("children", "deep", "dropped", "home", "label", "main", "marks", "path", "tag")

    def __init__(self, tag: str, label: str, marks: frozenset, up: Block | None) -> None:
        self.tag, self.label, self.marks = tag, label, marks
        self.main = tag in _MAIN or "main" in marks and tag in ("div", "section")
        inside_comments = bool(marks & _COMMENTS) or bool(up and up.dropped and up.marks & _COMMENTS)
        inside_main = bool(up) and (up.main or up.path.startswith("*"))
        own = tag in _DROPPED or bool(marks & _MARKS) or (not inside_main and (tag == "header" or bool(marks & _OUTER_MARKS)))
        # a main element in a menu that was never closed is main all the same; one among reader comments is not
        self.dropped = inside_comments or (own if self.main or up is None else own or up.dropped)
        if inside_comments:
            self.marks = marks | _COMMENTS
        self.deep = up.deep + 1 if up else 0
        way = "" if up is None else up.path.lstrip("*") if self.deep > DEPTH else up.path.lstrip("*") + "/" + label
        self.path = ("*" if inside_main or self.main else "") + way
        self.children: list = []
        #: The block whose child this one is in the tree.
        self.home = None if up is None else up if up.deep < DEPTH else up.home


def parse(page: str) -> tuple[Block, list[tuple[Block, str]]]:
    """The tree of a page, and its texts in page order as (block, text); one entry is one block of text."""
    root = Block("", "", frozenset(), None)
    stack, texts, parts, open_ = [root], [], [], Counter()

    def flush() -> None:
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            parts.clear()
            if text:
                texts.append((stack[-1], text))
                if not stack[-1].children or not isinstance(stack[-1].children[-1], list):
                    stack[-1].children.append([])
                stack[-1].children[-1].append(len(texts) - 1)

    for m in _TOKEN.finditer(page):
        if m["text"]:
            parts.append(m["text"])
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        attrs = m["attrs"]
        if tag in _INLINE and not (attrs and ("class" in attrs or "id" in attrs or "role" in attrs or "hidden" in attrs) and not m["close"] and _marks(attrs) & _MARKS) and not (m["close"] and stack[-1].tag == tag):
            continue
        flush()
        if m["close"]:
            if open_[tag]:
                while (last := stack.pop()).tag != tag:
                    open_[last.tag] -= 1
                open_[tag] -= 1
            continue
        if tag == "html" or tag == "body":
            continue
        while len(stack) > 1 and tag in _CLOSED_BY.get(stack[-1].tag, ()):
            open_[stack.pop().tag] -= 1
        if stack[-1].tag == "head" and tag not in ("meta", "link", "base"):
            open_[stack.pop().tag] -= 1
        if tag in _VOID:
            continue
        marks = _marks(attrs)
        block = Block(tag, tag + "".join("." + w for w in sorted(marks & (_MARKS | {"main"}))), marks, stack[-1])
        block.home.children.append(block)
        if not attrs.endswith("/") or tag not in ("div", "span"):
            stack.append(block)
            open_[tag] += 1
    flush()
    return root, texts


def _marks(attrs: str) -> frozenset:
    found: set = set()
    if attrs.strip():
        for name, a, b, c in _ATTR.findall(attrs):
            name = name.lower()
            if name in ("class", "id", "role"):
                found.update(_WORD.findall((a or b or c).lower()))
            elif name == "hidden" or name == "aria-hidden" and (a or b or c) == "true" or name == "style" and "display:none" in (a or b).replace(" ", ""):
                found.add("modal")
    return frozenset(found)


# An expression's node is [label, children, optional, repeated, load]; "#" is a text. A text's load is the list of its places in a
# page's texts, or over pages its state [least digest, greatest digest, up to PAGES pages, characters outside menus and the like].
def expression(block: Block) -> list:
    return [block.label, folded([["#", [], 0, 0, c] if isinstance(c, list) else expression(c) for c in block.children]), 0, 0, None]


def leaves(node: list) -> Iterator[list]:
    if node[0] == "#":
        yield node
    for c in node[1]:
        yield from leaves(c)


def shape(node: list) -> list:
    return [node[0], [shape(c) for c in node[1]], node[2], node[3], None]


def state(texts: list[tuple[Block, str]], at: list[int], page: int) -> list:
    digest = xxhash.xxh64_intdigest("\0".join(texts[i][1] for i in at)) >> 1
    return [digest, digest, [page], sum(len(texts[i][1]) for i in at if not texts[i][0].dropped)]


def _both(a: list | None, b: list | None) -> list | None:
    if a is None or b is None:
        return a or b
    if len(a) == 4 and isinstance(a[2], list):
        return [min(a[0], b[0]), max(a[1], b[1]), sorted({*a[2], *b[2]})[:PAGES], a[3] + b[3]]
    return a + b


def template(load: list) -> bool:
    """Whether a text is equal on all pages that have it, PAGES different ones at least; otherwise it is a slot."""
    return load[0] == load[1] and len(load[2]) == PAGES


def folded(nodes: list) -> list:
    """Equal neighbours, alone or in groups of two or three, as one repeated group."""
    for size in (1, 2, 3):
        out: list = []
        i = 0
        while i < len(nodes):
            group = nodes[i:i + size]
            labels = [n[0] for n in group]
            n = 1
            while len(group) == size and [x[0] for x in nodes[i + n * size:i + (n + 1) * size]] == labels and (size == 1 or len(set(labels)) > 1):
                group = [_merged(a, b) for a, b in zip(group, nodes[i + n * size:i + (n + 1) * size])]
                n += 1
            if n == 1:
                out.append(nodes[i])
                i += 1
            else:
                out.append([*group[0][:3], 1, group[0][4]] if size == 1 else ["()", group, 0, 1, None])
                i += n * size
        nodes = out
    return nodes


def _merged(a: list, b: list) -> list:
    return [a[0], aligned(a[1], b[1]), a[2] | b[2], a[3] | b[3], _both(a[4], b[4])]


def aligned(a: list, b: list) -> list:
    """One expression for both sequences: common nodes are aligned further, others become optional."""
    if [n[0] for n in a] == [n[0] for n in b]:
        return [_merged(x, y) for x, y in zip(a, b)]
    out: list = []
    for op, i, j, k, m in SequenceMatcher(None, [n[0] for n in a], [n[0] for n in b], autojunk=False).get_opcodes():
        if op == "equal":
            out += [_merged(x, y) for x, y in zip(a[i:j], b[k:m])]
        else:
            out += [[n[0], n[1], 1, n[3], n[4]] for n in a[i:j] + b[k:m]]
    return folded(out)


def shown(node: list) -> str:
    """The expression as text: groups in brackets, ? for optional and + for repeated."""
    if node[0] == "#":
        body = "#"
    elif node[0] == "()":
        body = "(" + " ".join(map(shown, node[1])) + ")"
    else:
        body = f"<{node[0]}>" + " ".join(map(shown, node[1])) + "</>"
    if node[2] or node[3]:
        body = f"({body}){'*' if node[2] and node[3] else '?' if node[2] else '+'}"
    return body


def _is_main(node: list) -> bool:
    return node[0].split(".")[0] in _MAIN and not set(node[0].split(".")[1:]) & _MARKS


def place_of(tree: list) -> tuple[str, list[list]]:
    """(place, [in main text, template] of each text) of a wrapper.

    The place is the deepest element with most of the characters in slots. Then tags are looked at: where article or main
    elements hold as much, they are the place, ``*``."""
    every = [n for n in leaves(tree) if n[4][3]]
    slots = [n for n in every if not template(n[4])] or every
    counted = {id(n) for n in slots}

    def mass(node: list) -> int:
        return sum(n[4][3] for n in leaves(node) if id(n) in counted)

    def tagged(node: list) -> Iterator[list]:
        if _is_main(node):
            yield node
        else:
            for c in node[1]:
                yield from tagged(c)

    least = SHARE * mass(tree)
    main = list(tagged(tree))
    if main and sum(map(mass, main)) >= least:
        place = "*"
    else:
        place, node = "", tree
        while least and (down := [c for c in node[1] if c[0] not in ("#", "()") and any(x[0] != "#" for x in c[1]) and mass(c) >= least]):
            node = down[0]
            place += "/" + node[0]
        main = [node]
    inside = {id(n) for m in main for n in leaves(m)}
    return place, [[int(id(n) in inside), int(template(n[4]))] for n in leaves(tree)]


def matched(page: list, wrapper: list, found: dict[int, list]) -> None:
    """Walk a page's expression along the wrapper: for each text's place in the page, the wrapper's text that it fills."""
    if page[0] == "#":
        for i in page[4]:
            found[i] = wrapper[4]
        return
    a, b = page[1], wrapper[1]
    groups = {n[0] for n in a}
    b = [x for n in b for x in (n[1] if n[0] == "()" and "()" not in groups else [n])]
    groups = {n[0] for n in b}
    a = [x for n in a for x in (n[1] if n[0] == "()" and "()" not in groups else [n])]
    for i, j, n in SequenceMatcher(None, [x[0] for x in a], [x[0] for x in b], autojunk=False).get_matching_blocks():
        for k in range(n):
            matched(a[i + k], b[j + k], found)


def _loaded(what: str, load: list) -> list:
    """The tree of a shape with its texts' loads, in order."""
    tree = json.loads(what)
    for n, x in zip(leaves(tree), load):
        n[4] = x
    return tree


def wrappers(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper, place, tree, slots): place is ``*`` where the main text is in article or main elements, else a path; slots
    tells of each text of the tree whether it is in the main text's place and whether it is template."""
    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict = {}
            for host, page in zip(b.column(0).to_pylist(), b.column(1)):
                root, texts = parse(page.as_py() or "")
                tree = expression(root)
                digest = xxhash.xxh64_intdigest("\0".join(t for _, t in texts)) >> 1
                load = [state(texts, n[4], digest) for n in leaves(tree)]
                old = seen.setdefault((host, json.dumps(shape(tree))), [0, load])
                old[:] = [old[0] + 1, load if not old[0] else list(map(_both, old[1], load))]
            yield table([(host, what, n, load) for (host, what), (n, load) in seen.items()])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([json.dumps(r[3]) for r in rows], pa.string())], ["host", "what", "n", "load"])

    def whole(group: pa.Table) -> tuple[str, list, int]:
        shapes: dict = {}
        for host, what, n, load in zip(*(group.column(c).to_pylist() for c in ("host", "what", "n", "load"))):
            load = json.loads(load)
            old = shapes.get(what)
            shapes[what] = (n, load) if old is None else (old[0] + n, list(map(_both, old[1], load)))
        tree = None
        for what, (_, load) in sorted(shapes.items(), key=lambda x: (-x[1][0], x[0])):
            tree = _loaded(what, load) if tree is None else _merged(tree, _loaded(what, load))
        return host, tree, sum(n for n, _ in shapes.values())

    def one(group: pa.Table) -> pa.Table:
        host, tree, n = whole(group)
        return pa.Table.from_batches([table([(host, json.dumps(shape(tree)), n, [x[4] for x in leaves(tree)])])])

    def decided(group: pa.Table) -> pa.Table:
        host, tree, _ = whole(group)
        place, slots = place_of(tree)
        return pa.table({"host": pa.array([host]), "wrapper": pa.array([" ".join(map(shown, tree[1]))]), "place": pa.array([place]), "tree": pa.array([json.dumps(shape(tree))]), "slots": pa.array([json.dumps(slots)])})

    found = map_arrow(pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")), trees, "host string, what string, n long, load string")
    portion = F.pmod(F.xxhash64("what"), F.lit(PORTIONS))
    part = found.withColumn("portion", portion).groupBy("host", "portion").applyInArrow(one, "host string, what string, n long, load string")
    return part.groupBy("host").applyInArrow(decided, "host string, wrapper string, place string, tree string, slots string")


def main_text(page: str, wrapper: list, place: str) -> str:
    """The page's texts that fill the wrapper's slots of main text, joined by a space.

    What the wrapper has no place for is looked up by its path. Texts in menus and the like are left out; a page whose main
    text is template throughout, a copy, keeps it."""
    root, texts = parse(page)
    fills: dict[int, list] = {}
    matched(expression(root), wrapper, fills)
    kept = [i for i, (b, _) in enumerate(texts) if not b.dropped]

    def by_path(b: Block) -> bool:
        return b.path[0:1] == "*" if place == "*" else (b.path + "/").startswith(place + "/")

    main = [i for i in kept if (fills[i][0] if i in fills else by_path(texts[i][0]))]
    chosen = [i for i in main if i not in fills or not fills[i][1]] or main or [i for i in kept if texts[i][0].path[0:1] == "*"] or kept
    return " ".join(texts[i][1] for i in chosen)


def extracted(pages: DataFrame, found: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text): every page read by its host's wrapper."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees: dict = {}
            texts = []
            for page, place, tree, slots in zip(b.column(2), *(b.column(i).to_pylist() for i in (3, 4, 5))):
                if (tree, slots) not in trees:
                    trees[tree, slots] = _loaded(tree, json.loads(slots))
                texts.append(main_text(page.as_py() or "", trees[tree, slots], place))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("_at"))
    places = found.select(F.col("host").alias("_host"), "place", "tree", "slots")
    joined = base.join(places, F.col("_at") == F.col("_host"), "left").select("page_id", "url", "html", "place", "tree", "slots")
    return map_arrow(joined, run, "page_id long, url string, text string")


def report(pages: DataFrame) -> DataFrame:
    found = stage(wrappers(pages), "wrappers")
    return extracted(pages, found).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
