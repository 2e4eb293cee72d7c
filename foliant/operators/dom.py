"""HTML pages to rows of selected nodes, in one pass over each page.

All selectors of a call are one automaton. A node's attributes are looked up once each and give the bits of the simple tests that they pass; only compound tests that these
bits complete are looked at, and what a compound leads to is a few operations on the bit set of selector steps that the node's ancestors have passed, carried down the tree. So what a node
costs depends on its attributes, not on the number of selectors. Sizes and link counts of all subtrees come from one pass from the last node to the first.

Trees follow the tolerant rules of Python's `html.parser`: an end tag closes up to the nearest open tag of its name, one that matches nothing is
ignored, nothing is closed by implication. Text is what stands in text nodes, stripped, empties dropped; that of comments, scripts, styles and
templates is not part of a page's text. Only nodes that some selector picks leave the Python worker, each with what later steps ask of it, so the
rows are few and narrow; the choice among them is made by windows and aggregates.

Cases: null or empty HTML gives no rows; broken markup never raises; `node_id` is the place in document order.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import urls

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MUTE = frozenset({"script", "style", "template", "rt", "rp"})
UNWANTED = frozenset({"script", "style", "noscript"})
_TOKEN = re.compile(
    r"""(?P<comma>\s*,\s*)|(?P<blank>\s+)|(?P<mark>[#.])?(?P<name>[\w-]+)
    |\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>\*?=)\s*(?:'(?P<single>[^']*)'|"(?P<double>[^"]*)"|(?P<plain>[\w-]+))\s*)?\]""",
    re.X,
)
MOST_BYTES = 4 << 20
MEMO = 20_000


class Node:
    __slots__ = ("tag", "attrs", "parent", "id", "children", "passed", "picks", "scopes", "size", "n_links")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, id: int = 0) -> None:
        self.tag, self.attrs, self.parent, self.id = tag, attrs, parent, id
        self.children: list = []
        self.passed, self.picks, self.scopes, self.size, self.n_links = 0, (), (), 0, 0

    def strings(self, bare: bool = False):
        """Stripped text nodes below; `bare`: without what sits in scripts, links and the like."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, str):
                    if text := child.strip():
                        yield text
                elif child.tag not in MUTE and not (bare and (child.tag in UNWANTED or child.tag == "a" and "href" in child.attrs)):
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()


class Tree(HTMLParser):
    """The nodes of a page in document order; with an automaton each node's `picks`, the selectors (by number) that pick it, and `scopes`, the (number, node_id) of the
    ancestors that selectors picked."""

    def __init__(self, html: str, automaton: Automaton | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.automaton = automaton
        self.root = Node("[document]", {}, None)
        self.open, self.nodes, self.texts = [self.root], [], []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        up = self.open[-1]
        node = Node(tag, {k: v or "" for k, v in attrs}, up, len(self.nodes))
        up.children.append(node)
        self.nodes.append(node)
        if self.automaton is not None:
            self.automaton.enter(node, up)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)
        self.texts.append((self.open[-1], data))

    def measure(self) -> None:
        """Sets every node's `size`, the characters of its text as `functions.text.clean_lines` leaves it, a line for each string, and one more (0 without text), and
        `n_links`, the links below it."""
        for node, data in self.texts:
            if not data.isspace():
                node.size += sum(len(x) + 1 for line in data.strip().replace("\r", "\n").split("\n") if (x := " ".join(line.split())))
        for node in reversed(self.nodes):  # children before their parents
            up = node.parent
            if node.tag not in MUTE:
                up.size += node.size
            up.n_links += node.n_links + (node.tag == "a" and "href" in node.attrs)


@functools.lru_cache(maxsize=512)
def compiled(selector: str) -> tuple[tuple[tuple, ...], ...]:
    """Alternatives of a selector; each is its steps from the last to the first. Commas and blanks within a quoted value are part of the value."""
    out, steps, at, text = [], [[]], 0, selector.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not a selector: {selector!r}")
        at = m.end()
        kind, name, value = m["mark"], m["name"], next((v for v in (m["single"], m["double"], m["plain"]) if v is not None), "")
        if m["comma"]:
            out.append(steps)
            steps = [[]]
        elif m["blank"]:
            steps.append([])
        elif m["attr"]:
            steps[-1].append((m["op"] or "has", m["attr"], value))
        elif kind or not steps[-1]:
            steps[-1].append((kind or "tag", name, ""))
        else:
            raise ValueError(f"not a selector: {selector!r}")
    out.append(steps)
    if not all(step for some in out for step in some):
        raise ValueError(f"not a selector: {selector!r}")
    return tuple(tuple(tuple(step) for step in reversed(some)) for some in out)


class Automaton:
    """Selectors, by number, compiled into one machine.

    `bits` has a bit for each simple test (a tag, an id, a class, a test of an attribute); a compound test is a set of these, found by the first of its bits. A selector's steps but the last are
    bits of `passed`: bit j of an alternative is set below a node that passes its step j while the steps before it have been passed above."""

    def __init__(self, selectors: list[str], scopes: frozenset[int] = frozenset()) -> None:
        self.scope_numbers = scopes
        simple: dict[tuple, int] = {}
        steps: dict[tuple, list[tuple[int, int, int]]] = defaultdict(list)  # compound: (bit that must be passed, bit gained, selector picked or -1)
        n_passed = 0
        for number, selector in enumerate(selectors):
            for some in compiled(selector):
                need = 0
                for j, compound in enumerate(reversed(some)):
                    for test in compound:
                        simple.setdefault(test, len(simple))
                    last = j == len(some) - 1
                    gain = 0 if last else 1 << n_passed
                    steps[tuple(sorted(set(compound)))].append((need, gain, number if last else -1))
                    need, n_passed = gain, n_passed + (not last)
        self.compounds: dict[int, list[tuple[int, list]]] = defaultdict(list)
        for compound, moves in steps.items():
            whole = sum(1 << simple[t] for t in compound)
            self.compounds[whole & -whole].append((whole, moves))
        by_kind = defaultdict(dict)
        for (kind, name, value), i in simple.items():
            by_kind[kind][name, value] = 1 << i
        self.tags = {name: bit for (name, _), bit in by_kind["tag"].items()}
        self.ids = {name: bit for (name, _), bit in by_kind["#"].items()}
        self.classes = {name: bit for (name, _), bit in by_kind["."].items()}
        self.tests: dict[str, list[tuple[str, str, int]]] = defaultdict(list)
        for kind in ("has", "=", "*="):
            for (name, value), bit in by_kind[kind].items():
                self.tests[name].append((kind, value, bit))
        self.named = {*self.tests, "id", "class"}
        self.memo: dict[tuple[str, str], int] = {}
        self.met: dict[int, list] = {}

    def _attribute(self, name: str, value: str) -> int:
        bits, words = 0, value.split() if name == "class" else ()
        if name == "id":
            bits |= self.ids.get(value, 0)
        for x in words:
            bits |= self.classes.get(x, 0)
        have = " ".join(words) if name == "class" else value
        for kind, wanted, bit in self.tests.get(name, ()):
            if kind == "has" or (wanted in have if kind == "*=" else have == wanted):
                bits |= bit
        return bits

    def _moves(self, bits: int) -> list:
        """The moves of all compounds that these simple tests complete."""
        out, left = [], bits
        while left:
            low = left & -left
            left ^= low
            for whole, moves in self.compounds.get(low, ()):
                if whole & bits == whole:
                    out += moves
        return out

    def enter(self, node: Node, up: Node) -> None:
        bits, memo = self.tags.get(node.tag, 0), self.memo
        for pair in node.attrs.items():
            if pair[0] in self.named:
                found = memo.get(pair)
                if found is None:
                    found = self._attribute(*pair)
                    if len(memo) < MEMO and len(pair[1]) < 200:
                        memo[pair] = found
                bits |= found
        passed, picks = up.passed, None
        if bits:
            moves = self.met.get(bits)
            if moves is None:
                moves = self._moves(bits)
                if len(self.met) < MEMO:
                    self.met[bits] = moves
            for need, gain, number in moves:
                if not need or up.passed & need:
                    passed |= gain
                    if number >= 0:
                        picks = {number} if picks is None else picks | {number}
        node.passed = passed
        node.picks = () if picks is None else tuple(sorted(picks))
        node.scopes = up.scopes + tuple((n, up.id) for n in up.picks if n in self.scope_numbers) if up.picks else up.scopes


def matches(node: Node, selector: str) -> bool:
    """Whether a selector picks one node, by a walk up from it; `select` asks an `Automaton` about all nodes instead."""

    def fits(at: Node, tests) -> bool:
        for kind, name, value in tests:
            words = at.attrs.get("class", "").split()
            if kind == "tag":
                fine = at.tag == name
            elif kind in "#.":
                fine = at.attrs.get("id") == name if kind == "#" else name in words
            elif name not in at.attrs:
                fine = False
            else:
                have = " ".join(words) if name == "class" else at.attrs[name]
                fine = kind == "has" or (value in have if kind == "*=" else have == value)
            if not fine:
                return False
        return True

    for first, *others in compiled(selector):
        if fits(node, first):
            at, left = node.parent, list(others)
            while left and at is not None:
                if at.parent is not None and fits(at, left[0]):
                    left.pop(0)
                at = at.parent
            if not left:
                return True
    return False


_FIELDS = [("grp", pa.string()), ("rank", pa.int32()), ("node_id", pa.int32()), ("scope", pa.int32()), ("tag", pa.string()), ("spaced", pa.string()), ("bare", pa.string()), ("size", pa.int32()), ("n_links", pa.int32()), ("href", pa.string()), ("link", pa.string()), ("content", pa.string())]
SCHEMA = "grp string, rank int, node_id int, scope int, tag string, spaced string, bare string, size int, n_links int, href string, link string, content string"


def select(pages: DataFrame, groups: dict[str, list[str]], scopes: dict[str, str] | None = None, best: dict[str, Callable] | None = None) -> DataFrame:
    """The columns of `pages` but html, and a row for each node that a selector of a group picks: group, the selector's place in it, node_id,
    text joined by spaces, href and content; `link` is the href as an absolute http(s) URL, if `pages` has its page's url.

    A group `name:adapter` is sought on pages of that `adapter` only, if `pages` has that column. For a group named in `scopes` nodes are sought below each
    node of that selector, whose node_id is `scope`. Of a group named in `best`, a function of (rank, size, n_links) to a score or None, just the
    node with the greatest score leaves the worker, of equal ones that of the earlier selector, then the earlier node: with `bare`, its text by lines without scripts
    and links, `size`, the length of its clean text, and n_links, the links below. So nested blocks cost one copy of a page's text, not one each."""
    keys = [f for f in pages.schema.fields if f.name != "html"]
    names = [k.name for k in keys]
    scopes, best = scopes or {}, best or {}

    def wanted(adapter: str | None):
        """What is asked of a page: (group, place) of each selector by number, the numbers of the groups' scopes, and the automaton of both."""
        asked = [(g, i, s) for g, some in groups.items() if adapter is None or g.rpartition(":")[2] in (g, adapter) for i, s in enumerate(some)]
        around = sorted({scopes[g] for g, _, _ in asked if g in scopes})
        numbers = {s: len(asked) + i for i, s in enumerate(around)}
        held = {g: numbers[scopes[g]] for g, _, _ in asked if g in scopes}
        return [(g, i) for g, i, _ in asked], held, Automaton([s for _, _, s in asked] + around, frozenset(numbers.values())), any(g in best for g, _, _ in asked)

    def rows(html: str, sought: tuple, base: str | None):
        asked, held, automaton, measured = sought
        resolve = urls.Resolver(base) if base else lambda href: None
        tree = Tree(html, automaton)
        if measured:
            tree.measure()
        top: dict[str, tuple] = {}
        for node in tree.nodes:
            for number in node.picks:
                if number >= len(asked):
                    continue
                g, i = asked[number]
                if g in best:
                    size = max(0, node.size - 1)
                    score = best[g](i, size, node.n_links)
                    if score is not None and (g not in top or (score, -i) > top[g][0]):
                        top[g] = (score, -i), node, i, size
                    continue
                for scope in [None] if g not in held else [at for n, at in node.scopes if n == held[g]]:
                    yield g, i, node.id, scope, node.tag, " ".join(node.strings()), None, None, None, node.attrs.get("href"), resolve(node.attrs.get("href")), node.attrs.get("content")
        for g, (_, node, i, size) in top.items():
            yield g, i, node.id, None, node.tag, None, "\n".join(node.strings(bare=True)), size, node.n_links, None, None, None

    def run(batches):
        sought = functools.lru_cache(maxsize=64)(wanted)
        for b in batches:
            htmls = b.column("html")
            adapters = b.column("adapter").to_pylist() if "adapter" in names else [None] * b.num_rows
            bases = b.column("url").to_pylist() if "url" in names else [None] * b.num_rows
            at, found, held = [], [], 0

            def flush():
                take = pa.array(at, pa.int32())
                columns = [b.column(n).take(take) for n in names]
                columns += [pa.array([r[j] for r in found], kind) for j, (_, kind) in enumerate(_FIELDS)]
                return pa.RecordBatch.from_arrays(columns, [*names, *(n for n, _ in _FIELDS)])

            for i in range(b.num_rows):
                html = htmls[i].as_py()
                for row in rows(html, sought(adapters[i]), bases[i]) if html else ():
                    at.append(i)
                    found.append(row)
                    held += len(row[5] or "") + len(row[6] or "")
                if held > MOST_BYTES:
                    yield flush()
                    at, found, held = [], [], 0
            yield flush()

    ddl = ", ".join(f"`{k.name}` {k.dataType.simpleString()}" for k in keys)
    return pages.select(*names, "html").mapInArrow(run, f"{ddl}, {SCHEMA}")
