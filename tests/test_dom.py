"""The selection of nodes against plain walks, and what it costs."""

import random
import time

from foliant.functions import fixed, text
from foliant.operators import chapters, dom, links

SELECTORS = ["a", "a[href]", "#i1", ".c1", "div.c2", ".c1 .c2 a", "#i2 div a[href]", "[class*='c']", "[id*='i']", "[class='c1 c2']", "div div", "p, .c3 b", "div#i1.c1[title]", "b[title='x, y'] a", ".c1 .c1", "p b p"]


def page(rng, n):
    out, open_ = [], []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.45:
            tag = rng.choice(["div", "p", "a", "b", "script", "br"])
            attrs = "".join(rng.choice([f" id=i{rng.randrange(3)}", f" class='{' '.join(rng.sample(['c1', 'c2', 'c3'], rng.randrange(4)))}'", " href=/x", " title='x, y'", " title", ""]) for _ in range(rng.randrange(3)))
            out.append(f"<{tag}{attrs}>")
            open_.append(tag)
        elif kind < 0.75:
            out.append(rng.choice(["t", " two  words ", "\n", "a\r\nb", "&amp;", "x\x1cy", "é　"]))
        elif open_:
            out.append(f"</{open_.pop(rng.randrange(len(open_)))}>")
    return "".join(out)


def test_the_automaton_against_walks():
    rng = random.Random(1)
    scopes = frozenset({3, 10})
    machine = dom.Automaton(SELECTORS, scopes)
    for _ in range(300):
        tree = dom.Tree(page(rng, rng.randrange(60)), machine)
        for node in tree.nodes:
            assert node.picks == tuple(i for i, s in enumerate(SELECTORS) if dom.matches(node, s))
            above, at = [], node.parent
            while at is not tree.root:
                above = [(i, at.id) for i in sorted(scopes) if dom.matches(at, SELECTORS[i])] + above
                at = at.parent
            assert list(node.scopes) == above


def test_subtree_sums_against_walks(spark):
    rng = random.Random(2)
    for _ in range(300):
        tree = dom.Tree(page(rng, rng.randrange(60)))
        tree.measure()
        for node in tree.nodes:
            lines = [" ".join(x.split()) for s in node.strings() for x in s.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
            assert max(0, node.size - 1) == len("\n".join(x for x in lines if x))
            below = [n for n in tree.nodes if n.tag == "a" and "href" in n.attrs and n is not node and node.id in ancestors(n)]
            assert node.n_links == len(below)
    joined = ["a\r\nb", " two  words ", "x\x1cy"]
    rows = spark.createDataFrame([("\n".join(joined),)], "t string").select(text.clean_lines("t").alias("t")).first()
    tree = dom.Tree(f"<p>{joined[0]}<b>{joined[1]}</b>{joined[2]}")
    tree.measure()
    assert tree.nodes[0].size - 1 == len(rows.t)


def ancestors(node):
    out = set()
    while node.parent.parent is not None:  # the document is no node
        node = node.parent
        out.add(node.id)
    return out


class Counted(dom.Automaton):
    """Counts the moves that nodes look at."""

    looked = 0

    def enter(self, node, up):
        super().enter(node, up)
        bits = self.tags.get(node.tag, 0)
        for pair in node.attrs.items():
            bits |= self.memo.get(pair, 0)
        Counted.looked += len(self.met.get(bits, ()))


def test_work_does_not_grow_with_the_selectors():
    html = "".join(f"<div class='row r{i}'><p>text <b>x</b></p><a href='/{i}'>l</a></div>" for i in range(500))
    every = [s for some in (*links.catalog_groups().values(), *chapters.content_groups().values(), fixed.TITLE_SELECTORS) for s in some]
    looked = []
    for selectors in ([".row a[href]"], [".row a[href]", *(f".none{i} #no{i} a.never{i}" for i in range(400))]):
        Counted.looked = 0
        dom.Tree(html, Counted(selectors))
        looked.append(Counted.looked)
    assert looked[0] == looked[1] > 0
    assert len(every) > 80
    dom.Tree(html, dom.Automaton(every))


def test_nested_blocks_cost_no_more_than_flat_ones():
    def took(depth):
        html = "<div class='content'>" * depth + "<p>words and words</p>" * 4000 + "</div>" * depth
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            dom.Tree(html, dom.Automaton([".content"])).measure()
            best = min(best, time.perf_counter() - began)
        return best

    assert took(400) < 2 * took(4) + 0.05
