"""Selectors and the cascade against plain walks over the same trees."""

import random
import re

import pytest

from piiguard.operators import selectors as S, styles as Y
from piiguard.sources import html

TAGS, IDS, CLASSES = ["div", "span", "b", "ul", "p"], ["a1", "b-2", "c_3"], ["x", "y", "hide"]


class Node:
    def __init__(self, rng, parent=None, depth=0):
        self.tag, self.up, self.kids = rng.choice(TAGS[:4] if depth < 5 else TAGS), parent, []
        self.attrs = {}
        if rng.random() < 0.3:
            self.attrs["id"] = rng.choice(IDS)
        if rng.random() < 0.5:
            self.attrs["class"] = " ".join(rng.sample(CLASSES, rng.randint(1, 2)))
        if rng.random() < 0.2:
            self.attrs["data-k"] = rng.choice(["", "one two", "one-two", "three"])
        if rng.random() < 0.25:
            self.attrs["style"] = rng.choice(["display:none", "visibility: VISIBLE", "visibility:hidden !important", "opacity: 0.0", "color:red;display:block", "position:fixed;left:-2000px", "transform:translate(-3000px, 1px)", "display:"])
        if depth < 6 and self.tag != "p":
            self.kids = [Node(rng, self, depth + 1) for _ in range(rng.randint(0, 3 if depth else 4))]

    def html(self):
        attrs = "".join(f' {k}="{v}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" + "".join(k.html() for k in self.kids) + f"</{self.tag}>"

    def walk(self):
        yield self
        for k in self.kids:
            yield from k.walk()


def page(seed, css=""):
    rng = random.Random(seed)
    body = Node(rng)
    body.tag, body.attrs = "body", {}
    body.kids = [Node(rng, body, 1) for _ in range(4)]
    return body, f"<html><head><style>{css}</style></head>{body.html()}</html>"


def compound(rng):
    """Text, test and weight of a random compound."""
    tag, tests, weight = rng.choice([*TAGS, "*", ""]), [], 0
    text = tag
    if tag not in ("", "*"):
        tests.append(lambda n: n.tag == tag)
        weight += 1
    for _ in range(rng.randint(0 if text else 1, 2)):
        kind, which = rng.randint(0, 3), rng.choice(CLASSES)
        if kind == 0:
            name = rng.choice(IDS)
            text, weight = text + f"#{name}", weight + 1_000_000
            tests.append(lambda n, i=name: n.attrs.get("id") == i)
        elif kind == 1:
            text, weight = text + f".{which}", weight + 1_000
            tests.append(lambda n, c=which: c in n.attrs.get("class", "").split())
        elif kind == 2 and ":nth" not in text:
            i = rng.randint(1, 3)
            text, weight = text + f":nth-of-type({i})", weight + 1_000
            tests.append(lambda n, i=i: n.up is None and i == 1 or n.up is not None and [k for k in n.up.kids if k.tag == n.tag].index(n) + 1 == i)
        else:
            op, value, test = rng.choice([
                ("", "", lambda v: v is not None), ("=", "three", lambda v: v == "three"), ("~=", "two", lambda v: v is not None and "two" in v.split()), ("|=", "one", lambda v: v is not None and (v == "one" or v.startswith("one-"))),
                ("^=", "one", lambda v: v is not None and v.startswith("one")), ("$=", "two", lambda v: v is not None and v.endswith("two")), ("*=", "e t", lambda v: v is not None and "e t" in v),
            ])
            text, weight = text + (f'[data-k{op}"{value}"]' if op else "[data-k]"), weight + 1_000
            tests.append(lambda n, t=test: t(n.attrs.get("data-k")))
    return text, lambda n: all(t(n) for t in tests), weight


def selector(rng):
    text, tests, marks, weight = "", [], [], 0
    for i in range(rng.randint(1, 4)):
        mark = rng.choice([" ", " ", ">", "+", "~"]) if i else ""
        own, test, more = compound(rng)
        text += (f" {mark} " if mark.strip() else mark) + own
        tests.append(test)
        marks.append(mark)
        weight += more

    def meets(n, i=None):
        i = len(tests) - 1 if i is None else i
        if n is None or not tests[i](n):
            return False
        if i == 0:
            return True
        before = [] if n.up is None else n.up.kids[: n.up.kids.index(n)]
        if marks[i] == ">":
            return meets(n.up, i - 1)
        if marks[i] == "+":
            return bool(before) and meets(before[-1], i - 1)
        if marks[i] == "~":
            return any(meets(b, i - 1) for b in before)
        while n.up is not None:
            n = n.up
            if meets(n, i - 1):
                return True
        return False

    return text, meets, weight


def order(body):
    """Numbers of the nodes in the page: html, head and style stand before the body."""
    return {id(n): i + 3 for i, n in enumerate(body.walk())}


def test_selectors_meet_what_a_plain_search_meets(spark):
    rng, pages, asked, want = random.Random(7), [], [], set()
    for p in range(12):
        body, text = page(p)
        pages.append((p, text))
        number = order(body)
        for k in range(25):
            alts = [selector(rng) for _ in range(rng.choice([1, 1, 2]))]
            asked.append((p, f"s{k}", ", ".join(a[0] for a in alts)))
            want |= {(p, f"s{k}", i, number[id(n)]) for i, (_, meets, _) in enumerate(alts) for n in body.walk() if meets(n)}
    tree = html.tree(spark.createDataFrame(pages, "page_id long, html string")).where("tag NOT IN ('HTML', 'HEAD', 'STYLE')")
    tree = tree.cache()
    # the html element is not part of these plain trees
    tree = tree.withColumn("up", S.F.when(S.F.col("tag") != "BODY", S.F.col("up"))).withColumn("prev", S.F.when(S.F.col("tag") != "BODY", S.F.col("prev")))
    steps = S.compile_steps(spark.createDataFrame(asked, "page_id long, sid string, selector string"))
    got = {tuple(r) for r in S.match(steps, tree).select("page_id", "sid", "alt", "node").collect()}
    assert got == want and len(want) > 500


@pytest.mark.parametrize("bad", ["", "#1a", "p >", "> p", "p > > b", "p:hover", "p..x", "p#", "a b:nth-of-type(0)", "p, :bad", "[x", "p[=a]", "p &"])
def test_bad_selectors_meet_nothing(spark, bad):
    assert S.compile_steps(spark.createDataFrame([(1, "s", bad)], "page_id long, sid string, selector string")).count() == 0


def test_resolve_takes_the_first_element(spark):
    text = "<body><p>1</p><div><p>2</p></div><p id='k'>3</p><i id='1a'></i><section><div id='d'><p>4</p><p>5</p></div></section></body>"
    tree = html.tree(spark.createDataFrame([(1, text)], "page_id long, html string"))
    rows = {r["node"]: (r["tag"], r["text"], r["selector"]) for r in tree.collect()}
    found = {r["selector"]: rows[r["node"]][:2] for r in S.resolve(tree, tree).collect()}
    own = {s: (t, x) for t, x, s in rows.values()}
    assert set(own) - set(found) == {"#1a"}
    # some selectors meet an earlier element than the one that they were made from
    assert own["div > p"] == ("P", "2") == found["div > p"] and found["div#d > p:nth-of-type(2)"] == ("P", "5") and own["section"] == found["section"]
    assert found["p:nth-of-type(1)"] == ("P", "1")


def brute_visible(body, css, sheet):
    """visible of each node by a plain cascade and recursion."""
    declared, out = {}, {}
    parsed = []
    for source, text in ((-1, sheet), (2, css)):
        for rule, (names, test, weight, block) in enumerate(text):
            parsed.append((source, rule, test, weight, block))
    for n in body.walk():
        rows = []
        for source, rule, meets, weight, block in parsed:
            if meets(n):
                rows += [((bool(imp), 0, weight, source, rule, i), prop, value) for i, (prop, value, imp) in enumerate(block)]
        for i, part in enumerate(n.attrs.get("style", "").split(";")):
            m = re.fullmatch(r"\s*([a-z]+)\s*:\s*(.*?)\s*(!important)?\s*", part)
            if m and m[2]:
                rows.append(((bool(m[3]), 1, 0, 0, 0, i), m[1], m[2].lower()))
        best = {}
        for rank, prop, value in rows:
            if prop not in best or rank > best[prop][0]:
                best[prop] = (rank, value)
        declared[id(n)] = {p: v for p, (_, v) in best.items()}

    def down(n, gone, vis):
        own = declared[id(n)]
        gone, vis = gone or own.get("display") == "none", own.get("visibility", vis)
        off = own.get("position") == "fixed" and own.get("left") == "-2000px" or own.get("transform") == "translate(-3000px, 1px)"
        out[id(n)] = not (gone or vis == "hidden" or float(own.get("opacity", "1")) == 0 or off)
        for k in n.kids:
            down(k, gone, vis)

    down(body, False, "visible")
    return out


BLOCKS = [[("display", "none", "")], [("display", "block", "")], [("display", "inline", "!important")], [("visibility", "hidden", "")], [("visibility", "visible", "!important")],
          [("opacity", "0", ""), ("opacity", "1", "")], [("opacity", "0", "")], [("position", "fixed", ""), ("left", "-2000px", "")], [("color", "red", "")]]


def test_visibility_equals_a_plain_cascade(spark):
    rng, pages, want = random.Random(3), [], {}
    sheet = [(".hide", lambda n: "hide" in n.attrs.get("class", "").split(), 1_000, [("display", "none", "")])]
    for p in range(25):
        made = [(*selector(rng), rng.choice(BLOCKS)) for _ in range(rng.randint(0, 5))]
        css = "/* p {display:none} */ @media print { p { display: none } } @import url(x);" + "".join(f"{s} {{ {'; '.join(f'{a} : {b}{c}' for a, b, c in block)} }}\n" for s, _, _, block in made)
        body, text = page(p, css)
        pages.append((p, text))
        shown, number = brute_visible(body, made, sheet), order(body)
        want |= {(p, number[id(n)]): shown[id(n)] for n in body.walk()}
    tree = html.tree(spark.createDataFrame(pages, "page_id long, html string")).where("tag NOT IN ('HTML', 'HEAD')")
    tree = tree.withColumn("up", S.F.when(S.F.col("tag") != "BODY", S.F.col("up"))).withColumn("prev", S.F.when(S.F.col("tag") != "BODY", S.F.col("prev"))).cache()
    plain = tree.where("tag <> 'STYLE' OR css IS NOT NULL").withColumn("node", S.F.col("node"))
    told = {(r["page_id"], r["node"]): r["visible"] for r in Y.visibility(plain.union(spark.createDataFrame([(p, *[None] * 2, "HTML", {}, None, None, None, None, None, 0, None, 0, None, 1, None) for p, _ in pages], plain.schema)), ".hide { display: none }").collect()}
    got = {k: told.get(k, True) for k in want}
    assert got == want and 100 < sum(want.values()) < len(want) - 100


def test_pages_without_rules_have_no_rows(spark):
    tree = html.tree(spark.createDataFrame([(1, "<html><head><style>p{margin:0}</style></head><body><p>x</p></body></html>"), (2, None)], "page_id long, html string"))
    assert Y.visibility(tree).count() == 0


def test_long_selectors_leave_a_plan_of_their_steps(spark):
    """each round read the one before four times, so plans grew by that factor a step."""
    depth = 9
    tree = html.tree(spark.createDataFrame([(1, "<body>" + "<div>" * depth + "</div>" * depth + "</body>")], "page_id long, html string")).localCheckpoint()
    asked = spark.createDataFrame([(1, "body" + " > div" * n) for n in range(1, depth + 1)] + [(1, "body div div + div"), (1, "body div ~ div")], "page_id long, selector string")
    met = S.resolve(asked, tree)
    assert "Join" not in met._jdf.queryExecution().optimizedPlan().toString()
    first = {r["node"]: r["selector"] for r in met.collect()}
    assert [first[n].count("div") for n in sorted(first)] == list(range(1, depth + 1))
