import random
from xml.etree import ElementTree

import pytest

from piiguard.sources.html import elements_of

PAGE = """<html><head><title>t</title></head><body><form id="f"><label for="a">Mail</label><input id="a" type="email" value="x">
<label>Pin <input name="p"></label></form><div><p>One <b>two</b><p>three<script>no</script></div></body></html>"""


def test_walk():
    rows = {(r[3], r[1]): r for r in elements_of(1, PAGE)}
    tags = [k[0] for k in sorted(rows, key=lambda k: k[1])]
    assert tags == ["FORM", "LABEL", "INPUT", "LABEL", "INPUT", "DIV", "P", "B", "P"]
    first = next(r for r in rows.values() if r[3] == "INPUT")
    assert first[5] == "x" and first[6] == "#a" and first[7] == "f" and first[8] == "Mail"
    assert next(r for r in rows.values() if r[3] == "B")[6] == "div > p:nth-of-type(1) > b"


def test_empty():
    assert elements_of(1, None) == [] and elements_of(1, "") == []


def test_labels_of_elements(spark):
    from piiguard.operators import pages as O
    from piiguard.sources import html

    body = "<body><span id='n'>Your name</span><span id='n'>other</span><input aria-labelledby='n'><input aria-label='own' aria-labelledby='n'><label>Mail <input></label></body>"
    walked = html.walk(spark.createDataFrame([(1, body), (2, None)], "page_id long, html string"))
    named = {r["elem_idx"]: r["aria_label"] for r in O.aria_labels(walked).collect()}
    assert named == {0: None, 1: None, 2: "Your name", 3: "own", 4: None, 5: None}
    assert {r["elem_idx"]: r["label_text"] for r in walked.collect() if r["tag"] == "INPUT"} == {2: None, 3: None, 5: "Mail"}


def test_elements_end_where_others_begin():
    rows = elements_of(1, "<body><p>a<div>b<table><tr><td>c<td>d<tr><td>e</table></div><dl><dt>f<dd>g<dt>h</dl><ul><li>i<ul><li>j</ul><li>k</ul></body>")
    got = [(r[3], r[2], r[5]) for r in rows]
    assert got[:2] == [("P", None, "a"), ("DIV", None, "bcde")] and [g[2] for g in got if g[0] == "TD"] == ["c", "d", "e"]
    assert [g[2] for g in got if g[0] in ("DT", "DD")] == ["f", "g", "h"] and [g[2] for g in got if g[0] == "LI"] == ["ij", "j", "k"]


def tree_rows(node, out, parent=None):
    """Rows of an element tree by recursion, the plain way."""
    for child in node:
        out.append([child.tag.upper(), parent, "".join(child.itertext()).strip() or None, child])
        tree_rows(child, out, len(out) - 1)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_walk_equals_a_tree(seed):
    rng = random.Random(seed)

    def grow(depth):
        tag = rng.choice(["div", "span", "b", "section", "a"])
        own = f' id="x{rng.randint(0, 999)}"' if rng.random() < 0.2 else ""
        inside = "".join(grow(depth + 1) if rng.random() < 0.6 and depth < 5 else rng.choice(["t", " u &amp; ", ""]) for _ in range(rng.randint(0, 4)))
        return f"<{tag}{own}>{inside}</{tag}>"

    page = "<html><body>" + "".join(grow(0) for _ in range(4)) + "</body></html>"
    body = ElementTree.fromstring(page)[0]
    want, rows = tree_rows(body, []), elements_of(1, page)
    assert [(r[3], r[2], r[5]) for r in rows] == [tuple(w[:3]) for w in want]
    up = {child: parent for parent in body.iter() for child in parent}
    for row, (_, _, _, node) in zip(rows, want, strict=True):
        parts = []
        while node is not body:  # the selector, from the element up to the first one with an id
            if node.get("id"):
                parts.append(f"{node.tag}#{node.get('id')}" if parts else f"#{node.get('id')}")
                break
            same = [c for c in up[node] if c.tag == node.tag]
            parts.append(node.tag + (f":nth-of-type({same.index(node) + 1})" if len(same) > 1 else ""))
            node = up[node]
        assert row[6] == " > ".join(reversed(parts))
