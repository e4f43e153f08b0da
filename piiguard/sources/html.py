"""Elements of HTML pages: the only row-wise Python of the library, batched by Arrow."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed values.
# The elements of these tags are skipped, not what is inside them.
SKIPPED = frozenset(("script", "style", "noscript", "meta", "link", "head", "title"))
#: Open elements that end where another begins: by the tag that begins, those it ends.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"),
    "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody"),
}
#: A paragraph ends where one of these begins.
BLOCKS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Inside of these a tag can close itself.
FOREIGN = frozenset(("svg", "math"))
RAW = frozenset(("script", "style"))
SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("elem_idx", pa.int32()), ("parent_idx", pa.int32()), ("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())),
    ("text", pa.string()), ("selector", pa.string()), ("form_id", pa.string()), ("label_text", pa.string()), ("svg_idx", pa.int32()),
])
DDL = "page_id long, elem_idx int, parent_idx int, tag string, attributes map<string,string>, text string, selector string, form_id string, label_text string, svg_idx int"
#: All elements of a page: number in document order, those of the parent, of the last one inside and of the sibling before,
#: place among the siblings of the tag, and a style element's text.
TREE_SCHEMA = pa.schema([*SCHEMA, *[(c, pa.int32()) for c in ("node", "up", "last", "prev", "nth")], ("css", pa.string())])
TREE_DDL = DDL + ", node int, up int, last int, prev int, nth int, css string"
#: Characters of text in the rows that a task holds before it hands them on (the page that crosses it included).
SLICE_CHARS = 8 << 20


class _Walk(HTMLParser):
    """Elements in document order. An element's text is a range of the page's pieces of text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.open, self.pieces, self.opened = [], [], [], Counter()

    def _shut(self, depth: int) -> None:
        for i in self.open[depth:]:
            self.found[i]["last"], self.found[i]["last_node"] = len(self.pieces), len(self.found) - 1
            self.opened[self.found[i]["tag"]] -= 1
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS and self.open and self.found[self.open[-1]]["tag"] == "p":
            self._shut(len(self.open) - 1)
        while self.open and self.found[self.open[-1]]["tag"] in ENDS.get(tag, ()):
            self._shut(len(self.open) - 1)
        parent, here = self.open[-1] if self.open else None, len(self.found)
        self.found.append({
            "tag": tag, "attrs": {k: v or "" for k, v in reversed(attrs)}, "parent": parent, "first": len(self.pieces), "last": len(self.pieces), "last_node": here,
            "kinds": Counter(), "child": None,
        })
        if parent is not None:
            up = self.found[parent]
            up["kinds"][tag] += 1
            self.found[-1]["prev"], up["child"] = up["child"], here
        self.found[-1]["nth"] = 1 if parent is None else self.found[parent]["kinds"][tag]
        if tag not in VOID:
            self.open.append(here)
            self.opened[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in RAW:
            self.set_cdata_mode(tag)
        elif tag not in VOID and (tag in FOREIGN or any(self.opened[t] for t in FOREIGN)):
            self._shut(len(self.open) - 1)

    def handle_endtag(self, tag):
        if self.opened[tag]:
            depth = len(self.open) - 1
            while self.found[self.open[depth]]["tag"] != tag:
                depth -= 1
            self._shut(depth)

    def handle_data(self, data):
        self.pieces.append(data)

    def close(self):
        super().close()
        self._shut(0)

    def text(self, i: int) -> str:
        e = self.found[i]
        return "".join(self.pieces[e["first"] : e["last"]])


def elements_of(page_id, html: str | None, whole: bool = False) -> list[tuple]:
    """Rows of the walk; with ``whole`` of all elements, also those outside the walk, with their places in the tree."""
    walk = _Walk()
    walk.feed(html or "")
    walk.close()
    found, rows, number, n = walk.found, [], {}, 0
    labels: dict[str, str] = {}
    for i, e in enumerate(found):
        if e["tag"] == "label" and "for" in e["attrs"]:
            labels.setdefault(e["attrs"]["for"], walk.text(i).strip())
    for i, e in enumerate(found):
        i_up, a = e["parent"], e["attrs"]
        up = found[i_up] if i_up is not None else None
        e["form"] = a.get("id", "") if e["tag"] == "form" else up and up["form"]
        e["label"] = walk.text(i).strip() if e["tag"] == "label" else up and up["label"]
        # an element with an id is named by it, in the path of those inside it together with its tag
        numbered = up is not None and up["kinds"][e["tag"]] > 1
        part = f"{e['tag']}#{a['id']}" if a.get("id") else e["tag"] + (f":nth-of-type({e['nth']})" if numbered else "")
        e["path"] = part if a.get("id") or up is None or up["tag"] == "body" else f"{up['path']} > {part}"
        e["svg"] = up and (i_up if up["tag"] == "svg" else up["svg"])
        e["in_body"] = up is not None and (up["tag"] == "body" or up["in_body"])
        walked = e["tag"] not in SKIPPED and e["in_body"]
        text = label = None
        if walked:
            number[i], n = n, n + 1
            field = e["tag"] in ("input", "textarea", "select")
            text = a.get("value", "") if field else walk.text(i).strip() or None
            label = (labels.get(a.get("id")) or e["label"]) if field else None
        elif not whole:
            continue
        selector = f"#{a['id']}" if a.get("id") else e["path"]
        row = (page_id, number.get(i), number.get(i_up), e["tag"].upper(), list(a.items()), text, selector, e["form"], label, number.get(e["svg"]))
        rows.append((*row, i, i_up, e["last_node"], e.get("prev"), e["nth"], walk.text(i) if e["tag"] == "style" else None) if whole else row)
    return rows


def _parsed(pages: DataFrame, whole: bool) -> DataFrame:
    schema = TREE_SCHEMA if whole else SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for page, html in zip(*batch.columns, strict=True):
                more = elements_of(page.as_py(), html.as_py(), whole)
                rows += more
                held += sum(len(r[5] or "") + 200 for r in more)
                if held >= SLICE_CHARS:
                    yield batch_of()
                    rows, held = [], 0
        if rows:
            yield batch_of()

    return pages.select("page_id", "html").mapInArrow(run, TREE_DDL if whole else DDL)


def walk(pages: DataFrame) -> DataFrame:
    """One row an element of each page (page_id, html) that the walk meets; null html has none."""
    return _parsed(pages, False)


def tree(pages: DataFrame) -> DataFrame:
    """One row an element of each page (page_id, html), with its place in the tree; ``elem_idx`` is null outside the walk."""
    return _parsed(pages, True)


def register_walk(spark: SparkSession, name: str = "walk") -> None:
    """The walk as a table function for SQL: ``SELECT p.page_id, w.* FROM pages p, LATERAL walk(p.html) w``.

    A call holds one page; rows go through Arrow.
    """

    class Walk:
        def eval(self, html: str | None):
            for row in elements_of(None, html):
                yield (*row[1:4], dict(row[4]), *row[5:])

    spark.udtf.register(name, F.udtf(Walk, returnType=DDL.removeprefix("page_id long, "), useArrow=True))
