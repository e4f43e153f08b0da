"""CSS selectors over the element trees of many pages: compiled to rows, matched by joins.

A selector is cut into steps, from the left: a compound (tag, id, classes, attributes, place among the siblings of its tag)
and the combinator before it. Elements and compounds meet in an equality join by page and the most telling name of
the compound (id, else class, else tag). Then the matches of each step are those of its elements that stand right to a match of the step before: a
child or next sibling by an equality join, a later sibling by the first match among the parent's children, a
descendant by a window: elements are numbered in document order and know the last number inside them, so an element
is inside a match if and only if some match before it reaches to it, which is a running maximum. No pairs of
ancestors and descendants are made.

Selectors that are not understood (other pseudo-classes, bad names) meet nothing, as ``querySelector`` throws on bad ones.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from piiguard.shared import materialize

_NAME = r"-?[A-Za-z_\u0080-\uffff][A-Za-z0-9_\u0080-\uffff-]*"
_ATTRIBUTE = rf"""\[\s*({_NAME})\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|({_NAME}))\s*)?\]"""
_PLACE = r":nth-of-type\(\s*([1-9][0-9]*)\s*\)"
_COMPOUND = rf"(?:{_NAME}|\*)?(?:#{_NAME}|\.{_NAME}|{_ATTRIBUTE}|{_PLACE}|:first-of-type)*"
_STEP = r"""([\s>+~]*)((?:[^\s>+~\[\]"']|\[[^\]]*\])+)"""


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def alternatives(selector: Column) -> Column:
    """The parts of a selector list."""
    return F.regexp_extract_all(selector, F.lit(r"((?:[^,\[]|\[[^\]]*\])+)"), F.lit(1))


def compile_steps(selectors: DataFrame) -> DataFrame:
    """A row a step of each understood alternative of ``selectors`` (page_id, sid, selector).

    page_id, sid, alt, step (from 1), steps, combinator ('', ' ', '>', '+', '~'), tag, id, classes, attrs, nth, key, and the
    alternative's specificity. A list with an alternative that is not understood has no rows.
    """
    cut = selectors.select("page_id", "sid", "selector", alternatives(F.col("selector")).alias("_cut")).where(F.array_join("_cut", ",") == F.col("selector"))
    alts = cut.select("page_id", "sid", F.posexplode("_cut").alias("alt", "one"), F.size("_cut").alias("_alts"))
    one = _stripped(F.col("one"))
    glue, body = (F.regexp_extract_all(F.col("one"), F.lit(_STEP), F.lit(n)) for n in (1, 2))
    alts = alts.withColumn("one", one).select("page_id", "sid", "alt", "_alts", "one", glue.alias("glue"), body.alias("body"))
    marks = F.transform("glue", lambda g, i: F.when((i == 0) & (g == ""), F.lit("")).when((i > 0) & (F.btrim(g) == ""), F.lit(" ")).otherwise(F.btrim(g)))
    whole = F.array_join(F.transform(F.arrays_zip("glue", "body"), lambda z: F.concat(z["glue"], z["body"])), "") == F.col("one")
    marked = F.transform(marks, lambda m: m.isin(" ", ">", "+", "~"))
    sound = whole & (F.size("body") > 0) & (F.get(marks, F.lit(0)) == "") & F.forall(F.slice(marked, 2, F.size("body")), lambda x: x) & F.forall("body", lambda c: c.rlike(f"^{_COMPOUND}$"))
    alts = alts.withColumn("marks", marks).withColumn("sound", F.coalesce(sound, F.lit(False)))
    all_ = Window.partitionBy("page_id", "sid")
    alts = alts.withColumn("able", (F.count_if("sound").over(all_) == F.col("_alts"))).where("able")
    rows = alts.select("page_id", "sid", "alt", F.size("body").alias("steps"), F.posexplode(F.arrays_zip("marks", "body")).alias("_n", "z"))
    c = F.col("c")
    bare = F.regexp_replace(c, _ATTRIBUTE, "")
    names = lambda mark: F.regexp_extract_all(bare, F.lit(rf"\{mark}({_NAME})"), F.lit(1))
    group = lambda n: F.regexp_extract_all(c, F.lit(_ATTRIBUTE), F.lit(n))
    attrs = F.transform(
        F.arrays_zip(group(1).alias("name"), group(2).alias("op"), group(3).alias("a"), group(4).alias("b"), group(5).alias("d")),
        lambda z: F.struct(F.lower(z["name"]).alias("name"), z["op"].alias("op"), F.concat(z["a"], z["b"], z["d"]).alias("value")),
    )
    nth = F.when(F.contains(bare, F.lit(":first-of-type")), F.lit(1)).otherwise(F.regexp_extract(bare, _PLACE, 1).try_cast("int"))
    rows = rows.select("page_id", "sid", "alt", "steps", (F.col("_n") + 1).alias("step"), F.col("z.marks").alias("combinator"), F.col("z.body").alias("c")).select(
        "page_id", "sid", "alt", "steps", "step", "combinator", F.nullif(F.lower(F.regexp_extract(bare, f"^({_NAME})", 1)), F.lit("")).alias("tag"),
        names("#").alias("ids"), names(".").alias("classes"), attrs.alias("attrs"), nth.alias("nth"),
    )
    first = lambda mark, xs: F.concat(F.lit(mark), F.get(xs, F.lit(0)))
    key = F.coalesce(first("#", "ids"), first(".", "classes"), F.concat(F.lit("<"), F.col("tag")), F.lit("*"))
    weight = F.size("ids") * 1_000_000 + (F.size("classes") + F.size("attrs") + F.col("nth").isNotNull().cast("int")) * 1_000 + F.col("tag").isNotNull().cast("int")
    alt = Window.partitionBy("page_id", "sid", "alt")
    return rows.select("*", key.alias("key"), F.sum(weight).over(alt).alias("specificity"))


def _has(attribute: Column) -> Column:
    """Whether the element's attributes have what one condition asks for."""
    own, want, op = F.try_element_at(F.col("attributes"), attribute["name"]), attribute["value"], attribute["op"]
    some = want != ""
    tests = (
        ("=", own == want), ("~=", F.array_contains(F.split(own, r"\s+"), want)), ("|=", (own == want) | own.startswith(F.concat(want, F.lit("-")))),
        ("^=", some & own.startswith(want)), ("$=", some & own.endswith(want)), ("*=", some & F.contains(own, want)),
    )
    out = own.isNotNull() & (op == "")
    for name, test in tests:
        out = out | ((op == name) & test)
    return F.coalesce(out, F.lit(False))


def match(steps: DataFrame, tree: DataFrame) -> DataFrame:
    """page_id, sid, alt, node of all elements of ``tree`` that the selectors of :func:`compile_steps` meet."""
    own_id = F.try_element_at("attributes", F.lit("id"))
    classes = F.filter(F.split(F.coalesce(F.try_element_at("attributes", F.lit("class")), F.lit("")), r"\s+"), lambda x: x != "")
    nodes = tree.select("page_id", "node", "up", "last", "prev", F.col("nth").alias("_nth"), F.lower("tag").alias("_tag"), "attributes", own_id.alias("_id"), classes.alias("_classes"))
    keys = F.array_distinct(F.array_compact(F.concat(
        F.array(F.concat(F.lit("<"), "_tag"), F.lit("*"), F.concat(F.lit("#"), "_id")), F.transform("_classes", lambda c: F.concat(F.lit("."), c)),
    )))
    met = nodes.withColumn("key", F.explode(keys)).join(steps, ["page_id", "key"])
    fits = (
        (F.col("tag").isNull() | (F.col("tag") == F.col("_tag"))) & (F.col("nth").isNull() | (F.col("nth") == F.col("_nth"))) & F.forall("ids", lambda i: F.coalesce(i == F.col("_id"), F.lit(False)))
        & F.forall("classes", lambda c: F.array_contains("_classes", c)) & F.forall("attrs", _has)
    )
    at = ["page_id", "sid", "alt"]
    # a condition on a row number stays above the join; the optimizer would infer one of the steps alone from the
    # attribute test, whose lambda also reads the element's attributes
    met = met.withColumn("_row", F.monotonically_increasing_id())
    here = materialize(met.where(fits & (F.col("_row") >= 0)).select(*at, "step", "steps", "combinator", "node", "up", "last", "prev"), "candidates")
    # a row a step of the longest selector; combinators that no selector has at a step are left out of its round
    used = {r["step"]: set(r["marks"]) for r in here.groupBy("step").agg(F.collect_set("combinator").alias("marks")).collect()}
    state = here.where("step = 1").select(*at, "steps", "node", "up", "last")
    done = state.where("steps = 1").select(*at, "node")
    columns = [*at, "steps", "node", "up", "last"]
    for k in range(2, max(used, default=0) + 1):
        now, known, found = here.where(F.col("step") == k), state.where(F.col("steps") >= k), []
        by = lambda c, k=known: k.select(*at, F.col("node").alias(c))
        marks = used.get(k, set())
        if ">" in marks:
            found.append(now.where("combinator = '>'").join(by("up"), [*at, "up"], "left_semi"))
        if "+" in marks:
            found.append(now.where("combinator = '+'").join(by("prev"), [*at, "prev"], "left_semi"))
        if "~" in marks:
            first = known.where("up IS NOT NULL").groupBy(*at, "up").agg(F.min("node").alias("_first"))
            found.append(now.where("combinator = '~'").join(first, [*at, "up"]).where("_first < node").drop("_first"))
        if " " in marks:
            marked = now.where("combinator = ' '").withColumn("_reach", F.lit(None).cast("int")).unionByName(known.select(*at, "node", F.col("last").alias("_reach")), allowMissingColumns=True)
            before = Window.partitionBy(*at).orderBy("node").rangeBetween(Window.unboundedPreceding, -1)
            found.append(marked.withColumn("_far", F.max("_reach").over(before)).where("step IS NOT NULL AND _far >= node"))
        if not found:
            break  # no element meets this step, so no selector that has it is met
        # each round reads the one before up to four times, so its result is written: plans would grow by that factor a round
        state = materialize(functools.reduce(DataFrame.unionByName, [f.select(*columns) for f in found]), "matched")
        done = done.unionByName(state.where(F.col("steps") == k).select(*at, "node"))
    return done


def resolve(asked: DataFrame, tree: DataFrame) -> DataFrame:
    """page_id, selector, node: the first element in document order that each of ``asked`` (page_id, selector) meets."""
    selectors = asked.where("selector IS NOT NULL").select("page_id", "selector").distinct().withColumn("sid", F.col("selector"))
    found = match(materialize(compile_steps(selectors), "steps"), tree)
    return found.groupBy("page_id", F.col("sid").alias("selector")).agg(F.min("node").alias("node"))
