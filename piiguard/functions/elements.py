"""Columns over page elements: roles, interaction, typed-field rules, visual gate, geometry."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
INTERACTIVE_TAGS = ("A", "BUTTON", "INPUT", "SELECT", "TEXTAREA", "OPTION", "OPTGROUP")
INTERACTIVE_ROLES = (
    "button link menuitem tab checkbox radio slider spinbutton textbox searchbox combobox listbox option menuitemcheckbox menuitemradio".split()
)
IMPLICIT_ROLES = {
    "A": "link", "BUTTON": "button", "INPUT": "textbox", "SELECT": "combobox", "TEXTAREA": "textbox", "IMG": "img",
    "H1": "heading", "H2": "heading", "H3": "heading", "H4": "heading", "H5": "heading", "H6": "heading",
    "FORM": "form", "NAV": "navigation", "MAIN": "main", "ARTICLE": "article", "SECTION": "region",
    "ASIDE": "complementary", "HEADER": "banner", "FOOTER": "contentinfo",
}
#: The sanitizer's roles: no headings; any other tag is its own role.
CONTEXT_ROLES = {k: v for k, v in IMPLICIT_ROLES.items() if v != "heading"}
TYPED_RULES = (
    ("password", "critical", "password", ("current-password", "new-password", "one-time-code")),
    ("email", "high", "email", ("email", "username")),
    ("phone", "high", "tel", (
        "tel", "tel-national", "tel-area-code", "tel-country-code", "tel-local", "tel-local-prefix", "tel-local-suffix", "tel-extension",
    )),
    ("credit_card", "critical", None, ("cc-number", "cc-name", "cc-exp", "cc-exp-month", "cc-exp-year", "cc-csc", "cc-type")),
    ("ssn", "critical", None, ("ssn",)),
    ("address", "medium", None, (
        "street-address", "address-line1", "address-line2", "address-line3", "address-level1", "address-level2", "address-level3", "address-level4",
        "postal-code", "country", "country-name",
    )),
    ("name", "medium", None, ("name", "given-name", "additional-name", "family-name", "honorific-prefix", "honorific-suffix", "nickname")),
)
LABEL_RULES = (
    ("password", "password"), ("passcode", "password"), ("pin", "password"), ("secret", "password"), ("ssn", "ssn"), ("social security", "ssn"),
    ("credit card", "credit_card"), ("card number", "credit_card"), ("cvv", "credit_card"), ("cvc", "credit_card"), ("expiration", "credit_card"),
    ("email", "email"), ("e-mail", "email"), ("phone", "phone"), ("telephone", "phone"), ("mobile", "phone"),
    ("address", "address"), ("street", "address"), ("zip", "address"), ("postal", "address"),
)
GATE_KEYWORDS = {
    "face": "face avatar profile portrait headshot".split(),
    "id": "id-card idcard passport driver license identity".split(),
    "document": "document document-upload upload-document verify-document kyc".split(),
}
CANVAS_WORDS = ("face", "avatar", "portrait")
REGIONS = {"IMG": "image", "CANVAS": "canvas", "VIDEO": "video", "SVG": "svg"}
SENSITIVE_TYPES = ("password", "credit_card", "ssn", "email", "phone", "address", "name")
FACE_WORDS = "face avatar profile portrait headshot id-card idcard passport driver".split()
VISUAL_TAGS = ("IMG", "CANVAS", "VIDEO", "SVG")
VIEW_WIDTH, VIEW_HEIGHT = 1024.0, 768.0


def any_in(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return F.coalesce(out, F.lit(False))


def interactive(tag: Column, role: Column, tabindex: Column, editable: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return tag.isin(*INTERACTIVE_TAGS) | yes(role.isin(*INTERACTIVE_ROLES)) | yes(tabindex != "-1") | yes(editable != "false")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def role_of(tag: Column, role: Column) -> Column:
    """The role attribute, or where it is missing or empty the tag's own role."""
    return F.coalesce(F.nullif(role, F.lit("")), _lookup(IMPLICIT_ROLES, tag))


def context_role(tag: Column) -> Column:
    return F.coalesce(_lookup(CONTEXT_ROLES, tag), F.lower(tag))


def region_of(tag: Column, xmlns: Column, w: Column, h: Column) -> Column:
    """The kind of visual region that an element of some size is; null for none."""
    kind = F.coalesce(_lookup(REGIONS, tag), F.when(F.contains(xmlns, F.lit("svg")), F.lit("svg")))
    return F.when((w != 0) & (h != 0), kind)


def typed_field(tag: Column, kind: Column, autocomplete: Column, role: Column, label: Column) -> Column:
    """The first rule that holds: struct of type, severity and rule; null where none does."""
    ac, text = F.lower(F.coalesce(autocomplete, F.lit(""))), F.lower(F.coalesce(label, F.lit("")))
    result = lambda t, s, r: F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"), F.lit(r).alias("rule"))
    field, out = tag.isin("INPUT", "TEXTAREA"), None
    for name, severity, typed, tokens in TYPED_RULES:
        hit = any_in(ac, tokens)
        hit = field & ((F.coalesce(kind == typed, F.lit(False)) | hit) if typed else hit)
        out = (F if out is None else out).when(hit, result(name, severity, f"l1_{name}"))
    out = out.when(F.coalesce(role.isin("password", "searchbox"), F.lit(False)), result("password", "critical", "l1_role"))
    for word, name in LABEL_RULES:
        out = out.when(F.contains(text, F.lit(word)), result(name, "high", "l1_label"))
    return out


def offscreen(position: Column, left: Column, top: Column, transform: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Placed or moved over two views away, or with no pixel inside the view."""
    placed = position.isin("absolute", "fixed") & ((left < -VIEW_WIDTH) | (top < -VIEW_HEIGHT) | (left > 2 * VIEW_WIDTH) | (top > 2 * VIEW_HEIGHT))
    moves = r"translate\(?\s*(-?\d+(?:\.\d+)?)px?\s*,\s*(-?\d+(?:\.\d+)?)px?\s*\)?"
    by = lambda n: F.abs(F.regexp_extract(transform, moves, n).try_cast("double"))
    moved = F.coalesce((by(1) > 2 * VIEW_WIDTH) | (by(2) > 2 * VIEW_HEIGHT), F.lit(False))
    return placed | moved | (x + w <= 0) | (y + h <= 0) | (x >= VIEW_WIDTH) | (y >= VIEW_HEIGHT)


def default_box(tag: Column) -> tuple[Column, Column]:
    """Width and height where nothing is laid out."""
    field = tag.isin("INPUT", "TEXTAREA", "SELECT", "BUTTON")
    return F.when(field, 200.0).otherwise(100.0), F.when(field, 30.0).otherwise(20.0)


def in_viewport(x: Column, y: Column, w: Column, h: Column) -> Column:
    return (x >= 0) & (y >= 0) & (x + w <= VIEW_WIDTH) & (y + h <= VIEW_HEIGHT)


def visible(display: Column, visibility: Column, opacity: Column, w: Column, h: Column, off: Column) -> Column:
    return ~((display == "none") | (visibility == "hidden") | (opacity == "0") | ((w == 0) & (h == 0)) | off)


def iou(a: str, b: str) -> Column:
    c = lambda p, k: F.col(f"{p}{k}")
    w = F.greatest(F.lit(0.0), F.least(c(a, "x") + c(a, "w"), c(b, "x") + c(b, "w")) - F.greatest(c(a, "x"), c(b, "x")))
    h = F.greatest(F.lit(0.0), F.least(c(a, "y") + c(a, "h"), c(b, "y") + c(b, "h")) - F.greatest(c(a, "y"), c(b, "y")))
    return F.when(w * h > 0, w * h / (c(a, "w") * c(a, "h") + c(b, "w") * c(b, "h") - w * h)).otherwise(F.lit(0.0))


def overlaps(a: str, b: str) -> Column:
    c = lambda p, k: F.col(f"{p}{k}")
    return (c(a, "x") < c(b, "x") + c(b, "w")) & (c(b, "x") < c(a, "x") + c(a, "w")) & (c(a, "y") < c(b, "y") + c(b, "h")) & (c(b, "y") < c(a, "y") + c(a, "h"))


def is_mouth(path: Column) -> Column:
    """A curve that is named a mouth, or has the shape and place of one."""
    curve = path.rlike(r"M\d+,\d+\s*Q\d+,\d+\s*\d+,\d+") & F.contains(path, F.lit("70"))
    return F.coalesce(F.contains(path, F.lit("Q")) & (F.contains(path, F.lit("mouth")) | F.contains(path, F.lit("Mouth")) | curve), F.lit(False))


def count_in(text: Column, words) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + F.contains(text, F.lit(w)).cast("int")
    return out


def face_confidence(indicators: Column) -> Column:
    return F.least(F.lit(0.9), F.lit(0.6) + F.lit(0.1) * indicators)


def nms(boxes: Column, most: int = 10, limit: float = 0.3) -> Column:
    """Greedy suppression over an array of struct(rank, id, score, x, y, w, h): least rank first, of equal ones by id; none overlapping."""
    ordered = F.sort_array(boxes)

    def over(a: Column, b: Column) -> Column:
        w = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
        h = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
        return w * h > limit * (a["w"] * a["h"] + b["w"] * b["h"] - w * h)

    step = lambda kept, b: F.when((F.size(kept) >= most) | F.exists(kept, lambda k: over(k, b)), kept).otherwise(F.array_append(kept, b))
    kind = "array<struct<rank:double,id:int,score:double,x:double,y:double,w:double,h:double>>"
    return F.aggregate(ordered, F.array().cast(kind), step)
